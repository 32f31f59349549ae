"""The registered queries of the numbered operators and, where SQL can say the same, their oracles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import divergence, htmltext, langid, merkle, packing, pii, quality, rans, rules, simhash, spm, topk, warc
from .common import held_out_sql, new_folder


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    filters = langid.fit(docs.where(f"NOT coalesce({held_out_sql()}, false)"))
    found = docs.withColumn("found", langid.language(docs, filters))
    return found.select("doc_id", F.expr(f"coalesce({held_out_sql()}, false)").alias("held_out"), F.col("found.lang").alias("lang_pred"), F.col("found.score").alias("score"))


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(_table(spark, sf_dir, "documents"))


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    found = pii.with_spans(docs, pii.fit(docs))
    base, both = F.col("pii.base"), F.array_sort(F.concat("pii.base", "pii.added"))
    of_kind = lambda k: lambda s: s["kind"] == k
    counts = [F.size(F.filter(base, of_kind(k))).cast("long").alias(f"n_{name}") for k, name in enumerate(pii.KINDS)]
    return found.select("doc_id", *counts, F.sha2(pii.joined(base).cast("binary"), 256).alias("base_sha256"), pii.joined(both).alias("spans"))


def trusted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of documents labelled as of good quality, less those held out."""
    return _table(spark, sf_dir, "labels").where(f"quality = 1 AND NOT {held_out_sql()}").select("doc_id")


def op4_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    model = rules.ratios(docs, trusted(spark, sf_dir))
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "score")
    return docs.withColumn("v", rules.verdict(docs, model)).select("doc_id", *[F.col(f"v.{n}").alias(n) for n in names])


def op10_spm(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _table(spark, sf_dir, "documents").select("doc_id", spm.checked(F.col("text"), spm.piece_model()).alias("found"))
    return found.select("doc_id", "found.*")


PREDICTED_FROM = 0.7


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    labels = _table(spark, sf_dir, "labels").where(f"NOT {held_out_sql()}").select("doc_id", F.col("quality").alias("label"))
    vectors = quality.word_vectors(docs)
    network = quality.fit(docs, labels, vectors)
    scored = docs.select("doc_id", F.expr(f"coalesce({held_out_sql()}, false)").alias("held_out"), quality.score(docs, vectors, network).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= PREDICTED_FROM).cast("int"))


def op6_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(_table(spark, sf_dir, "embeddings"))


def op7_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = _table(spark, sf_dir, "pages").withColumn("text", htmltext.main_text(F.col("html")))
    return text.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents"), packing.word_tokenizer())


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_folder(spark, "warc")
    warc.write_archives(_table(spark, sf_dir, "pages"), path)
    return warc.read_archives(spark, path)


def op11_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    leaf = lambda n: merkle.leaf_digest(F.col("doc_id"), F.col("source"), F.col("lang"), n, F.col("text"))
    tampered = F.expr("crc32(cast(cast(doc_id as string) as binary)) % 7 = 0 AND n_chars IS NOT NULL")
    m = merkle.manifest(docs, F.col("lang"), F.col("doc_id"), leaf(F.col("n_chars")), F.when(tampered, leaf(F.col("n_chars") + 1)))
    found = merkle.proofs(m, m.leaves)
    return found.select(F.col("id").alias("doc_id"), "leaf", "subroot", "root", F.col("proof").alias("proof_sha256"), "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


def op12_rans(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_folder(spark, "token-ids")
    rans.write(_table(spark, sf_dir, "documents"), path, packing.word_tokenizer())
    return rans.read(spark, path)


def op13_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(_table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (op1_langid, op2_simhash, op3_pii, op4_rules, op5_quality, op6_topk, op7_html, op8_packing, op9_warc, op10_spm, op11_merkle, op12_rans, op13_divergence)}

ORACLES = {
    "op6_topk": """
        WITH e AS (
            SELECT row_number() OVER () AS row, vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS q
            FROM embeddings
            WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
        ), s AS (
            SELECT a.row, a.vec_id AS query_id, b.vec_id, CAST(list_sum(list_transform(list_zip(a.q, b.q), lambda p: p[1] * p[2])) AS BIGINT) AS score
            FROM e a JOIN e b ON a.vec_id % 50 = 0 AND a.row <> b.row
        ), r AS (
            SELECT query_id, CAST(row_number() OVER (PARTITION BY row ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s
        )
        SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
    """,
    "op9_warc": """
        WITH h AS (
            SELECT page_id, CAST(octet_length(encode(coalesce(html, ''))) AS BIGINT) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages
        ), g AS (
            SELECT *, CASE WHEN payload_bytes >= 100 THEN min(page_id) OVER (PARTITION BY payload_digest) ELSE page_id END AS original FROM h
        )
        SELECT page_id, payload_bytes, payload_digest, CASE WHEN original <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
            CASE WHEN original <> page_id THEN original END AS refers_to
        FROM g
    """,
    "op11_merkle": """
        WITH RECURSIVE crc AS (
            SELECT doc_id, xor(4294967295, list_reduce(list_concat([4294967295::BIGINT], list_transform(split(CAST(doc_id AS VARCHAR), ''), lambda x: ascii(x)::BIGINT)),
                lambda c, b: list_reduce(list_concat([xor(c, b)], range(8)), lambda e, i: xor(e >> 1, (e & 1) * 3988292384)))) AS crc
            FROM (SELECT DISTINCT doc_id FROM documents WHERE doc_id IS NOT NULL)
        ), d AS (
            SELECT doc_id, coalesce('+' || lang, '') AS tree, n_chars IS NOT NULL AND coalesce(crc % 7 = 0, false) AS tampered, coalesce(octet_length(encode(CAST(doc_id AS VARCHAR))) || ':' || doc_id, '-')
                || coalesce(octet_length(encode(source)) || ':' || source, '-') || coalesce(octet_length(encode(lang)) || ':' || lang, '-') AS head,
                coalesce(octet_length(encode(CAST(n_chars AS VARCHAR))) || ':' || n_chars, '-') AS own, coalesce(octet_length(encode(CAST(n_chars + 1 AS VARCHAR))) || ':' || (n_chars + 1), '-') AS other,
                coalesce(octet_length(encode(text)) || ':' || text, '-') AS tail
            FROM documents LEFT JOIN crc USING (doc_id)
        ), h AS (
            SELECT doc_id, tree, tampered, sha256(head || own || tail) AS leaf, sha256(head || other || tail) AS claimed FROM d
        ), leaves AS (
            SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY tree) AS n FROM h
        ), nodes AS (
            SELECT tree, 0 AS level, pos, leaf AS digest, n FROM leaves
            UNION ALL
            SELECT tree, level + 1, pos // 2, sha256(string_agg(digest, '' ORDER BY pos)), (n + 1) // 2 FROM nodes WHERE n > 1 GROUP BY tree, level, pos // 2, n
        ), subroots AS (
            SELECT tree, digest AS subroot, level AS height, row_number() OVER (ORDER BY tree COLLATE "C") - 1 AS place, count(*) OVER () AS trees FROM nodes WHERE n = 1
        ), tops AS (
            SELECT 0 AS level, place AS pos, subroot AS digest, trees AS n FROM subroots
            UNION ALL
            SELECT level + 1, pos // 2, sha256(string_agg(digest, '' ORDER BY pos)), (n + 1) // 2 FROM tops WHERE n > 1 GROUP BY level, pos // 2, n
        ), paths AS (
            SELECT l.tree, l.pos AS leaf_pos, v.level, l.pos >> v.level & 1 AS digit, s.digest AS other
            FROM leaves l JOIN subroots USING (tree) CROSS JOIN LATERAL (SELECT unnest(range(height)) AS level) v
            LEFT JOIN nodes s ON s.tree = l.tree AND s.level = v.level AND s.pos = xor(l.pos >> v.level, 1)
            UNION ALL
            SELECT l.tree, l.pos, height + v.level, place >> v.level & 1, s.digest
            FROM leaves l JOIN subroots USING (tree) CROSS JOIN LATERAL (SELECT unnest(range((SELECT max(level) FROM tops))) AS level) v
            LEFT JOIN tops s ON s.level = v.level AND s.pos = xor(place >> v.level, 1)
        ), folds AS (
            SELECT tree, pos, 0 AS level, CASE WHEN tampered THEN claimed ELSE leaf END AS digest FROM leaves
            UNION ALL
            SELECT f.tree, f.pos, f.level + 1, sha256(CASE digit WHEN 1 THEN coalesce(other, '') || digest ELSE digest || coalesce(other, '') END)
            FROM folds f JOIN paths p ON p.tree = f.tree AND p.leaf_pos = f.pos AND p.level = f.level
        ), proofs AS (
            SELECT tree, leaf_pos, sha256(coalesce(string_agg(other, '' ORDER BY level), '')) AS proof_sha256 FROM paths GROUP BY ALL
        ), ends AS (
            SELECT tree, pos, arg_max(digest, level) AS folded_root FROM folds GROUP BY ALL
        )
        SELECT doc_id, leaf, subroot, digest AS root, coalesce(proof_sha256, sha256('')) AS proof_sha256, folded_root, folded_root = digest AS verified
        FROM leaves l JOIN subroots USING (tree) JOIN (SELECT digest FROM tops WHERE n = 1) ON true JOIN ends e ON e.tree = l.tree AND e.pos = l.pos
        LEFT JOIN proofs p ON p.tree = l.tree AND p.leaf_pos = l.pos
    """,
    "op13_divergence": r"""
        WITH d AS (
            SELECT row_number() OVER () AS row, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
                regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS terms FROM documents
        ), g AS (
            SELECT DISTINCT lang, source FROM d
        ), w AS (
            SELECT row, lang, source, unnest(terms) AS term FROM d
        ), k AS (
            SELECT lang, term, count(*) AS n_lang FROM w GROUP BY lang, term HAVING count(DISTINCT row) >= 30
        ), c AS (
            SELECT lang, source, term, count(*) AS n FROM w GROUP BY ALL
        ), f AS (
            SELECT g.lang, g.source, k.term, coalesce(n, 0) AS n, n_lang, count(*) OVER (PARTITION BY g.lang, g.source) AS v,
                sum(coalesce(n, 0)) OVER (PARTITION BY g.lang, g.source) AS total, sum(coalesce(n, 0)) OVER (PARTITION BY g.lang) AS total_lang
            FROM g JOIN k USING (lang) LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term
        ), s AS (
            SELECT lang, source, term, n, 1 + (1000000000::HUGEINT * (n + 5)) // (total + 5 * v) AS p, 1 + (1000000000::HUGEINT * (n_lang + 5)) // (total_lang + 5 * v) AS q FROM f
        ), sums AS (
            SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value FROM s a JOIN s b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL
        ), parts AS (
            SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0) AS value
            FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN sums ON sums.lang = a.lang AND sums.source = a.source AND sums.item = b.source
            UNION ALL
            SELECT lang, source, 'term', term, p - q FROM s WHERE n > 0 AND p > q
        ), r AS (
            SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item COLLATE "C") AS INTEGER) AS rank FROM parts
        )
        SELECT * FROM r WHERE part = 'pair' OR rank <= 50
    """,
}
