"""Queries of the text functions over documents, pages, conversations, part, customer and supplier."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators.catalog import fingerprint
from ..operators.shared import stored
from .registry import registry, table

QUERIES, ORACLES, register = registry()


@register("SELECT doc_id, regexp_replace(trim(regexp_replace(text, '[\\s\\x{00A0}]+', ' ', 'g')), '^ | $', '', 'g') AS t FROM documents")
def sc01_collapse(spark, sf_dir):
    """SC-01."""
    return table(spark, sf_dir, "documents").select("doc_id", T.collapsed(F.col("text")).alias("t"))


@register("SELECT doc_id, regexp_replace(lower(text), '[^\\p{L}\\p{N}]', '', 'g') AS t FROM documents")
def sc03_squash(spark, sf_dir):
    """SC-02, SC-03."""
    return table(spark, sf_dir, "documents").select("doc_id", T.squashed(F.col("text")).alias("t"))


@register("SELECT p_partkey, rtrim(left(trim(regexp_replace(lower(p_name || ' / ' || p_type), '[^\\p{L}\\p{N}\\p{M}]+', '-', 'g'), '-'), 24), '-') AS slug FROM part")
def sc07_slug(spark, sf_dir):
    """SC-06, SC-07."""
    return table(spark, sf_dir, "part").select("p_partkey", T.slug(F.concat_ws(" / ", "p_name", "p_type"), 24).alias("slug"))


@register("""WITH t AS (SELECT doc_id, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS t FROM documents) SELECT doc_id, CASE WHEN length(t) <= 120 THEN t ELSE CASE WHEN contains(left(t, 120), ' ') THEN regexp_replace(left(t, 120), ' [^ ]*$', '') ELSE left(t, 120) END || '…' END AS snippet FROM t""")
def sc08_snippets(spark, sf_dir):
    """SC-08."""
    return table(spark, sf_dir, "documents").select("doc_id", T.snippet(F.col("text")).alias("snippet"))


@register("SELECT doc_id, CAST(ceil(round(length(text) / 3.5, 6)) AS BIGINT) AS tokens FROM documents")
def sc09_token_estimate(spark, sf_dir):
    """SC-09."""
    return table(spark, sf_dir, "documents").select("doc_id", T.token_estimate(F.col("text")).alias("tokens"))


@register("SELECT doc_id, CASE WHEN length(regexp_replace(text, '[^A-Za-zÀ-ɏऀ-ॿ]', '', 'g')) = 0 THEN NULL WHEN length(regexp_replace(text, '[^ऀ-ॿ]', '', 'g')) * 10 >= 3 * length(regexp_replace(text, '[^A-Za-zÀ-ɏऀ-ॿ]', '', 'g')) THEN 'hi' ELSE 'en' END AS script FROM documents")
def sc13_script(spark, sf_dir):
    """SC-13."""
    return table(spark, sf_dir, "documents").select("doc_id", T.script_language(F.col("text")).alias("script"))


@register("SELECT doc_id, array_to_string(list_transform(string_split(text, '|'), lambda c: regexp_replace(trim(c, ' '), '^:?-{2,}:?$', '-')), '|') AS t FROM documents WHERE contains(text, '|')")
def sc17_compact_tables(spark, sf_dir):
    """SC-17: texts with cell marks."""
    return table(spark, sf_dir, "documents").where(F.contains("text", F.lit("|"))).select("doc_id", T.compact_table(F.col("text")).alias("t"))


WORDS = "list_filter(string_split_regex(lower(text), '[^\\p{L}\\p{N}]+'), lambda t: length(t) >= 3 AND t NOT IN (" + ", ".join(f"'{w}'" for w in T.STOP_WORDS) + "))"


@register(f"SELECT conv_id, turn, len(list_distinct({WORDS}))::INTEGER AS n, list_sort(list_distinct({WORDS})) AS words FROM conversations")
def sc24_content_words(spark, sf_dir):
    """SC-24."""
    w = T.content_words(F.col("text"))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.size(w).alias("n"), F.array_sort(w).alias("words"))


@register(f"""WITH w AS (SELECT DISTINCT unnest({WORDS}) AS word FROM conversations) SELECT word, CASE WHEN regexp_matches(word, 'ies$') AND length(word) > 4 THEN regexp_replace(word, 'ies$', 'y') WHEN regexp_matches(word, '(sses|ches|shes|xes)$') THEN regexp_replace(word, 'es$', '')
    WHEN regexp_matches(word, '[^s]s$') AND length(word) > 3 THEN regexp_replace(word, 's$', '') ELSE word END AS stem FROM w""")
def sc23_stems(spark, sf_dir):
    """SC-23."""
    w = table(spark, sf_dir, "conversations").select(F.explode(T.content_words(F.col("text"))).alias("word")).distinct()
    return w.select("word", T.stem(F.col("word")).alias("stem"))


SKELETON = "regexp_replace(replace(replace(replace(replace(replace(replace(replace(replace(regexp_replace(lower({0}), '[^a-z]', '', 'g'), 'ph', 'f'), 'ck', 'k'), 'qu', 'k'), 'q', 'k'), 'w', 'v'), 'x', 'ks'), 'z', 's'), 'c', 'k'), '[aeiouyh]', '', 'g')"


@register("SELECT p_partkey, " + "regexp_replace(" * 21 + SKELETON.format("p_name") + "".join(f", '{c}+', '{c}', 'g')" for c in "bcdfgjklmnpqrstvwxzhy") + " AS key FROM part")
def sc27_sound_keys(spark, sf_dir):
    """SC-27, JN-20."""
    return table(spark, sf_dir, "part").select("p_partkey", T.sound_key(F.col("p_name")).alias("key"))


@register("""WITH u AS (SELECT page_id, url, regexp_replace(lower(regexp_extract(url, '^[a-zA-Z]+://([^/?#]*)', 1)), '^www\\.', '') AS host, rtrim(regexp_extract(url, '^[a-zA-Z]+://[^/?#]*([^?#]*)', 1), '/') AS path,
    list_sort(list_filter(string_split(regexp_extract(url, '^[^?#]*\\?([^#]*)', 1), '&'), lambda p: p <> '' AND NOT (string_split(lower(p), '=')[1] IN ('fbclid', 'gclid', 'msclkid', 'ref', 'ref_src', 'igshid', 'mc_cid', 'mc_eid')) AND NOT starts_with(lower(p), 'utm_'))) AS q FROM pages)
    SELECT page_id, host || path || CASE WHEN len(q) > 0 THEN '?' || array_to_string(q, '&') ELSE '' END AS key FROM u""")
def sc70_url_keys(spark, sf_dir):
    """SC-70."""
    return table(spark, sf_dir, "pages").select("page_id", T.url_key(F.col("url")).alias("key"))


@register("""WITH k AS (SELECT page_id, url, page_id % 3 AS engine, regexp_replace(lower(regexp_extract(url, '^[a-zA-Z]+://([^/?#]*)', 1)), '^www\\.', '') AS host FROM pages), r AS (SELECT *, row_number() OVER (PARTITION BY engine, host ORDER BY page_id) AS r FROM k)
    SELECT host, min(page_id) AS first, count(*) AS n FROM r WHERE r <= 2 GROUP BY 1""")
def src11_search_merge(spark, sf_dir):
    """SRC-11, ST-12: results of several engines, at most two of an engine and host, one row for each host with the first to arrive."""
    from ..operators.retrieval import top_per

    p = table(spark, sf_dir, "pages").select("page_id", (F.col("page_id") % 3).alias("engine"), F.regexp_replace(F.lower(F.regexp_extract("url", r"^[a-zA-Z]+://([^/?#]*)", 1)), r"^www\.", "").alias("host"))
    return top_per(p, ["engine", "host"], [F.col("page_id")], 2, "r").groupBy("host").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n"))


@register("WITH p AS (SELECT doc_id, unnest(string_split_regex(text, '\\n\\s*\\n')) AS p FROM documents) SELECT doc_id, count(*) AS n, CAST(sum(length(trim(regexp_replace(p, '\\s+', ' ', 'g')))) AS BIGINT) AS chars FROM p WHERE trim(regexp_replace(p, '\\s+', ' ', 'g')) <> '' GROUP BY 1")
def src03_paragraphs(spark, sf_dir):
    """SRC-03."""
    p = table(spark, sf_dir, "documents").select("doc_id", F.explode(T.paragraphs(F.col("text"))).alias("p"))
    return p.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("p")).cast("long").alias("chars"))


@register()
def src13_page_text(spark, sf_dir):
    """SRC-13."""
    b = T.readable(F.col("html"))
    return table(spark, sf_dir, "pages").select("page_id", F.size(b).alias("blocks"), F.array_join(b, "\n").alias("text"))


@register()
def sc16_sentences(spark, sf_dir):
    """SC-16: the pattern looks behind, which the oracle's regular expressions can't."""
    return table(spark, sf_dir, "documents").select("doc_id", F.posexplode(T.sentences(F.col("text"))).alias("pos", "sentence"))


@register()
def sc12_tails(spark, sf_dir):
    """SC-12."""
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", T.tail(F.col("text"), 24).alias("tail"))


@register("""SELECT a.s_suppkey, b.c_custkey FROM supplier a JOIN customer b ON a.s_nationkey = b.c_nationkey AND levenshtein(regexp_extract(a.s_name, '[0-9]+$'), regexp_extract(b.c_name, '[0-9]+$')) <= 1""")
def jn21_edit_distance(spark, sf_dir):
    """SC-25, JN-21: names within one edit, blocked on the nation; they meet by equal keys, so that no name is compared with all others of its nation."""
    s = table(spark, sf_dir, "supplier").select("s_suppkey", F.col("s_nationkey").alias("k"), F.regexp_extract("s_name", "[0-9]+$", 0).alias("a"))
    c = table(spark, sf_dir, "customer").select("c_custkey", F.col("c_nationkey").alias("k"), F.regexp_extract("c_name", "[0-9]+$", 0).alias("b"))
    one, other = s.withColumn("key", F.explode(T.one_edit_keys(F.col("a"), "-", "+"))), c.withColumn("key", F.explode(T.one_edit_keys(F.col("b"), "+", "-")))
    return one.join(other, ["k", "key"]).where(~F.col("key").startswith("*") | (F.col("a") != F.col("b"))).select("s_suppkey", "c_custkey")


@register("""WITH w AS (SELECT p_partkey, unnest(string_split(lower(p_name), ' ')) AS t FROM part), q AS (SELECT DISTINCT p_brand AS brand, unnest(string_split(lower(p_type), ' ')) AS t FROM part)
    SELECT brand, p_partkey, count(DISTINCT t) AS shared FROM q JOIN w USING (t) GROUP BY ALL""")
def jn18_label_overlap(spark, sf_dir):
    """JN-18, JN-19: words of a question (here: a brand's types) against words of labels, by an equi-join on the word.

    Labels are dealt by their key over a number of tasks that grows with their rows, and a label's words are made distinct before they meet the brands, so a task counts
    the pairs of some 25,000 labels at a time, however large the file or few the row groups it came from. The brands' words are written first, so the planner knows how few they are."""
    p = table(spark, sf_dir, "part")
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-p.count() // 25_000))
    w = p.select("p_partkey", F.explode(F.split(F.lower("p_name"), " ")).alias("t")).repartition(tasks, "p_partkey").distinct()
    q = stored(p.select(F.col("p_brand").alias("brand"), F.explode(F.split(F.lower("p_type"), " ")).alias("t")).distinct(), "brand-words")
    return w.join(q, "t").groupBy("brand", "p_partkey").agg(F.count(F.lit(1)).alias("shared"))


@register("SELECT page_id, coalesce(sha256('chunk|' || doc), '') AS point, doc AS chunk_id FROM (SELECT page_id, page_id || ':v' || (1 + page_id % 3) || ':' || lpad((page_id % 50)::VARCHAR, 4, '0') AS doc FROM pages)")
def sc64_chunk_ids(spark, sf_dir):
    """SC-64."""
    i = F.format_string("%d:v%d:%04d", F.col("page_id"), 1 + F.col("page_id") % 3, F.col("page_id") % 50)
    return table(spark, sf_dir, "pages").select("page_id", fingerprint(F.array(i), "chunk").alias("point"), i.alias("chunk_id"))


@register("""SELECT conv_id, turn, CASE WHEN regexp_matches(lower(text), '\\b(show|draw|plot|chart|graph)\\b') THEN 'visual' WHEN regexp_matches(lower(text), '\\b(today|latest|current|live|news)\\b') THEN 'live' WHEN regexp_matches(lower(text), '\\b(no,|i meant|not that|wrong)') THEN 'correction'
    WHEN regexp_matches(lower(text), '\\?\\s*$|^(what|who|when|where|why|how|which|is|are|do|does|did|can)\\b') THEN 'question' ELSE 'statement' END AS intent FROM conversations
    WHERE len(list_filter(string_split_regex(lower(text), '[^a-z]+'), lambda t: t <> '' AND NOT (t IN ('ok', 'okay', 'yes', 'yeah', 'right', 'sure', 'hmm', 'mm', 'uh', 'thanks') OR regexp_matches(t, '^(h+m+|m+|u+h*|a+h+|o+h+)$')))) > 0""")
def flt15_intents(spark, sf_dir):
    """FLT-14, FLT-15, FLT-17, FLT-21, FLT-23, UD-09: turns that say more than an acknowledgement, by their cues."""
    return table(spark, sf_dir, "conversations").where(~T.backchannel(F.col("text"))).select("conv_id", "turn", T.intent(F.col("text")).alias("intent"))


@register("SELECT lang, array_to_string(x[1:3], ', ') || ', … ' || x[-1] || ' (' || len(x) || ' in all)' AS line FROM (SELECT lang, list_sort(list(DISTINCT source)) AS x FROM documents GROUP BY 1) WHERE len(x) > 4")
def sc41_short_lists(spark, sf_dir):
    """SC-41."""
    x = table(spark, sf_dir, "documents").groupBy("lang").agg(F.array_sort(F.collect_set("source")).alias("x")).where(F.size("x") > 4)
    return x.select("lang", T.short_list(F.col("x")).alias("line"))


@register("SELECT page_id, CASE WHEN n < 1024 THEN n || ' B' WHEN n < 1048576 THEN round(n / 1024, 1)::DOUBLE || ' KB' ELSE round(n / 1048576, 1)::DOUBLE || ' MB' END AS size FROM (SELECT page_id, octet_length(encode(html)) AS n FROM pages)")
def sc42_sizes(spark, sf_dir):
    """SC-42."""
    return table(spark, sf_dir, "pages").select("page_id", T.size_text(F.octet_length("html")).alias("size"))


@register("SELECT doc_id, regexp_replace(text, '([\\\\`*_\\[\\]<>|])', '\\\\\\1', 'g') AS t FROM documents")
def sc33_escape(spark, sf_dir):
    """SC-33."""
    return table(spark, sf_dir, "documents").select("doc_id", T.clip(F.col("text"), 1 << 30).alias("t"))


@register("SELECT conv_id, turn, 'Source: ' || role || chr(10) || text AS embed FROM conversations")
def sc22_embed_text(spark, sf_dir):
    """SC-22: parts joined by line ends, empty ones left out."""
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.concat_ws("\n", F.concat(F.lit("Source: "), "role"), F.nullif(F.trim(F.lit(" ")), F.lit("")), "text").alias("embed"))


@register("SELECT doc_id, CASE WHEN lang = 'en' THEN 'english' ELSE 'native' END AS reranker, lang FROM documents")
def ud04_rerank_dispatch(spark, sf_dir):
    """UD-04: which query text a passage's scorer gets."""
    return table(spark, sf_dir, "documents").select("doc_id", F.when(F.col("lang") == "en", "english").otherwise("native").alias("reranker"), "lang")
