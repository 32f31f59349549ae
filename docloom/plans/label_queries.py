"""Queries of labels, ids, the guarded replacement of datasets, and the coverage of facts by chunks."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import labels as L
from ..functions.text import chunk_id, point_id
from ..operators.catalog import fact_coverage, replaced_if_present
from ..sources.frames import DOCUMENTS_SQL, documents
from .registry import registry, table

QUERIES, ORACLES, register = registry()

PARTS = """p AS (SELECT l_orderkey, l_linenumber, p_name, p_type, l_quantity::INTEGER AS start, (l_quantity + l_linenumber % 3)::INTEGER AS stop, l_returnflag, o_orderpriority FROM lineitem JOIN part ON l_partkey = p_partkey JOIN orders ON l_orderkey = o_orderkey)"""


@register(f"""WITH {PARTS}, s AS (SELECT *, CASE WHEN l_returnflag = 'R' THEN NULL ELSE start END AS a, p_type || ' > ' || p_name AS section FROM p)
    SELECT l_orderkey, l_linenumber, CASE WHEN l_returnflag = 'N' THEN 'web: ' || p_type || ' — ' || p_name ELSE p_type || ', ' || CASE WHEN a IS NULL THEN '§ ' || p_name ELSE
        CASE WHEN start = stop THEN CASE WHEN o_orderpriority LIKE '1%' THEN 'पृ. ' ELSE 'p. ' END || start ELSE CASE WHEN o_orderpriority LIKE '1%' THEN 'पृ. ' ELSE 'pp. ' END || start || '–' || stop END END END AS label,
        '§ ' || section AS whole_section FROM s""")
def sc20_reference_labels(spark, sf_dir):
    """SC-20: a line's part as a source, its quantity as the page, its return flag telling pages of the web and sources without pages."""
    # What the part alone says is made once for each part and not for each of its lines.
    section = L.section_of(F.array("p_type", F.lit(" "), "p_name"))
    fixed = [L.section_label(section, short=False).alias("whole_section"), L.reference_label(F.col("p_type"), F.col("p_name"), F.lit(True), *[F.lit(None)] * 4).alias("site")]
    parts = table(spark, sf_dir, "part").select("p_partkey", "p_type", L.section_label(section).alias("short_section"), *fixed)
    orders = table(spark, sf_dir, "orders").select("o_orderkey", F.when(F.col("o_orderpriority").startswith("1"), "hi").otherwise("en").alias("language"))
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_returnflag", "l_quantity")
    j = lines.join(parts, F.col("l_partkey") == F.col("p_partkey")).join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
    start = F.when(F.col("l_returnflag") != "R", F.col("l_quantity").cast("int"))
    page = L.document_place(F.col("p_type"), start, (F.col("l_quantity") + F.col("l_linenumber") % 3).cast("int"), F.col("short_section"), F.col("language"))
    return j.select("l_orderkey", "l_linenumber", F.when(F.col("l_returnflag") == "N", F.col("site")).otherwise(page).alias("label"), "whole_section")


@register("""WITH f AS (SELECT doc_id, lang || '_' || source || '-report.v' || doc_id % 3 || '.pdf' AS filename, regexp_extract(text, '^[^\\n]*') AS line FROM documents), t AS (SELECT *, trim(regexp_replace(line, '[\\s\\x{00A0}\\x{200B}\\x{FEFF}]+', ' ', 'g')) AS title FROM f),
    n AS (SELECT *, regexp_replace(regexp_replace(filename, '\\.[^.]*$', ''), '[\\s_\\-.]+', ' ', 'g') AS name, CASE WHEN title <> '' AND length(title) <= 120 THEN title END AS own FROM t)
    SELECT doc_id, name, own AS title, CASE WHEN own IS NULL OR len(list_filter(string_split_regex(trim(regexp_replace(lower(own), '[\\s_\\-.]+', ' ', 'g')), '\\s+'), lambda w: w <> '' AND NOT list_contains(string_split(name, ' '), w))) = 0 THEN name ELSE name || ': ' || own END AS label FROM n""")
def sc21_document_labels(spark, sf_dir):
    """SC-21: the label of each document from a file name of its language and source and from its first line, and the label split again."""
    name = F.concat("lang", F.lit("_"), "source", F.lit("-report.v"), (F.col("doc_id") % 3).cast("string"), F.lit(".pdf"))
    item = F.struct(F.get(F.split("text", "\n", 2), F.lit(0)).alias("text"), F.lit("title").alias("label"), F.lit(None).cast("int").alias("level"), F.lit(1).alias("page"))
    d = table(spark, sf_dir, "documents").select("doc_id", name.alias("filename"), L.document_title(F.array(item)).alias("title"))
    label = L.document_label(F.col("filename"), F.col("title"))
    return d.select("doc_id", L.split_document_label(label)["name"].alias("name"), "title", label.alias("label"))


@register(f"""WITH {DOCUMENTS_SQL}, tables AS (SELECT id, version, unnest([1, 2]) AS table_id FROM docs WHERE status <> 'FAILED'), stored AS (SELECT id, 1 AS version, 1 AS table_id, 'old' AS body FROM docs),
    new AS (SELECT id, CASE WHEN id % 4 = 0 THEN version + 1 ELSE version END AS version, unnest([1, CASE WHEN id % 5 = 0 THEN 3 ELSE 2 END]) AS table_id, 'new' AS body FROM docs WHERE id % 3 > 0),
    done AS (SELECT DISTINCT id FROM docs WHERE id % 3 > 0 AND id % 4 > 0 AND id % 5 > 0 AND status <> 'FAILED')
    SELECT id AS document_id, version, table_id, body FROM stored WHERE id NOT IN (SELECT id FROM done) UNION ALL SELECT id, version, table_id, body FROM new WHERE id IN (SELECT id FROM done)""")
def dm08_replace_datasets(spark, sf_dir):
    """DM-08: datasets of documents replaced where the version is still the document's and the tables are there."""
    d = documents(spark, sf_dir).select(F.col("id").alias("document_id"), "version", "status")
    tables = d.where("status <> 'FAILED'").select("document_id", "version", F.explode(F.array(F.lit(1), F.lit(2))).alias("table_id"))
    stored = d.select("document_id", F.lit(1).alias("version"), F.lit(1).alias("table_id"), F.lit("old").alias("body"))
    i = F.col("document_id")
    new = d.where("document_id % 3 > 0").select("document_id", F.when(i % 4 == 0, F.col("version") + 1).otherwise(F.col("version")).alias("version"), F.explode(F.array(F.lit(1), F.when(i % 5 == 0, 3).otherwise(2))).alias("table_id"), F.lit("new").alias("body"))
    return replaced_if_present(stored, new, d, tables)[0]


@register("""WITH c AS (SELECT doc_id, doc_id || ':v' || (1 + doc_id % 3) || ':' || lpad(unnest(range(1 + n_chars // 2000))::VARCHAR, 4, '0') AS chunk_id FROM documents), h AS (SELECT *, sha1(unhex('5b0f6a4e2f0c4c1a9a433f8e0f3c2d71') || encode(chunk_id)) AS h FROM c)
    SELECT doc_id, chunk_id, substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-5' || substr(h, 14, 3) || '-' || (['8', '9', 'a', 'b'])[(strpos('0123456789abcdef', substr(h, 17, 1)) - 1) % 4 + 1] || substr(h, 18, 3) || '-' || substr(h, 21, 12) AS point FROM h""")
def sc64_point_ids(spark, sf_dir):
    """SC-64: the ids of all chunks of 2,000 characters of every document."""
    chunks = table(spark, sf_dir, "documents").select("doc_id", F.explode(F.sequence(F.lit(0), F.floor(F.col("n_chars") / 2000).cast("int"))).alias("i"))
    return chunks.select("doc_id", chunk_id(F.col("doc_id"), 1 + F.col("doc_id") % 3, F.col("i")).alias("chunk_id")).select("doc_id", "chunk_id", point_id(F.col("chunk_id")).alias("point"))


FACTS = """f AS (SELECT item_id AS fact, string_split(text, ' ') AS w FROM benchmark), facts AS (SELECT fact, list_distinct([lower(w[1] || ' ' || w[2] || ' ' || w[3]), lower(w[len(w) - 1] || ' ' || w[len(w)])]) AS evidence, [1, 4 + fact % 5] AS pages FROM f WHERE len(w) > 3),
    l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS i FROM documents), chunks AS (SELECT doc_id, i // 8 AS page, string_agg(line, chr(10) ORDER BY i) AS text FROM l GROUP BY ALL)"""


@register(f"""WITH {FACTS}, held AS (SELECT fact, page, pages FROM facts JOIN chunks ON list_bool_and(list_transform(evidence, lambda e: contains(lower(text), e))))
    SELECT fact, count(page) AS chunks, count(*) FILTER (WHERE list_bool_or(list_transform(held.pages, lambda p: p BETWEEN page + 1 AND page + 2))) AS stating FROM facts LEFT JOIN held USING (fact) GROUP BY 1""")
def jn11_fact_coverage(spark, sf_dir):
    """JN-11: the start and the end of each benchmark passage as its evidence, against chunks of eight lines of all documents, two pages each."""
    w = F.split("text", " ")
    word = lambda i: F.element_at(w, i)
    evidence = F.array(F.concat_ws(" ", word(1), word(2), word(3)), F.concat_ws(" ", word(-2), word(-1)))
    facts = table(spark, sf_dir, "benchmark").where(F.size(w) > 3).select(F.col("item_id").alias("fact"), evidence.alias("evidence"), F.array(F.lit(1), (4 + F.col("item_id") % 5).cast("int")).alias("pages"))
    lines = F.split("text", "\n")
    cut = table(spark, sf_dir, "documents").select("doc_id", F.explode(F.transform(F.sequence(F.lit(0), F.floor((F.size(lines) - 1) / 8).cast("int")), lambda i: F.struct(i.alias("page"), F.array_join(F.slice(lines, i * 8 + 1, F.lit(8)), "\n").alias("text")))).alias("c"))
    chunks = cut.select((F.col("doc_id") * 100_000 + F.col("c.page")).alias("chunk"), "c.text", (F.col("c.page") + 1).alias("page_start"), (F.col("c.page") + 2).alias("page_end"))
    return fact_coverage(facts, chunks)
