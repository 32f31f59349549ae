"""Queries of charts and of the remaining predicates and joins, over yearly sums per nation, conversations, documents and pages."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import visual as V
from ..operators.retrieval import top_per
from ..operators.shared import numbered
from ..sources.frames import DOCUMENTS_SQL, MESSAGES_SQL, documents, messages
from .registry import registry, table
from .table_queries import SUMS, sums

QUERIES, ORACLES, register = registry()

VALUES = f"{SUMS}, v AS (SELECT table_id, segment AS series, fy AS x, v * (CASE WHEN table_id % 4 = 0 AND segment = 'FURNITURE' THEN -1 ELSE 1 END) AS value, CASE WHEN table_id % 3 = 0 AND segment = 'HOUSEHOLD' THEN 'USD' ELSE 'INR' END AS unit FROM s WHERE table_id % 2 = 0 OR segment <> 'BUILDING')"
PROFILE = f"{VALUES}, p AS (SELECT table_id, count(DISTINCT series) AS n_series, count(DISTINCT x) AS n_x, count(DISTINCT unit) AS n_units, count(*) FILTER (WHERE value < 0) AS negatives FROM v GROUP BY 1)"
KINDS = "k AS (SELECT * FROM (VALUES " + ", ".join(f"('{k}', {a}, {b}, {c}, {d}, {str(k in V.SINGLE_UNIT).lower()}, {str(k in V.NO_NEGATIVES).lower()})" for k, (a, b, c, d) in V.LIMITS.items()) + ") t(kind, a, b, c, d, single, positive))"
AGAINST = """list_filter([CASE WHEN n_series < a THEN 'too few series' END, CASE WHEN n_series > b THEN 'too many series' END, CASE WHEN n_x < c THEN 'too few points' END, CASE WHEN n_x > d THEN 'too many points' END,
    CASE WHEN single AND n_units > 1 THEN 'mixed units' END, CASE WHEN positive AND negatives > 0 THEN 'negative values' END], lambda x: x IS NOT NULL)"""


def values(spark, sf_dir):
    s = sums(spark, sf_dir).where("table_id % 2 = 0 OR segment <> 'BUILDING'")
    value = F.when((F.col("table_id") % 4 == 0) & (F.col("segment") == "FURNITURE"), -F.col("v")).otherwise(F.col("v"))
    return s.select("table_id", F.col("segment").alias("series"), F.col("fy").alias("x"), value.alias("value"), F.when((F.col("table_id") % 3 == 0) & (F.col("segment") == "HOUSEHOLD"), "USD").otherwise("INR").alias("unit"))


@register(f"WITH {PROFILE}, {KINDS} SELECT p.*, kind, {AGAINST} AS problems FROM p, k")
def vq01_problems(spark, sf_dir):
    """VQ-01, VQ-02."""
    return V.problems(V.profile(values(spark, sf_dir)))


@register(f"""WITH {PROFILE}, {KINDS}, ok AS (SELECT table_id, list(kind) AS ok FROM p, k WHERE len({AGAINST}) = 0 GROUP BY 1), w AS (SELECT p.*, CASE table_id % 3 WHEN 0 THEN 'stacked_bar' WHEN 1 THEN 'donut' ELSE 'line' END AS wanted, ok FROM p LEFT JOIN ok USING (table_id))
    SELECT table_id, n_series, n_x, n_units, negatives, wanted, CASE WHEN list_contains(ok, wanted) THEN wanted WHEN wanted = 'stacked_bar' AND list_contains(ok, 'grouped_bar') THEN 'grouped_bar' WHEN list_contains(ok, 'bar') THEN 'bar' ELSE 'table' END AS kind FROM w""")
def vq10_fallback(spark, sf_dir):
    """VQ-10."""
    t = F.col("table_id") % 3
    return V.built(V.profile(values(spark, sf_dir)), F.when(t == 0, "stacked_bar").when(t == 1, "donut").otherwise("line"))


@register(f"""WITH {PROFILE} SELECT *, CASE WHEN table_id % 2 = 0 THEN CASE WHEN n_x >= 3 THEN 'line' WHEN n_series > 1 THEN 'grouped_bar' ELSE 'bar' END WHEN n_series = 1 AND negatives = 0 AND n_x BETWEEN 2 AND 8 THEN 'donut' WHEN n_series > 1 THEN 'grouped_bar' ELSE 'bar' END AS kind, CASE WHEN n_series > 4 THEN 0.5 ELSE 0.8 END::DOUBLE AS confidence FROM p""")
def vq13_draft(spark, sf_dir):
    """VQ-13, VQ-14."""
    return V.drafted(V.profile(values(spark, sf_dir)), F.col("table_id") % 2 == 0, F.col("negatives") == 0)


OPTIONS = f"{PROFILE}, o AS (SELECT table_id, table_id % 5 AS document, unnest([{{'purpose': 'trend', 'c': 0.5 + 0.01 * n_x}}, {{'purpose': 'composition', 'c': 0.6 + 0.01 * n_series}}]) AS x FROM p)"


@register(f"""WITH {OPTIONS}, b AS (SELECT document, table_id, x.purpose AS purpose, round(x.c, 4)::DOUBLE AS confidence FROM o QUALIFY row_number() OVER (PARTITION BY document, x.purpose ORDER BY round(x.c, 4) DESC, table_id) = 1)
    SELECT *, CAST(row_number() OVER (PARTITION BY document ORDER BY confidence DESC, purpose) AS INTEGER) AS round FROM b""")
def vq12_overview(spark, sf_dir):
    """VQ-12."""
    o = V.profile(values(spark, sf_dir)).select("table_id", (F.col("table_id") % 5).alias("document"), F.explode(F.array(F.struct(F.lit("trend").alias("purpose"), F.round(0.5 + 0.01 * F.col("n_x"), 4).alias("confidence")), F.struct(F.lit("composition").alias("purpose"), F.round(0.6 + 0.01 * F.col("n_series"), 4).alias("confidence")))).alias("x"))
    return V.overview(o.select("table_id", "document", "x.*"), "document")


@register(f"""WITH {VALUES}, e AS (SELECT table_id, list_sort(list(DISTINCT x)) AS periods FROM v GROUP BY 1)
    SELECT table_id, CASE WHEN table_id % 2 = 0 THEN 'bar' ELSE 'line' END AS kind, CASE table_id % 3 WHEN 0 THEN [2000]::INTEGER[] WHEN 1 THEN list_sort(list_distinct(list_append(periods, 2050)))::INTEGER[] ELSE periods::INTEGER[] END AS periods FROM e""")
def vq11_edits(spark, sf_dir):
    """VQ-11."""
    s = values(spark, sf_dir).groupBy("table_id").agg(F.array_sort(F.collect_set("x")).alias("periods")).withColumn("kind", F.lit("line"))
    t = F.col("table_id")
    return V.edited(s, F.when(t % 2 == 0, "bar"), F.when(t % 3 == 0, F.array(F.lit(2000))), F.when(t % 3 == 1, F.array(F.lit(2050))))


@register(f"""WITH {VALUES}, e AS (SELECT DISTINCT table_id, series, unit FROM v), f AS (SELECT *, min(series) OVER (PARTITION BY table_id, unit) AS f FROM e)
    SELECT table_id, series, unit, CAST(dense_rank() OVER (PARTITION BY table_id ORDER BY f) AS INTEGER) AS panel, CAST(row_number() OVER (PARTITION BY table_id ORDER BY series) AS INTEGER) AS colour FROM f""")
def ag38_small_multiples(spark, sf_dir):
    """AG-38."""
    return V.small_multiples(values(spark, sf_dir).select("table_id", "series", "unit").distinct(), "table_id", "series")


@register("""WITH p AS (SELECT o_custkey AS chat, list_sort(list(o_orderkey)) AS ids FROM orders GROUP BY 1) SELECT chat, CASE chat % 4 WHEN 0 THEN array_to_string(list_transform(ids, lambda x: x || CASE WHEN x = ids[1] THEN '*' ELSE '' END), ',')
    WHEN 1 THEN array_to_string(ids[2:], ',') WHEN 2 THEN array_to_string(list_concat([ids[-1]], ids[:-2]), ',') ELSE array_to_string(list_append(ids, -1), ',') END AS panels FROM p""")
def dm09_panels(spark, sf_dir):
    """DM-09: a customer's orders as panels; pinned, removed, moved to the front or added, by the key."""
    p = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("chat")).agg(F.array_sort(F.collect_list("o_orderkey")).alias("ids"))
    p = p.withColumn("panels", F.transform("ids", lambda x: F.struct(x.alias("id"), F.lit(False).alias("pinned"))))
    c = F.col("chat") % 4
    op = F.struct(F.when(c == 0, "pin").when(c == 1, "remove").when(c == 2, "front").otherwise("add").alias("kind"), F.when(c <= 1, F.element_at("ids", 1)).when(c == 2, F.element_at("ids", -1)).otherwise(F.lit(-1)).alias("id"))
    moved = V.panels_moved(p.withColumn("op", op), F.col("op"))
    return moved.select("chat", F.array_join(F.transform("panels", lambda x: F.concat(x["id"].cast("string"), F.when(x["pinned"], "*").otherwise(""))), ",").alias("panels"))


@register(f"""WITH {MESSAGES_SQL}, c AS (SELECT chat_id, seq, 'S' || (length(text) % 7) AS source FROM msgs WHERE role = 'agent'), f AS (SELECT chat_id, source, min(seq) AS first FROM c GROUP BY ALL), n AS (SELECT *, row_number() OVER (PARTITION BY chat_id ORDER BY first) AS number FROM f)
    SELECT c.chat_id, c.seq, c.source, CAST(n.number AS INTEGER) AS number FROM c JOIN n USING (chat_id, source)""")
def jn22_citation_numbers(spark, sf_dir):
    """JN-22: sources numbered over a chat by first appearance."""
    c = messages(spark, sf_dir).where("role = 'agent'").select("chat_id", "seq", F.concat(F.lit("S"), (F.length("text") % 7).cast("string")).alias("source"))
    first = F.min("seq").over(Window.partitionBy("chat_id", "source"))
    return c.withColumn("first", first).withColumn("number", F.dense_rank().over(Window.partitionBy("chat_id").orderBy("first"))).drop("first")


@register(f"""WITH {DOCUMENTS_SQL}, r AS (SELECT id, project_id, CASE WHEN id % 2 = 0 THEN lang || '*' END AS routed FROM docs) SELECT d.id, coalesce(r.routed, d.lang) AS lang FROM docs d LEFT JOIN r ON d.id = r.id AND r.routed IS NOT NULL""")
def jn17_overlay(spark, sf_dir):
    """JN-17: a routed result stands in for the raw one where there is one."""
    d = documents(spark, sf_dir)
    routed = d.where("id % 2 = 0").select("id", F.concat("lang", F.lit("*")).alias("routed"))
    return d.join(routed, "id", "left").select("id", F.coalesce("routed", "lang").alias("lang"))


@register("SELECT doc_id, v.variant AS variant FROM (SELECT doc_id, unnest(list_filter([{'variant': 'raw', 'ok': true}, {'variant': 'english', 'ok': lang = 'en'}, {'variant': 'routed', 'ok': n_chars > 1000}], lambda x: x.ok)) AS v FROM documents)")
def jn16_variants(spark, sf_dir):
    """JN-16: the variants that apply to each question."""
    options = F.array(F.struct(F.lit("raw").alias("variant"), F.lit(True).alias("ok")), F.struct(F.lit("english").alias("variant"), (F.col("lang") == "en").alias("ok")), F.struct(F.lit("routed").alias("variant"), (F.col("n_chars") > 1000).alias("ok")))
    return table(spark, sf_dir, "documents").select("doc_id", F.explode(F.filter(options, lambda x: x["ok"])).alias("v")).select("doc_id", "v.variant")


@register("""WITH p AS (SELECT o_orderkey, o_custkey, o_orderdate AS lo, o_orderdate + INTERVAL 30 DAY AS hi FROM orders) SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_shipdate BETWEEN lo AND hi AS within FROM lineitem JOIN p ON l_orderkey = o_orderkey""")
def jn12_range_hits(spark, sf_dir):
    """FLT-08, JN-11, JN-12: passages (line items) of a document (order) against its target range, an equi-join with a range test."""
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_orderdate").alias("lo"), (F.col("o_orderdate") + F.expr("INTERVAL 30 DAY")).alias("hi"))
    return table(spark, sf_dir, "lineitem").join(o, "l_orderkey").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.col("l_shipdate").between(F.col("lo"), F.col("hi")).alias("within"))


@register(f"""WITH {SUMS}, a AS (SELECT table_id, segment AS label, list_sort(list(fy)) AS xs FROM s WHERE fy < 1998 GROUP BY ALL), b AS (SELECT table_id, segment AS label, list_sort(list(fy)) AS xs FROM s WHERE fy >= 1998 - table_id % 2 GROUP BY ALL)
    SELECT coalesce(a.table_id, b.table_id) AS table_id, coalesce(a.label, b.label) AS label, CASE WHEN a.xs IS NOT NULL AND b.xs IS NOT NULL AND list_has_any(a.xs, b.xs) THEN false ELSE true END AS merged FROM a FULL JOIN b ON a.table_id = b.table_id AND a.label = b.label""")
def jn24_series_merge(spark, sf_dir):
    """JN-24, JN-23: same-label series of two tables merge if they share no x."""
    s = sums(spark, sf_dir)
    side = lambda c, n: s.where(c).groupBy("table_id", F.col("segment").alias("label")).agg(F.collect_set("fy").alias(n))
    j = side(F.col("fy") < 1998, "a").join(side(F.col("fy") >= 1998 - F.col("table_id") % 2, "b"), ["table_id", "label"], "full")
    return j.select("table_id", "label", (~F.coalesce(F.arrays_overlap("a", "b"), F.lit(False))).alias("merged"))


@register("SELECT doc_id, source, n_chars, CAST(row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) AS INTEGER) AS rank, max((lang = 'en')::INT) OVER w = 1 AND lang <> 'en' AS dropped FROM documents WINDOW w AS (PARTITION BY source)")
def flt13_subject(spark, sf_dir):
    """FLT-13: where a group has rows on the subject, the others go."""
    d = table(spark, sf_dir, "documents").select("doc_id", "source", "n_chars", "lang")
    about = d.groupBy(F.col("source").alias("_of")).agg(F.bool_or(F.col("lang") == "en").alias("_some"))
    ranked = numbered(d, ["source"], [F.desc("n_chars"), F.col("doc_id")], "rank").join(about, F.col("source").eqNullSafe(F.col("_of")))
    return ranked.select("doc_id", "source", "n_chars", "rank", (F.col("_some") & (F.col("lang") != "en")).alias("dropped"))


@register("""SELECT o_orderkey, NOT list_contains(years, y + 1) AND len(years) > 0 AS vetoed FROM (SELECT o_orderkey, year(o_orderdate)::INTEGER AS y, CASE o_orderkey % 3 WHEN 0 THEN []::INTEGER[] WHEN 1 THEN [year(o_orderdate)::INTEGER] ELSE [year(o_orderdate)::INTEGER, year(o_orderdate)::INTEGER + 1] END AS years FROM orders)""")
def flt12_period_veto(spark, sf_dir):
    """FLT-12: a passage that states years, but not the one asked for, is vetoed; one that states none isn't."""
    y, k = F.year("o_orderdate"), F.col("o_orderkey") % 3
    years = F.when(k == 0, F.array().cast("array<int>")).when(k == 1, F.array(y)).otherwise(F.array(y, y + 1))
    return table(spark, sf_dir, "orders").select("o_orderkey", ((F.size(F.array_except(F.array(y + 1), years)) > 0) & (F.size(years) > 0)).alias("vetoed"))


@register("""SELECT event_id, CASE WHEN lvl < -60 THEN 'drop' WHEN lvl < -45 AND (weak OR frag) THEN 'drop' WHEN weak AND frag THEN 'drop' WHEN garbled THEN 'say_again' ELSE 'answer' END AS verdict FROM (SELECT event_id, -90 + value % 90 AS lvl, event_id % 4 = 0 AS weak, event_id % 3 = 0 AS frag, event_id % 11 = 0 AS garbled FROM events)""")
def flt18_addressed(spark, sf_dir):
    """FLT-18: whether an utterance is for the agent."""
    e, level = F.col("event_id"), -90 + F.col("value") % 90
    weak, fragment = e % 4 == 0, e % 3 == 0
    return table(spark, sf_dir, "events").select("event_id", F.when(level < -60, "drop").when((level < -45) & (weak | fragment), "drop").when(weak & fragment, "drop").when(e % 11 == 0, "say_again").otherwise("answer").alias("verdict"))


@register("""SELECT conv_id, turn, len(list_filter(string_split('the|tion;ing;zzz', ';'), lambda n: len(list_filter(string_split(n, '|'), lambda a: contains(regexp_replace(lower(text), '[^\\p{L}\\p{N}]', '', 'g'), a))) > 0)) = 2 AS two_of_three FROM conversations""")
def flt10_needles(spark, sf_dir):
    """FLT-10: needles with alternatives, separators ignored."""
    from ..functions.text import squashed

    h, needles = squashed(F.col("text")), F.split(F.lit("the|tion;ing;zzz"), ";")
    d = table(spark, sf_dir, "conversations").withColumn("h", h)
    hit = F.filter(needles, lambda n: F.exists(F.split(n, r"\|"), lambda a: F.contains(F.col("h"), a)))
    return d.select("conv_id", "turn", (F.size(hit) == 2).alias("two_of_three"))


@register("SELECT source, arg_max(lang, {'n': length(lang || doc_id), 'd': -doc_id}) AS label, count(*) AS sample FROM (SELECT * FROM documents QUALIFY row_number() OVER (PARTITION BY source ORDER BY doc_id) <= 16) GROUP BY 1")
def src10_scroll_sample(spark, sf_dir):
    """SRC-10: a sample of each document's chunks (a feature of the operator) and its longest label."""
    d = top_per(table(spark, sf_dir, "documents"), "source", [F.col("doc_id")], 16, "_r")
    return d.groupBy("source").agg(F.max_by("lang", F.struct(F.length(F.concat("lang", F.col("doc_id").cast("string"))), -F.col("doc_id"))).alias("label"), F.count(F.lit(1)).alias("sample"))


@register("""SELECT event_id, json_extract_string(props, '$.k') IS NOT NULL AS has_key, TRY_CAST(json_extract_string(props, '$.k') AS INTEGER) AS k, '{"k":' || json_extract_string(props, '$.k') || ',"seen":true}' AS merged FROM events""")
def dm07_merge_json(spark, sf_dir):
    """DM-07, SRC-12, SC-75, SC-76: fields read from JSON, one merged in, keys in order."""
    p = F.from_json("props", "k int")
    merged = F.to_json(F.struct(p["k"].alias("k"), F.lit(True).alias("seen")))
    return table(spark, sf_dir, "events").select("event_id", p["k"].isNotNull().alias("has_key"), p["k"].alias("k"), merged.alias("merged"))


@register("SELECT 'duplicate' AS problem, count(*) AS n FROM (SELECT text FROM documents GROUP BY 1 HAVING count(*) > 1) UNION ALL SELECT 'unlabelled', count(*) FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels) UNION ALL SELECT 'label without document', count(*) FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents) UNION ALL SELECT 'short', count(*) FROM documents WHERE n_chars < 20")
def src16_consistency(spark, sf_dir):
    """SRC-15, SRC-16: one report of all violations."""
    d, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    n = lambda df, name: df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("problem"), "n")
    same = d.groupBy(F.sha2(F.col("text").cast("binary"), 256).alias("h")).count().where("count > 1")
    return n(same, "duplicate").unionByName(n(d.join(labels, "doc_id", "left_anti"), "unlabelled")).unionByName(n(labels.join(d, "doc_id", "left_anti"), "label without document")).unionByName(n(d.where("n_chars < 20"), "short"))


@register("SELECT conv_id, turn, hex(encode(role)) AS frame, CAST(turn + 256 * conv_id AS BIGINT) AS number FROM conversations")
def src21_frames(spark, sf_dir):
    """SRC-21: little-endian header of two bytes read back from binary."""
    c = table(spark, sf_dir, "conversations")
    b = F.unhex(F.concat(F.lpad(F.hex(F.col("turn") % 256), 2, "0"), F.lpad(F.hex(F.col("conv_id") % 256), 2, "0"), F.lpad(F.hex(F.floor(F.col("conv_id") / 256)), 2, "0")))
    byte = lambda i: F.conv(F.hex(F.substring(b, i, 1)), 16, 10).cast("long")
    return c.select("conv_id", "turn", F.hex(F.encode("role", "utf-8")).alias("frame"), (byte(1) + 256 * byte(2) + 65536 * byte(3)).alias("number"))


@register("""WITH k AS (SELECT conv_id, turn, list_sort(list_distinct(list_filter(string_split_regex(lower(text), '[^\\p{L}\\p{N}]+'), lambda t: length(t) >= 3))) AS w FROM conversations), p AS (SELECT a.conv_id, a.turn, b.turn AS other, len(list_intersect(a.w, b.w)) / nullif(len(list_distinct(list_concat(a.w, b.w))), 0)::DOUBLE AS j FROM k a JOIN k b ON a.conv_id = b.conv_id AND a.turn < b.turn)
    SELECT conv_id, turn, other, round(j, 6) AS likeness FROM p WHERE j >= 0.02""")
def ag35_alike_points(spark, sf_dir):
    """AG-35: turns of a conversation whose words are alike (Jaccard over words of three letters); a conversation is bounded by its turns."""
    w = F.array_distinct(F.filter(F.split(F.lower("text"), r"[^\p{L}\p{N}]+"), lambda t: F.length(t) >= 3))
    k = table(spark, sf_dir, "conversations").select("conv_id", "turn", w.alias("w"))
    j = k.join(k.select("conv_id", F.col("turn").alias("other"), F.col("w").alias("v")), "conv_id").where("turn < other")
    like = F.try_divide(F.size(F.array_intersect("w", "v")).cast("double"), F.size(F.array_union("w", "v")).cast("double"))
    return j.withColumn("likeness", like).where("likeness >= 0.02").select("conv_id", "turn", "other", F.round("likeness", 6).alias("likeness"))


@register("SELECT n_nationkey, arg_max(segment, {'n': n, 's': segment}) AS best, max(n) AS n FROM (SELECT c_nationkey AS n_nationkey, c_mktsegment AS segment, count(*) AS n FROM customer WHERE c_mktsegment IN ('BUILDING', 'FURNITURE', 'MACHINERY') GROUP BY ALL) GROUP BY 1")
def ag40_allowed_best(spark, sf_dir):
    """AG-40: the best of an allowed set."""
    c = table(spark, sf_dir, "customer").where(F.col("c_mktsegment").isin("BUILDING", "FURNITURE", "MACHINERY")).groupBy(F.col("c_nationkey").alias("n_nationkey"), F.col("c_mktsegment").alias("segment")).agg(F.count(F.lit(1)).alias("n"))
    return c.groupBy("n_nationkey").agg(F.max_by("segment", F.struct("n", "segment")).alias("best"), F.max("n").alias("n"))


@register("SELECT user_id, sum(value * length(event_type)) / nullif(sum(length(event_type)), 0) > 40 AS sure, round(sum(value * length(event_type)) / nullif(sum(length(event_type)), 0)::DOUBLE, 6) AS confidence, max(value) AS worst FROM events GROUP BY 1")
def ag39_confidence(spark, sf_dir):
    """AG-39: a mean weighted by tokens, the worst value, and the rule on them."""
    n = F.length("event_type")
    mean = F.try_divide(F.sum(F.col("value") * n), F.sum(n).cast("double"))
    return table(spark, sf_dir, "events").groupBy("user_id").agg((mean > 40).alias("sure"), F.round(mean, 6).alias("confidence"), F.max("value").alias("worst"))
