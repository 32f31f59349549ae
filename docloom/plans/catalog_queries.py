"""Queries of the catalog operators over frames derived from documents, labels, conversations and the star schema."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import catalog as C
from ..operators.retrieval import top_per
from ..sources.frames import DOCUMENTS_SQL, JOBS_SQL, MESSAGES_SQL, documents, jobs, messages
from ..operators.shared import numbered
from .registry import registry, table

QUERIES, ORACLES, register = registry()


@register(f"WITH {DOCUMENTS_SQL} SELECT * FROM docs WHERE project_id = 'src3'")
def flt01_scope(spark, sf_dir):
    """FLT-01."""
    return C.in_scope(documents(spark, sf_dir), "src3")


@register(f"WITH {DOCUMENTS_SQL} SELECT id, project_id, filename FROM docs WHERE status = 'READY'")
def flt02_ready(spark, sf_dir):
    """FLT-02."""
    return C.ready(documents(spark, sf_dir))


@register("SELECT o_orderkey, o_orderstatus, CASE WHEN o_orderkey % 3 = 0 THEN o_orderdate END AS archived_at FROM orders WHERE o_orderkey % 3 <> 0")
def flt03_hide_archived(spark, sf_dir):
    """FLT-03."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", F.when(F.col("o_orderkey") % 3 == 0, F.col("o_orderdate")).alias("archived_at"))
    return C.visible(o)


@register(f"WITH {DOCUMENTS_SQL} SELECT * FROM docs WHERE id = (SELECT max(id) FROM docs)")
def flt04_point(spark, sf_dir):
    """FLT-04."""
    d = documents(spark, sf_dir)
    return C.point(d, "id", d.agg(F.max("id")).first()[0])


@register("SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN CASE WHEN c_custkey % 4 = 0 THEN NULL ELSE 'pinned' END ELSE c_mktsegment END AS segment FROM customer")
def flt05_partial_update(spark, sf_dir):
    """FLT-05: even keys give the field, every fourth as null."""
    c, k = table(spark, sf_dir, "customer"), F.col("c_custkey")
    return c.select("c_custkey", C.patched(F.col("c_mktsegment"), k % 2 == 0, F.when(k % 4 != 0, F.lit("pinned"))).alias("segment"))


@register(f"""WITH {DOCUMENTS_SQL}, s AS (SELECT DISTINCT conv_id AS chat_id, 'src' || (conv_id % 20) AS project_id, unnest([conv_id, conv_id + 1, conv_id + 20]) AS id FROM conversations)
    SELECT chat_id, project_id, id FROM s WHERE NOT EXISTS (SELECT 1 FROM docs WHERE docs.id = s.id AND docs.project_id = s.project_id)""")
def flt06_unknown_scope(spark, sf_dir):
    """FLT-06."""
    c = F.col("conv_id")
    s = table(spark, sf_dir, "conversations").select(c.alias("chat_id"), F.concat(F.lit("src"), (c % 20).cast("string")).alias("project_id"), F.array(c, c + 1, c + 20, c).alias("scope")).dropDuplicates(["chat_id"])
    return C.unknown_scope(s, documents(spark, sf_dir)).select("chat_id", "project_id", "id")


@register("SELECT n_name, r_name, c_custkey, c_name FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE c_acctbal > 0")
def jn01_pinned_join(spark, sf_dir):
    """JN-01: two small sides, which the planner broadcasts by their size."""
    c, n, r = (table(spark, sf_dir, t) for t in ("customer", "nation", "region"))
    return c.where("c_acctbal > 0").join(n, c.c_nationkey == n.n_nationkey).join(r, n.n_regionkey == r.r_regionkey).select("n_name", "r_name", "c_custkey", "c_name")


@register(f"WITH {DOCUMENTS_SQL}, ds AS (SELECT doc_id, CAST(1 + item % 3 AS INTEGER) AS version, item FROM (SELECT doc_id, unnest(range(3)) AS item FROM documents)) SELECT docs.id, docs.version, item FROM docs JOIN ds ON docs.id = ds.doc_id AND docs.version = ds.version")
def jn02_versioned_join(spark, sf_dir):
    """JN-02: children meet only the version that their document is at."""
    d = documents(spark, sf_dir).select("id", "version")
    ds = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.explode(F.array(*[F.lit(i).cast("long") for i in range(3)])).alias("item")).withColumn("version", (1 + F.col("item") % 3).cast("int"))
    return d.join(ds, ["id", "version"])


@register(f"""WITH {MESSAGES_SQL}, s AS (SELECT chat_id, max(seq) + chat_id % 2 AS covers FROM msgs GROUP BY chat_id) SELECT s.chat_id, covers, coalesce(m.seq, 0) AS covers_seq, m.role FROM s LEFT JOIN msgs m ON m.chat_id = s.chat_id AND m.seq = s.covers""")
def jn03_summary_left_join(spark, sf_dir):
    """JN-03: the covering message's place, 0 where it is gone."""
    m = messages(spark, sf_dir)
    s = m.groupBy("chat_id").agg((F.max("seq") + F.first("chat_id") % 2).alias("covers"))
    return s.join(m.withColumnRenamed("seq", "covers"), ["chat_id", "covers"], "left").select("chat_id", "covers", F.when(F.col("text").isNotNull(), F.col("covers")).otherwise(F.lit(0)).cast("long").alias("covers_seq"), "role")


@register(f"""WITH {DOCUMENTS_SQL} SELECT p.project_id, coalesce(d.n, 0) AS documents, coalesce(r.n, 0) AS ready FROM (SELECT DISTINCT project_id FROM docs UNION SELECT 'empty') p
    LEFT JOIN (SELECT project_id, count(*) AS n FROM docs GROUP BY 1) d USING (project_id) LEFT JOIN (SELECT project_id, count(*) AS n FROM docs WHERE status = 'READY' AND lang <> 'en' GROUP BY 1) r USING (project_id)""")
def jn04_project_counts(spark, sf_dir):
    """JN-04."""
    d = documents(spark, sf_dir)
    projects = d.select("project_id").distinct().unionByName(spark.range(1).select(F.lit("empty").alias("project_id")))
    return C.counted(projects, "project_id", {"documents": d, "ready": d.where("status = 'READY' AND lang <> 'en'")})


@register(f"WITH {DOCUMENTS_SQL}, {JOBS_SQL} SELECT id, filename FROM docs WHERE status = 'READY' AND id IN (SELECT document_id FROM jobs)")
def jn05_known_only(spark, sf_dir):
    """JN-05."""
    return C.ready(documents(spark, sf_dir)).join(jobs(spark, sf_dir), F.col("id") == F.col("document_id"), "left_semi").select("id", "filename")


@register(f"WITH {DOCUMENTS_SQL}, {JOBS_SQL} SELECT id FROM docs WHERE status = 'READY' AND id NOT IN (SELECT document_id FROM jobs WHERE state IN ('QUEUED', 'RUNNING'))")
def jn06_ready_without_job(spark, sf_dir):
    """JN-06."""
    active = jobs(spark, sf_dir).where(F.col("state").isin("QUEUED", "RUNNING")).select(F.col("document_id").alias("id"))
    return C.without(C.ready(documents(spark, sf_dir)), active, ["id"]).select("id")


@register("SELECT l_orderkey, l_linenumber FROM lineitem a WHERE NOT EXISTS (SELECT 1 FROM lineitem b WHERE b.l_quantity >= 10 AND a.l_orderkey = b.l_orderkey AND a.l_linenumber = b.l_linenumber)")
def jn07_delete_except(spark, sf_dir):
    """JN-07: the parts that a new version doesn't have."""
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity")
    return C.without(li, li.where("l_quantity >= 10"), ["l_orderkey", "l_linenumber"]).select("l_orderkey", "l_linenumber")


@register("""SELECT a.event_id, b.event_id AS other_id, a.user_id FROM events a JOIN events b ON a.user_id = b.user_id AND a.event_id < b.event_id
    AND a.ts <= b.ts + INTERVAL 90 SECOND AND b.ts <= a.ts + INTERVAL 90 SECOND""")
def jn13_interval_overlap(spark, sf_dir):
    """JN-13: events of a user as windows of 90 seconds; overlaps meet by user and time bucket, never across all pairs."""
    from ..operators.windows import overlapping

    return overlapping(table(spark, sf_dir, "events"), "user_id", "event_id", "ts", 90)


@register(f"WITH {DOCUMENTS_SQL}, {JOBS_SQL}, e AS (SELECT project_id, count(*) AS expected FROM docs GROUP BY 1), d AS (SELECT project_id, count(*) AS done FROM docs JOIN jobs ON id = document_id GROUP BY 1) SELECT project_id, expected, coalesce(done, 0) AS done FROM e LEFT JOIN d USING (project_id) WHERE coalesce(done, 0) <> expected")
def jn26_missing_counts(spark, sf_dir):
    """JN-26."""
    d = documents(spark, sf_dir)
    return C.missing_counts(d, d.join(jobs(spark, sf_dir), F.col("id") == F.col("document_id"), "left_semi"), "project_id")


@register(f"WITH {DOCUMENTS_SQL}, {JOBS_SQL} SELECT document_id, state FROM jobs WHERE document_id NOT IN (SELECT id FROM docs WHERE status = 'READY')")
def jn28_orphan_sweep(spark, sf_dir):
    """JN-28."""
    parents = C.ready(documents(spark, sf_dir)).select(F.col("id").alias("document_id"))
    return C.orphans(jobs(spark, sf_dir), parents, "document_id")


@register("SELECT conv_id AS chat_id, CASE WHEN conv_id % 2 = 1 THEN [conv_id + 1] END AS scope FROM (SELECT DISTINCT conv_id FROM conversations)")
def jn28_scope_cleanup(spark, sf_dir):
    """JN-28: scopes less the deleted document, null once empty."""
    c = F.col("conv_id")
    s = table(spark, sf_dir, "conversations").select(c).distinct().select(c.alias("chat_id"), F.when(c % 2 == 1, F.array(c, c + 1)).otherwise(F.array(c)).alias("scope"), c.alias("gone"))
    return s.select("chat_id", C.scope_without(F.col("scope"), F.col("gone")).alias("scope"))


@register(f"WITH {DOCUMENTS_SQL} SELECT project_id, status, count(*) AS n FROM docs GROUP BY ALL")
def ag01_status_counts(spark, sf_dir):
    """AG-01, AG-05."""
    return documents(spark, sf_dir).groupBy("project_id", "status").agg(F.count(F.lit(1)).alias("n"))


@register(f"WITH {DOCUMENTS_SQL} SELECT DISTINCT project_id FROM docs WHERE status = 'READY'")
def ag02_ready_projects(spark, sf_dir):
    """AG-02."""
    return C.ready(documents(spark, sf_dir)).select("project_id").distinct()


@register(f"WITH {DOCUMENTS_SQL} SELECT project_id, sha256('v2|20|en|' || string_agg(k, '|' ORDER BY k)) AS print, count(*) AS n FROM (SELECT project_id, id || ':v' || version AS k FROM docs) GROUP BY 1")
def ag04_fingerprint(spark, sf_dir):
    """AG-03, AG-04."""
    k = F.concat(F.col("id").cast("string"), F.lit(":v"), F.col("version").cast("string"))
    return documents(spark, sf_dir).groupBy("project_id").agg(C.fingerprint(F.collect_list(k), "v2", "20", "en").alias("print"), F.count(F.lit(1)).alias("n"))


@register(f"""WITH {DOCUMENTS_SQL}, ch AS (SELECT doc_id AS id, CAST(1 + (doc_id + i) % 2 AS INTEGER) AS version FROM (SELECT doc_id, unnest(range(doc_id % 3)) AS i FROM documents)),
    g AS (SELECT id, count(*) AS total, count(*) FILTER (WHERE version <> 1) AS other FROM ch GROUP BY 1)
    SELECT docs.id, coalesce(total, 0) AS total, coalesce(other, 0) AS other FROM docs LEFT JOIN g USING (id) WHERE coalesce(total, 0) = 0 OR coalesce(other, 0) > 0""")
def ag06_stale_index(spark, sf_dir):
    """AG-06."""
    d = documents(spark, sf_dir).select("id")
    i = F.explode(F.when(F.col("id") % 3 > 0, F.sequence(F.lit(0), (F.col("id") % 3 - 1).cast("int")))).alias("i")
    ch = d.select("id", i).select("id", (1 + (F.col("id") + F.col("i")) % 2).cast("int").alias("version"))
    return C.stale(d, ch, "id", "version", 1)


@register(f"WITH {DOCUMENTS_SQL} SELECT project_id, sha256, min(id) AS first, count(*) AS copies FROM docs GROUP BY ALL HAVING count(*) > 1")
def so04_first_duplicate(spark, sf_dir):
    """SO-04, SRC-01's content hash."""
    return C.first_duplicate(documents(spark, sf_dir), ["project_id", "sha256"], "id")


@register(f"WITH {MESSAGES_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY chat_id ORDER BY seq) AS r, count(*) OVER (PARTITION BY chat_id) AS n FROM msgs WHERE seq > 2) SELECT chat_id, seq, role, text, n > 4 AS has_more FROM r WHERE r <= 4")
def so05_page_forward(spark, sf_dir):
    """SO-05: the page after the second message, of every chat."""
    return C.page(messages(spark, sf_dir), "seq", 4, after=2, key="chat_id")


@register(f"WITH {MESSAGES_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY chat_id ORDER BY seq DESC) AS r, count(*) OVER (PARTITION BY chat_id) AS n FROM msgs WHERE seq < 6) SELECT chat_id, seq, role, text, n > 3 AS has_more FROM r WHERE r <= 3")
def so05_page_back(spark, sf_dir):
    """SO-05: the page before the sixth message, of every chat."""
    return C.page(messages(spark, sf_dir), "seq", 3, before=6, key="chat_id")


@register(f"WITH {MESSAGES_SQL} SELECT chat_id, string_agg('**' || role || '** ' || text, chr(10) || chr(10) ORDER BY seq) AS transcript, count(*) AS n FROM msgs WHERE role <> 'event' GROUP BY 1")
def src18_transcript(spark, sf_dir):
    """SRC-18, SO-06: a chat is the unit of the result, so its messages meet in one row."""
    m = messages(spark, sf_dir).where("role <> 'event'").groupBy("chat_id").agg(F.array_sort(F.collect_list(F.struct("seq", "role", "text"))).alias("m"))
    return m.select("chat_id", F.array_join(F.transform("m", lambda x: F.concat(F.lit("**"), x["role"], F.lit("** "), x["text"])), "\n\n").alias("transcript"), F.size("m").cast("long").alias("n"))


@register(f"WITH {MESSAGES_SQL}, l AS (SELECT chat_id, max(seq) AS last FROM msgs GROUP BY 1) SELECT m.chat_id, l.last + row_number() OVER (PARTITION BY m.chat_id ORDER BY m.seq) AS seq, m.role FROM msgs m JOIN l USING (chat_id) WHERE m.role = 'user'")
def dm01_append_seq(spark, sf_dir):
    """DM-01: a chat's user messages sent again get the next numbers."""
    m = messages(spark, sf_dir)
    again = m.where("role = 'user'").select("chat_id", "role", F.col("seq").alias("old"))
    return C.appended(m, again, "chat_id", [F.col("old")]).select("chat_id", "seq", "role")


@register("SELECT c_custkey, c_mktsegment, false AS fresh FROM customer WHERE c_acctbal >= 5000 UNION ALL SELECT c_custkey, upper(c_name), true FROM customer WHERE c_acctbal < 5000")
def dm05_upsert(spark, sf_dir):
    """DM-05."""
    c = table(spark, sf_dir, "customer")
    new = c.where("c_acctbal < 5000").select("c_custkey", F.upper("c_name").alias("c_mktsegment"), F.lit(True).alias("fresh"))
    return C.upserted(c.select("c_custkey", "c_mktsegment", F.lit(False).alias("fresh")), new, ["c_custkey"])


@register("SELECT user_id, arg_max(event_type, {'t': ts, 'e': event_id}) AS state, max(event_id) AS last_event, count(*) AS events FROM (SELECT *, event_id AS e FROM events) GROUP BY 1".replace("max(event_id) AS last_event", "arg_max(event_id, {'t': ts, 'e': event_id}) AS last_event"))
def dm03_latest_state(spark, sf_dir):
    """DM-03, ST-17."""
    e = table(spark, sf_dir, "events").select("user_id", F.col("event_type").alias("state"), F.struct("ts", "event_id").alias("at"))
    return C.latest(e, "user_id", "at", "state").select("user_id", "state", F.col("at.event_id").alias("last_event"), "events")


@register(f"WITH {JOBS_SQL}, r AS (SELECT document_id, unnest(CASE WHEN state = 'RUNNING' THEN [{{'attempt': 0, 'state': 'CANCELLED'}}, {{'attempt': 1, 'state': 'QUEUED'}}] ELSE [{{'attempt': 0, 'state': state}}] END) AS s FROM jobs) SELECT document_id, s.attempt AS attempt, s.state AS state FROM r")
def dm04_recovery(spark, sf_dir):
    """DM-04."""
    return C.recovered(jobs(spark, sf_dir), "document_id")


@register("""WITH o AS (SELECT l_orderkey AS k, l_partkey AS v FROM lineitem), n AS (SELECT l_orderkey AS k, CASE WHEN l_orderkey % 5 = 0 THEN l_suppkey ELSE l_partkey END AS v FROM lineitem),
    h AS (SELECT k, string_agg(v::VARCHAR, '|' ORDER BY v::VARCHAR) AS a FROM o GROUP BY 1), g AS (SELECT k, string_agg(v::VARCHAR, '|' ORDER BY v::VARCHAR) AS a FROM n GROUP BY 1), s AS (SELECT k FROM h JOIN g USING (k, a))
    SELECT k, v, true AS kept FROM o WHERE k IN (SELECT k FROM s) UNION ALL SELECT k, v, false FROM n WHERE k NOT IN (SELECT k FROM s)""")
def se08_replace_if_different(spark, sf_dir):
    """SE-08."""
    li, k = table(spark, sf_dir, "lineitem"), F.col("l_orderkey")
    old = li.select(k.alias("k"), F.col("l_partkey").alias("v"))
    return C.replaced_if_different(old, li.select(k.alias("k"), F.when(k % 5 == 0, F.col("l_suppkey")).otherwise(F.col("l_partkey")).alias("v")), "k", "v")


@register(f"""WITH {MESSAGES_SQL}, c AS (SELECT chat_id, max(seq) // 2 AS covers FROM msgs GROUP BY 1)
    SELECT chat_id, count(*) FILTER (WHERE role = 'user') AS exchanges, CAST(sum(ceil(length(text) / 3.5)) AS BIGINT) AS tokens, count(*) FILTER (WHERE role = 'user') >= 2 OR sum(ceil(length(text) / 3.5)) >= 400 AS due
    FROM msgs JOIN c USING (chat_id) WHERE seq > covers GROUP BY 1""")
def dm12_memory_due(spark, sf_dir):
    """DM-12: what has come since the covered message, by exchanges and tokens."""
    m = messages(spark, sf_dir)
    c = m.groupBy("chat_id").agg(F.floor(F.max("seq") / 2).alias("covers"))
    t = m.join(c, "chat_id").where("seq > covers").groupBy("chat_id").agg(F.count_if(F.col("role") == "user").alias("exchanges"), F.sum(F.ceil(F.length("text") / 3.5)).cast("long").alias("tokens"))
    return t.withColumn("due", (F.col("exchanges") >= 2) | (F.col("tokens") >= 400))


@register(f"WITH {DOCUMENTS_SQL} SELECT id, project_id, CAST(row_number() OVER (PARTITION BY project_id ORDER BY (id % 5 = 0) DESC, n_chars DESC, id) AS INTEGER) AS place FROM docs")
def so01_pinned_first(spark, sf_dir):
    """SO-01, SO-02, SO-03, SO-15: pinned first, then activity, then id; the place in each project."""
    d = documents(spark, sf_dir).select("id", "project_id", "n_chars")
    return numbered(d, ["project_id"], [(F.col("id") % 5 == 0).desc(), F.desc("n_chars"), F.col("id")], "place").drop("n_chars")


@register(f"WITH {JOBS_SQL} SELECT document_id, state, CAST(row_number() OVER (PARTITION BY state ORDER BY document_id) AS INTEGER) AS place FROM jobs WHERE state IN ('QUEUED', 'RUNNING') QUALIFY place <= 5")
def so16_job_queue(spark, sf_dir):
    """SO-16: the next five jobs of each state."""
    return top_per(jobs(spark, sf_dir).where(F.col("state").isin("QUEUED", "RUNNING")), "state", [F.col("document_id")], 5, "place")


@register("SELECT CASE WHEN position('.' IN f) > 0 THEN regexp_extract(f, '\\.([a-z0-9]+)$', 1) END AS extension, count(*) AS n, count(DISTINCT h) AS contents, max(size) AS largest FROM (SELECT 'file ' || page_id || CASE WHEN page_id % 4 = 0 THEN '.HTML' ELSE '.htm' END AS f0, lower('file ' || page_id || CASE WHEN page_id % 4 = 0 THEN '.HTML' ELSE '.htm' END) AS f, sha256(html) AS h, octet_length(encode(html)) AS size FROM pages) GROUP BY 1")
def src01_admission(spark, sf_dir):
    """SRC-01: extension, size and content hash of uploads."""
    p = table(spark, sf_dir, "pages")
    name = F.lower(F.concat(F.lit("file "), F.col("page_id").cast("string"), F.when(F.col("page_id") % 4 == 0, ".HTML").otherwise(".htm")))
    u = p.select(F.regexp_extract(name, r"\.([a-z0-9]+)$", 1).alias("extension"), F.sha2(F.col("html").cast("binary"), 256).alias("h"), F.octet_length("html").cast("long").alias("size"))
    return u.groupBy("extension").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("h").alias("contents"), F.max("size").alias("largest"))


@register(f"""WITH {MESSAGES_SQL}, u AS (SELECT *, last_value(CASE WHEN role = 'user' THEN text END IGNORE NULLS) OVER (PARTITION BY chat_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS asked FROM msgs)
    SELECT chat_id, seq, asked FROM u WHERE role = 'agent' AND length(text) % 5 = 0 AND asked IS NOT NULL QUALIFY row_number() OVER (PARTITION BY chat_id, lower(asked) ORDER BY seq) = 1""")
def ag37_unanswered(spark, sf_dir):
    """AG-37: questions before agent turns that abstained (here: by length), each once."""
    before = F.last(F.when(F.col("role") == "user", F.col("text")), ignorenulls=True).over(Window.partitionBy("chat_id").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1))
    u = messages(spark, sf_dir).withColumn("asked", before).where("role = 'agent' AND length(text) % 5 = 0 AND asked IS NOT NULL").withColumn("_low", F.lower("asked"))
    return top_per(u, ["chat_id", "_low"], [F.col("seq")], 1, "_r").select("chat_id", "seq", "asked")
