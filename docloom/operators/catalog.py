"""The catalog: scopes, joins, counts, pages, sequences and state changes as transforms of frames (F1)."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import stored

#: Evidence that a task may get at once.
NEEDLE_BYTES = 8 << 20
STATES = ["QUEUED", "RUNNING", "SUCCEEDED", "FAILED", "CANCELLED"]


def in_scope(df: DataFrame, project: str, ids: list | None = None, project_col: str = "project_id", id_col: str = "id") -> DataFrame:
    """FLT-01: rows of a project, within a list of ids; None means all of them, an empty list none."""
    kept = df.where(F.col(project_col) == project)
    return kept if ids is None else kept.where(F.col(id_col).isin(list(ids))) if ids else kept.where(F.lit(False))


def ready(df: DataFrame) -> DataFrame:
    """FLT-02: id and filename of the documents that are ready."""
    return df.where("status = 'READY'").select("id", "project_id", "filename")


def visible(df: DataFrame, archived: bool = False, column: str = "archived_at") -> DataFrame:
    """FLT-03."""
    return df if archived else df.where(F.col(column).isNull())


def point(df: DataFrame, column: str, value) -> DataFrame:
    """FLT-04: one row or an error."""
    found = df.where(F.col(column) == value)
    if found.isEmpty():
        raise LookupError(f"no {column} {value}")
    return found


def patched(old: Column, given: Column, new: Column) -> Column:
    """FLT-05: an absent field stays, a given one replaces, also by null."""
    return F.when(given, new).otherwise(old)


def unknown_scope(scopes: DataFrame, documents: DataFrame, owner: str = "chat_id") -> DataFrame:
    """FLT-06: scope ids (deduplicated) that aren't documents of the owner's project."""
    wanted = scopes.select(owner, "project_id", F.explode(F.array_distinct("scope")).alias("id"))
    return wanted.join(documents.select("id", "project_id"), ["id", "project_id"], "left_anti")


def counted(parents: DataFrame, key: str, children: dict[str, DataFrame]) -> DataFrame:
    """JN-04: one count of each kind of child per parent, zero where there are none; each child is aggregated before it is joined."""
    for name, child in children.items():
        parents = parents.join(child.groupBy(key).agg(F.count(F.lit(1)).alias(name)), key, "left")
    return parents.select("*").fillna(0, list(children))


def without(df: DataFrame, others: DataFrame, on: list[str]) -> DataFrame:
    """JN-06, JN-07: rows that have no counterpart."""
    return df.join(others.select(*on).distinct(), on, "left_anti")


def missing_counts(expected: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """JN-26: keys whose done count differs from the expected one."""
    e, d = expected.groupBy(key).agg(F.count(F.lit(1)).alias("expected")), done.groupBy(key).agg(F.count(F.lit(1)).alias("done"))
    return e.join(d, key, "left").select(key, "expected", F.coalesce("done", F.lit(0)).alias("done")).where("done <> expected")


def fingerprint(keys: Column, *head: str) -> Column:
    """AG-04: SHA-256 of settings and sorted keys."""
    return F.sha2(F.concat_ws("|", *[F.lit(h) for h in head], F.array_join(F.array_sort(keys), "|")).cast("binary"), 256)


def stale(parents: DataFrame, children: DataFrame, key: str, version: str, current) -> DataFrame:
    """AG-06: parents without children, or with one of another version."""
    c = children.groupBy(key).agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col(version) != current).alias("other"))
    joined = parents.join(c, key, "left").select(parents["*"], F.coalesce("total", F.lit(0)).alias("total"), F.coalesce("other", F.lit(0)).alias("other"))
    return joined.where("total = 0 OR other > 0")


def page(df: DataFrame, order: str, limit: int, after=None, before=None, key: str | None = None) -> DataFrame:
    """SO-05: a keyset page after or before a cursor, ascending; has_more tells whether a further row exists. With a key, a page of every key at once."""
    if after is not None:
        df = df.where(F.col(order) > after)
    if before is not None:
        df = df.where(F.col(order) < before)
    direction = F.col(order).desc() if before is not None else F.col(order).asc()
    w = Window.partitionBy(key) if key else Window.partitionBy(F.lit(0))
    ranked = df.withColumn("_r", F.row_number().over(w.orderBy(direction))).where(F.col("_r") <= limit + 1)
    return ranked.withColumn("has_more", F.max("_r").over(w) > limit).where(F.col("_r") <= limit).drop("_r")


def first_duplicate(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    """SO-04: the earliest row of each key that has more than one."""
    return df.groupBy(*keys).agg(F.min(order).alias("first"), F.count(F.lit(1)).alias("copies")).where("copies > 1")


def appended(log: DataFrame, new: DataFrame, key: str, order: list[Column]) -> DataFrame:
    """DM-01: new rows with sequence numbers that go on from the log's, without gaps."""
    last = log.groupBy(key).agg(F.max("seq").alias("_last"))
    numbered = new.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy(*order)))
    return numbered.join(last, key, "left").withColumn("seq", (F.coalesce("_last", F.lit(0)) + F.col("_n")).cast("long")).drop("_last", "_n")


def upserted(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """DM-05: rows of new, and those of old whose key new doesn't have."""
    return old.join(new.select(*keys).distinct(), keys, "left_anti").unionByName(new)


def latest(events: DataFrame, key: str, order: str, state: str) -> DataFrame:
    """DM-03, ST-17: the state of each key by its last event."""
    return events.groupBy(key).agg(F.max_by(state, order).alias(state), F.max(order).alias(order), F.count(F.lit(1)).alias("events"))


def recovered(jobs: DataFrame, key: str, state: str = "state") -> DataFrame:
    """DM-04: running jobs are cancelled and queued again."""
    running = F.col(state) == "RUNNING"
    return jobs.withColumn("_s", F.when(running, F.array(F.lit("CANCELLED"), F.lit("QUEUED"))).otherwise(F.array(state))).withColumn("attempt", F.lit(0)).select(key, F.posexplode("_s").alias("attempt", state))


def replaced_if_different(old: DataFrame, new: DataFrame, key: str, value: str) -> DataFrame:
    """SE-08: a key whose set of values hasn't changed keeps its old rows, others take the new ones."""
    h = lambda df: df.groupBy(key).agg(F.sha2(F.array_join(F.array_sort(F.collect_list(F.col(value).cast("string"))), "|").cast("binary"), 256).alias("_h"))
    same = h(old).join(h(new), [key, "_h"], "left_semi").select(key)
    return old.join(same, key, "left_semi").withColumn("kept", F.lit(True)).unionByName(new.join(same, key, "left_anti").withColumn("kept", F.lit(False)))


def replaced_if_present(stored: DataFrame, new: DataFrame, documents: DataFrame, tables: DataFrame) -> tuple[DataFrame, DataFrame]:
    """DM-08: stored after new datasets replaced those of their documents, and which documents were done.

    stored, new: document_id, version, table_id and more; documents: document_id, version; tables: document_id, version, table_id. A document's new datasets
    count as one change: all are taken, in place of everything stored for it, if the document has their version and every table they name still has
    a row of that version; else none is, and what was stored stays. new must hold one version of a document.
    """
    keys = ["document_id", "version"]
    asked = new.select(*keys, "table_id").join(documents.select(*keys, F.lit(True).alias("_doc")).distinct(), keys, "left").join(tables.select(*keys, "table_id", F.lit(True).alias("_table")).distinct(), [*keys, "table_id"], "left")
    done = asked.groupBy(*keys).agg((F.count(F.lit(1)) == F.count(F.when(F.col("_doc") & F.col("_table"), 1))).alias("done"))
    taken = done.where("done").select(*keys)
    return stored.join(taken.select("document_id"), "document_id", "left_anti").select(*stored.columns).unionByName(new.join(taken, keys, "left_semi").select(*stored.columns)), done


def contained(evidence: DataFrame, docs: DataFrame, window: int = 5, most: int = NEEDLE_BYTES) -> DataFrame:
    """JN-10, FLT-09: (item_id, doc_id, lang) where the document's text holds the evidence, letter case aside.

    Evidence of up to `most` bytes in all, which is counted first, goes to the tasks as one automaton that finds every piece in one pass over a
    text (pyahocorasick must be installed there). More of it meets the texts by windows of words, see `contained_by_windows`.
    """
    needles = evidence.select("item_id", F.lower("text").alias("needle")).where("needle IS NOT NULL")
    size = needles.agg(F.sum(F.octet_length("needle")).alias("n")).first().n or 0
    if size > most:
        return contained_by_windows(evidence, docs, window)
    held: dict[str, list[int]] = {}
    for r in needles.collect():
        held.setdefault(r.needle, []).append(r.item_id)
    shared = docs.sparkSession.sparkContext.broadcast(held)

    made: list = []  # the automaton of a task, once its first batch has come

    def find(texts: pa.Array) -> pa.Array:
        if not made:
            import ahocorasick

            made.append(ahocorasick.Automaton())
            for needle, ids in shared.value.items():
                if needle:
                    made[0].add_word(needle, ids)
            if len(made[0]):
                made[0].make_automaton()
        automaton, always, out = made[0], shared.value.get("", []), []
        for text in texts.to_pylist():
            ids = set(always) if text is not None else set()
            if text and len(automaton):
                ids.update(i for _, own in automaton.iter(text) for i in own)
            out.append(sorted(ids))
        return pa.array(out, pa.list_(pa.int64()))

    found = F.arrow_udf(find, "array<long>")(F.lower("text"))
    return docs.select(F.explode(found).alias("item_id"), "doc_id", "lang")


def contained_by_windows(evidence: DataFrame, docs: DataFrame, window: int = 5) -> DataFrame:
    """The same for evidence of any size.

    The evidence's words 2 to 6 are whole words in any text that holds it, so hashes of such windows meet by equality, without the texts; those
    are joined to the few pairs that met, and the full test follows. Evidence of fewer than 7 words, which has no such window, goes by its longest
    inner word, or, with two words or fewer, by the full test of the stated set against every text.
    """
    words = lambda c: F.filter(F.split(F.lower(c), r"[\x20\x09-\x0D]+"), lambda w: w != "")
    hashed = lambda w, i, n: F.xxhash64(F.array_join(F.slice(w, i, n), " "))
    inner = F.slice("w", 2, F.greatest(F.size("w") - 2, F.lit(0)))
    longest = F.array_max(F.transform(inner, lambda w: F.struct(F.length(w).alias("n"), w.alias("w"))))["w"]
    e = evidence.select("item_id", F.lower("text").alias("needle"), words(F.col("text")).alias("w")).where("needle IS NOT NULL")
    e = e.withColumn("at", F.when(F.size("w") >= window + 2, hashed(F.col("w"), 2, window)).when(F.size("w") > 2, F.xxhash64(longest)))
    d = docs.select("doc_id", "lang", F.lower("text").alias("hay"), F.xxhash64("text").alias("th")).where("hay IS NOT NULL")
    w = docs.select(F.xxhash64("text").alias("th"), words(F.col("text")).alias("w"))
    windows = F.when(F.size("w") >= window, F.transform(F.sequence(F.lit(1), F.greatest(F.size("w") - window + 1, F.lit(1))), lambda i: hashed(F.col("w"), i, window))).otherwise(F.array().cast("array<long>"))
    keys = F.array_distinct(F.concat(windows, F.transform("w", lambda x: F.xxhash64(x))))
    met = w.select("th", F.explode(keys).alias("at")).join(e.where("at IS NOT NULL").select("item_id", "at"), "at").select("item_id", "th").distinct()
    long = d.join(met, "th").join(e.select("item_id", "needle"), "item_id").where(F.contains("hay", "needle"))
    short = d.join(e.where("at IS NULL").select("item_id", "needle"), F.contains("hay", "needle"))
    return long.select("item_id", "doc_id", "lang").unionByName(short.select("item_id", "doc_id", "lang"))


def orphans(children: DataFrame, parents: DataFrame, key: str) -> DataFrame:
    """JN-28: children whose parent is gone."""
    return children.join(parents.select(key), key, "left_anti")


def scope_without(scope: Column, gone: Column) -> Column:
    """JN-28: a scope array less a deleted id; null once it is empty."""
    left = F.filter(scope, lambda x: x != gone)
    return F.when(F.size(left) > 0, left)


def fact_coverage(facts: DataFrame, chunks: DataFrame) -> DataFrame:
    """JN-11: fact, chunks (that hold all of its evidence), stating (of these, on a page that states it), for every fact.

    facts: fact, evidence (array<string>), pages (array<int>: null or empty, any page will do). chunks: chunk (long), text, page_start, page_end (null: the same page; no
    start: any page). All pieces of evidence are found by one containment join, a piece that several facts share once; facts then count the chunks in which all
    of theirs met. A fact without evidence, or with a null or empty piece, is held nowhere; letter case doesn't matter; pieces that repeat count once.
    """
    pieces = facts.select("fact", "pages", F.array_distinct(F.transform("evidence", lambda e: F.lower(e))).alias("all")).where(F.forall("all", lambda e: e.isNotNull() & (e != "")))
    pieces = pieces.select("fact", "pages", F.size("all").alias("n"), F.explode("all").alias("piece"))
    known = stored(pieces.select("piece").distinct().withColumn("item_id", F.monotonically_increasing_id()), "evidence")
    met = contained(known.select("item_id", F.col("piece").alias("text")), chunks.select(F.col("chunk").alias("doc_id"), F.lit(None).cast("string").alias("lang"), "text"))
    hits = pieces.join(known, "piece").join(met.select("item_id", F.col("doc_id").alias("chunk")), "item_id")
    held = hits.groupBy("fact", "chunk").agg(F.count(F.lit(1)).alias("found"), F.first("n").alias("n"), F.first("pages").alias("pages")).where("found = n").join(chunks.select("chunk", "page_start", "page_end"), "chunk")
    inside = F.exists("pages", lambda p: p.between(F.col("page_start"), F.coalesce("page_end", "page_start")))
    right = F.coalesce(F.size("pages"), F.lit(0)).isin(0, -1) | F.col("page_start").isNull() | F.coalesce(inside, F.lit(False))
    counted = held.groupBy("fact").agg(F.count(F.lit(1)).alias("chunks"), F.count_if(right).alias("stating"))
    return facts.select("fact").join(counted, "fact", "left").na.fill(0, ["chunks", "stating"])
