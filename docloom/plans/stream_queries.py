"""Queries of the stream operators as batches over events and conversations; tests run the same steps on streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators.windows import folded
from ..streaming import steps as S
from ..streaming.stateful import barge_in, batches, sessions
from .registry import registry, table

QUERIES, ORACLES, register = registry()


@register("""WITH g AS (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM events), s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts RANGE UNBOUNDED PRECEDING) AS s FROM g)
    SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 30 MINUTE AS "end", count(*) AS n, round(sum(value), 4) AS total FROM s GROUP BY user_id, s""")
def st02_sessions(spark, sf_dir):
    """ST-02."""
    return sessions(table(spark, sf_dir, "events"), "user_id", "ts", "30 minutes")


def _frames(spark, sf_dir):
    """Frames of a session: a user's events in order, the value as probability and level."""
    from pyspark.sql import Window

    n = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    return table(spark, sf_dir, "events").where("value IS NOT NULL").select(F.col("user_id").alias("key"), n.cast("long").alias("frame_no"), (F.col("value") % 100 / 100).alias("p"), (-90 + F.col("value") % 90).alias("level"))


@register()
def st01_endpointing(spark, sf_dir):
    """ST-01."""
    return folded(_frames(spark, sf_dir), "key", ["frame_no"], S.endpoint(), lambda: None, "key long, frame_no long, event string, speech_ms long, silence_ms long")


@register()
def st03_gated_endpointing(spark, sf_dir):
    """ST-03: each user's events as frames of a session, announced only where near speech reached the least."""
    return folded(_frames(spark, sf_dir), "key", ["frame_no"], S.gated(), lambda: None, "key long, frame_no long, event string, speech_ms long, silence_ms long, level double")


@register()
def st04_noise_floor(spark, sf_dir):
    """ST-04, ST-06."""
    return folded(_frames(spark, sf_dir), "key", ["frame_no"], S.noise, lambda: None, "key long, frame_no long, floor double, level double")


def _turns(spark, sf_dir):
    c = table(spark, sf_dir, "conversations")
    n = F.length("text")
    return c.select(
        F.col("conv_id").alias("key"), F.col("turn").alias("seq"), F.when(n % 6 == 0, "acknowledgement").otherwise("question").alias("intent"), F.element_at(F.split("text", " "), 1).alias("topic"), (n % 5 == 0).alias("is_shift"), (n % 2 == 0).alias("searched"),
        F.lower("text").alias("query"), F.array(n % 7, n % 11).alias("cited"), (n % 9 > 0).alias("completed"), F.when(n % 4 == 0, "en").alias("asked_language"), "text", "role",
    )


@register()
def st07_conversation_state(spark, sf_dir):
    """ST-07, DM-06."""
    return folded(_turns(spark, sf_dir), "key", ["seq"], S.conversation, lambda: None, "key long, seq long, topic string, query string, cited string, language string, interrupted boolean")


@register()
def st08_speech_chunks(spark, sf_dir):
    """ST-08: assistant turns of a conversation as one stream of pieces."""
    pieces = _turns(spark, sf_dir).where("role = 'assistant'").select("key", "seq", F.concat("text", F.lit(" ")).alias("text"))
    return folded(pieces, "key", ["seq"], S.chunker, lambda: None, "key long, n long, chunk string")


@register("SELECT conv_id AS key, turn AS seq, text FROM conversations WHERE turn % 3 <> 1 AND text <> ''")
def st11_think_filter(spark, sf_dir):
    """ST-11: every third turn stands between think tags, of which one is split over two pieces."""
    c = table(spark, sf_dir, "conversations")
    t = F.when(F.col("turn") % 3 == 1, F.concat(F.lit("ink>"), "text", F.lit("</think>"))).otherwise(F.col("text"))
    pieces = c.select(F.col("conv_id").alias("key"), F.col("turn").alias("seq"), t.alias("text"), F.lit(1).alias("part"))
    opening = c.where("turn % 3 = 1").select(F.col("conv_id").alias("key"), F.col("turn").alias("seq"), F.lit("<th").alias("text"), F.lit(0).alias("part"))
    return folded(pieces.unionByName(opening), "key", ["seq", "part"], S.think_filter, lambda: None, "key long, seq long, text string")


@register()
def st10_script_check(spark, sf_dir):
    """ST-10."""
    return folded(_turns(spark, sf_dir).select("key", "seq", "text"), "key", ["seq"], S.script_check, lambda: None, "key long, seq long, verdict string")


@register("""WITH v AS (SELECT event_id, CAST(value * 10 AS BIGINT) AS heard, event_id % 13 = 0 AS stop, event_id % 5 = 0 AS sure, event_id % 3 = 0 AS back, event_id % 7 = 0 AS ended, event_id % 4000 AS waited, event_id % 2 = 0 AS busy FROM events)
    SELECT event_id, CASE WHEN stop OR (sure AND NOT back) THEN 'stop' WHEN ended THEN 'resume' WHEN waited < 700 THEN 'wait' WHEN heard < 250 THEN 'resume' WHEN busy THEN CASE WHEN waited < 2500 THEN 'wait' ELSE 'stop' END WHEN back THEN CASE WHEN waited < 1500 THEN 'wait' ELSE 'resume' END ELSE 'stop' END AS verdict FROM v""")
def st05_barge_in(spark, sf_dir):
    """ST-05."""
    e = F.col("event_id")
    return table(spark, sf_dir, "events").select("event_id", barge_in(F.round(F.col("value") * 10, 0).cast("long"), e % 13 == 0, e % 5 == 0, e % 3 == 0, e % 7 == 0, e % 4000, e % 2 == 0).alias("verdict"))


@register("SELECT page_id, engine, CASE WHEN t <= 400 THEN 0 ELSE 1 + (t - 400) // 400 END::INTEGER AS batch FROM (SELECT page_id, page_id % 3 AS engine, (page_id * 37) % 2000 AS t FROM pages) WHERE t <= 1500")
def st12_result_batches(spark, sf_dir):
    """ST-12."""
    p = table(spark, sf_dir, "pages").select("page_id", (F.col("page_id") % 3).alias("engine"), ((F.col("page_id") * 37) % 2000).alias("t"))
    return batches(p, "engine", "t", 400, 1500).select("page_id", "engine", "batch")
