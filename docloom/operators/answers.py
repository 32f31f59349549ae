"""The answer guard (ST-09): sentences of streamed answers, checked against their sources before they go out.

Pieces become whole sentences in a keyed fold (streaming.steps.sentence_out), on a stream or in a batch; all checks are columns over those sentences, joined to what
their answer's sources state. `guarded` ranks within an answer, which Spark doesn't do on a stream, so it runs over a batch of whole answers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import guard as G
from .shared import stored


def source_facts(sources: DataFrame, key: str, text: str = "text", dealt: bool = False) -> DataFrame:
    """key, unsigned, signed, allowed: how an answer's sources state their figures; each source is reduced before they meet.

    Sources are dealt by key first (unless they are already), so that all cores read texts, also those of a single file."""
    facts = (sources if dealt else sources.repartition(key)).select(key, G.number_facts(F.col(text)).alias("f"), G.figures(F.col(text)).alias("figures"))
    merged = lambda c: F.array_distinct(F.flatten(F.collect_set(c)))
    return facts.groupBy(key).agg(merged("f.unsigned").alias("unsigned"), merged("f.signed").alias("signed"), merged("figures").alias("allowed"))


def units(sources: DataFrame, key: str, text: str = "text", heading: Column | None = None, dealt: bool = False) -> DataFrame:
    """key, unit, numbers: evidence that states a figure (SC-36)."""
    each = (sources if dealt else sources.repartition(key)).select(key, F.explode(G.evidence_units(F.col(text), F.lit("") if heading is None else heading)).alias("unit"))
    return each.withColumn("numbers", G.numbers(F.col("unit"))).where(F.size("numbers") > 0)


def contradicted(sentences: DataFrame, evidence: DataFrame, key: str, number: str, text: str) -> DataFrame:
    """key, number of the denials that the evidence contradicts: for each period they name (or once), one unit has it with all their numbers and words.

    Units meet denials by key and numbers; only of those that do are words worked out, and periods where the denial names one."""
    said = sentences.where(G.not_covered(F.col(text))).select(key, number, G.terms(F.col(text)).alias("said"))
    said = said.where(F.size("said.words") > 0).withColumn("period", F.explode(F.when(F.size("said.periods") > 0, F.col("said.periods")).otherwise(F.array(F.lit(None).cast("int")))))
    alike = lambda w, x: (w == x) | ((F.length(w) >= 5) & (F.length(x) >= 5) & (x.startswith(w) | w.startswith(x)))
    met = said.join(evidence.select(F.col(key).alias("_key"), "unit", "numbers"), (F.col(key) == F.col("_key")) & (F.size(F.array_except("said.numbers", "numbers")) == 0), "left")
    words = F.get(F.transform(F.array(G.words(F.col("unit"))), lambda own: F.forall("said.words", lambda w: F.exists(own, lambda x: alike(w, x)))), F.lit(0))
    dated = F.when(F.col("period").isNull(), True).otherwise(F.array_contains(G.periods(G.without_citations(F.col("unit")), stated=True), F.col("period")))
    fits = F.when(F.col("unit").isNotNull(), F.when(dated, words))
    met = met.groupBy(key, number, "period").agg(F.max(F.coalesce(fits, F.lit(False))).alias("stated"))
    return met.groupBy(key, number).agg(F.bool_and("stated").alias("all")).where("all").select(key, number)


def guarded(sentences: DataFrame, sources: DataFrame, key: str = "key", number: str = "n", text: str = "sentence", line: str = "I can't confirm that figure.", dealt: bool = False) -> DataFrame:
    """ST-09: each sentence with its action and what goes out. dealt: sources are dealt by key already.

    Numbers are repaired and signs put right (SC-37). A denial that the evidence contradicts loses its denying clause; where nothing can stand
    before it the first sentence asks for a retry and a later one is dropped. A sentence with a figure that no source has becomes a fixed line, once an answer,
    and is dropped after that. Other sentences are released.
    """
    facts = source_facts(sources, key, dealt=dealt)
    sentences = stored(sentences.select(key, number, text), "sentences")
    # One row a key, so that all joins and the window below need the same deal.
    denied = contradicted(sentences, units(sources, key, dealt=dealt), key, number, text).groupBy(key).agg(F.collect_set(number).alias("_numbers"))
    s = sentences.join(facts, key, "left").join(denied, key, "left").withColumn("_denied", F.when(F.array_contains("_numbers", F.col(number)), True)).withColumn("_repaired", G.repaired(F.col(text)))
    none = F.array().cast("array<string>")
    fixed = G.unflipped(F.col("_repaired"), F.coalesce("unsigned", none), F.coalesce("signed", none))
    s = s.withColumn("fixed", fixed).withColumn("kept", F.when(F.col("_denied"), G.drop_denial(F.col("fixed"))))
    s = s.withColumn("_loose", F.col("_denied").isNull() & (F.size(G.unsupported_figures(F.col("fixed"), F.coalesce("allowed", none))) > 0))
    earlier = F.coalesce(F.max(F.col("_loose").cast("int")).over(Window.partitionBy(key).orderBy(number).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) == 1
    action = (
        F.when(F.col("_denied") & F.col("kept").isNotNull(), "clause_dropped").when(F.col("_denied"), F.when(F.col(number) == 1, "retry").otherwise("dropped"))
        .when(F.col("_loose"), F.when(earlier, "figure_dropped").otherwise("figure_replaced")).when(F.col("fixed") != F.col(text), "repaired").otherwise("released")
    )
    s = s.withColumn("action", action)
    out = F.when(F.col("action") == "clause_dropped", F.col("kept")).when(F.col("action").isin("retry", "dropped", "figure_dropped"), "").when(F.col("action") == "figure_replaced", line).otherwise(F.col("fixed"))
    return s.select(key, number, text, "action", out.alias("out"))
