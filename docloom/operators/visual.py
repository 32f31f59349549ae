"""The declarative chart form: limits, problems, fallbacks, drafts and overviews as DataFrame transforms (F5, VQ).

Values are long rows (table_id, series, x, value, unit). A chart is chosen for every table at once, from a profile of its values.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Series and x limits of each kind, kinds on one axis, kinds without negatives, what a kind falls back to.
LIMITS = {
    "line": (1, 4, 2, 24), "bar": (1, 4, 1, 12), "grouped_bar": (2, 4, 1, 12), "stacked_bar": (2, 6, 1, 12), "waterfall": (1, 1, 2, 12),
    "donut": (1, 1, 2, 8), "table": (1, 8, 1, 30), "kpi": (1, 6, 1, 12), "comparison": (1, 3, 1, 2), "timeline": (0, 1, 1, 20),
}
SINGLE_UNIT = ["grouped_bar", "stacked_bar", "waterfall", "donut"]
NO_NEGATIVES = ["donut", "stacked_bar"]
FALLBACK = {"line": "bar", "donut": "bar", "stacked_bar": "grouped_bar", "grouped_bar": "bar", "waterfall": "bar", "comparison": "bar"}


def profile(values: DataFrame, key: str = "table_id") -> DataFrame:
    """Counts that decide what a table can show."""
    v = values.where(F.col("value").isNotNull())
    return v.groupBy(key).agg(F.count_distinct("series").alias("n_series"), F.count_distinct("x").alias("n_x"), F.count_distinct("unit").alias("n_units"), F.count_if(F.col("value") < 0).alias("negatives"))


def kinds() -> Column:
    """VQ-02: the kinds and limits as an array of structs."""
    return F.array(*[F.struct(F.lit(k).alias("kind"), *[F.lit(n).alias(c) for n, c in zip(v, ("series_min", "series_max", "x_min", "x_max"), strict=True)]) for k, v in LIMITS.items()])


def problems(profiles: DataFrame) -> DataFrame:
    """VQ-01: for each table and kind everything that stands against it."""
    p = profiles.withColumn("k", F.explode(kinds())).select(*profiles.columns, "k.*")
    when = lambda c, text: F.when(c, F.lit(text))
    found = F.array_compact(
        F.array(
            when(F.col("n_series") < F.col("series_min"), "too few series"), when(F.col("n_series") > F.col("series_max"), "too many series"), when(F.col("n_x") < F.col("x_min"), "too few points"), when(F.col("n_x") > F.col("x_max"), "too many points"),
            when(F.col("kind").isin(SINGLE_UNIT) & (F.col("n_units") > 1), "mixed units"), when(F.col("kind").isin(NO_NEGATIVES) & (F.col("negatives") > 0), "negative values"),
        )
    )
    return p.select(*profiles.columns, "kind", found.alias("problems"))


def built(profiles: DataFrame, wanted: Column, check=None) -> DataFrame:
    """VQ-10, UD-07: the wanted kind, or the first of its fallbacks that nothing stands against (nor fails check(kind), a condition of the caller's), else a table."""
    ok = problems(profiles).where((F.size("problems") == 0) & (F.lit(True) if check is None else check(F.col("kind")))).groupBy(*profiles.columns).agg(F.collect_set("kind").alias("ok"))
    chain = F.create_map(*[F.lit(x) for kv in FALLBACK.items() for x in kv])
    d = profiles.join(ok, profiles.columns, "left").withColumn("wanted", wanted)
    one = chain[F.col("wanted")]
    two = chain[one]
    tries = F.array_compact(F.array(F.col("wanted"), one, two))
    return d.select(*profiles.columns, "wanted", F.coalesce(F.get(F.filter(tries, lambda k: F.array_contains(F.coalesce(F.col("ok"), F.array()), k)), F.lit(0)), F.lit("table")).alias("kind"))


def drafted(profiles: DataFrame, periods_down: Column, additive: Column) -> DataFrame:
    """VQ-13, VQ-14: the default chart of a layout, with its confidence."""
    kind = F.when(periods_down, F.when(F.col("n_x") >= 3, "line").when(F.col("n_series") > 1, "grouped_bar").otherwise("bar")).when((F.col("n_series") == 1) & additive & F.col("n_x").between(2, 8), "donut").when(F.col("n_series") > 1, "grouped_bar").otherwise("bar")
    return profiles.select("*", kind.alias("kind"), F.when(F.col("n_series") > 4, 0.5).otherwise(0.8).alias("confidence"))


def overview(options: DataFrame, document: str, most: int = 6) -> DataFrame:
    """VQ-12, WN-25: per document one panel of each purpose by confidence, documents taking turns, up to a cap."""
    best = options.withColumn("_r", F.row_number().over(Window.partitionBy(document, "purpose").orderBy(F.desc("confidence"), "table_id"))).where("_r = 1")
    turn = best.withColumn("round", F.row_number().over(Window.partitionBy(document).orderBy(F.desc("confidence"), "purpose")))
    return turn.where(F.col("round") <= most).select(document, "table_id", "purpose", "confidence", "round")


def edited(spec: DataFrame, kind: Column, only: Column, add: Column) -> DataFrame:
    """VQ-11: a new kind where one is given; periods replaced by `only`, or joined by `add`."""
    p = F.when(only.isNotNull(), only).when(add.isNotNull(), F.array_sort(F.array_distinct(F.concat("periods", add)))).otherwise(F.col("periods"))
    return spec.withColumn("kind", F.coalesce(kind, F.col("kind"))).withColumn("periods", p)


def small_multiples(series: DataFrame, key: str, position: str, slots: int = 8) -> DataFrame:
    """AG-38: series grouped by unit in order of first appearance; colours for the first slots, then other."""
    first = F.min(position).over(Window.partitionBy(key, "unit"))
    d = series.withColumn("_first", first).withColumn("panel", F.dense_rank().over(Window.partitionBy(key).orderBy("_first")))
    n = F.row_number().over(Window.partitionBy(key).orderBy(position))
    return d.withColumn("colour", F.when(n <= slots, n)).drop("_first")


def panels_moved(panels: DataFrame, op: Column) -> DataFrame:
    """DM-09: a chat's panels (ordered array of struct<id, pinned>) after one operation: op is struct<kind, id>."""
    p, k, i = F.col("panels"), op["kind"], op["id"]
    pin = lambda flag: F.transform(p, lambda x: F.struct(x["id"].alias("id"), F.when(x["id"] == i, F.lit(flag)).otherwise(x["pinned"]).alias("pinned")))
    rest = F.filter(p, lambda x: x["id"] != i)
    own = F.filter(p, lambda x: x["id"] == i)
    return panels.withColumn("panels", F.when(k == "pin", pin(True)).when(k == "unpin", pin(False)).when(k == "remove", rest).when(k == "front", F.concat(own, rest)).when((k == "add") & (F.size(own) == 0), F.concat(p, F.array(F.struct(i.alias("id"), F.lit(False).alias("pinned"))))).otherwise(p))
