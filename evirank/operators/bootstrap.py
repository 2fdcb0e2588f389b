"""Cluster bootstrap intervals.

Facts are summed to one row per context first. Contexts get a dense number in md5 order; draw b picks number
md5(b-slot-seed) mod n for every slot. A shuffle-free explode makes the slots, the pick joins context sums on the
number, and sums per draw combine map-side, so the intermediate is draws x contexts narrow rows spread over all tasks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evirank.functions.text import md5_int
from evirank.operators.splits import hashed_order


def numbered_contexts(rows: DataFrame, by: list[str], sums: dict) -> DataFrame:
    """One row per (by, context) with its sums and number 0..n-1; n beside it."""
    per_context = rows.groupBy(*by, "context_id").agg(*[c.alias(n) for n, c in sums.items()])
    placed = hashed_order(per_context, "context_id", "ctx", by, digits=2).drop("running")
    n = placed.groupBy(*by).agg(F.count(F.lit(1)).alias("n_contexts"))
    return (placed.join(n, by) if by else placed.join(n)).withColumn("number", F.col("place") - 1).drop("place")


def draw_sums(contexts: DataFrame, by: list[str], names: list[str], draws: int, seed: int) -> DataFrame:
    """Resampled sums per draw; the draw table is the same for every `by` group with as many contexts."""
    slots = contexts.select(*by, "n_contexts", F.col("number").alias("slot"), F.explode(F.sequence(F.lit(0), F.lit(draws - 1))).alias("draw"))
    key = F.concat_ws("-", F.col("draw").cast("string"), F.col("slot").cast("string"), F.lit(str(seed)))
    picks = slots.select(*by, "draw", (md5_int(key) % F.col("n_contexts")).alias("number"))
    return picks.join(contexts.select(*by, "number", *names), [*by, "number"]).groupBy(*by, "draw").agg(
        *[F.sum(n).alias(n) for n in names])


def interval(rows: DataFrame, by: list[str], numerator, denominator, draws: int, seed: int) -> DataFrame:
    """Observed ratio of sums with its 2.5 and 97.5 percentile over the draws."""
    contexts = numbered_contexts(rows, by, {"num": F.sum(numerator), "den": F.sum(denominator)})
    ratios = draw_sums(contexts, by, ["num", "den"], draws, seed).withColumn("ratio", F.try_divide("num", "den"))
    ci = ratios.groupBy(*by).agg(F.percentile("ratio", F.array(F.lit(0.025), F.lit(0.975))).alias("q"))
    seen = contexts.groupBy(*by).agg((F.sum("num") / F.sum("den")).alias("mean"), F.sum("den").alias("n"), F.count(F.lit(1)).alias("n_contexts"))
    both = seen.join(ci, by) if by else seen.join(ci)
    return both.select(
        *by, F.round("mean", 6).alias("mean"), F.round(F.col("q")[0], 6).alias("ci_low"), F.round(F.col("q")[1], 6).alias("ci_high"),
        F.col("n").cast("bigint").alias("n"), "n_contexts",
        ((F.round(F.col("q")[0], 9) > 0) | (F.round(F.col("q")[1], 9) < 0)).alias("excludes_zero"))


def mean_interval(facts: DataFrame, value: str, by: list[str], draws: int, seed: int) -> DataFrame:
    return interval(facts, by, F.col(value), F.lit(1.0), draws, seed)


def paired_interval(left: DataFrame, right: DataFrame, value: str, by: list[str], draws: int, seed: int) -> DataFrame:
    """Interval of the mean difference over the facts both sides have."""
    joined = left.join(right.select("fact_id", *by, F.col(value).alias("_right")), ["fact_id", *by])
    return mean_interval(joined.withColumn("difference", F.col(value) - F.col("_right")), "difference", by, draws, seed)


def paired_table(metrics: DataFrame, pairs: list[tuple[str, str]], names: list[str], draws: int, seed: int) -> DataFrame:
    """metrics(arm, fact_id, context_id, modality, names..): each contrast x metric x slice in one job."""
    long = metrics.unpivot(["arm", "fact_id", "context_id", "modality"], names, "metric", "value")
    long = long.withColumn("modality", F.explode(F.array(F.col("modality"), F.lit("pooled"))))
    frames = []
    for a, b in pairs:
        left, right = long.where(F.col("arm") == a), long.where(F.col("arm") == b)
        both = left.join(right.select("fact_id", "metric", "modality", F.col("value").alias("other")), ["fact_id", "metric", "modality"])
        frames.append(both.withColumns({"contrast": F.lit(f"{a}-{b}"), "difference": F.col("value") - F.col("other")}))
    out = frames[0]
    for extra in frames[1:]:
        out = out.unionByName(extra)
    return mean_interval(out, "difference", ["contrast", "metric", "modality"], draws, seed)


def gate(intervals: DataFrame, minimum: float) -> DataFrame:
    """Halt below zero, claim when the mean reaches the minimum and the interval stays above zero, else weak."""
    decision = F.when(F.col("mean") < 0, "halt_requires_ack").when((F.col("mean") >= minimum) & (F.col("ci_low") > 0), "proceed_claim").otherwise("proceed_weak")
    return intervals.withColumn("decision", decision)
