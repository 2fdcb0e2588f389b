"""Windows of candidates shown to a verifier, and what the stored verdicts cover."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evirank.domain import DIMENSIONS
from evirank.operators.fuse import high, ranked


def score_window(ranking: DataFrame, score: str, m: int) -> DataFrame:
    return ranked(ranking, ["fact_id"], [high(score), F.asc("tag")], m, "pos")


def cluster_representatives(ranking: DataFrame, profiles: DataFrame, m: int, scan: int, keys: tuple = ("fact_id",)) -> DataFrame:
    """First of each category signature within the scanned head, in rank order, padded by rank to m."""
    signature = profiles.select("tag", F.to_json("cats").alias("signature"))
    head = ranking.where(F.col("rank") <= max(scan, m)).join(signature, "tag", "left")
    first = ranked(head, [*keys, "signature"], [F.asc("rank")], None, "seen")
    return ranked(first, list(keys), [F.desc((F.col("seen") == 1).cast("int")), F.asc("rank")], m, "pos")


def unresolved_tags(windows: DataFrame, known: DataFrame) -> DataFrame:
    """Per arm: window tags without a payload, and the facts that have a window."""
    marked = windows.join(known.withColumn("known", F.lit(True)), "tag", "left")
    return marked.groupBy("arm").agg(
        F.count_if(F.col("known").isNull()).alias("unresolved_tags"), F.countDistinct("fact_id").alias("facts"))


def verdict_coverage(needed: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Share of the needed (fact, hypothesis, tag) keys with a verdict, and what that means for reuse."""
    keys = ["fact_id", "hyp_idx", "tag"]
    have = verdicts.select(*keys).distinct().withColumn("have", F.lit(1.0))
    per_fact = needed.join(have, keys, "left").groupBy("fact_id").agg(F.avg(F.coalesce("have", F.lit(0.0))).alias("coverage"))
    status = F.when(F.col("coverage") >= 1, "REUSE").when(F.col("coverage") > 0, "PARTIAL").otherwise("NEEDS")
    return per_fact.withColumn("status", status)


def feedback_tally(verdicts: DataFrame) -> DataFrame:
    return verdicts.groupBy("fact_id", "dim").agg(
        F.count_if(F.col("matched")).alias("support"), F.count_if(~F.col("matched")).alias("against"),
        F.count_if(F.col("matched").isNull()).alias("abstain"))


def revision_target(tally: DataFrame) -> DataFrame:
    """Dimension with the largest positive margin of counter-evidence; the first dimension wins a tie."""
    place = F.array_position(F.array(*[F.lit(d.lower()) for d in DIMENSIONS]), F.lower("dim"))
    rows = tally.withColumn("margin", F.col("against") - F.col("support")).withColumn("place", place)
    best = rows.groupBy("fact_id").agg(
        F.max_by("dim", F.struct("margin", -F.col("place"))).alias("target_dimension"), F.max("margin").alias("margin"))
    return best.where(F.col("margin") > 0)
