"""Resume bookkeeping, completeness and consistency checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def pending(work: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    return work.join(done.select(*keys), keys, "left_anti")


def reusable_calls(log: DataFrame) -> DataFrame:
    """The last log row of each (fact, hypothesis) decides: usable when it parsed and judged something."""
    last = log.groupBy("fact_id", "hyp_idx").agg(
        F.max_by("parse_ok", "log_pos").alias("parse_ok"), F.max_by("n_verdicts", "log_pos").alias("n_verdicts"), F.count(F.lit(1)).alias("n_rows"))
    return last.withColumn("reusable", F.col("parse_ok") & (F.col("n_verdicts") > 0))


def missing_keys(expected: DataFrame, got: DataFrame, keys: list[str]) -> DataFrame:
    return expected.select(*keys).distinct().join(got.select(*keys), keys, "left_anti")


def require_empty(df: DataFrame, message: str) -> None:
    """Driver-side gate: reads at most one row."""
    if df.take(1):
        raise ValueError(message)


def parse_rate_guard(log: DataFrame, first: int, minimum: float) -> DataFrame:
    """Parse rate over the first calls of the log and whether the run should stop."""
    head = log.orderBy("log_pos").limit(first)
    return head.agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(F.col("parse_ok").cast("double")), 6).alias("parse_rate")).withColumn(
        "abort", (F.col("n") >= first) & (F.col("parse_rate") < minimum))


def invalid_records(records: DataFrame, mode: str, k: int) -> DataFrame:
    """Records of another query mode or with more than k candidates."""
    return records.where((F.col("query_mode") != mode) | (F.col("n_candidates") > k))


def config_drift(declared: DataFrame, pinned: DataFrame, tolerance: float = 1e-9) -> DataFrame:
    """declared(run, name, value text), pinned(name, value, allowed array): OK, ALLOWED, DRIFT or MISSING per run and name.

    Numbers agree within the tolerance, comma lists regardless of order; a name a run does not state is MISSING, no drift;
    a run that states nothing has NO METADATA.
    """
    runs = declared.groupBy("run").agg(F.count("name").alias("n_names"))
    wanted = runs.withColumn("one", F.lit(1)).join(pinned.withColumn("one", F.lit(1)), "one").drop("one")

    def as_set(c: str) -> Column:
        return F.array_sort(F.transform(F.split(c, ","), lambda x: F.trim(x)))

    number = F.expr("try_cast(value as double)"), F.expr("try_cast(pin as double)")
    close = F.abs(number[0] - number[1]) <= tolerance
    joined = wanted.withColumnRenamed("value", "pin").join(declared, ["run", "name"], "left")
    same = F.coalesce(close, F.lit(False)) | (as_set("value") == as_set("pin"))
    return joined.select(
        "run", "name", F.when(F.col("n_names") == 0, "NO METADATA").when(F.col("value").isNull(), "MISSING").when(same, "OK").when(
            F.array_contains("allowed", F.col("value")), "ALLOWED").otherwise("DRIFT").alias("status"))


def window_mismatch(verdicts: DataFrame, windows: DataFrame, m: int) -> DataFrame:
    """Verdicts outside the first m candidates of their call; a generated run of m must have none."""
    return verdicts.join(windows.where(F.col("pos") <= m), ["fact_id", "hyp_idx", "tag"], "left_anti")


def vocabulary_check(vocabulary: DataFrame, dims: list[str], filled: list[str]) -> DataFrame:
    """vocabulary(dimension, category, phrase): filled dimensions must have phrases, the others none."""
    counts = vocabulary.groupBy("dimension").agg(F.count("phrase").alias("n"))
    every = vocabulary.sparkSession.createDataFrame([(d, d in filled) for d in dims], "dimension string, wanted boolean")
    n = F.coalesce("n", F.lit(0))
    return every.join(counts, "dimension", "left").select("dimension", n.alias("n_phrases"), (F.col("wanted") == (n > 0)).alias("ok"))
