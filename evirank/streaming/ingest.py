"""Streaming forms of log ingest and running statistics.

Both are keyed, not windowed by time, so no watermark is needed: state holds one row per key.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CALL_LOG = "log_pos bigint, fact_id bigint, hyp_idx int, parse_ok boolean, n_verdicts int, prompt_tokens bigint, completion_tokens bigint"


def call_log(spark: SparkSession, path: str, files_per_batch: int | None = None) -> DataFrame:
    reader = spark.readStream.schema(CALL_LOG)
    return (reader if files_per_batch is None else reader.option("maxFilesPerTrigger", files_per_batch)).json(path)


def _last(rows: DataFrame) -> DataFrame:
    """The last row per key; of one log position the later batch."""
    names = [c for c in rows.columns if c != "batch"]
    last = rows.groupBy("fact_id", "hyp_idx").agg(F.max_by(F.struct(*names), "log_pos").alias("r"))
    return last.select("r.*")


def upsert_calls(batch: DataFrame, batch_id: int, table: str) -> None:
    """Write the batch's last row per key as its own version folder; a replayed batch replaces itself."""
    _last(batch).write.mode("overwrite").parquet(f"{table}/batches/batch={batch_id}")


def ingest_calls(log: DataFrame, table: str, checkpoint: str):
    """Start the ingest; the checkpoint takes the place of a resume flag."""
    return (log.writeStream.foreachBatch(lambda df, i: upsert_calls(df, i, table)).option("checkpointLocation", checkpoint)
            .trigger(availableNow=True).start())


def _versions(spark: SparkSession, table: str, newest: int | None = None) -> tuple[int, DataFrame]:
    """Last compacted batch (-1: none) and the rows to read: that state and the batches after it, up to `newest`."""
    batches = spark.read.schema(CALL_LOG + ", batch bigint").parquet(f"{table}/batches")
    if newest is not None:
        batches = batches.where(F.col("batch") <= newest)
    try:
        upto = spark.read.schema("upto bigint").parquet(f"{table}/compacted").agg(F.max("upto")).first()[0]
    except AnalysisException as error:  # nothing compacted yet
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        upto = None
    if upto is None:
        return -1, batches
    return upto, spark.read.schema(CALL_LOG).parquet(f"{table}/states/{upto}").unionByName(batches.where(F.col("batch") > upto).drop("batch"))


def compact_calls(spark: SparkSession, table: str) -> int:
    """Fold all batches so far into one state, one row per key; readers then skip those batches. Returns the last batch folded in.

    The state is written first and named in `compacted` after, so a job that dies between leaves the table as it was, and one that
    runs again replaces what it wrote. Batches that arrive meanwhile stay outside. Folded batch folders may be deleted."""
    newest = spark.read.schema(CALL_LOG + ", batch bigint").parquet(f"{table}/batches").agg(F.max("batch")).first()[0]
    upto, rows = _versions(spark, table, newest)
    if newest is None or newest <= upto:
        return upto
    _last(rows).write.mode("overwrite").parquet(f"{table}/states/{newest}")
    spark.createDataFrame([(newest,)], "upto bigint").coalesce(1).write.mode("append").parquet(f"{table}/compacted")
    return newest


def current_calls(spark: SparkSession, table: str) -> DataFrame:
    """The state of the table: the last row per key over all batches, usable ones only."""
    last = _last(_versions(spark, table)[1])
    return last.select("fact_id", "hyp_idx", "log_pos", "parse_ok", "n_verdicts").where("parse_ok AND n_verdicts > 0")


def running_statistics(log: DataFrame, by: str = "hyp_idx") -> DataFrame:
    """Counts and sums that update as calls arrive; write with outputMode("complete") or ("update")."""
    return log.groupBy(by).agg(
        F.count(F.lit(1)).alias("n_calls"), F.sum("prompt_tokens").alias("prompt_tokens"), F.sum("completion_tokens").alias("completion_tokens"),
        F.avg(F.col("parse_ok").cast("double")).alias("parse_rate"))


def run_statistics(log: DataFrame, name: str, checkpoint: str):
    """Run the statistics over everything available into an in-memory table, for tests and small reports."""
    return (running_statistics(log).writeStream.outputMode("complete").format("memory").queryName(name)
            .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
