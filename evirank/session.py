"""Session helpers."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def local_session(cpus: int | str = 8, partitions: int = 8) -> SparkSession:
    """Session for tests and benches; on a cluster the submitting job supplies its own."""
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("evirank")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", os.environ.get("EVIRANK_DRIVER_MEMORY", "8g"))
        .config("spark.driver.extraJavaOptions", "-Xss8m")
        .getOrCreate()
    )


def shared_folder(spark: SparkSession) -> str:
    """The folder every executor can reach: what the cluster names in spark.checkpoint.dir; a temporary one in local mode only."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder is None:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
        folder = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    return folder


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut lineage into the shared checkpoint folder the cluster names."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint(eager=True)


def by_fact(df: DataFrame, key: str = "fact_id") -> DataFrame:
    """Rows dealt by fact_id. Aggregates and windows over the fact and more keys, and joins by fact_id alone, then move nothing; the
    count is fixed, so the partitions still match those of other frames dealt by fact."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), key)


def stored_by_fact(df: DataFrame, key: str = "fact_id") -> DataFrame:
    """Write rows once, compressed, in buckets of the key; what reads them finds them dealt as `by_fact` deals, without a shuffle."""
    spark, name = df.sparkSession, f"by_fact_{uuid.uuid4().hex[:12]}"
    (df.write.bucketBy(int(spark.conf.get("spark.sql.shuffle.partitions")), key).sortBy(key).option("compression", "zstd")
     .option("path", f"{shared_folder(spark)}/{name}").saveAsTable(name))
    return spark.table(name)


def looked_up(rows: DataFrame, table: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """Left join of `table`, unique by fact_id and `keys`, whose rows of one fact are few: they meet the fact as a map, by fact_id
    alone, so rows that lie by fact stay there (a join by all keys would move them)."""
    entry = F.struct(F.struct(*keys).alias("key"), F.struct(*values).alias("value"))
    held = table.groupBy("fact_id").agg(F.map_from_entries(F.collect_list(entry)).alias("_held"))
    kinds = dict(table.dtypes)
    key = F.struct(*[F.col(k).cast(kinds[k]).alias(k) for k in keys])
    joined = rows.join(held, "fact_id", "left").withColumn("_found", F.try_element_at("_held", key))
    return joined.select(*rows.columns, *[F.col("_found")[v].alias(v) for v in values])
