"""Writers; column order is the order of the select, so headers are stable."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def scratch(spark: SparkSession) -> str:
    """A new folder below the shared checkpoint folder; a local temporary folder only in local mode."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base is None:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
        return tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    return os.path.join(base, f"evirank-{uuid.uuid4().hex}")


def jsonl(df: DataFrame, path: str) -> str:
    df.write.mode("errorifexists").option("ignoreNullFields", "false").json(path)
    return path


def delimited(df: DataFrame, path: str, sep: str = ",") -> str:
    df.write.mode("errorifexists").option("header", "true").option("sep", sep).csv(path)
    return path


def lines(df: DataFrame, path: str) -> str:
    """A single string column, one line per row."""
    df.write.mode("errorifexists").text(path)
    return path


def documents(df: DataFrame, path: str, key: str, value: str, head: str, tail: str) -> str:
    """One file per key whose rows stand between head and tail; the caller keeps the rows per key few."""
    body = F.array_join(F.array_sort(F.collect_list(value)), "")
    whole = df.groupBy(key).agg(F.concat(F.lit(head), body, F.lit(tail)).alias("value"))
    whole.write.mode("errorifexists").partitionBy(key).text(path)
    return path


def split_files(rows: DataFrame, report: DataFrame, path: str, key: str) -> dict[str, str]:
    """Samples as Parquet by split, their ids as CSV, the report as JSON."""
    paths = {name: os.path.join(path, name) for name in ("samples", "ids", "report")}
    rows.write.mode("errorifexists").partitionBy("split").parquet(paths["samples"])
    delimited(rows.select("split", key), paths["ids"])
    jsonl(report, paths["report"])
    return paths
