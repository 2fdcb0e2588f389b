"""Registered queries, their oracle SQL, and the SQL fragments both sides share."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evirank.domain import STOPWORDS

QUERIES: dict[str, Callable] = {}
ORACLES: dict[str, str] = {}
FRAGMENTS: dict[str, str] = {}


class Tables:
    """Driver tables by name, read lazily so each query scans only the columns it uses."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark = spark
        self.folder = folder

    def __getattr__(self, name: str) -> DataFrame:
        df = self.spark.read.parquet(f"{self.folder}/{name}.parquet")
        return spread(df) if name in ("documents", "pages") else df


def spread(df: DataFrame) -> DataFrame:
    """Text work is CPU-bound: a file with fewer splits than cores is spread out first, larger inputs stay as read."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores)


def widened(df: DataFrame) -> DataFrame:
    """Counts and ranks leave as bigint, the type SQL engines give them."""
    return df.withColumns({c: F.col(c).cast("bigint") for c, kind in df.dtypes if kind in ("int", "smallint", "tinyint")})


def query(name: str, oracle: str | None = None):
    def register(fn):
        QUERIES[name] = lambda spark, folder: widened(fn(Tables(spark, folder)))
        if oracle is not None:
            ORACLES[name] = with_fragments(oracle)
        return fn

    return register


def fragment(name: str, sql: str) -> None:
    FRAGMENTS[name] = sql


def with_fragments(sql: str) -> str:
    """Prefix the WITH list of every fragment the statement uses, dependencies first."""
    ordered: list[str] = []

    open_names: set[str] = set()

    def visit(text: str):
        for name in FRAGMENTS:
            if name not in ordered and name not in open_names and re.search(rf"\b(?:FROM|JOIN)\s+{name}\b", text):
                open_names.add(name)
                visit(FRAGMENTS[name])
                if name not in ordered:
                    ordered.append(name)

    visit(sql)
    if not ordered:
        return sql
    head = ",\n".join(f"{name} AS ({FRAGMENTS[name]})" for name in ordered)
    if sql.lstrip().startswith("WITH "):
        return f"WITH RECURSIVE {head},\n{sql.lstrip()[5:]}"
    return f"WITH RECURSIVE {head}\n{sql}"


# SQL spellings of the shared text rules (DuckDB dialect).

def sql_space(x: str) -> str:
    return f"trim(regexp_replace(coalesce({x}, ''), '[\\s\\x0b\\x1c-\\x1f\\x{{85}}\\p{{Z}}]+', ' ', 'g'))"


def sql_tokens(x: str) -> str:
    stop = ", ".join(f"'{w}'" for w in STOPWORDS)
    camel = (
        f"regexp_replace(regexp_replace({x}, '([a-z0-9])([A-Z])', '\\1 \\2', 'g'),"
        " '([A-Z])([A-Z][a-z])', '\\1 \\2', 'g')"
    )
    fold = (
        "CASE WHEN length(t) > 4 AND t LIKE '%ies' THEN t[:length(t)-3] || 'y' "
        "WHEN length(t) > 3 AND t LIKE '%s' AND t NOT LIKE '%ss' THEN t[:length(t)-1] ELSE t END"
    )
    return (
        f"list_filter(list_transform(regexp_extract_all(lower({x} || ' ' || {camel}), '[a-z0-9]+'), "
        f"lambda t: {fold}), lambda w: w NOT IN ({stop}))"
    )


def sql_md5(x: str) -> str:
    return f"('0x' || substr(md5({x}), 1, 8))::BIGINT"
