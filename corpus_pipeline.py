"""The corpus pipeline: language ID, near-dedup, decontamination, PII, mixing, each stage on what the one before kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evirank.llm import decontaminate, langid, mixing, pii, simhash
from evirank.llm.common import checkpointed, tag


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents in no language: null texts and texts without a letter. `lang` becomes the predicted language, however the
    probability is spread: texts in several languages or full of digits stay. The network learns from the labelled languages of docs
    itself, held-out ids left out. Other columns stay."""
    guess, score = f"lang_{tag()}", f"score_{tag()}"
    found = langid.identify(docs, langid.fit(docs), names=(guess, score))
    return found.where(F.col(guess) != langid.UNKNOWN).withColumn("lang", F.col(guess)).select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies by SimHash the document with the least id stays."""
    return simhash.one_of_each(docs)


def remove_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a whole window of a benchmark item; all others stay as they are."""
    own = f"{tag()}_"
    scanned = decontaminate.contamination(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), prefix=own)
    return scanned.where(F.col(f"{own}n_hit") == 0).select(*docs.columns)


def remove_pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data becomes its kind in angle brackets."""
    return pii.redact(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents the mix takes, with `copies`: how often."""
    return mixing.mixed(docs)


STAGES = [
    ("language_id", identify_language),
    ("near_dedup", drop_near_duplicates),
    ("decontamination", remove_benchmark),
    ("pii", remove_pii),
    ("mixing", mix_sources),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order over documents, each written to the shared checkpoint folder before the next reads it."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(spark, stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)


def written(spark: SparkSession, df: DataFrame, name: str) -> DataFrame:
    """df as a Parquet table in spark.checkpoint.dir; where that is unset (tests), a checkpoint instead."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder is None:
        return checkpointed(df)
    path = f"{folder}/pipeline-{name}-{tag()}"
    df.write.parquet(path)
    return spark.read.parquet(path)


#: No SQL: the first stage is a trained network. tests/llm compares the stages with brute force.
ORACLE_SQL = None

QUERIES = {"pipeline": run}
ORACLES: dict[str, str] = {} if ORACLE_SQL is None else {"pipeline": ORACLE_SQL}
