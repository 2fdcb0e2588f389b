"""Combining several rankings of one fact.

rankings(fact_id, list_id, rank, tag, ...) is long; a fact holds at most top_k rows per list, so windows over a fact
stay small however many facts there are. `keys` may carry more columns (a config id, a round) in front of the tag.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def ranked(df: DataFrame, keys: list[str], order: list[Column], k: int | None = None, name: str = "rank") -> DataFrame:
    """Number rows per key; with k only the first k remain (and Spark prunes before the shuffle)."""
    out = df.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    return out if k is None else out.where(F.col(name) <= k)


def high(name: str) -> Column:
    """Descending order that ignores the last bits of a float sum, so ties do not depend on summation order."""
    return F.desc(F.round(F.col(name), 10))


# The tie-break contracts; functions, because columns need a running session.

def fused_order() -> list[Column]:
    return [high("fused_score"), F.asc("first_list"), F.asc("best_rank"), F.asc("tag")]


def pool_order() -> list[Column]:
    return [high("fused_score"), F.asc("best_rank"), F.asc("tag")]


def final_order() -> list[Column]:
    return [high("final_score"), F.asc("tag")]


def rerank_order() -> list[Column]:
    return [high("final_score"), F.asc("rank"), F.asc("tag")]


def rrf_scores(rankings: DataFrame, kappa: float = 60.0, how: str = "sum", keys: tuple = ("fact_id",),
               payload: tuple = ()) -> DataFrame:
    """Reciprocal-rank score per (keys, tag); "mean" divides by the lists that hold the tag, not by all lists."""
    if how not in ("sum", "mean"):
        raise ValueError(f"unknown fusion {how!r}")
    usable = rankings.where((F.col("rank") > 0) & (F.coalesce("tag", F.lit("")) != ""))
    share = 1.0 / (F.lit(kappa) + F.col("rank"))
    best = [F.min_by(F.col(c), F.struct("rank", "list_id")).alias(c) for c in payload]
    return usable.groupBy(*keys, "tag").agg(
        (F.sum(share) if how == "sum" else F.avg(share)).alias("fused_score"),
        F.min("rank").alias("best_rank"), F.min("list_id").alias("first_list"),
        F.count(F.lit(1)).alias("n_lists"), *best,
    )


def fuse(rankings: DataFrame, top_k: int | None = None, kappa: float = 60.0, how: str = "sum",
         keys: tuple = ("fact_id",), payload: tuple = ()) -> DataFrame:
    return ranked(rrf_scores(rankings, kappa, how, keys, payload), list(keys), fused_order(), top_k)


def fuse_tag_lists(lists: DataFrame, kappa: float = 60.0) -> DataFrame:
    """lists(fact_id, list_id, tags array): fusion of bare ordered tag lists."""
    rows = lists.select("fact_id", "list_id", F.posexplode("tags").alias("pos", "tag"))
    return fuse(rows.withColumn("rank", F.col("pos") + 1), kappa=kappa)


def round_hits(rankings: DataFrame, keys: tuple = ("fact_id",)) -> DataFrame:
    """All (list, rank) places of a tag, in list order."""
    places = F.array_sort(F.collect_list(F.struct("list_id", "rank")))
    return rankings.groupBy(*keys, "tag").agg(places.alias("hits"))


def minmax(df: DataFrame, keys: list[str], score: str, on_tie: float, name: str) -> DataFrame:
    """Scale to [0, 1] within the keys; a spread of nothing gives `on_tie` to all."""
    window = Window.partitionBy(*keys)
    low, spread = F.min(score).over(window), F.max(score).over(window) - F.min(score).over(window)
    return df.withColumn(name, F.when(spread < 1e-12, F.lit(on_tie)).otherwise((F.col(score) - low) / spread))


def combsum(rankings: DataFrame, score: str, top_k: int | None = None, keys: tuple = ("fact_id",)) -> DataFrame:
    scaled = minmax(rankings, [*keys, "list_id"], score, 1.0, "scaled")
    sums = scaled.groupBy(*keys, "tag").agg(F.sum("scaled").alias("fused_score"), F.min("list_id").alias("first_list"))
    return ranked(sums, list(keys), [high("fused_score"), F.asc("first_list"), F.asc("tag")], top_k)


def selection_union(rankings: DataFrame, keys: tuple = ("fact_id",)) -> DataFrame:
    """rankings with `selected`: the selected list in order, then unseen tags by their best rank elsewhere."""
    best = rankings.groupBy(*keys, "tag").agg(
        F.min(F.when(F.col("selected"), F.col("rank"))).alias("own_rank"),
        F.min(F.when(~F.col("selected"), F.col("rank"))).alias("other_rank"),
    )
    return ranked(best, list(keys), [F.asc_nulls_last("own_rank"), F.asc("other_rank"), F.asc("tag")])


def ordered_union(rankings: DataFrame, top_k: int | None = None, keys: tuple = ("fact_id",)) -> DataFrame:
    """Tags in order of first appearance over the lists."""
    first = rankings.groupBy(*keys, "tag").agg(F.min(F.struct("list_id", "rank")).alias("first"))
    return ranked(first, list(keys), [F.asc("first"), F.asc("tag")], top_k)


def truncate_pool(scores: DataFrame, top_k: int, keys: tuple = ("fact_id",)) -> DataFrame:
    return ranked(scores, list(keys), pool_order(), top_k, "pool_rank")


def composite(model_order: DataFrame, candidates: DataFrame) -> DataFrame:
    """Tags the model listed (first mention counts, strangers ignored), then the remaining candidates by rank."""
    first = model_order.groupBy("fact_id", "tag").agg(F.min("pos").alias("model_pos"))
    joined = candidates.join(first, ["fact_id", "tag"], "left")
    return ranked(joined.withColumnRenamed("rank", "old_rank"), ["fact_id"],
                  [F.asc_nulls_last("model_pos"), F.asc("old_rank"), F.asc("tag")])


def candidate_pool(rankings: DataFrame, finals: DataFrame, payload: list[str]) -> DataFrame:
    """One payload per (fact, tag): the first list that has it, round lists before the final list."""
    keep = ["fact_id", "tag", "list_id", "rank", *payload]
    both = rankings.select(*keep, F.lit(0).alias("tier")).unionByName(finals.select(*keep, F.lit(1).alias("tier")))
    first = F.struct("tier", "list_id", "rank")
    return both.groupBy("fact_id", "tag").agg(*[F.min_by(F.col(c), first).alias(c) for c in payload])


def rebuild(ranking: DataFrame, pool: DataFrame, gold: DataFrame, top_k: int) -> DataFrame:
    """Drop tags without payload, renumber, cut at k; per fact the drops, whether the order changed, the gold rank.

    ranking(fact_id, rank, tag, old_rank): new order and the order it replaces.
    """
    marked = ranking.join(pool.select("fact_id", "tag", F.lit(True).alias("has_payload")), ["fact_id", "tag"], "left")
    dropped = marked.groupBy("fact_id").agg(F.count_if(F.col("has_payload").isNull()).alias("n_dropped"))
    kept = ranked(marked.where("has_payload").drop("rank").withColumn("order_key", F.col("new_rank")), ["fact_id"],
                  [F.asc("order_key")], top_k)
    old = ranked(marked.where("has_payload"), ["fact_id"], [F.asc("old_rank")], None, "old_pos").select(
        "fact_id", "tag", "old_pos")
    flagged = kept.join(old, ["fact_id", "tag"]).join(
        gold.select("fact_id", "tag", F.lit(True).alias("is_gold")), ["fact_id", "tag"], "left")
    summary = flagged.groupBy("fact_id").agg(
        F.count(F.lit(1)).alias("n_kept"), F.max(F.col("rank") != F.col("old_pos")).alias("order_changed"),
        F.min(F.when(F.col("is_gold"), F.col("rank"))).alias("gold_rank"))
    return dropped.join(summary, "fact_id", "left")


# Which lists a query mode fuses, and in which stages.
ONE_STAGE = "one_stage"
PER_HYPOTHESIS = "per_hypothesis"
MODES = {
    "direct_retrieval": ("single", ONE_STAGE), "one_pass_grounding": ("single", ONE_STAGE),
    "parallel_sampling": ("def", ONE_STAGE), "decomposed_retrieval": ("def", ONE_STAGE),
    "intrinsic_self_refinement": ("def", ONE_STAGE), "retrieval_feedback_refinement": ("def", ONE_STAGE),
    "parallel_sampling_diversity": ("dual", PER_HYPOTHESIS), "bandit_freeform": ("dual", PER_HYPOTHESIS),
    "frozen_hypotheses": ("dual", ONE_STAGE), "sequential_rounds": ("dual", ONE_STAGE),
}


def fuse_mode(rankings: DataFrame, mode: str, top_k: int, kappa: float = 60.0) -> DataFrame:
    """Final ranking of a query mode from its logged lists (fact_id, hyp_idx, rendering, list_id, rank, tag)."""
    lists, stages = MODES[mode]
    chosen = rankings
    if lists == "single":
        chosen = rankings.where((F.col("hyp_idx") == 0) & (F.col("rendering") == "def"))
    elif lists == "def":
        chosen = rankings.where(F.col("rendering") == "def")
    if stages == PER_HYPOTHESIS:
        inner = fuse(chosen, top_k, kappa, keys=("fact_id", "hyp_idx"))
        chosen = inner.select("fact_id", F.col("hyp_idx").alias("list_id"), "rank", "tag")
    return fuse(chosen, top_k, kappa)
