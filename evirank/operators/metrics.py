"""Gold ranks, per-fact metrics, slices and audits.

gold(fact_id, tag) is a long table, so a fact may have any number of gold tags.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def gold_ranks(rankings: DataFrame, gold: DataFrame, keys: list[str]) -> DataFrame:
    """Smallest rank of a gold tag per key; null when the list holds none. A fact's gold tags meet its rows as one list, so these stay by fact."""
    tags = gold.groupBy("fact_id").agg(F.collect_set("tag").alias("_gold"))
    rows = rankings.join(tags, "fact_id", "left")
    return rows.groupBy(*keys).agg(F.min(F.when(F.array_contains("_gold", F.col("tag")), F.col("rank"))).alias("gold_rank"))


def first_gold(rows: DataFrame, gold: DataFrame, ranks: dict[str, str], depth: int) -> DataFrame:
    """Per fact and rank column, under its name in `ranks`: the smallest rank of a gold tag, null beyond `depth`. All columns in one pass."""
    tags = gold.groupBy("fact_id").agg(F.collect_set("tag").alias("_gold"))
    found = rows.join(tags, "fact_id").where(F.array_contains("_gold", F.col("tag")))
    return found.groupBy("fact_id").agg(*[F.min(F.when(F.col(c) <= depth, F.col(c))).alias(n) for c, n in ranks.items()])


def metric_columns(depths: list[int], cap: int | None = None) -> dict[str, Column]:
    """Columns over gold_rank; with a cap, ranks beyond it count as not found."""
    rank = F.col("gold_rank") if cap is None else F.when(F.col("gold_rank") <= cap, F.col("gold_rank"))
    found = {f"recall_at_{k}": F.coalesce((rank <= k).cast("double"), F.lit(0.0)) for k in depths}
    return {
        "mrr": F.coalesce(1.0 / rank, F.lit(0.0)),
        "accuracy": F.coalesce((rank == 1).cast("double"), F.lit(0.0)),
        **found,
    }


def fact_metrics(facts: DataFrame, ranks: DataFrame, depths: list[int]) -> DataFrame:
    """One row per fact (and config, when ranks carry one); facts without a ranking score zero."""
    return facts.join(ranks, "fact_id", "left").withColumns(metric_columns(depths))


def slices(metrics: DataFrame, names: list[str], by: list[str], keep: list[str] = (), digits: int = 6) -> DataFrame:
    """Means pooled and per slice in one pass; fractional rows are averaged as they are.

    `by` columns get the value "pooled" on the grouping-set row that covers everything.
    """
    sets = [[*keep, *by], list(keep)] if by else [list(keep)]
    aggs = [F.round(F.avg(F.col(n).cast("double")), digits).alias(n) for n in names]
    grouped = metrics.groupingSets([[F.col(c) for c in s] for s in sets], *[F.col(c) for c in [*keep, *by]]).agg(
        F.grouping_id().alias("_gid"), F.count(F.lit(1)).alias("n"),
        F.countDistinct("context_id").alias("n_contexts"), *aggs)
    pooled = {c: F.when(F.col("_gid") != 0, F.lit("pooled")).otherwise(F.col(c)) for c in by}
    return grouped.withColumns(pooled).drop("_gid")


def gold_coverage(facts: DataFrame, gold: DataFrame, concepts: DataFrame, rankings: DataFrame) -> DataFrame:
    """Per fact: is every gold tag a concept, and is any gold tag in the ranking."""
    known = gold.join(concepts.select("tag", F.lit(True).alias("known")).distinct(), "tag", "left")
    in_taxonomy = known.groupBy("fact_id").agg(F.bool_and(F.coalesce("known", F.lit(False))).alias("gold_in_taxonomy"))
    found = gold_ranks(rankings, gold, ["fact_id"])
    return (
        facts.join(in_taxonomy, "fact_id", "left").join(found, "fact_id", "left")
        .withColumn("gold_in_taxonomy", F.coalesce("gold_in_taxonomy", F.lit(False)).cast("double"))
        .withColumn("search_coverage", F.col("gold_rank").isNotNull().cast("double"))
    )


def at_depths(rows: DataFrame, depths: list[int]) -> DataFrame:
    return rows.withColumn("depth", F.explode(F.array(*map(F.lit, depths))))


def rendering_metrics(rankings: DataFrame, gold: DataFrame, fused: DataFrame, depths: list[int]) -> DataFrame:
    """Per (fact, rendering, depth): first-hypothesis, union and fused hits with reciprocal ranks."""
    lists = gold_ranks(rankings, gold, ["fact_id", "rendering", "hyp_idx"])
    per_fact = lists.groupBy("fact_id", "rendering").agg(
        F.min_by("gold_rank", "hyp_idx").alias("hyp1_rank"), F.min("gold_rank").alias("union_rank"),
        F.count(F.lit(1)).alias("n_lists"))
    joined = per_fact.join(
        gold_ranks(fused, gold, ["fact_id", "rendering"]).withColumnRenamed("gold_rank", "rrf_rank"),
        ["fact_id", "rendering"])
    out = at_depths(joined, depths)

    def hit(name: str) -> Column:
        return F.coalesce(F.col(name) <= F.col("depth"), F.lit(False))

    def reciprocal(name: str) -> Column:
        return F.when(hit(name), 1.0 / F.col(name)).otherwise(F.lit(0.0))

    return out.withColumns({
        "hyp1_recall": hit("hyp1_rank").cast("double"), "hyp1_mrr": reciprocal("hyp1_rank"),
        "coverage": hit("union_rank").cast("double"), "rrf_recall": hit("rrf_rank").cast("double"),
        "rrf_mrr": reciprocal("rrf_rank"),
    })


def marginal_coverage(rankings: DataFrame, gold: DataFrame, depths: list[int]) -> DataFrame:
    """Does the union of the first j lists hold a gold tag at each depth; one row per (fact, depth, j)."""
    ranks = at_depths(gold_ranks(rankings, gold, ["fact_id", "list_id"]), depths)
    hit = F.coalesce(F.col("gold_rank") <= F.col("depth"), F.lit(False)).cast("int")
    window = Window.partitionBy("fact_id", "depth").orderBy("list_id")
    return ranks.select(
        "fact_id", "depth", F.row_number().over(window).alias("j"),
        F.max(hit).over(window.rowsBetween(Window.unboundedPreceding, 0)).alias("covered"))


def mean_pairwise_jaccard(rankings: DataFrame, depth: int) -> DataFrame:
    """Mean overlap over all list pairs of a fact; null with one list. A fact has a handful of lists."""
    sets = rankings.where(F.col("rank") <= depth).groupBy("fact_id", "list_id").agg(F.collect_set("tag").alias("tags"))
    left, right = sets.alias("a"), sets.alias("b")
    pairs = left.join(right, (F.col("a.fact_id") == F.col("b.fact_id")) & (F.col("a.list_id") < F.col("b.list_id")))
    overlap = F.size(F.array_intersect("a.tags", "b.tags")) / F.size(F.array_union("a.tags", "b.tags"))
    means = pairs.groupBy(F.col("a.fact_id").alias("fact_id")).agg(F.avg(overlap).alias("mean_jaccard"))
    return sets.groupBy("fact_id").agg(F.count(F.lit(1)).alias("n_lists")).join(means, "fact_id", "left")


def collapse_flag(jaccards: DataFrame, threshold: float) -> DataFrame:
    mean = F.avg("mean_jaccard")
    return jaccards.agg(F.round(mean, 6).alias("mean_jaccard"), (mean > threshold).alias("collapsed"),
                        F.count("mean_jaccard").alias("n_facts"))


def gap_to_ceiling(rows: DataFrame, ceiling: str, score: str, by: list[str]) -> DataFrame:
    """Distance of each config to the ceiling config of the same slice."""
    top = rows.where(F.col("config") == ceiling).select(*by, F.col(score).alias("ceiling"))
    gap = F.when(F.col("config") == ceiling, F.lit(0.0)).otherwise(F.round(F.col("ceiling") - F.col(score), 6))
    return rows.join(top, by, "left").withColumn("residual_gap", F.coalesce(gap, F.lit(0.0))).drop("ceiling")


def best_config(rows: DataFrame, order: list[Column]) -> DataFrame:
    """The config with the largest key; one row."""
    return rows.agg(F.max_by("config", F.struct(*order)).alias("winner"))


def ensemble_mean(left: DataFrame, right: DataFrame, names: list[str]) -> DataFrame:
    """Per-fact mean of two configs' metrics; facts both have."""
    other = right.select("fact_id", *[F.col(n).alias(f"_{n}") for n in names])
    return left.join(other, "fact_id").withColumns({n: (F.col(n) + F.col(f"_{n}")) / 2 for n in names}).drop(
        *[f"_{n}" for n in names])


def top_score_list(rankings: DataFrame, score: Column, m: int) -> DataFrame:
    """List with the largest mean score over its first m candidates; the lower index wins a tie."""
    means = rankings.where(F.col("rank") <= m).groupBy("fact_id", "list_id").agg(F.round(F.avg(score), 10).alias("mean_score"))
    return means.groupBy("fact_id").agg(
        F.max_by("list_id", F.struct("mean_score", -F.col("list_id"))).alias("carried_list"),
        F.max("mean_score").alias("mean_score"))


def usage_totals(calls: DataFrame, by: list[str], token_cap: int) -> DataFrame:
    return calls.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n_calls"), F.sum("prompt_tokens").alias("prompt_tokens"),
        F.sum("completion_tokens").alias("completion_tokens"),
        F.avg(F.col("parse_ok").cast("double")).alias("parse_rate"),
        F.avg((F.col("completion_tokens") >= token_cap).cast("double")).alias("cap_share"))


def firing_rate(verdicts: DataFrame) -> DataFrame:
    return verdicts.groupBy("dim").agg(
        F.count(F.lit(1)).alias("opportunities"), F.count("matched").alias("fired"),
        (F.count("matched") / F.count(F.lit(1))).alias("firing_rate"))


def audit_equal(left: DataFrame, right: DataFrame, keys: list[str], names: list[str], tolerance: float = 1e-6) -> DataFrame:
    """Metrics of two result sets that differ; a key missing on one side differs in every metric."""
    def long(df: DataFrame, value: str) -> DataFrame:
        return df.select(*keys, *[F.col(n).cast("double").alias(n) for n in names]).unpivot(keys, names, "metric", value)

    joined = long(left, "left_value").join(long(right, "right_value"), [*keys, "metric"], "full")
    same = F.abs(F.col("left_value") - F.col("right_value")) <= tolerance
    return joined.where(~F.coalesce(same, F.col("left_value").isNull() & F.col("right_value").isNull()))


def order_audit(left: DataFrame, right: DataFrame) -> DataFrame:
    """Two rankings of the same facts: same candidates, same order; facts that one side lacks differ."""
    joined = left.select("fact_id", "tag", F.col("rank").alias("l")).join(
        right.select("fact_id", "tag", F.col("rank").alias("r")), ["fact_id", "tag"], "full")
    per_fact = joined.groupBy("fact_id").agg(
        F.bool_and(F.col("l").isNotNull() & F.col("r").isNotNull()).alias("same_set"),
        F.bool_and(F.coalesce(F.col("l") == F.col("r"), F.lit(False))).alias("same_order"))
    return per_fact.agg(
        F.count(F.lit(1)).alias("n_facts"), F.count_if(~F.col("same_set")).alias("set_differences"),
        F.count_if(F.col("same_set") & ~F.col("same_order")).alias("order_differences"))


def interaction_table(metrics: DataFrame, names: list[str]) -> DataFrame:
    """Verifier on/off against reranker on/off: one row per cell."""
    return metrics.groupBy("verifier", "reranker").agg(
        F.count(F.lit(1)).alias("n"), *[F.round(F.avg(n), 6).alias(n) for n in names])


def miss_summary(probe: DataFrame, facts: DataFrame) -> DataFrame:
    """Probe misses per slice with their share."""
    joined = facts.join(probe, "fact_id")
    miss = F.col("gold_rank").isNull().cast("double")
    return joined.groupBy("modality", "datatype").agg(
        F.count(F.lit(1)).alias("n"), F.sum(miss).cast("bigint").alias("misses"), F.avg(miss).alias("miss_rate"))


def common_misses(probe: DataFrame, gold: DataFrame, n: int = 25) -> DataFrame:
    missed = probe.where(F.col("gold_rank").isNull()).join(gold, "fact_id")
    return missed.groupBy("tag").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), F.asc("tag")).limit(n)


def stacked(frames: dict[str, DataFrame], name: str = "config") -> DataFrame:
    """Union of result frames, each labelled."""
    return reduce(DataFrame.unionByName, [df.withColumn(name, F.lit(label)) for label, df in frames.items()])


def initialisation(ranks: DataFrame, choice: DataFrame, fused: DataFrame, depth: int) -> DataFrame:
    """Recall of ways to start: first list, expected random list, the list each agreement layer selects, union fusion.

    ranks(fact_id, hyp_idx, gold_rank); choice carries selected_by_* flags per (fact_id, hyp_idx).
    """
    def hit(name: str = "gold_rank") -> Column:
        return F.coalesce((F.col(name) <= depth).cast("double"), F.lit(0.0))

    joined = ranks.join(choice.select("fact_id", "hyp_idx", "selected_by_overall", "selected_by_exact", "selected_by_lexical"),
                        ["fact_id", "hyp_idx"])
    own = joined.groupBy("fact_id").agg(
        F.min_by(hit(), "hyp_idx").alias("first"), F.avg(hit()).alias("random_one"),
        F.max(F.when(F.col("selected_by_overall"), hit())).alias("symbolic"),
        F.max(F.when(F.col("selected_by_exact"), hit())).alias("exact_only"),
        F.max(F.when(F.col("selected_by_lexical"), hit())).alias("lexical_only"))
    both = own.join(fused.select("fact_id", hit().alias("union_rrf")), "fact_id")
    names = ["first", "random_one", "symbolic", "exact_only", "lexical_only", "union_rrf"]
    return both.unpivot(["fact_id"], names, "config", "recall").groupBy("config").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.avg("recall"), 6).alias(f"recall_at_{depth}"))
