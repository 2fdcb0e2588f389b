"""Analytics over the logged rounds of a fact."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evirank.functions.text import token_set, truncate_middle
from evirank.session import checkpointed


def cue_features(rows: DataFrame, text: str, modality: Column, cues: dict[str, list[str]]) -> DataFrame:
    """0/1 flags of the evidence text: modality, distinct-token bands, and one flag per cue list."""
    def flag(condition: Column) -> Column:
        return F.coalesce(condition, F.lit(False)).cast("double")

    toks = rows.withColumn("_tokens", token_set(text))
    flags = {
        "is_table": flag(modality == "table"),
        "is_text": flag(modality == "text"),
        "token_count_lt_12": flag(F.size("_tokens") < 12),
        "token_count_gt_30": flag(F.size("_tokens") > 30),
    }
    for name, words in cues.items():
        flags[name] = flag(F.arrays_overlap("_tokens", F.array(*map(F.lit, words))))
    return toks.withColumns(flags).drop("_tokens")


def evidence_profile(limit: int) -> Column:
    """Modality, datatype, which contexts are present, and the shortened contexts themselves."""
    def present(name: str) -> Column:
        return F.coalesce(F.col(name), F.lit("")) != ""

    return F.struct(
        F.col("input_type"), F.col("entity_type").alias("datatype"),
        present("row_context").alias("has_row_context"), present("column_context").alias("has_column_context"),
        truncate_middle("row_context", limit).alias("row_context"),
        truncate_middle("column_context", limit).alias("column_context"),
        truncate_middle("query_context", limit).alias("query_context"),
    )


#: Queries, and memories, of a pool that one task compares, on average at most.
MEMORY_BLOCK = 16384


# A fact has at most as many rounds as its search budget, so windows over a fact stay small.
def by_fact():
    return Window.partitionBy("fact_id").orderBy("round_idx")



# The operator that edits each dimension, and the order in which modes claim an operator.
DIMENSION_OPERATOR = {
    "FAMILY": "O_refine_family", "ROLE": "O_refine_role", "EVENT": "O_refine_event", "QUALIFIER": "O_refine_qualifier",
    "SCOPE": "O_refine_scope", "TEMPORAL": "O_refine_temporal",
}
CHANGE_STRATEGY_OPERATOR = "O_change_strategy"
PERTURB_OPERATOR = "O_perturb"
MODE_PRIORITY = {"REFINE": 0, "CHANGE_STRATEGY": 1, "BRANCH": 2, "PERTURB": 3}


def novelty(rounds: DataFrame, items: str) -> DataFrame:
    """1 minus the largest Jaccard overlap with an earlier round's set; 1 without earlier rounds or items."""
    previous = F.collect_list(items).over(by_fact().rowsBetween(Window.unboundedPreceding, -1))
    def overlap(other: Column) -> Column:
        return F.coalesce(F.try_divide(F.size(F.array_intersect(F.col(items), other)), F.size(F.array_union(F.col(items), other))), F.lit(0.0))

    worst = F.array_max(F.transform("_previous", overlap))
    rows = rounds.withColumn("_previous", previous)
    blank = (F.size(items) == 0) | (F.size("_previous") == 0)
    return rows.withColumn("novelty", F.when(blank, 1.0).otherwise(F.round(1.0 - worst, 6))).drop("_previous")


def nearest_memories(queries: DataFrame, memories: DataFrame, k: int) -> DataFrame:
    """Top k memories per query and sign by token overlap, from the same modality and type but another source.

    A query without any compatible memory falls back to its modality alone. Every query of a pool is compared with every memory of
    it, as an exact search over common words has to; the pool is cut into blocks of both, a task holds one block of each, and only
    the best k of a block leave it, so no pair is ever shuffled.
    queries(query_id, source, modality, datatype, tokens), memories(memory_id, source, modality, datatype, positive, tokens)
    """
    strict = F.concat_ws("|", F.lit("s"), "modality", "datatype")
    loose = F.concat_ws("|", F.lit("l"), "modality")
    per_source = memories.groupBy(strict.alias("pool"), F.col("source").alias("own")).agg(F.count(F.lit(1)).alias("n_own"))
    totals = per_source.groupBy("pool").agg(F.sum("n_own").alias("n_all"))
    sized = queries.withColumn("pool", strict).join(totals, "pool", "left").join(
        per_source.withColumnRenamed("own", "source"), ["pool", "source"], "left")
    others = F.coalesce("n_all", F.lit(0)) - F.coalesce("n_own", F.lit(0))
    asked = checkpointed(sized.select("query_id", F.col("source").alias("q_source"), F.when(others > 0, F.col("pool")).otherwise(loose).alias("pool"),
                                      F.col("tokens").alias("q_tokens")).where("q_source IS NOT NULL"))
    known = checkpointed(memories.select("memory_id", "source", "positive", F.explode(F.array(strict, loose)).alias("pool"), "tokens").where("source IS NOT NULL"))

    def blocks(rows: DataFrame, name: str) -> DataFrame:
        return rows.groupBy("pool").agg(F.ceil(F.count(F.lit(1)) / MEMORY_BLOCK).alias(name))

    def dealt(rows: DataFrame, key: str, own: str, other: str) -> DataFrame:
        """Each row in one block of its side and beside every block of the other. One row per pool holds the numbers of blocks."""
        cells = rows.join(F.broadcast(cut), "pool").withColumn(own, F.pmod(F.xxhash64(key), F.col(f"n_{own}")))
        return cells.withColumn(other, F.explode(F.sequence(F.lit(0).cast("bigint"), F.col(f"n_{other}") - 1))).drop("n_qb", "n_mb")

    cut = checkpointed(blocks(asked, "n_qb").join(blocks(known, "n_mb"), "pool"))
    cell = ["pool", "qb", "mb"]
    kinds = {**dict(asked.dtypes), **dict(known.dtypes)}
    schema = ", ".join(f"{c} {kinds[c]}" for c in ("query_id", "memory_id", "positive")) + ", similarity double"
    left, right = dealt(asked, "query_id", "qb", "mb"), dealt(known, "memory_id", "mb", "qb")
    best = left.groupBy(*cell).cogroup(right.groupBy(*cell)).applyInArrow(lambda q, m: _nearest_in_block(q, m, k), schema)
    window = Window.partitionBy("query_id", "positive").orderBy(F.desc(F.round("similarity", 10)), F.asc("memory_id"))
    return best.withColumn("place", F.row_number().over(window)).where(F.col("place") <= k)


def _nearest_in_block(queries: pa.Table, memories: pa.Table, k: int) -> pa.Table:
    """The best k memories of the block per query and sign: overlaps are counted along the postings of the query's tokens."""
    memories = memories.sort_by("memory_id")
    tokens = memories["tokens"].combine_chunks()
    words = tokens.flatten().dictionary_encode()
    sizes = np.nan_to_num(pc.list_value_length(tokens).to_numpy(zero_copy_only=False)).astype(np.int64)
    codes = words.indices.to_numpy()
    postings = np.repeat(np.arange(len(sizes)), sizes)[np.argsort(codes, kind="stable")]
    starts = np.concatenate([[0], np.cumsum(np.bincount(codes, minlength=len(words.dictionary)))])
    asked = queries["q_tokens"].combine_chunks()
    found = pc.index_in(asked.flatten(), value_set=words.dictionary).to_pylist()
    ends = np.cumsum(np.nan_to_num(pc.list_value_length(asked).to_numpy(zero_copy_only=False)).astype(np.int64)).tolist()
    sources, own = memories["source"].to_numpy(), queries["q_source"].to_numpy()
    signs = np.array([-1 if p is None else int(p) for p in memories["positive"].to_pylist()])
    sides = [np.flatnonzero(signs == s) for s in np.unique(signs)]
    later = np.arange(len(sizes))[::-1]
    rows, picked, similarity, begin = [], [], [], 0
    for i, end in enumerate(ends):
        lists = [postings[starts[w]:starts[w + 1]] for w in found[begin:end] if w is not None]
        shared = np.bincount(np.concatenate(lists), minlength=len(sizes)) if lists else np.zeros(len(sizes), np.int64)
        score = np.where(shared > 0, shared / np.maximum(end - begin + sizes - shared, 1), 0.0)
        # ten digits of the score, then the smaller id, in one number
        order = np.where(sources == own[i], -1, np.floor(score * 1e10 + 0.5).astype(np.int64) * len(sizes) + later)
        for side in sides:
            top = side[np.argpartition(-order[side], k)[:k]] if len(side) > k else side
            top = top[order[top] >= 0]
            rows.append(np.full(len(top), i)), picked.append(top), similarity.append(score[top])
        begin = end
    if not rows:
        rows = picked = similarity = [np.zeros(0, np.int64)]
    taken = memories.take(pa.array(np.concatenate(picked)))
    return pa.table({"query_id": queries["query_id"].take(pa.array(np.concatenate(rows))), "memory_id": taken["memory_id"],
                     "positive": taken["positive"], "similarity": pa.array(np.concatenate(similarity), pa.float64())})


def utility(rank) -> Column:
    return F.when(F.col(rank) > 0, 1.0 / F.log2(F.col(rank) + 1.0)).otherwise(F.lit(0.0))


def rewards(rounds: DataFrame, alpha: float) -> DataFrame:
    """Gain over the previous round mixed with the gain over the replayed alternative (rank, replay_rank)."""
    rows = rounds.withColumns({"u": utility("rank"), "u_replay": utility("replay_rank")})
    before = F.coalesce(F.lag("u").over(by_fact()), F.lit(0.0))
    rows = rows.withColumn("delta", F.col("u") - before)
    return rows.withColumn("reward", alpha * F.col("delta") + (1 - alpha) * (F.col("u") - F.col("u_replay")))


def transitions(rounds: DataFrame) -> DataFrame:
    """Consecutive rounds as before/after pairs with the reward change and a search text."""
    rows = rounds.select(
        "*", F.lag("operator").over(by_fact()).alias("before_operator"), F.lag("reward").over(by_fact()).alias("before_reward"))
    text = F.concat_ws(" ", F.col("before_operator"), F.lit("->"), F.col("operator"), F.col("modality"))
    return rows.where(F.col("before_operator").isNotNull()).withColumns({
        "reward_change": F.col("reward") - F.col("before_reward"), "search_text": text})


def recall_curve(rounds: DataFrame, budget: int, depth: int) -> DataFrame:
    """Hit at `depth` after each of `budget` rounds, the last value carried forward; one row per (fact, round)."""
    hits = rounds.where(F.col("round_idx") <= budget).select(
        "fact_id", "round_idx", F.coalesce((F.col("rank") <= depth).cast("double"), F.lit(0.0)).alias("hit"))
    grid = rounds.select("fact_id").distinct().withColumn("round_idx", F.explode(F.sequence(F.lit(1), F.lit(budget))))
    upto = by_fact().rowsBetween(Window.unboundedPreceding, 0)
    return grid.join(hits, ["fact_id", "round_idx"], "left").select(
        "fact_id", "round_idx", F.last("hit", ignorenulls=True).over(upto).alias("recall"))


def learning_area(curve: DataFrame) -> DataFrame:
    return curve.groupBy("fact_id").agg(F.avg("recall").alias("aulc"))


def arm_summary(facts: DataFrame) -> DataFrame:
    """facts(arm, context_id, final_hit, round1_hit, aulc, realized_rounds, stop_reason, parity_ok)."""
    reasons = facts.groupBy("arm", "stop_reason").agg(F.count(F.lit(1)).alias("n"))
    reasons = reasons.groupBy("arm").agg(F.to_json(F.map_from_entries(F.array_sort(F.collect_list(F.struct("stop_reason", "n"))))).alias("stop_reasons"))
    main = facts.groupBy("arm").agg(
        F.count(F.lit(1)).alias("facts"), F.countDistinct("context_id").alias("contexts"),
        F.round(F.avg("final_hit"), 6).alias("full_recall"), F.round(F.avg("round1_hit"), 6).alias("round1_recall"),
        F.round(F.avg("final_hit") - F.avg("round1_hit"), 6).alias("full_minus_round1"),
        F.round(F.avg("realized_rounds"), 6).alias("realized_rounds_mean"), F.max("realized_rounds").alias("realized_rounds_max"),
        F.round(F.avg("aulc"), 6).alias("aulc"), F.count_if(~F.col("parity_ok")).alias("parity_failures"))
    return main.join(reasons, "arm")


def parity(left: DataFrame, right: DataFrame) -> DataFrame:
    """Do two pipelines order a fact's tags alike; the first rank at which they part."""
    joined = left.select("fact_id", "rank", F.col("tag").alias("a")).join(
        right.select("fact_id", "rank", F.col("tag").alias("b")), ["fact_id", "rank"], "full")
    differs = ~F.col("a").eqNullSafe(F.col("b"))
    return joined.groupBy("fact_id").agg(
        (~F.max(differs)).alias("parity_ok"), F.min(F.when(differs, F.col("rank"))).alias("first_divergence"))


def context_features(modality: str, datatype: str, n_support: str, n_against: str, n_open: str, mismatch: str, novelty: str) -> Column:
    """Symbolic features of a round as a double array: no gold, no candidate identities."""
    kind = F.lower(F.coalesce(datatype, F.lit("")))

    def flag(c: Column) -> Column:
        return F.when(c, 1.0).otherwise(0.0)

    return F.array(
        F.lit(1.0), flag(F.col(modality) == "table"), flag(F.col(modality) == "text"), flag(kind.contains("monetary")),
        flag(kind.contains("share")), flag(kind.contains("percent") | kind.contains("pure")), F.col(n_support).cast("double"),
        F.col(n_against).cast("double"), F.col(n_open).cast("double"), flag(F.col(mismatch)), F.col(novelty).cast("double"))


def admissible_slate(states: DataFrame, limit: int) -> DataFrame:
    """states(fact_id, contradicted, open, supported arrays of dimensions, mismatch): at most `limit` directives,
    one per operator by mode priority; the perturbation always stays."""
    def proposal(mode: str, operator: str, target: str, when: Column) -> Column:
        return F.when(when, F.struct(F.lit(MODE_PRIORITY[mode]).alias("priority"), F.lit(mode).alias("mode"),
                                     F.lit(operator).alias("operator"), F.lit(target).alias("target")))

    cells = [proposal("REFINE", DIMENSION_OPERATOR[d], d, F.array_contains("contradicted", d)) for d in DIMENSION_OPERATOR]
    cells += [proposal("CHANGE_STRATEGY", CHANGE_STRATEGY_OPERATOR, "", F.col("mismatch"))]
    cells += [proposal("BRANCH", DIMENSION_OPERATOR[d], d, F.array_contains("open", d) & ~F.array_contains("contradicted", d))
              for d in DIMENSION_OPERATOR]
    cells += [proposal("PERTURB", PERTURB_OPERATOR, "", F.lit(True))]
    listed = states.select("fact_id", "supported", F.posexplode(F.array(*cells)).alias("order", "p")).where(F.col("p").isNotNull()).select(
        "fact_id", "order", F.array_join("supported", ",").alias("preserve"), "p.*")
    one = Window.partitionBy("fact_id", "operator").orderBy("priority", "order")
    claimed = listed.withColumn("claim", F.row_number().over(one)).where("claim = 1")
    slots = Window.partitionBy("fact_id").orderBy("priority", "order")
    numbered = claimed.withColumns({"slot": F.row_number().over(slots), "size": F.count(F.lit(1)).over(Window.partitionBy("fact_id"))})
    last = (F.col("operator") == PERTURB_OPERATOR) & (F.col("size") > limit)
    kept = numbered.where(last | (F.col("slot") < limit) | ((F.col("slot") == limit) & (F.col("size") <= limit)))
    return kept.withColumn("slot", F.when(last, F.lit(limit)).otherwise(F.col("slot"))).drop("claim", "size", "order", "priority")


def enforce_directive(rows: DataFrame, dims: list[str]) -> DataFrame:
    """rows(before, after map, mode, target, preserve array): only authorised dimensions move; the others are put back."""
    mode = F.col("mode")

    def allowed(d: str) -> Column:
        one = mode.isin("REFINE", "BRANCH") & (F.upper(F.trim("target")) == d)
        return one | ((mode == "CHANGE_STRATEGY") & ~F.array_contains("preserve", d))

    before = {d: F.coalesce(F.col("before")[d], F.lit("UNRESOLVED")) for d in dims}
    after = {d: F.coalesce(F.col("after")[d], before[d]) for d in dims}
    moved = [F.when(~allowed(d) & (F.trim(after[d]) != F.trim(before[d])), F.lit(d)) for d in dims]
    entries = [x for d in dims for x in (F.lit(d), F.when(allowed(d), after[d]).otherwise(before[d]))]
    return rows.withColumns({"enforced": F.create_map(*entries), "reverted": F.array_compact(F.array(*moved))})


def decayed_moments(rounds: DataFrame, dim: int, zeta: float, last_step) -> DataFrame:
    """Per (operator, context): discounted sums of psi psi' (cells a_ij) and r psi (cells b_i), pre-aggregated by Spark.

    rounds(operator, context_id, step, psi, reward); `last_step` is a one-row frame with the current step.
    """
    rows = rounds.crossJoin(last_step) if isinstance(last_step, DataFrame) else rounds.withColumn("now", F.lit(last_step))
    weight = F.pow(F.lit(zeta), (F.col("now") - F.col("step")).cast("double"))
    psi = F.col("psi")
    a = [F.sum(weight * psi[i] * psi[j]).alias(f"a_{i}_{j}") for i in range(dim) for j in range(i, dim)]
    b = [F.sum(weight * psi[i] * F.col("reward")).alias(f"b_{i}") for i in range(dim)]
    return rows.groupBy("operator", "context_id").agg(F.count(F.lit(1)).alias("n"), *a, *b)


def leave_one_context_out(moments: DataFrame) -> DataFrame:
    """Totals per operator minus each context's own part."""
    names = [c for c in moments.columns if c not in ("operator", "context_id")]
    totals = moments.groupBy("operator").agg(*[F.sum(c).alias(f"t_{c}") for c in names])
    return moments.join(totals, "operator").select(
        "operator", "context_id", *[(F.col(f"t_{c}") - F.col(c)).alias(c) for c in names])


def posterior_means(moments: DataFrame, dim: int, ridge: float) -> DataFrame:
    """mu = (ridge I + A)^-1 b for each row of moments, by elimination on columns: the matrix is symmetric and positive, so no
    pivot is zero and rows need not be swapped."""
    a = {(i, j): F.col(f"a_{min(i, j)}_{max(i, j)}") + (ridge if i == j else 0.0) for i in range(dim) for j in range(dim)}
    names = {(i, j): f"_m_{i}_{j}" for i in range(dim) for j in range(dim)} | {(i, dim): f"_m_{i}_b" for i in range(dim)}
    rows = moments.withColumns({names[i, j]: a[i, j] for i in range(dim) for j in range(dim)} | {names[i, dim]: F.col(f"b_{i}").cast("double") for i in range(dim)})
    for k in range(dim):  # clear column k in every other row
        factor = {i: F.col(names[i, k]) / F.col(names[k, k]) for i in range(dim) if i != k}
        rows = rows.withColumns({names[i, j]: F.col(names[i, j]) - f * F.col(names[k, j]) for i, f in factor.items() for j in range(k + 1, dim + 1)})
    mu = F.array(*[F.col(names[i, dim]) / F.col(names[i, i]) for i in range(dim)])
    return rows.select("operator", "context_id", "n", mu.alias("mu"))


def diagonal_statistics(rounds: DataFrame, ridge: float) -> DataFrame:
    """Per (arm, feature): a = ridge + sum x^2, b = sum r x, mu = b / a."""
    cells = rounds.select("arm", "reward", F.posexplode("psi").alias("feature", "x"))
    sums = cells.groupBy("arm", "feature").agg(
        (F.sum(F.col("x") * F.col("x")) + ridge).alias("a"), F.sum(F.col("reward") * F.col("x")).alias("b"))
    return sums.withColumn("mu", F.col("b") / F.col("a"))
