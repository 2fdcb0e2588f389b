"""Rerank terms from stored per-candidate verdicts, and the evaluation of a grid of configurations in one job.

  verdicts(fact_id, hyp_idx, tag, dim, matched)   long; matched null = the verifier abstained
  pairs(.., fact_id, hyp_idx, tag, m_<dim>, has_given, g_<dim>)   symbolic verdicts next to the stored ones
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evirank.domain import DIMENSIONS, DomainConfig
from evirank.operators import agree
from evirank.operators.fuse import final_order, pool_order, rerank_order, minmax, ranked
from evirank.session import looked_up

JUDGED_DIMENSIONS = [d.lower() for d in DIMENSIONS]
MODES = ["deterministic", "hybrid", "llm_drop", "llm_strict", "llm_neutral", "llm_varweight", "det_window"]
NEEDS_VERDICTS = set(MODES) - {"deterministic"}
# Modes that score every candidate, so nothing is left to fill.
SCORES_ALL = {"deterministic", "hybrid"}


def resolve_mode(mode: str, verdicts: DataFrame | None) -> str:
    """"auto" is hybrid when verdicts exist; a mode that needs verdicts never falls back silently."""
    if mode == "auto":
        return "deterministic" if verdicts is None else "hybrid"
    if mode not in MODES:
        raise ValueError(f"unknown verifier mode {mode!r}")
    if mode in NEEDS_VERDICTS and verdicts is None:
        raise ValueError(f"verifier mode {mode!r} needs verdicts")
    return mode


def wide_verdicts(verdicts: DataFrame) -> DataFrame:
    """One row per (fact, hypothesis, tag) with a column g_<dim>; a pair has at most one verdict per dimension."""
    cells = [F.max(F.when(F.lower("dim") == d, F.col("matched"))).alias(f"g_{d}") for d in JUDGED_DIMENSIONS]
    return verdicts.groupBy("fact_id", "hyp_idx", "tag").agg(F.lit(True).alias("has_given"), *cells)


def with_given(pairs: DataFrame, verdicts: DataFrame | None) -> DataFrame:
    if verdicts is None:
        return pairs.withColumns({c: F.lit(None).cast("boolean") for c in ["has_given"] + [f"g_{d}" for d in JUDGED_DIMENSIONS]})
    return looked_up(pairs, wide_verdicts(verdicts), ["hyp_idx", "tag"], ["has_given"] + [f"g_{d}" for d in JUDGED_DIMENSIONS])


def restrict_to_window(verdicts: DataFrame, windows: DataFrame, m: int) -> DataFrame:
    """Verdicts on the first m candidates of each call; windows(fact_id, hyp_idx, pos, tag)."""
    return verdicts.join(windows.where(F.col("pos") <= m), ["fact_id", "hyp_idx", "tag"], "left_semi")


def _weighted_mean(cells: list[tuple[Column, Column]]) -> Column:
    """Mean of (value, weight) cells over those with a value; null without any weight."""
    zero = F.lit(0.0)
    total = sum((F.when(v.isNotNull(), w).otherwise(zero) for v, w in cells), zero)
    won = sum((F.when(v, w).otherwise(zero) for v, w in cells), zero)
    return F.when(total > 0, won / total)


def _weight(weighted: bool, dim: str, default: float) -> Column:
    return F.coalesce(F.col(f"w_{dim}"), F.lit(default)) if weighted else F.lit(1.0)


def hybrid_score(weighted: bool = False) -> Column:
    """The stored verdict where it ruled on a resolved dimension, the symbolic one elsewhere; weights w_<dim> optional."""
    cells = []
    for d in agree.JUDGED:
        own = F.col(f"m_{d}")
        if d in JUDGED_DIMENSIONS:
            own = F.when(F.col(f"e_{d}").isNotNull(), F.coalesce(F.col(f"g_{d}"), own))
        cells.append((own, _weight(weighted and d in JUDGED_DIMENSIONS, d, 1.0)))
    return _weighted_mean(cells)


def verdict_score(abstention: str, weighted: bool = False) -> Column:
    """Score of the stored verdicts alone; null where no candidate was judged."""
    if abstention == "drop":
        score = _weighted_mean([(F.col(f"g_{d}"), _weight(weighted, d, 0.0)) for d in JUDGED_DIMENSIONS])
    else:
        other = F.lit({"negative": 0.0, "neutral": 0.5}[abstention])
        points = [F.coalesce(F.col(f"g_{d}").cast("double"), other) for d in JUDGED_DIMENSIONS]
        score = sum(points, F.lit(0.0)) / len(points)
    return F.when(F.col("has_given"), score)


def variance_weights(verdicts: DataFrame) -> DataFrame:
    """Per (fact, hypothesis): a dimension weighs its population variance over the window, 1 each if all are 0."""
    def own(d: str) -> Column:
        return F.when(F.lower("dim") == d, F.col("matched").cast("double"))

    spread = verdicts.groupBy("fact_id", "hyp_idx").agg(*[
        F.when(F.count(own(d)) > 1, F.var_pop(own(d))).otherwise(F.lit(0.0)).alias(f"v_{d}") for d in JUDGED_DIMENSIONS])
    top = F.greatest(*[F.col(f"v_{d}") for d in JUDGED_DIMENSIONS])
    return spread.select("fact_id", "hyp_idx", *[
        F.when(top > 0, F.col(f"v_{d}")).otherwise(F.lit(1.0)).alias(f"w_{d}") for d in JUDGED_DIMENSIONS])


def contradicted_weights(feedback: DataFrame, weight: float) -> DataFrame:
    """w_<dim> per (fact, hypothesis): contradicted dimensions count `weight`, the others 1."""
    def own(d: str) -> Column:
        return F.max(F.when((F.col("dim") == d) & (F.col("verdict") == "contradict"), F.lit(weight)))

    return feedback.groupBy("fact_id", "hyp_idx").agg(*[F.coalesce(own(d), F.lit(1.0)).alias(f"w_{d}") for d in JUDGED_DIMENSIONS])


def with_weights(pairs: DataFrame, weights: DataFrame) -> DataFrame:
    return looked_up(pairs, weights, ["hyp_idx"], [f"w_{d}" for d in JUDGED_DIMENSIONS])


def long_weights(weights: DataFrame) -> DataFrame:
    return weights.unpivot(["fact_id", "hyp_idx"], [f"w_{d}" for d in JUDGED_DIMENSIONS], "dim", "weight").withColumn(
        "dim", F.substring("dim", 3, 20))


def with_said(pairs: DataFrame, verdicts: DataFrame | None, weighted: bool = False) -> DataFrame:
    """Pair bits with the stored verdicts as bits of the same order: won (supported) and said (ruled on), null where the pair was not judged;
    `weighted` adds `variance_weights` as w_<dim>, from the same single pass over the verdicts."""
    names = [f"w_{d}" for d in JUDGED_DIMENSIONS] if weighted else []
    if verdicts is None:
        return pairs.withColumns({"won": F.lit(None).cast("int"), "said": F.lit(None).cast("int")})
    bit = F.coalesce(*[F.when(F.lower("dim") == d, F.lit(1 << i)) for i, d in enumerate(JUDGED_DIMENSIONS)])
    per_pair = verdicts.groupBy("fact_id", "hyp_idx", "tag").agg(*[
        F.coalesce(F.bit_or(F.when(rows, bit)), F.lit(0)).alias(n) for n, rows in (("won", F.col("matched")), ("said", F.col("matched").isNotNull()))])

    def n(bits: str, i: int) -> Column:
        return F.sum(F.shiftright(bits, i).bitwiseAND(F.lit(1)))

    spread = {f"w_{d}": F.when(n("said", i) > 1, (n("won", i) * n("said", i) - n("won", i) * n("won", i)) / (n("said", i) * n("said", i))).otherwise(F.lit(0.0))
              for i, d in enumerate(JUDGED_DIMENSIONS) if weighted}
    per_hyp = per_pair.groupBy("fact_id", "hyp_idx").agg(
        F.map_from_entries(F.collect_list(F.struct("tag", F.struct("won", "said")))).alias("_said"), *[c.alias(w) for w, c in spread.items()])
    if weighted:
        top = F.greatest(*names)
        per_hyp = per_hyp.select("fact_id", "hyp_idx", "_said", *[F.when(top > 0, F.col(w)).otherwise(F.lit(1.0)).alias(w) for w in names])
    rows = looked_up(pairs, per_hyp, ["hyp_idx"], ["_said", *names]).withColumn("_own", F.try_element_at("_said", F.col("tag")))
    return rows.select(*pairs.columns, F.col("_own")["won"].alias("won"), F.col("_own")["said"].alias("said"), *names)


def mode_score(mode: str) -> Column:
    """Raw score of a pair under a mode, from its bits; null = this hypothesis did not judge the candidate."""
    won, said = F.col("won"), F.col("said")
    if mode == "deterministic":
        return agree.bits_agree()
    if mode == "hybrid":
        # the stored verdict where it ruled on a resolved dimension, the symbolic one elsewhere
        given = F.coalesce(said, F.lit(0))
        hit = F.coalesce(won, F.lit(0)).bitwiseOR(F.col("hit").bitwiseAND(F.bitwise_not(given))).bitwiseAND(F.col("held"))
        return F.coalesce(F.try_divide(F.bit_count(hit), F.bit_count(given.bitwiseOR(F.col("ruled")).bitwiseAND(F.col("held")))), F.lit(0.0))
    if mode == "det_window":
        return F.when(said.isNotNull(), F.try_divide(F.bit_count("hit"), F.bit_count("ruled")))
    if mode == "llm_varweight":
        zero = F.lit(0.0)
        total, part = (sum((F.when(bits.bitwiseAND(F.lit(1 << i)) != 0, F.coalesce(f"w_{d}", zero)).otherwise(zero) for i, d in enumerate(JUDGED_DIMENSIONS)), zero)
                       for bits in (said, won))
        return F.when(total > 0, part / total)
    if mode == "llm_drop":
        return F.try_divide(F.bit_count(won), F.bit_count(said))
    n = len(JUDGED_DIMENSIONS)
    open_ = {"llm_strict": 0.0, "llm_neutral": 0.5}[mode]
    return (F.bit_count(won) + F.lit(open_) * (n - F.bit_count(said))) / n


def mode_consensus(pairs: DataFrame, modes: list[str], verdicts: DataFrame | None, fill: str = "mean",
                   keys: tuple = ("fact_id",)) -> DataFrame:
    """Consensus of every mode side by side, from pair bits: (keys, tag, mode, consensus).

    Candidates a hypothesis did not judge get 0 or the mean of that hypothesis's judged scores.
    """
    modes = [resolve_mode(m, verdicts) for m in modes]
    pairs = with_said(pairs, verdicts, "llm_varweight" in modes)
    # one column per mode: rows are neither multiplied nor shuffled per mode until the small result is turned long
    rows = pairs.select(*keys, "hyp_idx", "tag", *[mode_score(m).alias(m) for m in modes])
    judged = Window.partitionBy(*keys, "hyp_idx")

    def filled(m: str) -> Column:
        if m in SCORES_ALL or fill == "zero":
            return F.coalesce(m, F.lit(0.0))
        return F.coalesce(F.col(m), F.avg(m).over(judged), F.lit(0.0))

    means = rows.select(*keys, "tag", *[filled(m).alias(m) for m in modes]).groupBy(*keys, "tag").agg(*[F.avg(m).alias(m) for m in modes])
    return means.unpivot([*keys, "tag"], modes, "mode", "consensus")


def rerank(scores: DataFrame, terms: DataFrame, beta, scaling: str = "range", top_k: int | None = None,
           keys: tuple = ("fact_id",)) -> DataFrame:
    """Fused score, scaled to [0, 1] (no spread: 0) or raw, plus beta times the term; order (final desc, tag)."""
    base = minmax(scores, list(keys), "fused_score", 0.0, "base") if scaling == "range" else scores.withColumn(
        "base", F.col("fused_score"))
    joined = base.join(terms, [*keys, "tag"], "left").withColumn("consensus", F.coalesce("consensus", F.lit(0.0)))
    final = joined.drop("rank").withColumn("final_score", F.col("base") + beta * F.col("consensus"))
    return ranked(final, list(keys), final_order(), top_k)


def rerank_in_place(order: DataFrame, terms: DataFrame, beta: float, top_k: int, kappa: float = 60.0,
                    variant: str = "sum", scaling: str = "raw") -> DataFrame:
    """Configurable form: list-rank score where no fused score exists, mean over lists, range scaling with ties at 1."""
    score = F.coalesce("fused_score", 1.0 / (kappa + F.col("rank")))
    if variant == "mean":
        score = score / F.col("lists_fused")
    rows = order.withColumn("base", score)
    if scaling == "range_normalized":
        rows = minmax(rows.withColumn("raw_base", F.col("base")), ["fact_id"], "raw_base", 1.0, "base")
    joined = rows.join(terms, ["fact_id", "tag"], "left")
    final = joined.withColumn("final_score", F.col("base") + beta * F.coalesce("consensus", F.lit(0.0)))
    return ranked(final, ["fact_id"], rerank_order(), top_k, "new_rank")


def rerank_share(reranked: DataFrame, beta: float) -> DataFrame:
    """beta * range(consensus) / range(base) per fact; null when the base has no spread."""
    spread = F.max("base") - F.min("base")
    return reranked.groupBy("fact_id").agg(
        F.when(spread > 1e-12, beta * (F.max("consensus") - F.min("consensus")) / spread).alias("rerank_share"))


def fixed_denominator_terms(verdicts: DataFrame) -> DataFrame:
    """Supported dimensions over six; unresolved or missing ones count as not supported."""
    per_pair = verdicts.groupBy("fact_id", "hyp_idx", "tag").agg(
        (F.count_if(F.col("matched")) / len(JUDGED_DIMENSIONS)).alias("score"))
    return per_pair.groupBy("fact_id", "tag").agg(F.avg("score").alias("consensus"))


def support_terms(verdicts: DataFrame, pool: DataFrame, hypotheses: DataFrame) -> DataFrame:
    """Matched over ruled-on dimensions per pair, 0 where unjudged, averaged over all hypotheses."""
    per_pair = verdicts.groupBy("fact_id", "hyp_idx", "tag").agg(F.avg(F.col("matched").cast("double")).alias("support"))
    pairs = pool.select("fact_id", "tag").join(hypotheses.select("fact_id", "hyp_idx"), "fact_id")
    filled = pairs.join(per_pair, ["fact_id", "hyp_idx", "tag"], "left")
    return filled.groupBy("fact_id", "tag").agg(F.avg(F.coalesce("support", F.lit(0.0))).alias("consensus"))


def config(config_id: str, hyps: list[int], renderings: list[str], fusion: str = "sum", scaling: str = "range",
           beta: float = 0.6, mode: str = "deterministic", truncate: bool = False, fallback: str | None = None) -> dict:
    return dict(config_id=config_id, hyps=hyps, renderings=renderings, fusion=fusion, scaling=scaling, beta=float(beta),
                mode=mode, truncate=truncate, fallback=fallback)


def evaluate_grid(rankings: DataFrame, hypotheses: DataFrame, profiles: DataFrame, verdicts: DataFrame | None,
                  configs: list[dict], cfg: DomainConfig, top_k: int = 200, kappa: float = 60.0, fill: str = "mean") -> DataFrame:
    """All configurations in one job: (config_id, fact_id, tag, rank, scores, fallback_used).

    A candidate is one row with the shares its lists give it and a column per configuration, until the scores are ranked; pairs are
    judged once and shared by every configuration. Only candidates move, to their profiles and back; all else stays by fact.
    """
    for c in configs:
        c["mode"] = resolve_mode(c["mode"], verdicts)
    modes, hyps = sorted({c["mode"] for c in configs}), sorted({h for c in configs for h in c["hyps"]})
    groups = sorted({(h, r) for c in configs for h in c["hyps"] for r in [*c["renderings"], c["fallback"]] if r is not None})

    def of(h: int, r: str) -> Column:
        return (F.col("hyp_idx") == h) & (F.col("rendering") == r)

    share = 1.0 / (F.lit(kappa) + F.col("rank"))
    cells = [x for i, g in enumerate(groups) for x in (
        F.sum(F.when(of(*g), share)).alias(f"s_{i}"), F.count_if(of(*g)).cast("int").alias(f"n_{i}"), F.min(F.when(of(*g), F.col("rank"))).alias(f"b_{i}"))]
    used = rankings.where(reduce(Column.__or__, [of(*g) for g in groups])).groupBy("fact_id", "tag").agg(*cells)

    pairs = with_said(agree.pair_bits(used, hypotheses, profiles, cfg, outer=True), verdicts, "llm_varweight" in modes)
    carried = [c for c in used.columns if c not in ("fact_id", "tag")]
    pairs = pairs.select("fact_id", "tag", *carried, "hyp_idx", *[mode_score(m).alias(m) for m in modes])
    rows = pairs.groupBy("fact_id", "tag").agg(
        *[F.first(c).alias(c) for c in carried], *[F.coalesce(F.max(F.col("hyp_idx") == h), F.lit(False)).alias(f"has_{h}") for h in hyps],
        *[F.max(F.when(F.col("hyp_idx") == h, F.col(m))).alias(f"{m}_{h}") for m in modes for h in hyps])

    by_fact = Window.partitionBy("fact_id")

    def all_of(c: dict, renderings: list) -> list[int]:
        return [i for i, (h, r) in enumerate(groups) if h in c["hyps"] and r in renderings]

    def listed(places: list[int]) -> Column:
        return sum((F.col(f"n_{i}") for i in places), F.lit(0))

    # a fact without any of its own lists falls back as a whole
    spare = {j: c for j, c in enumerate(configs) if c["fallback"]}
    rows = rows.withColumns({f"own_{j}": F.max(listed(all_of(c, c["renderings"])) > 0).over(by_fact) for j, c in spare.items()})

    def pooled(j: int, c: dict) -> tuple[Column, Column]:
        def score(places: list[int]) -> tuple[Column, Column]:
            total, n = sum((F.coalesce(f"s_{i}", F.lit(0.0)) for i in places), F.lit(0.0)), listed(places)
            best = F.least(*[F.col(f"b_{i}") for i in places]) if len(places) > 1 else F.col(f"b_{places[0]}") if places else F.lit(None).cast("int")
            return F.when(n > 0, total if c["fusion"] == "sum" else total / n), best

        own = score(all_of(c, c["renderings"]))
        if j not in spare:
            return own
        return tuple(F.when(F.col(f"own_{j}"), a).otherwise(b) for a, b in zip(own, score(all_of(c, [c["fallback"]]))))

    pools = {j: pooled(j, c) for j, c in enumerate(configs)}
    rows = rows.withColumns({f"f_{j}": s for j, (s, _) in pools.items()} | {f"p_{j}": b for j, (_, b) in pools.items() if configs[j]["truncate"]})
    for j, c in enumerate(configs):
        if c["truncate"]:
            order = Window.partitionBy("fact_id").orderBy(F.desc_nulls_last(F.round(f"f_{j}", 10)), F.asc(f"p_{j}"), F.asc("tag"))
            rows = rows.withColumn(f"f_{j}", F.when(F.row_number().over(order) <= top_k, F.col(f"f_{j}")))

    means = {}
    for j, c in enumerate(configs):
        means |= {f"lo_{j}": F.min(f"f_{j}").over(by_fact), f"hi_{j}": F.max(f"f_{j}").over(by_fact)} if c["scaling"] == "range" else {}
        if c["mode"] not in SCORES_ALL and fill == "mean":
            means |= {f"m_{j}_{h}": F.avg(F.when(F.col(f"f_{j}").isNotNull(), F.col(f"{c['mode']}_{h}"))).over(by_fact) for h in c["hyps"]}
    rows = rows.withColumns(means)

    def result(j: int, c: dict) -> Column:
        base = F.col(f"f_{j}")
        if c["scaling"] == "range":
            spread = F.col(f"hi_{j}") - F.col(f"lo_{j}")
            base = F.when(spread < 1e-12, F.lit(0.0)).otherwise((base - F.col(f"lo_{j}")) / spread)
        filler = {h: [F.col(f"m_{j}_{h}")] if f"m_{j}_{h}" in means else [] for h in c["hyps"]}
        total = sum((F.when(F.col(f"has_{h}"), F.coalesce(f"{c['mode']}_{h}", *filler[h], F.lit(0.0))).otherwise(F.lit(0.0)) for h in c["hyps"]), F.lit(0.0))
        term = F.coalesce(F.try_divide(total, sum((F.col(f"has_{h}").cast("int") for h in c["hyps"]), F.lit(0))), F.lit(0.0))
        fell = ~F.col(f"own_{j}") if j in spare else F.lit(False)
        made = F.struct(F.lit(j).alias("_at"), F.col(f"f_{j}").alias("fused_score"), base.alias("base"), term.alias("consensus"),
                        (base + F.lit(c["beta"]) * term).alias("final_score"), fell.alias("fallback_used"))
        return F.when(F.col(f"f_{j}").isNotNull(), made)

    long = rows.select("fact_id", "tag", F.inline(F.array_compact(F.array(*[result(j, c) for j, c in enumerate(configs)]))))
    ranks = ranked(long, ["fact_id", "_at"], final_order(), top_k)
    return ranks.withColumn("config_id", F.element_at(F.array(*[F.lit(c["config_id"]) for c in configs]), F.col("_at") + 1)).drop("_at")


def best_single_hypothesis(rankings: DataFrame, hypotheses: DataFrame, profiles: DataFrame, gold: DataFrame,
                           beta: float, cfg: DomainConfig, kappa: float = 60.0) -> DataFrame:
    """Each hypothesis ranked alone; per fact the one with the best gold rank, the lower index on a tie.

    A candidate goes to its profile once, with its score under each hypothesis; scores and verdicts meet without a join.
    """
    from evirank.operators.fuse import rrf_scores
    from evirank.operators.metrics import gold_ranks

    keys = ["fact_id", "hyp_idx"]
    scores = rrf_scores(rankings, kappa, keys=tuple(keys))
    pool = scores.groupBy("fact_id", "tag").agg(F.collect_list(F.struct("hyp_idx", "fused_score")).alias("_hyps"))
    rows = agree.pair_bits(pool, hypotheses, profiles, cfg, outer=True).select(*keys, "tag", "fused_score", agree.bits_agree().alias("consensus"))
    alone = minmax(rows, keys, "fused_score", 0.0, "base").withColumn("final_score", F.col("base") + beta * F.col("consensus"))
    ranks = gold_ranks(ranked(alone, keys, final_order()), gold, keys)
    order = F.struct(F.coalesce("gold_rank", F.lit(10**9)), F.col("hyp_idx"))
    return ranks.groupBy("fact_id").agg(
        F.min_by("hyp_idx", order).alias("selected_hyp"), F.min("gold_rank").alias("gold_rank"))
