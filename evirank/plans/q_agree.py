"""Agreement, verifier terms, windows and the evaluation grid."""

from functools import cached_property

from pyspark.sql import functions as F

from evirank.operators import agree, fuse, metrics, verify, windows
from evirank.operators.fuse import ranked, rerank_order
from evirank.plans import frames
from evirank.plans.q_fuse import rrf
from evirank.plans.registry import fragment, query
from evirank.session import by_fact

CFG = frames.part_domain()


class Inputs:
    """The frames most queries here start from."""

    def __init__(self, t, stored=()):
        # not written in between: each use takes its lists from one exchange of the sales by fact; with many uses (grid, consolidation)
        # the lists are written once, a row for each candidate, in buckets of the fact
        self.lists = frames.stored_rankings(t, stored) if stored else frames.rankings(t)
        self.fused = fuse.fuse(self.lists)
        self.hyps = agree.normalize_hypotheses(frames.hypotheses(t), CFG)
        self.profiles = agree.concept_profiles(by_fact(frames.concepts(t), "tag"), CFG, frames.CONCEPT_TEXT)

    @cached_property
    def verdicts(self):
        return frames.verdicts(self.fused)

    @property
    def pairs(self):
        return agree.pair_verdicts(self.fused.select("fact_id", "tag", "rank"), self.hyps, self.profiles)

    @property
    def bits(self):
        return agree.pair_bits(self.fused.select("fact_id", "tag", "rank"), self.hyps, self.profiles, CFG)

    @property
    def given_pairs(self):
        return verify.with_given(self.pairs, self.verdicts)


fragment("ranged", """SELECT *, CASE WHEN max(fused_score) OVER w - min(fused_score) OVER w < 1e-12 THEN 0.0
    ELSE (fused_score - min(fused_score) OVER w) / (max(fused_score) OVER w - min(fused_score) OVER w) END AS base FROM fused WINDOW w AS (PARTITION BY fact_id)""")


@query("K1_range_normalize", "SELECT fact_id, tag, round(base, 8) AS base FROM ranged")
def k1(t):
    rows = fuse.minmax(fuse.rrf_scores(frames.rankings(t)), ["fact_id"], "fused_score", 0.0, "base")
    return rows.select("fact_id", "tag", F.round("base", 8).alias("base"))


@query("K2_canonical_dimensions", "SELECT fact_id, hyp_idx, dim, value FROM hyp_long")
def k2(t):
    dims = F.explode(agree.canonical_dimensions(F.col("dimensions"))).alias("dim", "value")
    return frames.hypotheses(t).select("fact_id", "hyp_idx", dims).where(F.col("value").isNotNull())


@query("K3_value_categories", "SELECT DISTINCT dim, value, array_to_string(coalesce(vcats, []), ',') AS cats FROM norm")
def k3(t):
    hyps = agree.normalize_hypotheses(frames.hypotheses(t), CFG)
    cells = [F.struct(F.lit(d).alias("dim"), F.col(f"dims.{d}.value").alias("value"), F.col(f"dims.{d}.cats").alias("cats")) for d in agree.JUDGED]
    rows = hyps.select(F.inline(F.array(*cells))).where(F.col("value").isNotNull())
    return rows.select("dim", "value", F.array_join("cats", ",").alias("cats")).distinct()


@query("K4_concept_profile", "SELECT tag, dim, array_to_string(ccats, ',') AS cats FROM concept_cats")
def k4(t):
    profiles = agree.concept_profiles(frames.concepts(t), CFG, frames.CONCEPT_TEXT)
    cells = [F.struct(F.lit(d).alias("dim"), F.array_join(f"cats.{d}", ",").alias("cats")) for d in agree.JUDGED]
    return profiles.select("tag", F.inline(F.array(*cells))).where(F.col("cats") != "")


@query("K5_dimension_verdict", """SELECT fact_id, hyp_idx, tag, dim, matched, round(confidence, 6) AS confidence, reason FROM pair_long""")
def k5(t):
    i = Inputs(t)
    rows = agree.stated_verdicts(i.fused.select("fact_id", "tag"), i.hyps, i.profiles)
    return rows.select("fact_id", "hyp_idx", "tag", "dim", "matched", "confidence", "reason")


@query("K6_agree_score", "SELECT fact_id, hyp_idx, tag, n_matched AS matched, n_evaluated AS evaluated, round(agree, 6) AS agree FROM pair_agree")
def k6(t):
    return Inputs(t).pairs.select(
        "fact_id", "hyp_idx", "tag", agree.count_matched().alias("matched"),
        agree.count_evaluated().alias("evaluated"), F.round(agree.agree_score(), 6).alias("agree"))


# each hypothesis's own list = the def list of that hypothesis
fragment("own_agree", """SELECT r.fact_id, r.hyp_idx, r.tag, r.rank, p.agree FROM rankings r JOIN pair_agree p USING (fact_id, hyp_idx, tag) WHERE rendering = 'def'""")
fragment("head_agree", "SELECT fact_id, hyp_idx, avg(agree) AS mean_agreement FROM own_agree WHERE rank <= 10 GROUP BY ALL")


def own_pairs(i):
    own = i.lists.where("rendering = 'def'").select("fact_id", "hyp_idx", "tag", "rank")
    return agree.pair_verdicts(own, i.hyps, i.profiles)


@query("K7_mean_agreement", "SELECT fact_id, hyp_idx, round(mean_agreement, 6) AS mean_agreement FROM head_agree")
def k7(t):
    return agree.mean_agreement(own_pairs(Inputs(t)), 10).withColumn("mean_agreement", F.round("mean_agreement", 6))


fragment("consensus", "SELECT fact_id, tag, avg(agree) AS consensus FROM pair_agree GROUP BY ALL")


@query("K8_consensus", "SELECT fact_id, tag, round(consensus, 6) AS consensus FROM consensus")
def k8(t):
    return agree.consensus(Inputs(t).pairs).withColumn("consensus", F.round("consensus", 6))


def final_sql(base: str, term: str, beta: float, k: int = 200, source: str = "ranged", order: str = "round(f, 10) DESC, tag") -> str:
    return f"""SELECT fact_id, tag, row_number() OVER (PARTITION BY fact_id ORDER BY {order}) AS rank, round(f, 8) AS final_score FROM (
      SELECT fact_id, tag, rank AS prev, {base} + {beta}::DOUBLE * coalesce(consensus, 0) AS f FROM {source} LEFT JOIN ({term}) USING (fact_id, tag)) QUALIFY rank <= {k}"""


def _final(df):
    return df.select("fact_id", "tag", "rank", F.round("final_score", 8).alias("final_score"))


@query("K9_consensus_rerank", final_sql("base", "SELECT * FROM consensus", 0.6))
def k9(t):
    i = Inputs(t)
    return _final(verify.rerank(fuse.rrf_scores(i.lists), agree.consensus(i.pairs), 0.6, top_k=200))


@query("K10_fused_only_rerank", final_sql("base", "SELECT * FROM consensus", 0))
def k10(t):
    scores = fuse.rrf_scores(frames.rankings(t))
    terms = scores.select("fact_id", "tag", F.lit(0.0).alias("consensus"))
    return _final(verify.rerank(scores, terms, 0.0, top_k=200))


@query("K11_raw_rerank", final_sql("fused_score", "SELECT * FROM consensus", 0.02, order="round(f, 10) DESC, prev, tag"))
def k11(t):
    i = Inputs(t)
    out = verify.rerank_in_place(i.fused.withColumn("lists_fused", F.lit(1)), agree.consensus(i.pairs), 0.02, 200)
    return _final(out.drop("rank").withColumnRenamed("new_rank", "rank"))


@query("K12_configurable_rerank", """WITH b AS (SELECT fact_id, tag, rank AS prev, CASE WHEN max(s) OVER w - min(s) OVER w < 1e-12 THEN 1.0
      ELSE (s - min(s) OVER w) / (max(s) OVER w - min(s) OVER w) END AS base FROM (SELECT fact_id, tag, rank, fused_score / 4 AS s FROM fused) WINDOW w AS (PARTITION BY fact_id))
    SELECT fact_id, tag, row_number() OVER (PARTITION BY fact_id ORDER BY round(f, 10) DESC, prev, tag) AS rank, round(f, 8) AS final_score FROM (
      SELECT fact_id, tag, prev, base + 0.4::DOUBLE * consensus AS f FROM b JOIN consensus USING (fact_id, tag)) QUALIFY rank <= 50""")
def k12(t):
    i = Inputs(t)
    order = i.fused.withColumn("lists_fused", F.lit(4))
    out = verify.rerank_in_place(order, agree.consensus(i.pairs), 0.4, 50, variant="mean", scaling="range_normalized")
    return _final(out.drop("rank").withColumnRenamed("new_rank", "rank"))


@query("K13_hypothesis_selection", """SELECT fact_id, row_number() OVER w AS j, arg_max(hyp_idx, (round(mean_agreement, 10), -hyp_idx)) OVER (w ROWS UNBOUNDED PRECEDING) AS selected_hyp
    FROM head_agree WINDOW w AS (PARTITION BY fact_id ORDER BY hyp_idx)""")
def k13(t):
    return agree.select_hypothesis(agree.mean_agreement(own_pairs(Inputs(t)), 10))


fragment("dims6", "SELECT unnest(['family', 'role', 'event', 'qualifier', 'scope', 'temporal']) AS dim")
fragment("feedback", """SELECT fact_id, hyp_idx, dim, coalesce(share, 0) AS share, CASE WHEN share >= 0.6 THEN 'support' WHEN share <= 0.25 THEN 'contradict' ELSE 'unresolved' END AS verdict,
    CASE WHEN share IS NULL THEN 0 ELSE abs(share - 0.5) * 2 END AS confidence FROM (SELECT c_custkey AS fact_id, hyp_idx, dim FROM customer, (SELECT unnest([0::BIGINT, 1::BIGINT]) AS hyp_idx) CROSS JOIN dims6)
    LEFT JOIN (SELECT fact_id, hyp_idx, dim, avg(CASE WHEN matched THEN 1.0::DOUBLE WHEN NOT matched THEN 0 END) AS share FROM pair_long JOIN
      (SELECT fact_id, hyp_idx, tag, rank FROM rankings WHERE rendering = 'def' AND rank <= 10) USING (fact_id, hyp_idx, tag) GROUP BY ALL) USING (fact_id, hyp_idx, dim)""")


def feedback(i):
    return agree.dimension_feedback(own_pairs(i), i.hyps, 10)


@query("K14_symbolic_feedback", """SELECT fact_id, hyp_idx, dim, round(share, 6) AS share, verdict, round(confidence, 6) AS confidence, is_mismatch FROM feedback JOIN (
    SELECT fact_id, hyp_idx, count(*) FILTER (verdict = 'contradict' AND dim IN ('family', 'role', 'event')) >= 2 AS is_mismatch FROM feedback GROUP BY ALL) USING (fact_id, hyp_idx)""")
def k14(t):
    rows = feedback(Inputs(t))
    return rows.join(agree.structural_mismatch(rows), ["fact_id", "hyp_idx"]).withColumns(
        {c: F.round(c, 6) for c in ("share", "confidence")})


SECOND = "CASE WHEN (fact_id + hyp_idx + length(dim)) % 4 = 0 THEN NULL ELSE ['support', 'contradict', 'unresolved'][(fact_id + length(dim)) % 3 + 1] END"


@query("K15_feedback_merge", f"""SELECT fact_id, hyp_idx, dim, CASE WHEN takes THEN o ELSE verdict END AS verdict,
    round(CASE WHEN takes THEN 0.6 WHEN disagrees THEN greatest(0.1, confidence - 0.2) ELSE confidence END, 6) AS confidence, disagrees,
    CASE WHEN takes THEN 'second' ELSE 'first' END AS layer FROM (SELECT *, o IS NOT NULL AND verdict = 'unresolved' AS takes,
      o IS NOT NULL AND verdict <> 'unresolved' AND o <> verdict AND o <> 'unresolved' AS disagrees FROM (SELECT *, {SECOND} AS o FROM feedback))""")
def k15(t):
    i = Inputs(t)
    rows = feedback(i)
    places = F.col("fact_id") + F.length("dim")
    other = F.element_at(F.array(F.lit("support"), F.lit("contradict"), F.lit("unresolved")), (places % 3 + 1).cast("int"))
    every = i.hyps.select("fact_id", "hyp_idx", F.explode(F.array(*map(F.lit, verify.JUDGED_DIMENSIONS))).alias("dim"))
    second = every.where((places + F.col("hyp_idx")) % 4 != 0).withColumn("verdict", other)
    return agree.merge_feedback(rows, second).withColumn("confidence", F.round("confidence", 6))


@query("K16_contradicted_weights", "SELECT fact_id, hyp_idx, dim, CASE WHEN verdict = 'contradict' THEN 0.5 ELSE 1.0 END AS weight FROM feedback")
def k16(t):
    weights = verify.contradicted_weights(feedback(Inputs(t)), 0.5)
    return verify.long_weights(weights)


fragment("hybrid_dims", """SELECT fact_id, hyp_idx, tag, dim, coalesce(v.matched, p.matched) AS matched FROM pair_long p LEFT JOIN verdicts v USING (fact_id, hyp_idx, tag, dim)""")
HYBRID = """SELECT fact_id, tag, avg(coalesce(s, 0)) AS consensus FROM pair_agree LEFT JOIN (
    SELECT fact_id, hyp_idx, tag, sum(w * matched::INT) / sum(w) AS s FROM ({rows}) WHERE matched IS NOT NULL GROUP BY ALL) USING (fact_id, hyp_idx, tag) GROUP BY ALL"""


@query("K17_hybrid_agree", "SELECT fact_id, tag, round(consensus, 6) AS consensus FROM (" + HYBRID.format(
    rows="SELECT h.*, CASE WHEN verdict = 'contradict' THEN 0.5::DOUBLE ELSE 1 END AS w FROM hybrid_dims h JOIN feedback USING (fact_id, hyp_idx, dim)") + ")")
def k17(t):
    i = Inputs(t)
    weights = verify.contradicted_weights(feedback(i), 0.5)
    rows = verify.with_weights(i.given_pairs, weights)
    scored = rows.select("fact_id", "tag", F.coalesce(verify.hybrid_score(weighted=True), F.lit(0.0)).alias("s"))
    return scored.groupBy("fact_id", "tag").agg(F.round(F.avg("s"), 6).alias("consensus"))


@query("K18_verdict_score", """SELECT fact_id, hyp_idx, tag, round(avg(matched::INT), 6) AS score_drop, round(count(*) FILTER (matched) / 6.0::DOUBLE, 6) AS score_negative,
    round(avg(coalesce(matched::INT::DOUBLE, 0.5::DOUBLE)), 6) AS score_neutral FROM verdicts GROUP BY ALL""")
def k18(t):
    rows = verify.wide_verdicts(Inputs(t).verdicts)
    return rows.select("fact_id", "hyp_idx", "tag", *[F.round(verify.verdict_score(a), 6).alias(f"score_{a}") for a in ("drop", "negative", "neutral")])


MODE_SCORES = {
    "llm_drop": "SELECT fact_id, hyp_idx, tag, avg(matched::INT) AS s FROM verdicts GROUP BY ALL",
    "llm_strict": "SELECT fact_id, hyp_idx, tag, count(*) FILTER (matched) / 6.0::DOUBLE AS s FROM verdicts GROUP BY ALL",
    "llm_neutral": "SELECT fact_id, hyp_idx, tag, avg(coalesce(matched::INT::DOUBLE, 0.5::DOUBLE)) AS s FROM verdicts GROUP BY ALL",
    "llm_varweight": "SELECT fact_id, hyp_idx, tag, sum(w * matched::INT) FILTER (matched IS NOT NULL) / nullif(sum(w) FILTER (matched IS NOT NULL), 0) AS s FROM verdicts JOIN var_weights USING (fact_id, hyp_idx, dim) GROUP BY ALL",
    "det_window": "SELECT fact_id, hyp_idx, tag, CASE WHEN n_evaluated > 0 THEN agree END AS s FROM pair_agree WHERE rank <= 10",
}
fragment("var_weights", """SELECT fact_id, hyp_idx, dim, CASE WHEN max(w) OVER (PARTITION BY fact_id, hyp_idx) > 0 THEN w ELSE 1 END AS w FROM (
    SELECT fact_id, hyp_idx, dim, CASE WHEN count(matched) > 1 THEN var_pop(matched::INT) ELSE 0 END AS w FROM verdicts GROUP BY ALL)""")


def filled(mode: str, fill: bool = True, pool: str = "pair_agree") -> str:
    filler = "coalesce(avg(s) OVER (PARTITION BY fact_id, hyp_idx), 0)" if fill else "0"
    return f"""SELECT fact_id, tag, avg(x) AS consensus FROM (SELECT fact_id, hyp_idx, tag, coalesce(s, {filler}) AS x FROM {pool}
      LEFT JOIN ({MODE_SCORES[mode]}) USING (fact_id, hyp_idx, tag)) GROUP BY ALL"""


ROUNDED = "SELECT fact_id, tag, round(consensus, 6) AS consensus FROM "


def _mode(t, mode, fill="mean"):
    i = Inputs(t)
    rows = verify.mode_consensus(i.bits, [mode], i.verdicts, fill)
    return rows.select("fact_id", "tag", F.round("consensus", 6).alias("consensus"))


@query("K19_verdict_consensus", ROUNDED + f"({filled('llm_drop')})")
def k19(t):
    return _mode(t, "llm_drop")


@query("K19_zero_fill", ROUNDED + f"({filled('llm_strict', False)})")
def k19z(t):
    return _mode(t, "llm_strict", "zero")


@query("K20_variance_weights", "SELECT fact_id, hyp_idx, dim, round(w, 8) AS weight FROM var_weights")
def k20(t):
    rows = verify.variance_weights(Inputs(t).verdicts)
    return verify.long_weights(rows).withColumn("weight", F.round("weight", 8))


@query("K21_window_symbolic", ROUNDED + f"({filled('det_window')})")
def k21(t):
    return _mode(t, "det_window")


FIXED = """SELECT fact_id, tag, avg(s) AS consensus FROM (SELECT fact_id, hyp_idx, tag, count(*) FILTER (matched) / 6.0::DOUBLE AS s FROM verdicts GROUP BY ALL) GROUP BY ALL"""


@query("K22_fixed_denominator", final_sql("base", FIXED, 0.6))
def k22(t):
    i = Inputs(t)
    return _final(verify.rerank(fuse.rrf_scores(i.lists), verify.fixed_denominator_terms(i.verdicts), 0.6, top_k=200))


@query("K23_support_value", final_sql("base", """SELECT fact_id, tag, avg(coalesce(s, 0)) AS consensus FROM pair_agree LEFT JOIN (
    SELECT fact_id, hyp_idx, tag, avg(matched::INT) AS s FROM verdicts GROUP BY ALL) USING (fact_id, hyp_idx, tag) GROUP BY ALL""", 0.6))
def k23(t):
    i = Inputs(t)
    terms = verify.support_terms(i.verdicts, i.fused, i.hyps)
    return _final(verify.rerank(fuse.rrf_scores(i.lists), terms, 0.6, top_k=200))


ALL_MODES = {"deterministic": "SELECT * FROM consensus", "hybrid": HYBRID.format(rows="SELECT *, 1.0::DOUBLE AS w FROM hybrid_dims"),
             **{m: filled(m) for m in MODE_SCORES}}


@query("K24_modes_side_by_side", " UNION ALL ".join(
    f"SELECT '{m}' AS mode, fact_id, tag, round(consensus, 6) AS consensus FROM ({sql})" for m, sql in ALL_MODES.items()))
def k24(t):
    i = Inputs(t)
    rows = verify.mode_consensus(i.bits, verify.MODES, i.verdicts)
    return rows.select("mode", "fact_id", "tag", F.round("consensus", 6).alias("consensus"))


GRID = [
    verify.config("full", [0, 1], ["def", "lab"]),
    verify.config("mean_raw", [0, 1], ["def", "lab"], fusion="mean", scaling="raw", beta=0.02),
    verify.config("truncated_hybrid", [0, 1], ["def", "lab"], mode="hybrid", truncate=True),
    verify.config("one_hyp", [1], ["def", "lab"], mode="llm_drop"),
    verify.config("def_only", [0, 1], ["def"], mode="det_window"),
    verify.config("lab_fallback", [1], ["lab"], mode="llm_varweight", fallback="def"),
]


def grid_sql(c: dict) -> str:
    hyps = ", ".join(map(str, c["hyps"]))
    forms = ", ".join(f"'{r}'" for r in c["renderings"])
    cid = c["config_id"]
    src = f"SELECT * FROM rankings WHERE hyp_idx IN ({hyps}) AND rendering IN ({forms})"
    if c["fallback"]:
        src += f""" UNION ALL SELECT * FROM rankings WHERE hyp_idx IN ({hyps}) AND rendering = '{c['fallback']}' AND fact_id NOT IN (
            SELECT fact_id FROM rankings WHERE hyp_idx IN ({hyps}) AND rendering IN ({forms}))"""
    agg = "avg" if c["fusion"] == "mean" else "sum"
    pool = f"""SELECT fact_id, tag, s FROM (SELECT fact_id, tag, {agg}(1.0::DOUBLE / (60 + rank)) AS s, min(rank) AS br FROM ({src}) GROUP BY ALL)
        QUALIFY row_number() OVER (PARTITION BY fact_id ORDER BY round(s, 10) DESC, br, tag) <= {25 if c['truncate'] else 100000}"""
    pairs = f"(SELECT p.* FROM pair_agree p JOIN ({pool}) USING (fact_id, tag) WHERE hyp_idx IN ({hyps}))"
    if c["mode"] == "deterministic":
        term = f"SELECT fact_id, tag, avg(agree) AS consensus FROM {pairs} GROUP BY ALL"
    elif c["mode"] == "hybrid":
        term = HYBRID.format(rows="SELECT *, 1.0::DOUBLE AS w FROM hybrid_dims").replace("FROM pair_agree", f"FROM {pairs}")
    else:
        term = filled(c["mode"], pool=pairs)
    base = "s" if c["scaling"] == "raw" else """CASE WHEN max(s) OVER w - min(s) OVER w < 1e-12 THEN 0.0 ELSE (s - min(s) OVER w) / (max(s) OVER w - min(s) OVER w) END"""
    return f"""SELECT '{cid}' AS config_id, fact_id, tag, row_number() OVER (PARTITION BY fact_id ORDER BY round(f, 10) DESC, tag) AS rank, round(f, 8) AS final_score FROM (
        SELECT fact_id, tag, base + {c['beta']}::DOUBLE * coalesce(consensus, 0) AS f FROM (SELECT fact_id, tag, {base} AS base FROM ({pool}) WINDOW w AS (PARTITION BY fact_id))
        LEFT JOIN ({term}) USING (fact_id, tag)) QUALIFY rank <= 25"""


fragment("grid_rankings", " UNION ALL ".join(f"({grid_sql(c)})" for c in GRID))


def grid(t):
    i = Inputs(t, stored=["rank"])
    return verify.evaluate_grid(i.lists, i.hyps, i.profiles, i.verdicts, [dict(c) for c in GRID], CFG, top_k=25)


@query("K25_evaluate_grid", "SELECT * FROM grid_rankings")
def k25(t):
    return grid(t).select("config_id", "fact_id", "tag", "rank", F.round("final_score", 8).alias("final_score"))


@query("K25_grid_metrics", """SELECT config_id, modality, count(*) AS n, round(avg(coalesce(1.0::DOUBLE / gold_rank, 0)), 6) AS mrr, round(avg(CASE WHEN gold_rank <= 10 THEN 1.0 ELSE 0 END), 6) AS recall_at_10
    FROM facts JOIN (SELECT config_id, fact_id, min(CASE WHEN g.tag IS NOT NULL THEN rank END) AS gold_rank FROM grid_rankings LEFT JOIN gold g USING (fact_id, tag) GROUP BY ALL) USING (fact_id) GROUP BY ALL""")
def k25m(t):
    ranks = metrics.gold_ranks(grid(t), frames.gold(t), ["config_id", "fact_id"])
    rows = frames.facts(t).join(ranks, "fact_id").withColumns(metrics.metric_columns([10]))
    return rows.groupBy("config_id", "modality").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.avg("mrr"), 6).alias("mrr"), F.round(F.avg("recall_at_10"), 6).alias("recall_at_10"))


@query("K26_oracle_best_single", f"""WITH f AS ({rrf('fact_id, hyp_idx')}), b AS (SELECT fact_id, hyp_idx, tag, CASE WHEN max(fused_score) OVER w - min(fused_score) OVER w < 1e-12 THEN 0.0
      ELSE (fused_score - min(fused_score) OVER w) / (max(fused_score) OVER w - min(fused_score) OVER w) END + 0.6::DOUBLE * agree AS x FROM f JOIN pair_agree p USING (fact_id, hyp_idx, tag) WINDOW w AS (PARTITION BY fact_id, hyp_idx)),
    r AS (SELECT fact_id, hyp_idx, tag, row_number() OVER (PARTITION BY fact_id, hyp_idx ORDER BY round(x, 10) DESC, tag) AS rank FROM b),
    g AS (SELECT fact_id, hyp_idx, min(CASE WHEN g.tag IS NOT NULL THEN rank END) AS gr FROM r LEFT JOIN gold g USING (fact_id, tag) GROUP BY ALL)
    SELECT fact_id, arg_min(hyp_idx, (coalesce(gr, 1000000000), hyp_idx)) AS selected_hyp, min(gr) AS gold_rank FROM g GROUP BY fact_id""")
def k26(t):
    i = Inputs(t, stored=["rank"])
    return verify.best_single_hypothesis(i.lists, i.hyps, i.profiles, frames.gold(t), 0.6, CFG)


@query("K27_rerank_share", """SELECT fact_id, round(CASE WHEN max(base) - min(base) > 1e-12 THEN 0.6 * (max(consensus) - min(consensus)) / (max(base) - min(base)) END, 6) AS rerank_share
    FROM ranged JOIN consensus USING (fact_id, tag) GROUP BY fact_id""")
def k27(t):
    i = Inputs(t)
    out = verify.rerank(fuse.rrf_scores(i.lists), agree.consensus(i.pairs), 0.6)
    return verify.rerank_share(out, 0.6).withColumn("rerank_share", F.round("rerank_share", 6))


@query("K28_verdict_restriction", "SELECT fact_id, hyp_idx, tag, dim, matched FROM verdicts WHERE (fact_id, tag) IN (SELECT fact_id, tag FROM fused WHERE rank <= 4)")
def k28(t):
    i = Inputs(t)
    calls = i.fused.where("rank <= 10").select("fact_id", F.explode(F.array(F.lit(0), F.lit(1))).alias("hyp_idx"), F.col("rank").alias("pos"), "tag")
    return verify.restrict_to_window(i.verdicts, calls, 4).select("fact_id", "hyp_idx", "tag", "dim", "matched")


EX = "reason IN ('candidate_missing_controlled_category', 'controlled_category_intersection')"
fragment("decomposed", f"""SELECT *, row_number() OVER (PARTITION BY fact_id ORDER BY round(overall_score, 10) DESC, hyp_idx) = 1 AS selected_by_overall,
      row_number() OVER (PARTITION BY fact_id ORDER BY round(exact_score, 10) DESC, hyp_idx) = 1 AS selected_by_exact,
      row_number() OVER (PARTITION BY fact_id ORDER BY round(lexical_score, 10) DESC, hyp_idx) = 1 AS selected_by_lexical FROM (
    SELECT *, CASE WHEN ee > 0 THEN es / ee::DOUBLE ELSE 0 END AS exact_score, CASE WHEN le > 0 THEN ls / le::DOUBLE ELSE 0 END AS lexical_score,
      CASE WHEN ee + le > 0 THEN (es + ls) / (ee + le)::DOUBLE ELSE 0 END AS overall_score FROM (
        SELECT fact_id, hyp_idx, coalesce(sum(es), 0)::BIGINT AS es, coalesce(sum(ee), 0)::BIGINT AS ee, coalesce(sum(ls), 0)::BIGINT AS ls, coalesce(sum(le), 0)::BIGINT AS le, coalesce(sum(n), 0)::BIGINT AS n
        FROM (SELECT fact_id, hyp_idx, tag FROM rankings WHERE rendering = 'def' AND rank <= 10) LEFT JOIN (SELECT fact_id, hyp_idx, tag, count(*) FILTER ({EX} AND matched) AS es,
          count(matched) FILTER ({EX}) AS ee, count(*) FILTER (NOT {EX} AND matched) AS ls, count(matched) FILTER (NOT {EX}) AS le, count(*) AS n FROM pair_long GROUP BY ALL) USING (fact_id, hyp_idx, tag) GROUP BY ALL))""")


@query("K29_agreement_decomposition", """SELECT fact_id, hyp_idx, es AS exact_support, ee AS exact_evaluated, ls AS lexical_support, le AS lexical_evaluated, n - ee - le AS unresolved,
    round(exact_score, 6) AS exact_score, round(lexical_score, 6) AS lexical_score, round(overall_score, 6) AS overall_score, selected_by_overall, selected_by_exact, selected_by_lexical FROM decomposed""")
def k29(t):
    rows = agree.decompose(own_pairs(Inputs(t)), 10)
    return rows.withColumns({f"{c}_score": F.round(f"{c}_score", 6) for c in ("exact", "lexical", "overall")})


@query("K29_decomposition_summary", """SELECT coalesce(modality, 'pooled') AS modality, count(*) AS hypothesis_rows, count(DISTINCT fact_id) AS fact_count,
    coalesce(round(sum(es) / nullif(sum(ee), 0)::DOUBLE, 6), 0) AS exact_support_fraction, coalesce(round(sum(ls) / nullif(sum(le), 0)::DOUBLE, 6), 0) AS lexical_support_fraction,
    coalesce(round(sum(le) / nullif(sum(ee + le), 0)::DOUBLE, 6), 0) AS lexical_evaluated_fraction, round(avg(selected_by_exact::INT) FILTER (selected_by_overall), 6) AS exact_matches_overall,
    round(avg(selected_by_lexical::INT) FILTER (selected_by_overall), 6) AS lexical_matches_overall, round(avg(exact_score) FILTER (selected_by_overall), 6) AS selected_mean_exact
    FROM decomposed JOIN facts USING (fact_id) GROUP BY GROUPING SETS ((modality), ())""")
def k29s(t):
    rows = agree.decompose(own_pairs(Inputs(t)), 10).join(frames.facts(t).select("fact_id", "modality"), "fact_id")
    return agree.decomposition_summary(rows, "modality")


@query("K30_agreement_detail", """WITH picked AS (SELECT c_custkey AS fact_id FROM customer ORDER BY md5('17-' || c_custkey), c_custkey LIMIT 40)
    SELECT fact_id, hyp_idx, rank, tag, round(agree, 6) AS agree, verdicts FROM picked JOIN own_agree USING (fact_id) LEFT JOIN (
      SELECT fact_id, hyp_idx, tag, string_agg(dim || '=' || coalesce(matched::VARCHAR, 'null'), ',' ORDER BY dim) AS verdicts FROM pair_long GROUP BY ALL) USING (fact_id, hyp_idx, tag) WHERE rank <= 10""")
def k30(t):
    from evirank.operators.splits import seeded_sample

    i = Inputs(t)
    picked = seeded_sample(frames.facts(t).select("fact_id"), "fact_id", 17, 40)
    pairs = own_pairs(i).where("rank <= 10").join(picked, "fact_id")
    keys = ["fact_id", "hyp_idx", "rank", "tag"]
    entry = F.concat("dim", F.lit("="), F.coalesce(F.col("matched").cast("string"), F.lit("null")))
    listed = agree.verdict_rows(pairs, keys).groupBy(*keys).agg(F.array_join(F.array_sort(F.collect_list(entry)), ",").alias("verdicts"))
    return pairs.select(*keys, F.round(agree.agree_score(), 6).alias("agree")).join(listed, keys, "left")


# --- windows over candidate lists ------------------------------------------------------------------------------------

@query("W1_window_ranking", "SELECT fact_id, tag, pos FROM (SELECT fact_id, tag, row_number() OVER (PARTITION BY fact_id ORDER BY round(base, 10) DESC, tag) AS pos FROM ranged) WHERE pos <= 10")
def w1(t):
    scaled = fuse.minmax(fuse.rrf_scores(frames.rankings(t)), ["fact_id"], "fused_score", 0.0, "base")
    return windows.score_window(scaled, "base", 10).select("fact_id", "tag", "pos")


fragment("signatures", "SELECT tag, string_agg(dim || ':' || array_to_string(ccats, '+'), ';' ORDER BY dim) AS sig FROM concept_cats GROUP BY tag")
fragment("reps", """SELECT fact_id, tag, row_number() OVER (PARTITION BY fact_id ORDER BY is_rep DESC, rank) AS pos FROM (SELECT fact_id, tag, rank,
    (row_number() OVER (PARTITION BY fact_id, coalesce(sig, '') ORDER BY rank) = 1)::INT AS is_rep FROM fused LEFT JOIN signatures USING (tag) WHERE rank <= 30)""")


@query("W2_cluster_representatives", "SELECT fact_id, tag, pos FROM reps WHERE pos <= 10")
def w2(t):
    i = Inputs(t)
    return windows.cluster_representatives(i.fused, i.profiles, 10, 30).select("fact_id", "tag", "pos")


@query("W3_arm_windows", """WITH arms AS (SELECT 'sum' AS arm, fact_id, tag, rank FROM fused WHERE rank <= 40 UNION ALL SELECT 'mean', fact_id, tag, rank FROM fused_mean WHERE rank <= 40)
    SELECT arm, fact_id, tag, row_number() OVER (PARTITION BY arm, fact_id ORDER BY is_rep DESC, rank) AS pos FROM (SELECT arm, fact_id, tag, rank,
      (row_number() OVER (PARTITION BY arm, fact_id, coalesce(sig, '') ORDER BY rank) = 1)::INT AS is_rep FROM arms LEFT JOIN signatures USING (tag) WHERE rank <= 30) QUALIFY pos <= 10""")
def w3(t):
    i = Inputs(t)
    arms = metrics.stacked({how: fuse.fuse(i.lists, 40, how=how).select("fact_id", "tag", "rank") for how in ("sum", "mean")}, "arm")
    return windows.cluster_representatives(arms, i.profiles, 10, 30, keys=("arm", "fact_id")).select("arm", "fact_id", "tag", "pos")


@query("W3_unresolved_tags", """SELECT arm, count(*) FILTER (p_partkey IS NULL) AS unresolved_tags, count(DISTINCT fact_id) AS facts FROM (
    SELECT 'sum' AS arm, fact_id, tag FROM fused WHERE rank <= 10 UNION ALL SELECT 'mean', fact_id, tag FROM fused_mean WHERE rank <= 10) LEFT JOIN (SELECT p_partkey FROM part WHERE p_size > 5) ON p_partkey::VARCHAR = tag GROUP BY arm""")
def w3u(t):
    lists = frames.rankings(t)
    arms = metrics.stacked({how: fuse.fuse(lists, 10, how=how).select("fact_id", "tag", "rank") for how in ("sum", "mean")}, "arm")
    known = t.part.where("p_size > 5").select(F.col("p_partkey").cast("string").alias("tag"))
    return windows.unresolved_tags(arms, known)


@query("W4_window_coverage", """WITH need AS (SELECT fact_id, tag, unnest([0::BIGINT, 1::BIGINT]) AS hyp_idx FROM fused_mean WHERE rank <= 10),
    c AS (SELECT fact_id, avg(CASE WHEN v.tag IS NULL THEN 0.0 ELSE 1.0 END) AS coverage FROM need LEFT JOIN (SELECT DISTINCT fact_id, hyp_idx, tag FROM verdicts) v USING (fact_id, hyp_idx, tag) GROUP BY fact_id)
    SELECT fact_id, round(coverage, 6) AS coverage, CASE WHEN coverage >= 1 THEN 'REUSE' WHEN coverage > 0 THEN 'PARTIAL' ELSE 'NEEDS' END AS status FROM c""")
def w4(t):
    i = Inputs(t)
    needed = fuse.fuse(i.lists, 10, how="mean").select("fact_id", "tag", F.explode(F.array(F.lit(0), F.lit(1))).alias("hyp_idx"))
    return windows.verdict_coverage(needed, i.verdicts).withColumn("coverage", F.round("coverage", 6))


fragment("tally", """SELECT fact_id, dim, count(*) FILTER (matched) AS support, count(*) FILTER (NOT matched) AS against, count(*) FILTER (matched IS NULL) AS abstain FROM verdicts GROUP BY ALL""")


@query("W5_feedback_tally", "SELECT fact_id, dim, support, against, abstain FROM tally")
def w5(t):
    return windows.feedback_tally(Inputs(t).verdicts)


@query("W5_revision_target", """SELECT fact_id, arg_max(dim, (against - support, -list_position(['family', 'role', 'event', 'qualifier', 'scope', 'temporal'], dim))) AS target_dimension,
    max(against - support) AS margin FROM tally GROUP BY fact_id HAVING max(against - support) > 0""")
def w5t(t):
    return windows.revision_target(windows.feedback_tally(Inputs(t).verdicts))


@query("M16_firing_rate", "SELECT dim, count(*) AS opportunities, count(matched) AS fired, count(matched) / count(*)::DOUBLE AS firing_rate FROM verdicts GROUP BY dim")
def m16(t):
    return metrics.firing_rate(Inputs(t).verdicts)


# --- consolidation and initialisation comparisons --------------------------------------------------------------------

COMBSUM = """SELECT fact_id, tag, row_number() OVER (PARTITION BY fact_id ORDER BY round(s, 10) DESC, fl, tag) AS rank FROM (
    SELECT fact_id, tag, sum(sc) AS s, min(list_id) AS fl FROM (SELECT *, CASE WHEN max(score) OVER w - min(score) OVER w < 1e-12 THEN 1.0
      ELSE (score - min(score) OVER w) / (max(score) OVER w - min(score) OVER w) END AS sc FROM rankings WINDOW w AS (PARTITION BY fact_id, list_id)) GROUP BY ALL)"""
BETAS = [0.0, 0.02, 0.1]


def raw_sql(beta):
    return f"SELECT fact_id, tag, row_number() OVER (PARTITION BY fact_id ORDER BY round(f, 10) DESC, prev, tag) AS rank FROM (SELECT fact_id, tag, rank AS prev, fused_score + {beta}::DOUBLE * consensus AS f FROM fused JOIN consensus USING (fact_id, tag))"


VARIANTS = {"plain_rrf": "SELECT fact_id, tag, rank FROM fused", "score_normalized_combsum": COMBSUM,
            **{f"rrf_consensus_beta_{b:g}": raw_sql(b) for b in BETAS}}
fragment("variant_ranks", " UNION ALL ".join(
    f"SELECT '{n}' AS config, fact_id, min(rank) AS gold_rank FROM ({sql}) JOIN gold USING (fact_id, tag) WHERE rank <= 10 GROUP BY fact_id" for n, sql in VARIANTS.items())
    + " UNION ALL SELECT 'coverage_ceiling', fact_id, 1 FROM rankings JOIN gold USING (fact_id, tag) GROUP BY fact_id")
fragment("variant_rows", """SELECT config, coalesce(modality, 'pooled') AS modality, count(*) AS n, round(avg(CASE WHEN gold_rank IS NULL THEN 0.0 ELSE 1 END), 6) AS recall,
    round(avg(coalesce(1.0::DOUBLE / gold_rank, 0)), 6) AS mrr FROM (SELECT DISTINCT config FROM variant_ranks) CROSS JOIN facts LEFT JOIN variant_ranks USING (config, fact_id)
    GROUP BY GROUPING SETS ((config, modality), (config))""")


def consolidation(t):
    i = Inputs(t, stored=["rank", "score"])
    gold = frames.gold(t)
    # a candidate is one row with its consensus; the orders of all betas are columns of it, and a fact's gold tags meet it by fact
    bits = agree.pair_bits(i.fused.select("fact_id", "tag", "rank", "fused_score"), i.hyps, i.profiles, CFG, outer=True)
    pool = bits.groupBy("fact_id", "tag").agg(F.first("rank").alias("rank"), F.first("fused_score").alias("fused_score"), F.avg(agree.bits_agree()).alias("consensus"))
    names = {"rank": "plain_rrf"}
    for j, b in enumerate(BETAS):
        pool = ranked(pool.withColumn("final_score", F.col("fused_score") + b * F.col("consensus")), ["fact_id"], rerank_order(), None, f"rank_{j}")
        names[f"rank_{j}"] = f"rrf_consensus_beta_{b:g}"
    summed = fuse.combsum(i.lists, "score").withColumn("covered", F.lit(1))
    ranks = metrics.first_gold(pool, gold, names, 10).join(
        metrics.first_gold(summed, gold, {"rank": "score_normalized_combsum", "covered": "coverage_ceiling"}, 10), "fact_id", "full")
    cells = [F.struct(F.lit(c).alias("config"), F.col(f"`{c}`").alias("gold_rank")) for c in ranks.columns if c != "fact_id"]
    rows = frames.facts(t).join(ranks, "fact_id", "left").select("fact_id", "context_id", "modality", F.inline(F.array(*cells))).withColumns(
        {"recall": F.col("gold_rank").isNotNull().cast("double"), "mrr": F.coalesce(1.0 / F.col("gold_rank"), F.lit(0.0))})
    return metrics.slices(rows, ["recall", "mrr"], ["modality"], keep=["config"]).drop("n_contexts")


@query("M10_consolidation", """SELECT v.*, CASE WHEN v.config = 'coverage_ceiling' THEN 0 ELSE round(c.recall - v.recall, 6) END AS residual_gap
    FROM variant_rows v JOIN (SELECT modality, recall FROM variant_rows WHERE config = 'coverage_ceiling') c USING (modality)""")
def m10(t):
    return metrics.gap_to_ceiling(consolidation(t), "coverage_ceiling", "recall", ["modality"])


@query("M11_best_config", """SELECT arg_max(config, (recall, mrr, -replace(config, 'rrf_consensus_beta_', '')::DOUBLE)) AS winner FROM variant_rows
    WHERE modality = 'pooled' AND config LIKE 'rrf_consensus_beta_%'""")
def m11(t):
    rows = consolidation(t).where((F.col("modality") == "pooled") & F.col("config").startswith("rrf_consensus_beta_"))
    beta = F.replace("config", F.lit("rrf_consensus_beta_"), F.lit("")).cast("double")
    return metrics.best_config(rows, [F.col("recall"), F.col("mrr"), -beta])


fragment("init_ranks", """SELECT 'first' AS config, fact_id, gr1 AS gr, NULL::DOUBLE AS mean_recall FROM (SELECT fact_id, arg_min(coalesce(gold_rank, 99999), list_id) AS gr1 FROM list_ranks WHERE rendering = 'def' GROUP BY fact_id)
    UNION ALL SELECT 'random_one', fact_id, NULL, avg(CASE WHEN gold_rank <= 10 THEN 1.0::DOUBLE ELSE 0 END) FROM list_ranks WHERE rendering = 'def' GROUP BY fact_id
    UNION ALL SELECT 'symbolic', l.fact_id, l.gold_rank, NULL FROM list_ranks l JOIN (SELECT fact_id, hyp_idx FROM decomposed WHERE selected_by_overall) d USING (fact_id, hyp_idx) WHERE rendering = 'def'
    UNION ALL SELECT 'exact_only', l.fact_id, l.gold_rank, NULL FROM list_ranks l JOIN (SELECT fact_id, hyp_idx FROM decomposed WHERE selected_by_exact) d USING (fact_id, hyp_idx) WHERE rendering = 'def'
    UNION ALL SELECT 'lexical_only', l.fact_id, l.gold_rank, NULL FROM list_ranks l JOIN (SELECT fact_id, hyp_idx FROM decomposed WHERE selected_by_lexical) d USING (fact_id, hyp_idx) WHERE rendering = 'def'
    UNION ALL SELECT 'union_rrf', fact_id, rr, NULL FROM rendering_base WHERE rendering = 'def'""")


@query("M12_initialisation", """SELECT config, count(*) AS n, round(avg(coalesce(mean_recall, CASE WHEN gr <= 10 THEN 1.0::DOUBLE ELSE 0 END)), 6) AS recall_at_10 FROM init_ranks GROUP BY config""")
def m12(t):
    i = Inputs(t)
    lists = i.lists.where("rendering = 'def'")
    gold = frames.gold(t)
    ranks = metrics.gold_ranks(lists, gold, ["fact_id", "hyp_idx", "list_id"])
    choice = agree.decompose(own_pairs(i), 10)
    fused = metrics.gold_ranks(fuse.fuse(lists), gold, ["fact_id"])
    return metrics.initialisation(ranks, choice, fused, 10)
