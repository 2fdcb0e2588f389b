"""Pairs as bits, and the grid of configurations on one row per candidate."""

import re

from pyspark.sql import functions as F

from evirank.operators import agree, metrics, verify
from evirank.plans import frames
from evirank.plans.q_agree import CFG, Inputs, consolidation, k24, k25, k26
from evirank.plans.registry import Tables
from evirank.session import by_fact

FOLDER = "/root/testdata/sf0.001"


def shuffles(spark, make):
    """What the plan deals its rows by, without broadcasts."""
    name = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(name)
    spark.conf.set(name, "-1")
    try:
        plan = make()._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set(name, before)
    return {re.sub(r"#\d+L?", "", x) for x in re.findall(r"hashpartitioning\(([^()]*), \d+\)", plan)}


def test_grid_moves_candidates_to_tags_and_facts_only(spark):
    """Neither configurations nor pairs are dealt: a shuffle by (configuration, fact, tag) writes each candidate once per configuration."""
    assert shuffles(spark, lambda: k25(Tables(spark, FOLDER))) == {"fact_id", "tag"}


def test_gold_tags_meet_lists_by_fact(spark):
    lists = by_fact(spark.createDataFrame([(1, 0, "a", 1), (1, 0, "b", 2), (1, 1, "c", 1), (2, 0, "a", 1)], "fact_id bigint, hyp_idx int, tag string, rank int"))
    gold = spark.createDataFrame([(1, "b"), (1, "c"), (3, "a")], "fact_id bigint, tag string")
    got = metrics.gold_ranks(lists, gold, ["fact_id", "hyp_idx"])
    assert sorted((r.fact_id, r.hyp_idx, r.gold_rank) for r in got.collect()) == [(1, 0, 2), (1, 1, 1), (2, 0, None)]
    assert shuffles(spark, lambda: metrics.gold_ranks(lists, gold, ["fact_id", "hyp_idx"])) == {"fact_id"}


def test_bits_are_the_verdicts_of_the_pairs(spark):
    i = Inputs(Tables(spark, FOLDER))

    def bits(name):
        return sum((F.when(name(d), F.lit(1 << at)).otherwise(F.lit(0)) for at, d in enumerate(agree.JUDGED)), F.lit(0))

    wide = i.pairs.select("fact_id", "tag", "hyp_idx", bits(lambda d: F.col(f"m_{d}")).alias("hit"), bits(lambda d: F.col(f"m_{d}").isNotNull()).alias("ruled"),
                          bits(lambda d: F.col(f"e_{d}").isNotNull()).alias("held"))
    want, got = sorted(map(tuple, wide.collect())), sorted(map(tuple, i.bits.select(*wide.columns).collect()))
    assert got == want and len(got) > 1000 and len({r[3] for r in got}) > 5


def test_variance_weights_of_bits(spark):
    i = Inputs(Tables(spark, FOLDER))
    names = [f"w_{d}" for d in verify.JUDGED_DIMENSIONS]
    held = verify.with_said(i.bits, i.verdicts, weighted=True).select("fact_id", "hyp_idx", *names).distinct()
    both = held.join(verify.variance_weights(i.verdicts).withColumnsRenamed({n: f"v{n}" for n in names}), ["fact_id", "hyp_idx"])
    assert both.count() == held.count() > 100
    assert both.where(F.greatest(*[F.abs(F.col(n) - F.col(f"v{n}")) for n in names]) > 1e-12).count() == 0


def test_grid_keeps_candidates_without_profile_and_facts_without_hypothesis(spark):
    lists = spark.createDataFrame([(1, 1, 0, "def", "a", 1), (1, 1, 0, "def", "x", 2), (1, 2, 0, "lab", "x", 1), (2, 1, 0, "def", "a", 1)],
                                  "fact_id bigint, list_id int, hyp_idx int, rendering string, tag string, rank int")
    concepts = spark.createDataFrame([("a", "red bolt")], "tag string, standard_label string")
    stated = spark.createDataFrame([(1, 0, {"QUALIFIER": "red"})], "fact_id bigint, hyp_idx int, dimensions map<string,string>")
    got = verify.evaluate_grid(
        lists, agree.normalize_hypotheses(stated, CFG), agree.concept_profiles(concepts, CFG, ["tag", "standard_label"]), None,
        [verify.config("both", [0, 1], ["def", "lab"], scaling="raw", beta=1), verify.config("spare", [0], ["lab"], fallback="def", scaling="raw", beta=1)], CFG, 5)
    rows = {(r.config_id, r.fact_id, r.tag): (r["rank"], round(r.consensus, 6), round(r.fused_score, 6), r.fallback_used) for r in got.collect()}
    assert rows == {
        ("both", 1, "a"): (1, 1.0, round(1 / 61, 6), False), ("both", 1, "x"): (2, 0.0, round(1 / 61 + 1 / 62, 6), False), ("both", 2, "a"): (1, 0.0, round(1 / 61, 6), False),
        ("spare", 1, "x"): (1, 0.0, round(1 / 61, 6), False), ("spare", 2, "a"): (1, 0.0, round(1 / 61, 6), True)}


def test_stored_lists_are_the_lists_and_lie_by_fact(spark):
    t = Tables(spark, FOLDER)
    names = ["fact_id", "tag", "list_id", "hyp_idx", "rendering", "rank", "score"]
    stored = frames.stored_rankings(t, ["rank", "score"])
    assert sorted(map(tuple, stored.select(*names).collect())) == sorted(map(tuple, frames.rankings(t).select(*names).collect()))
    assert shuffles(spark, lambda: stored.groupBy("fact_id").count()) == set()


def test_modes_judge_bits(spark):
    assert "m_family" not in k24(Tables(spark, FOLDER))._jdf.queryExecution().optimizedPlan().toString()


def test_single_hypotheses_and_consolidation_deal_no_pairs_or_configurations(spark):
    t = Tables(spark, FOLDER)
    assert not [x for x in shuffles(spark, lambda: k26(t)) if "hyp_idx" in x]
    assert not [x for x in shuffles(spark, lambda: consolidation(t)) if "config" in x and "fact_id" in x]


def test_candidates_are_judged_by_the_hypotheses_they_carry(spark):
    pool = spark.createDataFrame([(1, "a", [(0, 0.5), (2, 0.25)]), (1, "x", [(0, 1.0)])], "fact_id bigint, tag string, _hyps array<struct<hyp_idx:int,fused_score:double>>")
    concepts = spark.createDataFrame([("a", "red bolt")], "tag string, standard_label string")
    stated = spark.createDataFrame([(1, 0, {"QUALIFIER": "red"}), (1, 1, {"QUALIFIER": "hot"})], "fact_id bigint, hyp_idx int, dimensions map<string,string>")
    got = agree.pair_bits(pool, agree.normalize_hypotheses(stated, CFG), agree.concept_profiles(concepts, CFG, ["tag", "standard_label"]), CFG, outer=True)
    at = 1 << agree.JUDGED.index("qualifier")
    assert sorted((r.tag, r.hyp_idx, r.fused_score, r.hit, r.ruled, r.held) for r in got.collect()) == [("a", 0, 0.5, at, at, at), ("a", 2, 0.25, 0, 0, 0), ("x", 0, 1.0, 0, 0, 0)]


def test_first_gold_of_several_orders(spark):
    rows = spark.createDataFrame([(1, "a", 1, 9), (1, "b", 3, 2), (1, "c", 2, 1), (2, "a", 1, 1)], "fact_id bigint, tag string, p int, q int")
    gold = spark.createDataFrame([(1, "a"), (1, "b"), (3, "a")], "fact_id bigint, tag string")
    assert [tuple(r) for r in metrics.first_gold(rows, gold, {"p": "x", "q": "y.1"}, 1).collect()] == [(1, 1, None)]
