"""Judged candidates stay with their fact."""

import random
import re

from pyspark.sql import functions as F

from evirank.operators import agree, rounds
from evirank.plans.q_agree import Inputs, k5, k24
from evirank.plans.registry import Tables
from evirank.session import looked_up


def test_modes_move_no_row_by_fact_and_more(spark):
    """Only sales go to facts, candidates to tags and back, hypotheses and verdicts to facts: nothing is dealt by (fact, hypothesis, tag)."""
    name = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(name)
    spark.conf.set(name, "-1")
    try:
        plan = k24(Tables(spark, "/root/testdata/sf0.001"))._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set(name, before)
    assert re.search(r"hashpartitioning\(fact_id#\d+L?, \d+\)", plan)
    assert not re.search(r"hashpartitioning\((fact_id#\d+L?, \w+#|\w+#\d+L?, fact_id#)", plan)


def test_look_up_is_a_left_join(spark):
    rows = spark.createDataFrame([(1, 0, "a"), (1, 1, "a"), (1, 0, "b"), (2, 0, "a"), (3, 0, "a")], "fact_id bigint, hyp_idx int, tag string")
    table = spark.createDataFrame([(1, 0, "a", True, 1.0), (1, 1, "a", None, 2.0), (2, 0, "b", True, 3.0), (4, 0, "a", True, 4.0)],
                                  "fact_id bigint, hyp_idx int, tag string, m boolean, w double")
    keys = ["hyp_idx", "tag"]
    want = rows.join(table, ["fact_id", *keys], "left").select("fact_id", *keys, "m", "w")
    assert sorted(map(str, looked_up(rows, table, keys, ["m", "w"]).collect())) == sorted(map(str, want.collect()))
    wide = looked_up(rows.withColumn("hyp_idx", F.col("hyp_idx").cast("bigint")), table, keys, ["m", "w"])
    assert wide.where("m").count() == want.where("m").count() == 1


def test_memories_in_blocks_are_the_nearest_of_all(spark, monkeypatch):
    monkeypatch.setattr(rounds, "MEMORY_BLOCK", 7)
    rnd = random.Random(3)

    def row(i):
        return f"q{i}", i % 9, rnd.choice(["table", "text"]), rnd.choice(["d1", "d2", "d3"]), rnd.random() < 0.6, rnd.sample("abcdefghijkl", rnd.randint(0, 5))

    asked, known = [row(i) for i in range(40)], [r for r in map(row, range(100, 160)) if r[3] != "d3"]
    schema = "{0} string, source int, modality string, datatype string, positive boolean, tokens array<string>"
    found = rounds.nearest_memories(spark.createDataFrame(asked, schema.format("query_id")).drop("positive"), spark.createDataFrame(known, schema.format("memory_id")), 3)
    got = {(r["query_id"], r["positive"], r["place"]): (r["memory_id"], round(r["similarity"], 10)) for r in found.collect()}
    want = {}
    for q, source, modality, kind, _, words in asked:
        pool = [m for m in known if m[2] == modality and m[1] != source]
        pool = [m for m in pool if m[3] == kind] or pool
        for sign in (True, False):
            scored = [(-round(len({*words} & {*m[5]}) / max(len({*words} | {*m[5]}), 1), 10), m[0]) for m in pool if m[4] == sign]
            want |= {(q, sign, i + 1): (m, -s) for i, (s, m) in enumerate(sorted(scored)[:3])}
    assert got == want


def test_stated_verdicts_are_the_rows_of_the_pairs(spark):
    """Each resolved dimension is judged as a row of its own; the wide form of the pairs is not computed for it."""
    t = Tables(spark, "/root/testdata/sf0.001")
    i = Inputs(t)
    want = agree.verdict_rows(i.pairs, ["fact_id", "hyp_idx", "tag"]).drop("exact").withColumn("confidence", F.round("confidence", 6))
    got = k5(t)
    assert sorted(map(str, got.collect())) == sorted(map(str, want.select(*got.columns).collect()))
    assert "m_family" not in got._jdf.queryExecution().optimizedPlan().toString()


def test_one_split_of_facts_or_concepts_is_not_one_task(spark):
    i = Inputs(Tables(spark, "/root/testdata/sf0.001"))
    assert i.hyps.rdd.getNumPartitions() > 1 and i.profiles.rdd.getNumPartitions() > 1
