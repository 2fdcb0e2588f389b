"""Mixing and the pipeline."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from evirank.llm import mixing


def slow_targets(sizes, weights, most=3):
    fixed = {}
    while True:
        rest = sum(sizes.values()) - sum(fixed.values())
        weight = sum(weights[s] for s in sizes if s not in fixed)
        share = {s: rest * weights[s] / weight for s in sizes if s not in fixed}
        over = {s: most * sizes[s] for s, v in share.items() if v > most * sizes[s]}
        if not over:
            return {**fixed, **share}
        fixed |= over


def test_targets():
    rnd = random.Random(1)
    for _ in range(50):
        sizes = {f"s{i}": rnd.choice([1, 10, 1000, 0]) + rnd.randrange(5) for i in range(6)}
        weights = {s: i % 3 + 1 for i, s in enumerate(sizes)}
        got, want = mixing.targets(sizes, weights), slow_targets(sizes, weights)
        assert all(abs(got[s] - want[s]) < 1e-6 for s in sizes) and all(got[s] <= 3 * sizes[s] + 1e-9 for s in sizes)


def test_min_cost_flow_is_cheapest():
    """Against all whole-number flows of small cases."""
    rnd = random.Random(2)
    for _ in range(30):
        patterns = {("a",): rnd.randint(0, 3), ("b",): rnd.randint(0, 3), ("a", "b"): rnd.randint(0, 3)}
        quotas = {"a": rnd.randint(0, 6), "b": rnd.randint(0, 6)}
        got = mixing.min_cost_flow(patterns, quotas)
        unit = lambda n, flow: sum(max(0, min(n, flow - k * n)) * c for k, c in enumerate(mixing.COPY_COSTS))
        best = (-1, 0)
        for fa, fb, fab in itertools.product(*(range(3 * n + 1) for n in patterns.values())):
            for to_a in range(fab + 1):
                if fa + to_a <= quotas["a"] and fb + fab - to_a <= quotas["b"]:
                    cost = unit(patterns["a",], fa) + unit(patterns["b",], fb) + unit(patterns["a", "b"], fab)
                    best = max(best, (fa + fb + fab, -cost))
        cost = sum(unit(patterns[p], got[p]) for p in patterns)
        assert abs(sum(got.values()) - best[0]) < 1e-6 and abs(cost + best[1]) < 1e-6


@pytest.fixture(scope="module")
def sourced(spark):
    rnd = random.Random(3)
    rows = [(i, "w " * rnd.randint(0, 40), rnd.choice(["hot"] * 6 + ["a", "b", None])) for i in range(900)]
    rows += [(2000, None, "a"), (2001, "", None), (None, "x y z", "b"), (2002, "only", "one")] + rows[:5]
    return spark.createDataFrame(rows, "doc_id bigint, text string, source string").withColumn("_source", F.lit("own"))


def test_mix_meets_targets(spark, sourced):
    got = mixing.mix_documents(sourced.repartition(5)).collect()
    again = mixing.mix_documents(sourced.repartition(2)).collect()
    assert sorted(map(str, got)) == sorted(map(str, again)) and len(got) == sourced.count()
    by_source = {}
    for r in got:
        assert r["taken"] <= 3 * r["size"] and (r["size"] == 0 or r["taken"] % r["size"] == 0)
        by_source.setdefault((r["source_size"], r["target"]), []).append(r)
    sizes = {r["source"]: r["n"] for r in sourced.withColumn("n", mixing.n_words(F.col("text"))).groupBy("source").agg(F.sum("n").alias("n")).collect()}
    order = sorted(s for s in sizes if s is not None) + [None]
    want = slow_targets(sizes, {s: i % 3 + 1 for i, s in enumerate(order)})
    assert sorted(round(t, 3) for _, t in by_source) == sorted(round(t, 3) for t in want.values())
    for (_, target), rows in by_source.items():
        assert abs(sum(r["taken"] for r in rows) - target) <= max(3, 0.01 * target)
    assert mixing.mix_documents(sourced.limit(0)).count() == 0


def first_fit(rows, rest, base, passes=mixing.PASSES, most=3):
    """Plain scan in hash order: past rows that don't fit; then one copy of the nearest row."""
    import hashlib
    order = sorted(range(len(rows)), key=lambda i: (hashlib.md5(f"{mixing.SEED}-{rows[i][0]}".encode()).hexdigest(), rows[i][0], rows[i][2]))
    gap, more = rest, [0] * len(rows)
    for i in order:
        if 0 < rows[i][2] <= gap:
            more[i], gap = 1, gap - rows[i][2]
    near = [(abs(rows[i][2] - gap), more[i], at, i) for at, i in enumerate(order) if rows[i][2] > 0 and base + more[i] < most and abs(rows[i][2] - gap) < gap]
    if near:
        more[min(near)[3]] += 1
    return [base + m if r[2] else 0 for m, r in zip(more, rows)]


def test_selection_goes_past_large_rows(spark):
    """A document of a quarter of its source doesn't keep smaller ones behind it out; as the plain scan of the whole order."""
    rnd = random.Random(9)
    for trial in range(4):
        rows = [(i, ["a"], rnd.choice([1, 5, 20, 60]) + rnd.randrange(4)) for i in range(60)]
        rows.append((100, ["a"], sum(r[2] for r in rows) // 3))
        total = sum(r[2] for r in rows)
        rows += [(200 + i, ["b"], 10) for i in range(total // 10)]
        rows = [(i + 1000 * trial, m, n) for i, m, n in rows]
        df = spark.createDataFrame(rows, "id bigint, members array<string>, size bigint").repartition(3)
        mixed, wanted = mixing.mix(df, weights={"a": 1, "b": 2})
        target = {r["source"]: r["target"] for r in wanted.collect()}
        got = {r["id"]: r["copies"] for r in mixed.collect()}
        own = [r for r in rows if r[1] == ["a"]]
        taken = sum(r[2] * got[r[0]] for r in own)
        assert abs(taken - target["a"]) <= 0.02 * target["a"]
        base, rest = mixing._shared_out(target["a"], total)
        want = first_fit(own, rest, base)
        exact = sum(r[2] * c for r, c in zip(own, want))
        assert abs(taken - target["a"]) <= abs(exact - target["a"]) + mixing.CLOSE * target["a"]


def test_overlapping_sources(spark):
    rows = [(i, ["a", "b"] if i % 2 else ["a"], 10) for i in range(200)]
    mixed, wanted = mixing.mix(spark.createDataFrame(rows, "id bigint, members array<string>, size bigint"), weights={"a": 1, "b": 1})
    taken = {r["m"]: r["t"] for r in mixed.groupBy(F.array_join("members", ",").alias("m")).agg(F.sum(F.col("size") * F.col("copies")).alias("t")).collect()}
    assert abs(sum(taken.values()) - 2000) <= 20 and taken["a,b"] >= 1000, "only rows of both can fill b"
    assert {r["source"] for r in wanted.collect()} == {"a", "b"}


def test_stages_keep_columns(spark, tmp_path):
    """Odd rows and clashing column names go through every stage; each stage's decision takes effect."""
    bench = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda"
    spark.createDataFrame([(1, bench)], "item_id bigint, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    rnd = random.Random(4)
    say = lambda n: " ".join("".join(rnd.choice("abcdefghij") for _ in range(rnd.randint(2, 8))) for _ in range(n))
    auf = lambda n: " ".join("".join(rnd.choice("uvwxyzäöü") for _ in range(rnd.randint(2, 8))) for _ in range(n))
    rows = [(i, say(60) if i % 2 else auf(60), "en" if i % 2 else "de", f"s{i % 3}", 1) for i in range(120)]
    rows += [(300, rows[7][1], "en", "s1", 1), (301, say(30) + " " + bench.upper() + " " + say(30), "en", "s1", 1), (302, say(40) + " me@site.org", "en", "s2", 1),
             (303, None, "en", "s1", 1), (304, "", None, None, None), (305, "12345 67", "en", "s1", 1), (None, say(50), None, None, None), rows[3]]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    for extra in ("score", "lang_pred", "n_hit", "items", "spans", "simhash", "fp", "h", "copies", "members", "_source"):
        docs = docs.withColumn(extra, F.lit("own"))
    kept, left = docs, {}
    for name, stage in corpus_pipeline.STAGES:
        out = corpus_pipeline.written(spark, stage(spark, kept, str(tmp_path)), name)
        assert sorted(out.columns) == sorted(docs.columns), name
        left[name] = {r["doc_id"]: r["text"] for r in out.select("doc_id", "text").collect()}
        assert out.where("score <> 'own' or spans <> 'own'").count() == 0
        kept = out
    ids = {name: set(found) for name, found in left.items()}
    every = {r[0] for r in rows}
    assert ids["language_id"] == every - {303, 304, 305}
    assert ids["near_dedup"] == ids["language_id"] - {300}
    assert ids["decontamination"] == ids["near_dedup"] - {301}
    assert ids["pii"] == ids["decontamination"] and left["pii"][302].endswith(" <email>")
    assert ids["mixing"] <= ids["pii"] and kept.where("copies between 1 and 3").count() == kept.count() > 50
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), str(tmp_path)).count() == 0, name
