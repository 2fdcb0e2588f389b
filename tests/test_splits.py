"""The searches over many attempts against plain loops."""

import hashlib
import random
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from evirank.operators import splits
from tests.test_quotas import greedy

P = splits.PRIME


def number(text):
    return int(hashlib.md5(text.encode()).hexdigest()[:8], 16)


def ordered(keys, seed, attempt):
    a, b = 1 + number(f"{seed}-{attempt}-a") % (P - 1), number(f"{seed}-{attempt}-b") % P
    return sorted(keys, key=lambda k: ((a * (number(str(k)) % P) + b) % P, k))


def shares_gap(left, right):
    def share(c):
        return {k: v / sum(c.values()) for k, v in c.items()} if c else {}
    p, q = share(left), share(right)
    return max((abs(p.get(k, 0) - q.get(k, 0)) for k in {*p, *q}), default=0)


def test_split_search_equals_one_attempt_at_a_time(spark):
    rnd, attempts, n_train, n_test = random.Random(4), 130, 20, 6
    strata = {i: rnd.choice("aaab c".replace(" ", "")) for i in range(60)}
    labels = {i: {f"l{rnd.randint(0, 25)}" for _ in range(rnd.randint(1, 3))} for i in strata if i % 9}
    kinds = {i: Counter(rnd.choices("xyz", k=rnd.randint(1, 4))) for i in strata}
    rows = spark.createDataFrame(list(strata.items()), "sample_id int, stratum string")
    found = splits.split_search(rows, spark.createDataFrame([(i, x) for i, s in labels.items() for x in s], "sample_id int, label string"), 3, attempts, n_train, n_test)
    kind_rows = spark.createDataFrame([(i, k, n) for i, c in kinds.items() for k, n in c.items()], "sample_id int, kind string, n int")
    scores = splits.split_scores(found, kind_rows, n_train, n_test)
    got, got_scores = defaultdict(set), {r["attempt"]: r for r in scores.collect()}
    for r in found.collect():
        got[r["attempt"], r["split"]].add(r["sample_id"])
        assert r["stratum"] == strata[r["sample_id"]]

    def drawn(ids, quotas, seed, attempt):
        return {i for s, q in quotas.items() for i in ordered([i for i in ids if strata[i] == s], seed, attempt)[:q]}

    sizes, best = Counter(strata.values()), None
    for attempt in range(attempts):
        train = drawn(strata, greedy({s: (n, n) for s, n in sizes.items()}, n_train, True), 3, attempt)
        known = set().union(*(labels.get(i, set()) for i in train))
        open_ = [i for i in strata if i not in train and labels.get(i, set()) <= known]
        room = Counter(strata[i] for i in open_)
        test = drawn(open_, greedy({s: (sizes[s], n) for s, n in room.items()}, n_test, True), 1_000_003, attempt)
        assert (got[attempt, "train"], got[attempt, "test"]) == (train, test)
        sides = [[Counter(strata[i] for i in side), Counter(k for i in side for k in kinds[i]), sum((kinds[i] for i in side), Counter())] for side in (train, test)]
        stratum, presence, entity = (shares_gap(x, y) for x, y in zip(*sides))
        score = 10 * abs(len(test) - n_test) / n_test + 5 * abs(len(train) - n_train) / n_train + 4 * stratum + 2 * presence + entity
        assert abs(got_scores[attempt]["score"] - score) < 1e-9
        best = min(best or (9e9, 0), (round(score, 10), attempt))
    assert splits.best_attempt(scores).first()["attempt"] == best[1]

    contexts = spark.createDataFrame([(i, i // 7) for i in strata], "sample_id int, context_id int")
    families = spark.createDataFrame([(i, "concept", x) for i, s in labels.items() for x in s], "sample_id int, family string, label string")
    report = splits.split_report(found, scores, contexts, families).first()
    train, test = got[best[1], "train"], got[best[1], "test"]
    shared = {i // 7 for i in train} & {i // 7 for i in test}
    assert (report["attempt"], report["sample_overlap"], report["missing_concepts"], report["missing_datatypes"]) == (best[1], 0, 0, 0)
    assert report["context_overlap"] == len(shared) and report["passed"] == (not shared and report["max_diff"] <= 0.05)


def test_report_names_what_train_lacks(spark):
    found = spark.createDataFrame([(0, 1, "a", "train"), (0, 2, "a", "test"), (0, 1, "a", "test")], "attempt int, sample_id int, stratum string, split string")
    labels = spark.createDataFrame([(1, "concept", "p"), (2, "concept", "q"), (2, "datatype", "d")], "sample_id int, family string, label string")
    kinds = spark.createDataFrame([(1, "d", 1)], "sample_id int, kind string, n int")
    contexts = spark.createDataFrame([(1, 10), (2, 10)], "sample_id int, context_id int")
    r = splits.split_report(found, splits.split_scores(found, kinds, 1, 2), contexts, labels).first()
    assert (r["sample_overlap"], r["context_overlap"], r["missing_concepts"], r["missing_datatypes"], r["passed"]) == (1, 1, 1, 1, False)


def test_draws_are_the_first_of_each_order_also_with_ties(spark):
    keys = [f"k{i}" for i in range(700)]
    rows = spark.createDataFrame([(k, "g") for k in keys] + [("only", "h")], "sample_id string, stratum string")
    quotas = spark.createDataFrame([("g", 33), ("h", 5)], "stratum string, quota int")
    got = defaultdict(list)
    for r in splits.attempt_draws(rows, splits.attempt_counts(rows, 8, 70), quotas, 8, 70).collect():
        got[r["attempt"], r["stratum"]].append(r["sample_id"])
    for attempt in range(70):
        assert sorted(got[attempt, "g"]) == sorted(ordered(keys, 8, attempt)[:33]) and got[attempt, "h"] == ["only"]


def test_cluster_search_stops_at_the_first_sample_within_all_limits(spark):
    rnd, attempts, target = random.Random(2), 40, 20
    facts = [(m, c, rnd.choice("xyz"), f"c{rnd.randint(0, 30)}") for m, n in (("table", 15), ("text", 25)) for c in range(n) for _ in range(rnd.randint(1, 5))]
    r = splits.cluster_search(spark.createDataFrame(facts, "modality string, context_id int, datatype string, concept string"), 6, attempts, 3, 5, target, 0.1).first()

    def stats(rows):
        contexts = {m: {c for k, c, *_ in rows if k == m} for m in ("table", "text")}
        count = Counter(m for m, *_ in rows)
        return count["table"] / len(rows), Counter(d for _, _, d, _ in rows), [count[m] / len(contexts[m]) for m in contexts], len({x[3] for x in rows}) / len(set().union(*contexts.values()))

    whole, best = stats(facts), None
    for attempt in range(attempts):
        taken = {k for m, n in (("table", 3), ("text", 5)) for k in ordered(sorted({f"{m}:{c}" for k, c, *_ in facts if k == m}), 6, attempt)[:n]}
        rows = [f for f in facts if f"{f[0]}:{f[1]}" in taken]
        s = stats(rows)
        l1 = sum(abs(s[1][d] / len(rows) - whole[1][d] / len(facts)) for d in whole[1])
        deltas = abs(s[0] - whole[0]), l1, max(abs(x - y) / y for x, y in zip(s[2], whole[2])), abs(s[3] - whole[3]) / whole[3]
        score = round(sum(w * d for w, d in zip((1, 0.5, 0.2, 0.2), deltas)) + 0.1 * abs(len(rows) - target) / target, 10)
        if best is None or score < best[0]:
            passed = all(d <= limit for d, limit in zip(deltas, (0.08, 0.15, 0.35, 0.6)))
            best = score, attempt, len(rows), passed
            if passed:
                break
    assert (r["attempt"], r["facts"], r["passed"]) == best[1:] and abs(r["score"] - best[0]) < 1e-8


def test_empty_tables_give_no_attempt(spark):
    none = spark.createDataFrame([], "sample_id int, stratum string")
    found = splits.split_search(none, spark.createDataFrame([], "sample_id int, label string"), 1, 3, 5, 2)
    assert found.count() == 0
    facts = spark.createDataFrame([], "modality string, context_id int, datatype string, concept string")
    assert splits.cluster_search(facts, 1, 3, 2, 2).count() == 0


def test_rows_meet_the_attempts_only_below_the_place_a_quota_needs(spark):
    keys = [f"k{i}" for i in range(3000)]
    rows = spark.createDataFrame([(k, "g") for k in keys], "sample_id string, stratum string")
    quotas = spark.createDataFrame([("g", 4)], "stratum string, quota int")
    counts = splits.attempt_counts(rows, 9, 50)
    assert [r["_n"] for r in counts.collect()] == [3000]  # one row per group, not one per attempt and bucket
    # counts that promise more rows than there are leave every attempt short, so all rows are read
    for known in (counts, counts.withColumn("_n", counts["_n"] * 1000)):
        got = defaultdict(list)
        for r in splits.attempt_draws(rows, known, quotas, 9, 50).collect():
            got[r["attempt"]].append(r["sample_id"])
        for attempt in range(50):
            assert sorted(got[attempt]) == sorted(ordered(keys, 9, attempt)[:4])
    bits = rows.withColumn("open", F.array(F.when(F.col("sample_id") == "k1", 5).otherwise(2).cast("bigint")))
    assert {r["attempt"]: r["_n"] for r in splits.attempt_counts(bits, 9, 3).collect()} == {0: 1, 1: 2999, 2: 1}
