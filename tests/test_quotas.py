"""Quotas in closed form against handing seats out one by one."""

import random

from evirank.operators import splits


def greedy(rows, total, one_each):
    """rows: name -> (weight, cap)."""
    rows = {n: wc for n, wc in rows.items() if wc[1] > 0}
    total = min(total, sum(c for _, c in rows.values()))
    got = {n: int(one_each and total >= len(rows)) for n in rows}
    all_ = sum(w for w, _ in rows.values())
    raw = {n: w / all_ * total for n, (w, _) in rows.items()}
    while sum(got.values()) < total:
        best = max((n for n in rows if got[n] < rows[n][1]), key=lambda n: (raw[n] - got[n], rows[n][0], n))
        got[best] += 1
    return got


def test_quotas_equal_the_greedy_hand_out(spark):
    rnd = random.Random(9)
    for total, one_each in ((1, True), (7, True), (40, False), (400, True), (5000, True)):
        cases, want = [], {}
        for case in range(120):
            rows = {f"n{i}": (rnd.choice([1, 2, 3, 10, 50, 1000]), rnd.choice([0, 1, 2, 5, 30, 400])) for i in range(rnd.randint(1, 9))}
            cases += [(case, n, w, c) for n, (w, c) in rows.items()]
            want |= {(case, n): q for n, q in greedy(rows, total, one_each).items()}
        df = spark.createDataFrame(cases, "case int, name string, weight bigint, room bigint")
        got = {(r["case"], r["name"]): r["quota"] for r in splits.allocate_quotas(df, total, ("case",), "room", one_each).collect()}
        assert got == want


def test_large_quotas_cost_no_rows_per_seat(spark):
    df = spark.createDataFrame([("a", 3_000_000_000), ("b", 1_000_000_000), ("c", 1)], "name string, weight bigint")
    got = {r["name"]: r["quota"] for r in splits.allocate_quotas(df, 2_000_000_000).collect()}
    assert got == {"a": 1_499_999_999, "b": 500_000_000, "c": 1}  # c is forced; the last seat goes to the deficit of 0.9
