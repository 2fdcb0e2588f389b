"""N-gram Jaccard join against all pairs."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from evirank.llm import jaccard


def slow_set(text):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").encode().split()
    return {b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))} if words else set()


def slow_components(rows, percent=90):
    sets, parent = [slow_set(t) for _, t in rows], list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    links = set()
    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                parent[find(i)] = find(j)
                links.add((j, i))
    least = {}
    for i, (doc_id, _) in enumerate(rows):
        if doc_id is not None:
            least[find(i)] = min(least.get(find(i), doc_id), doc_id)
    out = [(d, len(sets[i]), d if not sets[i] else least.get(find(i))) for i, (d, _) in enumerate(rows)]
    return sorted(out, key=str), links


def words(rnd, n, vocabulary=5000):
    return [f"w{rnd.randrange(vocabulary)}" for _ in range(n)]


def edited(rnd, base, edits):
    out = list(base)
    for _ in range(edits):
        at = rnd.randrange(len(out))
        kind = rnd.randrange(3)
        out[at : at + (kind != 1)] = [f"e{rnd.randrange(10**6)}"] if kind < 2 else []
    return out


def planted_rows():
    rnd = random.Random(2)
    texts = [" ".join(words(rnd, rnd.randint(0, 60))) for _ in range(40)]
    passage = words(rnd, 120)
    for n, copies in ((9, 6), (11, 8), (13, 8), (22, 10), (40, 12), (90, 12), (400, 15), (1500, 8)):
        base = words(rnd, n)
        family = [base]
        for _ in range(copies):  # chains: each copy is an edit of some earlier one
            family.append(edited(rnd, rnd.choice(family), rnd.choice([0, 1, 1, 2, max(1, n // 60), max(1, n // 40)])))
        texts += [" ".join(f) for f in family]
    texts += [" ".join(passage + words(rnd, rnd.choice([4, 15, 30]))) for _ in range(40)]  # one passage, own endings
    texts += [" ".join(words(rnd, 30, 2)) for _ in range(10)] + ["", " \t", None, None, "One", "one", "one two", "One TWO", "one two three", "é é é", "x " * 500, "x x x"]
    rows = [(i if i % 31 else None, t) for i, t in enumerate(texts)]
    rnd.shuffle(rows)
    return rows + rows[:4] + [(3, texts[60] + " end"), (3, "a text of its own under an id that repeats")]


@pytest.mark.parametrize("growth", [jaccard.GROWTH, 4.0])
def test_components_equal_all_pairs(spark, monkeypatch, growth):
    """Families by chains of edits, a shared passage, short and tiny texts, nulls, repeated rows, one id with several texts."""
    monkeypatch.setattr(jaccard, "GROWTH", growth)
    rows = planted_rows()
    df = spark.createDataFrame(rows, "doc_id bigint, text string").withColumn("n", F.lit(0)).withColumn("node", F.lit("x")).repartition(3)
    want, links = slow_components(rows)
    assert len(links) > 150
    got = sorted((tuple(r) for r in jaccard.jaccard_components(df).collect()), key=str)
    assert got == want
    assert jaccard.jaccard_components(df.limit(0)).count() == 0


def test_linked_sets_share_their_rarest_segments():
    """For pairs just within reach, at every size: the segments kept under any order of rarity have one in common."""
    rnd = np.random.default_rng(1)
    for size in [*range(9, 60), 100, 151, 152, 500, 2000, 30_000]:
        for _ in range(6):
            x = np.unique(rnd.integers(0, 1 << 63, size, dtype=np.uint64))
            gone = int(rnd.integers(0, size // 10 + 1))
            room = (10 * (size - gone) - 9 * size) // 9  # additions that keep 100 * shared >= 90 * union
            y = np.unique(np.concatenate([x[rnd.permutation(size)[gone:]], rnd.integers(0, 1 << 63, max(0, room), dtype=np.uint64)]))
            if np.array_equal(x, y):
                continue
            shared = len(np.intersect1d(x, y))
            assert 100 * shared >= 90 * (len(x) + len(y) - shared)
            order = int(rnd.integers(1, 1 << 62))

            def rarest(elements):
                sigs = jaccard.signatures(elements)
                return {k for _, need, keys in sigs for k in sorted(keys.tolist(), key=lambda k: k * order % (1 << 61))[: len(keys) - max(need - 1, 0)]}

            assert rarest(x) & rarest(y)


def test_sets_with_empty_segments():
    """Elements crowded into one fragment of the first order: further orders are tried, and such sets still meet."""
    x = np.arange(1, 31, dtype=np.uint64)
    y = np.arange(1, 32, dtype=np.uint64)
    a, b = jaccard.signatures(x), jaccard.signatures(y)
    assert a[0][1] < 1 <= a[-1][1]
    assert {k for *_, keys in a for k in keys.tolist()} & {k for *_, keys in b for k in keys.tolist()}


def test_a_large_family_costs_few_pairs(spark, monkeypatch):
    """600 near copies of one text: the pairs that are checked stay near one per copy, not near all 180,000."""
    rnd = random.Random(7)
    base = words(rnd, 300)
    rows = [(i, " ".join(edited(rnd, base, rnd.choice([1, 2])))) for i in range(600)]
    checked = []
    plain = jaccard._linked

    def counted(pairs, *rest):
        checked.append(pairs.count())
        return plain(pairs, *rest)

    monkeypatch.setattr(jaccard, "_linked", counted)
    got = {r.component_id for r in jaccard.jaccard_components(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert got == {0}
    assert sum(checked) < 20 * 600
