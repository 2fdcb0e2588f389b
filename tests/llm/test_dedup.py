"""SimHash components and suffix dedup against brute force."""

import hashlib
import random

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from evirank.llm import bwt, graph, simhash, suffix_dedup


def components_of(links):
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {x: find(x) for x in parent}


def slow_fingerprint(text):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").encode().split()
    shingles = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    values = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(v >> b & 1 for v in values) > len(values))


def test_fingerprint():
    rnd = random.Random(1)
    for n in (0, 1, 2, 3, 4, 50, 700):
        text = " ".join(rnd.choice(["A", "bé", "c d", "\t\n"]) for _ in range(n))
        assert simhash.fingerprint(text.encode()) == slow_fingerprint(text)
    assert simhash.fingerprint(None) == 0


@pytest.mark.parametrize("bucket_rows", [1024, 8])
def test_links_keep_components(spark, monkeypatch, bucket_rows):
    """Families of near fingerprints, chains and loners; with small buckets the second level is taken."""
    monkeypatch.setattr(simhash, "BUCKET_ROWS", bucket_rows)
    rnd = random.Random(4)
    prints = {rnd.getrandbits(64) for _ in range(150)} | {0, (1 << 64) - 1, 7, 1 << 63}
    for seed in list(prints)[:12]:
        family = [seed]
        for _ in range(25):
            near = rnd.choice(family)
            for _ in range(rnd.randint(1, 5)):
                near ^= 1 << rnd.randrange(64)
            family.append(near)
        prints |= set(family)
    prints = sorted(prints)
    signed = [p - (1 << 64) if p >= 1 << 63 else p for p in prints]
    want = components_of([(signed[i], signed[j]) for i in range(len(prints)) for j in range(i) if bin(prints[i] ^ prints[j]).count("1") <= 3])
    found = simhash.links(spark.createDataFrame([(s,) for s in signed], "fp bigint")).collect()
    assert all(bin((a ^ b) & (2**64 - 1)).count("1") <= 3 for a, b in found)
    assert components_of(found) == want
    roots = {r["node"]: r["root"] for r in graph.components(spark.createDataFrame(found, "a bigint, b bigint")).collect()}
    assert roots == want


def test_components_of_a_chain(spark):
    n = 300
    order = list(range(n))
    random.Random(0).shuffle(order)
    links = spark.createDataFrame([(order[i], order[i + 1]) for i in range(n - 1)] + [(5, 5), (1000, 1001), (1001, 1000)], "a bigint, b bigint")
    got = {r["node"]: r["root"] for r in graph.components(links).collect()}
    assert got == {i: 0 for i in range(n)} | {1000: 1000, 1001: 1000}
    assert graph.components(links.limit(0)).count() == 0


def test_one_of_each(spark):
    long = " ".join(f"w{i}" for i in range(400))
    rows = [(5, long, "x"), (3, long, "y"), (3, long, "z"), (9, long + " tail", "x"), (1, "other words here at all", "x"), (None, long, "x"), (7, None, "x"), (8, "", "x"), (None, "quite alone now, really", "x")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, fp string").withColumn("h", F.lit(1)).withColumn("k_id", F.lit(2))
    got = simhash.one_of_each(df)
    assert got.columns == df.columns
    # 3 stays once of the long ones; null and empty texts are copies of each other; a group of null ids alone keeps one
    assert sorted(str(r["doc_id"]) for r in got.collect()) == ["1", "3", "7", "None"]
    assert simhash.one_of_each(df.limit(0)).count() == 0
    table = {(r["doc_id"], r["component_id"]) for r in simhash.digest(simhash.simhash_components(df)).collect()}
    assert {(5, 3), (9, 3), (3, 3), (None, 3), (7, 7), (8, 7), (1, 1), (None, None)} == table


def slow_runs(rows, size=50):
    first, out = {}, []
    for i, text in rows:
        data, key = (text or "").encode(), suffix_dedup.LAST if i is None else i
        for p in range(len(data) - size + 1):
            first[data[p : p + size]] = min(first.get(data[p : p + size], key), key)
    for i, text in rows:
        data, key = (text or "").encode(), suffix_dedup.LAST if i is None else i
        gone = np.zeros(len(data), bool)
        for p in range(len(data) - size + 1):
            if first[data[p : p + size]] < key:
                gone[p : p + size] = True
        spans = int((np.diff(np.concatenate(([0], gone.view(np.int8)))) == 1).sum())
        out.append((i, len(data), int(gone.sum()), spans, hashlib.sha256(np.frombuffer(data, np.uint8)[~gone].tobytes()).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("bucket_bytes", [1500, 1 << 20])
def test_suffix_dedup(spark, bucket_bytes):
    rnd = random.Random(1)
    base = ["".join(rnd.choice("abé ") for _ in range(rnd.randint(0, 400))) for _ in range(30)]
    rows = []
    for i in range(120):
        text = "".join(rnd.choice(base)[a : a + rnd.randint(10, 200)] for a in (rnd.randint(0, 100) for _ in range(rnd.randint(0, 4))))
        rows.append((i if i % 37 else None, text if i % 29 else None))
    rows += rows[:5] + [(200, "x" * 300), (201, "x" * 120), (202, "x" * 60 + "y" * 60), (203, "y" * 49), (204, "ab" * 400)]
    rows += [(400 + i, base[3] + " tail " + str(i)) for i in range(25)] + [(500, "".join(base) * 12)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").withColumn("th", F.lit("clash")).repartition(3)
    got = sorted((tuple(r) for r in suffix_dedup.digest(suffix_dedup.repeated_runs(df, bucket_bytes)).collect()), key=str)
    assert got == slow_runs(rows)
    assert suffix_dedup.repeated_runs(df.limit(0)).count() == 0


def test_merge_equals_sorting():
    rnd = random.Random(6)
    texts = sorted({"".join(rnd.choice("ab") for _ in range(rnd.randint(3, 14))).encode() for _ in range(60)}, key=lambda t: rnd.random())
    width = 14
    rows, lengths = np.zeros((len(texts), width), np.uint8), np.array([len(t) for t in texts])
    for i, t in enumerate(texts):
        rows[i, : len(t)] = np.frombuffer(t, np.uint8)
    parts = [bwt.shard_order(rows[a : a + 13], lengths[a : a + 13], width) for a in range(0, len(texts), 13)]
    row, border = bwt.merge([p[0] for p in parts], 5)
    who = np.concatenate([p[1] + 13 * i for i, p in enumerate(parts)])[row]
    offset = np.concatenate([p[2] for p in parts])[row]
    head = [((texts[w] + b"\0") * 6)[o : o + 5] for w, o in zip(who, offset)]
    assert head == sorted(head)
    assert border.tolist() == [i == 0 or head[i] != head[i - 1] for i in range(len(head))]


def test_earliest_repeat():
    rnd = random.Random(8)
    texts = sorted({"".join(rnd.choice("ab") for _ in range(rnd.randint(6, 20))).encode() for _ in range(80)})
    owner = np.array([rnd.randrange(30) for _ in texts])
    rows, lengths = np.zeros((len(texts), 20), np.uint8), np.array([len(t) for t in texts])
    for i, t in enumerate(texts):
        rows[i, : len(t)] = np.frombuffer(t, np.uint8)
    who, at = bwt.earliest_repeat(rows, lengths, owner, 7, shard_bytes=200)
    want = {(i, p) for i, t in enumerate(texts) for p in range(len(t) - 6) if any(owner[j] < owner[i] and t[p : p + 7] in u for j, u in enumerate(texts))}
    assert set(zip(who.tolist(), at.tolist())) == want
