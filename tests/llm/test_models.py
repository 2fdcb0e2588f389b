"""The three trained models: gradients, formulas against brute force, held-out accuracy."""

import os
import random
import zlib
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from evirank.llm import langid, quality_net, queries, terms, toxicity
from evirank.llm.common import held_out, pieces, text_bytes

FOLDER = "/root/testdata/sf0.01"
needs_tables = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="driver tables not present")


def held(doc_id):
    return zlib.crc32(str(doc_id).encode()) % 5 == 0


def check_gradients(params, grads, loss, step):
    for p, g in zip(params, grads):
        at = np.unravel_index(np.abs(g).argmax(), g.shape)
        old = p[at].copy()
        p[at] = old + step
        up = loss()
        p[at] = old - step
        down = loss()
        p[at] = old
        assert abs((up - down) / (2 * step) - g[at]) < 2e-2 * max(1e-2, abs(g[at]))


def test_gru_gradients():
    rng = np.random.default_rng(0)
    net = langid.new_net(["a", "b", "c"], 4)
    net.tables, net.us = [t.astype(float) for t in net.tables], [u.astype(float) for u in net.us]
    net.w, net.b = net.w.astype(float), net.b.astype(float)
    x, y = rng.integers(1, 256, (7, 5)).astype(np.uint8), np.array([0, 1, 2, 1, 0])
    x[5:, 2] = 0
    _, grads = langid.gradients(net, x, y)
    check_gradients(net.params(), grads, lambda: langid.gradients(net, x, y)[0], 1e-3)


def test_gru_pools_every_byte():
    """A text longer than many segments is pooled over all of it: the language of its larger part wins wherever that part stands."""
    rng, small = np.random.default_rng(1), "abcdefg"
    def say(letters, n):
        return "".join(rng.choice(list(letters)) for _ in range(n))

    crops = [(say(small, 40), 0) for _ in range(80)] + [(say("uvwxyz", 40), 1) for _ in range(80)]
    x = np.stack([np.frombuffer(t.encode().ljust(64, b"\0"), np.uint8) for t, _ in crops])
    net = langid.train(["lo", "hi"], x, np.array([y for _, y in crops]), steps=40)
    texts = [say(small, 900) + say("uvwxyz", 2000), say("uvwxyz", 900) + say(small, 2000), ""]
    p = langid.pooled(net, *text_bytes(pa.array(texts)))
    assert p.argmax(axis=1)[:2].tolist() == [1, 0] and 0.55 < p[0, 1] < 0.85 and p[2].sum() == 0


def test_conv_gradients_and_padding():
    net = quality_net.new_net()
    net.bias += 0.05  # away from the kink that zero padding sits on
    texts = [b"hello world " * 20, b"abc def ghi, jkl mno" * 9, b"zz"]
    rows = [quality_net.padded(np.frombuffer(t, np.uint8), np.array([0, len(t)]))[0] for t in texts]
    marks, y, w = [quality_net.repeats(r) for r in rows], np.array([1, 0, 1.0]), np.ones(3)
    _, grads = quality_net.gradients(net, rows, marks, y, w)
    check_gradients(net.params(), grads, lambda: quality_net.gradients(net, rows, marks, y, w)[0], 1e-2)
    alone = [quality_net.scores(net, np.frombuffer(t, np.uint8), np.array([0, len(t)]))[0] for t in texts]
    together = quality_net.scores(net, *text_bytes(pa.array([*texts, b""])))
    assert np.allclose(together[:3], alone, atol=1e-5) and 0 < together[3] < 1


def test_conv_sees_the_whole_text():
    """One odd stretch anywhere in a long text decides."""
    rng = np.random.default_rng(2)
    def plain(n):
        return "".join(rng.choice(list("abcdefgh ")) for _ in range(n))

    texts, y = [], []
    for i in range(240):
        t = plain(int(rng.integers(100, 600)))
        at = int(rng.integers(0, len(t)))
        texts.append((t if i % 2 else t[:at] + "#$#$" * 20 + t[at:]).encode())
        y.append(float(i % 2))
    net = quality_net.train(texts, np.array(y, np.float32), np.ones(240, np.float32), epochs=8)
    long = plain(60000)
    tests = [long, long[:200] + "#$#$" * 20 + long[200:], long[:30000] + "#$#$" * 20 + long[30000:], long + "#$#$" * 20]
    assert (quality_net.scores(net, *text_bytes(pa.array(tests))) > 0.5).tolist() == [True, False, False, False]


def test_repeats():
    x = np.frombuffer(b"Thorble Thorble Thorble and other words", np.uint8)
    got = quality_net.repeats(x)
    want = [any(i >= lag and x[i : i + 8].tobytes() == x[i - lag : i - lag + 8].tobytes() and i + 8 <= len(x) for lag in range(2, 33)) for i in range(len(x))]
    assert got.astype(bool).tolist() == want and sum(want) > 5


def test_terms():
    """Equal words hash alike wherever they stand; rows, prefixes and long rows in parts agree with a plain split."""
    rnd = random.Random(3)
    texts = ["", None, "The the THE", "abcdefgh abcdefxyz", "é-É x"] + [" ".join(rnd.choice(["ab", "Réeuxpa", "x,y", "longerword\n"]) for _ in range(50)) for _ in range(4)]
    hashes, rows = terms.word_hashes(*text_bytes(pa.array(texts)))
    seen = {}
    for i, t in enumerate(texts):
        words = bytes(terms._FOLD[np.frombuffer((t or "").encode(), np.uint8)]).replace(b"\0", b" ").split()
        expected = sorted([w for w in words] + [w[:6] + b"*" for w in words if len(w) > 6])
        own = hashes[rows == i]
        assert len(own) == len(expected)
        for h in own:
            seen.setdefault(int(h), set()).add(i)
    assert len(seen) == len({w for t in texts for x in [bytes(terms._FOLD[np.frombuffer((t or "").encode(), np.uint8)]).replace(b"\0", b" ").split()] for w in x}
                            | {w[:6] + b"*" for t in texts for w in bytes(terms._FOLD[np.frombuffer((t or "").encode(), np.uint8)]).replace(b"\0", b" ").split() if len(w) > 6})
    long = text_bytes(pa.array([" ".join(texts[5:]) * 20]))
    whole, cut = terms.word_hashes(*long)[0], terms.word_hashes(*long, most=500)[0]
    assert sorted(whole.tolist()) == sorted(cut.tolist())


def test_machine_formula():
    rng = np.random.default_rng(4)
    vocabulary = [f"w{i}" for i in range(30)]
    known = np.unique(terms.word_hashes(*text_bytes(pa.array([" ".join(vocabulary)])))[0])
    machine = toxicity.Machine(known, rng.standard_normal(30), rng.standard_normal((30, 3)), 0.3)
    texts = [" ".join(rng.choice(vocabulary + ["other"], 12)) for _ in range(20)] + [None, "", "nothing"]
    got = machine.scores(*text_bytes(pa.array(texts)))
    for text, score in zip(texts, got):
        at = np.searchsorted(known, np.unique(terms.word_hashes(*text_bytes(pa.array([" ".join(w for w in (text or "").split() if w in vocabulary)])))[0]))
        z = 0.3 + machine.w[at].sum() + sum(machine.v[i] @ machine.v[j] for i, j in combinations(at, 2))
        assert abs(score - 1 / (1 + np.exp(-z))) < 1e-6


def test_machine_learns_pairs():
    """Toxic only if an insult meets a group: no sum of single weights can say so once either alone is as common in both classes."""
    rng = np.random.default_rng(5)
    x = (rng.random((3000, 40)) < 0.1).astype(np.uint8)
    x[:, :2] = rng.random((3000, 2)) < 0.5
    y = (x[:, 0] == x[:, 1]).astype(np.float32)
    w, v, b = toxicity.train(x[:2500], y[:2500])
    s = x[2500:].astype(float) @ v
    z = b + x[2500:] @ w + 0.5 * ((s * s).sum(1) - x[2500:] @ (v * v).sum(1))
    assert ((z > 0) == y[2500:]).mean() > 0.95


def test_fit_learns_pairs(spark):
    """The same from texts, through the choice of features: toxic iff insult and group agree, each as common in both classes; one group name is rare."""
    rng = np.random.default_rng(6)
    vocabulary = ["".join(rng.choice(list("abcdefghijkl"), 6)) for _ in range(300)]
    rows = []
    for i in range(3000):
        insult, group, rare = rng.random() < 0.5, rng.random() < 0.5, rng.random() < 0.1
        said = list(rng.choice(vocabulary, 15)) + ["moron"] * insult + ["rarefolk" if rare else "people"] * group
        rng.shuffle(said)
        rows.append((i, " ".join(said), int(insult == group), bool(group and rare)))
    df = spark.createDataFrame(rows, "doc_id bigint, text string, toxic int, rare boolean").repartition(4)
    got = toxicity.digest(toxicity.score(df.select("doc_id", "text"), toxicity.fit(df, df))).toPandas().merge(pd.DataFrame(rows, columns=["doc_id", "text", "toxic", "rare"]), on="doc_id")
    out = got[got.held_out]
    assert len(out) > 500 and (out.predicted == out.toxic).mean() > 0.9
    assert (out[out.rare].predicted == out[out.rare].toxic).mean() > 0.8


def test_pieces_cover_all_rows():
    batch = pa.RecordBatch.from_pydict({"text": ["a" * n for n in (0, 5, 50, 3, 0, 7)], "i": list(range(6))})
    parts = list(pieces(iter([batch.slice(1), batch.slice(0, 0)]), "text", 10))
    assert [i for p in parts for i in p.column("i").to_pylist()] == [1, 2, 3, 4, 5]
    assert all(p.num_rows == 1 or sum(map(len, p.column("text").to_pylist())) <= 10 for p in parts)


@needs_tables
@pytest.mark.parametrize("name, column, least", [("op9_language_id", "lang", 0.95), ("op2_quality_net", "quality", 0.95), ("op10_toxicity", "toxic", 0.93)])
def test_held_out_accuracy(spark, name, column, least):
    got = queries.QUERIES[name](spark, FOLDER).toPandas()
    truth = pd.read_parquet(f"{FOLDER}/{'documents' if column == 'lang' else 'labels'}.parquet")[["doc_id", column]]
    assert len(got) == len(pd.read_parquet(f"{FOLDER}/documents.parquet")) and got.score.between(0, 1).all()
    assert (got.held_out == got.doc_id.map(held)).all()
    both = got.merge(truth, on="doc_id")
    both = both[both.held_out]
    said = both.lang_pred if column == "lang" else both.predicted
    assert (said == both[column]).mean() >= least


def test_odd_rows(spark):
    """Nulls, empty tables, missing classes and clashing columns."""
    rows = [(1, "one text about things", "en"), (2, None, "en"), (3, "", None), (None, "un texte", "fr"), (4, "123 !?", "en"), (1, "one text about things", "en")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string").withColumn("score", F.lit("own")).withColumn("row_id", F.lit(1)).withColumn("y", F.lit(1))
    labels = spark.createDataFrame([(1, 1, 1), (2, None, 0), (None, 0, 0)], "doc_id bigint, quality int, toxic int")
    for module in (quality_net, toxicity):
        out = module.digest(module.score(docs, module.fit(docs, labels)))
        assert out.count() == 6 and out.where("score is null or score < 0 or score > 1").count() == 0
        assert module.digest(module.score(docs.limit(0), module.fit(docs.limit(0), labels.limit(0)))).count() == 0
    assert "score" in toxicity.score(docs, toxicity.fit(docs, labels), "other").columns
    found = langid.identify(docs, langid.fit(docs)).collect()
    assert [r["lang_pred"] for r in found if not r["text"] or r["doc_id"] == 4] == ["und"] * 3
    assert langid.identify(docs.limit(0), langid.fit(docs.limit(0))).count() == 0
    assert {r["lang_pred"] for r in langid.identify(docs, None).collect()} == {"und"}


def test_every_language_trains_on_its_first_documents(spark, monkeypatch):
    """300 languages, one of them hot: each gives the documents first in the seeded order, and none is left out."""
    rows = [(i, f"text {i} of the hot one", "hot") for i in range(2000)] + [(10_000 + i, f"words {i}", f"l{i % 299:03d}") for i in range(1500)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string").repartition(6)
    monkeypatch.setattr(langid, "train", lambda langs, x, y: (langs, x, y))
    langs, x, y = langid.fit(df, 3)
    usable = df.where(~held_out("doc_id")).select("lang", "text", F.xxhash64(F.lit(langid.SEED), "doc_id").alias("o")).toPandas()
    first = usable.sort_values("o").groupby("lang").head(3)
    assert langs == sorted(first.lang.unique()) and len(langs) > 256
    assert sorted(zip(y, (bytes(r).rstrip(b"\0").decode() for r in x))) == sorted((langs.index(a), t[:64]) for a, t in zip(first.lang, first.text) for _ in range(langid.CROPS))
