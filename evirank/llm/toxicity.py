"""Toxicity: a factorization machine over hashed terms, trained in numpy on a bounded labelled sample."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from evirank.llm.common import checkpointed, held_out, pieces, text_bytes
from evirank.llm.terms import word_hashes

#: Labelled rows per class that the model is fitted on, and terms it keeps.
ROWS_PER_CLASS = 3000
TERMS = 2048
#: Labelled rows a term must occur in to become a feature.
LEAST_ROWS = 4
FACTORS = 4
STEPS, BATCH = 1500, 256
L2_LINEAR, L2_FACTORS = 1e-4, 1e-2
#: Standard errors by which a term's rates in the two classes must differ to become a feature.
LEAST_Z = 2.5
#: Batches hold both classes equally; the intercept then moves this share of the way to the log odds of all labelled rows.
PRIOR_WEIGHT = 0.5
#: The most frequent terms, whatever their labels, are looked at in pairs: both terms of a pair become features if texts that hold both
#: are toxic more or less often than the two terms alone let expect, by so many standard errors (about the largest of PAIR_TERMS^2 / 2 chance values).
PAIR_TERMS = 2048
LEAST_PAIR_Z = 5.5
SEED = 11


@dataclass
class Machine:
    """score = sigmoid(bias + sum w_i + 1/2 sum_f ((sum v_if)^2 - sum v_if^2)) over the distinct terms of a text."""

    terms: np.ndarray  # sorted uint32 hashes
    w: np.ndarray
    v: np.ndarray
    bias: float

    def __post_init__(self):
        self._maybe = np.zeros(1 << 20, bool)
        self._maybe[self.terms & np.uint32((1 << 20) - 1)] = True

    def features(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, term index), distinct and ordered by row, of all words that are features."""
        hashes, rows = word_hashes(data, offsets)
        maybe = self._maybe[hashes & np.uint32((1 << 20) - 1)]
        hashes, rows = hashes[maybe], rows[maybe]
        at = np.minimum(np.searchsorted(self.terms, hashes), max(len(self.terms) - 1, 0))
        known = self.terms[at] == hashes if len(self.terms) else np.zeros(len(hashes), bool)
        keys = np.unique(rows[known] * np.int64(1 << 20) + at[known])
        return keys >> 20, keys & ((1 << 20) - 1)

    def scores(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        rows, at = self.features(data, offsets)
        n = len(offsets) - 1
        linear = np.bincount(rows, self.w[at], n)
        pairs = np.zeros(n)
        for f in range(self.v.shape[1]):
            column = self.v[:, f].astype(np.float64)[at]
            pairs += np.bincount(rows, column, n) ** 2 - np.bincount(rows, column**2, n)
        return 1 / (1 + np.exp(-np.clip(self.bias + linear + 0.5 * pairs, -30, 30)))


def train(x: np.ndarray, y: np.ndarray, factors: int = FACTORS, steps: int = STEPS, seed: int = SEED) -> tuple[np.ndarray, np.ndarray, float]:
    """Fit w, v, bias by Adam on the logistic loss. x: rows x terms of 0/1."""
    rng = np.random.default_rng(seed)
    n, m = x.shape
    w, v, b = np.zeros(m, np.float32), (0.01 * rng.standard_normal((m, factors))).astype(np.float32), np.zeros(1, np.float32)
    moments = [[np.zeros_like(p), np.zeros_like(p)] for p in (w, v, b)]
    classes = [np.flatnonzero(y == c) for c in (0, 1)]
    for step in range(1, steps + 1):
        rows = np.concatenate([rng.choice(own, BATCH // 2) for own in classes])  # both classes equally
        part = x[rows].astype(np.float32)
        s = part @ v
        z = b[0] + part @ w + 0.5 * ((s * s).sum(1) - part @ (v * v).sum(1))
        g = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y[rows]).astype(np.float32) / len(rows)
        grads = (part.T @ g + L2_LINEAR * w, part.T @ (g[:, None] * s) - (part.T @ g)[:, None] * v + L2_FACTORS * v, np.array([g.sum()], np.float32))
        rate = 0.02 * min(1, 2 * (1 - step / (steps + 1)))
        for p, d, (m1, m2) in zip((w, v, b), grads, moments):
            m1 += 0.1 * (d - m1)
            m2 += 0.001 * (d * d - m2)
            p -= rate * (m1 / (1 - 0.9**step)) / (np.sqrt(m2 / (1 - 0.999**step)) + 1e-8)
    return w, v, float(b[0])


def interacting(x: np.ndarray, y: np.ndarray, least_z: float = LEAST_PAIR_Z) -> np.ndarray:
    """Which columns of x (rows x terms of 0/1) belong to a pair that says more about y than its two terms do.

    Rows are weighted so that both classes count alike. A pair's expected rate is additive, rate(i) + rate(j) - 1/2, kept off 0 and 1:
    a word that is toxic alone makes no pair with the common words beside it."""
    weight = np.where(y > 0, 0.5 / max((y > 0).mean(), 1e-9), 0.5 / max((y <= 0).mean(), 1e-9)).astype(np.float32)
    bits = x.astype(np.float32)
    weighted = bits * weight[:, None]
    both = weighted.T @ bits
    toxic = (weighted * (y > 0)[:, None]).T @ bits
    spread = (weighted * weight[:, None]).T @ bits  # sum of squared weights: the variance of a weighted rate
    each = np.diag(toxic) / np.maximum(np.diag(both), 1e-9)
    expected = np.clip(each[:, None] + each[None, :] - 0.5, 0.02, 0.98)
    z = np.abs(toxic - expected * both) / np.sqrt(np.maximum(spread * expected * (1 - expected), 1e-9))
    z[both <= 0] = 0
    np.fill_diagonal(z, 0)
    return (z >= least_z).any(axis=1)


def _terms(docs: DataFrame) -> DataFrame:
    """docs(row_id, y, text) -> row_id, y, terms array<bigint>: the distinct hashed words of each whole text."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "text"):
            hashes, rows = word_hashes(*text_bytes(batch.column("text")))
            keys = np.unique((rows.astype(np.uint64) << np.uint64(32)) | hashes)
            ends = np.searchsorted(keys, np.arange(batch.num_rows + 1, dtype=np.uint64) << np.uint64(32)).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(ends), pa.array((keys & np.uint64(0xFFFFFFFF)).astype(np.int64)))
            yield pa.RecordBatch.from_arrays([batch.column("row_id"), batch.column("y"), lists], names=["row_id", "y", "terms"])

    kinds = docs.schema
    return docs.select("row_id", "y", "text").mapInArrow(run, T.StructType([kinds["row_id"], kinds["y"], T.StructField("terms", T.ArrayType(T.LongType()))]))


def labelled(labels: DataFrame, column: str, per_class: int) -> tuple[DataFrame, dict[int, int]]:
    """(row_id, y) of at most per_class rows of each class that may be learned from, in hash order, and the class counts of all
    such rows. Ids with differing labels count as the higher one; null ids and labels are left out."""
    usable = labels.where(~held_out("doc_id") & F.col(column).isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(
        (F.max(column) > 0).cast("int").alias("y"))
    counts = {r["y"]: r["n"] for r in usable.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    parts = [usable.where(F.col("y") == y).orderBy(F.xxhash64(F.lit(SEED), "doc_id"), "doc_id").limit(per_class) for y in (0, 1)]
    return parts[0].unionAll(parts[1]).select(F.col("doc_id").alias("row_id"), "y"), counts


def fit(docs: DataFrame, labels: DataFrame, column: str = "toxic", per_class: int = ROWS_PER_CLASS, terms: int = TERMS) -> Machine:
    """A Machine from docs(doc_id, text) and labels(doc_id, <column> 0/1).

    The sample is per_class rows of each class. Features are the terms whose own rates differ, and the terms of interacting() pairs,
    which may be as common in both classes. Terms are counted in Spark, and the driver gets rows x (terms + PAIR_TERMS) bits at
    most, so long texts don't grow what it holds. With one class or none the machine scores that rate."""
    sample, counts = labelled(labels, column, per_class)
    total = sum(counts.values())
    rate = (counts.get(1, 0) + 1) / (total + 2)
    bags = checkpointed(_terms(docs.select("doc_id", "text").join(sample, F.col("doc_id") == F.col("row_id")).select("row_id", "y", "text")))
    by_class = {r["y"]: r["n"] for r in bags.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    n1, n0 = by_class.get(1, 0), by_class.get(0, 0)
    if not n0 or not n1:
        return Machine(np.zeros(0, np.uint32), np.zeros(0), np.zeros((0, FACTORS)), float(np.log(rate / (1 - rate))))
    each = bags.select("y", F.explode("terms").alias("term")).groupBy("term").agg(
        F.sum("y").alias("a"), F.count(F.lit(1)).alias("n")).where(F.col("n") >= LEAST_ROWS)
    gap = F.col("a") / n1 - (F.col("n") - F.col("a")) / n0
    spread = (F.col("n") / (n0 + n1)) * (1 - F.col("n") / (n0 + n1)) + 1e-6
    strength = gap * gap / spread
    each = checkpointed(each)
    alone = {r["term"] for r in each.where(strength >= LEAST_Z**2 * (1 / n0 + 1 / n1)).orderBy(strength.desc(), "term").limit(terms).select("term").collect()}
    frequent = {r["term"] for r in each.orderBy(F.col("n").desc(), "term").limit(PAIR_TERMS).select("term").collect()}
    keys = np.array(sorted(alone | frequent), np.uint32)
    held = docs.sparkSession.sparkContext.broadcast(keys)

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bits = []
            for terms_ in batch.column("terms"):
                mask = np.isin(held.value, np.array(terms_.as_py() or [], np.uint32), kind="sort")
                bits.append(np.packbits(mask).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column("row_id"), batch.column("y"), pa.array(bits, pa.binary())], names=["row_id", "y", "bits"])

    kinds = bags.schema
    rows = bags.mapInArrow(index, T.StructType([kinds["row_id"], kinds["y"], T.StructField("bits", T.BinaryType())])).collect()
    rows.sort(key=lambda r: (r["row_id"], bytes(r["bits"])))
    x = np.stack([np.unpackbits(np.frombuffer(r["bits"], np.uint8), count=len(keys)) for r in rows])
    y = np.array([r["y"] for r in rows], np.float32)
    paired = np.flatnonzero(np.isin(keys, np.array(sorted(frequent), np.uint32)))
    used = np.isin(keys, np.array(sorted(alone), np.uint32))
    used[paired] |= interacting(x[:, paired], y)
    keys, x = keys[used], np.ascontiguousarray(x[:, used])
    w, v, bias = train(x, y)
    bias += PRIOR_WEIGHT * float(np.log(rate / (1 - rate)))
    return Machine(keys, w, v, bias)


def score(docs: DataFrame, machine: Machine, name: str = "score", keep: list[str] | None = None) -> DataFrame:
    """Add the score of the whole text; null and wordless texts get that of a text without terms. Other columns pass through."""
    held = docs.sparkSession.sparkContext.broadcast(machine)
    carried = [f for f in docs.schema.fields if f.name != name and (keep is None or f.name in keep)]
    names = [f.name for f in carried]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "text"):
            found = held.value.scores(*text_bytes(batch.column("text")))
            yield pa.RecordBatch.from_arrays([batch.column(n) for n in names] + [pa.array(found)], names=names + [name])

    return docs.mapInArrow(run, T.StructType(carried + [T.StructField(name, T.DoubleType())]))


def digest(scored: DataFrame, threshold: float = 0.5) -> DataFrame:
    return scored.select("doc_id", held_out("doc_id").alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
