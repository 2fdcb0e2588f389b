"""Language ID: a bidirectional gated recurrent network over bytes, trained in numpy by backpropagation through time."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from evirank.llm.common import held_out, pieces, tag, text_bytes

HIDDEN = 12
#: Training: documents per language, crops per document, code points per crop, bytes per crop, steps.
DOCS_PER_LANG, CROPS, CROP_CHARS, CROP_BYTES, STEPS, BATCH = 400, 4, 64, 64, 300, 256
#: Buckets of the seeded hash that choose training documents; the counts of a language's buckets say where its first documents end.
BUCKET_BITS = 16
#: Scoring: bytes per segment, bytes of context on either side, segments side by side.
SEGMENT, CONTEXT, WIDE = 128, 12, 2048
UNKNOWN = "und"
SEED = 5


@dataclass
class Net:
    """Per direction: table (3H x 256, input weights and biases by byte), u (3H x H). Output: w (C x 2H), b (C)."""

    langs: list[str]
    tables: list[np.ndarray]
    us: list[np.ndarray]
    w: np.ndarray
    b: np.ndarray

    def params(self) -> list[np.ndarray]:
        return [*self.tables, *self.us, self.w, self.b]


def new_net(langs: list[str], hidden: int = HIDDEN, seed: int = SEED) -> Net:
    rng = np.random.default_rng(seed)
    def some(*shape, scale):
        return (scale * rng.standard_normal(shape)).astype(np.float32)

    return Net(langs, [some(3 * hidden, 256, scale=0.5) for _ in "fb"], [some(3 * hidden, hidden, scale=0.4) for _ in "fb"],
               some(len(langs), 2 * hidden, scale=0.1), np.zeros((len(langs), 1), np.float32))


def _cell(table: np.ndarray, u: np.ndarray, h: np.ndarray, x: np.ndarray) -> tuple:
    """One step for many sequences: x holds a byte per sequence, h is hidden x sequences. Gates are clipped lines, the candidate a softsign."""
    n = h.shape[0]
    a, uh = np.take(table, x, axis=1), u @ h
    gates = a[: 2 * n]
    gates += uh[: 2 * n]
    gates *= 0.2
    gates += 0.5
    np.clip(gates, 0, 1, out=gates)
    z, r = gates[:n], gates[n:]
    c = a[2 * n :]
    c += r * uh[2 * n :]
    c /= 1 + np.abs(c)
    new = c - h
    new *= z
    new += h
    return new, z, r, c, uh[2 * n :]


def _softmax(logits: np.ndarray) -> np.ndarray:
    e = np.exp(logits - logits.max(axis=0))
    return e / e.sum(axis=0)


def gradients(net: Net, x: np.ndarray, y: np.ndarray) -> tuple[float, list[np.ndarray]]:
    """Mean cross entropy over the non-zero bytes of x (time x sequences) with a label per sequence, and its gradients."""
    steps, n = x.shape
    hidden = net.us[0].shape[1]
    states, saved = [], []
    for d in (0, 1):
        h, out, kept = np.zeros((hidden, n), np.float32), np.empty((steps, hidden, n), np.float32), [None] * steps
        for t in range(steps) if d == 0 else range(steps - 1, -1, -1):
            new, z, r, c, uc = _cell(net.tables[d], net.us[d], h, x[t])
            kept[t] = (h, z.copy(), r.copy(), c.copy(), uc.copy())
            out[t] = h = new
        states.append(out)
        saved.append(kept)
    both = np.concatenate(states, axis=1).transpose(1, 0, 2).reshape(2 * hidden, -1)
    p = _softmax(net.w @ both + net.b)
    mask = (x.reshape(-1) != 0).astype(np.float32)
    scale = mask / max(mask.sum(), 1)
    target = np.tile(y, steps)
    at = np.arange(len(target))
    loss = float(-(np.log(p[target, at] + 1e-9) * scale).sum())
    g = p
    g[target, at] -= 1
    g *= scale
    d_both = (net.w.T @ g).reshape(2 * hidden, steps, n)
    d_tables, d_us = [], []
    flat = x.reshape(-1)
    for d in (0, 1):
        dh, du = np.zeros((hidden, n), np.float32), np.zeros_like(net.us[d])
        inputs = np.empty((steps, 3 * hidden, n), np.float32)
        for t in range(steps - 1, -1, -1) if d == 0 else range(steps):
            h, z, r, c, uc = saved[d][t]
            dh = dh + d_both[d * hidden : (d + 1) * hidden, t]
            dz = dh * (c - h) * 0.2 * ((z > 0) & (z < 1))
            dc = dh * z * (1 - np.abs(c)) ** 2
            dr = dc * uc * 0.2 * ((r > 0) & (r < 1))
            inputs[t] = np.concatenate((dz, dr, dc))
            da = np.concatenate((dz, dr, dc * r))
            du += da @ h.T
            dh = dh * (1 - z) + net.us[d].T @ da
        rows = inputs.transpose(1, 0, 2).reshape(3 * hidden, -1)
        d_tables.append(np.stack([np.bincount(flat, row, 256) for row in rows]).astype(np.float32))
        d_us.append(du)
    return loss, [*d_tables, *d_us, g @ both.T, g.sum(axis=1, keepdims=True)]


def train(langs: list[str], x: np.ndarray, y: np.ndarray, steps: int = STEPS, hidden: int = HIDDEN, seed: int = SEED) -> Net:
    """x: crops x bytes (0 pads), y: index of the language. Batches draw all languages equally; Adam."""
    net, rng = new_net(langs, hidden, seed), np.random.default_rng(seed)
    moments = [[np.zeros_like(p), np.zeros_like(p)] for p in net.params()]
    by_lang = [np.flatnonzero(y == i) for i in range(len(langs))]
    for step in range(1, steps + 1):
        pick = np.concatenate([rng.choice(own, -(-BATCH // len(langs))) for own in by_lang])
        _, grads = gradients(net, x[pick].T, y[pick])
        norm = np.sqrt(sum(float((g * g).sum()) for g in grads))
        rate = 0.02 * min(1, 3 * (1 - step / (steps + 1)))
        for p, g, (m1, m2) in zip(net.params(), grads, moments):
            g = g * min(1, 1 / (norm + 1e-9))
            m1 += 0.1 * (g - m1)
            m2 += 0.01 * (g * g - m2)
            p -= rate * (m1 / (1 - 0.9**step)) / (np.sqrt(m2 / (1 - 0.99**step)) + 1e-8)
    return net


def _segment_sums(net: Net, x: np.ndarray) -> np.ndarray:
    """x: (CONTEXT + SEGMENT + CONTEXT) x segments -> classes x segments: probabilities summed over the segment's own non-zero bytes."""
    hidden, n = net.us[0].shape[1], x.shape[1]
    forward = np.empty((SEGMENT, hidden, n), np.float32)
    h = np.zeros((hidden, n), np.float32)
    for t in range(CONTEXT + SEGMENT):
        h = _cell(net.tables[0], net.us[0], h, x[t])[0]
        if t >= CONTEXT:
            forward[t - CONTEXT] = h
    total = np.zeros((len(net.langs), n), np.float32)
    wf, wb = net.w[:, :hidden], net.w[:, hidden:]
    h = np.zeros((hidden, n), np.float32)
    for t in range(x.shape[0] - 1, CONTEXT - 1, -1):
        h = _cell(net.tables[1], net.us[1], h, x[t])[0]
        if t < CONTEXT + SEGMENT:
            p = _softmax(wf @ forward[t - CONTEXT] + wb @ h + net.b)
            p *= x[t] != 0
            total += p
    return total


def pooled(net: Net, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """rows x classes: position probabilities averaged over each whole row. Segments never cross rows; NUL bytes count as nothing."""
    sizes = np.diff(offsets)
    count = -(-sizes // SEGMENT)
    row = np.repeat(np.arange(len(sizes)), count)
    first = offsets[:-1][row] + SEGMENT * (np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count))
    sums = np.zeros((len(sizes), len(net.langs)))
    steps = np.arange(-CONTEXT, SEGMENT + CONTEXT)[:, None]
    for at in range(0, len(row), WIDE):
        r = row[at : at + WIDE]
        places = first[at : at + WIDE][None, :] + steps
        inside = (places >= offsets[:-1][r]) & (places < offsets[1:][r])
        x = np.where(inside, data[np.clip(places, 0, len(data) - 1)], 0).astype(np.uint8)
        own = _segment_sums(net, x)
        for c in range(len(net.langs)):
            sums[:, c] += np.bincount(r, own[c], len(sizes))
    return sums / np.maximum(sums.sum(axis=1, keepdims=True), 1e-9)


def fit(docs: DataFrame, docs_per_lang: int = DOCS_PER_LANG) -> Net | None:
    """A Net from docs(doc_id, text, lang): crops of a bounded number of documents per language (first in the order of a seeded
    hash), held-out ids, null languages and texts without a letter left out. Every language gets an output. None if nothing is left."""
    usable = docs.where(~held_out("doc_id") & F.col("lang").isNotNull() & F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)))
    crops = F.array(*[F.substring("text", (1 + F.pmod(F.xxhash64(F.lit(SEED + k), "doc_id"), F.greatest(F.length("text") - CROP_CHARS, F.lit(1)))).cast("int"), F.lit(CROP_CHARS)) for k in range(CROPS)])
    order, bucket = f"o_{tag()}", f"b_{tag()}"
    hashed = usable.select("lang", F.xxhash64(F.lit(SEED), "doc_id").alias(order), crops.alias("crops")).withColumn(
        bucket, F.shiftright(order, 64 - BUCKET_BITS))
    # counts are summed before they are shuffled; a language's documents themselves meet no common task
    counts = hashed.groupBy("lang", bucket).agg(F.count(F.lit(1)).alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("lang").orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ends = counts.withColumn("n0", before).where(F.col("n0") < docs_per_lang).groupBy("lang").agg(F.max(bucket).alias("end"))
    # one row a language, fewer than the training rows collected below
    near = hashed.join(F.broadcast(ends), "lang").where(F.col(bucket) <= F.col("end")).drop("end")
    order_in = Window.partitionBy("lang").orderBy(order, F.col("crops")[0])
    # near holds the first documents and the rest of the last bucket
    ranked = near.withColumn("place", F.row_number().over(order_in)).where(F.col("place") <= docs_per_lang)
    rows = ranked.select("lang", order, "crops").collect()  # DOCS_PER_LANG x CROPS short strings a language
    langs = sorted({r["lang"] for r in rows})
    index = {name: i for i, name in enumerate(langs)}
    x, y = [], []
    for r in sorted(rows, key=lambda r: (r["lang"], r[order], r["crops"])):
        for crop in r["crops"]:
            raw = crop.encode()[:CROP_BYTES]
            if raw.strip(b"\0"):
                x.append(np.frombuffer(raw.ljust(CROP_BYTES, b"\0"), np.uint8))
                y.append(index[r["lang"]])
    if not x:
        return None
    found = np.array(y)
    langs_seen = [i for i in range(len(langs)) if (found == i).any()]
    return train([langs[i] for i in langs_seen], np.stack(x), np.searchsorted(langs_seen, found))


def identify(docs: DataFrame, net: Net | None, keep: list[str] | None = None, names: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """Add two columns (lang_pred and score, or other `names`) to docs(.., text): the language with the largest probability pooled over every byte of the text.

    `und` with score 0 if the text is null or has no letter (or no language could be learned). Ties go to the language first in order.
    Other columns pass through, columns of the two names are replaced."""
    carried = [f for f in docs.schema.fields if f.name not in names and (keep is None or f.name in keep)]
    own = [f.name for f in carried]
    letter = f"letter_{tag()}"
    held = docs.sparkSession.sparkContext.broadcast(net)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = held.value
        for batch in pieces(batches, "text"):
            known = np.array(batch.column(letter).to_pylist(), bool)
            langs, scores = [UNKNOWN] * batch.num_rows, np.zeros(batch.num_rows)
            if net is not None:
                p = pooled(net, *text_bytes(batch.column("text")))
                best = p.argmax(axis=1)
                langs = [net.langs[b] if k else UNKNOWN for b, k in zip(best, known)]
                scores = np.where(known, np.clip(p[np.arange(len(best)), best], 0, 1), 0.0)
            yield pa.RecordBatch.from_arrays([batch.column(n) for n in own] + [pa.array(langs), pa.array(scores)], names=[*own, *names])

    marked = docs.withColumn(letter, F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)))
    return marked.mapInArrow(run, T.StructType(carried + [T.StructField(names[0], T.StringType()), T.StructField(names[1], T.DoubleType())]))


def digest(found: DataFrame) -> DataFrame:
    return found.select("doc_id", held_out("doc_id").alias("held_out"), "lang_pred", "score")
