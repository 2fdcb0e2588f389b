"""Quality classifier: a byte-level convolutional network in numpy with learned filters over overlapping chunks of the whole text."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from evirank.llm.common import held_out, pieces, text_bytes
from evirank.llm.toxicity import labelled

#: A chunk is two halves long and starts every half, so chunks overlap by half; inside it filters of WIDTH bytes start every STRIDE bytes.
HALF, WIDTH, STRIDE = 64, 8, 4
DIMS, FILTERS, HIDDEN = 7, 24, 12
#: Besides its embedding a byte carries one bit: the RUN bytes from here repeat those some 2 .. LAGS bytes before.
RUN, LAGS = 8, 32
#: Labelled rows per class for training, taken from texts of at most so many bytes; passes over them.
ROWS_PER_CLASS, ROW_BYTES, EPOCHS = 1500, 6000, 14
SEED = 3
PER_HALF = HALF // STRIDE
LEAD = WIDTH - STRIDE


@dataclass
class Net:
    embed: np.ndarray  # 256 x DIMS, row 0 (padding) stays 0
    filters: np.ndarray  # WIDTH * (DIMS + 1) x FILTERS
    bias: np.ndarray
    w1: np.ndarray  # FILTERS x HIDDEN
    b1: np.ndarray
    w2: np.ndarray  # HIDDEN
    b2: np.ndarray

    def params(self) -> list[np.ndarray]:
        return [self.embed, self.filters, self.bias, self.w1, self.b1, self.w2, self.b2]


def new_net(seed: int = SEED) -> Net:
    rng = np.random.default_rng(seed)
    def some(*shape, scale):
        return (scale * rng.standard_normal(shape)).astype(np.float32)

    embed = some(256, DIMS, scale=0.5)
    embed[0] = 0
    return Net(embed, some(WIDTH * (DIMS + 1), FILTERS, scale=0.25), np.zeros(FILTERS, np.float32), some(FILTERS, HIDDEN, scale=0.4),
               np.zeros(HIDDEN, np.float32), some(HIDDEN, scale=0.4), np.zeros(1, np.float32))


def padded(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows padded with zero bytes to whole halves plus one, side by side, and the row offsets counted in halves.

    A row starts LEAD zero bytes in, which is as far as the windows of the half before it reach, so rows don't see each other."""
    sizes = np.diff(offsets)
    halves = np.maximum(-(-(sizes + LEAD) // HALF), 1) + 1
    ends = np.concatenate(([0], np.cumsum(halves)))
    out = np.zeros(ends[-1] * HALF + WIDTH, np.uint8)
    for at, start, stop in zip((ends[:-1] * HALF).tolist(), offsets[:-1].tolist(), offsets[1:].tolist()):
        out[at + LEAD : at + LEAD + stop - start] = data[start:stop]
    return out, ends


def repeats(x: np.ndarray) -> np.ndarray:
    """1 where RUN bytes equal the RUN bytes some 2 .. LAGS places before; zero padding never does."""
    out = np.zeros(len(x), np.uint8)
    for lag in range(2, LAGS + 1):
        same = (x[lag:] == x[:-lag]).view(np.uint8)
        n = len(same) - RUN + 1
        if n <= 0:
            break
        two = same[:-1] & same[1:]
        four = two[:-2] & two[2:]
        out[lag : lag + n] |= four[:-4] & four[4:]
    return out * (x != 0)


def _channels(net: Net, x: np.ndarray, marks: np.ndarray) -> np.ndarray:
    out = np.empty((len(x), DIMS + 1), np.float32)
    out[:, :DIMS] = net.embed[x]
    out[:, DIMS] = marks
    return out


def _windows(channels: np.ndarray, halves: int) -> np.ndarray:
    """All filter windows as rows; windows of a half may reach WIDTH - STRIDE bytes into the next."""
    size = channels.strides[1]
    row = (DIMS + 1) * size
    shape = (halves * PER_HALF, WIDTH * (DIMS + 1))
    return np.lib.stride_tricks.as_strided(channels, shape, (STRIDE * row, size))


def chunk_features(net: Net, x: np.ndarray, marks: np.ndarray, halves: int) -> np.ndarray:
    """Mean rectified filter response of each chunk (a half and the next): (halves - 1) x FILTERS."""
    means = np.empty((halves, FILTERS), np.float32)
    for at in range(0, halves, 256):  # a block at a time, so that a long text needs no more memory than a short one
        n = min(256, halves - at)
        span = slice(at * HALF, (at + n) * HALF + WIDTH)
        act = np.ascontiguousarray(_windows(_channels(net, x[span], marks[span]), n)) @ net.filters
        act += net.bias
        np.maximum(act, 0, out=act)
        means[at : at + n] = act.reshape(n, PER_HALF, FILTERS).mean(axis=1)
    return 0.5 * (means[:-1] + means[1:])


def _head(net: Net, top: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    hidden = np.maximum(top @ net.w1 + net.b1, 0)
    return hidden, hidden @ net.w2 + net.b2[0]


def scores(net: Net, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """One probability per row: chunk features, maximum over all chunks of the row, two dense layers."""
    x, ends = padded(data, offsets)
    features = chunk_features(net, x, repeats(x), int(ends[-1]))
    # a row of h halves has h - 1 chunks; the chunk that straddles two rows is the last before the next row's first
    drop = np.ones(len(features), bool)
    drop[ends[1:-1] - 1] = False
    rows_at = ends[:-1] - np.arange(len(ends) - 1)
    top = np.maximum.reduceat(features[drop], rows_at, axis=0)
    return 1 / (1 + np.exp(-np.clip(_head(net, top)[1], -30, 30)))


def gradients(net: Net, rows: list[np.ndarray], marks: list[np.ndarray], y: np.ndarray, weight: np.ndarray) -> tuple[float, list[np.ndarray]]:
    """Weighted logistic loss over padded rows and its gradients; through the maximum only the winning chunk of each filter learns."""
    tops, winners = np.empty((len(rows), FILTERS), np.float32), np.empty((len(rows), FILTERS), np.int64)
    halves = np.array([(len(x) - WIDTH) // HALF for x in rows])
    starts = np.concatenate(([0], np.cumsum(halves)))
    joined = np.concatenate([x[:-WIDTH] for x in rows] + [np.zeros(WIDTH, np.uint8)])
    bits = np.concatenate([m[:-WIDTH] for m in marks] + [np.zeros(WIDTH, np.uint8)])
    features = chunk_features(net, joined, bits, int(starts[-1]))
    for i in range(len(rows)):
        own = features[starts[i] : starts[i + 1] - 1]
        winners[i] = starts[i] + own.argmax(axis=0)
        tops[i] = own.max(axis=0)
    hidden, z = _head(net, tops)
    p = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
    loss = float((weight * (np.logaddexp(0, z) - y * z)).sum() / weight.sum())
    g = ((p - y) * weight / weight.sum()).astype(np.float32)
    d_hidden = g[:, None] * net.w2 * (hidden > 0)
    d_top = d_hidden @ net.w1.T
    # windows of the winning chunks: rows x FILTERS x (2 * PER_HALF)
    place = winners[:, :, None] * PER_HALF + np.arange(2 * PER_HALF)
    windows = _windows(_channels(net, joined, bits), int(starts[-1]))
    d_filters, d_bias, d_embed = np.zeros_like(net.filters), np.zeros_like(net.bias), np.zeros_like(net.embed)
    offsets = np.arange(WIDTH)
    for f in range(FILTERS):
        at = place[:, f].reshape(-1)
        seen = windows[at]
        live = (seen @ net.filters[:, f] + net.bias[f]) > 0
        share = np.repeat(d_top[:, f], 2 * PER_HALF) * live / (2 * PER_HALF)
        d_filters[:, f] = seen.T @ share
        d_bias[f] = share.sum()
        use = share != 0
        chars = joined[at[use][:, None] * STRIDE + offsets].reshape(-1)
        kernel = net.filters[:, f].reshape(WIDTH, DIMS + 1)[:, :DIMS]
        for d in range(DIMS):
            d_embed[:, d] += np.bincount(chars, (share[use][:, None] * kernel[:, d]).reshape(-1), 256)
    d_embed[0] = 0
    return loss, [d_embed, d_filters, d_bias, tops.T @ d_hidden, d_hidden.sum(axis=0), hidden.T @ g, np.array([g.sum()], np.float32)]


def train(texts: list[bytes], y: np.ndarray, weight: np.ndarray, epochs: int = EPOCHS, seed: int = SEED) -> Net:
    """Adam over small batches; the epoch with the least loss on a fifth of the rows wins."""
    net, rng = new_net(seed), np.random.default_rng(seed)
    rows = [padded(np.frombuffer(t, np.uint8), np.array([0, len(t)]))[0] for t in texts]
    marks = [repeats(x) for x in rows]
    order = rng.permutation(len(rows))
    check, fit = order[: len(rows) // 5], order[len(rows) // 5 :]
    moments = [[np.zeros_like(p), np.zeros_like(p)] for p in net.params()]
    best, step = (np.inf, [p.copy() for p in net.params()]), 0
    for epoch in range(epochs):
        fit = rng.permutation(fit)
        for at in range(0, len(fit), 32):
            part = fit[at : at + 32]
            _, grads = gradients(net, [rows[i] for i in part], [marks[i] for i in part], y[part], weight[part])
            step += 1
            for p, g, (m1, m2) in zip(net.params(), grads, moments):
                m1 += 0.1 * (g - m1)
                m2 += 0.01 * (g * g - m2)
                p -= 0.01 * (m1 / (1 - 0.9**step)) / (np.sqrt(m2 / (1 - 0.99**step)) + 1e-8)
        if len(check):
            z = np.array([_logit(net, rows[i], marks[i]) for i in check])
            loss = float((weight[check] * (np.logaddexp(0, z) - y[check] * z)).sum() / weight[check].sum())
        else:
            loss = -epoch
        if loss < best[0]:
            best = (loss, [p.copy() for p in net.params()])
    return Net(*best[1])


def _logit(net: Net, x: np.ndarray, marks: np.ndarray) -> float:
    return float(_head(net, chunk_features(net, x, marks, (len(x) - WIDTH) // HALF).max(axis=0)[None])[1][0])


def fit(docs: DataFrame, labels: DataFrame, column: str = "quality", per_class: int = ROWS_PER_CLASS, row_bytes: int = ROW_BYTES) -> Net:
    """A Net from docs(doc_id, text) and labels(doc_id, <column> 0/1): per_class labelled rows of each class, whole texts of at most
    row_bytes bytes, so the driver holds a bounded sample. The classes are weighted back to their shares among all labelled rows.
    With one class or none the net scores that rate."""
    sample, counts = labelled(labels, column, per_class)
    total = sum(counts.values())
    short = docs.select("doc_id", "text").where(F.octet_length(F.coalesce("text", F.lit(""))) <= row_bytes)
    rows = short.join(sample, F.col("doc_id") == F.col("row_id")).select(
        "row_id", "y", F.coalesce("text", F.lit("")).cast("binary").alias("text")).collect()
    rows = sorted(((r["row_id"], r["y"], bytes(r["text"])) for r in rows))
    y = np.array([r[1] for r in rows], np.float32)
    if len(set(y.tolist())) < 2:
        net = new_net()
        net.w2[:] = 0
        rate = (counts.get(1, 0) + 1) / (total + 2)
        net.b2[:] = np.log(rate / (1 - rate))
        return net
    weight = np.where(y > 0, counts[1] / (y > 0).sum(), counts[0] / (y == 0).sum()) / total * len(y)
    return train([r[2] for r in rows], y, weight.astype(np.float32))


def score(docs: DataFrame, net: Net, name: str = "score", keep: list[str] | None = None) -> DataFrame:
    """Add the probability of label 1 for the whole text; null and empty texts are scored as padding alone. Other columns pass through."""
    held = docs.sparkSession.sparkContext.broadcast(net)
    carried = [f for f in docs.schema.fields if f.name != name and (keep is None or f.name in keep)]
    names = [f.name for f in carried]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "text", 1 << 20):
            found = scores(held.value, *text_bytes(batch.column("text"))).astype(np.float64)
            yield pa.RecordBatch.from_arrays([batch.column(n) for n in names] + [pa.array(found)], names=names + [name])

    return docs.mapInArrow(run, T.StructType(carried + [T.StructField(name, T.DoubleType())]))


def digest(scored: DataFrame, threshold: float = 0.3) -> DataFrame:
    return scored.select("doc_id", held_out("doc_id").alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
