"""Suffix-array dedup: bytes covered by a 50-byte string that also starts in a document with a smaller id.

Three steps. (1) Every 50-byte window has an anchor, the 20-byte string of least hash in it (windows with equal bytes have equal
anchors). Anchors that occur in two different texts are flagged. (2) The fragments around flagged anchors are dealt by anchor, so equal windows meet.
(3) In each part, equal fragments are settled by their least id; the Burrows-Wheeler transforms of what is left are built
shard by shard and merged by interleave refinement, whose borders give the common prefixes of 50 bytes and so the repeated intervals.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evirank.llm.bwt import earliest_repeat
from evirank.llm.common import checkpointed, pieces, text_bytes
from evirank.llm.terms import _INVERSE, _MIX, _powers, _BASE

MATCH, ANCHOR = 50, 20
SPAN = MATCH - ANCHOR + 1
#: A fragment holds the windows of one anchor: at most SPAN of them.
WIDTH = MATCH + SPAN - 1
#: Bytes of text per anchor bucket; their number follows the size of the input.
BUCKET_BYTES = 48 << 20
#: A window has at least so many bytes on one side of its anchor: half of those around it.
SIDE = (MATCH - ANCHOR) // 2
#: Fragments are dealt to so many times more parts than anchors, whose entries are smaller.
FINER = 8
#: Fragment bytes that are merged together (anchors are independent of each other; one anchor is never cut).
MERGE_BYTES = 1 << 20
#: Packed columns of a fragment, and of a stretch of a text that is covered already, with their types.
FRAGMENT = {"hash": np.uint64, "id": np.int64, "th": np.int64, "start": np.int64, "size": np.uint8, "anchor": np.uint8, "bytes": np.uint8}
DONE = {"done_th": np.int64, "done_start": np.int64, "done_size": np.uint8}
LAST = (1 << 63) - 1  # stands for a null id: larger than any other
PIECE = 2 << 20


@lru_cache(4)
def _tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    return _powers(n, _BASE), _powers(n, _INVERSE)


def _hashes(data: np.ndarray, size: int) -> np.ndarray:
    """Hash of the `size` bytes from each place on."""
    n = len(data) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    forward, back = _tables(1 << (len(data) - 1).bit_length())
    sums = np.empty(len(data) + 1, np.uint64)
    sums[0] = 0
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * forward[: len(data)], out=sums[1:])
    value = (sums[size:] - sums[:n]) * back[:n]
    value ^= value >> np.uint64(29)
    value *= _MIX
    value ^= value >> np.uint64(32)
    return value


class Runs:
    """The anchors of the rows data[offsets[i]:offsets[i + 1]] in order: row, hash, place, first and last window (places in data)."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        parts = [self._part(data[a:b], a) for a, b in _cuts(len(data))]
        place, anchor, hashed = (np.concatenate(x) for x in zip(*parts)) if parts else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64))
        row = np.searchsorted(offsets, place, "right") - 1
        inside = place + MATCH <= offsets[row + 1] if len(row) else np.zeros(0, bool)
        place, anchor, hashed, row = place[inside], anchor[inside], hashed[inside], row[inside]
        new = np.ones(len(place), bool)
        new[1:] = anchor[1:] != anchor[:-1]
        first = np.flatnonzero(new)
        last = np.append(first[1:], len(place)) - 1
        self.row, self.hash = row[first], hashed[first]
        self.first, self.last, self.anchor = place[first], place[last], anchor[first]

    @staticmethod
    def _part(data: np.ndarray, base: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """All windows of a stretch: place, place of the anchor, hash. The least of 40 hash bits wins, the leftmost among equals."""
        n = len(data) - MATCH + 1
        if n <= 0:
            return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
        hashed = _hashes(data, ANCHOR)
        key = (hashed & ~np.uint64(0xFFFFFF)) | np.arange(len(hashed), dtype=np.uint64)
        width, least = 1, key
        while width * 2 <= SPAN:
            least = np.minimum(least[:-width], least[width:])
            width *= 2
        if width < SPAN:
            least = np.minimum(least[: n], least[SPAN - width : SPAN - width + n])
        at = (least[:n] & np.uint64(0xFFFFFF)).astype(np.int64)
        return np.arange(base, base + n), at + base, hashed[at]


def _cuts(n: int, most: int = 1 << 15) -> list[tuple[int, int]]:
    """Stretches of at most `most` windows (small enough for the cache) that overlap by MATCH - 1 bytes, so each window lies in exactly one."""
    return [(a, min(n, a + most + MATCH - 1)) for a in range(0, max(n - MATCH + 1, 0), most)]


def _lists(values: np.ndarray, counts: np.ndarray) -> pa.Array:
    """One binary value per count from the bytes of `values`, cut one after another."""
    size = values.dtype.itemsize
    ends = np.concatenate(([0], np.cumsum(counts * size))).astype(np.int64)
    kept = pa.py_buffer(np.ascontiguousarray(values).tobytes())
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(counts), [None, pa.py_buffer(ends.tobytes()), kept]).cast(pa.binary())


def _joined(column: pa.ChunkedArray, kind) -> np.ndarray:
    return np.frombuffer(b"".join(x.as_py() for x in column), kind)


def _entries(rows: DataFrame, buckets: int) -> DataFrame:
    """rows(th, text) -> (bucket, texts, counts, hashes): the anchors of some texts in one bucket, text after text."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "text", PIECE):
            runs = Runs(*text_bytes(batch.column("text")))
            texts = batch.column("th").to_numpy(zero_copy_only=False)
            bucket = (runs.hash % np.uint64(buckets)).astype(np.int64)
            order = np.argsort(bucket, kind="stable")
            rest = (runs.hash // np.uint64(buckets))[order]
            six = rest.view(np.uint8).reshape(-1, 8)[:, :6]  # 48 bits beside those of the bucket
            key = bucket[order] * len(texts) + runs.row[order]
            new = np.flatnonzero(np.diff(key, prepend=-1))
            count = np.diff(np.append(new, len(key))).astype(np.int32)
            owner, part = texts[runs.row[order][new]], bucket[order][new]
            edge = np.flatnonzero(np.diff(part, prepend=-1))
            if len(edge):
                docs_in = np.diff(np.append(edge, len(part)))
                n_in = np.diff(np.append(new[edge], len(key)))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(part[edge].astype(np.int32)), _lists(owner, docs_in), _lists(count, docs_in), _lists(six.reshape(-1), n_in * 6)],
                    names=["bucket", "texts", "counts", "hashes"])

    return rows.mapInArrow(run, "bucket int, texts binary, counts binary, hashes binary")


def _flag(table: pa.Table) -> pa.Table:
    """The anchors of one bucket that occur in two different texts: (th, bucket, bits), a 0/1 byte per anchor of the text in this bucket."""
    texts, counts = _joined(table.column("texts"), np.int64), _joined(table.column("counts"), np.int32)
    six = _joined(table.column("hashes"), np.uint8).reshape(-1, 6)
    value = np.zeros((len(six), 8), np.uint8)
    value[:, :6] = six
    value = value.view(np.uint64).ravel()
    who = np.repeat(texts, counts)
    order = np.argsort(value, kind="stable")
    start = np.flatnonzero(np.concatenate(([True], np.diff(value[order]) != 0)))
    own = who[order]
    many = np.minimum.reduceat(own, start) != np.maximum.reduceat(own, start)
    bits = np.zeros(len(value), np.uint8)
    bits[order] = np.repeat(many, np.diff(np.append(start, len(value))))
    ends = np.concatenate(([0], np.cumsum(counts)))
    some = np.add.reduceat(bits.astype(np.int64), ends[:-1]) > 0
    keep = np.zeros(len(texts), bool)
    keep[np.unique(texts, return_index=True)[1]] = True  # copies of a text have equal anchors: one stands for all
    keep &= some
    return pa.table({"th": pa.array(texts[keep]), "bucket": pa.array(np.full(keep.sum(), table.column("bucket")[0].as_py(), np.int32)),
                     "bits": _lists(bits[np.repeat(keep, counts)], counts[keep].astype(np.int64))})


def _fragments(rows: DataFrame, buckets: int) -> DataFrame:
    """rows(id, th, text, flags) -> (bucket, FRAGMENT and DONE columns): the fragments of flagged anchors, dealt by anchor, and the
    stretches that are covered already, dealt by text; packed. A passage of very many texts goes on once per batch of texts."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "text", PIECE):
            data, offsets = text_bytes(batch.column("text"))
            runs = Runs(data, offsets)
            bucket = (runs.hash % np.uint64(buckets)).astype(np.int64)
            finer = (runs.hash % np.uint64(buckets * FINER)).astype(np.int64)
            order = np.lexsort((bucket, runs.row))
            key = runs.row[order] * buckets + bucket[order]
            hit = np.zeros(len(key), bool)
            for i, flags in enumerate(batch.column("flags").to_pylist()):
                for flag in flags:
                    at = np.searchsorted(key, i * buckets + flag["bucket"])
                    bits = np.frombuffer(flag["bits"], np.uint8)
                    hit[at : at + len(bits)] = bits
            chosen = order[hit]
            chosen = chosen[np.argsort(finer[chosen], kind="stable")]
            if not len(chosen):
                continue
            first, size = runs.first[chosen], runs.last[chosen] - runs.first[chosen] + MATCH
            joined = _stretches(data, first, size)
            row = runs.row[chosen]
            ids, ths = (batch.column(c).to_numpy(zero_copy_only=False)[row] for c in ("id", "th"))
            hashed, start, part = runs.hash[chosen], (first - offsets[row]).astype(np.int64), finer[chosen]
            # equal fragments of this batch: the least id goes on, the others are covered whole and need not meet anyone
            gone = _later_copies(hashed, ids, size, joined)
            keep = ~gone
            joined = joined[np.repeat(keep, size)]
            yield _packed(FRAGMENT, part[keep], [hashed[keep], ids[keep], ths[keep], start[keep], size[keep].astype(np.uint8), (runs.anchor[chosen] - first)[keep].astype(np.uint8)], joined, size[keep])
            if gone.any():
                spread = ths[gone] % (buckets * FINER)
                order = np.argsort(spread, kind="stable")
                yield _packed(DONE, spread[order], [ths[gone][order], start[gone][order], size[gone].astype(np.uint8)[order]], None, None)

    return rows.mapInArrow(run, "bucket int, " + ", ".join(f"{name} binary" for name in FRAGMENT | DONE))


def _stretches(data: np.ndarray, first: np.ndarray, size: np.ndarray) -> np.ndarray:
    jump = np.repeat(first - np.concatenate(([0], np.cumsum(size)[:-1])), size)
    return data[np.arange(size.sum()) + jump]


def _later_copies(hashed: np.ndarray, ids: np.ndarray, size: np.ndarray, joined: np.ndarray) -> np.ndarray:
    """Fragments that equal (by 128 bits of hash) one of a smaller id."""
    forward, back = _tables(1 << (len(joined) - 1).bit_length())
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum((joined.astype(np.uint64) + np.uint64(1)) * forward[: len(joined)])))
    ends = np.cumsum(size)
    begin = ends - size
    content = (sums[ends] - sums[begin]) * back[begin] + size.astype(np.uint64) * _MIX
    order = np.lexsort((ids, content, hashed))
    same = (hashed[order][1:] == hashed[order][:-1]) & (content[order][1:] == content[order][:-1])
    lead = np.maximum.accumulate(np.where(np.concatenate(([True], ~same)), np.arange(len(order)), 0))
    gone = np.zeros(len(order), bool)
    gone[order] = ids[order] > ids[order][lead]
    return gone


def _packed(names: dict, part: np.ndarray, columns: list[np.ndarray], joined: np.ndarray | None, size: np.ndarray | None) -> pa.RecordBatch:
    """One row per part, ordered by part; the columns of the other kind of row stay empty."""
    edge = np.flatnonzero(np.diff(part, prepend=-1))
    n_in = np.diff(np.append(edge, len(part)))
    lists = [_lists(c, n_in) for c in columns] + ([_lists(joined, np.add.reduceat(size, edge))] if joined is not None else [])
    filled = dict(zip(names, lists))
    blank = pa.array([b""] * len(edge), pa.binary())
    every = [*FRAGMENT, *DONE]
    return pa.RecordBatch.from_arrays([pa.array(part[edge].astype(np.int32)), *[filled.get(name, blank) for name in every]], names=["bucket", *every])


def _shared(key: np.ndarray, usable: np.ndarray) -> np.ndarray:
    """Which usable rows have a key that another usable row has as well."""
    at = np.flatnonzero(usable)
    order = at[np.argsort(key[at], kind="stable")]
    same = key[order][1:] == key[order][:-1]
    out = np.zeros(len(key), bool)
    out[order[1:][same]] = True
    out[order[:-1][same]] = True
    return out


def _may_repeat(hashed: np.ndarray, rows: np.ndarray, size: np.ndarray, anchor: np.ndarray) -> np.ndarray:
    """Fragments of an anchor that agree with another one in the SIDE bytes on the left or on the right of it: as a window has that
    many on one side, all others can't share a window."""
    weight = _powers(SIDE, _BASE)

    def side(start: np.ndarray) -> np.ndarray:
        near = rows[np.arange(len(rows))[:, None], np.clip(start, 0, rows.shape[1] - SIDE)[:, None] + np.arange(SIDE)].astype(np.uint64)
        return (near + np.uint64(1)) @ weight ^ hashed

    right = anchor + ANCHOR
    return _shared(side(anchor - SIDE), anchor >= SIDE) | _shared(side(right), size - right >= SIDE)


def covered(hashed: np.ndarray, ids: np.ndarray, size: np.ndarray, anchored: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(fragment, from, to): stretches of fragments that repeat in a smaller id. Fragments of one bucket, bytes one after another."""
    n, ends = len(size), np.cumsum(size.astype(np.int64))
    rows = np.zeros((n, WIDTH), np.uint8)
    owner = np.repeat(np.arange(n), size)
    rows[owner, np.arange(len(data)) - np.repeat(ends - size, size)] = data
    # equal fragments: the least id keeps its copy, all others are covered whole
    _, same = np.unique(rows.view(f"V{WIDTH}").ravel(), return_inverse=True)
    order = np.lexsort((ids, same))
    starts = np.flatnonzero(np.diff(same[order], prepend=-1))
    keeper = order[starts]
    least = ids[keeper][same]
    whole = ids > least
    # distinct fragments that may share a window with another one of their anchor, anchor by anchor
    anchor = hashed[keeper]
    open_ = np.flatnonzero(_may_repeat(anchor, rows[keeper], size[keeper], anchored[keeper]))
    open_ = open_[np.argsort(anchor[open_], kind="stable")]
    found_class, found_at = [], []
    group = np.cumsum(np.diff(anchor[open_], prepend=anchor[open_][:1]) != 0) if len(open_) else np.zeros(0, np.int64)
    at = 0
    while at < len(open_):
        stop = min(len(open_), at + MERGE_BYTES // (WIDTH + 1))
        while stop < len(open_) and group[stop] == group[stop - 1]:
            stop += 1
        part = keeper[open_[at:stop]]
        who, offset = earliest_repeat(rows[part], size[part].astype(np.int64), ids[part], MATCH)
        found_class.append(open_[at:stop][who])
        found_at.append(offset)
        at = stop
    out = [(np.flatnonzero(whole), np.zeros(whole.sum(), np.int64), size[whole].astype(np.int64))]
    if found_class:
        # every fragment equal to the keeper and of the same id has the keeper's windows
        classes, offsets = np.concatenate(found_class), np.concatenate(found_at)
        by_class = np.argsort(classes, kind="stable")
        classes, offsets = classes[by_class], offsets[by_class]
        left = np.flatnonzero(~whole)
        lo, hi = np.searchsorted(classes, same[left]), np.searchsorted(classes, same[left], "right")
        count = hi - lo
        fragment = np.repeat(left, count)
        place = offsets[np.arange(count.sum()) + np.repeat(lo - np.concatenate(([0], np.cumsum(count)[:-1])), count)] if count.sum() else np.zeros(0, np.int64)
        out.append((fragment, place, place + MATCH))
    return tuple(np.concatenate(x) for x in zip(*out))


def union(start: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Maximal runs covered by the intervals; touching ones join."""
    order = np.argsort(start, kind="stable")
    start, far = start[order], np.maximum.accumulate(stop[order]) if len(stop) else stop
    new = np.ones(len(start), bool)
    new[1:] = start[1:] > far[:-1]
    first = np.flatnonzero(new)
    return start[first], far[np.append(first[1:], len(start)) - 1] if len(start) else far


def _settle(table: pa.Table) -> pa.Table:
    """The covered stretches of one bucket: (th, spans), spans as packed pairs of int64 offsets in the text."""
    c = {name: _joined(table.column(name), kind) for name, kind in (FRAGMENT | DONE).items()}
    th, begin, end = c["done_th"], c["done_start"], c["done_start"] + c["done_size"]
    if len(c["hash"]):
        fragment, lo, hi = covered(c["hash"], c["id"], c["size"].astype(np.int64), c["anchor"].astype(np.int64), c["bytes"])
        at = c["start"][fragment]
        th, begin, end = np.concatenate((th, c["th"][fragment])), np.concatenate((begin, at + lo)), np.concatenate((end, at + hi))
    order = np.lexsort((begin, th))
    pairs = np.stack([begin[order], end[order]], axis=1).reshape(-1)
    edge = np.flatnonzero(np.concatenate(([True], np.diff(th[order]) != 0))) if len(th) else np.zeros(0, np.int64)
    n_in = np.diff(np.append(edge, len(th)))
    return pa.table({"th": pa.array(th[order][edge]), "spans": _lists(pairs, 2 * n_in)})


def _cut(rows: DataFrame) -> DataFrame:
    """rows(id, th, text, spans array<binary>) -> (id, th, runs array<struct<start, end>>, kept_sha256) of the text without its spans."""
    kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "text", PIECE):
            data, offsets = text_bytes(batch.column("text"))
            runs, shas = [], []
            for i, spans in enumerate(batch.column("spans").to_pylist()):
                pairs = np.concatenate([np.frombuffer(s, np.int64) for s in spans]).reshape(-1, 2)
                start, stop = union(pairs[:, 0], pairs[:, 1])
                text, at, digest = data[offsets[i] : offsets[i + 1]], 0, hashlib.sha256()
                for a, b in zip(start.tolist(), stop.tolist()):
                    digest.update(text[at:a].tobytes())
                    at = b
                digest.update(text[at:].tobytes())
                runs.append([{"start": a, "end": b} for a, b in zip(start.tolist(), stop.tolist())])
                shas.append(digest.hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("th"), pa.array(runs, kind), pa.array(shas)], names=["id", "th", "runs", "kept_sha256"])

    return rows.select("id", "th", "text", "spans").mapInArrow(run, "id bigint, th bigint, runs array<struct<start:bigint,end:bigint>>, kept_sha256 string")


def repeated_runs(docs: DataFrame, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """docs(doc_id, text, ..) -> (doc_id, n_bytes, runs array<struct<start, end>>, kept_sha256), one row per row of docs.

    `runs` are the maximal byte runs covered by 50-byte strings that also start in a document with a smaller doc_id; the hash is of
    the other bytes. Null text is empty. A null doc_id counts as larger than any id, and two null ids as equal. Rows of one id
    don't remove each other. Texts are told apart by a 64-bit hash; of equal texts the least id is searched and the others, wholly
    covered, are settled without it. Texts under 50 bytes keep everything. Other columns are ignored; an empty table gives no rows.
    """
    text = F.coalesce("text", F.lit(""))
    source = docs.select("doc_id", F.coalesce("doc_id", F.lit(LAST)).alias("id"), text.alias("text"), F.xxhash64(text).alias("th"))
    narrow = checkpointed(source.select("doc_id", "id", "th", F.octet_length("text").cast("bigint").alias("n_bytes"), F.sha2(F.col("text").cast("binary"), 256).alias("sha")))
    total = narrow.agg(F.sum("n_bytes")).first()[0] or 0
    buckets = int(max(12, -(-total // bucket_bytes)))
    firsts = narrow.where(F.col("n_bytes") >= MATCH).groupBy("th").agg(F.min("id").alias("id"))
    long = source.where(F.octet_length("text") >= MATCH)
    flags = _entries(long.select("th", "text"), buckets).groupBy("bucket").applyInArrow(_flag, "th bigint, bucket int, bits binary")
    by_text = checkpointed(flags.groupBy("th").agg(F.collect_list(F.struct("bucket", "bits")).alias("flags")).join(firsts, "th"))
    texts = long.select("id", "th", "text")
    pieces_ = _fragments(texts.join(by_text, ["id", "th"]).select("id", "th", "text", "flags"), buckets)
    spans = pieces_.groupBy("bucket").applyInArrow(_settle, "th bigint, spans binary").groupBy("th").agg(F.collect_list("spans").alias("spans"))
    # one job from here: both joins read the texts from the same shuffle
    spans = spans.join(firsts, "th")
    partly = _cut(texts.join(spans, ["id", "th"])).dropDuplicates(["id", "th"]).withColumnsRenamed({"id": "_id", "th": "_th"})
    least = firsts.withColumnsRenamed({"id": "_first", "th": "_text"})
    joined = narrow.join(least, F.col("th") == F.col("_text"), "left").join(partly, (F.col("id") == F.col("_id")) & (F.col("th") == F.col("_th")), "left")
    copy = F.col("_first").isNotNull() & (F.col("id") > F.col("_first"))
    all_of_it = F.array(F.struct(F.lit(0).cast("bigint").alias("start"), F.col("n_bytes").alias("end")))
    none = F.array().cast("array<struct<start:bigint,end:bigint>>")
    return joined.select(
        "doc_id", "n_bytes", F.when(copy, all_of_it).otherwise(F.coalesce("runs", none)).alias("runs"),
        F.when(copy, F.sha2(F.lit("").cast("binary"), 256)).otherwise(F.coalesce("kept_sha256", "sha")).alias("kept_sha256"))


def digest(found: DataFrame) -> DataFrame:
    removed = F.aggregate("runs", F.lit(0).cast("bigint"), lambda acc, r: acc + r["end"] - r["start"])
    return found.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("runs").cast("bigint").alias("n_spans"), "kept_sha256")
