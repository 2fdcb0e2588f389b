"""Fill-in-middle: texts cut at unit boundaries, rearranged around markers, and put back together.

The cuts come from a Fenwick tree over fixed blocks of bytes, whose nodes hold how many units end and how many code points begin
in their blocks. A descent by powers of two finds the block of a cut; only that block is then looked at byte by byte.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from evirank.llm.common import pieces, tag, text_bytes

#: Bytes of a block, and bytes that the counting pass looks at together (whole blocks).
BLOCK, STRIDE = 4096, 1 << 20
SEED = 42
#: Per cent of the texts that are rearranged, and of those the share that puts the suffix first.
FIM_PERCENT, SPM_PERCENT = 50, 80
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True


class Blocks:
    """Fenwick tree over the blocks of a buffer that holds documents one after the other.

    A unit is a word with the white space before it, or white space at the end of a document; it ends at a word's last byte
    or at the document's last byte.
    """

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        self.data = data
        self.last = offsets[1:][np.diff(offsets) > 0] - 1
        count = -(-len(data) // BLOCK)
        self.units, self.points = np.zeros(count + 1, np.int64), np.zeros(count + 1, np.int64)
        for at in range(0, len(data), STRIDE):
            ends, starts = self._marks(at, min(at + STRIDE, len(data)))
            edges, block = np.arange(0, len(ends), BLOCK), at // BLOCK + 1
            self.units[block : block + len(edges)] = np.add.reduceat(ends, edges, dtype=np.int64)
            self.points[block : block + len(edges)] = np.add.reduceat(starts, edges, dtype=np.int64)
        step = 1
        while 2 * step <= count:
            node = np.arange(2 * step, count + 1, 2 * step)
            self.units[node] += self.units[node - step]
            self.points[node] += self.points[node - step]
            step *= 2
        self.top = step

    def _marks(self, a: int, b: int) -> tuple[np.ndarray, np.ndarray]:
        """For each byte from a to b: whether a unit ends with it, whether a code point begins with it."""
        part = self.data[a : b + 1]
        space = _SPACE[part]
        ends = np.zeros(b - a, bool)
        ends[: len(part) - 1] = (~space[:-1] & space[1:])[: b - a]
        ends[self.last[np.searchsorted(self.last, a) : np.searchsorted(self.last, b)] - a] = True
        return ends, (part[: b - a] & 0xC0) != 0x80

    def before(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Units that end and code points that begin before each byte position."""
        node = at // BLOCK
        units, points = np.zeros(len(at), np.int64), np.zeros(len(at), np.int64)
        while node.any():
            units += self.units[node]
            points += self.points[node]
            node = node & (node - 1)
        for i, p in enumerate(at.tolist()):
            if p % BLOCK:
                ends, starts = self._marks(p - p % BLOCK, p)
                units[i] += ends.sum()
                points[i] += starts.sum()
        return units, points

    def after(self, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The byte position behind the unit of each rank (from 1 over the whole buffer), and the code points before it."""
        node, left, points = np.zeros(len(rank), np.int64), rank.copy(), np.zeros(len(rank), np.int64)
        step = self.top
        while step:
            far = node + step
            ok = far < len(self.units)
            ok[ok] = self.units[far[ok]] < left[ok]
            left[ok] -= self.units[far[ok]]
            points[ok] += self.points[far[ok]]
            node[ok] = far[ok]
            step //= 2
        cut = np.zeros(len(rank), np.int64)
        for i, (block, k) in enumerate(zip(node.tolist(), left.tolist())):
            a = block * BLOCK
            ends, starts = self._marks(a, min(a + BLOCK, len(self.data)))
            inside = int(np.flatnonzero(ends)[k - 1]) + 1
            cut[i] = a + inside
            points[i] += starts[:inside].sum()
        return cut, points


def cuts(data: np.ndarray, offsets: np.ndarray, first: np.ndarray, second: np.ndarray) -> tuple[np.ndarray, ...]:
    """Per document: units n, bytes and code points before the two cuts. The cuts come behind (first mod n + 1) and
    (second mod n + 1) units, the smaller one first."""
    blocks = Blocks(data, offsets)
    units, points = blocks.before(offsets.astype(np.int64))
    n = np.diff(units)
    ranks = np.sort(np.stack([first % (n + 1), second % (n + 1)]), axis=0)
    out = [n]
    for rank in ranks:
        at, chars = offsets[:-1].astype(np.int64), points[:-1].copy()
        inner = rank > 0
        at[inner], chars[inner] = blocks.after((units[:-1] + rank)[inner])
        out += [at - offsets[:-1], chars - points[:-1]]
    return tuple(out)


def _with_cuts(docs: DataFrame, first: str, second: str, into: str) -> DataFrame:
    """docs with a struct column `into`: units and both cuts of `text`."""
    kept = [f for f in docs.schema.fields if f.name not in (first, second)]
    names = [f.name for f in kept]
    parts = ["n", "byte1", "char1", "byte2", "char2"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "text"):
            data, offsets = text_bytes(batch.column("text"))
            draw = [batch.column(c).to_numpy(zero_copy_only=False) for c in (first, second)]
            found = pa.StructArray.from_arrays([pa.array(x) for x in cuts(data, offsets, *draw)], parts)
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in names] + [found], names=[*names, into])

    struct = T.StructType([T.StructField(p, T.LongType()) for p in parts])
    return docs.mapInArrow(run, T.StructType([*kept, T.StructField(into, struct)]))


def fill_in_middle(docs: DataFrame, into: str = "fim", seed: int = SEED, percent: int = FIM_PERCENT, spm_percent: int = SPM_PERCENT) -> DataFrame:
    """docs(doc_id, text, ..) with a struct column `into`: n (units), form, prefix_chars, middle_chars, output.

    The draws of a row come from the hash of seed and doc_id, so reruns and partitionings agree; rows of one id are drawn alike. Form is
    `plain` (output is the text), `psm` or `spm`; texts that are empty or hold a marker stay plain. A null text is empty, a
    null doc_id draws as an empty id. Other columns pass through; one named like `into` is replaced. An empty table gives no rows.
    """
    first, second, cut, full, h = (f"{c}_{tag()}" for c in ("a", "b", "cut", "text", "h"))
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256)
    draw = [F.conv(F.substring(F.col(h), 8 * i + 1, 8), 16, 10).cast("bigint") for i in range(4)]
    ready = docs.drop(into).withColumn(h, digest).withColumn(first, draw[0]).withColumn(second, draw[1])
    placed = _with_cuts(ready, first, second, cut).withColumn(full, F.coalesce("text", F.lit("")))

    text, at = F.col(full), F.col(cut)
    marked = F.contains(text, F.lit(PREFIX)) | F.contains(text, F.lit(SUFFIX)) | F.contains(text, F.lit(MIDDLE))
    plain = (text == "") | marked | (draw[2] % 100 >= percent)
    form = F.when(plain, "plain").when(draw[3] % 100 < spm_percent, "spm").otherwise("psm")
    raw = text.cast("binary")
    prefix = F.substring(raw, F.lit(1), at["byte1"].cast("int")).cast("string")
    middle = F.substring(raw, (at["byte1"] + 1).cast("int"), (at["byte2"] - at["byte1"]).cast("int")).cast("string")
    suffix = F.substring(raw, (at["byte2"] + 1).cast("int"), F.octet_length(text)).cast("string")
    output = (F.when(form == "plain", text)
              .when(form == "psm", F.concat(F.lit(PREFIX), prefix, F.lit(SUFFIX), suffix, F.lit(MIDDLE), middle))
              .otherwise(F.concat(F.lit(SUFFIX), suffix, F.lit(PREFIX), prefix, F.lit(MIDDLE), middle)))
    result = F.struct(
        at["n"].alias("n"), form.alias("form"), F.when(form != "plain", at["char1"]).alias("prefix_chars"),
        F.when(form != "plain", at["char2"] - at["char1"]).alias("middle_chars"), output.alias("output"))
    return placed.withColumn(into, result).drop(cut, full, h)


def restored(output: Column, form: Column) -> Column:
    """The text an output was made from. A rearranged text holds no marker, and none can arise where a piece meets one, so the
    first of each is the one that was set."""
    def around(one: str, two: str) -> tuple[Column, Column, Column]:
        i = F.locate(one, output) if one == SUFFIX else F.locate(PREFIX, output)
        j = F.locate(two, output)
        return F.substring(output, F.lit(4), i - 4), F.substring(output, i + 3, j - i - 3), F.substring(output, j + 3, F.length(output))

    prefix, suffix, middle = around(SUFFIX, MIDDLE)
    late, early, rest = around(PREFIX, MIDDLE)
    return F.when(form == "psm", F.concat(prefix, middle, suffix)).when(form == "spm", F.concat(early, rest, late)).otherwise(output)


def digest(found: DataFrame, fim: str = "fim") -> DataFrame:
    """Counts and hashes per document, the text read back from its output."""
    f = F.col(fim)
    return found.select(
        "doc_id", f["n"].alias("n"), f["form"].alias("form"), f["prefix_chars"].alias("prefix_chars"), f["middle_chars"].alias("middle_chars"),
        F.sha2(f["output"].cast("binary"), 256).alias("output_sha256"), F.sha2(restored(f["output"], f["form"]).cast("binary"), 256).alias("restored_sha256"))
