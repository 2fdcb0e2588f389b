"""SimHash near duplicates: pigeonhole blocks, exact Hamming checks, components."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from evirank.llm.common import checkpointed, pieces, tag
from evirank.llm.graph import components

SHINGLE_WORDS = 3
SEED = 42
MAX_BITS = 3
#: First level: 6 blocks of the 64 bits; a pair with at most 3 differing bits agrees in at least 3 blocks.
BLOCKS, CLEAN = 6, 3
#: A bucket with more fingerprints than this is split again by its free bits (second level).
BUCKET_ROWS = 1024
#: Second level: the free bits (30 to 33) in 8 cells, of which a pair agrees in at least 5. What is left free has at most
#: 15 bits, of which two linked fingerprints differ in at most 3, so no sub-bucket outgrows 2^15 fingerprints.
CELLS, CLEAN_CELLS = 8, 5

#: Rows of whole buckets that one call works on.
PART_ROWS = 100_000

_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def fingerprint(text: bytes | None, size: int = SHINGLE_WORDS) -> int:
    """64-bit SimHash of the word shingles, repeats included; 0 if there is no word."""
    words = (text or b"").translate(_LOWER).split()
    if not words:
        return 0
    hashed = xxhash.xxh64_intdigest
    if len(words) <= size:
        return hashed(b" ".join(words), SEED)
    join = b" ".join
    counts, n = np.zeros(64, np.int64), len(words) - size + 1
    for at in range(0, n, 1 << 16):
        part = words[at : at + (1 << 16) + size - 1]
        values = np.fromiter((hashed(join(s), SEED) for s in zip(*(part[i:] for i in range(size)))), np.uint64)
        counts += _bit_counts(values)
    return int(sum(1 << i for i in np.flatnonzero(2 * counts > n).tolist()))


def _bit_counts(values: np.ndarray) -> np.ndarray:
    """How many values have bit i set, for i = 0 (lowest) to 63."""
    bits = np.unpackbits(values.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    out = np.zeros(64, np.int64)
    for at in range(0, len(bits), 255):  # 255 ones fit a byte, so the inner sums stay in uint8
        out += bits[at : at + 255].sum(axis=0, dtype=np.uint8)
    return out


def with_fingerprint(docs: DataFrame, name: str = "simhash", keep: list[str] | None = None) -> DataFrame:
    """Add the SimHash of `text` as a bigint; null and wordless texts have 0. Other columns pass through."""
    carried = [f for f in docs.schema.fields if f.name != name and (keep is None or f.name in keep)]
    names = [f.name for f in carried]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "text"):
            texts = batch.column("text").cast(pa.large_binary())
            found = np.array([fingerprint(t.as_py()) for t in texts], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(n) for n in names] + [pa.array(found)], names=names + [name])

    return docs.mapInArrow(run, T.StructType(carried + [T.StructField(name, T.LongType())]))


def _edges(bits: int, parts: int) -> list[int]:
    return [round(i * bits / parts) for i in range(parts + 1)]


def _mask(chosen: tuple[int, ...], positions: list[list[int]]) -> int:
    value = sum(1 << p for c in chosen for p in positions[c])
    return value - (1 << 64) if value >= 1 << 63 else value


def block_masks() -> list[tuple[int, list[int]]]:
    """For each choice of clean blocks: its bit mask (signed) and the masks of its second level."""
    edges = _edges(64, BLOCKS)
    blocks = [list(range(a, b)) for a, b in zip(edges, edges[1:])]
    out = []
    for chosen in combinations(range(BLOCKS), CLEAN):
        free = [p for i, block in enumerate(blocks) if i not in chosen for p in block]
        inner = _edges(len(free), CELLS)
        cells = [free[a:b] for a, b in zip(inner, inner[1:])]
        fixed = _mask(chosen, blocks)
        out.append((fixed, [fixed | _mask(c, cells) for c in combinations(range(CELLS), CLEAN_CELLS)]))
    return out


def _forest(values: np.ndarray) -> list[tuple[int, int]]:
    """Links that join all values within MAX_BITS of each other, at most one per value: breadth first with exact distances."""
    left = np.unique(values)
    out = []
    while len(left):
        front, left = left[:1], left[1:]
        while len(front) and len(left):
            parent = np.full(len(left), -1)
            for start in range(0, len(front), 64):
                differ = (left[None, :] ^ front[start : start + 64, None]).view(np.uint64)  # of a signed number numpy counts the absolute value's bits
                near = np.bitwise_count(differ) <= MAX_BITS
                hit = near.any(axis=0) & (parent < 0)
                parent[hit] = start + near[:, hit].argmax(axis=0)
            found = parent >= 0
            out += list(zip(front[parent[found]].tolist(), left[found].tolist()))
            front, left = left[found], left[~found]
    return out


def links(prints: DataFrame) -> DataFrame:
    """prints(fp bigint), distinct -> (a, b): links between fingerprints at 3 or fewer differing bits that give the same
    components as all such links, at most one per fingerprint and bucket.

    Fingerprints meet only in buckets of shared blocks. A large bucket, as a family of near copies makes, is cut by its free bits
    into sub-buckets whose size the number of bits bounds, so that no task sees an unbounded group and no pairs are listed.
    """
    masks = block_masks()
    spec = F.array(*[F.struct(F.lit(i).alias("m"), F.lit(fixed).alias("mask")) for i, (fixed, _) in enumerate(masks)])
    keyed = prints.select("fp", F.explode(spec).alias("s")).select("fp", "s.m", F.col("fp").bitwiseAND(F.col("s.mask")).alias("key"))
    sizes = keyed.groupBy("m", "key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    met = checkpointed(keyed.join(sizes, ["m", "key"]))
    inner = F.array(*[F.array(*[F.lit(x) for x in second]) for _, second in masks])
    small = met.where(F.col("n") <= BUCKET_ROWS).select("fp", F.col("m").alias("mask"), "key")
    large = met.where(F.col("n") > BUCKET_ROWS).select("fp", F.explode(F.element_at(inner, F.col("m") + 1)).alias("mask")).select(
        "fp", "mask", F.col("fp").bitwiseAND(F.col("mask")).alias("key"))

    each = [small.withColumn("mask", F.col("mask").cast("bigint")), large]
    return _joined_up(each[0]).unionAll(_joined_up(each[1]))


def _joined_up(buckets: DataFrame) -> DataFrame:
    """buckets(fp, mask, key) -> (a, b). Whole buckets are dealt to parts of about PART_ROWS rows and told apart by sorting there,
    so a part costs one call however many small buckets it holds."""
    parts = buckets.count() // PART_ROWS + 1

    def run(table: pa.Table) -> pa.Table:
        fp, mask, key = (table.column(c).to_numpy() for c in ("fp", "mask", "key"))
        order = np.lexsort((key, mask))
        mask, key, fp = mask[order], key[order], fp[order]
        starts = np.flatnonzero(np.concatenate(([True], (mask[1:] != mask[:-1]) | (key[1:] != key[:-1]), [True])))
        found = [link for a, b in zip(starts[:-1].tolist(), starts[1:].tolist()) for link in _forest(fp[a:b])]
        ends = np.array(found, np.int64).reshape(-1, 2)
        return pa.table({"a": ends[:, 0], "b": ends[:, 1]})

    part = F.pmod(F.xxhash64("mask", "key"), F.lit(parts)).cast("int")
    return buckets.withColumn("part", part).groupBy("part").applyInArrow(run, "a bigint, b bigint")


def near_components(prints: DataFrame) -> DataFrame:
    """prints(doc_id, fp) -> distinct fp with its component: (fp, root, component_id); root is the least fingerprint
    and component_id the least doc_id reachable by links."""
    first = checkpointed(prints.groupBy("fp").agg(F.min("doc_id").alias("least")))
    found = components(links(first.select("fp")))
    joined = first.join(found.select(F.col("node").alias("fp"), "root"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    least = joined.groupBy("root").agg(F.min("least").alias("component_id"))
    return joined.select("fp", "root").join(least, "root").select("fp", "root", "component_id")


def hex64(value: Column) -> Column:
    return F.lower(F.lpad(F.hex(value), 16, "0"))


def simhash_components(docs: DataFrame) -> DataFrame:
    """docs(doc_id, text, ..) -> (doc_id, simhash bigint, component_id), one row per row of docs.

    Fingerprints link at 3 or fewer differing bits; component_id is the least doc_id reachable. Rows with equal
    fingerprints are one node, so exact copies cost one fingerprint. Null and wordless texts have fingerprint 0. A null
    doc_id keeps its row but never names a component, unless it has no other id. An empty table gives no rows.
    """
    prints = checkpointed(with_fingerprint(docs.select("doc_id", "text"), keep=["doc_id"]))
    found = near_components(prints.select("doc_id", F.col("simhash").alias("fp")))
    return prints.join(found.withColumnRenamed("fp", "simhash"), "simhash").select("doc_id", "simhash", "component_id")


def digest(found: DataFrame) -> DataFrame:
    return found.select("doc_id", hex64(F.col("simhash")).alias("fingerprint"), "component_id")


def one_of_each(docs: DataFrame) -> DataFrame:
    """The rows of docs without near copies: of each component the row with the least doc_id stays, whole.

    A null doc_id sorts last; rows that repeat id and text are one; rows of one id with different texts are told apart by
    a hash of the text. Only (id, hash, fingerprint) go through the search, the texts move once.
    """
    text_hash, place, id_, hash_ = (f"{x}_{tag()}" for x in ("hash", "place", "id", "first"))
    narrow = docs.select("doc_id", "text", F.xxhash64("text").alias("h"))
    prints = checkpointed(with_fingerprint(narrow, "fp", keep=["doc_id", "h"]))
    keepers = prints.join(near_components(prints), "fp").groupBy("component_id", "root").agg(
        F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "h")).alias("first")).select(
        F.col("first.doc_id").alias(id_), F.col("first.h").alias(hash_))
    hashed = docs.withColumn(text_hash, F.xxhash64("text"))
    kept = hashed.join(keepers, F.col("doc_id").eqNullSafe(F.col(id_)) & (F.col(text_hash) == F.col(hash_)), "left_semi")
    once = Window.partitionBy("doc_id", text_hash).orderBy(F.lit(1))
    return kept.withColumn(place, F.row_number().over(once)).where(F.col(place) == 1).drop(text_hash, place)
