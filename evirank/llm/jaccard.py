"""N-gram Jaccard join by vertical partitioning.

A document's set holds the 64-bit hashes of its distinct shingles. The hash order is the global order of all n-grams; it is cut into
fragments at pivots known beforehand, and a set falls into one segment per fragment. Since the order is random to the texts, a
passage that many documents share spreads over all fragments.

Search: sets that are near enough differ in at most D elements, so of F fragments at least F - D hold equal segments. Equal segments
are counted, each set keeps its rarest ones up to the number that decides (a prefix filter over segments), and sets that share one are
candidates; among those a prefix filter over elements, rarest first, leaves the pairs to check. Check: for a candidate pair the overlap is counted apart
in each fragment of its sets and summed.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from evirank.llm.common import checkpointed, pieces
from evirank.llm.graph import components

SHINGLE_WORDS = 3
#: Two sets link if 100 * intersection >= PERCENT * union.
PERCENT = 90
#: Size groups: each upper end is GROWTH times the lower; sets within reach of the next group's lower end are in both.
GROWTH = 1.5
#: Fragments per D + 1, so that more than the least number of equal segments is asked for.
SPARE = 1.25
#: Orders tried for a set that leaves too many fragments empty; the last also counts empty segments as equal.
ORDERS = 8
#: Elements of a set per fragment, at most on average, in which overlaps are counted.
FRAGMENT = 128
#: Leaders of a bucket grow by this factor from round to round.
SPREAD = 64
#: Bytes of a text split into words together, and words whose hashes are remembered.
STRIDE, REMEMBERED = 1 << 20, 1 << 20

_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
_SPACE = re.compile(rb"[\x20\x09-\x0D]")


class _WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= REMEMBERED:
            self.clear()
        self[word] = value = xxhash.xxh64_intdigest(word)
        return value


_hashes = _WordHashes()


def _mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of the 64-bit numbers whose bits all depend on all."""
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def shingles(text: bytes | None) -> np.ndarray:
    """Sorted hashes of the distinct shingles; of fewer words the whole sequence is one; none for no word."""
    low, parts, at = (text or b"").translate(_LOWER), [], 0
    while at < len(low):
        cut = _SPACE.search(low, at + STRIDE)
        end = cut.start() if cut else len(low)
        words = low[at:end].split()
        parts.append(np.fromiter(map(_hashes.__getitem__, words), np.uint64, len(words)))
        at = end
    hashed = np.concatenate(parts) if parts else np.zeros(0, np.uint64)
    if not len(hashed):
        return hashed
    size = min(SHINGLE_WORDS, len(hashed))
    n = len(hashed) - size + 1
    out = np.full(n, size, np.uint64)
    for i in range(size):
        out = _mixed(out + hashed[i : i + n])
    return np.unique(out)


def most_differing(size: int, other: int, percent: int = PERCENT) -> int:
    """Elements that are in one of two linked sets only, at most."""
    return (size + other) * (100 - percent) // (100 + percent)


def size_groups(size: int, percent: int = PERCENT) -> list[tuple[int, int]]:
    """(number, greatest size) of the size groups a set is in; none if only an equal set can link to it."""
    low, number, out = 1, 0, []
    while low <= size:
        high = max(low + 1, int(low * GROWTH))
        if size < high:
            out.append((number, high - 1))
            if 100 * size >= percent * high:
                out.append((number + 1, max(high + 1, int(high * GROWTH)) - 1))
        low, number = high, number + 1
    return [(g, most) for g, most in out if most_differing(most, most, percent) > 0]


def signatures(elements: np.ndarray, percent: int = PERCENT) -> list[tuple[int, int, np.ndarray]]:
    """(group, need, keys): the keys of the non-empty segments, of which a linked set shares at least `need`. A group stands for
    a size group and an order; a set whose need falls below one tries a further order and keeps all keys of this one."""
    out = []
    for number, most in size_groups(len(elements), percent):
        allowed = most_differing(most, most, percent)
        fragments = int(SPARE * (allowed + 1)) + 1
        for order in range(ORDERS):
            group = number * ORDERS + order
            x = elements if not order else np.sort(_mixed(elements + np.uint64(order)))
            segment = ((x >> np.uint64(32)) * np.uint64(fragments)) >> np.uint64(32)
            present, starts = np.unique(segment, return_index=True)
            content = np.add.reduceat(_mixed(x), starts)
            need = len(present) - allowed
            if need < 1 and order == ORDERS - 1:
                missing = np.setdiff1d(np.arange(fragments, dtype=np.uint64), present)
                present, content = np.concatenate([present, missing]), np.concatenate([content, np.zeros(len(missing), np.uint64)])
            keys = _mixed(_mixed(content + np.uint64(group)) + present)
            out.append((group, need, keys.view(np.int64)))
            if need >= 1:
                break
    return out


def _with_sets(docs: DataFrame, keep: list[str], percent: int, keyed: bool) -> DataFrame:
    """keep columns of docs, n (size of the set), node (128-bit hash of the set, null if empty) and, if keyed, signatures `sigs`."""
    fields = [docs.schema[c] for c in keep] + [T.StructField("n", T.LongType()), T.StructField("node", T.BinaryType())]
    sig = pa.list_(pa.struct([("g", pa.int32()), ("need", pa.int32()), ("keys", pa.list_(pa.int64()))]))
    if keyed:
        inner = T.StructType([T.StructField("g", T.IntegerType()), T.StructField("need", T.IntegerType()), T.StructField("keys", T.ArrayType(T.LongType()))])
        fields.append(T.StructField("sigs", T.ArrayType(inner)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "text"):
            sizes, nodes, sigs = [], [], []
            for text in batch.column("text").cast(pa.large_binary()):
                found = shingles(text.as_py())
                sizes.append(len(found))
                nodes.append(hashlib.blake2b(found.tobytes(), digest_size=16).digest() if len(found) else None)
                if keyed:
                    sigs.append([{"g": g, "need": need, "keys": keys} for g, need, keys in signatures(found, percent)])
            columns = [batch.column(c) for c in keep] + [pa.array(sizes, pa.int64()), pa.array(nodes, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns + [pa.array(sigs, sig)] * keyed, names=[f.name for f in fields])

    return docs.mapInArrow(run, T.StructType(fields))


def _fragments(docs: DataFrame, percent: int) -> DataFrame:
    """docs(text, id) -> (id, node, n, size group, fragment, elements): the sets cut at the pivots of their size groups."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "text"):
            rows: list[list] = [[], [], [], [], [], []]
            for id_, text in zip(batch.column("id").to_pylist(), batch.column("text").cast(pa.large_binary())):
                x = shingles(text.as_py())
                node = hashlib.blake2b(x.tobytes(), digest_size=16).digest()
                for number, most in size_groups(len(x), percent):
                    parts = -(-most // FRAGMENT)
                    which = ((x >> np.uint64(32)) * np.uint64(parts)) >> np.uint64(32)
                    edges = np.searchsorted(which, np.arange(parts + 1, dtype=np.uint64))
                    for i, (a, b) in enumerate(zip(edges[:-1].tolist(), edges[1:].tolist())):
                        for column, value in zip(rows, (id_, node, len(x), number, i, x[a:b].view(np.int64))):
                            column.append(value)
            kinds = [pa.int64(), pa.binary(), pa.int64(), pa.int32(), pa.int32(), pa.list_(pa.int64())]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(rows, kinds)], names=["id", "node", "n", "size_group", "fragment", "elements"])

    return docs.mapInArrow(run, "id bigint, node binary, n bigint, size_group int, fragment int, elements array<bigint>")


def _linked(pairs: DataFrame, cut: DataFrame, percent: int) -> DataFrame:
    """pairs(a, b, size_group) -> (a, b) as nodes, for those that link: overlaps counted per fragment, summed per pair."""
    left = cut.select(F.col("id").alias("a"), F.col("node").alias("x"), F.col("n").alias("nx"), "size_group", "fragment", F.col("elements").alias("of_x"))
    right = cut.select(F.col("id").alias("b"), F.col("node").alias("y"), F.col("n").alias("ny"), "size_group", "fragment", F.col("elements").alias("of_y"))
    met = pairs.join(left, ["a", "size_group"]).join(right, ["b", "size_group", "fragment"])
    partial = met.select("x", "y", "nx", "ny", F.size(F.array_intersect("of_x", "of_y")).cast("bigint").alias("shared"))
    whole = partial.groupBy("x", "y", "nx", "ny").agg(F.sum("shared").alias("shared"))
    return whole.where(100 * F.col("shared") >= percent * (F.col("nx") + F.col("ny") - F.col("shared"))).select(F.col("x").alias("a"), F.col("y").alias("b"))


def _buckets(classes: DataFrame) -> DataFrame:
    """classes(id, n, sigs) -> (key, id, n, size_group, apart): sets that share one of their rarest segments; apart is the lower, the
    more frequent a set's segments are. A set with k keys that
    occur elsewhere and a need of m can link only to sets that share one of its k - m + 1 rarest; with k < m to none."""
    sigs = classes.select("id", "n", F.explode("sigs").alias("s")).select("id", "n", "s.g", "s.need", "s.keys")
    keyed = sigs.select("id", "g", F.explode("keys").alias("key"))
    often = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("often")).where("often > 1")
    held = keyed.join(often, "key").groupBy("id", "g").agg(F.sort_array(F.collect_list(F.struct("often", "key"))).alias("keys"))
    total = F.aggregate("keys", F.lit(0).cast("bigint"), lambda acc, k: acc - k["often"])
    rare = held.join(sigs.select("id", "g", "n", "need"), ["id", "g"]).where(F.size("keys") >= F.col("need")).select(
        "id", "n", (F.col("g") / ORDERS).cast("int").alias("size_group"), total.alias("apart"),
        F.explode(F.slice("keys", F.lit(1), F.size("keys") - F.greatest(F.col("need") - 1, F.lit(0)))["key"]).alias("key"))
    rare = checkpointed(rare)
    shared = rare.groupBy("key").agg(F.count(F.lit(1)).alias("c")).where("c > 1").select("key")
    return checkpointed(rare.join(shared, "key"))


def _unit(id_: Column) -> Column:
    """The place of a hashed id among all, 0 to 1."""
    return (id_.cast("double") + float(1 << 63)) / float(1 << 64)


def _rarest(cut: DataFrame, percent: int) -> DataFrame:
    """Fragments -> (key, id, n, size_group, at): each set's rarest elements by their number of candidate sets, as many as decide, without
    those that no other candidate holds; `at` is the place of an element in the set's order of rarity, from 0."""
    once = cut.groupBy("id").agg(F.min("size_group").alias("size_group"))
    each = cut.join(once, ["id", "size_group"]).select("id", "n", "size_group", F.explode("elements").alias("element"))
    often = each.groupBy("element").agg(F.count(F.lit(1)).alias("often")).where("often > 1")
    held = each.join(often, "element").groupBy("id", "n", "size_group").agg(F.sort_array(F.collect_list(F.struct("often", "element"))).alias("held"))
    own = F.col("n") - F.size("held")
    room = (F.col("n") * (100 - percent) / 100).cast("bigint") + 1 - own
    first = F.slice("held", F.lit(1), F.greatest(room, F.lit(0)).cast("int"))["element"]
    return held.select("id", "n", "size_group", own.alias("own"), F.posexplode(first).alias("at", "key")).withColumn("at", F.col("at") + F.col("own")).drop("own")


def _within_reach(one: str, two: str, percent: int) -> Column:
    """Whether sets that share an element can link: by their sizes, and by what may still be shared behind its places, if the
    element is the first shared one."""
    n1, n2, at1, at2 = (F.col(f"{x}.{c}") for c in ("n", "at") for x in (one, two))
    most = F.least(n1 - at1, n2 - at2)
    return (100 * F.least(n1, n2) >= percent * F.greatest(n1, n2)) & (most * (100 + percent) >= (n1 + n2) * percent)


def joined_up(docs: DataFrame, classes: DataFrame, percent: int = PERCENT) -> DataFrame:
    """classes(id, node, n, sigs, row_id, row_hash) -> (node, root): the components of all links between different sets.

    First each candidate meets the most central set of its buckets, the one whose segments are the most frequent. Then buckets are drawn
    anew, by the rarest elements that candidates share, and members of a bucket meet those leaders of it that are not in their
    component yet: one, next about SPREAD, SPREAD squared and so on, until a bucket's members are one component or all have led. So a
    family of near copies costs a few pairs per member, while no pair that could link two components stays unchecked.
    """
    buckets = _buckets(classes)
    wanted = buckets.select("id").distinct().join(classes.select("id", "row_id", "row_hash"), "id")
    same = F.col("d.doc_id").eqNullSafe(F.col("w.row_id")) & (F.xxhash64("d.text") == F.col("w.row_hash"))
    texts = docs.select("doc_id", "text").alias("d").join(wanted.alias("w"), same).select("id", "text")
    cut = checkpointed(_fragments(texts, percent).dropDuplicates(["id", "node", "size_group", "fragment"]))

    head = buckets.groupBy("key").agg(F.min(F.struct("apart", "id", "n")).alias("l"))
    near = 100 * F.least("m.n", "l.n") >= percent * F.greatest("m.n", "l.n")
    best = buckets.alias("m").join(head, "key").where((F.col("m.id") != F.col("l.id")) & near)
    best = best.groupBy(F.col("m.id").alias("a")).agg(F.min(F.struct("l.apart", "l.id", "m.size_group")).alias("f"))
    found = checkpointed(_linked(best.select("a", F.col("f.id").alias("b"), "f.size_group"), cut, percent))
    rare, share, more = checkpointed(_rarest(cut, percent)), 1, found
    rare = rare.join(rare.groupBy("key").agg(F.count(F.lit(1)).alias("members"), F.min("id").alias("least")).where("members > 1"), "key")
    roots = None
    while True:
        if roots is None or more.take(1):  # without new links the components stay
            roots = checkpointed(components(found))
        labels = roots.select(F.xxhash64("node").alias("id"), F.xxhash64("root").alias("label"))
        now = rare.join(labels, "id", "left").withColumn("label", F.coalesce("label", "id"))
        apart = now.groupBy("key").agg(F.min("label").alias("low"), F.max("label").alias("high")).where("low <> high").select("key")
        led = _leads(share // SPREAD) if share > 1 else F.lit(False)
        now = checkpointed(now.join(apart, "key").withColumn("leads", _leads(share)).where(~led))
        if not now.take(1):
            return roots
        m, l = now.alias("m"), now.where("leads").alias("l")
        once = (F.col("m.id") > F.col("l.id")) | ~F.col("m.leads")
        pairs = m.join(l, (F.col("m.key") == F.col("l.key")) & (F.col("m.label") != F.col("l.label")) & once & _within_reach("m", "l", percent))
        pairs = pairs.select(F.col("m.id").alias("a"), F.col("l.id").alias("b"), F.greatest("m.size_group", "l.size_group").alias("size_group"))
        more = checkpointed(_linked(pairs.distinct(), cut, percent))
        found = found.unionAll(more)
        share *= SPREAD


def _leads(share: int) -> Column:
    """Whether a member is among the about `share` leaders of its bucket: the one of least id, then those of low ids."""
    least = F.col("id") == F.col("least")
    return least if share == 1 else least | (_unit(F.col("id")) * F.col("members") <= float(share))


def jaccard_components(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """docs(doc_id, text, ..) -> (doc_id, n_shingles, component_id), one row per row of docs.

    Documents link when 100 * intersection >= percent * union of their shingle sets; component_id is the least doc_id reachable.
    Equal sets are one class and cost one set in the search. Null, empty and wordless texts have no shingles and link with
    nothing: their component is their own id. A null doc_id keeps its row but names no component unless it has no other id. Rows may
    repeat, and one id may have several texts. An empty table gives no rows. Other columns are ignored.
    """
    narrow = docs.select("doc_id", "text")
    hashed = narrow.withColumn("row_hash", F.xxhash64("text"))
    sets = _with_sets(hashed, ["doc_id", "row_hash"], percent, keyed=True).where("n > 0")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row_hash")).alias("row")
    classes = checkpointed(sets.groupBy("node").agg(first, F.first("n").alias("n"), F.first("sigs").alias("sigs")).select(
        "node", F.xxhash64("node").alias("id"), "n", "sigs", F.col("row.doc_id").alias("row_id"), F.col("row.row_hash").alias("row_hash")))
    found = joined_up(narrow, classes, percent)
    rooted = classes.select("node", "row_id").join(found, "node", "left").withColumn("root", F.coalesce("root", "node"))
    least = rooted.groupBy("root").agg(F.min("row_id").alias("component_id"))
    named = rooted.select("node", "root").join(least, "root").select("node", "component_id")
    rows = checkpointed(_with_sets(narrow, ["doc_id"], percent, keyed=False))
    alone = rows.where("n = 0").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"))
    return rows.where("n > 0").join(named, "node").select("doc_id", F.col("n").alias("n_shingles"), "component_id").unionAll(alone)
