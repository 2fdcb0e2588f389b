"""Benchmark decontamination: one automaton over normalised item windows, one pass over each text."""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evirank.llm.common import pieces, tag

#: Consecutive words of an item that make a window; an item with fewer words is one window.
WINDOW_WORDS = 10
#: Bytes of window text in one automaton (its trie takes about ten times that in a worker). A larger benchmark is cut into
#: several automata of this size, and the texts pass each of them.
AUTOMATON_BYTES = 16 << 20

#: Byte map: A-Z to lower case, every other ASCII byte that is no digit or letter to a space; bytes of multi-byte characters stay.
_MAP = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))

_built: dict[str, ahocorasick.Automaton] = {}


def words_of(text: bytes) -> list[bytes]:
    return text.translate(_MAP).split()


def windows_of(words: list[bytes], size: int = WINDOW_WORDS) -> list[list[bytes]]:
    if not words:
        return []
    return [words[i : i + size] for i in range(max(1, len(words) - size + 1))]


def _automaton(key: str, items: list[tuple[object, bytes]], size: int) -> ahocorasick.Automaton | None:
    """The automaton of these items, built once per worker. Values: (words in the window, items that have it)."""
    if key not in _built:
        owners: dict[bytes, tuple[int, set]] = {}
        for item_id, text in items:
            for window in windows_of(words_of(text), size):
                owners.setdefault(b" " + b" ".join(window) + b" ", (len(window), set()))[1].add(item_id)
        automaton = ahocorasick.Automaton()
        for window, (n, ids) in owners.items():
            automaton.add_word(window.decode("latin-1"), (n, frozenset(ids)))
        if owners:
            automaton.make_automaton()
        _built.clear()
        _built[key] = automaton if owners else None
    return _built[key]


def _word_spans(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Code-point start and end (exclusive) of each normalised word in the original text."""
    data = np.frombuffer(raw, np.uint8)
    kept = np.frombuffer(raw.translate(_MAP), np.uint8) != 32
    edge = np.flatnonzero(np.diff(np.concatenate(([0], kept.view(np.int8), [0]))))
    points = np.concatenate(([0], np.cumsum((data & 0xC0) != 0x80)))
    return points[edge[0::2]], points[edge[1::2]]


def _scan(automaton, raw: bytes) -> tuple[int, np.ndarray, set]:
    """Words, a hit flag per word, and the items found."""
    words = words_of(raw)
    found: set = set()
    if automaton is None or not words:
        return len(words), np.zeros(0, bool), found
    joined = b" " + b" ".join(words) + b" "
    ends, sizes = [], []
    for end, (n, ids) in automaton.iter(joined.decode("latin-1")):
        ends.append(end)
        sizes.append(n)
        found |= ids
    if not ends:
        return len(words), np.zeros(0, bool), found
    # the space at `end` closes the last word of the occurrence: as many words end there as spaces stand before it
    spaces = np.flatnonzero(np.frombuffer(joined, np.uint8) == 32)
    last = np.searchsorted(spaces, np.array(ends))  # exclusive word index
    delta = np.zeros(len(words) + 1, np.int64)
    np.add.at(delta, last - np.array(sizes), 1)
    np.add.at(delta, last, -1)
    return len(words), np.cumsum(delta[:-1]) > 0, found


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW_WORDS, automaton_bytes: int = AUTOMATON_BYTES,
                  keep: list[str] | None = None, prefix: str = "") -> DataFrame:
    """Add n_words, n_hit, items array<string> (sorted as strings), spans array<struct<start, end>> to docs(.., text).

    A word is hit if it lies in any occurrence of an item window; `spans` are the maximal runs of hit words as code-point
    offsets of the original text, end exclusive. Null and empty texts have no words; an empty benchmark, or items with
    null text or no word, hit nothing; items with a null id count as the id ''. Repeated rows each keep their own row,
    and other columns pass through (columns with the four names are replaced). A text is scanned whole, once per automaton.
    keep: the columns of docs to return (all of them by default); prefix: put before the four names.
    """
    names = [prefix + name for name in ("n_words", "n_hit", "items", "spans")]
    n_words, n_hit, items, spans = names
    docs = docs.drop(*names)
    rows = benchmark.where(F.col("text").isNotNull()).select(
        F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("id"), F.col("text").cast("binary").alias("text"))
    sized = rows.withColumn("bytes", F.octet_length("text") * window)
    total = sized.agg(F.sum("bytes")).first()[0] or 0
    blocks = max(1, -(-total // automaton_bytes))
    context = docs.sparkSession.sparkContext
    flags = f"flags_{tag()}"
    out = docs.withColumns({items: F.lit(None).cast("array<string>"), n_words: F.lit(0).cast("bigint"), flags: F.lit(None).cast("binary")})
    for block in range(blocks):
        part = sized.where(F.pmod(F.xxhash64("id", "text"), F.lit(blocks)) == block) if blocks > 1 else sized
        held = context.broadcast([(r["id"], bytes(r["text"])) for r in part.select("id", "text").toLocalIterator()])  # about automaton_bytes / window
        out = _pass(out, held, f"{tag()}", window, flags, names, keep if block == blocks - 1 else docs.columns, last=block == blocks - 1)
    return out


def _pass(docs: DataFrame, held, key: str, window: int, flags: str, named: list[str], keep: list[str] | None, last: bool) -> DataFrame:
    """One scan; the hit flags of earlier scans come in the column `flags` and leave as spans after the last one."""
    from pyspark.sql import types as T

    n_words, n_hit, n_items, n_spans = named
    carried = [f for f in docs.schema.fields if f.name not in (flags, n_items, n_words) and (keep is None or f.name in keep)]
    ends = [T.StructField(n_hit, T.LongType()), T.StructField(n_spans, T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())])))]
    schema = T.StructType(carried + [T.StructField(n_items, T.ArrayType(T.StringType())), T.StructField(n_words, T.LongType())] + (ends if last else [T.StructField(flags, T.BinaryType())]))
    names = [f.name for f in carried]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = _automaton(key, held.value, window)
        for batch in pieces(batches, "text"):
            texts = batch.column("text").cast(pa.binary()) if pa.types.is_string(batch.column("text").type) else batch.column("text").cast(pa.large_binary())
            before, seen = batch.column(flags), batch.column(n_items)
            cols: dict[str, list] = {n_items: [], n_words: [], n_hit: [], n_spans: [], flags: []}
            for i in range(batch.num_rows):
                raw = texts[i].as_py() or b""
                n, hit, found = _scan(automaton, raw)
                if (old := before[i].as_py()) is not None:
                    old = np.unpackbits(np.frombuffer(old, np.uint8), count=n).astype(bool)
                    hit = old | hit if len(hit) else old
                cols[n_items].append(sorted(found | set(seen[i].as_py() or [])))
                cols[n_words].append(n)
                if last:
                    cols[n_hit].append(int(hit.sum()))
                    runs = []
                    if hit.any():
                        starts, stops = _word_spans(raw)
                        edge = np.flatnonzero(np.diff(np.concatenate(([0], hit.view(np.int8), [0]))))
                        runs = [{"start": int(starts[a]), "end": int(stops[b - 1])} for a, b in zip(edge[0::2], edge[1::2])]
                    cols[n_spans].append(runs)
                else:
                    cols[flags].append(np.packbits(hit).tobytes() if len(hit) else None)
            arrays = [batch.column(name) for name in names]
            kinds = {n_items: pa.list_(pa.string()), n_words: pa.int64(), n_hit: pa.int64(), flags: pa.binary(),
                     n_spans: pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))}
            extra = [n_items, n_words] + ([n_hit, n_spans] if last else [flags])
            yield pa.RecordBatch.from_arrays(arrays + [pa.array(cols[c], kinds[c]) for c in extra], names=names + extra)

    return docs.mapInArrow(scan, schema)


def without_spans(scanned: DataFrame, prefix: str = "") -> DataFrame:
    """The texts of contamination() without their spans; n_chars, if there, follows. Rows without a span stay untouched."""
    spans = prefix + "spans"
    hit = F.size(spans) > 0
    start = F.struct(F.lit(0).cast("bigint").alias("at"), F.array().cast("array<string>").alias("parts"))

    def step(acc, s):
        gap = F.substring("text", (acc["at"] + 1).cast("int"), (s["start"] - acc["at"]).cast("int"))
        return F.struct(s["end"].alias("at"), F.concat(acc["parts"], F.array(gap)).alias("parts"))

    cut = F.aggregate(spans, start, step, lambda acc: F.concat(
        F.array_join(acc["parts"], ""), F.substring("text", (acc["at"] + 1).cast("int"), F.length("text"))))
    out = scanned.withColumn("text", F.when(hit, cut).otherwise(F.col("text")))
    if "n_chars" in scanned.columns:
        out = out.withColumn("n_chars", F.when(hit, F.length("text")).otherwise(F.col("n_chars")).cast(scanned.schema["n_chars"].dataType))
    return out


def digest(scanned: DataFrame) -> DataFrame:
    return scanned.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("bigint").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))
