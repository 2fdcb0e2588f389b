"""Quality rules with adaptive thresholds: signals per text, quantile sketches per language and source, fences, one joined filter.

Column expressions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evirank.llm.common import checkpointed, let

#: Base rules of every text.
LEAST_WORDS = 10
MOST_REPEATED_PERCENT = 20
WINDOW_WORDS = 5
SYMBOLS = "#*$%&|<>"

#: Signals with an adaptive fence: (name, lower slack, upper slack). Two fences are read from the group's sketch and the nearer one
#: holds. One lies FENCE interquartile ranges outside the quartiles, or the slack if that is more: it decides in groups whose own
#: tail is odd. The other lies outside the quantile TAIL by TAIL_MARGIN times the way from the median to it: it has no constant,
#: so a group in which a signal hardly occurs also drops the few texts that show it. No lower fence where the slack is None.
FENCE = 3.0
TAIL = 0.99
TAIL_MARGIN = 1.0
SIGNALS: list[tuple[str, float | None, float]] = [
    ("mean_word", 1.5, 3.0),
    ("symbol_rate", None, 0.3),
    ("dup_line_rate", None, 0.3),
    ("repeat_rate", None, 0.2),
    ("upper_rate", None, 0.2),
]
#: Rows a group needs for fences of its own; smaller groups take those of their language, then of all rows.
LEAST_ROWS = 200
#: KLL sketch size: rank error about 0.3 %, well below 1 - TAIL.
SKETCH_K = 1000


def _repeated_words(words: Column) -> Column:
    """Words that lie in a window of WINDOW_WORDS words found twice or more, from the array of words.

    Windows are compared by 64-bit hash. Most texts have no repeat, which a set of hashes shows; the others sort (hash, place)
    pairs, keep the places beside an equal hash, and add up the union of their windows."""
    last = F.size(words) - WINDOW_WORDS
    hashes = F.transform(F.sequence(F.lit(1), last + 1), lambda i: F.xxhash64(*[F.get(words, i - 1 + k) for k in range(WINDOW_WORDS)]))

    def covered(h: Column) -> Column:
        ordered = F.array_sort(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))

        def places(s: Column) -> Column:
            beside = F.transform(s, lambda x, j: F.when(
                (x["h"] == F.get(s, j + 1)["h"]) | (x["h"] == F.get(s, j - 1)["h"]), x["i"]))
            return F.array_sort(F.array_compact(beside))

        total = F.aggregate(
            let(ordered, places), F.struct(F.lit(0).cast("bigint").alias("n"), F.lit(-WINDOW_WORDS).alias("at")),
            lambda acc, p: F.struct((acc["n"] + F.least(F.lit(WINDOW_WORDS), p - acc["at"])).cast("bigint").alias("n"), p.alias("at")),
            lambda acc: acc["n"])
        return F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0).cast("bigint")).otherwise(total)

    return F.when(last < 0, F.lit(0).cast("bigint")).otherwise(let(hashes, covered))


def signals(docs: DataFrame) -> DataFrame:
    """docs(doc_id, text, lang, source, ..) -> doc_id, lang, source, the base counts (long), base_failed and the rates of SIGNALS.

    Null text counts as empty. Rates of a text without words or lines are 0.
    """
    text = F.coalesce("text", F.lit(""))
    spaces = F.length(text) - F.length(F.translate(text, " \t\n\x0b\x0c\r", ""))

    def per_text(words: Column) -> Column:
        return F.struct(F.size(words).cast("bigint").alias("n_words"), _repeated_words(words).alias("n_repeat_words"))

    lines = F.filter(F.split(text, "\n", -1), lambda x: F.length(F.translate(x, " \t\x0b\x0c\r", "")) > 0)
    rows = docs.select(
        "doc_id", "lang", "source",
        let(F.filter(F.split(text, r"[\x20\x09-\x0D]+", -1), lambda w: w != ""), per_text).alias("w"),
        (F.length(text) - spaces).cast("bigint").alias("word_chars"),
        (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("bigint").alias("n_symbols"),
        let(lines, lambda x: F.struct(F.size(x).alias("n"), (F.size(x) - F.size(F.array_distinct(x))).cast("bigint").alias("dup"))).alias("l"),
        F.length(F.regexp_replace(text, r"[^\p{Lu}]+", "")).alias("n_upper"))
    n, one = F.col("w.n_words"), F.lit(1)
    return rows.select(
        "doc_id", "lang", "source", n.alias("n_words"), "word_chars", "n_symbols", F.col("l.dup").alias("n_dup_lines"), F.col("w.n_repeat_words").alias("n_repeat_words"),
        ((n < LEAST_WORDS) | (100 * F.col("w.n_repeat_words") > MOST_REPEATED_PERCENT * n)).alias("base_failed"),
        (F.col("word_chars") / F.greatest(n, one)).alias("mean_word"), (F.col("n_symbols") / F.greatest(n, one)).alias("symbol_rate"),
        (F.col("l.dup") / F.greatest("l.n", one)).alias("dup_line_rate"), (F.col("w.n_repeat_words") / F.greatest(n, one)).alias("repeat_rate"),
        (F.col("n_upper") / F.greatest("word_chars", one)).alias("upper_rate"))


def thresholds(rows: DataFrame, least_rows: int = LEAST_ROWS, k: int = SKETCH_K) -> DataFrame:
    """Fences per (lang, source) of signals(): one KLL sketch per group and signal; a language's sketch is the merge of its
    groups' sketches, and the sketch of all rows the merge of those, so the rows are read once.

    Texts that fail the base rules don't shape the fences. Returns lang, source (null is a group), and lo_/hi_ per signal
    from the finest level with `least_rows` rows."""
    names = [name for name, _, _ in SIGNALS]
    good = F.when(~F.col("base_failed"), F.lit(True))
    groups = checkpointed(rows.groupBy("lang", "source").agg(
        F.count(good).alias("n"), *[F.kll_sketch_agg_double(F.when(good, F.col(c)), F.lit(k)).alias(c) for c in names]))
    languages = checkpointed(groups.groupBy("lang").agg(F.sum("n").alias("n"), *[F.kll_merge_agg_double(c, F.lit(k)).alias(c) for c in names]))
    everything = languages.agg(F.sum("n").alias("n"), *[F.kll_merge_agg_double(c, F.lit(k)).alias(c) for c in names])

    def fences(sketches: DataFrame, prefix: str) -> list[Column]:
        out = []
        for name, below, above in SIGNALS:
            def quantile(p: float, name=name) -> Column:
                return F.when(F.col("n") > 0, F.kll_sketch_get_quantile_double(name, F.lit(p)))

            def tail(p: float) -> Column:
                return quantile(p) + TAIL_MARGIN * (quantile(p) - quantile(0.5))

            spread = FENCE * (quantile(0.75) - quantile(0.25))
            out.append(F.least(quantile(0.75) + F.greatest(spread, F.lit(above)), tail(TAIL)).alias(f"{prefix}hi_{name}"))
            if below is not None:
                out.append(F.greatest(quantile(0.25) - F.greatest(spread, F.lit(below)), tail(1 - TAIL)).alias(f"{prefix}lo_{name}"))
        return out

    fine = groups.select("lang", "source", F.col("n").alias("n0"), *fences(groups, "a_"))
    mid = languages.select(F.col("lang").alias("lang1"), F.col("n").alias("n1"), *fences(languages, "b_"))
    top = everything.select(*fences(everything, "c_"))
    levels = fine.join(mid, F.col("lang").eqNullSafe(F.col("lang1"))).join(F.broadcast(top))  # one row
    ends = [f"hi_{name}" for name in names] + [f"lo_{name}" for name, below, _ in SIGNALS if below is not None]
    return levels.select("lang", "source", *[
        F.when(F.col("n0") >= least_rows, F.col(f"a_{e}")).when(F.col("n1") >= least_rows, F.col(f"b_{e}")).otherwise(F.col(f"c_{e}")).alias(e) for e in ends])


def judged(docs: DataFrame, least_rows: int = LEAST_ROWS) -> DataFrame:
    """signals() with `kept` and `failed_rules`: base rules, then the group's fences, joined by (lang, source).

    One row per row of docs, repeats too; null lang or source form groups of their own; a group whose rows all fail the base
    rules, or an empty table, has no fence and fails nobody by one. Needs columns doc_id, text, lang, source; others are ignored.
    """
    rows = checkpointed(signals(docs))  # numbers only; read for the sketches and for the filter
    limits = thresholds(rows, least_rows).withColumnsRenamed({"lang": "_lang", "source": "_source"})
    joined = rows.join(limits, F.col("lang").eqNullSafe(F.col("_lang")) & F.col("source").eqNullSafe(F.col("_source")), "left")
    rules = [F.when(F.col(name) > F.col(f"hi_{name}"), F.lit(f"high_{name}")) for name, _, _ in SIGNALS]
    rules += [F.when(F.col(name) < F.col(f"lo_{name}"), F.lit(f"low_{name}")) for name, below, _ in SIGNALS if below is not None]
    failed = F.array_compact(F.array(F.when(F.col("base_failed"), F.lit("base")), *rules))
    return joined.withColumn("failed_rules", failed).withColumn("kept", F.size("failed_rules") == 0).select(*rows.columns, "kept", "failed_rules")


def digest(rows: DataFrame) -> DataFrame:
    return rows.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
