"""Expressions over diagnosis codes, offset positions and document segments."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evirank.functions.text import col, normalize_space

# Ordered text cues and the encounter category each one stands for.
TEMPORAL_CUES = [
    ("routine healing", "subsequent-routine-healing"),
    ("delayed healing", "subsequent-delayed-healing"),
    ("nonunion", "subsequent-nonunion"),
    ("malunion", "subsequent-malunion"),
    ("subsequent", "subsequent-encounter"),
    ("initial", "initial-encounter"),
    ("sequela", "sequela"),
    ("unspecified", "unspecified"),
    ("not applicable", "not-applicable"),
    ("fetus", "fetus-specific"),
    ("stage", "stage"),
]
# Ordered code classes, a pattern on the undotted code and its role.
CODE_ROLES = [
    (r"^(C|D0[0-79])", "neoplasm"),
    (r"^R", "symptom-sign-abnormal-finding"),
    (r"^[ST]", "injury-poisoning"),
    (r"^[VWXY]", "external-cause"),
    (r"^Z", "health-status-factor"),
    (r"^O", "pregnancy-related"),
    (r"^P", "perinatal"),
    (r"^Q", "congenital"),
]
# Fixed value: a sentence ends at . ! ? before a capital, digit, quote or the end, initials such as "A.B." aside.
SENTENCE_END = r"(?U)((?<!\.\p{Lu})\.|[!?])(?=\s*(?:\z|[\p{Lu}\p{Nd}\"¿¡]))"
CUT = "\ue000"


def _cases(pairs: list[tuple[Column, str]], default: str) -> Column:
    out = F
    for condition, value in pairs:
        out = out.when(condition, F.lit(value))
    return out.otherwise(F.lit(default))


def normalize_code(code) -> Column:
    return F.replace(F.upper(normalize_space(code)), F.lit("."), F.lit(""))


def dotted_code(code) -> Column:
    raw = normalize_code(code)
    return F.when(F.length(raw) <= 3, raw).otherwise(
        F.concat(F.substring(raw, 1, 3), F.lit("."), F.substring(raw, F.lit(4), F.length(raw)))
    )


def role_for_code(code) -> Column:
    raw = normalize_code(code)
    return _cases([(raw.rlike(pattern), role) for pattern, role in CODE_ROLES], "disease-disorder")


def temporal_category(text) -> Column:
    low = F.lower(col(text))
    return _cases([(low.contains(cue), name) for cue, name in TEMPORAL_CUES], "other-extension")


def parse_ranges(position) -> Column:
    """`"s e;s e"` to array<struct<s,e>>; parts that are not two numbers are left out."""
    parts = F.transform(F.split(col(position), ";"), lambda p: F.split(F.trim(p), r"\s+"))
    good = F.filter(parts, lambda p: (F.size(p) == 2) & F.forall(p, lambda x: x.rlike(r"^\d+$")))
    return F.transform(good, lambda p: F.struct(p[0].cast("int").alias("s"), p[1].cast("int").alias("e")))


def extract_span(text, ranges) -> Column:
    text = col(text)
    inside = F.filter(col(ranges), lambda r: (r.s <= r.e) & (r.e <= F.length(text)))
    return normalize_space(F.array_join(F.transform(inside, lambda r: F.substring(text, r.s + 1, r.e - r.s)), " "))


def sentence_spans(docs: DataFrame, key: str, text: str) -> DataFrame:
    """One row per sentence: key, idx from 0, character offsets, cleaned sentence; blank pieces are dropped."""
    pieces = F.split(F.regexp_replace(col(text), SENTENCE_END, "$1" + CUT), CUT)
    by_key = Window.partitionBy(key).orderBy("piece")
    rows = docs.select(key, F.posexplode(pieces).alias("piece", "body")).withColumn(
        "span_end", F.sum(F.length("body")).over(by_key)
    )
    return (
        rows.withColumn("span_start", F.col("span_end") - F.length("body"))
        .withColumn("sentence", normalize_space("body"))
        .where(F.col("sentence") != "")
        .withColumn("idx", F.row_number().over(by_key) - 1)
        .select(key, "idx", "span_start", "span_end", "sentence")
    )


#: Characters that end a line, a carriage return with its line feed counting once.
LINE_BREAKS = r"\n\x0B\f\r\x1C-\x1E\x{85}\x{2028}\x{2029}"


def line_spans(docs: DataFrame, key: str, text: str) -> DataFrame:
    """One row per line with offsets. Any line break ends a line; carriage return and line feed are not part of it, rarer ones are."""
    whole = F.regexp_extract_all(col(text), F.lit(rf"[^{LINE_BREAKS}]*(?:\r\n|[{LINE_BREAKS}])|[^{LINE_BREAKS}]+"), 0)
    by_key = Window.partitionBy(key).orderBy("idx")
    return (
        docs.select(key, F.posexplode(whole).alias("idx", "body"))
        .withColumn("next_start", F.sum(F.length("body")).over(by_key))
        .withColumn("line", F.regexp_replace("body", r"[\r\n]+\z", ""))
        .withColumn("span_start", F.col("next_start") - F.length("body"))
        .select(key, "idx", "span_start", (F.col("span_start") + F.length("line")).alias("span_end"), "line")
    )


def spans_touching(spans: DataFrame, ranges: DataFrame, key: str) -> DataFrame:
    """Spans that share a character with a range (s, e) of the same document."""
    hit = (F.col("s") < F.col("span_end")) & (F.col("e") > F.col("span_start"))
    return ranges.join(spans, key).where(hit)


def aligned_locus(requests: DataFrame, sentences: DataFrame, lines: DataFrame) -> DataFrame:
    """Target lines parallel to the source sentences a request touches, else the whole target document.

    requests(req_id, doc_id, ranges), sentences(doc_id, idx, span_start, span_end, sentence), lines(doc_id, idx, line)
    """
    counts = sentences.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_source"))
    targets = lines.groupBy("doc_id").agg(
        F.count(F.lit(1)).alias("n_target"),
        normalize_space(
            F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("idx", "line"))), lambda p: p["line"]), "\n")
        ).alias("document"),
    )
    ranges = requests.select("req_id", "doc_id", F.explode("ranges").alias("r")).select("req_id", "doc_id", "r.s", "r.e")
    touched = spans_touching(sentences, ranges, "doc_id").select("req_id", "doc_id", "idx").distinct()
    located = (
        touched.join(lines, ["doc_id", "idx"], "left")
        .groupBy("req_id")
        .agg(
            F.array_sort(F.collect_list("idx")).alias("sentence_indices"),
            F.count_if(F.col("line").isNull()).alias("n_outside"),
            F.array_sort(F.collect_list(F.struct("idx", "line"))).alias("parts"),
        )
    )
    joined = (
        requests.select("req_id", "doc_id")
        .join(counts, "doc_id", "left")
        .join(targets, "doc_id", "left")
        .join(located, "req_id", "left")
    )
    same = F.coalesce(F.col("n_source"), F.lit(0)) == F.coalesce(F.col("n_target"), F.lit(0))
    ok = same & F.col("parts").isNotNull() & (F.coalesce("n_outside", F.lit(0)) == 0)
    pieces = normalize_space(F.array_join(F.transform("parts", lambda p: p["line"]), " "))
    return joined.select(
        "req_id", "doc_id",
        F.coalesce("sentence_indices", F.array().cast("array<int>")).alias("sentence_indices"),
        same.alias("alignment_ok"),
        F.when(ok, F.lit("aligned_sentence")).otherwise(F.lit("document")).alias("locus_level"),
        F.when(ok, pieces).otherwise(F.coalesce("document", F.lit(""))).alias("locus"),
        F.when(ok, F.lit("")).otherwise(F.lit("sentence_count_mismatch_or_offset_out_of_range")).alias("fallback_reason"),
    )
