"""Personal data: base patterns as seeds, lexical patterns induced from their contexts, graph scores, newly found identifiers.

Column expressions and joins only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evirank.llm.common import checkpointed, let, tag

#: Base patterns, leftmost without overlap. Repetitions are possessive, which changes no match (nothing that follows could use
#: what they give back) and keeps the matcher from recursing over long runs of digits. A match starts at the head of its run or where
#: the match before ended: a later start in a run could only match where the head does, so a long run is read once.
PATTERNS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9]++(?:[\x20-][0-9]++)*+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
KINDS = list(PATTERNS)
#: What may be an identifier that the base patterns miss: a run with a digit or @, long enough (see _candidates).
CANDIDATE = r"(?<![A-Za-z._%+-])[A-Za-z._%+-]*+[0-9@][A-Za-z0-9._%+@-]*+"
#: The same written in groups: runs of digits joined by single spaces, dots, hyphens or round brackets.
GROUPED = r"\(?[0-9]++(?:\)?[\x20.-]?\(?[0-9]++)*+"
LEAST_DIGITS = 6
#: Code points of context looked at on either side.
CONTEXT = 48
#: Scoring rounds of a hop; a pattern counts once it has so many distinct seed values, and finds identifiers from this confidence on.
ROUNDS = 3
LEAST_SEEDS = 5
CONFIDENT = 0.8
#: Pattern confidence is a mean over its instances with so many imagined misses added.
PRIOR = 1.0

SPAN = "array<struct<kind:int,start:int,end:int,value:string>>"


def _placed(text: Column, pattern: str, kind: int, valid) -> Column:
    """Valid matches as SPAN. Their places follow from the lengths of the matches and of what lies between them."""
    start = F.struct(F.lit(0).alias("at"), F.array().cast(SPAN).alias("out"))
    between = F.split(text, pattern, -1)
    matches = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    parts = F.zip_with(between, matches, lambda gap, match: F.struct(F.length(gap).alias("gap"), match.alias("match")))

    def step(acc: Column, part: Column) -> Column:
        at = acc["at"] + part["gap"]
        end = at + F.length(part["match"])
        span = F.struct(F.lit(kind).alias("kind"), at.alias("start"), end.alias("end"), part["match"].alias("value"))
        grown = F.when(valid(part["match"]), F.concat(acc["out"], F.array(span))).otherwise(acc["out"]).cast(SPAN)
        return F.struct(end.alias("at"), grown.alias("out"))

    return F.aggregate(F.filter(parts, lambda p: p["match"].isNotNull()), start, step, lambda acc: acc["out"])


def _part_ok(part: Column) -> Column:
    return let(F.regexp_replace(part, "^0+", ""), lambda z: (F.length(z) <= 3) & (F.coalesce(F.try_to_number(F.lpad(z, 3, "0"), F.lit("999")), F.lit(0)) <= 255))


def base_spans(text: Column) -> Column:
    """All base spans of a text, ordered by kind as listed, then start."""
    digits = lambda m, other: F.regexp_replace(m, other, "")
    checks = {
        "email": (F.contains(text, F.lit("@")), lambda m: F.lit(True)),
        "ip": (text.rlike(r"[0-9]\.[0-9]"), lambda m: F.forall(F.split(m, r"\."), _part_ok)),
        "card": (text.rlike("[0-9]"), lambda m: let(digits(m, "[ -]"), lambda d: F.length(d).between(13, 19) & F.call_function("luhn_check", d))),
        "phone": (F.contains(text, F.lit("+")), lambda m: F.length(digits(m, "[^0-9]")).between(9, 15)),
    }
    none = F.array().cast(SPAN)
    return F.concat(*[F.when(gate, _placed(text, PATTERNS[kind], i, valid)).otherwise(none) for i, (kind, (gate, valid)) in enumerate(checks.items())])


def _candidates(text: Column, taken: Column) -> Column:
    """Runs that look like an identifier and overlap no base span; kind -1. Digit groups that are joined count as one run, looked for
    beside the base spans; a single run of digits inside it is no candidate of its own."""
    def valid(m: Column) -> Column:
        return (F.length(F.regexp_replace(m, "[^0-9]", "")) >= LEAST_DIGITS) | (F.contains(m, F.lit("@")) & (F.length(m) >= LEAST_DIGITS))

    def joined(m: Column) -> Column:
        return m.rlike(r"[\x20()]") & (F.length(F.regexp_replace(m, "[^0-9]", "")) >= LEAST_DIGITS)

    def unbracketed(c: Column) -> Column:
        """Without an opening bracket that nothing closes."""
        cut = F.when(F.startswith(c["value"], F.lit("(")) & ~F.contains(c["value"], F.lit(")")), 1).otherwise(0)
        return let(cut, lambda k: F.struct(c["kind"].alias("kind"), (c["start"] + k).alias("start"), c["end"].alias("end"), F.substring(c["value"], k + 1, F.length(c["value"])).alias("value")))

    masked = F.aggregate(taken, text, lambda acc, b: F.concat(
        F.substring(acc, F.lit(1), b["start"]), F.repeat(F.lit("\x01"), b["end"] - b["start"]), F.substring(acc, b["end"] + 1, F.length(acc))))
    groups = F.when(text.rlike(r"[0-9][\x20()]+[0-9]|\([0-9]"), F.transform(let(masked, lambda t: _placed(t, GROUPED, -1, joined)), unbracketed)).otherwise(F.array().cast(SPAN))

    found = F.when(text.rlike("[0-9@]"), _placed(text, CANDIDATE, -1, valid)).otherwise(F.array().cast(SPAN))
    trimmed = F.transform(found, lambda c: let(F.regexp_replace(c["value"], r"[._%+-]+$", ""), lambda v: F.struct(
        c["kind"].alias("kind"), c["start"].alias("start"), (c["start"] + F.length(v)).alias("end"), v.alias("value"))))
    apart = F.filter(trimmed, lambda c: ~F.exists(taken, lambda b: (c["start"] < b["end"]) & (b["start"] < c["end"])))

    def whole(g: Column) -> Column:
        return F.concat(g, F.filter(apart, lambda c: c["value"].rlike("[A-Za-z@]") | ~F.exists(g, lambda b: (b["start"] <= c["start"]) & (c["end"] <= b["end"]))))

    return let(groups, whole)


def _contexts(text: Column, span: Column) -> Column:
    """Lexical patterns of a span: the word before, the two words before, the word after (lower case)."""
    before = F.lower(F.substring(text, F.greatest(span["start"] - CONTEXT, F.lit(0)) + 1, F.least(span["start"], F.lit(CONTEXT))))
    after = F.lower(F.substring(text, span["end"] + 1, F.lit(CONTEXT)))
    one = F.regexp_extract(before, r"([^\x20\x09-\x0D]+)[\x20\x09-\x0D]*$", 1)
    two = F.regexp_extract(before, r"([^\x20\x09-\x0D]+[\x20\x09-\x0D]+[^\x20\x09-\x0D]+)[\x20\x09-\x0D]*$", 1)
    right = F.regexp_extract(after, r"^[\x20\x09-\x0D]*([^\x20\x09-\x0D]+)", 1)
    named = [F.when(value != "", F.concat(F.lit(name), value)) for name, value in (("1<", one), ("2<", two), ("1>", right))]
    return F.array_compact(F.array(*named))


def extracted(docs: DataFrame) -> DataFrame:
    """docs(doc_id, text, ..) -> doc_id, text_hash, base SPAN, seen array<struct<kind, start, end, value, patterns>>; one row per row of docs."""
    text = F.coalesce("text", F.lit(""))

    def per_text(t: Column) -> Column:
        return let(base_spans(t), lambda base: F.struct(base.alias("base"), F.transform(
            F.concat(base, _candidates(t, base)), lambda s: F.struct(
                s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end"), F.lower(s["value"]).alias("value"), _contexts(t, s).alias("patterns"))).alias("seen")))

    # a text without digit or @ has neither seeds nor candidates
    found = F.when(text.rlike("[0-9@]"), let(text, per_text))
    return docs.select("doc_id", F.xxhash64("text").alias("text_hash"), found.alias("f")).select(
        "doc_id", "text_hash", F.coalesce("f.base", F.array().cast(SPAN)).alias("base"), F.col("f.seen").alias("seen"))


def scored_patterns(edges: DataFrame, rounds: int = ROUNDS, least_seeds: int = LEAST_SEEDS) -> DataFrame:
    """edges(pattern, value, kind) -> (pattern, kind, confidence) of patterns with enough distinct seeds of that kind.

    The graph joins patterns to instances (values). In each round a pattern's confidence for a kind is the mean confidence of its
    instances, smoothed by PRIOR; an instance that is no seed takes the noisy-or of its patterns. Seeds stay at 1 for their kind
    and 0 for others. All sums are combined before the shuffle, so a frequent pattern or value gathers nowhere."""
    seeds = edges.where("kind >= 0").groupBy("pattern", "kind").agg(F.count(F.lit(1)).alias("seeds")).where(F.col("seeds") >= least_seeds)
    seeds = checkpointed(seeds)
    sizes = checkpointed(edges.groupBy("pattern").agg(F.count(F.lit(1)).alias("n")).join(seeds, "pattern").select("pattern", "kind", "n", "seeds"))
    unknown = checkpointed(edges.where("kind < 0").select("pattern", "value").join(seeds.select("pattern", "kind"), "pattern"))
    scores = sizes.select("pattern", "kind", (F.col("seeds") / (F.col("n") + PRIOR)).alias("confidence"))
    for _ in range(rounds - 1):
        instances = unknown.join(scores, ["pattern", "kind"]).groupBy("value", "kind").agg(
            (1 - F.exp(F.sum(F.log(F.greatest(1 - F.col("confidence"), F.lit(1e-9)))))).alias("belief"))
        gained = unknown.join(instances, ["value", "kind"]).groupBy("pattern", "kind").agg(F.sum("belief").alias("gained"))
        scores = checkpointed(sizes.join(gained, ["pattern", "kind"], "left").select(
            "pattern", "kind", ((F.col("seeds") + F.coalesce("gained", F.lit(0.0))) / (F.col("n") + PRIOR)).alias("confidence")))
    return scores


def learned_patterns(occurrences: DataFrame, confident: float = CONFIDENT) -> DataFrame:
    """occurrences(kind, value, patterns, ..) -> (pattern, kind, confidence) of the patterns that were confident in some hop.

    After each hop the values that a confident pattern found become seeds of its kind (that of the most confident; ties: listed first)
    and all patterns are counted anew, so contexts seen only around found values are induced too. Values not found stay in the counts
    as evidence against. Edges are counted once however often they occur. Ends when a hop finds nothing new; no count of hops is set."""
    edges = checkpointed(occurrences.select("value", F.explode("patterns").alias("pattern"), "kind").groupBy("pattern", "value").agg(F.max("kind").alias("kind")))
    known = None
    while True:
        sure = checkpointed(scored_patterns(edges).where(F.col("confidence") >= confident))
        known = sure if known is None else checkpointed(known.unionByName(sure).groupBy("pattern", "kind").agg(F.max("confidence").alias("confidence")))
        fresh = checkpointed(edges.where("kind < 0").select("pattern", "value").join(sure, "pattern").groupBy("value").agg(
            F.min(F.struct((-F.col("confidence")).alias("c"), F.col("kind").alias("kind")))["kind"].alias("as_kind")))
        if fresh.isEmpty():
            return known
        edges = checkpointed(edges.join(fresh, "value", "left").select(
            "pattern", "value", F.when(F.col("kind") < 0, F.coalesce("as_kind", "kind")).otherwise(F.col("kind")).alias("kind")))


def find_pii(docs: DataFrame, confident: float = CONFIDENT) -> DataFrame:
    """docs(doc_id, text, ..) -> doc_id, text_hash, base SPAN, found SPAN (added by the method), one row per row of docs.

    Spans are code-point offsets, end exclusive. Null text is empty and has none. Rows that repeat, or share a null doc_id, are
    told apart by the hash of their text; equal rows get equal spans. A candidate is added under the kind of its most confident
    pattern (ties: the kind listed first). Other columns are ignored; an empty table gives no rows.
    """
    rows = checkpointed(extracted(docs))  # spans and short contexts, no texts
    occurrences = rows.where(F.size("seen") > 0).select("doc_id", "text_hash", F.explode("seen").alias("s")).select("doc_id", "text_hash", "s.*")
    patterns = learned_patterns(occurrences, confident).withColumnRenamed("kind", "as_kind")
    open_ = occurrences.where("kind < 0").select("doc_id", "text_hash", "start", "end", "value", F.explode("patterns").alias("pattern"))
    best = open_.join(patterns, "pattern").groupBy("doc_id", "text_hash", "start", "end", "value").agg(
        F.min(F.struct((-F.col("confidence")).alias("c"), F.col("as_kind").alias("kind"))).alias("b"))
    found = best.groupBy(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash")).agg(
        F.array_sort(F.collect_list(F.struct(F.col("b.kind").alias("kind"), "start", "end", "value"))).alias("found"))
    joined = rows.join(found, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("text_hash") == F.col("_hash")), "left")
    return joined.select("doc_id", "text_hash", "base", F.coalesce("found", F.array().cast(SPAN)).cast(SPAN).alias("found"))


def _listed(spans: Column) -> Column:
    kinds = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(kinds, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def digest(found: DataFrame) -> DataFrame:
    def count(kind: int) -> Column:
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("bigint")

    counts = [count(i).alias(f"n_{kind}") for i, kind in enumerate(KINDS)]
    return found.select("doc_id", *counts, F.sha2(_listed(F.col("base")).cast("binary"), 256).alias("base_sha256"),
                        _listed(F.array_sort(F.concat("base", "found"))).alias("spans"))


def redact(docs: DataFrame) -> DataFrame:
    """docs with every span of find_pii() replaced by its kind in angle brackets; overlapping spans become one. Other columns pass
    through, but n_chars, if there, is set to the new length of a changed text. Null text stays null."""
    key, id_, spans = f"hash_{tag()}", f"id_{tag()}", f"spans_{tag()}"
    found = find_pii(docs).select(F.col("doc_id").alias(id_), F.col("text_hash").alias(key), F.concat("base", "found").alias(spans)).where(
        F.size(spans) > 0).dropDuplicates([id_, key])
    joined = docs.join(found, F.col("doc_id").eqNullSafe(F.col(id_)) & (F.xxhash64("text") == F.col(key)), "left")
    kinds = F.array(*[F.lit(f"<{k}>") for k in KINDS])
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("parts"))

    def step(acc: Column, s: Column) -> Column:
        gap = F.substring("text", acc["at"] + 1, s["start"] - acc["at"])
        grown = F.concat(acc["parts"], F.array(gap, F.element_at(kinds, s["kind"] + 1)))
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), F.when(s["start"] >= acc["at"], grown).otherwise(acc["parts"]).alias("parts"))

    ordered = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"], s["end"], s["kind"])))
    changed = F.aggregate(ordered, start, step, lambda acc: F.concat(F.array_join(acc["parts"], ""), F.substring("text", acc["at"] + 1, F.length("text"))))
    hit = F.col(spans).isNotNull()
    out = joined.withColumn("text", F.when(hit, changed).otherwise(F.col("text")))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(hit, F.length("text")).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType))
    return out.select(*docs.columns)
