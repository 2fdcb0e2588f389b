"""Parsing of stored model outputs into columns, through VARIANT.

`parsed` is tolerant: reasoning blocks and fences go, the whole text is tried, then the first complete JSON value in
it. Only texts that fail the plain attempt reach the small Python step.
"""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evirank.domain import DIMENSIONS, INTERPRETATION_OPERATORS
from evirank.functions.text import col, first_filled, normalize_space, normalize_tag, tokenize

THINK = r"(?is)<think>.*?</think>"
# How a written verdict counts.
MATCHED = {"support": True, "contradict": False}


def cleaned(raw) -> Column:
    return F.regexp_replace(F.trim(F.regexp_replace(F.coalesce(col(raw), F.lit("")), THINK, "")), r"^`+|`+$", "")


def _first_complete(text: Column) -> Column:
    """Text of the first complete object in a string, else of the first array; null passes through."""
    def find(text):
        decoder = json.JSONDecoder()
        for opener in "{[":
            start = text.find(opener)
            if start >= 0:
                try:
                    return json.dumps(decoder.raw_decode(text, start)[0])
                except ValueError:
                    continue
        return None

    def batch(texts: pd.Series) -> pd.Series:
        return texts.map(find, na_action="ignore")

    return F.pandas_udf(batch, "string")(text)


def parsed(rows: DataFrame, raw: str = "raw_output", lists: bool = False) -> DataFrame:
    """Add `doc` (VARIANT or null) and `parse_ok` (an object was found).

    The first complete object counts, also inside a list that is valid JSON as a whole; with `lists` such a list stays the doc.
    """
    rows = rows.withColumn("_clean", cleaned(raw)).withColumn("_whole", F.try_parse_json("_clean"))
    good = F.col("_whole").isNotNull() if lists else F.coalesce(F.schema_of_variant("_whole").startswith("OBJECT"), F.lit(False))
    rows = rows.withColumn("_found", F.try_parse_json(_first_complete(F.when(~good, F.col("_clean")))))
    rows = rows.withColumn("doc", F.when(good, F.col("_whole")).otherwise(F.coalesce("_found", "_whole")))
    kind = F.schema_of_variant("doc")
    return rows.withColumn("parse_ok", F.coalesce(kind.startswith("OBJECT"), F.lit(False))).drop("_whole", "_found")


def text_at(*paths: str, doc: str = "doc") -> Column:
    """First non-empty scalar among the paths; lists are joined by a comma."""
    def one(path: str) -> Column:
        listed = F.array_join(F.transform(F.try_variant_get(doc, path, "array<string>"), normalize_space), ", ")
        return normalize_space(F.coalesce(listed, F.try_variant_get(doc, path, "string")))

    return first_filled(*map(one, paths))


def list_at(*paths: str, doc: str = "doc") -> Column:
    """First non-empty list among the paths; a string is cut at commas and semicolons."""
    def one(path: str) -> Column:
        items = F.coalesce(F.try_variant_get(doc, path, "array<string>"), F.split(F.try_variant_get(doc, path, "string"), "[,;]"))
        items = F.filter(F.transform(items, normalize_space), lambda x: x != "")
        return F.when(F.size(items) > 0, items)

    return F.coalesce(*map(one, paths), F.array().cast("array<string>"))


def bool_at(path: str, doc: str = "doc") -> Column:
    return F.lower(normalize_space(F.try_variant_get(doc, path, "string"))).isin("yes", "true", "1", "y")


def model_text(raw) -> Column:
    """Plain text of an answer without fences or quotes, spaces collapsed."""
    text = F.trim(F.regexp_replace(col(raw), THINK, ""))
    text = F.trim(F.regexp_replace(F.regexp_replace(text, r"(?i)^```(?:json)?\s*", ""), r"```$", ""))
    return normalize_space(F.regexp_replace(F.regexp_replace(text, '^"+|"+$', ""), "^'+|'+$", ""))


def query_description(raw: str, fallback) -> tuple[Column, Column]:
    """(query, found as a field): a named field of the object, else the cleaned text, else the fallback."""
    named = F.when(F.col("parse_ok"), text_at("$.query", "$.description", "$.retrieval_query")).otherwise(F.lit(""))
    return first_filled(named, model_text(raw), fallback), named != ""


def hypothesis(raw: str, fallback) -> dict[str, Column]:
    """Dimensions (upper or lower names, nested or top level), known operators, retrieval query."""
    nested = F.coalesce(F.schema_of_variant(F.variant_get("doc", "$.dimensions", "variant")).startswith("OBJECT"), F.lit(False))

    def value(d: str) -> Column:
        found = F.when(nested, text_at(f"$.dimensions.{d}", f"$.dimensions.{d.lower()}")).otherwise(text_at(f"$.{d}", f"$.{d.lower()}"))
        return F.when(found == "", "UNRESOLVED").otherwise(found)

    operators = F.filter(list_at("$.operators", "$.operator"), lambda o: o.isin(INTERPRETATION_OPERATORS))
    own = text_at("$.retrieval_query", "$.query", "$.semantic_description", "$.description")
    other, named = query_description(raw, fallback)
    return {
        "dimensions": F.create_map(*[x for d in DIMENSIONS for x in (F.lit(d), value(d))]),
        "operators": F.when(F.size(operators) > 0, operators).otherwise(F.array(F.lit("direct_label"))),
        "retrieval_query": first_filled(own, other),
        "hypothesis_ok": F.when(own != "", F.col("parse_ok")).otherwise(named),
    }


def surfaces(raw: str, fallback) -> dict[str, Column]:
    own = F.when(F.col("parse_ok"), text_at("$.grounding", "$.query", "$.retrieval_query", "$.semantic_description", "$.description"))
    other, named = query_description(raw, fallback)
    grounding = first_filled(own, other)
    compact = F.array_join(tokenize(grounding), " ")
    return {
        "grounding": grounding,
        "q_lab": first_filled(F.when(F.col("parse_ok"), text_at("$.q_lab", "$.label_query")), compact),
        "q_def": first_filled(F.when(F.col("parse_ok"), text_at("$.q_def", "$.definition_query")), grounding),
        "surface_ok": F.when(F.coalesce(own, F.lit("")) != "", F.col("parse_ok")).otherwise(named),
    }


def decomposed_queries(raw: str, fallback, n: int) -> Column:
    """n queries: a list of strings or objects, numbered keys, or lines; padded with the fallback."""
    def of_list(path: str) -> Column:
        return F.transform(F.try_variant_get("doc", path, "array<variant>"), lambda v: normalize_space(F.coalesce(
            F.nullif(F.try_variant_get(v, "$.query", "string"), F.lit("")), F.try_variant_get(v, "$.description", "string"),
            F.when(~F.schema_of_variant(v).startswith("OBJECT"), F.try_variant_get(v, "$", "string")))))

    listed = F.coalesce(*[of_list(p) for p in ("$.queries", "$.sub_queries", "$.retrieval_queries", "$")])
    numbered = F.array(*[text_at(f"$.query_{i}", f"$.query{i}") for i in range(1, n + 1)])

    def kept(items: Column) -> Column:
        items = F.filter(items, lambda q: q != "")
        return F.when(F.size(items) > 0, items)

    line = F.regexp_replace(model_text(raw), r"(?i)^(?:query|interpretation)\s*\d+\s*[:.)-]\s*", "")
    items = F.coalesce(kept(listed), kept(numbered), kept(F.array(line)), F.array().cast("array<string>"))
    return F.slice(F.concat(items, F.array_repeat(col(fallback), n)), 1, n)


def feedback() -> dict[str, Column]:
    mismatch = F.variant_get("doc", "$.structural_mismatch", "variant")
    is_object = F.coalesce(F.schema_of_variant(mismatch).startswith("OBJECT"), F.lit(False))
    return {
        "supported": list_at("$.supported_dimensions", "$['D+']", "$.supported"),
        "contradicted": list_at("$.contradicted_dimensions", "$['D-']", "$.contradicted"),
        "unresolved": list_at("$.unresolved_dimensions", "$['D?']", "$.unresolved"),
        "is_mismatch": F.when(is_object, bool_at("$.structural_mismatch.is_mismatch")).otherwise(bool_at("$.structural_mismatch")),
    }


def directive() -> dict[str, Column]:
    mode = F.upper(text_at("$.mode"))
    operator = text_at("$.operator")
    return {
        "mode": F.when(mode.isin("REFINE", "BRANCH", "CHANGE_STRATEGY"), mode).otherwise("BRANCH"),
        "operator": F.when(operator.isin(INTERPRETATION_OPERATORS), operator).otherwise("direct_label"),
        "target_dimension": F.upper(text_at("$.target_dimension", "$.dimension")),
        "semantic_patch": text_at("$.semantic_patch", "$.patch", "$.new_value"),
        "preserve": list_at("$.preserve", "$.preservation_set"),
        "rationale": text_at("$.rationale", "$.reason"),
    }


def _finished_entries(text: Column) -> Column:
    """JSON texts of the finished objects of a verdict list that may be cut off; null passes through.

    The list starts after the key "verdicts", else at the first bracket, and ends at its closing bracket. Objects are read by
    a JSON decoder, so braces inside strings and nested objects are no obstacle; one that doesn't decode is stepped over."""
    def find(text):
        decoder, out = json.JSONDecoder(), []
        named = re.search(r'"verdicts"\s*:\s*\[', text)
        at = named.end() if named else text.find("[") + 1
        while 0 < at < len(text) and text[at] != "]":
            if text[at] == "{":
                try:
                    entry, at = decoder.raw_decode(text, at)
                    out.append(json.dumps(entry))
                    continue
                except ValueError:
                    pass
            at += 1
        return out

    def batch(texts: pd.Series) -> pd.Series:
        return texts.map(find, na_action="ignore")

    return F.pandas_udf(batch, "array<string>")(text)


def verdict_entries(calls: DataFrame, dims: list[str], prefix: str = "") -> DataFrame:
    """calls(call_id, raw_output, candidate_tags): one row per judged (call, tag, dim) with the parse mode.

    A cut-off array still yields its finished entries; tags outside the window are dropped and later entries win. Tags count
    with or without the taxonomy prefix and leave as the window spells them.
    """
    rows = parsed(calls)
    clean = F.try_variant_get("doc", "$.verdicts", "array<variant>")
    whole = F.coalesce(F.size(clean) > 0, F.lit(False))
    text = F.regexp_replace("raw_output", THINK, "")
    salvaged = F.filter(F.transform(_finished_entries(F.when(~whole, text)), F.try_parse_json), lambda v: v.isNotNull())
    rows = rows.select(
        "call_id", "candidate_tags", "parse_ok", whole.alias("whole"),
        F.posexplode_outer(F.when(whole, clean).otherwise(salvaged)).alias("pos", "entry"))
    said = normalize_tag(F.try_variant_get("entry", "$.tag", "string"), prefix)
    own = F.filter("candidate_tags", lambda c: normalize_tag(c, prefix) == F.col("said"))
    allowed = rows.withColumn("said", said).withColumn("tag", F.try_element_at(own, F.lit(1))).where(F.col("tag").isNotNull())
    mode = F.when(F.col("whole"), "clean").otherwise("salvaged")
    words = [F.lower(F.trim(F.try_variant_get("entry", f"$.{d}", "string"))).alias(f"w{i}") for i, d in enumerate(dims)]
    # the last entry is an aggregate: a join of the parsed rows with themselves would parse all answers again
    judged = allowed.select("call_id", "tag", "pos", F.struct(mode.alias("parse_mode"), *words).alias("judged"))
    kept = judged.groupBy("call_id", "tag").agg(F.max_by("judged", "pos").alias("judged")).select("call_id", "tag", "judged.*")
    cells = []
    for i, d in enumerate(dims):
        matched = F.when(F.col(f"w{i}") == "support", F.lit(True)).when(F.col(f"w{i}") == "contradict", F.lit(False))
        cells.append(F.struct(F.lit(d.lower()).alias("dim"), matched.alias("matched")))
    return kept.select("call_id", "tag", "parse_mode", F.inline(F.array(*cells)))


def call_modes(calls: DataFrame, entries: DataFrame) -> DataFrame:
    """Parse mode per call; a call without a usable entry failed."""
    seen = entries.groupBy("call_id").agg(F.max("parse_mode").alias("mode"), F.countDistinct("tag").alias("n_tags"))
    return calls.select("call_id").join(seen, "call_id", "left").select(
        "call_id", F.coalesce("mode", F.lit("failed")).alias("parse_mode"), F.coalesce("n_tags", F.lit(0)).alias("n_tags"))


def decisive_dimensions(allowed: list[str]) -> Column:
    names = F.transform(F.try_variant_get("doc", "$.decisive_dimensions", "array<string>"), lambda x: F.upper(F.trim(x)))
    return F.coalesce(F.array_distinct(F.filter(names, lambda x: x.isin(allowed))), F.array().cast("array<string>"))


def ranked_tags(outputs: DataFrame, candidates: DataFrame, prefix: str = "") -> DataFrame:
    """outputs(fact_id, doc), candidates(fact_id, rank, tag): tags in the model's order, the selected one in front.

    Tags count with or without the taxonomy prefix and leave as the candidates spell them.
    """
    def column(*paths: str) -> Column:
        return F.concat(*[F.coalesce(F.try_variant_get("doc", p, "array<string>"), F.array().cast("array<string>")) for p in paths])

    by_index = column("$.ranked_indices", "$.ranking", "$.ranked_candidate_indices")
    by_tag = column("$.ranked_tags", "$.tags")
    mentions = outputs.select("fact_id", F.inline(F.concat(
        F.array(F.struct(F.lit(-2).alias("pos"), F.try_variant_get("doc", "$.selected_index", "string").alias("item"), F.lit(True).alias("is_index"))),
        F.array(F.struct(F.lit(-1).alias("pos"), F.try_variant_get("doc", "$.selected_tag", "string").alias("item"), F.lit(False).alias("is_index"))),
        F.transform(by_index, lambda x, i: F.struct(i.alias("pos"), x.alias("item"), F.lit(True).alias("is_index"))),
        F.transform(by_tag, lambda x, i: F.struct((i + 1_000_000).alias("pos"), x.alias("item"), F.lit(False).alias("is_index"))))))
    index_hits = mentions.where("is_index").withColumn("rank", F.expr("try_cast(item as int)")).join(
        candidates.select("fact_id", "rank", "tag"), ["fact_id", "rank"]).select("fact_id", "pos", "tag")
    tag_hits = mentions.where("NOT is_index").withColumn("_said", normalize_tag("item", prefix)).join(
        candidates.select("fact_id", "tag", normalize_tag("tag", prefix).alias("_said")), ["fact_id", "_said"]).select("fact_id", "pos", "tag")
    hits = index_hits.unionByName(tag_hits)
    # a valid selected index outranks a selected tag
    first = hits.where("pos < 0").groupBy("fact_id").agg(F.min_by("tag", "pos").alias("selected"))
    listed = hits.where("pos >= 0").unionByName(first.select("fact_id", F.lit(-1).alias("pos"), F.col("selected").alias("tag")))
    order = listed.groupBy("fact_id", "tag").agg(F.min("pos").alias("pos"))
    from evirank.operators.fuse import ranked

    return ranked(order, ["fact_id"], [F.asc("pos"), F.asc("tag")], None, "model_rank").select(
        "fact_id", "tag", "model_rank", (F.col("pos") < 0).alias("selected"))


def substring_field() -> Column:
    return F.try_variant_get("doc", "$.substring", "string")


def budgeted_prompt(rows: DataFrame, options: list[tuple[int, int]], build, max_tokens: int, count) -> DataFrame:
    """First (context size, document size) option whose text fits the budget, else the last option.

    `build(context, document)` gives the prompt column, `count(prompt)` its size.
    """
    prompts = F.array(*[F.struct(F.lit(i).alias("option"), build(a, b).alias("prompt")) for i, (a, b) in enumerate(options)])
    fits = F.filter(prompts, lambda p: count(p["prompt"]) <= max_tokens)
    return rows.withColumn("chosen", F.coalesce(F.try_element_at(fits, F.lit(1)), F.element_at(prompts, -1))).select("*", "chosen.*").drop("chosen")


def symbolic_hint(feedback_rows: DataFrame, only: list[str] | None = None) -> DataFrame:
    """feedback(fact_id, hyp_idx, dim, verdict): one sentence per side, empty when there is nothing to say."""
    rows = feedback_rows if only is None else feedback_rows.where(F.col("dim").isin(only))

    def names(verdict: str) -> Column:
        return F.array_join(F.array_sort(F.collect_list(F.when(F.col("verdict") == verdict, F.upper("dim")))), ", ")

    sums = rows.groupBy("fact_id", "hyp_idx").agg(names("contradict").alias("against"), names("support").alias("for"))
    parts = [F.when(F.col(c) != "", F.concat(F.lit(f"{label}: "), F.col(c))) for c, label in (("against", "Contradicted"), ("for", "Supported"))]
    return sums.select("fact_id", "hyp_idx", F.concat_ws(". ", *parts).alias("hint"))
