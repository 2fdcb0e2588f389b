"""Symbolic agreement between a concept and the dimensions of a hypothesis.

The vocabulary is a literal, so matching a text against it needs no join: concepts are profiled once, hypotheses are
normalised in place. A (concept, hypothesis) pair is judged from arrays already on its row, with one plain column per
dimension, so judging and scoring stay inside generated code.

  profiles(tag, tokens, cats struct<dimension: array<category>>)
  hypotheses(fact_id, hyp_idx, dims struct<dimension: struct<value, cats, tokens>>)      null = unresolved
  pairs(keys.., hyp_idx, tag, m_<dim> matched, e_<dim> by category, c_<dim> confidence)  m null = nothing to compare
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evirank.domain import DIMENSION_ALIASES, DIMENSIONS, STOPWORDS, UNRESOLVED, DomainConfig
from evirank.functions.text import join_filled, normalize_space, token_set

# The six dimensions and the optional aggregation reading.
JUDGED = [d.lower() for d in DIMENSIONS] + ["aggregation"]


def dimension_name(name) -> Column:
    key = F.replace(F.lower(normalize_space(name)), F.lit(" "), F.lit("_"))
    known = F.create_map(*[F.lit(x) for pair in DIMENSION_ALIASES.items() for x in pair])
    return F.coalesce(known[key], F.lower(normalize_space(name)))


def canonical_dimensions(dims: Column) -> Column:
    """map name -> value, to the six lower-case dimensions (and aggregation when given); unresolved becomes null."""
    names = JUDGED
    known = F.create_map(*[F.lit(x) for pair in DIMENSION_ALIASES.items() for x in pair])

    def named(entry: Column) -> Column:
        value = normalize_space(entry["value"])
        key = F.replace(F.lower(F.trim(entry["key"])), F.lit(" "), F.lit("_"))
        return F.struct(F.coalesce(known[key], key).alias("dim"), value.alias("value"))

    # one pass over the entries; a later entry for the same dimension replaces an earlier one
    start = F.map_from_arrays(F.array(*map(F.lit, names)), F.array_repeat(F.lit(None).cast("string"), len(names)))
    found = F.aggregate(F.transform(F.map_entries(dims), named), start, lambda acc, e: F.map_zip_with(
        acc, F.create_map(e["dim"], e["value"]),
        lambda k, old, new: F.when(k == e["dim"], F.when(~F.lower(new).isin(UNRESOLVED), new)).otherwise(old)))
    return F.map_filter(found, lambda k, v: k.isin(names[:-1]) | ((k == "aggregation") & v.isNotNull()))


def _phrase_tokens(phrase: str) -> list[str]:
    """Tokens of a vocabulary phrase; phrases are lower-case already, so only plurals and stopwords matter."""
    def fold(word: str) -> str:
        if len(word) > 4 and word.endswith("ies"):
            return word[:-3] + "y"
        return word[:-1] if len(word) > 3 and word.endswith("s") and not word.endswith("ss") else word

    words = [fold(w) for w in re.findall("[a-z0-9]+", phrase)]
    return list(dict.fromkeys(w for w in words if w not in STOPWORDS))


def _vocabulary(cfg: DomainConfig) -> Column:
    """Literal struct dimension -> array<struct<category, phrase, tokens>>, written as one expression."""
    def text(value: str) -> str:
        return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"

    def entry(category: str, phrase: str) -> str:
        tokens = ", ".join(text(w) for w in _phrase_tokens(phrase))
        return (f"named_struct('category', {text(category)}, 'phrase', {text(phrase)}, "
                f"'tokens', cast(array({tokens}) as array<string>))")

    cells = []
    for dimension in JUDGED:
        categories = cfg.vocabulary.get(dimension, {})
        entries = ", ".join(entry(c, p.lower()) for c, words in categories.items() for p in words)
        kind = "array<struct<category:string,phrase:string,tokens:array<string>>>"
        cells.append(f"{text(dimension)}, cast(array({entries}) as {kind})")
    return F.expr(f"named_struct({', '.join(cells)})")


def _matching(entries: Column, text: Column, tokens: Column) -> Column:
    """Sorted categories with a phrase that is a raw substring of the text or whose tokens all occur in it."""
    hits = F.filter(entries, lambda v: F.contains(text, v["phrase"]) | (
        (F.size(v["tokens"]) > 0) & (F.size(F.array_except(v["tokens"], tokens)) == 0)))
    return F.array_sort(F.array_distinct(F.transform(hits, lambda v: v["category"])))


def concept_profiles(concepts: DataFrame, cfg: DomainConfig, text_columns: list[str]) -> DataFrame:
    """Categories per dimension and tokens of each concept's joined text columns."""
    rows = concepts.select("tag", join_filled(text_columns, " ").alias("text"))
    rows = rows.select("tag", F.lower("text").alias("low"), token_set("text").alias("tokens"))
    vocabulary = _vocabulary(cfg)
    cats = [_matching(vocabulary[d], F.col("low"), F.col("tokens")).alias(d) for d in JUDGED]
    return rows.select("tag", "tokens", F.struct(*cats).alias("cats"))


def normalize_hypotheses(hypotheses: DataFrame, cfg: DomainConfig) -> DataFrame:
    """hypotheses(fact_id, hyp_idx, dimensions map) with the value, categories and tokens of each resolved dimension."""
    vocabulary = _vocabulary(cfg)
    rows = hypotheses.withColumn("_canon", canonical_dimensions(F.col("dimensions")))
    tokens = [F.struct(F.col("_canon")[d].alias("value"), token_set(F.lower(F.col("_canon")[d])).alias("tokens")).alias(d) for d in JUDGED]
    rows = rows.withColumn("_named", F.struct(*tokens))

    def normalized(d: str) -> Column:
        value, words = F.col("_named")[d]["value"], F.col("_named")[d]["tokens"]
        full = F.struct(value.alias("value"), _matching(vocabulary[d], F.lower(value), words).alias("cats"), words.alias("tokens"))
        return F.when(value.isNotNull(), full).alias(d)

    return rows.withColumn("dims", F.struct(*map(normalized, JUDGED))).drop("_canon", "_named")


def pair_verdicts(pool: DataFrame, hypotheses: DataFrame, profiles: DataFrame) -> DataFrame:
    """Judge every (candidate, hypothesis) of a fact; `pool` may carry hyp_idx to judge a list by its own hypothesis.

    A candidate meets its profile first and the hypotheses, one row per fact, last: what moves to the tags and back is one short row
    per candidate, no hypothesis does, and the judged pairs lie by fact for what follows.
    """
    own = "hyp_idx" in pool.columns
    stated = hypotheses.groupBy("fact_id").agg(F.collect_list(F.struct("hyp_idx", "dims")).alias("_stated"))
    mine = F.filter("_stated", lambda h: h["hyp_idx"] == F.col("hyp_idx")) if own else F.col("_stated")
    kept = [c for c in pool.columns if c != "hyp_idx"]
    rows = pool.join(profiles, "tag").join(stated, "fact_id").select(*kept, "tokens", "cats", F.inline(mine))
    out = {}
    for d in JUDGED:
        mine, theirs = F.col("dims")[d], F.col("cats")[d]
        resolved = mine.isNotNull()
        controlled = (F.size(mine["cats"]) > 0) | (F.size(theirs) > 0)
        comparable = (F.size(mine["tokens"]) > 0) & (F.size("tokens") > 0)
        overlap = F.size(F.array_intersect(mine["tokens"], F.col("tokens"))) / F.size(mine["tokens"])
        out[f"m_{d}"] = F.when(resolved & controlled, F.arrays_overlap(mine["cats"], theirs)).when(
            resolved & comparable, overlap >= 0.5)
        out[f"e_{d}"] = F.when(resolved, controlled)
        out[f"c_{d}"] = F.when(resolved & controlled, F.when(F.size(theirs) > 0, 0.85).otherwise(0.35)).when(
            resolved & comparable, F.least(F.lit(0.75), F.greatest(F.lit(0.2), overlap))).when(resolved, 0.0)
    return rows.select(*kept, "hyp_idx", *[c.alias(n) for n, c in out.items()])


#: Categories in one mask.
MASK = 62


def _masks(cats: Column, names: list[str]) -> list[Column]:
    """The categories as bits, as many to a bigint as it holds."""
    def mask(part: list[str]) -> Column:
        return sum((F.when(F.array_contains(cats, n), F.lit(1 << i).cast("bigint")).otherwise(F.lit(0).cast("bigint")) for i, n in enumerate(part)), F.lit(0).cast("bigint"))

    return [mask(names[i:i + MASK]) for i in range(0, len(names), MASK)]


def pair_bits(pool: DataFrame, hypotheses: DataFrame, profiles: DataFrame, cfg: DomainConfig, outer: bool = False) -> DataFrame:
    """`pair_verdicts` as three small numbers with a bit per dimension in the order of JUDGED: hit (matched), ruled (could be compared), held (resolved).

    Profiles move as one text of their tokens (tokens hold no spaces) and as category bits, hypotheses as bits and tokens; `cfg` names the
    vocabulary both were made with. `pool` may carry _hyps array<struct<hyp_idx, ..>>: those hypotheses judge the candidate, and the struct's other fields come out beside the pair.
    `outer` keeps candidates without profile or hypothesis; without _hyps they come once, with hyp_idx null.
    """
    names = {d: list(cfg.vocabulary.get(d, {})) for d in JUDGED}
    coded = profiles.select("tag", F.when(F.size("tokens") > 0, F.concat(F.lit(" "), F.array_join("tokens", " "), F.lit(" "))).otherwise("").alias("_words"),
                            *[m.alias(f"_k_{d}_{i}") for d in JUDGED for i, m in enumerate(_masks(F.col("cats")[d], names[d]))])
    cells = [F.col("hyp_idx")]
    for d in JUDGED:
        mine = F.col("dims")[d]
        cells += [F.transform(mine["tokens"], lambda t: F.concat(F.lit(" "), t, F.lit(" "))).alias(f"_t_{d}")]
        cells += [F.coalesce(m, F.lit(0).cast("bigint")).alias(f"_h_{d}_{i}") for i, m in enumerate(_masks(mine["cats"], names[d]))]
    stated = hypotheses.groupBy("fact_id").agg(F.collect_list(F.struct(*cells)).alias("_stated"))
    how, written = ("left", F.inline_outer) if outer else ("inner", F.inline)
    rows = pool.join(coded, "tag", how).join(stated, "fact_id", how)
    codes = [c for c in coded.columns if c != "tag"]
    kept, asked = [c for c in pool.columns if c != "_hyps"], F.col("_stated")
    if "_hyps" in pool.columns:
        rows = rows.select(*kept, *codes, "_stated", F.inline("_hyps"))
        kept = [c for c in rows.columns if c not in (*codes, "_stated")]
        asked = F.transform(F.filter("_stated", lambda h: h["hyp_idx"] == F.col("hyp_idx")), lambda h: h.dropFields("hyp_idx"))
    rows = rows.select(*kept, *codes, written(F.when(F.col("_words").isNotNull(), asked) if outer else asked))
    kept = [c for c in kept if c != "hyp_idx"]
    hit, ruled, held = [], [], []
    for at, d in enumerate(JUDGED):
        def either(conditions: list[Column]) -> Column:
            return reduce(Column.__or__, conditions, F.lit(False))

        places = range(-(-len(names[d]) // MASK))
        asks, has = F.col(f"_t_{d}"), [(F.col(f"_h_{d}_{i}"), F.col(f"_k_{d}_{i}")) for i in places]
        resolved = asks.isNotNull()
        controlled = either([(a != 0) | (b != 0) for a, b in has])
        shares = either([a.bitwiseAND(b) != 0 for a, b in has])
        comparable = (F.size(asks) > 0) & (F.col("_words") != "")
        found = F.size(F.filter(asks, lambda t: F.contains(F.col("_words"), t)))
        matched = F.when(controlled, shares).when(comparable, found * 2 >= F.size(asks)).otherwise(F.lit(False))
        for bits, condition in ((hit, resolved & matched), (ruled, resolved & (controlled | comparable)), (held, resolved)):
            bits.append(F.when(condition, F.lit(1 << at)).otherwise(F.lit(0)))
    return rows.select(*kept, "hyp_idx", sum(hit, F.lit(0)).alias("hit"), sum(ruled, F.lit(0)).alias("ruled"), sum(held, F.lit(0)).alias("held"))


def bits_agree() -> Column:
    """`agree_score` of pair bits."""
    return F.coalesce(F.try_divide(F.bit_count("hit"), F.bit_count("ruled")), F.lit(0.0))


def verdict_rows(pairs: DataFrame, keys: list[str]) -> DataFrame:
    """Long form of the resolved dimensions: keys, dim, matched, confidence, reason."""
    def reason(d: str) -> Column:
        by_category = F.when(F.col(f"c_{d}") == 0.35, "candidate_missing_controlled_category").otherwise(
            "controlled_category_intersection")
        return F.when(F.col(f"e_{d}"), by_category).when(F.col(f"m_{d}").isNotNull(), "token_overlap").otherwise(
            "no_comparable_tokens")

    cells = [F.struct(F.lit(d).alias("dim"), F.col(f"m_{d}").alias("matched"), F.col(f"e_{d}").alias("exact"),
                      F.col(f"c_{d}").alias("confidence"), reason(d).alias("reason")) for d in JUDGED]
    return pairs.select(*keys, F.inline(F.array(*cells))).where(F.col("exact").isNotNull())


def stated_verdicts(pool: DataFrame, hypotheses: DataFrame, profiles: DataFrame) -> DataFrame:
    """`verdict_rows` of every (candidate, hypothesis) straight from what the hypotheses state: one row per resolved dimension, judged
    once with one expression, where the pairs' wide form judges all dimensions of a pair, resolved or not, before it is made long."""
    entries = [F.when(F.col("dims")[d].isNotNull(), F.struct("hyp_idx", F.lit(d).alias("dim"), F.lit(i).alias("_at"), F.col("dims")[d]["cats"].alias("_cats"),
                                                             F.col("dims")[d]["tokens"].alias("_tokens"))) for i, d in enumerate(JUDGED)]
    stated = hypotheses.groupBy("fact_id").agg(F.flatten(F.collect_list(F.array_compact(F.array(*entries)))).alias("_stated"))
    known = profiles.select("tag", "tokens", F.array(*[F.col("cats")[d] for d in JUDGED]).alias("cats"))
    rows = pool.join(known, "tag").join(stated, "fact_id").select(*pool.columns, "tokens", "cats", F.inline("_stated"))
    rows = rows.select(*pool.columns, "hyp_idx", "dim", "tokens", "_cats", "_tokens", F.get("cats", F.col("_at")).alias("_theirs"))
    by_category = (F.size("_cats") > 0) | (F.size("_theirs") > 0)
    share = F.size(F.array_intersect("_tokens", "tokens")) / F.size("_tokens")
    rows = rows.withColumns({"_exact": by_category, "_share": F.when(~by_category & (F.size("_tokens") > 0) & (F.size("tokens") > 0), share)})
    has_category, by_token = F.size("_theirs") > 0, F.col("_share").isNotNull()
    # only a share has more than six digits to round
    confidence = F.when(F.col("_exact"), F.when(has_category, 0.85).otherwise(0.35)).when(
        by_token, F.when(F.col("_share") >= 0.75, 0.75).when(F.col("_share") <= 0.2, 0.2).otherwise(F.round("_share", 6))).otherwise(0.0)
    reason = F.when(F.col("_exact"), F.when(has_category, "controlled_category_intersection").otherwise("candidate_missing_controlled_category")).when(
        by_token, "token_overlap").otherwise("no_comparable_tokens")
    return rows.select(*pool.columns, "hyp_idx", "dim", F.when(F.col("_exact"), F.arrays_overlap("_cats", "_theirs")).otherwise(F.col("_share") >= 0.5).alias("matched"),
                       confidence.alias("confidence"), reason.alias("reason"))


def _tally(flags: list[Column]) -> Column:
    """How many of the conditions hold; null counts as no."""
    return sum((F.coalesce(f.cast("int"), F.lit(0)) for f in flags), F.lit(0))


def count_matched() -> Column:
    return _tally([F.col(f"m_{d}") for d in JUDGED])


def count_evaluated() -> Column:
    return _tally([F.col(f"m_{d}").isNotNull() for d in JUDGED])


def agree_score() -> Column:
    """Share of the evaluated dimensions that match; 0 when none was evaluated."""
    return F.coalesce(F.try_divide(count_matched(), count_evaluated()), F.lit(0.0))


def consensus(pairs: DataFrame, keys: tuple = ("fact_id",)) -> DataFrame:
    """Mean agreement over the hypotheses."""
    return pairs.groupBy(*keys, "tag").agg(F.avg(agree_score()).alias("consensus"))


def mean_agreement(pairs: DataFrame, top_m: int) -> DataFrame:
    """pairs with rank: mean agreement of the first m candidates of each list with its own hypothesis."""
    head = pairs.where(F.col("rank") <= top_m)
    return head.groupBy("fact_id", "hyp_idx").agg(F.avg(agree_score()).alias("mean_agreement"))


def select_hypothesis(scores: DataFrame, score: str = "mean_agreement") -> DataFrame:
    """For each prefix of j hypotheses the best-scored index; the lower index wins a tie."""
    by_fact = Window.partitionBy("fact_id").orderBy("hyp_idx")
    prefix = by_fact.rowsBetween(Window.unboundedPreceding, 0)
    key = F.struct(F.round(score, 10), -F.col("hyp_idx"))
    return scores.select(
        "fact_id", F.row_number().over(by_fact).alias("j"),
        F.max_by("hyp_idx", key).over(prefix).alias("selected_hyp"))


def dimension_feedback(pairs: DataFrame, hypotheses: DataFrame, top_m: int) -> DataFrame:
    """Per (fact, hypothesis, dimension): support share over the first m candidates and the resulting verdict."""
    every = hypotheses.select("fact_id", "hyp_idx", F.explode(F.array(*[F.lit(d.lower()) for d in DIMENSIONS])).alias("dim"))
    shares = (
        verdict_rows(pairs.where(F.col("rank") <= top_m), ["fact_id", "hyp_idx"])
        .groupBy("fact_id", "hyp_idx", "dim")
        .agg(F.avg(F.col("matched").cast("double")).alias("share"))
    )
    share = F.col("share")
    verdict = F.when(share >= 0.6, "support").when(share <= 0.25, "contradict").otherwise("unresolved")
    confidence = F.when(share.isNull(), 0.0).otherwise(F.abs(share - 0.5) * 2)
    return every.join(shares, ["fact_id", "hyp_idx", "dim"], "left").select(
        "fact_id", "hyp_idx", "dim", F.coalesce("share", F.lit(0.0)).alias("share"), verdict.alias("verdict"),
        confidence.alias("confidence"))


def structural_mismatch(feedback: DataFrame) -> DataFrame:
    """Two or more of family, role and event contradicted."""
    structural = (F.col("verdict") == "contradict") & F.col("dim").isin("family", "role", "event")
    return feedback.groupBy("fact_id", "hyp_idx").agg((F.count_if(structural) >= 2).alias("is_mismatch"))


def merge_feedback(first: DataFrame, second: DataFrame) -> DataFrame:
    """Second layer fills what the first leaves open; on conflict the first stays, flagged and less confident."""
    keys = ["fact_id", "hyp_idx", "dim"]
    other = second.select(*keys, F.col("verdict").alias("other"))
    joined = first.join(other, keys, "full")
    has_other = F.col("other").isNotNull()
    is_open = F.col("verdict").isNull() | (F.col("verdict") == "unresolved")
    conflict = has_other & ~is_open & (F.col("other") != F.col("verdict")) & (F.col("other") != "unresolved")
    takes = has_other & is_open
    return joined.select(
        *keys,
        F.when(takes, F.col("other")).otherwise(F.col("verdict")).alias("verdict"),
        F.when(takes, F.lit(0.6))
        .when(conflict, F.greatest(F.lit(0.1), F.col("confidence") - 0.2))
        .otherwise(F.col("confidence")).alias("confidence"),
        conflict.alias("disagrees"),
        F.when(takes, "second").otherwise("first").alias("layer"))


def decompose(pairs: DataFrame, top_m: int) -> DataFrame:
    """Exact and lexical support per (fact, hypothesis) over the first m candidates, with each layer's choice."""
    def share(a: str, b: str) -> Column:
        return F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(F.lit(0.0))

    def layer(exact: bool, matched: bool) -> Column:
        flags = []
        for d in JUDGED:
            own = F.col(f"e_{d}") if exact else ~F.col(f"e_{d}")
            flags.append(own & (F.col(f"m_{d}") if matched else F.col(f"m_{d}").isNotNull()))
        return F.sum(_tally(flags))

    sums = pairs.where(F.col("rank") <= top_m).groupBy("fact_id", "hyp_idx").agg(
        layer(True, True).alias("exact_support"), layer(True, False).alias("exact_evaluated"),
        layer(False, True).alias("lexical_support"), layer(False, False).alias("lexical_evaluated"),
        F.sum(_tally([F.col(f"e_{d}").isNotNull() for d in JUDGED])).alias("judged"))
    scored = sums.withColumns({
        "exact_score": share("exact_support", "exact_evaluated"),
        "lexical_score": share("lexical_support", "lexical_evaluated"),
        "_s": F.col("exact_support") + F.col("lexical_support"), "_e": F.col("exact_evaluated") + F.col("lexical_evaluated"),
    }).withColumn("overall_score", share("_s", "_e")).withColumn("unresolved", F.col("judged") - F.col("_e"))
    flags = {}
    for layer in ("overall", "exact", "lexical"):
        best = Window.partitionBy("fact_id").orderBy(F.desc(F.round(f"{layer}_score", 10)), F.asc("hyp_idx"))
        flags[f"selected_by_{layer}"] = F.row_number().over(best) == 1
    return scored.withColumns(flags).drop("_s", "_e", "judged")


def decomposition_summary(detail: DataFrame, by: str) -> DataFrame:
    """Pooled and per-slice shares of each layer and how often its choice equals the overall one."""
    def total(a: str, b: Column) -> Column:
        return F.coalesce(F.round(F.try_divide(F.sum(a), F.sum(b)), 6), F.lit(0.0))

    def among_selected(value: Column) -> Column:
        return F.round(F.avg(F.when(F.col("selected_by_overall"), value)), 6)

    both = F.col("exact_evaluated") + F.col("lexical_evaluated")
    return detail.groupingSets([[F.col(by)], []], F.col(by)).agg(
        F.count(F.lit(1)).alias("hypothesis_rows"), F.countDistinct("fact_id").alias("fact_count"),
        total("exact_support", F.col("exact_evaluated")).alias("exact_support_fraction"),
        total("lexical_support", F.col("lexical_evaluated")).alias("lexical_support_fraction"),
        total("lexical_evaluated", both).alias("lexical_evaluated_fraction"),
        among_selected(F.col("selected_by_exact").cast("double")).alias("exact_matches_overall"),
        among_selected(F.col("selected_by_lexical").cast("double")).alias("lexical_matches_overall"),
        among_selected(F.col("exact_score")).alias("selected_mean_exact"),
    ).withColumn(by, F.coalesce(by, F.lit("pooled")))
