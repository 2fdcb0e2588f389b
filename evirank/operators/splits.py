"""Entity tables, strata, quotas, samples and splits."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evirank.functions.text import md5_int
from evirank.session import checkpointed

#: Orders of many attempts are lines modulo a prime.
PRIME = 2**31 - 1


def split_differences(rows: DataFrame) -> DataFrame:
    """rows(split, sample_id, context_id, tag): overlaps and differences between train and test, one row."""
    def sides(column: str) -> DataFrame:
        flags = rows.groupBy(column).agg(
            F.max((F.col("split") == "train").cast("int")).alias("tr"), F.max((F.col("split") == "test").cast("int")).alias("te"))
        return flags.agg(
            F.coalesce(F.sum(F.col("tr") * F.col("te")), F.lit(0)).alias("both"),
            F.coalesce(F.sum(F.col("tr") * (1 - F.col("te"))), F.lit(0)).alias("train_only"),
            F.coalesce(F.sum(F.col("te") * (1 - F.col("tr"))), F.lit(0)).alias("test_only"))

    ids = sides("sample_id").select(F.col("both").alias("id_overlap"))
    contexts = sides("context_id").select(F.col("both").alias("context_overlap"))
    tags = sides("tag").select(F.col("test_only").alias("missing_in_train"), "train_only", F.col("both").alias("shared"))
    # three one-row frames side by side
    return ids.join(contexts).join(tags)


def seeded_sample(rows: DataFrame, key: str, seed: int, n: int) -> DataFrame:
    """n rows in the order of md5(seed-key): the same rows on any engine and any partitioning."""
    order = F.md5(F.concat_ws("-", F.lit(str(seed)), F.col(key).cast("string")))
    return rows.orderBy(order, key).limit(n)


def hashed_order(rows: DataFrame, key: str, seed, groups: list[str], value: str | None = None, digits: int = 3) -> DataFrame:
    """Add `place` (1, 2, ..) in md5(seed-key) order per group, and `running` (sum of value up to the row).

    The md5 prefix cuts each group into 16^digits even buckets, so a group of any size is ordered by many tasks; only
    the bucket totals (at most 16^digits per group) pass through one window.
    """
    seed = F.lit(str(seed)) if not hasattr(seed, "cast") else seed.cast("string")
    rows = rows.withColumn("_h", F.md5(F.concat_ws("-", seed, F.col(key).cast("string")))).withColumn(
        "_b", F.substring("_h", 1, digits)).withColumn("_v", F.lit(1) if value is None else F.col(value))
    totals = rows.groupBy(*groups, "_b").agg(F.count(F.lit(1)).alias("_n"), F.sum("_v").alias("_s"))
    before = Window.partitionBy(*groups).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(*groups, "_b", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_n0"),
                            F.coalesce(F.sum("_s").over(before), F.lit(0)).alias("_s0"))
    within = Window.partitionBy(*groups, "_b").orderBy("_h", key)
    numbered = rows.withColumns({"_p": F.row_number().over(within), "_r": F.sum("_v").over(within.rowsBetween(Window.unboundedPreceding, 0))})
    joined = numbered.join(offsets, [*groups, "_b"])
    return joined.withColumns({"place": F.col("_n0") + F.col("_p"), "running": F.col("_s0") + F.col("_r")}).drop(
        "_h", "_b", "_v", "_n0", "_s0", "_p", "_r")


def entity_rows(samples: DataFrame) -> DataFrame:
    """samples(sample_id, context_id, entities array<struct<value, concept, kind>>): one row per entity with position."""
    return samples.select("sample_id", "context_id", F.posexplode_outer("entities").alias("position", "e")).select(
        "sample_id", "context_id", "position", "e.value", "e.concept", "e.kind")


def labelled_samples(entities: DataFrame) -> DataFrame:
    """Samples with a concept and a type; the stratum is the type present in the fewest samples (name on a tie)."""
    filled = entities.withColumns({c: F.nullif(c, F.lit("")) for c in ("concept", "kind")})
    valid = filled.groupBy("sample_id").agg(F.count("concept").alias("nc"), F.count("kind").alias("nk")).where("nc > 0 AND nk > 0")
    kinds = filled.join(valid, "sample_id", "left_semi").where("kind IS NOT NULL").groupBy("sample_id", "context_id", "kind").agg(
        F.count(F.lit(1)).alias("n"))
    presence = kinds.groupBy("kind").agg(F.count(F.lit(1)).alias("presence"))
    return kinds.join(presence, "kind").groupBy("sample_id", "context_id").agg(
        F.min_by("kind", F.struct("presence", "kind")).alias("stratum"), F.count(F.lit(1)).alias("n_kinds"))


def allocate_quotas(weights: DataFrame, total: int, keys: tuple = (), cap: str = "weight", one_each: bool = True) -> DataFrame:
    """weights(keys.., name, weight[, cap]): integer seats by largest remaining deficit, then weight, then name.

    Handing seats out one by one lowers a name's deficit by one each time, so at the end all names without a bound stand within one
    seat of a common level m: a name has ceil(share) - m seats, or its cap, or its forced first seat. The seats at level m are a
    piecewise linear function of m that bends where a name meets a bound. Its bends, summed by place, give the least m that needs
    no more than `total` seats; what is left goes to the highest deficits, one seat each. No seat is ever a row.
    """
    by = [*keys, "_all"]
    rows = weights.withColumns({"_cap": F.col(cap).cast("bigint"), "_all": F.lit(0)}).where("_cap > 0")
    sums = rows.groupBy(*by).agg(F.sum("weight").alias("_w"), F.count(F.lit(1)).alias("_g"), F.sum("_cap").alias("_c"))
    rows = rows.join(sums, by).withColumn("_total", F.least(F.lit(total), F.col("_c")))
    rows = rows.withColumns({"_raw": F.col("weight") / F.col("_w") * F.col("_total"), "_f": (F.lit(one_each) & (F.col("_total") >= F.col("_g"))).cast("bigint")})
    rows = rows.withColumn("_top", F.ceil("_raw").cast("bigint"))

    bends = F.array(F.struct((F.col("_top") - F.col("_cap")).alias("x"), F.lit(1).alias("d")), F.struct((F.col("_top") - F.col("_f")).alias("x"), F.lit(-1).alias("d")))
    levels = rows.select(*by, "_total", "_c", F.inline(bends)).groupBy(*by, "_total", "_c", "x").agg(F.sum("d").alias("d"))
    upto = Window.partitionBy(*by).orderBy("x")
    levels = levels.withColumns({"slope": F.sum("d").over(upto), "next": F.lead("x").over(upto)}).withColumn(
        "fall", F.coalesce(F.col("slope") * (F.col("next") - F.col("x")), F.lit(0)))
    levels = levels.withColumn("seats", F.col("_c") - F.coalesce(F.sum("fall").over(upto.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    inside = F.col("x") + F.ceil((F.col("seats") - F.col("_total")) / F.col("slope")).cast("bigint")
    level = levels.where("seats - fall <= _total").groupBy(*by).agg(F.min(F.when(F.col("seats") <= F.col("_total"), F.col("x")).otherwise(inside)).alias("_m"))

    rows = rows.join(level, by).withColumn("_n", F.greatest("_f", F.least("_cap", F.col("_top") - F.col("_m"))))
    given = rows.groupBy(*by).agg(F.sum("_n").alias("_given"))
    order = Window.partitionBy(*by).orderBy(F.desc(F.col("_n") < F.col("_cap")), F.desc(F.col("_raw") - F.col("_n")), F.desc("weight"), F.desc("name"))
    return rows.join(given, by).withColumn("_r", F.row_number().over(order)).select(
        *keys, "name", (F.col("_n") + (F.col("_r") <= F.col("_total") - F.col("_given")).cast("bigint")).alias("quota"))


def stratified_sample(samples: DataFrame, quotas: DataFrame, seed, keys: tuple = ()) -> DataFrame:
    """The first quota samples of each stratum in md5 order, without replacement."""
    placed = hashed_order(samples, "sample_id", seed, [*keys, "stratum"])
    return placed.join(quotas.withColumnRenamed("name", "stratum"), [*keys, "stratum"]).where(F.col("place") <= F.col("quota")).drop(
        "place", "running", "quota")


def proportions(rows: DataFrame, keys: list[str], name: str) -> DataFrame:
    counts = rows.groupBy(*keys, name).agg(F.count(F.lit(1)).alias("n"))
    return counts.withColumn("p", F.col("n") / F.sum("n").over(Window.partitionBy(*keys)))


def share_distance(left: DataFrame, right: DataFrame, name: str) -> DataFrame:
    a, b = left.select(name, F.col("p").alias("a")), right.select(name, F.col("p").alias("b"))
    gap = F.abs(F.coalesce("a", F.lit(0.0)) - F.coalesce("b", F.lit(0.0)))
    return a.join(b, name, "full").agg(F.sum(gap).alias("l1"))


def _line(seed: int, attempts: int, attempt: Column, h: Column) -> Column:
    """Place of a key with number h in an attempt: a * h + b modulo PRIME, with a and b from the md5 of seed and attempt."""
    def numbers(part: str, low: int) -> Column:
        drawn = (low + int(hashlib.md5(f"{seed}-{i}-{part}".encode()).hexdigest()[:8], 16) % (PRIME - low) for i in range(attempts))
        return F.split(F.lit(",".join(map(str, drawn))), ",").cast("array<bigint>")

    return (F.get(numbers("a", 1), attempt) * h + F.get(numbers("b", 0), attempt)) % PRIME


def _numbered(rows: DataFrame, key: str) -> DataFrame:
    """Each key hashed once, before its row meets the attempts. The rows are narrow and become many each: they are spread over all
    tasks by number, since small inputs would else be coalesced to one."""
    return rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), key).withColumn("_h", md5_int(F.col(key).cast("string")) % PRIME)


def attempt_counts(rows: DataFrame, seed: int, attempts: int, key: str = "sample_id", group: str = "stratum") -> DataFrame:
    """rows(key, group[, open]) -> ([attempt,] group, _n): rows that an attempt may draw from a group. Rows without bits are open to
    all attempts; equal bits of a group are counted before they meet the attempts."""
    if "open" not in rows.columns:
        return rows.groupBy(group).agg(F.count(F.lit(1)).alias("_n"))
    alike = rows.groupBy(group, "open").agg(F.count(F.lit(1)).alias("_n")).withColumn("attempt", F.explode(F.sequence(F.lit(0), F.lit(attempts - 1))))
    return alike.where(_open()).groupBy("attempt", group).agg(F.sum("_n").alias("_n"))


def _open() -> Column:
    return F.getbit(F.get("open", F.expr("cast(attempt div 64 as int)")), F.expr("attempt % 64")) == 1


def attempt_draws(rows: DataFrame, counts: DataFrame, quotas: DataFrame, seed: int, attempts: int, key: str = "sample_id", group: str = "stratum") -> DataFrame:
    """The first quota rows of each group in the order of each attempt: (attempt, key, group), quotas([attempt,] group, quota).

    Places are even, so the counts say below which place a quota and some more lie; a row leaves only the attempts where its place
    is below. Where fewer rows than the quota are found, that group of that attempt is read in full. Equal places go to the smaller key.
    """
    by = ["attempt", group]
    ends = counts.join(quotas, [c for c in by if c in counts.columns and c in quotas.columns]).where("quota > 0")
    if "attempt" not in ends.columns:
        ends = ends.withColumn("attempt", F.explode(F.sequence(F.lit(0), F.lit(attempts - 1))))
    ends = checkpointed(ends.select(*by, F.least("quota", "_n").alias("_take"), F.least(
        F.lit(PRIME), F.ceil(PRIME / F.col("_n") * (F.col("quota") + 8 * F.sqrt("quota") + 16))).cast("bigint").alias("_limit")))
    numbered = _numbered(rows, key)

    def below(ends: DataFrame) -> DataFrame:
        # one entry per attempt, so groups x attempts entries in all
        held = F.broadcast(ends.groupBy(group).agg(F.collect_list(F.struct("attempt", "_take", "_limit")).alias("_ends")))
        own = [c for c in (key, group, "_h", "open") if c in numbered.columns]
        near = numbered.join(held, group).select(*own, F.inline("_ends"))
        near = near.withColumn("_place", _line(seed, attempts, F.col("attempt"), F.col("_h"))).where(F.col("_place") < F.col("_limit"))
        return (near.where(_open()) if "open" in own else near).select(*by, key, "_place", "_take")

    near = checkpointed(below(ends))
    found = near.groupBy(*by).agg(F.count(F.lit(1)).alias("_found"))
    short = checkpointed(ends.join(found, by, "left").where(F.coalesce("_found", F.lit(0)) < F.col("_take")).select(*ends.columns))
    if not short.isEmpty():
        near = near.join(short, by, "left_anti").unionByName(below(short.withColumn("_limit", F.lit(PRIME).cast("bigint"))))
    rank = F.row_number().over(Window.partitionBy(*by).orderBy("_place", key))
    return near.withColumn("_rank", rank).where(F.col("_rank") <= F.col("_take")).select("attempt", key, group)


def split_search(samples: DataFrame, labels: DataFrame, seed: int, attempts: int, n_train: int, n_test: int) -> DataFrame:
    """All attempts in one pass: train by quota, test from samples whose labels train covers. Returns (attempt, sample_id, stratum,
    split) of every attempt.

    samples(sample_id, stratum), labels(sample_id, label): labels are concepts and datatypes alike. Attempts are bits: a sample
    carries the attempts that train on it, a label the `or` of its samples, a sample is open to the `and` of its labels less its
    own. So coverage costs two joins of the labels for any number of attempts. A sample without labels is covered.
    """
    samples, labels = checkpointed(samples), checkpointed(labels)
    sizes = samples.groupBy("stratum").agg(F.count(F.lit(1)).alias("weight"))
    quotas = allocate_quotas(sizes.withColumnRenamed("stratum", "name"), n_train).withColumnRenamed("name", "stratum")
    # the picked training samples feed three later steps, so they are written once
    train = checkpointed(attempt_draws(samples, attempt_counts(samples, seed, attempts), quotas, seed, attempts))
    words = range(-(-attempts // 64))

    def merged(how, missing: int) -> list[Column]:
        return [how(F.coalesce(f"b{w}", F.lit(missing).cast("bigint"))).alias(f"b{w}") for w in words]

    bit = F.expr("shiftleft(1L, cast(attempt % 64 as int))")
    picked = train.groupBy("sample_id").agg(*[F.bit_or(F.when(F.expr("attempt div 64") == w, bit).otherwise(F.lit(0).cast("bigint"))).alias(f"b{w}") for w in words])
    covered = labels.join(picked, "sample_id").groupBy("label").agg(*merged(F.bit_or, 0))
    shared = labels.join(covered, "label", "left").groupBy("sample_id").agg(*merged(F.bit_and, 0))
    own = picked.select("sample_id", *[F.col(f"b{w}").alias(f"t{w}") for w in words])
    free = [F.coalesce(f"b{w}", F.lit(-1).cast("bigint")).bitwiseAND(F.bitwise_not(F.coalesce(f"t{w}", F.lit(0).cast("bigint")))) for w in words]
    eligible = checkpointed(samples.join(shared, "sample_id", "left").join(own, "sample_id", "left").select("sample_id", "stratum", F.array(*free).alias("open")))

    counts = checkpointed(attempt_counts(eligible, seed + 1_000_000, attempts))
    room = counts.withColumnRenamed("_n", "room").join(sizes, "stratum").withColumnRenamed("stratum", "name")
    test_quotas = allocate_quotas(room, n_test, ("attempt",), "room").withColumnRenamed("name", "stratum")
    test = attempt_draws(eligible, counts, test_quotas, seed + 1_000_000, attempts)
    # scores and reports read the drawn rows several times
    return checkpointed(train.withColumn("split", F.lit("train")).unionByName(test.withColumn("split", F.lit("test"))))


def split_scores(splits: DataFrame, kinds: DataFrame, n_train: int, n_test: int) -> DataFrame:
    """Score of each attempt, low is good: both size penalties and the largest share differences between train and test of the
    strata, of the samples a datatype occurs in and of the entities of a datatype. kinds(sample_id, kind, n)."""
    strata = splits.groupBy("attempt", "split", F.col("stratum").alias("name")).agg(F.count(F.lit(1)).alias("w")).withColumn("measure", F.lit("stratum"))
    by_kind = splits.join(kinds.select("sample_id", "kind", "n"), "sample_id").groupBy("attempt", "split", F.col("kind").alias("name")).agg(
        F.count(F.lit(1)).alias("presence"), F.sum("n").alias("entity"))
    by_kind = by_kind.select("attempt", "split", "name", F.inline(F.array(*[F.struct(F.lit(m).alias("measure"), F.col(m).alias("w")) for m in ("presence", "entity")])))
    sides = strata.unionByName(by_kind).groupBy("attempt", "measure", "name").agg(
        *[F.sum(F.when(F.col("split") == s, F.col("w")).otherwise(0)).alias(s) for s in ("train", "test")])
    whole = Window.partitionBy("attempt", "measure")
    train, test = (F.coalesce(F.try_divide(F.col(s).cast("double"), F.sum(s).over(whole)), F.lit(0.0)) for s in ("train", "test"))
    gaps = sides.select("attempt", "measure", F.abs(train - test).alias("gap")).groupBy("attempt").agg(
        *[F.max(F.when(F.col("measure") == m, F.col("gap"))).alias(c) for m, c in (("stratum", "max_diff"), ("presence", "presence_diff"), ("entity", "entity_diff"))])
    sizes = splits.groupBy("attempt").agg(
        F.count_if(F.col("split") == "train").alias("n_train"), F.count_if(F.col("split") == "test").alias("n_test"))
    penalties = 10.0 * F.abs(F.col("n_test") - n_test) / max(n_test, 1) + 5.0 * F.abs(F.col("n_train") - n_train) / max(n_train, 1)
    score = penalties + 4.0 * F.col("max_diff") + 2.0 * F.coalesce("presence_diff", F.lit(0.0)) + F.coalesce("entity_diff", F.lit(0.0))
    return sizes.join(gaps, "attempt").withColumn("score", score)


def best_attempt(scores: DataFrame) -> DataFrame:
    return scores.agg(F.min_by("attempt", F.struct(F.round("score", 10), "attempt")).alias("attempt"), F.min("score").alias("score"))


def split_report(splits: DataFrame, scores: DataFrame, contexts: DataFrame, labels: DataFrame, allowed: float = 0.05) -> DataFrame:
    """One row: the best attempt with its overlaps, labels of test that train lacks, and whether it is valid.

    contexts(sample_id, context_id), labels(sample_id, family, label) with the families concept and datatype.
    """
    best = scores.join(best_attempt(scores).select("attempt"), "attempt")
    chosen = splits.join(best.select("attempt"), "attempt").select("split", "sample_id")
    ids = chosen.select("split", F.lit("sample").alias("family"), F.col("sample_id").cast("string").alias("label"))
    owners = chosen.join(contexts, "sample_id").select("split", F.lit("context").alias("family"), F.col("context_id").cast("string").alias("label"))
    held = chosen.join(labels, "sample_id").select("split", "family", F.col("label").cast("string").alias("label"))
    sides = ids.unionByName(owners).unionByName(held).groupBy("family", "label").agg(
        F.bool_or(F.col("split") == "train").alias("train"), F.bool_or(F.col("split") == "test").alias("test"))

    def both(family: str, wanted: Column) -> Column:
        return F.count_if((F.col("family") == family) & F.col("test") & wanted)

    found = sides.agg(both("sample", F.col("train")).alias("sample_overlap"), both("context", F.col("train")).alias("context_overlap"),
                      both("concept", ~F.col("train")).alias("missing_concepts"), both("datatype", ~F.col("train")).alias("missing_datatypes"))
    faults = F.col("sample_overlap") + F.col("context_overlap") + F.col("missing_concepts") + F.col("missing_datatypes")
    # two one-row frames side by side
    return best.join(found).withColumn("passed", (faults == 0) & (F.round("max_diff", 10) <= allowed))


def count_with_share(rows: DataFrame, lead: list[str], name: str) -> DataFrame:
    counts = rows.groupBy(*lead, name).agg(F.count(F.lit(1)).alias("n"))
    return counts.withColumn("pct", F.col("n") / F.sum("n").over(Window.partitionBy(*lead)))


def presence_counts(entities: DataFrame, label: str) -> DataFrame:
    """Distinct samples per (split, label); a null label is a group of its own."""
    return entities.select("split", "sample_id", label).distinct().groupBy("split", label).agg(F.count(F.lit(1)).alias("n_samples"))


def group_facts(contexts: DataFrame) -> DataFrame:
    """contexts(context_id, entities, meta arrays of equal length): zipped, looked up by index, grouped by identical input."""
    same = F.assert_true(F.size("entities") == F.size("meta"), F.lit("entities and metadata differ in length"))
    rows = contexts.select("context_id", F.posexplode(F.arrays_zip("entities", "meta")).alias("position", "z"), same.alias("_ok"))
    rows = rows.where("_ok IS NULL").select("context_id", "position", "z.entities.*", F.col("z.meta.status").alias("status"))
    keys = [c for c in ("value", "kind") if c in rows.columns]
    return rows.groupBy("context_id", *keys).agg(
        F.array_distinct(F.transform(F.array_sort(F.collect_list(F.struct("position", "concept"))), lambda p: p["concept"])).alias("concepts"),
        F.min("position").alias("position"), F.count(F.lit(1)).alias("n_entities"))


def describe_sample(facts: DataFrame) -> DataFrame:
    """facts(modality, context_id, concept, n_tags): counts and facts per context, pooled and per modality."""
    per_context = facts.groupBy("modality", "context_id").agg(F.count(F.lit(1)).alias("n"))
    spread = per_context.groupingSets([[F.col("modality")], []], F.col("modality")).agg(
        F.round(F.avg("n"), 6).alias("facts_per_context_mean"), F.min("n").alias("facts_per_context_min"), F.max("n").alias("facts_per_context_max"))
    main = facts.groupingSets([[F.col("modality")], []], F.col("modality")).agg(
        F.count(F.lit(1)).alias("fact_count"), F.countDistinct("context_id").alias("context_count"),
        F.countDistinct("concept").alias("unique_concepts"), F.count_if(F.col("n_tags") > 1).alias("multi_tag_facts"))
    named = [d.withColumn("modality", F.coalesce("modality", F.lit("pooled"))) for d in (main, spread)]
    return named[0].join(named[1], "modality")


def sample_quality(sample: DataFrame, whole: DataFrame) -> DataFrame:
    """Deltas of a sample against all facts with the fixed soft limits; one row.

    Both come from `facts(modality, datatype, context_id, concept)`.
    """
    def stats(df: DataFrame, tag: str) -> DataFrame:
        return df.agg(F.avg((F.col("modality") == "table").cast("double")).alias(f"{tag}_table"),
                      (F.countDistinct("concept") / F.greatest(F.countDistinct("context_id"), F.lit(1))).alias(f"{tag}_unique"),
                      *[F.try_divide(F.count_if(F.col("modality") == m), F.countDistinct(F.when(F.col("modality") == m, F.col("context_id")))).alias(
                          f"{tag}_{m}_fpc") for m in ("table", "text")])

    l1 = share_distance(proportions(sample, [], "datatype"), proportions(whole, [], "datatype"), "datatype")
    # three one-row frames side by side
    row = stats(sample, "s").join(stats(whole, "w")).join(l1)
    rel = [F.abs(F.coalesce(f"s_{m}_fpc", F.lit(0.0)) - F.col(f"w_{m}_fpc")) / F.col(f"w_{m}_fpc") for m in ("table", "text")]
    row = row.select(
        F.abs(F.col("s_table") - F.col("w_table")).alias("table_delta"), F.col("l1").alias("datatype_l1"),
        F.greatest(*rel).alias("fpc_delta"), (F.abs(F.col("s_unique") - F.col("w_unique")) / F.col("w_unique")).alias("unique_delta"))
    return row.withColumns({"flags": F.array_join(soft_flags(), ","), "passed": F.size(soft_flags()) == 0})


def soft_flags() -> Column:
    """Names of the soft limits that the deltas of a sample exceed."""
    # fixed values: the published limits and their names
    limits = (("table_delta", 0.08, "table_fact_ratio_delta_gt_0.08"), ("datatype_l1", 0.15, "datatype_l1_delta_gt_0.15"),
              ("fpc_delta", 0.35, "by_modality_facts_per_context_relative_delta_gt_0.35"),
              ("unique_delta", 0.60, "unique_concepts_per_context_relative_delta_gt_0.60"))
    return F.array_compact(F.array(*[F.when(F.round(c, 10) > limit, name) for c, limit, name in limits]))


def cluster_search(facts: DataFrame, seed: int, attempts: int, n_table: int, n_text: int, target: int = 0, target_weight: float = 0.0) -> DataFrame:
    """Each attempt draws contexts per modality; four weighted deltas against all facts, and the distance from a target number of
    facts, are its score. facts(modality, context_id, datatype, concept); one row, the chosen attempt.

    The first attempt that improves on all before it and exceeds no soft limit ends the search, else the least score wins, the
    lower number on a tie. The facts meet only the contexts drawn, so the work after the draw grows with attempts x contexts drawn.
    """
    facts = checkpointed(facts.select("modality", "context_id", "datatype", "concept").withColumn("cluster", F.concat_ws(":", "modality", F.col("context_id").cast("string"))))
    clusters = facts.select("cluster", "modality").distinct()
    quotas = facts.select("modality").distinct().withColumn("quota", F.when(F.col("modality") == "table", n_table).otherwise(n_text))
    clusters = checkpointed(clusters)
    drawn = attempt_draws(clusters, attempt_counts(clusters, seed, attempts, "cluster", "modality"), quotas, seed, attempts, "cluster", "modality")
    rows = checkpointed(drawn.drop("modality").join(facts, "cluster"))

    def stats(df: DataFrame, keys: list[str]) -> DataFrame:
        one = lambda m: F.col("modality") == m
        return df.groupBy(*keys).agg(
            F.count(F.lit(1)).alias("facts"), F.avg(one("table").cast("double")).alias("share"), (F.countDistinct("concept") / F.countDistinct("context_id")).alias("unique"),
            *[F.coalesce(F.try_divide(F.count_if(one(m)), F.countDistinct(F.when(one(m), F.col("context_id")))), F.lit(0.0)).alias(m) for m in ("table", "text")])

    def relative(c: str) -> Column:
        return F.coalesce(F.try_divide(F.abs(F.col(c) - F.col(f"w_{c}")), F.col(f"w_{c}")), F.lit(0.0))

    # every datatype drawn occurs in all facts: those not drawn add their own share, which is one less the shares of the drawn
    p, q = proportions(rows, ["attempt"], "datatype"), proportions(facts, [], "datatype").select("datatype", F.col("p").alias("q"))
    l1 = p.join(q, p["datatype"].eqNullSafe(q["datatype"])).groupBy("attempt").agg((1 + F.sum(F.abs(F.col("p") - F.col("q")) - F.col("q"))).alias("datatype_l1"))
    whole = stats(facts, []).select(*[F.col(c).alias(f"w_{c}") for c in ("share", "unique", "table", "text")])
    # one-row frame: the figures of all facts
    scored = stats(rows, ["attempt"]).join(l1, "attempt").join(whole).select(
        "attempt", "facts", F.abs(F.col("share") - F.col("w_share")).alias("table_delta"), "datatype_l1",
        F.greatest(relative("table"), relative("text")).alias("fpc_delta"), relative("unique").alias("unique_delta"))
    score = F.col("table_delta") + 0.5 * F.col("datatype_l1") + 0.2 * F.col("fpc_delta") + 0.2 * F.col("unique_delta")
    if target:
        score = score + target_weight * F.abs(F.col("facts") - target) / target
    scored = scored.withColumns({"score": F.round(score, 10), "passed": F.size(soft_flags()) == 0})
    # one row per attempt
    before = F.min("score").over(Window.orderBy("attempt").rowsBetween(Window.unboundedPreceding, -1))
    ends = F.col("passed") & F.coalesce(F.col("score") < before, F.lit(True))
    order = F.struct((~F.col("ends")).alias("later"), F.when(F.col("ends"), F.col("attempt")).otherwise(F.lit(0)).alias("at"), "score", "attempt")
    row = F.struct("attempt", "facts", "table_delta", "datatype_l1", "fpc_delta", "unique_delta", "score", "passed")
    return scored.withColumn("ends", ends).agg(F.min_by(row, order).alias("r")).where("r IS NOT NULL").select("r.*")


def fill_to_target(documents: DataFrame, seed: int, target: int) -> DataFrame:
    """documents(sample_id, n): whole documents in md5 order until their facts reach the target."""
    placed = hashed_order(documents, "sample_id", seed, [], "n")
    return placed.where(F.col("running") - F.col("n") < target).drop("running")


def dedupe_annotations(rows: DataFrame, codes: DataFrame, label: str) -> DataFrame:
    """Annotations of one label with a known code, the first of each (document, position, code)."""
    kept = rows.where(F.col("label") == label).join(codes, "code", "left_semi")
    return kept.groupBy("doc_id", "position", "code").agg(F.min("row_id").alias("row_id"))
