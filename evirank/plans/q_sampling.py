"""Entity tables, splits, samples and bootstrap intervals."""

from pyspark.sql import functions as F

from evirank.functions.text import md5_int
from evirank.operators import bootstrap, fuse, metrics, splits
from evirank.plans import frames
from evirank.plans.q_fuse import NAMES, fused_metrics
from evirank.plans.registry import fragment, query, sql_md5
from evirank.session import checkpointed

# samples = orders, entities = their lines (value, part as concept, part type as datatype), context = customer


def samples(t):
    lines = t.lineitem.join(t.part.select("p_partkey", "p_type"), F.col("l_partkey") == F.col("p_partkey"))
    concept = F.when(F.col("l_quantity") > 2, F.concat(F.lit("c"), F.col("l_partkey") % 500))
    rows = lines.select("l_orderkey", "l_linenumber", F.struct(
        F.col("l_quantity").cast("int").cast("string").alias("value"), concept.alias("concept"),
        F.when(F.col("l_tax") < 0.08, F.col("p_type")).alias("kind")).alias("e"))
    nested = rows.groupBy(F.col("l_orderkey").alias("sample_id")).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", F.col("e.value"), F.col("e.concept"), F.col("e.kind")))),
                    lambda x: F.struct(x["value"], x["concept"], x["kind"])).alias("entities"))
    return nested.join(t.orders.select(F.col("o_orderkey").alias("sample_id"), F.col("o_custkey").alias("context_id")), "sample_id")


def entities(t):
    return splits.entity_rows(samples(t))


fragment("ents", """SELECT l_orderkey AS sample_id, o_custkey AS context_id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_quantity::INT::VARCHAR, concept NULLS FIRST, kind NULLS FIRST) - 1 AS position,
    l_quantity::INT::VARCHAR AS value, concept, kind FROM (SELECT *, CASE WHEN l_quantity > 2 THEN 'c' || l_partkey % 500 END AS concept, CASE WHEN l_tax < 0.08 THEN p_type END AS kind
      FROM lineitem JOIN part ON l_partkey = p_partkey) JOIN orders ON l_orderkey = o_orderkey""")
fragment("kinds", """SELECT sample_id, context_id, kind, count(*) AS n FROM ents WHERE kind IS NOT NULL AND sample_id IN (SELECT sample_id FROM ents GROUP BY sample_id HAVING count(concept) > 0 AND count(kind) > 0) GROUP BY ALL""")
fragment("labelled", """SELECT sample_id, context_id, arg_min(kind, (presence, kind)) AS stratum, count(*) AS n_kinds FROM kinds JOIN (SELECT kind, count(*) AS presence FROM kinds GROUP BY kind) USING (kind) GROUP BY ALL""")


@query("B1_entity_rows", "SELECT sample_id, context_id, position, value, concept, kind FROM ents")
def b1(t):
    return entities(t)


@query("B2_rarest_type_stratum", "SELECT sample_id, context_id, stratum, n_kinds FROM labelled")
def b2(t):
    return splits.labelled_samples(entities(t))


fragment("strata", "SELECT stratum AS name, count(*) AS weight FROM labelled GROUP BY stratum")
SEATS = """SELECT {k} name, count(*) AS quota FROM (SELECT {k} name, row_number() OVER ({p} ORDER BY (total >= g AND seat = 1)::INT DESC, raw - (seat - 1) DESC, weight DESC, name DESC, seat) AS r, total FROM (
    SELECT *, unnest(range(1, least(cap, total)::BIGINT + 1)) AS seat FROM (SELECT *, weight / (sum(weight) OVER ({p})) * total AS raw FROM (
      SELECT *, count(*) OVER ({p}) AS g, least({n}, sum(cap) OVER ({p})) AS total FROM ({src}) WHERE cap > 0)))) WHERE r <= total GROUP BY ALL"""
fragment("train_quotas", SEATS.format(k="", p="", n=400, src="SELECT name, weight, weight AS cap FROM strata"))


def strata(t):
    return splits.labelled_samples(entities(t)).groupBy(F.col("stratum").alias("name")).agg(F.count(F.lit(1)).alias("weight"))


@query("B3_quota_allocation", "SELECT name, quota FROM train_quotas")
def b3(t):
    return splits.allocate_quotas(strata(t), 400)


@query("B4_stratified_sample", """SELECT sample_id, stratum FROM (SELECT sample_id, stratum, row_number() OVER (PARTITION BY stratum ORDER BY md5('7-' || sample_id), sample_id) AS r FROM labelled)
    JOIN train_quotas ON stratum = name WHERE r <= quota""")
def b4(t):
    rows = splits.labelled_samples(entities(t))
    quotas = splits.allocate_quotas(rows.groupBy(F.col("stratum").alias("name")).agg(F.count(F.lit(1)).alias("weight")), 400)
    return splits.stratified_sample(rows, quotas, 7).select("sample_id", "stratum")


ATT, PRIME = 200, splits.PRIME


def sql_lines(seed: int, attempts: int) -> str:
    """Lines a * h + b modulo PRIME of the attempts, whose order on h = md5 number of the key is the order of the draw."""
    return f"""(SELECT i AS attempt, 1 + {sql_md5(f"'{seed}-' || i || '-a'")} % {PRIME - 1} AS a, {sql_md5(f"'{seed}-' || i || '-b'")} % {PRIME} AS b FROM (SELECT unnest(range(0, {attempts})) AS i))"""


fragment("numbered", f"SELECT sample_id, stratum, {sql_md5('sample_id::VARCHAR')} % {PRIME} AS h FROM labelled")
fragment("train_tries", f"""SELECT attempt, sample_id, stratum FROM (SELECT attempt, sample_id, stratum, row_number() OVER (PARTITION BY attempt, stratum ORDER BY (a * h + b) % {PRIME}, sample_id) AS r
    FROM numbered, {sql_lines(11, ATT)}) JOIN train_quotas ON stratum = name WHERE r <= quota""")
fragment("split_labels", "SELECT DISTINCT sample_id, 'concept' AS family, concept AS label FROM ents WHERE concept IS NOT NULL UNION ALL SELECT DISTINCT sample_id, 'datatype', kind FROM ents WHERE kind IS NOT NULL")
fragment("covered_labels", "SELECT DISTINCT attempt, family, label FROM train_tries JOIN split_labels USING (sample_id)")
fragment("uncovered", f"""SELECT DISTINCT attempt, sample_id FROM (SELECT l.*, attempt FROM split_labels l SEMI JOIN labelled USING (sample_id), (SELECT unnest(range(0, {ATT})) AS attempt)) ANTI JOIN covered_labels USING (attempt, family, label)""")
fragment("eligible", f"""SELECT attempt, sample_id, stratum, h FROM (SELECT attempt, sample_id, stratum, h FROM numbered, (SELECT unnest(range(0, {ATT})) AS attempt)) ANTI JOIN train_tries USING (attempt, sample_id) ANTI JOIN uncovered USING (attempt, sample_id)""")
fragment("test_quotas", SEATS.format(k="attempt,", p="PARTITION BY attempt", n=100, src="SELECT attempt, name, weight, cap FROM (SELECT attempt, stratum AS name, count(*) AS cap FROM eligible GROUP BY ALL) JOIN strata USING (name)"))
fragment("test_tries", f"""SELECT attempt, sample_id, stratum FROM (SELECT attempt, sample_id, stratum, row_number() OVER (PARTITION BY attempt, stratum ORDER BY (a * h + b) % {PRIME}, sample_id) AS r
    FROM eligible JOIN {sql_lines(1000011, ATT)} USING (attempt)) e JOIN test_quotas q USING (attempt) WHERE e.stratum = q.name AND r <= quota""")
fragment("tries", "SELECT *, 'train' AS split FROM train_tries UNION ALL SELECT *, 'test' FROM test_tries")


def search(t):
    """The splits of all attempts, with the labelled samples, their labels and their datatypes."""
    rows = checkpointed(entities(t))
    labelled = checkpointed(splits.labelled_samples(rows))
    labels = rows.select("sample_id", F.inline(F.array(*[F.struct(F.lit(f).alias("family"), F.col(c).alias("label")) for f, c in (("concept", "concept"), ("datatype", "kind"))]))).where("label IS NOT NULL").distinct()
    kinds = rows.join(labelled, "sample_id", "left_semi").where("kind IS NOT NULL").groupBy("sample_id", "kind").agg(F.count(F.lit(1)).alias("n"))
    found = splits.split_search(labelled.select("sample_id", "stratum"), labels.select("sample_id", F.concat_ws(":", "family", "label").alias("label")), 11, ATT, 400, 100)
    return found, labelled, labels, kinds


@query("B5_split_search", "SELECT attempt, sample_id, stratum, split FROM tries")
def b5(t):
    return search(t)[0]


fragment("try_scores", """WITH m AS (SELECT attempt, split, 's' AS measure, stratum AS name, count(*) AS w FROM tries GROUP BY ALL UNION ALL SELECT attempt, split, 'p', kind, count(*) FROM tries JOIN kinds USING (sample_id) GROUP BY ALL
      UNION ALL SELECT attempt, split, 'e', kind, sum(n) FROM tries JOIN kinds USING (sample_id) GROUP BY ALL),
    p AS (SELECT *, w / (sum(w) OVER (PARTITION BY attempt, split, measure)) AS p FROM m),
    d AS (SELECT attempt, measure, max(abs(coalesce(a.p, 0) - coalesce(b.p, 0))) AS d FROM (SELECT * FROM p WHERE split = 'train') a FULL JOIN (SELECT * FROM p WHERE split = 'test') b USING (attempt, measure, name) GROUP BY attempt, measure),
    g AS (SELECT attempt, max(d) FILTER (measure = 's') AS max_diff, max(d) FILTER (measure = 'p') AS presence_diff, max(d) FILTER (measure = 'e') AS entity_diff FROM d GROUP BY attempt)
    SELECT attempt, n_train, n_test, max_diff, presence_diff, entity_diff, 10 * abs(n_test - 100) / 100.0::DOUBLE + 5 * abs(n_train - 400) / 400.0::DOUBLE + 4 * max_diff + 2 * presence_diff + entity_diff AS score FROM g JOIN (
      SELECT attempt, count(*) FILTER (split = 'train') AS n_train, count(*) FILTER (split = 'test') AS n_test FROM tries GROUP BY attempt) USING (attempt)""")


@query("B5_best_attempt", "SELECT arg_min(attempt, (round(score, 10), attempt)) AS attempt, round(min(score), 8) AS score FROM try_scores")
def b5b(t):
    found, _, _, kinds = search(t)
    return splits.best_attempt(splits.split_scores(found, kinds, 400, 100)).withColumn("score", F.round("score", 8))


@query("B5_split_report", """WITH best AS (SELECT * FROM try_scores ORDER BY round(score, 10), attempt LIMIT 1), c AS (SELECT split, sample_id, context_id FROM tries SEMI JOIN best USING (attempt) JOIN labelled USING (sample_id)),
    l AS (SELECT split, family, label FROM c JOIN split_labels USING (sample_id)),
    f AS (SELECT (SELECT count(*) FROM (SELECT sample_id FROM c WHERE split = 'train' INTERSECT SELECT sample_id FROM c WHERE split = 'test')) AS sample_overlap, (SELECT count(*) FROM (SELECT context_id FROM c WHERE split = 'train' INTERSECT SELECT context_id FROM c WHERE split = 'test')) AS context_overlap,
      (SELECT count(*) FROM (SELECT label FROM l WHERE split = 'test' AND family = 'concept' EXCEPT SELECT label FROM l WHERE split = 'train' AND family = 'concept')) AS missing_concepts, (SELECT count(*) FROM (SELECT label FROM l WHERE split = 'test' AND family = 'datatype' EXCEPT SELECT label FROM l WHERE split = 'train' AND family = 'datatype')) AS missing_datatypes)
    SELECT attempt, n_train, n_test, round(score, 8) AS score, round(max_diff, 8) AS max_diff, sample_overlap, context_overlap, missing_concepts, missing_datatypes,
      sample_overlap + context_overlap + missing_concepts + missing_datatypes = 0 AND round(max_diff, 10) <= 0.05 AS passed FROM best, f""")
def b5c(t):
    found, labelled, labels, kinds = search(t)
    report = splits.split_report(found, splits.split_scores(found, kinds, 400, 100), labelled, labels)
    return report.drop("presence_diff", "entity_diff").withColumns({c: F.round(c, 8) for c in ("score", "max_diff")})


@query("B6_share_difference", "SELECT attempt, n_train, n_test, round(max_diff, 8) AS max_diff, round(presence_diff, 8) AS presence_diff, round(entity_diff, 8) AS entity_diff, round(score, 8) AS score FROM try_scores")
def b6(t):
    found, _, _, kinds = search(t)
    return splits.split_scores(found, kinds, 400, 100).withColumns({c: F.round(c, 8) for c in ("max_diff", "presence_diff", "entity_diff", "score")})


@query("B7_count_with_share", "SELECT o_orderstatus, o_orderpriority, count(*) AS n, count(*) / sum(count(*)) OVER (PARTITION BY o_orderstatus) AS pct FROM orders GROUP BY o_orderstatus, o_orderpriority")
def b7(t):
    return splits.count_with_share(t.orders, ["o_orderstatus"], "o_orderpriority")


@query("B8_presence_counts", "SELECT CASE WHEN sample_id % 5 = 0 THEN 'test' ELSE 'train' END AS split, kind, count(DISTINCT sample_id) AS n_samples FROM ents GROUP BY ALL")
def b8(t):
    rows = entities(t).withColumn("split", F.when(F.col("sample_id") % 5 == 0, "test").otherwise("train"))
    return splits.presence_counts(rows, "kind")


@query("B9_facts_from_arrays", """SELECT context_id, value, kind, coalesce(array_to_string(list_distinct_ordered, ','), '') AS concepts, position, n_entities FROM (SELECT sample_id AS context_id, value, kind,
      list_filter(list(concept ORDER BY position), lambda x: true) AS l, (SELECT list(c ORDER BY p) FROM (SELECT concept AS c, min(position) AS p FROM ents e2 WHERE e2.sample_id = ents.sample_id AND e2.value = ents.value AND e2.kind IS NOT DISTINCT FROM ents.kind AND concept IS NOT NULL GROUP BY concept)) AS list_distinct_ordered,
      min(position) AS position, count(*) AS n_entities FROM ents GROUP BY ALL)""")
def b9(t):
    nested = samples(t).select(F.col("sample_id").alias("context_id"), "entities",
                               F.transform("entities", lambda e, i: F.struct(i.alias("entity_index"), F.lit("exact").alias("status"))).alias("meta"))
    rows = splits.group_facts(nested)
    return rows.withColumn("concepts", F.array_join("concepts", ","))


def described(t):
    """Facts = lines with the context (order), its modality, concept and tag count."""
    rows = entities(t).where("concept IS NOT NULL AND kind IS NOT NULL")
    return rows.select(F.when(F.col("sample_id") % 3 == 0, "table").otherwise("text").alias("modality"), F.col("sample_id").alias("context_id"),
                       "concept", F.col("kind").alias("datatype"), (F.col("position") % 2 + 1).alias("n_tags"))


fragment("described", "SELECT CASE WHEN sample_id % 3 = 0 THEN 'table' ELSE 'text' END AS modality, sample_id AS context_id, concept, kind AS datatype, position % 2 + 1 AS n_tags FROM ents WHERE concept IS NOT NULL AND kind IS NOT NULL")


@query("B10_sample_description", """SELECT * FROM (SELECT coalesce(modality, 'pooled') AS modality, count(*) AS fact_count, count(DISTINCT context_id) AS context_count, count(DISTINCT concept) AS unique_concepts, count(*) FILTER (n_tags > 1) AS multi_tag_facts
    FROM described GROUP BY GROUPING SETS ((modality), ())) JOIN (SELECT coalesce(modality, 'pooled') AS modality, round(avg(n), 6) AS facts_per_context_mean, min(n) AS facts_per_context_min, max(n) AS facts_per_context_max
      FROM (SELECT modality, context_id, count(*) AS n FROM described GROUP BY ALL) GROUP BY GROUPING SETS ((modality), ())) USING (modality)""")
def b10(t):
    return splits.describe_sample(described(t))


STATS = """SELECT avg((modality = 'table')::INT) AS tb, count(DISTINCT concept) / greatest(count(DISTINCT context_id), 1)::DOUBLE AS un,
    count(*) FILTER (modality = 'table') / nullif(count(DISTINCT context_id) FILTER (modality = 'table'), 0)::DOUBLE AS f1, count(*) FILTER (modality = 'text') / nullif(count(DISTINCT context_id) FILTER (modality = 'text'), 0)::DOUBLE AS f2 FROM """


@query("B11_sample_quality", f"""WITH s AS (SELECT * FROM described WHERE concept < 'c3'), x AS ({STATS} s), y AS ({STATS} described),
    l AS (SELECT sum(abs(coalesce(a.p, 0) - coalesce(b.p, 0))) AS l1 FROM (SELECT datatype, count(*) / (SELECT count(*) FROM s)::DOUBLE AS p FROM s GROUP BY datatype) a FULL JOIN (SELECT datatype, count(*) / (SELECT count(*) FROM described)::DOUBLE AS p FROM described GROUP BY datatype) b USING (datatype)),
    d AS (SELECT abs(x.tb - y.tb) AS table_delta, l1 AS datatype_l1, greatest(abs(x.f1 - y.f1) / y.f1, abs(x.f2 - y.f2) / y.f2) AS fpc_delta, abs(x.un - y.un) / y.un AS unique_delta FROM x, y, l)
    SELECT round(table_delta, 6) AS table_delta, round(datatype_l1, 6) AS datatype_l1, round(fpc_delta, 6) AS fpc_delta, round(unique_delta, 6) AS unique_delta, f AS flags, f = '' AS passed FROM (SELECT *, concat_ws(',', CASE WHEN table_delta > 0.08 THEN 'table_fact_ratio_delta_gt_0.08' END,
      CASE WHEN datatype_l1 > 0.15 THEN 'datatype_l1_delta_gt_0.15' END, CASE WHEN fpc_delta > 0.35 THEN 'by_modality_facts_per_context_relative_delta_gt_0.35' END, CASE WHEN unique_delta > 0.6 THEN 'unique_concepts_per_context_relative_delta_gt_0.60' END) AS f FROM d)""")
def b11(t):
    whole = described(t)
    out = splits.sample_quality(whole.where("concept < 'c3'"), whole)
    return out.withColumns({c: F.round(c, 6) for c in ("table_delta", "datatype_l1", "fpc_delta", "unique_delta")})


DRAWS = 2000


@query("B12_cluster_search", f"""WITH c AS (SELECT DISTINCT modality, context_id, {sql_md5("modality || ':' || context_id")} % {PRIME} AS h FROM described),
    d AS (SELECT attempt, modality, unnest(CASE WHEN modality = 'table' THEN arg_min(context_id, (a * h + b) % {PRIME} * 4294967296 + context_id, 30) ELSE arg_min(context_id, (a * h + b) % {PRIME} * 4294967296 + context_id, 50) END) AS context_id FROM c, {sql_lines(5, DRAWS)} GROUP BY attempt, modality),
    r AS (SELECT attempt, f.* FROM d JOIN described f USING (modality, context_id)),
    x AS (SELECT attempt, count(*) AS facts, avg((modality = 'table')::INT) AS tb, count(DISTINCT concept) / count(DISTINCT context_id)::DOUBLE AS un, count(*) FILTER (modality = 'table') / 30.0::DOUBLE AS f1, count(*) FILTER (modality = 'text') / 50.0::DOUBLE AS f2 FROM r GROUP BY attempt),
    y AS ({STATS} described), q AS (SELECT datatype, count(*) / (SELECT count(*) FROM described)::DOUBLE AS q FROM described GROUP BY datatype),
    p AS (SELECT attempt, datatype, count(*) / (sum(count(*)) OVER (PARTITION BY attempt))::DOUBLE AS p FROM r GROUP BY attempt, datatype),
    l AS (SELECT attempt, sum(abs(coalesce(p, 0) - q)) AS datatype_l1 FROM (SELECT attempt, datatype, q FROM q, (SELECT unnest(range(0, {DRAWS})) AS attempt)) LEFT JOIN p USING (attempt, datatype) GROUP BY attempt),
    s AS (SELECT attempt, facts, abs(x.tb - y.tb) AS table_delta, datatype_l1, greatest(abs(x.f1 - y.f1) / y.f1, abs(x.f2 - y.f2) / y.f2) AS fpc_delta, abs(x.un - y.un) / y.un AS unique_delta FROM x JOIN l USING (attempt), y),
    t AS (SELECT *, round(table_delta + 0.5 * datatype_l1 + 0.2 * fpc_delta + 0.2 * unique_delta + 0.3 * abs(facts - 240) / 240.0::DOUBLE, 10) AS score, round(table_delta, 10) <= 0.08 AND round(datatype_l1, 10) <= 0.15 AND round(fpc_delta, 10) <= 0.35 AND round(unique_delta, 10) <= 0.6 AS passed FROM s),
    m AS (SELECT *, passed AND coalesce(score < min(score) OVER (ORDER BY attempt ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), true) AS ends FROM t)
    SELECT attempt, facts, round(table_delta, 8) AS table_delta, round(datatype_l1, 8) AS datatype_l1, round(fpc_delta, 8) AS fpc_delta, round(unique_delta, 8) AS unique_delta, round(score, 8) AS score, passed FROM m ORDER BY (NOT ends)::INT, CASE WHEN ends THEN attempt ELSE 0 END, score, attempt LIMIT 1""")
def b12(t):
    found = splits.cluster_search(described(t), 5, DRAWS, 30, 50, 240, 0.3)
    return found.withColumns({c: F.round(c, 8) for c in ("table_delta", "datatype_l1", "fpc_delta", "unique_delta", "score")})


@query("B13_fill_to_target", """SELECT sample_id, n, place FROM (SELECT sample_id, n, row_number() OVER w AS place, sum(n) OVER w - n AS before FROM (SELECT doc_id AS sample_id, len(string_split(text, chr(10))) AS n FROM documents)
    WINDOW w AS (ORDER BY md5('3-' || sample_id), sample_id)) WHERE before < 2000""")
def b13(t):
    docs = t.documents.select(F.col("doc_id").alias("sample_id"), F.size(F.split("text", "\n")).alias("n"))
    return splits.fill_to_target(docs, 3, 2000).select("sample_id", "n", "place")


fragment("annots", "SELECT l_orderkey * 10 + l_linenumber AS row_id, l_suppkey AS doc_id, l_linenumber || ' ' || (l_quantity::INT % 5) AS position, l_partkey % 50 AS code, l_returnflag AS label FROM lineitem")


def annotations(t):
    return t.lineitem.select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("row_id"), F.col("l_suppkey").alias("doc_id"),
                             F.concat_ws(" ", F.col("l_linenumber").cast("string"), (F.col("l_quantity").cast("int") % 5).cast("string")).alias("position"),
                             (F.col("l_partkey") % 50).alias("code"), F.col("l_returnflag").alias("label"))


@query("B14_dedupe_annotations", "SELECT doc_id, position, code, min(row_id) AS row_id FROM annots WHERE label = 'R' AND code IN (SELECT p_size FROM part WHERE p_brand = 'Brand#3') GROUP BY ALL")
def b14(t):
    known = t.part.where("p_brand = 'Brand#3'").select(F.col("p_size").cast("bigint").alias("code")).distinct()
    return splits.dedupe_annotations(annotations(t), known, "R")


@query("B15_spot_check", "SELECT o_orderkey AS row_id, c_name AS label FROM (SELECT * FROM orders ORDER BY md5('9-' || o_orderkey), o_orderkey LIMIT 50) JOIN customer ON o_custkey = c_custkey")
def b15(t):
    picked = splits.seeded_sample(t.orders.select(F.col("o_orderkey").alias("row_id"), F.col("o_custkey").alias("c_custkey")), "row_id", 9, 50)
    return picked.join(t.customer.select("c_custkey", F.col("c_name").alias("label")), "c_custkey").select("row_id", "label")


# --- bootstrap --------------------------------------------------------------------------------------------------------

DRAWS = 2000


def interval_sql(by: str, src: str, num: str = "value", den: str = "1.0::DOUBLE", seed: int = 41) -> str:
    """src has the by columns, context_id and the value columns."""
    cols = f"{by}, " if by else ""
    part = f"PARTITION BY {by}" if by else ""
    using = f"USING ({by})" if by else "ON true"
    return f"""WITH c0 AS (SELECT {cols} context_id, sum({num}) AS num, sum({den}) AS den FROM ({src}) GROUP BY ALL),
      c AS (SELECT *, row_number() OVER ({part} ORDER BY md5('ctx-' || context_id), context_id) - 1 AS number, count(*) OVER ({part}) AS n_contexts FROM c0),
      s AS (SELECT {cols} n_contexts, number AS slot, unnest(range(0, {DRAWS})) AS draw FROM c),
      k AS (SELECT {cols} draw, {sql_md5(f"draw || '-' || slot || '-{seed}'")} % n_contexts AS number FROM s),
      r AS (SELECT {cols} draw, sum(num) / nullif(sum(den), 0) AS ratio FROM k JOIN (SELECT {cols} number, num, den FROM c) USING ({cols} number) GROUP BY ALL),
      q AS (SELECT {cols} quantile_cont(ratio, 0.025) AS lo, quantile_cont(ratio, 0.975) AS hi FROM r {'GROUP BY ALL' if by else ''}),
      o AS (SELECT {cols} sum(num) / sum(den) AS mean, sum(den)::BIGINT AS n, count(*) AS n_contexts FROM c {'GROUP BY ALL' if by else ''})
      SELECT {cols} round(mean, 6) AS mean, round(lo, 6) AS ci_low, round(hi, 6) AS ci_high, n, n_contexts, round(lo, 9) > 0 OR round(hi, 9) < 0 AS excludes_zero FROM o JOIN q {using}"""


@query("B16_cluster_bootstrap", interval_sql("modality", "SELECT modality, context_id, recall_at_10 AS value FROM fused_metrics"))
def b16(t):
    return bootstrap.mean_interval(fused_metrics(t), "recall_at_10", ["modality"], DRAWS, 41)


HIT = "CASE WHEN gold_rank <= 10 THEN 1.0::DOUBLE ELSE 0 END"


def list_metrics(t):
    ranks = metrics.gold_ranks(frames.rankings(t), frames.gold(t), ["fact_id", "list_id"])
    rows = metrics.fact_metrics(frames.facts(t), ranks, [10]).where("list_id IS NOT NULL")
    return rows.withColumn("arm", F.element_at(F.array(*map(F.lit, ["def0", "lab0", "def1", "lab1"])), F.col("list_id")))


@query("B17_paired_bootstrap", interval_sql("", f"SELECT context_id, a.h - b.h AS value FROM facts JOIN (SELECT fact_id, {HIT} AS h FROM list_ranks WHERE list_id = 1) a USING (fact_id) JOIN (SELECT fact_id, {HIT} AS h FROM list_ranks WHERE list_id = 2) b USING (fact_id)"))
def b17(t):
    rows = list_metrics(t)
    return bootstrap.paired_interval(rows.where("arm = 'def0'"), rows.where("arm = 'lab0'"), "recall_at_10", [], DRAWS, 41)


@query("B18_paired_accuracy", interval_sql("", "SELECT context_id, x.a - y.a AS value FROM facts JOIN (SELECT fact_id, (coalesce(gold_rank, 0) = 1)::INT::DOUBLE AS a FROM list_ranks WHERE list_id = 1) x USING (fact_id) JOIN (SELECT fact_id, (coalesce(gold_rank, 0) = 1)::INT::DOUBLE AS a FROM list_ranks WHERE list_id = 3) y USING (fact_id)", seed=43))
def b18(t):
    rows = list_metrics(t)
    return bootstrap.paired_interval(rows.where("arm = 'def0'"), rows.where("arm = 'def1'"), "accuracy", [], DRAWS, 43)


fragment("arm_long", f"""SELECT ['def0', 'lab0', 'def1', 'lab1'][list_id] AS arm, fact_id, context_id, unnest([modality, 'pooled']) AS modality, {HIT} AS recall_at_10, coalesce(1.0::DOUBLE / gold_rank, 0) AS mrr FROM facts JOIN list_ranks USING (fact_id)""")
PAIRED = """SELECT '{a}-{b}' AS contrast, metric, modality, context_id, x.v - y.v AS value FROM (SELECT * FROM (UNPIVOT (SELECT * FROM arm_long WHERE arm = '{a}') ON recall_at_10, mrr INTO NAME metric VALUE v)) x
    JOIN (SELECT fact_id, modality, metric, v FROM (UNPIVOT (SELECT * FROM arm_long WHERE arm = '{b}') ON recall_at_10, mrr INTO NAME metric VALUE v)) y USING (fact_id, modality, metric)"""
PAIR_SQL = interval_sql("contrast, metric, modality", PAIRED.format(a="lab0", b="def0") + " UNION ALL " + PAIRED.format(a="def1", b="def0"))


def pair_table(t):
    return bootstrap.paired_table(list_metrics(t).select("arm", "fact_id", "context_id", "modality", "recall_at_10", "mrr"),
                                  [("lab0", "def0"), ("def1", "def0")], ["recall_at_10", "mrr"], DRAWS, 41)


@query("B19_paired_differences", PAIR_SQL)
def b19(t):
    return pair_table(t)


@query("B20_gate_decision", f"""SELECT contrast, metric, modality, mean, ci_low, CASE WHEN mean < 0 THEN 'halt_requires_ack' WHEN mean >= 0.03 AND ci_low > 0 THEN 'proceed_claim' ELSE 'proceed_weak' END AS decision FROM ({PAIR_SQL})""")
def b20(t):
    return bootstrap.gate(pair_table(t), 0.03).select("contrast", "metric", "modality", "mean", "ci_low", "decision")
