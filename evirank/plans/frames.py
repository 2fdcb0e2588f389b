"""Stand-ins for the engine's tables, derived from the driver tables, in Spark and as SQL fragments.

facts = customers, context = nation, candidates = parts, four ranked lists per customer from sales, gold = parts the
customer returned in bulk. The part table is also a taxonomy (name = label, type = scope).
"""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from evirank.functions.text import md5_int
from evirank.plans.registry import Tables, fragment, sql_md5
from evirank.session import by_fact, stored_by_fact

TOP_K = 200
TABLE_SEGMENTS = ["BUILDING", "AUTOMOBILE", "MACHINERY"]


def facts(t: Tables) -> DataFrame:
    return t.customer.select(
        F.col("c_custkey").alias("fact_id"), F.col("c_nationkey").cast("bigint").alias("context_id"),
        F.when(F.col("c_mktsegment").isin(TABLE_SEGMENTS), "table").otherwise("text").alias("modality"),
        F.col("c_mktsegment").alias("datatype"))


fragment("facts", """SELECT c_custkey AS fact_id, c_nationkey::BIGINT AS context_id, CASE WHEN c_mktsegment IN
    ('BUILDING', 'AUTOMOBILE', 'MACHINERY') THEN 'table' ELSE 'text' END AS modality, c_mktsegment AS datatype FROM customer""")


def sold(t: Tables) -> DataFrame:
    return t.lineitem.join(t.orders.select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey")).select(
        F.col("o_custkey").alias("fact_id"), F.col("l_partkey").cast("string").alias("tag"),
        "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag")


fragment("sold", """SELECT o_custkey AS fact_id, l_partkey::VARCHAR AS tag, l_quantity, l_extendedprice, l_discount, l_tax,
    l_returnflag FROM lineitem JOIN orders ON l_orderkey = o_orderkey""")


def rankings(t: Tables, top_k: int = TOP_K) -> DataFrame:
    """Lists 1-4 = (hypothesis 0, def), (0, lab), (1, def), (1, lab).

    Sales move once, to their fact: sums, lists, fusion and windows over a fact all run where its rows are then.
    """
    sums = by_fact(sold(t)).groupBy("fact_id", "tag").agg(
        F.sum("l_extendedprice").alias("s1"),
        F.sum(F.when(F.col("l_returnflag") != "N", F.col("l_quantity"))).alias("s2"),
        F.sum(F.when(F.col("l_discount") >= 0.05, F.col("l_discount"))).alias("s3"),
        F.sum(F.when(F.col("l_tax") >= 0.04, F.col("l_tax"))).alias("s4"))
    cell = [F.struct(F.lit(i + 1).alias("list_id"), F.lit(i // 2).alias("hyp_idx"),
                     F.lit("lab" if i % 2 else "def").alias("rendering"), F.round(f"s{i + 1}", 6).alias("score"))
            for i in range(4)]
    long = sums.select("fact_id", "tag", F.inline(F.array(*cell))).where(F.col("score").isNotNull())
    window = Window.partitionBy("fact_id", "list_id").orderBy(F.desc("score"), F.asc("tag"))
    return long.withColumn("rank", F.row_number().over(window)).where(F.col("rank") <= top_k)


def stored_rankings(t: Tables, columns: list[str]) -> DataFrame:
    """`rankings` with these columns of rank and score, written once: a candidate is one row there, and its lists are written out when read."""
    lists = rankings(t)
    cells = [F.max(F.when(F.col("list_id") == i + 1, F.col(c))).alias(f"{c}_{i}") for c in columns for i in range(4)]
    wide = stored_by_fact(lists.groupBy("fact_id", "tag").agg(*cells))
    rows = [F.when(F.col(f"{columns[0]}_{i}").isNotNull(), F.struct(
        F.lit(i + 1).alias("list_id"), F.lit(i // 2).alias("hyp_idx"), F.lit("lab" if i % 2 else "def").alias("rendering"),
        *[F.col(f"{c}_{i}").alias(c) for c in columns])) for i in range(4)]
    return wide.select("fact_id", "tag", F.inline(F.array_compact(F.array(*rows))))


fragment("rankings", """SELECT fact_id, list_id, ((list_id - 1) // 2)::BIGINT AS hyp_idx,
    CASE WHEN list_id % 2 = 1 THEN 'def' ELSE 'lab' END AS rendering, tag, score, rank FROM (
    SELECT *, row_number() OVER (PARTITION BY fact_id, list_id ORDER BY score DESC, tag) AS rank FROM (
      SELECT fact_id, tag, 1::BIGINT AS list_id, round(sum(l_extendedprice), 6) AS score FROM sold GROUP BY ALL
      UNION ALL SELECT fact_id, tag, 2, round(sum(l_quantity), 6) FROM sold WHERE l_returnflag <> 'N' GROUP BY ALL
      UNION ALL SELECT fact_id, tag, 3, round(sum(l_discount), 6) FROM sold WHERE l_discount >= 0.05 GROUP BY ALL
      UNION ALL SELECT fact_id, tag, 4, round(sum(l_tax), 6) FROM sold WHERE l_tax >= 0.04 GROUP BY ALL)) WHERE rank <= 200""")


def gold(t: Tables) -> DataFrame:
    return sold(t).where((F.col("l_returnflag") == "R") & (F.col("l_quantity") >= 40)).select("fact_id", "tag").distinct()


fragment("gold", "SELECT DISTINCT fact_id, tag FROM sold WHERE l_returnflag = 'R' AND l_quantity >= 40")


# Taxonomy of parts.

def concepts(t: Tables) -> DataFrame:
    size = F.concat(F.lit("size "), F.col("p_size").cast("string"))
    return t.part.select(
        F.col("p_partkey").alias("doc_idx"), F.col("p_partkey").cast("string").alias("tag"),
        F.col("p_type").alias("entity_type"), F.col("p_name").alias("standard_label"),
        F.col("p_brand").alias("documentation"),
        F.concat_ws(". ", "p_name", "p_brand", size).alias("retrieval_text"))


fragment("concepts", """SELECT p_partkey AS doc_idx, p_partkey::VARCHAR AS tag, p_type AS entity_type, p_name AS standard_label,
    p_brand AS documentation, p_name || '. ' || p_brand || '. size ' || p_size AS retrieval_text FROM part""")


def document_concepts(t: Tables) -> DataFrame:
    return t.documents.select(
        F.col("doc_id").alias("doc_idx"), F.col("doc_id").cast("string").alias("tag"), F.col("lang").alias("entity_type"),
        F.substring_index("text", "\n", 1).alias("standard_label"), F.col("text").alias("retrieval_text"))


LANGS = ["en", "fr", "de", "other"]


def benchmark_queries(t: Tables) -> DataFrame:
    lang = F.element_at(F.array(*map(F.lit, LANGS)), (F.col("item_id") % 4 + 1).cast("int"))
    return t.benchmark.select(F.col("item_id").alias("query_id"), lang.alias("entity_type"), F.col("text").alias("query"))


fragment("doc_concepts", """SELECT doc_id AS doc_idx, doc_id::VARCHAR AS tag, lang AS entity_type,
    string_split(text, chr(10))[1] AS standard_label, text AS retrieval_text FROM documents""")
fragment("bench_queries", """SELECT item_id AS query_id, ['en', 'fr', 'de', 'other'][item_id % 4 + 1] AS entity_type,
    text AS query FROM benchmark""")

# Suppliers as facts with two hypotheses each, queried against the parts.
ADJECTIVES = "small hot red blue large old cold new".split()
NOUNS = "widget gear plate bolt ring rod gizmo anvil".split()
SCOPES = "STANDARD MEDIUM SMALL LARGE ECONOMY PROMO UNKNOWN".split()


def pick(options: list[str], key) -> F.Column:
    return F.element_at(F.array(*map(F.lit, options)), (md5_int(key) % len(options) + 1).cast("int"))


def sql_pick(options: list[str], key: str) -> str:
    return "[" + ", ".join(f"'{o}'" for o in options) + f"][{sql_md5(key)} % {len(options)} + 1]"


def supplier_hypotheses(t: Tables) -> DataFrame:
    key = F.concat_ws("-", F.col("s_suppkey").cast("string"), F.col("hyp_idx").cast("string"))

    def salted(prefix):
        return F.concat(F.lit(prefix), key)

    rows = t.supplier.select("s_suppkey", "s_name", F.explode(F.array(F.lit(0), F.lit(1))).alias("hyp_idx"))
    return rows.select(
        F.col("s_suppkey").alias("fact_id"), "hyp_idx",
        F.when(F.col("s_suppkey") % 2 == 0, "table").otherwise("text").alias("modality"),
        F.lit("").alias("entity"), pick(SCOPES, F.concat(F.lit("t"), F.col("s_suppkey").cast("string"))).alias("entity_type"),
        F.col("s_name").alias("context"),
        F.concat_ws(" ", pick(ADJECTIVES, salted("a")), pick(NOUNS, salted("n")),
                    F.concat(F.lit("size "), (md5_int(salted("s")) % 50).cast("string"))).alias("def_query"),
        F.when(md5_int(salted("e")) % 5 == 0, F.lit("")).otherwise(pick(NOUNS, salted("l"))).alias("lab_query"))


fragment("sup_hyps", f"""SELECT s_suppkey AS fact_id, hyp_idx, CASE WHEN s_suppkey % 2 = 0 THEN 'table' ELSE 'text' END AS modality,
    {sql_pick(SCOPES, "'t' || s_suppkey")} AS entity_type,
    {sql_pick(ADJECTIVES, "'a' || s_suppkey || '-' || hyp_idx")} || ' ' || {sql_pick(NOUNS, "'n' || s_suppkey || '-' || hyp_idx")}
      || ' size ' || {sql_md5("'s' || s_suppkey || '-' || hyp_idx")} % 50 AS def_query,
    CASE WHEN {sql_md5("'e' || s_suppkey || '-' || hyp_idx")} % 5 = 0 THEN '' ELSE {sql_pick(NOUNS, "'l' || s_suppkey || '-' || hyp_idx")} END AS lab_query
    FROM supplier, (SELECT unnest([0::BIGINT, 1::BIGINT]) AS hyp_idx)""")
fragment("sup_queries", """SELECT fact_id, hyp_idx, rendering, list_id, entity_type, fact_id * 10 + list_id AS query_id,
      trim(entity_type || ' ' || txt) AS query FROM (
    SELECT *, 'def' AS rendering, hyp_idx * 2 + 1 AS list_id, def_query AS txt FROM sup_hyps
    UNION ALL SELECT *, 'lab', hyp_idx * 2 + 2, lab_query FROM sup_hyps WHERE modality = 'table' AND lab_query <> '')""")
fragment("sup_gold", """SELECT DISTINCT l_suppkey AS fact_id, l_partkey::VARCHAR AS tag FROM lineitem
    WHERE l_discount >= 0.09 AND l_quantity >= 45""")


def supplier_gold(t: Tables) -> DataFrame:
    big = t.lineitem.where((F.col("l_discount") >= 0.09) & (F.col("l_quantity") >= 45))
    return big.select(F.col("l_suppkey").alias("fact_id"), F.col("l_partkey").cast("string").alias("tag")).distinct()


# Two hypotheses per customer over a small vocabulary of part words; roles and events are matched by tokens only.
PART_VOCABULARY = {
    "family": {"fastener": ["bolt", "rod", "ring"], "device": ["gizmo", "widget"], "machine": ["gear", "plate", "anvil"]},
    "qualifier": {"hue": ["red", "blue"], "thermal": ["hot", "cold"], "age": ["old", "new"]},
    "scope": {"little": ["small", "economy"], "big": ["large", "promo"], "odd": ["brand 7"]},
    "temporal": {}, "aggregation": {}, "role": {}, "event": {},
}
VALUES = {
    "FAMILY": ["bolt", "gizmo widgets", "large gear", "UNRESOLVED", "tool"],
    "ROLE": ["red ring", "blue brand 7", "none", "size 12", "cold gear size"],
    "EVENT": ["UNRESOLVED", "old anvil", "brand 3", "not specified"],
    "QUALIFIER": ["hot", "blue", "cold plate", "unknown", "shiny"],
    "SCOPE": ["small", "promo", "", "huge"],
    "TEMPORAL": ["n/a", "size 7", "new"],
}
UNRESOLVED_SQL = "('', 'na', 'n/a', 'none', 'null', 'unknown', 'unsupported', 'unresolved', 'not specified', 'not applicable')"


def part_domain():
    from evirank.domain import DomainConfig

    return DomainConfig(tag_prefix="", vocabulary=PART_VOCABULARY)


def hypotheses(t: Tables) -> DataFrame:
    # ids are dealt before anything is stated or normalised: a table in one split would leave that to one task
    rows = by_fact(t.customer.select(F.col("c_custkey").alias("fact_id"))).select("fact_id", F.explode(F.array(F.lit(0), F.lit(1))).alias("hyp_idx"))
    key = F.concat_ws("-", F.col("fact_id").cast("string"), F.col("hyp_idx").cast("string"))
    cells = [x for d, options in VALUES.items() for x in (F.lit(d), pick(options, F.concat(F.lit(d), key)))]
    return rows.withColumn("dimensions", F.create_map(*cells))


fragment("hyp_long", "SELECT fact_id, hyp_idx, lower(dim) AS dim, value FROM (" + " UNION ALL ".join(
    f"SELECT c_custkey AS fact_id, hyp_idx, '{d}' AS dim, "
    + sql_pick(options, f"'{d}' || c_custkey || '-' || hyp_idx") + " AS value FROM customer, (SELECT unnest([0::BIGINT, 1::BIGINT]) AS hyp_idx)"
    for d, options in VALUES.items()) + f") WHERE lower(value) NOT IN {UNRESOLVED_SQL}")
fragment("vocab", "SELECT dim, category, phrase, " + "string_split(phrase, ' ') AS ptoks FROM (VALUES " + ", ".join(
    f"('{d}', '{c}', '{p}')" for d, cats in PART_VOCABULARY.items() for c, words in cats.items() for p in words)
    + ") v(dim, category, phrase)")
CONCEPT_TEXT = ["tag", "standard_label", "documentation", "retrieval_text", "entity_type"]


def _toks(x: str) -> str:
    from evirank.plans.registry import sql_tokens

    return f"list_distinct({sql_tokens(x)})"


fragment("concept_tok", f"""SELECT tag, lower(txt) AS low, {_toks('txt')} AS ctoks FROM (
    SELECT tag, tag || ' ' || standard_label || ' ' || documentation || ' ' || retrieval_text || ' ' || entity_type AS txt FROM concepts)""")
fragment("concept_cats", """SELECT tag, dim, list_sort(list_distinct(list(category))) AS ccats FROM concept_tok CROSS JOIN vocab
    WHERE contains(low, phrase) OR (len(ptoks) > 0 AND list_has_all(ctoks, ptoks)) GROUP BY ALL""")
fragment("norm", f"""SELECT dim, value, any_value(vtoks) AS vtoks, list_sort(list_distinct(list(category) FILTER (category IS NOT NULL))) AS vcats FROM (
    SELECT DISTINCT dim, value, {_toks('lower(value)')} AS vtoks FROM hyp_long) LEFT JOIN vocab v USING (dim) WHERE category IS NULL
      OR contains(lower(value), phrase) OR list_has_all(vtoks, ptoks) GROUP BY ALL
    UNION ALL SELECT DISTINCT dim, value, {_toks('lower(value)')} AS vtoks, [] FROM hyp_long h WHERE EXISTS (SELECT 1 FROM vocab v WHERE v.dim = h.dim)
      AND NOT EXISTS (SELECT 1 FROM vocab v WHERE v.dim = h.dim AND (contains(lower(h.value), v.phrase) OR list_has_all({_toks('lower(h.value)')}, v.ptoks)))""")
# every (candidate, hypothesis, dimension) of the fused pools, judged
fragment("pair_long", """SELECT fact_id, hyp_idx, tag, dim, pool_rank, ctl,
      CASE WHEN ctl THEN len(list_intersect(vc, cc)) > 0 WHEN len(vtoks) > 0 AND len(ctoks) > 0 THEN ov >= 0.5 END AS matched,
      CASE WHEN ctl THEN CASE WHEN len(cc) > 0 THEN 0.85 ELSE 0.35 END WHEN len(vtoks) > 0 AND len(ctoks) > 0 THEN least(0.75, greatest(0.2, ov)) ELSE 0 END AS confidence,
      CASE WHEN ctl THEN CASE WHEN len(cc) > 0 THEN 'controlled_category_intersection' ELSE 'candidate_missing_controlled_category' END
        WHEN len(vtoks) > 0 AND len(ctoks) > 0 THEN 'token_overlap' ELSE 'no_comparable_tokens' END AS reason FROM (
    SELECT f.fact_id, h.hyp_idx, f.tag, h.dim, f.rank AS pool_rank, n.vtoks, c.ctoks, coalesce(n.vcats, []) AS vc, coalesce(k.ccats, []) AS cc,
      len(coalesce(n.vcats, [])) > 0 OR len(coalesce(k.ccats, [])) > 0 AS ctl,
      len(list_intersect(n.vtoks, c.ctoks))::DOUBLE / nullif(len(n.vtoks), 0) AS ov
    FROM fused f JOIN hyp_long h USING (fact_id) JOIN norm n USING (dim, value) JOIN concept_tok c USING (tag) LEFT JOIN concept_cats k ON k.tag = f.tag AND k.dim = h.dim)""")
# a pair without any resolved dimension still takes part with score 0
fragment("pair_agree", """SELECT fact_id, hyp_idx, tag, rank, coalesce(matched, 0) AS n_matched, coalesce(evaluated, 0) AS n_evaluated,
      CASE WHEN coalesce(evaluated, 0) > 0 THEN matched / evaluated::DOUBLE ELSE 0.0 END AS agree
    FROM (SELECT fact_id, tag, rank, unnest([0::BIGINT, 1::BIGINT]) AS hyp_idx FROM fused) LEFT JOIN (
      SELECT fact_id, hyp_idx, tag, count(*) FILTER (matched) AS matched, count(matched) AS evaluated FROM pair_long GROUP BY ALL) USING (fact_id, hyp_idx, tag)""")
WINDOW_M = 10
fragment("verdicts", f"""SELECT fact_id, hyp_idx, tag, dim, CASE WHEN x < 3 THEN NULL ELSE x < 7 END AS matched FROM (
    SELECT fact_id, hyp_idx, tag, dim, {sql_md5("fact_id || '-' || hyp_idx || '-' || tag || '-' || dim")} % 10 AS x FROM fused,
      (SELECT unnest([0::BIGINT, 1::BIGINT]) AS hyp_idx), (SELECT unnest(['family', 'role', 'event', 'qualifier', 'scope', 'temporal']) AS dim) WHERE rank <= 10)""")


def verdicts(fused: DataFrame) -> DataFrame:
    dims = ["family", "role", "event", "qualifier", "scope", "temporal"]
    rows = fused.where(F.col("rank") <= WINDOW_M).select(
        "fact_id", "tag", F.explode(F.array(F.lit(0), F.lit(1))).alias("hyp_idx")).withColumn(
        "dim", F.explode(F.array(*map(F.lit, dims))))
    x = md5_int(F.concat_ws("-", F.col("fact_id").cast("string"), F.col("hyp_idx").cast("string"), "tag", "dim")) % 10
    return rows.withColumn("matched", F.when(x >= 3, x < 7))
