"""BM25 ranking of concepts for text queries, as joins and aggregates over a postings table.

Frames:
  concepts(doc_idx, tag, entity_type, standard_label, retrieval_text)
  queries(query_id, entity_type, query)
  docs(scope, doc_idx, tag, tokens, dl)          from `scoped_docs`
  postings(scope, token, doc_idx, tag, dl, tf)   from `postings`

Only rows that survive a top-k window are ever sorted per query, and Spark keeps k rows per query and map task
before the shuffle (WindowGroupLimit), so a query that matches a third of the corpus does not fill one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from evirank.domain import DomainConfig
from evirank.functions.text import coverage, first_filled, token_set, tokenize

ALL = "ALL"
#: Scores are compared at ten digits; a pool whose scores differ by less is one of equal scores.
NO_SPREAD = 5e-11


def scoped_docs(concepts: DataFrame, typed: bool = True) -> DataFrame:
    """Each concept once under its type and once under ALL, where its type counts as text too.

    The text is tokenised once; scores do not depend on token order, so the type's tokens are simply added.
    """
    rows = concepts.select("doc_idx", "tag", "entity_type", tokenize("retrieval_text").alias("own"))
    whole = F.struct(F.lit(ALL).alias("scope"), F.concat(tokenize("entity_type"), F.col("own")).alias("tokens"))
    own = F.struct(F.col("entity_type").alias("scope"), F.col("own").alias("tokens"))
    scoped = rows.select("doc_idx", "tag", F.inline(F.array(own, whole) if typed else F.array(whole)))
    return scoped.withColumn("dl", F.size("tokens"))


def scope_stats(docs: DataFrame) -> DataFrame:
    return docs.groupBy("scope").agg(F.count(F.lit(1)).alias("n_docs"), F.avg("dl").alias("avgdl"))


def postings(docs: DataFrame, vocabulary: DataFrame | None = None) -> DataFrame:
    """Term frequencies; with a vocabulary(scope, token) other tokens are dropped before the shuffle."""
    rows = docs.select("scope", "doc_idx", "tag", "dl", F.explode("tokens").alias("token"))
    if vocabulary is not None:
        rows = rows.join(vocabulary, ["scope", "token"], "left_semi")
    return rows.groupBy("scope", "token", "doc_idx", "tag", "dl").agg(F.count(F.lit(1)).alias("tf"))


def idf_table(posts: DataFrame, stats: DataFrame) -> DataFrame:
    # least(tf, 1) keeps tf in the plan, so this aggregate and the scoring join share one postings exchange
    df = posts.groupBy("scope", "token").agg(F.sum(F.least("tf", F.lit(1))).alias("df"))
    return df.join(stats, "scope").withColumn(
        "idf", F.log(1.0 + (F.col("n_docs") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    )


def resolve_scope(queries: DataFrame, stats: DataFrame, typed: bool = True) -> DataFrame:
    """The query's own type when such an index exists, else the index over all concepts."""
    if not typed:
        return queries.withColumn("scope", F.lit(ALL))
    known = stats.select(F.col("scope").alias("known_scope"))
    return queries.join(known, F.col("entity_type") == F.col("known_scope"), "left").withColumn(
        "scope", F.coalesce("known_scope", F.lit(ALL))
    ).drop("known_scope")


def by_document(rows: DataFrame) -> DataFrame:
    """Spread index rows by document before queries meet them.

    While the query terms are small enough to be broadcast, every (query, document) group then forms and is summed
    inside one task: the index is shuffled, not the far more numerous matches, and only k rows per query and task
    travel to the top-k window. The count is fixed, so tasks are not merged for the small input they read.
    """
    return rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), "doc_idx")


def match_parts(queries: DataFrame, docs: DataFrame, stats: DataFrame, cfg: DomainConfig) -> DataFrame:
    """One row per (query, concept, shared token) with the token's share of the BM25 score."""
    terms = queries.select("query_id", "scope", F.explode(token_set("query")).alias("token"))
    posts = postings(docs, terms.select("scope", "token").distinct())
    weighted = posts.join(idf_table(posts, stats), ["scope", "token"]).select(
        "scope", "token", "doc_idx", "tag",
        (F.col("idf") * F.col("tf") * (cfg.k1 + 1.0)
         / (F.col("tf") + cfg.k1 * (1.0 - cfg.b + cfg.b * F.col("dl") / F.col("avgdl")))).alias("part"),
    )
    return terms.join(by_document(weighted), ["scope", "token"]).select("query_id", "scope", "doc_idx", "tag", "part")


def match_scores(queries: DataFrame, docs: DataFrame, stats: DataFrame, cfg: DomainConfig) -> DataFrame:
    """BM25 score of every (query, concept) that shares a token: query_id, scope, doc_idx, tag, bm25_score."""
    parts = match_parts(queries, docs, stats, cfg)
    return parts.groupBy("query_id", "scope", "doc_idx", "tag").agg(F.sum("part").alias("bm25_score"))


def _top(df: DataFrame, keys: list[str], order: list, k: int, name: str = "rank") -> DataFrame:
    window = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(name, F.row_number().over(window)).where(F.col(name) <= k)


def bm25_order() -> list:
    return [F.desc(F.expr("round(bm25_score, 10)")), F.asc("doc_idx")]


def rank_bm25(queries: DataFrame, docs: DataFrame, k: int, cfg: DomainConfig = DomainConfig(),
              typed: bool = True, zero_fill: bool = True, stats: DataFrame | None = None) -> DataFrame:
    """Top k concepts per query by (score desc, doc_idx); short lists are padded with unmatched concepts at 0."""
    stats = scope_stats(docs) if stats is None else stats
    scoped = resolve_scope(queries, stats, typed)
    hits = _top(match_scores(scoped, docs, stats, cfg), ["query_id"], bm25_order(), k)
    if not zero_fill:
        return hits
    return _zero_filled(scoped, hits, docs, k)


def _zero_filled(scoped: DataFrame, hits: DataFrame, docs: DataFrame, k: int) -> DataFrame:
    """The first k concepts of a scope are enough: at most len(hits) of them can already be in the list."""
    found = hits.groupBy("query_id").agg(F.count(F.lit(1)).alias("n_hits"))
    short = scoped.select("query_id", "scope").join(found, "query_id", "left").where(
        F.coalesce("n_hits", F.lit(0)) < k
    )
    head = _top(docs.select("scope", "doc_idx", "tag"), ["scope"], [F.asc("doc_idx")], k, "pos").drop("pos")
    pad = (
        short.select("query_id", "scope").join(head, "scope")
        .join(hits.select("query_id", "doc_idx"), ["query_id", "doc_idx"], "left_anti")
        .select("query_id", "scope", "doc_idx", "tag", F.lit(0.0).alias("bm25_score"))
    )
    both = hits.drop("rank").unionByName(pad)
    return _top(both, ["query_id"], bm25_order(), k)


def rescore_with_labels(queries: DataFrame, docs: DataFrame, concepts: DataFrame, k: int,
                        cfg: DomainConfig = DomainConfig(), typed: bool = True) -> DataFrame:
    """BM25 min-max scaled over the pool plus weighted label coverage, ordered by five keys.

    With `pool_multiplier` <= 0 the pool is every concept of the scope.
    """
    stats = scope_stats(docs)
    scoped = resolve_scope(queries, stats, typed).withColumn("q_tokens", token_set("query"))
    labels = concepts.select("doc_idx", token_set(first_filled("standard_label", "tag")).alias("label_tokens"))
    if cfg.pool_multiplier <= 0:
        pool = _whole_pool(scoped, docs, labels, stats, match_parts(scoped, docs, stats, cfg), k)
    else:
        pool_k = max(k, k * cfg.pool_multiplier)
        pool = _bounded_pool(scoped, docs, labels, _top(match_scores(scoped, docs, stats, cfg), ["query_id"], bm25_order(), pool_k), pool_k)
    return _rescored(pool, k, cfg)


def _rescored(pool: DataFrame, k: int, cfg: DomainConfig) -> DataFrame:
    """Top k of a pool with bm25_score, its lo and hi per query, and both coverages.

    Equal scores that were summed in another order differ in their last bits; a spread of no more than that is none.
    """
    spread = F.col("hi") - F.col("lo")
    rescored = pool.withColumn(
        "bm25_normalized", F.when(spread >= NO_SPREAD, (F.col("bm25_score") - F.col("lo")) / spread).otherwise(F.lit(1.0))
    ).withColumn(
        "retrieval_score",
        F.col("bm25_normalized") + cfg.coverage_weight * (F.col("label_coverage") + F.col("query_label_coverage")),
    ).drop("lo", "hi")
    order = [
        F.desc(F.expr("round(retrieval_score, 10)")), F.desc(F.expr("round(label_coverage, 10)")),
        F.desc(F.expr("round(query_label_coverage, 10)")), F.desc(F.expr("round(bm25_score, 10)")), F.asc("tag"),
    ]
    return _top(rescored, ["query_id"], order, k)


def _bounded_pool(scoped: DataFrame, docs: DataFrame, labels: DataFrame, hits: DataFrame, pool_k: int) -> DataFrame:
    """The best pool_k concepts per query, zero fill included, with their coverage."""
    pool = _zero_filled(scoped, hits, docs, pool_k).drop("rank")
    span = pool.groupBy("query_id").agg(F.min("bm25_score").alias("lo"), F.max("bm25_score").alias("hi"))
    joined = pool.join(span, "query_id").join(scoped.select("query_id", "q_tokens"), "query_id").join(labels, "doc_idx")
    cov, qcov = coverage("q_tokens", "label_tokens")
    return joined.withColumns({"label_coverage": cov, "query_label_coverage": qcov}).drop("q_tokens", "label_tokens")


def _whole_pool(scoped: DataFrame, docs: DataFrame, labels: DataFrame, stats: DataFrame, parts: DataFrame, k: int) -> DataFrame:
    """Every concept that can be listed: text matches, label matches, and the smallest tags of the scope.

    Text and label postings meet in one aggregate per (query, concept), so coverage is a count and no concept text is
    joined to the matches. A concept without either match scores the pool minimum; it is listed only while there are
    fewer than k matches, so 2k names leave k that are no match.
    """
    terms = scoped.select("query_id", "scope", F.size("q_tokens").alias("n_query"), F.explode("q_tokens").alias("token"))
    members = docs.select("scope", "doc_idx", "tag")
    label_terms = labels.select("doc_idx", F.size("label_tokens").alias("n_label"), F.explode("label_tokens").alias("token")).join(
        terms.select("token").distinct(), "token", "left_semi")
    none = F.lit(None).cast("int")
    cells = ["query_id", "scope", "doc_idx", "tag"]
    by_text = parts.select(*cells, "part", F.lit(0).alias("shared"), none.alias("n_label"), none.alias("n_query"))
    by_label = terms.join(by_document(label_terms.join(members, "doc_idx")), ["scope", "token"]).select(
        *cells, F.lit(None).cast("double").alias("part"), F.lit(1).alias("shared"), "n_label", "n_query")
    head = _top(members, ["scope"], [F.asc("tag")], 2 * k, "pos").drop("pos")
    by_name = scoped.select("query_id", "scope").join(head, "scope").select(
        *cells, F.lit(None).cast("double").alias("part"), F.lit(0).alias("shared"), none.alias("n_label"), none.alias("n_query"))
    pool = by_text.unionByName(by_label).unionByName(by_name).groupBy(*cells).agg(
        F.sum("part").alias("text_score"), F.sum("shared").alias("shared"), F.max("n_label").alias("n_label"), F.max("n_query").alias("n_query"))
    hit = pool.groupBy("query_id").agg(F.min("text_score").alias("min_hit"), F.max("text_score").alias("max_hit"), F.count("text_score").alias("n_hits"))
    span = scoped.select("query_id", "scope").join(stats, "scope").join(hit, "query_id").select(
        "query_id", F.when(F.col("n_hits") < F.col("n_docs"), 0.0).otherwise(F.col("min_hit")).alias("lo"), F.coalesce("max_hit", F.lit(0.0)).alias("hi"))
    return pool.join(span, "query_id").select(
        *cells, F.coalesce("text_score", F.lit(0.0)).alias("bm25_score"), "lo", "hi",
        F.coalesce(F.col("shared") / F.col("n_label"), F.lit(0.0)).alias("label_coverage"),
        F.coalesce(F.col("shared") / F.col("n_query"), F.lit(0.0)).alias("query_label_coverage"))


def attach_concepts(ranking: DataFrame, concepts: DataFrame, digits: int = 8) -> DataFrame:
    """Late join of the concept text; scores are rounded here and nowhere earlier."""
    scores = [c for c in ("bm25_score", "bm25_normalized", "label_coverage", "query_label_coverage", "retrieval_score")
              if c in ranking.columns]
    text = concepts.select("doc_idx", "entity_type", "standard_label", "retrieval_text")
    return ranking.join(text, "doc_idx").withColumns({c: F.round(c, digits) for c in scores})


def renderings(hypotheses: DataFrame, cfg: DomainConfig) -> DataFrame:
    """Query rows per hypothesis: the definition always, the label for dual modalities when it is not empty.

    hypotheses(fact_id, hyp_idx, modality, entity, entity_type, context, def_query, lab_query)
    """
    from evirank.functions.text import grounding_query

    dual = F.col("modality").isin(list(cfg.dual_modalities)) & (F.coalesce("lab_query", F.lit("")) != "")
    forms = F.array_compact(F.array(
        F.struct(F.lit("def").alias("rendering"), F.col("def_query").alias("text")),
        F.when(dual, F.struct(F.lit("lab").alias("rendering"), F.col("lab_query").alias("text"))),
    ))
    rows = hypotheses.select("fact_id", "hyp_idx", "entity", "entity_type", "context", F.inline(forms))
    return rows.select(
        "fact_id", "hyp_idx", "rendering", "entity_type",
        grounding_query("entity", "entity_type", "context", "text").alias("query"),
        (F.col("hyp_idx") * 2 + F.when(F.col("rendering") == "def", 1).otherwise(2)).alias("list_id"),
    )


def self_retrieval(concepts: DataFrame, docs: DataFrame, cfg: DomainConfig = DomainConfig()) -> DataFrame:
    """Per scope: share of concepts whose own text does not rank them first."""
    queries = concepts.select(
        F.col("tag").alias("query_id"), "entity_type", F.col("retrieval_text").alias("query"),
        F.col("doc_idx").alias("own_idx"),
    )
    best = rank_bm25(queries, docs, 1, cfg, zero_fill=False).select("query_id", F.col("doc_idx").alias("top_idx"))
    checked = queries.join(best, "query_id", "left")
    missed = F.coalesce(F.col("top_idx") != F.col("own_idx"), F.lit(True)).cast("int")
    return checked.groupBy("entity_type").agg(
        F.count(F.lit(1)).alias("concepts"), F.sum(missed).alias("misses"), F.avg(missed).alias("failure_rate")
    )


def same_type_first(rankings: DataFrame, n: int) -> DataFrame:
    """Candidates of the fact's own type first, the others after them, first n."""
    order = [F.desc((F.col("tag_type") == F.col("fact_type")).cast("int")), F.asc("rank"), F.asc("tag")]
    return _top(rankings, ["fact_id"], order, n, "pos")


def adopt_rendering(rankings: DataFrame, policy: dict[str, str], default: str) -> DataFrame:
    """Lists of the rendering adopted for the fact's modality, numbered by hypothesis."""
    wanted = F.lit(default)
    for modality, rendering in policy.items():
        wanted = F.when(F.col("modality") == modality, F.lit(rendering)).otherwise(wanted)
    return rankings.where((F.col("rendering") == wanted) | (wanted == "dual")).withColumn("adopted", wanted)


def best_score(*names: str):
    """First score present: rerank, fused, retrieval, BM25."""
    return F.coalesce(*names)
