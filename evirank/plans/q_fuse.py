"""Fusion of ranked lists, metrics and slices over customers' lists of parts."""

from pyspark.sql import functions as F

from evirank.operators import fuse, metrics
from evirank.operators.fuse import high, ranked
from evirank.plans import frames
from evirank.plans.registry import fragment, query


def rrf(keys: str, source: str = "rankings", how: str = "sum", kappa: int = 60) -> str:
    return f"""SELECT {keys}, tag, s AS fused_score, br AS best_rank, fl AS first_list, n AS n_lists, bs AS best_score,
      row_number() OVER (PARTITION BY {keys} ORDER BY round(s, 10) DESC, fl, br, tag) AS rank FROM (
        SELECT {keys}, tag, {how}(1.0::DOUBLE / ({kappa} + rank)) AS s, min(rank) AS br, min(list_id) AS fl, count(*) AS n,
          arg_min(score, (rank, list_id)) AS bs FROM {source} GROUP BY ALL)"""


fragment("fused", rrf("fact_id"))
fragment("fused_mean", rrf("fact_id", how="avg"))
OUT = "SELECT fact_id, tag, rank, round(fused_score, 8) AS fused_score, best_rank, first_list, n_lists, best_score FROM "


def _out(df, *extra):
    return df.select("fact_id", "tag", "rank", F.round("fused_score", 8).alias("fused_score"), *extra)


@query("U1_sum_rrf", OUT + "fused")
def u1(t):
    df = fuse.fuse(frames.rankings(t).withColumn("best_score", F.col("score")), payload=("best_score",))
    return _out(df, "best_rank", "first_list", "n_lists", "best_score")


@query("U1_round_hits", """SELECT fact_id, tag, string_agg(list_id || ':' || rank, ',' ORDER BY list_id) AS hits FROM rankings GROUP BY fact_id, tag""")
def u1_hits(t):
    hits = fuse.round_hits(frames.rankings(t))
    return hits.select("fact_id", "tag", F.array_join(
        F.transform("hits", lambda h: F.concat_ws(":", h["list_id"].cast("string"), h["rank"].cast("string"))), ",").alias("hits"))


@query("U2_mean_rrf", OUT + "fused_mean WHERE rank <= 50")
def u2(t):
    df = fuse.fuse(frames.rankings(t).withColumn("best_score", F.col("score")), top_k=50, how="mean", payload=("best_score",))
    return _out(df, "best_rank", "first_list", "n_lists", "best_score")


@query("U3_list_rrf", "SELECT fact_id, tag, rank, round(fused_score, 8) AS fused_score FROM fused")
def u3(t):
    lists = frames.rankings(t).groupBy("fact_id", "list_id").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("rank", "tag"))), lambda p: p["tag"]).alias("tags"))
    return _out(fuse.fuse_tag_lists(lists))


@query("U4_combsum", """SELECT fact_id, tag, rank, round(s, 8) AS fused_score FROM (
    SELECT fact_id, tag, s, row_number() OVER (PARTITION BY fact_id ORDER BY round(s, 10) DESC, fl, tag) AS rank FROM (
      SELECT fact_id, tag, sum(sc) AS s, min(list_id) AS fl FROM (SELECT *, CASE WHEN max(score) OVER w - min(score) OVER w < 1e-12 THEN 1.0
        ELSE (score - min(score) OVER w) / (max(score) OVER w - min(score) OVER w) END AS sc FROM rankings
        WINDOW w AS (PARTITION BY fact_id, list_id)) GROUP BY ALL)) WHERE rank <= 50""")
def u4(t):
    return _out(fuse.combsum(frames.rankings(t), "score", 50))


@query("U5_selection_union", """SELECT fact_id, tag, row_number() OVER (PARTITION BY fact_id ORDER BY own NULLS LAST, other, tag) AS rank FROM (
    SELECT fact_id, tag, min(CASE WHEN list_id = fact_id % 4 + 1 THEN rank END) AS own, min(CASE WHEN list_id <> fact_id % 4 + 1 THEN rank END) AS other
    FROM rankings GROUP BY ALL)""")
def u5(t):
    rows = frames.rankings(t).withColumn("selected", F.col("list_id") == F.col("fact_id") % 4 + 1)
    return fuse.selection_union(rows).select("fact_id", "tag", "rank")


@query("U6_ordered_union", """SELECT fact_id, tag, row_number() OVER (PARTITION BY fact_id ORDER BY f, tag) AS rank FROM (
    SELECT fact_id, tag, min((list_id, rank)) AS f FROM rankings GROUP BY ALL)""")
def u6(t):
    return fuse.ordered_union(frames.rankings(t)).select("fact_id", "tag", "rank")


fragment("pooled", """SELECT * FROM (SELECT fact_id, tag, fused_score, best_rank, row_number() OVER (
    PARTITION BY fact_id ORDER BY round(fused_score, 10) DESC, best_rank, tag) AS pool_rank FROM fused) WHERE pool_rank <= 30""")


@query("U7_pool_truncation", "SELECT fact_id, tag, pool_rank, round(fused_score, 8) AS fused_score FROM pooled")
def u7(t):
    scores = fuse.rrf_scores(frames.rankings(t))
    return fuse.truncate_pool(scores, 30).select("fact_id", "tag", "pool_rank", F.round("fused_score", 8).alias("fused_score"))


@query("U8_composite", """SELECT fact_id, tag, row_number() OVER (PARTITION BY fact_id ORDER BY mp NULLS LAST, rank, tag) AS rank FROM (
    SELECT r.fact_id, r.tag, r.rank, m.mp FROM rankings r LEFT JOIN (
      SELECT fact_id, tag, min(51 - rank) AS mp FROM rankings WHERE list_id = 2 AND rank <= 5 GROUP BY ALL) m USING (fact_id, tag) WHERE list_id = 1)""")
def u8(t):
    lists = frames.rankings(t)
    model = lists.where("list_id = 2 AND rank <= 5").select("fact_id", "tag", (51 - F.col("rank")).alias("pos"))
    return fuse.composite(model, lists.where("list_id = 1")).select("fact_id", "tag", "rank")


@query("U9_candidate_pool", """SELECT fact_id, tag, arg_min(score, (tier, list_id, rank)) AS score FROM (
    SELECT fact_id, tag, list_id, rank, score, CASE WHEN list_id = 4 THEN 1 ELSE 0 END AS tier FROM rankings) GROUP BY ALL""")
def u9(t):
    lists = frames.rankings(t)
    return fuse.candidate_pool(lists.where("list_id < 4"), lists.where("list_id = 4"), ["score"])


@query("U10_rebuild", """WITH o AS (SELECT a.fact_id, a.tag, a.rank AS new_rank, coalesce(b.rank, 1000 + a.rank) AS old_rank FROM rankings a
      LEFT JOIN (SELECT fact_id, tag, rank FROM rankings WHERE list_id = 2) b USING (fact_id, tag) WHERE a.list_id = 1),
    m AS (SELECT o.*, p.tag IS NOT NULL AS has FROM o LEFT JOIN (SELECT DISTINCT fact_id, tag FROM rankings WHERE list_id >= 2) p USING (fact_id, tag)),
    k AS (SELECT * FROM (SELECT fact_id, tag, row_number() OVER (PARTITION BY fact_id ORDER BY new_rank) AS rank,
      row_number() OVER (PARTITION BY fact_id ORDER BY old_rank) AS old_pos FROM m WHERE has) WHERE rank <= 20)
    SELECT fact_id, n_dropped, n_kept, order_changed, gold_rank FROM (SELECT fact_id, count(*) FILTER (NOT has) AS n_dropped FROM m GROUP BY fact_id)
    LEFT JOIN (SELECT k.fact_id, count(*) AS n_kept, bool_or(rank <> old_pos) AS order_changed, min(CASE WHEN g.tag IS NOT NULL THEN rank END) AS gold_rank
      FROM k LEFT JOIN gold g USING (fact_id, tag) GROUP BY k.fact_id) USING (fact_id)""")
def u10(t):
    lists = frames.rankings(t)
    old = lists.where("list_id = 2").select("fact_id", "tag", F.col("rank").alias("old"))
    order = lists.where("list_id = 1").join(old, ["fact_id", "tag"], "left").select(
        "fact_id", "tag", "rank", F.col("rank").alias("new_rank"), F.coalesce("old", F.col("rank") + 1000).alias("old_rank"))
    pool = lists.where("list_id >= 2").select("fact_id", "tag").distinct()
    return fuse.rebuild(order, pool, frames.gold(t), 20)


@query("U11_inventory_intersection", """SELECT tag FROM (SELECT l_partkey AS tag FROM lineitem WHERE l_returnflag = 'R' INTERSECT
    SELECT p_partkey FROM part WHERE p_size > 20)""")
def u11(t):
    from evirank.operators.corpus import inventory

    returned = t.lineitem.where("l_returnflag = 'R'").select(F.col("l_partkey").alias("tag"))
    return inventory(returned, t.part.where("p_size > 20").select(F.col("p_partkey").alias("tag")))


@query("U12_split_differences", """WITH tr AS (SELECT DISTINCT l_orderkey AS id, l_partkey AS tag, l_suppkey AS ctx FROM lineitem WHERE l_orderkey % 10 < 8),
    te AS (SELECT DISTINCT l_orderkey AS id, l_partkey AS tag, l_suppkey AS ctx FROM lineitem WHERE l_orderkey % 10 >= 8)
    SELECT (SELECT count(*) FROM (SELECT id FROM tr INTERSECT SELECT id FROM te)) AS id_overlap,
      (SELECT count(*) FROM (SELECT ctx FROM tr INTERSECT SELECT ctx FROM te)) AS context_overlap,
      (SELECT count(*) FROM (SELECT tag FROM te EXCEPT SELECT tag FROM tr)) AS missing_in_train,
      (SELECT count(*) FROM (SELECT tag FROM tr EXCEPT SELECT tag FROM te)) AS train_only,
      (SELECT count(*) FROM (SELECT tag FROM tr INTERSECT SELECT tag FROM te)) AS shared""")
def u12(t):
    from evirank.operators.splits import split_differences

    rows = t.lineitem.select(
        F.when(F.col("l_orderkey") % 10 < 8, "train").otherwise("test").alias("split"), F.col("l_orderkey").alias("sample_id"),
        F.col("l_suppkey").alias("context_id"), F.col("l_partkey").alias("tag"))
    return split_differences(rows)


# --- metrics -------------------------------------------------------------------------------------------------------

DEPTHS = [5, 10, 20]
SQL_METRICS = ", ".join(
    ["coalesce(1.0::DOUBLE / gold_rank, 0) AS mrr", "CASE WHEN gold_rank = 1 THEN 1.0::DOUBLE ELSE 0 END AS accuracy"]
    + [f"CASE WHEN gold_rank <= {k} THEN 1.0::DOUBLE ELSE 0 END AS recall_at_{k}" for k in DEPTHS])
NAMES = ["mrr", "accuracy"] + [f"recall_at_{k}" for k in DEPTHS]
fragment("fused_ranks", "SELECT fact_id, min(rank) AS gold_rank FROM fused JOIN gold USING (fact_id, tag) GROUP BY fact_id")
fragment("fused_metrics", f"SELECT f.*, gold_rank, {SQL_METRICS} FROM facts f LEFT JOIN fused_ranks USING (fact_id)")
fragment("list_ranks", """SELECT fact_id, list_id, hyp_idx, rendering, min(CASE WHEN g.tag IS NOT NULL THEN rank END) AS gold_rank
    FROM rankings LEFT JOIN gold g USING (fact_id, tag) GROUP BY ALL""")


def fused_metrics(t, **kw):
    ranks = metrics.gold_ranks(fuse.fuse(frames.rankings(t), **kw), frames.gold(t), ["fact_id"])
    return metrics.fact_metrics(frames.facts(t), ranks, DEPTHS)


@query("M1_first_gold_rank", "SELECT fact_id, list_id, gold_rank FROM list_ranks")
def m1(t):
    return metrics.gold_ranks(frames.rankings(t), frames.gold(t), ["fact_id", "list_id"])


@query("M2_fact_metrics", f"SELECT fact_id, gold_rank, {', '.join(NAMES)} FROM fused_metrics")
def m2(t):
    return fused_metrics(t).select("fact_id", "gold_rank", *NAMES)


AVGS = ", ".join(f"round(avg({n}), 6) AS {n}" for n in NAMES)


@query("M3_aggregate_metrics", f"SELECT count(*) AS n, count(DISTINCT context_id) AS n_contexts, {AVGS} FROM fused_metrics")
def m3(t):
    return metrics.slices(fused_metrics(t), NAMES, [])


@query("M4_metric_slices", f"""SELECT coalesce(modality, 'pooled') AS modality, config, count(*) AS n, count(DISTINCT context_id) AS n_contexts, {AVGS}
    FROM (SELECT 'sum' AS config, * FROM fused_metrics UNION ALL SELECT 'mean', f.*, gold_rank, {SQL_METRICS} FROM facts f LEFT JOIN (
      SELECT fact_id, min(rank) AS gold_rank FROM fused_mean JOIN gold USING (fact_id, tag) GROUP BY fact_id) USING (fact_id))
    GROUP BY GROUPING SETS ((modality, config), (config))""")
def m4(t):
    both = metrics.stacked({"sum": fused_metrics(t), "mean": fused_metrics(t, how="mean")})
    return metrics.slices(both, NAMES, ["modality"], keep=["config"])


@query("M5_gold_coverage", """SELECT modality, avg(CASE WHEN coalesce(ok, false) THEN 1.0 ELSE 0 END) AS gold_in_taxonomy,
    avg(CASE WHEN gold_rank IS NULL THEN 0.0 ELSE 1 END) AS search_coverage FROM facts LEFT JOIN (
      SELECT fact_id, bool_and(p_partkey IS NOT NULL) AS ok FROM gold LEFT JOIN (SELECT p_partkey FROM part WHERE p_size > 10) ON tag = p_partkey::VARCHAR
      GROUP BY fact_id) USING (fact_id) LEFT JOIN fused_ranks USING (fact_id) GROUP BY modality""")
def m5(t):
    concepts = t.part.where("p_size > 10").select(F.col("p_partkey").cast("string").alias("tag"))
    rows = metrics.gold_coverage(frames.facts(t), frames.gold(t), concepts, fuse.fuse(frames.rankings(t)))
    return rows.groupBy("modality").agg(
        F.avg("gold_in_taxonomy").alias("gold_in_taxonomy"), F.avg("search_coverage").alias("search_coverage"))


fragment("fused_by_rendering", rrf("fact_id, rendering"))
fragment("rendering_base", """SELECT fact_id, rendering, arg_min(coalesce(gold_rank, 9999), hyp_idx) AS h1, min(gold_rank) AS u, rr FROM list_ranks
    LEFT JOIN (SELECT fact_id, rendering, min(rank) AS rr FROM fused_by_rendering JOIN gold USING (fact_id, tag) GROUP BY ALL) USING (fact_id, rendering)
    GROUP BY fact_id, rendering, rr""")


@query("M6_rendering_metrics", """SELECT modality, rendering, depth, count(*) AS n, round(avg(CASE WHEN h1 <= depth THEN 1.0 ELSE 0 END), 6) AS hyp1_recall,
    round(avg(CASE WHEN h1 <= depth THEN 1.0::DOUBLE / h1 ELSE 0 END), 6) AS hyp1_mrr, round(avg(CASE WHEN u <= depth THEN 1.0 ELSE 0 END), 6) AS coverage,
    round(avg(CASE WHEN rr <= depth THEN 1.0 ELSE 0 END), 6) AS rrf_recall, round(avg(CASE WHEN rr <= depth THEN 1.0::DOUBLE / rr ELSE 0 END), 6) AS rrf_mrr
    FROM rendering_base JOIN facts USING (fact_id), (SELECT unnest([5, 10, 20]) AS depth) GROUP BY ALL""")
def m6(t):
    lists = frames.rankings(t)
    fused = fuse.fuse(lists, keys=("fact_id", "rendering"))
    rows = metrics.rendering_metrics(lists, frames.gold(t), fused, DEPTHS).join(frames.facts(t), "fact_id")
    names = ["hyp1_recall", "hyp1_mrr", "coverage", "rrf_recall", "rrf_mrr"]
    return rows.groupBy("modality", "rendering", "depth").agg(
        F.count(F.lit(1)).alias("n"), *[F.round(F.avg(n), 6).alias(n) for n in names])


@query("M7_marginal_coverage", """SELECT depth, j, avg(covered) AS coverage, count(*) AS n FROM (SELECT depth, row_number() OVER w AS j,
    max(CASE WHEN gold_rank <= depth THEN 1.0 ELSE 0 END) OVER (w ROWS UNBOUNDED PRECEDING) AS covered FROM list_ranks, (SELECT unnest([5, 10, 20]) AS depth)
    WINDOW w AS (PARTITION BY fact_id, depth ORDER BY list_id)) GROUP BY ALL""")
def m7(t):
    rows = metrics.marginal_coverage(frames.rankings(t), frames.gold(t), DEPTHS)
    return rows.groupBy("depth", "j").agg(F.avg(F.col("covered").cast("double")).alias("coverage"), F.count(F.lit(1)).alias("n"))


fragment("jaccards", """SELECT s.fact_id, n_lists, mean_jaccard FROM (SELECT fact_id, count(DISTINCT list_id) AS n_lists FROM rankings WHERE rank <= 10 GROUP BY fact_id) s
    LEFT JOIN (SELECT fact_id, avg(i / (na + nb - i)) AS mean_jaccard FROM (
      SELECT x.fact_id, x.na, y.nb, coalesce(i, 0)::DOUBLE AS i FROM (SELECT fact_id, list_id, count(*) AS na FROM rankings WHERE rank <= 10 GROUP BY ALL) x
      JOIN (SELECT fact_id, list_id, count(*) AS nb FROM rankings WHERE rank <= 10 GROUP BY ALL) y ON x.fact_id = y.fact_id AND x.list_id < y.list_id
      LEFT JOIN (SELECT a.fact_id, a.list_id AS la, b.list_id AS lb, count(*) AS i FROM rankings a JOIN rankings b ON a.fact_id = b.fact_id AND a.tag = b.tag
        AND a.list_id < b.list_id WHERE a.rank <= 10 AND b.rank <= 10 GROUP BY ALL) z ON z.fact_id = x.fact_id AND z.la = x.list_id AND z.lb = y.list_id) GROUP BY fact_id)
    j ON j.fact_id = s.fact_id""")


@query("M8_pairwise_jaccard", "SELECT fact_id, n_lists, round(mean_jaccard, 8) AS mean_jaccard FROM jaccards")
def m8(t):
    rows = metrics.mean_pairwise_jaccard(frames.rankings(t), 10)
    return rows.withColumn("mean_jaccard", F.round("mean_jaccard", 8))


@query("M9_collapse_diagnostic", """SELECT round(avg(mean_jaccard), 6) AS mean_jaccard, avg(mean_jaccard) > 0.8 AS collapsed, count(mean_jaccard) AS n_facts FROM jaccards""")
def m9(t):
    return metrics.collapse_flag(metrics.mean_pairwise_jaccard(frames.rankings(t), 10), 0.8)


@query("M13_ensemble_mean", f"""SELECT count(*) AS n, count(DISTINCT context_id) AS n_contexts, round(avg(mrr), 6) AS mrr, round(avg(recall_at_5), 6) AS recall_at_5 FROM (
    SELECT context_id, (a.mrr + b.mrr) / 2 AS mrr, (a.r + b.r) / 2 AS recall_at_5 FROM facts JOIN
     (SELECT fact_id, coalesce(1.0::DOUBLE / gold_rank, 0) AS mrr, CASE WHEN gold_rank <= 5 THEN 1.0::DOUBLE ELSE 0 END AS r FROM list_ranks WHERE list_id = 1) a USING (fact_id) JOIN
     (SELECT fact_id, coalesce(1.0::DOUBLE / gold_rank, 0) AS mrr, CASE WHEN gold_rank <= 5 THEN 1.0::DOUBLE ELSE 0 END AS r FROM list_ranks WHERE list_id = 3) b USING (fact_id))""")
def m13(t):
    ranks = metrics.gold_ranks(frames.rankings(t), frames.gold(t), ["fact_id", "list_id"])
    sides = [metrics.fact_metrics(frames.facts(t), ranks.where(F.col("list_id") == i), [5]).where(
        F.col("list_id").isNotNull()) for i in (1, 3)]
    return metrics.slices(metrics.ensemble_mean(*sides, ["mrr", "recall_at_5"]), ["mrr", "recall_at_5"], [])


@query("M14_top_score_list", """SELECT fact_id, arg_max(list_id, (m, -list_id)) AS carried_list, round(max(m), 8) AS mean_score FROM (
    SELECT fact_id, list_id, round(avg(score / 100), 10) AS m FROM rankings WHERE rank <= 5 GROUP BY ALL) GROUP BY fact_id""")
def m14(t):
    rows = metrics.top_score_list(frames.rankings(t), F.col("score") / 100, 5)
    return rows.withColumn("mean_score", F.round("mean_score", 8))


fragment("calls", """SELECT event_id AS log_pos, user_id AS fact_id, event_type, event_id % 100 AS prompt_tokens,
    (value * 10)::BIGINT AS completion_tokens, event_id % 7 <> 0 AS parse_ok FROM (SELECT event_id, user_id, event_type, floor(value) AS value FROM events)""")


def calls(t):
    return t.events.select(
        F.col("event_id").alias("log_pos"), F.col("user_id").alias("fact_id"), "event_type",
        (F.col("event_id") % 100).alias("prompt_tokens"), (F.floor("value") * 10).cast("bigint").alias("completion_tokens"),
        (F.col("event_id") % 7 != 0).alias("parse_ok"))


@query("M15_usage_totals", """SELECT event_type, count(*) AS n_calls, sum(prompt_tokens)::BIGINT AS prompt_tokens, sum(completion_tokens)::BIGINT AS completion_tokens,
    round(avg(CASE WHEN parse_ok THEN 1.0 ELSE 0 END), 8) AS parse_rate, round(avg(CASE WHEN completion_tokens >= 200 THEN 1.0 ELSE 0 END), 8) AS cap_share FROM calls GROUP BY event_type""")
def m15(t):
    rows = metrics.usage_totals(calls(t), ["event_type"], 200)
    return rows.withColumns({c: F.round(c, 8) for c in ("parse_rate", "cap_share")})


@query("M17_equality_audit", f"""WITH a AS (SELECT modality, {AVGS} FROM fused_metrics GROUP BY modality), b AS (SELECT modality, {AVGS} FROM (
      SELECT f.*, gold_rank, {SQL_METRICS} FROM facts f LEFT JOIN (SELECT fact_id, min(rank) AS gold_rank FROM fused_mean JOIN gold USING (fact_id, tag) GROUP BY fact_id) USING (fact_id)) GROUP BY modality)
    SELECT modality, metric, l AS left_value, r AS right_value FROM (UNPIVOT a ON {', '.join(NAMES)} INTO NAME metric VALUE l) FULL JOIN
    (UNPIVOT b ON {', '.join(NAMES)} INTO NAME metric VALUE r) USING (modality, metric) WHERE NOT coalesce(abs(l - r) <= 1e-6, false)""")
def m17(t):
    sides = [metrics.slices(fused_metrics(t, how=how), NAMES, ["modality"]).where("modality <> 'pooled'") for how in ("sum", "mean")]
    return metrics.audit_equal(*sides, ["modality"], NAMES)


@query("M18_order_audit", """WITH j AS (SELECT fact_id, tag, a.rank AS l, b.rank AS r FROM fused a FULL JOIN (SELECT fact_id, tag, row_number() OVER (
      PARTITION BY fact_id ORDER BY round(fused_score, 10) DESC, tag) AS rank FROM fused) b USING (fact_id, tag)),
    p AS (SELECT fact_id, bool_and(l IS NOT NULL AND r IS NOT NULL) AS ss, bool_and(coalesce(l = r, false)) AS so FROM j GROUP BY fact_id)
    SELECT count(*) AS n_facts, count(*) FILTER (NOT ss) AS set_differences, count(*) FILTER (ss AND NOT so) AS order_differences FROM p""")
def m18(t):
    fused = fuse.fuse(frames.rankings(t))
    plain = ranked(fused.drop("rank"), ["fact_id"], [high("fused_score"), F.asc("tag")])
    return metrics.order_audit(fused, plain)


@query("M19_interaction_table", f"""SELECT verifier, reranker, count(*) AS n, round(avg(coalesce(1.0::DOUBLE / gold_rank, 0)), 6) AS mrr,
    round(avg(CASE WHEN gold_rank = 1 THEN 1.0 ELSE 0 END), 6) AS accuracy FROM (SELECT list_id <= 2 AS verifier, list_id % 2 = 1 AS reranker, gold_rank
      FROM facts JOIN list_ranks USING (fact_id)) GROUP BY ALL""")
def m19(t):
    ranks = metrics.gold_ranks(frames.rankings(t), frames.gold(t), ["fact_id", "list_id"])
    rows = metrics.fact_metrics(frames.facts(t), ranks, []).where(F.col("list_id").isNotNull())
    cells = rows.withColumns({"verifier": F.col("list_id") <= 2, "reranker": F.col("list_id") % 2 == 1})
    return metrics.interaction_table(cells, ["mrr", "accuracy"])


@query("M20_miss_summary", """SELECT modality, datatype, count(*) AS n, count(*) FILTER (gold_rank IS NULL) AS misses,
    avg(CASE WHEN gold_rank IS NULL THEN 1.0 ELSE 0 END) AS miss_rate FROM facts JOIN (SELECT fact_id, gold_rank FROM list_ranks WHERE list_id = 3) USING (fact_id) GROUP BY ALL""")
def m20(t):
    probe = metrics.gold_ranks(frames.rankings(t).where("list_id = 3"), frames.gold(t), ["fact_id"])
    return metrics.miss_summary(probe, frames.facts(t))


@query("M20_common_misses", """SELECT tag, count(*) AS n FROM (SELECT fact_id FROM list_ranks WHERE list_id = 3 AND gold_rank IS NULL) JOIN gold USING (fact_id)
    GROUP BY tag ORDER BY n DESC, tag LIMIT 25""")
def m20b(t):
    probe = metrics.gold_ranks(frames.rankings(t).where("list_id = 3"), frames.gold(t), ["fact_id"])
    return metrics.common_misses(probe, frames.gold(t))


# --- ranking contracts ----------------------------------------------------------------------------------------------

@query("QM1_mode_fusion", f"""WITH inner_lists AS ({rrf('fact_id, hyp_idx')}),
    two AS (SELECT fact_id, tag, row_number() OVER (PARTITION BY fact_id ORDER BY round(s, 10) DESC, fl, br, tag) AS rank FROM (
      SELECT fact_id, tag, sum(1.0::DOUBLE / (60 + rank)) AS s, min(hyp_idx) AS fl, min(rank) AS br FROM inner_lists WHERE rank <= 20 GROUP BY ALL)),
    defs AS ({rrf('fact_id', '(SELECT * FROM rankings WHERE rendering = $$def$$)')}), one AS ({rrf('fact_id', '(SELECT * FROM rankings WHERE list_id = 1)')})
    SELECT 'parallel_sampling_diversity' AS mode, fact_id, tag, rank FROM two WHERE rank <= 20 UNION ALL SELECT 'parallel_sampling', fact_id, tag, rank FROM defs WHERE rank <= 20
    UNION ALL SELECT 'frozen_hypotheses', fact_id, tag, rank FROM fused WHERE rank <= 20 UNION ALL SELECT 'direct_retrieval', fact_id, tag, rank FROM one WHERE rank <= 20""")
def qm1(t):
    lists = frames.rankings(t)
    modes = ["parallel_sampling_diversity", "parallel_sampling", "frozen_hypotheses", "direct_retrieval"]
    return metrics.stacked({m: fuse.fuse_mode(lists, m, 20).select("fact_id", "tag", "rank") for m in modes}, "mode")
