"""Round-by-round analytics: eight consecutive events are the rounds of one fact, a dialogue's turns another kind."""

from pyspark.sql import functions as F

from evirank.functions import codes
from evirank.functions.text import md5_int, token_set
from evirank.operators import corpus, fuse, rounds
from evirank.operators.fuse import high, ranked
from evirank.plans import frames
from evirank.plans.q_text import POSITION
from evirank.plans.registry import fragment, query, sql_md5, sql_tokens


def event_rounds(t):
    k = F.get_json_object("props", "$.k").cast("int")
    rows = t.events.select(
        F.floor(F.col("event_id") / 8).alias("fact_id"), (F.col("event_id") % 8 + 1).alias("round_idx"), F.col("event_type").alias("operator"),
        F.when(F.col("event_type") != "error", F.floor("value") + 1).alias("rank"), F.when(k % 5 != 0, k % 40 + 1).alias("replay_rank"),
        F.col("event_id").alias("step"), k.alias("k"))
    return rows.withColumns({"context_id": F.col("fact_id") % 50, "arm": F.when(F.col("fact_id") % 2 == 0, "seq").otherwise("random"),
                             "modality": F.when(F.col("fact_id") % 3 == 0, "table").otherwise("text")})


fragment("event_rounds", """SELECT *, fact_id % 50 AS context_id, CASE WHEN fact_id % 2 = 0 THEN 'seq' ELSE 'random' END AS arm,
    CASE WHEN fact_id % 3 = 0 THEN 'table' ELSE 'text' END AS modality FROM (SELECT event_id // 8 AS fact_id, event_id % 8 + 1 AS round_idx,
      event_type AS operator, CASE WHEN event_type <> 'error' THEN floor(value)::BIGINT + 1 END AS rank, CASE WHEN k % 5 <> 0 THEN k % 40 + 1 END AS replay_rank,
      event_id AS step, k FROM (SELECT *, (props->>'$.k')::INT AS k FROM events))""")
fragment("rewarded", """SELECT *, u - coalesce(lag(u) OVER w, 0) AS delta, 0.5 * (u - coalesce(lag(u) OVER w, 0)) + 0.5 * (u - ur) AS reward FROM (
    SELECT *, CASE WHEN rank > 0 THEN 1.0::DOUBLE / log2(rank + 1) ELSE 0 END AS u, CASE WHEN replay_rank > 0 THEN 1.0::DOUBLE / log2(replay_rank + 1) ELSE 0 END AS ur FROM event_rounds)
    WINDOW w AS (PARTITION BY fact_id ORDER BY round_idx)""")
fragment("turns", f"SELECT conv_id AS fact_id, turn AS round_idx, role, list_distinct({sql_tokens('text')}) AS toks FROM conversations")


def turns(t):
    return t.conversations.select(F.col("conv_id").alias("fact_id"), F.col("turn").alias("round_idx"), "role", token_set("text").alias("toks"))


NOVELTY = """SELECT a.fact_id, a.round_idx, CASE WHEN len(a.toks) = 0 OR max(b.round_idx) IS NULL THEN 1.0 ELSE round(1 - max(CASE WHEN b.toks IS NULL THEN 0
    ELSE len(list_intersect(a.toks, b.toks)) / len(list_distinct(list_concat(a.toks, b.toks)))::DOUBLE END), 6) END AS novelty FROM {a} a LEFT JOIN {a} b ON a.fact_id = b.fact_id AND b.round_idx < a.round_idx
    GROUP BY a.fact_id, a.round_idx, a.toks"""
fragment("event_sets", "SELECT fact_id, round_idx, list_distinct([operator, 'k' || (k % 10), 'r' || (coalesce(rank, 0) % 4), modality]) AS toks FROM event_rounds")


@query("J1_neighborhood_novelty", NOVELTY.format(a="event_sets"))
def j1(t):
    tags = F.array_distinct(F.array(F.col("operator"), F.concat(F.lit("k"), F.col("k") % 10),
                                    F.concat(F.lit("r"), F.coalesce("rank", F.lit(0)) % 4), F.col("modality")))
    return rounds.novelty(event_rounds(t).withColumn("items", tags), "items").select("fact_id", "round_idx", "novelty")


@query("J2_query_novelty", f"SELECT *, novelty >= 0.6 AS passes_gate FROM ({NOVELTY.format(a='turns')})")
def j2(t):
    rows = rounds.novelty(turns(t), "toks").select("fact_id", "round_idx", "novelty")
    return rows.withColumn("passes_gate", F.col("novelty") >= 0.6)


fragment("mems", f"""SELECT conv_id || '-' || turn AS id, conv_id AS source, CASE WHEN conv_id % 2 = 0 THEN 'table' ELSE 'text' END AS modality,
    'd' || conv_id % 7 AS datatype, role, turn % 4 < 2 AS positive, list_distinct({sql_tokens('text')}) AS toks FROM conversations""")


@query("J3_memory_retrieval", """WITH q AS (SELECT * FROM mems WHERE role = 'user'), m AS (SELECT * FROM mems WHERE role <> 'user' AND datatype <> 'd3'),
    s AS (SELECT q.id, count(m.id) > 0 AS strict FROM q LEFT JOIN m ON q.modality = m.modality AND q.datatype = m.datatype AND q.source <> m.source GROUP BY q.id),
    p AS (SELECT q.id AS query_id, m.id AS memory_id, m.positive, len(list_intersect(q.toks, m.toks))::DOUBLE AS n, len(q.toks) AS nq, len(m.toks) AS nm
      FROM q JOIN s USING (id) JOIN m ON q.modality = m.modality AND (NOT strict OR q.datatype = m.datatype) AND q.source <> m.source)
    SELECT query_id, memory_id, positive, place, round(sim, 8) AS similarity FROM (SELECT *, row_number() OVER (PARTITION BY query_id, positive ORDER BY round(sim, 10) DESC, memory_id) AS place
      FROM (SELECT *, CASE WHEN n > 0 THEN n / (nq + nm - n) ELSE 0 END AS sim FROM p)) WHERE place <= 3""")
def j3(t):
    rows = t.conversations.select(
        F.concat_ws("-", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("id"), F.col("conv_id").alias("source"),
        F.when(F.col("conv_id") % 2 == 0, "table").otherwise("text").alias("modality"), F.concat(F.lit("d"), F.col("conv_id") % 7).alias("datatype"),
        "role", (F.col("turn") % 4 < 2).alias("positive"), token_set("text").alias("tokens"))
    queries = rows.where("role = 'user'").withColumnRenamed("id", "query_id")
    memories = rows.where("role <> 'user' AND datatype <> 'd3'").withColumnRenamed("id", "memory_id")
    return rounds.nearest_memories(queries, memories, 3).select("query_id", "memory_id", "positive", "place", F.round("similarity", 8).alias("similarity"))


@query("J4_span_overlap", "SELECT doc_id, r.s AS s, r.e AS e, idx FROM ranges JOIN sentences USING (doc_id) WHERE r.s < span_end AND r.e > span_start")
def j4(t):
    ranges = t.documents.select("doc_id", F.inline(codes.parse_ranges(F.expr(POSITION))))
    return codes.spans_touching(codes.sentence_spans(t.documents, "doc_id", "text"), ranges, "doc_id").select("doc_id", "s", "e", "idx")


# targets: every third document keeps its own lines, the others are aligned sentence by sentence
fragment("targets", "SELECT doc_id, idx, line FROM doc_lines WHERE doc_id % 3 = 0 UNION ALL SELECT doc_id, idx, 'en: ' || sentence FROM sentences WHERE doc_id % 3 <> 0")
fragment("loci", """WITH c AS (SELECT doc_id, count(*) AS n FROM sentences GROUP BY doc_id), g AS (SELECT doc_id, count(*) AS m, string_agg(line, chr(10) ORDER BY idx) AS doc FROM targets GROUP BY doc_id),
    h AS (SELECT DISTINCT doc_id, idx FROM ranges JOIN sentences USING (doc_id) WHERE r.s < span_end AND r.e > span_start),
    l AS (SELECT doc_id, string_agg(idx::VARCHAR, ',' ORDER BY idx) AS indices, string_agg(line, ' ' ORDER BY idx) AS locus, count(*) FILTER (line IS NULL) AS outside FROM h LEFT JOIN targets USING (doc_id, idx) GROUP BY doc_id)
    SELECT d.doc_id, coalesce(indices, '') AS indices, coalesce(n, 0) = coalesce(m, 0) AS alignment_ok, coalesce(n, 0) = coalesce(m, 0) AND locus IS NOT NULL AND outside = 0 AS ok, locus AS sentence_locus, doc
    FROM documents d LEFT JOIN c USING (doc_id) LEFT JOIN g USING (doc_id) LEFT JOIN l USING (doc_id)""")
_CLEAN = "trim(regexp_replace(coalesce({x}, ''), '[\\s\\x0b\\x1c-\\x1f\\x{{85}}\\p{{Z}}]+', ' ', 'g'))"


def source_and_target(t):
    sentences = codes.sentence_spans(t.documents, "doc_id", "text")
    lines = codes.line_spans(t.documents, "doc_id", "text").where("doc_id % 3 = 0").select("doc_id", "idx", "line").unionByName(
        sentences.where("doc_id % 3 <> 0").select("doc_id", "idx", F.concat(F.lit("en: "), F.col("sentence")).alias("line")))
    return sentences, lines


def loci(t):
    sentences, lines = source_and_target(t)
    requests = t.documents.select(F.col("doc_id").alias("req_id"), "doc_id", codes.parse_ranges(F.expr(POSITION)).alias("ranges"))
    return codes.aligned_locus(requests, sentences, lines)


@query("J5_aligned_locus", f"""SELECT doc_id, indices, alignment_ok, CASE WHEN ok THEN 'aligned_sentence' ELSE 'document' END AS locus_level,
    CASE WHEN ok THEN {_CLEAN.format(x='sentence_locus')} ELSE {_CLEAN.format(x='doc')} END AS locus FROM loci""")
def j5(t):
    return loci(t).select("doc_id", F.array_join("sentence_indices", ",").alias("indices"), "alignment_ok", "locus_level", "locus")


# a part tree: the parent of key k is k div 10, as a code's parent drops its last character
def part_tree(t):
    return t.part.select(F.col("p_partkey").alias("node"), F.when(F.col("p_partkey") > 0, F.floor(F.col("p_partkey") / 10)).alias("parent"),
                         F.col("p_name").alias("label"), F.when(F.col("p_size") % 3 == 0, F.concat(F.lit("note "), F.col("p_size"))).alias("note"), "p_brand")


fragment("tree", """SELECT p_partkey AS node, CASE WHEN p_partkey > 0 THEN p_partkey // 10 END AS parent, p_name AS label,
    CASE WHEN p_size % 3 = 0 THEN 'note ' || p_size END AS note, p_brand FROM part""")
fragment("walked", """SELECT node, label AS path, coalesce(note, '') AS notes, 0 AS depth FROM tree WHERE parent IS NULL
    UNION ALL SELECT t.node, w.path || ' > ' || t.label, w.notes || CASE WHEN t.note IS NULL THEN '' WHEN w.notes = '' THEN t.note ELSE ';' || t.note END, w.depth + 1 FROM tree t JOIN walked w ON t.parent = w.node""")


@query("J6_hierarchy_walk", "SELECT node, path, notes, depth FROM walked")
def j6(t):
    return corpus.walk_up(part_tree(t)).select("node", F.array_join("labels", " > ").alias("path"), F.array_join("notes", ";").alias("notes"), "depth")


@query("J7_index_term_paths", """SELECT p_brand, array_to_string(list_sort(list_distinct(list(path))), '|') AS paths FROM walked JOIN tree USING (node) WHERE note IS NOT NULL GROUP BY p_brand""")
def j7(t):
    tree = part_tree(t)
    paths = corpus.walk_up(tree).select("node", F.array_join("labels", " > ").alias("path"))
    return corpus.paths_by_code(tree.where("note IS NOT NULL").select("node", F.col("p_brand").alias("code")).join(paths, "node")).select(
        F.col("code").alias("p_brand"), F.array_join("paths", "|").alias("paths"))


ALPHA = 0.5


@query("J8_utility_reward", "SELECT fact_id, round_idx, round(u, 8) AS u, round(delta, 8) AS delta, round(reward, 8) AS reward FROM rewarded")
def j8(t):
    rows = rounds.rewards(event_rounds(t), ALPHA)
    return rows.select("fact_id", "round_idx", *[F.round(c, 8).alias(c) for c in ("u", "delta", "reward")])


@query("J9_transition_log", """SELECT fact_id, round_idx, bo AS before_operator, operator, round(reward - br, 8) AS reward_change, bo || ' -> ' || operator || ' ' || modality AS search_text
    FROM (SELECT *, lag(operator) OVER w AS bo, lag(reward) OVER w AS br FROM rewarded WINDOW w AS (PARTITION BY fact_id ORDER BY round_idx)) WHERE bo IS NOT NULL""")
def j9(t):
    rows = rounds.transitions(rounds.rewards(event_rounds(t), ALPHA))
    return rows.select("fact_id", "round_idx", "before_operator", "operator", F.round("reward_change", 8).alias("reward_change"), "search_text")


fragment("curve", """SELECT fact_id, round_idx, last_value(hit IGNORE NULLS) OVER (PARTITION BY fact_id ORDER BY round_idx) AS recall FROM (
    SELECT fact_id, unnest(range(1, 11)) AS round_idx FROM (SELECT DISTINCT fact_id FROM event_rounds)) LEFT JOIN (
      SELECT fact_id, round_idx, CASE WHEN rank <= 10 THEN 1.0::DOUBLE ELSE 0 END AS hit FROM event_rounds) USING (fact_id, round_idx)""")


@query("J10_recall_curve", "SELECT fact_id, avg(recall) AS aulc, string_agg(recall::INT, '' ORDER BY round_idx) AS curve FROM curve GROUP BY fact_id")
def j10(t):
    curve = rounds.recall_curve(event_rounds(t), 10, 10)
    text = curve.groupBy("fact_id").agg(F.array_join(F.transform(
        F.array_sort(F.collect_list(F.struct("round_idx", "recall"))), lambda p: p["recall"].cast("int").cast("string")), "").alias("curve"))
    return rounds.learning_area(curve).join(text, "fact_id")


fragment("arm_facts", """SELECT arm, context_id, fact_id, count(*) AS rr, max(CASE WHEN round_idx = 1 AND rank <= 10 THEN 1.0 ELSE 0 END) AS r1, max(CASE WHEN rank <= 10 THEN 1.0 ELSE 0 END) AS fin,
    CASE WHEN max(k) > 80 THEN 'budget' ELSE 'plateau' END AS stop_reason, min(k) > 2 AS parity_ok FROM event_rounds GROUP BY arm, context_id, fact_id""")


@query("J11_arm_summary", """SELECT * FROM (SELECT arm, count(*) AS facts, count(DISTINCT context_id) AS contexts, round(avg(fin), 6) AS full_recall, round(avg(r1), 6) AS round1_recall, round(avg(fin) - avg(r1), 6) AS full_minus_round1,
      round(avg(rr), 6) AS realized_rounds_mean, max(rr) AS realized_rounds_max, round(avg(aulc), 6) AS aulc, count(*) FILTER (NOT parity_ok) AS parity_failures
      FROM arm_facts JOIN (SELECT fact_id, avg(recall) AS aulc FROM curve GROUP BY fact_id) USING (fact_id) GROUP BY arm)
    JOIN (SELECT arm, '{' || string_agg('"' || stop_reason || '":' || n, ',' ORDER BY stop_reason) || '}' AS stop_reasons FROM (SELECT arm, stop_reason, count(*) AS n FROM arm_facts GROUP BY ALL) GROUP BY arm) USING (arm)""")
def j11(t):
    rows = event_rounds(t)
    hit = F.coalesce((F.col("rank") <= 10).cast("double"), F.lit(0.0))
    per_fact = rows.groupBy("arm", "context_id", "fact_id").agg(
        F.count(F.lit(1)).alias("realized_rounds"), F.max(F.when(F.col("round_idx") == 1, hit).otherwise(0.0)).alias("round1_hit"),
        F.max(hit).alias("final_hit"), F.when(F.max("k") > 80, "budget").otherwise("plateau").alias("stop_reason"), (F.min("k") > 2).alias("parity_ok"))
    return rounds.arm_summary(per_fact.join(rounds.learning_area(rounds.recall_curve(rows, 10, 10)), "fact_id"))


@query("J12_round_one_parity", """SELECT fact_id, bool_and(a.tag IS NOT DISTINCT FROM b.tag) AS parity_ok, min(CASE WHEN a.tag IS DISTINCT FROM b.tag THEN rank END) AS first_divergence FROM fused a FULL JOIN (
    SELECT fact_id, tag, row_number() OVER (PARTITION BY fact_id ORDER BY round(fused_score, 10) DESC, tag) AS rank FROM fused) b USING (fact_id, rank) GROUP BY fact_id""")
def j12(t):
    fused = fuse.fuse(frames.rankings(t))
    other = ranked(fused.drop("rank"), ["fact_id"], [high("fused_score"), F.asc("tag")])
    return rounds.parity(fused, other)


DIMS = list(frames.VALUES)
STATUS = ["support", "contradict", "unresolved"]


def states(t):
    """Feedback status per (part, dimension) from a hash: the arrays a controller reads."""
    key = F.col("p_partkey").cast("string")
    status = {d: frames.pick(STATUS, F.concat(F.lit(f"st{d}"), key)) for d in DIMS}

    def having(s):
        return F.array_compact(F.array(*[F.when(status[d] == s, F.lit(d)) for d in DIMS]))

    rows = t.part.select(F.col("p_partkey").alias("fact_id"), "p_type", "p_size", having("support").alias("supported"),
                         having("contradict").alias("contradicted"), having("unresolved").alias("open"))
    structural = F.size(F.array_intersect("contradicted", F.array(F.lit("FAMILY"), F.lit("ROLE"), F.lit("EVENT"))))
    return rows.withColumn("mismatch", structural >= 2)


fragment("states", "SELECT p_partkey AS fact_id, p_type, p_size, dim, pos, status FROM (" + " UNION ALL ".join(
    f"SELECT p_partkey, p_type, p_size, '{d}' AS dim, {i} AS pos, " + frames.sql_pick(STATUS, f"'st{d}' || p_partkey") + " AS status FROM part" for i, d in enumerate(DIMS)) + ")")
fragment("mismatches", "SELECT fact_id, count(*) FILTER (status = 'contradict' AND dim IN ('FAMILY', 'ROLE', 'EVENT')) >= 2 AS mismatch FROM states GROUP BY fact_id")


@query("J13_context_features", """SELECT fact_id, '1.0,' || CASE WHEN p_size % 2 = 0 THEN '1.0,0.0' ELSE '0.0,1.0' END || ',0.0,0.0,0.0,' || ns || '.0,' || na || '.0,' || nu || '.0,' || CASE WHEN mismatch THEN '1.0' ELSE '0.0' END || ',0.5' AS psi FROM (
    SELECT fact_id, any_value(p_size) AS p_size, count(*) FILTER (status = 'support') AS ns, count(*) FILTER (status = 'contradict') AS na, count(*) FILTER (status = 'unresolved') AS nu FROM states GROUP BY fact_id) JOIN mismatches USING (fact_id)""")
def j13(t):
    rows = states(t).select("fact_id", F.when(F.col("p_size") % 2 == 0, "table").otherwise("text").alias("modality"), F.col("p_type").alias("datatype"),
                            F.size("supported").alias("ns"), F.size("contradicted").alias("na"), F.size("open").alias("nu"), "mismatch", F.lit(0.5).alias("novelty"))
    psi = rounds.context_features("modality", "datatype", "ns", "na", "nu", "mismatch", "novelty")
    return rows.select("fact_id", F.array_join(F.transform(psi, lambda x: x.cast("string")), ",").alias("psi"))


@query("J14_admissible_slate", """WITH p AS (SELECT fact_id, CASE WHEN status = 'contradict' THEN 0 ELSE 2 END AS pr, pos, CASE WHEN status = 'contradict' THEN 'REFINE' ELSE 'BRANCH' END AS mode,
      'O_refine_' || lower(dim) AS operator, dim AS target FROM states WHERE status <> 'support' UNION ALL SELECT fact_id, 1, 0, 'CHANGE_STRATEGY', 'O_change_strategy', '' FROM mismatches WHERE mismatch
      UNION ALL SELECT fact_id, 3, 0, 'PERTURB', 'O_perturb', '' FROM mismatches),
    n AS (SELECT *, row_number() OVER (PARTITION BY fact_id ORDER BY pr, pos) AS slot, count(*) OVER (PARTITION BY fact_id) AS size FROM p),
    s AS (SELECT fact_id, coalesce(string_agg(dim, ',' ORDER BY pos) FILTER (status = 'support'), '') AS preserve FROM states GROUP BY fact_id)
    SELECT fact_id, CASE WHEN mode = 'PERTURB' AND size > 4 THEN 4 ELSE slot END AS slot, mode, operator, target, preserve FROM n JOIN s USING (fact_id) WHERE (mode = 'PERTURB' AND size > 4) OR slot < 4 OR (slot = 4 AND size <= 4)""")
def j14(t):
    return rounds.admissible_slate(states(t), 4).select("fact_id", "slot", "mode", "operator", "target", "preserve")


def before_after(prefix):
    return {d: frames.pick(o, F.concat(F.lit(prefix + d), F.col("p_partkey").cast("string"))) for d, o in frames.VALUES.items()}


MODES = ["REFINE", "BRANCH", "CHANGE_STRATEGY", "PERTURB"]
fragment("edits", "SELECT p_partkey AS fact_id, dim, pos, bv, av, mode, target, pv FROM (" + " UNION ALL ".join(
    f"SELECT p_partkey, '{d}' AS dim, {i} AS pos, {frames.sql_pick(o, chr(39) + 'b' + d + chr(39) + ' || p_partkey')} AS bv, {frames.sql_pick(o, chr(39) + 'z' + d + chr(39) + ' || p_partkey')} AS av, "
    f"{frames.sql_pick(MODES, chr(39) + 'mo' + chr(39) + ' || p_partkey')} AS mode, {frames.sql_pick(DIMS, chr(39) + 'ta' + chr(39) + ' || p_partkey')} AS target, {frames.sql_pick(DIMS, chr(39) + 'pr' + chr(39) + ' || p_partkey')} AS pv FROM part"
    for i, (d, o) in enumerate(frames.VALUES.items())) + ")")


@query("J15_edit_enforcement", """SELECT fact_id, string_agg(CASE WHEN ok THEN av ELSE bv END, '|' ORDER BY pos) AS enforced, coalesce(string_agg(dim, ',' ORDER BY pos) FILTER (NOT ok AND av <> bv), '') AS reverted
    FROM (SELECT *, (mode IN ('REFINE', 'BRANCH') AND target = dim) OR (mode = 'CHANGE_STRATEGY' AND pv <> dim) AS ok FROM edits) GROUP BY fact_id""")
def j15(t):
    def as_map(cells):
        return F.create_map(*[x for d, c in cells.items() for x in (F.lit(d), c)])

    key = F.col("p_partkey").cast("string")
    rows = t.part.select(F.col("p_partkey").alias("fact_id"), as_map(before_after("b")).alias("before"), as_map(before_after("z")).alias("after"),
                         frames.pick(MODES, F.concat(F.lit("mo"), key)).alias("mode"), frames.pick(DIMS, F.concat(F.lit("ta"), key)).alias("target"),
                         F.array(frames.pick(DIMS, F.concat(F.lit("pr"), key))).alias("preserve"))
    out = rounds.enforce_directive(rows, DIMS)
    return out.select("fact_id", F.array_join(F.array(*[F.col("enforced")[d] for d in DIMS]), "|").alias("enforced"), F.array_join("reverted", ",").alias("reverted"))


ZETA = 0.9999
PSI = "[1.0::DOUBLE, CASE WHEN modality = 'table' THEN 1.0::DOUBLE ELSE 0 END, k / 100.0::DOUBLE]"


def psi_rounds(t):
    rows = rounds.rewards(event_rounds(t), ALPHA)
    psi = F.array(F.lit(1.0), F.when(F.col("modality") == "table", 1.0).otherwise(0.0), F.col("k") / 100.0)
    return rows.withColumn("psi", psi)


fragment("moment_parts", f"""SELECT operator, context_id, count(*) AS n, sum(w) AS a_0_0, sum(w * p[1] * p[2]) AS a_0_1, sum(w * p[1] * p[3]) AS a_0_2, sum(w * p[2] * p[2]) AS a_1_1, sum(w * p[2] * p[3]) AS a_1_2,
    sum(w * p[3] * p[3]) AS a_2_2, sum(w * p[1] * reward) AS b_0, sum(w * p[2] * reward) AS b_1, sum(w * p[3] * reward) AS b_2
    FROM (SELECT *, pow({ZETA}::DOUBLE, (SELECT max(event_id) + 1 FROM events) - step) AS w, {PSI} AS p FROM rewarded) GROUP BY operator, context_id""")
CELLS = ["a_0_0", "a_0_1", "a_0_2", "a_1_1", "a_1_2", "a_2_2", "b_0", "b_1", "b_2"]


def loco(t):
    now = t.events.agg((F.max("event_id") + 1).alias("now"))
    return rounds.leave_one_context_out(rounds.decayed_moments(psi_rounds(t), 3, ZETA, now))


@query("J16_decayed_moments", "SELECT m.operator, m.context_id, t.n - m.n AS n, " + ", ".join(f"round(t.{c} - m.{c}, 6) AS {c}" for c in CELLS)
       + " FROM moment_parts m JOIN (SELECT operator, sum(n)::BIGINT AS n, " + ", ".join(f"sum({c}) AS {c}" for c in CELLS) + " FROM moment_parts GROUP BY operator) t USING (operator)")
def j16(t):
    return loco(t).withColumns({c: F.round(c, 6) for c in CELLS})


# the inverse of a symmetric 3 x 3 matrix from its cofactors
@query("J16_posterior_means", """WITH m AS (SELECT m.operator, m.context_id, t.n - m.n AS n, 1 + t.a_0_0 - m.a_0_0 AS a, t.a_0_1 - m.a_0_1 AS b, t.a_0_2 - m.a_0_2 AS c, 1 + t.a_1_1 - m.a_1_1 AS d,
      t.a_1_2 - m.a_1_2 AS e, 1 + t.a_2_2 - m.a_2_2 AS f, t.b_0 - m.b_0 AS x, t.b_1 - m.b_1 AS y, t.b_2 - m.b_2 AS z FROM moment_parts m JOIN (SELECT operator, sum(n)::BIGINT AS n, """
       + ", ".join(f"sum({c}) AS {c}" for c in CELLS) + """ FROM moment_parts GROUP BY operator) t USING (operator)),
    k AS (SELECT *, d * f - e * e AS aa, c * e - b * f AS bb, b * e - c * d AS cc, a * f - c * c AS dd, b * c - a * e AS ee, a * d - b * b AS ff FROM m)
    SELECT operator, context_id, n, round((aa * x + bb * y + cc * z) / det, 6) AS mu_0, round((bb * x + dd * y + ee * z) / det, 6) AS mu_1, round((cc * x + ee * y + ff * z) / det, 6) AS mu_2
    FROM (SELECT *, a * aa + b * bb + c * cc AS det FROM k)""")
def j16p(t):
    means = rounds.posterior_means(loco(t), 3, 1.0)
    return means.select("operator", "context_id", "n", *[F.round(F.col("mu")[i], 6).alias(f"mu_{i}") for i in range(3)])


@query("J17_diagonal_statistics", f"""SELECT arm, feature, round(a, 6) AS a, round(b, 6) AS b, round(b / a, 6) AS mu FROM (SELECT arm, feature, sum(x * x) + 1.0::DOUBLE AS a, sum(reward * x) AS b FROM (
    SELECT arm, reward, unnest(p) AS x, unnest([0, 1, 2]) AS feature FROM (SELECT arm, reward, {PSI} AS p FROM rewarded)) GROUP BY ALL)""")
def j17(t):
    rows = rounds.diagonal_statistics(psi_rounds(t), 1.0)
    return rows.withColumns({c: F.round(c, 6) for c in ("a", "b", "mu")})
