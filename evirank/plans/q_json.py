"""Model outputs derived from events and dialogues: clean, wrapped, cut off, or no JSON at all."""

from pyspark.sql import functions as F

from evirank.functions import modeljson as mj
from evirank.functions.text import md5_int, tokenize
from evirank.plans import frames
from evirank.plans.registry import fragment, query, sql_md5, sql_tokens


def wrapped(doc, kind):
    """Spark spelling of the six ways an answer is written around its JSON."""
    return (F.when(kind == 0, doc).when(kind == 1, F.concat(F.lit("<think>so {x: 1}</think>\n"), doc)).when(kind == 2, F.concat(F.lit("```"), doc, F.lit("```")))
            .when(kind == 3, F.concat(F.lit("Answer: "), doc, F.lit(" done."))).when(kind == 4, F.expr("left(doc, cast(length(doc) * 62 div 100 as int))")).otherwise("no json here"))


SQL_WRAPPED = """CASE kind WHEN 0 THEN doc WHEN 1 THEN '<think>so {x: 1}</think>' || chr(10) || doc WHEN 2 THEN '```' || doc || '```'
    WHEN 3 THEN 'Answer: ' || doc || ' done.' WHEN 4 THEN left(doc, length(doc) * 62 // 100) ELSE 'no json here' END"""


def outputs(t):
    rows = t.events.select(
        "event_id", (F.col("event_id") % 6).alias("kind"), F.expr(
            "concat('{\"query\": \"', event_type, ' ', user_id, '\", \"dimensions\": {\"FAMILY\": \"', event_type, '\", \"role\": \"user ', user_id, '\", \"SCOPE\": \"\"},"
            " \"operators\": [\"rate\", \"bogus\"], \"q_lab\": \"', if(event_id % 4 = 0, '', 'lab'), '\", \"queries\": [\"a ', user_id, '\", {\"query\": \"b\"}, \"\"],"
            " \"D+\": [\"FAMILY\"], \"contradicted_dimensions\": \"ROLE; EVENT\", \"structural_mismatch\": {\"is_mismatch\": \"', if(event_id % 3 = 0, 'yes', 'no'), '\"},"
            " \"mode\": \"', if(event_id % 2 = 0, 'refine', 'jump'), '\", \"operator\": \"', if(event_id % 5 = 0, 'schedule', 'dance'), '\", \"dimension\": \"role\", \"patch\": \"p\", \"preserve\": [\"FAMILY\", \"SCOPE\"],"
            " \"decisive_dimensions\": [\"role\", \"Family\", \"role\", \"other\"], \"substring\": ', if(event_id % 7 = 0, 'null', '\"ev\"'), '}')").alias("doc"), "event_type", "user_id")
    return rows.select("event_id", "kind", "event_type", "user_id", wrapped(F.col("doc"), F.col("kind")).alias("raw_output"))


fragment("outs", f"""SELECT event_id, kind, event_type, user_id, {SQL_WRAPPED} AS raw FROM (SELECT event_id, event_id % 6 AS kind, event_type, user_id,
    '{{"query": "' || event_type || ' ' || user_id || '", "dimensions": {{"FAMILY": "' || event_type || '", "role": "user ' || user_id || '", "SCOPE": ""}}, "operators": ["rate", "bogus"], "q_lab": "' || CASE WHEN event_id % 4 = 0 THEN '' ELSE 'lab' END ||
    '", "queries": ["a ' || user_id || '", {{"query": "b"}}, ""], "D+": ["FAMILY"], "contradicted_dimensions": "ROLE; EVENT", "structural_mismatch": {{"is_mismatch": "' || CASE WHEN event_id % 3 = 0 THEN 'yes' ELSE 'no' END ||
    '"}}, "mode": "' || CASE WHEN event_id % 2 = 0 THEN 'refine' ELSE 'jump' END || '", "operator": "' || CASE WHEN event_id % 5 = 0 THEN 'schedule' ELSE 'dance' END || '", "dimension": "role", "patch": "p", "preserve": ["FAMILY", "SCOPE"], "decisive_dimensions": ["role", "Family", "role", "other"], "substring": ' ||
    CASE WHEN event_id % 7 = 0 THEN 'null' ELSE '"ev"' END || '}}' AS doc FROM events)""")
# the JSON found in an answer: the whole cleaned text, else everything between the first and the last brace
fragment("docs_found", """SELECT *, CASE WHEN json_valid(c) THEN c WHEN json_valid(b) THEN b END AS js FROM (SELECT *, regexp_extract(c, '(?s)\\{.*\\}') AS b FROM (
    SELECT *, trim(trim(regexp_replace(raw, '(?is)<think>.*?</think>', '', 'g'), chr(10) || ' '), '`') AS c FROM outs))""")
FOUND = "(js IS NOT NULL)"


def parsed(t, lists=False):
    return mj.parsed(outputs(t), lists=lists)


@query("P1_tolerant_parse", f"SELECT event_id, {FOUND} AS parse_ok, js->>'$.query' AS query FROM docs_found")
def p1(t):
    return parsed(t).select("event_id", "parse_ok", F.try_variant_get("doc", "$.query", "string").alias("query"))


PLAIN = "CASE WHEN kind = 4 THEN trim(regexp_replace(trim(regexp_replace(raw, '\\s+', ' ', 'g')), '\"+$', '')) ELSE 'no json here' END"


@query("P2_hypothesis_parse", f"""SELECT event_id, {FOUND} AS hypothesis_ok, CASE WHEN {FOUND} THEN event_type ELSE 'UNRESOLVED' END AS family, CASE WHEN {FOUND} THEN 'user ' || user_id ELSE 'UNRESOLVED' END AS role,
    'UNRESOLVED' AS scope, CASE WHEN {FOUND} THEN 'rate' ELSE 'direct_label' END AS operators, CASE WHEN {FOUND} THEN js->>'$.query' ELSE {PLAIN} END AS retrieval_query FROM docs_found""")
def p2(t):
    h = mj.hypothesis("raw_output", F.lit("fallback"))
    rows = parsed(t).select("event_id", *[c.alias(n) for n, c in h.items()])
    return rows.select("event_id", "hypothesis_ok", *[F.col("dimensions")[d].alias(d.lower()) for d in ("FAMILY", "ROLE", "SCOPE")],
                       F.array_join("operators", ",").alias("operators"), "retrieval_query")


@query("P3_query_description", f"SELECT event_id, CASE WHEN {FOUND} THEN js->>'$.query' ELSE {PLAIN} END AS query, {FOUND} AS named FROM docs_found")
def p3(t):
    text, named = mj.query_description("raw_output", F.lit("fallback"))
    return parsed(t).select("event_id", text.alias("query"), named.alias("named"))


@query("P4_surface_parse", f"""SELECT event_id, g AS grounding, CASE WHEN {FOUND} AND js->>'$.q_lab' <> '' THEN js->>'$.q_lab' ELSE array_to_string({sql_tokens('g')}, ' ') END AS q_lab, g AS q_def, {FOUND} AS surface_ok
    FROM (SELECT *, CASE WHEN {FOUND} THEN js->>'$.query' ELSE {PLAIN} END AS g FROM docs_found)""")
def p4(t):
    return parsed(t).select("event_id", *[c.alias(n) for n, c in mj.surfaces("raw_output", F.lit("fallback")).items()])


@query("P5_decomposed_queries", f"SELECT event_id, CASE WHEN {FOUND} THEN 'a ' || user_id || '|b|fallback' WHEN kind = 4 THEN 'rate|bogus|fallback' ELSE {PLAIN} || '|fallback|fallback' END AS queries FROM docs_found")
def p5(t):
    return parsed(t, lists=True).select("event_id", F.array_join(mj.decomposed_queries("raw_output", F.lit("fallback"), 3), "|").alias("queries"))


@query("P6_feedback_parse", f"SELECT event_id, CASE WHEN {FOUND} THEN 'FAMILY' ELSE '' END AS supported, CASE WHEN {FOUND} THEN 'ROLE,EVENT' ELSE '' END AS contradicted, '' AS unresolved, {FOUND} AND event_id % 3 = 0 AS is_mismatch FROM docs_found")
def p6(t):
    f = mj.feedback()
    return parsed(t).select("event_id", *[F.array_join(f[n], ",").alias(n) for n in ("supported", "contradicted", "unresolved")],
                            F.coalesce(f["is_mismatch"], F.lit(False)).alias("is_mismatch"))


@query("P7_directive_parse", f"""SELECT event_id, CASE WHEN {FOUND} AND event_id % 2 = 0 THEN 'REFINE' ELSE 'BRANCH' END AS mode, CASE WHEN {FOUND} AND event_id % 5 = 0 THEN 'schedule' ELSE 'direct_label' END AS operator,
    CASE WHEN {FOUND} THEN 'ROLE' ELSE '' END AS target_dimension, CASE WHEN {FOUND} THEN 'p' ELSE '' END AS semantic_patch, CASE WHEN {FOUND} THEN 'FAMILY,SCOPE' ELSE '' END AS preserve, '' AS rationale FROM docs_found""")
def p7(t):
    d = mj.directive()
    d["preserve"] = F.array_join(d["preserve"], ",")
    return parsed(t).select("event_id", *[c.alias(n) for n, c in d.items()])


# verdict calls: one per order, its lines are the window
WORDS = ["support", "contradict", "abstain"]


def verdict_calls(t):
    entry = F.concat(F.lit('{"tag": "'), F.col("l_partkey"), F.lit('", "FAMILY": "'), frames.pick(WORDS, F.concat(F.lit("f"), "l_orderkey", F.lit("-"), "l_partkey")),
                     F.lit('", "ROLE": "'), frames.pick(WORDS, F.concat(F.lit("r"), "l_orderkey", F.lit("-"), "l_partkey")), F.lit('"}'))
    lines = t.lineitem.select("l_orderkey", F.col("l_partkey").cast("string").alias("tag"), "l_linenumber", entry.alias("entry")).distinct()
    rows = lines.groupBy(F.col("l_orderkey").alias("call_id")).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", "entry"))), lambda p: p["entry"]), ", ").alias("body"),
        F.collect_set(F.when(F.col("l_linenumber") < 6, F.col("tag"))).alias("candidate_tags"))
    doc = F.concat(F.lit('{"verdicts": ['), F.col("body"), F.lit("]}"))
    kind = F.col("call_id") % 3
    raw = F.when(kind == 0, doc).when(kind == 1, F.substring(doc, F.lit(1), F.length(doc) - 20)).otherwise("I cannot judge")
    return rows.select("call_id", "candidate_tags", raw.alias("raw_output"))


fragment("call_lines", f"""SELECT DISTINCT l_orderkey AS call_id, l_partkey::VARCHAR AS tag, l_linenumber, {frames.sql_pick(WORDS, "'f' || l_orderkey || '-' || l_partkey")} AS fw, {frames.sql_pick(WORDS, "'r' || l_orderkey || '-' || l_partkey")} AS rw FROM lineitem""")
# cutting 20 characters always breaks the last entry and no other
fragment("call_entries", """SELECT DISTINCT call_id, tag, CASE WHEN call_id % 3 = 0 THEN 'clean' ELSE 'salvaged' END AS parse_mode, fw, rw FROM (
    SELECT *, row_number() OVER (PARTITION BY call_id ORDER BY l_linenumber DESC, '{"tag": "' || tag || '", "FAMILY": "' || fw || '", "ROLE": "' || rw || '"}' DESC) AS from_end FROM call_lines) WHERE (call_id % 3 = 0 OR (call_id % 3 = 1 AND from_end > 1))
    AND (call_id, tag) IN (SELECT call_id, tag FROM call_lines WHERE l_linenumber < 6)""")


@query("P8_verdict_parse", """SELECT call_id, tag, parse_mode, dim, CASE w WHEN 'support' THEN true WHEN 'contradict' THEN false END AS matched FROM (
    SELECT call_id, tag, parse_mode, 'family' AS dim, fw AS w FROM call_entries UNION ALL SELECT call_id, tag, parse_mode, 'role', rw FROM call_entries)""")
def p8(t):
    return mj.verdict_entries(verdict_calls(t), ["FAMILY", "ROLE"])


@query("P8_call_modes", """SELECT call_id, coalesce(m, 'failed') AS parse_mode, coalesce(n, 0) AS n_tags FROM (SELECT DISTINCT l_orderkey AS call_id FROM lineitem) LEFT JOIN (SELECT call_id, max(parse_mode) AS m, count(DISTINCT tag) AS n FROM call_entries GROUP BY call_id) USING (call_id)""")
def p8m(t):
    calls = verdict_calls(t)
    return mj.call_modes(calls, mj.verdict_entries(calls, ["FAMILY", "ROLE"]))


@query("P9_decisive_dimensions", f"SELECT event_id, CASE WHEN {FOUND} THEN 'ROLE,FAMILY' ELSE '' END AS dims FROM docs_found")
def p9(t):
    return parsed(t).select("event_id", F.array_join(mj.decisive_dimensions(["FAMILY", "ROLE", "EVENT"]), ",").alias("dims"))


def selections(t):
    key = F.col("fact_id").cast("string")
    sel = md5_int(F.concat(F.lit("s"), key)) % 12 + 1
    doc = F.concat(F.lit('{"ranked_indices": [3, "2", 201, 3, "x"], "ranked_tags": ["'), (F.col("fact_id") % 7).cast("string"), F.lit('", "1"], "selected_index": '), sel.cast("string"), F.lit("}"))
    return t.customer.select(F.col("c_custkey").alias("fact_id")).select("fact_id", doc.alias("raw_output"))


@query("P10_ranked_selection", f"""WITH c AS (SELECT fact_id, tag, rank FROM rankings WHERE list_id = 1), m AS (
    SELECT fact_id, tag, -1 AS pos FROM c WHERE rank = {sql_md5("'s' || fact_id")} % 12 + 1 UNION ALL SELECT fact_id, tag, CASE rank WHEN 3 THEN 0 ELSE 1 END FROM c WHERE rank IN (2, 3)
    UNION ALL SELECT fact_id, tag, CASE WHEN tag = (fact_id % 7)::VARCHAR THEN 1000000 ELSE 1000001 END FROM c WHERE tag IN ((fact_id % 7)::VARCHAR, '1'))
    SELECT fact_id, tag, row_number() OVER (PARTITION BY fact_id ORDER BY pos, tag) AS model_rank, pos < 0 AS selected FROM (SELECT fact_id, tag, min(pos) AS pos FROM m GROUP BY ALL)""")
def p10(t):
    return mj.ranked_tags(mj.parsed(selections(t)), frames.rankings(t).where("list_id = 1"))


@query("P11_substring_parse", f"SELECT event_id, CASE WHEN {FOUND} THEN js->>'$.substring' END AS substring FROM docs_found")
def p11(t):
    return parsed(t).select("event_id", mj.substring_field().alias("substring"))


LADDER = [(400, 200), (200, 100), (80, 40)]


def _fit(x: str, n: int) -> str:
    return f"CASE WHEN length({x}) <= {n} THEN {x} ELSE rtrim({x}[:{n // 2}]) || ' ... ' || ltrim(right({x}, {n - n // 2})) END"


_SPACE = "trim(regexp_replace(text, '[\\s\\x0b\\x1c-\\x1f\\x{85}\\p{Z}]+', ' ', 'g'))"
_OPT = [f"({_fit('c', a)}) || ' | ' || ({_fit('c', b)})" for a, b in LADDER]


@query("P12_budget_ladder", f"""SELECT conv_id, turn, option, CASE option WHEN 0 THEN {_OPT[0]} WHEN 1 THEN {_OPT[1]} ELSE {_OPT[2]} END AS prompt FROM (SELECT *, CASE WHEN len(regexp_extract_all({_OPT[0]}, '[^ ]+')) <= 60 THEN 0
    WHEN len(regexp_extract_all({_OPT[1]}, '[^ ]+')) <= 60 THEN 1 ELSE 2 END AS option FROM (SELECT conv_id, turn, {_SPACE} AS c FROM conversations))""")
def p12(t):
    from evirank.functions.text import truncate_middle

    def build(a, b):
        return F.concat(truncate_middle("text", a), F.lit(" | "), truncate_middle("text", b))

    out = mj.budgeted_prompt(t.conversations, LADDER, build, 60, lambda p: F.size(F.regexp_extract_all(p, F.lit("[^ ]+"), F.lit(0))))
    return out.select("conv_id", "turn", "option", "prompt")


@query("P13_symbolic_hint", """SELECT fact_id, hyp_idx, concat_ws('. ', 'Contradicted: ' || string_agg(upper(dim), ', ' ORDER BY dim) FILTER (verdict = 'contradict'), 'Supported: ' || string_agg(upper(dim), ', ' ORDER BY dim) FILTER (verdict = 'support')) AS hint FROM feedback GROUP BY ALL""")
def p13(t):
    from evirank.plans.q_agree import Inputs, feedback

    return mj.symbolic_hint(feedback(Inputs(t)))
