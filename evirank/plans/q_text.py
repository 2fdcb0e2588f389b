"""Text and code expressions over the driver tables."""

from pyspark.sql import functions as F

from evirank.functions import codes, text
from evirank.functions.text import md5_int
from evirank.plans.registry import fragment, query, sql_md5, sql_space, sql_tokens

fragment("pairs_text", "SELECT conv_id, turn, role, text FROM conversations")


@query("F1_normalize_space", f"SELECT doc_id, {sql_space('text')} AS clean FROM documents")
def f1(t):
    return t.documents.select("doc_id", text.normalize_space("text").alias("clean"))


@query("F2_tag_prefix", """SELECT p_partkey, 'us-gaap:' || p_name AS tag, p_name AS raw,
    'us-gaap:' || p_name AS again, p_name AS bare FROM part""")
def f2(t):
    tagged = t.part.select("p_partkey", "p_name", text.normalize_tag("p_name", "us-gaap:").alias("tag"))
    return tagged.select(
        "p_partkey", "tag", text.raw_tag("tag", "us-gaap:").alias("raw"),
        text.normalize_tag("tag", "us-gaap:").alias("again"), text.normalize_tag("p_name", "").alias("bare"),
    )


@query("F3_tokenize", f"""SELECT doc_id, len(toks)::BIGINT AS n_tokens, array_to_string(toks, ' ') AS tokens
    FROM (SELECT doc_id, {sql_tokens('text')} AS toks FROM documents)""")
def f3(t):
    toks = t.documents.select("doc_id", text.tokenize("text").alias("toks"))
    return toks.select("doc_id", F.size("toks").cast("bigint").alias("n_tokens"), F.array_join("toks", " ").alias("tokens"))


@query("F4_fold_token", """SELECT token, CASE WHEN length(lower(token)) > 4 AND lower(token) LIKE '%ies' THEN
      lower(token)[:length(token)-3] || 'y' WHEN length(token) > 3 AND lower(token) LIKE '%s'
      AND lower(token) NOT LIKE '%ss' THEN lower(token)[:length(token)-1] ELSE lower(token) END AS folded, n FROM (
    SELECT token, count(*) AS n FROM (SELECT unnest(regexp_extract_all(text, '[A-Za-z0-9]+')) AS token FROM documents)
    GROUP BY token)""")
def f4(t):
    words = t.documents.select(F.explode(F.regexp_extract_all("text", F.lit(text.TOKEN), F.lit(0))).alias("token"))
    return words.groupBy("token").agg(F.count(F.lit(1)).alias("n")).select(
        "token", text.fold_token(F.col("token")).alias("folded"), "n")


def _sql_unescape(x: str) -> str:
    """The references that the driver's pages hold; a cut-off `&amp` counts as well."""
    for name, code in (("copy", 0xA9), ("middot", 0xB7), ("quot", 0x22)):
        x = f"replace({x}, '&{name};', chr({code}))"
    return f"regexp_replace({x}, '&amp;?', '&', 'g')"


SQL_BLOCK = r"(?is)<!--.*?-->|<script\b[^>]*>.*?</script\s*>|<style\b[^>]*>.*?</style\s*>"


def sql_visible(x: str) -> str:
    keep = (
        "CASE WHEN b LIKE '<!--%' THEN ' ' ELSE ' ' || translate(regexp_replace(regexp_replace(b, '^<[^>]*>', ''), "
        "'</[a-zA-Z]+\\s*>$', ''), '<>&', '\ue001\ue002\ue003') || ' ' END"
    )
    joined = (
        f"array_to_string(list_transform(list_zip(string_split_regex({x}, '{SQL_BLOCK}'), "
        f"list_transform(regexp_extract_all({x}, '{SQL_BLOCK}'), lambda b: {keep})), "
        "lambda p: coalesce(p[1], '') || coalesce(p[2], '')), '')"
    )
    stripped = f"regexp_replace(regexp_replace({joined}, '(?s)<![^>]*>|<\\?[^>]*>', ' ', 'g'), '</?[A-Za-z][^>]*>', ' ', 'g')"
    return sql_space(f"translate({_sql_unescape(stripped)}, '\ue001\ue002\ue003', '<>&')")


@query("F5_html_visible_text", f"SELECT page_id, {sql_visible('html')} AS visible FROM pages")
def f5(t):
    return t.pages.select("page_id", text.html_to_visible_text("html").alias("visible"))


@query("F6_truncate_middle", f"""SELECT doc_id, CASE WHEN length(c) <= 200 THEN c ELSE
    rtrim(c[:100]) || ' ... ' || ltrim(right(c, 100)) END AS short
    FROM (SELECT doc_id, {sql_space('text')} AS c FROM documents)""")
def f6(t):
    return t.documents.select("doc_id", text.truncate_middle("text", 200).alias("short"))


# Codes for the driver tables: a letter and digits derived from the part key, dotted after three characters.
PART_CODE = (
    "concat(substr('CDRSTVWXYZOPQABEFGHIJKLMNU', cast(p_partkey % 26 as int) + 1, 1), lpad(cast(p_partkey % 100 as string), 2, '0'),"
    " case when p_partkey % 3 = 0 then '' else '.' end, cast(p_size as string))"
)
SQL_CODE = (
    "(substr('CDRSTVWXYZOPQABEFGHIJKLMNU', (p_partkey % 26 + 1)::INT, 1) || lpad((p_partkey % 100)::VARCHAR, 2, '0') || "
    "CASE WHEN p_partkey % 3 = 0 THEN '' ELSE '.' END || p_size::VARCHAR)"
)
SQL_DOTTED = "CASE WHEN length(raw) <= 3 THEN raw ELSE raw[:3] || '.' || raw[4:] END"
SQL_ROLE = """CASE WHEN raw[:1] = 'C' OR raw[:3] IN ('D00','D01','D02','D03','D04','D05','D06','D07','D09') THEN 'neoplasm'
    WHEN raw[:1] = 'R' THEN 'symptom-sign-abnormal-finding' WHEN raw[:1] IN ('S','T') THEN 'injury-poisoning'
    WHEN raw[:1] IN ('V','W','X','Y') THEN 'external-cause' WHEN raw[:1] = 'Z' THEN 'health-status-factor'
    WHEN raw[:1] = 'O' THEN 'pregnancy-related' WHEN raw[:1] = 'P' THEN 'perinatal'
    WHEN raw[:1] = 'Q' THEN 'congenital' ELSE 'disease-disorder' END"""
fragment("coded_parts", f"SELECT p_partkey, p_name, p_type, replace(upper({SQL_CODE}), '.', '') AS raw FROM part")


@query("F7_code_normalize", f"SELECT p_partkey, raw, {SQL_DOTTED} AS dotted FROM coded_parts")
def f7(t):
    return t.part.select(
        "p_partkey", codes.normalize_code(F.expr(PART_CODE)).alias("raw"), codes.dotted_code(F.expr(PART_CODE)).alias("dotted"))


@query("F8_code_role", f"SELECT {SQL_ROLE} AS role, count(*) AS n FROM coded_parts GROUP BY 1")
def f8(t):
    return t.part.groupBy(codes.role_for_code(F.expr(PART_CODE)).alias("role")).agg(F.count(F.lit(1)).alias("n"))


PHRASES = ["routine healing", "delayed healing", "nonunion", "malunion", "subsequent", "initial", "sequela",
           "unspecified", "not applicable", "fetus 1", "stage 2", "other"]
fragment("phrased", "SELECT event_id, event_type || ' ' || ["
         + ", ".join(f"'{p}'" for p in PHRASES) + f"][{sql_md5('event_id::VARCHAR')} % 12 + 1] AS phrase FROM events")


@query("F9_phrase_category", "SELECT category, count(*) AS n FROM (SELECT CASE "
       + " ".join(f"WHEN phrase LIKE '%{cue}%' THEN '{name}'" for cue, name in codes.TEMPORAL_CUES)
       + " ELSE 'other-extension' END AS category FROM phrased) GROUP BY 1")
def f9(t):
    pick = F.element_at(F.array(*map(F.lit, PHRASES)), (md5_int(F.col("event_id").cast("string")) % 12 + 1).cast("int"))
    phrase = F.concat_ws(" ", "event_type", pick)
    return t.events.groupBy(codes.temporal_category(phrase).alias("category")).agg(F.count(F.lit(1)).alias("n"))


@query("F10_retrieval_text", """SELECT p_partkey, array_to_string(list_filter([p_name, nullif(p_brand, 'Brand#7'), p_type],
    lambda x: x IS NOT NULL), '. ') AS retrieval_text FROM part""")
def f10(t):
    brand = F.nullif("p_brand", F.lit("Brand#7"))
    return t.part.select("p_partkey", text.retrieval_text("p_name", brand, "p_type").alias("retrieval_text"))


@query("F11_label_and_href", f"""SELECT page_id, {sql_space("replace(url, ',', ' ')")} AS label,
    regexp_extract('x.xsd#us-gaap_' || page_id, '#us-gaap_(.*)$', 1) AS tag,
    string_split('xbrli:' || lang, ':')[-1] AS type_name FROM (SELECT *, regexp_extract(url, '/([a-z]{{2}})/', 1) AS lang FROM pages)""")
def f11(t):
    lang = F.regexp_extract("url", "/([a-z]{2})/", 1)
    return t.pages.select(
        "page_id", text.clean_label("url").alias("label"),
        text.tag_from_href(F.concat(F.lit("x.xsd#us-gaap_"), "page_id")).alias("tag"),
        text.strip_namespace(F.concat(F.lit("xbrli:"), lang)).alias("type_name"),
    )


@query("F12_queries", f"""SELECT conv_id, turn, {sql_space("role || ' ' || conv_id || ' ' || text")} AS direct,
    {sql_space("role || ' ' || conv_id || ' ' || CASE WHEN turn % 2 = 0 THEN text ELSE role || ' ' || conv_id || ' ' || text END")} AS grounded
    FROM conversations""")
def f12(t):
    key = F.col("conv_id").cast("string")
    grounding = F.when(F.col("turn") % 2 == 0, F.col("text")).otherwise(F.lit("  "))
    return t.conversations.select(
        "conv_id", "turn", text.direct_query("role", key, "text").alias("direct"),
        text.grounding_query("role", key, "text", grounding).alias("grounded"),
    )


@query("F13_gold_query", """SELECT l_orderkey, l_linenumber, coalesce(p_partkey::VARCHAR || ' ' || p_name || ' ' || p_brand,
    l_returnflag || ' ' || l_linestatus) AS query FROM lineitem LEFT JOIN part ON l_partkey = p_partkey AND p_size > 10""")
def f13(t):
    from evirank.operators.corpus import gold_queries

    facts = t.lineitem.select(
        "l_orderkey", "l_linenumber", F.col("l_partkey").cast("string").alias("gold_tag"),
        text.direct_query("l_returnflag", "l_linestatus", F.lit("")).alias("direct_query"))
    concepts = t.part.where("p_size > 10").select(
        F.col("p_partkey").cast("string").alias("tag"), F.col("p_name").alias("standard_label"),
        F.col("p_brand").alias("documentation"))
    return gold_queries(facts, concepts, "").select("l_orderkey", "l_linenumber", "query")


@query("F14_serialize_evidence", f"""SELECT conv_id, turn, 'Entity value: ' || conv_id || chr(10) || 'Datatype: ' || role ||
    chr(10) || 'Input type: ' || CASE WHEN turn % 2 = 0 THEN 'table' ELSE 'text' END ||
    CASE WHEN turn > 0 THEN chr(10) || 'Row context: ' || turn ELSE '' END || chr(10) || 'Source context:' || chr(10) ||
    CASE WHEN length(c) <= 120 THEN c ELSE rtrim(c[:60]) || ' ... ' || ltrim(right(c, 60)) END AS evidence
    FROM (SELECT *, {sql_space('text')} AS c FROM conversations)""")
def f14(t):
    return t.conversations.select(
        "conv_id", "turn",
        text.serialize_evidence(
            F.col("conv_id").cast("string"), "role", F.when(F.col("turn") % 2 == 0, "table").otherwise("text"),
            F.when(F.col("turn") > 0, F.col("turn").cast("string")), F.lit(""), "text", 120).alias("evidence"),
    )


fragment("dims_of_parts", """SELECT p_partkey, p_size, p_type,
    [p_name, 'UNRESOLVED', p_brand, CASE WHEN p_size % 2 = 0 THEN p_type ELSE '' END, 'unresolved', p_size::VARCHAR] AS vals FROM part""")


@query("F15_render", f"""SELECT p_partkey,
    CASE WHEN p_size % 5 = 0 THEN 'size ' || p_size ELSE array_to_string(r, ' ') END AS def_query,
    nullif(array_to_string(flatten(list_transform(r, lambda v: {sql_tokens('v')})), ' '), '') AS lab_query
    FROM (SELECT *, list_filter(vals, lambda v: v <> '' AND lower(v) <> 'unresolved') AS r FROM dims_of_parts)""")
def f15(t):
    dims = F.create_map(
        F.lit("FAMILY"), F.col("p_name"), F.lit("ROLE"), F.lit("UNRESOLVED"), F.lit("EVENT"), F.col("p_brand"),
        F.lit("QUALIFIER"), F.when(F.col("p_size") % 2 == 0, F.col("p_type")).otherwise(""),
        F.lit("SCOPE"), F.lit("unresolved"), F.lit("TEMPORAL"), F.col("p_size").cast("string"))
    given = F.when(F.col("p_size") % 5 == 0, F.concat(F.lit("size "), "p_size")).otherwise("")
    return t.part.select("p_partkey", "p_size", given.alias("given"), dims.alias("dims")).select(
        "p_partkey", text.render_definition("given", "dims").alias("def_query"), text.render_label("dims").alias("lab_query"))


# Two offset ranges per document, the second one malformed for every fourth document.
POSITION = ("concat(doc_id % 40, ' ', doc_id % 40 + 15, ';', case when doc_id % 4 = 0 then 'x 9' else"
                  " concat(60 + doc_id % 300, ' ', 90 + doc_id % 300) end)")
fragment("ranges", """SELECT doc_id, unnest(list_concat([{'s': doc_id % 40, 'e': doc_id % 40 + 15}],
    CASE WHEN doc_id % 4 = 0 THEN [] ELSE [{'s': 60 + doc_id % 300, 'e': 90 + doc_id % 300}] END)) AS r FROM documents""")


@query("F16_parse_ranges", "SELECT doc_id, r.s AS s, r.e AS e FROM ranges")
def f16(t):
    return t.documents.select("doc_id", F.inline(codes.parse_ranges(F.expr(POSITION))))


@query("F17_extract_span", f"""SELECT doc_id, {sql_space("string_agg(CASE WHEN r.e <= length(text) THEN text[r.s+1:r.e] END, ' ' ORDER BY r.s)")} AS span
    FROM ranges JOIN documents USING (doc_id) GROUP BY doc_id""")
def f17(t):
    rows = t.documents.select("doc_id", "text", codes.parse_ranges(F.expr(POSITION)).alias("ranges"))
    return rows.select("doc_id", codes.extract_span("text", "ranges").alias("span"))


_KEEP = "regexp_replace(regexp_replace(text, '\\.(\\p{Lu})\\.', '.\\1\ue001', 'g'), '([.\ue001])(\\p{Lu})\\.', '\\1\\2\ue001', 'g')"
_MARK = ("regexp_replace(regexp_replace(" + _KEEP + ", '([.!?])([\\s\\x0b\\p{Z}]*)([\\p{Lu}\\p{Nd}\"¿¡])', '\\1\ue000\\2\\3', 'g'),"
         " '([.!?])([\\s\\x0b\\p{Z}]*)\\z', '\\1\ue000\\2', 'g')")
fragment("pieces", f"""SELECT doc_id, unnest(p) AS body, generate_subscripts(p, 1) AS piece FROM (
    SELECT doc_id, list_transform(string_split({_MARK}, '\ue000'), lambda x: replace(x, '\ue001', '.')) AS p FROM documents)""")
fragment("sentences", f"""SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY piece) - 1)::BIGINT AS idx,
    span_end - length(body) AS span_start, span_end, sentence FROM (
      SELECT *, (sum(length(body)) OVER (PARTITION BY doc_id ORDER BY piece))::BIGINT AS span_end, {sql_space('body')} AS sentence
      FROM pieces) WHERE sentence <> ''""")


@query("F18_sentence_spans", "SELECT doc_id, idx, span_start, span_end, sentence FROM sentences")
def f18(t):
    return codes.sentence_spans(t.documents, "doc_id", "text").withColumn("idx", F.col("idx").cast("bigint"))


_BREAKS = r"\n\x0B\f\r\x1C-\x1E\x{85}\x{2028}\x{2029}"
fragment("doc_lines", f"""SELECT doc_id, idx, span_start, span_start + length(line) AS span_end, line FROM (
    SELECT doc_id, (i - 1)::BIGINT AS idx, regexp_replace(body, '[\\r\\n]+$', '') AS line,
      (coalesce(sum(length(body)) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::BIGINT AS span_start
    FROM (SELECT doc_id, unnest(l) AS body, generate_subscripts(l, 1) AS i
          FROM (SELECT doc_id, regexp_extract_all(text, '[^{_BREAKS}]*(?:\\r\\n|[{_BREAKS}])|[^{_BREAKS}]+') AS l FROM documents)))""")


@query("F19_line_spans", "SELECT doc_id, idx, span_start, span_end, line FROM doc_lines")
def f19(t):
    return codes.line_spans(t.documents, "doc_id", "text").withColumn("idx", F.col("idx").cast("bigint"))


@query("F20_substring_check", f"""SELECT page_id, contains(v, {sql_space("regexp_extract(url, '//([^/]+)/', 1)")}) AS host_found,
    tail <> '' AND contains(v, tail) AS tail_found
    FROM (SELECT page_id, url, {sql_space("regexp_extract(url, '([^/?#]+)([?#].*)?$', 1)")} AS tail, {sql_visible('html')} AS v FROM pages)""")
def f20(t):
    rows = t.pages.select("page_id", "url", text.html_to_visible_text("html").alias("visible"))
    host, tail = F.regexp_extract("url", "//([^/]+)/", 1), F.regexp_extract("url", "([^/?#]+)([?#].*)?$", 1)
    return rows.select("page_id", text.contains_normalized(host, "visible").alias("host_found"),
                       text.contains_normalized(tail, "visible").alias("tail_found"))


@query("F21_cue_features", f"""SELECT conv_id, turn, CASE WHEN role = 'user' THEN 1.0 ELSE 0.0 END AS is_text,
    CASE WHEN len(list_distinct(toks)) < 12 THEN 1.0 ELSE 0.0 END AS token_count_lt_12,
    CASE WHEN len(list_distinct(toks)) > 30 THEN 1.0 ELSE 0.0 END AS token_count_gt_30,
    CASE WHEN list_has_any(toks, ['date', 'year', 'period', 'current', 'prior', 'les', 'la']) THEN 1.0 ELSE 0.0 END AS has_cue,
    (turn + 1)::DOUBLE AS round_idx
    FROM (SELECT conv_id, turn, role, {sql_tokens('text')} AS toks FROM conversations)""")
def f21(t):
    from evirank.operators.rounds import cue_features

    rows = t.conversations.withColumn("round_idx", F.col("turn") + 1)
    cues = {"has_cue": ["date", "year", "period", "current", "prior", "les", "la"]}
    flags = cue_features(rows, text="text", modality=F.when(F.col("role") == "user", "text"), cues=cues)
    return flags.select("conv_id", "turn", "is_text", "token_count_lt_12", "token_count_gt_30", "has_cue",
                        F.col("round_idx").cast("double").alias("round_idx"))


@query("F22_evidence_profile", """SELECT conv_id, turn, CASE WHEN turn % 2 = 0 THEN 'table' ELSE 'text' END AS input_type, role AS datatype,
    turn > 0 AS has_row_context, false AS has_column_context FROM conversations""")
def f22(t):
    from evirank.operators.rounds import evidence_profile

    rows = t.conversations.select(
        "conv_id", "turn", F.when(F.col("turn") % 2 == 0, "table").otherwise("text").alias("input_type"),
        F.col("role").alias("entity_type"), F.when(F.col("turn") > 0, F.col("turn").cast("string")).alias("row_context"),
        F.lit("").alias("column_context"), F.col("text").alias("query_context"))
    return rows.select("conv_id", "turn", evidence_profile(160).alias("p")).select(
        "conv_id", "turn", "p.input_type", "p.datatype", "p.has_row_context", "p.has_column_context")
