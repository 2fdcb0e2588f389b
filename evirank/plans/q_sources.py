"""Readers, sinks, corpus builds, quality checks and streams. Files are written by Spark from the driver tables first."""

import os
import uuid

from pyspark.sql import functions as F

from evirank.domain import ACCOUNTING_VOCABULARY
from evirank.functions import codes
from evirank.functions.text import md5_int, normalize_space
from evirank.operators import agree, corpus, fuse, metrics, quality
from evirank.plans import frames, q_rounds, q_sampling
from evirank.plans.q_fuse import calls
from evirank.plans.q_rounds import loci, part_tree
from evirank.plans.q_text import PART_CODE, SQL_ROLE, sql_visible
from evirank.plans.registry import fragment, query, sql_md5, sql_space
from evirank.sources import readers, sinks
from evirank.streaming import ingest


def at(t, name):
    return os.path.join(sinks.scratch(t.spark), name)


@query("S1_jsonl_scan", "SELECT event_id, event_type, value FROM events")
def s1(t):
    path = sinks.jsonl(t.events.select("event_id", "event_type", "value"), at(t, "events"))
    return readers.jsonl(t.spark, path, "event_id bigint, event_type string, value double")


def raw_facts(t):
    fields = F.struct(F.nullif(F.col("page_id") % 3, F.lit(0)).cast("string").alias("numeric_entity"), F.lit("").alias("entity"),
                      F.concat(F.lit(" v "), "page_id").alias("value"), F.lit("monetary").alias("type"), F.col("html").alias("original_context"))
    as_text = F.to_json(fields)
    return t.pages.select(
        F.col("page_id").alias("example_idx"), (F.col("page_id") % 9).cast("string").alias("context_id"), F.lit(" table ").alias("input_type"),
        F.when(F.col("page_id") % 2 == 0, as_text).alias("input"), F.when(F.col("page_id") % 2 == 1, fields).alias("input_fields"),
        F.array(F.lit(""), F.concat(F.lit("Tag"), "page_id"), F.lit("us-gaap:Cash")).alias("ground_truth_concepts"))


@query("S2_facts_load", f"""SELECT page_id AS fact_id, 'table' AS input_type, CASE WHEN page_id % 3 <> 0 THEN (page_id % 3)::VARCHAR ELSE 'v ' || page_id END AS entity, 'monetary' AS entity_type,
    {sql_visible(sql_space('html'))} AS query_context, 'us-gaap:Tag' || page_id || ',us-gaap:Cash' AS gold_tags FROM pages""")
def s2(t):
    path = sinks.jsonl(raw_facts(t), at(t, "facts"))
    rows = readers.facts(t.spark, path, "us-gaap:")
    return rows.select("fact_id", "input_type", "entity", "entity_type", "query_context", F.array_join("gold_tags", ",").alias("gold_tags"))


@query("S3_concepts_load", """SELECT doc_idx, 'us-gaap:' || tag AS tag, tag AS raw_tag, entity_type, standard_label, documentation, 'r1' AS refs FROM concepts""")
def s3(t):
    rows = frames.concepts(t).select("doc_idx", "tag", F.col("entity_type").alias("type"), F.concat(F.lit(" "), "standard_label").alias("standard_label"),
                                     "documentation", F.array(F.lit(" r1"), F.lit("")).alias("references"), "retrieval_text")
    got = readers.concepts(t.spark, sinks.jsonl(rows, at(t, "concepts")), "us-gaap:")
    return got.select("doc_idx", "tag", "raw_tag", "entity_type", "standard_label", "documentation", F.array_join("references", ",").alias("refs"))


@query("S4_parquet_samples", "SELECT o_orderkey, o_custkey, 'train' AS split, o_orderkey AS source_sample_idx FROM orders")
def s4(t):
    rows = readers.samples(t.spark, f"{t.folder}/orders.parquet", "train", "o_orderkey")
    return rows.select("o_orderkey", "o_custkey", "split", "source_sample_idx")


@query("S5_split_sink", """SELECT o_orderkey, o_custkey, split, split AS id_split, n FROM (SELECT o_orderkey, o_custkey, CASE WHEN o_orderkey % 5 = 0 THEN 'test' ELSE 'train' END AS split, count(*) OVER (PARTITION BY o_orderkey % 5 = 0) AS n FROM orders)""")
def s5(t):
    rows = t.orders.withColumn("split", F.when(F.col("o_orderkey") % 5 == 0, "test").otherwise("train"))
    report = rows.groupBy("split").agg(F.count(F.lit(1)).alias("n"))
    paths = sinks.split_files(rows.select("split", "o_orderkey", "o_custkey"), report, at(t, "split"), "o_orderkey")
    ids = t.spark.read.option("header", "true").schema("id_split string, o_orderkey bigint").csv(paths["ids"], enforceSchema=True)
    samples = t.spark.read.schema("o_orderkey bigint, o_custkey bigint, split string").parquet(paths["samples"])
    return samples.join(ids, "o_orderkey", "full").join(report, "split")


def code_lines(t):
    return t.part.select(F.concat_ws("\t", F.expr(PART_CODE), F.concat(F.lit("es "), "p_name"), F.concat(F.lit(" "), "p_name")).alias("value"))


@query("S6_tsv_scan", "SELECT raw, 'es ' || p_name AS es_desc, p_name AS en_desc FROM coded_parts")
def s6(t):
    return readers.valid_codes(t.spark, sinks.lines(code_lines(t), at(t, "codes"))).drop("display")


@query("S7_fixed_width", "SELECT 'K' || p_partkey AS raw, p_name AS desc FROM part")
def s7(t):
    rows = t.part.select(F.concat(F.rpad(F.concat(F.lit("k"), "p_partkey"), 8, " "), "p_name").alias("value"))
    return readers.billable_codes(t.spark, sinks.lines(rows, at(t, "billable")))


@query("S8_whole_files", """SELECT line, count(*) AS n FROM (SELECT unnest(string_split(text, chr(10))) AS line FROM (SELECT string_agg(text, '' ORDER BY turn, text) AS text FROM conversations GROUP BY conv_id)) GROUP BY line""")
def s8(t):
    rows = t.conversations.groupBy("conv_id").agg(F.array_join(F.transform(
        F.array_sort(F.collect_list(F.struct("turn", "text"))), lambda p: p["text"]), "").alias("value"))
    files = readers.text_files(t.spark, sinks.lines(rows.select("value"), at(t, "texts")))
    # which rows share a file depends on the writer, the lines in all files don't; the last line break of a file ends its last row
    lines = files.select(F.explode(F.split(F.regexp_replace("text", r"\n$", ""), "\n", -1)).alias("line"))
    return lines.groupBy("line").agg(F.count(F.lit(1)).alias("n"))


@query("S9_xml_elements", "SELECT 'C' || p_partkey AS tag, p_type AS type FROM part")
def s9(t):
    rows = t.part.select(F.floor(F.col("p_partkey") / 1000).alias("doc"), F.format_string(
        '<xs:element name="C%d" type="x:%s"><xs:note>d</xs:note></xs:element>', "p_partkey", "p_type").alias("value"))
    path = sinks.documents(rows, at(t, "schema"), "doc", "value", '<xs:schema xmlns:xs="s">', "</xs:schema>")
    return readers.xml_elements(t.spark, path)


def linkbase(t, kind, resources):
    """One link block per thousand parts: a locator, its resources in order, an arc to each resource."""
    loc = F.format_string('<link:loc xlink:label="l%d" xlink:href="f.xsd#us-gaap_C%d"/>', "p_partkey", "p_partkey")
    res = F.concat(*[F.format_string(f'<link:{kind} xlink:label="r{i}_%d"%s</link:{kind}>', "p_partkey", body) for i, body in enumerate(resources)])
    arcs = F.concat(*[F.format_string(f'<link:{kind}Arc xlink:from="l%d" xlink:to="r{i}_%d"/>', "p_partkey", "p_partkey") for i in range(len(resources))])
    rows = t.part.select(F.floor(F.col("p_partkey") / 1000).alias("doc"), F.concat(loc, res, arcs).alias("value"))
    head = f'<link:linkbase xmlns:link="l" xmlns:xlink="x" xmlns:ref="r" xmlns:codification-part="c"><link:{kind}Link>'
    return sinks.documents(rows, at(t, kind), "doc", "value", head, f"</link:{kind}Link></link:linkbase>")


@query("S10_label_linkbase", "SELECT 'C' || p_partkey AS tag, p_name || ' 1' AS label FROM part")
def s10(t):
    resources = [F.lit(' xlink:role="terse">T'), F.concat(F.lit(' xlink:role="label"> '), "p_name", F.lit(" 1")), F.lit(' xlink:role="label">later')]
    return readers.label_linkbase(t.spark, linkbase(t, "label", resources), "label")


@query("S11_reference_linkbase", "SELECT 'C' || p_partkey AS tag, CASE WHEN p_size % 2 = 0 THEN 'ASC 310-10-45-2' ELSE 'FASB 45 2' END || '|tail9' AS refs FROM part")
def s11(t):
    topic = F.when(F.col("p_size") % 2 == 0, "<codification-part:Topic>310</codification-part:Topic>").otherwise("")
    first = F.concat(F.lit("><ref:Name>FASB</ref:Name>"), topic, F.lit("<codification-part:SubTopic>10</codification-part:SubTopic><ref:Section>45</ref:Section><ref:Paragraph>2</ref:Paragraph>"))
    second = F.lit("><ref:Name>FASB</ref:Name><codification-part:URI>http://x/y/tail9/</codification-part:URI>")
    got = readers.reference_linkbase(t.spark, linkbase(t, "reference", [first, second]))
    return got.select("tag", F.array_join("references", "|").alias("refs"))


@query("S12_delimited_sinks", "SELECT p_partkey, p_name, p_size::BIGINT AS p_size FROM part")
def s12(t):
    rows = t.part.select("p_partkey", "p_name", "p_size")
    path = sinks.delimited(rows, at(t, "parts"), "\t")
    return t.spark.read.option("header", "true").option("sep", "\t").schema("p_partkey bigint, p_name string, p_size int").csv(path)


def traces(t):
    """Nested records of a customer: one round per list, the fourth marked as skipped for every third customer."""
    cands = frames.rankings(t).groupBy("fact_id", "list_id", "hyp_idx", "rendering").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("rank", "tag", "score"))), lambda c: F.struct(
            c["rank"].alias("rank"), c["tag"].alias("tag"), c["score"].alias("bm25_score"), c["score"].alias("retrieval_score"))).alias("candidates"))
    skipped = (F.col("list_id") == 4) & (F.col("fact_id") % 3 == 0)
    rounds = F.struct(F.col("list_id").alias("round"), F.col("hyp_idx").alias("hypothesis_idx"), "rendering", skipped.alias("label_render_skipped"), "candidates")
    return cands.groupBy(F.col("fact_id").alias("example_idx")).agg(F.sort_array(F.collect_list(rounds)).alias("rounds"))


@query("S13_trace_explode", "SELECT fact_id, list_id, hyp_idx, rendering, rank, tag, score AS bm25_score FROM rankings WHERE NOT (list_id = 4 AND fact_id % 3 = 0)")
def s13(t):
    path = sinks.jsonl(traces(t), at(t, "traces"))
    return readers.trace_rankings(readers.jsonl(t.spark, path, readers.TRACES)).select("fact_id", "list_id", "hyp_idx", "rendering", "rank", "tag", "bm25_score")


@query("S14_replay_check", """SELECT count(*) AS n, count(*) FILTER (a.gr IS DISTINCT FROM b.gr) AS mismatches, round(avg((a.gr IS DISTINCT FROM b.gr)::INT), 6) AS mismatch_rate FROM (SELECT fact_id, gold_rank AS gr FROM list_ranks WHERE list_id = 1) a
    FULL JOIN (SELECT fact_id, CASE WHEN gold_rank <= 5 THEN gold_rank END AS gr FROM list_ranks WHERE list_id = 1) b USING (fact_id)""")
def s14(t):
    ranks = metrics.gold_ranks(frames.rankings(t).where("list_id = 1"), frames.gold(t), ["fact_id"]).withColumn("slot", F.lit(1))
    logged = ranks.withColumn("gold_rank", F.when(F.col("gold_rank") <= 5, F.col("gold_rank")))
    return readers.replay_mismatches(ranks, logged)


def verdict_log(t):
    """Every line logs a verdict; repeated (order supplier, flag, part) keys are later rows of the same key."""
    dims = F.create_map(F.lit("FAMILY"), F.col("l_tax") > 0.04, F.lit("ROLE"), F.when(F.col("l_discount") > 0.02, F.col("l_quantity") > 25))
    return t.lineitem.select(F.struct(F.col("l_orderkey").alias("file"), F.col("l_linenumber").cast("bigint").alias("line")).alias("log_pos"), F.col("l_suppkey").alias("fact_id"),
                             F.when(F.col("l_returnflag") == "R", 1).otherwise(0).alias("hypothesis_idx"), (F.col("l_partkey") % 100).cast("string").alias("tag"), dims.alias("verdict"))


@query("S15_verdict_load", """SELECT fact_id, hyp_idx, tag, dim, CASE dim WHEN 'FAMILY' THEN f ELSE r END AS matched FROM (SELECT fact_id, hyp_idx, tag, arg_max(fam, log_pos) AS f, arg_max(role, log_pos) AS r FROM (
    SELECT {'file': l_orderkey, 'line': l_linenumber} AS log_pos, l_suppkey AS fact_id, CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS hyp_idx, (l_partkey % 100)::VARCHAR AS tag,
      CASE WHEN l_tax > 0.04 THEN 1 ELSE 0 END AS fam, CASE WHEN l_discount > 0.02 THEN (l_quantity > 25)::INT ELSE 2 END AS role FROM lineitem) GROUP BY ALL), (SELECT unnest(['FAMILY', 'ROLE']) AS dim)""".replace("THEN f ELSE r END", "THEN f = 1 ELSE CASE WHEN r < 2 THEN r = 1 END END"))
def s15(t):
    path = sinks.jsonl(verdict_log(t), at(t, "verdicts"))
    return readers.verdict_rows(readers.jsonl(t.spark, path, readers.VERDICTS))


def call_rows(t):
    top = frames.rankings(t).where("rendering = 'def' AND rank <= 10")
    return top.groupBy("fact_id", F.col("hyp_idx").alias("hypothesis_idx")).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("rank", "tag"))), lambda p: p["tag"]).alias("candidate_tags"),
        F.sum("rank").cast("bigint").alias("prompt_tokens"), F.count(F.lit(1)).alias("completion_tokens"))


@query("S16_call_windows", "SELECT fact_id, hyp_idx, rank AS pos, tag FROM rankings WHERE rendering = 'def' AND rank <= 10")
def s16(t):
    return readers.call_windows(readers.jsonl(t.spark, sinks.jsonl(call_rows(t), at(t, "calls")), readers.CALLS))


@query("S16_call_costs", "SELECT count(DISTINCT (fact_id, hyp_idx)) AS n_calls, sum(rank)::BIGINT AS prompt_tokens, count(*) AS completion_tokens, max(rank) AS max_window FROM rankings WHERE rendering = 'def' AND rank <= 10")
def s16c(t):
    return readers.call_costs(call_rows(t))


# --- corpus builds ----------------------------------------------------------------------------------------------------

@query("C1_concept_table", f"""SELECT 'us-gaap:' || p_partkey AS tag, CASE WHEN s.s_suppkey IS NOT NULL AND s.s_suppkey % 2 = 0 THEN 'old' ELSE p_type END AS type, CASE WHEN s.s_suppkey IS NOT NULL THEN {sql_space("replace(s_name, ',', ' ')")} ELSE p_name END AS standard_label,
    CASE WHEN p_size > 25 THEN p_brand ELSE '' END AS documentation FROM part LEFT JOIN supplier s ON s_suppkey = p_partkey""")
def c1(t):
    key = F.col("p_partkey").cast("string").alias("tag")
    elements = t.part.select(key, F.col("p_type").alias("type"))
    labels = t.part.select(key, F.col("p_name").alias("label"))
    docs = t.part.where("p_size > 25").select(key, F.col("p_brand").alias("label"))
    refs = t.part.select(key, F.array(F.lit("ASC")).alias("references"))
    older = t.supplier.select(F.col("s_suppkey").cast("string").alias("tag"), F.col("s_name").alias("standard_label"), F.when(F.col("s_suppkey") % 2 == 0, "old").otherwise("").alias("type"))
    return corpus.concept_table(elements, labels, docs, refs, older, "us-gaap:").select("tag", "type", "standard_label", "documentation")


@query("C2_code_table", f"""SELECT raw || '-' || p_partkey AS key, {SQL_ROLE} AS role, array_to_string(list_filter([notes2, path2, p_name], lambda x: x <> ''), '. ') AS documentation FROM coded_parts JOIN (
    SELECT node AS p_partkey, replace(notes, ';', '; ') AS notes2, path AS path2 FROM walked) USING (p_partkey)""")
def c2(t):
    walked = corpus.walk_up(part_tree(t)).select("node", "labels", "notes")
    rows = t.part.select("p_partkey", "p_name", codes.normalize_code(F.expr(PART_CODE)).alias("code"))
    # the part key keeps equal codes apart
    key = F.concat_ws("-", "code", F.col("p_partkey").cast("string"))
    base = rows.select(key.alias("raw"), F.col("p_name").alias("label"))
    tab = rows.join(walked, rows["p_partkey"] == walked["node"]).select(key.alias("raw"), F.col("notes").alias("inclusions"), F.array().cast("array<string>").alias("inherited"),
                                                                      F.col("labels").alias("path"), F.array().cast("array<string>").alias("excludes"))
    terms = rows.select(key.alias("raw"), F.array("p_name").alias("paths"))
    return corpus.code_table(base, tab, terms).select(F.col("tag").alias("key"), "role", "documentation")


@query("C3_vocabulary_build", f"""SELECT dimension, category, phrase, count(*) AS n FROM (SELECT 'family' AS dimension, p_type AS category, lower(p_type) AS phrase FROM part UNION ALL SELECT 'role', role, replace(role, '-', ' ') FROM (SELECT {SQL_ROLE} AS role FROM coded_parts)
    UNION ALL SELECT 'temporal', CASE WHEN p_name LIKE '%new%' THEN 'initial-encounter' ELSE 'sequela' END, CASE WHEN p_name LIKE '%new%' THEN 'initial encounter' ELSE 'sequela of ' || p_name END FROM part) GROUP BY ALL""")
def c3(t):
    extension = F.when(F.col("p_name").contains("new"), "initial encounter").otherwise(F.concat(F.lit("sequela of "), "p_name"))
    return corpus.vocabulary_table(t.part.select(F.col("p_type").alias("chapter"), codes.role_for_code(F.expr(PART_CODE)).alias("role"), extension.alias("extension")))


# annotations of documents: lines of 15 orders each, their position by quantity and line number
TARGET_FACTS = 500
fragment("doc_annots", """SELECT l_orderkey * 10 + l_linenumber AS row_id, l_orderkey // 15 AS doc_id, l_partkey % 50 AS code, l_returnflag AS label,
    l_quantity::INT * 4 AS s, l_quantity::INT * 4 + 12 AS e, l_linenumber % 3 = 0 AS two FROM lineitem""")
fragment("doc_facts", """SELECT doc_id, code, s, e, two, min(row_id) AS row_id FROM doc_annots WHERE label = 'R' AND code IN (SELECT p_size FROM part WHERE p_brand <> 'Brand#3') GROUP BY ALL""")
fragment("drawn_facts", f"""SELECT *, concat_ws('|', doc_id, s, two, code) AS k FROM doc_facts WHERE doc_id IN (SELECT doc_id FROM (SELECT doc_id, n, sum(n) OVER (ORDER BY md5('3-' || doc_id), doc_id) AS upto FROM (SELECT doc_id, count(*) AS n FROM doc_facts GROUP BY doc_id))
    WHERE upto - n < {TARGET_FACTS})""")
fragment("fact_loci", """WITH c AS (SELECT doc_id, count(*) AS n FROM sentences GROUP BY doc_id), g AS (SELECT doc_id, count(*) AS m FROM targets GROUP BY doc_id),
    r AS (SELECT k, doc_id, s, e FROM drawn_facts UNION ALL SELECT k, doc_id, s + 90, e + 100 FROM drawn_facts WHERE two),
    h AS (SELECT DISTINCT k, doc_id, idx FROM r JOIN sentences USING (doc_id) WHERE s < span_end AND e > span_start),
    l AS (SELECT k, string_agg(idx::VARCHAR, ',' ORDER BY idx) AS indices, count(*) FILTER (line IS NULL) AS outside FROM h LEFT JOIN targets USING (doc_id, idx) GROUP BY k)
    SELECT f.row_id, f.doc_id, code, coalesce(indices, '') AS indices, coalesce(n, 0) = coalesce(m, 0) AS alignment_ok, coalesce(n, 0) = coalesce(m, 0) AND indices IS NOT NULL AND outside = 0 AS ok
    FROM drawn_facts f LEFT JOIN c USING (doc_id) LEFT JOIN g USING (doc_id) LEFT JOIN l USING (k)""")


def facts_built(t):
    start = F.col("l_quantity").cast("int") * 4
    span = lambda s, e: F.concat_ws(" ", s.cast("string"), e.cast("string"))
    rows = t.lineitem.select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("row_id"), F.floor(F.col("l_orderkey") / 15).alias("doc_id"),
                             F.concat_ws(";", span(start, start + 12), F.when(F.col("l_linenumber") % 3 == 0, span(start + 90, start + 112))).alias("position"),
                             (F.col("l_partkey") % 50).alias("code"), F.col("l_returnflag").alias("label"))
    known = t.part.where("p_brand <> 'Brand#3'").select(F.col("p_size").cast("bigint").alias("code")).distinct()
    return corpus.facts_from_annotations(rows, known, "R", *q_rounds.source_and_target(t), TARGET_FACTS, 3)


@query("C4_fact_rows", """SELECT row_id, doc_id, code, indices, alignment_ok, CASE WHEN ok THEN 'aligned_sentence' ELSE 'document' END AS locus_level FROM fact_loci""")
def c4_rows(t):
    return facts_built(t).select("row_id", "doc_id", "code", F.array_join("sentence_indices", ",").alias("indices"), "alignment_ok", "locus_level")


@query("C4_facts_build", """SELECT count(*) AS n_facts, count(DISTINCT doc_id) AS n_documents, avg(alignment_ok::INT) AS alignment_rate, avg(CASE WHEN ok THEN 0 ELSE 1 END) AS fallback_rate FROM fact_loci""")
def c4(t):
    return facts_built(t).agg(F.count(F.lit(1)).alias("n_facts"), F.count_distinct("doc_id").alias("n_documents"), F.avg(F.col("alignment_ok").cast("double")).alias("alignment_rate"),
                              F.avg((F.col("locus_level") == "document").cast("double")).alias("fallback_rate"))


fragment("requests_sql", f"SELECT doc_id, CASE WHEN ok THEN 'sentence' ELSE 'document' END AS scope, CASE WHEN ok THEN {sql_space('sentence_locus')} ELSE {sql_space('text')} END AS candidate_text FROM loci JOIN documents USING (doc_id)")


@query("C5_relocation_requests", "SELECT doc_id, scope, candidate_text FROM requests_sql")
def c5(t):
    return corpus.relocation_requests(loci(t), t.documents).select("doc_id", "scope", "candidate_text")


ANSWER = "CASE WHEN doc_id % 4 = 0 THEN 'zzz not there' WHEN doc_id % 4 = 1 THEN NULL ELSE split_part(candidate_text, ' ', 2) END"
fragment("relocated", f"SELECT doc_id, scope, candidate_text, coalesce(a <> '' AND contains(candidate_text, {sql_space('a')}), false) AS exact, a FROM (SELECT *, {ANSWER} AS a FROM requests_sql)")


def relocated(t):
    requests = corpus.relocation_requests(loci(t), t.documents)
    answers = requests.select("req_id", F.expr(ANSWER).alias("substring"))
    return corpus.materialise_relocation(requests, answers)


@query("C6_relocation_materialise", "SELECT doc_id, scope, exact, CASE WHEN exact THEN a ELSE candidate_text END AS evidence FROM relocated")
def c6(t):
    return relocated(t).drop("req_id")


@query("C6_relocation_rates", "SELECT scope, count(*) AS n, round(avg(exact::INT), 6) AS exact_rate FROM relocated GROUP BY scope")
def c6r(t):
    return corpus.relocation_rates(relocated(t))


@query("C7_input_verification", "SELECT label AS file, count(*) AS n_rows, '2' AS column_counts, bool_or(contains(position, ';')) AS has_discontinuous FROM annots GROUP BY label")
def c7(t):
    rows = q_sampling.annotations(t).withColumnRenamed("label", "file")
    return corpus.verify_inputs(rows, F.size(F.split("position", " ")), F.col("position"))


@query("C8_output_gate", "SELECT 1::BIGINT AS wrong_files, (SELECT count(*) FILTER (rate < 0.5) FROM (SELECT scope, avg(exact::INT) AS rate FROM relocated GROUP BY scope)) AS low_rates, false AS passed")
def c8(t):
    counts = t.lineitem.groupBy(F.col("l_returnflag").alias("file")).agg(F.count(F.lit(1)).alias("n_rows"))
    expected = counts.select("file", (F.col("n_rows") + F.when(F.col("file") == "R", 1).otherwise(0)).alias("n_expected"))
    return corpus.output_gate(counts, expected, corpus.relocation_rates(relocated(t)), 0.5)


@query("C9_hypothesis_table", """SELECT fact_id, hyp_idx, dim, value, array_to_string(coalesce(vcats, []), ',') AS cats FROM hyp_long JOIN norm USING (dim, value)""")
def c9(t):
    hyps = agree.normalize_hypotheses(frames.hypotheses(t), frames.part_domain())
    cells = [F.struct(F.lit(d).alias("dim"), F.col(f"dims.{d}.value").alias("value"), F.array_join(f"dims.{d}.cats", ",").alias("cats")) for d in agree.JUDGED]
    return hyps.select("fact_id", "hyp_idx", F.inline(F.array(*cells))).where("value IS NOT NULL")


@query("C10_facts_from_rows", "SELECT page_id AS fact_id, 'table' AS input_type, 2::BIGINT AS n_gold FROM pages")
def c10(t):
    rows = readers.fact_rows(raw_facts(t).withColumn("source_sample_idx", F.lit("")).withColumn(
        "input_fields", F.from_json(F.to_json("input_fields"), readers.FIELDS)), "us-gaap:")
    return rows.select("fact_id", "input_type", F.size("gold_tags").alias("n_gold"))


# --- quality ----------------------------------------------------------------------------------------------------------

@query("Q1_pending_work", "SELECT o_orderkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R')")
def q1(t):
    done = t.lineitem.where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey"))
    return quality.pending(t.orders.select("o_orderkey"), done, ["o_orderkey"])


def call_log(t):
    return calls(t).select("log_pos", "fact_id", (F.col("log_pos") % 2).cast("int").alias("hyp_idx"), "parse_ok", (F.col("log_pos") % 5).cast("int").alias("n_verdicts"), "prompt_tokens", "completion_tokens")


fragment("reusables", """SELECT fact_id, hyp_idx, arg_max(parse_ok, log_pos) AS parse_ok, arg_max(n_verdicts, log_pos) AS n_verdicts, count(*) AS n_rows FROM (SELECT *, log_pos % 2 AS hyp_idx, log_pos % 5 AS n_verdicts FROM calls) GROUP BY ALL""")


@query("Q2_reusable_calls", "SELECT *, parse_ok AND n_verdicts > 0 AS reusable FROM reusables")
def q2(t):
    return quality.reusable_calls(call_log(t))


@query("Q3_completeness", "SELECT DISTINCT fact_id, tag FROM rankings WHERE rank <= 5 EXCEPT SELECT fact_id, tag FROM fused WHERE rank <= 10")
def q3(t):
    lists = frames.rankings(t)
    return quality.missing_keys(lists.where("rank <= 5"), fuse.fuse(lists, 10), ["fact_id", "tag"])


@query("Q4_parse_rate_guard", "SELECT count(*) AS n, round(avg(parse_ok::INT), 6) AS parse_rate, count(*) >= 500 AND avg(parse_ok::INT) < 0.9 AS abort FROM (SELECT * FROM calls ORDER BY log_pos LIMIT 500)")
def q4(t):
    return quality.parse_rate_guard(call_log(t), 500, 0.9)


@query("Q5_record_validation", "SELECT fact_id, 'direct' AS query_mode, count(*) AS n_candidates FROM rankings WHERE list_id = 1 GROUP BY fact_id HAVING count(*) > 50")
def q5(t):
    records = frames.rankings(t).where("list_id = 1").groupBy("fact_id").agg(F.lit("direct").alias("query_mode"), F.count(F.lit(1)).alias("n_candidates"))
    return quality.invalid_records(records, "direct", 50)


@query("Q6_config_drift", """SELECT p_partkey AS run, name, CASE WHEN p_size % 10 = 0 THEN 'NO METADATA' ELSE CASE name WHEN 'beta' THEN CASE WHEN p_size % 3 = 0 THEN 'OK' ELSE 'DRIFT' END WHEN 'dims' THEN 'OK' WHEN 'k' THEN 'MISSING' ELSE 'ALLOWED' END END AS status
    FROM part, (SELECT unnest(['beta', 'dims', 'k', 'fusion']) AS name)""")
def q6(t):
    stated = F.array(F.struct(F.lit("beta").alias("name"), F.when(F.col("p_size") % 3 == 0, "0.60").otherwise("0.7").alias("value")),
                     F.struct(F.lit("dims").alias("name"), F.lit("b, a").alias("value")), F.struct(F.lit("fusion").alias("name"), F.lit("mean").alias("value")))
    declared = t.part.select(F.col("p_partkey").alias("run"), F.inline_outer(F.when(F.col("p_size") % 10 != 0, stated)))
    pinned = t.spark.createDataFrame([("beta", "0.6", []), ("dims", "a,b", []), ("k", "200", []), ("fusion", "sum", ["mean"])], "name string, value string, allowed array<string>")
    return quality.config_drift(declared, pinned)


@query("Q7_window_mismatch", "SELECT fact_id, hyp_idx, tag, dim FROM verdicts WHERE (fact_id, tag) IN (SELECT fact_id, tag FROM fused WHERE rank > 8)")
def q7(t):
    fused = fuse.fuse(frames.rankings(t))
    windows = fused.where("rank <= 10").select("fact_id", F.explode(F.array(F.lit(0), F.lit(1))).alias("hyp_idx"), F.col("rank").alias("pos"), "tag")
    return quality.window_mismatch(frames.verdicts(fused), windows, 8).select("fact_id", "hyp_idx", "tag", "dim")


@query("Q8_vocabulary_check", """SELECT dim AS dimension, count(v.p_partkey) AS n_phrases, (dim <> 'event') = (count(v.p_partkey) > 0) AS ok FROM (SELECT unnest(['family', 'qualifier', 'role', 'event']) AS dim) LEFT JOIN (
    SELECT p_partkey, CASE p_size % 4 WHEN 0 THEN 'family' WHEN 1 THEN 'qualifier' WHEN 2 THEN 'family' ELSE 'qualifier' END AS d FROM part) v ON d = dim GROUP BY dim""")
def q8(t):
    dimension = F.when(F.col("p_size") % 2 == 0, "family").otherwise("qualifier")
    vocabulary = t.part.select(dimension.alias("dimension"), F.col("p_type").alias("category"), F.col("p_name").alias("phrase"))
    return quality.vocabulary_check(vocabulary, ["family", "qualifier", "role", "event"], ["family", "qualifier", "role"])


# --- streams ----------------------------------------------------------------------------------------------------------

def streamed_log(t):
    path = sinks.jsonl(call_log(t).repartitionByRange(4, "log_pos"), at(t, "log"))
    return ingest.call_log(t.spark, path, 1)


@query("ST1_call_log_ingest", "SELECT fact_id, hyp_idx, n_verdicts FROM reusables WHERE parse_ok AND n_verdicts > 0")
def st1(t):
    table = at(t, "table")
    ingest.ingest_calls(streamed_log(t), table, at(t, "checkpoint")).awaitTermination()
    return ingest.current_calls(t.spark, table).select("fact_id", "hyp_idx", "n_verdicts")


@query("ST2_running_statistics", """SELECT log_pos % 2 AS hyp_idx, count(*) AS n_calls, sum(prompt_tokens)::BIGINT AS prompt_tokens, sum(completion_tokens)::BIGINT AS completion_tokens, round(avg(parse_ok::INT), 8) AS parse_rate FROM calls GROUP BY 1""")
def st2(t):
    name = f"stats_{uuid.uuid4().hex}"
    ingest.run_statistics(streamed_log(t), name, at(t, "checkpoint")).awaitTermination()
    return t.spark.table(name).withColumn("parse_rate", F.round("parse_rate", 8))
