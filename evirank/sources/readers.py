"""Readers with fixed schemas. Order keys are carried in the data; file order is never relied on."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from evirank.functions import text
from evirank.functions.codes import normalize_code
from evirank.functions.text import first_filled, normalize_space
from evirank.session import checkpointed

FIELDS = ("struct<numeric_entity:string,entity:string,value:string,numeric_value:string,datatype:string,type:string,"
          "row_context:string,column_context:string,original_context:string>")
FACTS = f"example_idx bigint, context_id string, source_sample_idx string, input_type string, input string, input_fields {FIELDS}, ground_truth_concepts array<string>"
CONCEPTS = "doc_idx bigint, tag string, type string, standard_label string, documentation string, references array<string>, retrieval_text string"
CANDIDATE = "struct<rank:int,tag:string,bm25_score:double,retrieval_score:double>"
TRACES = f"example_idx bigint, context_id string, rounds array<struct<round:int,hypothesis_idx:int,rendering:string,label_render_skipped:boolean,candidates:array<{CANDIDATE}>>>"
VERDICTS = "log_pos struct<file:bigint,line:bigint>, fact_id bigint, hypothesis_idx int, tag string, verdict map<string,boolean>"
CALLS = "fact_id bigint, hypothesis_idx int, candidate_tags array<string>, prompt_tokens bigint, completion_tokens bigint"


def jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """One object per line; blank lines are skipped."""
    return spark.read.schema(schema).json(path)


def facts(spark: SparkSession, path: str, prefix: str) -> DataFrame:
    return fact_rows(jsonl(spark, path, FACTS), prefix)


def fact_rows(rows: DataFrame, prefix: str) -> DataFrame:
    """Alias names coalesced, `input` text parsed where `input_fields` is absent, contexts made visible, golds tagged."""
    given = F.coalesce(F.col("input_fields"), F.from_json("input", FIELDS))
    rows = rows.withColumn("f", given)
    tags = F.transform(F.coalesce("ground_truth_concepts", F.array().cast("array<string>")), lambda g: text.normalize_tag(g, prefix))
    return rows.select(
        F.col("example_idx").alias("fact_id"), "context_id", "source_sample_idx", normalize_space("input_type").alias("input_type"),
        normalize_space(first_filled("f.numeric_entity", "f.entity", "f.value", "f.numeric_value")).alias("entity"),
        normalize_space(first_filled("f.datatype", "f.type")).alias("entity_type"),
        normalize_space("f.row_context").alias("row_context"), normalize_space("f.column_context").alias("column_context"),
        normalize_space("f.original_context").alias("original_context"),
        text.html_to_visible_text(normalize_space("f.original_context")).alias("query_context"),
        F.filter(tags, lambda g: g != "").alias("gold_tags"))


def concepts(spark: SparkSession, path: str, prefix: str) -> DataFrame:
    rows = jsonl(spark, path, CONCEPTS)
    refs = F.filter(F.transform(F.coalesce("references", F.array().cast("array<string>")), normalize_space), lambda r: r != "")
    tag = text.normalize_tag("tag", prefix)
    return rows.select(
        "doc_idx", tag.alias("tag"), text.raw_tag(tag, prefix).alias("raw_tag"), normalize_space("type").alias("entity_type"),
        *[normalize_space(c).alias(c) for c in ("standard_label", "documentation", "retrieval_text")], refs.alias("references"))


def samples(spark: SparkSession, path: str, split: str, key: str) -> DataFrame:
    """Parquet samples with `split` and an ordinal taken from the key when the files lack them."""
    rows = spark.read.parquet(path)
    if "split" not in rows.columns:
        rows = rows.withColumn("split", F.lit(split))
    return rows if "source_sample_idx" in rows.columns else rows.withColumn("source_sample_idx", F.col(key))


def tsv(spark: SparkSession, path: str, names: list[str]) -> DataFrame:
    """Tab-separated rows; a row with another number of columns stops the job."""
    cells = spark.read.text(path).select(F.split("value", "\t").alias("c"))
    check = F.assert_true(F.size("c") == len(names), F.concat(F.lit(f"expected {len(names)} columns, got "), F.size("c").cast("string")))
    return cells.withColumn("_ok", check).where("_ok IS NULL").select(*[F.col("c")[i].alias(n) for i, n in enumerate(names)])


def valid_codes(spark: SparkSession, path: str) -> DataFrame:
    rows = tsv(spark, path, ["code", "es_desc", "en_desc"])
    return rows.select(normalize_code("code").alias("raw"), F.upper(normalize_space("code")).alias("display"),
                       normalize_space("es_desc").alias("es_desc"), normalize_space("en_desc").alias("en_desc"))


def billable_codes(spark: SparkSession, path: str) -> DataFrame:
    """Fixed width: code in the first 8 characters, description after; the later of two equal codes wins."""
    rows = spark.read.text(path).where(F.length("value") > 0).select(
        normalize_code(F.substring("value", 1, 8)).alias("raw"), normalize_space(F.substring("value", F.lit(9), F.length("value"))).alias("desc"),
        F.struct(F.col("_metadata.file_path"), F.monotonically_increasing_id()).alias("at"))
    return rows.where("raw <> '' AND desc <> ''").groupBy("raw").agg(F.max_by("desc", "at").alias("desc"))


def text_files(spark: SparkSession, path: str) -> DataFrame:
    """One row per file: its name without folder and ending, and its whole text."""
    rows = spark.read.text(path, wholetext=True)
    return rows.select(F.regexp_extract(F.col("_metadata.file_name"), r"([^/]+?)(\.[^.]*)?$", 1).alias("doc_id"), F.col("value").alias("text"))


def xml_elements(spark: SparkSession, path: str) -> DataFrame:
    """Named schema elements as (tag, type without namespace)."""
    rows = spark.read.format("xml").option("rowTag", "xs:element").schema("_name string, _type string").load(path)
    return rows.where(F.coalesce("_name", F.lit("")) != "").select(F.col("_name").alias("tag"), text.strip_namespace("_type").alias("type"))


LOC = "array<struct<`_xlink:label`:string,`_xlink:href`:string>>"
ARC = "array<struct<`_xlink:from`:string,`_xlink:to`:string>>"


def _linked(rows: DataFrame, arcs: str, resources: str, value) -> DataFrame:
    """Arcs joined inside their own link block to locator and resource: (block, pos, tag, value struct).

    A label may repeat inside a block; the last locator or resource of it counts. Blocks are numbered once, then locators,
    resources and arcs are rows of their own that meet on (block, label), so a large block is no large row.
    """
    loc = F.transform("`link:loc`", lambda x: F.struct(x["_xlink:label"].alias("label"), text.tag_from_href(x["_xlink:href"]).alias("tag")))
    res = F.transform(F.col(f"`{resources}`"), lambda x: F.struct(x["_xlink:label"].alias("label"), value(x).alias("value")))
    blocks = checkpointed(rows.select(F.monotonically_increasing_id().alias("block"), loc.alias("loc"), res.alias("res"), F.col(f"`{arcs}`").alias("arcs")))

    def last(items: str, field: str, end: str) -> DataFrame:
        each = blocks.select("block", F.posexplode(items).alias("pos", "x"))
        return each.groupBy("block", F.col("x.label").alias(end)).agg(F.max_by(f"x.{field}", "pos").alias(field))

    each = blocks.select("block", F.posexplode("arcs").alias("pos", "arc")).select(
        "block", "pos", F.col("arc")["_xlink:from"].alias("from"), F.col("arc")["_xlink:to"].alias("to"))
    joined = each.join(last("loc", "tag", "from"), ["block", "from"]).join(last("res", "value", "to"), ["block", "to"])
    return joined.select("block", "pos", "tag", "value").where("tag IS NOT NULL AND tag <> '' AND value IS NOT NULL")


def label_linkbase(spark: SparkSession, path: str, role: str) -> DataFrame:
    """First non-empty label of the role per tag, in arc order."""
    schema = (f"`link:loc` {LOC}, `link:label` array<struct<`_xlink:label`:string,`_xlink:role`:string,_VALUE:string>>, `link:labelArc` {ARC}")
    rows = spark.read.format("xml").option("rowTag", "link:labelLink").schema(schema).load(path)
    linked = _linked(rows, "link:labelArc", "link:label", lambda x: F.struct(x["_xlink:role"].alias("role"), normalize_space(x["_VALUE"]).alias("text")))
    kept = linked.where((F.col("value.role") == role) & (F.col("value.text") != ""))
    return kept.groupBy("tag").agg(F.min_by("value.text", F.struct("block", "pos")).alias("label"))


PARTS = ["Topic", "SubTopic", "Section", "Paragraph", "URI", "Name", "Number", "Subparagraph"]


def format_reference(x) -> F.Column:
    """Codification citation, else the tail of the URI, else the joined parts."""
    def part(name):
        return normalize_space(x[f"codification-part:{name}"] if name in ("Topic", "SubTopic", "URI") else x[f"ref:{name}"])

    topic, sub, section, paragraph = (part(n) for n in ("Topic", "SubTopic", "Section", "Paragraph"))
    full = (topic != "") & (sub != "") & (section != "") & (paragraph != "")
    tail = F.regexp_extract(part("URI"), r"([^/]+)/*$", 1)
    return F.when(full, F.concat(F.lit("ASC "), topic, F.lit("-"), sub, F.lit("-"), section, F.lit("-"), paragraph)).when(
        tail != "", tail).otherwise(text.join_filled([part(n) for n in ("Name", "Number", "Section", "Paragraph", "Subparagraph")], " "))


def reference_linkbase(spark: SparkSession, path: str) -> DataFrame:
    """Ordered distinct citations per tag."""
    fields = ",".join(f"`{'codification-part' if n in ('Topic', 'SubTopic', 'URI') else 'ref'}:{n}`:string" for n in PARTS)
    schema = f"`link:loc` {LOC}, `link:reference` array<struct<`_xlink:label`:string,{fields}>>, `link:referenceArc` {ARC}"
    rows = spark.read.format("xml").option("rowTag", "link:referenceLink").schema(schema).load(path)
    linked = _linked(rows, "link:referenceArc", "link:reference", lambda x: format_reference(x)).where("value <> ''")
    ordered = F.array_sort(F.collect_list(F.struct("block", "pos", "value")))
    return linked.groupBy("tag").agg(F.array_distinct(F.transform(ordered, lambda p: p["value"])).alias("references"))


def trace_rankings(traces: DataFrame) -> DataFrame:
    """Nested traces to the long rankings table; rounds whose label form was skipped stay out."""
    rounds = traces.select(F.col("example_idx").alias("fact_id"), F.explode("rounds").alias("r")).where(~F.coalesce("r.label_render_skipped", F.lit(False)))
    return rounds.select("fact_id", F.col("r.round").alias("list_id"), F.col("r.hypothesis_idx").alias("hyp_idx"), F.col("r.rendering").alias("rendering"),
                         F.inline("r.candidates"))


def replay_mismatches(replayed: DataFrame, logged: DataFrame) -> DataFrame:
    """Share of (fact, slot) keys whose replayed gold rank differs from the logged one."""
    keys = ["fact_id", "slot"]
    joined = replayed.select(*keys, F.col("gold_rank").alias("a"), F.lit(True).alias("in_a")).join(
        logged.select(*keys, F.col("gold_rank").alias("b"), F.lit(True).alias("in_b")), keys, "full")
    same = F.col("a").eqNullSafe(F.col("b")) & F.col("in_a").isNotNull() & F.col("in_b").isNotNull()
    return joined.agg(F.count(F.lit(1)).alias("n"), F.count_if(~same).alias("mismatches"), F.round(F.avg((~same).cast("double")), 6).alias("mismatch_rate"))


def verdict_rows(rows: DataFrame) -> DataFrame:
    """Logged verdicts in long form; for one (fact, hypothesis, tag) the later row wins."""
    last = rows.groupBy("fact_id", F.col("hypothesis_idx").alias("hyp_idx"), "tag").agg(F.max_by("verdict", "log_pos").alias("verdict"))
    return last.select("fact_id", "hyp_idx", "tag", F.explode("verdict").alias("dim", "matched"))


def call_windows(calls: DataFrame) -> DataFrame:
    return calls.select("fact_id", F.col("hypothesis_idx").alias("hyp_idx"), F.posexplode("candidate_tags").alias("p", "tag")).select(
        "fact_id", "hyp_idx", (F.col("p") + 1).alias("pos"), "tag")


def call_costs(calls: DataFrame) -> DataFrame:
    return calls.agg(F.count(F.lit(1)).alias("n_calls"), F.sum("prompt_tokens").alias("prompt_tokens"),
                     F.sum("completion_tokens").alias("completion_tokens"), F.max(F.size("candidate_tags")).alias("max_window"))
