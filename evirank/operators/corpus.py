"""Building concept, fact and vocabulary tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evirank.functions import codes, text
from evirank.functions.text import first_filled, normalize_space, raw_tag
from evirank.operators.splits import dedupe_annotations, fill_to_target
from evirank.session import checkpointed


def gold_queries(facts: DataFrame, concepts: DataFrame, prefix: str) -> DataFrame:
    """Query text of the gold concept itself; the direct query where the gold tag is not in the taxonomy."""
    described = concepts.select(
        F.col("tag").alias("gold_tag"),
        text.join_filled([raw_tag("tag", prefix), "standard_label", "documentation"], " ").alias("gold_text"),
    )
    return facts.join(described, "gold_tag", "left").withColumn("query", first_filled("gold_text", "direct_query"))


def inventory(*code_lists: DataFrame) -> DataFrame:
    """Codes every list holds, once each."""
    out = code_lists[0]
    for other in code_lists[1:]:
        out = out.intersect(other)
    return out.distinct() if len(code_lists) == 1 else out


def walk_up(nodes: DataFrame) -> DataFrame:
    """nodes(node, parent, label, note): labels and notes from the root down to each node, however deep it lies.

    Pointer doubling: a node's pointer moves to its target's pointer while the target's labels go in front, so the rounds grow
    with the logarithm of the depth, and each is one equi-join of the rows that are still open. A cycle stops the job.
    """
    rows = checkpointed(nodes.select("node", F.col("parent").alias("at"), F.array("node").alias("ids"), F.array("label").alias("labels"), F.array("note").alias("notes")))
    finished = None
    while True:
        done, open_ = rows.where(F.col("at").isNull()), rows.where(F.col("at").isNotNull())
        finished = done if finished is None else finished.unionByName(done)
        n, cycles = open_.agg(F.count(F.lit(1)), F.coalesce(F.count_if(F.array_contains("ids", F.col("at"))), F.lit(0))).first()
        if not n:
            break
        if cycles:
            raise ValueError("the hierarchy has a cycle")
        up = open_.unionByName(finished).select(F.col("node").alias("at"), F.col("at").alias("next"), *[F.col(c).alias(f"up_{c}") for c in ("ids", "labels", "notes")])
        found = F.col("up_ids").isNotNull()
        rows = checkpointed(open_.join(up, "at", "left").select(
            "node", F.col("next").alias("at"), *[F.when(found, F.concat(f"up_{c}", c)).otherwise(F.col(c)).alias(c) for c in ("ids", "labels", "notes")]))
    return finished.select("node", "labels", F.array_compact("notes").alias("notes"), (F.size("labels") - 1).alias("depth"))


def paths_by_code(rows: DataFrame) -> DataFrame:
    """rows(code, path): the sorted distinct paths of each code."""
    return rows.groupBy("code").agg(F.array_sort(F.collect_set("path")).alias("paths"))


def facts_from_annotations(annotations: DataFrame, known: DataFrame, label: str, sentences: DataFrame, lines: DataFrame, target: int, seed: int) -> DataFrame:
    """annotations(row_id, doc_id, position, code, label) -> located facts of whole documents, drawn until their facts reach the target.

    One fact per document, position and known code. Documents are taken in seeded order by a running sum of their facts, which is
    spread over buckets of that order; only documents taken have their positions located.
    """
    facts = dedupe_annotations(annotations, known, label)
    counts = facts.groupBy(F.col("doc_id").alias("sample_id")).agg(F.count(F.lit(1)).alias("n"))
    taken = fill_to_target(counts, seed, target).select(F.col("sample_id").alias("doc_id"))
    named = F.concat_ws("|", F.col("doc_id").cast("string"), "position", F.col("code").cast("string"))
    drawn = checkpointed(facts.join(taken, "doc_id", "left_semi").withColumn("req_id", named))
    some = drawn.select("doc_id").distinct()
    requests = drawn.select("req_id", "doc_id", codes.parse_ranges("position").alias("ranges"))
    located = codes.aligned_locus(requests, sentences.join(some, "doc_id", "left_semi"), lines.join(some, "doc_id", "left_semi"))
    return drawn.join(located.drop("doc_id"), "req_id").drop("req_id")


def concept_table(elements: DataFrame, labels: DataFrame, docs: DataFrame, refs: DataFrame, older: DataFrame, prefix: str) -> DataFrame:
    """elements(tag, type) with label, documentation and references; an older label or type is preferred when present."""
    joined = (
        elements.join(older.select("tag", F.col("standard_label").alias("old_label"), F.col("type").alias("old_type")), "tag", "left")
        .join(labels, "tag", "left").join(docs.withColumnRenamed("label", "documentation"), "tag", "left").join(refs, "tag", "left"))
    label, kind = text.clean_label(first_filled("old_label", "label")), first_filled("old_type", "type")
    return joined.select(
        text.normalize_tag("tag", prefix).alias("tag"), kind.alias("type"), label.alias("standard_label"),
        normalize_space("documentation").alias("documentation"), F.coalesce("references", F.array().cast("array<string>")).alias("references"),
        text.retrieval_text(label, F.col("documentation")).alias("retrieval_text"))


def code_table(codes_: DataFrame, tabular: DataFrame, index_terms: DataFrame, n_terms: int = 20) -> DataFrame:
    """Code concepts: codes(raw, label) with tabular(raw, inclusions, inherited, path, excludes) and terms(raw, paths)."""
    joined = codes_.join(tabular, "raw", "left").join(index_terms, "raw", "left")
    none = F.array().cast("array<string>")
    definition = text.join_filled([
        F.array_join(F.coalesce("inclusions", none), "; "), F.array_join(F.coalesce("inherited", none), "; "), F.array_join(F.coalesce("path", none), " > "),
        F.array_join(F.slice(F.coalesce("paths", none), 1, n_terms), "; ")], ". ")
    return joined.select(
        F.col("raw").alias("tag"), codes.dotted_code("raw").alias("display"), "label", definition.alias("documentation"),
        codes.role_for_code("raw").alias("role"), F.coalesce("excludes", none).alias("excludes"),
        text.retrieval_text("label", definition).alias("retrieval_text"))


def vocabulary_table(concepts: DataFrame) -> DataFrame:
    """concepts(chapter, role, extension): chapters and roles as phrases, extension texts grouped by category, counted."""
    def rows(dimension: str, category: Column, phrase: Column) -> DataFrame:
        named = concepts.select(F.lit(dimension).alias("dimension"), category.alias("category"), F.lower(normalize_space(phrase)).alias("phrase"))
        return named.where("phrase <> ''").groupBy("dimension", "category", "phrase").agg(F.count(F.lit(1)).alias("n"))

    family = rows("family", F.col("chapter"), F.col("chapter"))
    role = rows("role", F.col("role"), F.replace("role", F.lit("-"), F.lit(" ")))
    temporal = rows("temporal", codes.temporal_category("extension"), F.col("extension"))
    return family.unionByName(role).unionByName(temporal)


def relocation_requests(loci: DataFrame, documents: DataFrame) -> DataFrame:
    """The text to search: the aligned sentences, else the whole document."""
    joined = loci.join(documents.select("doc_id", F.col("text").alias("document")), "doc_id")
    sentence = F.col("locus_level") == "aligned_sentence"
    return joined.select("req_id", "doc_id", F.when(sentence, "sentence").otherwise("document").alias("scope"),
                         F.when(sentence, F.col("locus")).otherwise(normalize_space("document")).alias("candidate_text"))


def materialise_relocation(requests: DataFrame, answers: DataFrame) -> DataFrame:
    """answers(req_id, substring): kept when it occurs in the searched text, else the whole scope is the evidence."""
    joined = requests.join(answers, "req_id", "left")
    ok = F.coalesce(text.contains_normalized("substring", "candidate_text"), F.lit(False))
    return joined.select("req_id", "doc_id", "scope", ok.alias("exact"), F.when(ok, normalize_space("substring")).otherwise(F.col("candidate_text")).alias("evidence"))


def relocation_rates(facts: DataFrame) -> DataFrame:
    return facts.groupBy("scope").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(F.col("exact").cast("double")), 6).alias("exact_rate"))


def verify_inputs(rows: DataFrame, cells: Column, positions: Column) -> DataFrame:
    """rows(file, ..): per file the row count, the distinct column counts and whether any position is discontinuous."""
    return rows.groupBy("file").agg(
        F.count(F.lit(1)).alias("n_rows"), F.array_join(F.array_sort(F.collect_set(cells.cast("string"))), ",").alias("column_counts"),
        F.max(positions.contains(";")).alias("has_discontinuous"))


def output_gate(counts: DataFrame, expected: DataFrame, rates: DataFrame, minimum: float) -> DataFrame:
    """One row: files with the wrong count, facts below the minimum rate, and the verdict."""
    wrong = counts.join(expected, "file", "full").agg(F.count_if(~F.col("n_rows").eqNullSafe(F.col("n_expected"))).alias("wrong_files"))
    low = rates.agg(F.count_if(F.col("exact_rate") < minimum).alias("low_rates"))
    # two one-row frames side by side
    return wrong.join(low).withColumn("passed", (F.col("wrong_files") == 0) & (F.col("low_rates") == 0))
