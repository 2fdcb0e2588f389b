"""Text rules as column expressions; nothing here leaves the JVM."""

from __future__ import annotations

import html

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from evirank.domain import DIMENSIONS, STOPWORDS, UNRESOLVED

# (?U) makes \s cover no-break and other Unicode spaces; the separators x1c-x1f count as space as well.
SPACE = r"(?U)[\s\x1c-\x1f]+"
# Token shape and the two camel-case boundaries.
TOKEN = r"[A-Za-z0-9]+"
CAMEL = r"(?<=[a-z0-9])(?=[A-Z])|(?<=[A-Z])(?=[A-Z][a-z])"


def col(value) -> Column:
    return F.col(value) if isinstance(value, str) else value


def normalize_space(text) -> Column:
    return F.trim(F.regexp_replace(F.coalesce(col(text).cast("string"), F.lit("")), SPACE, " "))


def first_filled(*values) -> Column:
    """First value that is neither null nor empty; empty string when there is none."""
    return F.coalesce(*[F.nullif(col(v).cast("string"), F.lit("")) for v in values], F.lit(""))


def normalize_tag(tag, prefix: str) -> Column:
    text = normalize_space(tag)
    return F.when((text == "") | text.startswith(prefix), text).otherwise(F.concat(F.lit(prefix), text))


def raw_tag(tag, prefix: str) -> Column:
    text = normalize_space(tag)
    return F.when(text.startswith(prefix), F.substring(text, F.lit(len(prefix) + 1), F.length(text))).otherwise(text)


def fold_token(token: Column) -> Column:
    """Lower-case and undo the plain plural endings."""
    low = F.lower(token)
    size = F.length(low)
    return (
        F.when((size > 4) & low.endswith("ies"), F.concat(F.substring(low, F.lit(1), size - 3), F.lit("y")))
        .when((size > 3) & low.endswith("s") & ~low.endswith("ss"), F.substring(low, F.lit(1), size - 1))
        .otherwise(low)
    )


def tokenize(text) -> Column:
    """Tokens of the text followed by tokens of its camel-split copy, order and repeats kept."""
    text = F.coalesce(col(text), F.lit(""))
    both = F.concat_ws(" ", text, F.regexp_replace(text, CAMEL, " "))
    tokens = F.transform(F.regexp_extract_all(both, F.lit(TOKEN), F.lit(0)), fold_token)
    return F.filter(tokens, lambda t: ~t.isin(STOPWORDS))


def token_set(text) -> Column:
    return F.array_distinct(tokenize(text))


# What html.unescape takes for a reference; everything between references stays as it is.
REFERENCE = r"&(?:#[0-9]+;?|#[xX][0-9a-fA-F]+;?|[^\t\n\f <&#;]{1,32};?)"


def unescape_html(text) -> Column:
    """All named and numeric character references of HTML 5, decoded once. Only the references reach the Arrow step, no texts."""
    def decode(found: pd.Series) -> pd.Series:
        return found.map(lambda refs: [html.unescape(r) for r in refs], na_action="ignore")

    text = col(text)
    decoded = F.pandas_udf(decode, "array<string>")(F.when(text.contains("&"), F.regexp_extract_all(text, F.lit(REFERENCE), F.lit(0))))
    joined = F.array_join(F.zip_with(F.split(text, REFERENCE), decoded, lambda a, b: F.concat(a, F.coalesce(b, F.lit("")))), "")
    return F.when(decoded.isNotNull(), joined).otherwise(text)


# A comment, or a script or style element whose body is raw text.
RAW_BLOCK = r"(?is)<!--.*?-->|<script\b[^>]*>.*?</script\s*>|<style\b[^>]*>.*?</style\s*>"
SHIELD = "\ue001\ue002\ue003"


def _shielded(block: Column) -> Column:
    """Body of a raw block with its markup characters set aside; a comment becomes a space."""
    body = F.regexp_replace(F.regexp_replace(block, r"^<[^>]*>", ""), r"</[a-zA-Z]+\s*>$", "")
    return F.when(block.startswith("<!--"), F.lit(" ")).otherwise(
        F.concat(F.lit(" "), F.translate(body, "<>&", SHIELD), F.lit(" "))
    )


def html_to_visible_text(text) -> Column:
    """Text nodes joined by a space; script and style text stays, comments and declarations go."""
    text = F.coalesce(col(text), F.lit(""))
    blocks = F.transform(F.regexp_extract_all(text, F.lit(RAW_BLOCK), F.lit(0)), _shielded)
    between = F.split(text, RAW_BLOCK)
    joined = F.array_join(
        F.zip_with(between, blocks, lambda a, b: F.concat(F.coalesce(a, F.lit("")), F.coalesce(b, F.lit("")))), ""
    )
    bare = F.regexp_replace(joined, r"(?s)<![^>]*>|<\?[^>]*>", " ")
    bare = F.regexp_replace(bare, r"</?[A-Za-z][^>]*>", " ")
    marked = text.contains("<") & text.contains(">")
    parsed = normalize_space(F.translate(unescape_html(F.when(marked, bare)), SHIELD, "<>&"))
    plain = normalize_space(unescape_html(F.when(~marked, text)))
    fallback = normalize_space(F.regexp_replace(unescape_html(F.when(marked, text)), r"<[^>]+>", " "))
    return F.when(~marked, plain).otherwise(first_filled(parsed, fallback))


def truncate_middle(text, limit) -> Column:
    """Head and tail around an ellipsis once the text is longer than `limit` characters."""
    text = normalize_space(text)
    limit = F.lit(limit) if isinstance(limit, int) else limit
    head = F.floor(limit / 2).cast("int")
    tail = (limit - head).cast("int")
    cut = F.concat(
        F.rtrim(F.substring(text, F.lit(1), head)), F.lit(" ... "),
        F.ltrim(F.substring(text, F.length(text) - tail + 1, tail)),
    )
    return F.when((limit <= 0) | (F.length(text) <= limit), text).otherwise(cut)


def join_filled(parts: list, sep: str) -> Column:
    cleaned = F.array(*[normalize_space(p) for p in parts])
    return F.array_join(F.filter(cleaned, lambda p: p != ""), sep)


def retrieval_text(*parts) -> Column:
    return join_filled(list(parts), ". ")


def clean_label(label) -> Column:
    return normalize_space(F.replace(col(label), F.lit(","), F.lit(" ")))


def tag_from_href(href) -> Column:
    return F.regexp_extract(col(href), r"#us-gaap_(.*)$", 1)


def strip_namespace(name) -> Column:
    return F.substring_index(col(name), ":", -1)


def direct_query(entity, entity_type, context) -> Column:
    return normalize_space(F.concat_ws(" ", *[F.coalesce(col(c), F.lit("")) for c in (entity, entity_type, context)]))


def grounding_query(entity, entity_type, context, grounding) -> Column:
    body = first_filled(normalize_space(grounding), direct_query(entity, entity_type, context))
    return direct_query(entity, entity_type, body)


def serialize_evidence(entity, entity_type, input_type, row_context, column_context, context, limit: int) -> Column:
    def line(label, value, optional=False):
        text = F.concat(F.lit(f"{label}: "), F.coalesce(col(value), F.lit("")))
        return F.when(F.coalesce(col(value), F.lit("")) != "", text) if optional else text

    return F.array_join(
        F.array_compact(F.array(
            line("Entity value", entity),
            line("Datatype", entity_type),
            line("Input type", input_type),
            line("Row context", row_context, optional=True),
            line("Column context", column_context, optional=True),
            F.lit("Source context:"),
            truncate_middle(context, limit),
        )),
        "\n",
    )


def is_unresolved(value) -> Column:
    return F.lower(normalize_space(value)).isin(UNRESOLVED)


def resolved_values(dims: Column) -> Column:
    """Values of the named dimensions in the fixed order, the literal "unresolved" and blanks left out."""
    values = F.array(*[normalize_space(dims[d]) for d in DIMENSIONS])
    return F.filter(values, lambda v: (v != "") & (F.lower(v) != "unresolved"))


def render_definition(query, dims) -> Column:
    return first_filled(normalize_space(query), F.array_join(resolved_values(col(dims)), " "))


def render_label(dims) -> Column:
    """Tokens of the resolved values; null when nothing is resolved."""
    tokens = F.flatten(F.transform(resolved_values(col(dims)), tokenize))
    return F.nullif(F.array_join(tokens, " "), F.lit(""))


def contains_normalized(needle, text) -> Column:
    needle = normalize_space(needle)
    return (needle != "") & F.contains(normalize_space(text), needle)


def coverage(query_tokens, label_tokens) -> tuple[Column, Column]:
    """Shares of the label and of the query that the other side covers."""
    q, label = col(query_tokens), col(label_tokens)
    shared = F.size(F.array_intersect(q, label))
    cov = F.when(F.size(label) > 0, shared / F.size(label)).otherwise(F.lit(0.0))
    qcov = F.when((F.size(label) > 0) & (F.size(q) > 0), shared / F.size(q)).otherwise(F.lit(0.0))
    return cov, qcov


def md5_int(key) -> Column:
    """First 32 bits of the md5 of a string key."""
    return F.conv(F.substring(F.md5(col(key)), 1, 8), 16, 10).cast("bigint")
