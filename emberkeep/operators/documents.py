"""Document extraction: metadata, text, tables and links of HTML pages, as Markdown.

A document is the pages that share ``doc_id``, numbered by ``page_no``.  A
report is kept as one row per section, so a document of any length is many
rows rather than one.
"""

from __future__ import annotations

import json
from functools import reduce
from html.entities import html5

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberkeep.functions import text as T

NO_TEXT = "_No text detected on this page._"
NO_TABLES = "_No tables detected on this page._"
NO_LINKS = "_No links detected on this page._"
FIELDS = ["Title", "Author", "Subject", "Creator", "Producer"]
META_NAMES = {"Author": "author", "Subject": "description", "Creator": "generator", "Producer": "publisher"}
# Entities that the corpus is full of; a blank that doesn't break is a blank in plain text.
ENTITIES = [
    ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "),
    ("&copy;", "©"), ("&middot;", "·"), ("&amp;", "&"),
]


ENTITY = r"&(#[0-9]{1,8}|#[xX][0-9a-fA-F]{1,7}|[A-Za-z][A-Za-z0-9]{1,31});"


def _named_entities() -> str:
    """The names that HTML knows and the numbers that stand for a byte of the Windows code page, as one JSON object."""
    named = {name[:-1]: sign for name, sign in html5.items() if name.endswith(";")}
    named |= {f"#{byte}": bytes([byte]).decode("cp1252", "replace") for byte in range(0x80, 0xA0)}
    named |= {entity[1:-1]: sign for entity, sign in ENTITIES}
    return json.dumps(named)


def decode_entities(text: Column) -> Column:
    """Named and numbered entities as the signs they stand for, each once; unknown names stay, numbers beyond Unicode become U+FFFD.

    The few that are common are replaced first, none of them leaving a new
    ampersand; only a text that still holds another entity is cut at those.
    """
    common = reduce(lambda acc, e: F.replace(acc, F.lit(e[0]), F.lit(e[1])), [e for e in ENTITIES if e[0] != "&amp;"], text)
    return T.let(common, _decoded)


def _decoded(text: Column) -> Column:
    names = F.regexp_extract_all(text, F.lit(ENTITY), F.lit(1))
    table = F.from_json(F.lit(_named_entities()), "map<string,string>")

    def sign(name: Column) -> Column:
        code = F.when(name.rlike("^#[xX]"), F.conv(F.substring(name, F.lit(3), F.length(name)), 16, 10)).when(
            name.startswith("#"), F.substring(name, F.lit(2), F.length(name))).try_cast("long")
        valid = (code > 0) & (code <= 0x10FFFF) & ~code.between(0xD800, 0xDFFF)
        plain = F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32")
        known = F.element_at(table, F.when(code.isNotNull(), F.concat(F.lit("#"), code.cast("string"))).otherwise(name))
        return F.coalesce(known, F.when(valid, plain), F.when(code.isNotNull(), "\ufffd"), F.concat(F.lit("&"), name, F.lit(";")))

    pieces = F.split(text, ENTITY, -1)
    signs = F.concat(F.transform(names, sign), F.array(F.lit("")))
    whole = F.array_join(F.zip_with(pieces, signs, lambda p, e: F.concat(p, e)), "")
    rare = F.regexp_replace(text, "&amp;", "").rlike(ENTITY)
    return F.when(~F.contains(text, F.lit("&")), text).when(rare, whole).otherwise(F.replace(text, F.lit("&amp;"), F.lit("&")))


def visible_text(html: Column) -> Column:
    """The text a reader sees: no scripts, styles, comments or tags."""
    hidden = F.regexp_replace(html, r"(?is)<script\b.*?</script>|<style\b.*?</style>|<!--.*?-->|<title\b.*?</title>", " ")
    broken = F.regexp_replace(hidden, r"(?i)<br\s*/?>|</(?:p|h[1-6]|li|div|tr)>", "\n")
    plain = decode_entities(F.regexp_replace(broken, r"<[^>]*>", " "))
    tight = F.regexp_replace(F.regexp_replace(plain, r"[ \t]+", " "), r" ?\n[ \n]*", "\n")
    return F.regexp_replace(tight, r"^[ \n]+|[ \n]+$", "")


def links(html: Column) -> Column:
    """Link targets in order, quoted either way or bare; relative ones in their internal form."""
    held = F.regexp_extract_all(html, F.lit(r"""(?i)<a\s(?:[^>]*?\s)?href\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)"""), F.lit(1))
    found = F.transform(held, lambda u: F.when(u.rlike("^[\"']"), F.substring(u, F.lit(2), F.length(u) - 2)).otherwise(u))
    return F.transform(found, lambda u: F.when(u.startswith("http"), u).otherwise(
        F.concat(F.lit("[Internal link → "), u, F.lit("]"))))


def link_display(link: Column) -> Column:
    return F.when(link.startswith("http"), F.concat(F.lit("<"), link, F.lit(">"))).otherwise(link)


def html_tables(html: Column) -> Column:
    """array<table<row<cell>>> of an HTML page."""

    def inside(text: Column, tag: str) -> Column:
        return F.regexp_extract_all(text, F.lit(rf"(?is)<{tag}\b[^>]*>(.*?)</{tag}>"), F.lit(1))

    return F.transform(inside(html, "table"), lambda t: F.transform(inside(t, "tr"), lambda r: F.transform(
        inside(r, "t[dh]"), visible_text)))


def clean_cell(cell: Column) -> Column:
    return F.coalesce(F.replace(F.replace(cell, F.lit("\n"), F.lit(" ")), F.lit("|"), F.lit("\\|")), F.lit(""))


def _table_row(cells: Column, width: Column) -> Column:
    padding = F.array_repeat(F.lit(""), F.greatest(width - F.size(cells), F.lit(0)).cast("int"))
    padded = F.concat(F.transform(cells, clean_cell), padding)
    return F.concat(F.lit("| "), F.array_join(padded, " | "), F.lit(" |"))


def _separator(width: Column) -> Column:
    return F.concat(F.lit("| "), F.array_join(F.array_repeat(F.lit("---"), width.cast("int")), " | "), F.lit(" |"))


def table_to_markdown(rows: Column) -> Column:
    """One table held in a row, array<array<string>>, as Markdown; ragged rows are padded."""
    width = F.array_max(F.transform(rows, F.size))
    lines = F.transform(rows, lambda r: _table_row(r, width))
    whole = F.concat(F.slice(lines, 1, 1), F.array(_separator(width)), F.slice(lines, F.lit(2), F.size(lines)))
    return F.when(F.size(rows) > 0, F.array_join(whole, "\n")).otherwise(F.lit(""))


def table_lines(df: DataFrame, group: list[str], order: list[str], cells: str) -> DataFrame:
    """Tables spread over rows, one per group, as Markdown lines ``(group, position, line)``.

    Only a group's width and first row travel between rows.  ``position`` sorts
    the lines: the header, its separator, then the other rows by ``order``.
    """
    key = F.struct(*order)
    shape = df.groupBy(*group).agg(F.max(F.size(cells)).alias("__width"), F.min(key).alias("__first"))
    placed = df.join(shape, group).withColumn("__head", key == F.col("__first"))
    part = F.when(F.col("__head"), 0).otherwise(2)
    body = placed.select(*group, F.struct(part.alias("part"), *order).alias("position"), _table_row(F.col(cells), F.col("__width")).alias("line"))
    rule = placed.where("__head").select(
        *group, F.struct(F.lit(1).alias("part"), *order).alias("position"), _separator(F.col("__width")).alias("line"))
    return body.unionByName(rule)


def _field(html: Column, name: str) -> Column:
    if name == "Title":
        found = F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title>", 1)
    else:
        found = F.regexp_extract(html, rf'(?i)<meta\s+name="{META_NAMES[name]}"\s+content="([^"]*)"', 1)
    return F.coalesce(F.nullif(F.trim(decode_entities(found)), F.lit("")), F.lit("N/A"))


def document_metadata(pages: DataFrame) -> DataFrame:
    """Fields of each document's first page, and its page count."""
    fields = F.struct(*[_field(F.col("html"), n).alias(n) for n in FIELDS])
    staged = pages.select("doc_id", "page_no", fields.alias("fields"))
    folded = staged.groupBy("doc_id").agg(F.min_by("fields", "page_no").alias("fields"), F.count("*").alias("Pages"))
    return folded.select("doc_id", "fields.*", "Pages")


def document_links(pages: DataFrame) -> DataFrame:
    """One row per link with its place on the page and how it is shown."""
    listed = pages.select("doc_id", "page_no", F.posexplode_outer(links(F.col("html"))).alias("position", "link"))
    return listed.where("link is not null").withColumns({"external": F.col("link").startswith("http"), "display": link_display(F.col("link"))})


def document_text(pages: DataFrame) -> DataFrame:
    text = visible_text(F.col("html"))
    return pages.select("doc_id", "page_no", F.when(text == "", NO_TEXT).otherwise(text).alias("text"))


def _counted(pages: DataFrame) -> DataFrame:
    return pages.select(
        "doc_id", F.size(html_tables(F.col("html"))).alias("n_tables"), F.size(links(F.col("html"))).alias("n_links"))


def extraction_summary(pages: DataFrame) -> DataFrame:
    """Pages, tables and links per document; the row without a doc_id is the corpus."""
    return _counted(pages).rollup("doc_id").agg(
        F.count("*").alias("pages"), F.sum("n_tables").alias("tables"), F.sum("n_links").alias("links"))


def document_report(pages: DataFrame) -> DataFrame:
    """(doc_id, section_no, text): metadata, one section per page, summary.

    Sections in order make the Markdown report.
    """
    meta = document_metadata(pages)
    rows = [F.concat(F.lit(f"| **{n}** | "), F.col(n).cast("string"), F.lit(" |")) for n in [*FIELDS, "Pages"]]
    opening = meta.select("doc_id", F.lit(0).cast("long").alias("section_no"), F.concat_ws(
        "\n", F.lit("# Document Extraction Report\n\n## Document Metadata\n\n| Field | Value |\n| --- | --- |"),
        *rows, F.lit("\n---\n")).alias("text"))

    text, tables, found = (F.col(c) for c in ("t", "tables", "found"))
    shown_tables = F.array_join(F.transform(tables, lambda t, i: F.concat(
        F.lit("**Table "), (i + 1).cast("string"), F.lit("**\n\n"), table_to_markdown(t), F.lit("\n"))), "\n")
    shown_links = F.array_join(F.transform(found, lambda u: F.concat(F.lit("- "), link_display(u))), "\n")

    def block(title: str, items: Column, shown: Column, empty: str) -> Column:
        heading = F.concat(F.lit(f"### {title} ("), F.size(items).cast("string"), F.lit(" found)\n\n"), shown)
        return F.when(F.size(items) > 0, heading).otherwise(F.lit(f"### {title}\n\n{empty}"))

    staged = pages.select(
        "doc_id", "page_no", visible_text(F.col("html")).alias("t"), html_tables(F.col("html")).alias("tables"),
        links(F.col("html")).alias("found"))
    body = staged.join(meta.select("doc_id", "Pages"), "doc_id").select(
        "doc_id", F.col("page_no").cast("long").alias("section_no"), F.concat_ws(
            "\n\n",
            F.concat(F.lit("## Page "), F.col("page_no").cast("string"), F.lit(" of "), F.col("Pages").cast("string")),
            F.concat(F.lit("### Text\n\n"), F.when(text == "", NO_TEXT).otherwise(text)),
            block("Tables", tables, shown_tables, NO_TABLES), block("Links", found, shown_links, NO_LINKS),
            F.lit("---\n")).alias("text"))
    totals = _counted(pages).groupBy("doc_id").agg(
        F.count("*").alias("pages"), F.sum("n_tables").alias("tables"), F.sum("n_links").alias("links"))
    closing = totals.select("doc_id", F.lit(2**62).alias("section_no"), F.concat_ws(
        "\n", F.lit("## Extraction Summary\n\n| Metric | Count |\n| --- | --- |"),
        *[F.concat(F.lit(f"| Total {n} | "), F.col(n).cast("string"), F.lit(" |")) for n in ("pages", "tables", "links")],
    ).alias("text"))
    return opening.unionByName(body).unionByName(closing)
