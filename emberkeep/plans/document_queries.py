"""Registered queries over web pages as documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from emberkeep.operators import documents as D
from emberkeep.plans.registry import query
from emberkeep.plans.views import table
from emberkeep.session import work_dir
from emberkeep.sources import documents as S

PAGES = "p as (select page_id // 5 as doc_id, page_id % 5 + 1 as page_no, url, html from pages)"


def _chain(expr: str) -> str:
    for a, b in D.ENTITIES:
        expr = f"replace({expr}, '{a.replace(chr(39), chr(39) * 2)}', '{b.replace(chr(39), chr(39) * 2)}')"
    return expr


HIDDEN = r"(?is)<script\b.*?</script>|<style\b.*?</style>|<!--.*?-->|<title\b.*?</title>"
TEXT_SQL = (
    "regexp_replace(regexp_replace(regexp_replace("
    + _chain(rf"regexp_replace(regexp_replace(regexp_replace(html, '{HIDDEN}', ' ', 'g'), '(?i)<br\s*/?>|</(?:p|h[1-6]|li|div|tr)>', chr(10), 'g'), '<[^>]*>', ' ', 'g')")
    + r", '[ \t]+', ' ', 'g'), ' ?\n[ \n]*', chr(10), 'g'), '^[ \n]+|[ \n]+$', '', 'g')"
)
META_SQL = r"""coalesce(nullif(trim({}), ''), 'N/A')"""
TITLE_SQL = META_SQL.format(_chain(r"regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)"))
AUTHOR_SQL = META_SQL.format(_chain(r"""regexp_extract(html, '(?i)<meta\s+name="author"\s+content="([^"]*)"', 1)"""))
LINKS_SQL = r"""regexp_extract_all(html, '(?i)<a\s[^>]*?href="([^"]*)"', 1)"""


def pages_of(spark, sf_dir):
    """Every five pages of the corpus make one document."""
    pages = table(spark, sf_dir, "pages")
    return pages.select(
        F.floor(F.col("page_id") / 5).alias("doc_id"), (F.col("page_id") % 5 + 1).alias("page_no"), "url", "html")


@query("select page_id, url, length(html) as n_chars from pages")
def read_pages(spark, sf_dir):
    return S.read_pages(spark, f"{sf_dir}/pages.parquet").select("page_id", "url", F.length("html").alias("n_chars"))


@query(f"""
with {PAGES}, f as (select *, {TITLE_SQL} as title, {AUTHOR_SQL} as author from p)
select doc_id, arg_min(title, page_no) as title, arg_min(author, page_no) as author, count(*) as n_pages from f group by doc_id""")
def document_metadata(spark, sf_dir):
    return D.document_metadata(pages_of(spark, sf_dir)).select(
        "doc_id", F.col("Title").alias("title"), F.col("Author").alias("author"), F.col("Pages").alias("n_pages"))


@query(f"""
with {PAGES}, l as (select doc_id, page_no, unnest({LINKS_SQL}) as u, generate_subscripts({LINKS_SQL}, 1) - 1 as position from p)
select doc_id, page_no, position, u like 'http%' as external, case when u like 'http%' then '<' || u || '>' else '[Internal link → ' || u || ']' end as display from l""")
def document_links(spark, sf_dir):
    return D.document_links(pages_of(spark, sf_dir)).select("doc_id", "page_no", "position", "external", "display")


@query(f"""
with {PAGES}, t as (select doc_id, page_no, {TEXT_SQL} as text from p)
select doc_id, page_no, case when text = '' then '{D.NO_TEXT}' else text end as text from t""")
def document_text(spark, sf_dir):
    return D.document_text(pages_of(spark, sf_dir))


@query("""
with n as (select p_brand, p_partkey, row_number() over (partition by p_brand order by p_partkey) as n,
  '| ' || p_partkey || ' | ' || replace(p_name, '|', chr(92) || '|') || ' | ' || case when p_size % 2 = 0 then p_size::varchar else '' end || ' |' as line from part)
select p_brand, case when n = 1 then 0 else 2 end as part, p_partkey, line from n
union all select p_brand, 1, p_partkey, '| --- | --- | --- |' from n where n = 1""")
def table_to_markdown(spark, sf_dir):
    cells = F.array(F.col("p_partkey").cast("string"), F.col("p_name"))
    cells = F.when(F.col("p_size") % 2 == 0, F.concat(cells, F.array(F.col("p_size").cast("string")))).otherwise(cells)
    rows = table(spark, sf_dir, "part").select("p_brand", "p_partkey", cells.alias("cells"))
    lines = D.table_lines(rows, ["p_brand"], ["p_partkey"], "cells")
    return lines.select("p_brand", "position.part", "position.p_partkey", "line")


@query(f"""
with {PAGES}, c as (select doc_id, count(*) as n from p group by doc_id),
t as (select p.doc_id, page_no, n, {TEXT_SQL} as text, {LINKS_SQL} as links from p join c on c.doc_id = p.doc_id)
select doc_id, page_no as section_no, '## Page ' || page_no || ' of ' || n || chr(10) || chr(10) || '### Text' || chr(10) || chr(10)
  || case when text = '' then '{D.NO_TEXT}' else text end || chr(10) || chr(10) || '### Tables' || chr(10) || chr(10) || '{D.NO_TABLES}' || chr(10) || chr(10)
  || case when len(links) > 0 then '### Links (' || len(links) || ' found)' || chr(10) || chr(10) ||
     array_to_string(list_transform(links, lambda u: '- ' || case when u like 'http%' then '<' || u || '>' else '[Internal link → ' || u || ']' end), chr(10))
     else '### Links' || chr(10) || chr(10) || '{D.NO_LINKS}' end || chr(10) || chr(10) || '---' || chr(10) as text from t""")
def document_report(spark, sf_dir):
    report = D.document_report(pages_of(spark, sf_dir))
    return report.where((F.col("section_no") > 0) & (F.col("section_no") < 2**62))


@query(f"""
with {PAGES}, c as (select doc_id, len({LINKS_SQL}) as n from p)
select coalesce(doc_id, -1) as doc_id, count(*) as pages, 0 as tables, cast(sum(n) as bigint) as links from c group by rollup(doc_id)""")
def extraction_summary(spark, sf_dir):
    return D.extraction_summary(pages_of(spark, sf_dir)).withColumn("doc_id", F.coalesce("doc_id", F.lit(-1)))


@query()
def write_markdown_reports(spark, sf_dir):
    path = work_dir(spark, "reports")
    S.write_markdown_reports(pages_of(spark, sf_dir), path, 8)
    lines = spark.read.text(path)
    return lines.agg(F.count("*").alias("n_lines"), F.count_if(F.col("value").startswith("## Page")).alias("n_pages"))
