"""Registered queries over the line-based text format."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StringType, StructField, StructType

from emberkeep.functions import text as T
from emberkeep.operators import linetext as L
from emberkeep.plans.registry import query
from emberkeep.plans.views import table, view, with_views
from emberkeep.session import work_dir
from emberkeep.sources import linetext as S

QUOTE_SQL = r"""case when regexp_matches({0}, '^$|^(?:true|false|null)$|^[-\d#\s]|\s$|[:,|\t\[\]{{}}"\\\r\n]')
  then '"' || replace(replace(replace(replace(replace({0}, '\', '\\'), '"', '\"'), chr(10), '\n'), chr(13), '\r'), chr(9), '\t') || '"' else {0} end"""
NUMBER_SQL = r"regexp_replace(regexp_replace(printf('%.2f', {0}), '(\.\d*?)0+$', '\1'), '\.$', '')"
ORDER_LINES = f"'  ' || o_orderkey || ', ' || {NUMBER_SQL.format('o_totalprice')} || ', ' || {QUOTE_SQL.format('o_orderpriority')}"
HEAD = "'%lson 1.0' || chr(10) || '%delimiter comma' || chr(10) || '%strict true' || chr(10) || '---' || chr(10)"


@query(f"""
select doc_id, {QUOTE_SQL.format('text')} as value, {QUOTE_SQL.format('left(text, doc_id % 9)')} as short,
  case when regexp_matches(source || case when doc_id % 2 = 0 then ' x' else '' end, '^[A-Za-z_][A-Za-z0-9_.]*$') then source else '"' || source || ' x"' end as key
from documents""")
def line_quote(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    short = F.substring(F.col("text"), F.lit(1), (F.col("doc_id") % 9).cast("int"))
    name = F.concat("source", F.when(F.col("doc_id") % 2 == 0, " x").otherwise(""))
    return docs.select("doc_id", T.line_quote(F.col("text")).alias("value"), T.line_quote(short).alias("short"), T.line_key(name).alias("key"))


@query(f"""select l_orderkey, l_linenumber, {NUMBER_SQL.format('l_extendedprice')} as price, {NUMBER_SQL.format('l_discount')} as discount,
  {NUMBER_SQL.format('-l_quantity')} as negative from lineitem""")
def line_number(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", T.line_number(F.col("l_extendedprice")).alias("price"),
        T.line_number(F.col("l_discount")).alias("discount"), T.line_number(-F.col("l_quantity")).alias("negative"))


@query("""
select o_orderkey, 'long' as key_kind, 'double' as price_kind, 'string' as date_kind, o_orderstatus as status_value, o_orderpriority as unescaped
from orders""")
def line_token(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    tokens = o.select(
        "o_orderkey", T.line_token(F.col("o_orderkey").cast("string")).alias("k"), T.line_token(F.concat(F.col("o_orderkey").cast("string"), F.lit(".25"))).alias("p"),
        T.line_token(F.concat(F.lit('"'), F.col("o_orderkey").cast("string"), F.lit('"'))).alias("d"), T.line_token(F.col("o_orderstatus")).alias("s"),
        T.line_token(T.line_quote(F.col("o_orderpriority"))).alias("u"))
    return tokens.select(
        "o_orderkey", F.col("k.kind").alias("key_kind"), F.col("p.kind").alias("price_kind"), F.col("d.kind").alias("date_kind"),
        F.col("s.value").alias("status_value"), F.col("u.value").alias("unescaped"))


@query(f"""
select o_custkey, 0 as block_no, 'orders[' || count(*) || ']{{o_orderkey, o_totalprice, o_orderpriority}}:' || chr(10) ||
  string_agg({ORDER_LINES}, chr(10) order by o_orderkey) || chr(10) || '---' as text
from orders group by o_custkey""")
def encode_table(spark, sf_dir):
    fields = ["o_orderkey", "o_totalprice", "o_orderpriority"]
    return L.encode_table(table(spark, sf_dir, "orders"), ["o_custkey"], "orders", fields, "o_orderkey")


@query("""
select doc_id, case when doc_id % 10 = 0 then 'tags[0]:' || chr(10) || '---' else 'tags[3]: ' || lang || ', ' || source || ', "' || doc_id || '"' end as line from documents""")
def encode_array(spark, sf_dir):
    tags = F.array("lang", "source", F.col("doc_id").cast("string"))
    held = F.when(F.col("doc_id") % 10 == 0, F.array().cast("array<string>")).otherwise(tags)
    return table(spark, sf_dir, "documents").select("doc_id", L.encode_array(held, "tags", "string").alias("line"))


@query(f"""
select o_orderstatus, {HEAD} || 'orders[' || count(*) || ']{{o_orderkey, o_totalprice, o_orderpriority}}:' || chr(10) ||
  string_agg({ORDER_LINES}, chr(10) order by o_orderkey) || chr(10) || '---' as text
from (select *, (row_number() over (partition by o_orderstatus order by o_orderkey) - 1) // 10000 as b from orders) group by o_orderstatus, b""")
def write_line_table(spark, sf_dir):
    path = work_dir(spark, "line-table")
    orders = table(spark, sf_dir, "orders")
    S.write_line_table(orders, ["o_orderstatus"], "orders", ["o_orderkey", "o_totalprice", "o_orderpriority"], "o_orderkey", path)
    return S.read_line_docs(spark, path)


@query("""
select o_custkey, o_orderkey, o_totalprice, o_orderpriority, '' as error from orders where o_custkey % 7 <> 0
union all select distinct o_custkey, -1, 0.0, '', 'declared 99 rows but got ' || count(*) over (partition by o_custkey) from orders where o_custkey % 7 = 0""")
def read_line_table(spark, sf_dir):
    docs = L.encode_table(table(spark, sf_dir, "orders"), ["o_custkey"], "orders", ["o_orderkey", "o_totalprice", "o_orderpriority"], "o_orderkey")
    damaged = F.when(F.col("o_custkey") % 7 == 0, F.regexp_replace("text", r"\[\d+\]", "[99]")).otherwise(F.col("text"))
    schema = StructType([StructField("o_orderkey", LongType()), StructField("o_totalprice", DoubleType()), StructField("o_orderpriority", StringType())])
    rows, errors = S.read_line_table(docs.withColumn("text", damaged), schema, ["o_custkey"])
    bad = errors.select("o_custkey", F.lit(-1).alias("o_orderkey"), F.lit(0.0).alias("o_totalprice"), F.lit("").alias("o_orderpriority"), "error")
    return rows.withColumn("error", F.lit("")).unionByName(bad)


@query(f"""
select o_orderkey as doc_id, {HEAD} || 'id: ' || o_orderkey || chr(10) || 'status: ' || o_orderstatus || chr(10) || 'tags[2]: a, b' || chr(10)
  || 'cust:' || chr(10) || '  key: ' || o_custkey as text from orders""")
def encode_json_docs(spark, sf_dir):
    return L.encode_json_docs(view(spark, sf_dir, "v9"), "json_text").select("doc_id", "text")


@query("""
with e as (select o_orderkey as k, o_orderstatus as s, list_filter([
  case when o_orderkey % 8 = 0 then 'After line 7: declared 3 but got 2' end,
  case when o_orderkey % 10 = 0 then 'Line 11: missing colon' end,
  case when o_orderkey % 7 = 0 then 'Line 6: indentation is not a multiple of 2' end,
  case when o_orderkey % 9 = 0 then 'Line 9: expected 2 columns but got 3' end], lambda x: x is not null) as errors from orders)
select k as doc_id, array_to_string(list_sort(errors), '; ') as errors,
  case when len(errors) = 0 then '{"id":' || k || ',"status":"' || s || '","rows":[{"k":1,"v":"a"},{"k":2,"v":"b"}]}' else '-' end as json from e""")
def decode_docs(spark, sf_dir):
    got = L.decode_docs(view(spark, sf_dir, "v9"), "doc_id", "lson_text")
    return got.select("doc_id", F.array_join("errors", "; ").alias("errors"), F.coalesce("json", F.lit("-")).alias("json"))


DIAGNOSTICS = """
d as (
  select o_orderkey as doc_id, 6 as line_no, 'WARNING' as severity, 'Trailing space' as message from orders where o_orderkey % 11 = 0
  union all select o_orderkey, 6, 'ERROR', 'Indentation 1 is not a multiple of 2' from orders where o_orderkey % 7 = 0
  union all select o_orderkey, 7, 'ERROR', 'Declared 3 items but counted 2' from orders where o_orderkey % 8 = 0
  union all select o_orderkey, 9, 'ERROR', 'Row has 3 columns, expected 2' from orders where o_orderkey % 9 = 0
  union all select o_orderkey, 11, 'ERROR', 'Missing colon — expected key: value but got: no colon here' from orders where o_orderkey % 10 = 0)"""


@query(f"with {DIAGNOSTICS} select * from d")
def validate_docs(spark, sf_dir):
    return L.validate_docs(view(spark, sf_dir, "v9"), "doc_id", "lson_text")


@query("""
select o_orderkey as doc_id, 7 as block, case when o_orderkey % 8 = 0 then 3 else 2 end as declared, 2 as counted, true as closed from orders""")
def validate_blocks(spark, sf_dir):
    return L.validate_blocks(L.classify_lines(view(spark, sf_dir, "v9"), "doc_id", "lson_text"))


@query(f"""with {DIAGNOSTICS}
select o_orderkey as doc_id, count(severity) filter (severity = 'ERROR') as errors, count(severity) filter (severity = 'WARNING') as warnings,
  count(severity) filter (severity = 'ERROR') = 0 as valid
from orders left join d on d.doc_id = o_orderkey group by o_orderkey""")
def validation_summary(spark, sf_dir):
    v9 = view(spark, sf_dir, "v9")
    return L.validation_summary(L.validate_docs(v9, "doc_id", "lson_text"), v9)


@query(with_views("v9", r"""
with l as (select doc_id, unnest(string_split(lson_text, chr(10))) as raw, generate_subscripts(string_split(lson_text, chr(10)), 1) as line_no from v9)
select doc_id, line_no, length(raw) - length(ltrim(raw)) as spaces, (length(raw) - length(ltrim(raw))) // 2 as depth, trim(raw) as content from l where line_no > 4"""))
def read_doc_lines(spark, sf_dir):
    return L.read_doc_lines(view(spark, sf_dir, "v9"), "doc_id", "lson_text").select("doc_id", "line_no", "spaces", "depth", "content")


@query(with_views("v9", """
with s as (select doc_id % 5 as source, strlen(json_text) as i, strlen(lson_text) as o, len(string_split(lson_text, chr(10))) as l from v9)
select coalesce(source::varchar, '(all)') as source, count(*) as docs, cast(sum(i) as bigint) as bytes_in, cast(sum(o) as bigint) as bytes_out, cast(sum(l) as bigint) as lines,
  round((1 - sum(o)::double / sum(i)) * 100, 6) as savings_pct from s group by rollup(source)"""))
def size_savings(spark, sf_dir):
    v9 = view(spark, sf_dir, "v9").withColumn("source", F.col("doc_id") % 5)
    return L.size_savings(v9, "source", "json_text", "lson_text")


@query("""select o_orderkey as doc_id, strlen('{"id":' || o_orderkey || ',"status":"' || o_orderstatus || '","tags":["a","b"],"cust":{"key":' || o_custkey || '}}') as bytes_in,
  true as passed, '' as failure from orders""")
def roundtrip_audit(spark, sf_dir):
    audit = L.roundtrip_audit(view(spark, sf_dir, "v9"), "doc_id", "json_text")
    return audit.select("doc_id", "bytes_in", "passed", F.coalesce("failure", F.lit("")).alias("failure"))


@query("select count(*) as docs, count(*) as passed, 100.0::double as pass_rate_pct from orders")
def audit_rate(spark, sf_dir):
    return L.audit_rate(L.roundtrip_audit(view(spark, sf_dir, "v9"), "doc_id", "json_text"))


@query("""
select 'tags' as field, count(*) as arrays, 2 * count(*) as elements, false as all_tabular, true as all_primitive, 0 as key_sets, '-' as columns from orders
union all select 'rows', count(*), 2 * count(*), true, false, 1, 'k,v' from orders
union all select 'mixed', count(*), 2 * count(*), false, false, 0, '-' from orders""")
def profile_json_arrays(spark, sf_dir):
    rows = F.format_string('"rows":[{"k":1,"v":"%s"},{"v":"y","k":2}],"mixed":[1,{"k":2}]}', F.col("doc_id"))
    docs = view(spark, sf_dir, "v9").select(F.concat(F.regexp_replace("json_text", r"\}$", ","), rows).alias("json_text"))
    return L.profile_json_arrays(docs, "json_text").withColumn("columns", F.coalesce("columns", F.lit("-")))
