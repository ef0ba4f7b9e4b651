"""Registered queries over agent checkpoints and lifecycle events."""

from __future__ import annotations

from pyspark.sql import functions as F

from emberkeep.operators import checkpoints as C
from emberkeep.operators.checkpoint_table import merge_into_table
from emberkeep.plans.registry import query
from emberkeep.plans.views import table, view, with_views
from emberkeep.session import work_dir

LIFECYCLE = "event_type in ('registered', 'committed', 'evicted')"
STATUS_SQL = f"""
with f as (
  select subject as agent_id,
    max(case when event_type = 'registered' then at_ms * 4 end) as r,
    max(case when event_type = 'committed' then at_ms * 4 + 1 end) as c,
    max(case when event_type = 'evicted' then at_ms * 4 + 2 end) as e,
    max(case when event_type = 'registered' then size_chars end) as size_bytes, max(at_ms) as updated_ms
  from v6 where {LIFECYCLE} group by subject),
s as (select agent_id, case when c is not null and c > r then case when e > c then 'evicted' else 'committed' end
         when size_bytes > 150 then 'streaming_to_disk' else 'pending' end as status,
       case when e is null or e < r then size_bytes <= 150 else false end as in_memory, size_bytes, updated_ms from f)
"""


def lifecycle(spark, sf_dir):
    return view(spark, sf_dir, "v6").where(LIFECYCLE).select(
        F.col("subject").alias("agent_id"), "event_type", "at_ms", F.col("size_chars").alias("size_bytes"))


def updates(spark, sf_dir, condition="true"):
    return view(spark, sf_dir, "v4").where(condition).select("agent_id", "data", F.col("written_ms").alias("written_at"))


@query(with_views("v4", """
select agent_id, arg_max(data, written_ms) as data, strlen(arg_max(data, written_ms)) as size_bytes,
  min(written_ms) as created_at, max(written_ms) as updated_at from v4 group by agent_id"""))
def upsert_checkpoints(spark, sf_dir):
    first = C.upsert_checkpoints(None, updates(spark, sf_dir, "turn < 3"))
    return C.upsert_checkpoints(first, updates(spark, sf_dir, "turn >= 3"))


@query(with_views("v4", """
select agent_id, arg_max(data, written_ms) as data, strlen(arg_max(data, written_ms)) as size_bytes,
  min(written_ms) as created_at, max(written_ms) as updated_at from v4 group by agent_id"""))
def upsert_checkpoint_table(spark, sf_dir):
    path = work_dir(spark, "checkpoints")
    for part in ("turn < 3", "turn >= 3"):
        rows = updates(spark, sf_dir, part).select("agent_id", "data", F.col("written_at").alias("created_at"), F.col("written_at").alias("updated_at"))
        stored = merge_into_table(spark, path, rows, part.replace(" ", ""), buckets=16)
    return stored


@query("""
select doc_id, strlen(text) as size_bytes, case when strlen(text) > 4000 then 'streaming_to_disk' else 'pending' end as status,
  strlen(text) <= 4000 as in_memory from documents""")
def route_payload(spark, sf_dir):
    routed = C.route_payload(table(spark, sf_dir, "documents"), "text", 4_000)
    return routed.select("doc_id", "size_bytes", "status", "in_memory")


@query(with_views("v4", """
with c as (select agent_id, arg_max(data, written_ms) as data from v4 group by agent_id),
w as (select distinct conv_id || ':' || r as agent_id from conversations, (values ('user'), ('critic')) as t(r))
select w.agent_id, coalesce(data, '(none)') as data from w left join c on w.agent_id = c.agent_id"""))
def get_many(spark, sf_dir):
    stored = C.upsert_checkpoints(None, updates(spark, sf_dir))
    ids = table(spark, sf_dir, "conversations").select(
        F.explode(F.array(F.concat("conv_id", F.lit(":user")), F.concat("conv_id", F.lit(":critic")))).alias("agent_id")).distinct()
    return C.get_many(stored, ids).select("agent_id", F.coalesce("data", F.lit("(none)")).alias("data"))


@query(with_views("v4", """
with c as (select agent_id, arg_max(data, written_ms) as data from v4 group by agent_id),
k as (select distinct conv_id from conversations)
select k.conv_id as consumer_id,
  'user=' || coalesce((select data from c where agent_id = k.conv_id || ':user'), 'null')
  || '; critic=' || coalesce((select data from c where agent_id = k.conv_id || ':critic'), 'null') as inputs
from k"""))
def inject_upstream(spark, sf_dir):
    stored = C.upsert_checkpoints(None, updates(spark, sf_dir))
    wants = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("consumer_id")).distinct().withColumn(
        "depends_on", F.array(F.concat("consumer_id", F.lit(":user")), F.concat("consumer_id", F.lit(":critic"))))
    got = C.inject_upstream(wants, stored)
    shown = F.transform(F.map_entries("inputs"), lambda e: F.concat(
        F.split_part(e["key"], F.lit(":"), F.lit(2)), F.lit("="), F.coalesce(e["value"], F.lit("null"))))
    return got.select("consumer_id", F.array_join(shown, "; ").alias("inputs"))


@query(with_views("v6", STATUS_SQL + "select * from s"))
def current_status(spark, sf_dir):
    return C.current_status(lifecycle(spark, sf_dir), 150)


@query(with_views("v6", STATUS_SQL + """
select count(*) as total, count(*) filter (in_memory) as in_memory, count(*) filter (not in_memory) as on_disk_only,
  count(*) filter (status = 'pending') as pending, count(*) filter (status = 'committed') as committed,
  count(*) filter (status = 'streaming_to_disk') as streaming, count(*) filter (status = 'evicted') as evicted from s"""))
def snapshot_summary(spark, sf_dir):
    return C.snapshot_summary(C.current_status(lifecycle(spark, sf_dir), 150))


@query(with_views("v6", """
with r as (select subject as agent_id, at_ms as registered_ms from v6 where event_type = 'registered'),
m as (select agent_id, registered_ms, (select min(at_ms) from v6 where event_type = 'committed' and subject = agent_id and at_ms >= registered_ms) as committed_ms from r)
select agent_id, registered_ms, coalesce(committed_ms, -1) as committed_ms, committed_ms is null as pending,
  coalesce(committed_ms, 1704200000000) - registered_ms as wait_ms from m"""))
def pending_writes(spark, sf_dir):
    waits = C.pending_writes(lifecycle(spark, sf_dir), 1_704_200_000_000)
    return waits.withColumn("committed_ms", F.coalesce("committed_ms", F.lit(-1)))


@query(with_views("v4", """
select agent_id, 0 as row_no, string_agg(data, chr(10) order by turn) as output
from v4 where data <> '' group by agent_id"""))
def checkpoint_outputs(spark, sf_dir):
    turns = view(spark, sf_dir, "v4").select("agent_id", "turn", F.col("data").alias("text"))
    return C.checkpoint_outputs(turns, "turn")


@query()
def compression_report(spark, sf_dir):
    return C.compression_report(table(spark, sf_dir, "documents"), "text", ["source"])


@query("select doc_id, strlen(text) as original_bytes, true as same, '' as error from documents")
def compress_payload(spark, sf_dir):
    packed = table(spark, sf_dir, "documents").withColumn("packed", C.compress_payload(F.col("text"), 6))
    opened = packed.withColumn("opened", C.decompress_payload(F.col("packed")))
    return opened.select(
        "doc_id", F.octet_length("opened.data").alias("original_bytes"),
        (F.col("opened.data") == F.col("text").cast("binary")).alias("same"),
        F.coalesce("opened.error", F.lit("")).alias("error"))
