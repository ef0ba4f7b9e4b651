"""Registered streams: each runs over a whole table and returns its sink."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from emberkeep.plans.log_queries import HOOKS
from emberkeep.plans.registry import query
from emberkeep.plans.views import EPOCH_MS, VIEWS, table, view, with_views
from emberkeep.streaming import streams as S
from emberkeep.streaming.runner import run_to_table, sliced_stream, table_stream


CLOSING_AT = "2100-01-01 00:00:00"


def stream_view(spark, sf_dir, name: str, source: str):
    """A derived view over a streamed table."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    table_stream(spark, sf_dir, source).createOrReplaceTempView(source)
    return spark.sql(VIEWS[name])


def log_stream(spark, sf_dir, *columns: str, **closing):
    """The columns of the log in three micro-batches by time, and a closing event that lets the last windows close."""
    log = view(spark, sf_dir, "v3").withColumn("ts", F.col("ts").cast("timestamp")).select("ts", *columns)
    end = {"ts": datetime.fromisoformat(CLOSING_AT), **closing} if closing else None
    return sliced_stream(log, "ts", end)


TTL_MS = "event_id % 5 * 21600000"  # of each put its own, none for every fifth
MS = "epoch_us({}) // 1000"


def puts_of(log):
    return log.where("operation = 'PUT'").select(F.col("lookup_key").alias("key"), F.col("event_id").alias("value"), "ts", F.expr(TTL_MS).alias("ttl_ms"))


def ms(column: str):
    return F.unix_millis(column).alias(column)


# Every put with its end; a life goes on while the next put is no later than the end of the one before.
LIVES = f"""
p as (select lookup_key as key, event_id as value, ts, case when {TTL_MS} > 0 then ts + to_milliseconds({TTL_MS}) end as due from v3 where operation = 'PUT'),
g as (select *, case when ts <= coalesce(lag(due) over w, case when lag(ts) over w is not null then ts end) then 0 else 1 end as fresh,
  lead(ts) over w as follows from p window w as (partition by key order by ts)),
l as (select *, sum(fresh) over (partition by key order by ts rows unbounded preceding) as n from g),
lives as (select key, arg_max(value, ts) as value, count(*) as puts, min(ts) as f, max(ts) as t, arg_max(coalesce(epoch_us(due) // 1000, 0), ts) as due_ms,
  bool_or(follows is null) as newest from l group by key, n)"""


@query(with_views("v3", f"""
with {LIVES}
select key, value::varchar as value, puts, {MS.format('f')} as first_put_ms, {MS.format('t')} as put_ms, due_ms as expires_ms, not (due_ms > 0 and due_ms <= w) as live
from lives, (select epoch_us(max(ts) - interval 1 hour) // 1000 as w from p) where newest or due_ms between 1 and w"""))
def ttl_table_stream(spark, sf_dir):
    log = log_stream(spark, sf_dir, "operation", "lookup_key", "event_id")
    return S.ttl_table_stream(puts_of(log), "1 hour")


@query(with_views("v3", f"""
with {LIVES}
select due_ms // 86400000 * 86400000 as from_at, count(*) as expired from lives where due_ms > 0 group by 1"""))
def expiry_counts_stream(spark, sf_dir):
    log = log_stream(spark, sf_dir, "operation", "lookup_key", "event_id", operation="PUT", lookup_key="closing", event_id=0)
    counts = S.expiry_counts_stream(puts_of(log), "1 day", "1 hour")
    return run_to_table(counts, "expiry").select(ms("from_at"), "expired")


@query(with_views("v4", """
select agent_id, arg_max(data, written_ms) as data, strlen(arg_max(data, written_ms)) as size_bytes,
  min(written_ms) as created_at, max(written_ms) as updated_at from v4 group by agent_id"""))
def write_behind_stream(spark, sf_dir):
    updates = stream_view(spark, sf_dir, "v4", "conversations").select("agent_id", "data", F.col("written_ms").alias("written_at"))
    return S.write_behind_stream(updates)


def lifecycle_of(conversations):
    """Registered, committed and evicted events, exploded from each turn."""
    at = EPOCH_MS + F.col("conv_id") * 600_000 + F.col("turn") * 60_000
    seed = F.col("conv_id") * 7 + F.col("turn")

    def event(name, when, keep):
        return F.when(keep, F.struct(F.lit(name).alias("event_type"), when.alias("at_ms")))

    events = F.array_compact(F.array(
        event("registered", at, F.lit(True)), event("committed", at + seed % 5 * 1000 + 500, seed % 11 != 0),
        event("evicted", at + 2750, (F.col("conv_id") + F.col("turn")) % 3 == 0)))
    return conversations.select(
        F.concat_ws(":", "conv_id", "role", "turn").alias("agent_id"), F.explode(events).alias("e"), F.length("text").alias("size_bytes")
    ).select("agent_id", "e.event_type", "e.at_ms", "size_bytes")


@query(with_views("v6", """
with f as (
  select subject as agent_id, max(case when event_type = 'registered' then at_ms * 4 end) as r, max(case when event_type = 'committed' then at_ms * 4 + 1 end) as c,
    max(case when event_type = 'evicted' then at_ms * 4 + 2 end) as e, max(case when event_type = 'registered' then size_chars end) as size_bytes, max(at_ms) as updated_ms
  from v6 where event_type in ('registered', 'committed', 'evicted') group by subject)
select agent_id, case when c > r then case when e > c then 'evicted' else 'committed' end when size_bytes > 150 then 'streaming_to_disk' else 'pending' end as status,
  e is null and size_bytes <= 150 as in_memory, size_bytes, updated_ms from f"""))
def status_stream(spark, sf_dir):
    events = lifecycle_of(table(spark, sf_dir, "conversations"))
    by_time = sliced_stream(events.withColumn("at", F.timestamp_millis("at_ms")), "at")
    return S.status_stream(by_time, 150)


@query(with_views("v3", f"""
with g as (select lookup_key, ts, lag(ts) over (partition by lookup_key order by ts) as prev from v3 where operation = 'GET'),
b as (select *, count(*) filter (prev is null or ts >= prev + interval 10 minute) over (partition by lookup_key order by ts rows unbounded preceding) as burst from g),
r as (select lookup_key, min(ts) as s, max(ts) as e, count(*) as reads from b group by lookup_key, burst)
select lookup_key, {MS.format('s')} as at_ms, reads from r"""))
def coalesce_requests(spark, sf_dir):
    first = S.coalesce_requests(log_stream(spark, sf_dir, "operation", "lookup_key", operation="GET", lookup_key="closing").where("operation = 'GET'"), ["lookup_key"], "10 minutes")
    return run_to_table(first, "coalesce").select("lookup_key", ms("ts").alias("at_ms"), "reads")


@query(with_views("v3", f"""
with c as (select user_id, operation, time_bucket(interval 1 day, ts) as w, count(*) as requests from v3 group by 1, 2, 3)
select user_id, operation, {MS.format('w')} as from_at, requests, requests - case operation when 'GET' then 1 else 2 end as over_limit
from c where requests > case operation when 'GET' then 1 when 'PUT' then 2 end"""))
def rate_limit_stream(spark, sf_dir):
    over = S.rate_limit_stream(log_stream(spark, sf_dir, "operation", "user_id", operation="GET"), {"GET": 1, "PUT": 2}, "1 hour", "1 day")
    return run_to_table(over, "rates").select("user_id", "operation", ms("from_at"), "requests", "over_limit")


@query(with_views("v3", f"""
with f as (select remote_addr, time_bucket(interval 1 day, ts) as w, count(*) as failures from v3 where status = 500 group by 1, 2)
select remote_addr, {MS.format('w')} as from_at, failures from f where failures > 1"""))
def auth_failure_stream(spark, sf_dir):
    refused = log_stream(spark, sf_dir, "status", "remote_addr", status=500).withColumn("status", F.when(F.col("status") == 500, 401).otherwise(F.col("status")))
    return run_to_table(S.auth_failure_stream(refused, "1 hour", 1, "1 day"), "auth").select("remote_addr", ms("from_at"), "failures")


@query(with_views("v3", f"""
with w as (select v3.*, time_bucket(interval 6 hour, ts) - interval 6 hour * k as s from v3, (values (0), (1)) as t(k)),
a as (select s, count(*) as requests, quantile_disc(duration_ms, 0.99) as p99_ms, avg(case when status >= 400 then 1.0 else 0.0 end) as er, avg(case when is_hit then 1.0 else 0.0 end) as hr,
  avg(case when operation = 'GET' and status = 404 then 1.0 else 0.0 end) as ff from w group by s)
select {MS.format('s')} as from_at, requests, round(p99_ms, 6) as p99_ms, round(er, 6) as error_rate, round(hr, 6) as hit_rate, p99_ms > 500 as slow, er > 0.01 as failing, hr < 0.9 as cold, ff > 0.005 as missing
from a"""))
def slo_stream(spark, sf_dir):
    log = log_stream(spark, sf_dir, "duration_ms", "status", "is_hit", "operation", duration_ms=0.0, status=200, is_hit=True, operation="GET")
    seen = run_to_table(S.slo_stream(log, "1 hour", "12 hours", "6 hours"), "slo")
    return seen.select(
        ms("from_at"), "requests", *[F.round(c, 6).alias(c) for c in ("p99_ms", "error_rate", "hit_rate")], "slow", "failing", "cold", "missing")


@query(with_views("v3", f"""
with g as (select *, case when ts >= lag(ts) over w + interval 6 hour or lag(ts) over w is null then 1 else 0 end as fresh from v3 window w as (partition by user_id order by ts)),
s as (select *, sum(fresh) over (partition by user_id order by ts rows unbounded preceding) as n from g),
a as (select user_id, min(ts) as f, max(ts) + interval 6 hour as e, count(*) filter (is_hit) as hits, count(*) filter (not is_hit) as misses from s group by user_id, n)
select user_id, {MS.format('f')} as from_at, {MS.format('e')} as to_at, hits, misses from a"""))
def session_stream(spark, sf_dir):
    log = log_stream(spark, sf_dir, "user_id", "is_hit", is_hit=True)
    sessions = run_to_table(S.session_stream(log, "6 hours", "1 hour"), "sessions")
    return sessions.select("user_id", ms("from_at"), ms("to_at"), "hits", "misses")


@query(with_views("v6", """
with r as (select subject, at_ms from v6 where event_type = 'registered'), c as (select subject, at_ms from v6 where event_type = 'committed')
select r.subject as agent_id, r.at_ms as registered_ms, coalesce(c.at_ms - r.at_ms, -1) as latency_ms, c.at_ms is null as pending
from r left join c on c.subject = r.subject and c.at_ms between r.at_ms and r.at_ms + 3000"""))
def commit_latency_stream(spark, sf_dir):
    events = lifecycle_of(table(spark, sf_dir, "conversations"))

    def side(event, name):
        rows = events.where(F.col("event_type") == event).select("agent_id", F.timestamp_millis("at_ms").alias(name))
        return sliced_stream(rows, name, {"agent_id": f"closing {event}", name: datetime.fromisoformat(CLOSING_AT)})

    joined = S.commit_latency_stream(side("registered", "registered_at"), side("committed", "committed_at"), "3 seconds", "10 minutes")
    done = run_to_table(joined, "latency").where(F.col("registered_at") < F.lit(CLOSING_AT).cast("timestamp"))
    return done.select("agent_id", F.unix_millis("registered_at").alias("registered_ms"), F.coalesce("latency_ms", F.lit(-1)).alias("latency_ms"), "pending")


@query(with_views("v1 v3", """
with c as (select 'label:' || event_id % 12 as namespace, max(1704067200000 + event_id * 3000) as at_ms from v3 where operation = 'PUT' and event_id % 12 <> 11 group by 1),
g as (select max(1704067200000 + event_id * 300) as at_ms from v3 where operation = 'PUT' and event_id % 12 = 11)
select v1.id, v1.namespace from v1 left join c on c.namespace = v1.namespace where inserted_ms > coalesce(c.at_ms, -1) and inserted_ms > (select at_ms from g)"""))
def invalidation_stream(spark, sf_dir):
    number = F.col("event_id")
    changes = stream_view(spark, sf_dir, "v3", "events").where("operation = 'PUT'").select(
        F.when(number % 12 != 11, F.concat(F.lit("label:"), (number % 12).cast("string"))).alias("namespace"),
        F.when(number % 12 != 11, EPOCH_MS + number * 3000).otherwise(EPOCH_MS + number * 300).alias("at_ms"))
    return S.invalidation_stream(changes, view(spark, sf_dir, "v1").select("id", "namespace", "inserted_ms")).select("id", "namespace")


@query(with_views("v5", """
select 'h1' as hook_id, 'artefact.' || status as event, id as artefact_id, published_ms as at_ms from v5 where status in ('verified', 'deprecated')"""))
def event_fanout_stream(spark, sf_dir):
    hooks = spark.createDataFrame(HOOKS, "hook_id string, events array<string>, enabled boolean, secret string")
    events = stream_view(spark, sf_dir, "v5", "documents").select(
        F.concat(F.lit("artefact."), "status").alias("event"), F.col("id").alias("artefact_id"), F.col("published_ms").alias("at_ms"))
    return run_to_table(S.event_fanout_stream(events, hooks), "fanout", ["hook_id"])
