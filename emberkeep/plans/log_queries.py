"""Registered queries over request, usage and interaction logs."""

from __future__ import annotations

from pyspark.sql import functions as F

from emberkeep.functions import codes, security
from emberkeep.operators import governance as G
from emberkeep.operators import logs as L
from emberkeep.operators.scan import scan_rules
from emberkeep.plans.artefact_queries import versions
from emberkeep.plans.registry import query
from emberkeep.plans.scan_queries import RULES_SQL
from emberkeep.plans.views import table, view, with_views
from emberkeep.session import work_dir
from emberkeep.sources import entries as E
from emberkeep.sources import logs as S

NOW = 1_704_067_200_000 + 40 * 86_400_000
NOW_TS = "timestamp '2024-02-10 00:00:00'"


def log8(spark, sf_dir):
    return view(spark, sf_dir, "v8").withColumn("ts", F.col("ts").cast("timestamp"))


def log3(spark, sf_dir):
    return view(spark, sf_dir, "v3").withColumn("ts", F.col("ts").cast("timestamp"))


def fetches(spark, sf_dir):
    return view(spark, sf_dir, "v6").where("event_type = 'artefact.fetch'").select(
        F.col("subject").alias("artefact_id"), "at_ms")


# --- sources ------------------------------------------------------------------


@query("""
select 'vec:' || vec_id as id, len(embedding) as dimension, round(list_sum(embedding::double[]), 4) as total, case when vec_id % 2 = 0 then 'label:' || label else '-' end as namespace,
  'title=vec ' || vec_id as metadata, '' as error from embeddings where vec_id % 9 <> 0
union all select 'vec:' || vec_id, 0, 0, '-', '', 'EMBEDDING_REQUIRED' from embeddings where vec_id % 9 = 0""")
def read_entry_requests(spark, sf_dir):
    vec = F.col("vec_id")
    body = F.to_json(F.struct(
        F.when(vec % 9 != 0, F.col("embedding")).alias("embedding"),
        F.when(vec % 2 == 0, F.concat(F.lit("label:"), "label")).alias("namespace"),
        F.concat(F.lit("vec "), vec.cast("string")).alias("title"), vec.alias("number")))
    good, bad = E.read_entry_requests(table(spark, sf_dir, "embeddings").select(F.concat(F.lit("vec:"), vec.cast("string")).alias("key"), body.alias("body")))
    total = F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x.cast("double"))
    shown = F.transform(F.map_entries("metadata"), lambda e: F.concat_ws("=", e["key"], e["value"]))
    rows = good.select(
        "id", F.size("embedding").alias("dimension"), F.round(total, 4).alias("total"), F.coalesce("namespace", F.lit("-")).alias("namespace"),
        F.array_join(shown, ",").alias("metadata"), F.lit("").alias("error"))
    rejected = bad.select("id", F.lit(0).alias("dimension"), F.lit(0.0).alias("total"), F.lit("-").alias("namespace"), F.lit("").alias("metadata"), "error")
    return rows.unionByName(rejected)


@query(with_views("v3", """
select operation, case when event_id % 4 = 0 then '-' else lookup_key end as key, status, cast(floor(duration_ms) as bigint) as duration_ms, remote_addr, strftime(ts, '%Y-%m-%d') as day,
  epoch_us(ts) // 1000 as at_ms from v3"""))
def read_access_log(spark, sf_dir):
    path = work_dir(spark, "access-log")
    rows = log3(spark, sf_dir).select(
        F.col("ts").alias("timestamp"), F.lit("GET").alias("method"), F.lit("/cache").alias("path"),
        F.when(F.col("event_id") % 4 != 0, F.col("lookup_key")).alias("key"), "operation", "status",
        F.floor("duration_ms").alias("duration_ms"), "remote_addr")
    S.write_access_log(rows, path)
    return S.read_access_log(spark, path).select(
        "operation", "key", "status", "duration_ms", "remote_addr", F.col("day").cast("string").alias("day"), F.unix_millis("timestamp").alias("at_ms"))


@query(with_views("v3", """
select 'req_' || event_id as request_id, status, cast(floor(duration_ms) as bigint) as latency_ms, 'u' || user_id as user_id, is_hit as cache_hit, epoch_us(ts) // 1000 as at_ms from v3"""))
def read_api_log(spark, sf_dir):
    path = work_dir(spark, "api-log")
    log3(spark, sf_dir).select(
        F.col("ts").alias("timestamp"), F.lit("info").alias("level"), F.concat(F.lit("req_"), "event_id").alias("requestId"), F.lit("GET").alias("method"),
        F.lit("/api").alias("path"), "status", F.floor("duration_ms").alias("latencyMs"), F.concat(F.lit("u"), "user_id").alias("userId"),
        F.lit("org").alias("orgId"), F.col("is_hit").alias("cacheHit")).write.json(path)
    return S.read_api_log(spark, path).select(
        F.col("requestId").alias("request_id"), "status", F.col("latencyMs").alias("latency_ms"), F.col("userId").alias("user_id"),
        F.col("cacheHit").alias("cache_hit"), F.unix_millis("timestamp").alias("at_ms"))


@query(with_views("v6", """
select event_type as action, cast(at_ms as bigint) as at_ms, strftime(epoch_ms(at_ms), '%Y-%m-%d') as day, 'artefact_id=' || subject || ',user_id=u' || at_ms % 7 as metadata
from v6"""))
def append_audit(spark, sf_dir):
    path = work_dir(spark, "audit")
    actions = view(spark, sf_dir, "v6").select(
        F.col("event_type").alias("action"), F.timestamp_millis("at_ms").alias("created_at"), F.col("subject").alias("artefact_id"),
        F.concat(F.lit("u"), F.col("at_ms") % 7).alias("user_id"))
    S.append_audit(actions, path)
    shown = F.transform(F.array_sort(F.map_entries("metadata")), lambda e: F.concat_ws("=", e["key"], e["value"]))
    return spark.read.parquet(path).select(
        "action", F.unix_millis("created_at").alias("at_ms"), F.col("day").cast("string").alias("day"), F.array_join(shown, ",").alias("metadata"))


# --- request and usage logs ---------------------------------------------------


@query(with_views("v3", """
select operation, count(*) as requests, round(count(*) * 60.0 / (floor(epoch(max(ts))) - floor(epoch(min(ts)))), 6) as per_minute,
  round(avg(case when status >= 400 then 1.0 else 0.0 end), 6) as error_rate, round(avg(case when is_hit then 1.0 else 0.0 end), 6) as hit_ratio,
  round(quantile_cont(duration_ms, 0.5), 6) as p50, round(quantile_cont(duration_ms, 0.95), 6) as p95, round(quantile_cont(duration_ms, 0.99), 6) as p99
from v3 group by operation"""))
def request_metrics(spark, sf_dir):
    return L.request_metrics(log3(spark, sf_dir), "operation", "duration_ms", "status", F.col("is_hit"))


@query(with_views("v3", """
select operation, case status when 500 then 'INTERNAL_ERROR' when 429 then 'RATE_LIMITED' when 404 then 'NOT_FOUND' end as code, count(*) as errors
from v3 where status >= 400 group by 1, 2"""))
def error_breakdown(spark, sf_dir):
    return L.error_breakdown(log3(spark, sf_dir), "operation", "status")



@query(with_views("v5 v6", f"""
with r as (select * from v6 where event_type = 'artefact.fetch' and at_ms >= {NOW} - 30 * 86400000::bigint),
s as (select doc_id, doc_id % 5 <> 0 as passed, 100 - doc_id % 50 as score from documents where doc_id % 60 <= 30)
select 'by_type' as section, type as key, count(*)::double as value from v5 group by type
union all select 'by_status', status, count(*) from v5 group by status
union all select 'total', 'artefacts', count(*) from v5
union all select 'usage', 'fetches_last_30_days', count(*) from r
union all select * from (select 'top_artefacts', subject, count(*) from r group by subject order by count(*) desc, subject limit 10)
union all select 'security', 'scans', count(*) from s union all select 'security', 'blocked', count(*) filter (not passed) from s
union all select 'security', 'avg_risk_score', round(avg(score), 6) from s"""))
def org_stats(spark, sf_dir):
    d = F.col("doc_id")
    scans = table(spark, sf_dir, "documents").select(
        (d % 5 != 0).alias("passed"), (100 - d % 50).alias("score"), (F.lit(NOW) - (d % 60) * 86_400_000).alias("at_ms"))
    return L.org_stats(versions(spark, sf_dir), fetches(spark, sf_dir), scans, NOW)


@query(with_views("v5 v6", f"""
with f as (select subject, at_ms // 250000 % 90 as consumer from v6 where event_type = 'artefact.fetch'),
a as (select *, ({NOW} - published_ms) / 86400000.0 as age from v5)
select 'fetches_by_namespace' as section, split_part(subject, '/', 1) as key, count(*)::double as value from f group by 2
union all select 'models', model, count(*) from v5 group by model
union all select 'artefact_age', case when age < 1 then '<1d' when age < 7 then '<7d' when age < 30 then '<30d' when age < 90 then '<90d' else '>=90d' end, count(*) from a group by 2
union all select 'review_queue', namespace, count(*) from v5 where status = 'review' group by namespace
union all select 'consumers', 'distinct', count(distinct consumer) from f"""))
def usage_analytics(spark, sf_dir):
    used = fetches(spark, sf_dir).withColumn("consumer", F.floor(F.col("at_ms") / 250000) % 90)
    return L.usage_analytics(used, versions(spark, sf_dir), NOW)


@query(with_views("v5 v6", """
with f as (select subject as artefact_id, at_ms from v6 where event_type = 'artefact.fetch'),
p as (select id, published_ms, version from v5 where status = 'verified')
select cast(f.at_ms as varchar) as fetch_id, f.artefact_id, f.at_ms, coalesce(p.version, '-') as latest, coalesce(p.published_ms, -1) as promoted_ms
from f asof left join p on f.artefact_id = p.id and f.at_ms >= p.published_ms"""))
def latest_asof(spark, sf_dir):
    promoted = versions(spark, sf_dir).where("status = 'verified'").select(F.col("id").alias("artefact_id"), F.col("published_ms").alias("at_ms"), "version")
    got = L.latest_asof(fetches(spark, sf_dir).withColumn("fetch_id", F.col("at_ms")), promoted)
    return got.withColumns({"latest": F.coalesce("latest", F.lit("-")), "promoted_ms": F.coalesce("promoted_ms", F.lit(-1))})


@query(with_views("v5 v6", """
with f as (select subject as id, at_ms, case when at_ms % 3 = 0 then '9.9.9' when at_ms // 250000 % 2 = 0 then '1.0.0' else '2.0.0' end as version from v6 where event_type = 'artefact.fetch')
select f.id, f.at_ms, f.version, case when status is null then 'NOT_FOUND' when status = 'deprecated' then 'DEPRECATED' else 'OK' end as outcome,
  case when status = 'deprecated' then '2.1.0' else '-' end as successor
from f left join v5 on v5.id = f.id and v5.version = f.version"""))
def fetch_health(spark, sf_dir):
    at = F.col("at_ms")
    version = F.when(at % 3 == 0, "9.9.9").when(F.floor(at / 250000) % 2 == 0, "1.0.0").otherwise("2.0.0")
    asked = fetches(spark, sf_dir).select(F.col("artefact_id").alias("id"), at, version.alias("version"))
    got = L.fetch_health(asked, versions(spark, sf_dir).withColumn("successor", F.lit("2.1.0")))
    return got.withColumn("successor", F.coalesce("successor", F.lit("-")))


HOOKS = [("h1", ["artefact.verified", "artefact.deprecated"], True, "s1"), ("h2", ["artefact.fetch"], False, "s2")]
PAYLOAD = """'{"event":"' || event_type || '","at_ms":' || at_ms || ',"artefact":{"id":"' || subject || '"}}'"""


def _xor_hex_sql(hex_sql: str, pad: str) -> str:
    """A pad byte XORed with each byte of a key in hex, digit by digit."""
    upper, lower = security.PADS[pad]
    return f"""unhex(array_to_string(list_transform(range(1, 128, 2), lambda i: translate({hex_sql}[i], '{security.HEX}', '{upper}') || translate({hex_sql}[i + 1], '{security.HEX}', '{lower}')), ''))"""


@query(with_views("v6", f"""
with hooks as (
  select c_custkey, 'h' || c_custkey as hook_id, rpad(hex(encode('secret-' || c_custkey || repeat('x', (c_custkey % 40)::int))), 128, '0') as k,
    case c_custkey % 24 when 0 then 'artefact.verified' when 1 then 'artefact.deprecated' when 2 then 'artefact.published' else 'customer.' || c_custkey end as event
  from customer where c_custkey % 5 <> 0
), pads as (select hook_id, event, {_xor_hex_sql('k', 'inner')} as inner_pad, {_xor_hex_sql('k', 'outer')} as outer_pad from hooks),
signed as (select hook_id, event, subject as artefact_id, {PAYLOAD} as payload, inner_pad, outer_pad from v6 join pads on event = event_type)
select hook_id, event, artefact_id, payload, 'hmac:' || sha256(outer_pad || unhex(sha256(inner_pad || encode(payload)))) as signature from signed"""))
def match_webhooks(spark, sf_dir):
    key, no = F.col("c_custkey").cast("string"), F.col("c_custkey") % 24
    event = F.when(no == 0, "artefact.verified").when(no == 1, "artefact.deprecated").when(no == 2, "artefact.published").otherwise(F.concat(F.lit("customer."), key))
    hooks = table(spark, sf_dir, "customer").select(
        F.concat(F.lit("h"), key).alias("hook_id"), F.array(event, F.lit("never")).alias("events"), (F.col("c_custkey") % 5 != 0).alias("enabled"),
        F.concat(F.lit("secret-"), key, F.repeat(F.lit("x"), (F.col("c_custkey") % 40).cast("int"))).alias("secret"))
    events = view(spark, sf_dir, "v6").select(F.col("event_type").alias("event"), F.col("subject").alias("artefact_id"), "at_ms")
    return L.match_webhooks(events, hooks).select("hook_id", "event", "artefact_id", "payload", "signature")


@query(with_views("v5", f"""
with s as (select *, published_ms + case when doc_id % 5 = 1 then 90000000 else 0 end as since_ms from v5 where status = 'review')
select id, version, namespace, {NOW} - since_ms as age_ms, rank() over w as age_rank, round(percent_rank() over w, 6) as age_percent_rank,
  count(*) over (partition by namespace) as queue_depth
from s window w as (partition by namespace order by since_ms)"""))
def review_queue_age(spark, sf_dir):
    v = versions(spark, sf_dir).select("doc_id", "id", "version", "namespace", "status", "published_ms")
    moved = v.where("doc_id % 5 = 1").select("id", "version", F.explode(F.array(F.lit(1000), F.lit(90_000_000))).alias("later"), "published_ms")
    changes = moved.select("id", "version", (F.col("published_ms") + F.col("later")).alias("at_ms"))
    return L.review_queue_age(L.status_since(v, changes), NOW).select("id", "version", "namespace", "age_ms", "age_rank", "age_percent_rank", "queue_depth")


@query(with_views("v3 v6", """
select 'fetch' as source, subject as target, at_ms, '-' as operation from v6 where event_type like 'artefact.%'
union all select 'access', lookup_key, epoch_us(ts) // 1000, operation from v3"""))
def merge_logs(spark, sf_dir):
    a = view(spark, sf_dir, "v6").where("event_type like 'artefact.%'").select(F.lit("fetch").alias("source"), F.col("subject").alias("target"), "at_ms")
    b = log3(spark, sf_dir).select(F.lit("access").alias("source"), F.col("lookup_key").alias("target"), F.unix_millis("ts").alias("at_ms"), "operation")
    return L.merge_logs(a, b).withColumn("operation", F.coalesce("operation", F.lit("-")))


@query(with_views("v8", f"""
select event_id, project_id, pii_detected, case when ts >= {NOW_TS} - interval 20 day then tool_name else '-' end as tool_name from v8
where ts >= {NOW_TS} - interval 30 day and (tier < 3 or ts >= {NOW_TS} - interval 25 day)"""))
def retain_log(spark, sf_dir):
    now = F.expr(NOW_TS)
    log = log8(spark, sf_dir).withColumn("class", F.when(F.col("tier") < 3, "standard").otherwise("short"))
    kept = L.retain_log(log, "ts", now, "class", {"standard": 40, "short": 25})
    blanked = L.retain_fields(kept, "ts", now, {"tool_name": 20, "pii_detected": 30})
    return blanked.select("event_id", "project_id", "pii_detected", F.coalesce("tool_name", F.lit("-")).alias("tool_name"))


@query(with_views("v3", """
select event_id, case status when 500 then 'INTERNAL_ERROR' when 429 then 'RATE_LIMITED' when 404 then 'NOT_FOUND' else '-' end as code from v3"""))
def error_code(spark, sf_dir):
    return view(spark, sf_dir, "v3").select("event_id", F.coalesce(codes.error_code(F.col("status")), F.lit("-")).alias("code"))


@query(with_views("v5", """
select id, version, case status when 'verified' then doc_id * 50000 <= 3600000 when 'draft' then doc_id * 50000 <= 60000 when 'review' then doc_id * 50000 <= 60000 else false end as fresh from v5"""))
def freshness(spark, sf_dir):
    v = view(spark, sf_dir, "v5")
    return v.select("id", "version", codes.freshness(F.col("status"), F.col("doc_id") * 50_000).alias("fresh"))


@query("""
select count(*) as total, count(*) filter (contains(text, 'the')) as passed, count(*) filter (not contains(text, 'the')) as failed,
  round(avg(turn * 10 + conv_id % 7), 6) as avg_latency_ms from conversations""")
def test_case_summary(spark, sf_dir):
    results = table(spark, sf_dir, "conversations").select(
        security.check_expected(F.col("text"), F.array(F.lit("the")))["passed"].alias("passed"),
        (F.col("turn") * 10 + F.col("conv_id") % 7).alias("latency_ms"))
    return L.test_case_summary(results)


# --- governance -----------------------------------------------------------------


@query(with_views("v8", "select event_id, user_id, tool_name from v8 where tool_name not in ('chat-a', 'ide-a', 'ide-b', 'agent-a')"))
def unregistered_tools(spark, sf_dir):
    tools = spark.createDataFrame([(t,) for t in ("chat-a", "ide-a", "ide-b", "agent-a")], "tool_name string")
    return G.unregistered_tools(log8(spark, sf_dir), tools).select("event_id", "user_id", "tool_name")


@query(with_views("v8", """
with t as (select *, case user_id % 3 when 0 then 3 when 1 then 4 else 5 end as role_tier, 2 + (user_id % 10) % 4 as tier_allowed from v8)
select event_id, tier, tier > role_tier as over_role, tier > tier_allowed as over_project from t where tier > role_tier or tier > tier_allowed"""))
def tier_violations(spark, sf_dir):
    log = log8(spark, sf_dir)
    role = F.when(F.col("user_id") % 3 == 0, "dev").when(F.col("user_id") % 3 == 1, "lead").otherwise("staff")
    users = log.select("user_id").distinct().withColumn("role", role)
    projects = log.select("project_id").distinct().withColumn("tier_allowed", 2 + F.substring("project_id", 2, 9).cast("int") % 4)
    found = G.tier_violations(log, users, {"dev": 3, "lead": 4, "staff": 5}, projects)
    return found.select("event_id", "tier", "over_role", "over_project")


@query(with_views("v8", """
select strftime(ts, '%Y-%m') as month, case when grouping(team) = 1 then '(all)' else team end as team, case when grouping(project_id) = 1 then '(all)' else project_id end as project_id,
  count(*) filter (gates_passed) as passed, count(*) filter (not gates_passed) as failed
from v8 group by grouping sets ((strftime(ts, '%Y-%m'), team, project_id), (strftime(ts, '%Y-%m'), team), (strftime(ts, '%Y-%m'), project_id), (strftime(ts, '%Y-%m')))"""))
def tool_quality_report(spark, sf_dir):
    return G.tool_quality_report(log8(spark, sf_dir))


@query(with_views("v8 v2 v5", f"""
with parts as (
select 'daily' as cadence, strftime(ts, '%Y-%m-%d') as period, '(all)' as key, 'failed_gates' as metric, count(*) as value from v8 where not gates_passed group by 2
union all select 'weekly', strftime(date_trunc('week', ts), '%Y-%m-%d'), project_id, 'tokens', cast(sum(tokens_used) as bigint) from v8 group by 2, 3
union all select 'weekly', strftime(date_trunc('week', ts), '%Y-%m-%d'), tool_name, 'failed_gates', count(*) from v8 where not gates_passed group by 2, 3
union all select 'monthly', strftime(ts, '%Y-%m'), tool_name, 'interactions', count(*) from v8 group by 2, 3
union all select 'monthly', strftime(ts, '%Y-%m'), '(all)', 'library_prompts', count(*) from v8 where prompt_template_ref is not null group by 2
union all select 'monthly', strftime(ts, '%Y-%m'), tool_name, 'shadow_interactions', count(*) from v8 where tool_name not in ('chat-a', 'ide-a', 'ide-b') group by 2, 3),
found as (select strftime(date_trunc('week', epoch_ms(published_ms)), '%Y-%m-%d') as period, rule_id as key, count(*) as value
  from v2 join {RULES_SQL} on regexp_matches(content, pattern) join v5 on v5.doc_id = v2.doc_id group by 1, 2)
select cadence, period, key, metric, value, null::int as position from parts
union all select 'weekly', period, key, 'failing_rule', value, row_number() over (partition by period order by value desc, key) from found"""))
def audit_dashboard(spark, sf_dir):
    known = spark.createDataFrame([("chat-a",), ("ide-a",), ("ide-b",)], "tool_name string")
    at = view(spark, sf_dir, "v5").select("doc_id", F.timestamp_millis("published_ms").alias("ts"))
    found = scan_rules(view(spark, sf_dir, "v2"), "content", ["doc_id"]).select("doc_id", "rule_id").join(at, "doc_id")
    return G.audit_dashboard(log8(spark, sf_dir), known, found)


@query(with_views("v8", """
select project_id, string_agg(distinct tool_name, ',' order by tool_name) as tools, max(tier) as max_tier, round(avg(case when tier >= 3 then 100.0 else 0.0 end), 6) as pct_assisted,
  count(distinct prompt_template_ref) as prompts, count(*) filter (gates_passed) as scans_passed, bool_and(gates_passed) as all_reviewed
from v8 group by project_id"""))
def sbom(spark, sf_dir):
    return G.sbom(log8(spark, sf_dir), "project_id", F.col("tier") >= 3, F.col("gates_passed"))


@query(with_views("v8", """
with t as (select distinct 'tpl-' || event_id % 30 as template from events)
select template, (select count(*) from v8 where prompt_template_ref = template) as uses from t"""))
def prompt_usage(spark, sf_dir):
    templates = table(spark, sf_dir, "events").select(F.concat(F.lit("tpl-"), F.col("event_id") % 30).alias("template")).distinct()
    return G.prompt_usage(log8(spark, sf_dir), templates)


INCIDENTS_SQL = """
i as (select event_id, 'P' || (1 + event_id % 4) as severity, [1, 4, 24, 72][1 + event_id % 4] as limit_hours,
  case when event_id % 6 = 0 then 30 * 24 else event_id % 40 end as hours from events where event_type = 'error')"""


@query(f"with {INCIDENTS_SQL} select event_id, severity, limit_hours, case when event_id % 6 = 0 then true else hours > limit_hours end as breached from i")
def incident_sla(spark, sf_dir):
    return _incidents(spark, sf_dir).select("event_id", "severity", "limit_hours", "breached")


@query(f"""with {INCIDENTS_SQL}, j as (select *, case when event_id % 6 = 0 then true else hours > limit_hours end as breached from i)
select severity, count(*) as incidents, count(*) filter (breached) as breaches, round(avg(case when breached then 1.0 else 0.0 end), 6) as breach_rate from j group by severity""")
def sla_rates(spark, sf_dir):
    return G.sla_rates(_incidents(spark, sf_dir))


def _incidents(spark, sf_dir):
    number = F.col("event_id")
    opened = F.col("ts").cast("timestamp")
    events = table(spark, sf_dir, "events").where("event_type = 'error'").select(
        number, F.concat(F.lit("P"), 1 + number % 4).alias("severity"), opened.alias("opened_at"),
        F.when(number % 6 != 0, opened + F.make_dt_interval(hours=number % 40)).alias("responded_at"))
    return G.incident_sla(events, F.expr("timestamp '2024-12-31 00:00:00'"))


@query(with_views("v8", """
with t as (select *, strftime(ts, '%Y-%m') as month from v8),
r as (select *, cast(sum(tokens_used) over (partition by project_id, month order by ts, event_id rows unbounded preceding) as bigint) as project_tokens,
  cast(sum(tokens_used) over (partition by user_id, month order by ts, event_id rows unbounded preceding) as bigint) as user_tokens,
  1000000 + 500000 * cast(substr(project_id, 2) as bigint) as token_cap from t)
select event_id, project_tokens, user_tokens, case when project_tokens >= token_cap then 'approval' when project_tokens >= 0.8 * token_cap then 'alert' else 'ok' end as status,
  user_tokens > 100000 as user_alert, tokens_used > 5000 as run_over_budget from r"""))
def budget_status(spark, sf_dir):
    log = log8(spark, sf_dir)
    caps = log.select("project_id").distinct().withColumn("token_cap", 1_000_000 + 500_000 * F.substring("project_id", 2, 9).cast("long"))
    got = G.budget_status(log, caps, 100_000, 5_000)
    return got.select("event_id", "project_tokens", "user_tokens", "status", "user_alert", "run_over_budget")


@query(with_views("v8", """
with o as (select event_id, user_id, row_number() over (partition by user_id order by ts, event_id) as occurrence from v8 where tool_name = 'shadow-x')
select event_id, user_id, occurrence, case occurrence when 1 then 'retraining' when 2 then 'warning' else 'disciplinary' end as level from o"""))
def escalation_level(spark, sf_dir):
    shadow = log8(spark, sf_dir).where("tool_name = 'shadow-x'")
    return G.escalation_level(shadow).select("event_id", "user_id", "occurrence", "level")
