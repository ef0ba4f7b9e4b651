"""Governance of AI tool use: access, budgets, quality reports, incidents."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from emberkeep.functions.codes import case_of
from emberkeep.operators.running import order_bounds, running

# Response limits by incident class, in hours.
SLA_HOURS = {"P1": 1, "P2": 4, "P3": 24, "P4": 72}
ALERT_SHARE, APPROVAL_SHARE = 0.8, 1.0


def month_of(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM")


def unregistered_tools(log: DataFrame, registry: DataFrame) -> DataFrame:
    """Interactions with a tool that is not on the approved list."""
    return log.join(registry.select("tool_name"), "tool_name", "left_anti")


def tier_violations(log: DataFrame, users: DataFrame, role_tiers: dict[str, int], projects: DataFrame) -> DataFrame:
    """Interactions above the tier of the user's role or of the project."""
    joined = log.join(users.select("user_id", "role"), "user_id", "left").join(
        projects.select("project_id", "tier_allowed"), "project_id", "left")
    role_limit = F.coalesce(case_of(F.col("role"), role_tiers), F.lit(0))
    over_role = F.col("tier") > role_limit
    over_project = F.col("tier") > F.coalesce("tier_allowed", F.lit(0))
    return joined.withColumns({"over_role": over_role, "over_project": over_project}).where("over_role or over_project")


def tool_quality_report(log: DataFrame) -> DataFrame:
    """Gate passes and failures per month for every team and project combination."""
    months = log.withColumn("month", month_of(F.col("ts")))
    sets = [["month", "team", "project_id"], ["month", "team"], ["month", "project_id"], ["month"]]
    grouped = months.groupingSets([[F.col(c) for c in s] for s in sets], "month", "team", "project_id")
    counted = grouped.agg(
        F.grouping("team").alias("all_teams"), F.grouping("project_id").alias("all_projects"),
        F.count_if("gates_passed").alias("passed"), F.count_if(~F.col("gates_passed")).alias("failed"))
    return counted.select(
        "month", F.when(F.col("all_teams") == 1, "(all)").otherwise(F.col("team")).alias("team"),
        F.when(F.col("all_projects") == 1, "(all)").otherwise(F.col("project_id")).alias("project_id"), "passed", "failed")


def audit_dashboard(log: DataFrame, registered: DataFrame | None = None, findings: DataFrame | None = None) -> DataFrame:
    """(cadence, period, key, metric, value, position): daily failures, weekly cost and failing rules, monthly use.

    ``findings`` (ts, rule_id) are ranked per week by how often a rule failed,
    ties by rule; ``position`` is null for all else.  Use of tools that aren't
    among ``registered`` (tool_name) is shadow use, counted per month.
    """
    ts = F.col("ts")
    day, week = (F.date_format(F.date_trunc(u, ts), "yyyy-MM-dd") for u in ("day", "week"))
    month = month_of(ts)

    def part(df: DataFrame, cadence: str, period: Column, key: Column, metric: str, value: Column) -> DataFrame:
        return df.groupBy(period.alias("period"), key.alias("key")).agg(value.cast("long").alias("value")).select(
            F.lit(cadence).alias("cadence"), "period", "key", F.lit(metric).alias("metric"), "value")

    failed = log.where(~F.col("gates_passed"))
    parts = [
        part(failed, "daily", day, F.lit("(all)"), "failed_gates", F.count("*")),
        part(log, "weekly", week, F.col("project_id"), "tokens", F.sum("tokens_used")),
        part(failed, "weekly", week, F.col("tool_name"), "failed_gates", F.count("*")),
        part(log, "monthly", month, F.col("tool_name"), "interactions", F.count("*")),
        part(log.where("prompt_template_ref is not null"), "monthly", month, F.lit("(all)"), "library_prompts", F.count("*")),
    ]
    if registered is not None:
        unknown = log.join(registered.select("tool_name").distinct(), "tool_name", "left_anti")
        parts.append(part(unknown, "monthly", month, F.col("tool_name"), "shadow_interactions", F.count("*")))
    shown = reduce(DataFrame.unionByName, parts).withColumn("position", F.lit(None).cast("int"))
    if findings is None:
        return shown
    rules = part(findings, "weekly", week, F.col("rule_id"), "failing_rule", F.count("*"))
    worst = Window.partitionBy("period").orderBy(F.desc("value"), F.asc("key"))  # one row a rule and week
    return shown.unionByName(rules.withColumn("position", F.row_number().over(worst)))


def sbom(log: DataFrame, repository: str, assisted: Column, reviewed: Column) -> DataFrame:
    """What AI use went into each repository."""
    return log.groupBy(repository).agg(
        F.array_join(F.sort_array(F.collect_set("tool_name")), ",").alias("tools"),
        F.max("tier").alias("max_tier"),
        F.round(F.avg(F.when(assisted, 100.0).otherwise(0.0)), 6).alias("pct_assisted"),
        F.count_distinct("prompt_template_ref").alias("prompts"),
        F.count_if("gates_passed").alias("scans_passed"),
        F.bool_and(reviewed).alias("all_reviewed"))


def prompt_usage(log: DataFrame, templates: DataFrame) -> DataFrame:
    """Uses per library template, including those never used."""
    used = log.where("prompt_template_ref is not null").groupBy(F.col("prompt_template_ref").alias("template")).agg(F.count("*").alias("uses"))
    return templates.join(used, "template", "left").select("template", F.coalesce("uses", F.lit(0)).alias("uses"))


def incident_sla(incidents: DataFrame, now: Column) -> DataFrame:
    """Add the response limit and whether it was broken: (severity, opened_at, responded_at)."""
    limit = case_of(F.col("severity"), SLA_HOURS)
    taken = F.unix_seconds(F.coalesce("responded_at", now)) - F.unix_seconds("opened_at")
    return incidents.withColumns({"limit_hours": limit, "breached": taken > limit * 3600})


def sla_rates(judged: DataFrame) -> DataFrame:
    return judged.groupBy("severity").agg(
        F.count("*").alias("incidents"), F.count_if("breached").alias("breaches"),
        F.round(F.avg(F.when(F.col("breached"), 1.0).otherwise(0.0)), 6).alias("breach_rate"))


def budget_status(log: DataFrame, caps: DataFrame, soft_user_limit: int, run_budget: int) -> DataFrame:
    """Month-to-date tokens after each interaction, against project, user and run budgets."""
    months = log.withColumns({"month": month_of(F.col("ts")), "__at": F.unix_micros("ts")})
    tokens = ("sum", F.col("tokens_used"))
    bounds = order_bounds(months, "__at")
    by_project = running(months, ["project_id", "month"], "__at", ["event_id"], {"project_tokens": tokens}, bounds)
    by_user = running(by_project, ["user_id", "month"], "__at", ["event_id"], {"user_tokens": tokens}, bounds)
    used = F.try_divide(F.col("project_tokens").cast("double"), F.col("token_cap"))
    status = F.when(used >= APPROVAL_SHARE, "approval").when(used >= ALERT_SHARE, "alert").otherwise("ok")
    return by_user.join(caps.select("project_id", "token_cap"), "project_id", "left").withColumns({
        "status": status,
        "user_alert": F.col("user_tokens") > soft_user_limit,
        "run_over_budget": F.col("tokens_used") > run_budget,
    }).drop("__at")


def escalation_level(violations: DataFrame) -> DataFrame:
    """The nth violation of a user and what follows from it."""
    timed = violations.withColumn("__at", F.unix_micros("ts"))
    counted = running(timed, ["user_id"], "__at", ["event_id"], {"occurrence": ("count", F.lit(1))})
    level = F.when(F.col("occurrence") == 1, "retraining").when(F.col("occurrence") == 2, "warning").otherwise("disciplinary")
    return counted.withColumn("level", level).drop("__at")
