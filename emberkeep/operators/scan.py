"""Injection scans: rules over whole texts, suppressions and risk decisions."""

from __future__ import annotations

import re
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import udtf

from emberkeep.functions.text import let

# The canonical rules (id, severity, pattern), each with a
# lower-case literal that every match contains.
RULES = [
    ("INJ-C001", "critical", r"(?i)ignore\s+(all\s+)?(previous|above|prior)\s+instructions", "ignore"),
    ("INJ-C002", "critical", r"(?i)disregard\s+your\s+(system|original)\s+prompt", "disregard"),
    ("INJ-C003", "critical", r"(?i)\{\{.*?(exec|eval|__import__|subprocess|os\.system).*?\}\}", "{{"),
    ("INJ-C004", "critical", r"(?i)<\s*script\b", "script"),
    ("INJ-C005", "critical", r"(?i)new\s+role\s*:", "role"),
    ("INJ-H001", "high", r"(?i)you\s+are\s+now\s+(a|an)\s+", "now"),
    ("INJ-H002", "high", r"(?i)system\s*:\s*override", "override"),
    ("INJ-H003", "high", r"(?i)\[SYSTEM\]", "[system]"),
    ("INJ-H004", "high", r"<!--[\s\S]*?-->", "<!--"),
    ("INJ-M001", "medium", r"(?i)pretend\s+(you\s+are|to\s+be)\s+", "pretend"),
    ("INJ-M002", "medium", r"(?i)as\s+(a|an)\s+AI\s+without\s+restrictions", "restrictions"),
]
SEVERITIES = ["low", "medium", "high", "critical"]
WEIGHTS = {"critical": 40, "high": 20, "medium": 5}  # ours: points taken off 100


Rule = tuple[str, str, str, str]


def _may_match(lowered: Column, literal: str) -> Column:
    """A byte search that settles most texts before any pattern runs."""
    return F.contains(lowered, F.lit(literal)) if literal else F.lit(True)


def matches(text: Column, rules: list[Rule]) -> Column:
    """array<struct<rule_id, severity, position, match, line>>, first match per rule.

    The lower-case text is made once and bound to a name for all rules.
    """

    def found(rule: Rule, lowered: Column) -> Column:
        rule_id, severity, pattern, literal = rule
        position = F.regexp_instr(text, F.lit(pattern))
        before = F.substring(text, F.lit(1), position - 1)
        return F.when(_may_match(lowered, literal) & text.rlike(pattern), F.struct(
            F.lit(rule_id).alias("rule_id"), F.lit(severity).alias("severity"), position.alias("position"),
            F.regexp_substr(text, F.lit(pattern)).alias("match"), (F.regexp_count(before, F.lit("\n")) + 1).alias("line")))

    return let(F.lower(text), lambda low: F.array_compact(F.array(*[found(r, low) for r in rules])))


def scan_rules(docs: DataFrame, text: str, keys: list[str], rules: list[Rule] = RULES) -> DataFrame:
    """Every (document, rule) match with its severity and place; no join, no shuffle.

    The outer explode keeps the optimizer from inferring a filter below it,
    which would run every pattern a second time.
    """
    hits = docs.select(*keys, F.explode_outer(matches(F.col(text), rules)).alias("f"))
    return hits.where("f is not null").select(*keys, "f.*")


def line_findings(docs: DataFrame, text: str, keys: list[str], rules: list[Rule] = RULES) -> DataFrame:
    """One row per rule and line it matches, with the line number and matched text."""
    lines = docs.select(*keys, F.posexplode_outer(F.split(text, "\n")).alias("__n", "__text"))
    hits = lines.select(*keys, "__n", F.explode_outer(matches(F.col("__text"), rules)).alias("f"))
    return hits.where("f is not null").select(*keys, (F.col("__n") + 1).alias("line"), "f.rule_id", "f.severity", "f.match")


@udtf(returnType="line int, rule_id string, severity string, match string")
class findings_udtf:
    """Table function form of ``line_findings`` for SQL users."""

    def __init__(self):
        self.rules = [(i, s, re.compile(p)) for i, s, p, _ in RULES]

    def eval(self, text: str):
        for number, line in enumerate((text or "").split("\n"), 1):
            for rule_id, severity, pattern in self.rules:
                hit = pattern.search(line)
                if hit:
                    yield number, rule_id, severity, hit.group(0)


def suppress_findings(findings: DataFrame, suppressions: DataFrame, keys: list[str]) -> DataFrame:
    """Drop findings that hold an approved suppression for the same rule and artefact."""
    approved = suppressions.where("approved").select("rule_id", *keys)
    return findings.join(approved, ["rule_id", *keys], "left_anti")


def risk_decision(docs: DataFrame, findings: DataFrame, keys: list[str], strict: bool = False) -> DataFrame:
    """Worst severity, score and pass flag for every document, also clean ones."""
    rank = F.array_position(F.array(*map(F.lit, SEVERITIES)), F.col("severity"))
    weight = F.when(F.lit(False), 0)
    for name, points in WEIGHTS.items():
        weight = weight.when(F.col("severity") == name, points)
    judged = findings.groupBy(*keys).agg(
        F.max(rank).alias("worst"), F.sum(F.coalesce(weight, F.lit(0))).alias("points"), F.count("*").alias("n_findings"))
    worst = F.coalesce("worst", F.lit(0))
    blocking = SEVERITIES.index("medium" if strict else "high") + 1
    return docs.select(*keys).join(judged, keys, "left").select(
        *keys,
        F.when(worst == 0, "none").otherwise(F.element_at(F.array(*map(F.lit, SEVERITIES)), F.greatest(worst, F.lit(1)).cast("int"))).alias("severity"),
        F.greatest(F.lit(100) - F.coalesce("points", F.lit(0)), F.lit(0)).alias("score"),
        (worst < blocking).alias("passed"), F.coalesce("n_findings", F.lit(0)).alias("n_findings"))
