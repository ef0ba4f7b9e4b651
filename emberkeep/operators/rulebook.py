"""Scans by rules that are rows of a table, any number of them: one automaton of literals decides which patterns run."""

from __future__ import annotations

import hashlib
import math
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

RULE_BYTES = 32 << 20  # patterns of one pass over the texts; a larger table takes several passes
FINDING = T.ArrayType(T.StructType([
    T.StructField("rule_id", T.StringType()), T.StructField("rule_version", T.LongType()), T.StructField("severity", T.StringType()),
    T.StructField("position", T.IntegerType()), T.StructField("match", T.StringType()), T.StructField("line", T.IntegerType())]))
ARROW_FINDING = pa.list_(pa.struct([
    ("rule_id", pa.string()), ("rule_version", pa.int64()), ("severity", pa.string()), ("position", pa.int32()), ("match", pa.string()), ("line", pa.int32())]))

Rule = tuple[str, int, str, str]  # id, version, severity, pattern


def required_literal(pattern: str) -> str:
    """The longest run of ASCII letters and signs, in lower case, that every match of a pattern holds; "" if that can't be told."""
    try:
        parsed = re._parser.parse(pattern, re.ASCII)
    except (re.error, OverflowError, RecursionError):
        return ""
    runs = [""]

    def walk(items) -> None:
        for kind, value in items:
            name = str(kind)
            if name == "LITERAL" and value < 128:
                runs[-1] += chr(value).lower()
            elif name == "SUBPATTERN":
                walk(value[3])
            elif name in ("MAX_REPEAT", "MIN_REPEAT", "POSSESSIVE_REPEAT") and value[0] >= 1:
                runs.append("")
                walk(value[2])
                runs.append("")
            elif name != "AT":  # a place between letters breaks no run
                runs.append("")

    walk(parsed)
    return max(runs, key=len)


class Rulebook:
    """Compiled rules behind one automaton of their literals; rules without one are tried on every text."""

    def __init__(self, rules: list[Rule]):
        import ahocorasick
        import regex

        self.rules = [(i, v, s, regex.compile(p, regex.ASCII)) for i, v, s, p in rules]
        by_literal: dict[str, list[int]] = {}
        for number, (_, _, _, pattern) in enumerate(rules):
            by_literal.setdefault(required_literal(pattern), []).append(number)
        self.always = by_literal.pop("", [])
        self.automaton = ahocorasick.Automaton()
        for literal, numbers in by_literal.items():
            self.automaton.add_word(literal, (literal, numbers))
        self.any = bool(by_literal)
        if self.any:
            self.automaton.make_automaton()

    def findings(self, text: str | None) -> list[dict]:
        """The first match of every rule that has one, in order of rule id."""
        if text is None:
            return []
        numbers = set(self.always)
        if self.any:
            met = {literal: found for _, (literal, found) in self.automaton.iter(text.lower())}
            numbers.update(n for found in met.values() for n in found)
        out = []
        for rule_id, version, severity, pattern in (self.rules[n] for n in numbers):
            hit = pattern.search(text)
            if hit:
                out.append({"rule_id": rule_id, "rule_version": version, "severity": severity, "position": hit.start() + 1,
                            "match": hit.group(0), "line": text.count("\n", 0, hit.start()) + 1})
        return sorted(out, key=lambda f: f["rule_id"])


_books: dict[str, Rulebook] = {}


def _book(shared) -> Rulebook:
    """A worker compiles a set of rules once and keeps the last one."""
    key, rules = shared.value
    if key not in _books:
        _books.clear()
        _books[key] = Rulebook(rules)
    return _books[key]


def active_rules(rules: DataFrame) -> DataFrame:
    """Of each rule id its highest ``rule_version`` (ties: the greatest pattern); rows without id or pattern are left out."""
    known = rules.where("id is not null and pattern is not null").select("id", F.coalesce(F.col("rule_version").cast("long"), F.lit(0)).alias("rule_version"), "severity", "pattern")
    newest = known.groupBy("id").agg(F.max(F.struct("rule_version", "pattern", "severity")).alias("r"))
    return newest.select("id", "r.rule_version", "r.severity", "r.pattern")


@F.arrow_udf(returnType=T.StringType())
def _problem(patterns: pa.Array) -> pa.Array:
    import regex

    def tried(p: str) -> str | None:
        try:
            regex.compile(p, regex.ASCII)
        except regex.error as e:
            return str(e)
        return None

    return pa.array([None if p is None else tried(p) for p in patterns.to_pylist()], pa.string())


def rule_problems(rules: DataFrame) -> DataFrame:
    """(id, rule_version, pattern, problem) of active rules that are no valid patterns; scans leave them out."""
    return active_rules(rules).withColumn("problem", _problem("pattern")).where("problem is not null").select("id", "rule_version", "pattern", "problem")


def _finder(shared):
    @F.arrow_udf(returnType=FINDING)
    def found(texts: pa.Array) -> pa.Array:
        book = _book(shared)
        return pa.array([book.findings(t) for t in texts.to_pylist()], ARROW_FINDING)

    return found


def scan_rule_table(docs: DataFrame, text: str, keys: list[str], rules: DataFrame, rule_bytes: int = RULE_BYTES) -> DataFrame:
    """Every (document, rule) match: ``keys``, rule_id, rule_version, severity, position, match, line.

    ``rules``: id, rule_version, severity, pattern.  Rules reach the workers as
    data, in sets of at most ``rule_bytes``; each set is one pass over whole
    texts without a shuffle, so no number of rules is refused.  A text runs the
    patterns whose literal it holds and those that have none.  Patterns are
    read as ASCII classes and ASCII letter case.
    """
    spark = docs.sparkSession
    sound = active_rules(rules).where(_problem("pattern").isNull())
    size = sound.agg(F.sum(F.octet_length("pattern") + F.octet_length("id") + 64).alias("n")).first().n or 0
    sets = math.ceil(size / rule_bytes)
    out = None
    for number in range(max(1, sets)):
        mine = sound if sets <= 1 else sound.where(F.pmod(F.xxhash64("id"), F.lit(sets)) == number)
        held = sorted((r.id, r.rule_version, r.severity, r.pattern) for r in mine.collect())
        shared = spark.sparkContext.broadcast((hashlib.sha256(repr(held).encode()).hexdigest(), held))
        part = docs.select(*keys, F.explode_outer(_finder(shared)(F.col(text))).alias("f")).where("f is not null").select(*keys, "f.*")
        out = part if out is None else out.unionByName(part)
    return out

