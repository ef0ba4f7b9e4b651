"""URL filter: explicit rules first, then an empirical-Bayes reputation of the host. DataFrame functions alone."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberkeep.llm.common import staged

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
TWO_LABEL_SUFFIXES = ("co.uk", "org.uk", "ac.uk", "com.au", "co.jp", "com.br")
BOUND_Z = 1.645  # one-sided 95 %
WEAKEST, STRONGEST, UNKNOWN_STRENGTH = 1.0, 1000.0, 10.0


@dataclass(frozen=True)
class UrlRule:
    verdict: str  # allow or block
    host: str
    path: str  # from the slash on

    @property
    def text(self) -> str:
        return self.host + self.path


def url_host_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path; both empty for null or without ``://``."""
    at = F.locate("://", F.coalesce(url, F.lit("")))
    rest = F.when(at > 0, F.substring(url, at + 3, F.lit(2**31 - 1))).otherwise(F.lit(""))
    host = F.regexp_extract(rest, r"(?s)^[^/?#]*", 0)
    path = F.regexp_extract(F.substring(rest, F.length(host) + 1, F.lit(2**31 - 1)), r"(?s)^[^?#]*", 0)
    return F.translate(host, UPPER, LOWER), path


def first_rule(host: Column, path: Column, rules: list[UrlRule]) -> Column:
    """(text, verdict) of the longest rule that fits host or a parent of it and starts the path; else null."""
    found = F.lit(None)
    for rule in sorted(rules, key=lambda r: (len(r.text), r.text)):
        fits = ((host == rule.host) | host.endswith("." + rule.host)) & path.startswith(rule.path)
        found = F.when(fits, F.struct(F.lit(rule.text).alias("text"), F.lit(rule.verdict).alias("verdict"))).otherwise(found)
    return found


def registered_domain(host: Column) -> tuple[Column, Column]:
    """Public suffix and registered domain of a host."""
    labels = F.split(host, r"\.")
    two = F.concat_ws(".", F.slice(labels, F.greatest(F.size(labels) - 1, F.lit(1)), F.lit(2)))
    wide = two.isin(*TWO_LABEL_SUFFIXES)
    suffix = F.when(wide, two).otherwise(F.element_at(labels, -1))
    three = F.concat_ws(".", F.slice(labels, F.greatest(F.size(labels) - 2, F.lit(1)), F.lit(3)))
    return suffix, F.when(wide, three).otherwise(two)


def _strength(counts: DataFrame, key: str) -> tuple[float, float]:
    """Overall share of good outcomes and the weight of a prior at this level, by moments: the less groups differ, the heavier."""
    row = (
        counts.where("n > 0").groupBy(key).agg(F.sum("good").alias("good"), F.sum("n").alias("n"))
        .agg(F.count("*").alias("groups"), F.sum("good").alias("good"), F.sum("n").alias("n"), F.sum(F.col("n") * F.col("n")).alias("squares"), F.sum(F.col("good") * F.col("good") / F.col("n")).alias("spread"))
        .first()
    )
    if not row.n:
        return 0.5, UNKNOWN_STRENGTH
    share = row.good / row.n
    room = row.n - row.squares / row.n - (row.groups - 1)
    if share in (0.0, 1.0) or room <= 0:
        return share, UNKNOWN_STRENGTH
    alike = ((row.spread - row.good * row.good / row.n) / (share * (1 - share)) - (row.groups - 1)) / room
    return share, round(min(max((1 - alike) / alike, WEAKEST), STRONGEST), 6) if alike > 0 else STRONGEST


def host_reputation(counts: DataFrame) -> DataFrame:
    """``host``, ``reputation`` (posterior mean of a good outcome), ``upper`` (its bound) from (host, good, n).

    Beta-binomial shrinkage in three steps: the suffix towards the overall
    share, the registered domain towards its suffix, the host towards its
    domain.  How strongly is estimated at each level.
    """
    suffix, domain = registered_domain(F.col("host"))
    counts = staged(counts.withColumn("suffix", suffix).withColumn("domain", domain), "hosts")
    share, of_suffix = _strength(counts, "suffix")
    _, of_domain = _strength(counts, "domain")
    _, of_host = _strength(counts, "host")

    def shrunk(prior: Column, strength: float) -> Column:
        return (F.col("good") + F.lit(strength) * prior) / (F.col("n") + F.lit(strength))

    def total(key: str) -> DataFrame:
        return counts.groupBy(key, *(["suffix"] if key == "domain" else [])).agg(F.sum("good").alias("good"), F.sum("n").alias("n"))

    suffixes = total("suffix").select("suffix", shrunk(F.lit(share), of_suffix).alias("suffix_mean"))
    domains = total("domain").join(suffixes, "suffix").select("domain", shrunk(F.col("suffix_mean"), of_domain).alias("domain_mean"))
    means = counts.join(domains, "domain").withColumn("reputation", shrunk(F.col("domain_mean"), of_host))
    weight = F.col("n") + F.lit(of_host)
    deviation = F.sqrt(F.col("reputation") * (1 - F.col("reputation")) / (weight + 1))
    return means.select("host", "reputation", F.least(F.lit(1.0), F.col("reputation") + BOUND_Z * deviation).alias("upper"))


def filter_urls(pages: DataFrame, rules: list[UrlRule], id_col: str = "page_id", url_col: str = "url", least: float = 0.5) -> DataFrame:
    """``page_id``, ``host``, ``path``, ``rule``, ``verdict`` of every row.

    The longest fitting rule decides.  Pages that a rule decides are also the
    labelled outcomes of their host (allow is good); a page without a rule is
    blocked when even the upper posterior bound of its host's good share is
    below ``least``, so unknown hosts pass.  A null or malformed url has empty
    host and path and is judged as the host "".  One row per input row, in any
    number; rules are a short literal list; other columns aren't read.
    """
    host, path = url_host_path(F.col("__url"))
    parsed = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).cast("string").alias("__url")).select("page_id", host.alias("host"), path.alias("path"))
    judged = parsed.withColumn("hit", first_rule(F.col("host"), F.col("path"), rules))
    outcome = F.col("hit")["verdict"]
    counts = judged.groupBy("host").agg(F.count(outcome).alias("n"), F.count(F.when(outcome == "allow", 1)).alias("good"))
    reputation = staged(host_reputation(counts), "reputation").withColumnRenamed("host", "named")
    found = judged.join(reputation, F.col("host") == F.col("named"), "left")
    verdict = F.coalesce(outcome, F.when(F.col("upper") < least, F.lit("block")).otherwise(F.lit("allow")))
    return found.select("page_id", "host", "path", F.col("hit")["text"].alias("rule"), verdict.alias("verdict"), "reputation")
