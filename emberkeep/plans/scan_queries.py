"""Registered queries for scans, signatures, templates and personal data."""

from __future__ import annotations

import hashlib

from pyspark.sql import functions as F

from emberkeep.functions import security as X
from emberkeep.functions import text as T
from emberkeep.functions.register import register_functions
from emberkeep.operators import scan as S
from emberkeep.operators.rulebook import scan_rule_table as scan_by_table
from emberkeep.plans.registry import query
from emberkeep.plans.views import table, view, with_views

KEYS = [b"current key", b"retired key"]
RULES_SQL = "(values " + ", ".join(f"('{i}', '{s}', '{p}')" for i, s, p, _ in S.RULES) + ") as r(rule_id, severity, pattern)"
FOUND = f"f as (select doc_id, rule_id, severity, content, pattern from v2 join {RULES_SQL} on regexp_matches(content, pattern))"


def _hmac_sql(text: str, key: bytes) -> str:
    block = (hashlib.sha256(key).digest() if len(key) > 64 else key).ljust(64, b"\0")
    pads = [bytes(b ^ x for b in block).hex() for x in (0x36, 0x5C)]
    return f"'hmac:' || sha256(unhex('{pads[1]}') || unhex(sha256(unhex('{pads[0]}') || encode({text}))))"


@query(with_views("v2", f"""
with {FOUND}
select doc_id, rule_id, severity, regexp_extract(content, pattern, 0) as match,
  1 + length(split_part(content, regexp_extract(content, pattern, 0), 1)) - length(replace(split_part(content, regexp_extract(content, pattern, 0), 1), chr(10), '')) as line
from f"""))
def scan_rules(spark, sf_dir):
    found = S.scan_rules(view(spark, sf_dir, "v2"), "content", ["doc_id"])
    return found.select("doc_id", "rule_id", "severity", "match", "line")


# A rule per pair of letters; customers beyond the pairs bring later versions, which ask for another ending.
RULE_ROWS = """
select 'R-' || chr(97 + cast(c_custkey % 26 as int)) || chr(97 + cast(floor(c_custkey / 26) as int) % 26) as id, cast(1 + floor(c_custkey / 676) as bigint) as rule_version,
  case when c_custkey % 3 = 0 then 'high' else 'medium' end as severity,
  '(?i)' || chr(97 + cast(c_custkey % 26 as int)) || chr(97 + cast(floor(c_custkey / 26) as int) % 26) || case when c_custkey >= 676 then '(tion|ing)[a-z]+[ ;]' else 'tion[a-z]*[.,]' end as pattern
from customer"""


@query(with_views("v2", f"""
with rules as ({RULE_ROWS}),
active as (select id, arg_max(pattern, rule_version) as pattern, arg_max(severity, rule_version) as severity, max(rule_version) as rule_version from (select distinct * from rules) group by id)
select doc_id, id as rule_id, rule_version, severity, regexp_extract(content, pattern, 0) as match,
  1 + length(split_part(content, regexp_extract(content, pattern, 0), 1)) as position from v2 join active on regexp_matches(content, pattern)"""))
def scan_rule_table(spark, sf_dir):
    v2 = view(spark, sf_dir, "v2")
    table(spark, sf_dir, "customer").createOrReplaceTempView("customer")
    found = scan_by_table(v2, "content", ["doc_id"], spark.sql(RULE_ROWS))
    return found.select("doc_id", "rule_id", "rule_version", "severity", "match", "position")


@query(with_views("v2", f"""
with {FOUND} select doc_id, rule_id from f where not (doc_id % 3 = 0 and rule_id in ('INJ-C001', 'INJ-H003'))"""))
def suppress_findings(spark, sf_dir):
    v2 = view(spark, sf_dir, "v2")
    findings = S.scan_rules(v2, "content", ["doc_id"])
    held = v2.where("doc_id % 3 = 0").select(
        "doc_id", F.explode(F.array(F.lit("INJ-C001"), F.lit("INJ-H003"))).alias("rule_id"), F.lit(True).alias("approved"))
    return S.suppress_findings(findings, held, ["doc_id"]).select("doc_id", "rule_id")


@query(with_views("v2", f"""
with {FOUND}, a as (select doc_id, max(case severity when 'critical' then 4 when 'high' then 3 else 2 end) as w,
   sum(case severity when 'critical' then 40 when 'high' then 20 else 5 end) as points, count(*) as n from f group by doc_id)
select v2.doc_id, case w when 4 then 'critical' when 3 then 'high' when 2 then 'medium' else 'none' end as severity,
  cast(greatest(100 - coalesce(points, 0), 0) as bigint) as score, coalesce(w, 0) < 2 as passed, coalesce(n, 0) as n_findings
from v2 left join a on a.doc_id = v2.doc_id"""))
def risk_decision(spark, sf_dir):
    v2 = view(spark, sf_dir, "v2")
    return S.risk_decision(v2, S.scan_rules(v2, "content", ["doc_id"]), ["doc_id"], strict=True)


LINES_SQL = with_views("v2", f"""
with l as (select doc_id, unnest(string_split(content, chr(10))) as t, generate_subscripts(string_split(content, chr(10)), 1) as line from v2)
select doc_id, line, rule_id, severity, regexp_extract(t, pattern, 0) as match from l join {RULES_SQL} on regexp_matches(t, pattern)""")


@query(LINES_SQL)
def line_findings(spark, sf_dir):
    return S.line_findings(view(spark, sf_dir, "v2"), "content", ["doc_id"])


@query(LINES_SQL)
def findings_udtf(spark, sf_dir):
    register_functions(spark)
    view(spark, sf_dir, "v2").createOrReplaceTempView("v2")
    return spark.sql("select doc_id, f.* from v2, lateral findings(content) f")


@query("select doc_id, 'sha256:' || sha256(text) as checksum, sha256(text) as prompt_hash from documents")
def checksum(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return docs.select("doc_id", X.checksum(F.col("text")).alias("checksum"), X.prompt_hash(F.col("text")).alias("prompt_hash"))


@query(f"""
select doc_id, case when doc_id % 2 = 0 then {_hmac_sql('text', KEYS[0])} else {_hmac_sql('text', KEYS[1])} end as signature,
  true as verified, false as tampered_verified, {_hmac_sql('text', KEYS[0])} as resigned from documents""")
def hmac_sha256(spark, sf_dir):
    text = F.col("text")
    docs = table(spark, sf_dir, "documents").withColumn(
        "signature", F.when(F.col("doc_id") % 2 == 0, X.hmac_sha256(text, KEYS[0])).otherwise(X.hmac_sha256(text, KEYS[1])))
    signature = F.col("signature")
    return docs.select(
        "doc_id", "signature", X.verify_signature(text, signature, KEYS).alias("verified"),
        X.verify_signature(F.concat(text, F.lit("!")), signature, KEYS).alias("tampered_verified"),
        X.resign(text, signature, KEYS).alias("resigned"))


@query(with_views("v2", """
select doc_id, 'title,lang,audience' as vars, case when v_audience is null then '' else 'Summarise ' || v_title || ' in ' || v_lang || ' for ' || v_audience end as text,
  case when v_audience is null then 'audience' else '' end as missing, 'Summarise ' || v_title || ' in ' || v_lang || ' for ' || coalesce(v_audience, 'all') as with_default
from v2"""))
def render(spark, sf_dir):
    values = F.create_map(F.lit("title"), "v_title", F.lit("lang"), "v_lang", F.lit("audience"), "v_audience")
    none = F.create_map(F.lit("unused"), F.lit("x"))
    t = F.col("template")
    v2 = view(spark, sf_dir, "v2").withColumns({
        "r": X.render(t, values, none), "d": X.render(t, values, F.create_map(F.lit("audience"), F.lit("all")))})
    return v2.select(
        "doc_id", F.array_join(X.template_vars(t), ",").alias("vars"), F.coalesce("r.text", F.lit("")).alias("text"),
        F.array_join("r.missing", ",").alias("missing"), F.col("d.text").alias("with_default"))


@query("""
select conv_id, turn, contains(text, 'the') and contains(text, 'in') as passed,
  concat_ws(',', case when not contains(text, 'the') then 'the' end, case when not contains(text, 'in') then 'in' end) as missing
from conversations""")
def check_expected(spark, sf_dir):
    checked = table(spark, sf_dir, "conversations").withColumn(
        "c", X.check_expected(F.col("text"), F.array(F.lit("the"), F.lit("in"))))
    return checked.select("conv_id", "turn", "c.passed", F.array_join("c.missing", ",").alias("missing"))


@query(with_views("v2", """
select doc_id, concat_ws(',', case when doc_id % 17 = 2 then 'INJ-H005' end, case when doc_id % 17 = 6 then 'STR-PLACEHOLDER' end,
  case when doc_id % 17 = 6 then 'STR-CODE' end, case when doc_id % 5 = 0 then 'INJ-M003' end, case when doc_id % 5 = 0 then 'INJ-M004' end) as rules from v2"""))
def structural_findings(spark, sf_dir):
    v2 = view(spark, sf_dir, "v2").withColumn("t", F.when(F.col("doc_id") % 5 == 0, F.concat("content", F.lit(" {{ title }}"))).otherwise(F.col("content")))
    found = X.structural_findings(F.col("t"), F.array(F.lit("lang")))
    return v2.select("doc_id", F.array_join(F.transform(found, lambda f: f["rule_id"]), ",").alias("rules"))


def _cases(patterns: dict) -> str:
    quoted = {n: p.replace("'", "''") for n, p in patterns.items()}
    return ", ".join(f"case when regexp_matches(text, '{p}') then '{n}' end" for n, p in quoted.items())


def _redact_sql() -> str:
    out = "text"
    for name, p in X.PII_PATTERNS.items():
        out = f"regexp_replace({out}, '{p}', '[{name.upper()}]', 'g')"
    return out


@query(f"select doc_id, concat_ws(',', {_cases(X.PII_PATTERNS)}) as pii, concat_ws(',', {_cases(X.SECRET_PATTERNS)}) as secrets, {_redact_sql()} as redacted from documents")
def detect_pii(spark, sf_dir):
    t = F.col("text")
    return table(spark, sf_dir, "documents").select(
        "doc_id", F.array_join(X.detect_pii(t), ",").alias("pii"), F.array_join(X.detect_secrets(t), ",").alias("secrets"),
        X.redact_pii(t).alias("redacted"))


@query("""
select doc_id, case when strlen(text) < 1024 then strlen(text) || ' B' when strlen(text) < 1048576 then printf('%.1f KB', round(strlen(text) / 1024.0, 1))
  else printf('%.2f MB', round(strlen(text) / 1048576.0, 2)) end as size from documents""")
def human_bytes(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", T.human_bytes(F.octet_length("text")).alias("size"))


@query("""
select doc_id, '{"id":' || doc_id || ',"meta":{"lang":"' || lang || '","source":"' || source || '"},"note":null}' as json from documents""")
def canonical_json(spark, sf_dir):
    nested = F.struct(F.col("doc_id").alias("id"), F.struct("lang", "source").alias("meta"), F.lit(None).cast("string").alias("note"))
    return table(spark, sf_dir, "documents").select("doc_id", T.canonical_json(nested).alias("json"))


@query("""
select doc_id, case when strlen(text) < 1024 then strlen(text) || ' B' when strlen(text) < 1048576 then printf('%.1f KB', round(strlen(text) / 1024.0, 1)) else printf('%.2f MB', round(strlen(text) / 1048576.0, 2)) end as size,
  'sha256:' || sha256(text) as checksum, 2 as minor from documents""")
def register_sql_functions(spark, sf_dir):
    register_functions(spark)
    table(spark, sf_dir, "documents").createOrReplaceTempView("documents")
    return spark.sql("""
        select doc_id, human_bytes(octet_length(text)) as size, checksum(text) as checksum, semver('1.2.3-draft').minor as minor
        from documents""")
