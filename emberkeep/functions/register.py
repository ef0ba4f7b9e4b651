"""SQL names for the column functions, as SQL functions that Catalyst inlines."""

from __future__ import annotations

from pyspark.sql import SparkSession

from emberkeep.functions import security
from emberkeep.functions.codes import ERROR_CODES, FRESH_MS
from emberkeep.functions.text import key_sql, number_sql, quote_sql
from emberkeep.functions.versions import SEMVER


def _lit(s: str) -> str:
    return "r'" + s + "'" if "'" not in s else "'" + s.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _cases(key: str, table: dict) -> str:
    return f"case {key} " + " ".join(
        f"when {k!r} then {v!r}" for k, v in table.items()) + " end"


def _definitions() -> dict[str, tuple[str, str, str]]:
    dot = "aggregate(zip_with(a, b, (x, y) -> cast(x as double) * cast(y as double)), 0D, (s, x) -> s + x)"
    part = [f"try_cast(regexp_extract(s, {_lit(SEMVER)}, {i}) as bigint)" for i in (1, 2, 3)]
    pre = f"regexp_extract(s, {_lit(SEMVER)}, 4)"
    words = (f"transform(split({pre}, r'\\.'), x -> named_struct('kind', case when x rlike r'^\\d+$' then 0 else 1 end, "
             "'number', try_cast(x as decimal(38,0)), 'text', x))")
    sound = " and ".join(f"{p} is not null" for p in part)
    semver_type = "struct<major bigint, minor bigint, patch bigint, release int, parts array<struct<kind int, number decimal(38,0), text string>>, pre string, text string>"
    head, at = "split_part(s, '@', 1)", "nullif(split_part(s, '@', 2), '')"
    namespace = f"case when instr({head}, '/') > 0 then split_part({head}, '/', 1) else 'default' end"
    named = f"case when instr({head}, '/') > 0 then regexp_extract({head}, r'^[^/]*/(.*)$', 1) else {head} end"
    pii = ", ".join(f"case when t rlike {_lit(p)} then '{n}' end" for n, p in security.PII_PATTERNS.items())
    secrets = ", ".join(f"case when t rlike {_lit(p)} then '{n}' end" for n, p in security.SECRET_PATTERNS.items())
    return {
        "l2_norm": ("v array<float>", "double",
                    "sqrt(aggregate(v, 0D, (s, x) -> s + cast(x as double) * cast(x as double)))"),
        "cosine": ("a array<float>, b array<float>, na double, nb double", "double",
                   f"try_divide({dot}, na * nb)"),
        "remaining_ttl": ("expires_ms bigint, now_ms bigint", "bigint",
                          "case when expires_ms = 0 then -1 else greatest(expires_ms - now_ms, 0) end"),
        "human_bytes": ("b bigint", "string",
                        "case when b < 1024 then format_string('%d B', b) when b < 1048576 then "
                        "format_string('%.1f KB', round(b / 1024D, 1)) else "
                        "format_string('%.2f MB', round(b / 1048576D, 2)) end"),
        "line_quote": ("s string", "string",
                       f"case when s is null then 'null' else {quote_sql('s')} end"),
        "line_key": ("k string", "string",
                     key_sql("k")),
        "semver": ("s string", semver_type,
                   f"case when s rlike {_lit(SEMVER)} and {sound} then named_struct('major', {part[0]}, 'minor', {part[1]}, 'patch', {part[2]}, "
                   f"'release', case when {pre} = '' then 1 else 0 end, 'parts', {words}, 'pre', {pre}, 'text', s) end"),
        "parse_artefact_ref": ("s string", "struct<namespace string, name string, version string, error string>",
                               f"named_struct('namespace', {namespace}, 'name', {named}, 'version', {at}, 'error', "
                               f"case when s is null or {namespace} = '' or {named} = '' then 'INVALID_ID' "
                               rf"when {at} is not null and not {at} rlike r'^\d+(\.\d+){{0,2}}(-[0-9A-Za-z.-]+)?$' then 'INVALID_VERSION' end)"),
        "infer_bump": ("removed_required boolean, output_changed boolean, added_optional boolean", "string",
                       "case when removed_required or output_changed then 'major' when added_optional then 'minor' else 'patch' end"),
        "line_number": ("d double", "string", f"case when d is null or isnan(d) or abs(d) = double('infinity') then 'null' else {number_sql('d')} end"),
        "checksum": ("content string", "string", "concat('sha256:', sha2(cast(content as binary), 256))"),
        "template_vars": ("t string", "array<string>",
                          f"array_distinct(regexp_extract_all(t, {_lit(security.PLACEHOLDER)}, 1))"),
        "check_expected": ("output string, wanted array<string>", "boolean",
                           "forall(wanted, s -> contains(coalesce(output, ''), s))"),
        "detect_pii": ("t string", "array<string>", f"array_compact(array({pii}))"),
        "detect_secrets": ("t string", "array<string>", f"array_compact(array({secrets}))"),
        "error_code": ("status int", "string", _cases("status", ERROR_CODES)),
        "freshness": ("status string, age_ms bigint", "boolean",
                      f"age_ms <= coalesce({_cases('status', FRESH_MS)}, -1)"),
    }


def register_functions(spark: SparkSession) -> list[str]:
    """Create the temporary functions in this session; returns their names."""
    from emberkeep.operators.scan import findings_udtf

    names = []
    for name, (arguments, returns, body) in _definitions().items():
        spark.sql(f"create or replace temporary function {name}({arguments}) returns {returns} return {body}")
        names.append(name)
    spark.udtf.register("findings", findings_udtf)
    return [*names, "findings"]
