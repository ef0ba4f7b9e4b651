"""Text columns: sizes, JSON text and the tokens of the line format."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the line format.
MUST_QUOTE = r'^$|^(?:true|false|null)$|^[-\d#\s]|\s$|[:,|\t\[\]{}"\\\r\n]'
BARE_KEY = r"^[A-Za-z_][A-Za-z0-9_.]*$"
NUMBER = r"^-?(?:0|[1-9]\d*)(?:\.\d+)?(?:[eE][+-]?\d+)?$"
ESCAPES = [("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")]


def human_bytes(size: Column) -> Column:
    kb = F.round(size / F.lit(1024.0), 1)
    mb = F.round(size / F.lit(1048576.0), 2)
    return (
        F.when(size < 1024, F.format_string("%d B", size.cast("long")))
        .when(size < 1048576, F.format_string("%.1f KB", kb))
        .otherwise(F.format_string("%.2f MB", mb))
    )


def _escaped(s: Column) -> Column:
    return reduce(lambda acc, pair: F.replace(acc, F.lit(pair[0]), F.lit(pair[1])), ESCAPES, s)


def quoted(s: Column) -> Column:
    return F.concat(F.lit('"'), _escaped(s), F.lit('"'))


# The same rules as SQL text, for expressions composed as text.


def quoted_sql(s: str) -> str:
    body = s
    for plain, escaped in [("\\\\", "\\\\\\\\"), ('"', '\\\\"'), ("\\n", "\\\\n"), ("\\r", "\\\\r"), ("\\t", "\\\\t")]:
        body = f"replace({body}, '{plain}', '{escaped}')"
    return f"""concat('"', {body}, '"')"""


def quote_sql(s: str) -> str:
    return f"case when {s} rlike r'{MUST_QUOTE}' then {quoted_sql(s)} else {s} end"


def key_sql(k: str) -> str:
    return f"case when {k} rlike r'{BARE_KEY}' then {k} else {quoted_sql(k)} end"


def number_sql(d: str) -> str:
    shape = ("named_struct('digits', concat(p[0], p[1]), 'point', "
             "length(p[0]) + coalesce(cast(substring(get(p, 2), 2, 9) as int), 0))")
    plain = ("case when n.point <= 0 then concat('0.', repeat('0', -n.point), n.digits) "
             "when n.point >= length(n.digits) then rpad(n.digits, n.point, '0') "
             "else concat(substring(n.digits, 1, n.point), '.', substring(n.digits, n.point + 1, length(n.digits))) end")
    text = (rf"transform(transform(array(regexp_extract_all(cast(abs(d) as string), r'\d+|E-?\d+', 0)), p -> {shape}), n -> "
            rf"regexp_replace({plain}, r'(?:(\.\d*?[1-9])0+|\.0*)$', '$1'))[0]")
    whole = f"case when d = 0 then '0' else concat(case when d < 0 then '-' else '' end, {text}) end"
    return f"transform(array({d}), d -> {whole})[0]"


def line_quote(s: Column) -> Column:
    """A cell or value: quoted only where reading it back would change it."""
    return F.when(s.isNull(), F.lit("null")).when(s.rlike(MUST_QUOTE), quoted(s)).otherwise(s)


def line_key(k: Column) -> Column:
    return F.when(k.rlike(BARE_KEY), k).otherwise(quoted(k))


def line_number(d: Column) -> Column:
    """A double as plain decimal text: no exponent, no trailing zeros, no -0."""
    parts = F.regexp_extract_all(F.abs(d).cast("string"), F.lit(r"\d+|E-?\d+"), F.lit(0))
    shape = F.struct(
        F.concat(parts[0], parts[1]).alias("digits"),
        (F.length(parts[0]) + F.coalesce(F.substring(F.get(parts, F.lit(2)), 2, 9).cast("int"), F.lit(0))).alias("point"))

    def plain(n: Column) -> Column:
        digits, point = n["digits"], n["point"]
        return (
            F.when(point <= 0, F.concat(F.lit("0."), F.repeat(F.lit("0"), -point), digits))
            .when(point >= F.length(digits), F.rpad(digits, point, F.lit("0")))
            .otherwise(F.concat(F.substring(digits, F.lit(1), point), F.lit("."), F.substring(digits, point + 1, F.length(digits))))
        )

    trimmed = F.regexp_replace(let(shape, plain), r"(?:(\.\d*?[1-9])0+|\.0*)$", "$1")
    signed = F.concat(F.when((d < 0), "-").otherwise(""), trimmed)
    finite = ~(F.isnan(d) | (F.abs(d) == float("inf")))
    return F.when(d.isNotNull() & finite, F.when(d == 0, "0").otherwise(signed)).otherwise("null")


def unescaped(body: Column) -> Column:
    """Undo the five escapes; backslash pairs are split off first."""
    pieces = F.split(body, r"\\\\", -1)

    def restore(p: Column) -> Column:
        return reduce(lambda acc, pair: F.replace(acc, F.lit(pair[1]), F.lit(pair[0])), ESCAPES[1:], p)

    return F.array_join(F.transform(pieces, restore), "\\")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once and use it many times inside an expression."""
    return F.transform(F.array(value), body)[0]


def line_token(s: Column) -> Column:
    """Type a token: struct<kind, value>; numbers that overflow stay strings."""

    def typed(t: Column) -> Column:
        number = t.rlike(NUMBER)
        kind = (
            F.when(t.rlike(r'(?s)^".*"$') & (F.length(t) >= 2), "quoted")
            .when(t.isin("true", "false"), "boolean")
            .when(t == "null", "null")
            .when(number & t.rlike(r"[.eE]"), "double")
            .when(number & t.try_cast("long").isNotNull(), "long")
            .otherwise("string")
        )
        return F.struct(kind.alias("kind"), t.alias("value"))

    def plain(t: Column) -> Column:
        value = (
            F.when(t["kind"] == "quoted", unescaped(F.substring(t["value"], F.lit(2), F.length(t["value"]) - 2)))
            .when(t["kind"] != "null", t["value"])
        )
        return F.struct(F.when(t["kind"] == "quoted", "string").otherwise(t["kind"]).alias("kind"), value.alias("value"))

    return let(let(F.trim(s), typed), plain)


def json_string(s: Column) -> Column:
    """A string as a JSON literal."""
    return F.regexp_extract(F.to_json(F.struct(s.alias("v"))), r'(?s)^\{"v":(.*)\}$', 1)


def token_json(s: Column) -> Column:
    """A token as a JSON literal."""
    return let(line_token(s), lambda t: (
        F.when(t["kind"] == "null", "null")
        .when(t["kind"] == "string", json_string(t["value"]))
        .when(t["kind"] == "double", let(t["value"].cast("double"), line_number))
        .otherwise(t["value"])
    ))


def canonical_json(value: Column, pretty: bool = False) -> Column:
    """Compact or indented JSON that keeps null fields."""
    return F.to_json(value, {"ignoreNullFields": "false", "pretty": "true" if pretty else "false"})
