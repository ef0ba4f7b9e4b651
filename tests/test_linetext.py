"""The line format: literal cases, traps and round trips of awkward documents."""

import json
import random
import time

from pyspark.sql import functions as F

from emberkeep.functions import lines as P
from emberkeep.functions import text as T
from emberkeep.operators import linetext as L

AWKWARD = [
    {"a": 1, "b": "x", "c": None, "d": True, "e": 1.5},
    {"s": "", "t": "true", "u": "-x", "v": "5a", "w": "a,b", "x": "a: b", "y": 'say "hi"', "z": "back\\slash\nline\ttab"},
    {"lead": " x", "trail": "x ", "hash": "#x", "bracket": "[1]: a", "brace": "{a}", "pipe": "a|b", "percent": "%p"},
    {"odd key": 1, "a.b": 2, "1st": 3, "k:v": 4, 'q"t': 5, "arr[1]": 6},
    {"empty": {}, "none": [], "nest": {"a": {"b": {"c": {"d": [1, {"e": 2}]}}}}},
    {"tags": ["a", "b", "", "null", "1"], "nums": [1, 2.5, -3, 1e15], "flags": [True, False, None]},
    {"rows": [{"id": 1, "n": "a"}, {"n": "b, c", "id": 2}], "after": "z"},
    {"one": [{"x": "only"}, {"x": "b"}]},
    {"mixed": [1, "two", {"a": 1, "b": [1, 2], "c": {"d": 1}, "e": []}, [1, 2], [[1], 2], {}, {"o": {"p": 1}}]},
    {"deep": {"rows": [{"a": 1}, {"a": 2}], "inner": {"list": [{"a": 1, "b": 2}, 3], "tags": ["x"]}}},
    [1, "a", None],
    [{"a": 1, "b": "x"}, {"a": 2, "b": "y"}],
    {"unicode": "é→漢", "quote": '"', "esc": "\\n"},
]


def test_round_trip_of_awkward_documents(spark):
    docs = spark.createDataFrame([(i, json.dumps(d)) for i, d in enumerate(AWKWARD)], "doc_id long, j string")
    audit = {r.doc_id: r for r in L.roundtrip_audit(docs, "doc_id", "j").collect()}
    failed = {i: (r.failure, r.after) for i, r in audit.items() if not r.passed}
    assert failed == {}
    for i, d in enumerate(AWKWARD):
        assert json.loads(audit[i].after) == d
    rate = L.audit_rate(L.roundtrip_audit(docs, "doc_id", "j")).first()
    assert (rate.docs, rate.pass_rate_pct) == (len(AWKWARD), 100.0)


def test_encoded_text(spark):
    doc = {"id": 7, "cust": {"key": 1}, "rows": [{"k": 1, "v": "a"}, {"k": 2, "v": "x, y"}], "none": [], "mix": [1, {"a": "b", "c": 2}]}
    df = spark.createDataFrame([(json.dumps(doc),)], "j string")
    text = L.encode_json_docs(df, "j").first().text
    assert text.split("\n")[4:] == [
        "id: 7", "cust:", "  key: 1", "rows[2]{k, v}:", "  1, a", '  2, "x, y"', "---", "none[0]:", "---",
        "mix[2]:", "  - 1", "  - a: b", "    c: 2", "---"]
    assert L.encode_json_docs(spark.createDataFrame([("{oops",)], "j string"), "j").first().text is None


def test_numbers_and_quoting(spark):
    numbers = [(1.0, "1"), (1e3, "1000"), (-0.0, "0"), (29.990, "29.99"), (float("nan"), "null"), (float("inf"), "null"), (1e-9, "0.000000001"), (-2.5e10, "-25000000000")]
    df = spark.createDataFrame([(d,) for d, _ in numbers], "d double")
    assert [r.x for r in df.select(T.line_number(F.col("d")).alias("x")).collect()] == [t for _, t in numbers]
    words = ["", "true", "-x", "5a", "a,b", "plain", " x", "#x", "two words"]
    df = spark.createDataFrame([(w,) for w in words], "w string")
    got = [r.x for r in df.select(T.line_quote(F.col("w")).alias("x")).collect()]
    assert got == ['""', '"true"', '"-x"', '"5a"', '"a,b"', "plain", '" x"', '"#x"', "two words"]


def test_tokens(spark):
    cases = {"12": ("long", "12"), "01": ("string", "01"), "1.5": ("double", "1.5"), "99999999999999999999": ("string", "99999999999999999999"),
             '"a\\\\n\\"b"': ("string", 'a\\n"b'), "null": ("null", None), "false": ("boolean", "false"), "word": ("string", "word")}
    df = spark.createDataFrame([(c,) for c in cases], "c string")
    got = {r.c: (r.t.kind, r.t.value) for r in df.select("c", T.line_token(F.col("c")).alias("t")).collect()}
    assert got == cases


def decoded(spark, *texts):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return {r.doc_id: r for r in L.decode_docs(docs).collect()}


def test_headerless_document_with_a_block_is_read_whole(spark):
    got = decoded(spark, "a: 1\nrows[1]{x}:\n  5\n---\nb: 2")
    assert json.loads(got[0].json) == {"a": 1, "rows": [{"x": 5}], "b": 2}


def test_lenient_documents_skip_what_they_cannot_read(spark):
    head = "%lson 1.0\n%strict false\n---\n"
    got = decoded(spark, head + "a: 1\nrows[3]{x, y}:\n  5\n  6, 7, 8\n---\nno colon", head.replace("false", "true") + "a: 1\nno colon")
    assert json.loads(got[0].json) == {"a": 1, "rows": [{"x": 5, "y": ""}, {"x": 6, "y": 7}]}
    assert got[1].json is None and got[1].errors == ["Line 5: missing colon"]


def test_other_delimiters(spark):
    got = decoded(spark, "rows[1|]{a, b}:\n  1| x\n---", "%lson 1.0\n%delimiter pipe\n---\nrows[1]{a| b}:\n  1| \"x|y\"\n---")
    assert json.loads(got[1].json) == {"rows": [{"a": 1, "b": "x|y"}]}


def test_diagnostics(spark):
    text = "\n".join([
        "%lson 1.0", "---", 'a: "open', 'b: "bad\\q"', "rows[2]{x}:", "  1", "---", "list[2]:", "  - 1", "  -", "---", "e[1]{}:", "  1", "---", "last[1]{x}:", "  2"])
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    got = {(r.line_no, r.message) for r in L.validate_docs(docs).collect()}
    assert (3, "Unterminated quoted string") in got
    assert (4, "Invalid escape sequence: \\q") in got
    assert (5, "Declared 2 items but counted 1") in got
    assert (12, "Empty field list {} in tabular header") in got
    assert (15, "Array block opened at line 15 was never closed with ---") in got
    assert not any(line == 8 for line, _ in got)


def test_diagnostics_of_headers_and_escapes(spark):
    lines = ["a[1|]{x, y}:", "  1", "---", "b[-3]: 1", "c[two]: 1", "d[99999999999]: 1", 'e: "ends in \\', 'f: "fine \\\\"', "g[1|]{x|y}:", "  1|2", "---"]
    docs = spark.createDataFrame([(1, "\n".join(lines)), (2, None), (3, "")], "doc_id long, text string")
    got = {(r.line_no, r.severity, r.message) for r in L.validate_docs(docs).collect()}
    assert got == {
        (1, "WARNING", "Field list may not use the declared delimiter '|'"), (4, "ERROR", "Negative array length: -3"),
        (5, "ERROR", "Non-integer array length: two"), (6, "ERROR", "Non-integer array length: 99999999999"),
        (7, "ERROR", "Unterminated escape sequence at end of line")}


def test_table_blocks_split_large_groups(spark):
    df = spark.range(25).select((F.col("id") % 2).alias("g"), "id")
    blocks = L.encode_table(df, ["g"], "rows", ["id"], "id", rows_per_block=5)
    got = {(r.g, r.block_no): r.text for r in blocks.collect()}
    assert sorted(got) == [(0, 0), (0, 1), (0, 2), (1, 0), (1, 1), (1, 2)]
    assert got[(0, 2)] == "rows[3]{id}:\n  20\n  22\n  24\n---"


def nested(depth, inner):
    for d in reversed(range(depth)):
        inner = {f"k{d}": inner}
    return inner


def test_documents_of_any_depth_decode(spark):
    """A 500-level document and a line indented by 1,000 blanks cost the others nothing."""
    lines = [f"{'  ' * d}k{d}:" for d in range(500)] + ["  " * 500 + "leaf: 7", "after: x"]
    stray = "%lson 1.0\n%strict false\n---\na: 1\n" + " " * 1_000 + "lost: 2\nb:\n  c: 3"
    texts = [("deep", "\n".join(lines)), ("flat", "a: 1"), ("stray", stray), ("strict", stray.replace("false", "true")), ("empty", ""), ("none", None)]
    docs = spark.createDataFrame(texts, "doc_id string, text string")
    got = {r.doc_id: r for r in L.decode_docs(docs).collect()}
    assert json.loads(got["deep"].json) == {**nested(500, {"leaf": 7}), "after": "x"} and got["flat"].json == '{"a":1}'
    assert got["stray"].json == '{"a":1,"b":{"c":3}}' and got["stray"].errors == ["Line 5: unexpected depth"]
    assert got["strict"].json is None and (got["empty"].json, got["none"].json) == ("{}", None)
    assert L.validate_docs(docs).collect() == []


def plan_size(df):
    return len(df._jdf.queryExecution().optimizedPlan().toString().split("\n"))


def test_plans_have_one_size_for_any_depth(spark):
    flat, deep = (spark.createDataFrame([(1, t)], "doc_id long, text string") for t in ("a: 1", "\n".join("  " * d + f"k{d}:" for d in range(300))))
    assert plan_size(L.decode_docs(flat)) == plan_size(L.decode_docs(deep))
    plan = L.validate_docs(deep)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and L.decode_docs(deep)._jdf.queryExecution().executedPlan().toString().count("Exchange") == 1


def test_nearest_smaller_lines_match_a_search():
    rng = random.Random(4)
    for _ in range(200):
        depths = [rng.randrange(5) for _ in range(rng.randrange(30))]
        marks = [rng.choice((L.PLAIN, L.ITEM, L.CLOSES)) for _ in depths]
        for i, (parent, end, first, members, items) in enumerate(L.nearest_smaller(depths, marks)):
            assert parent == max((j for j in range(i) if depths[j] < depths[i]), default=-1)
            assert end == min((j for j in range(i + 1, len(depths)) if depths[j] <= depths[i]), default=len(depths))
            below = [j for j in range(i + 1, end) if depths[j] == depths[i] + 1 and marks[j] != L.CLOSES]
            assert (members, items) == (len(below), sum(marks[j] == L.ITEM for j in below))
            assert first == min((j for j in below if marks[j] == L.PLAIN), default=-1)


def test_items_with_arrays_and_more_fields(spark):
    head = "%lson 1.0\n%strict false\n---\n"
    got = decoded(
        spark, "list[2]:\n  - tags[2]:\n    - a\n    - b\n    more: 1\n    deep:\n      x: 2\n  - last: 3\n---",
        head + "list[1]:\n  - tags[2]:\n    - a\n    more: 1\n    - b\n      hidden: 9\n---\nz: 1", "only[0]:\n---", "- a\n- b", "plain",
        "rows[2]{a, b}:\n  1, 2\n    under: 3\n  4, 5\n---")
    assert json.loads(got[0].json) == {"list": [{"tags": ["a", "b"], "more": 1, "deep": {"x": 2}}, {"last": 3}]}
    assert json.loads(got[1].json) == {"list": [{"tags": ["a"], "more": 1}], "z": 1} and "Line 8: list item after a field" in got[1].errors
    assert json.loads(got[2].json) == {"only": []} and got[4].json == '"plain"'
    assert json.loads(got[5].json) == {"rows": [{"a": 1, "b": 2}, {"a": 4, "b": 5}]}


def test_lines_below_a_closing_line_are_errors(spark):
    got = decoded(spark, "rows[1]{a}:\n  1\n---\n  c: 2\nb: 1")
    assert got[0].json is None and got[0].errors == ["Line 4: unexpected depth"]


def test_numbers_that_no_double_holds(spark):
    docs = spark.createDataFrame([(1, '{"a":1e400,"b":[-1e999,2.5]}'), (2, '{"a":"1e400"}'), (3, "{oops"), (4, None)], "doc_id long, j string")
    got = {r.doc_id: (r.text.split("\n")[4:] if r.text else None, r.error) for r in L.encode_json_docs(docs, "j", error="error").collect()}
    assert got == {1: (["a: null", 'b[2]: "-Infinity", 2.5'], "number out of range"), 2: (['a: "1e400"'], None), 3: (None, "not JSON"), 4: (None, None)}


HEAD = "%lson 1.0\n%delimiter comma\n%strict true\n---\n"


def test_documents_are_read_by_a_given_number_of_tasks(spark):
    """A document is one row of the shuffle, and AQE, which goes by bytes, leaves its tasks alone."""
    docs = spark.range(0, 400, 1, 1).select(F.col("id").alias("doc_id"), F.concat(F.lit(HEAD + "a: "), "id", F.lit("\nb:\n  c[2]: x, y")).alias("text"))
    read = L.decode_docs(docs)
    got = read.select("json", F.spark_partition_id().alias("task")).collect()
    assert len({r.task for r in got}) == 4 and {r.json for r in got} == {f'{{"a":{i},"b":{{"c":["x","y"]}}}}' for i in range(400)}
    plan = read._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and "inline" not in plan


def test_an_audit_takes_little_time_a_document(spark):
    """A document took 266 microseconds of a core before, 5.3 s for these; the three Python steps were measured at 15."""
    texts = [json.dumps({"id": i, "status": "O", "tags": ["a", "b, c"], "cust": {"key": i * 7}}, separators=(",", ":")) for i in range(20_000)]
    began = time.process_time()
    encoded = [P.encode_plain(t) for t in texts]
    assert not any(P.diagnostics(t) for t in encoded) and [P.decode([t])[0] for t in encoded] == texts
    assert time.process_time() - began < 4


def test_simple_documents_read_alike_line_by_line(monkeypatch):
    bodies = [
        "a: 1\nb:\n  c: x\n  d:\ne: {}", "a: 1.5\nb[2]: 1.50, x", "a[3]: 1, 2", "a: 1\n  b: 2", "  a: 1", "a:\n    b: 1", 'a: "x, y"\nb[2]: "p, q", r', 'a: "open', 'a: x "y" z', "a: x\ty", "a: 1\n",
        "a: [1]", "a: x[1]: y", 'a: "\\q"', "a: 1 ", "a:  two", "a: 12\r", "a: x\x85", "a[1]: \u2028", "a[0]:\n---", "a.b: -0\nc: 01\nd: 9223372036854775808", "a: null\nb: true\nc: \x1f", "a:\n  b:\n    c:\n      d: 1\ne: 2", ""]
    texts = [HEAD + b for b in bodies]
    assert P.simple_lines(texts[0]) and P.simple_lines(texts[-2]) and not P.simple_lines(texts[8 + 2])

    def read(text):
        whole, pieces, errors = P.decode([text])
        return whole if pieces is None else "".join(before + (value or "") for before, value, _ in pieces), errors, P.diagnostics(text)

    fast = [read(t) for t in texts]
    monkeypatch.setattr(P, "simple_lines", lambda text: None)
    assert fast == [read(t) for t in texts]


def test_python_and_the_expression_encode_alike(spark):
    odd = [
        '{"a":1,"a":2}', '{"a":{ }}', '{ }', '{}', '{"a":[ ],"b":{}}', '{"a":NaN}', '{"a":"\\ud800"}', '{"a":-0}', '{"a":12345678901234567890,"b":1.50}', '  {"a" : [ 1 , "x" ] }  ', '{"a":1}x', "[1,2]", "null", "", None,
        '{"a\\n":"\\u0085","t\\u2028":"x \\u2028","é":" y"}', '{"a":[{"x":1,"y":null},{"y":"p, q","x":2}],"b":[[1,2],{"c":1,"d":[]},{}]}', '{"a":{"b":{"c":{}}}}']
    texts = [json.dumps(d) for d in AWKWARD] + odd
    df = spark.createDataFrame([(t,) for t in texts], "j string")
    got = df.select("j", L.encode_json("j").alias("both"), L._encode_any("j").alias("expression")).collect()
    assert [r.both for r in got] == [r.expression for r in got]
    plain = {r.j: P.encode_plain(r.j) for r in got}
    assert all(p in (None, r.expression) for r, p in zip(got, plain.values())) and sum(p is not None for p in plain.values()) > 12


def test_documents_that_share_an_id_or_have_none(spark):
    """Documents under one id are read as one, as before, and one without an id finds no other side."""
    rows = [(1, '{"a":1}'), (1, '{"a":1}'), (None, '{"a":1}'), (2, '{"b":[1.50,"x"],"c":{"d":2.5e-3}}'), (3, "{oops"), (3, '{"a":1}'), (4, None)]
    audit = L.roundtrip_audit(spark.createDataFrame(rows, "doc_id long, j string"), "doc_id", "j").collect()
    got = sorted((r.doc_id or 0, r.failure or "", r.passed, r.after) for r in audit if r.doc_id != 3)
    assert got == [(0, "mismatch", False, None), (1, "mismatch", False, '{{"a":1,"a":1}}'), (1, "mismatch", False, '{{"a":1,"a":1}}'), (2, "", True, '{"b":[1.5,"x"],"c":{"d":0.0025}}'), (4, "not JSON", False, None)]
    assert sorted(r.failure for r in audit if r.doc_id == 3) == ["mismatch", "not JSON"]


def test_audit_rate_moves_a_row_for_each_document(spark):
    """Every document counts; no step sorts lines or tokens, and the text stays where it was written."""
    docs = spark.range(2_000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 10 == 0, "{oops").when(F.col("id") % 10 == 1, '{"n":1e400}').otherwise(F.concat(F.lit('{"n":'), "id", F.lit(',"b":[1.50]}'))).alias("j"))
    rate = L.audit_rate(L.roundtrip_audit(docs, "doc_id", "j"))
    assert tuple(rate.first()) == (2_000, 1_600, 80.0)
    plan = rate._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" not in plan and "octet_length(text" in plan
