"""The line-based text format: encoding, decoding, validation and audits as table jobs.

A document is one row of text.  Plain JSON is encoded, and a document validated
and decoded, by Python over Arrow batches, one pass over its lines each; a
column expression encodes what is not plain.  The format fixes how deep
structure may nest before it falls back to inline JSON.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types

from emberkeep.functions import lines as P
from emberkeep.functions import text as T
from emberkeep.functions.lines import ARRAY_HEADER, CLOSE, CLOSES, HEADER_LINES, INDENT, ITEM, KEY_VALUE, MAX_OBJECT_DEPTH, NODE, PLAIN, QUOTED, nearest_smaller
from emberkeep.operators.running import running
from emberkeep.session import work_dir

ROWS_PER_BLOCK = 10_000


def _lines(*parts: Column | str) -> Column:
    return F.concat_ws("\n", *[F.lit(p) if isinstance(p, str) else p for p in parts])


# --- encoding -------------------------------------------------------------------
#
# The encoder is composed as SQL text: three structural levels make a large
# expression, and one parse in the JVM builds it far faster than thousands of
# Column calls.  ``let`` binds a value to a name inside the expression.


def _let(value: str, name: str, body: str) -> str:
    return f"transform(array({value}), {name} -> {body})[0]"


def _kind_sql(variant: str) -> str:
    return _let(f"coalesce(schema_of_variant({variant}), 'VOID')", "n", """case when n like 'OBJECT%' then 'object'
        when n like 'ARRAY%' then 'array' when n = 'STRING' then 'string' when n = 'VOID' then 'null'
        when n = 'BOOLEAN' then 'boolean' when n = 'BIGINT' then 'long' else 'double' end""")


def _fields_sql(raw: str) -> str:
    """array<struct<key, raw, kind>> of a JSON object's text, in its own order."""
    return (f"zip_with(map_entries(from_json({raw}, 'map<string,string>')), map_values(from_json({raw}, 'map<string,variant>')), "
            f"(t, w) -> named_struct('key', t.key, 'raw', t.value, 'kind', {_kind_sql('w')}))")


def _elements_sql(raw: str) -> str:
    return (f"zip_with(from_json({raw}, 'array<string>'), from_json({raw}, 'array<variant>'), "
            f"(t, w) -> named_struct('raw', t, 'kind', {_kind_sql('w')}))")


def _is_plain(v: str) -> str:
    return f"({v}.kind not in ('object', 'array'))"


def _token_sql(v: str) -> str:
    number = f"coalesce({T.number_sql(f'try_cast({v}.raw as double)')}, 'null')"  # the reader turns what no double holds into a word
    return (f"case {v}.kind when 'null' then 'null' when 'string' then {T.quote_sql(f'{v}.raw')} "
            f"when 'double' then {number} else {v}.raw end")


def _inline_sql(raw: str) -> str:
    """JSON text with a space after every comma and colon outside strings."""
    return f"""regexp_replace({raw}, r'((?:[^",:]|{QUOTED})*)([,:])', '$1$2 ')"""


def _cells_sql(elements: str) -> str:
    return f"array_join(transform({elements}, c -> {_token_sql('c')}), ', ')"


def _flat_sql(head: str, pad: str, elements: str) -> str:
    """An array of primitives after its key."""
    return (f"case when size({elements}) = 0 then concat({head}, '[0]:\n{pad}{CLOSE}') "
            f"else concat({head}, '[', size({elements}), ']: ', {_cells_sql(elements)}) end")


def _tabular_sql(rows: str) -> str:
    """All objects, one key set, only primitive values."""
    def names(r: str) -> str:
        return f"array_sort(transform({r}, f -> f.key))"
    return (f"forall({rows}, r -> coalesce(size(r) > 0 and {names('r')} = {names(rows + '[0]')} "
            f"and forall(r, f -> {_is_plain('f')}), false))")


def _rows_sql(elements: str) -> str:
    return f"transform({elements}, v -> case when v.kind = 'object' then {_fields_sql('v.raw')} end)"


def _table_sql(head: str, pad: str, rows: str) -> str:
    names = f"transform({rows}[0], f -> {T.key_sql('f.key')})"
    picked = f"map_from_entries(transform(r, f -> struct(f.key, struct(f.raw as raw, f.kind as kind))))"
    cells = _let(picked, "m", f"array_join(transform({rows}[0], f -> {_let('m[f.key]', 'c', _token_sql('c'))}), ', ')")
    lines = f"array_join(transform({rows}, r -> concat('{pad}{INDENT}', {cells})), '\n')"
    return f"concat({head}, '[', size({rows}), ']{{', array_join({names}, ', '), '}}:\n', {lines}, '\n{pad}{CLOSE}')"


def _item_sql(v: str, depth: int) -> str:
    """A list item after its indentation; objects put their first field on the hyphen line."""
    pad = INDENT * (depth + 2)
    inline = f"concat(h, ': ', {_inline_sql('g.raw')})"
    array = _let(_elements_sql("g.raw"), "u", f"case when forall(u, x -> {_is_plain('x')}) then {_flat_sql('h', pad, 'u')} else {inline} end")
    later = _let(f"concat('{pad}', {T.key_sql('g.key')})", "h", f"""case g.kind when 'array' then {array}
        when 'object' then {inline} else concat(h, ': ', {_token_sql('g')}) end""")
    first = f"concat('- ', {T.key_sql('o[0].key')}, ': ', {_let('o[0]', 'c', _token_sql('c'))})"
    of_object = f"""case when size(o) = 0 then '-' when {_is_plain('o[0]')} then
        array_join(concat(array({first}), transform(slice(o, 2, size(o)), g -> {later})), '\n')
        else concat('- ', {_inline_sql(v + '.raw')}) end"""
    of_array = f"""case when forall(o, x -> {_is_plain('x')}) then concat('- [', size(o), ']: ', {_cells_sql('o')})
        else concat('- ', {_inline_sql(v + '.raw')}) end"""
    return (f"case {v}.kind when 'object' then {_let(_fields_sql(v + '.raw'), 'o', of_object)} "
            f"when 'array' then {_let(_elements_sql(v + '.raw'), 'o', of_array)} else concat('- ', {_token_sql(v)}) end")


def _array_sql(head: str, pad: str, raw: str, depth: int) -> str:
    """An array after its key: inline, tabular or as a list."""
    items = f"array_join(transform(e, i -> concat('{pad}{INDENT}', {_item_sql('i', depth)})), '\n')"
    block = f"concat({head}, '[', size(e), ']:\n', {items}, '\n{pad}{CLOSE}')"
    if depth < MAX_OBJECT_DEPTH:
        block = _let(_rows_sql("e"), "rs", f"case when {_tabular_sql('rs')} then {_table_sql(head, pad, 'rs')} else {block} end")
    return _let(_elements_sql(raw), "e", f"case when forall(e, x -> {_is_plain('x')}) then {_flat_sql(head, pad, 'e')} else {block} end")


def _object_sql(raw: str, depth: int) -> str:
    pad, f, h = INDENT * depth, f"f{depth}", f"h{depth}"
    if depth >= MAX_OBJECT_DEPTH:
        nested = f"concat({h}, ': ', {_inline_sql(f + '.raw')})"
    else:
        nested = f"concat({h}, ':\n', {_object_sql(f + '.raw', depth + 1)})"
    value = f"""case {f}.kind when 'object' then case when {f}.raw = '{{}}' then concat({h}, ': {{}}') else {nested} end
        when 'array' then {_array_sql(h, pad, f + '.raw', depth)} else concat({h}, ': ', {_token_sql(f)}) end"""
    line = _let(f"concat('{pad}', {T.key_sql(f + '.key')})", h, value)
    return f"array_join(transform({_fields_sql(raw)}, {f} -> {line}), '\n')"


def _texts(a: pa.Array) -> list[str | None]:
    """The strings of a column; bytes that are no text are read as Java reads them."""
    try:
        return a.to_pylist()
    except UnicodeDecodeError:
        return [None if b is None else b.decode(errors="replace") for b in a.cast(pa.binary()).to_pylist()]


@F.arrow_udf(returnType=types.StringType())
def _encode_plain(texts: pa.Array) -> pa.Array:
    return pa.array([P.encode_plain(t) for t in _texts(texts)], pa.string())


def _encode_any(json_col: str) -> Column:
    """The document of any JSON text, as one expression."""
    j = f"`{json_col}`"
    root = f"try_parse_json({j})"
    single = _let(f"named_struct('raw', try_variant_get({root}, '$', 'string'), 'kind', {_kind_sql(root)})", "c", _token_sql("c"))
    head = "\\n".join(HEADER_LINES)
    return F.expr(f"""case when {root} is null then null else concat('{head}\n', case {_kind_sql(root)}
        when 'object' then {_object_sql(j, 0)} when 'array' then {_array_sql("''", '', j, 0)} else {single} end) end""")


def encode_json(json_col: str) -> Column:
    """JSON text as a document of the line format; null where it is not JSON.

    Plain objects are written by Python, everything else by the expression.
    """
    return F.coalesce(_encode_plain(F.col(f"`{json_col}`")), _encode_any(json_col))


def encode_json_docs(df: DataFrame, json_col: str, out: str = "text", error: str | None = None) -> DataFrame:
    """``df`` with each JSON text as a document, null where it is not JSON.

    A number that no double holds is written as ``null``, or inside an array or
    object as the reader's word for it, in quotes.

    ``error`` names one more column that says what could not be written as it was.
    """
    j = F.col(f"`{json_col}`")
    numbers = F.regexp_extract_all(F.regexp_replace(j, QUOTED, '""'), F.lit(r"(-?\d+(?:\.\d+)?(?:[eE][+-]?\d+)?)"), F.lit(1))
    infinite = F.exists(numbers, lambda n: F.abs(n.try_cast("double")) == float("inf"))
    problem = F.when(j.isNotNull() & F.try_parse_json(j).isNull(), "not JSON").when(infinite, "number out of range")
    named = {out: encode_json(json_col)} | ({error: problem} if error else {})
    return df.withColumns(named)


def _cells(tokens: Column) -> Column:
    return F.array_join(tokens, ", ")


def encode_table(
    df: DataFrame, group: list[str], key: str, fields: list[str], order: str, rows_per_block: int = ROWS_PER_BLOCK
) -> DataFrame:
    """Each group's rows as ``key[N]{f1, f2}:`` blocks: (group, block_no, text).

    A group fills as many blocks as it needs, so no group is gathered whole;
    each block declares its own length and reads back alone.
    """
    numbered = running(df, group, order, [], {"__row": ("count", F.lit(1))})
    kinds = dict(df.dtypes)
    tokens = F.array(*[_cell(F.col(f), kinds[f]) for f in fields])
    block = F.floor((F.col("__row") - 1) / rows_per_block).cast("long")
    gathered = numbered.groupBy(*group, block.alias("block_no")).agg(
        F.sort_array(F.collect_list(F.struct("__row", tokens.alias("cells")))).alias("rows"))
    names = ", ".join(f for f in fields)
    head = F.concat(F.lit(f"{key}["), F.size("rows").cast("string"), F.lit("]{" + names + "}:"))
    body = F.array_join(F.transform("rows", lambda r: F.concat(F.lit(INDENT), _cells(r["cells"]))), "\n")
    return gathered.select(*group, "block_no", _lines(head, body, CLOSE).alias("text"))


def encode_array(values: Column, key: str, kind: str) -> Column:
    """A primitive array column as ``key[N]: a, b``."""
    cells = _cells(F.transform(values, lambda v: _cell(v, kind)))
    head = F.concat(F.lit(f"{key}["), F.size(values).cast("string"), F.lit("]:"))
    return F.when(F.size(values) == 0, _lines(head, CLOSE)).otherwise(F.concat(head, F.lit(" "), cells))


def _cell(c: Column, kind: str) -> Column:
    if kind in ("double", "float"):
        return T.line_number(c.cast("double"))
    if kind == "string":
        return T.line_quote(c)
    if kind in ("boolean", "tinyint", "smallint", "int", "bigint"):
        return F.coalesce(c.cast("string"), F.lit("null"))
    return T.line_quote(c.cast("string"))


# --- reading lines ----------------------------------------------------------------


def _directive(lines: Column, name: str, default: str) -> Column:
    start = f"%{name} "
    found = F.filter(lines, lambda x: F.trim(x).startswith(start))
    return F.coalesce(F.trim(F.substring(F.trim(F.get(found, F.lit(0))), len(start) + 1, 2**31 - 1)), F.lit(default))


def _spaces(raw: Column) -> Column:
    return F.length(raw) - F.length(F.ltrim(raw))


def _depth(raw: Column) -> Column:
    return F.floor(_spaces(raw) / 2).cast("int")


def _documents(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, delimiter, strict, lines) of every document; ``lines`` are its meaningful ones as (line_no, raw)."""
    lines = F.split(F.col(text_col), "\n", -1)
    staged = docs.select(F.col(id_col).alias("doc_id"), lines.alias("__lines"))
    ends = F.array_position(F.transform("__lines", lambda x: F.trim(x)), CLOSE)
    head = F.slice("__lines", F.lit(1), F.greatest(ends, F.lit(1)).cast("int"))
    has_header = F.exists(head, lambda x: F.trim(x).startswith("%"))
    headed = staged.withColumn("__head", F.when(has_header, head).otherwise(F.array().cast("array<string>")))
    delimiter = _directive(F.col("__head"), "delimiter", "comma")
    numbered = F.transform("__lines", lambda x, i: F.struct((i + 1).alias("line_no"), x.alias("raw")))
    kept = F.filter(numbered, lambda x: (x["line_no"] > F.size("__head")) & (F.trim(x["raw"]) != "") & ~F.trim(x["raw"]).rlike("^[#%]"))
    return headed.select(
        "doc_id", F.when(delimiter == "tab", "\t").when(delimiter == "pipe", "|").otherwise(",").alias("delimiter"),
        (_directive(F.col("__head"), "strict", "true") != "false").alias("strict"), kept.alias("lines"))


def read_doc_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, line_no, spaces, depth, content, raw, delimiter, strict) of every meaningful line.

    Blank lines, comments and the directive header are left out.  ``---`` ends
    a header only where a directive stands before it.
    """
    read = _documents(docs, id_col, text_col).select("doc_id", "delimiter", "strict", F.inline("lines"))
    return read.select(
        "doc_id", "line_no", _spaces(F.col("raw")).alias("spaces"), _depth(F.col("raw")).alias("depth"), F.trim("raw").alias("content"), "raw",
        "delimiter", "strict")


def split_cells(text: Column, delimiter: Column) -> Column:
    """Cells of a row; delimiters inside quotes do not split."""

    def by(d: str) -> Column:
        escaped = "\\|" if d == "|" else d
        found = F.regexp_extract_all(F.concat(text, F.lit(d)), F.lit(rf'((?:{QUOTED}|[^{escaped}"])*){escaped}'), F.lit(1))
        cells = F.when(F.contains(text, F.lit('"')), found).otherwise(F.split(text, escaped, -1))
        return F.transform(cells, lambda x: F.trim(x))

    return F.when(delimiter == "|", by("|")).when(delimiter == "\t", by("\t")).otherwise(by(","))


def _header_part(content: Column, group: int) -> Column:
    return F.regexp_extract(content, ARRAY_HEADER, group)


TREE = types.ArrayType(types.StructType([types.StructField(n, types.IntegerType()) for n in NODE]))
@F.arrow_udf(returnType=TREE)
def _line_tree(depths: pa.Array, marks: pa.Array) -> pa.Array:
    rows = zip(depths.to_pylist(), marks.to_pylist())
    trees = [None if d is None else [dict(zip(NODE, t)) for t in nearest_smaller(d, m)] for d, m in rows]
    return pa.array(trees, pa.list_(pa.struct([(n, pa.int32()) for n in NODE])))


def _is_item(content: Column) -> Column:
    return content.rlike(r"^-(?: |$)")


def _body(content: Column) -> Column:
    return F.when(_is_item(content), F.trim(F.substring(content, F.lit(2), F.length(content)))).otherwise(content)


def _kind(content: Column, body: Column) -> Column:
    header = body.rlike(ARRAY_HEADER)
    return (
        F.when(content == CLOSE, "close")
        .when(header & (_header_part(body, 4) != ""), "tabular")
        .when(header & (_header_part(body, 5) == ""), "list")
        .when(header, "inline")
        .when(body.rlike(KEY_VALUE), "field")
        .otherwise("token")
    )


def _mark(body: Column, delimiter: Column) -> Column:
    return F.when(_header_part(body, 3) == "|", "|").when(_header_part(body, 3) == "\t", "\t").otherwise(delimiter)


def _field_text(body: Column) -> Column:
    return F.regexp_replace(_header_part(body, 4), r"^\{|\}$", "")


def _has_key(body: Column, kind: Column) -> Column:
    return (kind == "field") | (kind.isin("tabular", "list", "inline") & (_header_part(body, 1) != ""))


def _shape(content: Column, delimiter: Column) -> Column:
    """What a line is to the lines below it."""

    def of_body(b: Column) -> Column:
        return T.let(_kind(content, b), lambda kind: F.struct(
            kind.alias("kind"), _is_item(content).alias("is_item"), _has_key(b, kind).alias("keyed"), _mark(b, delimiter).alias("mark"),
            F.when(kind == "tabular", F.transform(split_cells(_field_text(b), _mark(b, delimiter)), _unquoted)).alias("names"),
            ((kind == "inline") | ((kind == "field") & (F.regexp_extract(b, KEY_VALUE, 2) != "")) | ((kind == "token") & (b != ""))).alias("valued")))

    return T.let(_body(content), of_body)


def classify_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every meaningful line with what it is and the line it hangs under; a document without any keeps one row of nulls.

    ``place`` counts a document's lines from 0, ``parent`` is the nearest line
    above at a smaller depth, ``end`` the place of the next line at no greater
    depth, ``members`` and ``items`` how many lines stand one level below.  A
    document is one row when it is read, so its tree is found there and then:
    the plan has no shuffle and the same size for any depth.  Only lines that
    have others below are looked at for their shape before lines become rows.
    """
    read = _documents(docs, id_col, text_col)
    depths = F.transform("lines", lambda x: _depth(x["raw"]))
    marks = F.transform("lines", lambda x: F.when(F.trim(x["raw"]) == CLOSE, CLOSES).when(_is_item(F.trim(x["raw"])), ITEM).otherwise(PLAIN))
    treed = read.withColumn("tree", _line_tree(depths, marks))
    lines, tree = F.col("lines"), F.col("tree")
    live = F.filter(lines, lambda x: F.trim(x["raw"]) != CLOSE)
    roots = F.filter(live, lambda x: _depth(x["raw"]) == 0)
    first = F.get(roots, F.lit(0))

    def with_parents(shapes: Column) -> Column:
        def parent(p: Column) -> Column:
            depth, up = _depth(F.get(lines, p)["raw"]), F.get(tree, p)["parent"]
            in_table = (F.get(shapes, up)["kind"] == "tabular") & (_depth(F.get(lines, up)["raw"]) == depth - 1)
            return F.when(p >= 0, F.struct(
                F.get(lines, p)["line_no"].alias("line_no"), depth.alias("depth"), F.get(tree, p)["first_field"].alias("first_field"),
                F.coalesce(in_table, F.lit(False)).alias("is_row"), F.get(shapes, p).alias("shape")))

        return F.transform(lines, lambda x, i: T.let(F.get(tree, i), lambda t: F.struct(
            i.alias("place"), x["line_no"].alias("line_no"), x["raw"].alias("raw"), t["end"].alias("end"), t["first_field"].alias("first_field"), t["members"].alias("members"),
            t["items"].alias("items"), parent(t["parent"]).alias("parent"))))

    shapes = F.transform(lines, lambda x, i: F.when(F.get(tree, i)["end"] > i + 1, _shape(F.trim(x["raw"]), F.col("delimiter"))))
    rows = treed.select(
        "doc_id", "delimiter", "strict", F.size("lines").alias("n_lines"), (F.size(live) > 1).alias("several"), F.size(roots).alias("roots"),
        first["line_no"].alias("root_line"), _shape(F.trim(first["raw"]), F.col("delimiter")).alias("root_shape"),
        F.inline_outer(T.let(shapes, with_parents)))
    read_back = rows.withColumns({
        "spaces": _spaces(F.col("raw")), "depth": _depth(F.col("raw")), "content": F.trim("raw"),
        "is_item": _is_item(F.trim("raw")), "body": _body(F.trim("raw"))})
    b = F.col("body")
    placed = read_back.withColumn("kind", _kind(F.col("content"), b)).withColumns({
        "declared": F.when(F.col("kind").isin("tabular", "list", "inline"), _header_part(b, 2).try_cast("int")), "mark": _mark(b, F.col("delimiter"))})
    in_table = (F.col("parent.shape.kind") == "tabular") & (F.col("kind") != "close") & (F.col("parent.depth") == F.col("depth") - 1)
    return placed.withColumn("kind", F.when(in_table, "row").otherwise(F.col("kind")))


def _unquoted(s: Column) -> Column:
    return F.when(s.rlike(f"^{QUOTED}$"), T.unescaped(F.substring(s, F.lit(2), F.length(s) - 2))).otherwise(s)


# --- validation ---------------------------------------------------------------------


DIAGNOSTICS = types.ArrayType(types.StructType().add("line_no", "integer").add("severity", "string").add("message", "string"))


@F.arrow_udf(returnType=DIAGNOSTICS)
def _diagnosed(texts: pa.Array) -> pa.Array:
    kind = pa.list_(pa.struct([("line_no", pa.int32()), ("severity", pa.string()), ("message", pa.string())]))
    return pa.array([P.diagnostics(t) for t in _texts(texts)], kind)


def validate_docs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, line_no, severity, message) for everything wrong with each document; one pass without a shuffle."""
    judged = docs.select(F.col(id_col).alias("doc_id"), _diagnosed(F.col(text_col)).alias("found"))
    return judged.select("doc_id", F.explode("found").alias("d")).select("doc_id", "d.line_no", "d.severity", "d.message")


def _is_block() -> Column:
    return F.col("kind").isin("tabular", "list")


def _counted() -> Column:
    return F.when(F.col("kind") == "tabular", F.col("members")).otherwise(F.col("items"))


def _ended() -> Column:
    return F.col("end") < F.col("n_lines")


def validate_blocks(lines: DataFrame) -> DataFrame:
    """Counted and declared length of every block of ``classify_lines``, and whether a line ends it."""
    return lines.where(_is_block()).select("doc_id", F.col("line_no").alias("block"), "declared", _counted().alias("counted"), _ended().alias("closed"))


def validation_summary(diagnostics: DataFrame, docs: DataFrame | None = None, id_col: str = "doc_id") -> DataFrame:
    """Errors, warnings and the valid flag per document; clean ones too when ``docs`` is given."""
    counted = diagnostics.groupBy("doc_id").agg(
        F.count_if(F.col("severity") == "ERROR").alias("errors"), F.count_if(F.col("severity") == "WARNING").alias("warnings"))
    if docs is not None:
        counted = docs.select(F.col(id_col).alias("doc_id")).join(counted, "doc_id", "left")
    errors = F.coalesce("errors", F.lit(0))
    return counted.select("doc_id", errors.alias("errors"), F.coalesce("warnings", F.lit(0)).alias("warnings"), (errors == 0).alias("valid"))


# --- decoding -----------------------------------------------------------------------


def _value_json(value: Column) -> Column:
    nested = value.rlike(r"^[\{\[]") & F.try_parse_json(value).isNotNull()
    return F.when(nested, F.to_json(F.try_parse_json(value))).otherwise(T.token_json(value))


PIECE = types.StructType().add("before", "string").add("value", "string").add("token", "boolean")
DECODED = types.StructType().add("json", "string").add("pieces", types.ArrayType(PIECE)).add("errors", types.ArrayType(types.StringType()))


@F.arrow_udf(returnType=DECODED)
def _decoded(texts: pa.Array) -> pa.Array:
    pieces = pa.list_(pa.struct([("before", pa.string()), ("value", pa.string()), ("token", pa.bool_())]))
    read = [P.decode(under) for under in _lists(texts)]
    columns = list(zip(*read)) or [(), (), ()]
    return pa.StructArray.from_arrays(
        [pa.array(c, kind) for c, kind in zip(columns, (pa.string(), pieces, pa.list_(pa.string())))], ["json", "pieces", "errors"])


def _lists(a: pa.Array) -> list[list[str | None]]:
    flat, ends = _texts(a.values), a.offsets.to_pylist()
    return [flat[i:j] for i, j in zip(ends, ends[1:])]


def decode_docs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, json, errors): documents as JSON text.

    A strict document with an error has null JSON; a lenient one skips what it
    cannot read, fills short rows with empty strings and drops extra cells.  A
    document without lines is ``{}``, a null one null.

    Every line becomes its opening text at its own place and its closing text
    at the place where its block ends; in order, these are the JSON.  One
    shuffle brings the documents of one id together, which are read as one.
    JSON inside a value and decimal numbers are read by Spark.  The plan is the
    same for any depth.
    """
    text = F.struct(F.col(text_col).alias("text"))  # keeps a null text in the list
    # Reading takes far longer than the bytes of the texts say, so the number of tasks is given.
    dealt = docs.select(F.col(id_col).alias("doc_id"), text.alias("t")).repartition(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), "doc_id")
    under = dealt.groupBy("doc_id").agg(F.collect_list("t").alias("texts"))
    read = under.select("doc_id", _decoded(F.col("texts.text")).alias("d"))

    def whole(p: Column) -> Column:
        value = F.when(p["value"].isNull(), "").when(p["token"], T.token_json(p["value"])).otherwise(_value_json(p["value"]))
        return F.concat(p["before"], value)

    json = F.when(F.col("d.pieces").isNull(), F.col("d.json")).otherwise(F.array_join(F.transform("d.pieces", whole), ""))
    return read.select("doc_id", json.alias("json"), F.col("d.errors").alias("errors"))


# --- audits -------------------------------------------------------------------------


def size_savings(docs: DataFrame, source: str, json_col: str, text_col: str) -> DataFrame:
    """Bytes in and out, savings and lines per source, with the total."""
    sized = docs.select(
        F.col(source).alias("source"), F.octet_length(F.col(json_col)).cast("long").alias("i"),
        F.octet_length(F.col(text_col)).cast("long").alias("o"), (F.regexp_count(F.col(text_col), F.lit("\n")) + 1).alias("l"))
    totals = sized.rollup("source").agg(
        F.grouping("source").alias("is_total"), F.count("*").alias("docs"), F.sum("i").alias("bytes_in"),
        F.sum("o").alias("bytes_out"), F.sum("l").alias("lines"))
    saved = F.round((1 - F.try_divide(F.col("bytes_out"), F.col("bytes_in"))) * 100, 6)
    return totals.select(
        F.when(F.col("is_total") == 1, "(all)").otherwise(F.col("source").cast("string")).alias("source"), "docs", "bytes_in",
        "bytes_out", "lines", saved.alias("savings_pct"))


def canonical(json: Column) -> Column:
    """JSON with sorted keys and plain numbers, for comparison."""
    return F.to_json(F.try_parse_json(json))


def roundtrip_audit(docs: DataFrame, id_col: str, json_col: str) -> DataFrame:
    """Encode, validate, decode and compare every document.

    The encoded texts feed three branches, so they are written once to the
    shared work folder rather than encoded three times.
    """
    spark = docs.sparkSession
    path = work_dir(spark, "roundtrip")
    encoded = encode_json(json_col).alias("text")
    docs.select(F.col(id_col).alias("doc_id"), F.col(json_col).alias("before"), encoded).write.parquet(path)
    source = spark.read.parquet(path)
    written = source.select("doc_id", "before", F.octet_length("text").alias("bytes_out"))  # null where there is no text, which stays behind
    back = decode_docs(source).select("doc_id", F.col("json").alias("after"), (F.size("errors") > 0).alias("failed"))
    judged = validation_summary(validate_docs(source)).select("doc_id", F.col("errors").alias("n_errors"))
    joined = written.join(back, "doc_id", "left").join(judged, "doc_id", "left")
    a, b = canonical(F.col("before")), canonical(F.col("after"))
    same = F.coalesce(F.col("bytes_out").isNotNull() & (F.col("before") == F.col("after")), F.lit(False)) | F.coalesce(a == b, F.lit(False))
    differs = F.array_position(F.zip_with(F.split(a, ""), F.split(b, ""), lambda x, y: ~x.eqNullSafe(y)), True)
    reason = (
        F.when(F.col("bytes_out").isNull(), "not JSON").when(F.coalesce("n_errors", F.lit(0)) > 0, "validation")
        .when(F.col("failed"), "decode").when(~same, "mismatch"))
    out = joined.select(
        "doc_id", F.octet_length("before").alias("bytes_in"), "bytes_out", "after", reason.alias("failure"),
        F.when(~same, differs - 1).alias("divergence"))
    return out.withColumn("passed", F.col("failure").isNull())


def audit_rate(audit: DataFrame) -> DataFrame:
    """Documents, passes and the pass rate; the flag is evaluated once per row."""
    counted = audit.groupBy("passed").agg(F.count("*").alias("n"))
    passes = F.coalesce(F.sum(F.when(F.col("passed"), F.col("n"))), F.lit(0))
    return counted.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("docs"), passes.alias("passed"),
        F.round(F.try_divide(passes * 100.0, F.sum("n")), 6).alias("pass_rate_pct"))


def profile_json_arrays(docs: DataFrame, json_col: str) -> DataFrame:
    """Which array fields of JSON objects qualify for tabular form, over the corpus."""
    fields = docs.select(F.explode_outer(F.expr(_fields_sql(f"`{json_col}`"))).alias("f")).where("f.kind = 'array'")
    parsed = fields.select(F.col("f.key").alias("field"), F.expr(_elements_sql("f.raw")).alias("e"))
    shaped = parsed.withColumn("rows", F.expr(_rows_sql("e")))
    tabular = (F.size("e") > 0) & F.expr(_tabular_sql("rows"))
    columns = F.when(tabular, F.array_join(F.array_sort(F.transform(F.col("rows")[0], lambda f: f["key"])), ","))
    profiled = shaped.select(
        "field", F.size("e").alias("n"), F.coalesce(tabular, F.lit(False)).alias("tabular"),
        F.expr(f"forall(e, x -> {_is_plain('x')})").alias("primitive"), columns.alias("columns"))
    return profiled.groupBy("field").agg(
        F.count("*").alias("arrays"), F.sum("n").alias("elements"), F.bool_and("tabular").alias("all_tabular"),
        F.bool_and("primitive").alias("all_primitive"), F.count_distinct("columns").alias("key_sets"), F.min("columns").alias("columns"))
