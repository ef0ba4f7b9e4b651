"""The line format one document at a time: plain Python that Arrow workers run.

The patterns are the ones of the column expressions, read as Java reads them.
What only Spark's own readers settle (JSON inside a value, decimal numbers,
documents that are not plain) is left to the expressions around these functions.
"""

from __future__ import annotations

import json
import re

from emberkeep.functions.text import BARE_KEY, ESCAPES, MUST_QUOTE, NUMBER

# Fixed values of the format.
HEADER_LINES = ["%lson 1.0", "%delimiter comma", "%strict true", "---"]
CLOSE = "---"
INDENT = "  "
MAX_OBJECT_DEPTH = 2

QUOTED = r'"(?:[^"\\]|\\.)*"'
ARRAY_HEADER = rf'^({QUOTED}|[A-Za-z_][^\["\:]*)?\[(\d*)([\t|]?)\](\{{(?:{QUOTED}|[^}}"])*\}})?:\s*(.*)$'
KEY_VALUE = rf'^({QUOTED}|[^":\[\{{]+):\s*(.*)$'
LENGTH = r"^[^:]*?\[([^\]\t|]*)[\t|]?\]"

# The wording that users of the format look for.
MESSAGES = {
    "space": "Trailing space", "tab": "Tab character used in indentation", "indent": "Indentation %d is not a multiple of 2",
    "width": "Row has %d columns, expected %d", "open": "Unterminated quoted string", "escape": "Invalid escape sequence: %s",
    "dangling": "Unterminated escape sequence at end of line", "header": "Malformed array header: %s", "negative": "Negative array length: %s",
    "length": "Non-integer array length: %s", "empty": "Empty field list {} in tabular header", "delimiter": "Field list may not use the declared delimiter '%s'",
    "colon": "Missing colon — expected key: value but got: %s", "count": "Declared %d items but counted %d",
    "unclosed": "Array block opened at line %d was never closed with ---",
}

_head = "\n".join(HEADER_LINES) + "\n"
LINE_ENDS = r"\n\r\x85\u2028\u2029"


def java(pattern: str) -> re.Pattern:
    """A pattern as Java reads it: classes are ASCII, ``.`` is no line end, ``$`` stands before a last line end too."""
    out, in_class, i = [], False, 0
    while i < len(pattern):
        c = pattern[i]
        if c == "\\":
            out.append(pattern[i : i + 2])
            i += 2
            continue
        if c in "[]":
            in_class = c == "["
        out.append(c if in_class or c not in ".$" else rf"[^{LINE_ENDS}]" if c == "." else rf"(?=(?:\r\n|[{LINE_ENDS}])?\Z)")
        i += 1
    return re.compile("".join(out), re.ASCII)


_quoted, _whole_quoted = java(QUOTED), java(f"^{QUOTED}$")
_header, _key_value, _length = java(ARRAY_HEADER), java(KEY_VALUE), java(LENGTH)
_must_quote, _bare_key, _number = java(MUST_QUOTE), java(BARE_KEY), java(NUMBER)
_item, _quotes, _digits, _negative = java(r"^-(?: |$)"), java(r'(?s)^".*"$'.removeprefix("(?s)").replace(".", r"[\s\S]")), java(r"^\d*$"), java(r"^-\d+$")
_dangling, _bad_escape = java(r'"(?:[^"\\]|\\.)*\\$'), java(r'(\\[^"\\nrt])')
_bracketed, _no_fields, _indent = java(r"^[^:]*\[[^\]]*\].*:"), java(r"^\{\s*\}$"), java(r"^([ \t]*)")
_cell = {d: java(rf'((?:{QUOTED}|[^{re.escape(d)}"])*){re.escape(d)}') for d in (",", "|", "\t")}


# --- encoding -------------------------------------------------------------------


class NotPlain(ValueError):
    """JSON that takes Spark's readers: decimal or very large numbers, keys that repeat, values that stay JSON."""


def _refused(_: str):
    raise NotPlain


def _whole(digits: str) -> int:
    n = int(digits)
    if digits == "-0" or not -(2**63) <= n < 2**63:
        raise NotPlain
    return n


def _object(pairs: list[tuple[str, object]]) -> dict:
    found = dict(pairs)
    if len(found) != len(pairs):
        raise NotPlain
    return found


_json = json.JSONDecoder(object_pairs_hook=_object, parse_float=_refused, parse_int=_whole, parse_constant=_refused)
_blank_object = re.compile(r"\{\s+\}")
LONGEST = 1_000_000  # characters; beyond, Spark's own limits may hold


def _quoted_text(s: str) -> str:
    for plain, escaped in ESCAPES:
        s = s.replace(plain, escaped)
    return f'"{s}"'


def _key_text(k: str) -> str:
    return k if _bare_key.search(k) else _quoted_text(k)


def _token_text(v: object) -> str:
    if isinstance(v, str):
        return _quoted_text(v) if _must_quote.search(v) else v
    return "null" if v is None else "true" if v is True else "false" if v is False else str(v)


def _plain(v: object) -> bool:
    return not isinstance(v, (dict, list))


def _cells_text(values: list) -> str:
    return ", ".join(map(_token_text, values))


def _flat_text(head: str, pad: str, values: list) -> str:
    return f"{head}[{len(values)}]: {_cells_text(values)}" if values else f"{head}[0]:\n{pad}{CLOSE}"


def _item_text(v: object, depth: int) -> str:
    if _plain(v):
        return f"- {_token_text(v)}"
    if isinstance(v, list):
        if not all(map(_plain, v)):
            raise NotPlain
        return f"- [{len(v)}]: {_cells_text(v)}"
    if not v:
        return "-"
    pad, lines = INDENT * (depth + 2), []
    for key, value in v.items():
        head = f"{pad if lines else '- '}{_key_text(key)}"
        if _plain(value):
            lines.append(f"{head}: {_token_text(value)}")
        elif lines and isinstance(value, list) and all(map(_plain, value)):
            lines.append(_flat_text(head, pad, value))
        else:
            raise NotPlain
    return "\n".join(lines)


def _array_text(head: str, pad: str, values: list, depth: int) -> str:
    if all(map(_plain, values)):
        return _flat_text(head, pad, values)
    first = values[0]
    if depth < MAX_OBJECT_DEPTH and isinstance(first, dict) and first and all(
            isinstance(r, dict) and r.keys() == first.keys() and all(map(_plain, r.values())) for r in values):
        rows = "\n".join(f"{pad}{INDENT}{_cells_text([r[k] for k in first])}" for r in values)
        return f"{head}[{len(values)}]{{{', '.join(map(_key_text, first))}}}:\n{rows}\n{pad}{CLOSE}"
    items = "\n".join(f"{pad}{INDENT}{_item_text(v, depth)}" for v in values)
    return f"{head}[{len(values)}]:\n{items}\n{pad}{CLOSE}"


def _object_text(fields: dict, depth: int) -> str:
    pad, lines = INDENT * depth, []
    for key, value in fields.items():
        head = f"{pad}{_key_text(key)}"
        if _plain(value):
            lines.append(f"{head}: {_token_text(value)}")
        elif isinstance(value, list):
            lines.append(_array_text(head, pad, value, depth))
        elif not value:
            lines.append(f"{head}: {{}}")
        elif depth < MAX_OBJECT_DEPTH:
            lines.append(f"{head}:\n{_object_text(value, depth + 1)}")
        else:
            raise NotPlain
    return "\n".join(lines)


def encode_plain(text: str | None) -> str | None:
    """The document of a JSON object, or null where it is not plain JSON or none at all."""
    if text is None or len(text) > LONGEST:
        return None
    try:
        fields = _json.decode(text)
        if not isinstance(fields, dict) or _blank_object.search(text):
            return None
        document = _head + _object_text(fields, 0)
        document.encode()  # half a surrogate pair
        return document
    except (ValueError, RecursionError):
        return None


# --- reading lines ----------------------------------------------------------------


NODE = ("parent", "end", "first_field", "members", "items")
PLAIN, ITEM, CLOSES = 0, 1, 2  # what the tree has to know of a line


def nearest_smaller(depths: list[int], marks: list[int]) -> list[tuple[int, int, int, int, int]]:
    """Of each line of a document: the nearest line above at a smaller depth, and what hangs one level below the line itself.

    ``end`` is the next line at the same or a smaller depth, ``first_field``
    the first line one level below that is no list item; -1 stands for none.
    One pass with a stack, whatever the depths.
    """
    n = len(depths)
    parents, ends, fields, members, items = [-1] * n, [n] * n, [-1] * n, [0] * n, [0] * n
    open_lines: list[int] = []
    for i, depth in enumerate(depths):
        while open_lines and depths[open_lines[-1]] >= depth:
            ends[open_lines.pop()] = i
        if open_lines:
            parent = parents[i] = open_lines[-1]
            if depths[parent] == depth - 1 and marks[i] != CLOSES:
                members[parent] += 1
                if marks[i] == ITEM:
                    items[parent] += 1
                elif fields[parent] < 0:
                    fields[parent] = i
        open_lines.append(i)
    return list(zip(parents, ends, fields, members, items))


def _directive(head: list[str], name: str, default: str) -> str:
    start = f"%{name} "
    return next((x[len(start) :].strip(" ") for x in head if x.startswith(start)), default)


class Line:
    """A meaningful line: what it is by itself, and its place in the tree of lines."""

    __slots__ = ("no", "raw", "content", "spaces", "depth", "item", "body", "header", "pair", "shape", "kind", "mark", "parent", "end", "first_field", "members", "items", "_names")

    def __init__(self, no: int, raw: str, content: str, delimiter: str):
        self.no, self.raw, self.content = no, raw, content
        self.spaces = len(raw) - len(raw.lstrip(" "))
        self.depth = self.spaces // 2
        self.item = content[0] == "-" and _item.search(content) is not None
        body = self.body = content[1:].strip(" ") if self.item else content
        header = self.header = _header.search(body) if "[" in body else None
        self.pair = None
        if content == CLOSE:
            shape = "close"
        elif header:
            shape = "tabular" if header[4] else "inline" if header[5] else "list"
        else:
            self.pair = _key_value.search(body) if ":" in body else None
            shape = "field" if self.pair else "token"
        self.shape = self.kind = shape  # ``shape`` is what it is to the lines below, ``kind`` may be a row
        self.mark = header and header[3] or delimiter
        self._names = None

    @property
    def keyed(self) -> bool:
        return self.shape == "field" or (self.header is not None and self.shape != "close" and bool(self.header[1]))

    @property
    def valued(self) -> bool:
        return self.shape == "inline" or (self.shape == "field" and self.pair[2] != "") or (self.shape == "token" and self.body != "")

    @property
    def names(self) -> list[str]:
        if self._names is None:
            self._names = [unquoted(c) for c in split_cells(self.header[4][1:-1], self.mark)]
        return self._names

    @property
    def declared(self) -> int | None:
        return whole_number(self.header[2]) if self.header else None

    @property
    def counted(self) -> int:
        return self.members if self.kind == "tabular" else self.items


def whole_number(digits: str) -> int | None:
    short = digits.lstrip("0")
    return int(short or 0) if digits and len(short) <= 10 and int(short or 0) < 2**31 else None


def classified(text: str | None) -> tuple[bool, list[Line]]:
    """Whether a document is strict, and its meaningful lines with the lines they hang under."""
    if text is None:
        return True, []
    raws = text.split("\n")
    trimmed = [x.strip(" ") for x in raws]
    head = trimmed[: trimmed.index(CLOSE) + 1 if CLOSE in trimmed else 1]
    if not any(x.startswith("%") for x in head):
        head = []
    delimiter = {"tab": "\t", "pipe": "|"}.get(_directive(head, "delimiter", "comma"), ",")
    lines = [Line(i + 1, raws[i], trimmed[i], delimiter) for i in range(len(head), len(raws)) if trimmed[i] and trimmed[i][0] not in "#%"]
    depths = [x.depth for x in lines]
    marks = [CLOSES if x.shape == "close" else ITEM if x.item else PLAIN for x in lines]
    for line, (parent, line.end, line.first_field, line.members, line.items) in zip(lines, nearest_smaller(depths, marks)):
        up = line.parent = lines[parent] if parent >= 0 else None
        if up and up.shape == "tabular" and line.shape != "close" and up.depth == line.depth - 1:
            line.kind = "row"
    return _directive(head, "strict", "true") != "false", lines


_text = rf"[^\s{{}}{LINE_ENDS}][^{LINE_ENDS}]*(?<! )"
_simple = re.compile(
    r"^((?:  )*)([A-Za-z_][A-Za-z0-9_.]*)(?:\[([0-9]{1,9})\]: (" + _text.format("") + r")|: (\{\}|" + _text.format(r"\[{") + r")|:)$", re.ASCII | re.MULTILINE)


def simple_lines(text: str | None) -> list[tuple[str, str, str, str, str]] | None:
    """(indentation, key, length, cells, value) of a strict document where every line is a field or an inline array under a bare key.

    None for other documents, which are read line by line.
    """
    if text is None or not text.startswith(_head):
        return None
    body = text[len(_head) :]
    found = _simple.findall(body)
    return found if len(found) == body.count("\n") + 1 else None


def split_cells(text: str, delimiter: str) -> list[str]:
    """Cells of a row; delimiters inside quotes do not split."""
    cells = _cell[delimiter].findall(text + delimiter) if '"' in text else text.split(delimiter)
    return [c.strip(" ") for c in cells]


def unescaped(body: str) -> str:
    """Undo the five escapes; backslash pairs are split off first."""
    if "\\" not in body:
        return body
    pieces = body.split("\\\\")
    for plain, escaped in ESCAPES[1:]:
        pieces = [p.replace(escaped, plain) for p in pieces]
    return "\\".join(pieces)


def unquoted(s: str) -> str:
    return unescaped(s[1:-1]) if s[:1] == '"' and _whole_quoted.search(s) else s


# --- validation ---------------------------------------------------------------------


def diagnostics(text: str | None) -> list[tuple[int, str, str]]:
    """(line_no, severity, message) for everything wrong with a document."""
    simple = simple_lines(text)
    if simple is not None and "\\" not in text and ('"' not in text or not any('"' in v and '"' in _quoted.sub("", v) for *_, cells, value in simple for v in (cells, value))):
        return []
    lines = classified(text)[1]
    found: list[tuple[int, str, str]] = []
    for line in lines:
        def add(severity: str, message: str, *values: object, no: int = line.no) -> None:
            found.append((no, severity, MESSAGES[message] % values if values else MESSAGES[message]))

        content, kind, b, header = line.content, line.kind, line.body, line.header
        is_header = kind in ("tabular", "list", "inline")
        if line.raw.endswith(" "):
            add("WARNING", "space")
        if "\t" in line.raw and "\t" in _indent.search(line.raw)[1]:
            add("ERROR", "tab")
        if line.spaces % 2:
            add("ERROR", "indent", line.spaces)
        if kind == "row":
            wide, expected = len(split_cells(content, line.parent.mark)), len(line.parent.names)
            if wide != expected:
                add("ERROR", "width", wide, expected)
        if '"' in content:
            unpaired = _quoted.sub("", content)
            if _dangling.search(unpaired):
                add("ERROR", "dangling")
            elif '"' in unpaired:
                add("ERROR", "open")
            bad = _bad_escape.search("".join(q.replace("\\\\", "") for q in _quoted.findall(content))) if "\\" in content else None
            if bad:
                add("ERROR", "escape", bad[1])
        looks_header = digits = False
        if "[" in b and not is_header and kind not in ("row", "close"):
            bare = _quoted.sub('""', b)
            looks_header = _bracketed.search(bare) is not None
            length = _length.search(bare)
            length = length[1].strip(" ") if length else ""
            digits = looks_header and _digits.search(length) is not None
            negative = looks_header and _negative.search(length) is not None
            if negative:
                add("ERROR", "negative", length)
            if looks_header and not digits and not negative:
                add("ERROR", "length", length)
        if is_header and header[2] and line.declared is None:
            add("ERROR", "length", header[2])
        if digits:
            add("ERROR", "header", content)
        if kind == "tabular":
            if _no_fields.search(header[4]):
                add("ERROR", "empty")
            if header[3] and header[3] not in header[4][1:-1]:
                add("WARNING", "delimiter", header[3])
        if kind == "token" and not line.item and not looks_header:
            add("ERROR", "colon", content)
        if kind in ("tabular", "list"):
            if line.end < len(lines):
                if line.declared is not None and line.declared != line.counted:
                    add("ERROR", "count", line.declared, line.counted)
            elif line.declared is not None:
                add("WARNING", "unclosed", line.no)
    return found


# --- decoding -----------------------------------------------------------------------


_odd_controls = re.compile("[\x0b\x0e\x0f\x1a-\x1f]")
_json_string = json.encoder.encode_basestring
LEFT = "\0"  # stands around the number of a value that is left to Spark; no JSON text has it


def json_string(s: str) -> str:
    """A string as a JSON literal, with escapes in capitals."""
    if _odd_controls.search(s):
        return '"' + "".join(f"\\u{ord(c):04X}" if _odd_controls.match(c) else _json_string(c)[1:-1] for c in s) + '"'
    return _json_string(s)


def token_json(s: str, left: list[tuple[str, bool]]) -> str:
    """A token as a JSON literal; a decimal number is put on ``left``."""
    t = s.strip(" ")
    if t[:1] == '"' and len(t) >= 2 and _quotes.search(t):
        return json_string(unescaped(t[1:-1]))
    if t in ("true", "false", "null"):
        return t
    if t[:1] in "-0123456789" and _number.search(t):
        if "." in t or "e" in t or "E" in t:
            left.append((t, True))
            return f"{LEFT}{len(left) - 1}{LEFT}"
        digits = t.removesuffix("\r")
        if len(digits) <= 20 and digits.lstrip("-").isdigit() and -(2**63) <= int(digits) < 2**63:
            return t
    return json_string(t)


def value_json(s: str, left: list[tuple[str, bool]]) -> str:
    if s[:1] in ("{", "["):
        left.append((s, False))
        return f"{LEFT}{len(left) - 1}{LEFT}"
    return token_json(s, left)


# Tokens that share a place are in this order: what ends before a line, what the line's parent closes there, the line itself, what it hides.
ENDS, SWITCHES, OPENS, HIDES = range(4)


def tokens(lines: list[Line], left: list[tuple[str, bool]], errors: list[str]) -> list[tuple]:
    """(place, order, tie, text, is_value, opens, hidden) of a document's lines.

    ``is_value``: a value is complete after this text; ``opens``: it starts a
    member, which a comma parts from the one before.  What is wrong goes to
    ``errors``, values that Spark reads go to ``left``.
    """
    live = [x for x in lines if x.shape != "close"]
    roots = [x for x in live if x.depth == 0]
    root = roots[0] if roots else None
    bare = root is not None and root.shape in ("tabular", "list", "inline") and not root.keyed
    single = len(roots) == 1 and root.shape == "token"
    out: list[tuple] = []
    if not (bare or single):
        out += [(-1, OPENS, 0, "{", False, False, 0), (len(lines), ENDS, 1, "}", True, False, 0)]
    for place, line in enumerate(lines):
        kind = line.kind
        if kind == "close":
            continue
        up, item, depth, b, header, no = line.parent, line.item, line.depth, line.body, line.header, line.no
        key = leaf = None
        if kind == "field":
            key, value = json_string(unquoted(line.pair[1].strip(" "))), line.pair[2]
            leaf = value_json(value, left) if value else None
        elif kind == "token":
            leaf = value_json(b, left) if b else None
        elif kind == "row":
            cells = split_cells(line.content, up.mark)
            if len(cells) != len(up.names):
                errors.append(f"Line {no}: expected {len(up.names)} columns but got {len(cells)}")
            leaf = "{" + ",".join(f"{json_string(n)}:{token_json(cells[i] if i < len(cells) else '', left)}" for i, n in enumerate(up.names)) + "}"
        else:
            key = json_string(unquoted(header[1].strip(" "))) if header[1] else None
            if kind == "inline":
                cells = [c for c in split_cells(header[5], line.mark) if c != ""]
                if line.declared is not None and line.declared != len(cells):
                    errors.append(f"Line {no}: declared length {line.declared} but got {len(cells)}")
                leaf = "[" + ",".join(token_json(c, left) for c in cells) + "]"
        is_list = kind in ("tabular", "list")
        lost = depth > 0 and not (up is not None and up.depth == depth - 1 and up.shape != "close")
        is_pair = key is not None and not item
        late = False
        if depth == 0:
            shown = line is root if bare else single or is_pair
        elif lost:
            shown = False
        else:
            continues = up.item and up.keyed  # the parent's first field stands on its hyphen line, and more follow below
            late = item and up.shape == "list" and continues and 0 <= up.first_field < place
            above = up.parent
            if above is not None and above.shape == "tabular" and above.depth == up.depth - 1:
                shown = False
            elif up.shape == "tabular":
                shown = kind == "row"
            elif up.shape == "list":
                shown = (item and not late) or (continues and is_pair)
            else:
                shown = is_pair and (continues or not up.valued)
        if line.spaces % 2:
            errors.append(f"Line {no}: indentation is not a multiple of 2")
        if kind == "token" and not item and len(live) > 1:
            errors.append(f"Line {no}: missing colon")
        if lost:
            errors.append(f"Line {no}: unexpected depth")
        if late:
            errors.append(f"Line {no}: list item after a field")
        if is_list and not lost and line.declared is not None and line.declared != line.counted:
            errors.append(f"After line {no}: declared {line.declared} but got {line.counted}")
        if shown:
            nested = item and key is not None
            text = leaf if leaf is not None else "[" if is_list else "{"
            if nested:
                text = f"{{{key}:{text}"
            elif is_pair and not (depth == 0 and bare):
                text = f"{key}:{text}"
            out.append((place, OPENS, 0, text, leaf is not None, True, 0))
            # The array of an item whose fields go on below ends before the first of them.
            switches = nested and kind == "list" and line.members > line.items
            if switches:
                out.append((line.first_field, SWITCHES, 0, "]", True, False, 0))
            closing = ("" if leaf is not None or switches else "]" if is_list else "}") + ("}" if nested else "")
            if closing:
                out.append((line.end, ENDS, -place, closing, True, False, 0))
        elif line.end > place + 1:
            out += [(place, HIDES, 0, None, False, False, 1), (line.end, ENDS, -place, None, False, False, -1)]
    return out


def _simple_json(lines: list[tuple[str, str, str, str, str]], left: list[tuple[str, bool]]) -> str | None:
    """The JSON of ``simple_lines``, or None where a line stands too deep or an array has another length."""
    out, level, comma = ["{"], 0, ""
    for indent, key, length, cells, value in lines:
        depth = len(indent) // 2
        if depth != level:
            if depth > level:
                return None
            out.append("}" * (level - depth))
            level, comma = depth, ","
        if value:
            out.append(f'{comma}"{key}":{value if value == "{}" else token_json(value, left)}')
        elif cells:
            values = [token_json(c, left) for c in split_cells(cells, ",") if c != ""]
            if len(values) != int(length):
                return None
            out.append(f'{comma}"{key}":[{",".join(values)}]')
        else:
            out.append(f'{comma}"{key}":{{')
            level, comma = level + 1, ""
            continue
        comma = ","
    out.append("}" * (level + 1))
    return "".join(out)


def _pieces(joined: str, left: list[tuple[str, bool]]) -> list[tuple[str, str | None, bool]]:
    parts = joined.split(LEFT)
    return [(parts[i], *(left[int(parts[i + 1])] if i + 1 < len(parts) else (None, False))) for i in range(0, len(parts), 2)]


def decode(texts: list[str | None]) -> tuple[str | None, list[tuple[str, str | None, bool]] | None, list[str]]:
    """(json, pieces, errors) of the documents under one id, in general one.

    ``pieces`` stand for ``json`` where values are left to Spark: a text, the
    value after it, and whether that is a token that holds no JSON.
    """
    left: list[tuple[str, bool]] = []
    if len(texts) == 1:
        simple = simple_lines(texts[0])
        joined = simple and _simple_json(simple, left)
        if joined:
            return (None, _pieces(joined, left), []) if left else (joined, None, [])
        left.clear()
    errors: list[str] = []
    all_tokens: list[tuple] = []
    any_strict = False
    for text in texts:
        strict, lines = classified(text)
        any_strict |= strict
        all_tokens += tokens(lines, left, errors)
    errors.sort()
    if (errors and any_strict) or any(t is None for t in texts):
        return None, None, errors
    all_tokens.sort(key=lambda t: t[:3])
    out: list = []
    hidden, follows = 0, False
    for token in all_tokens:
        hidden += token[6]
        text = token[3]
        if text is not None and not hidden:
            out.append("," + text if follows and token[5] else text) if len(texts) == 1 else out.append((*token[:3], "," + text if follows and token[5] else text))
            follows = token[4]
    joined = "".join(out if len(texts) == 1 else [t[3] for t in sorted(out)])
    return (None, _pieces(joined, left), errors) if left else (joined, None, errors)
