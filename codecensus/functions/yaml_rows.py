"""Nested YAML as rows: one fold over the lines of a text, inside its row.

``yaml_rows`` gives ``array<struct<path, value, line, text>>`` in the order of the text. ``path`` holds the keys from the
top down to the row; an item of a list adds its number. Every key has a row, with an empty value if all it has stands
below it. The fold carries a stack of open keys with their indents, so any nesting step will do, also lists that stand as
deep as their key. Lines of block scalars and of values that run on are rows of their own with ``text`` set, trimmed and
under the path of their key; flow lists and maps, over one or several lines, become rows as well (six levels
deep). Comments, quotes, anchors and tags are taken off; aliases and merge keys stay as
they are written. One document at a time: split a text with ``documents`` first.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from codecensus.functions.matching import bound

ROW = "struct<path:array<string>,value:string,line:int,text:boolean>"
STACK = "array<struct<indent:int,item:boolean,key:string,n:int>>"
#: Tokens are folded in chunks of so many; a list that grows by one entry a step is copied each time.
CHUNK = 256

_COMMENT = r"""^((?:[^\s"']++|"(?:[^"\\]|\\.)*+"|'[^']*+'|["']|\s++(?!#))*+)\s++#.*$"""
_KEY = r"""^("(?:[^"\\]|\\.)*+"|'[^']*+'|[^\s"'\[{#&*!|>%@`\-][^:]*+(?::(?=\S)[^:]*+)*+)[ \t]*:(?=[ \t]|$)"""
_DASHES = r"^[ \t]*(?:-(?:[ \t]+|$))*"
_BLOCK = r"^[|>][-+0-9]*$"
# Pieces of a flow list or map: quoted texts and nested brackets are not cut.
FLOW_LEVELS = 6


def _nested(levels: int) -> str:
    """A bracketed text with brackets in it, so many levels deep."""
    inside = r"""[^\[\]{}"']|"(?:[^"\\]|\\.)*+"|'[^']*+'|["']"""
    return r"[\[{](?:" + inside + ("|" + _nested(levels - 1) if levels > 1 else "") + r")*+[\]}]"


_PIECE = r"""(?:[^,"'\[\]{}]|"(?:[^"\\]|\\.)*+"|'[^']*+'|""" + _nested(FLOW_LEVELS - 1) + ")++"


def documents(text: Column) -> Column:
    """The documents of a text; every one keeps the number of its first line as ``first``."""
    parts = F.split(text, r"(?m)^---(?=[ \t\r]|$)[^\n]*$")
    breaks = lambda s: F.length(s) - F.length(F.replace(s, F.lit("\n"), F.lit("")))
    return F.aggregate(
        parts, F.struct(F.lit(0).alias("at"), F.expr("cast(array() as array<struct<first:int,text:string>>)").alias("out")),
        lambda a, p: F.struct((a["at"] + breaks(p)).alias("at"), F.array_append(a["out"], F.struct(a["at"].alias("first"), p.alias("text"))).alias("out")),
        lambda a: a["out"])


def bare(value: Column) -> Column:
    """A value without tag, anchor and quotes."""
    quoted = lambda v: (F.length(v) > 1) & (F.left(v, F.lit(1)) == F.right(v, F.lit(1))) & F.left(v, F.lit(1)).isin('"', "'")
    return bound(F.regexp_replace(F.btrim(value, F.lit(" \t\r")), r"^(?:[&!][^\s]*+[ \t]*)+", ""),
                 lambda v: F.when(quoted(v), F.substr(v, F.lit(2), F.length(v) - 2)).otherwise(v))


def _tokens(text: Column) -> Column:
    """``array<struct<line, first, raw, indent, item, body>>``: one token for each dash in front of a line and one for the rest."""
    def of_line(raw: Column, n: Column) -> Column:
        token = lambda first, indent, item, body: F.struct(
            (n + 1).cast("int").alias("line"), first.alias("first"), raw.alias("raw"), indent.cast("int").alias("indent"), F.lit(item).alias("item"), body.alias("body"))

        def cut_at(dashes: Column) -> Column:
            rest = F.substr(raw, F.length(dashes) + 1)
            clean = F.btrim(F.when(rest.startswith("#"), "").when(rest.contains(" #") | rest.contains("\t#"), F.regexp_replace(rest, _COMMENT, "$1")).otherwise(rest), F.lit(" \t\r"))
            marks = F.filter(F.sequence(F.lit(1), F.length(dashes)), lambda k: F.substr(dashes, k, F.lit(1)) == "-")
            items = F.transform(marks, lambda k, i: token(i == 0, k - 1, True, F.lit("")))
            last = F.array(token(~dashes.contains("-"), F.length(dashes), False, clean))
            return F.when(dashes.contains("-"), F.concat(items, last)).otherwise(last)

        return bound(F.regexp_extract(raw, _DASHES, 0), cut_at)

    return F.flatten(F.transform(F.split(text, "\n"), of_line))


def _open(value: Column) -> Column:
    """How many brackets of a text are not closed."""
    left_out = lambda plain, marks: F.length(F.translate(plain, marks, ""))
    return bound(F.regexp_replace(value, r"""\"(?:[^"\\]|\\.)*+"|'[^']*+'""", ""), lambda plain: left_out(plain, "]}") - left_out(plain, "[{"))


def _is_flow(value: Column) -> Column:
    return value.startswith("[") | value.startswith("{")


def _step(a: Column, t: Column) -> Column:
    none = F.expr(f"cast(array() as array<{ROW}>)")

    def state(stack: Column, block: Column, flow: Column, at: Column, new: Column) -> Column:
        return F.struct(stack.cast(STACK).alias("stack"), block.cast("int").alias("block"), flow.alias("flow"), at.cast("int").alias("at"),
                        F.concat(a["out"], new.cast(f"array<{ROW}>")).alias("out"))

    def row(stack: Column, value: Column, line: Column, text: bool) -> Column:
        return F.array(F.struct(F.transform(stack, lambda e: e["key"]).alias("path"), value.alias("value"), line.alias("line"), F.lit(text).alias("text")))

    width = F.length(t["raw"]) - F.length(F.ltrim(t["raw"], F.lit(" \t")))
    blank = F.btrim(t["raw"], F.lit(" \t\r")) == ""
    no_block, no_flow, no_line = F.lit(-1), F.lit(""), F.lit(0)
    inside = (a["block"] >= 0) & (blank | (width > a["block"]))
    spoken = F.when(t["first"] & ~blank, row(a["stack"], F.btrim(t["raw"], F.lit(" \t\r")), t["line"], True)).otherwise(none)
    joined = F.concat(a["flow"], F.lit(" "), F.when(t["raw"].rlike(r"^\s*#"), "").otherwise(F.btrim(F.regexp_replace(t["raw"], _COMMENT, "$1"), F.lit(" \t\r"))))
    on = F.when(~t["first"], state(a["stack"], no_block, a["flow"], a["at"], none)).otherwise(bound(joined, lambda j: F.when(
        _open(j) > 0, state(a["stack"], no_block, j, a["at"], none)).otherwise(state(a["stack"], no_block, no_flow, no_line, row(a["stack"], j, a["at"], False)))))
    # A dash closes what stands deeper and the item before it; the key it belongs to may stand as deep as the dash.
    above = F.filter(a["stack"], lambda e: (e["indent"] < t["indent"]) | ((e["indent"] == t["indent"]) & ~e["item"]))
    before = F.filter(a["stack"], lambda e: e["item"] & (e["indent"] == t["indent"]))
    n = F.coalesce(F.try_element_at(before, F.lit(1))["n"] + 1, F.lit(0))
    entry = lambda item, key, k: F.array(F.struct(t["indent"].alias("indent"), F.lit(item).alias("item"), key.alias("key"), k.alias("n")))
    item = state(F.concat(above, entry(True, n.cast("string"), n)), no_block, no_flow, no_line, none)

    def with_key(key: Column) -> Column:
        parents = F.filter(a["stack"], lambda e: e["indent"] < t["indent"])
        raw_value = F.btrim(F.when(key != "", F.regexp_replace(t["body"], _KEY, "")).otherwise(t["body"]), F.lit(" \t\r"))
        value = F.regexp_replace(raw_value, r"^(?:[&!][^\s]*+[ \t]*)+", "")
        stack = F.when(key != "", F.concat(parents, entry(False, bare(key), F.lit(0)))).otherwise(parents)
        return bound(F.struct(key.alias("key"), value.alias("value"), parents.alias("parents"), stack.alias("stack")), with_value)

    def with_value(b: Column) -> Column:
        key, value, stack, last = b["key"], b["value"], b["stack"], F.try_element_at(b["parents"], F.lit(-1))
        owner = F.when(key != "", t["indent"]).otherwise(F.coalesce(last["indent"], F.lit(0)))
        deeper = (key == "") & ~_is_flow(value) & ~F.coalesce(last["item"], F.lit(False))
        return (
            F.when(value.rlike(_BLOCK), state(stack, owner, no_flow, no_line, F.when(key != "", row(stack, F.lit(""), t["line"], False)).otherwise(none)))
            .when(_is_flow(value) & (_open(value) > 0), state(stack, no_block, value, t["line"], none))
            .when(deeper, state(stack, no_block, no_flow, no_line, row(stack, bare(value), t["line"], True)))
            .otherwise(state(stack, no_block, no_flow, no_line, row(stack, F.when(_is_flow(value), value).otherwise(bare(value)), t["line"], False))))

    line = bound(F.regexp_extract(t["body"], _KEY, 1), with_key)
    return (F.when(inside, state(a["stack"], a["block"], no_flow, no_line, spoken)).when(a["flow"] != "", on).when(t["item"], item)
            .when(t["body"] == "", state(a["stack"], no_block, no_flow, no_line, none)).otherwise(line))


def _spread_flow(r: Column) -> Column:
    """A row with a flow list or map as the row of its key and one row for each entry."""
    inner = F.substr(r["value"], F.lit(2), F.length(r["value"]) - 2)
    pieces = F.filter(F.transform(F.regexp_extract_all(inner, F.lit(_PIECE), F.lit(0)), lambda p: F.btrim(p, F.lit(" \t\r"))), lambda p: p != "")
    made = lambda keys, value: F.struct(keys.alias("path"), value.alias("value"), r["line"].alias("line"), F.lit(False).alias("text"))
    own = F.array(made(r["path"], F.lit("")))
    add = lambda k: F.array_append(r["path"], k)
    pair = lambda p: made(add(bare(F.regexp_extract(p, r"""^("[^"]*+"|'[^']*+'|[^:]*+)""", 1))), bare(F.regexp_replace(p, r"""^(?:"[^"]*+"|'[^']*+'|[^:]*+):?""", "")))
    listed = F.transform(pieces, lambda p, i: made(add(i.cast("string")), bare(p)))
    return (F.when(~r["text"] & r["value"].rlike(r"^\[[\s\S]*\]$"), F.concat(own, listed))
            .when(~r["text"] & r["value"].rlike(r"^\{(?!\{)[\s\S]*\}$"), F.concat(own, F.transform(pieces, pair))).otherwise(F.array(r)))


def yaml_rows(text: Column | str) -> Column:
    """Rows of one document; see the module. A null text has none."""
    t = F.col(text) if isinstance(text, str) else text
    none = F.expr(f"cast(array() as array<{ROW}>)")

    def fold(tokens: Column) -> Column:
        start = F.struct(F.expr(f"cast(array() as {STACK})").alias("stack"), F.lit(-1).alias("block"), F.lit("").alias("flow"), F.lit(0).alias("at"), F.expr(f"cast(array() as array<array<{ROW}>>)").alias("done"))

        def chunk(s: Column, k: Column) -> Column:
            begin = F.struct(s["stack"].alias("stack"), s["block"].alias("block"), s["flow"].alias("flow"), s["at"].alias("at"), none.alias("out"))
            return F.aggregate(F.slice(tokens, k * CHUNK + 1, F.lit(CHUNK)), begin, _step, lambda e: F.struct(
                e["stack"].alias("stack"), e["block"].alias("block"), e["flow"].alias("flow"), e["at"].alias("at"), F.array_append(s["done"], e["out"]).alias("done")))

        chunks = F.sequence(F.lit(0), F.floor((F.size(tokens) - 1) / CHUNK).cast("int"))
        return F.aggregate(chunks, start, chunk, lambda s: F.flatten(s["done"]))

    # The tokens are bound to a variable, so that every chunk reads the same array.
    rows = bound(_tokens(F.coalesce(t, F.lit(""))), fold)
    # Rows are only read again where a flow list or map is left among them.
    left = lambda rows: F.exists(rows, lambda r: ~r["text"] & _is_flow(r["value"]))
    for _ in range(FLOW_LEVELS):
        rows = bound(rows, lambda rs: F.when(left(rs), F.flatten(F.transform(rs, _spread_flow))).otherwise(rs))
    return rows


def _is(path: Column, pattern: tuple[str, ...]) -> Column:
    """Whether a path has these keys; '*' stands for any one key, a leading '**' for any number."""
    tail = pattern[1:] if pattern[0] == "**" else pattern
    test = F.size(path) >= len(tail) if pattern[0] == "**" else F.size(path) == len(tail)
    for k, key in enumerate(tail):
        if key != "*":
            test = test & (F.try_element_at(path, F.lit(k - len(tail))) == key)
    return F.coalesce(test, F.lit(False))


def value_at(rows: Column, *pattern: str) -> Column:
    """First value under a path, '' without one."""
    return F.coalesce(F.try_element_at(F.filter(rows, lambda r: ~r["text"] & _is(r["path"], pattern)), F.lit(1))["value"], F.lit(""))


def values_at(rows: Column, *pattern: str) -> Column:
    """All values but empty ones under a path, in order."""
    return F.transform(F.filter(rows, lambda r: ~r["text"] & (r["value"] != "") & _is(r["path"], pattern)), lambda r: r["value"])


def list_at(rows: Column, *pattern: str) -> Column:
    """The items of a list, the keys of a map, or the one value of a scalar, under a path."""
    deep = len(pattern)
    below = F.filter(rows, lambda r: ~r["text"] & _is(r["path"], (*pattern, "*")))
    named = F.transform(below, lambda r: F.when(F.element_at(r["path"], deep + 1).rlike("^[0-9]+$"), r["value"]).otherwise(F.element_at(r["path"], deep + 1)))
    return F.when(F.size(below) > 0, F.filter(named, lambda v: v != "")).otherwise(values_at(rows, *pattern))


def under(rows: Column, *pattern: str) -> Column:
    """The rows below a path, with what is left of their paths."""
    deep = len(pattern)
    return F.transform(
        F.filter(rows, lambda r: (F.size(r["path"]) > deep) & _is(F.slice(r["path"], 1, deep), pattern)),
        lambda r: F.struct(F.slice(r["path"], F.lit(deep + 1), F.size(r["path"])).alias("path"), r["value"].alias("value"), r["line"].alias("line"), r["text"].alias("text")))
