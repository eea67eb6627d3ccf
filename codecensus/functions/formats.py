"""Reading flat shapes of TOML and YAML with splits inside a row.

A text is split in front of its section headers, so every block knows its header; no
window over lines and no shuffle. Anchors, flow style and multi-line strings stay unread.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def _c(col: Column | str) -> Column:
    return F.col(col) if isinstance(col, str) else col


EMPTY = "cast(array() as array<string>)"


def empty_strings() -> Column:
    return F.expr(EMPTY)


def unquote(col: Column) -> Column:
    return F.btrim(F.btrim(col, F.lit(" \t\r\n")), F.lit("\"'"))


# ------------------------------------------------------------------ TOML

def toml_sections(text: Column | str) -> Column:
    """``array<struct<header, body>>``; keys before the first header have header ''."""
    parts = F.split(_c(text), r"(?m)(?=^[ \t]*\[{1,2}[^\]\n\"',]+\]{1,2}[ \t]*(?:#.*)?$)")
    return F.transform(parts, lambda p: F.struct(
        F.regexp_extract(p, r"\A[ \t]*\[{1,2}([^\]\n]+)\]", 1).alias("header"),
        F.regexp_replace(p, r"\A[ \t]*\[{1,2}[^\]\n]+\]{1,2}[^\n]*", "").alias("body")))


def toml_body(sections: Column, header: str) -> Column:
    """Joined bodies of all sections with this header ('' when absent)."""
    return F.array_join(F.transform(F.filter(sections, lambda s: s["header"] == header), lambda s: s["body"]), "\n")


def toml_value(body: Column, key: str) -> Column:
    """Scalar string of a key, '' when absent."""
    return F.regexp_extract(body, rf"""(?m)^[ \t]*{key}[ \t]*=[ \t]*["']([^"'\n]*)["']""", 1)


def toml_strings(body: Column, key: str) -> Column:
    """Strings of a (multi-line) array value."""
    inner = F.regexp_extract(body, rf"""(?m)^[ \t]*["']?{key}["']?[ \t]*=[ \t]*\[((?:[^\]"']++|"[^"]*+"|'[^']*+')*+)\]""", 1)
    double = F.regexp_extract_all(inner, F.lit(r"""["']([^"'\n]*)["']"""), F.lit(1))
    return F.filter(double, lambda s: s != "")


def toml_pairs(body: Column) -> Column:
    """``array<struct<name, value>>`` of simple ``key = value`` lines."""
    lines = F.regexp_extract_all(body, F.lit(r"""(?m)^[ \t]*["']?([\w.@/\-]+)["']?[ \t]*=[ \t]*([^\n]+)$"""), F.lit(0))
    return F.transform(lines, lambda l: F.struct(
        unquote(F.regexp_extract(l, r"^([^=]+)=", 1)).alias("name"), F.btrim(F.regexp_extract(l, r"^[^=]+=(.*)$", 1), F.lit(" \t\r")).alias("value")))


def toml_version(value: Column) -> Column:
    """Version of a dependency value: a string, or ``version`` / ``rev`` of an inline table."""
    inline = F.regexp_extract(value, r"""version\s*=\s*["']([^"']*)["']""", 1)
    rev = F.regexp_extract(value, r"""rev\s*=\s*["']([^"']*)["']""", 1)
    return F.when(value.startswith("{"), F.when(inline != "", inline).otherwise(rev)).otherwise(
        F.regexp_extract(value, r"""^["']([^"']*)["']""", 1))


# ------------------------------------------------------------------ YAML

def yaml_even(text: Column | str) -> Column:
    """Comment-free text whose nesting step is two blanks."""
    t = F.regexp_replace(_c(text), r"(?m)^[ \t]*#[^\n]*$|[ \t]+#[^\n]*$", "")
    four = t.rlike(r"(?m)^ {4}\S") & ~t.rlike(r"(?m)^ {2}\S")
    return F.when(four, F.regexp_replace(t, r"(?m)(?:^|\G(?!^)) {4}", "  ")).otherwise(t)


def yaml_blocks(text: Column, depth: int) -> Column:
    """Blocks that start at nesting ``depth`` (list items do not start a block)."""
    pad = "  " * depth
    return F.filter(F.split(text, rf"(?m)(?=^{pad}[^\s#\-][^\n]*:)"), lambda b: b.rlike(rf"\A{pad}[^\s#\-]"))


def yaml_key(block: Column) -> Column:
    return unquote(F.regexp_extract(block, r"\A\s*([^:\n]+?)[ \t]*:", 1))


def yaml_scalar(block: Column) -> Column:
    """Inline value of the block's own key."""
    return unquote(F.regexp_extract(block, r"\A\s*[^:\n]+:[ \t]*([^\n]*)", 1))


def yaml_inner(block: Column) -> Column:
    """Everything below the first line of a block."""
    return F.when(block.contains("\n"), F.regexp_replace(block, r"\A[^\n]*\n", "")).otherwise("")


def yaml_child(blocks: Column, key: str) -> Column:
    """First block with this key, '' when absent."""
    return F.coalesce(F.try_element_at(F.filter(blocks, lambda b: yaml_key(b) == key), F.lit(1)), F.lit(""))


def yaml_items(block: Column, depth: int) -> Column:
    """Values of a block's list, written inline ``[a, b]`` or as ``- a`` lines."""
    inline = F.regexp_extract(block, r"\A\s*[^:\n]+:[ \t]*\[([^\]\n]*)\]", 1)
    dashed = F.regexp_extract_all(yaml_inner(block), F.lit(rf"(?m)^ {{{max(2 * depth - 2, 0)},{2 * depth + 2}}}-[ \t]+([^\n]+)$"), F.lit(1))
    many = F.when(inline != "", F.split(inline, ",")).otherwise(dashed)
    return F.filter(F.transform(many, unquote), lambda x: x != "")
