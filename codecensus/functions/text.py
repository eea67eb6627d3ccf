"""Text helpers as column expressions."""

from __future__ import annotations

import unicodedata
from functools import lru_cache

from pyspark.sql import Column, functions as F

BLANK = " \t\n\r\x0b\x0c"
ELLIPSIS = "…"
# Every separator that ends a line of text, CRLF first.
LINE_BREAK = r"\r\n|[\n\x0B\f\r\x1C-\x1E\x{85}\x{2028}\x{2029}]"
_RARE_BREAK = r"[\x0B\f\r\x1C-\x1E\x{85}\x{2028}\x{2029}]"


def _c(col: Column | str) -> Column:
    return F.col(col) if isinstance(col, str) else col


def strip(col: Column | str) -> Column:
    return F.btrim(_c(col), F.lit(BLANK))


def lines(text: Column | str) -> Column:
    """Array of lines; a final line break opens no extra line, '' has no lines."""
    parts = F.split(_c(text), LINE_BREAK)
    return F.when(F.element_at(parts, -1) == "", F.slice(parts, 1, F.size(parts) - 1)).otherwise(parts)


def line_total(text: Column | str) -> Column:
    """Number of lines, without building the array when only ``\\n`` occurs."""
    t = _c(text)
    breaks = F.length(t) - F.length(F.replace(t, F.lit("\n"), F.lit("")))
    quick = breaks + F.when((t == "") | t.endswith("\n"), 0).otherwise(1)
    return F.when(t.rlike(_RARE_BREAK), F.size(lines(t))).otherwise(quick).cast("long")


def code_line_total(text: Column | str, prefixes: tuple[str, ...] = ("#", "//", "--", "*", "%")) -> Column:
    """Lines that are neither blank nor open with one of the comment prefixes."""
    mute = "".join(f"(?!{_literal(p)})" for p in prefixes)
    return F.regexp_count(_c(text), F.lit(rf"(?m)^[^\S\n]*+{mute}\S")).cast("long")


def _literal(s: str) -> str:
    return "".join("\\" + ch if not ch.isalnum() and not ch.isspace() else ch for ch in s)


@lru_cache(maxsize=1)
def _ascii_fold() -> tuple[str, str]:
    """Letters whose compatibility decomposition keeps exactly one ASCII character."""
    src, dst = [], []
    for cp in [*range(0xA0, 0x250), *range(0x1E00, 0x1F00), *range(0x2070, 0x20A0), *range(0xFF01, 0xFF5F)]:
        kept = unicodedata.normalize("NFKD", chr(cp)).encode("ascii", "ignore").decode()
        if len(kept) == 1:
            src.append(chr(cp))
            dst.append(kept)
    return "".join(src), "".join(dst)


def to_ascii(col: Column | str) -> Column:
    """Fold accented letters to ASCII and drop what has no ASCII form."""
    c = _c(col)
    src, dst = _ascii_fold()
    folded = F.regexp_replace(F.translate(c, src, dst), r"[^\x00-\x7f]", "")
    return F.when(c.rlike(r"[^\x00-\x7f]"), folded).otherwise(c)


def slug(*parts: Column | str, maxlen: int = 80) -> Column:
    """Stable readable id from the non-empty parts; long ids end in a digest."""
    raw = F.concat_ws("-", *[F.when(_c(p) != "", _c(p)) for p in parts])
    base = F.lower(F.btrim(F.regexp_replace(to_ascii(raw), "[^a-zA-Z0-9]+", "-"), F.lit("-")))
    cut = F.concat(
        F.rtrim(F.substring(base, 1, maxlen - 9), F.lit("-")),
        F.lit("-"),
        F.substring(F.sha1(base), 1, 8),
    )
    return F.when(base == "", F.lit("n")).when(F.length(base) > maxlen, cut).otherwise(base)


def one_line(col: Column | str) -> Column:
    return F.regexp_replace(strip(col), r"\s+", " ")


def truncate(col: Column | str, length: int = 160) -> Column:
    flat = one_line(col)
    return F.when(F.length(flat) <= length, flat).otherwise(
        F.concat(F.substring(flat, 1, length - 1), F.lit(ELLIPSIS))
    )


def title_case(col: Column | str) -> Column:
    c = _c(col)
    spaced = F.regexp_replace(F.regexp_replace(c, r"[-_./]+", " "), r"(?<=[a-z0-9])(?=[A-Z])", " ")
    words = F.filter(F.split(strip(spaced), r"\s+"), lambda w: w != "")
    out = F.array_join(F.transform(words, lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.substr(w, F.lit(2)))), " ")
    return F.when(out == "", c).otherwise(out)


def top_dir(path: Column | str) -> Column:
    p = _c(path)
    return F.when(p.contains("/"), F.substring_index(p, "/", 1)).otherwise("")


def dirname(path: Column | str) -> Column:
    p = _c(path)
    return F.when(p.contains("/"), F.regexp_replace(p, r"/[^/]*$", "")).otherwise("")


def basename(path: Column | str) -> Column:
    return F.substring_index(_c(path), "/", -1)


def ancestors(path: Column | str) -> Column:
    """Every directory above a path, the repository root '' first."""
    segs = F.split(_c(path), "/")
    return F.transform(F.sequence(F.lit(0), F.size(segs) - 1), lambda i: F.array_join(F.slice(segs, 1, i), "/"))


def ext(path: Column | str) -> Column:
    name = F.lower(basename(path))
    return F.when(name.contains("."), F.concat(F.lit("."), F.substring_index(name, ".", -1))).otherwise("")


def normal_path(path: Column | str) -> Column:
    """Resolve ``.`` and ``..`` segments of a relative path."""
    segs = F.filter(F.split(_c(path), "/"), lambda s: (s != "") & (s != "."))
    kept = F.aggregate(
        segs,
        F.expr("cast(array() as array<string>)"),
        lambda acc, s: F.when(
            (s == "..") & (F.size(acc) > 0) & (F.element_at(acc, -1) != ".."), F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0)))
        ).otherwise(F.array_append(acc, s)),
    )
    # Most paths hold no dot segment; skip the fold for them.
    return F.when(_c(path).rlike(r"(^|/)\.{0,2}(/|$)"), F.array_join(kept, "/")).otherwise(_c(path))


def common_dir(paths_min: Column, paths_max: Column) -> Column:
    """Shared directory of a group, from its smallest and largest segment arrays.

    Arrays compare segment by segment, so whatever the two extremes share is shared
    by all; the aggregate is a plain min/max that combines on the map side.
    """
    same = F.zip_with(paths_min, paths_max, lambda a, b: F.coalesce(a == b, F.lit(False)))
    first_gap = F.array_position(same, F.lit(False))
    n = F.when(first_gap == 0, F.size(same)).otherwise(first_gap - 1).cast("int")
    return F.array_join(F.slice(paths_min, F.lit(1), n), "/")


def dir_segments(path: Column | str) -> Column:
    segs = F.split(_c(path), "/")
    return F.slice(segs, F.lit(1), F.size(segs) - 1)


def _one_decimal(x: Column) -> Column:
    """One decimal place of 1 <= |x| < 2048, rounded by the exact binary value of x.

    x * 2^52 is a whole number there, so the comparison with the midpoint is exact.
    """
    unit = 2**52
    m = (F.abs(x) * F.lit(float(unit))).cast("long").cast("decimal(38,0)") * F.lit(10).cast("decimal(2,0)")
    q = F.floor(m / F.lit(unit).cast("decimal(20,0)")).cast("decimal(20,0)")
    rest = m - q * F.lit(unit).cast("decimal(20,0)")
    half = F.lit(unit // 2).cast("decimal(20,0)")
    up = (rest > half) | ((rest == half) & (q % 2 == 1))
    tenths = (q + F.when(up, 1).otherwise(0)).cast("long")
    sign = F.when(x < 0, "-").otherwise("")
    return F.concat(sign, F.floor(tenths / 10).cast("string"), F.lit("."), (tenths % 10).cast("string"))


def human_bytes(col: Column | str) -> Column:
    v = _c(col).cast("double")
    out = F.when(F.abs(v) < 1024, F.concat(v.cast("long").cast("string"), F.lit("B")))
    for power, unit in enumerate(("KB", "MB", "GB", "TB"), start=1):
        out = out.when(F.abs(v) < 1024.0 ** (power + 1), F.concat(_one_decimal(v / 1024.0**power), F.lit(unit)))
    return out.otherwise(F.format_string("%.1fPB", v / 1024.0**5))


def human_number(col: Column | str) -> Column:
    v = _c(col).cast("double")
    out = F.when(F.abs(v) < 1000, F.format_string("%.0f", F.bround(v, 0)))
    for power, unit in enumerate(("k", "M", "B"), start=1):
        out = out.when(F.abs(v) < 1000.0 ** (power + 1), F.concat(_one_decimal(v / 1000.0**power), F.lit(unit)))
    return out.otherwise(F.format_string("%.1fT", v / 1000.0**4))


def clamp(col: Column | str, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), _c(col)))


def entropy(col: Column | str) -> Column:
    """Shannon entropy in bits per character."""
    c = _c(col)
    n = F.length(c).cast("double")
    chars = F.array_distinct(F.filter(F.split(c, ""), lambda ch: ch != ""))
    share = lambda ch: (n - F.length(F.replace(c, ch, F.lit("")))) / n
    bits = F.aggregate(chars, F.lit(0.0), lambda acc, ch: acc - share(ch) * F.log2(share(ch)))
    return F.when(F.length(c) == 0, 0.0).otherwise(bits)


def singular(word: Column | str) -> Column:
    w = F.lower(_c(word))
    n = F.length(w)
    return (
        F.when(w.endswith("ies") & (n > 4), F.concat(F.left(w, n - 3), F.lit("y")))
        .when(w.endswith("ses") | w.endswith("xes"), F.left(w, n - 2))
        .when(w.endswith("s") & ~w.endswith("ss"), F.left(w, n - 1))
        .otherwise(w)
    )


def identifier_tokens(word: Column | str) -> Column:
    """Letter runs of an identifier, split on case changes, three letters or more."""
    parts = F.split(_c(word), r"[^a-zA-Z]+|(?<=[a-z0-9])(?=[A-Z])")
    return F.filter(parts, lambda t: F.length(t) >= 3)


def route(base: Column | str, path: Column | str) -> Column:
    """Join a controller base and a path into one absolute route."""
    def clean(c: Column) -> Column:
        bare = F.btrim(F.coalesce(c, F.lit("")), F.lit("\"'` "))
        return F.when((bare != "") & ~bare.startswith("/"), F.concat(F.lit("/"), bare)).otherwise(bare)

    b, p = clean(_c(base)), clean(_c(path))
    joined = F.concat(F.rtrim(b, F.lit("/")), p)
    return F.when(joined == "", F.lit("/")).otherwise(joined)


def matches_any_text(cols: list[str], needle: str) -> Column:
    """Case-insensitive substring test over the shown columns of a table."""
    return F.lower(F.concat_ws(" ", *[F.col(c).cast("string") for c in cols])).contains(needle.lower())


def glob_regex(pattern: str) -> str:
    """Shell glob as an anchored regular expression; ``*`` also crosses ``/``."""
    out, i = [], 0
    while i < len(pattern):
        ch = pattern[i]
        if ch == "*":
            out.append(".*")
        elif ch == "?":
            out.append(".")
        elif ch == "[" and "]" in pattern[i + 2:]:
            end = pattern.index("]", i + 2)
            body = pattern[i + 1:end].replace("\\", "\\\\")
            out.append("[" + ("^" + body[1:] if body.startswith("!") else body) + "]")
            i = end
        else:
            out.append(_literal(ch))
        i += 1
    return "(?s)^" + "".join(out) + "$"


def glob_regex_col(pattern: Column | str) -> Column:
    """Column form of :func:`glob_regex` for patterns that arrive as data."""
    esc = F.regexp_replace(_c(pattern), r"([\\.^$+(){}|])", r"\\$1")
    return F.concat(F.lit("(?s)^"), F.replace(F.replace(esc, F.lit("*"), F.lit(".*")), F.lit("?"), F.lit(".")), F.lit("$"))
