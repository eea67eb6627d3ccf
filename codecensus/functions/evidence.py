"""Does a line use something, or does it only mention or define it?"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from codecensus.rules import security as S


def _c(col: Column | str) -> Column:
    return F.col(col) if isinstance(col, str) else col


def is_comment_line(line: Column | str) -> Column:
    return _c(line).rlike(S.COMMENT_LINE)


def is_pattern_definition(line: Column | str) -> Column:
    signals = [_c(line).rlike(p).cast("int") for p in S.REGEX_SIGNALS]
    return sum(signals[1:], signals[0]) >= 2


def is_whole_raw_string(line: Column | str, matched: Column | str) -> Column:
    bodies = F.regexp_extract_all(_c(line), F.lit(S.RAW_STRING), F.lit(2))
    return (_c(matched) != "") & F.array_contains(bodies, _c(matched))


def is_xml_namespace(line: Column | str, matched: Column | str = "") -> Column:
    hit = _c(line).rlike("(?i)" + S.XML_NAMESPACE_HOSTS) | _c(line).rlike("(?i)" + S.XML_NAMESPACE_CONTEXT)
    if isinstance(matched, str) and not matched:
        return hit
    return hit | _c(matched).rlike("(?i)" + S.XML_NAMESPACE_HOSTS)


def declares_no_security_use(line: Column | str) -> Column:
    return _c(line).rlike(S.NON_SECURITY_HASH)


def is_language_comment(line: Column | str, language: Column | str) -> Column:
    """Does the line open with a comment prefix of its own language?"""
    out = F.lit(False)
    for name, prefixes in S.COMMENT_PREFIXES.items():
        opened = F.lit(False)
        for p in prefixes:
            opened = opened | _c(line).startswith(p)
        out = F.when(_c(language) == name, opened).otherwise(out)
    return out


def valid_citations(values: Column | str) -> Column:
    """Distinct, trimmed ``path`` / ``path:line`` / range / list citations."""
    # Fixed value: path, path:line, path:from-to and path:line,line.
    shape = r"^[\w./\\@+-]+(?::\d+(?:-\d+)?(?:,\d+(?:-\d+)?)*)?$"
    trimmed = F.transform(_c(values), lambda v: F.btrim(v))
    return F.array_distinct(F.filter(trimmed, lambda v: v.rlike(shape)))
