"""Package names, versions and package URLs."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Package-URL type where it differs from the ecosystem name.
PURL_TYPES = {"go": "golang", "rubygems": "gem"}


def _c(col: Column | str) -> Column:
    return F.col(col) if isinstance(col, str) else col


def requirement_parts(raw: Column | str) -> Column:
    """``struct<name, version>`` of a requirement such as ``name[extra]>=1.0; marker``."""
    pattern = r"^([A-Za-z0-9._\-]+)\s*(\[[^\]]*\])?\s*(.*)$"
    bare = F.btrim(F.substring_index(_c(raw), ";", 1), F.lit(" \t\r\n"))
    return F.struct(
        F.regexp_extract(bare, pattern, 1).alias("name"),
        F.btrim(F.regexp_extract(bare, pattern, 3)).alias("version"),
    )


def clean_version(version: Column | str) -> Column:
    bare = F.regexp_replace(_c(version), r"""^[\^~>=<\s"'v]*""", "")
    return F.btrim(F.btrim(bare, F.lit(" \t\r\n")), F.lit('"'))


def exact_version(version: Column | str) -> Column:
    """Version that an advisory can be looked up for, '' for ranges."""
    v = F.btrim(F.ltrim(F.btrim(F.coalesce(_c(version), F.lit(""))), F.lit("=^~v ")))
    return F.when(v.rlike(r"[*<>|,^~ ]"), F.lit("")).otherwise(v)


def normal_name(name: Column | str, ecosystem: Column | str) -> Column:
    n, e = _c(name), _c(ecosystem)
    return (
        F.when(e == "pypi", F.lower(F.replace(n, F.lit("_"), F.lit("-"))))
        .when(e == "maven", F.substring_index(n, ":", -1))
        .otherwise(n)
    )


def purl(name: Column | str, version: Column | str, ecosystem: Column | str) -> Column:
    e = _c(ecosystem)
    kind = e
    for eco, typ in PURL_TYPES.items():
        kind = F.when(e == eco, typ).otherwise(kind)
    at = F.when(_c(version) != "", F.concat(F.lit("@"), clean_version(version))).otherwise("")
    return F.concat(F.lit("pkg:"), kind, F.lit("/"), F.btrim(_c(name)), at)


def is_unpinned(version: Column | str) -> Column:
    from codecensus.rules.dependencies import UNPINNED

    v = F.btrim(F.coalesce(_c(version), F.lit("")))
    return v.isin(*UNPINNED) | v.startswith("*") | v.startswith("x")
