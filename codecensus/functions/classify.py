"""Names and paths to categories."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from codecensus.functions.text import basename, ext
from codecensus.rules import files as R
from codecensus.rules.flows import LANE_DIRS, LANE_FILES
from codecensus.rules.security import FIXTURE_PATH
from codecensus.rules.systems import ENV_KINDS, IMAGES

SEVERITIES = ("critical", "high", "medium", "low", "info")


def _c(col: Column | str) -> Column:
    return F.col(col) if isinstance(col, str) else col


def _map(pairs: dict[str, str]) -> Column:
    flat = [F.lit(x) for kv in pairs.items() for x in kv]
    return F.create_map(*flat)


def language(path: Column | str) -> Column:
    """Language from the file name, else from the extension."""
    name = F.lower(basename(path))
    by_name = F.try_element_at(_map({k: v[0] for k, v in R.FILENAMES.items()}), name)
    by_ext = F.try_element_at(_map({k: v[0] for k, v in R.EXTENSIONS.items()}), ext(path))
    return F.coalesce(
        by_name,
        F.when(name.startswith("dockerfile"), F.lit("Dockerfile")).when(name.startswith(".env"), F.lit("Dotenv")),
        by_ext,
        F.lit("Unknown"),
    )


def code_lines(path: Column | str, text: Column | str) -> Column:
    """Significant lines under the comment prefixes of the file's own name or extension."""
    from codecensus.functions.text import code_line_total

    # Few distinct prefix sets serve all names: look the set up, then count with its pattern.
    sets = list(dict.fromkeys([("#", "//"), ("#",), *(v[1] for v in (*R.FILENAMES.values(), *R.EXTENSIONS.values()))]))
    ids = lambda table: F.create_map(*[F.lit(x) for k, v in table.items() for x in (k, sets.index(v[1]))])
    name = F.lower(basename(path))
    which = F.coalesce(
        F.try_element_at(ids(R.FILENAMES), name), F.when(name.startswith("dockerfile") | name.startswith(".env"), 1),
        F.try_element_at(ids(R.EXTENSIONS), ext(path)), F.lit(0))
    out = F.when(F.lit(False), F.lit(0).cast("long"))
    for i, prefixes in enumerate(sets):
        out = out.when(which == i, code_line_total(text, prefixes))
    return out


def is_code(lang: Column | str) -> Column:
    return _c(lang).isin(*R.CODE_LANGUAGES)


def _any_rlike(col: Column, patterns) -> Column:
    return col.rlike("|".join(f"(?:{p})" for p in patterns))


def file_kind(path: Column | str, lang: Column | str) -> Column:
    """First matching group wins."""
    p, lg = _c(path), _c(lang)
    lower = F.lower(p)
    return (
        F.when(_any_rlike(p, R.TEST_PATHS), "test")
        .when(_any_rlike(p, R.INFRA_PATHS), "infra")
        .when(F.lower(basename(p)).isin(*R.BUILD_FILES) | lower.endswith(".gradle") | lower.endswith(".cmake") | lower.endswith("makefile"), "build")
        .when(lg.isin(*R.DOC_LANGUAGES), "docs")
        .when(lg.isin(*R.CONFIG_LANGUAGES), "config")
        .when(is_code(lg) | lg.isin(*R.SCHEMA_LANGUAGES), "source")
        .when(lg.isin(*R.INFRA_LANGUAGES), "infra")
        .otherwise("data")
    )


def severity_rank(severity: Column | str) -> Column:
    out = F.lit(5)
    for i, name in enumerate(SEVERITIES):
        out = F.when(_c(severity) == name, i).otherwise(out)
    return out


def downgrade(severity: Column | str) -> Column:
    """One step milder; 'info' stays, unknown counts as medium."""
    steps = dict(zip(SEVERITIES, SEVERITIES[1:] + SEVERITIES[-1:]))
    return F.coalesce(F.try_element_at(_map(steps), _c(severity)), F.lit("low"))


def is_fixture(path: Column | str) -> Column:
    return _c(path).rlike(FIXTURE_PATH)


def env_kind(name: Column | str) -> Column:
    out = F.when(F.lit(False), F.lit(""))
    for needle, kind in ENV_KINDS:
        out = out.when(_c(name).contains(needle), kind)
    return out.otherwise("config")


def lane(path: Column | str, default: Column | str = "Application") -> Column:
    slashed = F.concat(F.lit("/"), F.lower(_c(path)))
    name = F.lower(basename(path))
    out = F.when(F.lit(False), F.lit(""))
    for pattern, label in LANE_DIRS:
        out = out.when(slashed.rlike(pattern), label)
    for pattern, label in LANE_FILES:
        out = out.when(name.rlike(pattern), label)
    return out.otherwise(F.lit(default) if isinstance(default, str) else default)


def image_system(image: Column | str) -> Column:
    """``struct<name, kind, technology>`` of the first matching image rule, else NULL."""
    out = F.when(F.lit(False), F.struct(*[F.lit("").alias(a) for a in ("name", "kind", "technology")]))
    for pattern, name, kind, tech in IMAGES:
        out = out.when(
            _c(image).rlike("(?i)" + pattern),
            F.struct(F.lit(name).alias("name"), F.lit(kind).alias("kind"), F.lit(tech).alias("technology")),
        )
    return out
