"""Findings in source text. All scans are narrow: one row in, its findings out, no shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from codecensus.functions import classify as C
from codecensus.functions import evidence as V
from codecensus.functions.matching import LONG_LINE, docstring_spans, hits_sql, in_spans, quoted, rule_table_sql, table_hits_sql, unmarked
from codecensus.functions.text import entropy, lines, slug, strip
from codecensus.operators.windows import first_wins
from codecensus.rules import secrets as K
from codecensus.rules import security as S

FINDING = [
    "id", "title", "severity", "category", "file", "line", "snippet", "cwe", "package", "version",
    "fixed_version", "identifier", "confidence", "remediation", "references",
]


HIT = "array<struct<i:int,line:int,col:int,text:string,hit:string>>"


def _scope_sql(rule: dict) -> str:
    tests = ["true"]
    if rule.get("languages"):
        tests.append("language IN (" + ", ".join(quoted(x) for x in rule["languages"]) + ")")
    if rule.get("files"):
        tests.append(f"path RLIKE {quoted('(?i)' + rule['files'])}")
    if rule.get("not_files"):
        tests.append(f"NOT path RLIKE {quoted('(?i)' + rule['not_files'])}")
    return " AND ".join(tests)


def _whole_sql(rule: dict, index: int) -> str:
    """The hit of a rule on the whole file, guarded by its scope."""
    hit = (
        "NOT text RLIKE '(?m)^\\\\s*USER\\\\s+\\\\w'" if rule["id"] == "docker-root"
        else "text RLIKE 'kind:\\\\s*(Deployment|StatefulSet|DaemonSet)' AND NOT contains(text, 'limits:')"
    )
    first = f"array(named_struct('i', {index}, 'line', 1, 'col', 0, 'text', btrim(substring_index(text, '\\n', 1), ' \\t\\r'), 'hit', ''))"
    return f"coalesce(CASE WHEN {_scope_sql(rule)} AND {hit} THEN {first} END, cast(array() as {HIT}))"


def _meta(rules: list[dict]) -> Column:
    """Rule facts as one constant array, looked up by position. A rule without a title is named by its id."""
    fields = ("id", "title", "severity", "cwe", "category", "confidence", "remediation")
    default = {"severity": "medium", "category": "code", "confidence": "medium"}
    value = lambda r, f: r.get(f, r["id"].replace("-", " ") if f == "title" else default.get(f, ""))
    rows = ", ".join("named_struct(" + ", ".join(f"'{f}', {quoted(value(r, f))}" for f in fields) + ")" for r in rules)
    return F.expr(f"array({rows})")


def _first_per_rule(hits: Column, limits: Column) -> Column:
    """Keep the first hits of every rule; rules without a limit have NULL. The array is ordered by rule, so a hit is
    over the limit n if the hit n places before it is of the same rule."""
    def keep(h: Column, k: Column) -> Column:
        n = F.element_at(limits, h["i"] + 1)
        return n.isNull() | (k < n) | (F.get(hits, k - n)["i"] != h["i"])

    return F.filter(hits, keep)


def scan_rules(files: DataFrame, keys: list[str], rules=S.RULES, max_per_rule: int | None = None, id_prefix: str = "CC-") -> DataFrame:
    """Findings of all rules over ``files(keys, path, language, text)``.

    Rules are entries of a constant table. Per file only those are looked for whose language and path fit and
    of which a guard occurs in the text. ``rules`` may be extended. Every hit
    is a finding, but for rules that report a file once; ``max_per_rule`` limits the others.
    """
    rules = list(rules)
    path = F.col("path")
    matched = rule_table_sql([{**r, "i": i} for i, r in enumerate(rules) if r["id"] not in S.WHOLE_FILE_RULES])
    parts = [table_hits_sql("text", "low", matched)] + [_whole_sql(r, i) for i, r in enumerate(rules) if r["id"] in S.WHOLE_FILE_RULES]
    raw = F.expr("concat(" + ", ".join(parts) + ")")
    scanned = (
        files.where(F.col("text") != "")
        .select(*keys, "path", "language", unmarked("text").alias("text"), F.lower("text").alias("low"))
        .select(*keys, "path", "language", raw.alias("raw"),
                F.when(path.rlike(r"\.pyi?$"), F.expr(docstring_spans("text"))).alias("docs"))
    )
    whole = [i for i, r in enumerate(rules) if r["id"] in S.WHOLE_FILE_RULES]
    uri = [i for i, r in enumerate(rules) if r["id"] in S.URI_RULES]
    digest = [i for i, r in enumerate(rules) if r["id"] in S.HASH_RULES]

    def keep(h):
        accepted = (
            ~V.is_language_comment(h["text"], "language") & ~V.is_pattern_definition(h["text"])
            & ~(h["i"].isin(uri) & V.is_xml_namespace(h["text"], h["hit"]))
            & ~(h["i"].isin(digest) & V.declares_no_security_use(h["text"]))
        )
        return h["i"].isin(whole) | accepted

    limits = F.array(*[F.lit(1 if r.get("once_per_file") else max_per_rule).cast("int") for r in rules])
    # ``docs`` is read twice on purpose: the optimizer then keeps it as a computed column
    # instead of moving the whole expression into the per-hit lambda.
    spoken = F.when(F.col("docs").isNull(), F.col("raw")).otherwise(
        F.filter("raw", lambda h: h["i"].isin(whole) | ~in_spans(F.col("docs"), h["line"], h["col"])))
    accepted = scanned.select(*keys, "path", F.filter(spoken, keep).alias("accepted"))
    kept = accepted.select(*keys, "path", F.explode_outer(_first_per_rule(F.col("accepted"), limits)).alias("h")).where("h IS NOT NULL")
    named = kept.select(*keys, "path", "h", F.element_at(_meta(rules), F.col("h.i") + 1).alias("m"))
    fixture = C.is_fixture(path)
    mild = F.col("m.category").isin("config", "secret") & fixture
    return named.select(
        *keys,
        slug(F.lit("rule"), F.col("m.id"), F.col("path"), F.col("h.line").cast("string")).alias("id"),
        F.col("m.title").alias("title"),
        F.when(mild, C.downgrade("m.severity")).otherwise(F.col("m.severity")).alias("severity"),
        F.col("m.category").alias("category"), F.col("path").alias("file"), F.col("h.line").alias("line"),
        F.col("h.text").alias("snippet"), F.col("m.cwe").alias("cwe"),
        F.lit("").alias("package"), F.lit("").alias("version"), F.lit("").alias("fixed_version"),
        F.concat(F.lit(id_prefix), F.upper("m.id")).alias("identifier"),
        F.when(fixture & (F.col("m.confidence") != "high"), "low").otherwise(F.col("m.confidence")).alias("confidence"),
        F.col("m.remediation").alias("remediation"), F.expr("cast(array() as array<string>)").alias("references"),
    )


def redact(value: Column) -> Column:
    """First four characters, then stars."""
    return F.concat(F.substring(value, 1, 4), F.lit("****"))


def _long_lines(text: str) -> Column:
    """``array<struct<line, text>>`` of the lines that a hit does not show whole; NULL without one."""
    numbered = F.transform(F.split(text, "\n"), lambda l, n: F.struct((n + 1).alias("line"), F.btrim(l, F.lit(" \t\r\f")).alias("text"), F.length(l).alias("n")))
    return F.when(F.length(text) > LONG_LINE, F.filter(numbered, lambda x: x["n"] > LONG_LINE))


def scan_secrets(files: DataFrame, keys: list[str], rules=K.SECRETS, min_entropy: float = K.MIN_ENTROPY, id_prefix: str = "CC-") -> DataFrame:
    """Redacted credential findings over ``files(keys, path, text)``. The snippet is the whole line, however long."""
    path = F.col("path")
    rules = list(rules)
    # The secret is group 1, so the mark goes around the whole match and the value is cut out later.
    raw = F.expr("concat(" + ", ".join(
        f"coalesce({hits_sql('text', r[2], i, 'low')}, cast(array() as {HIT}))" for i, r in enumerate(rules)) + ")")
    found = (
        files.where(F.col("text") != "").select(*keys, "path", unmarked("text").alias("text"), F.lower("text").alias("low"))
        .select(*keys, "path", raw.alias("raw"), _long_lines("text").alias("long"), F.when(path.rlike(r"\.pyi?$"), F.expr(docstring_spans("text"))).alias("docs"))
        .select(*keys, "path", "long", F.explode(F.when(F.col("docs").isNull(), F.col("raw")).otherwise(
            F.filter("raw", lambda h: ~in_spans(F.col("docs"), h["line"], h["col"])))).alias("h"))
        # A hit shows only a part of a long line; all hits of a file share its long lines.
        .withColumn("shown", F.coalesce(F.get(F.filter("long", lambda x: x["line"] == F.col("h.line")), F.lit(0))["text"], F.col("h.text"))).drop("long")
    )
    value, entropic = F.lit(None).cast("string"), [i for i, r in enumerate(rules) if r[0] in K.ENTROPY_RULES]
    for i, r in enumerate(rules):
        value = F.when(F.col("h.i") == i, F.regexp_extract("h.hit", r[2], 1)).otherwise(value)
    meta = F.expr("array(" + ", ".join(
        f"named_struct('id', {quoted(r[0])}, 'title', {quoted(r[1])}, 'severity', {quoted(r[3])})" for r in rules) + ")")
    real = (
        found.withColumn("value", value).withColumn("m", F.element_at(meta, F.col("h.i") + 1))
        .where((F.col("value") != "") & ~F.col("value").rlike(K.PLACEHOLDER) & ~F.col("value").rlike(K.PROSE))
        .where(~V.is_pattern_definition("shown"))
        .where(~F.col("h.i").isin(entropic) | (entropy("value") >= min_entropy))
    )
    mild = path.rlike(K.MILD_PATH)
    return real.select(
        *keys,
        slug(F.lit("secret"), F.col("m.id"), path, F.col("h.line").cast("string")).alias("id"),
        F.col("m.title").alias("title"),
        F.when(mild, C.downgrade("m.severity")).otherwise(F.col("m.severity")).alias("severity"),
        F.lit("secret").alias("category"), path.alias("file"), F.col("h.line").alias("line"),
        F.replace(F.col("shown"), F.col("value"), redact(F.col("value"))).alias("snippet"),
        F.lit(K.CWE).alias("cwe"), F.lit("").alias("package"), F.lit("").alias("version"), F.lit("").alias("fixed_version"),
        F.concat(F.lit(id_prefix + "SECRET-"), F.upper("m.id")).alias("identifier"),
        F.when(mild, "low").otherwise("high").alias("confidence"), F.lit(K.REMEDIATION).alias("remediation"),
        F.expr("cast(array() as array<string>)").alias("references"),
    )


def optional_imports(files: DataFrame, keys: list[str]) -> DataFrame:
    """Top-level modules imported inside ``try:`` that ends in ``except ImportError``.

    One in-row fold over the lines: the state is the open block's indent and the names seen
    in it, so a text of any length takes linear time.
    """
    txt = F.col("text")
    numbered = lines(txt)
    width = lambda s: F.length(s) - F.length(F.ltrim(s, F.lit(" \t\x0b\x0c")))
    empty = F.expr("cast(array() as array<string>)")
    init = F.struct(F.lit(-1).alias("indent"), empty.alias("open"), empty.alias("out"))

    def step(acc, line):
        is_try = line.rlike(S.TRY_LINE)
        blank = strip(line) == ""
        closes = (acc["indent"] >= 0) & ~blank & (width(line) <= acc["indent"])
        name = F.regexp_extract(line, S.IMPORT_LINE, 1)
        accepted = closes & line.rlike(S.EXCEPT_IMPORT)
        return F.when(closes | (acc["indent"] < 0), F.struct(
            F.when(is_try, width(line)).otherwise(F.lit(-1)).alias("indent"),
            empty.alias("open"),
            F.when(accepted, F.concat(acc["out"], acc["open"])).otherwise(acc["out"]).alias("out"),
        )).otherwise(F.struct(
            acc["indent"].alias("indent"),
            F.when(name != "", F.array_append(acc["open"], F.substring_index(name, ".", 1))).otherwise(acc["open"]).alias("open"),
            acc["out"].alias("out"),
        ))

    names = F.aggregate(numbered, init, step, lambda acc: acc["out"])
    likely = txt.contains("try") & txt.contains("Error")
    return files.where(likely).select(*keys, "path", F.explode(F.array_distinct(names)).alias("name"))


def dedupe_findings(findings: DataFrame, keys: list[str], order: list) -> DataFrame:
    """First finding per (file, line, identifier), or per id when there is no file."""
    has_file = F.col("file") != ""
    keyed = (
        findings.withColumn("__k1", F.when(has_file, F.col("file")).otherwise(""))
        .withColumn("__k2", F.when(has_file, F.col("line")).otherwise(0))
        .withColumn("__k3", F.when(has_file, F.col("identifier")).otherwise(F.col("id")))
    )
    return first_wins(keyed, [*keys, "__k1", "__k2", "__k3"], order).drop("__k1", "__k2", "__k3")


def finding_order() -> list[Column]:
    return [C.severity_rank("severity"), F.col("category"), F.col("file"), F.col("line")]
