"""Where does a pattern occur? Narrow, shuffle-free match finding inside a row.

``regexp_replace`` walks a text once, left to right, over non-overlapping matches.
Letting it put a mark in front of every match and splitting the result by line gives
the line of every match, also of patterns that span lines, without a Python worker
and without exploding the text into one row per line.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from codecensus.functions.guards import guard_sql, literal_guards
from codecensus.functions.text import strip

OPEN, CLOSE = "\x01", "\x02"
DOC_OPEN, DOC_CLOSE = "\x03", "\x04"

_TRIPLE = r"(?s)\"\"\".*?\"\"\"|'''.*?'''"


def _c(col: Column | str) -> Column:
    return F.col(col) if isinstance(col, str) else col


def _unmark(col: Column) -> Column:
    return F.translate(col, OPEN + CLOSE + DOC_OPEN + DOC_CLOSE, "")


def bound(value: Column, use) -> Column:
    """``use(value)``, in which the value is a variable: it is worked out once, wherever ``use`` reads it."""
    return F.transform(F.array(value), use)[0]


def quoted(value: str) -> str:
    """A Python string as a SQL string literal."""
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'").replace("\n", "\\n") + "'"


#: A line of at most so many characters is shown whole; of a longer one its start and what stands around the hit.
LONG_LINE, HEAD, AROUND = 2000, 24, 400
#: Marks are counted in blocks of so many, so that many hits in one line take little more than linear time.
MARK_BLOCK = 256


def _marked_lines(text: str, pattern: str, replacement: str, mark: str, rest: str, fields: str, index: int) -> str:
    """SQL that gives one struct for each mark ``OPEN`` that the replacement puts into the text.

    ``p`` are the pieces of a marked line, cut once at the marks, and ``p[k]`` is the piece that begins with hit k;
    ``rest`` turns a piece ``q`` into what it holds of the line itself. The column of a hit is the length of all pieces
    before it: whole blocks come from a table of sums, the rest of the last block is added up. Nothing is done for each
    hit that reads the whole line, unless the line is short.
    """
    lengths = f"transform(p.p, q -> length({rest}))"
    sums = (
        f"aggregate(sequence(0, (size(p.n) - 1) div {MARK_BLOCK}), named_struct('s', 0, 'o', cast(array() as array<int>)), "
        f"(a, b) -> named_struct('s', a.s + aggregate(slice(p.n, b * {MARK_BLOCK} + 1, {MARK_BLOCK}), 0, (u, v) -> u + v), 'o', array_append(a.o, a.s)), a -> a.o)"
    )
    column = f"p.b[k div {MARK_BLOCK}] + aggregate(slice(p.n, k div {MARK_BLOCK} * {MARK_BLOCK} + 1, k % {MARK_BLOCK}), 0, (u, v) -> u + v)"
    near = (
        f"concat(left(p.c[0], {HEAD}), CASE WHEN k > 1 OR length(p.c[0]) > {HEAD} THEN right(concat(substring(p.c[0], {HEAD + 1}), array_join(slice(p.c, greatest(2, k - 3), greatest(0, least(4, k - 1))), '')), {AROUND}) ELSE '' END, "
        f"left(array_join(slice(p.c, k + 1, 5), ''), {AROUND}))"
    )
    shown = f"btrim(CASE WHEN p.w IS NULL THEN {near} ELSE p.w END, ' \\t\\r\\f')"
    hit = f"named_struct('i', {index}, 'line', p.line, 'col', {column}, {fields.replace('{text}', shown)})"
    return (
        f"flatten(transform(filter(transform(split(regexp_replace({text}, {pattern}, '{replacement}'), '\\n'), (l, n) -> named_struct('line', n + 1, 'p', split(l, '{mark}'))), x -> size(x.p) > 1), x -> "
        f"transform(transform(transform(array(x), p -> named_struct('line', p.line, 'p', p.p, 'n', {lengths}, 'c', transform(p.p, q -> {rest}))), "
        f"p -> named_struct('line', p.line, 'p', p.p, 'n', p.n, 'c', p.c, 'b', {sums}, 'w', CASE WHEN aggregate(p.n, 0, (u, v) -> u + v) <= {LONG_LINE} THEN array_join(p.c, '') END)), "
        f"p -> transform(sequence(1, size(p.p) - 1), k -> {hit}))[0]))"
    )


def hits_sql(text: str, pattern: str, index: int, low: str | None = None) -> str:
    """SQL for ``array<struct<i:int, line:int, col:int, text:string, hit:string>>`` of one rule.

    Every match is marked; only marked lines are looked at further. A text without the
    pattern pays for one search, or, when ``low`` names the lower-cased text, mostly for a
    few substring tests. Built as SQL text because rule tables yield hundreds of these.
    """
    p = quoted("(?m)" + pattern)
    guard = guard_sql(pattern, low) if low else "true"
    found = _marked_lines(text, p, f"{OPEN}$0{CLOSE}", OPEN, f"translate(q, '{CLOSE}', '')", f"'text', {{text}}, 'hit', substring_index(p.p[k], '{CLOSE}', 1)", index)
    return f"CASE WHEN {guard} AND {text} RLIKE {p} THEN {found} END"


def rule_table_sql(rules: list[dict]) -> str:
    """SQL for a constant array with one entry per rule: number ``i``, ``pattern``, ``guards`` and scope. The keys
    ``languages``, ``files`` and ``not_files`` of a rule may be missing; a missing one is NULL in the table."""
    def texts(values) -> str:
        return "array(" + ", ".join(map(quoted, values)) + ")" if values else "cast(NULL AS array<string>)"

    def path(value) -> str:
        return quoted("(?i)" + value) if value else "cast(NULL AS string)"

    return "array(" + ", ".join(
        f"named_struct('i', {r['i']}, 'pattern', {quoted('(?m)' + r['pattern'])}, 'guards', {texts(literal_guards(r['pattern']))}, "
        f"'languages', {texts(r.get('languages'))}, 'files', {path(r.get('files'))}, 'not_files', {path(r.get('not_files'))})" for r in rules) + ")"


def table_hits_sql(text: str, low: str, table: str) -> str:
    """The hits of all rules of a table, in its order, as in ``hits_sql``.

    The rules are data: the table says which of them are in scope of the row (columns ``language`` and ``path``) and which
    have a guard that occurs in the lower-cased text, and only for these one shared expression looks for matches. With a
    copy of that expression for each rule, planning took longer than scanning.
    """
    met = (
        "(r.languages IS NULL OR array_contains(r.languages, language)) "
        f"AND (r.guards IS NULL OR exists(r.guards, g -> contains({low}, g))) "
        "AND (r.files IS NULL OR path RLIKE r.files) AND (r.not_files IS NULL OR NOT path RLIKE r.not_files)"
    )
    found = _marked_lines(text, "r.pattern", f"{OPEN}$0{CLOSE}", OPEN, f"translate(q, '{CLOSE}', '')", f"'text', {{text}}, 'hit', substring_index(p.p[k], '{CLOSE}', 1)", "r.i")
    return f"flatten(transform(filter(filter({table}, r -> {met}), r -> {text} RLIKE r.pattern), r -> {found}))"


def groups_sql(text: str, pattern: str, groups: int, index: int) -> str:
    """SQL for ``array<struct<i:int, line:int, col:int, g:array<string>, text:string>>`` of one rule.

    The groups are copied in front of each match, between marks, so they may not hold line
    breaks. With a negative number the first group only leads up to the match.
    """
    p = quoted("(?m)" + pattern)
    lead = groups < 0
    caught = DOC_OPEN.join(f"${k}" for k in range(2 if lead else 1, abs(groups) + 1))
    replacement = f"$1{OPEN}{caught}{CLOSE}" if lead else f"{OPEN}{caught}{CLOSE}$0"
    rest = f"CASE WHEN contains(q, '{CLOSE}') THEN substring(q, instr(q, '{CLOSE}') + 1) ELSE q END"
    found = _marked_lines(text, p, replacement, OPEN, rest, f"'g', split(substring_index(p.p[k], '{CLOSE}', 1), '{DOC_OPEN}'), 'text', {{text}}", index)
    return f"CASE WHEN {text} RLIKE {p} THEN {found} END"


def docstring_spans(text: str) -> str:
    """SQL for the (line, col) spans of triple-quoted strings, start inclusive, end exclusive."""
    pieces = f"split(regexp_replace({text}, {quoted(_TRIPLE)}, '{DOC_OPEN}$0{DOC_OPEN}'), '{DOC_OPEN}')"
    return (
        f"CASE WHEN {text} RLIKE {quoted(_TRIPLE)} THEN aggregate({pieces}, "
        "named_struct('doc', false, 'line', 1, 'col', 0, 'out', cast(array() as array<struct<l0:int,c0:int,l1:int,c1:int>>)), "
        "(a, p) -> named_struct('doc', not a.doc, "
        "'line', a.line + length(p) - length(replace(p, '\\n', '')), "
        "'col', CASE WHEN contains(p, '\\n') THEN length(substring_index(p, '\\n', -1)) ELSE a.col + length(p) END, "
        "'out', CASE WHEN a.doc THEN array_append(a.out, named_struct('l0', a.line, 'c0', a.col, "
        "'l1', a.line + length(p) - length(replace(p, '\\n', '')), "
        "'c1', CASE WHEN contains(p, '\\n') THEN length(substring_index(p, '\\n', -1)) ELSE a.col + length(p) END)) ELSE a.out END), "
        "a -> a.out) END"
    )


def in_spans(spans: Column, line: Column, col: Column) -> Column:
    at = F.struct(line.cast("int").alias("l"), col.cast("int").alias("c"))
    return F.coalesce(F.exists(spans, lambda s: (
        F.struct(s["l0"].alias("l"), s["c0"].alias("c")) <= at) & (at < F.struct(s["l1"].alias("l"), s["c1"].alias("c")))), F.lit(False))


def unmarked(text: Column | str) -> Column:
    return F.translate(_c(text), OPEN + CLOSE + DOC_OPEN + DOC_CLOSE, "")


def find_lines(text: Column | str, pattern: str) -> Column:
    """``array<struct<line:int, text:string, hits:array<string>>>`` for lines where matches start."""
    t = unmarked(text)
    marked = F.regexp_replace(t, f"(?m){pattern}", f"{OPEN}$0{CLOSE}")
    numbered = F.transform(
        F.split(marked, "\n"),
        lambda line, i: F.struct((i + 1).cast("int").alias("line"), line.alias("text")),
    )
    found = F.transform(
        F.filter(numbered, lambda x: x["text"].contains(OPEN)),
        lambda x: F.struct(
            x["line"].alias("line"),
            strip(_unmark(x["text"])).alias("text"),
            F.regexp_extract_all(x["text"], F.lit(f"{OPEN}([^{CLOSE}]*)"), F.lit(1)).alias("hits"),
        ),
    )
    return F.when(_c(text).rlike(f"(?m){pattern}"), found)


def first_hit(text: Column | str, pattern: str) -> Column:
    """``struct<line, text, hit>`` of the first match, NULL without one."""
    t = _c(text)
    at = F.regexp_instr(t, F.lit(pattern))
    before = F.left(t, at - 1)
    head = F.substring_index(before, "\n", -1)
    tail = F.substring_index(F.substr(t, at), "\n", 1)
    return F.when(
        at > 0,
        F.struct(
            (F.length(before) - F.length(F.replace(before, F.lit("\n"), F.lit(""))) + 1).cast("int").alias("line"),
            strip(F.concat(head, tail)).alias("text"),
            F.regexp_extract(t, pattern, 0).alias("hit"),
        ),
    )


def blocks(text: Column | str, header: str) -> Column:
    """Split a text in front of every line that matches ``header``."""
    return F.split(_c(text), f"(?m)(?={header})")


def block_comments_removed(text: Column | str) -> Column:
    t = _c(text)
    return F.when(t.contains("/*"), F.regexp_replace(t, r"(?s)/\*.*?\*/", "")).otherwise(t)
