"""Imports, symbols, endpoints, frameworks and entry flags of source files.

All narrow: a file row goes in, fact rows come out. Rules are literal patterns behind a
language test; callers may pass longer rule lists to teach the scan another language.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from codecensus.functions.matching import block_comments_removed, bound, docstring_spans, groups_sql, in_spans, quoted, unmarked
from codecensus.functions.text import route, strip
from codecensus.rules import languages as L
from codecensus.session import once

Keys = list[str]
MATCH = "array<struct<i:int,line:int,col:int,g:array<string>,text:string>>"


def _in(languages: Sequence[str]) -> str:
    return "language IN (" + ", ".join(quoted(x) for x in languages) + ")"


def _matches(rules) -> str:
    """SQL: all matches of all rules that apply to the row's language."""
    per_rule = [
        f"coalesce(CASE WHEN {_in(r[0])} THEN {groups_sql('body', r[1], r[2], i)} END, cast(array() as {MATCH}))"
        for i, r in enumerate(rules)
    ]
    return "concat(" + ", ".join(per_rule) + ")"


def _pick(rules, at: int) -> Column:
    """The rule's SQL for one output column, chosen by the rule that matched."""
    arms = " ".join(f"WHEN {i} THEN {r[at]}" for i, r in enumerate(rules))
    return F.expr(f"CASE i {arms} END")


def bodies(files: DataFrame, keys: Keys) -> DataFrame:
    """Text to match on: block comments gone where the language has them."""
    text = unmarked("text")
    body = F.when(F.col("language").isin(*L.BLOCK_COMMENTS), block_comments_removed(text)).otherwise(text)
    return files.where(F.col("text") != "").select(*keys, "path", "language", once(body, "body"))


def _spread(df: DataFrame, keys: Keys, rules, extra: Sequence[str] = ()) -> DataFrame:
    return df.select(*keys, "path", "language", *extra, F.explode_outer(F.expr(_matches(rules))).alias("x")).where("x IS NOT NULL").select(
        *keys, "path", "language", *extra, F.col("x.i").alias("i"), F.col("x.line").alias("line"),
        F.col("x.col").alias("col"), F.col("x.g").alias("g"), F.col("x.text").alias("m"))


def imports(files: DataFrame, keys: Keys, rules=L.IMPORTS) -> DataFrame:
    """``(keys, file, language, module, line, raw, relative)``, one row per imported module."""
    rules = list(rules)
    src = bodies(files, keys).withColumn(
        "docs", F.when(F.col("language") == "Python", F.expr(docstring_spans("body"))))
    found = _spread(src, keys, rules, extra=["docs"]).where(
        F.col("docs").isNull() | ~in_spans(F.col("docs"), F.col("line"), F.col("col")))
    named = found.select(
        *keys, F.col("path").alias("file"), "language", "line", F.substring("m", 1, 120).alias("raw"),
        _pick(rules, 4).alias("relative"), _pick(rules, 3).alias("module"))
    # "import a as x, b" names two modules.
    several = F.when(
        (F.col("language") == "Python") & F.col("module").rlike(r"[, ]"),
        F.transform(F.split("module", ","), lambda p: F.regexp_replace(F.btrim(p), r"\s+as\s+\w+$", "")),
    ).otherwise(F.array("module"))
    out = named.select(*keys, "file", "language", F.explode(several).alias("module"), "line", "raw", "relative")
    js = F.col("language").isin(*L.JS)
    # The import and re-export forms of JavaScript overlap: one row per module and line.
    return out.where(F.col("module") != "").where(~js).unionByName(
        _once_per_line(out.where(js & (F.col("module") != "")), keys))


def _once_per_line(rows: DataFrame, keys: Keys) -> DataFrame:
    by = [*keys, "file", "module", "line"]
    return rows.groupBy(*by, "language", "relative").agg(F.min("raw").alias("raw")).select(*rows.columns)


# Fixed value: what opens a decorator, function or class.
_HEAD = r"^[ \t]*(?:@[\w.]+|(?:async[ \t]+)?def[ \t]|class[ \t])"


def heads_joined(text: Column) -> Column:
    """Python text in which decorators and heads of functions and classes that run over several lines stand on their first
    line, without comments; empty lines take the place of the others, so that no line gets another number.

    One fold over the lines, in chunks. A head whose brackets never close ends at the next head or at the end.
    """
    strings = "array<string>"
    none = F.expr(f"cast(array() as {strings})")
    quoted_or_comment = r"""\"(?:[^"\\]|\\.)*+"|'(?:[^'\\]|\\.)*+'|#.*+$"""
    no_comment = r"""^((?:[^"'#]++|"(?:[^"\\]|\\.)*+"|'(?:[^'\\]|\\.)*+'|["'])*+)#.*$"""

    def state(opened, head, held, out) -> Column:
        return F.struct(opened.cast("int").alias("open"), head.alias("head"), held.cast("int").alias("held"), out.alias("out"))

    def flushed(a: Column) -> Column:
        """What is held, with an empty line for each line it took in."""
        return F.when(a["open"] > 0, F.concat(a["out"], F.array(a["head"]), F.array_repeat(F.lit(""), a["held"]))).otherwise(a["out"])

    def step(a: Column, line: Column) -> Column:
        left_out = lambda plain, marks: F.length(F.translate(plain, marks, ""))
        grown = bound(F.regexp_replace(line, quoted_or_comment, ""), lambda plain: left_out(plain, ")]}") - left_out(plain, "([{"))
        clean = F.when(line.contains("#"), F.regexp_replace(line, no_comment, "$1")).otherwise(line)
        as_is = state(F.lit(0), F.lit(""), F.lit(0), F.array_append(flushed(a), line))

        def run_on(b: Column) -> Column:
            joined = F.concat(a["head"], F.lit(" "), strip(clean))
            more = F.when(a["open"] + b["grown"] > 0, state(a["open"] + b["grown"], joined, a["held"] + 1, a["out"])).otherwise(
                state(F.lit(0), F.lit(""), F.lit(0), F.concat(a["out"], F.array(joined), F.array_repeat(F.lit(""), a["held"] + 1))))
            return F.when((a["open"] > 0) & ~b["is_head"], more).when(b["is_head"] & (b["grown"] > 0), state(b["grown"], F.rtrim(clean), F.lit(0), flushed(a))).otherwise(as_is)

        # Most lines are no heads and stand in none: their brackets are not counted.
        return bound(line.rlike(_HEAD), lambda is_head: F.when((a["open"] == 0) & ~is_head, as_is).otherwise(
            bound(F.struct(is_head.alias("is_head"), grown.alias("grown")), run_on)))

    def fold(every: Column) -> Column:
        start = F.struct(F.lit(0).alias("open"), F.lit("").alias("head"), F.lit(0).alias("held"), F.expr(f"cast(array() as array<{strings}>)").alias("done"))

        def chunk(s: Column, k: Column) -> Column:
            return F.aggregate(F.slice(every, k * 256 + 1, F.lit(256)), state(s["open"], s["head"], s["held"], none), step, lambda e: F.struct(
                e["open"].alias("open"), e["head"].alias("head"), e["held"].alias("held"), F.array_append(s["done"], e["out"]).alias("done")))

        rest = lambda s: flushed(F.struct(s["open"].alias("open"), s["head"].alias("head"), s["held"].alias("held"), F.flatten(s["done"]).alias("out")))
        return F.aggregate(F.sequence(F.lit(0), F.floor((F.size(every) - 1) / 256).cast("int")), start, chunk, rest)

    runs_on = text.rlike("(?m)" + _HEAD + r"[^\n]*[(,\[{][ \t]*(?:#[^\n]*)?\r?$")
    return F.when(runs_on, F.array_join(F.transform(F.array(F.split(text, "\n")), fold)[0], "\n")).otherwise(text)


def python_outline(files: DataFrame, keys: Keys, marked: bool = False) -> DataFrame:
    """Classes and functions of Python files with qualified names and their decorators; if ``marked``, with the frameworks of the file.

    One linear fold per file over the matched lines only; the state is the stack of open
    classes (by indent) and the decorators waiting for their definition.
    """
    pattern = (
        r"""^([ \t]*)(?:@([\w.]+)(?:\((?:\s*[rf]?["']([^"'\n]*)["'])?([^\n]*))?|((?:async[ \t]+)?def|class)[ \t]+(\w+)([^\n]*))"""
    )
    src = bodies(files.where(F.col("language") == "Python"), keys)
    kept = [*keys, "path"]
    if marked:
        src, kept = src.select("*", once(F.expr(_framework_sql()), "frameworks")), [*kept, "frameworks"]
    heads = src.select(*kept, F.expr(docstring_spans("body")).alias("docs"), once(heads_joined(F.col("body")), "body"))
    found = heads.select(*kept, "docs", once(F.expr(groups_sql("body", pattern, 7, 0)), "raw"))
    items = F.when(F.col("docs").isNull(), F.col("raw")).otherwise(
        F.filter("raw", lambda x: ~in_spans(F.col("docs"), x["line"], x["col"])))
    deco = "struct<chain:string,path:string,rest:string>"
    item = f"struct<what:string,name:string,qual:string,line:int,rest:string,deco:array<{deco}>>"
    empty_stack = F.expr("cast(array() as array<struct<indent:int,name:string>>)")
    empty_deco = F.expr(f"cast(array() as array<{deco}>)")

    def step(a: Column, x: Column) -> Column:
        g = x["g"]
        indent = F.length(F.regexp_replace(g[0], "\t", "    "))
        stack = F.filter(a["stack"], lambda s: s["indent"] < indent)
        is_deco = g[1] != ""
        is_class = g[4] == "class"
        qual = F.concat_ws(".", F.transform(stack, lambda s: s["name"]), g[5])
        made = F.struct(
            F.when(is_class, "class").when(F.size(stack) > 0, "method").otherwise("function").alias("what"),
            g[5].alias("name"), F.when(is_class, g[5]).otherwise(qual).alias("qual"), x["line"].alias("line"),
            g[6].alias("rest"), a["wait"].alias("deco"))
        return F.struct(
            F.when(is_class, F.array_append(stack, F.struct(indent.alias("indent"), g[5].alias("name")))).otherwise(
                F.when(is_deco, a["stack"]).otherwise(stack)).alias("stack"),
            F.when(is_deco, F.array_append(a["wait"], F.struct(g[1].alias("chain"), g[2].alias("path"), g[3].alias("rest"))))
            .otherwise(empty_deco).alias("wait"),
            F.when(is_deco, a["out"]).otherwise(F.array_append(a["out"], made)).alias("out"))

    folded = F.aggregate(
        items, F.struct(empty_stack.alias("stack"), empty_deco.alias("wait"), F.expr(f"cast(array() as array<{item}>)").alias("out")),
        step, lambda a: a["out"])
    return found.select(*kept, F.explode_outer(folded).alias("o")).where("o IS NOT NULL").select(*keys, F.col("path").alias("file"), *kept[len(keys) + 1:], "o.*")


def symbols(files: DataFrame, keys: Keys, rules=L.SYMBOLS) -> DataFrame:
    """``(keys, name, kind, file, line, signature, exported)``."""
    rules = list(rules)
    src = bodies(files.where(F.col("language") != "Python"), keys).withColumn(
        "package", F.when(F.col("language").isin(*L.JVM), F.regexp_extract("body", r"(?m)^\s*package\s+([\w.]+)", 1)).otherwise(""))
    found = _spread(src, keys, rules, extra=["package"]).select(
        *keys, "path", "language", "line", _pick(rules, 3).alias("name"), _pick(rules, 4).alias("kind"),
        _pick(rules, 5).alias("exported"))
    # A JavaScript name that is exported is not listed again as a local one.
    js_out = found.where(F.col("language").isin(*L.JS) & F.col("exported")).select(*keys, "path", "name").distinct()
    local = found.where(F.col("language").isin(*L.JS) & ~F.col("exported")).join(js_out, [*keys, "path", "name"], "left_anti")
    rest = found.where(~F.col("language").isin(*L.JS) | F.col("exported"))
    other = rest.unionByName(local.select(*rest.columns)).select(
        *keys, "name", "kind", F.col("path").alias("file"), "line", F.lit("").alias("signature"), "exported")
    o = python_outline(files, keys)
    args = F.regexp_extract("rest", r"^\s*\(([^)]*)\)?", 1)
    arg_names = F.array_join(F.filter(F.transform(F.split(args, ","), lambda a: F.regexp_replace(F.btrim(a), r"^\*+|\s*[:=].*$", "")), lambda a: a != ""), ", ")
    py = o.select(
        *keys, F.col("qual").alias("name"), F.col("what").alias("kind"), "file", "line",
        F.when(F.col("what") == "class", F.concat(F.lit("class "), "name", F.lit("("), args, F.lit(")")))
        .otherwise(F.concat(F.lit("def "), "name", F.lit("("), arg_names, F.lit(")"))).alias("signature"),
        (~F.col("name").startswith("_")).alias("exported"))
    return other.unionByName(py)


def frameworks(files: DataFrame, keys: Keys, rules=L.FRAMEWORKS) -> DataFrame:
    """``(keys, path, frameworks)``; files without any marker are left out."""
    marks = _framework_sql(rules)
    src = bodies(files, keys)
    return src.select(*keys, "path", once(F.expr(marks), "frameworks")).where(F.size("frameworks") > 0)


def _framework_sql(rules=L.FRAMEWORKS) -> str:
    by_lang: dict[tuple, list] = {}
    for langs, name, pattern in rules:
        by_lang.setdefault(langs, []).append((name, pattern))
    arms = " ".join(
        f"WHEN {_in(langs)} THEN array_compact(array(" + ", ".join(
            f"CASE WHEN body RLIKE {quoted(p)} THEN {quoted(n)} END" for n, p in pairs) + "))"
        for langs, pairs in by_lang.items())
    return f"CASE {arms} ELSE cast(array() as array<string>) END"


def entry_files(files: DataFrame, keys: Keys, rules=L.ENTRYPOINTS) -> DataFrame:
    """Files that start a program."""
    test = " OR ".join(f"({_in(langs)} AND body RLIKE {quoted(p)})" for langs, p in rules)
    return bodies(files, keys).where(F.expr(test)).select(*keys, "path")


def endpoints(files: DataFrame, keys: Keys, rules=L.ENDPOINTS) -> DataFrame:
    """``(keys, kind, method, path, handler, file, line, framework, description)``."""
    rules = list(rules)
    lang = F.col("language")
    src = bodies(files, keys).select("*", once(F.expr(_framework_sql()), "frameworks"))
    spring = r"""@RequestMapping\s*\(\s*(?:value\s*=\s*)?["']([^"']+)["']"""
    nest = r"""@Controller\(\s*[`'"]?([^`'")]*)[`'"]?\s*\)"""
    body = F.col("body")
    stem = F.regexp_extract("path", r"([^/]*?)(?:Controller)?(?:\.[^./]*)?$", 1)
    last_service = F.try_element_at(F.regexp_extract_all(body, F.lit(r"(?m)^\s*service\s+(\w+)"), F.lit(1)), F.lit(-1))
    class_at = F.regexp_instr(body, F.lit(spring))
    context = src.select(
        *keys, "path", "language", "body", "frameworks",
        F.when(lang.isin(*L.JS), F.regexp_extract(body, nest, 1))
        .when(lang.isin(*L.JVM) & body.rlike("@RestController|@Controller"), F.regexp_extract(body, spring, 1))
        .when(lang == "C#", F.replace(F.regexp_extract(body, r"""\[Route\(\s*["']([^"']+)["']""", 1), F.lit("[controller]"), stem))
        .when((lang == "Protobuf") & body.contains("service"), F.coalesce(F.when(body.rlike(r"(?m)^\s*service\s+\w+"), last_service), F.lit("")))
        .otherwise("").alias("base"),
        (body.rlike(nest) | body.contains("@nestjs/")).alias("nest"),
        (lang.isin("Ruby") & body.contains("sinatra")).alias("sinatra"),
        F.when(lang.isin(*L.JVM), F.regexp_extract(body, r"""@Path\s*\(\s*["']([^"']+)["']\s*\)""", 1)).otherwise("").alias("jax_root"),
        F.when(lang.isin(*L.JVM) & (class_at > 0),
               F.length(F.left(body, class_at)) - F.length(F.replace(F.left(body, class_at), F.lit("\n"), F.lit(""))) + 1
               ).otherwise(0).alias("class_line"),
    )
    extra = ["frameworks", "base", "nest", "sinatra", "jax_root", "class_line"]
    found = _spread(context, keys, rules, extra=extra).where(_pick(rules, 3))
    kinds = F.expr("CASE i " + " ".join(f"WHEN {i} THEN {quoted(r[4])}" for i, r in enumerate(rules)) + " END")
    named = found.select(
        *keys, kinds.alias("kind"), _pick(rules, 5).alias("method"), _pick(rules, 6).alias("p"), _pick(rules, 7).alias("handler"),
        F.col("path").alias("file"), "line", _pick(rules, 8).alias("framework"),
        F.when(lang == "Protobuf", F.concat(F.btrim(F.col("g")[1]), F.lit(" -> "), F.btrim(F.col("g")[2]))).otherwise("").alias("description"))
    based = F.col("p").contains("|")
    raw = F.col("kind").isin(*L.RAW_PATHS) | F.col("framework").isin(*L.RAW_FRAMEWORKS) | (F.col("framework") == "tRPC")
    by_rule = named.select(
        *keys, "kind", "method",
        F.when(based & ~raw, route(F.substring_index("p", "|", 1), F.substring_index("p", "|", -1)))
        .when(raw, F.col("p")).otherwise(route(F.lit(""), F.col("p"))).alias("path"),
        "handler", "file", "line", "framework", "description")
    return by_rule.unionByName(python_endpoints(files, keys)).unionByName(file_routes(files, keys)).unionByName(graphql_fields(files, keys))


def python_endpoints(files: DataFrame, keys: Keys) -> DataFrame:
    """Routes, tasks and commands declared by decorators."""
    d = python_outline(files, keys, marked=True).select(*keys, "file", "frameworks", "qual", "line", F.explode_outer("deco").alias("d")).where("d IS NOT NULL")
    d = d.withColumn("last", F.substring_index("d.chain", ".", -1))
    chain, last = F.col("d.chain"), F.col("last")
    listed = F.filter(
        F.regexp_extract_all(F.regexp_extract("d.rest", r"methods\s*=\s*[\[(]([^\])]*)", 1), F.lit(r"[\"']([^\"']+)[\"']"), F.lit(1)),
        lambda m: m != "")
    is_route = last.isin(*L.ROUTE_DECORATORS) & (F.col("d.path") != "")
    is_cli = (last.isin("command", "group") & chain.contains("click")) | chain.contains("typer")
    methods = (
        F.when(is_route & (last == "websocket"), F.array(F.lit("WS")))
        .when(is_route & (F.size(listed) > 0), F.transform(listed, lambda m: F.upper(m)))
        .when(is_route, F.array(F.when(last == "route", "GET").otherwise(F.upper(last))))
        .when(last.isin(*L.TASK_DECORATORS), F.array(F.lit("TASK")))
        .when(is_cli & ~last.isin(*L.ROUTE_DECORATORS), F.array(F.lit("CMD")))
    )
    rows = d.select(*keys, "file", "frameworks", "qual", "line", chain.alias("chain"), F.col("d.path").alias("p"), F.explode_outer(methods).alias("method")).where("method IS NOT NULL")
    fw = F.array_intersect(F.array(*[F.lit(x) for x in L.PYTHON_WEB]), "frameworks")
    web = F.coalesce(F.try_element_at(fw, F.lit(1)), F.substring_index("chain", ".", 1))
    other = F.col("method").isin("TASK", "CMD")
    return rows.select(
        *keys,
        F.when(F.col("method") == "WS", "websocket").when(F.col("method") == "TASK", "event").when(F.col("method") == "CMD", "cli").otherwise("http").alias("kind"),
        "method", F.when(other, F.col("qual")).otherwise(route(F.lit(""), F.col("p"))).alias("path"),
        F.col("qual").alias("handler"), "file", "line",
        F.when(F.col("method") == "TASK", "Celery").when(F.col("method") == "CMD", "Click/Typer").otherwise(web).alias("framework"),
        F.lit("").alias("description"))


def file_routes(files: DataFrame, keys: Keys) -> DataFrame:
    """Routes that a file's own path declares (pages/api, app/**/route, +server)."""
    p, low = F.col("path"), F.lower("path")
    pages = low.contains("/pages/api/") | low.startswith("pages/api/")
    app = p.rlike(r"(^|/)app/.*/route\.[jt]sx?$")
    server = p.rlike(r"\+server\.[jt]s$")
    pages_route = F.regexp_replace(F.regexp_replace(F.regexp_replace(low, r"^.*?pages/api", "/api"), r"\.(js|ts|jsx|tsx)$", ""), r"/index$", "")
    app_route = F.regexp_replace(F.regexp_replace(F.regexp_replace(p, r"^.*?(^|/)app", ""), r"/route\.[jt]sx?$", ""), r"/\((\w+)\)", "")
    server_route = F.regexp_replace(F.regexp_replace(p, r"^.*?routes", ""), r"/\+server\.[jt]s$", "")
    verbs = F.regexp_extract_all(
        "text", F.lit(r"(?m)^\s*export\s+(?:async\s+)?function\s+(GET|POST|PUT|PATCH|DELETE|HEAD|OPTIONS)\b"), F.lit(1))
    path = F.when(pages, pages_route).when(app, app_route).otherwise(server_route)
    return (
        files.where(F.col("language").isin(*L.JS) & (pages | app | server))
        .select(
            *keys, F.lit("http").alias("kind"),
            F.explode(F.when(pages | (F.size(verbs) == 0), F.array(F.lit("ANY"))).otherwise(verbs)).alias("method"),
            F.when(path == "", F.when(pages, "/api").otherwise("/")).otherwise(path).alias("path"), F.lit("").alias("handler"),
            p.alias("file"), F.lit(1).alias("line"),
            F.when(pages | app, "Next.js").otherwise("SvelteKit").alias("framework"), F.lit("").alias("description"))
    )


def graphql_fields(files: DataFrame, keys: Keys) -> DataFrame:
    """Fields of the operation types; a field belongs to the type opened last before it."""
    blocks = F.split(F.col("body"), r"(?m)(?=^[^\S\n]*(?:type|input|enum|interface|union)\s+\w+)")
    src = bodies(files.where(F.col("language") == "GraphQL"), keys)
    # One fold carries the line number along; earlier blocks are not read again.
    breaks = lambda b: F.length(b) - F.length(F.replace(b, F.lit("\n"), F.lit("")))
    offsets = F.aggregate("blocks", F.struct(F.lit(0).alias("n"), F.expr("cast(array() as array<int>)").alias("out")), lambda a, b: F.struct(
        (a["n"] + breaks(b)).alias("n"), F.array_append(a["out"], a["n"]).alias("out")), lambda a: a["out"])
    per_block = src.select(*keys, "path", blocks.alias("blocks")).select(*keys, "path", F.explode(F.arrays_zip(F.col("blocks").alias("body"), offsets.alias("offset"))).alias("b"))
    typed = per_block.select(
        *keys, "path", F.regexp_extract("b.body", r"^\s*type\s+(\w+)", 1).alias("owner"), F.col("b.body").alias("body"), F.col("b.offset").alias("offset"),
        F.lit("GraphQL").alias("language")).where(F.col("owner").isin("Query", "Mutation", "Subscription"))
    rows = typed.select(*keys, "path", "owner", "offset", F.explode(F.expr(groups_sql("body", r"^[^\S\n]{2,}(\w+)[^\S\n]*(\([^)\n]*\))?[^\S\n]*:", 2, 0))).alias("x"))
    return rows.select(
        *keys, F.lit("graphql").alias("kind"), F.upper("owner").alias("method"), F.col("x.g")[0].alias("path"), F.col("x.g")[0].alias("handler"),
        F.col("path").alias("file"), (F.col("x.line") + F.col("offset")).cast("int").alias("line"), F.lit("GraphQL").alias("framework"), F.lit("").alias("description"))
