import json

from codecensus.operators import report as RP
from codecensus.operators import review as RV
from codecensus.sources import tables as T

ANSWERS = {
    "schema": "x/1", "generated_by": {"tool": "hand"},
    "applications": [{"id": "app-a", "summary": " Takes  orders. ", "responsibilities": ["a"]}, {"id": "app-zz", "summary": "x"}, {"id": "app-b", "summary": " "}],
    "findings": [{"id": "f1", "assessment": "TRUE_POSITIVE", "reasoning": "seen"}, {"id": "f2", "assessment": "meh", "reasoning": "x"}, {"id": "f3", "assessment": "false_positive", "reasoning": ""}, {"id": "nope", "assessment": "false_positive", "reasoning": "x"}],
    "insights": [
        {"kind": "risk", "title": "No proof", "evidence": ["just words here"]}, {"kind": "risk", "title": "Proof", "severity": "loud", "targets": ["app-a", "ghost"], "evidence": ["a.py:3-9", "b.py:1,4", "a.py:3-9"]},
        {"kind": "odd", "title": "Note", "confidence": "sure"}, {"kind": "answer", "title": ""}],
    "unanswered": ["q1"],
}


def test_answers_are_checked(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps(ANSWERS))
    a = T.read_answers(spark, str(tmp_path / "a.json"))
    k = ["repo"]
    apps = spark.createDataFrame([("r", "app-a"), ("r", "app-b")], "repo string, id string")
    finds = spark.createDataFrame([("r", f"f{i}") for i in (1, 2, 3)], "repo string, id string")
    ok, bad = RV.judge_texts(T.answer_rows(a, "applications", "r"), apps, k, "application", "summary")
    assert [(r.id, r.summary) for r in ok.collect()] == [("app-a", "Takes orders.")]
    assert {r.id for r in bad.collect()} == {"app-zz", "app-b"}
    ok, bad = RV.judge_findings(T.answer_rows(a, "findings", "r"), finds, k)
    assert [(r.id, r.assessment) for r in ok.collect()] == [("f1", "true_positive")]
    reasons = {r.id: r.reason for r in bad.collect()}
    assert set(reasons) == {"f2", "f3", "nope"} and "does not exist" in reasons["nope"]
    merged = {r.id: r.ai_assessment for r in RV.merge_assessments(finds, ok, k).collect()}
    assert merged == {"f1": "true_positive", "f2": "", "f3": ""}
    ok, bad = RV.judge_insights(T.answer_rows(a, "insights", "r"), apps, k)
    got = {r.title: r for r in ok.collect()}
    assert set(got) == {"Proof", "Note"}
    assert (got["Proof"].targets, got["Proof"].severity, got["Proof"].evidence) == (["app-a"], "info", ["a.py:3-9", "b.py:1,4"])
    assert (got["Note"].kind, got["Note"].confidence, got["Note"].id) == ("observation", "medium", "ai-3")
    why = [r.reason for r in bad.collect()]
    assert len(why) == 3 and any("ghost" in w for w in why) and any("no path:line evidence" in w for w in why)


def test_damaged_answers_fail_no_job(spark, tmp_path):
    (tmp_path / "b.json").write_text('{"applications": [')
    assert T.read_answers(spark, str(tmp_path / "b.json")).first()._corrupt_record is not None


def test_advisory_documents(spark, tmp_path):
    doc = {"id": "GHSA-x", "aliases": ["CVE-1"], "summary": "bad", "severity": [{"type": "CVSS_V3", "score": "CVSS:3.1/AV:N"}],
           "affected": [{"package": {"name": "lodash", "ecosystem": "npm"}, "versions": ["1"], "ranges": [{"type": "SEMVER", "events": [{"introduced": "0"}, {"fixed": "2.0"}, {"introduced": "3.0"}]}]}],
           "references": [{"type": "WEB", "url": "u"}], "database_specific": {"severity": "HIGH", "cwe_ids": ["CWE-1"]}}
    (tmp_path / "x.json").write_text(json.dumps(doc))
    r = T.read_advisories(spark, str(tmp_path)).first()
    assert (r.id, r.ecosystem, r.package, r.label, r.refs) == ("GHSA-x", "npm", "lodash", "HIGH", ["u"])
    assert [(e.introduced, e.fixed) for e in r.events] == [("0", "2.0"), ("3.0", None)]


def test_saved_model_defaults(spark, tmp_path):
    (tmp_path / "m.json").write_text(json.dumps({"schema_version": "1.0", "endpoints": [{"kind": "http", "path": "/x", "unknown": 1}]}))
    r = T.read_model(spark, str(tmp_path / "m.json"), "endpoints", "r").first()
    assert (r.repo, r.kind, r.path, r.handler, r.line) == ("r", "http", "/x", "", 0)


def test_commit_log(spark, tmp_path):
    (tmp_path / "log.tsv").write_text("r\t0\tAda\t2024-03-02T10:00:00Z\nr\t1\tBob\t2024-02-01T10:00:00Z\nr\t2\tAda\t2024-01-01T10:00:00Z\n")
    (tmp_path / "files.tsv").write_text("r\t0\tsrc/a.py\nr\t1\tsrc/a.py\nr\t1\tBinary x\nr\t2\tsrc/in/b.py\n")
    c = T.read_commits(spark, str(tmp_path / "log.tsv"))
    s = RP.commit_span(c, ["repo"]).first()
    assert (s.commits, s.contributors, s.first_commit, s.last_commit) == (3, 2, "2024-01-01", "2024-03-02")
    assert [(r.author, r.commits) for r in RP.authors(c, ["repo"]).orderBy("rank").collect()] == [("Ada", 2), ("Bob", 1)]
    h = RP.hotspots(T.read_commit_files(spark, str(tmp_path / "files.tsv")), ["repo"])
    assert [(r.path, r.changes) for r in h.orderBy("rank").collect()] == [("src/a.py", 2), ("src/in/b.py", 1)]
    assert {(r.dir, r.changes) for r in RP.churn_by_dir(h, ["repo"]).collect()} == {("src", 2), ("src/in", 1)}


def test_text_helpers(spark):
    from codecensus.functions import text as X

    df = spark.createDataFrame([("Crème Brûlée_x",), ("",), ("fooBarBaz-qux",)], "s string")
    assert [r[0] for r in df.select(X.slug("s")).collect()] == ["creme-brulee-x", "n", "foobarbaz-qux"]
    assert [r[0] for r in df.select(X.title_case("s")).collect()] == ["Crème Brûlée X", "", "Foo Bar Baz Qux"]
    nums = spark.createDataFrame([(512.0,), (1280.0,), (1150.0,), (5_000_000.0,)], "v double")
    assert [r[0] for r in nums.select(X.human_bytes("v")).collect()] == ["512B", "1.2KB", "1.1KB", "4.8MB"]
    assert [r[0] for r in nums.select(X.human_number("v")).collect()] == ["512", "1.3k", "1.1k", "5.0M"]
    paths = spark.createDataFrame([("a/./b/../c",), ("../x",), ("a/b",), ("./q",)], "p string")
    assert [r[0] for r in paths.select(X.normal_path("p")).collect()] == ["a/c", "../x", "a/b", "q"]
    t = spark.createDataFrame([("a\r\nb\x0cc\n",), ("",), ("x",)], "t string")
    assert [(r[0], r[1]) for r in t.select(X.line_total("t"), X.lines("t")).collect()] == [(3, ["a", "b", "c"]), (0, []), (1, ["x"])]


def test_models_of_many_repositories_in_one_pass(spark, tmp_path):
    import json

    one = {"notes": [{"id": "n1", "size": 3, "tags": ["a", "b"], "extra": {"k": 1.5}}, {"id": "n2", "size": None, "tags": []}], "version": 7, "empty": []}
    two = {"notes": [{"id": "n3", "size": 4_000_000_000, "tags": ["c"], "more": True}], "version": 8}
    for name, doc in (("one", one), ("two", two)):
        (tmp_path / f"{name}.json").write_text(json.dumps(doc))
    items = T.read_models(spark, str(tmp_path)).persist()
    got = {(r.repo, r.section, r.ord) for r in items.where("item IS NOT NULL").collect()}
    assert got == {("one", "notes", 0), ("one", "notes", 1), ("two", "notes", 0), ("one", "version", 0), ("two", "version", 0)}
    rows = T.section_rows(items, "notes", "id string, size bigint, tags array<string>", aside="saved").selectExpr("repo", "id", "size", "tags", "to_json(saved) AS saved").collect()
    assert {(r.repo, r.id, r.size, tuple(r.tags)) for r in rows} == {("one", "n1", 3, ("a", "b")), ("one", "n2", None, ()), ("two", "n3", 4_000_000_000, ("c",))}
    assert {json.loads(r.saved).get("more") for r in rows} == {None, True} and any(json.loads(r.saved).get("extra") == {"k": 1.5} for r in rows)
    # Without a schema the columns are those found, of all repositories together.
    found = T.section_rows(items, "notes")
    assert set(found.columns) == {"repo", "id", "size", "tags", "extra", "more"} and found.count() == 3
    items.unpersist()


def test_model_lines_come_back_as_the_same_tables(spark):
    from codecensus.sinks.exports import model_lines

    tables = {
        "files": spark.createDataFrame([("r", "a.py", 10, True, 0.5), ("s", "b\"\n.py", None, False, None)], "repo string, path string, loc bigint, test boolean, share double"),
        "apps": spark.createDataFrame([("r", "x", ["p", "q"], [(1, "t")], {"k": "v"}), ("s", None, [], [], None)], "repo string, name string, roots array<string>, parts array<struct<n:int,l:string>>, env map<string,string>"),
        "nothing": spark.createDataFrame([], "repo string, id string"),
    }
    items = T.model_items(model_lines(tables, ["repo"]))
    for name, table in tables.items():
        fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in table.schema.fields if f.name != "repo").replace("` ", "`:")
        back = T.section_rows(items, name, fields)
        assert back.columns == table.columns and sorted(map(str, back.collect())) == sorted(map(str, table.collect()))
