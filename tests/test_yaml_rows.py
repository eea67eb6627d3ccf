"""Nested YAML as rows."""

import time

from pyspark.sql import functions as F

from codecensus.functions.yaml_rows import documents, list_at, under, value_at, values_at, yaml_rows

TEXT = '''# head
name: "a: b"   # why
on:
  push: {branches: [main, dev], tags: 'v*'}
  schedule:
  - cron: '0 5 * * *'
list: [a, "b, c",
  d]   # end
jobs:
    build:
        runs-on: &os ubuntu
        steps:
            - uses: x/y@v1
              with: {a: 1}
            -   run: |
                    make # no comment
                    key: no key

                    - no item
            - plain
            - - deep
              - er
    "quo ted":
        url: http://h:80/x#y
        folded: >-
          one
          two
after: long text
  that runs on
empty:
'''


def plain(rows):
    return [("/".join(r.path), r.value, r.line, r.text) for r in rows]


def test_rows(spark):
    got = plain(spark.createDataFrame([(TEXT,)], "text string").select(yaml_rows("text").alias("y")).first().y)
    assert got == [
        ("name", "a: b", 2, False), ("on", "", 3, False), ("on/push", "", 4, False), ("on/push/branches", "", 4, False), ("on/push/branches/0", "main", 4, False), ("on/push/branches/1", "dev", 4, False), ("on/push/tags", "v*", 4, False),
        ("on/schedule", "", 5, False), ("on/schedule/0/cron", "0 5 * * *", 6, False),
        ("list", "", 7, False), ("list/0", "a", 7, False), ("list/1", "b, c", 7, False), ("list/2", "d", 7, False),
        ("jobs", "", 9, False), ("jobs/build", "", 10, False), ("jobs/build/runs-on", "ubuntu", 11, False), ("jobs/build/steps", "", 12, False),
        ("jobs/build/steps/0/uses", "x/y@v1", 13, False), ("jobs/build/steps/0/with", "", 14, False), ("jobs/build/steps/0/with/a", "1", 14, False),
        ("jobs/build/steps/1/run", "", 15, False), ("jobs/build/steps/1/run", "make # no comment", 16, True), ("jobs/build/steps/1/run", "key: no key", 17, True),
        ("jobs/build/steps/1/run", "- no item", 19, True), ("jobs/build/steps/2", "plain", 20, False), ("jobs/build/steps/3/0", "deep", 21, False), ("jobs/build/steps/3/1", "er", 22, False),
        ("jobs/quo ted", "", 23, False), ("jobs/quo ted/url", "http://h:80/x#y", 24, False), ("jobs/quo ted/folded", "", 25, False),
        ("jobs/quo ted/folded", "one", 26, True), ("jobs/quo ted/folded", "two", 27, True), ("after", "long text", 28, False), ("after", "that runs on", 29, True), ("empty", "", 30, False)]


def test_lookups_and_documents(spark):
    df = spark.createDataFrame([("a: 1\n--- # next\nb: [x, y]\nc:\n  k: {u: 1}\n  l: 2\n",)], "text string").select(F.explode(documents(F.col("text"))).alias("d")).select("d.first", yaml_rows("d.text").alias("y"))
    y = F.col("y")
    got = df.select("first", value_at(y, "a").alias("a"), list_at(y, "b").alias("b"), list_at(y, "c").alias("c"), values_at(y, "**", "u").alias("u"), F.transform(under(y, "c"), lambda r: F.array_join(r["path"], "/")).alias("p")).collect()
    assert [tuple(r) for r in got] == [(0, "1", [], [], [], []), (1, "", ["x", "y"], ["k", "l"], ["1"], ["k", "k/u", "l"])]
    odd = spark.createDataFrame([(None,), ("",), ("\n\n",), ("- a\n- b: 1\n  c: 2\n-\n  d: 3\n",), ("{a: 1, b: two}\n",), ("\ta: x\r\nb: y\r\n",)], "text string")
    assert [plain(r.y) for r in odd.select(yaml_rows("text").alias("y")).collect()] == [
        [], [], [], [("0", "a", 1, False), ("1/b", "1", 2, False), ("1/c", "2", 3, False), ("2/d", "3", 5, False)],
        [("", "", 1, False), ("a", "1", 1, False), ("b", "two", 1, False)], [("a", "x", 1, False), ("b", "y", 2, False)]]


def test_long_texts_take_linear_time(spark):
    text = "items:\n" + "".join(f"  - name: n{k}\n    ports: [1, {k}]\n" for k in range(20000))
    text += "flow: [" + ", ".join(f"'a {k}', {{b: [{k}]}}" for k in range(10000)) + "]\nwords: " + "w 'q' " * 20000 + " # end\n"
    at = time.time()
    n = spark.createDataFrame([(text,)], "text string").select(F.size(yaml_rows("text"))).first()[0]
    assert n == 1 + 20000 * 4 + 1 + 10000 * 4 + 1 and time.time() - at < 60
