import importlib.util
import os
import random
import re

from pyspark.sql import functions as F

import corpus_pipeline as P
from codecensus.llm.queries import ORACLES, QUERIES



def _beside(name):
    spec = importlib.util.spec_from_file_location(f"llm_{name}", os.path.join(os.path.dirname(__file__), f"{name}.py"))
    module = importlib.util.module_from_spec(spec)
    spec.loader.exec_module(module)
    return module


brute_classes = _beside("test_dedup").brute_classes
brute = _beside("test_scans").brute


def brute_leaks(docs, items):
    return brute(docs, items, lambda t: re.findall(r"[^\x20\x09-\x0D]+", t), whole=True)


COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def test_every_operator_has_one_query():
    names = [q for q in QUERIES if q.startswith("op")]
    assert sorted(int(n[2:].split("_")[0]) for n in names) == list(range(1, 14))
    assert set(ORACLES) <= set(QUERIES)


def test_stages_on_their_own_input(spark):
    d = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{d}/documents.parquet")
    items = {r.item_id: r.text for r in spark.read.parquet(f"{d}/benchmark.parquet").collect()}
    before = {r.doc_id: r for r in docs.collect()}
    for name, stage in P.STAGES[:-1]:
        docs = P.stored(stage(spark, docs, d))
        assert docs.columns == COLUMNS
        after = {r.doc_id: r for r in docs.collect()}
        if name == "language_id":
            assert set(after) == {i for i, r in before.items() if any(c.isalpha() for c in r.text)}
        elif name == "line_dedup":
            assert set(after) == set(before) and all(after[i].n_chars == len(after[i].text) for i in after if after[i].text != before[i].text)
        elif name == "minhash_near_dedup":
            assert set(after) == {i for i, (_, c) in brute_classes({i: r.text for i, r in before.items()}).items() if c == i}
        else:
            assert set(after) == set(before) - {i for i, *_ in brute_leaks([(i, r.text) for i, r in before.items()], items)}
        before = after
    mixed = P.mix_sources(spark, docs, d).collect()
    assert {r.doc_id for r in mixed} == set(before) and sum(r.taken for r in mixed) > 0


def test_stages_on_no_documents(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    for _, stage in P.STAGES:
        docs = stage(spark, docs, "/root/testdata/sf0.001")
        assert docs.collect() == []
        docs = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")


CLASHING = ("_id", "_language", "_host", "_keys", "_bad", "_kept", "_row", "id", "i", "k", "d", "key", "host", "whole", "found", "of", "least", "bad", "set_key", "lines")


def odd_documents(spark):
    text = "the rain in spain stays mainly in the plain and so it goes on for quite a while with words"
    rows = [(1, text, "en", "a"), (2, text, "en", "a"), (2, text, "en", "a"), (2, "an other text under the same number, of which nothing else is like it", "en", "b"), (3, None, None, None), (4, "", "en", "a"),
            (None, text, None, "b"), (None, "words without any number that stand alone in this whole table", "en", None), (5, "long words " * 20_000, "en", "a"), (6, "123 456", "de", "a")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").withColumn("n_chars", F.length("text").cast("long"))
    return docs.withColumns({c: F.lit(f"own {c}") for c in CLASHING}).withColumn("a map", F.create_map(F.lit(1), F.lit(2)))


def test_stages_on_odd_rows_and_clashing_names(spark):
    docs = odd_documents(spark)
    ids = {}
    for name, stage in P.STAGES:
        out = stage(spark, docs, "/root/testdata/sf0.001")
        rows = out.collect()
        ids[name] = sorted((r.doc_id for r in rows), key=str)
        if name != "mixing":
            assert out.columns == docs.columns and all(r[c] == f"own {c}" for r in rows for c in CLASHING) and all(r["a map"] == {1: 2} for r in rows)
    assert ids == {"language_id": [1, 2, 2, 2, 5, None, None], "line_dedup": [1, 2, 2, 2, 3, 4, 5, 6, None, None], "minhash_near_dedup": [1, 2, 3, 4, 5, 6, None],
                   "benchmark_decontamination": [1, 2, 2, 2, 3, 4, 5, 6, None, None], "mixing": [1, 2, 2, 2, 3, 4, 5, 6, None, None]}


def test_languages_not_learned_go(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", "lang", "source", "n_chars")
    rng = random.Random(2)
    strange = [(-1, "".join(rng.choice("abcdefghijklmnopqrstuvwxyz ") for _ in range(2000))), (-2, "Nel mezzo del cammin di nostra vita mi ritrovai per una selva oscura che la diritta via era smarrita. " * 3)]
    more = spark.createDataFrame([(i, t, None, "x", len(t)) for i, t in strange], docs.schema)
    got = {r.doc_id for r in P.identify_language(spark, docs.union(more), "").select("doc_id").collect()}
    letters = {r.doc_id for r in docs.collect() if any(c.isalpha() for c in r.text or "")}
    assert got == letters
