import random
import re

from pyspark.sql import functions as F

from codecensus.llm.common import components
from codecensus.llm.line_dedup import dedup_lines
from codecensus.llm.minhash_dedup import near_duplicates
from codecensus.session import cut

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, source string, lang string"


def lower(text):
    return re.sub("[A-Z]+", lambda m: m[0].lower(), text)


def shingles(text):
    words = WORD.findall(lower(text or ""))
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def brute_classes(texts):
    sets = {i: shingles(t) for i, t in texts.items()}
    parent = {i: i for i in texts}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    ids = sorted(texts)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            x, y = sets[a], sets[b]
            if x and y and 100 * len(x & y) >= 85 * len(x | y):
                low, high = sorted((root(a), root(b)))
                parent[high] = low
    return {i: (len(sets[i]), root(i)) for i in ids}


def corpus():
    rng = random.Random(3)
    vocabulary = [f"w{k}" for k in range(400)]
    base = [rng.choice(vocabulary) for _ in range(150)]
    texts = {}
    for k in range(70):  # one dense group: edits at random places, some copies below the threshold, all sharing lists
        words = list(base)
        for _ in range(rng.choice([0, 1, 1, 2, 2, 3, 4])):
            words[rng.randrange(len(words))] = rng.choice(vocabulary)
        texts[1000 - k] = " ".join(words[: len(words) - rng.choice([0, 0, 0, 5, 20])])
    for k in range(40):
        texts[k] = " ".join(rng.choice(vocabulary) for _ in range(rng.choice([1, 3, 4, 5, 6, 30, 90])))
    texts[41], texts[42], texts[43] = texts[5].upper(), texts[5].replace(" ", "\t\n"), "  "
    texts[44], texts[45] = None, ""
    texts[46] = texts[47] = "only three words"
    texts[48] = "Only three words"  # a no-break space is no gap
    texts[49] = "x y " * 30000
    return texts


def test_near_duplicates_equal_brute_force(spark):
    texts = corpus()
    rows = [(i, t, "s", "en") for i, t in texts.items()]
    docs = spark.createDataFrame(rows + rows[:5], SCHEMA).withColumnsRenamed({"source": "n_shingles", "lang": "component_id"})
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in near_duplicates(docs).collect()}
    assert got == {i: (n, c, c == i) for i, (n, c) in brute_classes(texts).items()}
    assert max(sum(c == k for _, c, _ in got.values()) for k in got) > 20


def test_near_duplicates_of_nothing(spark):
    assert near_duplicates(spark.createDataFrame([], SCHEMA)).collect() == []


def test_line_dedup_equals_brute_force(spark):
    rng = random.Random(4)
    lines = ["menu", "  menu ", "imprint", "a", "b", "c", "", "unique {k}", "menu\t"]
    rows = [(k % 70, "\n".join(rng.choice(lines).format(k=k) for _ in range(rng.randrange(5))), f"h{k % 3}", "en") for k in range(80)]
    rows += [(100 + k, "copied\ncopied too", "h9", "en") for k in range(9)] + [(200, None, None, None), (None, "menu", None, None)]
    pages = {}
    for _, _, host, _ in rows:
        pages[host] = pages.get(host, 0) + 1
    held = {}
    bare = lambda x: x.strip(" \t\n\v\f\r")
    for _, text, host, _ in rows:
        for x in {bare(x) for x in (text or "").split("\n")} - {""}:
            held[host, x] = held.get((host, x), 0) + 1
    want = []
    for i, text, host, lang in rows:
        all_lines = (text or "").split("\n")
        kept = [x for x in all_lines if not bare(x) or held[host, bare(x)] < 5 or held[host, bare(x)] <= 0.05 * pages[host]]
        n = sum(bool(bare(x)) for x in all_lines)
        dropped = len(all_lines) - len(kept)
        want.append((i, "\n".join(kept) if dropped else text, host, lang, n, dropped))
    got = [tuple(r) for r in dedup_lines(spark.createDataFrame(rows, SCHEMA)).collect()]
    key = lambda r: tuple(str(x) for x in r)
    assert sorted(got, key=key) == sorted(want, key=key)
    assert any(r[5] for r in want)


def test_near_duplicates_of_any_ids(spark):
    text = "one two three four five six seven eight nine ten"
    rows = [("b", text), ("a", text), ("a", text), ("a", "other words that are like nothing else here"), (None, text.upper()), (None, "alone and without any id at all"), (None, None), ("c", ""), (None, "alone and without any id at all")]
    got = sorted((str(r.doc_id), r.n_shingles, str(r.component_id), r.kept) for r in near_duplicates(spark.createDataFrame(rows, "doc_id string, text string")).collect())
    assert got == sorted([("b", 6, "a", False), ("a", 6, "a", True), ("a", 6, "a", True), ("a", 4, "a", True), ("None", 6, "a", False), ("None", 3, "None", True), ("None", 3, "None", True),
                          ("None", 0, "None", True), ("c", 0, "c", True)])


def test_copies_do_not_make_boilerplate(spark):
    rng = random.Random(8)
    article = [" ".join(rng.choices("abcdefghij", k=12)) for _ in range(30)]
    docs = [(k, "\n".join(article)) for k in range(9)] + [(9, "\n".join([*article[:-1], "edited"]))]
    docs += [(k, "menu\n" + " ".join(rng.choices("klmnopqr", k=30))) for k in range(10, 30)] + [(40, "menu")]
    frame = spark.createDataFrame(docs, "doc_id long, text string").withColumns({"source": F.lit("h"), "_n_lines": F.lit("x"), "host": F.lit(1), "bad": F.lit(2), "d": F.lit(3)})
    copies = near_duplicates(frame).where("not kept").select("doc_id", "text_key")
    got = {r.doc_id: (r.text, r._n_dropped) for r in dedup_lines(frame, uncounted=copies).collect()}
    for i, text in docs:
        assert got[i] == ((text, 0) if i < 10 else (text.replace("menu", "", 1).lstrip("\n"), 1))


def test_line_dedup_of_nothing(spark):
    assert dedup_lines(spark.createDataFrame([], SCHEMA).withColumn("_text2", F.lit(1))).columns == ["doc_id", "text", "source", "lang", "_text2", "_n_lines", "_n_dropped"]


def test_small_tables_take_few_partitions(spark):
    docs = spark.createDataFrame([(i, " ".join(f"w{i // 3 * 50 + k}" for k in range(40))) for i in range(60)], "doc_id long, text string")
    names = {"spark.sql.shuffle.partitions": "64", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in names}
    try:
        for k, v in names.items():
            spark.conf.set(k, v)
        found = near_duplicates(docs)
        classes = components(spark.createDataFrame([(i, i - 1) for i in range(1, 40) if i % 10], "a long, b long"), "a", "b")
        # 64 partitions were written in every round, whatever the rows; only the table of smallest nodes may still have them.
        assert found.rdd.getNumPartitions() <= spark.sparkContext.defaultParallelism
        assert classes.rdd.getNumPartitions() <= 64 + spark.sparkContext.defaultParallelism
        assert {(r.doc_id, r.component_id) for r in found.collect()} == {(i, i // 3 * 3) for i in range(60)}
        assert {(r.node, r.component) for r in classes.collect()} == {(i, i // 10 * 10) for i in range(40)}
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_stars_take_no_round(spark, monkeypatch):
    tables = []
    monkeypatch.setattr("codecensus.llm.common.cut", lambda df, real=cut: tables.append(1) or real(df))
    rows = [(10 * (i // 10), i) for i in range(1, 60)] + [(7, 7)]
    found = components(spark.createDataFrame(rows, "a long, b long"), "a", "b")
    assert len(tables) == 1 and {(r.node, r.component) for r in found.collect()} == {(i, 10 * (i // 10)) for i in range(60)}
