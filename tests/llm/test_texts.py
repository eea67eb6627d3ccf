import random
import re
import tracemalloc
from html.parser import HTMLParser

import pandas as pd
import pytest

from codecensus.llm import language_id as L
from codecensus.llm.html_text import extract_pages, main_text
from codecensus.llm.mixing import apportion, mix
from codecensus.llm.quality_rules import quality_rules

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, source string, lang string"


def page(body, head="<title>T</title><style>p{}</style><script>var x='</p>';</script>"):
    return f"<!DOCTYPE html><html><head>{head}</head><body>{body}</body></html>"


FURNITURE = ('<nav><ul><li><a href="/a">A</a></li><li><a href="/b">B</a></li></ul></nav><header class="site">Name</header><div class="cookie-notice">We use cookies.</div>'
             '<aside><p>See also</p></aside><form><label>Search</label><input></form><div id="comments"><p>First! A very long reader comment about nothing at all.</p></div><footer>&copy; us</footer>')


@pytest.mark.parametrize(("source", "want"), [
    (page(FURNITURE + "<article><h1>Title &amp; more</h1><p>One  two\n three.<p><b>Four<br>five</b></article>"), "Title & more\nOne two three.\nFour five"),
    (page(FURNITURE + '<div class="content"><h2>Head</h2><p>Some longer text of the article.</p><ul><li>x<li>y</ul><p>More of it.</p></div>'), "Head\nSome longer text of the article.\nx\ny\nMore of it."),
    (page('<div class="wrap has-sidebar"><div id="post-12" class="entry"><div class="part"><p>A long first paragraph of the story, with many words.</p><p>And a second one of it.</p></div><div class="part"><p>Ok.</p></div></div>'
          '<div class="sidebar"><p>Elsewhere on this site there is much more to read about.</p></div></div>'), "A long first paragraph of the story, with many words.\nAnd a second one of it.\nOk."),
    (page('<article><div class="article-header"><h1>Head</h1></div><p>Text of it.</p><section class="comments"><p>Reader says</p></section><div class="share-buttons"><a href="x">Share</a></div></article>'), "Head\nText of it."),
    ("<div>Hello <b>wor</b>ld<br>x</div>", "Hello world x"), ("plain &lt;text", "plain <text"), ("", ""), (None, ""), ("<", "<"), ("<p>cut <a hre", "cut <a hre"), (page(""), ""), ("<script>x", ""),
    (page("<main><table><tr><td>a<td>b<tr><td>c</table></main>"), "a\nb\nc"), ("<!-- never closed <p>x</p>", ""),
])
def test_main_text(source, want):
    assert main_text(source) == want


STORY = "<h1>Head of it</h1><p>A long first paragraph of the story, with many words.</p><p>And a second one of it.</p>"
PLAIN = "Head of it\nA long first paragraph of the story, with many words.\nAnd a second one of it."


@pytest.mark.parametrize("around", ['<form id="aspnetForm">{}</form>', '<div class="share-price-story">{}</div>', '<div class="with-sidebar page-menu-open">{}</div>', '<header>{}</header>',
                                    '<div role="dialog">{}</div>', '<form><div class="social-wrap"><div id="newsletter-page">{}</div></div></form>', '<div class="ad" class="post">{}</div>'])
@pytest.mark.parametrize("story", [STORY, f"<article>{STORY}</article>", f'<div class="content">{STORY}</div>', f"<main><div>{STORY}</div></main>"])
def test_articles_in_doubtful_elements(around, story):
    assert main_text(page(around.format(story))) == PLAIN
    furniture = '<nav><a href="/">Home</a></nav><div class="ad">Buy this now.</div><footer>&copy; us</footer>'
    comments = '<div class="comments"><p>First!</p><p>I have a comment to make on it.</p></div>'
    assert main_text(page(furniture + around.format(story + comments) + '<form><label>Search</label></form>')) == PLAIN


@pytest.mark.parametrize("story", [f"<article>{STORY}</article>", f'<div class="content">{STORY}</div>'])
def test_long_comments_and_teasers_are_no_article(story):
    comments = '<div class="comments">' + "<p>A reader has very much to say on this matter, again and again and on.</p>" * 30 + "</div>"
    teasers = '<div class="related"><article><p>Short.</p></article></div>' if "<article>" in story else ""
    assert main_text(page(comments + story + teasers)) == PLAIN


def test_nesting_without_end():
    assert main_text("<div>" * 20_000 + "<p>Deep text of some words.</p>") == "Deep text of some words."


class Reference(HTMLParser):
    """Text in <article> by the standard library's parser; the pages' articles hold no furniture."""

    def __init__(self, source):
        super().__init__(convert_charrefs=True)
        self.depth, self.blocks, self.now = 0, [], []
        self.feed(source or "")
        self.close()

    def _end(self):
        text = " ".join("".join(self.now).split())
        self.blocks += [text] * bool(text)
        self.now = []

    def handle_starttag(self, tag, attrs):
        self.depth += tag == "article"
        if tag == "br":
            self.now.append(" ")
        elif tag not in ("b", "i", "a", "em", "strong", "span"):
            self._end()

    def handle_endtag(self, tag):
        if tag not in ("b", "i", "a", "em", "strong", "span", "br"):
            self._end()
        self.depth -= tag == "article"

    def handle_data(self, data):
        if self.depth:
            self.now.append(data)


def test_whole_table_equals_a_reference(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    want = {r.page_id: "\n".join(Reference(r.html).blocks) for r in pages.collect()}
    got = {r.page_id: (r.text, r.n_chars) for r in extract_pages(pages).collect()}
    assert got == {k: (t, len(t)) for k, t in want.items()} and all(want.values())


def test_pages_frame(spark):
    rows = [(1, "u", page("<article><p>x y</p></article>")), (1, "u", page("<article><p>x y</p></article>")), (2, None, None), (None, "v", "<p>" + "long " * 100_000)]
    got = sorted((tuple(r) for r in extract_pages(spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "1 AS text")).collect()), key=str)
    assert got == sorted([(1, "u", "x y", 3), (1, "u", "x y", 3), (2, None, "", 0), (None, "v", ("long " * 100_000).strip(), 499_999)], key=str)
    assert extract_pages(spark.createDataFrame([], "page_id long, url string, html string")).collect() == []


def naive_phrases(text, sample):
    count = at = 0
    while at < len(text):
        end = at + 1
        while end < len(text) and text[at : end + 1] in sample:
            end += 1
        count, at = count + 1, end
    return count


def test_parsing_equals_brute_force():
    rng = random.Random(1)
    samples = {k: ["".join(rng.choice(letters) for _ in range(400)) for _ in range(3)] for k, letters in {"x": "aab c", "y": "abbd ", "z": "éabc"}.items()}
    model = L.build(samples)
    texts = ["".join(rng.choice("abcdé zQ1") for _ in range(n)) for n in (0, 1, 5, 100, 511, 700)]
    got = model.phrases([model.symbols(t) for t in texts])
    for row, text in zip(got, texts, strict=True):
        folded = "".join(chr(c) if c else " " for c in L.codes(text))
        for value, lang in zip(row, model.languages, strict=True):
            parts = ["".join(chr(c) if c else " " for c in L.codes(t)) for t in samples[lang]]
            pieces = [folded[k : k + L.PIECE] for k in range(0, len(folded), L.PIECE)]
            assert value == sum(naive_phrases(p, "|".join(parts)) for p in pieces)


def test_language_frame(spark):
    rng = random.Random(2)
    make = {"aa": "bado keli ".split(), "bb": "xuri wopi ".split()}
    rows = [(k, " ".join(rng.choice(["ba", "do", "ke"] if lang == "aa" else ["xu", "ri", "wo"]) * rng.randrange(1, 3) for _ in range(30)), "s", lang) for k in range(80) for lang in [sorted(make)[k % 2]]]
    odd = [(200, None, None, None), (201, "123 !", "s", "aa"), (202, "", "s", "bb"), (203, "x" * 100_000, "s", None), (None, "badoke", None, "aa"), (5, rows[5][1], "s", rows[5][3])]
    got = L.identify(spark.createDataFrame(rows + odd, SCHEMA).withColumnRenamed("source", "score")).collect()
    assert len(got) == len(rows) + len(odd)
    lang = {r[0]: r[3] for r in rows}
    assert all(r.lang_pred == lang[r.doc_id] and 0 <= r.score <= 1 for r in got if r.doc_id in lang)
    assert {r.lang_pred for r in got if r.doc_id in (200, 201, 202)} == {"und"}
    from zlib import crc32
    assert all(r.held_out == (r.doc_id is not None and crc32(str(r.doc_id).encode()) % 4 == 2) for r in got)
    empty = spark.createDataFrame([], SCHEMA)
    assert L.identify(empty).collect() == []
    assert {r.lang_pred for r in L.identify(spark.createDataFrame([(1, "text", "s", None)], SCHEMA)).collect()} == {"und"}


def test_language_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    got = L.identify(docs).where("held_out").join(docs.select("doc_id", "lang"), "doc_id").collect()
    assert sum(r.lang == r.lang_pred for r in got) >= 0.95 * len(got) > 0


def brute_quality(text):
    words = WORD.findall(text or "")
    windows = {}
    for i in range(len(words) - 4):
        windows.setdefault(tuple(words[i : i + 5]), []).append(i)
    covered = {p + k for at in windows.values() if len(at) > 1 for p in at for k in range(5)}
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    return (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(covered), len(words) < 10 or 100 * len(covered) > 20 * len(words))


def test_quality_equals_brute_force(spark):
    rng = random.Random(9)
    texts = ["".join(rng.choice(["a ", "b ", "c\n", "é# ", "<d>\t", " ", "w7 ", "  \n"]) for _ in range(rng.choice([0, 3, 12, 60, 400]))) for _ in range(60)] + [None, "", "one two " * 20_000]
    rows = [(k, t, "s", "en") for k, t in enumerate(texts)]
    farm = [(1000 + k, f"Page {k} of the farm says nothing new at all\nunique {chr(97 + k % 26)}{k} here", "farm", "en") for k in range(40)]
    got = {r.doc_id: tuple(r)[1:] for r in quality_rules(spark.createDataFrame(rows + farm, SCHEMA).withColumnRenamed("lang", "kept")).collect()}
    for i, text, _, _ in rows + farm:
        assert got[i][:6] == brute_quality(text), i
    # Digits are folded, so the farm's first line is one line; the second keeps its letter.
    assert all(got[i][6] == 10 and not got[i][7] for i, *_ in farm)
    assert quality_rules(spark.createDataFrame([], SCHEMA)).collect() == []


def highest_quotients(votes, seats):
    quotients = sorted(((-v / (2 * k + 1), name) for name, v in votes.items() for k in range(seats)))[:seats]
    return {name: sum(n == name and q < 0 for q, n in quotients) for name in votes}


def test_apportionment_equals_highest_quotients(spark):
    rng = random.Random(8)
    parties = [(g, name, rng.choice([0, 1, 3, 10, 77, 500, 501]), seats) for g, seats in (("a", 40), ("b", 3), ("c", 0), ("d", 700)) for name in range(9)]
    got = {(r.g, r.name): r.quota for r in apportion(spark.createDataFrame(parties, "g string, name long, votes long, seats long"), ["g"], "name", "votes", "seats").collect()}
    for g, seats in (("a", 40), ("b", 3), ("c", 0), ("d", 700)):
        want = highest_quotients({n: v for h, n, v, _ in parties if h == g}, seats)
        assert {n: q for (h, n), q in got.items() if h == g} == want


def brute_targets(sizes):
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: k % 3 + 1 for k, s in enumerate(names)}
    total, full = sum(sizes.values()), {s for s in names if not sizes[s]}
    while True:
        rest = total - sum(3 * sizes[s] for s in full)
        level = rest / sum(weight[s] for s in names if s not in full) if len(full) < len(names) else 0
        over = {s for s in names if s not in full and weight[s] * level > 3 * sizes[s]}
        if not over:
            return {s: 3.0 * sizes[s] if s in full else weight[s] * level for s in names}
        full |= over


def test_mixing(spark):
    rng = random.Random(7)
    rows = [(k, "w " * rng.choice([0, 1, 7, 50, 90]), rng.choice(["a", "B", "é", None, "z", "z", "z", "z"]), "en") for k in range(300)]
    rows += [(500, None, "empty", None), (501, "", "empty", "en"), (7, rows[7][1], rows[7][2], "en"), (None, "x y", "tiny", None)]
    docs = spark.createDataFrame(rows, SCHEMA).withColumnRenamed("lang", "taken")
    got = mix(docs, block=2, shard_documents=40).collect()
    assert len(got) == len(rows)
    sizes, taken = {}, {}
    for r in got:
        sizes[r.source] = sizes.get(r.source, 0) + r.size
        taken[r.source] = taken.get(r.source, 0) + r.taken
        assert 0 <= r.taken <= 3 * r.size
    want = brute_targets(sizes)
    for r in got:
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(want[r.source])
    assert all(abs(taken[s] - want[s]) <= 0.02 * want[s] + 6 for s in sizes)
    assert sorted(map(str, got)) == sorted(map(str, mix(docs.repartition(5), block=2, shard_documents=40).collect()))
    assert mix(spark.createDataFrame([], SCHEMA)).collect() == []


def test_automata_are_placed_one_at_a_time():
    def peak(languages):
        rnd = random.Random(3)
        samples = {f"l{k}": ["".join(rnd.choices("abcdefgh ", k=4000))] for k in range(languages)}
        tracemalloc.start()
        model = L.build(samples)
        most = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert list(model.decide(pd.Series([s[0] for s in samples.values()])).lang_pred) == list(samples)
        return most

    assert peak(6) < 3 * peak(1)
