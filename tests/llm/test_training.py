import base64
import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from codecensus.llm import byte_bpe as B, fill_middle as M, resampling as R

ODD = ["", " ", "\n", "a", "é\n", "日本語", "😀😀\nx\n\n", "<P>", "a\r\n b\x0bc\x1c\x85d e", "x" * 300, "don't we'll I'M 12３½ ²", "࢏꟎z1\U0003d000 q", "\n\n  a   \n"]
RAW = B.vocabulary()
RANKS = B.read_ranks(RAW)
TIKTOKEN = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=RANKS, special_tokens={})
ENCODER = B.Encoder(RAW, B.split_pattern(), B.younger())
LETTERS = st.text(alphabet=st.one_of(st.sampled_from(list(" \n\t'aestnb01.-éßдя日́　\xa0😀࢏\U0003d000\x1c\x85")), st.characters(codec="utf-8")), max_size=60)


def ids_of(text):
    return np.frombuffer(ENCODER.packed([text])[0], "<u4").tolist()


# --- importance resampling


@given(st.lists(st.binary(max_size=40), max_size=30))
@settings(max_examples=60, deadline=None)
def test_checksums(items):
    items = items + [b"", b"x" * (R.LONG_FEATURE + 1), b"y" * R.LONG_FEATURE]
    assert R.crc32_all(items).tolist() == [zlib.crc32(i) for i in items]


def features(text, runs):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate({c: c + 32 for c in range(65, 91)}))
    return len(words), [" ".join(words[i : i + k]) for k in range(1, runs + 1) for i in range(len(words) - k + 1)]


@pytest.mark.parametrize("runs", [1, 2, 3, 4])
def test_features(runs):
    rng = random.Random(runs)
    texts = [None, *ODD, *[" ".join(rng.choice(["a", "B", "é", "x9", "-"]) for _ in range(n)) for n in (1, 2, 3, 4, 5, 200)], "IİK"]
    sizes, owner, bucket = R.feature_buckets(texts, runs, 997)
    for k, text in enumerate(texts):
        n, want = features(text, runs)
        assert sizes[k] == n
        assert Counter(bucket[owner == k].tolist()) == Counter(zlib.crc32(x.encode()) % 997 for x in want)
    assert all(len(x) == 0 for x in R.feature_buckets([], runs))


def brute_resample(docs, items, percent=25, least=20, buckets=10000):
    made = [(i, *features(t, 2)) for i, t in docs]
    held = [Counter(zlib.crc32(x.encode()) % buckets for xs in side for x in xs) for side in ([m[2] for m in made], [features(t, 2)[1] for t in items])]
    size, aim = (sum(h.values()) for h in held)
    gain = lambda b: math.floor(1000 * math.log((held[1][b] + 1) * (size + buckets) / ((held[0][b] + 1) * (aim + buckets))))
    rows = []
    for i, n, xs in made:
        weight = sum(gain(zlib.crc32(x.encode()) % buckets) for x in xs) // len(xs) if xs else 0
        h = int(hashlib.sha256(f"7:{'null' if i is None else i}".encode()).hexdigest()[:8], 16)
        rows.append((i, n, len(xs), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))))
    may = sorted((r for r in rows if r[1] >= least), key=lambda r: (-r[4], r[0] is None, r[0] or 0))
    rank = {id(r): k + 1 for k, r in enumerate(may[: percent * len(may) // 100])}
    return sorted(((*r, rank.get(id(r))) for r in rows), key=str)


def test_resample_equals_brute_force(spark):
    rng = random.Random(3)
    words = [f"w{k}" for k in range(60)] + ["é", "日本"]
    docs = [(i, " ".join(rng.choices(words, k=rng.choice([0, 3, 19, 20, 40, 90])))) for i in range(120)]
    docs += [(500, None), (501, ""), (None, " ".join(words)), (502, "long " * 30_000), (503, "z" * 20_000), (504, docs[3][1])]
    items = [" ".join(rng.choices(words[:10], k=15)) for _ in range(20)] + [None, ""]
    frame = spark.createDataFrame([(*d, "x", 1) for d in docs], "doc_id long, text string, bucket string, rank int").withColumn("n", F.lit(1))
    got = R.resample(frame, spark.createDataFrame([(t, 5) for t in items], "text string, n int"))
    assert got.columns == ["doc_id", "n_words", "n_features", "weight", "score", "rank"]
    assert sorted(map(tuple, got.collect()), key=str) == brute_resample(docs, items)


def test_resample_ties_and_empty_tables(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert R.resample(empty, empty).collect() == []
    same = spark.createDataFrame([(7, "a b " * 10)] * 9, "doc_id long, text string")
    rows = R.resample(same, empty).collect()
    assert sorted(r["rank"] or 0 for r in rows) == [0] * 7 + [1, 2] and len({r.score for r in rows}) == 1


# --- byte-level BPE


@given(LETTERS)
@settings(max_examples=400, deadline=None)
def test_ids_equal_the_library(text):
    assert ids_of(text) == TIKTOKEN.encode_ordinary(text)


def test_ids_of_odd_and_long_texts():
    rng = random.Random(5)
    long = ["a" * 20_000, " " * 5_000 + "x", "".join(rng.choices("abcdefgh", k=30_000)), "日" * 3_000, "é1 " * 2_000, "".join(map(chr, range(0x20, 0x3000)))]
    for text in ODD + long + ["<|endoftext|>"]:
        assert ids_of(text) == TIKTOKEN.encode_ordinary(text)
        assert b"".join(TIKTOKEN.decode_single_token_bytes(i) for i in ids_of(text)) == text.encode()


def test_pieces_of_every_character():
    # Each code point between a letter, a digit and a sign: the split alone decides the ids.
    for start in range(0, 0x110000, 0x8000):
        text = "".join(f"a{chr(c)}b{chr(c)}1{chr(c)}.{chr(c)} " for c in range(start, start + 0x8000, 7) if not 0xD800 <= c < 0xE000)
        assert ids_of(text) == TIKTOKEN.encode_ordinary(text)


def brute_merge(piece, ranks):
    parts = [piece[i : i + 1] for i in range(len(piece))]
    while len(parts) > 1:
        best = min(range(len(parts) - 1), key=lambda i: ranks.get(parts[i] + parts[i + 1], 1 << 60))
        if parts[best] + parts[best + 1] not in ranks:
            break
        parts[best : best + 2] = [parts[best] + parts[best + 1]]
    return [ranks[p] for p in parts]


@given(st.lists(st.text(alphabet="ab", min_size=2, max_size=5).map(str.encode), max_size=12), st.text(alphabet="ab", max_size=24))
@settings(max_examples=200, deadline=None)
def test_merges_equal_brute_force(tokens, text):
    ranks = {bytes([b]): b for b in range(256)}
    for k, token in enumerate(tokens):
        ranks.setdefault(token, 300 + k)
    want = brute_merge(text.encode(), ranks)
    assert B.merged(text.encode(), ranks, max(map(len, ranks))) == want
    pieces = [text.encode(), b"b" + text.encode(), text.encode()[:5], b"", b"a"]
    assert [np.frombuffer(x, "<u4").tolist() for x in B.Merges(ranks).packed(pieces)] == [brute_merge(p, ranks) if p not in ranks else [ranks[p]] for p in pieces]


def test_pieces_of_every_length_side_by_side():
    rng = random.Random(6)
    pieces = ["".join(rng.choices("etaoin shrdlué日", k=k)).encode() for k in range(90) for _ in range(3)]
    want = [[RANKS[p]] if p in RANKS else B.merged(p, RANKS, 128) for p in pieces]
    assert [np.frombuffer(x, "<u4").tolist() for x in B.Merges(RANKS).packed(pieces)] == want


def test_pieces_are_forgotten(monkeypatch):
    few = B.Encoder(RAW, B.split_pattern(), B.younger())
    few.MOST_PIECES = 3
    monkeypatch.setattr(B, "LONG_TEXT", 20)
    texts = ["one two three four five", None, "short", "q" * 100, "six " * 30, ""]
    assert few.packed(texts) == ENCODER.packed(texts) and not any(len(p) > 64 for p in few.known)


def test_vocabulary_must_hold_every_byte():
    with pytest.raises(ValueError):
        B.Merges({b"a": 0})


def test_encode_and_decode_frames(spark):
    rows = [(k, t) for k, t in enumerate(ODD)] + [(None, "null id"), (3, "again"), (3, "again"), (99, None)]
    frame = spark.createDataFrame([(*r, b"x") for r in rows], "doc_id long, text string, ids binary").withColumn("token", F.lit(1))
    got = B.encode(frame).select("doc_id", B.token_count(F.col("ids")).alias("n"), B.token_ids(F.col("ids")).alias("each"), B.decoded(F.col("ids")).alias("back")).collect()
    want = [(i, len(x := TIKTOKEN.encode_ordinary(t or "")), x, bytearray((t or "").encode())) for i, t in rows]
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
    assert B.encode(spark.createDataFrame([], "doc_id string, text string")).collect() == []
    assert spark.range(1).select(B.decoded(F.lit(None).cast("binary"))).first()[0] is None


def test_other_vocabulary(spark, tmp_path):
    path = tmp_path / "ranks"
    tokens = [bytes([b]) for b in range(256)] + [b"ab", b"abab", b"ba"]
    path.write_bytes(b"\n".join(base64.b64encode(t) + b" %d" % k for k, t in enumerate(tokens)))
    got = B.encode(spark.createDataFrame([(1, "babab ab")], "doc_id long, text string"), ranks_path=str(path), pattern=r"\S+|\s+").select(B.token_ids(F.col("ids"))).first()[0]
    assert got == [98, 257, 32, 256]


# --- fill in the middle


@given(st.text(alphabet=st.characters(codec="utf-8"), max_size=40), st.integers(0, 200))
@settings(max_examples=200, deadline=None)
def test_places(text, at):
    raw = text.encode()
    index = M.CutIndex(raw)
    assert index.chars() == len(text)
    at %= len(text) + 1
    byte = len(text[:at].encode())
    assert index.to_byte(at) == byte and index.to_char(byte) == at
    inside = at % (len(raw) + 1)
    while inside < len(raw) and 0x80 <= raw[inside] < 0xC0:
        inside -= 1
    assert index.snapped(at % (len(raw) + 1)) == inside


def brute_fill(doc_id, text, unit="line", percent=100, spm=50):
    text = text or ""
    h = hashlib.sha256(f"7:{'null' if doc_id is None else doc_id}".encode()).hexdigest()
    a, b, whether, which = (int(h[k : k + 8], 16) for k in (0, 8, 16, 24))
    units = re.findall(r"[^\n]*\n|[^\n]+", text) if unit == "line" else list(text)
    low, high = sorted((a % (len(units) + 1), b % (len(units) + 1)))
    if not text or "<P>" in text or "<S>" in text or "<M>" in text or whether % 100 >= percent:
        return doc_id, len(units), "plain", None, None, text, text
    p, m, s = "".join(units[:low]), "".join(units[low:high]), "".join(units[high:])
    return (doc_id, len(units), "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}", text) if which % 100 < spm else (doc_id, len(units), "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}", text)


@pytest.mark.parametrize(("unit", "percent", "spm"), [("line", 100, 50), ("char", 60, 30), ("line", 0, 0), ("char", 100, 100)])
def test_fill_equals_brute_force(spark, unit, percent, spm):
    rng = random.Random(7)
    docs = [(k, "".join(rng.choices("ab\n é日😀<PSM>", k=rng.choice([1, 5, 40])))) for k in range(150)] + [(1000 + k, t) for k, t in enumerate(ODD)]
    docs += [(None, "a\nb\nc"), (5, None), (5, "same\nid"), (5, "same\nid"), (9, "line é\n" * 50_000), (10, "<<P<S\n>M>\n" * 9)]
    frame = spark.createDataFrame([(*d, "x") for d in docs], "doc_id long, text string, output string").withColumn("form", F.lit(2)).withColumn("digest", F.lit(None).cast("string"))
    made = M.fill_in_middle(frame, unit=unit, percent=percent, spm_percent=spm)
    got = made.withColumn("back", M.restored(F.col("output"), F.col("form"))).collect()
    assert sorted(map(tuple, got), key=str) == sorted((brute_fill(*d, unit, percent, spm) for d in docs), key=str)


def test_fill_by_bytes_keeps_characters(spark):
    docs = [(k, "é日😀a" * (k % 7)) for k in range(100)]
    made = M.fill_in_middle(spark.createDataFrame(docs, "doc_id long, text string"), unit="byte", sentinels=("[p]", "[s]", "[m]"))
    for r in made.withColumn("back", M.restored(F.col("output"), F.col("form"), ("[p]", "[s]", "[m]"))).collect():
        assert r.back == dict(docs)[r.doc_id] and r.n == len(r.back.encode())


def test_fill_empty_table_and_arguments(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert M.fill_in_middle(empty).collect() == []
    for bad in ({"unit": "word"}, {"sentinels": ("aa", "b", "c")}, {"sentinels": ("<P>", "<P>", "<M>")}, {"sentinels": ("ab", "bc", "x")}, {"sentinels": ("", "b", "c")}):
        with pytest.raises(ValueError):
            M.fill_in_middle(empty, **bad)
