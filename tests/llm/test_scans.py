import hashlib
import random
import re

import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from codecensus.llm import pii_redaction, secret_scan
from codecensus.llm.decontaminate import leaks, window_size, windows
from codecensus.llm.license_scan import TEMPLATES, guard_words, scan_licenses

SCHEMA = "doc_id long, text string, source string"
#: The contract's patterns, as given.
SECRETS = {
    "assign": (r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
               lambda m: len(m[2]) >= 6),
    "access": (r"AKIA[A-Z0-9]+", lambda m: len(m[0]) >= 20),
    "hex": (r"[0-9a-f]+", lambda m: len(m[0]) >= 24),
}


def luhn(digits):
    odd, even = digits[::-1][::2], digits[::-1][1::2]
    return (sum(map(int, odd)) + sum(sum(divmod(2 * int(d), 10)) for d in even)) % 10 == 0


def digits(m):
    return re.sub("[^0-9]", "", m[0])


PERSONAL = {
    "email": (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
    "ip": (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(x) <= 255 for x in m[0].split("."))),
    "card": (r"[0-9]([\x20-]?[0-9])+", lambda m: 12 <= len(digits(m)) <= 19 and luhn(digits(m))),
    "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 9 <= len(digits(m)) <= 15),
}


def base(text, kinds):
    found = [(m.start(), k, m.end(), kind) for k, (kind, (p, ok)) in enumerate(kinds.items()) for m in re.finditer(p, text or "") if ok(m)]
    return [f"{kind}:{s}:{e}" for s, _, e, kind in sorted(found)]


PIECES = ["a", "@", ".", "b.co", "-", " ", "+", "1", "23", "4539578763621486", "(", ")", "255", "0001", "1.2.3.4", "é", "\n", "token", "Api_Key", "ſecret", "Key", "password", "=", ":", "\"",
          "AKIA", "ABCDEFGHIJKLMNOP", "deadbeef", "0123456789abcdef", "+1 (017) 555-7713", "passwd", "%", "eyJ"]


@settings(max_examples=600, deadline=None)
@given(st.lists(st.sampled_from(PIECES), max_size=30).map("".join))
def test_base_spans_equal_the_given_patterns(text):
    got = [f"{secret_scan.KINDS[k]}:{s}:{e}" for k, s, e, _ in secret_scan.candidates(text) if k < secret_scan.BASE]
    assert got == base(text, SECRETS)
    assert [f"{pii_redaction.KINDS[k]}:{s}:{e}" for s, k, e in pii_redaction.base_spans(text)] == base(text, PERSONAL)


def test_long_texts_are_read_in_linear_time():
    text = "1" * 300_000 + "a" * 300_000 + "@" + " +" * 100_000 + "1.1." * 50_000
    secret_scan.candidates(text)
    pii_redaction.base_spans(text)


LIVE = "9f86d081884c7d659a2feaa0c55ad015a3bf4f1b"
COPIED = "2c26b46b68ffc68ff99b453c1d30413413422d70"


def test_secrets_by_ownership(spark):
    rows = [(1, f'token = "{LIVE}"', "s1"), (1, f'token = "{LIVE}"', "s1")] + [(10 + k, f"see {COPIED}, glpat-ABCDEFGHIJKLMNOPQRST12", f"o{k}") for k in range(4)]
    rows += [(2, None, None), (3, "", "s1"), (4, "password: example_password_1", "s4")]
    docs = spark.createDataFrame(rows, SCHEMA)
    got = secret_scan.secret_scan(docs.withColumnRenamed("source", "owner").withColumn("spans", docs.text), owner_col="owner").collect()
    assert len(got) == len(rows)
    by = {r.doc_id: r for r in got}
    for i, text, _ in rows:
        spans = base(text, SECRETS)
        assert by[i].base_sha256 == hashlib.sha256(",".join(spans).encode()).hexdigest()
        assert set(spans) <= set(by[i].spans.split(",")) | {""} and by[i].n_hex == sum(x.startswith("hex") for x in spans)
    assert by[1].n_live == 2 and by[1].n_example == 0 and by[10].n_live == 0 and by[10].n_example == 2 and by[4].n_live == 0
    assert "vendor" not in by[10].spans  # copied by many owners
    assert secret_scan.secret_scan(spark.createDataFrame([], SCHEMA)).collect() == []


def test_secrets_copied_within_one_owner(spark):
    own = "6b86b273ff34fce19d6b804eff5a3f5747ada4ea"
    rows = [(k, f"see {COPIED}, glpat-ABCDEFGHIJKLMNOPQRST12", "hot") for k in range(40)] + [(100 + k, f'token = "{LIVE}"', "hot") for k in range(9)]
    rows += [(200, own, "hot"), (201, own, None)]
    docs = spark.createDataFrame(rows, SCHEMA)
    by = {r.doc_id: r for r in secret_scan.secret_scan(docs).collect()}
    assert by[0].live == "" and by[0].n_example == 2 and by[0].spans == "hex:4:44" and by[0].held == "hex:4:44:1:40,vendor:46:74:1:40"
    assert by[100].n_live == 2 and by[100].n_example == 0  # nine repositories are too few for an example
    assert by[200].held == "hex:0:40:2:2" and by[200].n_live == by[200].n_example == by[201].n_live == 0
    # The number is relative to the owner's repositories, 50 here.
    assert {r.n_example for r in secret_scan.secret_scan(docs, copied_share=0.9).collect()} == {0}


def test_personal_data_added_beside_a_document_of_many_spans(spark):
    """A document with more spans than the sample holds, first in the order of the sample, and mistyped card numbers elsewhere."""
    from pyspark.sql import functions as F

    def card(k, wrong):
        stem = f"45395787{k * 7919 % 10**7:07}"
        right = next(d for d in range(10) if pii_redaction.luhn(f"{stem}{d}"))
        return f"{stem}{(right + wrong) % 10}"

    first = spark.range(1000, 3000).orderBy(F.xxhash64("id", F.lit(11))).first().id
    rows = [(k, f"pay by card {card(k, k % 25 == 0)} now", "s") for k in range(1, 400)]
    rows += [(first, " ".join(f"10.0.{k // 250}.{k % 250}" for k in range(4500)), "s")]
    got = {r.doc_id: r for r in pii_redaction.find_personal_data(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert [k for k in range(1, 400) if got[k].n_added] == list(range(25, 400, 25))
    assert got[25].spans == "card:12:28" and got[25].n_card == 0 and got[first].n_ip == 4500


def test_personal_data_written_otherwise(spark):
    """Learnt from strict spans alone: spans written another way are found, decoys are left alone; precision and recall."""
    import random

    rng = random.Random(4)
    words = "the report of last week was sent to all of them and nobody knew why it came so late".split()
    prose = lambda n: " ".join(rng.choice(words) for _ in range(n))

    def card(wrong):
        stem = f"4{rng.randrange(10**14):014}"
        return stem + str((next(d for d in range(10) if pii_redaction.luhn(f"{stem}{d}")) + wrong) % 10)

    def strict(kind):
        return (f"{rng.choice(words)}.{rng.randrange(99)}@mail{rng.randrange(9)}.example.com", ".".join(str(rng.randrange(256)) for _ in range(4)), card(0),
                f"+{rng.randrange(1, 99)} {rng.randrange(100, 999)} {rng.randrange(100, 999)} {rng.randrange(1000, 9999)}")[kind]

    decoys = (lambda: card(1 + rng.randrange(8)), lambda: f"user@host{rng.randrange(9999)}", lambda: f"build 900.{rng.randrange(99)}.3.4")
    learn = [(k, f"{prose(9)} {strict(k % 4)} {prose(5)} {rng.choice(decoys)()} {prose(3)}", "s") for k in range(800)]
    held, truth = [], {}
    for k in range(1000, 1400):
        form = pii_redaction.written_otherwise(strict(k % 4), k % 4)[0][0]
        lead = prose(7) + " "
        truth[k] = (k % 4, len(lead), len(lead) + len(form)) if k % 3 else None
        held.append((k, f"{lead}{form if k % 3 else rng.choice(decoys)()} {prose(6)}", "s"))
    got = {r.doc_id: r for r in pii_redaction.find_personal_data(spark.createDataFrame(learn + held, SCHEMA)).collect()}
    added = {k: [x.split(":") for x in got[k].spans.split(",") if x] for k in truth if got[k].n_added}
    right = [k for k, spans in added.items() if truth[k] and any(
        x == pii_redaction.KINDS[truth[k][0]] and int(s) < truth[k][2] and truth[k][1] < int(e) for x, s, e in spans)]
    wanted = sum(t is not None for t in truth.values())
    assert len(right) >= 0.9 * wanted and len(right) >= 0.9 * len(added), (len(right), wanted, len(added))
    assert sum(got[k].n_added for k in range(800)) <= 8


def test_personal_data_with_and_without_training(spark):
    rows = [(k, f"call +1 (017) 555-{7000 + k} or mail a{k}@b{k}.com, host 10.0.0.{k}, build 900.{k}.3.4" if k % 2 else f"pay 4539578763621486 for {10**11 + k * 7}", "s") for k in range(60)]
    rows += [(100, None, None), (101, "", None), (101, "", None), (102, "write to me at[at]home.org", "s")]
    got = pii_redaction.find_personal_data(spark.createDataFrame(rows, SCHEMA).withColumnRenamed("source", "found")).collect()
    assert len(got) == len(rows)
    for r, (_, text, _) in zip(sorted(got, key=lambda r: r.doc_id), rows, strict=True):
        spans = base(text, PERSONAL)
        assert r.base_sha256 == hashlib.sha256(",".join(spans).encode()).hexdigest()
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(x.startswith(k) for x in spans) for k in PERSONAL]
        assert set(spans) <= set(r.spans.split(",")) | {""} and len([x for x in r.spans.split(",") if x]) == len(spans) + r.n_added
    assert pii_redaction.find_personal_data(spark.createDataFrame([], SCHEMA)).collect() == []


def shingles(words):
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)}


def brute(docs, parts, find, whole=False):
    def shingles_of(words):
        return {tuple(words)} if whole and 0 < len(words) < 5 else shingles(words)

    sets = {k: shingles_of(find(v.lower())) for k, v in parts.items()}
    count = {}
    for s in sets.values():
        for x in s:
            count[x] = count.get(x, 0) + 1
    out = set()
    for i, text in docs:
        held = shingles_of(find((text or "").lower()))
        for k, s in sets.items():
            total, shared = sum(max(1, 1000 // count[x]) for x in s), sum(max(1, 1000 // count[x]) for x in s & held)
            if total and 100 * shared >= 80 * total:
                out.add((i, k, shared, total))
    return out


def test_leaks_equal_brute_force(spark):
    import random
    rng = random.Random(5)
    vocabulary = [f"v{k}" for k in range(300)]
    items = {k: " ".join(rng.choice(vocabulary) for _ in range(n)) for k, n in enumerate([4, 5, 9, 13, 14, 20, 33, 47, 48, 60, 95, 96, 130, 200, 400])}
    items[50] = items[5] + " and more of the same kind"
    docs = [(200, None), (201, ""), (202, "a b"), (203, " ".join(items[9].split()[:30])), (204, items[8].upper()), (204, items[8].upper())]
    for k, text in items.items():
        for e in range(3):
            words = text.split()
            for _ in range(e):
                words[rng.randrange(len(words))] = "edited"
            docs.append((k * 10 + e, " ".join(rng.choice(vocabulary) for _ in range(rng.randrange(40))) + "\n" + " ".join(words) + " end of it"))
    frame = spark.createDataFrame([(i, t, "s") for i, t in docs], SCHEMA).withColumnRenamed("source", "item_id")
    listed = spark.createDataFrame([(k, v) for k, v in items.items()] + [(99, None), (98, "")], "item_id long, text string")
    got = {tuple(r)[:4] for r in leaks(frame, listed).collect()}
    want = brute(docs, items, lambda t: re.findall(r"[^\x20\x09-\x0D]+", t), whole=True)
    assert got == want and len(want) > 30
    assert leaks(frame, listed.limit(0)).collect() == [] == leaks(frame.limit(0), listed).collect()


def test_leaks_with_evenly_spaced_edits(spark):
    """Just above and below the threshold, and for items whose weight lies in a few shingles of their own."""
    def edited(words, count, kind):
        out = list(words)
        for e in range(count, 0, -1):
            at = e * len(words) // (count + 1)
            out[at:at + (kind != "insert")] = [] if kind == "delete" else [f"edit{e}"]
        return " ".join(out)

    items = {n: [f"i{n}w{k}" for k in range(n)] for n in (48, 60, 96, 130, 200, 300, 400)}
    common = [f"common{k}" for k in range(100)]
    items |= {1000 + k: common + [f"own{k}w{j}" for j in range(40)] for k in range(12)}
    docs = []
    for n, words in items.items():
        for kind, lost in (("insert", 4), ("substitute", 5), ("delete", 5)):
            most = (len(words) - 4) // (5 * lost)
            docs += [(len(docs) + k, edited(words, count, kind)) for k, count in enumerate((most, most + 1, most + 2))]
    docs += [(5000, " ".join(items[1003][95:])), (5001, " ".join(f"{' '.join(items[96][k:k + 5])} apart" for k in range(92)))]
    listed = {k: " ".join(v) for k, v in items.items()}
    got = {tuple(r)[:4] for r in leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(list(listed.items()), "item_id long, text string")).collect()}
    want = brute(docs, listed, str.split, whole=True)
    assert got == want and {48, 60, 96, 130, 200, 300, 400} <= {k for _, k, *_ in want} and {i for i, *_ in want} >= {5000, 5001}


def test_windows_find_evenly_spaced_edits_alone(spark):
    """The item-sized windows without the short ones: every copy with the shingles that the size asks for keeps a window."""
    for n in (20, 48, 96, 200, 400):
        for percent in (80, 95):
            size = spark.range(1).select(window_size(F.lit(n), percent)).first()[0]
            run = 3 * size // 2 - 1
            cuts = range(1, n)
            for gap in range(1, run):  # breaks every ``gap`` words, the cheapest way to leave no run
                lost = {s for c in cuts if c % gap == 0 for s in range(max(0, c - 4), min(c, n - 4))}
                assert size == 4 or len(lost) * 100 > (100 - percent) * (n - 4)


def test_items_that_share_all_their_shingles(spark):
    listed = [(k, "one two three four five six seven") for k in range(1001)] + [(2000, "other words of one two three four five here"), (2001, "just three words")]
    docs = [(1, "begin one two three four five end"), (2, "one two three four five six seven"), (3, "just three words"), (4, "it is just three words"), (None, "other words of one two three four five here")]
    got = {tuple(r)[:4] for r in leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(listed, "item_id long, text string")).collect()}
    assert got == brute(docs, dict(listed), str.split, whole=True)
    assert {i for i, *_ in got} == {2, 3, None}


def test_licenses_equal_brute_force(spark):
    docs = [(k, f"Some words before. {v} And after, under the software rules.") for k, v in enumerate(TEMPLATES.values())]
    docs += [(50, TEMPLATES["MIT-text"].replace("furnished", "x").replace("sublicense", "rent")), (51, None), (52, ""), (53, "license"), (54, "thunder under licensed"), (55, docs[0][1]), (55, docs[0][1])]
    docs += [(60, TEMPLATES["GPL-3.0"].rsplit(" ", 1)[0]), (61, "word " * 5000 + TEMPLATES["Apache-2.0"])]
    got = {tuple(r)[:4] for r in scan_licenses(spark.createDataFrame([(i, t, "s") for i, t in docs], SCHEMA).withColumnRenamed("source", "license")).collect()}
    want = brute(docs, TEMPLATES, lambda t: re.findall("[a-z0-9]+", t))
    assert got == want and {k for _, k, *_ in got} == set(TEMPLATES)
    assert scan_licenses(spark.createDataFrame([], SCHEMA)).collect() == []


def guarded(templates):
    """Whether no text without a guard word can have four fifths of a template's weight."""
    find = lambda t: re.findall("[a-z0-9]+", t.lower())
    sets, guards = {k: shingles(find(t)) for k, t in templates.items()}, set(guard_words(templates))
    weight = lambda xs: sum(max(1, 1000 // sum(x in s for s in sets.values())) for x in xs)
    return all(not s or 100 * weight([x for x in s if not set(x) & guards]) < 80 * weight(s) for s in sets.values())


def test_guards_are_lossless():
    assert guarded(TEMPLATES)


def test_guards_count_weight(spark):
    """Templates with a common head: nearly all the weight is in their own tails."""
    head = " ".join(f"commonly{k}" for k in range(60))
    templates = {f"T{k}": f"{head} " + " ".join(f"own{k}x{j}" for j in range(12)) for k in range(40)}
    assert guarded(templates)
    docs = [(k, t.split(" ", 56)[-1]) for k, t in enumerate(templates.values())] + [(100, head)]
    got = {tuple(r)[:4] for r in scan_licenses(spark.createDataFrame(docs, "doc_id long, text string"), templates=templates).collect()}
    want = brute(docs, templates, lambda t: re.findall("[a-z0-9]+", t))
    assert got == want and {i for i, *_ in want} == set(range(40))


def test_small_windows_are_counted_in_columns(spark):
    rng = random.Random(4)
    texts = {n: [rng.getrandbits(64) - 2**63 for _ in range(n)] for n in (0, 1, 3, 4, 5, 7, 8, 9, 12, 21)}
    hashed = spark.createDataFrame(list(texts.items()), "i long, h array<long>")
    found = windows(hashed, [4, 8], "i")

    def print_of(h):  # at half, the first word decides
        ones = [sum(x >> b & 1 for x in h) for b in range(64)]
        bits = sum((2 * n > len(h) or 2 * n == len(h) and h[0] >> b & 1) << b for b, n in enumerate(ones))
        return bits - 2**64 if bits >> 63 else bits

    expected = sorted((i, w, print_of(h[k : k + w])) for i, h in texts.items() for w in (4, 8) for k in range(0, len(h) - w + 1, w // 2))
    assert sorted((r.i, r.size, r.fingerprint) for r in found.collect()) == expected
    # One lambda lays the words out; before, others counted bits in arrays of structs.
    assert found._jdf.queryExecution().optimizedPlan().toString().count("lambdafunction") <= 1
