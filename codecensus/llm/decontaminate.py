"""Benchmark decontamination by SimHash windows and multi-index Hamming blocks, in column expressions only.

All windows of an item are fingerprinted, and every second half of a window of the documents. A fingerprint has 64 bits,
each the majority of that bit over the hashes of the window's words. It is cut into four blocks: two fingerprints that
differ in at most three bits agree in one block, so a join on blocks misses none. Candidates are confirmed by the weighted
share of the item's shingles that the document holds.

Windows are sized by the items, W words being the largest power of two for which a copy with 80 % of the item's shingles
surely keeps a run of 3 W / 2 - 1 words; such a run holds one of the document's windows whole. Take R such words as a
block, R + 2 words apart: breaking every run breaks every block, by a word put in, taken out or replaced, and each break
costs four shingles of its own. So all is well while 4 times the blocks is more than the shingles that may be lost.

That counts shingles as equal and breaks as costly. A document may also keep the weight in a few heavy shingles, or hold
each shingle apart from the next. For that an item is filed again by windows of four words, where a run of one shingle is
enough: under both windows of each of its heaviest shingles, until they weigh more than the part that may be lacking. A
document with 80 % of the weight holds one of these shingles at least, and of its two windows one begins at an even word
and is a window of the document, with the same fingerprint. So no pair is missed, whatever the edits and weights are.

Bits are counted for all 64 places at once: a count is a few longs, the k-th of which holds the k-th binary digit of every
place's count, and two counts are added by a chain of XOR and AND. Sums over pairs of words give those over four, eight, ...
For windows of four and eight words, which every item asks for, the words are laid out side by side in a row instead: bits are
then counted by compiled code, without an array in between.
"""


from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from codecensus.llm.native import SHINGLE, bounded, contained, exploded, hashes, shingle_hashes, weighted_shingles, words
from codecensus.session import cut

GAP = r"[\x20\x09-\x0D]+"
RADIUS = 3
BLOCKS = RADIUS + 1
BITS = 64 // BLOCKS
SIZES = (4, 8, 16, 32, 64)
SMALLEST, LARGEST = SIZES[0], SIZES[-1]
#: Windows of up to so many words are laid out word by word.
GATHERED = 8
SIMILAR_PERCENT = 80


def window_size(n: Column, percent: int = SIMILAR_PERCENT) -> Column:
    """Words in a window for an item of n words; items under five words are one window of their own and have none here."""
    def sure(w: int) -> Column:
        run = 3 * w // 2 - 1
        blocks = F.greatest(F.lit(0), F.floor((n - 2 * (SHINGLE - 2)) / (run + 2)))
        return 100 * (SHINGLE - 1) * blocks > (100 - percent) * (n - SHINGLE + 1)

    size = F.lit(SMALLEST)
    for w in SIZES[1:]:
        size = F.when(sure(w), w).otherwise(size)
    return F.when(n >= SHINGLE, size)


def _starts(n: Column) -> Column:
    return F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))


def _digits(values: list[Column]) -> Column:
    return F.struct(*[v.alias(f"d{k}") for k, v in enumerate(values)])


def _pairs(word_hashes: Column) -> Column:
    """Counts of words 2 i and 2 i + 1."""
    def both(i: Column) -> Column:
        a, b = F.get(word_hashes, 2 * i), F.get(word_hashes, 2 * i + 1)
        return _digits([a.bitwiseXOR(b), a.bitwiseAND(b)])

    return F.transform(_starts(F.floor(F.size(word_hashes) / 2).cast("int")), both)


def _added(counts: Column, digits: int, hop: int, apart: int) -> Column:
    """Counts ``hop`` i and ``hop`` i + ``apart``, added; each has ``digits`` digits, the sums have one more."""
    n = F.floor((F.size(counts) - apart - 1) / hop).cast("int") + 1

    def add(x: Column) -> Column:
        out, carry = [], None
        for k in range(digits):
            a, b = x["a"][f"d{k}"], x["b"][f"d{k}"]
            out.append(a.bitwiseXOR(b) if carry is None else a.bitwiseXOR(b).bitwiseXOR(carry))
            carry = a.bitwiseAND(b) if carry is None else a.bitwiseAND(b).bitwiseOR(carry.bitwiseAND(a.bitwiseXOR(b)))
        return _digits([*out, carry])

    # The pairs stand in an array of their own, so that each is looked up once.
    return F.transform(F.transform(_starts(n), lambda i: F.struct(F.get(counts, hop * i).alias("a"), F.get(counts, hop * i + apart).alias("b"))), add)


def _majority(counts: Column, size: int, hop: int) -> Column:
    """Bits that more than half of the window's words have; at half, the first word decides, so that no value is preferred."""
    digits = size.bit_length()

    def vote(c: Column, k: Column) -> Column:
        rest = reduce(lambda a, b: a.bitwiseOR(b), [c[f"d{d}"] for d in range(digits - 2)], F.get("h", k * hop))
        return c[f"d{digits - 1}"].bitwiseOR(c[f"d{digits - 2}"].bitwiseAND(rest))

    return F.transform(counts, vote)


def _small_windows(hashed: DataFrame, sizes: list[int], *keep: str) -> DataFrame:
    """``windows`` of sizes up to ``GATHERED``: a row of its words for each, so that bits are counted by compiled code and not in arrays."""
    long = [w for w in sizes if w]
    h, most, hop = F.col("h"), max(long, default=1), min(long, default=2) // 2
    n = F.floor((F.size(h) - 2 * hop) / hop).cast("int") + 1 if long else F.lit(0)
    groups = F.transform(_starts(n), lambda i: F.struct(i.alias("at"), *[F.get(h, hop * i + k).alias(f"h{k}") for k in range(most)]))
    if 0 in sizes:  # a short text stands at -1 and is its own hash
        short = F.struct(F.lit(-1).alias("at"), F.xxhash64(h).alias("h0"), *[F.lit(None).cast("long").alias(f"h{k}") for k in range(1, most)])
        groups = F.concat(F.filter(F.array(short), lambda _: F.size(h).between(1, SHINGLE - 1)), groups)
    # Digits are columns, level by level: one expression for all would be too long to be compiled.
    given = [F.coalesce(F.col(f"g.h{k}"), F.lit(0)).alias(f"_h{k}") for k in range(most)]
    rows = exploded(hashed, groups, "g", *keep).select(*keep, F.col("g.at").alias("_at"), F.col(f"g.h{most - 1}").isNotNull().alias("_full"), *given)
    at, h = F.col("_at"), [F.col(f"_h{k}") for k in range(most)]
    every = []
    if 0 in sizes:
        every.append(F.when(at < 0, F.struct(F.lit(0).alias("size"), h[0].alias("fingerprint"))))
    if 4 in sizes:
        value = h[0].bitwiseAND(h[1].bitwiseOR(h[2]).bitwiseOR(h[3])).bitwiseOR(h[1].bitwiseAND(h[2]).bitwiseAND(h[3]))
        every.append(F.when(at >= 0, F.struct(F.lit(4).alias("size"), value.alias("fingerprint"))))
    if 8 in sizes:
        counts = [[x] for x in h]
        while len(counts) > 1:
            level, names = {}, []
            for m, (x, y) in enumerate(zip(counts[::2], counts[1::2], strict=True)):
                digits, carry = [], None
                for a, b in zip(x, y, strict=True):
                    digits.append(a.bitwiseXOR(b) if carry is None else a.bitwiseXOR(b).bitwiseXOR(carry))
                    carry = a.bitwiseAND(b) if carry is None else a.bitwiseAND(b).bitwiseOR(carry.bitwiseAND(a.bitwiseXOR(b)))
                names.append([f"_c{len(counts)}_{m}_{d}" for d in range(len(digits) + 1)])
                level |= dict(zip(names[-1], [*digits, carry], strict=True))
            rows, counts = rows.withColumns(level), [[F.col(c) for c in n] for n in names]
        *low, half, all_ = counts[0]
        value = all_.bitwiseOR(half.bitwiseAND(reduce(lambda a, b: a.bitwiseOR(b), low, h[0])))
        there = (at >= 0) & F.col("_full") & (at * hop % 4 == 0)
        every.append(F.when(there, F.struct(F.lit(8).alias("size"), value.alias("fingerprint"))))
    return exploded(rows, F.array(*every), "w", *keep).select(*keep, "w.size", "w.fingerprint")


def windows(hashed: DataFrame, sizes: list[int], *keep: str) -> DataFrame:
    """(keep, size, fingerprint) of (keep, h): windows of each of the sizes, one each half of a window; size 0 are short texts."""
    small, long = [w for w in sizes if w <= GATHERED], [w for w in sizes if w > GATHERED]
    if not long:
        return _small_windows(hashed, small or [0], *keep)
    # Counts over 4 words stand 4 words apart, later ones half of their size.
    df = hashed.withColumn("c2", _pairs(F.col("h"))).withColumn("c4", _added(F.col("c2"), 2, 2, 1))
    digits, size, hop = 3, 4, 1
    while size < max(long):
        df = df.withColumn(f"c{2 * size}", _added(F.col(f"c{size}"), digits, hop, 2 if hop == 2 else 1))
        digits, size, hop = digits + 1, 2 * size, 2
    every = [_sized(w, _majority(F.col(f"c{w}"), w, w // 2)) for w in long]
    large = exploded(df, F.flatten(F.array(*every)), "w", *keep).select(*keep, "w.size", "w.fingerprint")
    return _small_windows(hashed, small, *keep).union(large) if small else large


def _blocks(size: Column, fingerprint: Column) -> Column:
    """Keys under which a fingerprint is filed: window size, block number and block."""
    mask = (1 << BITS) - 1
    return F.array(*[(size.cast("long") * BLOCKS + b) * (mask + 1) + F.shiftrightunsigned(fingerprint, b * BITS).bitwiseAND(F.lit(mask).cast("long")) for b in range(BLOCKS)])


def _sized(size: int, prints: Column) -> Column:
    return F.transform(prints, lambda f: F.struct(F.lit(size).alias("size"), f.alias("fingerprint")))


def heaviest(parts: DataFrame, percent: int) -> DataFrame:
    """(item_id, x) of (item_id, x, weight): the heaviest shingles, of which a document with ``percent`` of the weight holds one at least."""
    item = Window.partitionBy("item_id")
    before = F.sum("weight").over(item.orderBy(F.desc("weight"), "x").rowsBetween(Window.unboundedPreceding, -1))
    weighed = parts.select("item_id", "x", F.coalesce(before, F.lit(0)).alias("before"), F.sum("weight").over(item).alias("total"))
    return weighed.where(100 * F.col("before") <= (100 - percent) * F.col("total")).select("item_id", "x")


def _short(h: Column) -> Column:
    """A text of fewer than five words is one window and one shingle: struct(size 0, fingerprint), else null."""
    return F.when(F.size(h).between(1, SHINGLE - 1), F.struct(F.lit(0).alias("size"), F.xxhash64(h).alias("fingerprint")))


def item_windows(items: DataFrame, parts: DataFrame, id_col: str = "item_id", text_col: str = "text", percent: int = SIMILAR_PERCENT) -> DataFrame:
    """(item_id, size, fingerprint) of the windows under which items are filed; parts are their weighted shingles."""
    every = items.select(F.col(id_col).alias("item_id"), hashes(words(F.col(text_col), GAP)).alias("h"))
    hashed = every.withColumn("size", window_size(F.size("h"), percent)).where("size is not null")
    found = every.select("item_id", _short(F.col("h")).alias("w")).where("w is not null").select("item_id", "w.size", "w.fingerprint")
    # Windows stand half a window apart: with every offset below that, one starts at each word.
    for w in SIZES:
        shifted = hashed.where(F.col("size") == w).select("item_id", "h", F.explode(F.sequence(F.lit(0), F.lit(w // 2 - 1))).alias("o"))
        rest = shifted.select("item_id", F.slice("h", F.col("o") + 1, F.greatest(F.lit(0), F.size("h") - F.col("o"))).alias("h"))
        found = found.union(windows(rest, [w], "item_id"))
    placed = hashed.select("item_id", "h", F.posexplode(shingle_hashes(F.col("h"))).alias("at", "x"))
    heavy = placed.join(heaviest(parts, percent), ["item_id", "x"]).groupBy("item_id", "x").agg(F.min_by(F.slice("h", F.col("at") + 1, F.lit(SHINGLE)), "at").alias("run"))
    ends = F.array(*[F.slice("run", k, F.lit(SMALLEST)) for k in range(1, SHINGLE - SMALLEST + 2)])
    return found.union(windows(heavy.select("item_id", F.explode(ends).alias("h")), [SMALLEST], "item_id")).distinct()


def leaks(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text", *,
          percent: int = SIMILAR_PERCENT) -> DataFrame:
    """(doc_id, item_id, shared, total, similarity) of every document that holds ``percent`` of an item's weighted five-word shingles.

    A text of fewer than five words is one shingle, so a short item matches documents of just its words. Null and empty
    texts, of either side, hold nothing; texts of any length are read whole. Rows that repeat an id are one document, or
    one item; a null id is an id. Empty tables give an empty result; other columns are ignored, whatever their names.
    """
    parts = cut(weighted_shingles(items, item_id, item_text, "item_id", GAP, whole=True))
    prints = cut(item_windows(items, parts, item_id, item_text, percent))
    sizes = sorted(r["size"] for r in prints.select("size").distinct().collect())  # six sizes at most
    texts = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("text"))
    filed = prints.select("item_id", F.col("fingerprint").alias("f1"), F.explode(_blocks(F.col("size"), F.col("fingerprint"))).alias("key"))
    hashed = texts.select("_id", hashes(words(F.col("text"), GAP)).alias("h"))
    seen = windows(hashed, sizes, "_id").withColumnRenamed("fingerprint", "f2")
    seen = exploded(seen, _blocks(F.col("size"), F.col("f2")), "key", "_id", "f2")
    pairs = cut(seen.join(bounded(filed), "key").where(F.bit_count(F.col("f1").bitwiseXOR(F.col("f2"))) <= RADIUS).select("_id", "item_id").distinct())
    found = contained(texts, pairs, parts, "item_id", GAP, percent, whole=True)
    return found.select(F.col("_id").alias("doc_id"), "item_id", "shared", "total", (F.col("shared") / F.col("total")).alias("similarity"))
