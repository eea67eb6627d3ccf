"""MinHash near-duplicates by an inverted join of signature coordinates.

Every distinct shingle set gets a signature of ``COORDINATES`` minima and is posted under each (coordinate, value). Two
sets that agree on at least ``LEAST_MATCHES`` coordinates are candidates; at a similarity of 0.85 fewer agree with a
probability of 3e-6. Merging the posting lists is cut down in two lossless ways:

* prefix: pairs are ordered by how many sets hold them, rarest first. Of two sets that share m of c pairs one must share
  a pair among the first c - m + 1 of each, so only those are posted. A value that one set alone holds takes a place in
  the prefix and is never posted; a set with more than c - m such values has no partner at all.
* skip: the long lists are those of the suffix. They are not merged; the matches they hold are counted by comparing the
  two signatures of a candidate.

Groups of copies do not square. Equal sets collapse before anything is posted. Each list compares its members with its
hub only, the member whose pairs are the most common; links found that way form classes, and what is left to do is to link
members of different classes of one list. Short lists are compared in full. The members of long ones are joined on their
shingles, which is exact: shingles are ordered by how many members hold them, two linked sets must share one among the rarest
15 in a hundred of each, and the place of the first shared one bounds how many more they can share. A shingle that one member
alone holds takes its place and is never posted, so a copy with more edits than the threshold allows drops out at once.
Links are confirmed on the full shingle sets, made again from the texts of candidates.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from codecensus.llm.common import WordHashes, components, packed, shingle_set, slices
from codecensus.llm.native import bounded
from codecensus.session import cut

COORDINATES = 32
LEAST_MATCHES = 17
SHINGLE = 5
SIMILAR_PERCENT = 85


def _odd_numbers(n: int, seed: int = 20) -> np.ndarray:
    return np.random.default_rng(seed).integers(0, 2**63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def text_key(text: Column) -> Column:
    """Tells the texts of one id apart."""
    return F.xxhash64(text)


def signatures(docs: DataFrame, id_col: str, text_col: str, coordinates: int = COORDINATES, size: int = SHINGLE) -> DataFrame:
    """(doc_id, text_key, n_shingles, set_key, signature) of every row; set_key is equal for equal shingle sets, null for empty ones."""
    factors = _odd_numbers(coordinates)

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen = WordHashes()
        for batch in slices(batches):
            counts, keys, signs = [], [], []
            for text in batch["text"]:
                values = shingle_set(text, seen, size)
                counts.append(len(values))
                keys.append(xxhash.xxh3_128_digest(values.tobytes()) if len(values) else None)
                signs.append(np.array([(values * f).min() for f in factors]).view(np.int64) if len(values) else None)
            yield pd.DataFrame({"doc_id": batch["doc_id"], "text_key": batch["text_key"], "n_shingles": counts, "set_key": keys, "signature": signs})

    slim = docs.select(F.col(id_col).alias("doc_id"), text_key(F.col(text_col)).alias("text_key"), F.col(text_col).alias("text"))
    return slim.mapInPandas(scan, f"doc_id {slim.schema['doc_id'].dataType.simpleString()}, text_key long, n_shingles long, set_key binary, signature array<long>")


def _shingle_sets(docs: DataFrame, size: int) -> DataFrame:
    """(id, n, shingles) of (id, text, set_key) rows; rows whose text has another key are left out."""
    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen = WordHashes()
        for batch in slices(batches):
            found = [(i, s) for i, t, k in zip(batch["id"], batch["text"], batch["set_key"], strict=True)
                     if xxhash.xxh3_128_digest((s := shingle_set(t, seen, size)).tobytes()) == bytes(k)]
            yield pd.DataFrame({"id": [i for i, _ in found], "n": [len(s) for _, s in found], "shingles": [s.view(np.int64) for _, s in found]})

    return docs.mapInPandas(scan, "id long, n long, shingles array<long>")


def _postings(reps: DataFrame, least_matches: int, coordinates: int) -> DataFrame:
    """(key, id, at, weight): the prefix of each set, rarest pairs first, without pairs that only one set holds."""
    posted = reps.select("id", F.explode("signature").alias("key"))
    common = posted.groupBy("key").agg(F.count("*").alias("df")).where("df > 1")
    held = posted.join(common, "key").groupBy("id").agg(F.sort_array(F.collect_list(F.struct("df", "key"))).alias("pairs"))
    held = held.where(F.size("pairs") >= least_matches).join(reps.select("id", F.col("first.doc_id").alias("at")), "id")
    # c - m + 1 places, of which the pairs nobody else holds take the first.
    room = F.lit(coordinates - least_matches + 1) - (F.lit(coordinates) - F.size("pairs"))
    weight = F.aggregate("pairs", F.lit(0).cast("long"), lambda s, p: s + p["df"])
    return held.select("id", "at", weight.alias("weight"), F.explode(F.slice("pairs", 1, room)).alias("p")).select(F.col("p.key").alias("key"), "id", "at", "weight")


def _linked(pairs: DataFrame, reps: DataFrame, sets: DataFrame, least_matches: int, percent: int, n: int) -> DataFrame:
    """The (a, b) of the given pairs whose signatures agree often enough and whose full sets are similar enough."""
    slim = reps.select("id", "n_shingles", "signature")
    left = slim.select(F.col("id").alias("a"), F.col("n_shingles").alias("na"), F.col("signature").alias("sa"))
    right = slim.select(F.col("id").alias("b"), F.col("n_shingles").alias("nb"), F.col("signature").alias("sb"))
    agree = F.aggregate(F.zip_with("sa", "sb", lambda x, y: (x == y).cast("int")), F.lit(0), lambda s, x: s + x)
    close = 100 * F.least("na", "nb") >= percent * F.greatest("na", "nb")
    asked = cut(packed(pairs.join(right, "b").join(left, "a").where(close & (agree >= least_matches)).select("a", "b", "na", "nb"), n))
    both = asked.join(sets.select(F.col("id").alias("b"), F.col("shingles").alias("xb")), "b").join(
        sets.select(F.col("id").alias("a"), F.col("shingles").alias("xa")), "a")
    inter = F.size(F.array_intersect("xa", "xb"))
    return both.where(100 * inter >= percent * (F.col("na") + F.col("nb") - inter)).select("a", "b").distinct()


def _stars(postings: DataFrame) -> DataFrame:
    """(hub, id): every member of a list beside its hub, of the commonest pairs, then of the smallest document id. Lists with the same hub are one."""
    hubs = postings.groupBy("key").agg(F.min(F.struct(-F.col("weight"), F.col("at"), F.col("id"))).alias("h"), F.count("*").alias("members")).where("members > 1")
    return postings.join(hubs, "key").where("id != h.id").select(F.col("h.id").alias("hub"), "id").distinct()


def _rare_shingle_pairs(members: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(a, b): members of different classes that may be linked, by their rarest shingles and the places of these."""
    held = members.join(sets, "id").select("id", "c", "n", F.explode("shingles").alias("x"))
    common = held.groupBy("x").agg(F.count("*").alias("df")).where("df > 1")
    ordered = held.join(common, "x").groupBy("id", "c", "n").agg(F.sort_array(F.collect_set(F.struct("df", "x"))).alias("xs"))
    alone = F.col("n") - F.size("xs")
    places = F.greatest(F.lit(0), F.floor(F.col("n") * (100 - percent) / 100) + 1 - alone).cast("int")
    posted = ordered.select("id", "c", "n", alone.alias("alone"), F.posexplode(F.slice("xs", 1, places)).alias("p", "v"))
    # A partner of size s needs percent / (100 + percent) * (n + s) shared shingles, of which this is the first.
    largest = F.floor((F.col("n") - F.col("alone") - F.col("p")) * (100 + percent) / percent - F.col("n") + 1e-9)
    posted = posted.select("id", "c", "n", F.col("v.x").alias("x"), largest.alias("largest"))
    return posted.alias("x").join(posted.alias("y"), F.expr("x.x = y.x and x.id < y.id and x.c != y.c and x.n <= y.largest and y.n <= x.largest")).select(
        F.col("x.id").alias("a"), F.col("y.id").alias("b")).distinct()


#: Lists of at most so many members beside the hub are compared in full.
SHORT = 8


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, size: int = SHINGLE, percent: int = SIMILAR_PERCENT,
                    coordinates: int = COORDINATES, least_matches: int = LEAST_MATCHES) -> DataFrame:
    """One row per row of ``docs``: (doc_id, n_shingles, component_id, kept, text_key).

    Documents are linked if 100 * |intersection| >= percent * |union| of their shingle sets; a class is what links
    reach, named by its smallest id, and ``kept`` marks that document. Ids may be of any type that can be ordered. A row
    is a document: different texts under one id are judged apart, and of those of one class and id that with the smallest
    ``text_key`` is kept; rows that repeat id and text are kept together. Null ids come last in a class, and a class of
    such rows alone has a null name. Null and empty texts, and texts without words, have an empty set and are linked with
    nothing. Texts are read whole, of any length. An empty table gives an empty result; other columns are ignored.
    """
    rows = cut(signatures(docs, id_col, text_col, coordinates, size))
    n = rows.count()
    # Equal sets are one node, numbered once and for all by the checkpoint; its first row is where its text is read.
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_key"))
    reps = cut(packed(rows.where("n_shingles > 0").groupBy("set_key").agg(
        first.alias("first"), F.first("n_shingles").alias("n_shingles"), F.first("signature").alias("signature")).withColumn("id", F.monotonically_increasing_id()), n))
    stars = cut(packed(_stars(_postings(reps, least_matches, coordinates)), n))
    ids = stars.select("id").union(stars.select("hub")).distinct().join(reps.select("id", "set_key", "first.doc_id", F.col("first.text_key").alias("key")), "id")
    texts = docs.select(F.col(id_col).alias("at"), text_key(F.col(text_col)).alias("text_key"), F.col(text_col).alias("text"))
    texts = texts.join(bounded(cut(packed(ids, n))), F.expr("at <=> doc_id and text_key = key")).select("id", "text", "set_key")
    sets = cut(_shingle_sets(texts, size))
    links = cut(packed(_linked(stars.select(F.col("hub").alias("a"), F.col("id").alias("b")), reps, sets, least_matches, percent, n), n))
    found = components(links, "a", "b").withColumnRenamed("node", "id")

    members = stars.join(found, "id", "left").select("hub", "id", F.coalesce("component", "id").alias("c"))
    split = members.groupBy("hub").agg(F.min("c").alias("c0"), F.max("c").alias("c1"), F.count("*").alias("members")).where("c0 != c1")
    members = cut(packed(members.join(split.select("hub", "members"), "hub"), n))
    classes = found
    if not members.isEmpty():
        short = members.where(F.col("members") <= SHORT)
        pairs = short.alias("x").join(short.alias("y"), F.expr("x.hub = y.hub and x.id < y.id and x.c != y.c")).select(F.col("x.id").alias("a"), F.col("y.id").alias("b"))
        rest = _rare_shingle_pairs(members.where(F.col("members") > SHORT).select("id", "c").distinct(), sets, percent)
        more = _linked(pairs.union(rest).distinct(), reps, sets, least_matches, percent, n)
        # The first classes are stars already, so the second search starts from them and not from the links.
        classes = components(found.select("id", "component").union(more), "id", "component").withColumnRenamed("node", "id")

    placed = reps.select("set_key", "first", "id").join(classes, "id", "left").select(
        "set_key", "first", F.coalesce("component", "id").alias("class"))
    named = placed.join(placed.groupBy("class").agg(F.min("first").alias("best")), "class").select("set_key", "best")
    empty = F.col("best").isNull()
    return packed(rows.join(named, "set_key", "left"), n).select(
        "doc_id", "n_shingles", F.when(empty, F.col("doc_id")).otherwise(F.col("best.doc_id")).alias("component_id"),
        (empty | (F.col("doc_id").eqNullSafe(F.col("best.doc_id")) & (F.col("text_key") == F.col("best.text_key")))).alias("kept"), "text_key")
