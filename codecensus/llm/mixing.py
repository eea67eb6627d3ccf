"""Mixing sources to target weights by Sainte-Lague apportionment.

Targets come from the sources' weights and sizes. Blocks of equal size are allocated to sources by the highest quotients
target / 1, target / 3, target / 5, ...; each source's blocks are allocated the same way to its shards, and every shard
lays its documents end to end in a seeded order and takes its blocks from there, starting over when it has used all.

Blocks are never rows: how many quotients of a source are surely among the highest follows from bounds on the last
allocated quotient, and only the few quotients between the bounds are ranked.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from codecensus.llm.common import WORD, ranked
from codecensus.session import cut

#: Words in a block, and documents that a shard holds on average.
BLOCK = 16
SHARD_DOCUMENTS = 250
MOST_EPOCHS = 3


def targets(sources: DataFrame, weights: tuple[int, ...] = (1, 2, 3), most: int = MOST_EPOCHS) -> DataFrame:
    """(source, source_size, weight, target) of (source, source_size, number): number is the place in the order of names.

    Every word of the corpus is given out by weight; a source gets at most ``most`` times its size, and what is over is
    given to the others by weight again until no source is above.
    """
    weight = F.get(F.array(*[F.lit(w) for w in weights]), F.pmod("number", F.lit(len(weights))).cast("int")).cast("double")
    # A source of size 0 has reached its limit from the start.
    now = cut(sources.select("source", "source_size", weight.alias("weight"), (F.col("source_size") == 0).alias("full")))
    total = now.agg(F.sum("source_size")).first()[0] or 0
    while True:
        used, open_weight = now.agg(F.sum(F.when(F.col("full"), most * F.col("source_size"))), F.sum(F.when(~F.col("full"), F.col("weight")))).first()
        level = (total - (used or 0)) / open_weight if open_weight else 0.0
        over = ~F.col("full") & (F.col("weight") * level > most * F.col("source_size"))
        if now.where(over).isEmpty():
            break
        now = cut(now.withColumn("full", F.col("full") | over))
    return now.select("source", "source_size", "weight", F.when(F.col("full"), (most * F.col("source_size")).cast("double")).otherwise(F.col("weight") * level).alias("target"))


def apportion(parties: DataFrame, group: list[str], name: str, votes: str, seats: str) -> DataFrame:
    """Adds ``quota``: the seats of each party by Sainte-Lague within its group; equal quotients go to the smaller name.

    With V votes, S parties and N seats in a group the last allocated quotient lies between V / (2N + S) and V / (2N - S),
    so that all above are sure and at most about 2 S remain to be ranked.
    """
    sums = parties.groupBy(*group).agg(F.sum(votes).alias("_v"), F.count("*").alias("_s"), F.max(seats).alias("_n"))
    same = " and ".join(f"p.{g} <=> s.{g}" for g in group) or "true"
    p = parties.alias("p").join(sums.alias("s"), F.expr(same)).select("p.*", "_v", "_s", "_n")
    vote = F.col(votes).cast("double")
    high = F.when(2 * F.col("_n") > F.col("_s"), F.col("_v") / (2 * F.col("_n") - F.col("_s")))
    low = F.col("_v") / (2 * F.col("_n") + F.col("_s"))
    # Quotients vote / (2 k + 1) at or above a bound t: floor((vote / t + 1) / 2); one place of slack for rounding.
    sure = F.greatest(F.lit(0), F.floor((vote / high + 1) / 2) - 1)
    sure = F.when(vote > 0, F.coalesce(sure, F.lit(0))).otherwise(0)
    most = F.when(vote > 0, F.floor((vote / low + 1) / 2) + 1).otherwise(0)
    p = cut(p.withColumn("_sure", sure.cast("long")).withColumn("_most", most.cast("long")))
    asked = p.where("_most > _sure").select(*group, name, vote.alias("_vote"), F.explode(F.sequence("_sure", F.col("_most") - 1)).alias("_k"))
    asked = asked.withColumn("_q", F.col("_vote") / (2 * F.col("_k") + 1))
    order = [F.col(g).asc_nulls_last() for g in group] + [F.desc("_q"), F.col(name).asc_nulls_last()]
    placed = cut(ranked(asked, order, "_place"))
    # Places count over all groups; a group's own begin after the smallest of its places.
    begun = placed.groupBy(*group).agg(F.min("_place").alias("_first"))
    left = p.groupBy(*group).agg((F.max("_n") - F.sum("_sure")).alias("_left"))
    same = lambda a, b, keys: F.expr(" and ".join(f"{a}.{g} <=> {b}.{g}" for g in keys) or "true")
    won = placed.alias("a").join(begun.alias("b"), same("a", "b", group)).join(left.alias("c"), same("a", "c", group)).where("_place - _first < _left")
    won = won.groupBy(*[f"a.{g}" for g in group], f"a.{name}").agg(F.count("*").alias("_won"))
    out = p.alias("p").join(won.alias("w"), same("p", "w", [*group, name]), "left")
    return out.select("p.*", (F.col("_sure") + F.coalesce("_won", F.lit(0))).alias("quota")).drop("_v", "_s", "_n", "_sure", "_most")


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", *, weights: tuple[int, ...] = (1, 2, 3), block: int = BLOCK,
        shard_documents: int = SHARD_DOCUMENTS, most: int = MOST_EPOCHS, seed: int = 5) -> DataFrame:
    """One row per row of ``docs``: (doc_id, source, size, source_size, target, shard, taken).

    Sources in code point order, null last, have the ``weights`` in turn. ``taken`` counts the words the mix takes of a
    document, repeats included, at most ``most`` times its size. Reruns agree: the order in a shard is that of a seeded
    hash, then of the ids; rows equal in id and size are interchangeable. Null and empty texts have size 0 and give
    nothing. An empty table gives an empty result; other columns are ignored.
    """
    rows = cut(docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("long").alias("size")))
    sources = rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("documents"))
    numbered = cut(ranked(sources, [F.col("source").asc_nulls_last()], "number"))
    aimed = targets(numbered, weights, most)
    total = aimed.agg(F.sum("target")).first()[0] or 0.0
    quotas = apportion(aimed.withColumn("seats", F.lit(round(total / block)).cast("long")).withColumn("all", F.lit(1)), ["all"], "source", "target", "seats")
    known = cut(numbered.alias("n").join(quotas.alias("q"), F.expr("n.source <=> q.source")).select(
        "n.source", "n.source_size", "n.documents", "q.target", F.col("q.quota").alias("seats")))
    # Shards by a seeded hash: as many as the source's documents ask for.
    shards = F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.ceil(F.col("k.documents") / shard_documents).cast("long"))
    dealt = rows.alias("r").join(known.alias("k"), F.expr("r.source <=> k.source")).select("r.doc_id", "r.source", "r.size", "k.source_size", "k.target", "k.seats", shards.alias("shard"))
    dealt = cut(dealt)
    by_shard = dealt.groupBy("source", "shard").agg(F.sum("size").alias("shard_size"), F.max("seats").alias("seats"))
    by_shard = apportion(by_shard, ["source"], "shard", "shard_size", "seats").select("source", "shard", "shard_size", "quota")
    order = Window.partitionBy("d.source", "d.shard").orderBy(F.xxhash64("d.doc_id", F.lit(seed + 1)), "d.doc_id", "d.size").rowsBetween(Window.unboundedPreceding, -1)
    laid = dealt.alias("d").join(by_shard.alias("s"), F.expr("d.source <=> s.source and d.shard = s.shard")).select(
        "d.*", "shard_size", F.least(F.col("quota") * block, most * F.col("shard_size")).alias("words"), F.coalesce(F.sum("d.size").over(order), F.lit(0)).alias("start"))
    rounds = F.when(F.col("shard_size") > 0, F.floor(F.col("words") / F.col("shard_size"))).otherwise(0)
    rest = F.col("words") - rounds * F.col("shard_size")
    part = F.greatest(F.lit(0), F.least(F.col("size"), rest - F.col("start")))
    return laid.select("doc_id", "source", "size", "source_size", "target", "shard", (rounds * F.col("size") + part).cast("long").alias("taken"))
