"""Corpus pipeline: language identification, line dedup, near-dedup, decontamination, mixing.

Each stage takes (spark, docs, sf_dir) and returns what it keeps of ``docs``; ``run`` writes each result as Parquet to the
shared folder and reads it again for the next stage. All stages but the last return the columns of ``docs``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from codecensus.llm.decontaminate import leaks
from codecensus.llm.language_id import Model, held_out, language, learn
from codecensus.llm.line_dedup import dedup_lines
from codecensus.llm.minhash_dedup import near_duplicates, text_key
from codecensus.llm.mixing import mix
from codecensus.llm.native import bounded
from codecensus.session import cut, stored

#: Letters per phrase under which a text is in none of the learned languages: nearly every letter is a phrase of its own.
LEAST_PHRASE = 1.5
#: Longer texts are held to a part of what nine in ten held-out texts of their language reach; copies of taught texts do not move that.
JUDGED_LETTERS, LIMIT_QUANTILE, LIMIT_PART = 100, 0.1, 0.45


#: Rows that go to a Python worker at a time; texts are long, and executors hold two workers beside the heap.
BATCH_ROWS = 1000


def _small_batches(spark: SparkSession) -> None:
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= BATCH_ROWS:
        spark.conf.set(name, str(BATCH_ROWS))


def phrase_limits(model: Model, docs: DataFrame) -> DataFrame:
    """(of, least): letters per phrase that a text of a language must have, from the labelled texts that taught nothing."""
    known = docs.where(held_out(F.col("doc_id")) & F.col("lang").isNotNull()).select(F.col("lang"), language(model, F.col("text")).alias("found"))
    told = known.where("found.lang_pred = lang and found.n_letters >= %d" % JUDGED_LETTERS)
    least = F.greatest(F.lit(LEAST_PHRASE), LIMIT_PART * F.percentile_approx("found.phrase_length", LIMIT_QUANTILE, 10_000))
    return cut(told.groupBy(F.col("lang").alias("of")).agg(least.alias("least")))


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents without a letter and those that fit no learned language. Without any label nothing is learned and all stay.

    A null or empty text has no letter. A text of 100 letters or more must have about half the letters per phrase that held-out texts
    of its language have (see ``phrase_limits``), a shorter one ``LEAST_PHRASE``. Rows are judged one by one, so repeated
    rows fare alike; ids may be null; all columns stay as they are, whatever their names; texts are read whole.
    """
    _small_batches(spark)
    model = learn(docs.where(~held_out(F.col("doc_id"))))
    if not model.languages:
        return docs
    limits = F.broadcast(phrase_limits(model, docs))  # a row for each learned language
    known = docs.select(F.struct("*").alias("d"), language(model, F.col("text")).alias("found")).join(limits, F.expr("found.lang_pred = of"), "left")
    least = F.when(F.col("found.n_letters") >= JUDGED_LETTERS, F.coalesce("least", F.lit(LEAST_PHRASE))).otherwise(LEAST_PHRASE)
    return known.where((F.col("found.lang_pred") != "und") & (F.col("found.phrase_length") >= least)).select("d.*")


def drop_boilerplate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops boilerplate lines from texts and sets ``n_chars`` of these anew; no document goes.

    Equal and nearly equal documents count as one page when the pages of a line are counted, so that a group of copies
    does not make its own text boilerplate; what is boilerplate is then dropped from every document. Null texts stay null
    and a text of boilerplate alone becomes empty; null sources are one host; other columns stay, whatever their names.
    """
    _small_batches(spark)
    copies = near_duplicates(docs).where(~F.col("kept")).select("doc_id", "text_key").distinct()
    lines = dedup_lines(docs.select(F.struct("*").alias("whole"), "doc_id", "text", "source"), uncounted=cut(copies))
    changed = {"text": F.col("text")}
    if "n_chars" in docs.columns:
        changed["n_chars"] = F.when(F.col("_n_dropped") > 0, F.length("text")).otherwise(F.col("whole")["n_chars"]).cast(docs.schema["n_chars"].dataType)
    return lines.select(*[changed.get(c, F.col("whole")[c]).alias(c) for c in docs.columns])


def keep_one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of every class of near-duplicates, that with the smallest id, and one of rows that repeat id and text.

    Documents without words are linked with nothing and stay, those with a null id all of them. Different texts of one id
    are documents of their own. Of repeated rows the first in the order of their columns written as JSON stays. Other
    columns stay, whatever their names. The result is the same on every run.
    """
    _small_batches(spark)
    found = cut(near_duplicates(docs).select("doc_id", "text_key", "kept", "n_shingles"))
    gone = found.where(~F.col("kept")).select(F.col("doc_id").alias("i"), F.col("text_key").alias("k")).distinct()
    same = found.where(F.col("kept") & (F.col("doc_id").isNotNull() | (F.col("n_shingles") > 0))).groupBy(F.col("doc_id").alias("i"), F.col("text_key").alias("k"))
    repeated = cut(same.count().where("count > 1").select("i", "k"))
    rows = docs.select(F.struct("*").alias("d"), text_key(F.col("text")).alias("key"))
    of = F.expr("d.doc_id <=> i and key = k")
    # Texts of rows that occur once are not moved.
    single = rows.join(bounded(cut(gone.union(repeated))), of, "left_anti").select("d")
    one = rows.join(bounded(repeated), of, "left_semi").groupBy(F.col("d.doc_id"), "key").agg(F.min_by("d", F.to_json("d")).alias("d")).select("d")
    return single.union(one).select("d.*")


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents that hold a benchmark item; see ``leaks``.

    Null and empty texts hold nothing and stay. Rows of one id fare alike: they go if one of them holds an item. Without
    items all stay. Other columns stay, whatever their names.
    """
    found = cut(leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).select(F.col("doc_id").alias("i")).distinct())
    return docs.select(F.struct("*").alias("d")).join(bounded(found), F.expr("d.doc_id <=> i"), "left_anti").select("d.*")


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """How many words of each document the mix takes, by id; see ``mix``, which says what becomes of nulls, ties and repeated rows."""
    return mix(docs)


STAGES = [
    ("language_id", identify_language),
    ("line_dedup", drop_boilerplate),
    ("minhash_near_dedup", keep_one_of_each),
    ("benchmark_decontamination", decontaminate),
    ("mixing", mix_sources),
]

#: The first stage is a fitted model and the last a seeded choice, which SQL cannot express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = stored(docs)
    return docs
