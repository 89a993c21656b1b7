"""A corpus in five stages; each reads what the one before it wrote."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestone.llm import decontam, mixing, sharding, simhash, toxicity
from lodestone.llm._base import salted_join, stash, table, word_count

TOXIC = 0.3
SHARDS = 40


def _apart(docs: DataFrame, taken: Sequence[str], work: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """work(docs) with the columns of docs, where those that have one of the names `taken` go by another name meanwhile."""
    names = {}
    for c in docs.columns:
        new = c
        while new in taken or new in names.values():
            new = f"own_{new}"
        names[c] = new
    done = work(docs.toDF(*names.values()))
    return done.select(*[F.col(new).alias(c) for c, new in names.items()])


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose worst window scores TOXIC or more go; the model learns from `labels` and the raw documents.
    Null and empty texts are scored as empty ones; rows stand alone, so ids and ties don't matter."""
    held = F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(4)) == 2
    model = toxicity.fit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels").where(~held))
    return _apart(docs, ["score"], lambda d: toxicity.score_column(d, model).where(F.col("score") < TOXIC))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Near copies are texts whose five-word shingles are alike by 0.8 or more. Of each class the row of the smallest
    doc_id stays (rows without an id come last; ties go by the text's hash, then by the other columns)."""

    def work(d: DataFrame) -> DataFrame:
        roots = simhash.near_copies(d)
        tid = F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit("")))
        rows = stash(d.select("doc_id", tid.alias("tid")).groupBy("doc_id", "tid").agg(F.count(F.lit(1)).alias("n")), "ids")
        best = salted_join(rows, roots, "tid").groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "tid", "n")).alias("b"))
        best = stash(best.select(F.col("b.tid").alias("__tid"), F.col("b.doc_id").alias("__id"), F.col("b.n").alias("__n")), "kept")
        same = (tid == F.col("__tid")) & F.col("doc_id").eqNullSafe(F.col("__id"))
        once = d.join(best.where("__n = 1"), same).select(*d.columns)
        order = Window.partitionBy("__tid").orderBy(*[c for c in d.columns if c not in ("doc_id", "text")] or ["doc_id"])
        often = d.join(best.where("__n > 1"), same).withColumn("__n", F.row_number().over(order)).where("__n = 1")
        return once.union(often.select(*d.columns))

    return _apart(docs, ["__tid", "__id", "__n"], work)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go, whatever their id: a text's hash stands for it."""
    hashed = docs.select(F.xxhash64("text").alias("doc_id"), "text")
    found = stash(decontam.leaks(hashed, table(spark, sf_dir, "benchmark")).select(F.col("doc_id").alias("__text")).distinct(), "leaks")
    return _apart(docs, ["__text"], lambda d: d.join(found, F.xxhash64("text") == F.col("__text"), "left_anti"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeat or go as their source's target asks; sizes are words. Rows without an id draw by their text."""
    taken = ["__key", "__size", "__source", "__source_size", "__target", "__copies", "__copy"]
    return _apart(docs, taken, lambda d: mixing.emit(mixing.mix(d.withColumn("__key", mixing.row_key()), word_count(F.col("text")), id_col="__key")))


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with shard and slot, in shards at most one row apart; columns of those names are replaced."""
    return sharding.shard_rows(docs, docs.columns, SHARDS)


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_copies),
    ("decontamination", drop_leaks),
    ("mixing", mix_sources),
    ("sharding", shard),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = stash(docs, name)
    return docs
