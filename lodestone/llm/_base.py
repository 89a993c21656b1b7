"""Shared plumbing of the training-data operators: scratch tables and connected components."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from pathlib import Path

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words are maximal runs of anything but ASCII white space; bytes.split() cuts at the same six bytes.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ship(spark: SparkSession) -> None:
    """Gives Python workers this package, unless the environment they inherit has it."""
    sc = spark.sparkContext
    package = Path(__file__).resolve().parent.parent
    inherited = [Path(p).resolve() for p in os.environ.get("PYTHONPATH", "").split(os.pathsep) if p]
    if package.parent in inherited or getattr(sc, "_lodestone_shipped", False):
        return
    path = f"{tempfile.mkdtemp(prefix='lodestone-')}/{package.name}.zip"  # Spark serves it from there
    with zipfile.ZipFile(path, "w") as z:
        for f in sorted(package.rglob("*.py")):
            z.write(f, f.relative_to(package.parent))
    sc.addPyFile(path)
    sc._lodestone_shipped = True


def checkpoint_root(spark: SparkSession) -> str:
    """The shared folder of the cluster; only a local session may fall back to one of its own."""
    root = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if root:
        return root
    own = getattr(spark.sparkContext, "_lodestone_scratch", None)
    if own is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        own = spark.sparkContext._lodestone_scratch = "file://" + tempfile.mkdtemp(prefix="lodestone-")
    return own


def stash(df: DataFrame, name: str) -> DataFrame:
    """Cuts lineage: writes the rows to the shared folder as Parquet and reads them back.

    The table lives until the folder is emptied, as lazy results may still refer to it.
    """
    spark = df.sparkSession
    path = f"{checkpoint_root(spark)}/lodestone/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def word_count(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)).cast("long")


def text_bytes(batch: pa.RecordBatch, column: str) -> list[bytes]:
    """UTF-8 of a string column, null as empty."""
    return [x or b"" for x in batch.column(column).cast(pa.large_binary()).to_pylist()]


def slices(batches: Iterator[pa.RecordBatch], text: str, max_bytes: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about max_bytes of text, one row at least."""
    for batch in batches:
        start = held = 0
        if batch.nbytes <= max_bytes:
            yield batch
            continue
        for i, size in enumerate(pc.binary_length(batch.column(text)).fill_null(0).to_pylist()):
            if held and held + size > max_bytes:
                yield batch.slice(start, i - start)
                start, held = i, 0
            held += size
        yield batch.slice(start)


#: A key with over one in HUBS of all rows counts as a hub; there are fewer than HUBS of them, whatever the data.
HUBS, SALTS = 1000, 32


def hubs(df: DataFrame, key: str) -> list:
    """The keys that hold a large share of the rows: fewer than HUBS, whatever the data."""
    total = df.count()
    counts = df.where(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("__rows"))
    return [r[0] for r in counts.where(F.col("__rows") * HUBS > max(total, HUBS)).select(key).collect()] if total else []


def salted_join(big: DataFrame, small: DataFrame, key: str, counted: DataFrame | None = None) -> DataFrame:
    """Inner join on key, where rows of big that share a hub key go to SALTS tasks and their row of small to each of them.
    `counted` has the keys of big in a smaller table, if there is one. Hubs are looked for now, so that the join of a table without
    any (most have none) stays a plain one, and its plan small."""
    hot = hubs(big if counted is None else counted, key)
    if not hot:
        return big.join(small, key)
    salts = F.when(F.col(key).isin(hot), SALTS).otherwise(1)  # fewer than HUBS values, so that neither side is joined with a table of them
    left = big.withColumn("__salt", F.pmod(F.xxhash64(*big.columns), salts).cast("int"))
    right = small.withColumn("__salt", F.explode(F.sequence(F.lit(0), salts - 1)))
    return left.join(right, [key, "__salt"]).drop("__salt")


def connected_components(edges: DataFrame, left: str = "a", right: str = "b", max_rounds: int = 40) -> DataFrame:
    """(node, root) for each node of an undirected graph of longs; root is the smallest node reachable.

    Alternates the large-star and small-star steps until the edge set stays the same. Each step is one
    grouped minimum and one join, in which a node with a large share of all edges is spread over tasks.
    Edge sets go to the shared folder after each round.
    Self-loops and null ends are ignored; an empty graph gives no rows.
    """
    e = edges.select(F.greatest(left, right).alias("u"), F.least(left, right).alias("v"))
    e = stash(e.where("u is not null and v is not null and u <> v").distinct(), "edges")
    seen = None
    for _ in range(max_rounds):
        now = e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == seen or not now[0]:
            break
        seen = now
        both = e.union(e.select("v", "u"))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = salted_join(both, least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = stash(large.where("u <> v").distinct(), "edges")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = salted_join(large, least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        e = stash(small.union(least).distinct(), "edges")
    else:
        raise RuntimeError("components did not settle")
    return e.select(F.col("u").alias("node"), F.col("v").alias("root")).union(e.select("v", "v").distinct())
