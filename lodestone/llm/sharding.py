"""Sharding by a hypergeometric communication matrix: a uniform shuffle with exact shard sizes."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: numpy's exact samplers stop here; `draw` goes on.
EXACT = 1_000_000_000
#: The matrix has at most so many rows and columns, however large the table; it is all that the driver holds.
MOST_PARTS, MOST_BLOCKS = 512, 1024


def capacities(rows: int, parts: int) -> np.ndarray:
    """Sizes at most one apart that add up to rows."""
    return np.full(parts, rows // parts, dtype=np.int64) + (np.arange(parts) < rows % parts)


def draw(rng: np.random.Generator, good: int, bad: int, n: int) -> int:
    """A hypergeometric number: of n drawn from good + bad, how many are good. By inversion around the mode, where
    neighbouring probabilities stand in a known ratio; what lies over 12 standard deviations away weighs less than 1e-30."""
    low, high = max(0, n - bad), min(good, n)
    if low == high:
        return low
    total = good + bad
    mode = min(max((n + 1) * (good + 1) // (total + 2), low), high)
    reach = int(12 * (n * (good / total) * (bad / total) * ((total - n) / max(1, total - 1))) ** 0.5) + 40
    first = max(low, mode - reach)
    k = np.arange(first, min(high, mode + reach), dtype=np.float64)
    log = np.concatenate([[0.0], np.cumsum(np.log(good - k) + np.log(n - k) - np.log(k + 1) - np.log(bad - n + k + 1))])
    below = np.cumsum(np.exp(log - log.max()))
    return first + int(np.searchsorted(below, rng.random() * below[-1], "right"))


def communication_matrix(counts: Sequence[int], sizes: Sequence[int], seed: int) -> np.ndarray:
    """m[p, s]: rows that partition p sends to shard s. Row sums are counts, column sums are sizes, and the
    law is that of cutting a uniform permutation of all rows, drawn one margin at a time."""
    rng = np.random.Generator(np.random.Philox(seed))
    left = np.asarray(sizes, dtype=np.int64).copy()
    out = np.zeros((len(counts), len(left)), dtype=np.int64)
    for p, n in enumerate(counts):
        if left.sum() < EXACT:
            out[p] = rng.multivariate_hypergeometric(left, int(n), method="marginals")
        else:
            rest, need = int(left.sum()), int(n)
            for s, good in enumerate(map(int, left)):
                rest -= good
                out[p, s] = take = draw(rng, good, rest, need)
                need -= take
        left -= out[p]
    return out


def _ranked(rows: DataFrame, group: str, order: list, by: Column, bits: int, name: str) -> DataFrame:
    """rows plus `name`, the place from 1 of each in its group by (by, order). A group of any size is cut by the first
    `bits` bits of `by`, so a task orders one piece; the pieces' sizes, one number each, give where it begins."""
    own = [f"{name}_piece", f"{name}_base"]
    cut = rows.withColumn(own[0], F.shiftrightunsigned(by, 64 - bits) if bits else F.lit(0).cast("long"))
    sizes = cut.groupBy(group, own[0]).agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy(group).orderBy(own[0]).rowsBetween(Window.unboundedPreceding, -1)
    base = sizes.select(group, own[0], F.coalesce(F.sum("n").over(before), F.lit(0)).alias(own[1]))
    within = F.row_number().over(Window.partitionBy(group, own[0]).orderBy(by, *order))
    return cut.withColumn(name, within).join(base, [group, own[0]]).withColumn(name, (F.col(name) + F.col(own[1])).cast("long")).drop(*own)


def shard_rows(docs: DataFrame, keys: Sequence[str], n_shards: int = 40, seed: int = 23, rows_per_task: int = 8192) -> DataFrame:
    """docs plus shard (0 to n_shards - 1) and slot (gapless from 0 in each shard); shard sizes are at most one apart.

    1. Logical partitions are fixed by a hash of the keys, not by where rows happen to lie, so that a retried
       task sends the same rows to the same places.
    2. Their row counts, MOST_PARTS at most, go to the driver, which draws how many rows each sends to each of at most
       MOST_BLOCKS blocks of the shards.
    3. Each partition permutes its rows by a keyed hash and deals them out by the matrix's running sums.
    4. Each block permutes again; its first slot is known from the sizes alone.
    Partitions and blocks are ordered in pieces of about rows_per_task rows, so tasks don't grow with the table.
    Rows of equal keys are interchangeable and lie in one piece; ties break by the keys. Null keys count as a key. Columns
    named shard or slot in docs are replaced. An empty table gives no rows.
    """
    spark = docs.sparkSession
    docs = docs.drop("shard", "slot")
    keys = [k for k in keys if k not in ("shard", "slot")]
    free = "__deal"
    while any(c.startswith(free) for c in docs.columns):
        free += "_"
    p, ends_of, n, block = (f"{free}{x}" for x in ("part", "ends", "n", "block"))
    part_of = lambda parts: F.pmod(F.xxhash64(F.lit(seed), *keys), F.lit(parts)).cast("int")
    fine = docs.groupBy(part_of(MOST_PARTS).alias("p")).count().collect()
    total = sum(r["count"] for r in fine)
    parts = min(MOST_PARTS, 1 << max(3, -(-total // rows_per_task) - 1).bit_length())  # divides MOST_PARTS, so counts add up
    counts = np.zeros(parts, dtype=np.int64)
    for r in fine:
        counts[r["p"] % parts] += r["count"]
    per_shard = max(1, min(-(-total // (n_shards * rows_per_task)), MOST_BLOCKS // n_shards))
    bits = lambda groups: max(0, -(-total // (groups * rows_per_task)) - 1).bit_length()
    blocks = np.concatenate([capacities(int(size), per_shard) for size in capacities(total, n_shards)])
    ends = communication_matrix(counts, blocks, seed).cumsum(axis=1)
    first = np.concatenate([np.concatenate([[0], x.cumsum()[:-1]]) for x in blocks.reshape(n_shards, per_shard)])
    plan = spark.createDataFrame([(i, e.tolist()) for i, e in enumerate(ends)], T.StructType([T.StructField(p, T.IntegerType()), T.StructField(ends_of, T.ArrayType(T.LongType()))]))
    again = [F.col(k).asc_nulls_first() for k in keys]
    dealt = _ranked(docs.withColumn(p, part_of(parts)), p, again, F.xxhash64(F.lit(seed + 1), *keys), bits(parts), n).join(F.broadcast(plan), p)
    dealt = dealt.withColumn(block, F.size(F.filter(ends_of, lambda e: e < F.col(n)))).drop(ends_of, n, p)
    out = _ranked(dealt, block, again, F.xxhash64(F.lit(seed + 2), *keys), bits(len(blocks)), n)
    at = F.element_at(F.array(*[F.lit(int(x)) for x in first]), F.col(block) + 1)
    return out.withColumn("shard", F.floor(F.col(block) / per_shard).cast("int")).withColumn("slot", (F.col(n) - 1 + at).cast("long")).drop(block, n)
