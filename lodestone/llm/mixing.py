"""Mixing sources to target weights: whole repeats plus one hash-seeded Bernoulli copy."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.llm._base import stash


def source_targets(sizes: DataFrame, weights: Sequence[float] = (5, 2, 1), max_repeat: float = 3.0) -> DataFrame:
    """(source, source_size, target) from rows (source, size); one row per source.

    Sources by code point, null last, take the weights in turn. Targets share the total by weight, but none
    passes max_repeat times its source: what is above goes to the others by weight. That fixed point is
    min(cap, weight * level), and the level follows in closed form once sources are ordered by cap / weight,
    so no iteration is needed. The windows without a key run over one row per source, after aggregation.
    A source of size 0 gets target 0; an empty table gives no rows.
    """
    per = sizes.groupBy("source").agg(F.sum("size").cast("long").alias("source_size"))
    turn = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    per = per.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), F.pmod(turn, F.lit(len(weights))) + 1))
    per = per.withColumn("cap", max_repeat * F.col("source_size"))
    whole = Window.partitionBy()
    before = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    zero = F.lit(0.0)
    per = per.withColumn("total", F.sum("source_size").over(whole).cast("double")).withColumn("all_weight", F.sum("weight").over(whole))
    level = (F.col("total") - F.coalesce(F.sum("cap").over(before), zero)) / (F.col("all_weight") - F.coalesce(F.sum("weight").over(before), zero))
    per = per.withColumn("full", F.col("cap") <= level * F.col("weight"))
    held = F.coalesce(F.sum(F.when(F.col("full"), F.col("cap"))).over(whole), zero)
    weight = F.coalesce(F.sum(F.when(~F.col("full"), F.col("weight"))).over(whole), zero)
    target = F.when(F.col("full"), F.col("cap")).otherwise(F.col("weight") * (F.col("total") - held) / weight)
    return per.select("source", "source_size", target.alias("target"))


def coin(seed: int, *keys: Column) -> Column:
    """A number in [0, 1) that depends on seed and keys alone, so reruns and lost executors agree."""
    key = F.concat_ws(":", F.lit(str(seed)), *[F.coalesce(k.cast("string"), F.lit("null")) for k in keys])
    return F.conv(F.substring(F.md5(key), 1, 12), 16, 10).cast("long") / F.lit(float(1 << 48))


def row_key(id_col: str = "doc_id", text_col: str = "text") -> Column:
    """What a row's coin depends on: its id, or its text where it has none, so that rows without an id don't share one coin."""
    return F.coalesce(F.col(id_col).cast("string"), F.concat(F.lit("text:"), F.md5(F.coalesce(F.col(text_col).cast("string"), F.lit("")))))


def mix(docs: DataFrame, size: Column, id_col: str = "doc_id", source_col: str = "source", weights: Sequence[float] = (5, 2, 1), max_repeat: float = 3.0, seed: int = 17) -> DataFrame:
    """docs plus __size, __source_size, __target and __copies: floor(rate), and one more where the coin is below the fraction.

    rate = target / source_size. Rows of equal id share a coin; a null id is a key like any other. Sizes are
    summed map-side per source, so a source with a third of all rows costs one partial row per task. The
    table of targets goes out by broadcast only while its files measure small; beyond that adaptive execution
    splits a skewed source.
    """
    sized = docs.withColumn("__size", size)
    plan = source_targets(sized.select(F.col(source_col).alias("source"), F.col("__size").alias("size")), weights, max_repeat)
    # written first: Spark then knows its size before it plans the join, and texts need no exchange while it is small
    plan = stash(plan.select(F.col("source").alias("__source"), F.col("source_size").alias("__source_size"), F.col("target").alias("__target")), "targets")
    rate = F.when(F.col("__source_size") > 0, F.col("__target") / F.col("__source_size")).otherwise(F.lit(0.0))
    whole = F.floor(rate)
    copies = whole + F.when(coin(seed, F.col(id_col)) < rate - whole, 1).otherwise(0)
    return sized.join(plan, F.col(source_col).eqNullSafe(F.col("__source"))).withColumn("__copies", copies.cast("int")).drop("__source")


def emit(mixed: DataFrame) -> DataFrame:
    """Each row of mix() as often as __copies says, without the plan's columns."""
    rows = mixed.where("__copies > 0").withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("__copies"))))
    return rows.drop("__copy", "__copies", "__size", "__source_size", "__target")
