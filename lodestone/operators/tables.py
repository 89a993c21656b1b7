"""Whole-table operators: duplicates, conflicts, drift, profiles, overlaps."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions.canonical import comparison_text
from lodestone.functions.text import normalize_text


def duplicate_ids(items: DataFrame, key: str = "item_id", order: str = "source_row_index") -> DataFrame:
    """(key, n, first_row) of ids that occur more than once. Only counts and minima are kept, so a hot id needs no list."""
    return items.groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.min(order).alias("first_row")).where("n > 1")


def task_signature(items: DataFrame, task: str = "task") -> Column:
    """SHA-256 over what makes two tasks the same: normalised task, context (names sorted), choices in order, output contract. Columns that
    items don't have, and nulls, count as empty."""
    have = lambda name, use: F.coalesce(use(F.col(name)), F.lit("")) if name in items.columns else F.lit("")
    context = have("context", lambda m: F.array_join(F.transform(F.array_sort(F.map_entries(m)), lambda e: F.concat_ws("=", e["key"], normalize_text(e["value"]))), "\x1e"))
    choices = have("choices", lambda cs: F.array_join(F.transform(cs, normalize_text), "\x1e"))
    return F.sha2(F.concat_ws("\x1f", normalize_text(F.col(task)), context, choices, have("output_contract", normalize_text)), 256)


def duplicate_tasks(items: DataFrame, task: str = "task", gold: str = "gold") -> DataFrame:
    """(signature, n, golds, verdict): groups of equal tasks. More than one raw gold is a conflict, or only a surface difference if
    their comparison forms agree (`canonical.comparison_text`); else the task is a duplicate. Null golds don't count as golds.

    Rows are first folded to one per task and raw gold, so that only those are compared, and a task that a third of all
    rows repeat leaves each task as a few rows.
    """
    pairs = items.select(task_signature(items, task).alias("signature"), F.col(gold).cast("string").alias("g")).groupBy("signature", "g").agg(F.count(F.lit(1)).alias("n"))
    grouped = pairs.withColumn("form", comparison_text(F.col("g"))).groupBy("signature").agg(F.sum("n").alias("n"), F.count("g").alias("golds"), F.count_distinct("form").alias("forms"))
    verdict = F.when((F.col("golds") > 1) & (F.col("forms") > 1), "conflicting_duplicate_oracle").when(F.col("golds") > 1, "surface_only_review").otherwise("duplicate_task")
    return grouped.where("n > 1").select("signature", "n", "golds", verdict.alias("verdict"))


def coverage(items: DataFrame) -> DataFrame:
    """item_id and which artifacts are present. A gold counts as present unless null or empty text."""
    some = lambda c: F.coalesce(F.trim(c) != "", F.lit(False))
    flags = {"has_task": some(F.col("task")), "has_gold": F.col("gold").isNotNull() & (F.col("gold") != ""), "has_choices": F.size("choices") > 0, "has_contract": some(F.col("output_contract")), "has_evaluator": some(F.col("evaluator"))}
    return items.select("item_id", *[F.coalesce(v, F.lit(False)).alias(k) for k, v in flags.items()])


def drift(covered: DataFrame, min_rows: int = 5, min_share: float = 0.02) -> DataFrame:
    """(pattern, n, share, is_mode, drifts): patterns of presence flags; others than the most frequent drift from min_share on."""
    flags = [c for c in covered.columns if c.startswith("has_")]
    counts = covered.groupBy(F.concat(*[F.col(c).cast("int").cast("string") for c in flags]).alias("pattern")).agg(F.count(F.lit(1)).alias("n"))
    whole = Window.partitionBy()
    share = F.col("n") / F.sum("n").over(whole)
    mode = F.row_number().over(Window.orderBy(F.desc("n"), "pattern")) == 1
    return counts.select("pattern", "n", share.alias("share"), mode.alias("is_mode"), (~mode & (share >= min_share) & (F.sum("n").over(whole) >= min_rows)).alias("drifts"))


def field_coverage(rows: DataFrame, candidates: Sequence[str]) -> DataFrame:
    """(field, present, numeric) shares for each candidate field, in one pass."""
    some = lambda c: (F.coalesce(F.trim(F.col(c).cast("string")), F.lit("")) != "").cast("int")
    aggs = [F.struct(F.lit(c).alias("field"), F.avg(some(c)).alias("present"), F.avg(F.col(c).cast("string").try_cast("double").isNotNull().cast("int")).alias("numeric")) for c in candidates]
    return rows.agg(F.array(*aggs).alias("a")).select(F.explode("a").alias("a")).select("a.*")


def json_paths(rows: DataFrame, column: str, depth: int = 2) -> DataFrame:
    """(path, type, n): paths of JSON objects up to `depth` levels, by type, with counts."""
    level = rows.select(F.lit("$").alias("path"), F.try_parse_json(column).alias("v")).where("v is not null")
    out = None
    for _ in range(depth):
        level.createOrReplaceTempView("__json_level")
        level = rows.sparkSession.sql("SELECT concat(path, '.', e.key) AS path, e.value AS v FROM __json_level, LATERAL variant_explode(v) AS e WHERE e.key IS NOT NULL AND schema_of_variant(v) LIKE 'OBJECT%'")
        kind = F.regexp_replace(F.schema_of_variant("v"), r"[<(].*$", "")
        part = level.select("path", kind.alias("type"))
        out = part if out is None else out.unionByName(part)
    return out.groupBy("path", "type").agg(F.count(F.lit(1)).alias("n"))


def contained(items: DataFrame, documents: DataFrame, gram: int = 5) -> DataFrame:
    """(doc_id, item_id) where an item's text is in a document's, ignoring case and white space.

    Items and documents meet on hashes of the item's rarest start: every run of `gram` words of a document is joined
    with the first run of each item, and what meets is verified. Items of fewer words than `gram` are compared on what
    they have. Documents aren't paired with items that share no run.
    """
    words = lambda c: F.filter(F.split(normalize_text(c), " "), lambda w: w != "")
    it = items.select("item_id", words(F.col("text")).alias("w")).where("size(w) > 0")
    it = it.select("item_id", F.array_join("w", " ").alias("whole"), F.least(F.size("w"), F.lit(gram)).alias("k"), F.xxhash64(F.array_join(F.slice("w", 1, gram), " ")).alias("h"))
    sizes = [r["k"] for r in it.select("k").distinct().collect()] or [gram]
    docs = documents.select("doc_id", words(F.col("text")).alias("w"))
    starts = lambda k: F.transform(F.sequence(F.lit(1), F.size("w") - k + 1), lambda i: F.xxhash64(F.array_join(F.slice("w", i, k), " ")))
    grams = F.flatten(F.array(*[F.when(F.size("w") >= k, starts(k)).otherwise(F.array().cast("array<bigint>")) for k in sizes]))
    met = docs.select("doc_id", F.explode(F.array_distinct(grams)).alias("h")).join(it, "h").select("doc_id", "item_id", "whole").distinct()
    text = documents.select("doc_id", F.concat(F.lit(" "), normalize_text(F.col("text")), F.lit(" ")).alias("t"))
    return met.join(text, "doc_id").where(F.contains("t", F.concat(F.lit(" "), F.col("whole"), F.lit(" ")))).select("doc_id", "item_id").distinct()


def nearest(left: DataFrame, right: DataFrame, key: str, distance: Column, most: int = 3) -> DataFrame:
    """Rows of left with the right rows of equal key at the least distance, at most `most` of them by name."""
    joined = left.join(right, key).withColumn("distance", distance)
    least = F.min("distance").over(Window.partitionBy("left_id"))
    ranked = joined.withColumn("least", least).where("distance = least").withColumn("n", F.row_number().over(Window.partitionBy("left_id").orderBy("right_id")))
    return ranked.where(F.col("n") <= most).select("left_id", "right_id", "distance")
