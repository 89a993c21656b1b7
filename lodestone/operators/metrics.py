"""Comparison with labels, injected defects, sampling and resampling."""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestone.functions.stats import hash_order, hash_unit, poisson_weight, ratio


def confusion(predicted: DataFrame, truth: DataFrame, key: str = "item_id", by: str | None = None) -> DataFrame:
    """TP, FP, FN, precision, recall and F1 (0 where undefined) from two sets of keys, one full outer join on distinct keys.
    With `by`, a column of truth, one row per value of it."""
    p = predicted.select(key).distinct().withColumn("p", F.lit(1))
    keep = [key] + ([by] if by else [])
    t = truth.select(*keep).distinct().withColumn("t", F.lit(1))
    both = p.join(t, key, "full_outer")
    cells = {"tp": "p = 1 and t = 1", "fp": "p = 1 and t is null", "fn": "p is null and t = 1"}
    m = (both.groupBy(by) if by else both.groupBy()).agg(*[F.count_if(F.expr(v)).alias(k) for k, v in cells.items()])
    m = m.withColumn("precision", ratio(F.col("tp"), F.col("tp") + F.col("fp"))).withColumn("recall", ratio(F.col("tp"), F.col("tp") + F.col("fn")))
    return m.withColumn("f1", ratio(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))


def review_budget(ranked: DataFrame, truth: DataFrame, shares: tuple[int, ...] = (5, 10, 20)) -> DataFrame:
    """(share, reviewed, found, recall): what reviewing the riskiest share of items finds. ranked: item_id, tier, risk."""
    hit = ranked.join(truth.select("item_id").distinct().withColumn("t", F.lit(1)), "item_id", "left").select("item_id", F.when(F.col("tier") == "priority", 0).otherwise(1).alias("tier"), "risk", F.coalesce("t", F.lit(0)).alias("t"))
    total = truth.select("item_id").distinct().agg(F.count(F.lit(1)).alias("total"))
    # places come from counts per (tier, risk), few values, and from the order inside each of them
    groups = hit.groupBy("tier", "risk").agg(F.count(F.lit(1)).alias("c"))
    before = F.coalesce(F.sum("c").over(Window.orderBy("tier", F.desc("risk")).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    groups = groups.select("tier", "risk", before.alias("before"), F.sum("c").over(Window.partitionBy()).alias("n"))
    inside = F.row_number().over(Window.partitionBy("tier", "risk").orderBy("item_id"))
    placed = hit.withColumn("inside", inside).join(groups, ["tier", "risk"]).select((F.col("before") + F.col("inside")).alias("place"), "n", "t")
    cut = placed.select("place", "n", "t", F.explode(F.array(*[F.lit(s) for s in shares])).alias("share")).where(F.col("place") <= F.greatest(F.lit(1), F.ceil(F.col("n") * F.col("share") / 100)))
    per = cut.groupBy("share").agg(F.count(F.lit(1)).alias("reviewed"), F.sum("t").alias("found"))
    return per.join(F.broadcast(total)).select("share", "reviewed", "found", ratio(F.col("found"), F.col("total")).alias("recall"))


MUTATIONS = ("remove_task", "remove_gold", "wrong_gold", "duplicate_choice", "remove_evaluator")
#: The defect that each mutation must bring to light.
EXPECTED = {"remove_task": "missing_task", "remove_gold": "missing_oracle", "wrong_gold": "invalid_choice_gold", "duplicate_choice": "duplicate_choices", "remove_evaluator": "missing_evaluator"}


def inject(items: DataFrame, per_item: int = 2, seed: int = 20260713) -> DataFrame:
    """Mutants of items: up to per_item applicable mutations each, in hash order, with item_id <source>__mut_<operator>,
    operator, expected_defect and hashes before and after."""
    ops = F.array(*[F.lit(o) for o in MUTATIONS])
    can = F.filter(ops, lambda o: F.when(o == "remove_task", F.trim("task") != "").when(o == "remove_gold", F.col("gold").isNotNull()).when(o.isin("wrong_gold", "duplicate_choice"), (F.size("choices") > 1) & F.col("gold").isNotNull()).otherwise(F.trim("evaluator") != ""))
    placed = F.transform(can, lambda o: F.struct(F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("item_id"), o)).alias("h"), o.alias("o")))
    chosen = F.transform(F.slice(F.array_sort(placed), 1, per_item), lambda x: x["o"])
    rows = items.withColumn("operator", F.explode(chosen))
    is_op = lambda o: F.col("operator") == o
    before = F.sha2(F.to_json(F.struct("task", "gold", "choices", "evaluator")), 256)
    rows = rows.withColumn("before_sha256", before).withColumn("source_id", F.col("item_id")).withColumn("item_id", F.concat("item_id", F.lit("__mut_"), "operator"))
    rows = rows.withColumn("task", F.when(is_op("remove_task"), "").otherwise(F.col("task")))
    rows = rows.withColumn("gold", F.when(is_op("remove_gold"), F.lit(None)).when(is_op("wrong_gold"), F.lit("Z?")).otherwise(F.col("gold")))
    rows = rows.withColumn("choices", F.when(is_op("duplicate_choice"), F.array_append("choices", F.get("choices", F.lit(0)))).otherwise(F.col("choices")))
    rows = rows.withColumn("evaluator", F.when(is_op("remove_evaluator"), "").otherwise(F.col("evaluator")))
    table = F.create_map(*[F.lit(x) for kv in EXPECTED.items() for x in kv])
    return rows.withColumn("after_sha256", F.sha2(F.to_json(F.struct("task", "gold", "choices", "evaluator")), 256)).withColumn("expected_defect", F.element_at(table, F.col("operator")))


def injected_recall(mutants: DataFrame, findings: DataFrame) -> DataFrame:
    """(operator, expected, hits, recall) per operator and, with null, in all: exact hits of item and defect."""
    want = mutants.select("item_id", "operator", F.col("expected_defect").alias("defect_type"))
    hit = findings.select("item_id", "defect_type").distinct().withColumn("hit", F.lit(1))
    rows = want.join(hit, ["item_id", "defect_type"], "left")
    return rows.rollup("operator").agg(F.count(F.lit(1)).alias("expected"), F.count("hit").alias("hits")).withColumn("recall", ratio(F.col("hits"), F.col("expected")))


def stratified_sample(items: DataFrame, size: int, strata: tuple[str, ...], seed: int, key: str = "item_id") -> DataFrame:
    """size rows, dealt round-robin over strata in hash order: (key, strata, place)."""
    turn = F.row_number().over(Window.partitionBy(*strata).orderBy(hash_order(seed, key), key))
    picked = items.select(key, *strata).withColumn("turn", turn)
    place = F.row_number().over(Window.orderBy("turn", *strata))
    # each stratum gives at most `size` rows, so what the last window orders is bounded by size times strata
    return picked.where(F.col("turn") <= size).withColumn("place", place).where(F.col("place") <= size).drop("turn")


def balanced_folds(items: DataFrame, group: str, folds: int) -> DataFrame:
    """(group, n, fold): whole groups to folds; the largest group first, ties by name, each to the fold that holds least, ties to the
    smaller number. A null group is a group of its own and comes last among equals.

    Each step needs the one before, so the groups' counts (not their rows) pass through one task, in order, which holds a
    heap of `folds` sums.
    """
    per = items.groupBy(group).agg(F.count(F.lit(1)).alias("n"))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        heap = [(0, i) for i in range(folds)]
        for batch in batches:
            chosen = []
            for n in batch.column("n").to_pylist():
                held, fold = heap[0]
                heapq.heapreplace(heap, (held + n, fold))
                chosen.append(fold)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(chosen, pa.int32())], [*batch.schema.names, "fold"])

    ordered = per.repartition(1).sortWithinPartitions(F.desc("n"), F.asc_nulls_last(group))
    return ordered.mapInArrow(deal, T.StructType([*per.schema.fields, T.StructField("fold", T.IntegerType())]))


def bootstrap_mean(rows: DataFrame, key: str, value: str, draws: int, seed: int) -> DataFrame:
    """(lo, mean, hi): 95 % interval of a mean by a Poisson bootstrap whose weights follow from hashes of draw and key.

    Each row is weighed for all draws at once and sums leave each task as `draws` numbers, so nothing is replicated
    across the network.
    """
    d = rows.select(key, value, F.explode(F.sequence(F.lit(1), F.lit(draws))).alias("draw"))
    w = poisson_weight(hash_unit(seed, F.col("draw"), F.col(key)))
    per = d.groupBy("draw").agg((F.sum(w * F.col(value)) / F.sum(w)).alias("m"))
    mean = rows.agg(F.avg(value).alias("mean"))
    bounds = per.agg(F.percentile("m", F.lit(0.025)).alias("lo"), F.percentile("m", F.lit(0.975)).alias("hi"))
    return bounds.join(F.broadcast(mean)).select("lo", "mean", "hi")


def permutation_p(rows: DataFrame, key: str, group: str, value: str, draws: int, seed: int) -> DataFrame:
    """(observed, ge, p): add-one p of the difference of means between group 1 and the rest, under relabelling by hash order.

    A draw labels each row 1 with the chance of the observed share, by a coin of draw and key.
    """
    seen = rows.agg(F.avg(F.when(F.col(group) == 1, F.col(value))).alias("a"), F.avg(F.when(F.col(group) != 1, F.col(value))).alias("b"), F.avg(group).alias("share"))
    d = rows.select(key, value, F.explode(F.sequence(F.lit(1), F.lit(draws))).alias("draw")).join(F.broadcast(seen))
    one = hash_unit(seed, F.col("draw"), F.col(key)) < F.col("share")
    per = d.groupBy("draw").agg((F.avg(F.when(one, F.col(value))) - F.avg(F.when(~one, F.col(value)))).alias("diff"), F.first("a").alias("a"), F.first("b").alias("b"))
    out = per.agg(F.max(F.col("a") - F.col("b")).alias("observed"), F.count_if(F.abs("diff") >= F.abs(F.col("a") - F.col("b"))).alias("ge"))
    return out.select("observed", "ge", ((F.col("ge") + 1) / (draws + 1)).alias("p"))


def split_metrics(rows: DataFrame) -> DataFrame:
    """(split, tp, fn, fp, tn, abstained, recall, fpr) of rows split, expected (0/1), predicted (0/1 or null); rates are null
    where undefined."""
    is_ = lambda e, p: F.count_if((F.col("expected") == e) & (F.col("predicted") == p))
    m = rows.groupBy("split").agg(is_(1, 1).alias("tp"), is_(1, 0).alias("fn"), is_(0, 1).alias("fp"), is_(0, 0).alias("tn"), F.count_if(F.col("predicted").isNull()).alias("abstained"))
    return m.withColumn("recall", ratio(F.col("tp"), F.col("tp") + F.col("fn"), None)).withColumn("fpr", ratio(F.col("fp"), F.col("fp") + F.col("tn"), None))


def paired_discrimination(rows: DataFrame) -> DataFrame:
    """(pairs, discriminated) over groups with both an expected and an unexpected row: all of the first flagged, none of the
    second. rows: source_group, expected, predicted."""
    per = rows.groupBy("source_group").agg(
        F.bool_or(F.col("expected") == 1).alias("a"), F.bool_or(F.col("expected") == 0).alias("b"),
        F.bool_and(F.coalesce(F.col("predicted"), F.lit(-1)) == F.col("expected")).alias("ok"),
    )
    return per.where("a and b").agg(F.count(F.lit(1)).alias("pairs"), F.count_if("ok").alias("discriminated"))


def topk_jaccard(a: DataFrame, b: DataFrame, ks: list[int]) -> DataFrame:
    """(k, common, jaccard) of the top k of two (item_id, score) tables; ties break by id. Each side gives max(ks) rows."""
    top = lambda df, n: df.orderBy(F.desc("score"), "item_id").limit(max(ks)).select("item_id", F.row_number().over(Window.orderBy(F.desc("score"), "item_id")).alias(n))
    both = top(a, "ra").join(top(b, "rb"), "item_id").select("item_id", F.greatest("ra", "rb").alias("r"))
    cut = a.sparkSession.range(1).select(F.explode(F.array(*[F.lit(k) for k in ks])).alias("k"))
    per = cut.join(both, F.col("r") <= F.col("k"), "left").groupBy("k").agg(F.count("r").alias("common"))
    return per.select("k", "common", (F.col("common") / (2 * F.col("k") - F.col("common"))).alias("jaccard"))


def correction_impact(resp: DataFrame, fixed: DataFrame) -> DataFrame:
    """(model_id, old, new, gain, old_rank, new_rank) when golds are corrected. resp: model_id, item_id, label, gold;
    fixed: item_id, new_gold."""
    rows = resp.join(fixed, "item_id", "left").withColumn("now", F.coalesce("new_gold", "gold"))
    per = rows.groupBy("model_id").agg(F.avg((F.col("label") == F.col("gold")).cast("int")).alias("old"), F.avg((F.col("label") == F.col("now")).cast("int")).alias("new"))
    rank = lambda c: F.row_number().over(Window.orderBy(F.desc(c), "model_id"))
    return per.select("model_id", "old", "new", (F.col("new") - F.col("old")).alias("gain"), rank("old").alias("old_rank"), rank("new").alias("new_rank"))


def repeat_arms(runs: DataFrame, need: int) -> DataFrame:
    """(item_id, runs) of items that at least `need` distinct runs flag."""
    return runs.groupBy("item_id").agg(F.count_distinct("run").alias("runs")).where(F.col("runs") >= need)


def sampling_quotas(total: int, defects: int, clean: int, size: int, share: float) -> tuple[int, int]:
    """Defects and clean rows to draw: the share rounded half to even, then shortfalls go to defects first."""
    target = min(size, total)
    d = min(defects, round(target * share))
    c = min(clean, target - d)
    d = min(defects, d + target - d - c)
    return d, min(clean, target - d)
