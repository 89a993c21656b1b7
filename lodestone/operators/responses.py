"""Model-by-item responses: quality, error rates, behaviour scores, overlaps of methods, leaderboards."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions.stats import ratio, safe_corr, wilson, with_percentile


def quality(resp: DataFrame) -> DataFrame:
    """(model_id, answered, coverage, qualified) against the number of items; a model qualifies from 0.8 on."""
    items = resp.agg(F.count_distinct("item_id").alias("items"))
    per = resp.groupBy("model_id").agg(F.count_distinct("item_id").alias("answered"))
    share = F.col("answered") / F.col("items")
    return per.join(F.broadcast(items)).select("model_id", "answered", share.alias("coverage"), (share >= 0.8).alias("qualified"))


def item_errors(resp: DataFrame) -> DataFrame:
    """(item_id, n, wrong, error_rate, lo, hi) with a Wilson interval."""
    per = resp.groupBy("item_id").agg(F.count(F.lit(1)).alias("n"), F.sum(1 - F.col("correct")).alias("wrong"))
    k, n = F.col("wrong"), F.col("n")
    return per.select("item_id", "n", "wrong", ratio(k, n).alias("error_rate"), wilson(k, n, False).alias("lo"), wilson(k, n, True).alias("hi"))


def fused_triage(errors: DataFrame, audit: DataFrame) -> DataFrame:
    """(item_id, error_pct, audit_pct, fused): mean of average-rank percentiles, of error and of audit score."""
    rows = with_percentile(with_percentile(errors.join(audit, "item_id"), "error_rate", "error_pct"), "score", "audit_pct")
    return rows.select("item_id", "error_pct", "audit_pct", (0.5 * F.col("error_pct") + 0.5 * F.col("audit_pct")).alias("fused"))


def entropy(labels: DataFrame, classes: int) -> DataFrame:
    """(item_id, entropy) of the answers' labels, divided by ln(classes)."""
    counted = labels.groupBy("item_id", "label").agg(F.count(F.lit(1)).alias("c"))
    p = F.col("c") / F.sum("c").over(Window.partitionBy("item_id"))
    return counted.select("item_id", (-p * F.ln(p)).alias("h")).groupBy("item_id").agg((F.sum("h") / F.ln(F.lit(float(classes)))).alias("entropy"))


def majority_against_gold(labels: DataFrame) -> DataFrame:
    """(item_id, score): most votes for one wrong label less the votes for gold, over all votes."""
    counted = labels.groupBy("item_id", "label").agg(F.count(F.lit(1)).alias("c"), F.max((F.col("label") == F.col("gold")).cast("int")).alias("is_gold"))
    per = counted.groupBy("item_id").agg(F.max(F.when(F.col("is_gold") == 0, F.col("c")).otherwise(0)).alias("wrong"), F.sum(F.when(F.col("is_gold") == 1, F.col("c")).otherwise(0)).alias("right"), F.sum("c").alias("n"))
    return per.select("item_id", ((F.col("wrong") - F.col("right")) / F.col("n")).alias("score"))


def item_total(resp: DataFrame) -> DataFrame:
    """(item_id, anomaly): minus the correlation of an item's correctness with the models' totals without the item; 0 where
    it isn't defined or fewer than 3 models answered."""
    total = resp.groupBy("model_id").agg(F.sum("correct").alias("total"))
    rows = resp.join(total, "model_id").select("item_id", F.col("correct").cast("double").alias("x"), (F.col("total") - F.col("correct")).cast("double").alias("rest"))
    per = rows.groupBy("item_id").agg(safe_corr("x", "rest").alias("r"), F.count(F.lit(1)).alias("n"), F.stddev_pop("x").alias("sx"), F.stddev_pop("rest").alias("sr"))
    ok = (F.col("n") >= 3) & (F.col("sx") >= 1e-12) & (F.col("sr") >= 1e-12)
    return per.select("item_id", F.when(ok, -F.col("r")).otherwise(0.0).alias("anomaly"))


def top_third_disagreement(resp: DataFrame) -> DataFrame:
    """(item_id, score): error rate among the best third of models (two at least) less the error rate of all."""
    total = resp.groupBy("model_id").agg(F.sum("correct").alias("total"))
    m = F.count(F.lit(1)).over(Window.partitionBy())
    top = total.withColumn("place", F.row_number().over(Window.orderBy(F.desc("total"), "model_id"))).withColumn("m", m)
    top = top.select("model_id", (F.col("place") <= F.greatest(F.lit(2), F.ceil(F.col("m") / 3))).alias("is_top"))
    per = resp.join(top, "model_id").groupBy("item_id").agg(F.avg(F.when(F.col("is_top"), 1 - F.col("correct"))).alias("a"), F.avg(1 - F.col("correct")).alias("b"))
    return per.select("item_id", (F.coalesce("a", F.lit(0.0)) - F.col("b")).alias("score"))


def fuse(parts: dict[str, DataFrame]) -> DataFrame:
    """(item_id, fused): mean of the average-rank percentiles of several (item_id, score) tables on their common items."""
    out = None
    for name, df in parts.items():
        df = df.toDF("item_id", name)
        out = df if out is None else out.join(df, "item_id")
    for name in parts:
        out = with_percentile(out, name, name)
    total = sum((F.col(n) for n in parts), F.lit(0.0))
    return out.select("item_id", (total / len(parts)).alias("fused"))


def leaderboard(trials: DataFrame) -> DataFrame:
    """(system_id, score, n, rank): mean reward, null as 0; rank is a row number by score, then name."""
    per = trials.groupBy("system_id").agg(F.avg(F.coalesce("reward", F.lit(0.0))).alias("score"), F.count(F.lit(1)).alias("n"))
    return per.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), "system_id")))


def impact(before: DataFrame, after: DataFrame) -> DataFrame:
    """(system_id, old_rank, new_rank, shift, gain)."""
    a = before.select("system_id", F.col("rank").alias("old_rank"), F.col("score").alias("old"))
    b = after.select("system_id", F.col("rank").alias("new_rank"), F.col("score").alias("new"))
    return a.join(b, "system_id").select("system_id", "old_rank", "new_rank", (F.col("old_rank") - F.col("new_rank")).alias("shift"), (F.col("new") - F.col("old")).alias("gain"))


def rank_correlations(pairs: DataFrame) -> DataFrame:
    """(n, tau_a, tau_b, spearman, pearson, flips) of columns x and y of one row per system. Systems are few by nature: the
    self-join over a < b runs on one row per system. Where all systems tie in x or y, tau_b, spearman and pearson aren't
    defined and are NaN, as in SQL; of less than two systems tau_a, tau_b and flips are null."""
    a, b = pairs.select(F.col("system_id").alias("a"), F.col("x").alias("ax"), F.col("y").alias("ay")), pairs.select(F.col("system_id").alias("b"), F.col("x").alias("bx"), F.col("y").alias("by"))
    s = F.signum(F.col("ax") - F.col("bx")) * F.signum(F.col("ay") - F.col("by"))
    two = a.join(b, F.col("a") < F.col("b")).agg(
        F.count(F.lit(1)).alias("pairs"), F.sum(s).alias("s"), F.count_if(F.col("ax") == F.col("bx")).alias("tx"), F.count_if(F.col("ay") == F.col("by")).alias("ty"), F.count_if(s < 0).alias("flips")
    )
    mean_rank = lambda c: F.rank().over(Window.orderBy(c)) + (F.count(F.lit(1)).over(Window.partitionBy(c)) - 1) / 2
    one = pairs.select("x", "y", mean_rank("x").alias("rx"), mean_rank("y").alias("ry")).agg(F.count(F.lit(1)).alias("n"), safe_corr("rx", "ry").alias("spearman"), safe_corr("x", "y").alias("pearson"))
    nan = lambda c: F.when(F.col("n") > 0, F.coalesce(c, F.lit(float("nan")))).alias(c)
    n = F.col("pairs").cast("double")
    untied = F.sqrt((n - F.col("tx")) * (n - F.col("ty")))
    tau_b = F.when(untied > 0, F.col("s") / untied).when(n > 0, F.lit(float("nan")))
    return one.join(F.broadcast(two)).select("n", F.when(n > 0, F.col("s") / n).alias("tau_a"), tau_b.alias("tau_b"), nan("spearman"), nan("pearson"), F.when(n > 0, F.col("flips")).alias("flips"))


def method_overlap(flags: DataFrame) -> DataFrame:
    """(a, b, common, either, jaccard) for unordered pairs of methods in (method, item_id): an equi-join on items gives the
    common ones; union sizes follow from the sizes."""
    f = flags.select("method", "item_id").distinct()
    size = f.groupBy("method").agg(F.count(F.lit(1)).alias("n"))
    both = f.toDF("a", "item_id").join(f.toDF("b", "item_id"), "item_id").where("a < b").groupBy("a", "b").agg(F.count(F.lit(1)).alias("common"))
    sized = both.join(size.toDF("a", "na"), "a").join(size.toDF("b", "nb"), "b")
    either = F.col("na") + F.col("nb") - F.col("common")
    return sized.select("a", "b", "common", either.alias("either"), (F.col("common") / either).alias("jaccard"))


def unique_positives(flags: DataFrame) -> DataFrame:
    """(method, unique_items): items that only this method flags."""
    per = flags.groupBy("item_id").agg(F.count_distinct("method").alias("k"), F.min("method").alias("method"))
    return per.where("k = 1").groupBy("method").agg(F.count(F.lit(1)).alias("unique_items"))


def phi(rows: DataFrame, columns: list[str]) -> DataFrame:
    """(a, b, phi) of 0/1 columns, all pairs in one aggregation."""
    cells = [F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), safe_corr(a, b).alias("phi")) for i, a in enumerate(columns) for b in columns[i + 1 :]]
    return rows.agg(F.array(*cells).alias("c")).select(F.explode("c").alias("c")).select("c.*")


def precision_at(scored: DataFrame, ks: list[int]) -> DataFrame:
    """(k, hits, precision, recall): exact expectation at k of a score order whose ties fall at random. scored: score, positive."""
    per = scored.groupBy("score").agg(F.count(F.lit(1)).alias("n"), F.sum("positive").alias("pos"))
    upto = Window.orderBy(F.desc("score")).rowsBetween(Window.unboundedPreceding, -1)
    per = per.withColumn("before", F.coalesce(F.sum("n").over(upto), F.lit(0))).withColumn("all_pos", F.sum("pos").over(Window.partitionBy()))
    cut = per.withColumn("k", F.explode(F.array(*[F.lit(k) for k in ks])))
    taken = F.greatest(F.lit(0), F.least(F.col("k") - F.col("before"), F.col("n")))
    hits = cut.groupBy("k").agg(F.sum(taken * F.col("pos") / F.col("n")).alias("hits"), F.max("all_pos").alias("all_pos"))
    return hits.select("k", "hits", (F.col("hits") / F.col("k")).alias("precision"), ratio(F.col("hits"), F.col("all_pos")).alias("recall"))


def paired_conditions(rows: DataFrame) -> DataFrame:
    """(common, only_a, only_b, neither) over tasks scored under both conditions; rows: task_id, a, b (0/1 or null)."""
    r = rows.where("a is not null and b is not null")
    return r.agg(F.count_if((F.col("a") == 1) & (F.col("b") == 1)).alias("common"), F.count_if((F.col("a") == 1) & (F.col("b") == 0)).alias("only_a"), F.count_if((F.col("a") == 0) & (F.col("b") == 1)).alias("only_b"), F.count_if((F.col("a") == 0) & (F.col("b") == 0)).alias("neither"))


def distribution(rows: DataFrame, value: str) -> DataFrame:
    """(n, lo, hi, mean, median, sd, mad): summary with the sample deviation and the median absolute deviation."""
    one = rows.agg(F.count(value).alias("n"), F.min(value).alias("lo"), F.max(value).alias("hi"), F.avg(value).alias("mean"), F.percentile(value, F.lit(0.5)).alias("median"), F.stddev_samp(value).alias("sd"))
    mad = rows.join(F.broadcast(one.select("median"))).agg(F.percentile(F.abs(F.col(value) - F.col("median")), F.lit(0.5)).alias("mad"))
    return one.join(F.broadcast(mad))
