"""Verdict tables put together: stages of a gold audit, majorities of repeated answers, agreement of profile votes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.functions.text import let

# What the stages may say, and the thresholds of the findings.
DEFECTS = ("wrong_gold_answer", "no_correct_answer", "multiple_correct_answers")
CONFIRM, REVIEW, VOTES_AGREE = 0.75, 0.45, 2 / 3
STAGES = ("blind", "defender", "challenger")


def _inferred(answers: Column) -> Column:
    """The defect that a set of acceptable answers other than the gold shows, by their number."""
    return F.when(F.size(answers) == 0, "no_correct_answer").when(F.size(answers) > 1, "multiple_correct_answers").otherwise("wrong_gold_answer")


def stage_evidence(verdicts: DataFrame) -> DataFrame:
    """(row_uid, gold_status, defect_type, confidence, agreement, n_stages, needs_expert, votes, answers) per row.

    Rows of verdicts: row_uid, stage (blind, defender or challenger), verdict (blind: solved, none or multiple; defender: supported or
    unsupported; challenger: invalid or valid), defect_type, answers, accepted (answers declared right), has_choices, confidence,
    needs_expert, failed. Each stage casts one vote; a blind answer that isn't accepted counts where the item has choices, and is uncertain
    elsewhere, as it may be the same in other words. The defect with the most votes is taken, ties by the greater name; its share of the
    stages times their mean confidence is the confidence. As many votes against as for it make it uncertain. Failed stages don't
    count, apart from the blind one; a row without a blind stage has one without answers, at confidence 0. Of repeated stages
    the one of greatest confidence counts, then the greatest row. One exchange by row_uid with three structs each, no list.
    """
    none = F.array().cast("array<string>")
    clean = lambda c: F.array_sort(F.array_distinct(F.filter(F.transform(F.coalesce(c, none), lambda x: F.trim(x)), lambda x: x != "")))
    off = F.lit(False)
    said = F.struct(
        F.coalesce("confidence", F.lit(0.0)).alias("confidence"), "verdict", F.coalesce("defect_type", F.lit("none")).alias("defect_type"), clean(F.col("answers")).alias("answers"),
        clean(F.col("accepted")).alias("accepted"), F.coalesce("has_choices", off).alias("has_choices"), F.coalesce("needs_expert", off).alias("needs_expert"),
    )
    ok = (F.col("stage") == "blind") | ~F.coalesce("failed", off)
    per = verdicts.groupBy("row_uid").agg(*[F.max(F.when((F.col("stage") == s) & ok, said)).alias(s) for s in STAGES])
    b, d, c = (F.col(s) for s in STAGES)
    own, theirs = F.coalesce(b["answers"], none), F.coalesce(c["answers"], none)
    differs = (b["verdict"] == "solved") & (F.size(own) > 0) & ~F.arrays_overlap(own, b["accepted"])
    blind = F.when(b["verdict"] == "none", "no_correct_answer").when(b["verdict"] == "multiple", "multiple_correct_answers").when(differs & b["has_choices"], "wrong_gold_answer").when(differs, "uncertain").otherwise("none")
    defends = F.when(d.isNotNull(), F.when(d["verdict"] == "supported", "none").when(d["verdict"] == "unsupported", _inferred(own)).otherwise("uncertain"))
    named = F.when(c["verdict"] == "valid", "none").when((c["verdict"] == "invalid") & (c["defect_type"] == "none"), _inferred(theirs)).otherwise(c["defect_type"])
    challenges = F.when(c.isNotNull(), F.when(named.isin("none", *DEFECTS), named).otherwise("uncertain"))
    votes = per.select(
        "row_uid", F.array_compact(F.array(blind, defends, challenges)).alias("votes"), F.array_sort(F.array_union(own, theirs)).alias("answers"),
        F.exists(F.array(b, d, c), lambda s: F.coalesce(s["needs_expert"], off)).alias("needs_expert"),
        sum((F.coalesce(s["confidence"], F.lit(0.0)) for s in (b, d, c)), F.lit(0.0)).alias("total"),
    )
    count = lambda of: F.size(F.filter("votes", lambda v: v == of))
    best = F.array_max(F.array(*[F.struct(count(F.lit(x)).alias("n"), F.lit(x).alias("defect")) for x in DEFECTS]))
    chosen = votes.withColumn("best", best).withColumn("against", count(F.lit("none"))).withColumn("n_stages", F.size("votes"))
    n = F.col("best.n")
    status = F.when(n == 0, F.when(F.col("against") > 0, "supported").otherwise("uncertain")).when((F.col("against") > 0) & (n <= F.col("against")), "uncertain").otherwise("contradicted")
    share = F.when(n == 0, F.col("against")).otherwise(n) / F.col("n_stages")
    return chosen.select(
        "row_uid", status.alias("gold_status"), F.when(n > 0, F.col("best.defect")).otherwise("none").alias("defect_type"), F.round(share * (F.col("total") / F.col("n_stages")), 6).alias("confidence"),
        (n / F.col("n_stages")).alias("agreement"), "n_stages", "needs_expert", "votes", "answers",
    )


def evidence_findings(evidence: DataFrame, confirm: float = CONFIRM, review: float = REVIEW) -> DataFrame:
    """(row_uid, method, defect_type, confidence, review_only) of evidence from `review` on that names a defect; a column vote_fraction, where there
    is one, holds a finding back for review below two thirds."""
    split = F.coalesce(F.col("vote_fraction") < VOTES_AGREE, F.lit(False)) if "vote_fraction" in evidence.columns else F.lit(False)
    named = F.when(F.col("defect_type").isin(*DEFECTS), F.col("defect_type")).when(F.col("gold_status") == "contradicted", "wrong_gold_answer")
    found = evidence.where((F.col("confidence") >= review) & named.isNotNull())
    return found.select("row_uid", F.lit("llm_gold_audit").alias("method"), named.alias("defect_type"), "confidence", (F.col("needs_expert") | (F.col("confidence") < confirm) | split).alias("review_only"))


def majority(votes: DataFrame, default: str = "uncertain") -> DataFrame:
    """(key, majority, n_votes, top, exemplar) for rows (key, position, vote, result): the most frequent vote, ties to the one cast first (at one position: the greater), and the
    first result that cast it. Null and empty votes don't count; without any the default is the majority and the first result the exemplar.

    Votes are counted per key and value before keys meet, so a hot key sends one row per value and task.
    """
    cast = F.when(F.col("vote") != "", F.trim("vote"))
    counted = votes.withColumn("v", cast).groupBy("key", "v").agg(F.count(F.lit(1)).alias("n"), F.min("position").alias("first"), F.min_by("result", "position").alias("result"))
    real = F.when(F.col("v").isNotNull(), F.struct("n", (-F.col("first")).alias("early"), "v", "result"))
    per = counted.groupBy("key").agg(F.max(real).alias("best"), F.sum(F.when(F.col("v").isNotNull(), F.col("n")).otherwise(0)).alias("n_votes"), F.min_by("result", "first").alias("any"))
    return per.select("key", F.coalesce("best.v", F.lit(default)).alias("majority"), "n_votes", F.coalesce("best.n", F.lit(0).cast("long")).alias("top"), F.when(F.col("best").isNotNull(), F.col("best.result")).otherwise(F.col("any")).alias("exemplar"))


def agreed(votes: DataFrame, fallback: str = "other") -> DataFrame:
    """(key, dimension, value, disputed) for rows (key, dimension, value): the value if all votes gave it, else the fallback and the values that they
    were split between. A null value is a value of its own ("None"). Different values are found before they meet."""
    different = votes.select("key", "dimension", F.coalesce(F.col("value"), F.lit("None")).alias("told"), "value").distinct()
    per = different.groupBy("key", "dimension").agg(F.array_sort(F.collect_list("told")).alias("all"), F.max("value").alias("value"))
    split = lambda a: F.when(F.size(a) > 1, F.concat(F.lit("votes split between "), F.array_join(a, ", ")))
    return per.select("key", "dimension", F.when(F.size("all") == 1, F.col("value")).otherwise(fallback).alias("value"), let(F.col("all"), split).alias("disputed"))
