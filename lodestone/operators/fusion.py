"""Findings placed on items, and what the findings of one item say about each other.

Items have row_uid (one each, see `unique_row_uids`) and item_id, which may repeat. Findings have row_uid or only item_id.
Nothing is collected per item: flags of an item are one grouped aggregate of bounded sets (methods, defects), joined back to
its findings; an item with a large share of all findings is split by the adaptive skew join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.functions.text import blank, let

CONTRADICTED, FAILED = "auditor_contradiction", "llm_audit_failure"


def unique_row_uids(items: DataFrame, order: str = "source_row_index") -> DataFrame:
    """items with a row_uid of their own each: the first row by `order` keeps a repeated one, all others and those without
    one get audit-row-<order>, with -dup behind it where an item has just that name already."""
    first = items.where(~blank(F.col("row_uid"))).groupBy("row_uid").agg(F.min(order).alias("__first"))
    kept = items.join(first, "row_uid", "left").withColumn("__keeps", F.col(order) == F.col("__first"))
    made = F.format_string("audit-row-%08d", F.col(order))
    taken = first.where(F.col("row_uid").startswith("audit-row-")).select(F.col("row_uid").alias("__taken"))
    named = kept.withColumn("__made", F.when(~F.coalesce("__keeps", F.lit(False)), made)).join(taken, F.col("__made") == F.col("__taken"), "left")
    uid = F.when(F.col("__made").isNull(), F.col("row_uid")).when(F.col("__taken").isNotNull(), F.concat("__made", F.lit("-dup"))).otherwise(F.col("__made"))
    return named.select(*[uid.alias(c) if c == "row_uid" else F.col(c) for c in items.columns])


def on_items(findings: DataFrame, items: DataFrame) -> DataFrame:
    """findings with row_uid filled in and `resolution`: row_uid or item_id where that names one item, unknown_row,
    ambiguous_item_id (several rows have it, so none is chosen) or unknown_item_id.

    A finding that names a row never falls back to its item id, and keeps the name although no row has it.
    """
    rows = items.select(F.col("row_uid").alias("__row"), F.lit(True).alias("__known"))
    ids = items.groupBy(F.col("item_id").alias("__id")).agg(F.count(F.lit(1)).alias("__n"), F.min("row_uid").alias("__only"))
    by_id = F.when(F.col("row_uid").isNull(), F.col("item_id"))
    met = findings.join(rows, F.col("row_uid") == F.col("__row"), "left").join(ids, by_id == F.col("__id"), "left")
    how = (
        F.when(F.col("__known"), "row_uid")
        .when(F.col("row_uid").isNotNull(), "unknown_row")
        .when(F.col("__n") == 1, "item_id")
        .when(F.col("__n") > 1, "ambiguous_item_id")
        .otherwise("unknown_item_id")
    )
    uid = F.coalesce("row_uid", F.when(F.col("__n") == 1, F.col("__only")))
    return met.select(*[uid.alias(c) if c == "row_uid" else F.col(c) for c in findings.columns], how.alias("resolution"))


def strictly_on_items(findings: DataFrame, items: DataFrame) -> DataFrame:
    """findings with `identity`: resolved, or why not: no_row_uid, unknown_row, other_item_id, other_source_hash (only a hash
    that is given counts). Nothing falls back to an item id."""
    rows = items.select(F.col("row_uid").alias("__row"), F.col("item_id").alias("__id"), F.col("source_row_sha256").alias("__hash"))
    met = findings.join(rows, F.col("row_uid") == F.col("__row"), "left")
    claimed = F.nullif(F.col("source_row_sha256"), F.lit(""))
    identity = (
        F.when(F.coalesce("row_uid", F.lit("")) == "", "no_row_uid")
        .when(F.col("__row").isNull(), "unknown_row")
        .when(~F.col("__id").eqNullSafe(F.col("item_id")), "other_item_id")
        .when(claimed.isNotNull() & ~claimed.eqNullSafe(F.col("__hash")), "other_source_hash")
        .otherwise("resolved")
    )
    return met.select(*findings.columns, identity.alias("identity"))


def contradictions(gold_status: Column, correct: Column, statuses: Column, option_defect: Column, cardinality: Column, declared: Column) -> Column:
    """array<struct<reason, methods>>: where the audits of the gold and of the options of one item exclude each other.

    correct: answers that the gold audit takes for right; statuses: array of struct(label, best_answer_status).
    Labels are compared trimmed and in upper case; null and empty ones don't count. All inputs may be null.
    """
    told = lambda xs: F.array_sort(F.array_distinct(F.transform(F.filter(F.coalesce(xs, F.array().cast("array<string>")), lambda x: x.isNotNull() & (x != "")), lambda x: F.upper(F.trim(x)))))
    fit = F.transform(F.filter(statuses, lambda s: s["best_answer_status"].isin("best", "acceptable")), lambda s: s["label"])
    listed = lambda xs: F.concat(F.lit("["), F.array_join(F.transform(xs, lambda x: F.concat(F.lit("'"), x, F.lit("'"))), ", "), F.lit("]"))
    two, one = F.array(F.lit("llm_gold_audit"), F.lit("llm_option_set")), F.array(F.lit("llm_option_set"))
    reason = lambda text, methods: F.struct(text.alias("reason"), methods.alias("methods"))

    def of(sets: Column) -> Column:
        right, best = sets["right"], sets["best"]
        single = F.coalesce(cardinality == "exactly_one", F.lit(False))
        gold = F.upper(F.trim(F.coalesce(declared, F.lit(""))))
        return F.array_compact(F.array(
            F.when((F.size(right) > 0) & (F.size(best) > 0) & ~F.arrays_overlap(right, best), reason(F.concat(F.lit("gold correct_answers="), listed(right), F.lit(" conflicts with option best_answers="), listed(best)), two)),
            F.when((option_defect == "multiple_correct_answers") & single, reason(F.lit("option defect says multiple_correct_answers but cardinality is exactly_one"), one)),
            F.when((option_defect == "no_correct_answer") & single, reason(F.lit("option defect says no_correct_answer but cardinality is exactly_one"), one)),
            F.when((gold_status == "contradicted") & (gold != "") & F.array_contains(best, gold), reason(F.lit("gold auditor contradicts the declared gold while option auditor still marks it as best"), two)),
        ))

    return let(F.struct(told(correct).alias("right"), told(fit).alias("best")), of)


def fuse(findings: DataFrame, items: DataFrame) -> DataFrame:
    """All findings, placed on items, after each item's findings were held against each other, plus the new ones.

    Items have `contradictions` (see above) besides row_uid and item_id; findings have method, defect_type, severity,
    review_only, defect_scope and needs_expert. A model's finding (its method starts with llm_, failed audits aside)

    * becomes review_only with severity review where a contradiction touches its method (auditor_contradictions says which),
      or else where the model asked for an expert;
    * otherwise names all models that found something in the item, if there are two (llm_corroborated_by), and is exploratory
      if it only says that an option doesn't apply and nothing else speaks of the item;
    * is marked corroborated_by_non_llm if it is about clarity and another method reports the same defect, unless contradicted.

    Each item with contradictions and at least one finding gets one auditor_contradiction finding. Findings that no item could
    be found for stay and are held against each other as one group, as no item tells them apart.
    """
    placed = on_items(findings, items)
    model = F.col("method").startswith("llm_")
    real = model & (F.col("defect_type") != FAILED)
    base = F.substring_index("method", "+", 1)
    flags = placed.groupBy("row_uid").agg(F.array_sort(F.collect_set(F.when(real, base))).alias("__models"), F.collect_set(F.when(~model, F.col("defect_type"))).alias("__others"))
    known = items.select(F.col("row_uid").alias("__row"), F.col("item_id").alias("__id"), F.col("contradictions").alias("__against"))
    flags = flags.join(known, F.col("row_uid") == F.col("__row"), "left").withColumnRenamed("row_uid", "__uid")

    met = placed.join(flags, F.col("row_uid").eqNullSafe(F.col("__uid")))
    against = F.transform(F.filter("__against", lambda c: F.array_contains(c["methods"], base)), lambda c: c["reason"])
    contradicted = real & (F.coalesce(F.size(against), F.lit(0)) > 0)
    expert = real & ~contradicted & F.coalesce("needs_expert", F.lit(False))
    free = real & ~contradicted & ~expert
    alone = (F.col("__models") == F.array(F.lit("llm_option_applicability"))) & (F.size("__others") == 0)
    changed = {
        "severity": F.when(contradicted | expert, "review").otherwise(F.col("severity")),
        "review_only": contradicted | expert | F.col("review_only"),
    }
    added = [
        F.when(contradicted, against).alias("auditor_contradictions"),
        (real & ~contradicted & (F.col("method") == "llm_question_clarity") & F.array_contains("__others", F.col("defect_type"))).alias("corroborated_by_non_llm"),
        F.when(free & (F.size("__models") >= 2), F.col("__models")).alias("llm_corroborated_by"),
        (free & alone & (F.col("method") == "llm_option_applicability")).alias("exploratory"),
    ]
    old = met.select(*[changed.get(c, F.col(c)).alias(c) for c in placed.columns], *added)
    told = flags.where(F.size("__against") > 0)
    values = {
        "row_uid": F.col("__uid"), "item_id": F.col("__id"), "method": F.lit("llm_evidence_fusion"), "defect_type": F.lit(CONTRADICTED), "severity": F.lit("review"), "review_only": F.lit(True),
        "defect_scope": F.lit("operational"), "needs_expert": F.lit(False), "resolution": F.lit("row_uid"), "auditor_contradictions": F.transform("__against", lambda c: c["reason"]),
        "corroborated_by_non_llm": F.lit(False), "exploratory": F.lit(False),
    }
    new = told.select(*[values.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in old.schema.fields])
    return old.unionByName(new)
