"""Evidence: promotion of findings, tiers and risks of items, summaries, votes."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# Names and numbers that have to equal the published decision policy's for equal tiers.
IGNORED_DEFECTS = ("llm_audit_failure", "auditor_contradiction")
STRONG_METHODS = ("llm_gold_audit", "llm_event_state", "llm_quantity_consistency", "executable_evidence", "executable_evidence_replay", "evaluator_replay", "differential_testing", "metamorphic_testing")
STRONG_DEFECTS = ("wrong_gold_answer", "unexpected_invisible_or_control_gold", "invalid_choice_gold", "missing_oracle", "duplicate_choices", "duplicate_item_id", "conflicting_duplicate_oracle", "evaluator_mismatch", "metamorphic_inconsistency")
WEAK_DEFECTS = ("ambiguous_goal", "bad_options_clarity", "context_version_mismatch_risk", "missing_accepted_alternatives", "missing_condition", "missing_output_contract", "source_reference_missing", "temporal_scope_missing")
NONMATERIAL_METHODS = ("llm_quantity_consistency_nonmaterial", "llm_event_state_nonmaterial")
STRONG_CONFIDENCE = 0.6
CORROBORATING_METHODS = 2
#: Proofs that a replay on live columns can confirm.
PROOFS = (
    ("static_rule", "canonical_task_absence", "missing_task"),
    ("static_rule", "choice_gold_domain_replay", "invalid_choice_gold"),
    ("static_rule", "safe_arithmetic_replay", "wrong_gold_answer"),
    ("static_rule", "oracle_unicode_integrity_replay", "unexpected_invisible_or_control_gold"),
    ("cross_artifact_consistency", "answer_contract_static_consistency", "output_evaluator_contract_mismatch"),
)


def promote(findings: DataFrame, trusted: bool = True) -> DataFrame:
    """findings plus tier, in the lattice's order: untrusted mapping or operational is unknown, model-based or
    review-only is review, a registered proof is confirmed, everything else is review. The findings here are computed
    on live columns, so the proof's replay is the finding itself."""
    proof = F.concat_ws("|", "method", "evidence_level", "defect_type").isin(["|".join(p) for p in PROOFS])
    tier = (
        F.when(F.lit(not trusted), "unknown")
        .when(F.col("defect_type").isin(*IGNORED_DEFECTS), "unknown")
        .when(F.col("method").startswith("llm_"), "review")
        .when(F.col("review_only"), "review")
        .when(proof, "confirmed")
        .otherwise("review")
    )
    return findings.withColumn("tier", tier).withColumn("review_only", F.col("tier") != "confirmed")


def item_tiers(findings: DataFrame) -> DataFrame:
    """(item_id, tier, risk, n_methods, confirmed): one aggregation per item over findings that count. Operational findings
    and those of a failed audit don't; an item with presentation findings only is exploratory at a low risk. A column
    needs_expert, where there is one, says whether a model asked for an expert."""
    expert = F.coalesce(F.col("needs_expert"), F.lit(False)) if "needs_expert" in findings.columns else F.lit(False)
    model = F.col("method").startswith("llm_")
    sure = F.coalesce(F.col("confidence") >= STRONG_CONFIDENCE, F.lit(True))
    strong = (F.substring_index("method", "+", 1).isin(*STRONG_METHODS) | F.col("defect_type").isin(*STRONG_DEFECTS)) & ~F.col("method").isin(*NONMATERIAL_METHODS) & sure
    relevant = (F.coalesce("defect_scope", F.lit("substantive")) != "operational") & ~F.col("defect_type").isin(*IGNORED_DEFECTS)
    own = relevant & (F.coalesce("defect_scope", F.lit("substantive")) == "substantive")
    method = F.substring_index("method", "+", 1)
    evident = method.isin(*STRONG_METHODS) | F.col("defect_type").isin(*STRONG_DEFECTS)
    any_of = lambda x: F.coalesce(F.bool_or(x), F.lit(False))
    per = findings.groupBy("item_id").agg(
        any_of(relevant).alias("relevant"),
        any_of(own).alias("substantive"),
        any_of(own & ~F.col("review_only")).alias("confirmed"),
        any_of(own & strong).alias("strong"),
        any_of(own & evident).alias("evident"),
        F.coalesce(F.bool_and(F.when(own, F.col("defect_type").isin(*WEAK_DEFECTS))), F.lit(False)).alias("all_weak"),
        F.count_distinct(F.when(own, method)).cast("int").alias("n_methods"),
        F.count_distinct(F.when(own & model, method)).cast("int").alias("n_models"),
        F.coalesce(F.bool_and(F.when(own & model, expert)), F.lit(False)).alias("all_expert"),
        any_of(F.col("defect_type") == "auditor_contradiction").alias("contradicted"),
        F.max(F.when(own, F.col("confidence"))).alias("confidence"),
    ).where("relevant")
    supported = F.col("strong") | ((F.col("n_methods") >= CORROBORATING_METHODS) & ~F.col("all_weak"))
    tier = F.when(F.col("confirmed") | supported, "priority").otherwise("exploratory")
    base = F.when(F.col("confirmed"), 0.72).when(supported, 0.52).otherwise(0.12)
    more = F.greatest(F.lit(0.0), F.least(F.lit(0.12), 0.06 * (F.col("n_models") - 1)))
    less = F.when(F.col("contradicted"), 0.08).otherwise(0.0) + F.when(F.col("all_expert"), 0.08).otherwise(0.0)
    risk = base + 0.12 * F.coalesce("confidence", F.lit(0.0)) + more + F.when(F.col("evident"), 0.10).otherwise(0.0) - less
    risk = F.when(F.col("substantive"), risk).otherwise(0.07)
    return per.select("item_id", tier.alias("tier"), F.least(F.lit(1.0), F.greatest(F.lit(0.0), risk)).alias("risk"), "n_methods", "confirmed")


def summary(findings: DataFrame) -> DataFrame:
    """Histograms by defect, method, severity and tier from one pass of grouping sets: (dimension, value, n, items)."""
    findings.createOrReplaceTempView("__findings")
    return findings.sparkSession.sql("""
        SELECT CASE WHEN grouping(defect_type) = 0 THEN 'defect_type' WHEN grouping(method) = 0 THEN 'method'
                    WHEN grouping(severity) = 0 THEN 'severity' ELSE 'tier' END AS dimension,
               coalesce(defect_type, method, severity, tier) AS value, count(*) AS n, count(DISTINCT item_id) AS items
        FROM __findings GROUP BY GROUPING SETS ((defect_type), (method), (severity), (tier))""")


def ledger_summary(ledger: DataFrame) -> DataFrame:
    """(checker, eligible, findings, completed, ineligible, status) per checker."""
    of = lambda s: F.count_if(F.col("status") == s)
    per = ledger.groupBy("checker").agg(F.count_if("eligible").alias("eligible"), of("finding").alias("with_finding"), of("completed_no_finding").alias("completed"), of("ineligible").alias("ineligible"))
    return per.withColumn("status", F.when(F.col("eligible") == 0, "ineligible").otherwise("executed"))


def quorum(votes: DataFrame, need: int) -> DataFrame:
    """(item_id, verdict, agreement): the verdict with an absolute quorum; ties and too few votes are uncertain."""
    counted = votes.groupBy("item_id", "verdict").agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy("item_id")
    ranked = counted.select("item_id", "verdict", "n", F.sum("n").over(w).alias("total"), F.max("n").over(w).alias("top"))
    per = ranked.where("n = top").groupBy("item_id").agg(F.count(F.lit(1)).alias("ties"), F.min("verdict").alias("v"), F.max("top").alias("top"), F.max("total").alias("total"))
    return per.select("item_id", F.when((F.col("ties") == 1) & (F.col("top") >= need), F.col("v")).otherwise("uncertain").alias("verdict"), (F.col("top") / F.col("total")).alias("agreement"))


def signals(*parts: DataFrame, least: int = 2) -> DataFrame:
    """(item_id, n_signals) of items that at least `least` of the (item_id, signal) tables name."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.groupBy("item_id").agg(F.count_distinct("signal").alias("n_signals")).where(F.col("n_signals") >= least)
