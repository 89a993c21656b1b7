"""Validators of what models extracted: quantities that must stand in a relation, and states that events change.

Both are row functions over arrays of structs, as an extraction belongs to one item. A state model is folded over its events
in order of stage, in one pass that emits findings as it goes.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from lodestone.functions.text import let, parse_number

CLOSE = 1e-9
FOUND = "array<struct<method:string,defect_type:string,confidence:double,review_only:boolean,n:int>>"
STATE_FOUND = "array<struct<finding_type:string,value:double,bound:double>>"
UNKNOWN_CHANGE = r"(?is)\bafter\b.*\b(some|several|an unknown number|an unknown amount)\b"


def finite(x: Column) -> Column:
    return F.when(~F.isnan(x) & (F.abs(x) < float("inf")), x)


def holds(left: Column, relation: Column, right: Column) -> Column:
    """Whether left <=, >=, ==, < or > right, to within 1e-9; null for other relations and for values that are no finite numbers."""
    a, b = finite(left), finite(right)
    same = F.abs(a - b) <= CLOSE
    known = F.when(relation == "<=", (a <= b) | same).when(relation == ">=", (a >= b) | same).when(relation == "==", same)
    return known.when(relation == "<", (a < b) & ~same).when(relation == ">", (a > b) & ~same)


def _one(some: Column, method: str, defect: str, review: Column | bool, confidence: Callable | None = None) -> Column:
    """A finding that stands for all elements of `some`, with their highest confidence; null if there are none."""
    sure = F.array_max(F.transform(some, lambda x: x["confidence"])) if confidence is None else confidence
    return let(sure, lambda s: F.when(F.size(some) > 0, F.struct(F.lit(method).alias("method"), F.lit(defect).alias("defect_type"), s.alias("confidence"), (review(s) if callable(review) else F.lit(review)).alias("review_only"), F.size(some).alias("n"))))


def quantity_findings(checks: Column, reference_issues: Column, derived: Column, solved: Column, confidence: Column, gold: Column, confirm: float, review: float) -> Column:
    """Findings of a quantity extraction, array<struct<method, defect_type, confidence, review_only, n>>.

    checks: array of struct(left_value, relation, right_value, confidence, fully_grounded, material_to_answer); reference_issues:
    array of struct(confidence, material_to_answer); derived: answers as texts; confidence of the whole stands in for a missing
    one of a check, and counts as 0 if missing too. Only grounded checks of two finite numbers and a known relation count, from
    confidence `review` on. Violations that matter to the answer are one finding (review only below `confirm`), those that don't are
    another; so are reference issues. One derived number, however often it was derived, is held against the gold.
    Null arrays count as empty, null flags as false.
    """
    whole = F.coalesce(confidence, F.lit(0.0))
    told = F.transform(F.coalesce(checks, F.array()), lambda c: F.struct(F.coalesce(c["confidence"], whole).alias("confidence"), F.coalesce(c["material_to_answer"], F.lit(False)).alias("material"), (F.coalesce(c["fully_grounded"], F.lit(False)) & ~F.coalesce(holds(c["left_value"], F.trim(c["relation"]), c["right_value"]), F.lit(True))).alias("violated")))
    told = F.filter(told, lambda c: c["violated"] & (c["confidence"] >= review))
    issues = F.filter(F.transform(F.coalesce(reference_issues, F.array()), lambda c: F.struct(F.coalesce(c["confidence"], F.lit(0.0)).alias("confidence"), F.coalesce(c["material_to_answer"], F.lit(False)).alias("material"))), lambda c: c["confidence"] >= review)
    numbers = F.array_distinct(F.array_compact(F.transform(F.coalesce(derived, F.array().cast("array<string>")), parse_number)))
    value = parse_number(gold)
    wrong = (solved == "solved") & (F.size(numbers) == 1) & (F.abs(F.get(numbers, F.lit(0)) - value) > CLOSE) & (whole >= review)
    method, other = "llm_quantity_consistency", "llm_quantity_consistency_nonmaterial"
    return F.array_compact(F.array(
        _one(F.filter(told, lambda c: c["material"]), method, "ambiguous_goal", lambda s: s < confirm), _one(F.filter(told, lambda c: ~c["material"]), other, "ambiguous_goal", True),
        _one(F.filter(issues, lambda c: c["material"]), method, "ambiguous_goal", True), _one(F.filter(issues, lambda c: ~c["material"]), other, "ambiguous_goal", True),
        _one(F.when(wrong, F.array(F.lit(1))).otherwise(F.array().cast("array<int>")), method, "wrong_gold_answer", True, whole),
    )).cast(FOUND)


def state_findings(initial: Column, final: Column, limit: Column, events: Column) -> Column:
    """Findings of one state model, array<struct<finding_type, value, bound>>; events: array of struct(stage, operation, amount, evidence).

    The state starts at `initial` (unknown if null) and takes the events by stage, equal stages in the order given and a missing
    stage as 0: add, remove and set, in any case; other operations, and negative amounts, change nothing. An add or remove
    without an amount makes the state unknown until it is set, as does a set whose evidence tells of an unknown change after
    which it holds. Findings, in this order:

    * removal_exceeds_available: more was removed than there was (value removed, bound available);
    * state_transition_mismatch: a state was set to another value than computed (value stated, bound computed);
    * negative_inferred_initial_state: without initial, the final state less all changes lies below zero;
    * final_state_mismatch: initial and all changes don't give the final state (both only without set and unknown changes);
    * state_exceeds_required_limit: the final state, or else the last one, lies above the limit.
    """
    start, end, most = finite(initial), finite(final), finite(limit)
    found = lambda kind, value, bound: F.struct(F.lit(kind).alias("finding_type"), value.cast("double").alias("value"), bound.cast("double").alias("bound"))
    none = F.array().cast(STATE_FOUND)
    indexed = F.transform(F.coalesce(events, F.array()), lambda e, i: F.struct(F.coalesce(e["stage"].cast("double"), F.lit(0.0)).alias("stage"), i.alias("at"), F.lower(F.coalesce(e["operation"], F.lit(""))).alias("operation"), finite(e["amount"]).alias("amount"), F.coalesce(e["evidence"], F.lit("")).alias("evidence")))
    zero = F.struct(start.cast("double").alias("now"), F.lit(0.0).alias("net"), F.lit(False).alias("was_set"), F.lit(False).alias("unknown"), none.alias("found"))

    def step(s: Column, e: Column) -> Column:
        changes, sets, amount = e["operation"].isin("add", "remove"), e["operation"] == "set", e["amount"]
        lost = changes & amount.isNull()
        counts = amount.isNotNull() & (amount >= 0)
        signed = F.when(e["operation"] == "add", amount).otherwise(-amount)
        unknown = s["unknown"] | lost | (sets & counts & F.regexp_like(e["evidence"], F.lit(UNKNOWN_CHANGE)))
        short = counts & (e["operation"] == "remove") & (amount > s["now"] + CLOSE)
        off = counts & sets & ~unknown & (F.abs(s["now"] - amount) > CLOSE)
        new = F.when(short, F.array(found("removal_exceeds_available", amount, s["now"]))).when(off, F.array(found("state_transition_mismatch", amount, s["now"]))).otherwise(none)
        now = F.when(lost, F.lit(None)).when(counts & changes, s["now"] + signed).when(counts & sets, amount).otherwise(s["now"])
        return F.struct(now.cast("double").alias("now"), (s["net"] + F.when(counts & changes, signed).otherwise(0.0)).alias("net"), (s["was_set"] | (counts & sets)).alias("was_set"), unknown.alias("unknown"), F.concat(s["found"], new).alias("found"))

    def finish(s: Column) -> Column:
        plain = ~s["was_set"] & ~s["unknown"]
        last = F.coalesce(end, s["now"])
        more = F.array_compact(F.array(
            F.when(plain & start.isNull() & (end - s["net"] < -CLOSE), found("negative_inferred_initial_state", end - s["net"], end)),
            F.when(plain & (F.abs(start + s["net"] - end) > CLOSE), found("final_state_mismatch", start + s["net"], end)),
            F.when(last > most + CLOSE, found("state_exceeds_required_limit", last, most)),
        ))
        return F.concat(s["found"], more)

    return F.aggregate(F.array_sort(indexed), zero, step, finish)


def event_state_findings(models: Column, role_conflicts: Column, confidence: Column, confirm: float, review: float) -> Column:
    """Findings of an event-state extraction, as quantity_findings gives them: one for what matters to the answer (review only below
    `confirm`), one for the rest.

    models: array of struct(initial_value, stated_final_value, required_limit, confidence, material_to_answer, events);
    role_conflicts: array of struct(confidence, material_to_answer, same_quantity_justified). Models and conflicts below
    confidence `review` are left out, as are conflicts that are justified or don't say (null). A model's own
    confidence stands with its findings, 0 if it has none.
    """
    whole = F.coalesce(confidence, F.lit(0.0))
    kept = F.filter(F.coalesce(models, F.array()), lambda m: F.coalesce(m["confidence"], whole) >= review)
    each = F.flatten(F.transform(kept, lambda m: F.transform(state_findings(m["initial_value"], m["stated_final_value"], m["required_limit"], m["events"]), lambda f: F.struct(F.coalesce(m["confidence"], F.lit(0.0)).alias("confidence"), F.coalesce(m["material_to_answer"], F.lit(False)).alias("material")))))
    roles = F.filter(F.coalesce(role_conflicts, F.array()), lambda c: (F.coalesce(c["confidence"], whole) >= review) & ~F.coalesce(c["same_quantity_justified"], F.lit(True)))
    both = F.concat(each, F.transform(roles, lambda c: F.struct(F.coalesce(c["confidence"], whole).alias("confidence"), F.coalesce(c["material_to_answer"], F.lit(False)).alias("material"))))
    of = lambda b: F.array_compact(F.array(_one(F.filter(b, lambda c: c["material"]), "llm_event_state", "ambiguous_goal", lambda s: s < confirm), _one(F.filter(b, lambda c: ~c["material"]), "llm_event_state_nonmaterial", "ambiguous_goal", True)))
    return let(both, of).cast(FOUND)
