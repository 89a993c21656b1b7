"""Row checkers. A checker is a name, an eligibility column and columns that each give one finding or null; all of them
run in one projection, which gives the findings table and the item-by-checker ledger from a single scan.

Items have item_id, task, choices (array), gold, aliases (array), output_contract, evaluator, metadata (map) and, where
known, row_uid, context (map of name to text) and task_shape (of a profile; null says nothing about the task).
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark import SparkContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.functions import answers as A
from lodestone.functions import text as X

# Patterns that have to equal the published checkers' for equal findings.
AMBIGUITY = (
    r"\b(latest|most recent)\b|"
    r"\bcurrent\s+(?:president|prime minister|leader|ceo|version|release|"
    r"population|rate|status|law|policy)\b",
    r"\b(best|most appropriate|most likely|typically|usually)\b",
)
REFERENCES = {
    "figure": r"\b(figure|diagram|chart|plot|screenshot|image)\s+(above|below|shown|provided|attached)\b|"
    r"\b(attached|provided|following|shown|uploaded)\s+(figure|diagram|chart|plot|screenshot|image)\b|"
    r"\bin\s+(figure|diagram|chart)\s*\d",
    "file": r"\b(attached|provided|following|uploaded)\s+(file|attachment|document|pdf)\b|"
    r"\baccording to\s+(the\s+)?(file|document|pdf)\b",
    "database": r"\b(given|provided|attached|following)\s+(database|schema)\b|"
    r"\baccording to\s+(the\s+)?(database|schema)\b",
}
MULTIPLICITY = {
    "order_agnostic": r"\bin\s+any\s+order\b|\bregardless\s+of\s+(?:the\s+)?order\b|\border[-\s]?independent\b|\bunordered\b",
    "existential": r"\b(?:one|any|a)\s+(?:maximal|possible|valid|such)\b|\bany\s+valid\s+(?:answer|solution|output|result|combination)\b",
    "explicit_multiple": r"\bmultiple\s+(?:valid\s+)?(?:answers?|solutions?|outputs?|results?)\b|"
    r"\bmore\s+than\s+one\s+(?:answer|solution|way|result)\b|\b(?:several|many)\s+(?:valid\s+)?(?:answers?|solutions?|ways)\b",
    "randomness": r"\brandom(?:ly|ized)?\b|\bshuffl(?:e|ed|ing)\b",
}
CONTEXT_NAMES = {
    "figure": ("figure", "image", "images", "attachment", "attachments", "file", "files", "context"),
    "file": ("file", "files", "attachment", "attachments", "document", "documents", "context"),
    "database": ("database", "schema", "db_schema", "database_schema", "tables", "context"),
}
ANSWER_SHAPES = ("multiple_choice", "open_ended_qa")
APPROXIMATE = r"(?i)\b(about|approximately|approximate|estimate|roughly|nearest)\b"
COUNTED = r"\bhow\s+many\b[^?.!]*\b(?:piles|groups|packages|packs|boxes|bags|buses|cars|trips|loads|teams)\b"
UNITS = r"(?i)\b(dollar|usd|yuan|rmb|percent|%|meter|mile|hour|minute|kg|pound)\b"
UNIT_ASKED = (
    r"\bhow\s+(?:many|much)\b[^?.!]*\b(?:dollars?|usd|yuan|rmb|cents?|percent|%|meters?|miles?|hours?|minutes?|kilograms?|kg|pounds?)\b",
    r"\bhow\s+much\s+(?:money|will\b[^?.!]*(?:pay|cost)|does\b[^?.!]*cost)\b",
    r"\bhow\s+(?:long|far)\b",
    r"\bwhat\s+is\b[^?.!]*\b(?:area|perimeter|volume|length|height|width|distance|time)\b",
)
VERSIONED = r"(?i)\b(as of|version|release|updated|latest|current)\b"
ARITHMETIC = tuple(rf"(?i){asks}\s+([-+*/().\d\s]+)\??" for asks in ("what is", "calculate", "compute"))
TEMPORAL = r"(?i)\bas of now\b|\b(?:latest|most recent|current)\s+(?:president|prime minister|leader|dalai lama|ceo|version|release|population|rate|status|law|policy)\b"
YEAR = r"\b(?:19|20)\d{2}\b"
UNNAMED_SOURCE = r"(?i)\b(recent|new|latest|a|the)\s+(research|study|report|survey|comparison)\b"
NAMED_SOURCE = r"\b(?:19|20)\d{2}\b|https?://|doi:|according to [A-Z][A-Za-z'-]+"
BROKEN_INSTRUCTION = (r"(?i)\bserving\s*[-–—]\s*year terms\b", r"(?i)\bhas members each serving\s*[-–—]?\s*year terms\b", r"(?i)\b(?:select|identify|choose)\s*$")
BROKEN_TEXT = (r"(?:â|ï¿½|�|Ã[A-Za-z])", r"(?i)\b\d{1,2}-(?:Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec)\b", r"\b(?:10\^|10\s*\*)\s*$")


@dataclass(frozen=True)
class Check:
    name: str
    eligible: Column
    findings: Sequence[Column]


def finding(method: str, defect: str, when: Column, severity: str | Column = "major", evidence: str = "", review: bool = False, confidence: float | None = None, scope: str = "substantive") -> Column:
    level = severity if isinstance(severity, Column) else F.lit(severity)
    return F.when(
        when,
        F.struct(
            F.lit(method).alias("method"),
            F.lit(defect).alias("defect_type"),
            level.alias("severity"),
            F.lit(evidence).alias("evidence_level"),
            F.lit(review).alias("review_only"),
            F.lit(confidence).cast("double").alias("confidence"),
            F.lit(scope).alias("defect_scope"),
        ),
    )


def arithmetic_value(task: Column) -> Column:
    """The value that an arithmetic task asks for: decimal numbers, + - * / // ** and brackets, signs and precedence as usual.
    Null for other tasks, division by zero and values beyond 1e12."""
    found = F.coalesce(*[F.nullif(F.trim(F.regexp_extract(task, p, 1)), F.lit("")) for p in ARITHMETIC])
    value = X.expression_value(found)
    return F.when(task.rlike("(?i)what is|calculate|compute") & (F.abs(value) <= 1e12), value)


def _missing_context(kind: str, task: Column, context: Column) -> Column:
    """Whether a task points to material that isn't text and that no filled context entry has in its name."""
    named = F.exists(F.map_entries(context), lambda e: (F.coalesce(e["value"], F.lit("")) != "") & e["key"].rlike("(?i)" + "|".join(CONTEXT_NAMES[kind])))
    return task.rlike("(?i)" + REFERENCES[kind]) & ~F.coalesce(named, F.lit(False))


#: Columns built in this application; the checkers are thousands of calls into the JVM.
_BUILT: dict = {}


def _once(name: object, build: Callable[[], object]) -> object:
    """build(), or what it gave before in the same Spark application."""
    context = SparkContext._active_spark_context
    if context is None:
        return build()
    key = (context.applicationId, name)
    if key not in _BUILT:
        _BUILT[key] = build()
    return _BUILT[key]


def standard_checks(names: Sequence[str] | None = None) -> list[Check]:
    """All checkers, or those named; only what is asked for is built, once in an application."""
    return list(_once(("checks", names if names is None else tuple(names)), lambda: _standard_checks(names)))


def _standard_checks(names: Sequence[str] | None) -> list[Check]:
    c = F.col
    task, gold, choices, ev, out, context = c("task"), c("gold"), c("choices"), c("evaluator"), c("output_contract"), c("__context")
    yes, static = F.lit(True), "static_rule"
    answers, seen = c("__answers"), c("__gold")  # of prepared()
    kind, single = answers["kind"], answers["cardinality"] == "single"
    has_gold, has_choices, has_out, has_ev = F.coalesce(gold != "", F.lit(False)), F.size(choices) > 0, ~X.blank(out), ~X.blank(ev)
    loose = F.transform(choices, X.normalize_choice)
    metadata = lambda *keys: F.exists(F.map_keys("metadata"), lambda k: k.isin(*keys))
    any_case = lambda *keys: F.exists(F.map_keys("metadata"), lambda k: F.lower(k).isin(*keys))
    may_ask = F.coalesce(c("__shape").isin(*ANSWER_SHAPES), F.lit(True))
    number = X.parse_number(gold)
    low = lambda: F.lower(F.regexp_replace(task, r"(?U)\s+", " "))
    off = lambda: F.abs(arithmetic_value(task) - number) > 1e-9
    ok = lambda x: A.accept(x, seen, answers, choices, ev, c("aliases"))
    told_off = c("__alias_rejected")  # of prepared()
    rejected = lambda vs: F.exists(vs, lambda v: ~ok(v))
    survived = lambda: F.filter(A.mutations(gold, kind, choices), ok)
    plain = single & kind.isin("choice", "numeric", "normalized_exact")
    severity = F.when(has_out & ~has_gold, "major").when(plain, "minor").otherwise("major")
    norm_ev, norm_out = X.normalize_text(ev), X.normalize_text(out)
    mismatch = (has_choices & norm_out.rlike("numeric|number|free.?text")) | (norm_out.rlike("json") & norm_ev.rlike("exact|numeric|choice")) | (norm_out.rlike("numeric|number") & norm_ev.rlike("choice"))
    unit_asked = lambda: F.greatest(*[low().rlike(p).cast("int") for p in UNIT_ASKED]) == 1
    whole = F.concat(task, F.lit("\n"), F.array_join(choices, " "))
    built = [
        ("task_specification", lambda: Check(
            "task_specification",
            yes,
            [
                finding(static, "missing_task", X.blank(task), "critical", "canonical_task_absence"),
                *[finding(static, "missing_context", _missing_context(k, task, context), review=True) for k in REFERENCES],
                *[finding(static, "ambiguous_goal", ~X.blank(task) & may_ask & task.rlike("(?i)" + p) & ~metadata("source", "version", "date", "domain"), "review", review=True) for p in AMBIGUITY],
            ],
        )),
        ("context_attachment", lambda: Check("context_attachment", yes, [finding(static, "context_version_mismatch_risk", may_ask & task.rlike(VERSIONED) & ~any_case("version", "source", "date", "release"), "review", review=True)])),
        ("expected_output", lambda: Check(
            "expected_output",
            yes,
            [
                finding(static, "missing_output_contract", ~has_out & ~has_choices & ~has_ev, "review", review=True),
                finding("cross_artifact_consistency", "output_format_overstrict_risk", number.isNotNull() & (kind == "numeric") & task.rlike(APPROXIMATE) & ~((number == F.floor(number)) & low().rlike(COUNTED)), "review", review=True),
                finding(static, "missing_accepted_alternatives", has_out & number.isNotNull() & task.rlike(UNITS) & ~out.rlike(UNITS) & ~unit_asked(), "review", review=True),
            ],
        )),
        ("oracle_ground_truth", lambda: Check(
            "oracle_ground_truth",
            yes,
            [
                finding(static, "missing_oracle", ~has_gold, "critical"),
                finding(static, "unexpected_invisible_or_control_gold", has_gold & (X.invisible_count(gold) > 0), "major", "oracle_unicode_integrity_replay"),
                finding(static, "invalid_choice_gold", has_choices & has_gold & seen["index"].isNull(), "critical", "choice_gold_domain_replay"),
                finding(static, "duplicate_choices", has_gold & (F.size(F.array_distinct(loose)) < F.size(choices)), "review"),
                finding(static, "empty_choice", has_gold & F.exists(choices, X.blank), "major"),
                finding(static, "wrong_gold_answer", has_gold & off(), "critical", "safe_arithmetic_replay"),
            ],
        )),
        ("evaluator", lambda: Check(
            "evaluator",
            yes,
            [
                finding(static, "missing_evaluator", ~has_ev & (has_gold | has_out), severity, review=True),
                finding(static, "overstrict_evaluator", told_off, "major", "declared_alias_replay", True),
                finding(static, "output_format_overstrict_risk", single & (kind == "exact") & ~told_off & rejected(A.format_variants(gold, answers, choices)), "review", review=True),
                finding(static, "underconstrained_evaluator_risk", ~has_ev & ~has_out & ~has_choices, "review", review=True),
            ],
        )),
        ("contract_consistency", lambda: Check("contract_consistency", has_out | has_choices, [finding("cross_artifact_consistency", "output_evaluator_contract_mismatch", mismatch, "major", "answer_contract_static_consistency")])),
        ("evaluator_replay", lambda: Check("evaluator_replay", has_gold & has_ev, [finding("evaluator_replay", "gold_rejected_by_evaluator", ~ok(gold), "critical", "declared_evaluator_gold_replay")])),
        ("metamorphic_answer", lambda: Check("metamorphic_answer", has_gold, [finding("metamorphic_testing", "metamorphic_inconsistency", rejected(A.variants(gold, answers, choices, c("aliases"))), "major", review=True)])),
        ("evaluator_mutation", lambda: Check("evaluator_mutation", has_gold & has_ev, [finding("mutation_testing", "evaluator_mutation_survived", F.size(survived()) > 0, "major", review=True)])),
        ("task_integrity", lambda: Check(
            "task_integrity",
            ~X.blank(task),
            [
                finding("task_integrity_rule", "temporal_scope_missing", task.rlike(TEMPORAL) & ~task.rlike(YEAR) & ~any_case("date", "as_of", "timestamp", "release_date", "version"), "review", review=True),
                finding("task_integrity_rule", "source_reference_missing", task.rlike(UNNAMED_SOURCE) & ~task.rlike(NAMED_SOURCE) & (F.size(context) == 0), "review", review=True),
                finding("task_integrity_rule", "incomplete_task_instruction", F.greatest(*[F.trim(task).rlike(p).cast("int") for p in BROKEN_INSTRUCTION]) == 1, "review", review=True),
                finding("task_integrity_rule", "presentation_corruption", F.greatest(*[whole.rlike(p).cast("int") for p in BROKEN_TEXT]) == 1, "review", review=True, scope="presentation"),
            ],
        )),
    ]
    return [make() for name, make in built if names is None or name in names]


def prepared(items: DataFrame) -> DataFrame:
    """items plus their answer contract and the view of their gold, each computed once, and what may be missing of context and shape."""
    c = F.col
    context = F.coalesce(c("context"), F.create_map().cast("map<string,string>")) if "context" in items.columns else F.create_map().cast("map<string,string>")
    shape = c("task_shape") if "task_shape" in items.columns else F.lit(None).cast("string")
    items = items.withColumns({"__context": context, "__shape": shape})
    view = _once("prepared", lambda: (
        A.contract(c("evaluator"), c("output_contract"), c("gold"), c("choices")), A.view(c("gold"), c("choices")),
        F.coalesce((c("__answers")["cardinality"] != "set") & F.exists("aliases", lambda a: ~A.accept(a, c("__gold"), c("__answers"), c("choices"), c("evaluator"), c("aliases"))), F.lit(False)),
    ))
    return items.withColumn("__answers", view[0]).withColumn("__gold", view[1]).withColumn("__alias_rejected", view[2] if "aliases" in items.columns else F.lit(False))


def with_audit(items: DataFrame, checks: Sequence[Check] | None = None) -> DataFrame:
    """items plus `audit`: array of struct(checker, eligible, findings), one element per checker, in one projection."""
    checks = list(checks or standard_checks())
    cells = [F.struct(F.lit(k.name).alias("checker"), F.coalesce(k.eligible, F.lit(False)).alias("eligible"), F.array_compact(F.array(*k.findings)).alias("findings")) for k in checks]
    return prepared(items).withColumn("audit", F.array(*cells)).drop("__answers", "__gold", "__context", "__shape", "__alias_rejected")


def findings(audited: DataFrame) -> DataFrame:
    """One row per finding, with item_id and checker; an ineligible checker's findings don't count. The outer explodes keep Spark
    from working all checks out once more in filters of its own."""
    cell = audited.select("item_id", F.explode_outer("audit").alias("a")).where("a.eligible")
    each = cell.select("item_id", F.col("a.checker").alias("checker"), F.explode_outer("a.findings").alias("f")).where("f is not null")
    return each.select("item_id", "checker", "f.*")


def ledger(audited: DataFrame) -> DataFrame:
    """One row per item and checker: ineligible, finding or completed_no_finding (which never means clean)."""
    cell = audited.select("item_id", F.explode_outer("audit").alias("a"))
    n = F.size("a.findings")
    status = F.when(~F.col("a.eligible"), "ineligible").when(n > 0, "finding").otherwise("completed_no_finding")
    return cell.select("item_id", F.col("a.checker").alias("checker"), F.col("a.eligible").alias("eligible"), status.alias("status"), F.when(F.col("a.eligible"), n).otherwise(0).alias("n_findings"))


def multiplicity(task: Column) -> Column:
    """by_design if a task declares that several outputs are right, ambiguous if it only speaks of randomness, else priority."""
    plain = F.regexp_replace(F.coalesce(task, F.lit("")), r"(?is)BEGIN\s+SOLUTION.*$", "")
    plain = F.regexp_replace(plain, r"(?is)<code>.*?</code>", " ")
    has = lambda k: plain.rlike("(?i)" + MULTIPLICITY[k])
    return F.when(has("order_agnostic") | has("existential") | has("explicit_multiple"), "by_design").when(has("randomness"), "ambiguous").otherwise("priority")


OPERATORS: dict[str, Callable[[Column, Column], Column]] = {
    "eq": lambda a, b: a == b,
    "ne": lambda a, b: a != b,
    "lt": lambda a, b: a < b,
    "le": lambda a, b: a <= b,
    "gt": lambda a, b: a > b,
    "ge": lambda a, b: a >= b,
    "contains": F.contains,
    "matches": lambda a, b: F.regexp_like(a, b),
}


def rule(spec: dict) -> Column:
    """A declarative rule as a three-valued column: {"all": [...]}, {"any": [...]}, {"not": r}, {"exists": field} or
    {"op": name, "field": f, "value": v, "as": type}. A missing operand makes a comparison false; a value that can't be read as
    the type asked for leaves it unknown, and all and any follow SQL's three-valued logic."""
    if "all" in spec or "any" in spec:
        parts = [rule(r) for r in spec.get("all", spec.get("any"))]
        out = parts[0]
        for p in parts[1:]:
            out = out & p if "all" in spec else out | p
        return out
    if "not" in spec:
        return ~rule(spec["not"])
    if "exists" in spec:
        return F.col(spec["exists"]).isNotNull()
    field = F.col(spec["field"])
    value = field.try_cast(spec["as"]) if "as" in spec else field
    return F.when(field.isNull(), False).otherwise(OPERATORS[spec["op"]](value, F.lit(spec["value"])))


def leaked_lines(patch: Column, task: Column, hints: Column | None = None) -> Column:
    """struct(lines, leaked, defect, confidence) of a patch whose substantive added lines a task, or else only its hints, contain."""
    lines = X.added_lines(patch)
    hit = F.filter(lines, lambda s: F.contains(task, s))
    hinted = F.filter(lines, lambda s: F.contains(F.coalesce(hints, F.lit("")), s)) if hints is not None else A.none_of()
    share = F.size(hit) / F.greatest(F.size(lines), F.lit(1))
    sure = F.least(F.lit(0.9), 0.55 + 0.25 * share + 0.03 * F.least(F.size(hit), F.lit(3)))
    defect = F.when(F.size(hit) > 0, "solution_leak").when(F.size(hinted) > 0, "hints_only_solution_leak")
    return F.struct(F.size(lines).alias("lines"), F.size(hit).alias("leaked"), defect.alias("defect"), sure.alias("confidence"))
