import json
import math

import pytest
from pyspark.sql import functions as F

from lodestone.operators import checks, evidence, responses, tables
from lodestone.sources import readers
from lodestone.streaming import audit as streaming

ROWS = [
    {"id": "a", "question": "Calculate 9 - 4 * 2", "answer": "10", "evaluator": "numeric"},
    {"id": "b", "question": "Pick one", "choices": ["x", "y", "y"], "answer": "None of it", "evaluator": "choice"},
    {"id": "c", "question": "", "answer": "1", "evaluator": "exact"},
    {"question": "Name it", "answer": "Ber​lin", "aliases": ["Berlino"], "evaluator": "exact"},
]


@pytest.fixture
def items(spark, tmp_path):
    (tmp_path / "x.jsonl").write_text("\n".join(map(json.dumps, ROWS)) + "\n\n")
    return readers.items(readers.scan_jsonl(spark, str(tmp_path / "x.jsonl")))


def test_scan_and_check(items):
    found = {(r["item_id"], r["defect_type"]) for r in checks.findings(checks.with_audit(items)).collect()}
    assert {("a", "wrong_gold_answer"), ("b", "invalid_choice_gold"), ("b", "duplicate_choices"), ("c", "missing_task"), ("item-3", "unexpected_invisible_or_control_gold"), ("item-3", "overstrict_evaluator")} <= found


def test_promotion_is_fail_closed(items):
    tiers = {(r["item_id"], r["defect_type"]): r["tier"] for r in evidence.promote(checks.findings(checks.with_audit(items))).collect()}
    assert tiers["a", "wrong_gold_answer"] == "confirmed"
    assert tiers["b", "duplicate_choices"] == "review"
    assert tiers["item-3", "overstrict_evaluator"] == "review"


def test_ledger_has_every_cell(items):
    led = checks.ledger(checks.with_audit(items))
    assert led.count() == items.count() * len(checks.standard_checks())
    assert led.where("status = 'clean'").count() == 0


BLANK = {"task": "Name it.", "choices": [], "gold": "x", "aliases": [], "output_contract": "one word", "evaluator": "loose", "metadata": {}, "context": {}, "task_shape": None}
CASES = [
    ({"task": None}, ["missing_task"]), ({"task": " ", "gold": None}, ["missing_task", "missing_oracle"]),
    ({"task": "See the attached figure and the provided file."}, ["missing_context", "missing_context"]), ({"task": "See the attached figure.", "context": {"Images": "a.png", "other": ""}}, []), ({"task": "See the attached figure.", "context": {"image": "", "table": "t"}}, ["missing_context"]),
    ({"task": "Read the passage above."}, []), ({"task": "Name the best and most recent one"}, ["ambiguous_goal", "ambiguous_goal"]), ({"task": "Name the best one.", "metadata": {"source": "s"}}, []), ({"task": "Name the best one.", "task_shape": "instruction"}, []),
    ({"task": "Name the best one.", "task_shape": "multiple_choice"}, ["ambiguous_goal"]), ({"task": "Name the current version."}, ["ambiguous_goal", "context_version_mismatch_risk", "temporal_scope_missing"]), ({"task": "Name the version.", "metadata": {"Version": "1"}}, []),
    ({"output_contract": "", "evaluator": None}, ["missing_evaluator", "missing_output_contract", "underconstrained_evaluator_risk"]), ({"output_contract": None, "evaluator": "", "choices": ["x", "y"]}, ["missing_evaluator"]),
    ({"task": "About how tall is it?", "gold": "12", "evaluator": "numeric"}, ["output_format_overstrict_risk"]), ({"task": "About how many boxes fit?", "gold": "12", "evaluator": "numeric"}, []), ({"task": "About how many boxes fit?", "gold": "12.5", "evaluator": "numeric"}, ["output_format_overstrict_risk"]),
    ({"task": "It costs one dollar each. Total?", "gold": "12", "evaluator": "numeric"}, ["missing_accepted_alternatives"]), ({"task": "It costs one dollar each. How much money?", "gold": "12", "evaluator": "numeric"}, []), ({"task": "It costs one dollar each. Total?", "gold": "12", "evaluator": "numeric", "output_contract": "USD"}, []),
    ({"gold": ""}, ["missing_oracle"]), ({"gold": None, "choices": ["a", "a"]}, ["missing_oracle"]), ({"gold": "a", "choices": ["a", "A) a", ""], "output_contract": ""}, ["duplicate_choices", "empty_choice"]), ({"gold": "zz", "choices": ["p", "q"]}, ["invalid_choice_gold"]),
    ({"task": "What is 2024-01-05?", "gold": "5 January 2024"}, []), ({"task": "what is 2**3", "gold": "9"}, ["wrong_gold_answer"]), ({"task": "compute 7//2", "gold": "3"}, []),
    ({"evaluator": "exact", "gold": "Ab", "aliases": ["ab"]}, ["overstrict_evaluator", "metamorphic_inconsistency"]), ({"evaluator": "exact", "gold": "Ab"}, ["output_format_overstrict_risk"]), ({"evaluator": "exact", "gold": "-"}, []), ({"evaluator": "alias exact", "gold": "42", "aliases": ["43"]}, []),
    ({"evaluator": "set match", "gold": "a, b", "aliases": ["zz"]}, []), ({"evaluator": None, "gold": "a, b", "output_contract": "a list"}, ["missing_evaluator"]), ({"task": "A new study says what?"}, ["source_reference_missing"]), ({"task": "A new study says what?", "context": {"s": "t"}}, []), ({"task": "The report of 2019 says what?"}, []),
    ({"task": "Members are serving - year terms. Choose"}, ["incomplete_task_instruction"]), ({"task": "Itâ€™s 10^"}, ["presentation_corruption"]), ({"choices": ["3-Mar", "x"]}, ["presentation_corruption"]), ({"task": "As of now, who leads?", "metadata": {"date": "d"}}, ["context_version_mismatch_risk"][:0]),
]


def test_checkers_case_by_case(spark):
    """Each branch of each checker alone, with what must not be found beside it."""
    schema = "item_id long, task string, choices array<string>, gold string, aliases array<string>, output_contract string, evaluator string, metadata map<string,string>, context map<string,string>, task_shape string"
    df = spark.createDataFrame([{"item_id": i, **BLANK, **change} for i, (change, _) in enumerate(CASES)], schema)
    found = {}
    for r in checks.findings(checks.with_audit(df)).collect():
        found.setdefault(r["item_id"], []).append(r["defect_type"])
    for i, (change, want) in enumerate(CASES):
        assert sorted(found.get(i, [])) == sorted(want), change


def test_bad_rows_are_refused(spark, tmp_path):
    (tmp_path / "bad.jsonl").write_text('{"id": 1}\n[1, 2]\n')
    with pytest.raises(readers.BadRows):
        readers.scan_jsonl(spark, str(tmp_path / "bad.jsonl"))


@pytest.mark.parametrize("text", ['[{"id": 1}, {"id": 2}]', '{"items": [{"id": 1}, {"id": 2}]}'])
def test_scan_json(spark, tmp_path, text):
    (tmp_path / "x.json").write_text(text)
    assert readers.scan_json(spark, str(tmp_path / "x.json")).count() == 2


def test_empty_items(spark, items):
    none = items.limit(0)
    assert checks.findings(checks.with_audit(none)).count() == 0
    assert tables.drift(tables.coverage(none)).count() == 0


def test_rule_logic(spark):
    df = spark.createDataFrame([("5",), ("x",), (None,)], "v string")
    spec = {"op": "gt", "field": "v", "value": 3, "as": "double"}
    assert [r["r"] for r in df.select(checks.rule(spec).alias("r")).collect()] == [True, None, False]
    assert [r["r"] for r in df.select(checks.rule({"any": [spec, {"exists": "v"}]}).alias("r")).collect()] == [True, True, False]


def test_leaked_lines(spark):
    patch = "--- a\n+++ b\n+    return compute_total(order)\n+# note\n-old\n"
    df = spark.createDataFrame([(patch, "just call return compute_total(order) there"), (patch, "nothing")], "p string, t string")
    got = [r["x"]["defect"] for r in df.select(checks.leaked_lines(F.col("p"), F.col("t")).alias("x")).collect()]
    assert got == ["solution_leak", None]


def test_streamed_findings_equal_batch(spark, items, tmp_path):
    items.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(items.schema).parquet(str(tmp_path / "in"))
    streaming.run_once(streaming.stream_findings(stream), "streamed")
    assert spark.table("streamed").count() == checks.findings(checks.with_audit(items)).count()


def test_windowed_counts(spark):
    events = streaming.replay(spark, "/root/testdata/sf0.001", "events")
    streaming.run_once(streaming.windowed_counts(events), "counted", "complete")
    assert spark.table("counted").agg(F.sum("n")).first()[0] == spark.read.parquet("/root/testdata/sf0.001/events.parquet").count()


def test_rank_correlations_of_ties(spark):
    of = lambda rows: responses.rank_correlations(spark.createDataFrame(rows, "system_id string, x double, y double")).first()
    for rows in ([("a", 4.4, 1.0), ("b", 4.4, 2.0), ("c", 4.4, 3.0)], [("a", 4.4, 4.5), ("b", 4.4, 4.5), ("c", 4.4, 4.5)]):  # all systems tie
        r = of(rows)
        assert (r["n"], r["tau_a"], r["flips"]) == (3, 0, 0) and all(math.isnan(r[c]) for c in ("tau_b", "spearman", "pearson"))
    one = of([("a", 1.0, 2.0)])
    assert (one["n"], one["tau_a"], one["tau_b"], one["flips"]) == (1, None, None, None)
    none = of([])
    assert (none["n"], none["tau_a"], none["tau_b"], none["spearman"], none["pearson"], none["flips"]) == (0, None, None, None, None, None)
    r = of([("a", 1.0, 2.0), ("b", 1.0, 1.0), ("c", 2.0, 3.0)])
    assert r["tau_a"] == pytest.approx(2 / 3) and r["tau_b"] == pytest.approx(2 / math.sqrt(6)) and r["flips"] == 0
