import pytest
from pyspark.sql import functions as F

from lodestone.operators import contracts, evidence, metrics, tables
from lodestone.sources import adapter, readers


def test_path_conflicts(spark):
    rows = [("a", "Read `in.csv`. Save the table to `out.csv` and write notes.", ["out.csv", "log.txt"], ["in.csv", "log.txt"])]
    r = contracts.path_conflicts(spark.createDataFrame(rows, "item_id string, task string, required_files array<string>, input_files array<string>")).first()
    assert (r["extra"], r["untested"], r["reused"]) == ([], ["log.txt"], ["log.txt"])


def test_pretty_rubric(spark):
    got = spark.createDataFrame([("[+2] names the city\n[-1] invents a date\nfree text",), (None,)], "t string").select(contracts.pretty_rubric(F.col("t")).alias("r")).collect()
    assert [tuple(x) for x in got[0]["r"]] == [(2, "names the city"), (-1, "invents a date")] and got[1]["r"] == []


def test_listing(spark, tmp_path):
    (tmp_path / "pkg").mkdir()
    (tmp_path / "pkg" / "rubric.md").write_text("x")
    (tmp_path / "pkg" / "items.jsonl").write_text("{}")
    got = {r["path"]: (r["kind"], r["size"]) for r in contracts.listing(spark.read.format("binaryFile").load(str(tmp_path / "pkg")), "pkg").collect()}
    assert got == {"rubric.md": ("evaluator", 1), "items.jsonl": ("dataset", 2)}


@pytest.mark.parametrize(("args", "want"), [((100, 10, 90, 20, 0.5), (10, 10)), ((100, 50, 50, 20, 0.5), (10, 10)), ((30, 28, 2, 20, 0.5), (18, 2)), ((5, 3, 2, 20, 0.5), (3, 2))])
def test_sampling_quotas(args, want):
    assert metrics.sampling_quotas(*args) == want


def test_quorum_ties(spark):
    votes = [("a", "x"), ("a", "x"), ("a", "y"), ("b", "x"), ("b", "y"), ("c", "x")]
    got = {r["item_id"]: r["verdict"] for r in evidence.quorum(spark.createDataFrame(votes, "item_id string, verdict string"), 2).collect()}
    assert got == {"a": "x", "b": "uncertain", "c": "uncertain"}


def test_surface_only_conflict(spark):
    rows = [("What?", "Paris."), ("what? ", "paris"), ("Who?", "A1"), ("who?", "B2"), ("Same", "x"), ("same", "x")]
    got = sorted(r["verdict"] for r in tables.duplicate_tasks(spark.createDataFrame(rows, "task string, gold string")).collect())
    assert got == ["conflicting_duplicate_oracle", "duplicate_task", "surface_only_review"]


def test_task_signature(spark):
    """Context, choices and contract tell tasks apart; case, white space and the order of context names don't."""
    schema = "task string, gold string, choices array<string>, output_contract string, context map<string,string>"
    base = ("Pick", "A", ["x", "y"], "label", {"a": "1", "b": "2"})
    rows = [base, ("pick ", "B", ["X", "y"], "Label", {"b": "2", "a": "1"}), ("Pick", "A", ["y", "x"], "label", base[4]), ("Pick", "A", base[2], "number", base[4]), ("Pick", "A", base[2], "label", {"a": "1"}), ("Pick", "A", None, None, None), ("Pick", None, [], "", {})]
    got = sorted(tuple(r)[1:] for r in tables.duplicate_tasks(spark.createDataFrame(rows, schema)).collect())
    assert got == [(2, 1, "duplicate_task"), (2, 2, "conflicting_duplicate_oracle")]
    assert tables.duplicate_tasks(spark.createDataFrame([], schema)).count() == 0


def test_adapter_abstains(spark):
    rows = spark.createDataFrame([(1, '{"a": {"b": "x"}}', "q"), (2, "bad", "q")], "id long, raw string, name string")
    out = adapter.project(rows, "id", [adapter.Binding("gold", path="raw.$.a.b", required=True), adapter.Binding("task", template="<{name}>")]).collect()
    assert [(r["gold"], r["task"], r["abstains"]) for r in out] == [("x", "<q>", False), (None, "<q>", True)]


def test_sinks_and_responses(spark, tmp_path):
    (tmp_path / "m1.jsonl").write_text('{"id": "a", "correct": true}\n{"id": "b", "correct": false}\n')
    got = readers.scan_responses(spark, str(tmp_path / "m1.jsonl"))
    assert sorted(map(tuple, got.collect())) == [("m1", "a", 1), ("m1", "b", 0)]
    readers.write_jsonl(got, str(tmp_path / "out"))
    assert spark.read.json(str(tmp_path / "out")).count() == 2
