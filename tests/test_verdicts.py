"""Profiles, adapter sources, set answers and votes: branches, nulls, empties, ties, repeats."""

import pytest
from pyspark.sql import functions as F

from lodestone.functions import answers as A
from lodestone.operators import profiles, votes


def raws(spark, *texts):
    return spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "source_row_index long, j string").select("source_row_index", F.parse_json("j").alias("raw"))


def test_a_profile_merges_types_and_keeps_few_examples(spark):
    deep = '{"a":' * 11 + "1" + "}" * 11
    rows = raws(spark, '{"x": 1, "l": [1, null, {"y": true}], "s": "%s"}' % ("é" * 200), '{"x": 1.0, "l": []}', '{"x": true}', '{"x": null, "a.b": {"": "q"}}', deep, "[1]", None, '{"x": 100000000000000000000}', '{"x": 1}')
    got = {tuple(r["path"]): r for r in profiles.profile(rows).collect()}
    x = got["x",]
    assert x["present"] == 6 and x["types"] == ["boolean", "integer", "null", "number"] and len(set(x["examples"])) == 2
    assert got["l",]["types"] == ["array"] and got["l",]["element_types"] == ["integer", "null", "object"] and set(got["l",]["examples"]) == {'[1,null,{"y":true}]', "[]"}
    assert got["s",]["examples"] == ['"' + "é" * 160 + '"'] and got["a.b", ""]["examples"] == ['"q"']
    assert ("a",) * 10 in got and ("a",) * 11 not in got and ("l", "y") not in got
    assert got["a",]["examples"] == ['{"a":{"a":{"a":"<object>"}}}']
    many = raws(spark, *['{"x": %d}' % i for i in range(40)])
    assert len(profiles.profile(many, examples=5).first()["examples"]) >= 3 and profiles.profile(many, examples=0).first()["examples"] == []
    assert profiles.profile(rows.limit(0)).count() == 0


def test_fingerprints_tell_structure_from_values(spark):
    of = lambda *texts: profiles.fingerprint(profiles.profile(raws(spark, *texts))).first()
    one = of('{"a": 1, "b": [1]}', '{"a": "x"}')
    assert one["n_paths"] == 2 and one == of('{"a": "other"}', '{"b": [5, 6], "a": 7}', '{"a": 3}')
    assert one["fingerprint"] != of('{"a": 1, "b": ["1"]}', '{"a": "x"}')["fingerprint"] != of('{"a": 1}')["fingerprint"]
    wide = "{" + ", ".join(f'"k{i}": {i}' for i in range(513)) + "}"
    with pytest.raises(Exception, match="more than 512 paths"):
        of(wide)
    assert of(wide[: wide.rindex(",")] + "}")["n_paths"] == 512


def test_sources_are_checked_against_what_was_seen(spark):
    seen = profiles.profile(raws(spark, '{"t": "x", "n": 1, "o": {"k": []}, "m": "x"}', '{"m": {}}'))
    S = profiles.Source
    cases = [
        (S("task", ("t",)), ["string"], None), (S("task", ("n",)), ["integer"], "unexpected_type"), (S("task", ("n",), ("stringify", "strip")), ["string"], None),
        (S("choices", ("m",), ("parse_jsonish",)), list(profiles.TYPES), "unexpected_type"), (S("choices", ("o", "k"), ("parse_jsonish",)), ["array"], None),
        (S("item_id", ("m",), ("strip",)), ["string"], "strip_of_non_strings"), (S("item_id", ("gone",)), None, "absent_path"), (S("task", ("t",), ("upper",)), ["string"], "unsupported_transform"),
        (S("task", ("n",), (), "template"), ["string"], None), (S("task", ("o",), (), "template"), ["string"], "template_of_non_scalar"), (S("context", ("n",), (), "field"), ["object"], None),
    ]
    sources = profiles.source_rows(spark, [s for s, _, _ in cases] + [cases[0][0]])
    got = {(r["target"], tuple(r["path"]), tuple(r["transforms"]), r["part"]): (r["result_types"], r["issue"]) for r in profiles.checked_sources(sources, seen).collect()}
    assert got == {(s.target, s.path, s.transforms, s.part): (types, issue) for s, types, issue in cases}
    assert profiles.checked_sources(sources, seen).count() == 12 and profiles.checked_sources(sources.limit(0), seen).count() == 0


def test_gaps_of_specs_without_targets_and_of_unknown_families(spark):
    rows = spark.createDataFrame([(1, "swebench", "task"), (1, "swebench", "task"), (1, "swebench", "repo"), (2, None, None), (3, "odd", "task")], "spec int, family string, target string")
    got = {(r["spec"], r["component"]): (r["status"], r["missing"]) for r in profiles.component_gaps(rows).collect()}
    assert got[1, "canonical_task"] == ("resolved", []) and got[1, "repository_identity"] == ("unresolved", ["base_commit"]) and got[2, "canonical_task"] == ("unresolved", ["task"])
    assert got[3, "canonical_task"][0] == "resolved" and got[3, "trace_parser"] == ("requires_trusted_plugin", []) and len(got) == 9 + 6 + 6


@pytest.mark.parametrize(
    "answer, gold, evaluator, want",
    [
        ("2, 1", "1, 2.0", "numeric set", True), ("1, 1", "1, 2", "numeric set", False), ("1; 1", "1 and 1", "numeric set", True), ("1, x", "1, 2", "numeric set", False), ("1,2,3", "1,2", "numeric set", False),
        ("1.0000000015, 1", "1.0000000008, 1.0000000016", "numeric set", False), ("1, 1.0000000015", "1.0000000008, 1.0000000016", "numeric set", True), ("1/2, 3:4", "0.75, 0.5", "ratio set", True),
        ("The cat, dog", "Dog; cat", "normalized set", True), ("Cat, dog", "cat, dog", "exact set", False), ("dog, cat", "cat, dog", "exact set", True), (None, "a, b", "exact set", False), ("", "a, b", "exact set", False),
        ("1.0 ; Cat;", "1; cat", "normalized compound", True), ("1; cat; 2", "1; cat", "normalized compound", False), ("cat; 1", "1; cat", "normalized compound", False),
    ],
)
def test_sets_match_one_to_one_in_greedy_order(spark, answer, gold, evaluator, want):
    row = spark.createDataFrame([(answer, gold, evaluator)], "a string, g string, e string").withColumn("c", A.none_of())
    answers = A.contract(F.col("e"), F.lit(None).cast("string"), F.col("g"), F.col("c"))
    assert row.select(A.accept(F.col("a"), A.view(F.col("g"), F.col("c")), answers, F.col("c"), F.col("e"), A.none_of())).first()[0] is want


def test_answer_values(spark):
    rows = spark.createDataFrame([(t,) for t in ('["a", null, "", 2]', '"x"', '""', "null", "[]", "1.5", None)], "j string").select(A.answer_values(F.parse_json("j")).alias("v"))
    assert [r["v"] for r in rows.collect()] == [["a", "2"], ["x"], [], [], [], ["1.5"], []]


VERDICT = "row_uid string, stage string, verdict string, defect_type string, answers array<string>, accepted array<string>, has_choices boolean, confidence double, needs_expert boolean, failed boolean"


def test_stages_vote_once_each(spark):
    row = lambda uid, stage, verdict, answers=None, confidence=0.9, defect=None, failed=None, choices=True: (uid, stage, verdict, defect, answers, ["A"], choices, confidence, None, failed)
    rows = [
        row("both", "blind", "solved", ["B"]), row("both", "challenger", "invalid", ["B"], 0.6), row("both", "defender", "supported", None, 0.3),
        row("tie", "blind", "solved", ["B"], 1.0), row("tie", "challenger", "valid", None, 1.0, "wrong_gold_answer"),
        row("names", "blind", "multiple", ["A", "B"]), row("names", "challenger", "invalid", [], 0.9, "none"),
        row("words", "blind", "solved", ["B"], 0.8, choices=False), row("words", "defender", "supported", None, 0.1, failed=True),
        row("only", "challenger", "odd", None, None, "ambiguous_goal"), row("again", "blind", "none", [], 0.2), row("again", "blind", "solved", ["A"], 0.7),
    ]
    table = spark.createDataFrame(rows, VERDICT)
    got = {r["row_uid"]: r for r in votes.stage_evidence(table).collect()}
    told = {k: (r["gold_status"], r["defect_type"], r["confidence"], r["n_stages"]) for k, r in got.items()}
    assert told == {
        "both": ("contradicted", "wrong_gold_answer", 0.4, 3), "tie": ("uncertain", "wrong_gold_answer", 0.5, 2), "names": ("contradicted", "no_correct_answer", 0.45, 2), "words": ("uncertain", "none", 0.0, 1),
        "only": ("supported", "none", 0.0, 2), "again": ("supported", "none", 0.7, 1),
    }
    assert got["only"]["votes"] == ["none", "uncertain"] and got["both"]["answers"] == ["B"] and not got["only"]["needs_expert"]
    found = {r["row_uid"]: (r["defect_type"], r["review_only"]) for r in votes.evidence_findings(votes.stage_evidence(table), confirm=0.46, review=0.4).collect()}
    assert found == {"both": ("wrong_gold_answer", True), "tie": ("wrong_gold_answer", False), "names": ("no_correct_answer", True)}
    assert votes.stage_evidence(table.limit(0)).count() == 0


def test_majorities_and_agreement(spark):
    rows = [(1, 2, "b", "r2"), (1, 1, " a ", "r1"), (1, 3, "a", "r3"), (1, 4, "b", "r4"), (2, 1, None, "x"), (2, 0, "", "y"), (3, 5, "z", None)]
    got = {r["key"]: tuple(r)[1:] for r in votes.majority(spark.createDataFrame(rows, "key int, position int, vote string, result string"), "none").collect()}
    assert got == {1: ("a", 4, 2, "r1"), 2: ("none", 0, 0, "y"), 3: ("z", 1, 1, None)}
    rows = [(1, "d", "x"), (1, "d", "x"), (1, "e", "y"), (1, "e", None), (2, "d", None)]
    got = {(r["key"], r["dimension"]): (r["value"], r["disputed"]) for r in votes.agreed(spark.createDataFrame(rows, "key int, dimension string, value string")).collect()}
    assert got == {(1, "d"): ("x", None), (1, "e"): ("other", "votes split between None, y"), (2, "d"): (None, None)}
