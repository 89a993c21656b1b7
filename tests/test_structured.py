"""Placement and fusion of findings, schema validation, comparison forms, states, claims: branches, nulls, empties, ties, repeats."""

import json

import pytest
from pyspark.sql import functions as F

from lodestone.functions import canonical as K
from lodestone.operators import checks, fusion, schemas, search, states

FINDING = "row_uid string, item_id string, method string, defect_type string, severity string, review_only boolean, defect_scope string, needs_expert boolean"
AGAINST = "array<struct<reason:string,methods:array<string>>>"


def test_row_uids_become_unique(spark):
    rows = [("a", 3), ("a", 1), (None, 2), ("", 4), ("b", 5), ("audit-row-00000002", 6)]
    got = fusion.unique_row_uids(spark.createDataFrame(rows, "row_uid string, source_row_index long"))
    assert {r["source_row_index"]: r["row_uid"] for r in got.collect()} == {1: "a", 3: "audit-row-00000003", 2: "audit-row-00000002-dup", 4: "audit-row-00000004", 5: "b", 6: "audit-row-00000002"}
    assert got.columns == ["row_uid", "source_row_index"]


def test_an_item_id_that_repeats_places_nothing(spark):
    items = spark.createDataFrame([("r1", "one"), ("r2", "two"), ("r3", "two"), ("r4", None)], "row_uid string, item_id string")
    rows = [("r2", "one"), ("r9", "one"), (None, "one"), (None, "two"), (None, "three"), (None, None)]
    found = spark.createDataFrame(rows, "row_uid string, item_id string")
    got = {(r["row_uid"], r["item_id"], r["resolution"]) for r in fusion.on_items(found, items).collect()}
    assert got == {("r2", "one", "row_uid"), ("r9", "one", "unknown_row"), ("r1", "one", "item_id"), (None, "two", "ambiguous_item_id"), (None, "three", "unknown_item_id"), (None, None, "unknown_item_id")}
    assert fusion.on_items(found.limit(0), items).count() == 0


def test_contradictions(spark):
    schema = "status string, correct array<string>, statuses array<struct<label:string,best_answer_status:string>>, defect string, cardinality string, declared string"
    rows = [
        ("contradicted", ["b ", None, ""], [("a", "best"), ("C", "wrong"), (None, "best")], None, None, " a"),
        ("supported", ["A"], [("A", "acceptable")], "multiple_correct_answers", "exactly_one", "A"),
        (None, None, None, "no_correct_answer", "exactly_one", None), (None, None, None, None, None, None), (None, [], [], "no_correct_answer", "several", ""),
    ]
    got = spark.createDataFrame(rows, schema).select(fusion.contradictions(*[F.col(c) for c in ("status", "correct", "statuses", "defect", "cardinality", "declared")]).alias("c"))
    got = [[(c["reason"], len(c["methods"])) for c in r["c"]] for r in got.collect()]
    assert got[0] == [("gold correct_answers=['B'] conflicts with option best_answers=['A']", 2), ("gold auditor contradicts the declared gold while option auditor still marks it as best", 2)]
    assert got[1] == [("option defect says multiple_correct_answers but cardinality is exactly_one", 1)]
    assert got[2] == [("option defect says no_correct_answer but cardinality is exactly_one", 1)] and got[3:] == [[], []]


def test_fusion(spark):
    both = [("they differ", ["llm_gold_audit", "llm_option_set"])]
    items = spark.createDataFrame([("r1", "i1", both), ("r2", "i2", []), ("r3", "i3", None), ("r4", "i4", both)], f"row_uid string, item_id string, contradictions {AGAINST}")
    rows = [
        ("r1", "i1", "llm_gold_audit+vote", "wrong_gold_answer", "major", False, "substantive", True), ("r1", "i1", "static_rule", "missing_task", "critical", False, "substantive", None), ("r1", "i1", "llm_question_clarity", "missing_task", "major", False, "substantive", False),
        ("r1", "i1", "llm_gold_audit", "llm_audit_failure", "major", False, "operational", True), ("r2", "i2", "llm_option_applicability", "x", "major", False, "substantive", False), (None, "i3", "llm_option_set", "y", "major", False, "substantive", True),
        (None, "gone", "llm_option_applicability", "z", "major", True, "substantive", None), (None, "gone too", "llm_gold_audit", "z", "major", False, "substantive", None),
    ]
    got = fusion.fuse(spark.createDataFrame(rows, FINDING), items).collect()
    at = {(r["item_id"], r["method"], r["defect_type"]): r for r in got}
    assert len(got) == len(rows) + 1  # r4 has no finding, so nothing is said of it
    first = at["i1", "llm_gold_audit+vote", "wrong_gold_answer"]
    assert (first["severity"], first["review_only"], first["auditor_contradictions"]) == ("review", True, ["they differ"]) and first["llm_corroborated_by"] is None
    assert at["i1", "static_rule", "missing_task"]["severity"] == "critical" and at["i1", "llm_gold_audit", "llm_audit_failure"]["review_only"] is False
    clear = at["i1", "llm_question_clarity", "missing_task"]
    assert clear["corroborated_by_non_llm"] and clear["llm_corroborated_by"] == ["llm_gold_audit", "llm_question_clarity"] and not clear["review_only"]
    assert at["i2", "llm_option_applicability", "x"]["exploratory"] and at["i3", "llm_option_set", "y"]["review_only"] and at["i3", "llm_option_set", "y"]["row_uid"] == "r3"
    lost = at["gone", "llm_option_applicability", "z"]
    assert not lost["exploratory"] and lost["llm_corroborated_by"] == ["llm_gold_audit", "llm_option_applicability"]
    new = at["i1", "llm_evidence_fusion", "auditor_contradiction"]
    assert (new["row_uid"], new["severity"], new["review_only"], new["defect_scope"]) == ("r1", "review", True, "operational")


def plain_issues(value, schema, path):
    """The rule once more, by recursion."""
    fits = {"object": dict, "array": list, "string": str, "boolean": bool, "integer": int, "number": (int, float), "null": type(None)}
    kinds = schema.get("type")
    kinds = [kinds] if isinstance(kinds, str) else [k for k in kinds or [] if isinstance(k, str)]
    fit = lambda k: k not in fits or (isinstance(value, fits[k]) and (k not in ("integer", "number") or not isinstance(value, bool)))
    if kinds and not any(map(fit, kinds)):
        return [(path, "type_mismatch")]
    out = [(path, "enum_mismatch")] if isinstance(schema.get("enum"), list) and value not in schema["enum"] else []
    props = schema.get("properties")
    if isinstance(value, dict) and isinstance(props, dict):
        out += [(f"{path}.{k}", "missing_required") for k in schema.get("required", []) if k not in value]
        for k, v in value.items():
            if isinstance(props.get(k), dict):
                out += plain_issues(v, props[k], f"{path}.{k}")
            elif schema.get("additionalProperties") is False:
                out.append((f"{path}.{k}", "unknown_property"))
    if isinstance(value, list) and isinstance(schema.get("items"), dict):
        for i, v in enumerate(value):
            out += plain_issues(v, schema["items"], f"{path}[{i}]")
    return out


SPEC = {
    "type": "object", "required": ["id", "deep"], "additionalProperties": False,
    "properties": {
        "id": {"type": ["integer", "null", 5]}, "kind": {"enum": ["a", 1, None, {"x": [1]}]}, "odd": {"type": "unheard-of"}, "bare": 7,
        "deep": {"type": "object", "properties": {"list": {"type": "array", "items": {"type": "array", "items": {"type": "number", "enum": [1, 2.5, True]}}}}, "required": ["list"]}, "flag": {"type": "boolean"},
    },
}
VALUES = [
    {"id": 1, "deep": {"list": [[1, 2.5], []]}}, {"id": None, "deep": {"list": [[3], 4, [True, "1"]]}}, {"id": 1.5, "deep": {}}, {}, [], None, "x", {"id": True, "deep": None, "more": 1, "bare": 2},
    {"id": 2, "kind": {"x": [1]}, "deep": {"list": []}, "odd": [], "flag": 1}, {"id": 2, "kind": 1.0, "deep": {"list": {}}, "flag": True}, {"id": 2, "kind": "b", "deep": {"list": [[]], "other": 1}}, {"id": 10**25, "kind": None, "deep": {"list": [[1e3]]}},
]


def test_schema_issues_equal_the_recursive_rule(spark):
    context = json.dumps({"z": "text", "tools": [{"name": "f", "parameters": SPEC}, {"function": {"name": "g"}}, {"parameters": {}}, 5, {"name": "f", "parameters": {}}]})
    rows = [(i, json.dumps({f"f_{i}": v}), context) for i, v in enumerate(VALUES)] + [(100, '{"g": 1, "h": 2, "f": {"id": 1, "deep": {"list": []}}}', context), (101, "[]", context), (102, None, context), (103, '{"f": 1}', '{"tools": [{"x": 1}]}'), (104, '{"f": 1}', None), (105, "{}", context), (106, "no json", context)]
    items = spark.createDataFrame(rows, "item_id long, reference_solution string, context string")
    done = schemas.with_schema_issues(items)
    got = {r["item_id"]: None if r["schema_issues"] is None else sorted((i["path"], i["kind"]) for i in r["schema_issues"]) for r in done.collect()}
    for i, v in enumerate(VALUES):
        assert got[i] == sorted(plain_issues(v, SPEC, f"f_{i}")), v
    assert got[100] == [("g", "missing_parameters_schema"), ("h", "missing_function_schema")]
    assert got[101] is None and got[102] is None and got[103] is None and got[104] is None and got[105] == [] and got[106] is None
    assert schemas.issue_rows(done).count() == sum(len(x or []) for x in got.values())
    cells = done.select(F.lit("i").alias("item_id"), "schema_issues", *[F.lit(None).cast("string").alias(c) for c in ("evaluator", "output_contract", "gold")], F.array().cast("array<string>").alias("choices"))
    ledger = checks.ledger(checks.with_audit(cells, [schemas.reference_check()])).groupBy("status").count().collect()
    assert {r["status"]: r["count"] for r in ledger} == {"ineligible": 5, "finding": sum(bool(x) for x in got.values()), "completed_no_finding": sum(x == [] for x in got.values())}


SAME = [["Paris.", "PARIS", " paris  !", "Ｐａｒｉｓ。"], [42, "42.0", "+42", "042", 42.0], ["1,000", 1000.0, 1e3, "1000."[:-1]], [0, "-0", "0.00", ".0"], ["straße", "STRASSE"], [True], ["true"], [None], [""], [[]], [{}], ['42"'], ["42%"], ["-42"], ["1,00"], [[1, "2"], ["1", 2.0]], [[2, 1]], [{"a": "x", "B": ["1"]}, {"b": [1.0], "A ": "X."}], [{"a": {"b": []}}], [{"a": {"b": {}}}], [{"a": {"b": ""}}]]


def test_comparison_forms(spark):
    rows = [(i, json.dumps(v)) for i, group in enumerate(SAME) for v in group] + [(99, None)]
    df = spark.createDataFrame(rows, "g int, j string").withColumn("v", F.try_parse_json("j"))
    forms = {}
    for r in K.with_comparison(df, "v").collect():
        forms.setdefault(r["g"], set()).add(r["comparison"])
    assert forms.pop(99) == {None}
    assert all(len(f) == 1 for f in forms.values()), [SAME[g] for g, f in forms.items() if len(f) > 1]
    assert len(set.union(*forms.values())) == len(SAME)


def test_same_json_and_filled(spark):
    rows = [('{"a":1,"b":2}', '{"b":2,"a":1}', True), ("[1,2]", "[2,1]", False), ("1", '"1"', False), ("1", "1.0", False), (None, None, False), ("null", "null", True), ("{}", "[]", False)]
    df = spark.createDataFrame(rows, "l string, r string, same boolean").select("*", F.try_parse_json("l").alias("a"), F.try_parse_json("r").alias("b"))
    assert all(r["same"] == r["got"] for r in df.select("same", K.same_json(F.col("a"), F.col("b")).alias("got")).collect())
    assert [r[0] for r in df.select(K.filled(F.col("b"))).collect()] == [True, True, True, True, False, False, False]


EVENTS = "array<struct<stage:double,operation:string,amount:double,evidence:string>>"
MODELS = [
    (10.0, None, None, [(2.0, "REMOVE", 12.0, ""), (1.0, "add", 1.0, "")], [("removal_exceeds_available", 12.0, 11.0)]), (10.0, 12.0, None, [(1.0, "add", 1.0, "")], [("final_state_mismatch", 11.0, 12.0)]),
    (None, 3.0, 2.0, [(1.0, "add", 5.0, "")], [("negative_inferred_initial_state", -2.0, 3.0), ("state_exceeds_required_limit", 3.0, 2.0)]), (4.0, None, 3.0, [(1.0, "set", 6.0, "")], [("state_transition_mismatch", 6.0, 4.0), ("state_exceeds_required_limit", 6.0, 3.0)]),
    (4.0, 9.0, None, [(1.0, "set", 9.0, "After he ate\nsome more")], []), (4.0, 9.0, None, [(1.0, "add", None, ""), (2.0, "remove", 99.0, "")], []), (4.0, None, None, [(1.0, "add", -5.0, ""), (1.0, "look", 3.0, ""), (None, "set", 4.0, "")], []),
    (4.0, None, 5.0, [(1.0, "remove", None, ""), (2.0, "set", 9.0, "")], [("state_exceeds_required_limit", 9.0, 5.0)]), (None, None, None, None, []), (float("nan"), 3.0, float("inf"), [], []), (1.0, None, None, [(1.0, "add", 1.0, ""), (1.0, "remove", 2.0, ""), (1.0, "remove", 1.0, "")], [("removal_exceeds_available", 1.0, 0.0)]),
]


def test_state_findings(spark):
    df = spark.createDataFrame([(i, *m[:4]) for i, m in enumerate(MODELS)], f"i int, a double, f double, l double, e {EVENTS}")
    got = df.select("i", states.state_findings(F.col("a"), F.col("f"), F.col("l"), F.col("e")).alias("x")).collect()
    for r in got:
        assert [tuple(x) for x in r["x"]] == MODELS[r["i"]][4], MODELS[r["i"]]


def test_event_state_findings(spark):
    model = "struct<initial_value:double,stated_final_value:double,required_limit:double,confidence:double,material_to_answer:boolean,events:" + EVENTS + ">"
    bad = lambda sure, material: (1.0, None, 0.0, sure, material, [])
    rows = [([bad(0.7, True), bad(0.9, True), bad(0.6, False)], None), ([bad(None, True), bad(0.1, True)], [(0.9, False, False), (0.9, True, True), (0.9, True, None), (0.2, True, False)]), (None, None)]
    df = spark.createDataFrame(rows, f"m array<{model}>, c array<struct<confidence:double,material_to_answer:boolean,same_quantity_justified:boolean>>")
    got = [[tuple(f) for f in r[0]] for r in df.select(states.event_state_findings(F.col("m"), F.col("c"), F.lit(0.5), 0.8, 0.5)).collect()]
    assert got[0] == [("llm_event_state", "ambiguous_goal", 0.9, False, 2), ("llm_event_state_nonmaterial", "ambiguous_goal", 0.6, True, 1)]
    assert got[1] == [("llm_event_state", "ambiguous_goal", 0.0, True, 1), ("llm_event_state_nonmaterial", "ambiguous_goal", 0.9, True, 1)] and got[2] == []


@pytest.mark.parametrize(("left", "relation", "right", "want"), [(1.0, "<=", 1.0, True), (2.0, "<=", 1.0, False), (1.0, ">=", 1.0 + 1e-10, True), (1.0, "<", 1.0 + 1e-10, False), (1.0, "<", 2.0, True), (2.0, ">", 1.0, True), (1.0, "==", 1.5, False), (1.0, "~", 1.0, None), (None, "<", 1.0, None), (float("nan"), "<", 1.0, None)])
def test_relations(spark, left, relation, right, want):
    assert spark.createDataFrame([(left, relation, right)], "l double, r string, x double").select(states.holds(F.col("l"), F.col("r"), F.col("x"))).first()[0] is want


def test_terms_and_snippets(spark):
    df = spark.createDataFrame([("Line one\nhas the WORD here", ["word", "none", None, "line"]), (None, ["a"]), ("", [])], "t string, w array<string>")
    got = [[tuple(s) for s in r[0]] for r in df.select(search.snippets(F.col("t"), F.col("w"))).collect()]
    assert got == [[("word", 17, "Line one has the WORD here"), ("none", None, None), ("line", 0, "Line one has the WORD here")], [("a", None, None)], []]
    terms = df.limit(1).select(search.required_terms(F.array(F.lit("net_profit 12%x"), F.lit(None)), F.lit("NET-PROFIT 1,000.5 预算表 data"))).first()[0]
    assert terms == ["net profit 12%x", "12%", "12", "profit", "NET PROFIT 1,000.5 预算表 data", "1,000.5", "预算表"]
    assert len(df.limit(1).select(search.required_terms(F.array(F.lit(" ".join(f"word{i}" for i in range(200)))), F.lit(None))).first()[0]) == 64


def test_phrase_hits(spark):
    docs = spark.createDataFrame([(1, "The cat, sat on. the CAT   sat"), (2, "concatenate sat"), (3, None), (4, ""), (1, "cat")], "doc_id long, text string").withColumn("word", F.lit("clash"))
    terms = spark.createDataFrame([(1, "Cat sat"), (2, "cat"), (3, "!!"), (4, "zebra cat"), (5, None), (6, "sat sat")], "term_id long, term string")
    got = sorted((r["term_id"], r["doc_id"], r["hits"], r["at"]) for r in search.phrase_hits(docs, terms).collect())
    assert got == [(1, 1, 2, 4), (2, 1, 1, 0), (2, 1, 2, 4)]
    assert search.phrase_hits(docs, terms.limit(0)).count() == 0 and search.phrase_hits(docs.limit(0), terms).count() == 0


def test_phrase_hits_ignore_the_case_of_all_scripts(spark):
    docs = spark.createDataFrame([(1, "Le Éai ÉONLEEAU, éai Éonleeau"), (2, "ΟΔΟΣ.Α οδοσ"), (None, "İZ, iz ÖL"), (4, "DIE STRAẞE")], "doc_id long, text string")
    terms = spark.createDataFrame([(1, "éai éonleeau"), (2, "ΟΔΟΣ"), (3, "İz"), (4, "Öl"), (4, "öL"), (None, "straße")], "term_id long, term string")
    got = sorted(((r["term_id"], r["doc_id"], r["hits"], r["at"]) for r in search.phrase_hits(docs, terms).collect()), key=str)
    assert got == [(1, 1, 2, 3), (2, 2, 2, 0), (3, None, 2, 0), (4, None, 1, 7), (4, None, 1, 7), (None, 4, 1, 4)]


def test_filename_and_format_claims(spark):
    texts = [
        "Use the attached file 'in.xlsx' and save the result as 'out/final.v2.docx'.", "There is 'x.csv' here.", "Based on 'copy.pdf' return 'copy.pdf'", None, "",
        "Return a PowerPoint file as PDF. Create an Excel workbook and a Word file.\nSee Word. Submit http://x/a.pdf now", "A deliverable named “b.TXT”",
    ]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select(search.filename_claims(F.col("t")).alias("f"), search.format_claims(F.col("t")).alias("o")).collect()
    files = [None if r["f"] is None else [(c["role"], c["name"], c["policy"]) for c in r["f"]] for r in df]
    assert files[0] == [("reference", "in.xlsx", "exact"), ("deliverable", "final.v2.docx", "exact")] and files[1] == [] and files[4] == []
    assert files[2] == [("reference", "copy.pdf", "named_reference_candidate"), ("deliverable", "copy.pdf", "named_reference_candidate")]
    assert files[6] == [("deliverable", "b.TXT", "named_reference_candidate")]
    assert [(c["fragment"], c["extension"]) for c in df[5]["o"]] == [(0, ".pdf")] and df[3]["o"] == []


def test_column_claims(spark):
    rows = [
        (1, "On the Summary sheet the variance is in column k. If asked, variance in column L.", "Summary sheet: column M shows the variance.\nOn the Summary sheet sampled rows are in column M; sampled again: column M."),
        (2, "The variance column in both is fine. Variance in column XFE", None), (3, None, "Q2 2024 and Q3 2024 in columns B and C on the first tab. Put Q2 and Q3 into columns B and C of the first worksheet"), (4, "Capture the variance in column A", "In the 'My  Sheet' tab variance in column A"),
    ]
    claims = search.claim_rows(spark.createDataFrame(rows, "item_id long, task string, rubric string"))
    got = sorted((r["item_id"], r["source"], r["scope"], r["role"], r["column"], r["conditional"]) for r in claims.collect())
    one = "deliverable:sheet:summary"
    assert got == [
        (1, "rubric", one, "sample_flag", "M", False), (1, "rubric", one, "variance", "M", False), (1, "task", one, "variance", "K", False), (1, "task", "unspecified", "variance", "L", True),
        (3, "rubric", "deliverable:first_sheet", "q2", "B", False), (3, "rubric", "deliverable:first_sheet", "q2", "B", False), (3, "rubric", "deliverable:first_sheet", "q3", "C", False), (3, "rubric", "deliverable:first_sheet", "q3", "C", False),
        (4, "rubric", "deliverable:sheet:my sheet", "variance", "A", False), (4, "task", "deliverable:first_sheet", "variance", "A", False),
    ]
    assert [tuple(r) for r in search.claim_differences(claims).collect()] == [(1, one, "variance", ["K"], ["M"])]
    assert [tuple(r) for r in search.rubric_contradictions(claims).collect()] == [(1, "one_column_multiple_roles", one, "M", ["sample_flag", "variance"])]
    assert [r[0] for r in spark.createDataFrame([("a",), ("AB",), ("ab",), ("XFD",), ("XFE",), ("ABCD",), (None,)], "x string").select(search.column_token(F.col("x"))).collect()] == ["A", "AB", None, "XFD", None, None, None]
