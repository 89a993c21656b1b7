import math

import pytest
from pyspark.sql import functions as F

from lodestone.functions import answers as A
from lodestone.functions import stats as S
from lodestone.functions import text as X
from lodestone.operators import checks, metrics


def one(spark, column, **values):
    row = spark.range(1).select(*[F.lit(v).alias(k) if not isinstance(v, list) else F.array(*[F.lit(x) for x in v]).cast("array<string>").alias(k) for k, v in values.items()])
    return row.select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(("text", "want"), [("  The  Cat, sat. ", "cat sat"), ("-3.50!", "-3.50"), ("A b-c", "bc"), ("", "")])
def test_normalize_loose(spark, text, want):
    assert one(spark, X.normalize_loose(F.col("t")), t=text) == want


@pytest.mark.parametrize(("text", "want"), [("1,234.5 kg", 1234.5), (".5", 5.0), ("1e5", 1.0), ("none", None), ("-7", -7.0)])
def test_parse_number(spark, text, want):
    assert one(spark, X.parse_number(F.col("t")), t=text) == want


@pytest.mark.parametrize(("gold", "want"), [("B", 1), ("B. green", 1), ("b.", 1), ("E. none", None), ("BC", 1), ("beta", 1), ("Z", None), ("a", 0)])
def test_choice_index(spark, gold, want):
    assert one(spark, A.choice_index(F.col("g"), F.col("c")), g=gold, c=["alpha", "beta", "gamma", "delta"]) == want


@pytest.mark.parametrize(
    ("answer", "gold", "evaluator", "choices", "want"),
    [("41", "41.0", "numeric", [], True), ("1/2", "0.5", "ratio", [], True), ("zzz", "qqq", "x", ["A", "B"], True), ("b, a", "a and b", "set match", [], True), ("Paris", "paris.", "loose", [], True), ("Paris", "paris", "exact", [], False), ("Rome", "paris", "loose", [], False)],
)
def test_accept(spark, answer, gold, evaluator, choices, want):
    c = F.col
    answers = A.contract(c("e"), F.lit(""), c("g"), c("c"))
    assert one(spark, A.accept(c("a"), A.view(c("g"), c("c")), answers, c("c"), c("e"), A.none_of()), a=answer, g=gold, e=evaluator, c=choices) is want


def test_wilson_edges(spark):
    assert one(spark, S.wilson(F.lit(0), F.lit(0), True)) == 1.0
    assert one(spark, S.wilson(F.lit(0), F.lit(0), True, "null")) is None
    assert math.isclose(one(spark, S.wilson(F.lit(5), F.lit(10), False)), 0.236593, rel_tol=1e-5)


def test_percentile_ties(spark):
    got = S.with_percentile(spark.createDataFrame([(1.0,), (1.0,), (2.0,), (3.0,)], "x double"), "x", "p").collect()
    assert sorted(r["p"] for r in got) == [1 / 6, 1 / 6, 2 / 3, 1.0]


def test_invisible_and_terms(spark):
    assert one(spark, X.invisible_count(F.col("t")), t="a​b\tc\x01") == 2
    assert "report.pdf" in one(spark, X.search_terms(F.col("t")), t='see report.pdf for "net income" of 42')
    assert one(spark, X.folded(F.col("t")), t="Straße ﬁ") == "strasse fi"


VALUES = {
    "(3 + 4) * 2": 14.0, "2 + 3 * 4": 14.0, "-(2 - 5) / 3": 1.0, "((1+2)*(3+4)) - -2": 23.0, "10 - 4 - 3": 3.0, "8/4/2": 1.0, "2**3": 8.0, "7//2": 3.0, "-7//2": -4.0, "1 - 7//2": -2.0, "-2**2": -4.0, "(-2)**2": 4.0, "2**-1": 0.5, "2**3**2": 512.0,
    "-(2)**2": -4.0, "(1/3)*3": 1.0, "(0.00001*0.00001)*10000000000": 1.0, "1-(2-5)": 4.0, "007.5 + 1": 8.5, "00 + 1": 1.0, "1. + .5": 1.5, "2*-3": -6.0, "+-+5": -5.0, "10 // 3 * 2": 6.0, "2 * (3": None, "1/0": None, "5//0": None, "0**-1": None, "(-8)**.5": None, "3 4": None,
    "2(3)": None, "(1)(2)": None, "2024-01-05": None, "12 + 05": None, "1 * * 2": None, "6 / / 2": None, "2***3": None, "1..2": None, "()": None, "*3": None, "3 +": None, "1\n+ 2": None, "9**99": None, "10**12": 1e12, "10**12 + 1": None,
}


def test_arithmetic_value(spark):
    asked = [(f"{verb} {x}?", v) for x, v in VALUES.items() for verb in ("What is", "calculate")]
    asked += [(t, None) for t in ("what is love", "", None, "what is  the sum", "solve 1 + 1")] + [("Compute  3", 3.0), ("what is the way to compute 4 * 5", 20.0)]
    frame = spark.createDataFrame(asked, "t string, v double").select("t", "v", checks.arithmetic_value(F.col("t")).alias("got"))
    for r in frame.collect():
        assert (r["got"] is None and r["v"] is None) or (r["got"] is not None and r["v"] is not None and math.isclose(r["got"], r["v"], rel_tol=1e-12)), r


def test_variants(spark):
    rows = [("6", "numeric", [], ["six"]), ("-6.30", "numeric", [], []), ("1,234", "numeric", [], []), ("B", "choice", ["x", "y"], []), ("aB", "loose", [], ["Z", "Z"]), ("a, b", "set match", [], ["q"]), ("a; b", "compound", [], ["q"]), (None, "loose", [], [])]
    df = spark.createDataFrame(rows, "g string, e string, c array<string>, a array<string>")
    answers = A.contract(F.col("e"), F.lit("free form"), F.col("g"), F.col("c"))
    got = df.select(A.variants(F.col("g"), answers, F.col("c"), F.col("a")).alias("v"), A.format_variants(F.col("g"), answers, F.col("c")).alias("f")).collect()
    assert [r["v"] for r in got] == [["6.0", "6.00", "006", "six"], ["-6.300"], ["1234.0", "1234.00", "1234"], ["y", "B.", "b"], ["  aB  ", "Ab", "Z"], ["b, a", "a, b"], ["q"], []]
    assert [r["f"] for r in got][:4] == [["Answer: 6", "The final answer is 6.", "6", "6"], ["Answer: -6.30", "The final answer is -6.30.", "-6.30"], ["Answer: 1,234", "The final answer is 1,234.", "1,234", "1,234"], ["Answer: B", "The final answer is B.", "b", "y", "B."]]
    assert got[6]["f"] == [] and got[7]["f"] == []


def test_balanced_folds(spark):
    sizes = {"a": 9, "b": 7, "c": 7, "d": 5, "e": 4, "f": 4, "g": 1, None: 4}
    rows = [(k,) for k, n in sizes.items() for _ in range(n)]
    held, want = [0, 0, 0], {}
    for k, n in sorted(sizes.items(), key=lambda x: (-x[1], x[0] is None, x[0] or "")):
        fold = held.index(min(held))
        held[fold], want[k] = held[fold] + n, fold
    df = spark.createDataFrame(rows, "s string")
    assert {r["s"]: r["fold"] for r in metrics.balanced_folds(df, "s", 3).collect()} == want
    assert metrics.balanced_folds(df.limit(0), "s", 3).count() == 0


@pytest.mark.parametrize(
    ("text", "want"),
    [("discount >=50% of 1,250 rows", [1250.0]), ("SR-021 in 2024年 total 58000", [58000.0]), ("item 14 has 3.5 and 12", [3.5, 12.0]), ("35%-45% share, 84 rows", [84.0]), ("a.xlsx 9", [9.0]), ("Partner 3 #1013", [])],
)
def test_rubric_numbers(spark, text, want):
    assert one(spark, X.rubric_numbers(F.col("t")), t=text) == want
    assert one(spark, X.missed(X.rubric_numbers(F.col("t")), F.lit("a_9=1250.4\nb=58200")), t=text) == [w for w in want if w not in (1250.0, 58000.0)]


def test_added_lines_and_multiplicity(spark):
    patch = "+++ b/x\n+return None\n+x = total(a)\n+# a comment\n+'short string'\n+finally:\n+x=1\n+x = total(a)\n+import os.path\n-y = total(b)"
    assert one(spark, X.added_lines(F.col("t")), t=patch) == ["x = total(a)", "import os.path"]
    for text, want in [("```in any order```", "by_design"), ("sort BEGIN SOLUTION in any order", "priority"), ("<code>unordered</code> random", "ambiguous")]:
        assert one(spark, checks.multiplicity(F.col("t")), t=text) == want
    assert one(spark, X.normalize_choice(F.col("t")), t="a)x") == "x"
