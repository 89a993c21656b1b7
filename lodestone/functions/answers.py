"""Answer contracts, acceptance, variants and mutations as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lodestone.functions.text import let, normalize_loose, normalize_text, parse_number, parse_ratio, split_list

LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
SENTINEL = "__wrong_answer__"


def none_of(kind: str = "string") -> Column:
    return F.array().cast(f"array<{kind}>")


def choice_index(answer: Column, choices: Column) -> Column:
    """Index from 0 of an answer among choices, null if it names none.

    A label counts if it is a substring of the labels in use, so that "BC" gives 1; then a label with a period, whatever
    follows it ("B. green"); then comes loose equality with a choice's text.
    """
    label = F.regexp_replace(F.upper(F.trim(answer)), r"(?s)^([A-Z])\..*$", "$1")
    at = F.instr(F.substring(F.lit(LETTERS), F.lit(1), F.size(choices)), label) - 1
    text = F.array_position(F.transform(choices, normalize_loose), normalize_loose(answer)).cast("int") - 1
    return F.when((label != "") & (at >= 0), at).when(text >= 0, text)


def contract(evaluator: Column, output: Column, gold: Column, choices: Column) -> Column:
    """struct(kind, cardinality, basis, explains). Tokens are found as substrings, first match wins; explains: text around the answer is allowed."""
    ev, every = normalize_text(evaluator), F.concat_ws(" ", normalize_text(evaluator), normalize_text(output))
    has = lambda x, *words: F.greatest(*[F.contains(x, F.lit(w)).cast("int") for w in words], F.lit(0)) == 1
    kind = (
        F.when(F.size(choices) > 0, "choice")
        .when(has(ev, "ratio"), "ratio")
        .when(has(ev, "numeric", "number"), "numeric")
        .when(has(ev, "choice"), "choice")
        .when(has(ev, "normalized", "loose", "alias", "denotation"), "normalized_exact")
        .when(has(ev, "exact"), "exact")
        .when(parse_number(gold).isNotNull(), "numeric")
        .otherwise("normalized_exact")
    )
    basis = (
        F.when(F.size(choices) > 0, "choices")
        .when(has(ev, "ratio", "numeric", "number", "choice", "normalized", "loose", "alias", "denotation", "exact"), "evaluator")
        .when(parse_number(gold).isNotNull(), "gold_shape")
        .otherwise("default")
    )
    cardinality = F.when(has(every, "compound"), "compound").when(has(every, "set", "list", "multi", "multiple", "all answers", "denotation"), "set").otherwise("single")
    explains = has(every, "free form", "free-form", "natural language", "answer extraction", "extract", "explanation", "sentence")
    return F.struct(kind.alias("kind"), cardinality.alias("cardinality"), basis.alias("basis"), explains.alias("explains"))


def close(a: Column, b: Column, rel: float = 0.0, absolute: float = 1e-9) -> Column:
    return F.coalesce(F.abs(a - b) <= F.greatest(F.lit(absolute), rel * F.greatest(F.lit(1.0), F.abs(a), F.abs(b))), F.lit(False))


def one_view(gold: Column, choices: Column) -> list[Column]:
    return [F.trim(gold).alias("plain"), choice_index(gold, choices).alias("index"), parse_number(gold).alias("number"), parse_ratio(gold).alias("ratio"), normalize_loose(gold).alias("loose")]


def view(gold: Column, choices: Column) -> Column:
    """What acceptance reads of a gold answer, as a struct to be computed once per item: its values as one and as a list."""
    parts = lambda v: F.when(F.size(split_list(gold)) == 1, F.array(v)).otherwise(F.transform(split_list(gold), lambda g: F.struct(*one_view(g, choices))))
    return let(F.struct(*one_view(gold, choices)), lambda v: F.struct(*[v[n].alias(n) for n in ("plain", "index", "number", "ratio", "loose")], parts(v).alias("parts")))


def answer_values(v: Column) -> Column:
    """The values of a VARIANT answer as texts: entries of a list without null and empty ones, one for a scalar, none for null or ""."""
    listed = F.when(F.startswith(F.schema_of_variant(v), F.lit("ARRAY")), F.try_variant_get(v, "$", "array<string>"))
    return F.filter(F.coalesce(listed, F.array(F.try_variant_get(v, "$", "string"))), lambda x: F.coalesce(x != "", F.lit(False)))


def match_sets(answers: Column, golds: Column, kind: Column, choices: Column) -> Column:
    """Whether two arrays of equal size match one to one: each answer, in order, takes the first gold value still free that it passes
    against. golds are views. Values of loose text pass exactly when they are equal, so these are only sorted; numbers pass within a
    tolerance, where the order of choosing counts."""

    def take(state: Column, x: Column) -> Column:
        at = F.array_position(F.transform(state["free"], lambda g: F.coalesce(accept_single(x, g, kind, choices), F.lit(False))), True).cast("int")
        rest = lambda i: F.when(i > 0, F.concat(F.slice(state["free"], F.lit(1), i - 1), F.slice(state["free"], i + 1, F.size(state["free"])))).otherwise(state["free"])
        return let(at, lambda i: F.struct(rest(i).alias("free"), (state["ok"] & (i > 0)).alias("ok")))

    greedy = F.aggregate(answers, F.struct(golds.alias("free"), F.lit(True).alias("ok")), take)["ok"]
    loose = F.array_sort(F.transform(answers, normalize_loose)) == F.array_sort(F.transform(golds, lambda g: g["loose"]))
    return (F.size(answers) == F.size(golds)) & F.when(kind.isin("choice", "numeric", "ratio", "exact"), greedy).otherwise(loose)


def accept_single(answer: Column, gold: Column, kind: Column, choices: Column) -> Column:
    """Whether one value passes against a gold's view; an answer and a gold that both name no choice are equal under choice."""
    loose = normalize_loose(answer) == gold["loose"]
    return (
        F.when(kind == "choice", choice_index(answer, choices).eqNullSafe(gold["index"]))
        .when(kind == "numeric", close(parse_number(answer), gold["number"]))
        .when(kind == "ratio", F.coalesce(F.when(gold["ratio"].isNotNull() & parse_ratio(answer).isNotNull(), close(parse_ratio(answer), gold["ratio"], 1e-6)), loose))
        .when(kind == "exact", F.trim(answer) == gold["plain"])
        .otherwise(loose)
    )


def accept(answer: Column, gold: Column, answers: Column, choices: Column, evaluator: Column, aliases: Column) -> Column:
    """Acceptance under a contract struct, against a gold's view: sets of equal size one to one in any order, compounds place by
    place (as numbers where both are), else one value; a declared alias helps where the evaluator says so."""
    kind = answers["kind"]
    as_set = match_sets(F.when(F.size(gold["parts"]) > 1, split_list(answer)).otherwise(F.array(answer)), gold["parts"], kind, choices)
    a, b = (F.filter(F.split(F.trim(x), r"\s*;\s*"), lambda p: F.trim(p) != "") for x in (answer, gold["plain"]))
    number = lambda x, y: F.when(parse_number(x).isNotNull() & parse_number(y).isNotNull(), F.lit("numeric")).otherwise(kind)
    placed = lambda x, y: F.coalesce(accept_single(x, F.struct(*one_view(y, choices)), number(x, y), choices), F.lit(False))
    compound = (F.size(a) == F.size(b)) & F.forall(F.zip_with(a, b, placed), lambda x: x)
    plain = F.when(answers["cardinality"] == "set", as_set).when(answers["cardinality"] == "compound", compound).otherwise(accept_single(answer, gold, kind, choices))
    alias = F.contains(F.lower(evaluator), F.lit("alias")) & F.exists(aliases, lambda x: accept_single(answer, F.struct(*one_view(x, choices)), kind, choices))
    return F.coalesce(plain, F.lit(False)) | F.coalesce(alias, F.lit(False))


def swapped(x: Column) -> Column:
    """Upper and lower case exchanged, for ASCII letters."""
    return F.translate(x, LETTERS + LETTERS.lower(), LETTERS.lower() + LETTERS)


def _strings(*found: Column) -> Column:
    return F.array_compact(F.array(*[x.cast("string") for x in found]))


def format_variants(gold: Column, answers: Column, choices: Column) -> Column:
    """Other ways to write a gold down, by its contract: a set reversed and comma-joined (from two values on); none of a compound; else
    in a sentence where explanations are allowed, with case exchanged, with thousands commas, and as a choice's text or
    label with a period. Null golds have none."""
    text, number, at = F.trim(gold), parse_number(gold), choice_index(gold, choices)
    parts = F.transform(split_list(gold), lambda p: F.trim(p))
    as_set = F.when(F.size(parts) > 1, F.array(F.array_join(F.reverse(parts), ", "), F.array_join(parts, ", "))).otherwise(none_of())
    single = _strings(
        F.when(answers["explains"], F.concat(F.lit("Answer: "), text)), F.when(answers["explains"], F.concat(F.lit("The final answer is "), text, F.lit("."))), F.when(text != "", swapped(text)),
        F.when(number == F.floor(number), F.format_number(number, 0)), F.get(choices, at), F.when(at >= 0, F.concat(F.substring(F.lit(LETTERS), at + 1, F.lit(1)), F.lit("."))),
    )
    return F.coalesce(F.when(answers["cardinality"] == "set", as_set).when(answers["cardinality"] == "compound", none_of()).otherwise(F.when(gold.isNotNull(), single)), none_of())


def variants(gold: Column, answers: Column, choices: Column, aliases: Column) -> Column:
    """Answers that mean the same as gold under its contract, each once: a choice's text and labels, a number's spellings (6.0, 6.00, 006;
    6.30 for 6.3), text with blanks around or case exchanged, a set's orders, and the declared aliases (not of sets)."""
    kind, multi = answers["kind"], answers["cardinality"].isin("set", "compound")
    at = choice_index(gold, choices)
    label = F.substring(F.lit(LETTERS), at + 1, F.lit(1))
    number = parse_number(gold)
    told = F.regexp_extract(F.replace(F.trim(gold), F.lit(","), F.lit("")), r"[-+]?\d+(?:\.\d+)?", 0)
    digits = F.abs(number).cast("decimal(38,0)").cast("string")
    sign = F.when(number < 0, "-").otherwise("")
    padded = F.concat(sign, F.lpad(digits, F.greatest(F.length(digits), F.when(number < 0, F.lit(2)).otherwise(F.lit(3))), F.lit("0")))
    numeric = F.when(number == F.floor(number), _strings(F.concat(sign, digits, F.lit(".0")), F.concat(sign, digits, F.lit(".00")), padded)).when(F.contains(told, F.lit(".")), F.array(F.concat(told, F.lit("0"))))
    found = (
        F.when(multi, format_variants(gold, answers, choices))
        .when(kind == "choice", F.when(at >= 0, F.array(F.get(choices, at), F.concat(label, F.lit(".")), F.lower(label))))
        .when(kind == "numeric", numeric)
        .when(kind == "normalized_exact", F.array(F.concat(F.lit("  "), gold, F.lit("  ")), swapped(gold)))
    )
    more = F.when(answers["cardinality"] != "set", aliases)
    return F.array_distinct(F.array_compact(F.concat(F.coalesce(found, none_of()), F.coalesce(more, none_of()))))


def mutations(gold: Column, kind: Column, choices: Column) -> Column:
    """Answers that are wrong."""
    labels = F.transform(F.sequence(F.lit(1), F.greatest(F.size(choices), F.lit(1))), lambda i: F.substring(F.lit(LETTERS), i, F.lit(1)))
    at = choice_index(gold, choices)
    other = F.filter(labels, lambda x: F.instr(F.lit(LETTERS), x) - 1 != at)
    number = parse_number(gold)
    numeric = F.array((number + 1).cast("string"), F.when(number == 0, F.lit(1.0)).otherwise(-number).cast("string"))
    text = F.array(F.lit(SENTINEL), F.lit(""), F.concat(gold, F.lit(" OR " + SENTINEL)))
    return F.coalesce(F.when(kind == "choice", other).when(kind.isin("numeric", "ratio"), numeric).otherwise(text), none_of())
