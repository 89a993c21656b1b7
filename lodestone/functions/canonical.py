"""Nested values as sorted typed leaves: a form in which equal answers are equal, whatever their surface.

A value is walked level by level in a fold over VARIANT; each leaf keeps its path. Object keys and strings are then
normalised together in one Arrow call per batch (only where they aren't plain ASCII), and the leaves are sorted, so that
the order of keys doesn't count and that of list elements does. The result is one string to compare or group by.
"""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

OPEN = "array<struct<steps:array<string>,value:variant>>"
LEAVES = "array<struct<steps:array<string>,kind:string,text:string>>"

# Marks that may end a sentence without changing an answer.
TERMINAL = ".!?。！？"
#: A whole number or decimal, with thousands commas in place or none.
PLAIN_NUMBER = r"^[-+]?(?:(?:\d{1,3}(?:,\d{3})+|\d+)(?:\.\d+)?|\.\d+)$"


def _leaf_kind(v: Column) -> Column:
    return F.regexp_extract(F.schema_of_variant(v), "^[A-Z]+", 0)


def leaves(v: Column) -> Column:
    """array<struct<steps, kind, text>> of a VARIANT. Steps are k:<key> and i<place>; kind is the VARIANT's own type name.
    An empty object or list is a leaf of its own. Null (no value at all) gives null."""
    kind = lambda n: _leaf_kind(n["value"])
    whole, listed = "map<string,variant>", "array<variant>"
    size = lambda n: F.coalesce(F.size(F.when(kind(n) == "OBJECT", n["value"].try_cast(whole))), F.lit(-1)), lambda n: F.coalesce(F.size(F.when(kind(n) == "ARRAY", n["value"].try_cast(listed))), F.lit(-1))
    inner = lambda n: F.greatest(size[0](n), size[1](n)) > 0

    def children(n: Column) -> Column:
        own = lambda step, value: F.struct(F.concat(n["steps"], F.array(step)).alias("steps"), value.alias("value"))
        named = F.transform(F.map_entries(n["value"].try_cast(whole)), lambda e: own(F.concat(F.lit("k:"), e["key"]), e["value"]))
        placed = F.transform(n["value"].try_cast(listed), lambda e, i: own(F.concat(F.lit("i"), F.lpad(i.cast("string"), 9, "0")), e))
        return F.when(kind(n) == "OBJECT", named).otherwise(placed)

    def step(state: Column, _: Column) -> Column:
        done = F.transform(F.filter(state["open"], lambda n: ~inner(n)), lambda n: F.struct(n["steps"].alias("steps"), kind(n).alias("kind"), F.coalesce(n["value"].cast("string"), F.lit("")).alias("text")))
        return F.struct(F.flatten(F.transform(F.filter(state["open"], inner), children)).alias("open"), F.concat(state["done"], done).alias("done"))

    first = F.array(F.struct(F.array().cast("array<string>").alias("steps"), v.alias("value")))
    start = F.struct(first.cast(OPEN).alias("open"), F.array().cast(LEAVES).alias("done"))
    levels = 1 + F.greatest(F.regexp_count(F.to_json(v), F.lit(r"[\[{]")), F.lit(0))
    return F.when(v.isNotNull(), F.aggregate(F.sequence(F.lit(1), levels), start, step)["done"])


def folded_all(texts: Column) -> Column:
    """NFKC and case folding of each string of an array; arrays of plain ASCII stay in the JVM."""
    import pyarrow as pa

    def run(batch):
        flat = [None if t is None else unicodedata.normalize("NFKC", t).casefold() for t in batch.flatten().to_pylist()]
        lengths = [0 if x is None else x for x in batch.value_lengths().to_pylist()]
        offsets = [0]
        for n in lengths:
            offsets.append(offsets[-1] + n)
        return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(flat, pa.string()), mask=batch.is_null())

    plain = F.forall(texts, lambda t: t.rlike(r"^[\x00-\x7F]*$"))
    return F.coalesce(F.when(plain, F.transform(texts, F.lower)), F.arrow_udf(run, "array<string>")(F.when(~plain, texts)))


def decimal_text(x: Column) -> Column:
    """A plain number's one spelling: no commas, plus sign, leading or trailing zeros; zero has no sign."""
    bare = F.regexp_replace(x, r"[,+]", "")
    whole = F.regexp_replace(F.regexp_replace(bare, r"^(-?)0*(?=\d)", "$1"), r"(?<!\d)\.", "0.")
    short = F.when(F.contains(whole, F.lit(".")), F.regexp_replace(whole, r"\.?0*$", "")).otherwise(whole)
    return F.when(short.rlike("^-?0?$"), "0").otherwise(short)


def surface(folded: Column) -> Column:
    """Typed form of a folded string: n<number> if all of it is a plain number, else s<text> with single blanks and without
    the marks that end a sentence. Signs, units, per cent signs and inner punctuation stay."""
    plain = F.trim(F.regexp_replace(folded, r"(?U)\s+", " "))
    text = F.regexp_replace(F.regexp_replace(plain, f"[{TERMINAL}]+$", ""), r"\s+$", "")
    return F.when(plain.rlike(PLAIN_NUMBER), F.concat(F.lit("n"), decimal_text(plain))).otherwise(F.concat(F.lit("s"), text))


def _number(text: Column) -> Column:
    """A JSON number's text, powers of ten written out where 38 digits hold them."""
    return F.when(text.rlike("[eE]"), F.coalesce(text.try_cast("double").try_cast("decimal(38,12)").cast("string"), text)).otherwise(text)


def with_comparison(rows: DataFrame, value: str, name: str = "comparison") -> DataFrame:
    """rows plus the comparison form of a VARIANT column as one string; null for null.

    Numbers and strings that are whole plain numbers compare as numbers of any length, strings by NFKC and case folding;
    true, false and JSON null are types of their own; an empty list, an empty object and an empty text all differ.
    """
    c = F.col
    wide = F.transform(leaves(c(value)), lambda n: F.struct(F.concat(n["steps"], F.array(F.when(n["kind"] == "STRING", n["text"]).otherwise(""))).alias("texts"), n["kind"].alias("kind"), n["text"].alias("text")))
    staged = rows.withColumn("__leaves", wide)
    staged = staged.withColumn("__texts", F.flatten(F.transform("__leaves", lambda n: n["texts"])))
    ends = F.aggregate("__leaves", F.array().cast("array<int>"), lambda a, n: F.array_append(a, F.coalesce(F.get(a, F.size(a) - 1), F.lit(0)) + F.size(n["texts"])))
    staged = staged.withColumn("__folded", folded_all(c("__texts"))).withColumn("__ends", ends)

    def one(n: Column, i: Column) -> Column:
        own = F.slice(c("__folded"), F.get(c("__ends"), i) - F.size(n["texts"]) + 1, F.size(n["texts"]))
        path = F.transform(F.slice(own, F.lit(1), F.size(own) - 1), lambda s: F.when(F.startswith(s, F.lit("k:")), F.concat(F.lit("k"), surface(F.substr(s, F.lit(3))))).otherwise(s))
        number = F.concat(F.lit("n"), decimal_text(_number(n["text"])))
        leaf = F.when(n["kind"] == "STRING", surface(F.element_at(own, -1))).when(n["kind"].isin("BIGINT", "DECIMAL", "DOUBLE", "FLOAT"), number).otherwise(F.concat(F.lit("x"), F.lower(n["kind"]), n["text"]))
        return F.to_json(F.array_append(path, leaf))

    form = F.array_join(F.array_sort(F.transform("__leaves", one)), "\n")
    return staged.withColumn(name, form).drop("__leaves", "__texts", "__folded", "__ends")


def comparison_text(x: Column) -> Column:
    """comparison_value of a plain string, without a walk."""
    return surface(F.get(folded_all(F.array(x)), F.lit(0)))


def same_json(a: Column, b: Column) -> Column:
    """Whether two VARIANTs are equal as JSON, key order aside; 1 and 1.0 differ, as do 1 and "1"."""
    form = lambda v: F.array_sort(F.transform(leaves(v), lambda n: F.to_json(n)))
    return F.coalesce(form(a) == form(b), F.lit(False))


def filled(v: Column) -> Column:
    """Not null, an empty text, an empty list or an empty object."""
    return F.coalesce(~F.to_json(v).isin("null", '""', "[]", "{}"), F.lit(False))
