"""Reference calls held against the function schemas of their context, in VARIANT columns of the row itself.

A pass keeps a frontier of (path, value, schema) triples per row. Each step checks all of them, adds their issues and
replaces them by their children, until none is left; the number of steps is bounded by the schemas' own keywords.
There is no recursion in Python, no exchange and no second scan; a row's state is of the size of the row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.functions.text import let
from lodestone.operators.checks import Check, finding

TRIPLES, ISSUES, VARIANTS = "array<struct<path:string,value:variant,schema:variant>>", "array<struct<path:string,kind:string>>", "array<variant>"


def is_kind(v: Column, kind: str) -> Column:
    return F.coalesce(F.startswith(F.schema_of_variant(v), F.lit(kind)), F.lit(False))


def is_type(kind: Column, name: Column) -> Column:
    """Whether a value of a VARIANT kind (schema_of_variant) has a JSON schema type. Whole numbers are integers and numbers, booleans
    are neither; unknown names fit all. A number with a decimal point isn't an integer, whatever its value."""
    whole = kind.rlike(r"^(BIGINT|DECIMAL\((19|2\d|3\d),0\))")
    return (
        F.when(name == "object", F.startswith(kind, F.lit("OBJECT")))
        .when(name == "array", F.startswith(kind, F.lit("ARRAY")))
        .when(name == "string", kind == "STRING")
        .when(name == "boolean", kind == "BOOLEAN")
        .when(name == "integer", whole)
        .when(name == "number", whole | kind.rlike("^(DECIMAL|DOUBLE|FLOAT)"))
        .when(name == "null", kind == "VOID")
        .otherwise(True)
    )


def equal(a: Column, b: Column) -> Column:
    """Numbers and booleans by value (true is 1), the rest by its JSON text with sorted keys."""
    number = lambda v: F.when(F.schema_of_variant(v).rlike("^(BIGINT|DECIMAL|DOUBLE|FLOAT|BOOLEAN)"), F.coalesce(F.try_variant_get(v, "$", "double"), F.try_variant_get(v, "$", "boolean").cast("double")))
    return F.coalesce(number(a) == number(b), number(a).isNull() & number(b).isNull() & (F.to_json(a) == F.to_json(b)), F.lit(False))


def member(v: Column, name: str) -> Column:
    return F.try_variant_get(v, "$." + name, "variant")


def entries(v: Column) -> Column:
    """An object's members as a map, empty for what isn't one."""
    return F.coalesce(F.when(is_kind(v, "OBJECT"), v.try_cast("map<string,variant>")), F.create_map().cast("map<string,variant>"))


def elements(v: Column) -> Column:
    return F.coalesce(F.when(is_kind(v, "ARRAY"), v.try_cast(VARIANTS)), F.array().cast(VARIANTS))


def _visit(n: Column) -> Column:
    """struct(issues, children) of one (path, value, schema) node, each part of it looked at once."""
    issue = lambda path, kind: F.struct(path.alias("path"), F.lit(kind).alias("kind"))
    inside = lambda k: F.concat(n["path"], F.lit("."), k)
    child = lambda path, v, s: F.struct(path.alias("path"), v.alias("value"), s.alias("schema"))
    none, leaf = F.array().cast(ISSUES), F.array().cast(TRIPLES)
    result = lambda issues, children: F.struct(issues.alias("issues"), children.alias("children"))
    get = lambda m, k: F.try_element_at(m, F.lit(k))

    def names(t: Column) -> Column:
        return F.when(is_kind(t, "STRING"), F.array(t.cast("string"))).otherwise(F.transform(F.filter(elements(t), lambda x: is_kind(x, "STRING")), lambda x: x.cast("string")))

    def members(s: Column) -> Column:
        def of(m: Column) -> Column:
            have, props = F.map_keys(m["value"]), m["props"]
            missing = F.transform(F.filter(F.transform(elements(get(s, "required")), lambda k: k.cast("string")), lambda k: ~F.array_contains(have, k)), lambda k: issue(inside(k), "missing_required"))
            strict = F.coalesce(F.to_json(get(s, "additionalProperties")) == "false", F.lit(False))
            known = F.filter(F.transform(F.map_entries(m["value"]), lambda e: F.struct(e["key"].alias("key"), e["value"].alias("value"), F.try_element_at(props, e["key"]).alias("schema"))), lambda e: is_kind(e["schema"], "OBJECT"))
            unknown = F.transform(F.filter(have, lambda k: ~is_kind(F.try_element_at(props, k), "OBJECT")), lambda k: issue(inside(k), "unknown_property"))
            return result(F.concat(missing, F.when(strict, unknown).otherwise(none)), F.transform(known, lambda e: child(inside(e["key"]), e["value"], e["schema"])))

        return let(F.struct(entries(n["value"]).alias("value"), entries(get(s, "properties")).alias("props")), of)

    def look(c: Column) -> Column:
        s, kind = c["schema"], c["kind"]
        listed = F.transform(elements(n["value"]), lambda v, i: child(F.concat(n["path"], F.lit("["), i.cast("string"), F.lit("]")), v, get(s, "items")))
        below = (
            F.when(F.startswith(kind, F.lit("OBJECT")) & is_kind(get(s, "properties"), "OBJECT"), members(s))
            .when(F.startswith(kind, F.lit("ARRAY")) & is_kind(get(s, "items"), "OBJECT"), result(none, listed))
            .otherwise(result(none, leaf))
        )
        barred = is_kind(get(s, "enum"), "ARRAY") & ~F.exists(elements(get(s, "enum")), lambda e: equal(e, n["value"]))
        fine = F.when(barred, let(below, lambda b: result(F.concat(F.array(issue(n["path"], "enum_mismatch")), b["issues"]), b["children"]))).otherwise(below)
        return F.when((F.size(c["types"]) > 0) & ~F.exists(c["types"], lambda t: is_type(kind, t)), result(F.array(issue(n["path"], "type_mismatch")), leaf)).otherwise(fine)

    opened = let(entries(n["schema"]), lambda s: F.struct(F.schema_of_variant(n["value"]).alias("kind"), s.alias("schema"), names(get(s, "type")).alias("types")))
    return let(opened, look)


def schema_issues(triples: Column) -> Column:
    """array<struct<path, kind>>: type_mismatch, enum_mismatch, missing_required and unknown_property of values against schemas.

    Knows type (a name or a list of names), enum, properties, required and additionalProperties (beside properties), items.
    A value of the wrong type gets that one issue and isn't looked into. Issues come level by level.
    """

    def step(state: Column, _: Column) -> Column:
        return let(F.transform(state["open"], _visit), lambda vs: F.struct(F.flatten(F.transform(vs, lambda v: v["children"])).alias("open"), F.concat(state["issues"], F.flatten(F.transform(vs, lambda v: v["issues"]))).alias("issues")))

    start = F.struct(triples.cast(TRIPLES).alias("open"), F.array().cast(ISSUES).alias("issues"))
    levels = F.aggregate(triples, F.lit(1), lambda most, n: F.greatest(most, 1 + F.regexp_count(F.to_json(n["schema"]), F.lit(r'"(properties|items)"'))))
    return F.aggregate(F.sequence(F.lit(1), levels), start, step)["issues"]


def _as_variant(items: DataFrame, name: str) -> Column:
    return F.col(name) if dict(items.dtypes)[name] == "variant" else F.try_parse_json(name)


def with_schema_issues(items: DataFrame, calls: str = "reference_solution", context: str = "context") -> DataFrame:
    """items plus `schema_issues` of a reference (object of function name to arguments), null where it can't be checked: the
    reference isn't an object, or no list of the context holds a schema with a name.

    Columns are VARIANT or JSON text. A name is looked up as it is, then without a trailing _<digits>; of schemas of one
    name the first counts, lists in the order of their names. Issues besides those of values: missing_function_schema,
    missing_parameters_schema.
    """
    solution, about = _as_variant(items, calls), _as_variant(items, context)
    filled = lambda v: F.nullif(F.when(~is_kind(v, "VOID"), v.cast("string")), F.lit(""))
    nested = lambda e: F.when(is_kind(member(e, "function"), "OBJECT"), member(e, "function"))
    tools = F.filter(F.flatten(F.transform(F.map_values(entries(about)), elements)), lambda e: is_kind(e, "OBJECT"))
    tools = F.filter(F.transform(tools, lambda e: F.struct(F.coalesce(filled(member(e, "name")), filled(member(nested(e), "name"))).alias("name"), member(F.coalesce(nested(e), e), "parameters").alias("parameters"))), lambda t: t["name"].isNotNull())
    rows = items.withColumn("__calls", solution).withColumn("__tools", tools)

    def placed(e: Column) -> Column:
        of = lambda name: F.get(F.filter("__tools", lambda t: t["name"] == name), F.lit(0))
        return F.struct(e["key"].alias("path"), e["value"].alias("value"), F.coalesce(of(e["key"]), of(F.regexp_replace(e["key"], r"_\d+$", ""))).alias("tool"))

    rows = rows.withColumn("__placed", F.transform(F.map_entries(entries(F.col("__calls"))), placed))
    usable = lambda p: is_kind(p["tool"]["parameters"], "OBJECT")
    triples = F.transform(F.filter("__placed", usable), lambda p: F.struct(p["path"].alias("path"), p["value"].alias("value"), p["tool"]["parameters"].alias("schema")))
    bare = F.transform(F.filter("__placed", lambda p: ~usable(p)), lambda p: F.struct(p["path"].alias("path"), F.when(p["tool"].isNull(), "missing_function_schema").otherwise("missing_parameters_schema").alias("kind")))
    eligible = is_kind(F.col("__calls"), "OBJECT") & (F.size("__tools") > 0)
    return rows.withColumn("schema_issues", F.when(eligible, F.concat(bare.cast(ISSUES), schema_issues(triples)))).drop("__calls", "__tools", "__placed")


def issue_rows(items: DataFrame) -> DataFrame:
    """(item_id, path, kind), one row per issue of `schema_issues`. The outer explode keeps Spark from working the issues out a
    second time in a filter of its own."""
    return items.select("item_id", F.explode_outer("schema_issues").alias("i")).where("i is not null").select("item_id", "i.*")


def reference_check() -> Check:
    """The row checker over `schema_issues`: one review finding where there are any."""
    return Check("reference_schema_validation", F.col("schema_issues").isNotNull(), [finding("reference_schema_validation", "reference_schema_mismatch", F.size("schema_issues") > 0, "review", "reference-schema-validation-v1", True)])
