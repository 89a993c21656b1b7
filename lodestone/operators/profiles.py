"""Schema profiles of VARIANT rows, their fingerprint, type checks of adapter sources against them, component gaps.

A row's objects are walked level by level in a fold inside the row; what leaves it is one small struct per path. The types
seen at a path are bits of an integer, so that profiles merge by bit_or before any exchange: a path that all rows have
reaches its task as one row per input task, however many rows there are.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.functions.text import let
from lodestone.operators.schemas import elements, entries, is_kind, is_type

#: JSON types in order of name; a type's bit is 2 to the power of its place.
TYPES = ("array", "boolean", "integer", "null", "number", "object", "string")
ANY = (1 << len(TYPES)) - 1
BIT = {name: 1 << i for i, name in enumerate(TYPES)}
NODES = "array<struct<path:array<string>,value:variant>>"

# Limits of a profile, expected types of targets, and what the components of a family need.
MOST_LEVELS, MOST_PATHS, EXAMPLE_CHARS, EXAMPLE_ENTRIES, EXAMPLE_FIELDS, EXAMPLE_LEVELS = 10, 512, 160, 3, 8, 3
EXPECTED = {"task": "string", "context": "object", "choices": "array", "aliases": "array", "evaluator": "object", "metadata": "object"}
TRANSFORMS = {"stringify": "string", "as_list": "array", "as_context": "object", "as_metadata": "object", "as_evaluator": "object"}
COMPONENTS = {
    "generic": {"canonical_task": ["task"]},
    "workspacebench": {
        "canonical_task": ["task"], "record_identity": ["item_id"], "evaluator_protocol": ["evaluator", "rubrics"], "output_contract": ["output_contract", "output_files"],
        "attachment_manifest": ["context", "data_manifest"], "dependency_graph": ["file_dep_graph"], "materialized_inputs": ["input_files"],
    },
    "swebench": {"canonical_task": ["task"], "repository_identity": ["repo", "base_commit"], "reference_patch": ["patch"], "test_protocol": ["test_patch"]},
    "terminalbench": {"canonical_task": ["task"], "environment_protocol": ["environment"], "command_protocol": ["commands"], "test_protocol": ["tests"]},
}
PLUGINS = ["record_source_loader", "attachment_resolver", "candidate_materializer", "harness_result_parser", "trace_parser"]


def type_bit(v: Column) -> Column:
    """The bit of a VARIANT's JSON type. Booleans are neither integers nor numbers; 1.0 is a number."""
    of = lambda kind: F.coalesce(*[F.when(is_type(kind, F.lit(t)), F.lit(BIT[t])) for t in ("object", "array", "string", "boolean", "integer", "number")], F.lit(BIT["null"]))
    return let(F.schema_of_variant(v), of)


def type_names(mask: Column) -> Column:
    """The names of a mask's types, sorted."""
    return F.array_compact(F.array(*[F.when(mask.bitwiseAND(F.lit(BIT[t])) != 0, F.lit(t)) for t in TYPES]))


def _quoted(text: Column) -> Column:
    return F.regexp_replace(F.to_json(F.array(text)), r"(?s)^\[|\]$", "")


def example(v: Column, level: int = 0) -> Column:
    """A value's JSON text, cut: strings after 160 characters, lists after 3 entries, objects after 8 fields, and from the third level
    on only the type's name."""
    if level == EXAMPLE_LEVELS:
        return _quoted(F.concat(F.lit("<"), F.get(type_names(type_bit(v)), F.lit(0)), F.lit(">")))
    text = _quoted(F.left(F.try_variant_get(v, "$", "string"), F.lit(EXAMPLE_CHARS)))
    listed = F.array_join(F.transform(F.slice(elements(v), 1, EXAMPLE_ENTRIES), lambda e: example(e, level + 1)), ",")
    fields = F.array_join(F.transform(F.slice(F.map_entries(entries(v)), 1, EXAMPLE_FIELDS), lambda e: F.concat(_quoted(e["key"]), F.lit(":"), example(e["value"], level + 1))), ",")
    return F.when(is_kind(v, "STRING"), text).when(is_kind(v, "ARRAY"), F.concat(F.lit("["), listed, F.lit("]"))).when(is_kind(v, "OBJECT"), F.concat(F.lit("{"), fields, F.lit("}"))).otherwise(F.to_json(v))


def nodes(raw: Column, levels: int = MOST_LEVELS) -> Column:
    """array<struct<path, value>> of all fields of a VARIANT object and of the objects in it, not of those in lists."""
    inside = lambda n: F.transform(F.map_entries(entries(n["value"])), lambda e: F.struct(F.array_append(n["path"], e["key"]).alias("path"), e["value"].alias("value")))

    def step(state: Column, _: Column) -> Column:
        below = F.flatten(F.transform(F.filter(state["open"], lambda n: is_kind(n["value"], "OBJECT")), inside))
        return let(below, lambda b: F.struct(b.alias("open"), F.concat(state["done"], b).alias("done")))

    first = F.array(F.struct(F.array().cast("array<string>").alias("path"), raw.alias("value"))).cast(NODES)
    deep = F.least(F.lit(levels), F.greatest(F.lit(1), F.regexp_count(F.to_json(raw), F.lit(r"\{"))))
    return F.aggregate(F.sequence(F.lit(1), deep), F.struct(first.alias("open"), F.array().cast(NODES).alias("done")), step)["done"]


def profile(rows: DataFrame, raw: str = "raw", examples: int = 2) -> DataFrame:
    """(path, present, types, element_types, examples): one row per path of the objects in `raw`, with the number of rows that have it,
    the types of its values and of the entries of its lists, and up to `examples` different cut values as JSON text.

    Examples are the least and the greatest by a hash of the text, under as many hashes as are needed, so they don't depend
    on the order of rows, and two are found wherever there are two. A key that holds null counts as present. Null rows and
    rows that aren't objects have no paths; repeated rows count again; an empty table gives no rows. Fields beyond ten levels
    aren't looked at.
    """
    each = rows.select(F.explode(nodes(F.col(raw))).alias("n")).select(
        F.col("n.path").alias("path"), type_bit(F.col("n.value")).alias("mask"), example(F.col("n.value")).alias("example"),
        F.aggregate(elements(F.col("n.value")), F.lit(0), lambda a, e: a.bitwiseOR(type_bit(e))).alias("inner"),
    )
    kept = []
    for i in range((examples + 1) // 2):
        ranked = F.struct(F.md5(F.concat(F.lit(f"{i}:"), "example").cast("binary")), "example")
        kept += [F.min(ranked)["example"], F.max(ranked)["example"]]
    some = F.slice(F.array_distinct(F.array(*kept)), 1, examples) if kept else F.array().cast("array<string>")
    merged = each.groupBy("path").agg(F.count(F.lit(1)).alias("present"), F.bit_or("mask").alias("mask"), F.bit_or("inner").alias("inner"), some.alias("examples"))
    return merged.select("path", "present", type_names(F.col("mask")).alias("types"), type_names(F.col("inner")).alias("element_types"), "examples")


def fingerprint(profiled: DataFrame, version: str = "schema-profile-v1") -> DataFrame:
    """(n_paths, fingerprint): one row, SHA-256 of the paths with their types in canonical JSON; values, counts and the order of rows
    don't matter. More than 512 paths are refused, and no more are ever brought together."""
    one = F.struct(F.col("element_types").alias("list_element_types"), "path", "types")
    least = profiled.orderBy("path").limit(MOST_PATHS + 1).agg(F.array_sort(F.collect_list(F.struct("path", one.alias("one")))).alias("paths"))
    told = F.to_json(F.struct(F.transform("paths", lambda p: p["one"]).alias("paths"), F.lit(version).alias("schema_version")))
    refuse = F.raise_error(F.lit(f"more than {MOST_PATHS} paths")).cast("string")
    return least.select(F.size("paths").alias("n_paths"), F.when(F.size("paths") > MOST_PATHS, refuse).otherwise(F.sha2(told, 256)).alias("fingerprint"))


def shapes(rows: DataFrame, raw: str = "raw", order: str = "source_row_index", sample: int = 20) -> DataFrame:
    """(field, shapes): shapes of the top-level fields in the first `sample` rows by `order`; a list's shape names its entries' types."""
    short = lambda v: F.get(type_names(type_bit(v)), F.lit(0))
    listed = lambda v: F.concat(F.lit("list["), F.array_join(F.array_sort(F.array_distinct(F.transform(elements(v), short))), "|"), F.lit("]"))
    first = rows.where(is_kind(F.col(raw), "OBJECT")).orderBy(order).limit(sample)
    each = first.select(F.explode(entries(F.col(raw))).alias("field", "v")).select("field", F.when(is_kind(F.col("v"), "ARRAY"), listed(F.col("v"))).otherwise(short(F.col("v"))).alias("shape"))
    return each.groupBy("field").agg(F.array_sort(F.collect_set("shape")).alias("shapes"))


@dataclass(frozen=True)
class Source:
    """Where an adapter's target takes its value from. `part` is how: the value itself, in a template, or as a field of an object."""

    target: str
    path: tuple[str, ...]
    transforms: tuple[str, ...] = field(default=())
    part: str = "value"


def source_rows(spark: SparkSession, sources: Sequence[Source]) -> DataFrame:
    return spark.createDataFrame([(s.target, list(s.path), list(s.transforms), s.part) for s in sources], "target string, path array<string>, transforms array<string>, part string")


def checked_sources(sources: DataFrame, profiled: DataFrame) -> DataFrame:
    """sources plus result_types and issue: the types that a chain of transforms may give for the types seen at its path.

    issue is null, or the first of: absent_path, unsupported_transform, strip_of_non_strings, template_of_non_scalar,
    unexpected_type (the target takes one type, and another may come out). A JSON text that is parsed may become any type. All transforms
    of the chain are read even behind a fault. Repeated sources are checked each; both tables may be large, they meet by path.
    """

    def step(state: Column, name: Column) -> Column:
        mask = state["mask"]
        parsed = F.when(mask.bitwiseAND(F.lit(BIT["string"])) != 0, F.lit(ANY)).otherwise(mask)
        to = F.when(name == "parse_jsonish", parsed).when(name == "strip", F.lit(BIT["string"]))
        for transform, kind in TRANSFORMS.items():
            to = to.when(name == transform, F.lit(BIT[kind]))
        wrong = F.when(~name.isin("parse_jsonish", "strip", *TRANSFORMS), "unsupported_transform").when((name == "strip") & (mask != BIT["string"]), "strip_of_non_strings")
        return F.struct(F.coalesce(to, mask).alias("mask"), F.coalesce(state["issue"], wrong).alias("issue"))

    seen = F.aggregate(F.col("types"), F.lit(0), lambda a, t: a.bitwiseOR(sum((F.when(t == x, F.lit(b)).otherwise(F.lit(0)) for x, b in BIT.items()), F.lit(0))))
    met = sources.join(profiled.select("path", "types"), "path", "left")
    chain = met.withColumn("c", F.aggregate(F.coalesce("transforms", F.array().cast("array<string>")), F.struct(seen.alias("mask"), F.lit(None).cast("string").alias("issue")), step))
    composite = F.col("c.mask").bitwiseAND(F.lit(BIT["array"] | BIT["object"])) != 0
    out = F.when(F.col("part") == "template", F.lit(BIT["string"])).when(F.col("part") == "field", F.lit(BIT["object"])).otherwise(F.col("c.mask"))
    wanted = F.create_map(*[F.lit(x) for t, kind in EXPECTED.items() for x in (t, BIT[kind])])[F.col("target")]
    issue = F.when(F.col("types").isNull(), "absent_path").when(F.col("c.issue").isNotNull(), F.col("c.issue")).when((F.col("part") == "template") & composite, "template_of_non_scalar").when(out.bitwiseAND(F.bitwise_not(wanted)) != 0, "unexpected_type")
    return chain.select(*sources.columns, F.when(F.col("types").isNotNull(), type_names(out)).alias("result_types"), issue.alias("issue"))


def component_gaps(targets: DataFrame) -> DataFrame:
    """(spec, component, status, required, missing) for rows (spec, family, target): declared components are resolved once all their targets
    are there; the components that need code never are. An unknown or null family counts as generic; a spec without targets has one row with a
    null target; repeated targets count once."""
    needs = F.create_map(*[x for f, parts in COMPONENTS.items() for x in (F.lit(f), F.array(*[F.struct(F.lit(c).alias("component"), F.array(*[F.lit(t) for t in need]).alias("required")) for c, need in parts.items()]))])
    per = targets.groupBy("spec").agg(F.min("family").alias("family"), F.collect_set(F.when(F.col("target").isin(*{t for parts in COMPONENTS.values() for need in parts.values() for t in need}), F.col("target"))).alias("have"))
    plugins = F.array(*[F.struct(F.lit(p).alias("component"), F.array().cast("array<string>").alias("required")) for p in PLUGINS])
    each = per.select("spec", "have", F.explode(F.concat(F.coalesce(F.try_element_at(needs, F.col("family")), needs["generic"]), plugins)).alias("c")).select("spec", "have", "c.*")
    missing = F.array_except("required", "have")
    status = F.when(F.size("required") == 0, "requires_trusted_plugin").when(F.size(missing) == 0, "resolved").otherwise("unresolved")
    return each.select("spec", "component", status.alias("status"), "required", missing.alias("missing"))
