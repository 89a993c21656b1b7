"""Contracts of items: attachments, paths, rubrics, citations, choices, workspaces."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.functions.answers import choice_index
from lodestone.functions.text import folded, normalize_text, path_like, pieces


def missing_attachments(refs: DataFrame, listing: DataFrame) -> DataFrame:
    """(item_id, path) of path-like references that a listing of files lacks."""
    named = refs.where(path_like(F.col("path"))).select("item_id", "path").distinct()
    return named.join(listing.select("path").distinct(), "path", "left_anti").select("item_id", "path")


def listing(binary_files: DataFrame, root: str) -> DataFrame:
    """(path, kind, sha256, size) of a binaryFile scan, paths relative to root; the kind follows from the name."""
    path = F.regexp_replace("path", rf"^.*?{root}/*", "")
    low = F.lower(path)
    kind = F.when(low.rlike(r"(^|[/_-])(rubric|grader|eval)"), "evaluator").when(low.rlike(r"(gold|answer|solution)"), "gold").when(low.rlike(r"\.(jsonl?|csv|tsv|parquet)$"), "dataset").when(low.rlike(r"\.(md|txt|pdf|docx)$"), "document").otherwise("other")
    return binary_files.select(path.alias("path"), kind.alias("kind"), F.sha2("content", 256).alias("sha256"), F.col("length").alias("size"))


def output_paths(text: Column) -> Column:
    """Back-ticked paths after words that announce an output."""
    return pieces(text, r"(?i)(?:save|write|output|create|produce)[^`\n]{0,60}`([\w./-]+\.\w{1,5})`", 1)


def path_conflicts(items: DataFrame) -> DataFrame:
    """(item_id, extra, untested, reused) from task, required_files and input_files: outputs asked for but not required,
    required but not asked for, and inputs that are outputs too."""
    asked = output_paths(F.col("task"))
    return items.select("item_id", F.array_except(asked, "required_files").alias("extra"), F.array_except(F.col("required_files"), asked).alias("untested"), F.array_intersect(F.col("input_files"), F.col("required_files")).alias("reused"))


def choice_tiers(items: DataFrame) -> DataFrame:
    """(item_id, tier, n) of choices that repeat raw (T1), after folding and white space (T2), or without edge punctuation (T3);
    the first tier at which an item has repeats."""
    rows = items.select("item_id", F.explode("choices").alias("c"))
    loose = F.regexp_replace(F.trim(folded(F.col("c"))), r"(?U)\s+", " ")
    rows = rows.select("item_id", F.col("c").alias("t1"), loose.alias("t2"), F.regexp_replace(loose, r"^[\p{P}\s]+|[\p{P}\s]+$", "").alias("t3"))
    per = rows.groupBy("item_id").agg(F.count(F.lit(1)).alias("n"), *[F.count_distinct(t).alias(t) for t in ("t1", "t2", "t3")])
    tier = F.when(F.col("t1") < F.col("n"), "T1").when(F.col("t2") < F.col("n"), "T2").when(F.col("t3") < F.col("n"), "T3")
    return per.select("item_id", tier.alias("tier"), "n").where("tier is not null")


def gold_resolution(gold: Column, choices: Column) -> Column:
    """Why a gold doesn't resolve to a choice: no_choices, missing, blank, out_of_range, not_found; null if it does."""
    return (
        F.when(F.size(choices) == 0, "no_choices").when(gold.isNull(), "missing").when(F.trim(gold) == "", "blank").when(choice_index(gold, choices).isNotNull(), F.lit(None).cast("string"))
        .when(F.trim(gold).rlike("^[A-Za-z]$"), "out_of_range").otherwise("not_found")
    )


def citations(claims: DataFrame, sources: DataFrame) -> DataFrame:
    """(claim_id, status): supported if the normalised quote is in the source it names, unsupported if it isn't, unresolved
    if there is no such source."""
    joined = claims.join(sources, "source_id", "left")
    quote = F.contains(normalize_text(F.col("text")), normalize_text(F.col("quote")))
    return joined.select("claim_id", F.when(F.col("text").isNull(), "unresolved").when(quote, "supported").otherwise("unsupported").alias("status"))


def repeated_rubrics(items: DataFrame) -> DataFrame:
    """(rubric_id, n, items) of rubric ids that occur more than once over all items. items: item_id, rubric_ids."""
    rows = items.select("item_id", F.explode("rubric_ids").alias("rubric_id"))
    return rows.groupBy("rubric_id").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("item_id").alias("items")).where("n > 1")


def pretty_rubric(text: Column) -> Column:
    """Array of struct(points, criterion) from lines like "[+2] names the city"."""
    marks = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"\[([+-]?\d+)\]\s*([^\n]+)"), 1)
    said = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"\[([+-]?\d+)\]\s*([^\n]+)"), 2)
    return F.zip_with(marks, said, lambda p, c: F.struct(p.try_cast("int").alias("points"), F.trim(c).alias("criterion")))


def workspace_issues(items: DataFrame) -> DataFrame:
    """(item_id, issue) of a workspace item: set and cardinality invariants between its parts.

    items: item_id, output_files, required_files, rubrics, evaluator_rubrics, rubric_types, manifest (names), files (present),
    edges (struct from, to).
    """
    c = F.col
    differs = lambda a, b: (F.size(F.array_except(a, b)) > 0) | (F.size(F.array_except(b, a)) > 0)
    ends = F.flatten(F.transform("edges", lambda e: F.array(e["from"], e["to"])))
    issues = {
        "outputs_differ_from_contract": differs("output_files", "required_files"),
        "rubrics_differ_from_evaluator": differs("rubrics", "evaluator_rubrics"),
        "rubric_type_count": (F.size("rubric_types") > 0) & (F.size("rubric_types") != F.size("rubrics")),
        "manifest_without_file": F.size(F.array_except("manifest", "files")) > 0,
        "dangling_edge": F.size(F.array_except(F.array_except(ends, "manifest"), c("output_files"))) > 0,
        "repeated_rubric": F.size(F.array_distinct("rubrics")) < F.size("rubrics"),
        "unsafe_path": F.exists(F.concat("output_files", "manifest"), lambda p: p.rlike(r"^/|(^|/)\.\.(/|$)")),
    }
    found = F.array_compact(F.array(*[F.when(v, F.lit(k)) for k, v in issues.items()]))
    return items.select("item_id", F.explode(found).alias("issue"))
