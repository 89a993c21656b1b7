"""Scans of evaluation files into one VARIANT column per row, and sinks. Nothing is parsed on the driver."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

WRAPPERS = ("data", "items", "examples", "rows")


class BadRows(ValueError):
    """Rows that aren't JSON objects; names the first ten."""


def _checked(rows: DataFrame) -> DataFrame:
    bad = rows.where("raw is null or schema_of_variant(raw) not like 'OBJECT%'").select("source", "source_row_index").orderBy("source", "source_row_index").limit(10).collect()
    if bad:
        raise BadRows(", ".join(f"{r['source']}:{r['source_row_index']}" for r in bad))
    return rows


def scan_jsonl(spark: SparkSession, path: str) -> DataFrame:
    """(source, source_row_index, raw): one object per line, blank lines skipped; anything else is refused.

    The index is a line's place among the lines of its file by byte offset order, from the reader's own row order.
    """
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("source"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"), "value")
    order = Window.partitionBy("source").orderBy("block", "at")
    numbered = lines.withColumn("source_row_index", F.row_number().over(order) - 1).where(F.trim("value") != "")
    return _checked(numbered.select("source", "source_row_index", F.try_parse_json("value").alias("raw")))


def scan_json(spark: SparkSession, path: str) -> DataFrame:
    """As scan_jsonl, from whole files: a list, an object that wraps one under a known key, or a single object."""
    whole = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("source"), F.try_parse_json("value").alias("v"))
    inner = F.coalesce(*[F.try_variant_get("v", f"$.{k}", "array<variant>") for k in WRAPPERS], F.try_variant_get("v", "$", "array<variant>"), F.array("v"))
    return _checked(whole.select("source", F.posexplode(inner).alias("source_row_index", "raw")))


def scan_table(rows: DataFrame, order: Sequence[str]) -> DataFrame:
    """A table's rows as objects, numbered by `order`."""
    return rows.select(F.lit("table").alias("source"), *order, F.parse_json(F.to_json(F.struct("*"), {"ignoreNullFields": "false"})).alias("raw"))


def scan_csv(spark: SparkSession, path: str, sep: str = ",") -> DataFrame:
    """Rows of a file with a header, every value a string."""
    return spark.read.csv(path, header=True, inferSchema=False, sep=sep, multiLine=True)


def field(raw: Column, *paths: str) -> Column:
    """The first non-empty value among dotted paths of a VARIANT, as text; objects and lists come as JSON."""
    some = [F.to_json(F.try_variant_get(raw, "$." + p, "variant")) for p in paths]
    text = [F.coalesce(F.try_variant_get(raw, "$." + p, "string"), s) for p, s in zip(paths, some, strict=True)]
    return F.coalesce(*[F.when(F.trim(t) != "", t) for t in text])


def as_list(raw: Column, path: str) -> Column:
    """A list of texts: null or empty gives none, a JSON list in a string is parsed, a scalar stands alone."""
    listed = F.try_variant_get(raw, "$." + path, "array<string>")
    text = F.try_variant_get(raw, "$." + path, "string")
    parsed = F.try_variant_get(F.try_parse_json(text), "$", "array<string>")
    return F.coalesce(listed, parsed, F.when(F.trim(text) != "", F.array(text)), F.array().cast("array<string>"))


def items(rows: DataFrame) -> DataFrame:
    """Canonical items of scanned rows: ids fall back to item-<index>; uid and hash identify the source row."""
    raw, at = F.col("raw"), F.col("source_row_index")
    return rows.select(
        F.coalesce(field(raw, "id", "item_id", "question_id"), F.concat(F.lit("item-"), at.cast("string"))).alias("item_id"),
        field(raw, "question", "task", "prompt", "instruction").alias("task"),
        field(raw, "answer", "gold", "target").alias("gold"),
        as_list(raw, "choices").alias("choices"),
        as_list(raw, "aliases").alias("aliases"),
        field(raw, "output_format", "output_contract").alias("output_contract"),
        field(raw, "evaluator", "metric").alias("evaluator"),
        F.coalesce(F.try_variant_get(raw, "$.metadata", "map<string,string>"), F.create_map().cast("map<string,string>")).alias("metadata"),
        F.format_string("source-row-%08d", at).alias("row_uid"),
        F.sha2(F.to_json(raw), 256).alias("source_row_sha256"),
        at.alias("source_row_index"),
    )


def scan_responses(spark: SparkSession, path: str) -> DataFrame:
    """(model_id, item_id, correct) from files of one model each or long files; the model falls back to the file's stem."""
    rows = scan_jsonl(spark, path)
    stem = F.regexp_extract("source", r"([^/]+?)(?:\.[^./]*)?$", 1)
    return rows.select(F.coalesce(field(F.col("raw"), "model_id", "model"), stem).alias("model_id"), field(F.col("raw"), "item_id", "id").alias("item_id"), F.try_variant_get("raw", "$.correct", "boolean").cast("int").alias("correct"))


def write_findings(findings: DataFrame, path: str) -> None:
    findings.write.mode("overwrite").parquet(path)


def write_jsonl(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").json(path)


def write_leaderboard(board: DataFrame, path: str) -> None:
    board.write.mode("overwrite").csv(path, header=True)
