"""Items, responses and trials as plain projections of the tables, with the same views in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(rows: DataFrame) -> DataFrame:
    """A plain scan over fewer splits than there are cores, as of a small single file, dealt out to all of them before
    costly projections. Larger inputs have splits enough and stay as they are."""
    cores = rows.sparkSession.sparkContext.defaultParallelism
    return rows.repartition(cores) if rows.rdd.getNumPartitions() < cores else rows


def _texts() -> object:
    return F.array().cast("array<string>")


def doc_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    return docs.join(labels, "doc_id", "left").select(
        F.col("doc_id").cast("string").alias("item_id"), F.col("doc_id").alias("source_row_index"), F.col("text").alias("task"), F.col("quality").cast("string").alias("gold"),
        _texts().alias("choices"), _texts().alias("aliases"), F.lit(None).cast("string").alias("output_contract"), F.lit("exact_match").alias("evaluator"),
        F.create_map(F.lit("lang"), F.col("lang"), F.lit("origin"), F.col("source")).alias("metadata"), "lang", "source", "quality",
    )


DOC_SQL = "doc_items AS (SELECT d.doc_id::VARCHAR AS item_id, d.doc_id AS source_row_index, d.text AS task, l.quality::VARCHAR AS gold, d.lang, d.source, l.quality FROM documents d LEFT JOIN labels l USING (doc_id))"


def mcq_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as choice questions, with defects planted by key: wrong label, no gold, repeated choice, blank choice, no evaluator."""
    k = F.col("o_orderkey")
    return spread(table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_orderpriority")).select(
        k.cast("string").alias("item_id"), k.alias("source_row_index"), F.concat(F.lit("Order "), k.cast("string"), F.lit(" status?")).alias("task"),
        F.when(k % 17 == 0, "Z?").when(k % 23 == 0, F.lit(None)).otherwise(F.translate("o_orderstatus", "FOP", "ABC")).alias("gold"),
        F.when(k % 19 == 0, F.array(F.lit("F"), F.lit("O"), F.lit("F"))).when(k % 29 == 0, F.array(F.lit("F"), F.lit(""), F.lit("P"))).otherwise(F.array(F.lit("F"), F.lit("O"), F.lit("P"))).alias("choices"),
        _texts().alias("aliases"), F.when(k % 13 == 0, "numeric value").otherwise("one label").alias("output_contract"), F.when(k % 31 == 0, "").otherwise("choice_exact_match").alias("evaluator"),
        F.create_map(F.lit("priority"), F.col("o_orderpriority")).alias("metadata"),
    )


MCQ_SQL = """mcq AS (SELECT o_orderkey::VARCHAR AS item_id, o_orderkey AS k, 'Order ' || o_orderkey || ' status?' AS task,
  CASE WHEN o_orderkey % 17 = 0 THEN 'Z?' WHEN o_orderkey % 23 = 0 THEN NULL ELSE translate(o_orderstatus, 'FOP', 'ABC') END AS gold,
  CASE WHEN o_orderkey % 19 = 0 THEN ['F','O','F'] WHEN o_orderkey % 29 = 0 THEN ['F','','P'] ELSE ['F','O','P'] END AS choices,
  CASE WHEN o_orderkey % 13 = 0 THEN 'numeric value' ELSE 'one label' END AS output_contract,
  CASE WHEN o_orderkey % 31 = 0 THEN '' ELSE 'choice_exact_match' END AS evaluator, o_orderpriority AS priority FROM orders)"""


def arith_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as products to compute, wrong by one where the order key divides by 17."""
    q, n = F.col("l_quantity").cast("int"), F.col("l_linenumber")
    gold = q * n + F.when(F.col("l_orderkey") % 17 == 0, 1).otherwise(0)
    return spread(table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_returnflag")).select(
        F.concat_ws("-", F.col("l_orderkey").cast("string"), n.cast("string")).alias("item_id"), F.concat(F.lit("What is "), q.cast("string"), F.lit(" * "), n.cast("string"), F.lit("?")).alias("task"), gold.cast("string").alias("gold"),
        _texts().alias("choices"), _texts().alias("aliases"), F.lit("a number").alias("output_contract"), F.lit("numeric").alias("evaluator"), F.create_map(F.lit("flag"), F.col("l_returnflag")).alias("metadata"),
        F.col("l_returnflag").alias("flag"), (F.col("l_orderkey") % 17 == 0).alias("corrupt"),
    )


ARITH_SQL = """arith AS (SELECT l_orderkey || '-' || l_linenumber AS item_id, 'What is ' || l_quantity::INT || ' * ' || l_linenumber || '?' AS task,
  (l_quantity::INT * l_linenumber + CASE WHEN l_orderkey % 17 = 0 THEN 1 ELSE 0 END) AS gold, l_quantity::INT * l_linenumber AS product,
  l_returnflag AS flag, l_orderkey % 17 = 0 AS corrupt FROM lineitem)"""


def responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers as 20 models, parts as 200 items; correct if none of their lines was returned."""
    li = table(spark, sf_dir, "lineitem").select((F.col("l_suppkey") % 20).cast("string").alias("model_id"), (F.col("l_partkey") % 200).cast("string").alias("item_id"), "l_returnflag")
    return li.groupBy("model_id", "item_id").agg((F.max(F.when(F.col("l_returnflag") == "R", 1).otherwise(0)) == 0).cast("int").alias("correct"), F.min("l_returnflag").alias("label"))


RESP_SQL = """resp AS (SELECT (l_suppkey % 20)::VARCHAR AS model_id, (l_partkey % 200)::VARCHAR AS item_id,
  (max(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END) = 0)::INT AS correct, min(l_returnflag) AS label FROM lineitem GROUP BY 1, 2)"""


def trials(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers as 50 systems, parts as tasks, rewards from discounts; null where the line number is 7."""
    return table(spark, sf_dir, "lineitem").select(
        F.concat(F.lit("s"), F.lpad((F.col("l_suppkey") % 50).cast("string"), 2, "0")).alias("system_id"), F.col("l_partkey").alias("task_id"), F.when(F.col("l_linenumber") == 7, F.lit(None)).otherwise(F.round(F.col("l_discount") * 100)).cast("double").alias("reward")
    )


TRIAL_SQL = """trials AS (SELECT 's' || lpad((l_suppkey % 50)::VARCHAR, 2, '0') AS system_id, l_partkey AS task_id,
  CASE WHEN l_linenumber = 7 THEN NULL ELSE round(l_discount * 100) END AS reward FROM lineitem)"""


def flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four methods that each flag some line items."""
    li = table(spark, sf_dir, "lineitem").select(F.concat_ws("-", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string")).alias("item_id"), "l_returnflag", "l_quantity", "l_discount", "l_tax")
    hit = F.array_compact(F.array(F.when(F.col("l_returnflag") == "R", "m_return"), F.when(F.col("l_quantity") > 40, "m_quantity"), F.when(F.col("l_discount") > 0.085, "m_discount"), F.when(F.col("l_tax") > 0.075, "m_tax")))
    return li.select("item_id", F.explode(hit).alias("method"))


FLAG_SQL = """flags AS (SELECT DISTINCT l_orderkey || '-' || l_linenumber AS item_id, unnest(list_filter([CASE WHEN l_returnflag = 'R' THEN 'm_return' END,
  CASE WHEN l_quantity > 40 THEN 'm_quantity' END, CASE WHEN l_discount > 0.085 THEN 'm_discount' END, CASE WHEN l_tax > 0.075 THEN 'm_tax' END], lambda x: x IS NOT NULL)) AS method FROM lineitem)"""
