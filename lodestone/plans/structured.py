"""Queries over placed findings, fused evidence, nested references, extracted states and claims, each with SQL of its own."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.functions import canonical as K
from lodestone.operators import fusion, schemas, search, states
from lodestone.plans.views import spread, table

QUERIES: dict = {}


def query(name: str, sql: str | None = None):
    def keep(f):
        QUERIES[name] = (f, sql)
        return f

    return keep


def pick(key: Column, *values) -> Column:
    """The value at key modulo their number."""
    return F.get(F.array(*[v if isinstance(v, Column) else F.lit(v) for v in values]), F.pmod(key, F.lit(len(values))).cast("int"))


def texts(*values: str) -> Column:
    return F.array(*[F.lit(v) for v in values]).cast("array<string>")


def audited_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as items of which every fourth shares its id with others, with what two audits said of each."""
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    status = lambda label, word: F.struct(F.lit(label).alias("label"), word.alias("best_answer_status"))
    against = fusion.contradictions(
        F.when(k % 3 == 0, "contradicted").otherwise("supported"),
        pick(k, texts(" a"), texts("B", ""), texts(), F.lit(None).cast("array<string>"), texts("C", "A")),
        F.array(status("A", F.when(c % 2 == 0, "best").otherwise("wrong")), status(" b", F.when(c % 3 == 0, "acceptable").otherwise("unclear"))),
        F.when(c % 4 == 0, "multiple_correct_answers").when(c % 4 == 1, "no_correct_answer"),
        F.when(k % 6 < 3, "exactly_one").otherwise("several"),
        F.when(k % 7 == 0, "a").when(k % 7 == 1, " B ").otherwise(""),
    )
    return table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey").select(
        F.concat(F.lit("r"), k.cast("string")).alias("row_uid"), F.when(k % 4 == 0, F.concat(F.lit("shared-"), (k % 100).cast("string"))).otherwise(F.concat(F.lit("o"), k.cast("string"))).alias("item_id"),
        F.sha2(k.cast("string"), 256).alias("source_row_sha256"), against.alias("contradictions"),
    )


def audit_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as findings that name a row, only an item, or what isn't there."""
    k, n, p, s = (F.col(c) for c in ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"))
    of_row = F.concat(F.lit("r"), k.cast("string"))
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_returnflag").select(
        (k * 10 + n).alias("finding_id"), F.when(n % 3 == 0, of_row).when((n % 3 == 2) & (p % 50 == 0), F.concat(F.lit("x"), p.cast("string"))).when(n % 3 == 2, of_row).alias("row_uid"),
        F.when(s % 20 == 0, "gone").when(k % 4 == 0, F.concat(F.lit("shared-"), (k % 100).cast("string"))).otherwise(F.concat(F.lit("o"), k.cast("string"))).alias("item_id"),
        F.when(n % 2 == 0, F.sha2(F.when(p % 9 == 0, (k + 1).cast("string")).otherwise(k.cast("string")), 256)).when(p % 2 == 0, "").alias("source_row_sha256"),
        pick(p, "llm_gold_audit", "llm_option_set+vote", "llm_option_applicability", "llm_question_clarity", "static_rule", "llm_quantity_consistency").alias("method"),
        pick(s, "wrong_gold_answer", "multiple_correct_answers", "ambiguous_goal", "llm_audit_failure").alias("defect_type"), F.lit("major").alias("severity"), (F.col("l_returnflag") == "A").alias("review_only"),
        ((F.col("l_returnflag") == "R") & (p % 3 == 0)).alias("needs_expert"), F.lit("substantive").alias("defect_scope"),
    )


PLACED_SQL = """it AS (SELECT 'r' || o_orderkey AS row_uid, CASE WHEN o_orderkey % 4 = 0 THEN 'shared-' || (o_orderkey % 100) ELSE 'o' || o_orderkey END AS item_id, sha256(o_orderkey::VARCHAR) AS hash, o_orderkey AS k, o_custkey AS c FROM orders),
fd AS (SELECT l_orderkey * 10 + l_linenumber AS finding_id,
  CASE WHEN l_linenumber % 3 = 0 THEN 'r' || l_orderkey WHEN l_linenumber % 3 = 2 THEN CASE WHEN l_partkey % 50 = 0 THEN 'x' || l_partkey ELSE 'r' || l_orderkey END END AS row_uid,
  CASE WHEN l_suppkey % 20 = 0 THEN 'gone' WHEN l_orderkey % 4 = 0 THEN 'shared-' || (l_orderkey % 100) ELSE 'o' || l_orderkey END AS item_id,
  CASE WHEN l_linenumber % 2 = 0 THEN sha256((l_orderkey + (l_partkey % 9 = 0)::INT)::VARCHAR) WHEN l_partkey % 2 = 0 THEN '' END AS hash,
  ['llm_gold_audit', 'llm_option_set+vote', 'llm_option_applicability', 'llm_question_clarity', 'static_rule', 'llm_quantity_consistency'][l_partkey % 6 + 1] AS method,
  ['wrong_gold_answer', 'multiple_correct_answers', 'ambiguous_goal', 'llm_audit_failure'][l_suppkey % 4 + 1] AS defect_type, l_returnflag = 'A' AS review_only, l_returnflag = 'R' AND l_partkey % 3 = 0 AS expert FROM lineitem),
ids AS (SELECT item_id, count(*) AS n, min(row_uid) AS only_row FROM it GROUP BY 1),
pl AS (SELECT f.*, coalesce(f.row_uid, CASE WHEN ids.n = 1 THEN only_row END) AS uid,
  CASE WHEN it.row_uid IS NOT NULL THEN 'row_uid' WHEN f.row_uid IS NOT NULL THEN 'unknown_row' WHEN ids.n = 1 THEN 'item_id' WHEN ids.n > 1 THEN 'ambiguous_item_id' ELSE 'unknown_item_id' END AS resolution
  FROM fd f LEFT JOIN it ON f.row_uid = it.row_uid LEFT JOIN ids ON f.row_uid IS NULL AND f.item_id = ids.item_id)"""


@query("finding_resolution", f"WITH {PLACED_SQL} SELECT resolution, count(*) AS n, count(DISTINCT uid) AS places FROM pl GROUP BY 1")
def finding_resolution(spark, sf_dir):
    placed = fusion.on_items(audit_findings(spark, sf_dir), audited_items(spark, sf_dir))
    return placed.groupBy("resolution").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("row_uid").alias("places"))


@query("finding_identity", f"""WITH {PLACED_SQL} SELECT CASE WHEN f.row_uid IS NULL THEN 'no_row_uid' WHEN it.row_uid IS NULL THEN 'unknown_row' WHEN f.item_id <> it.item_id THEN 'other_item_id'
 WHEN f.hash <> '' AND f.hash <> it.hash THEN 'other_source_hash' ELSE 'resolved' END AS identity, count(*) AS n FROM fd f LEFT JOIN it ON f.row_uid = it.row_uid GROUP BY 1""")
def finding_identity(spark, sf_dir):
    return fusion.strictly_on_items(audit_findings(spark, sf_dir), audited_items(spark, sf_dir)).groupBy("identity").agg(F.count(F.lit(1)).alias("n"))


FUSED_SQL = f"""{PLACED_SQL},
ob AS (SELECT row_uid, item_id, CASE k % 5 WHEN 0 THEN ['A'] WHEN 1 THEN ['B'] WHEN 4 THEN ['A', 'C'] ELSE [] END AS rights, list_filter([CASE WHEN c % 2 = 0 THEN 'A' END, CASE WHEN c % 3 = 0 THEN 'B' END], lambda x: x IS NOT NULL) AS best,
  c % 4 AS defect, k % 6 < 3 AS single, k % 3 = 0 AS contradicted, CASE k % 7 WHEN 0 THEN 'A' WHEN 1 THEN 'B' END AS declared FROM it),
ag AS (SELECT row_uid, item_id,
  CASE WHEN len(rights) > 0 AND len(best) > 0 AND NOT list_has_any(rights, best) THEN 'gold correct_answers=[''' || array_to_string(rights, ''', ''') || '''] conflicts with option best_answers=[''' || array_to_string(best, ''', ''') || ''']' END AS r1,
  CASE WHEN single AND defect = 0 THEN 'option defect says multiple_correct_answers but cardinality is exactly_one' WHEN single AND defect = 1 THEN 'option defect says no_correct_answer but cardinality is exactly_one' END AS r2,
  CASE WHEN contradicted AND list_contains(best, declared) THEN 'gold auditor contradicts the declared gold while option auditor still marks it as best' END AS r3 FROM ob),
fl AS (SELECT uid, list_sort(list_distinct(list(CASE WHEN starts_with(method, 'llm_') AND defect_type <> 'llm_audit_failure' THEN split_part(method, '+', 1) END))) AS models, list_distinct(list(CASE WHEN NOT starts_with(method, 'llm_') THEN defect_type END)) AS others FROM pl GROUP BY uid),
mt AS (SELECT pl.*, models, others, starts_with(method, 'llm_') AND defect_type <> 'llm_audit_failure' AS really, CASE split_part(method, '+', 1) WHEN 'llm_gold_audit' THEN concat_ws('|', r1, r3) WHEN 'llm_option_set' THEN concat_ws('|', r1, r2, r3) ELSE '' END AS told
  FROM pl JOIN fl ON pl.uid IS NOT DISTINCT FROM fl.uid LEFT JOIN ag ON pl.uid = ag.row_uid)"""


@query("evidence_fusion", f"""WITH {FUSED_SQL}
SELECT finding_id, uid AS row_uid, resolution, method, defect_type, CASE WHEN really AND (told <> '' OR expert) THEN 'review' ELSE 'major' END AS severity, review_only OR (really AND (told <> '' OR expert)) AS review_only,
 CASE WHEN really AND told <> '' THEN told END AS contradictions, really AND told = '' AND method = 'llm_question_clarity' AND list_contains(others, defect_type) AS corroborated_by_non_llm,
 CASE WHEN really AND told = '' AND NOT expert AND len(models) >= 2 THEN array_to_string(models, '|') END AS llm_corroborated_by,
 really AND told = '' AND NOT expert AND method = 'llm_option_applicability' AND models = ['llm_option_applicability'] AND len(others) = 0 AS exploratory FROM mt
UNION ALL SELECT NULL, row_uid, 'row_uid', 'llm_evidence_fusion', 'auditor_contradiction', 'review', true, concat_ws('|', r1, r2, r3), false, NULL, false FROM ag JOIN fl ON fl.uid = ag.row_uid WHERE concat_ws('|', r1, r2, r3) <> ''""")
def evidence_fusion(spark, sf_dir):
    fused = fusion.fuse(audit_findings(spark, sf_dir), audited_items(spark, sf_dir))
    joined = lambda c: F.array_join(c, "|").alias({"auditor_contradictions": "contradictions"}.get(c, c))
    return fused.select("finding_id", "row_uid", "resolution", "method", "defect_type", "severity", "review_only", joined("auditor_contradictions"), "corroborated_by_non_llm", joined("llm_corroborated_by"), "exploratory")


#: A tool that takes an order, one without parameters, and an entry without a name.
TOOLS = """{"tools": [{"type": "function", "function": {"name": "place_order", "parameters": {"type": "object", "required": ["id", "status"], "additionalProperties": false, "properties": {
 "id": {"type": "integer"}, "status": {"type": ["string", "null"], "enum": ["F", "O", null]}, "total": {"type": "number"},
 "lines": {"type": "array", "items": {"type": "object", "required": ["qty"], "properties": {"qty": {"type": "integer"}, "unit": {"enum": ["box", 1]}}}}}}}}, {"name": "plain"}, {"parameters": {}}], "question": "text"}"""


def order_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as calls of place_order, with faults by key; those of customers that divide by 40 have no structured reference."""
    k = F.col("o_orderkey")
    text = lambda *parts: F.concat(*[p.cast("string") if isinstance(p, Column) else F.lit(p) for p in parts])
    number = F.when(k % 11 == 0, text('"', k, '"')).when(k % 13 == 0, text(k, ".5")).otherwise(text(k))
    status = F.when(k % 37 == 0, "").when(k % 17 == 0, ', "status": null').otherwise(text(', "status": "', F.col("o_orderstatus"), '"'))
    total = F.when(k % 19 == 0, ', "total": true').otherwise(text(', "total": ', F.col("o_totalprice").cast("decimal(18,2)")))
    second = F.when(k % 41 == 0, ", 7").when(k % 43 == 0, ', {"unit": 1.0}').otherwise("")
    lines = text(', "lines": [{"qty": ', k % 7, ', "unit": "', F.when(k % 5 == 0, "bag").otherwise("box"), '"}', second, "]")
    note = F.when(k % 23 == 0, ', "note": []').otherwise("")
    more = text(F.when(k % 29 == 0, ', "cancel_2": {}').otherwise(""), F.when(k % 31 == 0, ', "plain": {}').otherwise(""))
    call = text('{"place_order', F.when(k % 3 == 0, "").otherwise(text("_", k % 3)), '": {"id": ', number, status, total, lines, note, "}", more, "}")
    return spread(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice")).select(k.cast("string").alias("item_id"), F.when(F.col("o_custkey") % 40 == 0, text("[", k, "]")).otherwise(call).alias("reference_solution"), F.lit(TOOLS).alias("context"))


@query("reference_schema_issues", """WITH o AS (SELECT o_orderkey AS k, o_orderkey::VARCHAR AS item_id, 'place_order' || CASE WHEN o_orderkey % 3 = 0 THEN '' ELSE '_' || (o_orderkey % 3) END AS f, o_orderstatus AS s FROM orders WHERE o_custkey % 40 <> 0)
SELECT item_id, f || '.id' AS path, 'type_mismatch' AS kind FROM o WHERE k % 11 = 0 OR k % 13 = 0 UNION ALL SELECT item_id, f || '.status', 'missing_required' FROM o WHERE k % 37 = 0
UNION ALL SELECT item_id, f || '.status', 'enum_mismatch' FROM o WHERE k % 37 <> 0 AND k % 17 <> 0 AND s NOT IN ('F', 'O') UNION ALL SELECT item_id, f || '.total', 'type_mismatch' FROM o WHERE k % 19 = 0
UNION ALL SELECT item_id, f || '.note', 'unknown_property' FROM o WHERE k % 23 = 0 UNION ALL SELECT item_id, 'cancel_2', 'missing_function_schema' FROM o WHERE k % 29 = 0 UNION ALL SELECT item_id, 'plain', 'missing_parameters_schema' FROM o WHERE k % 31 = 0
UNION ALL SELECT item_id, f || '.lines[0].unit', 'enum_mismatch' FROM o WHERE k % 5 = 0 UNION ALL SELECT item_id, f || '.lines[1]', 'type_mismatch' FROM o WHERE k % 41 = 0 UNION ALL SELECT item_id, f || '.lines[1].qty', 'missing_required' FROM o WHERE k % 43 = 0 AND k % 41 <> 0""")
def reference_schema_issues(spark, sf_dir):
    return schemas.issue_rows(schemas.with_schema_issues(order_calls(spark, sf_dir)))


@query("oracle_comparison_groups", """WITH p AS (SELECT lower(p_brand) AS brand, CASE WHEN p_partkey % 5 = 4 THEN 'true' ELSE p_size::VARCHAR END AS size, p_partkey % 5 AS form FROM part)
SELECT brand, size, count(*) AS n, count(DISTINCT form) AS forms FROM p GROUP BY 1, 2""")
def oracle_comparison_groups(spark, sf_dir):
    k, brand, size = F.col("p_partkey"), F.col("p_brand"), F.col("p_size").cast("string")
    form = pick(
        k, F.concat(F.lit('{"name": "'), F.upper(brand), F.lit('!", "size": ["'), size, F.lit('.0"]}')), F.concat(F.lit('{"size": ['), size, F.lit('], "name": "'), brand, F.lit('"}')),
        F.concat(F.lit('{"NAME ": " '), brand, F.lit('  .", "ＳＩＺＥ": ["+'), size, F.lit('"]}')), F.concat(F.lit('{"name": "'), brand, F.lit('。", "size": ['), size, F.lit(".00]}")), F.concat(F.lit('{"name": "'), brand, F.lit('", "size": [true]}')),
    )
    rows = table(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_size").select(form.alias("raw"), F.lower(brand).alias("brand"), F.when(k % 5 == 4, "true").otherwise(size).alias("size"), (k % 5).alias("form"))
    compared = K.with_comparison(rows.withColumn("value", F.parse_json("raw")), "value")
    return compared.groupBy("comparison").agg(F.min("brand").alias("brand"), F.min("size").alias("size"), F.count(F.lit(1)).alias("n"), F.count_distinct("form").alias("forms")).drop("comparison")


@query("field_disagreements", """WITH o AS (SELECT o_orderkey AS k FROM orders) SELECT k % 6 AS kind, count(*) AS rows_seen, sum((k % 6 IN (1, 4, 5))::INT)::BIGINT AS disagree FROM o GROUP BY 1""")
def field_disagreements(spark, sf_dir):
    k = F.col("o_orderkey")
    left = F.concat(F.lit('{"a": '), k.cast("string"), F.lit(', "b": [1, "x"]}'))
    right = pick(k, F.concat(F.lit('{"b": [1, "x"], "a": '), k.cast("string"), F.lit("}")), F.concat(F.lit('{"b": ["x", 1], "a": '), k.cast("string"), F.lit("}")), F.lit("{}"), F.lit(None).cast("string"), F.concat(F.lit('{"b": [1, "x"], "a": "'), k.cast("string"), F.lit('"}')), F.lit("[0]"))
    rows = spread(table(spark, sf_dir, "orders").select("o_orderkey")).select((k % 6).alias("kind"), F.parse_json(left).alias("l"), F.try_parse_json(right).alias("r"))
    differs = K.filled(F.col("l")) & K.filled(F.col("r")) & ~K.same_json(F.col("l"), F.col("r"))
    return rows.groupBy("kind").agg(F.count(F.lit(1)).alias("rows_seen"), F.count_if(differs).alias("disagree"))


def order_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as state models; their few lines, by number and then by their other columns, are the events."""
    line = lambda x, i: F.struct(
        i.cast("double").alias("stage"), F.when(x["l_returnflag"] == "R", "remove").when(x["l_linenumber"] % 4 == 0, "SET").when(x["l_partkey"] % 70 == 0, "look").otherwise("add").alias("operation"),
        F.when(x["l_partkey"] % 40 != 0, F.when(x["l_partkey"] % 33 == 0, -x["l_quantity"]).otherwise(x["l_quantity"])).cast("double").alias("amount"), F.when(x["l_suppkey"] % 9 == 0, "after he lost some").otherwise("told").alias("evidence"),
    )
    columns = ["l_linenumber", "l_partkey", "l_suppkey", "l_returnflag", "l_quantity"]
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", F.struct(*columns).alias("e")).groupBy("l_orderkey").agg(F.array_sort(F.collect_list("e")).alias("lines"))
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    return lines.join(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), k == F.col("l_orderkey")).select(
        k.alias("order_id"), F.when(k % 3 != 0, (c % 50).cast("double")).alias("initial"), F.when(k % 4 < 2, (c % 70).cast("double")).alias("final"), F.when(k % 5 == 0, F.lit(60.0)).alias("most"), F.transform("lines", line).alias("events")
    )


EVENTS_SQL = r"""e AS (SELECT l_orderkey AS k, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_returnflag, l_quantity) AS n, CASE WHEN l_returnflag = 'R' THEN 'remove' WHEN l_linenumber % 4 = 0 THEN 'set' WHEN l_partkey % 70 = 0 THEN 'look' ELSE 'add' END AS op,
  CASE WHEN l_partkey % 40 <> 0 THEN CASE WHEN l_partkey % 33 = 0 THEN -l_quantity ELSE l_quantity END END::DOUBLE AS amount, l_suppkey % 9 = 0 AS vague FROM lineitem),
z AS (SELECT k, max(n) AS events FROM e GROUP BY k),
m AS (SELECT o_orderkey AS k, events, CASE WHEN o_orderkey % 3 <> 0 THEN (o_custkey % 50)::DOUBLE END AS initial, CASE WHEN o_orderkey % 4 < 2 THEN (o_custkey % 70)::DOUBLE END AS final, CASE WHEN o_orderkey % 5 = 0 THEN 60.0::DOUBLE END AS most FROM orders JOIN z ON k = o_orderkey),
st AS (WITH RECURSIVE s AS (SELECT k, events, 0::BIGINT AS n, initial AS now, 0.0::DOUBLE AS net, false AS was_set, false AS lost, NULL::VARCHAR AS found, NULL::DOUBLE AS value, NULL::DOUBLE AS bound FROM m
  UNION ALL SELECT s.k, events, s.n + 1,
   CASE WHEN op IN ('add', 'remove') AND amount IS NULL THEN NULL WHEN op = 'add' AND amount >= 0 THEN now + amount WHEN op = 'remove' AND amount >= 0 THEN now - amount WHEN op = 'set' AND amount >= 0 THEN amount ELSE now END,
   net + CASE WHEN op = 'add' AND amount >= 0 THEN amount WHEN op = 'remove' AND amount >= 0 THEN -amount ELSE 0 END, was_set OR coalesce(op = 'set' AND amount >= 0, false),
   lost OR coalesce(op IN ('add', 'remove') AND amount IS NULL, false) OR coalesce(op = 'set' AND amount >= 0 AND vague, false),
   CASE WHEN op = 'remove' AND amount >= 0 AND amount > now + 1e-9 THEN 'removal_exceeds_available' WHEN op = 'set' AND amount >= 0 AND NOT vague AND NOT lost AND abs(now - amount) > 1e-9 THEN 'state_transition_mismatch' END, amount, now
  FROM s JOIN e ON e.k = s.k AND e.n = s.n + 1) SELECT * FROM s),
l AS (SELECT m.*, net, was_set OR lost AS loose, coalesce(final, now) AS last FROM st JOIN m USING (k) WHERE n = m.events)"""


@query("event_state_findings", f"""WITH {EVENTS_SQL} SELECT k AS order_id, found AS finding_type, value, bound FROM st WHERE found IS NOT NULL
UNION ALL SELECT k, 'negative_inferred_initial_state', final - net, final FROM l WHERE NOT loose AND initial IS NULL AND final - net < -1e-9 UNION ALL SELECT k, 'final_state_mismatch', initial + net, final FROM l WHERE NOT loose AND abs(initial + net - final) > 1e-9
UNION ALL SELECT k, 'state_exceeds_required_limit', last, most FROM l WHERE last > most + 1e-9""")
def event_state_findings(spark, sf_dir):
    found = states.state_findings(F.col("initial"), F.col("final"), F.col("most"), F.col("events"))
    return order_events(spark, sf_dir).select("order_id", F.explode(found).alias("f")).select("order_id", "f.*")


@query("quantity_findings", r"""WITH c AS (SELECT l_orderkey AS k, l_quantity::DOUBLE AS a, ['<=', '>=', '==', '<', '>', '~'][l_partkey % 6 + 1] AS rel, (l_suppkey % 51)::DOUBLE AS b, CASE WHEN l_partkey % 4 = 0 THEN NULL ELSE (l_partkey % 10) / 10.0 END AS own, l_suppkey % 3 <> 0 AS grounded, l_linenumber % 2 = 0 AS material, l_partkey % 13 = 0 AS issue FROM lineitem),
o AS (SELECT o_orderkey AS k, (o_orderkey % 10) / 10.0 AS conf, CASE WHEN o_custkey % 3 = 0 THEN 'solved' ELSE 'uncertain' END AS solved, o_custkey % 40 AS gold, o_orderkey % 40 AS got, o_custkey % 5 = 0 AS two FROM orders),
v AS (SELECT c.*, coalesce(own, conf) AS sure, grounded AND coalesce(CASE rel WHEN '<=' THEN a > b + 1e-9 WHEN '>=' THEN a + 1e-9 < b WHEN '==' THEN abs(a - b) > 1e-9 WHEN '<' THEN NOT (a < b AND abs(a - b) > 1e-9) WHEN '>' THEN NOT (a > b AND abs(a - b) > 1e-9) END, false) AS bad FROM c JOIN o USING (k)),
g AS (SELECT k, material, max(sure) AS confidence, count(*)::INT AS n FROM v WHERE bad AND sure >= 0.5 GROUP BY ALL UNION ALL SELECT k, material, max(coalesce(own, 0)), count(*)::INT FROM v WHERE issue AND coalesce(own, 0) >= 0.5 GROUP BY ALL),
f AS (SELECT k, CASE WHEN material THEN 'llm_quantity_consistency' ELSE 'llm_quantity_consistency_nonmaterial' END AS method, 'ambiguous_goal' AS defect_type, max(sure)::DOUBLE AS confidence, NOT material OR max(sure) < 0.8 AS review_only, count(*)::INT AS n FROM v WHERE bad AND sure >= 0.5 GROUP BY k, material
 UNION ALL SELECT k, CASE WHEN material THEN 'llm_quantity_consistency' ELSE 'llm_quantity_consistency_nonmaterial' END, 'ambiguous_goal', max(own)::DOUBLE, true, count(*)::INT FROM v WHERE issue AND own >= 0.5 GROUP BY k, material
 UNION ALL SELECT k, 'llm_quantity_consistency', 'wrong_gold_answer', conf::DOUBLE, true, 1 FROM o WHERE solved = 'solved' AND NOT (two AND got <> 7) AND got <> gold AND conf >= 0.5 AND k IN (SELECT k FROM c))
SELECT k AS order_id, method, defect_type, confidence, review_only, n FROM f""")
def quantity_findings(spark, sf_dir):
    p, s, n = F.col("l_partkey"), F.col("l_suppkey"), F.col("l_linenumber")
    own = F.when(p % 4 != 0, (p % 10) / F.lit(10.0))
    check = F.struct(F.col("l_quantity").cast("double").alias("left_value"), pick(p, "<=", ">=", "==", "<", ">", "~").alias("relation"), (s % 51).cast("double").alias("right_value"), own.alias("confidence"), (s % 3 != 0).alias("fully_grounded"), (n % 2 == 0).alias("material_to_answer"))
    issue = F.when(p % 13 == 0, F.struct(own.alias("confidence"), (n % 2 == 0).alias("material_to_answer")))
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", check.alias("c"), issue.alias("i")).groupBy("l_orderkey").agg(F.collect_list("c").alias("checks"), F.collect_list("i").alias("issues"))
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    rows = lines.join(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), k == F.col("l_orderkey"))
    got = (k % 40).cast("string")
    derived = F.when(c % 5 == 0, F.array(F.concat(F.lit("x = "), got, F.lit(".0")), F.lit("7"))).otherwise(F.array(got, F.lit("none"), F.concat(got, F.lit(".00"))))
    found = states.quantity_findings(F.col("checks"), F.col("issues"), derived, F.when(c % 3 == 0, "solved").otherwise("uncertain"), (k % 10) / F.lit(10.0), F.concat(F.lit("about "), (c % 40).cast("string")), 0.8, 0.5)
    return rows.select(k.alias("order_id"), F.explode(found).alias("f")).select("order_id", "f.*")


@query("phrase_hits", r"""WITH t AS (SELECT item_id AS term_id, list_slice(regexp_extract_all(lower(text), '[\p{L}\p{N}]+'), 2, 4) AS w FROM benchmark),
d AS (SELECT doc_id, ' ' || array_to_string(regexp_extract_all(lower(text), '[\p{L}\p{N}]+'), '  ') || ' ' AS t FROM documents)
SELECT term_id, doc_id, ((length(t) - length(replace(t, p, ''))) / length(p))::INT AS hits FROM d JOIN (SELECT term_id, ' ' || array_to_string(w, '  ') || ' ' AS p FROM t WHERE len(w) > 0) ON contains(t, p)""")
def phrase_hits(spark, sf_dir):
    terms = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("term_id"), F.array_join(F.slice(search.words(F.col("text")), 2, 3), " ").alias("term"))
    return search.phrase_hits(table(spark, sf_dir, "documents"), terms).select("term_id", "doc_id", "hits")


@query("search_terms", r"""SELECT p_partkey AS part_id, CASE WHEN p_size % 2 = 0 THEN 'must list ' || p_size || '%|' || p_size || '|' || p_size || '%x|' || p_size || '%|' ELSE '' END || CASE WHEN p_partkey % 3 = 0 THEN 'Weight share|Weight|share' ELSE 'share' END AS required,
 CASE WHEN p_size % 2 = 0 THEN 'a ' || p_size || '|' ELSE '' END || p_size || '|dir/part' || p_partkey || '.csv|part' || p_partkey || '.csv|Exact|part' || p_partkey AS grounding FROM part""")
def search_terms(spark, sf_dir):
    size, even, key = F.col("p_size").cast("string"), F.col("p_size") % 2 == 0, F.col("p_partkey")
    required = F.when(even, F.array(F.concat(F.lit("must_list "), size, F.lit("%")), F.concat(size, F.lit("%x"))))
    rubric = F.concat(F.lit("Exact, "), F.when(even, F.concat(F.lit("'a "), size, F.lit("', "))).otherwise(""), size, F.lit(", dir/part"), key.cast("string"), F.lit(".csv; from exact"))
    joined = lambda c, name: F.array_join(c, "|").alias(name)
    return table(spark, sf_dir, "part").select(key.alias("part_id"), joined(search.required_terms(required, F.when(key % 3 == 0, "Weight share").otherwise("share")), "required"), joined(search.grounding_terms(rubric), "grounding"))


def told_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as tasks and rubrics that say which column holds what."""
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    letter = lambda x, n: F.substring(F.lit("ABCDEFGHIJKLMNOPQRSTUVWXYZ"), x % n + 1, F.lit(1))
    task = F.concat(F.lit("On the Summary sheet the variance goes in column "), letter(k, 5), F.lit(". If possible the Summary sheet has the variance in column Z. Q2 2024 and Q3 2024 stand in columns "), letter(c, 4), F.lit(" and "), letter(c + 1, 4), F.lit(" of the Data tab."))
    rubric = F.concat(
        F.lit("Summary sheet: column "), letter(c, 5), F.lit(" shows the variance.\nOn the Summary sheet, sampled rows are marked in column "), F.lower(letter(k, 3)), F.lit(".\n"),
        F.when(k % 2 == 0, F.concat(F.lit("On the Data tab columns "), letter(c, 4), F.lit(" and B hold Q2 and Q3 respectively."))).otherwise("The variance column in both is fine."),
    )
    return spread(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")).select(k.alias("item_id"), task.alias("task"), rubric.alias("rubric"))


CLAIM_SQL = """o AS (SELECT o_orderkey AS item_id, chr((65 + o_orderkey % 5)::INT) AS tv, chr((65 + o_custkey % 4)::INT) AS t2, chr((65 + (o_custkey + 1) % 4)::INT) AS t3, chr((65 + o_custkey % 5)::INT) AS rv, chr((65 + o_orderkey % 3)::INT) AS rs, o_orderkey % 2 = 0 AS told FROM orders)"""


@query("claim_differences", f"""WITH {CLAIM_SQL} SELECT item_id, 'deliverable:sheet:summary' AS scope, 'variance' AS role, tv AS task_columns, rv AS rubric_columns FROM o WHERE tv <> rv UNION ALL SELECT item_id, 'deliverable:sheet:data', 'q3', t3, 'B' FROM o WHERE told AND t3 <> 'B'""")
def claim_differences(spark, sf_dir):
    found = search.claim_differences(search.claim_rows(told_columns(spark, sf_dir)))
    return found.select("item_id", "scope", "role", F.array_join("task_columns", "|").alias("task_columns"), F.array_join("rubric_columns", "|").alias("rubric_columns"))


@query("rubric_contradictions", f"""WITH {CLAIM_SQL}, c AS (SELECT item_id, 'summary' AS s, 'variance' AS role, rv AS col FROM o UNION SELECT item_id, 'summary', 'sample_flag', rs FROM o UNION SELECT item_id, 'data', 'q2', t2 FROM o WHERE told UNION SELECT item_id, 'data', 'q3', 'B' FROM o WHERE told)
SELECT item_id, 'one_column_multiple_roles' AS kind, 'deliverable:sheet:' || s AS scope, col AS subject, string_agg(role, '|' ORDER BY role) AS others FROM c GROUP BY item_id, s, col HAVING count(*) > 1""")
def rubric_contradictions(spark, sf_dir):
    found = search.rubric_contradictions(search.claim_rows(told_columns(spark, sf_dir)))
    return found.withColumn("others", F.array_join("others", "|"))


@query("artifact_claims", """WITH o AS (SELECT o_orderkey AS k FROM orders) SELECT k AS item_id, CASE WHEN k % 3 = 0 THEN 'reference:in' || k || '.csv:named_reference_candidate' WHEN k % 3 = 1 THEN 'deliverable:in' || k || '.csv:exact' ELSE '' END AS files, CASE k % 4 WHEN 0 THEN '.docx' WHEN 1 THEN '.pdf' ELSE '' END AS formats FROM o""")
def artifact_claims(spark, sf_dir):
    k = F.col("o_orderkey")
    name = F.concat(F.lit("'data/in"), k.cast("string"), F.lit(".csv'"))
    file = pick(k, F.concat(F.lit("Based on the attached file "), name), F.concat(F.lit("Save the table as "), name), F.concat(F.lit("There is "), name))
    text = F.concat(file, F.lit(" for all of it, which takes some time and care to read through. "), F.lit("Whoever works on this has a whole day for it, and nothing else to do.\n"), pick(k, F.lit("Submit a Word document."), F.lit("Create a PowerPoint file as PDF."), F.lit("Create a Word file or a PowerPoint file."), F.lit("We like Word documents.")))
    files = F.array_join(F.transform(search.filename_claims(F.col("t")), lambda c: F.concat_ws(":", c["role"], c["name"], c["policy"])), "|")
    formats = F.array_join(F.transform(search.format_claims(F.col("t")), lambda c: c["extension"]), "|")
    return spread(table(spark, sf_dir, "orders").select("o_orderkey")).select(k.alias("item_id"), text.alias("t")).select("item_id", files.alias("files"), formats.alias("formats"))
