"""Queries over checkers, evidence and labels, each with the SQL that says the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.functions import answers as A
from lodestone.functions import text as X
from lodestone.operators import checks, contracts, evidence, metrics, tables
from lodestone.plans.views import ARITH_SQL, DOC_SQL, MCQ_SQL, arith_items, doc_items, mcq_items, table

QUERIES: dict = {}


def query(name: str, sql: str | None = None):
    def keep(f):
        QUERIES[name] = (f, sql)
        return f

    return keep


def arith_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    use = checks.standard_checks(["oracle_ground_truth"])
    return checks.findings(checks.with_audit(arith_items(spark, sf_dir), use))


STATIC = ("task_specification", "expected_output", "oracle_ground_truth", "evaluator", "contract_consistency")


#: Ratios of counts tp, fp and fn, 0 where there is nothing to divide by.
RATIO_SQL = "CASE WHEN tp + fp > 0 THEN tp::DOUBLE / (tp + fp) ELSE 0 END AS precision, CASE WHEN tp + fn > 0 THEN tp::DOUBLE / (tp + fn) ELSE 0 END AS recall, CASE WHEN 2 * tp + fp + fn > 0 THEN 2.0::DOUBLE * tp / (2 * tp + fp + fn) ELSE 0 END AS f1"


@query("arithmetic_audit", f"""WITH {ARITH_SQL}, i AS (SELECT item_id, bool_or(product <> gold) AS hit, bool_or(corrupt) AS bad FROM arith GROUP BY 1), c AS (SELECT count_if(hit AND bad)::BIGINT AS tp, count_if(hit AND NOT bad)::BIGINT AS fp, count_if(NOT hit AND bad)::BIGINT AS fn FROM i) SELECT tp, fp, fn, {RATIO_SQL} FROM c""")
def arithmetic_audit(spark, sf_dir):
    found = arith_findings(spark, sf_dir).where("defect_type = 'wrong_gold_answer'")
    return metrics.confusion(found, arith_items(spark, sf_dir).where("corrupt"))


@query("wrong_gold_arithmetic", f"WITH {ARITH_SQL} SELECT item_id, task, gold::VARCHAR AS gold, product::DOUBLE AS value FROM arith WHERE product <> gold")
def wrong_gold(spark, sf_dir):
    rows = arith_items(spark, sf_dir).withColumn("value", checks.arithmetic_value(F.col("task")))
    return rows.where(F.abs(F.col("value") - X.parse_number(F.col("gold"))) > 1e-9).select("item_id", "task", "gold", "value")


@query("per_label_confusion", f"""WITH {ARITH_SQL}, p AS (SELECT DISTINCT item_id FROM arith WHERE product <> gold), t AS (SELECT DISTINCT item_id, flag FROM arith WHERE corrupt), j AS (SELECT flag, p.item_id AS p, t.item_id AS t FROM t FULL JOIN p USING (item_id)),
c AS (SELECT flag, count_if(p IS NOT NULL AND t IS NOT NULL)::BIGINT AS tp, count_if(t IS NULL)::BIGINT AS fp, count_if(p IS NULL)::BIGINT AS fn FROM j GROUP BY flag) SELECT flag, tp, fp, fn, {RATIO_SQL} FROM c""")
def per_label(spark, sf_dir):
    found = arith_findings(spark, sf_dir).where("defect_type = 'wrong_gold_answer'")
    return metrics.confusion(found, arith_items(spark, sf_dir).where("corrupt"), by="flag")


#: The findings of the choice items, defect by defect.
MCQ_FINDINGS_SQL = f"""{MCQ_SQL}, idx AS (SELECT *, CASE WHEN gold IN ('A','B','C') THEN ascii(gold) - 65 END AS pos,
  len(list_distinct(list_transform(choices, lambda c: lower(trim(c))))) < 3 AS dup, len(list_filter(choices, lambda c: trim(c) = '')) > 0 AS empty_choice FROM mcq),
f AS (SELECT item_id, 'oracle_ground_truth' AS checker, 'static_rule' AS method, 'missing_oracle' AS defect_type, 'critical' AS severity, '' AS evidence_level, false AS review_only FROM idx WHERE gold IS NULL
 UNION ALL SELECT item_id, 'oracle_ground_truth', 'static_rule', 'invalid_choice_gold', 'critical', 'choice_gold_domain_replay', false FROM idx WHERE gold IS NOT NULL AND pos IS NULL
 UNION ALL SELECT item_id, 'oracle_ground_truth', 'static_rule', 'duplicate_choices', 'review', '', false FROM idx WHERE dup AND gold IS NOT NULL
 UNION ALL SELECT item_id, 'oracle_ground_truth', 'static_rule', 'empty_choice', 'major', '', false FROM idx WHERE empty_choice AND gold IS NOT NULL
 UNION ALL SELECT item_id, 'evaluator', 'static_rule', 'missing_evaluator', CASE WHEN gold IS NULL THEN 'major' ELSE 'minor' END, '', true FROM idx WHERE evaluator = ''
 UNION ALL SELECT item_id, 'contract_consistency', 'cross_artifact_consistency', 'output_evaluator_contract_mismatch', 'major', 'answer_contract_static_consistency', false FROM idx WHERE output_contract = 'numeric value')"""


@query("mcq_findings", f"WITH {MCQ_FINDINGS_SQL} SELECT * FROM f")
def mcq_static_findings(spark, sf_dir):
    use = checks.standard_checks(STATIC)
    found = checks.findings(checks.with_audit(mcq_items(spark, sf_dir), use))
    return found.select("item_id", "checker", "method", "defect_type", "severity", "evidence_level", "review_only")


@query("promotion_tiers", f"""WITH {MCQ_FINDINGS_SQL} SELECT defect_type, CASE WHEN review_only THEN 'review' WHEN defect_type IN ('invalid_choice_gold', 'output_evaluator_contract_mismatch') THEN 'confirmed' ELSE 'review' END AS tier, count(*) AS n FROM f GROUP BY ALL""")
def promotion_tiers(spark, sf_dir):
    return evidence.promote(mcq_static_findings(spark, sf_dir)).groupBy("defect_type", "tier").agg(F.count(F.lit(1)).alias("n"))


@query("findings_summary_grouping_sets", f"""WITH {MCQ_FINDINGS_SQL}, t AS (SELECT *, CASE WHEN NOT review_only AND defect_type IN ('invalid_choice_gold', 'output_evaluator_contract_mismatch') THEN 'confirmed' ELSE 'review' END AS tier FROM f)
SELECT CASE WHEN grouping(defect_type) = 0 THEN 'defect_type' WHEN grouping(method) = 0 THEN 'method' WHEN grouping(severity) = 0 THEN 'severity' ELSE 'tier' END AS dimension,
 coalesce(defect_type, method, severity, tier) AS value, count(*) AS n, count(DISTINCT item_id) AS items FROM t GROUP BY GROUPING SETS ((defect_type), (method), (severity), (tier))""")
def findings_summary(spark, sf_dir):
    return evidence.summary(evidence.promote(mcq_static_findings(spark, sf_dir)))


@query("item_risk", f"""WITH {MCQ_FINDINGS_SQL}, p AS (SELECT *, NOT review_only AND defect_type IN ('invalid_choice_gold', 'output_evaluator_contract_mismatch') AS conf,
 defect_type IN ('invalid_choice_gold', 'missing_oracle', 'duplicate_choices') AS strong FROM f),
g AS (SELECT item_id, bool_or(conf) AS confirmed, bool_or(strong) AS strong, count(DISTINCT method)::INT AS n_methods FROM p GROUP BY item_id)
SELECT item_id, CASE WHEN confirmed OR strong OR n_methods >= 2 THEN 'priority' ELSE 'exploratory' END AS tier,
 least(1.0, greatest(0.0, CASE WHEN confirmed THEN 0.72 WHEN strong OR n_methods >= 2 THEN 0.52 ELSE 0.12 END::DOUBLE + CASE WHEN strong THEN 0.10 ELSE 0.0 END::DOUBLE)) AS risk,
 n_methods, confirmed FROM g""")
def item_risk(spark, sf_dir):
    found = mcq_static_findings(spark, sf_dir).withColumn("confidence", F.lit(None).cast("double")).withColumn("defect_scope", F.lit("substantive"))
    return evidence.item_tiers(evidence.promote(found))


@query("review_budget", f"""WITH {ARITH_SQL}, hit AS (SELECT item_id, bool_or(corrupt) AS bad, row_number() OVER (ORDER BY item_id) AS place, count(*) OVER () AS n FROM arith WHERE item_id IN (SELECT item_id FROM arith WHERE product <> gold) GROUP BY item_id), t AS (SELECT count(DISTINCT item_id) AS bad FROM arith WHERE corrupt)
SELECT share, count(*) AS reviewed, count_if(hit.bad)::BIGINT AS found, count_if(hit.bad)::DOUBLE / max(t.bad) AS recall FROM hit, t, (SELECT unnest([5, 10, 20]) AS share) WHERE place <= greatest(1, ceil(n * share / 100.0)) GROUP BY share""")
def review_budget(spark, sf_dir):
    found = evidence.promote(arith_findings(spark, sf_dir).where("defect_type = 'wrong_gold_answer'"))
    return metrics.review_budget(evidence.item_tiers(found), arith_items(spark, sf_dir).where("corrupt"))


@query("coverage_ledger_status", f"""WITH {MCQ_FINDINGS_SQL}, n AS (SELECT count(*) AS n FROM mcq), w AS (SELECT checker, count(DISTINCT item_id) AS with_finding FROM f GROUP BY checker),
c AS (SELECT * FROM (VALUES ('task_specification'), ('expected_output'), ('oracle_ground_truth'), ('evaluator'), ('contract_consistency')) t(checker))
SELECT checker, n AS eligible, coalesce(with_finding, 0) AS with_finding, n - coalesce(with_finding, 0) AS completed, 0::BIGINT AS ineligible, 'executed' AS status FROM c CROSS JOIN n LEFT JOIN w USING (checker)""")
def coverage_ledger(spark, sf_dir):
    use = checks.standard_checks(STATIC)
    return evidence.ledger_summary(checks.ledger(checks.with_audit(mcq_items(spark, sf_dir), use)))


@query("evaluator_replay", f"""WITH {ARITH_SQL}, g AS (SELECT gold::DOUBLE AS x, regexp_replace(gold::VARCHAR, ',', '') AS t FROM arith),
v AS (SELECT x, [t || '.0', t || '.00', CASE WHEN x < 0 THEN '-' ELSE '' END || lpad(replace(t, '-', ''), greatest(length(replace(t, '-', '')), 3)::INT, '0')] AS same, [(x + 1)::VARCHAR, CASE WHEN x = 0 THEN '1.0' ELSE (-x)::VARCHAR END] AS other, t FROM g)
SELECT 'numeric' AS kind, count(*) AS items, count_if(abs(t::DOUBLE - x) >= 1e-9)::BIGINT AS rejected, count_if(len(list_filter(same, lambda s: abs(s::DOUBLE - x) >= 1e-9)) > 0)::BIGINT AS variant_rejected, count_if(len(list_filter(other, lambda s: abs(s::DOUBLE - x) < 1e-9)) > 0)::BIGINT AS mutants_survived FROM v""")
def evaluator_replay(spark, sf_dir):
    c = F.col
    rows = checks.prepared(arith_items(spark, sf_dir))
    kind = c("__answers")["kind"]
    ok = lambda x: A.accept(x, c("__gold"), c("__answers"), c("choices"), c("evaluator"), c("aliases"))
    return rows.groupBy(kind.alias("kind")).agg(
        F.count(F.lit(1)).alias("items"), F.count_if(~ok(c("gold"))).alias("rejected"),
        F.count_if(F.exists(A.variants(c("gold"), c("__answers"), c("choices"), c("aliases")), lambda v: ~ok(v))).alias("variant_rejected"), F.count_if(F.exists(A.mutations(c("gold"), kind, c("choices")), ok)).alias("mutants_survived"),
    )


@query("answer_contract_census", f"""WITH {MCQ_SQL}, {ARITH_SQL} SELECT 'choice' AS kind, 'choices' AS basis, 'single' AS cardinality, count(*) AS n FROM mcq UNION ALL SELECT 'numeric', 'evaluator', 'single', count(*) FROM arith""")
def contract_census(spark, sf_dir):
    c = F.col
    both = mcq_items(spark, sf_dir).select("evaluator", "output_contract", "gold", "choices").unionByName(arith_items(spark, sf_dir).select("evaluator", "output_contract", "gold", "choices"))
    answers = A.contract(c("evaluator"), c("output_contract"), c("gold"), c("choices"))
    return both.select(answers.alias("a")).groupBy("a.kind", "a.basis", "a.cardinality").agg(F.count(F.lit(1)).alias("n"))


@query("injected_recall", f"""WITH {MCQ_SQL}, ops AS (SELECT m.*, o.operator, md5('20260713:' || item_id || ':' || o.operator) AS h FROM mcq m CROSS JOIN (VALUES ('remove_task'), ('remove_gold'), ('wrong_gold'), ('duplicate_choice'), ('remove_evaluator')) o(operator)
 WHERE k % 17 <> 0 AND k % 19 <> 0 AND k % 29 <> 0 AND CASE o.operator WHEN 'remove_task' THEN true WHEN 'remove_evaluator' THEN trim(evaluator) <> '' ELSE gold IS NOT NULL END),
p AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY h, operator) AS rn FROM ops),
m AS (SELECT operator, CASE operator WHEN 'remove_task' THEN '' ELSE task END AS task, CASE operator WHEN 'remove_gold' THEN NULL WHEN 'wrong_gold' THEN 'Z?' ELSE gold END AS gold,
 CASE operator WHEN 'duplicate_choice' THEN list_append(choices, choices[1]) ELSE choices END AS choices, CASE operator WHEN 'remove_evaluator' THEN '' ELSE evaluator END AS evaluator FROM p WHERE rn <= 2),
c AS (SELECT operator, CASE operator WHEN 'remove_task' THEN trim(task) = '' WHEN 'remove_gold' THEN gold IS NULL WHEN 'wrong_gold' THEN gold IS NOT NULL AND NOT (length(gold) = 1 AND ascii(gold) - 65 BETWEEN 0 AND len(choices) - 1) AND NOT list_contains(choices, gold)
 WHEN 'duplicate_choice' THEN gold IS NOT NULL AND len(list_distinct(list_transform(choices, lambda c: lower(trim(c))))) < len(choices) ELSE trim(evaluator) = '' END AS hit FROM m)
SELECT operator, count(*) AS expected, count_if(hit)::BIGINT AS hits, count_if(hit)::DOUBLE / count(*) AS recall FROM c GROUP BY ROLLUP (operator)""")
def injected_recall(spark, sf_dir):
    clean = mcq_items(spark, sf_dir).where("source_row_index % 17 <> 0 and source_row_index % 19 <> 0 and source_row_index % 29 <> 0")
    mutants = metrics.inject(clean, 2)
    use = checks.standard_checks(STATIC)
    return metrics.injected_recall(mutants, checks.findings(checks.with_audit(mutants.drop("operator"), use)))


@query("paired_challenge", f"""WITH {MCQ_SQL}, m AS (SELECT item_id, gold, k FROM mcq) SELECT 'remove_gold' AS defect_type, count(*) AS extra FROM m WHERE gold IS NOT NULL AND k % 5 = 0""")
def paired_challenge(spark, sf_dir):
    clean = mcq_items(spark, sf_dir)
    mutant = clean.withColumn("gold", F.when(F.col("source_row_index") % 5 == 0, F.lit(None)).otherwise(F.col("gold")))
    use = [checks.Check("oracle_ground_truth", F.lit(True), [checks.finding("static_rule", "missing_oracle", F.col("gold").isNull())])]
    atoms = lambda d: checks.findings(checks.with_audit(d, use)).select("item_id", "defect_type")
    extra = atoms(mutant).exceptAll(atoms(clean))
    return extra.groupBy(F.lit("remove_gold").alias("defect_type")).agg(F.count(F.lit(1)).alias("extra"))


@query("lexical_task_checks", rf"""WITH {DOC_SQL} SELECT lang, sum(regexp_matches(task, '(^|[^\p{{L}}\p{{N}}_])(best|most appropriate|most likely|typically|usually)($|[^\p{{L}}\p{{N}}_])', 'i')::INT)::BIGINT AS typical,
 sum(regexp_matches(task, '\b(latest|most recent)\b', 'i')::INT)::BIGINT AS latest, sum(contains(task, '?')::INT)::BIGINT AS asks, sum((task IS NULL OR trim(task) = '')::INT)::BIGINT AS missing FROM doc_items GROUP BY lang""")
def lexical(spark, sf_dir):
    t = F.col("task")
    return doc_items(spark, sf_dir).groupBy("lang").agg(F.count_if(t.rlike("(?i)" + checks.AMBIGUITY[1])).alias("typical"), F.count_if(t.rlike(r"(?i)\b(latest|most recent)\b")).alias("latest"), F.count_if(F.contains(t, F.lit("?"))).alias("asks"), F.count_if(X.blank(t)).alias("missing"))


@query("invisible_characters", rf"""WITH {DOC_SQL} SELECT item_id, len(regexp_extract_all(task, '[\p{{Cf}}\x00-\x08\x0b\x0c\x0e-\x1f\x7f-\x9f]'))::BIGINT AS n FROM doc_items WHERE regexp_matches(task, '[\p{{Cf}}\x00-\x08\x0b\x0c\x0e-\x1f\x7f-\x9f]')""")
def invisible(spark, sf_dir):
    rows = doc_items(spark, sf_dir).select("item_id", X.invisible_count(F.col("task")).cast("long").alias("n"))
    return rows.where("n > 0")


@query("canonical_items_coverage", f"""WITH {DOC_SQL} SELECT (trim(coalesce(task, '')) <> '') AS has_task, (gold IS NOT NULL) AS has_gold, count(*) AS n FROM doc_items GROUP BY ALL""")
def canonical_coverage(spark, sf_dir):
    return tables.coverage(doc_items(spark, sf_dir)).groupBy("has_task", "has_gold").agg(F.count(F.lit(1)).alias("n"))


@query("coverage_pattern_drift", f"""WITH {DOC_SQL}, c AS (SELECT (trim(coalesce(task, '')) <> '')::INT || '' || (gold IS NOT NULL)::INT || '001' AS pattern, count(*) AS n FROM doc_items GROUP BY 1),
w AS (SELECT pattern, n, n::DOUBLE / sum(n) OVER () AS share, row_number() OVER (ORDER BY n DESC, pattern) = 1 AS is_mode, sum(n) OVER () AS total FROM c) SELECT pattern, n, share, is_mode, NOT is_mode AND share >= 0.02 AND total >= 5 AS drifts FROM w""")
def pattern_drift(spark, sf_dir):
    return tables.drift(tables.coverage(doc_items(spark, sf_dir)))


@query("duplicate_item_ids", "SELECT l_suppkey || ':' || l_partkey AS item_id, count(*) AS n, min(l_orderkey) AS first_row FROM lineitem GROUP BY 1 HAVING count(*) > 1")
def duplicate_item_ids(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select(F.concat_ws(":", F.col("l_suppkey").cast("string"), F.col("l_partkey").cast("string")).alias("item_id"), F.col("l_orderkey").alias("source_row_index"))
    return tables.duplicate_ids(rows)


@query("conflicting_oracles", f"""WITH {ARITH_SQL}, g AS (SELECT sha256(lower(task) || chr(31) || chr(31) || chr(31) || 'a number') AS signature, count(*) AS n, count(DISTINCT gold) AS golds FROM arith GROUP BY 1 HAVING count(*) > 1)
SELECT signature, n, golds, CASE WHEN golds > 1 THEN 'conflicting_duplicate_oracle' ELSE 'duplicate_task' END AS verdict FROM g""")
def conflicting_oracles(spark, sf_dir):
    return tables.duplicate_tasks(arith_items(spark, sf_dir))


@query("duplicate_documents", rf"""SELECT sha256(lower(trim(regexp_replace(coalesce(text, ''), '[\s\x0b]+', ' ', 'g'))) || chr(31) || chr(31) || chr(31)) AS signature, count(*) AS n FROM documents GROUP BY 1 HAVING count(*) > 1""")
def duplicate_documents(spark, sf_dir):
    return tables.duplicate_tasks(doc_items(spark, sf_dir)).select("signature", "n")


@query("benchmark_contamination", r"""WITH d AS (SELECT doc_id, ' ' || lower(trim(regexp_replace(text, '[\s\x0b]+', ' ', 'g'))) || ' ' AS t FROM documents), b AS (SELECT item_id, ' ' || lower(trim(regexp_replace(text, '[\s\x0b]+', ' ', 'g'))) || ' ' AS t FROM benchmark)
SELECT doc_id, item_id FROM d JOIN b ON contains(d.t, b.t)""")
def contamination(spark, sf_dir):
    return tables.contained(table(spark, sf_dir, "benchmark"), table(spark, sf_dir, "documents"))


@query("infer_field_coverage", """SELECT 'text' AS field, avg((trim(coalesce(text, '')) <> '')::INT) AS present, avg((try_cast(text AS DOUBLE) IS NOT NULL)::INT) AS numeric FROM documents
UNION ALL SELECT 'source', avg((trim(coalesce(source, '')) <> '')::INT), avg((try_cast(source AS DOUBLE) IS NOT NULL)::INT) FROM documents UNION ALL SELECT 'n_chars', avg((n_chars IS NOT NULL)::INT), avg((n_chars IS NOT NULL)::INT) FROM documents""")
def field_coverage(spark, sf_dir):
    return tables.field_coverage(table(spark, sf_dir, "documents"), ["text", "source", "n_chars"])


@query("scan_profile_json_paths", """SELECT '$.' || k AS path, CASE WHEN json_type(props, '$.' || k) IN ('UBIGINT', 'BIGINT') THEN 'BIGINT' ELSE 'STRING' END AS type, count(*) AS n FROM (SELECT props, unnest(json_keys(props)) AS k FROM events) GROUP BY ALL""")
def json_paths(spark, sf_dir):
    return tables.json_paths(table(spark, sf_dir, "events"), "props")


@query("task_multiplicity_triage", rf"""WITH d AS (SELECT doc_id, regexp_replace(regexp_replace(text, 'BEGIN\s+SOLUTION.*$', '', 'is'), '<code>.*?</code>', ' ', 'gis') AS text FROM documents), t AS (SELECT doc_id, regexp_matches(text, '\b(?:one|any|a)\s+(?:maximal|possible|valid|such)\b|\bin\s+any\s+order\b|\bunordered\b', 'i') AS high, regexp_matches(text, '\brandom(?:ly|ized)?\b|\bshuffl(?:e|ed|ing)\b', 'i') AS low FROM documents)
SELECT CASE WHEN high THEN 'by_design' WHEN low THEN 'ambiguous' ELSE 'priority' END AS verdict, count(*) AS n FROM t GROUP BY 1""")
def multiplicity_triage(spark, sf_dir):
    return table(spark, sf_dir, "documents").groupBy(checks.multiplicity(F.col("text")).alias("verdict")).agg(F.count(F.lit(1)).alias("n"))


@query("declarative_rules", """SELECT CASE WHEN (o_totalprice > 200000 AND o_orderpriority = '1-URGENT') OR o_orderstatus = 'P' THEN 'matched' ELSE 'no_match' END AS outcome, count(*) AS n FROM orders GROUP BY 1""")
def declarative_rules(spark, sf_dir):
    r = checks.rule({"any": [{"all": [{"op": "gt", "field": "o_totalprice", "value": 200000}, {"op": "eq", "field": "o_orderpriority", "value": "1-URGENT"}]}, {"op": "eq", "field": "o_orderstatus", "value": "P"}]})
    return table(spark, sf_dir, "orders").groupBy(F.when(r, "matched").when(~r, "no_match").otherwise("abstained").alias("outcome")).agg(F.count(F.lit(1)).alias("n"))


RUBRIC_SQL = "text"
for _pattern in X.NOT_ASSERTED:
    _flags = "gi" if _pattern.startswith("(?i") else "g"
    _plain = _pattern.removeprefix("(?iU)").removeprefix("(?i)").removeprefix("(?U)").replace("'", "''")
    RUBRIC_SQL = f"regexp_replace({RUBRIC_SQL}, '{_plain}', ' ', '{_flags}')"


@query("rubric_numbers", rf"""SELECT doc_id, len(v)::INT AS n, coalesce(list_sum(list_transform(v, lambda x: x::DOUBLE)), 0.0) AS total FROM (SELECT doc_id, regexp_extract_all(replace({RUBRIC_SQL}, ',', ''), '\d[\d,]*\.?\d*') AS v FROM documents)""")
def rubric_numbers(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", X.rubric_numbers(F.col("text")).alias("v")).select("doc_id", F.size("v").alias("n"), F.aggregate("v", F.lit(0.0), lambda a, x: a + x).alias("total"))


@query("adapter_projection", """SELECT event_id, event_type || ' by ' || user_id AS task, json_extract_string(props, '$.k') AS gold, json_extract_string(props, '$.k') IS NULL AS abstains FROM events""")
def adapter_projection(spark, sf_dir):
    from lodestone.sources.adapter import Binding, project

    return project(table(spark, sf_dir, "events"), "event_id", [Binding("task", template="{event_type} by {user_id}"), Binding("gold", path="props.$.k", required=True)])


@query("choice_tiers", f"""WITH {MCQ_SQL}, t AS (SELECT item_id, len(choices)::BIGINT AS n, CASE WHEN len(list_distinct(choices)) < len(choices) THEN 'T1' WHEN len(list_distinct(list_transform(choices, lambda c: lower(trim(c))))) < len(choices) THEN 'T2' END AS tier FROM mcq) SELECT item_id, tier, n FROM t WHERE tier IS NOT NULL""")
def choice_tiers(spark, sf_dir):
    return contracts.choice_tiers(mcq_items(spark, sf_dir))


@query("gold_resolution", f"WITH {MCQ_SQL} SELECT CASE WHEN gold IS NULL THEN 'missing' WHEN gold IN ('A', 'B', 'C') THEN 'resolved' ELSE 'not_found' END AS reason, count(*) AS n FROM mcq GROUP BY 1")
def gold_resolution(spark, sf_dir):
    reason = F.coalesce(contracts.gold_resolution(F.col("gold"), F.col("choices")), F.lit("resolved"))
    return mcq_items(spark, sf_dir).groupBy(reason.alias("reason")).agg(F.count(F.lit(1)).alias("n"))


@query("citation_support", """SELECT item_id AS claim_id, CASE WHEN d.text IS NULL THEN 'unresolved' WHEN contains(lower(trim(regexp_replace(d.text, '[\\s\\x0b]+', ' ', 'g'))), lower(trim(regexp_replace(substr(b.text, 1, 40), '[\\s\\x0b]+', ' ', 'g')))) THEN 'supported' ELSE 'unsupported' END AS status
FROM benchmark b LEFT JOIN documents d ON d.doc_id = b.item_id * 3""")
def citation_support(spark, sf_dir):
    claims = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("claim_id"), (F.col("item_id") * 3).alias("source_id"), F.substring("text", 1, 40).alias("quote"))
    return contracts.citations(claims, table(spark, sf_dir, "documents").select(F.col("doc_id").alias("source_id"), "text"))


@query("missing_attachments", """SELECT DISTINCT item_id::VARCHAR AS item_id, p AS path FROM (SELECT o_orderkey AS item_id, 'part-' || (o_orderkey % 3000) || '.csv' AS p FROM orders) WHERE p NOT IN (SELECT 'part-' || p_partkey || '.csv' FROM part)""")
def missing_attachments(spark, sf_dir):
    refs = table(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("string").alias("item_id"), F.concat(F.lit("part-"), (F.col("o_orderkey") % 3000).cast("string"), F.lit(".csv")).alias("path"))
    have = table(spark, sf_dir, "part").select(F.concat(F.lit("part-"), F.col("p_partkey").cast("string"), F.lit(".csv")).alias("path"))
    return contracts.missing_attachments(refs, have)


@query("repeated_rubric_ids", "SELECT l_partkey AS rubric_id, count(*) AS n, count(DISTINCT l_orderkey) AS items FROM lineitem GROUP BY 1 HAVING count(*) > 1")
def repeated_rubrics(spark, sf_dir):
    return contracts.repeated_rubrics(table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("item_id"), F.array("l_partkey").alias("rubric_ids")))


@query("workspace_issues", """WITH w AS (SELECT o_orderkey AS item_id, o_orderkey % 5 = 0 AS a, o_orderkey % 7 = 0 AS b, o_orderkey % 11 = 0 AS c FROM orders)
SELECT item_id, 'outputs_differ_from_contract' AS issue FROM w WHERE a UNION ALL SELECT item_id, 'rubric_type_count' FROM w WHERE b UNION ALL SELECT item_id, 'manifest_without_file' FROM w WHERE c""")
def workspace_issues(spark, sf_dir):
    k = F.col("o_orderkey")
    names = lambda *x: F.array(*[F.lit(v) for v in x])
    rows = table(spark, sf_dir, "orders").select(
        k.alias("item_id"), F.when(k % 5 == 0, names("out.csv", "more.csv")).otherwise(names("out.csv")).alias("output_files"), names("out.csv").alias("required_files"), names("r1", "r2").alias("rubrics"), names("r2", "r1").alias("evaluator_rubrics"),
        F.when(k % 7 == 0, names("t")).otherwise(names("t", "t")).alias("rubric_types"), names("in.csv").alias("manifest"), F.when(k % 11 == 0, names("x")).otherwise(names("in.csv")).alias("files"),
        F.array(F.struct(F.lit("in.csv").alias("from"), F.lit("out.csv").alias("to"))).alias("edges"),
    )
    return contracts.workspace_issues(rows)


#: Whether a line s of code is concrete, in SQL.
CONCRETE_SQL = r"""length(s) >= 8 AND lower(regexp_replace(s, '\s+', ' ', 'g')) NOT IN ('pass', 'continue', 'break', 'return', 'return none', 'return true', 'return false', 'return 0', 'return 1', 'none', 'true', 'false', 'else:', 'try:', 'finally:')
 AND NOT regexp_matches(s, '^(#|//|[*])') AND NOT regexp_matches(s, '^[rubfRUBF]*[''"]{3}') AND NOT regexp_matches(s, '^[rubfRUBF]*[''"][^''"]{0,40}[''"]$')
 AND NOT regexp_matches(lower(regexp_replace(s, '\s+', ' ', 'g')), '^((return )?(none|true|false|[0-9]+([.][0-9]+)?)|(raise|except|elif|if|for|while|with|class|def)[: ]*)$')
 AND (regexp_matches(s, '[][=().:{},]') OR (len(regexp_extract_all(s, '[A-Za-z_][A-Za-z0-9_]*')) >= 2 AND len(list_filter(regexp_extract_all(s, '[A-Za-z_][A-Za-z0-9_]*'), lambda w: contains(w, '_'))) > 0)
  OR (len(regexp_extract_all(s, '[A-Za-z_][A-Za-z0-9_]*')) >= 3 AND lower(regexp_extract(s, '[A-Za-z_][A-Za-z0-9_]*')) IN ('and', 'or', 'not', 'is', 'in')))"""


@query("solution_leak_lines", rf"""WITH p AS (SELECT d.doc_id, list_distinct(list_filter(list_transform(string_split(d.text, chr(10)), lambda s: trim(s)), lambda s: {CONCRETE_SQL})) AS lines, t.text AS task FROM documents d JOIN documents t ON t.doc_id = d.doc_id - 1)
SELECT doc_id, len(list_filter(lines, lambda s: contains(task, s)))::INT AS leaked FROM p WHERE len(list_filter(lines, lambda s: contains(task, s))) > 0""")
def solution_leaks(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    patch = F.array_join(F.transform(F.split("text", "\n"), lambda s: F.concat(F.lit("+ "), s)), "\n")
    pairs = docs.select("doc_id", patch.alias("patch")).join(docs.select((F.col("doc_id") + 1).alias("doc_id"), F.col("text").alias("task")), "doc_id")
    return pairs.select("doc_id", checks.leaked_lines(F.col("patch"), F.col("task"))["leaked"].alias("leaked")).where("leaked > 0")


#: Lines of which each kind is decided by another condition.
PLANTED = ("total = sum(rows)", "import os.path", "# a comment line", "return none", "'a short string'", "finally:", "x=1", "row_count limit", "not yet done here", "plain words only", "def   :", "return 12.50")


@query("added_code_lines", rf"""WITH l AS (SELECT p_partkey AS part_id, [{", ".join("'" + x.replace("'", "''") + "'" for x in PLANTED)}][p_partkey % {len(PLANTED)} + 1] AS s, 'part_' || p_partkey || ' = ' || p_size AS own FROM part)
SELECT part_id, CASE WHEN {CONCRETE_SQL} THEN s || '|' ELSE '' END || own AS lines FROM l""")
def added_code_lines(spark, sf_dir):
    key = F.col("p_partkey")
    planted = F.get(F.array(*[F.lit(x) for x in PLANTED]), (key % len(PLANTED)).cast("int"))
    own = F.concat(F.lit("part_"), key.cast("string"), F.lit(" = "), F.col("p_size").cast("string"))
    patch = F.concat(F.lit("--- a/x\n+++ b/x\n-old = 1\n+  "), planted, F.lit("\n context(line)\n+"), own, F.lit("\n+"), own)
    return table(spark, sf_dir, "part").select(key.alias("part_id"), F.array_join(X.added_lines(patch), "|").alias("lines"))


@query("rubric_numbers_planted", """SELECT p_partkey AS part_id, CASE p_partkey % 6 WHEN 0 THEN (1000 + p_size) || '.0' WHEN 1 THEN '58000.0' WHEN 2 THEN p_size || '.5|12.0' WHEN 3 THEN (p_size + 60) || '.0' WHEN 4 THEN '9.0' ELSE '' END AS numbers FROM part""")
def rubric_numbers_planted(spark, sf_dir):
    key, size = F.col("p_partkey"), F.col("p_size").cast("string")
    kinds = (
        F.concat(F.lit("discount >=50% of 1,"), F.lpad(size, 3, "0"), F.lit(" rows")), F.concat(F.lit("SR-"), size, F.lit(" in 2024年 total 58000")), F.concat(F.lit("item 14 has "), size, F.lit(".5 and 12")),
        F.concat(F.lit("35%-45% share, "), (F.col("p_size") + 60).cast("string"), F.lit(" rows")), F.concat(F.lit("a"), size, F.lit(".xlsx 9")), F.concat(F.lit("Partner "), size, F.lit(" #1013")),
    )
    text = F.get(F.array(*kinds), (key % len(kinds)).cast("int"))
    return table(spark, sf_dir, "part").select(key.alias("part_id"), F.array_join(F.transform(X.rubric_numbers(text), lambda x: x.cast("string")), "|").alias("numbers"))
