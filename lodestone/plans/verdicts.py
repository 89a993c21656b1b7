"""Queries over schema profiles, set answers and tables of votes, each with SQL of its own."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.functions import answers as A
from lodestone.operators import profiles, votes
from lodestone.plans.structured import pick, texts
from lodestone.plans.views import spread, table

QUERIES: dict = {}


def query(name: str, sql: str | None = None):
    def keep(f):
        QUERIES[name] = (f, sql)
        return f

    return keep


def joined(*parts) -> Column:
    return F.concat(*[p.cast("string") if isinstance(p, Column) else F.lit(p) for p in parts])


def order_objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as nested objects whose fields change their type, their depth or aren't there, by key."""
    k = F.col("o_orderkey")
    ident = F.when(k % 5 == 0, joined('"', k, '"')).otherwise(joined(k))
    who = F.when(k % 7 == 0, "null").otherwise(joined('{"seg": "', F.col("o_orderpriority"), '", "more": {"vip": ', F.when(k % 2 == 0, "true").otherwise("[]"), ', "k": ', F.col("o_custkey") % 3, "}}"))
    tags = F.when(k % 3 == 0, '["a", 1]').when(k % 3 == 1, "[null, {\"t\": 1}, 2.5, 3]").otherwise("[]")
    total = F.when(k % 11 == 0, "").otherwise(joined(', "total": ', k % 50, ".25"))
    raw = joined('{"id": ', ident, ', "who": ', who, ', "tags": ', tags, total, "}")
    return spread(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderpriority")).select(k.alias("source_row_index"), F.parse_json(raw).alias("raw"))


PROFILE_SQL = """WITH RECURSIVE raws AS (SELECT o_orderkey AS k, ('{"id":' || CASE WHEN o_orderkey % 5 = 0 THEN '"' || o_orderkey || '"' ELSE o_orderkey::VARCHAR END
 || CASE WHEN o_orderkey % 11 = 0 THEN '' ELSE ',"total":' || (o_orderkey % 50) || '.25' END || ',"tags":' || CASE o_orderkey % 3 WHEN 0 THEN '["a",1]' WHEN 1 THEN '[null,{"t":1},2.5,3]' ELSE '[]' END
 || ',"who":' || CASE WHEN o_orderkey % 7 = 0 THEN 'null' ELSE '{"more":{"k":' || (o_custkey % 3) || ',"vip":' || CASE WHEN o_orderkey % 2 = 0 THEN 'true' ELSE '[]' END || '},"seg":"' || o_orderpriority || '"}' END || '}')::JSON AS v FROM orders),
walk AS (SELECT k, []::VARCHAR[] AS path, v, 'OBJECT' AS t FROM raws UNION ALL
 SELECT k, list_append(path, key), v -> ('$."' || key || '"'), json_type(v -> ('$."' || key || '"')) FROM (SELECT k, path, v, unnest(json_keys(v)) AS key FROM walk WHERE t = 'OBJECT')),
named AS (SELECT *, CASE WHEN t LIKE '%BIGINT' THEN 'integer' WHEN t = 'DOUBLE' THEN 'number' WHEN t = 'VARCHAR' THEN 'string' ELSE lower(t) END AS type FROM walk WHERE len(path) > 0),
inner_types AS (SELECT path, CASE WHEN j IS NULL THEN 'null' WHEN j LIKE '%BIGINT' THEN 'integer' WHEN j = 'DOUBLE' THEN 'number' WHEN j = 'VARCHAR' THEN 'string' ELSE lower(j) END AS e FROM (SELECT path, json_type(unnest(from_json(v, '["JSON"]'))) AS j FROM walk WHERE t = 'ARRAY')),
es AS (SELECT path, string_agg(DISTINCT e, '|' ORDER BY e) AS element_types FROM inner_types GROUP BY 1),
cut AS (SELECT path, type, CASE WHEN t = 'ARRAY' AND json_array_length(v) > 3 THEN '[' || coalesce((v -> '$[0]')::VARCHAR, 'null') || ',' || (v -> '$[1]') || ',' || (v -> '$[2]') || ']' ELSE v::VARCHAR END AS e FROM named),
pr AS (SELECT path, count(*) AS present, string_agg(DISTINCT type, '|' ORDER BY type) AS types, arg_min(e, md5('0:' || e)) AS x, arg_max(e, md5('0:' || e)) AS y FROM cut GROUP BY 1)"""


@query("schema_profile", f"{PROFILE_SQL} SELECT array_to_string(pr.path, '.') AS path, present, types, coalesce(element_types, '') AS element_types, x || CASE WHEN x = y THEN '' ELSE ' ' || y END AS examples FROM pr LEFT JOIN es ON pr.path = es.path")
def schema_profile(spark, sf_dir):
    found = profiles.profile(order_objects(spark, sf_dir))
    bar = lambda c: F.array_join(c, "|").alias(c)
    return found.select(F.array_join("path", ".").alias("path"), "present", bar("types"), bar("element_types"), F.array_join("examples", " ").alias("examples"))


@query("schema_profile_fingerprint", f"""{PROFILE_SQL}, one AS (SELECT pr.path, '{{"list_element_types":[' || coalesce('"' || replace(element_types, '|', '","') || '"', '') || '],"path":["' || array_to_string(pr.path, '","') || '"],"types":["' || replace(types, '|', '","') || '"]}}' AS j FROM pr LEFT JOIN es ON pr.path = es.path)
SELECT count(*) AS n_paths, sha256('{{"paths":[' || string_agg(j, ',' ORDER BY path) || '],"schema_version":"schema-profile-v1"}}') AS fingerprint FROM one""")
def schema_profile_fingerprint(spark, sf_dir):
    return profiles.fingerprint(profiles.profile(order_objects(spark, sf_dir), examples=0))


@query("schema_shapes", """WITH o AS (SELECT o_orderkey AS k FROM orders ORDER BY 1 LIMIT 20) SELECT 'id' AS field, string_agg(DISTINCT CASE WHEN k % 5 = 0 THEN 'string' ELSE 'integer' END, ' ' ORDER BY CASE WHEN k % 5 = 0 THEN 'string' ELSE 'integer' END) AS shapes FROM o
UNION ALL SELECT DISTINCT 'total', 'number' FROM o WHERE k % 11 <> 0 UNION ALL SELECT 'who', string_agg(DISTINCT w, ' ' ORDER BY w) FROM (SELECT CASE WHEN k % 7 = 0 THEN 'null' ELSE 'object' END AS w FROM o)
UNION ALL SELECT 'tags', string_agg(DISTINCT t, ' ' ORDER BY t) FROM (SELECT CASE k % 3 WHEN 0 THEN 'list[integer|string]' WHEN 1 THEN 'list[integer|null|number|object]' ELSE 'list[]' END AS t FROM o)""")
def schema_shapes(spark, sf_dir):
    return profiles.shapes(order_objects(spark, sf_dir)).withColumn("shapes", F.array_join("shapes", " "))


def customer_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each customer as an adapter of orders' objects: a target, where its value comes from, and by which transforms."""
    k, n = F.col("c_custkey"), F.col("c_nationkey")
    path = pick(k, texts("id"), texts("who"), texts("who", "seg"), texts("tags"), texts("who", "more", "vip"), texts("gone"), texts("total"))
    chain = pick(n, texts(), texts("strip"), texts("parse_jsonish"), texts("stringify", "strip"), texts("as_list"), texts("odd", "as_context"), texts("stringify", "parse_jsonish"), F.lit(None).cast("array<string>"))
    return table(spark, sf_dir, "customer").select(k.alias("spec"), pick(k + n, "task", "choices", "context", "item_id").alias("target"), path.alias("path"), chain.alias("transforms"), pick(n, "value", "template", "field").alias("part"))


@query("adapter_sources", f"""{PROFILE_SQL}, s AS (SELECT c_custkey AS spec, c_custkey % 7 AS p, c_nationkey % 8 AS c, c_nationkey % 3 AS part, (c_custkey + c_nationkey) % 4 AS target FROM customer),
seen AS (SELECT array_to_string(path, '.') AS path, string_split(types, '|') AS ts FROM pr),
m AS (SELECT s.*, ts FROM s LEFT JOIN seen ON seen.path = ['id', 'who', 'who.seg', 'tags', 'who.more.vip', 'gone', 'total'][p + 1]),
r AS (SELECT *, CASE WHEN c IN (0, 7, 5) THEN CASE WHEN c = 5 THEN ['object'] ELSE ts END WHEN c IN (1, 3) THEN ['string'] WHEN c = 4 THEN ['array']
 WHEN c = 6 OR list_contains(ts, 'string') THEN ['array', 'boolean', 'integer', 'null', 'number', 'object', 'string'] ELSE ts END AS after,
 CASE WHEN c = 1 AND ts <> ['string'] THEN 'strip_of_non_strings' WHEN c = 5 THEN 'unsupported_transform' END AS fault FROM m),
f AS (SELECT *, CASE part WHEN 0 THEN after WHEN 1 THEN ['string'] ELSE ['object'] END AS out FROM r)
SELECT spec, CASE WHEN ts IS NOT NULL THEN array_to_string(out, '|') END AS result_types, CASE WHEN ts IS NULL THEN 'absent_path' WHEN fault IS NOT NULL THEN fault WHEN part = 1 AND list_has_any(after, ['array', 'object']) THEN 'template_of_non_scalar'
 WHEN target < 3 AND len(list_filter(out, lambda x: x <> ['string', 'array', 'object'][target + 1])) > 0 THEN 'unexpected_type' END AS issue FROM f""")
def adapter_sources(spark, sf_dir):
    found = profiles.checked_sources(customer_sources(spark, sf_dir), profiles.profile(order_objects(spark, sf_dir), examples=0))
    return found.select("spec", F.array_join("result_types", "|").alias("result_types"), "issue")


GAP_TARGETS = ["task", "item_id", "evaluator", "rubrics", "repo", "base_commit", "patch", "environment", "context", "input_files", "unheard_of"]


@query("component_gaps", f"""WITH s AS (SELECT s_suppkey AS spec, any_value(['swebench', 'terminalbench', 'workspacebench', 'elsewhere', NULL][s_suppkey % 5 + 1]) AS family, list(DISTINCT {GAP_TARGETS}[(ps * 7 + s_nationkey) % 11 + 1]) AS have
 FROM supplier LEFT JOIN (SELECT l_suppkey, l_orderkey AS ps FROM lineitem) ON l_suppkey = s_suppkey GROUP BY 1),
need(family, component, required) AS (VALUES ('generic', 'canonical_task', ['task']), ('workspacebench', 'canonical_task', ['task']), ('workspacebench', 'record_identity', ['item_id']), ('workspacebench', 'evaluator_protocol', ['evaluator', 'rubrics']),
 ('workspacebench', 'output_contract', ['output_contract', 'output_files']), ('workspacebench', 'attachment_manifest', ['context', 'data_manifest']), ('workspacebench', 'dependency_graph', ['file_dep_graph']), ('workspacebench', 'materialized_inputs', ['input_files']),
 ('swebench', 'canonical_task', ['task']), ('swebench', 'repository_identity', ['repo', 'base_commit']), ('swebench', 'reference_patch', ['patch']), ('swebench', 'test_protocol', ['test_patch']),
 ('terminalbench', 'canonical_task', ['task']), ('terminalbench', 'environment_protocol', ['environment']), ('terminalbench', 'command_protocol', ['commands']), ('terminalbench', 'test_protocol', ['tests']))
SELECT spec, component, CASE WHEN list_has_all(have, required) THEN 'resolved' ELSE 'unresolved' END AS status, array_to_string(list_filter(required, lambda x: NOT list_contains(have, x)), '|') AS missing
FROM s JOIN need ON need.family = CASE WHEN s.family IN ('swebench', 'terminalbench', 'workspacebench') THEN s.family ELSE 'generic' END
UNION ALL SELECT spec, unnest(['record_source_loader', 'attachment_resolver', 'candidate_materializer', 'harness_result_parser', 'trace_parser']), 'requires_trusted_plugin', '' FROM s""")
def component_gaps(spark, sf_dir):
    k = F.col("s_suppkey")
    lines = table(spark, sf_dir, "lineitem").select("l_suppkey", "l_orderkey")
    specs = table(spark, sf_dir, "supplier").join(lines, F.col("l_suppkey") == k, "left")
    rows = specs.select(k.alias("spec"), pick(k, "swebench", "terminalbench", "workspacebench", "elsewhere", None).alias("family"), pick(F.col("l_orderkey") * 7 + F.col("s_nationkey"), *GAP_TARGETS).alias("target"))
    return profiles.component_gaps(rows).select("spec", "component", "status", F.array_join("missing", "|").alias("missing"))


@query("set_answers", """WITH l AS (SELECT l_orderkey AS k, list(l_quantity::INT * 1000 ORDER BY l_linenumber) AS g, list(CASE WHEN l_orderkey % 5 = 1 AND l_linenumber = 1 THEN 1000 * l_quantity::INT + 1 WHEN l_orderkey % 5 = 2 AND l_linenumber = 2 THEN 7000 ELSE 1000 * l_quantity::INT END ORDER BY l_linenumber) AS a FROM lineitem GROUP BY 1)
SELECT k AS item_id, len(g) AS n, CASE WHEN k % 5 = 3 THEN len(g) = 0 ELSE list_sort(a) = list_sort(g) END AS accepted FROM l""")
def set_answers(spark, sf_dir):
    """Sets of numbers in other spellings and orders, with one value changed, one doubled or one left out."""
    k, n, q = F.col("l_orderkey"), F.col("l_linenumber"), F.col("l_quantity").cast("int")
    answer = F.when((k % 5 == 1) & (n == 1), q * 1000 + 1).when((k % 5 == 2) & (n == 2), F.lit(7000)).otherwise(q * 1000)
    per = table(spark, sf_dir, "lineitem").select(k, n, q.alias("q"), F.struct(n, (q * 1000).alias("g"), answer.alias("a")).alias("s")).groupBy("l_orderkey").agg(F.array_sort(F.collect_list("s")).alias("s"))
    golds = F.array_join(F.transform("s", lambda s: s["g"].cast("string")), ", ")
    told = F.transform(F.reverse("s"), lambda s: F.concat(s["a"].cast("string"), F.when(s["l_linenumber"] % 2 == 0, ".0000000001").otherwise(" pieces")))
    said = F.when(k % 5 == 3, F.slice(told, F.lit(2), F.size(told))).otherwise(told)
    rows = per.select("l_orderkey", F.size("s").alias("n"), golds.alias("gold"), F.array_join(said, "; ").alias("answer"))
    ev, none = F.lit("numeric set"), A.none_of()
    return rows.select(k.alias("item_id"), "n", A.accept(F.col("answer"), A.view(F.col("gold"), none), A.contract(ev, F.lit(None).cast("string"), F.col("gold"), none), none, ev, none).alias("accepted"))


def verdict_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Up to three stages of a gold audit for each order."""
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    no, right = F.lit(None).cast("string"), texts("A")
    of = lambda stage, verdict, defect, answers, confidence, expert, failed: F.struct(F.lit(stage).alias("stage"), verdict.alias("verdict"), defect.alias("defect_type"), answers.alias("answers"), right.alias("accepted"), (c % 2 == 0).alias("has_choices"), confidence.alias("confidence"), expert.alias("needs_expert"), failed.alias("failed"))
    blind = of("blind", pick(c, "solved", "solved", "none", "multiple", "unclear"), no, pick(k, texts("A "), texts("A", "B"), texts(), texts("B", "")), (c % 10) / 10, k % 17 == 0, F.lit(True))
    defends = of("defender", pick(c, "supported", "unsupported", "unclear"), no, texts(), (k % 7) / 10, F.lit(None).cast("boolean"), c % 13 == 0)
    attacks = of("challenger", pick(c, "invalid", "valid", "unclear", "invalid"), pick(k, "none", "no_correct_answer", "odd", None, "wrong_gold_answer"), pick(c, texts("B"), texts("B", "C"), texts()), F.when(c % 6 > 0, (c % 6) / 6 + 0.16), c % 23 == 0, k % 19 == 0)
    stages = F.array_compact(F.array(blind, F.when(k % 3 != 0, defends), F.when(k % 4 != 1, attacks)))
    return spread(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")).select(k.alias("row_uid"), F.explode(stages).alias("s")).select("row_uid", "s.*")


EVIDENCE_SQL = """WITH o AS (SELECT o_orderkey AS k, o_custkey AS c, [['A'], ['A', 'B'], [], ['B']][o_orderkey % 4 + 1] AS ba, [['B'], ['B', 'C'], []][o_custkey % 3 + 1] AS ca, o_orderkey % 3 <> 0 AND o_custkey % 13 <> 0 AS hd, o_orderkey % 4 <> 1 AND o_orderkey % 19 <> 0 AS hc FROM orders),
v AS (SELECT *, CASE c % 5 WHEN 2 THEN 'no_correct_answer' WHEN 3 THEN 'multiple_correct_answers' WHEN 4 THEN 'none' ELSE CASE WHEN k % 4 = 3 THEN CASE WHEN c % 2 = 0 THEN 'wrong_gold_answer' ELSE 'uncertain' END ELSE 'none' END END AS vb,
 CASE WHEN hd THEN CASE c % 3 WHEN 0 THEN 'none' WHEN 1 THEN ['no_correct_answer', 'wrong_gold_answer', 'multiple_correct_answers'][len(ba) + 1] ELSE 'uncertain' END END AS vd,
 CASE WHEN hc THEN CASE WHEN c % 4 = 1 THEN 'none' ELSE CASE k % 5 WHEN 1 THEN 'no_correct_answer' WHEN 2 THEN 'uncertain' WHEN 4 THEN 'wrong_gold_answer' ELSE CASE WHEN c % 4 = 2 THEN 'none' ELSE ['no_correct_answer', 'wrong_gold_answer', 'multiple_correct_answers'][len(ca) + 1] END END END END AS vc,
 (c % 10) / 10 + CASE WHEN hd THEN (k % 7) / 10 ELSE 0 END + CASE WHEN hc AND c % 6 > 0 THEN (c % 6) / 6 + 0.16 ELSE 0 END AS total FROM o),
w AS (SELECT *, list_filter([vb, vd, vc], lambda x: x IS NOT NULL) AS votes FROM v), t AS (SELECT k, unnest(votes) AS vote FROM w),
n AS (SELECT k, vote, count(*) AS n FROM t WHERE vote NOT IN ('none', 'uncertain') GROUP BY 1, 2), b AS (SELECT k, vote, n FROM n QUALIFY row_number() OVER (PARTITION BY k ORDER BY n DESC, vote DESC) = 1),
a AS (SELECT w.*, b.vote, coalesce(b.n, 0) AS n, len(list_filter(votes, lambda x: x = 'none')) AS against, len(votes) AS stages FROM w LEFT JOIN b USING (k)),
ev AS (SELECT k AS row_uid, CASE WHEN n = 0 THEN CASE WHEN against > 0 THEN 'supported' ELSE 'uncertain' END WHEN against > 0 AND n <= against THEN 'uncertain' ELSE 'contradicted' END AS gold_status, coalesce(vote, 'none') AS defect_type,
 CASE WHEN n = 0 THEN against ELSE n END / stages * (total / stages) AS confidence, n / stages AS agreement, stages AS n_stages, k % 17 = 0 OR (hc AND c % 23 = 0) AS needs_expert, array_to_string(votes, '|') AS votes,
 array_to_string(list_sort(list_distinct(list_concat(ba, CASE WHEN hc THEN ca ELSE [] END))), '|') AS answers FROM a)"""


@query("stage_evidence", f"{EVIDENCE_SQL} SELECT * REPLACE (round(confidence, 6) AS confidence) FROM ev")
def stage_evidence(spark, sf_dir):
    bar = lambda c: F.array_join(c, "|").alias(c)
    return votes.stage_evidence(verdict_rows(spark, sf_dir)).select("row_uid", "gold_status", "defect_type", "confidence", "agreement", "n_stages", "needs_expert", bar("votes"), bar("answers"))


@query("stage_findings", f"{EVIDENCE_SQL} SELECT row_uid, defect_type, row_uid % 10 < 3 OR needs_expert OR round(confidence, 6) < 0.6 AS review_only FROM ev WHERE round(confidence, 6) >= 0.4 AND defect_type <> 'none'")
def stage_findings(spark, sf_dir):
    evidence = votes.stage_evidence(verdict_rows(spark, sf_dir)).withColumn("vote_fraction", (F.col("row_uid") % 10) / 4.5)
    return votes.evidence_findings(evidence, confirm=0.6, review=0.4).select("row_uid", "defect_type", "review_only")


@query("majority_answers", """WITH v AS (SELECT l_orderkey AS key, l_linenumber AS position, CASE WHEN l_partkey % 11 = 0 THEN NULL WHEN l_partkey % 13 = 0 THEN '' WHEN l_orderkey % 9 = 0 THEN '' ELSE l_returnflag END AS vote FROM lineitem),
n AS (SELECT key, vote, count(*) AS n, min(position) AS first FROM v WHERE vote <> '' GROUP BY 1, 2), b AS (SELECT * FROM n QUALIFY row_number() OVER (PARTITION BY key ORDER BY n DESC, first, vote DESC) = 1)
SELECT v.key, coalesce(any_value(b.vote), 'uncertain') AS majority, count(CASE WHEN v.vote <> '' THEN 1 END) AS n_votes, coalesce(any_value(b.n), 0) AS top, coalesce(any_value(b.first), min(v.position)) AS exemplar FROM v LEFT JOIN b ON b.key = v.key GROUP BY v.key""")
def majority_answers(spark, sf_dir):
    k, p = F.col("l_orderkey"), F.col("l_partkey")
    vote = F.when(p % 11 == 0, F.lit(None)).when(p % 13 == 0, "").when(k % 9 == 0, "").otherwise(F.concat(F.lit(" "), "l_returnflag"))
    return votes.majority(table(spark, sf_dir, "lineitem").select(k.alias("key"), F.col("l_linenumber").alias("position"), vote.alias("vote"), F.col("l_linenumber").alias("result")))


@query("profile_agreement", """WITH v AS (SELECT l_orderkey AS key, unnest([{'d': 'modality', 'v': CASE WHEN l_partkey % 7 = 0 THEN NULL ELSE l_returnflag END}, {'d': 'task_shape', 'v': CASE WHEN l_orderkey % 3 = 0 THEN l_linestatus ELSE 'open' END}]) AS x FROM lineitem),
d AS (SELECT DISTINCT key, x.d AS dimension, x.v AS value FROM v)
SELECT key, dimension, CASE WHEN count(*) = 1 THEN max(value) ELSE 'other' END AS value, CASE WHEN count(*) > 1 THEN 'votes split between ' || string_agg(coalesce(value, 'None'), ', ' ORDER BY coalesce(value, 'None')) END AS disputed FROM d GROUP BY 1, 2""")
def profile_agreement(spark, sf_dir):
    k = F.col("l_orderkey")
    of = lambda d, v: F.struct(F.lit(d).alias("dimension"), v.alias("value"))
    both = F.array(of("modality", F.when(F.col("l_partkey") % 7 != 0, F.col("l_returnflag"))), of("task_shape", F.when(k % 3 == 0, F.col("l_linestatus")).otherwise("open")))
    return votes.agreed(table(spark, sf_dir, "lineitem").select(k.alias("key"), F.explode(both).alias("x")).select("key", "x.*"))
