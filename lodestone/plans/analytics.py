"""Queries over responses, leaderboards, methods and samples, each with the SQL that says the same."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestone.operators import evidence, metrics, responses, tables
from lodestone.plans import views as V
from lodestone.plans.views import DOC_SQL, FLAG_SQL, RESP_SQL, TRIAL_SQL, table

QUERIES: dict = {}
Z = "1.959963984540054"


def query(name: str, sql: str | None = None):
    def keep(f):
        QUERIES[name] = (f, sql)
        return f

    return keep


@query("response_quality", f"WITH {RESP_SQL}, n AS (SELECT count(DISTINCT item_id) AS n FROM resp) SELECT model_id, count(DISTINCT item_id) AS answered, count(DISTINCT item_id)::DOUBLE / max(n) AS coverage, count(DISTINCT item_id)::DOUBLE / max(n) >= 0.8 AS qualified FROM resp, n GROUP BY model_id")
def response_quality(spark, sf_dir):
    return responses.quality(V.responses(spark, sf_dir))


ERR = f"""err AS (SELECT item_id, count(*) AS n, sum(1 - correct)::BIGINT AS wrong, sum(1 - correct)::DOUBLE / count(*) AS error_rate FROM resp GROUP BY item_id)"""


@query("item_error_wilson", f"""WITH {RESP_SQL}, {ERR} SELECT *, greatest(0.0, (error_rate + {Z}*{Z}/(2*n)) / (1 + {Z}*{Z}/n) - {Z} * sqrt(error_rate*(1-error_rate)/n + {Z}*{Z}/(4.0::DOUBLE*n*n)) / (1 + {Z}*{Z}/n)) AS lo,
 least(1.0, (error_rate + {Z}*{Z}/(2*n)) / (1 + {Z}*{Z}/n) + {Z} * sqrt(error_rate*(1-error_rate)/n + {Z}*{Z}/(4.0::DOUBLE*n*n)) / (1 + {Z}*{Z}/n)) AS hi FROM err""".replace(Z, Z + "::DOUBLE"))
def item_error_wilson(spark, sf_dir):
    return responses.item_errors(V.responses(spark, sf_dir))


def _pct(c: str, src: str) -> str:
    return f"(rank() OVER (ORDER BY {c}) - 1 + (count(*) OVER (PARTITION BY {c}) - 1) / 2.0::DOUBLE) / (count(*) OVER () - 1)"


@query("percentile_fusion", f"""WITH {RESP_SQL}, {ERR}, a AS (SELECT item_id, count(DISTINCT label)::DOUBLE AS score FROM resp GROUP BY 1), j AS (SELECT * FROM err JOIN a USING (item_id))
SELECT item_id, {_pct('error_rate', 'j')} AS error_pct, {_pct('score', 'j')} AS audit_pct, 0.5::DOUBLE * {_pct('error_rate', 'j')} + 0.5::DOUBLE * {_pct('score', 'j')} AS fused FROM j""")
def percentile_fusion(spark, sf_dir):
    r = V.responses(spark, sf_dir)
    return responses.fused_triage(responses.item_errors(r), r.groupBy("item_id").agg(F.count_distinct("label").cast("double").alias("score")))


@query("behavior_entropy", f"WITH {RESP_SQL}, c AS (SELECT item_id, label, count(*) AS c FROM resp GROUP BY ALL), p AS (SELECT item_id, c / (sum(c) OVER (PARTITION BY item_id))::DOUBLE AS p FROM c) SELECT item_id, round(sum(-p * ln(p)) / ln(3.0), 9) AS entropy FROM p GROUP BY 1")
def behavior_entropy(spark, sf_dir):
    e = responses.entropy(V.responses(spark, sf_dir), 3)
    return e.select("item_id", F.round("entropy", 9).alias("entropy"))


@query("majority_against_gold", f"WITH {RESP_SQL}, c AS (SELECT item_id, label, count(*) AS c FROM resp GROUP BY ALL) SELECT item_id, (max(CASE WHEN label <> 'N' THEN c ELSE 0 END) - sum(CASE WHEN label = 'N' THEN c ELSE 0 END))::DOUBLE / sum(c) AS score FROM c GROUP BY 1")
def majority_against_gold(spark, sf_dir):
    return responses.majority_against_gold(V.responses(spark, sf_dir).withColumn("gold", F.lit("N")))


TOT = "tot AS (SELECT model_id, sum(correct) AS total FROM resp GROUP BY 1)"
ITEM_TOTAL = f"""{TOT}, it AS (SELECT item_id, correct::DOUBLE AS x, (total - correct)::DOUBLE AS rest FROM resp JOIN tot USING (model_id)),
itt AS (SELECT item_id, CASE WHEN count(*) >= 3 AND stddev_pop(x) >= 1e-12 AND stddev_pop(rest) >= 1e-12 THEN -corr(x, rest) ELSE 0.0 END AS anomaly FROM it GROUP BY 1)"""


@query("item_total_corr", f"WITH {RESP_SQL}, {ITEM_TOTAL} SELECT item_id, round(anomaly, 6) + 0.0 AS anomaly FROM itt")
def item_total(spark, sf_dir):
    return responses.item_total(V.responses(spark, sf_dir)).select("item_id", (F.round("anomaly", 6) + 0.0).alias("anomaly"))


@query("top_third_disagreement", f"""WITH {RESP_SQL}, {TOT}, t AS (SELECT model_id, row_number() OVER (ORDER BY total DESC, model_id) <= greatest(2, ceil(count(*) OVER () / 3.0)) AS is_top FROM tot)
SELECT item_id, round(coalesce(avg(CASE WHEN is_top THEN 1 - correct END), 0) - avg(1 - correct), 9) + 0.0 AS score FROM resp JOIN t USING (model_id) GROUP BY 1""")
def top_third(spark, sf_dir):
    return responses.top_third_disagreement(V.responses(spark, sf_dir)).select("item_id", (F.round("score", 9) + 0.0).alias("score"))


@query("psychometric_fusion")
def psychometric_fusion(spark, sf_dir):
    r = V.responses(spark, sf_dir)
    parts = {"entropy": responses.entropy(r, 3), "total": responses.item_total(r), "top": responses.top_third_disagreement(r), "majority": responses.majority_against_gold(r.withColumn("gold", F.lit("N")))}
    return responses.fuse(parts)


BOARD = "board AS (SELECT system_id, avg(coalesce(reward, 0)) AS score, count(*) AS n FROM trials GROUP BY 1)"
CLEAN = "clean AS (SELECT system_id, avg(coalesce(reward, 0)) AS score, count(*) AS n FROM trials WHERE task_id NOT IN (SELECT p_partkey FROM part WHERE p_size < 10) GROUP BY 1)"


def _boards(spark, sf_dir):
    t = V.trials(spark, sf_dir)
    drop = table(spark, sf_dir, "part").where("p_size < 10").select(F.col("p_partkey").alias("task_id"))
    return responses.leaderboard(t), responses.leaderboard(t.join(drop, "task_id", "left_anti"))


@query("leaderboard", f"WITH {TRIAL_SQL}, {BOARD} SELECT *, (row_number() OVER (ORDER BY score DESC, system_id))::INT AS rank FROM board")
def leaderboard(spark, sf_dir):
    return _boards(spark, sf_dir)[0]


@query("leaderboard_impact", f"""WITH {TRIAL_SQL}, {BOARD}, {CLEAN}, a AS (SELECT *, (row_number() OVER (ORDER BY score DESC, system_id))::INT AS r FROM board), b AS (SELECT *, (row_number() OVER (ORDER BY score DESC, system_id))::INT AS r FROM clean)
SELECT a.system_id, a.r AS old_rank, b.r AS new_rank, a.r - b.r AS shift, b.score - a.score AS gain FROM a JOIN b USING (system_id)""")
def leaderboard_impact(spark, sf_dir):
    return responses.impact(*_boards(spark, sf_dir))


@query("rank_correlation", f"""WITH {TRIAL_SQL}, {BOARD}, {CLEAN}, j AS (SELECT system_id, round(board.score, 1) AS x, round(clean.score, 1) AS y FROM board JOIN clean USING (system_id)),
p AS (SELECT count(*) AS pairs, sum(sign(a.x-b.x)*sign(a.y-b.y))::DOUBLE AS s, sum((a.x=b.x)::INT) AS tx, sum((a.y=b.y)::INT) AS ty, sum((sign(a.x-b.x)*sign(a.y-b.y) < 0)::INT)::BIGINT AS flips FROM j a JOIN j b ON a.system_id < b.system_id),
r AS (SELECT x, y, rank() OVER (ORDER BY x) + (count(*) OVER (PARTITION BY x) - 1) / 2.0 AS rx, rank() OVER (ORDER BY y) + (count(*) OVER (PARTITION BY y) - 1) / 2.0 AS ry FROM j),
o AS (SELECT count(*) AS n, corr(rx, ry) AS spearman, corr(x, y) AS pearson FROM r)
SELECT n, s / pairs AS tau_a, s / sqrt(((pairs - tx) * (pairs - ty))::DOUBLE) AS tau_b, round(spearman, 9) AS spearman, round(pearson, 9) AS pearson, flips FROM o, p""")
def rank_correlation(spark, sf_dir):
    a, b = _boards(spark, sf_dir)
    pairs = a.select("system_id", F.round("score", 1).alias("x")).join(b.select("system_id", F.round("score", 1).alias("y")), "system_id")
    c = responses.rank_correlations(pairs)
    return c.select("n", "tau_a", "tau_b", F.round("spearman", 9).alias("spearman"), F.round("pearson", 9).alias("pearson"), "flips")


@query("method_overlap_jaccard", f"WITH {FLAG_SQL}, s AS (SELECT method, count(*) AS n FROM flags GROUP BY 1), b AS (SELECT x.method AS a, y.method AS b, count(*) AS common FROM flags x JOIN flags y USING (item_id) WHERE x.method < y.method GROUP BY 1, 2) SELECT a, b.b, common, sa.n + sb.n - common AS either, common::DOUBLE / (sa.n + sb.n - common) AS jaccard FROM b JOIN s sa ON sa.method = a JOIN s sb ON sb.method = b.b")
def method_overlap(spark, sf_dir):
    return responses.method_overlap(V.flags(spark, sf_dir))


@query("unique_positive", f"WITH {FLAG_SQL}, p AS (SELECT item_id, min(method) AS method FROM flags GROUP BY 1 HAVING count(*) = 1) SELECT method, count(*) AS unique_items FROM p GROUP BY 1")
def unique_positive(spark, sf_dir):
    return responses.unique_positives(V.flags(spark, sf_dir))


@query("phi_matrix", """WITH x AS (SELECT (l_returnflag = 'R')::INT AS a, (l_quantity > 40)::INT AS b, (l_discount > 0.085)::INT AS c FROM lineitem)
SELECT 'a' AS a, 'b' AS b, round(corr(a, b), 9) AS phi FROM x UNION ALL SELECT 'a', 'c', round(corr(a, c), 9) FROM x UNION ALL SELECT 'b', 'c', round(corr(b, c), 9) FROM x""")
def phi_matrix(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").select((F.col("l_returnflag") == "R").cast("int").alias("a"), (F.col("l_quantity") > 40).cast("int").alias("b"), (F.col("l_discount") > 0.085).cast("int").alias("c"))
    return responses.phi(li, ["a", "b", "c"]).select("a", "b", F.round("phi", 9).alias("phi"))


@query("status_cube", "SELECT CASE WHEN grouping(event_type) = 1 AND grouping(u) = 1 THEN 'all' WHEN grouping(event_type) = 1 THEN 'user' WHEN grouping(u) = 1 THEN 'type' ELSE 'both' END AS level, event_type, u, count(*) AS n FROM (SELECT event_type, user_id % 7 AS u FROM events) GROUP BY CUBE (event_type, u)")
def status_cube(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_type", (F.col("user_id") % 7).alias("u"))
    level = F.when((F.grouping("event_type") == 1) & (F.grouping("u") == 1), "all").when(F.grouping("event_type") == 1, "user").when(F.grouping("u") == 1, "type").otherwise("both")
    return e.cube("event_type", "u").agg(level.alias("level"), F.count(F.lit(1)).alias("n"))


@query("paired_condition_effect", f"WITH {RESP_SQL}, p AS (SELECT item_id, max(CASE WHEN model_id = '1' THEN correct END) AS a, max(CASE WHEN model_id = '2' THEN correct END) AS b FROM resp GROUP BY 1) SELECT sum((a=1 AND b=1)::INT)::BIGINT AS common, sum((a=1 AND b=0)::INT)::BIGINT AS only_a, sum((a=0 AND b=1)::INT)::BIGINT AS only_b, sum((a=0 AND b=0)::INT)::BIGINT AS neither FROM p WHERE a IS NOT NULL AND b IS NOT NULL")
def paired_condition(spark, sf_dir):
    r = V.responses(spark, sf_dir)
    return responses.paired_conditions(r.groupBy(F.col("item_id").alias("task_id")).agg(F.max(F.when(F.col("model_id") == "1", F.col("correct"))).alias("a"), F.max(F.when(F.col("model_id") == "2", F.col("correct"))).alias("b")))


@query("topk_precision_ties", """WITH g AS (SELECT l_quantity AS score, count(*) AS n, sum((l_returnflag = 'R')::INT) AS pos FROM lineitem GROUP BY 1), w AS (SELECT *, coalesce(sum(n) OVER (ORDER BY score DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before, sum(pos) OVER () AS all_pos FROM g),
c AS (SELECT k, sum(greatest(0, least(k - before, n)) * pos / n::DOUBLE) AS hits, max(all_pos) AS all_pos FROM w, (SELECT unnest([50, 500, 5000]) AS k) GROUP BY k) SELECT k, round(hits, 6) AS hits, round(hits / k, 9) AS precision, round(hits / all_pos, 9) AS recall FROM c""")
def topk_precision(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").select(F.col("l_quantity").alias("score"), (F.col("l_returnflag") == "R").cast("int").alias("positive"))
    p = responses.precision_at(li, [50, 500, 5000])
    return p.select("k", F.round("hits", 6).alias("hits"), F.round("precision", 9).alias("precision"), F.round("recall", 9).alias("recall"))


@query("distribution_summary", "WITH m AS (SELECT median(o_totalprice) AS m FROM orders) SELECT count(o_totalprice) AS n, min(o_totalprice) AS lo, max(o_totalprice) AS hi, round(avg(o_totalprice), 4) AS mean, round(median(o_totalprice), 4) AS median, round(stddev_samp(o_totalprice), 4) AS sd, round((SELECT median(abs(o_totalprice - m)) FROM orders, m), 4) AS mad FROM orders")
def distribution(spark, sf_dir):
    d = responses.distribution(table(spark, sf_dir, "orders"), "o_totalprice")
    return d.select("n", "lo", "hi", *[F.round(c, 4).alias(c) for c in ("mean", "median", "sd", "mad")])


@query("stratified_sample_manifest", f"""WITH {DOC_SQL}, t AS (SELECT item_id, lang, source, row_number() OVER (PARTITION BY lang, source ORDER BY md5('7:' || item_id), item_id) AS turn FROM doc_items), p AS (SELECT item_id, lang, source, (row_number() OVER (ORDER BY turn, lang, source))::INT AS place FROM t) SELECT * FROM p WHERE place <= 120""")
def stratified_sample(spark, sf_dir):
    return metrics.stratified_sample(V.doc_items(spark, sf_dir), 120, ("lang", "source"), 7)


@query("subject_folds", """WITH g AS (SELECT source, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, source NULLS LAST) AS pos FROM documents GROUP BY 1),
a AS (WITH RECURSIVE r AS (SELECT 0::BIGINT AS pos, [0::BIGINT, 0, 0, 0] AS held, NULL::INT AS fold, NULL::VARCHAR AS source, 0::BIGINT AS n
 UNION ALL SELECT g.pos, list_transform(held, lambda h, i: CASE WHEN i = list_position(held, list_min(held)) THEN h + g.n ELSE h END), (list_position(held, list_min(held)) - 1)::INT, g.source, g.n FROM r JOIN g ON g.pos = r.pos + 1) SELECT * FROM r)
SELECT source, n, fold FROM a WHERE pos > 0""")
def subject_folds(spark, sf_dir):
    return metrics.balanced_folds(table(spark, sf_dir, "documents"), "source", 4)


WEIGHT = "CASE WHEN u < 0.36787944117144233 THEN 0 WHEN u < 0.7357588823428847 THEN 1 WHEN u < 0.9196986029286058 THEN 2 WHEN u < 0.9810118431238462 THEN 3 WHEN u < 0.9963401531726563 THEN 4 WHEN u < 0.9994058151824183 THEN 5 WHEN u < 0.9999167588507119 THEN 6 WHEN u < 0.9999897508033253 THEN 7 ELSE 8 END"


@query("bootstrap_ci", f"""WITH d AS (SELECT doc_id, n_chars, ('0x' || substr(md5('3:' || draw || ':' || doc_id), 1, 8))::BIGINT / 4294967296.0::DOUBLE AS u, draw FROM documents, (SELECT unnest(range(1, 201)) AS draw)),
m AS (SELECT draw, sum(({WEIGHT}) * n_chars) / sum({WEIGHT})::DOUBLE AS m FROM d GROUP BY 1) SELECT round(quantile_cont(m, 0.025), 6) AS lo, (SELECT round(avg(n_chars), 6) FROM documents) AS mean, round(quantile_cont(m, 0.975), 6) AS hi FROM m""")
def bootstrap(spark, sf_dir):
    b = metrics.bootstrap_mean(table(spark, sf_dir, "documents"), "doc_id", "n_chars", 200, 3)
    return b.select(*[F.round(c, 6).alias(c) for c in ("lo", "mean", "hi")])


@query("permutation_null", """WITH x AS (SELECT doc_id, n_chars, (lang = 'en')::INT AS g FROM documents), s AS (SELECT avg(CASE WHEN g = 1 THEN n_chars END) AS a, avg(CASE WHEN g <> 1 THEN n_chars END) AS b, avg(g) AS share FROM x),
d AS (SELECT draw, n_chars, a, b, ('0x' || substr(md5('5:' || draw || ':' || doc_id), 1, 8))::BIGINT / 4294967296.0::DOUBLE < share AS one FROM x, s, (SELECT unnest(range(1, 201)) AS draw)),
p AS (SELECT draw, avg(CASE WHEN one THEN n_chars END) - avg(CASE WHEN NOT one THEN n_chars END) AS diff, max(a) AS a, max(b) AS b FROM d GROUP BY 1) SELECT round(max(a - b), 6) AS observed, sum((abs(diff) >= abs(a - b))::INT)::BIGINT AS ge, (sum((abs(diff) >= abs(a - b))::INT) + 1) / 201.0::DOUBLE AS p FROM p""")
def permutation(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "n_chars", (F.col("lang") == "en").cast("int").alias("g"))
    p = metrics.permutation_p(docs, "doc_id", "g", "n_chars", 200, 5)
    return p.select(F.round("observed", 6).alias("observed"), "ge", "p")


@query("event_state_fold", "WITH e AS (SELECT user_id, event_type, CASE WHEN event_type = 'purchase' THEN 1 WHEN event_type = 'error' THEN -1 ELSE 0 END AS d, ts, event_id FROM events), r AS (SELECT user_id, sum(d) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS state FROM e) SELECT user_id, max(state)::BIGINT AS peak, min(state)::BIGINT AS trough FROM r GROUP BY 1")
def event_fold(spark, sf_dir):
    from lodestone.operators.folds import running_state

    e = table(spark, sf_dir, "events").withColumn("d", F.when(F.col("event_type") == "purchase", 1).when(F.col("event_type") == "error", -1).otherwise(0))
    return running_state(e, "user_id", ["ts", "event_id"], "d").groupBy("user_id").agg(F.max("state").alias("peak"), F.min("state").alias("trough"))


@query("role_sequences", "SELECT pattern, count(*) AS n FROM (SELECT conv_id, string_agg(role, '>' ORDER BY turn) AS pattern FROM conversations GROUP BY 1) GROUP BY 1")
def role_sequences(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("turn", "role"))), lambda x: x["role"]), ">").alias("pattern"))
    return c.groupBy("pattern").agg(F.count(F.lit(1)).alias("n"))


@query("vote_quorum", f"""WITH {RESP_SQL}, c AS (SELECT item_id, label AS verdict, count(*) AS n FROM resp GROUP BY ALL), m AS (SELECT item_id, max(n) AS top, sum(n) AS total FROM c GROUP BY 1),
t AS (SELECT m.item_id, count(*) AS ties, min(verdict) AS v, max(top) AS top, max(total) AS total FROM m JOIN c ON c.item_id = m.item_id AND c.n = m.top GROUP BY 1) SELECT item_id, CASE WHEN ties = 1 AND top >= 12 THEN v ELSE 'uncertain' END AS verdict, top::DOUBLE / total AS agreement FROM t""")
def vote_quorum(spark, sf_dir):
    return evidence.quorum(V.responses(spark, sf_dir).select("item_id", F.col("label").alias("verdict")), 12)


@query("nearest_artifact", """WITH j AS (SELECT a.n_name AS left_id, b.n_name AS right_id, abs(a.n_nationkey - b.n_nationkey) AS distance FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey <> b.n_nationkey),
l AS (SELECT *, min(distance) OVER (PARTITION BY left_id) AS least FROM j), r AS (SELECT *, row_number() OVER (PARTITION BY left_id ORDER BY right_id) AS n FROM l WHERE distance = least) SELECT left_id, right_id, distance FROM r WHERE n <= 3""")
def nearest_artifact(spark, sf_dir):
    n = table(spark, sf_dir, "nation")
    left = n.select(F.col("n_name").alias("left_id"), F.col("n_nationkey").alias("lk"), "n_regionkey")
    right = n.select(F.col("n_name").alias("right_id"), F.col("n_nationkey").alias("rk"), "n_regionkey")
    return tables.nearest(left, right.withColumnRenamed("n_regionkey", "n_regionkey"), "n_regionkey", F.when(F.col("lk") != F.col("rk"), F.abs(F.col("lk") - F.col("rk"))))


@query("rubric_pass_rates", f"WITH {RESP_SQL} SELECT item_id, count(*) AS n, avg(correct) AS mean FROM resp GROUP BY 1 HAVING count(*) >= 3 AND avg(correct) <= 0.2")
def rubric_pass_rates(spark, sf_dir):
    return V.responses(spark, sf_dir).groupBy("item_id").agg(F.count(F.lit(1)).alias("n"), F.avg("correct").alias("mean")).where("n >= 3 and mean <= 0.2")


@query("signal_synthesis", f"WITH {FLAG_SQL} SELECT item_id, count(DISTINCT method) AS n_signals FROM flags GROUP BY 1 HAVING count(DISTINCT method) >= 2")
def signal_synthesis(spark, sf_dir):
    return evidence.signals(V.flags(spark, sf_dir).withColumnRenamed("method", "signal"))


@query("split_metrics", """WITH r AS (SELECT l_returnflag AS split, (l_quantity > 25)::INT AS expected, CASE WHEN l_linenumber = 7 THEN NULL ELSE (l_extendedprice > 35000)::INT END AS predicted FROM lineitem),
m AS (SELECT split, sum((expected = 1 AND predicted = 1)::INT)::BIGINT AS tp, sum((expected = 1 AND predicted = 0)::INT)::BIGINT AS fn, sum((expected = 0 AND predicted = 1)::INT)::BIGINT AS fp, sum((expected = 0 AND predicted = 0)::INT)::BIGINT AS tn, sum((predicted IS NULL)::INT)::BIGINT AS abstained FROM r GROUP BY 1)
SELECT *, tp::DOUBLE / nullif(tp + fn, 0) AS recall, fp::DOUBLE / nullif(fp + tn, 0) AS fpr FROM m""")
def split_metrics(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    rows = li.select(F.col("l_returnflag").alias("split"), (F.col("l_quantity") > 25).cast("int").alias("expected"), F.when(F.col("l_linenumber") != 7, (F.col("l_extendedprice") > 35000).cast("int")).alias("predicted"))
    return metrics.split_metrics(rows)


@query("paired_discrimination", """WITH r AS (SELECT l_orderkey AS g, (l_quantity > 25)::INT AS e, (l_quantity > 27)::INT AS p FROM lineitem), s AS (SELECT g, bool_or(e = 1) AS a, bool_or(e = 0) AS b, bool_and(p = e) AS ok FROM r GROUP BY 1)
SELECT count(*) AS pairs, sum(ok::INT)::BIGINT AS discriminated FROM s WHERE a AND b""")
def paired_discrimination(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    return metrics.paired_discrimination(li.select(F.col("l_orderkey").alias("source_group"), (F.col("l_quantity") > 25).cast("int").alias("expected"), (F.col("l_quantity") > 27).cast("int").alias("predicted")))


@query("topk_jaccard", """WITH a AS (SELECT c_custkey AS i, row_number() OVER (ORDER BY c_acctbal DESC, c_custkey) AS r FROM customer), b AS (SELECT o_custkey AS i, row_number() OVER (ORDER BY sum(o_totalprice) DESC, o_custkey) AS r FROM orders GROUP BY 1),
j AS (SELECT greatest(a.r, b.r) AS r FROM a JOIN b USING (i)), k AS (SELECT unnest([10, 50, 200]) AS k) SELECT k, count(r) AS common, count(r)::DOUBLE / (2 * k - count(r)) AS jaccard FROM k LEFT JOIN j ON r <= k GROUP BY k""")
def topk_jaccard(spark, sf_dir):
    a = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("item_id"), F.col("c_acctbal").alias("score"))
    b = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("item_id")).agg(F.sum("o_totalprice").alias("score"))
    return metrics.topk_jaccard(a, b, [10, 50, 200])


@query("gold_correction_impact", f"""WITH {RESP_SQL}, x AS (SELECT model_id, label, 'A' AS gold, CASE WHEN item_id::INT % 5 = 0 THEN 'N' ELSE 'A' END AS now FROM resp), p AS (SELECT model_id, avg((label = gold)::INT) AS old, avg((label = now)::INT) AS new FROM x GROUP BY 1)
SELECT model_id, old, new, new - old AS gain, (row_number() OVER (ORDER BY old DESC, model_id))::INT AS old_rank, (row_number() OVER (ORDER BY new DESC, model_id))::INT AS new_rank FROM p""")
def gold_correction(spark, sf_dir):
    r = V.responses(spark, sf_dir).withColumn("gold", F.lit("A"))
    fixed = r.where("cast(item_id as int) % 5 = 0").select("item_id").distinct().withColumn("new_gold", F.lit("N"))
    return metrics.correction_impact(r, fixed)


@query("repeat_arms", "SELECT user_id AS item_id, count(DISTINCT event_type) AS runs FROM events GROUP BY 1 HAVING count(DISTINCT event_type) >= 5")
def repeat_arms(spark, sf_dir):
    return metrics.repeat_arms(table(spark, sf_dir, "events").select(F.col("user_id").alias("item_id"), F.col("event_type").alias("run")), 5)
