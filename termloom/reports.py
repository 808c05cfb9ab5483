"""More registered queries: validation, summaries, patches, published tables, plans and contracts, each beside SQL that says the same.

Stand-ins: orders with their lineitems are predictions of modes (order priorities) and of models; parts are vocabularies, replies and results.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from .functions import errors
from .functions import gold as G
from .functions import numbers as N
from .operators import audit, baselines, compare, contracts, decide, evaluate, hierarchy, patch, payload, planning, reconcile, retrieve, runs, score, summaries, validate
from .operators.store import written
from .operators.vector_index import new_path
from .plans import disabled
from .queries import _PRED, _REL, MODES, predictions, query, relations, rounded, table
from .sources.versions import VersionedTable

# --- validation -------------------------------------------------------------------------------------------------------

# codes of a vocabulary, of one that has no table, of an unknown one, and no codes at all
_CODED = """CASE l_partkey % 4 WHEN 0 THEN CASE l_partkey % 12 WHEN 0 THEN 'HP:' WHEN 4 THEN 'hpo_' ELSE ' HPO:' END || l_partkey WHEN 1 THEN 'LOINC:' || l_partkey WHEN 2 THEN 'zz:' || l_partkey ELSE 'code ' || l_partkey END AS code,
  CASE l_returnflag WHEN 'R' THEN 'mapped' WHEN 'A' THEN 'unmapped' ELSE 'error' END AS status"""
_VALID = f"""y AS (SELECT l_orderkey AS id, l_linenumber AS line, l_partkey AS k, {_CODED} FROM lineitem),
v AS (SELECT y.*, CASE WHEN status <> 'mapped' THEN 'NOT_APPLICABLE' WHEN k % 4 = 0 AND k % 16 = 0 THEN 'VALID' WHEN k % 4 = 0 THEN CASE WHEN p_partkey IS NULL THEN 'INVALID' ELSE 'VALID' END WHEN k % 4 = 3 THEN 'INVALID' ELSE 'UNRESOLVED' END AS outcome,
  CASE WHEN status <> 'mapped' THEN NULL WHEN k % 16 = 0 THEN 'cache' WHEN k % 4 = 0 THEN 'OLS4' WHEN k % 4 = 1 THEN 'LOINC-FHIR' ELSE 'UNKNOWN' END AS source FROM y LEFT JOIN part ON p_partkey = k AND p_size > 5)"""


def checked(spark, d):
    rows = table(spark, d, "lineitem").selectExpr("l_orderkey AS id", "l_linenumber AS line", *[x.strip() for x in _CODED.replace("AS code,", "AS mapped_code\x00").split("\x00")])
    part = table(spark, d, "part")
    vocabulary = part.where("p_size > 5").select(F.concat(F.lit("hp:"), "p_partkey").alias("code"))
    cache = part.where("p_partkey % 16 = 0").select(F.concat(F.lit("HP:"), "p_partkey").alias("curie"), F.lit("VALID").alias("status"), F.lit("cache").alias("source"))
    return validate.validated(rows, vocabulary, cache)


@query(f"WITH {_VALID} SELECT id, line, outcome, source FROM v")
def validation_pass(spark, d):
    return rounded(checked(spark, d).select("id", "line", F.col("validation_status").alias("outcome"), F.col("validation_source").alias("source")))


@query(f"""WITH {_VALID}, a AS (SELECT status, count(*) FILTER (WHERE status = 'mapped') AS mapped, count(*) FILTER (WHERE outcome = 'VALID') AS valid, count(*) FILTER (WHERE outcome = 'INVALID') AS invalid, count(*) FILTER (WHERE outcome = 'UNRESOLVED') AS unresolved,
  count(*) FILTER (WHERE outcome = 'NOT_APPLICABLE') AS not_applicable FROM v GROUP BY status)
SELECT *, round(invalid / nullif(valid + invalid, 0), 6) AS hallucination_rate, round((valid + invalid) / nullif(mapped, 0), 6) AS coverage, round(unresolved / nullif(mapped, 0), 6) AS unresolved_rate FROM a""")
def validation_summary(spark, d):
    return rounded(validate.hallucination(checked(spark, d), ["status"]))


@query(f"WITH {_VALID}, c AS (SELECT DISTINCT upper(code) AS curie, outcome FROM v WHERE outcome <> 'NOT_APPLICABLE') SELECT count(*) AS total, count(*) FILTER (WHERE outcome = 'VALID') AS valid, count(*) FILTER (WHERE outcome = 'INVALID') AS invalid, count(*) FILTER (WHERE outcome = 'UNRESOLVED') AS unresolved FROM c")
def validation_cache(spark, d):
    return validate.cache_stats(validate.cache_of(checked(spark, d)))


@query("""WITH c AS (SELECT DISTINCT l_orderkey AS id, l_partkey AS k FROM lineitem), m AS (SELECT o_orderkey AS id, o_orderpriority AS mode, CASE WHEN o_orderkey % 3 = 0 THEN (SELECT min(k) FROM c WHERE c.id = o_orderkey) WHEN o_orderkey % 3 = 1 THEN -1 END AS k, o_orderstatus = 'F' AS mapped FROM orders)
SELECT mode, count(*) FILTER (WHERE mapped) AS mapped, count(*) FILTER (WHERE mapped AND k >= 0) AS grounded, round(count(*) FILTER (WHERE mapped AND k >= 0) / nullif(count(*) FILTER (WHERE mapped), 0), 6) AS grounding_rate FROM m GROUP BY mode""")
def grounding_by_mode(spark, d):
    c = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("request_id"), F.concat(F.lit("p:"), "l_partkey").alias("code"), "l_partkey")
    least = c.groupBy("request_id").agg(F.min("l_partkey").alias("k"))
    o = table(spark, d, "orders").join(least, F.col("o_orderkey") == F.col("request_id"), "left").drop("request_id")
    k = F.when(F.col("o_orderkey") % 3 == 0, F.col("k")).when(F.col("o_orderkey") % 3 == 1, F.lit(-1))
    rows = o.select(F.col("o_orderkey").alias("request_id"), F.col("o_orderpriority").alias("mode"), F.when(F.col("o_orderstatus") == "F", "mapped").otherwise("unmapped").alias("status"), F.concat(F.lit("P:"), k.cast("string")).alias("mapped_code"))
    return rounded(validate.grounding(validate.grounded(rows, c.drop("l_partkey")), ["mode"]))


# --- summaries --------------------------------------------------------------------------------------------------------

_RAW = f"""{_PRED}, raw AS (SELECT id, mode AS model, cust % 2 + 1 AS run, 'O' || (cust % 3) AS onto, status, CASE WHEN status = 'mapped' THEN r END AS k, gold, id % 4 AS logic,
  id % 97 / 10.0 AS e2e, CASE WHEN id % 7 <> 0 THEN id % 50 / 20.0 END AS llm, id % 30 / 10.0 AS ret, id % 1000 AS tin, CASE WHEN id % 5 <> 0 THEN id % 11 / 1000.0 END AS cost, CASE WHEN id % 6 = 0 THEN 2 ELSE 0 END AS retries, CASE WHEN id % 40 = 0 THEN 1 END AS final FROM s),
frac AS (SELECT *, CASE WHEN status = 'mapped' AND k IS NOT NULL THEN power(0.5, k - 1) ELSE 0 END AS tp FROM raw),
x AS (SELECT *, CASE WHEN status = 'mapped' THEN (1 - tp) / 2 ELSE 0 END AS fp, CASE WHEN status = 'mapped' THEN (1 - tp) / 2 WHEN len(gold) > 0 THEN 1 ELSE 0 END AS fn, CASE WHEN status <> 'mapped' AND len(gold) = 0 THEN 1 ELSE 0 END AS tn FROM frac)"""


def raw(spark, d):
    """Raw rows of a model benchmark."""
    p = score.scored(predictions(spark, d))
    i, mapped = F.col("id"), F.col("status") == "mapped"
    p = p.withColumn("k", F.when(mapped, F.col("gold_rank"))).withColumn("f", G.fractional(mapped, F.col("k"), F.col("gold")))
    return p.select(
        "id", F.col("mode").alias("model"), (F.col("cust") % 2 + 1).cast("int").alias("run_number"), F.concat(F.lit("O"), (F.col("cust") % 3).cast("string")).alias("target_ontology"), F.col("status").alias("mapped_status"),
        "f.tp", "f.fp", "f.fn", "f.tn", (F.col("k") == 1).alias("top1_correct"), F.col("k").isNotNull().alias("top5_hit"), F.element_at(F.array(*[F.lit(x) for x in summaries.LOGIC]), (i % 4 + 1).cast("int")).alias("logic_type"),
        (i % 97 / 10).alias("end_to_end_seconds"), F.when(i % 7 != 0, i % 50 / 20).alias("llm_seconds"), (i % 30 / 10).alias("retrieval_seconds"), (i % 1000).alias("total_input_tokens"), F.lit(None).cast("bigint").alias("total_cached_input_tokens"),
        (i % 100).alias("total_output_tokens"), (i % 10).alias("total_reasoning_tokens"), F.when(i % 5 != 0, i % 11 / 1000).alias("api_cost_usd"), F.when(i % 6 == 0, 2).otherwise(0).alias("retrieval_retry_count"), F.when(i % 40 == 0, 1).alias("retrieval_final_error_count"),
    )


_RUN = f"""{_RAW}, z AS (SELECT model, run, count(*) AS rows_total, count(*) FILTER (WHERE status <> 'error') AS rows_evaluated, count(*) FILTER (WHERE status = 'error') AS error_count,
  CAST(sum(tp) FILTER (WHERE status <> 'error') AS DOUBLE) AS tp, CAST(sum(fp) FILTER (WHERE status <> 'error') AS DOUBLE) AS fp, CAST(sum(fn) FILTER (WHERE status <> 'error') AS DOUBLE) AS fn, CAST(sum(tn) FILTER (WHERE status <> 'error') AS DOUBLE) AS tn,
  count(*) FILTER (WHERE k = 1) AS top1_correct_count, count(k) AS top5_hit_count, count(*) FILTER (WHERE status = 'mapped') AS mapped_count, count(*) FILTER (WHERE status = 'unmapped') AS unmapped_count,
  count(*) FILTER (WHERE status <> 'error' AND logic = 0) AS direct_count, count(*) FILTER (WHERE status <> 'error' AND logic = 1) AS rag_count, count(*) FILTER (WHERE status <> 'error' AND logic = 2) AS hybrid_count, count(*) FILTER (WHERE status <> 'error' AND logic = 3) AS llm_count,
  avg(e2e) AS mean_e2e, quantile_cont(e2e::DOUBLE, 0.5) AS median_e2e, quantile_cont(e2e::DOUBLE, 0.95) AS p95_e2e, CAST(sum(llm) FILTER (WHERE status <> 'error') AS DOUBLE) AS total_llm, avg(llm) FILTER (WHERE status <> 'error') AS mean_llm,
  quantile_cont(llm::DOUBLE, 0.5) FILTER (WHERE status <> 'error') AS median_llm, quantile_cont(llm::DOUBLE, 0.95) FILTER (WHERE status <> 'error') AS p95_llm, CAST(sum(ret) FILTER (WHERE status <> 'error') AS DOUBLE) AS total_ret,
  CAST(sum(tin) FILTER (WHERE status <> 'error') AS BIGINT) AS total_input_tokens, CAST(sum(id % 100) FILTER (WHERE status <> 'error') AS BIGINT) AS total_output_tokens, CAST(sum(id % 10) FILTER (WHERE status <> 'error') AS BIGINT) AS total_reasoning_tokens,
  CAST(sum(cost) FILTER (WHERE status <> 'error') AS DOUBLE) AS cost, CAST(sum(retries) AS BIGINT) AS retries, count(*) FILTER (WHERE retries > 0) AS with_retries, count(final) AS with_final FROM x GROUP BY model, run)"""


@query(f"""WITH {_RUN} SELECT model, run AS run_number, rows_total, rows_evaluated, error_count, round(tp, 6) AS tp_total, round(fp, 6) AS fp_total, round(fn, 6) AS fn_total, round(tn, 6) AS tn_total, top1_correct_count, top5_hit_count, mapped_count, unmapped_count,
  direct_count, rag_count, hybrid_count, llm_count, round(mean_e2e::DOUBLE, 6) AS mean_end_to_end_seconds_per_term, round(total_llm, 6) AS total_llm_seconds, round(mean_llm::DOUBLE, 6) AS mean_llm_seconds_per_term, round(total_ret, 6) AS total_retrieval_seconds,
  total_input_tokens, NULL::BIGINT AS total_cached_input_tokens, total_output_tokens, total_reasoning_tokens, round(cost, 6) AS total_api_cost_usd, retries AS total_retrieval_retries, with_retries AS rows_with_retrieval_retries, with_final AS rows_with_final_retrieval_errors,
  round(tp / (tp + fp), 6) AS weighted_precision, round(tp / (tp + fn), 6) AS weighted_recall, round(2 * (tp / (tp + fp)) * (tp / (tp + fn)) / (tp / (tp + fp) + tp / (tp + fn)), 6) AS weighted_f1, round(top1_correct_count / rows_evaluated, 6) AS top1_accuracy, round(top5_hit_count / rows_evaluated, 6) AS top5_hit_rate,
  round(cost / rows_evaluated, 6) AS mean_api_cost_per_term_usd, round(median_e2e, 6) AS median_end_to_end_seconds_per_term, round(p95_e2e, 6) AS p95_end_to_end_seconds_per_term, round(median_llm, 6) AS median_llm_seconds_per_term, round(p95_llm, 6) AS p95_llm_seconds_per_term FROM z""")
def run_summary(spark, d):
    return rounded(summaries.run_summary(raw(spark, d), ["model", "run_number"]))


@query(f"""WITH {_RUN}, y AS (SELECT *, tp / (tp + fp) AS p, tp / (tp + fn) AS r, 2 * (tp / (tp + fp)) * (tp / (tp + fn)) / (tp / (tp + fp) + tp / (tp + fn)) AS f1, top1_correct_count / rows_evaluated AS t1, top5_hit_count / rows_evaluated AS t5 FROM z),
g2 AS (SELECT model, avg(CASE WHEN k = 1 THEN 1.0 ELSE 0.0 END)::DOUBLE AS a1 FROM x GROUP BY model)
SELECT y.model, count(*) AS runs_completed, round(avg(p), 6) AS mean_weighted_precision, round(avg(r), 6) AS mean_weighted_recall, round(avg(f1), 6) AS mean_weighted_f1, round(avg(t1), 6) AS mean_top1_accuracy, round(avg(t5), 6) AS mean_top5_hit_rate, round(avg(run * 10.0)::DOUBLE, 6) AS mean_total_run_seconds,
  round(avg(mean_e2e)::DOUBLE, 6) AS mean_end_to_end_seconds_per_term, round(avg(mean_llm)::DOUBLE, 6) AS mean_llm_seconds_per_term, round(sum(cost), 6) AS combined_api_cost_usd, round(max(f1) FILTER (WHERE run = 1), 6) AS run_1_weighted_f1, round(max(f1) FILTER (WHERE run = 2), 6) AS run_2_weighted_f1,
  round(max(t1) FILTER (WHERE run = 1), 6) AS run_1_top1_accuracy, round(max(t1) FILTER (WHERE run = 2), 6) AS run_2_top1_accuracy, round(max(t5) FILTER (WHERE run = 1), 6) AS run_1_top5_hit_rate, round(max(t5) FILTER (WHERE run = 2), 6) AS run_2_top5_hit_rate,
  round(abs(max(f1) FILTER (WHERE run = 1) - max(f1) FILTER (WHERE run = 2)), 6) AS weighted_f1_absolute_difference, round(abs(max(t1) FILTER (WHERE run = 1) - max(t1) FILTER (WHERE run = 2)), 6) AS top1_absolute_difference, round(abs(max(t5) FILTER (WHERE run = 1) - max(t5) FILTER (WHERE run = 2)), 6) AS top5_absolute_difference,
  CAST(sum(retries) AS BIGINT) AS total_retrieval_retries, CAST(sum(with_retries) AS BIGINT) AS rows_with_retrieval_retries, CAST(sum(with_final) AS BIGINT) AS rows_with_final_retrieval_errors, round(sum(cost) / sum(rows_evaluated), 6) AS mean_api_cost_per_term_usd, round(any_value(a1), 6) AS top1_agreement FROM y JOIN g2 ON g2.model = y.model GROUP BY y.model""")
def model_summary(spark, d):
    rows = raw(spark, d)
    found = summaries.run_summary(rows, ["model", "run_number"]).withColumn("run_complete", F.lit(True)).withColumn("total_run_seconds", F.col("run_number") * 10.0)
    agreement = rows.groupBy("model").agg(F.avg(F.coalesce("top1_correct", F.lit(False)).cast("double")).alias("top1_agreement"))
    return rounded(summaries.model_summary(found, agreement))


_E2E = """SUM(CASE WHEN status = 'error' THEN 0 ELSE tp END)::DOUBLE AS tp, SUM(CASE WHEN status = 'error' THEN 0 ELSE fp END)::DOUBLE AS fp, SUM(CASE WHEN status = 'error' THEN 1 ELSE fn END)::DOUBLE AS fn, count(*) AS n,
  count(*) FILTER (WHERE k = 1) / count(*) AS top1_accuracy, count(k) / count(*) AS top5_hit_rate, count(*) FILTER (WHERE status = 'error') AS execution_error_count"""
_PRF = "tp / (tp + fp) AS p, tp / (tp + fn) AS r, 2 * (tp / (tp + fp)) * (tp / (tp + fn)) / (tp / (tp + fp) + tp / (tp + fn)) AS f1"


@query(f"""WITH {_RAW}, e AS (SELECT model, onto, {_E2E} FROM x GROUP BY model, onto), q AS (SELECT *, {_PRF} FROM e), o AS (SELECT onto, row_number() OVER (ORDER BY sum(n) DESC, onto) AS place FROM e GROUP BY onto)
SELECT q.onto AS target_ontology, model, n, round(top1_accuracy, 6) AS top1_accuracy, round(top5_hit_rate, 6) AS top5_hit_rate, execution_error_count, round(p, 6) AS weighted_precision, round(r, 6) AS weighted_recall, round(f1, 6) AS weighted_f1, place FROM q JOIN o ON o.onto = q.onto""")
def ontology_performance(spark, d):
    return rounded(summaries.by_ontology(raw(spark, d)))


@query(f"""WITH {_RAW}, e AS (SELECT model, run, {_E2E} FROM x GROUP BY model, run), q AS (SELECT *, {_PRF} FROM e)
SELECT model, 'low' AS effort, round(avg(p), 6) AS mean_weighted_precision_e2e, round(avg(r), 6) AS mean_weighted_recall_e2e, round(avg(f1), 6) AS mean_weighted_f1_e2e, round(avg(top1_accuracy), 6) AS mean_top1_accuracy_e2e, round(avg(top5_hit_rate), 6) AS mean_top5_hit_rate_e2e,
  round(abs(max(f1) FILTER (WHERE run = 1) - max(f1) FILTER (WHERE run = 2)), 6) AS weighted_f1_absolute_difference_e2e, CAST(sum(execution_error_count) AS BIGINT) AS execution_error_count, round(sum(execution_error_count) / sum(n), 6) AS execution_error_rate FROM q GROUP BY model""")
def combined_models(spark, d):
    rows = raw(spark, d)
    return rounded(summaries.combined_models(rows, rows.select("model", F.lit("low").alias("effort")).distinct()))


@query("""WITH t AS (SELECT o_orderpriority AS model, o_orderkey AS i FROM orders) SELECT model, round(avg(i % 1000), 6) AS mean_total_input_tokens, round(avg(i % 90), 6) AS mean_total_cached_input_tokens, round(avg(i % 100), 6) AS mean_total_output_tokens, CASE WHEN model < '3' THEN round(avg(i % 10), 6) END AS mean_total_reasoning_tokens,
  round(avg(i % 500), 6) AS mean_planner_input_tokens, round(avg(i % 50), 6) AS mean_planner_output_tokens, CASE WHEN model < '3' THEN round(avg(i % 5), 6) END AS mean_planner_reasoning_tokens,
  round(avg(CASE WHEN i % 3 = 0 THEN 0 ELSE i % 400 END), 6) AS mean_reranker_input_tokens, round(avg(i % 40), 6) AS mean_reranker_output_tokens, CASE WHEN model < '3' THEN round(avg(i % 4), 6) END AS mean_reranker_reasoning_tokens FROM t GROUP BY model""")
def token_usage(spark, d):
    i = F.col("o_orderkey")
    sizes = {"total": (1000, 90, 100, 10), "planner": (500, None, 50, 5), "reranker": (400, None, 40, 4)}
    cols = [(F.when(i % 3 != 0, i % n) if (part, kind) == ("reranker", "input") else i % n).alias(f"{part}_{kind}_tokens") for part, of in sizes.items() for kind, n in zip(("input", "cached_input", "output", "reasoning"), of, strict=True) if n]
    return rounded(summaries.token_usage(table(spark, d, "orders").select(F.col("o_orderpriority").alias("model"), *cols), ["1-URGENT", "2-HIGH"]))


@query("""WITH t AS (SELECT o_orderpriority AS mode, CASE WHEN o_orderkey % 3 <> 0 THEN 1 END AS planner, CASE WHEN o_orderkey % 4 = 0 THEN 1 END AS llm FROM orders), a AS (SELECT mode, count(*) AS n, count(planner) AS planner, count(llm) AS llm FROM t GROUP BY mode)
SELECT mode, 'planner' AS field, planner AS present, n AS rows, round(planner / n, 6) AS share FROM a UNION ALL SELECT mode, 'llm', llm, n, round(llm / n, 6) FROM a""")
def latency_completeness(spark, d):
    i = F.col("o_orderkey")
    rows = table(spark, d, "orders").select(F.col("o_orderpriority").alias("mode"), F.when(i % 3 != 0, 1).alias("planner"), F.when(i % 4 == 0, 1).alias("llm"))
    return rounded(summaries.completeness(rows, ["planner", "llm"], ["mode"]))


_MODE = f"""{_PRED}, w AS (SELECT mode, status, CASE WHEN id % 11 <> 0 THEN (id * 7 % 100 + CASE WHEN top1 THEN 40 ELSE 0 END) / 140.0::DOUBLE END AS conf, top1, top3, top5, rr, recall, ranks[1] AS code, id % 3 = 0 AS retrieved, CASE WHEN status <> 'mapped' THEN 'NOT_APPLICABLE' WHEN id % 5 = 0 THEN 'INVALID' WHEN id % 5 = 1 THEN 'UNRESOLVED' ELSE 'VALID' END AS v,
  id % 97 / 10.0 AS e2e, CASE WHEN id % 7 <> 0 THEN id % 50 / 20.0 END AS llm, CASE WHEN id % 5 <> 0 THEN id % 11 / 1000.0 END AS cost FROM s),
a AS (SELECT mode, count(*) AS n, avg(top1::DOUBLE) AS top1_accuracy, avg(top3::DOUBLE) AS top3_accuracy, avg(top5::DOUBLE) AS top5_accuracy, avg(rr)::DOUBLE AS mrr, coalesce(avg(recall), 0) AS recall_at_gt, count(recall) AS recall_at_gt_n,
  count(*) FILTER (WHERE status <> 'error' AND (status = 'unmapped' OR code IS NULL)) AS abstention_count, count(*) FILTER (WHERE status = 'mapped') AS mapped_count, count(*) FILTER (WHERE status = 'unmapped') AS unmapped_count, count(*) FILTER (WHERE status = 'error') AS execution_error_count,
  count(*) FILTER (WHERE status = 'mapped' AND retrieved) AS g, count(*) FILTER (WHERE v = 'VALID') AS valid_code_count, count(*) FILTER (WHERE v = 'INVALID') AS invalid_code_count, count(*) FILTER (WHERE v = 'UNRESOLVED') AS unresolved_validation_count,
  avg(e2e)::DOUBLE AS mean_end_to_end_seconds, avg(llm)::DOUBLE AS mean_llm_seconds, sum(cost)::DOUBLE AS total_api_cost_usd, avg(cost)::DOUBLE AS mean_api_cost_per_row_usd, quantile_cont(e2e::DOUBLE, 0.5) AS median_end_to_end_seconds, quantile_cont(llm::DOUBLE, 0.5) AS median_llm_seconds FROM w GROUP BY mode),
cp AS (SELECT mode, top1::INT AS y, conf, rank() OVER (PARTITION BY mode ORDER BY conf) + (count(*) OVER (PARTITION BY mode, conf) - 1) / 2.0 AS rk FROM w WHERE status = 'mapped' AND conf IS NOT NULL),
cb AS (SELECT mode, count(*) AS n, abs(avg(y) - avg(conf)) AS gap FROM cp GROUP BY mode, least(floor(conf * 10), 9)), ce AS (SELECT mode, sum(gap * n) / sum(n) AS ece FROM cb GROUP BY mode),
ca AS (SELECT mode, count(*) AS calibration_n, avg(power(conf - y, 2)) AS brier_score, sum(y)::DOUBLE AS n1, count(*)::DOUBLE - sum(y)::DOUBLE AS n0, sum(rk) FILTER (WHERE y = 1)::DOUBLE AS r1,
  avg(conf) FILTER (WHERE y = 1) - avg(conf) FILTER (WHERE y = 0) AS apart, var_samp(conf) FILTER (WHERE y = 1) AS v1, var_samp(conf) FILTER (WHERE y = 0) AS v0 FROM cp GROUP BY mode),
cal AS (SELECT mode, calibration_n, brier_score, CASE WHEN n1 > 0 AND n0 > 0 THEN (r1 - n1 * (n1 + 1) / 2) / (n1 * n0) END AS roc_auc, ece,
  CASE WHEN n1 > 1 AND n0 > 1 THEN apart / nullif(sqrt(((n1 - 1) * v1 + (n0 - 1) * v0) / (n1 + n0 - 2)), 0) END AS cohens_d FROM ca JOIN ce USING (mode)),
ms AS (SELECT * EXCLUDE (g), n AS abstention_total, abstention_count / n AS abstention_rate, g / nullif(mapped_count, 0) AS grounding_rate, invalid_code_count / nullif(valid_code_count + invalid_code_count, 0) AS hallucination_rate,
  (valid_code_count + invalid_code_count) / nullif(mapped_count, 0) AS validation_coverage, unresolved_validation_count / nullif(mapped_count, 0) AS unresolved_validation_rate, execution_error_count / n AS execution_error_rate FROM a JOIN cal USING (mode))"""


def mode_rows(spark, d):
    p = score.scored(predictions(spark, d))
    i = F.col("id")
    outcome = F.when(F.col("status") != "mapped", "NOT_APPLICABLE").when(i % 5 == 0, "INVALID").when(i % 5 == 1, "UNRESOLVED").otherwise("VALID")
    confidence = F.when(i % 11 != 0, (i * 7 % 100 + F.when(F.col("top1"), 40).otherwise(0)) / 140.0)
    return p.select("mode", "status", confidence.alias("confidence"), F.col("top1").alias("semantic_correctness"), "top1", "top3", "top5", "rr", "recall", F.col("ranks")[0].alias("mapped_code"), (i % 3 == 0).alias("was_retrieved"), outcome.alias("validation_status"), (i % 97 / 10).alias("end_to_end_seconds"), F.when(i % 7 != 0, i % 50 / 20).alias("llm_seconds"), F.when(i % 5 != 0, i % 11 / 1000).alias("api_cost_usd"))


def mode_summaries(spark, d):
    return summaries.mode_summary(mode_rows(spark, d), ["mode"])


_ROUNDED = "top1_accuracy, top3_accuracy, top5_accuracy, mrr, recall_at_gt, abstention_rate, hallucination_rate, validation_coverage, grounding_rate, execution_error_rate, mean_end_to_end_seconds, mean_llm_seconds, mean_api_cost_per_row_usd, total_api_cost_usd, median_end_to_end_seconds, median_llm_seconds, unresolved_validation_rate, roc_auc, brier_score, ece, cohens_d".split(", ")


@query(f"WITH {_MODE} SELECT * REPLACE ({', '.join(f'round({c}, 6) AS {c}' for c in _ROUNDED)}) FROM ms")
def mode_summary(spark, d):
    return rounded(mode_summaries(spark, d))


@query(f"""WITH {_MODE}, u AS (UNPIVOT (SELECT mode, {', '.join(f'''CAST({c} AS DOUBLE) AS "{summaries.COMPARED[c]}"''' for c in _ROUNDED if c in summaries.COMPARED)} FROM ms) ON COLUMNS(* EXCLUDE (mode)) INTO NAME metric VALUE v)
SELECT metric, {', '.join(f'''round(max(v) FILTER (WHERE mode = '{m}'), 6) AS "{m}"''' for m in MODES)} FROM u GROUP BY metric""")
def comparison_table(spark, d):
    return rounded(summaries.comparison(mode_summaries(spark, d), MODES))


# what a run states: its summary with a difference within the tolerance, others beyond it, and a value left out
_OFF = {"mrr": ("1-URGENT", "mrr + 0.00001"), "roc_auc": ("2-HIGH", "roc_auc - 0.01"), "n": ("3-MEDIUM", "n + 1"), "ece": ("5-LOW", "NULL"), "brier_score": ("5-LOW", "brier_score * 1.0000001")}
_STATED = [*reconcile.COUNTS, *summaries.COMPARED]


@query(f"""WITH {_MODE}, st AS (SELECT mode, {', '.join(f"CASE WHEN mode = '{_OFF[c][0]}' THEN {_OFF[c][1]} ELSE {c} END AS {c}" if c in _OFF else c for c in _STATED)} FROM ms),
x AS (SELECT ms.mode, unnest([{', '.join(f"{{metric: '{c}', found: ms.{c}::DOUBLE, stated: st.{c}::DOUBLE}}" for c in _STATED)}], recursive := true) FROM ms JOIN st USING (mode))
SELECT mode, metric, round(found, 6) AS found, round(stated, 6) AS stated, true AS kept FROM x
WHERE (found IS NULL) <> (stated IS NULL) OR abs(found - stated) > greatest(1e-9, 1e-6 * greatest(abs(found), abs(stated)))""")
def reconcile_runs(spark, d):
    """A run whose summary states other values is refused, and the version before (kept) stays; the differences by name."""
    rows = written(mode_rows(spark, d))  # read for the summary, by two commits and for the count
    own = {r["mode"]: {c: r[c] for c in _STATED} for r in summaries.mode_summary(rows, ["mode"]).collect()}  # as many rows as modes
    run = VersionedTable(spark, new_path(spark))
    first = reconcile.commit(run, rows, own)
    stated = {m: dict(values) for m, values in own.items()}
    for metric, (m, _) in _OFF.items():
        v = stated[m][metric]
        stated[m][metric] = {"mrr": lambda x: x + 0.00001, "roc_auc": lambda x: x - 0.01, "n": lambda x: x + 1, "ece": lambda x: None, "brier_score": lambda x: x * 1.0000001}[metric](v)
    try:
        reconcile.commit(run, rows, stated)
        refused = []
    except reconcile.Refused as e:
        refused = e.problems
    kept = run.version() == first and run.read().count() == rows.count()
    held = [(m, c, *[None if x is None else float(x) for x in pair], kept) for m in own for c, pair in reconcile.differences(own[m], stated[m]).items()]
    named = [h for h in held if any(p.startswith(f"{h[0]}: {h[1]} is ") for p in refused)]
    return rounded(spark.createDataFrame(named, "mode string, metric string, found double, stated double, kept boolean"))


_MODEL = f"""{_RAW}, e AS (SELECT model, run, count(*)::DOUBLE AS n, count(*) FILTER (WHERE status = 'error')::DOUBLE AS bad, sum(CASE WHEN status = 'error' THEN 0 ELSE tp END)::DOUBLE AS tp, sum(CASE WHEN status = 'error' THEN 0 ELSE fp END)::DOUBLE AS fp,
  sum(CASE WHEN status = 'error' THEN 1 ELSE fn END)::DOUBLE AS fn, sum(cost) FILTER (WHERE status <> 'error')::DOUBLE AS cost, count(*) FILTER (WHERE status <> 'error') AS ok FROM x WHERE model <> '1-URGENT' OR status <> 'error' GROUP BY model, run),
f AS (SELECT *, CASE WHEN tp > 0 THEN 2 * tp / (2 * tp + fp + fn) ELSE 0 END AS f1 FROM e),
m AS (SELECT model, sum(cost) / sum(n) AS implied, sum(cost) / sum(ok) AS mean FROM f GROUP BY model)"""


@query(f"""WITH {_MODEL} SELECT model, run, 'error_count' AS problem, bad AS found, bad + 1 AS stated FROM f WHERE model = '2-HIGH' AND run = 1
UNION ALL SELECT model, run, 'not reported', NULL, NULL FROM f WHERE model = '5-LOW' AND run = 2
UNION ALL SELECT model, run, 'weighted_f1', round(f1, 6), round(f1 + 0.001, 6) FROM f WHERE run = 2 AND bad = 0 AND model <> '5-LOW'
UNION ALL SELECT model, NULL, 'mean_api_cost_per_term_usd', round(implied, 6), round(mean, 6) FROM m WHERE abs(implied - mean) > 1e-8 + 1e-6 * abs(mean)""")
def model_run_problems(spark, d):
    """One model without failed rows; of the reported runs one has a wrong number of errors, one is absent, and second runs have wrong scores."""
    rows = raw(spark, d).where("model <> '1-URGENT' OR mapped_status <> 'error'")
    reported = summaries.end_to_end(rows, ["model", "run_number"]).where("model <> '5-LOW' OR run_number <> 2")
    wrong = (F.col("model") == "2-HIGH") & (F.col("run_number") == 1)
    reported = reported.withColumn("error_count", F.col("execution_error_count") + wrong.cast("int")).withColumn("weighted_f1", F.col("weighted_f1") + F.when(F.col("run_number") == 2, 0.001).otherwise(0.0))
    ok = F.col("mapped_status") != "error"
    models = rows.groupBy("model").agg(F.sum(F.when(ok, F.col("api_cost_usd"))).alias("combined_api_cost_usd"), (F.sum(F.when(ok, F.col("api_cost_usd"))) / F.count_if(ok)).alias("mean_api_cost_per_term_usd"))
    return rounded(reconcile.model_problems(rows, reported, models))


_CATS = ["F", "O", "P"]


@query("""WITH t AS (SELECT o_orderstatus AS b, CASE o_orderkey % 3 WHEN 0 THEN 'F' WHEN 1 THEN 'O' ELSE o_orderstatus END AS a FROM orders), c AS (SELECT unnest(['F', 'O', 'P']) AS k)
SELECT x.k AS before, y.k AS after, (SELECT count(*) FROM t WHERE b = x.k AND a = y.k) AS count FROM c x, c y""")
def transition_matrix(spark, d):
    i = F.col("o_orderkey") % 3
    rows = table(spark, d, "orders").select(F.col("o_orderstatus").alias("b"), F.when(i == 0, "F").when(i == 1, "O").otherwise(F.col("o_orderstatus")).alias("a"))
    return summaries.transition_matrix(rows, "b", "a", _CATS)


@query(f"WITH {_PRED}, x AS (SELECT id, status, ranks AS a, CASE WHEN id % 3 = 0 THEN list_reverse(ranks) ELSE ranks END AS b, CASE WHEN id % 2 = 0 THEN 'error' ELSE status END AS st FROM g), y AS (SELECT CASE WHEN status = 'error' THEN ['E'] ELSE a END AS a, CASE WHEN st = 'error' THEN ['E'] ELSE b END AS b FROM x) SELECT count(*) AS n, round(avg((a[1] IS NOT DISTINCT FROM b[1])::INT), 6) AS top1_agreement, round(avg((list_sort(list_distinct(a)) = list_sort(list_distinct(b)))::INT), 6) AS top5_agreement FROM y")
def end_to_end_agreement(spark, d):
    p = predictions(spark, d).select("id", "status", "ranks")
    again = p.withColumn("ranks", F.when(F.col("id") % 3 == 0, F.reverse(F.array_compact("ranks"))).otherwise(F.col("ranks"))).withColumn("status", F.when(F.col("id") % 2 == 0, "error").otherwise(F.col("status")))
    return rounded(evaluate.end_to_end_agreement(p, again))


# --- patches ----------------------------------------------------------------------------------------------------------


@query(f"""WITH {_PRED}, q AS (SELECT DISTINCT l_orderkey AS id, 'P' || l_partkey AS code FROM lineitem), e AS (SELECT q.id, q.code, CASE WHEN g.id IS NULL THEN 'missing_prediction' ELSE g.status END AS status, list_min(list_filter(list_transform(range(1, 6), lambda i: CASE WHEN g.ranks[i] = q.code THEN i END), lambda i: i IS NOT NULL)) AS r FROM q LEFT JOIN g ON g.id = q.id AND g.id % 10 <> 0)
SELECT id AS query_id, code AS gold_code, status, CAST(r AS BIGINT) AS first_gold_rank, coalesce(r <= 1, false) AS top1_hit, coalesce(r <= 3, false) AS top3_hit, coalesce(r <= 5, false) AS top5_hit, round(coalesce(1.0 / r, 0)::DOUBLE, 6) AS reciprocal_rank FROM e""")
def pair_expansion(spark, d):
    p = predictions(spark, d).where("id % 10 <> 0").select(F.col("id").alias("query_id"), "ranks", "status")
    pairs = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("query_id"), F.concat(F.lit("P"), "l_partkey").alias("gold_code")).distinct()
    return rounded(patch.pair_expansion(pairs, p).drop("ranks"))


@query("SELECT o_orderkey AS query_id, o_totalprice AS price FROM orders WHERE o_orderstatus = 'O'")
def unmapped_subset(spark, d):
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("query_id"), F.col("o_totalprice").alias("price"), F.when(F.col("o_orderstatus") == "O", "unmapped").otherwise("mapped").alias("status"))
    return patch.unmapped_subset(o).drop("status")


@query(f"""WITH {_PRED}, n AS (SELECT id, ranks, gold, CASE WHEN id % 4 = 0 THEN list_append(gold, ranks[1]) ELSE gold END AS gold2 FROM g), k AS (SELECT *, list_min(list_filter(list_transform(range(1, 6), lambda i: CASE WHEN list_contains(gold2, ranks[i]) THEN i END), lambda i: i IS NOT NULL)) AS r FROM n)
SELECT id AS query_id, id % 4 = 0 AS affected, CAST(r AS BIGINT) AS gold_rank, coalesce(r <= 1, false) AS top1 FROM k""")
def gold_correction(spark, d):
    p = predictions(spark, d).withColumnRenamed("id", "query_id").withColumn("gold_labels", F.array().cast("array<string>"))
    new = F.when(F.col("query_id") % 4 == 0, F.array_append("gold", F.col("ranks")[0])).otherwise(F.col("gold"))
    canonical = p.select("query_id", new.alias("gold"), "gold_labels")
    return rounded(patch.gold_corrected(score.scored(p), canonical).select("query_id", "affected", "gold_rank", "top1"))


@query("SELECT count(*) AS base_rows, count(*) AS patched_rows, CAST(0 AS BIGINT) AS missing_ids, CAST(0 AS BIGINT) AS unexpected_ids, CAST(0 AS BIGINT) AS repeated_ids, count(*) FILTER (WHERE o_orderstatus = 'O' AND o_orderkey % 2 = 0) AS targeted, count(*) FILTER (WHERE o_orderkey % 1000 = 0) AS fixed_changes, count(*) FILTER (WHERE o_orderstatus = 'F' AND o_orderkey % 7 = 0) AS changes_outside, false AS passed FROM orders")
def patch_validation(spark, d):
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("query_id"), F.col("o_custkey").alias("query"), F.col("o_orderstatus").alias("code"))
    i = F.col("query_id")
    targeted = o.where((F.col("code") == "O") & (i % 2 == 0))
    new = o.withColumn("query", F.when(i % 1000 == 0, -1).otherwise(F.col("query"))).withColumn("code", F.when(((F.col("code") == "O") & (i % 2 == 0)) | ((F.col("code") == "F") & (i % 7 == 0)), "X").otherwise(F.col("code")))
    return patch.patch_validation(o, new, targeted, fixed=["query"], mapper=["code"])


@query(f"WITH {_PRED} SELECT mode, count(*) FILTER (WHERE status = 'unmapped') AS still_unmapped, count(*) FILTER (WHERE status = 'mapped') AS now_mapped, count(*) FILTER (WHERE status = 'error') AS now_error, count(*) AS total_rerun, count(*) FILTER (WHERE r = 1) AS gold_rank_1, count(*) FILTER (WHERE r = 2) AS gold_rank_2, count(*) FILTER (WHERE r = 3) AS gold_rank_3, count(*) FILTER (WHERE r = 4) AS gold_rank_4, count(*) FILTER (WHERE r = 5) AS gold_rank_5, count(*) FILTER (WHERE r IS NULL) AS gold_absent FROM g GROUP BY mode")
def patch_summary(spark, d):
    return patch.patch_summary(predictions(spark, d), ["mode"])


@query(f"WITH {_PRED}, x AS (SELECT id, ranks[1] AS c, top1 AS a, top5 AS b, status AS s, CASE WHEN id % 6 = 0 THEN NULL ELSE ranks[1] END AS c2, id % 5 <> 0 AND top1 AS a2, CASE WHEN id % 9 = 0 THEN 'unmapped' ELSE status END AS s2, id % 11 = 0 AS gone FROM s) SELECT count(*) AS sample_size, round(avg((NOT gone AND c IS NOT DISTINCT FROM c2)::INT), 6) AS code_agreement, round(avg((NOT gone AND a = a2)::INT), 6) AS top1_agreement, round(avg((NOT gone)::INT), 6) AS top5_agreement, count(*) FILTER (WHERE NOT gone AND s = 'mapped' AND s2 = 'unmapped') AS mapped_to_unmapped FROM x")
def stability_summary(spark, d):
    p = score.scored(predictions(spark, d)).select(F.col("id").alias("query_id"), F.col("ranks")[0].alias("mapped_code"), "top1", "top5", "status")
    i = F.col("query_id")
    again = p.withColumns({"mapped_code": F.when(i % 6 != 0, F.col("mapped_code")), "top1": (i % 5 != 0) & F.col("top1"), "status": F.when(i % 9 == 0, "unmapped").otherwise(F.col("status"))})
    return rounded(patch.stability(p.where(i % 11 != 0), again))


@query("SELECT o_orderkey AS query_id, '' AS reviewer_decision, '' AS reviewer_notes FROM orders WHERE o_orderstatus = 'P' AND o_totalprice > 100000")
def review_queue(spark, d):
    o = table(spark, d, "orders")
    return patch.review_queue(o.select(F.col("o_orderkey").alias("query_id"), "o_orderstatus", "o_totalprice"), (F.col("o_orderstatus") == "P") & (F.col("o_totalprice") > 100000)).drop("o_orderstatus", "o_totalprice")


# --- published tables -------------------------------------------------------------------------------------------------

_PUB = "m AS (SELECT * FROM (VALUES ('Top-1', 0), ('Top-3', 1), ('Top-5', 2), ('MRR', 3)) t(metric, i)), t AS (SELECT * FROM (VALUES ('alpha', 1), ('beta', 2)) t(tool, j)), b AS (SELECT r_name AS benchmark, tool, metric, round((r_regionkey + 1) * 0.1 + i * 0.05 + j * 0.02, 4) AS value, 100 * (r_regionkey + 1) AS denominator FROM region, m, t)"


def published(spark, d):
    one = table(spark, d, "region").withColumn("tool", F.explode(F.array(F.lit("alpha"), F.lit("beta")))).withColumn("j", F.when(F.col("tool") == "alpha", 1).otherwise(2))
    rows = one.select("*", F.posexplode(F.array(*[F.lit(m) for m in baselines.METRICS])).alias("i", "metric"))
    value = F.round((F.col("r_regionkey") + 1) * 0.1 + F.col("i") * 0.05 + F.col("j") * 0.02, 4)
    return rows.select(F.col("r_name").alias("benchmark"), "tool", "metric", value.alias("value"), (100 * (F.col("r_regionkey") + 1)).alias("denominator"))


@query(f"""WITH {_PUB}, w AS (SELECT benchmark, tool AS method, max(denominator) AS n, max(value) FILTER (WHERE metric = 'Top-1') AS top1, max(value) FILTER (WHERE metric = 'Top-3') AS top3, max(value) FILTER (WHERE metric = 'Top-5') AS top5, max(value) FILTER (WHERE metric = 'MRR') AS mrr FROM b GROUP BY benchmark, tool
  UNION ALL SELECT r_name, 'ours', 50, 0.5, 0.6, 0.75, 0.55 FROM region) SELECT benchmark, method, CAST(n AS BIGINT) AS n, round(top1::DOUBLE, 6) AS top1, round(top3::DOUBLE, 6) AS top3, round(top5::DOUBLE, 6) AS top5, round(mrr::DOUBLE, 6) AS mrr, round(top1::DOUBLE, 6) AS rank_1, round((top3 - top1)::DOUBLE, 6) AS rank_2_3, round((top5 - top3)::DOUBLE, 6) AS rank_4_5, round((1 - top5)::DOUBLE, 6) AS beyond FROM w""")
def all_methods(spark, d):
    names = [r[0] for r in table(spark, d, "region").select("r_name").collect()]
    own = table(spark, d, "region").select(F.col("r_name").alias("benchmark"), F.lit(50).cast("bigint").alias("n"), F.lit(0.5).alias("top1"), F.lit(0.6).alias("top3"), F.lit(0.75).alias("top5"), F.lit(0.55).alias("mrr"))
    return rounded(baselines.all_methods(own, baselines.checked(published(spark, d), benchmarks=names, tools=["alpha", "beta"])))


@query(f"WITH {_PUB}, o AS (SELECT 'Top-1' AS metric, 0.5 AS v UNION ALL SELECT 'F1', 0.25), p AS (SELECT metric, max(value) AS a FROM b WHERE benchmark = 'ASIA' AND tool = 'alpha' GROUP BY metric) SELECT coalesce(o.metric, p.metric) AS metric, CASE WHEN a IS NULL THEN 'unavailable' ELSE CAST(CAST(a AS DOUBLE) AS VARCHAR) END AS alpha, 'unavailable' AS gamma, CASE WHEN v IS NULL THEN 'unavailable' ELSE printf('%.4f', v::DOUBLE) END AS this_study FROM o FULL JOIN p ON o.metric = p.metric")
def published_comparison(spark, d):
    own = spark.createDataFrame([("Top-1", 0.5), ("F1", 0.25)], "metric string, value double")
    return baselines.side_by_side(own, published(spark, d), ["alpha", "gamma"], "ASIA")


@query(f"""WITH RECURSIVE {_REL}, k2 AS (SELECT st AS slice, CASE WHEN relationship = 'Not Applicable' THEN 'No Top-1 prediction' ELSE relationship END AS r FROM rel), kinds AS (SELECT unnest(['Same', 'More Specific', 'More General', 'Sibling', 'Unrelated', 'No Top-1 prediction']) AS r), t AS (SELECT slice, count(*) AS n, count(*) FILTER (WHERE r <> 'No Top-1 prediction') AS m FROM k2 GROUP BY slice)
SELECT t.slice, kinds.r AS relationship, count(k2.r) AS count, m AS mapped_n, n, CASE WHEN kinds.r <> 'No Top-1 prediction' THEN round(count(k2.r) / m, 6) END AS mapped_only_share, round(count(k2.r) / n, 6) AS end_to_end_share FROM t CROSS JOIN kinds LEFT JOIN k2 ON k2.slice = t.slice AND k2.r = kinds.r GROUP BY t.slice, kinds.r, m, n""")
def relationship_shares(spark, d):
    r = relations(spark, d).withColumn("slice", F.when(F.col("status") == "mapped", "F").when(F.col("status") == "unmapped", "O").otherwise("P"))
    return rounded(baselines.relationship_shares(r, by=["slice"]))


@query(f"WITH RECURSIVE {_REL}, t AS (SELECT relationship AS found, CASE WHEN id % 8 = 0 THEN 'Same' ELSE relationship END AS stated FROM rel) SELECT stated, found, count(*) AS count, round((SELECT avg((stated = found)::INT) FROM t), 6) AS agreement FROM t GROUP BY stated, found")
def reclassification(spark, d):
    r = relations(spark, d)
    return rounded(baselines.reclassified(r.withColumn("stated", F.when(F.col("id") % 8 == 0, "Same").otherwise(F.col("relationship"))), "stated", "relationship"))


@query("""WITH c AS (SELECT DISTINCT c_nationkey AS nation, CAST(regexp_extract(c_name, '[0-9]+') AS BIGINT) % 50 AS suffix FROM customer), s AS (SELECT DISTINCT s_nationkey AS nation, CAST(regexp_extract(s_name, '[0-9]+') AS BIGINT) % 50 AS suffix FROM supplier), j AS (SELECT c.nation AS a, s.nation AS b FROM c FULL JOIN s ON c.nation = s.nation AND c.suffix = s.suffix),
n AS (SELECT count(*) FILTER (WHERE a IS NOT NULL AND b IS NOT NULL) AS matched, count(*) FILTER (WHERE b IS NULL) AS ou, count(*) FILTER (WHERE a IS NULL) AS tu FROM j), r AS (SELECT *, matched / (matched + ou) AS ra, matched / (matched + tu) AS rb FROM n)
SELECT matched, CAST(0 AS BIGINT) AS ambiguous, ou AS ours_unmatched, tu AS theirs_unmatched, round(ra, 6) AS match_rate_ours, round(rb, 6) AS match_rate_theirs, CASE WHEN least(ra, rb) >= 0.95 THEN 'excellent' WHEN least(ra, rb) >= 0.9 THEN 'good' WHEN least(ra, rb) >= 0.75 THEN 'moderate' ELSE 'poor' END AS quality FROM r""")
def alignment_rates(spark, d):
    number = lambda c: F.regexp_extract(c, "[0-9]+", 0).cast("bigint") % 50
    side = lambda t, p: table(spark, d, t).select(F.col(f"{p}_nationkey").alias("nation"), number(f"{p}_name").alias("suffix"), F.lit("x").alias("result"))
    return rounded(baselines.alignment_rates(compare.aligned(side("customer", "c"), side("supplier", "s"), ["nation", "suffix"])))


# --- plans, contracts, decisions --------------------------------------------------------------------------------------

_REPLIES = [
    '{"normalized_term": " T ", "expanded_queries": ["a", " ", " b "], "candidate_ontologies": ["hp", "mondo", "hp"], "preferred_ontology": "hp", "confidence": 1.7}',
    '{"expanded_queries": ["a"], "candidate_ontologies": ["hp", "mondo"], "preferred_ontology": "hp", "confidence": "0.5"}',
    '{"expanded_queries": ["a"], "candidate_ontologies": ["hp"], "preferred_ontology": "hp", "confidence": -3}',
    '```json\n{"expanded_queries": "one", "confidence": null}\n```',
    "no json",
    '{"confidence": "x", "candidate_ontologies": "efo", "reasoning": ""}',
]


@query("""SELECT k, CASE k % 6 WHEN 4 THEN NULL WHEN 0 THEN 'T' ELSE 'term ' || k END AS term, CASE k % 6 WHEN 0 THEN 'a|b' WHEN 1 THEN 'a' WHEN 2 THEN 'a' WHEN 3 THEN 'one' WHEN 5 THEN n END AS queries,
  CASE k % 6 WHEN 0 THEN 'HP|MONDO' WHEN 1 THEN 'MONDO' WHEN 2 THEN 'LOINC' WHEN 3 THEN '' WHEN 5 THEN 'HP|LOINC' END AS ontologies, CASE k % 6 WHEN 0 THEN 'HP' WHEN 1 THEN 'MONDO' WHEN 2 THEN 'LOINC' END AS preferred,
  CASE k % 6 WHEN 0 THEN 1.0 WHEN 1 THEN 0.5 WHEN 4 THEN NULL ELSE 0.0 END::DOUBLE AS confidence FROM (SELECT p_partkey AS k, p_name AS n FROM part)""")
def plan_replies(spark, d):
    k = F.col("p_partkey")
    none = F.lit(None).cast("array<string>")
    allowed = F.when(k % 6 == 1, F.array(F.lit("mondo"))).when(k % 6 == 5, F.array(F.lit("HP"), F.lit(" loinc "), F.lit("hp"))).otherwise(none)
    reply = F.element_at(F.array(*[F.lit(r) for r in _REPLIES]), (k % 6 + 1).cast("int"))
    plan = planning.plan_of(reply, F.concat(F.lit(" term "), k), F.col("p_name"), F.when(k % 6 == 2, "loinc"), allowed)
    p = table(spark, d, "part").select(k.alias("k"), plan.alias("p"))
    return p.select("k", F.col("p.normalized_term").alias("term"), F.array_join("p.queries", "|").alias("queries"), F.array_join("p.ontologies", "|").alias("ontologies"), "p.preferred", "p.confidence")


@query("""SELECT k, CASE k % 4 WHEN 0 THEN 'HP:' || k WHEN 1 THEN 'HP:' || k WHEN 2 THEN 'MONDO:' || k ELSE '' END AS code, CASE WHEN k % 4 = 3 THEN 'blank code|code of another vocabulary' WHEN k % 4 = 2 THEN 'code of another vocabulary' ELSE '' END || CASE WHEN k % 5 = 0 THEN CASE WHEN k % 4 < 2 THEN '' ELSE '|' END || 'confidence' ELSE '' END || CASE WHEN k % 7 = 0 THEN CASE WHEN k % 4 < 2 AND k % 5 <> 0 THEN '' ELSE '|' END || 'alternative' ELSE '' END AS broken FROM (SELECT p_partkey AS k FROM part)""")
def result_contracts(spark, d):
    k = F.col("p_partkey")
    text = k.cast("string")
    code = F.when(k % 4 == 0, text).when(k % 4 == 1, F.concat(F.lit(" HP:"), text)).when(k % 4 == 2, F.concat(F.lit("MONDO:"), text)).otherwise(" ")
    other = F.struct(F.when(k % 7 == 0, "MONDO:1").otherwise("HP:1").alias("code"), F.lit("HPO").alias("ontology"), F.lit(0.5).alias("confidence"))
    rows = table(spark, d, "part").select(k.alias("k"), code.alias("target_code"), F.lit(" hpo ").alias("ontology"), F.when(k % 5 == 0, 1.5).otherwise(0.5).alias("confidence"), F.array(other).alias("alternatives"))
    return contracts.results(rows).select("k", F.when(F.col("k") % 4 != 3, F.col("target_code")).otherwise("").alias("code"), F.array_join("violations", "|").alias("broken"))


@query("""WITH t AS (SELECT k, k % 2 = 0 AS grounded, CASE WHEN k % 3 = 0 THEN 'disabled' ELSE 'public' END AS mode FROM (SELECT p_partkey AS k FROM part)), b AS (SELECT mode = 'disabled' AND grounded AS x, mode = 'disabled' AND k % 5 = 0 AS y, mode = 'public' AND NOT grounded AND k % 7 <> 0 AS z FROM t)
SELECT rule, CAST(n AS BIGINT) AS rows FROM (SELECT 'grounded without retrieval' AS rule, count(*) FILTER (WHERE x) AS n FROM b UNION ALL SELECT 'grounding source without retrieval', count(*) FILTER (WHERE y) FROM b UNION ALL SELECT 'ungrounded production', count(*) FILTER (WHERE z) FROM b) WHERE n > 0""")
def decision_contracts(spark, d):
    k = F.col("k")
    p = table(spark, d, "part").select(F.col("p_partkey").alias("k"))
    rows = p.select((k % 2 == 0).alias("is_grounded"), F.when(k % 3 == 0, "disabled").otherwise("public").alias("retrieval_mode"), F.when((k % 3 != 0) | (k % 5 == 0), "public_api").otherwise("none").alias("grounding_source"), F.lit(False).alias("is_unmapped"), F.lit(0.5).alias("confidence"), F.when(k % 7 == 0, "research_debug").otherwise("production_grounded").alias("policy"), F.lit(None).cast("array<struct<code: string, explanation: string>>").alias("alternatives"))
    return contracts.refused(contracts.decisions(rows))


@query("""WITH a AS (SELECT user_id AS r, event_type AS c, event_id AS i, CASE WHEN event_id % 3 = 0 THEN '' ELSE 'n' || event_id END AS n, event_id % 4 = 0 AS pref, CASE WHEN event_id % 5 = 0 THEN NULL ELSE floor(value) END AS rk FROM events),
g AS (SELECT r, c, coalesce(min(CASE WHEN n <> '' AND pref THEN i END), min(CASE WHEN n <> '' THEN i END)) AS named, min(i) AS o, coalesce(min(rk), 0) AS rk FROM a GROUP BY r, c), s AS (SELECT *, row_number() OVER (PARTITION BY r ORDER BY 1.0 / (1 + rk) DESC, o) AS place FROM g WHERE named IS NOT NULL)
SELECT r AS request_id, 'RXNORM:' || c AS code, 'n' || named AS term, round((1.0 / (1 + rk))::DOUBLE, 6) AS score, place FROM s WHERE place <= 3""")
def concept_candidates(spark, d):
    i = F.col("event_id")
    e = table(spark, d, "events").select(F.col("user_id").alias("request_id"), i.alias("ord"), F.col("event_type").alias("concept"), F.when(i % 3 == 0, " ").otherwise(F.concat(F.lit("n"), i.cast("string"))).alias("name"), F.when(i % 4 == 0, "RXNORM").otherwise("GS").alias("source"), F.when(i % 5 == 0, "none").otherwise(F.floor("value").cast("string")).alias("rank"))
    return rounded(retrieve.concepts(e, 3).drop("ord"))


@query("""SELECT event_id AS id, CASE event_id % 6 WHEN 0 THEN 'local_retrieval' WHEN 1 THEN 'query_planner' WHEN 2 THEN 'reranker' WHEN 3 THEN 'pipeline' ELSE 'unknown' END AS stage,
  CASE event_id % 6 WHEN 0 THEN 'PlannedPipelineError: LLMReranker failed <- LocalRetrievalError: down' WHEN 1 THEN 'PlannedPipelineError: x <- QueryPlanningError' WHEN 2 THEN 'PlannedPipelineError: LLMReranker failed: y' WHEN 3 THEN 'PlannedPipelineError: other' WHEN 4 THEN 'KeyError: z' ELSE '' END AS text FROM events""")
def error_stages(spark, d):
    chains = [[("PlannedPipelineError", "LLMReranker failed"), ("LocalRetrievalError", "down")], [("PlannedPipelineError", "x"), ("QueryPlanningError", " ")], [("PlannedPipelineError", "LLMReranker failed: y")], [("PlannedPipelineError", "other")], [("KeyError", "z")], []]
    kind = "array<struct<type: string, message: string>>"
    made = F.array(*[F.array(*[F.struct(F.lit(t).alias("type"), F.lit(m).alias("message")) for t, m in c]).cast(kind) for c in chains])
    e = table(spark, d, "events").select(F.col("event_id").alias("id"), F.element_at(made, (F.col("event_id") % 6 + 1).cast("int")).alias("chain"))
    return e.select("id", errors.error_stage(F.col("chain")).alias("stage"), errors.chain_text(F.col("chain")).alias("text"))


def decided(spark, d):
    li = table(spark, d, "lineitem")
    code = F.concat_ws(":", F.lit("P"), "l_linenumber", "l_partkey", "l_suppkey")
    per = li.groupBy(F.col("l_orderkey").alias("request_id")).agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", code.alias("code"), F.col("l_discount").alias("normalized_score")))).alias("x"))
    held = F.transform("x", lambda x: F.struct(x.code.alias("code"), F.lit("P").alias("ontology"), F.lit(1.0).alias("raw_score"), x.normalized_score.alias("normalized_score")))
    alternative = lambda c, score: F.struct(c.alias("code"), F.lit(score).alias("confidence"), F.lit(None).cast("string").alias("explanation"))
    others = F.concat(F.transform(F.slice("x", 2, 2), lambda x: alternative(x.code, 0.4)), F.array(alternative(F.lit("none"), 0.1)))
    return per.select("request_id", held.alias("candidates"), F.struct(F.col("x")[0].code.alias("selected_code"), F.lit(0.9).alias("confidence"), others.alias("alternatives")).alias("decision"))


@query("""WITH l AS (SELECT l_orderkey AS id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) AS k, 'P:' || l_linenumber || ':' || l_partkey || ':' || l_suppkey AS code, l_discount AS s FROM lineitem)
SELECT id AS request_id, k AS rank, code, k = 1 AS selected, round(s, 6) AS normalized_score FROM l WHERE k <= 3""")
def ranking_trace(spark, d):
    return rounded(decide.ranking_trace(decided(spark, d)).select("request_id", "rank", "code", "selected", "normalized_score"))


_PAYLOAD = """l AS (SELECT l_orderkey AS id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) AS k, 'P:' || l_linenumber || ':' || l_partkey || ':' || l_suppkey AS code FROM lineitem)"""


@query(f"WITH {_PAYLOAD} SELECT id AS request_id, k AS rank, code, 'P' AS ontology, CASE k WHEN 1 THEN 0.9 ELSE 0.4 END::DOUBLE AS final_confidence FROM l WHERE k <= 3")
def payload_trace(spark, d):
    """Traces packed into payloads and read back from them."""
    return rounded(payload.trace(payload.packed(decided(spark, d)), ["request_id"]))


@query(f"""WITH {_PAYLOAD}, c AS (SELECT id, count(*) AS n FROM l GROUP BY id)
SELECT id AS request_id, id % 7 <> 2 AS readable, CASE WHEN id % 7 <> 2 THEN id % 7 IN (0, 1, 3) END AS is_grounded, CASE WHEN id % 7 <> 2 THEN CASE WHEN id % 7 IN (0, 1, 3) THEN 'public_api' ELSE 'none' END END AS grounding_source,
  CASE WHEN id % 7 <> 2 THEN id % 7 IN (1, 5) END AS retrieval_skipped, CASE WHEN id % 7 <> 2 THEN CASE WHEN id % 7 IN (0, 1, 3) THEN n ELSE 0 END END AS candidate_count, CASE WHEN id % 7 <> 2 THEN id % 7 IN (0, 3) END AS selected_code_was_retrieved,
  CASE WHEN id % 7 IN (0, 1) THEN n END AS retries, CASE WHEN id % 7 IN (0, 1, 3) AND id % 3 = 0 THEN n END AS tokens FROM c""")
def payload_evidence(spark, d):
    """Payloads of several shapes as text (whole ones; cut ones; without a record; disabled, with the flag beside the others; of other types) and what is read from them."""
    i = F.col("request_id") % 7
    rows = decided(spark, d)
    n = F.size("candidates")
    rows = rows.withColumns({
        "is_grounded": F.lit(True), "grounding_source": F.lit("public_api"), "retrieval_trace": F.struct((i == 1).alias("retrieval_skipped")), "pipeline_timings": F.create_map(F.lit("total"), n * 1.5),
        "pipeline_usage": F.when(F.col("request_id") % 3 == 0, F.create_map(F.lit("tokens"), n)).otherwise(F.create_map().cast("map<string,int>")),
        "retrieval_diagnostics": F.struct(F.when(i == 3, 0).otherwise(n).alias("retrieval_request_count"), n.alias("retrieval_retry_count")),
    })
    rows = payload.texts(rows).withColumnRenamed("payload", "whole")
    text = (
        F.when(i == 2, F.left("whole", F.length("whole") - 1)).when(i == 4, F.lit('{"rag_debug": null}')).when(i == 5, F.lit('{"rag_debug": {"candidates_retrieved": [{"is_grounded": false, "retrieval_skipped": true}]}}'))
        .when(i == 6, F.lit('{"rag_debug": {"candidates_retrieved": [{"is_grounded": "who knows", "grounding_source": "", "candidate_score_provenance": [5, "x", {"code": ""}, {"code": null}]}]}}')).otherwise(F.col("whole"))
    )
    rows = rows.select("request_id", payload.parsed(text).alias("payload"), F.when(F.col("request_id") % 7 != 1, F.col("decision.selected_code")).alias("code"))
    e = payload.evidence(F.col("payload"), F.col("code"))
    out = rows.select("request_id", F.col("payload").isNotNull().alias("readable"), e.alias("e"), payload.at(F.col("payload"), "$.rag_debug.retrieval_diagnostics.retrieval_retry_count", "bigint").alias("retries"), payload.at(F.col("payload"), "$.rag_debug.pipeline_usage.tokens", "bigint").alias("tokens"))
    return rounded(out.select("request_id", "readable", "e.is_grounded", "e.grounding_source", "e.retrieval_skipped", "e.candidate_count", "e.selected_code_was_retrieved", "retries", "tokens"))


@query("SELECT l_orderkey AS query, min(l_linenumber)::BIGINT AS line FROM lineitem GROUP BY l_orderkey")
def first_rows(spark, d):
    li = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("query"), F.col("l_linenumber").alias("line"), (F.col("l_linenumber") * 100000000 + F.col("l_partkey")).alias("ord"))
    return rounded(audit.first_rows(li, ["query"], "ord").select("query", "line"))


@query("SELECT CASE p_partkey % 3 WHEN 0 THEN 'HP' WHEN 1 THEN 'MONDO' ELSE 'NONE' END AS prefix, count(*) AS rows FROM part GROUP BY 1")
def gold_prefixes(spark, d):
    k = F.col("p_partkey")
    code = F.when(k % 3 == 0, F.concat(F.lit("hp_"), k.cast("string"))).when(k % 3 == 1, F.concat(F.lit("MONDO:"), k.cast("string"))).otherwise(k.cast("string"))
    return audit.prefixes(table(spark, d, "part").select(code.alias("code")))


@query("SELECT o_orderkey AS id, round(o_custkey / 1e6 * CASE o_orderpriority WHEN '1-URGENT' THEN 1 WHEN '2-HIGH' THEN 2 ELSE 3 END, 8) AS usd FROM orders")
def priced_rows(spark, d):
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("model"), F.col("o_custkey").alias("tokens"))
    prices = o.select("model").distinct().select("model", F.when(F.col("model") == "1-URGENT", 1.0).when(F.col("model") == "2-HIGH", 2.0).otherwise(3.0).alias("price_in"), F.lit(0.5).alias("price_cached"), F.lit(8.0).alias("price_out"))
    none = F.lit(None).cast("bigint")
    return N.priced(o, prices).select("id", F.round(N.cost(F.col("tokens"), none, none, F.col("price_in"), F.col("price_cached"), F.col("price_out")), 8).alias("usd"))


@query("SELECT 'P:' || p_partkey AS code FROM part WHERE p_partkey <= (SELECT max(p_partkey) FROM part)")
def known_codes(spark, d):
    p = table(spark, d, "part")
    e = p.select(F.concat(F.lit("P:"), "p_partkey").alias("subject"), F.lit("top").alias("object"))
    asked = p.select(F.concat(F.lit("P:"), "p_partkey").alias("code")).unionByName(p.select(F.concat(F.lit("Q:"), "p_partkey").alias("code")))
    return hierarchy.known(asked, e)


@query("SELECT o_orderkey AS id FROM orders WHERE o_orderkey % 9 = 0")
def rerun_strays(spark, d):
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("id"))
    return runs.strays(o.where("id % 9 <> 0"), o, "id")


# --- mapping without lookups ------------------------------------------------------------------------------------------

# A model's reply from a part: the vocabulary it names, its code, its confidence, and what the caller allows.
_REPLIED = """k % 4 AS asks, CASE k % 5 WHEN 0 THEN 'HP' WHEN 1 THEN 'hpo' WHEN 2 THEN 'LOINC' WHEN 3 THEN 'Mondo' ELSE '' END AS named,
  CASE k % 5 WHEN 0 THEN 'HP:' WHEN 1 THEN '' WHEN 2 THEN CASE WHEN k % 7 = 0 THEN 'HP:' ELSE 'LOINC:' END WHEN 3 THEN 'MONDO_' ELSE 'X:' END || k || CASE k % 5 WHEN 2 THEN '-1' ELSE '' END AS code, s % 6 / 4.0 AS sure, k, name"""


@query(f"""
WITH p AS (SELECT {_REPLIED} FROM (SELECT p_partkey AS k, p_size AS s, p_name AS name FROM part)),
q AS (SELECT *, CASE WHEN named IN ('HP', 'hpo') THEN 'HPO' ELSE upper(named) END AS key, CASE asks WHEN 1 THEN 'HPO' WHEN 2 THEN 'LOINC' END AS target FROM p),
r AS (SELECT *, CASE WHEN k % 11 = 0 THEN 'the reply is no JSON object' WHEN sure > 1 THEN 'confidence outside [0, 1]' WHEN key = '' THEN NULL WHEN target <> key THEN 'vocabulary outside the target'
    WHEN k % 5 = 2 AND k % 7 = 0 AND asks <> 3 THEN 'code of another vocabulary' END AS error FROM q),
t AS (SELECT *, CASE WHEN error IS NOT NULL THEN 'error' WHEN key = '' OR (asks = 3 AND key NOT IN ('HPO', 'MONDO')) THEN 'unmapped' ELSE 'mapped' END AS status FROM r),
a AS (SELECT *, list_filter([
    {{'c': 'HP:' || (k + 1), 'v': 'HPO', 's': 0.2}}, {{'c': 'LOINC:' || k || '-1', 'v': 'LOINC', 's': 0.9}}, {{'c': 'HP:' || k, 'v': 'HPO', 's': 0.0}}, {{'c': 'MONDO:' || k, 'v': 'MONDO', 's': 0.25}}],
    lambda x: x.s <= sure AND (target IS NULL OR x.v = target) AND (asks <> 3 OR x.v IN ('HPO', 'MONDO')) AND NOT (x.v = key AND x.c = CASE key WHEN 'HPO' THEN 'HP:' ELSE key || ':' END || k || CASE key WHEN 'LOINC' THEN '-1' ELSE '' END)) AS kept FROM t)
SELECT k, status, CASE status WHEN 'mapped' THEN CASE key WHEN 'HPO' THEN 'HP:' ELSE key || ':' END || k || CASE key WHEN 'LOINC' THEN '-1' ELSE '' END WHEN 'unmapped' THEN 'UNKNOWN:UNMAPPED' END AS target_code,
  CASE status WHEN 'mapped' THEN upper(named) WHEN 'unmapped' THEN 'UNKNOWN' END AS ontology, CASE WHEN status <> 'error' THEN CAST(sure AS DOUBLE) END AS confidence, error,
  CASE WHEN status = 'mapped' THEN coalesce(array_to_string(list_transform(list_sort(list_transform(kept, lambda x, i: {{'o': -x.s, 'i': i, 'c': x.c}})), lambda x: x.c), ','), '') ELSE '' END AS others
FROM a
""")
def disabled_mapping(spark, d):
    """Replies of a model without lookups, held against a target (1 and 2) or an allow-list (3)."""
    rows = table(spark, d, "part").selectExpr("p_partkey AS k", "p_size AS s", "p_name AS name").selectExpr(*_REPLIED.split(","))
    item = lambda code, named, sure: F.struct(F.concat(F.lit(code), F.col("k").cast("string"), F.lit("-1" if named == "LOINC" else "")).alias("code"), F.lit("t").alias("term"), F.lit(named).alias("ontology"), F.lit(sure).alias("confidence"))
    first = F.struct((F.col("k") + 1).cast("string").alias("code"), F.lit("t").alias("term"), F.lit("hpo").alias("ontology"), F.lit(0.2).alias("confidence"))
    again = F.struct(F.concat(F.lit("HPO:"), (F.col("k") + 1).cast("string")).alias("code"), F.lit("u").alias("term"), F.lit("HP").alias("ontology"), F.lit(0.1).alias("confidence"))
    listed = F.array(first, again, item("LOINC:", "LOINC", 0.9), item("hp_", "HP", 0.0), item("MONDO:", "MONDO", 0.25), item("MONDO:", "HP", 0.0))
    reply = F.to_json(F.struct(F.col("code").alias("target_code"), F.col("name").alias("target_term"), F.col("named").alias("ontology"), F.col("sure").cast("double").alias("confidence"), listed.alias("alternatives")))
    reply = F.when(F.col("k") % 11 == 0, F.lit("I can't say")).when(F.col("k") % 2 == 0, F.concat(F.lit("```json\n"), reply, F.lit("\n```"))).otherwise(reply)
    target = F.when(F.col("asks") == 1, "hp").when(F.col("asks") == 2, "LOINC")
    allowed = F.when(F.col("asks") == 3, F.array(F.lit(" hp"), F.lit("MONDO")))
    got = disabled.results(rows.select(F.col("k").alias("request_id"), target.alias("target"), allowed.alias("allowed"), reply.alias("reply"), F.lit(None).cast("string").alias("error")))
    others = F.array_join(F.transform("alternatives", lambda a: a.code), ",")
    return rounded(got.select(F.col("request_id").alias("k"), "status", "target_code", "ontology", "confidence", "error", others.alias("others")))


# --- versions ---------------------------------------------------------------------------------------------------------


@query("SELECT o_orderkey AS id, CASE WHEN o_orderkey % 3 = 0 THEN 'again' ELSE o_orderstatus END AS status, CASE WHEN o_orderkey % 3 = 0 THEN o_totalprice + 1 ELSE o_totalprice END AS price FROM orders WHERE o_orderkey % 3 = 0 OR o_orderstatus <> 'P'")
def versioned_results(spark, d):
    """A first version of finished rows, then a batch of reruns in their place, which comes twice and counts once."""
    rows = table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("status"), F.col("o_totalprice").alias("price"))
    to = VersionedTable(spark, new_path(spark))
    to.overwrite(rows.where("status <> 'P'"))
    again = rows.where("id % 3 = 0").select("id", F.lit("again").alias("status"), (F.col("price") + 1).alias("price"))
    one = to.each_batch("reruns", lambda held, batch, options: held.upsert(batch, "id", **options))
    one(again, 0)
    one(again, 0)
    return rounded(to.read())
