"""Summaries of runs, models and modes: one row of aggregates a group, and tables that set them side by side."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.gold import prf
from ..functions.numbers import rate
from .ordering import percentiles
from .store import written

# How a mapping came about, and the metrics that modes are compared by, with their labels.
LOGIC = ("direct", "rag", "hybrid", "llm")
COMPARED = {
    "top1_accuracy": "Top-1", "top3_accuracy": "Top-3", "top5_accuracy": "Top-5", "mrr": "MRR", "recall_at_gt": "Recall@GT", "abstention_rate": "Abstention",
    "hallucination_rate": "Hallucination", "validation_coverage": "Validation coverage", "grounding_rate": "Grounding", "roc_auc": "AUC", "brier_score": "Brier", "ece": "ECE",
    "cohens_d": "Cohen's d", "execution_error_rate": "Execution error rate", "mean_end_to_end_seconds": "Mean E2E latency", "mean_llm_seconds": "Mean LLM latency",
    "mean_api_cost_per_row_usd": "Cost / row", "total_api_cost_usd": "Total cost",
}


def beside(left: DataFrame, right: DataFrame, by: list[str]) -> DataFrame:
    """left with right's other columns, by equal groups; two null groups are equal."""
    if not by:
        return left.crossJoin(F.broadcast(right))  # a row each
    named = right.select(*[F.col(c).alias(f"_{c}") for c in by], *[c for c in right.columns if c not in by])
    same = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in by])
    return left.join(named, same, "left").drop(*[f"_{c}" for c in by])


def zero(c: Column) -> Column:
    return F.coalesce(c, F.lit(0.0))


def execution(rows: DataFrame, by: list[str] | None = None, *, status: str = "status") -> DataFrame:
    """Rows by status, and the share of failed ones."""
    out = rows.groupBy(*(by or [])).agg(F.count("*").alias("rows"), *[F.count_if(F.col(status) == s).alias(s) for s in ("mapped", "unmapped", "error")])
    return out.withColumn("error_rate", rate(F.col("error"), F.col("rows"), empty=0.0))


def namespaces(rows: DataFrame, ontology: str) -> DataFrame:
    """How often each vocabulary comes, NONE for rows without one, and its share of all rows."""
    counts = rows.groupBy(F.coalesce(ontology, F.lit("NONE")).alias("namespace")).agg(F.count("*").alias("count"))
    total = counts.agg(F.sum("count").alias("_total"))
    return counts.crossJoin(F.broadcast(total)).select("namespace", "count", rate(F.col("count"), F.col("_total"), empty=0.0).alias("share"))


def retrieval(rows: DataFrame, by: list[str] | None = None, *, requests: str = "requests", retries: str = "retries", recovered: str = "recovered", final: str = "final", source: str = "source") -> DataFrame:
    """Sums of requests, retries, errors that a retry mended and final ones, the rows with any, and the sources of final errors in order of
    appearance by name, ten at most as the reports show them."""
    n = lambda c: F.coalesce(F.sum(c), F.lit(0)).alias(c)
    some = lambda c, name: F.count_if(F.coalesce(F.col(c), F.lit(0)) > 0).alias(name)
    bad = F.array_sort(F.collect_set(F.when(F.coalesce(F.col(final), F.lit(0)) > 0, F.col(source))))
    return rows.groupBy(*(by or [])).agg(
        F.count("*").alias("rows"), n(requests), n(retries), n(recovered), n(final), some(retries, "rows_with_retries"), some(recovered, "rows_with_recovered_errors"), some(final, "rows_with_final_errors"),
        F.slice(bad, 1, 10).alias("error_sources"),
    )


def usage(calls: DataFrame, by: list[str], *, order: str, model: str = "model", tokens: tuple[str, ...] = ("input_tokens", "output_tokens")) -> DataFrame:
    """Calls, summed tokens (null if none is known) and the last model that is known, by order."""
    last = F.max_by(model, F.when(F.col(model).isNotNull(), F.col(order)))
    return calls.groupBy(*by).agg(F.count("*").alias("calls"), *[F.sum(t).alias(t) for t in tokens], last.alias(model))


def run_summary(rows: DataFrame, by: list[str] | None = None) -> DataFrame:
    """rows: a model benchmark's (mapped_status, tp, fp, fn, tn, top1_correct, top5_hit, logic_type, end_to_end_seconds, llm_seconds,
    retrieval_seconds, total_*_tokens, api_cost_usd, retrieval_retry_count, retrieval_final_error_count). A row a run: failed rows count
    for latency and retries only."""
    by = by or []
    ok = F.col("mapped_status") != "error"
    of = lambda c: F.when(ok, F.col(c))
    some = lambda c: F.count_if(F.coalesce(F.col(c), F.lit(0)) > 0)
    tokens = [f"total_{k}tokens" for k in ("input_", "cached_input_", "output_", "reasoning_")]
    out = rows.groupBy(*by).agg(
        F.count("*").alias("rows_total"), F.count_if(ok).alias("rows_evaluated"), F.count_if(~ok).alias("error_count"),
        *[zero(F.sum(of(c))).alias(f"{c}_total") for c in ("tp", "fp", "fn", "tn")],
        F.count_if(ok & F.col("top1_correct")).alias("top1_correct_count"), F.count_if(ok & F.col("top5_hit")).alias("top5_hit_count"),
        *[F.count_if(F.col("mapped_status") == s).alias(f"{s}_count") for s in ("mapped", "unmapped")],
        *[F.count_if(ok & (F.col("logic_type") == s)).alias(f"{s}_count") for s in LOGIC],
        zero(F.avg("end_to_end_seconds")).alias("mean_end_to_end_seconds_per_term"),
        zero(F.sum(of("llm_seconds"))).alias("total_llm_seconds"), zero(F.avg(of("llm_seconds"))).alias("mean_llm_seconds_per_term"), zero(F.sum(of("retrieval_seconds"))).alias("total_retrieval_seconds"),
        *[F.sum(of(t)).alias(t) for t in tokens], F.sum(of("api_cost_usd")).alias("total_api_cost_usd"),
        F.coalesce(F.sum("retrieval_retry_count"), F.lit(0)).alias("total_retrieval_retries"), some("retrieval_retry_count").alias("rows_with_retrieval_retries"), some("retrieval_final_error_count").alias("rows_with_final_retrieval_errors"),
    )
    n = F.col("rows_evaluated")
    p, r, f1 = prf(F.col("tp_total"), F.col("fp_total"), F.col("fn_total"))
    out = out.select(
        "*", p.alias("weighted_precision"), r.alias("weighted_recall"), f1.alias("weighted_f1"), rate(F.col("top1_correct_count"), n, empty=0.0).alias("top1_accuracy"),
        rate(F.col("top5_hit_count"), n, empty=0.0).alias("top5_hit_rate"), rate(F.col("total_api_cost_usd"), n).alias("mean_api_cost_per_term_usd"),
    )
    for column, source in (("end_to_end_seconds", rows), ("llm_seconds", rows.where(ok))):
        names = {f"median_{column}_per_term": 0.5, f"p95_{column}_per_term": 0.95}
        out = beside(out, percentiles(source, column, names, by), by)
        out = out.withColumns({name: zero(F.col(name)) for name in names})
    return out


def model_summary(runs: DataFrame, agreement: DataFrame, *, model: str = "model", run: str = "run_number") -> DataFrame:
    """runs: summaries of runs with run_complete and total_run_seconds; agreement: model, top1_agreement and top5_agreement. A row a model:
    means over its runs, both runs' scores and their distance."""
    mean = ("weighted_precision", "weighted_recall", "weighted_f1", "top1_accuracy", "top5_hit_rate", "total_run_seconds", "mean_end_to_end_seconds_per_term", "mean_llm_seconds_per_term")
    name = lambda c: c if c.startswith("mean_") else f"mean_{c}"
    scores = {"weighted_f1": "weighted_f1", "top1_accuracy": "top1", "top5_hit_rate": "top5"}
    of = lambda c, k: F.max(F.when(F.col(run) == k, F.col(c)))
    out = runs.groupBy(model).agg(
        F.count_if("run_complete").alias("runs_completed"), *[F.avg(c).alias(name(c)) for c in mean], F.sum("total_api_cost_usd").alias("combined_api_cost_usd"), F.sum("rows_evaluated").alias("_n"),
        *[of(c, k).alias(f"run_{k}_{c}") for c in scores for k in (1, 2)], *[F.abs(of(c, 1) - of(c, 2)).alias(f"{short}_absolute_difference") for c, short in scores.items()],
        *[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("total_retrieval_retries", "rows_with_retrieval_retries", "rows_with_final_retrieval_errors")],
    )
    out = out.withColumn("mean_api_cost_per_term_usd", rate(F.col("combined_api_cost_usd"), F.col("_n"))).drop("_n")
    return beside(out, agreement, [model])


def end_to_end(rows: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Weighted scores over all rows of a model benchmark, a failed one as a miss."""
    bad = F.col("mapped_status") == "error"
    part = {"tp": 0.0, "fp": 0.0, "fn": 1.0}
    out = rows.groupBy(*(by or [])).agg(
        F.count("*").alias("n"), *[zero(F.sum(F.when(bad, v).otherwise(F.col(c)))).alias(c) for c, v in part.items()],
        *[zero(F.avg((~bad & F.coalesce(c, F.lit(False))).cast("double"))).alias(name) for c, name in (("top1_correct", "top1_accuracy"), ("top5_hit", "top5_hit_rate"))],
        F.count_if(bad).alias("execution_error_count"),
    )
    p, r, f1 = prf(F.col("tp"), F.col("fp"), F.col("fn"))
    return out.select("*", p.alias("weighted_precision"), r.alias("weighted_recall"), f1.alias("weighted_f1")).drop("tp", "fp", "fn")


def combined_models(rows: DataFrame, reported: DataFrame, *, model: str = "model", run: str = "run_number") -> DataFrame:
    """Reported model summaries beside what all rows give: means of both runs, their distance, errors and retries."""
    e2e = end_to_end(rows, [model, run])
    f1 = lambda k: F.max(F.when(F.col(run) == k, F.col("weighted_f1")))
    names = ("weighted_precision", "weighted_recall", "weighted_f1", "top1_accuracy", "top5_hit_rate")
    means = e2e.groupBy(model).agg(
        *[F.avg(c).alias(f"mean_{c}_e2e") for c in names], F.abs(f1(1) - f1(2)).alias("weighted_f1_absolute_difference_e2e"), F.sum("execution_error_count").alias("execution_error_count"),
        rate(F.sum("execution_error_count"), F.sum("n"), empty=0.0).alias("execution_error_rate"),
    )
    return beside(reported, means, [model])


def by_ontology(rows: DataFrame, *, model: str = "model", ontology: str = "target_ontology") -> DataFrame:
    """End-to-end scores by model and vocabulary, with the vocabulary's place by rows of all models (1 has most)."""
    from pyspark.sql import Window

    per = end_to_end(rows, [model, ontology])
    totals = per.groupBy(ontology).agg(F.sum("n").alias("_n"))
    places = totals.select(ontology, F.row_number().over(Window.orderBy(F.desc("_n"), ontology)).alias("place"))  # as many rows as vocabularies
    return per.join(places, ontology)


def token_usage(rows: DataFrame, reasoning: list[str], *, model: str = "model") -> DataFrame:
    """Mean tokens by model; reasoning tokens only of models that have them, a reranker's missing tokens as 0."""
    has = F.col(model).isin(*reasoning) if reasoning else F.lit(False)
    cols = []
    for part, kinds in (("total", ("input", "cached_input", "output")), ("planner", ("input", "output")), ("reranker", ("input", "output"))):
        for kind in (*kinds, "reasoning"):
            c = F.col(f"{part}_{kind}_tokens").cast("double")
            c = zero(c) if part == "reranker" else c
            cols.append(F.avg(F.when(has, c) if kind == "reasoning" else c).alias(f"mean_{part}_{kind}_tokens"))
    return rows.groupBy(model).agg(*cols)


def completeness(rows: DataFrame, fields: list[str], by: list[str] | None = None) -> DataFrame:
    """For each field, how many rows have a value, and their share; a row a field and group."""
    by = by or []
    wide = rows.groupBy(*by).agg(F.count("*").alias("_rows"), *[F.count(f).alias(f) for f in fields])
    out = wide.unpivot([*by, "_rows"], fields, "field", "present")
    return out.select(*by, "field", "present", F.col("_rows").alias("rows"), rate(F.col("present"), F.col("_rows"), empty=0.0).alias("share"))


#: What a mode summary reads of its rows.
MODE_COLUMNS = ("status", "top1", "top3", "top5", "rr", "recall", "mapped_code", "was_retrieved", "validation_status", "confidence", "semantic_correctness", "end_to_end_seconds", "llm_seconds", "api_cost_usd")


def mode_summary(rows: DataFrame, by: list[str] | None = None) -> DataFrame:
    """rows: scored predictions (status, top1, top3, top5, rr, recall, mapped_code, was_retrieved, validation_status, confidence,
    semantic_correctness, end_to_end_seconds, llm_seconds, api_cost_usd). A row a mode with every metric that reports have; those of calibration
    are null for a mode without mapped rows that have a confidence."""
    from . import calibrate
    from .score import abstained

    by = by or []
    # written, since totals, percentiles, bins and ranks each read them, and rows may be the result of joins
    rows = written(rows.select(*dict.fromkeys((*by, *MODE_COLUMNS))))
    n = lambda c: F.count_if(c)
    mapped = F.col("status") == "mapped"
    outcome = lambda s: n(F.col("validation_status") == s)
    gone = abstained(F.col("status"), F.col("mapped_code"))
    out = rows.groupBy(*by).agg(
        F.count("*").alias("n"), *[zero(F.avg(F.col(f"top{k}").cast("double"))).alias(f"top{k}_accuracy") for k in (1, 3, 5)], zero(F.avg("rr")).alias("mrr"), zero(F.avg("recall")).alias("recall_at_gt"),
        F.count("recall").alias("recall_at_gt_n"), n(gone).alias("abstention_count"), n(mapped).alias("mapped_count"), n(F.col("status") == "unmapped").alias("unmapped_count"), n(F.col("status") == "error").alias("execution_error_count"),
        n(mapped & F.coalesce("was_retrieved", F.lit(False))).alias("_grounded"), outcome("VALID").alias("valid_code_count"), outcome("INVALID").alias("invalid_code_count"), outcome("UNRESOLVED").alias("unresolved_validation_count"),
        *[f(c).alias(name) for c, f, name in (("end_to_end_seconds", F.avg, "mean_end_to_end_seconds"), ("llm_seconds", F.avg, "mean_llm_seconds"), ("api_cost_usd", F.sum, "total_api_cost_usd"), ("api_cost_usd", F.avg, "mean_api_cost_per_row_usd"))],
    )
    told = F.col("valid_code_count") + F.col("invalid_code_count")
    m = F.col("mapped_count")
    out = out.select(
        "*", F.col("n").alias("abstention_total"), rate(F.col("abstention_count"), F.col("n"), empty=0.0).alias("abstention_rate"), rate(F.col("_grounded"), m).alias("grounding_rate"),
        rate(F.col("invalid_code_count"), told).alias("hallucination_rate"), rate(told, m).alias("validation_coverage"), rate(F.col("unresolved_validation_count"), m).alias("unresolved_validation_rate"),
        rate(F.col("execution_error_count"), F.col("n"), empty=0.0).alias("execution_error_rate"),
    ).drop("_grounded")
    for column in ("end_to_end_seconds", "llm_seconds"):
        out = beside(out, percentiles(rows, column, {f"median_{column}": 0.5}, by), by)
    return beside(out, calibrate.summary(rows, by), by)


def comparison(summaries: DataFrame, modes: list[str], *, mode: str = "mode") -> DataFrame:
    """summaries: a row a mode. A row a compared metric with its label, and a column a mode; a metric that summaries lack is left out."""
    names = [m for m in COMPARED if m in summaries.columns]
    long = summaries.select(mode, *[F.col(m).cast("double").alias(m) for m in names]).unpivot([mode], names, "metric", "value")
    labels = F.create_map(*[F.lit(x) for m in names for x in (m, COMPARED[m])])
    return long.groupBy(labels[F.col("metric")].alias("metric")).agg(*[F.max(F.when(F.col(mode) == m, F.col("value"))).alias(m) for m in modes])


def transition_matrix(rows: DataFrame, before: str, after: str, categories: list[str]) -> DataFrame:
    """How many rows go from each category to each other, those that none goes to as well."""
    counts = rows.groupBy(F.col(before).alias("before"), F.col(after).alias("after")).agg(F.count("*").alias("_n"))
    held = F.array(*[F.lit(c) for c in categories])
    grid = rows.sparkSession.range(1).select(F.explode(held).alias("before")).select("before", F.explode(held).alias("after"))
    return grid.join(counts, ["before", "after"], "left").select("before", "after", F.coalesce("_n", F.lit(0)).alias("count"))
