"""Runs held against what they state: metrics are recomputed in the pass that writes a run, and a run that differs is never committed.

The metrics are aggregates observed in the stage that writes, where a task counts once, whichever executors are lost; so the check costs no second
scan. Only the area under the curve needs an order of all confidences and reads three columns of what was staged.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from ..functions.numbers import rate
from ..sources.versions import VersionedTable
from .calibrate import BINS, summary
from .score import abstained
from .summaries import COMPARED, beside, end_to_end, zero

REL, ABSOLUTE = 1e-6, 1e-9
#: What a run may state beside the compared metrics.
COUNTS = ("n", "execution_error_count")


class Refused(Exception):
    """A run that isn't complete, or isn't what it states; problems names each."""

    def __init__(self, problems: list[str]):
        super().__init__("; ".join(problems))
        self.problems = problems


def metrics(on: Column) -> dict[str, Column]:
    """Aggregates over the rows (as for a mode summary) for which on holds: every compared metric but the area under the curve, and counts."""
    x = lambda c: F.when(on, F.col(c))
    n = lambda c: F.count_if(on & c)
    share = lambda c: zero(F.avg(x(c).cast("double")))
    outcome = lambda s: n(F.col("validation_status") == s)
    rows, mapped, told = F.count_if(on), n(F.col("status") == "mapped"), outcome("VALID") + outcome("INVALID")
    score, label = F.col("confidence"), F.coalesce(F.col("semantic_correctness").cast("int"), F.lit(0))
    held = on & (F.col("status") == "mapped") & score.isNotNull()
    place = F.least(F.floor(score * BINS), F.lit(BINS - 1))
    gaps = reduce(lambda a, b: a + b, [F.abs(zero(F.sum(F.when(held & (place == k), label - score)))) for k in range(BINS)])
    right, wrong = F.when(held & (label == 1), score), F.when(held & (label == 0), score)
    n1, n0 = F.count(right), F.count(wrong)
    pooled = F.sqrt(((n1 - 1) * F.var_samp(right) + (n0 - 1) * F.var_samp(wrong)) / (n1 + n0 - 2))
    return {
        "n": rows, "execution_error_count": n(F.col("status") == "error"), **{f"top{k}_accuracy": share(f"top{k}") for k in (1, 3, 5)}, "mrr": share("rr"), "recall_at_gt": share("recall"),
        "abstention_rate": rate(n(abstained(F.col("status"), F.col("mapped_code"))), rows, empty=0.0), "hallucination_rate": rate(outcome("INVALID"), told), "validation_coverage": rate(told, mapped),
        "grounding_rate": rate(n((F.col("status") == "mapped") & F.coalesce("was_retrieved", F.lit(False))), mapped), "brier_score": F.avg(F.when(held, F.pow(score - label, F.lit(2)))),
        "ece": F.when(F.count_if(held) > 0, gaps / F.count_if(held)), "cohens_d": F.when((n1 > 1) & (n0 > 1) & (pooled > 0), (F.avg(right) - F.avg(wrong)) / pooled),
        "execution_error_rate": rate(n(F.col("status") == "error"), rows, empty=0.0), "mean_end_to_end_seconds": F.avg(x("end_to_end_seconds")), "mean_llm_seconds": F.avg(x("llm_seconds")),
        "mean_api_cost_per_row_usd": F.avg(x("api_cost_usd")), "total_api_cost_usd": F.sum(x("api_cost_usd")),
    }


def watched(rows: DataFrame, modes: list[str], *, mode: str = "mode") -> tuple[DataFrame, Observation]:
    """rows, and what is observed once they are written."""
    seen = Observation()
    own = [c.alias(f"{k}:{name}") for k, m in enumerate(modes) for name, c in metrics(F.coalesce(F.col(mode) == m, F.lit(False))).items()]
    strays = F.count_if(~F.coalesce(F.col(mode).isin(*modes), F.lit(False)))
    return rows.observe(seen, strays.alias("strays"), *own), seen


def near(a: float, b: float, rel: float = REL, absolute: float = ABSOLUTE) -> bool:
    return math.isclose(a, b, rel_tol=rel, abs_tol=absolute)


def differences(found: dict[str, float | None], stated: dict[str, float | None], *, rel: float = REL, absolute: float = ABSOLUTE) -> dict[str, tuple]:
    """Of the metrics that were found and stated: (found, stated) where they differ beyond the tolerance. What is found and isn't stated
    differs; two nulls don't. A stated metric that nothing computes differs as well."""
    out = {}
    for name in {**found, **stated}:
        a, b = found.get(name), stated.get(name)
        same = a is None and b is None if a is None or b is None else near(float(a), float(b), rel, absolute)
        if not same:
            out[name] = (a, b)
    return out


def gate(configs: dict[str, dict], fields: list[str]) -> list[str]:
    """Problems of the runs' settings: not completed, or not those of the first run in one of the fields."""
    problems = [f"{m}: not completed" for m, c in configs.items() if c.get("completed") is not True]
    first, *others = configs
    return problems + [f"{m}: {f} differs from {first}" for m in others for f in fields if configs[m].get(f) != configs[first].get(f)]


def commit(table: VersionedTable, rows: DataFrame, stated: dict[str, dict[str, float | None]], *, mode: str = "mode", configs: dict[str, dict] | None = None,
           fields: tuple[str, ...] = (), since: int | None = None, rel: float = REL, absolute: float = ABSOLUTE) -> int:
    """Writes rows as the table's next version if every mode's metrics are those that are stated (mode -> metric -> value; all that
    metrics() gives, and roc_auc), and refuses them by name otherwise: the version before stays. Modes and metrics are few; only they come to the driver."""
    if problems := gate(configs, list(fields)) if configs else []:
        raise Refused(problems)
    modes = list(stated)
    rows, seen = watched(rows, modes, mode=mode)

    def check(staged: DataFrame) -> None:
        areas = {r[mode]: r["roc_auc"] for r in summary(staged.where(F.col(mode).isin(*modes)), [mode]).select(mode, "roc_auc").collect()}
        got = seen.get
        bad = [f"{got['strays']} rows of no stated mode"] if got["strays"] else []
        for k, m in enumerate(modes):
            found = {name: got[f"{k}:{name}"] for name in (*COUNTS, *COMPARED) if name != "roc_auc"} | {"roc_auc": areas.get(m)}
            bad += [f"{m}: {name} is {a}, stated {b}" for name, (a, b) in differences(found, stated[m], rel=rel, absolute=absolute).items()]
        if bad:
            raise Refused(bad)

    return table.overwrite(rows, since=since, check=check)


def model_problems(rows: DataFrame, runs: DataFrame, models: DataFrame, *, rows_per_run: int | None = None, model: str = "model", run: str = "run_number") -> DataFrame:
    """model, run (null for a model as a whole), problem, found and stated, for raw rows of a model benchmark beside its reported runs
    and models: a run's number of rows and of errors; its scores where nothing failed, as failed rows count in these only; runs that one side lacks; a
    model's cost a term, which is to be its combined cost over all its rows."""
    scores = ("weighted_precision", "weighted_recall", "weighted_f1", "top1_accuracy", "top5_hit_rate")
    ours = end_to_end(rows, [model, run]).withColumn("_ours", F.lit(True))
    theirs = runs.select(model, run, F.col("error_count").cast("double").alias("_errors"), *[F.col(c).alias(f"_{c}") for c in scores]).withColumn("_theirs", F.lit(True))
    both = ours.join(theirs, [model, run], "full_outer")
    both = both.withColumn("_expected", F.lit(rows_per_run).cast("double"))
    there, clean = F.col("_ours") & F.col("_theirs"), F.col("execution_error_count") == 0
    told = lambda name, found, stated, when: F.when(F.coalesce(when, F.lit(False)), F.struct(F.lit(name).alias("problem"), found.cast("double").alias("found"), stated.cast("double").alias("stated")))
    off = lambda a, b: F.coalesce(F.abs(a - b) > 1e-9 + 1e-5 * F.abs(b), a.isNotNull() | b.isNotNull())
    none = F.lit(None)
    found = [
        told("no rows", none, none, F.col("_ours").isNull()), told("not reported", none, none, F.col("_theirs").isNull()),
        told("rows", F.col("n"), F.col("_expected"), F.col("n") != F.col("_expected")), told("error_count", F.col("execution_error_count"), F.col("_errors"), there & ~F.col("execution_error_count").cast("double").eqNullSafe(F.col("_errors"))),
        *[told(c, F.col(c), F.col(f"_{c}"), there & clean & off(F.col(c), F.col(f"_{c}"))) for c in scores],
    ]
    of_runs = both.select(model, F.col(run).cast("int").alias("run"), F.explode(F.filter(F.array(*found), lambda x: x.isNotNull())).alias("x")).select(model, "run", "x.*")
    counts = ours.groupBy(model).agg(F.sum("n").alias("_n"))
    costs = beside(models.select(model, "combined_api_cost_usd", F.col("mean_api_cost_per_term_usd").alias("_mean")), counts, [model])
    implied = rate(F.col("combined_api_cost_usd"), F.col("_n"))
    apart = F.coalesce(F.abs(implied - F.col("_mean")) > 1e-8 + 1e-6 * F.abs("_mean"), implied.isNotNull() | F.col("_mean").isNotNull())
    of_models = costs.where(apart).select(model, none.cast("int").alias("run"), F.lit("mean_api_cost_per_term_usd").alias("problem"), implied.alias("found"), F.col("_mean").alias("stated"))
    return of_runs.unionByName(of_models)
