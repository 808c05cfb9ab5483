"""The whole mapping as one plan over tables of requests: plan, route, look up, merge, decide, build results."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import readable
from ..operators import candidates as C
from ..operators import decide, planning, retrieve, routing
from ..operators.store import written
from ..providers import ANSWER, FirstCandidate, answered
from ..schemas import assert_columns


def planned(requests: DataFrame, planner=None) -> DataFrame:
    """requests: request_id, term, label, description, type, target, allowed. Adds queries and ontologies to search, as a model plans them, or without one
    the label and the readable name in the vocabularies that the request names. A plan that failed has no queries, and plan_error."""
    assert_columns(requests, ["request_id", "term", "label", "target", "allowed"])
    if planner is not None:
        rows = planning.planned(requests, planner)
        empty = F.array().cast("array<string>")
        return rows.select(*requests.columns, F.coalesce("plan.queries", empty).alias("queries"), F.coalesce("plan.ontologies", empty).alias("ontologies"), "plan_error")
    queries = routing.queries_of(F.array_compact(F.array(F.nullif(F.trim("label"), F.lit("")), F.nullif(readable(F.col("term")), F.lit("")))), F.col("term"))
    empty = F.lit(None).cast("array<string>")
    return requests.select("*", queries.alias("queries"), routing.ontologies_of(F.col("target"), F.lit(None).cast("string"), empty, F.col("allowed")).alias("ontologies"))


def retrieved(plans: DataFrame, vocabulary: DataFrame, k: int = 10) -> DataFrame:
    """Candidates of every request, in order of its calls and their places."""
    spread = plans.select("request_id", F.posexplode("queries").alias("query_ord", "query"), "ontologies")
    calls = spread.select("request_id", "query_ord", "query", F.posexplode_outer("ontologies").alias("onto_ord", "ontology"))
    calls = calls.select("request_id", (F.col("query_ord") * 1000 + F.coalesce("onto_ord", F.lit(0))).alias("query_ord"), "query", "ontology")
    hits = retrieve.lexical(calls, vocabulary, k)
    asked = calls.select("request_id", "query_ord", F.col("query").alias("matched_query"), F.col("ontology").alias("asked"))
    hits = hits.join(asked, ["request_id", "query_ord"])
    return hits.select(
        "request_id", (F.col("query_ord").cast("bigint") * 1000 + F.col("place")).alias("ord"), "code", "term", "ontology", F.lit(None).cast("string").alias("definition"), F.lit("vocabulary").alias("source"),
        "matched_query", F.col("score").alias("raw_score"), F.when(F.col("score").between(0.0, 1.0), F.col("score")).alias("normalized_score"), F.array_compact(F.array("asked")).alias("retrieved_from"),
    )


def mapped(requests: DataFrame, vocabulary: DataFrame, *, provider=None, planner=None, k: int = 10, limit: int = 20, strict: bool = False) -> DataFrame:
    """A result a request. Only candidates of the vocabularies that the request allows are decided on. Requests without candidates skip the provider; a
    failed call gives an unmapped result."""
    plans = planned(requests, planner)
    limits = plans.select("request_id", planning.limits_of(F.col("target"), F.col("allowed")).alias("limits"))
    found = retrieved(plans, vocabulary, k).join(limits, "request_id")
    merged = C.merged(found, targets="limits", strict=strict, limit=limit)
    rows = decide.prompts(requests, merged)
    # written before it is read, so that no call is made twice
    asked = written(answered(rows.where(F.size("candidates") > 0), provider or FirstCandidate()))
    none = F.lit(None).cast(f"struct<{ANSWER.replace(' ', ':').replace(',:', ',')}>")
    rows = asked.unionByName(rows.where(F.size("candidates") == 0).withColumn("answer", none))
    return decide.results(rows.withColumn("decision", decide.decision(F.col("answer.reply"), F.col("candidates"))))
