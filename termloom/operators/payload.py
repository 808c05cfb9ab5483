"""The open payload of a mapping result as a VARIANT: what a run keeps about each result, and the evidence that is read back from it.

A payload has a stated place for what every result has, and takes stages' timings, usage and diagnostics only where there are any. Text that
isn't JSON is a null payload, and what a payload lacks, or holds in another type, has its default; neither ends the job.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.identity import let, normalized_code
from .decide import ranked

# Where a result keeps what its stages say, and what stands for no source.
PLACE = "$.rag_debug.candidates_retrieved[0]"
NO_SOURCE = "none"
#: Columns of rows that become parts of the payload, if they are there: those of the stages' record, and those that lie beside it.
INSIDE = ("retrieval_mode", "is_grounded", "grounding_source", "strict_target_ontology", "query_plan", "retrieval_trace", "retrieval_skipped")
BESIDE = ("pipeline_timings", "pipeline_usage", "retrieval_diagnostics")


def packed(rows: DataFrame) -> DataFrame:
    """texts() with the payload as a VARIANT."""
    return texts(rows).withColumn("payload", F.parse_json("payload"))


def texts(rows: DataFrame) -> DataFrame:
    """rows: candidates, decision and any of INSIDE and BESIDE (structs, maps or plain values). rows with payload as JSON text. Empty maps, and
    diagnostics without a request, are left out as if they were null."""
    has = set(rows.columns)
    types = dict(rows.dtypes)
    told = {c: F.when(F.size(c) > 0, F.col(c)) if types[c].startswith("map") else F.col(c) for c in BESIDE if c in has}
    if "retrieval_diagnostics" in told and "retrieval_request_count" in types["retrieval_diagnostics"]:
        told["retrieval_diagnostics"] = F.when(F.col("retrieval_diagnostics.retrieval_request_count") > 0, told["retrieval_diagnostics"])
    own = [c for c in ("code", "ontology", "term", "retrieved_from", "raw_score", "normalized_score") if c in rows.select(F.explode("candidates").alias("x")).select("x.*").columns]
    trace = F.transform(ranked(F.col("candidates"), F.col("decision")), lambda x, i: F.struct((i + 1).alias("rank"), x.c.code.alias("code"), x.c.ontology.alias("ontology"), x.confidence.alias("final_confidence")))
    record = F.struct(
        *[F.col(c) for c in INSIDE if c in has], F.size("candidates").alias("candidate_count"),
        F.transform("candidates", lambda c: F.struct(*[c[n].alias(n) for n in own])).alias("candidate_score_provenance"), trace.alias("final_ranking_trace"),
    )
    debug = F.struct(F.array(record).alias("candidates_retrieved"), F.size("candidates").alias("top_k"), *[c.alias(n) for n, c in told.items()])
    return rows.withColumn("payload", F.to_json(F.struct(debug.alias("rag_debug"))))


def parsed(text: Column) -> Column:
    """A payload from text; null for what isn't JSON."""
    return F.try_parse_json(text)


def at(payload: Column, path: str, kind: str) -> Column:
    return F.try_variant_get(payload, path, kind)


def evidence(payload: Column, code: Column) -> Column:
    """A struct: is_grounded, grounding_source, retrieval_skipped (beside the other flags or, without that, in the trace of the retrieval),
    candidate_codes (normalized), candidate_count (as stated, else that of the codes) and selected_code_was_retrieved, false without a code. Null for a null payload."""
    told = lambda name, kind: at(payload, f"{PLACE}.{name}", kind)
    entries = F.coalesce(told("candidate_score_provenance", "array<variant>"), F.array().cast("array<variant>"))
    pairs = F.transform(entries, lambda e: F.struct(at(e, "$.code", "string").alias("code"), at(e, "$.ontology", "string").alias("ontology")))
    codes = F.transform(F.filter(pairs, lambda p: p.code != ""), lambda p: normalized_code(p.code, p.ontology))
    skipped = F.when(told("retrieval_skipped", "variant").isNotNull(), told("retrieval_skipped", "boolean")).otherwise(told("retrieval_trace.retrieval_skipped", "boolean"))
    false = F.lit(False)
    # codes are made once, as three fields are read from them
    found = lambda codes: F.struct(
        F.coalesce(told("is_grounded", "boolean"), false).alias("is_grounded"), F.coalesce(F.nullif(told("grounding_source", "string"), F.lit("")), F.lit(NO_SOURCE)).alias("grounding_source"),
        F.coalesce(skipped, false).alias("retrieval_skipped"), codes.alias("candidate_codes"), F.coalesce(told("candidate_count", "int"), F.size(codes)).alias("candidate_count"),
        F.coalesce(F.array_contains(codes, code), false).alias("selected_code_was_retrieved"),
    )
    return F.when(payload.isNotNull(), let(codes, found))


def trace(rows: DataFrame, keep: list[str], payload: str = "payload") -> DataFrame:
    """keep, rank, code, ontology and final_confidence: the rows of the ranking that payloads hold."""
    kind = "array<struct<rank: int, code: string, ontology: string, final_confidence: double>>"
    held = at(F.col(payload), f"{PLACE}.final_ranking_trace", kind)
    return rows.select(*keep, F.explode(held).alias("x")).select(*keep, "x.*")
