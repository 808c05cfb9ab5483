"""What rows have to keep: the rules of plans, candidates, alternatives, decisions, traces and results, and the forms that they are brought into
first. violations() of schemas names the broken rules of each row, so that bad rows can be counted, refused or set aside."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.identity import canonical, inconsistency, normalized_code
from ..schemas import violations
from .planning import upper_list

NONE, DISABLED, PRODUCTION = "none", "disabled", "production_grounded"


def filled(c: str) -> Column:
    return F.trim(F.coalesce(F.col(c).cast("string"), F.lit(""))) != ""


def consistent(ontology: str, code: str, iri: Column | None = None) -> Column:
    return inconsistency(F.col(ontology), F.col(code), F.lit(None).cast("string") if iri is None else iri).isNull()


def unless_disabled(grounded: str, mode: str = "retrieval_mode", source: str = "grounding_source") -> dict[str, Column]:
    """Disabled retrieval grounds nothing."""
    on = F.coalesce(F.col(mode) != DISABLED, F.lit(True))
    return {"grounded without retrieval": on | ~F.col(grounded), "grounding source without retrieval": on | (F.col(source) == NONE)}


def results(rows: DataFrame) -> DataFrame:
    """Results: code and vocabulary trimmed, the vocabulary's prefix given to a bare code, alternatives by falling confidence; then code not blank
    and of its vocabulary, confidence in [0, 1], and every alternative of its own."""
    ontology = F.upper(F.trim("ontology"))
    code = F.trim("target_code")
    code = F.when(F.contains(code, F.lit(":")), code).otherwise(normalized_code(code, ontology))
    order = F.transform("alternatives", lambda a, i: F.struct((-a.confidence).alias("k"), i.alias("i"), a.alias("a")))
    rows = rows.withColumns({"target_code": code, "ontology": ontology, "alternatives": F.transform(F.array_sort(order), lambda x: x.a)})
    none = F.lit(None).cast("string")
    fits = F.forall("alternatives", lambda a: inconsistency(a.ontology, a.code, none).isNull() & a.confidence.between(0.0, 1.0))
    return violations(rows, {"blank code": filled("target_code"), "code of another vocabulary": consistent("ontology", "target_code"), "confidence": F.col("confidence").between(0.0, 1.0), "alternative": F.coalesce(fits, F.lit(True))})


def plans(rows: DataFrame) -> DataFrame:
    """Plans: term trimmed, allow-list upper-cased without repeats (null if empty); a term there is, and a confidence in [0, 1]."""
    rows = rows.withColumns({"term": F.trim("term"), "allowed": upper_list(F.col("allowed"))})
    return violations(rows, {"blank term": filled("term"), "confidence": F.col("confidence").between(0.0, 1.0)})


def candidates(rows: DataFrame, iri: Column | None = None) -> DataFrame:
    """Candidates: texts trimmed, vocabulary upper-cased, search spaces canonical without repeats; no field blank, not from disabled retrieval,
    a score in [0, 1] if there is one, and one namespace."""
    spaces = F.array_distinct(F.array_compact(F.transform("retrieved_from", canonical)))
    texts = ("code", "term", "source", "matched_query")
    rows = rows.withColumns({**{c: F.trim(c) for c in texts}, "ontology": F.upper(F.trim("ontology")), "retrieved_from": spaces})
    score = F.col("normalized_score")
    return violations(rows, {
        **{f"blank {c}": filled(c) for c in (*texts, "ontology")}, "disabled retrieval": F.coalesce(F.col("retrieval_mode") != DISABLED, F.lit(True)),
        "score": score.isNull() | score.between(0.0, 1.0), "namespace": consistent("ontology", "code", iri),
    })


def decisions(rows: DataFrame) -> DataFrame:
    """Decisions: nothing grounded without retrieval; with it, an ungrounded one is unmapped or not of production; explanations of alternatives
    aren't blank."""
    on = F.coalesce(F.col("retrieval_mode") != DISABLED, F.lit(True))
    ungrounded = on & ~F.col("is_grounded") & ~F.col("is_unmapped") & (F.col("policy") == PRODUCTION)
    said = F.forall("alternatives", lambda a: (F.trim(a.explanation) != "") & (F.trim(a.code) != ""))
    return violations(rows, {**unless_disabled("is_grounded"), "ungrounded production": ~ungrounded, "confidence": F.col("confidence").between(0.0, 1.0), "alternative text": F.coalesce(said, F.lit(True))})


def traces(rows: DataFrame, grounded: str = "is_grounded") -> DataFrame:
    """Traces and route plans: skipped follows from disabled retrieval where it isn't given; nothing is grounded then."""
    skipped = F.coalesce(F.col("retrieval_skipped"), F.col("retrieval_mode") == DISABLED, F.lit(False))
    return violations(rows.withColumn("retrieval_skipped", skipped), unless_disabled(grounded))


def accepted(rows: DataFrame) -> DataFrame:
    """Rows that break no rule."""
    return rows.where(F.size("violations") == 0).drop("violations")


def refused(rows: DataFrame) -> DataFrame:
    """Rule and rows that break it, the most often broken first in number."""
    return rows.select(F.explode("violations").alias("rule")).groupBy("rule").agg(F.count("*").alias("rows"))
