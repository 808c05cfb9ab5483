"""Prompts from plans and candidates, and decisions from replies: parsed, held against the contract, made into results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import bounded, explanation, without_fences

REPLY = "selected_code string, selected_candidate_id string, is_unmapped boolean, confidence double, reasoning string, alternatives array<struct<code: string, confidence: double, explanation: string>>, alternative_codes array<string>"
UNMAPPED = "UNKNOWN:UNMAPPED"
HIGH = 0.8


def prompts(requests: DataFrame, candidates: DataFrame) -> DataFrame:
    """request_id, candidates (an array in order of rank) and prompt. Requests without candidates have an empty array and
    need no call."""
    per = candidates.groupBy("request_id").agg(F.array_sort(F.collect_list(F.struct("rank", "code", "term", "ontology", "definition", "source", "normalized_score", "raw_score"))).alias("candidates"))
    line = lambda c: F.concat_ws(" | ", F.concat(F.lit("C"), c["rank"].cast("string")), c.code, c.term, c.ontology, bounded(F.coalesce(c.definition, F.lit("")), 200), F.concat(F.lit("score="), F.when(c.normalized_score.isNotNull(), F.format_string("%.4f", c.normalized_score)).otherwise("-")))
    context = F.concat_ws("\n", F.concat(F.lit("Term: "), F.col("term")), F.concat(F.lit("Label: "), F.col("label")), F.concat(F.lit("Description: "), F.col("description")), F.concat(F.lit("Type: "), F.col("type")))
    rows = requests.join(per, "request_id", "left")
    empty = F.array().cast(per.schema["candidates"].dataType)
    rows = rows.withColumn("candidates", F.coalesce("candidates", empty))
    return rows.withColumn("prompt", F.concat_ws("\n\n", context, F.array_join(F.transform("candidates", line), "\n")))


def decision(reply: Column, candidates: Column, most: int = 5) -> Column:
    """A struct: selected_code, is_unmapped, confidence, reasoning, alternatives, policy. A code that no candidate has or that isn't the
    named candidate's (C1, C2, ...), a confidence outside [0, 1] or no JSON make it unmapped, policy says why. Alternatives (codes or candidates; a plain list of
    them has no confidence) are cut to most first; those go that no candidate has, that repeat the selected code, or that are surer than it; then they are
    sorted by confidence. Where nothing is selected by choice, alternatives keep their own confidence."""
    kind = "array<struct<code: string, confidence: double, explanation: string>>"
    got = F.from_json(without_fences(reply), REPLY)
    codes = F.transform(candidates, lambda c: c.code)
    named = code_of(got.selected_candidate_id, candidates)
    policy = (
        F.when(got.isNull() | (got.selected_code.isNull() & got.is_unmapped.isNull()), "invalid reply")
        .when(F.coalesce(got.is_unmapped, F.lit(False)), "unmapped by choice")
        .when(~F.coalesce(F.array_contains(codes, got.selected_code), F.lit(False)), "code is not a candidate")
        .when(F.coalesce(named != got.selected_code, F.lit(False)), "code is not the named candidate's")
        .when(~F.coalesce(got.confidence.between(0.0, 1.0), F.lit(False)), "invalid confidence")
    )
    ok, chosen_none = policy.isNull(), F.coalesce(policy == "unmapped by choice", F.lit(False))
    plain = F.transform(got.alternative_codes, lambda a: F.struct(a.alias("code"), F.lit(0.0).alias("confidence"), F.lit(None).cast("string").alias("explanation"))).cast(kind)
    some = F.slice(F.coalesce(got.alternatives, plain, F.array().cast(kind)), 1, most)
    some = F.transform(some, lambda a: F.struct(code_of(a.code, candidates).alias("code"), a.confidence.alias("confidence"), a.explanation.alias("explanation")))
    fits = lambda a: F.array_contains(codes, a.code) & a.confidence.between(0.0, 1.0) & F.when(ok, (a.code != got.selected_code) & (a.confidence <= got.confidence)).otherwise(chosen_none)
    good = F.filter(some, lambda a: F.coalesce(fits(a), F.lit(False)))
    ordered = F.transform(F.array_sort(F.transform(good, lambda a, i: F.struct((-a.confidence).alias("k"), i.alias("i"), a.alias("a")))), lambda x: x.a)
    return F.struct(
        F.when(ok, got.selected_code).alias("selected_code"), (~ok).alias("is_unmapped"), F.when(ok, got.confidence).otherwise(F.lit(0.0)).alias("confidence"),
        got.reasoning.alias("reasoning"), F.when(ok | chosen_none, ordered).alias("alternatives"), policy.alias("policy"),
    )


def results(rows: DataFrame) -> DataFrame:
    """rows: a request's columns, candidates and decision. The mapping result; an unmapped one has the sentinel code. Grounded
    results have a code that a lookup has found."""
    d = F.col("decision")
    chosen = F.get(F.filter("candidates", lambda c: c.code == d.selected_code), F.lit(0))
    rest = F.filter("candidates", lambda c: c.code != d.selected_code)
    listed = F.coalesce(d.alternatives, F.array().cast("array<struct<code: string, confidence: double, explanation: string>>"))
    named = F.filter(F.transform(listed, lambda a: F.struct(F.get(F.filter("candidates", lambda c: c.code == a.code), F.lit(0)).alias("c"), a.confidence.alias("confidence"), a.explanation.alias("explanation"))), lambda x: x.c.isNotNull())
    # replies without alternatives: the next candidates by rank, no surer than the chosen one
    filled = F.transform(F.slice(rest, 1, 4), lambda c: F.struct(c.alias("c"), F.least(F.coalesce(c.normalized_score, F.lit(0.0)), d.confidence).alias("confidence"), F.lit(None).cast("string").alias("explanation")))
    alternatives = F.transform(F.when((F.size(named) > 0) | d.is_unmapped, named).otherwise(filled), lambda x: F.struct(x.c.code.alias("code"), x.c.term.alias("term"), x.c.ontology.alias("ontology"), x.confidence.alias("confidence"), x.c.source.alias("source"), F.coalesce(x.explanation, explanation(x.c.term)).alias("explanation")))
    none = d.is_unmapped
    return rows.select(
        "request_id", F.col("term").alias("source_term"), F.col("label").alias("source_label"), F.col("type").alias("source_type"),
        F.when(none, UNMAPPED).otherwise(chosen.code).alias("target_code"), F.when(none, "UNMAPPED").otherwise(chosen.term).alias("target_term"), F.when(none, "UNKNOWN").otherwise(chosen.ontology).alias("ontology"),
        d.confidence.alias("confidence"), (~none).alias("is_grounded"), (d.confidence >= HIGH).alias("high_confidence"), F.when(none, d.policy).alias("notes"), alternatives.alias("alternatives"),
    )


def ranks(alternatives: Column, selected: Column) -> Column:
    """The selected code and its alternatives as five ranks."""
    codes = F.concat(F.array(selected), F.transform(alternatives, lambda a: a.code))
    return F.slice(F.concat(codes, F.array_repeat(F.lit(None).cast("string"), 5)), 1, 5)


def code_of(answer: Column, candidates: Column) -> Column:
    """What an answer names: a candidate's place (C1, C2, ...) or a code; null for a blank."""
    text = F.nullif(F.trim(answer), F.lit(""))
    at = F.regexp_extract(text, "^C([0-9]{1,6})$", 1).try_cast("int")
    named = F.get(candidates, at - 1).code
    return F.coalesce(F.when(at > 0, named), text)


def provenance(candidates: DataFrame) -> DataFrame:
    """What each candidate's retrieval says about it, apart from any decision."""
    kept = ("code", "term", "ontology", "source", "matched_queries", "retrieved_from", "raw_score", "normalized_score")
    return candidates.select("request_id", "rank", *[c for c in kept if c in candidates.columns])


def ranked(candidates: Column, d: Column) -> Column:
    """The selected candidate and the decision's alternatives that some candidate has, each as c with the decision's confidence."""
    none = F.array().cast("array<struct<code: string, confidence: double, explanation: string>>")
    own = F.when(d.selected_code.isNotNull(), F.array(F.struct(d.selected_code.alias("code"), d.confidence.alias("confidence"), F.lit(None).cast("string").alias("explanation"))))
    named = F.concat(F.coalesce(own, none), F.coalesce(d.alternatives, none))
    with_candidate = F.transform(named, lambda a: F.struct(F.get(F.filter(candidates, lambda c: c.code == a.code), F.lit(0)).alias("c"), a.confidence.alias("confidence")))
    return F.filter(with_candidate, lambda x: x.c.isNotNull())


def ranking_trace(rows: DataFrame) -> DataFrame:
    """rows: request_id, candidates and decision. The selected candidate and its alternatives with ranks from 1 without gaps, the confidence
    of the decision and the scores of the retrieval; alternatives that no candidate has are left out."""
    d = F.col("decision")
    kept = ranked(F.col("candidates"), d)
    out = rows.select("request_id", d.selected_code.alias("selected"), F.posexplode(kept).alias("at", "x"))
    return out.select("request_id", (F.col("at") + 1).alias("rank"), "x.c.code", "x.c.ontology", (F.col("x.c.code") == F.col("selected")).alias("selected"), F.col("x.confidence").alias("final_confidence"), F.col("x.c.raw_score").alias("raw_score"), F.col("x.c.normalized_score").alias("normalized_score"))
