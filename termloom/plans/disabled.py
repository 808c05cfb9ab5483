"""Mapping without lookups: a model names a code itself. Its reply is held against the caller's vocabularies; nothing is grounded."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.identity import blank, canonical, inconsistency, normalized_code
from ..functions.text import without_fences
from ..operators.planning import upper_list
from ..operators.store import spread, written
from ..providers import answered
from ..schemas import assert_columns

ITEM = "code string, term string, ontology string, confidence string"
# alternatives are read one by one, so that one that is no object spoils no other
REPLY = "target_code string, target_term string, ontology string, confidence string, notes string, alternatives array<string>"
# What stands for no mapping, and the note of a vocabulary that isn't allowed.
CODE, TERM, ONTOLOGY = "UNKNOWN:UNMAPPED", "UNMAPPED", "UNKNOWN"
OUTSIDE = "Disabled-mode LLM output used an ontology outside allowed_target_ontologies."


def prompts(requests: DataFrame, most: int = 5) -> DataFrame:
    """requests with prompt: what is known of the field, the vocabularies that an answer may come from, and what is asked for. Empty parts are left out."""
    line = lambda name, c: F.concat(F.lit(f"{name}: "), blank(F.col(c)))
    known = [line(n, c) for n, c in (("Term", "term"), ("Label", "label"), ("Description", "description"), ("Type", "type")) if c in requests.columns]
    must = F.concat(F.lit("Answer with a code of this vocabulary only: "), canonical(F.col("target")))
    may = F.concat(F.lit("Answer with a code of one of these vocabularies only: "), F.array_join(upper_list(F.col("allowed")), ", "))
    more = f"Up to {most} other plausible codes may follow as alternatives, surest first, each once, none surer than the answer." if most else "Give no alternatives."
    form = "Reply in JSON: target_code, target_term, ontology, confidence (0 to 1), notes, alternatives (code, term, ontology, confidence). Without a match: UNKNOWN:UNMAPPED, and no alternatives."
    return requests.withColumn("prompt", F.concat_ws("\n\n", F.concat_ws("\n", *known), F.coalesce(must, may), F.lit(more), F.lit(form)))


def results(rows: DataFrame, most: int = 5) -> DataFrame:
    """rows: request_id, target, allowed, reply (null after a failed call), error. A result each: status is mapped, unmapped or error.

    Fences are stripped. No JSON object, a confidence outside [0, 1] (one that is no number counts as 0), a vocabulary other than the target (spellings of one vocabulary are equal),
    or a code that contradicts its vocabulary, are errors. A vocabulary outside the allow-list, or a reply without a code, term or vocabulary, is unmapped, and has no
    alternatives. Alternatives go singly where they lack a part, leave the target or the allow-list, have no confidence within [0, 1], are surer than the answer, contradict
    their vocabulary, or repeat a code; the first `most` of the others stay, sorted by confidence."""
    text = without_fences(F.col("reply"))
    whole = F.coalesce(F.startswith(text, F.lit("{")) & F.try_parse_json(text).isNotNull(), F.lit(False))
    rows = spread(rows.select("request_id", "target", "allowed", "reply", "error"))  # reading a reply is heavy
    rows = rows.select("request_id", "reply", "error", whole.alias("whole"), F.from_json(text, REPLY).alias("r"), canonical(F.col("target")).alias("target"), canonical_list(F.col("allowed")).alias("allowed"))
    answer = rows.select(
        "request_id", "reply", "error", "whole", "target", "allowed", F.trim(F.coalesce("r.target_code", F.lit(""))).alias("code"), F.trim(F.coalesce("r.target_term", F.lit(""))).alias("term"),
        F.upper(F.trim(F.coalesce("r.ontology", F.lit("")))).alias("ontology"), F.coalesce(F.col("r.confidence").try_cast("double"), F.lit(0.0)).alias("confidence"), blank(F.col("r.notes")).alias("notes"),
        F.coalesce("r.alternatives", F.array().cast("array<string>")).alias("listed"),
    )
    none = (F.col("code") == "") | (F.col("term") == "") | F.col("ontology").isin("", "UNKNOWN") | F.upper("code").isin("UNMAPPED", CODE)
    key = canonical(F.col("ontology"))
    outside = F.coalesce(~F.array_contains("allowed", key), F.lit(False))
    wrong = (
        F.when(F.col("reply").isNull(), F.coalesce("error", F.lit("no reply")))
        .when(~F.col("whole"), "the reply is no JSON object")
        .when(~F.col("confidence").between(0.0, 1.0), "confidence outside [0, 1]")
        .when(none, F.lit(None))
        .when(F.coalesce(F.col("target") != key, F.lit(False)), "vocabulary outside the target")
        .when(~outside & inconsistency(F.col("ontology"), normalized_code(F.col("code"), F.col("ontology")), F.lit(None).cast("string")).isNotNull(), "code of another vocabulary")
    )
    judged = answer.withColumn("wrong", wrong).withColumn("outside", outside & ~none)
    judged = judged.withColumn("status", F.when(F.col("wrong").isNotNull(), "error").when(none | F.col("outside"), "unmapped").otherwise("mapped"))
    judged = judged.withColumn("found", F.when(F.col("status") == "mapped", normalized_code(F.col("code"), F.col("ontology"))))
    ok = F.col("status") == "mapped"
    pick = lambda c, other: F.when(ok, c).when(F.col("status") == "unmapped", other)
    notes = F.when(F.col("outside"), F.concat_ws(" ", F.lit(OUTSIDE), "notes")).otherwise(F.col("notes"))
    return judged.select(
        "request_id", "status", pick(F.col("found"), CODE).alias("target_code"), pick(F.col("term"), TERM).alias("target_term"), pick(F.col("ontology"), ONTOLOGY).alias("ontology"),
        F.when(F.col("status") != "error", F.col("confidence")).alias("confidence"), F.when(F.col("status") != "error", notes).alias("notes"),
        F.when(ok, others(most)).otherwise(F.array().cast("array<struct<code: string, term: string, ontology: string, confidence: double>>")).alias("alternatives"),
        F.col("wrong").alias("error"), F.lit(False).alias("is_grounded"),
    )


def canonical_list(names: Column) -> Column:
    own = F.array_compact(F.transform(names, canonical))
    return F.when(F.size(own) > 0, own)


def others(most: int) -> Column:
    """The alternatives of a mapped row that keep the rules."""
    up = lambda c: F.upper(F.trim(F.coalesce(c, F.lit(""))))
    read = F.transform(F.filter("listed", lambda a: F.startswith(F.ltrim(a), F.lit("{"))), lambda a: F.from_json(a, ITEM))
    item = F.transform(read, lambda a: F.struct(F.trim(a.code).alias("code"), F.trim(a.term).alias("term"), up(a.ontology).alias("ontology"), a.confidence.try_cast("double").alias("confidence")))
    full = F.filter(item, lambda a: F.coalesce((a.code != "") & (a.term != "") & (a.ontology != ""), F.lit(False)))
    keyed = F.transform(full, lambda a: F.struct(a.alias("a"), canonical(a.ontology).alias("key"), normalized_code(a.code, a.ontology).alias("code")))
    within = lambda x: F.coalesce(F.col("target") == x.key, F.lit(True)) & F.coalesce(F.array_contains("allowed", x.key), F.lit(True))
    sure = lambda x: F.coalesce(x.a.confidence.between(0.0, 1.0) & (x.a.confidence <= F.col("confidence")), F.lit(False))
    other = lambda x: (x.key != canonical(F.col("ontology"))) | (F.upper(x.code) != F.upper("found"))
    good = F.filter(keyed, lambda x: within(x) & sure(x) & other(x) & inconsistency(x.a.ontology, x.code, F.lit(None).cast("string")).isNull())
    name = lambda x: F.concat_ws("\n", x.key, F.upper(x.code))
    once = F.filter(good, lambda x, i: F.array_position(F.transform(good, name), name(x)) == i + 1)
    some = F.transform(F.slice(once, 1, most) if most else F.slice(once, 1, 0), lambda x, i: F.struct((-x.a.confidence).alias("k"), i.alias("i"), x.alias("x")))
    return F.transform(F.array_sort(some), lambda s: F.struct(s.x.code.alias("code"), s.x.a.term.alias("term"), s.x.a.ontology.alias("ontology"), s.x.a.confidence.alias("confidence")))


def mapped(requests: DataFrame, provider, *, most: int = 5, **calls) -> DataFrame:
    """A result a request: request_id, term, label, target and allowed. A call that fails is a row of status error."""
    assert_columns(requests, ["request_id", "term", "label", "target", "allowed"])
    # written, so that no call is made twice
    rows = written(answered(prompts(requests, most), provider, **calls))
    return results(rows.select("request_id", "target", "allowed", "answer.reply", "answer.error"), most)
