"""Query plans by a model: prompts, replies read into plans, constraints of the caller, and a second call where the first gives nothing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.identity import canonical
from ..functions.text import without_fences
from ..providers import answered
from .store import written

REPLY = "normalized_term string, inferred_meaning string, semantic_type string, preferred_ontology string, reasoning string, confidence string, expanded_queries string, candidate_ontologies string"
PLAN = "normalized_term string, queries array<string>, inferred_meaning string, semantic_type string, ontologies array<string>, preferred string, reasoning string, confidence double"


def asks_only(target: Column, allowed: Column, key: str) -> Column:
    """Whether a request's target, or its allow-list of one, is the vocabulary."""
    one = F.when((F.size(allowed) == 1), F.element_at(allowed, 1))
    return F.coalesce(canonical(F.coalesce(F.nullif(F.trim(target), F.lit("")), one)) == key, F.lit(False))


def upper_list(names: Column) -> Column:
    """Trimmed upper-cased names in order, each once; null if none is left."""
    own = F.array_distinct(F.filter(F.transform(names, lambda x: F.upper(F.trim(x))), lambda x: x != ""))
    return F.when(F.size(own) > 0, own)


def limits_of(target: Column, allowed: Column) -> Column:
    """The vocabularies that an answer may come from: the allow-list, else the target; null for any."""
    return F.coalesce(upper_list(allowed), upper_list(F.array(target)))


def prompts(requests: DataFrame) -> DataFrame:
    """requests: term, label, description, type, target, allowed. Adds prompt; empty parts are left out."""
    said = lambda name, c: F.when(F.trim(c) != "", F.concat(F.lit(f"{name}: "), F.trim(c)))
    allowed = F.array_join(upper_list(F.col("allowed")), ", ")
    only = F.when(F.trim("target") != "", F.concat(F.lit("Only this vocabulary: "), F.upper(F.trim("target")))).when(allowed != "", F.concat(F.lit("Only these vocabularies: "), allowed))
    hint = F.when(asks_only(F.col("target"), F.col("allowed"), "ICD10"), "Prefer the wording of diagnoses.").when(asks_only(F.col("target"), F.col("allowed"), "SNOMED-CT"), "Prefer the wording of clinical findings.")
    parts = [F.lit("Plan the lookups for this field and reply with JSON."), said("Term", F.col("term")), said("Label", F.col("label")), said("Description", F.col("description")), said("Type", F.col("type")), only, hint]
    return requests.withColumn("prompt", F.concat_ws("\n", *parts))


def listed(text: Column) -> Column:
    """A JSON array of texts, or one text, as an array without blanks."""
    many = F.from_json(text, "array<string>")
    own = F.when(F.startswith(F.trim(text), F.lit("[")), many).when(F.trim(text) != "", F.array(text))
    return F.coalesce(F.filter(F.transform(own, lambda x: F.trim(x)), lambda x: x != ""), F.array().cast("array<string>"))


def plan_of(reply: Column, term: Column, label: Column, target: Column, allowed: Column) -> Column:
    """A reply as a plan (a struct), null if it is no JSON object. The caller's target, else its allow-list, decide over the reply's vocabularies; a
    confidence is drawn into [0, 1], 0 if it is no number; without queries the label is asked for, or the term."""
    got = F.from_json(without_fences(reply), REPLY)
    own = F.nullif(F.trim(label), F.lit(""))
    queries = listed(got.expanded_queries)
    queries = F.when(F.size(queries) > 0, queries).otherwise(F.array(F.coalesce(own, F.trim(term))))
    wanted = F.coalesce(upper_list(listed(got.candidate_ontologies)), F.array().cast("array<string>"))
    hard = F.nullif(F.upper(F.trim(target)), F.lit(""))
    allow = upper_list(allowed)
    kept = F.filter(wanted, lambda x: F.array_contains(allow, x))
    first = F.nullif(F.upper(F.trim(got.preferred_ontology)), F.lit(""))
    ontologies = F.when(hard.isNotNull(), F.array(hard)).when(allow.isNull(), wanted).when(F.size(kept) > 0, kept).otherwise(allow)
    inside = F.when(F.coalesce(F.array_contains(allow, first), F.lit(False)), first).otherwise(F.get(kept, F.lit(0)))
    preferred = F.when(hard.isNotNull(), hard).when(allow.isNull(), first).otherwise(inside)
    confidence = F.coalesce(got.confidence.try_cast("double"), F.lit(0.0))
    confidence = F.when(F.isnan(confidence), 0.0).otherwise(F.least(F.greatest(confidence, F.lit(0.0)), F.lit(1.0)))
    text = lambda c: F.nullif(c, F.lit(""))
    plan = F.struct(
        F.coalesce(F.nullif(F.trim(got.normalized_term), F.lit("")), F.trim(term)).alias("normalized_term"), queries.alias("queries"), text(got.inferred_meaning).alias("inferred_meaning"), text(got.semantic_type).alias("semantic_type"),
        ontologies.alias("ontologies"), preferred.alias("preferred"), text(got.reasoning).alias("reasoning"), confidence.alias("confidence"),
    )
    return F.when(F.startswith(without_fences(reply), F.lit("{")) & got.isNotNull() & F.try_parse_json(without_fences(reply)).isNotNull(), plan)


def planned(requests: DataFrame, provider) -> DataFrame:
    """requests with plan, calls (1 or 2), and plan_error where both calls gave nothing. A reply that is empty or no JSON is asked for once more;
    every call's answer is written before it is read, so that none is paid for twice."""
    rows = prompts(requests)
    read = lambda df: df.withColumn("plan", plan_of(F.col("answer.reply"), F.col("term"), F.col("label"), F.col("target"), F.col("allowed")))
    first = written(answered(rows, provider))
    again = written(answered(read(first).where("plan IS NULL").drop("plan", "answer"), provider))
    done = read(first).where("plan IS NOT NULL").withColumn("calls", F.lit(1)).unionByName(read(again).withColumn("calls", F.lit(2)))
    error = F.when(F.col("plan").isNull(), F.coalesce("answer.error", F.lit("no JSON in the reply")))
    return done.withColumn("plan_error", error).drop("prompt")
