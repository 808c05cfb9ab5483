"""Candidates: raw hits made uniform, duplicates merged, filtered by eligibility, sorted, cut."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.identity import blank, canonical, eligible, inconsistency, resolved
from ..functions.numbers import clamp_unit

# Where a raw hit may hold a field, the first non-blank one counts.
KEYS = {
    "code": ["code", "id", "curie", "iri", "concept_id", "loinc_num", "rxnorm_id", "icd10_code"], "term": ["term", "label", "name", "display", "preferred_label"],
    "ontology": ["ontology", "ontology_id", "ontology_prefix", "source_ontology"], "definition": ["definition", "description", "meaning", "definitions"],
    "source": ["source", "source_name", "endpoint", "retriever"], "score": ["score", "raw_score", "similarity", "confidence"],
}


def items(value: Column) -> Column:
    """The non-blank items of a value that is a JSON list, or the value alone."""
    text = blank(value)
    held = F.when(F.startswith(text, F.lit("[")), F.from_json(text, "array<string>"))
    return F.filter(F.transform(F.coalesce(held, F.array(text)), blank), lambda x: x.isNotNull())


def first_of(raw: Column, keys: list[str], lists: bool = False) -> Column:
    """The first non-blank value of a map's keys; with lists the first item of a value that is a JSON list."""
    value = lambda k: F.try_element_at(raw, F.lit(k))
    return F.coalesce(*[F.get(items(value(k)), F.lit(0)) if lists else blank(value(k)) for k in keys])


def search_spaces(raw: Column) -> Column:
    """Where a hit was found: the listed vocabularies, then the requested one, canonical, each once."""
    value = lambda k: F.try_element_at(raw, F.lit(k))
    return F.array_distinct(F.array_compact(F.transform(F.concat(items(value("retrieved_from_ontologies")), F.array(value("requested_ontology"))), canonical)))


def normalized(hits: DataFrame, *, raw: str = "raw", mode: str = "public") -> DataFrame:
    """hits: request_id, ord, matched_query, default_ontology and raw, a map of texts. Adds a candidate's fields and error,
    why a hit can't be one (null for good rows), so that bad rows go to a dead-letter table and not away."""
    r = F.col(raw)
    out = hits.select(
        "*",
        *[first_of(r, KEYS[k]).alias(f"_{k}") for k in ("code", "term", "ontology", "source")],
        first_of(r, KEYS["definition"], lists=True).alias("definition"),
        F.coalesce(*[F.try_element_at(r, F.lit(k)).try_cast("double") for k in KEYS["score"]]).alias("raw_score"),
        F.try_element_at(r, F.lit("normalized_score")).try_cast("double").alias("_given"),
        blank(F.try_element_at(r, F.lit("iri"))).alias("_iri"),
        search_spaces(r).alias("retrieved_from"),
    )
    out = out.withColumn("_id", resolved(F.col("_code"), F.col("_iri"), F.col("_ontology"), F.col("default_ontology")))
    error = F.when(F.col("_code").isNull(), "no code").when(F.col("_term").isNull(), "no term").when(F.col("_id").isNull(), "no consistent identity")
    return out.select(
        *hits.columns, F.col("_id.code").alias("code"), F.col("_term").alias("term"), F.col("_id.ontology").alias("ontology"), "definition",
        F.coalesce("_source", F.lit("public_api" if mode == "public" else "local_sapbert")).alias("source"), "raw_score",
        F.coalesce(clamp_unit(F.col("_given")), clamp_unit(F.col("raw_score"))).alias("normalized_score"), "retrieved_from", error.alias("error"),
    )


def all_or_error(rows: DataFrame) -> DataFrame:
    """The candidates of rows of normalized(); one that can't be a candidate ends the job, whichever columns are read."""
    bad = F.raise_error(F.concat(F.lit("a hit can't be a candidate: "), F.col("error"))).cast("boolean")
    return rows.where(F.when(F.col("error").isNull(), True).otherwise(bad)).drop("error")


def within_error_limit(rows: DataFrame, key: str = "request_id", limit: float = 0.5) -> DataFrame:
    """Good rows of requests of which at most the limit's share failed; a failed share counts by partial aggregates."""
    bad = rows.groupBy(key).agg(F.avg(F.col("error").isNotNull().cast("double")).alias("bad")).where(F.col("bad") > limit)
    return rows.where(F.col("error").isNull()).join(bad, key, "left_anti")


def merged(candidates: DataFrame, *, key: str = "request_id", targets: Column | str | None = None, strict: bool = False, limit: int | None = None) -> DataFrame:
    """Duplicates (of vocabulary and upper-cased code) become their best row, which keeps where all of them were found; then
    eligibility, order and limit. targets: an array of vocabularies, null for any; as a name, a column of a request's rows."""
    good = candidates.where(inconsistency(F.col("ontology"), F.col("code"), F.lit(None).cast("string")).isNull())
    best = F.struct(
        F.col("normalized_score").isNull().alias("a"), (-F.coalesce("normalized_score", F.lit(0.0))).alias("b"), F.col("raw_score").isNull().alias("c"),
        (-F.coalesce("raw_score", F.lit(0.0))).alias("d"), F.coalesce(F.col("definition") == "", F.lit(True)).alias("e"), F.col("ord").alias("f"),
    )
    fields = [c for c in candidates.columns if c not in (key, "ontology", "retrieved_from")]  # a column of targets as well
    group = [key, "ontology", "_code"]
    # rows that were found alike first, so that a group holds no more than the ways in which its code was found
    alike = good.groupBy(key, "ontology", F.upper("code").alias("_code"), "matched_query", F.col("retrieved_from").alias("_from")).agg(
        F.min(best).alias("_key"), F.min_by(F.struct(*fields), best).alias("_best"), F.count("*").alias("_n"), F.min("ord").alias("_ord")
    )
    one = alike.groupBy(*group).agg(
        F.min_by("_best", "_key").alias("_best"),
        F.sum("_n").alias("duplicate_count"),
        F.min("_ord").alias("first_ord"),
        F.array_sort(F.collect_list(F.struct("_ord", "matched_query", "_from"))).alias("_all"),
    )
    one = one.select(
        key, "ontology", *[F.col(f"_best.{c}").alias(c) for c in fields], "duplicate_count", "first_ord",
        F.array_distinct(F.transform("_all", lambda x: x.matched_query)).alias("matched_queries"),
        F.array_distinct(F.flatten(F.transform("_all", lambda x: F.coalesce(x._from, F.array().cast("array<string>"))))).alias("retrieved_from"),
    )
    if targets is not None:
        one = one.where(eligible(F.col("ontology"), F.col("retrieved_from"), F.col(targets) if isinstance(targets, str) else targets, strict=strict))
    return ranked(one, key, limit)


def ranked(candidates: DataFrame, key: str = "request_id", limit: int | None = None) -> DataFrame:
    """Adds rank: by normalized score, raw score (each the higher the better, nulls last), term, first appearance."""
    order = Window.partitionBy(key).orderBy(F.desc_nulls_last("normalized_score"), F.desc_nulls_last("raw_score"), "term", "first_ord")
    out = candidates.withColumn("rank", F.row_number().over(order))
    return out if limit is None else out.where(F.col("rank") <= limit)
