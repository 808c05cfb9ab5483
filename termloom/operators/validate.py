"""Whether predicted codes exist: checked against a vocabulary table and what earlier passes have found, summed up as rates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.identity import normalized_code
from ..functions.numbers import rate
from ..schemas import blank_to_null

# Outcomes of a check, and codes that stand for no mapping.
VALID, INVALID, UNRESOLVED, NOT_APPLICABLE = "VALID", "INVALID", "UNRESOLVED", "NOT_APPLICABLE"
UNMAPPED, SENTINELS = "UNKNOWN:UNMAPPED", ("UNMAPPED", "ERROR", "NONE", "UNKNOWN")
# Which service answers for a prefix.
SOURCES = {
    "LOINC-FHIR": ("LOINC",), "RxNav": ("RXNORM", "RXCUI"), "NIH-ClinicalTables": ("ICD10", "ICD10CM"),
    "OLS4": ("HP", "HPO", "MONDO", "NCIT", "SNOMED", "SNOMEDCT", "SNOMED-CT", "UO", "UBERON", "CHEBI", "GO", "DOID", "MESH"),
}


def curie(code: Column) -> Column:
    """A code in canonical form, whatever the spelling of its vocabulary (HPO:1, hp_1 and HP:1 are one), in upper case."""
    return F.upper(normalized_code(F.trim(code), F.lit(None).cast("string")))


def prefix(code: Column) -> Column:
    """What stands before the first colon of an upper-cased code; all of it without one."""
    return F.trim(F.split_part(code, F.lit(":"), F.lit(1)))


def source_of(code: Column) -> Column:
    """The service that answers for a code's prefix."""
    out = F.lit("UNKNOWN")
    for name, prefixes in SOURCES.items():
        out = F.when(prefix(curie(code)).isin(*prefixes), name).otherwise(out)
    return out


def dispatched(code: Column) -> Column:
    """For an upper-cased code: false if it can't be one, null if no service knows its prefix, else true (it is to be looked up)."""
    known = [p for prefixes in SOURCES.values() for p in prefixes]
    bad = F.coalesce(code == "", F.lit(True)) | ~F.contains(code, F.lit(":")) | code.isin(*SENTINELS)
    return F.when(bad, False).when(prefix(code).isin(*known), True)


def validated(rows: DataFrame, vocabulary: DataFrame, cache: DataFrame | None = None, *, status: str = "status", code: str = "mapped_code") -> DataFrame:
    """rows with validation_status and validation_source. vocabulary: code, every existing one; a prefix that it has no code of can't be
    resolved. cache: curie, status, source of earlier passes, which decide where they have a code. Rows that aren't mapped don't apply."""
    asked = curie(F.col(code))
    applies = (F.col(status) == "mapped") & blank_to_null(F.col(code)).isNotNull() & (asked != UNMAPPED)
    rows = rows.withColumn("_curie", F.when(F.coalesce(applies, F.lit(False)), asked))
    codes = rows.where("_curie IS NOT NULL").select("_curie").distinct()
    there = vocabulary.select(curie(F.col("code")).alias("_curie"), F.lit(True).alias("_there")).distinct()
    covered = there.select(prefix(F.col("_curie")).alias("_prefix"), F.lit(True).alias("_covered")).distinct()
    codes = codes.withColumn("_prefix", prefix(F.col("_curie"))).join(there, "_curie", "left").join(covered, "_prefix", "left")
    sent = dispatched(F.col("_curie"))
    found = F.when(~sent, INVALID).when(sent.isNull() | F.col("_covered").isNull(), UNRESOLVED).when(F.col("_there"), VALID).otherwise(INVALID)
    codes = codes.select("_curie", found.alias("_found"), source_of(F.col("_curie")).alias("_source"))
    if cache is not None:
        old = cache.select(curie(F.col("curie")).alias("_curie"), F.struct("status", "source").alias("old")).groupBy("_curie").agg(F.min("old").alias("old"))
        codes = codes.join(old, "_curie", "left").select("_curie", F.coalesce("old.status", "_found").alias("_found"), F.when(F.col("old").isNotNull(), F.col("old.source")).otherwise(F.col("_source")).alias("_source"))
    # rows without a code go by what else they have, so that they don't meet in one task as the rows of a null; a code never starts with a space
    plain = [F.col(f"`{c}`") for c, kind in rows.dtypes if "<" not in kind and kind != "variant"]
    rows = rows.withColumn("_curie", F.coalesce("_curie", F.concat(F.lit(" "), F.xxhash64(*plain).cast("string"))))
    out = rows.join(codes, "_curie", "left")
    return out.withColumn("validation_status", F.coalesce("_found", F.lit(NOT_APPLICABLE))).withColumn("validation_source", F.col("_source")).drop("_curie", "_found", "_source")


def cache_of(rows: DataFrame, *, code: str = "mapped_code") -> DataFrame:
    """curie, status and source of every code that a pass has checked, for the next one."""
    checked = rows.where(F.col("validation_status") != NOT_APPLICABLE)
    return checked.select(curie(F.col(code)).alias("curie"), F.col("validation_status").alias("status"), F.col("validation_source").alias("source")).distinct()


def cache_stats(cache: DataFrame) -> DataFrame:
    """How many codes a cache has, by outcome."""
    n = lambda s: F.count_if(F.col("status") == s)
    return cache.agg(F.count("*").alias("total"), n(VALID).alias("valid"), n(INVALID).alias("invalid"), n(UNRESOLVED).alias("unresolved"))


def hallucination(rows: DataFrame, by: list[str] | None = None, *, status: str = "status", outcome: str = "validation_status") -> DataFrame:
    """Counts of outcomes; invalid ones among those that could be told, those among mapped ones, and unresolved among mapped ones, null
    where nothing is to be divided by."""
    n = lambda *s: F.count_if(F.col(outcome).isin(*s))
    out = rows.groupBy(*(by or [])).agg(
        F.count_if(F.col(status) == "mapped").alias("mapped"), n(VALID).alias("valid"), n(INVALID).alias("invalid"), n(UNRESOLVED).alias("unresolved"), n(NOT_APPLICABLE).alias("not_applicable")
    )
    told = F.col("valid") + F.col("invalid")
    return out.select("*", rate(F.col("invalid"), told).alias("hallucination_rate"), rate(told, F.col("mapped")).alias("coverage"), rate(F.col("unresolved"), F.col("mapped")).alias("unresolved_rate"))


def grounded(rows: DataFrame, candidates: DataFrame, *, key: str = "request_id", code: str = "mapped_code") -> DataFrame:
    """rows with was_retrieved: whether a candidate of the request has the code (null without a code)."""
    own = candidates.select(F.col(key).alias("_key"), curie(F.col("code")).alias("_code")).distinct().withColumn("_hit", F.lit(True))
    joined = rows.join(own, (F.col(key) == F.col("_key")) & (curie(F.col(code)) == F.col("_code")), "left")
    return joined.withColumn("was_retrieved", F.when(blank_to_null(F.col(code)).isNotNull(), F.coalesce("_hit", F.lit(False)))).drop("_key", "_code", "_hit")


def grounding(rows: DataFrame, by: list[str] | None = None, *, status: str = "status", flag: str = "was_retrieved") -> DataFrame:
    """Mapped rows, those whose code was retrieved, and their share, null without mapped rows."""
    mapped = F.col(status) == "mapped"
    out = rows.groupBy(*(by or [])).agg(F.count_if(mapped).alias("mapped"), F.count_if(mapped & F.coalesce(flag, F.lit(False))).alias("grounded"))
    return out.withColumn("grounding_rate", rate(F.col("grounded"), F.col("mapped")))


def violations_of_namespace(rows: DataFrame, code: str, target: str) -> DataFrame:
    """Rows whose code names another vocabulary than the one asked for: found and expected."""
    from ..functions.identity import canonical, namespace

    out = rows.withColumn("found", namespace(F.col(code))).withColumn("expected", canonical(F.col(target)))
    return out.where("found <> expected")
