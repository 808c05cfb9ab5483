"""From a request to the lookups it needs: its queries, the vocabularies to search, and the source of each."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..dims import ROUTES
from ..functions.identity import canonical


def queries_of(expanded: Column, *fallbacks: Column) -> Column:
    """The expanded queries, trimmed, distinct, in order; without any the first non-blank fallback."""
    own = F.array_distinct(F.filter(F.transform(F.coalesce(expanded, F.array().cast("array<string>")), lambda x: F.trim(x)), lambda x: x != ""))
    one = F.coalesce(F.lit(None).cast("string"), *[F.nullif(F.trim(c), F.lit("")) for c in fallbacks])
    return F.when(F.size(own) > 0, own).otherwise(F.array_compact(F.array(one)))


def ontologies_of(target: Column, preferred: Column, candidates: Column, allowed: Column) -> Column:
    """A hard target alone (nothing, if the allow-list lacks it); else the preferred and candidate vocabularies that are
    allowed; else the whole allow-list."""
    empty = F.array().cast("array<string>")
    allow = F.transform(allowed, canonical)
    want = F.array_distinct(F.array_compact(F.transform(F.concat(F.array(preferred), F.coalesce(candidates, empty)), canonical)))
    kept = F.when(allow.isNull(), want).otherwise(F.filter(want, lambda x: F.array_contains(allow, x)))
    hard = F.when(allow.isNull() | F.array_contains(allow, canonical(target)), F.array(canonical(target))).otherwise(empty)
    return F.when(canonical(target).isNotNull(), hard).when(F.size(kept) > 0, kept).otherwise(F.coalesce(F.array_distinct(allow), empty))


def routes(spark: SparkSession) -> DataFrame:
    """alias, ontology, source_id, source_ontology: constant rows; an alias of two vocabularies is an error."""
    rows, seen = [], {}
    for key, (source, own, aliases) in ROUTES.items():
        for alias in dict.fromkeys([key.upper(), *aliases]):
            if seen.setdefault(alias, key) != key:
                raise ValueError(f"{alias} stands for {seen[alias]} and {key}")
            rows.append((alias, key, source, own or key))
    return spark.createDataFrame(rows, "alias string, ontology string, source_id string, source_ontology string")


def calls(plans: DataFrame) -> DataFrame:
    """plans: request_id, queries, ontologies (arrays). A row a query and vocabulary, in order, with its source; supported is
    false for a vocabulary that no source serves. Without vocabularies a query is one broad search."""
    spread = plans.select("request_id", F.posexplode("queries").alias("query_ord", "query"), "ontologies")
    spread = spread.select("request_id", "query_ord", "query", F.posexplode_outer("ontologies").alias("onto_ord", "asked"))
    table = F.broadcast(routes(plans.sparkSession))
    out = spread.join(table, F.upper(F.col("asked")) == F.col("alias"), "left")
    return out.select("request_id", "query_ord", "query", F.coalesce("onto_ord", F.lit(0)).alias("onto_ord"), "asked", "ontology", "source_id", "source_ontology", (F.col("asked").isNull() | F.col("source_id").isNotNull()).alias("supported"))
