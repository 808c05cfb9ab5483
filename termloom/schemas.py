"""Schemas of the engine's rows, and checks of columns and values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

REQUEST = "request_id bigint, term string, label string, description string, type string, entity_type string, target string, allowed array<string>, mode string"
CANDIDATE = "request_id bigint, ord bigint, code string, term string, ontology string, definition string, source string, matched_query string, raw_score double, normalized_score double, retrieved_from array<string>"
DECISION = "request_id bigint, selected_code string, is_unmapped boolean, is_grounded boolean, confidence double, reasoning string, alternatives array<struct<code: string, confidence: double, explanation: string>>"
PREDICTION = "query_id bigint, query string, gold_codes string, status string, rank_1_code string, rank_2_code string, rank_3_code string, rank_4_code string, rank_5_code string"
EDGE = "subject string, object string"


def assert_columns(df: DataFrame, required: list[str]) -> DataFrame:
    """df, if it has the required columns; more may follow."""
    missing = [c for c in required if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return df


def blank_to_null(c: Column, *, more: tuple[str, ...] = ()) -> Column:
    """The trimmed text; null for blanks and for words that stand for nothing."""
    t = F.trim(c.cast("string"))
    return F.when(~F.lower(t).isin("", "nan", "none", "null", *more), t)


def violations(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """df with violations: the names of the rules (conditions of validity) that a row breaks; a null condition is broken."""
    return df.withColumn("violations", F.array_compact(F.array(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in rules.items()])))


def hard_fail(value: Column, ok: Column, message: str) -> Column:
    """value; a row for which ok doesn't hold ends the job."""
    return F.when(F.coalesce(ok, F.lit(False)), value).otherwise(F.raise_error(F.lit(message)))
