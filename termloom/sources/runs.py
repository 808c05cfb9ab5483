"""Files of finished runs: predictions with their whole declared schemas, read as typed rows and written as cells, and the small tables beside them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.gold import split_codes
from ..schemas import assert_columns, blank_to_null
from .files import read_table

_RANKED = lambda label: ", ".join(f"rank_{k}_code string, rank_{k}_{label} string" + (f", rank_{k}_ontology string" if label == "label" else "") for k in range(1, 6))
_SCORES = "first_gold_rank int, top1_hit boolean, top3_hit boolean, top5_hit boolean, reciprocal_rank double, recall_at_gt double"
_TOKENS = "total_input_tokens bigint, total_cached_input_tokens bigint, total_output_tokens bigint, total_reasoning_tokens bigint, api_cost_usd double"
_RETRIEVAL = "retrieval_request_count bigint, retrieval_retry_count bigint, retrieval_recovered_error_count bigint, retrieval_final_error_count bigint, retrieval_error_sources string, retrieval_error_types string"
_TIMES = "end_to_end_seconds double, {0}planner_seconds double, retrieval_seconds double, reranker_seconds double, llm_seconds double"

#: Predictions for unique queries.
QUERIES = f"""query_id bigint, query string, gold_codes string, gold_labels string, gold_count int, status string, mapped_code string, mapped_term string, mapped_ontology string, confidence double,
{_RANKED("label")}, {_SCORES}, graph_relationship string, graph_matched_gold_code string, execution_error boolean, error_type string, error_stage string, error_message string,
{_TIMES.format("query_")}, {_TOKENS}, {_RETRIEVAL}"""
#: Predictions of one retrieval mode.
MODES = f"""row_id bigint, source_variable string, source_label string, source_description string, target_ontology string, gold_codes string, gold_terms string, retrieval_mode string, status string,
mapped_code string, mapped_code_normalized string, mapped_term string, mapped_ontology string, confidence double, logic_type string, {_RANKED("term")}, {_SCORES}, semantic_correctness boolean,
is_grounded boolean, grounding_source string, selected_code_was_retrieved boolean, retrieval_skipped boolean, validation_status string, validation_source string,
execution_error boolean, error_stage string, error_type string, error_message string, {_TIMES.format("")}, {_TOKENS}, {_RETRIEVAL}"""
#: Raw rows of a model benchmark.
_BY_PART = ", ".join(f"{part}_{kind}tokens bigint" for part in ("planner", "reranker") for kind in ("input_", "cached_input_", "output_", "reasoning_"))
_OTHERS = ", ".join(f"alternative_{k}_code string, alternative_{k}_term string, alternative_{k}_ontology string, alternative_{k}_confidence double" for k in range(1, 5))
MODELS = f"""input_row bigint, source_variable string, source_label string, source_description string, target_ontology string, gold_code_raw string, gold_codes_normalized string, gold_target_term string,
mapped_status string, mapped_code string, mapped_code_normalized string, mapped_term string, mapped_ontology string, confidence double, logic_type string, {_OTHERS}, gold_rank int, top1_correct boolean,
top5_hit boolean, tp double, fp double, fn double, tn double, {_TIMES.format("query_")}, {_BY_PART}, {_TOKENS}, model string, requested_reasoning_effort string, temperature double, temperature_mode string,
seed bigint, retrieval_mode string, max_alternatives int, run_number int, system_fingerprint string, {_RETRIEVAL}, error_type string, error_message string"""


def fields_of(schema: str) -> dict[str, str]:
    """Name -> type of a declared schema."""
    return dict(x.split() for x in schema.replace("\n", " ").split(","))


def exists(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def typed(rows: DataFrame, schema: str) -> DataFrame:
    """Cells of text as typed columns: blanks are null, what can't be read as its type as well; other columns are left out."""
    as_type = lambda c, t: blank_to_null(F.col(c)) if t == "string" else blank_to_null(F.col(c)).try_cast(t)
    return assert_columns(rows, list(fields_of(schema))).select(*[as_type(c, t).alias(c) for c, t in fields_of(schema).items()])


def read_run(spark: SparkSession, path: str | list[str], schema: str = QUERIES) -> DataFrame:
    """The rows of a run's table by a declared schema; a path without files is an empty table."""
    paths = [path] if isinstance(path, str) else path
    if not any(exists(spark, p) for p in paths):
        return spark.createDataFrame([], ", ".join(f"{c} {t}" for c, t in fields_of(schema).items()))
    return typed(read_table(spark, paths, list(fields_of(schema))), schema)


def records(rows: DataFrame, gold: str = "gold_codes") -> DataFrame:
    """Rows with gold (an array) and ranks (five codes, null where there is none) as scores take them."""
    return rows.withColumn("gold", split_codes(F.col(gold), exact=False)).withColumn("ranks", F.array(*[F.col(f"rank_{k}_code") for k in range(1, 6)]))


def as_cells(rows: DataFrame, schema: str = QUERIES) -> DataFrame:
    """Typed rows (also with gold, gold_labels and ranks as arrays) as the cells of a declared schema, in its order; what rows lack is empty."""
    names = set(rows.columns)
    kinds = dict(rows.dtypes)

    def cell(c: str) -> Column:
        k = c.removeprefix("rank_").removesuffix("_code")
        if c in names and not kinds[c].startswith("array"):
            return F.col(c).cast("string")
        if c in names:
            return F.array_join(F.col(c), " | ", "")
        if c == "gold_codes" and "gold" in names:
            return F.array_join("gold", " | ", "")
        if k.isdigit() and c == f"rank_{k}_code" and "ranks" in names:
            return F.get("ranks", F.lit(int(k) - 1))
        return F.lit(None).cast("string")

    return rows.select(*[F.coalesce(cell(c), F.lit("")).alias(c) for c in fields_of(schema)])


def read_config(spark: SparkSession, path: str) -> dict | None:
    """A run's settings, null without a file."""
    import json

    if not exists(spark, path):
        return None
    return json.loads("\n".join(r.value for r in spark.read.text(path, wholetext=True).collect()))


def read_values(spark: SparkSession, path: str) -> DataFrame:
    """A summary's metric and value; an empty table without a file."""
    if not exists(spark, path):
        return spark.createDataFrame([], "metric string, value string")
    return read_table(spark, path, ["metric", "value"]).select("metric", "value")


def read_pairs_with_flag(spark: SparkSession, path: str, audit_path: str) -> DataFrame:
    """A run's mapping pairs with single_gold: whether the query has one pair in the audit table (query_id, original_mapping_pair_count)."""
    pairs = read_table(spark, path, ["query_id", "source_query", "gold_code"])
    single = read_table(spark, audit_path, ["query_id", "original_mapping_pair_count"]).where(F.col("original_mapping_pair_count").try_cast("int") == 1)
    return pairs.join(single.select("query_id", F.lit(True).alias("_one")).distinct(), "query_id", "left").withColumn("single_gold", F.coalesce("_one", F.lit(False))).drop("_one")


def read_relationships(spark: SparkSession, path: str) -> DataFrame:
    """query_id and relationship of a run's table."""
    return read_table(spark, path, ["query_id", "graph_relationship"]).select("query_id", F.col("graph_relationship").alias("relationship"))


def read_gold_counts(spark: SparkSession, path: str) -> DataFrame:
    """gold_count and queries of a dataset's audit (a JSON file with the map gold_count_distribution)."""
    text = spark.read.text(path, wholetext=True)
    held = F.from_json("value", "gold_count_distribution map<string, bigint>").getField("gold_count_distribution")
    return text.select(F.explode(held).alias("gold_count", "queries")).select(F.col("gold_count").cast("int").alias("gold_count"), "queries")


def read_cache(spark: SparkSession, path: str) -> DataFrame:
    """curie, status and source of a validation cache; rows without a code or outcome are left out, and there may be no file."""
    if not exists(spark, path):
        return spark.createDataFrame([], "curie string, status string, source string")
    rows = read_table(spark, path, ["curie", "status", "source"]).select(*[blank_to_null(F.col(c)).alias(c) for c in ("curie", "status", "source")])
    return rows.where("curie IS NOT NULL AND status IS NOT NULL").withColumn("source", F.coalesce("source", F.lit("")))


def read_ids(spark: SparkSession, path: str, key: str = "query_id") -> DataFrame:
    """The distinct ids of a subset; a missing file is an error."""
    return read_table(spark, path, [key]).select(F.col(key).cast("bigint").alias(key)).distinct()


def both_runs(spark: SparkSession, model: str, first: str, second: str) -> DataFrame:
    """A model's two runs with model and run_number, texts without null."""
    rows = [read_run(spark, p, MODELS).withColumns({"model": F.lit(model), "run_number": F.lit(k)}) for k, p in ((1, first), (2, second))]
    return rows[0].unionByName(rows[1]).fillna("", [c for c, t in fields_of(MODELS).items() if t == "string"])
