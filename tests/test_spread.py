"""Heavy work a row doesn't stay in the one task that reads a small file."""

from pyspark.sql import functions as F

from termloom.operators import abbreviations, summaries, validate
from termloom.plans import disabled


def tasks(df):
    return df.select(F.spark_partition_id().alias("p")).distinct().count()


def one_file(spark, tmp_path, rows, schema):
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / "t"))
    return spark.read.parquet(str(tmp_path / "t"))


def test_replies_are_read_by_many_tasks(spark, tmp_path):
    reply = '{"target_code": "HP:%d", "target_term": "t", "ontology": "HPO", "confidence": 0.5}'
    rows = one_file(spark, tmp_path, [(i, None, None, reply % i, None) for i in range(400)], "request_id int, target string, allowed array<string>, reply string, error string")
    got = disabled.results(rows)
    assert tasks(got) > 1
    assert sorted((r.request_id, r.target_code) for r in got.collect()) == [(i, f"HP:{i}") for i in range(400)]


def test_rows_without_a_code_dont_meet_in_one_task(spark):
    rows = spark.createDataFrame([(i, "unmapped" if i % 4 else "mapped", None if i % 3 else f"HP:{i}") for i in range(4000)], "id int, status string, mapped_code string")
    codes = spark.createDataFrame([(f"HP:{i}",) for i in range(0, 4000, 2)], "code string")
    kept = {k: spark.conf.get(k) for k in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.enabled")}
    for k, v in zip(kept, ("-1", "false"), strict=True):
        spark.conf.set(k, v)
    try:
        out = validate.validated(rows, codes)
        most = out.groupBy(F.spark_partition_id()).count().agg(F.max("count")).first()[0]
        got = {r.validation_status: r["count"] for r in out.groupBy("validation_status").count().collect()}
    finally:
        for k, v in kept.items():
            spark.conf.set(k, v)
    assert most < 1500  # of 4000 over 8 tasks
    assert got == {"NOT_APPLICABLE": 4000 - 334, "VALID": 334}


def test_pairs_are_aligned_by_many_tasks(spark, tmp_path):
    rows = one_file(spark, tmp_path, [(i, f"alpha beta{i} (AB)") for i in range(400)], "k int, t string")
    got = abbreviations.definitions(rows, "t", ["k"])
    assert tasks(got) > 1
    assert sorted((r.k, r.short, r.long) for r in got.collect()) == [(i, "AB", f"alpha beta{i}") for i in range(400)]


def test_a_summary_evaluates_its_rows_once(spark):
    seen = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def told(i):
        seen.add(1)
        return "mapped" if i % 3 else "unmapped"

    i = F.col("id")
    of = {"mode": F.lit("a"), "status": told(i), **{f"top{k}": i % (k + 1) == 0 for k in (1, 3, 5)}, "rr": i / 90, "recall": i / 90, "mapped_code": F.lit("c"), "was_retrieved": i % 2 == 0, "validation_status": F.lit("VALID")}
    of |= {"confidence": i / 100, "semantic_correctness": i % 2 == 0, "end_to_end_seconds": i / 10, "llm_seconds": i / 20, "api_cost_usd": i / 1000}
    rows = spark.range(90).select(*[c.alias(n) for n, c in of.items()])
    got = summaries.mode_summary(rows, ["mode"]).collect()
    assert [(r.n, r.mapped_count, r.calibration_n) for r in got] == [(90, 60, 60)]
    assert seen.value == 90
