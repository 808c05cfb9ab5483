"""Payloads: what is packed and read back, and shapes that nobody promised."""

from pyspark.sql import functions as F

from termloom.operators import payload as P


def test_packed_and_read(spark, tmp_path):
    schema = """id int, candidates array<struct<code: string, ontology: string, term: string, normalized_score: double>>,
    decision struct<selected_code: string, confidence: double, alternatives: array<struct<code: string, confidence: double, explanation: string>>>,
    pipeline_timings map<string, double>, pipeline_usage map<string, int>, retrieval_diagnostics struct<retrieval_request_count: int>"""
    some = [("HP:1", "HPO", "one", 0.5), ("HP:2", "HPO", None, None)]
    rows = [
        (1, some, ("HP:2", 0.9, [("HP:1", 0.4, None), ("HP:9", 0.3, None)]), {"total": 1.5}, {"tokens": 7}, (2,)),
        (2, [], (None, 0.0, None), {}, {}, (0,)),
        (3, some, (None, 0.0, [("HP:1", 0.4, None)]), None, None, None),
    ]
    packed = P.packed(spark.createDataFrame(rows, schema))
    packed.write.parquet(str(tmp_path / "x"))
    df = spark.read.parquet(str(tmp_path / "x"))
    assert sorted(tuple(r) for r in P.trace(df, ["id"]).collect()) == [(1, 1, "HP:2", "HPO", 0.9), (1, 2, "HP:1", "HPO", 0.4), (3, 1, "HP:1", "HPO", 0.4)]
    v = F.col("payload")
    has = {c: P.at(v, f"$.rag_debug.{c}", "variant").isNotNull().alias(c) for c in P.BESIDE}
    assert [tuple(r) for r in df.orderBy("id").select(*has.values()).collect()] == [(True, True, True), (False,) * 3, (False,) * 3]
    assert [r[0] for r in df.orderBy("id").select(P.at(v, "$.rag_debug.top_k", "int")).collect()] == [2, 0, 2]
    assert P.packed(spark.createDataFrame([], schema)).count() == 0


def test_evidence(spark):
    inside = lambda text: '{"rag_debug": {"candidates_retrieved": [' + text + "]}}"
    texts = [
        inside('{"is_grounded": true, "grounding_source": "local", "candidate_score_provenance": [{"code": "hp_1", "ontology": "HPO"}, {"code": "", "ontology": "HPO"}, 3], "retrieval_trace": {"retrieval_skipped": true}}'),
        inside('{"retrieval_skipped": null, "retrieval_trace": {"retrieval_skipped": true}, "candidate_count": 4}'),
        inside('"text"'), inside(""), '{"rag_debug": 5}', "[]", "not JSON", "", None,
    ]
    df = spark.createDataFrame(list(enumerate(texts)), "k int, t string")
    e = P.evidence(P.parsed(F.col("t")), F.lit("HP:1"))
    got = [None if r.e is None else (r.e.is_grounded, r.e.grounding_source, r.e.retrieval_skipped, r.e.candidate_codes, r.e.candidate_count, r.e.selected_code_was_retrieved) for r in df.select("k", e.alias("e")).orderBy("k").collect()]
    default = (False, "none", False, [], 0, False)
    assert got[0] == (True, "local", True, ["HP:1"], 1, True)
    assert got[1] == (False, "none", False, [], 4, False)
    assert got[2:6] == [default] * 4
    assert got[6:] == [None] * 3
    assert [r[0] for r in df.where("k = 0").select(P.evidence(P.parsed(F.col("t")), F.lit(None).cast("string"))["selected_code_was_retrieved"]).collect()] == [False]


def test_codes_of_a_payload_are_made_once(spark):
    e = P.evidence(F.col("payload"), F.lit("HP:1"))
    plan = spark.createDataFrame([("{}",)], "t string").select(P.parsed(F.col("t")).alias("payload")).select(e.alias("e"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("candidate_score_provenance, ArrayType") == 1, plan.count("candidate_score_provenance, ArrayType")
