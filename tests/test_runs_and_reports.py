"""Run files, patches, published tables, plans and contracts: errors, edge cases and round trips."""

import json

import pytest
from pyspark.sql import functions as F

from termloom import providers
from termloom.functions import errors
from termloom.operators import baselines, compare, contracts, decide, ordering, patch, planning, retrieve, runs, summaries, validate
from termloom.plans import mapping
from termloom.sources import files
from termloom.sources import runs as R


def test_runs_round_trip(spark, tmp_path):
    empty = R.read_run(spark, str(tmp_path / "none.csv"), R.MODES)
    assert empty.count() == 0 and len(empty.columns) == 58
    rows = spark.createDataFrame([(7, ["a", None, "b", None, None], ["b"], "mapped", 0.25, True), (8, [None] * 5, [], "error", None, None)], "query_id bigint, ranks array<string>, gold array<string>, status string, confidence double, execution_error boolean")
    files.write_csv(R.as_cells(rows), str(tmp_path / "run"))
    back = R.records(R.read_run(spark, str(tmp_path / "run")))
    assert len(back.columns) == 53 + 2 and dict(back.dtypes)["end_to_end_seconds"] == "double"
    got = {r.query_id: (r.ranks, r.gold, r.status, r.confidence, r.execution_error) for r in back.collect()}
    assert got == {7: (["a", None, "b", None, None], ["b"], "mapped", 0.25, True), 8: ([None] * 5, [], "error", None, None)}
    with pytest.raises(ValueError, match="rank_5_code"):
        R.typed(back.drop("rank_5_code"), R.QUERIES)


def test_small_tables(spark, tmp_path):
    (tmp_path / "c.json").write_text(json.dumps({"seed": 42, "gold_count_distribution": {"1": 5, "2": 3}}))
    assert R.read_config(spark, str(tmp_path / "c.json"))["seed"] == 42 and R.read_config(spark, str(tmp_path / "x.json")) is None
    assert sorted(tuple(r) for r in R.read_gold_counts(spark, str(tmp_path / "c.json")).collect()) == [(1, 5), (2, 3)]
    (tmp_path / "cache.csv").write_text("curie,status,source\nHP:1,VALID,OLS4\n,VALID,x\nHP:2,,\n")
    assert [tuple(r) for r in R.read_cache(spark, str(tmp_path / "cache.csv")).collect()] == [("HP:1", "VALID", "OLS4")]
    assert R.read_cache(spark, str(tmp_path / "none")).count() == 0 and R.read_values(spark, str(tmp_path / "none")).count() == 0
    (tmp_path / "pairs.csv").write_text("query_id,source_query,gold_code\n1,a,x\n2,b,y\n")
    (tmp_path / "audit.csv").write_text("query_id,original_mapping_pair_count\n1,1\n2,3\n")
    got = R.read_pairs_with_flag(spark, str(tmp_path / "pairs.csv"), str(tmp_path / "audit.csv"))
    assert {r.query_id: r.single_gold for r in got.collect()} == {"1": True, "2": False}


def test_validation_edges(spark):
    rows = spark.createDataFrame([(1, "mapped", " hp:1 "), (2, "mapped", "HP:9"), (3, "mapped", None), (4, "error", "HP:1"), (5, "mapped", "unknown:unmapped"), (6, "mapped", "UNMAPPED"), (7, "mapped", "GO:1"), (8, "mapped", "old:1")], "id int, status string, mapped_code string")
    vocabulary = spark.createDataFrame([("HP:1",), ("hp:1",), (None,)], "code string")
    cache = spark.createDataFrame([("OLD:1", "VALID", None)], "curie string, status string, source string")
    got = {r.id: (r.validation_status, r.validation_source) for r in validate.validated(rows, vocabulary, cache).collect()}
    assert got == {1: ("VALID", "OLS4"), 2: ("INVALID", "OLS4"), 3: ("NOT_APPLICABLE", None), 4: ("NOT_APPLICABLE", None), 5: ("NOT_APPLICABLE", None), 6: ("INVALID", "UNKNOWN"), 7: ("UNRESOLVED", "OLS4"), 8: ("VALID", None)}
    assert tuple(validate.hallucination(validate.validated(rows, vocabulary).limit(0)).first())[:5] == (0, 0, 0, 0, 0)
    assert validate.validated(rows.limit(0), vocabulary).count() == 0


def test_patches_refuse_to_guess(spark):
    p = spark.createDataFrame([(1, "unmapped"), (1, "unmapped"), (2, "mapped")], "query_id bigint, status string")
    with pytest.raises(patch.PatchError, match="twice"):
        patch.unmapped_subset(p)
    with pytest.raises(patch.PatchError, match="without an id"):
        patch.unmapped_subset(p.withColumn("query_id", F.lit(None).cast("bigint")))
    with pytest.raises(patch.PatchError, match="2 expected"):
        patch.unmapped_subset(p.distinct(), expected=2)
    assert patch.unmapped_subset(p.where("query_id = 2"), expected=0).count() == 0
    scored = spark.createDataFrame([(1, "mapped", ["a"], ["a"], ["x"])], "query_id bigint, status string, ranks array<string>, gold array<string>, gold_labels array<string>")
    with pytest.raises(Exception, match="no canonical query"):
        patch.gold_corrected(scored, scored.where("query_id > 1").select("query_id", "gold", "gold_labels")).collect()
    again = spark.createDataFrame([(2, "c", 1), (2, "d", 2)], "id int, v string, w int")
    base = spark.createDataFrame([(1, "a", 0), (2, "b", 0)], "id int, v string, w int")
    for names in (["id"], ["id", "v"], ["patched"]):  # whichever columns are read
        with pytest.raises(Exception, match="twice"):
            runs.patched(base, again, "id", ["v", "w"]).select(*names).collect()


def test_published_tables_are_checked(spark):
    good = [("A", "t", m, v, 10) for m, v in (("Top-1", 0.1), ("Top-3", 0.2), ("Top-5", 0.3), ("MRR", 0.15))]
    make = lambda rows: spark.createDataFrame(rows, "benchmark string, tool string, metric string, value double, denominator int")
    assert baselines.checked(make(good), benchmarks=["A"], tools=["t"]).first().top5 == 0.3
    for rows, why in ((good[1:], "missing metric"), ([*good, good[0]], "repeated"), ([("B", *good[0][1:]), *good], "unknown benchmark"), ([(*good[0][:3], 1.5, 10), *good[1:]], "malformed"), ([(*good[0][:4], 11), *good[1:]], "denominators")):
        with pytest.raises(baselines.BaselineError, match=why):
            baselines.checked(make(rows), benchmarks=["A"], tools=["t"])
    with pytest.raises(baselines.BaselineError, match="missing benchmark"):
        baselines.checked(make(good), benchmarks=["A", "B"], tools=["t"])
    kinds = [("A", r, 10, 2, 0.2) for r in baselines.RELATIONSHIPS]
    table = lambda rows: spark.createDataFrame(rows, "benchmark string, relationship string, n int, count int, proportion double")
    assert baselines.checked_relationships(table(kinds), ["A"]).count() == 5
    with pytest.raises(baselines.BaselineError, match="add up"):
        baselines.checked_relationships(table([("A", "Same", 10, 3, 0.3), *kinds[1:]]), ["A"])
    q = spark.createDataFrame([("excellent", 0.995), ("good", 1.0)], "quality string, agreement double")
    assert baselines.promotable(q).first().promotable and not baselines.promotable(q.withColumn("agreement", F.lit(None).cast("double"))).first().promotable


class Twice:
    """Gives nothing at first for terms that end with 2, and never for those that end with 3."""

    def complete(self, prompts):
        return [self.reply(p) for p in prompts]

    def __init__(self, folder):
        self.folder = folder

    def reply(self, prompt):
        import os
        import re
        import uuid

        term = re.search("Term: (\\S+)", prompt)[1]
        seen = any(n.startswith(term) for n in os.listdir(self.folder))
        open(f"{self.folder}/{term}-{uuid.uuid4().hex}", "w").close()
        return "" if term.endswith("3") or term.endswith("2") and not seen else json.dumps({"expanded_queries": [term.upper()], "candidate_ontologies": ["HPO", "EFO"]})


def test_plans_are_asked_for_twice_at_most(spark, tmp_path):
    calls = tmp_path / "calls"
    calls.mkdir()
    schema = "request_id bigint, term string, label string, description string, type string, target string, allowed array<string>"
    rows = spark.createDataFrame([(1, "t1", None, " ", "int", None, ["hpo"]), (2, "t2", "l", None, None, "snomed", None), (3, "t3", None, None, None, None, None)], schema)
    got = {r.request_id: r for r in planning.planned(rows, Twice(str(calls))).collect()}
    assert [(got[k].calls, got[k].plan_error) for k in (1, 2, 3)] == [(1, None), (2, None), (2, "no JSON in the reply")]
    assert got[1].plan.ontologies == ["HPO"] and got[2].plan.ontologies == ["SNOMED"] and got[2].plan.preferred == "SNOMED"
    assert len(list(calls.iterdir())) == 5
    prompts = {r.request_id: r.prompt for r in planning.prompts(rows).collect()}
    assert "Only these vocabularies: HPO" in prompts[1] and "Description" not in prompts[1] and "clinical findings" in prompts[2]


def test_mapping_keeps_to_the_allowed_vocabularies(spark):
    schema = "request_id bigint, term string, label string, description string, type string, target string, allowed array<string>"
    rows = spark.createDataFrame([(1, "t", "red ring", None, None, None, ["HPO"]), (2, "t", "red ring", None, None, "MONDO", None), (3, "t", "nothing", None, None, None, None)], schema)
    vocabulary = spark.createDataFrame([("HP:1", "red ring", "HPO"), ("MONDO:1", "red ring", "MONDO"), ("HP:2", "ring", "HPO")], "code string, term string, ontology string")
    got = {r.request_id: r.target_code for r in mapping.mapped(rows, vocabulary).collect()}
    assert got == {1: "HP:1", 2: "MONDO:1", 3: decide.UNMAPPED}


def test_contracts(spark):
    schema = "code string, term string, ontology string, source string, matched_query string, retrieval_mode string, normalized_score double, retrieved_from array<string>"
    rows = spark.createDataFrame([(" HP:1 ", "a", " hpo ", "s", "q", "public", 1.0, ["hp", "HPO", None]), ("HP:1", None, "MONDO", "s", "q", "disabled", 1.5, None)], schema)
    good, bad = contracts.candidates(rows).collect()
    assert (good.code, good.ontology, good.retrieved_from, good.violations) == ("HP:1", "HPO", ["HPO"], [])
    assert bad.violations == ["blank term", "disabled retrieval", "score", "namespace"]
    assert contracts.accepted(contracts.candidates(rows)).count() == 1
    plans = contracts.plans(spark.createDataFrame([(" ", ["a", " A "], 2.0), ("t", [], 0.5)], "term string, allowed array<string>, confidence double")).collect()
    assert [(p.allowed, p.violations) for p in plans] == [(["A"], ["blank term", "confidence"]), (None, [])]
    trace = contracts.traces(spark.createDataFrame([("disabled", None, False, "none"), (None, None, True, "x")], "retrieval_mode string, retrieval_skipped boolean, is_grounded boolean, grounding_source string")).collect()
    assert [(t.retrieval_skipped, t.violations) for t in trace] == [(True, []), (False, [])]


def test_call_settings():
    assert providers.settings_of(None, 0.1, a=1) == (0.1, {"a": 1})
    assert providers.settings_of(providers.CallSettings(force=True, seed=4), 0.1) == (None, {"seed": 4, "force_temperature": True})
    assert providers.settings_of(providers.CallSettings(temperature=0.5, effort="low", strict=True), 0.1) == (0.5, {"reasoning_effort": "low", "strict": True})


def test_named_answers(spark):
    c = F.array(F.struct(F.lit("A:1").alias("code")), F.struct(F.lit("A:2").alias("code")))
    names = ["C2", " C9 ", "A:7", "", None]
    got = spark.createDataFrame([(n,) for n in names], "n string").select(decide.code_of(F.col("n"), c).alias("x")).collect()
    assert [r.x for r in got] == ["A:2", "C9", "A:7", None, None]


def test_lookup_by_rare_words(spark):
    words = ["common", "rare", "odd", "thing"]
    vocabulary = [(f"T:{i:03}", " ".join([words[0], words[i % 3], f"w{i}"]), "A" if i % 2 else "B") for i in range(60)] + [("T:900", "Common, COMMON", "A"), ("T:901", "", "A"), ("T:902", None, "A")]
    asked = [(1, 0, "common rare w4", None), (2, 0, "common", "A"), (3, 0, "w3 w5 w7", "A"), (4, 0, "unseen words", None), (5, 1, "", None), (6, 0, "w4", "A"), (7, 0, "common rare w4", None)]
    sets = lambda t: {w for w in "".join(c if c.isalnum() else " " for c in (t or "").lower()).split()}
    want = set()
    for r, o, q, v in asked:
        scored = [(-len(sets(q) & sets(t)) / len(sets(q) | sets(t)), c) for c, t, own in vocabulary if (v is None or v == own) and sets(q) & sets(t)]
        want |= {(r, o, c, k + 1) for k, (_, c) in enumerate(sorted(scored)[:5])}
    calls = spark.createDataFrame(asked, "request_id int, query_ord int, query string, ontology string")
    got = retrieve.lexical(calls, spark.createDataFrame(vocabulary, "code string, term string, ontology string"), 5)
    assert {(r.request_id, r.query_ord, r.code, r.place) for r in got.collect()} == want


def test_running_values_and_percentiles(spark):
    import numpy as np

    rows = [(k % 3 if k % 7 else None, float((k * 37) % 50) if k % 11 else None) for k in range(400)]
    df = spark.createDataFrame(rows, "g int, x double")
    got = {r.g: (r.a, r.b) for r in ordering.percentiles(df, "x", {"a": 0.5, "b": 0.95}, ["g"]).collect()}
    for g in {g for g, _ in rows}:
        x = [v for h, v in rows if h == g and v is not None]
        assert got[g] == pytest.approx((np.percentile(x, 50), np.percentile(x, 95)))
    assert tuple(runs.telemetry(df.limit(0), ["x"]).first()) == (None, None, None, None, 0)
    best = compare.pareto(spark.createDataFrame([(1, 5.0, 1.0), (2, 5.0, 1.0), (3, 4.0, 2.0), (4, 9.0, 3.0), (5, 9.0, 4.0)], "id int, good double, bad double"), "good", "bad")
    assert sorted(r.id for r in best.collect()) == [1, 2, 4]


def test_error_chains(spark):
    kind = "array<struct<type: string, message: string>>"
    rows = spark.createDataFrame([([("KeyError", None)] * 9 + [("LocalRetrievalError", "far")],), (None,), ([("PublicRetrievalError", " ")],)], f"chain {kind}")
    got = [tuple(r) for r in rows.select(errors.error_stage(F.col("chain")), errors.chain_text(F.col("chain"), 20)).collect()]
    assert got == [("unknown", "KeyError <- KeyEr..."), ("unknown", None), ("pipeline", "PublicRetrievalError")]


def test_summaries_of_nothing(spark):
    none = spark.createDataFrame([], "route string, requests int, retries int, recovered int, final int, source string")
    assert tuple(summaries.retrieval(none).first())[:5] == (0, 0, 0, 0, 0)
    assert summaries.namespaces(none, "route").count() == 0


def test_decisions_by_candidate_and_without_a_choice(spark):
    c = F.array(*[F.struct(F.lit(f"A:{k}").alias("code")) for k in (1, 2, 3)])
    replies = [
        {"selected_code": "A:1", "selected_candidate_id": "C2", "confidence": 0.5},
        {"selected_code": "A:1", "selected_candidate_id": "C1", "confidence": 0.5, "alternatives": [{"code": "C2", "confidence": 0.4}, {"code": "A:3", "confidence": None}]},
        {"is_unmapped": True, "confidence": 0.0, "alternatives": [{"code": "A:2", "confidence": 0.3}, {"code": "C3", "confidence": 0.9}, {"code": "X", "confidence": 0.1}]},
        {"selected_code": "A:2", "confidence": 0.7, "alternative_codes": ["C1", "A:2", "nope"]},
    ]
    rows = spark.createDataFrame([(k, json.dumps(r)) for k, r in enumerate(replies)], "k int, reply string").orderBy("k")
    got = [r.d for r in rows.select(decide.decision(F.col("reply"), c).alias("d")).collect()]
    assert got[0].policy == "code is not the named candidate's" and got[0].alternatives is None
    assert got[1].selected_code == "A:1" and [(a.code, a.confidence) for a in got[1].alternatives] == [("A:2", 0.4)]
    assert got[2].is_unmapped and [a.code for a in got[2].alternatives] == ["A:3", "A:2"]
    assert got[3].selected_code == "A:2" and [(a.code, a.confidence) for a in got[3].alternatives] == [("A:1", 0.0)]


def test_hits_with_lists(spark):
    from termloom.operators import candidates as C

    raw = {"code": "HP:1", "label": "a", "definitions": '[" ", "first", "second"]', "requested_ontology": "efo", "retrieved_from_ontologies": '["hp", "EFO"]'}
    rows = spark.createDataFrame([(1, "EFO", raw), (2, "EFO", {"term": "no code"})], "request_id int, default_ontology string, raw map<string,string>")
    good = C.normalized(rows, mode="local").where("request_id = 1")
    row = C.all_or_error(good).first()
    assert (row.definition, row.retrieved_from, row.source) == ("first", ["HPO", "EFO"], "local_sapbert")
    with pytest.raises(Exception, match="no code"):
        C.all_or_error(C.normalized(rows)).select("request_id").collect()


def test_markdown_of_a_long_table(spark):
    with pytest.raises(ValueError, match="more than 3"):
        files.markdown(spark.range(9), most=3)
