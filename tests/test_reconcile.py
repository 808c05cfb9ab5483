"""Runs that aren't complete or aren't what they state are refused by name; others are committed."""

import pytest

from termloom.operators import reconcile, summaries
from termloom.sources.versions import VersionedTable

SCHEMA = """mode string, status string, top1 boolean, top3 boolean, top5 boolean, rr double, recall double, mapped_code string, was_retrieved boolean, validation_status string,
confidence double, semantic_correctness boolean, end_to_end_seconds double, llm_seconds double, api_cost_usd double"""


def rows_of(spark):
    kinds = ("VALID", "INVALID", "UNRESOLVED")
    data = []
    for k in range(90):
        status = "error" if k % 10 == 0 else "unmapped" if k % 7 == 0 else "mapped"
        data.append(("ab"[k % 2], status, k % 3 == 0, k % 3 < 2, True, 1 / (k % 5 + 1), (k % 4) / 4 if k % 9 else None, f"HP:{k}" if status == "mapped" else None, k % 4 == 0,
                     kinds[k % 3] if status == "mapped" else "NOT_APPLICABLE", (k * 17 % 53) / 53 if k % 11 else None, k % 3 == 0, k / 10, k / 20 if k % 6 else None, k / 1000))
    return spark.createDataFrame(data, SCHEMA)


def stated_by(spark, rows):
    names = (*reconcile.COUNTS, *summaries.COMPARED)
    return {r["mode"]: {c: r[c] for c in names} for r in summaries.mode_summary(rows, ["mode"]).collect()}


def test_commit(spark, tmp_path):
    rows = rows_of(spark)
    stated = stated_by(spark, rows)
    table = VersionedTable(spark, str(tmp_path / "run"))
    configs = {"a": {"completed": True, "seed": 1}, "b": {"completed": True, "seed": 1}}
    assert reconcile.commit(table, rows, stated, configs=configs, fields=("seed",)) == 1
    folders = sorted(p.name for p in (tmp_path / "run").iterdir())
    wrong = {m: {c: v * 1.01 if c in ("mrr", "roc_auc", "ece", "cohens_d") and m == "b" else v for c, v in of.items()} for m, of in stated.items()}
    with pytest.raises(reconcile.Refused) as e:
        reconcile.commit(table, rows, wrong)
    assert sorted(p.split(" is ")[0] for p in e.value.problems) == ["b: cohens_d", "b: ece", "b: mrr", "b: roc_auc"]
    with pytest.raises(reconcile.Refused, match="45 rows of no stated mode"):
        reconcile.commit(table, rows, {"a": stated["a"]})
    assert table.version() == 1 and table.read().count() == 90
    assert sorted(p.name for p in (tmp_path / "run").iterdir()) == folders


def test_gate():
    good = {"completed": True, "seed": 1}
    assert reconcile.gate({"a": good, "b": good}, ["seed"]) == []
    assert reconcile.gate({"a": good, "b": {"seed": 2}}, ["seed"]) == ["b: not completed", "b: seed differs from a"]
    assert reconcile.gate({"a": {"completed": "yes"}}, []) == ["a: not completed"]


def test_differences():
    one = {name: 0.5 for name in (*reconcile.COUNTS, *summaries.COMPARED)}
    assert len(one) == 20 and reconcile.differences(one, one) == {}
    for name in one:
        assert reconcile.differences(one, one | {name: 0.50001}) == {name: (0.5, 0.50001)}
        assert reconcile.differences(one, one | {name: None}) == {name: (0.5, None)}
        assert reconcile.differences(one | {name: None}, one) == {name: (None, 0.5)}
        assert reconcile.differences(one | {name: None}, one | {name: None}) == {}
        assert reconcile.differences(one, one | {name: 0.5 * (1 + 1e-7)}) == {}
    assert reconcile.differences(one, one | {"other": 1.0}) == {"other": (None, 1.0)}


def test_model_problems(spark):
    raw = spark.createDataFrame(
        [("m", r, "error" if r == 2 and k == 0 else "mapped", 1.0, 0.0, 0.0, True, True) for r in (1, 2) for k in range(4)],
        "model string, run_number int, mapped_status string, tp double, fp double, fn double, top1_correct boolean, top5_hit boolean",
    )
    run = "model string, run_number int, error_count int, weighted_precision double, weighted_recall double, weighted_f1 double, top1_accuracy double, top5_hit_rate double"
    model = "model string, combined_api_cost_usd double, mean_api_cost_per_term_usd double"
    good = [("m", 1, 0, 1.0, 1.0, 1.0, 1.0, 1.0), ("m", 2, 1, 0.3, 0.3, 0.3, 0.3, 0.3)]
    cost = spark.createDataFrame([("m", 8.0, 1.0)], model)
    found = lambda runs, models, n=4: sorted((r.run, r.problem) for r in reconcile.model_problems(raw, spark.createDataFrame(runs, run), models, rows_per_run=n).collect())
    assert found(good, cost) == []
    assert found(good, cost, 5) == [(1, "rows"), (2, "rows")]
    bad = [("m", 1, 0, 1.0, 1.0, 0.9, 1.0, 1.0), ("m", 2, 2, 1.0, 1.0, 1.0, 1.0, 1.0), ("m", 3, 0, 1.0, 1.0, 1.0, 1.0, 1.0)]
    assert found(bad, cost) == [(1, "weighted_f1"), (2, "error_count"), (3, "no rows")]
    assert found(good[:1], cost) == [(2, "not reported")]
    (row,) = reconcile.model_problems(raw, spark.createDataFrame(good, run), spark.createDataFrame([("m", 8.0, 1.1)], model)).collect()
    assert tuple(row) == ("m", None, "mean_api_cost_per_term_usd", 1.0, 1.1)
