"""Calibration by group beside a plain loop."""

import math

import pytest
from pyspark.errors import PySparkException

from termloom.operators import calibrate


def loop(pairs):
    n = len(pairs)
    bins = {}
    for s, y in pairs:
        bins.setdefault(min(int(s * 10), 9), []).append((s, y))
    ece = sum(len(b) / n * abs(sum(y for _, y in b) / len(b) - sum(s for s, _ in b) / len(b)) for b in bins.values())
    right, wrong = [s for s, y in pairs if y], [s for s, y in pairs if not y]
    wins = [1.0 if a > b else 0.5 if a == b else 0.0 for a in right for b in wrong]
    var = lambda v: sum((x - sum(v) / len(v)) ** 2 for x in v) / (len(v) - 1)
    d = None
    if len(right) > 1 and len(wrong) > 1:
        pooled = math.sqrt(((len(right) - 1) * var(right) + (len(wrong) - 1) * var(wrong)) / (n - 2))
        d = (sum(right) / len(right) - sum(wrong) / len(wrong)) / pooled if pooled else None
    return n, sum(wins) / len(wins) if wins else None, sum((s - y) ** 2 for s, y in pairs) / n, ece, d


def test_groups(spark):
    rows = [("a", "mapped", (k * 37 % 100) / 100, k % 3 == 0) for k in range(60)]
    rows += [("b", "mapped", 1.0, True), ("b", "mapped", 0.5, True), ("b", "mapped", None, False), ("b", "error", 0.1, False)]
    rows += [("c", "unmapped", 0.3, False), (None, "mapped", 0.0, None), (None, "mapped", 0.25, True)]
    df = spark.createDataFrame(rows, "mode string, status string, confidence double, semantic_correctness boolean")
    got = {r["mode"]: tuple(r)[1:] for r in calibrate.summary(df, ["mode"]).select("mode", "calibration_n", "roc_auc", "brier_score", "ece", "cohens_d").collect()}
    assert set(got) == {"a", "b", None}
    for mode, found in got.items():
        want = loop([(s, int(bool(y))) for m, st, s, y in rows if m == mode and st == "mapped" and s is not None])
        assert all(f is None and w is None or abs(f - w) < 1e-12 for f, w in zip(found, want, strict=True)), (mode, found, want)
    assert calibrate.summary(df.limit(0), ["mode"]).count() == 0


def test_confidence_out_of_range(spark):
    df = spark.createDataFrame([("a", "mapped", 1.5, True)], "mode string, status string, confidence double, semantic_correctness boolean")
    with pytest.raises(PySparkException, match="confidence lies outside"):
        calibrate.summary(df, ["mode"]).collect()
