"""Exponents beyond 1, and limits that no exponent meets."""

import math

import pytest

from termloom.llm import mixing

TOKENS = {"a": 600, "b": 300, "c": 100}


def docs(spark, tokens=TOKENS):
    return spark.createDataFrame(list(tokens.items()), "source string, tokens bigint")


def entropy(rows):
    return -sum(r.weight * math.log2(r.weight) for r in rows if r.weight > 0)


@pytest.mark.parametrize("target", [1.5, 1.2, 0.5, 0.01])
def test_entropy_on_both_sides_of_the_corpus(spark, target):
    rows = mixing.weights(docs(spark), entropy=target).collect()
    assert abs(entropy(rows) - target) < 1e-6 and (rows[0].exponent > 1) == (target < 1.295)


def test_entropy_that_no_exponent_gives(spark):
    with pytest.raises(Exception, match="no exponent gives"):
        mixing.weights(docs(spark, {"a": 500, "b": 500, "c": 1}), entropy=0.5).collect()


def test_budget_beyond_the_limit(spark):
    assert {r.weight for r in mixing.weights(docs(spark), max_repeats=2, budget_tokens=2000).collect()} == {0.6, 0.3, 0.1}
    with pytest.raises(Exception, match="more than 2"):
        mixing.weights(docs(spark), max_repeats=2, budget_tokens=2100).collect()
    assert mixing.weights(docs(spark).limit(0)).count() == 0
