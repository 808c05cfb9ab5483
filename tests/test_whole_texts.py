"""Queries that take the whole text of a benchmark row."""

import re

from termloom import queries as Q

DIR = "/root/testdata/sf0.1"


def test_codes_behind_the_eightieth_character(spark):
    texts = {r.item_id: r.text for r in spark.read.parquet(f"{DIR}/benchmark.parquet").collect()}
    got = {r.item_id: r.codes for r in Q.QUERIES["parse_gold_codes"](spark, DIR).collect()}
    assert any(len(t) > 80 for t in texts.values())
    assert got == {i: "|".join(w for w in re.split(" ", t) if w.strip()) for i, t in texts.items()}


def test_calls_have_the_whole_text(spark):
    texts = {r.item_id: r.text.strip() for r in spark.read.parquet(f"{DIR}/benchmark.parquet").collect()}
    got = Q.QUERIES["route_calls"](spark, DIR).where("query_ord = 0").collect()
    assert {r.request_id: r.query for r in got} == texts
