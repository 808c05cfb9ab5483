"""Gold data: canonical queries, mapping pairs, audits."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.identity import code_prefix
from .ordering import numbered


def canonical_queries(pairs: DataFrame, *, query: str = "query", code: str = "code", ord_: str = "ord", label: str | None = None) -> DataFrame:
    """pairs: query, code, ord (a total order), and a label of the code if it is named. A row a query: query_id (dense, by first appearance),
    its distinct codes in order of appearance, each one's first label and ord. Numbers come from running counts in two levels."""
    named = F.col(label).cast("string") if label else F.lit(None).cast("string")
    firsts = pairs.groupBy(F.col(query).alias("query"), F.col(code).alias("code")).agg(F.min(ord_).alias("ord"), F.min_by(named, ord_).alias("label"), F.count("*").alias("copies"))
    per = firsts.groupBy("query").agg(F.array_sort(F.collect_list(F.struct("ord", "code", "label"))).alias("g"), F.min("ord").alias("first_ord"), F.sum("copies").alias("pair_rows"))
    of = lambda f: F.transform("g", lambda x: x[f])
    return numbered(per, "first_ord", ["query"], "query_id").select("query_id", "query", of("code").alias("gold_codes"), of("label").alias("gold_labels"), of("ord").alias("gold_ords"), "first_ord", "pair_rows")


def mapping_pairs(queries: DataFrame) -> DataFrame:
    """A row a query and gold code."""
    return queries.select("query_id", "query", F.size("gold_codes").alias("n_gold"), F.inline(F.arrays_zip(F.col("gold_codes").alias("gold_code"), F.col("gold_ords").alias("ord"))))


def audit(pairs: DataFrame, *, query: str = "query", code: str = "code") -> DataFrame:
    """One row: rows, blanks, extra copies of equal rows, distinct pairs and queries, the most codes of a query."""
    distinct = pairs.groupBy(query, code).agg(F.count("*").alias("n"))
    per = distinct.groupBy(query).agg(F.sum("n").alias("n"), F.count("*").alias("codes"))
    blank = lambda c: F.coalesce(F.trim(F.col(c).cast("string")) == "", F.lit(True))
    blanks = pairs.agg(F.count_if(blank(query)).alias("blank_queries"), F.count_if(blank(code)).alias("blank_codes"))
    sums = per.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("rows"), F.coalesce(F.sum("codes"), F.lit(0)).alias("pairs"), F.count("*").alias("queries"), F.max("codes").alias("most_codes"))
    return sums.join(blanks, F.lit(True)).select("*", (F.col("rows") - F.col("pairs")).alias("extra_copies"))


def cardinality(pairs: DataFrame, *, query: str = "query", code: str = "code") -> DataFrame:
    """How many queries have how many distinct codes."""
    return pairs.groupBy(query).agg(F.count_distinct(code).alias("codes")).groupBy("codes").agg(F.count("*").alias("queries"))


def prefixes(pairs: DataFrame, *, code: str = "code") -> DataFrame:
    """How many rows have codes of each prefix, NONE for those without one."""
    return pairs.groupBy(F.coalesce(code_prefix(F.col(code)), F.lit("NONE")).alias("prefix")).agg(F.count("*").alias("rows"))


def first_rows(rows: DataFrame, keys: list[str], ord_: str) -> DataFrame:
    """The first row of each key by an order, with all its columns."""
    return rows.groupBy(*keys).agg(F.min_by(F.struct(*[c for c in rows.columns if c not in keys]), ord_).alias("_first")).select(*keys, "_first.*")
