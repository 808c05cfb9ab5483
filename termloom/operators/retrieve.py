"""Lookups: exact and lexical search of a vocabulary table, and exact nearest neighbours of embeddings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numbers import positional
from .store import written
from .vector_index import VectorIndex, new_path


def words(c: Column) -> Column:
    """Distinct words in lower case."""
    return F.array_distinct(F.filter(F.split(F.lower(c), r"[^\p{L}\p{N}]+"), lambda x: x != ""))


def lexical(calls: DataFrame, vocabulary: DataFrame, k: int) -> DataFrame:
    """calls: request_id, query_ord, query, ontology; vocabulary: code, term, ontology. Per call the k terms that share most words with
    the query, by the share of the union, then code; scored by place. Calls without an ontology search all vocabularies.

    Equal sets of words are looked up once, on both sides. A set meets first the terms with its rarest word; the k-th best of these is a
    bound: a better term shares so many words that it has one of the set's few rarest ones, and only these are joined then. So
    a word that many terms share is joined for the sets that nothing rarer tells apart.
    """
    q = calls.select("request_id", "query_ord", F.col("ontology").alias("asked"), F.array_sort(words(F.col("query"))).alias("qw"))
    q = q.where(F.size("qw") > 0).withColumn("qid", F.md5(F.concat_ws("\n", F.coalesce("asked", F.lit("\n")), F.array_join("qw", " "))))
    v = vocabulary.select("code", "term", "ontology", F.array_sort(words(F.col("term"))).alias("vw")).where(F.size("vw") > 0)
    # of terms with equal words the k first codes can be among a query's best
    v = v.withColumn("_nth", F.row_number().over(Window.partitionBy("ontology", "vw").orderBy("code", "term"))).where(F.col("_nth") <= k)
    listed = F.array_sort(F.collect_list(F.struct("code", "term")))  # k at most
    # each table is read and split into words once; all that follows reads these sets
    sets = written(v.groupBy("ontology", "vw").agg(listed.alias("terms")).withColumn("vid", F.monotonically_increasing_id()))
    q = written(q)
    of_word = sets.select("vid", "ontology", "vw", F.col("terms")[0].code.alias("first"), F.size("terms").alias("codes"), F.explode("vw").alias("word"))
    often = of_word.groupBy("word").agg(F.count("*").alias("often"))
    asked = q.groupBy("qid", "asked", "qw").agg(F.lit(1).alias("_one")).drop("_one")
    each = asked.select("qid", F.explode("qw").alias("word")).join(often, "word", "left")
    rare = each.groupBy("qid").agg(F.array_sort(F.collect_list(F.struct(F.coalesce("often", F.lit(0)).alias("often"), "word"))).alias("rare"))
    asked = written(asked.join(rare, "qid"))
    known = F.filter("rare", lambda w: w.often > 0)
    least = best_sets(asked.select("qid", "asked", "qw", F.slice(known, 1, 1).alias("by")), of_word, k)
    up_to = F.sum("codes").over(Window.partitionBy("qid").orderBy(F.desc("score"), "first").rowsBetween(Window.unboundedPreceding, -1))
    least = least.withColumn("before", F.coalesce(up_to, F.lit(0))).groupBy("qid").agg(F.sum("codes").alias("found"), F.min(F.when(F.col("before") < k, F.col("score"))).alias("bound"))
    bound = F.when(F.col("found") >= k, F.col("bound")).otherwise(0.0)
    few = F.size("qw") - F.ceil(bound * F.size("qw") - 1e-9) + 1
    some = F.filter(F.slice("rare", F.lit(1), few.cast("int")), lambda w: w.often > 0)
    close = best_sets(asked.join(least, "qid", "left").select("qid", "asked", "qw", some.alias("by")), of_word, k)
    hits = close.join(sets.select("vid", "ontology", F.explode("terms").alias("t")), "vid").select("qid", "ontology", "t.code", "t.term", F.col("score"))
    order = Window.partitionBy("qid").orderBy(F.desc("score"), "code")
    hits = hits.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k)
    out = q.select("request_id", "query_ord", "qid").join(hits, "qid")
    return out.select("request_id", "query_ord", "code", "term", "ontology", "place", positional(F.col("place") - 1).alias("score"))


def best_sets(asked: DataFrame, of_word: DataFrame, k: int) -> DataFrame:
    """asked: qid, asked, qw and by (words with often). The k sets of terms that share one of these words and are most like the query's."""
    by = asked.select("qid", "asked", "qw", F.explode(F.transform("by", lambda w: w.word)).alias("word"))
    met = by.join(of_word, "word").where(F.col("asked").isNull() | (F.col("asked") == F.col("ontology")))
    shared = F.size(F.array_intersect("qw", "vw"))
    met = met.select("qid", "vid", "first", "codes", (shared / (F.size("qw") + F.size("vw") - shared)).alias("score")).dropDuplicates(["qid", "vid"])
    order = Window.partitionBy("qid").orderBy(F.desc("score"), "first")
    return met.withColumn("_place", F.row_number().over(order)).where(F.col("_place") <= k).drop("_place")


def nearest(queries: DataFrame, vectors: DataFrame, k: int, *, digits: int = 6, clusters: int | None = None) -> DataFrame:
    """queries: query_id, vec; vectors: vec_id, vec, label. Exact top k by cosine (rounded, ties to the smaller id), without the query's own id, by an
    index that is built for this search. Build a VectorIndex to search more than once."""
    index = VectorIndex.build(vectors.select(F.lit("").alias("key"), "vec_id", "label", "vec"), new_path(vectors.sparkSession), clusters)
    return index.search(queries.select("query_id", F.lit(None).cast("string").alias("key"), "vec"), k, digits)


def concepts(atoms: DataFrame, k: int, *, preferred: str = "RXNORM", prefix: str = "RXNORM") -> DataFrame:
    """atoms: request_id, ord, concept, name, source, rank (text). Of a source that answers with several atoms a concept: one candidate a concept,
    with the name of the preferred source's atom, else the first one there is, and a score by the least rank (ranks that are no
    number don't count; 0 without any). Concepts without a name are left out; per request the k best, ties in order of appearance."""
    named = F.trim("name") != ""
    per = atoms.where(F.trim("concept") != "").groupBy("request_id", F.trim("concept").alias("concept")).agg(
        F.min_by(F.trim("name"), F.when(named, F.struct((F.coalesce(F.col("source") != preferred, F.lit(True))).alias("a"), F.col("ord").alias("b")))).alias("term"),
        F.coalesce(F.min(F.coalesce(F.nullif(F.trim("rank"), F.lit("")), F.lit("0")).try_cast("double")), F.lit(0.0)).alias("rank"), F.min("ord").alias("ord"),
    )
    out = per.where("term IS NOT NULL").select("request_id", F.concat(F.lit(f"{prefix}:"), "concept").alias("code"), "term", positional(F.col("rank"), "inverse").alias("score"), "ord")
    order = Window.partitionBy("request_id").orderBy(F.desc("score"), "ord")
    return out.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k)
