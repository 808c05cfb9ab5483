"""The registered queries: each applies an operator to stand-in tables, beside SQL that says the same.

Stand-ins: parts are a vocabulary, orders are requests with a status, lineitems are ranked predictions (gold: returned parts), events
are candidates with many duplicates, nations and regions are a hierarchy, labels are truths with confidences.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import gold as G
from .functions import identity as I
from .functions import numbers as N
from .functions import statistics
from .functions import text as T
from .functions.identity import let
from .operators import abbreviations as abbreviations_of
from .operators import audit, breaker, calibrate, candidates, compare, evaluate, hierarchy, retrieve, routing, runs, score, summaries, validate
from .operators.vector_index import VectorIndex, new_path
from .plans import mapping

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def rounded(df: DataFrame) -> DataFrame:
    """Doubles with six digits, whole numbers as long."""
    return df.select(*[F.round(F.col(n), 6).alias(n) if t == "double" else F.col(n).cast("bigint").alias(n) if t in ("int", "decimal(20,0)", "decimal(38,0)") else F.col(n) for n, t in df.dtypes])


# --- identity ---------------------------------------------------------------------------------------------------------

# codes of several spellings, from part keys
_CODES = """
  CASE k % 8 WHEN 0 THEN 'HP_' || k WHEN 1 THEN 'hp:' || k WHEN 2 THEN 'http://x.org/obo/MONDO_' || k || '/' WHEN 3 THEN 'ICD10CM:A' || k
    WHEN 4 THEN CAST(k AS VARCHAR) WHEN 5 THEN 'SCTID:' || k WHEN 6 THEN 'Foo-1:b_' || k ELSE ' LOINC:' || (k % 99999) || '-' || (k % 10) END AS code,
  CASE k % 3 WHEN 0 THEN NULL WHEN 1 THEN 'http://x.org/obo/HP_' || k ELSE '' END AS iri,
  CASE k % 5 WHEN 0 THEN 'hpo' WHEN 1 THEN 'RXCUI' WHEN 2 THEN NULL WHEN 3 THEN 'snomed' ELSE 'efo' END AS explicit_ontology
"""
_CANON = "CASE {0} WHEN '' THEN NULL WHEN 'HP' THEN 'HPO' WHEN 'SCTID' THEN 'SNOMED-CT' WHEN 'SNOMED' THEN 'SNOMED-CT' WHEN 'SNOMEDCT' THEN 'SNOMED-CT' WHEN 'RXNORM' THEN 'RxNorm' WHEN 'RXCUI' THEN 'RxNorm' WHEN 'ICD10CM' THEN 'ICD10' ELSE {0} END"
_PREFIX = "CASE {0} WHEN 'HPO' THEN 'HP' WHEN 'SNOMED-CT' THEN 'SNOMEDCT' WHEN 'RxNorm' THEN 'RXNORM' ELSE {0} END"


def codes(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").selectExpr("p_partkey AS k").selectExpr(
        "k",
        "CASE k % 8 WHEN 0 THEN 'HP_' || k WHEN 1 THEN 'hp:' || k WHEN 2 THEN 'http://x.org/obo/MONDO_' || k || '/' WHEN 3 THEN 'ICD10CM:A' || k WHEN 4 THEN CAST(k AS STRING) WHEN 5 THEN 'SCTID:' || k WHEN 6 THEN 'Foo-1:b_' || k ELSE ' LOINC:' || (k % 99999) || '-' || (k % 10) END AS code",
        "CASE k % 3 WHEN 0 THEN NULL WHEN 1 THEN 'http://x.org/obo/HP_' || k ELSE '' END AS iri",
        "CASE k % 5 WHEN 0 THEN 'hpo' WHEN 1 THEN 'RXCUI' WHEN 2 THEN NULL WHEN 3 THEN 'snomed' ELSE 'efo' END AS explicit_ontology",
    )


_ID_SQL = f"""
WITH c AS (SELECT p_partkey AS k FROM part), r AS (SELECT k, {_CODES} FROM c),
t AS (SELECT *, trim(code) AS tc, regexp_extract(regexp_replace(trim(code), '[/#]+$', ''), '[^/#]*$') AS seg FROM r),
u AS (SELECT *, regexp_extract(seg, '^([A-Za-z][A-Za-z0-9-]*)[_:](.+)$', 1) AS sp, trim(regexp_extract(seg, '^([A-Za-z][A-Za-z0-9-]*)[_:](.+)$', 2)) AS sl, upper(trim(explicit_ontology)) AS ue FROM t),
v AS (SELECT *, {_CANON.format("upper(sp)")} AS so, {_CANON.format("coalesce(ue, '')")} AS eo FROM u)
"""


@query(_ID_SQL + f"SELECT k, CASE WHEN sp <> '' THEN {_PREFIX.format('upper(so)')} || ':' || sl END AS curie, eo AS canonical, coalesce({_PREFIX.format('eo')}, '') AS prefix FROM (SELECT * REPLACE (CASE WHEN so = 'RxNorm' THEN 'RXNORM' ELSE so END AS so) FROM v)")
def identity_curie(spark, d):
    c = codes(spark, d)
    return c.select("k", I.curie_from_iri(F.col("code")).alias("curie"), I.canonical(F.col("explicit_ontology")).alias("canonical"), I.prefix_of(F.col("explicit_ontology")).alias("prefix"))


@query(
    _ID_SQL
    + f"""SELECT k, CASE WHEN ok THEN code2 END AS code, CASE WHEN ok THEN onto END AS ontology, CASE WHEN ok THEN reason END AS reason FROM (
  SELECT k, onto, code2, reason, NOT (so IS NOT NULL AND io IS NOT NULL AND so <> io) AND onto IS NOT NULL AND NOT coalesce(io <> onto, false)
      AND (onto NOT IN ('HPO', 'MONDO') OR coalesce(so = onto OR so IS NULL AND (io = onto OR io IS NULL), false)) AND (onto <> 'LOINC' OR regexp_matches(sl, '^[0-9]{{1,7}}-[0-9]$')) AS ok FROM (
  SELECT k, so, sl, io, coalesce(so, io, eo) AS onto,
    CASE WHEN so IS NOT NULL THEN {_PREFIX.format('so')} || ':' || replace(sl, '_', ':') WHEN io IS NOT NULL THEN 'HP:' || k ELSE {_PREFIX.format('eo')} || ':' || tc END AS code2,
    CASE WHEN so IS NOT NULL THEN 'code' WHEN io IS NOT NULL THEN 'iri' ELSE 'explicit' END AS reason
  FROM (SELECT * REPLACE (CASE WHEN so = '' THEN NULL WHEN so = 'FOO-1' THEN 'FOO-1' ELSE so END AS so), CASE WHEN k % 3 = 1 THEN 'HPO' END AS io FROM v)))"""
)
def identity_resolve(spark, d):
    got = codes(spark, d).select("k", I.resolved(F.col("code"), F.col("iri"), F.col("explicit_ontology"), F.lit(None).cast("string")).alias("i"))
    return got.select("k", "i.code", "i.ontology", "i.reason")


@query("SELECT coalesce(CASE WHEN p_size % 7 = 0 THEN NULL ELSE p_brand END, 'NONE') AS namespace, count(*) AS count FROM part GROUP BY 1")
def namespace_distribution(spark, d):
    p = table(spark, d, "part").select(F.when(F.col("p_size") % 7 != 0, F.col("p_brand")).alias("b"))
    return summaries.namespaces(p, "b").select("namespace", "count")


# --- gold pairs -------------------------------------------------------------------------------------------------------


def pairs(spark, d):
    li = table(spark, d, "lineitem")
    return li.select(F.col("l_orderkey").alias("query"), F.concat(F.lit("P"), "l_partkey").alias("code"), (F.col("l_orderkey") * 1000 + F.col("l_linenumber")).alias("ord"))


_PAIRS = "q AS (SELECT l_orderkey AS query, 'P' || l_partkey AS code, l_orderkey * 1000 + l_linenumber AS ord FROM lineitem), f AS (SELECT query, code, min(ord) AS ord, count(*) AS copies FROM q GROUP BY query, code)"


@query(f"WITH {_PAIRS} SELECT row_number() OVER (ORDER BY min(ord), query) - 1 AS query_id, query, array_to_string(list(code ORDER BY ord, code), '|') AS gold, min(ord) AS first_ord, CAST(sum(copies) AS BIGINT) AS pair_rows FROM f GROUP BY query")
def canonical_queries(spark, d):
    c = audit.canonical_queries(pairs(spark, d))
    return c.select(F.col("query_id").cast("bigint"), "query", F.array_join("gold_codes", "|").alias("gold"), "first_ord", "pair_rows")


@query(f"WITH {_PAIRS}, i AS (SELECT query, row_number() OVER (ORDER BY min(ord), query) - 1 AS query_id, count(*) AS n FROM f GROUP BY query) SELECT query_id, f.query, n AS n_gold, code AS gold_code, ord FROM f JOIN i ON f.query = i.query")
def mapping_pairs(spark, d):
    return rounded(audit.mapping_pairs(audit.canonical_queries(pairs(spark, d))))


@query(f"WITH {_PAIRS} SELECT CAST(sum(copies) AS BIGINT) AS rows, count(*) AS pairs, count(DISTINCT query) AS queries, (SELECT max(n) FROM (SELECT count(*) AS n FROM f GROUP BY query)) AS most_codes, CAST(0 AS BIGINT) AS blank_queries, CAST(0 AS BIGINT) AS blank_codes, CAST(sum(copies) - count(*) AS BIGINT) AS extra_copies FROM f")
def dataset_audit(spark, d):
    return rounded(audit.audit(pairs(spark, d)))


@query(f"WITH {_PAIRS} SELECT n AS codes, count(*) AS queries FROM (SELECT query, count(*) AS n FROM f GROUP BY query) GROUP BY n")
def gold_cardinality(spark, d):
    return audit.cardinality(pairs(spark, d))


@query("SELECT item_id, array_to_string(list_filter(list_transform(string_split(replace(text, ' ', ' | '), ' | '), lambda x: trim(x)), lambda x: x <> ''), '|') AS codes FROM benchmark")
def parse_gold_codes(spark, d):
    b = table(spark, d, "benchmark")
    return b.select("item_id", F.array_join(G.split_codes(F.replace("text", F.lit(" "), F.lit(" | "))), "|").alias("codes"))


# --- ranked predictions -----------------------------------------------------------------------------------------------


def predictions(spark, d):
    li, o = table(spark, d, "lineitem"), table(spark, d, "orders")
    row = F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_returnflag")
    name = lambda x: F.concat(F.lit("P"), x.l_partkey.cast("string"))
    per = li.groupBy("l_orderkey").agg(F.array_sort(F.collect_list(row)).alias("x"))
    per = per.select(F.col("l_orderkey").alias("id"), G.five(F.transform("x", name)).alias("ranks"), F.array_sort(F.array_distinct(F.transform(F.filter("x", lambda x: x.l_returnflag == "R"), name))).alias("gold"))
    status = o.select(F.col("o_orderkey").alias("id"), F.when(F.col("o_orderstatus") == "F", "mapped").when(F.col("o_orderstatus") == "O", "unmapped").otherwise("error").alias("status"), F.col("o_orderpriority").alias("mode"), F.col("o_custkey").alias("cust"))
    return per.join(status, "id")


_PRED = """p AS (SELECT l_orderkey AS id, (list('P' || l_partkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice))[1:5] AS ranks,
  coalesce(list_sort(list(DISTINCT 'P' || l_partkey) FILTER (WHERE l_returnflag = 'R')), []) AS gold FROM lineitem GROUP BY l_orderkey),
g AS (SELECT p.*, CASE o_orderstatus WHEN 'F' THEN 'mapped' WHEN 'O' THEN 'unmapped' ELSE 'error' END AS status, o_orderpriority AS mode, o_custkey AS cust,
  list_min(list_filter(list_transform(range(1, 6), lambda i: CASE WHEN list_contains(gold, ranks[i]) THEN i END), lambda i: i IS NOT NULL)) AS r FROM p JOIN orders ON o_orderkey = id),
s AS (SELECT *, coalesce(r <= 1, false) AS top1, coalesce(r <= 3, false) AS top3, coalesce(r <= 5, false) AS top5, coalesce(1.0 / r, 0) AS rr,
  CASE WHEN len(gold) > 0 THEN CAST(len(list_filter(gold, lambda c: list_contains(ranks[1:least(len(gold), 5)], c))) AS DOUBLE) / len(gold) END AS recall FROM g)"""


@query(f"WITH {_PRED} SELECT id, CAST(r AS BIGINT) AS gold_rank, top1, top3, top5, round(CAST(rr AS DOUBLE), 6) AS rr, round(recall, 6) AS recall FROM s")
def first_gold_rank(spark, d):
    return rounded(score.scored(predictions(spark, d)).select("id", "gold_rank", "top1", "top3", "top5", "rr", "recall"))


_SUMMED = "count(*) AS n, round(avg(top1::DOUBLE), 6) AS top1, round(avg(top3::DOUBLE), 6) AS top3, round(avg(top5::DOUBLE), 6) AS top5, round(CAST(avg(rr) AS DOUBLE), 6) AS mrr, round(coalesce(avg(recall), 0), 6) AS recall_at_gold, count(recall) AS recall_n"


@query(f"WITH {_PRED} SELECT {_SUMMED} FROM s")
def topk_mrr(spark, d):
    return rounded(score.summed(score.scored(predictions(spark, d))))


@query(f"WITH {_PRED} SELECT {_SUMMED} FROM s WHERE status <> 'error'")
def topk_mrr_without_errors(spark, d):
    return rounded(score.summed(score.scored(predictions(spark, d), errors="drop")))


@query(f"WITH {_PRED}, e AS (SELECT * REPLACE (top1 AND status <> 'error' AS top1, top3 AND status <> 'error' AS top3, top5 AND status <> 'error' AS top5, CASE WHEN status = 'error' THEN 0 ELSE rr END AS rr) FROM s) SELECT mode, {_SUMMED} FROM e GROUP BY mode")
def topk_by_mode_errors_missed(spark, d):
    return rounded(score.summed(score.scored(predictions(spark, d), errors="miss"), ["mode"]))


_FRAC = """f AS (SELECT *, CASE WHEN status = 'mapped' THEN r END AS k FROM g WHERE status <> 'error'),
t AS (SELECT *, CASE WHEN status = 'mapped' AND k IS NOT NULL THEN power(0.5, k - 1) ELSE 0 END AS tp FROM f),
u AS (SELECT *, CASE WHEN status = 'mapped' THEN (1 - tp) / 2 ELSE 0 END AS fp, CASE WHEN status = 'mapped' THEN (1 - tp) / 2 WHEN len(gold) > 0 THEN 1 ELSE 0 END AS fn, CASE WHEN status <> 'mapped' AND len(gold) = 0 THEN 1 ELSE 0 END AS tn FROM t),
a AS (SELECT count(*) AS rows, CAST(sum(tp) AS DOUBLE) AS tp, CAST(sum(fp) AS DOUBLE) AS fp, CAST(sum(fn) AS DOUBLE) AS fn, CAST(sum(tn) AS DOUBLE) AS tn, count(*) FILTER (WHERE k = 1) AS top1_count, count(k) AS top5_count FROM u)"""


@query(f"WITH {_PRED}, {_FRAC} SELECT rows, round(tp, 6) AS tp, round(fp, 6) AS fp, round(fn, 6) AS fn, round(tn, 6) AS tn, top1_count, top5_count, round(tp / (tp + fp), 6) AS precision, round(tp / (tp + fn), 6) AS recall, round(2 * (tp / (tp + fp)) * (tp / (tp + fn)) / (tp / (tp + fp) + tp / (tp + fn)), 6) AS f1, round(top1_count / rows, 6) AS top1_accuracy, round(top5_count / rows, 6) AS top5_rate FROM a")
def weighted_prf(spark, d):
    return rounded(score.fractions(predictions(spark, d)))


_OUT = "CASE WHEN status = 'error' THEN 'Execution error' WHEN status = 'unmapped' OR ranks[1] IS NULL THEN 'Abstained' WHEN r = 1 THEN 'Gold rank 1' WHEN r IN (2, 3) THEN 'Gold rank 2-3' WHEN r IN (4, 5) THEN 'Gold rank 4-5' ELSE 'No gold in Top 5' END"


@query(f"WITH {_PRED}, o AS (SELECT {_OUT} AS outcome FROM g), c AS (SELECT unnest(['Execution error', 'Abstained', 'Gold rank 1', 'Gold rank 2-3', 'Gold rank 4-5', 'No gold in Top 5']) AS outcome) SELECT c.outcome, count(o.outcome) AS count, round(count(o.outcome) / (SELECT count(*) FROM o), 6) AS share FROM c LEFT JOIN o ON c.outcome = o.outcome GROUP BY c.outcome")
def outcome_distribution(spark, d):
    s = score.scored(predictions(spark, d)).withColumn("outcome", score.outcome(F.col("status"), F.col("ranks")[0], F.col("gold_rank")))
    return rounded(score.distribution(s, "outcome", score.OUTCOMES))


@query(f"WITH {_PRED} SELECT count(*) AS rows, count(*) FILTER (WHERE status <> 'error' AND (status = 'unmapped' OR ranks[1] IS NULL)) AS abstained, round(count(*) FILTER (WHERE status <> 'error' AND (status = 'unmapped' OR ranks[1] IS NULL)) / count(*), 6) AS abstention_rate, round(count(*) FILTER (WHERE status = 'mapped' AND len(gold) > 0) / count(*) FILTER (WHERE status = 'mapped'), 6) AS grounding_rate FROM g")
def abstention_and_grounding(spark, d):
    p = predictions(spark, d).withColumn("a", score.abstained(F.col("status"), F.col("ranks")[0]))
    abstained = p.agg(F.count("*").alias("rows"), F.count_if("a").alias("abstained"), N.rate(F.count_if("a"), F.count("*")).alias("abstention_rate"))
    grounding = validate.grounding(p.withColumn("was_retrieved", F.size("gold") > 0)).select("grounding_rate")
    return rounded(summaries.beside(abstained, grounding, []))


@query("WITH v AS (SELECT l_partkey AS k, CASE WHEN p_partkey IS NULL THEN 'INVALID' WHEN p_size > 45 THEN 'UNRESOLVED' ELSE 'VALID' END AS s FROM lineitem LEFT JOIN part ON p_partkey = l_partkey AND p_size > 5) SELECT count(*) AS mapped, count(*) FILTER (WHERE s = 'VALID') AS valid, count(*) FILTER (WHERE s = 'INVALID') AS invalid, count(*) FILTER (WHERE s = 'UNRESOLVED') AS unresolved, round(count(*) FILTER (WHERE s = 'INVALID') / count(*) FILTER (WHERE s IN ('VALID', 'INVALID')), 6) AS hallucination_rate, round(count(*) FILTER (WHERE s IN ('VALID', 'INVALID')) / count(*), 6) AS coverage FROM v")
def hallucination_summary(spark, d):
    known = table(spark, d, "part").where("p_size > 5").select("p_partkey", "p_size")
    s = F.when(F.col("p_partkey").isNull(), "INVALID").when(F.col("p_size") > 45, "UNRESOLVED").otherwise("VALID")
    v = table(spark, d, "lineitem").select("l_partkey").join(known, F.col("l_partkey") == F.col("p_partkey"), "left").select(s.alias("validation_status"), F.lit("mapped").alias("status"))
    return rounded(validate.hallucination(v).drop("not_applicable", "unresolved_rate"))


@query(f"WITH {_PRED} SELECT metric, value FROM (UNPIVOT (SELECT CAST(count(*) AS DOUBLE) AS n, round(avg(top1::DOUBLE), 6) AS top1, round(CAST(avg(rr) AS DOUBLE), 6) AS mrr FROM s) ON n, top1, mrr INTO NAME metric VALUE value)")
def metric_table(spark, d):
    return rounded(score.long_form(score.summed(score.scored(predictions(spark, d))).select("n", "top1", "mrr")))


# --- candidates -------------------------------------------------------------------------------------------------------


def hits(spark, d):
    e = table(spark, d, "events")
    return e.select(
        F.col("user_id").alias("request_id"), F.col("event_id").alias("ord"), F.concat(F.lit("x:"), "event_type").alias("code"), F.col("event_type").alias("term"), F.lit("X").alias("ontology"),
        F.when(F.col("event_id") % 3 == 0, "d").alias("definition"), F.lit("s").alias("source"), F.concat(F.lit("q"), (F.col("event_id") % 4).cast("string")).alias("matched_query"),
        F.when(F.col("event_id") % 11 != 0, F.col("value")).alias("raw_score"), N.clamp_unit(F.floor("value") / 100).alias("normalized_score"),
        F.when(F.col("event_id") % 5 == 0, F.array(F.lit("EFO"))).otherwise(F.array(F.lit("HP"))).alias("retrieved_from"),
    )


_HITS = """h AS (SELECT user_id AS request_id, event_id AS ord, event_type AS term, CASE WHEN event_id % 3 = 0 THEN 'd' END AS definition, 'q' || (event_id % 4) AS mq,
  CASE WHEN event_id % 11 <> 0 THEN value END AS rs, CASE WHEN floor(value) / 100 BETWEEN 0 AND 1 THEN floor(value) / 100 END AS ns, event_id % 5 = 0 AS efo FROM events),
w AS (SELECT *, row_number() OVER (PARTITION BY request_id, term ORDER BY ns DESC NULLS LAST, rs DESC NULLS LAST, definition IS NULL, ord) AS k FROM h),
a AS (SELECT request_id, term, count(*) AS n, min(ord) AS first_ord, bool_or(efo) AS efo FROM h GROUP BY request_id, term),
q AS (SELECT request_id, term, array_to_string(list(mq ORDER BY o), ',') AS qs FROM (SELECT request_id, term, mq, min(ord) AS o FROM h GROUP BY request_id, term, mq) GROUP BY request_id, term),
m AS (SELECT w.request_id, w.ord, w.term, w.ns, w.rs, a.n, a.first_ord, a.efo, q.qs, row_number() OVER (PARTITION BY w.request_id ORDER BY w.ns DESC NULLS LAST, w.rs DESC NULLS LAST, w.term, a.first_ord) AS rank FROM w JOIN a USING (request_id, term) JOIN q USING (request_id, term) WHERE k = 1)"""


@query(f"WITH {_HITS} SELECT request_id, term, ord, round(ns, 6) AS normalized_score, round(rs, 6) AS raw_score, n AS duplicate_count, qs AS queries, rank FROM m")
def merge_dedup(spark, d):
    m = candidates.merged(hits(spark, d))
    return rounded(m.select("request_id", "term", "ord", "normalized_score", "raw_score", "duplicate_count", F.array_join("matched_queries", ",").alias("queries"), "rank"))


@query(f"WITH {_HITS}, f AS (SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY ns DESC NULLS LAST, rs DESC NULLS LAST, term, first_ord) AS r FROM m WHERE efo) SELECT request_id, term, r AS rank FROM f WHERE r <= 3")
def merge_eligible_topk(spark, d):
    return rounded(candidates.merged(hits(spark, d), targets=F.array(F.lit("efo")), limit=3).select("request_id", "term", "rank"))


@query("SELECT event_id, coalesce(nullif(trim(json_extract_string(props, '$.id')), ''), nullif(trim(json_extract_string(props, '$.k')), '')) AS code, TRY_CAST(json_extract_string(props, '$.k') AS DOUBLE) AS score FROM events")
def json_first_nonblank(spark, d):
    raw = F.from_json("props", "map<string,string>")
    e = table(spark, d, "events").select("event_id", raw.alias("raw"))
    return e.select("event_id", candidates.first_of(F.col("raw"), ["id", "k"]).alias("code"), F.try_element_at("raw", F.lit("k")).try_cast("double").alias("score"))


@query("""WITH h AS (SELECT event_id, user_id, CASE WHEN event_id % 7 = 0 THEN NULL WHEN event_id % 5 = 0 THEN 'HP_' || event_id WHEN event_id % 5 = 1 THEN 'MONDO:' || event_id ELSE CAST(event_id AS VARCHAR) END AS c, event_type AS t, value AS v FROM events)
SELECT event_id, CASE WHEN event_id % 7 = 0 THEN NULL WHEN event_id % 5 = 0 THEN 'HP:' || event_id WHEN event_id % 5 = 1 THEN c ELSE 'EFO:' || c END AS code, CASE WHEN event_id % 7 = 0 THEN NULL WHEN event_id % 5 = 0 THEN 'HPO' WHEN event_id % 5 = 1 THEN 'MONDO' ELSE 'EFO' END AS ontology,
  round(v, 6) AS raw_score, round(CASE WHEN v BETWEEN 0 AND 1 THEN v WHEN v > 1 AND v <= 1.000001 THEN 1 WHEN v < 0 AND v >= -0.000001 THEN 0 END, 6) AS normalized_score, CASE WHEN event_id % 7 = 0 THEN 'no code' END AS error FROM h""")
def normalize_candidates(spark, d):
    e = table(spark, d, "events")
    code = F.when(F.col("event_id") % 7 == 0, "").when(F.col("event_id") % 5 == 0, F.concat(F.lit("HP_"), "event_id")).when(F.col("event_id") % 5 == 1, F.concat(F.lit("MONDO:"), "event_id")).otherwise(F.col("event_id").cast("string"))
    h = e.select("event_id", F.lit("efo").alias("default_ontology"), F.create_map(F.lit("curie"), code, F.lit("label"), F.col("event_type"), F.lit("similarity"), F.col("value").cast("string")).alias("raw"))
    return rounded(candidates.normalized(h).select("event_id", "code", "ontology", "raw_score", "normalized_score", "error"))


# --- routing and lookups ----------------------------------------------------------------------------------------------


@query("""WITH q AS (SELECT item_id AS request_id, [text, 'x'] AS qs, CASE item_id % 3 WHEN 0 THEN ['HPO', 'ICD'] WHEN 1 THEN ['SNOMED'] ELSE ['NOPE', 'RxNorm'] END AS os FROM benchmark),
a AS (SELECT request_id, unnest(range(0, len(qs))) AS query_ord, qs, os FROM q), b AS (SELECT request_id, query_ord, qs[query_ord + 1] AS query, unnest(range(0, len(os))) AS onto_ord, os FROM a)
SELECT request_id, query_ord, trim(query) AS query, onto_ord, os[onto_ord + 1] AS asked, CASE os[onto_ord + 1] WHEN 'HPO' THEN 'ols4' WHEN 'ICD' THEN 'nih_clinical_tables' WHEN 'SNOMED' THEN 'ols4' WHEN 'RxNorm' THEN 'rxnav' END AS source_id, os[onto_ord + 1] <> 'NOPE' AS supported FROM b""")
def route_calls(spark, d):
    b = table(spark, d, "benchmark")
    os = F.when(F.col("item_id") % 3 == 0, F.array(F.lit("HPO"), F.lit("ICD"))).when(F.col("item_id") % 3 == 1, F.array(F.lit("SNOMED"))).otherwise(F.array(F.lit("NOPE"), F.lit("RxNorm")))
    plans = b.select(F.col("item_id").alias("request_id"), routing.queries_of(F.array(F.col("text"), F.lit(" x"))).alias("queries"), os.alias("ontologies"))
    return rounded(routing.calls(plans).select("request_id", "query_ord", "query", "onto_ord", "asked", "source_id", "supported"))


_LEX = """v AS (SELECT 'PART:' || p_partkey AS code, p_brand AS ontology, list_distinct(string_split(lower(p_name), ' ')) AS vw FROM part),
q AS (SELECT s_suppkey AS request_id, list_distinct(string_split(lower(p_name), ' ')) AS qw, p_brand AS asked FROM supplier JOIN part ON p_partkey = s_suppkey),
h AS (SELECT request_id, code, len(list_intersect(qw, vw)) AS s, len(qw) AS nq, len(vw) AS nv FROM q JOIN v ON ontology = asked WHERE len(list_intersect(qw, vw)) > 0),
l AS (SELECT request_id, code, row_number() OVER (PARTITION BY request_id ORDER BY CAST(s AS DOUBLE) / (nq + nv - s) DESC, code) AS place FROM h)"""


def lexical_calls(spark, d):
    p, s = table(spark, d, "part"), table(spark, d, "supplier")
    calls = s.join(p, F.col("s_suppkey") == F.col("p_partkey")).select(F.col("s_suppkey").alias("request_id"), F.lit(0).alias("query_ord"), F.col("p_name").alias("query"), F.col("p_brand").alias("ontology"))
    return calls, p.select(F.concat(F.lit("PART:"), "p_partkey").alias("code"), F.col("p_name").alias("term"), F.col("p_brand").alias("ontology"))


@query(f"WITH {_LEX} SELECT request_id, code, place, round(1 - 0.05 * (place - 1), 6)::DOUBLE AS score FROM l WHERE place <= 5")
def lexical_topk(spark, d):
    calls, vocabulary = lexical_calls(spark, d)
    return rounded(retrieve.lexical(calls, vocabulary, 5).select("request_id", "code", "place", "score"))


# the stated queries: every id that 20 divides
_KNN = "v AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS w FROM embeddings), c AS (SELECT q.vec_id AS query_id, v.vec_id, v.label, round(list_inner_product(q.w, v.w) / sqrt(list_inner_product(q.w, q.w) * list_inner_product(v.w, v.w)), 6) AS cosine FROM v AS q JOIN v ON q.vec_id <> v.vec_id WHERE q.vec_id % 20 = 0), k AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY cosine DESC, vec_id) AS place FROM c)"


def neighbours(spark, d, k):
    v = table(spark, d, "embeddings").select("vec_id", "label", F.col("embedding").alias("vec"))
    return retrieve.nearest(v.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), "vec"), v, k)


@query(f"WITH {_KNN} SELECT query_id, vec_id, label, cosine, place FROM k WHERE place <= 5")
def knn_topk(spark, d):
    return rounded(neighbours(spark, d, 5)).withColumn("label", F.col("label").cast("int"))


@query("""
WITH v AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS w FROM embeddings),
c AS (SELECT q.vec_id AS query_id, v.vec_id, round(list_inner_product(q.w, v.w) / sqrt(list_inner_product(q.w, q.w) * list_inner_product(v.w, v.w)), 6) AS cosine
  FROM v AS q JOIN v ON q.vec_id <> v.vec_id AND v.label = (q.label + 1) % 10 WHERE q.vec_id % 20 = 0)
SELECT query_id, vec_id, cosine, row_number() OVER (PARTITION BY query_id ORDER BY cosine DESC, vec_id) AS place FROM c
QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY cosine DESC, vec_id) <= 4
""")
def semantic_search(spark, d):
    """Each query searches one vocabulary of a stored index: only that vocabulary's partitions are read."""
    v = table(spark, d, "embeddings").select(F.col("label").cast("string").alias("key"), "vec_id", "label", F.col("embedding").alias("vec"))
    index = VectorIndex.build(v, new_path(spark))
    asked = v.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), ((F.col("label") + 1) % 10).cast("string").alias("key"), "vec")
    return rounded(index.search(asked, 4).drop("label"))


@query(f"WITH {_KNN} SELECT round(avg(CASE WHEN k.label = e.label THEN 1.0 ELSE 0.0 END), 6)::DOUBLE AS hit_rate, count(*) AS n FROM k JOIN embeddings e ON e.vec_id = query_id WHERE place <= 5")
def knn_label_hit_rate(spark, d):
    own = table(spark, d, "embeddings").select(F.col("vec_id").alias("query_id"), F.col("label").alias("own"))
    return rounded(neighbours(spark, d, 5).join(own, "query_id").agg(F.avg((F.col("label") == F.col("own")).cast("double")).alias("hit_rate"), F.count("*").alias("n")))


# --- hierarchy --------------------------------------------------------------------------------------------------------


def edges(spark, d):
    n, r, s = table(spark, d, "nation"), table(spark, d, "region"), table(spark, d, "supplier")
    up = n.select(F.concat(F.lit("N:"), "n_nationkey").alias("subject"), F.concat(F.lit("R:"), "n_regionkey").alias("object"))
    top = r.select(F.concat(F.lit("R:"), "r_regionkey").alias("subject"), F.lit("W:0").alias("object"))
    return up.unionByName(top).unionByName(s.select(F.concat(F.lit("S:"), "s_suppkey").alias("subject"), F.concat(F.lit("N:"), "s_nationkey").alias("object")))


_EDGES = "e AS (SELECT 'N:' || n_nationkey AS s, 'R:' || n_regionkey AS o FROM nation UNION ALL SELECT 'R:' || r_regionkey, 'W:0' FROM region UNION ALL SELECT 'S:' || s_suppkey, 'N:' || s_nationkey FROM supplier), c(s, o) AS (SELECT s, o FROM e UNION SELECT c.s, e.o FROM c JOIN e ON c.o = e.s)"


@query(f"WITH RECURSIVE {_EDGES} SELECT s AS subject, o AS object FROM c")
def hierarchy_closure(spark, d):
    return hierarchy.closure(edges(spark, d))


# a graph with two parents a node and many paths between nodes
_DAG = "e AS (SELECT DISTINCT 'P:' || p_partkey AS s, 'P:' || (p_partkey // 2) AS o FROM part WHERE p_partkey > 1 UNION SELECT 'P:' || p_partkey, 'P:' || (p_partkey // 3) FROM part WHERE p_partkey > 2), c(s, o) AS (SELECT s, o FROM e UNION SELECT c.s, e.o FROM c JOIN e ON c.o = e.s)"


@query(f"WITH RECURSIVE {_DAG} SELECT s AS subject, o AS object FROM c")
def hierarchy_closure_dag(spark, d):
    p = table(spark, d, "part")
    up = lambda n: p.where(F.col("p_partkey") >= n).select(F.concat(F.lit("P:"), "p_partkey").alias("subject"), F.concat(F.lit("P:"), F.expr(f"p_partkey div {n}")).alias("object"))
    return hierarchy.closure(up(2).unionByName(up(3)))


_REL = f"""{_EDGES}, p AS (SELECT o_orderkey AS id, CASE WHEN o_orderkey % 10 = 0 THEN NULL WHEN o_orderkey % 4 = 0 THEN 'R:' || (o_orderkey % 5) WHEN o_orderkey % 4 = 1 THEN 'N:' || (o_orderkey % 25) ELSE 'S:' || (o_custkey % 7 + 1) END AS p,
  ['N:' || (o_custkey % 30), 'S:' || (o_custkey % 5 + 1)] AS gold, o_orderstatus AS st FROM orders),
x AS (SELECT id, p, unnest(range(0, 2)) AS i, gold FROM p), y AS (SELECT id, p, i, gold[i + 1] AS g FROM x),
z AS (SELECT y.*, p = g AS same, EXISTS (SELECT 1 FROM c WHERE c.s = p AND c.o = g) AS narrower, EXISTS (SELECT 1 FROM c WHERE c.s = g AND c.o = p) AS broader, (SELECT min(a.o) FROM e a JOIN e b ON a.o = b.o WHERE a.s = p AND b.s = g) AS parent FROM y),
k AS (SELECT id, any_value(p) AS p, bool_or(coalesce(same, false)) AS same, min(i) FILTER (WHERE narrower) AS n, min(i) FILTER (WHERE broader) AS b, min(i) FILTER (WHERE parent IS NOT NULL) AS s FROM z GROUP BY id),
rel AS (SELECT k.id, k.p, p.gold, p.st, CASE WHEN k.p IS NULL THEN 'Not Applicable' WHEN same THEN 'Same' WHEN n IS NOT NULL THEN 'More Specific' WHEN b IS NOT NULL THEN 'More General' WHEN s IS NOT NULL THEN 'Sibling' ELSE 'Unrelated' END AS relationship, n, b, s FROM k JOIN p ON p.id = k.id)"""


def relations(spark, d):
    o = table(spark, d, "orders")
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    p = F.when(k % 10 == 0, F.lit(None)).when(k % 4 == 0, F.concat(F.lit("R:"), (k % 5).cast("string"))).when(k % 4 == 1, F.concat(F.lit("N:"), (k % 25).cast("string"))).otherwise(F.concat(F.lit("S:"), (c % 7 + 1).cast("string")))
    gold = F.array(F.concat(F.lit("N:"), (c % 30).cast("string")), F.concat(F.lit("S:"), (c % 5 + 1).cast("string")))
    pairs_ = o.select(k.alias("id"), p.alias("predicted"), gold.alias("gold"), F.when(F.col("o_orderstatus") == "F", "mapped").when(F.col("o_orderstatus") == "O", "unmapped").otherwise("error").alias("status"))
    e = edges(spark, d)
    return hierarchy.related(pairs_, e, hierarchy.closure(e))


@query(f"WITH RECURSIVE {_REL} SELECT id, relationship, CASE relationship WHEN 'Same' THEN p WHEN 'More Specific' THEN gold[n + 1] WHEN 'More General' THEN gold[b + 1] WHEN 'Sibling' THEN gold[s + 1] END AS matched_gold FROM rel")
def relationship_classes(spark, d):
    return relations(spark, d).select("id", "relationship", "matched_gold")


_TAX = "t AS (SELECT CASE WHEN st IN ('O', 'P') OR p IS NULL THEN 'FN' WHEN list_contains(gold, p) THEN 'TP-Identical' WHEN relationship IN ('More Specific', 'More General', 'Sibling') THEN 'TP-Related' ELSE 'FP-Error' END AS category FROM rel), n AS (SELECT CAST(count(*) FILTER (WHERE category IN ('TP-Identical', 'TP-Related')) AS BIGINT) AS tp, count(*) FILTER (WHERE category = 'FP-Error') AS fp, count(*) FILTER (WHERE category = 'FN') AS fn, count(*) FILTER (WHERE category = 'TP-Identical') AS ti FROM t)"


@query(f"WITH RECURSIVE {_REL}, {_TAX} SELECT tp, fp, fn, round(tp / (tp + fp), 6) AS precision, round(tp / (tp + fn), 6) AS recall, round(2 * (tp / (tp + fp)) * (tp / (tp + fn)) / (tp / (tp + fp) + tp / (tp + fn)), 6) AS f1 FROM n")
def taxonomy_prf(spark, d):
    r = relations(spark, d)
    return rounded(score.taxonomy_prf(r.withColumn("category", score.taxonomy(F.col("status"), F.col("predicted"), F.col("gold"), F.col("relationship")))))


@query(f"WITH RECURSIVE {_REL}, {_TAX}, m AS (SELECT ti AS tp, fp + tp - ti AS fp, fn FROM n) SELECT tp, fp, fn, round(tp / (tp + fp), 6) AS precision, round(tp / (tp + fn), 6) AS recall, round(2 * (tp / (tp + fp)) * (tp / (tp + fn)) / (tp / (tp + fp) + tp / (tp + fn)), 6) AS f1 FROM m")
def taxonomy_exact_only(spark, d):
    r = relations(spark, d)
    return rounded(score.taxonomy_prf(r.withColumn("category", score.taxonomy(F.col("status"), F.col("predicted"), F.col("gold"), F.col("relationship"))), exact_only=True))


# --- calibration ------------------------------------------------------------------------------------------------------


def confidences(spark, d):
    docs, labels = table(spark, d, "documents").select("doc_id", "n_chars"), table(spark, d, "labels").select("doc_id", "quality")
    return labels.join(docs, "doc_id").select("doc_id", F.col("quality").alias("label"), F.least(F.round(F.col("n_chars") / 5000, 2), F.lit(1.0)).alias("score"))


_CONF = "x AS (SELECT l.doc_id, quality AS label, least(round(n_chars / 5000, 2), 1.0)::DOUBLE AS score FROM labels l JOIN documents d ON l.doc_id = d.doc_id), k AS (SELECT *, rank() OVER (ORDER BY score) + (count(*) OVER (PARTITION BY score) - 1) / 2.0 AS rk FROM x), u AS (SELECT count(*) FILTER (WHERE label = 1) AS n1, count(*) FILTER (WHERE label = 0) AS n0, CAST(sum(rk) FILTER (WHERE label = 1) AS DOUBLE) AS r1 FROM k)"


@query(f"WITH {_CONF} SELECT n1, n0, round((r1 - n1 * (n1 + 1) / 2) / (n1 * n0), 6) AS auc, 'OK' AS status FROM u")
def roc_auc(spark, d):
    return rounded(calibrate.roc_auc(confidences(spark, d)))


@query(f"WITH {_CONF} SELECT round(avg(power(score - label, 2)), 6) AS brier FROM x")
def brier(spark, d):
    return confidences(spark, d).agg(F.round(calibrate.brier(F.col("label"), calibrate.valid_confidence(F.col("score"))), 6).alias("brier"))


_BINS = "b AS (SELECT least(floor(score * 10), 9)::BIGINT AS bin, count(*) AS count, avg(score) AS mean_confidence, avg(label) AS accuracy FROM x GROUP BY 1), ten AS (SELECT unnest(range(0, 10)) AS bin), j AS (SELECT ten.bin, coalesce(count, 0) AS count, mean_confidence, accuracy, abs(accuracy - mean_confidence) AS gap FROM ten LEFT JOIN b ON b.bin = ten.bin)"


@query(f"WITH {_CONF}, {_BINS} SELECT bin, count, round(mean_confidence, 6) AS mean_confidence, round(accuracy, 6) AS accuracy, round(gap, 6) AS gap FROM j")
def ece_bins(spark, d):
    return rounded(calibrate.bins(confidences(spark, d)))


@query(f"WITH {_CONF}, {_BINS} SELECT round(CAST(sum(gap * count) / sum(count) AS DOUBLE), 6) AS ece, round(max(gap), 6) AS max_gap FROM j")
def expected_calibration_error(spark, d):
    return rounded(calibrate.ece(calibrate.bins(confidences(spark, d))))


@query(f"WITH {_CONF}, m AS (SELECT avg(score) FILTER (WHERE label = 1) AS mr, avg(score) FILTER (WHERE label = 0) AS mw, stddev_samp(score) FILTER (WHERE label = 1) AS sr, stddev_samp(score) FILTER (WHERE label = 0) AS sw FROM x) SELECT n1, n0, round(mr, 6) AS mean_right, round(mw, 6) AS mean_wrong, round(sr, 6) AS sd_right, round(sw, 6) AS sd_wrong, round((r1 - n1 * (n1 + n0 + 1) / 2.0) / sqrt(n1 * n0 * (n1 + n0 + 1) / 12.0), 6) AS z, round((mr - mw) / sqrt(((n1 - 1) * sr * sr + (n0 - 1) * sw * sw) / (n1 + n0 - 2)), 6) AS cohens_d FROM u, m")
def separation_stats(spark, d):
    return rounded(calibrate.separation(confidences(spark, d)).drop("p"))  # SQL has no error function


# --- comparison -------------------------------------------------------------------------------------------------------

MODES = ["1-URGENT", "2-HIGH", "3-MEDIUM"]


def modes(spark, d):
    o = table(spark, d, "orders")
    one = o.groupBy("o_custkey", "o_orderpriority").agg(F.max("o_orderstatus").alias("code"), F.max("o_totalprice").alias("price"))
    return one.select(F.col("o_custkey").alias("id"), F.col("o_orderpriority").alias("mode"), F.when(F.col("code") != "P", F.col("code")).alias("code"), (F.col("price") > 200000).alias("top1"))


_MODES = "m AS (SELECT o_custkey AS id, o_orderpriority AS mode, nullif(max(o_orderstatus), 'P') AS code, max(o_totalprice) > 200000 AS top1 FROM orders GROUP BY 1, 2), w AS (SELECT a.id, a.code AS ca, b.code AS cb, c.code AS cc, a.top1 AS ta, b.top1 AS tb, c.top1 AS tc FROM m a JOIN m b ON a.id = b.id AND b.mode = '2-HIGH' JOIN m c ON c.id = a.id AND c.mode = '3-MEDIUM' WHERE a.mode = '1-URGENT')"


def paired(spark, d):
    return compare.paired(modes(spark, d), id_col="id", mode_col="mode", modes=MODES, fields=["code", "top1"])


@query(f"WITH {_MODES} SELECT id, ca AS code_a, cb AS code_b, cc AS code_c, ca IS NOT DISTINCT FROM cb AND cb IS NOT DISTINCT FROM cc AS same FROM w")
def paired_predictions(spark, d):
    a, b, c = [F.col(f"`code_{m}`") for m in MODES]
    return paired(spark, d).select("id", a.alias("code_a"), b.alias("code_b"), c.alias("code_c"), (a.eqNullSafe(b) & b.eqNullSafe(c)).alias("same"))


@query(f"WITH {_MODES} SELECT count(*) FILTER (WHERE ta AND tb) AS both_right, count(*) FILTER (WHERE ta AND NOT tb) AS lost, count(*) FILTER (WHERE NOT ta AND tb) AS gained, count(*) FILTER (WHERE NOT ta AND NOT tb) AS both_wrong FROM w")
def transitions(spark, d):
    return paired(spark, d).agg(*compare.transitions(F.col("`top1_1-URGENT`"), F.col("`top1_2-HIGH`")))


@query("""
WITH w AS (SELECT l_suppkey AS tool, l_returnflag = 'R' AS ours, l_discount >= 0.05 AS theirs FROM lineitem),
n AS (SELECT tool, count(*) FILTER (WHERE ours AND theirs) AS both_right, count(*) FILTER (WHERE ours AND NOT theirs) AS lost, count(*) FILTER (WHERE NOT ours AND theirs) AS gained,
  count(*) FILTER (WHERE NOT ours AND NOT theirs) AS both_wrong FROM w GROUP BY tool)
SELECT *, round(CASE WHEN lost + gained = 0 THEN 1.0 ELSE least(1.0, 2 * list_sum(list_transform(range(0, least(lost, gained) + 1),
  lambda i: exp(lgamma(lost + gained + 1) - CASE WHEN i > 1 THEN lgamma(i + 1) ELSE 0 END - lgamma(lost + gained - i + 1) - (lost + gained) * ln(2))))) END, 6)::DOUBLE AS p FROM n
""")
def mcnemar_by_tool(spark, d):
    """Exact tests of paired outcomes, one a tool, in one aggregation."""
    w = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("tool"), (F.col("l_returnflag") == "R").alias("ours"), (F.col("l_discount") >= 0.05).alias("theirs"))
    n = w.groupBy("tool").agg(*compare.transitions(F.col("ours"), F.col("theirs")))
    return rounded(n.withColumn("p", statistics.mcnemar(F.col("lost"), F.col("gained"))))


@query(f"WITH {_MODES} SELECT round(avg(CASE WHEN ca IS NOT DISTINCT FROM cb THEN 1.0 ELSE 0.0 END), 6)::DOUBLE AS top1_agreement, count(*) AS n FROM w")
def run_agreement(spark, d):
    return paired(spark, d).agg(F.round(compare.agreement(F.col("`code_1-URGENT`"), F.col("`code_2-HIGH`")), 6).alias("top1_agreement"), F.count("*").alias("n"))


@query("""WITH c AS (SELECT c_nationkey AS nation, CAST(regexp_extract(c_name, '[0-9]+') AS BIGINT) % 50 AS suffix, c_mktsegment AS result FROM customer), s AS (SELECT s_nationkey AS nation, CAST(regexp_extract(s_name, '[0-9]+') AS BIGINT) % 50 AS suffix, CASE WHEN s_acctbal > 0 THEN 'BUILDING' ELSE 'OTHER' END AS result FROM supplier),
x AS (SELECT nation, suffix, count(*) AS n, count(DISTINCT result) AS d, max(result) AS r FROM c GROUP BY 1, 2), y AS (SELECT nation, suffix, count(*) AS n, count(DISTINCT result) AS d, max(result) AS r FROM s GROUP BY 1, 2)
SELECT coalesce(x.nation, y.nation)::BIGINT AS nation, coalesce(x.suffix, y.suffix) AS suffix, coalesce(x.n, 0) AS n_ours, coalesce(y.n, 0) AS n_theirs, x.r AS result_ours, y.r AS result_theirs,
 CASE WHEN x.n IS NULL THEN 'missing ours' WHEN y.n IS NULL THEN 'missing theirs' WHEN x.d > 1 OR y.d > 1 THEN 'ambiguous' ELSE 'matched' END AS reason FROM x FULL JOIN y ON x.nation = y.nation AND x.suffix = y.suffix""")
def exact_alignment(spark, d):
    number = lambda c: F.regexp_extract(c, "[0-9]+", 0).cast("bigint") % 50
    ours = table(spark, d, "customer").select(F.col("c_nationkey").alias("nation"), number("c_name").alias("suffix"), F.col("c_mktsegment").alias("result"))
    theirs = table(spark, d, "supplier").select(F.col("s_nationkey").alias("nation"), number("s_name").alias("suffix"), F.when(F.col("s_acctbal") > 0, "BUILDING").otherwise("OTHER").alias("result"))
    return rounded(compare.aligned(ours, theirs, ["nation", "suffix"]))


@query(f"WITH {_PRED}, a AS (SELECT mode, avg(top1::DOUBLE) AS v FROM s GROUP BY mode) SELECT x.mode AS method, 'top1' AS metric, round(x.v, 6) AS value, round(y.v, 6) AS base, round(x.v - y.v, 6) AS delta FROM a x JOIN a y ON y.mode = '1-URGENT' WHERE x.mode <> '1-URGENT'")
def baseline_deltas(spark, d):
    s = score.summed(score.scored(predictions(spark, d)), ["mode"]).select(F.col("mode").alias("method"), F.lit("top1").alias("metric"), F.col("top1").alias("value"))
    return rounded(compare.deltas(s, "1-URGENT", keys=["metric"]))


@query("WITH p AS (SELECT p_brand AS model, round(avg(p_size), 3) AS good, round(avg(p_retailprice), 2) AS bad FROM part GROUP BY p_brand) SELECT model, good, bad FROM p a WHERE NOT EXISTS (SELECT 1 FROM p b WHERE b.good >= a.good AND b.bad <= a.bad AND (b.good > a.good OR b.bad < a.bad))")
def pareto_frontier(spark, d):
    p = table(spark, d, "part").groupBy(F.col("p_brand").alias("model")).agg(F.round(F.avg("p_size"), 3).alias("good"), F.round(F.avg("p_retailprice"), 2).alias("bad"))
    return compare.pareto(p, "good", "bad").select("model", "good", "bad")


@query("WITH a AS (SELECT o_orderpriority AS metric, round(avg(o_totalprice), 6) AS v FROM orders GROUP BY 1), b AS (SELECT metric, CASE WHEN metric LIKE '1%' THEN v + 1 ELSE v END AS w FROM a WHERE metric NOT LIKE '5%') SELECT a.metric, round(v, 3) AS found, round(w, 3) AS stated FROM a LEFT JOIN b ON a.metric = b.metric WHERE w IS NULL OR abs(v - w) > 0.5")
def reconcile_metrics(spark, d):
    a = table(spark, d, "orders").groupBy(F.col("o_orderpriority").alias("metric")).agg(F.round(F.avg("o_totalprice"), 6).alias("value"))
    b = a.where("metric NOT LIKE '5%'").withColumn("value", F.when(F.col("metric").like("1%"), F.col("value") + 1).otherwise(F.col("value")))
    return compare.reconciled(a, b).select("metric", F.round("found", 3).alias("found"), F.round("stated", 3).alias("stated"))


# --- runs -------------------------------------------------------------------------------------------------------------


def orders(spark, d):
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("cust"), F.when(F.col("o_orderstatus") == "F", "mapped").when(F.col("o_orderstatus") == "O", "unmapped").otherwise("error").alias("status"), F.col("o_totalprice").alias("price"))


@query("SELECT o_orderkey AS id FROM orders WHERE o_orderstatus = 'P'")
def resume_remaining(spark, d):
    o = orders(spark, d)
    return runs.remaining(o.select("id"), runs.quarantined(o)[0], "id")


@query("SELECT o_orderkey AS id, CASE WHEN o_orderstatus = 'O' AND o_orderkey % 2 = 0 THEN 'mapped' WHEN o_orderstatus = 'F' THEN 'mapped' WHEN o_orderstatus = 'O' THEN 'unmapped' ELSE 'error' END AS status, o_orderstatus = 'O' AND o_orderkey % 2 = 0 AS patched FROM orders")
def patch_merge(spark, d):
    o = orders(spark, d)
    again = o.where("status = 'unmapped' AND id % 2 = 0").select("id", F.lit("mapped").alias("status"))
    return runs.patched(o.select("id", "status"), again, "id", ["status"])


_SOURCE = "CASE WHEN o_custkey % 3 = 0 THEN 0 ELSE o_custkey % 50 END"


@query(f"""
WITH o AS (SELECT {_SOURCE} AS source, o_orderkey AS k, o_orderstatus = 'O' AS bad, o_orderstatus = 'F' AS done, o_orderstatus = 'O' AND o_orderpriority < '4' AS local FROM orders),
i AS (SELECT *, sum(CASE WHEN done THEN 1 ELSE 0 END) OVER (PARTITION BY source ORDER BY k) AS g FROM o),
r AS (SELECT *, sum(local::INT) OVER w AS local_run, sum(bad::INT) OVER w AS any_run FROM i WINDOW w AS (PARTITION BY source, g ORDER BY k)),
t AS (SELECT *, CASE WHEN local AND local_run >= 3 THEN 'consecutive_local_retrieval_errors' WHEN bad AND NOT local AND any_run >= 5 THEN 'consecutive_execution_errors' END AS why FROM r)
SELECT source, arg_max(local_run, k) AS local_run, arg_max(any_run, k) AS any_run, max(local_run) AS longest_local, max(any_run) AS longest_any,
  min(k) FILTER (WHERE why IS NOT NULL) AS opened_at, arg_min(why, k) FILTER (WHERE why IS NOT NULL) AS reason
FROM t GROUP BY source
""")
def circuit_breaker(spark, d):
    """Orders are results of sources, one of which has a third of them; a status of P is neither a result nor an error."""
    status = F.when(F.col("o_orderstatus") == "F", "mapped").when(F.col("o_orderstatus") == "O", "error")
    stage = F.when(F.col("o_orderpriority") < "4", "local_retrieval").otherwise("planner")
    rows = table(spark, d, "orders").select(F.expr(_SOURCE).alias("source"), F.col("o_orderkey").alias("ord"), status.alias("status"), stage.alias("error_stage"))
    return rounded(breaker.breakers(rows, group="source", ord_="ord"))


@query("SELECT count(*) AS rows, count(*) FILTER (WHERE o_orderstatus = 'F') AS mapped, count(*) FILTER (WHERE o_orderstatus = 'O') AS unmapped, count(*) FILTER (WHERE o_orderstatus = 'P') AS error FROM orders")
def execution_diagnostics(spark, d):
    o = orders(spark, d)
    return summaries.execution(o).drop("error_rate")


@query("SELECT l_returnflag AS flag, round(avg(l_quantity), 4) AS l_quantity_mean, quantile_cont(l_quantity, 0.5) AS l_quantity_median, round(quantile_cont(l_quantity, 0.95), 6) AS l_quantity_p95, sum(l_quantity) AS l_quantity_sum, count(l_quantity) AS l_quantity_n FROM lineitem GROUP BY 1")
def telemetry_percentiles(spark, d):
    t = runs.telemetry(table(spark, d, "lineitem").select(F.col("l_returnflag").alias("flag"), "l_quantity"), ["l_quantity"], ["flag"])
    return t.withColumn("l_quantity_mean", F.round("l_quantity_mean", 4)).withColumn("l_quantity_p95", F.round("l_quantity_p95", 6))


@query("SELECT l_orderkey AS id, l_linenumber AS line, l_partkey AS part, l_suppkey AS supp, round(greatest(i - least(c, i), 0) / 1e6 * 2 + least(c, i) / 1e6 * 0.5 + o / 1e6 * 8, 8) AS usd FROM (SELECT *, CAST(l_quantity * 100 AS BIGINT) AS i, CAST(l_discount * 10000 AS BIGINT) AS c, CAST(l_tax * 10000 AS BIGINT) AS o FROM lineitem)")
def cost_projection(spark, d):
    li = table(spark, d, "lineitem")
    n = lambda c, k: (F.col(c) * k).cast("double")
    whole = lambda c: F.round(c).cast("bigint")
    usd = N.cost(whole(n("l_quantity", 100)), whole(n("l_discount", 10000)), whole(n("l_tax", 10000)), F.lit(2.0), F.lit(0.5), F.lit(8.0))
    return li.select(F.col("l_orderkey").alias("id"), F.col("l_linenumber").alias("line"), F.col("l_partkey").alias("part"), F.col("l_suppkey").alias("supp"), F.round(usd, 8).alias("usd"))


@query("SELECT conv_id, count(*) AS turns, CAST(sum(length(text)) AS BIGINT) AS chars, max_by(role, turn) AS last_role FROM conversations GROUP BY conv_id")
def usage_accumulate(spark, d):
    c = table(spark, d, "conversations").withColumn("chars", F.length("text"))
    return summaries.usage(c, ["conv_id"], order="turn", model="role", tokens=("chars",)).select("conv_id", F.col("calls").alias("turns"), F.col("chars").cast("bigint"), F.col("role").alias("last_role"))


# --- texts ------------------------------------------------------------------------------------------------------------


@query("SELECT p_partkey AS k, 'Use only if the field specifically means ' || array_to_string(regexp_extract_all(p_name, '[A-Za-z0-9][A-Za-z0-9:/.-]*')[1:8], ' ') || '.' AS explanation, regexp_replace(regexp_replace(lower(trim(p_type)), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') AS slug FROM part")
def term_explanations(spark, d):
    return table(spark, d, "part").select(F.col("p_partkey").alias("k"), T.explanation(F.col("p_name")).alias("explanation"), T.slug(F.col("p_type")).alias("slug"))


@query("SELECT conv_id, turn, trim(regexp_replace(text, '^\\s+|\\s+$', '', 'g')) AS reply FROM conversations")
def strip_fences(spark, d):
    c = table(spark, d, "conversations")
    return c.select("conv_id", "turn", T.without_fences(F.concat(F.lit("```json\n"), "text", F.lit("\n```"))).alias("reply"))


@query("SELECT k, CASE WHEN k % 2 = 0 THEN 'ORDO:' || k ELSE 'EFO:a' || k END AS code FROM (SELECT p_partkey AS k FROM part)")
def gold_curies(spark, d):
    k = F.col("p_partkey").cast("string")
    return table(spark, d, "part").select(F.col("p_partkey").alias("k"), T.gold_curie(F.when(F.col("p_partkey") % 2 == 0, F.concat(F.lit(" Orphanet: "), k)).otherwise(F.concat(F.lit("efo:a"), k))).alias("code"))


# --- the whole mapping ------------------------------------------------------------------------------------------------


def requests(spark, d):
    p, s = table(spark, d, "part"), table(spark, d, "supplier")
    return s.join(p, F.col("s_suppkey") == F.col("p_partkey")).select(F.col("s_suppkey").alias("request_id"), F.concat(F.lit("part_"), "s_suppkey").alias("term"), F.col("p_name").alias("label"), F.lit(None).cast("string").alias("description"), F.lit("text").alias("type"), F.lit("PART").alias("target"), F.lit(None).cast("array<string>").alias("allowed"))


@query("""WITH v AS (SELECT 'PART:' || p_partkey AS code, p_name, list_distinct(string_split(lower(p_name), ' ')) AS vw FROM part),
q AS (SELECT s_suppkey AS request_id, list_distinct(string_split(lower(p_name), ' ')) AS qw FROM supplier JOIN part ON p_partkey = s_suppkey),
h AS (SELECT request_id, code, p_name, row_number() OVER (PARTITION BY request_id ORDER BY CAST(len(list_intersect(qw, vw)) AS DOUBLE) / (len(qw) + len(vw) - len(list_intersect(qw, vw))) DESC, code) AS place FROM q JOIN v ON len(list_intersect(qw, vw)) > 0)
SELECT request_id, code AS target_code, p_name AS target_term, 'PART' AS ontology, CAST(1 AS DOUBLE) AS confidence, true AS is_grounded, true AS high_confidence, CAST(4 AS BIGINT) AS n_alternatives FROM h WHERE place = 1""")
def map_dictionary(spark, d):
    vocabulary = table(spark, d, "part").select(F.concat(F.lit("PART:"), "p_partkey").alias("code"), F.col("p_name").alias("term"), F.lit("PART").alias("ontology"))
    out = mapping.mapped(requests(spark, d), vocabulary)
    return out.select("request_id", "target_code", "target_term", "ontology", F.round("confidence", 4).alias("confidence"), "is_grounded", "high_confidence", F.size("alternatives").cast("bigint").alias("n_alternatives"))


@query(f"WITH {_LEX}, t AS (SELECT request_id, min(place) FILTER (WHERE code = 'PART:' || request_id) AS r FROM l WHERE place <= 5 GROUP BY request_id) SELECT count(*) AS n, round(avg(CASE WHEN r = 1 THEN 1.0 ELSE 0.0 END), 6)::DOUBLE AS top1, round(avg(CASE WHEN r <= 3 THEN 1.0 ELSE 0.0 END), 6)::DOUBLE AS top3, round(avg(CASE WHEN r <= 5 THEN 1.0 ELSE 0.0 END), 6)::DOUBLE AS top5, round(avg(coalesce(1.0 / r, 0)), 6)::DOUBLE AS mrr, round(avg(CASE WHEN r = 1 THEN 1.0 ELSE 0.0 END), 6)::DOUBLE AS recall_at_gold, count(*) AS recall_n FROM t")
def lookup_then_score(spark, d):
    """The flagship: look up, rank, score against gold."""
    calls, vocabulary = lexical_calls(spark, d)
    found = retrieve.lexical(calls, vocabulary, 5)
    per = found.groupBy("request_id").agg(F.array_sort(F.collect_list(F.struct("place", "code"))).alias("x"))
    rows = per.select("request_id", G.five(F.transform("x", lambda x: x.code)).alias("ranks"), F.array(F.concat(F.lit("PART:"), "request_id")).alias("gold"), F.lit("mapped").alias("status"))
    return rounded(score.summed(score.scored(rows)))


# --- evaluation -------------------------------------------------------------------------------------------------------


@query(f"WITH {_PRED}, m AS (SELECT mode, CASE WHEN status = 'error' THEN 'ERROR' WHEN status = 'unmapped' THEN 'UNMAPPED' WHEN list_contains(gold, ranks[1]) THEN 'EXACT' ELSE 'UNKNOWN' END AS m FROM g) SELECT CASE WHEN grouping(mode) = 1 THEN 'total' ELSE 'entity' END AS slice, mode AS value, count(*) AS n, count(*) FILTER (WHERE m = 'EXACT') AS exact, count(*) FILTER (WHERE m = 'UNKNOWN') AS unknown, count(*) FILTER (WHERE m = 'UNMAPPED') AS unmapped, count(*) FILTER (WHERE m = 'ERROR') AS error, round(count(*) FILTER (WHERE m = 'EXACT') / count(*), 6) AS accuracy FROM m GROUP BY GROUPING SETS ((mode), ())")
def evaluator_breakdown(spark, d):
    p = predictions(spark, d)
    code = F.when(F.col("status") == "error", "ERROR").when(F.col("status") == "unmapped", "UNKNOWN:UNMAPPED").otherwise(F.col("ranks")[0])
    rows = p.withColumn("match", evaluate.match_type(code, F.col("gold"), F.lit(None).cast("boolean"))).withColumnRenamed("mode", "entity")
    return rounded(evaluate.breakdown(rows).select("slice", "value", "n", "exact", "unknown", "unmapped", "error", "accuracy"))


_E2E = "CASE WHEN status = 'error' THEN 'Execution error' WHEN status = 'unmapped' THEN 'Unmapped' WHEN r IS NULL THEN 'Mapped, gold not in Top 5' ELSE 'Gold rank ' || r END"


@query(f"WITH {_PRED}, o AS (SELECT mode, {_E2E} AS outcome FROM g), c AS (SELECT unnest(['Execution error', 'Unmapped', 'Gold rank 1', 'Gold rank 2', 'Gold rank 3', 'Gold rank 4', 'Gold rank 5', 'Mapped, gold not in Top 5']) AS outcome), t AS (SELECT mode, count(*) AS t FROM o GROUP BY mode) SELECT t.mode, c.outcome, count(o.outcome) AS count, round(count(o.outcome) / any_value(t.t), 6) AS share FROM t CROSS JOIN c LEFT JOIN o ON o.mode = t.mode AND o.outcome = c.outcome GROUP BY t.mode, c.outcome")
def e2e_outcomes(spark, d):
    s = score.scored(predictions(spark, d)).withColumn("outcome", evaluate.e2e_outcome(F.col("status"), F.col("gold_rank")))
    return rounded(score.distribution(s, "outcome", evaluate.E2E, ["mode"]))


@query(f"WITH {_PRED}, a AS (SELECT mode, avg(top1::DOUBLE) AS x, avg(top3::DOUBLE) AS y, avg(top5::DOUBLE) AS z FROM s GROUP BY mode) SELECT mode, round(x, 6) AS rank_1, round(y - x, 6) AS rank_2_3, round(z - y, 6) AS rank_4_5, round(1 - z, 6) AS beyond FROM a")
def exclusive_rank_bins(spark, d):
    s = score.summed(score.scored(predictions(spark, d)), ["mode"])
    return rounded(s.select("mode", *evaluate.exclusive_bins(F.col("top1"), F.col("top3"), F.col("top5"))))


@query("SELECT l_returnflag AS flag, round(avg(l_quantity), 6) AS total, round(avg(l_quantity * l_discount), 6) AS planner, round(avg(l_quantity * l_tax), 6) AS reranker, round(avg(l_quantity) - avg(l_quantity * l_discount) - avg(l_quantity * l_tax), 6) AS rest FROM lineitem GROUP BY 1")
def latency_breakdown(spark, d):
    li = table(spark, d, "lineitem").select(F.col("l_returnflag").alias("flag"), F.col("l_quantity").alias("total"), (F.col("l_quantity") * F.col("l_discount")).alias("planner"), (F.col("l_quantity") * F.col("l_tax")).alias("reranker"))
    return rounded(evaluate.latency(li, "total", ["planner", "reranker"], ["flag"]))


@query(f"WITH {_PRED}, x AS (SELECT id, ranks AS a, CASE WHEN id % 3 = 0 THEN list_reverse(ranks) WHEN id % 3 = 1 THEN ranks ELSE ranks[1:1] END AS b FROM g WHERE status <> 'error') SELECT count(*) AS n, round(avg((a[1] IS NOT DISTINCT FROM b[1])::INT), 6) AS top1_agreement, round(avg((list_sort(list_distinct(a)) = list_sort(list_distinct(b)))::INT), 6) AS top5_agreement FROM x")
def reproducibility_summary(spark, d):
    p = predictions(spark, d).select("id", "status", "ranks")
    own = F.filter("ranks", lambda x: x.isNotNull())
    again = p.withColumn("ranks", F.when(F.col("id") % 3 == 0, F.reverse(own)).when(F.col("id") % 3 == 1, F.col("ranks")).otherwise(F.slice("ranks", 1, 1)))
    return rounded(evaluate.reproducibility(p, again))


@query(f"WITH {_PRED} SELECT mode, count(*) AS n, round(count(*) FILTER (WHERE status = 'error') * 100 / count(*), 6) AS errors, round(count(*) FILTER (WHERE status = 'unmapped') * 100 / count(*), 6) AS unmapped FROM g GROUP BY mode")
def reliability_per_hundred(spark, d):
    return rounded(evaluate.per_hundred(predictions(spark, d), {"errors": F.col("status") == "error", "unmapped": F.col("status") == "unmapped"}, ["mode"]))


@query("SELECT o_orderkey AS id FROM orders ORDER BY md5('42:' || o_orderkey), o_orderkey LIMIT 50")
def random_sample(spark, d):
    return evaluate.sample(table(spark, d, "orders").select(F.col("o_orderkey").alias("id")), "id", 50)


@query("SELECT 'ALS' AS short, 'alpha ' || lower(p_brand) || ' x' AS long, count(*) AS n FROM part WHERE false GROUP BY 2 UNION ALL SELECT upper(left(w[1], 1) || left(w[2], 1)), lower(w[1] || ' ' || w[2]), count(*) FROM (SELECT regexp_extract_all(p_name, '[A-Za-z]+') AS w FROM part) WHERE len(w) = 2 GROUP BY 1, 2")
def abbreviations(spark, d):
    w = F.regexp_extract_all("p_name", F.lit("([A-Za-z]+)"), F.lit(1))
    p = table(spark, d, "part").select(w.alias("w")).where(F.size("w") == 2)
    text = F.concat(F.array_join("w", " "), F.lit(" ("), F.upper(F.concat(F.left(F.col("w")[0], F.lit(1)), F.left(F.col("w")[1], F.lit(1)))), F.lit(")"))
    return abbreviations_of.learned(p.select(text.alias("t")), "t")


# every third text ends with a definition whose letters lie inside its last words; the other texts use some of these words
_ABBR = r"""t AS (SELECT doc_id AS k, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+') AS w FROM documents),
d AS (SELECT k, w, CASE WHEN k % 3 = 0 AND len(w) > 1 THEN text || ' ' || w[-2] || ' ' || w[-1] || ' (' || upper(left(w[-2], 1) || right(w[-1], 1)) || ')' ELSE text END AS text FROM t),
o AS (SELECT k, i AS place, regexp_extract(p[i + 1], '^([^()]{2,10})\)', 1) AS short, list_filter(regexp_split_to_array(regexp_extract(p[i], '[^)]*$'), '[ \t\r\n]+'), lambda x: x <> '') AS ws
  FROM (SELECT k, p, unnest(range(1, len(p))) AS i FROM (SELECT k, string_split(text, '(') AS p FROM d WHERE contains(text, '(')))),
c AS (SELECT k, place, short, array_to_string(ws[greatest(len(ws) - least(length(short) + 5, length(short) * 2) + 1, 1):], ' ') AS before FROM o
  WHERE regexp_matches(short, '^[\p{L}\p{N}]') AND regexp_matches(short, '\p{L}') AND len(regexp_split_to_array(short, '[ \t\r\n]+')) <= 2 AND len(ws) > 0),
q AS (SELECT *, translate(short, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS s,
  reverse(regexp_replace(translate(before, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\p{L}\p{N}]', ' ', 'g')) || ' ' AS b FROM c),
r AS (SELECT *, length(regexp_extract(b, '^(.*?' || array_to_string(list_reverse(regexp_extract_all(s, '[\p{L}\p{N}]')), '.*?') || ') ', 1)) AS e FROM q),
f AS (SELECT k, place, s AS short, right(before, e) AS long FROM r WHERE e > length(short)),
g AS (SELECT short, k, max_by(long, place) AS long FROM f GROUP BY short, k),
u AS (SELECT DISTINCT k, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\p{L}\p{N}]+')) AS short FROM d)"""


def defining(spark, d):
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("k"), F.coalesce("text", F.lit("")).alias("text"))
    short = lambda x: F.upper(F.concat(F.left(x.one, F.lit(1)), F.right(x.two, F.lit(1))))
    tail = lambda x: F.concat(F.lit(" "), x.one, F.lit(" "), x.two, F.lit(" ("), short(x), F.lit(")"))
    # the last two words, read from the text's end
    ends = lambda t, k: F.nullif(F.reverse(F.regexp_extract(t, "^[^A-Za-z]*+([A-Za-z]++)[^A-Za-z]++([A-Za-z]++)", k)), F.lit(""))
    last = lambda t: F.struct(ends(t, 2).alias("one"), ends(t, 1).alias("two"))
    ended = let(F.reverse("text"), lambda t: let(last(t), lambda x: F.concat(F.col("text"), F.coalesce(tail(x), F.lit("")))))
    return docs.select("k", F.when(F.col("k") % 3 == 0, ended).otherwise(F.col("text")).alias("text"))


@query(f"WITH {_ABBR} SELECT short, long, count(*) AS n FROM f GROUP BY short, long")
def abbreviation_definitions(spark, d):
    found = abbreviations_of.definitions(defining(spark, d), "text", ["k"])
    return found.groupBy(abbreviations_of.lowered(F.col("short")).alias("short"), "long").agg(F.count("*").alias("n"))


@query(f"WITH {_ABBR} SELECT u.k, u.short, g.long FROM u ASOF JOIN g ON u.short = g.short AND u.k > g.k")
def abbreviations_in_order(spark, d):
    return abbreviations_of.expanded(defining(spark, d), "text", "k")


@query("SELECT route, count(*) AS calls, count(*) FILTER (WHERE failed) AS errors, CAST(sum(retries) AS BIGINT) AS retries, count(*) FILTER (WHERE retries <> 0) AS rows_with_retries FROM (SELECT event_type AS route, event_id % 13 = 0 AS failed, event_id % 4 AS retries FROM events) GROUP BY route")
def retrieval_diagnostics(spark, d):
    e = table(spark, d, "events").select(F.col("event_type").alias("route"), (F.col("event_id") % 13 == 0).alias("failed"), (F.col("event_id") % 4).alias("retries"))
    none = F.lit(0).cast("bigint")
    e = e.select("route", none.alias("requests"), "retries", none.alias("recovered"), F.col("failed").cast("bigint").alias("final"), F.col("route").alias("source"))
    return summaries.retrieval(e, ["route"]).select("route", F.col("rows").alias("calls"), F.col("final").alias("errors"), "retries", "rows_with_retries")


@query("WITH p AS (SELECT p_partkey AS k, p_brand AS ns, CASE WHEN p_partkey % 9 = 0 THEN 'MONDO:' || p_partkey ELSE 'HP:' || p_partkey END AS code FROM part) SELECT k, 'MONDO' AS found, 'HPO' AS expected FROM p WHERE code LIKE 'MONDO%'")
def namespace_violations(spark, d):
    p = table(spark, d, "part").select(F.col("p_partkey").alias("k"), F.when(F.col("p_partkey") % 9 == 0, F.concat(F.lit("MONDO:"), "p_partkey")).otherwise(F.concat(F.lit("HP_"), "p_partkey")).alias("code"))
    return validate.violations_of_namespace(p.withColumn("target", F.lit("hp")), "code", "target").select("k", "found", "expected")


@query("SELECT reason, count(*) AS n FROM (SELECT CASE WHEN c.k IS NULL THEN 'missing left' WHEN s.k IS NULL THEN 'missing right' ELSE 'differs' END AS reason FROM (SELECT c_custkey AS k, c_nationkey AS n FROM customer) c FULL JOIN (SELECT s_suppkey AS k, s_nationkey AS n FROM supplier) s ON c.k = s.k WHERE c.k IS NULL OR s.k IS NULL OR c.n <> s.n) GROUP BY reason")
def run_compatibility(spark, d):
    a = table(spark, d, "customer").select(F.col("c_custkey").alias("k"), F.col("c_nationkey").alias("n"))
    b = table(spark, d, "supplier").select(F.col("s_suppkey").alias("k"), F.col("s_nationkey").alias("n"))
    return compare.mismatches(a, b, "k", ["n"]).groupBy("reason").agg(F.count("*").alias("n"))
