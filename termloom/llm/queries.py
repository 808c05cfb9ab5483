"""The registered queries of this subpackage; each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, divergence, langid, mixing, neardup, negatives, neighbours, quality, secrets, suffixes, topk, urls, warc
from .common import split_of


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = quality.train(docs, labels, learn=split_of("doc_id", 4) != 2)
    out = docs.select("doc_id", (split_of("doc_id", 4) == 2).alias("held_out"), quality.quality_score(docs, model, "text").alias("score"))
    return out.withColumn("predicted", (F.col("score") >= 0.7).cast("int"))


def op2_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, sf_dir, "documents"), width=4, percent=80)


def op3_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = langid.train(docs, learn=split_of("doc_id", 3) != 1)
    found = docs.select("doc_id", (split_of("doc_id", 3) == 1).alias("held_out"), langid.language(docs, model, "text").alias("found"))
    return found.select("doc_id", "held_out", "found.lang_pred", "found.score", "found.rejected")


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixed(table(spark, sf_dir, "documents"))


#: Hosts with paths and what they are: the rules that the query fixes.
URL_RULES = {"net/": "block", "example.net/en/": "allow", "example.com/de/": "block", "org/fr/": "allow"}


def op6_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judged(table(spark, sf_dir, "pages"), URL_RULES)


def op5_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = docs.select("doc_id", secrets.secret_spans(docs, secrets.train(docs), "text").alias("found"))
    listed = lambda x: F.array_join(F.transform(x, lambda s: F.concat_ws(":", s.kind, s.start.cast("string"), s.end.cast("string"))), ",")
    count = lambda kind: F.size(F.filter("found", lambda s: s.kind == kind)).cast("bigint").alias(f"n_{kind}")
    base = F.filter("found", lambda s: s.kind != "model")
    *kinds, model = secrets.KINDS
    return found.select("doc_id", *[count(k) for k in kinds], F.sha2(listed(base), 256).alias("base_sha256"), listed(F.col("found")).alias("spans"), count(model))


def op7_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = bpe.encode(table(spark, sf_dir, "documents"), decoded=True)
    return out.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op8_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.linked(table(spark, sf_dir, "embeddings"), 0.95)


def op9_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings"), 20, is_query=F.col("vec_id") % 20 == 0)


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    manifest = warc.write_archives(table(spark, sf_dir, "pages"), warc.new_folder(spark))
    return warc.read_archives(manifest, payloads=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op11_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = suffixes.removed(table(spark, sf_dir, "documents"), length=50)
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op12_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return negatives.mined(table(spark, sf_dir, "embeddings"), is_anchor=F.col("vec_id") % 100 == 0, label=label)


def op13_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audited(table(spark, sf_dir, "documents"), at_least=30, top=50)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_quality": op1_quality,
    "op2_near_duplicates": op2_near_duplicates,
    "op3_language": op3_language,
    "op4_mixing": op4_mixing,
    "op5_secrets": op5_secrets,
    "op6_urls": op6_urls,
    "op7_byte_bpe": op7_byte_bpe,
    "op8_embeddings": op8_embeddings,
    "op9_topk": op9_topk,
    "op10_warc": op10_warc,
    "op11_suffixes": op11_suffixes,
    "op12_negatives": op12_negatives,
    "op13_divergence": op13_divergence,
}

MIXING_SQL = """
WITH RECURSIVE docs AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^ \\t\\n\\x0B\\f\\r]+')) AS BIGINT) AS tokens FROM documents),
per AS (SELECT source, CAST(sum(tokens) AS BIGINT) AS tokens FROM docs GROUP BY source),
one AS (SELECT list(CAST(tokens AS DOUBLE) ORDER BY tokens, source) FILTER (WHERE tokens > 0) AS ts, CAST(sum(tokens) AS DOUBLE) AS total FROM per),
bis(step, lo, hi) AS (
  SELECT 0, CAST(0 AS DOUBLE), CAST(1 AS DOUBLE)
  UNION ALL
  SELECT step + 1, CASE WHEN good THEN lo ELSE mid END, CASE WHEN good THEN mid ELSE hi END
  FROM (SELECT step, lo, hi, (lo + hi) / 2 AS mid,
          list_max(list_transform(ts, lambda x: pow(x / total, (lo + hi) / 2) / x)) * total <= list_sum(list_transform(ts, lambda x: pow(x / total, (lo + hi) / 2))) * 2.0 AS good
        FROM bis, one WHERE step < 40)),
ex AS (SELECT CASE WHEN list_max(list_transform(ts, lambda x: 1.0 / x)) * total <= len(ts) * 2.0 THEN CAST(0 AS DOUBLE) ELSE round(hi, 9) END AS e, total, list_sum(list_transform(ts, lambda x: pow(x / total, CASE WHEN list_max(list_transform(ts, lambda x: 1.0 / x)) * total <= len(ts) * 2.0 THEN CAST(0 AS DOUBLE) ELSE round(hi, 9) END))) AS norm FROM bis, one WHERE step = 40),
w AS (SELECT source, tokens, CASE WHEN tokens > 0 THEN round(pow(tokens / total, e) / norm, 9) ELSE 0.0 END AS weight, total FROM per, ex),
b AS (SELECT source, tokens, weight, CAST(floor(weight * total) AS BIGINT) AS budget, CAST(ceil(sqrt(tokens / 100)) AS BIGINT) AS blocks FROM w),
s AS (SELECT source, weight, blocks, CASE WHEN tokens > 0 THEN budget // tokens ELSE 1 END AS passes, CASE WHEN tokens > 0 THEN budget % tokens ELSE 0 END AS rest FROM b),
d AS (SELECT doc_id, d.source, d.tokens, weight, passes, rest, CAST('0x' || substr(md5('1:' || doc_id), 1, 8) AS BIGINT) % greatest(blocks, 1) AS block FROM docs d JOIN s ON d.source IS NOT DISTINCT FROM s.source),
k AS (SELECT source, block, sum(tokens) AS size, any_value(rest) AS rest, any_value(passes) AS pass FROM d GROUP BY source, block),
o AS (SELECT source, block, size, rest, row_number() OVER g AS place, sum(size) OVER g - size AS before FROM k WINDOW g AS (PARTITION BY source ORDER BY CAST('0x' || substr(md5('1:' || coalesce(source, '') || ':' || pass || ':' || block), 1, 8) AS BIGINT), block)),
r AS (SELECT source, block, place, size, least(greatest(rest - before, 0), size) AS room FROM o),
m AS (SELECT d.doc_id, d.source, d.tokens, d.block, r.place, d.weight, d.passes, r.room, r.size,
        sum(d.tokens) OVER (PARTITION BY d.source, d.block ORDER BY CAST('0x' || substr(md5('1:d:' || d.doc_id), 1, 8) AS BIGINT), d.doc_id) AS run
      FROM d JOIN r ON d.source IS NOT DISTINCT FROM r.source AND d.block = r.block)
SELECT doc_id, source, tokens AS n_tokens, block, CAST(place AS INTEGER) AS place, weight,
  CASE WHEN tokens = 0 THEN 1 ELSE passes + CASE WHEN room > 0 AND (room = size OR run <= room) THEN 1 ELSE 0 END END AS copies
FROM m
"""

WARC_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html, CAST(strlen(coalesce(html, '')) AS BIGINT) AS n FROM pages),
q AS (SELECT page_id, n, sha1(html) AS digest, CASE WHEN n >= 1000 THEN max(page_id) OVER (PARTITION BY html) END AS response FROM p)
SELECT page_id, n AS payload_bytes, digest AS payload_digest,
  CASE WHEN response <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN response <> page_id THEN response END AS refers_to
FROM q
"""

TOPK_SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(64 * CAST(x AS DOUBLE))) AS w FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.w, c.w) AS BIGINT) AS score FROM v q JOIN v c ON q.vec_id % 20 = 0 AND q.vec_id <> c.vec_id AND len(q.w) = len(c.w))
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s
QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) <= 20
"""

LINKS_SQL = """
WITH RECURSIVE v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS w FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
e AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.w) = len(b.w) AND list_inner_product(a.w, b.w) / (sqrt(list_inner_product(a.w, a.w)) * sqrt(list_inner_product(b.w, b.w))) >= 0.95),
r(id, reached) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT r.id, e.b FROM r JOIN e ON r.reached = e.a),
c AS (SELECT id, min(reached) AS component_id FROM r GROUP BY id)
SELECT m.vec_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_links, c.component_id, m.vec_id = c.component_id AS kept
FROM embeddings m JOIN c ON c.id = m.vec_id LEFT JOIN (SELECT a, count(*) AS n FROM e GROUP BY a) n ON n.a = m.vec_id
"""

#: WIDTH words a shingle.
NEAR_SQL = """
WITH RECURSIVE w AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[ \\t\\n\\x0B\\f\\r]+'), lambda x: x <> '') AS ws FROM documents),
g AS (SELECT doc_id, list_distinct(list_transform(range(1, greatest(len(ws) - WIDTH + 2, 2)), lambda i: array_to_string(ws[i:i + WIDTH - 1], ' '))) AS gs FROM w WHERE len(ws) > 0),
s AS (SELECT doc_id, unnest(gs) AS sh FROM g),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n FROM s a JOIN s b ON a.sh = b.sh AND a.doc_id < b.doc_id GROUP BY a.doc_id, b.doc_id),
l AS (SELECT a, b FROM p JOIN g x ON x.doc_id = p.a JOIN g y ON y.doc_id = p.b WHERE 100 * n >= 80 * (len(x.gs) + len(y.gs) - n)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r(id, reached) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.id, e.b FROM r JOIN e ON r.reached = e.a),
c AS (SELECT id, min(reached) AS component_id FROM r GROUP BY id)
SELECT d.doc_id, CAST(coalesce(len(g.gs), 0) AS BIGINT) AS n_shingles, c.component_id, d.doc_id = c.component_id AS kept
FROM documents d JOIN c ON c.id = d.doc_id LEFT JOIN g ON g.doc_id = d.doc_id
"""

SUFFIX_SQL = """
WITH d AS (SELECT row_number() OVER () AS id, doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
c AS (SELECT id, doc_id, unnest(list_transform(range(0, len(h) // 2, 500), lambda k: {'k': k, 'h': substr(h, 2 * k + 1, 1098)})) AS c FROM d WHERE doc_id IS NOT NULL),
w AS (SELECT id, doc_id, unnest(list_transform(range(0, len(c.h) // 2 - 49), lambda s: {'s': c.k + s, 'g': unhex(substr(c.h, 2 * s + 1, 100))})) AS x FROM c),
f AS (SELECT x.g AS g, min(doc_id) AS least FROM w GROUP BY x.g HAVING min(doc_id) < max(doc_id)),
m AS (SELECT id, doc_id, x.s AS s, least FROM w JOIN f ON f.g = x.g),
r AS (SELECT id, s, CASE WHEN s - lag(s) OVER (PARTITION BY id ORDER BY s) <= 50 THEN 0 ELSE 1 END AS new FROM m WHERE least < doc_id),
i AS (SELECT id, s, sum(new) OVER (PARTITION BY id ORDER BY s) AS k FROM r),
x AS (SELECT id, k, min(s) AS a, max(s) + 50 AS b FROM i GROUP BY id, k),
y AS (SELECT id, k, a, b, coalesce(lag(b) OVER (PARTITION BY id ORDER BY k), 0) AS before FROM x),
z AS (SELECT y.id, count(*) AS n, sum(b - a) AS gone, string_agg(substr(h, 2 * before + 1, 2 * (a - before)), '' ORDER BY k) || substr(any_value(h), 2 * max(b) + 1) AS kept
  FROM y JOIN d ON d.id = y.id GROUP BY y.id)
SELECT doc_id, CAST(len(h) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(gone, 0) AS BIGINT) AS n_removed, CAST(coalesce(n, 0) AS BIGINT) AS n_spans,
  sha256(unhex(coalesce(kept, h))) AS kept_sha256
FROM d LEFT JOIN z ON z.id = d.id
"""

NEGATIVES_SQL = """
WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS w FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, c.vec_id, a.label = c.label AS same, CAST(list_inner_product(a.w, c.w) AS BIGINT) AS score
  FROM v a JOIN v c ON a.vec_id % 100 = 0 AND a.vec_id <> c.vec_id AND len(a.w) = len(c.w)),
p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT p.anchor_id, positive_id, CAST(row_number() OVER o AS INTEGER) AS rank, vec_id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT same AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score
WINDOW o AS (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, vec_id)
QUALIFY row_number() OVER o <= 10
"""

DIVERGENCE_SQL = """
WITH d AS (SELECT row_number() OVER () AS id, coalesce(lang, '') AS lang, coalesce(source, '') AS source, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
t AS (SELECT id, lang, source, unnest(regexp_extract_all(text, '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) AS term FROM d),
k AS (SELECT lang, term FROM t GROUP BY lang, term HAVING count(DISTINCT id) >= 30),
v AS (SELECT lang, count(*) AS v FROM k GROUP BY lang),
g AS (SELECT DISTINCT lang, source FROM d),
c AS (SELECT t.lang, t.source, t.term, count(*) AS n FROM t JOIN k ON k.lang = t.lang AND k.term = t.term GROUP BY t.lang, t.source, t.term),
n AS (SELECT g.lang, g.source, coalesce(sum(c.n), 0) AS n FROM g LEFT JOIN c ON c.lang = g.lang AND c.source = g.source GROUP BY g.lang, g.source),
p AS (SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n, 1 + CAST(coalesce(c.n, 0) + 5 AS HUGEINT) * 1000000000 // CAST(n.n + 5 * v.v AS HUGEINT) AS p
  FROM g JOIN k ON k.lang = g.lang JOIN v ON v.lang = g.lang JOIN n ON n.lang = g.lang AND n.source = g.source
  LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
l AS (SELECT k.lang, k.term, 1 + CAST(coalesce(c.n, 0) + 5 AS HUGEINT) * 1000000000 // CAST(s.n + 5 * v.v AS HUGEINT) AS q
  FROM k JOIN v ON v.lang = k.lang JOIN (SELECT lang, term, sum(n) AS n FROM c GROUP BY lang, term) c ON c.lang = k.lang AND c.term = k.term
  JOIN (SELECT lang, sum(n) AS n FROM n GROUP BY lang) s ON s.lang = k.lang),
f AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, CAST(coalesce(s.value, 0) AS BIGINT) AS value
  FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN (SELECT x.lang, x.source, y.source AS item, sum(abs(x.p - y.p)) AS value FROM p x JOIN p y ON x.lang = y.lang AND x.term = y.term AND x.source <> y.source
    GROUP BY x.lang, x.source, y.source) s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source
  UNION ALL
  SELECT p.lang, p.source, 'term', p.term, CAST(p.p - l.q AS BIGINT) FROM p JOIN l ON l.lang = p.lang AND l.term = p.term WHERE p.n > 0 AND p.p > l.q)
SELECT lang, source, part, item, value, CAST(row_number() OVER o AS INTEGER) AS rank FROM f
WINDOW o AS (PARTITION BY lang, source, part ORDER BY value DESC, item)
QUALIFY part = 'pair' OR row_number() OVER o <= 50
"""

ORACLES: dict[str, str] = {
    "op2_near_duplicates": NEAR_SQL.replace("WIDTH", "4"),
    "op4_mixing": MIXING_SQL,
    "op8_embeddings": LINKS_SQL,
    "op9_topk": TOPK_SQL,
    "op10_warc": WARC_SQL,
    "op11_suffixes": SUFFIX_SQL,
    "op12_negatives": NEGATIVES_SQL,
    "op13_divergence": DIVERGENCE_SQL,
}
