"""Quality, language, secrets and URLs: held-out accuracy, edge cases, base findings beside plain loops."""

import random
import re

from pyspark.sql import functions as F

from termloom.llm import langid, quality, secrets, urls
from termloom.llm.common import split_of

SF = "/root/testdata/sf0.01"


def test_quality_on_held_out_documents(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    model = quality.train(docs, labels, learn=split_of("doc_id", 4) != 2)
    rows = docs.join(labels, "doc_id").where(split_of("doc_id", 4) == 2)
    got = rows.select("quality", (quality.quality_score(docs, model, "text") >= 0.7).cast("int").alias("p")).collect()
    assert sum(r.quality == r.p for r in got) / len(got) > 0.95
    assert model.score("") == model.score(None) and 0 < model.score("") < 1


def test_quality_without_labels(spark):
    docs = spark.createDataFrame([(1, "a b"), (None, None)], "doc_id bigint, text string")
    labels = spark.createDataFrame([(1, None), (None, 1), (1, 7)], "doc_id bigint, quality int")
    model = quality.train(docs, labels)
    got = docs.withColumn("score", F.lit("own")).select(quality.quality_score(docs, model, "text").alias("s")).collect()
    assert [r.s for r in got] == [0.5, 0.5]


def test_language_on_held_out_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = langid.train(docs, learn=split_of("doc_id", 3) != 1)
    got = docs.where(split_of("doc_id", 3) == 1).select("lang", langid.language(docs, model, "text").alias("f")).collect()
    assert sum(r.lang == r.f.lang_pred for r in got) / len(got) > 0.97
    assert sum(r.f.rejected for r in got) / len(got) < 0.02
    odd = spark.createDataFrame([(None,), ("",), ("12 !!",), ("x" * 300_000,)], "text string")
    assert [(r.f.lang_pred, r.f.rejected) for r in odd.select(langid.language(docs, model, "text").alias("f")).collect()][:3] == [("und", True)] * 3


def test_language_without_rows(spark):
    docs = spark.createDataFrame([(1, "abc", None)], "doc_id bigint, text string, lang string")
    model = langid.train(docs)
    assert docs.select(langid.language(docs, model, "text").alias("f")).first().f.lang_pred == "und"


PATTERN = re.compile(r"""(?:[pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")


def plain_base(text):
    out = [(m.start(), 0, m.end()) for m in PATTERN.finditer(text) if len(m[1]) >= 6]
    out += [(m.start(), 1, m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    out += [(m.start(), 2, m.end()) for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 24]
    return sorted(out)


def test_base_findings():
    rng = random.Random(5)
    parts = ["token", "TOKEN", "paſſword", "passwd", "api_key", "APIKEY", "secret", "=", ":", " ", '"', "'", "abc", "abcdef1", "AKIA", "AKIA" + "A1" * 8, "AKIAX" * 5, "0f" * 12, "0F" * 12, "deadbeef" * 3, "é", "😀", "\n", "toKen"]
    for _ in range(3000):
        text = "".join(rng.choices(parts, k=rng.randint(0, 14)))
        assert secrets.base(text) == plain_base(text)


def test_secrets_are_found_and_redacted(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = secrets.train(docs)
    found = docs.select("text", secrets.secret_spans(docs, model, "text").alias("f"), secrets.redacted(docs, model, "text").alias("r")).collect()
    for r in found:
        assert [(s.start, s.end) for s in r.f if s.kind != "model"] == [(a, b) for a, _, b in plain_base(r.text)]
        assert not plain_base(r.r.replace("[SECRET]", " ")) and (r.f or r.r == r.text)
    assert secrets.spans(None, model) == [] and secrets.redact(None, [], "x") is None
    assert secrets.train(docs.limit(0)) is None


def test_url_parts_rules_and_trees(spark):
    from termloom.llm.queries import URL_RULES

    rows = ["http://A.Net/x?y", "http://net", "http://example.net/en/1", "https://a.EXAMPLE.net/en", "http://example.com/de/#a", "http://notexample.com/de/", "http://x.org/fr/?q://", "no scheme", None, "", "http://é.net/", "ftp://net?a/b"]
    df = spark.createDataFrame([(k, u, "own") for k, u in enumerate(rows)], "page_id bigint, url string, host string")
    got = [tuple(r)[1:5] for r in urls.judged(df, URL_RULES).orderBy("page_id").collect()]
    assert got[:7] == [("a.net", "/x", "net/", "block"), ("net", "", None, got[1][3]), ("example.net", "/en/1", "example.net/en/", "allow"), ("a.example.net", "/en", "net/", "block"), ("example.com", "/de/", "example.com/de/", "block"), ("notexample.com", "/de/", None, got[5][3]), ("x.org", "/fr/", "org/fr/", "allow")]
    assert [g[:3] for g in got[7:]] == [("", "", None)] * 3 + [("é.net", "/", "net/"), ("net", "", None)]
    assert urls.judged(df.limit(0), URL_RULES).count() == 0


def test_url_trees_on_held_out_urls(spark):
    from termloom.llm.queries import URL_RULES

    pages = spark.read.parquet(f"{SF}/pages.parquet")
    rows = pages.select("page_id", "url", urls.host_of(F.col("url")).alias("host"), urls.path_of(F.col("url")).alias("path"))
    rows = rows.withColumn("rule", urls.rule_of(F.col("host"), F.col("path"), URL_RULES)).withColumn("verdict", urls.verdict_of(F.col("rule"), URL_RULES)).where("rule IS NOT NULL")
    model = urls.train(rows.where(split_of("page_id", 3) != 1))
    got = rows.where(split_of("page_id", 3) == 1).select("verdict", (urls.blocked(rows, model, F.col("url"), F.col("host"), F.col("path")) >= 0.5).alias("b")).collect()
    assert sum((r.verdict == "block") == r.b for r in got) / len(got) > 0.75
