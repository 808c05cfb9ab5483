"""Nulls, repeated rows, very long texts, ties, empty tables and columns whose names clash, for each operator and the pipeline."""

import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as P
from termloom.llm import bpe, common, langid, mixing, neardup, neighbours, quality, secrets, topk, warc

WORDS = ["alpha", "beta", "gamma", "delta", "omega", "sigma", "tau", "rho"]
LONG = " ".join(random.Random(1).choices(WORDS, k=60_000)) + " token=abcdef1234567890"
CLASH = ["id", "key", "n", "row", "source_", "text_", "block", "copies", "copy", "tokens", "weight", "digest", "bucket", "vec", "q", "rank", "found", "score", "lang_pred", "rejected", "component", "size", "other", "payload", "p_source", "cut", "_nth", "_copy", "mix_id", "raw", "ids", "piece", "a.b"]


def documents(spark):
    rows = [(1, "The quick one", "en", "a", 1), (1, "The quick one", "en", "a", 1), (2, None, None, None, None), (3, "", "fr", "a", 0), (4, LONG, "en", "b", 9), (None, "no id here", "en", "b", 3), (None, None, None, None, None), (5, "12 34", "fr", None, 2)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    return df.withColumns({c: F.lit(7) for c in CLASH}).repartition(3)


def test_models_on_odd_rows(spark):
    docs = documents(spark)
    labels = spark.createDataFrame([(1, 1), (4, 0), (None, 1)], "doc_id bigint, quality int").withColumn("text", F.lit("own"))
    model = quality.train(docs, labels)
    got = [r.s for r in docs.select(quality.quality_score(docs, model, "text").alias("s")).collect()]
    assert len(got) == 8 and all(0 <= s <= 1 for s in got) and docs.limit(0).select(quality.quality_score(docs, model, "text")).count() == 0
    model = langid.train(docs)
    got = docs.select("doc_id", "text", langid.language(docs, model, "text").alias("f")).collect()
    assert len(got) == 8 and {r.f.lang_pred for r in got if r.text in (None, "", "12 34")} == {"und"}
    assert len({(r.f.lang_pred, r.f.score) for r in got if r.doc_id == 1}) == 1
    assert langid.train(docs.limit(0)).languages == []


def test_secrets_on_odd_rows(spark):
    docs = documents(spark)
    for model in (None, secrets.train(docs)):
        got = docs.select("doc_id", "text", secrets.secret_spans(docs, model, "text").alias("f"), secrets.redacted(docs, model, "text").alias("r")).collect()
        assert len(got) == 8 and all((r.r is None) == (r.text is None) for r in got)
        assert [s.kind for r in got if r.doc_id == 4 for s in r.f if s.kind == "assign"] == ["assign"]
    assert docs.limit(0).select(secrets.secret_spans(docs, None, "text")).count() == 0


def test_secrets_take_time_in_proportion():
    import time

    one = "token=abcdef123 deadbeef0123456789abcdef01 path/to/file9 "
    took = []
    for n in (2_000, 16_000):
        began = time.process_time()
        assert len(secrets.candidates(one * n, secrets.base(one * n))) >= 3 * n
        took.append(time.process_time() - began)
    assert took[1] < 30 * took[0]


def test_encoding_odd_rows(spark):
    docs = documents(spark)
    got = {r.doc_id: r for r in bpe.encode(docs, decoded=True).collect()}
    assert bytes(got[4].decoded).decode() == LONG and got[3].n_tokens == 0 and got[2].n_tokens == 0 and bytes(got[None].decoded) in (b"", b"no id here")
    assert bpe.encode(docs).count() == 8 and bpe.encode(docs.limit(0)).count() == 0


@pytest.mark.parametrize("parts", [1, 3, 8])
def test_an_id_with_several_texts_is_one_document(spark, parts):
    one, two = [" ".join(random.Random(s).choices(WORDS, k=60)) for s in (5, 6)]
    rows = [(5, one), (5, two), (6, one + " end"), (7, two + " end"), (8, "something else of six words here"), (3, one + " other"), (9, LONG), (10, LONG.upper()), (5, one)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").withColumns({c: F.lit(7) for c in CLASH}).repartition(parts)
    got = sorted((r.doc_id, r.component_id, r.kept) for r in neardup.near_duplicates(df, width=4).collect())
    assert got == [(3, 3, True), (5, 3, False), (5, 3, False), (5, 3, False), (6, 3, False), (7, 3, False), (8, 8, True), (9, 9, True), (10, 9, False)]


def test_one_outsider_in_a_large_bucket(spark):
    rng = random.Random(9)
    base = [rng.choice("abcdefghijklmnopq") + str(rng.randrange(900)) for _ in range(150)]
    rows = []
    for i in range(120):  # near copies of one text, and texts that share half of it only
        copy = list(base)
        for _ in range(2):
            copy[rng.randrange(150)] = f"x{i}"
        rows.append((i, " ".join(copy if i < 110 else copy[:75] + [f"y{i}z{k}" for k in range(75)])))
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    for small in (0, 32):
        got = {r.doc_id: r.component_id for r in neardup.near_duplicates(df, small=small).collect()}
        assert got == {i: 0 if i < 110 else i for i in range(120)}


def test_mixing_odd_rows(spark):
    docs = documents(spark)
    got = mixing.mixed(docs).collect()
    assert len(got) == 8 and all(r.copies == 1 for r in got if not r.n_tokens)
    again = mixing.repeated(docs)
    assert again.columns == docs.columns and again.count() == sum(r.copies for r in got)
    assert mixing.repeated(docs.limit(0)).count() == 0


def test_copies_of_both_forms_agree(spark):
    rng = random.Random(3)
    rows = [(i if i % 9 else None, " ".join(rng.choices(WORDS, k=rng.randint(0, 40))), "big" if i < 400 else f"s{i % 5}" if i % 7 else None) for i in range(600)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string").repartition(5)
    found = mixing.mixed(docs).groupBy("doc_id", "source").agg(F.sum("copies").alias("n")).where("n > 0").collect()
    seen = mixing.repeated(docs.repartition(2)).groupBy("doc_id", "source").agg(F.count("*").alias("n")).collect()
    assert sorted(map(str, found)) == sorted(map(str, seen))
    blocks = mixing.mixed(docs).where("doc_id IS NULL AND source = 'big'").select("block").distinct().count()
    assert blocks > 1  # null ids are dealt by their texts


def test_many_sources(spark):
    docs = spark.range(4000).select(F.col("id").alias("doc_id"), F.lit("a b c").alias("text"), F.concat(F.lit("s"), F.least("id", F.lit(2999)).cast("string")).alias("source"))
    got = mixing.mixed(docs, max_repeats=None, entropy=11.0).groupBy("source").agg(F.first("weight").alias("w")).agg(F.sum(-F.col("w") * F.log2("w")), F.count("*")).first()
    assert abs(got[0] - 11.0) < 1e-3 and got[1] == 3000
    assert {r.weight for r in mixing.weights(docs.limit(0).select("source", F.lit(1).alias("tokens"))).collect()} == set()


def vectors(spark):
    rows = [(20, [1.0, 0.0]), (20, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [0.6, 0.8]), (3, None), (None, [1.0, 0.0]), (4, []), (5, [0.0, -0.0]), (6, [float("inf"), 1.0])]
    return spark.createDataFrame(rows, "vec_id bigint, embedding array<float>").withColumns({c: F.lit(7) for c in CLASH})


def test_vectors_that_tie_and_clash(spark):
    got = sorted(((r.vec_id, r.n_links, r.component_id) for r in neighbours.linked(vectors(spark), 0.6).collect()), key=str)
    want = [(20, 2, 1), (20, 2, 1), (1, 2, 1), (2, 0, 2), (3, 0, 3), (None, 0, None), (4, 0, 4), (5, 0, 5), (6, 0, 6)]
    # a cosine of floats 0.6 and 0.8 is a little above 0.6
    want = [(i, n + (i in (20, 1)) if i != 2 else 3, 1 if i == 2 else c) for i, n, c in want]
    assert got == sorted(want, key=str)
    found = [(r.query_id, r["rank"], r.vec_id, r.score) for r in topk.top_k(vectors(spark), 2, is_query=F.col("vec_id") % 20 == 0).collect()]
    assert sorted(found) == [(20, 1, 1, 4096), (20, 1, 1, 4096), (20, 2, 2, 2432), (20, 2, 2, 2432)]
    assert topk.top_k(vectors(spark), 2, is_query=F.lit(None).cast("boolean")).count() == 0


def test_archives_of_odd_rows(spark, tmp_path):
    rows = [(1, "u", LONG), (2, "u", LONG), (None, None, None), (3, "u", "")]
    df = spark.createDataFrame(rows, "page_id bigint, url string, html string").withColumns({c: F.lit(7) for c in CLASH})
    got = sorted((r.page_id or 0, r.record_type, r.payload_bytes, r.refers_to) for r in warc.read_archives(warc.write_archives(df, f"file://{tmp_path}")).collect())
    assert got == [(0, "response", 0, None), (1, "revisit", len(LONG), 2), (2, "response", len(LONG), None), (3, "response", 0, None)]


def test_pipeline_on_clashing_columns_and_repeated_ids(spark):
    text = " ".join(random.Random(2).choices(WORDS, k=80))
    rows = [(1, text, "en", "a"), (1, text, "en", "a"), (1, text.upper(), "en", "a"), (2, text + " end", "en", "b"), (3, "le été nous avec qui " * 9, "fr", "a"), (3, "une autre chose de plus ici " * 7, "fr", "a"), (4, None, None, None), (None, text, "en", "b"), (6, LONG, "en", "a")]
    rows += [(100 + i, " ".join(random.Random(i).choices(["le", "été", "nous", "avec", "qui"] if i % 2 else WORDS, k=50)), "fr" if i % 2 else "en", "ab"[i % 2]) for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string").withColumn("n_chars", F.length("text").cast("bigint")).withColumns({c: F.lit(7) for c in CLASH})
    once = P.deduplicate(spark, docs, "")
    assert once.columns == docs.columns
    ids = [r.doc_id for r in once.collect()]
    assert ids.count(1) == 1 and 2 not in ids and ids.count(None) == 1 and 6 in ids and ids.count(3) == 1
    for name, stage in P.STAGES[:-1]:
        docs = common.stored(stage(spark, docs, ""))
        assert docs.columns == once.columns and docs.count() > 40, name
    assert P.encode(spark, docs, "").count() == docs.count()
    none = docs.limit(0)
    for _, stage in P.STAGES:
        assert stage(spark, none, "").count() == 0


def test_a_cluster_without_a_shared_folder_is_an_error():
    class Context:
        master = "spark://host:7077"

        def getConf(self):
            return {}

        def getCheckpointDir(self):
            return None

    class Session:
        sparkContext = Context()

    with pytest.raises(ValueError, match="checkpoint.dir"):
        common.shared_dir(Session())


def test_stored_files_go_when_they_are_freed(spark):
    import os

    df = common.stored(spark.range(3))
    path = df.stored_path
    assert os.path.isdir(path) and df.count() == 3
    common.freed(df, spark.range(1))
    assert not os.path.exists(path)
    common.freed(df)
