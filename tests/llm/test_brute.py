"""Models beside plain loops that do the same a number at a time."""

import math
import zlib

import numpy as np
from pyspark.sql import functions as F

from termloom.llm import langid, quality, secrets, urls

SF = "/root/testdata/sf0.001"


def test_ftrl_by_loops():
    rng = np.random.default_rng(4)
    words = ["good", "fine", "clear", "bad", "spam", "!!!", "the", "of"]
    texts = [(int(k % 2), " ".join(rng.choice(words[:3] if k % 2 else words[3:6], 3).tolist() + rng.choice(words[6:], 4).tolist())) for k in range(40)]
    bits, alpha, beta, l1, l2 = 12, 0.3, 1.0, 0.02, 0.1

    def counts(text):
        at, n = np.unique(quality.features(text, bits), return_counts=True)
        return at, n

    model = quality.ftrl([(y, *counts(t)) for y, t in texts], bits, epochs=3)
    z, n = {}, {}
    weight = lambda i, free: 0.0 if not free and abs(z.get(i, 0.0)) <= l1 else -(z.get(i, 0.0) - (0 if free else math.copysign(l1, z.get(i, 0.0)))) / ((beta + math.sqrt(n.get(i, 0.0))) / alpha + l2)
    order, again = np.arange(len(texts)), np.random.default_rng(1)
    for _ in range(3):
        again.shuffle(order)
        for k in order:
            y, text = texts[k]
            at, c = counts(text)
            x = {int(i): v / math.sqrt(c.sum()) for i, v in zip(at, c, strict=True)} | {"bias": 1.0}
            w = {i: weight(i, i == "bias") for i in x}
            p = 1 / (1 + math.exp(-sum(w[i] * x[i] for i in x)))
            for i in x:
                g = (p - y) * x[i]
                z[i] = z.get(i, 0.0) + g - (math.sqrt(n.get(i, 0.0) + g * g) - math.sqrt(n.get(i, 0.0))) / alpha * w[i]
                n[i] = n.get(i, 0.0) + g * g
    assert abs(model.bias - weight("bias", True)) < 1e-9
    for _, text in texts:
        at = quality.features(text, bits)
        score = 1 / (1 + math.exp(-weight("bias", True) - sum(weight(int(i), False) for i in at) / math.sqrt(len(at))))
        assert abs(model.score(text) - score) < 1e-5
    assert all(model.score(t) > 0.5 for y, t in texts if y) and all(model.score(t) < 0.5 for y, t in texts if not y)


def test_language_by_dense_softmax(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for dim in (16, 2):  # with fewer dimensions than languages embeddings are kept, else what the softmax makes of them
        was, langid.DIM = langid.DIM, dim
        try:
            model = langid.train(docs)
        finally:
            langid.DIM = was
        assert (model.head is None) == (dim == 16) and len(model.languages) == 4
        rows = docs.select("text", langid.language(docs, model, "text").alias("f")).collect()
        for r in rows[:60]:
            grams = []
            for w in langid.words_of((r.text or "").lower()):
                s = f"<{w}>"
                grams += [s[i : i + n] for n in (2, 3, 4) for i in range(len(s) - n + 1)] + [f"={s}"]
            if not grams:
                assert tuple(r.f) == ("und", 0.0, True)
                continue
            mean = sum(model.rows[zlib.crc32(g.encode()) % langid.BUCKETS].astype(np.float64) for g in grams) / len(grams)
            z = ((mean if model.head is None else mean @ model.head) + model.bias) / model.temperature
            p = np.exp(z - z.max()) / np.exp(z - z.max()).sum()
            assert r.f.lang_pred == model.languages[int(p.argmax())] and abs(r.f.score - p.max()) < 1e-6


def test_convolution_by_loops():
    rng = np.random.default_rng(3)
    m = secrets.Model(rng.normal(0, 1, (secrets.WIDTH, secrets.CODES, secrets.FILTERS)), rng.normal(0, 1, secrets.FILTERS), rng.normal(0, 1, secrets.FILTERS), 0.3, (1.5, -0.2))
    text = "see token: Zx9QkLm3vB7tYw2PsD4f7 and é9ab12cd34ef56 end"
    for start, end in ((11, 32), (37, 51)):
        x = secrets.codes(text, start, end)
        total = m.bias
        for f in range(secrets.FILTERS):
            best = max(m.shift[f] + sum(m.conv[j][x[k + j]][f] for j in range(secrets.WIDTH)) for k in range(len(x) - secrets.WIDTH + 1))
            total += max(best, 0.0) * m.dense[f]
        assert abs(m.scores(x[None])[0] - 1 / (1 + math.exp(-(1.5 * total - 0.2)))) < 1e-9


def walk(tree, x):
    """The value of a leaf, by going down node after node."""
    feature, limit, leaf = tree
    at = 0
    while at < len(feature):
        at = 2 * at + 1 + (x[feature[at]] > limit[at])
    return leaf[at - len(feature)]


def test_trees_by_walking_down():
    rng = np.random.default_rng(6)
    x = rng.normal(size=(300, 5))
    y = ((x[:, 1] > 0.2) ^ (x[:, 3] < -0.1)).astype(float)
    start, trees = urls.boost(x, y)
    p = urls.Model(0.5, start, trees=trees).probability(x)
    for k in range(0, 300, 7):
        z = start + sum(walk(t, x[k]) for t in trees)
        assert abs(p[k] - 1 / (1 + math.exp(-z))) < 1e-12
    assert ((p > 0.5) == y).mean() > 0.95
    # the first split has the greatest gain of all limits
    g, h = np.full(300, y.mean()) - y, np.full(300, y.mean() * (1 - y.mean()))
    gain = lambda m: g[m].sum() ** 2 / (h[m].sum() + 1) + g[~m].sum() ** 2 / (h[~m].sum() + 1)
    edges = [np.unique(np.quantile(c, np.linspace(0, 1, urls.BINS + 1)[1:-1])) for c in x.T]
    best = max(gain(x[:, j] <= e) for j in range(5) for e in edges[j])
    assert abs(gain(x[:, trees[0][0][0]] <= trees[0][1][0]) - best) < 1e-9


def test_url_features_by_counting():
    url = "http://a-b.example.com/x/y2/z.html?p=1&q=&&r#t"
    x = dict(zip(urls.FEATURES, urls.lexical(url, "a-b.example.com", "/x/y2/z.html", [{}] * 4, 0.25), strict=True))
    assert x["length"] == len(url) and x["depth"] == 3 and x["parameters"] == 3 and x["labels"] == 3 and x["hyphens"] == 1 and x["fragment"] == 1
    assert abs(x["digit ratio"] - 2 / len(url)) < 1e-12 and x["last label's share"] == 0.25 and x["longest part"] == 6


def test_the_same_urls_are_learned_from_each_time(spark):
    rows = [(f"http://h{k % 9}.net/p{k % 40}", f"h{k % 9}.net", f"/p{k % 40}", "block" if k % 3 else "allow") for k in range(4000)]
    df = spark.createDataFrame(rows, "url string, host string, path string, verdict string")
    a, b = [urls.train(df.repartition(n), max_rows=100) for n in (1, 7)]
    assert a.start == b.start and a.shares == b.shares and all((s[0] == t[0]).all() and (s[2] == t[2]).all() for s, t in zip(a.trees, b.trees, strict=True))


def test_no_trees_where_a_rule_decides(spark):
    df = spark.createDataFrame([(1, "http://a.net/x"), (2, "http://a.com/x"), (2, "http://a.com/x"), (3, "http://a.com/" + "x/1" * 100_000)], "page_id bigint, url string")
    got = urls.judged(df.withColumn("blocked", F.lit(1)).withColumn("verdict", F.lit("own")), {"net/": "block"}, model=urls.Model(0.5, 3.0)).orderBy("page_id").collect()
    assert [(r.page_id, r.rule, r.verdict, r.blocked is None) for r in got] == [(1, "net/", "block", True), (2, None, "block", False), (2, None, "block", False), (3, None, "block", False)]
