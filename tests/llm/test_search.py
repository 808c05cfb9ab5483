"""Vectors beside brute force, archives as round trips, mixing and the pipeline by what they promise."""

import io
import random
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from termloom.llm import mixing, neighbours, topk, warc


def vectors(n=240, dim=8, seed=2):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, dim)).astype(np.float32)
    x[50:80] = x[0] + 0.05 * rng.normal(size=(30, dim))
    x[80:100] = x[1]
    rows = [(i, [float(v) for v in r]) for i, r in enumerate(x)]
    return rows + [(1000, None), (1001, []), (1002, [0.0] * dim), (1003, [float("nan")] + [1.0] * (dim - 1)), (1004, [None] + [1.0] * (dim - 1)), (1005, [1.0, 2.0, 3.0]), (1006, [2.0, 4.0, 6.0]), (1020, [1.0] * dim), (1040, None)]


def valid(v):
    return v and all(c is not None and np.isfinite(c) for c in v)


@pytest.mark.parametrize("rows", [16, 2048])
def test_links_against_all_pairs(spark, rows):
    data = vectors()
    df = spark.createDataFrame([(i, v, 1) for i, v in data], "vec_id bigint, embedding array<float>, n_links int").repartition(3)
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in neighbours.linked(df, 0.95, rows=rows).collect()}
    good = {i: np.array(v) for i, v in data if valid(v) and any(v)}
    near = {i: [j for j in good if j != i and len(good[j]) == len(good[i]) and good[i] @ good[j] / (np.linalg.norm(good[i]) * np.linalg.norm(good[j])) >= 0.95] for i in good}
    for i, _ in data:
        seen, todo = {i}, [i]
        while todo:
            for j in near.get(todo.pop(), []):
                if j not in seen:
                    seen.add(j)
                    todo.append(j)
        assert got[i] == (len(near.get(i, [])), min(seen), i == min(seen))
    assert neighbours.linked(df.limit(0), 0.95).count() == 0


@pytest.mark.parametrize(("k", "rows", "bins"), [(5, 32, 8), (300, 4096, 1024)])
def test_top_k_against_sorting(spark, k, rows, bins):
    data = vectors()
    df = spark.createDataFrame([(i, v, 1) for i, v in data], "vec_id bigint, embedding array<float>, score int").repartition(3)
    got = {}
    for r in topk.top_k(df, k, is_query=F.col("vec_id") % 20 == 0, rows=rows, query_rows=5, bins=bins, slab_bytes=500).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    whole = {i: np.floor(64 * np.array(v, np.float64)) for i, v in data if valid(v)}
    for q in [i for i in whole if i % 20 == 0]:
        best = sorted((-int(whole[q] @ whole[j]), j) for j in whole if j != q and len(whole[j]) == len(whole[q]))[:k]
        assert sorted(got[q]) == [(n + 1, j, -s) for n, (s, j) in enumerate(best)]
    assert topk.top_k(df.limit(0), k, is_query=F.lit(True)).count() == 0


@pytest.mark.parametrize("zip64", [False, True])
def test_archives(spark, tmp_path, zip64):
    long = "é" * 600
    rows = [(1, "http://a/ b\n", long), (2, "u", long), (2, "u", long), (3, None, "short"), (4, "u", "short"), (5, "u", None), (6, "u", "WARC/1.1\r\n\r\n\r\n" * 100), (None, "u", long)]
    df = spark.createDataFrame(rows, "page_id bigint, url string, html string").withColumn("payload", F.lit(1)).repartition(2)
    manifest = warc.write_archives(df, f"file://{tmp_path}", archive_bytes=700, zip64=zip64)
    got = sorted((r.page_id or 0, r.record_type, r.payload_bytes, r.refers_to, None if r.payload is None else bytes(r.payload).decode()) for r in warc.read_archives(manifest).collect())
    text = {k: (t or "") for k, _, t in rows if k}
    want = [(0, "revisit", 1200, 2, None), (1, "revisit", 1200, 2, None), (2, "response", 1200, None, long), (2, "response", 1200, None, long)]
    want += [(k, "response", len(text[k].encode()), None, text[k]) for k in (3, 4, 5, 6)]
    assert got == want
    assert manifest.count() > 1
    for r in manifest.collect():  # other readers read them too
        with zipfile.ZipFile(r.path.removeprefix("file://")) as z:
            assert z.testzip() is None and z.namelist() == [warc.DATA, warc.INDEX]
    assert warc.read_archives(warc.write_archives(df.limit(0), f"file://{tmp_path}/none")).count() == 0


class Ranges(io.BytesIO):
    def read_at(self, n, at):
        self.seek(at)
        return self.read(n)


def test_a_signature_in_a_comment_is_no_directory():
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("a", b"123")
        z.writestr("b", b"xx" * 100, zipfile.ZIP_DEFLATED)
        z.comment = b"PK\x05\x06" + b"c" * 30
    found = warc.members(Ranges(out.getvalue()), len(out.getvalue()))
    assert list(found) == ["a"] and out.getvalue()[found["a"][0] :][:3] == b"123"
    with pytest.raises(ValueError, match="end of central"):
        warc.members(Ranges(b"nothing"), 7)


def test_mixing(spark):
    rng = random.Random(1)
    rows = [(i, " ".join(["w"] * rng.randint(1, 30)), "big" if i < 900 else f"s{i % 4}" if i % 7 else None) for i in range(1200)]
    rows += [(2000, "", "big"), (2001, None, "empty"), (None, "x y", "s1"), (5, rows[5][1], "big")]
    df = spark.createDataFrame([(i, t, s, 3) for i, t, s in rows], "doc_id bigint, text string, source string, copies int")
    out = mixing.mixed(df, max_repeats=2.0).collect()
    assert len(out) == len(rows)
    total, per, took = 0, {}, {}
    for r in out:
        total += r.n_tokens
        per[r.source] = per.get(r.source, 0) + r.n_tokens
        took[r.source] = took.get(r.source, 0) + r.n_tokens * r.copies
        assert r.n_tokens or r.copies == 1
    weight = {r.source: r.weight for r in out}
    assert abs(sum(weight.values()) - 1) < 1e-6
    for s, n in per.items():
        if n:
            assert took[s] <= 2.0 * n + 1e-6
            assert 0 <= weight[s] * total - took[s] < 61  # the budget is met up to a document at the border
    flat = {r.source: r.weight for r in mixing.mixed(df, max_repeats=None, entropy=2.0).select("source", "weight").distinct().collect() if r.weight}
    assert abs(-sum(w * np.log2(w) for w in flat.values()) - 2.0) < 1e-3
    assert mixing.mixed(df.limit(0)).count() == 0


def test_pipeline_keeps_clean_documents(spark):
    import corpus_pipeline as P

    rows = [(i, " ".join(random.Random(i).choices(["the", "and", "thing", "was", "there"] if i % 2 else ["le", "été", "nous", "avec", "qui"], k=60)), "en" if i % 2 else "fr", f"s{i % 3}") for i in range(60)]
    rows += [(100, rows[3][1], "en", "s0"), (101, None, None, None), (102, "1234", None, "s1"), (103, rows[7][1] + " token=abcdef123456", "en", "s2"), (None, "the and thing was", "en", None)]
    docs = spark.createDataFrame([(i, t, lang, s, len(t or "")) for i, t, lang, s in rows], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    kept = P.identify(spark, docs, "")
    assert {r.doc_id for r in kept.collect()} == {r[0] for r in rows} - {101, 102}
    once = P.deduplicate(spark, kept, "")
    ids = {r.doc_id for r in once.collect()}
    assert 100 not in ids and {3, 7, None} <= ids
    clean = P.redact(spark, docs, "")
    assert "token" not in "".join(r.text or "" for r in clean.collect()) and clean.columns == docs.columns and clean.count() == docs.count()
    mix = P.mix(spark, once, "")
    assert mix.columns == docs.columns
    assert P.encode(spark, mix, "").count() == mix.count()
    for _, f in P.STAGES[1:]:
        assert f(spark, docs.limit(0), "").count() == 0
