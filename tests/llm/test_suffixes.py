"""Suffix dedup beside all windows of all texts."""

import random

import pyarrow as pa
import pytest

from termloom.llm import suffixes

SCHEMA = "doc_id bigint, text string, n_bytes int, kept string, batch int, `a.b` int"


def corpus(seed, n=60):
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdé") for _ in range(r.randint(1, 7)))
    passages = [" ".join(word() for _ in range(r.randint(8, 40))) for _ in range(6)]
    docs = []
    for i in range(n):
        t = ""
        for _ in range(r.randint(0, 6)):
            t += r.choice(passages) if r.random() < 0.5 else " ".join(word() for _ in range(r.randint(1, 30)))
            if r.random() < 0.3:
                t += r.choice([" ", "\n", "\0", "", "a" * r.randint(1, 120), "ab" * r.randint(1, 80)])
        docs.append((i * 3, t))
    docs += [(0, docs[5][1]), (7, docs[5][1]), (7, docs[5][1]), (None, docs[5][1]), (1000, None), (1001, ""), (-4, passages[1])]
    docs += [(1002, passages[0] * 300), (1003, passages[0] * 300 + "x")]
    r.shuffle(docs)
    return docs


def brute(docs, length):
    first = {}
    for i, t in docs:
        b = (t or "").encode()
        for s in range(len(b) - length + 1):
            if i is not None:
                first[b[s : s + length]] = min(first.get(b[s : s + length], i), i)
    out = []
    for i, t in docs:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for s in range(len(b) - length + 1):
            if i is not None and first[b[s : s + length]] < i:
                gone[s : s + length] = b"\1" * length
        spans = sum(1 for k, g in enumerate(gone) if g and not (k and gone[k - 1]))
        out.append((i, len(b), sum(gone), spans, bytes(x for x, g in zip(b, gone, strict=True) if not g)))
    return out


# hot: windows are dealt singly; 16 and 79 are the ends of what length may be
@pytest.mark.parametrize(("length", "sizes"), [(50, {}), (50, {"batch_bytes": 900, "bucket_bytes": 2000, "hot": 5}), (17, {"batch_bytes": 300, "hot": 2}), (79, {"batch_bytes": 5000, "hot": 3}), (16, {})])
def test_against_all_windows(spark, length, sizes):
    docs = corpus(length)
    df = spark.createDataFrame([(i, t, 1, "x", 2, 3) for i, t in docs], SCHEMA).repartition(4)
    got = [(r.doc_id, r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in suffixes.removed(df, length=length, **sizes).collect()]
    assert sorted(got, key=str) == sorted(brute(docs, length), key=str)


def test_slices_of_long_texts(spark, monkeypatch):
    monkeypatch.setattr(suffixes, "SLICE", 64)
    row = {"ids": b"\0" * 8, "known": b"\1", "sizes": (3000).to_bytes(8, "little"), "texts": pa.compress(random.Random(1).randbytes(3000), asbytes=True, **suffixes.ZSTD)}
    found = suffixes.Surroundings(row, 50)
    starts = [s for a, b in zip(found.first, found.stop, strict=True) for s in range(a, b)]
    assert starts == list(range(2951)) and ((found.place - found.first) <= 34).all() and (found.place >= found.stop - 1).all()


def test_empty_and_bounds(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert suffixes.removed(df).count() == 0
    only = suffixes.removed(spark.createDataFrame([(None, None), (None, "x" * 99)], "doc_id bigint, text string")).collect()
    assert sorted((r.n_bytes, r.n_removed) for r in only) == [(0, 0), (99, 0)]
    with pytest.raises(ValueError, match="length"):
        suffixes.removed(df, length=15)


def test_names_follow_the_order_of_triples():
    import numpy as np

    keys = [np.array([2, 1, 2, 1]), np.array([0, 5, 0, 4])]
    assert suffixes.named(keys).tolist() == [2, 1, 2, 0]


def test_keys_beyond_64_bits_sort_as_their_rows():
    import numpy as np

    rng = np.random.default_rng(5)
    keys = [rng.integers(0, 3, 500).astype(np.uint64) << np.uint64(62), *[rng.integers(0, 4, 500).astype(np.uint64) << np.uint64(61) for _ in range(3)], rng.integers(0, 3, 500)]
    rows = list(zip(*[k.tolist() for k in keys], strict=True))
    place = {r: k for k, r in enumerate(sorted(set(rows)))}
    assert suffixes.named(keys).tolist() == [place[r] for r in rows]


def test_a_bucket_answers_all_batches_at_once(spark, monkeypatch):
    """Answers grow with batches times buckets; an Arrow batch each made the work grow so, too."""
    docs = [(i, "the same passage of more than fifty bytes in every document, and " + str(i) * 40) for i in range(64)]
    df = spark.createDataFrame(docs, "doc_id bigint, text string").coalesce(1)
    made, path = suffixes.batch_of, spark.sparkContext.accumulator(0)

    def counted(rows, schema):
        if schema.names[-1] in ("marks", "bits"):
            path.add(1)
        return made(rows, schema)

    monkeypatch.setattr(suffixes, "batch_of", counted)
    assert suffixes.removed(df, batch_bytes=200, bucket_bytes=1 << 20).count() == 64
    assert 0 < path.value <= 4 * 8  # 32 batches, 8 buckets, 2 answers, each perhaps evaluated twice
