import base64
import hashlib
import random

import public_tokenizers as P
import tiktoken

from termloom.llm import bpe

RANKS = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(P.path(bpe.VOCABULARY), "rb"))}
LIBRARY = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=RANKS, special_tokens={})


def texts():
    rng = random.Random(7)
    odd = ["", " ", "\n\n  a", "it's 12345 ok!!", "é́  ñ　\x1c日本語テキスト", "<|endoftext|>", "x" * 5000, " " * 700 + "a", "1" * 2000 + "'re"]
    words = ["the", "'ll", " ", "  ", "\n", "don't", "Übung", "12", "…", "a b", "zz" * 40, "\t \t"]
    return odd + ["".join(rng.choices(words, k=n)) for n in (5, 50, 500, 3000)]


def test_merging_is_as_the_library_does():
    for t in texts():
        for piece in bpe.coder(open(P.path(bpe.VOCABULARY), "rb").read(), P.PATTERN).split(t):
            b = piece.encode()
            assert bpe.merged(b, RANKS) == bpe.merged_long(b, RANKS) if b not in RANKS else True


def test_chunks_give_the_same_ids(spark):
    rows = [(i, t) for i, t in enumerate(texts())] + [(100, None), (None, "no id"), (3, "again"), (3, "again")]
    df = spark.createDataFrame([(i, t, 1, 2) for i, t in rows], "doc_id bigint, text string, ids int, n_tokens int").repartition(3)
    for chunk, overlap in ((40, 8), (64, 16), (100_000, 100)):
        got = sorted(((r.doc_id if r.doc_id is not None else -1), r.n_tokens, bytes(r.ids), bytes(r.decoded)) for r in bpe.encode(df, chunk=chunk, overlap=overlap, decoded=True).collect())
        want = []
        for i, t in rows:
            ids = LIBRARY.encode_ordinary(t or "")
            want.append((i if i is not None else -1, len(ids), b"".join(x.to_bytes(4, "little") for x in ids), (t or "").encode()))
        assert got == sorted(want)
    back = bpe.decode(bpe.encode(df, chunk=64, overlap=16))
    assert sorted(bytes(r.decoded) for r in back.collect()) == sorted((t or "").encode() for _, t in rows)


def test_empty_table(spark):
    assert bpe.encode(spark.createDataFrame([], "doc_id bigint, text string")).count() == 0


def test_query_digests(spark):
    from termloom.llm.queries import op7_byte_bpe

    d = "/root/testdata/sf0.001"
    got = {r.doc_id: r for r in op7_byte_bpe(spark, d).collect()}
    for r in spark.read.parquet(f"{d}/documents.parquet").collect():
        ids = LIBRARY.encode_ordinary(r.text or "")
        assert got[r.doc_id].n_tokens == len(ids)
        assert got[r.doc_id].ids_sha256 == hashlib.sha256(b"".join(x.to_bytes(4, "little") for x in ids)).hexdigest()
        assert got[r.doc_id].decoded_sha256 == hashlib.sha256((r.text or "").encode()).hexdigest()
