"""What a Python worker holds as it serves one stage of the pipeline after another."""

import gc
import tracemalloc

import public_tokenizers as P
import pyarrow as pa

from termloom.llm import bpe, common, langid, neardup, secrets


def held():
    gc.collect()
    return {type(x).__module__ for x in gc.get_objects() if isinstance(x, (langid.Words, neardup.Words, bpe.Coder)) and len(x)}


def test_a_worker_keeps_what_one_operator_remembers():
    model = langid.Model(["de", "fr"], langid.np.zeros((langid.BUCKETS, 2)), None, langid.np.zeros(2))
    content = open(P.path(bpe.VOCABULARY), "rb").read()
    uses = [
        ("termloom.llm.langid", lambda: langid.words_for(model).total(["ein", "mot"])),
        ("termloom.llm.neardup", lambda: neardup.shingles("ein mot de plus", 2)),
        ("termloom.llm.bpe", lambda: bpe.coder(content, P.PATTERN).encode("ein mot")),
        ("termloom.llm.neardup", lambda: neardup.shingles("ein mot de plus", 2)),
    ]
    for name, use in uses:
        use()
        assert held() == {name}
    words = common.remembered(neardup.Words, neardup.Words)
    neardup.shingles("noch ein mot", 2)
    assert common.remembered(neardup.Words, neardup.Words) is words and b"noch" in words  # kept from batch to batch
    common.forget()
    del words
    assert held() == set()


def test_texts_are_python_objects_a_slice_at_a_time():
    texts = pa.array([f"{k} token=abcdefgh{k} " + "x y " * 2_500 if k % 9 else None for k in range(4_000)])
    assert texts.nbytes > 32 << 20
    most = []

    def of(part):
        most.append(sum(len(t or "") for t in part))
        return (secrets.redact(t, [(s, e) for _, s, e, _ in found], "[SECRET]") for t, found in zip(part, secrets.spans_of(part, None), strict=True))

    expected = [None if t is None else secrets.redact(t, [(s, e) for _, s, e, _ in secrets.spans(t, None)], "[SECRET]") for t in texts.to_pylist()]
    tracemalloc.start()
    got = common.mapped(texts, of, pa.string())
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(most) > 3 and max(most) <= 9 << 20
    assert peak < 25 << 20  # two slices, and not two batches
    assert got.to_pylist() == expected and common.mapped(pa.array([], pa.string()), of, pa.string()).to_pylist() == []


def test_a_rounds_mean_does_not_depend_on_how_shares_lie(spark):
    """Sums go from tasks to groups of tasks to the driver."""
    docs = spark.createDataFrame([(k, f"plain{k % 7}words x{k:012d}y token=Ab{k * 7919:09d}Cd") for k in range(300)], "doc_id bigint, text string")
    found = common.stored(secrets.findings(docs.selectExpr("doc_id AS id", "text", "cast(null AS array<struct<start: int, end: int, label: int>>) AS said")))
    one = secrets.shared(found, {0: 300, 1: 300})
    rows = [r.asDict() for r in one.collect()]
    several = spark.createDataFrame([tuple((r | {"share": k}).values()) for r in rows for k in range(7)], one.schema)
    nets = [secrets.round_of(several.repartition(n), secrets.begun(), 1) for n in (1, 2, 7)]
    alone = [secrets.round_of(several.where(f"share = {k}"), secrets.begun(), 1) for k in range(7)]
    for k, p in enumerate(nets[0]):
        assert all((p == other[k]).all() for other in nets[1:])
        assert abs(p - sum(a[k].astype(float) for a in alone) / 7).max() < 1e-6
