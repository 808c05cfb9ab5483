"""How the sources of a language differ in their terms, by mergeable radix tries.

Tasks count terms in byte tries whose leaves hold a counter for each source and one for documents. A trie that has grown enough leaves the task in parts, cut at
fixed prefixes; a part's terms, in order, are written as the bytes that they share with the term before and the rest. The parts of a language and a prefix
range are merged into one trie, of which the terms in enough documents stay. Walking such a trie gives terms in the order of their UTF-8 bytes, from which sums over
pairs of sources are streamed, and for each source the candidates of its most over-used terms, ties in the walk's order.

So that no task holds a language: a range's trie has the terms of that range only, the ranges being cut at quantiles of a sample's terms (where exactly changes no result); a source with a
third of all rows is one counter a term, summed up before it is sent. Pairs of sources are sums over ranges, candidates at most `top` a source and range.

Terms are runs of letters A to Z, a to z and of characters beyond ASCII; only A to Z are lower-cased. Null text, language and source are empty strings. A group is a language and a source
that occur, with or without terms. All numbers are whole. Rows count as often as they occur. An empty table gives an empty result. Only the three columns are read; others may
have any name.
"""

from __future__ import annotations

import gc
from bisect import bisect_right
from collections import Counter, defaultdict
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .blocks import rows_of
from .common import batch_of, freed, hash_sample, slices, stored

#: Counters that a task holds before they go out as tries, terms scored at once, documents whose terms cut the ranges, and bytes of text a range.
HELD, PART, SAMPLE, RANGE_BYTES = 800_000, 4096, 2000, 24 << 20
#: What a count is raised by, and the whole of the shares.
ADDED, WHOLE = 5, 10**9
#: A to Z as a to z, letters and bytes beyond ASCII as they are, all others as blanks.
LETTERS = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


class Trie:
    """A radix trie over bytes. A node is [label, children by first byte (or None), documents, counters by source]; counters are None where no term ends."""

    def __init__(self):
        self.root = [b"", None, 0, None]

    def add(self, term: bytes, docs: int, counts: dict[str, int]) -> None:
        """Adds up; a new leaf keeps counts itself."""
        node, at, end = self.root, 0, len(term)
        while at < end:
            children = node[1]
            if children is None:
                children = node[1] = {}
            child = children.get(term[at])
            if child is None:
                children[term[at]] = [term[at:], None, docs, counts]
                return
            label = child[0]
            same = len(label)
            if not term.startswith(label, at):
                same = 1
                while at + same < end and label[same] == term[at + same]:
                    same += 1
                child[0] = label[same:]
                child = children[term[at]] = [label[:same], {label[same]: child}, 0, None]
            at += same
            node = child
        node[2] += docs
        if node[3] is None:
            node[3] = counts
        else:
            own = node[3]
            for source, n in counts.items():
                own[source] = own.get(source, 0) + n

    def walk(self) -> Iterator[tuple[int, bytes, int, dict[str, int]]]:
        """Terms in the order of their bytes: how many bytes a term shares with the one before, the term, documents and counters."""
        todo, shared = [(b"", self.root)], 0
        while todo:
            before, (label, children, docs, counts) = todo.pop()
            # what two terms share is the shortest path at which the walk has branched between them
            if len(before) < shared:
                shared = len(before)
            term = before + label
            if counts is not None:
                yield shared, term, docs, counts
                shared = len(term)
            if children:
                todo += [(term, children[b]) for b in sorted(children, reverse=True)]


@contextmanager
def uncollected() -> Iterator[None]:
    """Without the collector of cycles: tries have none, and it would walk their millions of nodes again and again."""
    was = gc.isenabled()
    gc.disable()
    try:
        yield
    finally:
        if was:
            gc.enable()


PACKED = [("sources", pa.list_(pa.string())), ("shared", pa.binary()), ("rest", pa.binary()), ("tails", pa.binary()), ("docs", pa.binary()), ("entries", pa.binary()), ("which", pa.binary()), ("counts", pa.binary())]
PACKED_SQL = "sources array<string>, shared binary, rest binary, tails binary, docs binary, entries binary, which binary, counts binary"


def packed(leaves: list[tuple[int, bytes, int, dict[str, int]]]) -> tuple:
    """Leaves of a walk (the first may share bytes with one that isn't there) as a row of PACKED: lengths of what a term shares with the one before and of the rest, the
    rests, documents, numbers of counters, their sources and values."""
    names: dict[str, int] = {}
    which: list[int] = []
    counts: list[int] = []
    for leaf in leaves:
        own = leaf[3]
        which += [names.setdefault(s, len(names)) for s in own]
        counts += own.values()
    shared = [0, *[leaf[0] for leaf in leaves[1:]]]
    tails = [leaf[1][k:] for k, leaf in zip(shared, leaves, strict=True)]
    rest = [len(t) for t in tails]
    kinds = [(shared, "<u4"), (rest, "<u4"), (None, ""), ([leaf[2] for leaf in leaves], "<i8"), ([len(leaf[3]) for leaf in leaves], "<u4"), (which, "<u4"), (counts, "<i8")]
    return list(names), *[b"".join(tails) if x is None else np.array(x, kind).tobytes() for x, kind in kinds]


def terms_of(row: dict) -> Iterator[tuple[bytes, int, dict[str, int]]]:
    """The terms of a packed row, in order."""
    shared, rest, docs, entries, which, counts = (np.frombuffer(row[c], kind).tolist() for c, kind in (("shared", "<u4"), ("rest", "<u4"), ("docs", "<i8"), ("entries", "<u4"), ("which", "<u4"), ("counts", "<i8")))
    names, tails, last, at, entry = row["sources"], row["tails"], b"", 0, 0
    for k, n, d, e in zip(shared, rest, docs, entries, strict=True):
        last = last[:k] + tails[at : at + n]
        yield last, d, {names[w]: c for w, c in zip(which[entry : entry + e], counts[entry : entry + e])}  # noqa: B905
        at, entry = at + n, entry + e


def words(text: bytes | None) -> list[bytes]:
    return (text or b"").translate(LETTERS).split()


def counted(docs: DataFrame, cuts: list[bytes]) -> DataFrame:
    """lang, range and packed tries of what tasks have counted. docs: lang, source, text (UTF-8)."""
    schema = pa.schema([("lang", pa.string()), ("range", pa.int32()), *PACKED])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, dict[str, Counter]] = defaultdict(lambda: defaultdict(Counter))
        documents: dict[str, Counter] = defaultdict(Counter)

        def out() -> Iterator[pa.RecordBatch]:
            for lang, seen in documents.items():
                # one language's trie at a time
                leaves: dict[bytes, dict[str, int]] = {term: {} for term in seen}
                for source, own in counts[lang].items():
                    for term, n in own.items():
                        leaves[term][source] = n
                trie = Trie()
                for term, own in leaves.items():
                    trie.add(term, seen[term], own)
                held: list = []
                at = 0
                for leaf in trie.walk():
                    place = bisect_right(cuts, leaf[1])
                    if place != at and held:
                        yield batch_of([(lang, at, *packed(held))], schema)
                        held = []
                    at = place
                    held.append(leaf)
                if held:
                    yield batch_of([(lang, at, *packed(held))], schema)
            counts.clear()
            documents.clear()

        for batch in batches:
            for part in slices(batch):
                for lang, source, text in zip(*[c.to_pylist() for c in part.columns], strict=True):
                    found = words(text)
                    counts[lang][source].update(found)
                    documents[lang].update(set(found))
                if sum(len(c) for own in counts.values() for c in own.values()) > HELD:
                    yield from out()
        yield from out()

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with uncollected():
            yield from run(batches)

    return docs.mapInArrow(task, f"lang string, range int, {PACKED_SQL}")


def merged(tries: DataFrame, ranges: int, at_least: int) -> DataFrame:
    """lang, range, the packed terms of at least so many documents, their number v, and sums of their counts by source (in the order of sources)."""
    schema = pa.schema([("lang", pa.string()), ("range", pa.int32()), *PACKED, ("v", pa.int64()), ("sums", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, trie = None, Trie()

        def out() -> Iterator[pa.RecordBatch]:
            kept, shared = [], 0
            for k, term, docs, own in trie.walk():
                shared = min(shared, k)  # with the last term that was kept
                if docs >= at_least:
                    kept.append((shared, term, docs, own))
                    shared = len(term)
            if kept:
                row = packed(kept)
                sums: Counter = Counter()
                for _, _, _, own in kept:
                    sums.update(own)
                yield batch_of([(*now, *row, len(kept), [sums[s] for s in row[0]])], schema)

        for row in rows_of(batches):
            if (key := (row["lang"], row["range"])) != now:
                yield from out()
                now, trie = key, Trie()
            for leaf in terms_of(row):
                trie.add(*leaf)
        yield from out()

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with uncollected():
            yield from run(batches)

    dealt = tries.repartition(ranges, "lang", "range").sortWithinPartitions("lang", "range")
    return stored(dealt.mapInArrow(task, f"lang string, range int, {PACKED_SQL}, v bigint, sums array<bigint>"))


def shares(counts: np.ndarray, totals: np.ndarray) -> np.ndarray:
    """1 + floor(WHOLE * (count + ADDED) / total), exactly."""
    if counts.size and int(counts.max()) + ADDED >= (1 << 63) // WHOLE:
        return np.array([[1 + WHOLE * (int(c) + ADDED) // int(t) for c, t in zip(row, np.broadcast_to(totals, row.shape), strict=True)] for row in counts], np.int64)
    return 1 + WHOLE * (counts + ADDED) // totals


def measured(ranges: DataFrame, top: int) -> DataFrame:
    """lang, source, part, item, value: for each range, sums over its terms for every ordered pair of sources, and the `top` most over-used terms of every source. ranges: packed
    rows beside v (of the language), names and totals (its sources, and counts of kept terms in each)."""
    schema = pa.schema([("lang", pa.string()), ("source", pa.string()), ("part", pa.string()), ("item", pa.string()), ("value", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in rows_of(batches):
            names = row["names"]
            place = {s: k for k, s in enumerate(names)}
            wide = row["v"] * ADDED
            own = np.array(row["totals"], np.int64) + wide
            whole = np.array([sum(row["totals"]) + wide], np.int64)
            sums = np.zeros((len(names), len(names)), np.int64)
            best: list[list[tuple[int, bytes]]] = [[] for _ in names]
            terms: list[bytes] = []
            counts = np.zeros((PART, len(names)), np.int64)

            def score(terms=terms, counts=counts, own=own, whole=whole, sums=sums, best=best) -> None:
                c = counts[: len(terms)]
                p, q = shares(c, own), shares(c.sum(1, keepdims=True), whole)
                for a in range(len(best)):
                    sums[a] += np.abs(p - p[:, a : a + 1]).sum(0)
                    over = np.flatnonzero((c[:, a] > 0) & (p[:, a] > q[:, 0]))
                    f = (p[:, a] - q[:, 0])[over]
                    # stable, so that ties stay in the walk's order; what came before comes first
                    first = np.argsort(-f, kind="stable")[:top]
                    both = best[a] + [(int(f[k]), terms[over[k]]) for k in first]
                    best[a] = sorted(both, key=lambda x: -x[0])[:top]

            for term, _, entries in terms_of(row):
                for s, n in entries.items():
                    counts[len(terms), place[s]] = n
                terms.append(term)
                if len(terms) == PART:
                    score()
                    terms.clear()
                    counts[:] = 0
            score()
            out = [(row["lang"], names[a], "pair", names[b], int(sums[a, b])) for a in range(len(names)) for b in range(len(names)) if a != b]
            out += [(row["lang"], names[a], "term", term.decode(), f) for a, found in enumerate(best) for f, term in found]
            if out:
                yield batch_of(out, schema)

    return ranges.mapInArrow(run, "lang string, source string, part string, item string, value bigint")


def audited(
    docs: DataFrame, *, lang_col: str = "lang", source_col: str = "source", text_col: str = "text", at_least: int = 30, top: int = 50, range_bytes: int = RANGE_BYTES, sample: int = SAMPLE,
) -> DataFrame:
    """lang, source, part (pair or term), item, value and rank, for every language and source that occur. The terms of a language are those in at_least documents of it."""
    text = lambda c: F.coalesce(F.col(f"`{c}`"), F.lit(""))
    rows = docs.select(text(lang_col).alias("lang"), text(source_col).alias("source"), F.encode(text(text_col), "UTF-8").alias("text"))
    groups = stored(rows.groupBy("lang", "source").agg(F.sum(F.length("text").cast("bigint")).alias("size")))
    ranges = max(4, -(-(groups.agg(F.sum("size")).first()[0] or 0) // range_bytes))
    seen: set[bytes] = set()
    for r in hash_sample(rows.select("text"), None, sample).limit(sample).toLocalIterator():
        seen.update(words(r.text))
    terms = sorted(seen)
    cuts = sorted({terms[len(terms) * k // ranges] for k in range(1, ranges)}) if terms else []
    tries = merged(counted(rows, cuts), ranges * 2, at_least)
    sums = tries.select("lang", F.explode(F.arrays_zip("sources", "sums")).alias("x")).groupBy("lang", F.col("x.sources").alias("source")).agg(F.sum("x.sums").alias("n"))
    totals = groups.join(sums, ["lang", "source"], "left").groupBy("lang").agg(F.array_sort(F.collect_list(F.struct("source", F.coalesce("n", F.lit(0)).alias("n")))).alias("s"))
    totals = totals.join(tries.groupBy("lang").agg(F.sum("v").alias("all")), "lang")
    beside = tries.drop("v", "sums").join(totals, "lang").select("lang", *[n for n, _ in PACKED], F.col("all").alias("v"), F.col("s.source").alias("names"), F.col("s.n").alias("totals"))
    found = stored(measured(beside, top))
    value = found.where("part = 'pair'").groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
    pairs = groups.select("lang", "source").join(groups.select("lang", F.col("source").alias("item")), "lang").where("source <> item")
    pairs = pairs.join(value, ["lang", "source", "item"], "left").select("lang", "source", F.lit("pair").alias("part"), "item", F.coalesce("value", F.lit(0)).alias("value"))
    both = pairs.unionByName(found.where("part = 'term'"))
    place = Window.partitionBy("lang", "source", "part").orderBy(F.desc("value"), "item")
    out = stored(both.withColumn("rank", F.row_number().over(place)).where(f"part = 'pair' OR rank <= {top}"))
    freed(groups, tries, found)
    return out
