"""Removal of repeated passages by sorted suffixes (a difference-cover suffix sort), for matches of a fixed length.

A byte goes if a string of `length` bytes that covers it also starts in a document with a smaller id. Equal strings have to meet in one
task before suffixes can be sorted there, so texts are sampled by content first: of every window of `length` bytes the sampled
position is that of its least hashed gram (the leftmost of equals). Equal windows have their sampled positions at equal offsets, and a gram that occurs
in one document only can't belong to a repeated window. So

1. every batch of documents tells buckets of the grams' hashes which sampled grams it has, and learns which of them other documents have, too;
2. it sends the distinct surroundings of those to the bucket, with the smallest id of each;
3. the bucket sorts the suffixes that start in them by difference cover (see ordered()): triples of words at positions that 3 doesn't divide get names by
   their order, suffixes at such positions are sorted by the names of their triples, the remaining suffixes by their first byte and the
   names of the next position; adjacent ones with equal prefixes of `length` bytes share the smallest id among them;
4. batches learn which windows have a smaller id elsewhere, and drop what they cover.

A gram in more than `hot` places of documents deals its windows out one by one, by their own hashes, so that no task gets all surroundings of
a passage that a third of the documents share; equal windows of one batch count once before they are sent.

Null texts are empty, and texts shorter than length keep all bytes. Documents of equal ids don't remove from each other. Rows without an id keep all bytes
and remove nothing. Every row gives one row, repeated rows included. An empty table gives an empty result. Only the id and the text are read; other columns may have any name.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blocks import rows_of
from .common import batch_of, slices, stored

#: Bytes of a match, of a gram whose hash decides, of texts in a batch, of texts in a bucket; places from which on a gram is hot.
LENGTH, GRAM, BATCH_BYTES, BUCKET_BYTES, HOT = 50, 16, 2 << 20, 8 << 20, 10_000
#: Bytes of a word; positions hashed at once; bits that hold a position among these.
WORD, SLICE, PLACE = 8, 1 << 18, np.uint64(20)
#: How texts and records are compressed that are stored and sent.
ZSTD = {"codec": "zstd"}
M1, M2, M3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9)


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * M3
    return h ^ (h >> np.uint64(29))


def gram_hashes(text: bytes) -> np.ndarray:
    """A hash of every gram of 16 bytes."""
    words = np.ndarray((len(text) - WORD + 1,), "<u8", text, 0, (1,))
    return mixed(words[:-WORD] * M1 ^ mixed(words[WORD:] * M2))


def sampled(text: bytes, length: int, starts: np.ndarray) -> tuple[np.ndarray, ...]:
    """The sampled grams of joined texts: hash, position, and first and last (exclusive) start of the windows that they are sampled for; those windows don't lie on both
    sides of a text's start, but may reach beyond its end."""
    n, wide = len(text) - length + 1, length - GRAM + 1
    if n < 1:
        return (np.zeros(0, np.uint64), *[np.zeros(0, np.int64)] * 3)
    found = []
    for at in range(0, n, SLICE):
        stop = min(at + SLICE, n)
        h = gram_hashes(text[at : stop + length - 1])
        least = (h >> PLACE << PLACE) | np.arange(len(h), dtype=np.uint64)
        span = 1
        while 2 * span <= wide:
            least = np.minimum(least[:-span], least[span:])
            span *= 2
        if wide > span:
            least = np.minimum(least[: span - wide], least[wide - span :])
        p = (least & ((np.uint64(1) << PLACE) - np.uint64(1))).astype(np.int64)
        new = np.r_[True, p[1:] != p[:-1]]
        new[starts[np.searchsorted(starts, at) : np.searchsorted(starts, stop)] - at] = True
        first = np.flatnonzero(new)
        found.append((h[p[first]], p[first] + at, first + at, np.r_[first[1:], stop - at] + at))
    return tuple(np.concatenate(c) for c in zip(*found, strict=True))


class Surroundings:
    """The sampled grams of a batch: gram, document's place, position in the batch's bytes, windows."""

    def __init__(self, row: dict, length: int):
        self.length, self.wide = length, length - GRAM + 1
        self.ids, self.sizes = np.frombuffer(row["ids"], "<i8"), np.frombuffer(row["sizes"], "<i8")
        self.known = np.frombuffer(row["known"], "?")
        ends = np.cumsum(self.sizes)
        self.text = unpacked(row["texts"], int(self.sizes.sum()))
        self.starts = ends - self.sizes
        self.gram, self.place, self.first, stop = sampled(self.text, length, self.starts)
        self.doc = np.searchsorted(self.starts, self.first, "right") - 1
        self.stop = np.minimum(stop, ends[self.doc] - length + 1)
        self.keep((self.stop > self.first) & self.known[self.doc])

    def keep(self, good: np.ndarray) -> None:
        self.gram, self.doc, self.place, self.first, self.stop = (c[good] for c in (self.gram, self.doc, self.place, self.first, self.stop))

    def single(self, hot: np.ndarray) -> None:
        """Windows of hot grams become surroundings of their own."""
        is_hot = in_sorted(hot, self.gram)
        n = np.where(is_hot, self.stop - self.first, 1)
        self.hot = np.repeat(is_hot, n)
        nth = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        self.gram, self.doc, self.place, self.first, self.stop = (np.repeat(c, n) for c in (self.gram, self.doc, self.place, self.first, self.stop))
        self.first = self.first + nth
        self.stop = np.where(self.hot, self.first + 1, self.stop)

    def records(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Distinct surroundings as fixed rows (gram, lowest column, number of windows, bytes aligned at the gram), the smallest id of each, and the row
        of every sampled gram."""
        bytes_ = np.frombuffer(self.text, np.uint8)
        width = self.wide - 1 + self.length
        low, many = self.wide - 1 - (self.place - self.first), self.stop - self.first
        at = np.arange(width)[None, :]
        rows = np.zeros((len(self.gram), 10 + width), np.uint8)
        rows[:, :8] = self.gram[:, None].view(np.uint8)
        rows[:, 8], rows[:, 9] = low, many
        inside = (at >= low[:, None]) & (at < (low + many + self.length - 1)[:, None])
        around = np.concatenate([np.zeros(self.wide - 1, np.uint8), bytes_, np.zeros(width, np.uint8)])
        np.multiply(np.lib.stride_tricks.sliding_window_view(around, width)[self.place], inside, out=rows[:, 10:])
        whole = rows.view(f"V{rows.shape[1]}").ravel()
        # equal rows have equal hashes; unequal ones with one hash only stay apart, perhaps in several records
        h = hashed(rows)
        order = np.lexsort((self.ids[self.doc], h, self.gram))
        new = np.r_[True, whole[order][1:] != whole[order][:-1]][: len(order)]
        of = np.empty(len(order), np.int64)
        of[order] = np.cumsum(new) - 1
        return rows[order[new]], self.ids[self.doc][order[new]], of


def unpacked(data: bytes, size: int) -> bytes:
    return pa.decompress(data, size, asbytes=True, **ZSTD) if size else b""


def hashed(rows: np.ndarray) -> np.ndarray:
    """A hash of each byte row."""
    wide = np.zeros((len(rows), -(-rows.shape[1] // WORD) * WORD), np.uint8)
    wide[:, : rows.shape[1]] = rows
    h = np.zeros(len(rows), np.uint64)
    for c in wide.view("<u8").T:
        h = mixed(h * M1 ^ c * M2)
    return h


def in_sorted(values: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Whether each x is among sorted values."""
    if not len(values):
        return np.zeros(len(x), bool)
    return values[np.minimum(np.searchsorted(values, x), len(values) - 1)] == x


def changes(order: np.ndarray, keys: list[np.ndarray]) -> np.ndarray:
    """In an order, whether a row differs from the one before it in any key."""
    new = np.zeros(len(order), bool)
    new[:1] = True
    for k in keys:
        s = k[order]
        new[1:] |= s[1:] != s[:-1]
    return new


def packed(keys: list[np.ndarray]) -> np.ndarray:
    """A number a row, which sorts as rows of keys (whole numbers from 0, most significant first) do; where 64 bits don't hold them all, names stand for the first ones."""
    bits = lambda k: int(k.max(initial=0)).bit_length()
    out = keys[0].astype(np.uint64)
    for k in keys[1:]:
        if bits(out) + bits(k) > 64:
            out = named([out]).astype(np.uint64)
        if bits(out) + bits(k) > 64:
            k = named([k])
        out = (out << np.uint64(bits(k))) | k.astype(np.uint64)
    return out


def named(keys: list[np.ndarray]) -> np.ndarray:
    """Names of rows of keys (most significant first): their places among the distinct ones in order."""
    key = packed(keys)
    order = np.argsort(key)
    out = np.empty(len(order), np.int32 if len(order) < 1 << 31 else np.int64)
    out[order] = np.cumsum(changes(order, [key])) - 1
    return out


def ordered(rows: np.ndarray, docs: np.ndarray, length: int) -> np.ndarray:
    """For surroundings of a bucket (rows of records() without the gram, the smallest id of each): bits of the windows (by column) for which another row has a smaller id.

    Suffixes are sorted by difference cover with words of 8 bytes as characters: triples of words get names, in order, at the two thirds of the columns that 3
    doesn't divide. A suffix there is sorted by the names of the triples that follow each other from it (the recursion, which ends once they cover `length` bytes)
    and the bytes left over; one at another column by its first byte and then as its successor. Windows that are equal lie in one column, so
    the suffixes of a column are merged with each other only.
    """
    wide, width = length - GRAM + 1, rows.shape[1] - 2
    low, many = rows[:, 0].astype(np.int64), rows[:, 1].astype(np.int64)
    padded = np.zeros((len(rows), width + 4 * WORD), np.uint8)
    padded[:, :width] = rows[:, 2:]
    words: dict[int, np.ndarray] = {}
    names: dict[int, np.ndarray] = {}

    def word(c: int) -> np.ndarray:
        if c not in words:
            words[c] = named([np.ascontiguousarray(padded[:, c : c + WORD]).view(">u8").ravel()])
        return words[c]

    def name(c: int) -> np.ndarray:
        if c not in names:
            names[c] = named([word(c), word(c + WORD), word(c + 2 * WORD)])
        return names[c]

    out = np.zeros(len(rows), np.uint64)
    for column in range(wide):
        v = np.flatnonzero((low <= column) & (column < low + many))
        if not len(v):
            continue
        at = column if column % 3 else column + 1
        for held in (names, words):
            for c in [c for c in held if c < at]:
                del held[c]  # later columns need later names only
        # the gram lies inside of every window, so it is no key of its own
        keys = [padded[v, column]] if at > column else []
        while at + 3 * WORD <= column + length:
            keys.append(name(at)[v])
            at += 3 * WORD
        key = packed([*keys, *[padded[v, c] for c in range(at, column + length)]])
        order = np.argsort(key)
        new = changes(order, [key])
        least = np.minimum.reduceat(docs[v][order], np.flatnonzero(new))[np.cumsum(new) - 1]
        out[v[order]] |= (least < docs[v][order]).astype(np.uint64) << np.uint64(column)
    return out


def batched(docs: DataFrame, id_col: str, text_col: str, batch_bytes: int) -> DataFrame:
    """Documents packed into rows of about batch_bytes: batch (a number), ids, known (whether there is an id), sizes, texts (UTF-8, compressed), n
    and size."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, texts, held = [], [], 0

        def out() -> pa.RecordBatch:
            whole = [np.array([i or 0 for i in ids], "<i8"), np.array([i is not None for i in ids], "?"), np.array([len(t) for t in texts], "<i8")]
            return batch_of([(*[c.tobytes() for c in whole], pa.compress(b"".join(texts), asbytes=True, **ZSTD), len(ids), held)], schema)

        for batch in batches:
            for part in slices(batch, batch_bytes):
                for i, t in zip(*[c.to_pylist() for c in part.columns], strict=True):
                    ids.append(i)
                    texts.append(t or b"")
                    held += len(texts[-1])
                    if held >= batch_bytes:
                        yield out()
                        ids, texts, held = [], [], 0
        if ids:
            yield out()

    fields = [("ids", pa.binary()), ("known", pa.binary()), ("sizes", pa.binary()), ("texts", pa.binary()), ("n", pa.int32()), ("size", pa.int64())]
    schema = pa.schema(fields)
    rows = docs.select(F.col(f"`{id_col}`").cast("bigint"), F.encode(F.col(f"`{text_col}`"), "UTF-8"))
    out = rows.mapInArrow(run, "ids binary, known binary, sizes binary, texts binary, n int, size bigint")
    return stored(out.withColumn("batch", F.monotonically_increasing_id()))


def own_grams(found: Surroundings, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct sampled grams of a batch in the order of buckets, in how many of its documents they are (1 if all have one id), and the place of
    every sampled gram among them."""
    ids = found.ids[found.doc]
    bucket = found.gram % np.uint64(buckets)
    order = np.lexsort((ids, found.gram, bucket))
    g, i = found.gram[order], ids[order]
    new = np.r_[True, g[1:] != g[:-1]][: len(g)]
    first = np.flatnonzero(new)
    stop = np.r_[first[1:], len(g)][: len(first)]
    of = np.empty(len(order), np.int64)
    of[order] = np.cumsum(new) - 1
    return g[first], np.where(i[first] == i[stop - 1], 1, np.minimum(stop - first, 1 << 30)).astype("<u4"), of


def shared_grams(batches: DataFrame, length: int, buckets: int, hot: int) -> DataFrame:
    """batch and marks: for the distinct sampled grams of a batch, bucket after bucket, whether two documents of different ids have it (1) or it is hot, too (2)."""

    def tell(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in rows_of(rows):
            g, many, _ = own_grams(Surroundings(row, length), buckets)
            yield from dealt(g % np.uint64(buckets), row["batch"], g, many)

    def meet(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in grouped(rows):
            grams = [np.frombuffer(r["a"], "<u8") for r in group]
            g, at = np.unique(np.concatenate(grams), return_inverse=True)
            many = np.bincount(at, np.concatenate([np.frombuffer(r["b"], "<u4") for r in group]))
            marks = (many > 1).astype(np.uint8) + (many > hot)
            parts = np.split(marks[at], np.cumsum([len(x) for x in grams])[:-1])
            # one batch a bucket: rows grow with the product of batches and buckets
            yield batch_of([(r["batch"], r["bucket"], own.tobytes()) for r, own in zip(group, parts, strict=True)], answer)

    answer = pa.schema([("batch", pa.int64()), ("bucket", pa.int32()), ("marks", pa.binary())])
    met = regrouped(batches.mapInArrow(tell, DEALT), buckets).mapInArrow(meet, "batch bigint, bucket int, marks binary")
    return met.groupBy("batch").agg(F.array_sort(F.collect_list(F.struct("bucket", "marks"))).alias("x")).select("batch", F.col("x.marks").alias("marks"))


DEALT = "bucket int, batch bigint, a binary, b binary"


def dealt(bucket: np.ndarray, batch: int, a: np.ndarray, b: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Rows of a and b, which are sorted by bucket, a row a bucket."""
    first = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]][: len(bucket)])
    schema = pa.schema([("bucket", pa.int32()), ("batch", pa.int64()), ("a", pa.binary()), ("b", pa.binary())])
    rows = [(int(bucket[x]), batch, a[x:y].tobytes(), b[x:y].tobytes()) for x, y in zip(first, [*first[1:], len(bucket)][: len(first)], strict=True)]
    if rows:
        yield batch_of(rows, schema)


def regrouped(rows: DataFrame, buckets: int) -> DataFrame:
    """Rows of a bucket together, in order of batches."""
    return rows.repartition(buckets, "bucket").sortWithinPartitions("bucket", "batch")


def grouped(batches: Iterator[pa.RecordBatch]) -> Iterator[list[dict]]:
    """The rows of one bucket after the other."""
    held: list[dict] = []
    for row in rows_of(batches):
        if held and held[0]["bucket"] != row["bucket"]:
            yield held
            held = []
        held.append(row)
    if held:
        yield held


def surroundings(row: dict, length: int, buckets: int) -> tuple[Surroundings, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of a batch beside the marks of its grams: the surroundings, their distinct records in the order of buckets, smallest ids, buckets, and the record of each."""
    found = Surroundings(row, length)
    g, _, of = own_grams(found, buckets)
    marks = np.frombuffer(b"".join(row["marks"] or []), np.uint8)
    found.keep(marks[of] > 0)
    hot = np.sort(g[marks > 1])
    found.single(hot)
    rows, ids, of = found.records()
    gram = rows[:, :8].copy().view("<u8").ravel()
    if len(hot):  # windows of hot grams go by their own bytes
        own = in_sorted(hot, gram)
        gram[own] = hashed(rows[own])
    bucket = (gram % np.uint64(buckets)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    back = np.empty(len(order), np.int64)
    back[order] = np.arange(len(order))
    return found, rows[order], ids[order], bucket[order], back[of]


def removed(docs: DataFrame, *, length: int = LENGTH, id_col: str = "doc_id", text_col: str = "text", batch_bytes: int = BATCH_BYTES, bucket_bytes: int = BUCKET_BYTES, hot: int = HOT) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans (runs of removed bytes), kept (the remaining bytes), a row a document.

    length: from the bytes of a gram (16) to 79 (windows of a gram are bits of a whole number).
    """
    if not GRAM <= length < GRAM + 64:
        raise ValueError(f"length has to lie between {GRAM} and {GRAM + 63}")
    batches = batched(docs, id_col, text_col, batch_bytes)
    buckets = max(8, -(-(batches.agg(F.sum("size")).first()[0] or 0) // bucket_bytes))
    # read twice, each time by batch: the texts are sent once
    beside = batches.join(stored(shared_grams(batches, length, buckets, hot)), "batch", "left")

    def send(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in rows_of(rows):
            _, records, ids, bucket, _ = surroundings(row, length, buckets)
            for part in dealt(bucket, row["batch"], records[:, 8:], ids):  # the gram is among the bytes
                small = pa.array([pa.compress(x, asbytes=True, **ZSTD) for x in part.column("a").to_pylist()], pa.binary())
                yield part.set_column(2, part.schema.field(2), small)

    def sort(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wide = 2 + 2 * length - GRAM
        answer = pa.schema([("batch", pa.int64()), ("bucket", pa.int32()), ("bits", pa.binary())])
        for group in grouped(rows):
            records = [np.frombuffer(unpacked(r["a"], len(r["b"]) // 8 * wide), np.uint8).reshape(-1, wide) for r in group]
            bits = ordered(np.concatenate(records), np.concatenate([np.frombuffer(r["b"], "<i8") for r in group]), length)
            parts = np.split(bits, np.cumsum([len(x) for x in records])[:-1])
            yield batch_of([(r["batch"], r["bucket"], own.tobytes()) for r, own in zip(group, parts, strict=True)], answer)

    sent = beside.mapInArrow(send, DEALT)
    found = regrouped(sent, buckets).mapInArrow(sort, "batch bigint, bucket int, bits binary")
    found = found.groupBy("batch").agg(F.array_sort(F.collect_list(F.struct("bucket", "bits"))).alias("found"))
    whole = beside.join(found.select("batch", F.col("found.bits").alias("bits")), "batch", "left")

    def drop(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fields = [(id_col, pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept", pa.binary())]
        for row in rows_of(rows):
            gone = covered(row, length, buckets)
            ids, known, sizes = (np.frombuffer(row[c], kind) for c, kind in (("ids", "<i8"), ("known", "?"), ("sizes", "<i8")))
            text, out = np.frombuffer(unpacked(row["texts"], len(gone)), np.uint8), []
            for i, k, at, n in zip(ids.tolist(), known, (np.cumsum(sizes) - sizes).tolist(), sizes.tolist(), strict=True):
                g = gone[at : at + n]
                spans = int(g[:1].sum() + np.count_nonzero(g[1:] & ~g[:-1]))
                out.append((i if k else None, n, int(g.sum()), spans, text[at : at + n][~g].tobytes()))
            yield batch_of(out, pa.schema(fields))

    return whole.mapInArrow(drop, f"`{id_col}` bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept binary")


def covered(row: dict, length: int, buckets: int) -> np.ndarray:
    """Of each byte of a batch, whether a window covers it that starts in a document of a smaller id, too."""
    n = int(np.frombuffer(row["sizes"], "<i8").sum())
    if not row["bits"]:
        return np.zeros(n, bool)
    found, _, least, _, of = surroundings(row, length, buckets)
    bits = np.frombuffer(b"".join(row["bits"]), "<u8")[of]
    # the batch's smallest id of a record goes by the bucket's word, the others lose all its windows
    later = found.ids[found.doc] > least[of]
    many = found.stop - found.first
    nth = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
    column = np.repeat(found.wide - 1 - (found.place - found.first), many) + nth
    repeated = np.repeat(later, many) | ((np.repeat(bits, many) >> column.astype(np.uint64)) & np.uint64(1)).astype(bool)
    start = (np.repeat(found.first, many) + nth)[repeated]
    return np.cumsum(np.bincount(start, minlength=n + 1) - np.bincount(start + length, minlength=n + 1))[:n] > 0
