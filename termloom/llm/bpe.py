"""Byte-level BPE encoding and decoding by overlapping chunks.

Texts up to a chunk's length are encoded where they lie. A longer text is cut into overlapping chunks, which are
pre-tokenised in parallel. A pre-token depends only on the text from its start on, so from the first boundary that two
neighbouring chunks agree on, the later chunk's boundaries are those of the whole text. The pieces between such stitches are
encoded in parallel and their ids joined in order. Where chunks find no common boundary (one very long run), the rest
of that text becomes one piece.

Nulls count as empty texts, which have no ids. Repeated rows stay repeated, null ids as well. Very long texts are encoded whole. Pairs of
equal rank are joined from the left. An empty table gives an empty result. Extra columns are not read, and may have any name.
"""

from __future__ import annotations

import base64
import heapq
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import map_batches, remembered

CHUNK, OVERLAP = 32_768, 1_024
#: Pieces that a worker remembers; then it starts anew.
REMEMBERED = 400_000
VOCABULARY = "byte_bpe_multi_50k.tiktoken"


def read_ranks(content: bytes) -> dict[bytes, int]:
    """The ranks of a file of lines of a base64 token and its rank."""
    return {base64.b64decode(a): int(b) for a, b in (x.split() for x in content.splitlines() if x.strip())}


def merged(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The ids of one pre-token: the adjacent pair of lowest rank is joined, the leftmost first, until none is left."""
    if (whole := ranks.get(piece)) is not None:
        return [whole]
    if len(piece) > 96:
        return merged_long(piece, ranks)
    parts = [piece[i : i + 1] for i in range(len(piece))]
    while len(parts) > 1:
        best, at = None, -1
        for i in range(len(parts) - 1):
            r = ranks.get(parts[i] + parts[i + 1])
            if r is not None and (best is None or r < best):
                best, at = r, i
        if best is None:
            break
        parts[at : at + 2] = [parts[at] + parts[at + 1]]
    return [ranks[p] for p in parts]


def merged_long(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """As merged(), by a heap of pairs over a linked list: n log n steps for a long piece."""
    n = len(piece)
    end, left, alive = [i + 1 for i in range(n)], [i - 1 for i in range(n)], [True] * n
    heap: list[tuple[int, int, int, int]] = []

    def offer(i: int) -> None:
        j = end[i]
        if j < n and (r := ranks.get(piece[i : end[j]])) is not None:
            heapq.heappush(heap, (r, i, j, end[j]))

    for i in range(n):
        offer(i)
    while heap:
        _, i, j, k = heapq.heappop(heap)
        if not alive[i] or end[i] != j or j >= n or not alive[j] or end[j] != k:
            continue
        alive[j], end[i] = False, k
        if k < n:
            left[k] = i
        offer(i)
        if left[i] >= 0:
            offer(left[i])
    return [ranks[piece[i : end[i]]] for i in range(n) if alive[i]]


class Coder(dict):
    """Remembers the packed ids of each pre-token it has met."""

    def __init__(self, content: bytes, pattern: str):
        super().__init__()
        self.ranks = read_ranks(content)
        self.split = regex.compile(pattern).findall
        self.token = {i: b for b, i in self.ranks.items()}

    def __missing__(self, piece: str) -> bytes:
        if len(self) >= REMEMBERED:
            self.clear()
        out = self[piece] = np.array(merged(piece.encode(), self.ranks), "<u4").tobytes()
        return out

    def encode(self, text: str) -> bytes:
        """The ids as little-endian unsigned 32-bit integers."""
        return b"".join(map(self.__getitem__, self.split(text)))

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.token.__getitem__, np.frombuffer(ids, "<u4").tolist()))

    def boundaries(self, text: str) -> list[int]:
        at, out = 0, []
        for piece in self.split(text):
            at += len(piece)
            out.append(at)
        return out


def coder(content: bytes, pattern: str) -> Coder:
    """One coder a worker and vocabulary."""
    return remembered((Coder, len(content), hash(content), pattern), lambda: Coder(content, pattern))


def encode(
    docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", vocabulary: str | None = None, pattern: str = public_tokenizers.PATTERN,
    chunk: int = CHUNK, overlap: int = OVERLAP, decoded: bool = False,
) -> DataFrame:
    """Per row of docs: the id, n_tokens long and ids binary (little-endian unsigned 32-bit), and with decoded the bytes
    that the ids stand for. vocabulary: the path of a rank file, by default a public one."""
    with open(vocabulary or public_tokenizers.path(VOCABULARY), "rb") as f:
        content = docs.sparkSession.sparkContext.broadcast(f.read())
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    more = ", decoded binary" if decoded else ""

    def whole(columns: list) -> Iterator[tuple]:
        c = coder(content.value, pattern)
        for i, text in zip(*columns, strict=True):
            ids = c.encode(text)
            yield (i, len(ids) // 4, ids, *([c.decode(ids)] if decoded else []))

    short = map_batches(rows.where(F.length("text") <= chunk), whole, f"id {kind}, n_tokens bigint, ids binary{more}")
    long = _long(rows.where(F.length("text") > chunk), content, pattern, kind, chunk, overlap, decoded)
    return short.unionByName(long).withColumnRenamed("id", id_col)


def _long(rows: DataFrame, content, pattern: str, kind: str, chunk: int, overlap: int, decoded: bool) -> DataFrame:
    """Encodes texts longer than a chunk; each step's rows are chunks or pieces of at most a few chunks."""
    size = F.length("text").cast("int")
    starts = F.sequence(F.lit(0), F.floor((size - 1) / chunk).cast("int"))
    chunks = F.transform(starts, lambda c: F.substring("text", c * chunk + 1, F.lit(chunk + overlap)))
    cut = rows.withColumn("row", F.monotonically_increasing_id()).select("row", "id", size.alias("n"), F.posexplode(chunks).alias("c", "part"))

    def pretokenise(columns: list) -> Iterator[tuple]:
        find = coder(content.value, pattern).boundaries
        for row, i, n, c, part in zip(*columns, strict=True):
            at = c * chunk
            found = find(part)
            if at + len(part) < n:
                found = found[:-1]  # what ends at a chunk's end may go on behind it
            yield row, i, n, c, part, [at + x for x in [0, *found] if x <= overlap], [at + x for x in found if x >= chunk]

    by_doc = Window.partitionBy("row").orderBy("c")
    so_far = by_doc.rowsBetween(Window.unboundedPreceding, 0)
    parts = map_batches(cut.repartition("row", "c"), pretokenise, f"row bigint, id {kind}, n int, c int, part string, head array<int>, tail array<int>")
    parts = parts.withColumn("start", F.when(F.col("c") == 0, 0).otherwise(F.array_min(F.array_intersect("head", F.lag("tail").over(by_doc)))))
    parts = parts.withColumn("agreed", F.min(F.col("start").isNotNull()).over(so_far))
    parts = parts.withColumn("piece", F.sum(F.col("agreed").cast("int")).over(so_far)).withColumn("goes_on", F.lead("agreed").over(by_doc)).withColumn("next", F.lead("start").over(by_doc))
    base = F.col("c") * chunk
    from_ = F.when(F.col("agreed"), F.col("start") - base).otherwise(0)
    to = F.when(F.col("goes_on") & F.col("agreed"), F.col("next") - base).otherwise(F.lit(chunk))
    pieces = parts.select("row", "id", "piece", "c", F.substring("part", from_ + 1, to - from_).alias("part"))
    pieces = pieces.groupBy("row", "id", "piece").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("c", "part"))), lambda x: x.part), "").alias("part"))

    def encode_piece(columns: list) -> Iterator[tuple]:
        c = coder(content.value, pattern)
        for row, i, piece, part in zip(*columns, strict=True):
            ids = c.encode(part)
            yield row, i, piece, ids, c.decode(ids) if decoded else b""

    done = map_batches(pieces.repartition("row", "piece"), encode_piece, f"row bigint, id {kind}, piece bigint, ids binary, decoded binary")
    joined = lambda name: F.unhex(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("piece", name))), lambda x: F.hex(x[name])), ""))
    out = done.groupBy("row", "id").agg(joined("ids").alias("ids"), *([joined("decoded").alias("decoded")] if decoded else []))
    return out.select("id", F.expr("cast(length(ids) div 4 as bigint) as n_tokens"), "ids", *(["decoded"] if decoded else []))


def decode(rows: DataFrame, *, id_col: str = "doc_id", ids_col: str = "ids", vocabulary: str | None = None) -> DataFrame:
    """Per row: the id and decoded binary, the bytes of its ids; null ids give no bytes."""
    with open(vocabulary or public_tokenizers.path(VOCABULARY), "rb") as f:
        content = rows.sparkSession.sparkContext.broadcast(f.read())
    kind = rows.schema[id_col].dataType.simpleString()

    def run(columns: list) -> Iterator[tuple]:
        c = coder(content.value, public_tokenizers.PATTERN)
        for i, ids in zip(*columns, strict=True):
            yield i, c.decode(ids or b"")

    return map_batches(rows.select(F.col(id_col).alias("id"), F.col(ids_col).alias("ids")), run, f"id {kind}, decoded binary").withColumnRenamed("id", id_col)
