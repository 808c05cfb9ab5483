"""Quality classifier: logistic regression on hashed word n-grams, trained with follow-the-regularised-leader updates.

A text's features are its words and punctuation runs and their pairs, hashed to 2**bits buckets; a feature's value is its count
over the root of the number of features. Training takes a bounded sample of labelled rows (about max_rows,
chosen by the hash of their ids); scoring is one sparse dot product a text, over whole texts.

Null texts count as empty; an empty text's score is that of the bias alone. Labels other than 0 and 1 are not learned
from. Without any label every score is 0.5. Rows with equal texts get equal scores; repeated ids count each. Very long texts are
scored whole. An empty table gives an empty result; columns other than the text (in training the id and the label, too) are not
read, and may have any name.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import hash_sample, map_batches

BITS, MAX_ROWS, EPOCHS = 18, 6_000, 3
REMEMBERED = 300_000
words_of = re.compile(r"\w+|[^\w\s]+").findall


class Hashes(dict):
    """Remembers the hash of each word it has met."""

    def __missing__(self, word: str) -> int:
        if len(self) >= REMEMBERED:
            self.clear()
        out = self[word] = zlib.crc32(word.encode("utf-8", "surrogatepass")) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF
        return out


_hashes = Hashes()


def features(text: str | None, bits: int = BITS) -> np.ndarray:
    """The buckets of a text's words and word pairs."""
    found = words_of(text or "")
    h = np.fromiter(map(_hashes.__getitem__, found), np.uint64, len(found))
    pairs = (h[:-1] * np.uint64(0xD6E8FEB86659FD93)) ^ h[1:]
    pairs *= np.uint64(0xFF51AFD7ED558CCD)
    return (np.concatenate([h, pairs]) >> np.uint64(64 - bits)).astype(np.int32)


@dataclass
class Model:
    weights: np.ndarray
    bias: float
    bits: int

    def score(self, text: str | None) -> float:
        at = features(text, self.bits)
        z = self.bias + (float(self.weights[at].sum(dtype=np.float64)) / len(at) ** 0.5 if len(at) else 0.0)
        return float(1 / (1 + np.exp(-np.clip(z, -40, 40))))


def ftrl(rows: list[tuple[int, np.ndarray, np.ndarray]], bits: int, *, epochs: int = EPOCHS, alpha: float = 0.3, beta: float = 1.0, l1: float = 0.02, l2: float = 0.1, seed: int = 1) -> Model:
    """Rows: label, buckets, counts. The bias is one more coordinate, without l1."""
    size = 1 << bits
    z, n = np.zeros(size + 1), np.zeros(size + 1)
    order = np.arange(len(rows))
    rng = np.random.default_rng(seed)

    def weights(at):
        held = np.where(at == size, 0.0, l1)
        zs = z[at]
        return np.where(np.abs(zs) <= held, 0.0, -(zs - np.sign(zs) * held) / ((beta + np.sqrt(n[at])) / alpha + l2))

    for _ in range(epochs):
        rng.shuffle(order)
        for k in order:
            label, at, count = rows[k]
            at = np.append(at, size)
            x = np.append(count / max(count.sum(), 1) ** 0.5, 1.0)
            w = weights(at)
            g = (1 / (1 + np.exp(-np.clip(w @ x, -40, 40))) - label) * x
            z[at] += g - (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / alpha * w
            n[at] += g * g
    w = weights(np.arange(size + 1))
    return Model(w[:size].astype(np.float32), float(w[size]), bits)


def train(
    docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality",
    learn: Column | None = None, max_rows: int = MAX_ROWS, bits: int = BITS,
) -> Model:
    """Learns from about max_rows labelled rows (chosen by the hash of their ids) of the documents that learn allows.

    learn is a condition on the labels' id column. The sample's ids and labels are about max_rows rows, so they are
    broadcast; its features are made on the executors.
    """
    some = labels.where(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull())
    some = some.where(learn) if learn is not None else some
    some = hash_sample(some.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("label")), "id", max_rows)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(some), "id")

    def count(columns: list) -> Iterator[tuple]:
        for i, label, text in zip(*columns, strict=True):
            at, n = np.unique(features(text, bits), return_counts=True)
            yield str(i), label, at.astype("<i4").tobytes(), n.astype("<i4").tobytes()

    found = map_batches(rows.select("id", "label", "text"), count, "id string, label int, at binary, n binary").collect()
    found.sort(key=lambda r: (zlib.crc32(r.id.encode()), r.id, bytes(r.at)))
    return ftrl([(r.label, np.frombuffer(r.at, "<i4"), np.frombuffer(r.n, "<i4")) for r in found], bits)


def quality_score(docs: DataFrame, model: Model, text: str | Column) -> Column:
    """A column with the score (0 to 1) of each text; docs gives the session."""
    held = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        m = held.value
        return pd.Series([m.score(t) for t in texts], dtype="float64")

    return score(text)
