"""Language identification: averaged hashed subword embeddings and a linear softmax, trained by stochastic gradient descent.

A text's subwords are, for each run of letters in lower case, its character 2- to 4-grams with word ends and the
word itself, hashed to buckets. The mean of their embeddings goes through a linear softmax. Part of the sample is not trained on:
it sets the temperature that makes probabilities honest and the score under which a document is rejected. Since the mean is linear,
scoring adds up a remembered sum of embeddings a word, over whole texts of any length; every language of the table is learned.

A null text, or one without a letter, is `und` with score 0 and rejected. Ties go to the first language in order. Without any
row to learn from every text is `und`. Rows are judged alone, so repeated rows get equal results. An empty table gives an empty
result; columns other than the text (in training the id and the language, too) are not read, and may have any name.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import map_batches, map_texts, remembered, stored

BUCKETS, DIM, EPOCHS = 1 << 16, 16, 6
#: Learned from: about so many documents a language.
PER_LANGUAGE = 400
REMEMBERED = 300_000
UNKNOWN = "und"
words_of = regex.compile(r"\p{L}{1,64}").findall


def subwords(word: str) -> np.ndarray:
    s = f"<{word}>"
    grams = [s[i : i + n] for n in (2, 3, 4) for i in range(len(s) - n + 1)]
    return np.array([zlib.crc32(g.encode("utf-8", "surrogatepass")) % BUCKETS for g in [*grams, f"={s}"]], np.int32)


@dataclass
class Model:
    languages: list[str]
    #: A row a bucket: its embedding, or with few languages what the softmax makes of it (then there is no head).
    rows: np.ndarray
    head: np.ndarray | None
    bias: np.ndarray
    temperature: float = 1.0
    reject: float = 0.0

    def logits(self, total: np.ndarray) -> np.ndarray:
        mean = total[:-1] / max(total[-1], 1)
        return (mean if self.head is None else mean @ self.head) + self.bias


def nothing() -> Model:
    return Model([], np.zeros((BUCKETS, 0)), None, np.zeros(0))


class Words(dict):
    """Remembers the sum over each word's subwords, and their number."""

    def __init__(self, model: Model):
        super().__init__()
        self.model = model
        self.rows = np.zeros((REMEMBERED, model.rows.shape[1] + 1))

    def __missing__(self, word: str) -> int:
        at = subwords(word)
        k = len(self)
        self.rows[k, :-1], self.rows[k, -1] = self.model.rows[at].sum(0), len(at)
        self[word] = k
        return k

    def total(self, found: list[str]) -> np.ndarray:
        out = np.zeros(self.rows.shape[1])
        for a in range(0, len(found), 20_000):  # so that no text needs more rows than there are
            part = found[a : a + 20_000]
            if len(self) + len(part) > REMEMBERED:
                self.clear()
            out += self.rows[np.fromiter(map(self.__getitem__, part), np.int64, len(part))].sum(0)
        return out


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(-1, keepdims=True))
    return e / e.sum(-1, keepdims=True)


def descend(rows: list[tuple[int, np.ndarray, np.ndarray]], n_classes: int, *, epochs: int = EPOCHS, rate: float = 0.5, seed: int = 1) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows: class, buckets, counts. The rate falls linearly to zero."""
    rng = np.random.default_rng(seed)
    e = rng.uniform(-1 / DIM, 1 / DIM, (BUCKETS, DIM)).astype(np.float32)
    w, b = np.zeros((DIM, n_classes), np.float32), np.zeros(n_classes, np.float32)
    order, step, steps = np.arange(len(rows)), 0, max(1, epochs * len(rows))
    for _ in range(epochs):
        rng.shuffle(order)
        for k in order:
            y, at, count = rows[k]
            share = (count / count.sum()).astype(np.float32)
            mean = share @ e[at]
            d = softmax(mean @ w + b)
            d[y] -= 1
            lr = np.float32(rate * (1 - step / steps))
            back = w @ d
            w -= lr * np.outer(mean, d)
            b -= lr * np.float32(0.1) * d
            e[at] -= lr * len(at) ** 0.5 * share[:, None] * back
            step += 1
    return e, w, b


def train(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", learn: Column | None = None, per_language: int = PER_LANGUAGE) -> Model:
    """Learns from about per_language documents of each language, chosen by the hash of their ids among those that learn
    (a condition on docs) allows. A fifth of them sets the temperature and the rejection."""
    rows = docs.where(F.col(lang_col).isNotNull() & F.col(id_col).isNotNull())
    rows = (rows.where(learn) if learn is not None else rows).select(F.col(id_col).alias("id"), F.col(lang_col).cast("string").alias("lang"), F.col(text_col).alias("text"))
    sizes = stored(rows.groupBy("lang").agg(F.count("*").alias("n")))
    languages = sorted(r.lang for r in sizes.select("lang").collect())
    if not languages:
        return nothing()
    share = sizes.select("lang", F.floor(F.least(F.lit(1.0), F.lit(float(per_language)) / F.col("n")) * (1 << 30)).alias("share"))
    chosen = rows.join(share, "lang").where(F.pmod(F.xxhash64("id"), F.lit(1 << 30)) <= F.col("share")).select("id", "lang", "text")

    def count(columns: list) -> Iterator[tuple]:
        for i, lang, text in zip(*columns, strict=True):
            found = words_of((text or "").lower())
            if found:
                at, n = np.unique(np.concatenate([subwords(w) for w in found]), return_counts=True)
                yield str(i), lang, at.astype("<i4").tobytes(), n.astype("<i4").tobytes()

    got = map_batches(chosen, count, "id string, lang string, at binary, n binary").collect()
    got.sort(key=lambda r: (zlib.crc32(r.id.encode()), r.id, bytes(r.at)))
    of = {k: j for j, k in enumerate(languages)}
    examples = [(of[r.lang], np.frombuffer(r.at, "<i4"), np.frombuffer(r.n, "<i4")) for r in got]
    held, used = examples[::5], [x for k, x in enumerate(examples) if k % 5] or examples
    if not used:
        return nothing()
    e, w, b = descend(used, len(languages))
    model = Model(languages, e @ w, None, b) if len(languages) <= DIM else Model(languages, e, w, b)
    calibrate(model, held)
    return model


def calibrate(model: Model, held: list[tuple[int, np.ndarray, np.ndarray]], lost: float = 0.002) -> None:
    """The temperature of the least log loss; the score that all but a share lost of the held documents reach, a half at most."""
    x = np.array([model.logits(np.append((n[:, None] * model.rows[at]).sum(0), n.sum())) for _, at, n in held])
    y = np.array([k for k, _, _ in held])
    loss = lambda t: -np.log(softmax(x / t)[np.arange(len(y)), y] + 1e-12).mean()
    model.temperature = float(min(np.geomspace(0.05, 5, 60), key=loss))
    best = softmax(x / model.temperature).max(1)
    model.reject = float(min(0.5, np.quantile(best, lost)))


def language(docs: DataFrame, model: Model, text: str | Column) -> Column:
    """A struct column: lang_pred string, score double, rejected boolean."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def of(texts: list) -> Iterator[tuple]:
        m = shared.value
        known = words_for(m)
        for t in texts:
            found = words_of(t.lower()) if t is not None else []
            if not found or not m.languages:
                yield UNKNOWN, 0.0, True
                continue
            p = softmax(m.logits(known.total(found)) / m.temperature)
            k = int(p.argmax())
            yield m.languages[k], float(p[k]), bool(p[k] < m.reject)

    return map_texts(of, "lang_pred string, score double, rejected boolean")(text)


def words_for(model: Model) -> Words:
    """One memory a worker and model."""
    return remembered((Words, id(model)), lambda: Words(model))  # which holds the model, so that no other gets its number
