"""Secret scans: fixed patterns, and a character convolutional network over every other candidate with its context.

Patterns give the base findings of three kinds. A run is 10 or more characters of keys and tokens; its parts inside and outside of
base findings are candidates. The network reads a candidate with the characters around it, a longer one than a window in overlapping
windows of which the greatest score counts: one convolution over characters, the greatest value of each filter, a logistic layer.
It learns from the findings of all documents: a table of labels says which candidates are secrets, where it is
given; of the others, those inside base findings are secrets, and those that look random are left out, since nothing says that
they are clean. Findings are dealt by hash into shares of bounded size; in a round each share goes on from the same network, and the
mean of what they learn is the next round's. A held part of the findings, all of it, sets the scale of the scores and the threshold: the highest that keeps
the wanted recall, in steps of 1 / STEPS of a score before its logistic.
Candidates outside of base findings at the threshold or above are added as kind `model`. The model has the precision and recall
that its threshold had on the held part.

Null and empty texts have no findings. Base findings never depend on the network. Without findings of both labels
nothing is added. Offsets count code points, the end is exclusive. Findings that tie in their start are in the order of KINDS.
Rows are judged alone, so repeated rows stay; very long texts are read whole, in steps that grow with their length. An empty table
gives an empty result; columns other than the text (in training the id, too) are not read, and may have any name.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import forget, freed, map_batches, map_texts, stored

KINDS = ("assign", "access", "hex", "model")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")
RUN = re.compile(r"[A-Za-z0-9+/_=-]{10,}")
DIGIT = re.compile(r"[0-9]")
PART = re.compile(r"[A-Za-z0-9]+")
#: Characters that the network reads: before a window, of it, after it; and from a window's start to the next one's.
BEFORE, WINDOW, AFTER, STEP = 24, 56, 8, 28
#: Windows scored at once, and the network's sizes.
PART_ROWS = 1024
WIDTH, FILTERS, CODES = 5, 24, 258
#: Windows of a share, and the fewest of a label in it (a rarer one's go to several shares); rounds over all shares, after one over the first share that
#: gives them a common start; windows of a batch, and of each kind in it at least; batches that a small share is read again for, and how often at most.
SHARE, RARER, ROUNDS, BATCH, LEAST, BATCHES, PASSES = 60_000, 64, 2, 64, 6, 1_000, 16
#: Steps of a held score, greatest held score, and what sums of weights count in.
STEPS, TOP, FIXED = 1024, 40, 2.0**30


def base(text: str) -> list[tuple[int, int, int]]:
    """Base findings as (start, kind's place in KINDS, end), in order."""
    out = []
    if "=" in text or ":" in text:
        out += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text)]
    out += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(out)


def candidates(text: str, known: list[tuple[int, int, int]]) -> list[tuple[int, int, bool]]:
    """The parts of runs inside and outside of base findings, in order: (start, end, inside)."""
    cover, out = [], []
    for a, _, b in sorted(known):
        if cover and a <= cover[-1][1]:
            cover[-1][1] = max(cover[-1][1], b)
        else:
            cover.append([a, b])
    k = 0
    for m in RUN.finditer(text):
        at, end = m.span()
        while k < len(cover) and cover[k][1] <= at:
            k += 1
        j = k
        while at < end:
            if j == len(cover) or cover[j][0] >= end:
                out.append((at, end, False))
                break
            if cover[j][0] > at:
                out.append((at, cover[j][0], False))
            out.append((max(at, cover[j][0]), min(end, cover[j][1]), True))
            at = min(end, cover[j][1])
            j += 1
    return out


def windows(start: int, end: int) -> list[tuple[int, int]]:
    """A candidate in stretches of at most WINDOW characters, each of which shares half of it at least with the next."""
    if end - start <= WINDOW:
        return [(start, end)]
    return [*[(a, a + WINDOW) for a in range(start, end - WINDOW, STEP)], (end - WINDOW, end)]


def numbers(text: str) -> np.ndarray:
    """A text's characters as numbers, 128 for those beyond ASCII, with room for what is read around a window."""
    x = np.minimum(np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4"), 128).astype(np.int16)
    return np.concatenate([np.zeros(BEFORE, np.int16), x, np.zeros(WINDOW + AFTER, np.int16)])


def coded(x: np.ndarray, found: list[tuple[int, int]]) -> np.ndarray:
    """As codes() of each of many windows of the text of numbers()."""
    a, b = np.array(found).T[:, :, None]
    at = np.arange(BEFORE + WINDOW + AFTER)[None, :]
    out = x[a + at]
    n = b - a
    out += np.where((at >= BEFORE) & (at < BEFORE + n), 129, 0).astype(np.int16)
    out[at >= BEFORE + n + AFTER] = 0
    return out


def looks_random(found: str) -> bool:
    """Whether a part of letters and digits changes its kind of character like a key, or is a long run of letters with few vowels."""
    for part in PART.findall(found):
        kinds = "".join("d" if c.isdigit() else "u" if c.isupper() else "l" for c in part)
        changes = sum(a != b for a, b in zip(kinds, kinds[1:], strict=False)) - kinds.startswith("ul")
        if len(part) >= 8 and changes >= 3 or len(part) >= 16 and changes >= 2:
            return True
        if len(part) >= 12 and "d" not in kinds and sum(c in "aeiouyAEIOUY" for c in part) < 0.15 * len(part):
            return True
    return False


def codes(text: str, start: int, end: int, context: tuple[str, str] | None = None) -> np.ndarray:
    """What the network reads: characters (129 codes) outside the window, and 129 more inside it; 0 pads."""
    left, right = context or (text[max(0, start - BEFORE) : start], text[end : end + AFTER])
    one = lambda s: np.minimum(np.frombuffer(s.encode("utf-32-le", "surrogatepass"), "<u4"), 128).astype(np.int16)
    row = np.zeros(BEFORE + WINDOW + AFTER, np.int16)
    a, b, c = one(left), one(text[start:end]) + 129, one(right)
    row[BEFORE - len(a) : BEFORE] = a
    row[BEFORE : BEFORE + len(b)] = b
    row[BEFORE + len(b) : BEFORE + len(b) + len(c)] = c
    return row


@dataclass
class Model:
    conv: np.ndarray
    shift: np.ndarray
    dense: np.ndarray
    bias: float
    scale: tuple[float, float] = (1.0, 0.0)
    threshold: float = 2.0
    #: On the held part: precision, recall, secrets and others.
    held: tuple[float, float, int, int] | None = None

    def raw(self, x: np.ndarray) -> np.ndarray:
        # by position, so that no array is larger than a row's filters; a row's result doesn't depend on the others
        top = np.zeros((len(x), FILTERS), self.conv.dtype)
        for k in range(x.shape[1] - WIDTH + 1):
            out = self.conv[0][x[:, k]] + self.shift
            for j in range(1, WIDTH):
                out += self.conv[j][x[:, k + j]]
            np.maximum(top, out, out=top)
        return (top * self.dense).sum(1, dtype=np.float64) + self.bias

    def scores(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.raw(x) * self.scale[0] + self.scale[1], -40, 40)))


def begun(seed: int = 1) -> list[np.ndarray]:
    """A network that has learned nothing: conv, shift, dense and bias, and what their steps are divided by."""
    rng = np.random.default_rng(seed)
    net = [rng.normal(0, 0.1, (WIDTH, CODES, FILTERS)), np.zeros(FILTERS), rng.normal(0, 0.3, FILTERS), np.zeros(1)]
    return [p.astype(np.float32) for p in net] + [np.full(p.shape, 1e-3, np.float32) for p in net]


def visits(kind: np.ndarray, rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """How a share is read: windows, whose contexts they get, and a batch's weights, in batches one after another. Each batch has windows of every kind, and each window comes once at
    least, half of the times in the context of another that is no secret: the network has to judge the candidate as well."""
    own = [np.flatnonzero(kind == k) for k in range(4)]
    own = [k for k in own if len(k)]
    part = [LEAST + int((BATCH - 4 * LEAST) * len(k) / len(kind)) for k in own]
    batches = max(-(-len(k) // m) for k, m in zip(own, part, strict=True))
    batches *= min(PASSES, -(-BATCHES // batches))
    order = [np.concatenate([rng.permutation(k) for _ in range(-(-batches * m // len(k)))])[: batches * m].reshape(batches, m) for k, m in zip(own, part, strict=True)]
    i = np.concatenate(order, 1)
    label = kind[i[0]] // 2
    weight = np.where(label == 1, 0.5 / max(int(label.sum()), 1), 0.5 / max(int((1 - label).sum()), 1))
    i = i.ravel()
    others = np.flatnonzero(kind < 2)
    j = np.where(rng.random(len(i)) < 0.5, i, others[rng.integers(len(others), size=len(i))]) if len(others) else i
    return i, j, weight * (2 * label - 1)


def together(x: np.ndarray, n: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """As codes(): the windows i in the contexts of the windows j."""
    at = np.arange(WINDOW)[None, :]
    out = np.zeros((len(i), x.shape[1]), np.int16)
    out[:, :BEFORE] = x[j, :BEFORE]
    out[:, BEFORE : BEFORE + WINDOW] = np.where(at < n[i, None], x[i, BEFORE : BEFORE + WINDOW].astype(np.int16) + 129, 0)
    after = BEFORE + np.arange(AFTER)[None, :]
    out[np.arange(len(i))[:, None], after + n[i, None]] = x[j[:, None], after + n[j, None]]
    return out


def learn(net: list[np.ndarray], x: np.ndarray, n: np.ndarray, i: np.ndarray, j: np.ndarray, weight: np.ndarray, rate: float = 0.02) -> list[np.ndarray]:
    """Goes on from a network over batches as visits() gives them, some of which are coded at once (a secret's weight is positive): stochastic gradient descent with adaptive steps (Adagrad)."""
    conv, shift, dense, bias, *seen = [p.copy() for p in net]
    seen = [p * p for p in seen]
    m, places = len(weight), x.shape[1] - WIDTH + 1
    y, mass = weight > 0, np.abs(weight)
    f, rows = np.arange(FILTERS)[None, :], np.arange(m)[:, None]
    for a in range(0, len(i), m):
        if a % (16 * m) == 0:
            some = together(x, n, i[a : a + 16 * m], j[a : a + 16 * m])
        k = some[a % (16 * m) :][:m]
        out = conv[0][k[:, :places]]
        for w in range(1, WIDTH):
            out += conv[w][k[:, w : w + places]]
        at = out.argmax(1)
        top = np.take_along_axis(out, at[:, None], 1)[:, 0] + shift
        h = np.maximum(top, 0)
        d = (1 / (1 + np.exp(-np.clip((h * dense).sum(1) + bias, -40, 40))) - y) * mass
        back = (d[:, None] * dense * (top > 0)).ravel()
        g = np.empty_like(conv)
        for w in range(WIDTH):
            g[w] = np.bincount((k[rows, at + w] * FILTERS + f).ravel(), back, CODES * FILTERS).reshape(CODES, FILTERS)
        for p, grad, s in ((conv, g, seen[0]), (shift, back.reshape(m, -1).sum(0), seen[1]), (dense, (h * d[:, None]).sum(0), seen[2]), (bias, d.sum(), seen[3])):
            s += grad * grad
            p -= rate * grad / np.sqrt(s)
    return [conv, shift, dense, bias, *[np.sqrt(s) for s in seen]]


def findings(rows: DataFrame) -> DataFrame:
    """rows: id, text and said (labels of stretches, or null). A row a window of a labelled candidate: id, start (of the candidate), at (of the window), kind (twice the
    label, and 1 with a digit), crc (of the candidate's text), n (the window's length), code (what the network reads, a byte a character)."""

    def run(columns: list) -> Iterator[tuple]:
        forget()
        for i, text, said in zip(*columns, strict=True):
            text = text or ""
            places, told = [], []
            for a, b, inside in candidates(text, base(text)):
                own = [x["label"] for x in said or [] if x["start"] < b and a < x["end"] and x["label"] is not None]
                label = max(own) if own else inside
                if not (own or label) and looks_random(text[a:b]):
                    continue
                crc, kind = zlib.crc32(text[a:b].encode("utf-8", "surrogatepass")), 2 * int(label > 0) + (DIGIT.search(text, a, b) is not None)
                for p, q in windows(a, b):
                    places.append((p, q))
                    told.append((a, kind, crc))
            x = numbers(text) if places else None
            for k in range(0, len(places), PART_ROWS):
                part = coded(x, places[k : k + PART_ROWS])
                part -= np.where(part > 128, 129, 0).astype(np.int16)
                flat = part.astype(np.uint8).tobytes()
                w = part.shape[1]
                for r, ((p, q), (a, kind, crc)) in enumerate(zip(places[k : k + PART_ROWS], told[k : k + PART_ROWS], strict=True)):
                    yield str(i), a, p, kind, crc, q - p, flat[r * w : r * w + w]

    return map_batches(rows, run, "id string, start int, at int, kind int, crc bigint, n int, code binary")


def shared(fit: DataFrame, count: dict[int, int]) -> DataFrame:
    """fit: findings() to learn from; count: windows of each label. A row a share, in which windows have an order that doesn't depend on the input's: share and
    rows, kind, n and code of all of its windows one after another. A label that is too rare for all shares goes to several."""
    shares = -(-sum(count.values()) // SHARE)
    times = lambda y: min(shares, -(-shares * RARER // count[y]))
    own = F.transform(F.sequence(F.lit(0), F.when(F.col("kind") >= 2, times(1)).otherwise(times(0)) - 1), lambda k: F.pmod(F.pmod(F.col("hash"), F.lit(shares)) + k, F.lit(shares)).cast("int"))
    rows = fit.select(F.xxhash64("id", "at").alias("hash"), "kind", "n", "code").withColumn("share", F.explode(own))
    if shares > 1:
        rows = rows.repartition(shares, "share")

    def pack(table: pa.Table) -> pa.Table:
        table = table.sort_by([(c, "ascending") for c in ("hash", "kind", "n", "code")])
        whole = [np.asarray(table.column(c).to_numpy(), np.uint8).tobytes() for c in ("kind", "n")] + [b"".join(table.column("code").to_pylist())]
        return pa.table({"share": table.column("share")[:1].combine_chunks(), "kind": pa.array(whole[:1]), "n": pa.array(whole[1:2]), "code": pa.array(whole[2:])})

    return stored(rows.groupBy("share").applyInArrow(pack, "share int, kind binary, n binary, code binary"))


def round_of(shares: DataFrame, net: list[np.ndarray], number: int) -> list[np.ndarray]:
    """The mean of the networks that the shares learn, each going on from net. Sums are whole numbers, so their order changes nothing; they are
    added up in each task, then in groups of tasks, of which there are as many as a group has tasks."""
    held, sizes = shares.sparkSession.sparkContext.broadcast(net), [p.size for p in net]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        total = None
        for batch in batches:
            for r in (batch.slice(k, 1).to_pylist()[0] for k in range(batch.num_rows)):
                kind, n = (np.frombuffer(r[c], np.uint8).astype(int) for c in ("kind", "n"))
                rng = np.random.default_rng([r["share"], number])
                got = learn(held.value, np.frombuffer(r["code"], np.uint8).reshape(len(n), -1), n, *visits(kind, rng))
                own = np.concatenate([[1], *[np.rint(p.ravel() * FIXED) for p in got]]).astype("<i8")
                total = own if total is None else total + own
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["sums"])

    def added(rows: list[bytes]) -> np.ndarray:
        return np.sum([np.frombuffer(x, "<i8") for x in rows], 0)

    def add(table: pa.Table) -> pa.Table:
        return pa.table({"sums": pa.array([added(table.column("sums").to_pylist()).tobytes()], pa.binary())})

    groups = math.ceil(math.sqrt(shares.rdd.getNumPartitions()))
    each = shares.mapInArrow(run, "sums binary").withColumn("part", F.spark_partition_id() % groups)
    sums = added([bytes(r.sums) for r in each.groupBy("part").applyInArrow(add, "sums binary").collect()])
    mean = np.split(sums[1:] / (FIXED * sums[0]), np.cumsum(sizes)[:-1])
    return [m.reshape(p.shape).astype(np.float32) for m, p in zip(mean, net, strict=True)]


def held_scores(held: DataFrame, model: Model) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of the candidates of the held part: raw scores (the greatest of a candidate's windows) in steps, labels, and how many there are of each. At most
    2 * (2 * TOP * STEPS + 1) rows, whatever the input."""
    model = held.sparkSession.sparkContext.broadcast(model)

    def run(columns: list) -> Iterator[tuple]:
        ids, starts, kinds, crcs, sizes, found = columns
        for a in range(0, len(ids), PART_ROWS):
            n = np.array(sizes[a : a + PART_ROWS])
            x = np.frombuffer(b"".join(found[a : a + PART_ROWS]), np.uint8).reshape(len(n), -1)
            every = np.arange(len(n))
            z = np.floor(np.clip(model.value.raw(together(x, n, every, every)), -TOP, TOP) * STEPS).astype(int)
            b = a + PART_ROWS
            yield from zip(ids[a:b], starts[a:b], [k // 2 for k in kinds[a:b]], crcs[a:b], z.tolist(), strict=True)

    each = map_batches(held.select("id", "start", "kind", "crc", "n", "code"), run, "id string, start int, label int, crc bigint, z int")
    got = each.groupBy("id", "start", "crc").agg(F.max("z").alias("z"), F.max("label").alias("label")).groupBy("z", "label").agg(F.count("*").alias("many")).orderBy("z", "label").collect()
    return tuple(np.array([r[c] for r in got]) for c in ("z", "label", "many"))


def train(docs: DataFrame, labels: DataFrame | None = None, *, id_col: str = "doc_id", text_col: str = "text", recall: float = 0.95) -> Model | None:
    """Learns from the findings of all documents; None without both labels.

    labels: id_col, start, end and label (1: a secret, 0: clean) of stretches of texts; a candidate that one touches has its
    label, the greatest of several.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    if labels is not None:
        said = labels.select(F.col(id_col).alias("id"), F.struct(*[F.col(c).cast("int").alias(c) for c in ("start", "end", "label")]).alias("s"))
        rows = rows.join(said.groupBy("id").agg(F.collect_list("s").alias("said")), "id", "left")
    else:
        rows = rows.withColumn("said", F.lit(None).cast("array<struct<start: int, end: int, label: int>>"))
    found = stored(findings(rows))
    is_held = F.col("crc") % 5 == 0  # copies of a finding stay on one side
    count = {(r.held, r.label): r.n for r in found.groupBy(is_held.alias("held"), (F.col("kind") / 2).cast("int").alias("label")).agg(F.count("*").alias("n")).collect()}
    if len(count) < 4:
        freed(found)
        return None
    shares = shared(found.where(~is_held), {y: count[False, y] for y in (0, 1)})
    net = round_of(shares.where("share = 0"), begun(), 0)
    for number in range(1, ROUNDS + 1):
        net = round_of(shares, net, number)
    freed(shares)
    model = Model(net[0], net[1], net[2], float(net[3][0]))
    q, y, many = held_scores(found.where(is_held), model)
    freed(found)
    z, share = (q + 0.5) / STEPS, many / many.sum()
    a, b = 1.0, 0.0
    for _ in range(300):  # Platt's scale, drawn to 1 a little
        d = (1 / (1 + np.exp(-np.clip(a * z + b, -40, 40))) - y) * share
        a, b = a - 0.05 * ((d * z).sum() + 0.01 * (a - 1)), b - 0.05 * d.sum()
    model.scale = (max(a, 0.05), b)
    secret = np.where(y == 1, many, 0)
    least = q[np.searchsorted(np.cumsum(secret), int((secret.sum() - 1) * (1 - recall)), side="right")]
    # a little less, so that rounding leaves out no score of this step
    model.threshold = float(1 / (1 + np.exp(-np.clip(least / STEPS * model.scale[0] + model.scale[1], -40, 40)))) * (1 - 1e-9)
    hit = q >= least
    model.held = (float(secret[hit].sum() / many[hit].sum()), float(secret[hit].sum() / secret.sum()), int(secret.sum()), int((many - secret).sum()))
    return model


def spans(text: str | None, model: Model | None) -> list[tuple[str, int, int, float]]:
    """All findings of a text by start, then kind: (kind, start, end, score)."""
    return next(spans_of([text], model))


def spans_of(texts: Iterable[str | None], model: Model | None) -> Iterator[list[tuple[str, int, int, float]]]:
    """spans() of each text; windows of many texts are scored at once."""
    held, parts, size = [], [], 0  # a text's base findings, candidates and windows' places; coded windows

    def done() -> Iterator[list]:
        scores = model.scores(np.concatenate(parts)) if parts else None
        at = 0
        for out, free, place, best in held:
            if place:
                np.maximum.at(best, place, scores[at : at + len(place)])
                at += len(place)
            out += [(a, 3, b, float(x)) for (a, b), x in zip(free, best, strict=True) if x >= model.threshold]
            yield [(KINDS[k], s, e, x) for s, k, e, x in sorted(out)]

    for text in texts:
        text = text or ""
        known = base(text)
        free = [(a, b) for a, b, inside in candidates(text, known) if not inside] if model else []
        best, found = np.zeros(len(free)), [(k, w) for k, c in enumerate(free) for w in windows(*c)]
        x = numbers(text) if free else None
        # of a text with very many windows only the last ones wait for other texts'
        rest = len(found) // PART_ROWS * PART_ROWS
        for at in range(0, rest, PART_ROWS):
            now = found[at : at + PART_ROWS]
            np.maximum.at(best, [k for k, _ in now], model.scores(coded(x, [w for _, w in now])))
        found = found[rest:]
        if found:
            parts.append(coded(x, [w for _, w in found]))
            size += len(found)
        held.append(([(s, k, e, 1.0) for s, k, e in known], free, [k for k, _ in found], best))
        if size >= PART_ROWS:
            yield from done()
            held, parts, size = [], [], 0
    yield from done()


def secret_spans(docs: DataFrame, model: Model | None, text: str | Column) -> Column:
    """A column: an array of structs kind string, start int, end int, score double."""
    held = docs.sparkSession.sparkContext.broadcast(model)

    def of(texts: list) -> Iterator[list]:
        forget()
        return spans_of(texts, held.value)

    return map_texts(of, "array<struct<kind: string, start: int, end: int, score: double>>")(text)


def redacted(docs: DataFrame, model: Model | None, text: str | Column, mark: str = "[SECRET]") -> Column:
    """A column: the text with each stretch of findings replaced by the mark; null stays null."""
    held = docs.sparkSession.sparkContext.broadcast(model)

    def of(texts: list) -> Iterator[str | None]:
        forget()
        for t, found in zip(texts, spans_of(texts, held.value), strict=True):
            yield redact(t, [(s, e) for _, s, e, _ in found], mark)

    return map_texts(of, "string")(text)


def redact(text: str | None, found: list[tuple[int, int]], mark: str) -> str | None:
    if not found:
        return text
    out, at = [], 0
    for s, e in found:
        if s >= at:
            out += [text[at:s], mark]
        at = max(at, e)
    return "".join([*out, text[at:]])
