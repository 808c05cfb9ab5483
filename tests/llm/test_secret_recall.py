"""The recall that the secret scan asks for, and labels as input."""

import base64
import random

from termloom.llm import secrets

RNG = random.Random(11)


def key(n):
    return base64.b64encode(RNG.randbytes(n)).decode().rstrip("=")


def words(n):
    return " ".join(RNG.choice(["order", "invoice", "page", "2024", "chapter", "is", "the", "of"]) for _ in range(n))


def texts(n):
    """Hex keys with and without a base pattern's shape, and clean numbers: the classes are hard to tell apart."""
    rows = []
    for i in range(n):
        hard = "".join(RNG.choice("0123456789abcdef") for _ in range(RNG.choice([20, 30])))
        rows.append((i, f"{words(6)} {hard} {words(4)} token={key(9)}1 {words(3)} {RNG.randrange(10**15, 10**16)} {words(2)}"))
    return rows


def test_wanted_recall_is_kept_on_the_held_part(spark):
    docs = spark.createDataFrame(texts(400), "doc_id bigint, text string")
    for recall in (0.95, 1.0):
        model = secrets.train(docs, recall=recall)
        precision, kept, n_secrets, n_others = model.held
        assert kept >= recall and 0 <= precision <= 1 and n_secrets > 50 and n_others > 50


def test_threshold_is_the_quantile(spark):
    rows = [(i, f"a {''.join(RNG.choice('0123456789abcdef') for _ in range(20 + 10 * (i % 2)))} b") for i in range(600)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    said = spark.createDataFrame([(i, 2, 12, int(RNG.random() < 0.5)) for i in range(600)], "doc_id bigint, start int, end int, label int")
    model = secrets.train(docs, said)  # labels at random: no score is near 1
    assert model.threshold < 0.9 and model.held[1] >= 0.95


def test_labels_teach_shapes_that_patterns_lack(spark):
    rows = [(i, f"see {key(15)}7 and {RNG.randrange(10**15, 10**16)} here") for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert secrets.train(docs) is None  # no base finding; nothing else says which ones are secrets
    said = spark.createDataFrame([(i, 4, 25, 1) for i in range(300)], "doc_id bigint, start int, end int, label int")
    model = secrets.train(docs, said)
    assert model.held[0] > 0.9 and any(k == "model" and t[a:b].startswith("Zx9Qk") for t in ["see Zx9QkLm3vB7tYw2PsD4f7 and more"] for k, a, b, _ in secrets.spans(t, model))


def test_random_looking_candidates_are_no_negatives():
    assert all(map(secrets.looks_random, ["Zx9QkLm3vB7tYw2P", "9f8a7b6c5d4e3f2a", "/x/aB3dE5fG7hJ9", "XKRTPWQZMNBVCD"]))
    assert not any(map(secrets.looks_random, ["4111111111111111", "disgusting", "Zuschkeitzuen", "2024-01-02", "path/to/chapter12"]))


class Marks(secrets.Model):
    """Scores a window by the code of Q inside it."""

    def __init__(self):
        self.threshold = 0.9

    def scores(self, x):
        return (x == 129 + ord("Q")).any(1).astype(float)


def test_every_part_of_a_run_is_judged():
    model = Marks()
    runs = ["z1" * 40 + "Q" + "y2" * 40, "Q" * 12, "k" * 9 + "Q", "/usr/share/" * 30 + "Q" + "/x" * 500]
    for run in runs:  # in the middle of a long one, without a digit
        assert secrets.spans(f"see {run} here", model) == [("model", 4, 4 + len(run), 1.0)]
    left = "abcdef0123456789" * 2
    text = f"x QQ{left}ZQ1 y"  # what a hex finding leaves on its two sides
    assert [s[:3] for s in secrets.spans(text, model)] == [("model", 2, 4), ("hex", 4, 36), ("model", 36, 39)]
    assert secrets.redact(text, [(s, e) for _, s, e, _ in secrets.spans(text, model)], "") == "x  y"
    many = [None, "", *[f"see {r} here" for r in runs], "Q" * 300_000 + " é " + runs[0]] * 3
    assert list(secrets.spans_of(many, model)) == [secrets.spans(t, model) for t in many]


def test_windows_cover_a_candidate_and_overlap():
    for n in (1, 56, 57, 84, 85, 500, 1001):
        w = secrets.windows(7, 7 + n)
        assert w[0][0] == 7 and w[-1][1] == 7 + n and all(b - a <= secrets.WINDOW for a, b in w)
        assert all(q - p >= secrets.WINDOW // 2 for (_, q), (p, _) in zip(w, w[1:], strict=False))


def test_many_windows_are_coded_like_one():
    import numpy as np

    text = f"x é token=abc/def12345 {'Q' * 130} {'ab' * 4}{'0123456789abcdef' * 2}Zz99 end 😀abcdefghijk"
    found = [w for a, b, _ in secrets.candidates(text, secrets.base(text)) for w in secrets.windows(a, b)]
    assert (secrets.coded(secrets.numbers(text), found) == np.stack([secrets.codes(text, a, b) for a, b in found])).all()


def test_every_finding_is_learned_from_in_any_order(spark, monkeypatch):
    import zlib

    dice = random.Random(4)
    plain = lambda: "".join(dice.choice("abdeilnorstu") for _ in range(dice.randint(10, 14)))
    rows = [(i, " ".join(plain() for _ in range(150)) + f" token={key(9)}1") for i in range(200)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    every = [(t[a:b], inside) for _, t in rows for a, b, inside in secrets.candidates(t, secrets.base(t)) if inside or not secrets.looks_random(t[a:b])]
    held = [inside for word, inside in every if zlib.crc32(word.encode()) % 5 == 0]
    monkeypatch.setattr(secrets, "SHARE", 8_000, raising=False)  # four shares
    model = secrets.train(docs)
    assert model.held[2:] == (sum(held), len(held) - sum(held)) and model.held[3] > 5_000
    assert model.held[0] > 0.9
    again = secrets.train(docs.repartition(5))
    assert again.threshold == model.threshold and (again.conv == model.conv).all()


def test_rare_label_is_in_every_share(spark):
    import numpy as np

    rows = [(str(i), 0, 0, 3 if i < 3 else 0, i, 1, bytes(secrets.BEFORE + secrets.WINDOW + secrets.AFTER)) for i in range(150_000)]
    fit = spark.createDataFrame(rows, "id string, start int, at int, kind int, crc bigint, n int, code binary")
    got = [np.frombuffer(r.kind, np.uint8) for r in secrets.shared(fit, {0: 149_997, 1: 3}).select("kind").collect()]
    assert len(got) == 3 and sum((k == 0).sum() for k in got) == 149_997 and all((k == 3).sum() == 3 for k in got)
