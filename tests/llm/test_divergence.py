"""Source divergence beside plain dictionaries; the trie beside sorting."""

import os
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from termloom.llm import divergence

SCHEMA = "doc_id int, text string, lang string, source string, value int, rank int, `a.b` int"


def table(n=400):
    r = random.Random(4)
    words = ["Ab", "abc", "abd", "a", "über", "ÜBER", "ß", "x1y", "\U0001f600", "naïve", "n", "zz-top"] + [f"w{chr(97 + k)}" for k in range(9)]
    rows = [(i, " ".join(r.choices(words, k=r.randint(0, 12))) + r.choice(["", "\n", "\0", "@[`{"]), r.choice(["en", "de", None, "", "xx"]), r.choice(["s1", "s2", "s3", None, "", "ä"])) for i in range(n)]
    rows += [rows[1], rows[1], (None, None, "en", "alone"), (None, "rare words only", "fr", "s1"), (None, "rare words only", "fr", "s2"), (0, "ab " * 20_000, "en", "s1")]
    return rows


def brute(rows, at_least, top):
    lower = lambda t: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t)
    counts, docs = defaultdict(Counter), defaultdict(Counter)
    for _, t, lang, source in rows:
        found = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", lower(t or ""))
        counts[lang or "", source or ""].update(found)
        docs[lang or ""].update(set(found))
    out = []
    for lang, seen in docs.items():
        kept = [t for t, n in seen.items() if n >= at_least]
        own = {s: {t: c[t] for t in kept} for (g, s), c in counts.items() if g == lang}
        share = lambda c: {t: 1 + 10**9 * (c[t] + 5) // (sum(c.values()) + 5 * len(kept)) for t in kept}
        p, q = {s: share(c) for s, c in own.items()}, share({t: sum(c[t] for c in own.values()) for t in kept})
        for s in own:
            pairs = sorted((-sum(abs(p[s][t] - p[o][t]) for t in kept), o.encode(), o) for o in own if o != s)
            terms = sorted((q[t] - p[s][t], t.encode(), t) for t in kept if own[s][t] > 0 and p[s][t] > q[t])[:top]
            out += [(lang, s, part, x[2], -x[0], k + 1) for part, found in (("pair", pairs), ("term", terms)) for k, x in enumerate(found)]
    return sorted(out)


@pytest.mark.parametrize(("at_least", "top", "more"), [(30, 50, {}), (2, 3, {"range_bytes": 2000, "sample": 50}), (10_000, 5, {})])
def test_against_dictionaries(spark, monkeypatch, at_least, top, more):
    monkeypatch.setattr(divergence, "PART", 7)
    rows = table()
    df = spark.createDataFrame([(*r, 1, 2, 3) for r in rows], SCHEMA).repartition(3)
    got = sorted(tuple(r) for r in divergence.audited(df, at_least=at_least, top=top, **more).select("lang", "source", "part", "item", "value", "rank").collect())
    assert got == brute(rows, at_least, top)
    assert divergence.audited(df.limit(0)).count() == 0


def test_trie_walks_in_order_and_merges():
    r = random.Random(9)
    terms = [bytes(r.choices(b"ab\xc3\xa9", k=r.randint(1, 6))) for _ in range(500)]
    one, two, both = divergence.Trie(), divergence.Trie(), divergence.Trie()
    for k, t in enumerate(terms):
        (one if k % 2 else two).add(t, 1, {f"s{k % 3}": 1})
        both.add(t, 1, {f"s{k % 3}": 1})
    names = [n for n, _ in divergence.PACKED]
    row = dict(zip(names, divergence.packed(list(one.walk())), strict=True))
    for leaf in divergence.terms_of(row):
        two.add(*leaf)
    assert list(two.walk()) == list(both.walk())
    leaves = list(both.walk())
    assert [t for _, t, _, _ in leaves] == sorted(set(terms))
    assert [k for k, _, _, _ in leaves[1:]] == [len(os.path.commonprefix([a[1], b[1]])) for a, b in zip(leaves, leaves[1:], strict=False)]
    assert {t: sum(own.values()) for _, t, _, own in leaves} == Counter(terms)


def test_shares_beyond_whole_numbers_of_64_bits():
    c = np.array([[10**13, 3], [9_300_000_000, 0]], np.int64)
    t = np.array([3 * 10**13, 7], np.int64)
    assert divergence.shares(c, t).tolist() == [[1 + 10**9 * (int(x) + 5) // int(y) for x, y in zip(row, t, strict=True)] for row in c]
