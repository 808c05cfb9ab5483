import random

import pytest

from termloom.llm import neardup


def truth(rows, width, percent):
    """Brute force: components by all pairs of sets of shingles."""
    sets = {}
    for i, text in rows:
        w = (text or "").encode().lower().split()
        n = min(width, len(w))
        sets[i] = {tuple(w[k : k + n]) for k in range(len(w) - n + 1)} if w else set()
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {i: (len(sets[i]), find(i)) for i in ids}


def corpus(seed=3):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choices("abcdefghij", k=rng.randint(2, 6)))
    passage = [word() for _ in range(60)]
    base = [word() for _ in range(120)]
    rows = [(i, " ".join(word() for _ in range(rng.randint(1, 80)))) for i in range(40)]
    rows += [(100 + i, " ".join(passage + [word() for _ in range(rng.randint(5, 40))])) for i in range(60)]
    for i in range(60):  # near copies of a text, and of those again: chains beyond direct links
        copy = list(base)
        for _ in range(rng.randint(0, 4)):
            copy[rng.randrange(len(copy))] = word()
        base = copy if i % 6 == 5 else base
        rows.append((200 + i, " ".join(copy)))
    rows += [(300, rows[5][1].upper()), (301, rows[5][1].replace(" ", "\t\n ")), (302, ""), (303, None), (304, "one"), (305, "ONE"), (306, "\x1cone"), (307, " \n "), (308, "é É"), (309, "é é")]
    return rows


@pytest.mark.parametrize(("width", "small"), [(4, 0), (4, 3), (5, 32)])
def test_against_all_pairs(spark, width, small):
    rows = corpus()
    df = spark.createDataFrame([(i, t, 1, 2) for i, t in rows], "doc_id bigint, text string, n int, component_id int").repartition(4)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in neardup.near_duplicates(df, width=width, percent=80, small=small).collect()}
    assert got == truth(rows, width, 80)


def test_repeated_rows_nulls_and_empty_tables(spark):
    df = spark.createDataFrame([(1, "a b c d e f"), (1, "a b c d e f"), (2, "a b c d e f"), (None, "a b c d e f"), (None, None)], "doc_id bigint, text string")
    got = sorted(neardup.near_duplicates(df).select("doc_id", "component_id", "kept").collect(), key=str)
    assert [tuple(r) for r in got] == [(1, 1, True), (1, 1, True), (2, 1, False), (None, None, True), (None, None, True)]
    assert neardup.near_duplicates(df.limit(0)).count() == 0
