"""The closure of deep hierarchies, of cycles and of many paths."""

from termloom.operators import hierarchy


def test_deep_paths_and_cycles(spark):
    chain = [(f"a{i}", f"a{i + 1}") for i in range(34)]
    cycle = [("x", "y"), ("y", "z"), ("z", "x")]
    diamonds = [(f"d{i}", f"{m}{i}") for i in range(3) for m in "lr"] + [(f"{m}{i}", f"d{i + 1}") for i in range(3) for m in "lr"]
    edges = spark.createDataFrame([*chain, *cycle, *diamonds, ("a0", "a1"), ("q", None), (None, "q")], "subject string, object string").coalesce(2)
    rows = [tuple(r) for r in hierarchy.closure(edges).collect()]
    got = set(rows)
    assert len(rows) == len(got)
    assert {r for r in got if r[0][0] == "a"} == {(f"a{i}", f"a{j}") for i in range(35) for j in range(i + 1, 35)}
    assert {r for r in got if r[0] in "xyz"} == {(s, o) for s in "xyz" for o in "xyz"}
    assert {o for s, o in got if s == "d0"} == {"l0", "r0", "d1", "l1", "r1", "d2", "l2", "r2", "d3"}
    pairs = spark.createDataFrame([(1, "a0", ["a34"]), (2, "a34", ["a0"])], "id int, predicted string, gold array<string>")
    found = {r.id: r.relationship for r in hierarchy.related(pairs, edges, hierarchy.closure(edges)).collect()}
    assert found == {1: hierarchy.NARROWER, 2: hierarchy.BROADER}


def test_no_edges(spark):
    assert hierarchy.closure(spark.createDataFrame([], "subject string, object string")).count() == 0


def test_rounds_keep_one_row_a_subject(spark, monkeypatch):
    """Layers of which each node has all of the next one as parents: pairs and paths are many, and no round writes more rows than there are subjects."""
    edges = spark.createDataFrame([(f"{k}:{i}", f"{k + 1}:{j}") for k in range(6) for i in range(8) for j in range(8)], "subject string, object string")
    sizes, keep = [], hierarchy.written

    def counted(df):
        out = keep(df)
        sizes.append(out.count())
        return out

    monkeypatch.setattr(hierarchy, "written", counted)
    assert hierarchy.closure(edges).count() == 8 * 8 * sum(range(7))
    assert max(sizes) <= 6 * 8 and len(sizes) <= 5
