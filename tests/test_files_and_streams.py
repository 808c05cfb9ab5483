import hashlib
import random

import pytest

from termloom.operators import breaker
from termloom.sources import files, versions
from termloom.streaming import runs


def test_pairs_predictions_edges(spark, tmp_path):
    (tmp_path / "pairs.csv").write_text('query,ref_match,ref_match_id,more\n"a, b",x,EFO:1 | EFO:2,1\n,nan,,2\n')
    assert [tuple(r) for r in files.read_pairs(spark, str(tmp_path / "pairs.csv")).collect()] == [("a, b", ["EFO:1", "EFO:2"], "x"), (None, [], None)]
    with pytest.raises(ValueError, match="ref_match_id"):
        files.read_table(spark, str(tmp_path / "pairs.csv"), ["ref_match_id2"])
    assert files.read_predictions(spark, str(tmp_path / "none.csv")).count() == 0
    text = "Subject\tObject\na\tb\n"
    (tmp_path / "edges.tsv").write_text(text)
    assert files.read_edges(spark, str(tmp_path / "edges.tsv"), hashlib.sha256(text.encode()).hexdigest()).count() == 1
    with pytest.raises(ValueError, match="digest"):
        files.read_edges(spark, str(tmp_path / "edges.tsv"), "0")


def test_round_trip(spark, tmp_path):
    df = spark.createDataFrame([(1, "q", ["A", None, "B"], 0.5)], "query_id int, query string, codes array<string>, x double")
    files.write_csv(df, str(tmp_path / "out"))
    assert tuple(spark.read.csv(str(tmp_path / "out"), header=True).first()) == ("1", "q", "A |  | B", "0.5")
    assert files.markdown(df.select("query", "x")).splitlines()[2] == "| q | 0.5000 |"


@pytest.mark.parametrize("size", ["200b", "1m"])
def test_row_numbers_follow_files_whatever_the_splits(spark, tmp_path, size):
    held = spark.conf.get("spark.sql.files.maxPartitionBytes")
    want = []
    for name, n in (("a", 70), ("b", 0), ("c", 45)):
        rows = [f"{name}{k},{'x' * (k % 13)}" for k in range(n)]
        (tmp_path / f"{name}.csv").write_text("id,text\n" + "".join(r + "\n" for r in rows))
        want += [r.split(",")[0] for r in rows]
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        got = files.read_table(spark, str(tmp_path), ["id"], multi_line=False, index="raw_row_index")
        assert got.columns == ["raw_row_index", "id", "text"]
        assert [(r.raw_row_index, r.id) for r in got.orderBy("raw_row_index").collect()] == list(enumerate(want))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", held)


def test_fingerprints_see_every_byte(spark, tmp_path):
    top = tmp_path / "data"
    (top / "more").mkdir(parents=True)
    (top / "a.bin").write_bytes(b"x" * 100_000)
    (top / "more" / "b.bin").write_bytes(b"")
    rows = {r.path: (r.bytes, r.sha256) for r in files.digests(spark, str(top), block=4096).collect()}
    assert rows == {"a.bin": (100_000, hashlib.sha256(b"x" * 100_000).hexdigest()), "more/b.bin": (0, hashlib.sha256(b"").hexdigest())}
    assert files.fingerprint(spark, str(top / "a.bin")) == rows["a.bin"][1]
    first = files.fingerprint(spark, str(top))
    (top / "a.bin").write_bytes(b"x" * 99_999 + b"y")
    second = files.fingerprint(spark, str(top))
    assert first != second
    begun = {"dataset": first, "model": "m", "seed": 42}
    assert files.changed(begun, begun | {"dataset": second, "seed": 43}, ["dataset", "model", "seed"]) == ["dataset", "seed"]


def test_stream_appends_once(spark, tmp_path):
    rows = spark.createDataFrame([(k, "2024-01-01 00:00:00") for k in range(6)], "id int, t string").selectExpr("*", "cast(t as timestamp) as time")
    rows.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    for _ in range(2):  # started again there is nothing new
        runs.append(runs.once(stream, "id", "time"), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 6


def results(n=400, seed=1):
    r = random.Random(seed)
    status = ["mapped", "unmapped", "error", "error", "error", None]
    return [(r.choice(["hot", "hot", "a", "b", None]), k, r.choice(status), r.choice(["local_retrieval", "planner", None])) for k in range(n)]


def loop(rows, local_limit=3, any_limit=5):
    state = {}
    for source, k, status, stage in rows:
        s = state.setdefault(source, dict(local=0, any=0, longest_local=0, longest_any=0, at=None, why=None))
        if status in ("mapped", "unmapped"):
            s["local"] = s["any"] = 0
        elif status == "error":
            s["any"] += 1
            s["local"] += stage == "local_retrieval"
            why = None
            if stage == "local_retrieval":
                why = "consecutive_local_retrieval_errors" if s["local"] >= local_limit else None
            elif s["any"] >= any_limit:
                why = "consecutive_execution_errors"
            if why and s["at"] is None:
                s["at"], s["why"] = k, why
        s["longest_local"], s["longest_any"] = max(s["longest_local"], s["local"]), max(s["longest_any"], s["any"])
    return sorted(((g, s["local"], s["any"], s["longest_local"], s["longest_any"], s["at"], s["why"]) for g, s in state.items()), key=str)


SCHEMA = "source string, ord bigint, status string, error_stage string"


@pytest.mark.parametrize("ranges", [1, 7, 90])
def test_breakers_beside_a_loop(spark, ranges):
    rows = results()
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    got = breaker.breakers(df, group="source", ord_="ord", ranges=ranges).collect()
    assert sorted((tuple(r) for r in got), key=str) == loop(rows)
    assert breaker.breakers(df.limit(0), group="source", ord_="ord").count() == 0


def test_stream_of_breakers_equals_batch(spark, tmp_path):
    rows = results(120, 3)
    for k, (a, b) in enumerate([(0, 1), (1, 40), (40, 43), (43, 120)]):
        spark.createDataFrame(rows[a:b], SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(SCHEMA).parquet(str(tmp_path / "in"))
        table = versions.VersionedTable(spark, str(tmp_path / "state"))
        runs.breaker(stream, table, str(tmp_path / "cp")).awaitTermination()
        assert table.version() == k + 1
        columns = ["source", "local_run", "any_run", "longest_local", "longest_any", "opened_at", "reason"]
        assert sorted((tuple(r) for r in table.read().select(*columns).collect()), key=str) == loop(rows[:b])


def test_versions_are_whole_conflict_and_replay(spark, tmp_path):
    table = versions.VersionedTable(spark, str(tmp_path / "t"))
    rows = lambda *x: spark.createDataFrame([(k, v) for k, v in x], "id int, v string")
    got = lambda version=None: sorted(tuple(r) for r in table.read(version).collect())
    with pytest.raises(FileNotFoundError):
        table.read()
    assert table.overwrite(rows((1, "a"), (2, "b"))) == 1
    assert table.upsert(rows((2, "c"), (3, "d")), "id") == 2  # reads what it replaces
    assert got() == [(1, "a"), (2, "c"), (3, "d")] and got(1) == [(1, "a"), (2, "b")]
    with pytest.raises(versions.Conflict):  # two writers that have read version 1
        table.append(rows((9, "x")), since=1)
    killed = versions.VersionedTable(spark, str(tmp_path / "t"))
    killed._commit = None  # ends between staging and commit
    with pytest.raises(TypeError):
        killed.overwrite(rows((7, "lost")))
    assert table.version() == 2 and got() == [(1, "a"), (2, "c"), (3, "d")]
    one = table.each_batch("s", lambda to, df, options: to.append(df, **options))
    for batch in (0, 1, 1, 0):
        one(rows((10 + batch, "n")), batch)
    assert got() == [(1, "a"), (2, "c"), (3, "d"), (10, "n"), (11, "n")] and table.version() == 4
    assert table.overwrite(rows()) == 5 and got() == []
