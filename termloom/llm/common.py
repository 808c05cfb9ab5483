"""What the operators share: the cluster's shared folder, Arrow batches and record splits."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Callable, Hashable, Iterable, Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows and bytes that an operator hands back to Spark at once.
OUT_ROWS, OUT_BYTES = 2048, 8 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Only a session on one machine may leave it unset;
    it gets a folder of its own then."""
    sc = spark.sparkContext
    found = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not found:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = tempfile.mkdtemp(prefix="termloom-")
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(found)
    return found


def stored(df: DataFrame) -> DataFrame:
    """df written as Parquet to the shared folder and read again; the files go with freed(), or when the driver ends."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/stored-{uuid.uuid4().hex}"
    df.write.parquet(path)
    atexit.register(remove, spark, path)
    out = spark.read.parquet(path)
    out.stored_path = path
    return out


def freed(*frames: DataFrame) -> None:
    """Deletes the files of stored frames that nothing will read any more."""
    for df in frames:
        if path := vars(df).pop("stored_path", None):
            remove(df.sparkSession, path)


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a path of any file system that Spark knows; does nothing once the session has ended."""
    try:
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
    except Exception:  # noqa: BLE001 - the JVM may be gone already
        pass


def split_of(id_col: str | Column, n: int) -> Column:
    """crc32 of the id as text modulo n; 0 for a null id."""
    c = F.col(id_col) if isinstance(id_col, str) else id_col
    return F.coalesce(F.crc32(c.cast("string").cast("binary")) % n, F.lit(0))


def hash_sample(df: DataFrame, id_col: str | None, bound: int) -> DataFrame:
    """About bound rows of df, the same ones each time: those whose hash (of the id, or of the whole row) is small enough.
    Rows without an id are left out. All rows, if there are no more than bound."""
    rows = df.where(F.col(id_col).isNotNull()) if id_col else df
    n = rows.count()
    h = F.xxhash64(*([id_col] if id_col else [F.col(f"`{c}`") for c in df.columns]))
    return rows if n <= bound else rows.where(F.pmod(h, F.lit(1 << 30)) < int(bound / n * (1 << 30)))


def map_batches(df: DataFrame, of: Callable[[list], Iterable[tuple]], schema: str) -> DataFrame:
    """Runs of() over slices of the rows (a list of columns as Python lists) inside tasks; it yields output rows.

    Rows leave in small Arrow batches, so that a batch of long texts stays within a task's memory.
    """
    to = [(f.name, f.dataType) for f in df.sparkSession.createDataFrame([], schema).schema.fields]
    from pyspark.sql.pandas.types import to_arrow_type

    arrow = pa.schema([pa.field(n, to_arrow_type(t)) for n, t in to])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                out: list[tuple] = []
                held = 0
                for row in of([c.to_pylist() for c in part.columns]):
                    out.append(row)
                    held += sum(len(v) for v in row if isinstance(v, bytes | str | list))
                    if len(out) >= OUT_ROWS or held >= OUT_BYTES:
                        yield batch_of(out, arrow)
                        out, held = [], 0
                if out:
                    yield batch_of(out, arrow)

    return df.mapInArrow(run, schema)


def map_texts(of: Callable[[list], Iterable], kind: str) -> Callable[[str | Column], Column]:
    """A column function over texts: of() gets slices of them as a Python list and gives a value of the kind for each. Only a slice
    is held as Python objects, and not a whole Arrow batch."""
    from pyspark.sql.pandas.types import to_arrow_type
    from pyspark.sql.types import DataType

    arrow = to_arrow_type(DataType.fromDDL(kind))

    @F.arrow_udf(kind)
    def run(texts: pa.Array) -> pa.Array:
        return mapped(texts, of, arrow)

    return run


def mapped(texts: pa.Array, of: Callable[[list], Iterable], kind: pa.DataType) -> pa.Array:
    """What of() gives for each of the texts, which it gets in slices."""
    parts = slices(pa.RecordBatch.from_arrays([texts], ["text"]))
    return pa.concat_arrays([pa.array([], kind), *[pa.array(list(of(p.column(0).to_pylist())), kind) for p in parts]])


_remembered: dict[Hashable, Any] = {}


def remembered(key: Hashable, make: Callable[[], Any]) -> Any:
    """What a worker keeps from one batch or task to the next: only what was asked for last, since a worker serves
    one stage after another and would end up with what all of them keep."""
    if key not in _remembered:
        forget()
        _remembered[key] = make()
    return _remembered[key]


def forget() -> None:
    """For tasks that keep nothing themselves, and need the room."""
    _remembered.clear()


def batch_of(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


def slices(batch: pa.RecordBatch, most: int = OUT_BYTES) -> Iterator[pa.RecordBatch]:
    """The batch in slices of about most bytes, of one row at least."""
    step = max(1, int(batch.num_rows * most / max(batch.nbytes, 1)))
    for at in range(0, batch.num_rows, step):
        yield batch.slice(at, step)
