"""Written intermediates of jobs that read a table several times."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir, which driver and executors share. Only a session on one machine may leave that unset; it gets a
    folder of its own then."""
    sc = spark.sparkContext
    found = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not found:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = tempfile.mkdtemp(prefix="termloom-")
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(found)
    return found


def written(df: DataFrame) -> DataFrame:
    """df as Parquet in the shared folder, read again; the files go with freed(), at the latest when the driver ends."""
    path = f"{shared_dir(df.sparkSession).rstrip('/')}/written-{uuid.uuid4().hex}"
    # columns by place, so that any name will do
    df.toDF(*[f"c{k}" for k in range(len(df.columns))]).write.parquet(path)
    atexit.register(removed, df.sparkSession, path)
    out = df.sparkSession.read.parquet(path).toDF(*df.columns)
    out.written_path = path
    return out


def spread(df: DataFrame) -> DataFrame:
    """df dealt evenly over as many tasks as shuffles have: for work that is heavy a row, since a small file of many rows is read by one task."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def freed(*frames: DataFrame) -> None:
    """Deletes the files of written frames that nothing will read any more."""
    for df in frames:
        if path := vars(df).pop("written_path", None):
            removed(df.sparkSession, path)


def removed(spark: SparkSession, path: str) -> None:
    """Deletes a path of any file system that Spark knows; does nothing once the session has ended."""
    try:
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
    except Exception:  # noqa: BLE001 - the JVM may be gone already
        pass
