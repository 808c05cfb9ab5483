"""Readers and writers of files that Spark's own sources read, with declared schemas."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.gold import split_codes
from ..schemas import assert_columns, blank_to_null


def read_table(spark: SparkSession, path: str | list[str], required: list[str], *, sep: str = ",", multi_line: bool = True, index: str | None = None) -> DataFrame:
    """A CSV or TSV table of texts with a header. Missing columns are an error, more are kept. With index a column of that name comes first: the row's place (see
    numbered()). Without multi_line no cell may hold a line break, and large files are read in splits."""
    rows = assert_columns(spark.read.csv(path, header=True, sep=sep, multiLine=multi_line, escape='"'), required)
    return numbered(rows, index) if index else rows


def numbered(rows: DataFrame, name: str) -> DataFrame:
    """rows, straight from a scan of files, with their places from 0: files in order of their paths, rows in the order of a file, whatever the splits. Rows are
    numbered inside their split; only the splits' counts meet in one task."""
    place = rows.select("*", F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start")).alias("_split"), F.monotonically_increasing_id().alias("_id"))
    # a split is read by one task, in order
    inside = place.withColumn("_nth", F.row_number().over(Window.partitionBy("_split").orderBy("_id")) - 1)
    counts = place.groupBy("_split").agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_split").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = counts.select(F.col("_split").alias("_of"), before.alias("_before"))
    both = inside.join(offsets, F.col("_split") == F.col("_of"))
    return both.select((F.col("_before") + F.col("_nth")).alias(name), *[F.col(f"`{c}`") for c in rows.columns])


def digests(spark: SparkSession, path: str, block: int = 8 << 20) -> DataFrame:
    """path (below the given one), bytes and sha256 of every file at a path, of any size: tasks stream files through pyarrow, which reads file:, hdfs: and s3: URIs."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = where.getFileSystem(spark._jsc.hadoopConfiguration())
    top = fs.makeQualified(where).toString()
    found, files = [], fs.listFiles(where, True)
    while files.hasNext():
        name = files.next().getPath().toString()
        if not name.rpartition("/")[2].startswith((".", "_")):
            found.append((name.removeprefix(top).lstrip("/"), name))

    def run(parts):
        from pyarrow import fs as pafs

        for part in parts:
            sums, sizes = [], []
            for name in part["file"]:
                system, local = pafs.FileSystem.from_uri(name if "://" in name else name.replace(":", "://", 1))
                total, size = hashlib.sha256(), 0
                with system.open_input_stream(local) as stream:
                    while data := stream.read(block):
                        total.update(data)
                        size += len(data)
                sums.append(total.hexdigest())
                sizes.append(size)
            yield part[["path"]].assign(bytes=sizes, sha256=sums)

    listed = spark.createDataFrame(found, "path string, file string").repartition(max(1, len(found)))
    return listed.mapInPandas(run, "path string, bytes bigint, sha256 string")


def fingerprint(spark: SparkSession, path: str) -> str:
    """One digest of the names and contents of all files at a path; that of its content for a single file."""
    rows = sorted((r.path, r.sha256) for r in digests(spark, path).collect())  # a row a file
    if len(rows) == 1 and not rows[0][0]:
        return rows[0][1]
    return hashlib.sha256("".join(f"{d}  {p}\n" for p, d in rows).encode()).hexdigest()


def changed(before: dict, now: dict, fields: list[str]) -> list[str]:
    """The named settings of a run that differ from those it was begun with; it may be resumed if there are none."""
    return [f for f in fields if before.get(f) != now.get(f)]


def read_pairs(spark: SparkSession, path: str) -> DataFrame:
    """Gold pairs: query, gold_codes (an array), label; blanks are null."""
    rows = read_table(spark, path, ["query", "ref_match", "ref_match_id"])
    return rows.select(F.col("query"), split_codes(F.col("ref_match_id")).alias("gold_codes"), blank_to_null(F.col("ref_match")).alias("label"))


def read_predictions(spark: SparkSession, path: str) -> DataFrame:
    """Predictions with ranks as an array of five and gold as an array; a path without files is an empty table."""
    fs = spark._jvm.org.apache.hadoop.fs.Path(path)
    names = ["query_id", "query", "gold_codes", "status", *[f"rank_{k}_code" for k in range(1, 6)]]
    there = fs.getFileSystem(spark._jsc.hadoopConfiguration()).exists(fs)
    rows = read_table(spark, path, names) if there else spark.createDataFrame([], ", ".join(f"{n} string" for n in names))
    return rows.select(F.col("query_id").try_cast("bigint").alias("query_id"), "query", split_codes(F.col("gold_codes"), exact=False).alias("gold"), "status", F.array(*[blank_to_null(F.col(f"rank_{k}_code")) for k in range(1, 6)]).alias("ranks"))


def read_edges(spark: SparkSession, path: str, sha256: str | None = None) -> DataFrame:
    """Hierarchy edges from a TSV; with sha256 the file's content has to have that digest."""
    if sha256 and fingerprint(spark, path) != sha256:
        raise ValueError(f"{path} hasn't the stated digest")
    return read_table(spark, path, ["Subject", "Object"], sep="\t").select(F.col("Subject").alias("subject"), F.col("Object").alias("object"))


def cells(df: DataFrame) -> DataFrame:
    """Arrays as cells joined by ` | ` (nulls as empty places), everything else as text."""
    return df.select(*[F.array_join(F.col(f"`{n}`").cast("array<string>"), " | ", "").alias(n) if t.startswith("array") else F.col(f"`{n}`").cast("string").alias(n) for n, t in df.dtypes])


def write_csv(df: DataFrame, path: str) -> None:
    cells(df).write.mode("overwrite").csv(path, header=True)


def markdown(df: DataFrame, most: int = 1000) -> str:
    """A small table as Markdown, numbers with four digits; one of more rows than most is an error."""
    rows = df.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} rows: write a CSV")
    show = lambda v: "" if v is None else f"{v:.4f}" if isinstance(v, float) else str(v)
    return "\n".join([f"| {' | '.join(df.columns)} |", f"|{'---|' * len(df.columns)}", *[f"| {' | '.join(map(show, r))} |" for r in rows]])
