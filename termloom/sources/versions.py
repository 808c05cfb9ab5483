"""A versioned table of Parquet files: readers see whole versions, writers commit by one rename, and a batch of a stream counts once.

A writer stages its files in a folder of their own and a manifest beside the others, then renames the manifest to the next version's name, which fails if another writer has
been there first. What was staged without a commit is never read. A manifest lists the folders of its version, the schema, and the last batch of each stream that it has.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType


class Conflict(Exception):
    """Another writer has committed first; read again and write anew."""


class VersionedTable:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        jvm = spark._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        where = self._path(self.path)
        self._context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(where.toUri(), spark._jsc.hadoopConfiguration())
        self._fs = where.getFileSystem(spark._jsc.hadoopConfiguration())

    # --- reading ---

    def version(self) -> int:
        """The last committed version; 0 if there is none."""
        folder = self._path(f"{self.path}/_manifests")
        if not self._fs.exists(folder):
            return 0
        names = [f.getPath().getName() for f in self._fs.listStatus(folder)]
        return max((int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit()), default=0)

    def manifest(self, version: int | None = None) -> dict:
        version = self.version() if version is None else version
        if not version:
            return {"version": 0, "folders": [], "schema": None, "batches": {}}
        stream = self._fs.open(self._path(self._name(version)))
        try:
            return json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def read(self, version: int | None = None) -> DataFrame:
        """The rows of a version, by default of the last one."""
        found = self.manifest(version)
        if found["schema"] is None:
            raise FileNotFoundError(f"{self.path} has no version yet")
        schema = StructType.fromJson(found["schema"])
        folders = [f"{self.path}/{f}" for f in found["folders"]]
        return self.spark.read.schema(schema).parquet(*folders) if folders else self.spark.createDataFrame([], schema)

    # --- writing ---

    def overwrite(self, rows: DataFrame, *, since: int | None = None, stream: tuple[str, int] | None = None, check: Callable[[DataFrame], None] | None = None) -> int:
        """rows as the next version. since: the version that the writer has read (by default the last one). check gets the staged rows; if it raises, nothing is committed."""
        base = self.manifest(since)
        folder = self._staged(rows)
        if check:
            try:
                check(self.spark.read.schema(rows.schema).parquet(f"{self.path}/{folder}"))
            except BaseException:
                self._fs.delete(self._path(f"{self.path}/{folder}"), True)
                raise
        return self._commit(base, [folder], rows.schema, stream)

    def append(self, rows: DataFrame, *, since: int | None = None, stream: tuple[str, int] | None = None) -> int:
        """rows after those of the version before."""
        base = self.manifest(since)
        if base["schema"] is not None:
            rows = rows.select(*[f"`{n}`" for n in StructType.fromJson(base["schema"]).fieldNames()])
        return self._commit(base, [*base["folders"], self._staged(rows)], rows.schema, stream)

    def upsert(self, rows: DataFrame, key: str, *, since: int | None = None, stream: tuple[str, int] | None = None) -> int:
        """rows in the place of those with the same key; keys that are new come in addition."""
        base = self.manifest(since)
        if base["schema"] is not None:
            old = self.read(base["version"])
            same = old[key].eqNullSafe(rows[key])
            rows = old.join(rows.select(key), same, "left_anti").unionByName(rows)
        return self._commit(base, [self._staged(rows)], rows.schema, stream)

    def each_batch(self, stream: str, write: Callable[[VersionedTable, DataFrame, dict], None]) -> Callable[[DataFrame, int], None]:
        """A function for foreachBatch. write(table, rows, options) gets the options (since, stream) to pass to overwrite, append or upsert; a batch that a version has is left out."""

        def one(rows: DataFrame, batch: int) -> None:
            base = self.manifest()
            if batch > base["batches"].get(stream, -1):
                write(self, rows, {"since": base["version"], "stream": (stream, batch)})

        return one

    def _name(self, version: int) -> str:
        return f"{self.path}/_manifests/{version:012d}.json"

    def _staged(self, rows: DataFrame) -> str:
        folder = f"data-{uuid.uuid4().hex}"
        rows.write.parquet(f"{self.path}/{folder}")
        return folder

    def _commit(self, base: dict, folders: list[str], schema: StructType, stream: tuple[str, int] | None) -> int:
        version = base["version"] + 1
        batches = base["batches"] | ({stream[0]: stream[1]} if stream else {})
        text = json.dumps({"version": version, "folders": folders, "schema": json.loads(schema.json()), "batches": batches})
        staged = self._path(f"{self.path}/_manifests/{uuid.uuid4().hex}.staged")
        out = self._fs.create(staged, False)
        out.write(bytearray(text.encode()))
        out.close()
        options = self.spark.sparkContext._gateway.new_array(getattr(self.spark._jvm.org.apache.hadoop.fs, "Options$Rename"), 1)
        options[0] = getattr(self.spark._jvm.org.apache.hadoop.fs, "Options$Rename").NONE
        try:
            self._context.rename(staged, self._path(self._name(version)), options)
        except Exception as e:
            self._fs.delete(staged, False)
            if "FileAlreadyExists" in str(e):
                raise Conflict(f"{self.path} has a version {version} already") from None
            raise
        return version
