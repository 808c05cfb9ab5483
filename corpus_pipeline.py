"""The corpus pipeline: language identification, near-dedup, secret redaction, mixing, encoding.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which run() writes as Parquet and reads again as the next
stage's docs. All but the last return the columns of documents. A stage's decisions take effect on its rows: rejected documents go,
one document of each near-duplicate group stays, findings are replaced in the text, the mix repeats or leaves out documents.
Null texts, and texts without a letter, are rejected by the first stage. Empty tables pass through. Columns beyond those of documents stay as
they are, whatever their names, up to the last stage. Very long texts are read whole. Rows that repeat an id and a text are one after the second
stage; an id with two texts is one document, of which the text of the smaller set number stays. Ties (of sources, of
equal rows in the mix) are settled as the operators' docstrings say.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from termloom.llm import bpe, langid, mixing, neardup, secrets
from termloom.llm.common import freed, split_of, stored


def wrapped(docs: DataFrame) -> DataFrame:
    """row (a struct of all columns, so that no name clashes), id and digest."""
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col("doc_id").alias("id"), F.xxhash64("text").alias("digest"))


def identify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the model rejects (no letters, or a calibrated score below its limit) go."""
    model = langid.train(docs, learn=split_of("doc_id", 3) != 1)
    found = langid.language(docs, model, "text")
    return docs.where(~found["rejected"])


def deduplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near-duplicates stays: of its smallest id. Rows without an id or without words all stay, but
    equal rows of one id are one."""
    found = neardup.grouped(docs, width=5, percent=80)
    # texts with equal sets (in upper and lower case, say) may share an id
    kept = found.where("one AND id IS NOT NULL").groupBy("id", F.when(F.col("n") == 0, F.col("digest")).alias("empty")).agg(F.min("digest").alias("digest"))
    kept = stored(kept.drop("empty"))
    freed(found)
    rows = wrapped(docs)
    # partitioned alike for the join and for what repeats, so that texts are sent once
    once = Window.partitionBy("id", "digest").orderBy(F.xxhash64("row"))
    one = rows.join(kept, ["id", "digest"], "left_semi").withColumn("nth", F.row_number().over(once)).where("nth = 1").select("row")
    return one.unionByName(rows.where("id IS NULL").select("row")).select("row.*")


def redact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents stay; what the scan finds is replaced, and n_chars follows the text."""
    model = secrets.train(docs)
    out = docs.withColumn("text", secrets.redacted(docs, model, "text"))
    return out.withColumn("n_chars", F.length("text").cast("bigint")).select(*[F.col(f"`{c}`") for c in docs.columns])


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources at their target weights: a document comes as often as its source's budget takes it, at most twice on the whole."""
    return mixing.repeated(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, the packed ids, their digest and that of the bytes that they decode to; a row a row of docs."""
    out = bpe.encode(docs, decoded=True)
    return out.select("doc_id", "n_tokens", "ids", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [
    ("language ID", identify),
    ("MinHash near-dedup", deduplicate),
    ("secret scans", redact),
    ("mixing sources to target weights", mix),
    ("byte-level BPE encoding and decoding", encode),
]

#: The language model, the secret scan and the encoding are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        done = stage(spark, docs, sf_dir)
        if k == len(STAGES) - 1:
            return done
        last, docs = docs, stored(done)
        freed(last)
    return docs
