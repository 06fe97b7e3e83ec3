"""Manifests of files as they arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.digests import block_hashes, root_digest

SCHEMA = "path string, modificationTime timestamp, length bigint, content binary"


def arriving(spark: SparkSession, path: str, files_per_batch: int = 1000) -> DataFrame:
    """A stream of the files that appear under a path."""
    return spark.readStream.format("binaryFile").schema(SCHEMA).option("maxFilesPerTrigger", files_per_batch).load(path)


def digested(stream: DataFrame, block_size: int) -> DataFrame:
    """``path, length, blocks, hash_of_hashes`` of each arriving file; stateless, so nothing is kept between batches."""
    size = F.octet_length("content").cast("bigint")
    rows = stream.select("path", "length", block_hashes(F.col("content"), size, block_size, "sha256").alias("hashes"))
    return rows.select("path", "length", F.size("hashes").cast("bigint").alias("blocks"), root_digest(F.col("hashes"), "sha256").alias("hash_of_hashes"))


def changed_since(stream: DataFrame, known: DataFrame, block_size: int) -> DataFrame:
    """Arriving files against a table of ``path, hash_of_hashes``: ``new``, ``same`` or ``changed``."""
    now = digested(stream, block_size)
    before = known.select("path", F.col("hash_of_hashes").alias("before"))
    state = F.when(F.col("before").isNull(), "new").when(F.col("before") == F.col("hash_of_hashes"), "same").otherwise("changed")
    return now.join(before, "path", "left").withColumn("state", state).drop("before")


def start(digests: DataFrame, target: str, checkpoint: str) -> StreamingQuery:
    """Appends the digests to a Parquet table and stops when nothing more is there."""
    return digests.writeStream.format("parquet").option("checkpointLocation", checkpoint).trigger(availableNow=True).start(target)
