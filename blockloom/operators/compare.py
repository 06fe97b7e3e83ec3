"""Comparison of files and copying of what differs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blocks import split


def _paired(left: DataFrame, right: DataFrame, block_size: int, how: str) -> DataFrame:
    a = split(left, block_size).select("file_id", "block_index", "file_size", F.col("data").alias("a"))
    b = split(right, block_size).select("file_id", "block_index", F.col("file_size").alias("other_size"), F.col("data").alias("b"))
    return a.join(b, ["file_id", "block_index"], how)


def first_difference(a, b):
    """The position of the first byte that differs within the shorter of two values, or null."""
    n = F.least(F.octet_length(a), F.octet_length(b))
    at = F.filter(F.sequence(F.lit(1), n), lambda i: F.substring(a, i, 1) != F.substring(b, i, 1))
    return F.when(n > 0, F.try_element_at(at, F.lit(1)) - 1)


def diff(left: DataFrame, right: DataFrame, block_size: int) -> DataFrame:
    """``file_id, sizes_equal, first_mismatch``: the smallest offset, up to the shorter length, at which the files differ.

    Whole contents are compared first; only files that differ are looked into,
    and of those only by slices inside the row, so no block is shuffled.
    """
    a = left.select("file_id", F.col("content").alias("a"))
    b = right.select("file_id", F.col("content").alias("b"))
    rows = a.join(b, "file_id")
    n = F.least(F.octet_length("a"), F.octet_length("b"))
    last = F.floor((n - 1) / block_size).cast("int")
    differs = lambda i: F.substring(F.col("a"), i * block_size + 1, F.least(F.lit(block_size), n - i * block_size)) != F.substring(F.col("b"), i * block_size + 1, F.least(F.lit(block_size), n - i * block_size))
    block = F.when((n > 0) & (F.col("a") != F.col("b")), F.try_element_at(F.filter(F.sequence(F.lit(0), last), differs), F.lit(1)))
    rows = rows.select("file_id", (F.octet_length("a") == F.octet_length("b")).alias("sizes_equal"), block.alias("block"), F.substring("a", block * block_size + 1, F.lit(block_size)).alias("x"), F.substring("b", block * block_size + 1, F.lit(block_size)).alias("y"))
    within = first_difference(F.col("x"), F.col("y"))
    return rows.select("file_id", "sizes_equal", (F.col("block").cast("bigint") * block_size + within).alias("first_mismatch"))


def changed_blocks(left: DataFrame, right: DataFrame, block_size: int) -> DataFrame:
    """``file_id, block_index`` of the blocks that both files have and that differ."""
    return _paired(left, right, block_size, "inner").where("a <> b").select("file_id", "block_index")


def delta_copy(source: DataFrame, target: DataFrame, block_size: int) -> tuple[DataFrame, DataFrame]:
    """What a copy that keeps equal blocks does: the target's blocks after it, and counts.

    The first result is ``file_id, block_index, data, action`` (``keep``,
    ``replace`` or ``append``), the second one row per source: ``file_id,
    bytes_copied`` (the source's size), ``kept, replaced, appended,
    bytes_written``. Blocks of the target behind the source's end are cut off.
    """
    paired = _paired(source, target, block_size, "left")
    action = F.when(F.col("b").isNull(), "append").when(F.col("a") == F.col("b"), "keep").otherwise("replace")
    blocks = paired.select("file_id", "block_index", F.when(action == "keep", F.col("b")).otherwise(F.col("a")).alias("data"), action.alias("action"))
    n = F.octet_length("data").cast("bigint")
    counts = blocks.groupBy("file_id").agg(
        *[F.count_if(F.col("action") == v).alias(k) for k, v in (("kept", "keep"), ("replaced", "replace"), ("appended", "append"))], F.sum(F.when(F.col("action") != "keep", n).otherwise(0)).alias("bytes_written")
    )
    sizes = source.select("file_id", F.octet_length("content").cast("bigint").alias("bytes_copied"))
    stats = sizes.join(counts, "file_id", "left").select("file_id", "bytes_copied", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("kept", "replaced", "appended", "bytes_written")])
    return blocks, stats
