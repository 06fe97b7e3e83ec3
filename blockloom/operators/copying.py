"""Copies of ranges and whole files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.binary import record_counts
from .manifests import UNIT, build


def zeros(n: Column) -> Column:
    return F.unhex(F.repeat(F.lit("00"), F.greatest(n, F.lit(0)).cast("int")))


def place(source: Column, source_offset: Column, length: Column, target: Column, target_offset: Column, truncate: bool) -> Column:
    """A target after a range of the source is written into it.

    The length is cut to what the source has. With truncation the result ends
    behind the range, and what lies before it is zero; without, the target's
    other bytes stay. A null target is an empty one.
    """
    have = F.octet_length(source)
    n = F.greatest(F.least(length, have - source_offset), F.lit(0)).cast("int")
    data = F.substring(source, (source_offset + 1).cast("int"), n)
    base = F.lit(b"") if truncate else F.coalesce(target, F.lit(b""))
    size = F.octet_length(base)
    before = F.concat(F.substring(base, F.lit(1), F.least(target_offset, size).cast("int")), zeros(target_offset - size))
    after = F.substring(base, (target_offset + n + 1).cast("int"), F.greatest(size - target_offset - n, F.lit(0)).cast("int"))
    return F.concat(before, data, after)


def range_copy(files: DataFrame, source_offset: int, target_offset: int, length: int, truncate: bool = True, target: str | None = None) -> DataFrame:
    """``file_id, bytes_copied, content``."""
    lit = lambda v: F.lit(v).cast("bigint")
    n = F.greatest(F.least(lit(length), F.octet_length("content") - source_offset), lit(0))
    old = F.col(target) if target else F.lit(None).cast("binary")
    return files.select("file_id", n.cast("bigint").alias("bytes_copied"), place(F.col("content"), lit(source_offset), lit(length), old, lit(target_offset), truncate).alias("content"))


def keep_target_size(source: Column, target: Column) -> Column:
    """The source over the target, whose longer tail stays."""
    zero = F.lit(0).cast("bigint")
    return place(source, zero, F.octet_length(source).cast("bigint"), target, zero, False)


def dd(files: DataFrame, block_size: int = 512, count: int | None = None, skip: int = 0, seek: int = 0, notrunc: bool = False, target: str | None = None) -> DataFrame:
    """``file_id, bytes_copied, full_records, partial_records, content``: block-addressed copying."""
    size = F.octet_length("content").cast("bigint")
    available = F.greatest(size - skip * block_size, F.lit(0).cast("bigint"))
    n = available if count is None else F.least(available, F.lit(count * block_size).cast("bigint"))
    lit = lambda v: F.lit(v).cast("bigint")
    old = F.col(target) if target else F.lit(None).cast("binary")
    records = record_counts(F.col("bytes_copied"), block_size)
    rows = files.select("file_id", n.alias("bytes_copied"), place(F.col("content"), lit(skip * block_size), n, old, lit(seek * block_size), not notrunc).alias("content"))
    return rows.select("file_id", "bytes_copied", records["full"].alias("full_records"), records["partial"].alias("partial_records"), "content")


def copy_verified(source: DataFrame, written: DataFrame, block_size: int, hash_type: str = "sha256", unit: int = UNIT) -> DataFrame:
    """The report of a verified copy, from the source and what was first written.

    ``file_id, bytes_copied, source_bytes_hashed, verified_blocks,
    repaired_blocks, used_recovery``: blocks whose hash is not the source's are
    written again from the source. A written file of another size is an error.
    """
    a = build(source, block_size, hash_type, unit).select("file_id", F.col("manifest").alias("a"))
    b = build(written, block_size, hash_type, unit).select("file_id", F.col("manifest").alias("b"))
    rows = a.join(b, "file_id")
    same = F.col("a.file_size") == F.col("b.file_size")
    bad = F.size(F.filter(F.arrays_zip(F.col("a.block_hashes").alias("x"), F.col("b.block_hashes").alias("y")), lambda p: p["x"] != p["y"])).cast("bigint")
    bad = F.when(same, bad).otherwise(F.raise_error(F.lit("short copy")).cast("bigint"))
    return rows.select(
        "file_id", F.col("a.file_size").alias("bytes_copied"), F.col("a.bytes_hashed").alias("source_bytes_hashed"), F.size("a.block_hashes").cast("bigint").alias("verified_blocks"),
        bad.alias("repaired_blocks"), (bad > 0).alias("used_recovery"),
    )
