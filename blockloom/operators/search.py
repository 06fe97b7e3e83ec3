"""Literal search in bytes, with exact offsets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.binary import literal, one_char_per_byte


def starts(data: Column, pattern: bytes) -> Column:
    """Byte positions of the matches in one value, from the left, none overlapping.

    Bytes are read as one character each; the text between matches is split
    off and its lengths are summed.
    """
    parts = F.split(one_char_per_byte(data), literal(pattern), -1)
    gaps = F.transform(F.slice(parts, F.lit(1), F.size(parts) - 1), lambda p: F.char_length(p).cast("bigint"))
    begin = F.struct(F.lit(0).cast("bigint").alias("next"), F.array().cast("array<bigint>").alias("found"))

    def step(acc: Column, gap: Column) -> Column:
        at = acc["next"] + gap
        return F.struct((at + len(pattern)).alias("next"), F.concat(acc["found"], F.array(at)).alias("found"))

    return F.aggregate(gaps, begin, step)["found"]


def grep(files: DataFrame, pattern: bytes) -> DataFrame:
    """``file_id, offset`` of every match in whole files, which need no block to be cut."""
    if not pattern:
        return files.select("file_id", F.lit(0).cast("bigint").alias("offset")).limit(0)
    has = F.contains("content", F.lit(pattern))
    return files.where(has).select("file_id", F.explode_outer(starts(F.col("content"), pattern)).alias("offset"))


def grep_blocks(blocks: DataFrame, pattern: bytes) -> DataFrame:
    """``file_id, offset`` as a block-wise search finds them.

    Matches are taken from the left anew in each block, and between a block's
    end and the next one's beginning, each as long as the pattern less one
    byte. So an overlap with itself may give more matches than a search of the
    whole, and a match over three blocks is missed.
    """
    if not pattern:
        return blocks.select("file_id", "offset").limit(0)
    edge = len(pattern) - 1
    size = F.octet_length("data")
    scanned = blocks.select(
        "file_id", "block_index", "offset", starts(F.col("data"), pattern).alias("found"), size.cast("bigint").alias("n"),
        F.substring("data", 1, edge).alias("head"), F.substring(F.col("data"), F.greatest(size - edge, F.lit(0)) + 1, F.lit(edge)).alias("tail"),
    )
    inside = scanned.select("file_id", "offset", F.explode_outer("found").alias("at")).where("at is not null").select("file_id", (F.col("offset") + F.col("at")).alias("offset"))
    if edge == 0:
        return inside
    # A block's end and the next one's head meet at their seam: one shuffle of a few bytes, whatever the file's size.
    ends = F.array(F.struct(F.col("block_index").alias("at"), F.col("offset"), F.col("n"), F.col("tail"), F.lit(None).cast("binary").alias("next")), F.struct((F.col("block_index") - 1).alias("at"), F.lit(None).cast("bigint").alias("offset"), F.lit(None).cast("bigint").alias("n"), F.lit(None).cast("binary").alias("tail"), F.col("head").alias("next")))
    met = scanned.select("file_id", F.explode(ends).alias("e")).groupBy("file_id", "e.at").agg(*[F.max(f"e.{c}").alias(c) for c in ("offset", "n", "tail", "next")])
    pairs = met.where((F.octet_length("tail") > 0) & (F.octet_length("next") > 0))
    seam = F.octet_length("tail")
    crossing = pairs.select("file_id", (F.col("offset") + F.col("n") - seam).alias("from"), seam.alias("seam"), F.explode_outer(starts(F.concat("tail", "next"), pattern)).alias("at"))
    crossing = crossing.where((F.col("at") < F.col("seam")) & (F.col("at") + len(pattern) > F.col("seam"))).select("file_id", (F.col("from") + F.col("at")).alias("offset"))
    # A match inside a block and one over its seam never begin at one place, so nothing is there twice.
    return inside.unionByName(crossing)
