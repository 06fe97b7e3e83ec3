"""Writers as relations: appended, indexed and positional writes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Order values of one step of a running sum, whose values one task sorts and buffers, and bytes of a chunk in which overlaps are settled.
SPAN = 1 << 12
CHUNK = 256


def append_ranges(writes: DataFrame, file: str, order: str, data: str = "data", span: int = SPAN) -> DataFrame:
    """Adds ``offset`` and ``len``: where each appended value lies in its file.

    With an integer order the running sum has two levels, within spans of the
    order and over the spans' sums, so a file with any share of the rows is
    summed by many tasks.
    """
    n = F.octet_length(data).cast("bigint")
    rows = writes.withColumn("len", n)
    whole = W.partitionBy(file).orderBy(order).rowsBetween(W.unboundedPreceding, -1)
    if not isinstance(writes.schema[order].dataType, T.IntegralType):
        return rows.withColumn("offset", F.coalesce(F.sum("len").over(whole), F.lit(0)))
    rows = rows.withColumn("_span", F.floor(F.col(order) / span))
    sums = rows.groupBy(file, "_span").agg(F.sum("len").alias("_sum"))
    earlier = F.sum("_sum").over(W.partitionBy(file).orderBy("_span").rowsBetween(W.unboundedPreceding, -1))
    sums = sums.select(file, "_span", F.coalesce(earlier, F.lit(0)).alias("_base"))
    within = F.sum("len").over(W.partitionBy(file, "_span").orderBy(order).rowsBetween(W.unboundedPreceding, -1))
    return rows.join(sums, [file, "_span"]).withColumn("offset", F.col("_base") + F.coalesce(within, F.lit(0))).drop("_span", "_base")


def index_faults(writes: DataFrame, file: str, index: str, expected: DataFrame) -> DataFrame:
    """``file, out_of_range, duplicates, missing`` against ``expected`` (file, block_count)."""
    seen = writes.join(expected, file).groupBy(file, "block_count").agg(
        F.count_if((F.col(index) < 0) | (F.col(index) >= F.col("block_count"))).alias("out_of_range"), (F.count(index) - F.count_distinct(index)).alias("duplicates"),
        F.count_distinct(F.when((F.col(index) >= 0) & (F.col(index) < F.col("block_count")), F.col(index))).alias("valid"),
    )
    rows = expected.join(seen.drop("block_count"), file, "left")
    return rows.select(file, *[F.coalesce(c, F.lit(0)).alias(c) for c in ("out_of_range", "duplicates")], (F.col("block_count") - F.coalesce("valid", F.lit(0))).alias("missing"))


def indexed(writes: DataFrame, file: str, index: str, expected: DataFrame, data: str = "data") -> DataFrame:
    """Blocks that came in any order, with their ranges in index order; faults are errors."""
    bad = index_faults(writes, file, index, expected)
    text = F.concat_ws(" ", F.lit("bad indexed write: out of range"), "out_of_range", F.lit("duplicates"), "duplicates", F.lit("missing"), "missing")
    good = bad.select(file, F.when((F.col("out_of_range") == 0) & (F.col("duplicates") == 0) & (F.col("missing") == 0), F.lit(True)).otherwise(F.raise_error(text).cast("boolean")).alias("good"))
    return append_ranges(writes.join(good, file).where("good").drop("good"), file, index, data)


def last_wins(writes: DataFrame, file: str, seq: str, offset: str, data: str, chunk: int = CHUNK) -> DataFrame:
    """The parts of each write that no later write covers: ``file, offset, data``.

    Writes are cut at chunk edges, and of equal intervals only the last is
    kept, so a chunk has a bounded number of them however often it is written.
    Their boundaries cut a chunk into pieces, each of which its last write keeps.
    """
    w = writes.select(F.col(file).alias("file"), F.col(seq).alias("seq"), F.col(offset).cast("bigint").alias("lo"), (F.col(offset) + F.octet_length(data)).cast("bigint").alias("hi"), F.col(data).alias("data")).where("hi > lo")
    w = w.select("*", F.explode(F.sequence(F.floor(F.col("lo") / chunk), F.floor((F.col("hi") - 1) / chunk))).alias("chunk"))
    low, high = F.greatest("lo", F.col("chunk") * chunk), F.least("hi", (F.col("chunk") + 1) * chunk)
    part = F.substring(F.col("data"), (low - F.col("lo") + 1).cast("int"), (high - low).cast("int"))
    w = w.select("file", "chunk", low.alias("lo"), high.alias("hi"), "seq", part.alias("data")).groupBy("file", "chunk", "lo", "hi").agg(F.max_by("data", "seq").alias("data"), F.max("seq").alias("seq"))
    edges = w.select("file", "chunk", F.explode(F.array("lo", "hi")).alias("at")).distinct()
    cuts = edges.withColumn("to", F.lead("at").over(W.partitionBy("file", "chunk").orderBy("at"))).where("to is not null")
    over = cuts.join(w, ["file", "chunk"]).where("at < hi and to > lo")
    kept = over.groupBy("file", "at", "to").agg(F.max_by(F.struct("lo", "data"), "seq").alias("w"))
    piece = F.substring(F.col("w.data"), (F.col("at") - F.col("w.lo") + 1).cast("int"), (F.col("to") - F.col("at")).cast("int"))
    return kept.select(F.col("file").alias(file), F.col("at").alias("offset"), piece.alias("data"))


def offset_image(writes: DataFrame, file: str, seq: str, sizes: DataFrame, offset: str = "offset", data: str = "data", base: str | None = None) -> DataFrame:
    """``file, content, bytes_written, extent``: a file of fixed size after positional writes.

    ``sizes`` is (file, total_size) and, with ``base``, a column of the content
    before: gaps then keep its bytes, otherwise they are zero. Of overlapping
    writes the one with the greatest ``seq`` wins. Writes past the end are errors.
    """
    checked = writes.join(sizes.select(file, "total_size"), file)
    end = F.col(offset) + F.octet_length(data)
    fine = (F.col(offset) >= 0) & (end <= F.col("total_size"))
    checked = checked.where(F.when(fine, F.lit(True)).otherwise(F.raise_error(F.lit("write past end of file")).cast("boolean")))
    stats = checked.groupBy(file).agg(F.sum(F.octet_length(data)).cast("bigint").alias("bytes_written"), F.max(end).cast("bigint").alias("extent"))
    parts = last_wins(checked, file, seq, offset, data).groupBy(file).agg(F.sort_array(F.collect_list(F.struct("offset", "data"))).alias("parts"))
    rows = sizes.join(stats, file, "left").join(parts, file, "left")
    under = F.coalesce(F.col(base), F.lit(b"")) if base else F.lit(b"")
    full = F.col("total_size")
    padded = F.substring(F.concat(under, F.unhex(F.repeat(F.lit("00"), full.cast("int")))), F.lit(1), full.cast("int"))
    image = F.when(F.col("parts").isNull(), padded).otherwise(overlay(padded, F.col("parts")))
    return rows.select(file, image.alias("content"), F.coalesce("bytes_written", F.lit(0)).cast("bigint").alias("bytes_written"), F.coalesce("extent", F.lit(0)).cast("bigint").alias("extent"))


def overlay(base: Column, parts: Column) -> Column:
    """The base with non-overlapping ``struct<offset, data>`` parts, in order, put over it."""
    start = F.struct(F.lit(0).cast("bigint").alias("at"), F.lit("").alias("hex"))

    def step(acc: Column, p: Column) -> Column:
        offset = p["offset"].cast("bigint")
        gap = F.substring(base, (acc["at"] + 1).cast("int"), (offset - acc["at"]).cast("int"))
        return F.struct((offset + F.octet_length(p["data"])).alias("at"), F.concat(acc["hex"], F.hex(gap), F.hex(p["data"])).alias("hex"))

    done = F.aggregate(parts, start, step)
    return F.unhex(F.concat(done["hex"], F.hex(F.substring(base, (done["at"] + 1).cast("int"), F.octet_length(base)))))


def fill(spark, block_size: int, total: int, seed: int) -> DataFrame:
    """``offset, data``: a file of one seeded random block, repeated and cut at its end."""
    import random

    block = random.Random(seed).randbytes(block_size)
    count = -(-total // block_size)
    n = F.least(F.lit(block_size), F.lit(total) - F.col("id") * block_size).cast("int")
    return spark.range(count).select((F.col("id") * block_size).alias("offset"), F.substring(F.lit(block), F.lit(1), n).alias("data"))
