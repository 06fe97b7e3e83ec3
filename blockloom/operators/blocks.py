"""Files as relations of blocks.

``files`` below is any DataFrame with ``file_id`` and a binary ``content``;
blocks are ``file_id, block_index, offset, file_size, data``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BLOCK = "file_id bigint, block_index bigint, offset bigint, file_size bigint, data binary"


def files_of(rows: DataFrame, id_col: str, content_col: str) -> DataFrame:
    """Rows as files: a text column counts as its UTF-8 bytes, null as empty."""
    content = F.coalesce(F.col(content_col).cast("binary"), F.lit(b""))
    return rows.select(F.col(id_col).alias("file_id"), content.alias("content"))


def size_of(content: str = "content") -> Column:
    return F.octet_length(content).cast("bigint")


def split(files: DataFrame, block_size: int, content: str = "content", keep: list[str] | None = None) -> DataFrame:
    """The blocks of every file; an empty file has none.

    Slices are made inside the generator, so a row carries its own block and
    not the whole file. The generator is the outer form on files that are not
    empty: for the plain one Spark infers a filter that makes all slices twice.
    """
    if block_size <= 0:
        raise ValueError("block size must be positive")
    size = F.octet_length(content)
    last = F.floor((size - 1) / block_size).cast("int")
    one = lambda i: F.struct(i.cast("bigint").alias("block_index"), F.substring(F.col(content), i * block_size + 1, block_size).alias("data"))
    cut = F.transform(F.sequence(F.lit(0), last), one)
    rows = files.where(size > 0).select("file_id", *(keep or []), size.cast("bigint").alias("file_size"), F.explode_outer(cut).alias("b"))
    return rows.select("file_id", *(keep or []), "b.block_index", (F.col("b.block_index") * block_size).alias("offset"), "file_size", "b.data")


def scan_stats(files: DataFrame, block_size: int) -> DataFrame:
    """``file_id, file_size, blocks, last_len``: what a pure scan reads, from lengths alone."""
    size = size_of()
    blocks = F.floor((size + (block_size - 1)) / block_size).cast("bigint")
    return files.select("file_id", size.alias("file_size"), blocks.alias("blocks"), F.when(size > 0, (size - 1) % block_size + 1).otherwise(0).cast("bigint").alias("last_len"))


def map_blocks(blocks: DataFrame, value: Column, name: str = "value") -> DataFrame:
    """One value for each block, in block order within a file."""
    return blocks.select("file_id", "block_index", "offset", value.alias(name)).orderBy("file_id", "block_index")


def map_blocks_python(blocks: DataFrame, mapper: Callable[[bytes], object], kind: str, name: str = "value") -> DataFrame:
    """The same with a Python function of a block's bytes, in Arrow batches."""
    import pandas as pd

    @F.pandas_udf(kind)
    def run(data: pd.Series) -> pd.Series:
        return data.map(mapper)

    return map_blocks(blocks, run("data"), name)


def complete(mapped: DataFrame, stats: DataFrame) -> DataFrame:
    """``file_id, complete``: whether every block of a file has a result."""
    have = mapped.groupBy("file_id").agg(F.count("*").alias("have"))
    return stats.join(have, "file_id", "left").select("file_id", (F.coalesce("have", F.lit(0)) == F.col("blocks")).alias("complete"))


def visit_blocks(blocks: DataFrame, visit: Callable) -> None:
    """Calls ``visit(row)`` once for each block, unordered, on the executors."""
    blocks.foreach(visit)


def read_range(files: DataFrame, offset: int, length: int) -> DataFrame:
    """``file_id, data``: exactly the range, null where the file ends before it does."""
    if offset < 0 or length < 0:
        raise ValueError("ranges are not negative")
    whole = size_of() >= offset + length
    return files.select("file_id", F.when(whole, F.substring("content", offset + 1, length)).alias("data"))


def assemble(blocks: DataFrame) -> DataFrame:
    """``file_id, content`` from blocks, for files that fit a row."""
    gathered = blocks.groupBy("file_id").agg(F.sort_array(F.collect_list(F.struct("block_index", "data"))).alias("all"))
    joined = F.unhex(F.array_join(F.transform("all", lambda b: F.hex(b["data"])), ""))
    return gathered.select("file_id", joined.alias("content"))


def indexed_jobs(spark, count: int, job: Callable[[int], object], kind: str, partitions: int | None = None) -> DataFrame:
    """``job_index, value``: ``job`` run for each index, spread over partitions."""
    import pandas as pd

    @F.pandas_udf(kind)
    def run(index: pd.Series) -> pd.Series:
        return index.map(lambda i: job(int(i)))

    jobs = spark.range(0, count, 1, partitions or max(1, min(count, spark.sparkContext.defaultParallelism)))
    return jobs.select(F.col("id").alias("job_index"), run("id").alias("value"))


def file_digests(blocks: DataFrame, kind: str = "sha256") -> DataFrame:
    """``file_id, digest`` of whole files from their blocks, for files beyond one row.

    A file's blocks are sorted into one task and stream through the digest's
    state, so a task holds a batch of blocks and no file. Files without blocks
    have no row. ``kind`` is ``sha256`` or ``blake3``.
    """
    import pyarrow as pa

    from ..functions.digests import STREAMS

    make = STREAMS[kind]

    def run(batches):
        now, state = None, None
        for batch in batches:
            for file_id, data in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True):
                if state is None or file_id != now:
                    if state is not None:
                        yield pa.RecordBatch.from_pydict({"file_id": pa.array([now], batch.schema.field(0).type), "digest": [state.hex()]})
                    now, state = file_id, make()
                state.update(data)
            last = batch.schema.field(0).type
        if state is not None:
            yield pa.RecordBatch.from_pydict({"file_id": pa.array([now], last), "digest": [state.hex()]})

    rows = blocks.select("file_id", "block_index", "data").repartition("file_id").sortWithinPartitions("file_id", "block_index")
    return rows.mapInArrow(run, f"file_id {blocks.schema['file_id'].dataType.simpleString()}, digest string")
