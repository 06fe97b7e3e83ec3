"""Helpers that several training-data operators share."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words of a shingle, and the least similarity of near copies.
SHINGLE_WORDS = 5
NEAR = 0.8

_WORD = re.compile(r"\w+")
_OWN: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, from ``spark.checkpoint.dir``.

    Only where that is unset (a plain local session) a temporary folder of
    this process stands in.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if base:
        return base.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("spark.checkpoint.dir must name a shared folder on a cluster")
    if not _OWN:
        _OWN.append(tempfile.mkdtemp(prefix="blockloom-"))
        atexit.register(shutil.rmtree, _OWN[0], ignore_errors=True)
    return f"file://{_OWN[0]}"


#: Most bytes of an Arrow batch: what a worker is handed at once, beside single longer rows.
BATCH_BYTES = 16 << 20


def bound_batches(spark: SparkSession) -> None:
    """Lowers the session's limit of an Arrow batch to ``BATCH_BYTES``; long texts otherwise come in batches of 64 MB."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    number = spark.conf.get(key).lower().rstrip("b")
    if not number.isdigit() or not 0 < int(number) <= BATCH_BYTES:
        spark.conf.set(key, f"{BATCH_BYTES}b")


class Stage:
    """Tables written to the shared folder; they cut lineage and outlive executors.

    A table is read back with the schema that was written, so that an empty
    one is as good as any other. ``drop`` deletes tables that nothing reads any
    more; what a result still reads stays until ``drop_all``.
    """

    made: list[Stage] = []

    def __init__(self, spark: SparkSession, label: str):
        self.spark, self.names = spark, []
        self.root = f"{shared_dir(spark)}/blockloom/{label}-{uuid.uuid4().hex}"
        Stage.made.append(self)

    def put(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{self.root}/{name}"
        df.write.mode("overwrite").parquet(path)
        self.names.append(name)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *names: str) -> None:
        jvm = self.spark.sparkContext._jvm
        for name in names:
            path = jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
            path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
            self.names.remove(name)

    @classmethod
    def drop_all(cls) -> None:
        """Deletes every table of this process; for when its results have been written."""
        for stage in cls.made:
            stage.drop(*stage.names)
        cls.made.clear()


def words(text: str | None) -> list[str]:
    """Lower-case runs of letters, digits and underscores."""
    return _WORD.findall(text.lower()) if text else []


def only(df: DataFrame, *names: str) -> DataFrame:
    """The named columns; others, whatever their names, are left out."""
    return df.select(*[F.col(f"`{n}`") for n in names])


def strings(column: pa.ChunkedArray | pa.Array) -> list[str | None]:
    return column.to_pylist()


def batches(rows: Iterable[pa.RecordBatch], most_chars: int = 8_000_000, text: str = "text", most_rows: int = 2048) -> Iterator[pa.RecordBatch]:
    """The same rows in slices of bounded text and number, so that neither long texts nor what short ones give add up."""
    for batch in rows:
        column = batch.column(batch.schema.get_field_index(text))
        at, n = 0, batch.num_rows
        sizes = pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False)
        ends = np.cumsum(sizes, dtype=np.int64)
        while at < n:
            before = ends[at - 1] if at else 0
            to = min(at + most_rows, max(at + 1, int(np.searchsorted(ends, before + most_chars, side="right"))))
            yield batch.slice(at, to - at)
            at = to


class Memo(dict):
    """A dictionary that computes what it lacks and stops growing at a bound.

    The bound keeps a worker's memory fixed; beyond it, and for keys of
    ``KEY`` or more characters, values are computed anew each time, so results
    never depend on it.
    """

    KEY = 64

    def __init__(self, make, most: int):
        super().__init__()
        self.make, self.most = make, most

    def __missing__(self, key):
        value = self.make(key)
        if len(self) < self.most and len(key) < self.KEY:
            self[key] = value
        return value


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(z, -35, 35)))
