"""A session with the settings that the engine's plans expect."""

from __future__ import annotations

from pyspark.sql import SparkSession

CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.python.filterPushdown.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
}


def session(master: str | None = None, **conf: str) -> SparkSession:
    """A session, with the block sources registered."""
    builder = SparkSession.builder.appName("blockloom").config(map=CONF | {k.replace("__", "."): v for k, v in conf.items()})
    spark = (builder.master(master) if master else builder).getOrCreate()
    register(spark)
    return spark


def register(spark: SparkSession) -> None:
    """Registers the block sources, and lowers the session's limit of an Arrow batch to what a batch of blocks holds (64 MB otherwise)."""
    from .sources.block_source import BATCH_BYTES, BlockSource
    from .sources.block_sink import BlockSink
    from .sources.container_source import ContainerSource

    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    number = spark.conf.get(key).lower().rstrip("b")
    if not number.isdigit() or not 0 < int(number) <= BATCH_BYTES:
        spark.conf.set(key, f"{BATCH_BYTES}b")
    for source in (BlockSource, BlockSink, ContainerSource):
        spark.dataSource.register(source)
