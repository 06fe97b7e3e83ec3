"""Verification of files against their sidecar manifests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import election
from .manifests import MANIFEST, UNIT, intact_sha256, summary

FIELDS = ", ".join(f.replace(" ", ":") for f in MANIFEST.split(", "))


def _judged(current: DataFrame, replicas: DataFrame, unit: int, is_intact: Column | None) -> DataFrame:
    """A row for each block, or one without a block for an empty file, with what its file says.

    What the manifests say of a block is looked up inside the file's row, before blocks become
    rows. Otherwise every block would carry all digests of its file.
    """
    good = intact_sha256(F.col("manifest"), unit) if is_intact is None else is_intact
    m, none = F.col("manifest"), F.array().cast(f"array<struct<manifest:struct<{FIELDS}>,intact:boolean>>")
    no_votes = F.array().cast("array<struct<hash:string,intact:boolean>>")

    def of_block(h: Column, i: Column) -> Column:
        fine = F.coalesce(F.get("agreed.block_hashes", i) == h, F.lit(False))
        votes = F.filter(F.transform(F.coalesce("all", none), lambda r: F.struct(F.get(r["manifest"]["block_hashes"], i).alias("hash"), r["intact"].alias("intact"))), lambda x: x["hash"].isNotNull())
        return F.struct(h.alias("hash"), fine.alias("fine"), F.when(fine, no_votes).otherwise(votes).alias("votes"))

    of_file = ["bytes_hashed", "file_size", "loaded_manifests", "expected_size"]
    rows = current.join(summary(replicas, good), "file_id", "left").select(
        "file_id", m["bytes_hashed"].alias("bytes_hashed"), m["file_size"].alias("file_size"), F.coalesce("loaded", F.lit(0)).cast("bigint").alias("loaded_manifests"), F.col("agreed.file_size").alias("expected_size"),
        F.posexplode_outer(F.transform(m["block_hashes"], of_block)).alias("block_index", "b"),
    )
    rows = rows.select("file_id", *of_file, F.col("block_index").cast("bigint").alias("block_index"), F.col("b.hash").alias("current_hash"), F.coalesce("b.fine", F.lit(False)).alias("fine"), F.array("b.hash").alias("files"), F.coalesce("b.votes", no_votes).alias("manifests"))
    elected = F.coalesce((F.col("elected_hash") == F.col("current_hash")) & (F.col("repair_source_index") == 0), F.lit(False))
    return election.decide(rows).withColumn("block_ok", F.col("fine") | elected)


def verify_blocks(current: DataFrame, replicas: DataFrame, unit: int = UNIT, is_intact: Column | None = None) -> DataFrame:
    """Each block that the file has now: ``file_id, block_index, current_hash, block_ok`` and the decision.

    Blocks that equal the manifest on which all intact replicas agree are fine
    at once; only the others are put to the vote of the file and its replicas.
    This goes over the blocks that exist: a file cut at a block boundary is
    found by ``verify_report``'s ``size_matches``.
    """
    clear = lambda c: F.when(~F.col("fine"), F.col(c)).alias(c)
    shown = [clear(c) for c in ("elected_hash", "repair_source_index", "basis", "failure", "votes")]
    return _judged(current, replicas, unit, is_intact).where("block_index is not null").select("file_id", "block_index", "current_hash", "block_ok", *shown)


def verify_report(current: DataFrame, replicas: DataFrame, unit: int = UNIT, is_intact: Column | None = None) -> DataFrame:
    """One row per file: ``bytes_hashed, total_blocks, loaded_manifests, ok_blocks, bad_blocks, size_matches``.

    ``size_matches`` is null without a manifest that the intact replicas agree
    on. Files and replicas are read once; a file's facts travel with its blocks.
    """
    there = F.col("block_index").isNotNull()
    rows = _judged(current, replicas, unit, is_intact).groupBy("file_id").agg(
        F.first("bytes_hashed").alias("bytes_hashed"), F.count("block_index").alias("total_blocks"), F.first("loaded_manifests").alias("loaded_manifests"),
        F.count_if(there & F.col("block_ok")).alias("ok_blocks"), F.count_if(there & ~F.col("block_ok")).alias("bad_blocks"), (F.first("expected_size") == F.first("file_size")).alias("size_matches"),
    )
    return rows
