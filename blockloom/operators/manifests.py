"""Block-hash manifests: building, checking, and comparing their replicas.

A manifest is one struct column; ``replicas`` below is a DataFrame
``file_id, replica, manifest`` in which unreadable replicas have no row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.digests import block_hashes, root_digest, valid_digest
from .blocks import size_of

MANIFEST = "hash_type string, file_size bigint, block_size bigint, bytes_hashed bigint, block_hashes array<string>, hash_of_hashes string"
REPLICAS = 3
#: Block sizes of manifests are multiples of this.
UNIT = 4096


def check_block_size(block_size: int, unit: int = UNIT) -> None:
    if block_size <= 0 or block_size % unit:
        raise ValueError(f"block size must be a positive multiple of {unit}")


def build(files: DataFrame, block_size: int, hash_type: str = "sha256", unit: int = UNIT, content: str = "content") -> DataFrame:
    """``file_id, manifest`` of every file, row by row: no block leaves its row."""
    check_block_size(block_size, unit)
    size = size_of(content)
    hashed = files.select("file_id", size.alias("file_size"), block_hashes(F.col(content), size, block_size, hash_type).alias("hashes"))
    return hashed.select("file_id", F.struct(
        F.lit(hash_type).alias("hash_type"), "file_size", F.lit(block_size).cast("bigint").alias("block_size"),
        F.col("file_size").alias("bytes_hashed"), F.col("hashes").alias("block_hashes"), root_digest(F.col("hashes"), hash_type).alias("hash_of_hashes"),
    ).alias("manifest"))


def build_from_blocks(digests: DataFrame, block_size: int, hash_type: str = "sha256") -> DataFrame:
    """``file_id, manifest`` from ``file_id, block_index, file_size, hash`` rows, for files beyond one row.

    Only digests are shuffled, and they are put in order inside the aggregate.
    """
    gathered = digests.groupBy("file_id").agg(F.max("file_size").alias("file_size"), F.sort_array(F.collect_list(F.struct("block_index", "hash"))).alias("all"))
    hashes = F.transform("all", lambda b: b["hash"])
    return gathered.select("file_id", F.struct(
        F.lit(hash_type).alias("hash_type"), "file_size", F.lit(block_size).cast("bigint").alias("block_size"), F.col("file_size").alias("bytes_hashed"),
        hashes.alias("block_hashes"), root_digest(hashes, hash_type).alias("hash_of_hashes"),
    ).alias("manifest"))


def replicate(manifests: DataFrame, count: int = REPLICAS) -> DataFrame:
    """Every manifest in ``count`` replicas."""
    return manifests.select("file_id", F.explode(F.sequence(F.lit(0), F.lit(count - 1))).alias("replica"), "manifest")


def intact(manifest: Column, unit: int = UNIT) -> Column:
    """The six checks of a manifest against itself."""
    size, block, kind = manifest["file_size"], manifest["block_size"], manifest["hash_type"]
    hashes, root = manifest["block_hashes"], manifest["hash_of_hashes"]
    well_sized = (block > 0) & (block % unit == 0)
    expected = F.when(block > 0, F.floor((size + block - 1) / block))
    right_root = F.when(kind == "sha256", F.sha2(F.unhex(F.array_join(hashes, "")), 256) == root)
    from ..functions.digests import _root_xxh3

    right_root = F.when(kind == "xxh3", _root_xxh3(hashes) == root).otherwise(right_root)
    digests = F.forall(hashes, lambda h: valid_digest(h, kind))
    checked = (manifest["bytes_hashed"] == size) & well_sized & valid_digest(root, kind) & digests & (F.size(hashes) == expected)
    return F.coalesce(F.when(checked, right_root).otherwise(F.lit(False)), F.lit(False))


def intact_sha256(manifest: Column, unit: int = UNIT) -> Column:
    """``intact`` for sha256 manifests, built-in functions only; other types are not intact."""
    size, block, kind = manifest["file_size"], manifest["block_size"], manifest["hash_type"]
    hashes, root = manifest["block_hashes"], manifest["hash_of_hashes"]
    expected = F.when(block > 0, F.floor((size + block - 1) / block))
    digests = F.forall(hashes, lambda h: valid_digest(h, kind))
    checked = (kind == "sha256") & (manifest["bytes_hashed"] == size) & (block > 0) & (block % unit == 0) & valid_digest(root, kind) & digests & (F.size(hashes) == expected)
    return F.coalesce(F.when(checked, F.sha2(F.unhex(F.array_join(hashes, "")), 256) == root).otherwise(F.lit(False)), F.lit(False))


def geometry(replicas: DataFrame) -> DataFrame:
    """``file_id, loaded, agree, file_size, block_size, blocks, hash_type``: whether a file's replicas agree on their shape."""
    m = F.col("manifest")
    shape = F.struct(m["file_size"].alias("file_size"), m["block_size"].alias("block_size"), F.size(m["block_hashes"]).cast("bigint").alias("blocks"), m["hash_type"].alias("hash_type"))
    seen = replicas.groupBy("file_id").agg(F.count("*").alias("loaded"), F.min(shape).alias("low"), F.max(shape).alias("high"))
    return seen.select("file_id", "loaded", (F.col("low") == F.col("high")).alias("agree"), *[F.when(F.col("low") == F.col("high"), F.col("low")[c]).alias(c) for c in ("file_size", "block_size", "blocks", "hash_type")])


def require_agreement(replicas: DataFrame) -> DataFrame:
    """``geometry``, failing on the first file whose replicas disagree."""
    return geometry(replicas).where(F.when(F.col("agree"), F.lit(True)).otherwise(F.raise_error(F.concat(F.lit("sidecars disagree on the shape of file "), F.col("file_id").cast("string"))).cast("boolean")))


def summary(replicas: DataFrame, is_intact: Column | None = None) -> DataFrame:
    """``file_id, loaded, agreed``: how many replicas were read, and the manifest that all intact ones agree on, or null.

    At most ``REPLICAS`` manifests of a file meet.
    """
    good = intact_sha256(F.col("manifest")) if is_intact is None else is_intact
    kept = replicas.select("file_id", F.struct("manifest", good.alias("intact")).alias("r"))
    gathered = kept.groupBy("file_id").agg(F.collect_list("r").alias("all"))
    sound = F.transform(F.filter("all", lambda r: r["intact"]), lambda r: r["manifest"])
    distinct = F.array_distinct(sound)
    return gathered.select("file_id", F.size("all").alias("loaded"), F.when(F.size(distinct) == 1, F.element_at(distinct, 1)).alias("agreed"), F.size(sound).alias("sound"), "all")


def healthy(current: Column, all_replicas: Column) -> Column:
    """Whether all replicas are there, intact, and equal to the current manifest."""
    return F.coalesce((F.size(all_replicas) == REPLICAS) & F.forall(all_replicas, lambda r: r["intact"] & (r["manifest"] == current)), F.lit(False))


def mismatched(expected: DataFrame, current: DataFrame) -> DataFrame:
    """``file_id, block_index`` where two manifests of one shape differ; other shapes are an error."""
    e, c = F.col("e.manifest"), F.col("c.manifest")
    same = (e["file_size"] == c["file_size"]) & (e["block_size"] == c["block_size"]) & (e["hash_type"] == c["hash_type"]) & (F.size(e["block_hashes"]) == F.size(c["block_hashes"]))
    pairs = expected.alias("e").join(current.alias("c"), "file_id").select("file_id", F.when(same, F.arrays_zip(e["block_hashes"].alias("a"), c["block_hashes"].alias("b"))).otherwise(F.raise_error(F.lit("manifests differ in shape")).cast("array<struct<a:string,b:string>>")).alias("pairs"))
    return pairs.select("file_id", F.posexplode_outer("pairs").alias("block_index", "p")).where("p.a <> p.b").select("file_id", F.col("block_index").cast("bigint").alias("block_index"))
