"""Which hash of a block to trust, from copies of the file and from manifests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The outcomes, by name and as shown.
BASIS = {"IntactHash": "intact hash", "FileAndFileAgreement": "file+file agreement", "FileAndManifestAgreement": "file+manifest agreement"}
FAILURE = {
    "ManifestOnlyAgreement": "manifest+manifest hashes agree", "NoBlockHashFound": "no block hash found either",
    "IntactHashWithoutMatchingBlock": "intact hash found but no matching file block", "ConflictingIntactHashes": "conflicting intact hashes",
}
RECOVERED, FAILED = "recovered block based on %s", "failed to recover corrupt block [%s]"
VOTE = "array<struct<hash:string,total_votes:bigint,file_copy_votes:bigint,hash_replica_votes:bigint>>"


def tally(files: Column, manifests: Column) -> Column:
    """Votes by hash: most votes first, then by file votes, manifest votes and hash.

    ``files`` is an array of the copies' hashes (null for a copy without the
    block), ``manifests`` an array of ``struct<hash, intact>``.
    """
    have = F.filter(files, lambda h: h.isNotNull())
    of_manifests = F.transform(manifests, lambda m: m["hash"])
    every = F.array_distinct(F.concat(have, of_manifests))

    def vote(h: Column) -> Column:
        f = F.size(F.filter(have, lambda x: x == h)).cast("bigint")
        m = F.size(F.filter(of_manifests, lambda x: x == h)).cast("bigint")
        return F.struct((-(f + m)).alias("t"), (-f).alias("f"), (-m).alias("m"), h.alias("h"))

    ordered = F.array_sort(F.transform(every, vote))
    return F.transform(ordered, lambda v: F.struct(v["h"].alias("hash"), (-v["t"]).alias("total_votes"), (-v["f"]).alias("file_copy_votes"), (-v["m"]).alias("hash_replica_votes")))


def unique_top(votes: Column, predicate) -> Column:
    """The hash of the first vote that qualifies, unless the next such has as many votes."""
    some = F.filter(votes, predicate)
    alone = (F.size(some) == 1) | (F.try_element_at(some, F.lit(2))["total_votes"] < F.try_element_at(some, F.lit(1))["total_votes"])
    return F.when((F.size(some) > 0) & alone, F.try_element_at(some, F.lit(1))["hash"])


def decide(rows: DataFrame, files: str = "files", manifests: str = "manifests") -> DataFrame:
    """Adds ``votes, elected_hash, repair_source_index, basis, failure``.

    An intact manifest rules unless intact ones disagree, or copies agree on
    another hash. Without one, two copies decide, then a copy and a manifest;
    manifests alone elect a hash that nothing can be repaired from.
    """
    f, m = F.col(files), F.col(manifests)
    rows = rows.withColumn("votes", tally(f, m))
    sound = F.transform(F.filter(m, lambda x: x["intact"]), lambda x: x["hash"])
    rows = rows.withColumns({
        "_sound": F.array_distinct(sound),
        "_ff": unique_top(F.col("votes"), lambda v: v["file_copy_votes"] >= 2),
        "_fm": unique_top(F.col("votes"), lambda v: (v["file_copy_votes"] >= 1) & (v["hash_replica_votes"] >= 1)),
        "_mm": unique_top(F.col("votes"), lambda v: v["hash_replica_votes"] >= 2),
    })
    ruled = F.size("_sound") > 0
    first = F.try_element_at("_sound", F.lit(1))
    conflict = ruled & ((F.size("_sound") > 1) | F.coalesce(F.col("_ff") != first, F.lit(False)))
    elected = F.when(conflict, None).when(ruled, first).otherwise(F.coalesce("_ff", "_fm", "_mm"))
    rows = rows.withColumns({"_conflict": conflict, "_ruled": ruled, "elected_hash": elected})
    place = F.array_position(f, F.col("elected_hash"))
    by_copy = F.col("_ruled") | F.coalesce("_ff", "_fm").isNotNull()
    source = F.when(by_copy & (place > 0), (place - 1).cast("int"))
    rows = rows.withColumn("repair_source_index", F.when(F.col("elected_hash").isNotNull(), source))
    found = F.col("repair_source_index").isNotNull()
    basis = F.when(F.col("_conflict"), None).when(F.col("_ruled"), F.when(found, "IntactHash")).when(F.col("_ff").isNotNull(), "FileAndFileAgreement").when(F.col("_fm").isNotNull(), "FileAndManifestAgreement")
    failure = F.when(F.col("_conflict"), "ConflictingIntactHashes").when(F.col("_ruled"), F.when(~found, "IntactHashWithoutMatchingBlock")).when(
        F.coalesce("_ff", "_fm").isNotNull(), None
    ).when(F.col("_mm").isNotNull(), "ManifestOnlyAgreement").otherwise("NoBlockHashFound")
    return rows.withColumns({"basis": basis, "failure": failure}).drop("_sound", "_ff", "_fm", "_mm", "_conflict", "_ruled")


def status_message(basis: Column, failure: Column) -> Column:
    """The outcome in words."""
    known = [F.when(basis == k, RECOVERED % v) for k, v in BASIS.items()] + [F.when(failure == k, FAILED % v) for k, v in FAILURE.items()]
    return F.coalesce(*known, F.lit(FAILED % "unknown reason"))


def witnesses(copies: DataFrame, replicas: DataFrame, is_intact: Column) -> DataFrame:
    """``file_id, block_index, files, manifests`` for each block that a copy has.

    ``copies`` is ``file_id, copy_index, hashes``; ``replicas`` is ``file_id,
    manifest``. Digests only are shuffled, once, and a block's group holds one
    row for each copy and replica. The position in ``files`` is the copy index.
    """
    # The outer form, since the plain one has Spark infer a filter on the array's size, for which all digests are taken twice.
    of_copies = copies.select("file_id", F.posexplode_outer("hashes").alias("block_index", "hash"), F.col("copy_index").cast("int").alias("source"), F.lit(None).cast("boolean").alias("intact"))
    of_replicas = replicas.withColumn("intact", is_intact).select("file_id", F.posexplode_outer("manifest.block_hashes").alias("block_index", "hash"), F.lit(None).cast("int").alias("source"), "intact")
    seen = of_copies.unionByName(of_replicas).where("block_index is not null").groupBy("file_id", "block_index").agg(
        F.collect_list(F.when(F.col("source").isNotNull(), F.struct("source", "hash"))).alias("c"), F.collect_list(F.when(F.col("source").isNull(), F.struct("hash", "intact"))).alias("manifests"), F.max("source").alias("last"),
    ).where("last is not null")
    by_copy = F.map_from_entries(F.col("c"))
    files = F.transform(F.sequence(F.lit(0), F.col("last")), lambda i: F.try_element_at(by_copy, i))
    return seen.select("file_id", F.col("block_index").cast("bigint").alias("block_index"), files.alias("files"), "manifests")
