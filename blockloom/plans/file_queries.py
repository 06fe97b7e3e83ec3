"""Queries over files by path, and their SQL.

All documents, in the order of their ids, are written as one file by all tasks,
into the folder that driver and executors share. The by-path functions then
read, search, hash, damage, verify, repair, compare and copy that file.
"""

from __future__ import annotations

import atexit
import contextlib
import os
import shutil
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import api
from ..operators import recover, writing
from ..sources.block_source import local_path
from .queries import DAMAGE, FILES, PATTERN, documents
from .registry import query

BLOCK = 1 << 16
#: Copy ``c`` has its block ``i`` damaged where ``(i + c) % EVERY = 0``.
EVERY = 4
_OWN: list[str] = []


def shared_folder(spark: SparkSession) -> str:
    """A folder that driver and executors mount, from ``spark.checkpoint.dir``; a temporary one in local sessions without it."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if base:
        path = local_path(base.rstrip("/"))
        if "://" in path:
            raise ValueError(f"files by path need a mounted folder, not {base}")
        return path
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("spark.checkpoint.dir must name a shared folder on a cluster")
    if not _OWN:
        _OWN.append(tempfile.mkdtemp(prefix="blockloom-files-"))
        atexit.register(shutil.rmtree, _OWN[0], ignore_errors=True)
    return _OWN[0]


def folder(spark: SparkSession) -> str:
    """A new folder under the shared one, which goes when the driver's process ends."""
    path = os.path.join(shared_folder(spark), "blockloom-files", uuid.uuid4().hex)
    os.makedirs(path)
    atexit.register(shutil.rmtree, path, ignore_errors=True)
    return path


@contextlib.contextmanager
def scratch(spark: SparkSession) -> Iterator[str]:
    """As ``folder``, for results that are computed when the block ends."""
    path = folder(spark)
    try:
        yield path
    finally:
        shutil.rmtree(path, ignore_errors=True)


def write_documents(spark: SparkSession, sf_dir: str, path: str) -> str:
    """All documents as one file; places are sums of lengths, and all tasks write."""
    placed = writing.append_ranges(documents(spark, sf_dir).withColumn("file", F.lit(0)), "file", "file_id", "content")
    total = placed.agg(F.coalesce(F.sum("len"), F.lit(0))).first()[0]
    api.write_blocks(placed.select("offset", F.col("content").alias("data")), path, total)
    return path


def damage(spark: SparkSession, path: str, copy: int) -> None:
    """Overwrites the first bytes of some blocks in place."""
    blocks = api.open_file(spark, path, BLOCK).blocks().where((F.col("block_index") + copy) % EVERY == 0)
    api.write_blocks(blocks.select("offset", F.substring(F.lit(DAMAGE), F.lit(1), F.octet_length("data")).alias("data")), path, os.path.getsize(path), truncate=False)


def rows(spark: SparkSession, schema: str, *values: tuple) -> DataFrame:
    return spark.createDataFrame(list(values), schema)


ONE = f"{FILES}, one AS (SELECT coalesce(string_agg(h, '' ORDER BY file_id), '') AS h, CAST(coalesce(sum(size), 0) AS BIGINT) AS size FROM f)"
CUT = f"""{ONE}, b AS (SELECT size, i AS block_index, substr(h, i * {2 * BLOCK} + 1, {2 * BLOCK}) AS x FROM one, unnest(range((size + {BLOCK - 1}) // {BLOCK})) AS t(i)),
    k AS (SELECT c, size, block_index, x, CASE WHEN (block_index + c) % {EVERY} = 0 THEN substr('5A5A5A5A', 1, least(8, length(x))) || substr(x, 9) ELSE x END AS y FROM b, unnest(range(3)) AS u(c))"""


@query("path_blocks", f"""WITH {CUT} SELECT block_index, block_index * {BLOCK} AS "offset", size AS file_size, CAST(length(x) // 2 AS BIGINT) AS length, sha256(unhex(x)) AS digest FROM b""")
def path_blocks(spark, sf_dir):
    path = write_documents(spark, sf_dir, f"{folder(spark)}/all")
    blocks = api.open_file(spark, path, BLOCK).blocks()
    return blocks.select("block_index", "offset", "file_size", F.octet_length("data").cast("bigint").alias("length"), F.sha2("data", 256).alias("digest"))


@query("path_shape", f"""WITH {ONE} SELECT size AS bytes, (size + {BLOCK - 1}) // {BLOCK} AS blocks, size AS scanned, sha256(unhex(h)) AS digest, lower(substr(h, 2 * 12345 + 1, 2000)) AS part FROM one""")
def path_shape(spark, sf_dir):
    with scratch(spark) as at:
        file = api.open_file(spark, write_documents(spark, sf_dir, f"{at}/all"), BLOCK)
        found = (len(file), file.block_count(), file.byte_count(), api.digest_file(spark, file.path, "sha256", BLOCK), file.read_range(12345, 1000).hex())
    return rows(spark, "bytes bigint, blocks bigint, scanned bigint, digest string, part string", found)


@query("path_grep", f"""WITH {ONE}, p AS (SELECT string_split(regexp_replace(h, '(..)', '\\1 ', 'g'), '74 68 65 20 ') AS parts FROM one),
    u AS (SELECT unnest(parts) AS part, generate_subscripts(parts, 1) AS i FROM p), n AS (SELECT i, sum(length(part) // 3) OVER (ORDER BY i) + 4 * (i - 1) AS place, count(*) OVER () AS n FROM u)
    SELECT CAST(place AS BIGINT) AS "offset" FROM n WHERE i < n""")
def path_grep(spark, sf_dir):
    path = write_documents(spark, sf_dir, f"{folder(spark)}/all")
    return api.open_file(spark, path, BLOCK).grep(PATTERN)


@query("path_verify", f"""WITH {CUT} SELECT max(size) AS bytes_hashed, count(*) AS total_blocks, CAST(3 AS BIGINT) AS loaded_manifests, count(*) FILTER (x = y) AS ok_blocks, count(*) FILTER (x <> y) AS bad_blocks,
    true AS size_matches, coalesce(string_agg(CASE WHEN x <> y THEN block_index || ' ' || sha256(unhex(y)) || ' IntactHashWithoutMatchingBlock' END, ',' ORDER BY block_index), '') AS bad FROM k WHERE c = 0""")
def path_verify(spark, sf_dir):
    with scratch(spark) as at:
        path = write_documents(spark, sf_dir, f"{at}/all")
        api.hash_file(spark, path, "sha256", BLOCK)
        damage(spark, path, 0)
        r = api.verify_file(spark, path)
    bad = ",".join(f"{b['block_index']} {b['current_hash']} {b['failure']}" for b in r.bad_blocks)
    return rows(spark, "bytes_hashed bigint, total_blocks bigint, loaded_manifests bigint, ok_blocks bigint, bad_blocks bigint, size_matches boolean, bad string", (r.bytes_hashed, r.total_blocks, r.loaded_manifests, r.ok_blocks, len(r.bad_blocks), r.size_matches, bad))


REPORT = "bytes_hashed bigint, repaired_blocks bigint, repaired_files bigint, sidecars_refreshed bigint, used_fast_path boolean, fell_back_to_full_scan boolean, failed_blocks bigint"


def _recovered(spark: SparkSession, sf_dir: str, mode: str, hash_type: str, damaged: tuple[int, ...]) -> DataFrame:
    """Three copies, sidecars of the first; its report, and the contents of all copies afterwards."""
    with scratch(spark) as at:
        first = write_documents(spark, sf_dir, f"{at}/copy0")
        paths = [first, f"{at}/copy1", f"{at}/copy2"]
        for other in paths[1:]:
            api.copy_file(spark, first, other)
        api.hash_file(spark, first, hash_type, BLOCK)
        for c in damaged:
            damage(spark, paths[c], c)
        r = api.recover_file(spark, first, paths[1:], mode=mode)
        report = (r.bytes_hashed, r.repaired_blocks, r.repaired_files, r.sidecars_refreshed, r.used_fast_path, r.fell_back_to_full_scan, len(r.failed_blocks))
        after = [(c, api.digest_file(spark, p, "sha256", BLOCK), *report) for c, p in enumerate(paths)]
    return rows(spark, f"copy_index int, digest string, {REPORT}", *after)


def _recovered_sql(repaired: str, hashed: str, refreshed: int, fast: str, fell: str) -> str:
    """``repaired``: which copies end whole, as a condition on ``c``; the others stay damaged."""
    return f"""WITH {CUT}, s AS (SELECT c, max(size) AS size, sha256(unhex(string_agg(CASE WHEN {repaired} THEN x ELSE y END, '' ORDER BY block_index))) AS digest, count(*) FILTER (x <> y AND {repaired}) AS n FROM k GROUP BY c),
    t AS (SELECT CAST(sum(n) AS BIGINT) AS blocks, count(*) FILTER (n > 0) AS files FROM s WHERE {repaired})
    SELECT CAST(c AS INTEGER) AS copy_index, digest, {hashed} AS bytes_hashed, blocks AS repaired_blocks, files AS repaired_files, CAST({refreshed} AS BIGINT) AS sidecars_refreshed,
    {fast} AS used_fast_path, {fell} AS fell_back_to_full_scan, CAST(0 AS BIGINT) AS failed_blocks FROM s, t"""


@query("path_recover", _recovered_sql("c = 0", "size * 3", 0, "false", "false"))
def path_recover(spark, sf_dir):
    return _recovered(spark, sf_dir, recover.STANDARD, "sha256", (0, 1, 2))


@query("path_recover_in_place_all", _recovered_sql("true", "size * 3", 2, "false", "false"))
def path_recover_in_place_all(spark, sf_dir):
    return _recovered(spark, sf_dir, recover.IN_PLACE_ALL, "sha256", (0, 1, 2))


@query("path_recover_xxh3", _recovered_sql("true", "size * 3", 2, "false", "false"))
def path_recover_xxh3(spark, sf_dir):
    return _recovered(spark, sf_dir, recover.IN_PLACE_ALL, "xxh3", (0, 1, 2))


@query("path_recover_fast_fallback", _recovered_sql("c = 0", "size * 3", 0, "false", "true"))
def path_recover_fast_fallback(spark, sf_dir):
    return _recovered(spark, sf_dir, recover.FAST, "xxh3", (0, 1, 2))


@query("path_recover_fast", f"""WITH {CUT}, s AS (SELECT c, max(size) AS size, sha256(unhex(string_agg(CASE WHEN c = 0 THEN x ELSE y END, '' ORDER BY block_index))) AS digest FROM k GROUP BY c)
    SELECT CAST(c AS INTEGER) AS copy_index, digest, size AS bytes_hashed, CAST(0 AS BIGINT) AS repaired_blocks, CAST(0 AS BIGINT) AS repaired_files, CAST(0 AS BIGINT) AS sidecars_refreshed,
    true AS used_fast_path, false AS fell_back_to_full_scan, CAST(0 AS BIGINT) AS failed_blocks FROM s""")
def path_recover_fast(spark, sf_dir):
    return _recovered(spark, sf_dir, recover.FAST, "sha256", (1, 2))


@query("path_copy_verified", f"""WITH {ONE} SELECT size AS bytes_copied, size AS source_bytes_hashed, (size + {BLOCK - 1}) // {BLOCK} AS verified_blocks, CAST(0 AS BIGINT) AS repaired_blocks, false AS used_recovery,
    'sha256' AS hash_type, true AS hashes_persisted, sha256(unhex(h)) AS digest, (size + {BLOCK - 1}) // {BLOCK} AS blocks_ok FROM one""")
def path_copy_verified(spark, sf_dir):
    with scratch(spark) as at:
        source, target = write_documents(spark, sf_dir, f"{at}/all"), f"{at}/target"
        r = api.copy_verified(spark, source, target, "sha256", BLOCK, save_hashes=True)
        ok = api.verify_file(spark, target).ok_blocks
        found = (r.bytes_copied, r.source_bytes_hashed, r.verified_blocks, r.repaired_blocks, r.used_recovery, r.hash_type, r.hashes_persisted, api.digest_file(spark, target, "sha256", BLOCK), ok)
    return rows(spark, "bytes_copied bigint, source_bytes_hashed bigint, verified_blocks bigint, repaired_blocks bigint, used_recovery boolean, hash_type string, hashes_persisted boolean, digest string, blocks_ok bigint", found)


@query("path_copy_changed", f"""WITH {CUT}, q AS (SELECT size, block_index, x <> y AS bad, block_index >= ((size + {BLOCK - 1}) // {BLOCK}) // 2 AS late FROM k WHERE c = 1)
    SELECT max(size) AS bytes_copied, count(*) FILTER (NOT late AND NOT bad) AS kept, count(*) FILTER (NOT late AND bad) AS replaced, count(*) FILTER (late) AS appended, (SELECT sha256(unhex(h)) FROM one) AS digest FROM q""")
def path_copy_changed(spark, sf_dir):
    with scratch(spark) as at:
        source, target = write_documents(spark, sf_dir, f"{at}/all"), f"{at}/target"
        half = api.open_file(spark, source, BLOCK).block_count() // 2 * BLOCK
        api.copy_range(spark, source, target, 0, 0, half, block_size=BLOCK)
        damage(spark, target, 1)
        n = api.copy_changed(spark, source, target, BLOCK)
        found = (n["bytes_copied"], n["kept"], n["replaced"], n["appended"], api.digest_file(spark, target, "sha256", BLOCK))
    return rows(spark, "bytes_copied bigint, kept bigint, replaced bigint, appended bigint, digest string", found)


@query("path_diff", f"""WITH {CUT} SELECT CAST(c AS INTEGER) AS copy_index, min(CASE WHEN x <> y THEN block_index * {BLOCK} + (SELECT min(i) FROM unnest(range(4)) AS t(i) WHERE substr(x, 2 * i + 1, 2) <> substr(y, 2 * i + 1, 2)) END) AS first_mismatch
    FROM k GROUP BY c""")
def path_diff(spark, sf_dir):
    found = []
    with scratch(spark) as at:
        source = write_documents(spark, sf_dir, f"{at}/all")
        for c in range(3):
            target = f"{at}/copy{c}"
            api.copy_file(spark, source, target)
            damage(spark, target, c)
            found.append((c, api.diff(spark, source, target, BLOCK)))
    return rows(spark, "copy_index int, first_mismatch bigint", *found)


@query("path_copy_range", f"""WITH {ONE} SELECT CAST(greatest(0, least(100000, size - 1000)) AS BIGINT) AS bytes_copied, sha256(unhex(repeat('00', 500) || substr(h, 2001, 200000))) AS ranged,
    size AS copied, sha256(unhex(h || substr('{'5A' * 64}', 1, 128))) AS kept_size, sha256(unhex(h)) AS via_memory FROM one""")
def path_copy_range(spark, sf_dir):
    with scratch(spark) as at:
        source = write_documents(spark, sf_dir, f"{at}/all")
        n = api.copy_range(spark, source, f"{at}/range", 1000, 500, 100_000, block_size=BLOCK)
        # A target that is longer keeps its own end.
        size = os.path.getsize(source)
        api.write_blocks(rows(spark, "offset bigint, data binary", (size, b"Z" * 64)), f"{at}/longer", size + 64)
        copied = api.copy_file(spark, source, f"{at}/longer", keep_target_size=True, block_size=BLOCK)
        api.copy_file_via_memory(spark, source, f"{at}/memory", block_size=BLOCK)
        digest = lambda name: api.digest_file(spark, f"{at}/{name}", "sha256", BLOCK)
        found = (n, digest("range"), copied, digest("longer"), digest("memory"))
    return rows(spark, "bytes_copied bigint, ranged string, copied bigint, kept_size string, via_memory string", found)


@query("path_writers", f"""WITH {ONE} SELECT size AS indexed_bytes, (SELECT count(*) FROM f) AS ranges, sha256(unhex(h)) AS indexed, sha256(unhex(h)) AS placed FROM one""")
def path_writers(spark, sf_dir):
    """The writer of indexed blocks, and that of offsets, where a later write wins."""
    files = documents(spark, sf_dir)
    first = files.agg(F.min("file_id")).first()[0] or 0
    with scratch(spark) as at:
        # The ids follow one another, so an id less the least is an index.
        writer = api.ParallelWriter.indexed(spark, f"{at}/indexed", files.count())
        writer.write_frame(files.select((F.col("file_id") - first).alias("index"), F.col("content").alias("data")))
        report = writer.finish()
        size = report.bytes_written
        writer = api.ParallelWriter.fixed_size(spark, f"{at}/placed", size)
        blocks = api.open_file(spark, f"{at}/indexed", BLOCK).blocks()
        writer.write_frame(blocks.select("offset", F.substring(F.lit(DAMAGE), F.lit(1), F.octet_length("data")).alias("data")))
        writer.write_frame(blocks.select("offset", "data"))
        writer.finish()
        found = (size, len(report.block_ranges), api.digest_file(spark, f"{at}/indexed", "sha256", BLOCK), api.digest_file(spark, f"{at}/placed", "sha256", BLOCK))
    return rows(spark, "indexed_bytes bigint, ranges bigint, indexed string, placed string", found)
