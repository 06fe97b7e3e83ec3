"""The engine's queries over the driver's tables, and their SQL.

Each row of ``documents`` or ``pages`` is one file. Damaged copies and
sidecars are derived by rule in both dialects: copy ``c`` of document ``d`` has
its block ``i`` damaged where ``(d + 3 * i + c) % 3 = 0``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import binary, digests
from ..operators import blocks, compare, containers, copying, election, lookup, manifests, recover, search, verify, writing
from . import copy_plan
from .registry import ORACLES, QUERIES, query, table

__all__ = ["ORACLES", "QUERIES"]

SMALL, LARGE = 1024, 4096
PATTERN = b"the "
DAMAGE = b"ZZZZ"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return blocks.files_of(table(spark, sf_dir, "documents"), "doc_id", "text")


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return blocks.files_of(table(spark, sf_dir, "pages"), "page_id", "html")


def damaged(content: Column, file_id: Column, copy: Column, block_size: int, modulus: int = 3) -> Column:
    """A copy's content: the first bytes of some blocks are overwritten."""
    size = F.octet_length(content)
    last = F.floor((size - 1) / block_size).cast("int")

    def block(i: Column) -> Column:
        data = F.substring(content, i * block_size + 1, block_size)
        bad = F.concat(F.substring(F.lit(DAMAGE), F.lit(1), F.octet_length(data)), F.substring(data, len(DAMAGE) + 1, block_size))
        return F.hex(F.when((file_id + 3 * i + copy) % modulus == 0, bad).otherwise(data))

    return F.when(size > 0, F.unhex(F.array_join(F.transform(F.sequence(F.lit(0), last), block), ""))).otherwise(content)


def copies(files: DataFrame, count: int, block_size: int = LARGE) -> DataFrame:
    """``file_id, copy_index, content``: damaged copies of every file."""
    rows = files.select("file_id", "content", F.explode(F.sequence(F.lit(0), F.lit(count - 1))).alias("copy_index"))
    return rows.select("file_id", "copy_index", damaged(F.col("content"), F.col("file_id"), F.col("copy_index"), block_size).alias("content"))


def sidecars(files: DataFrame, block_size: int = LARGE) -> DataFrame:
    """Three sidecars of each even file's true content; some hold a wrong first digest."""
    built = manifests.replicate(manifests.build(files.where("file_id % 2 = 0"), block_size))
    m = F.col("manifest")
    wrong = F.sha2(F.lit(b"x"), 256)
    hashes = F.when((F.col("file_id") + F.col("replica")) % 4 == 0, F.transform(m["block_hashes"], lambda h, i: F.when(i == 0, wrong).otherwise(h))).otherwise(m["block_hashes"])
    return built.withColumn("manifest", m.withField("block_hashes", hashes)).withColumn("copy_index", F.lit(0))


# --- SQL parts -------------------------------------------------------------

FILES = "f AS (SELECT doc_id AS file_id, hex(encode(coalesce(text, ''))) AS h, CAST(octet_length(encode(coalesce(text, ''))) AS BIGINT) AS size FROM documents)"


def cut(n: int, of: str = "f", name: str = "b") -> str:
    return f"{name} AS (SELECT file_id, size, i AS block_index, substr(h, i * {2 * n} + 1, {2 * n}) AS x FROM {of}, unnest(range((size + {n - 1}) // {n})) AS t(i))"


def copies_cut(count: int, n: int = LARGE) -> str:
    """``cb``: the blocks of damaged copies."""
    return f"""cb AS (SELECT file_id, size, copy_index, block_index,
      CASE WHEN (file_id + 3 * block_index + copy_index) % 3 = 0 THEN substr('5A5A5A5A', 1, least(8, length(x))) || substr(x, 9) ELSE x END AS x
      FROM b, unnest(range({count})) AS c(copy_index))"""


SIDECARS = """mb AS (SELECT file_id, replica, block_index, (file_id + replica) % 4 <> 0 AS intact,
      CASE WHEN (file_id + replica) % 4 = 0 AND block_index = 0 THEN sha256('x') ELSE sha256(unhex(x)) END AS hash
      FROM b, unnest(range(3)) AS r(replica) WHERE file_id % 2 = 0)"""


def election_sql(targets: str) -> str:
    """``d``: a decision for each (file, block) from ``w`` (file_id, block_index, src, hash, intact; src null for manifests)."""
    return f"""v AS (SELECT file_id, block_index, hash, count(*) AS tv, count(src) AS fv, count(*) - count(src) AS mv, min(src) AS first_copy,
        count(*) FILTER (src IS NULL AND intact) AS iv FROM w GROUP BY ALL),
    t AS (SELECT *, max(CASE WHEN fv >= 2 THEN tv END) OVER p AS ff, max(CASE WHEN fv >= 1 AND mv >= 1 THEN tv END) OVER p AS fm, max(CASE WHEN mv >= 2 THEN tv END) OVER p AS mm
        FROM v WINDOW p AS (PARTITION BY file_id, block_index)),
    u AS (SELECT file_id, block_index, count(*) FILTER (iv > 0) AS sound, min(hash) FILTER (iv > 0) AS sound_hash, min(first_copy) FILTER (iv > 0) AS sound_copy,
        CASE WHEN count(*) FILTER (fv >= 2 AND tv = ff) = 1 THEN min(hash) FILTER (fv >= 2 AND tv = ff) END AS ff_hash, min(first_copy) FILTER (fv >= 2 AND tv = ff) AS ff_copy,
        CASE WHEN count(*) FILTER (fv >= 1 AND mv >= 1 AND tv = fm) = 1 THEN min(hash) FILTER (fv >= 1 AND mv >= 1 AND tv = fm) END AS fm_hash, min(first_copy) FILTER (fv >= 1 AND mv >= 1 AND tv = fm) AS fm_copy,
        CASE WHEN count(*) FILTER (mv >= 2 AND tv = mm) = 1 THEN min(hash) FILTER (mv >= 2 AND tv = mm) END AS mm_hash
        FROM t GROUP BY ALL),
    o AS (SELECT *, CASE WHEN sound > 1 OR (sound = 1 AND ff_hash <> sound_hash) THEN 'conflict' WHEN sound = 1 THEN 'sound' WHEN ff_hash IS NOT NULL THEN 'ff'
        WHEN fm_hash IS NOT NULL THEN 'fm' WHEN mm_hash IS NOT NULL THEN 'mm' ELSE 'none' END AS how FROM u),
    d AS (SELECT {targets} file_id, block_index,
        CASE how WHEN 'sound' THEN sound_hash WHEN 'ff' THEN ff_hash WHEN 'fm' THEN fm_hash WHEN 'mm' THEN mm_hash END AS elected_hash,
        CAST(CASE how WHEN 'sound' THEN sound_copy WHEN 'ff' THEN ff_copy WHEN 'fm' THEN fm_copy END AS INTEGER) AS repair_source_index,
        CASE WHEN how = 'sound' AND sound_copy IS NOT NULL THEN 'IntactHash' WHEN how = 'ff' THEN 'FileAndFileAgreement' WHEN how = 'fm' THEN 'FileAndManifestAgreement' END AS basis,
        CASE WHEN how = 'conflict' THEN 'ConflictingIntactHashes' WHEN how = 'sound' AND sound_copy IS NULL THEN 'IntactHashWithoutMatchingBlock' WHEN how = 'mm' THEN 'ManifestOnlyAgreement' WHEN how = 'none' THEN 'NoBlockHashFound' END AS failure
        FROM o)"""


def witnesses_sql(count: int) -> str:
    return f"""{FILES}, {cut(LARGE)}, {copies_cut(count)}, {SIDECARS},
    ch AS (SELECT file_id, size, copy_index, block_index, sha256(unhex(x)) AS hash FROM cb),
    w AS (SELECT file_id, block_index, copy_index AS src, hash, NULL::BOOLEAN AS intact FROM ch UNION ALL SELECT file_id, block_index, NULL, hash, intact FROM mb)"""


# --- scans ------------------------------------------------------------------


@query("scan_block_stats", f"""WITH {FILES} SELECT file_id, size AS file_size, (size + 1023) // 1024 AS blocks,
    CAST(CASE WHEN size > 0 THEN (size - 1) % 1024 + 1 ELSE 0 END AS BIGINT) AS last_len FROM f""")
def scan_block_stats(spark, sf_dir):
    return blocks.scan_stats(documents(spark, sf_dir), SMALL)


@query("map_blocks_ordered", f"WITH {FILES}, {cut(SMALL)} SELECT file_id, block_index, block_index * 1024 AS \"offset\", CAST(length(x) // 2 AS BIGINT) AS value FROM b")
def map_blocks_ordered(spark, sf_dir):
    return blocks.map_blocks(blocks.split(documents(spark, sf_dir), SMALL), F.octet_length("data").cast("bigint"))


@query("map_blocks_complete", f"WITH {FILES} SELECT file_id, true AS complete FROM f")
def map_blocks_complete(spark, sf_dir):
    files = documents(spark, sf_dir)
    return blocks.complete(blocks.split(files, SMALL), blocks.scan_stats(files, SMALL))


@query("read_range", f"WITH {FILES} SELECT file_id, CASE WHEN size >= 301 THEN lower(substr(h, 401, 202)) END AS data FROM f")
def read_range(spark, sf_dir):
    return blocks.read_range(documents(spark, sf_dir), 200, 101).withColumn("data", F.lower(F.hex("data")))


@query("read_block", f"WITH {FILES}, {cut(SMALL)} SELECT file_id, lower(x) AS data FROM b WHERE block_index = 2")
def read_block(spark, sf_dir):
    return blocks.split(documents(spark, sf_dir), SMALL).where("block_index = 2").select("file_id", F.lower(F.hex("data")).alias("data"))


# --- digests and manifests ---------------------------------------------------


@query("hash_manifest_sha256", f"""WITH {FILES}, {cut(SMALL)},
    g AS (SELECT file_id, count(*) AS n, string_agg(sha256(unhex(x)), '' ORDER BY block_index) AS hs FROM b GROUP BY file_id)
    SELECT f.file_id, f.size AS file_size, CAST(coalesce(n, 0) AS BIGINT) AS blocks, f.size AS bytes_hashed, sha256(unhex(coalesce(hs, ''))) AS hash_of_hashes
    FROM f LEFT JOIN g USING (file_id)""")
def hash_manifest_sha256(spark, sf_dir):
    m = F.col("manifest")
    built = manifests.build(documents(spark, sf_dir), SMALL, "sha256", SMALL)
    return built.select("file_id", m["file_size"].alias("file_size"), F.size(m["block_hashes"]).cast("bigint").alias("blocks"), m["bytes_hashed"].alias("bytes_hashed"), m["hash_of_hashes"].alias("hash_of_hashes"))


@query("hash_manifest_from_blocks", f"""WITH {FILES}, {cut(SMALL)}
    SELECT file_id, count(*) AS blocks, sha256(unhex(string_agg(sha256(unhex(x)), '' ORDER BY block_index))) AS hash_of_hashes FROM b GROUP BY file_id""")
def hash_manifest_from_blocks(spark, sf_dir):
    rows = blocks.split(documents(spark, sf_dir), SMALL).select("file_id", "block_index", "file_size", F.sha2("data", 256).alias("hash"))
    m = F.col("manifest")
    return manifests.build_from_blocks(rows, SMALL).select("file_id", F.size(m["block_hashes"]).cast("bigint").alias("blocks"), m["hash_of_hashes"].alias("hash_of_hashes"))


@query("hash_manifest_xxh3")
def hash_manifest_xxh3(spark, sf_dir):
    m = F.col("manifest")
    built = manifests.build(documents(spark, sf_dir), SMALL, "xxh3", SMALL)
    return built.select("file_id", m["file_size"].alias("file_size"), F.size(m["block_hashes"]).cast("bigint").alias("blocks"), m["hash_of_hashes"].alias("hash_of_hashes"))


@query("hash_file_sha256", "SELECT page_id AS file_id, sha256(encode(coalesce(html, ''))) AS digest FROM pages")
def hash_file_sha256(spark, sf_dir):
    return pages(spark, sf_dir).select("file_id", F.sha2("content", 256).alias("digest"))


@query("hash_file_blake3")
def hash_file_blake3(spark, sf_dir):
    return pages(spark, sf_dir).select("file_id", digests.blake3("content").alias("digest"))


def _faulty(files: DataFrame) -> DataFrame:
    """Manifests with one of seven faults each, or none, by the file's number."""
    m, kind = F.col("manifest"), F.col("file_id") % 8
    hashes = m["block_hashes"]
    wrong = (
        m.withField("bytes_hashed", F.when(kind == 1, m["bytes_hashed"] + 1).otherwise(m["bytes_hashed"]))
        .withField("block_size", F.when(kind == 2, F.lit(1000).cast("bigint")).otherwise(m["block_size"]))
        .withField("hash_of_hashes", F.when(kind == 3, F.substring(m["hash_of_hashes"], 1, 16)).when(kind == 4, F.sha2(F.lit(b"y"), 256)).otherwise(m["hash_of_hashes"]))
        .withField("block_hashes", F.when(kind == 5, F.concat(hashes, F.array(F.sha2(F.lit(b"z"), 256)))).when(kind == 6, F.transform(hashes, lambda h: F.substring(h, 1, 62))).otherwise(hashes))
        .withField("hash_type", F.when(kind == 7, F.lit("xxh3")).otherwise(m["hash_type"]))
    )
    return manifests.build(files, LARGE).withColumn("manifest", wrong)


@query("manifest_integrity", "SELECT doc_id AS file_id, doc_id % 8 = 0 OR (doc_id % 8 = 6 AND coalesce(text, '') = '') AS intact FROM documents")
def manifest_integrity(spark, sf_dir):
    return _faulty(documents(spark, sf_dir)).select("file_id", manifests.intact_sha256(F.col("manifest")).alias("intact"))


@query("manifest_geometry", f"""WITH {FILES} SELECT file_id, CAST(3 AS BIGINT) AS loaded, file_id % 3 <> 0 AS agree,
    CASE WHEN file_id % 3 <> 0 THEN size END AS file_size, CASE WHEN file_id % 3 <> 0 THEN CAST(4096 AS BIGINT) END AS block_size,
    CASE WHEN file_id % 3 <> 0 THEN (size + 4095) // 4096 END AS blocks, CASE WHEN file_id % 3 <> 0 THEN 'sha256' END AS hash_type FROM f""")
def manifest_geometry(spark, sf_dir):
    built = manifests.replicate(manifests.build(documents(spark, sf_dir), LARGE))
    m = F.col("manifest")
    odd = (F.col("file_id") % 3 == 0) & (F.col("replica") == 1)
    return manifests.geometry(built.withColumn("manifest", m.withField("file_size", F.when(odd, m["file_size"] + 1).otherwise(m["file_size"]))))


@query("manifest_agreement", f"""WITH {FILES}, {cut(LARGE)}, {SIDECARS}, s AS (SELECT DISTINCT file_id, replica, intact OR size = 0 AS intact FROM f JOIN (SELECT unnest(range(3)) AS replica) ON true
      JOIN LATERAL (SELECT (file_id + replica) % 4 <> 0 AS intact) ON true WHERE file_id % 2 = 0)
    SELECT file_id, CAST(count(intact) AS INTEGER) AS loaded, CAST(count(*) FILTER (intact) AS INTEGER) AS sound, count(*) FILTER (intact) > 0 AS agreed, count(*) FILTER (intact) = 3 AS healthy FROM f LEFT JOIN s USING (file_id) GROUP BY file_id""")
def manifest_agreement(spark, sf_dir):
    files = documents(spark, sf_dir)
    current = manifests.build(files, LARGE)
    known = manifests.summary(sidecars(files))
    number = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return current.join(known, "file_id", "left").select("file_id", number("loaded"), number("sound"), F.col("agreed").isNotNull().alias("agreed"), manifests.healthy(F.col("manifest"), F.col("all")).alias("healthy"))


@query("manifest_mismatched_blocks", f"""WITH {FILES}, {cut(LARGE)} SELECT file_id, block_index FROM b
    WHERE (file_id + 3 * block_index + 1) % 3 = 0 AND substr(x, 1, 8) <> substr('5A5A5A5A', 1, length(x))""")
def manifest_mismatched_blocks(spark, sf_dir):
    files = documents(spark, sf_dir)
    other = files.withColumn("content", damaged(F.col("content"), F.col("file_id"), F.lit(1), LARGE))
    return manifests.mismatched(manifests.build(files, LARGE), manifests.build(other, LARGE))


# --- verify, election, recovery ------------------------------------------------

_VERIFY = f"""{witnesses_sql(1)}, {election_sql('')},
    a AS (SELECT file_id, block_index, min(hash) FILTER (intact) AS agreed FROM mb GROUP BY ALL),
    k AS (SELECT c.file_id, c.block_index, c.hash AS current_hash, coalesce(a.agreed = c.hash, false) AS fine, d.elected_hash, d.repair_source_index, d.basis, d.failure
          FROM ch c LEFT JOIN a USING (file_id, block_index) JOIN d USING (file_id, block_index))"""


@query("verify_blocks", f"""WITH {_VERIFY} SELECT file_id, block_index, current_hash, fine OR coalesce(elected_hash = current_hash AND repair_source_index = 0, false) AS block_ok,
    CASE WHEN NOT fine THEN elected_hash END AS elected_hash, CASE WHEN NOT fine THEN repair_source_index END AS repair_source_index,
    CASE WHEN NOT fine THEN basis END AS basis, CASE WHEN NOT fine THEN failure END AS failure FROM k""")
def verify_blocks(spark, sf_dir):
    files = documents(spark, sf_dir)
    current = manifests.build(copies(files, 1), LARGE)
    return verify.verify_blocks(current, sidecars(files)).drop("votes")


@query("verify_report", f"""WITH {_VERIFY}, r AS (SELECT file_id, count(*) FILTER (fine OR coalesce(elected_hash = current_hash AND repair_source_index = 0, false)) AS ok FROM k GROUP BY file_id)
    SELECT f.file_id, size AS bytes_hashed, (size + 4095) // 4096 AS total_blocks, CAST(CASE WHEN f.file_id % 2 = 0 THEN 3 ELSE 0 END AS BIGINT) AS loaded_manifests,
    CAST(coalesce(ok, 0) AS BIGINT) AS ok_blocks, CAST((size + 4095) // 4096 - coalesce(ok, 0) AS BIGINT) AS bad_blocks, CASE WHEN f.file_id % 2 = 0 THEN true END AS size_matches FROM f LEFT JOIN r USING (file_id)""")
def verify_report(spark, sf_dir):
    files = documents(spark, sf_dir)
    return verify.verify_report(manifests.build(copies(files, 1), LARGE), sidecars(files))


def _seen(spark, sf_dir, count: int) -> DataFrame:
    files = documents(spark, sf_dir)
    made = copies(files, count)
    size = blocks.size_of()
    hashed = made.select("file_id", "copy_index", digests.block_hashes(F.col("content"), size, LARGE, "sha256").alias("hashes"))
    return election.witnesses(hashed, sidecars(files), manifests.intact_sha256(F.col("manifest")))


@query("vote_tally", f"""WITH {witnesses_sql(3)} SELECT file_id, block_index, hash, count(*) AS total_votes, count(src) AS file_copy_votes, count(*) - count(src) AS hash_replica_votes,
    CAST(row_number() OVER (PARTITION BY file_id, block_index ORDER BY count(*) DESC, count(src) DESC, hash) - 1 AS INTEGER) AS place FROM w GROUP BY file_id, block_index, hash""")
def vote_tally(spark, sf_dir):
    votes = _seen(spark, sf_dir, 3).select("file_id", "block_index", F.posexplode(election.tally(F.col("files"), F.col("manifests"))).alias("place", "v"))
    return votes.select("file_id", "block_index", "v.hash", "v.total_votes", "v.file_copy_votes", "v.hash_replica_votes", "place")


@query("election_decisions", f"""WITH {witnesses_sql(4)}, {election_sql('')} SELECT *, CASE basis WHEN 'IntactHash' THEN 'recovered block based on intact hash' WHEN 'FileAndFileAgreement' THEN 'recovered block based on file+file agreement'
    WHEN 'FileAndManifestAgreement' THEN 'recovered block based on file+manifest agreement' ELSE 'failed to recover corrupt block [' || CASE failure WHEN 'NoBlockHashFound' THEN 'no block hash found either'
    WHEN 'ManifestOnlyAgreement' THEN 'manifest+manifest hashes agree' WHEN 'ConflictingIntactHashes' THEN 'conflicting intact hashes' ELSE 'intact hash found but no matching file block' END || ']' END AS status FROM d""")
def election_decisions(spark, sf_dir):
    judged = election.decide(_seen(spark, sf_dir, 4))
    return judged.select("file_id", "block_index", "elected_hash", "repair_source_index", "basis", "failure", election.status_message(F.col("basis"), F.col("failure")).alias("status"))


def _recover_sql(count: int, everyone: bool) -> str:
    where = "" if everyone else "WHERE copy_index = 0"
    return f"""{witnesses_sql(count)}, {election_sql('')},
    s AS (SELECT c.file_id, c.size, c.copy_index, c.block_index, c.hash, d.elected_hash,
            CASE WHEN d.elected_hash = c.hash THEN 'fine' WHEN d.repair_source_index <> c.copy_index THEN 'repaired' ELSE 'failed' END AS state
          FROM (SELECT * FROM ch {where}) c JOIN d USING (file_id, block_index)),
    p AS (SELECT file_id, copy_index, count(*) FILTER (state = 'repaired') AS repaired, count(*) FILTER (state = 'failed') AS failed,
            string_agg(CASE WHEN state = 'repaired' THEN elected_hash ELSE hash END, '' ORDER BY block_index) AS after FROM s GROUP BY ALL),
    truth AS (SELECT file_id, string_agg(sha256(unhex(x)), '' ORDER BY block_index) AS hs FROM b GROUP BY file_id),
    g AS (SELECT file_id, copy_index, repaired, failed,
            failed = 0 AND NOT (copy_index = 0 AND file_id % 2 = 0 AND sound = 3 AND after = hs) AS refresh
          FROM p JOIN truth USING (file_id) JOIN LATERAL (SELECT count(*) FILTER ((file_id + r) % 4 <> 0) AS sound FROM unnest(range(3)) AS q(r)) ON true),
    rep AS (SELECT file_id, sum(repaired) AS repaired, count(*) FILTER (repaired > 0) AS files, count(*) FILTER (refresh) AS refreshed, sum(failed) AS failed FROM g GROUP BY file_id)"""


def _report_sql(count: int, everyone: bool) -> str:
    empty_refresh = count if everyone else 1
    return f"""WITH {_recover_sql(count, everyone)} SELECT f.file_id, size * {count} AS bytes_hashed, CAST(coalesce(repaired, 0) AS BIGINT) AS repaired_blocks, CAST(coalesce(files, 0) AS BIGINT) AS repaired_files,
    CAST(coalesce(refreshed, {empty_refresh}) AS BIGINT) AS sidecars_refreshed, CAST(coalesce(failed, 0) AS BIGINT) AS failed_blocks, false AS used_fast_path, false AS fell_back_to_full_scan FROM f LEFT JOIN rep USING (file_id)"""


@query("recover_standard", _report_sql(3, False))
def recover_standard(spark, sf_dir):
    files = documents(spark, sf_dir)
    return recover.recover_report(copies(files, 3), sidecars(files), LARGE)


@query("recover_in_place_all", _report_sql(4, True))
def recover_in_place_all(spark, sf_dir):
    files = documents(spark, sf_dir)
    return recover.recover_report(copies(files, 4), sidecars(files), LARGE, recover.IN_PLACE_ALL)


@query("recover_fast", f"""WITH {_recover_sql(3, False)},
    z AS (SELECT file_id, bool_and(x = y) AS clean FROM (SELECT c.file_id, c.x, b.x AS y FROM cb c JOIN b USING (file_id, block_index) WHERE copy_index = 0) GROUP BY file_id),
    n AS (SELECT f.file_id, size, f.file_id % 2 = 0 AND coalesce(clean, true) AS fast FROM f LEFT JOIN z USING (file_id))
    SELECT n.file_id, CASE WHEN fast THEN size ELSE size * 3 END AS bytes_hashed, CAST(CASE WHEN fast THEN 0 ELSE coalesce(repaired, 0) END AS BIGINT) AS repaired_blocks,
    CAST(CASE WHEN fast THEN 0 ELSE coalesce(files, 0) END AS BIGINT) AS repaired_files,
    CAST(CASE WHEN fast THEN CASE WHEN (n.file_id % 4) = 2 AND (n.file_id + 2) % 4 <> 0 THEN 0 WHEN n.file_id % 4 = 0 OR (n.file_id + 2) % 4 = 0 THEN 1 ELSE 0 END ELSE coalesce(refreshed, 1) END AS BIGINT) AS sidecars_refreshed,
    CAST(CASE WHEN fast THEN 0 ELSE coalesce(failed, 0) END AS BIGINT) AS failed_blocks, fast AS used_fast_path, NOT fast AS fell_back_to_full_scan FROM n LEFT JOIN rep USING (file_id)""")
def recover_fast(spark, sf_dir):
    files = documents(spark, sf_dir)
    return recover.recover_report(copies(files, 3), sidecars(files), LARGE, recover.FAST)


def _content_sql(count: int, everyone: bool) -> str:
    where = "" if everyone else "WHERE copy_index = 0"
    return f"""WITH {witnesses_sql(count)}, {election_sql('')},
    n AS (SELECT c.file_id, c.copy_index, c.block_index, CASE WHEN d.elected_hash = c.hash THEN c.x WHEN d.repair_source_index <> c.copy_index THEN s.x ELSE c.x END AS x
      FROM (SELECT cb.*, ch.hash FROM cb JOIN ch USING (file_id, copy_index, block_index) {where}) c JOIN d USING (file_id, block_index)
      LEFT JOIN cb s ON s.file_id = c.file_id AND s.block_index = c.block_index AND s.copy_index = d.repair_source_index)
    SELECT file_id, CAST(copy_index AS INTEGER) AS copy_index, sha256(unhex(string_agg(x, '' ORDER BY block_index))) AS digest FROM n GROUP BY file_id, copy_index"""


def _recovered(spark, sf_dir, count: int, mode: str) -> DataFrame:
    files = documents(spark, sf_dir)
    made = copies(files, count)
    judged = recover.decisions(made, sidecars(files), LARGE, mode)
    return recover.repaired_content(made, judged, LARGE).select("file_id", "copy_index", F.sha2("content", 256).alias("digest"))


@query("recover_content", _content_sql(3, False))
def recover_content(spark, sf_dir):
    return _recovered(spark, sf_dir, 3, recover.STANDARD)


@query("recover_content_in_place_all", _content_sql(4, True))
def recover_content_in_place_all(spark, sf_dir):
    return _recovered(spark, sf_dir, 4, recover.IN_PLACE_ALL)


@query("recover_many_copies")
def recover_many_copies(spark, sf_dir):
    files = documents(spark, sf_dir)
    judged = recover.decisions(copies(files, 5), sidecars(files), LARGE, recover.IN_PLACE_ALL)
    return judged.select("file_id", "block_index", "copy_index", "elected_hash", "state")


# --- comparison ------------------------------------------------------------------


def _damaged_copy(files: DataFrame, copy: int, block_size: int = SMALL, modulus: int = 7) -> DataFrame:
    return files.withColumn("content", damaged(F.col("content"), F.col("file_id"), F.lit(copy), block_size, modulus))


_DIFFER = f"""{FILES}, {cut(SMALL)}, y AS (SELECT *, CASE WHEN (file_id + 3 * block_index + 1) % 7 = 0 THEN substr('5A5A5A5A', 1, least(8, length(x))) || substr(x, 9) ELSE x END AS y FROM b)"""


@query("diff_first_mismatch", f"""WITH {_DIFFER}, q AS (SELECT file_id, block_index * 1024 + (SELECT min(i) FROM unnest(range(length(x) // 2)) AS t(i) WHERE substr(x, 2 * i + 1, 2) <> substr(y, 2 * i + 1, 2)) AS place
      FROM y WHERE x <> y)
    SELECT f.file_id, true AS sizes_equal, min(place) AS first_mismatch FROM f LEFT JOIN q USING (file_id) GROUP BY f.file_id""")
def diff_first_mismatch(spark, sf_dir):
    files = documents(spark, sf_dir)
    return compare.diff(files, _damaged_copy(files, 1), SMALL)


@query("diff_changed_blocks", f"WITH {_DIFFER} SELECT file_id, block_index FROM y WHERE x <> y")
def diff_changed_blocks(spark, sf_dir):
    files = documents(spark, sf_dir)
    return compare.changed_blocks(files, _damaged_copy(files, 1), SMALL)


def _older(files: DataFrame) -> DataFrame:
    """Targets of a delta copy: a damaged copy, cut to three quarters."""
    content = _damaged_copy(files, 1)
    return content.withColumn("content", F.substring("content", F.lit(1), (F.octet_length("content") * 3 / 4).cast("int")))


_DELTA = f"""{_DIFFER}, t AS (SELECT file_id, block_index, size, x, substr(y, 1, greatest(0, 2 * (size * 3 // 4 - block_index * 1024))) AS y FROM y),
    e AS (SELECT file_id, block_index, x, CASE WHEN y = '' THEN 'append' WHEN x = y THEN 'keep' ELSE 'replace' END AS action FROM t)"""


@query("delta_copy_result", f"WITH {_DELTA} SELECT file_id, block_index, action, sha256(unhex(x)) AS digest FROM e")
def delta_copy_result(spark, sf_dir):
    files = documents(spark, sf_dir)
    result, _ = compare.delta_copy(files, _older(files), SMALL)
    return result.select("file_id", "block_index", "action", F.sha2("data", 256).alias("digest"))


@query("delta_copy_stats", f"""WITH {_DELTA}, s AS (SELECT file_id, count(*) FILTER (action = 'keep') AS kept, count(*) FILTER (action = 'replace') AS replaced, count(*) FILTER (action = 'append') AS appended,
      sum(CASE WHEN action <> 'keep' THEN length(x) // 2 ELSE 0 END) AS bytes_written FROM e GROUP BY file_id)
    SELECT f.file_id, size AS bytes_copied, CAST(coalesce(kept, 0) AS BIGINT) AS kept, CAST(coalesce(replaced, 0) AS BIGINT) AS replaced, CAST(coalesce(appended, 0) AS BIGINT) AS appended,
    CAST(coalesce(bytes_written, 0) AS BIGINT) AS bytes_written FROM f LEFT JOIN s USING (file_id)""")
def delta_copy_stats(spark, sf_dir):
    files = documents(spark, sf_dir)
    return compare.delta_copy(files, _older(files), SMALL)[1]


# --- search ------------------------------------------------------------------------


def _grep_sql(rows: str) -> str:
    """Left-to-right matches of the pattern in hexadecimal ``x``, byte by byte."""
    return f"""tok AS (SELECT *, string_split(regexp_replace(x, '(..)', '\\1 ', 'g'), '74 68 65 20 ') AS parts FROM {rows}),
    hit AS (SELECT * EXCLUDE (parts), unnest(list_transform(range(1, len(parts)), lambda k: list_sum(list_transform(parts[1:k], lambda p: length(p) // 3)) + 4 * (k - 1))) AS place FROM tok WHERE len(parts) > 1)"""


@query("grep_offsets", f"WITH {FILES}, w AS (SELECT file_id, h AS x FROM f), {_grep_sql('w')} SELECT file_id, CAST(place AS BIGINT) AS \"offset\" FROM hit")
def grep_offsets(spark, sf_dir):
    return search.grep(documents(spark, sf_dir), PATTERN)


@query("grep_blockwise", f"""WITH {FILES}, {cut(SMALL)},
    e AS (SELECT file_id, block_index, block_index * 1024 AS base, x, 0 AS seam FROM b
      UNION ALL
      SELECT * FROM (SELECT file_id, block_index, block_index * 1024 + length(x) // 2 - least(3, length(x) // 2) AS base,
        substr(x, greatest(1, length(x) - 5)) || substr(lead(x) OVER (PARTITION BY file_id ORDER BY block_index), 1, 6) AS x, least(3, length(x) // 2) AS seam FROM b) WHERE x IS NOT NULL),
    {_grep_sql('e')} SELECT DISTINCT file_id, CAST(base + place AS BIGINT) AS "offset" FROM hit WHERE seam = 0 OR (place < seam AND place + 4 > seam)""")
def grep_blockwise(spark, sf_dir):
    return search.grep_blocks(blocks.split(documents(spark, sf_dir), SMALL), PATTERN)


@query("grep_pages", f"""WITH w AS (SELECT page_id AS file_id, hex(encode(coalesce(html, ''))) AS x FROM pages), {_grep_sql('w')} SELECT file_id, count(*) AS matches FROM hit GROUP BY file_id""")
def grep_pages(spark, sf_dir):
    return search.grep(pages(spark, sf_dir), PATTERN).groupBy("file_id").agg(F.count("*").alias("matches"))


# --- writers ------------------------------------------------------------------------


@query("append_ranges", """SELECT source, doc_id, CAST(coalesce(sum(octet_length(encode(text))) OVER (PARTITION BY source ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS "offset",
    CAST(octet_length(encode(text)) AS BIGINT) AS len FROM documents""")
def append_ranges(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select("source", "doc_id", F.col("text").cast("binary").alias("data"))
    return writing.append_ranges(rows, "source", "doc_id").drop("data")


@query("indexed_writer_ranges", f"""WITH {FILES}, {cut(SMALL)} SELECT file_id, block_index, CAST(block_index * 1024 AS BIGINT) AS "offset", CAST(length(x) // 2 AS BIGINT) AS len FROM b""")
def indexed_writer_ranges(spark, sf_dir):
    files = documents(spark, sf_dir)
    expected = files.select("file_id", F.ceil(blocks.size_of() / SMALL).alias("block_count"))
    writes = blocks.split(files, SMALL).select("file_id", "block_index", "data")
    return writing.indexed(writes, "file_id", "block_index", expected).select("file_id", "block_index", "offset", "len")


@query("indexed_writer_faults", """SELECT conv_id, CAST(count(*) FILTER (turn >= 2) AS BIGINT) AS out_of_range, CAST(count(turn) - count(DISTINCT turn) AS BIGINT) AS duplicates,
    CAST(2 - count(DISTINCT CASE WHEN turn < 2 THEN turn END) AS BIGINT) AS missing FROM conversations GROUP BY conv_id""")
def indexed_writer_faults(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations")
    expected = rows.select("conv_id").distinct().withColumn("block_count", F.lit(2).cast("bigint"))
    return writing.index_faults(rows, "conv_id", "turn", expected)


@query("offset_writer_image", """WITH w AS (SELECT user_id, event_id AS seq, event_id * 37 % 200 AS lo, hex(encode(event_type)) AS x FROM events),
    n AS (SELECT user_id, seq, lo, x, i, lo + i AS pos FROM w, unnest(range(length(x) // 2)) AS t(i)),
    k AS (SELECT user_id, pos, arg_max(substr(x, 2 * i + 1, 2), seq) AS byte FROM n GROUP BY ALL),
    u AS (SELECT DISTINCT user_id FROM events),
    g AS (SELECT u.user_id, p.pos, coalesce(k.byte, '00') AS byte FROM u, unnest(range(256)) AS p(pos) LEFT JOIN k ON k.user_id = u.user_id AND k.pos = p.pos),
    s AS (SELECT user_id, CAST(sum(length(x) // 2) AS BIGINT) AS bytes_written, CAST(max(lo + length(x) // 2) AS BIGINT) AS extent FROM w GROUP BY user_id)
    SELECT g.user_id, lower(string_agg(byte, '' ORDER BY pos)) AS content, any_value(bytes_written) AS bytes_written, any_value(extent) AS extent FROM g JOIN s USING (user_id) GROUP BY g.user_id""")
def offset_writer_image(spark, sf_dir):
    events = table(spark, sf_dir, "events").select("user_id", F.col("event_id").alias("seq"), (F.col("event_id") * 37 % 200).alias("offset"), F.col("event_type").cast("binary").alias("data"))
    sizes = events.select("user_id").distinct().withColumn("total_size", F.lit(256).cast("bigint"))
    return writing.offset_image(events, "user_id", "seq", sizes).withColumn("content", F.lower(F.hex("content")))


# --- copies ---------------------------------------------------------------------------


@query("range_copy", f"""WITH {FILES} SELECT file_id, CAST(greatest(0, least(700, size - 100)) AS BIGINT) AS bytes_copied,
    sha256(unhex(repeat('00', 50) || substr(h, 201, 1400))) AS digest FROM f""")
def range_copy(spark, sf_dir):
    return copying.range_copy(documents(spark, sf_dir), 100, 50, 700).select("file_id", "bytes_copied", F.sha2("content", 256).alias("digest"))


@query("dd_copy", f"""WITH {FILES} SELECT file_id, CAST(greatest(0, least(512, size - 256)) AS BIGINT) AS bytes_copied,
    CAST(greatest(0, least(512, size - 256)) // 128 AS BIGINT) AS full_records, CAST(CASE WHEN greatest(0, least(512, size - 256)) % 128 <> 0 THEN 1 ELSE 0 END AS BIGINT) AS partial_records,
    sha256(unhex(rpad(substr(h, 1, 256), 256, '0') || substr(h, 513, 1024) || substr(h, 257 + 2 * CAST(greatest(0, least(512, size - 256)) AS BIGINT)))) AS digest FROM f""")
def dd_copy(spark, sf_dir):
    files = documents(spark, sf_dir).withColumn("old", F.col("content"))
    return copying.dd(files, 128, 4, 2, 1, notrunc=True, target="old").select("file_id", "bytes_copied", "full_records", "partial_records", F.sha2("content", 256).alias("digest"))


@query("dd_records", f"WITH {FILES} SELECT file_id, size AS bytes_copied, size // 512 AS full_records, CAST(CASE WHEN size % 512 <> 0 THEN 1 ELSE 0 END AS BIGINT) AS partial_records FROM f")
def dd_records(spark, sf_dir):
    return copying.dd(documents(spark, sf_dir)).drop("content")


@query("keep_target_size", """SELECT doc_id AS file_id, sha256(encode(coalesce(text, '') || CASE WHEN octet_length(encode(coalesce(text, ''))) < 400
    THEN repeat('0123456789', 40)[octet_length(encode(coalesce(text, ''))) + 1:] ELSE '' END)) AS digest FROM documents""")
def keep_target_size(spark, sf_dir):
    rows = documents(spark, sf_dir)
    return rows.select("file_id", F.sha2(copying.keep_target_size(F.col("content"), F.lit(b"0123456789" * 40)), 256).alias("digest"))


@query("copy_verified_report", f"""WITH {FILES}, {cut(LARGE)}, q AS (SELECT file_id, count(*) FILTER ((file_id + 3 * block_index + 1) % 7 = 0 AND substr(x, 1, 8) <> substr('5A5A5A5A', 1, length(x))) AS bad FROM b GROUP BY file_id)
    SELECT f.file_id, size AS bytes_copied, size AS source_bytes_hashed, (size + 4095) // 4096 AS verified_blocks, CAST(coalesce(bad, 0) AS BIGINT) AS repaired_blocks, coalesce(bad, 0) > 0 AS used_recovery FROM f LEFT JOIN q USING (file_id)""")
def copy_verified_report(spark, sf_dir):
    files = documents(spark, sf_dir)
    return copying.copy_verified(files, _damaged_copy(files, 1, LARGE), LARGE)


# --- folds and containers ------------------------------------------------------------------


@query("fold_digest_summary", f"""WITH {FILES}, {cut(SMALL)}, d AS (SELECT file_id, CAST(7 * ((size + 1023) // 1024 - 1 - block_index) % 64 AS INTEGER) AS turn, sha256(unhex(x)) AS s FROM b),
    n AS (SELECT file_id, CAST(pow(2, turn) AS HUGEINT) AS up, CAST(pow(2, 64 - turn) AS HUGEINT) AS down,
        CAST(CAST('0x' || substr(s, 15, 2) || substr(s, 13, 2) || substr(s, 11, 2) || substr(s, 9, 2) || substr(s, 7, 2) || substr(s, 5, 2) || substr(s, 3, 2) || substr(s, 1, 2) AS UBIGINT) AS HUGEINT) AS v FROM d),
    g AS (SELECT file_id, bit_xor(CAST((v % down) * up + v // down AS UBIGINT)) AS acc FROM n GROUP BY file_id)
    SELECT f.file_id, printf('%016x', coalesce(acc, CAST(0 AS UBIGINT))) AS summary FROM f LEFT JOIN g USING (file_id)""")
def fold_digest_summary(spark, sf_dir):
    built = manifests.build(documents(spark, sf_dir), SMALL, "sha256", SMALL)
    return built.select("file_id", digests.digest_summary(F.col("manifest.block_hashes")).alias("summary"))


@query("page_checksum", f"""WITH {FILES}, k AS (SELECT file_id, list_transform(range((size + 4095) // 4096), lambda i: CAST(('0x' || substr(h, i * 8192 + 1, 2)) AS HUGEINT)) AS v FROM f)
    SELECT file_id, printf('%016x', CAST(CASE WHEN len(v) = 0 THEN 0 ELSE list_reduce(v, lambda a, b: (a * 131 + b) % 18446744073709551616) END AS UBIGINT)) AS checksum FROM k""")
def page_checksum(spark, sf_dir):
    return documents(spark, sf_dir).select("file_id", digests.checksum("content").alias("checksum"))


@query("zstd_roundtrip", f"WITH {FILES} SELECT file_id, CAST(1024 AS BIGINT) AS block_size, size AS original_size, (size + 1023) // 1024 AS blocks, sha256(unhex(h)) AS digest FROM f")
def zstd_roundtrip(spark, sf_dir):
    packed = documents(spark, sf_dir).select("file_id", containers.compressed(SMALL)("content").alias("container"))
    read = packed.select("file_id", containers.described("container").alias("m"), F.sha2(containers.decompressed("container"), 256).alias("digest"))
    return read.select("file_id", "m.block_size", "m.original_size", "m.blocks", "digest")


# --- look-ups and scalars ---------------------------------------------------------------------

MOUNTS = ["/", "/de", "/en", "/en/1", "/en/12", "/es", "/fr/2"]


@query("longest_mount_prefix", """WITH m AS (SELECT unnest(['/', '/de', '/en', '/en/1', '/en/12', '/es', '/fr/2']) AS mount_point),
    p AS (SELECT page_id, coalesce(nullif(regexp_extract(url, '^[a-z]+://[^/]*([^?#]*)', 1), ''), '/') AS path FROM pages)
    SELECT page_id, path, (SELECT arg_max(mount_point, length(mount_point)) FROM m WHERE mount_point = '/' OR path = mount_point OR starts_with(path, mount_point || '/')) AS mount_point FROM p""")
def longest_mount_prefix(spark, sf_dir):
    path = F.regexp_extract("url", "^[a-z]+://[^/]*([^?#]*)", 1)
    rows = table(spark, sf_dir, "pages").select("page_id", F.when(path == "", "/").otherwise(path).alias("path"))
    return lookup.longest_mount(rows, spark.createDataFrame([(m,) for m in MOUNTS], "mount_point string"))


_PROFILES = [("a", 0, "zfs", None, None, None), ("b", 1, None, "nvme", "raid0", None), ("c", 2, None, "nvme", None, "Brand#1"), ("d", 3, "ext4", None, None, None)]


@query("device_profile_match", """WITH d AS (SELECT p_partkey AS device_id, CASE p_partkey % 5 WHEN 0 THEN 'zfs' WHEN 1 THEN 'ext4' ELSE 'xfs' END AS fstype, CASE WHEN p_partkey % 2 = 0 THEN 'nvme' ELSE 'ssd' END AS dev_kind,
      CASE WHEN p_partkey % 3 = 0 THEN 'raid0' END AS md_level, p_brand AS dev_model FROM part),
    p(id, ordinal, fstype, dev_kind, md_level, part) AS (VALUES ('a', 0, 'zfs', NULL, NULL, NULL), ('b', 1, NULL, 'nvme', 'raid0', NULL), ('c', 2, NULL, 'nvme', NULL, 'Brand#1'), ('d', 3, 'ext4', NULL, NULL, NULL))
    SELECT d.device_id, arg_min(p.id, p.ordinal) AS profile_id FROM d LEFT JOIN p ON (p.fstype IS NULL OR p.fstype = d.fstype) AND (p.dev_kind IS NULL OR p.dev_kind = d.dev_kind)
      AND (p.md_level IS NULL OR p.md_level = d.md_level) AND (p.part IS NULL OR contains(d.dev_model, p.part)) GROUP BY d.device_id""")
def device_profile_match(spark, sf_dir):
    n = F.col("p_partkey")
    devices = table(spark, sf_dir, "part").select(
        n.alias("device_id"), F.when(n % 5 == 0, "zfs").when(n % 5 == 1, "ext4").otherwise("xfs").alias("fstype"), F.when(n % 2 == 0, "nvme").otherwise("ssd").alias("dev_kind"),
        F.when(n % 3 == 0, "raid0").alias("md_level"), F.col("p_brand").alias("dev_model"),
    )
    profiles = spark.createDataFrame(_PROFILES, "id string, ordinal int, fstype string, dev_kind string, md_level string, dev_model_contains string")
    return lookup.profile_match(devices, profiles)


_UNITS = ["", "k", "KB", "KiB", "m", "MiB", "g", "GB", "t", "b", "x", "kk"]


@query("parse_size", """WITH u AS (SELECT s_suppkey, CAST(s_suppkey * 7 AS VARCHAR) || ['', 'k', 'KB', 'KiB', 'm', 'MiB', 'g', 'GB', 't', 'b', 'x', 'kk'][s_suppkey % 12 + 1] AS text FROM supplier)
    SELECT s_suppkey, text, CAST(CASE s_suppkey % 12 WHEN 0 THEN 1 WHEN 9 THEN 1 WHEN 1 THEN 1024 WHEN 2 THEN 1024 WHEN 3 THEN 1024 WHEN 4 THEN 1048576 WHEN 5 THEN 1048576 WHEN 6 THEN 1073741824 WHEN 7 THEN 1073741824
      WHEN 8 THEN 1099511627776 END AS BIGINT) * s_suppkey * 7 AS bytes FROM u""")
def parse_size(spark, sf_dir):
    n = F.col("s_suppkey")
    unit = F.element_at(F.array(*[F.lit(u) for u in _UNITS]), (n % len(_UNITS) + 1).cast("int"))
    rows = table(spark, sf_dir, "supplier").select("s_suppkey", F.concat((n * 7).cast("string"), unit).alias("text"))
    return rows.withColumn("bytes", binary.parse_size(F.col("text")))


@query("block_arithmetic", """SELECT o_orderkey, o_orderkey * 1000 - (o_orderkey * 1000) % 4096 AS aligned, CAST(greatest(0, least(o_orderkey * 1000 - 8192, 4096)) AS BIGINT) AS third_block_len,
    (o_orderkey * 1000) % 4096 = 0 AS direct, CAST(o_orderkey % 100 * 100 // 60 >= 70 AS BOOLEAN) AS similar FROM orders""")
def block_arithmetic(spark, sf_dir):
    n = F.col("o_orderkey") * 1000
    size = n
    return table(spark, sf_dir, "orders").select(
        "o_orderkey", binary.align_down(n, 4096).alias("aligned"), binary.expected_read_len(size, F.lit(8192).cast("bigint"), 4096).alias("third_block_len"),
        binary.direct_io_allowed(F.lit(0).cast("bigint"), n, n).alias("direct"), binary.similar_size(F.lit(60).cast("bigint"), F.col("o_orderkey") % 100).alias("similar"),
    )


@query("copy_plan_choice", """WITH s AS (SELECT o_orderkey AS k, o_orderkey % 2 = 0 AS sc, o_orderkey % 3 = 0 AS tc, o_orderkey % 50 AS sl, o_custkey % 50 AS tl, o_orderkey % 5 <> 0 AS dw,
      ['auto', 'full', 'diff'][CAST(o_custkey % 3 AS BIGINT) + 1] AS rw FROM orders),
    c AS (SELECT *, CASE WHEN sl = 0 THEN tl = 0 ELSE tl * 100 // sl >= 70 END AS near FROM s)
    SELECT k AS o_orderkey, CASE WHEN rw = 'diff' THEN CASE WHEN dw THEN 'forced diff-overwrite' ELSE 'forced diff copy_file_range single fallback' END
      WHEN rw <> 'full' AND sc AND tc AND near THEN CASE WHEN dw THEN 'auto diff-overwrite' ELSE 'auto copy_file_range single fallback' END
      WHEN sc AND near THEN 'auto cached-read direct-write' ELSE 'auto direct threaded' END AS label FROM c""")
def copy_plan_choice(spark, sf_dir):
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    rewrite = F.element_at(F.array(F.lit("auto"), F.lit("full"), F.lit("diff")), (c % 3 + 1).cast("int"))
    plan = copy_plan.choose(k % 2 == 0, k % 3 == 0, k % 50, c % 50, k % 5 != 0, rewrite)
    return table(spark, sf_dir, "orders").select("o_orderkey", copy_plan.label(plan).alias("label"))


@query("disk_backed_mounts", """WITH m AS (SELECT c_custkey, ['/', '/data', '/proc/x', '/run/user', '/mnt/a', '/boot'][CAST(c_custkey % 6 AS BIGINT) + 1] AS mp, ['ext4', 'tmpfs', 'zfs', 'nfs', 'xfs'][CAST(c_custkey % 5 AS BIGINT) + 1] AS fs,
      CASE WHEN c_custkey % 7 < 4 THEN '/dev/sda1' ELSE 'pool' END AS src FROM customer)
    SELECT c_custkey, fs NOT IN ('tmpfs', 'nfs') AND (mp = '/' OR (mp NOT IN ('/proc/x', '/run/user') AND (starts_with(src, '/dev/') OR fs = 'zfs'))) AS disk FROM m""")
def disk_backed_mounts(spark, sf_dir):
    pick = lambda values, n: F.element_at(F.array(*[F.lit(v) for v in values]), (F.col("c_custkey") % n + 1).cast("int"))
    mount, kind = pick(["/", "/data", "/proc/x", "/run/user", "/mnt/a", "/boot"], 6), pick(["ext4", "tmpfs", "zfs", "nfs", "xfs"], 5)
    source = F.when(F.col("c_custkey") % 7 < 4, "/dev/sda1").otherwise("pool")
    return table(spark, sf_dir, "customer").select("c_custkey", lookup.disk_backed(mount, kind, source).alias("disk"))
