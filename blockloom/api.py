"""Files by path: reading, searching, hashing, verifying, repairing, comparing, copying and writing.

A thin layer over the operators. Scans and digests run on the executors, which
must mount the paths; locks, renames and metadata checks are the driver's.
"""

from __future__ import annotations

import contextlib
import fcntl
import os
import shutil
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import digests
from .operators import manifests, recover, search, verify
from .plans import config as settings
from .session import register
from .sources import files as store


@dataclass
class VerifyReport:
    bytes_hashed: int
    total_blocks: int
    loaded_manifests: int
    ok_blocks: int
    bad_blocks: list[dict] = field(default_factory=list)
    size_matches: bool | None = None


@dataclass
class RecoverReport:
    bytes_hashed: int
    repaired_blocks: int
    repaired_files: int
    sidecars_refreshed: int
    used_fast_path: bool
    fell_back_to_full_scan: bool
    failed_blocks: list[dict] = field(default_factory=list)


@dataclass
class CopyReport:
    bytes_copied: int
    source_bytes_hashed: int
    verified_blocks: int
    repaired_blocks: int
    used_recovery: bool
    hash_type: str
    hashes_persisted: bool


class ParallelFile:
    """A file, read by blocks on the executors."""

    def __init__(self, spark: SparkSession, path: str, block_size: int | None = None, config: settings.Config | None = None):
        register(spark)
        self.spark, self.path = spark, os.path.abspath(path)
        if not os.path.isfile(self.path):
            raise FileNotFoundError(self.path)
        self.block_size = (config or settings.Config()).logical_block_size("read", self.path) if block_size is None else block_size
        if self.block_size <= 0:
            raise ValueError("block size must be positive")

    def __len__(self) -> int:
        return os.path.getsize(self.path)

    def block_count(self) -> int:
        return -(-len(self) // self.block_size)

    def blocks(self) -> DataFrame:
        """``path, block_index, offset, file_size, data``."""
        return self.spark.read.format("blocks").option("block_size", self.block_size).load(self.path)

    def foreach_block(self, visit: Callable) -> None:
        self.blocks().foreach(visit)

    def map_blocks(self, value) -> DataFrame:
        return self.blocks().select("block_index", "offset", value.alias("value")).orderBy("block_index")

    def byte_count(self) -> int:
        """What a pure scan reads."""
        return self.blocks().agg(F.coalesce(F.sum(F.octet_length("data")), F.lit(0))).first()[0]

    def read_range(self, offset: int, length: int) -> bytes:
        """Exactly the range; ``EOFError`` where the file ends before it does."""
        if offset < 0 or length < 0:
            raise ValueError("ranges are not negative")
        if offset + length > len(self):
            raise EOFError(f"{self.path}: {offset}+{length} is behind the end")
        with open(self.path, "rb") as f:
            f.seek(offset)
            data = f.read(length)
        if len(data) != length:
            raise EOFError(self.path)
        return data

    def grep(self, pattern: str | bytes) -> DataFrame:
        """``offset`` of each match that a block-wise search finds, in order."""
        raw = pattern.encode() if isinstance(pattern, str) else pattern
        rows = self.blocks().withColumn("file_id", F.lit(0).cast("bigint"))
        return search.grep_blocks(rows, raw).select("offset").orderBy("offset")

    def manifest(self, hash_type: str = "sha256", block_size: int = 1 << 20) -> dict:
        """The file's block-hash manifest; only digests come to the driver's aggregate."""
        manifests.check_block_size(block_size)
        rows = self.spark.read.format("blocks").option("block_size", block_size).load(self.path)
        digest = digests.block_digest(F.col("data"), hash_type)
        hashed = rows.select(F.lit(0).cast("bigint").alias("file_id"), "block_index", "file_size", digest.alias("hash"))
        row = manifests.build_from_blocks(hashed, block_size, hash_type).select("manifest.*").first()
        if row is None:
            empty = digests.xxh3_hex(b"") if hash_type == "xxh3" else digests.sha256_stream([])
            return {"hash_type": hash_type, "file_size": 0, "block_size": block_size, "bytes_hashed": 0, "block_hashes": [], "hash_of_hashes": empty}
        return row.asDict()


def open_file(spark: SparkSession, path: str, block_size: int | None = None) -> ParallelFile:
    return ParallelFile(spark, path, block_size)


def read_file(path: str) -> bytes:
    with open(path, "rb") as f:
        return f.read()


def write_file(path: str, data: bytes, offset: int = 0, length: int | None = None) -> int:
    """Writes a buffer, or a part of it; a part outside is an error."""
    length = len(data) - offset if length is None else length
    if offset < 0 or length < 0 or offset + length > len(data):
        raise ValueError("range is outside the buffer")
    with replacing(path) as temp, open(temp, "wb") as f:
        f.write(memoryview(data)[offset : offset + length])
    return length


def write_blocks(writes: DataFrame, path: str, total_size: int, truncate: bool = True, sync: bool = False) -> None:
    """Writes ``offset, data`` rows of a DataFrame into one file, from all tasks at once."""
    register(writes.sparkSession)
    out = writes.select(F.col("offset").cast("bigint").alias("offset"), F.col("data").cast("binary").alias("data"))
    out.write.format("blockfile").option("total_size", total_size).option("truncate", str(truncate).lower()).option("sync", str(sync).lower()).mode("append").save(os.path.abspath(path))


class SequentialWriter:
    """Appends to one file on the driver; each append returns where it lies."""

    def __init__(self, path: str, append: bool = False):
        self.file = open(path, "ab" if append else "wb")
        self.at, self.bytes_written = self.file.tell(), 0

    def append(self, data: bytes) -> int:
        start = self.at
        self.file.write(data)
        self.at += len(data)
        self.bytes_written += len(data)
        return start

    def flush(self, sync: bool = False) -> None:
        self.file.flush()
        if sync:
            os.fsync(self.file.fileno())

    def close(self) -> None:
        self.file.close()

    def __enter__(self) -> SequentialWriter:
        return self

    def __exit__(self, *_) -> None:
        self.close()


@dataclass
class WriteReport:
    bytes_written: int
    block_ranges: list[tuple[int, int]] = field(default_factory=list)


class ParallelWriter:
    """Writes blocks of DataFrames into one file, by index or by offset; ``finish`` makes the file.

    ``indexed``: frames of ``index, data`` in any order; indices must be 0 to
    ``block_count`` - 1, each once. ``fixed_size``: frames of ``offset, data``;
    what is written later wins, gaps are zero or, without truncation, the old bytes.
    """

    def __init__(self, spark: SparkSession, path: str, block_count: int | None, total_size: int | None, truncate: bool = True):
        self.spark, self.path, self.block_count, self.total_size, self.truncate = spark, path, block_count, total_size, truncate
        self.frames: list[DataFrame] = []
        self.done = False

    @classmethod
    def indexed(cls, spark: SparkSession, path: str, block_count: int) -> ParallelWriter:
        return cls(spark, path, block_count, None)

    @classmethod
    def fixed_size(cls, spark: SparkSession, path: str, total_size: int, truncate: bool = True) -> ParallelWriter:
        return cls(spark, path, None, total_size, truncate)

    def _add(self, frame: DataFrame, column: str) -> None:
        if self.done:
            raise RuntimeError("the writer is finished")
        if (column == "index") != (self.block_count is not None):
            raise ValueError("the writer takes " + ("indices" if self.block_count is not None else "offsets"))
        place = F.col(column).cast("bigint").alias(column)
        self.frames.append(frame.select(place, F.col("data").cast("binary").alias("data"), F.lit(len(self.frames)).alias("seq")))

    def write_frame(self, frame: DataFrame) -> None:
        self._add(frame, "index" if self.block_count is not None else "offset")

    def write_at_index(self, index: int, data: bytes) -> None:
        self._add(self.spark.createDataFrame([(index, data)], "index bigint, data binary"), "index")

    def write_at_offset(self, offset: int, data: bytes) -> None:
        self._add(self.spark.createDataFrame([(offset, data)], "offset bigint, data binary"), "offset")

    def finish(self) -> WriteReport:
        if self.done:
            raise RuntimeError("the writer is finished")
        self.done = True
        from .operators import writing

        column = "index" if self.block_count is not None else "offset"
        rows = self.spark.createDataFrame([], f"{column} bigint, data binary, seq int")
        for frame in self.frames:
            rows = rows.unionByName(frame)
        rows = rows.withColumn("file", F.lit(0))
        if self.block_count is not None:
            want = self.spark.createDataFrame([(0, self.block_count)], "file int, block_count bigint")
            fault = writing.index_faults(rows, "file", "index", want).first()
            if fault["out_of_range"] or fault["duplicates"] or fault["missing"]:
                raise ValueError(f"bad indexed write: {fault['out_of_range']} out of range, {fault['duplicates']} duplicates, {fault['missing']} missing")
            placed = writing.append_ranges(rows, "file", "index")
            ranges = [(r["offset"], r["len"]) for r in placed.select("index", "offset", "len").orderBy("index").toLocalIterator()]
            total = sum(n for _, n in ranges)
            write_blocks(placed, self.path, total)
            return WriteReport(total, ranges)
        n = rows.agg(F.coalesce(F.sum(F.octet_length("data")), F.lit(0)), F.coalesce(F.max(F.col("offset") + F.octet_length("data")), F.lit(0)), F.coalesce(F.min("offset"), F.lit(0))).first()
        if n[1] > self.total_size or n[2] < 0:
            raise ValueError(f"write past end of file: {n[1]} of {self.total_size}")
        write_blocks(writing.last_wins(rows, "file", "seq", "offset", "data"), self.path, self.total_size, self.truncate)
        return WriteReport(n[0])


def digest_file(spark: SparkSession, path: str, kind: str = "sha256", block_size: int = 1 << 20) -> str:
    """SHA-256 or BLAKE3 of a whole file of any size.

    The digest takes the bytes in order, so one task reads them in order, a block at a time; nothing is shuffled or sorted.
    """
    import pyarrow as pa

    file, make = open_file(spark, path, block_size), digests.STREAMS[kind]
    at, size = file.path, len(file)

    def run(batches):
        for _ in batches:
            state = make()
            with open(at, "rb") as f:
                for start in range(0, size, block_size):
                    want = min(block_size, size - start)
                    data = f.read(want)
                    if len(data) != want:
                        raise EOFError(f"{at}: {len(data)} of {want} bytes at {start}")
                    state.update(data)
            yield pa.RecordBatch.from_pydict({"digest": [state.hex()]})

    return spark.range(0, 1, 1, 1).mapInArrow(run, "digest string").first()["digest"]


# --- the driver's part: locks, renames, drift -----------------------------------


@contextlib.contextmanager
def replacing(path: str, sync: bool = False) -> Iterator[str]:
    """A sibling that takes the path's place when the block ends well, and goes otherwise."""
    path = os.path.abspath(path)
    temp = f"{path}.{uuid.uuid4().hex}.part"
    try:
        yield temp
        if os.path.exists(path):
            shutil.copymode(path, temp)
        if sync:
            _sync(temp)
        os.replace(temp, path)
        if sync:
            _sync(os.path.dirname(path))
    finally:
        if os.path.exists(temp):
            os.remove(temp)


def _sync(path: str) -> None:
    fd = os.open(path, os.O_RDONLY)
    try:
        os.fsync(fd)
    finally:
        os.close(fd)


def snapshot(path: str) -> tuple[int, int, int, int, int]:
    """Length, times and identity of a file."""
    s = os.stat(path)
    return s.st_size, s.st_mtime_ns, s.st_ctime_ns, s.st_dev, s.st_ino


@contextlib.contextmanager
def guard(source: str, target: str, lock: bool = True) -> Iterator[Callable[[], None]]:
    """Advisory locks, taken in the order of paths, and a check that the source has not changed.

    A target that is made only to be locked goes if the block fails.
    """
    source, target = os.path.abspath(source), os.path.abspath(target)
    if os.path.realpath(source) == os.path.realpath(target):
        raise ValueError("source and target are one file")
    before, held, made = snapshot(source), [], False
    try:
        if lock:
            made = not os.path.exists(target)
            for path in sorted((source, target)):
                fd = os.open(path, os.O_RDONLY if path == source else os.O_RDWR | os.O_CREAT, 0o666)
                held.append(fd)
                fcntl.flock(fd, fcntl.LOCK_SH if path == source else fcntl.LOCK_EX)

        def check() -> None:
            if snapshot(source) != before:
                raise RuntimeError(f"{source} changed while it was copied")

        yield check
    except BaseException:
        if made and os.path.exists(target) and os.path.getsize(target) == 0:
            os.remove(target)
        raise
    finally:
        for fd in reversed(held):
            os.close(fd)


# --- copies ----------------------------------------------------------------------


def copy_range(spark: SparkSession, source: str, target: str, source_offset: int, target_offset: int, length: int, truncate: bool = True, block_size: int = 1 << 20, keep_size: int | None = None, sync: bool = False) -> int:
    """Copies a range, cut to what the source has, into the target; returns the bytes copied."""
    have = os.path.getsize(source)
    n = max(0, min(length, have - source_offset))
    old = os.path.getsize(target) if os.path.exists(target) and not truncate else 0
    total = max(old, target_offset + n) if keep_size is None else max(keep_size, target_offset + n)
    first, last = source_offset // block_size, (source_offset + n - 1) // block_size if n else -1
    rows = open_file(spark, source, block_size).blocks().where(F.col("block_index").between(first, last))
    low = F.greatest(F.col("offset"), F.lit(source_offset))
    high = F.least(F.col("offset") + F.octet_length("data"), F.lit(source_offset + n))
    part = F.substring(F.col("data"), (low - F.col("offset") + 1).cast("int"), (high - low).cast("int"))
    write_blocks(rows.where(high > low).select((low - source_offset + target_offset).alias("offset"), part.alias("data")), target, total, truncate, sync)
    return n


def copy_file(spark: SparkSession, source: str, target: str, lock: bool = True, keep_target_size: bool = False, block_size: int = 1 << 20) -> int:
    """Copies a file; a source that changes meanwhile is an error."""
    with guard(source, target, lock) as check:
        n = os.path.getsize(source)
        copy_range(spark, source, target, 0, 0, n, not keep_target_size, block_size)
        check()
    return n


def copy_file_via_memory(spark: SparkSession, source: str, target: str, lock: bool = True, block_size: int = 1 << 20) -> int:
    """Holds all blocks in the executors' memory before the first is written."""
    with guard(source, target, lock) as check:
        blocks = open_file(spark, source, block_size).blocks().select("offset", "data").cache()
        blocks.count()
        write_blocks(blocks, target, os.path.getsize(source))
        blocks.unpersist()
        check()
    return os.path.getsize(source)


def _paired_digests(spark: SparkSession, first: str, second: str, block_size: int, how: str) -> DataFrame:
    """``block_index, a, b``: the digests of two files' blocks; no data leaves its task."""
    def of(path: str, name: str) -> DataFrame:
        return open_file(spark, path, block_size).blocks().select("block_index", F.sha2("data", 256).alias(name))

    return of(first, "a").join(of(second, "b"), "block_index", how)


def copy_changed(spark: SparkSession, source: str, target: str, block_size: int = 1 << 20) -> dict[str, int]:
    """Brings a target up to the source by writing only blocks that differ, in place; returns counts.

    Digests decide; then only blocks that changed are read again and written.
    """
    if not os.path.exists(target):
        open(target, "wb").close()
    action = F.when(F.col("b").isNull(), "appended").when(F.col("a") == F.col("b"), "kept").otherwise("replaced")
    judged = _paired_digests(spark, source, target, block_size, "left").select("block_index", action.alias("action")).persist()
    counts = {r["action"]: r["n"] for r in judged.groupBy("action").agg(F.count("*").alias("n")).collect()}
    total = os.path.getsize(source)
    changed = open_file(spark, source, block_size).blocks().join(judged.where("action <> 'kept'"), "block_index", "left_semi")
    write_blocks(changed.select("offset", "data"), target, total, truncate=False)
    judged.unpersist()
    return {"bytes_copied": total, **{k: counts.get(k, 0) for k in ("kept", "replaced", "appended")}}


def diff(spark: SparkSession, first: str, second: str, block_size: int = 1 << 20) -> int | None:
    """The smallest offset, up to the shorter length, at which two files differ; None if there is none."""
    at = _paired_digests(spark, first, second, block_size, "inner").where("a <> b").agg(F.min("block_index")).first()[0]
    if at is None:
        return None
    with open(first, "rb") as a, open(second, "rb") as b:
        for f in (a, b):
            f.seek(at * block_size)
        pair = zip(a.read(block_size), b.read(block_size), strict=False)
    # Where only the shorter file's end makes the blocks differ, it is their last common one.
    return next((at * block_size + i for i, (x, y) in enumerate(pair) if x != y), None)


# --- manifests ----------------------------------------------------------------------


def default_base(path: str) -> str:
    return path + store.SUFFIX


def hash_file(spark: SparkSession, path: str, hash_type: str = "sha256", block_size: int = 1 << 20, base: str | None = None, save: bool = True, durable: bool = False) -> dict:
    """The file's manifest, saved in three replicas beside it unless told otherwise."""
    made = open_file(spark, path, 1 << 20).manifest(hash_type, block_size)
    if save:
        store.save_replicas(base or default_base(path), made, durable)
    return made


def _current(spark: SparkSession, path: str, replicas: DataFrame, block_size: int) -> tuple[dict, DataFrame]:
    """The file's manifest now, by its replicas' shape, which must agree."""
    shape = manifests.geometry(replicas).first()
    if shape is not None and not shape["agree"]:
        raise ValueError(f"the sidecars of {path} disagree on its shape")
    kind, size = (shape["hash_type"], shape["block_size"]) if shape is not None else ("xxh3", block_size)
    made = open_file(spark, path, 1 << 20).manifest(kind, size)
    row = spark.createDataFrame([(0, made)], f"file_id bigint, manifest struct<{manifests.MANIFEST.replace(' ', ':').replace(',:', ',')}>")
    return made, row


def verify_file(spark: SparkSession, path: str, base: str | None = None, block_size: int = 1 << 20) -> VerifyReport:
    """Checks a file against its sidecars; without any, every block is bad."""
    replicas = store.load_replicas(spark, {0: base or default_base(path)})
    _, current = _current(spark, path, replicas, block_size)
    good = manifests.intact(F.col("manifest"))
    report = verify.verify_report(current, replicas, is_intact=good).first()
    bad = verify.verify_blocks(current, replicas, is_intact=good).where("not block_ok").orderBy("block_index")
    return VerifyReport(report["bytes_hashed"], report["total_blocks"], report["loaded_manifests"], report["ok_blocks"], [r.asDict(True) for r in bad.collect()] if report["bad_blocks"] else [], report["size_matches"])


def recover_file(spark: SparkSession, target: str, copies: list[str], base: str | None = None, mode: str = recover.STANDARD, block_size: int = 1 << 20) -> RecoverReport:
    """Repairs a file, or in place all copies of it, from the blocks that the vote elects.

    Hashes are taken on the executors. A block is copied from the first file
    that held the elected hash before any repair. All blocks are read and
    written by tasks, into the damaged places only, and hashed again before
    any sidecar is refreshed.
    """
    paths = [target, *copies]
    bases = [base or default_base(target), *map(default_base, copies)]
    stored = store.load_replicas(spark, dict(enumerate(bases)))
    shapes = manifests.geometry(stored).collect()
    if any(not s["agree"] for s in shapes) or len({(s["file_size"], s["block_size"], s["blocks"]) for s in shapes}) > 1:
        raise ValueError("the sidecars disagree on the files' shape")
    first = min(shapes, key=lambda s: s["file_id"], default=None)
    kind, size = (first["hash_type"], first["block_size"]) if first else ("xxh3", block_size)
    own = stored.where("file_id = 0")
    fast = fell = False
    now = [open_file(spark, target, 1 << 20).manifest(kind, size)]
    length = now[0]["file_size"]
    if mode == recover.FAST:
        good = manifests.summary(own, manifests.intact(F.col("manifest"))).first()
        agreed = good["agreed"] if good is not None else None
        if agreed is not None and agreed["block_hashes"][: len(now[0]["block_hashes"])] == now[0]["block_hashes"] and len(agreed["block_hashes"]) >= len(now[0]["block_hashes"]):
            fast = True
        fell = not fast
    if not fast:
        now += [open_file(spark, p, 1 << 20).manifest(kind, size) for p in copies]
        if len({(m["file_size"], len(m["block_hashes"])) for m in now}) > 1:
            raise ValueError("the files differ in shape")
    hashed = sum(m["bytes_hashed"] for m in now)
    good = manifests.intact(F.col("manifest"))
    kept = [(r["file_id"], r["manifest"].asDict(), r["ok"]) for r in stored.withColumn("ok", good).collect()]  # three for each file
    fixes: dict[int, dict[int, int]] = {}
    failed = []
    targets = range(len(paths)) if mode == recover.IN_PLACE_ALL else [0]
    found = [list(m["block_hashes"]) for m in now]
    for i in range(0 if fast else len(now[0]["block_hashes"])):
        votes = [(m["block_hashes"][i], ok) for _, m, ok in kept if i < len(m["block_hashes"])]
        for t in targets:
            have = [m["block_hashes"][i] for m in now]
            elected, source, basis, failure = recover.decide_one(have, votes)
            if elected == have[t]:
                continue
            if source is not None and source != t:
                fixes.setdefault(t, {})[i] = next(j for j, hashes in enumerate(found) if hashes[i] == elected)
                now[t]["block_hashes"][i] = elected
            else:
                failed.append({"file_index": t, "path": paths[t], "block_index": i, "current_hash": have[t], "basis": basis, "failure": failure})
    refreshed = 0
    for t, plan in fixes.items():
        donors = [open_file(spark, paths[d], size).blocks().where(F.col("block_index").isin([i for i in plan if plan[i] == d])) for d in sorted(set(plan.values()))]
        rows = donors[0].select("offset", "data")
        for other in donors[1:]:
            rows = rows.unionByName(other.select("offset", "data"))
        write_blocks(rows, paths[t], length, truncate=False, sync=True)
    for t, plan in fixes.items():
        written = open_file(spark, paths[t], size).blocks().where(F.col("block_index").isin(list(plan)))
        wrong = [r["block_index"] for r in written.select("block_index", digests.block_digest(F.col("data"), kind).alias("h")).collect() if r["h"] != now[t]["block_hashes"][r["block_index"]]]
        if wrong:
            raise RuntimeError(f"{paths[t]}: blocks {wrong[:10]} are not what was elected after their repair")
    for t, m in enumerate(now):
        if (t and mode != recover.IN_PLACE_ALL) or any(x["file_index"] == t for x in failed):
            continue
        root = b"".join(bytes.fromhex(h) for h in m["block_hashes"])
        m["hash_of_hashes"] = digests.xxh3_hex(root) if kind == "xxh3" else digests.sha256_stream([root])
        mine = [(x, ok) for f, x, ok in kept if f == t]
        if len(mine) != manifests.REPLICAS or not all(ok and x == m for x, ok in mine):
            store.save_replicas(bases[t], m, durable=True)
            refreshed += 1
    return RecoverReport(hashed, sum(map(len, fixes.values())), len(fixes), refreshed, fast, fell, failed)


def copy_verified(spark: SparkSession, source: str, target: str, hash_type: str = "sha256", block_size: int = 1 << 20, lock: bool = True, save_hashes: bool = False) -> CopyReport:
    """Copies into a sibling, compares block hashes, rewrites what differs, and only then renames."""
    with guard(source, target, lock), replacing(target, sync=True) as temp:
        before = open_file(spark, source, 1 << 20).manifest(hash_type, block_size)
        n = copy_range(spark, source, temp, 0, 0, os.path.getsize(source), True, block_size, sync=True)
        if n != before["file_size"]:
            raise OSError(f"copied {n} of {before['file_size']} bytes")
        after = open_file(spark, temp, 1 << 20).manifest(hash_type, block_size)
        bad = [i for i, (x, y) in enumerate(zip(before["block_hashes"], after["block_hashes"], strict=True)) if x != y]
        if bad:
            if open_file(spark, source, 1 << 20).manifest(hash_type, block_size) != before:
                raise RuntimeError(f"{source} changed while it was copied")
            rows = open_file(spark, source, block_size).blocks().where(F.col("block_index").isin(bad)).select("offset", "data")
            write_blocks(rows, temp, n, truncate=False, sync=True)
        if open_file(spark, temp, 1 << 20).manifest(hash_type, block_size) != before:
            raise RuntimeError(f"{target} could not be verified")
    if save_hashes:
        store.save_replicas(default_base(target), before, durable=True)
        if not any(os.path.exists(p) for p in store.sidecar_paths(default_base(source))):
            store.save_replicas(default_base(source), before, durable=True)
    return CopyReport(n, before["bytes_hashed"], len(before["block_hashes"]), len(bad), bool(bad), hash_type, save_hashes)
