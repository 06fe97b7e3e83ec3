"""The path-based layer: sources, sinks, manifests, repair and copies."""

import os
import random

import pytest

from blockloom import api
from blockloom.functions import blake3, digests
from blockloom.operators import containers, recover, writing
from blockloom.sources import files as store


def pattern(n: int, k: int = 17, c: int = 0) -> bytes:
    return bytes((i * k + c) % 251 for i in range(n))


@pytest.fixture
def target(tmp_path):
    path = tmp_path / "t.bin"
    path.write_bytes(pattern(40_000))
    return str(path)


def damage(path: str, offset: int, n: int = 4) -> None:
    with open(path, "r+b") as f:
        f.seek(offset)
        old = f.read(n)
        f.seek(offset)
        f.write(bytes(b ^ 0xFF for b in old))


def test_blocks_rebuild_the_file(spark, target):
    file = api.open_file(spark, target, 4096)
    rows = file.blocks().orderBy("block_index").collect()
    assert file.block_count() == len(rows) == 10
    assert b"".join(bytes(r["data"]) for r in rows) == pattern(40_000)
    assert [r["offset"] for r in rows] == [i * 4096 for i in range(10)] and len(rows[-1]["data"]) == 40_000 - 9 * 4096
    assert file.byte_count() == 40_000


def test_block_filters_prune(spark, target):
    from blockloom.sources.block_source import BlockReader
    from pyspark.sql.datasource import GreaterThanOrEqual, In, LessThan

    reader = BlockReader({"path": target, "block_size": "4096"})
    assert not list(reader.pushFilters([GreaterThanOrEqual(("block_index",), 3), LessThan(("block_index",), 5)]))
    assert [(p.first, p.last) for p in reader.partitions()] == [(3, 4)]
    reader = BlockReader({"path": target, "block_size": "4096"})
    assert not list(reader.pushFilters([In(("block_index",), (1, 7, 99))]))
    assert [(p.first, p.last) for p in reader.partitions()] == [(1, 1), (7, 7)]
    rows = api.open_file(spark, target, 4096).blocks().where("block_index = 9").collect()
    assert [r["block_index"] for r in rows] == [9]


def test_empty_files_are_listed(spark, tmp_path):
    (tmp_path / "a").write_bytes(b"xy")
    (tmp_path / "b").write_bytes(b"")
    rows = store.read_files(spark, f"file://{tmp_path}").orderBy("path").collect()
    assert [(r["length"], bytes(r["content"])) for r in rows] == [(2, b"xy"), (0, b"")]
    assert api.open_file(spark, str(tmp_path / "b"), 4096).blocks().count() == 0
    assert api.open_file(spark, str(tmp_path / "b")).manifest()["hash_of_hashes"] == "e3b0c44298fc1c149afbf4c8996fb92427ae41e4649b934ca495991b7852b855"


def test_ranges(spark, target):
    file = api.open_file(spark, target)
    assert file.read_range(100, 7) == pattern(40_000)[100:107]
    with pytest.raises(EOFError):
        file.read_range(39_999, 2)


def test_grep_over_a_boundary(spark, tmp_path):
    path = tmp_path / "g"
    path.write_bytes(b"x" * 4094 + b"abcd" + b"x" * 4094)
    assert [r["offset"] for r in api.open_file(spark, str(path), 4096).grep("abcd").collect()] == [4094]


def test_grep_restarts_in_each_block(spark, tmp_path):
    path = tmp_path / "g"
    path.write_bytes(b"a" * 10)
    assert [r["offset"] for r in api.open_file(spark, str(path), 5).grep("aa").collect()] == [0, 2, 4, 5, 7]


def test_hash_verify_recover(spark, target, tmp_path):
    copy = str(tmp_path / "copy.bin")
    api.write_file(copy, pattern(40_000))
    for kind in ("xxh3", "sha256"):
        api.hash_file(spark, target, kind, 4096)
        assert api.verify_file(spark, target).bad_blocks == []
        damage(target, 4096 + 7)
        report = api.verify_file(spark, target)
        assert [b["block_index"] for b in report.bad_blocks] == [1] and report.ok_blocks == 9
        done = api.recover_file(spark, target, [copy])
        assert (done.repaired_blocks, done.repaired_files, done.failed_blocks) == (1, 1, [])
        assert api.read_file(target) == pattern(40_000)
        assert api.verify_file(spark, target).bad_blocks == []


def test_fast_recovery_leaves_copies_alone(spark, target, tmp_path):
    copy = str(tmp_path / "copy.bin")
    api.write_file(copy, pattern(40_000))
    api.hash_file(spark, target, block_size=4096)
    damage(copy, 4096 + 3)
    done = api.recover_file(spark, target, [copy], mode=recover.FAST)
    assert done.used_fast_path and done.bytes_hashed == 40_000 and done.repaired_blocks == 0


def test_in_place_all_repairs_copies_and_sidecars(spark, target, tmp_path):
    copy = str(tmp_path / "copy.bin")
    api.write_file(copy, pattern(40_000))
    api.hash_file(spark, target, block_size=4096)
    api.hash_file(spark, copy, block_size=4096)
    damage(target, 7)
    damage(copy, 4096 + 9)
    os.remove(store.sidecar_paths(api.default_base(target))[1])
    os.remove(store.sidecar_paths(api.default_base(copy))[2])
    done = api.recover_file(spark, target, [copy], mode=recover.IN_PLACE_ALL)
    assert (done.repaired_blocks, done.repaired_files, done.sidecars_refreshed) == (2, 2, 2)
    assert api.read_file(target) == api.read_file(copy) == pattern(40_000)


def test_in_place_all_never_copies_from_a_file_that_is_damaged_itself(spark, tmp_path):
    """A target may elect a file that an earlier repair mended; its bytes come from one that was right before."""
    f, g, h = paths = [str(tmp_path / n) for n in "fgh"]
    for p in paths:
        api.write_file(p, pattern(16_384))
    api.hash_file(spark, f, "sha256", block_size=4096)
    damage(g, 5)
    damage(f, 4096 + 5)
    damage(g, 4096 + 9, 6)
    done = api.recover_file(spark, f, [g, h], mode=recover.IN_PLACE_ALL)
    assert (done.repaired_blocks, done.failed_blocks) == (3, [])
    assert all(api.read_file(p) == pattern(16_384) for p in paths)
    assert all(api.verify_file(spark, p).bad_blocks == [] for p in paths)


@pytest.mark.parametrize("count", [2, 3, 4, 5, 6])
def test_in_place_all_of_random_damage(spark, count):
    """Every block whose elected hash some copy held ends equal to it, whatever was damaged; held against a loop."""
    import hashlib
    import random

    from blockloom.operators import manifests

    rng, size, n = random.Random(count), 64, 6
    sha = lambda b: hashlib.sha256(b).hexdigest()
    rows, replicas, want = [], [], {}
    for file_id in range(12):
        true = [bytes([file_id, i]) * (size // 2) for i in range(n)]
        held = [[rng.choice([b, b, bytes([rng.randrange(2)]) * size]) for b in true] for _ in range(count)]
        rows += [(file_id, c, b"".join(blocks)) for c, blocks in enumerate(held)]
        stored = []
        if file_id % 2:
            hashes = [sha(b) for b in true]
            replicas.append((file_id, 0, 0, ("sha256", n * size, size, n * size, hashes, sha(b"".join(map(bytes.fromhex, hashes))))))
            stored = hashes
        for i in range(n):
            bytes_of = {sha(blocks[i]): blocks[i] for blocks in held}
            now = [sha(blocks[i]) for blocks in held]
            for t in range(count):
                elected, source, _, _ = recover.decide_one(now, [(stored[i], True)] if stored else [])
                if source is not None:
                    now[t] = elected
            for t in range(count):
                want.setdefault((file_id, t), []).append(bytes_of[now[t]])
    copies = spark.createDataFrame(rows, "file_id bigint, copy_index int, content binary")
    stored = spark.createDataFrame(replicas, f"file_id bigint, copy_index int, replica int, manifest struct<{manifests.MANIFEST.replace(' ', ':').replace(',:', ',')}>")
    judged = recover.decisions(copies, stored, size, recover.IN_PLACE_ALL, unit=1)
    got = {(r["file_id"], r["copy_index"]): bytes(r["content"]) for r in recover.repaired_content(copies, judged, size).collect()}
    assert got == {k: b"".join(v) for k, v in want.items()}


def test_without_sidecars_every_block_is_bad(spark, target):
    report = api.verify_file(spark, target, block_size=4096)
    assert report.loaded_manifests == 0 and len(report.bad_blocks) == 10
    assert {b["failure"] for b in report.bad_blocks} == {"NoBlockHashFound"}


def test_a_file_cut_at_a_block_shows_in_the_size(spark, target):
    api.hash_file(spark, target, block_size=4096)
    os.truncate(target, 4096 * 5)
    report = api.verify_file(spark, target)
    assert report.bad_blocks == [] and report.size_matches is False


def test_malformed_sidecars_are_absent(spark, target):
    api.hash_file(spark, target, block_size=4096)
    with open(store.sidecar_paths(api.default_base(target))[0], "w") as f:
        f.write("{")
    assert api.verify_file(spark, target).loaded_manifests == 2


def test_copies(spark, target, tmp_path):
    out = str(tmp_path / "out")
    assert api.copy_file(spark, target, out, block_size=4096) == 40_000 and api.read_file(out) == pattern(40_000)
    assert api.copy_file_via_memory(spark, target, out, block_size=4096) == 40_000
    damage(out, 9000)
    os.truncate(out, 30_000)
    counts = api.copy_changed(spark, target, out, 4096)
    assert counts == {"bytes_copied": 40_000, "kept": 6, "replaced": 2, "appended": 2} and api.read_file(out) == pattern(40_000)
    report = api.copy_verified(spark, target, out, block_size=4096, save_hashes=True)
    assert (report.bytes_copied, report.verified_blocks, report.repaired_blocks) == (40_000, 10, 0)
    assert api.verify_file(spark, out).bad_blocks == [] and api.verify_file(spark, target).bad_blocks == []
    assert [f for f in os.listdir(tmp_path) if f.endswith(".part")] == []


def test_keeping_the_target_size(spark, tmp_path):
    a, b = tmp_path / "a", tmp_path / "b"
    a.write_bytes(b"abcdef")
    b.write_bytes(b"0123456789")
    api.copy_file(spark, str(a), str(b), keep_target_size=True)
    assert b.read_bytes() == b"abcdef6789"


def test_range_copy(spark, target, tmp_path):
    out = tmp_path / "r"
    out.write_bytes(b"z" * 20)
    assert api.copy_range(spark, target, str(out), 5000, 3, 10, truncate=False, block_size=4096) == 10
    assert out.read_bytes() == b"zzz" + pattern(40_000)[5000:5010] + b"z" * 7
    assert api.copy_range(spark, target, str(out), 39_995, 3, 10, block_size=4096) == 5
    assert out.read_bytes() == b"\0\0\0" + pattern(40_000)[-5:]


def test_diff(spark, target, tmp_path):
    other = str(tmp_path / "o")
    api.write_file(other, pattern(40_000))
    assert api.diff(spark, target, other, 4096) is None
    damage(other, 12_345)
    damage(other, 20_000)
    assert api.diff(spark, target, other, 4096) == 12_345


def test_a_changing_source_is_an_error(spark, target, tmp_path):
    with pytest.raises(RuntimeError), api.guard(target, str(tmp_path / "n")) as check:
        damage(target, 0)
        check()
    assert not (tmp_path / "n").exists()


def test_offset_writes(spark, tmp_path):
    path = str(tmp_path / "w")
    rows = spark.createDataFrame([(0, b"abcd"), (12, b"xy")], "offset bigint, data binary")
    api.write_blocks(rows, path, 16)
    assert api.read_file(path) == b"abcd" + b"\0" * 8 + b"xy\0\0"
    api.write_blocks(spark.createDataFrame([(3, b"XYZ")], "offset bigint, data binary"), path, 10, truncate=False)
    assert api.read_file(path) == b"abcXYZ\0\0\0\0"
    with pytest.raises(Exception, match="past end"):
        api.write_blocks(rows, path, 13)
    assert api.read_file(path) == b"abcXYZ\0\0\0\0"


def test_overlapping_writes_keep_the_last(spark):
    rng = random.Random(5)
    writes = [(0, i, rng.randrange(40), rng.randbytes(rng.randrange(1, 20))) for i in range(30)]
    image = bytearray(60)
    for _, _, at, data in writes:
        image[at : at + len(data)] = data
    rows = spark.createDataFrame(writes, "f int, seq int, offset bigint, data binary")
    got = writing.offset_image(rows, "f", "seq", spark.createDataFrame([(0, 60)], "f int, total_size bigint")).first()
    assert bytes(got["content"]) == bytes(image) and got["bytes_written"] == sum(len(w[3]) for w in writes)


def test_indexed_writes(spark):
    rows = spark.createDataFrame([(0, 2, b"ccc"), (0, 0, b"a"), (0, 1, b"bb")], "f int, i bigint, data binary")
    want = spark.createDataFrame([(0, 3)], "f int, block_count bigint")
    got = writing.indexed(rows, "f", "i", want).orderBy("i").collect()
    assert [(r["offset"], r["len"]) for r in got] == [(0, 1), (1, 2), (3, 3)]
    with pytest.raises(Exception, match="missing"):
        writing.indexed(rows.where("i <> 1"), "f", "i", want).collect()


def test_known_digests():
    assert digests.xxh3_hex(b"") == "c294d3380580062d"
    vector = bytes(i % 251 for i in range(2049))
    assert blake3.blake3_hex(b"") == "af1349b9f5f9a1a6a0404dea36dcc9499bcb25c9adc112b7cc9a93cae41f3262"
    assert blake3.blake3_hex(vector[:1025]) == "d00278ae47eb27b34faecf67b4fe263f82d5412916c1ffd97c8cb7fb814b8444"
    assert blake3.blake3_hex(vector) == "5f4d72f40d7a5f82b15ca2b2e44b1de3c2ef86c426c95c1af0b6879522563030"
    assert digests.page_checksum(b"\1" + b"\0" * 4095 + b"\2") == 133
    assert digests.fold_digests(["01" + "00" * 31, "00" * 32]) == 1 << 7


def test_containers(spark, tmp_path):
    data = pattern(10_000)
    packed = containers.compress(data, 1024)
    assert containers.decompress(packed) == data and containers.metadata(packed)[:2] == (1024, 10_000)
    assert containers.decompress(containers.compress(b"", 1024)) == b""
    with pytest.raises(ValueError):
        containers.decompress(packed[:-1])
    (tmp_path / "c").write_bytes(packed)
    rows = spark.read.format("zstd_blocks").load(str(tmp_path / "c")).orderBy("block_index").collect()
    assert b"".join(bytes(r["data"]) for r in rows) == data


def test_scrub_stream(spark, tmp_path):
    from blockloom.streaming import scrub

    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a").write_bytes(pattern(5000))
    stream = scrub.digested(scrub.arriving(spark, str(tmp_path / "in")), 4096)
    scrub.start(stream, str(tmp_path / "out"), str(tmp_path / "check")).awaitTermination(120)
    row = spark.read.parquet(str(tmp_path / "out")).first()
    assert row["blocks"] == 2 and row["length"] == 5000
    assert row["hash_of_hashes"] == api.open_file(spark, str(tmp_path / "in" / "a")).manifest(block_size=4096)["hash_of_hashes"]


def test_fill_is_seeded(spark):
    a, b = (writing.fill(spark, 64, 150, 9).orderBy("offset").collect() for _ in range(2))
    assert a == b and sum(len(r["data"]) for r in a) == 150


def test_whole_file_digests(spark, target, tmp_path):
    import hashlib

    assert api.digest_file(spark, target, block_size=4096) == hashlib.sha256(pattern(40_000)).hexdigest()
    for n in (0, 1, 1024, 1025, 5000, 40_000):
        path = tmp_path / "d"
        path.write_bytes(pattern(n))
        assert api.digest_file(spark, str(path), "blake3", 2048) == blake3.blake3_hex(pattern(n))


def test_writer_handles(spark, tmp_path):
    path = str(tmp_path / "w")
    writer = api.ParallelWriter.indexed(spark, path, 3)
    writer.write_frame(spark.createDataFrame([(2, b"ccc"), (0, b"a")], "index bigint, data binary"))
    with pytest.raises(ValueError, match="indices"):
        writer.write_at_offset(0, b"x")
    writer.write_at_index(1, b"bb")
    assert writer.finish() == api.WriteReport(6, [(0, 1), (1, 2), (3, 3)]) and api.read_file(path) == b"abbccc"
    with pytest.raises(RuntimeError):
        writer.finish()
    missing = api.ParallelWriter.indexed(spark, path, 2)
    missing.write_at_index(1, b"x")
    with pytest.raises(ValueError, match="1 missing"):
        missing.finish()
    writer = api.ParallelWriter.fixed_size(spark, path, 8, truncate=False)
    writer.write_at_offset(1, b"XYZ")
    writer.write_at_offset(2, b"!")
    assert writer.finish().bytes_written == 4 and api.read_file(path) == b"aX!Zcc\0\0"
    with api.SequentialWriter(path) as w:
        assert [w.append(b"ab"), w.append(b"c")] == [0, 2]
    with api.SequentialWriter(path, append=True) as w:
        assert w.append(b"d") == 3
    assert api.read_file(path) == b"abcd"


def chain(n: int) -> list[bytes]:
    """Different blocks."""
    return [i.to_bytes(4, "little") * 1024 for i in range(n)]


def test_verified_blocks_do_not_carry_the_manifests_of_their_file(spark, tmp_path):
    """A block's row holds what the manifests say of this block, so it does not grow with the file."""
    import hashlib

    from blockloom.operators import manifests, verify

    path, blocks = str(tmp_path / "many"), chain(300)
    api.write_file(path, b"".join(blocks))
    made = api.hash_file(spark, path, "sha256", 4096)
    bad = range(0, 300, 4)
    for i in bad:
        damage(path, i * 4096 + 9)
    shape = f"struct<{manifests.MANIFEST.replace(' ', ':').replace(',:', ',')}>"
    now = spark.createDataFrame([(0, api.open_file(spark, path).manifest("sha256", 4096))], f"file_id bigint, manifest {shape}")
    stored = spark.createDataFrame([(0, i, made) for i in range(3)], f"file_id bigint, replica int, manifest {shape}")

    def generators(node) -> list:
        children = node.children()
        return [node] * (node.nodeName() == "Generate") + [g for i in range(children.size()) for g in generators(children.apply(i))]

    for frame in (verify.verify_report(now, stored), verify.verify_blocks(now, stored)):
        found = generators(frame._jdf.queryExecution().optimizedPlan())
        carried = [g.requiredChildOutput().apply(i).dataType().simpleString() for g in found for i in range(g.requiredChildOutput().size())]
        assert found and set(carried) <= {"bigint", "int"}
    report = api.verify_file(spark, path)
    assert (report.total_blocks, report.ok_blocks, report.size_matches) == (300, 225, True)
    assert [b["block_index"] for b in report.bad_blocks] == list(bad)
    flipped = [b[:9] + bytes(x ^ 0xFF for x in b[9:13]) + b[13:] for b in blocks]
    assert all(b["current_hash"] == hashlib.sha256(flipped[b["block_index"]]).hexdigest() and b["elected_hash"] == made["block_hashes"][b["block_index"]] for b in report.bad_blocks)


def test_a_whole_file_digest_shuffles_nothing(spark, target, monkeypatch):
    """Else all bytes of a file are sorted in one task."""
    import hashlib

    def refused(*_):
        raise AssertionError("blocks are dealt out")

    monkeypatch.setattr(type(spark.range(0)), "repartition", refused)
    assert api.digest_file(spark, target, block_size=4096) == hashlib.sha256(pattern(40_000)).hexdigest()
    assert api.digest_file(spark, target, "blake3", 4096) == blake3.blake3_hex(pattern(40_000))


def test_batches_of_blocks_are_small(spark, tmp_path):
    """Workers that read and workers that write hold a batch each, and stay."""
    import pyarrow as pa

    path, block = str(tmp_path / "long"), 1 << 16
    api.write_file(path, b"")
    os.truncate(path, 20 << 20)

    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_pydict({"bytes": pa.array([b.nbytes], pa.int64())})

    found = [r["bytes"] for r in api.open_file(spark, path, block).blocks().select("data").mapInArrow(sizes, "bytes bigint").collect()]
    assert sum(found) >= 20 << 20 and max(found) <= (4 << 20) + 2 * block


def test_ranges_over_spans(spark):
    """The values of a span are sorted and buffered by one task, so blocks of 64 KiB must fit its share of a heap."""
    rng, n = random.Random(3), 10_000
    assert writing.SPAN * (1 << 16) <= 256 << 20 and n > 2 * writing.SPAN
    order = rng.sample(range(-n, 2 * n), n)
    rows = [(0, i, bytes(rng.randrange(4))) for i in order]
    at, want = 0, {}
    for _, i, data in sorted(rows, key=lambda r: r[1]):
        want[i] = (at, len(data))
        at += len(data)
    placed = writing.append_ranges(spark.createDataFrame(rows, "f int, i bigint, data binary"), "f", "i")
    assert {r["i"]: (r["offset"], r["len"]) for r in placed.select("i", "offset", "len").collect()} == want
