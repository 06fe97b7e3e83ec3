"""Elections, comparison, search and scalar expressions against plain models."""

import random

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from blockloom.functions import binary
from blockloom.operators import blocks, compare, copying, election, lookup, manifests, recover, search

ROWS = "files array<string>, manifests array<struct<hash:string,intact:boolean>>"
relaxed = settings(max_examples=10, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])

GOLDEN = [
    (["111", "333"], [("111", True), ("999", False)], "111", 0, "IntactHash"),
    (["222", "333"], [("111", True), ("111", True)], "111", None, "IntactHashWithoutMatchingBlock"),
    (["111", "222"], [("111", True), ("222", True)], None, None, "ConflictingIntactHashes"),
    (["444", "444", "999"], [], "444", 0, "FileAndFileAgreement"),
    (["555", "999"], [("555", False), ("777", False)], "555", 0, "FileAndManifestAgreement"),
    (["222", "333"], [("111", False), ("111", False)], "111", None, "ManifestOnlyAgreement"),
    ([None, None], [], None, None, "NoBlockHashFound"),
    (["111", "999", "999"], [("111", True)], None, None, "ConflictingIntactHashes"),
]


def test_golden_elections(spark):
    rows = spark.createDataFrame([(g[0], g[1]) for g in GOLDEN], ROWS).coalesce(1).withColumn("i", F.monotonically_increasing_id())
    for row, (files, stored, elected, source, outcome) in zip(election.decide(rows).orderBy("i").collect(), GOLDEN, strict=True):
        assert (row["elected_hash"], row["repair_source_index"], row["basis"] or row["failure"]) == (elected, source, outcome)
        got = recover.decide_one(files, stored)
        assert got[:2] == (elected, source) and (got[2] or got[3]) == outcome


def test_random_elections_equal_the_plain_model(spark):
    rng = random.Random(3)
    cases = [([rng.choice(["a", "b", "c", None]) for _ in range(rng.randrange(1, 5))], [(rng.choice("abc"), rng.random() < 0.4) for _ in range(rng.randrange(0, 5))]) for _ in range(400)]
    rows = spark.createDataFrame(cases, ROWS).coalesce(1).withColumn("i", F.monotonically_increasing_id())
    for row, case in zip(election.decide(rows).orderBy("i").collect(), cases, strict=True):
        assert (row["elected_hash"], row["repair_source_index"], row["basis"], row["failure"]) == recover.decide_one(*case), case


def test_five_copies_are_decided_in_turn(spark):
    """Here one decision for all targets would repair what decisions in turn cannot."""
    import pandas as pd

    stored = [{"hash": "0", "intact": True}] + [{"hash": "0", "intact": False}] * 2 + [{"hash": h, "intact": False} for h in "1111222 2".replace(" ", "")]
    frame = pd.DataFrame([(0, 0, ["0", "2", "2", "1", "1"], stored)], columns=["file_id", "block_index", "files", "manifests"])
    got = next(recover._in_turn(iter([frame])))
    assert got.failure.tolist()[2:] == ["ConflictingIntactHashes"] * 3 and got.elected_hash.tolist()[1] == "0"


@relaxed
@given(data=st.binary(max_size=300), size=st.integers(1, 70))
def test_blocks_rebuild_any_content(spark, data, size):
    files = spark.createDataFrame([(1, data)], "file_id bigint, content binary")
    rows = blocks.split(files, size).orderBy("block_index").collect()
    assert b"".join(bytes(r["data"]) for r in rows) == data and len(rows) == -(-len(data) // size)


def grep_model(data: bytes, pattern: bytes, size: int) -> set[int]:
    parts, edge, out = [(i, data[i : i + size]) for i in range(0, len(data), size)], len(pattern) - 1, set()

    def find(x: bytes):
        at = x.find(pattern)
        while at >= 0:
            yield at
            at = x.find(pattern, at + len(pattern))

    for i, x in parts:
        out |= {i + at for at in find(x)}
    for (i, x), (_, y) in zip(parts, parts[1:], strict=False):
        tail = x[max(0, len(x) - edge) :]
        out |= {i + len(x) - len(tail) + at for at in find(tail + y[:edge]) if at < len(tail) < at + len(pattern)}
    return out


@relaxed
@given(data=st.lists(st.sampled_from([97, 98, 255, 0]), max_size=120).map(bytes), pattern=st.lists(st.sampled_from([97, 98, 255]), min_size=1, max_size=4).map(bytes), size=st.integers(1, 40))
def test_blockwise_search_equals_the_model(spark, data, pattern, size):
    files = spark.createDataFrame([(1, data)], "file_id bigint, content binary")
    got = [r["offset"] for r in search.grep_blocks(blocks.split(files, size), pattern).collect()]
    assert sorted(got) == sorted(grep_model(data, pattern, size))
    assert sorted(r["offset"] for r in search.grep(files, pattern).collect()) == sorted(grep_model(data, pattern, 10_000))


@relaxed
@given(a=st.binary(max_size=60), b=st.binary(max_size=60), size=st.integers(1, 20))
def test_diff_and_delta_equal_the_model(spark, a, b, size):
    x, y = (spark.createDataFrame([(1, v)], "file_id bigint, content binary") for v in (a, b))
    row = compare.diff(x, y, size).first()
    assert row["first_mismatch"] == next((i for i, (p, q) in enumerate(zip(a, b, strict=False)) if p != q), None)
    result, stats = compare.delta_copy(x, y, size)
    assert b"".join(bytes(r["data"]) for r in result.orderBy("block_index").collect()) == a
    s = stats.first()
    assert s["kept"] + s["replaced"] + s["appended"] == -(-len(a) // size) and s["bytes_copied"] == len(a)


@relaxed
@given(data=st.binary(max_size=97), old=st.binary(max_size=80), bs=st.integers(1, 13), count=st.one_of(st.none(), st.integers(0, 9)), skip=st.integers(0, 9), seek=st.integers(0, 9), notrunc=st.booleans())
def test_dd_equals_slicing(spark, data, old, bs, count, skip, seek, notrunc):
    part = data[skip * bs :] if count is None else data[skip * bs :][: count * bs]
    base = old if notrunc else b""
    want = bytearray(base[: seek * bs].ljust(seek * bs, b"\0") + part)
    want += base[len(want) :]
    files = spark.createDataFrame([(1, data, old)], "file_id bigint, content binary, old binary")
    row = copying.dd(files, bs, count, skip, seek, notrunc, "old").first()
    assert bytes(row["content"]) == bytes(want) and row["bytes_copied"] == len(part)
    assert (row["full_records"], row["partial_records"]) == (len(part) // bs, int(len(part) % bs > 0))


def test_sizes(spark):
    texts = ["64k", "4GiB", "7", "1 KB", "12b", "9x", "", None, "99999999999999t", "8388607t"]
    got = [r["n"] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(binary.parse_size(F.col("t")).alias("n")).collect()]
    assert got == [65536, 4 << 30, 7, 1024, 12, None, None, None, None, 8388607 << 40]
    assert [binary.parse_size_value(t) for t in ("64k", "x")] == [65536, None]
    assert [binary.benchmark_size(f, 1 << 40, 2, 100, 1 << 30) for f in (1 << 40, 100_000, 0)] == [10_993_664, 28_672, 4096]
    row = spark.range(1).select(binary.format_bytes(F.lit(1536)), binary.first_gbps(F.lit("read 10 bytes in 2 s, 12.5 GB/s")), binary.first_gbps(F.lit("none"))).first()
    assert tuple(row) == ("1.50 KiB", 12.5, None)


def test_mounts_and_names(spark):
    mounts = spark.createDataFrame([("/",), ("/a",), ("/a/b",)], "mount_point string")
    got = lookup.longest_mount(spark.createDataFrame([("/a/b/c",), ("/ab",), ("/a",)], "path string"), mounts).collect()
    assert {r["path"]: r["mount_point"] for r in got} == {"/a/b/c": "/a/b", "/ab": "/", "/a": "/a"}
    names = spark.createDataFrame([("read x",), ("copy",)], "n string")
    assert names.where(lookup.selected(F.col("n"), ["read"])).count() == 1 and names.where(lookup.selected(F.col("n"), [])).count() == 2


def test_manifest_checks(spark):
    files = spark.createDataFrame([(1, b"a" * 5000), (2, b"")], "file_id bigint, content binary")
    for kind in ("sha256", "xxh3"):
        built = manifests.build(files, 4096, kind)
        assert [r["ok"] for r in built.select(manifests.intact(F.col("manifest")).alias("ok")).collect()] == [True, True]
        broken = built.withColumn("manifest", F.col("manifest").withField("bytes_hashed", F.lit(1).cast("bigint")))
        assert [r["ok"] for r in broken.select(manifests.intact(F.col("manifest")).alias("ok")).collect()] == [False, False]
    with pytest.raises(ValueError):
        manifests.build(files, 1000)
    other = manifests.build(files.where("file_id = 1"), 8192)
    with pytest.raises(Exception, match="disagree"):
        manifests.require_agreement(manifests.replicate(manifests.build(files, 4096)).unionByName(manifests.replicate(other))).collect()
