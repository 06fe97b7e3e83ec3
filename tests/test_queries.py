"""Every query of the engine against its SQL, on the smallest tables."""

import os

import duckdb
import pytest

import __spark_entry__ as entry
from blockloom.plans import queries

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="the driver's tables are not here")


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return c


def plain(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    shown = lambda v: bytes(v).hex() if isinstance(v, bytes | bytearray) else str(v)
    return sorted(tuple(shown(r[i]) for i in order) for r in rows)


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_equals_its_sql(spark, duck, name):
    got = queries.QUERIES[name](spark, DATA)
    want = duck.sql(queries.ORACLES[name])
    assert plain(got.columns, got.collect()) == plain(want.columns, want.fetchall())


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - set(queries.ORACLES)))
def test_other_queries_run(spark, name):
    assert queries.QUERIES[name](spark, DATA).count() > 0


def test_hashes_of_other_kinds_equal_their_libraries(spark):
    import xxhash

    rows = queries.documents(spark, DATA).collect()
    want = {}
    for r in rows:
        raw = bytes(r["content"])
        parts = b"".join(xxhash.xxh3_64_digest(raw[i : i + 1024])[::-1] for i in range(0, len(raw), 1024))
        want[r["file_id"]] = xxhash.xxh3_64_digest(parts)[::-1].hex()
    assert {r["file_id"]: r["hash_of_hashes"] for r in queries.QUERIES["hash_manifest_xxh3"](spark, DATA).collect()} == want


def test_many_copies_equal_the_plain_model(spark):
    """Targets decided one after the other, held against a literal loop."""
    from blockloom.operators import recover

    got: dict = {}
    for r in queries.QUERIES["recover_many_copies"](spark, DATA).collect():
        got.setdefault((r["file_id"], r["block_index"]), {})[r["copy_index"]] = (r["elected_hash"], r["state"])
    seen = queries._seen(spark, DATA, 5).collect()
    assert len(seen) == len(got)
    for row in seen:
        files, stored = list(row["files"]), [(m["hash"], m["intact"]) for m in row["manifests"]]
        for i, now in enumerate(list(files)):
            elected, source, _, _ = recover.decide_one(files, stored)
            state = "fine" if elected is not None and elected == now else "repaired" if source is not None and source != i else "failed"
            assert got[row["file_id"], row["block_index"]][i] == (elected, state)
            if state == "repaired":
                files[i] = elected


def test_entry(spark):
    assert entry.queries()[entry.FLAGSHIP] is queries.QUERIES[entry.FLAGSHIP]
    assert entry.entry(spark).count() == 200
