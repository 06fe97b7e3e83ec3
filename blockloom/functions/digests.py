"""Digests of blocks, ordered digests of digests, and folds."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Algorithms and the length of their hexadecimal digests.
HEX_LENGTH = {"sha256": 64, "xxh3": 16}


def xxh3_hex(data: bytes) -> str:
    """XXH3-64 with seed 0, its bytes stored in little-endian order."""
    import xxhash

    return xxhash.xxh3_64_intdigest(data).to_bytes(8, "little").hex()


def _blocks_xxh3(block_size: int):
    @F.pandas_udf(T.ArrayType(T.StringType()))
    def of(contents: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in contents:
            yield batch.map(lambda c: [xxh3_hex(c[i : i + block_size]) for i in range(0, len(c), block_size)] if c is not None else None)

    return of


@F.pandas_udf(T.StringType())
def xxh3(data: pd.Series) -> pd.Series:
    """The xxh3 digest of each value."""
    return data.map(lambda d: None if d is None else xxh3_hex(d))


def block_digest(data: Column, hash_type: str) -> Column:
    """The hexadecimal digest of one block."""
    return xxh3(data) if hash_type == "xxh3" else F.sha2(data, 256)


@F.pandas_udf(T.StringType())
def _root_xxh3(hashes: pd.Series) -> pd.Series:
    return hashes.map(lambda h: None if h is None else xxh3_hex(bytes.fromhex("".join(h))))


def block_hashes(content: Column, size: Column, block_size: int, hash_type: str) -> Column:
    """The hexadecimal digests of a value's blocks, in order; empty for an empty value.

    For sha256 a row expression: the array is built in place, so a manifest
    needs neither a row per block nor a shuffle.
    """
    if hash_type == "xxh3":
        return _blocks_xxh3(block_size)(content)
    if hash_type != "sha256":
        raise ValueError(f"unknown hash type {hash_type}")
    last = F.floor((size - 1) / block_size).cast("int")
    each = F.transform(F.sequence(F.lit(0), last), lambda i: F.sha2(F.substring(content, i * block_size + 1, block_size), 256))
    return F.when(size == 0, F.array().cast("array<string>")).otherwise(each)


def root_digest(hashes: Column, hash_type: str) -> Column:
    """The digest over the concatenated raw digests; empty text if any is malformed."""
    well = F.forall(hashes, lambda h: F.coalesce(h.rlike(f"^[0-9a-f]{{{HEX_LENGTH[hash_type]}}}$"), F.lit(False)))
    if hash_type == "xxh3":
        return F.when(well, _root_xxh3(hashes)).otherwise(F.lit(""))
    return F.when(well, F.sha2(F.unhex(F.array_join(hashes, "")), 256)).otherwise(F.lit(""))


def valid_digest(digest: Column, hash_type: Column) -> Column:
    """Whether a digest is lower-case hexadecimal of its algorithm's length."""
    sized = F.coalesce(*[F.when(hash_type == t, F.length(digest) == n) for t, n in HEX_LENGTH.items()], F.lit(False))
    return F.coalesce(sized & digest.rlike("^[0-9a-f]*$"), F.lit(False))


def fold_digests(hashes: list[str]) -> int:
    """Rotate left by 7, then xor the first 8 little-endian bytes of each digest, in order."""
    acc, mask = 0, (1 << 64) - 1
    for h in hashes:
        acc = ((acc << 7 | acc >> 57) & mask) ^ int.from_bytes(bytes.fromhex(h)[:8], "little")
    return acc


def page_checksum(data: bytes, step: int = 4096) -> int:
    """acc * 131 + byte in 64 bits, over every ``step``-th byte."""
    acc = 0
    for b in data[::step]:
        acc = (acc * 131 + b) & (1 << 64) - 1
    return acc


def digest_summary(hashes: Column) -> Column:
    """The fold of an ordered array of digests, as 16 hexadecimal digits."""
    def little_endian(h: Column) -> Column:
        return F.conv(F.concat(*[F.substring(h, 2 * i + 1, 2) for i in reversed(range(8))]), 16, -10).cast("bigint")

    def step(acc: Column, h: Column) -> Column:
        return F.shiftleft(acc, 7).bitwiseOR(F.shiftrightunsigned(acc, 57)).bitwiseXOR(little_endian(h))

    return F.lpad(F.lower(F.hex(F.aggregate(hashes, F.lit(0).cast("bigint"), step))), 16, "0")


@F.pandas_udf(T.StringType())
def checksum(data: pd.Series) -> pd.Series:
    """The page checksum, as 16 hexadecimal digits."""
    return data.map(lambda d: None if d is None else f"{page_checksum(d):016x}")


@F.pandas_udf(T.StringType())
def blake3(data: pd.Series) -> pd.Series:
    """BLAKE3 of each value."""
    from .blake3 import blake3_hex

    return data.map(lambda d: None if d is None else blake3_hex(d))


def sha256_stream(chunks) -> str:
    """SHA-256 over ordered chunks."""
    h = hashlib.sha256()
    for c in chunks:
        h.update(c)
    return h.hexdigest()


class Sha256Stream:
    def __init__(self):
        self.state = hashlib.sha256()

    def update(self, data: bytes) -> None:
        self.state.update(data)

    def hex(self) -> str:
        return self.state.hexdigest()


class Blake3Stream:
    """Keeps 32 bytes for each KiB; blocks but the last are whole KiB."""

    def __init__(self):
        self.values, self.count, self.only = [], 0, b""

    def update(self, data: bytes) -> None:
        from .blake3 import chunk_values

        self.only = data if self.count == 0 else b""
        self.values.append(chunk_values(data, self.count))
        self.count += self.values[-1].shape[1]

    def hex(self) -> str:
        from .blake3 import blake3_hex, fold

        if self.count <= 1:
            return blake3_hex(self.only)
        import numpy as np

        return fold(np.concatenate(self.values, 1))


STREAMS = {"sha256": Sha256Stream, "blake3": Blake3Stream}
