"""Byte-level BPE: two-tier encoding, and decoding.

Tier one is a minimal perfect hash over the vocabulary's byte strings: one
probe tells whether a whole pre-token is a token. Tier two merges the bytes
of the pre-tokens it misses: a doubly linked list of byte spans and a heap of
the ranks of neighbouring spans.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame

from .common import Memo, batches, only, strings

#: Pre-tokens that a worker remembers; only speed depends on it.
MEMO_TOKENS = 300_000
#: Longer texts are matched piece by piece, to hold few matches at once.
STREAM_CHARS = 1_000_000
_MASK = (1 << 64) - 1


class PerfectHash:
    """A minimal perfect hash: n keys, n slots, one displacement per bucket.

    Keys fall into buckets by one half of a 128-bit hash. Buckets of several
    keys, the largest first, get the first displacement that sends their keys
    to free slots; a bucket of one key stores its slot directly, as a
    negative number.
    """

    def __init__(self, keys: list[bytes], per_bucket: int = 3):
        if len(set(keys)) != len(keys):
            raise ValueError("keys repeat")
        self.n = n = max(1, len(keys))
        self.buckets = max(1, n // per_bucket)
        hashes = [self._halves(k) for k in keys]
        base = np.array([a for a, _ in hashes], np.uint64)
        stride = np.array([b | 1 for _, b in hashes], np.uint64)
        groups: dict[int, list[int]] = {}
        for i, (a, _) in enumerate(hashes):
            groups.setdefault(a % self.buckets, []).append(i)
        self.shift = np.zeros(self.buckets, np.int64)
        self.slot_key: list[int] = [-1] * n
        taken = np.zeros(n, bool)
        alone = []
        for bucket, members in sorted(groups.items(), key=lambda g: -len(g[1])):
            if len(members) == 1:
                alone.append((bucket, members[0]))
                continue
            d, slots = self._displace(base[members], stride[members], taken)
            self.shift[bucket] = d
            taken[slots] = True
            for i, s in zip(members, slots.tolist(), strict=True):
                self.slot_key[s] = i
        free = (s for s in range(n) if self.slot_key[s] < 0)
        for (bucket, i), s in zip(alone, free, strict=False):
            self.shift[bucket] = -1 - s
            self.slot_key[s] = i
        self.keys = keys
        self._shift = self.shift.tolist()

    @staticmethod
    def _halves(key: bytes) -> tuple[int, int]:
        whole = xxhash.xxh3_128_intdigest(key)
        return whole >> 64, whole & _MASK

    def _displace(self, base: np.ndarray, stride: np.ndarray, taken: np.ndarray) -> tuple[int, np.ndarray]:
        """The first displacement that sends the keys to different free slots."""
        step, first = 64, 0
        while first <= 64 * self.n:
            d = np.arange(first, first + step, dtype=np.uint64)
            slots = (((base[:, None] + d * stride[:, None]) >> np.uint64(32)) * np.uint64(self.n) >> np.uint64(32)).astype(np.int64)
            good = ~taken[slots].any(0)
            for c in np.flatnonzero(good):
                if len(set(slots[:, c].tolist())) == len(base):
                    return first + int(c), slots[:, c]
            first += step
            step = min(8192, step * 4)
        raise ValueError("no displacement found")

    def find(self, key: bytes) -> int:
        """The key's place in ``keys``, or -1."""
        whole = xxhash.xxh3_128_intdigest(key)
        a = whole >> 64
        d = self._shift[a % self.buckets]
        i = self.slot_key[-1 - d if d < 0 else ((a + d * (whole & _MASK | 1) & _MASK) >> 32) * self.n >> 32]
        return i if i >= 0 and self.keys[i] == key else -1


class ByteBPE:
    """Encodes and decodes by a rank file (``base64 rank`` lines)."""

    def __init__(self, path: str, pattern: str):
        self.ranks: dict[bytes, int] = {}
        with open(path, "rb") as f:
            for line in f:
                if line.strip():
                    token, rank = line.split()
                    self.ranks[base64.b64decode(token)] = int(rank)
        self.hash = PerfectHash(list(self.ranks))
        self.ids = list(self.ranks.values())
        self.pieces: dict[int, bytes] = {i: t for t, i in self.ranks.items()}
        self.pattern = regex.compile(pattern)
        self.memo = Memo(self._packed, MEMO_TOKENS)

    def piece_ids(self, piece: bytes) -> list[int]:
        """The ids of one pre-token."""
        at = self.hash.find(piece)
        return [self.ids[at]] if at >= 0 else self._merge(piece)

    def _merge(self, piece: bytes) -> list[int]:
        rank, n = self.ranks.get, len(piece)
        if n < 2:
            return [self.ranks[piece]] if n else []
        nxt, prv = list(range(1, n + 1)), list(range(-1, n - 1))
        end = list(range(1, n + 1))  # where the span that begins here ends; 0: merged into another
        heap = [(r, i, i + 1, i + 2) for i in range(n - 1) if (r := rank(piece[i : i + 2])) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, j, stop = heapq.heappop(heap)  # spans [i, j) and [j, stop)
            if end[i] != j or j >= n or end[j] != stop:
                continue
            end[i], end[j] = stop, 0
            k = nxt[i] = nxt[j]
            if k < n:
                prv[k] = i
                if (r := rank(piece[i : end[k]])) is not None:
                    heapq.heappush(heap, (r, i, k, end[k]))
            p = prv[i]
            if p >= 0 and (r := rank(piece[p:stop])) is not None:
                heapq.heappush(heap, (r, p, i, stop))
        out, i = [], 0
        while i < n:
            out.append(self.ranks[piece[i : end[i]]])
            i = nxt[i]
        return out

    def _packed(self, token: str) -> bytes:
        return np.array(self.piece_ids(token.encode()), "<u4").tobytes()

    def encode_packed(self, text: str) -> bytes:
        """The ids as little-endian unsigned 32-bit integers."""
        if len(text) <= STREAM_CHARS:
            return b"".join(map(self.memo.__getitem__, self.pattern.findall(text)))
        out = bytearray()
        for m in self.pattern.finditer(text):
            token = m[0]
            out += self.memo[token] if len(token) < 200 else self._packed(token)
        return bytes(out)

    def encode(self, text: str) -> list[int]:
        return np.frombuffer(self.encode_packed(text), "<u4").tolist()

    def decode(self, ids) -> bytes:
        return b"".join(map(self.pieces.__getitem__, ids))


@lru_cache(maxsize=2)
def codec(path: str, pattern: str) -> ByteBPE:
    return ByteBPE(path, pattern)


def bpe_encode(docs: DataFrame, ranks: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, ids`` for every text: ids as little-endian unsigned 32-bit integers in a binary.

    Null and empty texts have no ids; repeated rows are encoded each; other
    columns are ignored. A map without any shuffle.
    """

    def run(rows):
        bpe = codec(ranks, pattern)
        for batch in batches(rows):
            ids = [bpe.encode_packed(t) if t else b"" for t in strings(batch.column(1))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.binary())], names=["doc_id", "ids"])

    kind = docs.schema[id_col].dataType.simpleString()
    return only(docs, id_col, text_col).mapInArrow(run, f"doc_id {kind}, ids binary")


def bpe_decode(encoded: DataFrame, ranks: str, pattern: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """``doc_id, n_tokens, ids, bytes`` from packed ids; null ids decode to nothing."""

    def run(rows):
        bpe = codec(ranks, pattern)
        for batch in batches(rows, text=batch_name):
            packed = [x or b"" for x in batch.column(1).to_pylist()]
            raw = [bpe.decode(np.frombuffer(x, "<u4").tolist()) for x in packed]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([len(x) // 4 for x in packed], pa.int64()), pa.array(packed, pa.binary()), pa.array(raw, pa.binary())],
                names=["doc_id", "n_tokens", "ids", "bytes"],
            )

    batch_name = ids_col
    kind = encoded.schema[id_col].dataType.simpleString()
    return only(encoded, id_col, ids_col).mapInArrow(run, f"doc_id {kind}, n_tokens bigint, ids binary, bytes binary")


def bpe_digests(docs: DataFrame, ranks: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode, decode and digest every text in one pass over it.

    ``doc_id, n_tokens, ids_sha256, decoded_sha256``; the round trip never
    leaves the worker, so neither ids nor bytes are shipped.
    """

    def run(rows):
        bpe = codec(ranks, pattern)
        for batch in batches(rows):
            counts, of_ids, of_bytes = [], [], []
            for text in strings(batch.column(1)):
                packed = bpe.encode_packed(text) if text else b""
                counts.append(len(packed) // 4)
                of_ids.append(hashlib.sha256(packed).hexdigest())
                of_bytes.append(hashlib.sha256(bpe.decode(np.frombuffer(packed, "<u4").tolist())).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(counts, pa.int64()), pa.array(of_ids), pa.array(of_bytes)],
                names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    kind = docs.schema[id_col].dataType.simpleString()
    return only(docs, id_col, text_col).mapInArrow(run, f"doc_id {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string")
