"""Packing by non-negative least squares over a length histogram.

Documents are tokenised once. Each is cut into full windows and one rest
below the window. The histogram of rests, over bins of ``BIN`` tokens, is then
covered by strategies: multisets of at most ``DEPTH`` bins that fill a window
exactly. Non-negative least squares solves how often to repeat each strategy,
the counts are rounded down, and every rest takes a slot of its bin. Only the
histogram (at most window / BIN numbers) ever reaches the driver.

What the rounding leaves over, and the few tokens by which slots exceed their
rests, is packed greedily: leftover rests are cut to fill the gaps, first the
gaps of the strategies' windows, then new windows, so that no sequence but the
last is padded.
"""

from __future__ import annotations

import base64
import math
import re
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import tiktoken
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .byte_bpe import codec
from .common import Stage, batches, only, strings

WINDOW = 2048
#: Tokens of a histogram bin, and most rests in a strategy.
BIN = 32
DEPTH = 3
#: Most leftovers whose keys are sent to every task, at some tens of bytes each.
SENT_KEYS = 500_000


def strategies(bins: int, depth: int = DEPTH) -> np.ndarray:
    """All multisets of at most ``depth`` bin numbers (from 1) that sum to ``bins``, zero padded."""
    found = [(bins, 0, 0)]
    if depth >= 2:
        found += [(a, bins - a, 0) for a in range((bins + 1) // 2, bins)]
    if depth >= 3:
        found += [(a, b, bins - a - b) for a in range(1, bins) for b in range(1, a + 1) if 1 <= bins - a - b <= b]
    return np.array(found, np.int64)


def nnls(a: np.ndarray, b: np.ndarray, rounds: int = 400) -> np.ndarray:
    """x >= 0 that minimises |a x - b|, by the active-set method of Lawson and Hanson."""
    n = a.shape[1]
    x, passive = np.zeros(n), np.zeros(n, bool)
    slack = 1e-9 * max(1.0, float(np.abs(a.T @ b).max(initial=0)))
    for _ in range(rounds):
        gain = a.T @ (b - a @ x)
        gain[passive] = -np.inf
        if gain.max(initial=-np.inf) <= slack:
            break
        passive[int(np.argmax(gain))] = True
        while True:
            s = np.zeros(n)
            s[passive] = np.linalg.lstsq(a[:, passive], b, rcond=None)[0]
            if s[passive].min() > 0:
                x = s
                break
            bad = passive & (s <= 0)
            step = np.min(x[bad] / (x[bad] - s[bad] + 1e-300))
            x = x + step * (s - x)
            passive &= x > 1e-12
            x[~passive] = 0
            if not passive.any():
                return x
    return np.maximum(x, 0)


def plan(histogram: np.ndarray, depth: int = DEPTH) -> list[tuple[list[int], int]]:
    """(bins of a window, repeats) for a histogram of rests; index i counts bin i + 1.

    Rests that find no slot are packed greedily, so the counts are rounded
    down and never exceed the histogram.
    """
    bins = len(histogram)
    combos = strategies(bins, depth)
    combos = combos[[all(histogram[v - 1] > 0 for v in c if v) for c in combos.tolist()]]
    if not len(combos):
        return []
    a = np.zeros((bins, len(combos)))
    for j, c in enumerate(combos.tolist()):
        for v in c:
            if v:
                a[v - 1, j] += 1
    scale = float(histogram.max(initial=1)) or 1.0
    x = nnls(a, histogram / scale) * scale
    left, out = histogram.astype(np.int64).copy(), []
    for j in np.argsort(-x, kind="stable"):
        parts = [v for v in combos[j].tolist() if v]
        need = np.bincount(parts, minlength=bins + 1)[1:]
        used = need > 0
        times = min(int(x[j] + 1e-6), int((left[used] // need[used]).min()))
        if times > 0:
            left -= times * need
            out.append((sorted(parts, reverse=True), times))
    return out


@lru_cache(maxsize=2)
def _encoder(ranks_path: str, pattern: str, special: tuple[tuple[str, int], ...]) -> tiktoken.Encoding:
    with open(ranks_path, "rb") as f:
        ranks = {base64.b64decode(t): int(r) for t, r in map(bytes.split, filter(None, map(bytes.strip, f)))}
    return tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens=dict(special))


def _ids(text: str, enc: tiktoken.Encoding, ranks_path: str, pattern: str, special: dict[str, int]) -> np.ndarray:
    """The text's ids. Runs of white space too long for the library's matcher are left to our own encoder."""
    try:
        return enc.encode_to_numpy(text, allowed_special="all")
    except ValueError:
        own, out = codec(ranks_path, pattern), []
        for part in re.split("(" + "|".join(map(re.escape, special)) + ")", text) if special else [text]:
            out.append([special[part]] if part in special else np.frombuffer(own.encode_packed(part), "<u4"))
        return np.concatenate([np.asarray(o, np.uint32) for o in out])


def tokenized(
    docs: DataFrame, ranks_path: str, pattern: str, end_id: int, special: dict[str, int], window: int = WINDOW,
    id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """One row per window-sized cut of each document, with its ids.

    The ids equal those of the tokenizer file of the same vocabulary, which
    also reads the special strings inside a text as their ids. Columns:
    ``part`` (the task), ``row`` (of the document within it), ``doc_id``,
    ``cut`` (0, 1, ..), ``length``, ``crc`` of the cut's ids, ``doc_tokens``
    and, for the rest below a window, its ``ids`` (little-endian, 16 bits
    where the vocabulary allows it): only rests may be cut again.
    """
    known = tuple(sorted(special.items()))

    def run(rows):
        from pyspark import TaskContext

        enc, task = _encoder(ranks_path, pattern, known), TaskContext.get().partitionId()
        kept, row = _kept(max(enc.max_token_value, end_id)), 0
        for batch in batches(rows, 2_000_000):
            out: tuple[list, ...] = ([], [], [], [], [], [], [])
            for doc_id, text in zip(batch.column(0).to_pylist(), strings(batch.column(1)), strict=True):
                ids = np.append(_ids(text or "", enc, ranks_path, pattern, special), end_id).astype("<u4")
                for cut, at in enumerate(range(0, len(ids), window)):
                    piece = ids[at : at + window]
                    stored = piece.astype(kept).tobytes() if len(piece) < window else None
                    values = (row, doc_id, cut, len(piece), zlib.crc32(piece), len(ids), stored)
                    for column, value in zip(out, values, strict=True):
                        column.append(value)
                row += 1
            n = len(out[0])
            yield pa.RecordBatch.from_arrays(
                [pa.array([task] * n, pa.int64()), pa.array(out[0], pa.int64()), pa.array(out[1], batch.schema.field(0).type)]
                + [pa.array(c, pa.int64()) for c in out[2:6]] + [pa.array(out[6], pa.binary())],
                names=["part", "row", "doc_id", "cut", "length", "crc", "doc_tokens", "ids"],
            )

    kind = docs.schema[id_col].dataType.simpleString()
    return only(docs, id_col, text_col).mapInArrow(
        run, f"part bigint, row bigint, doc_id {kind}, cut bigint, length bigint, crc bigint, doc_tokens bigint, ids binary"
    )


def _kept(most: int) -> str:
    return "<u2" if most < 1 << 16 else "<u4"


def _before(df: DataFrame, keys: list[str], what: Column, order: list[str], buckets: int) -> Column | DataFrame:
    """``df`` with ``before``: the sum of ``what`` over the key's earlier rows.

    Rows are dealt to buckets by a hash of their order columns, so no key,
    however common, is summed in one task: a running sum within the bucket
    follows the sum of the key's earlier buckets.
    """
    df = df.withColumns({"bucket": F.pmod(F.xxhash64(*order), F.lit(buckets)), "amount": what})
    sums = df.groupBy(*keys, "bucket").agg(F.sum("amount").alias("amount"))
    earlier = W.partitionBy(*keys).orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)
    sums = sums.select(*keys, "bucket", F.coalesce(F.sum("amount").over(earlier), F.lit(0)).alias("base"))
    within = W.partitionBy(*keys, "bucket").orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    return df.join(sums, [*keys, "bucket"]).withColumn(
        "before", F.col("base") + F.coalesce(F.sum("amount").over(within), F.lit(0))
    ).drop("bucket", "amount", "base")


def pack(
    spark: SparkSession, docs: DataFrame, ranks_path: str, pattern: str, end_id: int, special: dict[str, int],
    window: int = WINDOW, bin_size: int = BIN, id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """Pack all documents into sequences of at most ``window`` ids.

    Returns one row per piece: ``doc_id, start, length, ids_crc32, doc_tokens,
    sequence_id, offset``. Every id of every document lies in exactly one
    piece; offsets of a sequence have no gaps; sequence ids count from 0. All
    sequences but the last are full, so nothing else is padded.

    Null and empty texts are one end id each; repeated rows are packed each,
    as documents of their own; a null id stays null; an empty table has no
    pieces; other columns are ignored. Ids are written once, for rests only,
    and shuffled once, for leftovers only unless these exceed ``SENT_KEYS``.
    """
    if window % bin_size:
        raise ValueError("the window must be a multiple of the bin size")
    stage = Stage(spark, "pack")
    cuts = stage.put(tokenized(docs, ranks_path, pattern, end_id, special, window, id_col, text_col), "cuts")
    bins = window // bin_size
    size = F.col("length")
    full = cuts.where(size == window).select("part", "row", "doc_id", "cut", "length", "crc", "doc_tokens")
    rest = cuts.where(size < window).select(
        "part", "row", "doc_id", "cut", "length", "crc", "doc_tokens", F.ceil(size / bin_size).cast("int").alias("bin")
    )
    # At most one row for each bin reaches the driver, and one for the full windows.
    binned = cuts.groupBy(F.ceil(size / bin_size).cast("int").alias("bin"), (size == window).alias("whole")).agg(F.count("*").alias("n")).collect()
    n_full = sum(r["n"] for r in binned if r["whole"])
    counted = {r["bin"]: r["n"] for r in binned if not r["whole"]}
    histogram = np.array([counted.get(b + 1, 0) for b in range(bins)], np.int64)

    # Slots: ranges of a bin's ranks, and the windows and places that they stand for.
    slots, used, sequence = [], [0] * (bins + 1), n_full
    for parts, times in plan(histogram):
        for place, b in enumerate(parts):
            slots.append((b, used[b], used[b] + times, sequence, place))
            used[b] += times
        sequence += times
    slots = slots or [(0, 0, 0, 0, 0)]

    def buckets(n: int) -> int:
        return max(1, math.isqrt(n))  # as many buckets as rows in one: both levels of a sum stay small

    ranked = _before(rest, ["bin"], F.lit(1), ["part", "row"], buckets(int(histogram.sum())))
    # The slots are at most DEPTH for each strategy in use, and strategies in use are about as many as bins.
    hit = (F.col("bin") == F.col("s_bin")) & (F.col("before") >= F.col("first")) & (F.col("before") < F.col("stop"))
    slot_table = F.broadcast(spark.createDataFrame(slots, "s_bin int, first bigint, stop bigint, seq0 bigint, place int"))
    placed = ranked.join(slot_table, hit, "left").withColumn("sequence_id", F.col("seq0") + F.col("before") - F.col("first"))
    placed = stage.put(placed.drop("s_bin", "first", "stop", "seq0", "before", "bin"), "placed")

    # Room that the planned windows leave, and the leftovers that can fill it. A window
    # that is given up adds exactly its size to the difference, so these suffice:
    sums = placed.agg(
        F.sum(F.when(F.col("sequence_id").isNotNull(), size)), F.sum(F.when(F.col("sequence_id").isNull(), size)), F.count("*")
    ).first()
    room = (sequence - n_full) * window - (sums[0] or 0)
    given_up = max(0, -(-(room - (sums[1] or 0)) // window))
    end = sequence - given_up
    seated = F.coalesce(F.col("sequence_id") < end, F.lit(False))
    planned, loose = placed.where(seated), placed.where(~seated).drop("sequence_id", "place", "crc")

    whole = _before(full, [], F.lit(1), ["part", "row", "cut"], buckets(n_full)).select(
        "doc_id", "cut", F.lit(0).alias("from"), "length", "crc", "doc_tokens", F.col("before").alias("sequence_id"), F.lit(0).cast("bigint").alias("offset")
    )
    in_window = W.partitionBy("sequence_id").orderBy("place").rowsBetween(W.unboundedPreceding, -1)
    whole = whole.unionByName(planned.select(
        "doc_id", "cut", F.lit(0).alias("from"), "length", "crc", "doc_tokens", "sequence_id",
        F.coalesce(F.sum("length").over(in_window), F.lit(0)).alias("offset"),
    ))

    # Two lines of tokens: the leftovers end to end, and the places for them end to end:
    # first the room in planned windows, then new windows.
    filled = planned.groupBy("sequence_id").agg(F.sum("length").alias("filled")).where(F.col("filled") < window)
    gaps = _before(filled, [], F.lit(window) - F.col("filled"), ["sequence_id"], buckets(end - n_full)).select(
        "sequence_id", "filled", F.col("before").alias("g0"), (F.col("before") + window - F.col("filled")).alias("g1")
    )
    gaps = stage.put(gaps, "gaps")
    room = gaps.agg(F.max("g1")).first()[0] or 0
    line = _before(loose, [], size, ["part", "row"], buckets(sums[2])).withColumn("after", F.col("before") + size)
    line = stage.put(line, "line")

    def chunks(a: str, b: str) -> Column:
        return F.explode(F.sequence(F.floor(F.col(a) / window), F.floor((F.col(b) - 1) / window))).alias("chunk")

    into_gaps = (
        line.where(F.col("before") < room).select("*", chunks("before", "after"))
        .join(gaps.select("*", chunks("g0", "g1")), "chunk")
        .where((F.col("g0") < F.col("after")) & (F.col("before") < F.col("g1")))
        .withColumns({"lo": F.greatest("g0", "before"), "hi": F.least("g1", "after")})
        .where(F.floor(F.col("lo") / window) == F.col("chunk"))  # an overlap of two chunks counts once
        .select("part", "row", "before", "lo", "hi", "sequence_id", (F.col("filled") + F.col("lo") - F.col("g0")).alias("offset"))
    )
    behind = F.greatest(F.col("before"), F.lit(room)) - room
    edge = F.col("w") * window + room
    into_new = (
        line.where(F.col("after") > room)
        .withColumn("w", F.explode(F.sequence(F.floor(behind / window), F.floor((F.col("after") - 1 - room) / window))))
        .withColumns({"lo": F.greatest(F.col("before"), F.lit(room), edge), "hi": F.least(F.col("after"), edge + window)})
        .select("part", "row", "before", "lo", "hi", (F.col("w") + end).alias("sequence_id"), (F.col("lo") - edge).alias("offset"))
    )
    top = max(end_id, _encoder(ranks_path, pattern, tuple(sorted(special.items()))).max_token_value)
    kept = _kept(top)

    def sums_of(rows):
        for batch in batches(rows, 2_000_000, "ids"):
            lists = batch.column("pieces")
            of, flat = pc.list_parent_indices(lists), pc.list_flatten(lists)
            ids = batch.column("ids").to_pylist()
            crcs = [
                zlib.crc32(np.frombuffer(ids[i], kept)[a : a + n].astype("<u4"))
                for i, a, n in zip(of.to_pylist(), flat.field("from").to_pylist(), flat.field("length").to_pylist(), strict=True)
            ]
            names = ["doc_id", "cut", "doc_tokens"], ["from", "length", "sequence_id", "offset"]
            yield pa.RecordBatch.from_arrays(
                [batch.column(n).take(of) for n in names[0]] + [flat.field(n) for n in names[1]] + [pa.array(crcs, pa.int64())], names=[*names[0], *names[1], "crc"]
            )

    # One row for each leftover, which has at most a piece for each of its ids.
    pieces = into_gaps.unionByName(into_new).select(
        "part", "row", F.struct((F.col("lo") - F.col("before")).cast("int").alias("from"), (F.col("hi") - F.col("lo")).alias("length"), "sequence_id", "offset").alias("piece")
    ).groupBy("part", "row").agg(F.collect_list("piece").alias("pieces"))
    kind = docs.schema[id_col].dataType.simpleString()
    rests = cuts.where(size < window).select("part", "row", "doc_id", "cut", "doc_tokens", "ids")
    # Few rests are left over, so the others' ids need no exchange. A hash is a smaller key than
    # both columns; the join below is exact, and does alone if the leftovers are too many to send.
    if line.count() <= SENT_KEYS:
        key = F.xxhash64("part", "row").alias("key")
        rests = rests.select("*", key).join(F.broadcast(line.select(key)), "key", "left_semi").drop("key")
    cut_again = pieces.join(rests, ["part", "row"]).drop("part", "row").mapInArrow(
        sums_of, f"doc_id {kind}, cut bigint, doc_tokens bigint, from int, length bigint, sequence_id bigint, offset bigint, crc bigint"
    )
    return whole.unionByName(cut_again).select(
        "doc_id", (F.col("cut") * window + F.col("from")).cast("bigint").alias("start"), F.col("length").cast("bigint").alias("length"),
        F.col("crc").alias("ids_crc32"), "doc_tokens", "sequence_id", F.col("offset").cast("bigint").alias("offset"),
    )
