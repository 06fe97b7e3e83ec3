"""N-gram Jaccard self-join by chosen paths.

Each text becomes the set of its word shingles. Equal sets are one class; the
join works on one representative of each, weighted by its number of rows.

A run of the chosen-path recursion starts with all sets in one bucket and
splits a bucket by the min-hash token at a sampled coordinate: sets that share
the token go on together. A bucket of at most ``LEAF`` sets is a leaf and is
compared by brute force. Runs are repeated until a pair at the threshold is
missed with a probability below the target. How many that takes grows with the
number of splits, so the runs of a round end after a number of splits, and the
sets of buckets that are still large then go on to the next round: more runs,
each with fresh coordinates of its own. The first round's splits are taken at
once, as every set goes through them.

A large bucket whose sets are alike on average is not split. Buckets of that
kind which share sets make up a group, and a group is settled as a whole, once,
whatever the number of runs that met it. Each member is written as its
difference from the group's pivot, the shingles that most of a few members
hold. With D for the size of that difference and S for the set's, two members
are certainly linked if (1 + t)(D + D') <= (1 - t)(S + S'): the triangle
inequality. So each member has one number, two members are linked if theirs add
up to zero or more, and all those links are counted by running sums, in time
and rows proportional to the group. Only what this leaves open is compared, on
the differences, in blocks of which each is one row.

A pair may meet in several leaves; only the least of its common leaves counts
it, which both sets' lists of leaves decide without any exchange, and none
counts pairs of one group. What leaves a task is rows of single sets, never
pairs: the number of linked rows, and a set that it is connected with. Those
rows feed the connected components.
"""

from __future__ import annotations

import itertools
import math
import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import NEAR, SHINGLE_WORDS, Memo, Stage, batches, only, strings, words

#: Most levels of the recursion, and sets of a bucket that is compared at once.
LEVELS = 16
LEAF = 1024
#: Members of a group's block, each counted as one and as its bytes in units of UNIT.
BLOCK = 1024
UNIT = 8192
#: Average similarity from which a large bucket is not split, and the tokens that it is judged by.
ALIKE = 0.6
JUDGED = 64
#: Members that a group's pivot is drawn from.
VOTERS = 64
#: One in so many buckets has two children for each set: 1.25 on average, the inverse of the least similarity.
FORK = 4
TARGET_RECALL = 0.999
#: Splits of the first round.
USUAL_DEPTH = 3
#: Splits after which the runs of a round end; buckets that the last leaves are groups.
ROUNDS = (USUAL_DEPTH, 6, LEVELS)
#: Coordinates of each run of the later rounds.
RUN_COORDS = 32
_WORDS_KEPT = 200_000
_CHUNK = 1 << 19
#: Elements that a comparison holds at once, and most columns of their matrix.
_ELEMENTS = 1 << 22
_WIDTH = 1 << 14
#: Which half of a 64-bit integer is the high one in memory.
_HIGH = int(sys.byteorder == "little")


def runs_for(threshold: float, recall: float, depth: int = USUAL_DEPTH) -> int:
    """Runs after which a pair at the threshold has met with the given probability."""
    return max(1, math.ceil(math.log(1 - recall) / math.log(1 - threshold**depth)))


def kept_for(threshold: float, splits: int) -> float:
    """Probability that a pair at the threshold is together in some fork of a run after so many splits."""
    kept = 1.0
    for _ in range(splits - 1):
        kept = (1 - 1 / FORK) * threshold * kept + (1 - (1 - threshold * kept) ** 2) / FORK
    return threshold * kept


def later_runs_for(threshold: float, recall: float, splits: int) -> int:
    """Runs of a later round; each of these rounds may miss a quarter of what the target allows."""
    return max(1, math.ceil(math.log((1 - recall) / 4) / math.log(1 - min(kept_for(threshold, splits), 1 - 1e-9))))


def _coefficients(coords: int, number: int = 0) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng([20240229, number])
    return rng.integers(1, 1 << 63, coords, dtype=np.uint64) * np.uint64(2) + np.uint64(1), rng.integers(0, 1 << 63, coords, dtype=np.uint64)


def shingles(hashes: np.ndarray, n: int = SHINGLE_WORDS) -> np.ndarray:
    """The set of n-word shingles, as sorted 64-bit hashes; fewer words are one shingle."""
    if not len(hashes):
        return hashes
    n = min(n, len(hashes))
    out = hashes[: len(hashes) - n + 1].copy()
    for i in range(1, n):
        out = (out ^ (out >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15) + hashes[i : len(hashes) - n + 1 + i]
    out = (out ^ (out >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return np.unique(out ^ (out >> np.uint64(32)))


def signature(found: np.ndarray, mult: np.ndarray, add: np.ndarray) -> np.ndarray:
    """The set's min-hash tokens."""
    least = np.full(len(mult), np.iinfo(np.uint32).max, np.uint32)
    chunk = max(1, _CHUNK // len(mult))
    for at in range(0, len(found), chunk):
        part = found[at : at + chunk]
        least = np.minimum(least, ((part[:, None] * mult + add) >> np.uint64(32)).min(0).astype(np.uint32))
    return least


def shingle_sets(docs: DataFrame, n: int = SHINGLE_WORDS, text_col: str = "text", keep: list[str] | None = None, coords: int = RUN_COORDS) -> DataFrame:
    """``rid, k1, k2, n, sketch, grams`` and the columns in ``keep`` for every row.

    ``rid`` numbers the rows, ``k1, k2`` are a 128-bit key of the set of 64-bit
    shingle hashes, ``grams`` those hashes cut to 32 bits (two sets of 20,000
    shingles then share a tenth of a shingle by chance), ``sketch`` the
    min-hash tokens. A text without words has n = 0 and no sketch.
    """
    keep = keep or []

    def run(rows):
        from pyspark import TaskContext

        mult, add = _coefficients(coords)
        memo = Memo(lambda w: xxhash.xxh3_64_intdigest(w.encode("utf-8", "surrogatepass")), _WORDS_KEPT)
        rid = TaskContext.get().partitionId() << 33
        for batch in batches(rows, 2_000_000):
            out: tuple[list, ...] = ([], [], [], [], [], [])
            for text in strings(batch.column(0)):
                found = words(text)
                grams = shingles(np.fromiter(map(memo.__getitem__, found), np.uint64, len(found)), n)
                if len(grams):
                    key = xxhash.xxh3_128_intdigest(grams.tobytes())
                    k1, k2 = (key >> 64) - (1 << 63), (key & (1 << 64) - 1) - (1 << 63)
                    values = (rid, k1, k2, len(grams), signature(grams, mult, add).view(np.int32), np.unique(grams.astype(np.uint32)).tobytes())
                else:
                    values = (rid, None, None, 0, None, None)
                for column, value in zip(out, values, strict=True):
                    column.append(value)
                rid += 1
            arrays = [pa.array(c, pa.int64()) for c in out[:4]] + [pa.array(out[4], pa.list_(pa.int32())), pa.array(out[5], pa.binary())]
            yield pa.RecordBatch.from_arrays(arrays + batch.columns[1:], names=["rid", "k1", "k2", "n", "sketch", "grams", *keep])

    kinds = "".join(f", `{c}` {docs.schema[c].dataType.simpleString()}" for c in keep)
    rows = docs.select(F.col(f"`{text_col}`").alias("text"), *[F.col(f"`{c}`").alias(f"kept{i}") for i, c in enumerate(keep)])
    return rows.mapInArrow(run, f"rid bigint, k1 bigint, k2 bigint, n bigint, sketch array<int>, grams binary{kinds}")


def fresh_sketches(sets: DataFrame, coords: int, number: int) -> DataFrame:
    """``rid, sketch`` of ``rid, grams``: min-hash tokens by coordinates that no other round has."""

    def run(rows):
        mult, add = _coefficients(coords, number)
        for batch in rows:
            out = []
            for grams in batch.column(1):
                found = np.frombuffer(grams.as_py(), np.uint32).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
                out.append(signature(found ^ (found >> np.uint64(32)), mult, add).view(np.int32))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.list_(pa.int32()))], names=["rid", "sketch"])

    return sets.select("rid", "grams").mapInArrow(run, "rid bigint, sketch array<int>")


# --- buckets ----------------------------------------------------------------------------


def _sized(active: DataFrame) -> DataFrame:
    """The rows of ``rid, bucket, ...`` whose bucket has more sets, with their number and hashes of them."""
    members = active.groupBy("bucket").agg(
        F.count("*").alias("members"), F.bit_xor(F.xxhash64("rid")).alias("x"), F.bit_xor(F.xxhash64("rid", F.lit(1))).alias("y")
    ).where("members > 1")
    return active.join(members, "bucket")


def _sketched(large: DataFrame, sketches: DataFrame) -> DataFrame:
    """The live buckets of each set with its sketch, which is fetched once for each set."""
    of_set = large.groupBy("rid").agg(F.collect_list(F.struct(*[c for c in large.columns if c != "rid"])).alias("live"))
    return of_set.join(sketches, "rid").select("rid", "sketch", F.explode("live").alias("at")).select("rid", "sketch", "at.*")


def _alike(large: DataFrame, width: int) -> DataFrame:
    """``bucket, first, alike``: the least set, and whether the sets are alike on average by the tokens that each shares with the usual ones.

    The usual token of a coordinate is the commonest among at most ``VOTERS``
    sets, so no single set that lies far out decides about its bucket.
    """
    large = large.withColumn("sketch", F.slice("sketch", 1, width))
    voters = large.groupBy("bucket", F.pmod(F.xxhash64("rid"), F.lit(VOTERS)).alias("seat")).agg(F.min_by("sketch", "rid").alias("sketch"), F.min("rid").alias("first"))
    usual = F.array(*[F.mode(F.get("sketch", F.lit(i)), True) for i in range(width)])
    usual = voters.groupBy("bucket").agg(usual.alias("usual"), F.min("first").alias("first"))
    equal = F.aggregate(F.zip_with("sketch", "usual", lambda a, b: (a == b).cast("int")), F.lit(0), lambda n, x: n + x)
    return large.join(usual, "bucket").groupBy("bucket").agg(F.min("first").alias("first"), (F.avg(equal / width) >= ALIKE).alias("alike"))


class _Found:
    """What the rounds gather: leaves (``rid, members, x, y``), edges of groups (``a, b``), and the sets left over (``rid``)."""

    def __init__(self):
        self.leaves: list[DataFrame] = []
        self.edges: list[DataFrame] = []
        self.left: DataFrame | None = None

    def settle(self, stage: Stage, found: DataFrame, sketches: DataFrame, width: int, name: str, last: bool = False) -> DataFrame | None:
        """Sorts the buckets of ``found``; returns those to go on with, with their sketches, or None."""
        self.leaves.append(found.where(F.col("members") <= LEAF).select("rid", "members", "x", "y"))
        large = found.where(F.col("members") > LEAF)
        if large.isEmpty():
            return None
        large = stage.put(_sketched(large.drop("members", "x", "y"), sketches), f"large{name}")
        large = stage.put(large.join(_alike(large, min(width, JUDGED)), "bucket"), f"judged{name}")
        whole = F.lit(True) if last else F.col("alike")
        self.edges.append(large.where(whole).select(F.col("rid").alias("a"), F.col("first").alias("b")))
        return None if last else large.where(~whole).drop("first", "alike")


def _first_round(stage: Stage, reps: DataFrame, runs: int, found: _Found) -> None:
    """All runs of the first splits, each by coordinates of its own."""
    depth = F.lit(USUAL_DEPTH)
    at = F.explode(F.sequence(F.lit(0), F.lit(runs - 1))).alias("run")
    active = reps.select("rid", "sketch", at).select("rid", F.xxhash64("run", F.slice("sketch", F.col("run") * depth + 1, depth)).alias("bucket"))
    rest = found.settle(stage, stage.put(_sized(active), "level0"), reps.select("rid", "sketch"), runs * USUAL_DEPTH, "0")
    found.left = None if rest is None else rest.select("rid").distinct()


def _child(bucket, branch, sketch, first):
    """The bucket that a set of a bucket goes to: the path's hash samples the coordinate, the set's token there splits."""
    at = (first + F.pmod(F.xxhash64(bucket, branch), F.lit(RUN_COORDS))).cast("int")
    return F.xxhash64(bucket, branch, at, F.get(sketch, at))


def _later_round(stage: Stage, sketches: DataFrame, number: int, runs: int, splits: int, found: _Found) -> None:
    """The recursion, level by level, for the sets that are left.

    All sets of a bucket follow the same sampled coordinates, so a level is a
    join of sets with the sizes of their buckets. One in ``FORK`` buckets
    splits by two coordinates, into as many children as keep a pair at the
    threshold together once on average, however deep it goes.
    """
    first = (F.col("run") - 1) * RUN_COORDS
    root = F.explode(F.sequence(F.lit(1).cast("bigint"), F.lit(runs).cast("bigint")))
    active = sketches.withColumn("run", root).select("rid", "run", _child(F.col("run"), F.lit(0), F.col("sketch"), first).alias("bucket"))
    for level in range(splits):
        large = found.settle(stage, stage.put(_sized(active), f"level{number}_{level}"), sketches, runs * RUN_COORDS, f"{number}_{level}", level == LEVELS - 1)
        if large is None:
            found.left = None
            return
        forked = F.pmod(F.xxhash64("bucket", F.lit(level)), F.lit(FORK)) == 0
        branches = F.explode(F.when(forked, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))).alias("branch")
        active = large.select("rid", "run", "bucket", "sketch", branches)
        active = active.select("rid", "run", _child(F.col("bucket"), F.col("branch"), F.col("sketch"), first).alias("bucket")).distinct()
    found.left = large.select("rid").distinct()


def _buckets(stage: Stage, sets: DataFrame, reps: DataFrame, threshold: float, recall: float) -> tuple[DataFrame, DataFrame | None]:
    """``rid, leaf``, the buckets to compare, each set of members once; and the edges ``a, b`` of the groups, if there are any.

    A pair that is together after a round's splits is in a leaf, in a group, or
    both its sets are in a large bucket and so both in the next round.
    """
    found = _Found()
    _first_round(stage, reps, runs_for(threshold, recall), found)
    for number, splits in enumerate(ROUNDS[1:], 1):
        if found.left is None:
            break
        left = stage.put(found.left, f"left{number}")
        if left.isEmpty():
            break
        runs = later_runs_for(threshold, recall, splits)
        fresh = stage.put(fresh_sketches(sets.join(left, "rid", "left_semi"), runs * RUN_COORDS, number), f"fresh{number}")
        _later_round(stage, fresh, number, runs, splits, found)
    leaves, *more = found.leaves
    for other in more:
        leaves = leaves.unionByName(other)
    edges, *more = found.edges or [None]
    for other in more:
        edges = edges.unionByName(other)
    # Buckets of the same members are one leaf, named by the hashes of the members.
    return leaves.select("rid", F.xxhash64("members", "x", "y").alias("leaf")).distinct(), edges


# --- comparing --------------------------------------------------------------------------


def overlaps(sets: list[np.ndarray], others: list[np.ndarray] | None = None) -> np.ndarray:
    """The number of common elements of each set (sorted uint32) with each of the others, as a matrix.

    Large inputs are gone through by ranges of the elements, so that memory stays bounded.
    """
    every = sets if others is None else sets + others
    n, m = len(sets), len(every) - len(sets)
    out = np.zeros((n, m or n), np.float32)
    passes = max(1, -(-sum(map(len, every)) // _ELEMENTS))
    cuts = np.linspace(0, 1 << 32, passes + 1).astype(np.uint64)
    held = np.empty((len(every), min(_WIDTH, max(1, _ELEMENTS // max(1, len(every))))), np.float32)
    for low, high in itertools.pairwise(cuts):
        part = every if passes == 1 else [s[np.searchsorted(s, low) : np.searchsorted(s, high)] for s in every]
        token, owner = _shared(part)
        tokens = int(token[-1]) + 1 if len(token) else 0
        for first in range(0, tokens, held.shape[1]):
            a, b = np.searchsorted(token, [first, first + held.shape[1]])
            some = held[:, : min(tokens - first, held.shape[1])]
            some[:] = 0
            some[owner[a:b], token[a:b] - first] = 1
            out += some[:n] @ (some[n:] if m else some).T
    return out


def _shared(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The elements that more than one set holds, numbered in order, and whose they are; made in one array of 8 bytes an element, sorted in place."""
    both = np.empty(sum(map(len, sets)), np.uint64)
    at = 0
    for i, s in enumerate(sets):
        mine = both[at : at + len(s)]
        mine[:] = s
        mine <<= np.uint64(32)
        mine |= np.uint64(i)
        at += len(s)
    both.sort()
    element = both.view(np.uint32)[_HIGH::2]
    again = element[1:] == element[:-1]
    keep = np.zeros(len(both), bool)
    keep[1:] = again
    keep[:-1] |= again
    both = both[keep]
    element, owner = both.view(np.uint32)[_HIGH::2], both.view(np.uint32)[1 - _HIGH :: 2]
    token = np.zeros(len(both), np.int32)
    np.cumsum(element[1:] != element[:-1], out=token[1:], dtype=np.int32)
    return token, owner


def _least_connected(near: np.ndarray, label: np.ndarray) -> np.ndarray:
    """The least label of the sets that each is connected with."""
    some = np.flatnonzero(near.any(1))
    while True:
        new = label.copy()
        for i in some:
            new[i] = min(new[i], label[near[i]].min())
        if (new == label).all():
            return label
        label = new


def _runs(rows: Iterator[pa.RecordBatch], key: str) -> Iterator[dict[str, list]]:
    """The rows of each key together; they arrive sorted by it."""
    held: dict[str, list] = {}
    for batch in rows:
        columns = {n: batch.column(n).to_pylist() for n in batch.schema.names}
        names = columns[key]
        at = 0
        for i in range(1, len(names) + 1):
            if i < len(names) and names[i] == names[at]:
                continue
            part = {n: c[at:i] for n, c in columns.items()}
            if held and held[key][0] == names[at]:
                for n, c in part.items():
                    held[n] += c
            else:
                if held:
                    yield held
                held = part
            at = i
    if held:
        yield held


def _compare_leaves(rows: Iterator[pa.RecordBatch], threshold: float) -> Iterator[pa.RecordBatch]:
    """``rid, linked, root`` for the sets that are linked in a leaf."""
    for g in _runs(rows, "leaf"):
        n = len(g["rid"])
        if n < 2:
            continue
        rid, leaf, group = np.array(g["rid"], np.int64), g["leaf"][0], np.array(g["grp"], np.int64)
        weight, size = np.array(g["copies"], np.int64), np.array([len(x) // 4 for x in g["grams"]], np.float32)
        common = overlaps([np.frombuffer(x, np.uint32) for x in g["grams"]])
        near = common >= np.float32(threshold - 1e-6) * (size[:, None] + size[None, :] - common)
        near &= (group[:, None] != group[None, :]) | (group < 0)[:, None]
        np.fill_diagonal(near, False)
        if not near.any():
            continue
        # Another leaf that both share and that comes first counts the pair.
        earlier: dict[int, list[int]] = {}
        for i, leaves in enumerate(g["leaves"]):
            for x in leaves:
                if x < leaf:
                    earlier.setdefault(x, []).append(i)
        for members in earlier.values():
            if len(members) > 1:
                near[np.ix_(members, members)] = False
        some = np.flatnonzero(near.any(1))
        if len(some):
            yield _linked(rid[some], (near @ weight)[some], _least_connected(near, rid)[some])


def _linked(rid: np.ndarray, linked: np.ndarray, root: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(a.astype(np.int64)) for a in (rid, linked, root)], names=["rid", "linked", "root"])


def _leaf_links(leaves: DataFrame, groups: DataFrame | None, of_rep: DataFrame, threshold: float) -> DataFrame:
    """Links of pairs that meet in a leaf and are not of one group."""
    grp = F.lit(None).cast("bigint").alias("grp")
    own = leaves.groupBy("rid").agg(F.sort_array(F.collect_set("leaf")).alias("leaves"))  # about one for each run
    own = own.join(groups, "rid", "left") if groups is not None else own.select("*", grp)
    if groups is not None:
        # A leaf whose sets are all of one group has nothing to compare.
        open_ = leaves.join(groups, "rid", "left").groupBy("leaf").agg(F.min("grp").alias("low"), F.max("grp").alias("high"), F.count_if(F.col("grp").isNull()).alias("free"))
        leaves = leaves.join(open_.where("free > 0 or low <> high").select("leaf"), "leaf")
    own = own.withColumn("grp", F.coalesce("grp", F.lit(-1))).join(of_rep, "rid")
    tasks = leaves.join(own, "rid").repartition("leaf").sortWithinPartitions("leaf")
    return tasks.mapInArrow(lambda rows: _compare_leaves(rows, threshold), "rid bigint, linked bigint, root bigint")


# --- groups -----------------------------------------------------------------------------


def _pivots(members: DataFrame) -> DataFrame:
    """``grp, pivot``: the shingles that more than half of at most ``VOTERS`` members of the group hold."""

    def vote(rows):
        for batch in rows:
            out = []
            for ballots in batch.column(1).to_pylist():
                tokens, n = np.unique(np.concatenate([np.frombuffer(b, np.uint32) for b in ballots]), return_counts=True)
                out.append(tokens[2 * n > len(ballots)].tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], names=["grp", "pivot"])

    drawn = members.groupBy("grp", F.pmod(F.xxhash64("rid"), F.lit(VOTERS)).alias("seat")).agg(F.min_by("grams", "rid").alias("grams"))
    return drawn.groupBy("grp").agg(F.collect_list("grams").alias("ballots")).mapInArrow(vote, "grp bigint, pivot binary")


def _coded(members: DataFrame, pivots: DataFrame, threshold: float) -> DataFrame:
    """``rid, grp, copies, size, v, diff``: the difference from the pivot; v + v' >= 0 means that two members are linked for certain."""

    def code(rows):
        for batch in rows:
            size, v, diff = [], [], []
            for grams, pivot in zip(batch.column(3), batch.column(4), strict=True):
                grams, pivot = (np.frombuffer(x.as_py(), np.uint32) for x in (grams, pivot))
                other = np.setxor1d(grams, pivot, assume_unique=True)
                size.append(len(grams))
                v.append(math.floor(((1 - threshold) * len(grams) - (1 + threshold) * len(other)) * 1e6))
                diff.append(other.tobytes())
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(size, pa.int64()), pa.array(v, pa.int64()), pa.array(diff, pa.binary())], names=["rid", "grp", "copies", "size", "v", "diff"])

    rows = members.join(pivots, "grp").select("rid", "grp", "copies", "grams", "pivot")
    return rows.mapInArrow(code, "rid bigint, grp bigint, copies bigint, size bigint, v bigint, diff binary")


def _settled(coded: DataFrame) -> DataFrame:
    """``coded`` with ``certain`` (rows of other members that are linked for certain), ``top`` (the member nearest the pivot), ``loose`` and ``block``.

    Members that are not loose are linked with ``top`` for certain. Blocks
    follow the order of v. All of it comes from one histogram of v for each group.
    """
    units = 1 + F.floor(F.octet_length("diff") / UNIT)
    counts = coded.groupBy("grp", "v").agg(F.sum("copies").alias("w"), F.sum(units).alias("u"), F.min("rid").alias("least"))
    down = Window.partitionBy("grp").orderBy(F.desc("at"), "kind").rowsBetween(Window.unboundedPreceding, 0)
    # Running sums from the largest v down, asked at -v after the members that have it.
    steps = counts.select("grp", F.col("v").alias("at"), F.lit(0).alias("kind"), "w", "v")
    asks = counts.select("grp", (-F.col("v")).alias("at"), F.lit(1).alias("kind"), F.lit(0).cast("bigint").alias("w"), "v")
    certain = steps.unionByName(asks).withColumn("certain", F.sum("w").over(down)).where("kind = 1").select("grp", "v", "certain")
    before = Window.partitionBy("grp").orderBy(F.desc("v")).rowsBetween(Window.unboundedPreceding, -1)
    placed = counts.withColumn("start", F.floor(F.coalesce(F.sum("u").over(before), F.lit(0)) / BLOCK)).withColumn("parts", F.ceil(F.col("u") / BLOCK))
    top = counts.groupBy("grp").agg(F.max_by("least", "v").alias("top"), F.max("v").alias("top_v"))
    of_v = placed.join(certain, ["grp", "v"]).select("grp", "v", "certain", "start", "parts").join(top, "grp")
    rows = coded.join(of_v, ["grp", "v"])
    itself = F.when(F.col("v") >= 0, F.col("copies")).otherwise(0)
    return rows.select(
        "rid", "grp", "copies", "size", "v", "diff", "top", (F.col("certain") - itself).alias("certain"),
        ((F.col("rid") != F.col("top")) & (F.col("v") + F.col("top_v") < 0)).alias("loose"),
        (F.col("start") + F.pmod(F.xxhash64("rid"), F.col("parts"))).alias("block"),
    )


def _members_of(column: pa.Array, i: int) -> dict[str, np.ndarray | list]:
    part = column.slice(i, 1).flatten()
    out = {n: part.field(n).to_numpy(zero_copy_only=False) for n in ("rid", "copies", "size", "v", "loose")}
    return out | {"diff": [np.frombuffer(x.as_py(), np.uint32) for x in part.field("diff")]}


def _compare_blocks(rows: Iterator[pa.RecordBatch], threshold: float) -> Iterator[pa.RecordBatch]:
    """Links between a block's members and those of other blocks that are not certain; the block itself comes first.

    Yields each member's number of linked rows once, and where loose members
    are connected with; the others are all connected with the top already.
    """
    mine, linked, at = None, None, None
    for batch in rows:
        keys = list(zip(*(batch.column(n).to_pylist() for n in ("grp", "block", "other", "top")), strict=True))
        for i, (grp, block, other, top) in enumerate(keys):
            if (grp, block) != at:
                if mine is not None:
                    yield _linked(mine["rid"], linked, mine["rid"])
                assert block == other
                mine, at = _members_of(batch.column("members"), i), (grp, block)
                linked = np.zeros(len(mine["rid"]), np.int64)
            theirs = mine if block == other else _members_of(batch.column("members"), i)
            away = [np.array([len(d) for d in x["diff"]], np.float32) for x in (mine, theirs)]
            size = (mine["size"][:, None] + theirs["size"][None, :]).astype(np.float32)
            common = (size - away[0][:, None] - away[1][None, :]) / 2 + overlaps(mine["diff"], theirs["diff"])
            near = common >= np.float32(threshold - 1e-6) * (size - common)
            near &= (mine["v"][:, None] + theirs["v"][None, :] < 0) & (mine["rid"][:, None] != theirs["rid"][None, :])
            linked += near @ theirs["copies"]
            if not (mine["loose"].any() and near.any()):
                continue
            # All that is not loose is one node, before all others: the least of labels from 0, which is the top.
            n = len(mine["rid"])
            ids = np.concatenate([mine["rid"], theirs["rid"]])
            label = np.where(np.concatenate([mine["loose"], theirs["loose"]]), ids, -1)
            both = np.zeros((len(ids), len(ids)), bool)
            both[:n, n:], both[n:, :n] = near, near.T
            if block == other:
                both[:n, :n] = both[n:, n:] = near
            free = np.flatnonzero(mine["loose"] & near.any(1))
            root = _least_connected(both, label)[:n][free]
            yield _linked(mine["rid"][free], np.zeros(len(free)), np.where(root < 0, top, root))
    if mine is not None:
        yield _linked(mine["rid"], linked, mine["rid"])


def _group_links(stage: Stage, groups: DataFrame, of_rep: DataFrame, threshold: float, counting: bool) -> DataFrame:
    """Links of all pairs of one group; without ``counting`` only as many as connect what is linked."""
    members = stage.put(groups.join(of_rep, "rid"), "members")
    coded = stage.put(_coded(members, _pivots(members), threshold), "coded")
    rows = stage.put(_settled(coded), "settled")
    sure = rows.select("rid", F.col("certain").alias("linked"), F.when(F.col("loose"), F.col("rid")).otherwise(F.col("top")).alias("root"))
    packed = rows.groupBy("grp", "block").agg(
        F.collect_list(F.struct("rid", "copies", "size", "v", "loose", "diff")).alias("members"), F.min("v").alias("low"), F.max("loose").alias("open"), F.min("top").alias("top"),
    )
    packed = stage.put(packed, "packed")
    # One row for each pair of blocks that holds a pair which is not certain; each block meets itself as well.
    heads = packed.select("grp", "block", "low", "open")
    left = heads if counting else heads.where("open")
    pairs = left.alias("a").join(heads.alias("b"), "grp").where("a.low + b.low < 0")
    pairs = pairs.select("grp", F.col("a.block").alias("block"), F.col("b.block").alias("other"))
    pairs = pairs.unionByName(pairs.select("grp", "block", F.col("block").alias("other"))).distinct()
    tasks = pairs.join(packed.select("grp", F.col("block").alias("other"), "members", "top"), ["grp", "other"])
    tasks = tasks.withColumn("later", F.col("block") != F.col("other")).repartition("grp", "block").sortWithinPartitions("grp", "block", "later", "other")
    return sure.unionByName(tasks.mapInArrow(lambda r: _compare_blocks(r, threshold), "rid bigint, linked bigint, root bigint"))


def components(stage: Stage, edges: DataFrame, label: str = "edges") -> DataFrame:
    """``node, least``: the least node that each node is connected with.

    Large-star and small-star steps in turn; each round's edges are written,
    and the loop ends when a round changes nothing. Star centres are the
    minima, which joins spread, so no task holds a component.
    """
    def checksum(df: DataFrame):
        return df.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()

    edges = stage.put(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), f"{label}0")
    seen = checksum(edges)
    for i in itertools.count(1):
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.where("a <> b").distinct()
        small = large.groupBy("a").agg(F.min("b").alias("m"))
        edges = stage.put(
            large.join(small, "a").select(F.when(F.col("b") == F.col("m"), F.col("a")).otherwise(F.col("b")).alias("a"), F.col("m").alias("b"))
            .where("a <> b").distinct(), f"{label}{i}",
        )
        stage.drop(f"{label}{i - 1}")
        now = checksum(edges)
        if now == seen:
            break
        seen = now
    return edges.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("least"))


def _joined(
    stage: Stage, docs: DataFrame, threshold: float, n: int, recall: float, text_col: str, keep: list[str], counting: bool
) -> tuple[DataFrame, DataFrame]:
    """All rows (``rid, k1, k2, n`` and the kept columns), and the representatives (``k1, k2, rid, copies, linked, root, least``).

    ``root`` is the least representative of the connected ones, ``linked`` the
    number of rows of other sets that the set is linked with (only if ``counting``).
    """
    coords = runs_for(threshold, recall) * USUAL_DEPTH
    sets = stage.put(shingle_sets(docs, n, text_col, keep, coords), "sets")
    first = F.min(F.struct("rid", "sketch")).alias("first")
    least = F.min(keep[0]).alias("least") if keep else F.lit(None).alias("least")
    reps = sets.where("n > 0").groupBy("k1", "k2").agg(first, F.count("*").alias("copies"), least)
    reps = stage.put(reps.select("k1", "k2", "first.rid", "first.sketch", "copies", "least"), "reps")
    leaves, edges = _buckets(stage, sets, reps, threshold, recall)
    leaves = stage.put(leaves, "leaves")
    of_rep = reps.select("rid", "copies").join(sets.select("rid", "grams"), "rid")
    groups = None
    if edges is not None:
        joined = components(stage, edges, "alike").toDF("rid", "grp")
        groups = stage.put(joined.unionByName(joined.select(F.col("grp").alias("rid"), "grp").distinct()), "groups")
    stage.drop(*[n for n in stage.names if n.startswith(("level", "large", "judged", "left", "fresh", "alike"))])
    links = stage.put(_leaf_links(leaves, groups, of_rep, threshold), "links")
    if groups is not None:
        links = links.unionByName(stage.put(_group_links(stage, groups, of_rep, threshold, counting), "grouped"))
        stage.drop("groups", "members", "coded", "settled", "packed")
    stage.drop("leaves")

    joined = components(stage, links.select(F.col("rid").alias("a"), F.col("root").alias("b"))).toDF("rid", "top")
    counts = links.groupBy("rid").agg(F.sum("linked").alias("linked"))
    reps = reps.drop("sketch").join(counts, "rid", "left").join(joined, "rid", "left")
    reps = reps.withColumns({"root": F.coalesce("top", "rid"), "linked": F.coalesce("linked", F.lit(0))}).drop("top")
    return sets.drop("sketch", "grams"), reps


def jaccard_join(
    spark: SparkSession, docs: DataFrame, threshold: float = NEAR, n: int = SHINGLE_WORDS, recall: float = TARGET_RECALL,
    id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """Near copies among all texts: ``doc_id, class_id, n_links``, one row per input row.

    Rows are linked if the Jaccard similarity of their sets of word shingles
    (n words, lower case) is at least ``threshold``; equal sets are linked
    whatever their number. ``class_id`` is the least ``doc_id`` of the
    connected rows and ``n_links`` the number of other rows linked with the
    row. Found links are verified on the sets; a pair at the very threshold is
    found with about the target recall, nearer ones almost surely.

    Texts of fewer than n words are one shingle. Null texts and texts without
    words have no links and are classes of their own. A null id takes part and
    stays null. Repeated rows are linked to one another. An empty table gives
    none; other columns are ignored.
    """
    named = only(docs, id_col, text_col).toDF("doc_id", "text")
    rows, reps = _joined(Stage(spark, "jaccard"), named, threshold, n, recall, "text", ["doc_id"], True)
    names = reps.groupBy("root").agg(F.min("least").alias("class_id"))
    reps = reps.join(names, "root").select("k1", "k2", "class_id", (F.col("linked") + F.col("copies") - 1).alias("n_links"))
    out = rows.where("n > 0").join(reps, ["k1", "k2"]).select("doc_id", "class_id", "n_links")
    alone = rows.where("n = 0").select("doc_id", F.col("doc_id").alias("class_id"), F.lit(0).cast("bigint").alias("n_links"))
    return out.unionByName(alone)


def keep_one(
    spark: SparkSession, docs: DataFrame, threshold: float = NEAR, n: int = SHINGLE_WORDS, recall: float = TARGET_RECALL, text_col: str = "text",
) -> DataFrame:
    """The rows of ``docs`` without all but one of each class of near copies.

    The row that the join met first stays; texts without words all stay. Rows
    are told apart by their number, so null or repeated ids do no harm. The
    columns travel beside the sets, so the texts are joined with the few
    numbers that stay, not found again by id.
    """
    names = docs.columns
    plain = docs.toDF(*[f"c{i}" for i in range(len(names))])
    rows, reps = _joined(Stage(spark, "dedup"), plain, threshold, n, recall, f"c{names.index(text_col)}", plain.columns, False)
    stay = reps.where(F.col("rid") == F.col("root")).select("rid")
    kept = rows.where("n > 0").join(stay, "rid", "left_semi").unionByName(rows.where("n = 0"))
    return kept.select(*[F.col(c).alias(name) for c, name in zip(plain.columns, names, strict=True)])
