"""What the two vector searches share: shards of distinct vectors that queries stream through."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import Stage

#: Queries that are searched together.
QUERY_BATCH = 256


def finite(vec: Column) -> Column:
    """Whether a vector is there and holds numbers only; an empty one is not."""
    return F.coalesce(
        (F.size(vec) > 0)
        & F.forall(vec, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) != float("inf"))),
        F.lit(False),
    )


def classes(rows: DataFrame, most: int) -> DataFrame:
    """``vec, ids``: each distinct vector with its ``most`` smallest ids.

    A vector shared by any number of rows is cut to its smallest ids before
    the shuffle (Spark limits ranked windows on the map side), which is exact
    where no more than ``most`` of equal rank can be asked for.
    """
    own = W.partitionBy("vec").orderBy("id")
    ranked = rows.distinct().withColumn("place", F.row_number().over(own)).where(F.col("place") <= most)
    return ranked.groupBy("vec").agg(F.sort_array(F.collect_list("id")).alias("ids"))


def search(
    spark: SparkSession, rows: DataFrame, queries: DataFrame, k: int, shard_rows: int,
    make: Callable[[np.ndarray, np.ndarray], Callable[[np.ndarray], tuple[np.ndarray, np.ndarray]]], value: str,
) -> DataFrame:
    """``query_id, rank, vec_id, score`` for rows ``id, vec`` and queries ``id, vec``.

    Distinct vectors are dealt to shards by a hash, each at most about
    ``shard_rows``, and each shard is a task. It takes its shard's vectors first, calls ``make(vectors,
    least ids)`` once, then streams all queries of the same dimension through
    the search it returns, which gives (indices, scores) of at least the k + 1
    best distinct vectors, -1 where there are fewer. A task thus holds one
    shard and one batch of queries. The best k rows of each shard meet at the
    query; the query's own row is left out.
    """
    found = Stage(spark, "vectors").put(classes(rows, k + 1), "classes")
    dims = {r["dim"]: -(-r["n"] // shard_rows) for r in found.groupBy(F.size("vec").alias("dim")).agg(F.count("*").alias("n")).orderBy("dim").collect()}
    starts = dict(zip(dims, np.cumsum([0, *dims.values()]).tolist(), strict=False))
    of_dim = lambda numbers: F.coalesce(*[F.when(F.size("vec") == d, F.lit(int(n))) for d, n in numbers.items()], F.lit(0)) if numbers else F.lit(0)
    shards, start = of_dim(dims), of_dim(starts)
    own = start + F.pmod(F.xxhash64("vec"), F.greatest(shards, F.lit(1))).cast("int")
    candidates = found.select(own.alias("shard"), F.lit(0).alias("kind"), F.lit(None).cast("bigint").alias("id"), "ids", "vec")
    asked = queries.select("id", "vec").distinct().withColumns({"shards": shards, "start": start}).where("shards > 0").select(
        F.explode(F.sequence(F.col("start"), F.col("start") + F.col("shards") - 1)).alias("shard"), F.lit(1).alias("kind"), "id", F.lit(None).cast("array<bigint>").alias("ids"), "vec"
    )
    total = max(1, sum(dims.values()))
    both = candidates.unionByName(asked).repartitionById(total, F.col("shard")).sortWithinPartitions("shard", "kind")
    exact = np.float64 if value == "double" else np.int64

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, ids, vectors, searcher, waiting = None, [], [], None, ([], [])

        def answer():
            nonlocal searcher
            if not waiting[0] or not ids:
                return None
            if searcher is None:
                matrix = np.array(vectors, exact)
                searcher = make(matrix, np.array([x[0] for x in ids], np.int64))
                vectors.clear()
            index, score = searcher(np.array(waiting[1], exact))
            out: tuple[list, list, list] = ([], [], [])
            for q, own in enumerate(waiting[0]):
                best = [(-s, i) for at, s in zip(index[q].tolist(), score[q].tolist(), strict=True) if at >= 0 for i in ids[at] if i != own]
                best.sort()
                for s, i in best[:k]:
                    out[0].append(own)
                    out[1].append(i)
                    out[2].append(-s)
            waiting[0].clear()
            waiting[1].clear()
            kind = pa.float64() if value == "double" else pa.int64()
            return pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], kind)], names=["query_id", "vec_id", "score"])

        for batch in batches:
            at_shard, at_kind, at_id = (batch.column(i).to_pylist() for i in range(3))
            lists, flat = batch.column(3), batch.column(4)
            values, offsets = flat.values.to_numpy(zero_copy_only=False), flat.offsets.to_numpy()
            for i in range(batch.num_rows):
                if at_shard[i] != here:
                    if done := answer():
                        yield done
                    waiting[0].clear()
                    waiting[1].clear()
                    here, ids, vectors, searcher = at_shard[i], [], [], None
                vec = values[offsets[i] : offsets[i + 1]].copy()
                if at_kind[i] == 0:
                    ids.append(lists[i].as_py())
                    vectors.append(vec)
                elif at_id[i] is not None:
                    waiting[0].append(at_id[i])
                    waiting[1].append(vec)
                    if len(waiting[0]) == QUERY_BATCH and (done := answer()):
                        yield done
        if done := answer():
            yield done

    near = both.mapInArrow(run, f"query_id bigint, vec_id bigint, score {value}")
    order = W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return near.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
