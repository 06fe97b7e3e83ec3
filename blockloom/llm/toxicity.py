"""Toxicity by a chain of classifiers.

The chain predicts categories one after the other. Each link is a linear
model over word features and the probabilities of the links before it. When a
link is trained, those probabilities are out-of-fold: each training row gets
them from models that have not seen it, as a new document would.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Memo, Stage, batches, only, sigmoid, strings, words
from .linear import Logistic, fold_of, held_out, sample_ids

#: Most labelled documents that the chain is fitted on; scoring covers all.
MAX_LABELLED = 8000
#: Features that a link weighs, those that tell its own category best, and labelled documents that must hold one.
FEATURES = 256
LEAST_DOCS = 3
#: Word beginnings that are features beside whole words.
PREFIXES = (4, 5, 6, 7)
_RIDGE = 0.3
_WORDS_KEPT = 100_000


def features_of(word: str) -> list[int]:
    """A word's features: itself and its beginnings, hashed to 63 bits."""
    parts = ["=" + word] + ["^" + word[:n] for n in PREFIXES if len(word) > n]
    return [xxhash.xxh3_64_intdigest(p.encode("utf-8", "surrogatepass")) >> 1 for p in parts]


class Chain:
    """The fitted chain: the features' columns, and for each category a model of some of them and of the links before."""

    def __init__(self, columns: dict[int, int], chosen: list[np.ndarray], links: list[Logistic], threshold: float):
        self.columns, self.threshold = columns, threshold
        self.weights = np.zeros((len(columns), len(links)))
        self.after = np.zeros((len(links), len(links)))
        self.bias = np.array([link.bias for link in links])
        for j, (cols, link) in enumerate(zip(chosen, links, strict=True)):
            self.weights[cols, j] = link.weights[: len(cols)]
            self.after[:j, j] = link.weights[len(cols) :]

    def predict(self, x: np.ndarray) -> np.ndarray:
        """Probabilities of all categories, in the chain's order, from feature counts."""
        out = x @ self.weights + self.bias
        for j in range(out.shape[1]):
            out[:, j] = sigmoid(out[:, j] + out[:, :j] @ self.after[:j, j])
        return out

    def word_columns(self, word: str) -> tuple[int, ...]:
        return tuple(c for f in features_of(word) if (c := self.columns.get(f)) is not None)

    def vector(self, found: list[str], memo: Memo) -> np.ndarray:
        """How many of the text's distinct words carry each feature."""
        held = [c for cols in map(memo.__getitem__, set(found)) for c in cols]
        return np.bincount(np.array(held, np.int64), minlength=len(self.columns)).astype(float)


def fit_chain(ids: Sequence, x: np.ndarray, labels: np.ndarray, columns: dict[int, int], chosen: list[np.ndarray], threshold: float = 0.5) -> Chain:
    """Fit from feature counts, 0/1 labels (a column for each category), the features' columns and those that each link weighs.

    Without a positive label of the last category no score reaches the threshold.
    """
    folds, links = fold_of(ids), []
    threshold = threshold if labels[:, -1].any() else 2.0
    earlier = np.zeros((len(x), 0))
    for j, cols in enumerate(chosen):
        z, y = np.column_stack([x[:, cols], earlier]), labels[:, j]
        link = Logistic(_RIDGE).fit(z, y)
        links.append(link)
        earlier = np.column_stack([earlier, sigmoid(held_out(z, y, folds, _RIDGE))])
    return Chain(columns, chosen, links, threshold)


def _counted(held: DataFrame, ys: list[str]) -> DataFrame:
    """``feature, n`` and the columns ``ys``: documents, and documents of each category, that hold each feature."""

    def run(batches_):
        for rows in batches_:
            for batch in batches(iter([rows]), 1 << 20, "held"):
                found = [np.unique(np.frombuffer(h, np.uint64)) for h in batch.column("held").to_pylist()]
                names, n = np.unique(np.concatenate(found), return_counts=True)
                out = [pa.array(names.view(np.int64)), pa.array(n, pa.int64())]
                for y in ys:
                    good = [f for f, v in zip(found, batch.column(y).to_pylist(), strict=True) if v]
                    count = np.zeros(len(names), np.int64)
                    if good:
                        some, times = np.unique(np.concatenate(good), return_counts=True)
                        count[np.searchsorted(names, some)] = times
                    out.append(pa.array(count))
                yield pa.RecordBatch.from_arrays(out, names=["feature", "n", *ys])

    counted = held.select("held", *ys).mapInArrow(run, f"feature bigint, n bigint, {', '.join(f'{y} bigint' for y in ys)}")
    return counted.groupBy("feature").agg(F.sum("n").alias("n"), *[F.sum(y).alias(y) for y in ys]).where(F.col("n") >= LEAST_DOCS)


def best_features(counts: DataFrame, y: str, positive: int, total: int, most: int = FEATURES) -> list[int]:
    """The features that tell the category best, by the chi-square of holding them at all; ties go to the smaller hash."""
    if not positive or positive == total:
        return []
    expect = F.col("n") * positive / total
    ranked = counts.withColumn("chi", F.round((F.col(y) - expect) ** 2 / expect, 9)).where("chi > 0")
    return [r["feature"] for r in ranked.orderBy(F.desc("chi"), "feature").limit(most).collect()]


def train_chain(spark: SparkSession, docs: DataFrame, labels: DataFrame, names: list[str], most: int = MAX_LABELLED, id_col: str = "doc_id", text_col: str = "text") -> Chain:
    """Fit the chain on at most ``most`` labelled documents.

    ``labels`` has the id and one 0/1 column for each category in ``names``,
    in the chain's order; of repeated ids the largest labels hold, null labels
    are 0. Each link weighs the ``FEATURES`` features that tell its category
    best. Only the sample's counts of those reach the driver.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    wide = labels.where(F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("label_id")).agg(*[F.coalesce(F.max(F.col(f"`{n}`").cast("int")), F.lit(0)).alias(f"y{i}") for i, n in enumerate(names)])
    sample = spark.createDataFrame([(i,) for i in sample_ids(wide, most, "label_id")], f"label_id {kind}")
    # At most ``most`` ids and labels are broadcast.
    known = F.broadcast(wide.join(F.broadcast(sample), "label_id"))
    rows = only(docs, id_col, text_col).toDF("doc_id", "text").join(known, F.col("doc_id") == F.col("label_id")).drop("label_id").dropDuplicates(["doc_id"])
    ys = [f"y{i}" for i in range(len(names))]

    def run(batch_rows):
        memo = Memo(features_of, _WORDS_KEPT // 4)
        for batch in batches(batch_rows, 2_000_000):
            held = [np.array([f for w in set(words(t)) for f in memo[w]], np.uint64).tobytes() for t in strings(batch.column(1))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(held, pa.binary()), *batch.columns[2:]], names=["doc_id", "held", *ys])

    stage = Stage(spark, "toxicity")
    held = stage.put(rows.mapInArrow(run, f"doc_id {kind}, held binary, {', '.join(f'{y} int' for y in ys)}"), "held")
    counts = stage.put(_counted(held, ys), "counts")
    total, *positive = held.agg(F.count("*"), *[F.coalesce(F.sum(y), F.lit(0)) for y in ys]).first()
    best = [best_features(counts, y, n, total) for y, n in zip(ys, positive, strict=True)]
    columns = {f: i for i, f in enumerate(dict.fromkeys(f for some in best for f in some))}
    chosen = [np.array([columns[f] for f in some], np.int64) for some in best]
    order = np.array(sorted(columns), np.int64)
    place = np.array([columns[f] for f in order.tolist()], np.int64)

    def count(batch_rows):
        for batch in batch_rows:
            lists = []
            for h in batch.column(1).to_pylist():
                found = np.frombuffer(h, np.int64)
                at = np.searchsorted(order, found) if len(order) else np.zeros(0, np.int64)
                hit = (at < len(order)) & (order[np.minimum(at, len(order) - 1)] == found) if len(order) else np.zeros(0, bool)
                lists.append(place[at[hit]].tolist())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(lists, pa.list_(pa.int64())), *batch.columns[2:]], names=["doc_id", "cols", *ys])

    got = held.mapInArrow(count, f"doc_id {kind}, cols array<bigint>, {', '.join(f'{y} int' for y in ys)}").collect()
    got.sort(key=lambda r: r["doc_id"])
    x = np.zeros((len(got), len(columns)), np.float32)
    for i, r in enumerate(got):
        np.add.at(x[i], r["cols"], 1)
    labelled = np.array([[r[y] for y in ys] for r in got], float).reshape(len(got), len(names))
    return fit_chain([r["doc_id"] for r in got], x, labelled, columns, chosen)


def score_chain(docs: DataFrame, chain: Chain, id_col: str = "doc_id", text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``doc_id, probabilities, score, toxic`` and the columns in ``keep``, one row per input row.

    ``probabilities`` follow the chain; ``score`` is the last one, rounded to
    six places, and ``toxic`` tells whether it reaches the threshold. Null and
    empty texts have no words and get the constant. A map without shuffle,
    over few rows at once.
    """
    keep = keep or []

    def run(rows):
        memo = Memo(chain.word_columns, _WORDS_KEPT)
        for batch in batches(rows, 2_000_000, most_rows=512):
            x = np.array([chain.vector(words(t), memo) for t in strings(batch.column(1))]).reshape(batch.num_rows, len(chain.columns))
            p = np.round(chain.predict(x), 6)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, p.size + 1, p.shape[1]), pa.int32()), pa.array(p.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column(0), lists, pa.array(p[:, -1]), pa.array(p[:, -1] >= chain.threshold), *batch.columns[2:]], names=["doc_id", "probabilities", "score", "toxic", *keep])

    kind = docs.schema[id_col].dataType.simpleString()
    kinds = "".join(f", `{c}` {docs.schema[c].dataType.simpleString()}" for c in keep)
    rows = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text"), *[F.col(f"`{c}`").alias(f"kept{i}") for i, c in enumerate(keep)])
    return rows.mapInArrow(run, f"doc_id {kind}, probabilities array<double>, score double, toxic boolean{kinds}")


#: Languages that get a category of their own, by their number of toxic labels; all others share one.
LANGUAGES = 4


def language_categories(docs: DataFrame, labels: DataFrame) -> tuple[DataFrame, list[str]]:
    """The labels' one category, split by language, then the whole: what the chain predicts in turn.

    Abuse is worded differently in each language, so each of the most common
    languages is a category of its own, the other languages (and none) are
    another, and the last category is any toxicity. Columns are named by
    number, as a language may be any string.
    """
    tagged = labels.where("toxic is not null").select("doc_id", "toxic").join(only(docs, "doc_id", "lang"), "doc_id", "left")
    counts = tagged.where("toxic = 1 and lang is not null").groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(LANGUAGES).collect()
    langs = [r["lang"] for r in counts]
    bad = F.col("toxic") == 1
    split = [F.when(bad & (F.col("lang") == lang), 1).otherwise(0) for lang in langs] + [F.when(bad & ~F.coalesce(F.col("lang").isin(langs), F.lit(False)), 1).otherwise(0)]
    names = [f"category{i}" for i in range(len(split))]
    return tagged.select("doc_id", *[c.alias(n) for c, n in zip(split, names, strict=True)], "toxic"), [*names, "toxic"]


def toxicity(spark: SparkSession, docs: DataFrame, labels: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """Fit the chain on a bounded sample of the labels and score all documents.

    ``docs`` has ``doc_id, text, lang`` and ``labels`` has ``doc_id, toxic``.
    See ``score_chain`` for the result. Null labels are skipped; without toxic
    labels nothing is toxic; null ids are scored and stay null; repeated rows
    are scored each; an empty table gives none; other columns are ignored.
    """
    tagged, names = language_categories(docs, labels)
    return score_chain(docs, train_chain(spark, docs, tagged, names), keep=keep)
