"""Quality by co-training of two views.

One classifier sees only the text's content, the other only the page's
metadata. Over a few rounds each labels the unlabelled documents that it is
surest of, and those labels train the other. Both views are then calibrated on
out-of-fold scores of the true labels, and their log-odds are added.
"""

from __future__ import annotations

import math
import operator
from collections.abc import Callable, Sequence

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Stage, batches, only, sigmoid, strings
from .linear import Logistic, fold_of, held_out, sample_ids

#: Most labelled documents that the views are fitted on; the pool is all others, and scoring covers all.
MAX_LABELLED = 8000
ROUNDS = 4
#: Pseudo-labels that a view hands over in a round, and how sure it must be, calibrated on labels set aside.
HANDED = 400
SURE = 0.97
#: Quantile bins of a numeric feature, and hash buckets of a categorical one.
BINS = 8
BUCKETS = 64
#: Parts of the pool that are ranked apart before what is left is ranked together.
SEATS = 256
_RIDGE = 1.0

#: Byte classes whose shares of a text are features.
CLASSES = {
    "upper": range(65, 91), "lower": range(97, 123), "digit": range(48, 58), "space": (32, 9), "line": (10, 13),
    "stop": b".,;:", "shout": b"!?", "mark": b"#$%&*+=~^<>@", "bar": b"|/\\_", "quote": b"'\"`()[]{}-", "wide": range(128, 256),
}
_CLASS = np.zeros((256, len(CLASSES)))
for _i, _bytes in enumerate(CLASSES.values()):
    _CLASS[list(_bytes), _i] = 1
TEXT_FEATURES = len(CLASSES) + 9
META_NUMBERS = 1


def text_features(text: str | None) -> list[float]:
    """What the content view sees: shares of byte classes, repetition, and lengths."""
    text = text or ""
    raw = text.encode("utf-8", "surrogatepass")
    shares = np.bincount(np.frombuffer(raw, np.uint8), minlength=256) @ _CLASS / max(1, len(raw))
    words = text.split()
    lines = text.split("\n")
    n = max(1, len(words))
    distinct = set(words)
    ends = sum(not w[-1].isalnum() for w in distinct) / max(1, len(distinct))
    return [
        *shares.tolist(), len(distinct) / n, sum(map(operator.eq, words, words[1:])) / n, sum(map(operator.eq, words, words[2:])) / n,
        len(set(lines)) / len(lines), math.log1p(n / len(lines)), len(text) / n, math.log1p(len(text)), ends,
        sum(map(len, distinct)) / max(1, len(distinct)),
    ]


class View:
    """A classifier over numbers, binned by ``edges``, and hashed categories; a number that is not there has a bin of its own."""

    def __init__(self, edges: np.ndarray, ridge: float = _RIDGE):
        self.ridge, self.model, self.edges = ridge, Logistic(ridge), edges
        self.slope, self.shift = 1.0, 0.0

    def matrix(self, numbers: np.ndarray, codes: np.ndarray) -> np.ndarray:
        n, d = numbers.shape
        x = np.zeros((n, d * (BINS + 1) + codes.shape[1] * BUCKETS), np.float32)
        rows = np.arange(n)
        for j in range(d):
            at = np.where(np.isfinite(numbers[:, j]), np.searchsorted(self.edges[j], numbers[:, j], side="left"), BINS)
            x[rows, j * (BINS + 1) + at] = 1
        for j in range(codes.shape[1]):
            x[rows, d * (BINS + 1) + j * BUCKETS + codes[:, j]] = 1
        return x

    def calibrate(self, logits: np.ndarray, y: np.ndarray) -> None:
        """Platt scaling, from out-of-fold logits of true labels."""
        fitted = Logistic(1e-3).fit(logits[:, None], y)
        self.slope, self.shift = (max(0.0, float(fitted.weights[0])), fitted.bias) if len(fitted.weights) else (0.0, fitted.bias)

    def log_odds(self, x: np.ndarray) -> np.ndarray:
        return self.model.logit(x) * self.slope + self.shift


class CoTrained:
    """Both views and how they are combined."""

    def __init__(self, content: View, meta: View, prior: float, threshold: float):
        self.content, self.meta, self.prior, self.threshold = content, meta, prior, threshold

    def scores(self, content_x: np.ndarray, meta_x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Probabilities of good quality: content, metadata, both."""
        a, b = self.content.log_odds(content_x), self.meta.log_odds(meta_x)
        return sigmoid(a), sigmoid(b), sigmoid(a + b - self.prior)


class Rows:
    """Documents as the views see them."""

    def __init__(self, ids: list, text: np.ndarray, numbers: np.ndarray, codes: np.ndarray):
        self.ids, self.text, self.numbers, self.codes = ids, text, numbers, codes

    def xs(self, views: Sequence[View]) -> list[np.ndarray]:
        return [views[0].matrix(self.text, np.zeros((len(self.ids), 0), np.int64)), views[1].matrix(self.numbers, self.codes)]


def sureness(views: Sequence[View], rows: Rows) -> np.ndarray:
    """How sure each view is that a document is bad or good: ``[view, label, document]``, rounded for the sake of ties."""
    p = [sigmoid(v.log_odds(x)) for v, x in zip(views, rows.xs(views), strict=True)]
    return np.round(np.array([[1 - q, q] for q in p]), 9)


#: What a round asks the pool for: views, ids that each view has been given, and how many of each label; gives each view's new documents and their labels.
Propose = Callable[[Sequence[View], Sequence[set], Sequence[int]], Sequence[tuple[Rows, np.ndarray]]]


def co_train(known: Rows, y: np.ndarray, edges: Sequence[np.ndarray], propose: Propose, rounds: int = ROUNDS, threshold: float = 0.5) -> CoTrained:
    """Fit both views on labelled documents and, round by round, on what the other view is surest of in the pool."""
    views = [View(e) for e in edges]
    xs, ys, ids = known.xs(views), [y.astype(float)] * 2, [list(known.ids)] * 2
    n, base = len(y), float(y.mean()) if len(y) else 1.0
    folds = fold_of(known.ids)
    aside = folds == 0
    handed = [max(1, round(HANDED * share)) for share in (1 - base, base)]
    taken: list[set] = [set(), set()]
    for _ in range(rounds):
        # A view is as sure as it is right on true labels that it has not seen; one that tells nothing hands over nothing.
        seen = [np.concatenate([~aside, np.ones(len(t) - n, bool)]) for t in ys]
        if not aside.any() or any(len(np.unique(t[s])) < 2 for t, s in zip(ys, seen, strict=True)):
            break
        for v, x, t, s in zip(views, xs, ys, seen, strict=True):
            v.model.fit(x[s], t[s])
            v.calibrate(v.model.logit(x[:n][aside]), y[aside].astype(float))
        found = propose(views, taken, handed)
        for i, (rows, labels) in enumerate(found):
            taken[i] = taken[i] | set(rows.ids)
            xs[i], ys[i], ids[i] = np.concatenate([xs[i], rows.xs(views)[i]]), np.concatenate([ys[i], labels.astype(float)]), ids[i] + list(rows.ids)
        if not any(len(labels) for _, labels in found):
            break
    for v, x, t, who in zip(views, xs, ys, ids, strict=True):
        v.model.fit(x, t)
        if n:
            v.calibrate(held_out(x, t, fold_of(who), _RIDGE)[:n], y.astype(float))
    prior = min(max(base, 1e-3), 1 - 1e-3) if n else 0.5
    return CoTrained(views[0], views[1], math.log(prior / (1 - prior)), threshold)


def _codes(values: Sequence[list]) -> np.ndarray:
    columns = [[0 if v is None else 1 + xxhash.xxh3_64_intdigest(str(v).encode()) % (BUCKETS - 1) for v in column] for column in values]
    return np.array(columns, np.int64).T.reshape(-1, len(values))


def _numbers(column: list) -> np.ndarray:
    return np.array([math.nan if v is None else math.log1p(max(0, v)) for v in column], float)[:, None]


META = ("lang", "source")


def _narrow(docs: DataFrame, keep: list[str]) -> DataFrame:
    """``doc_id, text``, the metadata and the kept columns, the latter under names of their own."""
    return docs.select("doc_id", "text", *META, F.col("n_chars").cast("double").alias("n_chars"), *[F.col(f"`{c}`").alias(f"kept{i}") for i, c in enumerate(keep)])


def _featured(docs: DataFrame) -> DataFrame:
    """``doc_id, x`` (the content view's features) and the metadata of every document."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(rows):
        for batch in batches(rows):
            found = [text_features(t) for t in strings(batch.column("text"))]
            features = pa.ListArray.from_arrays(pa.array(np.arange(0, len(found) * TEXT_FEATURES + 1, TEXT_FEATURES), pa.int32()), pa.array([v for f in found for v in f], pa.float64()))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), features, *[batch.column(c) for c in META], batch.column("n_chars")], names=["doc_id", "x", *META, "n_chars"])

    return _narrow(docs, []).mapInArrow(run, f"doc_id {kind}, x array<double>, lang string, source string, n_chars double")


def _rows(got: list) -> Rows:
    x = np.array([r["x"] for r in got], float).reshape(len(got), TEXT_FEATURES)
    return Rows([r["doc_id"] for r in got], x, _numbers([r["n_chars"] for r in got]).reshape(len(got), META_NUMBERS), _codes([[r[c] for r in got] for c in META]).reshape(len(got), len(META)))


def _edges(featured: DataFrame) -> list[np.ndarray]:
    """The bins' edges of the text features and of the lengths: quantiles over all documents."""
    at = [i / BINS for i in range(1, BINS)]
    asked = [F.percentile_approx(F.col("x")[i], at, 1000) for i in range(TEXT_FEATURES)] + [F.percentile_approx("n_chars", at, 1000)]
    found = [q or [0.0] * (BINS - 1) for q in featured.agg(*[q.alias(f"q{i}") for i, q in enumerate(asked)]).first()]
    return [np.array(found[:TEXT_FEATURES], float), np.array([_numbers(found[TEXT_FEATURES])[:, 0]])]


def _proposed(pool: DataFrame, views: Sequence[View], taken: Sequence[set], handed: Sequence[int]) -> list[tuple[Rows, np.ndarray]]:
    """For each view the documents of the whole pool that the other is surest of.

    Each task keeps what is sure enough; the surest are ranked within seats
    first and then among the seats' best, so no task gathers more than
    ``SEATS`` times what is handed over.
    """
    kind = pool.schema["doc_id"].dataType.simpleString()
    names = ["doc_id", "x", *META, "n_chars"]

    def run(batches_):
        for batch in batches_:
            got = batch.to_pylist()
            rows = _rows(got)
            sure = sureness(views, rows)
            for mine in (0, 1):
                free = np.array([i not in taken[1 - mine] for i in rows.ids], bool)
                for label in (0, 1):
                    some = np.flatnonzero(free & (sure[mine, label] >= SURE))
                    if len(some):
                        part = batch.take(pa.array(some))
                        yield pa.RecordBatch.from_arrays(
                            [*part.columns, pa.array(np.full(len(some), 1 - mine, np.int32)), pa.array(np.full(len(some), label, np.int32)), pa.array(sure[mine, label][some])],
                            names=[*names, "view", "label", "sure"],
                        )

    sure = pool.select(*names).mapInArrow(run, f"doc_id {kind}, x array<double>, lang string, source string, n_chars double, view int, label int, sure double")
    most = F.when(F.col("label") == 1, handed[1]).otherwise(handed[0])
    for key in (["view", "label", "seat"], ["view", "label"]):
        place = F.row_number().over(Window.partitionBy(*key).orderBy(F.desc("sure"), "doc_id"))
        sure = sure.withColumn("seat", F.pmod(F.xxhash64("doc_id"), F.lit(SEATS))).withColumn("place", place).where(F.col("place") <= max(handed)).where(F.col("place") <= most).drop("place")
    got = sure.orderBy("view", "label", F.desc("sure"), "doc_id").collect()
    return [(_rows(part := [r for r in got if r["view"] == v]), np.array([r["label"] for r in part], np.int64)) for v in (0, 1)]


def train_quality(spark: SparkSession, docs: DataFrame, labels: DataFrame, labelled: int = MAX_LABELLED) -> CoTrained:
    """Fit on at most ``labelled`` labelled documents, chosen by a hash of their ids, and on all documents without a label.

    Every document's features are written once. A document that shares its id
    with others counts once among the labelled, and for each of its rows in the pool.
    """
    known = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.min("quality").cast("int").alias("y"))
    kind = docs.schema["doc_id"].dataType.simpleString()
    featured = Stage(spark, "quality").put(_featured(docs).where("doc_id is not null").join(known, "doc_id", "left"), "features")
    sample = spark.createDataFrame([(i,) for i in sample_ids(known, labelled)], f"doc_id {kind}")
    # At most ``labelled`` ids are broadcast, and as many rows collected.
    got = featured.where("y is not null").join(F.broadcast(sample), "doc_id").groupBy("doc_id").agg(F.min(F.struct("x", *META, "n_chars", "y")).alias("r")).select("doc_id", "r.*").collect()
    got.sort(key=lambda r: r["doc_id"])
    pool = featured.where("y is null")
    return co_train(_rows(got), np.array([r["y"] for r in got], np.int64), _edges(featured), lambda views, taken, handed: _proposed(pool, views, taken, handed))


def score_quality(docs: DataFrame, model: CoTrained, keep: list[str] | None = None) -> DataFrame:
    """``doc_id, text_score, meta_score, score, keep`` and the columns in ``keep``; a map without shuffle."""
    keep = keep or []

    def run(rows):
        none = np.zeros((0, 0), np.int64)  # the content view has no categories
        for batch in batches(rows):
            n = batch.num_rows
            text = np.array([text_features(t) for t in strings(batch.column(1))]).reshape(n, TEXT_FEATURES)
            codes = _codes([batch.column(2 + i).to_pylist() for i in range(len(META))])
            numbers = _numbers(batch.column(2 + len(META)).to_pylist()).reshape(n, META_NUMBERS)
            a, b, both = model.scores(model.content.matrix(text, none), model.meta.matrix(numbers, codes))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *[pa.array(np.round(v, 6)) for v in (a, b, both)], pa.array(both >= model.threshold), *batch.columns[3 + len(META) :]],
                names=["doc_id", "text_score", "meta_score", "score", "keep", *keep],
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    kinds = "".join(f", `{c}` {docs.schema[c].dataType.simpleString()}" for c in keep)
    return _narrow(docs, keep).mapInArrow(run, f"doc_id {kind}, text_score double, meta_score double, score double, keep boolean{kinds}")


def quality(spark: SparkSession, docs: DataFrame, labels: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """Fit on a bounded sample of the labels and all that has none, and score all documents.

    ``docs`` has ``doc_id, text, lang, source, n_chars``, ``labels`` has
    ``doc_id, quality`` (0 or 1; of repeated ids the least holds). Scores are
    probabilities of good quality, rounded to six places; ``keep`` holds from
    one half. Null texts count as empty, null metadata has its own category or
    bin; null labels are skipped; without labels all is kept; null ids are
    scored and stay null; repeated rows are scored each; an empty table gives
    none; other columns are ignored.
    """
    return score_quality(docs, train_quality(spark, docs, labels), keep)
