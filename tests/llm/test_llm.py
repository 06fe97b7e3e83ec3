"""The training-data operators against brute force, libraries and held-out labels."""

import hashlib
import math
import random
import tracemalloc
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from blockloom.llm import ann, byte_bpe, chat, jaccard_join, packing, quality, queries, token_counts, topk, toxicity, warc

DATA = "/root/testdata/sf0.001"
DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"
#: Null and empty texts, ties, repeated rows, null ids, odd characters, a very long text.
ODD = [
    (1, None), (2, ""), (3, "   \n\t "), (4, "one two three four five six"), (4, "one two three four five six"), (None, "one two three four five six"), (5, "word"), (6, "naïve 漢字 😀 \u0000 é"),
    (7, "long words here " * 5000), (8, "x" * 3000), (9, " " * 3000 + "."), (10, "it's 12345 don't!!  \n\n a<|endoftext|>b"),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{DATA}/documents.parquet")


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(i, t, "en" if i else None, None, None if t is None else len(t)) for i, t in ODD]
    return spark.createDataFrame(rows, DOCS).withColumns({"rid": F.lit("clash"), "score": F.lit(1), "ids": F.lit(2), "part": F.lit("x")})


def texts_of(df):
    return {r["doc_id"]: r["text"] for r in df.select("doc_id", "text").collect()}


# --- 1 ---------------------------------------------------------------------------------


def greedy(word, pieces, longest):
    at = n = 0
    while at < len(word):
        for to in range(min(len(word), at + longest), at, -1):
            if tuple(word[at:to]) in pieces:
                at, n = to, n + 1
                break
        else:
            return 1
    return n


def test_automaton_equals_greedy_matching():
    rng = random.Random(1)
    for _ in range(300):
        pieces = {tuple(rng.choices([1, 2, 3], k=rng.randrange(1, 5))) for _ in range(rng.randrange(1, 9))}
        auto = token_counts.Automaton(pieces)
        for _ in range(20):
            word = rng.choices([1, 2, 3], k=rng.randrange(0, 12))
            assert auto.count(word) == greedy(word, pieces, 5), (pieces, word)


def test_token_counts(spark, docs, odd):
    path = public_tokenizers.path("word_bpe_49k.json")
    pieces = {tuple(p) for p in token_counts.load_pieces(path)}
    longest, split = max(map(len, pieces)), __import__("regex").compile(token_counts.SPLIT).findall
    for df in (docs, odd):
        got = sorted((r["doc_id"] or -1, r["n_words"], r["n_tokens"]) for r in token_counts.token_counts(df, path).collect())
        memo = {}
        want = []
        for r in df.select("doc_id", "text").collect():
            found = split((r["text"] or "").lower())
            for w in found:
                if w not in memo:
                    memo[w] = greedy(token_counts.byte_symbols(w), pieces, longest)
            want.append((r["doc_id"] or -1, len(found), sum(memo[w] for w in found)))
        assert got == sorted(want)
    assert token_counts.token_counts(odd.limit(0), path).count() == 0


# --- 3 ---------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def bpe_path():
    return public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def test_bpe_equals_the_library(spark, docs, odd, bpe_path):
    import base64

    import tiktoken

    with open(bpe_path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    for df in (docs, odd):
        want = []
        for r in df.select("doc_id", "text").collect():
            raw = (r["text"] or "").encode()
            ids = np.array(library.encode_ordinary(r["text"] or ""), "<u4")
            want.append((r["doc_id"] or -1, len(ids), hashlib.sha256(ids.tobytes()).hexdigest(), hashlib.sha256(raw).hexdigest()))
        got = byte_bpe.bpe_digests(df, bpe_path, public_tokenizers.PATTERN).collect()
        assert sorted((r["doc_id"] or -1, *r[1:]) for r in got) == sorted(want)
    encoded = byte_bpe.bpe_encode(odd, bpe_path, public_tokenizers.PATTERN)
    back = byte_bpe.bpe_decode(encoded, bpe_path, public_tokenizers.PATTERN).collect()
    assert sorted(bytes(r["bytes"]) for r in back) == sorted((t or "").encode() for _, t in ODD)


def test_perfect_hash():
    keys = [str(i * i).encode() for i in range(3000)]
    table = byte_bpe.PerfectHash(keys)
    assert [table.find(k) for k in keys] == list(range(3000)) and sorted(table.slot_key) == list(range(3000))
    assert table.find(b"no") == -1 and byte_bpe.PerfectHash([b"a"]).find(b"a") == 0 and byte_bpe.PerfectHash([]).find(b"a") == -1


# --- 2 ---------------------------------------------------------------------------------


def shingle_set(text, n=5):
    import re

    found = re.findall(r"\w+", (text or "").lower())
    k = min(n, len(found))
    return frozenset(tuple(found[i : i + k]) for i in range(len(found) - k + 1)) if found else frozenset()


def links_by_brute_force(texts, threshold=0.8):
    sets = [shingle_set(t) for t in texts]
    links = [set() for _ in texts]
    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and len(a & b) >= (threshold - 1e-9) * len(a | b):
                links[i].add(j)
                links[j].add(i)
    root = list(range(len(texts)))
    changed = True
    while changed:
        changed = False
        for i, near in enumerate(links):
            low = min([root[i], *(root[j] for j in near)])
            changed |= low < root[i]
            root[i] = low
    return links, root


def varied(seed=3):
    """Groups of copies with a word or more changed, and documents that share a passage."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choices("abcdefgh", k=5))
    passage, out = [word() for _ in range(40)], []
    for _ in range(12):
        base = [word() for _ in range(rng.randrange(5, 120))]
        for _ in range(rng.randrange(1, 9)):
            copy = list(base)
            for _ in range(rng.randrange(0, 4)):
                copy[rng.randrange(len(copy))] = word()
            out.append(" ".join(copy))
    out += [" ".join(passage + [word() for _ in range(rng.randrange(2, 60))]) for _ in range(60)]
    base = [word() for _ in range(200)]
    for i in range(300):  # more near copies than a leaf or a block holds
        copy = list(base)
        copy[i % 200] = word()
        out.append(" ".join(copy))
    base = [word() for _ in range(90)]
    for i in range(160):  # copies that lie so far apart that no bound tells which are linked
        copy = list(base)
        for _ in range(i % 8):
            copy[rng.randrange(30)] = word()
        out.append(" ".join(copy))
    return out


def test_jaccard_join_equals_brute_force(spark, monkeypatch):
    monkeypatch.setattr(jaccard_join, "LEAF", 16)
    monkeypatch.setattr(jaccard_join, "BLOCK", 64)
    texts = varied()
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").repartition(5)
    links, root = links_by_brute_force(texts)
    got = {r["doc_id"]: (r["class_id"], r["n_links"]) for r in jaccard_join.jaccard_join(spark, rows).collect()}
    assert got == {i: (root[i], len(links[i])) for i in range(len(texts))}
    kept = jaccard_join.keep_one(spark, rows).collect()
    assert sorted(root[r["doc_id"]] for r in kept) == sorted(set(root))


def test_overlaps_of_many_long_sets_fit_beside_another_worker(monkeypatch):
    rng = np.random.default_rng(5)
    base = np.unique(rng.integers(0, 1 << 32, 16_000, dtype=np.uint64)).astype(np.uint32)
    sets = [np.unique(np.concatenate([rng.choice(base, 9_000, False), rng.integers(0, 1 << 32, 7_000, dtype=np.uint64).astype(np.uint32)])) for _ in range(128)]
    total = sum(map(len, sets))
    tracemalloc.start()
    found = jaccard_join.overlaps(sets)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 36 * total  # bytes; indices of 64 bits beside the elements took 54 for each
    for i, j in ((0, 1), (5, 127), (64, 63)):
        assert found[i, j] == len(np.intersect1d(sets[i], sets[j]))
    for elements, width in ((1 << 22, 1000), (total // 7, 1 << 14), (100_000, 77)):
        monkeypatch.setattr(jaccard_join, "_ELEMENTS", elements)
        monkeypatch.setattr(jaccard_join, "_WIDTH", width, raising=False)
        assert (jaccard_join.overlaps(sets) == found).all()
        assert (jaccard_join.overlaps(sets[:50], sets[50:]) == found[:50, 50:]).all()


def missed_pairs(splits, runs, coords, fresh, pairs=3000, similarity=0.8):
    """Share of simulated pairs that no run keeps together; the runs share their coordinates unless they are fresh."""
    rng, missed = random.Random(splits), 0
    for _ in range(pairs):
        equal = [rng.random() < similarity for _ in range(coords)]
        for _ in range(runs):
            if fresh:
                equal = [rng.random() < similarity for _ in range(coords)]
            forks = int(rng.choice(equal))
            for _ in range(splits - 1):
                forks = sum(rng.choice(equal) for _ in range(forks) for _ in range(1 + (rng.randrange(jaccard_join.FORK) == 0)))
            if forks:
                break
        else:
            missed += 1
    return missed / pairs


def test_jaccard_join_runs_follow_the_splits():
    assert missed_pairs(7, jaccard_join.runs_for(0.8, 0.999), 64, False) > 0.01  # why later rounds are needed
    assert jaccard_join.ROUNDS[0] == jaccard_join.USUAL_DEPTH and jaccard_join.ROUNDS[-1] == jaccard_join.LEVELS
    for splits in jaccard_join.ROUNDS[1:]:
        assert missed_pairs(splits, jaccard_join.later_runs_for(0.8, 0.999, splits), jaccard_join.RUN_COORDS, True) <= 0.002


def test_jaccard_join_of_odd_rows(spark, odd):
    got = sorted((r["doc_id"] or -1, r["class_id"] if r["class_id"] is not None else -1, r["n_links"]) for r in jaccard_join.jaccard_join(spark, odd).collect())
    assert got == [(-1, 4, 2), (1, 1, 0), (2, 2, 0), (3, 3, 0), (4, 4, 2), (4, 4, 2), (5, 5, 0), (6, 6, 0), (7, 7, 0), (8, 8, 0), (9, 9, 0), (10, 10, 0)]
    assert jaccard_join.jaccard_join(spark, odd.limit(0)).count() == 0
    kept = jaccard_join.keep_one(spark, odd)
    assert kept.columns == odd.columns and kept.count() == len(ODD) - 2


def test_components(spark):
    from blockloom.llm.common import Stage

    edges = [(i + 1, i) for i in range(40)] + [(100, 50), (100, 90), (90, 80)]
    got = jaccard_join.components(Stage(spark, "t"), spark.createDataFrame(edges, "a bigint, b bigint")).collect()
    assert {r["node"]: r["least"] for r in got} == {i: 0 for i in range(1, 41)} | {100: 50, 90: 50, 80: 50}


# --- 4 and 5 ----------------------------------------------------------------------------

VECS = "vec_id bigint, embedding array<float>, label int"


def vectors(n=1500, d=16, seed=0):
    rng = np.random.default_rng(seed)
    x = (rng.normal(size=(n, d)) * rng.lognormal(size=(n, 1))).astype(np.float32)
    x[n // 2 : n // 2 + 40] = x[0]  # one common vector, with ties
    return x


def frame(spark, x, more=()):
    return spark.createDataFrame([(i, v.tolist(), 0) for i, v in enumerate(x)] + list(more), VECS)


BAD_VECTORS = [(9001, None, 0), (9002, [], 0), (9003, [1.0, None], 0), (9004, [float("nan")] * 16, 0), (9005, [float("inf")] * 16, 0), (None, [1.0] * 16, 0), (0, None, 0)]


def brute(x, queries, k=20):
    for q in queries:
        score = x @ x[q]
        order = [i for i in np.lexsort((np.arange(len(x)), -score)) if i != q][:k]
        yield q, order, score


def test_exact_top_k_equals_brute_force(spark):
    x = vectors()
    got = topk.exact_top_k(spark, frame(spark, x, BAD_VECTORS), shard_rows=400).collect()
    by = {}
    for r in sorted(got, key=lambda r: (r["query_id"], r["rank"])):
        by.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
    whole = np.floor(64 * x.astype(np.float64)).astype(np.int64)
    for q, order, score in brute(whole, range(0, len(x), 20)):
        assert by.pop(q) == [(i, score[i]) for i in order]
    assert not by


def test_pruning_of_buckets_is_exact():
    rng = np.random.default_rng(2)
    for scale in (3, 1000):
        centre = rng.normal(size=8) * scale
        x = (centre + rng.normal(size=(3000, 8)) * scale / 3).astype(np.int64)  # directions close together
        q = x[::30]
        index, score = topk.NormBuckets(x, np.arange(len(x)), 5).find(q)
        for i, v in enumerate(q):
            all_ = x @ v
            assert index[i].tolist() == np.lexsort((np.arange(len(x)), -all_))[:5].tolist() and score[i].tolist() == sorted(all_, reverse=True)[:5]


def test_scores_that_fit_are_exact_whatever_the_components():
    rng = np.random.default_rng(6)
    x = rng.integers(-3, 4, (700, 64))
    x[np.arange(60), rng.integers(2, 64, 60)] = 1 << 31  # each score fits, sums of bounds do not
    x[60, :2], x[61, :2] = (1 << 40, 1 << 40), ((1 << 40) + 1, -(1 << 40))  # terms beyond 64 bits that cancel
    x[60, 2:], x[61, 2:] = 0, 0
    fits = np.delete(x, 60, 0)  # the score of row 60 with itself does not fit
    for rows, q in ((fits, fits[:60]), (x[[61, *range(100, 700)]], x[60:61])):
        index, score = topk.NormBuckets(rows, np.arange(len(rows)), 5).find(q)
        for i, v in enumerate(q.tolist()):
            all_ = [sum(a * b for a, b in zip(v, r)) for r in rows.tolist()]
            best = sorted(range(len(rows)), key=lambda j: (-all_[j], j))[:5]
            assert index[i].tolist() == best and score[i].tolist() == [all_[j] for j in best]
    with pytest.raises(ArithmeticError):
        topk.NormBuckets(x, np.arange(len(x)), 5).find(x[60:61])


def test_few_and_no_vectors(spark):
    few = frame(spark, vectors(60)[:7, :3], BAD_VECTORS)
    for run in (topk.exact_top_k, ann.nearest):
        got = run(spark, few).collect()
        assert sorted(r["rank"] for r in got) == [1, 2, 3, 4, 5, 6] and {r["query_id"] for r in got} == {0}
        assert run(spark, few.limit(0)).count() == 0
        assert run(spark, frame(spark, [], BAD_VECTORS)).count() == 0
    zero = spark.createDataFrame([(0, [0.0, 0.0], 0), (20, [1.0, 0.0], 0), (21, [2.0, 0.0], 0)], VECS)
    assert {r["vec_id"] for r in ann.nearest(spark, zero).collect()} == {20, 21} - {20} and topk.exact_top_k(spark, zero).count() == 4


def recall_of(spark, x, shard_rows):
    got = ann.nearest(spark, frame(spark, x, BAD_VECTORS), shard_rows=shard_rows).collect()
    by = {}
    for r in sorted(got, key=lambda r: (r["query_id"], r["rank"])):
        by.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
    hit = total = 0
    wide = x.astype(np.float64)
    for q, order, score in brute(wide, range(0, len(x), 20)):
        assert len(by[q]) == 20 and all(abs(s - score[i]) < 1e-9 * max(1, abs(s)) for i, s in by[q])
        assert by[q] == sorted(by[q], key=lambda p: (-p[1], p[0]))
        hit, total = hit + len({i for i, _ in by[q]} & set(order)), total + 20
    return hit / total


def test_graph_recall(spark):
    assert recall_of(spark, vectors(3000), 1000) >= 0.95
    x = np.random.default_rng(3).normal(size=(3000, 64)).astype(np.float32)
    assert recall_of(spark, x / np.linalg.norm(x, axis=1)[:, None], 3000) >= 0.95  # one graph of all, without any structure


@pytest.mark.parametrize("dim, lengths", [(16, False), (64, False), (64, True), (256, False)])
def test_every_search_goes_through_a_graph(monkeypatch, dim, lengths):
    """All vectors are in graphs, however few are of a length, and every point of a graph can be reached."""
    made, rng = [], np.random.default_rng(dim)
    init = ann.Graph.__init__
    monkeypatch.setattr(ann.Graph, "__init__", lambda self, x, *a, **b: (init(self, x, *a, **b), made.append(self))[0])
    x = rng.normal(size=(1500, dim))
    x *= rng.lognormal(size=(len(x), 1)) if lengths else 1 / np.linalg.norm(x, axis=1)[:, None]
    x[40:50] = x[40] * (1 + 1e-9 * np.arange(10))[:, None]  # one point to the graph
    index, score = ann._searcher(x, 21)(x[::30])
    assert sum(len(g.x) for g in made) == len(x) and (lengths or len(made) == 1)
    for g in made:
        seen, front = {g.entry}, [g.entry]
        while front:
            front = [v for v in {int(e) for u in front for e in g.edges[u] if e >= 0} if v not in seen]
            seen.update(front)
        assert len(seen) == len(g.x)
    want = np.sort(x[::30] @ x.T, 1)[:, ::-1][:, :21]
    assert (np.sort(score, 1)[:, ::-1][:, :21] >= want - 1e-6).mean() >= 0.95


def test_clashing_names_beside_vectors(spark):
    odd = frame(spark, vectors(60)).withColumns({"id": F.lit("x"), "vec": F.lit(1), "ids": F.lit(2), "shard": F.lit(3), "kind": F.lit(4), "rank": F.lit(5), "score": F.lit(6), "dim": F.lit(7)})
    for run in (topk.exact_top_k, ann.nearest):
        assert run(spark, odd).count() == 60


# --- 6 and 9 ----------------------------------------------------------------------------


def test_quality_on_held_out_labels(spark):
    data = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{data}/documents.parquet"), spark.read.parquet(f"{data}/labels.parquet")
    seen, held = labels.where("doc_id % 3 <> 0"), labels.where("doc_id % 3 = 0")
    sample = docs.join(labels.select("doc_id"), "doc_id", "left_semi")
    right = quality.quality(spark, sample, seen).join(held, "doc_id").agg(F.avg((F.col("keep") == (F.col("quality") == 1)).cast("int")), F.count("*")).first()
    assert right[0] >= 0.99 and right[1] > 1000
    judged = toxicity.toxicity(spark, sample, seen).withColumnRenamed("toxic", "called").join(held, "doc_id").groupBy("called", "toxic").count().collect()
    n = {(r["called"], r["toxic"]): r["count"] for r in judged}
    # One in fourteen texts labelled toxic here holds no toxic word at all.
    assert n.get((True, 0), 0) <= 3 and n[True, 1] / (n[True, 1] + n.get((False, 1), 0)) >= 0.87


def test_classifiers_on_odd_rows(spark, odd, docs):
    labels = spark.read.parquet(f"{DATA}/labels.parquet")
    broken = labels.limit(5).withColumns({"quality": F.lit(None).cast("int"), "toxic": F.lit(None).cast("int")}).unionByName(labels).unionByName(labels)
    mixed = odd.select("doc_id", "text", "lang", "source", "n_chars").unionByName(docs)
    for run in (quality.quality, toxicity.toxicity):
        assert run(spark, odd, broken).count() == len(ODD)
        assert run(spark, odd.limit(0), broken).count() == 0
        none = run(spark, odd, broken.limit(0)).collect()
        assert len(none) == len(ODD) and all(r["keep"] if "keep" in r else not r["toxic"] for r in none)
        assert run(spark, mixed, broken).count() == len(ODD) + docs.count()


def test_classifiers_take_any_id_and_language(spark, docs):
    """Ids that are strings, and a language whose name is no column name."""
    labels = spark.read.parquet(f"{DATA}/labels.parquet").withColumn("doc_id", F.concat(F.lit("d"), "doc_id"))
    named = docs.withColumn("doc_id", F.concat(F.lit("d"), "doc_id")).withColumn("lang", F.when(F.col("doc_id").like("%1"), F.lit("a`b .c")).otherwise(F.col("lang")))
    for run in (quality.quality, toxicity.toxicity):
        assert run(spark, named, labels).count() == docs.count()


def plain_logistic(x, y, ridge, steps=15):
    """Newton's method in plain loops."""
    n, d = len(x), len(x[0]) if x else 0
    prior = (sum(y) + 0.5) / (n + 1)
    w = [0.0] * d + [math.log(prior / (1 - prior))]
    if n == 0 or min(y) == max(y):
        return w
    keep = [ridge] * d + [1e-6]
    for _ in range(steps):
        gradient, hessian = [k * v for k, v in zip(keep, w)], [[keep[i] if i == j else 0.0 for j in range(d + 1)] for i in range(d + 1)]
        for row, target in zip(x, y):
            row = [*row, 1.0]
            p = 1 / (1 + math.exp(-max(-35, min(35, sum(a * b for a, b in zip(row, w))))))
            for i, a in enumerate(row):
                gradient[i] += a * (p - target)
                for j, b in enumerate(row):
                    hessian[i][j] += a * b * (p * (1 - p) + 1e-6)
        step = np.linalg.solve(hessian, gradient)
        step = step * min(1.0, 10.0 / (max(map(abs, step)) + 1e-12))
        w = [a - b for a, b in zip(w, step)]
        if max(map(abs, step)) < 1e-5:
            break
    return w


def plain_chain(rows, ys):
    """Scores of the last category for ``(id, text)`` rows, all of them labelled, as the chain must give them."""
    import re

    sets = []
    for _, text in rows:
        held = {}
        for w in set(re.findall(r"\w+", (text or "").lower())):
            for f in toxicity.features_of(w):
                held[f] = held.get(f, 0) + 1
        sets.append(held)
    total, chosen = len(rows), []
    for y in ys:
        n, n1 = {}, {}
        for held, v in zip(sets, y):
            for f in held:
                n[f], n1[f] = n.get(f, 0) + 1, n1.get(f, 0) + v
        chi = {f: round((n1[f] - c * sum(y) / total) ** 2 / (c * sum(y) / total), 9) for f, c in n.items() if c >= toxicity.LEAST_DOCS} if 0 < sum(y) < total else {}
        chosen.append([f for f in sorted(chi, key=lambda f: (-chi[f], f)) if chi[f] > 0][: toxicity.FEATURES])
    folds = toxicity.fold_of([i for i, _ in rows])
    fitted, earlier = [], [[] for _ in rows]  # out-of-fold, for training
    dot = lambda row, w: sum(a * b for a, b in zip(row, w)) + w[-1]
    squash = lambda z: 1 / (1 + math.exp(-max(-35, min(35, z))))
    for y, feats in zip(ys, chosen):
        x = [[float(h.get(f, 0)) for f in feats] + e for h, e in zip(sets, earlier)]
        fitted.append(plain_logistic(x, y, toxicity._RIDGE))
        out = [0.0] * total
        for k in set(folds.tolist()):
            w = plain_logistic([r for r, f in zip(x, folds) if f != k], [v for v, f in zip(y, folds) if f != k], toxicity._RIDGE)
            out = [squash(dot(r, w)) if f == k else o for r, f, o in zip(x, folds, out)]
        earlier = [e + [o] for e, o in zip(earlier, out)]
    scores = []
    for h in sets:
        p = []
        for feats, w in zip(chosen, fitted):
            p.append(squash(dot([float(h.get(f, 0)) for f in feats] + p, w)))
        scores.append(p[-1])
    return scores


def test_toxicity_equals_plain_loops(spark, monkeypatch):
    monkeypatch.setattr(toxicity, "FEATURES", 6)
    monkeypatch.setattr(toxicity.best_features, "__defaults__", (6,))
    rng = random.Random(8)
    vocabulary = {"en": ["vile", "mean"], "de": ["mies"], "xx": ["brr"]}
    rows, bad = [], []
    for i in range(90):
        lang = rng.choice(["en", "en", "de", "xx"])
        said = rng.choices("the a of und ist da la".split(), k=8)
        bad.append(int(rng.random() < 0.4))
        rows.append((i, " ".join(said + [rng.choice(vocabulary[lang])] * bad[-1]), lang))
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    labels = spark.createDataFrame([(i, b) for i, b in enumerate(bad)], "doc_id bigint, toxic int")
    count = {lang: sum(b for r, b in zip(rows, bad) if r[2] == lang) for lang in vocabulary}
    order = sorted(count, key=lambda lang: (-count[lang], lang))
    ys = [[b * (r[2] == lang) for r, b in zip(rows, bad)] for lang in order] + [[0] * len(rows), bad]
    want = plain_chain([r[:2] for r in rows], ys)
    got = {r["doc_id"]: (r["score"], r["toxic"]) for r in toxicity.toxicity(spark, docs, labels).collect()}
    assert all(abs(got[i][0] - want[i]) < 2e-6 and got[i][1] == (got[i][0] >= 0.5) for i in range(len(rows)))


def plain_proposals(rows, calls):
    """What a round asks for, from a pool in memory: sorted whole, view by view."""
    def propose(views, taken, handed):
        sure, out = quality.sureness(views, rows), []
        for view in (0, 1):
            picked = []
            for label in (0, 1):
                some = [i for i in range(len(rows.ids)) if sure[1 - view, label, i] >= quality.SURE and rows.ids[i] not in taken[view]]
                picked += [(i, label) for i in sorted(some, key=lambda i: (-sure[1 - view, label, i], rows.ids[i]))[: handed[label]]]
            at = np.array([i for i, _ in picked], np.int64)
            out.append((quality.Rows([rows.ids[i] for i in at], rows.text[at], rows.numbers[at], rows.codes[at]), np.array([v for _, v in picked], np.int64)))
        calls.append(sum(len(v) for _, v in out))
        return out

    return propose


def test_views_exchange_labels():
    rng = np.random.default_rng(0)
    n = 600
    y = rng.integers(0, 2, n)
    text = np.column_stack([y + rng.normal(size=n) * 0.2, *rng.normal(size=(quality.TEXT_FEATURES - 1, n))])
    rows = lambda at, codes: quality.Rows(at.tolist(), text[at], rng.normal(size=(len(at), 1)), codes[at])
    edges = [np.quantile(text, np.linspace(0, 1, 9)[1:-1], axis=0).T, np.zeros((1, 7))]
    given = rng.random(n) < 0.2
    for codes, gives in ((np.column_stack([y * 3 + rng.integers(0, 3, n), rng.integers(0, 5, n)]), True), (rng.integers(0, 5, (n, 2)), False)):
        calls = []
        known, pool = np.flatnonzero(given), rows(np.flatnonzero(~given), codes)
        model = quality.co_train(rows(known, codes), y[known], edges, plain_proposals(pool, calls))
        every = rows(np.arange(n), codes)
        _, _, both = model.scores(*every.xs([model.content, model.meta]))
        assert ((both >= 0.5) == y).mean() > 0.95 and (sum(calls) > 100) == gives or not gives


def test_quality_equals_a_plain_pool(spark, docs, monkeypatch):
    """Scores against the same rounds over a pool that is held in memory and sorted whole."""
    monkeypatch.setattr(quality, "SEATS", 3)
    data = "/root/testdata/sf0.1"
    docs = spark.read.parquet(f"{data}/documents.parquet").where("doc_id < 3000").cache()
    labels = spark.read.parquet(f"{data}/labels.parquet").where("doc_id % 2 = 0")
    got = {r["doc_id"]: r["score"] for r in quality.quality(spark, docs, labels).collect()}
    every = sorted(docs.collect(), key=lambda r: r["doc_id"])
    y = {r["doc_id"]: r["quality"] for r in labels.collect() if r["quality"] is not None}
    as_rows = lambda some: quality._rows([r.asDict() | {"x": quality.text_features(r["text"])} for r in some])
    known = [r for r in every if r["doc_id"] in y]
    edges = quality._edges(quality._featured(docs))
    pool, calls = as_rows([r for r in every if r["doc_id"] not in y]), []
    model = quality.co_train(as_rows(known), np.array([y[r["doc_id"]] for r in known]), edges, plain_proposals(pool, calls))
    rows = as_rows(every)
    _, _, both = model.scores(*rows.xs([model.content, model.meta]))
    assert sum(calls) > 0 and len(got) == len(every)
    assert max(abs(got[r["doc_id"]] - p) for r, p in zip(every, both)) < 2e-6


# --- 7 ---------------------------------------------------------------------------------


def check_packing(pieces, rows, window=2048):
    import tokenizers

    library = tokenizers.Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = {}
    for doc_id, text in rows:
        want.setdefault(doc_id, []).append(np.array(library.encode(text or "", add_special_tokens=False).ids + [1], "<u4"))
    filled, seen = {}, {}
    for p in sorted(pieces, key=lambda p: (p["sequence_id"], p["offset"])):
        assert filled.get(p["sequence_id"], 0) == p["offset"] and p["length"] > 0
        filled[p["sequence_id"]] = p["offset"] + p["length"]
        seen.setdefault((p["doc_id"], p["doc_tokens"]), []).append(p)
    assert sorted(filled) == list(range(len(filled))) and all(n == window for s, n in filled.items() if s < len(filled) - 1) and max(filled.values(), default=0) <= window
    for doc_id, many in want.items():
        for ids in many:
            mine = sorted((p["start"], p["length"], p["ids_crc32"]) for p in seen[doc_id, len(ids)])
            copies = sum(len(x) == len(ids) for x in many)
            covered = np.zeros(len(ids), int)
            for start, length, crc in mine:
                covered[start : start + length] += 1
                assert crc == zlib.crc32(ids[start : start + length])
            assert (covered == copies).all()


def test_packing(spark, docs, odd):
    for df in (docs, odd):
        check_packing(queries.packed(spark, df).collect(), [tuple(r) for r in df.select("doc_id", "text").collect()])
    assert queries.packed(spark, odd.limit(0)).count() == 0


def test_packing_of_equal_lengths(spark):
    """All rests fall into one bin, so gaps outnumber leftovers and windows are given up."""
    rows = [(i, "a b c d e f g " * 100 + f"{i}") for i in range(60)]
    check_packing(queries.packed(spark, spark.createDataFrame(rows, "doc_id bigint, text string")).collect(), rows)


def test_packing_of_very_long_runs(spark):
    rows = [(1, "a<|endoftext|>" + " " * 600_000 + "b"), (2, "z" * 300_000), (3, "\n" * 200_000)]
    check_packing(queries.packed(spark, spark.createDataFrame(rows, "doc_id bigint, text string")).collect(), rows)


def exchanged(node, column):
    """Rows that the exchanges below a node of an executed plan wrote, of those with the column."""
    kind = node.getClass().getSimpleName()
    if kind == "AdaptiveSparkPlanExec":
        return exchanged(node.executedPlan(), column)
    if kind.endswith("QueryStageExec"):
        return exchanged(node.plan(), column)
    own = kind == "ShuffleExchangeExec" and any(node.output().apply(i).name() == column for i in range(node.output().size()))
    below = node.children()
    return own * (node.metrics().apply("shuffleRecordsWritten").value() if own else 0) + sum(exchanged(below.apply(i), column) for i in range(below.size()))


@pytest.mark.parametrize("keys", [500_000, 0])
def test_packing_exchanges_the_ids_of_leftovers_only(spark, monkeypatch, keys):
    """Pairs of half windows need no cut; the ids of few documents do, unless their keys are too many to send."""
    monkeypatch.setattr(packing, "SENT_KEYS", keys, raising=False)
    rows = [(i, " a" * 1023) for i in range(300)] + [(1000 + i, " a" * (100 + 7 * i)) for i in range(5)]
    limit = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(limit)
    spark.conf.set(limit, "-1")  # so small a table would be sent whole
    try:
        df = queries.packed(spark, spark.createDataFrame(rows, "doc_id bigint, text string"))
        check_packing(df.collect(), rows)
    finally:
        spark.conf.set(limit, before)
    n = exchanged(df._jdf.queryExecution().executedPlan(), "ids")
    assert (0 < n <= 5) if keys else n == len(rows)


def test_least_squares():
    rng = np.random.default_rng(1)
    for _ in range(20):
        a, b = rng.random((12, 6)), rng.random(12)
        x = packing.nnls(a, b)
        slope = a.T @ (b - a @ x)
        assert (x >= 0).all() and (slope <= 1e-7).all() and abs(slope[x > 1e-9]).max(initial=0) < 1e-7
    histogram = rng.integers(0, 5000, 64)
    used = np.zeros(64, int)
    for parts, times in packing.plan(histogram):
        assert sum(parts) == 64 and len(parts) <= packing.DEPTH
        np.add.at(used, np.array(parts) - 1, times)
    assert (used <= histogram).all() and used.sum() > 0.8 * histogram.sum()


# --- 8 and 10 ---------------------------------------------------------------------------

TURNS = "pair_id bigint, turn bigint, role string, text string"


def test_preference_pairs(spark):
    chosen = [(1, 0, "user", "hi"), (1, 1, "assistant", "yes"), (1, 2, "user", None), (2, 0, "user", "same"), (2, 0, "user", "same"), (3, None, "user", "x"), (None, 0, "user", "x"), (4, 0, None, "q"), (4, 5, "assistant", "")]
    rejected = [(1, 0, "user", "hi"), (1, 1, "assistant", "no"), (2, 0, "user", "same"), (5, 0, "assistant", "only")]
    a, b = (spark.createDataFrame(rows, TURNS).withColumn("part", F.lit("clash")) for rows in (chosen, rejected))
    segments = chat.preference_segments(a, b)
    pairs = {r["pair_id"]: r for r in chat.preference_pairs(segments).collect()}
    shown = lambda role, text: f"<|im_start|>{role}\n{text}<|im_end|>\n"
    one = pairs[1]
    assert (one["prompt"], one["chosen"], one["rejected"]) == (shown("user", "hi"), shown("assistant", "yes") + shown("user", ""), shown("assistant", "no"))
    assert [one["chosen"][s["from"] : s["to"]] for s in one["chosen_spans"]] == ["yes<|im_end|>\n"] and len(one["rejected_spans"]) == 1
    assert (pairs[2]["prompt"], pairs[2]["chosen"], pairs[2]["rejected"]) == (shown("user", "same"), "", "")
    assert pairs[4]["prompt"] == "" and pairs[4]["chosen"].startswith(shown("unknown", "q")) and pairs[5]["rejected"] == shown("assistant", "only") and 3 not in pairs
    assert chat.preference_segments(a.limit(0), b.limit(0)).count() == 0


def test_pairs_equal_plain_loops(spark):
    """Random conversations, long texts and odd rows: segments, pairs and their digests against a literal rendering."""
    rng = random.Random(9)
    sides = []
    for _ in range(2):
        rows = []
        for pair in range(30):
            rows += [(pair, t * 700, rng.choice(["user", "assistant", "assistant"]), rng.choice(["a", "bb", "é😀", "", None])) for t in range(rng.randrange(6))]
        sides.append(rows)
    for pair in range(30, 36):  # a shared beginning, and very long texts
        shared = [(pair, t, "user", "x" * 200_000) for t in range(3)]
        for rows in sides:
            rows += shared + [(pair, 3, "assistant", rng.choice(["y" * 300_000, "z"]))]
    plain = []
    for rows in sides:
        said = {}
        for pair, turn, role, text in rows:
            said.setdefault(pair, {})[turn] = (role, text or "")
        plain.append(said)
    want = {}
    for pair in set(plain[0]) | set(plain[1]):
        a, b = (side.get(pair, {}) for side in plain)
        first = min((t for t in set(a) | set(b) if a.get(t) != b.get(t)), default=1 << 60)
        out = {"prompt": [t for t in sorted(a.items()) if t[0] < first], "chosen": [t for t in sorted(a.items()) if t[0] >= first], "rejected": [t for t in sorted(b.items()) if t[0] >= first]}
        row, mask = {}, 0
        for part, said in out.items():
            start = digest = target = 0
            for turn, (role, text) in said:
                shown = f"<|im_start|>{role}\n{text}<|im_end|>\n"
                word = lambda *w: int(hashlib.sha256(":".join(map(str, w)).encode()).hexdigest()[:15], 16)
                digest ^= word(turn, start, len(shown), hashlib.sha256(shown.encode()).hexdigest())
                if role == "assistant" and part != "prompt":
                    target += len(text) + len("<|im_end|>\n")
                    mask ^= word(part, start + len(role) + 13, start + len(shown))
                start += len(shown)
            row |= {f"{part}_turns": len(said), f"{part}_chars": start, f"{part}_digest": digest} | ({f"{part}_target_chars": target} if part != "prompt" else {})
        want[pair] = row | {"mask_digest": mask, "pair_id": pair}
    clash = {"pair_id": F.lit(7), "c": F.lit(1), "span": F.lit(2), "first": F.lit(3), "part": F.lit(4)}
    chosen, rejected = (spark.createDataFrame(rows, TURNS).withColumnRenamed("pair_id", "conv").withColumns(clash) for rows in sides)
    segments = chat.segments_of(chat.both_sides(chosen, rejected, "conv", lambda r: F.sha2(r.cast("binary"), 256)))
    assert {r["pair_id"]: r.asDict() for r in chat.paired(segments).collect()} == want
    assert chat.paired(segments.limit(0)).count() == 0


def test_other_answers_ignore_clashing_names(spark):
    rows = [(1, 0, "user", "hi"), (1, 1, "assistant", "one"), (2, 0, "assistant", "two"), (3, 0, "user", "no answer")]
    df = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string").withColumn("pair_id", F.lit("clash"))
    text = lambda t: t["shown"].removeprefix(f"<|im_start|>{t['role']}\n").removesuffix("<|im_end|>\n")
    got = {(r["pair_id"], r["turn"]): (text(r["c"]), text(r["r"])) for r in chat.other_answers(spark, df).collect()}
    assert got == {(1, 0): ("hi", "hi"), (1, 1): ("one", "two"), (2, 0): ("two", ""), (3, 0): ("no answer", "no answer")}


@pytest.mark.parametrize("least", [-3, -(1 << 63)])
def test_pairs_of_the_query_hold_whole_texts(spark, tmp_path, monkeypatch, least):
    """op8's segments are texts of two tables matched turn by turn, whatever the conversations' numbers."""
    most = (1 << 63) - 1
    rows = [(least, 0, "user", "hi"), (least, 1, "assistant", "least"), (least + 1, 0, "assistant", "second"), (most, 0, "assistant", "greatest")]
    rows += [(5, t, "assistant" if t % 2 else "user", f"{t}" * (t % 5)) for t in range(1100)] + [(6, 3, "assistant", "é😀"), (6, 3, "assistant", "z"), (6, 4, "user", None), (7, 0, None, "alone")]
    spark.createDataFrame(rows, TURNS.replace("pair_id", "conv_id")).write.parquet(f"{tmp_path}/conversations.parquet")
    said = {}
    for pair, turn, role, text in rows:
        one = (role or "unknown", text or "")
        said.setdefault(pair, {})[turn] = min(one, said.get(pair, {}).get(turn, one))
    last = {pair: max((t for t, (role, _) in turns.items() if role == "assistant"), default=None) for pair, turns in said.items()}
    want, other = {}, []
    for pair, turns in said.items():
        at, following = last[pair], last.get(pair + 1)
        answer = said[pair + 1][following][1] if following is not None else ""
        swapped = {t: ("assistant", answer) if t == at else one for t, one in turns.items()}
        other += [(pair, t, *one) for t, one in swapped.items()]
        first = min((t for t in turns if turns[t] != swapped[t]), default=1 << 60)
        show = lambda side, kept: "".join(f"<|im_start|>{role}\n{text}<|im_end|>\n" for t, (role, text) in sorted(side.items()) if kept(t))
        want[pair] = (show(turns, lambda t: t < first), show(turns, lambda t: t >= first), show(swapped, lambda t: t >= first))
    seen, of = [], chat.segments_of
    monkeypatch.setattr(chat, "segments_of", lambda both: seen.append(of(both)) or seen[-1])
    got = {r["pair_id"]: r for r in queries.QUERIES["op8_preference_format"](spark, str(tmp_path)).collect()}
    assert {r["pair_id"]: (r["prompt"], r["chosen"], r["rejected"]) for r in chat.preference_pairs(seen[0]).collect()} == want
    assert {pair: tuple(r[f"{part}_chars"] for part in ("prompt", "chosen", "rejected")) for pair, r in got.items()} == {pair: tuple(map(len, texts)) for pair, texts in want.items()}
    two = chat.preference_segments(spark.createDataFrame(rows, TURNS), spark.createDataFrame(other, TURNS))
    assert sorted(map(repr, seen[0].collect())) == sorted(map(repr, two.collect()))


def test_long_conversations_are_summed_in_spans(spark):
    rows = [(1, i, "assistant", "x" * (i % 7)) for i in range(3000)]
    other = [(1, 0, "assistant", "y")]
    got = chat.preference_segments(spark.createDataFrame(rows, TURNS), spark.createDataFrame(other, TURNS)).where("part = 'chosen'").orderBy("turn").collect()
    at = 0
    for r in got:
        assert r["start"] == at
        at += r["n_chars"]


RECORDS = "record_id bigint, url string, at bigint, kind string, headers map<string,string>, payload_digest string"


def test_revisits(spark):
    rows = [
        (1, "http://A.example/x/?utm_source=f&b=2&a=1#t", 10, "response", {"etag": '"1"', "content-type": "t", "date": "old"}, "p1"),
        (2, "https://a.example:443/x?a=1&b=2", 20, "response", {"etag": '"2"', "last-modified": "m"}, "p2"),
        (3, "https://a.example/x?b=2&a=1&ref=z", 15, "revisit", {"etag": 'W/"1"', "date": "new", "server": "s"}, None),
        (4, "https://a.example/x?b=2&a=1", 20, "revisit", {"last-modified": "m"}, None),
        (5, "https://a.example/x?b=2&a=1", 5000, "revisit", {"etag": '"1"'}, None),
        (6, "https://a.example/x?b=2&a=1", 9, "revisit", {"etag": '"1"'}, None),
        (7, "https://a.example/x?b=2&a=1", 90000, "revisit", None, "p2"),
        (7, "https://a.example/x?b=2&a=1", 90000, "revisit", None, "p2"),
        (8, None, 1, "revisit", {}, None), (9, "https://a.example/x?b=2&a=1", None, "revisit", {}, None), (10, "https://a.example/x?b=2&a=1", 99, "revisit", None, None),
        (11, "https://a.example/x", 100, "metadata", {}, None),
    ]
    df = spark.createDataFrame(rows, RECORDS).withColumns({"address": F.lit("clash"), "span": F.lit(1)})
    for span in (1, 7, 4096):
        got = sorted((r["record_id"], r["refers_to"], r["outcome"], r["payload_digest"]) for r in warc.resolve_revisits(df, span).collect())
        none = "no earlier response"
        assert got == [(3, 1, "resolved", "p1"), (4, 2, "resolved", "p2"), (5, None, "validator mismatch", None), (6, None, none, None), (7, 2, "resolved", "p2"), (7, 2, "resolved", "p2"), (8, None, none, None), (9, None, none, None), (10, None, "no validator", None)]
    merged = warc.resolve_revisits(df).where("record_id = 3").first()["headers"]
    assert merged == {"etag": 'W/"1"', "content-type": "t", "date": "new"}
    assert warc.resolve_revisits(df.limit(0)).count() == 0


def test_revisits_equal_a_loop(spark):
    rng = random.Random(4)
    rows = [(i, f"http://h/{rng.randrange(3)}", rng.randrange(60), rng.choice(["response", "revisit"]), {"etag": f'"{rng.randrange(2)}"'}, "p") for i in range(300)]
    got = {r["record_id"]: r["refers_to"] for r in warc.resolve_revisits(spark.createDataFrame(rows, RECORDS), 8).collect()}
    for i, url, at, kind, headers, _ in rows:
        if kind == "revisit":
            before = [(a, j, h) for j, u, a, k, h, _ in rows if k == "response" and u == url and (a, j) < (at, i)]
            last = max(before, key=lambda b: b[:2], default=None)
            assert got.pop(i) == (last[1] if last and last[2] == headers else None)
    assert not got


# --- queries and pipeline ---------------------------------------------------------------


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_equals_its_sql(spark, name):
    import duckdb

    c = duckdb.connect()
    for t in ("documents", "embeddings", "pages", "conversations"):
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    got, want = queries.QUERIES[name](spark, DATA), c.sql(queries.ORACLES[name])
    order = lambda names, rows: sorted(str([r[i] for i in sorted(range(len(names)), key=names.__getitem__)]) for r in rows)
    assert sorted(got.columns) == sorted(want.columns)
    assert order(got.columns, [tuple(r) for r in got.collect()]) == order(want.columns, want.fetchall())


def test_pipeline(spark, docs):
    rows = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, rows, DATA).cache()
        assert kept.columns == corpus_pipeline.COLUMNS and 0 < kept.count() <= rows.count(), name
        rows = kept
    labels = {r["doc_id"]: r for r in spark.read.parquet(f"{DATA}/labels.parquet").collect()}
    left = [tuple(r) for r in rows.select("doc_id", "text").collect()]
    called = [labels[i] for i, _ in left if i in labels]
    assert sum(r["quality"] == 0 or r["toxic"] == 1 for r in called) <= 1
    links, root = links_by_brute_force([t for _, t in left])
    assert not any(links)
    check_packing(corpus_pipeline.run(spark, DATA).collect(), left)


def test_pipeline_stages_on_odd_rows(spark, odd, docs):
    """Nulls, empty and very long texts, repeated rows, clashing columns, missing columns and empty tables."""
    names = corpus_pipeline.COLUMNS
    given = sorted(map(str, odd.select(*names).collect()))
    for _, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, odd, DATA)
        assert kept.columns == names
        left = sorted(map(str, kept.collect()))
        assert all(left.count(r) <= given.count(r) for r in left)
        empty = stage(spark, odd.limit(0), DATA)
        assert empty.columns == names and empty.count() == 0
        assert stage(spark, odd.select("doc_id", "text"), DATA).columns == names
    stay = corpus_pipeline.dedup_stage(spark, odd, DATA).collect()
    assert len(stay) == len(ODD) - 2 and sum(r["text"] is None or not r["text"].strip() for r in stay) == 3
    check_packing(corpus_pipeline.packing_stage(spark, odd, DATA).collect(), [(i, t) for i, t in ODD])
    assert corpus_pipeline.packing_stage(spark, odd.limit(0), DATA).count() == 0
