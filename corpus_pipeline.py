"""A corpus pipeline: quality, toxicity, near copies, packing.

Each stage takes what its predecessor kept, written as Parquet and read again.
All but the last return rows with the columns of ``documents``.
"""

from __future__ import annotations

import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from blockloom.llm import jaccard_join, quality, toxicity
from blockloom.llm.common import Stage, bound_batches
from blockloom.llm.queries import packed, table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: SQL cannot express fitted models; the tests hold the stages against brute force.
ORACLE_SQL = None


def _columns(docs: DataFrame) -> DataFrame:
    """The columns of documents; any that is missing is null."""
    kinds = {"doc_id": "bigint", "n_chars": "bigint"}
    return docs.select(*[F.col(c) if c in docs.columns else F.lit(None).cast(kinds.get(c, "string")).alias(c) for c in COLUMNS])


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops what the co-trained classifier rejects; the text passes through its map, so nothing is joined.

    A null text counts as empty, null metadata as a kind of its own; null ids
    are scored and stay null; each of repeated rows is judged alike; without
    labels all stay; an empty table stays empty; other columns are left out.
    """
    rest = COLUMNS[1:]
    scored = quality.quality(spark, _columns(docs), table(spark, sf_dir, "labels"), keep=rest)
    return scored.where("keep").select(*COLUMNS)


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops what the classifier chain calls toxic.

    A null or empty text has no words and gets the constant; null ids are
    scored and stay null; each of repeated rows is judged alike; without toxic
    labels all stay; an empty table stays empty; other columns are left out.
    """
    rest = COLUMNS[1:]
    scored = toxicity.toxicity(spark, _columns(docs), table(spark, sf_dir, "labels"), keep=rest)
    return scored.where("not toxic").select(*COLUMNS)


def dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near copies: that of the least row number, which is unique, so there are no ties.

    Texts that are null, empty or without words are no copies of anything and
    all stay; of repeated rows one stays, whatever their ids; an empty table
    stays empty; other columns are left out.
    """
    bound_batches(spark)
    return jaccard_join.keep_one(spark, _columns(docs)).select(*COLUMNS)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs the remaining documents; returns pieces.

    A null or empty text is its end id alone; repeated rows and null ids are
    packed each; ties in length are dealt by a hash; an empty table gives no
    pieces; other columns are left out.
    """
    bound_batches(spark)
    return packed(spark, _columns(docs))


STAGES = [
    ("quality classifier", quality_stage),
    ("toxicity", toxicity_stage),
    ("n-gram jaccard join", dedup_stage),
    ("packing", packing_stage),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    written = Stage(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = written.put(docs, f"stage{i}")
            if i:
                written.drop(f"stage{i - 1}")
    return docs


if __name__ == "__main__":
    session = SparkSession.builder.getOrCreate()
    run(session, sys.argv[1]).write.mode("overwrite").parquet(sys.argv[2])
    Stage.drop_all()
