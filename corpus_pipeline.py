"""The corpus pipeline: quality classifier, n-gram Jaccard join, benchmark decontamination, best-fit packing.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept; ``run`` writes each stage's result as Parquet
into the shared folder and rereads it for the next. The first stage drops documents whose quality score is under the cut, the second
keeps one document of each group of near copies (five words a shingle, similarity 0.8), the third drops contaminated documents and cuts
the hit spans out of others, the last packs what is left into sequences of 2048 tokens.

Defined results: null texts pass for empty ones in every stage; rows with a null doc_id are in no group of near copies and stay; rows that repeat
a doc_id are one document, of which the second stage keeps all rows or none; empty tables give empty results; columns beyond those of
documents are kept by the stages that filter and dropped by those that return new rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seqlytics.llm import decontaminate, jaccard, packing, quality
from seqlytics.llm.common import table, written


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of a quality score at the cut or above."""
    model = quality.fit(docs, table(spark, sf_dir, "labels"))
    columns = [F.col(f"`{c}`") for c in docs.columns]
    return quality.score(docs, model, column="__quality").where(F.col("__quality") >= quality.CUT_SCORE).select(*columns)


def keep_one_copy(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of near copies, the document with the smallest doc_id."""
    _, links = jaccard.link_documents(docs, n=5, percent=80)
    dropped = jaccard.components(links).where("doc <> component").select(F.col("doc").alias("doc_id"))
    return docs.join(dropped, "doc_id", "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])


def cut_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without contaminated documents; hit spans are cut out of the others, whose n_chars is counted again."""
    others = ("lang", "source", "n_chars")
    cleaned = decontaminate.scan(docs, table(spark, sf_dir, "benchmark"), others=others, cut=True)
    n_chars = F.when(F.col("n_hit") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))
    return cleaned.select(F.col("key").alias("doc_id"), "text", "lang", "source", n_chars.alias("n_chars"))


def pack_all(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every piece of every document with its sequence and its place there."""
    return packing.pack_documents(docs)


STAGES = [("quality", keep_good), ("near_copies", keep_one_copy), ("decontamination", cut_benchmark), ("packing", pack_all)]

#: Trained scores, exact set joins and packings have no SQL; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
