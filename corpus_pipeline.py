"""A training-data pipeline: quality, near-duplicates, benchmark passages, secrets, pieces.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept; run()
writes each result as Parquet to the shared folder and reads it as the next one's docs.
All stages but the last return the columns of documents, whatever else these are named.

Defined results: null and empty texts are scored like any others, are near no document, hold
no passage and no secret, and have one empty segmentation; a null doc_id is kept by every
stage that its text passes; rows that repeat a doc_id are one document after the
near-duplicates, the row with the least hash of its columns; empty tables give empty results.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillgrid.llm.neardup import near_duplicates
from quillgrid.llm.pieces import sample_encodings
from quillgrid.llm.quality import learn, score
from quillgrid.llm.queries import TOKENIZERS
from quillgrid.llm.scratch import settle, small
from quillgrid.llm.secrets import redact
from quillgrid.llm.winnow import decontaminate
from quillgrid.session import ship

#: Bytes of text that are segmented at once: executors still hold what earlier stages took, so it is less than where op2 runs alone.
PIECES_BLOCK = 1 << 18


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier (5) gives a score of 0.5 or more."""
    labels = ship(spark).read.parquet(f"{sf_dir}/labels.parquet")
    kept = score(docs, learn(docs, labels), "_quality").where("_quality >= 0.5")
    return kept.select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates (1): five-word shingles, a similarity of 0.8."""
    ship(spark)
    gone = settle(near_duplicates(docs, words_each=5, percent=80).where("not kept").select("doc_id").distinct(), "gone")
    left = docs.join(small(gone), "doc_id", "left_anti").select(*docs.columns)
    # Rows that repeat a doc_id are one document; only they are brought together.
    twice = settle(left.where("doc_id is not null").groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("doc_id"), "twice")
    if twice.isEmpty():
        return left
    once = left.join(small(twice), "doc_id", "left_anti").select(*docs.columns)
    return once.unionByName(_one_each(left.join(small(twice), "doc_id", "left_semi").select(*docs.columns)))


def _one_each(rows: DataFrame) -> DataFrame:
    """The row of each doc_id whose columns have the least hash: the same one in every run."""
    first = rows.groupBy("doc_id").agg(F.min_by(F.struct(*rows.columns), F.xxhash64(*rows.columns)).alias("_row"))
    return first.select("_row.*")


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark (6)."""
    bench = ship(spark).read.parquet(f"{sf_dir}/benchmark.parquet")
    hit = settle(decontaminate(docs, bench).where("contaminated").select(F.col("doc_id").alias("_d"), F.col("text_hash").alias("_h")).distinct(), "hit")
    hit = small(hit)
    return docs.join(hit, docs["doc_id"].eqNullSafe(hit["_d"]) & (F.xxhash64(docs["text"].cast("string")) == hit["_h"]), "left_anti")


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, secrets (3) replaced by their kind; n_chars follows."""
    ship(spark)
    return redact(docs)


def pieces(spark: SparkSession, docs: DataFrame, sf_dir: str, model_file: str = f"{TOKENIZERS}/piece_bpe_32k.model") -> DataFrame:
    """Two distinct sampled segmentations of each document (2): doc_id, rank, ids, n_pieces, log_prob, inclusion."""
    ship(spark)
    return sample_encodings(docs, model_file, k=2, block=PIECES_BLOCK).select("doc_id", "rank", "ids", "n_pieces", "log_prob", "inclusion")


STAGES = [("quality classifier", quality), ("near dedup", near_dedup), ("benchmark decontamination", decontamination), ("secret scan", secrets), ("sentencepiece", pieces)]

#: No SQL expresses a fitted classifier or sampled segmentations; tests/llm holds run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = ship(spark).read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        docs = settle(stage(spark, docs, sf_dir), f"stage{i}")
    return docs
