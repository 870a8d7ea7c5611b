"""Corpus pipeline: documents through toxicity, line dedup, near-dedup, mixing and piece encoding.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of documents. Stages
are written as Parquet and read again, which cuts lineage: a lost executor costs no more than its stage.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lodestat.llm import linear, lines, minhash, mixing, piece_bpe
from lodestat.llm.common import bounded_batches, checkpoint_folder, documents, remainder
from lodestat.llm.queries import TOXICITY_ROWS


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is below one half, by a model fitted on labelled rows among them.

    Without labelled rows of both classes every document stays.  A null text is scored as the empty one, repeated rows
    stay or go alike, and an empty table gives an empty one.
    """
    sample = linear.labelled_sample(docs, documents(spark, sf_dir, "labels"), "toxic", remainder("doc_id", 5) != 0, TOXICITY_ROWS)
    return linear.keep_below(docs, linear.fitted(sample, linear.fit_toxicity), 0.5)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that an earlier line of any document has, exactly or nearly.

    The first is by id (null first) and line number.  A document all of whose lines go is dropped; null, empty and blank texts
    stay; repeated rows are treated alike; an empty table gives an empty one.
    """
    bounded_batches(spark)
    return lines.dedup_lines(docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near-duplicates: five-word shingles, similarity 0.8 or more.

    The first by id (null last) stays, of equal rows one; texts that are null or without words all stay; an
    empty table gives an empty one.
    """
    bounded_batches(spark)
    return minhash.dedup_documents(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents once for each time that the mix takes them, shard by shard in shuffled order.

    Null texts have no words and null sources are a source; repeated rows are taken together; an empty table gives an
    empty one.
    """
    bounded_batches(spark)
    return mixing.mix(docs).select(*docs.columns)


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Piece ids of each text, with digests of the ids and of the text that they decode to; a null text counts as empty."""
    bounded_batches(spark)
    return piece_bpe.encode_documents(docs, with_ids=True)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_repeated_lines),
    ("near_dedup", drop_near_duplicates),
    ("mixing", mix_sources),
    ("encoding", encode_pieces),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``."""
    folder = f"{checkpoint_folder(spark)}/pipeline-{uuid.uuid4()}"
    docs = documents(spark, sf_dir)
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return docs
