"""Queries of this subpackage, one for each numbered operator, with SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import alignment, conversations, fingerprints, flatgraph, langid, linear, lines, minhash, mixing, piece_bpe, sql, urlfilter, warc
from .common import documents, remainder

#: Labelled rows of each class that the classifiers are fitted on.
QUALITY_ROWS, TOXICITY_ROWS = 1500, 1500


def op1_flat_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flatgraph.near_vectors(documents(spark, sf_dir, "embeddings"))


def op2_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    model = langid.train(docs, remainder("doc_id", 4) != 2)
    found = langid.identify(docs, model)
    return found.select("doc_id", (remainder("doc_id", 4) == 2).alias("held_out"), "lang_pred", "score")


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = lines.line_decisions(documents(spark, sf_dir))
    return found.select("doc_id", "line_no", "class_id", "n_copies", "kept")


def op4_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return piece_bpe.encode_documents(documents(spark, sf_dir))


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    sample = linear.labelled_sample(docs, documents(spark, sf_dir, "labels"), "quality", remainder("doc_id", 3) != 1, QUALITY_ROWS)
    return _classified(linear.score(docs, linear.fitted(sample, linear.fit_quality)), 3, 1)


def op6_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.fingerprints(documents(spark, sf_dir))


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = mixing.placements(documents(spark, sf_dir).select("doc_id", "source", "text"))
    return placed.select("doc_id", F.col("mix_size").alias("size"), F.col("mix_source_size").alias("source_size"), F.col("mix_target").alias("target"), (F.col("mix_size") * F.size("mix_places")).alias("taken"), F.transform("mix_places", lambda x: x["shard"]).alias("shards"))


def op8_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(documents(spark, sf_dir), size=4)


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = warc.derivatives(warc.responses(documents(spark, sf_dir, "pages")))
    page = F.col("id").cast("bigint").alias("page_id")
    return made.select(page, "kind", "record_id", "refers_to", "target_uri", "source_block_digest", "source_payload_digest", "block_digest", "content_length", "n_links", F.sha2("record", 256).alias("record_sha256"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    sample = linear.labelled_sample(docs, documents(spark, sf_dir, "labels"), "toxic", remainder("doc_id", 5) != 0, TOXICITY_ROWS)
    return _classified(linear.score(docs, linear.fitted(sample, linear.fit_toxicity)), 5, 0)


def op11_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversations.repair(conversations.damaged(documents(spark, sf_dir, "conversations")), times=F.col("times"))


def op12_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urlfilter.judged(documents(spark, sf_dir, "pages")).select("page_id", "host", "path", "rule", "verdict")


def op13_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.align(documents(spark, sf_dir))


def _classified(scored: DataFrame, modulus: int, held: int) -> DataFrame:
    return scored.select("doc_id", (remainder("doc_id", modulus) == held).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = (op1_flat_graph, op2_language, op3_line_dedup, op4_sentencepiece, op5_quality, op6_fingerprints, op7_mixing, op8_minhash, op9_warc, op10_toxicity, op11_conversations, op12_url_filter, op13_alignment)
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    return {"op11_conversations": sql.CONVERSATIONS, "op12_url_filter": sql.URLS}
