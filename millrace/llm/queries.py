"""The registered queries of this subpackage and the SQL of those that SQL can express."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm import bpe, credentials, fingerprints, jaccard, langid, licenses, packing, planes, quality, topk
from millrace.llm.common import shared_dir, table


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of 1024 tokens."""
    pieces = packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), capacity=1024, end_id=0)
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "sequence_tokens", "sequence_cost")


def op2_plane_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents' ids, written to plane files and read back."""
    manifest = planes.write(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), shared_dir(spark), end_id=2)
    return planes.read(spark, manifest).select("doc_id", "start", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.crc32("ids").alias("ids_crc32"))


def op3_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 best other vectors of every 20th vector."""
    return topk.search(table(spark, sf_dir, "embeddings"), k=20, scale=64, query_divisor=20)


def op4_credentials(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and digests of the secrets in all documents."""
    found = credentials.scan(table(spark, sf_dir, "documents"))
    base = F.filter("spans", lambda s: s["base"])
    count = lambda kind: F.size(F.filter(base, lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    joined = lambda spans: F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))))
    linked = (F.size("spans") - F.size(base)).cast("long").alias("n_linked")
    return found.select("doc_id", count("assign"), count("access"), count("hex"), linked, F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))


def op5_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """License labels of all documents."""
    return licenses.scan(table(spark, sf_dir, "documents")).drop("detections")


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of all documents, by profiles of those that aren't held out."""
    docs = table(spark, sf_dir, "documents")
    found = langid.predict(docs.select("doc_id", "text"), langid.learn(docs))
    return found.select("doc_id", langid.held_out(F.col("doc_id")).alias("held_out"), "lang_pred", F.col("lang_score").alias("score"))


def op7_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of all documents' ids and of the bytes decoded from them."""
    ranks = bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    return bpe.encode_decode(table(spark, sf_dir, "documents"), ranks, public_tokenizers.PATTERN, then=bpe.digests, schema=bpe.DIGESTS)


def op8_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of all documents, their edited texts and how like they are."""
    return fingerprints.compare_with_next(table(spark, sf_dir, "documents"))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Expected grade and probability of the best grade of all documents, by the labels that aren't held out."""
    docs = table(spark, sf_dir, "documents")
    model = quality.learn(docs, table(spark, sf_dir, "labels"))
    found = quality.grade(docs.select("doc_id", "text"), model, tail_from=quality.GOOD)
    return found.select("doc_id", langid.held_out(F.col("doc_id")).alias("held_out"), "expected_grade", "p_tail", "accepted")


def op10_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of all documents under Jaccard similarity of at least 0.75 of five-word shingles."""
    return jaccard.components(table(spark, sf_dir, "documents"), num=75, den=100, shingle=5)


QUERIES = {f.__name__: f for f in (op1_packing, op2_plane_files, op3_topk, op4_credentials, op5_licenses, op6_language_id, op7_byte_bpe, op8_fingerprints, op9_quality, op10_jaccard)}

ORACLES = {"op3_topk": topk.ORACLE, "op10_jaccard": jaccard.ORACLE}
