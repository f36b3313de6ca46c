"""The corpus pipeline: language, quality, near copies, secrets, packing.

Each stage gets the documents that the one before it left, and all but the last
return the columns of documents.  Stages are written as Parquet and read again;
``millrace.llm.common.remove_shared`` deletes them once the result is consumed.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm import credentials, jaccard, langid, packing, quality
from millrace.llm.common import shared_dir, table, written

#: A document nearer to no language than this is in none of them.  Measured on the 0.1 tables: all 10,000 documents score at least
#: 0.38, random Latin letters 0.17 to 0.20, other alphabets 0.
LEAST_LANGUAGE_SCORE = 0.3


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in one of the languages that the corpus names.

    Rows with null or empty texts, or without a letter, go; repeated rows and null ids are kept; an
    empty table gives an empty one; whole texts of any length count.
    """
    found = langid.predict(docs, langid.learn(docs))
    return found.where((F.col("lang_pred") != langid.UNDETERMINED) & (F.col("lang_score") >= LEAST_LANGUAGE_SCORE)).select(docs.columns)


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are more likely than not of the best grade: neither of low quality nor toxic.

    Rows with null texts or without tokens go; repeated rows and null ids are kept; an empty table gives
    an empty one; whole texts of any length count.  Without labels all documents with tokens stay.
    """
    return quality.grade(docs, quality.learn(docs, table(spark, sf_dir, "labels")), tail_from=quality.GOOD).where("accepted").select(docs.columns)


def one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, its doc_id the smallest; documents without text or words stay.

    Rows are told apart by their doc_ids where those are unique.  Where rows share one or have none, each row counts
    by itself: it goes only if it is a near copy of another one, and of rows with one id the first stays, those
    without an id coming last.
    """
    folder = shared_dir(spark)
    if docs.where("doc_id is null").isEmpty() and docs.groupBy("doc_id").count().where("count > 1").isEmpty():
        copies = written(spark, jaccard.components(docs).where("doc_id <> component_id").select("doc_id"), folder, "copies")
        return docs.join(copies, "doc_id", "left_anti").select(docs.columns)
    rows = written(spark, docs.withColumn("__row", F.monotonically_increasing_id()), folder, "rows")
    groups = jaccard.components(rows, id_col="__row").select(F.col("doc_id").alias("__row"), "component_id")
    groups = written(spark, groups.join(rows.select("__row", "doc_id"), "__row"), folder, "groups")
    first = groups.groupBy("component_id").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "__row"))["__row"].alias("__row"))
    return rows.join(first.select("__row"), "__row", "left_semi").select(docs.columns)


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, secrets masked; null and empty texts, repeated rows and null ids stay as they are, an empty table is empty."""
    return credentials.redact(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in sequences of at most 1024 tokens.

    A null or empty text is a piece of one token; repeated rows and null ids are packed like any other;
    texts of any length are cut; an empty table gives no piece.
    """
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"), capacity=1024, end_id=0, table_entries=200_000)


STAGES = [
    ("language ID", language),
    ("quality classifier", good_quality),
    ("n-gram Jaccard join", one_of_near_copies),
    ("secret scans", without_secrets),
    ("packing", packed),
]

#: SQL expresses neither the language profiles, the classifier nor the tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, folder = table(spark, sf_dir, "documents"), shared_dir(spark)
    for k, (_, stage) in enumerate(STAGES[:-1]):
        docs = written(spark, stage(spark, docs, sf_dir), folder, f"stage-{k}")
    return STAGES[-1][1](spark, docs, sf_dir)
