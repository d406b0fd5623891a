"""From raw documents to packed sequences: five stages, each one operator over all that the stage before kept."""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from swathframe.llm.near_dup import keep_one
from swathframe.llm.packing import pack_documents
from swathframe.llm.quality_classifier import fit_quality, keep_good
from swathframe.llm.quality_rules import keep_passing
from swathframe.llm.substring_dedup import without_repeats
from swathframe.session import shared_folder

#: Jaccard similarity of word shingles, in percent, at which the stage links documents; query op4 has its own.
NEAR_PERCENT = 80


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the trained classifier does not reject.

    Null and empty texts and rows without id are scored like all others and
    stay or go by their score; repeated rows stay or go together; an empty
    table stays empty; columns of any name are kept.
    """
    return keep_good(docs, fit_quality(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the plain rules and lie in the perplexity band of their language.

    Null, empty and other texts of fewer than 50 words go, as the plain rules
    say; null and unknown languages share one model; repeated rows stay or go
    together; an empty table stays empty; columns of any name are kept.
    """
    return keep_passing(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the least id of each group of documents linked at a similarity of ``NEAR_PERCENT`` or more.

    Texts without words and rows without id are linked with nothing and stay;
    rows that share an id stay or go together; an empty table stays empty;
    columns of any name are kept.
    """
    return keep_one(docs, NEAR_PERCENT)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the words of repeated windows; ``n_chars`` follows the text.

    Null and empty texts stay as they are, texts that only repeat become empty;
    repeated rows repeat each other; an empty table stays empty; columns of
    any name are kept.
    """
    return without_repeats(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in their sequences.

    A null or empty text is its end id alone; rows without id and repeated rows
    are packed each for itself; an empty table gives no pieces; other columns
    are left out.
    """
    return pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN)


STAGES = [("quality_classifier", quality_classifier), ("quality_rules", quality_rules),
          ("near_duplicates", near_duplicates), ("substring_dedup", substring_dedup), ("packing", packing)]

#: No SQL for trained models, sketches and a linear program; the tests hold each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The packed pieces of ``documents``; every stage is written as Parquet in the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return docs


QUERIES = {"pipeline": run}
ORACLES = {"pipeline": ORACLE_SQL} if ORACLE_SQL else {}
