"""A training corpus in five stages: languages, exact copies, near copies, source mix, tokens.

Each stage is a function (spark, docs, sf_dir) of the documents that the one before it kept; its
result is written as Parquet and read again. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridkin.llm import langid
from gridkin.llm._common import shared_dir, written
from gridkin.llm.bpe import encode
from gridkin.llm.entry import language_model, vocabulary
from gridkin.llm.exact_dedup import kept_rows
from gridkin.llm.minhash import distinct_rows
from gridkin.llm.mixing import mixed_rows


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language: those without a letter go, as do those with no text (null or empty).

    Long texts are read whole; repeated rows stay or go together; columns of any name are kept; an
    empty table, also one from which nothing can be learned, gives no rows.
    """
    return langid.in_language(docs, language_model(spark, sf_dir))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents with equal texts, A-Z taken as a-z, the one with the largest id.

    A null text counts as empty, a null id is the smallest; of rows that repeat id and text one
    stays; long texts are compared whole; columns of any name are kept; an empty table stays empty.
    """
    return kept_rows(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by a similarity of 0.8 in shingles of five words, the one with the smallest id.

    Texts without a word (null, empty, white space) stay, as do rows with a null id; rows that share
    an id stay or go together; a text of under five words is one shingle, a long one is read whole;
    columns of any name are kept; an empty table stays empty.
    """
    return distinct_rows(docs, width=5, percent=80)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """As many copies of each document, each whole, as the mix of the sources takes.

    A null source is a source; texts without words are taken no times, and so go; rows with one id
    and size draw alike; columns of any name are kept; an empty table stays empty.
    """
    return mixed_rows(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of each copy.

    A null text counts as empty and has no ids; texts of any length are encoded whole; repeated rows
    have a row each, null ids too; other columns are left alone; an empty table gives no rows.
    """
    return encode(docs.select("doc_id", "text"), vocabulary())


STAGES = [("language", language), ("exact", exact), ("near", near), ("mixture", mixture), ("tokens", tokens)]

#: Trained models and rounded tilts are beyond SQL; the tests hold run() against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over documents, each written to the shared folder."""
    folder = shared_dir(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), folder, name)
    return docs
