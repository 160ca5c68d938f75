"""A training-data pipeline over ``documents``: each stage applies one operator to all that the stage before has kept.

1. language_id: documents without a language go; ``lang`` becomes the language found. Where no row has a label to learn
   from, documents with a letter stay as they are.
2. near_duplicates: one document of each group of similarity 0.8 or more over five words stays, that of the smallest id.
3. secrets: spans of secrets are masked in the texts, widely copied examples with another mask.
4. mixing: each document occurs as often as its source's share asks for, from not at all to three times.
5. byte_bpe: the texts become token ids.

All but the last stage return the columns of ``documents``, whatever further ones there are; ``n_chars`` follows the text.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import bpe, langid, mixing, secret_scan, simhash
from tidemark.llm.common import private, shared_folder, table
from tidemark.llm.queries import RANKS


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents whose language can be told, and sets ``lang`` to it; learns from the labelled ones."""
    profiles = langid.fit(docs.select("doc_id", "text", "lang"), F.lit(True))
    if not profiles:
        return docs.where(F.col("text").rlike(r"\p{L}"))
    inner, names = private(docs)
    found = langid.identify(inner, profiles, text=names["text"]).where(F.col("lang_pred") != langid.UNDETERMINED)
    return found.select(*("lang_pred" if c == "lang" else n for c, n in names.items())).toDF(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each near-duplicate group."""
    return simhash.keep_one(docs)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Masks secrets."""
    found = secret_scan.redact(docs)
    return found.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else found


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats or leaves out documents so that the sources have their target shares of words."""
    return mixing.resample(docs)


def byte_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, lang, source, n_tokens, ids_sha256, decoded_sha256, ids) for each document."""
    docs = docs.select("doc_id", "lang", "source", "text")
    return bpe.round_trip(docs, RANKS, public_tokenizers.PATTERN, drop=("text",), keep_ids=True)


STAGES = [
    ("language_id", language_id),
    ("near_duplicates", near_duplicates),
    ("secrets", secrets),
    ("mixing", mix),
    ("byte_bpe", byte_bpe),
]

#: SQL has neither the fingerprints' links nor the tokenizer; the stages are tested against brute force.
ORACLE_SQL = None


def remove(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows; what a stage returns is written to the shared folder and read again by the next, and removed when
    that one is written, or when a stage fails.

    The result reads what the stage before the last has written, so that folder stays until its owner clears it.
    """
    docs = table(spark, sf_dir, "documents")
    folder, before = f"{shared_folder(spark)}/corpus-pipeline-{uuid.uuid4().hex}", None
    try:
        for name, stage in STAGES[:-1]:
            stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
            docs = spark.read.parquet(f"{folder}/{name}")
            if before:
                remove(spark, before)
            before = f"{folder}/{name}"
    except BaseException:
        remove(spark, folder)
        raise
    return STAGES[-1][1](spark, docs, sf_dir)
