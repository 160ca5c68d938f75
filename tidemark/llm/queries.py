"""One query for each operator over its whole table, with production parameters, and DuckDB SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import ann, bpe, langid, license_scan, maxscore, merkle, mixing, quality, secret_scan, simhash, spelling, suffix_lm, token_counts
from tidemark.llm.common import fold, table

RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def op1_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """query_id, rank, vec_id, score: the 20 nearest found for each row whose vec_id is divisible by 20."""
    return ann.search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, k=20)


def op2_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, path, licence, cosine, origin, inherited_from for each document.

    ``documents`` has no paths; a document lies at source/lang/b/doc_id.txt, b being its doc_id divided by 50 and rounded
    down, so that directories are small and nested. A null part of the path is called none.
    """
    docs = table(spark, sf_dir, "documents")
    parts = [F.col("source"), F.col("lang"), F.floor(F.col("doc_id") / 50).cast("string"), F.concat(F.col("doc_id").cast("string"), F.lit(".txt"))]
    path = F.concat_ws("/", *(F.coalesce(p, F.lit("none")) for p in parts))
    return license_scan.scan(docs.select("doc_id", path.alias("path"), "text"), "doc_id", "path", "text")


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, held_out, lang_pred, score for each document; learns from the rows whose fold is not 2 of 4."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held = fold("doc_id", 4, 2)
    profiles = langid.fit(docs, ~held)
    found = langid.identify(docs.select("doc_id", held.alias("held_out"), "text"), profiles, drop=("text",))
    return found.select("doc_id", "held_out", "lang_pred", "score")


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, fingerprint, component_id for each document; links within 4 bits."""
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("simhash")), 16, "0").alias("fingerprint"), "component_id")


def op5_suffix_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base and suffix-tree scores of each document; learns from the rows whose fold is not 2 of 7."""
    return suffix_lm.score(table(spark, sf_dir, "documents"), fold("doc_id", 7, 2))


def op6_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 for each document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = bpe.round_trip(docs, RANKS, public_tokenizers.PATTERN, drop=("text",))
    return found.select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")


def op7_maxscore(spark: SparkSession, sf_dir: str) -> DataFrame:
    """query_id, rank, vec_id, score: the 10 highest scores for each row whose vec_id is divisible by 100."""
    return maxscore.search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, k=10)


def op8_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secret spans of each document; a source is an owner and a document a repository."""
    return secret_scan.report(table(spark, sf_dir, "documents"))


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, size, source_size, target, taken, copies for each document."""
    return mixing.mix(table(spark, sf_dir, "documents"))


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, n_crossing and section_tokens (of each line) for each document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return token_counts.by_lines(docs, RANKS, public_tokenizers.PATTERN, drop=("text",))


def op11_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """word, form, root, n, n_near, form_n for each word of seven letters or more that occurs twice or more in all documents."""
    return spelling.variants(spelling.count_words(table(spark, sf_dir, "documents")))


def op12_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, held_out, score, predicted, n_rules for each document; learns from the rows whose fold is not 1 of 3."""
    return quality.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), fold("doc_id", 3, 1))


def op13_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root, verified for each document; a third of the rows is tampered with."""
    docs = table(spark, sf_dir, "documents")
    text = F.when(merkle.tampered(), merkle.lowered(F.col("text"))).otherwise(F.col("text"))
    return merkle.verify(docs, {"text": text}, ["doc_id", "source", "lang", "n_chars", "text"])


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_nearest, op2_licenses, op3_language_id, op4_simhash, op5_suffix_tree, op6_byte_bpe, op7_maxscore, op8_secrets, op9_mixing, op10_token_counts, op11_spelling, op12_quality, op13_merkle)}


def oracle_sql() -> dict[str, str]:
    return {"op7_maxscore": maxscore.ORACLE, "op8_secrets": secret_scan.ORACLE, "op9_mixing": mixing.ORACLE}
