"""From raw documents to packed sequences: language ID, exact dedup, n-gram Jaccard join, benchmark decontamination, packing.

Each stage works on all rows that its predecessor kept; all but the last return the columns of documents, and other
columns are left out. Defined results: a null or empty text has no letter, so the first stage rejects it; a later stage
treats it as its operator does (empty). A row with a null id is judged by its text like any other; of repeated rows, and
of texts that are equal or near, one row stays, with the smallest id. An empty table gives an empty result; without any
labelled row the first stage rejects everything, as no language is known.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import language_id as lid
from tessera.llm.common import SPACE, materialize, release, table, text_or_empty
from tessera.llm.decontaminate import decontaminate
from tessera.llm.exact_dedup import exact_dedup
from tessera.llm.near_dedup import near_duplicates
from tessera.llm.packing import pack, tokenized_pieces

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: Documents whose language is less certain are rejected, as are those without a letter.
LEAST_SCORE = 0.4


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    out = lid.language_id(docs.select(*COLUMNS), public_tokenizers.path("piece_bpe_32k.model"), lid.trains())
    return out.where((F.col("lang_pred") != "und") & (F.col("score") >= LEAST_SCORE)).select(*COLUMNS)


def _one_each(docs: DataFrame, mark: Column, kept: DataFrame) -> DataFrame:
    """The rows of docs whose id and mark are in kept (id, mark), one for each; joined and thinned out in one exchange."""
    name = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    mine = docs.select(*COLUMNS).withColumns({"_id": name("doc_id"), "_mark": mark})
    return mine.join(kept.select(name("id").alias("_id"), F.col("mark").alias("_mark")), ["_id", "_mark"], "left_semi").dropDuplicates(["_id", "_mark"]).select(*COLUMNS)


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    kept = exact_dedup(docs).where("kept").select(F.col("doc_id").alias("id"), F.col("text_sha256").alias("mark"))
    return _one_each(docs, F.sha2(F.regexp_replace(text_or_empty(), SPACE, " "), 256), kept)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    kept = near_duplicates(docs).where("keep").select(F.col("doc_id").alias("id"), F.col("text_hash").alias("mark"))
    return _one_each(docs, F.xxhash64(text_or_empty()), kept)


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate(docs.select(*COLUMNS), table(spark, sf_dir, "benchmark"))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pack(tokenized_pieces(docs, public_tokenizers.path("word_bpe_49k.json")))


STAGES = [
    ("language ID", identify_language),
    ("exact dedup", drop_exact_copies),
    ("n-gram Jaccard join", drop_near_copies),
    ("benchmark decontamination", drop_benchmark),
    ("packing", pack_sequences),
]
#: SQL expresses neither the language model nor the tokenizer; tests/llm hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows. A stage's table goes once the next one is written."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        made = materialize(stage(spark, docs, sf_dir), name.replace(" ", "-"))
        release(docs)
        docs = made
    return docs
