"""The corpus pipeline: language ID, line dedup, n-gram Jaccard join, best-fit packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; its output is written as Parquet and read again as the next one's
docs. All but the last return the columns of documents.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quantpanel.llm import language_id, line_dedup, ngram_join, packing
from quantpanel.llm.common import cut

#: A document whose n-grams hardly any language contains goes; clean short texts score far higher.
LEAST_SCORE = 0.1


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without letters, or in none of the labelled languages, go. The labels are those of docs; they stay as they are.

    Null and empty texts have no letter, so they go. Repeated rows and null ids are judged like others. Without any label no language is
    known, and all documents go. An empty table stays empty; extra columns stay, whatever their names.
    """
    known = language_id.identify(docs, language_id.train(docs))
    return known.where((F.col("lang_pred") != language_id.UNKNOWN) & (F.col("score") >= LEAST_SCORE)).select(docs.columns)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines of 20 characters or more that three documents hold stay in the one of the largest id; n_chars follows the text.

    A null text becomes empty. Every document stays, also one that keeps no line. Rows that repeat an id count as one document. An empty
    table stays empty; extra columns stay.
    """
    done = line_dedup.dedup_lines(docs)
    return done.withColumn("n_chars", F.char_length("text").cast("long")).select(docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by five-word shingles with a similarity of 0.8 or more, the smallest id stays.

    Null, empty and blank texts are linked with nothing and stay, as null ids do. Rows that repeat the id that stays all stay. An empty
    table stays empty; extra columns stay.
    """
    return ngram_join.drop_similar(docs, words=5, percent=80).select(docs.columns)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of at most 4096 tokens and their places."""
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("language_id", identify_language),
    ("line_dedup", drop_repeated_lines),
    ("ngram_jaccard_join", drop_near_copies),
    ("best_fit_packing", pack_sequences),
]

#: Prediction, similarity components and packing are beyond SQL; tests/llm compare with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
