"""Training corpus from ``documents``: language, boilerplate lines, near-duplicates, personal data, packed sequences.

Every stage takes (spark, docs, folder of the tables) and returns a DataFrame, which is written as Parquet and
read again as the next one's ``docs``. All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wayline.llm import langmask, line_frequency, packing, personal_data, setsketch
from wayline.llm.frames import col, number_rows, unused
from wayline.session import settle

#: Texts below this share of recognised n-grams are in no language known here.
LEAST_SCORE = 0.3


def _counted(docs: DataFrame) -> DataFrame:
    """``n_chars`` of the text as it now is."""
    return docs.withColumn("n_chars", F.length("text").cast("long"))


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a learned language; those without letters or text, or like no language, go."""
    masks = langmask.fit(docs.where(~langmask.held_out()))
    return langmask.keep_known(docs, masks, least=LEAST_SCORE)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, without the lines that its source repeats on many of its documents."""
    return _counted(line_frequency.drop_lines(docs, host="source")).select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, the one with the smallest id (rows without an id stand last).

    Rows are told apart by a number of their own, so different texts that share an id are different documents."""
    (own,) = unused(docs, "_row")
    # the order is sampled on the driver, so it is kept to two numbers a row
    numbered = number_rows(docs, [col("doc_id").asc_nulls_last(), F.xxhash64(col("text"))], own, "numbered")
    kept = setsketch.near_duplicates(numbered, key=own).where("kept").select(F.col("doc_id").alias(own))
    return numbered.join(kept, own, "left_semi").select(*map(col, docs.columns))


def personal_spans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, with its personal data replaced by the kind in brackets."""
    return _counted(personal_data.redact(docs, personal_data.fit(docs))).select(*docs.columns)


def packed_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces of every document with their sequence and place."""
    return packing.pack_documents(docs)


STAGES = [
    ("language_id", language_id),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("personal_data", personal_spans),
    ("packing", packed_sequences),
]

#: SQL can state neither the language masks nor the token ids; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = settle(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
