"""From documents to training sequences: language, near-duplicates, secrets, packing.

Each stage takes (spark, docs, sf_dir) and gives a DataFrame, which is written as Parquet into
the shared folder and read again as the next one's docs; all but the last keep the columns
of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from spanloom.llm import dedup, langid, packing, secrets
from spanloom.llm.common import written
from spanloom.llm.queries import tokenizer
from spanloom.plans.session import ship


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter go, and those whose words are told with a mean confidence under two fifths.

    A null or empty text goes; repeated rows stay or go together; an empty table gives an empty one; where no
    two languages are labelled, every document with a letter stays.
    """
    ship(spark)
    return langid.accepted(docs, langid.fit(docs))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked documents the one with the smallest id stays.

    Links are by five-word shingles; the four words of op5_minhash are that query's own. Rows that repeat a doc_id are one
    document and stay or go together; rows without a doc_id, and texts without words, are linked with nothing and stay.
    """
    ship(spark)
    gone = dedup.near_duplicates(docs, width=5).where("NOT kept").select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced by a mark; the documents stay, null and empty texts as they are, repeated rows repeated."""
    ship(spark)
    return secrets.redacted(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document that is left, in as few sequences as the search can reach; a null text takes one token, repeated rows a place each."""
    ship(spark)
    return packing.pack(docs, tokenizer("word_bpe_49k.json"))


STAGES = [("language", language), ("near-duplicates", near_duplicates), ("secrets", without_secrets), ("packing", packed)]

#: SQL cannot express the language model or the tokenizer; the tests hold each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage over the documents table."""
    docs = ship(spark).read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
