"""The corpus pipeline: documents to training tokens, one operator a stage.

``STAGES`` lists (name, function); a function takes (spark, docs, sf_dir) and
returns the rows that it keeps.  Every stage but the last returns the columns
of documents, and works on all that the one before kept.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tierlens.llm import exact_dedup, langid, mixing, ngram_join, piece_fst
from tierlens.llm.common import stored
from tierlens.llm.queries import PIECE_MODEL
from tierlens.sources.ship import ship


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that are in no language: those without letters, and those mostly explained by the background."""
    return langid.keep_known(docs, langid.train(docs))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document of the smallest id of each text."""
    return exact_dedup.keep_first(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document of the smallest id of each group of near duplicates."""
    return ngram_join.keep_one(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Samples the sources down to the target weights; short sources stay whole and the others fill up for them."""
    return mixing.sample(docs, fill=mixing.FILL)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The token ids of each document."""
    return piece_fst.tokenise(docs, PIECE_MODEL).select("doc_id", "lang", "source", "ids", "n_tokens")


STAGES = [("language", language), ("exact", exact), ("near", near), ("mix", mix), ("tokens", tokens)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage; each stage's are written as Parquet to the shared folder and read again by the next."""
    ship(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)


#: SQL can't express the mixture inference of the first stage; tests hold run() against a brute-force version.
ORACLE_SQL = None
