"""The queries of the operators in this subpackage, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import cotrain, ctw, digest, exact_dedup, htmltext, langid, mixing, ngram_join, pii, piece_fst
from .common import shared_dir

#: Default place of the public SentencePiece model; executors read it, so it is a path on every host.
PIECE_MODEL = "/opt/tokenizers/piece_bpe_32k.model"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = langid.detect(docs, langid.train(docs))
    return found.select("doc_id", "language.lang", "language.share", "language.mixture", "language.n_grams", "language.rejected")


def op2_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return digest.nearest(docs, table(spark, sf_dir, "benchmark")).select("doc_id", "digest", "nearest_item", "difference")


def op2_fingerprints_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest.search(table(spark, sf_dir, "documents"))


def op3_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return piece_fst.tokenise(docs, PIECE_MODEL).select("doc_id", "ids", "n_tokens", "round_trip")


def op4_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.classes(table(spark, sf_dir, "documents"))


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ingests the half of smaller ids, then the rest against the index that this left; returns the index."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    index = exact_dedup.DigestIndex(spark, shared_dir(spark, "digest-index"))
    low, high = docs.agg(F.min("doc_id"), F.max("doc_id")).first()
    middle = ((low or 0) + (high or 0)) // 2
    index.ingest(docs.where((F.col("doc_id") <= middle) | F.col("doc_id").isNull()))
    index.ingest(docs.where(F.col("doc_id") > middle))
    return index.table().select("doc_id", F.lower(F.hex("digest")).alias("digest"))


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find(table(spark, sf_dir, "documents"))


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cotrain.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The budgets of the query's SQL, which end where the first source is used up."""
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "source", "tokens", "tier")


def op8_mixing_filled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The budgets of the pipeline, which no short source limits."""
    return mixing.mix(table(spark, sf_dir, "documents"), fill=mixing.FILL).select("doc_id", "source", "tokens", "tier")


def op9_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    scores = ctw.score(table(spark, sf_dir, "documents"))
    return scores.select("doc_id", "n_bytes", F.round("code_bits", 3).alias("code_bits"), F.round("bits_per_byte", 6).alias("bits_per_byte"))


def op10_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return htmltext.visible_text(table(spark, sf_dir, "pages")).select("page_id", "text")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (op1_language_id, op2_fingerprints, op2_fingerprints_search, op3_sentencepiece, op4_ngram_join, op5_exact_dedup, op6_pii, op7_quality, op8_mixing, op8_mixing_filled, op9_lm_score, op10_html)
}

ORACLES: dict[str, str] = {
    "op2_fingerprints": digest.oracle(),
    "op2_fingerprints_search": digest.search_oracle(),
    "op5_exact_dedup": "select min(doc_id) as doc_id, sha256(text) as digest from documents where text is not null group by text",
    "op8_mixing": mixing.ORACLE,
    "op9_lm_score": ctw.oracle(),
}
