"""Exact dedup against a persistent digest index.

The index is a table of (digest, doc_id), bucketed and sorted by digest, that
outlives a run.  New data is reduced to one id per digest, joined to the index
by a sort-merge anti-join that reads its buckets in place (only the 40-byte
keys of the new data are shuffled, never texts), and appended.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fresh, shared_dir, stored

#: Rejected keys up to this many are broadcast when rows are selected (56 bytes each); beyond, both sides are shuffled by digest.
BROADCAST_ROWS = 1_000_000


class DigestIndex:
    """The index at *path*, made if it isn't there; *buckets* must be the same each time."""

    def __init__(self, spark: SparkSession, path: str, buckets: int = 64) -> None:
        self.spark, self.path, self.buckets = spark, path, buckets
        self.name = f"digest_index_{uuid.uuid4().hex}"
        spark.sql(f"create table {self.name} (digest binary, doc_id bigint) using parquet clustered by (digest) sorted by (digest) into {buckets} buckets location '{path}'")

    def table(self) -> DataFrame:
        return self.spark.table(self.name)

    def ingest(self, docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> tuple[DataFrame, DataFrame]:
        """Append what is new of *docs*; returns (admitted, rejected) keys.

        admitted: (digest, doc_id) - of each text that the index lacks, the
        smallest id (null if it has no other).  rejected: (digest, doc_id, all)
        of the other keys of *docs*, and with ``all`` false the admitted keys
        that several rows repeat.  An empty text is a text like any other; a
        null text has no digest and takes no part.
        """
        keys = docs.where(F.col(text).isNotNull()).groupBy(F.unhex(F.sha2(F.col(text), 256)).alias("digest"), F.col(doc_id).cast("long").alias("doc_id")).agg(F.count(F.lit(1)).alias("n"))
        keys = stored(keys.repartition(self.buckets, "digest"), "digests")
        first = keys.groupBy("digest").agg(F.min("doc_id").alias("doc_id"))
        admitted = stored(first.join(self.table().select("digest").hint("merge"), "digest", "left_anti"), "admitted")
        admitted.repartition(self.buckets, "digest").write.mode("append").bucketBy(self.buckets, "digest").sortBy("digest").saveAsTable(self.name)
        won = admitted.select(F.col("digest").alias("g"), F.col("doc_id").alias("i"), F.lit(True).alias("won"))
        both = keys.join(won, (F.col("digest") == F.col("g")) & F.col("doc_id").eqNullSafe(F.col("i")), "left")
        rejected = stored(both.where("won is null or n > 1").select("digest", "doc_id", F.col("won").isNull().alias("all")), "rejected")
        return admitted, rejected

    def compact(self) -> None:
        """Rewrite the index with one sorted file a bucket, as appends leave several."""
        path = f"{self.path}-{uuid.uuid4().hex}"
        new = DigestIndex(self.spark, path, self.buckets)
        self.table().repartition(self.buckets, "digest").write.mode("append").bucketBy(self.buckets, "digest").sortBy("digest").saveAsTable(new.name)
        self.name, self.path = new.name, path


def select_rows(docs: DataFrame, rejected: DataFrame, doc_id: str = "doc_id", text: str = "text", broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """The rows of *docs* that :meth:`DigestIndex.ingest` admitted, with all columns.

    Of rows that repeat both id and text one stays; rows without text all stay.
    """
    key = fresh(docs, "digest_key")
    rows = docs.withColumn(key, F.unhex(F.sha2(F.col(text), 256)))
    out, again = rejected.where("all"), rejected.where("not all")
    few = lambda d: F.broadcast(d) if d.limit(broadcast_rows + 1).count() <= broadcast_rows else d

    def match(d: DataFrame):
        return (rows[key] == d["digest"]) & rows[doc_id].cast("long").eqNullSafe(d["doc_id"])

    out = few(out)
    kept = rows.join(out, match(out), "left_anti")
    if again.limit(1).count():
        again = few(again)
        repeated = kept.join(again, match(again), "left_semi").dropDuplicates([key])
        kept = kept.join(again, match(again), "left_anti").unionByName(repeated)
    return kept.drop(key)


def keep_first(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", index: DigestIndex | None = None) -> DataFrame:
    """*docs* with one row, that of the smallest id, for each text that *index* (a new one by default) doesn't know yet."""
    index = index or DigestIndex(docs.sparkSession, shared_dir(docs.sparkSession, "digest-index"))
    return select_rows(docs, index.ingest(docs, doc_id, text)[1], doc_id, text)
