"""The five semi-structured queries, on events rendered as one variant a row."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.dates import micros, part, to_timestamp_micros
from ..functions.variant import variant_get


def feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(data): a variant with did, kind, time_us and commit.operation and .collection for each event."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    operation = F.when(F.col("event_type") == "error", "delete").otherwise("create")
    commit = F.struct(operation.alias("operation"), F.concat(F.lit("app.feed."), "event_type").alias("collection"))
    kind = F.when(F.col("event_type") == "signup", "identity").otherwise("commit")
    row = F.struct(F.concat(F.lit("did:"), F.col("user_id").cast("string")).alias("did"), kind.alias("kind"), micros(F.col("ts")).alias("time_us"), commit.alias("commit"))
    return e.select(F.parse_json(F.to_json(row)).alias("data"))


def _get(path: str, kind: str = "Utf8"):
    return variant_get(F.col("data"), path, kind)


def _created(d: DataFrame) -> DataFrame:
    return d.where((_get("kind") == "commit") & (_get("commit.operation") == "create"))


def json_q1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return feed(spark, sf_dir).groupBy(_get("commit.collection").alias("event")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"))


def json_q2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _created(feed(spark, sf_dir)).groupBy(_get("commit.collection").alias("event")).agg(F.count(F.lit(1)).alias("n"), F.count_distinct(_get("did")).alias("users")).orderBy(F.desc("n"))


def json_q3(spark: SparkSession, sf_dir: str) -> DataFrame:
    event = _get("commit.collection")
    d = _created(feed(spark, sf_dir)).where(event.isin("app.feed.view", "app.feed.click", "app.feed.purchase"))
    hour = part("HOUR", to_timestamp_micros(_get("time_us", "Int64"))).cast("bigint")
    return d.groupBy(event.alias("event"), hour.alias("hour_of_day")).agg(F.count(F.lit(1)).alias("n")).orderBy("hour_of_day", "event")


def json_q4(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _created(feed(spark, sf_dir)).where(_get("commit.collection") == "app.feed.view")
    first = F.min(to_timestamp_micros(_get("time_us", "Int64"))).alias("first_seen")
    return d.groupBy(_get("did").alias("user_id")).agg(first).orderBy(F.asc("first_seen"), "user_id").limit(3)


def json_q5(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _created(feed(spark, sf_dir)).where(_get("commit.collection") == "app.feed.view")
    time = _get("time_us", "Int64")
    span = F.floor((F.max(time) - F.min(time)) / 1000).cast("bigint").alias("span_ms")
    return d.groupBy(_get("did").alias("user_id")).agg(span).orderBy(F.desc("span_ms"), "user_id").limit(3)


QUERIES = {f.__name__: f for f in (json_q1, json_q2, json_q3, json_q4, json_q5)}
_FEED = """with feed as (select 'did:' || user_id::varchar as did, case when event_type = 'signup' then 'identity' else 'commit' end as kind, ts,
  case when event_type = 'error' then 'delete' else 'create' end as operation, 'app.feed.' || event_type as collection from events)"""
_MADE = "kind = 'commit' and operation = 'create'"
ORACLES = {
    "json_q1": f"{_FEED} select collection as event, count(*) as n from feed group by 1",
    "json_q2": f"{_FEED} select collection as event, count(*) as n, count(distinct did) as users from feed where {_MADE} group by 1",
    "json_q3": f"{_FEED} select collection as event, hour(ts) as hour_of_day, count(*) as n from feed where {_MADE} and collection in ('app.feed.view', 'app.feed.click', 'app.feed.purchase') group by 1, 2",
    "json_q4": f"{_FEED} select did as user_id, min(ts) as first_seen from feed where {_MADE} and collection = 'app.feed.view' group by 1 order by 2, 1 limit 3",
    "json_q5": f"{_FEED} select did as user_id, ((epoch_us(max(ts)) - epoch_us(min(ts))) // 1000)::bigint as span_ms from feed where {_MADE} and collection = 'app.feed.view' group by 1 order by 2 desc, 1 limit 3",
}
