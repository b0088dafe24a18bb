"""Queries over the cache registry and over column lineage: the answers must not depend on the tier."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators.cache import COMPACT, DISK, RAW, SQUEEZED, EntryId, Hint, Registry, replay
from ..plans.lineage import annotations
from ..plans.predicates import ordered
from ..session import EngineBuilder

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(oracle: str | None = None, name: str | None = None):
    def add(f):
        QUERIES[name or f.__name__] = f
        if oracle is not None:
            ORACLES[name or f.__name__] = oracle
        return f

    return add


def _tier(tier: str):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        """Two reads of one column through the registry, the second one warm."""
        registry = Registry(spark, memory=1 << 40, hydrate=False)
        id = EntryId("pages", "url")
        registry.insert(id, spark.read.parquet(f"{sf_dir}/pages.parquet"), hint=Hint("substring", ("ther",)))
        registry._hold(registry.entries[id], tier)
        out = None
        for label in ("cold", "warm"):
            url = registry.get(id, F.col("url").like("https://%"))
            part = url.groupBy(F.regexp_extract("url", "example[.]([a-z]+)", 1).alias("domain")).agg(F.count(F.lit(1)).alias("n"), F.min("url").alias("first_url")).withColumn("run", F.lit(label))
            out = part if out is None else out.unionByName(part)
        return out

    return run


_DOMAINS = "select regexp_extract(url, 'example[.]([a-z]+)', 1) as domain, count(*) as n, min(url) as first_url, r as run from pages, (values ('cold'), ('warm')) v(r) where url like 'https://%' group by 1, 4"
for _name, _level in (("memory_raw", RAW), ("memory_compact", COMPACT), ("squeezed", SQUEEZED), ("disk", DISK)):
    query(_DOMAINS, f"cache_invariance_{_name}")(_tier(_level))


@query("select year(o_orderdate)::bigint as y, count(*) as n from orders group by 1")
def cache_derived_date(spark, sf_dir):
    """Answered from the squeezed projection alone: the year is all that it holds."""
    registry = Registry(spark, memory=1 << 40)
    id = EntryId("orders", "o_orderdate")
    registry.insert(id, spark.read.parquet(f"{sf_dir}/orders.parquet"), hint=Hint("date", ("YEAR",)))
    registry._hold(registry.entries[id], SQUEEZED)
    return registry.projection(id).groupBy(F.col("o_orderdate_year").cast("bigint").alias("y")).agg(F.count(F.lit(1)).alias("n"))


@query("select coalesce(nullif(event_type, 'view') = 'click', false) as mask, count(*) as n from events group by 1")
def cache_eval_predicate(spark, sf_dir):
    registry = Registry(spark)
    id = EntryId("events", "event_type")
    registry.insert(id, spark.read.parquet(f"{sf_dir}/events.parquet"), size=1000)
    return registry.eval_predicate(id, F.nullif("event_type", F.lit("view")) == "click").groupBy("mask").agg(F.count(F.lit(1)).alias("n"))


def _cache_sql(name: str, sql: str, oracle: str):
    """A query through the engine: cold, filling the cache; warm; and when the cache has squeezed what the query allows."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        engine = EngineBuilder().with_hydration(False).build(spark)
        for t in ("orders", "pages"):
            engine.register_parquet(t, f"{sf_dir}/{t}.parquet")
        engine.register("feed", spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "event_type", F.parse_json("props").alias("data")))
        out = engine.sql(sql).withColumn("run", F.lit("cold")).unionByName(engine.sql(sql).withColumn("run", F.lit("warm")))
        engine.registry.squeeze()
        return out.unionByName(engine.sql(sql).withColumn("run", F.lit("squeezed")))

    query(f"select q.*, run from ({oracle}) q, (values ('cold'), ('warm'), ('squeezed')) v(run)", name)(run)


_cache_sql("cache_sql_date", "select extract(year from o_orderdate) as y, extract(month from o_orderdate) as m, count(*) as n, max(o_totalprice) as top from orders where o_orderstatus = 'F' group by 1, 2", "select year(o_orderdate) as y, month(o_orderdate) as m, count(*) as n, max(o_totalprice) as top from orders where o_orderstatus = 'F' group by 1, 2")
_cache_sql("cache_sql_substring", "select page_id, url from pages where url like '%ther%' and url not like '%org%'", "select page_id, url from pages where url like '%ther%' and url not like '%org%'")
_cache_sql("cache_sql_variant", "select event_type, variant_get(data, '$.k', 'bigint') as k, count(*) as n from feed group by 1, 2", "select event_type, (props->>'k')::bigint as k, count(*) as n from events group by 1, 2")


def _under_pressure(spark, sf_dir) -> Registry:
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    registry = Registry(spark, memory=1000, policy="transcode_squeeze_evict", hydrate=False)
    for column, hint in (("event_id", None), ("user_id", Hint("predicate")), ("value", None), ("event_type", None)):
        registry.insert(EntryId("events", column), events, size=400, hint=hint)
    registry.get(EntryId("events", "event_id"))
    registry.get(EntryId("events", "ts"))
    return registry


_TRACE = """(values (0, 'inserted', 'events/event_id/batch_0', 'memory_raw', 400, 400), (1, 'inserted', 'events/user_id/batch_0', 'memory_raw', 400, 800),
  (2, 'squeezed', 'events/event_id/batch_0', 'memory_raw->memory_compact', 200, 600), (3, 'inserted', 'events/value/batch_0', 'memory_raw', 400, 1000),
  (4, 'squeezed', 'events/user_id/batch_0', 'memory_raw->memory_compact', 200, 800), (5, 'squeezed', 'events/value/batch_0', 'memory_raw->memory_compact', 200, 600),
  (6, 'inserted', 'events/event_type/batch_0', 'memory_raw', 400, 1000), (7, 'read', 'events/event_id/batch_0', 'memory_compact', 200, 1000)) t(step, kind, entry_id, detail, entry_size, memory)"""


@query(f"select step::bigint as step, kind, entry_id, detail, entry_size::bigint as entry_size, memory::bigint as memory from {_TRACE}")
def cache_trace_fifo(spark, sf_dir):
    trace = _under_pressure(spark, sf_dir).trace()
    step = F.row_number().over(W.orderBy("seq")).cast("bigint") - 1
    return trace.select(step.alias("step"), "kind", "entry_id", "detail", "entry_size", F.col("cache_memory_bytes").alias("memory"))


@query(f"select kind, count(*) as n, max(memory)::bigint as peak from {_TRACE} group by 1")
def cache_trace_replay(spark, sf_dir):
    return replay(_under_pressure(spark, sf_dir).trace()).groupBy("kind").agg(F.count(F.lit(1)).alias("n"), F.max("cache_memory_bytes").alias("peak"))


@query("select name, value::bigint as value from (values ('memory_bytes', 1000), ('memory_raw_entries', 1), ('memory_compact_entries', 3), ('disk_entries', 0), ('miss_events', 1), ('squeezed_events', 3)) t(name, value)")
def cache_stats(spark, sf_dir):
    return _under_pressure(spark, sf_dir).stats().where("name in ('memory_bytes', 'memory_raw_entries', 'memory_compact_entries', 'disk_entries', 'miss_events', 'squeezed_events')")


@query("select * from (values ('event_id', 'memory_compact', 400::bigint, 200::bigint), ('user_id', 'memory_compact', 400, 200), ('value', 'memory_compact', 400, 200), ('event_type', 'memory_raw', 400, 400)) t(col, tier, size, held_bytes)")
def cache_entry_stats(spark, sf_dir):
    return _under_pressure(spark, sf_dir).entry_stats().select(F.col("column").alias("col"), "tier", "size", "held_bytes")


def _lineage(name: str, sql: str, expected: list[tuple[str, str, str]]):
    rows = ", ".join(f"('{c}', '{k}', '{d}')" for c, k, d in expected)

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        for t in ("orders", "events", "pages", "customer"):
            spark.read.parquet(f"{sf_dir}/{t}.parquet").createOrReplaceTempView(t)
        spark.sql("select event_id, event_type, parse_json(props) as data from events").createOrReplaceTempView("feed")
        found = annotations(spark.sql(sql))
        return spark.createDataFrame([(a.column, a.kind, a.detail) for a in found], "col string, kind string, detail string")

    query(f"select * from (values {rows}) t(col, kind, detail)", name)(run)


_lineage("lineage_date_year", "select extract(year from o_orderdate) as y, count(*) as n from orders group by 1", [("o_orderdate", "date", "YEAR")])
_lineage("lineage_date_union", "select extract(month from o_orderdate) as p from orders union all select extract(year from o_orderdate) from orders where extract(dow from o_orderdate) > 2", [("o_orderdate", "date", "YEAR,MONTH,DOW")])
_lineage("lineage_date_direct", "select extract(year from ts) as y, event_type like '%lic%' as c from events where ts > timestamp_ntz '2024-01-02'", [("event_type", "substring", "lic")])
_lineage("lineage_date_interval", "select extract(day from o_orderdate + interval '1' day) as d, o_orderstatus like '%F%' as f from orders", [("o_orderstatus", "substring", "F")])
_lineage("lineage_alias_subquery", "select y + 1 as next from (select extract(year from d) as y from (select o_orderdate as d from orders) a) b where y > 1996", [("o_orderdate", "date", "YEAR")])
_lineage("lineage_self_join", "select extract(day from a.ts) as d from events a join events b on a.event_id = b.event_id where extract(month from b.ts) = 1", [("ts", "date", "MONTH,DAY")])
_lineage("lineage_variant", "select variant_get(data, '$.k', 'int') as k, data from feed where variant_get(data, '$.j', 'string') = 'x'", [("data", "variant", "$.j:string,$.k:integer")])
_lineage("lineage_variant_conflict", "select variant_get(data, '$.k', 'int') as k, variant_get(data, '$.k', 'string') as s, event_type like '%view%' as v from feed", [("event_type", "substring", "view")])
_lineage("lineage_substring", "select url from pages where url like '%ther%' or url not like '%org%'", [("url", "substring", "org,ther")])


@query("select * from (values ('EqualTo', true, 0::bigint), ('NotEqualTo', true, 0), ('StartsWith', false, 1), ('NotLike', true, 2), ('GreaterThan', true, 3), ('Or', false, 4)) t(kind, evaluable, priority)")
def predicate_order(spark, sf_dir):
    spark.read.parquet(f"{sf_dir}/events.parquet").createOrReplaceTempView("events")
    df = spark.sql("select * from events where value > 3 and (user_id = 1 or value < 9) and event_type not like '%x%' and startswith(event_type, 'v') and user_id = 8 and event_type <> 'click'")
    return spark.createDataFrame([(c.kind, c.evaluable, c.priority) for c in ordered(df, substring_hint=True)], "kind string, evaluable boolean, priority bigint")


