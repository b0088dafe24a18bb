"""One query for each operator family: scans, filters, joins, aggregates, sorting, dates, strings, variants, encodings, windows and set operations."""

from __future__ import annotations

from datetime import datetime
from decimal import Decimal

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import dates, strings, variant
from ..operators import encodings as enc
from ..operators import squeeze
from ..operators.membership import not_in
from ..plans.lineage import Annotation
from ..plans.sqlquery import SqlQuery, mean, money, n

SQL = {
    # Scans and filters
    "scan_projection": "select event_id, event_type from events",
    "count_star": "select count(*) as n from lineitem",
    "filter_eq_neq": "select event_id, event_type, user_id from events where event_type = 'click' and user_id <> 8",
    "filter_range": "select event_id, value from events where value >= 10.5 and value < 20 and event_id between 100 and 9000",
    "filter_or_multi": "select event_id, event_type, user_id from events where event_type = 'error' or user_id = 43 or value > 300",
    "filter_not": "select event_id from events where not (event_type = 'view' or value < 5)",
    "filter_string_order": "select page_id, url from pages where url >= 'https://m' and url < 'https://t'",
    "filter_timestamp": "select event_id, ts from events where ts >= $ts '2024-01-10' and ts < $ts '2024-01-12'",
    "filter_partition_like": "select o_orderkey from orders where o_orderdate = $ts '1998-10-03'",
    "like_prefix": "select count(*) as n from pages where url like 'https://%'",
    "like_suffix": "select page_id from pages where url like '%top'",
    "like_infix": "select page_id, url from pages where url like '%example.net%'",
    "like_two_holes": "select page_id from pages where url like '%ther%page%'",
    "not_like": "select page_id from pages where url not like '%example.com%'",
    "ilike": "select doc_id from documents where text ilike '%LICENSE%'",
    "in_list": "select event_id from events where event_type in ('error', 'signup')",
    "not_in_list": "select event_id from events where event_type not in ('error', 'signup', 'view')",
    "is_null": "select event_id, nullif(event_type, 'view') as kind from events where nullif(event_type, 'view') is null or user_id = 8",
    "case_expr": "select event_id, case when value < 10 then 'low' when value < 100 then 'middle' else 'high' end as level from events",
    "int_division": f"select event_id, {n('user_id $div 7')} as q, user_id % 7 as r from events",
    "try_cast": f"select doc_id, {n('try_cast(substring(source, 4, 9) as int)')} as source_no, try_cast(source as int) is null as not_a_number from documents",
    # Joins
    "join_inner": "select o_orderkey, c_name from orders join customer on o_custkey = c_custkey",
    "join_comma": "select s_suppkey, n_name, r_name from supplier, nation, region where s_nationkey = n_nationkey and n_regionkey = r_regionkey",
    "join_left_residual": "select c_custkey, count(o_orderkey) as n from customer left join orders on c_custkey = o_custkey and o_totalprice > 400000 group by c_custkey",
    "join_right": "select r_name, count(n_nationkey) as n from nation right join region on n_regionkey = r_regionkey and n_nationkey > 20 group by r_name",
    "join_full": "select a.n_nationkey as x, b.n_nationkey as y from (select * from nation where n_nationkey < 15) a full join (select * from nation where n_nationkey > 10) b on a.n_nationkey = b.n_nationkey",
    "join_semi_exists": "select c_custkey from customer where exists (select 1 from orders where o_custkey = c_custkey and o_totalprice > 450000)",
    "join_semi_in": "select p_partkey, p_name from part where p_partkey in (select l_partkey from lineitem where l_quantity = 50 and l_discount > 0.05)",
    "join_anti_not_exists": "select c_custkey from customer where not exists (select 1 from orders where o_custkey = c_custkey and o_orderstatus = 'F' and o_totalprice > 300000)",
    "join_not_in": "select s_suppkey from supplier where s_suppkey not in (select l_suppkey from lineitem where l_quantity = 50 and l_discount = 0.1 and l_tax > 0.07)",
    "join_not_in_null": "select s_suppkey from supplier where s_suppkey not in (select nullif(l_suppkey, 3) from lineitem where l_quantity = 50) or s_suppkey = 5",
    "join_self": "select a.n_name as x, b.n_name as y from nation a join nation b on a.n_regionkey = b.n_regionkey and a.n_nationkey < b.n_nationkey",
    "join_cross": "select a.r_name as x, b.r_name as y from region a cross join region b",
    "join_scalar_subquery": "select o_orderkey, o_totalprice from orders where o_totalprice > (select 1.9 * avg(o_totalprice) from orders)",
    "join_theta": "select r_regionkey, count(*) as n from region join nation on n_nationkey > 4 * r_regionkey group by r_regionkey",
    "join_disjunctive": "select o_orderkey from orders join customer on (o_custkey = c_custkey and c_mktsegment = 'BUILDING' and o_totalprice > 400000) or (o_custkey = c_custkey and c_mktsegment = 'MACHINERY' and o_totalprice < 20000)",
    "join_correlated_scalar": "select p_partkey, (select max(l_quantity) from lineitem where l_partkey = p_partkey) as most from part",
    # Aggregates
    "agg_global": f"select count(*) as n, count(nullif(event_type, 'view')) as not_views, {money('value')} as total, {mean('value')} as mean_value, min(value) as low, max(value) as high from events",
    "agg_min_max_strings": "select min(url) as first_url, max(url) as last_url from pages",
    "agg_group": f"select l_returnflag, l_linestatus, count(*) as n, {money('l_quantity')} as qty from lineitem group by l_returnflag, l_linestatus",
    "agg_count_distinct": "select event_type, count(distinct user_id) as users from events group by event_type",
    "agg_multi_distinct": f"select count(distinct user_id) as users, count(distinct event_type) as kinds, count(*) as n, {money('value')} as total from events",
    "agg_distinct_case": "select count(distinct case when value > 100 then user_id end) as rich, count(case when value > 100 then 1 end) as n from events",
    "agg_having": "select user_id, count(*) as n from events group by user_id having count(*) > 70",
    "agg_group_alias": f"select {n('extract(year from o_orderdate) - 1990')} as y, count(*) as n from orders group by y",
    "agg_group_literal": "select 1 as one, o_orderstatus, count(*) as n from orders group by 1, o_orderstatus",
    "agg_nested": "select n, count(*) as users from (select user_id, count(*) as n from events group by user_id) t group by n",
    "distinct": "select distinct event_type, user_id from events order by user_id, event_type",
    "rollup": f"select n_regionkey, n_nationkey, count(*) as n, {money('s_acctbal')} as balance from supplier join nation on s_nationkey = n_nationkey group by rollup (n_regionkey, n_nationkey)",
    "cube": "select o_orderstatus, o_orderpriority, count(*) as n from orders group by cube (o_orderstatus, o_orderpriority)",
    "grouping_sets": f"select l_returnflag, l_linestatus, {n('grouping(l_returnflag)')} as g, count(*) as n from lineitem group by grouping sets ((l_returnflag, l_linestatus), (l_linestatus), ())",
    # Sorting and limits
    "topk": "select o_orderkey, o_totalprice from orders order by o_totalprice desc, o_orderkey limit 10",
    "limit_offset": "select event_id, ts from events order by ts, event_id limit 20 offset 35",
    "sort_nulls": "select nullif(user_id, 8) as u, event_id from events order by u asc nulls last, event_id",
    "sort_nulls_desc": "select nullif(user_id, 8) as u, event_id from events order by u desc nulls first, event_id",
    "sort_expression": "select event_id, value from events order by value * -1, event_id",
    # Dates and times
    "date_year": f"select {n('extract(year from o_orderdate)')} as y, count(*) as n from orders group by extract(year from o_orderdate)",
    "date_month": f"select {n('extract(month from o_orderdate)')} as m, count(*) as n from orders group by extract(month from o_orderdate)",
    "date_day": f"select {n('extract(day from o_orderdate)')} as d, count(*) as n from orders group by extract(day from o_orderdate)",
    "date_hour": f"select {n('extract(hour from ts)')} as h, {n('extract(minute from ts)')} as m, count(*) as n from events group by 1, 2",
    "interval_arith": "select o_orderkey, o_orderdate + interval '3' month as later, o_orderdate - interval '10' day as earlier from orders",
    "date_trunc_month": "select cast(date_trunc('month', o_orderdate) as date) as m, count(*) as n from orders group by 1",
    # Strings and numbers
    "str_length": f"select page_id, {n('length(url)')} as chars from pages",
    "substring": "select c_custkey, substring(c_name from 1 for 8) as head, substring(c_name, 10, 3) as tail from customer",
    "upper_concat": "select n_nationkey, upper(n_name) || '-' || lower(n_name) as both_cases from nation",
    "round_nullif": "select s_suppkey, round(s_acctbal / nullif(s_nationkey % 5, 0), 4) as share, coalesce(nullif(s_nationkey, 3), -1) as k from supplier",
    # Windows, set operations, views
    "win_rank": f"select o_orderkey, {n('rank() over (partition by o_orderstatus order by o_totalprice desc)')} as place, {n('dense_rank() over (partition by o_orderpriority order by o_custkey)')} as dense_place from orders",
    "win_running": "select event_id, cast(sum(cast(value as decimal(18,2))) over (partition by user_id order by ts, event_id rows between unbounded preceding and current row) as double) as so_far from events",
    "win_lag": "select event_id, lag(event_id) over (partition by user_id order by ts, event_id) as before_id, lead(value, 2) over (partition by user_id order by ts, event_id) as later from events",
    "win_ntile_topn": "select * from (select o_orderkey, o_orderpriority, cast(row_number() over (partition by o_orderpriority order by o_totalprice desc, o_orderkey) as bigint) as place from orders) t where place <= 3",
    "win_frame_max": "select event_id, max(value) over (partition by event_type order by ts, event_id rows between 3 preceding and 1 following) as peak from events",
    "distinct_on": "select user_id, event_id, event_type from (select *, row_number() over (partition by user_id order by ts desc, event_id) as rn from events) t where rn = 1",
    "union_all": "select c_nationkey as k from customer union all select s_nationkey as k from supplier",
    "union_distinct": "select c_nationkey as k from customer union select s_nationkey as k from supplier",
    "intersect": "select o_custkey as k from orders where o_orderstatus = 'F' intersect select o_custkey as k from orders where o_orderpriority = '1-URGENT'",
    "except_": "select c_custkey as k from customer except select o_custkey as k from orders where o_totalprice > 350000",
    "except_all": "select n_regionkey as k from nation except all select r_regionkey as k from region",
    "cte_chain": "with a as (select user_id, count(*) as n from events group by user_id), b as (select max(n) as top from a) select a.user_id, a.n from a, b where a.n * 2 > b.top",
    "values_inline": "select a.x, b.n_name from (values (1), (2), (null)) as a(x) left join nation b on a.x = b.n_nationkey",
}
QUERIES: dict = {k: SqlQuery(v) for k, v in SQL.items()}
ORACLES: dict[str, str] = {}


def query(oracle: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if oracle is not None:
            ORACLES[f.__name__] = oracle
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query(SQL["join_not_in_null"])
def join_not_in_null(spark, sf_dir):
    taken = table(spark, sf_dir, "lineitem").where("l_quantity = 50").select(F.nullif("l_suppkey", F.lit(3)))
    return not_in(table(spark, sf_dir, "supplier"), "s_suppkey", taken, "free").where("free or s_suppkey = 5").select("s_suppkey")


@query("select event_id, user_id from events where user_id = 43")
def scan_user_schema(spark, sf_dir):
    return spark.read.schema("event_id bigint, user_id bigint").parquet(f"{sf_dir}/events.parquet").where("user_id = 43")


@query("select dayofweek(o_orderdate)::bigint as dow, count(*) as n from orders group by 1")
def date_dow(spark, sf_dir):
    return table(spark, sf_dir, "orders").groupBy(dates.part("DOW", F.col("o_orderdate")).cast("bigint").alias("dow")).agg(F.count(F.lit(1)).alias("n"))


@query("select date_trunc('minute', ts) as m, count(*) as n from events group by 1")
def date_trunc_minute(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy(F.date_trunc("minute", "ts").cast("timestamp_ntz").alias("m")).agg(F.count(F.lit(1)).alias("n"))


@query("select time_bucket(interval '10 seconds', ts, timestamp '1970-01-01') as bucket, count(*) as n from events group by 1")
def date_bin_10s(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy(dates.date_bin(10_000_000, F.col("ts")).alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


@query("select user_id, round((epoch_us(max(ts)) - epoch_us(min(ts))) / 1e6, 3) as seconds from events group by 1")
def epoch_diff(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy("user_id").agg(F.round(dates.epoch_between(F.max("ts"), F.min("ts")), 3).alias("seconds"))


@query("select o_orderkey, (date '1970-01-01' + (o_orderkey % 20000)::int)::date as day from orders")
def from_unix_days(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", dates.date_from_days(F.col("o_orderkey") % 20000).alias("day"))


@query("select event_id, make_timestamp(1700000000000000 + event_id * 1000000) as at_seconds, make_timestamp(1700000000000000 + event_id) as at_micros from events")
def from_epochs(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return e.select("event_id", dates.to_timestamp_seconds(F.col("event_id") + 1700000000).alias("at_seconds"), dates.to_timestamp_micros(F.col("event_id") + 1700000000000000).alias("at_micros"))


@query(r"select page_id, regexp_replace(url, 'th(.)r', '<\1>') as first_only, regexp_replace(url, '^https?://(?:m[.])?([^/]+)/.*$', '\1') as host from pages")
def regexp_host(spark, sf_dir):
    url = F.col("url")
    return table(spark, sf_dir, "pages").select("page_id", strings.regexp_replace_first(url, "th(.)r", r"<\1>").alias("first_only"), strings.regexp_replace_first(url, "^https?://(?:m[.])?([^/]+)/.*$", r"\1").alias("host"))


@query("select event_id from events where make_timestamp(event_id * 1000000) > timestamp '1970-01-01 00:20:00.5'")
def filter_epoch_seconds(spark, sf_dir):
    return table(spark, sf_dir, "events").where(dates.seconds_compare(F.col("event_id"), ">", datetime(1970, 1, 1, 0, 20, 0, 500_000))).select("event_id")


def _props(spark, sf_dir):
    return table(spark, sf_dir, "events").withColumn("data", F.parse_json("props"))


_K = "(props->>'k')::bigint"


@query(f"select event_id, {_K} as k from events")
def variant_get_typed(spark, sf_dir):
    return _props(spark, sf_dir).select("event_id", variant.variant_get(F.col("data"), "k", "Int64").alias("k"))


@query("select event_id, props->>'k' as k, null::varchar as missing from events")
def variant_get_untyped_json(spark, sf_dir):
    get = lambda p: variant.variant_to_json(variant.variant_get(F.col("data"), p))
    return _props(spark, sf_dir).select("event_id", get("k").alias("k"), get("nothing.there").alias("missing"))


@query(f"select event_id from events where {_K} = 42")
def variant_predicate(spark, sf_dir):
    return _props(spark, sf_dir).where(variant.variant_get(F.col("data"), "k", "Int64") == 42).select("event_id")


@query(f"select {_K} as k, count(*) as n from events group by 1")
def variant_group(spark, sf_dir):
    return _props(spark, sf_dir).groupBy(variant.variant_get(F.col("data"), "k", "Int64").alias("k")).agg(F.count(F.lit(1)).alias("n"))


@query(f"select event_type, count(distinct {_K}) as k from events group by 1")
def variant_count_distinct(spark, sf_dir):
    return _props(spark, sf_dir).groupBy("event_type").agg(F.count_distinct(variant.variant_get(F.col("data"), "k", "Int64")).alias("k"))


_ROWS = """(values (0, '{"name":"Alice","age":30}'), (1, '{"name":"Bob","age":25,"address":{"city":"New York"}}'),
  (2, '{"name":"Charlie","age":30,"address":{"zipcode":90001}}'), (3, null), (4, '{}'))"""


@query(f"select i, j->'name' as name, j->>'$.address.city' as city, case when (j->>'age') is not null then (j->>'age')::bigint end as age from (select i, j::json as j from {_ROWS} t(i, j)) u".replace("j->'name' as name", "(j->'name')::varchar as name"))
def variant_nested(spark, sf_dir):
    d = spark.sql(f"select i, parse_json(j) as data from {_ROWS} as t(i, j)")
    get = lambda p, t=None: variant.variant_get(F.col("data"), p, t)
    return d.select("i", variant.variant_to_json(get("name")).alias("name"), get("address.city", "Utf8").alias("city"), get("age", "Int64").alias("age"))


@query()
def variant_pretty(spark, sf_dir):
    return _props(spark, sf_dir).select("event_id", variant.variant_pretty(F.col("data")).alias("pretty"))


# Encodings, on the cents of events.value in batches of 1024 events


def _cents(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_id", "ts", F.round(F.col("value") * 100).cast("bigint").alias("v"))
    return enc.batched(e, "event_id", 1024)


_CENTS = "c as (select event_id, ts, round(value * 100)::bigint as v, event_id // 1024 as batch, event_id % 1024 as pos from events)"
_FOR = f"with {_CENTS}, s as (select batch, min(v) as ref, max(v) as top from c group by 1), f as (select c.*, ref, v - ref as off, length(bin(top - ref))::bigint as width from c join s using (batch))"
_HALF = "greatest(width // 2, 1)"


@query(f"{_FOR} select event_id, off, ref, width from f")
def enc_for(spark, sf_dir):
    return enc.frame_of_reference(_cents(spark, sf_dir), "v").select("event_id", "off", "ref", "width")


@query(f"with {_CENTS} select event_id, case when pos = 0 then v else v - lag(v) over (partition by batch order by pos) end as delta from c")
def enc_delta(spark, sf_dir):
    return enc.delta(_cents(spark, sf_dir), "v").select("event_id", "delta")


@query(f"with {_CENTS} select event_id, v as value from c")
def enc_delta_inverse(spark, sf_dir):
    return enc.undelta(enc.delta(_cents(spark, sf_dir), "v").drop("v")).select("event_id", "value")


@query("with c as (select event_id // 1024 as batch from events) select batch, count(*) as n, true as holds from c group by 1")
def enc_linear(spark, sf_dir):
    """The model of each batch of time stamps, applied again: all residuals lie in the range that it states."""
    e = enc.batched(table(spark, sf_dir, "events").select("event_id", dates.micros(F.col("ts")).alias("v")), "event_id", 1024)
    m = enc.linear_model(e, "v")
    residual = F.col("v") - F.col("intercept") - F.rint(F.col("slope") * F.col("pos")).cast("bigint")
    ok = residual.between(F.col("low"), F.col("high"))
    return e.join(m, "batch").groupBy("batch").agg(F.count(F.lit(1)).alias("n"), F.bool_and(ok).alias("holds"))


@query(f"{_FOR} select event_id, case when width >= 8 then (1::bigint << {_HALF}::int) - 1 end as sentinel, case when width >= 8 then least(off, (1::bigint << {_HALF}::int) - 1) else off end as clamped from f")
def enc_clamp(spark, sf_dir):
    return enc.clamp(enc.frame_of_reference(_cents(spark, sf_dir), "v")).select("event_id", "sentinel", "clamped")


_QUANT = f"{_FOR}, t as (select batch, max(off) as most from f group by 1), q as (select f.*, 1::bigint << {_HALF}::int as buckets, (most + (1::bigint << {_HALF}::int)) // (1::bigint << {_HALF}::int) as step from f join t using (batch))"


@query(f"{_QUANT} select event_id, step, least(off // step, buckets - 1) as bucket from q")
def enc_quantize(spark, sf_dir):
    return enc.quantize(enc.frame_of_reference(_cents(spark, sf_dir), "v")).select("event_id", "step", "bucket")


@query(f"with {_CENTS} select event_id from c where v > 2500")
def enc_quantize_prune(spark, sf_dir):
    base = _cents(spark, sf_dir)
    squeezed = enc.quantize(enc.frame_of_reference(base, "v"))
    return enc.filter_squeezed(squeezed, base, "event_id", "v", ">", 2500).select("event_id")


@query(f"with {_CENTS} select event_id from c where v <= 1234")
def enc_clamp_prune(spark, sf_dir):
    base = _cents(spark, sf_dir)
    squeezed = enc.clamp(enc.frame_of_reference(base, "v"))
    return enc.filter_squeezed(squeezed, base, "event_id", "v", "<=", 1234, enc.decide_clamped).select("event_id")


@query("select event_id, round(value * 100)::bigint as alp from events")
def enc_float_alp(spark, sf_dir):
    """The exponent is searched; all values are exact at two decimals."""
    e = table(spark, sf_dir, "events")
    return e.select("event_id", enc.alp_integer(F.col("value"), enc.alp_places(e, "value")).alias("alp"))


def _alp(spark, sf_dir):
    return enc.batched(table(spark, sf_dir, "events").select("event_id", "value", enc.alp_integer(F.col("value"), 2).alias("v")), "event_id", 1024)


@query(f"{_QUANT} select event_id, step, least(off // step, buckets - 1) as bucket from q")
def enc_float_quantize(spark, sf_dir):
    return enc.quantize(enc.frame_of_reference(_alp(spark, sf_dir), "v")).select("event_id", "step", "bucket")


@query("select event_id from events where value > 24.995")
def enc_float_prune(spark, sf_dir):
    """The constant lies between two codes; what the buckets can't decide is compared as it is."""
    base = _alp(spark, sf_dir)
    squeezed = enc.quantize(enc.frame_of_reference(base, "v"))
    return enc.filter_squeezed(squeezed, base, "event_id", "value", ">", 24.995, lambda op, k: enc.decide_scaled(op, k, 2)).select("event_id")


def _price(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_totalprice").cast("decimal(15,2)").alias("price"))
    return o.withColumns({"batch": F.expr("o_orderkey div 4096"), "v": enc.decimal_integer(F.col("price"), 2)})


@query("""with p as (select o_orderkey, o_orderkey // 4096 as batch, (o_totalprice::decimal(15,2) * 100)::bigint as v from orders), s as (select batch, min(v) as ref, max(v) as top from p group by 1),
  f as (select *, 1::bigint << greatest(length(bin(top - ref)) // 2, 1)::int as buckets from p join s using (batch)), q as (select *, (top - ref) // buckets + 1 as step from f)
  select o_orderkey, step, least((v - ref) // step, buckets - 1) as bucket from q""")
def enc_decimal_quantize(spark, sf_dir):
    return enc.quantize(enc.frame_of_reference(_price(spark, sf_dir), "v")).select("o_orderkey", "step", "bucket")


@query("select o_orderkey from orders where o_totalprice::decimal(15,2) <= 50000.125")
def enc_decimal_prune(spark, sf_dir):
    base = _price(spark, sf_dir)
    squeezed = enc.quantize(enc.frame_of_reference(base, "v"))
    k = Decimal("50000.125")
    return enc.filter_squeezed(squeezed, base, "o_orderkey", "price", "<=", k, lambda op, k: enc.decide_scaled(op, k, 2)).select("o_orderkey")


@query("select o_orderkey, year(o_orderdate)::bigint as year, month(o_orderdate)::bigint as month, day(o_orderdate)::bigint as day, dayofweek(o_orderdate)::bigint as dow from orders")
def enc_date_squeeze(spark, sf_dir):
    return enc.date_squeeze(table(spark, sf_dir, "orders"), "o_orderdate").select("o_orderkey", "year", "month", "day", "dow")


@query("""select o_orderkey, make_date(year(o_orderdate), 1, 1) as year, make_date(1970, month(o_orderdate), 1) as month,
  make_date(1970, 1, day(o_orderdate)) as day, (date '1970-01-04' + dayofweek(o_orderdate)::int)::date as dow, true as keeps from orders""")
def enc_date_lossy(spark, sf_dir):
    d = F.col("o_orderdate")
    back = {u: dates.expand(u, dates.part(u, d)) for u in dates.PARTS}
    keeps = F.lit(True)
    for u, b in back.items():
        keeps = keeps & (dates.part(u, b) == dates.part(u, d))
    return table(spark, sf_dir, "orders").select("o_orderkey", *[b.alias(u.lower()) for u, b in back.items()], keeps.alias("keeps"))


@query("""select page_id, (select sum(1::bigint << b)::bigint from (select distinct ('0x' || h)::int & 31 as b from unnest(regexp_extract_all(hex(encode(url)), '..')) t(h)) u) as print from pages""")
def enc_fingerprint(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", strings.fingerprint(F.col("url")).alias("print"))


@query("select page_id from pages where url like '%therin%'")
def enc_fingerprint_search(spark, sf_dir):
    return enc.substring_candidates(table(spark, sf_dir, "pages"), "url", "therin").where("match").select("page_id")


@query("select page_id, substr(hex(encode(url)), 1, 14) as prefix, least(octet_length(encode(url)), 255)::bigint as size, (dense_rank() over (order by url) - 1)::bigint as code from pages")
def enc_prefix(spark, sf_dir):
    return enc.dictionary(table(spark, sf_dir, "pages"), "url").select("page_id", "prefix", "size", "code")


@query("select event_type, (dense_rank() over (order by event_type) - 1)::bigint as code, event_id from events")
def enc_dictionary(spark, sf_dir):
    return enc.dictionary(table(spark, sf_dir, "events"), "event_type").select("event_type", "code", "event_id")


@query(f"select event_id, event_type, {_K} as k from events")
def enc_variant_shred(spark, sf_dir):
    """The typed path as a column of its own, and a variant of it alone made again for the query."""
    base = _props(spark, sf_dir).select("event_id", "event_type", "data")
    forms = {"data": Annotation("events", "data", "variant", "$.k:bigint")}
    shredded = squeeze.restore(squeeze.squeeze(base, forms), base, forms)
    return shredded.select("event_id", "event_type", variant.variant_get(F.col("data"), "k", "Int64").alias("k"))


@query("""with r as (select event_id // 1024 as batch, event_id % 1024 as pos, event_type from events),
  m as (select *, case when event_type is distinct from lag(event_type) over (partition by batch order by pos) or pos = 0 then 1 else 0 end as new from r),
  g as (select *, sum(new) over (partition by batch order by pos) as run from m) select batch, run::bigint as run, min(event_type) as event_type, count(*) as n from g group by batch, run""")
def enc_run_length(spark, sf_dir):
    return enc.run_lengths(enc.batched(table(spark, sf_dir, "events").select("event_id", "event_type"), "event_id", 1024), "event_type")


@query("select event_id, coalesce(nullif(event_type, 'view') = 'click', false) as mask from events where user_id > 100")
def eval_predicate(spark, sf_dir):
    e = table(spark, sf_dir, "events").where("user_id > 100")
    return e.select("event_id", F.coalesce(F.nullif("event_type", F.lit("view")) == "click", F.lit(False)).alias("mask"))


@query("select count(*) as n, sum((a or b)::int)::bigint as either, sum((a and b)::int)::bigint as both, sum((not a)::int)::bigint as not_a from (select value > 50 as a, user_id < 75 as b from events) t")
def selection_algebra(spark, sf_dir):
    a, b = F.col("value") > 50, F.col("user_id") < 75
    count = lambda c: F.count(F.when(c, 1))
    return table(spark, sf_dir, "events").agg(F.count(F.lit(1)).alias("n"), count(a | b).alias("either"), count(a & b).alias("both"), count(~a).alias("not_a"))
