"""Sessions, catalog, cache registry, lineage, predicates, functions and encodings beyond what the oracle queries cover."""

import json

import pytest
from pyspark.sql import functions as F

from tierlens.functions import dates, strings, variant
from tierlens.operators import encodings as enc
from tierlens.operators.cache import COMPACT, DISK, RAW, SQUEEZED, CacheFull, EntryId, Hint, HintTracker, Registry
from tierlens.plans.lineage import annotations, like_needle
from tierlens.plans.predicates import ordered
from tierlens.session import EngineBuilder
from tierlens.sources import catalog

SF = "/root/testdata/sf0.001"


# Sessions and catalog


def test_engine_runs_sql_and_reports(spark, tmp_path):
    engine = EngineBuilder().with_memory(5000).with_disk(10_000).with_batch_rows(1024).with_policy("transcode_evict").build(spark)
    engine.register_parquet("orders", f"{SF}/orders.parquet")
    engine.register_parquet("slim", f"{SF}/orders.parquet", "o_orderkey bigint, o_orderstatus string")
    assert engine.sql('select count(*) as n from orders where "o_orderstatus" <> \'x\'').first()["n"] == 1500
    assert engine.spark.table("slim").columns == ["o_orderkey", "o_orderstatus"]
    assert "Scan parquet" in engine.execution_plans()[0][1] or "FileScan" in engine.execution_plans()[0][1]
    assert engine.cache_info() == {"batch_rows": 1024, "memory_budget": 5000, "disk_budget": 10_000}
    assert 0 < engine.cache_usage()["memory_bytes"] <= 5000
    engine.reset_cache()
    engine.registry.insert(EntryId("orders", "o_orderkey"), spark.table("orders"), size=100)
    assert engine.cache_usage()["memory_bytes"] == 100 and engine.system_info()["spark"]
    engine.cache_stats(str(tmp_path / "stats"))
    engine.stop_trace(str(tmp_path / "trace"))
    assert spark.read.parquet(str(tmp_path / "stats")).count() == 1
    assert spark.read.parquet(str(tmp_path / "trace")).first()["kind"] == "inserted"
    engine.reset_cache()
    assert engine.cache_usage() == {"memory_bytes": 0, "disk_bytes": 0}
    spark.conf.set("spark.sql.ansi.doubleQuotedIdentifiers", "false")


def test_bad_settings():
    with pytest.raises(ValueError):
        EngineBuilder().with_policy("lru")
    with pytest.raises(ValueError):
        EngineBuilder().with_batch_rows(0)


def test_manifest(spark, tmp_path):
    (tmp_path / "q7.sql").write_text("create or replace temporary view big as select * from part where p_size > 40; -- a; comment\nselect count(*) as n from big where p_name <> 'a;b'; drop view big")
    (tmp_path / "m.json").write_text(json.dumps({"name": "m", "tables": {"part": f"{SF}/part.parquet"}, "queries": ["q7.sql", "select 1 as one"]}))
    m = catalog.Manifest.load(tmp_path / "m.json")
    m.register(spark)
    assert [(k, [r[0] for r in df.collect()]) for k, df in m.run(spark)][1] == ("1", [1])
    assert [k for k, _ in m.statements()] == ["7", "1"] and len(dict(m.statements())["7"]) == 3
    (tmp_path / "bad.json").write_text("{}")
    with pytest.raises(ValueError):
        catalog.Manifest.load(tmp_path / "bad.json")


def test_object_store_options(spark):
    catalog.register_object_store(spark, "s3://b", {"access_key_id": "k", "endpoint": "http://localhost:1"})
    assert spark.sparkContext._jsc.hadoopConfiguration().get("fs.s3a.access.key") == "k"
    for url, options in (("ftp://x", {}), ("s3://b", {"colour": "red"})):
        with pytest.raises(ValueError):
            catalog.register_object_store(spark, url, options)


def test_csv_import_and_sinks(spark, tmp_path):
    (tmp_path / "a.csv").write_text('1,"x ""y"", z",2020-01-02\n2,,\n')
    catalog.csv_to_parquet(spark, str(tmp_path / "a.csv"), str(tmp_path / "a"), "id int, t string, d date")
    rows = spark.read.parquet(str(tmp_path / "a")).orderBy("id").collect()
    assert rows[0]["t"] == 'x "y", z' and rows[1]["t"] is None and rows[1]["d"] is None
    catalog.save_result(spark.read.parquet(str(tmp_path / "a")), str(tmp_path / "r"))
    warm = catalog.prefetch(spark.read.parquet(str(tmp_path / "r")), ["id"])
    assert warm.is_cached and warm.count() == 2
    warm.unpersist()


def test_pruning_reaches_the_scan(spark, tmp_path):
    """200,000 ids in small row groups: one id reads few rows; only the named column is read."""
    path = str(tmp_path / "ids")
    spark.range(200_000).withColumn("x", F.col("id") * 2).coalesce(1).write.option("parquet.block.size", "65536").option("parquet.bloom.filter.enabled#id", "true").parquet(path)
    df = spark.read.parquet(path).where("id = 123456").select("id")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(id,123456)" in plan and "ReadSchema: struct<id:bigint>" in plan
    assert df.count() == 1


# Cache registry


def _registry(spark, **kw):
    return Registry(spark, **{"memory": 1000, "hydrate": False, **kw})


def _tiers(r):
    return {i.column: e.tier for i, e in r.entries.items()}


@pytest.mark.parametrize(
    ("policy", "want"),
    [
        ("evict", {"event_id": DISK, "user_id": DISK, "value": RAW, "event_type": RAW}),
        ("transcode_evict", {"event_id": COMPACT, "user_id": COMPACT, "value": COMPACT, "event_type": RAW}),
        ("transcode_squeeze_evict", {"event_id": COMPACT, "user_id": COMPACT, "value": COMPACT, "event_type": RAW}),
    ],
)
def test_policies(spark, policy, want):
    events, r = spark.read.parquet(f"{SF}/events.parquet"), _registry(spark, policy=policy)
    for c in want:
        r.insert(EntryId("events", c), events, size=400)
    assert _tiers(r) == want
    for c in want:
        got = r.get(EntryId("events", c))
        assert sorted(map(str, got.collect())) == sorted(map(str, events.select(c).collect()))
    r.reset()
    assert not r.entries and r.memory_used() == 0


def test_squeeze_then_disk_then_removed(spark):
    events = spark.read.parquet(f"{SF}/events.parquet")
    r = _registry(spark, memory=450, disk=450)
    r.insert(EntryId("events", "ts"), events, size=400, hint=Hint("date", ("YEAR", "DOW")))
    r.insert(EntryId("events", "value"), events, size=400)
    assert _tiers(r)["ts"] == SQUEEZED and r.projection(EntryId("events", "ts")).columns == ["ts_year", "ts_dow"]
    assert r.get(EntryId("events", "ts")).count() == 1000
    r.insert(EntryId("events", "user_id"), events, size=400)
    r.insert(EntryId("events", "event_id"), events, size=400)
    assert r.memory_used() <= 450 and r.disk_used() <= 450
    assert "removed" in [e.kind for e in r.events]
    r.flush()
    assert set(_tiers(r).values()) == {DISK}
    with pytest.raises(CacheFull):
        _registry(spark, memory=10, disk=10).insert(EntryId("events", "ts"), events, size=400)
    r.reset()


def test_hydration_and_misses(spark):
    events, r = spark.read.parquet(f"{SF}/events.parquet"), _registry(spark, hydrate=True)
    assert r.get(EntryId("events", "ts")) is None and r.eval_predicate(EntryId("events", "ts"), F.lit(True)) is None
    id = EntryId("events", "event_type")
    r.insert(id, events, size=400)
    r.flush()
    assert r.get(id, F.col("event_type") == "view").count() > 0 and _tiers(r)["event_type"] == COMPACT
    mask = r.eval_predicate(id, F.nullif("event_type", F.lit("view")) == "click")
    assert mask.where("mask is null").count() == 0 and mask.count() == 1000
    r.reset()


def test_hint_tracker():
    t = HintTracker()
    assert t.best("a") is None
    for u in ("YEAR", "MONTH", "MONTH", "YEAR"):
        t.note("a", Hint("date", (u,)))
    assert t.best("a") == Hint("date", ("YEAR",))
    for _ in range(16):
        t.note("a", Hint("predicate"))
    assert t.best("a") == Hint("predicate")


# Lineage and predicates


@pytest.fixture(scope="module")
def views(spark):
    for t in ("orders", "events", "pages", "customer"):
        spark.read.parquet(f"{SF}/{t}.parquet").createOrReplaceTempView(t)
    spark.sql("select event_id, event_type, parse_json(props) as data from events").createOrReplaceTempView("feed")
    return spark


@pytest.mark.parametrize(
    ("sql", "want"),
    [
        ("select extract(year from o_orderdate) from orders", {"o_orderdate": "YEAR"}),
        ("select year(o_orderdate), dayofweek(o_orderdate) from orders", {"o_orderdate": "YEAR,DOW"}),
        ("select date_part('month', o_orderdate) from orders", {"o_orderdate": "MONTH"}),
        ("select o_orderdate, extract(year from o_orderdate) from orders", {}),
        ("select extract(hour from ts) from events", {}),
        ("select extract(year from o_orderdate) from orders order by o_orderdate", {}),
        ("select max(extract(year from o_orderdate)) from orders where o_orderstatus = 'F'", {"o_orderdate": "YEAR"}),
        ("select a.y from (select extract(year from o_orderdate) as y, o_orderkey as k from orders) a join customer on k = c_custkey", {"o_orderdate": "YEAR"}),
        ("select 1 from orders a join orders b on a.o_orderdate = b.o_orderdate", {}),
        ("select extract(day from max(o_orderdate)) from orders", {}),
        ("select sum(n) over (partition by y) from (select extract(year from o_orderdate) as y, 1 as n from orders) t", {"o_orderdate": "YEAR"}),
        ("select distinct extract(month from o_orderdate) as m from orders", {"o_orderdate": "MONTH"}),
        ("with c as (select extract(year from o_orderdate) as y from orders) select x.y from c x join c z on x.y = z.y", {"o_orderdate": "YEAR"}),
        ("select c_custkey from customer where c_name like '%00%' and c_custkey > (select count(*) from orders where extract(year from o_orderdate) = 1996)", {"c_name": "00"}),
        ("select url from pages where url like 'http%'", {}),
        ("select url from pages where url like '%a%b%' or url like '%x%'", {}),
        ("select url from pages where contains(url, 'ther')", {"url": "ther"}),
        ("select length(url) from pages where url like '%x%'", {}),
        ("select variant_get(data, '$.a.b', 'int') from feed", {"data": "$.a.b:integer"}),
        ("select data from feed", {}),
        ("select to_json(data) from feed where variant_get(data, '$.k', 'int') = 1", {}),
    ],
)
def test_lineage(views, sql, want):
    assert {a.column: a.detail for a in annotations(views.sql(sql))} == want


def test_like_needles():
    assert [like_needle(p) for p in ("%x%", "%%", "x%", "%a_b%", "%a%b%", "%a\\%")] == ["x", None, None, None, None, None]


def test_predicate_kinds(views):
    df = views.sql("select * from events where 3 < value and user_id = event_id and event_type ilike '%V%' and event_type like '%ie%' and cast(user_id as int) <= 5 and event_type > 'a'")
    by = {c.kind: c for c in ordered(df, substring_hint=True)}
    assert by["Like"].evaluable and by["LessThanOrEqual"].evaluable and by["GreaterThan"].evaluable
    assert not by["LessThan"].evaluable and not by["EqualTo"].evaluable and not by.get("ILike", by["EqualTo"]).evaluable
    assert not {c.kind: c for c in ordered(df)}["Like"].evaluable


# Functions and encodings


def test_variant_paths_and_types(spark):
    assert variant.json_path("a.b[2]") == "$['a']['b'][2]" and variant.json_path("$.a") == "$.a"
    assert variant.spark_type("Decimal128(10, 2)") == "decimal(10,2)" and variant.spark_type("UInt64") == "decimal(20,0)"
    for f, bad in ((variant.spark_type, "Utf9"), (variant.spark_type, "Decimal256(60, 2)"), (variant.json_path, "")):
        with pytest.raises(ValueError):
            f(bad)
    d = spark.sql("""select parse_json('{"a b": {"c": [1, "x"]}, "n": null}') as v""")
    row = d.select(variant.variant_get(F.col("v"), "a b.c[1]", "Utf8").alias("x"), variant.variant_get(F.col("v"), "a b.c[1]", "Int64").alias("y"), variant.variant_to_json(variant.variant_get(F.col("v"), "a b")).alias("z")).first()
    assert (row["x"], row["y"], row["z"]) == ("x", None, '{"c":[1,"x"]}')


def test_first_match_only(spark):
    d = spark.createDataFrame([("aXbXc",), ("none",), (None,), ("a\nX",)], "t string")
    got = [r[0] for r in d.select(strings.regexp_replace_first(F.col("t"), "(X)", r"[\1]")).collect()]
    assert got == ["a[X]bXc", "none", None, "a\n[X]"]
    assert [r[0] for r in d.select(strings.regexp_replace_first(F.col("t"), "^a", "$1")).collect()] == ["$1XbXc", "none", None, "$1\nX"]


def test_fingerprint_never_misses(spark):
    d = spark.createDataFrame([("héllo wörld",), ("",), (None,), ("google",)], "t string").withColumn("p", strings.fingerprint(F.col("t")))
    rows = d.withColumn("m", strings.may_contain(F.col("p"), "oog")).collect()
    assert [r["m"] for r in rows] == [False, False, None, True]
    assert rows[3]["p"] == strings.fingerprint_of("google") and rows[1]["p"] == 0


def test_date_bins_before_the_origin(spark):
    d = spark.sql("select timestamp_ntz '1969-12-31 23:59:55' as t")
    assert str(d.select(dates.date_bin(10_000_000, F.col("t"))).first()[0]) == "1969-12-31 23:59:50"
    with pytest.raises(ValueError):
        dates.part("CENTURY", F.lit(1))


def _values(spark):
    rows = [(i, None if i % 97 == 0 else (i * i * 37) % 5000 - 700 if i < 3000 else 42) for i in range(4096)]
    return enc.batched(spark.createDataFrame(rows, "k bigint, v bigint"), "k", 1024)


@pytest.mark.parametrize("op", list(enc.COMPARE))
def test_squeezed_filters_agree_with_the_base(spark, op):
    base = _values(spark)
    f = enc.frame_of_reference(base, "v")
    for squeezed, decide in ((enc.quantize(f), enc.decide_quantized), (enc.clamp(f), enc.decide_clamped)):
        squeezed = squeezed.cache()
        for k in (-701, -700, 42, 43, 1000, 4299, 9999):
            want = sorted(r["k"] for r in base.where(enc.COMPARE[op](F.col("v"), F.lit(k))).collect())
            got = enc.filter_squeezed(squeezed, base, "k", "v", op, k, decide).collect()
            assert sorted(r["k"] for r in got) == want
        assert squeezed.where(decide("<", 10_000).isNull() & F.col("v").isNotNull()).count() <= squeezed.count()
        squeezed.unpersist()


def test_linear_model_is_tight(spark):
    rows = [(i, 1000 + 7 * i + (i * 31 % 5)) for i in range(300)] + [(300 + i, None) for i in range(300)] + [(600, 5)]
    m = {r["batch"]: r for r in enc.linear_model(enc.batched(spark.createDataFrame(rows, "k bigint, v bigint"), "k", 300), "v").collect()}
    assert set(m) == {0, 2} and abs(m[0]["slope"] - 7) < 0.05 and m[0]["high"] - m[0]["low"] <= 6 and m[0]["width"] <= 3 and m[2]["width"] == 1


def test_alp_exceptions(spark):
    d = spark.createDataFrame([(1.25,), (0.1,), (1 / 3,), (None,)], "x double")
    assert [r[0] for r in d.select(enc.alp_integer(F.col("x"), 2)).collect()] == [125, 10, None, None]


def test_dictionary_codes_follow_byte_order(spark):
    d = spark.createDataFrame([("b",), ("a",), (None,), ("é",), ("b",), ("x" * 300,)], "t string")
    rows = {r["t"]: (r["code"], r["size"]) for r in enc.dictionary(d, "t").collect()}
    assert rows == {"a": (0, 1), "b": (1, 1), "x" * 300: (2, 255), "é": (3, 2), None: (None, None)} or rows[None][0] is None


# SQL through the cache

SQLS = (
    "select extract(year from o_orderdate) as y, count(*) as n from orders group by 1",
    "select extract(year from o_orderdate) as y, extract(day from o_orderdate) as d, max(o_totalprice) as t from orders where o_orderstatus = 'F' group by 1, 2",
    "select extract(dow from o_orderdate) as w, count(*) as n from orders group by 1",
    "select max(o_orderdate) as latest, extract(month from o_orderdate) as m from orders group by 2",
    "select event_type, variant_get(data, '$.k', 'int') as k from feed where event_type like '%lic%'",
    "select data::string as whole, variant_get(data, '$.k', 'int') as k from feed where variant_get(data, '$.k', 'int') > 90",
    "select o_orderstatus, count(*) as n from orders join feed on o_orderkey = event_id where variant_get(data, '$.k', 'int') < 50 group by 1",
    "select count(*) as n from orders where o_totalprice > (select avg(o_totalprice) from orders)",
    "select o_orderstatus, extract(year from o_orderdate) as y, count(*) as n from orders group by rollup (o_orderstatus, extract(year from o_orderdate))",
)


def _engine(spark, **kw):
    builder = EngineBuilder(**kw)
    engine = builder.build(spark)
    engine.register_parquet("orders", f"{SF}/orders.parquet")
    engine.register("feed", spark.read.parquet(f"{SF}/events.parquet").select("event_id", "event_type", F.parse_json("props").alias("data")))
    return engine


@pytest.mark.parametrize("policy", ["evict", "transcode_evict", "transcode_squeeze_evict"])
@pytest.mark.parametrize("memory", [20_000, 200_000, 1 << 30])
def test_sql_is_the_same_whatever_the_cache_holds(spark, policy, memory):
    """Nine queries, cold, warm and squeezed, under each policy and budget."""
    engine = _engine(spark, memory=memory, policy=policy)
    rows = lambda df: sorted(map(str, df.collect()))
    want = [rows(spark.sql(q)) for q in SQLS]
    for step in ("cold", "warm", "squeezed"):
        assert [rows(engine.sql(q)) for q in SQLS] == want, step
        assert engine.registry.memory_used() <= memory
        engine.registry.squeeze()
    assert engine.registry.counters["fallback"] == 0
    engine.reset_cache()


def test_sql_reads_the_derived_column_when_warm(spark):
    engine = _engine(spark, hydrate=False)
    engine.sql(SQLS[0])
    whole = engine.cache_usage()["memory_bytes"]
    engine.registry.squeeze()
    plan = engine.sql(SQLS[0])._jdf.queryExecution().sparkPlan().toString()
    assert "InMemoryTableScan [o_orderdate_year" in plan
    assert 0 < engine.cache_usage()["memory_bytes"] < whole
    assert "o_orderdate_year" not in engine.sql(SQLS[3])._jdf.queryExecution().sparkPlan().toString().split("InMemoryRelation")[0]
    assert engine.registry.counters["squeezed_hit"] == 1
    engine.reset_cache()


def test_usage_is_what_the_block_manager_reports(spark):
    engine = _engine(spark)
    for q in SQLS:
        engine.sql(q)
    infos = list(spark.sparkContext._jsc.sc().getRDDStorageInfo())
    assert engine.cache_usage() == {"memory_bytes": sum(i.memSize() for i in infos), "disk_bytes": sum(i.diskSize() for i in infos)}
    assert engine.cache_usage()["memory_bytes"] > 0
    engine.reset_cache()


def test_predicate_hints_do_not_squeeze(spark):
    registry = Registry(spark, memory=450, hydrate=False)
    data = spark.range(100).withColumnRenamed("id", "a")
    registry.insert(EntryId("t", "a"), data, size=400, hint=Hint("predicate"))
    registry.insert(EntryId("u", "a"), data, size=400)
    assert registry.entries[EntryId("t", "a")].tier == DISK


# Encodings of values with nulls and extremes


def test_delta_and_frame_keep_nulls_and_extremes(spark):
    values = [None, 1, None, 3, 7, None, -(2**62), None] + [2**63 - 1, -(2**63), None, 0] + [5, 5, None, 9]
    df = spark.createDataFrame([(i, i // 8 if i < 8 else i // 4 + 10, i % 8, v) for i, v in enumerate(values)], "i int, batch int, pos int, v bigint")
    small = df.where("v is null or abs(try_divide(v, 4)) < 4611686018427387904 and v > -9223372036854775808 and v < 9223372036854775807")
    back = enc.undelta(enc.delta(small, "v")).collect()
    assert len(back) > 8 and all(r["value"] == r["v"] for r in back)
    framed = enc.frame_of_reference(df, "v").collect()
    assert all(r["v"] is None and r["off"] is None or r["ref"] + r["off"] == r["v"] for r in framed)
    assert {r["width"] for r in framed} >= {64}
    for op in enc.COMPARE:
        for k in (-(2**63), -5, 0, 3, 2**63 - 1):
            for squeezed, decide in ((enc.quantize, enc.decide_quantized), (enc.clamp, enc.decide_clamped)):
                got = enc.filter_squeezed(squeezed(enc.frame_of_reference(df, "v")), df, "i", "v", op, k, decide).collect()
                assert sorted(r["i"] for r in got) == [i for i, v in enumerate(values) if v is not None and eval(f"v {({'=': '==', '<>': '!='}).get(op, op)} k")]


def test_scaled_comparisons_and_exponents(spark):
    floats = [0.25, 1.5, None, -3.125, float("nan"), float("inf"), 1 / 3, 1e300, 2.0]
    df = spark.createDataFrame([(i, 0, i, f) for i, f in enumerate(floats)], "i int, batch int, pos int, f double")
    assert enc.alp_places(df, "f") == 3
    base = df.withColumn("v", enc.alp_integer(F.col("f"), 3))
    assert [r["v"] for r in base.orderBy("i").collect()] == [250, 1500, None, -3125, None, None, None, None, 2000]
    for op in ("=", "<>", "<", "<=", ">", ">="):
        for k in (1.5, 0.2503, -3.125):
            squeezed = enc.quantize(enc.frame_of_reference(base, "v"))
            got = enc.filter_squeezed(squeezed, base, "i", "f", op, k, lambda op, k: enc.decide_scaled(op, k, 3)).collect()
            assert sorted(r["i"] for r in got) == sorted(r["i"] for r in df.where(enc.COMPARE[op](F.col("f"), F.lit(k))).collect())
