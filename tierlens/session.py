"""Sessions: Spark with the settings that the engine's SQL relies on, a table catalog and a cache registry."""

from __future__ import annotations

import platform
import threading
from collections.abc import Mapping
from dataclasses import dataclass, field, replace

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession

from .operators.cache import POLICIES, CacheFull, Registry
from .plans.lineage import Annotation, annotations, forms
from .sources import catalog
from .sources.ship import ship

#: UTC, so that timestamps agree with other engines; ANSI errors; "x" as a column name.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.ansi.enabled": "true",
    "spark.sql.ansi.doubleQuotedIdentifiers": "true",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.parquet.filterPushdown": "true",
    "spark.sql.variant.pushVariantIntoScan": "true",
}


@dataclass(frozen=True)
class EngineBuilder:
    """Settings of an engine; each ``with_`` method returns a changed copy."""

    memory: int = 1 << 30
    disk: int | None = None
    batch_rows: int = 8192
    policy: str = "transcode_squeeze_evict"
    hydrate: bool = True
    settings: Mapping[str, str] = field(default_factory=dict)
    stores: tuple[tuple[str, Mapping[str, str]], ...] = ()

    def with_memory(self, size: int) -> EngineBuilder:
        return replace(self, memory=size)

    def with_disk(self, size: int | None) -> EngineBuilder:
        return replace(self, disk=size)

    def with_batch_rows(self, rows: int) -> EngineBuilder:
        if rows <= 0:
            raise ValueError("a batch has at least one row")
        return replace(self, batch_rows=rows)

    def with_policy(self, policy: str) -> EngineBuilder:
        if policy not in POLICIES:
            raise ValueError(f"no such policy: {policy}")
        return replace(self, policy=policy)

    def with_hydration(self, on: bool) -> EngineBuilder:
        return replace(self, hydrate=on)

    def with_setting(self, key: str, value: str) -> EngineBuilder:
        return replace(self, settings={**self.settings, key: value})

    def with_object_store(self, url: str, options: Mapping[str, str]) -> EngineBuilder:
        return replace(self, stores=(*self.stores, (url, dict(options))))

    def build(self, spark: SparkSession | None = None) -> Engine:
        if spark is None:
            spark = SparkSession.builder.config(map={**SETTINGS, **self.settings}).getOrCreate()
        for key, value in {**SETTINGS, **self.settings, "spark.sql.inMemoryColumnarStorage.batchSize": str(self.batch_rows), "spark.sql.parquet.columnarReaderBatchSize": str(self.batch_rows)}.items():
            if key.startswith("spark.sql."):
                spark.conf.set(key, value)
        for url, options in self.stores:
            catalog.register_object_store(spark, url, options)
        ship(spark)
        return Engine(spark, Registry(spark, self.memory, self.disk, self.policy, self.hydrate))


@dataclass
class Engine:
    """SQL over registered tables, with the registry's cache and the calls of an administrator."""

    spark: SparkSession
    registry: Registry
    plans: list[tuple[str, str]] = field(default_factory=list)
    tables: dict[str, DataFrame] = field(default_factory=dict)
    lock: threading.Lock = field(default_factory=threading.Lock)

    def register_parquet(self, name: str, path: str, schema=None) -> DataFrame:
        return self.register(name, catalog.register_parquet(self.spark, name, path, schema))

    def register(self, name: str, df: DataFrame) -> DataFrame:
        """Make *df* a table whose columns the cache may hold."""
        df.createOrReplaceTempView(name)
        self.tables[name] = df
        return df

    def sql(self, text: str) -> DataFrame:
        """The query over registered tables, answered from the cache: its analysed plan tells which columns it
        uses and how, the registry holds these from the first such query on, and the query is bound to what is held.

        Queries whose use of columns can't be followed (subqueries, windows)
        run on the tables as they are.
        """
        df = self.spark.sql(text)
        wanted = {t: columns for t, columns in forms(df).items() if t in self.tables}
        if wanted:
            with self.lock:
                try:
                    for t, columns in wanted.items():
                        self.registry.table(t, self.tables[t], columns).createOrReplaceTempView(t)
                    df = self.spark.sql(text)
                except (AnalysisException, CacheFull):  # a column that the walk over the plan didn't see, or no room
                    self.registry.counters["fallback"] += 1
                finally:
                    for t in wanted:
                        self.tables[t].createOrReplaceTempView(t)
        self.plans.append((text, df._jdf.queryExecution().simpleString()))
        return df

    def annotations(self, text: str) -> list[Annotation]:
        """How the query's columns could be reduced (see :mod:`tierlens.plans.lineage`)."""
        return annotations(self.spark.sql(text))

    # Administration ----------------------------------------------------------

    def reset_cache(self) -> None:
        self.registry.reset()
        self.spark.catalog.clearCache()

    def cache_info(self) -> dict[str, int]:
        """Batch size and budgets."""
        return {"batch_rows": int(self.spark.conf.get("spark.sql.inMemoryColumnarStorage.batchSize")), "memory_budget": self.registry.memory, "disk_budget": -1 if self.registry.disk is None else self.registry.disk}

    def cache_usage(self) -> dict[str, int]:
        return {"memory_bytes": self.registry.memory_used(), "disk_bytes": self.registry.disk_used()}

    def cache_stats(self, path: str) -> None:
        self.registry.write_stats(path)

    def stop_trace(self, path: str) -> None:
        self.registry.flush_trace(path)

    def system_info(self) -> dict[str, str | int]:
        sc = self.spark.sparkContext
        return {"spark": sc.version, "master": sc.master, "parallelism": sc.defaultParallelism, "python": platform.python_version(), "system": platform.platform()}

    def execution_plans(self) -> list[tuple[str, str]]:
        """(SQL, physical plan) of the queries so far."""
        return list(self.plans)
