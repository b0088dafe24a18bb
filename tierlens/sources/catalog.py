"""Tables by name: Parquet files and folders, workload manifests, storage options, CSV import, warm-up."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass, field
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

#: Hadoop settings of an object store's options, by URL scheme.
OPTIONS = {
    "s3": {"access_key_id": "fs.s3a.access.key", "secret_access_key": "fs.s3a.secret.key", "endpoint": "fs.s3a.endpoint", "region": "fs.s3a.endpoint.region", "session_token": "fs.s3a.session.token"},
    "gs": {"service_account_path": "fs.gs.auth.service.account.json.keyfile", "project_id": "fs.gs.project.id"},
    "http": {},
    "https": {},
    "file": {},
}


def register_parquet(spark: SparkSession, name: str, path: str, schema: StructType | str | None = None) -> DataFrame:
    """Make Parquet at *path* a temporary view; a given schema may leave columns out or widen their types."""
    reader = spark.read if schema is None else spark.read.schema(schema)
    df = reader.parquet(path)
    df.createOrReplaceTempView(name)
    return df


def register_object_store(spark: SparkSession, url: str, options: Mapping[str, str]) -> None:
    """Set the options of the store that *url* names; an option or scheme that isn't known is an error."""
    scheme = re.match(r"([a-z0-9]+)://", url)
    if not scheme or scheme[1].removesuffix("a") not in OPTIONS and scheme[1] not in OPTIONS:
        raise ValueError(f"no such kind of store: {url}")
    known = OPTIONS.get(scheme[1]) if scheme[1] in OPTIONS else OPTIONS[scheme[1].removesuffix("a")]
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    for key, value in options.items():
        name = known.get(key, key if key.startswith("fs.") else None)
        if name is None:
            raise ValueError(f"no such option of {scheme[1]}: {key}")
        conf.set(name, value)


@dataclass(frozen=True)
class Manifest:
    """A workload: tables by name, queries as SQL or as paths to SQL files, and the stores that they lie in."""

    name: str
    tables: Mapping[str, str]
    queries: Sequence[str]
    description: str = ""
    object_stores: Sequence[Mapping] = field(default_factory=tuple)
    folder: Path = Path(".")

    @classmethod
    def load(cls, path: str | Path) -> Manifest:
        path = Path(path)
        raw = json.loads(path.read_text())
        if missing := {"name", "tables", "queries"} - raw.keys():
            raise ValueError(f"{path}: no {', '.join(sorted(missing))}")
        return cls(raw["name"], raw["tables"], raw["queries"], raw.get("description", ""), raw.get("object_stores", ()), path.parent)

    def register(self, spark: SparkSession) -> None:
        for store in self.object_stores:
            register_object_store(spark, store["url"], store.get("options", {}))
        for name, path in self.tables.items():
            register_parquet(spark, name, path if "://" in path or path.startswith("/") else str(self.folder / path))

    def statements(self) -> Iterator[tuple[str, list[str]]]:
        """(id, statements) of each query: the number in ``q<number>.sql``, or its place among the queries."""
        for i, q in enumerate(self.queries):
            m = re.search(r"q(\d+)\.sql$", q)
            text = (self.folder / q).read_text() if q.endswith(".sql") else q
            yield (m[1] if m else str(i)), split_statements(text)

    def run(self, spark: SparkSession) -> Iterator[tuple[str, DataFrame]]:
        """(id, result): of a query of several statements, the last that returns columns."""
        for key, statements in self.statements():
            result = None
            for s in statements:
                df = spark.sql(s)
                result = df if df.columns else result
            if result is not None:
                yield key, result


def split_statements(text: str) -> list[str]:
    """Statements between semicolons that aren't in quotes or comments."""
    token = re.compile(r"'(?:[^']|'')*'|\"(?:[^\"]|\"\")*\"|`[^`]*`|--[^\n]*|/\*.*?\*/|;|[^'\"`;\-/]+|.", re.S)
    out, now = [], []
    for m in token.findall(text):
        if m == ";":
            out.append("".join(now))
            now = []
        elif not m.startswith(("--", "/*")):
            now.append(m)
    out.append("".join(now))
    return [s.strip() for s in out if s.strip()]


def csv_to_parquet(spark: SparkSession, source: str, target: str, schema: StructType | str, header: bool = False) -> None:
    """Convert CSV with doubled quotes and empty strings as nulls; rows must fit *schema*."""
    spark.read.schema(schema).csv(source, header=header, quote='"', escape='"', nullValue="", multiLine=True, mode="FAILFAST").write.mode("overwrite").parquet(target)


def save_result(df: DataFrame, path: str) -> None:
    """A query's result as Snappy Parquet."""
    df.write.mode("overwrite").option("compression", "snappy").parquet(path)


def prefetch(df: DataFrame, columns: Sequence[str] = ()) -> DataFrame:
    """Read the columns (all by default) into the cache and return the cached frame."""
    out = (df.select(*columns) if columns else df).persist()
    out.count()
    return out
