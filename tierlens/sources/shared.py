"""Intermediate tables in the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame

_LOCAL: dict[str, str] = {}


def stored(df: DataFrame, purpose: str) -> DataFrame:
    """*df* written as Parquet under ``spark.checkpoint.dir`` and read again.

    Where the setting is absent, a temporary folder serves local masters; a
    cluster without it is an error.
    """
    spark = df.sparkSession
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = _LOCAL.get("dir") or _LOCAL.setdefault("dir", tempfile.mkdtemp(prefix="tierlens-"))
    path = f"{base.rstrip('/')}/{purpose}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
