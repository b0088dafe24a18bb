"""One SQL text for Spark and for the oracle, with the few words that differ as placeholders."""

from __future__ import annotations

import re
from dataclasses import dataclass
from string import Template

from pyspark.sql import DataFrame, SparkSession

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
_SPARK = {"ts": "timestamp_ntz", "div": "div", "str": "string", "quot": "`", "ntz": "timestamp_ntz"}
_DUCK = {"ts": "timestamp", "div": "//", "str": "varchar", "quot": '"', "ntz": "timestamp"}


def money(expr: str, places: int = 4) -> str:
    """An exact sum of doubles that have few decimals: the same in any order of rows."""
    return f"cast(sum(cast({expr} as decimal(18,{places}))) as double)"


def mean(expr: str, places: int = 4) -> str:
    """The mean by the exact sum, rounded to four places."""
    return f"round({money(expr, places)} / count({expr}), 4)"


def n(expr: str) -> str:
    return f"cast({expr} as bigint)"


@dataclass(frozen=True)
class SqlQuery:
    """A query over the tables of a folder; *spark* replaces the common text where the dialects differ in more than a word."""

    text: str
    spark: str | None = None

    def __call__(self, spark: SparkSession, sf_dir: str) -> DataFrame:
        sql = Template(self.spark or self.text).substitute(_SPARK)
        for name in TABLES:
            if re.search(rf"\b{name}\b", sql):
                spark.read.parquet(f"{sf_dir}/{name}.parquet").createOrReplaceTempView(name)
        return spark.sql(sql)

    @property
    def oracle(self) -> str:
        return Template(self.text).substitute(_DUCK)
