"""``NOT IN`` over a subquery as an equi-join."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def not_in(left: DataFrame, key: str, values: DataFrame, name: str) -> DataFrame:
    """*left* with the column *name*: ``key not in (values)``, true, false or null as in SQL; *values* has one column.

    True if there are no values at all; null if the key is null, or isn't found
    among values of which some are null.  Each key meets at most one of the
    distinct values, by a shuffle or, if these are few, a broadcast.  Where the
    predicate stands under ``or``, Spark itself compares all pairs in a nested
    loop and broadcasts every value.
    """
    found = values.toDF("__value").distinct()
    # No values: null; else whether a null is among them. Counts and an equality of nulls leave the distinct
    # values as they are, so that the join and this subquery share one shuffle and the values are read once.
    rows = F.count(F.lit(1))
    holes = found.select(F.when(rows > 0, rows > F.count("__value"))).scalar()
    k, v = F.col(key), F.col("__value")
    answer = F.when(holes.isNull(), True).when(k.isNull(), None).when(v.isNotNull(), False).when(holes, None).otherwise(True)
    return left.join(found, k.eqNullSafe(v), "left").withColumn(name, answer).drop("__value")
