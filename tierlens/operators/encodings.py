"""Column encodings and squeezed forms as DataFrame transformations.

A column is cut into batches by a key, never by physical order.  Per-batch
facts (reference value, bit width) are one aggregation that is joined back, so
a batch isn't confined to a task as a window would have it; what they give is
exact, and every predicate on a squeezed form either decides a row or says that
it needs the base value.
"""

from __future__ import annotations

from decimal import ROUND_FLOOR, Decimal

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import dates, strings
from ..sources import shared

BATCH_ROWS = 8192


def batched(df: DataFrame, key: str, rows: int = BATCH_ROWS) -> DataFrame:
    """*df* with ``batch`` and ``pos`` from an integer key that starts at 0 and has no gaps."""
    return df.withColumns({"batch": F.expr(f"{key} div {rows}"), "pos": F.pmod(F.col(key), F.lit(rows))})


def bit_width(value: Column) -> Column:
    """Bits that the non-negative *value* takes, 1 for 0."""
    return F.length(F.bin(value)).cast("bigint")


def frame_of_reference(df: DataFrame, value: str) -> DataFrame:
    """Adds ``ref`` (the batch's least value), ``off`` (value - ref) and ``width`` (bits of the largest offset); nulls stay null.

    A batch whose range doesn't fit 63 bits stays as it is: ref 0, off the value, width 64.
    """
    facts = df.groupBy("batch").agg(F.min(value).alias("low"), F.max(value).alias("top"))
    wide = F.col("top").cast("decimal(20,0)") - F.col("low").cast("decimal(20,0)") > F.lit(2**63 - 1)
    ref, width = F.when(wide, 0).otherwise(F.col("low")), F.when(wide, 64).otherwise(bit_width(F.when(~wide, F.col("top") - F.col("low"))))
    facts = facts.select("batch", ref.cast("bigint").alias("ref"), width.cast("bigint").alias("width"))
    return df.join(facts, "batch").withColumn("off", F.col(value) - F.col("ref"))


def delta(df: DataFrame, value: str) -> DataFrame:
    """Adds ``delta``: the difference from the batch's last value before that isn't null, the value itself for its first; nulls stay null."""
    before = F.last(value, ignorenulls=True).over(W.partitionBy("batch").orderBy("pos").rowsBetween(W.unboundedPreceding, -1))
    return df.withColumn("delta", F.col(value) - F.coalesce(before, F.lit(0)))


def undelta(df: DataFrame) -> DataFrame:
    """Adds ``value``: the running sum of the deltas, null where the delta is."""
    total = F.sum("delta").over(W.partitionBy("batch").orderBy("pos").rowsBetween(W.unboundedPreceding, 0))
    return df.withColumn("value", F.when(F.col("delta").isNotNull(), total))


def linear_model(df: DataFrame, value: str) -> DataFrame:
    """(batch, intercept, slope, n, low, high, width): the line of least largest error through each batch's values by position.

    ``value = intercept + rint(slope * pos) + residual`` holds exactly for
    residuals between low and high.  The slope is found by bisection on the
    convex largest error.  Nulls are left out; a batch of nulls gives no row.
    """

    def fit(part: pd.DataFrame) -> pd.DataFrame:
        part = part.dropna().sort_values("pos")
        if not len(part):
            return pd.DataFrame({"batch": [], "intercept": [], "slope": [], "n": [], "low": [], "high": [], "width": []})
        x, y = part["pos"].to_numpy(float), part[value].to_numpy(np.int64)

        def spread(slope: float) -> tuple[float, float]:
            r = y - slope * x
            top, bottom = r.argmax(), r.argmin()
            return r[top] - r[bottom], x[top] - x[bottom]

        span = max(x[-1] - x[0], 1.0)
        bound = float(np.abs(np.diff(y)).max()) if len(y) > 1 else 0.0
        low, high = -bound, bound
        for _ in range(64):
            middle = (low + high) / 2
            _, lean = spread(middle)  # the error falls with the slope while its top lies right of its bottom
            low, high = (middle, high) if lean > 0 else (low, middle)
            if (high - low) * span < 1e-3:
                break
        slope = (low + high) / 2
        r = y - np.rint(slope * x).astype(np.int64)
        intercept = int(r.min() + (int(r.max()) - int(r.min())) // 2)
        r = r - intercept
        width = max(1, int(r.max() - r.min()).bit_length())
        return pd.DataFrame({"batch": [part["batch"].iloc[0]], "intercept": [intercept], "slope": [slope], "n": [len(y)], "low": [r.min()], "high": [r.max()], "width": [width]})

    return df.select("batch", "pos", value).groupBy("batch").applyInPandas(fit, "batch bigint, intercept bigint, slope double, n bigint, low bigint, high bigint, width bigint")


def dictionary(df: DataFrame, value: str) -> DataFrame:
    """Adds ``code``, the value's number among the distinct values in byte order from 0, its 7-byte ``prefix`` in hex, and ``size`` (its bytes, 255 for that many or more).

    The dictionary is built from the distinct values, which are numbered range by range.
    """
    distinct = shared.stored(df.where(F.col(value).isNotNull()).select(value).distinct().repartitionByRange(value).withColumn("part", F.spark_partition_id()), "dictionary")
    # Numbered within the ranges, each from where the ranges before it end: no task sees all values.
    sizes = distinct.groupBy("part").agg(F.count(F.lit(1)).alias("n"))
    before = sizes.select("part", (F.sum("n").over(W.orderBy("part")) - F.col("n")).alias("start"))
    place = F.row_number().over(W.partitionBy("part").orderBy(value)) - 1
    codes = distinct.withColumn("place", place).join(F.broadcast(before), "part").select(value, (F.col("start") + F.col("place")).cast("bigint").alias("code"))
    out = df.join(codes, value, "left")
    return out.withColumns({"prefix": strings.prefix(F.col(value)), "size": F.least(F.octet_length(value), F.lit(255)).cast("bigint")})


def clamp(df: DataFrame) -> DataFrame:
    """Adds ``sentinel`` and ``clamped``: offsets that don't fit half the width become the sentinel; batches narrower than 8 bits or not encoded keep theirs (null sentinel)."""
    sentinel = F.when(F.col("width").between(8, 63), F.expr("shiftleft(1L, cast(greatest(width div 2, 1) as int)) - 1"))
    return df.withColumn("sentinel", sentinel).withColumn("clamped", F.when(F.col("sentinel").isNull() | F.col("off").isNull(), F.col("off")).otherwise(F.least("off", "sentinel")))


def quantize(df: DataFrame) -> DataFrame:
    """Adds ``step`` and ``bucket``: offsets in 2**half equal steps, the last one open; batches not encoded keep steps of 1."""
    facts = df.groupBy("batch").agg(F.max("off").alias("top_off"))
    out = df.join(facts, "batch").withColumn("buckets", F.expr("shiftleft(1L, cast(greatest(width div 2, 1) as int))"))
    out = out.withColumn("step", F.expr("case when width = 64 then 1 else (top_off div buckets) + 1 end"))
    bucket = F.when(F.col("width") == 64, F.col("off")).when(F.col("off").isNotNull(), F.least(F.expr("off div step"), F.col("buckets") - 1))
    return out.withColumn("bucket", bucket).drop("top_off", "buckets")


def alp_integer(value: Column, places: int) -> Column:
    """The integer that a float is at *places* decimals, null (an exception, kept as it is) if it isn't exactly that."""
    scaled = F.round(value * 10**places).try_cast("bigint")
    return F.when(scaled.cast("double") / 10**places == value, scaled)


def alp_places(df: DataFrame, value: str, most: int = 10) -> int:
    """The fewest decimals at which the fewest values of a column are exceptions."""
    missed = [F.count(F.when(F.col(value).isNotNull() & alp_integer(F.try_divide(F.col(value), F.lit(1.0)), p).isNull(), 1)) for p in range(most + 1)]
    found = df.agg(*missed).first()
    return min(range(most + 1), key=lambda p: (found[p], p))


def decimal_integer(value: Column, scale: int) -> Column:
    """The unscaled integer of a decimal column; null, an exception, beyond 64 bits."""
    return F.try_multiply(value, F.lit(10**scale).cast("decimal(19,0)")).try_cast("bigint")


COMPARE = {
    "=": lambda a, b: a == b,
    "<>": lambda a, b: a != b,
    "<": lambda a, b: a < b,
    "<=": lambda a, b: a <= b,
    ">": lambda a, b: a > b,
    ">=": lambda a, b: a >= b,
}


def decide_clamped(op: str, k: int) -> Column:
    """true, false, or null where only the base value can tell: ``value op k`` on (ref, clamped, sentinel)."""
    value = F.col("ref") + F.col("clamped")
    limit = F.try_add(F.col("ref"), F.col("sentinel"))  # a clamped value is this or more
    cut = F.col("sentinel").isNotNull() & (F.col("clamped") == F.col("sentinel"))
    sure = F.lit(k) <= limit if op in ("<", ">=") else F.lit(k) < limit
    return F.when(cut, F.when(sure, F.lit(op in ("<>", ">", ">=")))).otherwise(COMPARE[op](value, F.lit(k)))


def decide_quantized(op: str, k: int) -> Column:
    """As :func:`decide_clamped`, on (ref, bucket, step): a bucket decides if all that it may hold agree."""
    low = F.col("ref") + F.col("bucket") * F.col("step")
    high = F.try_add(low, F.col("step") - 1)  # null beyond 64 bits, which decides nothing
    k = F.lit(k)
    outside = (k < low) | (k > high)
    one = (low == high) & (k == low)
    return {
        "=": F.when(outside, False).when(one, True),
        "<>": F.when(outside, True).when(one, False),
        "<": F.when(high < k, True).when(low >= k, False),
        "<=": F.when(high <= k, True).when(low > k, False),
        ">": F.when(low > k, True).when(high <= k, False),
        ">=": F.when(low >= k, True).when(high < k, False),
    }[op]


def scaled_comparison(op: str, k: float | Decimal, places: int) -> tuple[str, int] | bool:
    """The comparison of value * 10**places, an integer, that is ``value op k``; or what it always is."""
    exact = Decimal(str(k)) * 10**places
    whole = int(exact.to_integral_value(ROUND_FLOOR))
    if exact == whole:
        return op, whole
    if op in ("=", "<>"):
        return op == "<>"
    return ("<=", whole) if op in ("<", "<=") else (">", whole)


def decide_scaled(op: str, k: float | Decimal, places: int) -> Column:
    """As :func:`decide_quantized` for floats and decimals whose integers at *places* decimals are quantised; exceptions need the base value."""
    found = scaled_comparison(op, k, places)
    if isinstance(found, bool):
        return F.when(F.col("bucket").isNotNull(), F.lit(found))
    return decide_quantized(*found)


def filter_squeezed(squeezed: DataFrame, base: DataFrame, key: str, value: str, op: str, k: int, decide=decide_quantized) -> DataFrame:
    """(key, decided) of the rows with ``value op k``: base values are read for the undecided rows only."""
    judged = squeezed.select(key, decide(op, k).alias("verdict"))
    sure = judged.where("verdict").select(key, F.lit(True).alias("decided"))
    open_ = judged.where("verdict is null").select(key)
    found = base.select(key, value).where(COMPARE[op](F.col(value), F.lit(k))).join(open_, key, "left_semi").select(key, F.lit(False).alias("decided"))
    return sure.unionByName(found)


def date_squeeze(df: DataFrame, value: str, units: tuple[str, ...] = dates.PARTS) -> DataFrame:
    """Adds one small column for each date part that is kept."""
    return df.withColumns({u.lower(): dates.part(u, F.col(value)).cast("bigint") for u in units})


def run_lengths(df: DataFrame, value: str) -> DataFrame:
    """(batch, run, value, n): runs of equal neighbours."""
    w = W.partitionBy("batch").orderBy("pos")
    new = (~F.col(value).eqNullSafe(F.lag(value).over(w)) | (F.row_number().over(w) == 1)).cast("int")
    return df.withColumn("run", F.sum(new).over(w)).groupBy("batch", "run").agg(F.first(value).alias(value), F.count(F.lit(1)).alias("n"))


def substring_candidates(df: DataFrame, value: str, needle: str) -> DataFrame:
    """Adds ``candidate`` (by fingerprint) and ``match`` (verified) for a substring search."""
    out = df.withColumn("print", strings.fingerprint(F.col(value)))
    candidate = strings.may_contain(F.col("print"), needle)
    return out.withColumns({"candidate": candidate, "match": candidate & F.col(value).contains(needle)})
