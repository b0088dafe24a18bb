"""Mixing sources to target weights by hash thresholds.

Every document has a 48-bit hash of its id.  For each source and budget there
is a threshold: the documents with a smaller hash are the sample.  Thresholds
come from histograms of tokens by source and hash bucket: 4096 buckets over
all documents, then again within the bucket in which the budget ends, until
the hash is used up.  Budgets nest, as do their samples.  No step sorts
documents or puts a source in one task: partial sums leave at most 4096 rows of
a source and budget.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import fresh, stored

BITS, LEVELS = 12, 4
#: Shares of the largest budget.
BUDGETS = (0.25, 0.5, 1.0)
#: Share of all tokens that the pipeline's sample holds at least, however short the shortest source.
FILL = 0.75
#: Weight of a source without given weights: the power of its tokens.
ALPHA = 0.5
BROADCAST_SOURCES = 100_000
TOKEN = r"[^ \t\n\r]+"


def token_count(text: Column) -> Column:
    """Runs of other characters than space, tab and line ends; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(TOKEN)), F.lit(0)).cast("long")


def hash48(doc_id: Column) -> Column:
    """The first 48 bits of the MD5 of the id's decimal digits ("" for null)."""
    return F.conv(F.substring(F.md5(F.coalesce(doc_id.cast("string"), F.lit(""))), 1, 12), 16, 10).cast("long")


def _source(source: Column) -> Column:
    return F.coalesce(source.cast("string"), F.lit("\u0000"))


def targets(rows: DataFrame, budgets: Sequence[float] = BUDGETS, weights: Mapping[str, float] | None = None, fill: float | None = None) -> DataFrame:
    """(source, share, budget): tokens to take of each source, from rows of (source, tokens); see :func:`mix` for *fill*."""
    total = rows.groupBy("source").agg(F.sum("tokens").alias("have"))
    weight = F.floor(F.pow("have", F.lit(ALPHA))).cast("double")
    if weights is not None:
        given = F.create_map(*[x for k, v in weights.items() for x in (F.lit(k), F.lit(float(v)))]) if weights else F.lit(None).cast("map<string,double>")
        weight = F.coalesce(F.try_element_at(given, F.col("source")), F.lit(0.0))
    total = total.withColumn("w", weight)
    if fill is not None:
        return _filled(total, budgets, fill)
    unit = total.where("w > 0").agg(F.min(F.col("have") / F.col("w")).alias("unit"))
    share = F.explode(F.array(*[F.lit(float(b)) for b in budgets]))
    return total.crossJoin(F.broadcast(unit)).withColumn("share", share).select("source", "share", F.floor(F.coalesce(F.col("share") * F.col("unit") * F.col("w"), F.lit(0.0))).cast("long").alias("budget"))


def _filled(total: DataFrame, budgets: Sequence[float], fill: float) -> DataFrame:
    """The budgets from (source, have, w), short sources giving all they have and the others the rest by weight."""
    ratio = F.col("have") / F.col("w")
    by = W.orderBy("ratio", "source")
    before = by.rowsBetween(W.unboundedPreceding, -1)
    short = total.where("w > 0 and have > 0").withColumn("ratio", ratio)
    # Of sources from the shortest on: what the shorter ones have, the weights from here on, and what all give at this one's ratio.
    steps = short.select("source", "ratio", F.coalesce(F.sum("have").over(before), F.lit(0)).alias("gone"), F.sum("w").over(W.orderBy(F.desc("ratio"), F.desc("source"))).alias("rest"))
    steps = steps.withColumn("cap", F.col("gone") + F.col("ratio") * F.col("rest"))
    size = short.agg(F.greatest(F.min("ratio") * F.sum("w"), F.sum("have") * F.lit(float(fill))).alias("size"), F.sum("have").alias("all"))
    share = F.explode(F.array(*[F.lit(float(b)) for b in budgets]))
    size = size.withColumn("share", share).withColumn("size", F.least(F.col("share") * F.col("size"), F.col("all").cast("double")))
    first = steps.crossJoin(F.broadcast(size)).where("cap >= size").groupBy("share").agg(F.min_by(F.least((F.col("size") - F.col("gone")) / F.col("rest"), F.col("ratio")), F.struct("ratio", "source")).alias("level"))
    # Rounding may leave the last cap under the size of all tokens: without a level all is taken.
    level = size.select("share").join(first, "share", "left")
    budget = F.when((F.col("w") > 0) & (F.col("level").isNull() | (ratio <= F.col("level"))), F.col("have")).when(F.col("w") > 0, F.floor(F.col("level") * F.col("w"))).otherwise(0)
    return total.crossJoin(F.broadcast(level)).select("source", "share", budget.cast("long").alias("budget"))


def thresholds(rows: DataFrame, wanted: DataFrame) -> DataFrame:
    """(source, share, threshold): documents of the source with a hash under it fit the budget, those of the next hash wouldn't; 2**48 if all fit."""
    state = wanted.select("source", "share", F.col("budget").alias("left"), F.lit(0).cast("long").alias("prefix"))
    parts = []
    for level in range(LEVELS):
        shift = BITS * (LEVELS - 1 - level)
        if level == 0:
            hist = rows.groupBy("source", F.shiftright("h", shift).alias("bucket")).agg(F.sum("tokens").alias("n"))
            held = hist.join(state, "source")
        else:
            inside = rows.withColumn("prefix", F.shiftright("h", shift + BITS)).join(state.select("source", "prefix").distinct(), ["source", "prefix"], "left_semi")
            hist = inside.groupBy("source", "prefix", F.shiftright("h", shift).alias("bucket")).agg(F.sum("tokens").alias("n"))
            held = hist.join(state, ["source", "prefix"])
        upto = F.sum("n").over(W.partitionBy("source", "share").orderBy("bucket"))
        over = held.withColumn("upto", upto).where("upto > left")
        # The first bucket over the budget, and what is left when it begins.
        edge = over.groupBy("source", "share").agg(F.min_by(F.struct("bucket", (F.col("left") - F.col("upto") + F.col("n")).alias("rest")), "bucket").alias("e"))
        state = stored(edge.select("source", "share", F.col("e.rest").alias("left"), F.col("e.bucket").alias("prefix")), f"mixing-{level}")
        parts.append(state)
    found = parts[-1].select("source", "share", F.col("prefix").alias("threshold"))
    return wanted.select("source", "share").join(found, ["source", "share"], "left").select("source", "share", F.coalesce("threshold", F.lit(1 << BITS * LEVELS)).alias("threshold"))


def mix(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", budgets: Sequence[float] = BUDGETS, weights: Mapping[str, float] | None = None, fill: float | None = None) -> DataFrame:
    """The sampled rows of *docs* with ``tokens`` and ``tier``, the smallest budget whose sample holds the document.

    Target weights are *weights* by source (those not named get 0), or else the
    square root of each source's tokens.  The largest budget is the one at
    which the first source is used up.  With *fill* it is this share of all
    tokens of sources with weight, if that is more: sources too short for their
    weight give all they have, and the others make up for it by weight; the
    smaller budgets are shares of it, filled likewise.  A null source is a source of its own;
    a null text has no tokens; rows that repeat an id stand or fall together,
    also where their tokens alone pass the budget.  Names that clash with a
    column of *docs* get underscores appended.
    """
    tokens, tier = fresh(docs, "tokens"), fresh(docs, "tier")
    rows = stored(docs.select(_source(F.col(source)).alias("source"), token_count(F.col(text)).alias("tokens"), hash48(F.col(doc_id)).alias("h")), "mixing-rows")
    cut = thresholds(rows, stored(targets(rows, budgets, weights, fill), "mixing-targets"))
    cut = stored(cut.groupBy("source").agg(F.sort_array(F.collect_list(F.struct("share", "threshold"))).alias("cuts")), "mixing-cuts")
    s, h, cuts = fresh(docs, "mix_source"), fresh(docs, "mix_hash"), fresh(docs, "mix_cuts")
    cut = cut.select(F.col("source").alias(s), F.col("cuts").alias(cuts))
    if cut.limit(BROADCAST_SOURCES + 1).count() <= BROADCAST_SOURCES:
        cut = F.broadcast(cut)
    joined = docs.withColumns({s: _source(F.col(source)), h: hash48(F.col(doc_id))}).join(cut, s)
    first = F.get(F.filter(F.col(cuts), lambda x: F.col(h) < x["threshold"]), F.lit(0))["share"]
    return joined.withColumn(tier, first).where(F.col(tier).isNotNull()).drop(s, h, cuts).withColumn(tokens, token_count(F.col(text)))


def sample(docs: DataFrame, **params) -> DataFrame:
    """The rows of :func:`mix` with the columns of *docs* only."""
    return mix(docs, **params).select(*[F.col(f"`{c}`") for c in docs.columns])


ORACLE = r"""
with t as (
  select doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^ \t\n\r]+')) as tokens,
         ('0x' || substr(md5(coalesce(doc_id::varchar, '')), 1, 12))::bigint as h from documents),
g as (select source, sum(tokens) as have, floor(sqrt(sum(tokens))) as w from t group by source),
u as (select min(have::double / w) as unit from g where w > 0),
c as (select t.*, sum(tokens) over (partition by source order by h range between unbounded preceding and current row) as upto from t),
m as (select c.doc_id, c.source, c.tokens, case
    when upto <= coalesce(floor(0.25::double * unit * w), 0) then 0.25::double
    when upto <= coalesce(floor(0.5::double * unit * w), 0) then 0.5::double
    when upto <= coalesce(floor(1.0::double * unit * w), 0) then 1.0::double end as tier
  from c join g on c.source is not distinct from g.source cross join u)
select doc_id, source, tokens::bigint as tokens, tier from m where tier is not null
"""
