"""LM scoring by context-tree weighting over bytes, trained on the whole corpus.

A byte is eight binary decisions, one at each node of a binary tree over its
bits.  Each of the 255 nodes has its own context tree over the preceding bytes,
down to ``depth``; a context's decisions are coded by the Krichevsky-Trofimov
estimate, and every context weighs "stop here" against "look one byte further
back" by half each (Willems, Shtarkov and Tjalkens).  All counts of all depths
follow from the counts of (depth + 1)-grams, so the corpus is read once for
these, combined within each task before the shuffle.  Grams that share their
last two context bytes hold the whole of the trees from there on, which one
task computes; of the two depths above there are at most 65,280 and 255
contexts, which are aggregated and sent to all.  The result is the code length
of every gram of the corpus, from which documents are scored without a shuffle.

With six bytes of context the grams grow with the corpus.  Up to
``mapped_grams`` their code lengths (16 bytes each) are a sorted table that
Spark's file distribution brings to every executor, whose workers map it into
memory together; beyond that documents are joined to them.  The driver never
holds any.
"""

from __future__ import annotations

import fcntl
import math
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import by_bytes, flat, fresh, slices, stored

#: Bytes of context, the most that a gram's code holds.
DEPTH = 6
#: Code lengths that an executor's disk and page cache hold: 16 GB.
MAPPED_GRAMS = 1_000_000_000


def grams(texts: pa.Array, depth: int = DEPTH) -> tuple[np.ndarray, np.ndarray]:
    """(code of each byte with its context, offsets); before a text's first byte are zero bytes."""
    raw, at = flat(texts)
    code = raw.astype(np.uint32 if depth <= 3 else np.uint64)
    kind = code.dtype.type
    for d in range(1, depth + 1):
        code[d:] |= raw[:-d].astype(code.dtype) << kind(8 * d)
    size = np.diff(at)
    for p in range(depth):  # the context of a text's first bytes is cut
        first = at[:-1][size > p] + p
        code[first] &= kind((1 << 8 * (p + 1)) - 1)
    return code, at


def _count(depth: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes, counts, held = [], [], 0

        def merged() -> tuple[np.ndarray, np.ndarray]:
            code, n = np.concatenate(codes), np.concatenate(counts)
            order = np.argsort(code, kind="stable")
            code, n = code[order], n[order]
            first = np.flatnonzero(np.concatenate([[True], code[1:] != code[:-1]]))
            return code[first], np.add.reduceat(n, first)

        for batch in batches:
            for part in slices(batch.column(0)):
                code, n = np.unique(grams(part, depth)[0], return_counts=True)
                codes.append(code)
                counts.append(n.astype(np.int64))
                held += len(code)
                if held > 4_000_000:
                    code, n = merged()
                    codes, counts, held = [code], [n], len(code)
                    if held > 3_000_000:
                        yield pa.RecordBatch.from_arrays([pa.array(code.astype(np.int64)), pa.array(n)], names=["code", "n"])
                        codes, counts, held = [], [], 0
        if held:
            code, n = merged()
            yield pa.RecordBatch.from_arrays([pa.array(code.astype(np.int64)), pa.array(n)], names=["code", "n"])

    return run


def gram_counts(docs: DataFrame, text: str = "text", depth: int = DEPTH) -> DataFrame:
    """(code, n) over all documents."""
    return docs.select(text).mapInArrow(_count(depth), "code bigint, n bigint").groupBy("code").agg(F.sum("n").alias("n"))


def _lgamma(x: np.ndarray) -> np.ndarray:
    """Logarithm of the gamma function for x >= 0.5: Stirling's series eight further up."""
    z = x + 8
    low = np.multiply.reduce([x + k for k in range(8)])
    return (z - 0.5) * np.log(z) - z + 0.5 * math.log(2 * math.pi) + 1 / (12 * z) - 1 / (360 * z**3) + 1 / (1260 * z**5) - 1 / (1680 * z**7) - np.log(low)


def kt(n0: np.ndarray, n1: np.ndarray) -> np.ndarray:
    """Log probability of any one order of n0 zeros and n1 ones under the Krichevsky-Trofimov estimate."""
    return _lgamma(n0 + 0.5) + _lgamma(n1 + 0.5) - _lgamma(n0 + n1 + 1.0) - math.log(math.pi)


def weigh(n0: np.ndarray, n1: np.ndarray, deeper: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(log weighted probability, posterior weight of stopping, chance of a one) of contexts, given the sum of their deeper ones' log weighted probabilities."""
    own = kt(n0, n1)
    return np.logaddexp(own, deeper) - math.log(2), 1 / (1 + np.exp(np.minimum(deeper - own, 700))), (n1 + 0.5) / (n0 + n1 + 1)


def _steps(code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(tree node, bit) of the eight decisions of each gram's last byte [8, grams]."""
    byte = code & 255
    j = np.arange(8)[:, None]
    return (1 << j) | (byte >> (8 - j)), (byte >> (7 - j)) & 1


def _deep(code: np.ndarray, n: np.ndarray, depth: int) -> tuple[np.ndarray, ...]:
    """(chances of a one [8, grams] below depth two, and of the contexts of depth two: context and node, zeros, ones, log weighted probability), of whole groups."""
    node, bit = _steps(code)
    keys, at = np.unique((((code >> 8) << 8)[None, :] | node).ravel(), return_inverse=True)
    weight = np.broadcast_to(n, node.shape).ravel().astype(float)
    ones = np.bincount(at, weight * bit.ravel(), len(keys))
    zeros = np.bincount(at, weight, len(keys)) - ones
    chance = ((ones + 0.5) / (zeros + ones + 1))[at]
    pw = kt(zeros, ones)
    for d in range(depth - 1, 1, -1):
        keys, up = np.unique(keys & ((1 << 8 * (d + 1)) - 1), return_inverse=True)
        zeros, ones, deeper = (np.bincount(up, x, len(keys)) for x in (zeros, ones, pw))
        pw, stop, q = weigh(zeros, ones, deeper)
        at = up[at]
        chance = stop[at] * q[at] + (1 - stop[at]) * chance
    return chance.reshape(8, -1), keys, zeros, ones, pw


def _groups(batches: Iterator[pa.RecordBatch], most: int = 200_000) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(code, n) of whole groups of the same two last context bytes, some at a time, from rows sorted by group."""
    held: list[np.ndarray] = []
    for batch in batches:
        held.append(np.stack([batch.column(1).to_numpy(), batch.column(2).to_numpy()]))
        if sum(x.shape[1] for x in held) >= most:
            rows = np.concatenate(held, 1)
            group = (rows[0] >> 8) & 0xFFFF
            cut = int(np.flatnonzero(group != group[-1])[-1]) + 1 if (group != group[-1]).any() else 0
            if cut:
                yield rows[0, :cut], rows[1, :cut]
            held = [rows[:, cut:]]
    if held and sum(x.shape[1] for x in held):
        rows = np.concatenate(held, 1)
        yield rows[0], rows[1]


def code_lengths(counts: DataFrame, depth: int = DEPTH) -> DataFrame:
    """(code, bits): code length of a gram's last byte after the others, given the stored counts of all grams.

    At a node on the path the chance of a one is ``w * (n1 + 1/2) / (n + 1) +
    (1 - w) * that of the next deeper context``, w being the posterior weight
    of stopping; at full depth it is the estimate itself.  The deep trees are
    computed twice, once for the contexts above them and once for the result:
    that takes less than to store eight chances a gram.  Rows come by group,
    then code, each group in one partition.
    """
    if not 2 <= depth <= 6:
        raise ValueError("the depth must be from 2 to 6")

    def above(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for code, n in _groups(batches):
            _, keys, zeros, ones, pw = _deep(code, n, depth)
            columns = ((keys >> 8) & 255).astype(np.int32), (keys & 255).astype(np.int32), zeros.astype(np.int64), ones.astype(np.int64), pw
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in columns], names=["ctx", "node", "n0", "n1", "pw"])

    group = F.shiftright("code", 8).bitwiseAND(0xFFFF)
    rows = counts.select(group.alias("group"), "code", "n").repartition("group").sortWithinPartitions("group", "code")
    one = rows.mapInArrow(above, "ctx int, node int, n0 bigint, n1 bigint, pw double").groupBy("ctx", "node").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"), F.sum("pw").alias("deeper")).orderBy("ctx", "node").toPandas()
    stop, chance = np.zeros((2, 256, 256)), np.zeros((2, 256, 256))
    if len(one):
        c, node, n0, n1 = one["ctx"].to_numpy(np.int64), one["node"].to_numpy(np.int64), one["n0"].to_numpy(float), one["n1"].to_numpy(float)
        pw, stop[1, c, node], chance[1, c, node] = weigh(n0, n1, one["deeper"].to_numpy())
        zero, up = np.unique(node, return_inverse=True)
        _, w, q = weigh(np.bincount(up, n0), np.bincount(up, n1), np.bincount(up, pw))
        stop[0][:, zero], chance[0][:, zero] = w, q

    top = counts.sparkSession.sparkContext.broadcast((stop, chance))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stop, chance = top.value
        for code, n in _groups(batches):
            p = _deep(code, n, depth)[0]
            node, bit = _steps(code)
            for d in (1, 0):
                at = ((code >> 8) & 255)[None, :], node
                p = stop[d][at] * chance[d][at] + (1 - stop[d][at]) * p
            bits = -np.log2(np.where(bit == 1, p, 1 - p)).sum(0)
            yield pa.RecordBatch.from_arrays([pa.array(code), pa.array(bits)], names=["code", "bits"])

    return rows.mapInArrow(run, "code bigint, bits double")


def _key(code: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """A gram's place in the mapped table: by its group's rank, then by its code."""
    return rank[(code >> 8) & 0xFFFF] << 40 | (code >> 24) << 8 | code & 255


def _mapped(names: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(rank of each group, keys, bits) of the distributed Parquet files, each of which holds whole groups.

    The executor's first worker writes them out as arrays, all of its workers
    map these.  An executor that takes another's place gets the files anew.
    """
    base = SparkFiles.get(names[0])
    with open(base + ".lock", "w") as lock:
        fcntl.flock(lock, fcntl.LOCK_EX)  # released with the file, also if the worker dies
        if not os.path.exists(base + ".rank"):
            rank, next_ = np.zeros(1 << 16, np.int64), 0
            with open(base + ".keys", "wb") as keys, open(base + ".bits", "wb") as bits:
                for name in names:
                    last = -1
                    for batch in pq.ParquetFile(SparkFiles.get(name)).iter_batches():
                        code = batch.column(0).to_numpy()
                        group = (code >> 8) & 0xFFFF
                        new = group[np.flatnonzero(np.diff(group, prepend=last))]
                        rank[new] = np.arange(next_, next_ + len(new))
                        next_, last = next_ + len(new), int(group[-1])
                        keys.write(_key(code, rank).tobytes())
                        bits.write(batch.column(1).to_numpy().tobytes())
            rank.tofile(base + ".part")
            os.rename(base + ".part", base + ".rank")
            for name in names:
                os.truncate(SparkFiles.get(name), 0)
    return np.fromfile(base + ".rank", np.int64), np.memmap(base + ".keys", np.int64, "r"), np.memmap(base + ".bits", np.float64, "r")


def score(docs: DataFrame, text: str = "text", depth: int = DEPTH, mapped_grams: int = MAPPED_GRAMS) -> DataFrame:
    """*docs* with ``n_bytes``, ``code_bits`` and ``bits_per_byte`` under the trees of all of *docs*.

    A null text has nulls; an empty one no bytes, 0 bits and null per byte.
    Each document counts among those that the trees know, copies as often as
    they occur.  Names that clash get underscores appended.
    """
    names = [fresh(docs, c) for c in ("n_bytes", "code_bits", "bits_per_byte")]
    table = stored(code_lengths(stored(gram_counts(docs, text, depth), "ctw-grams"), depth), "ctw-bits")
    tmp = fresh(by_bytes(docs), "ctw")
    rows = table.count()
    if 0 < rows <= mapped_grams:
        files = table.inputFiles()
        for f in files:
            docs.sparkSession.sparkContext.addFile(f)
        parts = [f.rpartition("/")[2] for f in files]

        def run(texts: pa.Array) -> pa.Array:
            rank, keys, bits = _mapped(parts)
            sizes, sums = [], []
            for part in slices(texts):
                code, at = grams(part, depth)
                size = np.diff(at)
                total = np.zeros(len(part))
                if len(code):
                    there = size > 0
                    # Sorted grams are found several times faster: their search stays in the cache.
                    own, back = np.unique(_key(code.astype(np.int64), rank), return_inverse=True)
                    total[there] = np.add.reduceat(bits[np.searchsorted(keys, own)][back], at[:-1][there])
                sizes.append(size)
                sums.append(total)
            mask = ~np.array(texts.is_valid(), bool)
            n, b = (np.concatenate(x) if x else np.zeros(0) for x in (sizes, sums))
            return pa.StructArray.from_arrays([pa.array(n.astype(np.int64), mask=mask), pa.array(b.astype(float), mask=mask)], names=["n", "b"])

        out = docs.withColumn(tmp, F.arrow_udf(run, "struct<n:bigint,b:double>")(F.col(text)))
    else:
        out = _joined(docs, table, text, depth, tmp)
    n, b = F.col(tmp)["n"], F.col(tmp)["b"]
    return out.withColumns({names[0]: n, names[1]: b, names[2]: F.when(n > 0, b / n)}).drop(tmp)


def _joined(docs: DataFrame, table: DataFrame, text: str, depth: int, tmp: str) -> DataFrame:
    """The scores by a join of each distinct text's grams, known by the text's digest, with the code lengths."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, key in enumerate(batch.column(0).to_pylist()):
                code, n = np.unique(grams(batch.column(1).slice(i, 1), depth)[0], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array([key] * len(code), pa.string()), pa.array(code.astype(np.int64)), pa.array(n.astype(np.int64))], names=["key", "code", "n"])

    key = fresh(docs, "ctw_key")
    parts = docs.where(F.col(text).isNotNull()).select(F.md5(text).alias("key"), F.col(text).alias("text")).mapInArrow(run, "key string, code bigint, n bigint").groupBy("key", "code").agg(F.max("n").alias("n"))
    sums = parts.join(table, "code").groupBy("key").agg(F.struct(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("bits")).alias("b")).alias(tmp)).withColumnRenamed("key", key)
    empty = F.when(F.col(text) == "", F.struct(F.lit(0).cast("long").alias("n"), F.lit(0.0).alias("b")))
    return docs.withColumn(key, F.md5(text)).join(sums, key, "left").withColumn(tmp, F.coalesce(F.col(tmp), empty)).drop(key)


def oracle(depth: int = DEPTH) -> str:
    """DuckDB SQL for (doc_id, n_bytes, code_bits, bits_per_byte) of documents, bits rounded to three places and their mean to six."""
    kt_ = "lgamma(n0 + 0.5) + lgamma(n1 + 0.5) - lgamma(n0 + n1 + 1) - ln(pi())"

    def level(d: int) -> str:
        keys = ", ".join([*(f"c{k}" for k in range(1, d + 1)), "node"])
        return f"""
s{d} as (select {keys}, sum(n0) as n0, sum(n1) as n1, sum(pw) as deeper from l{d + 1} group by all),
l{d} as materialized (select *, greatest(own, deeper) + ln(exp(own - greatest(own, deeper)) + exp(deeper - greatest(own, deeper))) - ln(2) as pw,
  1 / (1 + exp(least(deeper - own, 700))) as w{d}, (n1 + 0.5) / (n0 + n1 + 1) as q{d} from (select *, {kt_} as own from s{d}) x),"""

    contexts = lambda d: ", ".join(f"c{k}" for k in range(1, d + 1))
    lags = ", ".join(f"coalesce(lag(c, {k}) over w, 0) as c{k}" for k in range(1, depth + 1))
    mixed = f"q{depth}"
    for d in reversed(range(depth)):
        mixed = f"(w{d} * q{d} + (1 - w{d}) * {mixed})"
    joins = " ".join(f"join l{d} using ({', '.join([*(f'c{k}' for k in range(1, d + 1)), 'node'])})" for d in reversed(range(depth)))
    return f"""
with texts as materialized (select row_number() over () as r, doc_id, text from documents),
bytes as (select r, unnest(l) as c, generate_subscripts(l, 1) as i from (
  select r, list_transform(regexp_extract_all(hex(encode(text)), '..'), lambda h: ('0x' || h)::int) as l from texts) x),
places as materialized (select r, c, {lags} from bytes window w as (partition by r order by i)),
grams as (select {contexts(depth)}, c, count(*)::double as n from places group by all),
steps as (select *, (1 << j) | (c >> (8 - j)) as node, (c >> (7 - j)) & 1 as bit from (select *, unnest(range(8))::int as j from grams) x),
s{depth} as (select {contexts(depth)}, node, sum(n * (1 - bit)) as n0, sum(n * bit) as n1 from steps group by all),
l{depth} as materialized (select *, {kt_} as pw, (n1 + 0.5) / (n0 + n1 + 1) as q{depth} from s{depth}),{"".join(level(d) for d in reversed(range(depth)))}
chances as (select {contexts(depth)}, node, {mixed} as p from l{depth} {joins}),
lengths as (select {contexts(depth)}, c, sum(-log2(case when bit = 1 then p else 1 - p end)) as bits from steps join chances using ({contexts(depth)}, node) group by all),
sums as (select r, sum(bits) as bits, count(*) as n from places join lengths using ({contexts(depth)}, c) group by r)
select doc_id, case when text is not null then coalesce(n, 0)::bigint end as n_bytes, case when text is not null then round(coalesce(bits, 0), 3) end as code_bits,
  round(bits / n, 6) as bits_per_byte from texts left join sums using (r)
"""
