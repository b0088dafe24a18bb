"""Document fingerprints: a digest of byte-triplet bucket quartiles and a bounded difference score.

Every window of five bytes gives six triplets that contain its last byte; each
is hashed into one of 128 buckets.  The digest holds, per bucket, which
quartile its count falls into (2 bits), with the length on a log scale, the
ratios of the quartiles and a checksum.  Small edits move few counts across a
quartile, so like texts have a small difference.  The digest is a scalar Arrow
function: no shuffle, and the same work per byte at any size.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import by_bytes, flat, fresh, slices, stored

BUCKETS, MIN_BYTES, DIGEST_BYTES = 128, 50, 35
#: (salt, distances of the two further bytes from the window's last byte)
TRIPLETS = ((2, 1, 2), (3, 1, 3), (5, 2, 3), (7, 2, 4), (11, 1, 4), (13, 3, 4))

#: Digests in a block, whose pairs with another block's are compared in one call.
BLOCK = 1024
#: Two documents that differ by less are near each other.
NEAR = 100


def _permutation() -> np.ndarray:
    """A fixed permutation of the byte values, shuffled by a linear congruential generator."""
    p, x = list(range(256)), 20240229
    for i in range(255, 0, -1):
        x = (x * 6364136223846793005 + 1442695040888963407) % 2**64
        j = (x >> 33) % (i + 1)
        p[i], p[j] = p[j], p[i]
    return np.array(p, np.uint8)


T = _permutation()
_PAIRS = {salt: T[T[T[salt] ^ np.arange(256, dtype=np.uint8)][:, None] ^ np.arange(256, dtype=np.uint8)].ravel() for salt, _, _ in TRIPLETS}
_STEP = np.array([0, 1, 2, 6])
_BODY = sum(_STEP[np.abs(((np.arange(256)[:, None] >> s) & 3) - ((np.arange(256)[None, :] >> s) & 3))] for s in (0, 2, 4, 6)).astype(np.uint16)

_COST = _STEP[np.abs(np.arange(4)[:, None] - np.arange(4))].astype(np.float32)


def length_code(n: int) -> int:
    """Eight steps for each doubling of the length."""
    return int(8 * math.log2(n)) & 255


def digests(texts: pa.Array) -> pa.Array:
    """The 35-byte digest of each text as 70 hex digits.

    Null: null texts, those under 50 bytes, and those of so little variety that
    three quarters of the buckets are empty.
    """
    out: list[str | None] = []
    for part in slices(texts, 1 << 20):
        raw, at = flat(part)
        n = len(part)
        size = np.diff(at)
        counts = np.zeros((n, 256), np.int64)
        if len(raw) >= 5:
            owner = np.repeat(np.arange(n, dtype=np.int64), size)
            whole = owner[4:] == owner[:-4]
            base = (owner[4:] << 8)[whole]
            window = [raw[4 - d : len(raw) - d][whole] for d in range(5)]
            flat_counts = np.zeros(n * 256, np.int64)
            for salt, d1, d2 in TRIPLETS:
                pair = (window[0].astype(np.uint16) << 8) | window[d1]
                flat_counts += np.bincount(base + T[_PAIRS[salt][pair] ^ window[d2]], minlength=n * 256)
            counts = flat_counts.reshape(n, 256)
            sums = np.zeros(n, np.int64)
            np.add.at(sums, owner[4:][whole], T[window[0] ^ T[window[1]]].astype(np.int64))
        body = counts[:, :BUCKETS]
        ranked = np.sort(body, axis=1)
        q1, q2, q3 = (ranked[:, BUCKETS * k // 4 - 1] for k in (1, 2, 3))
        code = (body > q1[:, None]).astype(np.uint8) + (body > q2[:, None]) + (body > q3[:, None])
        packed = (code[:, 0::4] | (code[:, 1::4] << 2) | (code[:, 2::4] << 4) | (code[:, 3::4] << 6)).astype(np.uint8)
        for i in range(n):
            if size[i] < MIN_BYTES or q3[i] == 0:
                out.append(None)
                continue
            ratios = (int(q1[i] * 100 // q3[i]) % 16) << 4 | int(q2[i] * 100 // q3[i]) % 16
            out.append((bytes([int(sums[i]) & 255, length_code(int(size[i])), ratios]) + packed[i].tobytes()).hex())
    return pa.array(out, pa.string())


def _parsed(hexes: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(digest bytes [n, 35], which are there)."""
    there = np.array(hexes.is_valid())
    raw = bytes.fromhex("".join(hexes.drop_null().to_pylist()))
    out = np.zeros((len(hexes), DIGEST_BYTES), np.uint8)
    out[there] = np.frombuffer(raw, np.uint8).reshape(-1, DIGEST_BYTES)
    return out, there


def _header(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The part of the difference that checksum, length and quartile ratios give."""
    around = lambda x, y, m: np.minimum((x - y) % m, (y - x) % m)
    a, b = a.astype(np.int32), b.astype(np.int32)
    step = around(a[..., 1], b[..., 1], 256)
    total = (a[..., 0] != b[..., 0]) + np.where(step <= 1, step, step * 12)
    for shift in (4, 0):
        d = around((a[..., 2] >> shift) & 15, (b[..., 2] >> shift) & 15, 16)
        total = total + np.where(d <= 1, d, (d - 1) * 12)
    return total


def scores(a: np.ndarray, b: np.ndarray, bound: int) -> np.ndarray:
    """Differences of digests row by row, at most *bound*: bodies are read only where the header is under it."""
    total = _header(a, b)
    at = np.flatnonzero(total < bound)
    if len(at):
        total[at] += _BODY[a[at, 3:], b[at, 3:]].sum(1, dtype=np.int32)
    return np.minimum(total, bound)


def digest(text: Column) -> Column:
    """The digest of a text column (see :func:`digests`)."""
    return F.arrow_udf(digests, "string")(text)


def difference(a: Column, b: Column, bound: int = 150) -> Column:
    """Difference of two digest columns, 0 for equal ones and *bound* for all that differ by that or more; null if either is."""

    def run(x: pa.Array, y: pa.Array) -> pa.Array:
        (left, there), (right, too) = _parsed(x), _parsed(y)
        return pa.array(scores(left, right, bound), pa.int32(), mask=~(there & too))

    return F.arrow_udf(run, "int")(a, b)


def _levels(bodies: np.ndarray) -> np.ndarray:
    """The quartiles of all buckets [n, 128]."""
    return np.stack([(bodies >> s) & 3 for s in (0, 2, 4, 6)], -1).reshape(len(bodies), BUCKETS)


def table(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Differences of all of *a* from all of *b*: the bodies' part is one product of matrices, exact in single floats."""
    one = np.eye(4, dtype=np.float32)[_levels(a[:, 3:])].reshape(len(a), -1)
    cost = _COST[_levels(b[:, 3:])].reshape(len(b), -1)
    return _header(a[:, None], b[None]) + (one @ cost.T).astype(np.int32)


def _blocked(rows: DataFrame) -> tuple[DataFrame, list[int]]:
    """(code, block, rows) of rows (d, i, n), and the number of blocks of each of the 256 length codes."""
    coded = rows.withColumn("code", F.conv(F.hex(F.substring("d", 2, 1)), 16, 10).cast("int"))
    count = dict(coded.groupBy("code").agg(F.count("*")).collect())
    blocks = [-(-count.get(c, 0) // BLOCK) for c in range(256)]
    block = F.pmod(F.xxhash64("d"), F.greatest(F.lit(1), F.get(F.array(*map(F.lit, blocks)), F.col("code")))).cast("int")
    return coded.groupBy("code", block.alias("block")).agg(F.collect_list(F.struct("d", "i", "n")).alias("rows")), blocks


def closest(asked: DataFrame, known: DataFrame, bound: int, other: bool = False) -> DataFrame:
    """(d, m, near) of the digests *asked* (d) that differ by less than *bound* from some of *known* (d, i, n).

    ``m`` is the least (s, i), the difference and the id it belongs to, and
    ``near`` the sum of n; with *other*, equal digests don't count.  Both are
    distinct digests, stored.  Digests whose lengths alone make the bound never
    meet: blocks of about a thousand digests of one length code are compared
    with those of codes close enough.  The blocks asked for are sent to each
    such block, which is joined with them and compared in the same task.
    """
    reach = min((bound - 1) // 12 if bound > 12 else 1, 128)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for q, k in zip(batch.column(0), batch.column(1)):
                (own,), (theirs, i, n) = q.values.flatten()[:1], k.values.flatten()
                a, b = (flat(x)[0].reshape(-1, DIGEST_BYTES) for x in (own, theirs))
                i, n = i.to_numpy(), n.to_numpy()
                order = np.argsort(i, kind="stable")  # the smallest id comes first among equal differences
                b, i, n = b[order], i[order], n[order]
                s = table(a, b)
                near = s < bound
                if other:
                    near &= s > 0  # only equal digests differ by nothing
                least = np.where(near, s, bound)
                at = least.argmin(1)
                found = np.flatnonzero(near.any(1))
                yield pa.RecordBatch.from_arrays(
                    [own.take(pa.array(found)), pa.array(least[found, at[found]].astype(np.int32)), pa.array(i[at[found]]), pa.array((near @ n)[found])], names=["d", "s", "i", "near"]
                )

    theirs, blocks = _blocked(known)
    mine, _ = _blocked(asked.select("d", F.lit(0).cast("long").alias("i"), F.lit(0).cast("long").alias("n")))
    targets = [[F.struct(F.lit(t).alias("code"), F.lit(b).alias("block")) for t in sorted({(c + x) % 256 for x in range(-reach, reach + 1)}) for b in [blocks[t]] if b] for c in range(256)]
    spans = F.array(*[F.array(*t) if t else F.array().cast("array<struct<code:int,block:int>>") for t in targets])
    sent = mine.select(F.explode(F.get(spans, F.col("code"))).alias("t"), F.col("rows").alias("asked"))
    sent = sent.select(F.col("t.code").alias("code"), F.explode(F.sequence(F.lit(0), F.col("t.block") - 1)).alias("block"), "asked")
    pairs = by_bytes(sent.join(theirs, ["code", "block"]).select("asked", "rows"))
    return pairs.mapInArrow(run, "d binary, s int, i bigint, near bigint").groupBy("d").agg(F.min(F.struct("s", "i")).alias("m"), F.sum("near").alias("near"))


def search(docs: DataFrame, bound: int = NEAR, every: int = 50, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, nearest_doc, difference, near) of each row whose id is divisible by *every*, against all rows of *docs*.

    ``near`` counts the other rows that differ by less than *bound*, and
    ``nearest_doc`` is the one of these that differs least; on ties the
    smallest id of its digest, then of all, but for a row that has this id itself
    the largest among its copies.  Copies share a digest, which is compared
    once.  Nulls: where the row has no digest, and but for ``near`` where
    nothing is near.  Rows without an id take no part; rows that repeat an id
    count as others.
    """
    rows = stored(by_bytes(docs).select(F.col(doc_id).cast("long").alias("id"), F.unhex(digest(F.col(text))).alias("d")).where("id is not null"), "digest-rows")
    asks = F.col("id") % every == 0
    classes = stored(rows.where("d is not null").groupBy("d").agg(F.count("*").alias("n"), F.min("id").alias("i"), F.max("id").alias("last"), F.max(asks).alias("asked")), "digest-classes")
    own = classes.where("asked")
    found = own.join(closest(own.select("d"), classes.select("d", "i", "n"), bound, other=True), "d", "left")
    copied = F.col("n") > 1
    return rows.where(asks).join(found, "d", "left").select(
        F.col("id").alias("doc_id"),
        F.when(copied, F.when(F.col("id") == F.col("i"), F.col("last")).otherwise(F.col("i"))).otherwise(F.col("m.i")).alias("nearest_doc"),
        F.when(copied, F.lit(0)).otherwise(F.col("m.s")).alias("difference"),
        (F.col("n") - 1 + F.coalesce("near", F.lit(0))).alias("near"),
    )


def nearest(docs: DataFrame, items: DataFrame, bound: int = 150, text: str = "text", item_id: str = "item_id", most_items: int = 20_000) -> DataFrame:
    """*docs* with ``digest``, ``nearest_item`` and ``difference``: the item whose digest differs least, if by less than *bound*.

    Ties go to the smallest item id; items without id or digest don't take
    part.  Up to *most_items* item digests (35 bytes each) travel with the
    function; with more, blocks of digests of like length are compared (:func:`closest`).  New columns
    that clash with one of *docs* get underscores appended.
    """
    name, near, by = fresh(docs, "digest"), fresh(docs, "nearest_item"), fresh(docs, "difference")
    coded = items.select(F.col(item_id).cast("long").alias("i"), digest(F.col(text)).alias("g")).where("i is not null and g is not null")
    out = by_bytes(docs).withColumn(name, digest(F.col(text)))
    if items.count() > most_items:
        asked = stored(out.select(F.unhex(name).alias("d")).where("d is not null").distinct(), "digests")
        known = stored(coded.groupBy(F.unhex("g").alias("d")).agg(F.min("i").alias("i"), F.count("*").alias("n")), "digests")
        best = closest(asked, known, bound).select("d", "m")
        return out.join(best, F.unhex(F.col(name)) == F.col("d"), "left").select(*[F.col(f"`{c}`") for c in out.columns], F.col("m.i").alias(near), F.col("m.s").alias(by))
    found = coded.orderBy("i").collect()
    ids, refs = np.array([r["i"] for r in found], np.int64), _parsed(pa.array([r["g"] for r in found], pa.string()))[0]

    def run(x: pa.Array) -> pa.Array:
        own, there = _parsed(x)
        best, at = np.full(len(own), bound), np.zeros(len(own), np.int64)
        for k in range(len(ids)):
            s = scores(own, np.broadcast_to(refs[k], own.shape), bound)
            less = (s < best) & there
            best[less], at[less] = s[less], ids[k]
        none = best >= bound
        return pa.StructArray.from_arrays([pa.array(at, pa.int64(), mask=none), pa.array(best, pa.int32(), mask=none)], names=["i", "s"])

    pair = fresh(out, "pair")
    out = out.withColumn(pair, F.arrow_udf(run, "struct<i:bigint,s:int>")(F.col(name)))
    return out.withColumns({near: F.col(pair)["i"], by: F.col(pair)["s"]}).drop(pair)


def _sql() -> tuple[str, str]:
    """DuckDB SQL: the tables up to the digests of documents and benchmark, and the difference of digests d and b."""
    table = "[" + ",".join(map(str, T)) + "]"
    t = lambda i: f"({table})[{i} + 1]"
    hashed = ", ".join(t(f"xor({t(f'xor({t(f'xor({T[salt]}, c)')}, c{d1})')}, c{d2})") for salt, d1, d2 in TRIPLETS)
    around = lambda a, b, m: f"least(({a} - {b} + {m}) % {m}, ({b} - {a} + {m}) % {m})"
    ratio = lambda c: f"case when {around(f'd.{c}', f'b.{c}', 16)} <= 1 then {around(f'd.{c}', f'b.{c}', 16)} else 12 * ({around(f'd.{c}', f'b.{c}', 16)} - 1) end"
    step = around("d.size_code", "b.size_code", 256)
    tables = f"""
with texts as materialized (select 'd' as k, row_number() over () as r, doc_id as id, text from documents union all select 'b', row_number() over (), item_id, text from benchmark),
bytes as (select k, r, unnest(l) as c, generate_subscripts(l, 1) as i from (
  select k, r, list_transform(regexp_extract_all(hex(encode(text)), '..'), lambda h: ('0x' || h)::int) as l from texts) x),
windows as (select * from (select k, r, c, lag(c, 1) over w as c1, lag(c, 2) over w as c2, lag(c, 3) over w as c3, lag(c, 4) over w as c4
  from bytes window w as (partition by k, r order by i)) x where c4 is not null),
checks as (select k, r, (sum({t(f"xor(c, {t('c1')})")}) % 256)::int as checksum from windows group by all),
hits as (select k, r, bucket, count(*) as n from (select k, r, unnest([{hashed}]) as bucket from windows) x where bucket < {BUCKETS} group by all),
bodies as (select k, r, list(coalesce(n, 0) order by bucket) as body from (select k, r, unnest(range({BUCKETS})) as bucket from checks) x left join hits using (k, r, bucket) group by all),
facts as (select k, r, checksum, body, list_sort(body)[{BUCKETS // 4}] as q1, list_sort(body)[{BUCKETS // 2}] as q2, list_sort(body)[{3 * BUCKETS // 4}] as q3 from bodies join checks using (k, r)),
coded as (select t.k, t.r, id, checksum, (floor(8 * log2(octet_length(encode(text))))::int & 255) as size_code, (q1 * 100 // q3 % 16)::int as r1, (q2 * 100 // q3 % 16)::int as r2,
  list_transform(body, lambda x: (x > q1)::int + (x > q2)::int + (x > q3)::int) as code
  from texts t join facts f on t.k = f.k and t.r = f.r where octet_length(encode(text)) >= {MIN_BYTES} and q3 > 0),
digests as (select *, printf('%02x%02x%02x', checksum, size_code, r1 * 16 + r2) || list_aggregate(list_transform(range({BUCKETS // 4}), lambda j:
  printf('%02x', code[4 * j + 1] + 4 * code[4 * j + 2] + 16 * code[4 * j + 3] + 64 * code[4 * j + 4])), 'string_agg', '') as digest from coded)"""
    score = f"""(d.checksum <> b.checksum)::int + case when {step} <= 1 then {step} else 12 * {step} end + {ratio('r1')} + {ratio('r2')}
  + list_sum(list_transform(list_zip(d.code, b.code), lambda z: ([0, 1, 2, 6])[abs(z[1] - z[2]) + 1]))"""
    return tables, score


def oracle(bound: int = 150) -> str:
    """DuckDB SQL for (doc_id, digest, nearest_item, difference) of documents against benchmark."""
    tables, score = _sql()
    return f"""{tables},
pairs as (select d.r, b.id as item, {score} as s from digests d, digests b where d.k = 'd' and b.k = 'b'),
best as (select r, min(s)::int as s, min_by(item, (s, item)) as item from pairs where s < {bound} group by r)
select t.id as doc_id, digest, item as nearest_item, s as difference from texts t left join digests d on t.k = d.k and t.r = d.r left join best on t.r = best.r where t.k = 'd'
"""


def search_oracle(bound: int = NEAR, every: int = 50) -> str:
    """DuckDB SQL for the rows of :func:`search` over documents."""
    tables, score = _sql()
    return f"""{tables},
classes as materialized (select digest, any_value(checksum) as checksum, any_value(size_code) as size_code, any_value(r1) as r1, any_value(r2) as r2, any_value(code) as code,
  count(*) as n, min(id) as i, max(id) as last, bool_or(id % {every} = 0) as asked from digests where k = 'd' and id is not null group by digest),
pairs as (select d.digest, b.i, b.n, {score} as s from classes d, classes b where d.asked and d.digest <> b.digest),
best as (select digest, min(s)::int as s, min_by(i, (s, i)) as near_i, sum(n)::bigint as near from pairs where s < {bound} group by digest)
select t.id as doc_id, case when n = 1 then near_i when t.id = i then last else i end as nearest_doc, case when n > 1 then 0 else s end as difference, n - 1 + coalesce(near, 0) as near
from texts t left join digests d on t.k = d.k and t.r = d.r left join classes c on d.digest = c.digest left join best on c.digest = best.digest where t.k = 'd' and t.id % {every} = 0
"""
