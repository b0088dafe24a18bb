"""N-gram Jaccard join: all links between like documents, exactly.

A document is its set of hashed word n-grams.  No step is a guess: what a step
leaves out can't reach the threshold t.  The join runs in four steps.

1. A text of which fewer than t of the n-grams occur in another text has no
   partner.  The n-grams of each text that a task meets go out by their
   hashes, packed, at some five bytes each; what comes back is how many of a
   text's n-grams others have.
2. Of the texts left, rarest n-grams first, two at the threshold share one of
   the first size - ceil(t * size) + 1 (prefix filter).  n-grams that one text
   has alone come first and lead nowhere, so few are left.  Texts that meet at
   one are linked in the order of their sizes, unless the sizes are too far
   apart.  Connected components of these links, by hooking to the smallest
   neighbour and pointer jumping, put all that may be alike in one place.  A
   component of more than ``block`` texts or ``block_bytes`` bytes is cut into
   blocks and every pair of blocks is a task of its own, so that no task grows
   with the data and no pair is lost.
3. Each task holds its texts once and counts the n-grams that any two share.
4. A task returns a row for each of its texts that has links: how many
   documents it is linked with, and the first text that it is connected to
   there.  From these follow the classes; documents join them by digest.  A
   class of thousands of texts, or a text with thousands of copies, gives
   thousands of rows and not millions.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import lru_cache
from math import comb

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WHITE, by_bytes, flat, frugal, mix64, parts, slices, stored

#: Words of an n-gram; similarity a pair must reach.  With three words, texts of which a tenth of the words differ
#: reach one half, and those that share a passage of half their length don't.
N, THRESHOLD = 3, 0.5
#: MinHash values of :func:`signatures`, and bits of :func:`sketches`: estimates only, on which no pair of the join depends.
VALUES, SKETCH = 400, 64
#: Bytes of text whose n-grams are one part of the exchange (there are 32 parts at least, 65,536 at most), and pairs counted at once.
PART_BYTES, COUNTED = 64 << 20, 2 << 20
#: Bytes of text whose n-grams are packed at once, and n-grams counted at once.
PACKED_BYTES, AT_ONCE = 2 << 20, 1 << 20
#: Distinct texts, and their bytes, that a task holds of a component (of two blocks, if it is larger).
BLOCK, BLOCK_BYTES = 4096, 16 << 20
#: Texts that may have partners (8 bytes each), texts in components (24 bytes) and documents to drop (16 bytes) up to this many are broadcast; beyond, documents are shuffled to them.
BROADCAST_ROWS = 2_000_000
#: Different edges up to this many are labelled by one task; beyond, in rounds over all executors.
ALONE = 500_000


def shingles(texts: pa.Array, n: int = N, distinct: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """(64-bit hashes, offsets) of the word n-grams of each text, sorted and without repeats if *distinct*.

    Words are what lies between ASCII white space, in lower case.  A text of
    fewer than *n* words has one n-gram of all of them; a null or blank text none.
    """
    raw, at = flat(pc.utf8_lower(texts))
    count = len(texts)
    if not len(raw):
        return np.zeros(0, np.uint64), np.zeros(count + 1, np.int64)
    words, begin = parts(raw, at, WHITE)
    per = np.diff(begin)
    owner = np.repeat(np.arange(count), per)
    grams = np.zeros(len(words), np.uint64)
    for k in range(n):
        part = words[k:]
        grams[: len(part)] = grams[: len(part)] * np.uint64(0xD6E8FEB86659FD93) + part if k else part
    position = np.arange(len(words)) - begin[owner]
    keep = position <= np.maximum(per[owner] - n, 0)
    for t in np.flatnonzero((per > 0) & (per < n)):  # one n-gram of fewer words
        value = np.uint64(int(per[t]))
        for w in words[begin[t] : begin[t + 1]]:
            value = np.uint64((int(value) * 0xD6E8FEB86659FD93 + int(w)) & (2**64 - 1))
        grams[begin[t]] = value
    grams, owner = mix64(grams[keep]), owner[keep]
    if not distinct:
        return grams, np.searchsorted(owner, np.arange(count + 1))
    order = np.lexsort((grams, owner)) if count > 1 else np.argsort(grams, kind="stable")
    grams, owner = grams[order], owner[order]
    new = np.ones(len(grams), bool)
    new[1:] = (grams[1:] != grams[:-1]) | (owner[1:] != owner[:-1])
    grams, owner = grams[new], owner[new]
    return grams, np.searchsorted(owner, np.arange(count + 1))


_SEEDS = np.random.default_rng(20240517).integers(0, 2**32, (2, VALUES), dtype=np.uint32)


def signatures(grams: np.ndarray, at: np.ndarray) -> np.ndarray:
    """MinHash values [texts, VALUES]; all ones for a text without n-grams."""
    n = len(at) - 1
    out = np.full((n, VALUES), 0xFFFFFFFF, np.uint32)
    there = np.flatnonzero(np.diff(at))
    if not len(there):
        return out
    low = (grams >> np.uint64(32)).astype(np.uint32)
    cuts = at[:-1][there]
    for k in range(VALUES):
        out[there, k] = np.minimum.reduceat((low ^ _SEEDS[0, k]) * (_SEEDS[1, k] | np.uint32(1)), cuts)
    return out


def sketches(sig: np.ndarray) -> np.ndarray:
    """One bit of each of the first 64 MinHash values: equal with probability (1 + similarity) / 2."""
    bits = (mix64(sig[:, :SKETCH].astype(np.uint64)) & np.uint64(1)) << np.arange(SKETCH, dtype=np.uint64)
    return np.bitwise_or.reduce(bits, axis=1)


@lru_cache
def least_bits(threshold: float, tolerance: float) -> int:
    """The fewest equal bits of two sketches with which an edge stays: as :func:`least_matches`, by the posterior of (1 + similarity) / 2 on 1/2 to 1."""
    chance = np.linspace(0.5, 1, 20_001)[:-1]
    for m in range(SKETCH + 1):
        weight = m * np.log(chance) + (SKETCH - m) * np.log(1 - chance)
        weight = np.exp(weight - weight.max())
        if weight[chance >= (1 + threshold) / 2].sum() >= tolerance * weight.sum():
            return m
    return SKETCH + 1


@lru_cache
def least_matches(threshold: float, tolerance: float, seen: int) -> int:
    """The fewest equal values among *seen* with which a pair stays.

    With a uniform prior the similarity given m matches has the distribution
    Beta(m + 1, seen - m + 1), so P(similarity >= t) is the probability of at
    most m successes in seen + 1 draws at t.
    """
    below = 0.0
    for m in range(seen + 1):
        below += comb(seen + 1, m) * threshold**m * (1 - threshold) ** (seen + 1 - m)
        if below >= tolerance:
            return m
    return seen + 1


def like_pairs(texts: pa.Array, task: np.ndarray, side: np.ndarray, n: int, threshold: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(i, j, similarity) of all pairs i < j of one task that reach *threshold*; side -1 pairs with all of its task, 0 with 1 only."""
    m, salt = len(texts), mix64(task.astype(np.uint64))
    keys, sizes, done = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)], 0
    for part in slices(texts):
        g, a = shingles(part, n)
        sizes.append(np.diff(a))
        keys.append(mix64(g + np.repeat(salt[done : done + len(part)], sizes[-1])))
        done += len(part)
    key, size = np.concatenate(keys), np.concatenate(sizes)
    keys.clear()
    kind = np.int32 if max(len(key), COUNTED, m) < 1 << 31 else np.int64
    order = np.argsort(key, kind="stable")  # the owners of an n-gram in order
    key = key[order]
    shared = _shared(key)
    key, own = key[shared], np.repeat(np.arange(m, dtype=kind), size)[order[shared]]
    del order, shared
    start, length = _runs(key)
    after = np.repeat(start + length, length) - np.arange(len(own)) - 1  # how many texts after its own have the n-gram
    here = np.flatnonzero(after)
    here = here[np.argsort(own[here], kind="stable")]
    after = after[here]
    upto = np.searchsorted(own[here], np.arange(m + 1))
    found = []
    step = max(1, COUNTED // max(1, m))
    for low in range(0, m, step):
        high = min(m, low + step)
        base, e = upto[low], upto[high]
        if base == e:
            continue
        both = np.zeros((high - low) * m, np.int64)
        total = np.cumsum(after[base:e])
        s, done = base, 0
        while s < e:
            stop = max(s + 1, base + int(np.searchsorted(total, done + COUNTED, "right")))
            times = after[s:stop]
            cell = np.arange(times.sum(), dtype=kind)
            cell -= np.repeat((np.cumsum(times) - times - here[s:stop] - 1).astype(kind), times)
            cell = own[cell]
            cell += np.repeat((own[here[s:stop]] - low) * m, times).astype(kind, copy=False)
            both += np.bincount(cell, minlength=len(both))
            s, done = stop, total[stop - base - 1]
        cell = np.flatnonzero(both)
        i, j, both = cell // m + low, cell % m, both[cell]
        similarity = both / (size[i] + size[j] - both)
        ok = (similarity >= threshold) & ((side[i] < 0) | (side[i] != side[j]))
        found.append((i[ok], j[ok], similarity[ok]))
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    return tuple(np.concatenate(x) for x in zip(*found))


def _runs(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the runs of equal values start, and their lengths."""
    start = np.flatnonzero(np.concatenate([[True], x[1:] != x[:-1]])) if len(x) else np.zeros(0, np.int64)
    return start, np.diff(np.append(start, len(x)))


def _shared(x: np.ndarray) -> np.ndarray:
    """Which of the sorted values occur twice at least."""
    out = np.zeros(len(x), bool)
    out[1:] = x[1:] == x[:-1]
    out[:-1] |= out[1:]
    return out


#: Values of some nodes: counts is an array [3, nodes] of the codes that belong to each, its n-grams, and those that its other n-grams clash with.
PACKED = "part int, nodes binary, counts binary, codes binary"


def _pack(part: np.ndarray, node: np.ndarray, counts: np.ndarray, codes: np.ndarray) -> pa.RecordBatch:
    """A row for each part; *part* is in order, and so are *codes*, as counts[0] tells."""
    start, length = _runs(part)
    ends = np.cumsum(counts[0])
    cut = np.concatenate([[0], ends])
    rows: list[tuple] = []
    for s, e in zip(start.tolist(), (start + length).tolist()):
        rows.append((int(part[s]), node[s:e].tobytes(), counts[:, s:e].astype(np.uint32).tobytes(), codes[cut[s] : cut[e]].tobytes()))
    columns = list(zip(*rows)) or [()] * 4
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, [pa.int32()] + [pa.binary()] * 3)], names=["part", "nodes", "counts", "codes"])


def _each_part(solve: Callable[[int, np.ndarray, np.ndarray, np.ndarray], pa.RecordBatch], kind: type):
    """Reads rows sorted by part and yields what *solve* makes of (part, nodes, counts, codes) of each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def solved() -> pa.RecordBatch:
            nodes, counts, codes = (np.concatenate(x, axis=-1) for x in zip(*held))
            held.clear()
            return solve(part, nodes, counts.astype(np.int64), codes)

        part, held = -1, []
        for batch in batches:
            for k, *values in zip(*(c.to_pylist() for c in batch.columns)):
                if k != part and held:
                    yield solved()
                part = k
                held.append((np.frombuffer(values[0], np.int64), np.frombuffer(values[1], np.uint32).reshape(3, -1), np.frombuffer(values[2], kind)))
        if held:
            yield solved()

    return frugal(run)


def _postings(n: int, bits: int):
    """The n-grams of each text, 32 bits of them, in the part that the upper bits name; its size in a part from 2**bits on that its node names.

    Of texts that a task meets again only the first gives rows.
    """
    parts = 1 << bits

    def rows(nodes: np.ndarray, texts: pa.Array) -> Iterator[pa.RecordBatch]:
        grams, sizes = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
        for some in slices(texts):
            g, a = shingles(some, n)
            grams.append(g)
            sizes.append(np.diff(a))
        gram, size = np.concatenate(grams), np.concatenate(sizes)
        grams.clear()
        owner = np.repeat(np.arange(len(size)), size)
        part = (gram >> np.uint64(64 - bits)).astype(np.uint16)
        order = np.argsort(part, kind="stable")
        part, owner = part[order].astype(np.int64), owner[order]
        start, length = _runs(part * len(size) + owner)
        zero = np.zeros_like(length)
        yield _pack(part[start], nodes[owner[start]], np.stack([length, zero, zero]), gram.astype(np.uint32)[order])
        there = np.flatnonzero(size)
        there = there[np.argsort(nodes[there] & (parts - 1), kind="stable")]
        zero = np.zeros_like(there)
        yield _pack(parts + (nodes[there] & (parts - 1)), nodes[there], np.stack([zero, size[there], zero]), np.zeros(0, np.uint32))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            nodes, done = batch.column(0).to_numpy(), 0
            for texts in slices(batch.column(1), PACKED_BYTES):
                own = nodes[done : done + len(texts)]
                done += len(texts)
                new = np.array([x not in seen and not seen.add(x) for x in own.tolist()], bool)
                yield from rows(own[new], texts.filter(pa.array(new)))

    return frugal(run)


def _common(bits: int, full: bool):
    """For each text, in the part that its node names, which n-grams of this part other texts have, or only how many.

    Codes are (texts that have it, part, 32 bits), so that they sort by rarity.
    """
    parts = 1 << bits

    def solve(part: int, nodes: np.ndarray, counts: np.ndarray, codes: np.ndarray) -> pa.RecordBatch:
        node, first, local = np.unique(nodes, return_index=True, return_inverse=True)
        if part >= parts:
            return _pack(np.full(len(node), part - parts), node, counts[:, first], np.zeros(0, np.uint64))
        key = codes.astype(np.uint64)
        key <<= np.uint64(32)
        key |= np.repeat(local.astype(np.uint32), counts[0])
        key.sort()
        if len(key):
            new = np.concatenate([[True], key[1:] != key[:-1]])
            if not new.all():
                key = key[new]  # less a text that several tasks have met, or two of its n-grams of the same bits
            del new
        lost = counts[0][first]
        for s in range(0, len(key), AT_ONCE):
            lost = lost - np.bincount((key[s : s + AT_ONCE] & np.uint64(0xFFFFFFFF)).astype(np.int64), minlength=len(node))
        code = (key >> np.uint64(32)).astype(np.uint32)
        several = _shared(code)
        code, own = code[several], (key[several] & np.uint64(0xFFFFFFFF)).astype(np.int64)
        del key, several
        _, length = _runs(code)
        often = np.repeat(length, length)
        shared = np.bincount(own, minlength=len(node))
        order = np.lexsort((np.arange(len(node)), node & (parts - 1)))
        order = order[(shared[order] > 0) | (lost[order] > 0)]
        kept = np.zeros(0, np.uint64)
        if full:
            place = np.zeros(len(node), np.int64)
            place[order] = np.arange(len(order))
            kept = (np.minimum(often, 65535).astype(np.uint64) << np.uint64(48) | np.uint64(part) << np.uint64(32) | code)[np.argsort(place[own], kind="stable")]
        return _pack(node[order] & (parts - 1), node[order], np.stack([shared[order], np.zeros_like(order), lost[order]]), kept)

    return _each_part(solve, np.uint32)


def _least(size: np.ndarray, threshold: float) -> np.ndarray:
    """The fewest n-grams that a text of *size* shares with one at the threshold."""
    return np.ceil(threshold * size - 1e-6).astype(np.int64)


def _sums(nodes: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Nodes once each, the place there of those given, and the sums [3, nodes] of their counts."""
    node, local = np.unique(nodes, return_inverse=True)
    return node, local, np.stack([np.bincount(local, c, len(node)).astype(np.int64) for c in counts])


def _hopeful(threshold: float):
    """The nodes that have enough n-grams in common with others, those that clash counted as such."""

    def solve(part: int, nodes: np.ndarray, counts: np.ndarray, codes: np.ndarray) -> pa.RecordBatch:
        node, _, (shared, size, lost) = _sums(nodes, counts)
        return pa.RecordBatch.from_arrays([pa.array(node[shared + lost >= _least(size, threshold)])], names=["node"])

    return _each_part(solve, np.uint64)


def _prefixes(threshold: float):
    """Of each text the n-grams of its prefix that others have, in the parts of the n-grams, with the text's size."""

    def solve(part: int, nodes: np.ndarray, counts: np.ndarray, codes: np.ndarray) -> pa.RecordBatch:
        node, local, (shared, size, lost) = _sums(nodes, counts)
        own = np.repeat(local, counts[0])
        order = np.lexsort((codes, own))
        codes, own = codes[order], own[order]
        begin = np.cumsum(shared) - shared
        most = size - _least(size, threshold) + 1 - (size - lost - shared)  # less those that it has alone
        kept = np.arange(len(own)) - begin[own] < most[own]
        codes, own = codes[kept], own[kept]
        part_of = (codes >> np.uint64(32) & np.uint64(0xFFFF)).astype(np.int64)
        order = np.lexsort((own, part_of))
        codes, own, part_of = codes[order], own[order], part_of[order]
        start, length = _runs(part_of * max(1, len(node)) + own)
        return _pack(part_of[start], node[own[start]], np.stack([length, size[own[start]], np.zeros_like(length)]), codes.astype(np.uint32))

    return _each_part(solve, np.uint64)


def _meetings(threshold: float):
    """(a, b): a forest over the texts that meet in a part at an n-gram of their prefixes, and whose sizes allow the threshold."""

    def solve(part: int, nodes: np.ndarray, counts: np.ndarray, codes: np.ndarray) -> pa.RecordBatch:
        own = np.repeat(np.arange(len(nodes)), counts[0])
        size = counts[1]
        order = np.lexsort((size[own], codes))
        codes, own = codes[order], own[order]
        a, b = own[:-1], own[1:]
        met = (codes[:-1] == codes[1:]) & (size[a] >= _least(size[b], threshold))
        root = roots(len(nodes), a[met], b[met])
        far = np.flatnonzero(root != np.arange(len(nodes)))
        return pa.RecordBatch.from_arrays([pa.array(nodes[root[far]]), pa.array(nodes[far])], names=["a", "b"])

    return _each_part(solve, np.uint32)


def _labelled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(node, label) of all edges (a, b) of the task."""
    held = [b for b in batches if b.num_rows]
    if not held:
        return
    edges = pa.Table.from_batches(held)
    held.clear()
    node = pc.unique(pa.chunked_array([*edges["a"].chunks, *edges["b"].chunks]))
    node = node.take(pc.array_sort_indices(node))
    i, j = (pc.index_in(edges[c], node).to_numpy() for c in "ab")
    del edges
    label = roots(len(node), i, j)
    for s in range(0, len(node), 1 << 16):
        yield pa.RecordBatch.from_arrays([node.slice(s, 1 << 16), node.take(pa.array(label[s : s + (1 << 16)]))], names=["node", "label"])


def components(edges: DataFrame, alone: int = ALONE) -> DataFrame:
    """(node, label) for edges (a, b): the smallest node that each is connected to.

    Up to *alone* different edges go to one task.  Of more, every round takes
    the smallest label among a node and its neighbours, then the label's own
    label; rounds double the reach, and what they read is the written table of
    the round before.  Labels only fall, so the rounds end.
    """
    once = stored(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    if once.count() <= alone:
        kind = once.schema["a"].dataType.simpleString()
        return stored(once.coalesce(1).mapInArrow(frugal(_labelled), f"node {kind}, label {kind}"), "labels")
    both = stored(once.union(once.select(F.col("b").alias("a"), F.col("a").alias("b"))), "edges")
    labels = stored(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.col("node")).alias("label")), "labels")
    while True:
        near = both.join(labels.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("near"))
        hooked = labels.join(near, "node").select("node", F.least("label", "near").alias("new"), F.col("label").alias("old"))
        jump = labels.select(F.col("node").alias("new"), F.col("label").alias("further"))
        after = hooked.join(jump, "new", "left").select("node", F.least("new", F.coalesce("further", "new")).alias("label"), "old")
        after = stored(after, "labels")
        changed = after.where("label <> old").limit(1).count()
        labels = after.select("node", "label")
        if not changed:
            return labels


def roots(m: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The smallest of 0..m - 1 that each is connected to by the edges (i, j)."""
    label = np.arange(m)
    while True:
        after = label.copy()
        np.minimum.at(after, i, label[j])
        np.minimum.at(after, j, label[i])
        after = after[after]
        if (after == label).all():
            return label
        label = after


def _solve(n: int, threshold: float, links: bool):
    """Reads rows sorted by task and yields its pairs, or its texts' links; small tasks share one call of the kernel."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def solve(tables: list[pa.RecordBatch]) -> pa.RecordBatch:
            t = pa.Table.from_batches(tables).combine_chunks()
            col = lambda name: t[name].combine_chunks() if t[name].num_chunks != 1 else t[name].chunk(0)
            task, side, exact = np.concatenate([[0], np.cumsum(np.diff(col("task").to_numpy()) != 0)]), col("side").to_numpy(), col("exact")
            i, j, s = like_pairs(col("text"), task, side, n, threshold)
            if not links:
                return pa.RecordBatch.from_arrays([exact.take(pa.array(i)), exact.take(pa.array(j)), pa.array(s)], names=["x", "y", "jaccard"])
            copies = col("copies").to_numpy().astype(float)
            count = (np.bincount(i, copies[j], len(t)) + np.bincount(j, copies[i], len(t))).astype(np.int64)
            at = np.flatnonzero(count)
            root = roots(len(t), i, j)[at]
            return pa.RecordBatch.from_arrays([exact.take(pa.array(at)), pa.array(count[at]), exact.take(pa.array(root)), pa.array(side[at] == WHOLE)], names=["exact", "links", "root", "whole"])

        held: list[pa.RecordBatch] = []
        rows, size = 0, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            task = batch.column(batch.schema.get_field_index("task")).to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(task)) + 1).tolist(), batch.num_rows]
            for s, e in zip(cuts, cuts[1:]):
                new = not held or held[-1].column(held[-1].schema.get_field_index("task"))[-1].as_py() != task[s]
                if new and (rows >= 2000 or size >= 8 << 20):
                    yield solve(held)
                    held, rows, size = [], 0, 0
                piece = batch.slice(s, e - s)
                held.append(piece)
                rows += piece.num_rows
                size += piece.get_total_buffer_size() * piece.num_rows // max(1, batch.num_rows)
        if held:
            yield solve(held)

    return frugal(run)


@dataclass(frozen=True)
class Join:
    """The parameters of a join; see the module's constants for what they mean."""

    n: int = N
    threshold: float = THRESHOLD
    block: int = BLOCK
    block_bytes: int = BLOCK_BYTES
    part_bytes: int = PART_BYTES
    broadcast_rows: int = BROADCAST_ROWS
    alone: int = ALONE

    def small(self, df: DataFrame) -> DataFrame:
        """*df*, broadcast if its rows are few enough."""
        return F.broadcast(df) if df.limit(self.broadcast_rows + 1).count() <= self.broadcast_rows else df

    def edges(self, texts: DataFrame, keyed: DataFrame) -> DataFrame:
        """(a, b) of nodes, by which any two that reach the threshold are connected, from (node, text)."""
        total = keyed.agg(F.sum("size")).first()[0] or 0
        bits = min(16, max(5, (total // self.part_bytes).bit_length()))

        def by_part(rows: DataFrame) -> DataFrame:
            return by_bytes(rows).repartition("part").sortWithinPartitions("part")

        first = by_bytes(texts).mapInArrow(_postings(self.n, bits), PACKED)
        counted = by_part(first).mapInArrow(_common(bits, False), PACKED)
        hopeful = stored(by_part(counted).mapInArrow(_hopeful(self.threshold), "node bigint"), "hopeful")
        again = by_bytes(texts.join(self.small(hopeful), "node", "left_semi")).mapInArrow(_postings(self.n, bits), PACKED)
        shared = by_part(again).mapInArrow(_common(bits, True), PACKED)
        prefixes = by_part(shared).mapInArrow(_prefixes(self.threshold), PACKED)
        return by_part(prefixes).mapInArrow(_meetings(self.threshold), "a bigint, b bigint")

    def members(self, texts: DataFrame, keyed: DataFrame) -> DataFrame:
        """(task, side, exact, copies, text): the distinct texts that may have a partner, each once per task."""
        labels = components(self.edges(texts.select("node", "text"), keyed), self.alone)
        held = keyed.join(self.small(labels), "node").groupBy("label", "node").agg(F.max("size").alias("size"))
        sizes = held.groupBy("label").agg(F.greatest(F.ceil(F.count(F.lit(1)) / self.block), F.ceil(F.sum("size") / self.block_bytes)).cast("long").alias("blocks"))
        placed = stored(labels.join(sizes, "label").select("node", "label", "blocks"), "placed")
        whole = by_bytes(texts).join(self.small(placed), "node")
        once = whole.groupBy("node", F.md5("text").alias("exact")).agg(F.count(F.lit(1)).alias("copies"), F.first("text").alias("text"), F.first("label").alias("label"), F.first("blocks").alias("blocks"))
        own = F.pmod(F.xxhash64("exact"), F.col("blocks"))
        many = once.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
        low, high = F.least("own", "other"), F.greatest("own", "other")
        side = F.when(F.col("blocks") == 1, WHOLE).when(F.col("own") == F.col("other"), -1).otherwise((F.col("own") > F.col("other")).cast("int"))
        return many.select(F.xxhash64("label", low, high).alias("task"), side.cast("int").alias("side"), "exact", "copies", "text")

    def solved(self, texts: DataFrame, keyed: DataFrame, links: bool) -> DataFrame:
        rows = self.members(texts, keyed).repartition("task").sortWithinPartitions("task")
        return rows.mapInArrow(_solve(self.n, self.threshold, links), "exact string, links bigint, root string, whole boolean" if links else "x string, y string, jaccard double")


#: Side of the texts of a component that is one task.
WHOLE = -2


def _inputs(docs: DataFrame, doc_id: str, text: str) -> tuple[DataFrame, DataFrame]:
    """(node, text) of the texts that aren't null, and stored (id, node, exact, size) of all rows; what has no words has no digest."""
    t = F.col(text)
    texts = docs.where(t.isNotNull()).select(F.xxhash64(t).alias("node"), t.alias("text"))
    keyed = docs.select(F.col(doc_id).cast("long").alias("id"), F.xxhash64(t).alias("node"), F.when(t.rlike(r"[^\t-\r ]"), F.md5(t)).alias("exact"), F.octet_length(t).cast("long").alias("size"))
    return texts, stored(keyed, "keyed")


def pairs(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", **params) -> DataFrame:
    """(doc_a < doc_b, jaccard) of different texts that are linked, each standing as the smallest id that has it; see :func:`classes`.

    Texts of which no document has an id are left out.
    """
    texts, keyed = _inputs(docs, doc_id, text)
    first = stored(keyed.where("exact is not null and id is not null").groupBy("exact").agg(F.min("id").alias("id")), "first")
    found = stored(Join(**params).solved(texts, keyed, False), "pairs")
    x, y = first.select(F.col("exact").alias("x"), F.col("id").alias("a")), first.select(F.col("exact").alias("y"), F.col("id").alias("b"))
    return found.join(x, "x").join(y, "y").where("a <> b").select(F.least("a", "b").alias("doc_a"), F.greatest("a", "b").alias("doc_b"), "jaccard")


def _facts(docs: DataFrame, doc_id: str, text: str, join: Join) -> tuple[DataFrame, DataFrame]:
    """(id, node, exact, size) of all rows, and (exact, class_id, n_links) of the texts that have copies or links."""
    texts, keyed = _inputs(docs, doc_id, text)
    found = stored(join.solved(texts, keyed, True), "links")
    labels = found.where("whole").select("exact", F.col("root").alias("label"))
    split = found.where("not whole").select(F.col("exact").alias("a"), F.col("root").alias("b"))
    if not split.isEmpty():
        labels = labels.unionByName(components(split, join.alone).select(F.col("node").alias("exact"), "label"))
    links = found.groupBy("exact").agg(F.sum("links").alias("links"))
    each = keyed.where("exact is not null").groupBy("exact").agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("copies"))
    each = each.join(labels, "exact", "left").join(links, "exact", "left").where("copies > 1 or label is not null")
    each = stored(each.select("exact", "id", F.coalesce("label", "exact").alias("label"), (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links")), "linked")
    return keyed, each.join(each.groupBy("label").agg(F.min("id").alias("class_id")), "label").select("exact", "class_id", "n_links")


def classes(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", **params) -> DataFrame:
    """(doc_id, class_id, n_links): a row for each row of *docs*, with the smallest id of its class and how many other rows it is linked with.

    Rows are linked if their texts are equal, or their n-gram Jaccard
    similarity is *threshold* or more; a class is what is connected by links.
    Texts that are null or blank have no n-grams, so they are classes of their
    own without links; of ids that are null the class is null where no linked
    row has an id.  Rows repeated in the input are rows of their own, linked
    with each other.  Ties don't arise, very long texts take part in whole.
    All links are found, but for n-grams or texts of equal 64-bit hashes.
    """
    keyed, facts = _facts(docs, doc_id, text, Join(**params))
    return keyed.join(facts, "exact", "left").select(F.col("id").alias("doc_id"), F.coalesce("class_id", "id").alias("class_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))


def keep_one(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", **params) -> DataFrame:
    """*docs* less the rows whose id isn't the smallest of their class (see :func:`classes`).

    One document of each class stays, with all columns.  Rows without n-grams
    or id stay; of equal rows all stay or all go.
    """
    join = Join(**params)
    keyed, facts = _facts(docs, doc_id, text, join)
    drop = stored(keyed.join(facts, "exact").where("id <> class_id").select("id", "node").distinct(), "drop")
    return docs.join(join.small(drop), (docs[doc_id] == drop["id"]) & (F.xxhash64(docs[text]) == drop["node"]), "left_anti")
