"""Operators over a whole corpus, each against brute force on small fixtures, and their edge cases."""

import hashlib
import math
import random
import tracemalloc
from collections import Counter, defaultdict
from functools import lru_cache

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tierlens.llm import common, cotrain, ctw, exact_dedup, mixing, ngram_join

from .test_text_operators import LONG, odd_documents

SF = "/root/testdata/sf0.001"


# N-gram Jaccard join


def _grams(text, n=3):
    w = "".join(c if c not in "\t\n\x0b\x0c\r" else " " for c in text.lower()).split(" ")
    w = [x for x in w if x]
    return {tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} if w else set()


def _pairs_by_hand(rows, threshold=0.5):
    """Of different texts, each standing as its smallest id."""
    ids = defaultdict(list)
    for i, t in rows:
        if t is not None and i is not None and _grams(t):
            ids[t].append(i)
    reps = [(min(v), _grams(t)) for t, v in ids.items()]
    out = {}
    for k, (a, x) in enumerate(reps):
        for b, y in reps[:k]:
            s = len(x & y) / len(x | y)
            if s >= threshold:
                out[(min(a, b), max(a, b))] = s
    return out


def _classes_by_hand(rows, threshold=0.5):
    """(id, class, links) of each row, every row held against every other."""
    grams = [_grams(t) if t is not None else set() for _, t in rows]
    near = [{j for j, y in enumerate(grams) if j != i and x and y and 2 * len(x) >= len(y) and 2 * len(y) >= len(x) and len(x & y) >= threshold * len(x | y)} for i, x in enumerate(grams)]
    group = list(range(len(rows)))
    for i, others in enumerate(near):
        for j in others:
            low, high = sorted((group[i], group[j]))
            group = [low if g == high else g for g in group]
    first = defaultdict(list)
    for g, (i, _) in zip(group, rows):
        first[g] += [i] if i is not None else []
    return [(i, min(first[g], default=None), len(near[k])) for k, (g, (i, _)) in enumerate(zip(group, rows))]


def _variants(n=60):
    """Copies of three texts with more and more words changed."""
    rng = random.Random(7)
    words = [f"w{i}" for i in range(3000)]
    out = []
    for base in range(3):
        text = [rng.choice(words) for _ in range(300)]
        for k in range(n // 3):
            t = list(text)
            for _ in range(k):
                t[rng.randrange(len(t))] = rng.choice(words)
            out.append(" ".join(t))
    return out


def test_shingles_are_those_of_plain_loops():
    texts = ["a b c d e f", "A  b\nc\td e", "a b", "", None, " \n ", "a b c d e a b c d e a b c d e", "é É x y z é É"]
    grams, at = ngram_join.shingles(pa.array(texts))
    for i, t in enumerate(texts):
        assert at[i + 1] - at[i] == len(_grams(t or ""))
    grams, at = ngram_join.shingles(pa.array(texts), 5)
    assert at[1] == 2 and len(set(grams[at[3] : at[6]].tolist())) == 0
    assert grams[at[0]] in grams[at[1] : at[2]] or grams[at[0] + 1] in grams[at[1] : at[2]]


def test_posterior_of_a_pair():
    """least_matches against a numeric integral of the posterior."""
    for seen in (32, 64, 160):
        m = ngram_join.least_matches(0.5, 1e-3, seen)
        s = np.linspace(0, 1, 200_001)

        def tail(k):
            logs = k * np.log(np.maximum(s, 1e-300)) + (seen - k) * np.log(np.maximum(1 - s, 1e-300))
            d = np.exp(logs - logs.max())
            return d[s >= 0.5].sum() / d.sum()

        assert tail(m) >= 1e-3 * 0.99 and (m == 0 or tail(m - 1) < 1e-3 * 1.01)


def test_sketches_keep_what_may_be_alike():
    """Of many pairs at the threshold the sketches keep all but the tolerance and some chance; of unlike pairs they drop most."""
    rng = np.random.default_rng(1)
    least, kept = ngram_join.least_bits(0.5, 1e-3), []
    for same in (200, 6):  # of 300 grams each: similarity 0.5 and 0.01
        ok = 0
        for _ in range(60):
            common_ = rng.integers(0, 2**63, same, dtype=np.uint64)
            sets = [np.sort(np.concatenate([common_, rng.integers(0, 2**63, 300 - same, dtype=np.uint64)])) for _ in range(2)]
            sig = ngram_join.signatures(np.concatenate(sets) * np.uint64(2), np.array([0, 300, 600]))
            a, b = ngram_join.sketches(sig)
            ok += 64 - bin(int(a) ^ int(b)).count("1") >= least
        kept.append(ok)
    assert kept[0] >= 58 and kept[1] <= 25


def _rows(spark):
    rows = [(i, t) for i, t in enumerate(_variants())]
    rows += [(100 + r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    return rows + [(1000 + i, rows[0][1]) for i in range(25)] + [(2000, None), (2001, ""), (2002, "one two"), (2003, "one two"), (2003, "one two"), (None, "one two"), (None, rows[1][1])]


@pytest.mark.parametrize("params", [{}, {"block": 7}, {"block_bytes": 9000, "broadcast_rows": 0}])  # also with components cut into blocks, nothing broadcast
def test_pairs_and_classes_match_brute_force(spark, params):
    rows = _rows(spark)
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    want = _pairs_by_hand(rows)
    got = {(r["doc_a"], r["doc_b"]): r["jaccard"] for r in ngram_join.pairs(df, **params).collect()}
    assert all(abs(got[k] - want[k]) < 1e-12 for k in got)
    assert len(got) >= 0.95 * len(want)
    assert {k for k, s in want.items() if s > 0.65} <= got.keys()
    if len(got) == len(want):  # then the classes must be the same as by hand
        assert Counter(map(tuple, ngram_join.classes(df, **params).collect())) == Counter(_classes_by_hand(rows))


def test_classes_of_copies_and_ties(spark):
    """Hot copies, whose rows are counted with those that they are linked with, whatever the order of ids."""
    near = _variants(15)[:5]
    rows = [(50 - i, near[0]) for i in range(20)] + [(100 + i, t) for i, t in enumerate(near[1:])] + [(7, "alone here is a text of its own"), (7, "alone here is a text of its own")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert Counter(map(tuple, ngram_join.classes(df).collect())) == Counter(_classes_by_hand(rows))
    assert Counter(r["class_id"] for r in ngram_join.classes(df).collect()) == {31: 24, 7: 2}
    for broadcast_rows in (0, 1000):
        assert sorted(r["doc_id"] for r in ngram_join.keep_one(df, broadcast_rows=broadcast_rows).collect()) == [7, 7, 31]


def test_classes_of_odd_rows(spark):
    docs = odd_documents(spark).withColumns({"node": F.lit("own"), "key": F.lit(1)})
    assert ngram_join.pairs(docs).collect() == []
    assert Counter(map(tuple, ngram_join.classes(docs).collect())) == Counter(_classes_by_hand([(r["doc_id"], r["text"]) for r in docs.collect()]))
    assert ngram_join.classes(docs.limit(0)).count() == 0
    kept = ngram_join.keep_one(docs)
    assert kept.columns == docs.columns and sorted(map(str, kept.collect())) == sorted(str(r) for r in docs.collect() if r["doc_id"] != 2)


def test_one_document_of_repeated_ids_stays(spark):
    """An id in two classes, smallest of one only: each class keeps a document."""
    a, b = _variants(6)[0], _variants(6)[2]
    rows = [(5, a), (9, a), (5, b), (3, b)]
    kept = ngram_join.keep_one(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    assert sorted(map(tuple, kept)) == sorted([(5, a), (3, b)])


def test_recall_in_buckets_of_many_groups(spark):
    """All texts share a passage that fills their buckets; those of a group share more, at 0.5 to 0.6, and are found all the same."""
    rng = random.Random(11)
    passage = " ".join(f"p{i}" for i in range(150))
    rows = []
    for g in range(120):
        own = [f"g{g}x{k}" for k in range(110)]
        for v in range(4):
            text = list(own)
            for _ in range(9):
                text[rng.randrange(len(text))] = f"v{g}.{v}.{rng.randrange(10**6)}"
            rows.append((4 * g + v, passage + " " + " ".join(text)))
    want = _pairs_by_hand(rows)
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = {(r["doc_a"], r["doc_b"]) for r in ngram_join.pairs(df).collect()}
    assert got <= want.keys() and len(got) >= 0.97 * len(want) > 600


def _at_the_threshold(groups=300):
    """Pairs of texts that share 100 words in a row and have up to 49 others: similarity 0.5 and little more, 0.49 in every sixth."""
    rows = []
    for g in range(groups):
        shared = " ".join(f"s{g}x{k}" for k in range(100))
        a, b = (" ".join(f"{v}{g}x{k}" for k in range(49 - g % 5 if g % 6 else 51)) for v in "ab")
        rows += [(2 * g, f"{shared} {a}"), (2 * g + 1, f"{shared} {b}")]
    return rows


@pytest.mark.parametrize("params", [{}, {"part_bytes": 500, "broadcast_rows": 0}])  # also with many parts, nothing broadcast
def test_no_link_at_the_threshold_is_lost(spark, params):
    rows = _at_the_threshold()
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert Counter(map(tuple, ngram_join.classes(df, **params).collect())) == Counter(_classes_by_hand(rows))


def test_pairs_of_a_task_whatever_is_counted_at_once(monkeypatch):
    texts = _variants(40)
    task, side = np.repeat([0, 1], 20), np.tile([0, 1, -1, -1], 10)
    want = {(i, j) for i, j in _pairs_by_hand(enumerate(texts)) if task[i] == task[j] and (side[i] < 0 or side[i] != side[j])}
    for counted in (1, 300, ngram_join.COUNTED):
        monkeypatch.setattr(ngram_join, "COUNTED", counted)
        i, j, _ = ngram_join.like_pairs(pa.array(texts), task, side, 3, 0.5)
        assert set(zip(i.tolist(), j.tolist())) == want and len(i) == len(want) > 50


def _peak(run):
    """Bytes that *run* takes at most, besides what is there before."""
    tracemalloc.start()
    try:
        run()
        return tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()


def test_memory_of_the_kernels():
    """A worker's share of a small executor: per n-gram of a part, of a batch and of a task, and what is left after it."""
    rng = np.random.default_rng(3)
    codes, nodes = rng.integers(0, 2**32, 1_000_000, dtype=np.uint32), np.arange(1000)
    counts = np.stack([np.full(1000, 1000), np.zeros(1000, int), np.zeros(1000, int)])
    part = ngram_join._pack(np.zeros(1000, int), nodes, counts, codes)
    assert _peak(lambda: list(ngram_join._common(5, True)(iter([part])))) < 45 * len(codes)
    words = 250_000
    texts = pa.array([" ".join(f"w{x}" for x in rng.integers(0, 10**6, words // 500)) for _ in range(500)] * 4)
    batch = pa.RecordBatch.from_arrays([pa.array(np.arange(len(texts))), texts], names=["node", "text"])
    assert _peak(lambda: list(ngram_join._postings(3, 5)(iter([batch])))) < 47 * 4 * words
    few = texts.slice(0, 1000)
    assert _peak(lambda: ngram_join.like_pairs(few, np.zeros(1000, int), np.full(1000, -1), 3, 0.5)) < 95 * 2 * words


def test_a_task_gives_its_memory_back(monkeypatch):
    calls = []
    monkeypatch.setattr(common, "give_back", lambda: calls.append(1))
    batch = pa.RecordBatch.from_arrays([pa.array([1, 2]), pa.array(["a b c d", "a b c d"])], names=["node", "text"])
    rows = list(ngram_join._postings(3, 5)(iter([batch])))
    list(ngram_join._common(5, False)(iter(rows)))
    assert len(calls) == 2


def test_keep_one_leaves_one_of_each_group(spark):
    rows = [(i, t) for i, t in enumerate(_variants(30))] + [(100 + i, f"quite another text number {i} of no group at all " + " ".join(f"x{i}{j}" for j in range(30))) for i in range(10)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert sorted(r["doc_id"] for r in ngram_join.keep_one(df).collect()) == sorted({c for _, c, _ in _classes_by_hand(rows)})


def test_components(spark):
    chain = [(i, i + 1) for i in range(0, 40)] + [(100, 101), (103, 101), (200, 200)]
    labels = {r["node"]: r["label"] for r in ngram_join.components(spark.createDataFrame(chain, "a bigint, b bigint")).collect()}
    assert labels == {**{i: 0 for i in range(41)}, 100: 100, 101: 100, 103: 100, 200: 200}


@pytest.mark.parametrize("kind", ["bigint", "string"])
def test_few_edges_are_labelled_by_one_task(spark, monkeypatch, kind):
    """Two tables are written, however far apart nodes are; more edges go in rounds, to the same labels."""
    rng, written = random.Random(5), []
    monkeypatch.setattr(ngram_join, "stored", lambda df, purpose: written.append(purpose) or common.stored(df, purpose))
    name = (lambda x: f"n{x:03d}") if kind == "string" else int
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(170)] + [(k, k + 1) for k in range(400, 440)] + [(7, 7), (8, 9), (9, 8), (8, 9)]
    df = spark.createDataFrame([(name(a), name(b)) for a, b in edges], f"a {kind}, b {kind}")
    label = {x: x for e in edges for x in e}
    for _ in edges:
        for a, b in edges:
            label[a] = label[b] = min(label[a], label[b])
    want = sorted((name(x), name(y)) for x, y in label.items())
    assert sorted(map(tuple, ngram_join.components(df).collect())) == want
    assert written == ["edges", "labels"]
    assert sorted(map(tuple, ngram_join.components(df, alone=3).collect())) == want
    assert len(written) > 6
    assert ngram_join.components(df.limit(0)).collect() == []


@pytest.mark.parametrize("params", [{}, {"block": 7}])
def test_classes_whatever_edges_a_task_takes(spark, params):
    rows = [(i, t) for i, t in enumerate(_variants(30))]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    for alone in (0, ngram_join.ALONE):
        assert Counter(map(tuple, ngram_join.classes(df, alone=alone, **params).collect())) == Counter(_classes_by_hand(rows))


# Exact dedup


def test_index_over_batches(spark):
    index = exact_dedup.DigestIndex(spark, common.shared_dir(spark, "index"), buckets=4)
    first = spark.createDataFrame([(3, "a"), (1, "a"), (2, "b"), (None, "c"), (9, None), (4, ""), (5, "")], "doc_id bigint, text string")
    admitted, rejected = index.ingest(first)
    assert sorted((r["doc_id"] or 0) for r in admitted.collect()) == [0, 1, 2, 4]
    assert sorted(r["doc_id"] for r in rejected.where("all").collect()) == [3, 5]
    second = spark.createDataFrame([(0, "a"), (6, "d"), (7, "d"), (8, "b")], "doc_id bigint, text string")
    assert [r["doc_id"] for r in index.ingest(second)[0].collect()] == [6]
    assert index.ingest(second)[0].count() == 0
    index.compact()
    again = exact_dedup.DigestIndex(spark, index.path, buckets=4)  # as another session finds it
    got = {(bytes(r["digest"]), r["doc_id"]) for r in again.table().collect()}
    assert got == {(hashlib.sha256(t.encode()).digest(), i) for i, t in ((1, "a"), (2, "b"), (None, "c"), (4, ""), (6, "d"))}
    assert "Exchange" not in index.table().groupBy("digest").count()._jdf.queryExecution().sparkPlan().toString()


def test_keep_first_of_odd_rows(spark):
    docs = odd_documents(spark)
    kept = exact_dedup.keep_first(docs)
    assert kept.columns == docs.columns
    rows = sorted(((r["doc_id"], r["text"]) for r in kept.collect()), key=str)
    assert rows == sorted([(1, "the house and the garden"), (3, None), (4, ""), (5, "   \n\t"), (6, LONG), (7, "%%% 123 $$$")], key=str)
    assert exact_dedup.keep_first(docs.limit(0)).count() == 0
    index = exact_dedup.DigestIndex(spark, common.shared_dir(spark, "index"), buckets=4)
    _, rejected = index.ingest(docs)
    assert sorted(map(str, exact_dedup.select_rows(docs, rejected, broadcast_rows=0).collect())) == sorted(map(str, kept.collect()))


# Mixing


def _mix_by_hand(rows, budgets=(0.25, 0.5, 1.0), weights=None):
    tokens = lambda t: len([w for w in (t or "").replace("\t", " ").replace("\n", " ").replace("\r", " ").split(" ") if w])
    have = Counter()
    for _, t, s in rows:
        have[s] += tokens(t)
    w = {s: float(math.floor(math.sqrt(n))) if weights is None else float(weights.get(s, 0)) for s, n in have.items()}
    unit = min((have[s] / w[s] for s in have if w[s] > 0), default=None)
    out = []
    for source in have:
        own = [(int(hashlib.md5(("" if i is None else str(i)).encode()).hexdigest()[:12], 16), i, t) for i, t, s in rows if s == source]
        for h, i, t in own:
            upto = sum(tokens(x) for g, _, x in own if g <= h)
            tier = next((b for b in budgets if upto <= math.floor((b * unit * w[source]) if unit is not None else 0)), None)
            if tier is not None:
                out.append((i, source, tokens(t), tier))
    return out


def test_mix_matches_sorting(spark):
    rng = random.Random(3)
    rows = [(i, " ".join("x" for _ in range(rng.randrange(0, 40))), rng.choice(["a", "a", "a", "a", "b", "c", None])) for i in range(400)]
    rows += [(None, "x y", "b"), (None, "x y z", "b"), (5, None, "a"), (6, "", "c"), (rows[7])]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    got = Counter((r["doc_id"], r["source"], r["tokens"], r["tier"]) for r in mixing.mix(df).collect())
    assert got == Counter(_mix_by_hand(rows))
    got = Counter((r["doc_id"], r["source"], r["tokens"], r["tier"]) for r in mixing.mix(df, weights={"a": 1, "b": 2}, budgets=[0.3]).collect())
    assert got == Counter(_mix_by_hand(rows, [0.3], {"a": 1, "b": 2}))


def test_short_sources_give_all_and_leave_the_rest_to_others(spark):
    import corpus_pipeline

    rows = [(i, "x " * 20, "abcd"[i % 4]) for i in range(400)] + [(400, "x y", "tiny"), (401, "x", None)]
    have = {"a": 2000, "b": 2000, "c": 2000, "d": 2000, "tiny": 2, None: 1}
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    kept = corpus_pipeline.mix(spark, docs, SF).groupBy("source").agg(F.sum(mixing.token_count(F.col("text"))).alias("n"))
    kept = {r["source"]: r["n"] for r in kept.collect()}
    assert kept.keys() == have.keys() and kept["tiny"] == 2 and kept[None] == 1
    assert 0.74 * 8003 < sum(kept.values()) <= 0.75 * 8003
    counts = spark.createDataFrame([("a", 900), ("b", 100), ("c", 10), ("d", 5)], "source string, tokens bigint")
    for fill, weights, want in [
        (0.5, {"a": 3, "b": 1, "c": 1}, {"a": 395, "b": 100, "c": 10, "d": 0}),
        (1.0, {"a": 3, "b": 1, "c": 1, "d": 7}, {"a": 900, "b": 100, "c": 10, "d": 5}),
        (0.0, {"a": 3, "b": 1, "c": 1}, {"a": 30, "b": 10, "c": 10, "d": 0}),
    ]:
        assert {r["source"]: r["budget"] for r in mixing.targets(counts, [1.0], weights, fill).collect()} == want


def test_mix_of_odd_rows(spark):
    docs = odd_documents(spark)
    out = mixing.mix(docs)
    assert out.columns == [*docs.columns, "tier_", "tokens_"]
    assert mixing.sample(docs).columns == docs.columns
    assert mixing.mix(docs.limit(0)).count() == 0
    assert mixing.mix(docs, weights={}).where("tokens_ > 0").count() == 0


def test_samples_nest_and_fill_their_budgets(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    out = mixing.mix(docs).groupBy("source").agg(*[F.sum(F.when(F.col("tier") <= b, F.col("tokens")).otherwise(0)).alias(str(int(b * 100))) for b in mixing.BUDGETS])
    rows = mixing.targets(docs.select("source", mixing.token_count(F.col("text")).alias("tokens"))).collect()
    want = {(r["source"], str(int(r["share"] * 100))): r["budget"] for r in rows}
    for r in out.collect():
        assert r["25"] <= r["50"] <= r["100"]
        for k in ("25", "50", "100"):
            assert r[k] <= want[(r["source"], k)]
        assert r["100"] > 0.8 * want[(r["source"], "100")]


# Context-tree weighting


def _ctw_by_hand(texts, depth):
    counts = defaultdict(lambda: [0, 0])

    def steps(t):
        b = b"\0" * depth + t.encode()
        for i in range(depth, len(b)):
            node = 1
            for j in range(7, -1, -1):
                bit = b[i] >> j & 1
                yield b[i - depth : i], node, bit
                node = node * 2 + bit

    for t in texts:
        for c, n, bit in steps(t or ""):
            for k in range(depth + 1):
                counts[(c[depth - k :], n)][bit] += 1
    deeper = defaultdict(set)
    for c, n in counts:
        if c:
            deeper[(c[1:], n)].add(c)
    kt = lambda a, b: math.lgamma(a + 0.5) + math.lgamma(b + 0.5) - math.lgamma(a + b + 1) - math.log(math.pi)

    @lru_cache(None)
    def weighted(c, n):
        own = kt(*counts[(c, n)])
        return own if len(c) == depth else float(np.logaddexp(own, sum(weighted(k, n) for k in deeper[(c, n)]))) - math.log(2)

    def chance(c, n, k=0):
        s = c[depth - k :]
        a, b = counts[(s, n)]
        q = (b + 0.5) / (a + b + 1)
        if k == depth:
            return q
        w = math.exp(math.log(0.5) + kt(a, b) - weighted(s, n))
        return w * q + (1 - w) * chance(c, n, k + 1)

    return [None if t is None else sum(-math.log2(chance(c, n) if bit else 1 - chance(c, n)) for c, n, bit in steps(t)) for t in texts]


@pytest.mark.parametrize("depth", [2, 3, 5])
def test_code_lengths_match_the_recursion(spark, depth):
    texts = ["abracadabra abracadabra", "the cat sat on the mat", "é", "", None, "abracadabra", "the cat sat on the mat", "x" * 40]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    want = _ctw_by_hand(texts, depth)
    for most in (ctw.MAPPED_GRAMS, 0):
        got = {r["doc_id"]: r for r in ctw.score(df, depth=depth, mapped_grams=most).collect()}
        for i, t in enumerate(texts):
            assert got[i]["n_bytes"] == (None if t is None else len(t.encode()))
            assert got[i]["code_bits"] == (None if t is None else pytest.approx(want[i], rel=1e-7))
            assert got[i]["bits_per_byte"] == (pytest.approx(want[i] / len(t.encode())) if t else None)


def test_default_scores_know_dependences_of_six_bytes(spark):
    texts = [f"{c}same-{c}" for c in "abcdefgh"] * 5
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    want, shallow = _ctw_by_hand(texts, 6), _ctw_by_hand(texts, 3)
    got = {r["doc_id"]: r["code_bits"] for r in ctw.score(df).collect()}
    assert all(got[i] == pytest.approx(want[i], rel=1e-7) for i in got)
    assert sum(got.values()) < 0.9 * sum(shallow)


def test_scores_of_odd_rows_and_of_noise(spark):
    docs = odd_documents(spark)
    out = ctw.score(docs)
    assert out.columns == [*docs.columns, "n_bytes", "code_bits", "bits_per_byte_"]
    assert ctw.score(docs.limit(0)).count() == 0
    rng = random.Random(1)
    noise = "".join(rng.choice("abcdefghijklmnopqrstuvwxyz0123456789") for _ in range(900))
    corpus = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").unionByName(spark.createDataFrame([(-1, noise)], "doc_id bigint, text string"))
    rows = {r["doc_id"]: r["bits_per_byte"] for r in ctw.score(corpus).collect()}
    assert rows[-1] > 1.3 * sorted(rows.values())[len(rows) // 2]


# Co-training


def test_naive_bayes_counts_and_bins():
    texts = ["The cat sat. The cat ran.", "BUY!! NOW!! $$$ %%%", "a | b | c", "", None, "x x x x\ny\ny"]
    bins = cotrain.text_bins(pa.array(texts))
    name = dict(zip(cotrain.TEXT_FEATURES, bins.T))
    assert name["upper"].argmax() == 1 and name["shouts"].argmax() == 1 and name["pipes"].argmax() == 2 and name["same_words"].argmax() == 5
    assert not bins[3].any() and not bins[4].any() and bins.max() < cotrain.BINS
    label = np.array([1, 0, 0, 1, 1, 0])
    counts = cotrain.count("text", bins, label)
    for i, f in enumerate(cotrain.TEXT_FEATURES):
        for v in range(cotrain.BINS):
            for c in (0, 1):
                assert counts[i * cotrain.BINS + v, c] == sum(1 for b, y in zip(bins, label) if b[i] == v and y == c)
    odds = cotrain.odds("text", counts)
    v = bins[1][0]
    assert odds[v] == pytest.approx(math.log((counts[v, 1] + 1 / 16) / 4) - math.log((counts[v, 0] + 1 / 16) / 4))


def test_quality_on_held_out_labels(spark):
    """A third of the labels is hidden from training."""
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    held = F.pmod(F.xxhash64("doc_id", F.lit(99)), F.lit(3)) == 0
    scores = cotrain.score(docs, labels.where(~held))
    rows = scores.join(labels.where(held), "doc_id").toPandas()
    assert len(rows) > 1000
    assert ((rows["score"] >= 0.5) == (rows["quality"] == 1)).mean() > 0.97
    bad, good = rows[rows["quality"] == 0]["score"], rows[rows["quality"] == 1]["score"]
    assert np.mean([(good > b).mean() + (good == b).mean() / 2 for b in bad]) > 0.98
    assert scores.count() == docs.count()


def test_pseudo_labels_count_every_unlabelled_row(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    rows = cotrain.features(docs, labels)
    model = cotrain.train(rows, rounds=1)
    views = {"text": model.text, "meta": model.meta}
    got = rows.where("label is null").select("text_bins", "meta_bins").mapInArrow(cotrain._pseudo(views, 0.9), "view string, at int, n double").groupBy("view", "at").agg(F.sum("n").alias("n")).toPandas()
    local = rows.where("label is null").toPandas()
    text, meta = np.array(local["text_bins"].tolist()), np.array(local["meta_bins"].tolist())
    a, b = model.text.logit(text), model.meta.logit(meta)
    limit = math.log(9)
    sure = (np.abs(a) >= limit) & ~((np.abs(b) >= limit) & (np.sign(a) != np.sign(b)))
    want = cotrain.count("meta", meta[sure], (a[sure] > 0).astype(int)).ravel()
    part = got[got["view"] == "meta"]
    mine = np.zeros(len(want))
    mine[part["at"]] = part["n"]
    assert (mine == want).all() and want.sum() > 0


def test_quality_of_odd_rows(spark):
    docs, labels = odd_documents(spark), spark.read.parquet(f"{SF}/labels.parquet")
    none = cotrain.score(docs, labels.limit(0)).collect()
    assert len(none) == docs.count() and all(r["score"] is None and r["good"] for r in none)
    everything = spark.read.parquet(f"{SF}/documents.parquet").unionByName(docs.select("doc_id", "text", "lang", "source", "n_chars"))
    rows = cotrain.score(everything, labels.unionByName(labels)).collect()
    assert len(rows) == everything.count() and all(0 <= r["score"] <= 1 for r in rows)
    assert cotrain.score(docs.limit(0), labels).count() == 0


# Oracle SQL and the pipeline


def test_oracles(spark):
    from tierlens.llm.queries import ORACLES, QUERIES

    c = duckdb.connect()
    for t in ("documents", "benchmark"):
        c.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    for name, sql in ORACLES.items():
        want = c.sql(sql)
        got = QUERIES[name](spark, SF)
        order = [got.columns.index(x) for x in want.columns]
        assert sorted((tuple(r[i] for i in order) for r in got.collect()), key=str) == sorted(want.fetchall(), key=str)


def test_pipeline_stage_by_stage(spark, tmp_path):
    import corpus_pipeline
    from tierlens.llm import langid, piece_fst
    from tierlens.llm.queries import PIECE_MODEL

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language", "exact", "near", "mix", "tokens"]
    rows = [(r["doc_id"], r["text"], r["source"]) for r in docs.collect()]
    pi, n = langid.proportions(pa.array([t for _, t, _ in rows]), langid.train(docs))
    rows = [r for r, p, k in zip(rows, pi, n) if k and round(float(p[-1]), 4) <= 0.5]
    first = {}
    for i, t, s in sorted(rows):
        first.setdefault(t, (i, t, s))
    rows = list(first.values())
    group = {i: i for i, _, _ in rows}
    for a, b in sorted(_pairs_by_hand([(i, t) for i, t, _ in rows])):
        low, high = sorted((group[a], group[b]))
        group = {k: low if v == high else v for k, v in group.items()}
    rows = [r for r in rows if group[r[0]] == r[0]]
    kept = {i for i, *_ in _mix_by_hand(rows)}
    fst = piece_fst.transducer(PIECE_MODEL)
    want = {i: fst.encode(t) for i, t, _ in rows if i in kept}
    got = {r["doc_id"]: r["ids"] for r in corpus_pipeline.run(spark, SF).collect()}
    assert len(got.keys() & want.keys()) > 0.97 * len(want) and all(got[i] == want[i] for i in got.keys() & want.keys())


def test_pipeline_keeps_one_of_each_pair_at_the_threshold(spark):
    import corpus_pipeline

    rows = _at_the_threshold()
    kept = corpus_pipeline.near(spark, spark.createDataFrame(rows, "doc_id bigint, text string"), SF)
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted({c for _, c, _ in _classes_by_hand(rows)})


def test_pipeline_of_odd_rows(spark):
    import corpus_pipeline

    docs = odd_documents(spark)
    for name, stage in corpus_pipeline.STAGES:
        empty = stage(spark, docs.limit(0), SF)
        assert empty.count() == 0
        out = common.stored(stage(spark, docs, SF), "stage")
        if name != "tokens":
            assert out.columns == docs.columns
            docs = out
        assert out.count() > 0
