"""Language ID: which languages a document mixes, and in which proportions.

A document is a bag of byte trigrams drawn from a mixture of language profiles
and a flat background.  Expectation-maximisation finds the proportions; the
set of languages is the one with the best penalised likelihood on the path of
backward elimination.  Everything but the profiles is one Arrow pass without a
shuffle, so the plan is the same at any size.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import by_bytes, flat, fresh, slices

UNKNOWN = "und"
#: Trigrams of 40 usual letter bytes; the background spreads evenly over that many.
BACKGROUND = 40**3
RESULT = "struct<lang:string,share:double,mixture:array<struct<lang:string,share:double>>,n_grams:bigint,rejected:boolean>"

# ASCII that isn't a letter becomes a space; bytes of longer UTF-8 sequences stay.
_CLASS = np.full(256, 32, np.uint8)
_CLASS[97:123] = np.arange(97, 123)
_CLASS[65:91] = np.arange(97, 123)
_CLASS[128:] = np.arange(128, 256)


@dataclass(frozen=True)
class Profiles:
    """Trigram probabilities: ``prob[f, k]`` for feature f (0: any other trigram) and component k, the last being the background."""

    langs: tuple[str, ...]
    codes: np.ndarray
    prob: np.ndarray


def trigrams(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(24-bit code, text number) of every byte trigram that lies in one text and has no two spaces in a row."""
    raw, at = flat(pc.utf8_lower(texts))
    none = np.zeros(0, np.int32)
    if len(raw) < 3:
        return none, none
    b = _CLASS[raw]
    owner = np.repeat(np.arange(len(texts), dtype=np.int32), np.diff(at))
    w = b.astype(np.int32)
    code = (w[:-2] << 16) | (w[1:-1] << 8) | w[2:]
    space = b == 32
    ok = owner[:-2] == owner[2:]
    ok &= ~(space[1:-1] & (space[:-2] | space[2:]))
    return code[ok], owner[:-2][ok]


def train(docs: DataFrame, text: str = "text", label: str = "lang", per_lang: int = 500, features: int = 2048, smooth: float = 0.5) -> Profiles:
    """Fit the profiles on about *per_lang* labelled documents of each language.

    The sample is those whose hash lies under the share that *per_lang* is of
    the language's documents, whole texts each.  Rows without label or text
    don't count.  A table without labelled rows gives profiles of no language;
    every document is then of the unknown language and rejected.
    """
    d = docs.select(F.col(label).alias("g"), F.col(text).alias("t")).where("g is not null and t is not null")
    sizes = {r["g"]: r["n"] for r in docs.groupBy(F.col(label).alias("g")).agg(F.count(F.lit(1)).alias("n")).where("g is not null").collect()}
    if not sizes:
        return Profiles((), np.zeros(0, np.int32), np.ones((1, 1), np.float32))
    share = F.create_map(*[x for g, n in sizes.items() for x in (F.lit(g), F.lit(min(1.0, per_lang / n)))])
    sample = d.where(F.pmod(F.xxhash64("t"), F.lit(1 << 20)) < F.element_at(share, F.col("g")) * (1 << 20))

    def count(batches):
        for batch in batches:
            for g in batch.column(0).unique().to_pylist():
                own = batch.column(1).filter(pc.equal(batch.column(0), g))
                for part in slices(own):
                    code, n = np.unique(trigrams(part)[0], return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array([g] * len(code), pa.string()), pa.array(code, pa.int32()), pa.array(n, pa.int64())], names=["g", "code", "n"])

    rows = sample.mapInArrow(count, "g string, code int, n bigint").groupBy("g", "code").agg(F.sum("n").alias("n")).toPandas()
    langs = tuple(sorted(set(rows["g"])))
    if not langs:
        return Profiles((), np.zeros(0, np.int32), np.ones((1, 1), np.float32))
    codes, inverse = np.unique(rows["code"].to_numpy(np.int32), return_inverse=True)
    counts = np.zeros((len(codes), len(langs)))
    np.add.at(counts, (inverse, rows["g"].map(langs.index).to_numpy()), rows["n"].to_numpy(float))
    weight = (counts / counts.sum(0)).max(1)
    keep = np.sort(np.lexsort((codes, -weight))[: features - 1])
    full = np.vstack([counts.sum(0) - counts[keep].sum(0), counts[keep]]) + smooth
    flat_share = np.full((len(full), 1), 1 / BACKGROUND)
    flat_share[0] = 1 - len(keep) / BACKGROUND
    return Profiles(langs, codes[keep], np.hstack([full / full.sum(0), flat_share]).astype(np.float32))


def fit(counts: np.ndarray, prob: np.ndarray, rounds: int = 12) -> np.ndarray:
    """Proportions [documents, components] of the best set, from trigram counts [documents, features].

    Starts from all components and drops the smallest of a document, one at a
    time; of the fits passed on the way it takes the one with the largest
    ``log-likelihood / 3 - (size - 1) / 2 * log(trigrams)``: neighbouring
    trigrams overlap, so three count as one observation.  Ties go to the
    smaller set.
    """
    n = counts.sum(1)
    k = prob.shape[1]
    pi = np.full((len(counts), k), 1 / k, np.float32)
    best, best_score = pi.copy(), np.full(len(counts), -np.inf)
    size = np.maximum(n, 1).astype(np.float32)
    for active in range(k, 0, -1):
        for _ in range(rounds if active > 1 else 0):
            ratio = counts / np.maximum(pi @ prob.T, 1e-30)
            pi = pi * (ratio @ prob) / size[:, None]
        total = pi.sum(1, keepdims=True)
        pi = np.where(total > 0, pi / np.maximum(total, 1e-30), pi)
        score = (counts * np.log(np.maximum(pi @ prob.T, 1e-30))).sum(1) / 3 - (active - 1) / 2 * np.log(size)
        better = score >= best_score
        best[better], best_score[better] = pi[better], score[better]
        if active > 1:
            alive = np.where(pi > 0, pi, np.inf)
            pi[np.arange(len(pi)), alive.argmin(1)] = 0
            total = pi.sum(1, keepdims=True)
            pi = np.where(total > 0, pi / np.maximum(total, 1e-30), pi)
    return best


_TABLE: dict[bytes, np.ndarray] = {}


def _lookup(codes: np.ndarray) -> np.ndarray:
    """Feature number of every 24-bit code."""
    key = codes.tobytes()
    if key not in _TABLE:
        _TABLE.clear()
        table = np.zeros(1 << 24, np.int16)
        table[codes] = np.arange(1, len(codes) + 1)
        _TABLE[key] = table
    return _TABLE[key]


def proportions(texts: pa.Array, profiles: Profiles) -> tuple[np.ndarray, np.ndarray]:
    """(proportions, trigrams) of each text."""
    v = len(profiles.prob)
    table = _lookup(profiles.codes)
    shares, sizes = [], []
    for part in slices(texts, 1 << 20):
        for start in range(0, len(part), 256):
            own = part.slice(start, 256)
            code, owner = trigrams(own)
            counts = np.bincount(owner.astype(np.int64) * v + table[code], minlength=len(own) * v).reshape(len(own), v).astype(np.float32)
            shares.append(fit(counts, profiles.prob))
            sizes.append(counts.sum(1).astype(np.int64))
    k = profiles.prob.shape[1]
    return (np.vstack(shares), np.concatenate(sizes)) if shares else (np.zeros((0, k), np.float32), np.zeros(0, np.int64))


def identify(text: Column, profiles: Profiles, reject_share: float = 0.5) -> Column:
    """Struct of lang, share, mixture, n_grams and rejected for a text column.

    ``lang`` is the language with the largest share (ties: the first by name),
    ``mixture`` the selected languages by falling share, rounded to four
    places.  A text without trigrams (null, empty, no letters) is of language
    "und" with share 1 and an empty mixture.  Rejected are those and the ones
    whose background share exceeds *reject_share*.
    """
    names = np.array([*profiles.langs, UNKNOWN], dtype=object)

    def run(texts: pa.Array) -> pa.Array:
        pi, n = proportions(texts, profiles)
        out = []
        for row, size in zip(np.round(pi.astype(float), 4), n.tolist()):
            if not size:
                out.append({"lang": UNKNOWN, "share": 1.0, "mixture": [], "n_grams": 0, "rejected": True})
                continue
            order = sorted((k for k in range(len(names)) if row[k] > 0), key=lambda k: (-row[k], k))
            mixture = [{"lang": names[k], "share": float(row[k])} for k in order]
            out.append({"lang": mixture[0]["lang"], "share": mixture[0]["share"], "mixture": mixture, "n_grams": size, "rejected": bool(row[-1] > reject_share)})
        kind = pa.struct([("lang", pa.string()), ("share", pa.float64()), ("mixture", pa.list_(pa.struct([("lang", pa.string()), ("share", pa.float64())]))), ("n_grams", pa.int64()), ("rejected", pa.bool_())])
        return pa.array(out, kind)

    return F.arrow_udf(run, RESULT)(text)


def detect(docs: DataFrame, profiles: Profiles, text: str = "text", reject_share: float = 0.5) -> DataFrame:
    """*docs* with a struct column ``language`` (see :func:`identify`); a column of that name keeps its own and the new one gets underscores appended."""
    return by_bytes(docs).withColumn(fresh(docs, "language"), identify(F.col(text), profiles, reject_share))


def keep_known(docs: DataFrame, profiles: Profiles, text: str = "text", reject_share: float = 0.5) -> DataFrame:
    """The rows of *docs* that aren't rejected, with the columns of *docs*."""
    name = fresh(docs, "language")
    return by_bytes(docs).withColumn(name, identify(F.col(text), profiles, reject_share)).where(~F.col(f"`{name}`.rejected")).drop(name)
