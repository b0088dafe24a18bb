"""Quality classifier by co-training.

Two views of a document each have a naive Bayes classifier over binned
features: the text's content, and the page's metadata.  Over some rounds each
view labels the unlabelled documents that it is sure of, for the other view to
learn from; then the views are calibrated and combined.  The labelled sample
is bounded and sits on the driver.  All unlabelled documents take part in
every round: a round is one pass over their small feature rows that returns
counts by feature and class, of a fixed size.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import NEWLINE, WHITE, by_bytes, flat, parts, slices, stored

BINS = 16
TEXT_FEATURES = ("upper", "symbols", "digits", "beyond_ascii", "pipes", "shouts", "marks", "stops", "word_length", "lines", "new_words", "same_words", "same_lines")
#: Sizes of the metadata features: source and language by hash, length by powers of two; the last value of each is null.
META_SIZES = (1024, 256, 32)
LABELLED, ROUNDS, SURE = 200_000, 4, 0.97

_CLASS = np.zeros(256, np.int64)
_CLASS[65:91], _CLASS[97:123], _CLASS[48:58], _CLASS[128:] = 1, 2, 3, 4
for _c, _k in ((b"|", 5), (b"!", 6), (b"#$%&*@^~", 7), (b".", 8)):
    _CLASS[list(_c)] = _k


def text_bins(texts: pa.Array) -> np.ndarray:
    """Bins [texts, features] of shares of characters, words and lines; all 0 for null and empty texts."""
    rows = [np.zeros((0, len(TEXT_FEATURES)), np.int64)]
    for part in slices(texts):
        raw, at = flat(part)
        n = len(part)
        out = np.zeros((n, len(TEXT_FEATURES)))
        if len(raw):
            owner = np.repeat(np.arange(n), np.diff(at))
            c = np.bincount(owner * 9 + _CLASS[raw], minlength=9 * n).reshape(n, 9).astype(float)
            size, letters = np.maximum(np.diff(at), 1), np.maximum(c[:, 1] + c[:, 2], 1)
            words, begin = parts(raw, at, WHITE)
            lines, line_begin = parts(raw, at, NEWLINE)
            count, line_count = np.maximum(np.diff(begin), 1), np.maximum(np.diff(line_begin), 1)
            whose = np.repeat(np.arange(n), np.diff(begin))
            again = np.zeros(len(words), bool)
            again[1:] = (words[1:] == words[:-1]) & (whose[1:] == whose[:-1])
            share = [c[:, 1] / letters, (c[:, 5] + c[:, 6] + c[:, 7]) / size, c[:, 3] / size, c[:, 4] / size, c[:, 5] / size, c[:, 6] / size, c[:, 7] / size, c[:, 8] / size]
            share += [np.minimum(size / count / 15, 1) ** 2, line_count / count, _distinct(words, begin) / count, np.bincount(whose[again], minlength=n) / count, 1 - _distinct(lines, line_begin) / line_count]
            out = np.sqrt(np.clip(np.stack(share, 1), 0, 1)) * (BINS - 1)
            out[np.diff(at) == 0] = 0
        rows.append(np.rint(out).astype(np.int64))
    return np.concatenate(rows)


def _distinct(hashes: np.ndarray, begin: np.ndarray) -> np.ndarray:
    owner = np.repeat(np.arange(len(begin) - 1), np.diff(begin))
    order = np.lexsort((hashes, owner))
    h, o = hashes[order], owner[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (o[1:] != o[:-1])
    return np.bincount(o[new], minlength=len(begin) - 1)


def _text_column(text: Column) -> Column:
    def run(texts: pa.Array) -> pa.Array:
        bins = text_bins(texts)
        return pa.ListArray.from_arrays(pa.array(np.arange(len(bins) + 1, dtype=np.int32) * bins.shape[1]), pa.array(bins.ravel().astype(np.int16)))

    return F.arrow_udf(run, "array<smallint>")(text)


def _meta_column(source: Column, lang: Column, size: Column) -> Column:
    def bucket(c: Column, n: int) -> Column:
        return F.when(c.isNull(), n - 1).otherwise(F.pmod(F.xxhash64(c), F.lit(n - 1)))

    length = F.when(size.isNull() | (size < 0), META_SIZES[2] - 1).otherwise(F.least(F.lit(META_SIZES[2] - 2), F.floor(F.log2(size + 1))))
    return F.array(*[c.cast("smallint") for c in (bucket(source, META_SIZES[0]), bucket(lang, META_SIZES[1]), length)])


_OFFSETS = {"text": np.arange(len(TEXT_FEATURES)) * BINS, "meta": np.concatenate([[0], np.cumsum(META_SIZES)[:-1]])}
_SIZES = {"text": len(TEXT_FEATURES) * BINS, "meta": sum(META_SIZES)}


@dataclass(frozen=True)
class View:
    """Naive Bayes log-odds of each feature value, and the line that turns their sum into a calibrated logit."""

    name: str
    odds: np.ndarray
    slope: float = 1.0
    shift: float = 0.0

    def logit(self, bins: np.ndarray) -> np.ndarray:
        return self.slope * self.odds[bins + _OFFSETS[self.name]].sum(1) + self.shift


def count(view: str, bins: np.ndarray, label: np.ndarray) -> np.ndarray:
    """Counts [values, classes]."""
    index = (bins + _OFFSETS[view]) * 2 + label[:, None]
    return np.bincount(index.ravel(), minlength=2 * _SIZES[view]).reshape(-1, 2).astype(float)


def odds(view: str, counts: np.ndarray) -> np.ndarray:
    """Log-odds of the values; each feature's are smoothed by one count spread over its values."""
    starts = np.append(_OFFSETS[view], _SIZES[view])
    out = np.zeros(len(counts))
    for s, e in zip(starts, starts[1:]):
        part = counts[s:e] + 1 / (e - s)
        out[s:e] = np.log(part[:, 1] / part[:, 1].sum()) - np.log(part[:, 0] / part[:, 0].sum())
    return out


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2, rounds: int = 30) -> np.ndarray:
    """Weights of the columns of *x* and, last, the intercept, by Newton's method."""
    x = np.column_stack([x, np.ones(len(x))])
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w)), x.T @ (y - p) - ridge * w)
        w += step
        if np.abs(step).max() < 1e-9:
            break
    return w


def _calibrated(view: str, counts: np.ndarray, bins: np.ndarray, label: np.ndarray) -> View:
    raw = View(view, odds(view, counts))
    slope, shift = logistic(raw.logit(bins)[:, None], label)
    return View(view, raw.odds, float(slope), float(shift))


def _matrix(lists: pa.Array, width: int) -> np.ndarray:
    return lists.flatten().to_numpy(zero_copy_only=False).reshape(-1, width).astype(np.int64)


def _pseudo(views: dict[str, View], sure: float):
    """A pass over unlabelled rows: what each view is sure of, as counts (view that learns, index, n)."""
    limit = float(np.log(sure / (1 - sure)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = {v: np.zeros((_SIZES[v], 2)) for v in views}
        for batch in batches:
            bins = {"text": _matrix(batch.column(0), len(TEXT_FEATURES)), "meta": _matrix(batch.column(1), len(META_SIZES))}
            logit = {v: views[v].logit(bins[v]) for v in views}
            for teacher, learner in (("text", "meta"), ("meta", "text")):
                ok = (np.abs(logit[teacher]) >= limit) & ~((np.abs(logit[learner]) >= limit) & (np.sign(logit[learner]) != np.sign(logit[teacher])))
                total[learner] += count(learner, bins[learner][ok], (logit[teacher][ok] > 0).astype(np.int64))
        for v, t in total.items():
            at = np.flatnonzero(t.ravel())
            yield pa.RecordBatch.from_arrays([pa.array([v] * len(at), pa.string()), pa.array(at.astype(np.int32)), pa.array(t.ravel()[at])], names=["view", "at", "n"])

    return run


@dataclass(frozen=True)
class Model:
    """Both calibrated views and the weights of their logits; None if the labels lack a class."""

    text: View
    meta: View
    weights: np.ndarray


def train(rows: DataFrame, labelled: int = LABELLED, rounds: int = ROUNDS, sure: float = SURE) -> Model | None:
    """Fit on rows of (id, text_bins, meta_bins, label); unlabelled rows have a null label.

    About *labelled* labelled rows, by hash of the id, serve as the sample:
    seven in ten to count, the others to calibrate and combine.  Pseudo-labels
    together weigh as much as the labels of their class.
    """
    known = rows.where("label is not null")
    n = known.count()
    share = min(1.0, labelled / n) if n else 1.0
    sample = known.where(F.pmod(F.xxhash64("id"), F.lit(1 << 20)) < share * (1 << 20)).select("text_bins", "meta_bins", "label", F.pmod(F.xxhash64("id", F.lit(7)), F.lit(10)).alias("fold")).orderBy("id").toArrow().combine_chunks()
    if not sample.num_rows:
        return None
    one = lambda name: sample[name].combine_chunks() if isinstance(sample[name], pa.ChunkedArray) else sample[name]
    y, fit = one("label").to_numpy().astype(np.int64), one("fold").to_numpy() < 7
    bins = {"text": _matrix(one("text_bins"), len(TEXT_FEATURES)), "meta": _matrix(one("meta_bins"), len(META_SIZES))}
    if min(np.bincount(y[fit], minlength=2).min(), np.bincount(y[~fit], minlength=2).min()) == 0:
        return None
    own = {v: count(v, bins[v][fit], y[fit]) for v in bins}
    learned = dict(own)
    for r in range(rounds + 1):
        views = {v: _calibrated(v, learned[v], bins[v][~fit], y[~fit]) for v in bins}
        if r == rounds:
            break
        got = rows.where("label is null").select("text_bins", "meta_bins").mapInArrow(_pseudo(views, sure), "view string, at int, n double").groupBy("view", "at").agg(F.sum("n").alias("n")).toPandas()
        for v in bins:
            extra = np.zeros(2 * _SIZES[v])
            part = got[got["view"] == v]
            extra[part["at"].to_numpy(np.int64)] = part["n"].to_numpy()
            extra = extra.reshape(-1, 2)
            learned[v] = own[v] + extra * (own[v].sum(0) / np.maximum(extra.sum(0), 1))
    logits = np.column_stack([views[v].logit(bins[v][~fit]) for v in ("text", "meta")])
    return Model(views["text"], views["meta"], logistic(logits, y[~fit]))


def features(docs: DataFrame, labels: DataFrame, label: str = "quality", doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, text_bins, meta_bins, label) of all documents; ids with labels of both classes count as unlabelled."""
    given = labels.where(F.col(label).isNotNull() & F.col(doc_id).isNotNull()).groupBy(F.col(doc_id).cast("long").alias("labelled")).agg(F.min(label).alias("low"), F.max(label).alias("high")).where("low = high and low in (0, 1)").select("labelled", F.col("low").cast("int").alias("label"))
    rows = by_bytes(docs).select(F.col(doc_id).cast("long").alias("id"), _text_column(F.col(text)).alias("text_bins"), _meta_column(F.col("source"), F.col("lang"), F.col("n_chars")).alias("meta_bins"))
    return rows.join(given, rows["id"] == given["labelled"], "left").drop("labelled")


def score(docs: DataFrame, labels: DataFrame, label: str = "quality", doc_id: str = "doc_id", text: str = "text", labelled: int = LABELLED, rounds: int = ROUNDS, sure: float = SURE) -> DataFrame:
    """(doc_id, text_score, meta_score, score, good) of every row of *docs*.

    Scores are probabilities of the label 1, rounded to six places; good means
    a score of one half or more.  Null and empty texts have features of their
    own, as null metadata has.  Where the labels lack a class the scores are
    null and every document is good.
    """
    rows = stored(features(docs, labels, label, doc_id, text), "cotrain")
    model = train(rows, labelled, rounds, sure)
    if model is None:
        none = F.lit(None).cast("double")
        return rows.select(F.col("id").alias("doc_id"), none.alias("text_score"), none.alias("meta_score"), none.alias("score"), F.lit(True).alias("good"))

    def run(text_lists: pa.Array, meta_lists: pa.Array) -> pa.Array:
        a, b = model.text.logit(_matrix(text_lists, len(TEXT_FEATURES))), model.meta.logit(_matrix(meta_lists, len(META_SIZES)))
        both = model.weights[0] * a + model.weights[1] * b + model.weights[2]
        return pa.StructArray.from_arrays([pa.array(np.round(1 / (1 + np.exp(-np.clip(x, -700, 700))), 6)) for x in (a, b, both)], names=["t", "m", "s"])

    out = rows.withColumn("p", F.arrow_udf(run, "struct<t:double,m:double,s:double>")("text_bins", "meta_bins"))
    return out.select(F.col("id").alias("doc_id"), F.col("p.t").alias("text_score"), F.col("p.m").alias("meta_score"), F.col("p.s").alias("score"), (F.col("p.s") >= 0.5).alias("good"))
