"""Toxicity by a classifier chain of sparse linear models.

Categories are predicted in turn. The model of each category sees the text's features and the
probabilities of the categories before it; in training those come from out-of-fold models, so that
a later model learns how far the earlier ones can be trusted on texts they haven't seen.

Features are the presence of words and of their beginnings (three to five letters) and bands of a
few text statistics. Each model is a logistic regression with an L1 penalty: what doesn't tell the
classes apart weighs exactly zero, so long clean texts don't add up to a verdict.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import forget_words, text_of

#: Labelled rows used for training at most, taken by a seeded hash of their id.
MAX_TRAIN = 10_000
#: Features that the search for the optimum begins with, by chi-square against any category; all others come in if they matter.
FIRST_FEATURES = 2_000
#: Labelled rows that a feature occurs in at least: what is met less often can't be told from chance.
MIN_DOCS = 4
#: The weight of the L1 penalty, and how far over it the slope of a feature left out may be (the optimum is found to 1 in 1000).
PENALTY, SLACK = 1e-3, 1.05
FOLDS = 3
#: Set on labelled rows held out of training: no clean one reached a tenth, 1 toxic one in 600 stayed under this.
THRESHOLD = 0.2
_WORD = re.compile(r"[^\W\d_]+")
_CACHE = 200_000
#: Entries of the matrix worked on at once.
_SPAN = 1 << 20


def _hash(feature: str) -> int:
    return zlib.crc32(feature.encode("utf-8", "replace"))


@lru_cache(maxsize=20_000)
def _word_features(word: str) -> tuple[int, ...]:
    return (_hash(f"w {word}"), *[_hash(f"{n} {word[:n]}") for n in (3, 4, 5) if len(word) > n])


def _statistics(text: str, words: list[str]) -> list[int]:
    """Bands of length, word length, the share of letters, and the share of distinct words."""
    letters = sum(map(len, words))
    bands = (
        ("n", int(np.log2(len(text) + 1))),
        ("l", round(2 * letters / len(words)) if words else 0),
        ("s", round(20 * letters / len(text)) if text else 0),
        ("d", round(10 * len(set(words)) / len(words)) if words else 0),
    )
    return [_hash(f"= {k} {v}") for k, v in bands]


def features(text: str) -> set[int]:
    """The features of a whole text, as 32-bit hashes."""
    words = _WORD.findall(text.lower())
    found = set(_statistics(text, words))
    for w in set(words):
        found.update(_word_features(w))
    return found


@dataclass
class Model:
    """One link of the chain: weights by feature, an intercept, weights of earlier probabilities."""

    weights: dict[int, float] = field(default_factory=dict)
    intercept: float = 0.0
    earlier: list[float] = field(default_factory=list)

    def score(self, active: set[int], before: list[float]) -> float:
        z = self.intercept + sum(self.weights.get(f, 0.0) for f in active) + sum(w * p for w, p in zip(self.earlier, before, strict=True))
        return float(1 / (1 + np.exp(-np.clip(z, -500, 500))))


class _Sparse:
    """Rows of present columns, with a few dense columns behind.

    Columns are scaled to one second moment, so that rare telling words are learnt as fast as
    common ones and the penalty asks less of them.
    """

    def __init__(self, idx: np.ndarray, row: np.ndarray, n: int, dense: np.ndarray):
        self.idx, self.row, self.n, self.dense, self.rows = idx, row, n, dense, len(dense)
        self.scale = np.ones(n + dense.shape[1] + 1)
        self.scale[:n] = np.sqrt(max(1, self.rows) / np.maximum(np.bincount(self.idx, minlength=n), 1))

    def dot(self, w: np.ndarray) -> np.ndarray:
        w = w * self.scale
        out = self.dense @ w[self.n : -1] + w[-1]
        for lo in range(0, len(self.idx), _SPAN):
            out += np.bincount(self.row[lo : lo + _SPAN], w[self.idx[lo : lo + _SPAN]], self.rows)
        return out

    def raw(self, w: np.ndarray) -> np.ndarray:
        """Scores of weights that are for columns as they come."""
        return self.dot(w / self.scale)

    def tdot(self, r: np.ndarray) -> np.ndarray:
        own = np.zeros(self.n)
        for lo in range(0, len(self.idx), _SPAN):
            own += np.bincount(self.idx[lo : lo + _SPAN], r[self.row[lo : lo + _SPAN]], self.n)
        return np.concatenate([own, self.dense.T @ r, [r.sum()]]) * self.scale

    def part(self, columns: np.ndarray) -> _Sparse:
        """The same rows with these columns only."""
        place = np.full(self.n, -1, np.int32)
        place[columns] = np.arange(len(columns), dtype=np.int32)
        at = place[self.idx]
        return _Sparse(at[at >= 0], self.row[at >= 0], len(columns), self.dense)

    def only(self, mask: np.ndarray) -> _Sparse:
        """The rows of the mask."""
        number = np.cumsum(mask, dtype=np.int32) - 1
        some = mask[self.row]
        return _Sparse(self.idx[some], number[self.row[some]], self.n, self.dense[mask])


def _fit_all(x: _Sparse, y: np.ndarray, first: np.ndarray, penalty: float = PENALTY) -> np.ndarray:
    """:func:`_fit` over all columns, though most are never worked on: the optimum of the ``first`` ones is that of all if no
    other column's gradient passes the penalty; those that do come in, until none does."""
    columns, out, turns = np.sort(first), np.zeros(x.n + x.dense.shape[1] + 1), 0
    while True:
        start = np.concatenate([out[columns], out[x.n :]]) if turns else None
        w = _fit(x.part(columns), y, penalty, start=start)
        out = np.zeros(x.n + x.dense.shape[1] + 1)
        out[columns], out[x.n :] = w[: len(columns)], w[len(columns) :]
        p = 1 / (1 + np.exp(-np.clip(x.raw(out), -500, 500)))
        slope = np.abs(x.tdot(p - y)[: x.n]) / max(1, len(y))
        slope[columns] = 0
        more = np.flatnonzero(slope > penalty * SLACK)
        if not len(more):
            return out
        turns += 1
        kept = columns if turns > 8 else np.flatnonzero(out[: x.n])  # idle columns go, unless the search goes round
        columns = np.union1d(kept, more)


def _fit(x: _Sparse, y: np.ndarray, penalty: float = PENALTY, rounds: int = 150, start: np.ndarray | None = None) -> np.ndarray:
    """L1 logistic regression by accelerated proximal gradient, from ``start`` if given; the intercept, last, isn't penalised."""
    w = np.zeros(x.n + x.dense.shape[1] + 1)
    rate = y.mean() if len(y) else 0.0
    w[-1] = np.log((rate + 1e-3) / (1 - rate + 1e-3))
    if not 0 < rate < 1:
        w[-1] = 8.0 if rate == 1 else -8.0
        return w * x.scale
    if start is not None:
        w = start / x.scale
    norm = np.ones_like(w)  # largest eigenvalue of X'X / n, by power iteration
    for _ in range(12):
        v = x.tdot(x.dot(norm))
        norm = v / np.linalg.norm(v)
    step = 4 / (np.linalg.norm(x.tdot(x.dot(norm))) / len(y) * 1.1)
    z, t = w.copy(), 1.0
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x.dot(z), -500, 500)))
        new = z - step * x.tdot(p - y) / len(y)
        new[:-1] = np.sign(new[:-1]) * np.maximum(np.abs(new[:-1]) - step * penalty, 0)
        t2 = (1 + np.sqrt(1 + 4 * t * t)) / 2
        z = new + (t - 1) / t2 * (new - w)
        if np.abs(new - w).max() < 1e-4:
            w = new
            break
        w, t = new, t2
    return w * x.scale


def train_chain(rows: list[np.ndarray], labels: np.ndarray, folds: np.ndarray) -> list[Model]:
    """A chain over the columns of ``labels`` (rows x categories, 0 or 1) from rows of feature hashes (32 bits)."""
    flat = np.concatenate([r.astype(np.uint32) for r in rows]) if rows else np.empty(0, np.uint32)
    owner = np.repeat(np.arange(len(rows), dtype=np.int32), [len(r) for r in rows])
    names, counts = np.unique(flat, return_counts=True)
    names, counts = names[counts >= MIN_DOCS], counts[counts >= MIN_DOCS]
    at = np.minimum(np.searchsorted(names, flat), max(0, len(names) - 1)).astype(np.int32)
    known = names[at] == flat if len(names) else np.zeros(len(flat), bool)
    at, owner = at[known], owner[known]
    del flat, known
    best = np.zeros(len(names))
    for y in labels.T:
        hit, rate = np.bincount(at, y[owner], len(names)), y.mean() if len(y) else 0
        if 0 < rate < 1:
            best = np.maximum(best, (hit - counts * rate) ** 2 / (counts * rate * (1 - rate) * np.maximum(1 - counts / max(1, len(rows)), 1e-9)))
    first = np.argsort(-best, kind="stable")[:FIRST_FEATURES]
    models, x = [], _Sparse(at, owner, len(names), np.empty((len(rows), 0)))
    for c, y in enumerate(labels.T):
        w = _fit_all(x, y, first)
        own = w[: len(names)]
        models.append(Model({int(names[i]): float(own[i]) for i in np.nonzero(own)[0]}, float(w[-1]), w[len(names) : -1].tolist()))
        if c + 1 < labels.shape[1]:
            p = np.zeros(len(rows))
            for k in np.unique(folds):
                out = folds == k
                p[out] = 1 / (1 + np.exp(-np.clip(x.only(out).raw(_fit_all(x.only(~out), y[~out], first)), -500, 500)))
            x = _Sparse(at, owner, len(names), np.column_stack([x.dense, p]))
    return models


def _featurize(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    forget_words()
    for b in batches:
        hashes = pa.array([sorted(features(t)) for t in b.column(1).to_pylist()], pa.list_(pa.int64()))
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), hashes], ["id", "y", "f"])


def fit(docs: DataFrame, labels: DataFrame, categories: dict[str, Column], id_col: str = "doc_id", text_col: str = "text", max_train: int = MAX_TRAIN, seed: int = 42) -> list[Model]:
    """Train the chain on labelled documents, ``max_train`` of them at most.

    ``categories`` gives, in chain order, a boolean expression over ``labels``; rows where one is
    null aren't used. Without labelled rows, or of one class alone, the chain answers with that class
    (no rows: never).
    """
    y = F.array(*[c.cast("int") for c in categories.values()])
    some = labels.select(F.col(id_col).cast("long").alias("id"), y.alias("y")).where(F.col("id").isNotNull() & ~F.exists("y", lambda v: v.isNull()))
    some = some.groupBy("id").agg(F.max("y").alias("y")).orderBy(F.xxhash64(F.lit(seed), "id"), "id").limit(max_train)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), text_of(text_col).alias("text")).join(F.broadcast(some), "id")  # max_train rows
    got = rows.select("id", "text", "y").mapInArrow(_featurize, "id long, y array<int>, f array<long>").toArrow()
    order = np.argsort(got["id"].to_numpy(), kind="stable")
    hashes = [got["f"][int(i)].values.to_numpy() for i in order]
    ys = np.array([got["y"][int(i)].as_py() for i in order], float).reshape(len(order), len(categories))
    folds = np.array([zlib.crc32(str(got["id"][int(i)].as_py()).encode()) % FOLDS for i in order])
    return train_chain(hashes, ys, folds)


def _scorer(models: list[Model]):
    """text -> probabilities; words map to the few features that weigh anything."""
    active = set().union(*[m.weights for m in models]) if models else set()
    cache: dict[str, tuple[int, ...]] = {}

    def score(text: str) -> list[float]:
        words = _WORD.findall(text.lower())
        found = active.intersection(_statistics(text, words))
        for w in set(words):
            f = cache.get(w)
            if f is None:
                if len(cache) >= _CACHE:
                    cache.clear()
                f = cache[w] = tuple(x for x in _word_features.__wrapped__(w) if x in active)
            if f:
                found.update(f)
        out: list[float] = []
        for m in models:
            out.append(m.score(found, out))
        return out

    return score


def predict(models: list[Model]):
    """A vectorised column function: text -> array of probabilities in chain order."""

    @F.pandas_udf("array<double>")
    def scores(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        forget_words()
        score = _scorer(models)
        for texts in parts:
            yield pd.Series([score(t) for t in texts])

    return scores


def default_categories() -> dict[str, Column]:
    """Chain order over the table of labels."""
    return {"low_quality": F.col("quality") == 0, "toxic": F.col("toxic") == 1}


def toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """(id_col, p_<category> ..., toxic) for every row of ``docs``; toxic: the last probability reaches the threshold.

    Null texts count as empty; null and repeated ids are rows like any other (only labelled rows
    need an id); other columns aren't looked at; an empty table gives an empty result.
    """
    cats = default_categories()
    models = fit(docs, labels, cats, id_col, text_col)
    p = docs.select(F.col(id_col).alias(id_col), predict(models)(text_of(text_col)).alias("p"))
    cols = [F.round(F.col("p")[i], 6).alias(f"p_{c}") for i, c in enumerate(cats)]
    return p.select(id_col, *cols, (F.col("p")[len(cats) - 1] >= threshold).alias("toxic"))


def keep_clean(docs: DataFrame, labels: DataFrame, text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` that aren't toxic, with their columns."""
    cats = default_categories()
    models = fit(docs, labels, cats, text_col=text_col)
    p = F.element_at(predict(models)(text_of(text_col)), len(cats))
    return docs.where(p < threshold)
