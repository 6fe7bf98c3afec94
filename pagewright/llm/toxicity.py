"""Toxicity by classifier chains.

The categories are predicted one after another by linear (logistic) models. A later model
also sees the probabilities of the earlier categories; in training these are out-of-fold
predictions, so that it learns from probabilities of the quality it will meet.

Models are fitted on the driver to a bounded sample of labelled rows: at most
``SAMPLE_TOXIC`` toxic and ``SAMPLE_CLEAN`` others, by a seeded hash of their ids. Features
are the words of the whole text and the first letters of each word, present or not; the
``FEATURES`` most telling ones of the sample are kept.

The tables label toxic documents and not kinds of toxicity. The categories before the label
are learned: the toxic documents of the sample are put into ``KINDS`` groups by the telling
features they share (spherical k-means from a fixed start), and each kind is a category,
largest first. No word list takes part. Every document is scored.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from pagewright.llm.batches import udf_of_lists

SAMPLE_TOXIC, SAMPLE_CLEAN, FEATURES = 4_000, 8_000, 2_000
FOLDS, STEPS, RIDGE, SEED = 5, 150, 1e-4, 11
#: Documents of the sample in which a feature must stand.
LEAST_DOCS = 3
#: Groups that toxic documents are put into, the features that part them, and rounds.
KINDS, TELLING, ROUNDS = 3, 400, 25
LABEL = "toxic"
WORD = re.compile(r"[^\W_]+")
PREFIXES = (2, 3, 4, 5, 6, 8)
#: Characters of a text whose words are gathered at once.
PART = 1 << 20


def features_of(text: str | None) -> set[str]:
    """Words, and their beginnings marked by a star, of the whole text in lower case."""
    words: set[str] = set()
    rest = (text or "").lower()
    at = 0
    while at < len(rest):
        end = at + PART
        while end < len(rest) and rest[end].isalnum():
            end += 1
        words.update(WORD.findall(rest, at, end))
        at = end
    found = set(words)
    for n in PREFIXES:
        found.update(w[:n] + "*" for w in words if len(w) > n)
    return found


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -35, 35)))


@dataclass
class _Sparse:
    """Rows of 0/1 features and some dense columns."""

    rows: np.ndarray
    cols: np.ndarray
    n: int
    width: int
    dense: np.ndarray

    def picked(self, keep: np.ndarray) -> _Sparse:
        to = np.full(self.n, -1)
        to[keep] = np.arange(len(keep))
        mine = to[self.rows] >= 0
        return _Sparse(to[self.rows[mine]], self.cols[mine], len(keep), self.width, self.dense[keep])

    def times(self, w: np.ndarray) -> np.ndarray:
        return np.bincount(self.rows, w[self.cols], self.n) + self.dense @ w[self.width :]

    def back(self, r: np.ndarray) -> np.ndarray:
        return np.concatenate([np.bincount(self.cols, r[self.rows], self.width), self.dense.T @ r])


def fit_logistic(x: _Sparse, y: np.ndarray, weight: np.ndarray, steps: int = STEPS, ridge: float = RIDGE) -> np.ndarray:
    """Weights, the last being the intercept: accelerated gradient steps on the ridge loss."""
    x = _Sparse(x.rows, x.cols, x.n, x.width, np.hstack([x.dense, np.ones((x.n, 1))]))
    weight = weight / weight.sum()
    size = x.width + x.dense.shape[1]
    v = np.random.default_rng(SEED).random(size)
    for _ in range(15):  # the largest curvature
        v = x.back(weight * x.times(v))
        top = np.linalg.norm(v)
        v /= top
    rate = 1 / (0.3 * top + ridge)
    w = ahead = np.zeros(size)
    for k in range(steps):
        slope = x.back(weight * (_sigmoid(x.times(ahead)) - y)) + ridge * ahead
        new = ahead - rate * slope
        ahead, w = new + k / (k + 3) * (new - w), new
    return w


@dataclass
class Chain:
    """Fitted models: for each category its weights by feature, by earlier category, and intercept."""

    categories: list[str]
    words: list[dict[str, float]] = field(default_factory=list)
    earlier: list[list[float]] = field(default_factory=list)
    intercepts: list[float] = field(default_factory=list)
    threshold: float = 1.1

    def score(self, text: str | None) -> list[float]:
        """The probability of each category, in order."""
        found, out = features_of(text), []
        for words, earlier, intercept in zip(self.words, self.earlier, self.intercepts, strict=True):
            z = intercept + sum(w * p for w, p in zip(earlier, out, strict=True))
            z += sum(words[f] for f in sorted(words.keys() & found))
            out.append(float(_sigmoid(np.array(z))))
        return out


def fit_chain(x: _Sparse, labels: np.ndarray, weight: np.ndarray, vocabulary: list[str], categories: list[str], folds: int = FOLDS) -> Chain:
    """A chain over the columns of ``labels``, the threshold of the last one set out of fold."""
    fold = np.random.default_rng(SEED).permutation(x.n) % folds
    chain, outside = Chain(categories), np.zeros((x.n, 0))
    for c in range(len(categories)):
        y = labels[:, c].astype(float)
        own = _Sparse(x.rows, x.cols, x.n, x.width, outside)
        p = np.full(x.n, float((y * weight).sum() / weight.sum()))
        for k in range(folds if x.n >= 2 * folds else 0):
            train, test = np.flatnonzero(fold != k), np.flatnonzero(fold == k)
            if 0 < y[train].sum() < len(train):
                w = fit_logistic(own.picked(train), y[train], weight[train])
                p[test] = _sigmoid(own.picked(test).times(w[:-1]) + w[-1])
        w = fit_logistic(own, y, weight) if 0 < y.sum() < len(y) else np.concatenate([np.zeros(x.width + c), [-35.0 if not y.any() else 35.0]])
        chain.words.append({v: float(a) for v, a in zip(vocabulary, w[: x.width], strict=True) if a})
        chain.earlier.append(w[x.width : x.width + c].tolist())
        chain.intercepts.append(float(w[-1]))
        outside = np.hstack([outside, p[:, None]])
    y, p = labels[:, -1].astype(bool), outside[:, -1]
    if 0 < y.sum() < len(y):  # the largest F1 out of fold, in the middle of its gap
        order = np.argsort(-p, kind="stable")
        hit, miss = np.cumsum((weight * y)[order]), np.cumsum((weight * ~y)[order])
        f1 = 2 * hit / (hit + miss + (weight * y).sum())
        last = np.concatenate([p[order][1:] < p[order][:-1], [True]])
        k = int(np.argmax(np.where(last, f1, -1)))
        chain.threshold = float((p[order][k] + (p[order][k + 1] if k + 1 < len(p) else 0)) / 2)
    return chain


def _empty(categories: list[str]) -> Chain:
    return Chain(categories, [{} for _ in categories], [[0.0] * i for i in range(len(categories))], [-35.0] * len(categories))


def kinds_of(x: _Sparse, y: np.ndarray, kinds: int = KINDS, telling: int = TELLING, rounds: int = ROUNDS) -> np.ndarray:
    """For each row its kind, largest kind first; -1 for rows without the label.

    Rows of the label are grouped by direction over the features that stand more often with
    it than without, weighted by how surely. A row without any goes to the first kind.
    """
    toxic = y.astype(bool)
    n1, n0 = max(toxic.sum(), 1), max((~toxic).sum(), 1)
    with_, without = np.bincount(x.cols[toxic[x.rows]], minlength=x.width), np.bincount(x.cols[~toxic[x.rows]], minlength=x.width)
    share = (with_ + without + 1) / (n1 + n0 + 2)
    z = (with_ / n1 - without / n0) / np.sqrt(share * (1 - share) * (1 / n1 + 1 / n0))
    top = np.argsort(-z, kind="stable")[:telling]
    top = top[z[top] > 2]
    to, at = np.full(x.width, -1), np.flatnonzero(toxic)
    to[top] = np.arange(len(top))
    where, cols = np.full(x.n, -1), to[x.cols]
    where[at] = np.arange(len(at))
    use = (cols >= 0) & toxic[x.rows]
    rows = np.zeros((len(at), len(top)))
    rows[where[x.rows[use]], cols[use]] = np.sqrt(z[top])[cols[use]]
    rows /= np.maximum(np.linalg.norm(rows, axis=1, keepdims=True), 1e-12)
    out, group = np.full(x.n, -1), np.zeros(len(at), np.int64)
    if len(at) and len(top):
        mean = rows.sum(axis=0)
        centres = [rows[np.argmax(rows @ mean)]]  # the most usual row, then each time the one farthest from all
        while len(centres) < min(kinds, len(at)):
            near = np.max(rows @ np.array(centres).T, axis=1)
            centres.append(rows[np.argmin(np.where(rows.any(axis=1), near, 2))])
        centres = np.array(centres)
        for _ in range(rounds):
            group = np.argmax(rows @ centres.T, axis=1)
            new = np.array([rows[group == k].sum(axis=0) if (group == k).any() else centres[k] for k in range(len(centres))])
            new /= np.maximum(np.linalg.norm(new, axis=1, keepdims=True), 1e-12)
            if np.allclose(new, centres):
                break
            centres = new
        rank = np.argsort(np.argsort(-np.bincount(group, minlength=kinds), kind="stable"), kind="stable")
        group = rank[group]
    out[at] = group
    return out


def train(docs: DataFrame, labels: DataFrame, *, kinds: int = KINDS, most_toxic: int = SAMPLE_TOXIC, most_clean: int = SAMPLE_CLEAN, most_features: int = FEATURES) -> Chain:
    """A chain of the kinds and ``toxic``, from ``labels`` (doc_id, toxic).

    A document labelled more than once is toxic if one label says so, and its text is the
    greatest of those under its id; null ids or labels, and labels of documents that ``docs``
    lacks, are left out. Ids may have any type that can be compared. Without both classes
    nothing is flagged.
    """
    categories = [*(f"kind{k + 1}" for k in range(kinds)), LABEL]
    known = labels.where("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max(F.col("toxic").cast("int")).alias("y"))
    known = known.join(docs.select("doc_id").distinct(), "doc_id", "left_semi").withColumn("h", F.xxhash64("doc_id", F.lit(SEED)))
    number = dict(known.groupBy("y").count().collect())  # two rows
    picked = [r for y, most in ((1, most_toxic), (0, most_clean)) for r in known.where(F.col("y") == y).orderBy("h", "doc_id").limit(most).select("doc_id", "y").collect()]
    if len({r["y"] for r in picked}) < 2:
        return _empty(categories)
    spark, id_kind = docs.sparkSession, known.schema["doc_id"].dataType.simpleString()
    sample = docs.select("doc_id", "text").join(F.broadcast(spark.createDataFrame(picked, f"doc_id {id_kind}, y int")), "doc_id").groupBy("doc_id", "y").agg(F.max("text").alias("text"))

    def counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            every, toxic = Counter(), Counter()
            for text, y in zip(batch["text"], batch["y"], strict=True):
                found = features_of(text)
                every.update(found)
                if y:
                    toxic.update(found)
            yield pd.DataFrame({"feature": list(every), "n": list(every.values()), "n1": [toxic[f] for f in every]})

    sums = sample.mapInPandas(counted, "feature string, n long, n1 long").groupBy("feature").agg(F.sum("n").alias("n"), F.sum("n1").alias("n1")).where(F.col("n") >= min(LEAST_DOCS, 1 + len(picked) // 200))
    rows, toxic = float(len(picked)), float(sum(r["y"] for r in picked))
    p1, p0 = F.col("n1") / toxic, (F.col("n") - F.col("n1")) / (rows - toxic)
    share = F.col("n") / rows
    z = F.abs(p1 - p0) / F.sqrt(share * (1 - share) / toxic + share * (1 - share) / (rows - toxic) + 1e-12)
    vocabulary = sorted(r["feature"] for r in sums.orderBy(F.desc(z), "feature").limit(most_features).select("feature").collect())
    place = {f: i for i, f in enumerate(vocabulary)}

    def placed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"doc_id": batch["doc_id"], "y": batch["y"], "at": [sorted(place[f] for f in features_of(t) & place.keys()) for t in batch["text"]]})

    got = sample.mapInPandas(placed, f"doc_id {id_kind}, y int, at array<int>").toPandas().sort_values("doc_id")
    y = got["y"].to_numpy()
    at = [np.asarray(a, np.int64) for a in got["at"]]
    x = _Sparse(np.repeat(np.arange(len(at)), [len(a) for a in at]), np.concatenate(at), len(at), len(vocabulary), np.zeros((len(at), 0)))
    kind = kinds_of(x, y, kinds)
    labelled = np.column_stack([*(kind == k for k in range(kinds)), y]).astype(int)
    weight = np.where(y == 1, number.get(1, 0) / max(y.sum(), 1), number.get(0, 0) / max((1 - y).sum(), 1))
    return fit_chain(x, labelled, weight, vocabulary, categories)


def with_scores(docs: DataFrame, chain: Chain, to: str) -> DataFrame:
    """``docs`` with a struct column ``to``: p_<category> of each, and toxic (boolean).

    Null text counts as empty and every row is scored; a column that is named ``to`` already
    is replaced.
    """
    kind = StructType()
    for c in chain.categories:
        kind.add(f"p_{c}", "double")
    kind.add("toxic", "boolean")

    def scored(text: str) -> dict:
        p = chain.score(text)
        return dict(zip(kind.names, [*p, p[-1] >= chain.threshold], strict=True))

    scores = udf_of_lists(kind, lambda batches: ([scored(t) for t in texts] for texts in batches))
    return docs.withColumn(to, scores(F.coalesce(F.col("text"), F.lit(""))))


def score_documents(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """doc_id, p_<category> for each category, toxic (boolean) of every row of ``docs``.

    Null text counts as empty. Repeated rows and null ids give a row each; other columns
    are not read. See ``train`` for labels.
    """
    chain = train(docs, labels, **options)
    return with_scores(docs.select("doc_id", "text"), chain, "scores").select("doc_id", "scores.*")
