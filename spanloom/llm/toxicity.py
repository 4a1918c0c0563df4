"""Toxicity by a classifier chain.

The categories are predicted one after another; each later linear model also sees the earlier categories' probabilities. For training,
those probabilities are out-of-fold ones, so that later models learn from predictions as they will be on new
documents. Categories are columns of the label table, in the order given; the last one decides, at the threshold that serves its out-of-fold
predictions best (by F1), or THRESHOLD where there is nothing to choose by. Of the labels at hand these are
`low_quality` (quality 0) and `toxic`; a table with finer ones (insult, threat, ...) needs only their names.

Features are the presence of words and word beginnings, chosen for each category by their log-odds over a bounded sample of labelled rows: the
SAMPLE rows with the smallest hash of doc_id. Scoring covers every document and whole texts, without a shuffle.

Null text counts as empty. A null label counts as 0, a row without any label isn't used. A category without labels of both kinds gets the
one that there is (none at all: 0). Repeated labels of a document count as 1 if one is. Any doc_id that fits a long will do, negative ones
too. Repeated rows give equal values; an empty table gives no rows.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanloom.llm.common import ids_and_texts, lean, staged, tidy

#: At most so many labelled rows are used for fitting, and so many features kept for each category.
SAMPLE, VOCABULARY, FOLDS = 8_000, 4_096, 5
THRESHOLD = 0.5
PREFIXES = (4, 5, 6)
_WORD = re.compile(r"[^\W\d_]+")


def features(text: str) -> set[str]:
    """Words and word beginnings (marked by a hyphen) of a text."""
    words = set(_WORD.findall(text.lower()))
    out = set(words)
    for n in PREFIXES:
        out.update([w[:n] + "-" for w in words if len(w) > n])
    return out


def sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def fit_logistic(rows: np.ndarray, cols: np.ndarray, more: np.ndarray, y: np.ndarray, n: int, penalty: float = 1.0, steps: int = 150) -> np.ndarray:
    """Weights for n binary features given by (row, column) places, then the dense columns `more`, then a constant. Accelerated gradient steps."""
    m, d = len(y), more.shape[1]
    w = np.zeros(n + d + 1)
    if m == 0 or y.min() == y.max():  # one kind only: that one
        w[-1] = 6.0 if m and y[0] else -6.0
        return w
    counts = np.bincount(rows, minlength=m) + (more**2).sum(1) + 1
    rate = 1.0 / (0.25 * float(np.sqrt((counts**2).mean()) * m * 0.25) + penalty)
    v, t = w.copy(), 1.0
    best = math.inf
    for _ in range(steps):
        z = np.bincount(rows, v[cols], minlength=m) + more @ v[n : n + d] + v[-1]
        r = sigmoid(z) - y
        g = np.concatenate([np.bincount(cols, r[rows], minlength=n), more.T @ r, [r.sum()]])
        g[:-1] += penalty * v[:-1]
        loss = float(np.logaddexp(0, z).sum() - (y * z).sum() + penalty / 2 * (v[:-1] ** 2).sum())
        if loss > best:
            t, rate = 1.0, rate * 0.5  # too long a step: start anew from the last weights
            v, best = w.copy(), math.inf
            continue
        best = loss
        new, after = v - rate * g, (1 + math.sqrt(1 + 4 * t * t)) / 2
        rate *= 1.1
        v, w, t = new + (t - 1) / after * (new - w), new, after
    return w


def best_threshold(p: np.ndarray, y: np.ndarray) -> float:
    """The threshold whose predictions have the best F1; halfway to the next lower probability, so that like documents fall on its side."""
    order = np.argsort(-p, kind="stable")
    p, hit = p[order], np.cumsum(y[order])
    f1 = 2 * hit / (np.arange(1, len(p) + 1) + y.sum())
    f1[:-1][p[:-1] == p[1:]] = -1  # equal probabilities can't be told apart
    at = int(np.argmax(f1))
    return float((p[at] + (p[at + 1] if at + 1 < len(p) else 0)) / 2)


@dataclass
class Chain:
    categories: list[str]
    vocabulary: dict[str, int] = field(default_factory=dict)
    weights: list[np.ndarray] = field(default_factory=list)
    threshold: float = THRESHOLD

    def _places(self, sets: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
        return np.repeat(np.arange(len(sets)), [len(s) for s in sets]).astype(np.int64), np.array([c for s in sets for c in s], np.int64)

    def fit(self, sets: list[list[int]], labels: np.ndarray, folds: np.ndarray) -> "Chain":
        """labels: a column for each category, in the order of the chain; folds: a number below FOLDS for each row."""
        n, m = len(self.vocabulary), len(sets)
        earlier = np.zeros((m, 0))
        rows, cols = self._places(sets)
        for c in range(labels.shape[1]):
            y, out = labels[:, c].astype(float), np.zeros(m)
            self.weights.append(fit_logistic(rows, cols, earlier, y, n))
            for f in range(FOLDS):
                inside = folds != f
                keep = inside[rows]
                number = np.cumsum(inside) - 1
                w = fit_logistic(number[rows[keep]], cols[keep], earlier[inside], y[inside], n)
                out += np.where(inside, 0, self._margin(rows, cols, earlier, w, n, m))
            earlier = np.column_stack([earlier, sigmoid(out)])
        if len(set(labels[:, -1].tolist())) == 2:
            self.threshold = best_threshold(earlier[:, -1], labels[:, -1])
        return self

    @staticmethod
    def _margin(rows, cols, more, w, n, m):
        return np.bincount(rows, w[cols], minlength=m) + more @ w[n : n + more.shape[1]] + w[-1]

    def predict(self, texts: list[str]) -> np.ndarray:
        """A column of probabilities for each category."""
        known = self.vocabulary
        sets = [[known[f] for f in self._known(t)] for t in texts]
        rows, cols = self._places(sets)
        p = np.zeros((len(texts), 0))
        for w in self.weights:
            p = np.column_stack([p, sigmoid(self._margin(rows, cols, p, w, len(known), len(texts)))])
        return p

    def _known(self, text: str) -> set[str]:
        """The features of a text that the model knows; as features(), without making the others."""
        known = self.vocabulary
        words = set(_WORD.findall(text.lower()))
        out = {w for w in words if w in known}
        for n in PREFIXES:
            out.update([p for w in words if len(w) > n and (p := w[:n] + "-") in known])
        return out


def table_labels(labels: DataFrame) -> DataFrame:
    """The categories of a table (doc_id, quality, toxic); a table without quality has only toxic ones."""
    low = [F.when(F.col("quality").isNotNull(), (F.col("quality") == 0).cast("int")).alias("low_quality")] if "quality" in labels.columns else []
    return labels.select("doc_id", *low, F.col("toxic").cast("int").alias("toxic"))


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Chain:
    """Fits the chain on a bounded sample of labelled documents. labels: doc_id, then a column of 0 and 1 for each category, in order."""
    categories = [c for c in labels.columns if c != "doc_id"]
    c = [F.col(k).cast("int").alias(f"c{i}") for i, k in enumerate(categories)]
    own = labels.select(F.col("doc_id").cast("long").alias("doc_id"), *c).where(F.col("doc_id").isNotNull() & F.coalesce(*[f"c{i}" for i in range(len(c))]).isNotNull())
    own = own.groupBy("doc_id").agg(F.array(*[F.coalesce(F.max(f"c{i}"), F.lit(0)) for i in range(len(c))]).alias("y"))
    chosen = own.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)  # at most `sample` rows, so it may be broadcast
    rows = ids_and_texts(docs).join(F.broadcast(chosen), "doc_id").dropDuplicates(["doc_id"])
    rows = staged(rows, "toxicity-sample")

    def listed(batches):
        for batch in batches:
            for text, y in zip(batch.column("text").to_pylist(), batch.column("y").to_pylist()):
                fs = sorted(features(text))
                yield pa.RecordBatch.from_pydict({"feature": pa.array(fs, pa.string()), **{f"c{i}": pa.array([int(v > 0)] * len(fs), pa.int32()) for i, v in enumerate(y)}})

    chain = Chain(categories)
    sums = [F.sum((F.col("y")[i] > 0).cast("int")).alias(f"t{i}") for i in range(len(c))]
    total = rows.agg(F.count(F.lit(1)).alias("n"), *sums).first()
    counted = rows.mapInArrow(lean(listed), "feature string, " + ", ".join(f"c{i} int" for i in range(len(c))))
    counted = counted.groupBy("feature").agg(F.count(F.lit(1)).alias("n"), *[F.sum(f"c{i}").alias(f"t{i}") for i in range(len(c))])
    best = []
    for i in range(len(c)):
        nt, nc = total[f"t{i}"] or 0, total["n"] - (total[f"t{i}"] or 0)
        if nt and nc:
            t = F.col(f"t{i}")
            odds = F.log((t + 0.5) / (nt + 1.0)) - F.log((F.col("n") - t + 0.5) / (nc + 1.0))
            best.append((i, F.when((t >= 4) & (odds > 2), odds * t)))
    if best:
        # at most VOCABULARY features for each category come to the driver
        weighed = counted.select("feature", *[w.alias(f"w{i}") for i, w in best])
        counted = staged(weighed.where(F.coalesce(*[f"w{i}" for i, _ in best]).isNotNull()), "toxicity-features")
        for i, _ in best:
            for r in counted.where(F.col(f"w{i}").isNotNull()).orderBy(F.desc(f"w{i}"), "feature").limit(VOCABULARY).select("feature").collect():
                chain.vocabulary.setdefault(r["feature"], len(chain.vocabulary))
    known = chain.vocabulary

    def sparse(batches):
        model = Chain(categories, known)
        for batch in batches:
            sets = [sorted(known[f] for f in model._known(t)) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(sets, pa.list_(pa.int32())), batch.column("y")], names=["doc_id", "places", "y"])

    # at most `sample` rows of places in a bounded vocabulary
    got = rows.mapInArrow(lean(sparse), "doc_id long, places array<int>, y array<int>").orderBy("doc_id").collect()
    y = np.array([r["y"] for r in got], int).reshape(len(got), len(c))
    folds = (np.array([r["doc_id"] for r in got], np.int64).view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(40)) % np.uint64(FOLDS)
    return chain.fit([r["places"] for r in got], (y > 0).astype(int), folds.astype(int))


def score(docs: DataFrame, chain: Chain, threshold: float | None = None) -> DataFrame:
    """doc_id, a probability for each category (p_ and its name), toxic (by the last one) and kept."""
    threshold = chain.threshold if threshold is None else threshold
    names = [f"p_{c}" for c in chain.categories]

    def run(batches):
        for batch in batches:
            p = np.round(chain.predict(batch.column("text").to_pylist()), 9)
            toxic = p[:, -1] >= threshold
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(p[:, i]) for i in range(len(names))), pa.array(toxic), pa.array(~toxic)], names=["doc_id", *names, "toxic", "kept"])

    return ids_and_texts(docs).mapInArrow(lean(run), f"doc_id long, {', '.join(f'{n} double' for n in names)}, toxic boolean, kept boolean")


def keep_documents(docs: DataFrame, chain: Chain, threshold: float | None = None) -> DataFrame:
    """The documents that aren't toxic, with all their columns."""
    threshold = chain.threshold if threshold is None else threshold

    @F.pandas_udf("boolean")
    def clean(texts: pd.Series) -> pd.Series:
        out = pd.Series(chain.predict(texts.fillna("").tolist())[:, -1] < threshold if len(texts) else [], dtype=bool)
        tidy()
        return out

    return docs.where(clean(F.col("text").cast("string")))
