"""Toxicity by a chain of linear classifiers.

The categories are predicted one after another, the overall label last. Only the overall label is given; the categories
are found in the data: toxic training rows are clustered by the words that tell them. Each model sees which words of
its own choice a text has, and the probabilities of the categories before it. For training, those are
out-of-fold predictions: they come from models that haven't seen the row.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vicinage.llm.tables import bounded_sample, materialize, text_of

#: Labelled rows that the chain is fitted on, at most; the first by hash of those that aren't held out.
FIT_ROWS = 6000
#: Words that the models may choose from: those of the training rows that differ most between the classes.
VOCABULARY = 4000
#: Categories, in the order of the chain: clusters of toxic training rows, larger ones first.
CATEGORIES = ("category_1", "category_2", "category_3")
WORDS, FOLDS, SEEN_IN, CLEAR = 400, 5, 4, 4.0
THRESHOLD = 0.5

_WORD = re.compile(r"[^\W\d_]+")


def words_of(text: str) -> set[str]:
    return set(_WORD.findall(text.lower()))


def sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


@dataclass
class Linear:
    """Weights of words, of earlier categories, and a bias."""

    words: dict[str, float]
    earlier: np.ndarray
    bias: float

    def score(self, words: set[str], earlier: list[float]) -> float:
        found = self.words.keys() & words
        return float(sigmoid(self.bias + sum(self.words[w] for w in sorted(found)) + float(np.dot(self.earlier, earlier))))


def choose(texts: list[set[str]], y: np.ndarray) -> list[str]:
    """The words whose frequency differs most between the classes, by a z-score of at least CLEAR; ties by name."""
    with_, without = Counter(), Counter()
    for words, label in zip(texts, y):
        (with_ if label else without).update(words)
    n1, n0 = max(1, int(y.sum())), max(1, int(len(y) - y.sum()))
    scores = []
    for w in with_.keys() | without.keys():
        a, b = with_[w], without[w]
        if a + b >= SEEN_IN:
            p = (a + b) / (n1 + n0)
            z = abs(a / n1 - b / n0) / np.sqrt(p * (1 - p) * (1 / n1 + 1 / n0) + 1e-9)
            if z >= CLEAR:
                scores.append((-z, w))
    return [w for _, w in sorted(scores)[:WORDS]]


def fit_linear(texts: list[set[str]], earlier: np.ndarray, y: np.ndarray, steps: int = 25) -> Linear:
    """Logistic regression with a quadratic penalty, by Newton steps."""
    words = choose(texts, y)
    at = {w: i for i, w in enumerate(words)}
    x = np.zeros((len(texts), len(words) + earlier.shape[1] + 1))
    for row, own in zip(x, texts):
        row[[at[w] for w in own if w in at]] = 1
    x[:, len(words) : -1] = earlier
    x[:, -1] = 1
    penalty = np.full(x.shape[1], 1.0)
    penalty[-1] = 1e-3
    w = np.zeros(x.shape[1])
    for _ in range(steps):
        p = sigmoid(x @ w)
        step = np.linalg.solve((x.T * (p * (1 - p) + 1e-6)) @ x + np.diag(penalty), x.T @ (y - p) - penalty * w)
        w += step
        if np.abs(step).max() < 1e-4:
            break
    return Linear({k: float(v) for k, v in zip(words, w) if abs(v) > 1e-3}, w[len(words) : -1], float(w[-1]))


@dataclass
class Chain:
    names: tuple[str, ...]
    models: list[Linear]

    def scores(self, words: set[str]) -> list[float]:
        out: list[float] = []
        for model in self.models:
            out.append(model.score(words, out))
        return out


def clusters(texts: list[set[str]], toxic: np.ndarray, number: int) -> np.ndarray:
    """For each text the number of its category from 0, or -1: k-means of the toxic rows on unit vectors of the words that tell them.

    Centres start farthest from one another, so the result doesn't depend on chance. Rows without a telling word have no category.
    """
    out = np.full(len(texts), -1)
    words = {w: i for i, w in enumerate(choose(texts, toxic))}
    rows = [i for i in np.flatnonzero(toxic > 0) if not words.keys().isdisjoint(texts[i])]
    if not rows:
        return out
    x = np.zeros((len(rows), len(words)))
    for row, i in zip(x, rows):
        row[[words[w] for w in texts[i] if w in words]] = 1
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    centres = [x[0]]
    while len(centres) < min(number, len(rows)):
        centres.append(x[np.argmin(np.max(x @ np.array(centres).T, axis=1))])
    centres = np.array(centres)
    for _ in range(20):
        own = np.argmax(x @ centres.T, axis=1)
        centres = np.array([x[own == k].mean(0) if (own == k).any() else centres[k] for k in range(len(centres))])
        centres /= np.linalg.norm(centres, axis=1, keepdims=True)
    order = np.argsort(-np.bincount(own, minlength=len(centres)), kind="stable")
    out[rows] = np.argsort(order)[own]
    return out


def fit_chain(texts: list[set[str]], toxic: np.ndarray) -> Chain:
    """A chain over the categories found in the data and then the given label. Without rows every score is 0.5."""
    names, models = (*CATEGORIES, "toxic"), []
    if not len(texts):
        return Chain(names, [Linear({}, np.zeros(i), 0.0) for i in range(len(names))])
    fold = np.where(toxic > 0, np.cumsum(toxic > 0), np.cumsum(toxic <= 0)) % FOLDS  # every fold has its share of both classes
    category = clusters(texts, toxic, len(CATEGORIES))
    earlier = np.zeros((len(texts), 0))
    for k, name in enumerate(names):
        y = toxic if name == "toxic" else (category == k).astype(np.float64)
        models.append(fit_linear(texts, earlier, y))
        if name != "toxic":
            out = np.zeros(len(texts))
            for k in range(FOLDS):
                rest = np.flatnonzero(fold != k)
                part = fit_linear([texts[i] for i in rest], earlier[rest], y[rest])
                for i in np.flatnonzero(fold == k):
                    out[i] = part.score(texts[i], list(earlier[i]))
            earlier = np.column_stack([earlier, out])
    return Chain(names, models)


def training_rows(docs: DataFrame, labels: DataFrame, label: str, rows: int) -> DataFrame:
    """_id, text, _label of at most `rows` labelled documents that aren't held out, the first by hash.

    The chosen ids, bounded by `rows`, are broadcast, so no text is shuffled. Rows without id or label are
    passed over; of several labels of an id the largest counts.
    """
    chosen = labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull() & (F.crc32(F.col("doc_id").cast("string")) % 5 != 0))
    chosen = bounded_sample(chosen.groupBy(F.col("doc_id").alias("_id")).agg(F.max(label).cast("int").alias("_label")), rows, "_id")
    text = docs.select("doc_id", text_of().alias("text"))
    return text.join(F.broadcast(chosen), F.col("doc_id") == F.col("_id")).select("_id", "text", "_label")


def telling_words(rows: DataFrame) -> list[str]:
    """The VOCABULARY words of rows (w: words, _label) whose frequency differs most between the classes, by a z-score; ties by name."""
    total = rows.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("_label"), F.lit(0)).alias("n1")).first()
    n, n1 = total["n"], total["n1"]
    counts = rows.select(F.explode("w").alias("w"), "_label").groupBy("w").agg(F.count(F.lit(1)).alias("n"), F.sum("_label").alias("a")).where(F.col("n") >= SEEN_IN)
    share = F.col("n") / F.lit(max(1, n))
    gap = F.abs(F.col("a") / F.lit(max(1, n1)) - (F.col("n") - F.col("a")) / F.lit(max(1, n - n1)))
    z = gap / F.sqrt(share * (1 - share) * F.lit(1 / max(1, n1) + 1 / max(1, n - n1)) + 1e-9)
    return [r["w"] for r in counts.orderBy(z.desc(), "w").limit(VOCABULARY).collect()]


def fit_on(docs: DataFrame, labels: DataFrame, rows: int = FIT_ROWS) -> Chain:
    """Fit on at most `rows` labelled documents that aren't held out, whole texts of any length. The driver gets their telling words only."""

    @F.pandas_udf("array<string>")
    def words(texts: pd.Series) -> pd.Series:
        return pd.Series([sorted(words_of(t)) for t in texts])

    sample = materialize(training_rows(docs, labels, "toxic", rows).select("_id", words("text").alias("w"), "_label"), "toxicity-words")
    known = set(telling_words(sample))

    @F.pandas_udf("array<string>")
    def told(lists: pd.Series) -> pd.Series:
        return pd.Series([[w for w in ws if w in known] for ws in lists])

    found = sample.select("_id", told("w").alias("w"), "_label").collect()
    found.sort(key=lambda r: (zlib.crc32(str(r["_id"]).encode()), str(r["_id"]), r["w"]))
    return fit_chain([set(r["w"]) for r in found], np.array([r["_label"] for r in found], dtype=np.float64))


def score_toxicity(docs: DataFrame, labels: DataFrame | None = None, chain: Chain | None = None) -> DataFrame:
    """One row per row of docs: doc_id, a probability for each category, score, toxic (score >= 0.5).

    Whole texts are read; null counts as empty. Repeated rows and null ids give rows of their own, an
    empty table gives none. A scan and a projection once the chain is fitted, on at most FIT_ROWS labelled rows
    and VOCABULARY words.
    """
    chain = chain or fit_on(docs, labels)
    used = set().union(*(m.words for m in chain.models))
    names = [f"p_{n}" for n in chain.names[:-1]]

    @F.pandas_udf(f"{', '.join(f'{n} double' for n in names)}, score double")
    def scored(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        known: dict[frozenset, list[float]] = {}
        for batch in texts:
            rows = []
            for text in batch:
                own = frozenset(used.intersection(_WORD.findall(text.lower())))
                if own not in known:
                    if len(known) > 100_000:
                        known.clear()
                    known[own] = chain.scores(own)
                rows.append(known[own])
            yield pd.DataFrame(rows, columns=[*names, "score"], dtype="float64")

    rows = docs.select("doc_id", scored(text_of()).alias("_s"))
    return rows.select("doc_id", *[F.col(f"_s.{n}").alias(n) for n in names], F.col("_s.score").alias("score"), (F.col("_s.score") >= THRESHOLD).alias("toxic"))
