"""Quality by attention-based multiple-instance learning.

A document is a bag of passages. Every passage is encoded; gated attention, learnt from document labels
alone, weighs the encodings; the weighted sum is scored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vicinage.llm.tables import text_of
from vicinage.llm.toxicity import sigmoid, training_rows

#: Labelled rows that the model is fitted on, and passages of each, evenly spread, at most.
FIT_ROWS, FIT_PASSAGES = 4000, 128
PASSAGE = 512  # bytes
HIDDEN, GATE = 16, 8
THRESHOLD = 0.3
#: Bytes of text that are worked on at a time; a longer text is taken in stretches of this size, and its phrases are new or not within one.
TOGETHER = 2 << 20

_GROUPS = ("aeiou", "bcdfghjklmnpqrstvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", " ", "\n\r", "\t", ".", ",", "!", "?", "|", "%", "$", "#", "&", "*", "<>", "{}[]()", "\"'`", ":;", "-_/\\", "@=+~^")
_CLASS = np.full(256, len(_GROUPS), np.uint8)
for _k, _chars in enumerate(_GROUPS):
    _CLASS[list(_chars.encode())] = _k
_CLASS[128:] = len(_GROUPS) + 1
_CLASSES = len(_GROUPS) + 2
#: Shares of the byte classes; words a byte; new words and phrases; fill of the passage; empty text.
FEATURES = _CLASSES + 5
_WHITE = np.zeros(256, bool)
_WHITE[[9, 10, 11, 12, 13, 32]] = True


def first_seen(owner: np.ndarray, what: np.ndarray) -> np.ndarray:
    """For each (owner, what), in order, whether it is the first of its kind."""
    order = np.lexsort((what, owner))
    new = np.ones(len(order), bool)
    same = (owner[order][1:] == owner[order][:-1]) & (what[order][1:] == what[order][:-1])
    new[1:] = ~same
    out = np.empty(len(order), bool)
    out[order] = new
    return out


def passages(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Features of all passages and the number of the text that each belongs to; an empty text has one."""
    sizes = np.array([len(t) for t in texts], dtype=np.int64)
    pieces = np.maximum(1, -(-sizes // PASSAGE))
    owner = np.repeat(np.arange(len(texts)), pieces)
    x = np.zeros((len(owner), FEATURES))
    data = np.frombuffer(b"".join(texts) + b" " * 24, np.uint8)
    n = len(data) - 24
    doc = np.repeat(np.arange(len(texts)), sizes)
    begin = np.concatenate([[0], np.cumsum(sizes)])
    first = np.concatenate([[0], np.cumsum(pieces)])
    at = first[doc] + (np.arange(n) - begin[doc]) // PASSAGE
    length = np.bincount(at, minlength=len(owner)).astype(np.float64)
    x[:, :_CLASSES] = np.bincount(at * _CLASSES + _CLASS[data[:n]], minlength=len(owner) * _CLASSES).reshape(-1, _CLASSES) / np.maximum(length, 1)[:, None]
    white = _WHITE[data[:n]]
    starts = np.flatnonzero(~white & (np.concatenate([[True], white[:-1]]) | (np.diff(doc, prepend=-1) != 0))) if n else np.zeros(0, np.int64)
    # Eight bytes from a word's start tell words, sixteen tell phrases.
    windows = np.lib.stride_tricks.sliding_window_view(data, 16)[starts]
    eight = np.ascontiguousarray(windows).view(np.uint64).reshape(-1, 2)
    with np.errstate(over="ignore"):
        phrase = (eight[:, 0] * np.uint64(0x9E3779B97F4A7C15)) ^ (eight[:, 1] * np.uint64(0xC2B2AE3D27D4EB4F))
    home = at[starts]
    words = np.bincount(home, minlength=len(owner)).astype(np.float64)
    some = np.maximum(words, 1)
    x[:, _CLASSES] = words / np.maximum(length, 1)
    x[:, _CLASSES + 1] = np.bincount(home, first_seen(home, eight[:, 0]), len(owner)) / some
    x[:, _CLASSES + 2] = np.bincount(home, first_seen(doc[starts], phrase), len(owner)) / some
    x[:, _CLASSES + 3] = length / PASSAGE
    x[:, _CLASSES + 4] = length == 0
    return x, owner


def grouped(texts: list[bytes]) -> Iterator[tuple[list[int], list[bytes]]]:
    """The texts in order, with their numbers, in groups of about TOGETHER bytes: features take some forty bytes a byte of text.

    A longer text comes in stretches of TOGETHER bytes, which are a whole number of passages.
    """
    numbers, group, size = [], [], 0
    for k, text in enumerate(texts):
        for at in range(0, max(1, len(text)), TOGETHER):
            numbers.append(k)
            group.append(text[at : at + TOGETHER])
            size += len(group[-1])
            if size >= TOGETHER:
                yield numbers, group
                numbers, group, size = [], [], 0
    if group:
        yield numbers, group


@dataclass
class Attention:
    """Passage encoder, gated attention and scorer."""

    mean: np.ndarray
    scale: np.ndarray
    p: dict[str, np.ndarray]

    def encoded(self, x: np.ndarray):
        z = np.clip((x - self.mean) / self.scale, -6, 6)
        h = np.tanh(z @ self.p["w"] + self.p["b"])
        t, s = np.tanh(h @ self.p["v"]), sigmoid(h @ self.p["u"])
        return z, h, t, s, (t * s) @ self.p["a"]

    def pooled(self, h: np.ndarray, e: np.ndarray, owner: np.ndarray, bags: int):
        top = np.full(bags, -np.inf)
        np.maximum.at(top, owner, e)
        a = np.exp(e - top[owner])
        a /= np.bincount(owner, a, bags)[owner]
        bag = np.stack([np.bincount(owner, a * h[:, j], bags) for j in range(h.shape[1])], 1)
        return a, bag, sigmoid(bag @ self.p["o"] + self.p["c"])

    def forward(self, x: np.ndarray, owner: np.ndarray, bags: int):
        z, h, t, s, e = self.encoded(x)
        return z, h, t, s, *self.pooled(h, e, owner, bags)

    def scores(self, texts: list[bytes]) -> np.ndarray:
        parts = []
        for numbers, group in grouped(texts):
            x, owner = passages(group)
            _, h, _, _, e = self.encoded(x)
            parts.append((h, e, np.array(numbers)[owner]))
        if not parts:
            return np.zeros(0)
        return self.pooled(*(np.concatenate(c) for c in zip(*parts)), len(texts))[-1]


def features_of(text: bytes, most: int = 1 << 62) -> np.ndarray:
    """Features of a text's passages, or of `most` of them, evenly spread."""
    x = np.concatenate([passages(group)[0] for _, group in grouped([text])])
    return x if len(x) <= most else x[np.arange(most) * len(x) // most]


def fit(bags: list[np.ndarray], y: np.ndarray, steps: int = 300, seed: int = 7) -> Attention:
    """Gradient descent on the log loss of whole documents, given as features of their passages. Without rows every score is 0.5."""
    rng = np.random.default_rng(seed)
    p = {"w": rng.normal(0, FEATURES**-0.5, (FEATURES, HIDDEN)), "b": np.zeros(HIDDEN), "v": rng.normal(0, HIDDEN**-0.5, (HIDDEN, GATE)), "u": rng.normal(0, HIDDEN**-0.5, (HIDDEN, GATE)), "a": np.zeros(GATE), "o": np.zeros(HIDDEN), "c": np.zeros(1)}
    if not bags:
        return Attention(np.zeros(FEATURES), np.ones(FEATURES), p)
    x, owner = np.concatenate(bags), np.repeat(np.arange(len(bags)), [len(b) for b in bags])
    model = Attention(x.mean(0), x.std(0) + 1e-3, p)
    p["a"] = rng.normal(0, 0.1, GATE)
    p["o"] = rng.normal(0, 0.1, HIDDEN)
    p["c"][:] = np.log((y.mean() + 1e-3) / (1 - y.mean() + 1e-3))
    first, second = ({k: np.zeros_like(v) for k, v in p.items()} for _ in range(2))
    for step in range(1, steps + 1):
        z, h, t, s, a, bag, score = model.forward(x, owner, len(y))
        d = (score - y) / len(y)
        d_bag = d[:, None] * p["o"]
        d_h = a[:, None] * d_bag[owner]
        d_a = (h * d_bag[owner]).sum(1)
        d_e = a * (d_a - np.bincount(owner, a * d_a, len(y))[owner])
        d_t, d_s = d_e[:, None] * p["a"] * s * (1 - t * t), d_e[:, None] * p["a"] * t * s * (1 - s)
        d_h += d_t @ p["v"].T + d_s @ p["u"].T
        d_z = d_h * (1 - h * h)
        grad = {"w": z.T @ d_z, "b": d_z.sum(0), "v": h.T @ d_t, "u": h.T @ d_s, "a": (t * s).T @ d_e, "o": bag.T @ d, "c": np.array([d.sum()])}
        for k, g in grad.items():
            g = g + 1e-4 * p[k]
            first[k] = 0.9 * first[k] + 0.1 * g
            second[k] = 0.999 * second[k] + 0.001 * g * g
            p[k] -= 0.02 * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)
    return model


def fit_on(docs: DataFrame, labels: DataFrame, rows: int = FIT_ROWS) -> Attention:
    """Fit on at most `rows` labelled documents that aren't held out, of any length. The driver gets features of at most FIT_PASSAGES passages of each."""

    @F.pandas_udf("binary")
    def made(texts: pd.Series) -> pd.Series:
        return pd.Series([features_of(t.encode(), FIT_PASSAGES).astype(np.float32).tobytes() for t in texts])

    found = training_rows(docs, labels, "quality", rows).select(made("text").alias("x"), "_label", "_id").collect()
    found.sort(key=lambda r: (str(r["_id"]), bytes(r["x"])))
    return fit([np.frombuffer(r["x"], np.float32).reshape(-1, FEATURES).astype(np.float64) for r in found], np.array([r["_label"] for r in found], dtype=np.float64))


def quality_score(text: Column, model: Attention) -> Column:
    @F.pandas_udf("double")
    def scored(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in texts:
            yield pd.Series(model.scores([t.encode() for t in batch]), dtype="float64")

    return scored(text)


def score_quality(docs: DataFrame, labels: DataFrame | None = None, model: Attention | None = None) -> DataFrame:
    """One row per row of docs: doc_id, held_out, score, predicted (1 if score >= 0.3).

    Whole texts are scored and nothing else of a row; null counts as empty, and an empty text has one
    empty passage. held_out is null for a null id. Repeated rows give rows of their own, an empty table none. The
    model is fitted on at most FIT_ROWS labelled rows and FIT_PASSAGES passages of each.
    """
    model = model or fit_on(docs, labels)
    rows = docs.select("doc_id", (F.crc32(F.col("doc_id").cast("string")) % 5 == 0).alias("held_out"), quality_score(text_of(), model).alias("score"))
    return rows.withColumn("predicted", F.when(F.col("score") >= THRESHOLD, 1).otherwise(0))


def keep_good(docs: DataFrame, labels: DataFrame, model: Attention | None = None) -> DataFrame:
    """The rows of docs that aren't rejected, with all their columns, whatever these are called.

    Each row is judged by its own text (null counts as empty), so ids may repeat, be missing or be of any type.
    An empty table stays empty.
    """
    model = model or fit_on(docs, labels)
    return docs.where(quality_score(text_of(), model) >= THRESHOLD)
