"""Toxicity score: logistic regression over hashed word n-grams, fitted by FTRL-proximal (operator 2).

Words are runs of word characters in lower case. A text's features are the set of hashes of its words, of its pairs of
neighbours and of its pairs with one word left out between (skip-grams), and of the stems of its words, their first four to six letters,
so that inflected and compound forms of one insult share evidence. Every coordinate has its own learning rate, and the L1 term
keeps coordinates at exactly zero unless the evidence for them is strong, so the fitted weights are few: they are kept as
(hash, weight) arrays of at most ``DIMENSIONS`` entries and sent with the function.

The fit runs on a bounded sample: ``SAMPLE_ROWS`` labelled texts of at most ``SAMPLE_CHARS`` characters, in one task. Only the fitted weights
reach the driver. Every text is scored whole.

Cases: a null or empty text has no feature, its score is that of the bias alone. Null labels and labels of unknown documents are
not used; of several labels of one document the largest counts. Repeated rows get the same score each. Without any label the score is 0.5.
Other columns are not looked at and may have any name.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame

from pagemill.llm.zstd_quality import SAMPLE_CHARS, fitted, labelled_sample

__all__ = ["DIMENSIONS", "SAMPLE_CHARS", "SAMPLE_ROWS", "ToxicityModel", "features", "fit", "train"]

SAMPLE_ROWS = 10_000
DIMENSIONS = 1 << 22
STEMS = (4, 5, 6)
EPOCHS = 5
ALPHA, BETA, L1, L2 = 1.0, 1.0, 6.0, 0.1
#: A toxic text counts as so many clean ones in the fit.
POSITIVE_WEIGHT = 2.0
_WORDS = re.compile(r"\w+")
_CACHED_WORDS = 300_000


class WordHashes:
    """Hashes of words and of their stems, remembered up to a fixed number of words."""

    def __init__(self) -> None:
        self.known: dict[str, int] = {}
        self.rows = np.zeros((_CACHED_WORDS, 1 + len(STEMS)), dtype=np.uint64)

    def _learn(self, word: str) -> None:
        at = self.known[word] = len(self.known)
        self.rows[at, 0] = zlib.crc32(word.encode("utf-8", "surrogatepass"))
        for k, length in enumerate(STEMS, 1):
            self.rows[at, k] = zlib.crc32(word[:length].encode("utf-8", "surrogatepass")) if len(word) > length else 0

    def __call__(self, text: str) -> np.ndarray:
        """A row for each word of the text: its hash, and that of each stem shorter than it."""
        words = _WORDS.findall(text.lower())
        parts, at = [], 0
        while at < len(words):
            part = words[at : at + _CACHED_WORDS // 2]
            new = set(part).difference(self.known)
            if len(self.known) + len(new) > _CACHED_WORDS:
                self.known.clear()
                new = set(part)
            for w in new:
                self._learn(w)
            parts.append(self.rows[[self.known[w] for w in part]])
            at += len(part)
        return np.concatenate(parts) if parts else self.rows[:0]


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return ((h ^ (h >> np.uint64(32))) & np.uint64(DIMENSIONS - 1)).astype(np.int32)


def _hashed(rows: np.ndarray) -> np.ndarray:
    """All features of a text, repeats included."""
    odd, other = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
    h = rows[:, 0]
    parts = [h * odd]
    if len(h) > 1:
        parts.append(h[:-1] * odd + h[1:] * other + np.uint64(1))
    if len(h) > 2:
        parts.append(h[:-2] * odd + h[2:] * other + np.uint64(2))
    for k in range(1, rows.shape[1]):
        stem = rows[:, k]
        parts.append(stem[stem != 0] * odd + np.uint64(2 + k))
    return _mix(np.concatenate(parts))


def features(text: str | None, hashes: WordHashes) -> np.ndarray:
    """The distinct hashed features of a text."""
    return np.unique(_hashed(hashes(text or "")))


@dataclass(frozen=True)
class ToxicityModel:
    index: np.ndarray
    weight: np.ndarray
    bias: float

    def scorer(self):
        """A function from texts to their probabilities of label 1."""
        table = np.zeros(DIMENSIONS, dtype=np.float32)
        table[self.index] = self.weight
        hashes = WordHashes()

        def one(text: str | None) -> float:
            x = _hashed(hashes(text or ""))
            hit = x[table[x] != 0]
            return self.bias + float(table[np.unique(hit)].sum(dtype=float))

        def score(texts: list[str | None]) -> np.ndarray:
            z = np.array([one(t) for t in texts], dtype=float)
            return 1.0 / (1.0 + np.exp(-np.clip(z, -60, 60)))

        return score


def fit(rows: list[np.ndarray], label: np.ndarray, epochs: int = EPOCHS) -> ToxicityModel:
    """FTRL-proximal over the rows, in a seeded order. The bias has a coordinate of its own, without L1."""
    z, n = np.zeros(DIMENSIONS, dtype=np.float32), np.zeros(DIMENSIONS, dtype=np.float32)
    bz = bn = bias = 0.0

    def weights(i: np.ndarray) -> np.ndarray:
        zi = z[i]
        w = -(zi - np.sign(zi) * L1) / ((BETA + np.sqrt(n[i])) / ALPHA + L2)
        w[np.abs(zi) <= L1] = 0.0
        return w

    rng = np.random.default_rng(7)
    for _ in range(epochs):
        for r in rng.permutation(len(rows)):
            i = rows[r]
            w = weights(i)
            bias = -bz / ((BETA + bn**0.5) / ALPHA)
            g = 1.0 / (1.0 + np.exp(-np.clip(w.sum() + bias, -35, 35))) - label[r]
            g *= POSITIVE_WEIGHT if label[r] else 1.0
            n_new = n[i] + g * g
            z[i] += g - (np.sqrt(n_new) - np.sqrt(n[i])) / ALPHA * w
            n[i] = n_new
            bz += g - ((bn + g * g) ** 0.5 - bn**0.5) / ALPHA * bias
            bn += g * g
    bias = -bz / ((BETA + bn**0.5) / ALPHA)
    index = np.flatnonzero(np.abs(z) > L1)
    return ToxicityModel(index.astype(np.int32), weights(index).astype(np.float32), float(bias))


def train(docs: DataFrame, labels: DataFrame, use: Column | None = None, id_col: str = "doc_id") -> ToxicityModel:
    """Fits the model on a bounded sample of labelled texts, on an executor."""
    sample = labelled_sample(docs, labels, "toxic", use, id_col, SAMPLE_ROWS).select("t", "label")

    def fit_all(batches: Iterator[pa.RecordBatch]) -> ToxicityModel:
        hashes, rows, label = WordHashes(), [], []
        for b in batches:
            rows += [features(t, hashes) for t in b.column(0).to_pylist()]
            label += b.column(1).to_pylist()
        return fit(rows, np.array(label, dtype=float))

    model = fitted(sample, fit_all)
    return ToxicityModel(**model) if model else fit([], np.empty(0))
