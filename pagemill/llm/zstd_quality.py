"""Quality score from compression (operator 1).

Two zstandard dictionaries are built, one from text labelled good and one from text labelled bad. A text is cut into
blocks of equal size and every block is compressed with both; the text's features are

    d = (bytes with the bad dictionary - bytes with the good one) / bytes of the text
    r = bytes with the good dictionary / bytes of the text

so text like the good samples has a high d. Blocks keep d comparable for short and long texts, since a dictionary helps
only the beginning of what it compresses. A logistic curve fitted on labelled texts that no dictionary has seen turns d into the
probability of label 1; r corrects it for texts that repeat themselves, which both dictionaries compress alike.

The dictionaries and the curve come from a bounded sample, ``SAMPLE_ROWS`` labelled texts of at most ``SAMPLE_CHARS``
characters, the rows with the smallest hash of id and text. The model is at most 2 * ``DICT_BYTES`` and a few
numbers, so it goes to the executors with the function. Every text is scored whole.

Cases: a null or empty text has no bytes; its d is 0 and its r is 1. A label may be null or name an unknown document, and is then not used;
of several labels of one document the largest counts. Repeated rows get the same score each. Without labels of both
kinds there is nothing to learn: the model then gives everything the share of good labels, or 0.5 without any. Other
columns are not looked at and may have any name.
"""

from __future__ import annotations

import math
import pickle
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard as zstd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SAMPLE_ROWS = 6000
SAMPLE_CHARS = 32_768
DICT_BYTES = 65_536
#: Blocks that dictionaries are trained on, and blocks that texts are measured in.
SAMPLE_BLOCK, BLOCK_BYTES = 4096, 512
LEVEL = 3


@dataclass(frozen=True)
class QualityModel:
    good: bytes
    bad: bytes
    slopes: tuple[float, float]
    offset: float

    def scorer(self):
        """A function from texts to their probabilities of label 1."""
        measure = difference_measure(self.good, self.bad)

        def score(texts: list[str | None]) -> np.ndarray:
            x = np.array([measure(t) for t in texts], dtype=float).reshape(-1, 2)
            return 1.0 / (1.0 + np.exp(-np.clip(x @ np.array(self.slopes) + self.offset, -60, 60)))

        return score


def difference_measure(good: bytes, bad: bytes):
    """A function from a text to d and r; 0 and 1 for every text where a dictionary is missing."""
    if not good or not bad:
        return lambda text: (0.0, 1.0)

    def compressor(data: bytes) -> zstd.ZstdCompressor:
        return zstd.ZstdCompressor(
            level=LEVEL,
            dict_data=zstd.ZstdCompressionDict(data),
            write_checksum=False,
            write_content_size=False,
            write_dict_id=False,
        )

    with_good, with_bad = compressor(good), compressor(bad)

    def measure(text: str | None) -> tuple[float, float]:
        raw = (text or "").encode("utf-8", "surrogatepass")
        if not raw:
            return 0.0, 1.0
        like_good = like_bad = 0
        for at in range(0, len(raw), BLOCK_BYTES):
            block = raw[at : at + BLOCK_BYTES]
            like_good += len(with_good.compress(block))
            like_bad += len(with_bad.compress(block))
        return (like_bad - like_good) / len(raw), like_good / len(raw)

    return measure


def build_dictionary(texts: list[str], size: int = DICT_BYTES) -> bytes:
    """A trained dictionary, or the texts themselves where there are too few to train on."""
    blocks = []
    for text in texts:
        raw = text.encode("utf-8", "surrogatepass")
        blocks += [raw[at : at + SAMPLE_BLOCK] for at in range(0, len(raw), SAMPLE_BLOCK)]
    try:
        return zstd.train_dictionary(size, blocks, level=LEVEL).as_bytes()
    except (zstd.ZstdError, ValueError):
        return b"".join(blocks)[-size:]


def fit_curve(x: np.ndarray, label: np.ndarray) -> tuple[tuple[float, float], float]:
    """Slopes and offset of the logistic curve, by Newton's method with a weak prior on the slopes."""
    middle, scale = x.mean(axis=0), x.std(axis=0)
    scale[scale == 0] = 1.0
    z = np.column_stack([(x - middle) / scale, np.ones(len(x))])
    prior = np.array([0.05, 0.05, 0.01])
    w = np.zeros(3)
    for _ in range(50):
        p = 1.0 / (1.0 + np.exp(-np.clip(z @ w, -30, 30)))
        step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + np.diag(prior), z.T @ (label - p) - prior * w)
        w += np.clip(step, -3, 3)
        if np.abs(step).max() < 1e-9:
            break
    slopes = w[:2] / scale
    return (float(slopes[0]), float(slopes[1])), float(w[2] - slopes @ middle)


def labelled_sample(
    docs: DataFrame, labels: DataFrame, label_col: str, use: Column | None, id_col: str = "doc_id", rows: int = SAMPLE_ROWS
) -> DataFrame:
    """At most ``rows`` labelled texts, each once however often its row is repeated: id, text and label. ``use`` is a condition on the label table's id column.

    The label ids are narrowed to twice the bound before they meet the documents, so only their texts are shuffled.
    """
    known = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull())
    if use is not None:
        known = known.where(use)
    known = known.groupBy(F.col(id_col).alias("id")).agg(F.max(label_col).cast("int").alias("label"))
    few = known.orderBy(F.xxhash64("id"), "id").limit(2 * rows)
    texts = docs.select(F.col(id_col).alias("id"), F.col("text").alias("t")).where(
        F.col("t").isNotNull() & (F.length("t") <= SAMPLE_CHARS)
    )
    found = texts.join(F.broadcast(few), "id").distinct()
    return found.orderBy(F.xxhash64("id", "t"), "id").limit(rows)


def fitted(sample: DataFrame, fit: Callable[[Iterator[pa.RecordBatch]], object]) -> dict | None:
    """The fields of the model that ``fit`` makes of the rows of a bounded sample, in their order; None if no task ran, as there were none.

    One task fits it, and the driver gets nothing but the model: its memory does not depend on the texts, and what it once took it would keep.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(vars(fit(batches)))], pa.binary())], names=["model"])

    rows = sample.coalesce(1).mapInArrow(run, "model binary").collect()
    return pickle.loads(rows[0]["model"]) if rows else None


def _fit(rows: list[tuple[str, int, int]]) -> QualityModel:
    """Dictionaries from three quarters of (text, label, part) and the curve from the rest."""
    build = [(t, label) for t, label, part in rows if part != 0]
    good = [t for t, label in build if label == 1]
    bad = [t for t, label in build if label == 0]
    share = (sum(label for _, label, _ in rows) + 1) / (len(rows) + 2)
    offset = math.log(share / (1 - share))
    if not good or not bad:
        return QualityModel(b"", b"", (0.0, 0.0), offset)
    good_dict, bad_dict = build_dictionary(good), build_dictionary(bad)
    rest = [(t, label) for t, label, part in rows if part == 0]
    if len({label for _, label in rest}) < 2:
        rest = [(t, label) for t, label, _ in rows]
    measure = difference_measure(good_dict, bad_dict)
    x = np.array([measure(t) for t, _ in rest])
    slopes, offset = fit_curve(x, np.array([float(label) for _, label in rest]))
    return QualityModel(good_dict, bad_dict, slopes, offset)


def train(docs: DataFrame, labels: DataFrame, use: Column | None = None, id_col: str = "doc_id") -> QualityModel:
    """Fits dictionaries on three quarters of the sample and the curve on the rest, on an executor."""
    sample = labelled_sample(docs, labels, "quality", use, id_col).select("t", "label", (F.crc32(F.sha1("t")) % 4).alias("part"))

    def fit(batches: Iterator[pa.RecordBatch]) -> QualityModel:
        return _fit([row for b in batches for row in zip(*(c.to_pylist() for c in b.columns))])

    model = fitted(sample, fit)
    return QualityModel(**model) if model else _fit([])


def score_texts(docs: DataFrame, model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id and score of every document; ``model`` is anything with a ``scorer``."""
    picked = docs.select(F.col(id_col), F.col(text_col).alias("__text"))
    schema = picked.schema.fields[0]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score = model.scorer()
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(score(b.column(1).to_pylist()))], names=[id_col, "score"])

    return picked.mapInArrow(run, f"`{id_col}` {schema.dataType.simpleString()}, score double")


def keep_texts(docs: DataFrame, model, threshold: float, keep_above: bool, text_col: str = "text") -> DataFrame:
    """The documents, with all their columns, that score at least the threshold (or below it)."""
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score = model.scorer()
        for b in batches:
            high = score(b.column(at).to_pylist()) >= threshold
            yield b.filter(pa.array(high if keep_above else ~high))

    return docs.mapInArrow(run, docs.schema)
