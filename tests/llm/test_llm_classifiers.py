import random

import numpy as np
import pytest

from pagemill.llm import ftrl_toxicity, zstd_quality
from pagemill.llm.common import fold
from pyspark.sql import functions as F

RND = random.Random(4)
GOOD = "river stone garden letter market silver winter summer engine teacher".split()


def good(n=60):
    return " ".join(RND.choice(GOOD) + RND.choice(("", "s", "ly", "ing")) for _ in range(n))


def bad(n=60):
    return " ".join(RND.choice("XQZ#*&%|") * 3 + RND.choice("0123456789") for _ in range(n))


def insult(n=60):
    words = good(n).split()
    words[RND.randrange(n)] = "bozo"
    words[RND.randrange(n)] = "twit" + RND.choice(("ish", "ter", "lor", "nak"))
    return " ".join(words)


EDGES = [(1000, None), (1001, ""), (1002, "word " * 200_000), (1003, good()), (1003, good()), (None, good())]


@pytest.mark.parametrize(("trainer", "label", "other"), [(zstd_quality, "quality", bad), (ftrl_toxicity, "toxic", insult)])
def test_held_out_accuracy_and_edge_rows(docs, labels, trainer, label, other):
    rows = [(k, good() if k % 3 else other()) for k in range(300)]
    marks = [(k, int(k % 3 > 0), int(k % 3 == 0)) for k in range(300)] + [(None, 1, 1), (5000, 0, 0), (7, None, None)]
    frame = docs(rows + EDGES)
    model = trainer.train(frame, labels(marks), fold(F.col("doc_id"), 5) != 0)
    got = zstd_quality.score_texts(frame, model).collect()
    assert len(got) == len(rows) + len(EDGES)
    assert all(0.0 <= r.score <= 1.0 for r in got)
    truth = {k: (q if label == "quality" else t) for k, q, t in marks}
    held = {r.doc_id for r in frame.where(fold(F.col("doc_id"), 5) == 0).select("doc_id").collect() if r.doc_id < 300}
    right = np.mean([(r.score >= 0.5) == truth[r.doc_id] for r in got if r.doc_id in held])
    assert len(held) > 30 and right > 0.95


@pytest.mark.parametrize("trainer", [zstd_quality, ftrl_toxicity])
def test_nothing_to_learn_from(docs, labels, trainer):
    frame = docs([(1, "a b"), (2, None)])
    model = trainer.train(frame, labels([]), None)
    assert {round(r.score, 6) for r in zstd_quality.score_texts(frame, model).collect()} == {0.5}
    assert zstd_quality.score_texts(docs([]), model).count() == 0
    assert trainer.train(docs([]), labels([(1, 1, 1)]), None) is not None


def test_filter_keeps_all_columns(docs, labels):
    frame = docs([(k, good() if k % 2 else bad()) for k in range(80)])
    model = zstd_quality.train(frame, labels([(k, k % 2, 0) for k in range(80)]))
    kept = zstd_quality.keep_texts(frame, model, 0.5, keep_above=True)
    assert kept.columns == frame.columns
    ids = [r.doc_id for r in kept.collect()]
    assert np.mean([k % 2 for k in ids]) > 0.9 and len(ids) > 30


def test_weights_are_sparse(docs, labels):
    frame = docs([(k, good() if k % 2 else insult()) for k in range(200)])
    model = ftrl_toxicity.train(frame, labels([(k, 1, 1 - k % 2) for k in range(200)]))
    assert 0 < len(model.index) < 500


def test_repeated_rows_take_one_place_in_the_sample(docs, labels):
    rows = [(k, f"text {k}") for k in range(20)]
    many = docs([*rows, *[row for row in rows for _ in range(30)], (3, "another")])
    known = labels([(k, k % 2, 0) for k in range(20)])
    got = zstd_quality.labelled_sample(many, known, "quality", None, rows=25).collect()
    assert sorted((r["id"], r["t"], r["label"]) for r in got) == sorted([(k, t, k % 2) for k, t in rows] + [(3, "another", 1)])
