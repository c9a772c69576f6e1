import math
import random
from collections import Counter

import numpy as np
import pytest

from pagemill.llm import lattice_lm
from pagemill.llm.lattice import Lattice
from pagemill.llm.queries import pieces_path
from pyspark.sql import functions as F

PIECES = ["a", "b", "ab", "ba", "aba", "▁", "▁a"]


def segmentations(word, pieces):
    if not word:
        yield ()
    for p in pieces:
        if word.startswith(p):
            for rest in segmentations(word[len(p) :], pieces):
                yield (p, *rest)
    if word and word[0] not in pieces:
        for rest in segmentations(word[1:], pieces):
            yield (word[0], *rest)


def brute(word, score, byte):
    """Log marginal and expected uses over all segmentations."""
    total, uses, spelled = 0.0, Counter(), 0.0
    for s in segmentations(word, PIECES):
        p = math.exp(sum(score.get(x, len(x.encode()) * byte) for x in s))
        total += p
        for x in s:
            uses[x] += p
            spelled += p * len(x.encode()) * (x not in score)
    return math.log(total), {k: v / total for k, v in uses.items()}, spelled / total


def test_lattice_matches_all_segmentations(monkeypatch):
    scores = np.log(np.array([0.2, 0.1, 0.15, 0.05, 0.1, 0.2, 0.1]))
    lattice, score = Lattice(PIECES, scores, -6.0), dict(zip(PIECES, scores.tolist()))
    words = ["a", "ab", "▁abab", "▁aéb", "bbb", "▁ab😀aba", "ababababab", "é"]
    counts = np.array([1.0, 2, 3, 1, 5, 1, 2, 4])
    for wide in (64, 0):
        monkeypatch.setattr("pagemill.llm.lattice._WIDE", wide)
        got = lattice.log_marginals(words)
        uses, spelled = lattice.expected(words, counts)
        want_uses, want_spelled = Counter(), 0.0
        for w, c, g in zip(words, counts, got):
            z, own, s = brute(w, score, -6.0)
            assert g == pytest.approx(z)
            want_spelled += c * s
            for k, v in own.items():
                want_uses[k] += c * v
        assert uses == pytest.approx([want_uses[p] for p in PIECES])
        assert spelled == pytest.approx(want_spelled)


def test_scores_match_brute_force(docs):
    rnd = random.Random(3)
    texts = [" ".join(rnd.choice("the cat Sat on a mat xyz é 日本 ▁x".split()) for _ in range(rnd.randint(0, 30))) for _ in range(60)]
    rows = [(k, t) for k, t in enumerate(texts)] + [(60, None), (61, " \n"), (62, "z" * 3000), (5, texts[5]), (None, "the the")]
    frame = docs(rows)
    got = lattice_lm.score_documents(frame, pieces_path(), F.col("doc_id") % 7 == 2, buckets=5).collect()
    assert len(got) == len(rows)
    tokens = [[*(t or "").encode().lower().split(), None] for _, t in rows]
    held = [i is not None and i % 7 == 2 for i, _ in rows]
    c = Counter(w for t, h in zip(tokens, held) if not h for w in t)
    n, v = sum(c.values()), len(c)
    want = Counter()
    for (i, _), t, h in zip(rows, tokens, held):
        base = sum(math.log10((c[w] + 1) / (n + v + 1)) for w in t)
        want[i, h, len(t), sum(c[w] > 0 for w in t), n, round(base, 6)] += 1
    assert Counter((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got) == want
    assert all(math.isfinite(r.score) and r.score < 0 and r.lattice_score < 0 for r in got)
    seen = {r.doc_id: r.score / r.n_tokens for r in got}
    assert seen[5] > seen[62]


def test_packs_and_buckets_do_not_change_results(docs, monkeypatch):
    frame = docs([(k, f"alpha beta {k} gamma " * (k % 5)) for k in range(80)])
    rule = F.col("doc_id") % 7 == 2
    one = lattice_lm.score_documents(frame.coalesce(1), pieces_path(), rule, buckets=1).collect()
    many = lattice_lm.score_documents(frame.repartition(5), pieces_path(), rule, buckets=9).collect()
    assert {r.doc_id: round(r.score, 6) for r in one} == {r.doc_id: round(r.score, 6) for r in many}


def test_nothing_to_learn_from(docs):
    got = lattice_lm.score_documents(docs([(1, "a b"), (2, None)]), pieces_path(), F.lit(True)).collect()
    assert {(r.doc_id, r.n_tokens, r.n_known, r.train_tokens, r.base_score) for r in got} == {(1, 3, 0, 0, 0.0), (2, 1, 0, 0, 0.0)}
    assert all(math.isfinite(r.score) for r in got)
    assert lattice_lm.score_documents(docs([]), pieces_path(), F.lit(False)).count() == 0
