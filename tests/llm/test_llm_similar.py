import random
from collections import defaultdict
from itertools import combinations

import numpy as np
import pytest

from pagemill.llm import collision_dedup, forest_jaccard, linking
from pagemill.llm.common import WORD

RND = random.Random(8)


def text(n):
    return " ".join(f"w{RND.randrange(5000)}" for _ in range(n))


def edited(t, edits):
    words = t.split()
    for _ in range(edits):
        words[RND.randrange(len(words))] = f"e{RND.randrange(10**6)}"
    return " ".join(words)


def shingles(t):
    w = WORD.findall(t or "")
    return {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()


def expected(ids, linked):
    """Links and components by brute force."""
    links, near = defaultdict(int), defaultdict(set)
    for a, b in combinations(ids, 2):
        if linked(a, b):
            links[a] += 1
            links[b] += 1
            near[a].add(b)
            near[b].add(a)
    component = {}
    for i in sorted(ids):
        todo = [i]
        while todo:
            k = todo.pop()
            if k not in component:
                component[k] = i
                todo += near[k]
    return {i: (links[i], component[i], component[i] == i) for i in ids}


def documents():
    rows = [(k, text(80)) for k in range(40)]
    base = text(200)
    rows += [(100 + k, edited(base, k % 5)) for k in range(40)]
    rows += [(200 + k, base) for k in range(30)]
    shared = text(60)
    rows += [(300 + k, shared + " " + text(60)) for k in range(20)]
    rows += [(400, "a b"), (401, "a b"), (402, "a  b"), (403, None), (404, ""), (405, " \n"), (406, "a b c")]
    rows += [(500, text(30_000))]
    rows += [(501, edited(rows[-1][1], 300))]
    return rows


def test_documents_match_brute_force(docs):
    rows = documents()
    sets = {i: shingles(t) for i, t in rows}

    def linked(a, b):
        both = len(sets[a] & sets[b])
        return both and 5 * both >= 4 * (len(sets[a]) + len(sets[b]) - both)

    want = expected(list(sets), linked)
    got = forest_jaccard.similar_documents(docs([*rows, (3, rows[3][1]), (None, "x y z"), (None, None)])).collect()
    assert len(got) == len(rows) + 3
    for r in got:
        if r.doc_id is None:
            assert (r.n_links, r.component_id, r.kept) == (0, None, True)
        else:
            assert (r.n_links, r.component_id, r.kept) == want[r.doc_id], r.doc_id


def test_rows_without_an_id_are_compared(docs):
    far = 10**6  # stands for rows without an id, which are never the smallest
    rows = documents()
    one, two = text(100), text(120)
    base = rows[40][1]
    nameless = [base, edited(base, 1), edited(base, 2), one, one, one, edited(one, 1), two, "", None, None, rows[0][1]]
    every = [*rows, *((far + k, t) for k, t in enumerate(nameless))]
    sets = {i: shingles(t) for i, t in every}

    def linked(a, b):
        both = len(sets[a] & sets[b])
        return both and 5 * both >= 4 * (len(sets[a]) + len(sets[b]) - both)

    want = expected(list(sets), linked)
    frame = docs([*rows, *((None, t) for t in nameless)])
    found = forest_jaccard.similar_documents(frame)
    got = found.collect()
    assert sorted((r.n_links, far if r.component_id is None else r.component_id) for r in got if r.doc_id is None) == sorted(
        (n, min(c, far)) for i, (n, c, _) in want.items() if i >= far
    )
    for r in got:
        if r.doc_id is not None:
            assert (r.n_links, r.component_id, r.kept) == want[r.doc_id], r.doc_id
    left = forest_jaccard.one_of_each(frame, found).collect()
    assert sorted(r.doc_id for r in left if r.doc_id is not None) == sorted(i for i, (_, _, kept) in want.items() if kept and i < far)
    texts = [r.text for r in left if r.doc_id is None]
    assert sorted(t or "" for t in texts if t != two)[:3] == ["", "", ""] and texts.count(two) == 1
    assert len(texts) == 5 and shingles(one) & shingles(max((t or "" for t in texts if t != two), key=len))


def test_large_groups_are_cut_into_tiles(docs, monkeypatch):
    monkeypatch.setattr(linking, "CHUNK", 16)
    monkeypatch.setattr(linking.tiles, "__defaults__", (16,))
    base = text(150)
    rows = [(k, edited(base, k % 7)) for k in range(90)]
    sets = {i: shingles(t) for i, t in rows}

    def linked(a, b):
        both = len(sets[a] & sets[b])
        return 5 * both >= 4 * (len(sets[a]) + len(sets[b]) - both)

    want = expected(list(sets), linked)
    got = {r.doc_id: (r.n_links, r.component_id, r.kept) for r in forest_jaccard.similar_documents(docs(rows)).collect()}
    assert got == want


def test_one_of_each_keeps_columns_and_rows_without_id_or_text(docs):
    rows = [(1, "a b c d e f"), (2, "a b c d e f"), (3, "x"), (3, "x"), (None, "a b c d e f"), (None, None)]
    frame = docs(rows)
    kept = forest_jaccard.one_of_each(frame, forest_jaccard.similar_documents(frame))
    assert kept.columns == frame.columns
    assert sorted((r.doc_id or 0) for r in kept.collect()) == [0, 1, 3]


def test_different_texts_of_one_id_are_judged_for_themselves(docs):
    one, two, three = text(60), text(60), text(60)
    frame = docs([(5, one), (5, two), (5, two), (5, three), (6, edited(one, 1)), (7, two), (8, three.replace(" ", "  ")), (5, three + " ")])
    found = forest_jaccard.similar_documents(frame)
    digests = {r.text_hash: r for r in found.collect()}
    assert len(digests) == 6  # three texts, an edit and two other spacings
    assert sorted((r.doc_id, r.n_links, r.component_id, r.kept) for r in found.collect()) == [(5, 1, 5, True)] * 5 + [(k, 1, 5, False) for k in (6, 7, 8)]
    kept = [(r.doc_id, " ".join(r.text.split())) for r in forest_jaccard.one_of_each(frame, found).collect()]
    assert sorted(kept) == sorted([(5, one), (5, two), (5, three)])


def test_prefix_depth_meets_the_recall():
    for recall in (0.9, 0.99, 0.999):
        k = forest_jaccard.prefix_depth(0.8, recall)
        assert 1 - (1 - 0.8**k) ** forest_jaccard.TREES >= recall
        assert k == forest_jaccard.DEPTH or 1 - (1 - 0.8 ** (k + 1)) ** forest_jaccard.TREES < recall


def vectors():
    rng = np.random.default_rng(3)
    rows = [(k, rng.standard_normal(16)) for k in range(150)]
    for k in range(60):
        rows.append((200 + k, rows[k % 3][1] + 0.05 * rng.standard_normal(16)))
    for k in range(40):
        rows.append((300 + k, rows[5][1]))
    for k in range(40):  # near the threshold
        rows.append((400 + k, rows[10 + k][1] + rng.uniform(0.2, 0.5) * rng.standard_normal(16)))
    return [(i, [float(x) for x in v]) for i, v in rows]


BROKEN = [(900, None), (901, []), (902, [0.0] * 16), (903, [1.0] * 15 + [None]), (904, [float("nan")] * 16),
          (905, [float("inf")] + [0.0] * 15), (906, [1.0, 2.0])]


def test_vectors_match_brute_force(spark):
    rows = vectors()
    unit = {i: np.array(v) / np.linalg.norm(v) for i, v in rows}
    want = expected(list(unit), lambda a, b: unit[a] @ unit[b] >= 0.95)
    frame = spark.createDataFrame([*rows, *BROKEN, rows[7], (None, rows[7][1])], "vec_id bigint, embedding array<float>")
    frame = frame.selectExpr("*", "1 AS id", "'x' AS key", "2 AS component")
    no_id = 10**9  # stands for the row without an id, which is never the smallest
    exact = {no_id if r.vec_id is None else r.vec_id: np.array(r.embedding, dtype=float) for r in frame.collect() if r.vec_id is None or r.vec_id < 900}
    unit = {i: v / np.linalg.norm(v) for i, v in exact.items()}
    want = expected(list(unit), lambda a, b: unit[a] @ unit[b] >= 0.95)
    got = collision_dedup.near_duplicates(frame).collect()
    assert len(got) == len(rows) + len(BROKEN) + 2
    found = sum({r.vec_id: r.n_links for r in got if r.vec_id is None or r.vec_id < 900}.values())
    true = sum(w[0] for w in want.values())
    assert found >= 0.98 * true
    for r in got:
        if r.vec_id is None:
            assert 0 < r.n_links <= want[no_id][0] and r.component_id == want[no_id][1] and not r.kept
        elif r.vec_id >= 900:
            assert (r.n_links, r.component_id, r.kept) == (0, r.vec_id, True)
        else:
            assert r.n_links <= want[r.vec_id][0]
        if r.vec_id is not None and r.vec_id >= 300 and r.vec_id < 340:
            assert r.component_id == 5


def test_every_vector_of_an_id_is_compared(spark):
    a, b, c = ([float(k == i) for k in range(16)] for i in range(3))
    near = lambda v: [x + 0.01 for x in v]
    rows = [(1, a), (1, b), (2, near(a)), (3, near(b)), (3, near(b)), (None, near(c)), (None, c), (4, [1.0] * 16)]
    got = collision_dedup.near_duplicates(spark.createDataFrame(rows, "vec_id bigint, embedding array<float>")).collect()
    assert sorted((r.vec_id or 0, r.n_links, r.component_id, r.kept) for r in got) == [
        (0, 1, None, True), (0, 1, None, True), (1, 1, 1, True), (1, 1, 1, True), (2, 1, 1, False), (3, 1, 1, False), (3, 1, 1, False), (4, 0, 4, True)
    ]
    empty = spark.createDataFrame([], "vec_id bigint, embedding array<float>")
    assert collision_dedup.near_duplicates(empty).count() == 0


@pytest.mark.parametrize("n", [10, 10_000, 10**9])
def test_plan_meets_the_recall_at_every_size(n):
    p = collision_dedup.Plan.of(n, 64, 0.95, 0.99)
    hit = collision_dedup.cell_chance(0.1**0.5, p.width) ** p.per_table
    assert 1 - (1 - hit) ** p.tables >= 0.99


def isolated_pairs(pairs, dim, low, high):
    """Pairs of random vectors at a cosine between ``low`` and ``high``."""
    rng = np.random.default_rng(11)
    a, b = rng.standard_normal((2, pairs, dim))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    b -= (a * b).sum(axis=1, keepdims=True) * a
    b /= np.linalg.norm(b, axis=1, keepdims=True)
    c = np.linspace(low, high, pairs)[:, None]
    return np.stack([a, c * a + np.sqrt(1 - c * c) * b], axis=1).reshape(-1, dim)


@pytest.mark.parametrize("low, high", [(0.9501, 0.9502), (0.9501, 0.97)])
def test_isolated_pairs_at_the_threshold_are_found(spark, low, high):
    frame = spark.createDataFrame(enumerate(isolated_pairs(2000, 64, low, high).tolist()), "vec_id bigint, embedding array<double>")
    rows = collision_dedup.near_duplicates(frame, recall=0.99).collect()
    assert all(r.component_id in (r.vec_id, r.vec_id - r.vec_id % 2) for r in rows)
    assert sum(r.n_links for r in rows) >= 0.985 * len(rows)


def test_vectors_of_every_length_are_compared(spark):
    sets = [isolated_pairs(40, 16, 0.98, 0.99), isolated_pairs(25, 24, 0.98, 0.99), isolated_pairs(1, 3, 0.99, 0.99)]
    vecs = [v.tolist() for s in sets for v in s] + [[1.0] * 5]
    got = collision_dedup.near_duplicates(spark.createDataFrame(enumerate(vecs), "vec_id bigint, embedding array<double>")).collect()
    unit = [np.array(v) / np.linalg.norm(v) for v in vecs]
    want = expected(range(len(vecs)), lambda a, b: len(vecs[a]) == len(vecs[b]) and unit[a] @ unit[b] >= 0.95)
    assert {r.vec_id: (r.n_links, r.component_id, r.kept) for r in got} == want


def test_empty_tables(spark, docs):
    assert forest_jaccard.similar_documents(docs([])).count() == 0
    assert collision_dedup.near_duplicates(spark.createDataFrame([], "vec_id bigint, embedding array<float>")).count() == 0
    assert collision_dedup.near_duplicates(spark.createDataFrame(BROKEN, "vec_id bigint, embedding array<float>")).count() == len(BROKEN)


def test_components_of_a_long_chain_and_a_star(spark):
    edges = [(k, k + 1) for k in range(1, 300)] + [(1000, 1000 + k) for k in range(1, 200)] + [(5, 5)]
    RND.shuffle(edges)
    got = {r.id: r.component for r in linking.components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert got == {k: 1 for k in range(1, 301)} | {1000 + k: 1000 for k in range(200)}
