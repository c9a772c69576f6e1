import random

import pytest

from pagemill.llm import linking as L


def brute(edges):
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a is not None and b is not None and a != b:
            a, b = find(a), find(b)
            parent[max(a, b)] = min(a, b)
    return {x: find(x) for x in parent}


def shapes():
    rnd = random.Random(1)
    chain = [(k, k + 1) for k in range(0, 300)]
    shuffled = chain[:]
    rnd.shuffle(shuffled)
    star = [(1000, 1001 + k) for k in range(400)] + [(1000, 5)]
    loose = [(rnd.randrange(2000, 3000), rnd.randrange(2000, 3000)) for _ in range(500)]
    return {
        "chain": chain, "shuffled": shuffled, "star under a smaller node": star, "random": loose * 2, "negative": [(-5, 3), (3, -9), (7, 7)],
        "nulls": [(None, 1), (1, None), (2, 3), (3, 2)], "together": shuffled + star + loose,
    }


@pytest.mark.parametrize("name", list(shapes()))
@pytest.mark.parametrize("held", [L.EDGES, 20])
def test_components_equal_union_find(spark, name, held):
    edges = shapes()[name]
    got = L.components(spark.createDataFrame(edges, "a bigint, b bigint").repartition(3), held).collect()
    assert sorted((r.id, r.component) for r in got) == sorted(brute(edges).items())


def test_no_edges(spark):
    assert L.components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0
    assert L.components(spark.createDataFrame([(4, 4), (None, None)], "a bigint, b bigint")).count() == 0


def test_a_round_keeps_about_one_edge_per_node(spark, monkeypatch):
    """Nodes with many neighbours, dealt over many tasks: no round stores an edge for every task that a node met."""
    rnd, sizes, stored = random.Random(2), [], L.stored
    edges = [(k, rnd.randrange(60)) for k in range(60, 1000) for _ in range(12)]

    def counted(df, name):
        out = stored(df, name)
        sizes.append(out.count())
        return out

    monkeypatch.setattr(L, "stored", counted)
    conf = {"spark.sql.shuffle.partitions": "48", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in conf}
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        got = L.components(spark.createDataFrame(edges, "a bigint, b bigint").repartition(48)).collect()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert sorted((r.id, r.component) for r in got) == sorted(brute(edges).items())
    assert max(sizes) <= 2 * len(got)
