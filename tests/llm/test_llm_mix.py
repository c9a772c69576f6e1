import random
from itertools import product

import pytest

from pagemill.llm import flow_mix
from pyspark.sql import functions as F

RND = random.Random(5)


def cost(patterns, given):
    """Cost of what the patterns give under the convex costs of copies."""
    total = 0.0
    for (_, words), flow in zip(patterns, given):
        left = sum(flow.values())
        for c in flow_mix.COPY_COSTS:
            step = min(left, words)
            total += c * step
            left -= step
        assert left <= 1e-6
    return total


def brute(patterns, quotas):
    """Best (flow, cost) over all whole-number flows."""
    best = (-1, 0)
    edges = [(i, s) for i, (p, _) in enumerate(patterns) for s in sorted(p)]
    for amounts in product(*(range(int(min(quotas[s], 3 * patterns[i][1])) + 1) for i, s in edges)):
        given = [{} for _ in patterns]
        into = [0] * len(quotas)
        for (i, s), x in zip(edges, amounts):
            given[i][s] = x
            into[s] += x
        if any(a > q for a, q in zip(into, quotas)) or any(sum(g.values()) > 3 * patterns[i][1] for i, g in enumerate(given)):
            continue
        value = (sum(amounts), -cost(patterns, given))
        best = max(best, value)
    return best


@pytest.mark.parametrize("seed", range(6))
def test_route_is_a_cheapest_largest_flow(seed):
    rnd = random.Random(seed)
    patterns = [(frozenset((0,)), rnd.randint(0, 3)), (frozenset((0, 1)), rnd.randint(1, 3)), (frozenset((1,)), rnd.randint(0, 3))]
    quotas = [rnd.randint(0, 5), rnd.randint(0, 5)]
    given = flow_mix.route(patterns, quotas)
    flow = sum(sum(g.values()) for g in given)
    want = brute(patterns, quotas)
    assert flow == pytest.approx(want[0])
    assert cost(patterns, given) == pytest.approx(-want[1])


def targets(sizes, weights, total):
    """Targets by raising the share of one weight to each limit in turn."""
    limits = sorted(range(len(sizes)), key=lambda i: 3 * sizes[i] / weights[i])
    out, left, open_ = [0.0] * len(sizes), float(total), float(sum(weights))
    for i in limits:
        out[i] = min(3.0 * sizes[i], weights[i] * left / open_)
        left, open_ = left - out[i], open_ - weights[i]
    return out


def goals_of(spark, sizes, weights, total):
    frame = spark.createDataFrame(list(zip(range(len(sizes)), sizes, map(float, weights))), "k int, words bigint, weight double")
    return [r.target for r in flow_mix.targets(frame, total).orderBy("k").collect()]


def test_targets_are_capped_and_shared_again(spark):
    got = goals_of(spark, [10, 100, 1000], [1, 2, 3], 1110)
    assert got[0] == 30 and got[1] == 300 and got[2] == pytest.approx(780)
    assert goals_of(spark, [1, 1], [1, 1], 100) == [3, 3]
    assert goals_of(spark, [], [], 0) == []
    assert goals_of(spark, [0, 0, 5], [1, 2, 3], 5) == [0, 0, 5]
    sizes = [int(3 ** RND.uniform(0, 12)) for _ in range(60)]
    weights = [1 + k % 3 for k in range(60)]
    assert goals_of(spark, sizes, weights, sum(sizes)) == pytest.approx(targets(sizes, weights, sum(sizes)))


def test_sources_are_numbered_in_order(spark):
    names = [f"{k:x}{'é' * (k % 3)}{chr(0x1F600) if k % 7 == 0 else chr(0xFF5E)}" for k in range(3000)] + [None, ""]
    frame = spark.createDataFrame([(n,) for n in names], "source string").repartition(7)
    got = {r["source"]: r["rank"] for r in flow_mix.numbered(frame).collect()}
    assert got == {n: k for k, n in enumerate(sorted(names, key=lambda n: (n is None, n or "")))}


def test_more_sources_than_the_driver_should_see(docs):
    rows = [(k, "w " * (1 + k % 40), f"source {k}") for k in range(20_000)]
    mixed, sources = flow_mix.mix_by_source(docs(rows))
    known = {r["source"]: r for r in sources.collect()}
    assert len(known) == len(rows)
    order = sorted(known)
    goals = targets([known[s].words for s in order], [1 + k % 3 for k in range(len(order))], sum(r.words for r in known.values()))
    assert [known[s].target for s in order] == pytest.approx(goals)
    for r in mixed.collect():
        whole = known[r.source].target / r["__size"]
        assert abs(r["__copies"] - whole) <= 0.5 + 1e-9, r


def text(n):
    return " ".join("w" * RND.randint(1, 6) for _ in range(n))


def test_mix_by_source(docs):
    rows = [(k, text(RND.choice((1, 5, 40, 300))), f"s{k % 4}") for k in range(400)]
    rows += [(k, text(20), "big") for k in range(1000, 1400)] + [(k, text(9), None) for k in range(2000, 2100)]
    rows += [(3000, None, "s0"), (3001, "", "s1"), (3002, " \n", None), (3003, text(4000), "s2"), (5, rows[5][1], rows[5][2]), (None, "a", "s0")]
    frame = docs(rows)
    mixed, sources = flow_mix.mix_by_source(frame)
    assert mixed.columns == [*frame.columns, "__members", "__size", "__copies"]
    got = mixed.collect()
    assert len(got) == len(rows)
    sources = sources.orderBy(F.col("source").asc_nulls_last()).collect()
    assert [s for s, _, _ in sources] == ["big", "s0", "s1", "s2", "s3", None]
    weights = [1, 2, 3, 1, 2, 3]
    goals = targets([n for _, n, _ in sources], weights, sum(n for _, n, _ in sources))
    for (s, n, t), goal in zip(sources, goals):
        own = [r for r in got if r.source == s]
        assert n == sum(len((r.text or "").split()) for r in own) == sum(r["__size"] for r in own)
        assert t == pytest.approx(goal)
        taken = sum(r["__size"] * r["__copies"] for r in own)
        assert abs(taken - t) <= 0.02 * t + 5, (s, taken, t)
    assert all(0 <= r["__copies"] <= 3 for r in got)
    assert all(r["__copies"] == 0 for r in got if not r["__size"])
    again, _ = flow_mix.mix_by_source(frame.repartition(3))
    key = lambda r: (r.doc_id or -1, r.text or "", r["__copies"])
    assert sorted(map(key, got)) == sorted(map(key, again.collect()))


def test_overlapping_sources(docs):
    frame = docs([(k, text(10), "x") for k in range(300)])
    members = F.when(F.col("doc_id") % 3 == 0, F.array(F.lit("a"))).otherwise(F.array(F.lit("b"), F.lit("a")))
    mixed, sources = flow_mix.mix(frame, members, flow_mix.word_count(F.col("text")), ("doc_id", "text"))
    sources = sources.orderBy("source").collect()
    assert [s for s, _, _ in sources] == ["a", "b"]
    taken = sum(r["__size"] * r["__copies"] for r in mixed.collect())
    assert taken == pytest.approx(sum(t for _, _, t in sources), rel=0.05)


def test_sets_of_sources_are_routed_apart(docs):
    names = [["a"], ["a", "b"], ["b"], ["c", "d", "c"], ["d"], ["e"], [None, "f"], ["f"], []]
    rows = [(k, text(10), ",".join(n or "?" for n in names[k % 9])) for k in range(1800)]
    members = F.transform(F.filter(F.split("source", ","), lambda m: m != ""), lambda m: F.when(m != "?", m))
    mixed, sources = flow_mix.mix(docs(rows), members, flow_mix.word_count(F.col("text")), ("doc_id", "text"))
    goals = {r["source"]: r.target for r in sources.collect()}
    taken = {}
    for r in mixed.collect():
        key = tuple(r["__members"])
        taken[key] = taken.get(key, 0) + r["__size"] * r["__copies"]
    assert taken[()] == 0 and ("c", "d") in taken
    order = sorted(goals, key=lambda m: (m is None, m or ""))
    keys = sorted(taken, key=str)
    flows = flow_mix.route([(frozenset(order.index(m) for m in k), 2000) for k in keys], [goals[m] for m in order])
    best = sum(sum(f.values()) for f in flows)
    assert sum(taken.values()) == pytest.approx(best, rel=0.02)
    for group in ("ab", "cd", "e"):
        own = sum(n for k, n in taken.items() if k and k[0] and k[0] in group)
        assert own == pytest.approx(sum(goals[m] for m in group), rel=0.03)


def test_empty_tables(docs):
    mixed, sources = flow_mix.mix_by_source(docs([]))
    assert mixed.count() == 0 and sources.count() == 0
    mixed, _ = flow_mix.mix_by_source(docs([(1, None), (2, "")]))
    assert [r["__copies"] for r in mixed.collect()] == [0, 0]


def test_columns_named_as_inner_ones(spark, docs):
    names = ["pattern", "whole", "size_class", "last_bucket", "bucket", "words", "want", "pattern_id"]
    frame = docs([(k, "a b c " * (k % 5 + 1), f"s{k % 3}") for k in range(30)])
    clashing = frame.selectExpr("*", *[f"'x' AS {n}" for n in names])
    plain = {r.doc_id: r["__copies"] for r in flow_mix.mix_by_source(frame)[0].collect()}
    mixed = flow_mix.mix_by_source(clashing)[0]
    assert {r.doc_id: r["__copies"] for r in mixed.collect()} == plain
    assert set(names) <= set(mixed.columns)
    import corpus_pipeline

    assert corpus_pipeline.mix_sources(spark, clashing, "").columns == clashing.columns
