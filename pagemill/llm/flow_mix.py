"""Mixing sources to target weights by minimum-cost flow (operator 5).

Documents may belong to several sources. They are first summed by membership pattern, the set of sources they belong to, which leaves one row per
pattern. A flow network then routes words from patterns to source quotas: a pattern offers its words once at no
cost, a second time at a cost and a third time at a higher one, so the cost of repetition is convex and nothing is repeated while unused text would
do. The flow that fills the quotas most at least cost says how many words each pattern gives to each source.

Documents are then selected by a seeded hash. Within a pattern they are cut into classes of size (powers of two) and each class into
``BUCKETS`` ranges of the hash; whole ranges are taken from the largest class to the smallest, and what a class takes
too much or too little is made up by the next one. So the taken words come close to the flow, sizes are taken in proportion,
and the same rows and seed always give the same documents.

Scale: documents are aggregated map-side to at most (patterns x classes x buckets) rows; a task plans one pattern over at most
64 x ``BUCKETS`` of them. Sources and patterns are tables of any length: sources are numbered after a distributed sort, targets take a few sums over
the sources, and the flow is solved apart for every set of sources that patterns connect, each in one task that holds one row per pattern and source of
the set. Sources that share no document are sets of their own. The plan that is joined back has a row per pattern and class; Spark sends
it to all tasks where the stored table is small. A source with a third of all rows is no special case.

Targets: sources share ``total`` words by weight; a target stops at ``max_repeats`` times the words of its source and the excess
goes to the others by weight, until none is above. If all are at their limit the rest is left out.

Cases: a null or empty text has size 0 and is never taken. A null source is a source of its own, last in order. Repeated
rows are selected each for itself, where id and text agree all alike. An empty table gives an empty mix. Documents without any source are not taken. A
source named twice by one document counts once. Other columns are not looked at.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pagemill.llm.common import A_WORD, SPACES, stored
from pagemill.llm.linking import components, group_starts, sorted_groups

BUCKETS = 512
#: Rows of a plan that a task gives out at once.
OUT_ROWS = 10_000
#: Cost of the first, second and third copy of a word.
COPY_COSTS = (0.0, 1.0, 3.0)


def word_count(text: Column) -> Column:
    """Number of words: places where a word begins. No array of words is built."""
    blank = F.translate(F.coalesce(text, F.lit("")), SPACES, " " * len(SPACES))
    return F.coalesce(F.regexp_count(blank, F.lit(A_WORD)), F.lit(0)).cast("bigint")


def numbered(sources: DataFrame) -> DataFrame:
    """Adds ``rank``, from 0 in code point order with null last: sorted in ranges, then counted per range."""
    ranges = stored(sources.orderBy(F.col("source").asc_nulls_last()).withColumn("range", F.spark_partition_id()), "mix-ranges")
    # One row per range, at most as many as there are shuffle partitions.
    before = W.orderBy("range").rowsBetween(W.unboundedPreceding, -1)
    starts = ranges.groupBy("range").agg(F.count(F.lit(1)).alias("n"))
    starts = starts.select("range", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    own = F.row_number().over(W.partitionBy("range").orderBy(F.col("source").asc_nulls_last()))
    return ranges.withColumn("rank", own - 1).join(starts, "range").withColumn("rank", F.col("rank") + F.col("start")).drop("range", "start")


def targets(sources: DataFrame, total: float, max_repeats: float = 3.0) -> DataFrame:
    """Adds ``target`` to (words, weight, ...): ``total`` by weight, none above ``max_repeats`` times its words, the excess shared again by weight.

    The share of one weight only grows from round to round, as those that stop take less than their share; so a round is one sum over the sources
    and the last one is that in which no more stop. The limits are summed as whole numbers times ``max_repeats``, so the order of rows does not matter.
    """
    share, stopped = 0.0, -1
    while True:
        full = F.col("weight") * F.lit(share) > F.col("words") * F.lit(max_repeats)
        row = sources.agg(
            F.count_if(full).alias("n"), F.sum(F.when(full, F.col("words"))).alias("words"), F.sum(F.when(~full, F.col("weight"))).alias("weight")
        ).first()
        if row.n == stopped or row.weight is None:
            break
        stopped, share = row.n, (total - max_repeats * (row.words or 0)) / row.weight
    return sources.withColumn("target", F.least(F.col("weight") * F.lit(share), F.col("words") * F.lit(max_repeats)))


def route(
    patterns: Sequence[tuple[frozenset, float]], quotas: Sequence[float], costs: Sequence[float] = COPY_COSTS
) -> list[dict[int, float]]:
    """Words that each pattern gives to each source: the largest flow of least cost.

    ``patterns`` are (sources, words). Successive shortest paths: start - pattern (one edge per copy) - source - end. Edges are lists
    [to, capacity, cost, index of the reverse edge].
    """
    n_p, n_s = len(patterns), len(quotas)
    start, end = n_p + n_s, n_p + n_s + 1
    graph: list[list[list]] = [[] for _ in range(end + 1)]

    def edge(a: int, b: int, capacity: float, cost: float) -> None:
        graph[a].append([b, capacity, cost, len(graph[b])])
        graph[b].append([a, 0.0, -cost, len(graph[a]) - 1])

    for i, (sources, words) in enumerate(patterns):
        for cost in costs:
            edge(start, i, float(words), cost)
        for s in sorted(sources):
            edge(i, n_p + s, math.inf, 0.0)
    for s, quota in enumerate(quotas):
        edge(n_p + s, end, float(quota), 0.0)
    tiny = 1e-9 * (1.0 + sum(quotas))
    while True:
        dist = [math.inf] * (end + 1)
        came: list[tuple[int, int] | None] = [None] * (end + 1)
        dist[start] = 0.0
        queue, queued, at = [start], [False] * (end + 1), 0
        while at < len(queue):
            u = queue[at]
            at += 1
            queued[u] = False
            for k, (v, capacity, cost, _) in enumerate(graph[u]):
                if capacity > tiny and dist[u] + cost < dist[v] - 1e-12:
                    dist[v], came[v] = dist[u] + cost, (u, k)
                    if not queued[v]:
                        queued[v] = True
                        queue.append(v)
        if came[end] is None:
            break
        room, v = math.inf, end
        while v != start:
            u, k = came[v]
            room, v = min(room, graph[u][k][1]), u
        v = end
        while v != start:
            u, k = came[v]
            step = graph[u][k]
            step[1] -= room
            graph[v][step[3]][1] += room
            v = u
    out: list[dict[int, float]] = []
    for i in range(n_p):
        given = {e[0] - n_p: graph[e[0]][e[3]][1] for e in graph[i] if n_p <= e[0] < start}
        out.append({s: x for s, x in given.items() if x > tiny})
    return out


def _groups(batches: Iterator[pa.RecordBatch], key: str, columns: Sequence[str]) -> Iterator[list[np.ndarray]]:
    """The columns of every group, from rows sorted by ``key``. Many small groups come in one batch."""
    for table in sorted_groups(batches, [key]):
        starts = [*group_starts(table, [key]).tolist(), table.num_rows]
        values = [table.column(c).to_numpy() for c in columns]
        for lo, hi in zip(starts, starts[1:]):
            yield [v[lo:hi] for v in values]


def _plan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per pattern: copies taken of everything, and per class the number of ranges that get one copy more.

    Rows are sorted by pattern, class from the largest down, and bucket.
    """
    kinds = [("pattern_id", pa.int64()), ("size_class", pa.int32()), ("whole", pa.int32()), ("last_bucket", pa.int32())]
    out: list[list[int]] = [[] for _ in kinds]

    def batch() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(v, t) for v, (_, t) in zip(out, kinds)], names=[k for k, _ in kinds])

    for patterns, wants, classes, buckets, words in _groups(batches, "pattern_id", ["pattern_id", "want", "size_class", "bucket", "words"]):
        want, size = float(wants[0]), float(words.sum())
        whole = int(want // size) if size else 0
        share, owed = ((want - whole * size) / size if size else 0.0), 0.0
        cuts = [0, *(np.flatnonzero(np.diff(classes)) + 1).tolist(), len(classes)]
        for lo, hi in zip(cuts, cuts[1:]):
            sums = np.cumsum(words[lo:hi])
            goal = share * float(sums[-1]) + owed
            take = int((sums <= goal).sum())
            below = float(sums[take - 1]) if take else 0.0
            if take < len(sums) and float(sums[take]) - goal < goal - below:
                below = float(sums[take])
                take += 1
            owed = goal - below
            last = int(buckets[lo + take - 1]) if take else -1
            for held, v in zip(out, (int(patterns[0]), int(classes[lo]), whole, last)):
                held.append(v)
        if len(out[0]) >= OUT_ROWS:
            yield batch()
            out = [[] for _ in kinds]
    if out[0]:
        yield batch()


def _routed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Words that each pattern gives, one connected set of sources after the other. One row per pattern and source."""
    names, wants = [], []

    def batch() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(names, pa.int64()), pa.array(wants, pa.float64())], names=["pattern_id", "want"])

    for ids, ranks, sizes, goals in _groups(batches, "component", ["pattern_id", "rank", "n", "target"]):
        quotas = dict(zip(ranks.tolist(), goals.tolist()))
        place = {r: i for i, r in enumerate(sorted(quotas))}
        words, sources = {}, {}
        for p, r, n in zip(ids.tolist(), ranks.tolist(), sizes.tolist()):
            words[p] = n
            sources.setdefault(p, []).append(place[r])
        # The number of a pattern may differ from run to run, its sources don't.
        order = sorted(words, key=lambda p: sorted(sources[p]))
        flows = route([(frozenset(sources[p]), words[p]) for p in order], [quotas[r] for r in sorted(quotas)])
        names += order
        wants += [float(sum(f.values())) for f in flows]
        if len(names) >= OUT_ROWS:
            yield batch()
            names, wants = [], []
    if names:
        yield batch()


def _connected(shares: DataFrame) -> DataFrame:
    """Adds ``component`` to (pattern_id, rank): the smallest rank that patterns connect to this one."""
    joint = shares.groupBy("pattern_id").agg(F.min("rank").alias("a"), F.count(F.lit(1)).alias("n")).where("n > 1")
    edges = stored(shares.join(joint, "pattern_id").select("a", F.col("rank").alias("b")).distinct(), "mix-overlaps")
    if edges.isEmpty():
        return shares.withColumn("component", F.col("rank"))
    found = components(edges).withColumnRenamed("id", "rank")
    return shares.join(found, "rank", "left").withColumn("component", F.coalesce("component", "rank"))


def mix(
    docs: DataFrame,
    members: Column,
    size: Column,
    key: Sequence[str],
    weight_cycle: Sequence[float] = (1, 2, 3),
    max_repeats: float = 3.0,
    seed: int = 0,
) -> tuple[DataFrame, DataFrame]:
    """Mixes documents of any number of sources each.

    ``members`` is the array of source names of a document, ``key`` the columns whose hash, with the seed, selects documents. Sources in code point
    order, null last, weigh by the cycle and share all words. Returns the documents with ``__members``, ``__size`` and ``__copies`` added, and
    (source, words, target) of the sources.
    """
    hashed = F.xxhash64(*(F.col(f"`{c}`") for c in key), F.lit(seed))
    marked = docs.withColumns({"__members": F.array_sort(F.array_distinct(members)), "__size": size})
    marked = marked.withColumns(
        {
            "__class": F.when(F.col("__size") > 0, F.floor(F.log2("__size"))).cast("int"),
            "__bucket": F.pmod(hashed, F.lit(BUCKETS)).cast("int"),
        }
    )
    cells = stored(
        marked.groupBy("__members", F.col("__class").alias("size_class"), F.col("__bucket").alias("bucket")).agg(
            F.sum("__size").alias("words")
        ),
        "mix-cells",
    )
    summed = cells.groupBy("__members").agg(F.coalesce(F.sum("words"), F.lit(0)).alias("n"))
    patterns = stored(summed.withColumn("pattern_id", F.monotonically_increasing_id()), "mix-patterns")
    shares = patterns.select("pattern_id", "n", F.explode("__members").alias("source"))
    sources = numbered(shares.groupBy("source").agg(F.sum("n").alias("words")))
    cycle = F.array(*(F.lit(float(w)) for w in weight_cycle))
    weight = F.element_at(cycle, (F.pmod("rank", F.lit(len(weight_cycle))) + 1).cast("int"))
    sources = stored(sources.withColumn("weight", weight), "mix-sources")
    total = float(patterns.agg(F.sum("n")).first()[0] or 0)
    sources = targets(sources, total, max_repeats)

    known = sources.select(F.col("source").alias("name"), "rank", "target")
    routes = stored(shares.join(known, F.col("source").eqNullSafe(F.col("name"))).select("pattern_id", "n", "rank", "target"), "mix-shares")
    want = routes.join(_connected(routes.select("pattern_id", "rank")), ["pattern_id", "rank"])
    want = want.repartition("component").sortWithinPartitions("component")
    want = stored(want.mapInArrow(_routed, "pattern_id bigint, want double"), "mix-flow")

    named = patterns.join(want, "pattern_id").select("pattern_id", "want", F.col("__members").alias("__pattern"))
    plan = (
        cells.where("words > 0")
        .join(named, F.col("__members").eqNullSafe(F.col("__pattern")))
        .select("pattern_id", "want", "size_class", "bucket", "words")
        .repartition("pattern_id")
        .sortWithinPartitions("pattern_id", F.desc("size_class"), "bucket")
        .mapInArrow(_plan, "pattern_id bigint, size_class int, whole int, last_bucket int")
        .join(named, "pattern_id")
        .select("__pattern", *[F.col(c).alias(f"__{c}") for c in ("size_class", "whole", "last_bucket")])
    )
    # Stored, so that Spark knows its size and sends it to all tasks only where it is small.
    plan = stored(plan, "mix-plan")
    copies = F.coalesce(F.col("__whole") + (F.col("__bucket") <= F.col("__last_bucket")).cast("int"), F.lit(0))
    same = F.col("__members").eqNullSafe(F.col("__pattern")) & (F.col("__class") == F.col("__size_class"))
    joined = marked.join(plan, same, "left")
    kept = [F.col(f"`{c}`") for c in docs.columns]
    return joined.select(*kept, "__members", "__size", copies.alias("__copies")), sources.select("source", "words", "target")


def mix_by_source(
    docs: DataFrame, text_col: str = "text", source_col: str = "source", id_col: str = "doc_id", seed: int = 0
) -> tuple[DataFrame, DataFrame]:
    """Mixes documents of one source each."""
    members = F.array(F.col(f"`{source_col}`").cast("string"))
    return mix(docs, members, word_count(F.col(f"`{text_col}`")), (id_col, text_col), seed=seed)
