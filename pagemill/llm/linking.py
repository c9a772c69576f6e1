"""From candidate links to verified links and components, for joins that find similar rows.

A join first yields candidate edges. Their connected components are the only groups inside which links can lie, so each row's full content is
moved once, to its component, and all pairs inside are verified there. Neither step emits a row per
pair: a task returns one row per member, with its number of links and the smallest member it is connected to.

A group of any size is split into chunks of at most ``CHUNK`` members, and every two chunks meet in a task of their own, so no task holds more than two chunks.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from pagemill.llm.common import stored

CHUNK = 512
#: Edges that a task holds at a time.
EDGES = 4_000_000


def contracted(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, bool]:
    """Stars with the same connections as the edges (a, b): every node and the smallest one it is connected to, and whether the edges were something else."""
    nodes, place = np.unique(np.concatenate([a, b]), return_inverse=True)
    i, j = place[: len(a)], place[len(a) :]
    label = labels_of(len(nodes), i, j)
    moved = bool((label[np.maximum(i, j)] != np.minimum(i, j)).any())
    linked = np.flatnonzero(label != np.arange(len(nodes)))
    return nodes[linked], nodes[label[linked]], moved


def _contract(batches: Iterator[pa.RecordBatch], held: int) -> Iterator[pa.RecordBatch]:
    """Replaces edges (a, b) by stars, ``held`` at a time.

    Where edges are sorted and a node has more than fit, its smallest neighbour, which came first, goes along into the next part.
    """
    held_a, held_b, size = [], [], 0
    first = (None, None)  # the node under way and its first neighbour

    def flush() -> pa.RecordBatch:
        u, v, moved = contracted(np.concatenate(held_a), np.concatenate(held_b))
        marks = np.full(len(u), moved)
        return pa.RecordBatch.from_arrays([pa.array(u), pa.array(v), pa.array(marks)], names=["a", "b", "moved"])

    for batch in batches:
        if not batch.num_rows:
            continue
        a, b = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        start = int(np.searchsorted(a, a[-1])) if (a[1:] >= a[:-1]).all() else len(a) - 1
        if a[start] != first[0]:
            first = (a[start], b[start])
        held_a.append(a)
        held_b.append(b)
        size += len(a)
        if size >= held:
            yield flush()
            held_a, held_b, size = [np.array([first[0]])], [np.array([first[1]])], 1
    if size:
        yield flush()


def components(edges: DataFrame, held: int = EDGES) -> DataFrame:
    """(id, component) of every id in ``edges`` (a, b); component is the smallest id reachable.

    Every round deals the edges out twice, by their larger end and then by both ends, and each time replaces what meets in a task by stars on the
    smallest node. By the first, a node that met many tasks goes on with about one edge and not with one from each. When no task finds anything
    but stars by the second, all edges together are stars: a node with two smaller neighbours, or with a smaller and a larger one, would have met both.
    A task keeps at most ``held`` edges at a time, and gives out at most one edge for each node it saw. A round is two shuffles and one table in the shared folder.

    Edges with a null end and edges from a node to itself count for nothing; repeated edges count once.
    """
    contract, kinds = partial(_contract, held=held), "a bigint, b bigint, moved boolean"

    def met(dealt: DataFrame) -> DataFrame:
        return dealt.select("a", "b").repartition("a").sortWithinPartitions("a", "b").mapInArrow(contract, kinds)

    ends = edges.where("a IS NOT NULL AND b IS NOT NULL AND a <> b").select(F.col("a").cast("bigint"), F.col("b").cast("bigint"))
    e = ends.mapInArrow(contract, kinds)
    while True:
        both = F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))).alias("e")
        seen = Observation()
        moved = F.count_if("moved").alias("moved")
        e = stored(met(met(e).select(both).select("e.*")).observe(seen, moved), "edges")
        if not seen.get["moved"]:
            break
    stars = e.select(F.col("a").alias("id"), F.col("b").alias("component")).distinct()
    heads = e.select(F.col("b").alias("id"), F.col("b").alias("component")).distinct()
    return stars.unionByName(heads)


def tiles(frame: DataFrame, keys: Sequence[str], spread: str, chunk: int = CHUNK) -> DataFrame:
    """Adds ``tile_a``, ``tile_b`` and ``side``: groups above ``chunk`` rows are split, each chunk meeting every other.

    Groups are counted first on their keys alone, and only the large ones are remembered, in a table: Spark sends it to all tasks where it is small.
    """
    large = stored(frame.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n")).where(F.col("__n") > chunk), "large-groups")
    parts = F.coalesce(F.ceil(F.col("__n") / F.lit(chunk)), F.lit(1)).cast("int")
    own = F.pmod(F.xxhash64(spread), F.col("__s").cast("bigint")).cast("int")
    return (
        frame.join(large, list(keys), "left")
        .withColumn("__s", parts)
        .withColumn("side", own)
        .withColumn("__o", F.explode(F.sequence(F.lit(0), F.col("__s") - 1)))
        .withColumn("tile_a", F.least("side", "__o"))
        .withColumn("tile_b", F.greatest("side", "__o"))
        .drop("__n", "__s", "__o")
    )


def sorted_groups(batches: Iterator[pa.RecordBatch], keys: Sequence[str]) -> Iterator[pa.Table]:
    """Tables of whole groups, many small ones together, from rows sorted by ``keys``.

    Held back is only the group that a batch may have cut.
    """
    held: list[pa.RecordBatch] = []
    for b in batches:
        if not b.num_rows:
            continue
        table = pa.Table.from_batches([*held, b]).combine_chunks()
        change = group_starts(table, keys)
        cut = int(change[-1])
        if cut:
            yield table.slice(0, cut)
        held = table.slice(cut).to_batches()
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def group_starts(table: pa.Table, keys: Sequence[str]) -> np.ndarray:
    """Row numbers where a group begins."""
    n = table.num_rows
    new = np.zeros(n, dtype=bool)
    new[0] = True
    for k in keys:
        v = table.column(k).to_numpy()
        new[1:] |= v[1:] != v[:-1]
    return np.flatnonzero(new)


def labels_of(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Smallest row reachable from each of ``n`` rows over the links (i, j)."""
    label = np.arange(n)
    while len(i):
        m = np.minimum(label[i], label[j])
        before = label.copy()
        np.minimum.at(label, i, m)
        np.minimum.at(label, j, m)
        label = label[label]
        if (label == before).all():
            break
    return label


#: Given the rows of a tile and, per row, its side: the linked pairs (i, j), i before j, and no pair twice.
Pairs = Callable[[pa.Table, np.ndarray | None], tuple[np.ndarray, np.ndarray]]


def verified(members: DataFrame, pairs: Pairs) -> DataFrame:
    """(id, links, reach) per row and tile, from ``members`` (component, id, weight, ...).

    ``links`` sums the weights of the rows linked to ``id``, ``reach`` is the smallest id of the tile it is connected to.
    """
    keys = ["component", "tile_a", "tile_b"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in sorted_groups(batches, keys):
            starts = [*group_starts(table, keys).tolist(), table.num_rows]
            for lo, hi in zip(starts, starts[1:]):
                if hi - lo < 2:
                    continue
                part = table.slice(lo, hi - lo)
                split = part.column("tile_a")[0] != part.column("tile_b")[0]
                side = part.column("side").to_numpy() if split else None
                i, j = pairs(part, side)
                if not len(i):
                    continue
                ids, weight = part.column("id").to_numpy(), part.column("weight").to_numpy()
                links = np.zeros(hi - lo, dtype=np.int64)
                np.add.at(links, i, weight[j])
                np.add.at(links, j, weight[i])
                order = np.argsort(ids, kind="stable")
                rank = np.empty_like(order)
                rank[order] = np.arange(len(order))
                label = labels_of(len(ids), rank[i], rank[j])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids), pa.array(links), pa.array(ids[order[label[rank]]])], names=["id", "links", "reach"]
                )

    split = tiles(members, ["component"], "id")
    return (
        split.repartition(*keys).sortWithinPartitions(*keys, "id").mapInArrow(run, "id bigint, links bigint, reach bigint")
    )


def classes_linked(found: DataFrame) -> DataFrame:
    """(id, links, component) from the rows of ``verified``, of every id that has a link."""
    found = stored(found.where("links > 0"), "verified")
    links = found.groupBy("id").agg(F.sum("links").alias("links"))
    reach = components(found.select(F.col("id").alias("a"), F.col("reach").alias("b")))
    return links.join(reach, "id", "left").select("id", "links", F.coalesce("component", "id").alias("component"))
