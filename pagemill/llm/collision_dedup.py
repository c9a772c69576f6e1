"""Near-duplicate vectors by counting collisions of one-dimensional projections (operator 10).

Two vectors of unit length with cosine c lie sqrt(2 - 2c) apart, so their projections on a random direction differ by a normal variable of that
deviation. Vectors are projected on many directions. For each of ``tables`` groups of directions the vectors are
sorted by the cells of these projections and, inside a cell, along one more projection of the table's own; a vector collides with the others of
its cell that lie in a window around its own value. For such pairs the windows, centred on the vector, of ``counted``
further projections are compared, and a pair becomes a candidate if it collides in at least ``calibrated_count`` of them: so many that a pair
at the threshold passes with chance ``COUNT_RECALL``, by the binomial law. Candidates are verified by their cosine in double precision.

The number of directions per table grows with the logarithm of the number of vectors, so that a cell holds about as many
unrelated vectors at every size; the number of tables follows from the chances of cell, window and count and from the wanted recall at the threshold
itself. Closer pairs are found almost surely.

Equal vectors are made one first and counted, so copies cost nothing; large groups of close vectors are cut into tiles
(``linking``). No pair becomes a row.

Vectors link only with those of their own length. Every length has a plan for its own number of vectors, and cells of different lengths never meet.

Cases: vectors that are null, empty, zero, or hold null or non-finite components link with nothing; they come
out alone. Rows that repeat an id and a vector are one vector and come out as often as they went in; rows that repeat an id with another
vector are another vector, compared for itself. Rows without an id are compared too, each a vector of its own; their component is the smallest id they reach, null if there is none,
and they are kept only then. Other columns are not looked at.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagemill.llm.common import stored
from pagemill.llm.linking import classes_linked, components, group_starts, labels_of, sorted_groups, tiles, verified

#: Window of a cell and of a count, in deviations of a pair at the threshold.
CELL_WIDTH, WINDOW = 4.0, 2.0
COUNTED = 32
#: Chance that a pair at the threshold passes the count, which is the same for all tables.
COUNT_RECALL = 0.9999
SCALE = 1024.0


def _phi(x: float) -> float:
    return 0.5 * (1.0 + math.erf(x / math.sqrt(2.0)))


def cell_chance(distance: float, width: float) -> float:
    """Chance that two points at a distance share a cell of a random grid on a normal projection."""
    if distance == 0:
        return 1.0
    r = width / distance
    return 1 - 2 * _phi(-r) - 2 / (math.sqrt(2 * math.pi) * r) * (1 - math.exp(-r * r / 2))


def calibrated_count(counted: int, chance: float, recall: float) -> int:
    """The largest count that a pair with this chance per window reaches with the wanted recall."""
    tail, k = 0.0, counted
    while k >= 0:
        tail += math.comb(counted, k) * chance**k * (1 - chance) ** (counted - k)
        if tail >= recall:
            return k
        k -= 1
    return 0


@dataclass(frozen=True)
class Plan:
    """Everything that follows from the threshold, the recall and the number of vectors."""

    dim: int
    per_table: int
    tables: int
    width: float
    window: float
    count: int
    seed: int = 5

    @staticmethod
    def of(n: int, dim: int, threshold: float, recall: float) -> Plan:
        near = math.sqrt(2 - 2 * threshold)
        width = CELL_WIDTH * near
        far = cell_chance(math.sqrt(2.0), width)
        per_table = max(2, math.ceil(math.log(max(n, 2)) / -math.log(far)))
        hit = cell_chance(near, width) ** per_table
        chance = 2 * _phi(WINDOW) - 1
        missed = 1 - min(recall / COUNT_RECALL, 1 - 1e-9)
        tables = max(1, math.ceil(math.log(missed) / math.log(1 - hit * chance)))
        return Plan(dim, per_table, tables, width, WINDOW * near, calibrated_count(COUNTED, chance, COUNT_RECALL))

    def directions(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Directions of the cells, their offsets, the direction each table is sorted along, the counted directions."""
        rng = np.random.default_rng(self.seed)
        cells = rng.standard_normal((self.dim, self.tables * self.per_table))
        offsets, counted = rng.uniform(0, self.width, self.tables * self.per_table), rng.standard_normal((self.dim, COUNTED))
        return cells, offsets, rng.standard_normal((self.dim, self.tables)), counted


def _vectors(table: pa.Table, name: str) -> np.ndarray:
    """The vectors, all of one length, scaled to unit length."""
    dim = len(table.column(name)[0])
    flat = pa.concat_arrays([c.flatten() for c in table.column(name).chunks])
    x = flat.to_numpy(zero_copy_only=False).astype(float).reshape(-1, dim)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def keyed(frame: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """(id, vec, key): key is a digest of the vector, null where it can't link."""
    vec = F.transform(F.col(vec_col), lambda x: x.cast("double"))
    bad = F.exists("vec", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    norm = F.aggregate("vec", F.lit(0.0), lambda a, x: a + x * x)
    usable = F.col("vec").isNotNull() & ~bad & (F.size("vec") > 0)
    text = F.array_join(F.transform("vec", lambda x: (x + 0.0).cast("string")), " ")
    return frame.select(F.col(id_col).cast("bigint").alias("id"), vec.alias("vec")).select(
        "id", "vec", F.when(usable, F.when(norm > 0, F.sha2(text, 256))).alias("key")
    )


def candidates(classes: DataFrame, plans: dict[int, Plan]) -> DataFrame:
    """Edges (a, b) between classes that collide often enough, by the plan of their length; at most one per row and table."""
    keys = ["dim", "t", "cell", "tile_a", "tile_b"]

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        directions = lru_cache(maxsize=8)(lambda dim: plans[dim].directions())

        def one(b: pa.RecordBatch, plan: Plan) -> pa.RecordBatch:
            cells, offsets, alongs, counted = directions(plan.dim)
            salt = np.random.default_rng(plan.seed + 1).integers(1, 1 << 62, plan.per_table, dtype=np.uint64) | np.uint64(1)
            x = _vectors(pa.Table.from_batches([b]), "vec")
            grid = np.floor((x @ cells + offsets) / plan.width).astype(np.int64).view(np.uint64)
            grid = grid.reshape(len(x), plan.tables, plan.per_table)
            h = np.zeros((len(x), plan.tables), dtype=np.uint64)
            for k in range(plan.per_table):
                h = (h ^ (grid[:, :, k] + np.uint64(0x9E3779B97F4A7C15))) * salt[k]
                h ^= h >> np.uint64(31)
            along = np.rint(x @ alongs * SCALE).astype(np.int32)
            sketch = np.clip(np.rint(x @ counted * SCALE), -32767, 32767).astype(np.int16)
            rows = np.repeat(np.arange(len(x)), plan.tables)
            packed = pa.array([r.tobytes() for r in sketch], pa.binary(2 * COUNTED)).cast(pa.binary())
            return pa.RecordBatch.from_arrays(
                [
                    pa.array(np.full(len(rows), plan.dim, dtype=np.int32)),
                    pa.array(np.tile(np.arange(plan.tables, dtype=np.int32), len(x))),
                    pa.array(h.reshape(-1).view(np.int64)),
                    b.column(0).take(pa.array(rows)),
                    pa.array(along.reshape(-1)),
                    packed.take(pa.array(rows)),
                ],
                names=["dim", "t", "cell", "id", "along", "sketch"],
            )

        for b in batches:
            length = pc.list_value_length(b.column(1)).to_numpy()
            for dim in np.unique(length).tolist():
                if dim in plans:
                    yield one(b.filter(pa.array(length == dim)), plans[dim])

    shared = next(iter(plans.values()))  # window and count follow from the threshold alone
    window = np.int32(math.ceil(shared.window * SCALE) + 1)

    def collide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in sorted_groups(batches, keys):
            n = table.num_rows
            starts = group_starts(table, keys)
            group = np.zeros(n, dtype=np.int64)
            group[starts[1:]] = 1
            group = np.cumsum(group)
            along = table.column("along").to_numpy()
            sketch = np.frombuffer(b"".join(table.column("sketch").to_pylist()), dtype=np.int16).reshape(n, COUNTED)
            side = table.column("side").to_numpy()
            split = table.column("tile_a").to_numpy() != table.column("tile_b").to_numpy()
            found_i, found_j = [], []
            left = np.arange(n)
            offset = 0
            while len(left):  # each round compares every row with the one so far on, while that is in its window
                offset += 1
                left = left[left + offset < n]
                right = left + offset
                near = (group[left] == group[right]) & (along[right] - along[left] <= window)
                left = left[near]
                right = left + offset
                apart = ~split[left] | (side[left] != side[right])
                i, j = left[apart], right[apart]
                hits = (np.abs(sketch[i].astype(np.int32) - sketch[j]) <= window).sum(axis=1) >= shared.count
                found_i.append(i[hits])
                found_j.append(j[hits])
            i, j = np.concatenate(found_i or [left]), np.concatenate(found_j or [left])
            if not len(i):
                continue
            label = labels_of(n, i, j)
            linked = np.flatnonzero(label != np.arange(n))
            ids = table.column("id").to_numpy()
            yield pa.RecordBatch.from_arrays([pa.array(ids[linked]), pa.array(ids[label[linked]])], names=["a", "b"])

    points = classes.select("id", "vec").mapInArrow(project, "dim int, t int, cell bigint, id bigint, along int, sketch binary")
    split = tiles(points, ["dim", "t", "cell"], "id")
    return split.repartition(*keys).sortWithinPartitions(*keys, "along", "id").mapInArrow(collide, "a bigint, b bigint")


def near_duplicates(
    frame: DataFrame,
    id_col: str = "vec_id",
    vec_col: str = "embedding",
    threshold: float = 0.95,
    recall: float = 0.99,
) -> DataFrame:
    """(id, n_links, component_id, kept) of every row. ``recall`` is that of a pair exactly at the threshold."""
    rows = stored(keyed(frame, id_col, vec_col), "vectors")
    owners = rows.where("key IS NOT NULL").groupBy("key", F.col("id").alias("own")).agg(
        F.count(F.lit(1)).alias("n"), F.first("vec").alias("vec")
    )
    classes = owners.groupBy("key").agg(
        F.min("own").alias("own"), F.sum(F.when(F.col("own").isNull(), F.col("n")).otherwise(1)).alias("weight"), F.first("vec").alias("vec")
    )
    # Classes are numbered, as several of them may begin with the same id, or with none; the number holds once it is stored.
    classes = stored(classes.select(F.monotonically_increasing_id().alias("id"), "key", "own", "weight", "vec"), "vector-classes")
    dims = classes.groupBy(F.size("vec").alias("dim")).agg(F.count(F.lit(1)).alias("n")).where("n > 1").collect()
    if dims:
        plans = {r["dim"]: Plan.of(r["n"], r["dim"], threshold, recall) for r in dims}
        edges = candidates(classes, plans)
    else:
        edges = classes.select(F.col("id").alias("a"), F.col("id").alias("b")).limit(0)
    members = components(edges).join(classes, "id").select("component", "id", "weight", "vec")

    def close(part: pa.Table, side: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
        x = _vectors(part, "vec")
        hit = np.triu(x @ x.T >= threshold, 1)
        if side is not None:
            hit &= side[:, None] != side[None, :]
        return np.nonzero(hit)

    linked = classes_linked(verified(members, close))
    found = linked.join(classes.select("id", "own"), "id")
    least = found.groupBy("component").agg(F.min("own").alias("least"))
    found = found.join(least, "component").select("id", "links", "least")
    result = classes.join(found, "id", "left").select(
        "key", (F.col("weight") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("least", "own").alias("component_id")
    )
    component = F.coalesce("component_id", "id")
    return rows.select("id", "key").join(result, "key", "left").select(
        F.col("id").alias(id_col),
        F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"),
        component.alias("component_id"),
        F.when(component.isNull(), True).otherwise(F.coalesce(F.col("id") == component, F.lit(False))).alias("kept"),
    )
