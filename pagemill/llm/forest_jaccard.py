"""Similarity join on word shingles with fixed MinHash bands in place of an LSH forest (operator 4).

A document is the set of its five-word shingles (all words as one shingle where there are fewer). Two documents link if the Jaccard
similarity of their sets is at least the threshold. Every document gets a MinHash signature of ``TREES`` bands. The length of a band is the
longest, up to ``DEPTH`` values, with which a pair exactly at the threshold meets in some band with the wanted recall; it follows from threshold and recall alone.
A pair meets in a band if all its values agree. The code calls a band a tree and its values a prefix, but keeps no tries and shortens nothing by the data. All
documents below one prefix are joined to its smallest id, the components of these edges are the candidate groups, and inside them every pair is
verified exactly on its shingle sets.

Documents with the same shingle set are one class and counted, so copies are never paired. All texts are shuffled once, to meet the list of documents in a candidate
group; those found there are moved on to their group, and large groups are cut into tiles (``linking``). No pair becomes a row.

Cases: null and empty texts have no shingle and link with nothing. Rows that repeat an id and a shingle set are one document and come out as often
as they went in; rows that repeat an id with another shingle set are another document, compared and judged for itself. Rows without an id are compared as all others, each a document of its own. The
component is the smallest id, null where no member has one; of several documents with that id the one with the smallest digest is kept. Rows without an id are kept only where
their component has no id, and ``one_of_each`` leaves one of them. Other columns are not looked at.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagemill.llm.common import WORD, stored
from pagemill.llm.linking import classes_linked, components, verified

SHINGLE = 5
TREES, DEPTH = 20, 8
SEED = 17
_CACHED_WORDS = 300_000
_COLUMNS = 4096


def prefix_depth(threshold: float, recall: float, trees: int = TREES, depth: int = DEPTH) -> int:
    """The longest prefix with which a pair at the threshold meets in some tree with the wanted recall."""
    while depth > 1 and 1 - (1 - threshold**depth) ** trees < recall:
        depth -= 1
    return depth


class Shingles:
    """Hashed shingle sets; word hashes are remembered up to a fixed number."""

    def __init__(self, size: int = SHINGLE) -> None:
        rng = np.random.default_rng(SEED)
        self.size = size
        self.factors = rng.integers(1, 1 << 62, size, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        self.known: dict[str, int] = {}

    def __call__(self, text: str | None) -> np.ndarray:
        """The sorted distinct shingles of a text."""
        words = WORD.findall(text or "")
        if not words:
            return np.empty(0, dtype=np.uint64)
        known = self.known
        if len(known) > _CACHED_WORDS:
            known.clear()
        for w in set(words).difference(known):
            known[w] = xxhash.xxh64_intdigest(w.encode("utf-8", "surrogatepass"))
        h = np.array([known[w] for w in words], dtype=np.uint64)
        size = min(self.size, len(h))
        total = np.full(len(h) - size + 1, np.uint64(size))
        for k in range(size):
            total = (total ^ (total >> np.uint64(31))) * self.factors[k] + h[k : k + len(total)]
        total = (total ^ (total >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        return np.unique(total ^ (total >> np.uint64(32)))


def signature(shingles: np.ndarray, factors: np.ndarray) -> np.ndarray:
    """The MinHash signature: per factor the least upper half of factor times shingle."""
    least = np.full(len(factors), np.iinfo(np.uint64).max, dtype=np.uint64)
    for lo in range(0, len(shingles), 1024):
        np.minimum(least, ((shingles[lo : lo + 1024, None] * factors) >> np.uint64(32)).min(axis=0), out=least)
    return least


def _digest(shingles: np.ndarray) -> bytes:
    return hashlib.sha1(shingles.tobytes()).digest()


def hashed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, hash, t): hash tells the texts of one id apart."""
    return docs.select(F.col(id_col).cast("bigint").alias("id"), F.xxhash64(text_col).alias("hash"), F.col(text_col).alias("t"))


def texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, noid, hash, t): rows without an id have id 0 and ``noid``, and each of their texts comes once, so that copies don't travel."""
    rows = hashed(docs, id_col, text_col)
    nameless = rows.where("id IS NULL").groupBy("hash", F.length("t").alias("n")).agg(F.first("t").alias("t"))
    named = rows.where("id IS NOT NULL").select("id", F.lit(False).alias("noid"), "hash", "t")
    return named.unionByName(nameless.select(F.lit(0).cast("bigint").alias("id"), F.lit(True).alias("noid"), "hash", "t"))


def sketches(docs: DataFrame, depth: int, id_col: str, text_col: str) -> DataFrame:
    """(id, hash, key, prefixes): hash is that of the text, key the digest of the shingle set, null without shingles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rng = np.random.default_rng(SEED + 1)
        factors = rng.integers(1, 1 << 62, TREES * DEPTH, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        factors = np.ascontiguousarray(factors.reshape(TREES, DEPTH)[:, :depth]).reshape(-1)
        mix = rng.integers(1, 1 << 62, depth, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        shingled = Shingles()
        for b in batches:
            keys, prefixes = [], []
            for t in b.column(2).to_pylist():
                s = shingled(t)
                if not len(s):
                    keys.append(None)
                    prefixes.append(None)
                    continue
                labels = signature(s, factors).reshape(TREES, depth)
                keys.append(_digest(s))
                prefixes.append((labels * mix).sum(axis=1).view(np.int64))
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.array(keys, pa.binary()), pa.array(prefixes, pa.list_(pa.int64()))],
                names=["id", "hash", "key", "prefixes"],
            )

    return hashed(docs, id_col, text_col).mapInArrow(run, "id bigint, hash bigint, key binary, prefixes array<bigint>")


def similar_pairs(threshold: Fraction):
    """For a tile of rows (id, key, t): the linked pairs."""
    shingled = Shingles()

    def pairs(part: pa.Table, side: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
        ids, keys, texts = part.column("id").to_pylist(), part.column("key").to_pylist(), part.column("t").to_pylist()
        rows, sets, seen = [], [], set()
        for k, (i, key, text) in enumerate(zip(ids, keys, texts)):
            if i in seen:
                continue
            s = shingled(text)
            if _digest(s) == key:
                seen.add(i)
                rows.append(k)
                sets.append(s)
        rows = np.array(rows, dtype=np.int64)
        size = np.array([len(s) for s in sets], dtype=np.int64)
        shared = _shared(sets)
        hit = threshold.denominator * shared >= threshold.numerator * (size[:, None] + size[None, :] - shared)
        hit = np.triu(hit, 1)
        if side is not None:
            hit &= side[rows][:, None] != side[rows][None, :]
        i, j = np.nonzero(hit)
        return rows[i], rows[j]

    return pairs


def _shared(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of all intersections, by products of incidence blocks; shingles of one set alone are left out first."""
    n = len(sets)
    if n == 2:
        common = len(np.intersect1d(sets[0], sets[1], assume_unique=True))
        return np.array([[len(sets[0]), common], [common, len(sets[1])]], dtype=np.int64)
    total = np.zeros((n, n))
    if n:
        values = np.concatenate(sets)
        owner = np.repeat(np.arange(n), [len(s) for s in sets])
        _, column, times = np.unique(values, return_inverse=True, return_counts=True)
        keep = times[column] > 1
        owner, column = owner[keep], column[keep]
        order = np.argsort(column, kind="stable")
        owner, column = owner[order], np.unique(column[order], return_inverse=True)[1]
        last = int(column[-1]) + 1 if len(column) else 0
        for lo in range(0, last, _COLUMNS):
            a, b = np.searchsorted(column, (lo, lo + _COLUMNS))
            block = np.zeros((n, min(_COLUMNS, last - lo)), dtype=np.float32)
            block[owner[a:b], column[a:b] - lo] = 1.0
            total += block @ block.T
    return np.rint(total).astype(np.int64)


def similar_documents(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.8, recall: float = 0.999
) -> DataFrame:
    """(id, n_links, component_id, kept, text_hash, digest) of every row. ``recall`` is that of a pair exactly at the threshold.

    ``text_hash`` and ``digest``, of the shingle set, tell ``one_of_each`` the documents of one id apart.
    """
    limit = Fraction(str(threshold))
    rows = stored(sketches(docs, prefix_depth(threshold, recall), id_col, text_col), "sketches")
    owners = rows.where("key IS NOT NULL").groupBy("id", "key")
    documents = F.when(F.col("id").isNull(), F.count(F.lit(1))).otherwise(F.lit(1)).alias("documents")
    owners = owners.agg(F.min("hash").alias("hash"), F.first("prefixes").alias("prefixes"), documents)
    # A class goes by its smallest id; only one without any id goes by none.
    classes = owners.groupBy("key").agg(
        F.min(F.struct(F.col("id").isNull().alias("noid"), "id", "hash")).alias("o"),
        F.sum("documents").alias("weight"),
        F.first("prefixes").alias("prefixes"),
    )
    # Classes are numbered, as several of them may begin with the same id; the number holds once it is stored.
    node = F.monotonically_increasing_id().alias("node")
    classes = stored(classes.select(node, "key", "o.id", "o.hash", "weight", "prefixes"), "classes")
    nodes = classes.select("node", F.posexplode("prefixes").alias("tree", "prefix"))
    heads = nodes.groupBy("tree", "prefix").agg(F.min("node").alias("head"), F.count(F.lit(1)).alias("n"))
    heads = stored(heads.where("n > 1").select("tree", "prefix", "head"), "heads")
    edges = nodes.join(heads, ["tree", "prefix"]).where("node > head").select(F.col("node").alias("a"), F.col("head").alias("b"))
    groups = components(edges).withColumnRenamed("id", "node")
    named = classes.select("node", F.coalesce("id", F.lit(0)).alias("id"), F.col("id").isNull().alias("noid"), "hash", "key", "weight")
    wanted = stored(groups.join(named, "node"), "members")
    # The same plan at every size: texts are shuffled once, whether or not the ids would fit a broadcast.
    members = texts(docs, id_col, text_col).join(wanted.hint("merge"), ["id", "noid", "hash"])
    members = members.select("component", F.col("node").alias("id"), "weight", "key", "t")
    linked = classes_linked(verified(members, similar_pairs(limit))).withColumnRenamed("id", "node")
    return _spread(rows, classes, linked, id_col)


def _spread(rows: DataFrame, classes: DataFrame, linked: DataFrame, id_col: str) -> DataFrame:
    """The result of every row, from (id, hash, key), (node, key, id, weight) and (node, links, component)."""
    owner = F.struct(F.col("id").isNull().alias("noid"), "id", "key")
    found = linked.join(classes.select("node", owner.alias("owner")), "node")
    first = found.groupBy("component").agg(F.min("owner").alias("first"))
    found = found.join(first, "component").select("node", "links", "first")
    result = classes.join(found, "node", "left").select(
        "key",
        (F.col("weight") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"),
        F.coalesce("first", owner).alias("first"),
    )
    judged = rows.where("key IS NOT NULL").join(result, "key").select(
        F.col("id").alias(id_col),
        F.col("n_links").cast("bigint").alias("n_links"),
        F.col("first.id").alias("component_id"),
        (F.col("id").eqNullSafe(F.col("first.id")) & (F.col("key") == F.col("first.key"))).alias("kept"),
        F.col("hash").alias("text_hash"),
        F.col("key").alias("digest"),
    )
    others = rows.where("key IS NULL").select(
        F.col("id").alias(id_col),
        F.lit(0).cast("bigint").alias("n_links"),
        F.col("id").alias("component_id"),
        F.lit(True).alias("kept"),
        F.col("hash").alias("text_hash"),
        F.lit(b"").alias("digest"),
    )
    return judged.unionByName(others)


def one_of_each(docs: DataFrame, found: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents with all their columns, one row for each component; rows with neither id nor shingles all stay."""
    known = {"__id": F.coalesce(F.col(id_col).cast("bigint"), F.lit(0)), "__noid": F.col(id_col).isNull()}
    rows = found.withColumns(known).select(
        *known, F.col("text_hash").alias("__hash"), F.col("digest").alias("__digest"), "kept"
    )
    same = rows.where(F.col("kept") & ~(F.col("__noid") & (F.length("__digest") == 0)))
    same = same.groupBy(*known, "__digest").agg(F.min("__hash").alias("__one"), F.count(F.lit(1)).alias("__n"))
    same = stored(same.where("__n > 1").select(*known, "__digest", "__one"), "repeats")
    other = rows.join(same, [*known, "__digest"]).where("kept AND __hash <> __one").select(*known, "__hash")
    gone = rows.where("NOT kept").select(*known, "__hash").unionByName(other).distinct()
    gone = gone.withColumn("__gone", F.lit(True))
    again = same.select(*known, F.col("__one").alias("__hash"), F.lit(True).alias("__again"))
    marks = stored(gone.join(again, [*known, "__hash"], "full"), "marks")
    here = docs.withColumns({**known, "__hash": F.xxhash64(text_col)})
    marked = here.join(marks.hint("merge"), [*known, "__hash"], "left").where("__gone IS NULL")
    once = marked.where("__again IS NULL").select(docs.columns)
    if not marks.where("__again").isEmpty():
        repeated = marked.where("__again").dropDuplicates([*known, "__hash"])
        once = once.unionByName(repeated.select(docs.columns))
    return once
