"""Audit of how the sources of a language differ in their words (operator 11).

Terms are maximal runs of ASCII letters and characters beyond ASCII, with A to Z lower-cased. A language keeps the terms that enough of its documents hold.
They are found by iceberg prefix refinement over the bytes of the terms: level by level, documents are counted once for every prefix of
the level's length that one of their terms has, prefixes below the threshold are dropped, and only terms under a surviving prefix are extended
to the next level. A prefix holds at least the documents of every term below it, so nothing kept is lost. A term that ends within the level's length is complete and its count exact.
Levels end when no prefix is left that could be extended; their lengths double, so their number grows with the logarithm of the longest
kept term, and the many rare terms are never counted whole.

A document lies in one task, so its prefixes are counted once there; the counts of tasks are added. Surviving prefixes steer the next level as
a filter of fixed size (``key_filter``), not as a broadcast table that would grow with the data. What passes it by chance is dropped by the exact counts of its own level.

Then the occurrences of kept terms are counted for each language and source, and shares are compared in integers. To compare all sources of a language, kept
terms are cut into blocks and sources into tiles, and each block of two tiles is one small matrix: neither all terms of a language nor all sources
meet in one task, and a task returns one row per pair of sources for thousands of terms.

Cases: null text, language and source count as empty strings. Every row is a document, also where ids repeat or are null; ids and other columns are not looked at.
A group without terms has the pairs with the other sources of its language, and a language without kept terms has all of these at 0. Ties in rank
go to the smaller item in UTF-8 order. Very long texts and terms are taken whole. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pagemill.llm.common import stored
from pagemill.llm.key_filter import key_filter, passes

MIN_DOCS = 30
TOP_TERMS = 50
SCALE = 1_000_000_000
SMOOTHING = 5
FIRST_LEVEL = 6
#: Terms of a block and sources of a tile.
BLOCK, TILE = 4096, 64
_BYTES = 16 << 20
_END = b"\0"
#: Bytes of terms stay, A to Z become small letters, all others become spaces.
_TO_TERMS = bytes(b if b >= 0x80 or chr(b).isalpha() else 0x20 for b in range(256)).lower()


def _hash(lang: str, key: bytes) -> int:
    return xxhash.xxh64_intdigest(key, xxhash.xxh64_intdigest(lang.encode("utf-8")))


def _hashes(b: pa.RecordBatch) -> np.ndarray:
    keys = zip(b.column(0).to_pylist(), b.column(1).to_pylist())
    return np.fromiter((_hash(lang, key) for lang, key in keys), np.uint64, b.num_rows)


def prefix(term: bytes, length: int | None) -> bytes:
    """The first bytes of a term with its end mark: where the mark is among them the term is complete. Without a length, the term alone."""
    return term if length is None else (term + _END)[:length]


@dataclass
class Block:
    """The terms of many documents of one language: the term at each place and the document it stands in."""

    lang: str
    terms: list[bytes]
    ids: np.ndarray
    document: np.ndarray
    sources: list[str]

    def wanted(self, bits: np.ndarray | None, length: int | None) -> np.ndarray:
        """For each term, whether it is new at this level and its prefix passed the level before."""
        sizes = np.fromiter(map(len, self.terms), np.int64, len(self.terms))
        good = sizes >= (length or 1)
        if bits is not None:
            seed = xxhash.xxh64_intdigest(self.lang.encode("utf-8"))
            at = np.flatnonzero(good)
            asked = (xxhash.xxh64_intdigest(prefix(self.terms[k], length), seed) for k in at.tolist())
            good[at] = passes(bits, np.fromiter(asked, np.uint64, len(at)))
        return good


def block_of(lang: str, texts: list[bytes], sources: list[str]) -> Block:
    """The terms of the texts, numbered."""
    split = pc.ascii_split_whitespace(pa.array(texts, pa.large_binary()).cast(pa.large_string()))
    codes = split.flatten().dictionary_encode()
    document = np.repeat(np.arange(len(texts)), np.diff(split.offsets.to_numpy()))
    return Block(lang, codes.dictionary.cast(pa.large_binary()).to_pylist(), codes.indices.to_numpy().astype(np.int64), document, sources)


def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[Block]:
    """Blocks of bounded size, by language, from batches (lang, source, text)."""
    held: dict[str, tuple[list[bytes], list[str]]] = {}
    size = 0
    for b in batches:
        for lang, source, text in zip(*(c.to_pylist() for c in b.columns)):
            texts, sources = held.setdefault(lang, ([], []))
            texts.append(text.encode("utf-8").translate(_TO_TERMS))
            sources.append(source)
            size += len(texts[-1]) + 64
            if size >= _BYTES:
                yield from (block_of(lang, *of_lang) for lang, of_lang in held.items())
                held, size = {}, 0
    yield from (block_of(lang, *of_lang) for lang, of_lang in held.items())


def distinct(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct values and how often each occurs."""
    codes = np.sort(codes)
    first = np.flatnonzero(np.concatenate([[True], codes[1:] != codes[:-1]])) if len(codes) else np.empty(0, dtype=np.int64)
    return codes[first], np.diff(first, append=len(codes))


def _prefix_counts(batches: Iterator[pa.RecordBatch], length: int, bits: np.ndarray | None, done: int | None) -> Iterator[pa.RecordBatch]:
    """(lang, prefix, documents) of the blocks of a task: every document counts once for each of its prefixes.

    Terms shorter than the level before, ``done``, were complete there.
    """
    for b in blocks(batches):
        prefixes: dict[bytes, int] = {}
        of_term = np.full(len(b.terms), -1, dtype=np.int64)
        for k in np.flatnonzero(b.wanted(bits, done)).tolist():
            of_term[k] = prefixes.setdefault(prefix(b.terms[k], length), len(prefixes))
        at = of_term[b.ids]
        new = at >= 0
        once, _ = distinct(b.document[new] << 32 | at[new])
        n = np.bincount(once & 0xFFFFFFFF, minlength=len(prefixes))
        yield pa.RecordBatch.from_arrays(
            [pa.array([b.lang] * len(prefixes), pa.string()), pa.array(list(prefixes), pa.binary()), pa.array(n.astype(np.int64))],
            names=["lang", "prefix", "n"],
        )


def _term_counts(batches: Iterator[pa.RecordBatch], bits: np.ndarray) -> Iterator[pa.RecordBatch]:
    """(lang, source, term, occurrences) of the blocks of a task."""
    for b in blocks(batches):
        names = {s: k for k, s in enumerate(dict.fromkeys(b.sources))}
        of_document = np.fromiter((names[s] for s in b.sources), np.int64, len(b.sources))
        good = b.wanted(bits, None)[b.ids]
        found, n = distinct(of_document[b.document[good]] << 32 | b.ids[good])
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([b.lang] * len(found), pa.string()),
                pa.array(list(names), pa.string()).take(pa.array(found >> 32)),
                pa.array(b.terms, pa.binary()).take(pa.array(found & 0xFFFFFFFF)),
                pa.array(n.astype(np.int64)),
            ],
            names=["lang", "source", "term", "n"],
        )


def _rows(docs: DataFrame, *names: str) -> DataFrame:
    return docs.select(*[F.coalesce(F.col(c), F.lit("")).alias(c) for c in names])


def kept_terms(docs: DataFrame, min_docs: int = MIN_DOCS, first: int = FIRST_LEVEL) -> DataFrame:
    """(lang, term as bytes, n_docs) of the terms that at least ``min_docs`` documents of a language hold."""
    texts = _rows(docs, "lang", "source", "text")
    send = docs.sparkSession.sparkContext.broadcast
    levels, length, wanted = [], first, send((None, None))
    while True:

        def count(batches: Iterator[pa.RecordBatch], length=length, wanted=wanted) -> Iterator[pa.RecordBatch]:
            return _prefix_counts(batches, length, *wanted.value)

        partial_counts = texts.mapInArrow(count, "lang string, prefix binary, n bigint")
        level = partial_counts.groupBy("lang", "prefix").agg(F.sum("n").alias("n_docs")).where(F.col("n_docs") >= min_docs)
        level = stored(level, f"prefixes-{length}")
        ended = F.endswith("prefix", F.lit(_END))
        levels.append(level.where(ended).select("lang", F.expr("substring(prefix, 1, length(prefix) - 1)").alias("term"), "n_docs"))
        open_prefixes = level.where(~ended)
        if open_prefixes.isEmpty():
            break
        wanted = send((key_filter(open_prefixes.select("lang", "prefix"), _hashes), length))
        length *= 2
    kept = levels[0]
    for level in levels[1:]:
        kept = kept.unionByName(level)
    return kept


def term_counts(docs: DataFrame, kept: DataFrame) -> DataFrame:
    """(lang, source, term, n) of the kept terms that occur in a group."""
    wanted = docs.sparkSession.sparkContext.broadcast(key_filter(kept.select("lang", "term"), _hashes))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _term_counts(batches, wanted.value)

    found = _rows(docs, "lang", "source", "text").mapInArrow(count, "lang string, source string, term binary, n bigint")
    found = found.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"))
    return found.join(kept.select("lang", "term"), ["lang", "term"], "left_semi")


def _share(n: Column, total: Column, kept: Column) -> Column:
    """1 + floor(SCALE * (n + SMOOTHING) / (total + SMOOTHING * kept)), exact for counts beyond 64-bit products; null without kept terms."""
    wide = "decimal(38,0)"
    top = (F.coalesce(n, F.lit(0)) + SMOOTHING).cast("decimal(20,0)") * F.lit(SCALE).cast("decimal(10,0)")
    bottom = (F.coalesce(total, F.lit(0)) + SMOOTHING * kept).cast(wide)
    whole = F.call_function("div", top.cast(wide), bottom)
    return F.when(kept > 0, whole + 1)


def _tiles(sources: DataFrame, tile: int) -> DataFrame:
    """(lang, source, ..., tile): sources of a language fall into as many tiles as it needs."""
    n_tiles = sources.groupBy("lang").agg(F.ceil(F.count(F.lit(1)) / tile).cast("int").alias("tiles"))
    return sources.join(n_tiles, "lang").withColumn("tile", F.pmod(F.xxhash64("source"), F.col("tiles").cast("bigint")).cast("int"))


def _distances(part: pa.Table) -> pa.Table:
    """(lang, a, b, f) of the pairs of two tiles over one block of terms.

    ``part`` has a row without term for each source, with the share of a term it lacks and the block's number of terms,
    and a row for each term that a source has.
    """
    lang, here = part.column("lang")[0].as_py(), part.column("term").is_null().to_numpy()
    heads, cells = part.filter(pa.array(here)), part.filter(pa.array(~here))
    names = heads.column("source").to_pylist()
    side = heads.column("tile").to_numpy()
    two = part.column("tile_a")[0].as_py() != part.column("tile_b")[0].as_py()
    missing = np.array(heads.column("p").fill_null(0).to_pylist(), dtype=np.int64)
    of_source = {s: k for k, s in enumerate(names)}
    codes = cells.column("term").combine_chunks().dictionary_encode()
    p = np.repeat(missing[:, None], len(codes.dictionary), axis=1)
    p[[of_source[s] for s in cells.column("source").to_pylist()], codes.indices.to_numpy()] = cells.column("p").to_numpy()
    unseen = int(heads.column("block_terms")[0].as_py()) - p.shape[1]
    first = np.flatnonzero(side == part.column("tile_a")[0].as_py())
    second = np.flatnonzero(side == part.column("tile_b")[0].as_py()) if two else first
    out_a, out_b, out_f = [], [], []
    for k, i in enumerate(first):
        others = second if two else second[k + 1 :]
        f = np.abs(p[others] - p[i]).sum(axis=1) + np.abs(missing[others] - missing[i]) * unseen
        out_a += [names[i]] * len(others)
        out_b += [names[j] for j in others]
        out_f.append(f)
    f = np.concatenate(out_f) if out_f else np.empty(0, dtype=np.int64)
    columns = [pa.array([lang] * len(f), pa.string()), pa.array(out_a, pa.string()), pa.array(out_b, pa.string()), pa.array(f.astype(np.int64))]
    return pa.Table.from_arrays(columns, names=["lang", "a", "b", "f"])


def pair_distances(groups: DataFrame, shares: DataFrame, languages: DataFrame, block: int = BLOCK, tile: int = TILE) -> DataFrame:
    """(lang, source, item, value) of all ordered pairs of sources of a language.

    ``groups`` is (lang, source, missing), ``shares`` (lang, source, term, p), ``languages`` (lang, term) of the kept terms with the
    number ``kept`` of the language's terms.
    """
    n_blocks = F.greatest(F.lit(1), F.ceil(F.col("kept") / block)).cast("int")
    of_term = F.pmod(F.xxhash64("term"), n_blocks.cast("bigint")).cast("int").alias("block")
    blocks = languages.select("lang", of_term).groupBy("lang", "block").agg(F.count(F.lit(1)).alias("block_terms"))
    tiled = _tiles(groups, tile)
    every = F.explode(F.sequence(F.lit(0), n_blocks - 1)).alias("block")
    heads = tiled.select("*", every).join(blocks, ["lang", "block"], "left").select(
        "lang", "block", "source", "tile", "tiles", F.lit(None).cast("binary").alias("term"), F.col("missing").alias("p"),
        F.coalesce("block_terms", F.lit(0)).alias("block_terms"),
    )
    cells = shares.join(tiled.select("lang", "source", "tile", "tiles"), ["lang", "source"]).select(
        "lang", of_term, "source", "tile", "tiles", "term", "p", F.lit(0).cast("bigint").alias("block_terms")
    )
    both = heads.unionByName(cells).withColumn("__o", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
    both = both.withColumn("tile_a", F.least("tile", "__o")).withColumn("tile_b", F.greatest("tile", "__o"))
    part = both.groupBy("lang", "block", "tile_a", "tile_b").applyInArrow(_distances, "lang string, a string, b string, f bigint")
    total = part.groupBy("lang", "a", "b").agg(F.sum("f").alias("value"))
    ends = F.explode(F.array(F.struct(F.col("a").alias("x"), F.col("b").alias("y")), F.struct(F.col("b").alias("x"), F.col("a").alias("y"))))
    return total.select("lang", "value", ends.alias("e")).select("lang", F.col("e.x").alias("source"), F.col("e.y").alias("item"), "value")


def audit(
    docs: DataFrame, min_docs: int = MIN_DOCS, top: int = TOP_TERMS, first: int = FIRST_LEVEL, block: int = BLOCK, tile: int = TILE
) -> DataFrame:
    """lang, source, part, item, value, rank: for each group its distance from every other source of the language, and the ``top`` terms it has more of than the language."""
    kept = stored(kept_terms(docs, min_docs, first), "kept-terms")
    counts = stored(term_counts(docs, kept), "term-counts")
    n_kept = kept.groupBy("lang").agg(F.count(F.lit(1)).alias("kept"))
    totals = counts.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    groups = _rows(docs, "lang", "source").distinct().join(n_kept, "lang", "left").join(totals, ["lang", "source"], "left")
    groups = groups.withColumn("kept", F.coalesce("kept", F.lit(0))).withColumn("missing", _share(F.lit(0), F.col("total"), F.col("kept")))
    groups = stored(groups, "groups")
    of_lang = counts.groupBy("lang", "term").agg(F.sum("n").alias("lang_n"))
    lang_totals = groups.groupBy("lang", "kept").agg(F.sum("total").alias("lang_total"))
    known = of_lang.join(lang_totals, "lang").select(
        "lang", "term", "kept", _share(F.col("lang_n"), F.col("lang_total"), F.col("kept")).alias("q")
    )
    shares = counts.join(groups, ["lang", "source"]).join(known.select("lang", "term", "q"), ["lang", "term"])
    shares = shares.select("lang", "source", "term", "kept", "q", _share(F.col("n"), F.col("total"), F.col("kept")).alias("p"))
    shares = stored(shares, "shares")
    distances = pair_distances(groups.select("lang", "source", "missing", "kept"), shares, known, block, tile)
    above = shares.where("p > q").select("lang", "source", F.col("term").cast("string").alias("item"), (F.col("p") - F.col("q")).alias("value"))
    order = W.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    ranked = F.row_number().over(order)
    pairs = distances.withColumn("part", F.lit("pair")).withColumn("rank", ranked)
    terms = above.withColumn("part", F.lit("term")).withColumn("rank", ranked).where(F.col("rank") <= top)
    names = ["lang", "source", "part", "item", "value", "rank"]
    return pairs.select(names).unionByName(terms.select(names))
