"""Phrase collocations by vertical partitioning of a depth-truncated suffix tree (operator 13).

A piece of text is a sequence of words, and every word starts a suffix that is followed for at most ``depth`` words. The tree of these suffixes of all texts is
never built whole. Its upper part is found by counting prefixes: first words, then pairs of words, each kept only where it occurs often enough.
The suffixes below a kept pair are then dealt into groups by prefix, so that a group's suffixes fit a memory budget; where one
prefix has more suffixes than the budget, it is told apart by one more word, and so on. Each group builds its subtree alone: its suffixes come sorted, and one
walk with a stack of open nodes reads the count of every node as the total of the leaves below it.

How far suffixes are followed is elastic: a suffix is cut where its next pair of words is not frequent, since no phrase across that pair can be, so
the many suffixes that lead nowhere are never moved. Equal suffixes of a task are moved once, with their number. Which words and pairs are
frequent is known to the tasks through filters of fixed size (``key_filter``); what passes by chance is dropped by the final counts.

Counts are of occurrences within pieces, by language. The score of a phrase is that of its weakest cut in two. Phrases inside a longer
candidate that is as frequent are dropped. All products are computed in 38 digits.

No task holds a language or a prefix: subtrees are read from a sorted stream, nodes cut across groups are added up, and the best
phrases of a language are chosen in parts first.

Cases: null texts count as empty, a null language is ``und``. Every row counts, also where ids repeat or are null; ids and other columns are not looked
at. Words may hold any character but space, tab and the marks that end a piece; a text of any length is taken whole. Ties go to the smaller number of words before the cut, and in rank
to the more frequent, then the smaller phrase in UTF-8 order. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pagemill.llm.common import partitions, stored
from pagemill.llm.key_filter import key_filter, passes

DEPTH = 5
MIN_COUNT = 100
TOP = 2000
PERCENT = 100
SCALE = 1000
#: Suffixes that one group may hold, and the greatest number of slots that prefixes are counted in to find the groups.
BUDGET = 2_000_000
MAX_SLOTS = 1 << 20
NO_LANGUAGE = "und"
_POSITIONS = 2_000_000
_BREAK, _SKIP = -1, -2
#: Marks become line feeds, tabs become spaces.
_BREAKS = bytes(0x0A if b in b".,;:!?\x0a\x0b\x0c\x0d" else 0x20 if b == 0x09 else b for b in range(256))
_MIX = np.uint64(0x9E3779B97F4A7C15)


class Words(dict):
    """Numbers of the words of one language, as they come up in a task."""

    def __init__(self, lang: str) -> None:
        super().__init__({b"": _SKIP, b"\n": _BREAK})
        self.lang, self.list, self.hashes = lang, [], []
        self.seed = xxhash.xxh64_intdigest(lang.encode("utf-8"))
        self.parts: list[np.ndarray] = []

    def __missing__(self, word: bytes) -> int:
        n = self[word] = len(self.list)
        self.list.append(word)
        self.hashes.append(xxhash.xxh64_intdigest(word, self.seed))
        return n

    def add(self, text: str) -> int:
        """Takes in a text; words and breaks that end pieces."""
        words = text.encode("utf-8").lower().translate(_BREAKS).replace(b"\n", b" \n ").split(b" ")
        words.append(b"\n")
        ids = np.fromiter(map(self.__getitem__, words), np.int64, len(words))
        ids = ids[ids != _SKIP]
        self.parts.append(ids)
        return len(ids)


@dataclass
class Block:
    """The words of many pieces of one language, in order, with a break after each piece."""

    lang: str
    words: list[bytes]
    hashes: np.ndarray
    ids: np.ndarray

    def follows(self, k: int) -> np.ndarray:
        """True where the word and the ``k`` next ones lie in one piece."""
        n, real = len(self.ids), self.ids >= 0
        inside = real.copy()
        for j in range(1, k + 1):
            rest = max(n - j, 0)
            inside[:rest] &= real[j:]
            inside[rest:] = False
        return inside

    def prefix_hashes(self, size: int) -> np.ndarray:
        """Hash of the ``size`` words from each position, meaningful where they lie in one piece."""
        own = self.hashes[self.ids]
        total = own.copy()
        for j in range(1, size):
            rest = max(len(own) - j, 0)
            total[:rest] = mixed(total[:rest], own[j:])
        return total


def mixed(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Hash of a sequence from that of its beginning and that of its next word."""
    total = (a ^ (a >> np.uint64(29))) * _MIX + b
    return total ^ (total >> np.uint64(32))


def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[Block]:
    """Blocks of bounded size, by language, from batches (lang, text)."""
    held: dict[str, Words] = {}
    size = 0

    def flush() -> Iterator[Block]:
        for lang, words in held.items():
            hashes = np.array([*words.hashes, 0], dtype=np.uint64)
            yield Block(lang, words.list, hashes, np.concatenate(words.parts))
        held.clear()

    for b in batches:
        for lang, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            if lang not in held:
                held[lang] = Words(lang)
            size += held[lang].add(text)
            if size >= _POSITIONS:
                yield from flush()
                size = 0
    yield from flush()


def _hash_of(lang: str, words: list[bytes]) -> int:
    seed = xxhash.xxh64_intdigest(lang.encode("utf-8"))
    total = np.array([xxhash.xxh64_intdigest(words[0], seed)], dtype=np.uint64)
    for w in words[1:]:
        total = mixed(total, np.array([xxhash.xxh64_intdigest(w, seed)], dtype=np.uint64))
    return int(total[0])


def phrase_hashes(b: pa.RecordBatch) -> np.ndarray:
    """Hashes of (lang, phrase), the same as ``Block.prefix_hashes``."""
    rows = zip(b.column(0).to_pylist(), b.column(1).to_pylist())
    return np.fromiter((_hash_of(lang, p.encode("utf-8").split(b" ")) for lang, p in rows), np.uint64, b.num_rows)


_COUNTED = "lang string, phrase string, n bigint"


def _counted(lang: str, phrases: list[bytes], n: np.ndarray) -> pa.RecordBatch:
    texts = pa.array(phrases, pa.binary()).cast(pa.string())
    return pa.RecordBatch.from_arrays([pa.array([lang] * len(n), pa.string()), texts, pa.array(n.astype(np.int64))], names=["lang", "phrase", "n"])


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.coalesce("lang", F.lit(NO_LANGUAGE)).alias("lang"), F.coalesce("text", F.lit("")).alias("text"))


def count_words(texts: DataFrame) -> DataFrame:
    """(lang, phrase, n): occurrences of every word; a null phrase stands for all words of the language."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in blocks(batches):
            n = np.bincount(b.ids[b.ids >= 0], minlength=len(b.words))
            yield _counted(b.lang, [*b.words, None], np.append(n, n.sum()))

    return texts.mapInArrow(run, _COUNTED).groupBy("lang", "phrase").agg(F.sum("n").alias("n"))


def count_pairs(texts: DataFrame, frequent: np.ndarray) -> DataFrame:
    """(lang, phrase, n): occurrences of the pairs of frequent words."""
    known = texts.sparkSession.sparkContext.broadcast(frequent)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in blocks(batches):
            good = np.append(passes(known.value, b.hashes[:-1]), False)[b.ids]
            at = np.flatnonzero(good[:-1] & good[1:])
            pairs, n = np.unique(b.ids[at] << 32 | b.ids[at + 1], return_counts=True)
            first, second = (pairs >> 32).tolist(), (pairs & 0xFFFFFFFF).tolist()
            yield _counted(b.lang, [b.words[i] + b" " + b.words[j] for i, j in zip(first, second)], n)

    return texts.mapInArrow(run, _COUNTED).groupBy("lang", "phrase").agg(F.sum("n").alias("n"))


@dataclass
class Plan:
    """The group of a suffix: by its first two words, or by more of them where a slot is over the budget.

    ``levels`` has, for two, three, ... words, the group of each slot, or -1 where the next level decides.
    """

    slots: int
    levels: list[np.ndarray]
    groups: int

    def slot(self, hashes: np.ndarray) -> np.ndarray:
        return (hashes >> np.uint64(20)).astype(np.int64) & (self.slots - 1)


def _grown(block: Block, frequent_pairs: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions that start a frequent pair, and the number of words each suffix is followed for."""
    chain = block.follows(1) & passes(frequent_pairs, block.prefix_hashes(2))
    length = chain.astype(np.int64)
    open_ = chain.copy()
    for j in range(1, depth - 1):
        rest = max(len(open_) - j, 0)
        open_[:rest] &= chain[j:]
        open_[rest:] = False
        length += open_
    at = np.flatnonzero(chain)
    return at, length[at] + 1


def plan_groups(texts: DataFrame, pairs: DataFrame, frequent_pairs: np.ndarray, depth: int, budget: int) -> Plan:
    """Slots are filled by the counts of prefixes and packed into groups in order; slots over the budget are told apart by one more word.

    What reaches the driver is one number for each slot, at most ``MAX_SLOTS``.
    """
    total = pairs.agg(F.sum("n")).first()[0] or 0
    slots = 16
    while slots < MAX_SLOTS and slots * budget < 4 * total:
        slots *= 2
    plan = Plan(slots, [], 0)
    send = texts.sparkSession.sparkContext.broadcast

    def of_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array(plan.slot(phrase_hashes(b))), b.column(2)], names=["slot", "n"])

    filled = pairs.select("lang", "phrase", "n").mapInArrow(of_pairs, "slot bigint, n bigint")
    while True:
        found = filled.groupBy("slot").agg(F.sum("n").alias("n")).toArrow()
        size = np.zeros(slots, dtype=np.int64)
        size[found.column("slot").to_numpy()] = found.column("n").to_numpy()
        over = (size > budget) & (len(plan.levels) + 2 < depth)
        size[over] = 0
        level = plan.groups + (np.cumsum(size) - size) // budget
        plan.groups = int(level[-1]) + 1
        level[over] = -1
        plan.levels.append(level)
        if not over.any():
            return plan
        known = send((frequent_pairs, plan))

        def of_suffixes(batches: Iterator[pa.RecordBatch], known=known) -> Iterator[pa.RecordBatch]:
            bits, plan = known.value
            for b in blocks(batches):
                at, length = _grown(b, bits, depth)
                _, level = dealt(b, at, length, plan)
                open_ = at[level < 0]
                found, n = np.unique(plan.slot(b.prefix_hashes(len(plan.levels) + 2)[open_]), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(n.astype(np.int64))], names=["slot", "n"])

        filled = texts.mapInArrow(of_suffixes, "slot bigint, n bigint")


def dealt(block: Block, at: np.ndarray, length: np.ndarray, plan: Plan) -> tuple[np.ndarray, np.ndarray]:
    """Group and number of deciding words of each suffix; -1 where no level decides yet.

    A suffix too short for its level goes with its whole length, and its nodes are all shared with other groups.
    """
    group = np.full(len(at), -1, dtype=np.int64)
    level = np.full(len(at), -1, dtype=np.int64)
    for k, of_slot in enumerate(plan.levels):
        size = k + 2
        slot = plan.slot(block.prefix_hashes(size)[at])
        open_ = group < 0
        group[open_] = of_slot[slot[open_]]
        level[open_ & (group >= 0)] = size
        short = (group < 0) & (length == size)
        group[short] = slot[short] % max(plan.groups, 1)
        level[short] = size + 1
    return group, level


def suffixes(texts: DataFrame, frequent_pairs: np.ndarray, plan: Plan, depth: int) -> DataFrame:
    """(group, lang, words, level, n): equal suffixes of a block once, with their number."""
    known = texts.sparkSession.sparkContext.broadcast((frequent_pairs, plan))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits, plan = known.value
        for b in blocks(batches):
            at, length = _grown(b, bits, depth)
            if depth > 2:
                at, length = at[length > 2], length[length > 2]
            if not len(at):
                continue
            group, level = dealt(b, at, length, plan)
            last = len(b.ids) - 1
            rows = np.stack([np.where(length > j, b.ids[np.minimum(at + j, last)], -1) for j in range(depth)], axis=1).astype(np.int32)
            packed = np.ascontiguousarray(rows).view(np.dtype((np.void, 4 * depth))).reshape(-1)
            _, first, n = np.unique(packed, return_index=True, return_counts=True)
            size = length[first]
            ends = np.concatenate([[0], np.cumsum(size)])
            flat = rows[first][np.arange(depth)[None, :] < size[:, None]]
            words = pa.array([b.words[i] for i in flat.tolist()], pa.binary()).cast(pa.string())
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(group[first]),
                    pa.array([b.lang] * len(first), pa.string()),
                    pa.ListArray.from_arrays(pa.array(ends, pa.int32()), words),
                    pa.array(level[first].astype(np.int32)),
                    pa.array(n.astype(np.int64)),
                ],
                names=["group", "lang", "words", "level", "n"],
            )

    return texts.mapInArrow(run, "group bigint, lang string, words array<string>, level int, n bigint")


class Subtree:
    """Walks sorted suffixes; the open nodes from the root to the last suffix are on a stack, with the leaf totals found so far."""

    def __init__(self, min_count: int) -> None:
        self.min_count = min_count
        self.key: tuple | None = None
        self.words: list[str] = []
        self.totals: list[int] = []
        self.shared: list[bool] = []
        self.out: list[tuple[str, str, int]] = []

    def close(self, depth: int) -> None:
        """Closes the nodes below ``depth`` words. A node of three or more words is given out if it is frequent, or may go on in another group."""
        while len(self.words) > depth:
            n, shared = self.totals.pop(), self.shared.pop()
            size = len(self.words)
            if size > 2 and (shared or n >= self.min_count):
                self.out.append((self.key[1], " ".join(self.words), n))
            self.words.pop()
            if self.totals:
                self.totals[-1] += n

    def add(self, key: tuple, words: list[str], level: int, n: int) -> None:
        if key != self.key:
            self.close(0)
            self.key = key
        same = 0
        for a, b in zip(self.words, words):
            if a != b:
                break
            same += 1
        self.close(same)
        for k in range(same, len(words)):
            self.words.append(words[k])
            self.totals.append(0)
            self.shared.append(False)
        for k in range(min(level - 1, len(words))):
            self.shared[k] = True
        self.totals[-1] += n

    def taken(self) -> pa.RecordBatch:
        lang, phrase, n = zip(*self.out) if self.out else ((), (), ())
        self.out = []
        return pa.RecordBatch.from_arrays(
            [pa.array(lang, pa.string()), pa.array(phrase, pa.string()), pa.array(n, pa.int64())], names=["lang", "phrase", "n"]
        )


def subtree_counts(found: DataFrame, groups: int, min_count: int) -> DataFrame:
    """(lang, phrase, n) of the nodes of all subtrees, each built from the sorted suffixes of its group."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree = Subtree(min_count)
        for b in batches:
            for group, lang, words, level, n in zip(*(c.to_pylist() for c in b.columns)):
                tree.add((group, lang), words, level, n)
            yield tree.taken()
        tree.close(0)
        yield tree.taken()

    by_group = found.repartition(max(groups, partitions(found.sparkSession)), "group")
    return by_group.sortWithinPartitions("group", "lang", "words").mapInArrow(run, _COUNTED)


def phrase_counts(docs: DataFrame, min_count: int = MIN_COUNT, depth: int = DEPTH, budget: int = BUDGET) -> tuple[DataFrame, DataFrame]:
    """(lang, phrase, n) of the phrases of one to ``depth`` words that occur often enough, and (lang, n) with all words."""
    texts = _texts(docs)
    words = stored(count_words(texts).where((F.col("n") >= min_count) | F.col("phrase").isNull()), "words")
    single = words.where("phrase IS NOT NULL")
    frequent = key_filter(single.select("lang", "phrase"), phrase_hashes)
    pairs = stored(count_pairs(texts, frequent).where(F.col("n") >= min_count), "pairs")
    phrases = single.unionByName(pairs)
    if depth > 2:
        bits = key_filter(pairs.select("lang", "phrase"), phrase_hashes)
        plan = plan_groups(texts, pairs, bits, depth, budget)
        longer = subtree_counts(suffixes(texts, bits, plan, depth), plan.groups, min_count)
        longer = longer.groupBy("lang", "phrase").agg(F.sum("n").alias("n")).where(F.col("n") >= min_count)
        phrases = phrases.unionByName(longer)
    return stored(phrases, "phrases"), words.where("phrase IS NULL").select("lang", "n")


def _wide(name: str) -> Column:
    return F.col(name).cast("decimal(19,0)")


def score_phrases(phrases: DataFrame, sizes: DataFrame) -> DataFrame:
    """lang, phrase, a, l, r, n, score of every candidate at its weakest cut, with its words in ``ws``."""
    known = phrases.select("lang", F.col("phrase").alias("part"), F.col("n").alias("of_part"))
    ws = F.split("phrase", " ", -1)
    candidates = phrases.select("lang", "phrase", F.col("n").alias("a"), ws.alias("ws")).where(F.size("ws") > 1)
    candidates = candidates.join(sizes, "lang")
    cut = candidates.select("*", F.explode(F.sequence(F.lit(1), F.size("ws") - 1)).alias("k"))
    head = F.array_join(F.slice("ws", F.lit(1), F.col("k")), " ")
    tail = F.array_join(F.slice("ws", F.col("k") + 1, F.size("ws") - F.col("k")), " ")
    cut = cut.withColumn("part", head).join(known, ["lang", "part"]).withColumnRenamed("of_part", "l")
    cut = cut.withColumn("part", tail).join(known, ["lang", "part"]).withColumnRenamed("of_part", "r")
    top = (F.lit(SCALE).cast("decimal(5,0)") * _wide("a")).cast("decimal(24,0)") * _wide("n").cast("decimal(14,0)")
    bottom = _wide("l") * _wide("r")
    cut = cut.withColumn("score", F.call_function("div", top.cast("decimal(38,0)"), bottom.cast("decimal(38,0)")))
    weakest = F.min(F.struct("score", "k", "l", "r")).alias("w")
    return cut.groupBy("lang", "phrase", "a", "n", "ws").agg(weakest).select(
        "lang", "phrase", "a", "w.l", "w.r", "n", F.col("w.score").alias("score"), "ws"
    )


def without_parts(candidates: DataFrame, percent: int = PERCENT) -> DataFrame:
    """Candidates that lie in no longer candidate with ``percent`` of their count.

    The next longer phrases decide: if a phrase lies in a much longer one as frequent, then so is every phrase between.
    """
    size = F.size("ws")
    ends = F.array(
        F.array_join(F.slice("ws", F.lit(1), size - 1), " "),
        F.array_join(F.slice("ws", F.lit(2), size - 1), " "),
    )
    inside = candidates.where(size > 2).select("lang", F.col("a").alias("longer"), F.explode(F.array_distinct(ends)).alias("phrase"))
    most = inside.groupBy("lang", "phrase").agg(F.max("longer").alias("longer"))
    covered = F.coalesce(F.lit(100).cast("decimal(5,0)") * _wide("longer") >= F.lit(percent).cast("decimal(5,0)") * _wide("a"), F.lit(False))
    return candidates.join(most, ["lang", "phrase"], "left").where(~covered).drop("longer")


def best_of_language(candidates: DataFrame, top: int = TOP) -> DataFrame:
    """The first ``top`` of each language with their rank, chosen among the first of many parts of the language."""
    parts = partitions(candidates.sparkSession)
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    part = F.pmod(F.xxhash64("phrase"), F.lit(parts)).alias("__part")
    first = F.row_number().over(W.partitionBy("lang", "__part").orderBy(*order))
    few = candidates.select("*", part).withColumn("__n", first).where(F.col("__n") <= top).drop("__part", "__n")
    return few.withColumn("rank", F.row_number().over(W.partitionBy("lang").orderBy(*order))).where(F.col("rank") <= top)


def mine(
    docs: DataFrame, min_count: int = MIN_COUNT, top: int = TOP, percent: int = PERCENT, depth: int = DEPTH, budget: int = BUDGET
) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score of the best phrases of each language."""
    phrases, sizes = phrase_counts(docs, min_count, depth, budget)
    scored = without_parts(score_phrases(phrases, sizes), percent)
    found = best_of_language(scored, top)
    return found.select("lang", F.col("rank").cast("bigint").alias("rank"), "phrase", "a", "l", "r", "n", "score")
