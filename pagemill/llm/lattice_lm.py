"""Language-model scores of documents: a word-unigram base and the likelihood of a subword lattice (operator 9).

The lattice model gives each piece of an existing vocabulary a probability. The probability of a word is the
sum over all its segmentations into pieces, by a forward recursion in log space, and that of a text the product over its words and one
end. The vocabulary's own scores (merge ranks) give the first probabilities, by Zipf's law; ``ROUNDS`` rounds of expectation
maximisation over the counts of all training words replace them. ``lattice_score`` is this product. For ``score`` the lattice of a word seen in
training has one more arc, over the whole word, with its relative frequency; Witten and Bell's rule shares the mass between word arcs and pieces, so
unseen words are weighed by their pieces alone. The base model smooths word counts by one.

How it runs. A table of all words does not fit anywhere, so words meet their counts by shuffles, but not one row per word
and document: a task packs some thousand documents, whose distinct words are stored once, in buckets by hash, and whose contents become arrays of
positions in these words. Only the words of the packs travel: grouped by bucket they are counted over all documents; piece expectations are summed from these
counts; each word's probability is computed once, in its bucket, and counts and probabilities go back to the packs, in the order in which the pack
holds its words. What is moved depends on the distinct words of the packs, not on the number of buckets. Buckets are hashed, and a word is in a pack once, so
frequent words are no hot keys. The driver gets sums per piece, whose number is that of the vocabulary.

Words are runs of characters other than white space, A to Z lower-cased; every text ends with one end token.

Cases: a null or empty text is the end alone. A null id counts as training. Repeated rows count each time and get the same
score each. Without training texts every token is unknown and N is 0; the base is then log10(1 / 1) per token and the lattice keeps the
vocabulary's probabilities. Words of any length are scored whole. Other columns are not looked at.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard as zstd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagemill.llm.common import partitions, stored
from pagemill.llm.lattice import MARK, Lattice

PACK_DOCS, PACK_BYTES = 8000, 32_000_000
ROUNDS = 2
SMOOTHING = 0.1

_PACKED = {
    "pack": pa.int64(),
    "bucket": pa.int32(),
    "words": pa.binary(),
    "train": pa.binary(),
    "ends": pa.int64(),
    "ids": pa.binary(),
    "held": pa.binary(),
    "tokens": pa.binary(),
    "cuts": pa.binary(),
    "lengths": pa.binary(),
    "index": pa.binary(),
    "counts": pa.binary(),
}
_PACKED_DDL = ", ".join(f"{n} {'bigint' if t == pa.int64() else 'int' if t == pa.int32() else 'binary'}" for n, t in _PACKED.items())


def _shut(data: np.ndarray | bytes) -> bytes:
    return zstd.compress(data if isinstance(data, bytes) else data.tobytes())


def _open(data: bytes, kind) -> np.ndarray:
    return np.frombuffer(zstd.decompress(data), dtype=kind)


def vocabulary(path: str) -> tuple[list[str], np.ndarray]:
    """The text pieces of a sentencepiece model and their scores."""
    from sentencepiece import sentencepiece_model_pb2

    model = sentencepiece_model_pb2.ModelProto()
    with open(path, "rb") as f:
        model.ParseFromString(f.read())
    kept = [p for p in model.pieces if p.type == 1]
    return [p.piece for p in kept], np.array([p.score for p in kept])


def first_scores(scores: np.ndarray) -> tuple[np.ndarray, float, float]:
    """Log probabilities by rank, of pieces, of a byte and of the end."""
    rank = np.empty(len(scores))
    rank[np.argsort(-scores, kind="stable")] = np.arange(len(scores))
    weight = 1.0 / (rank + 50.0)
    total = weight.sum() * 1.02
    return np.log(weight / total), math.log(0.01 / 1.02 / 256), math.log(0.01 / 1.02)


def learned_scores(uses: np.ndarray, in_bytes: float, ends: float) -> tuple[np.ndarray, float, float]:
    """The same from expected uses, smoothed."""
    total = uses.sum() + SMOOTHING * len(uses) + in_bytes + 256 * SMOOTHING + ends + SMOOTHING
    return (
        np.log((uses + SMOOTHING) / total),
        math.log((in_bytes / 256 + SMOOTHING) / total),
        math.log((ends + SMOOTHING) / total),
    )


def _text_words(words: list[bytes]) -> list[str]:
    return [MARK + w.decode("utf-8", "surrogatepass").replace(MARK, " ") for w in words]


def _pack(buckets: int):
    """Rows (id, held, text) to one row per pack and bucket with its words, and one of bucket -1 with the documents."""

    def one(number: int, ids: list, held: list[bool], texts: list[bytes]) -> pa.RecordBatch:
        known: dict[bytes, int] = {}
        words, counts, tokens, lengths = [np.empty(0, np.int32)], [np.empty(0, np.int64)], [], []
        for raw in texts:
            own = raw.lower().split()
            for x in own:
                if x not in known:
                    known[x] = len(known)
            w, c = np.unique(np.array([known[x] for x in own], dtype=np.int32), return_counts=True)
            words.append(w)
            counts.append(c)
            tokens.append(len(own) + 1)
            lengths.append(len(w))
        word, count = np.concatenate(words), np.concatenate(counts)
        doc = np.repeat(np.arange(len(texts)), lengths)
        names = list(known)
        bucket = np.array([zlib.crc32(x) % buckets for x in names], dtype=np.int32)
        order = np.argsort(bucket, kind="stable")
        place = np.empty_like(order)
        place[order] = np.arange(len(order))
        cuts = np.searchsorted(bucket[order], np.arange(buckets + 1))
        word = place[word].astype(np.int64)
        learned = np.bincount(word, count * ~np.array(held, dtype=bool)[doc], minlength=len(names)).astype(np.int64)
        by_doc = np.lexsort((word, doc))
        index = np.diff(word[by_doc], prepend=0)
        rows = [
            {
                "pack": number,
                "bucket": -1,
                "ends": held.count(False),
                "ids": _ids(ids),
                "held": _shut(np.array(held, dtype=np.int8)),
                "tokens": _shut(np.array(tokens, dtype=np.int64)),
                "cuts": _shut(cuts.astype(np.int64)),
                "lengths": _shut(np.array(lengths, dtype=np.int32)),
                "index": _shut(index.astype(np.int32)),
                "counts": _shut(count[by_doc].astype(np.int32)),
            }
        ]
        for b in np.flatnonzero(np.diff(cuts)):
            at = slice(cuts[b], cuts[b + 1])
            joined = b" ".join([names[x] for x in order[at]])
            rows.append({"pack": number, "bucket": int(b), "words": _shut(joined), "train": _shut(learned[at])})
        return pa.RecordBatch.from_pylist(rows, schema=pa.schema(list(_PACKED.items())))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        ids, held, texts, size = [], [], [], 0
        for b in batches:
            for i, h, t in zip(*(c.to_pylist() for c in b.columns)):
                raw = (t or "").encode("utf-8", "surrogatepass")
                ids.append(i)
                held.append(bool(h))
                texts.append(raw)
                size += len(raw)
                if len(ids) >= PACK_DOCS or size >= PACK_BYTES:
                    yield one(number, ids, held, texts)
                    number += 1
                    ids, held, texts, size = [], [], [], 0
        if ids:
            yield one(number, ids, held, texts)

    return run


def _ids(ids: list) -> bytes:
    """Ids as a little Arrow stream, which keeps nulls."""
    batch = pa.RecordBatch.from_arrays([pa.array(ids, pa.int64())], names=["id"])
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema) as out:
        out.write_batch(batch)
    return sink.getvalue().to_pybytes()


_COUNTED_DDL = "bucket int, words binary, train binary, packs binary, sizes binary, index binary, n bigint, types bigint"


def _count(table: pa.Table) -> pa.Table:
    """One bucket: its distinct words, their training counts, and for each pack where its words are among them."""
    known: dict[bytes, int] = {}
    places, learned = [], []
    for words, train in zip(table.column("words").to_pylist(), table.column("train").to_pylist()):
        own = zstd.decompress(words).split(b" ")
        for w in own:
            if w not in known:
                known[w] = len(known)
        places.append(np.array([known[w] for w in own], dtype=np.int64))
        learned.append(_open(train, np.int64))
    index = np.concatenate(places)
    counts = np.bincount(index, np.concatenate(learned), minlength=len(known)).astype(np.int64)
    return pa.table(
        {
            "bucket": table.column("bucket").slice(0, 1).cast(pa.int32()),
            "words": pa.array([_shut(b" ".join(known))], pa.binary()),
            "train": pa.array([_shut(counts)], pa.binary()),
            "packs": pa.array([_shut(table.column("pack").to_numpy())], pa.binary()),
            "sizes": pa.array([_shut(np.array([len(p) for p in places], dtype=np.int64))], pa.binary()),
            "index": pa.array([_shut(index.astype(np.int32))], pa.binary()),
            "n": pa.array([int(counts.sum())], pa.int64()),
            "types": pa.array([int((counts > 0).sum())], pa.int64()),
        }
    )


def _expect(lattice: Lattice):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        uses, in_bytes = np.zeros(len(lattice.pieces)), 0.0
        for b in batches:
            for words, train in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                counts = _open(train, np.int64)
                names = zstd.decompress(words).split(b" ")
                seen = np.flatnonzero(counts)
                own, spelled = lattice.expected(_text_words([names[k] for k in seen]), counts[seen].astype(float))
                uses += own
                in_bytes += spelled
        hit = np.flatnonzero(uses)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.append(hit, -1).astype(np.int32)), pa.array(np.append(uses[hit], in_bytes))], names=["piece", "uses"]
        )

    return run


def _with_words(log_lattice: np.ndarray, counts: np.ndarray, n: int, types: int) -> np.ndarray:
    """Log10 probability with one more arc over each word seen in training, weighed as Witten and Bell do."""
    types = max(types, 1)
    return np.log10((counts + types * np.exp(log_lattice)) / (n + types))


def _score(lattice: Lattice):
    """Each bucket: counts and lattice probabilities of its words, for every pack in the pack's order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row in b.to_pylist():
                counts = _open(row["train"], np.int64)
                pure = lattice.log_marginals(_text_words(zstd.decompress(row["words"]).split(b" "))).astype(np.float32)
                index, packs = _open(row["index"], np.int32), _open(row["packs"], np.int64)
                parts = np.split(index, np.cumsum(_open(row["sizes"], np.int64))[:-1])
                values = [(_shut(counts[p]), _shut(pure[p])) for p in parts]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(packs),
                        pa.array([row["bucket"]] * len(packs), pa.int32()),
                        pa.array([v[0] for v in values], pa.binary()),
                        pa.array([v[1] for v in values], pa.binary()),
                    ],
                    names=["pack", "bucket", "seen", "pure"],
                )

    return run


def _gather(n: int, types: int, end_count: int, end_score: float):
    """One pack: the scores of its documents from the values of its words."""
    unit = math.log10(n + types + 1.0)

    def run(packs: pa.Table, values: pa.Table) -> pa.Table:
        own = packs.to_pylist()[0]
        ids = pa.ipc.open_stream(own["ids"]).read_all().column("id").combine_chunks()
        tokens, held = _open(own["tokens"], np.int64), _open(own["held"], np.int8) > 0
        cuts, lengths = _open(own["cuts"], np.int64), _open(own["lengths"], np.int32)
        seen, pure = np.zeros(cuts[-1], dtype=np.int64), np.zeros(cuts[-1])
        for row in values.to_pylist():
            at = slice(cuts[row["bucket"]], cuts[row["bucket"] + 1])
            seen[at], pure[at] = _open(row["seen"], np.int64), _open(row["pure"], np.float32)
        word, times = np.cumsum(_open(own["index"], np.int32), dtype=np.int64), _open(own["counts"], np.int32)
        doc = np.repeat(np.arange(len(tokens)), lengths)

        def total(of_word: np.ndarray, of_end: float) -> np.ndarray:
            return np.bincount(doc, times * of_word[word], minlength=len(tokens)) + of_end

        ends = np.array([end_count]), np.array([end_score])
        base = total(np.log10(seen + 1.0), math.log10(end_count + 1.0)) - tokens * unit
        return pa.table(
            {
                "id": ids,
                "held_out": pa.array(held),
                "n_tokens": pa.array(tokens),
                "n_known": pa.array(np.rint(total(seen > 0, float(end_count > 0))).astype(np.int64)),
                "train_tokens": pa.array(np.full(len(tokens), n, dtype=np.int64)),
                "base_score": pa.array(base),
                "score": pa.array(total(_with_words(pure, seen, n, types), _with_words(ends[1], ends[0], n, types)[0])),
                "lattice_score": pa.array(total(pure / math.log(10), end_score / math.log(10))),
            }
        )

    return run


def score_documents(
    docs: DataFrame, path: str, held_out: Column, id_col: str = "doc_id", text_col: str = "text", buckets: int | None = None
) -> DataFrame:
    """id, held_out, n_tokens, n_known, train_tokens, base_score, score and lattice_score (all log10) of every document."""
    spark = docs.sparkSession
    buckets = buckets or partitions(spark)
    rows = docs.select(
        F.col(id_col).cast("bigint").alias("id"), F.coalesce(held_out, F.lit(False)).alias("held"), F.col(text_col).alias("t")
    )
    packed = stored(rows.mapInArrow(_pack(buckets), _PACKED_DDL), "packed")
    own = packed.where("bucket < 0").drop("bucket", "words", "train", "ends")
    parts = packed.where("bucket >= 0").select("pack", "bucket", "words", "train")
    words = stored(parts.groupBy("bucket").applyInArrow(_count, _COUNTED_DDL), "words")
    ends = packed.agg(F.coalesce(F.sum("ends"), F.lit(0))).first()[0]
    n, types = words.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("types"), F.lit(0))).first()
    n, types = int(n + ends), int(types + (ends > 0))

    pieces, ranks = vocabulary(path)
    scores, byte_score, end_score = first_scores(ranks)
    lattice = Lattice(pieces, scores, byte_score)
    for _ in range(ROUNDS if n else 0):
        found = (
            words.select("words", "train")
            .mapInArrow(_expect(lattice), "piece int, uses double")
            .groupBy("piece")
            .agg(F.sum("uses").alias("uses"))
            .toArrow()
        )
        piece, use = found.column("piece").to_numpy(), found.column("uses").to_numpy()
        uses = np.zeros(len(pieces))
        uses[piece[piece >= 0]] = use[piece >= 0]
        scores, byte_score, end_score = learned_scores(uses, float(use[piece < 0].sum()), float(ends))
        lattice.set_scores(scores, byte_score)

    values = words.select("bucket", "words", "train", "packs", "sizes", "index").mapInArrow(
        _score(lattice), "pack bigint, bucket int, seen binary, pure binary"
    )
    schema = "id bigint, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double, lattice_score double"
    scored = own.groupBy("pack").cogroup(values.groupBy("pack")).applyInArrow(_gather(n, types, ends, end_score), schema)
    return scored.withColumnRenamed("id", id_col)
