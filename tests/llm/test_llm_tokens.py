import random
import re
import sys

import pytest
import regex
from tokenizers import Tokenizer

from pagemill.llm import whole_tokens as T
from pagemill.llm.queries import vocabulary_path

ODD = ["<|endoftext|>", " the", "don't I'll", "\n\n  x", "\t", "éß", "漢字かな", "😀👍", "՘", "࢏", "\U00010940", "　", "1234 ½", "\x00\x1c", "á", "<|endof"]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(vocabulary_path())


def count(library, text):
    return len(library.encode(text or "", add_special_tokens=False).ids)


def test_whole_tokens_are_single_tokens_of_the_library(library):
    whole = T.proved(vocabulary_path())
    assert len(whole) > 49_000
    byte_of = {c: b for b, c in T.byte_letters().items()}
    split = T.Counter(vocabulary_path(), whole)
    for token in random.Random(3).sample(sorted(T.Merges(vocabulary_path()).vocab), 3000):
        try:
            text = bytes(byte_of[c] for c in token).decode("utf-8")
        except UnicodeDecodeError:
            continue
        if split.pieces(text) == [text]:
            assert (count(library, text) == 1) == (text in whole)


def test_characters_are_classed_as_by_the_library(library):
    counter = T.Counter(vocabulary_path(), T.proved(vocabulary_path()))
    splits = library.pre_tokenizer.pre_tokenize_str
    step = 16  # neighbours share blocks, so every sixteenth place with a random offset meets every block
    offset = random.Random(5).randrange(step)
    for lo in range(offset, sys.maxunicode, step * 200):
        codes = [c for c in range(lo, min(lo + step * 200, sys.maxunicode), step) if not 0xD800 <= c < 0xE000]
        text = "".join(f"x{chr(c)}1{chr(c)}!{chr(c)} " for c in codes)
        assert counter.pieces(text) == [text[a:b] for _, (a, b) in splits(text)]


def test_counts_match_the_library(spark, docs, library):
    rnd = random.Random(7)
    texts = ["".join(rnd.choice([rnd.choice(ODD), chr(rnd.randrange(0x20, 0x2FF)), " ", "word"]) for _ in range(rnd.randrange(30))) for _ in range(400)]
    texts += [None, "", " ", "a" * 50_000, "é=" * 20_000, "<|endoftext|>" * 50, " ".join(f"w{k}" for k in range(30_000))]
    rows = [(k, t) for k, t in enumerate(texts)] + [(3, texts[3]), (None, "no id"), (3, "other text")]
    got = T.count_tokens(docs(rows), vocabulary_path()).collect()
    assert sorted((r.doc_id is None, r.doc_id or 0, r.n_bytes, r.n_tokens, r.over_limit) for r in got) == sorted(
        (i is None, i or 0, len((t or "").encode()), n := count(library, t), n > 1024) for i, t in rows
    )
    assert T.count_tokens(docs([]), vocabulary_path()).count() == 0


def test_long_and_short_merges_agree():
    merges = T.Merges(vocabulary_path())
    rnd = random.Random(11)
    for _ in range(300):
        parts = [rnd.choice("etaoinéĠ") for _ in range(rnd.randrange(1, 40))]
        assert merges._short(list(parts)) == merges._long(list(parts))


def test_cache_is_bounded(monkeypatch):
    monkeypatch.setattr(T, "_KEPT_COUNTS", 10)
    counts = T.Counts(T.Merges(vocabulary_path()), frozenset([" the"]))
    for k in range(100):
        counts[f"zq{k}"]
    assert len(counts) <= 11 and counts[" the"] == 1


def test_other_vocabularies_are_refused(tmp_path):
    path = tmp_path / "v.json"
    path.write_text('{"model": {"type": "Unigram"}, "pre_tokenizer": {"type": "ByteLevel"}}')
    with pytest.raises(ValueError):
        T.Merges(str(path))


def test_ascii_pattern_is_the_general_one():
    rnd = random.Random(2)
    for _ in range(500):
        text = "".join(chr(rnd.randrange(128)) for _ in range(40))

        assert re.findall(T.ASCII_PRE_TOKENS, text, re.ASCII) == regex.findall(T.PRE_TOKENS, text)
