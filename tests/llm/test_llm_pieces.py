import hashlib
import random

import pytest
import sentencepiece

from pagemill.llm import prefix_bpe
from pagemill.llm.queries import pieces_path

PATH = pieces_path()
LIBRARY = sentencepiece.SentencePieceProcessor(model_file=PATH)
EDGES = ["", " ", "  a  b ", "a\nb\n\n", "▁a▁", "<s> </s> <unk> <0x41>", "\x00", "é😀​\t\r", "a" * 700, " " * 400, "\n" * 50,
         "=-" * 400, "日本語 текст", "� ⁇ ", "x" + "́" * 60]


def texts(n=300, seed=2):
    rnd = random.Random(seed)
    vocabulary = [p.replace("▁", " ") for p in prefix_bpe.pieces(PATH).text[259:]]
    out = list(EDGES)
    for _ in range(n):
        out.append("".join(rnd.choice(vocabulary) for _ in range(rnd.randint(1, 12))))
        out.append("".join(rnd.choice("ab  \n\té😀x1=-_.") for _ in range(rnd.randint(1, 40))))
        out.append("".join(chr(rnd.choice((rnd.randint(32, 126), rnd.randint(0x80, 0x7FF), rnd.randint(0x10000, 0x1FFFF)))) for _ in range(20)))
    return out


def test_encoding_and_decoding_are_the_librarys():
    p = prefix_bpe.pieces(PATH)
    for t in texts():
        ids = LIBRARY.encode(t)
        assert p.encode(t) == ids, repr(t)
        assert p.decode(ids) == LIBRARY.decode(ids), repr(t)


def test_decoding_of_any_ids():
    p, rnd = prefix_bpe.pieces(PATH), random.Random(3)
    for _ in range(500):
        ids = [rnd.choice((rnd.randint(0, 31_999), rnd.randint(0, 300), 259, 0, 1)) for _ in range(rnd.randint(1, 9))]
        assert p.decode(ids) == LIBRARY.decode(ids), ids


def test_digests(docs):
    rows = [(k, t) for k, t in enumerate(texts(20))] + [(None, None), (1, " ")]
    got = prefix_bpe.encoding_digests(docs(rows), PATH).collect()
    assert len(got) == len(rows)
    of = dict(rows)
    for r in got:
        ids = LIBRARY.encode(of[r.doc_id] or "")
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(LIBRARY.decode(ids).encode()).hexdigest()


def test_ids_and_text_of_the_operator(docs):
    got = {r.doc_id: r for r in prefix_bpe.encode_texts(docs([(1, " a é\n"), (2, None)]), PATH).collect()}
    assert got[1].ids == LIBRARY.encode(" a é\n") and got[1].decoded == " a é\n"
    assert got[2].ids == [] and got[2].decoded == ""
    assert prefix_bpe.encode_texts(docs([]), PATH).count() == 0


def test_unknown_models_are_refused(tmp_path):
    with pytest.raises(OSError):
        prefix_bpe.Pieces(str(tmp_path / "none.model"))
