import random
import re
from collections import Counter

import numpy as np
import pytest

from pagemill.llm import collocations as C

DDL = "doc_id bigint, text string, lang string, source string, n_chars bigint, phrase string, n bigint, l string, ws string, words string, `group` int"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


@pytest.fixture
def frame(spark):
    def make(rows):
        return spark.createDataFrame([(i, t, lang, "s", 1, "x", 2, "y", "z", "v", 3) for i, t, lang in rows], DDL)

    return make


def brute(rows, min_count, top, percent=100, depth=5):
    f, n = Counter(), Counter()
    for _, text, lang in rows:
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)):
            ws = re.findall(r"[^\x20\x09]+", piece)
            n[lang or "und"] += len(ws)
            f.update((lang or "und", tuple(ws[i : i + k])) for k in range(1, depth + 1) for i in range(len(ws) - k + 1))
    found = {key: a for key, a in f.items() if len(key[1]) > 1 and a >= min_count}
    best = {}
    for (lang, ws), a in found.items():
        longer = [b for (x, y), b in found.items() if x == lang and len(y) > len(ws) and any(y[i : i + len(ws)] == ws for i in range(len(y)))]
        if any(100 * b >= percent * a for b in longer):
            continue
        cuts = []
        for k in range(1, len(ws)):
            left, right = f[lang, ws[:k]], f[lang, ws[k:]]
            cuts.append((1000 * a * n[lang] // (left * right), k, left, right))
        score, _, left, right = min(cuts)
        best.setdefault(lang, []).append((" ".join(ws), a, left, right, n[lang], score))
    out = []
    for lang, items in best.items():
        items.sort(key=lambda x: (-x[5], -x[1], x[0].encode()))
        out += [(lang, k + 1, *x) for k, x in enumerate(items[:top])]
    return sorted(out)


def rows_of(seed, n=120):
    rnd = random.Random(seed)
    words = ["New", "York", "city", "a", "b", "c", "é", "É", "漢", "x\x01", "x", "\x00", "don't", " ", "b\x02c"]
    fixed = ["the quick brown fox jumps over", "New York City", "a a a a a a", "x\x01 x x\x01 x b"]
    rows = []
    for k in range(n):
        parts = []
        for _ in range(rnd.randrange(0, 12)):
            parts += [rnd.choice(fixed) if rnd.random() < 0.3 else rnd.choice(words), rnd.choice([" ", " ", " ", "  ", "\t", ". ", "\n", "!", ", ", "\r\n"])]
        rows.append((rnd.choice([k, None, 1]), "".join(parts), rnd.choice(["en", "en", "de", None])))
    rows += [(1, None, "en"), (2, "", "fr"), (3, ".,;", None), (4, "a b " * 3000, "en"), (5, "one two three four five six", "it")]
    return rows + [rows[3]] * 4


@pytest.mark.parametrize("min_count,budget,percent", [(5, C.BUDGET, 100), (3, 40, 100), (2, 7, 60), (10, 1, 100)])
def test_result_equals_brute_force(frame, min_count, budget, percent):
    rows = rows_of(min_count)
    got = C.mine(frame(rows), min_count, 25, percent, budget=budget).collect()
    assert sorted(map(tuple, got)) == brute(rows, min_count, 25, percent)


def test_small_blocks_change_nothing(frame, monkeypatch):
    monkeypatch.setattr(C, "_POSITIONS", 50)
    rows = rows_of(21, 40)
    assert sorted(map(tuple, C.mine(frame(rows), 4, 25, budget=20).collect())) == brute(rows, 4, 25)


@pytest.mark.parametrize("depth", [2, 3])
def test_other_depths(frame, depth):
    rows = rows_of(31, 40)
    assert sorted(map(tuple, C.mine(frame(rows), 4, 25, depth=depth).collect())) == brute(rows, 4, 25, depth=depth)


def test_empty_table_and_no_frequent_phrase(frame):
    assert C.mine(frame([])).count() == 0
    assert C.mine(frame([(1, "a b c", "en"), (2, None, None)])).count() == 0


def test_groups_hold_no_more_than_the_budget(frame):
    rows = [(k, " ".join(f"w{(k * 7 + j) % 11}" for j in range(60)), "en") for k in range(50)]
    texts = C._texts(frame(rows))
    words = C.count_words(texts).where("phrase IS NOT NULL")
    pairs = C.count_pairs(texts, C.key_filter(words.select("lang", "phrase"), C.phrase_hashes))
    bits = C.key_filter(pairs.select("lang", "phrase"), C.phrase_hashes)
    plan = C.plan_groups(texts, pairs, bits, 5, 400)
    held = Counter()
    for r in C.suffixes(texts, bits, plan, 5).collect():
        held[r.group] += r.n
    assert plan.groups > 4 and max(held.values()) <= 2 * 400


def test_hashes_of_blocks_and_phrases_agree(spark):
    import pyarrow as pa

    batch = pa.RecordBatch.from_arrays([pa.array(["en"]), pa.array(["A b cé. d b"])], names=["lang", "text"])
    (block,) = C.blocks(iter([batch]))
    asked = pa.RecordBatch.from_arrays([pa.array(["en", "en"]), pa.array(["b cé", "d b"])], names=["lang", "phrase"])
    assert np.isin(C.phrase_hashes(asked), block.prefix_hashes(2)).all()


def test_scores_are_exact_beyond_64_bits(spark):
    n, a, left, right = 17_000_000_000_000, 3_000_000_000_001, 5_000_000_000_003, 7_000_000_000_009
    phrases = spark.createDataFrame([("en", "x", left), ("en", "y", right), ("en", "x y", a)], "lang string, phrase string, n bigint")
    sizes = spark.createDataFrame([("en", n)], "lang string, n bigint")
    assert C.score_phrases(phrases, sizes).first().score == 1000 * a * n // (left * right)
