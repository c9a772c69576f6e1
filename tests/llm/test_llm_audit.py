import random
import re
from collections import Counter, defaultdict

import pytest

from pagemill.llm import source_audit as A

DDL = "doc_id bigint, text string, lang string, source string, n_chars bigint, term string, p bigint, q bigint, kept int, tile int, block int, n bigint"


@pytest.fixture
def frame(spark):
    def make(rows):
        return spark.createDataFrame([(i, t, lang, s, 1, "x", 1, 2, 3, 4, 5, 6) for i, t, lang, s in rows], DDL)

    return make


def brute(rows, min_docs, top):
    rows = [(t or "", lang or "", s or "") for _, t, lang, s in rows]
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    terms = [re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", t.translate(lower)) for t, _, _ in rows]
    df, n = Counter(), Counter()
    for (_, lang, _), ts in zip(rows, terms):
        df.update((lang, t) for t in set(ts))
    kept = defaultdict(list)
    for (lang, t), d in df.items():
        if d >= min_docs:
            kept[lang].append(t)
    for (_, lang, s), ts in zip(rows, terms):
        n.update((lang, s, t) for t in ts if t in set(kept[lang]))
    groups = defaultdict(set)
    for _, lang, s in rows:
        groups[lang].add(s)
    out = []
    for lang, sources in groups.items():
        ks = kept[lang]

        def share(count):
            total = sum(count[t] for t in ks)
            return {t: 1 + 10**9 * (count[t] + 5) // (total + 5 * len(ks)) for t in ks}

        of = {s: Counter({t: n[lang, s, t] for t in ks}) for s in sources}
        p = {s: share(of[s]) for s in sources}
        q = share(sum(of.values(), Counter()))
        for s in sources:
            pairs = [(o, sum(abs(p[s][t] - p[o][t]) for t in ks)) for o in sources if o != s]
            above = [(t, p[s][t] - q[t]) for t in ks if of[s][t] and p[s][t] > q[t]]
            for part, found, limit in (("pair", pairs, None), ("term", above, top)):
                found.sort(key=lambda x: (-x[1], x[0].encode()))
                out += [(lang, s, part, i, v, k + 1) for k, (i, v) in enumerate(found[:limit])]
    return sorted(out)


def rows_of(seed, n=150):
    rnd = random.Random(seed)
    words = ["ab", "ABC", "abc", "abcd", "abcde", "abcdefgh", "abcdefghi", "éa", "É", "漢字", "x", "🙂", "supercalifragilistic" * 4, "it's", "a_b", "\x00z"]
    words += [f"w{c}{d}" for c in "abc" for d in "xyz"]
    rows = [
        (rnd.choice([k, None, 1]), " ".join(rnd.choices(words, k=rnd.randrange(0, 40))), rnd.choice(["en", "de", None, ""]), rnd.choice(["s1", "s2", "s3", "é", None]))
        for k in range(n)
    ]
    rows += [(1, None, "en", "empty"), (2, "", "fr", "a"), (3, None, "fr", "b"), (4, "unseen word", "it", "only")]
    return rows + [(9, "hot abc " * 3000, "en", "s1")] + [rows[0]] * 3


@pytest.mark.parametrize("first,block,tile", [(4, 4096, 64), (1, 3, 2), (100, 5, 1)])
def test_result_equals_brute_force(frame, first, block, tile):
    rows = rows_of(first)
    got = A.audit(frame(rows), min_docs=5, top=4, first=first, block=block, tile=tile).collect()
    assert sorted(map(tuple, got)) == brute(rows, 5, 4)


def test_empty_table_and_nothing_kept(frame):
    assert A.audit(frame([])).count() == 0
    got = A.audit(frame([(1, "a b", "en", "s"), (2, "a", "en", "t")])).collect()
    assert sorted(map(tuple, got)) == [("en", "s", "pair", "t", 0, 1), ("en", "t", "pair", "s", 0, 1)]


def test_levels_keep_every_frequent_term_and_its_count(frame):
    rows = [(k, f"common{'x' * (k % 3)} rare{k} " + "y" * 40, "en", "s") for k in range(60)]
    kept = {r.term.decode() if isinstance(r.term, bytes) else bytes(r.term).decode(): r.n_docs for r in A.kept_terms(frame(rows), 10, 2).collect()}
    assert kept == {"common": 20, "commonx": 20, "commonxx": 20, "y" * 40: 60, "rare": 60}


def test_full_filters_change_nothing(frame, monkeypatch):
    from pagemill.llm import key_filter

    monkeypatch.setattr(key_filter, "BITS", 64)
    rows = rows_of(8, 60)
    assert sorted(map(tuple, A.audit(frame(rows), min_docs=5, top=4).collect())) == brute(rows, 5, 4)


def test_shares_stay_exact_beyond_64_bits(spark):
    from pyspark.sql import functions as F

    n, total, kept = 9_000_000_000_000, 123_456_789_012_345, 777
    got = spark.range(1).select(A._share(F.lit(n), F.lit(total), F.lit(kept).cast("bigint")).alias("p")).first().p
    assert got == 1 + 10**9 * (n + 5) // (total + 5 * kept)
