import re
from collections import Counter

from pagemill.llm import rule_ledger as R

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LONG = " ".join(f"w{k % 700}" for k in range(30_000))
TEXTS = [None, "", " \t\n", "a", "a b c a b c", "one two three " * 40, "x\nx\n\nx \ny", "#$ %& | <a>", "É ß 😀  x",
         "A B C " * 30, LONG, "a b c d", "a a a a a", "line\n" * 10, "abc\x0bdef\x0cghi\rj"]


def brute(text):
    t = text or ""
    ws = WORD.findall(t)
    grams = [tuple(ws[i : i + 3]) for i in range(len(ws) - 2)]
    n = Counter(grams)
    spots = {i + k for i, g in enumerate(grams) if n[g] > 1 for k in range(3)}
    lines = [x for x in t.split("\n") if WORD.search(x)]
    return len(ws), sum(map(len, ws)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(spots)


def test_measurements_match_brute_force(docs):
    rows = [(k, t) for k, t in enumerate(TEXTS)] + [(3, "a"), (None, "b c")]
    got = R.ledger(docs(rows)).collect()
    assert len(got) == len(rows)
    texts = {k: t for k, t in rows}
    for r in got:
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == brute(texts[r.doc_id])


def test_bits_follow_the_rules(docs):
    got = {r.doc_id: r for r in R.ledger(docs(list(enumerate(TEXTS)))).collect()}
    assert got[1].failed_bits == R.mask(["few_words"])
    assert got[5].failed_bits & R.mask(["repeated_windows"])
    assert got[9].failed_bits & R.mask(["no_lower_case"])
    assert got[10].failed_bits & R.mask(["few_words"]) == 0


def test_scripts_without_case_are_not_held_to_it(docs):
    words = "שלום עולם טוב היום גשם"
    text = " ".join(f"{words.split()[k % 5]}{words.split()[(k * 7 + 1) % 5]}{words.split()[k // 5 % 5]}{words.split()[k // 25]}" for k in range(120))
    got = {r.doc_id: r.failed_bits for r in R.ledger(docs([(1, text), (2, "ABC " + text)])).collect()}
    assert got[1] & R.mask(["no_lower_case"]) == 0 and got[2] & R.mask(["no_lower_case"])


def test_ablations_match_brute_force(docs):
    ledger = R.ledger(docs(list(enumerate(TEXTS)) * 2))
    bits = [r.failed_bits for r in ledger.collect()]
    seen = {(r.policy, r.rule): (r.n_failed, r.n_only, r.n_kept) for r in R.ablations(ledger).collect()}
    for policy, names in R.POLICIES.items():
        m = R.mask(names)
        for rule in names:
            b = R.mask([rule])
            want = (sum(bool(x & b) for x in bits), sum(x & m == b for x in bits), sum(x & m == 0 for x in bits))
            assert seen[policy, rule] == want


def test_empty_table_and_no_python_in_the_plan(docs):
    empty = R.ledger(docs([]))
    assert empty.count() == 0 and R.ablations(empty).count() == 0
    plan = empty._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
