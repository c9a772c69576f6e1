import math
import random
from itertools import product

import pytest

from pagemill.llm import dom_marginals as M
from pagemill.llm import page_labels, url_intervals
from pagemill.llm.dom_tree import parse


@pytest.fixture(scope="module")
def model():
    return M.train(page_labels.labelled_pages())


def test_messages_give_exact_marginals():
    rnd = random.Random(1)
    for _ in range(20):
        n = rnd.randint(1, 8)
        parent = [-1] + [rnd.randrange(v) for v in range(1, n)]
        odds = [math.exp(rnd.uniform(-2, 2)) for _ in range(n)]
        edges = [((rnd.uniform(0.1, 2), rnd.uniform(0.1, 2)), (rnd.uniform(0.1, 2), rnd.uniform(0.1, 2))) for _ in range(n)]
        total, ones = 0.0, [0.0] * n
        for y in product((0, 1), repeat=n):
            p = math.prod(odds[v] if y[v] else 1.0 for v in range(n))
            p *= math.prod(edges[v][y[parent[v]]][y[v]] for v in range(1, n))
            total += p
            ones = [o + p * s for o, s in zip(ones, y)]
        got, _ = M.messages(odds, parent, edges)
        assert got == pytest.approx([o / total for o in ones])


def test_held_out_labelled_pages(model):
    wrong = total = 0
    for html in page_labels.labelled_pages(120, seed=77):
        page = parse(html)
        labels, content = M.node_labels(page), M.marginals(model, page)
        wrong += sum((content[n] >= 0.5) != labels[n] for n, _ in page.runs)
        total += len(page.runs)
    assert total > 2000 and wrong / total < 0.01


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{x}</style></head><body>
<header class="site-header"><a href=/>Home</a></header><nav><ul><li><a href=/a>A</a><li><a href=/b>B</a></ul></nav>
<!-- <p>no</p> --><article><h1>Head &amp; line</h1><p>One  two
 three.<p>Caf&eacute; &#38; <b>bold</b> text<br>next.</p><script>var t="</p>";</script>
<aside class="related"><a href=/r>Read this too</a></aside><ul><li>Item one is here</li><li>Item two</li></ul></article>
<section class="comments"><div class="comment"><p>I liked it</p></div></section>
<form class="newsletter"><label>Mail</label><input><button>Send</button></form>
<footer>&copy; 2020 &middot; All rights</footer></body></html>"""


def test_a_page(model):
    want = ["Head & line", "One two three.", "Café & bold text next.", "Item one is here", "Item two"]
    assert M.main_blocks(model, PAGE) == want


def test_edge_pages(spark, model):
    deep = "<div>" * 20_000 + "<p>x</p>"
    rows = [(1, "u", PAGE), (2, None, None), (3, "u", ""), (4, "u", "plain &am text"), (5, "u", deep), (6, "u", "<p"), (1, "u", PAGE),
            (7, "u", "<script>x"), (8, "u", "<article><p>" + "word " * 50_000 + "</article>"), (None, "u", "<!--"), (9, "u", "a < b <3")]
    frame = spark.createDataFrame(rows, "page_id bigint, url string, html string").selectExpr("*", "1 AS text", "2 AS blocks")
    got = M.extract(frame, model).collect()
    assert len(got) == len(rows)
    by = {r.page_id: r.text for r in got}
    assert by[2] == by[3] == by[6] == by[7] == by[None] == ""
    assert len(by[8]) == 5 * 50_000 - 1
    assert M.extract(frame.limit(0), model).count() == 0
    assert "".join(t for _, t in parse("a < b <3").runs) == "a < b <3"
    assert parse("plain &am text").runs[0][1] == "plain &am text"


def brute(url, rules):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:cut])
    path = rest[cut:]
    path = path[: min([path.find(c) for c in "?#" if c in path], default=len(path))]
    fits = [
        (len(h + p), len(h), v == "block", h + p, v)
        for h, p, v in rules
        if (h == "" or host == h or host.endswith("." + h)) and path.startswith(p)
    ]
    best = max(fits, default=None)
    return host, path, best[3] if best else None, best[4] if best else "allow"


def test_urls_match_brute_force(spark):
    rnd = random.Random(2)
    hosts = ["com", "org", "a.com", "b.a.com", "aa.com", "x.org", "xorg", "é.org", "", "com.", "1.2.3.4"]
    paths = ["/", "/a", "/a/", "/a/b", "/ab", "", "/é", "/a/b/c/d"]
    rules = {(rnd.choice(hosts), rnd.choice(paths)): rnd.choice(("allow", "block")) for _ in range(60)}
    rules = [(h, p, v) for (h, p), v in rules.items()]
    urls = [None, "", "no scheme", "http://", "http://A.COM", "http://é.org/é?x#y", "http://a.com?q://z", "x://y://z/a#b"]
    urls += [f"http://{rnd.choice(('', 'w.', 'b.'))}{rnd.choice(hosts)}{rnd.choice(paths)}{rnd.choice(('', '?a=1', '#x', 'q/'))}" for _ in range(300)]
    urls += ["http://b.a.com/a/b"] * 300 + ["http://a.com/" + "x" * 20_000]
    frame = spark.createDataFrame(list(enumerate(urls)), "page_id bigint, url string").selectExpr("*", "'k' AS host", "1 AS key")
    known = spark.createDataFrame(rules, "host string, path string, verdict string")
    got = url_intervals.judge(frame, known).collect()
    assert len(got) == len(urls)
    for r in got:
        assert (r.host, r.path, r.rule, r.verdict) == brute(urls[r.page_id], rules), urls[r.page_id]


def test_urls_without_rules_or_rows(spark):
    none = spark.createDataFrame([], "host string, path string, verdict string")
    frame = spark.createDataFrame([(1, "http://a/b"), (None, None)], "page_id bigint, url string")
    assert [(r.rule, r.verdict) for r in url_intervals.judge(frame, none).collect()] == [(None, "allow")] * 2
    odd = spark.createDataFrame([(None, None, "block"), (None, None, "block")], "host string, path string, verdict string")
    assert {r.verdict for r in url_intervals.judge(frame, odd).collect()} == {"block"}
    assert url_intervals.judge(frame.limit(0), odd).count() == 0
