"""Page extraction, URL filters and packing against brute force."""

import itertools
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from lexgrid.llm import entries, packing, pages, urls

SF = "/root/testdata/sf0.001"


def page(*body):
    return "<!DOCTYPE html><html><head><title>t</title><style>p{}</style></head><body>" + "".join(body) + "</body></html>"


def text_of(html):
    found = pages.blocks(html)
    kinds = {k for _, k in found}
    want = pages.wanted(kinds)
    return " ".join(t for t, k in found if k.rstrip("?") == want)


@pytest.mark.parametrize(
    "html, want",
    [
        (page("<nav><ul><li><a>x</a></li></ul></nav><div class='ad'>buy</div><article><h1>A &amp; B</h1><p><b>c\n  d<br><p>e</p></article><footer>f</footer>"), "A & B c d e"),
        (page("<article><header><h1>T</h1><p>by me</p></header><p>x<i>y</i>z</p><aside>s</aside><form>q</form><script>var p='</p>';</script><div class='comments'><p>me too</p></div><p>end</p></article>"), "T xyz end"),
        (page("<main><p>one</p><div id=sidebar>no</div><div role='complementary'>no</div><p class=\"lead\">two</p></main><p>out</p>"), "one two"),
        (page("<p>1 < 2 &lt; 3</p><div class='cookie-notice'>we use cookies</div><!-- <p>no</p> --><p>&eacute;t&#233; &am</p>"), "1 < 2 < 3 été &am"),
        ("<article><p>cut of", "cut of"), ("<article><p>cut</p><p cla", "cut"), ("<article>a<p>b</arti", "a b"), ("", ""), ("plain", "plain"),
        (page("<article><p>a&nbsp;b</p><ul><li>c<li>d</ul><table><tr><td>e<td>f</table></article>"), "a b c d e f"),
        (page("<article><p>shadow heading adventure</p><div class='headline'>k</div><div class='added shared-x'>l</div></article>"), "shadow heading adventure k l"),
        (page("<main><p>Body text</p><article class='comment'><p>nice post!</p></article></main>"), "Body text"),
        (page("<article><h1>T</h1><p>own</p><article class='comment-body reply'>me</article></article><article class=teaser><p>x</p></article>"), "T own"),
        (page("<article><h2><a href='/x'>Other page</a></h2><p>Its first words</p></article><article><h1>This</h1><p>own <a href='/y'>link</a></p></article>"), "This own link"),
        (page("<article><h2><a href='/x'>One</a></h2><p>a</p></article><article><a href='/y'><h2>Two</h2></a><p>b</p></article>"), "One a Two b"),
        (page("<article><p class='search-engine'>on engines</p><p class='social-science'>on science</p><p class='social-links'>no</p><p id='side-bar'>no</p><p class='skip-link'>no</p></article>"), "on engines on science"),
        (page("<script>if (a<b) document.write('<article>')</script><p>x</p><noscript>n</noscript><textarea>t</textarea>"), "x"),
    ],
)
def test_blocks(html, want):
    assert text_of(html) == want


def test_fixture_articles(spark):
    import html
    import re

    got = {r.page_id: r for r in entries.op3_html_extraction(spark, SF).collect()}
    rows = spark.read.parquet(f"{SF}/pages.parquet").collect()
    assert len(got) == len(rows)
    for r in rows:
        inner = re.search(r"<article>(.*?)(?:</article>|$)", r.html, re.S)[1]
        want = " ".join(html.unescape(re.sub(r"<[^<>]*(>|$)", " ", re.sub(r"</?b>", "", inner))).split())
        assert got[r.page_id].text == want and got[r.page_id].n_chars == len(want)


def test_common_lines():
    rng = random.Random(3)
    for _ in range(300):
        a, b = ([rng.randrange(4) for _ in range(rng.randrange(8))] for _ in range(2))
        best = max(n for n in range(len(a) + 1) if any(_inside(c, b) for c in itertools.combinations(a, n)))
        got = pages.common_lines(a, b)
        assert len(got) == best and _inside([a[i] for i in got], b) and got == sorted(got)


def test_common_lines_of_many_repeats():
    a = [1] * 5000 + [2, 3]
    assert pages.common_lines(a, a) == list(range(5002)) and pages.common_lines([1] * 3000, [1] * 2500 + [9]) == list(range(2500))


def test_common_lines_of_many_shifted_repeats():
    a, b = [1, 2] * 2000, [2] + [1, 2] * 2000  # eight million equal pairs
    assert pages.common_lines(a, b) == list(range(4000)) and len(pages.common_lines(b, a)) == 4000
    rng = random.Random(4)
    a, b = ([rng.randrange(3) for _ in range(n)] for n in (700, 900))  # over many kept rows
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(row[j] + 1 if x == y else max(row[j + 1], new[-1]))
        row = new
    got = pages.common_lines(a, b)
    assert len(got) == row[-1] and got == sorted(set(got)) and _inside([a[i] for i in got], b)


def _inside(c, b):
    it = iter(b)
    return all(x in it for x in c)


def test_differencing(spark):
    frame = lambda i: page(f"<div>Site name</div><p>Own text number {i} of this page, which is long enough to matter</p><div>Call us now</div>")
    rows = [(i, f"http://h.org/a/{i}", frame(i), "clash") for i in range(6)] + [(10 + i, "http://h.org/a/3", frame(3), "clash") for i in range(3)]
    rows += [(20, "http://solo.org/x", frame(20), "c"), (21, None, None, None), (22, "http://e.org", "", "c")]
    got = {r.page_id: r.text for r in pages.extract_pages(spark.createDataFrame(rows, "page_id long, url string, html string, text string")).collect()}
    own = "Own text number {} of this page, which is long enough to matter"
    assert all(got[i] == own.format(i) for i in range(6)) and all(got[10 + i] == own.format(3) for i in range(3))
    assert got[20] == f"Site name {own.format(20)} Call us now" and got[21] == got[22] == ""


def test_differencing_inside_articles(spark):
    long = lambda i: f"Story {i} has words of its own, enough of them to be long beside the rest"
    frame = lambda i, *more: page("<article>", f"<p>{long(i)}</p>", *more, "<p>Get our letter by mail</p></article>")
    rows = [(i, f"http://h.org/a/{i}", frame(i, "<p>Quoted by two</p>" if i in (2, 3) else "")) for i in range(7)]
    rows += [(10 + i, f"http://copies.org/{i}", frame(10, f"<p>{i}</p>")) for i in range(7)]  # near copies of one article
    rows += [(20 + i, f"http://two.org/{i}", frame(20 + i)) for i in range(2)]  # too few to tell
    got = {r.page_id: r.text for r in pages.extract_pages(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    for i in range(7):
        assert got[i] == long(i) + (" Quoted by two" if i in (2, 3) else "")
        assert got[10 + i] == f"{long(10)} {i} Get our letter by mail"
    assert all(got[20 + i] == f"{long(20 + i)} Get our letter by mail" for i in range(2))


def test_differencing_decides_unsure_parts(spark):
    """The name ``search-engine`` may mean a search form or not: the nearest article tells, and nothing goes without one."""
    frame = lambda i, box: page(f"<article><p>Story {i} has words of its own, enough of them to be long</p><div class='search-engine'><p>{box}</p></div></article>")
    story = lambda i: f"Story {i} has words of its own, enough of them to be long"
    rows = [(i, f"http://h.org/{i}", frame(i, "Find it here")) for i in range(2)] + [(5, "http://o.org/1", frame(5, "Find it here"))] + [(10 + i, f"http://p.org/{i}", frame(10 + i, f"Engine {i} is fast")) for i in range(2)]
    got = {r.page_id: r.text for r in pages.extract_pages(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {0: story(0), 1: story(1), 5: f"{story(5)} Find it here", 10: f"{story(10)} Engine 0 is fast", 11: f"{story(11)} Engine 1 is fast"}


def test_pages_empty_table(spark):
    assert pages.extract_pages(spark.createDataFrame([], "page_id long, url string, html string, _html string, idx long")).count() == 0


def test_differencing_beyond_copies(spark):
    menu = "<nav>" + "".join(f"<p>Menu entry {i} of the template that all pages have</p>" for i in range(20)) + "</nav>"
    own = lambda i: f"Words of page {i} alone, some more of them than the template's"
    rows = [(i, f"http://menus.org/{i}", page(menu, "<p>Site name</p>", f"<p>{own(i)}</p>")) for i in range(3)]
    for host, n in (("run", 5), ("long", 700)):  # copies between two other pages
        mid = lambda i: f"<p>{own('x')}, and a few more of these</p><p>No {i}</p>"
        bodies = [f"<p>{own('a')}</p>", *(mid(i) for i in range(n)), f"<p>{own('z')}</p>"]
        rows += [(1000 * (1 + (host == "long")) + i, f"http://{host}.org/{i:04}", page("<p>Site name</p>", b)) for i, b in enumerate(bodies)]
    got = {r.page_id: r.text for r in pages.extract_pages(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert len(got) == len(rows) and all(got[i] == own(i) for i in range(3))
    assert not [i for i, t in got.items() if "Site name" in t]
    assert all(got[b + 1 + i] == f"{own('x')}, and a few more of these No {i}" for b, n in ((1000, 5), (2000, 700)) for i in range(n))


def test_page_order_is_even(spark):
    from lexgrid.llm.common import Scratch, indexed

    rows = spark.range(500).select(F.lit("one").alias("host"), (F.col("id") % 50).alias("path"), "id")
    got = indexed(Scratch(spark), rows, "host", "path", "id").orderBy("idx").collect()
    assert [r.idx for r in got] == list(range(500)) and [(r.path, r.id) for r in got] == sorted((r.path, r.id) for r in got)


def brute_url(u):
    low = lambda s: "".join(c.lower() if "A" <= c <= "Z" else c for c in s)
    if not u or "://" not in u:
        host = path = ""
    else:
        rest = u.split("://", 1)[1]
        k = min([len(rest), *(rest.find(c) for c in "/?#" if c in rest)])
        host, rest = low(rest[:k]), rest[k:]
        path = rest[: min([len(rest), *(rest.find(c) for c in "?#" if c in rest)])]
    fits = [(len(r), r, v) for v, r in urls.RULES if (host == r[: r.index("/")] or host.endswith("." + r[: r.index("/")])) and path.startswith(r[r.index("/") :])]
    return host, path, max(fits)[1] if fits else None, max(fits)[2] if fits else None


def test_urls(spark):
    odd = [None, "", "no scheme", "http://", "HTTP://WWW.Example.NET/en/1?x=/fr/#y", "http://net", "https://a.net/?q", "http://xnet/", "http://É.ORG/fr/é", "x://y://net/en/", "http://example.com/de/", "http://notexample.com/de/1", "http://org/fr/", "http://a.org#/fr/"]
    frame = spark.createDataFrame([(-1 - i, u, "c") for i, u in enumerate(odd)] + [(-1, odd[4], "c")], "page_id long, url string, host string")
    real = spark.read.parquet("/root/testdata/sf0.01/pages.parquet").select("page_id", "url", F.lit("x").alias("host"))
    rows = real.unionByName(frame)
    got = urls.filter_urls(rows).collect()
    key = lambda r: (r[0], r[1], r[2] or "", r[3] or "")
    want = sorted(((r.page_id, *brute_url(r.url)[:3]) for r in rows.collect()), key=key)
    assert sorted(((r.page_id, r.host, r.path, r.rule) for r in got), key=key) == want
    for r in got:
        assert r.verdict in ("allow", "block") and (r.rule is None or dict((b, a) for a, b in urls.RULES)[r.rule] == r.verdict)
    assert urls.filter_urls(frame.limit(0)).count() == 0


def test_url_tree(spark):
    rows = [(i, f"http://h.io/{'ab'[i % 2]}/{chr(97 + i % 26)}{chr(97 + i // 26)}x/{i}") for i in range(300)] + [(1000 + i, f"http://h.io/c/p{i}") for i in range(40)]
    labels = [(i, i % 2 == 0) for i in range(0, 200)] + [(1000 + i, i < 3) for i in range(40)]
    got = {r.page_id: r for r in urls.filter_urls(spark.createDataFrame(rows, "page_id long, url string"), labels=spark.createDataFrame(labels, "page_id long, blocked boolean")).collect()}
    assert got[250].template == "/a/*/{n}" and got[250].verdict == "block" and got[251].verdict == "allow" and got[1039].verdict == "allow"
    alike = [(i, f"http://m.io/{'ab'[i % 2]}/{i}") for i in range(60)]
    got = urls.filter_urls(spark.createDataFrame(alike, "page_id long, url string"), labels=spark.createDataFrame([(i, True) for i in range(40)], "page_id long, blocked boolean")).collect()
    assert {r.purity for r in got} == {round((40 + 2) / (40 + 4), 6)}  # merged: both branches' labels


def test_url_tree_nested(spark):
    word = lambda i: "".join(chr(97 + i // 26**k % 26) for k in range(3))
    rows = [(i, f"http://n.io/users/{word(i % 20)}/posts/{word(i)}") for i in range(60)] + [(100, "http://n.io/users/" + "x/" * 60)]
    labels = spark.createDataFrame([(i, True) for i in range(40)], "page_id long, blocked boolean")
    got = {r.page_id: r for r in urls.filter_urls(spark.createDataFrame(rows, "page_id long, url string"), labels=labels).collect()}
    assert {got[i].template for i in range(60)} == {"/users/*/posts/*"} and all(got[i].verdict == "block" for i in range(60))
    assert got[100].template == "/users/*/" + "x/" * 59 and got[100].verdict == "allow"


def test_url_query_is_native(spark):
    plan = entries.op8_url_filter(spark, SF)._jdf.queryExecution().toString()
    assert not any(x in plan for x in ("Python", "Pandas", "Arrow", "CartesianProduct"))


def check_packed(rows, capacity):
    bins = {}
    for r in rows:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for b in bins.values():
        at = 0
        for offset, length in sorted(b):
            assert offset == at
            at += length
        assert at <= capacity
    return len(bins)


def test_packing(spark):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    library = Tokenizer.from_file(path)
    odd = [(None, None), (-1, ""), (-2, "ΑΣ ΟΔΟΣ Σ İ ﬁ é ² ½ \x1c \x85 　 日本"), (-3, "it's <|endoftext|>x <|startoftext|> don't!!"), (-4, "word " * 9000), (-4, "word " * 9000)]
    frame = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", F.lit("c").alias("length")).unionByName(spark.createDataFrame(odd, "doc_id long, text string").withColumn("length", F.lit("c")))
    rows = packing.pack_documents(frame, path).collect()
    got = sorted((r.doc_id or 0, r.piece, r.start, r.length, r.ids_crc32) for r in rows)
    want = []
    for r in frame.collect():
        ids = np.array([*library.encode(r.text or "", add_special_tokens=False).ids, 0], "<u4")
        want += [(r.doc_id or 0, k, a, len(ids[a : a + 2048]), zlib.crc32(ids[a : a + 2048].tobytes())) for k, a in enumerate(range(0, len(ids), 2048))]
    assert got == sorted(want)
    n = check_packed(rows, 2048)
    assert n <= 1.02 * -(-sum(r.length for r in rows) // 2048) + 1
    assert packing.pack_documents(frame.limit(0), path).count() == 0


def test_encoder_random():
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    library, encoder = Tokenizer.from_file(path), packing.WordEncoder(path)
    rng = random.Random(5)
    texts = ["".join(rng.choice(["a", "The", " ", "\n", "'s", "É", "12", "!!", "　", "\x1c", "\x85", "σΣ", "日", "<|endoftext|>", "é", "²", "x'LL", "_", "İ"]) for _ in range(rng.randrange(14))) for _ in range(3000)]
    for t, got in zip(texts, encoder.ids(texts), strict=True):
        assert got.tolist() == library.encode(t, add_special_tokens=False).ids, repr(t)


def test_plan_bins():
    rng = np.random.default_rng(1)
    for lengths, capacity in [(rng.integers(1, 101, 3000), 100), (rng.integers(40, 60, 500), 100), (np.full(999, 34), 100), (np.array([100] * 50 + [1]), 100), (np.array([51] * 20 + [49] * 20), 100), (np.array([], int), 100)]:
        histogram = {int(k): int(n) for k, n in zip(*np.unique(lengths, return_counts=True), strict=True)}
        plan = packing.plan_bins(histogram, capacity)
        used = {}
        for pattern, n in plan:
            assert sum(k * a for k, a in pattern.items()) <= capacity
            for k, a in pattern.items():
                used[k] = used.get(k, 0) + a * n
        assert used == histogram
        big = sum(1 for x in lengths if x > capacity / 2)
        best = max(big, -(-int(lengths.sum()) // capacity), -(-len(lengths) // (capacity // int(lengths.min()))) if len(lengths) else 0)
        assert sum(n for _, n in plan) <= 1.06 * best + 1


def test_knapsack():
    rng = random.Random(2)
    for _ in range(30):
        w = np.full(13, -1.0)
        for k in rng.sample(range(1, 13), 4):
            w[k] = rng.random()
        best = 0.0
        present = [k for k in range(1, 13) if w[k] > 0]
        for a in itertools.product(range(13), repeat=len(present)):
            if sum(x * k for x, k in zip(a, present)) <= 12:
                best = max(best, sum(x * w[k] for x, k in zip(a, present)))
        p = packing.knapsack(w, 12)
        assert abs(sum(n * w[k] for k, n in p.items()) - best) < 1e-9 and sum(n * k for k, n in p.items()) <= 12
        counts = np.where(w > 0, 2, 0)
        best = max(sum(x * w[k] for x, k in zip(a, present)) for a in itertools.product(range(3), repeat=len(present)) if sum(x * k for x, k in zip(a, present)) <= 12)
        p = packing.bounded_knapsack(w, counts, 12)
        assert abs(sum(n * w[k] for k, n in p.items()) - best) < 1e-9 and all(n <= 2 for n in p.values())


def test_words_met_again_are_kept(monkeypatch):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    library, encoder = Tokenizer.from_file(path), packing.WordEncoder(path)
    monkeypatch.setattr(packing, "MEMORY", 400)
    learned = []
    learn = encoder._learn
    monkeypatch.setattr(encoder, "_learn", lambda words: (learned.extend(words), learn(words)))
    often = ["the", "tokens,", "it's", "a$$$", "x<|endoftext|>y", "7th.", "été"]
    for k in range(40):
        texts = [" ".join([*often, *(f"new{a}{b}{chr(97 + k % 26)}{chr(97 + k // 26)}%%" for a in "abcdef" for b in "ghijkl")])]
        assert [x.tolist() for x in encoder.ids(texts)] == [library.encode(t, add_special_tokens=False).ids for t in texts]
        assert len(encoder.known) <= 400 + 150
    assert all(learned.count(w) == 1 for w in often)
