"""The dealt methods against enumeration, and what changes when they are switched off."""

import itertools
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from lexgrid.llm import common, language, licenses, pages, quality, secrets, urls
from lexgrid.llm.crf import LinearChain


def chain_of(rng, k):
    c = LinearChain(5, k)
    c.trans = rng.normal(size=(k, k)).astype(np.float32)
    return c


@pytest.mark.parametrize("k", [2, 3])
def test_chain_against_all_paths(k):
    rng = np.random.default_rng(k)
    c = chain_of(rng, k)
    lengths = np.array([1, 4, 6])
    emit = rng.normal(size=(int(lengths.sum()), k)).astype(np.float32)
    got, pairs = c.marginals(emit, lengths, pairs=True)
    want_pairs, at = np.zeros((k, k)), 0
    for n in lengths:
        own = emit[at : at + n].astype(float)
        score = {p: sum(own[t, s] for t, s in enumerate(p)) + sum(float(c.trans[a, b]) for a, b in itertools.pairwise(p)) for p in itertools.product(range(k), repeat=int(n))}
        total = sum(map(math.exp, score.values()))
        prob = np.zeros((n, k))
        for p, s in score.items():
            for t, x in enumerate(p):
                prob[t, x] += math.exp(s) / total
            for a, b in itertools.pairwise(p):
                want_pairs[a, b] += math.exp(s) / total
        assert np.allclose(got[at : at + n], prob, atol=1e-4)
        path = tuple(c.viterbi(emit[at : at + n]).tolist())
        assert score[path] == pytest.approx(max(score.values()), abs=1e-5)
        at += n
    assert np.allclose(pairs, want_pairs, atol=1e-3)


def test_long_chains_are_one_chain():
    rng = np.random.default_rng(7)
    for k in (2, 4):
        c = chain_of(rng, k)
        c.trans *= 3
        lengths = np.array([1, 31, 32, 33, 64, 700, 5])
        emit = rng.normal(size=(int(lengths.sum()), k)).astype(np.float32) * 2
        assert np.allclose(c.long_marginals(emit, lengths), c.marginals(emit, lengths), atol=1e-4)
        assert np.allclose(c.long_marginals(emit, lengths, step=3), c.marginals(emit, lengths), atol=1e-4)
    sticky = LinearChain(1, 2)
    sticky.trans = np.array([[4, -4], [-4, 4]], np.float32)
    emit = np.zeros((200, 2), np.float32)
    emit[0] = [9, 0]  # one sure word, and its label is carried over all borders
    assert sticky.long_marginals(emit, np.array([200]))[40, 0] > 0.95


def test_languages_of_unlearned_words(spark):
    """Lettered texts always get a language: of those of which nothing was learned, the sample's commonest."""
    rows = [(i, "the cat and the dog walk home " * 4, "en") for i in range(12)] + [(100 + i, "der hund und die katze", "de") for i in range(12)]
    odd = [(1000 + i, chr(0x4E00 + 7 * i), None) for i in range(50)] + [(2000, "12 34", None), (2001, None, None)]
    got = {r.doc_id: r for r in language.identify_languages(spark.createDataFrame(rows + odd, "doc_id long, text string, lang string")).collect()}
    assert all(got[1000 + i].lang_pred in ("de", "en") and 0 < got[1000 + i].score <= 1 for i in range(50))
    assert got[2000].lang_pred == got[2001].lang_pred == "und"


def test_language_of_a_very_long_text(spark):
    rows = [(i, "the cat and the dog walk home " * 4, "en") for i in range(12)] + [(100 + i, "der hund und die katze gehen heim", "de") for i in range(12)]
    rows += [(5000, "the dog and the cat walk " * 60_000, None), (5001, "hundkatze" * 100_000, None)]
    got = {r.doc_id: r for r in language.identify_languages(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    assert got[5000].lang_pred == "en" and got[5001].lang_pred == "de"


def test_license_postings_are_intersected():
    index = licenses.RareTokenIndex(1000, {w.encode(): 5 for w in "license licensed mozilla public".split()})
    text = dict((label, t) for label, t, _ in licenses.TEMPLATES)
    whole = text["mpl-2.0"].split()
    noise = [f"n{i}" for i in range(40)]
    assert {m["label"] for m in index.scan([w.encode() for w in noise + whole + noise])} == {"mpl-2.0"}
    spread = [x for w in whole for x in (w, *noise[:5])]  # all words, in order, but at other relative positions
    shifts = {t: index.meet(t, ws, {w: [i for i, x in enumerate(spread) if x == w.decode()] for w, _ in ws}) for t, ws in index.lookup({w: [i for i, x in enumerate(spread) if x == w.decode()] for w in index.postings if w.decode() in spread}).items()}
    assert not any(shifts.values()) and not [m for m in index.scan([w.encode() for w in spread]) if not m["base"]]
    key = "the mozilla public license is a text".split()  # the key phrase alone isn't a notice
    assert not [m for m in index.scan([w.encode() for w in noise + key + noise]) if not m["base"]]


def test_license_altered_and_repeated():
    rng = random.Random(3)
    index = licenses.RareTokenIndex(1000, {})
    for label, text, keys in licenses.TEMPLATES:
        words = text.split()
        if len(words) < 20:
            continue
        inner = {w for k in keys for w in k.split()}
        at = [i for i, w in enumerate(words) if w not in inner]
        for i in rng.sample(at, min(2, len(at))):
            words[i] = "altered"
        found = [m for m in index.scan([w.encode() for w in ["x"] * 9 + words + ["y"] * 9 + words]) if m["label"] == label and m["end"] - m["start"] == len(words)]
        assert [m["start"] for m in found] == [9, 18 + len(words)], label  # one match for each copy


def test_licenses_without_the_method(spark):
    rows = spark.createDataFrame([(1, "x Released under the MIT license y"), (2, "all rights reserved")], "doc_id long, text string")
    with_it = {r.doc_id: sorted({m.label for m in r.matches}) for r in licenses.scan_licenses(rows).collect()}
    without = {r.doc_id: sorted({m.label for m in r.matches}) for r in licenses.scan_licenses(rows, templates=[]).collect()}
    assert with_it == {1: ["mit"], 2: ["reserved"]} and without == {1: [], 2: ["reserved"]}


def test_secrets_widely_copied_by_one_owner(spark):
    live = "token=Zq8vK2mXw91LpR7t"
    other = "token=Hj3nB6cYd48QsF5g"
    rows = [(i, live, "one") for i in range(25)] + [(100, other, "one"), (101, other, "one")]
    got = {r.doc_id: r.findings[0] for r in secrets.scan_secrets(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}
    assert got[0].verdict == "example" and (got[0].n_repos, got[0].n_owners) == (25, 1)
    assert got[100].verdict == "live" and (got[100].n_repos, got[100].n_owners) == (2, 1)


def test_secret_of_many_rows_is_dealt(spark, monkeypatch):
    rows = [(i, "password=Zq8vK2mXw91LpR7t", f"s{i % 2}") for i in range(60)] + [(99, None, "x")]
    frame = spark.createDataFrame(rows, "doc_id long, text string, source string")
    want = sorted(map(str, secrets.scan_secrets(frame).collect()))
    monkeypatch.setattr(secrets, "HOT", 7)
    assert sorted(map(str, secrets.scan_secrets(frame).collect())) == want


def test_rule_labels_reach_unruled_pages(spark):
    """Branches built alike inherit a rule's labels, a small branch that of its host, and nothing goes without labels."""
    kinds = ("shop/item{}", "shop/cart{}", "news/story{}", "login")
    urls_of = lambda host, branch, n: [f"http://{host}/{branch}/{kinds[i % 4].format(i)}" for i in range(n)]
    shop = urls_of("shop.example.com", "de", 40) + urls_of("shop.example.com", "pl", 40) + [f"http://shop.example.com/about/p{i}" for i in range(40)]
    small = [f"http://mini.example.com/de/{i}" for i in range(60)] + ["http://mini.example.com/xx/1"]
    plain = urls_of("other.example.com", "pl", 40)
    rows = spark.createDataFrame(list(enumerate(shop + small + plain)), "page_id long, url string")
    got = urls.filter_urls(rows).collect()
    by = {}
    for r in got:
        by.setdefault((r.host, r.path.split("/")[1]), set()).add((r.rule, r.verdict))
    assert by["shop.example.com", "de"] == {("example.com/de/", "block")} and by["shop.example.com", "pl"] == {(None, "block")}
    assert by["shop.example.com", "about"] == {(None, "allow")} and by["mini.example.com", "xx"] == {(None, "block")} and by["other.example.com", "pl"] == {(None, "allow")}
    assert {r.verdict for r in urls.filter_urls(rows, rules=[]).collect()} == {"allow"}


def test_hot_hosts_are_dealt(spark, monkeypatch):
    rows = [(i, f"http://h.io/{'ab'[i % 2]}/item/{i}") for i in range(120)] + [(500 + i, f"http://h.io/c/{chr(97 + i % 26)}{i // 26}x") for i in range(60)]
    frame = spark.createDataFrame(rows, "page_id long, url string")
    labels = spark.createDataFrame([(i, i % 3 > 0) for i in range(100)], "page_id long, blocked boolean")
    want = sorted(map(tuple, urls.filter_urls(frame, labels=labels).collect()))
    monkeypatch.setattr(urls, "HOT", 5)
    assert sorted(map(tuple, urls.filter_urls(frame, labels=labels).collect())) == want and len(want) == 180


def test_differencing_moves_the_text(spark):
    frame = lambda i: f"<html><body><div>Site name</div><p>Own text number {i}, long enough to be a page</p><div>Call us now</div></body></html>"
    rows = spark.createDataFrame([(i, f"http://h.org/{i}", frame(i)) for i in range(4)], "page_id long, url string, html string")
    on = {r.page_id: r.text for r in pages.extract_pages(rows).collect()}
    off = {r.page_id: r.text for r in pages.extract_pages(rows, copy_share=-1.0).collect()}  # every neighbour is a copy, so that none decides
    assert on == {i: f"Own text number {i}, long enough to be a page" for i in range(4)} and off == {i: f"Site name {t} Call us now" for i, t in on.items()}


def test_first_rows_and_fresh(spark):
    rows = spark.range(0, 1000, 1, 8).select((F.col("id") % 3).alias("g"), "id")
    got = common.first_rows(rows, ["g"], ["id"], 5).collect()
    assert sorted((r.g, r.id) for r in got) == [(g, g + 3 * k) for g in range(3) for k in range(5)]
    assert [r.id for r in common.first_rows(rows, [], ["id"], 4).collect()] == [0, 1, 2, 3]
    assert common.fresh(spark.range(1).withColumn("_KEY", F.lit(1)), "_key") == "_key_"


def test_training_samples_are_bounded_in_bytes(spark):
    rows = [(1, "a b c", "en"), (5, "x " * 1000, "en")]
    got = language.training_rows(spark.createDataFrame(rows, "doc_id long, text string, lang string"), "doc_id", "text", "lang", 9, 100).collect()
    assert [r["_text"] for r in got if len(r["_text"]) > 100] == []
    got = quality.training_rows(spark.createDataFrame(rows, "doc_id long, text string, lang string"), spark.createDataFrame([(1, 1), (5, 0)], "doc_id long, quality int"), "doc_id", "text", "quality", 9, 100)
    assert got == [("a b c", 1)]


NAMES = ("_language", "_hits", "_h", "_i", "_key", "_own", "_text", "_id", "node", "comp", "star", "idx", "language")


@pytest.mark.parametrize("stage", [f for _, f in corpus_pipeline.STAGES[:-1]])
def test_stages_keep_clashing_columns(spark, stage):
    text = "the of and with that these words stand in a text of some length and of no secrets at all number"
    base = [(i, f"{text} {i} " + " ".join(f"w{i}x{j}" for j in range(30)), "en", f"src{i}", 1) for i in range(6)] + [(7, None, None, None, None), (None, "the of and with", "en", None, 3)]
    docs = spark.createDataFrame(base, "doc_id long, text string, lang string, source string, n_chars long")
    extra = docs.select("*", *(F.lit(f"kept {n}").alias(n) for n in NAMES))
    plain, got = (stage(spark, d, "/root/testdata/sf0.001") for d in (docs, extra))
    assert got.columns == extra.columns
    rows = got.collect()
    assert sorted(str(r.doc_id) for r in rows) == sorted(str(r.doc_id) for r in plain.collect()) and rows
    assert all(r[n] == f"kept {n}" for r in rows for n in NAMES)


@pytest.mark.parametrize("stage", [f for _, f in corpus_pipeline.STAGES])
def test_stages_on_an_empty_table(spark, stage):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    assert stage(spark, docs, "/root/testdata/sf0.001").count() == 0
