"""Decontamination against brute force over all texts and items."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from lexgrid.llm import entries, leaks

SF = "/root/testdata/sf0.01"


def longest(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(row[j] + 1 if x == y else max(row[j + 1], new[-1]))
        row = new
    return row[-1]


def test_lcs():
    rng = random.Random(1)
    for _ in range(200):
        a, b = ([rng.choice([b"a", b"b", b"c", b"d"]) for _ in range(rng.randrange(1, 20))] for _ in range(2))
        masks = {}
        for i, w in enumerate(a):
            masks[w] = masks.get(w, 0) | 1 << i
        assert leaks.lcs(masks, len(a), b) == longest(a, b)


def test_recall_on_fixture(spark):
    got = {(r.doc_id, r.item_id): r for r in entries.op4_decontamination(spark, SF).collect()}
    docs = [(r.doc_id, leaks.words_of(r.text or "")) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    items = [(r.item_id, leaks.words_of(r.text)) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    rare = {w for _, ws in items for w in ws}
    want = set()
    for i, w in docs:
        at = {}
        for k, x in enumerate(w):
            if x in rare:
                at.setdefault(x, []).append(k)
        for item, ws in items:
            have = [x for x in ws if x in at]
            if len(have) < 0.6 * len(ws):
                continue
            for a in range(0, len(w), 8):
                if sum(x in set(w[a : a + 2 * len(ws)]) for x in set(ws)) >= 0.6 * len(set(ws)) and longest(ws, w[a : a + 2 * len(ws)]) >= 0.75 * len(ws):
                    want.add((i, item))
                    break
    assert want and len(want & got.keys()) >= 0.99 * len(want)
    assert all(r.lcs_share >= 0.45 for r in got.values())


def test_planted_and_odd(spark):
    rng = random.Random(5)
    words = [f"{a}{b}{c}" for a in "bdfgk" for b in "aeiou" for c in ("lm", "rt", "nd", "st")]
    draw = lambda n: [rng.choice(words) + rng.choice(["", "", "a", "e", "ix"]) for _ in range(n)]
    items = [draw(rng.randrange(12, 60)) for _ in range(30)] + [["tiny", "item"]]
    bench = [(k, " ".join(w).capitalize() + ".") for k, w in enumerate(items)] + [(100, None), (101, ""), (102, "!!")]
    rows, exact, near = [], set(), set()
    for i in range(300):
        text = draw(rng.randrange(0, 400))
        if i % 3 == 0:
            k = rng.randrange(30)
            w = list(items[k])
            if i % 2:  # a paraphrase: some words changed, some put in
                for _ in range(len(w) // 6):
                    w[rng.randrange(len(w))] = "zzz"
                w.insert(len(w) // 2, "yyy")
                near.add((i, k))
            else:
                exact.add((i, k))
            at = rng.randrange(len(text) + 1)
            text[at:at] = w
        rows.append((i, ", ".join(text).upper() if i % 6 == 0 else " ".join(text), "c"))
    rows += [(None, " ".join(items[0]), "c"), (900, None, None), (901, "", "c"), (902, "a tiny item here", "c"), (902, "a tiny item here", "c"), (903, "item tiny", "c")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, item_id string")
    pairs = leaks.leak_pairs(docs, spark.createDataFrame(bench, "item_id long, text string")).collect()
    got = {(r.doc_id, r.item_id) for r in pairs}
    assert exact <= got and len(near & got) >= 0.9 * len(near) and (None, 0) in got
    assert [(r.doc_id, r.item_id) for r in pairs].count((902, 30)) == 2 and (903, 30) not in got
    extra = got - exact - near - {(None, 0), (902, 30)}
    assert len(extra) <= 3, extra
    assert leaks.leak_pairs(docs.limit(0), spark.createDataFrame(bench, "item_id long, text string")).count() == 0
    assert leaks.leak_pairs(docs, spark.createDataFrame(bench[-3:], "item_id long, text string")).count() == 0
    kept = leaks.find_leaks(docs, spark.createDataFrame(bench, "item_id long, text string"))
    assert kept.columns == ["doc_id", "text", "item_id", "hits"] and kept.count() == len(rows) and kept.filter(F.size("hits") > 0).count() >= len(exact)


@pytest.mark.parametrize("n", [0, 1, 15, 16, 17, 32, 33, 48, 49, 100])
def test_passages_cover(n):
    import numpy as np

    p = leaks.passages(np.arange(n, dtype=np.int32), 32)
    assert set(p.ravel().tolist()) - {-1} == set(range(n)) and all(0 <= r[0] or n == 0 for r in p)


@pytest.mark.parametrize("seed, n_items, n_docs", [(1, 60, 600), (2, 60, 600), (3, 800, 150)])
def test_recall_at_own_bounds(seed, n_items, n_docs):
    """Items that lose their rarest or commonest words and get others put in, against the check at every place; also with
    ten times as many passages as the latent space has directions."""
    import inspect

    import numpy as np

    rng = random.Random(seed)
    words = ["".join(x) for x in itertools.product("bdfgkmpt", "aeiou", ("lm", "rt", "nd", "st"), ("", "a", "e", "ix"))]
    common = [f"c{i}" for i in range(60)]
    draw = lambda n: [rng.choice(common) if rng.random() < 0.5 else rng.choice(words) for _ in range(n)]
    items = [draw(rng.choice([16, 24, 32, 33, 40, 48, 64])) for _ in range(n_items)]
    docs = []
    for i in range(n_docs):
        text = draw(rng.randrange(20, 300))
        if i % 3:
            w = list(rng.choice(items))
            order = sorted(range(len(w)), key=lambda j: ((w[j] in common) == (i % 3 == 2), rng.random()))
            for j in order[: int(len(w) * rng.uniform(0.25, 0.55))]:
                w[j] = f"zz{rng.randrange(999)}"
            for _ in range(rng.randrange(len(w) // 3)):
                w.insert(rng.randrange(len(w)), f"yy{rng.randrange(999)}")
            at = rng.randrange(len(text) + 1)
            text[at:at] = w
        docs.append(" ".join(text))
    bench = leaks.Benchmark([(k, " ".join(w), None) for k, w in enumerate(items)])
    df = np.zeros(len(bench.vocabulary))
    for d in docs:
        for x in bench.vocabulary.keys() & set(leaks.words_of(d)):
            df[bench.vocabulary[x]] += 1
    idf = np.log((len(docs) + 2) / (df + 1)).astype(np.float32) ** 2
    idf /= idf.max()
    own = [leaks.passages(bench.ids(w), bench.window) for _, w, _ in bench.items]
    all_ = [leaks.passages(bench.ids(leaks.words_of(d)), bench.window) for d in docs]
    gram = lambda q: leaks.own_gram(bench, idf, q.astype(np.float32), all_) + 20 * leaks.own_gram(bench, idf, q.astype(np.float32), own)
    q = np.linalg.qr(gram(np.random.default_rng(1).standard_normal((len(df), 200))))[0]
    b = q.T @ gram(q)
    value, vector = np.linalg.eigh((b + b.T) / 2)
    given = {k: p.default for k, p in inspect.signature(leaks.find_leaks).parameters.items()}
    bounds = {k: given[k] for k in inspect.signature(leaks.LeakFinder).parameters if k in given}
    finder = leaks.LeakFinder(bench, idf, (q @ vector[:, np.argsort(-value)][:, :192]).astype(np.float32), **bounds)
    got = {(i, h["item"]) for i, hits in enumerate(finder.hits(docs)) for h in hits}
    want = {(i, k) for i, d in enumerate(docs) for w in [leaks.words_of(d)] for k in range(len(items)) if any(finder.check(w, at, k, 0.0) for at in range(0, len(w), 16))}
    assert len(want) > n_docs // 3 and got <= want and len(got) >= 0.9 * len(want), (len(got), len(want))


def test_every_row_shapes_the_basis(spark, monkeypatch):
    import numpy as np

    rng = random.Random(8)
    words = [f"w{i}" for i in range(40)]
    draw = lambda n: " ".join(rng.choice(words + ["out", "side"]) for _ in range(n))
    docs = [(i, draw(rng.randrange(1, 90))) for i in range(1300)] + [(1300, None), (1301, "")]
    bench = leaks.Benchmark([(k, draw(30), None) for k in range(8)])
    v = len(bench.vocabulary)
    idf = np.array([rng.uniform(0.1, 1) for _ in range(v)], np.float32)
    want = np.zeros((v, v))
    for weight, all_ in ((1, [leaks.words_of(t or "") for _, t in docs]), (20, [w for _, w, _ in bench.items])):
        for w in all_:
            for p in leaks.passages(bench.ids(w), bench.window):
                a = np.bincount(p[p >= 0], minlength=v) * idf
                want += weight * np.outer(a, a) / max((idf[p[p >= 0]] ** 2).sum(), 1e-9)
    q = np.linalg.qr(np.random.default_rng(3).standard_normal((v, 5)))[0]
    seen = []

    def look(rows, *_):
        seen.extend([rows.count(), leaks.gram_product(rows, bench, idf, np.eye(v), 20.0), leaks.gram_product(rows, bench, idf, q, 20.0, 1.0, leaks.own_inner)])
        return np.zeros((v, 1), np.float32)

    monkeypatch.setattr(leaks, "latent_basis", look)
    frame = spark.createDataFrame(docs, "doc_id long, text string").repartition(16)
    leaks.find_leaks(frame, spark.createDataFrame([(k, b" ".join(w).decode()) for k, w, _ in bench.items], "item_id long, text string"))
    assert seen[0] == len(docs)
    assert np.allclose(seen[1], want, rtol=1e-4, atol=1e-3) and np.allclose(seen[2], q.T @ want @ q, rtol=1e-4, atol=1e-3)


def test_basis_takes_one_pass(spark, monkeypatch):
    """One product with all rows gives a basis that holds as much of the matrix as that of two does."""
    import numpy as np

    rng = random.Random(4)
    words = [f"w{i}" for i in range(300)]
    draw = lambda n: " ".join(rng.choice(words) for _ in range(n))
    texts = [draw(rng.randrange(1, 120)) for _ in range(400)]
    bench = leaks.Benchmark([(k, draw(40), None) for k in range(30)])
    v = len(bench.vocabulary)
    idf = np.array([rng.uniform(0.05, 1) ** 2 for _ in range(v)], np.float32)
    own = [leaks.passages(bench.ids(w), bench.window) for _, w, _ in bench.items]
    all_ = [leaks.passages(bench.ids(leaks.words_of(t)), bench.window) for t in texts]
    gram = lambda q: leaks.own_gram(bench, idf, q.astype(np.float32), all_) * 0.5 + 20 * leaks.own_gram(bench, idf, q.astype(np.float32), own)
    product, calls = leaks.gram_product, []
    monkeypatch.setattr(leaks, "gram_product", lambda *a: (calls.append(1), product(*a))[1])
    rows = spark.createDataFrame([(bytearray(bench.ids(leaks.words_of(t)).tobytes()),) for t in texts], "ids binary")
    basis = leaks.latent_basis(rows, bench, idf, 40, 0.5)
    assert len(calls) == 1 and basis.shape == (v, 40) and np.allclose(basis.T @ basis, np.eye(40), atol=1e-4)
    q = np.linalg.qr(gram(np.linalg.qr(np.random.default_rng(11).standard_normal((v, 48)))[0]))[0]
    b = q.T @ gram(q)
    two = np.sort(np.linalg.eigvalsh((b + b.T) / 2))[::-1][:40].sum()
    assert np.trace(basis.T @ gram(basis)) >= 0.97 * two


def test_halves_are_summed_once(monkeypatch):
    import numpy as np

    bench = leaks.Benchmark([(0, " ".join(f"w{i}" for i in range(40)), None)])
    v = len(bench.vocabulary)
    finder = leaks.LeakFinder(bench, np.ones(v, np.float32), np.eye(v, dtype=np.float32), 0.35, 0.6, 0.45, 0.6, 0.15)
    read, rows = [], leaks._rows
    monkeypatch.setattr(leaks, "_rows", lambda ids, table: (read.append(ids.size), rows(ids, table))[1])
    text = " ".join(["w1 w2"] * 500 + [f"w{i}" for i in range(40)] + ["none"] * 3)
    assert [h["start"] for h in finder.hits(["", text, "w3"])[1]] and sum(read) <= 1.1 * len(text.split()) + 64
