"""The set join against all pairs."""

import random
import re

import pytest

from lexgrid.llm import entries, setjoin
from lexgrid.llm.common import Scratch
from lexgrid.llm.components import components


def shingles(text, size):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", low)
    if not w:
        return set()
    return {tuple(w[i : i + size]) for i in range(max(1, len(w) - size + 1))}


def brute(rows, size, num, den):
    sets = [shingles(t, size) for _, t in rows]
    top = list(range(len(rows)))

    def find(i):
        while top[i] != i:
            i = top[i]
        return i

    post = {}
    for i, s in enumerate(sets):
        for x in s:
            post.setdefault(x, []).append(i)
    seen = set()
    for own in post.values():
        for k, i in enumerate(own):
            for j in own[:k]:
                if find(i) != find(j) and (j, i) not in seen:
                    seen.add((j, i))
                    inter = len(sets[i] & sets[j])
                    if den * inter >= num * len(sets[i] | sets[j]):
                        top[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(d, least.get(find(i), d))
    return sorted(((d, len(s), least.get(find(i)) if s else d) for i, ((d, _), s) in enumerate(zip(rows, sets, strict=True))), key=str)


def run(spark, rows, *args):
    frame = spark.createDataFrame([(*r, "c") for r in rows], "doc_id long, text string, node string")
    return sorted(((r.doc_id, r.n_shingles, r.component_id) for r in setjoin.jaccard_components(frame, *args).collect()), key=str)


def corpus(seed, n=260):
    rng = random.Random(seed)
    word = lambda: rng.choice("abcdefghij") + rng.choice("klmnop")
    passage = " ".join(word() for _ in range(60))
    base = [[word() for _ in range(rng.choice([2, 5, 12, 40, 80, 120]))] for _ in range(n // 8)]
    rows = [(None, "aa bb cc dd"), (10_000, None), (10_001, ""), (10_002, " \n\t"), (10_003, "One"), (10_004, "one"), (10_005, "one two"), (10_006, "x\x0by  x y"), (7, "aa bb cc dd"), (7, "aa bb cc dd")]
    for i in range(n):
        w = list(rng.choice(base)) if rng.random() < 0.7 else [word() for _ in range(rng.randrange(1, 90))]
        for _ in range(rng.choice([0, 0, 1, 1, 2, 4])):
            w[rng.randrange(len(w))] = word()
        text = " ".join(w)
        rows.append((rng.randrange(5000), text + ("\n" + passage if rng.random() < 0.3 else "")))
    return rows


@pytest.mark.parametrize("seed, size, num, den", [(1, 3, 90, 100), (2, 5, 80, 100), (3, 1, 50, 100)])
def test_against_all_pairs(spark, seed, size, num, den):
    rows = corpus(seed)
    assert run(spark, rows, size, num, den) == brute(rows, size, num, den)


def test_large_near_copy_group(spark):
    rng = random.Random(9)
    base = [f"w{i}" for i in range(100)]
    rows = []
    for i in range(600):
        w = list(base)
        for _ in range(rng.choice([1, 1, 2, 3])):
            w[rng.randrange(100)] = f"z{rng.randrange(1000)}"
        rows.append((i, " ".join(w)))
    assert run(spark, rows, 3, 90, 100) == brute(rows, 3, 90, 100)


def test_no_links_and_empty(spark):
    rows = [(i, f"a{i} b{i} c{i} d{i}") for i in range(20)]
    assert [c for _, _, c in sorted(run(spark, rows))] == list(range(20))
    assert run(spark, [(1, None)]) == [(1, 0, 1)]
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert setjoin.jaccard_components(empty).count() == 0


def test_shuffled_texts_path(spark, monkeypatch):
    monkeypatch.setattr(setjoin, "SMALL", 0)
    rows = corpus(4, 120)
    assert run(spark, rows, 3, 90, 100) == brute(rows, 3, 90, 100)


def test_components(spark):
    chain = [(i, i + 1) for i in range(0, 40)] + [(100, 90), (90, 95), (200, 200)]
    got = {r.node: r.comp for r in components(Scratch(spark), spark.createDataFrame(chain, "a long, b long")).collect()}
    assert all(got[i] == 0 for i in range(41)) and got[100] == got[95] == 90 and 200 not in got


def test_query(spark):
    sf = "/root/testdata/sf0.001"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in entries.op7_ngram_jaccard_join(spark, sf).collect()), key=str)
    assert got == brute(rows, 3, 90, 100)


@pytest.mark.parametrize("size, num, den, changes", [(3, 90, 100, (3, 4, 5)), (5, 80, 100, (3, 4, 5))])
def test_own_changes_meet_nobody(spark, monkeypatch, size, num, den, changes):
    """A group of copies, each with changes of its own, which no star links with: whatever the star changed, hardly a pair is made; a pair far from all others is found."""
    rng = random.Random(size)
    base = [f"w{i}" for i in range(150)]
    rows = []
    for i in range(200):
        w = list(base)
        for at in rng.sample(range(150), rng.choice(changes)):
            w[at] = f"z{i}x{at}"
        rows.append((i, " ".join(w)))
        if i % 40 == 0:
            for at in range(i // 40, 150, 15):
                w[at] = f"y{i}x{at}"
            rows += [(1000 + i, " ".join(w)), (2000 + i, " ".join([*w[:-1], "end"]))]
    made = []
    kind = type(spark.range(1))
    joined = kind.join

    def join(self, other, on=None, how=None):
        out = joined(self, other, on, how)
        if isinstance(on, list) and on == ["hub", "x"] and "rest_a" in self.columns:
            made.append((joined(self, other, on).count(), len(rows)))
        return out

    monkeypatch.setattr(kind, "join", join)
    assert run(spark, rows, size, num, den) == brute(rows, size, num, den)
    assert made and all(n <= 4 * m for n, m in made), made


@pytest.mark.parametrize("n", [100, 200])
def test_outermost_variants_are_of_the_group(spark, monkeypatch, n):
    """Variants of one text, each with five changes of its own, link with nobody, but meet in the rest of their prefixes: they are one star's group, so that hardly a pair of
    blocks is made of them; a linked pair far from all others is found."""
    rng = random.Random(n)
    base = [f"w{i}" for i in range(150)]
    rows = []
    for i in range(n):
        w = list(base)
        for at in range(rng.randrange(30), 150, 30):
            w[at] = f"z{i}x{at}"
        rows.append((i, " ".join(w)))
        if i % 40 == 0:
            rows.append((1000 + i, " ".join([*w[:-1], "end"])))
    made = []
    hot = setjoin.hot_keys

    def hot_keys(scratch, rows, keys, most):
        if keys == "block_a":
            made.append(rows.count())
        return hot(scratch, rows, keys, most)

    monkeypatch.setattr(setjoin, "hot_keys", hot_keys)
    assert run(spark, rows, 5, 80, 100) == brute(rows, 5, 80, 100)
    assert made and all(m <= 4 * len(rows) for m in made), made
