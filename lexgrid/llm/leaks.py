"""Benchmark decontamination by latent semantic retrieval."""

from __future__ import annotations

import zlib
from itertools import repeat

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexgrid.llm.common import Scratch, add_column, map_rows, reduce_rows, texts

#: ASCII other than letters and digits parts words; other characters belong to them.
_PART = bytes(b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
#: Passages of items that windows are compared with at once, so that a task's memory doesn't grow with their number.
QUERIES = 4096
#: Rows that the corpus weighs as much as, whatever its size, beside the items' passages in the SVD; all rows are in it.
WEIGHS = 1000
HIT = "item:long,start:int,cosine:double,lcs:double,answer:double,kind:string"


def words_of(text: str) -> list[bytes]:
    return text.lower().encode("utf-8", "replace").translate(_PART).split()


class Benchmark:
    """The items' words as ids of their own vocabulary, which grows with the benchmark alone."""

    def __init__(self, items: list[tuple[int, str, str | None]], window: int = 32):
        self.items = [(i, w, words_of(a or "")) for i, t, a in items if (w := words_of(t or ""))]
        self.vocabulary = {w: k for k, w in enumerate(sorted({w for _, ws, _ in self.items for w in ws}))}
        self.window = window

    def ids(self, words: list[bytes]) -> np.ndarray:
        get = self.vocabulary.get
        return np.fromiter(map(get, words, repeat(-1)), np.int32, len(words))


def halved(ids: np.ndarray, window: int) -> np.ndarray:
    """(passages + 1, window // 2) ids; a passage is a half and the next, and -1 fills the last."""
    half = window // 2
    n = max(1, -(-(len(ids) - half) // half)) if len(ids) > half else 1
    flat = np.full((n + 1) * half, -1, np.int32)
    flat[: len(ids)] = ids
    return flat.reshape(-1, half)


def passages(ids: np.ndarray, window: int) -> np.ndarray:
    """(passages, window) ids of overlapping windows by half a window; -1 fills the last."""
    halves = halved(ids, window)
    return np.concatenate((halves[:-1], halves[1:]), axis=1)


def _rows(ids: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Sums of the table's rows over each passage; the table's last row is for -1."""
    return np.concatenate([table[ids[i : i + 512]].sum(1) for i in range(0, len(ids), 512)]) if len(ids) else np.zeros((0, table.shape[1]), np.float32)


def _blocks(passage_ids, most: int = 64):
    """The passages in blocks of so many rows, whatever texts they're of."""
    held, n = [], 0
    for p in passage_ids:
        held.append(p)
        n += len(p)
        if n >= most:
            p = np.vstack(held)
            yield from (p[i : i + most] for i in range(0, n - n % most, most))
            held, n = [p[n - n % most :]], n % most
    if n:
        yield np.vstack(held)


def _projected(idf: np.ndarray, basis: np.ndarray, passage_ids):
    """Of each block of passages its terms, how often each passage has them, (a . basis) of the passages a and their squared lengths."""
    table = np.vstack([basis * idf[:, None], np.zeros((1, basis.shape[1]))]).astype(np.float32)
    squares = np.append(idf**2, 0).astype(np.float32)[:, None]
    there, place = np.zeros(len(table), bool), np.zeros(len(table), np.int64)
    for p in _blocks(passage_ids):
        there[:] = False
        there[p] = True
        terms = np.flatnonzero(there)
        place[terms] = np.arange(len(terms))
        cells = place[p] + np.arange(len(p))[:, None] * len(terms)
        counts = np.bincount(cells.ravel(), minlength=len(p) * len(terms)).reshape(len(p), len(terms)).astype(np.float32)
        yield terms, counts, counts @ table[terms], np.maximum(counts @ squares[terms], 1e-9)


def own_gram(bench: Benchmark, idf: np.ndarray, basis: np.ndarray, passage_ids) -> np.ndarray:
    """Sum over passages a, of unit length, of a (a . basis)."""
    out = np.zeros((len(bench.vocabulary) + 1, basis.shape[1]))
    for terms, counts, y, square in _projected(idf, basis, passage_ids):
        out[terms] += counts.T @ (y / square)  # row -1 gathers what isn't in the vocabulary
    return out[:-1] * idf[:, None]


def own_inner(bench: Benchmark, idf: np.ndarray, basis: np.ndarray, passage_ids) -> np.ndarray:
    """The basis times :func:`own_gram`, (k, k) alone: sum over passages a, of unit length, of (a . basis) (a . basis)."""
    out = np.zeros((basis.shape[1], basis.shape[1]))
    for _, _, y, square in _projected(idf, basis, passage_ids):
        out += y.T @ (y / square)
    return out


def gram_product(rows: DataFrame, bench: Benchmark, idf: np.ndarray, basis: np.ndarray, weight: float, share: float = 1.0, step=own_gram) -> np.ndarray:
    """One step of the randomised SVD over the ids of all ``rows``: each task adds up its own rows' part; the items' own
    passages count ``weight`` times, a row's ``share`` times."""
    k = basis.shape[1]
    data = zlib.compress(basis.astype(np.float32).tobytes(), 1)

    def add(batches):
        own = np.frombuffer(zlib.decompress(data), np.float32).reshape(-1, k)
        out = step(bench, idf, own, (passages(np.frombuffer(x, np.int32), bench.window) for (ids,) in batches for x in ids))
        terms = np.flatnonzero(out.any(1))
        return [terms.tolist(), [out[t].tolist() for t in terms]]

    # few parts for each core, so that what is shuffled doesn't grow with the rows
    rows = rows.coalesce(4 * rows.sparkSession.sparkContext.defaultParallelism)
    summed = reduce_rows(rows, "term int, v array<double>", add).groupBy("term").agg(F.array(*(F.sum(F.col("v")[i]) for i in range(k))).alias("v")).collect()
    out = weight * step(bench, idf, basis.astype(np.float32), [passages(bench.ids(w), bench.window) for _, w, _ in bench.items])
    for r in summed:
        out[r["term"]] += share * np.array(r["v"])
    return out


def latent_basis(rows: DataFrame, bench: Benchmark, idf: np.ndarray, rank: int, share: float, weight: float = 20.0, seed: int = 11, power: int = 1) -> np.ndarray:
    """The leading right singular vectors of the TF-IDF passage matrix: a random
    start, ``power`` products with the distributed matrix, and the singular vectors of its Nystroem form."""
    v = len(bench.vocabulary)
    k = min(v, rank + 8)
    q = np.linalg.qr(np.random.default_rng(seed).standard_normal((v, k)))[0]
    for _ in range(power - 1):
        q = np.linalg.qr(gram_product(rows, bench, idf, q, weight, share))[0]
    y = gram_product(rows, bench, idf, q, weight, share)
    # as the matrix is positive semi-definite, y (q . y)^-1 y^T stands for it, and no second product is needed
    inner = q.T @ y
    value, vector = np.linalg.eigh((inner + inner.T) / 2)
    some = value > 1e-6 * max(float(value.max(initial=0)), 1e-30)
    left = np.linalg.svd(y @ (vector[:, some] / np.sqrt(value[some])), full_matrices=False)[0]
    return left[:, :rank].astype(np.float32)


def lcs(a_masks: dict[bytes, int], n: int, b: list[bytes]) -> int:
    """Length of a longest common subsequence of an item of n words and ``b``, in bits."""
    s = full = (1 << n) - 1
    for w in b:
        if m := a_masks.get(w):
            u = s & m
            s = ((s + u) | (s - u)) & full
    return n - s.bit_count()


class LeakFinder:
    """Candidates by cosine in the latent space, if a window has at least ``held`` of the item's
    length along the item, then the checks on words."""

    def __init__(self, bench: Benchmark, idf: np.ndarray, basis: np.ndarray, cosine: float, share: float, loose: float, answer: float, held: float):
        self.held = held
        self.bench, self.cosine, self.share, self.loose, self.answer = bench, cosine, share, loose, answer
        self.idf = np.append(idf, 0).astype(np.float32)
        self.table = np.vstack([basis * idf[:, None], np.zeros((1, basis.shape[1]), np.float32)]).astype(np.float32)
        self.queries, self.owner, mass = [], [], []
        self.checks = []
        for k, (item, words, answers) in enumerate(bench.items):
            ids = bench.ids(words)
            own = passages(ids, bench.window)
            self.queries.append(_rows(own, self.table))
            self.owner += [k] * len(own)
            mass.append(self.idf[own].sum(1).max())
            masks: dict[bytes, int] = {}
            for i, w in enumerate(words):
                masks[w] = masks.get(w, 0) | 1 << i
            if not answers:  # the rarest third of the item's words
                answers = sorted(set(words), key=lambda w: (-self.idf[bench.vocabulary[w]], w))[: max(1, len(set(words)) // 3)]
            self.checks.append((item, len(words), masks, frozenset(answers)))
        self.queries = np.vstack(self.queries) if self.queries else np.zeros((0, basis.shape[1]), np.float32)
        norm = np.maximum(np.linalg.norm(self.queries, axis=1, keepdims=True), 1e-9)
        self.queries /= norm
        self.floor = (self.held * norm.T).astype(np.float32)  # of a window's length along the item
        self.owner = np.array(self.owner)
        # a window with less than this much of the items' words isn't searched
        self.least = held * loose * min(mass, default=0)

    def hits(self, texts: list[str], most: int = 2_000_000) -> list[list[dict]]:
        """Of each text; so many characters, or one text, are held as words at once."""
        out: list[list[dict]] = []
        while len(out) < len(texts):
            i = j = len(out)
            n = 0
            while j < len(texts) and (j == i or n + len(texts[j]) <= most):
                n += len(texts[j])
                j += 1
            out += self._hits(texts[i:j])
        return out

    def _hits(self, texts: list[str]) -> list[list[dict]]:
        out: list[list[dict]] = [[] for _ in texts]
        if not len(self.queries):
            return out
        words = [words_of(t) for t in texts]
        parts = [halved(self.bench.ids(w), self.bench.window) for w in words if w]
        if not parts:
            return out
        each = np.array([len(p) - 1 for p in parts])
        docs = np.repeat([d for d, w in enumerate(words) if w], each)
        starts = (np.arange(len(docs)) - np.repeat(np.cumsum(each) - each, each)) * (self.bench.window // 2)
        halves = np.concatenate(parts)
        first = np.arange(len(docs)) + np.repeat(np.arange(len(parts)), each)  # a passage is this half and the next
        mass = self.idf[halves].sum(1)
        at = np.flatnonzero(mass[first] + mass[first + 1] >= self.least)
        docs, starts, first = docs[at], starts[at], first[at]
        best: dict[tuple[int, int], dict] = {}
        for i in range(0, len(docs), 4096):
            own = first[i : i + 4096]
            both = np.union1d(own, own + 1)  # each half is summed once, for both of its passages
            sums = _rows(halves[both], self.table)
            x = sums[np.searchsorted(both, own)] + sums[np.searchsorted(both, own + 1)]
            norm = np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)
            for j in range(0, len(self.queries), QUERIES):
                along = x @ self.queries[j : j + QUERIES].T
                at = np.flatnonzero((along >= self.cosine * norm) & (along >= self.floor[:, j : j + QUERIES]))
                for r, q in zip(*divmod(at, along.shape[1]), strict=True):
                    d, k = int(docs[i + r]), int(self.owner[j + q])
                    hit = self.check(words[d], int(starts[i + r]), k, float(along[r, q] / norm[r, 0]))
                    if hit and (best.get((d, k)) is None or hit["lcs"] > best[d, k]["lcs"]):
                        best[d, k] = hit
        for (d, _), hit in sorted(best.items()):
            out[d].append(hit)
        return out

    def check(self, words: list[bytes], start: int, k: int, cosine: float) -> dict | None:
        item, n, masks, answers = self.checks[k]
        a = max(0, start - n)
        region = words[a : start + self.bench.window + n]
        common = masks.keys() & set(region)
        if sum(masks[w].bit_count() for w in common) < min(self.loose, self.share) * n:
            return None
        share = lcs(masks, n, region) / n
        there = answers.intersection(region)
        answer = len(there) / len(answers)
        if share >= (self.share if n >= 8 else 1.0):
            kind = "copy"
        elif n >= 8 and share >= self.loose and answer >= self.answer:
            kind = "paraphrase"
        else:
            return None
        first = next(i for i, w in enumerate(region) if w in masks)
        return {"item": item, "start": a + first, "cosine": cosine, "lcs": share, "answer": answer, "kind": kind}


def make_finder(docs: DataFrame, benchmark: DataFrame, id_col: str, text_col: str, item_col: str, item_text: str, answer_col: str | None, rank: int, window: int, cosine: float, share: float, loose: float, answer: float, held: float) -> LeakFinder:
    columns = [F.col(item_col).cast("long"), F.col(item_text), F.col(answer_col) if answer_col else F.lit(None).cast("string")]
    bench = Benchmark(sorted(((r[0], r[1], r[2]) for r in benchmark.select(*columns).distinct().collect()), key=str), window)
    n_terms = len(bench.vocabulary)
    if not n_terms:
        return LeakFinder(bench, np.zeros(0, np.float32), np.zeros((0, 1), np.float32), cosine, share, loose, answer, held)
    scratch = Scratch(docs.sparkSession)
    rows = scratch.keep(map_rows(texts(docs, id_col, text_col).select("_text"), "ids binary", lambda: lambda text: [[bench.ids(words_of(t)).tobytes() for t in text]]))

    def count(batches):
        df, n = np.zeros(n_terms + 1, np.int64), 0  # the last is for what isn't in the vocabulary
        for (ids,) in batches:
            n += len(ids)
            for x in ids:
                df[np.unique(np.frombuffer(x, np.int32))] += 1
        terms = np.flatnonzero(df[:-1])
        return [[-1, *terms.tolist()], [n, *df[terms].tolist()]]

    counted = {r["term"]: r["n"] for r in reduce_rows(rows, "term int, n long", count).groupBy("term").agg(F.sum("n").alias("n")).collect()}
    n_docs = counted.pop(-1, 0)
    df = np.zeros(n_terms)
    for t, n in counted.items():
        df[t] = n
    idf = np.log((n_docs + 2) / (df + 1)).astype(np.float32) ** 2  # squared, so that rare words tell passages apart
    idf /= max(float(idf.max(initial=0)), 1e-9)
    basis = latent_basis(rows, bench, idf, rank, min(1.0, WEIGHS / max(n_docs, 1)))
    scratch.drop(rows)
    return LeakFinder(bench, idf, basis, cosine, share, loose, answer, held)


def find_leaks(
    docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", answer_col: str | None = None,
    rank: int = 192, window: int = 32, cosine: float = 0.35, share: float = 0.6, loose: float = 0.45, answer: float = 0.6, held: float = 0.15, name: str = "hits",
) -> DataFrame:
    """``docs`` with one more column: for each benchmark item that a row's text holds, the item, the first
    word, the cosine, the share of the item's words in a longest common subsequence, the share of its answer's words, and
    ``copy`` (at least ``share`` of the item in order) or ``paraphrase`` (at least ``loose``, and ``answer``).

    The document frequencies of the benchmark's words come from all rows, as do the singular vectors of the TF-IDF
    passages: a distributed randomised SVD of the passages of every row, which weigh as much as ``WEIGHS`` rows together, and of the items, weighed more. Every window of every text is then searched against all items, without a cap on
    candidates: checked is what has ``cosine`` with a passage of an item and ``held`` of its length along it, in a window with
    ``held`` * ``loose`` of the smallest item's weight. Recall at ``share`` and ``loose`` against brute force is tested. What is broadcast grows with the benchmark alone.

    Without an answer column the answer is the rarest third of an item's words. Items under 8 words must
    be there whole; items without words never match. Null and empty texts have no hits; repeated rows have
    theirs each; equal items each match; empty tables give no hits; other columns pass as they are."""
    finder = make_finder(docs, benchmark, id_col, text_col, item_col, item_text, answer_col, rank, window, cosine, share, loose, answer, held)

    def start():
        return lambda text: finder.hits([t or "" for t in text])

    return add_column(docs, [text_col], name, f"array<struct<{HIT}>>", start)


def leak_pairs(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """(id, item_id, start_word, cosine, lcs_share, answer_share, kind), a row for each text and item that leaks."""
    own = docs.select(F.col(id_col), F.col(text_col).alias("_text"))
    found = find_leaks(own, benchmark, id_col, "_text", name="_hits", **options).select(id_col, F.explode("_hits").alias("h"))
    r = lambda c: F.round(F.col(f"h.{c}"), 6)
    return found.select(id_col, F.col("h.item").alias("item_id"), F.col("h.start").alias("start_word"), r("cosine").alias("cosine"), r("lcs").alias("lcs_share"), r("answer").alias("answer_share"), F.col("h.kind").alias("kind"))
