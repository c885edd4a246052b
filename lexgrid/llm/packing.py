"""Best-fit packing by a configuration linear program over the length histogram."""

from __future__ import annotations

import zlib
from itertools import chain, repeat

import numpy as np
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexgrid.llm.common import Scratch, indexed, map_rows, texts, warm
from lexgrid.llm.tokens import PLAIN

#: Words and pieces whose ids a worker remembers; past this it forgets those that it met in one lookup alone.
MEMORY = 600_000
#: Fixed value: the splitting pattern of the vocabulary, on lower-cased words.
PATTERN = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")


_MARKS = ".,;:!?"
#: The characters of PLAIN below 256, as bytes.
_LATIN = bytes(b for b in range(256) if PLAIN.fullmatch(chr(b)))


def plain(text: str) -> bool:
    """Whether PLAIN matches it; of Latin-1 texts the bytes tell, faster."""
    try:
        return not text.encode("latin-1").translate(None, _LATIN)
    except UnicodeEncodeError:
        return PLAIN.fullmatch(text) is not None


class WordEncoder:
    """Token ids by the library, which sees each distinct piece of a word once. White space always
    parts tokens of this vocabulary, so a text's ids are its words' ids; texts with characters whose
    class or case depends on context or Unicode version are given to the library whole, as
    are words that hold a special token."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.specials = [t.content for t in self.library.get_added_tokens_decoder().values()]
        vocabulary = self.library.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)  # ids that end a piece
        self.ends[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True
        self.mark = {m: self.library.encode(m, add_special_tokens=False).ids[0] for m in _MARKS}
        self._clear()

    def _forget(self) -> None:
        """All but words that were looked up again since the last time, half of MEMORY at most."""
        again = np.flatnonzero(self.hit[: len(self.known)])[: MEMORY // 2]
        words = list(self.known)
        flat, sizes = self._gather(again)
        self._clear()
        self._add(flat, sizes, [words[i] for i in again.tolist()])

    def _clear(self) -> None:
        self.known: dict[str, int] = {}
        self.start, self.size, self.hit = np.zeros(1024, np.int64), np.zeros(1024, np.int64), np.zeros(1024, bool)
        self.pool, self.used = np.zeros(4096, np.uint32), 0

    def _gather(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of these entries in a row, and how many each has."""
        size = self.size[at]
        ends = np.cumsum(size)
        return self.pool[np.repeat(self.start[at] - (ends - size), size) + np.arange(int(ends[-1]) if len(ends) else 0)], size

    def _learn(self, words: list[str]) -> None:
        """Words of letters alone are pieces, so their ids are those of all in one go, parted after
        each end; a word with one mark behind it has the word's ids and the mark's; any other has its pieces'."""
        marked, rest, whole, plain, others = [], [], [], {}, {}
        pieces: list[list[str]] = []
        for w in words:
            if w.isalpha():
                plain[w] = None
            elif w[-1] in _MARKS and w[:-1].isalpha():
                marked.append(w)
                plain[w[:-1]] = None
            elif any(s in w for s in self.specials):
                whole.append(w)
            else:
                own = PATTERN.findall(w.replace("Σ", "σ").lower())
                for p in own:
                    (plain if p.isalpha() else others)[p] = None
                if own != [w]:
                    rest.append(w)
                    pieces.append(own)
        known = self.known
        new = [w for w in plain if w not in known]
        for a in range(0, len(new), 5000):
            some = new[a : a + 5000]
            flat = np.array(self.library.encode_batch_fast([" ".join(some)], add_special_tokens=False)[0].ids, np.uint32)
            last = np.flatnonzero(self.ends[flat]) + 1
            if len(last) == len(some):
                self._add(flat, np.diff(last, prepend=0), some)
            else:  # a word that isn't a piece after all
                self._each(some)
        if marked:
            at = np.fromiter((known[w[:-1]] for w in marked), np.int64, len(marked))
            sizes = self.size[at] + 1
            ends = np.cumsum(sizes)
            flat = self.pool[np.minimum(np.repeat(self.start[at] - (ends - sizes), sizes) + np.arange(int(ends[-1])), len(self.pool) - 1)]
            flat[ends - 1] = [self.mark[w[-1]] for w in marked]
            self._add(flat, sizes, marked)
        self._each([w for w in chain(others, whole) if w not in known])
        if rest:
            flat, sizes = self._gather(np.fromiter(map(known.__getitem__, chain.from_iterable(pieces)), np.int64))
            ends = np.concatenate([[0], np.cumsum(sizes)])[np.cumsum([len(own) for own in pieces])]
            self._add(flat, np.diff(ends, prepend=0), rest)

    def _each(self, words: list[str]) -> None:
        ids = [self.library.encode(w, add_special_tokens=False).ids for w in words]
        sizes = np.fromiter(map(len, ids), np.int64, len(ids))
        self._add(np.fromiter(chain.from_iterable(ids), np.uint32, int(sizes.sum())), sizes, words)

    def _add(self, flat: np.ndarray, sizes: np.ndarray, words: list[str]) -> None:
        n, top = len(self.known), self.used + len(flat)
        if n + len(words) > len(self.start):
            grow = np.zeros(n + 2 * len(words), np.int64)
            self.start, self.size, self.hit = np.append(self.start, grow), np.append(self.size, grow), np.append(self.hit, grow > 0)
        if top > len(self.pool):
            self.pool = np.append(self.pool, np.zeros(top, np.uint32))
        self.start[n : n + len(words)] = self.used + np.cumsum(sizes) - sizes
        self.size[n : n + len(words)] = sizes
        self.pool[self.used : top] = flat
        self.used = top
        self.known.update(zip(words, range(n, n + len(words)), strict=True))

    def ids(self, texts: list[str]) -> list[np.ndarray]:
        out: list[np.ndarray] = [None] * len(texts)
        i = 0
        while i < len(texts):  # some hundred thousand words at once
            own, words, counts = [], [], []
            while i < len(texts) and (not own or len(words) < 100_000):
                if plain(texts[i]):
                    w = (texts[i] if "<|" in texts[i] or "Σ" in texts[i] else texts[i].lower()).split()
                    own.append(i)
                    words += w
                    counts.append(len(w))
                else:
                    out[i] = np.array(self.library.encode(texts[i], add_special_tokens=False).ids, np.uint32)
                i += 1
            if len(self.known) > MEMORY:
                self._forget()
            known = self.known
            at = np.fromiter(map(known.get, words, repeat(-1)), np.int64, len(words))
            self.hit[at[at >= 0]] = True
            if len(new := np.flatnonzero(at < 0)):
                missed = [words[k] for k in new.tolist()]
                self._learn(list(dict.fromkeys(missed)))
                at[new] = np.fromiter(map(known.__getitem__, missed), np.int64, len(missed))
            flat, size = self._gather(at)
            ends = np.cumsum(size)
            last = np.concatenate([[0], ends])[np.cumsum(counts, dtype=np.int64)] if own else []
            first = 0
            for k, b in zip(own, last, strict=True):
                out[k] = flat[first:b]
                first = int(b)
        return out


def cut_pieces(docs: DataFrame, path: str, capacity: int = 2048, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """(id, piece, start, length, ids_crc32[, ids]) of every piece of every row: the text's ids and
    then ``end_id``, cut only where longer than ``capacity``. Null and empty texts are the end id alone."""
    kind = dict(docs.dtypes)[id_col]

    def start():
        own = warm(f"encoder {path}", lambda: WordEncoder(path))

        def step(keys, text):
            out: list[list] = [[], [], [], [], []]
            raws = []
            for key, ids in zip(keys, own.ids(text), strict=True):
                ids = np.append(ids, np.uint32(end_id)).astype("<u4")
                for piece, a in enumerate(range(0, len(ids), capacity)):
                    raw = ids[a : a + capacity].tobytes()
                    for column, value in zip(out, (key, piece, a, len(raw) // 4, zlib.crc32(raw)), strict=True):
                        column.append(value)
                    if with_ids:
                        raws.append(ids[a : a + capacity].tolist())
            return [*out, raws] if with_ids else out

        return step

    ddl = f"`{id_col}` {kind}, piece int, start long, length long, ids_crc32 long" + ", ids array<long>" * with_ids
    return map_rows(texts(docs, id_col, text_col), ddl, start, keep=True)


def knapsack(weights: np.ndarray, capacity: int) -> dict[int, int]:
    """The most valuable pattern, as lengths and how often each; any length any number of times."""
    best = np.zeros(capacity + 1)
    pick = np.zeros(capacity + 1, np.int64)
    for c in range(1, capacity + 1):
        value = weights[1 : c + 1] + best[c - 1 :: -1] if c < capacity else weights[1:] + best[-2::-1]
        k = int(value.argmax())
        if value[k] > best[c - 1]:
            best[c], pick[c] = value[k], k + 1
        else:
            best[c] = best[c - 1]
    pattern: dict[int, int] = {}
    c = capacity
    while c > 0:
        if pick[c]:
            pattern[int(pick[c])] = pattern.get(int(pick[c]), 0) + 1
            c -= int(pick[c])
        else:
            c -= 1
    return pattern


def bounded_knapsack(weights: np.ndarray, counts: np.ndarray, capacity: int) -> dict[int, int]:
    """The same with no more of a length than there are, by doubling bundles."""
    bundles = []
    for length in np.flatnonzero(counts):
        left, k = min(int(counts[length]), capacity // int(length)), 1
        while left > 0:
            take = min(k, left)
            bundles.append((int(length), take))
            left, k = left - take, 2 * k
    best = np.zeros(capacity + 1)
    used = np.zeros((len(bundles), capacity + 1), bool)
    for b, (length, take) in enumerate(bundles):
        size = length * take
        value = best[: capacity + 1 - size] + weights[length] * take
        better = value > best[size:]
        best[size:][better] = value[better]
        used[b, size:] = better
    pattern: dict[int, int] = {}
    c = int(best.argmax())
    for b in range(len(bundles) - 1, -1, -1):
        if used[b, c]:
            length, take = bundles[b]
            pattern[length] = pattern.get(length, 0) + take
            c -= length * take
    return pattern


def configuration_lp(counts: np.ndarray, capacity: int, rounds: int = 120, rate: float = 0.15) -> list[tuple[dict[int, int], float]]:
    """Patterns and how often to use each, fractionally, by multiplicative weights: price a
    pattern, use it for a share of what its scarcest length allows, and lower the weights of
    the lengths that it covers. A weight begins at its length's share of the capacity."""
    present = np.flatnonzero(counts)
    need = counts.astype(float)
    covered = np.zeros(capacity + 1)
    share = np.arange(capacity + 1) / capacity
    found: dict[tuple, float] = {}
    for _ in range(rounds):
        weights = np.full(capacity + 1, -1.0)
        over = np.clip(covered[present] / need[present], 0, 30)
        weights[present] = share[present] ** 1.02 * np.exp(-rate * over)
        pattern = knapsack(weights, capacity)
        if not pattern:
            break
        step = min(need[n] / a for n, a in pattern.items())
        for n, a in pattern.items():
            covered[n] += a * step
        key = tuple(sorted(pattern.items()))
        found[key] = found.get(key, 0.0) + step
    wanted, total = (counts * np.arange(capacity + 1)).sum(), sum(sum(n * a for n, a in k) * x for k, x in found.items())
    scale = min(1.0, wanted / total) if total else 0.0
    return [(dict(k), x * scale) for k, x in sorted(found.items(), key=lambda kx: (-kx[1], kx[0]))]


def plan_bins(histogram: dict[int, int], capacity: int) -> list[tuple[dict[int, int], int]]:
    """Patterns with whole numbers of uses that hold every piece once: the LP's, rounded down, then
    what is left by patterns priced on what is left. Its size depends on the capacity, not on the number of pieces."""
    counts = np.zeros(capacity + 1, np.int64)
    for length, n in histogram.items():
        counts[length] = n
    plan: list[tuple[dict[int, int], int]] = []

    def use(pattern: dict[int, int], most: float) -> int:
        n = int(min([most, *(counts[k] // a for k, a in pattern.items())]))
        if n > 0:
            plan.append((pattern, n))
            for k, a in pattern.items():
                counts[k] -= a * n
        return n

    if counts[capacity]:
        use({capacity: 1}, np.inf)
    if counts.any():
        for pattern, x in configuration_lp(counts, capacity):
            use(pattern, np.floor(x))
    share = (np.arange(capacity + 1) / capacity) ** 1.02
    while counts.any():  # the longest piece that is left, and what fills its sequence best
        longest = int(np.flatnonzero(counts)[-1])
        counts[longest] -= 1
        room = capacity - longest
        pattern = bounded_knapsack(share, np.minimum(counts[: room + 1], capacity), room) if counts[: room + 1].any() else {}
        counts[longest] += 1
        pattern[longest] = pattern.get(longest, 0) + 1
        use(pattern, np.inf)
    return plan


class Slots:
    """Where the piece of a length and a rank among its equals goes."""

    def __init__(self, plan: list[tuple[dict[int, int], int]], capacity: int):
        runs: dict[int, list[tuple[int, int, int, int, int]]] = {}
        given = np.zeros(capacity + 1, np.int64)
        first = 0
        for pattern, n in plan:
            offset = 0
            for length, a in sorted(pattern.items(), reverse=True):
                runs.setdefault(length, []).append((int(given[length]), first, a, offset, n))
                given[length] += a * n
                offset += length * a
            first += n
        self.n_bins = first
        self.runs = {k: np.array(v, np.int64) for k, v in runs.items()}

    def place(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        bins, offsets = np.zeros(len(length), np.int64), np.zeros(len(length), np.int64)
        for n in np.unique(length):
            own = np.flatnonzero(length == n)
            runs = self.runs[int(n)]
            r = runs[np.searchsorted(runs[:, 0], rank[own], side="right") - 1]
            k = rank[own] - r[:, 0]
            bins[own] = r[:, 1] + k // r[:, 2]
            offsets[own] = r[:, 3] + k % r[:, 2] * n
        return bins, offsets


def pack_pieces(pieces: DataFrame, keys: tuple[str, ...], capacity: int = 2048, scratch: Scratch | None = None) -> DataFrame:
    """``pieces`` with sequence_id and offset. ``pieces`` must have a ``length`` from 1 to the
    capacity, and is read twice, so it should be a written table. The driver sees the length
    histogram alone; ranks among equal lengths come from a range partitioning by length and
    keys, so that a length of any share of the rows is dealt evenly."""
    scratch = scratch or Scratch(pieces.sparkSession)
    histogram = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}
    slots = Slots(plan_bins(histogram, capacity), capacity)
    before, total = {}, 0
    for length in sorted(histogram):
        before[length] = total
        total += histogram[length]
    ranked = indexed(scratch, pieces, "length", *keys)
    names = [c for c in pieces.columns]
    kinds = dict(pieces.dtypes)

    def start():
        first = np.zeros(capacity + 1, np.int64)
        for length, n in before.items():
            first[length] = n
        at = names.index("length")

        def step(*columns):
            length = np.array(columns[at], np.int64)
            bins, offsets = slots.place(length, np.array(columns[-1], np.int64) - first[length])
            return [*columns[:-1], bins.tolist(), offsets.tolist()]

        return step

    ddl = ", ".join(f"`{c}` {kinds[c]}" for c in names) + ", sequence_id long, offset long"
    return map_rows(ranked.select(*names, "idx"), ddl, start)


def pack_documents(docs: DataFrame, path: str, capacity: int = 2048, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, piece, start, length, ids_crc32, sequence_id, offset) of every piece of every row.

    Null and empty texts are one piece of the end id; texts of any length are cut into
    pieces of ``capacity``, none dropped; repeated rows are packed each; ties of length, id
    and piece are placed in the order of their ids' checksum, and equal pieces are alike; an empty table gives an empty result; other columns
    are ignored. Sequence ids are 0, 1, ... and offsets in a sequence have no gaps."""
    scratch = Scratch(docs.sparkSession)
    pieces = scratch.keep(cut_pieces(docs, path, capacity, end_id, id_col, text_col))
    return pack_pieces(pieces, (id_col, "piece", "ids_crc32"), capacity, scratch)
