"""Token counts by heap-and-linked-list byte-pair merging."""

from __future__ import annotations

import heapq
import json
from collections import Counter

import regex
from pyspark.sql import DataFrame

from lexgrid.llm.common import map_rows, texts

#: Fixed value: the byte-level splitting pattern of the vocabulary.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Characters whose classes no Unicode version disputes; other texts are split by the library.
PLAIN = regex.compile(r"[\t-\r -~¡-ɏΑ-ΡΣ-ώА-я–—‘’“”…€ぁ-ゖァ-ヺ一-龥가-힣]*")
#: Words whose counts a worker remembers; past this it forgets them and counts anew.
MEMORY = 300_000
_GAPS = [" " + c for c in " \t\n\v\f\r"] + [c + " " for c in "\t\n\v\f\r"]


def byte_symbols() -> list[str]:
    """The printable stand-in of each byte: itself if printable, else the next free code point from 256."""
    own = {*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)}
    rest = iter(range(256, 512))
    return [chr(b if b in own else next(rest)) for b in range(256)]


class MergeCounter:
    """Counts tokens of one vocabulary file: initial symbols minus merges."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        pairs = (m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"])
        self.rank = {(a, b): i for i, (a, b) in enumerate(pairs)}
        self.specials = [t["content"] for t in spec["added_tokens"]]
        self.symbols = byte_symbols()
        self.split = regex.compile(PATTERN)
        self.library = Tokenizer.from_file(path)
        self.at_special = regex.compile("|".join(map(regex.escape, self.specials))) if self.specials else None
        self.known: dict[str, int] = {}

    def piece(self, text: str) -> int:
        """Tokens of one piece. The heap holds (rank, position) of adjacent pairs; merged
        cells leave the linked list, and entries whose pair has changed are skipped."""
        cell = [self.symbols[b] for b in text.encode("utf-8")]
        n, rank = len(cell), self.rank
        after, before = [*range(1, n), -1], [*range(-1, n - 1)]
        heap = [(r, i) for i in range(n - 1) if (r := rank.get((cell[i], cell[i + 1]))) is not None]
        heapq.heapify(heap)
        merges = 0
        while heap:
            r, i = heapq.heappop(heap)
            j = after[i] if cell[i] else -1
            if j < 0 or rank.get((cell[i], cell[j])) != r:
                continue
            cell[i], cell[j] = cell[i] + cell[j], ""
            merges += 1
            after[i] = k = after[j]
            if k >= 0:
                before[k] = i
                if (r := rank.get((cell[i], cell[k]))) is not None:
                    heapq.heappush(heap, (r, i))
            h = before[i]
            if h >= 0 and (r := rank.get((cell[h], cell[i]))) is not None:
                heapq.heappush(heap, (r, h))
        return n - merges

    def pieces(self, text: str) -> list[str]:
        if PLAIN.fullmatch(text):
            return self.split.findall(text)
        spans = self.library.pre_tokenizer.pre_tokenize_str(text)
        return [text[a:b] for _, (a, b) in spans if b > a]

    def unit(self, text: str) -> int:
        n = self.known.get(text)
        if n is None:
            if len(self.known) >= MEMORY:
                self.known.clear()
            n = self.known[text] = sum(map(self.piece, self.pieces(text)))
        return n

    def segment(self, text: str) -> int:
        """A space between two non-spaces always begins a new piece, so such texts split there."""
        if not text:
            return 0
        if PLAIN.fullmatch(text) is None or any(g in text for g in _GAPS):
            return sum(n * self.unit(p) for p, n in Counter(self.pieces(text)).items())
        first, *rest = text.split(" ")
        return self.unit(first) + sum(n * self.unit(" " + w) for w, n in Counter(rest).items())

    def count(self, text: str) -> int:
        if self.at_special is None:
            return self.segment(text)
        parts = self.at_special.split(text)
        return len(parts) - 1 + sum(map(self.segment, parts))


def count_tokens(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_bytes, n_tokens) of every row, by byte-pair merging with the vocabulary at ``path``.

    Null and empty texts have 0 bytes and 0 tokens; repeated rows are counted each; an
    empty table gives an empty result; other columns are ignored. Texts of any length are
    read whole. ``path`` is read on the executors. A piece is a few characters long but
    for unbroken runs, which cost n log n."""
    kind = dict(docs.dtypes)[id_col]

    def start():
        counter = MergeCounter(path)
        return lambda ids, text: [ids, [len(t.encode("utf-8")) for t in text], [counter.count(t) for t in text]]

    return map_rows(texts(docs, id_col, text_col), f"`{id_col}` {kind}, n_bytes long, n_tokens long", start)
