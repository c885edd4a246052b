"""Quality rules with a line sequence labeller."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexgrid.llm.common import first_rows, map_rows, texts
from lexgrid.llm.crf import LinearChain

SYMBOLS = "#*$%&|<>"
SIZE = 1 << 10


def base_counts(text: str) -> tuple[list[int], list[str]]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words; and the \\n-split lines."""
    raw = text.encode("utf-8", "replace")
    words = raw.split()  # bytes split at 0x20 and 0x09-0x0D only
    spaces = sum(map(text.count, " \t\n\v\f\r"))
    lines = text.split("\n")
    filled = [b for line in raw.split(b"\n") if (b := line).strip(b" \t\v\f\r")]
    repeat = repeated_words(words)
    return [len(words), len(text) - spaces, sum(map(text.count, SYMBOLS)), len(filled) - len(set(filled)), repeat], lines


def repeated_words(words: list[bytes], window: int = 3) -> int:
    """Words that stand in a window found twice or more."""
    n = len(words) - window + 1
    if n < 2:
        return 0
    ids: dict[bytes, int] = {}
    x = np.fromiter((ids.setdefault(w, len(ids)) for w in words), np.int64, len(words))
    v = len(ids)
    if v == len(words):
        return 0
    if v < 2_000_000:
        key = (x[:-2] * v + x[1:-1]) * v + x[2:]
    else:  # the product would not fit: number the pairs first
        pair = np.unique(x[:-1] * v + x[1:], return_inverse=True)[1]
        key = np.unique(np.stack([pair[:-1], x[2:]]), axis=1, return_inverse=True)[1].ravel()
    order = np.argsort(key, kind="stable")
    s = key[order]
    same = s[1:] == s[:-1]
    if not same.any():
        return 0
    twice = np.zeros(n, bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    cover = np.zeros(len(words) + 1, np.int64)
    at = np.flatnonzero(twice)
    np.add.at(cover, at, 1)
    np.add.at(cover, at + window, -1)
    return int((np.cumsum(cover)[:-1] > 0).sum())


def line_features(line: str, seen: bool, first: bool) -> tuple[int, ...]:
    """What a line looks like, in steps; nothing of its language or words."""
    n = len(line)
    words = line.split()
    k = len(words) or 1
    solid = n - line.count(" ") or 1
    upper = sum(1 for c in line if c.isupper())
    lower = sum(1 for c in line if c.islower())
    symbols = sum(map(line.count, SYMBOLS))
    digits = sum(map(line.count, "0123456789"))
    distinct = len(set(words))
    return (
        0,
        1 + min(9, k.bit_length()),
        12 + min(9, int(10 * upper / (upper + lower or 1))),
        24 + min(9, int(20 * symbols / solid)),
        36 + min(9, int(10 * digits / solid)),
        48 + min(9, int(10 * distinct / k)),
        60 + min(9, int(solid / k)),
        72 + (line.rstrip()[-1:] in ".!?"),
        76 + seen,
        80 + first,
        84 + min(9, int(10 * line.count("!") / k)),
        96 + min(9, int(10 * line.count("|") / k)),
        108 + min(9, int(20 * line.count(",") / k)),
        120 + (line[:1].isupper()),
        124 + min(9, int(10 * sum(len(w) > 2 for w in words) / k)),
        136 + min(9, int(10 * sum(w.isalpha() for w in words) / k)),
    )


WIDTH = len(line_features("", False, False))


def document_lines(lines: list[str]) -> tuple[list[tuple[int, ...]], list[int]]:
    """Features and word counts of the lines that have a word."""
    out, weight, seen = [], [], set()
    for line in lines:
        if k := len(line.split()):
            out.append(line_features(line, line in seen, not out))
            weight.append(k)
            seen.add(line)
    return out, weight


class LineLabeller:
    """Label 0 is content, 1 boilerplate; ``least`` is the content share that retains."""

    def __init__(self, chain: LinearChain, least: float):
        self.chain, self.least = chain, least

    def share(self, lines: list[str]) -> float:
        feats, weight = document_lines(lines)
        if not feats:
            return 0.0
        path = self.chain.viterbi(self.chain.emissions(np.array(feats)))
        return float(np.dot(path == 0, weight) / sum(weight))


def train(samples: list[tuple[str, int]], rounds: int = 60) -> LineLabeller:
    """From (text, quality) rows. Lines of good documents are content; those of bad ones
    begin as boilerplate and are labelled anew by the model, but for the worst line of each."""
    docs = [(document_lines(t.split("\n")), q) for t, q in samples]
    docs = [(f, w, q) for (f, w), q in docs if f]
    chain = LinearChain(SIZE, 2)
    if not docs or len({q for *_, q in docs}) < 2:
        chain.weights[0, 0] = 1.0  # nothing to learn from: all is content
        return LineLabeller(chain, 0.0)
    units = np.array([x for f, _, _ in docs for x in f])
    lengths = np.array([len(f) for f, _, _ in docs])
    labels = np.repeat([int(q == 0) for *_, q in docs], lengths)
    rows = np.arange(len(units))
    starts = np.cumsum(lengths) - lengths
    for _ in range(3):
        chain = LinearChain(SIZE, 2).fit(units, rows, labels, lengths, rounds)
        prob = chain.marginals(chain.emissions(units), lengths)[:, 1]
        for s, n, (_, _, q) in zip(starts, lengths, docs, strict=True):
            if q == 0:
                own = prob[s : s + n]
                labels[s : s + n] = own > min(0.5, own.max() - 1e-6)
    shares = []
    for s, n, (_, w, q) in zip(starts, lengths, docs, strict=True):
        path = chain.viterbi(chain.emissions(units[s : s + n]))
        shares.append((float(np.dot(path == 0, w) / sum(w)), q))
    good = sorted(s for s, q in shares if q)
    # the highest step that retains 99.5 % of the good rows
    steps = [i / 20 for i in range(1, 20)]
    least = max([0.0, *(t for t in steps if sum(s >= t for s in good) >= 0.995 * len(good))])
    return LineLabeller(chain, least)


def training_rows(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, quality_col: str, sample: int, most_chars: int) -> list[tuple[str, int]]:
    ids = labels.filter(F.col(quality_col).isNotNull() & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("_id")).agg(F.min(quality_col).alias("_q"))
    chosen = first_rows(ids, [], [F.xxhash64("_id"), "_id"], sample)
    rows = docs.filter(F.length(text_col) <= most_chars).select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")).join(F.broadcast(chosen), "_id")
    return sorted((r["_text"], r["_q"]) for r in rows.select("_text", "_q").collect())


def score_quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", quality_col: str = "quality", sample: int = 1500, most_chars: int = 200_000) -> DataFrame:
    """(id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, content_share, least_share) of every row.

    The labeller learns from at most ``sample`` labelled rows, by the hash of their id, those of up to ``most_chars`` characters. Viterbi decoding
    labels each line of the whole text; ``content_share`` is the share of words in content lines.
    Null and empty texts have zeros; a label given twice counts as the worse; repeated rows are scored
    each; empty tables give an empty result, or with no labels all lines as content; other columns are ignored."""
    kind = dict(docs.dtypes)[id_col]
    model = train(training_rows(docs, labels, id_col, text_col, quality_col, sample, most_chars))

    def start():
        def step(ids, text):
            counts, shares = [], []
            for t in text:
                c, lines = base_counts(t)
                counts.append(c)
                shares.append(model.share(lines))
            return [ids, *(list(c) for c in zip(*counts, strict=True)), shares, [model.least] * len(ids)]

        return step

    names = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long"
    return map_rows(texts(docs, id_col, text_col), f"`{id_col}` {kind}, {names}, content_share double, least_share double", start)
