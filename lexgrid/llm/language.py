"""Language identification by a linear-chain conditional random field over words."""

from __future__ import annotations

import re
import string
from collections import Counter, defaultdict

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexgrid.llm.common import add_column, first_rows
from lexgrid.llm.crf import LinearChain

LETTER = re.compile(r"[^\W\d_]")
#: Words a chain: longer texts are cut into chains of so many words, none left out.
CHAIN = 32
#: Words whose emissions a worker remembers; past this it forgets them.
MEMORY = 300_000


#: Letters of a unit with its two edges; longer words are cut into units, see :func:`units`.
WIDTH = 24
_STRIP = string.punctuation + string.digits + "«»“”„‘’‚…¡¿–—·"
_SALTS = (0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D, 0x27D4EB2F)


def core(word: str) -> str:
    """The word without marks and digits around it, in lower case."""
    return word.strip(_STRIP).lower()


def units(text: str) -> list[str]:
    """The words of a text; one of more than WIDTH - 2 letters, as in scripts without white space, is
    cut into consecutive units of so many (the last may be shorter), so that every letter is read."""
    words, most = text.split(), WIDTH - 2
    if "\u0130" in text:  # the one character that lower case lengthens, by one
        most //= 2
    out = []
    for w in words:
        if len(w) > most and len(c := core(w)) > WIDTH - 2:
            out += [c[i : i + WIDTH - 2] for i in range(0, len(c), WIDTH - 2)]
        else:
            out.append(w)
    return out


def features(cores: list[str], lexicon: dict[str, int], size: int) -> np.ndarray:
    """(words, features) ids, -1 for none: affixes of 1 to 3 letters, letter bigrams and trigrams with word
    edges, and the lexicon's language. A word without a core has none. All words at once."""
    edged = [f"^{c}$" for c in cores]
    x = np.array(edged, f"U{WIDTH}").view(np.uint32).reshape(len(edged), WIDTH).astype(np.uint64)
    n = np.fromiter(map(len, edged), np.int64, len(edged))
    some = n > 2

    def mixed(kind: int, letters: list[np.ndarray], there: np.ndarray) -> np.ndarray:
        h = np.full(letters[0].shape, kind + 1, np.uint64)
        for c, salt in zip(letters, _SALTS):
            h = (h ^ c) * np.uint64(salt)
            h ^= h >> np.uint64(17)
        return np.where(there, (h % np.uint64(size)).astype(np.int64), -1)

    every = np.arange(len(edged))
    cols = []
    for k in (2, 3, 4):
        cols.append(mixed(k, [x[:, i] for i in range(k)], some & (n >= k))[:, None])
        cols.append(mixed(10 + k, [x[every, np.maximum(n - k + i, 0)] for i in range(k)], some & (n >= k))[:, None])
    at = np.arange(WIDTH)[None, :]
    for k in (2, 3):
        cols.append(mixed(20 + k, [x[:, i : WIDTH - k + 1 + i] for i in range(k)], some[:, None] & (at[:, : WIDTH - k + 1] + k <= n[:, None])))
    lex = np.fromiter((lexicon.get(c, -1) for c in cores), np.int64, len(cores))
    cols.append(np.where((lex >= 0) & some, size + lex, -1)[:, None])
    return np.concatenate(cols, 1)


class WordTagger:
    """A trained model: languages, lexicon and chain."""

    def __init__(self, langs: list[str], lexicon: dict[str, int], chain: LinearChain, size: int, prior: np.ndarray):
        self.prior = prior  # the languages' shares of the sample's words, for texts of which no feature was learned
        self.langs, self.lexicon, self.chain, self.size = langs, lexicon, chain, size
        self.known: dict[str, int] = {}
        self.pool = np.zeros((1024, len(langs)), np.float32)

    def _emissions(self, words: list[str]) -> np.ndarray:
        """Of running words; each distinct word is looked at once."""
        known = self.known
        if new := [w for w in dict.fromkeys(words) if w not in known]:
            if len(known) + len(new) > MEMORY:
                known.clear()
                new = list(dict.fromkeys(words))
            n = len(known)
            if n + len(new) > len(self.pool):
                self.pool = np.vstack([self.pool[:n], np.zeros((n + 2 * len(new), len(self.langs)), np.float32)])
            for i in range(0, len(new), 20_000):
                some = new[i : i + 20_000]
                self.pool[n + i : n + i + len(some)] = self.chain.emissions(features([core(w) for w in some], self.lexicon, self.size))
            known.update(zip(new, range(n, n + len(new)), strict=True))
        return self.pool[np.fromiter(map(known.__getitem__, words), np.int64, len(words))]

    def shares(self, texts: list[str]) -> np.ndarray:
        """Each text's mean label probability over its words."""
        out = np.zeros((len(texts), len(self.langs)))
        words = [units(t) for t in texts]
        i = 0
        while i < len(words):  # some hundred thousand words at once
            j, n = i, 0
            while j < len(words) and (j == i or n + len(words[j]) <= 200_000):
                n += len(words[j])
                j += 1
            if n:
                own = np.array([len(w) for w in words[i:j]])
                emit = self._emissions([x for w in words[i:j] for x in w])
                prob = self.chain.long_marginals(emit, own[own > 0])
                prob *= np.abs(emit).sum(1, keepdims=True) > 0  # words without letters have no say
                doc = np.repeat(np.arange(i, j), own)
                for c in range(prob.shape[1]):
                    out[:, c] += np.bincount(doc, prob[:, c], minlength=len(texts))
            i = j
        total = out.sum(1, keepdims=True)
        return np.where(total > 0, out / np.maximum(total, 1e-9), self.prior)


def train(samples: list[tuple[str, str]], size: int = 1 << 16, chains_each: int = 10, rounds: int = 40) -> WordTagger | None:
    """From (text, language) rows. Of a long text, ``chains_each`` chains spread over it count."""
    langs = sorted({lang for _, lang in samples})
    if not langs:
        return None
    by_lang: dict[str, Counter] = defaultdict(Counter)
    seqs: list[tuple[list[str], int]] = []
    for text, lang in samples:
        words = units(text)
        for w in words:
            by_lang[core(w)][lang] += 1
        chains = [words[s : s + CHAIN] for s in range(0, len(words), CHAIN)]
        for c in chains[:: max(1, -(-len(chains) // chains_each))]:
            seqs.append((c, langs.index(lang)))
    lexicon = {}
    for w, c in by_lang.items():
        (top, n), total = c.most_common(1)[0], sum(c.values())
        if w and total >= 5 and n >= 0.9 * total:
            lexicon[w] = langs.index(top)
    chain = LinearChain(size + len(langs), len(langs))
    words_of = np.bincount([k for _, k in seqs], [len(c) for c, _ in seqs], len(langs)) if seqs else np.ones(len(langs))
    tagger = WordTagger(langs, lexicon, chain, size, words_of / max(1.0, words_of.sum()))
    order: dict[str, int] = {}
    rows = np.array([order.setdefault(w, len(order)) for c, _ in seqs for w in c], np.int64)
    if len(rows):
        lengths = np.array([len(c) for c, _ in seqs])
        labels = np.repeat([k for _, k in seqs], lengths)
        chain.fit(features([core(w) for w in order], lexicon, size), rows, labels, lengths, rounds)
    return tagger


def held_out(id_col: str = "doc_id") -> F.Column:
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def training_rows(docs: DataFrame, id_col: str, text_col: str, lang_col: str, per_lang: int, most_chars: int) -> DataFrame:
    """``per_lang`` rows of each language, of up to ``most_chars`` characters, by the hash of the id. Only ids move; texts are
    read in a second scan against that bounded list."""
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"), F.col(lang_col).alias("_lang"))
    ids = rows.filter(F.col("_lang").isNotNull() & (F.length("_text") <= most_chars) & ~held_out("_id")).select("_id", "_lang")
    chosen = first_rows(ids, ["_lang"], [F.xxhash64("_id"), "_id"], per_lang).distinct()
    return rows.filter(F.length("_text") <= most_chars).join(F.broadcast(chosen), ["_id", "_lang"]).select("_text", "_lang")


def tag_languages(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_lang: int = 250, chains_each: int = 10, most_chars: int = 200_000, train_docs: DataFrame | None = None, name: str = "language"
) -> DataFrame:
    """``docs`` with one more column: a struct of ``lang`` and ``score``, as in :func:`identify_languages`."""
    samples = [(r["_text"], r["_lang"]) for r in training_rows(docs if train_docs is None else train_docs, id_col, text_col, lang_col, per_lang, most_chars).collect()]
    model = train(sorted(samples), chains_each=chains_each)

    def start():
        def step(text):
            text = [t or "" for t in text]
            out = [{"lang": "und", "score": 0.0} for _ in text]
            if model:
                share = model.shares(text)
                for i, t in enumerate(text):
                    if LETTER.search(t):
                        out[i] = {"lang": model.langs[int(share[i].argmax())], "score": float(min(1.0, share[i].max()))}
            return out

        return step

    return add_column(docs, [text_col], name, "struct<lang:string,score:double>", start)


def identify_languages(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_lang: int = 250, chains_each: int = 10, most_chars: int = 200_000, train_docs: DataFrame | None = None
) -> DataFrame:
    """(id, held_out, lang_pred, score) of every row.

    The model learns from at most ``per_lang`` labelled rows of each language that aren't
    held out (of ``train_docs``, or ``docs``), of up to ``most_chars`` characters, and of each from ``chains_each`` chains of 32 words spread
    over the text: the bounds of the sample, and the only ones. Word labels come from forward-backward over one
    chain of affix, n-gram and lexicon features for each whole text; the language with the largest mean
    probability over all words (units of 22 letters of longer words) wins, ties to the alphabetically first, and that
    mean is the score. A text of whose words no feature was learned gets the languages' shares of the sample. ``und`` with score 0 if the text is null, empty or has no letter, or if
    there is nothing to learn from. A null id is not held out; repeated rows are predicted each; an
    empty table gives an empty result; other columns are ignored."""
    own = docs.select(F.col(id_col), held_out(id_col).alias("_held"), F.col(text_col).alias("_text"))
    source = docs if train_docs is None else train_docs
    rows = source.select(F.col(id_col), F.col(text_col).alias("_text"), F.col(lang_col))
    tagged = tag_languages(own, id_col, "_text", lang_col, per_lang, chains_each, most_chars, rows, "_tag")
    return tagged.select(F.col(id_col), F.col("_held").alias("held_out"), F.col("_tag.lang").alias("lang_pred"), F.col("_tag.score").alias("score"))
