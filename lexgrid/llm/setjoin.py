"""N-gram Jaccard join with set-relation skipping."""

from __future__ import annotations

import numpy as np
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexgrid.llm.common import Scratch, dealt, fresh, hot_keys, map_rows, texts
from lexgrid.llm.components import components

#: Slots of the frequency sketch that orders shingles, whatever the corpus's size.
SLOTS = 1 << 21
#: Shared shingles that a prefix is lengthened for, so that so many must meet.
MEETS = 3
#: Words whose hashes a worker remembers; past this it forgets them.
MEMORY = 300_000
#: Bytes of wanted ids, measured, up to which they're sent to all executors; beyond, texts are joined by a shuffle.
SMALL = 24_000_000
#: Entries of a block of an index list, and rows of one key that go to one task.
BLOCK, HOT = 128, 256
#: Steps that the distances of a group's members from its centre are told apart by.
STEPS = 64
_MIX = np.uint64(0x9E3779B97F4A7C15)
_MORE = np.uint64(0xBF58476D1CE4E5B9)


class _Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        h = self[word] = xxhash.xxh64_intdigest(word)
        return h


class Shingler:
    """The sorted distinct shingle hashes of each text."""

    def __init__(self, size: int):
        self.size, self.hashes = size, _Hashes()

    def sets(self, texts: list[bytes]) -> list[np.ndarray]:
        """Words are runs without 0x20 and 0x09-0x0D, A-Z lower-cased; a text of fewer words
        than a shingle is one shingle, one of none has none."""
        out = []
        for t in texts:
            if len(self.hashes) > MEMORY:
                self.hashes.clear()
            words = bytes(t).lower().split()
            if not words:
                out.append(np.zeros(0, np.int64))
                continue
            x = np.fromiter(map(self.hashes.__getitem__, words), np.uint64, len(words))
            k = min(self.size, len(x))
            h = np.full(len(x) - k + 1, k, np.uint64)
            for j in range(k):
                h = (h ^ (h >> np.uint64(29))) * _MIX + x[j : len(x) - k + 1 + j]
            h = (h ^ (h >> np.uint64(31))) * _MORE
            out.append(np.unique((h ^ (h >> np.uint64(33))).view(np.int64)))
        return out


def _slot(tokens: np.ndarray) -> np.ndarray:
    return tokens.view(np.uint64) % np.uint64(SLOTS)


def frequency_levels(rows: DataFrame, size: int) -> np.ndarray:
    """A count sketch of the whole corpus's shingles: for each slot, the bits of the number of rows.
    Shingles that stand once in a batch of rows aren't counted there; all are only an order, on
    which no result depends. The sketch has a fixed size, so it may go to driver and executors."""

    def start():
        shingler = Shingler(size)

        def step(text):
            out: list[list] = [[], []]
            for i in range(0, len(text), 2500):
                token, n = np.unique(np.concatenate(shingler.sets(text[i : i + 2500])), return_counts=True)
                slot, at = np.unique(_slot(token[n > 1]).astype(np.int64), return_inverse=True)
                out[0] += slot.tolist()
                out[1] += np.bincount(at, n[n > 1], len(slot)).astype(np.int64).tolist()
            return out

        return step

    counted = map_rows(rows.select("_text"), "slot long, n long", start).groupBy("slot").agg(F.ceil(F.log2(F.sum("n"))).cast("int").alias("level")).toArrow()
    levels = np.zeros(SLOTS, np.uint8)
    levels[counted["slot"].to_numpy()] = np.minimum(counted["level"].to_numpy(), 60) + 1
    return levels


def fold(levels: np.ndarray) -> bytes:
    import zlib

    return zlib.compress(levels.tobytes(), 1)


def unfold(data: bytes) -> np.ndarray:
    import zlib

    return np.frombuffer(zlib.decompress(data), np.uint8)


def least_overlap(n: int, num: int, den: int) -> int:
    """The fewest shared shingles of a set of n with any set that it links with."""
    return -(-num * n // den)


def prefix(tokens: np.ndarray, levels: np.ndarray, num: int, den: int) -> np.ndarray:
    """The rarest shingles first, so many that linked sets share MEETS of them (all they can, if less)."""
    order = np.argsort(levels[_slot(tokens)], kind="stable")
    need = least_overlap(len(tokens), num, den)
    return tokens[order[: len(tokens) - need + min(MEETS, need)]]


def summarise(rows: DataFrame, id_col: str, kind: str, size: int, num: int, den: int, levels: np.ndarray) -> DataFrame:
    data = fold(levels)

    def start():
        shingler, table = Shingler(size), unfold(data)

        def step(ids, text, texts_hash):
            sets = shingler.sets(text)
            keys = [xxhash.xxh3_128_intdigest(s.tobytes()) for s in sets]
            return [ids, [len(s) for s in sets], [(k >> 64) - (1 << 63) for k in keys], [(k & ((1 << 64) - 1)) - (1 << 63) for k in keys], [prefix(s, table, num, den) for s in sets], texts_hash]

        return step

    return map_rows(rows.withColumn("_h", F.xxhash64("_text")), f"_id {kind}, _n long, _hi long, _lo long, _prefix array<long>, _h long", start)


def full_sets(docs: DataFrame, id_col: str, text_col: str, wanted: DataFrame, size: int, scratch: Scratch) -> DataFrame:
    """(node, set) of the wanted (node, _id, _hi, _lo), from their texts."""
    size_of = sum((F.coalesce(F.octet_length(c), F.lit(0)) if k == "string" else F.lit(0) for c, k in wanted.dtypes), F.lit(16 * len(wanted.columns)))
    small = (wanted.agg(F.sum(size_of)).first()[0] or 0) <= SMALL
    left = texts(docs, id_col, text_col, binary=True).toDF("_own", "_text")
    right = F.broadcast(wanted) if small else wanted
    joined = left.join(right, left["_own"].eqNullSafe(right["_id"]))

    def start():
        shingler = Shingler(size)

        def step(node, hi, lo, text):
            keep: list[list] = [[], []]
            for n, h, low, s in zip(node, hi, lo, shingler.sets(text), strict=True):
                k = xxhash.xxh3_128_intdigest(s.tobytes())
                if (k >> 64) - (1 << 63) == h and (k & ((1 << 64) - 1)) - (1 << 63) == low:
                    keep[0].append(n)
                    keep[1].append(s)
            return keep

        return step

    found = scratch.keep(map_rows(joined.select("node", "_hi", "_lo", "_text"), "node long, set array<long>", start))
    if found.count() == found.select("node").distinct().count():
        return found
    return scratch.keep(found.groupBy("node").agg(F.first("set").alias("set")))  # of repeated rows one


def linked(inter, n_a, n_b, num: int, den: int) -> F.Column:
    return den * inter >= num * (n_a + n_b - inter)


def sizes_fit(n_a, n_b, num: int, den: int) -> F.Column:
    return (den * F.least(n_a, n_b) >= num * F.greatest(n_a, n_b))


def reach(num: int, den: int) -> int:
    """The most, of den times a member's size, that it and its star may differ to be of one group.

    A set's own shingles are the rarest and fill its prefix first. So if two variants of one text meet MEETS times in that text's shingles, neither has more than
    (den - num) / den of its size of its own, and if words were replaced, neither lacks more of the text than that; so they differ in four times that at most.
    A lower limit would leave the outermost variants as stars of their own, which meet each other and the group in every shingle of the text.
    Half of the size is allowed at least, and the size at most; no result depends on it."""
    return min(max(4 * (den - num), -(-den // 2)), den)


def jaccard_components(docs: DataFrame, size: int = 3, num: int = 90, den: int = 100, id_col: str = "doc_id", text_col: str = "text", stars: int = 3, with_hash: bool = False) -> DataFrame:
    """(id, n_shingles, component_id[, text_hash]) of every row: sets of ``size`` words link where den * intersection
    >= num * union, and a component's id is the smallest id that links reach.

    1. Equal sets become one node. Nodes post a prefix of their shingles, rarest first.
    2. Stars: a group of similar nodes takes one of them as its star, is compared with it alone, and keeps the differences.
    3. Members of one star in different components are answered from their differences with the centre of its group, which must meet.
    4. All other pairs that meet often enough in prefixes, are of different stars and aren't in one component
       yet are verified from both sets. Lists are skipped where one star or component fills them. The others stand in blocks of one star,
       of like positions and like differences with it; a pair of blocks is skipped by sizes, by positions, and by the
       distance of both stars less what their members can differ from them.
    No link between components is left out: a pair is skipped only if it can't link or is joined by verified links already.

    Null and empty texts have no set, 0 shingles and their own id; a text of fewer words than a shingle is one
    shingle; repeated rows and ids are rows of one component if their texts link; a null id takes part and
    is the component's only if there is no other; an empty table gives an empty result; other columns are ignored."""
    spark = docs.sparkSession
    scratch = Scratch(spark)
    kind = dict(docs.dtypes)[id_col]
    rows = texts(docs, id_col, text_col, binary=True)
    levels = frequency_levels(rows, size)
    full = scratch.keep(summarise(rows, id_col, kind, size, num, den, levels).withColumn("_uid", F.monotonically_increasing_id()))
    whole = scratch.keep(
        full.filter("_n > 0").groupBy("_hi", "_lo").agg(F.min(F.struct("_uid", "_id", "_n", "_prefix")).alias("m"), F.min("_id").alias("least"))
        .select("_hi", "_lo", F.col("m._uid").alias("node"), F.col("m._id").alias("_id"), F.col("m._n").alias("n"), F.col("m._prefix").alias("prefix"), "least")
    )
    posts = whole.select("node", "n", F.posexplode("prefix").alias("pos", "token"))
    # only what at least two nodes post
    several = posts.groupBy("token").agg(F.count("*").alias("c")).filter("c > 1").select("token")
    posts = scratch.keep(posts.join(several, "token"))
    kept, nodes = scratch.keep(full.drop("_prefix")), scratch.keep(whole.drop("prefix"))
    scratch.drop(full, whole)  # prefixes are read no more
    links = _links(docs, id_col, text_col, nodes, posts, size, num, den, stars, scratch)
    if links is None:
        final = scratch.keep(nodes.select("_hi", "_lo", F.col("least").alias("component_id")))
    else:
        placed = scratch.keep(_placed(nodes.select("_hi", "_lo", "node", "least"), components(scratch, links), "node", "comp"))
        ids = placed.groupBy("comp").agg(F.min("least").alias("component_id"))
        final = scratch.keep(dealt(placed, ids, "comp", "node", hot_keys(scratch, placed, "comp", HOT)).select("_hi", "_lo", "component_id"))
    scratch.drop_but(kept, final)
    more = [F.col("_h").alias("text_hash")] if with_hash else []
    alone = kept.filter("_n = 0").select(F.col("_id").alias(id_col), F.col("_n").alias("n_shingles"), F.col("_id").alias("component_id"), *more)
    named = kept.filter("_n > 0").select("_hi", "_lo", "_id", "_n", "_h", "_uid")
    rest = dealt(named, final, ["_hi", "_lo"], "_uid", hot_keys(scratch, named, ["_hi", "_lo"], HOT))
    return rest.select(F.col("_id").alias(id_col), F.col("_n").alias("n_shingles"), "component_id", *more).unionByName(alone)


def drop_near_copies(docs: DataFrame, size: int = 5, num: int = 80, den: int = 100, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay: of each component the one of the smallest id (ties: by the text's
    hash, nulls last), and every row without words. Of rows that agree in id and text one stays.

    Null and empty texts stay, as does a row with a null id unless its component has another; texts of any length
    are compared whole; an empty table stays empty; other columns pass as they are, whatever their names."""
    scratch = Scratch(docs.sparkSession)
    placed = scratch.keep(jaccard_components(docs, size, num, den, id_col, text_col, with_hash=True))
    first = F.struct(F.col(id_col).isNull().alias("x"), F.col(id_col).alias("i"), F.col("text_hash").alias("h"))
    i, h = fresh(docs, "_i"), fresh(docs, "_h")
    with_words = placed.filter("n_shingles > 0")
    winners = with_words.groupBy("component_id").agg(F.min(first).alias("w")).select(F.col("w.i").alias(i), F.col("w.h").alias(h))
    winners = winners.unionByName(placed.filter("n_shingles = 0").select(F.col(id_col).alias(i), F.col("text_hash").alias(h)).distinct())
    own = F.xxhash64(F.coalesce(F.col(text_col), F.lit("")).cast("binary"))
    kept = docs.join(winners, docs[id_col].eqNullSafe(F.col(i)) & (own == F.col(h)), "left_semi")
    repeated = with_words.groupBy(id_col, "text_hash").agg(F.count("*").alias("n")).filter("n > 1")
    if repeated.isEmpty():
        return kept
    return kept.withColumn(h, own).dropDuplicates([id_col, h]).drop(h)


def _links(docs, id_col, text_col, nodes, posts, size, num, den, stars, scratch) -> DataFrame | None:
    """Links (a, b) of nodes that connect all that linked sets connect; None if there are none."""
    if posts.isEmpty():
        return None
    best = scratch.keep(_hubs(posts, num, den, stars))
    found: list[DataFrame] = []
    comps = near = None
    sets = Sets(docs, id_col, text_col, nodes.select("node", "_id", "_hi", "_lo"), size, scratch)
    for s in range(stars):
        pairs = best.filter(F.col("seed") == s).drop("seed")
        if comps is not None:
            pairs = _across(pairs, comps, "node", "hub")
        pairs = scratch.keep(pairs)
        if pairs.isEmpty():
            continue
        if s == 0:  # those of all seeds, in one scan
            sets.fetch(best.select("node").union(best.select("hub")))
        seen = sets.apart(pairs, "node", "hub", once=True)
        ok = linked(F.col("n") - F.size("plus"), F.col("n"), F.col("hub_n"), num, den)
        if s == 0:  # what a member and its star don't share, if that is no more than variants of one text may have that meet in its shingles
            seen = scratch.keep(seen.select("node", "hub", "n", "hub_n", ok.alias("ok"), F.concat("plus", "minus").alias("diff")).withColumn("diff", F.when(den * F.size("diff") <= reach(num, den) * F.col("n"), F.col("diff"))))
            near = scratch.keep(seen.filter(F.col("diff").isNotNull()))
            ok = F.col("ok")
        good = scratch.keep(seen.filter(ok).select(F.col("node").alias("a"), F.col("hub").alias("b")))
        if s == 0:
            scratch.drop(seen)
        if not good.isEmpty():
            found.append(good)
            comps = components(scratch, _all(found))
    if near is not None:
        good = _within(near, comps, num, den, scratch)
        if not good.isEmpty():
            found.append(good)
            comps = components(scratch, _all(found))
    pairs = scratch.keep(_crossing(posts, comps, near, sets, num, den, scratch))
    if not pairs.isEmpty():
        sets.fetch(pairs.select("a").union(pairs.select("b")))
        ok = linked(F.col("n_a") - F.size("plus"), F.col("n_a"), F.col("n_b"), num, den)
        found.append(scratch.keep(sets.apart(pairs, "a", "b").filter(ok).select("a", "b")))
    return _all(found) if found else None


class Sets:
    """The whole sets of the nodes that were asked for, each read from its text once."""

    def __init__(self, docs: DataFrame, id_col: str, text_col: str, keys: DataFrame, size: int, scratch: Scratch):
        self.source, self.keys, self.size, self.scratch = (docs, id_col, text_col), keys, size, scratch
        self.whole: DataFrame | None = None

    def fetch(self, nodes: DataFrame) -> None:
        wanted = self.keys.join(nodes.toDF("node").distinct(), "node")
        if self.whole is not None:
            wanted = wanted.join(self.whole.select("node"), "node", "left_anti")
        wanted = self.scratch.keep(wanted)
        if not wanted.isEmpty():
            more = full_sets(*self.source, wanted, self.size, self.scratch)
            self.whole = more if self.whole is None else self.whole.unionByName(more)

    def _of(self, pairs: DataFrame, key: str, name: str) -> DataFrame:
        """The sets of the nodes in ``key``; where these are the smaller part, their ids are joined first, so that no other set moves."""
        named = self.whole.select(F.col("node").alias(key), F.col("set").alias(name))
        nodes = self.scratch.keep(pairs.select(key).distinct())
        return named.join(nodes, key, "left_semi") if 2 * nodes.count() <= self.whole.count() else named

    def apart(self, pairs: DataFrame, a: str, b: str, once: bool = False) -> DataFrame:
        """``pairs``, a written table, with ``plus`` and ``minus``: what a has and b hasn't, and the reverse. A node of many pairs is dealt over
        tasks; ``once``: no a has two."""
        out = dealt(pairs, self._of(pairs, a, "_own"), a, b, None if once else hot_keys(self.scratch, pairs, a, HOT))
        out = dealt(out, self._of(pairs, b, "_its"), b, a, hot_keys(self.scratch, pairs, b, HOT))
        return out.withColumns({"plus": F.array_except("_own", "_its"), "minus": F.array_except("_its", "_own")}).drop("_own", "_its")


def _hubs(posts: DataFrame, num: int, den: int, stars: int) -> DataFrame:
    """(seed, node, n, hub, hub_n): the star of each node and seed. In each list of a shingle and a span of
    sizes (two families of spans, half a span apart, so that no group lies on an edge of both), the node of the least seeded hash is
    offered to the others; a node takes the least of those that it's offered often enough, so that a group takes one star."""
    x = F.log("n") / float(np.log(den / num)) if den > num else F.col("n").cast("double")
    spans = F.explode(F.array(2 * F.floor(x), 2 * F.floor(x + 0.5) + 1))
    lists = posts.select("token", "node", "n", spans.alias("span"))
    hashes = [F.xxhash64("node", F.lit(s)) for s in range(stars)]
    least = lists.groupBy("token", "span").agg(F.count("*").alias("c"), *(F.min(F.struct(h.alias("h"), F.col("node"), F.col("n"))).alias(f"h{s}") for s, h in enumerate(hashes))).filter("c > 1").drop("c")
    each = F.explode(F.array(*(F.struct(F.lit(s).alias("seed"), F.col(f"h{s}.h").alias("h"), F.col(f"h{s}.node").alias("hub"), F.col(f"h{s}.n").alias("hub_n")) for s in range(stars))))
    offered = lists.join(least, ["token", "span"]).select("node", "n", each.alias("o")).select("node", "n", "o.*")
    met = (
        offered.filter((F.col("node") != F.col("hub")) & sizes_fit(F.col("n"), F.col("hub_n"), num, den))
        .groupBy("seed", "node", "n", "h", "hub", "hub_n").agg(F.count("*").alias("c")).filter((F.col("c") >= MEETS) | (F.least("n", "hub_n") < 4 * MEETS))
    )
    return met.groupBy("seed", "node").agg(F.min(F.struct("h", "hub", "n", "hub_n")).alias("b")).select("seed", "node", "b.hub", "b.n", "b.hub_n")


def _all(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


def _placed(frame: DataFrame, comps: DataFrame | None, node: str, comp: str) -> DataFrame:
    if comps is None:
        return frame.withColumn(comp, F.col(node))
    named = comps.select(F.col("node").alias(node), F.col("comp").alias(comp))
    return frame.join(named, node, "left").withColumn(comp, F.coalesce(comp, node))


def _across(pairs: DataFrame, comps: DataFrame | None, a: str, b: str) -> DataFrame:
    """Pairs whose nodes aren't in one component."""
    return _placed(_placed(pairs, comps, a, "_ca"), comps, b, "_cb").filter("_ca <> _cb").drop("_ca", "_cb")


def _centred(near: DataFrame, comps: DataFrame | None, num: int, den: int, scratch: Scratch) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(hub, node, n, comp, diff, d, r, step, joined, top), a written table, of the stars with members they don't link with, and of these stars themselves:
    ``diff`` is what a set doesn't share with its group's centre, which has what most of the group has. As the star is a copy itself, what it
    alone changed is in all differences with it, and in none with the centre.

    Let d be the size of ``diff`` and r = (den - num) * n - (den + num) * d. Sets with r_a + r_b >= 0 are linked for certain. So all with r + r_top >= 0
    are linked with ``top``, the one of the largest r, and no other is linked with any without sharing some of ``diff``. ``joined`` marks them, and what the star links with,
    if it's among them; all those are given one component. ``step`` is d as a share of n, in steps. The second table, (hub, steps), has for each step the largest r, ``high``,
    and that of those that aren't joined, ``open``. The third are the links (a, b) with ``top`` that join components."""
    open_ = scratch.keep(near.groupBy("hub").agg(F.min("ok").alias("all_ok"), F.first("hub_n").alias("hub_n")).filter(~F.col("all_ok")).drop("all_ok"))
    stars = open_.select("hub", F.col("hub").alias("node"), F.lit(True).alias("ok"), F.col("hub_n").alias("n"), F.array().cast("array<bigint>").alias("diff"))
    group = near.select("hub", "node", "ok", "n", "diff").join(open_.select("hub"), "hub", "left_semi").unionByName(stars)
    group = scratch.keep(_placed(group, comps, "node", "comp"))
    hot = hot_keys(scratch, group, "hub", HOT)
    sizes = group.groupBy("hub").agg(F.count("*").alias("g"))
    # a group has two sets at least, so what one alone has is in no centre
    counts = group.select("hub", F.explode("diff").alias("x")).groupBy("hub", "x").agg(F.count("*").alias("c")).filter("c > 1")
    centre = dealt(counts, sizes, "hub", "x", None).filter("2 * c > g").groupBy("hub").agg(F.collect_list("x").alias("centre"))
    centres = scratch.keep(open_.select("hub").join(centre, "hub", "left").withColumn("centre", F.coalesce("centre", F.array().cast("array<bigint>"))))
    moved = dealt(group, centres, "hub", "node", hot).withColumn("diff", F.concat(F.array_except("diff", "centre"), F.array_except("centre", "diff"))).drop("centre")
    moved = moved.withColumn("d", F.size("diff")).withColumn("r", (den - num) * F.col("n") - (den + num) * F.col("d"))
    moved = scratch.keep(moved.withColumn("step", F.least(F.floor(STEPS * F.col("d") / F.col("n")), F.lit(STEPS)).cast("int")))
    tops = scratch.keep(moved.groupBy("hub").agg(F.max(F.struct("r", "node", "comp")).alias("top"), F.max(F.when(F.col("node") == F.col("hub"), F.col("r"))).alias("r_star")))
    least = -F.col("top.r")
    marked = dealt(moved, tops, "hub", "node", hot).withColumn("joined", (F.col("r") >= least) | (F.col("ok") & (F.col("r_star") >= least)))
    marked = scratch.keep(marked.withColumn("sure", (F.col("r") >= least) & (F.col("comp") != F.col("top.comp"))).drop("ok", "r_star"))
    each = marked.groupBy("hub", "step").agg(F.max("r").alias("high"), F.max(F.when(~F.col("joined"), F.col("r"))).alias("open"))
    steps = scratch.keep(each.groupBy("hub").agg(F.collect_list(F.struct("step", "high", "open")).alias("steps")).filter(F.exists("steps", lambda c: c["open"].isNotNull())))
    out = scratch.keep(dealt(marked, steps.select("hub"), "hub", "node", hot))
    sure = scratch.keep(marked.filter("sure").select(F.col("top.node").alias("a"), F.col("node").alias("b")))
    scratch.drop(open_, group, centres, moved, tops, marked)
    return out, steps, sure


def _within(near: DataFrame, comps: DataFrame | None, num: int, den: int, scratch: Scratch) -> DataFrame:
    """Links (a, b), a written table, between members of one star in different components, from their differences with the group's centre.

    Let d be the size of a member's difference and r as in :func:`_centred`. |a ^ b| = d_a + d_b - 2 o, where o is what the differences share, so that linked sets
    have 2 (den + num) o >= -r_a - r_b, and o >= d - (den - num) / num * n of either. One of a pair, a, isn't joined with the top. So rare-first
    prefixes of their differences must meet, where enough is left of both. A prefix is as long as the largest r of the other's step asks for, so a member far from the
    centre, which others may lack the same shingles of, posts none for the steps too far from its own. Of members whose changes are their own none meet, however large the
    group is."""
    members, steps, sure = _centred(near, comps, num, den, scratch)
    # all that are joined are one component
    members = members.withColumn("comp", F.when(F.col("joined"), F.col("top.comp")).otherwise(F.col("comp")))
    alone = F.ceil(F.col("d") - (den - num) * F.col("n") / num - F.lit(1e-6))
    kept = ["hub", "node", "joined", "comp", "r", "step", "alone"]
    each = members.withColumn("alone", alone).select(*kept, F.explode("diff").alias("x"))
    often = each.groupBy("hub", "x").agg(F.count("*").alias("c")).filter("c > 1")
    shared = scratch.keep(each.join(often, ["hub", "x"]))
    # what one member alone has comes first in its prefix and meets nobody
    listed = scratch.keep(shared.groupBy(*kept).agg(F.sort_array(F.collect_list(F.struct("c", "x"))).alias("s")))

    ranked = scratch.keep(dealt(listed, steps, "hub", "node", hot_keys(scratch, listed, "hub", HOT)))

    def posted(rows: DataFrame, side: str, most: str) -> DataFrame:
        need = F.greatest(F.lit(1), F.col("alone"), F.ceil((-F.col("r") - F.col(f"o.{most}")) / (2 * (den + num)) - F.lit(1e-6)))
        names = {"node": side, "comp": f"c_{side}", "r": f"r_{side}"}
        each = rows.select("hub", *names, "step", "s", "alone", F.explode(F.filter("steps", lambda c: c[most].isNotNull())).alias("o"))
        each = each.withColumn("_n", (F.size("s") - need + 1).cast("int")).filter("_n > 0")
        each = each.select("hub", *(F.col(c).alias(n) for c, n in names.items()), "step", F.col("o.step").alias("other"), F.size("s").alias("_k"), F.posexplode(F.slice("s", F.lit(1), F.col("_n"))).alias("_p", "y"))
        a, b = ("step", "other") if side == "a" else ("other", "step")
        return each.select("hub", *names.values(), F.struct(F.col("y.x").alias("x"), F.col(a).alias("a"), F.col(b).alias("b")).alias("x"), (F.col("_k") - F.col("_p")).alias(f"rest_{side}"))

    right = posted(ranked, "b", "open")
    left = posted(ranked.filter(~F.col("joined")), "a", "high")
    # at the first element that they share, what is left of either must do
    may = (F.col("c_a") != F.col("c_b")) & (2 * (den + num) * F.least("rest_a", "rest_b") >= -F.col("r_a") - F.col("r_b"))
    met = left.join(right, ["hub", "x"]).filter(may).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "hub").distinct()
    one = lambda n: members.select("hub", F.col("node").alias(n), F.col("r").alias(f"r_{n}"), F.col("diff").alias(f"diff_{n}"))
    both = met.join(one("a"), ["hub", "a"]).join(one("b"), ["hub", "b"])
    good = both.filter(2 * (den + num) * F.size(F.array_intersect("diff_a", "diff_b")) >= -F.col("r_a") - F.col("r_b")).select("a", "b")
    good = scratch.keep(good.unionByName(sure))
    scratch.drop(shared, listed, ranked)
    return good


def _crossing(posts: DataFrame, comps: DataFrame | None, near: DataFrame | None, sets: Sets, num: int, den: int, scratch: Scratch) -> DataFrame:
    """Pairs (a, b, n_a, n_b) of nodes in different components and of different stars that meet often enough.

    A list's entries stand in blocks of one star, one step of the difference with it and one step of the position. Let
    a shingle stand at i of n_a in a and at j of n_b in b, and let S and T be their stars, with d_a and d_b what they differ. Then
    |a ^ b| >= abs(i - j) + abs(n_a - i - n_b + j), as the order is one for all, and |a ^ b| >= |S ^ T| - d_a - d_b. Linked sets
    differ in at most (den - num) / (den + num) * (n_a + n_b). So no block is opened, and no pair made, that these bounds exclude;
    they hold at each shingle that a linked pair shares, so that none is lost from its count."""
    own = _placed(posts, comps, "node", "comp")
    if near is None:
        own = own.withColumns({"star": F.col("node"), "d": F.lit(0)})
    else:
        own = own.join(near.select("node", F.col("hub").alias("star"), F.size("diff").alias("d")), "node", "left").withColumns({"star": F.coalesce("star", "node"), "d": F.coalesce("d", F.lit(0))})
    own = scratch.keep(own)
    scratch.drop(posts)
    several = own.groupBy("token").agg(F.min("star").alias("s"), F.max("star").alias("t"), F.min("comp").alias("c"), F.max("comp").alias("k")).filter("s <> t and c <> k").select("token")
    steps = [F.floor(20 * F.col("d") / F.col("n")).cast("int").alias("d_step"), F.floor(4 * den * F.col("pos") / ((den - num) * F.col("n") + den)).cast("int").alias("p_step")]
    # a star's members are dealt to as many parts as its size asks for, in every list, so that no block grows with it
    crowd = F.lit(1) if near is None else F.coalesce("crowd", F.lit(1))
    open_ = own.join(several, "token")
    if near is not None:
        many = scratch.keep(near.groupBy(F.col("hub").alias("star")).agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("crowd")).filter("crowd > 1"))
        open_ = open_.join(many, "star", "left")
    of = lambda f, *names: [x for c in names for x in (f[0](c).alias(f"{c}_lo"), f[1](c).alias(f"{c}_hi"))]
    blocks = scratch.keep(
        open_.groupBy("token", "star", *steps, F.pmod(F.xxhash64("node"), crowd).alias("part"))
        .agg(*of((F.min, F.max), "n", "pos", "d", "comp"), F.sort_array(F.collect_list(F.struct("n", "node", "comp", "pos", "d"))).alias("items"))
        .withColumn("block", F.monotonically_increasing_id())
    )
    scratch.drop(own)
    heads = blocks.drop("items", "d_step", "p_step", "part", "d_lo")
    side = lambda x: heads.select("token", *(F.col(c).alias(f"{c}_{x}") for c in heads.columns if c != "token"))
    most = lambda n_a, n_b: (den - num) * (n_a + n_b)  # noqa: E731  of den + num times what they differ
    gap = lambda lo_a, hi_a, lo_b, hi_b: F.greatest(lo_a - hi_b, lo_b - hi_a, F.lit(0))
    c = F.col
    rest = gap(c("n_lo_a") - c("pos_hi_a"), c("n_hi_a") - c("pos_lo_a"), c("n_lo_b") - c("pos_hi_b"), c("n_hi_b") - c("pos_lo_b"))
    positions = gap(c("pos_lo_a"), c("pos_hi_a"), c("pos_lo_b"), c("pos_hi_b")) + rest
    met = side("a").join(side("b"), "token").filter(
        (c("star_a") < c("star_b")) & (den * c("n_hi_a") >= num * c("n_lo_b")) & (den * c("n_hi_b") >= num * c("n_lo_a"))
        & ((den + num) * positions <= most(c("n_hi_a"), c("n_hi_b"))) & ~((c("comp_lo_a") == c("comp_hi_b")) & (c("comp_hi_a") == c("comp_lo_b")))
    )
    met = scratch.keep(met.select("block_a", "block_b", "star_a", "star_b", "n_hi_a", "n_hi_b", "d_hi_a", "d_hi_b", F.lit(0).alias("far")))
    if near is not None:
        hubs = near.select("hub").distinct()
        stars = scratch.keep(met.select("star_a", "star_b").distinct())
        grouped = scratch.keep(stars.join(hubs, stars["star_a"] == hubs["hub"], "left_semi").union(stars.join(hubs, stars["star_b"] == hubs["hub"], "left_semi")).distinct())
        if not grouped.isEmpty():
            sets.fetch(grouped.select("star_a").union(grouped.select("star_b")))
            distances = scratch.keep(sets.apart(grouped, "star_a", "star_b").select("star_a", "star_b", (F.size("plus") + F.size("minus")).alias("far")))
            met = met.drop("far").join(distances, ["star_a", "star_b"], "left").withColumn("far", F.coalesce("far", F.lit(0)))
            met = scratch.keep(met.filter((den + num) * (c("far") - c("d_hi_a") - c("d_hi_b")) <= most(c("n_hi_a"), c("n_hi_b"))))
    items = blocks.select("block", "items")
    opened = dealt(met.select("block_a", "block_b", "far"), items.toDF("block_a", "xs"), "block_a", "block_b", hot_keys(scratch, met, "block_a", HOT))
    opened = dealt(opened, items.toDF("block_b", "ys"), "block_b", "block_a", hot_keys(scratch, met, "block_b", HOT))

    def may(x, y, far) -> F.Column:
        i, j, n, m = x["pos"], y["pos"], x["n"], y["n"]
        bound = F.greatest(F.abs(i - j) + F.abs(n - i - m + j), far - x["d"] - y["d"])
        return (x["comp"] != y["comp"]) & sizes_fit(n, m, num, den) & ((den + num) * bound <= most(n, m))

    each = opened.select("far", F.explode("xs").alias("x"), "ys").select("x", F.explode(F.filter("ys", lambda y: may(F.col("x"), y, F.col("far")))).alias("y"))
    swap = F.col("x.node") > F.col("y.node")
    pick = lambda f, g: F.when(swap, F.col(g)).otherwise(F.col(f))
    need = F.least(F.lit(MEETS), F.ceil(num * F.least("x.n", "y.n") / den).cast("int"))
    return (
        each.select(pick("x.node", "y.node").alias("a"), pick("y.node", "x.node").alias("b"), pick("x.n", "y.n").alias("n_a"), pick("y.n", "x.n").alias("n_b"), need.alias("need"))
        .groupBy("a", "b", "n_a", "n_b", "need").agg(F.count("*").alias("c")).filter("c >= need").drop("c", "need")
    )
