"""HTML extraction with nearest-URL page differencing."""

from __future__ import annotations

import html
import math
import re

import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexgrid.llm.common import Scratch, indexed, map_rows

TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:"[^"]*"|'[^']*'|[^'">])*)(?:>|\Z)|<[!?/][^>]*(?:>|\Z)|<(?:[a-zA-Z][^>]*)\Z""", re.S)
ATTRIBUTE = re.compile(r"""\b(class|id|role|hidden|aria-hidden)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.I)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template textarea title iframe svg math object".split())
SKIP = frozenset("nav footer aside form head button select menu dialog".split())
BLOCK = frozenset(
    "address article aside blockquote body center dd details div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html li main nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
HEADING = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Class, id and role words of what isn't the article.
ROLE = re.compile(
    r"ad|ads|advert\w*|adsense|banner\w*|sponsor\w*|promo\w*|cookies?\w*|consent|gdpr|notices?|alerts?|sidebar\w*|comments?|disqus|respond|footer|header|masthead|nav|navbar|navigation|menu\w*|breadcrumbs?|pagination|pager|share|sharing|social|related|recommended|newsletter|subscribe|popup|modal|widgets?|toolbar|complementary|contentinfo|search|skip",
    re.I,
)
#: Words that may stand beside them in a name of several words; with another word, as in ``search-engine``, the name says nothing certain.
BESIDE = frozenset(
    "area article back bar block body bottom box btn button buttons card cat center col column container content count entry field fixed form global group head heading holder icon icons image img inner input item items js label left line link links list lower main media mobile module outer overlay page panel post posts primary region right row secondary section side sidebar site sticky sub text thread title to toggle top unit upper wrap wrapper zone".split()
)
#: Of an ``article`` element, the words that make it a reader's comment or a teaser of another page.
OTHER = re.compile(r"comments?|reply|replies|respond|teasers?|related|recommended|promo\w*|preview|sponsor\w*|advert\w*|ad", re.I)


def blocks(page: str) -> list[tuple[str, str]]:
    """(text, kind) of each block with a word, in page order; kind is ``article``, ``main``,
    ``body`` or ``skip`` (menus, headers, footers, sidebars, notices, adverts, forms, comments and teasers of other pages), or one of the first three with ``?``
    where a name only may mean such a part. An article is a teaser by its name, or if its heading is a link and another article's isn't."""
    out: list[tuple[str, str, int]] = []
    number, headed, linked = 0, set(), set()  # of the article, those that have a heading, and those whose heading is a link
    stack: list[tuple[str, str]] = []  # tag, kind
    kind, parts, at = "body", [], 0

    def close() -> None:
        if parts:
            if text := " ".join(html.unescape("".join(parts)).split()):
                out.append((text, kind, number if any(t == "article" for t, _ in stack) else 0))
            parts.clear()

    while at < len(page):
        m = TAG.search(page, at)
        if not m:
            parts.append(page[at:])
            break
        if m.start() > at:
            parts.append(page[at : m.start()])
        at = m.end()
        tag = (m[2] or "").lower()
        if not tag:
            continue
        if tag in RAW and not m[1]:
            end = re.compile(rf"</{tag}\s*(?:>|\Z)", re.I).search(page, at)
            at = at if m[0].endswith("/>") and tag in ("svg", "math") else end.end() if end else len(page)
            parts.append(" ")
            continue
        if tag in BLOCK:
            close()
        elif tag == "br":
            parts.append(" ")
        if tag in VOID:
            continue
        if m[1]:
            depth = next((i for i in range(len(stack) - 1, -1, -1) if stack[i][0] == tag), None)
            if depth is not None:
                if any(k != kind for _, k in stack[depth:]) or depth and stack[depth - 1][1] != kind:
                    close()
                del stack[depth:]
                kind = stack[-1][1] if stack else "body"
            continue
        if tag in BLOCK and stack and (stack[-1][0] == "p" or stack[-1][0] == tag in ("li", "dt", "dd", "td", "th", "tr")):
            stack.pop()
            kind = stack[-1][1] if stack else "body"
        inner = kind
        names = [t for t, _ in stack]
        if tag == "article" and "article" not in names:
            number += 1
        if "article" in names and tag in HEADING:
            headed.add(number)
        if "article" in names and (tag == "a" and not HEADING.isdisjoint(names) or tag in HEADING and "a" in names):
            linked.add(number)
        if kind != "skip":
            inner = "article" if tag == "article" else "main" if tag == "main" and kind == "body" else kind
            aside = _aside(tag, m[3]) if m[3] else ""
            if tag in SKIP or tag == "header" and kind != "article" or aside == "skip":
                inner = "skip"
            elif aside and kind in ("article", "main", "body"):
                inner = kind + "?"
            elif m[3] and kind == "body" and re.search(r"""\brole\s*=\s*["']?(?:main|article)\b""", m[3], re.I):
                inner = "main"
        if tag == "header" and kind == "article":
            inner = "headline"
        elif kind == "headline" and tag in HEADING:
            inner = "article"
        if inner != kind:
            close()
        stack.append((tag, inner))
        kind = inner
    close()
    if any(k == "article" and n in headed - linked for _, k, n in out):
        out = [(t, "skip" if n in linked and k != "skip" else k, n) for t, k, n in out]
    return [(t, "skip" if k.startswith("headline") else k) for t, k, _ in out]


def _aside(tag: str, attributes: str) -> str:
    """``skip`` if the attributes name a part that isn't the article, ``?`` if they may, else nothing."""
    if tag in ("html", "body", "main"):
        return ""
    found = ""
    for m in ATTRIBUTE.finditer(attributes):
        name, value = m[1].lower(), m[2] or m[3] or m[4] or ""
        if name == "hidden" and not value or name == "aria-hidden" and value == "true":
            return "skip"
        for word in value.split() if name in ("class", "id", "role") else ():
            parts = [x for x in re.split(r"[-_]+", word.lower().replace("side-bar", "sidebar")) if x]
            if tag == "article":
                if any(OTHER.fullmatch(x) for x in parts):
                    return "skip"
            elif any(ROLE.fullmatch(x) for x in parts):
                if all(ROLE.fullmatch(x) or x in BESIDE or x.isdigit() for x in parts):
                    return "skip"
                found = "?"
    return found


def common_lines(a: list[int], b: list[int]) -> list[int]:
    """Positions in ``a`` of a longest common subsequence with ``b``, in bits: after each line of ``b`` the zeros of a row are the
    positions where the length grows. Of the rows every k-th is kept, and those between are made again on the way back, so that
    pages of any length are aligned exactly, and by one method."""
    masks: dict[int, int] = {}
    for i, x in enumerate(a):
        masks[x] = masks.get(x, 0) | 1 << i
    b = [m for x in b if (m := masks.get(x))]
    full = (1 << len(a)) - 1

    def rows(s: int, some: list[int]) -> list[int]:
        out = []
        for m in some:
            u = s & m
            s = ((s + u) | (s - u)) & full
            out.append(s)
        return out

    k = max(64, math.isqrt(len(b)))
    kept = [full]
    for j in range(0, len(b), k):
        kept.append(rows(kept[-1], b[j : j + k])[-1])
    out, end = [], len(a)  # of what lies before ``end`` in a
    for j in range((len(b) - 1) // k, -1, -1):
        block = [kept[j], *rows(kept[j], b[j * k : (j + 1) * k])]
        for t in range(len(block) - 1, 0, -1):
            end = (~block[t] & ((1 << end) - 1)).bit_length()  # the last line of a that makes it longer
            if not end:
                return out[::-1]
            if block[t - 1] >> (end - 1) & 1:  # not without this line of b
                end -= 1
                out.append(end)
    return out[::-1]


def wanted(kinds: list[str]) -> str:
    """The kind of the blocks that are a page's text."""
    return next((k for k in ("article", "main") if k in kinds or k + "?" in kinds), "body")


def of_kind(kinds: list[str], kind: str) -> list[int]:
    return [i for i, k in enumerate(kinds) if k.rstrip("?") == kind]


def shared_lines(own: dict, other: dict, copy_share: float) -> list[int] | None:
    """The text lines of ``own`` that the other page shares; None if the two are copies of one another,
    from which nothing can be told. Menus and the like don't count. An article is aligned with the other's article alone, and is a copy
    if the shorter of both is shared."""
    kinds, size = own["kinds"], own["sizes"]
    if wanted(kinds) == "article":
        mine, theirs = (of_kind(x["kinds"], "article") for x in (own, other))
        same = [mine[i] for i in common_lines([own["lines"][i] for i in mine], [other["lines"][i] for i in theirs])]
        total = min(sum(size[i] for i in mine), sum(other["sizes"][i] for i in theirs))
        return None if not theirs or sum(size[i] for i in same) > copy_share * total else same
    text = of_kind(kinds, wanted(kinds))
    same = sorted(set(common_lines(own["lines"], other["lines"])).intersection(text))
    return None if sum(size[i] for i in same) > copy_share * sum(size[i] for i in text) else same


#: Pages of one group, in the order of hosts and paths, and pages on each side that come with it.
GROUP, REACH = 256, 4
#: A line inside an article goes only if the so many nearest articles hold it, or all that there are, at least LEAST.
WITNESSES, LEAST = 4, 3


def _common_path(a: str, b: str) -> int:
    return next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))


def article_lines(own: dict, near: list[dict], copy_share: float) -> list[int]:
    """The lines of ``own``'s article that the nearest articles of its host that aren't copies of it all hold; of
    a line in a part whose name may not mean the article, the nearest one decides."""
    found: list[set[int]] = []
    for other in near:
        if (same := shared_lines(own, other, copy_share)) is not None:
            found.append(set(same))
            if not same or len(found) == WITNESSES:
                break
    unsure = {i for i in found[0] if own["kinds"][i].endswith("?")} if found else set()
    return sorted(unsure | (set.intersection(*found) if len(found) >= LEAST else set()))


def _nearer(own: dict, others: list[dict], copy_share: float) -> list[int] | None:
    """The shared lines of the first that isn't a copy, by the longer common path, ties to the earlier; None if all are."""
    found = (shared_lines(own, x, copy_share) for x in sorted(others, key=lambda x: -_common_path(x["path"], own["path"])))
    return next((g for g in found if g is not None), None)


def differences(pages: list[dict], first: int, copy_share: float) -> dict:
    """What goes from the pages of one group, which starts at ``first``; ``pages``, in order, has those beside it too.
    ``open`` are the pages amid a run of copies that reaches beyond ``pages``, with the bounds of the run
    that were seen; ``low`` and ``high`` are the group's first and last bound (the first page of a run), -1 for none."""
    gone, open_ = [], []
    at = {p["idx"]: p for p in pages}
    known: dict[int, bool] = {}

    def bound(i: int) -> bool:
        """Whether page i isn't a copy of the one before it, nor that one of page i."""
        if i not in known:
            a, b = at[i - 1], at[i]
            known[i] = a["host"] != b["host"] or all(shared_lines(x, y, copy_share) is not None for x, y in ((a, b), (b, a)))
        return known[i]

    bottom, top = pages[0]["idx"], pages[-1]["idx"]
    mine = [p for p in pages if first <= p["idx"] < first + GROUP]
    starts = ends = None  # of the run last looked at
    for own in mine:
        i = own["idx"]
        near = [x for by in range(1, REACH + 1) for x in (at.get(i - by), at.get(i + by)) if x and x["host"] == own["host"]]
        if wanted(own["kinds"]) == "article":
            lines = article_lines(own, near, copy_share)
        else:
            beside = [x for x in near if abs(x["idx"] - i) == 1]
            lines = _nearer(own, beside, copy_share)
            if lines is None and beside:
                if ends is None or i >= ends:
                    starts = next((k for k in range(i, bottom, -1) if bound(k)), -1)
                    ends = next((k for k in range(i + 1, top + 1) if bound(k)), top + 1)
                if starts < 0 < bottom or ends > top:
                    open_.append(own | {"from": starts if starts >= 0 or bottom else 0, "to": ends if ends <= top else -1})
                else:
                    beyond = [x for k in (starts - 1, ends) if (x := at.get(k)) and x["host"] == own["host"]]
                    lines = _nearer(own, beyond, copy_share)
        if lines:
            gone.append({"host": own["host"], "key": own["key"], "size": own["size"], "gone": lines})
    inner = [p["idx"] for p in mine if p["idx"] > bottom]
    low = next((k for k in inner if bound(k)), -1)
    return {"gone": gone, "open": open_, "low": low, "high": next((k for k in reversed(inner) if bound(k)), -1)}


def split_url(url) -> tuple[F.Column, F.Column]:
    """Host (A-Z lower-cased) and path; both empty for null or no ``://``."""
    u = F.coalesce(url, F.lit(""))
    at = F.locate("://", u)
    rest = F.when(at > 0, F.substr(u, at + 3)).otherwise("")
    host = F.regexp_extract(rest, r"^([^/?#]*)", 1)
    after = F.substr(rest, F.length(host) + 1)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.regexp_extract(after, r"^([^?#]*)", 1)


def extract_pages(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", copy_share: float = 0.8) -> DataFrame:
    """(id, url, text, n_chars) of every row.

    Blocks in menus, headers, footers, sidebars, notices, adverts, forms, comments and teasers go by tag,
    class or role. If a page has an article, its blocks are the text; else the main element's, else all other blocks.
    Then page differencing: the distinct pages of a host are ordered by path, each is aligned with its nearer neighbour
    (the longer common path, ties to the earlier), line by line as a longest common subsequence, and
    lines that both hold are deleted. A line inside an article is deleted if the four nearest articles within
    four pages on each side hold it (all there are, at least three); where a part's name only may mean a menu or the like (``search-engine``),
    its lines go if the nearest article holds them, and stay without one. Neighbours sharing over ``copy_share`` of a page's text
    (of the shorter article's) are copies and delete nothing; a page between two copies is compared with the pages beyond the run of copies. Only line hashes are sorted and grouped; a host of any size is dealt by ranges of its paths.

    Null html gives an empty text, a null url one on the empty host; broken markup is read as far as it
    goes; repeated rows are extracted each and aren't each other's neighbours; an empty table gives an empty
    result; other columns are ignored."""
    spark = pages.sparkSession
    scratch = Scratch(spark)
    kind = dict(pages.dtypes)[id_col]
    host, path = split_url(F.col(url_col))
    body = F.coalesce(F.col(html_col), F.lit(""))
    rows = pages.select(F.col(id_col).alias("_id"), F.col(url_col).alias("_url"), body.alias("_html"), host.alias("_host"), path.alias("_path"), F.xxhash64(body).alias("_key"), F.length(body).alias("_size"))

    def hashes():
        def step(host, path, key, size, page):
            found = [blocks(p) for p in page]
            lines = [[xxhash.xxh64_intdigest(t) - (1 << 63) for t, _ in f] for f in found]
            return [host, path, key, size, lines, [[k for _, k in f] for f in found], [[len(t) for t, _ in f] for f in found]]

        return step

    thin = map_rows(rows.select("_host", "_path", "_key", "_size", "_html"), "_host string, _path string, _key long, _size int, _lines array<long>, _kinds array<string>, _sizes array<int>", hashes)
    distinct = thin.groupBy("_host", "_key", "_size").agg(F.min(F.struct("_path", "_lines", "_kinds", "_sizes")).alias("_m")).select("_host", "_key", "_size", "_m.*")
    order = scratch.keep(indexed(scratch, distinct, "_host", "_path", "_key", "_size"))

    idx = F.col("idx")
    page = F.struct("idx", *(F.col(f"_{c}").alias(c) for c in ("host", "path", "key", "size", "lines", "kinds", "sizes")))
    groups = F.explode(F.array_distinct(F.array(*(F.floor(F.greatest(idx + by, F.lit(0)) / GROUP) for by in (-REACH, 0, REACH)))))
    grouped = order.select(groups.alias("_group"), page.alias("_page")).groupBy("_group").agg(F.sort_array(F.collect_list("_page")).alias("_pages"))

    def differ():
        return lambda group, pages: [group, *zip(*([d[c] for c in ("gone", "open", "low", "high")] for d in (differences(p, g * GROUP, copy_share) for g, p in zip(group, pages, strict=True))), strict=True)]

    lost = "host:string,key:long,size:int,gone:array<int>"
    whole = "idx:long,host:string,path:string,key:long,size:int,lines:array<long>,kinds:array<string>,sizes:array<int>"
    found = scratch.keep(map_rows(grouped, f"_group long, _gone array<struct<{lost}>>, _open array<struct<{whole},from:long,to:long>>, _low long, _high long", differ))
    flat = lambda rows: rows.select(*(F.col(f"_x.{c}").alias(f"_{c}") for c in ("host", "key", "size", "gone")))
    gone = flat(found.select(F.explode("_gone").alias("_x")))
    inside = found.select("_group", F.explode("_open").alias("_x"))
    if not inside.isEmpty():  # runs of copies over more than a group: their bounds by group, one entry for each
        bounds = [(r["_group"], r["_low"], r["_high"]) for r in found.select("_group", "_low", "_high").collect()]
        bounds.sort()
        before, after, last, following = {}, {}, 0, -1
        for g, _, high in bounds:
            before[g] = last
            last = high if high >= 0 else last
        for g, low, _ in reversed(bounds):
            after[g] = following
            following = low if low >= 0 else following
        carried = spark.createDataFrame([(g, before[g], after[g]) for g, *_ in bounds], "_group long, _before long, _after long")
        ends = inside.join(F.broadcast(carried), "_group").select(
            "_x", (F.when(F.col("_x.from") >= 0, F.col("_x.from")).otherwise(F.col("_before")) - 1).alias("_l"), F.when(F.col("_x.to") >= 0, F.col("_x.to")).otherwise(F.col("_after")).alias("_r")
        )
        for c in ("_l", "_r"):
            ends = ends.join(order.select(idx.alias(c), page.alias(f"{c}p")), c, "left")

        def beyond():
            def step(own, left, right):
                lines = [_nearer(o, [x for x in both if x and x["host"] == o["host"]], copy_share) for o, *both in zip(own, left, right, strict=True)]
                return [[{"host": o["host"], "key": o["key"], "size": o["size"], "gone": g} if g else None for o, g in zip(own, lines, strict=True)]]

            return step

        gone = gone.unionByName(flat(map_rows(ends.select("_x", "_lp", "_rp"), f"_x struct<{lost}>", beyond).filter("_x is not null")))
    gone = scratch.keep(gone)

    def finish():
        def step(ids, url, page, gone):
            out = []
            for p, g in zip(page, gone, strict=True):
                found = blocks(p)
                kinds = [k for _, k in found]
                drop = set(g or ())
                out.append(" ".join(found[i][0] for i in of_kind(kinds, wanted(kinds)) if i not in drop))
            return [ids, url, out, [len(t) for t in out]]

        return step

    if gone.isEmpty():
        joined = rows.withColumn("_gone", F.lit(None).cast("array<int>"))
    else:
        joined = rows.join(gone, ["_host", "_key", "_size"], "left")
    url_kind = dict(pages.dtypes)[url_col]
    return map_rows(joined.select("_id", "_url", "_html", "_gone"), f"`{id_col}` {kind}, `{url_col}` {url_kind}, text string, n_chars long", finish)
