"""Secret scans by corpus-wide ownership frequency."""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexgrid.llm.common import Scratch, dealt, hot_keys, map_rows

#: The base kinds in the order in which spans with one start are listed,
#: each with its pattern, the group that is the value and the least length of that group.
BASE = {
    "assign": (re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A), 2, 6),
    "access": (re.compile(r"AKIA[A-Z0-9]+"), 0, 20),
    "hex": (re.compile(r"[0-9a-f]{24,}"), 0, 24),  # the runs that [0-9a-f]+ finds, without the short ones
}
#: Kinds of the method's own, listed after the base kinds.
ADDED = {
    "jwt": (re.compile(r"\beyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", re.A), 0, 1),
    "pem": (re.compile(r"-----BEGIN [A-Z ]*PRIVATE KEY-----[^-]*(?:-----END [A-Z ]*PRIVATE KEY-----)?"), 0, 1),
    "vendor": (re.compile(r"\b(?:gh[pousr]_[A-Za-z0-9]{30,}|xox[abpr]-[A-Za-z0-9-]{10,}|sk_live_[A-Za-z0-9]{16,})", re.A), 0, 1),
}
KINDS = {**BASE, **ADDED}
PLACEHOLDER = re.compile(r"example|changeme|dummy|sample|placeholder|redacted|x{6,}|0{12,}|123456", re.I | re.A)
FINDING = "kind:string,start:int,end:int,base:boolean,secret:string,looks_live:boolean"


#: Findings of one value that go to one task.
HOT = 4096


def entropy(value: str) -> float:
    n = len(value)
    return -sum(c / n * math.log2(c / n) for c in Counter(value).values()) if n else 0.0


def findings(text: str) -> list[dict]:
    """All spans by start, then kind; ``secret`` is the SHA-256 of the value alone, so
    that one value is one secret whatever surrounds it."""
    out = []
    for k, (pattern, group, least) in KINDS.items():
        for m in pattern.finditer(text):
            value = m[group]
            if len(value) >= least:
                live = entropy(value) >= 2.5 and not PLACEHOLDER.search(value)
                out.append({"kind": k, "start": m.start(), "end": m.end(), "base": k in BASE, "secret": hashlib.sha256(value.encode()).hexdigest(), "looks_live": live})
    order = list(KINDS)
    return sorted(out, key=lambda f: (f["start"], order.index(f["kind"])))


def scan_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", repo_col: str = "doc_id", owner_col: str = "source", wide_owners: int = 3, wide_repos: int = 20) -> DataFrame:
    """(id, findings) of every row. A finding has its kind, code points (end exclusive), whether
    it is a base kind, the value's hash, the distinct repositories and owners over the
    whole corpus that hold the value, and a verdict: ``example`` if it doesn't look live, or ``wide_owners`` owners
    or ``wide_repos`` repositories or more hold it, ``live`` if one owner holds it in fewer repositories, else ``shared``.

    Null or empty texts have no findings; texts of any length are read whole; a null owner or repository counts as one
    of its own; repeated rows are scanned each and count once for each repository; an empty
    table gives an empty result; other columns are ignored. Ownership is counted in three steps (distinct triples,
    then pairs, then values), and the findings of a hot value are dealt over tasks when they get its counts."""
    scratch = Scratch(docs.sparkSession)
    kind = dict(docs.dtypes)[id_col]
    named = [F.coalesce(F.col(c).cast("string"), F.lit("")).alias(n) for c, n in ((repo_col, "_repo"), (owner_col, "_owner"))]
    rows = docs.select(F.col(id_col), F.coalesce(F.col(text_col), F.lit("")).alias("_text"), *named)

    def start():
        return lambda ids, text, repo, owner: [ids, repo, owner, [findings(t) for t in text]]

    found = scratch.keep(
        map_rows(rows, f"`{id_col}` {kind}, _repo string, _owner string, _found array<struct<{FINDING}>>", start)
        .withColumn("_row", F.monotonically_increasing_id())
    )
    one = found.select("_row", id_col, "_repo", "_owner", F.posexplode("_found").alias("_pos", "_f"))
    owners = scratch.keep(
        one.select(F.col("_f.secret").alias("secret"), "_owner", "_repo").distinct()
        .groupBy("secret", "_owner").agg(F.count("*").alias("n"))
        .groupBy("secret").agg(F.sum("n").alias("n_repos"), F.count("*").alias("n_owners"))
    )
    f = F.col("_f")
    valued = one.withColumn("secret", f["secret"])
    wide = (F.col("n_owners") >= wide_owners) | (F.col("n_repos") >= wide_repos)
    verdict = F.when(wide | ~f["looks_live"], "example").when(F.col("n_owners") == 1, "live").otherwise("shared")
    judged = (
        dealt(valued, owners, "secret", "_row", hot_keys(scratch, valued, "secret", HOT))
        .select("_row", id_col, F.struct("_pos", f["kind"].alias("kind"), f["start"].alias("start"), f["end"].alias("end"), f["base"].alias("base"), "secret", "n_repos", "n_owners", verdict.alias("verdict")).alias("_x"))
        .groupBy("_row", id_col).agg(F.sort_array(F.collect_list("_x")).alias("findings"))
        .select(id_col, "findings")
    )
    shape = judged.schema["findings"].dataType
    none = found.filter(F.size("_found") == 0).select(id_col, F.array().cast(shape).alias("findings"))
    return none.unionByName(judged)


def span_text(spans) -> F.Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
