"""URL filters by a path-template tree, in DataFrame functions alone."""

from __future__ import annotations

import functools
import itertools

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexgrid.llm.common import Scratch, dealt, hot_keys
from lexgrid.llm.pages import split_url

#: The base rules.
RULES = [("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/")]


#: Rows of one key that go to one task.
HOT = 4096


def apply_rules(host, path, rules: list[tuple[str, str]]) -> tuple[F.Column, F.Column]:
    """The longest rule that fits and its verdict, or nulls. Rules of one length: the first listed."""
    rule = verdict = F.lit(None).cast("string")
    for v, r in sorted(reversed(rules), key=lambda x: len(x[1])):
        at = r.index("/")
        fits = ((host == r[:at]) | host.endswith("." + r[:at])) & path.startswith(r[at:])
        rule, verdict = F.when(fits, r).otherwise(rule), F.when(fits, v).otherwise(verdict)
    return rule, verdict


def segment_shape(segment) -> F.Column:
    """Numbers, long hexadecimal ids and dates are variable by their shape alone."""
    s = F.regexp_replace(segment, r"^[0-9a-fA-F]{8,}(?=\.|$)", "{h}")
    return F.regexp_replace(s, r"[0-9]+", "{n}")


def filter_urls(
    pages: DataFrame, rules: list[tuple[str, str]] | None = None, labels: DataFrame | None = None, id_col: str = "page_id", url_col: str = "url",
    least_distinct: int = 12, variety: float = 0.3, similar_z: float = 1.96, least_labelled: int = 8, strength: float = 4.0, reject: float = 0.8,
) -> DataFrame:
    """(id, host, path, rule, verdict, template, purity) of every row.

    A host's tree has a node for each prefix of its paths' segments, with its wildcards set, as deep as they go. A
    segment is a wildcard if its shape varies, or if its parent has at least ``least_distinct`` different children, one for
    each 1/``variety`` pages or fewer. A page's label is ``block`` or ``allow``: the rule's, or that of ``labels``
    (id, blocked boolean).

    Branches of a host are merged in two ways. Templates that differ in their first segment alone, with ``least_labelled`` labels on both sides,
    pool their labels where their labelled shares of blocked pages differ by under ``similar_z`` standard errors. A template with fewer
    labels, none included, takes those of the branches that are built like its own: of the same children (those of a twentieth of
    the pages or more, at least two, as one child tells nothing), in shares that a chi-square test against the rest doesn't part.

    A template's purity is its blocked labels' share, smoothed by ``strength`` labels of one half. Without labels it's the branch's purity, and
    without labels there the host's; there, all pages count, those without a label as allowed, so that a branch or host rejects the
    rest of its pages only if nearly all are blocked. At ``reject`` or more the template is blocked; a page without a rule gets its template's verdict.

    Null urls and urls without ``://`` have an empty host and path and the verdict of that template; repeated rows
    are judged each; a page labelled twice counts as blocked if either is; an empty table gives an empty result; other columns
    are ignored. All counts are added up before they move, by host and path; rows of a hot host, node or template are dealt over tasks.
    A level of the tree is a job, as long as nodes have ``least_distinct`` paths; a lone path of any depth costs none of its own."""
    host, path = split_url(F.col(url_col))
    rule, verdict = apply_rules(F.col("_host"), F.col("_path"), RULES if rules is None else rules)
    rows = pages.select(F.col(id_col), host.alias("_host"), path.alias("_path")).withColumns({"_rule": rule, "_said": verdict})
    labelled = rows.select("*", (F.col("_said") == "block").cast("int").alias("_bad"))
    if labels is not None:
        own = labels.groupBy(id_col).agg(F.max(F.col("blocked").cast("int")).alias("_l"))
        labelled = rows.join(own, id_col, "left").withColumn("_bad", F.coalesce((F.col("_said") == "block").cast("int"), F.col("_l"))).drop("_l")

    scratch = Scratch(pages.sparkSession)
    shaped = labelled.withColumn("_segs", F.transform(F.split(F.regexp_replace("_path", "^/", ""), "/"), segment_shape))
    sums = [F.sum(c).alias(c) for c in ("_n", "_labels", "_blocks")]
    paths = scratch.keep(
        shaped.groupBy("_host", "_segs").agg(F.count("*").alias("_n"), F.count("_bad").alias("_labels"), F.coalesce(F.sum("_bad"), F.lit(0)).alias("_blocks"))
    )
    # level by level, children are counted by value and then by node, whose own wildcards are set; a node of
    # too few paths has no wildcard below it
    at, ends, written = paths.select("_host", "_segs", "_n", F.lit("").alias("_parent")), [], paths
    for d in itertools.count():
        level = at.withColumn("_seg", F.get("_segs", F.lit(d)))
        hot = None if written.count() <= HOT else hot_keys(scratch, at, ["_host", "_parent"], HOT)
        nodes = (
            level.groupBy("_host", "_parent", "_seg").agg(F.sum("_n").alias("_n"), F.count("*").alias("_paths"))
            .groupBy("_host", "_parent").agg(F.count("*").alias("_kinds"), F.sum("_n").alias("_n"), F.sum("_paths").alias("_paths"))
            .select("_host", "_parent", F.when(F.col("_paths") >= least_distinct, (F.col("_kinds") >= least_distinct) & (F.col("_kinds") >= variety * F.col("_n"))).alias("_wide"))
        )
        rest = F.array_join(F.slice("_segs", F.lit(d + 1), F.size("_segs") - d), "/")
        shown = F.when(F.col("_wide").isNull(), rest).when(F.col("_wide"), "*").otherwise(F.col("_seg"))
        done = F.col("_wide").isNull() | (F.size("_segs") == d + 1)
        joined = scratch.keep(dealt(level, nodes, ["_host", "_parent"], "_segs", hot).select("_host", "_segs", "_n", F.concat("_parent", F.lit("/"), shown).alias("_parent"), done.alias("_done")))
        ends.append(joined.filter("_done").select("_host", "_segs", F.col("_parent").alias("_template")))
        at, written = joined.filter(~F.col("_done")).drop("_done"), joined
        if at.isEmpty():
            break
    templates = functools.reduce(DataFrame.unionByName, ends)
    known = scratch.keep(paths.join(templates, ["_host", "_segs"]))
    by_template = scratch.keep(
        known.groupBy("_host", "_template").agg(*sums).withColumns({"_branch": F.regexp_extract("_template", r"^(/[^/]*)", 1), "_tail": F.regexp_replace("_template", r"^/[^/]*", "/*")})
    )
    tails = by_template.groupBy("_host", "_tail").agg(F.sum("_labels").alias("_all"), F.sum("_blocks").alias("_bad"))
    branches = scratch.keep(by_template.groupBy("_host", "_branch").agg(F.sum("_n").alias("_bn"), F.sum("_labels").alias("_bl"), F.sum("_blocks").alias("_bb")))
    hosts = branches.groupBy("_host").agg(F.sum("_bn").alias("_hn"), F.sum("_bl").alias("_hl"), F.sum("_bb").alias("_hb"))
    pooled = dealt(by_template, tails, ["_host", "_tail"], "_template", hot_keys(scratch, by_template, ["_host", "_tail"], HOT))
    pooled = dealt(pooled, branches, ["_host", "_branch"], "_template", hot_keys(scratch, by_template, ["_host", "_branch"], HOT))
    pooled = dealt(pooled, hosts, "_host", "_template", hot_keys(scratch, by_template, "_host", HOT))
    built = _alike_branches(scratch, by_template, branches, similar_z)
    pooled = pooled.join(built, ["_host", "_template"], "left")
    rate, rest_n = F.try_divide("_blocks", "_labels"), F.col("_all") - F.col("_labels")
    mean, rest = F.try_divide("_bad", "_all"), F.try_divide(F.col("_bad") - F.col("_blocks"), rest_n)
    error = F.sqrt(mean * (1 - mean) * (F.try_divide(F.lit(1), "_labels") + F.try_divide(F.lit(1), rest_n)))
    alike = F.coalesce((F.col("_labels") >= least_labelled) & (rest_n >= least_labelled) & (F.abs(rate - rest) <= similar_z * error), F.lit(False))
    taken = F.col("_al").isNotNull() & (F.col("_labels") < least_labelled)
    n, bad = (F.when(alike, F.col(a)).when(taken, F.col(b)).otherwise(F.col(c)) for a, b, c in (("_all", "_al", "_labels"), ("_bad", "_ab", "_blocks")))
    smooth = lambda b, n: (b + strength / 2) / (n + strength)
    purity = F.when(n > 0, smooth(bad, n)).when(F.col("_bl") > 0, smooth(F.col("_bb"), F.col("_bn"))).when(F.col("_hl") > 0, smooth(F.col("_hb"), F.col("_hn"))).otherwise(0.5)
    judged = pooled.select("_host", "_template", F.round(purity, 6).alias("purity"))
    named = known.select("_host", "_segs", "_template")
    verdicts = dealt(named, judged, ["_host", "_template"], "_segs", hot_keys(scratch, known, ["_host", "_template"], HOT))
    return dealt(shaped, verdicts, ["_host", "_segs"], id_col, hot_keys(scratch, shaped, ["_host", "_segs"], HOT)).select(
        id_col, F.col("_host").alias("host"), F.col("_path").alias("path"), F.col("_rule").alias("rule"),
        F.coalesce("_said", F.when(F.col("purity") >= reject, "block").otherwise("allow")).alias("verdict"), F.col("_template").alias("template"), "purity",
    )


def _alike_branches(scratch: Scratch, by_template: DataFrame, branches: DataFrame, similar_z: float) -> DataFrame:
    """(_host, _template, _al, _ab): the labels and blocked labels of the branches that are built like a template's own, itself included.
    Branches with the same main children are one pool, and each is compared with the rest of its pool, so that no pairs of branches are made."""
    main = dealt(by_template, branches.select("_host", "_branch", "_bn"), ["_host", "_branch"], "_template", hot_keys(scratch, by_template, ["_host", "_branch"], HOT))
    main = scratch.keep(main.filter("20 * _n >= _bn"))
    built = main.groupBy("_host", "_branch").agg(F.md5(F.array_join(F.sort_array(F.collect_set("_tail")), "\n")).alias("_sig"), F.count("*").alias("_kinds"), F.sum("_n").alias("_inside")).filter("_kinds >= 2")
    rows = scratch.keep(main.join(built, ["_host", "_branch"]))  # twenty rows of a branch at most
    one = rows.select("_host", "_branch", "_sig", "_bn", "_inside").distinct()
    pools = one.groupBy("_host", "_sig").agg(F.sum("_bn").alias("_pn"), F.sum("_inside").alias("_pin"))
    shares = rows.groupBy("_host", "_sig", "_tail").agg(F.sum("_n").alias("_pt"))
    each = dealt(rows, shares, ["_host", "_sig", "_tail"], "_branch", hot_keys(scratch, rows, ["_host", "_sig", "_tail"], HOT))
    each = dealt(each, pools, ["_host", "_sig"], "_branch", hot_keys(scratch, rows, ["_host", "_sig"], HOT)).filter("_pn > _bn")
    own, rest = F.col("_bn"), F.col("_pn") - F.col("_bn")

    def term(n, total) -> F.Column:
        return F.coalesce(F.try_divide(F.pow(F.sqrt(rest / own) * n - F.sqrt(own / rest) * (total - n), F.lit(2)), total), F.lit(0.0))

    more = F.col("_pn") - F.col("_pin")
    chi = F.sum(term(F.col("_n"), F.col("_pt"))) + F.first(term(own - F.col("_inside"), more))
    free = F.first(F.col("_kinds")) - 1 + F.first((more > 0).cast("int"))
    alike = each.groupBy("_host", "_branch").agg(chi.alias("_chi"), free.alias("_free")).filter(F.col("_chi") <= F.col("_free") + similar_z * F.sqrt(2 * F.col("_free"))).select("_host", "_branch")
    mine = scratch.keep(rows.join(alike, ["_host", "_branch"]))
    sums = mine.groupBy("_host", "_sig", "_tail").agg(F.sum("_labels").alias("_al"), F.sum("_blocks").alias("_ab"))
    return dealt(mine, sums, ["_host", "_sig", "_tail"], "_branch", hot_keys(scratch, mine, ["_host", "_sig", "_tail"], HOT)).select("_host", "_template", "_al", "_ab")
