"""Ranking metrics and paired comparisons, relational and batched over queries."""

from __future__ import annotations

import math
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

K_VALUES = (1, 3, 5, 10, 20)


@dataclass(frozen=True)
class Groups:
    """Gold by groups: a query's gold ids are all others that share a group with it. queries (query_id, group), rows (id, group). The pairs,
    which grow with the square of a group's size, are never made: hits are marked by the groups of both ends, and gold ids are counted by groups."""

    queries: DataFrame
    rows: DataFrame

    def sets(self) -> tuple[DataFrame, DataFrame]:
        """The groups of each query and of each id."""
        own = F.collect_set("group")
        return self.queries.groupBy("query_id").agg(own.alias("asked")), self.rows.filter(F.col("id").isNotNull()).groupBy("id").agg(own.alias("has"))

    def mark(self, retrieved: DataFrame) -> DataFrame:
        asked, has = self.sets()
        both = retrieved.join(asked, "query_id", "left").join(has, "id", "left")
        return both.withColumn("_hit", F.when((F.col("query_id") != F.col("id")) & F.arrays_overlap("asked", "has"), True)).drop("asked", "has")

    def count(self) -> DataFrame:
        """Ids of equal sets of groups are counted together, so that ids of several groups count once."""
        asked, has = self.sets()
        sizes = has.groupBy(F.array_sort("has").alias("has")).agg(F.count("*").alias("n"))
        itself = F.coalesce(F.arrays_overlap("asked", "own"), F.lit(False)).cast("int")
        groups = asked.join(has.select(F.col("id").alias("query_id"), F.col("has").alias("own")), "query_id", "left").select("query_id", itself.alias("itself"), F.explode("asked").alias("group"))
        met = groups.join(sizes.withColumn("group", F.explode("has")), "group").select("query_id", "itself", "has", "n").distinct()
        return met.groupBy("query_id").agg((F.sum("n") - F.max("itself")).alias("n_gold")).filter("n_gold > 0")


def _mark(retrieved: DataFrame, gold: DataFrame | Groups) -> DataFrame:
    """``retrieved`` with ``_hit``, true or null."""
    if isinstance(gold, Groups):
        return gold.mark(retrieved)
    return retrieved.join(gold.select("query_id", "id").distinct().withColumn("_hit", F.lit(True)), ["query_id", "id"], "left")


def _n_gold(gold: DataFrame | Groups) -> DataFrame:
    """(query_id, n_gold) of the queries that have gold."""
    return gold.count() if isinstance(gold, Groups) else gold.select("query_id", "id").distinct().groupBy("query_id").agg(F.count("*").alias("n_gold"))


def score_rows(retrieved: DataFrame, gold: DataFrame | Groups, questions: DataFrame, keys: tuple[str, ...] = ("query_id",), ks: tuple[int, ...] = K_VALUES) -> DataFrame:
    """A row for each question (``questions`` has the keys): mrr, and recall, precision and hit at each k. retrieved (keys, id, rank from 1),
    gold (query_id, id) or groups. Repeated hits count for precision, once for recall; without gold or hits all are 0."""
    keys = list(keys)
    n_gold = _n_gold(gold)
    marked = _mark(retrieved, gold)
    hit = F.col("_hit").isNotNull()
    sums: list[Column] = [F.min(F.when(hit, F.col("rank"))).alias("first"), F.max("rank").alias("n")]
    for k in ks:
        sums += [F.count_if(hit & (F.col("rank") <= k)).alias(f"h{k}"), F.count_distinct(F.when(hit & (F.col("rank") <= k), F.col("id"))).alias(f"d{k}")]
    found = marked.groupBy(*keys).agg(*sums)
    joined = questions.select(*keys).distinct().join(found, keys, "left").join(n_gold, "query_id", "left")
    zero = F.lit(0.0)
    out = [F.coalesce(1 / F.col("first"), zero).alias("mrr")]
    for k in ks:
        out += [
            F.coalesce(F.col(f"d{k}") / F.col("n_gold"), zero).alias(f"recall_{k}"),
            F.coalesce(F.col(f"h{k}") / F.least(F.lit(k), F.col("n")), zero).alias(f"precision_{k}"),
            F.when(F.coalesce(F.col(f"h{k}"), F.lit(0)) > 0, 1.0).otherwise(0.0).alias(f"hit_{k}"),
        ]
    return joined.select(*keys, *out)


def long_scores(scores: DataFrame, keys: list[str], names: list[str]) -> DataFrame:
    return scores.unpivot(keys, names, "metric", "value")


def per_question(runs: DataFrame, gold: DataFrame | Groups, scores: DataFrame | None = None, ks: tuple[int, ...] = K_VALUES) -> DataFrame:
    """The long table of a report: a row for each question of each system, with the numbers of gold and retrieved ids, the latency and
    all metrics. runs (system, query_id, latency_s, retrieved array), both systems' rows under one another; gold (query_id, id) or groups. ``scores`` of a judge
    (system, query_id, columns) are joined by key, as ``judge_`` columns, null where there are none."""
    hits = runs.select("system", "query_id", F.posexplode("retrieved").alias("pos", "id")).withColumn("rank", F.col("pos") + 1)
    measured = score_rows(hits, gold, runs, ("system", "query_id"), ks)
    n_gold = _n_gold(gold)
    facts = runs.select("system", "query_id", "latency_s", F.size("retrieved").alias("n_retrieved")).join(n_gold, "query_id", "left")
    out = facts.withColumn("n_gold", F.coalesce("n_gold", F.lit(0))).join(measured, ["system", "query_id"])
    if scores is not None:
        names = [c for c in scores.columns if c not in ("system", "query_id")]
        out = out.join(scores.select("system", "query_id", *(F.col(c).alias(f"judge_{c}") for c in names)), ["system", "query_id"], "left")
    return out


def best_alpha(scores: DataFrame) -> DataFrame:
    """The alpha of the best mean recall@5, then mrr, both to 6 digits; ties to the smallest."""
    means = scores.groupBy("alpha").agg(F.avg("recall_5").alias("recall_5"), F.avg("mrr").alias("mrr"))
    return means.agg(F.max_by("alpha", F.struct(F.round("recall_5", 6), F.round("mrr", 6), -F.col("alpha"))).alias("alpha"))


def paired_summary(pairs: DataFrame) -> DataFrame:
    """pairs (metric, slice, a, b): for each metric over all and each slice, in one grouping-sets pass, n, means, mean
    and median difference, wins, losses and ties. NaN or null on either side drops a pair; slices without pairs have no row."""
    kept = pairs.filter(F.col("a").isNotNull() & F.col("b").isNotNull() & ~F.isnan("a") & ~F.isnan("b")).withColumn("d", F.col("b") - F.col("a"))
    d = F.col("d")
    grouped = kept.groupingSets([["metric"], ["metric", "slice"]], "metric", "slice").agg(
        F.grouping("slice").alias("g"), F.count("*").alias("n"), F.avg("a").alias("mean_a"), F.avg("b").alias("mean_b"), F.avg(d).alias("mean_delta"), F.percentile(d, 0.5).alias("median_delta"),
        F.count_if(d > 0).alias("wins_b"), F.count_if(d < 0).alias("wins_a"), F.count_if(d == 0).alias("ties"), F.try_divide(F.avg(d), F.stddev_samp(d) / F.sqrt(F.count("*"))).alias("t_stat"),
    )
    return grouped.withColumn("slice", F.when(F.col("g") == 1, "all").otherwise(F.col("slice"))).drop("g")


def wilcoxon(pairs: DataFrame) -> DataFrame:
    """(metric, slice, w_stat, z): signed ranks with average ranks for ties, without zero differences,
    tie-corrected, without continuity correction. pairs as in :func:`paired_summary`. Equal differences are counted first, so that ranks are running
    sums over a slice's distinct differences, which are few: a metric of ranks has few values, whatever the number of questions."""
    kept = pairs.filter(F.col("a").isNotNull() & F.col("b").isNotNull() & ~F.isnan("a") & ~F.isnan("b"))
    both = kept.withColumn("slice", F.explode(F.array(F.lit("all"), F.col("slice")))).withColumn("d", F.round(F.col("b") - F.col("a"), 12)).filter("d <> 0")
    by = both.groupBy("metric", "slice", F.abs("d").alias("m")).agg(F.count("*").alias("t"), F.count_if(F.col("d") > 0).alias("up"))
    w = Window.partitionBy("metric", "slice").orderBy("m").rowsBetween(Window.unboundedPreceding, -1)
    ranked = by.withColumn("r", F.coalesce(F.sum("t").over(w), F.lit(0)) + (F.col("t") + 1) / 2)
    sums = ranked.groupBy("metric", "slice").agg(F.sum("t").alias("n"), F.sum(F.col("r") * F.col("up")).alias("plus"), F.sum(F.col("r") * (F.col("t") - F.col("up"))).alias("minus"), F.sum(F.col("t") * F.col("t") * F.col("t") - F.col("t")).alias("ties"))
    n = F.col("n")
    stat = F.least("plus", "minus")
    spread = F.sqrt(n * (n + 1) * (2 * n + 1) / 24 - F.col("ties") / 48)
    return sums.select("metric", "slice", stat.alias("w_stat"), F.try_divide(stat - n * (n + 1) / 4, spread).alias("z"))


def normal_p(z: float) -> float:
    return math.erfc(abs(z) / math.sqrt(2))


def student_p(t: float, df: float) -> float:
    """Two-sided, by the continued fraction of the incomplete beta function."""
    if not math.isfinite(t):
        return 0.0 if math.isinf(t) else float("nan")
    x, a, b = df / (df + t * t), df / 2, 0.5
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x or 1e-300) + b * math.log1p(-x)) if 0 < x < 1 else 0.0
    if x >= 1:
        return 1.0

    def fraction(x: float, a: float, b: float) -> float:
        tiny, c = 1e-300, 1.0
        d = 1 - (a + b) * x / (a + 1)
        d = 1 / (d or tiny)
        h = d
        for m in range(1, 500):
            for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
                d = 1 / ((1 + num * d) or tiny)
                c = (1 + num / c) or tiny
                h *= c * d
            if abs(c * d - 1) < 1e-14:
                break
        return h

    return front * fraction(x, a, b) / a if x < (a + 1) / (a + b + 2) else 1 - front * fraction(1 - x, b, a) / b


def paired_report(pairs: DataFrame) -> DataFrame:
    """The summary with both tests and their p-values. Without any difference both p are 1 and the statistics NaN."""
    joined = paired_summary(pairs).join(wilcoxon(pairs), ["metric", "slice"], "left")

    @F.pandas_udf("struct<wilcoxon_p:double,t_p:double>")
    def tests(z: pd.Series, t: pd.Series, n: pd.Series) -> pd.DataFrame:
        flat = z.isna()
        return pd.DataFrame({"wilcoxon_p": [1.0 if f else normal_p(x) for f, x in zip(flat, z, strict=True)], "t_p": [1.0 if f else student_p(x, k - 1) if k > 1 else float("nan") for f, x, k in zip(flat, t, n, strict=True)]})

    nan = F.lit(float("nan"))
    return joined.withColumn("p", tests("z", "t_stat", "n")).select("*", "p.*").drop("p").withColumn("t_stat", F.when(F.col("z").isNull(), nan).otherwise(F.col("t_stat"))).withColumn("w_stat", F.coalesce("w_stat", nan))
