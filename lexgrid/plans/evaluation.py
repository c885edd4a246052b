"""Queries of the evaluation flow: seeding, splits, gold lists, both systems' rows, and judge scores."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexgrid.operators import experiment, metrics, retrieval
from lexgrid.plans import catalog as C  # read only when a query runs or SQL is made; the catalog is whole by then

table = C.table
SQL: dict[str, str] = {}


def _seeded(spark, sf_dir, mode: str) -> tuple[DataFrame, DataFrame]:
    """Seeds of the benchmark's items in a mode, and the items' vectors."""
    pooled = C.pool(spark, sf_dir)
    items = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"))
    queries = C.vectors(spark, sf_dir)[1].join(items, F.col("id") == F.col("query_id")).select("query_id", "vector")
    return retrieval.seeds(mode, pooled, lambda p: C.lexical(spark, sf_dir, p), C.TOP_K), queries


def hybrid_graph_rerank(spark, sf_dir):
    """Hybrid seeds, their graph, re-ranked with alpha 0.1; and as a row of its own the seeds' ranking, which alpha 0 doesn't give back."""
    seeds, queries = _seeded(spark, sf_dir, "hybrid")
    seeds = C.Scratch(spark).keep(seeds)
    found = C.gathered(spark, sf_dir, seeds.drop("rank"), queries)
    out = retrieval.rerank(found, [0.1], C.TOP_K).select(F.lit("graph").alias("system"), "query_id", "id", "score", "rank")
    base = seeds.select(F.lit("baseline").alias("system"), "query_id", "id", F.col("sim").alias("score"), "rank")
    return out.unionByName(base).select("system", "query_id", "id", F.round("score", 6).alias("score"), F.col("rank").cast("long").alias("rank"))


def dense_graph_rerank(spark, sf_dir):
    """The same items from dense seeds."""
    seeds, queries = _seeded(spark, sf_dir, "dense")
    return retrieval.rerank(C.gathered(spark, sf_dir, seeds.drop("rank"), queries), [0.1], C.TOP_K).select("query_id", "id", F.round("score", 6).alias("score"), F.col("rank").cast("long").alias("rank"))


def _graph_sql(seeds: str) -> str:
    """The candidates of seeds (query_id, id, sim) for the items' vectors, and their ranking with alpha 0.1."""
    after = C.CANDIDATES.split("seeds AS (", 1)[1].split("),", 1)[1]
    edges = C.CANDIDATES.split(C.DENSE, 1)[1].split("seeds AS (", 1)[0].lstrip(",\n").rstrip().rstrip(",")
    return f"q AS (SELECT item_id AS query_id, embedding::DOUBLE[] AS v FROM benchmark JOIN embeddings ON vec_id = item_id), {edges}, seeds AS ({seeds}), {after}, al AS (SELECT 0.1::DOUBLE AS alpha), {C.RERANK}"


SQL["hybrid_graph_rerank"] = f"""WITH {C.HYBRID}, {_graph_sql('SELECT query_id, id, sim FROM hy')} SELECT 'graph' AS system, query_id, id, round(score, 6) AS score, rank FROM ranked WHERE rank <= 5
UNION ALL SELECT 'baseline', query_id, id, round(sim, 6), rank FROM hy"""
SQL["dense_graph_rerank"] = f"WITH {C.POOL_SQL}, {_graph_sql('SELECT query_id, id, sim FROM pool WHERE rank <= 5')} SELECT query_id, id, round(score, 6) AS score, rank FROM ranked WHERE rank <= 5"


def split_items(spark, sf_dir):
    """The labelled documents of the dev split."""
    labels = table(spark, sf_dir, "labels")
    split = experiment.stratified_split(labels, "doc_id", "quality", 0.35, 20260701).select(F.col("doc_id").alias("id"), "split")
    return experiment.in_split(labels, split, "dev", "doc_id").select("doc_id", "quality", "toxic")


SQL["split_items"] = "SELECT doc_id, quality, toxic FROM (SELECT *, row_number() OVER (PARTITION BY quality ORDER BY md5('20260701:' || doc_id), doc_id) AS r, count(*) OVER (PARTITION BY quality) AS n FROM labels) WHERE r <= round_even(n * 0.35::DOUBLE, 0)"


def gold_ids(spark, sf_dir):
    """Orders as questions, their parts as gold."""
    items = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.collect_list("l_partkey").alias("gold"))
    return experiment.gold_ids(items, "gold")


SQL["gold_ids"] = "SELECT DISTINCT l_partkey AS id FROM lineitem"


def _runs(spark, sf_dir) -> DataFrame:
    """Both systems' rows: dense hits and re-ranked ones, with an invented latency."""
    pairs = [("baseline", C.dense(spark, sf_dir, C.TOP_K)), ("graph", retrieval.rerank(C.candidates(spark, sf_dir), [0.5], C.TOP_K))]
    out = None
    for name, hits in pairs:
        ordered = F.transform(F.sort_array(F.collect_list(F.struct("rank", "id"))), lambda x: x["id"])
        one = hits.groupBy("query_id").agg(ordered.alias("retrieved")).select(F.lit(name).alias("system"), "query_id", (F.col("query_id") % 7 / 10.0).alias("latency_s"), "retrieved")
        out = one if out is None else out.unionByName(one)
    return C.Scratch(spark).keep(out)


def _judged(spark, sf_dir) -> DataFrame:
    """A judge's scores of some of the rows."""
    q = C.vectors(spark, sf_dir)[0].filter("query_id % 100 = 0")
    return q.select(F.lit("graph").alias("system"), "query_id", (F.col("query_id") % 11 / 11.0).alias("faithfulness"))


def per_question(spark, sf_dir):
    out = metrics.per_question(_runs(spark, sf_dir), C.gold(spark, sf_dir), _judged(spark, sf_dir))
    return out.select("system", "query_id", F.round("latency_s", 6).alias("latency_s"), F.col("n_retrieved").cast("long").alias("n_retrieved"), F.col("n_gold").cast("long").alias("n_gold"), *(F.round(n, 6).alias(n) for n in C.NAMES), F.round("judge_faithfulness", 6).alias("judge_faithfulness"))


SQL["per_question"] = (
    f"WITH {C.CANDIDATES}, {C.GOLD}, al AS (SELECT 0.5::DOUBLE AS alpha), {C.RERANK}, both_ AS (SELECT 'baseline' AS system, query_id, id, rank FROM dense WHERE rank <= 5 UNION ALL SELECT 'graph', query_id, id, rank FROM ranked WHERE rank <= 5),"
    f" asked AS (SELECT DISTINCT system, query_id FROM both_), {C._scores_sql('system, query_id', 'both_', 'asked')} SELECT system, query_id, round(query_id % 7 / 10.0::DOUBLE, 6) AS latency_s, n AS n_retrieved, coalesce(ng.n_gold, 0) AS n_gold, "
    + ", ".join(f"round({n}, 6) AS {n}" for n in C.NAMES)
    + ", CASE WHEN system = 'graph' AND query_id % 100 = 0 THEN round(query_id % 11 / 11.0::DOUBLE, 6) END AS judge_faithfulness FROM scores LEFT JOIN ng USING (query_id) JOIN (SELECT system, query_id, max(rank) AS n FROM both_ GROUP BY 1, 2) USING (system, query_id)"
)

QUERIES = {f.__name__: f for f in (hybrid_graph_rerank, dense_graph_rerank, split_items, gold_ids, per_question)}
