"""The property graph as vertex and edge tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def build_edges(references: DataFrame, vertices: DataFrame, attr: str) -> DataFrame:
    """(src, dst, attr), each once, with both ends among the vertices."""
    ends = vertices.select("id")
    return (
        references.select("src", "dst", F.coalesce(F.col(attr).cast("string"), F.lit("")).alias("attr")).distinct()
        .join(ends.withColumnRenamed("id", "src"), "src", "left_semi").join(ends.withColumnRenamed("id", "dst"), "dst", "left_semi")
    )


def with_stubs(regulations: DataFrame, *targets: DataFrame, order: str | None = None) -> DataFrame:
    """Regulations by id, with a stub of nulls for each target that has no row. Of several rows of an id the last in ``order`` stays, whole
    (without ``order``: the greatest, field by field); fields of different rows are never mixed."""
    rest = [c for c in regulations.columns if c not in ("id", order)]
    row = F.struct(*rest)
    own = regulations.select("id", F.lit(True).alias("_real"), (F.col(order) if order else row).alias("_at"), row.alias("_row"))
    for t in targets:
        own = own.unionByName(t.select("id", F.lit(False).alias("_real")), allowMissingColumns=True)
    return own.groupBy("id").agg(F.max_by("_row", F.struct("_real", "_at")).alias("_row")).select("id", "_row.*")


def reference_edges(intra: DataFrame, cross: DataFrame, articles: DataFrame) -> DataFrame:
    """(src, dst, attr) of references within and between regulations, each once, whose targets are there.
    intra and cross (src, dst, ayat), articles (id)."""
    return build_edges(intra.select("src", "dst", "ayat").unionByName(cross.select("src", "dst", "ayat")), articles, "ayat")


def belongs_to(articles: DataFrame, regulations: DataFrame) -> DataFrame:
    """(src, dst): each article to its regulation, if that is a vertex. articles (id, regulation_id), regulations (id)."""
    return articles.select(F.col("id").alias("src"), F.col("regulation_id").alias("dst")).distinct().join(regulations.select(F.col("id").alias("dst")), "dst", "left_semi").select("src", "dst")


def amend_edges(amends: DataFrame, regulations: DataFrame) -> DataFrame:
    """(src, dst, attr): the action is the attribute. amends (src, dst, action); regulations with their stubs (id)."""
    return build_edges(amends, regulations, "action")


def define_edges(definitions: DataFrame, articles: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Concepts (id), one for each spelling, and the edges (src, dst) of the articles that define them. definitions (src, term)."""
    own = definitions.join(articles.select(F.col("id").alias("src")), "src", "left_semi").select("src", F.col("term").alias("dst")).distinct()
    return own.select(F.col("dst").alias("id")).distinct(), own


def resolution(references: DataFrame, articles: DataFrame) -> DataFrame:
    """One row: distinct references, those whose target is an article, and those that resolve to none."""
    own = references.select("src", "dst", F.coalesce("ayat", F.lit("")).alias("ayat")).distinct()
    marked = own.join(articles.select(F.col("id").alias("dst"), F.lit(1).alias("_there")).distinct(), "dst", "left")
    there = F.col("_there").isNotNull()
    return marked.agg(F.count("*").alias("attempted"), F.count_if(there).alias("resolved"), F.count_if(~there).alias("unresolved"))


def graph_counts(regulations: DataFrame, articles: DataFrame, concepts: DataFrame, belongs: DataFrame, references: DataFrame, amends: DataFrame, defines: DataFrame) -> DataFrame:
    """(what, n): the seven kinds of vertices and edges, and of the graph's health the articles without references and definitions, the
    articles that define something, and the regulations without an article."""
    def count(what: str, frame: DataFrame) -> DataFrame:
        return frame.agg(F.count("*").alias("n")).select(F.lit(what).alias("what"), "n")

    ends = references.select(F.col("src").alias("id")).unionByName(references.select(F.col("dst").alias("id"))).unionByName(defines.select(F.col("src").alias("id")))
    frames = {
        "regulations": regulations, "articles": articles, "concepts": concepts, "belongs_to": belongs, "references": references, "amends": amends, "defines": defines,
        "orphan_articles": articles.join(ends, "id", "left_anti"), "defining_articles": defines.select("src").distinct(),
        "stub_regulations": regulations.select("id").join(belongs.select(F.col("dst").alias("id")), "id", "left_anti"),
    }
    out = None
    for what, frame in frames.items():
        out = count(what, frame) if out is None else out.unionByName(count(what, frame))
    return out


def top_targets(edges: DataFrame, k: int = 10) -> DataFrame:
    """(id, degree) of the ``k`` vertices with the most incoming edges, ties to the smaller id."""
    return edges.groupBy(F.col("dst").alias("id")).agg(F.count("*").alias("degree")).orderBy(F.desc("degree"), "id").limit(k)


def undirected(edges: DataFrame) -> DataFrame:
    return edges.select("src", "dst").unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")))


def degrees(edges: DataFrame) -> DataFrame:
    """Both directions and parallel edges count."""
    return undirected(edges).groupBy(F.col("src").alias("id")).agg(F.count("*").alias("degree"))


def expand(seeds: DataFrame, edges: DataFrame, hops: int) -> DataFrame:
    """(seed, dst, hop): the fewest hops, up to ``hops``, from each seed to each other node. Each hop joins
    the frontier of (seed, node) pairs, each once, with distinct neighbours; a node already reached isn't a frontier again."""
    near = undirected(edges).filter("src <> dst").distinct()
    reached = seeds.select(F.col("id").alias("seed"), F.col("id").alias("dst"), F.lit(0).alias("hop")).distinct()
    frontier = reached
    for hop in range(1, hops + 1):
        step = frontier.select("seed", F.col("dst").alias("src")).join(near, "src").select("seed", "dst").distinct()
        frontier = step.join(reached, ["seed", "dst"], "left_anti").withColumn("hop", F.lit(hop))
        reached = reached.unionByName(frontier)
    return reached.filter("hop > 0")


def graph_stats(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """One row of counts: vertices, edges, distinct pairs, isolated vertices, sources and targets."""
    nodes = vertices.join(degrees(edges), "id", "left").agg(F.count("*").alias("n_vertices"), F.count_if(F.col("degree").isNull()).alias("n_isolated"))
    counts = edges.agg(F.count("*").alias("n_edges"), F.count_distinct("src", "dst").alias("n_pairs"), F.count_distinct("src").alias("n_sources"), F.count_distinct("dst").alias("n_targets"))
    both = nodes.unionByName(counts, allowMissingColumns=True)
    return both.agg(*(F.max(c).alias(c) for c in both.columns))


def orphans(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """Vertices without an edge."""
    return vertices.select("id").join(edges.select(F.col("src").alias("id")), "id", "left_anti").join(edges.select(F.col("dst").alias("id")), "id", "left_anti")


def top_degrees(edges: DataFrame, k: int = 10) -> DataFrame:
    return degrees(edges).orderBy(F.desc("degree"), "id").limit(k)


def duplicate_keys(rows: DataFrame, *keys: str) -> DataFrame:
    """The keys that a uniqueness constraint would refuse."""
    return rows.groupBy(*keys).agg(F.count("*").alias("copies")).filter("copies > 1")
