"""Dense, lexical and fused retrieval for many queries at once, and graph re-ranking."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexgrid.functions.text import tokens
from lexgrid.scratch import Scratch

RRF_K, BM25_K1, BM25_B = 60, 1.5, 0.75
CHUNK, QUERIES = 4096, 512


#: Parts that a block of queries is repeated for, so that the corpus's chunks are dealt over as many tasks.
DEALT = 256


def dense_topk(queries: DataFrame, corpus: DataFrame, k: int) -> DataFrame:
    """(query_id, id, sim, rank): the ``k`` rows nearest by cosine, ranks from 1, ties to the smaller id.

    queries (query_id, vector), corpus (id, vector). Both are packed into blocks, every block of the corpus meets
    every block of queries, and a block pair is one matrix product that keeps ``k`` rows of a query. The join's key is the query block and
    one of DEALT parts of the corpus's blocks, so that few queries don't gather the corpus in one task, and any number of queries works."""

    def packed(frame: DataFrame, key: str, blocks: int, name: str) -> DataFrame:
        n = F.pmod(F.xxhash64(key), F.lit(blocks)).cast("int").alias(name)
        return frame.groupBy(n).agg(F.collect_list(F.struct(F.col(key).alias("i"), F.col("vector").alias("v"))).alias("rows"))

    blocks, chunks = (max(1, -(-frame.count() // size)) for frame, size in ((queries, QUERIES), (corpus, CHUNK)))
    parts = min(chunks, DEALT)
    left = packed(queries, "query_id", blocks, "block").withColumnRenamed("rows", "qs").withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    right = packed(corpus, "id", chunks, "chunk").withColumns({"part": F.pmod("chunk", F.lit(parts)), "block": F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))})
    kinds = dict(queries.dtypes)["query_id"], dict(corpus.dtypes)["id"]

    def product(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def unit(rows) -> tuple[np.ndarray, np.ndarray]:
            m = np.array([r["v"] for r in rows], np.float64)
            norm = np.linalg.norm(m, axis=1, keepdims=True)
            return np.array([r["i"] for r in rows]), np.divide(m, norm, out=np.zeros_like(m), where=norm > 0)

        for batch in batches:
            for qs, rows in zip(batch["qs"], batch["rows"], strict=True):
                (qi, q), (di, d) = unit(qs), unit(rows)
                sims = np.round(q @ d.T, 12)
                for j in range(len(qi)):
                    best = np.lexsort((di, -sims[j]))[:k]
                    yield pd.DataFrame({"query_id": np.full(len(best), qi[j]), "id": di[best], "sim": sims[j][best]})

    part = right.join(left, ["block", "part"]).select("qs", "rows").mapInPandas(product, f"query_id {kinds[0]}, id {kinds[1]}, sim double")
    return top(part, "sim", k)


def top(hits: DataFrame, score: str, k: int) -> DataFrame:
    w = Window.partitionBy("query_id").orderBy(F.desc(score), "id")
    return hits.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def bm25_pool(pool: DataFrame, queries: DataFrame, texts: DataFrame, scratch: Scratch | None = None) -> DataFrame:
    """(query_id, id, bm25) of each pooled document. pool (query_id, id), a written table, queries (query_id, text), texts (id, text).
    Document counts, lengths and frequencies are the pool's own; query words count once; documents without any score 0. The pooled
    documents are tokenised once, and matches are made once, as written tables."""
    scratch = scratch or Scratch(texts.sparkSession)
    docs = texts.join(pool.select("id").distinct(), "id", "left_semi").select("id", tokens(F.col("text")).alias("toks"))
    terms = queries.select("query_id", F.explode(F.array_distinct(tokens(F.col("text")))).alias("tok"))
    words = docs.select("id", F.size("toks").alias("len"), F.explode_outer("toks").alias("tok")).groupBy("id", "len", "tok").agg(F.count("*").alias("tf"))
    words = scratch.keep(words)
    lens = scratch.keep(pool.select("query_id", "id").join(words.select("id", "len").distinct(), "id"))
    stats = lens.groupBy("query_id").agg(F.count("*").alias("n"), F.avg("len").alias("avg_len"))
    wanted = words.join(terms.select("tok").distinct(), "tok", "left_semi").select("id", "tok", "tf")
    hits = scratch.keep(lens.join(wanted, "id").join(terms, ["query_id", "tok"]))
    df = hits.groupBy("query_id", "tok").agg(F.count("*").alias("df"))
    scored = hits.join(df, ["query_id", "tok"]).join(stats, "query_id")
    idf = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    weight = idf * F.col("tf") * (BM25_K1 + 1) / (F.col("tf") + BM25_K1 * (1 - BM25_B + BM25_B * F.col("len") / F.nullif(F.col("avg_len"), F.lit(0.0))))
    sums = scored.groupBy("query_id", "id").agg(F.sum(weight).alias("s"))
    return lens.join(sums, ["query_id", "id"], "left").select("query_id", "id", F.round(F.coalesce("s", F.lit(0.0)), 9).alias("bm25"))


def seeds(mode: str, pool: DataFrame, lexical: Callable[[DataFrame], DataFrame], k: int) -> DataFrame:
    """(query_id, id, sim, rank) to start a graph retriever from: the ``k`` first of a dense pool (``dense``), or those of its fusion with
    lexical scores (``hybrid``). Either way ``sim`` is the dense similarity, by which re-ranking orders; the rank is the mode's own."""
    if mode not in ("dense", "hybrid"):
        raise ValueError(f"unknown seeding: {mode}")
    if mode == "dense":
        return pool.filter(F.col("rank") <= k)
    return fuse(pool, lexical(pool), k).drop("fused")


def fuse(pool: DataFrame, lexical: DataFrame, k: int) -> DataFrame:
    """Reciprocal rank fusion of a dense pool (query_id, id, sim, rank) and lexical scores: ranks from 0,
    lexical ties in dense order, fused ties by id."""
    w = Window.partitionBy("query_id").orderBy(F.desc("bm25"), "rank")
    both = pool.join(lexical, ["query_id", "id"]).withColumn("lex", F.row_number().over(w) - 1)
    fused = both.withColumn("fused", F.round(1 / (RRF_K + F.col("rank") - 1) + 1 / (RRF_K + F.col("lex")), 12)).drop("rank", "lex")
    return top(fused, "fused", k)


def graph_candidates(seeds: DataFrame, reach: DataFrame, degree: DataFrame, queries: DataFrame, corpus: DataFrame) -> DataFrame:
    """(query_id, id, sim, boost, is_seed): what doesn't depend on alpha. seeds (query_id, id, sim), reach (seed, dst, hop).
    A boost adds the seeds' similarities over their hops and is damped by the degree."""
    via = seeds.select("query_id", F.col("id").alias("seed"), F.col("sim").alias("seed_sim")).join(reach, "seed").filter("seed <> dst")
    raw = via.groupBy("query_id", F.col("dst").alias("id")).agg(F.sum(F.col("seed_sim") / F.greatest("hop", F.lit(1))).alias("raw"))
    boosted = raw.join(degree, "id", "left").select("query_id", "id", (F.col("raw") / (1 + F.log1p(F.coalesce("degree", F.lit(0))))).alias("boost"))
    own = seeds.select("query_id", "id", "sim").join(boosted, ["query_id", "id"], "left").select("query_id", "id", "sim", F.coalesce("boost", F.lit(0.0)).alias("boost"), F.lit(True).alias("is_seed"))
    from lexgrid.functions.vector import cosine

    rest = boosted.join(seeds.select("query_id", "id"), ["query_id", "id"], "left_anti")
    near = (
        rest.join(queries.select("query_id", F.col("vector").alias("q")), "query_id").join(corpus.select("id", F.col("vector").alias("v")), "id", "left")
        .select("query_id", "id", F.coalesce(F.round(cosine(F.col("q"), F.col("v")), 12), F.lit(0.0)).alias("sim"), "boost", F.lit(False).alias("is_seed"))
    )
    return own.unionByName(near)


def rerank(candidates: DataFrame, alphas: list[float], budget: int) -> DataFrame:
    """(alpha, query_id, id, score, rank) for every alpha in one job. Candidates, a written table if there are several alphas, are read once for
    each, so that a task sorts its rows of one alpha and not as many times more."""
    score = F.round(F.col("sim") + F.col("alpha") * F.col("boost"), 9)
    scored = reduce(DataFrame.unionByName, (candidates.withColumn("alpha", F.lit(float(a))).select("alpha", "query_id", "id", score.alias("score")) for a in alphas))
    w = Window.partitionBy("alpha", "query_id").orderBy(F.desc("score"), "id")
    return scored.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= budget).select("alpha", "query_id", "id", "score", "rank")


def format_contexts(hits: DataFrame, source: str = "source") -> DataFrame:
    """(query_id, context): a block for each hit in rank order. hits (query_id, rank, source, regulation_id, article_number, text)."""
    block = F.concat(F.lit("["), F.upper(source), F.lit("] "), F.col("regulation_id"), F.lit(" — Pasal "), F.col("article_number"), F.lit("\n"), F.col("text"))
    ordered = F.sort_array(F.collect_list(F.struct("rank", block.alias("b"))))
    return hits.groupBy("query_id").agg(F.array_join(F.transform(ordered, lambda x: x["b"]), "\n\n---\n\n").alias("context"))


def build_prompts(contexts: DataFrame) -> DataFrame:
    """contexts (query_id, question, context)."""
    return contexts.withColumn("prompt", F.concat(F.lit("Konteks peraturan:\n\n"), "context", F.lit("\n\nPertanyaan: "), "question", F.lit("\n\nJawaban:")))
