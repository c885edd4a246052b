"""Run logs, splits, validation and model hooks."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexgrid.functions import text as X


def latest_runs(log: DataFrame, keys: list[str], order: Column) -> DataFrame:
    """The last row of each key of an append-only log."""
    rest = [c for c in log.columns if c not in keys]
    return log.groupBy(*keys).agg(F.max_by(F.struct(*rest), order).alias("r")).select(*keys, "r.*")


def to_run(items: DataFrame, log: DataFrame, keys: list[str]) -> DataFrame:
    """Items that a log doesn't have yet."""
    return items.join(log.select(*keys), keys, "left_anti")


def stratified_split(rows: DataFrame, id_col: str, stratum: str, dev_share: float, seed: int) -> DataFrame:
    """(id, stratum, split): of each stratum's n rows, in the order of a seeded hash, the first round-half-even(n * share) are dev.
    Ranks come from counts of hash prefixes, and a window over one prefix, so that a stratum of any size is dealt evenly."""
    key = F.md5(F.concat(F.lit(f"{seed}:"), F.col(id_col).cast("string")))
    keyed = rows.select(id_col, stratum, key.alias("_key"), F.substring(key, 1, 3).alias("_part"))
    parts = keyed.groupBy(stratum, "_part").agg(F.count("*").alias("_c"))
    before = Window.partitionBy(stratum).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(stratum)
    offsets = parts.select(stratum, "_part", F.coalesce(F.sum("_c").over(before), F.lit(0)).alias("_o"), F.sum("_c").over(whole).alias("_n"))
    rank = F.row_number().over(Window.partitionBy(stratum, "_part").orderBy("_key", id_col)) + F.col("_o")
    ranked = keyed.join(offsets, [stratum, "_part"]).withColumn("_r", rank)
    return ranked.select(id_col, stratum, F.when(F.col("_r") <= F.bround(F.col("_n") * F.lit(dev_share)), "dev").otherwise("test").alias("split"))


def in_split(items: DataFrame, split: DataFrame, name: str, key: str = "id") -> DataFrame:
    """The items of a split (id, split); ``all`` takes every item."""
    return items if name == "all" else items.join(split.filter(F.col("split") == name).select(F.col("id").alias(key)), key, "left_semi")


def gold_ids(items: DataFrame, gold_col: str) -> DataFrame:
    """(id): every gold id of any item, once."""
    return items.select(F.explode(gold_col).alias("id")).distinct()


def validate_gold(gold: DataFrame, store: DataFrame, graph: DataFrame) -> DataFrame:
    """(question, id, state) of gold (question, id): missing_store, missing_graph, trivial, suspicious or ok. store (id, text), graph (id)."""
    text = F.coalesce(X.strip(F.col("text")), F.lit(""))
    joined = gold.join(store.select("id", "text", F.lit(True).alias("_s")), "id", "left").join(graph.select("id", F.lit(True).alias("_g")).distinct(), "id", "left")
    state = (
        F.when(F.col("_s").isNull(), "missing_store").when(F.col("_g").isNull(), "missing_graph")
        .when(~X.is_usable(text), "trivial").when(X.is_suspect_id(F.col("id")), "suspicious").otherwise("ok")
    )
    return joined.select("question", "id", state.alias("state"))


def embed(rows: DataFrame, text_col: str, model: Callable[[list[str]], list[list[float]]], least: int = 256) -> DataFrame:
    """``rows`` with an embedding column by a model that the caller supplies. A batch that the model refuses with
    ValueError is given text by text, each halved until it's taken or ``least`` long; a wrong number of vectors is an error."""

    def one(text: str) -> list[float]:
        while True:
            try:
                return model([text])[0]
            except ValueError:
                if len(text) <= least:
                    raise
                text = text[: max(least, len(text) // 2)]

    @F.pandas_udf("array<float>")
    def run(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in texts:
            given = batch.fillna("").tolist()
            try:
                out = model(given)
            except ValueError:
                out = [one(t) for t in given]
            if len(out) != len(given):
                raise RuntimeError(f"{len(given)} texts, {len(out)} vectors")
            yield pd.Series(list(out))

    return rows.withColumn("embedding", run(X.model_input(F.col(text_col))))


def generate(rows: DataFrame, prompt_col: str, model: Callable[[str], str] | None = None) -> DataFrame:
    """``rows`` with an answer by a model that the caller supplies; null without one."""
    if model is None:
        return rows.withColumn("answer", F.lit(None).cast("string"))

    @F.pandas_udf("string")
    def run(prompts: pd.Series) -> pd.Series:
        return prompts.map(model)

    return rows.withColumn("answer", run(prompt_col))


def evaluate(questions: DataFrame, pipeline: Callable[[DataFrame], DataFrame], system: str) -> DataFrame:
    """Any pipeline from questions to answers and contexts, as rows of a run log."""
    return pipeline(questions).withColumn("system", F.lit(system))
