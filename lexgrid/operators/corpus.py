"""Corpus building: deduplication, audits, file choice, pending rows and differences."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexgrid.functions import text as X


def dedup_articles(rows: DataFrame, id_col: str, text: Column, pos: Column) -> DataFrame:
    """One row for each id: the longest usable text, else the longest that isn't empty (ties: the first), else
    the last. One value of a fixed order for each row is reduced by a maximum, which is combined before it moves."""
    body = text
    n = F.length(body)
    usable, filled = X.is_usable(body), n > 0
    order = F.struct(usable.alias("u"), filled.alias("f"), F.when(filled, n).otherwise(0).alias("n"), F.when(filled, -pos).otherwise(pos).alias("p"))
    return rows.groupBy(id_col).agg(F.max_by(pos, order).alias("pos"), F.min(pos).alias("first_pos"))


def collision_audit(rows: DataFrame, id_col: str, text: Column) -> DataFrame:
    """Ids with at least two distinct openings among usable texts of over 300 characters."""
    long_ = X.is_usable(text) & (F.length(text) > X.COLLISION_LENGTH)
    marked = rows.select(id_col, F.when(long_, X.fingerprint(text)).alias("opening"))
    return marked.groupBy(id_col).agg(F.count_distinct("opening").alias("openings")).filter("openings >= 2")


def dedup_audit(rows: DataFrame, id_col: str, text: Column, pos: Column) -> DataFrame:
    """Counts over ids: all, with several rows, selectable, colliding, trivial alone, and changed against keep-last."""
    usable = X.is_usable(text)
    long_ = usable & (F.length(text) > X.COLLISION_LENGTH)
    groups = rows.groupBy(id_col).agg(
        F.count("*").alias("n"), F.count_if(usable).alias("usable"), F.count_distinct(F.when(long_, X.fingerprint(text))).alias("openings"), F.max(pos).alias("last"),
    )
    chosen = dedup_articles(rows, id_col, text, pos)
    joined = groups.join(chosen, id_col)
    many = F.col("n") > 1
    count = lambda c: F.count_if(c)
    return joined.agg(
        F.count("*").alias("groups"), count(many).alias("multi"), count(many & (F.col("usable") >= 1)).alias("selectable"),
        count(F.col("openings") >= 2).alias("collisions"), count(many & (F.col("usable") == 0)).alias("all_trivial"), count(F.col("pos") != F.col("last")).alias("changed_vs_last"),
    )


def best_files(files: DataFrame, key: Column, name: Column) -> DataFrame:
    """Of the files of a key: PDF first, then the original before a numbered copy, then by name."""
    ending = F.lower(F.regexp_extract(name, r"(\.[^.]*)$", 1))
    stem = F.regexp_replace(name, r"\.[^.]*$", "")
    order = F.struct(F.when(ending == ".pdf", 0).otherwise(1), F.when(stem.rlike("_[0-9]{1,2}$"), 1).otherwise(0), name)
    return files.groupBy(key.alias("file_key")).agg(F.min_by(name, order).alias("file_name"), F.count("*").alias("copies"))


def with_metadata(files: DataFrame, metadata: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """Files with their metadata, and those without any."""
    return files.join(metadata, key), files.join(metadata, key, "left_anti")


def last_by_key(rows: DataFrame, key: str, pos: str) -> DataFrame:
    """The last row of each key."""
    return rows.groupBy(key).agg(F.max_by(F.struct(*[c for c in rows.columns if c != key]), F.col(pos)).alias("r")).select(key, "r.*")


def pending(rows: DataFrame, stored: DataFrame, key: str) -> DataFrame:
    return rows.join(stored, key, "left_anti")


def store_diff(rows: DataFrame, stored: DataFrame, key: str, text: str) -> DataFrame:
    """missing or changed for each row whose stored text isn't the same."""
    have = stored.select(F.col(key), F.lit(True).alias("_there"), F.col(text).alias("_have"))
    joined = rows.select(key, text).join(have, key, "left")
    state = F.when(F.col("_there").isNull(), "missing").when(~F.col("_have").eqNullSafe(F.col(text)), "changed")
    return joined.select(key, state.alias("state")).filter("state is not null")


def upsert(stored: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """New rows replace those of their key."""
    return new.unionByName(stored.join(new.select(key), key, "left_anti"))


def lookup(rows: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """The rows of the ids that are asked for."""
    return rows.join(ids.select(key).distinct(), key, "left_semi")


def graph_diff(rows: DataFrame, graph: DataFrame, key: str, text: str) -> DataFrame:
    """(key): rows that the graph has with another text; ids and texts that it lacks don't count."""
    other = graph.select(F.col(key), F.col(text).alias("_have"))
    return rows.select(key, text).join(other, key).filter(F.col("_have") != F.col(text)).select(key)


def migrate(rows: DataFrame, stored: DataFrame, key: str, text: str, dry_run: bool = True) -> tuple[DataFrame, DataFrame | None]:
    """What a store needs to hold ``rows``, as counts by state, and unless it is a dry run the store with the changed and missing rows
    replaced. A second run on that store counts none."""
    diff = store_diff(rows, stored, key, text)
    counts = diff.groupBy("state").agg(F.count("*").alias("n"))
    return counts, None if dry_run else upsert(stored, lookup(rows, diff, key).select(*stored.columns), key)
