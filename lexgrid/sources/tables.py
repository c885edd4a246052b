"""Scans and sinks: JSON, JSON lines, CSV, files and keyed tables."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexgrid import schemas
from lexgrid.functions import text as X
from lexgrid.operators.corpus import dedup_articles, last_by_key
from lexgrid.scratch import delete

#: Where a result page's card has its fields.
CARD = r"(?i)<div[^>]*class=[\"'][^\"']*\bjdih-search\b[^>]*>"
CARD_NUMBER = r"(?is)<h5[^>]*\bitem\b[^>]*>.*?<a\b[^>]*>(.*?)</a>"
CARD_LINK = r"(?is)<h5[^>]*\bitem\b[^>]*>.*?<a\b[^>]*\bhref=[\"']([^\"']*)[\"']"
CARD_TITLE = r"(?is)<p[^>]*\bitem\b[^>]*>(.*?)</p>"
CARD_CATEGORY = r"(?is)<div[^>]*\bsearch-label\b[^>]*>(.*?)</div>"
CARD_DATES = r"(?is)<ul[^>]*\bsearch-meta\b[^>]*>(.*?)</ul>"


def read_metadata(spark: SparkSession, path: str) -> DataFrame:
    """Scraped records by normalised number; of equal keys the last in the file stays."""
    rows = spark.read.schema(schemas.SCRAPED).json(path, multiLine=True).filter(F.col("regulation_number").isNotNull())
    return last_by_key(rows.withColumns({"file_key": X.normalise_key(F.col("regulation_number")), "_pos": F.monotonically_increasing_id()}), "file_key", "_pos").drop("_pos")


def read_articles(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schemas.ARTICLE).json(path, multiLine=True)


def read_canonical_articles(spark: SparkSession, path: str) -> DataFrame:
    """The articles of a file, of each id the one that deduplication chooses, in the order of their first appearance."""
    rows = read_articles(spark, path).withColumns({"id": X.article_id(F.col("regulation_id"), F.col("article_number")), "pos": F.monotonically_increasing_id()})
    chosen = dedup_articles(rows, "id", X.article_text(F.col("content"), F.col("raw_text")), F.col("pos"))
    return rows.join(chosen, ["id", "pos"]).orderBy("first_pos").drop("pos", "first_pos")


def read_regulations(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schemas.REGULATION).json(path, multiLine=True)


def read_eval_items(spark: SparkSession, path: str) -> DataFrame:
    """Blank lines are skipped; keys that the schema doesn't know go to ``extra``."""
    lines = spark.read.text(path).filter(F.trim("value") != "")
    known = T.StructType.fromDDL(schemas.EVAL_ITEM).fieldNames()
    row = lines.select(F.from_json("value", schemas.EVAL_ITEM).alias("r"), F.from_json("value", "map<string,string>").alias("m"))
    return row.select("r.*", F.map_filter("m", lambda k, v: ~k.isin(known)).alias("extra"))


def read_split(spark: SparkSession, path: str) -> DataFrame:
    """(id, split) of a split file."""
    one = spark.read.schema(schemas.SPLIT).json(path, multiLine=True)
    parts = [one.select(F.explode(s).alias("id"), F.lit(s).alias("split")) for s in ("dev", "test")]
    return parts[0].unionByName(parts[1])


def write_split(split: DataFrame, path: str, seed: int, dev_share: float) -> None:
    """The split (id, split) as the one-row file that :func:`read_split` reads, ids in order."""
    ids = lambda name: F.sort_array(F.collect_list(F.when(F.col("split") == name, F.col("id").cast("string")))).alias(name)
    one = split.agg(ids("dev"), ids("test")).select(F.lit(seed).cast("long").alias("seed"), F.lit(float(dev_share)).alias("dev_frac"), "dev", "test")
    one.coalesce(1).write.mode("overwrite").json(path)


def parse_cards(pages: DataFrame, html_col: str, base_url: str) -> DataFrame:
    """The records of saved result pages: a row for each card that has a number, a description and a category; others go.
    Pages that aren't saved result pages have none."""
    card = lambda pattern: F.regexp_extract("_card", pattern, 1)
    plain = lambda c: X.strip(X.unescape(F.regexp_replace(c, r"<[^>]*>", "")))
    cards = pages.select(F.explode(F.slice(F.split(html_col, CARD), 2, 1_000_000)).alias("_card"))
    dates = F.regexp_extract_all(card(CARD_DATES), F.lit(r"(?is)<li\b[^>]*>(.*?)</li>"), F.lit(1))
    href = X.unescape(card(CARD_LINK))
    rows = cards.select(
        plain(card(CARD_NUMBER)).alias("regulation_number"), plain(card(CARD_TITLE)).alias("title"), X.title_year(plain(card(CARD_NUMBER))).alias("year"), plain(card(CARD_CATEGORY)).alias("category"),
        X.date_text(plain(F.get(dates, F.lit(0)))).alias("date_enacted"), X.date_text(plain(F.get(dates, F.lit(1)))).alias("date_promulgated"),
        F.when(href == "", None).when(href.rlike("^[a-z]+://"), href).otherwise(F.concat(F.lit(base_url.rstrip("/") + "/"), F.ltrim(href, F.lit("/")))).alias("detail_url"),
    )
    return rows.filter("regulation_number <> '' and title <> '' and category <> ''")


def read_files(spark: SparkSession, path: str, patterns: str = "*.{pdf,html,htm}", limit: int | None = None) -> DataFrame:
    """(path, name, data) of the matching files; with ``limit`` the first by name, then path. Only names are sorted for that."""
    if limit is not None:
        found = spark.read.format("binaryFile").option("pathGlobFilter", patterns).load(path).select("path", F.element_at(F.split("path", "/"), -1).alias("name"))
        chosen = found.orderBy("name", "path").limit(limit).select("path")
        return read_files(spark, path, patterns).join(chosen, "path", "left_semi")
    files = spark.read.format("binaryFile").option("pathGlobFilter", patterns).load(path)
    return files.select("path", F.element_at(F.split("path", "/"), -1).alias("name"), F.col("content").alias("data"))


def html_texts(files: DataFrame) -> DataFrame:
    return files.withColumn("text", X.html_text(X.decode_page(F.col("data"))))


def pdf_texts(files: DataFrame, extract: Callable[[bytes], list[str]]) -> DataFrame:
    """``files`` with ``text``, the pages by newlines, from an extractor that the caller supplies; files with
    under 50 characters a page, or that the extractor refuses, go."""
    pages = T.ArrayType(T.StringType())

    def safe(data: bytes) -> list[str] | None:
        try:
            return extract(data)
        except Exception:  # one broken file doesn't end the scan
            return None

    @F.pandas_udf(pages)
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield batch.map(safe)

    found = files.withColumn("_pages", run("data")).filter(F.col("_pages").isNotNull() & ~X.is_image_only(F.col("_pages")))
    return found.withColumn("text", F.array_join("_pages", "\n")).drop("_pages")


def write_json(frame: DataFrame, path: str) -> None:
    frame.write.mode("overwrite").json(path)


def write_csv(frame: DataFrame, path: str) -> None:
    """One file, for reports of a bounded number of rows."""
    frame.coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def write_new(frame: DataFrame, path: str) -> None:
    """Replaces a table: written whole beside it, then swapped in by two renames. A job that fails leaves the old table as it was; a driver
    that ends between the renames leaves it beside, under ``.old``. The frame may read the table that it replaces."""
    spark = frame.sparkSession
    path = path.rstrip("/")
    fresh, old = f"{path}.new-{uuid.uuid4().hex}", f"{path}.old"
    frame.write.parquet(fresh)
    at = spark._jvm.org.apache.hadoop.fs.Path
    fs = at(path).getFileSystem(spark._jsc.hadoopConfiguration())
    fs.delete(at(old), True)
    if fs.exists(at(path)) and not fs.rename(at(path), at(old)) or not fs.rename(at(fresh), at(path)):
        raise OSError(f"couldn't replace {path}")
    fs.delete(at(old), True)


def wipe(spark: SparkSession, path: str) -> None:
    """Removes a store."""
    delete(spark, path)


def append_runs(frame: DataFrame, path: str) -> None:
    frame.write.mode("append").parquet(path)
