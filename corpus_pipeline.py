"""From raw documents to packed training sequences."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexgrid.llm.common import Scratch, fresh, table
from lexgrid.llm.language import tag_languages
from lexgrid.llm.leaks import find_leaks
from lexgrid.llm.packing import pack_documents
from lexgrid.llm.secrets import scan_secrets
from lexgrid.llm.setjoin import drop_near_copies
from lexgrid.scratch import transient

#: Documents whose best language has less than this mean probability go; those of two languages stay.
LEAST_SCORE = 0.35
VOCABULARY = "word_bpe_49k.json"


def keep_known_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter or without a clear language go.

    Null and empty texts go; texts of any length are read whole; repeated rows are judged each, and alike; ties of languages go to the
    alphabetically first; an empty table stays empty; columns of any name pass as they are."""
    name = fresh(docs, "_language")
    tagged = tag_languages(docs, name=name)
    return tagged.filter((F.col(f"{name}.lang") != "und") & (F.col(f"{name}.score") >= LEAST_SCORE)).drop(name)


def keep_one_of_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of documents linked by five-word shingles at a similarity of 0.8, the smallest id stays.

    Null and empty texts stay, each; of equal ids in a group one row stays, by the text's hash, and of repeated rows one; null ids come last;
    texts of any length are compared whole; an empty table stays empty; columns of any name pass as they are."""
    return drop_near_copies(docs, 5, 80, 100)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go.

    Null and empty texts hold none and stay; repeated rows are judged each, and alike; texts of any length are searched whole; an empty table
    stays empty, and without benchmark items all stay; columns of any name pass as they are."""
    name = fresh(docs, "_hits")
    return find_leaks(docs, table(spark, sf_dir, "benchmark"), name=name).filter(F.size(name) == 0).drop(name)


def drop_live_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a live-looking credential of one owner and few repositories go; widely copied examples stay.

    A document is its own repository, and its source the owner; rows that agree in id and text are one. Null and empty texts have no
    findings and stay; a null source is an owner of its own; texts of any length are scanned whole; an empty table stays empty; columns of any
    name pass as they are."""
    name = fresh(docs, "_key")
    key = F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("-")), F.xxhash64("text").cast("string"))
    found = scan_secrets(docs.select(key.alias(name), "text", "source"), id_col=name, repo_col=name)
    bad = found.filter(F.exists("findings", lambda f: f["verdict"] == "live")).select(name).distinct()
    return docs.withColumn(name, key).join(bad, name, "left_anti").select(docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All that is left, packed into sequences of 2048 tokens.

    Null and empty texts are one piece of the end id; texts of any length are cut and none dropped; repeated rows are packed each; an empty
    table gives an empty result; other columns are ignored."""
    import public_tokenizers

    return pack_documents(docs, public_tokenizers.path(VOCABULARY))


STAGES = [
    ("language_id", keep_known_languages),
    ("ngram_jaccard_join", keep_one_of_copies),
    ("decontamination", drop_leaks),
    ("secret_scan", drop_live_secrets),
    ("packing", pack),
]

#: Models, components and packing are beyond SQL; tests/llm compares each stage with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each on the written table of the one before."""
    scratch = Scratch(spark)
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        with transient(spark):
            docs = scratch.keep(stage(spark, docs, sf_dir))
        scratch.drop_but(docs)
    return STAGES[-1][1](spark, docs, sf_dir)
