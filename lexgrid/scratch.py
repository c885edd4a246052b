"""Tables written to the folder that driver and executors share, for what several parts of a plan read."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_ROOTS: list[str] = []


def shared_folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``. Only a local session without one gets a temporary
    folder, which goes when the driver ends."""
    at = spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        own = tempfile.mkdtemp(prefix="shared-")
        atexit.register(shutil.rmtree, own, ignore_errors=True)
        at = f"file://{own}"
        spark.conf.set("spark.checkpoint.dir", at)
    return at


def delete(spark: SparkSession, folder: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(folder)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def clear_scratch(spark: SparkSession) -> None:
    """Delete all scratch tables of this driver; for callers who have written the results that read them."""
    while _ROOTS:
        delete(spark, _ROOTS.pop())


@contextmanager
def transient(spark: SparkSession) -> Iterator[None]:
    """Scratch tables of operators that run inside go when the block ends, so what they return must be written in it."""
    n = len(_ROOTS)
    try:
        yield
    finally:
        while len(_ROOTS) > n:
            delete(spark, _ROOTS.pop())


class Scratch:
    """Written tables, which cut lineage and survive lost executors."""

    def __init__(self, spark: SparkSession):
        self.spark, self.root = spark, f"{shared_folder(spark).rstrip('/')}/t-{uuid.uuid4().hex}"
        self.n = 0
        self.tables: list[DataFrame] = []
        _ROOTS.append(self.root)

    def keep(self, frame: DataFrame) -> DataFrame:
        self.n += 1
        at = f"{self.root}/{self.n}"
        frame.write.option("compression", "zstd").parquet(at)
        kept = self.spark.read.schema(frame.schema).parquet(at)
        kept._kept_at = at
        self.tables.append(kept)
        return kept

    def drop(self, *frames: DataFrame) -> None:
        """Delete tables that no later step reads."""
        for f in frames:
            delete(self.spark, f._kept_at)
            self.tables = [t for t in self.tables if t is not f]

    def drop_but(self, *frames: DataFrame) -> None:
        """Delete all tables but those that the result still reads."""
        self.drop(*(t for t in self.tables if not any(t is f for f in frames)))
