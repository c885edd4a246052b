"""Incremental ingestion of article files."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from lexgrid.operators.corpus import pending


def ingest_new(spark: SparkSession, source: str, schema: StructType, store: str, key: str, checkpoint: str, enrich: Callable[[DataFrame], DataFrame] | None = None) -> StreamingQuery:
    """Appends rows of new files whose key the store doesn't have, once each; ends when all files are read.
    A batch that is run again finds its rows stored and appends none. Of equal keys in one batch the smallest row stays, field by field.
    Of the store a batch reads the key column alone."""

    def batch(rows: DataFrame, _: int) -> None:
        rest = [c for c in rows.columns if c != key]
        new = rows.groupBy(key).agg(F.min(F.struct(*rest)).alias("_row")).select(key, "_row.*").select(rows.columns)
        try:
            new = pending(new, spark.read.schema(schema).parquet(store).select(key), key)
        except Exception as error:  # no store yet
            if "PATH_NOT_FOUND" not in str(error):
                raise
        (enrich(new) if enrich else new).write.mode("append").parquet(store)

    return spark.readStream.schema(schema).parquet(source).writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
