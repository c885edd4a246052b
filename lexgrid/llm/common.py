"""What the training-data operators share: Arrow mapping and scratch tables."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from lexgrid.scratch import Scratch, clear_scratch, shared_folder  # noqa: F401


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Rows and bytes of a batch that are Python values at once.
ROWS, BYTES = 2000, 8_000_000
_WARM: dict[str, object] = {}


def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        step = max(1, min(ROWS, BYTES * batch.num_rows // max(1, batch.nbytes)))
        for i in range(0, batch.num_rows, step):
            yield batch.slice(i, step)


def cool() -> None:
    _WARM.clear()


def give_back() -> None:
    """Return freed memory to the system when a task ends, as the worker stays while others work."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # not glibc
        pass


def warm(key: str, make: Callable[[], object]):
    """What a worker keeps for its next tasks: of one operator at a time."""
    if key not in _WARM:
        _WARM.clear()
        _WARM[key] = make()
    return _WARM[key]


def map_rows(frame: DataFrame, ddl: str, start: Callable[[], Callable[..., list]], keep: bool = False) -> DataFrame:
    """Map Arrow batches of ``frame``: ``start()`` runs once a task and returns a
    function from the columns (as Python lists) to the output columns (as lists). ``keep``: it uses :func:`warm`."""
    schema = T.StructType.fromDDL(ddl)
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not keep:
            cool()
        step = start()
        for batch in parts(batches):
            out = step(*(c.to_pylist() for c in batch.columns))
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(out, arrow)], schema=arrow)
        step = batch = out = None
        give_back()

    return frame.mapInArrow(run, schema)


def reduce_rows(frame: DataFrame, ddl: str, reduce: Callable[[Iterator[tuple[list, ...]]], list]) -> DataFrame:
    """One output batch for each task: ``reduce`` sees the batches' columns as lists."""
    schema = T.StructType.fromDDL(ddl)
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cool()
        out = reduce(tuple(c.to_pylist() for c in b.columns) for b in parts(batches))
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(out, arrow)], schema=arrow)

    return frame.mapInArrow(run, schema)


def texts(docs: DataFrame, id_col: str, text_col: str, *more: str, binary: bool = False) -> DataFrame:
    """id, text and further columns only, so that extra columns never clash; null text is empty."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(F.col(id_col), (text.cast("binary") if binary else text).alias("_text"), *(F.col(m) for m in more))


def first_rows(frame: DataFrame, by: list[str], order: list, n: int) -> DataFrame:
    """The first ``n`` rows of each value of ``by`` (of all, without one) in ``order``: first of every group of tasks, so that no task gets ``n`` of each task."""
    group = F.spark_partition_id() % 512
    near = frame.withColumn("_group", group).withColumn("_n", F.row_number().over(Window.partitionBy(*by, "_group").orderBy(*order))).filter(F.col("_n") <= n).drop("_n", "_group")
    if not by:
        return near.orderBy(*order).limit(n)
    return near.withColumn("_n", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).filter(F.col("_n") <= n).drop("_n")


def fresh(frame: DataFrame, name: str) -> str:
    """A column name that ``frame`` doesn't have."""
    taken = {c.lower() for c in frame.columns}
    while name.lower() in taken:
        name += "_"
    return name


def hot_keys(scratch: Scratch, rows: DataFrame, keys: str | list[str], most: int) -> DataFrame | None:
    """The keys with more than ``most`` rows, and how many tasks each is dealt to; None if there are none. It has a row for every ``most``
    rows at most, and as a written table its size is known, so that Spark decides how to join it."""
    if hasattr(rows, "_kept_at") and rows.count() <= most:  # a written table's rows are counted by its files' ends
        return None
    keys = [keys] if isinstance(keys, str) else keys
    hot = scratch.keep(rows.groupBy(*keys).agg(F.ceil(F.count("*") / most).cast("int").alias("_parts")).filter("_parts > 1"))
    return None if hot.isEmpty() else hot


def dealt(rows: DataFrame, lookup: DataFrame, keys: str | list[str], by: str, hot: DataFrame | None) -> DataFrame:
    """``rows`` joined with ``lookup`` (a row for each key): those of a hot key are dealt by the hash of ``by``, and its
    lookup row is repeated for each part."""
    keys = [keys] if isinstance(keys, str) else keys
    if hot is None:
        return rows.join(lookup, keys)
    parts = F.coalesce("_parts", F.lit(1))
    left = rows.join(hot, keys, "left").withColumn("_salt", F.pmod(F.xxhash64(by), parts).cast("int")).drop("_parts")
    right = lookup.join(hot, keys, "left").withColumn("_salt", F.explode(F.sequence(F.lit(0), parts - 1))).drop("_parts")
    return left.join(right, [*keys, "_salt"]).drop("_salt")


def indexed(scratch: Scratch, frame: DataFrame, *keys: str) -> DataFrame:
    """``frame`` with a gapless ``idx`` from 0 in the order of ``keys``, dealt by ranges of
    the whole key, so that no single key value fills a task. The order is total only if
    the keys are; equal rows get neighbouring numbers."""
    cols = [F.col(k) for k in keys]
    part = frame.repartitionByRange(_ranges(frame), *cols).sortWithinPartitions(*cols)
    kept = scratch.keep(part.withColumn("_m", F.monotonically_increasing_id()))
    pid = F.shiftright(F.col("_m"), 33)
    sizes = [(r["p"], r["n"]) for r in kept.groupBy(pid.alias("p")).agg(F.count("*").alias("n")).orderBy("p").collect()]
    starts, total = [], 0
    for p, n in sizes:  # one entry for each partition
        starts.append((p, total))
        total += n
    offsets = frame.sparkSession.createDataFrame(starts or [(0, 0)], "_p long, _s long")
    return (
        kept.withColumn("_p", pid)
        .join(F.broadcast(offsets), "_p")
        .withColumn("idx", F.col("_s") + F.col("_m").bitwiseAND((1 << 33) - 1))
        .drop("_p", "_s", "_m")
    )


def _ranges(frame: DataFrame) -> int:
    return int(frame.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def add_column(frame: DataFrame, inputs: list[str], name: str, ddl: str, start: Callable[[], Callable[..., list]]) -> DataFrame:
    """``frame`` with one more column, from the ``inputs``' values as Python lists; the
    other columns pass as they are."""
    schema = T.StructType([*frame.schema.fields, T.StructField(name, T.DataType.fromDDL(ddl))])
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cool()
        step = start()
        for batch in parts(batches):
            out = pa.array(step(*(batch.column(batch.schema.get_field_index(c)).to_pylist() for c in inputs)), arrow.field(len(arrow) - 1).type)
            yield pa.RecordBatch.from_arrays([*batch.columns, out], schema=arrow)
        step = batch = out = None
        give_back()

    return frame.mapInArrow(run, schema)
