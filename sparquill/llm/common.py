"""Helpers shared by the corpus operators.

Rules that all operators follow:

* a null text counts as the empty text, unless the operator says otherwise;
* a new column replaces an input column of the same name (names compare without case, as Spark does);
* intermediate tables go to the folder named by ``spark.checkpoint.dir`` only.
"""

from __future__ import annotations

import atexit
import time
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from ..session import delete, work_dir

#: Rows that a Python worker turns into objects at a time.
SLICE_ROWS = 256
#: A table is broadcast only if it is stored and has no more rows and no more bytes on disk.
BROADCAST_ROWS, BROADCAST_BYTES = 1_000_000, 32 << 20

COLLECT_S = 1.0

_written: list[str] = []
_collected = [0.0]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stored(df: DataFrame, name: str, by: str | None = None) -> DataFrame:
    """Write df as Parquet to the shared folder, in parts ``by`` a column if named, and read it again, which cuts its lineage.

    The table survives the loss of any executor. ``release`` deletes it.
    """
    spark = df.sparkSession
    path = f"{work_dir(spark)}/sparquill/{name}-{uuid.uuid4().hex}"
    (df.write.partitionBy(by) if by else df.write).parquet(path)
    if not _written:
        atexit.register(release, spark)
    _written.append(path)
    _collect(spark)
    out = spark.read.schema(df.schema).parquet(path)
    out._stored_at = path
    return out


def _collect(spark: SparkSession) -> None:
    """Collect the driver's garbage, once a COLLECT_S at most.

    Spark has no call that drops the shuffle files of a finished write: its cleaner waits for the driver to collect the plan.
    """
    now = time.monotonic()
    if now - _collected[0] >= COLLECT_S:
        spark.sparkContext._jvm.System.gc()
        _collected[0] = time.monotonic()


def discard(*tables: DataFrame) -> None:
    """Delete stored tables that nothing reads any more."""
    for df in tables:
        _written.remove(df._stored_at)
        delete(df.sparkSession, df._stored_at)


def release(spark: SparkSession) -> None:
    """Delete every intermediate table of this session; call it once results are written."""
    if spark.sparkContext._jsc is not None:
        while _written:
            delete(spark, _written.pop())


def without(df: DataFrame, names: list[str]) -> list[str]:
    """The columns of df that no new name replaces."""
    taken = {n.lower() for n in names}
    return [c for c in df.columns if c.lower() not in taken]


def bytes_of(df: DataFrame) -> int:
    """Bytes on disk of a stored table."""
    jvm = df.sparkSession.sparkContext._jvm
    found = jvm.org.apache.hadoop.fs.Path(df._stored_at)
    return found.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).getContentSummary(found).getLength()


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """df, stored, with the hint to broadcast it if it has no more than ``rows`` and BROADCAST_BYTES; else without, to be joined by a shuffle."""
    df = df if hasattr(df, "_stored_at") else stored(df, "small")
    return F.broadcast(df) if bytes_of(df) <= BROADCAST_BYTES and df.count() <= rows else df


def quoted(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")


def append_arrow(
    df: DataFrame,
    needs: list[str],
    make: Callable[[], Callable[[list[pa.Array]], list[pa.Array]]],
    fields: list[T.StructField],
) -> DataFrame:
    """Add columns computed by Arrow batches.

    ``make`` runs once in each task and returns a function from the needed columns of a slice of at
    most SLICE_ROWS rows to the new columns. Other columns pass through untouched.
    """
    keep = without(df, [f.name for f in fields])
    inputs = [f"__in{i}" for i in range(len(needs))]
    shown = df.select(*[quoted(c) for c in keep], *[quoted(c).alias(i) for c, i in zip(needs, inputs)])
    schema = T.StructType([df.schema[c] for c in keep] + fields)
    kinds = [to_arrow_type(f.dataType) for f in fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = make()
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE_ROWS):
                part = batch.slice(at, SLICE_ROWS)
                new = work([part.column(len(keep) + i) for i in range(len(inputs))])
                new = [x if x.type == k else x.cast(k) for x, k in zip(new, kinds)]
                yield pa.RecordBatch.from_arrays([part.column(i) for i in range(len(keep))] + new, schema.names)

    return shown.mapInArrow(run, schema)


def row_key(key: Column, text: Column) -> Column:
    """128 bits for an id and a text; null and empty texts differ."""
    shown = F.when(text.isNull(), F.lit("0")).otherwise(F.concat(F.lit("1"), text))
    return F.unhex(F.md5(F.concat(F.coalesce(key.cast("string"), F.lit("")), F.lit("\n"), shown)))


def sha256_of(column: Column) -> Column:
    return F.sha2(column.cast("binary"), 256)
