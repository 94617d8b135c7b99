"""What the corpus operators share: Arrow plumbing and tables written to the cluster's shared folder."""

from __future__ import annotations

import atexit
import gc
import re
import tempfile
import time
import uuid
from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

#: Rows in an Arrow batch: at a few kB a text, a few MB a batch in a Python worker.
BATCH_ROWS = 1024
#: Rows of a few numbers (some 30 bytes each) up to which they are broadcast.
FETCHED = 1 << 20
#: Seconds after which release() looks again.
RELEASE_AGAIN = 0.4

#: Bytes of stored tables after which it is worth to look for shuffle files: what leads to a table was about as large.
RELEASED = 8 << 20

_scratch: dict[str, str] = {}
_written: dict[str, int] = {}


def small_batches(spark: SparkSession) -> None:
    """Hand Python workers batches of a few MB, unless the session already asks for smaller ones."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= BATCH_ROWS:
        spark.conf.set(key, str(BATCH_ROWS))


def scratch(spark: SparkSession) -> str:
    """This application's folder under spark.checkpoint.dir; where that is unset, under the warehouse, or in tests on one machine a temporary folder."""
    app = spark.sparkContext.applicationId
    if app not in _scratch:
        base = spark.conf.get("spark.checkpoint.dir", None)
        if not base:
            alone = re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master)
            base = tempfile.mkdtemp(prefix="glyphmill-") if alone else spark.conf.get("spark.sql.warehouse.dir")
        _scratch[app] = f"{base.rstrip('/')}/glyphmill-{app}"
        atexit.register(_remove, spark, _scratch[app])
    return _scratch[app]


def _remove(spark: SparkSession, path: str) -> None:
    try:
        drop(spark, path)
    except Exception:  # the JVM may have ended before this hook runs
        pass


def _place(spark: SparkSession, path: str):
    """A path and its file system."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def _size(spark: SparkSession, path: str) -> int:
    where, system = _place(spark, path)
    return system.getContentSummary(where).getLength()


def drop(spark: SparkSession, path: str) -> None:
    where, system = _place(spark, path)
    system.delete(where, True)


def release(spark: SparkSession, small: bool = False) -> None:
    """Let the cluster delete shuffle files that no plan refers to any more; stored tables don't need them.

    That is done once RELEASED bytes of tables were stored since the last time, or now, if a small table came from large shuffles.

    The last job's plan is still in the queue of listeners for a moment, hence the second round.
    """
    app = spark.sparkContext.applicationId
    if not small and _written.get(app, 0) < RELEASED:
        return
    _written[app] = 0
    gc.collect()
    for pause in (0, RELEASE_AGAIN):
        time.sleep(pause)
        spark.sparkContext._jvm.System.gc()


def new_path(spark: SparkSession, name: str) -> str:
    """A place in the shared folder where nothing is yet."""
    return f"{scratch(spark)}/{name}-{uuid.uuid4().hex[:12]}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """df, written once as Parquet to the shared folder and reread: cuts lineage and survives lost executors."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    app = spark.sparkContext.applicationId
    _written[app] = _written.get(app, 0) + _size(spark, path)
    made = spark.read.schema(T.StructType([T.StructField(f.name, f.dataType, True) for f in df.schema.fields])).parquet(path)
    made.stored_at = path
    return made


def path_of(df: DataFrame) -> str:
    """Where stored() wrote this table."""
    return df.stored_at


def forget(*tables: DataFrame) -> None:
    """Delete tables that stored() wrote, at their last use."""
    for df in tables:
        drop(df.sparkSession, path_of(df))


def bounded(rows: DataFrame) -> DataFrame:
    """Stored rows of a few numbers, to be broadcast if they are at most FETCHED; beyond it, joins shuffle."""
    return F.broadcast(rows) if rows.count() <= FETCHED else rows


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Names for helper columns that no column of df has, in any case."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        out.append(name)
    return out


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with value evaluated once."""
    return F.transform(F.array(value), use)[0]


def append_columns(df: DataFrame, inputs: Sequence[str], fields: T.StructType, kernel: Callable[..., list]) -> DataFrame:
    """df with the columns that kernel makes from the input columns' Arrow arrays.

    Other columns pass through; a column whose name a new one has, in any case, is replaced.
    """
    small_batches(df.sparkSession)
    new = {f.name.lower() for f in fields.fields}
    carried = [c for c in df.columns if c.lower() not in new]
    needed = [c for c in df.columns if c in carried or c in inputs]
    schema = T.StructType([df.schema[c] for c in carried] + fields.fields)
    types = [to_arrow_type(f.dataType) for f in fields.fields]
    names = schema.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = kernel(*(batch.column(needed.index(c)) for c in inputs))
            made = [m if isinstance(m, (pa.Array, pa.ChunkedArray)) else pa.array(m, type=t) for m, t in zip(made, types, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(needed.index(c)) for c in carried] + made, names=names)

    return df.select(*(F.col(f"`{c}`") for c in needed)).mapInArrow(run, schema)


def texts(df: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Key and whole text alone, null texts as empty ones."""
    return df.select(F.col(key), F.coalesce(F.col(text), F.lit("")).alias(text))
