"""What the operators share: narrow inputs, staged tables, session limits."""

from __future__ import annotations

import ctypes
import gc
import uuid
from collections.abc import Callable, Iterator
from weakref import WeakKeyDictionary

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from basketlens.sources.staging import scratch_dir

# Rows of text an Arrow batch may hold; a worker then needs a few dozen MB for it.
ARROW_ROWS = 1000
# And its bytes, about: a thousand long texts, or the sets of a thousand pairs of them, may be a hundred MB.
ARROW_BYTES = 4 << 20


def column(name: str) -> Column:
    """A column by its exact name, dots included."""
    return F.col("`" + name.replace("`", "``") + "`")


def narrow(df: DataFrame, **names: str) -> DataFrame:
    """Only the named columns, under the operator's own names, so that no other column can clash."""
    return df.select(*[column(source).alias(own) for own, source in names.items()])


def prepared(spark: SparkSession) -> SparkSession:
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(ARROW_BYTES))
    return spark


def keep_where(df: DataFrame, text_col: str, keep: Callable[[pa.Array], np.ndarray]) -> DataFrame:
    """The rows of df whose text `keep` marks, as they are; nothing is shuffled.

    Columns are numbered on the way, so that any names will do.
    """
    numbered = df.toDF(*[f"c{i}" for i in range(len(df.columns))])
    place = df.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(keep(batch.column(place))))

    return numbered.mapInArrow(frugal(run), numbered.schema).toDF(*df.columns)


def frugal(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """run for mapInArrow, giving free memory back at its end: workers go on to other tasks, and keep what they once had otherwise."""

    def frugally(batches: Iterator) -> Iterator:
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
            if trim:
                trim(0)

    return frugally


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return prepared(spark).read.parquet(f"{sf_dir}/{table}.parquet")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path in the folder that driver and executors share (spark.checkpoint.dir)."""
    return f"{scratch_dir(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a table in the shared folder: lineage ends there, and lost executors cost nothing."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    _paths[out] = path
    return out


# Where written tables lie.
_paths: WeakKeyDictionary[DataFrame, str] = WeakKeyDictionary()


def forget(*tables: DataFrame | None) -> None:
    """Delete written tables that nothing reads any more, and the shuffle files of what they were made of.

    Spark drops a shuffle's files once the driver's garbage collector finds that no plan refers to it, so it is asked to look.
    """
    spark = None
    for df in tables:
        if df is None or df not in _paths:
            continue
        spark = df.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(_paths.pop(df))
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
    if spark is not None:
        gc.collect()
        spark._jvm.System.gc()


def is_written(df: DataFrame) -> bool:
    return df in _paths
