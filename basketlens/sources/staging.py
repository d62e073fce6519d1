"""Staged tables: results that several branches of a job read again.

A staged table is written as Parquet below the folder `spark.checkpoint.dir`
names, so losing an executor loses nothing, the lineage ends there, and later
reads are columnar and carry true sizes for the join planner.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

from basketlens.operators.skew import heavy_keys


def scratch_dir(spark: SparkSession) -> str:
    """Folder for this application's staged tables."""
    sc = spark.sparkContext
    base = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not base:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = tempfile.mkdtemp(prefix="basketlens-")
        atexit.register(shutil.rmtree, base, ignore_errors=True)
        sc.setCheckpointDir(base)
    return f"{base.rstrip('/')}/basketlens-stage/{sc.applicationId}"


def stage(df: DataFrame) -> DataFrame:
    """Write df once and return the written table."""
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def stage_by_month(tx: DataFrame, month: str = "order_year_month", key: str = "order_id") -> DataFrame:
    """Write tx once, a folder for each month, and within it a file for each bucket of the order ids.

    A report on some months reads their folders only; whatever groups or joins by order finds the rows of an order in one
    task, without moving them. Rows move once, by order, on the way there. A single order that holds a
    large part of the rows would make its bucket as large; with such orders (see heavy_keys) the table has months only,
    written from where the rows lie. Rows without a month are one more folder.

    The table is known to this application's catalogue; `clear_staged` and `staging` drop it.
    """
    spark = tx.sparkSession
    name = f"basketlens_{uuid.uuid4().hex}"
    path = f"{scratch_dir(spark)}/{name}"
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    even = not heavy_keys(tx, [key])[key].salts
    rows = tx.repartition(buckets, key) if even else tx
    writer = rows.write.partitionBy(month).option("path", path)
    (writer.bucketBy(buckets, key).sortBy(key) if even else writer).saveAsTable(name)
    _by_month.setdefault(spark.sparkContext.applicationId, {})[path] = name
    return spark.table(name).select(*tx.columns)


def _drop_tables(spark: SparkSession, paths: set[str] | None = None) -> None:
    """Forget the tables below these paths (all if None); their files are deleted by the caller."""
    known = _by_month.get(spark.sparkContext.applicationId, {})
    for path in [p for p in known if paths is None or any(p.endswith(x.rsplit("/", 1)[-1]) for x in paths)]:
        spark.sql(f"DROP TABLE IF EXISTS {known.pop(path)}")


@contextmanager
def staging(spark: SparkSession) -> Iterator[None]:
    """A report: what is staged inside is deleted at its end, so use its results inside."""
    jvm = spark.sparkContext._jvm
    folder = jvm.org.apache.hadoop.fs.Path(scratch_dir(spark))
    fs = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def tables() -> set[str]:
        return {s.getPath().toString() for s in fs.listStatus(folder)} if fs.exists(folder) else set()

    before = tables()
    try:
        yield
    finally:
        _drop_tables(spark, tables() - before)
        for path in tables() - before:
            fs.delete(jvm.org.apache.hadoop.fs.Path(path), True)


# Tables of stage_by_month by application: path -> name.
_by_month: dict[str, dict[str, str]] = {}
# Goes up whenever staged tables are deleted: what was built on older ones must be built anew.
generation = 0


def clear_staged(spark: SparkSession) -> None:
    """Delete this application's staged tables; frames built on them stop working."""
    global generation
    generation += 1
    _drop_tables(spark)
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(scratch_dir(spark))
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    fs.delete(path, True)
