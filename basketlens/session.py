"""Session settings the operators rely on at scale."""

from __future__ import annotations

from pyspark.sql import SparkSession

# Runtime SQL settings. Forced skew handling lets AQE split a hot join key even
# where the split costs one more shuffle of (already aggregated) rows upstream.
SQL_SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
}
# Shuffled bytes that a task reads, about: rows that are sorted and grouped take up to 30 times as much memory.
TASK_BYTES = 8 << 20
# Bytes of a file that a task reads at most: it groups what it reads before the shuffle, and 128 MB, as Spark reads them, may hold ten million items.
SCAN_BYTES = 16 << 20
# Bytes of input for each shuffle partition a query starts with; AQE puts small ones together.
PARTITION_BYTES = 4 << 20


def tune(spark: SparkSession, input_bytes: int = 0) -> SparkSession:
    """Apply the settings above to an existing session.

    With the size of the input, tasks also get no more to sort and group as the input grows: scans read SCAN_BYTES of a file
    at most (or one row group), AQE puts partitions together up to TASK_BYTES only, and starts with more than
    spark.sql.shuffle.partitions of them if the input is large. What else looks at that number (heavy keys, buckets) sees the caller's.
    """
    for key, value in SQL_SETTINGS.items():
        spark.conf.set(key, value)
    if input_bytes:
        spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", TASK_BYTES)
        spark.conf.set("spark.sql.files.maxPartitionBytes", SCAN_BYTES)
    partitions, start = -(-input_bytes // PARTITION_BYTES), "spark.sql.adaptive.coalescePartitions.initialPartitionNum"
    if partitions > int(spark.conf.get("spark.sql.shuffle.partitions")):
        spark.conf.set(start, partitions)
    else:
        spark.conf.unset(start)
    return spark


def local_session(cores: str = "*", app: str = "basketlens", memory: str = "12g") -> SparkSession:
    """A local session for tests, the benchmark and notebooks."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return tune(spark)
