from __future__ import annotations

from pathlib import Path

import pytest

import __spark_entry__ as registry
from basketlens import session
from basketlens.sources.testdata import SCHEMAS

SIZE, START = "spark.sql.adaptive.advisoryPartitionSizeInBytes", "spark.sql.adaptive.coalescePartitions.initialPartitionNum"


@pytest.fixture
def small_tasks(spark, monkeypatch):
    monkeypatch.setattr(session, "TASK_BYTES", 1 << 20)
    monkeypatch.setattr(session, "PARTITION_BYTES", 1 << 20)
    yield spark
    spark.conf.unset(SIZE)
    spark.conf.unset(START)


def tasks(df) -> int:
    return df.repartition("id").rdd.getNumPartitions()


def test_more_rows_get_more_tasks_and_not_larger_ones(small_tasks):
    rows = small_tasks.range(600_000).selectExpr("id", "md5(cast(id AS string)) AS a", "md5(cast(-id AS string)) AS b")
    assert int(small_tasks.conf.get("spark.sql.shuffle.partitions")) == 8
    assert tasks(rows) <= 8
    session.tune(small_tasks, 64 << 20)
    assert tasks(rows) > 16


def test_small_inputs_keep_the_number_of_partitions(small_tasks):
    session.tune(small_tasks, 64 << 20)
    assert small_tasks.conf.get(START) == "64"
    session.tune(small_tasks, 4 << 20)
    assert small_tasks.conf.get(START, None) is None
    session.tune(small_tasks, 64 << 20)
    session.tune(small_tasks)
    assert small_tasks.conf.get(START, None) is None


@pytest.mark.parametrize("name", ["category_performance", "churn_features", "popular_products", "orders_by_hour"])
def test_queries_are_set_up_by_the_size_of_their_tables(small_tasks, name):
    path = "/root/testdata/sf0.1"
    size = sum(Path(path, f"{t}.parquet").stat().st_size for t in SCHEMAS)
    registry.queries()[name](small_tasks, path)
    assert small_tasks.conf.get(SIZE) == str(1 << 20)
    assert small_tasks.conf.get(START) == str(-(-size // (1 << 20)))


def test_a_scan_gets_more_tasks_and_not_larger_ones(small_tasks, monkeypatch, tmp_path):
    """Rows are grouped in the scan's tasks before they move, so what a task reads must not grow with the table."""
    monkeypatch.setattr(session, "SCAN_BYTES", 1 << 18, raising=False)
    monkeypatch.setattr(session, "TASK_BYTES", 1 << 18)
    path = str(tmp_path / "rows")
    rows = small_tasks.range(400_000).selectExpr("id", "md5(cast(id AS string)) AS a")
    rows.coalesce(1).write.option("parquet.block.size", 1 << 18).parquet(path)
    size = sum(f.stat().st_size for f in Path(path).glob("*.parquet"))
    cost = "spark.sql.files.openCostInBytes"
    small_tasks.conf.set(cost, 1 << 10)
    try:
        session.tune(small_tasks, size)
        scan = small_tasks.read.parquet(path)
        assert scan.rdd.getNumPartitions() >= size // (1 << 18) > 16
    finally:
        small_tasks.conf.unset(cost)
        small_tasks.conf.unset("spark.sql.files.maxPartitionBytes")
