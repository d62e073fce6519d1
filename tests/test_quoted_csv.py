"""Quoted line breaks in CSV files read by several tasks."""

import random

import pytest
from pyspark.sql import functions as F

from basketlens.sources import quoted_csv
from basketlens.sources.io import read_dataset

NAMES = ["order_id", "review_score", "review_comment_message", "note"]


def field(rng):
    text = "".join(rng.choice(["a", "b ", ",", "\n", '"', "é", "\n\n", "\r\n", "xyz"]) for _ in range(rng.randint(0, 12)))
    plain = not any(c in text for c in ',\n\r"')
    return text if plain and rng.random() < 0.7 else '"' + text.replace('"', '""') + '"'


def made(seed, rows, end="\n", last=True):
    rng = random.Random(seed)
    lines = [",".join(NAMES)]
    for i in range(rows):
        lines.append(f"o{i},{rng.randint(1, 5)},{field(rng)},{field(rng)}")
        if rng.random() < 0.02:
            lines.append("")
    return end.join(lines) + (end if last else "")


def in_one_task(spark, path):
    df = spark.read.option("header", True).option("multiLine", True).option("quote", '"').option("escape", '"').csv(path)
    return sorted(map(repr, df.collect()))


@pytest.fixture
def small_splits(spark):
    for key, value in (("spark.sql.files.maxPartitionBytes", "700"), ("spark.sql.files.openCostInBytes", "0")):
        spark.conf.set(key, value)
    yield
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    spark.conf.unset("spark.sql.files.openCostInBytes")


@pytest.mark.parametrize("seed,end,last", [(1, "\n", True), (2, "\n", False), (3, "\r\n", True), (4, "\r\n", False)])
def test_many_splits_equal_one_task(spark, tmp_path, small_splits, seed, end, last):
    for k in range(3):
        (tmp_path / f"f{k}.csv").write_text(made(seed * 10 + k, 400, end, last), newline="")
    path = str(tmp_path)
    assert quoted_csv.text_lines(spark, path).rdd.getNumPartitions() > 20
    got = quoted_csv.read_quoted_csv(spark, path, NAMES)
    assert sorted(map(repr, got.collect())) == in_one_task(spark, path)


def test_some_splits_begin_inside_a_field(spark, tmp_path, small_splits):
    path = tmp_path / "f.csv"
    path.write_text(made(7, 500), newline="")
    splits = quoted_csv.quote_parity(quoted_csv.text_lines(spark, str(path)))
    [inside] = splits.inside.values()
    assert 0 < inside.sum() < len(inside)
    text = path.read_text(newline="")
    for start, begins in zip(*[next(iter(d.values())) for d in (splits.starts, splits.inside)]):
        # A split's first line is the first that begins in it.
        line = text.encode()[: text.encode().index(b"\n", start - 1) + 1] if start else b""
        assert begins == (line.count(b'"') % 2 == 1)


def test_a_field_longer_than_several_splits(spark, tmp_path, small_splits):
    path = tmp_path / "f.csv"
    long = "\n".join(f'line "{i}", of a long text' for i in range(600)).replace('"', '""')
    path.write_text(f'order_id,review_score,review_comment_message,note\no1,1,"{long}",x\no2,2,"{long}","{long}"\no3,3,c,\n')
    got = quoted_csv.read_quoted_csv(spark, str(path), NAMES)
    assert sorted(map(repr, got.collect())) == in_one_task(spark, str(path))
    parts = quoted_csv.cut(*(lambda x: (x, quoted_csv.quote_parity(x)))(quoted_csv.text_lines(spark, str(path))))
    assert parts.filter(F.col("kind") == quoted_csv.LATER).count() > 50


def test_small_arrow_batches_do_not_matter(spark, tmp_path, small_splits):
    path = tmp_path / "f.csv"
    path.write_text(made(9, 300), newline="")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        got = sorted(map(repr, quoted_csv.read_quoted_csv(spark, str(path), NAMES).collect()))
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert got == in_one_task(spark, str(path))


@pytest.mark.parametrize("text", [
    "order_id,a\n", "order_id,a", 'order_id,"a\nb"\n1,2\n', 'order_id,a\n1,"open\nto the end', "order_id,a\n1\n1,2,3\n,\n",
    '\n\norder_id,a\n\n"1","2"\n\n', 'order_id,a\r\n1,"x\r\ny"', 'order_id,a\n1,"x\r\ny"\n', 'order_id,a\r\n1,"x\ny"\r\n',
    'order_id,a\n"","x"\n" ",\n',
])
def test_odd_files_equal_one_task(spark, tmp_path, text):
    path = tmp_path / "f.csv"
    path.write_text(text, newline="")
    names = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(str(path)).columns
    got = quoted_csv.read_quoted_csv(spark, str(path), names)
    assert sorted(map(repr, got.collect())) == in_one_task(spark, str(path))


def test_a_file_that_is_split_anew_is_an_error(spark, tmp_path, small_splits):
    path = tmp_path / "f.csv"
    path.write_text(made(11, 300), newline="")
    df = quoted_csv.read_quoted_csv(spark, str(path), NAMES)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "900")
    lines = quoted_csv.text_lines(spark, str(path))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "700")
    splits = quoted_csv.quote_parity(quoted_csv.text_lines(spark, str(path)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "900")
    with pytest.raises(Exception, match="split differently"):
        quoted_csv.cut(lines, splits).collect()
    assert df is not None


def test_reviews_are_read_in_several_tasks(spark, tmp_path, small_splits):
    path = tmp_path / "reviews.csv"
    path.write_text(made(13, 400), newline="")
    df = read_dataset(spark, str(path), "reviews")
    assert df.rdd.getNumPartitions() > 5 and dict(df.dtypes)["review_score"] == "double"
    want = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(str(path))
    texts = [r[0] for r in want.select("review_comment_message").collect() if r[0] is not None]
    assert sorted(r[0] for r in df.select("review_comment_message").collect() if r[0] is not None) == sorted(texts)
