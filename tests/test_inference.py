"""Types of columns outside the contracts."""

import datetime as dt

import pytest

from basketlens.sources.inference import infer_types
from basketlens.sources.io import read_dataset

CASES = {
    "integers": (["1", "-2", "+3", None, "0"], "bigint"),
    "largest integer": (["9223372036854775807"], "bigint"),
    "too large an integer": (["9223372036854775808", "1"], "double"),
    "doubles": (["1.5", "-.5", "2.", "1e3", "inf"], "double"),
    "integers and doubles": (["1", "2.5", None], "double"),
    "numbers and text": (["1", "x"], "string"),
    "leading zeros": (["007", "1"], "string"),
    "suffixes": (["1d", "2.0f"], "string"),
    "spaces": ([" 1", "2 "], "string"),
    "booleans": (["true", "False", "TRUE"], "boolean"),
    "booleans and integers": (["true", "1"], "string"),
    "booleans and timestamps": (["true", "2024-01-01"], "string"),
    "dates and times": (["2024-01-01", "2024-02-03 04:05:06", "2024-02-03T04:05", "2024-01-01 00:00:00.123456"], "timestamp_ntz"),
    "no such day": (["2024-02-30"], "string"),
    "integers and timestamps": (["2024", "2024-01-01"], "string"),
    "nothing": ([None, None], "string"),
    "empty text": ([""], "string"),
}


def test_every_case_in_one_pass(spark, monkeypatch):
    names = list(CASES)
    height = max(len(v) for v, _ in CASES.values())
    rows = [tuple(CASES[n][0][i] if i < len(CASES[n][0]) else None for n in names) for i in range(height)]
    df = spark.createDataFrame(rows, ", ".join(f"`{n}` string" for n in names))
    passes = []
    agg = type(df).agg
    monkeypatch.setattr(type(df), "agg", lambda self, *a: passes.append(1) or agg(self, *a))
    assert infer_types(df, names) == {n: kind for n, (_, kind) in CASES.items()}
    assert len(passes) == 1


def test_columns_beyond_the_contract_get_types(spark, tmp_path):
    path = tmp_path / "customers.csv"
    path.write_text("customer_id,age,rate,member,since,tag,a.b\n1,30,1.5,True,2024-01-02,007,1\n2,NA,2,False,,8,\n")
    df = read_dataset(spark, str(path), "customers")
    assert dict(df.dtypes) == {
        "customer_id": "string", "age": "bigint", "rate": "double", "member": "boolean", "since": "timestamp_ntz",
        "tag": "string", "a.b": "bigint",
    }
    first = df.orderBy("customer_id").first()
    assert tuple(first) == ("1", 30, 1.5, True, dt.datetime(2024, 1, 2), "007", 1)
    assert dict(read_dataset(spark, str(path), "customers", infer=False).dtypes)["age"] == "string"


@pytest.mark.parametrize("rows", ["", "1,\n2,\n"])
def test_without_values_text_stays(spark, tmp_path, rows):
    path = tmp_path / "customers.csv"
    path.write_text("customer_id,extra\n" + rows)
    assert dict(read_dataset(spark, str(path), "customers").dtypes)["extra"] == "string"


def test_reviews_too(spark, tmp_path):
    path = tmp_path / "reviews.csv"
    path.write_text('order_id,review_comment_message,votes\n1,"a\nb",3\n2,c,4\n')
    assert dict(read_dataset(spark, str(path), "reviews").dtypes)["votes"] == "bigint"
