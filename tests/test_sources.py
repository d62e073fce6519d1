import datetime as dt

import pytest

from basketlens.sources.contracts import CONTRACTS, ContractError, missing_columns, require_minimum, validate
from basketlens.sources.io import contract_report, load_report, preview, read_dataset, read_result, write_result


def test_contracts_name_the_seven_tables_and_their_required_columns():
    assert list(CONTRACTS) == [
        "customers", "orders", "order_items", "order_payments", "products", "product_translation", "reviews",
    ]
    assert CONTRACTS["orders"].required == ["order_id", "customer_id", "order_status", "order_purchase_timestamp"]
    assert "freight_value" in CONTRACTS["order_items"].optional


def test_validation_names_the_missing_column(frame):
    orders = frame("order_id string, customer_id string, order_purchase_timestamp string", ("o", "c", "t"))
    assert missing_columns(orders, "orders") == ["order_status"]
    with pytest.raises(ContractError, match="order_status"):
        validate(orders, "orders")


def test_minimum_tables(shop):
    del shop["orders"]
    with pytest.raises(ContractError, match="orders"):
        require_minimum(shop)


def test_csv_is_read_by_name_with_missing_values_and_line_breaks(spark, tmp_path):
    path = tmp_path / "reviews.csv"
    path.write_text(
        "review_score,order_id,review_comment_message,review_creation_date,extra\n"
        '4,o1,"two\nlines, ""quoted""",2024-01-02 03:04:05,x\n'
        "NA,o2,null,bad,y\n"
        "abc,o3,,2024-01-02,\n"
    )
    rows = {r.order_id: r for r in read_dataset(spark, str(path), "reviews").collect()}
    assert rows["o1"].review_score == 4.0
    assert rows["o1"].review_comment_message == 'two\nlines, "quoted"'
    assert rows["o1"].review_creation_date == dt.datetime(2024, 1, 2, 3, 4, 5)
    assert rows["o2"].review_score is None and rows["o2"].review_comment_message is None
    assert rows["o2"].review_creation_date is None and rows["o3"].review_score is None
    assert rows["o3"].review_creation_date == dt.datetime(2024, 1, 2) and rows["o2"].extra == "y"


def test_csv_keeps_leading_zeros_and_reads_gapped_integers(spark, tmp_path):
    path = tmp_path / "customers.csv"
    path.write_text("customer_id,customer_zip_code_prefix\n007,01234\n")
    row = read_dataset(spark, str(path), "customers").first()
    assert (row.customer_id, row.customer_zip_code_prefix) == ("007", "01234")
    path = tmp_path / "payments.csv"
    path.write_text("order_id,payment_value,payment_sequential\no1,9.5,2.0\no2,,\n")
    rows = read_dataset(spark, str(path), "order_payments").orderBy("order_id").collect()
    assert [(r.payment_value, r.payment_sequential) for r in rows] == [(9.5, 2), (None, None)]


def test_csv_without_a_required_column_fails(spark, tmp_path):
    path = tmp_path / "items.csv"
    path.write_text("order_id,price\no1,1\n")
    with pytest.raises(ContractError, match="product_id"):
        read_dataset(spark, str(path), "order_items")


def test_results_round_trip(spark, frame, tmp_path):
    df = frame("items array<string>, lift double", (["a", "b"], 1.5), (["c"], 2.0))
    write_result(df, str(tmp_path / "out.csv"))
    back = spark.read.option("header", True).csv(str(tmp_path / "out.csv")).orderBy("items").collect()
    assert [tuple(r) for r in back] == [("a, b", "1.5"), ("c", "2.0")]
    write_result(df, str(tmp_path / "out.parquet"), fmt="parquet")
    assert spark.read.parquet(str(tmp_path / "out.parquet")).count() == 2


def test_parquet_input_keeps_id_types(spark, frame, tmp_path):
    path = str(tmp_path / "items")
    frame("order_id bigint, product_id bigint, price string", (1, 2, "3.5")).write.parquet(path)
    df = read_dataset(spark, path, "order_items", fmt="parquet")
    assert dict(df.dtypes) == {"order_id": "bigint", "product_id": "bigint", "price": "double"}


def test_load_report_and_preview(shop):
    counts = {r.dataset: r.row_count for r in load_report(shop).collect()}
    assert counts["order_items"] == 7 and counts["customers"] == 2
    assert preview(shop["order_items"], 3).count() == 3


def test_large_csv_files_are_read_in_several_tasks(spark, tmp_path):
    path = tmp_path / "items.csv"
    path.write_text("order_id,product_id,price\n" + "".join(f"o{i},p{i % 7},{i}.5\n" for i in range(20_000)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "64k")
    try:
        df = read_dataset(spark, str(path), "order_items")
        assert df.rdd.getNumPartitions() > 2 and df.count() == 20_000
        assert df.agg({"price": "sum"}).first()[0] == sum(i + 0.5 for i in range(20_000))
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_quoted_line_breaks_are_kept_on_request_and_an_error_without(spark, tmp_path):
    path = tmp_path / "items.csv"
    path.write_text('order_id,product_id,price\no1,"p\n1",1.5\no2,p2,2.5\n')
    assert [r.product_id for r in read_dataset(spark, str(path), "order_items", multi_line=True).collect()] == ["p\n1", "p2"]
    with pytest.raises(Exception, match="MALFORMED|malformed"):
        read_dataset(spark, str(path), "order_items").select("order_id").collect()
    reviews = tmp_path / "reviews.csv"
    reviews.write_text('order_id,review_score,review_comment_message\no1,5,"two\nlines"\n')
    assert read_dataset(spark, str(reviews), "reviews").first().review_comment_message == "two\nlines"


def test_a_report_leaves_no_staged_tables(spark):
    from basketlens.sources.staging import scratch_dir, stage, staging

    with staging(spark):
        path = stage(spark.range(10)).inputFiles()[0]
        assert spark.read.parquet(path).count() >= 0
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    assert not folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(folder)
    assert scratch_dir(spark)


def test_contract_report_counts_values(shop):
    report = {(r.dataset, r.column): r for r in contract_report(shop).collect()}
    item = report["order_items", "freight_value"]
    assert (item.required, item.present, item.row_count, item.value_count) == (False, True, 7, 6)
    assert not report["orders", "order_approved_at"].present and report["orders", "order_id"].required
    assert {d for d, _ in report} == set(shop)


def test_results_come_back_with_their_types(spark, frame, tmp_path):
    df = frame("name string, items array<string>, n bigint, share double, x string", ("a,b", ["p", "q"], 5, 0.25, None), ('say "hi"', ["r"], None, 1.0, "7"))
    write_result(df, str(tmp_path / "out"))
    back = read_result(spark, str(tmp_path / "out"))
    assert dict(back.dtypes) == {"name": "string", "items": "string", "n": "bigint", "share": "double", "x": "bigint"}
    assert sorted(map(tuple, back.collect())) == [("a,b", "p, q", 5, 0.25, None), ('say "hi"', "r", None, 1.0, 7)]
