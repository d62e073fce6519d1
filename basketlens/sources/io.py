"""Reading the input tables, reporting on them, and writing results."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType

from basketlens.sources.contracts import contract, validate
from basketlens.sources.inference import infer_types, typed_column
from basketlens.sources.quoted_csv import read_quoted_csv

# The texts a CSV reader takes for "missing".
NA_TOKENS = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
    "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
)


def _typed(df: DataFrame, name: str, keep: set[str] = frozenset()) -> DataFrame:
    """Cast contract columns by name, but for `keep`; text that does not parse becomes NULL."""
    kinds = {f.name: f.dataType for f in contract(name).schema if f.name not in keep}

    def cast(c: str) -> Column:
        kind = kinds.get(c)
        if kind is None:
            return F.col(f"`{c}`")
        # "3.0" is how integers with gaps are written; go through double.
        x = F.col(c).try_cast("double") if isinstance(kind, IntegerType) else F.col(c)
        return x.try_cast(kind).alias(c)

    return df.select([cast(c) for c in df.columns])


def read_dataset(
    spark: SparkSession,
    path: str | list[str],
    name: str,
    fmt: str = "csv",
    multi_line: bool | None = None,
    infer: bool = True,
) -> DataFrame:
    """Read one input table, check its header and cast its columns by name.

    CSV columns are read as text (a schema would be applied by position). Large files are
    split over tasks. A quoted line break then makes a row of the wrong length, which is an
    error when the rows are read, whatever columns are asked for. With `multi_line`, the
    default for reviews, whose texts have line breaks, they are kept: one more pass over the
    files, when this is called, finds out which splits begin inside a field.

    Columns outside the contract get the smallest type that holds all their values, from one
    pass over these columns, again when this is called; without `infer` they stay text.
    """
    if multi_line is None:
        multi_line = name == "reviews"
    if fmt == "csv":
        raw = (
            spark.read.option("header", True)
            .option("multiLine", multi_line)
            .option("quote", '"')
            .option("escape", '"')
            .option("mode", "FAILFAST")
            .option("columnPruning", False)
            .csv(path)
        )
        validate(raw, name)
        if multi_line:
            raw = read_quoted_csv(spark, path, raw.columns)
        raw = raw.select([F.when(~F.col(f"`{c}`").isin(*NA_TOKENS), F.col(f"`{c}`")).alias(c) for c in raw.columns])
        known = {f.name for f in contract(name).schema}
        types = infer_types(raw, [c for c in raw.columns if c not in known]) if infer else {}
        raw = raw.select([typed_column(c, types[c]) if c in types else F.col(f"`{c}`") for c in raw.columns])
        return _typed(raw, name)
    df = validate(spark.read.format(fmt).load(path), name)
    return _typed(df, name, keep={c for c in df.columns if c.endswith("_id")})  # ids keep their stored type


def load_report(datasets: dict[str, DataFrame]) -> DataFrame:
    """Rows per loaded table: dataset, row_count."""
    counts = [
        df.agg(F.count("*").alias("row_count")).select(F.lit(name).alias("dataset"), "row_count")
        for name, df in datasets.items()
    ]
    return reduce(DataFrame.unionByName, counts)


def contract_report(datasets: dict[str, DataFrame]) -> DataFrame:
    """dataset, column, required, present, row_count, value_count of every column of every contract, one scan for each table.

    Absent tables have no rows in the report; absent columns no values.
    """

    def report(name: str, df: DataFrame) -> DataFrame:
        fields = contract(name).schema
        values = [F.count(f"`{f.name}`") if f.name in df.columns else F.lit(0).cast("long") for f in fields]
        counted = df.agg(F.count("*").alias("row_count"), *[v.alias(f"v{i}") for i, v in enumerate(values)])
        columns = [
            F.struct(
                F.lit(f.name).alias("column"), F.lit(not f.nullable).alias("required"), F.lit(f.name in df.columns).alias("present"),
                F.col(f"v{i}").alias("value_count"),
            )
            for i, f in enumerate(fields)
        ]
        listed = counted.select("row_count", F.explode(F.array(*columns)).alias("c"))
        return listed.select(F.lit(name).alias("dataset"), "c.column", "c.required", "c.present", "row_count", "c.value_count")

    return reduce(DataFrame.unionByName, [report(name, df) for name, df in datasets.items()])


def preview(df: DataFrame, n: int = 10) -> DataFrame:
    """The first n rows."""
    return df.limit(n)


def write_result(df: DataFrame, path: str, fmt: str = "csv", mode: str = "errorifexists") -> None:
    """Write a result; CSV gets a header and lists as ', '-joined text."""
    if fmt == "csv":
        flat = [
            F.array_join(f.name, ", ").alias(f.name) if isinstance(f.dataType, ArrayType) else F.col(f.name)
            for f in df.schema
        ]
        df.select(flat).write.mode(mode).option("header", True).option("escape", '"').csv(path)
    else:
        df.write.mode(mode).format(fmt).save(path)


def read_result(spark: SparkSession, path: str) -> DataFrame:
    """A CSV result as written by write_result, with types inferred from its values; lists come back as text."""
    raw = spark.read.option("header", True).option("escape", '"').option("nullValue", "").csv(path)
    types = infer_types(raw, raw.columns)
    return raw.select([typed_column(c, types[c]) for c in raw.columns])
