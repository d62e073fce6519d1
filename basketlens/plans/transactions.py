"""The item-grain `transactions` table every analysis starts from."""

from __future__ import annotations

from collections.abc import Collection

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from basketlens.functions.calendar import time_features
from basketlens.functions.exact import exact_sum
from basketlens.operators.keyfilter import MOST_KEYS, key_words, with_partner
from basketlens.operators.skew import NO_HEAVY_KEYS, HeavyKeys, heavy_keys, salted_join
from basketlens.sources.checks import once
from basketlens.sources.contracts import ContractError, require_minimum, validate

# Item rows behind one row of a rollup.
ROWS = "item_rows"

# Items are filtered by the ids of sold orders before they move, if these are at most this share of all orders.
SELECTIVE = 0.25

# The order states that count as sales, and the date columns.
SOLD = ("delivered", "shipped")
DATE_COLUMNS = (
    "order_purchase_timestamp",
    "order_approved_at",
    "order_delivered_customer_date",
    "order_estimated_delivery_date",
)


def sold_orders(orders: DataFrame) -> DataFrame:
    """Orders that were delivered or shipped; all of them if there is no status."""
    if "order_status" not in orders.columns:
        return orders
    return orders.filter(F.col("order_status").isin(*SOLD))


def sold_items(items: DataFrame, orders: DataFrame) -> DataFrame:
    """The items that may belong to a sold order, where few orders are sold; else all items, and the join drops the rest.

    How many are sold is counted once per table of orders. The filter is a table of bounded size (see keyfilter),
    so it is left out if more orders are sold than it can tell apart.
    """
    if "order_status" not in orders.columns:
        return items

    def look() -> tuple[int, int]:
        sold = F.count_if(F.col("order_status").isin(*SOLD)).alias("sold")
        return tuple(orders.agg(sold, F.count("*").alias("orders")).first())

    sold, all_orders = once(orders, "sold orders", look)
    if sold > min(MOST_KEYS, SELECTIVE * all_orders):
        return items
    words = once(orders, "sold ids", lambda: key_words(sold_orders(orders), "order_id", sold))
    return with_partner(items, "order_id", *words)


def payments_per_order(payments: DataFrame) -> DataFrame:
    """Amount paid per order and the type of its first payment that has one."""
    aggs = [exact_sum("payment_value").alias("payment_value")]
    if "payment_type" in payments.columns:
        if "payment_sequential" in payments.columns:
            named = F.col("payment_type").isNotNull()
            # The type itself breaks ties; nulls in the sequence come last.
            order = F.struct(
                F.coalesce(F.col("payment_sequential").cast("long"), F.lit(2**62)), F.col("payment_type")
            )
            first = F.min(F.when(named, order)).getField("payment_type")
        else:
            first = F.min("payment_type")
        aggs.append(first.alias("payment_type"))
    return payments.filter(F.col("order_id").isNotNull()).groupBy("order_id").agg(*aggs)


def reviews_per_order(reviews: DataFrame) -> DataFrame | None:
    """Mean review score per order; None if the table has no scores."""
    if "review_score" not in reviews.columns:
        return None
    return reviews.filter(F.col("order_id").isNotNull()).groupBy("order_id").agg(
        F.avg("review_score").alias("review_score")
    )


def _renamed(df: DataFrame, taken: Collection[str], key: str, prefix: str) -> DataFrame:
    """Prefix the columns of df whose names are taken, so a join keeps both."""
    return df.select([F.col(c).alias(f"{prefix}_{c}" if c != key and c in taken else c) for c in df.columns])


def _catalogue(datasets: dict[str, DataFrame]) -> DataFrame:
    """Products with their translated category, joined while both are small."""
    products = datasets["products"]
    if "product_translation" not in datasets or "product_category_name" not in products.columns:
        return products
    return _translate(products, datasets["product_translation"])


def _translate(df: DataFrame, translation: DataFrame) -> DataFrame:
    """Add the columns of the translation of each row's category."""
    other = _renamed(translation, df.columns, "product_category_name", "product_translation")
    return df.join(other.filter(F.col("product_category_name").isNotNull()), "product_category_name", "left")


def _translation_of_none(translation: DataFrame) -> dict[str, object]:
    """The translation of rows without a category, by column; empty if the table has none. One look per table."""
    names = [c for c in translation.columns if c != "product_category_name"]

    def look() -> dict[str, object]:
        rows = translation.filter(F.col("product_category_name").isNull())
        found = rows.agg(F.min(F.struct(*names)).alias("t")).first().t if names else None
        return found.asDict() if found else {}

    return once(translation, "translation of none", look)


def _translate_missing(tx: DataFrame, translation: DataFrame) -> DataFrame:
    """Rows without a category take the translation row that has none either, if there is one.

    Items of unknown products are among them, so this follows the join of the catalogue; its values
    are constants of the plan, and without them nothing is added to it.
    """
    no_category = F.col("product_category_name").isNull()
    return tx.withColumns(
        {
            c: F.when(no_category, F.lit(v).cast(tx.schema[c].dataType)).otherwise(F.col(c))
            for c, v in _translation_of_none(translation).items()
            if c in tx.columns
        }
    )


def _repeated(df: DataFrame, key: str) -> int:
    """Rows whose id occurs before, in one pass over the ids of a table."""

    def look() -> int:
        ids = df.agg(F.count(key).alias("n"), F.count_distinct(key).alias("different")).first()
        return ids.n - ids.different

    return once(df, f"repeated {key}", look)


def require_unique(df: DataFrame, name: str, key: str) -> None:
    """Raise if an id of the table occurs twice."""
    if repeated := _repeated(df, key):
        raise ContractError(f"{name}: {key} was promised to be unique, but {repeated} rows repeat one")


def _one_row(df: DataFrame, name: str, key: str, promised: Collection[str], table: DataFrame, *joined: tuple) -> DataFrame:
    """df, checked if one row per key is promised, and then in a form that shows the planner that it is so.

    df is `table` joined with tables (`joined`, each with its key). If they too have single keys, what was
    found out about the tables before is enough; else df itself is looked at.
    """
    if name not in promised:
        return df
    require_unique(table, name, key)
    if any(_repeated(other, other_key) for other, other_key in joined):
        require_unique(df, name, key)
    return df.dropDuplicates([key])


def _catalogue_tables(datasets: dict[str, DataFrame]) -> tuple:
    translated = "product_translation" in datasets and "product_category_name" in datasets["products"].columns
    other = [(datasets["product_translation"], "product_category_name")] if translated else []
    return (datasets["products"], *other)


def build_transactions(
    datasets: dict[str, DataFrame],
    total: str = "payment",
    one_row_per_key: Collection[str] = (),
    split_heavy_keys: bool = True,
) -> DataFrame:
    """One row per order item of a sold order, with order, customer, payment, product and review columns.

    Everything that hangs on the order (customer, payments, reviews) is joined to the
    orders first, so the items, the largest input, are shuffled by order_id once.

    total: "payment" repeats what was paid for the order on each of its items;
        "item_share" divides it by their number.
    one_row_per_key: which of "customers", "products" hold one row per id; a ContractError
        if they don't. Spark then leaves the join out of any query that uses none of
        their columns. Without it repeated ids multiply rows, as joins do.
    split_heavy_keys: look for orders, customers and products that hold a large part of
        all rows, in one pass over the ids, and spread their joins over tasks.
    """
    if total not in ("payment", "item_share"):
        raise ContractError(f"total must be 'payment' or 'item_share', not {total!r}")
    require_minimum(datasets)
    for name, df in datasets.items():
        validate(df, name)

    items = sold_items(datasets["order_items"], datasets["orders"])
    header = sold_orders(datasets["orders"])
    heavy = {c: NO_HEAVY_KEYS for c in ("order_id", "customer_id", "product_id")}
    if split_heavy_keys:
        heavy |= heavy_keys(datasets["order_items"], ["order_id", "product_id"]) | heavy_keys(datasets["orders"], ["customer_id"])
    header = _header(datasets, header, one_row_per_key, heavy["customer_id"])
    if total == "item_share" and "order_payments" in datasets:
        sizes = items.filter(F.col("order_id").isNotNull()).groupBy("order_id").agg(F.count("*").alias("__items"))
        header = header.join(sizes, "order_id", "left")

    header = _renamed(header, items.columns, "order_id", "orders")
    tx = salted_join(items, header, "order_id", "inner", heavy["order_id"])
    if "products" in datasets:
        catalogue = _renamed(_catalogue(datasets), tx.columns, "product_id", "products")
        catalogue = _one_row(catalogue, "products", "product_id", one_row_per_key, *_catalogue_tables(datasets))
        tx = salted_join(tx, catalogue, "product_id", "left", heavy["product_id"])
    if "product_translation" in datasets and "product_category_name" in tx.columns:
        translation = datasets["product_translation"]
        if "products" not in datasets or "product_category_name" not in datasets["products"].columns:
            tx = _translate(tx, translation)
        tx = _translate_missing(tx, translation)
    return _derive(tx, total)


def build_order_rollup(
    datasets: dict[str, DataFrame], one_row_per_key: Collection[str] = (), split_heavy_keys: bool = True
) -> DataFrame:
    """The transactions with the items of an order folded into one row.

    `item_rows` and `item_products` count its items and those with a product. Analyses
    of orders and customers take this table in place of the item-grain one: the items
    are counted before they are shuffled, so neither their number nor a huge order
    matters from there on. With one row per product promised, products need no join here;
    without it an item counts as often as its product occurs. Without payments the
    total differs from item to item and the item-grain table is returned, as it is when
    categories of the items themselves are translated.
    """
    of_items = "products" not in datasets or "product_category_name" not in datasets["products"].columns
    translated = of_items and "product_translation" in datasets and (
        "product_category_name" in datasets["order_items"].columns
    )
    if "order_payments" not in datasets or translated:
        return build_transactions(datasets, one_row_per_key=one_row_per_key, split_heavy_keys=split_heavy_keys)
    require_minimum(datasets)
    for name, df in datasets.items():
        validate(df, name)
    orders = sold_orders(datasets["orders"])
    heavy = NO_HEAVY_KEYS
    if split_heavy_keys:
        heavy = heavy_keys(datasets["orders"], ["customer_id"])["customer_id"]
    header = _header(datasets, orders, one_row_per_key, heavy)
    items = sold_items(datasets["order_items"], datasets["orders"])
    items = items.filter(F.col("order_id").isNotNull()).select("order_id", "product_id")
    if "products" in datasets and "products" in one_row_per_key:
        require_unique(datasets["products"], "products", "product_id")
    elif "products" in datasets:
        copies = _catalogue(datasets).groupBy("product_id").agg(F.count("*").alias("__copies"))
        heavy_products = NO_HEAVY_KEYS
        if split_heavy_keys:
            heavy_products = heavy_keys(datasets["order_items"], ["product_id"])["product_id"]
        items = salted_join(items, copies, "product_id", "left", heavy_products)
    if "__copies" in items.columns:
        n = F.coalesce("__copies", F.lit(1))
        of_products = F.sum(F.when(F.col("product_id").isNotNull(), n).otherwise(F.lit(0)))
        counts = F.sum(n), of_products
    else:
        counts = F.count("*"), F.count("product_id")
    counted = items.groupBy("order_id").agg(counts[0].alias(ROWS), counts[1].alias("item_products"))
    return counted.join(header, "order_id", "inner").withColumn("order_total", F.col("payment_value"))


def build_category_rollup(
    datasets: dict[str, DataFrame], one_row_per_key: Collection[str] = (), split_heavy_keys: bool = True
) -> DataFrame:
    """The transactions with the items of an order and category folded into one row.

    The items meet the catalogue, both with two columns, and are counted by order and category before
    they meet the orders: `item_rows` and `item_products` as in the order rollup, under the name of the category in use
    (see category_column). Analyses of categories take this table in place of the item-grain one. Item rows move
    twice, to the catalogue and to their order, where all further steps of an order find them. If single orders hold a large part of the items,
    they are counted on the way there, which takes one exchange (of counted rows) more.

    Without payments the total differs from item to item; without a catalogue categories are columns of the
    items. Then the item-grain table is returned.
    """
    products = datasets.get("products")
    if "order_payments" not in datasets or products is None or "product_category_name" not in products.columns:
        return build_transactions(datasets, one_row_per_key=one_row_per_key, split_heavy_keys=split_heavy_keys)
    require_minimum(datasets)
    for name, df in datasets.items():
        validate(df, name)
    orders = sold_orders(datasets["orders"])
    items = datasets["order_items"]
    heavy = {c: NO_HEAVY_KEYS for c in ("order_id", "customer_id", "product_id")}
    if split_heavy_keys:
        heavy |= heavy_keys(items, ["order_id", "product_id"]) | heavy_keys(datasets["orders"], ["customer_id"])
    catalogue = _catalogue(datasets)
    category = category_column(catalogue)
    catalogue = catalogue.select("product_id", *dict.fromkeys(["product_category_name", category]))
    catalogue = _one_row(catalogue, "products", "product_id", one_row_per_key, *_catalogue_tables(datasets))
    items = sold_items(items, datasets["orders"]).filter(F.col("order_id").isNotNull()).select("order_id", "product_id")
    items = salted_join(items, catalogue, "product_id", "left", heavy["product_id"])
    if "product_translation" in datasets:
        items = _translate_missing(items, datasets["product_translation"])
    # Moved by order_id alone, the rows stay where they are for the grouping and for the join with the orders. Only rows counted
    # beforehand may move so if an order is heavy, or if nobody has looked.
    if split_heavy_keys and not heavy["order_id"].salts:
        items = items.repartition("order_id")
    counted = items.groupBy("order_id", category).agg(
        F.count("*").alias(ROWS), F.count("product_id").alias("item_products")
    )
    header = _header(datasets, orders, one_row_per_key, heavy["customer_id"])
    header = _renamed(header, counted.columns, "order_id", "orders")
    return counted.join(header, "order_id", "inner").withColumn("order_total", F.col("payment_value"))


def rows_per_row(tx: DataFrame) -> str | None:
    """The column that says how many item rows a row stands for, if tx is a rollup."""
    return ROWS if ROWS in tx.columns else None


def _header(
    datasets: dict[str, DataFrame], orders: DataFrame, one_row_per_key: Collection[str], heavy: HeavyKeys
) -> DataFrame:
    """Orders with their customer, payments, review score and times."""
    header = orders
    customers = _renamed(datasets["customers"], header.columns, "customer_id", "customers")
    customers = _one_row(customers, "customers", "customer_id", one_row_per_key, datasets["customers"])
    header = salted_join(header, customers, "customer_id", "left", heavy)
    if "order_payments" in datasets:
        paid = payments_per_order(datasets["order_payments"])
        header = header.join(_renamed(paid, header.columns, "order_id", "order_payments"), "order_id", "left")
    scores = reviews_per_order(datasets["reviews"]) if "reviews" in datasets else None
    if scores is not None:
        header = header.join(_renamed(scores, header.columns, "order_id", "reviews"), "order_id", "left")
    return _with_times(header)


def _with_times(orders: DataFrame) -> DataFrame:
    """Dates as timestamps, and the time features, once per order rather than per item."""
    orders = orders.withColumns({c: F.col(c).try_cast("timestamp_ntz") for c in DATE_COLUMNS if c in orders.columns})
    return orders.withColumns(time_features("order_purchase_timestamp"))


def _derive(tx: DataFrame, total: str) -> DataFrame:
    """Defaults, order total and shipping features."""
    if "freight_value" not in tx.columns:
        tx = tx.withColumn("freight_value", F.lit(0.0))
    if "payment_value" not in tx.columns:
        order_total = F.col("price") + F.col("freight_value")
    elif total == "item_share":
        order_total = F.col("payment_value") / F.col("__items")
    else:
        order_total = F.col("payment_value")
    tx = tx.withColumn("order_total", order_total).drop("__items")
    return tx.withColumns(
        {
            "has_free_shipping": F.coalesce(F.col("freight_value") == 0, F.lit(False)),
            "freight_ratio": F.try_divide(F.col("freight_value"), F.col("price") + 1),
        }
    )


def category_column(tx: DataFrame) -> str | None:
    """The category column in use: translated if there is one, else raw, else none."""
    # The two names, in order of preference.
    for name in ("product_category_name_english", "product_category_name"):
        if name in tx.columns:
            return name
    return None
