"""Market basket page: category baskets, frequent itemsets, association rules."""

from __future__ import annotations

from functools import reduce

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from basketlens.operators.binning import top_k
from basketlens.plans.overview import keyed, with_category
from basketlens.plans.transactions import rows_per_row
from basketlens.sources.staging import stage

# A rule's items are picked by a bit mask; masks are enumerated in blocks of 2^16.
_BLOCK_BITS = 16
# Masks are non-negative long integers.
MAX_ITEMS = 62


def baskets(tx: DataFrame) -> DataFrame:
    """Per order with a category: the sorted distinct categories of its products, staged.

    The lists are sets of category names, filled per task before the shuffle, so
    their length is bounded by the catalogue and not by the size of the order.
    """
    tx, category = with_category(tx)
    bought = F.when(F.col("item_products") > 0 if rows_per_row(tx) else F.col("product_id").isNotNull(), F.col(category))
    return stage(
        keyed(tx, "order_id", category)
        .groupBy("order_id")
        .agg(F.sort_array(F.collect_set(bought)).alias("items"))
    )


def frequent_itemsets(orders: DataFrame, min_support: float = 0.01, max_len: int | None = None) -> DataFrame:
    """Itemsets in at least min_support of the baskets: items (sorted), freq, support; staged.

    Any length unless max_len asks for short ones only.
    """
    n = orders.agg(F.count("*")).scalar()
    # FPGrowth rounds the threshold up to a count; ask for a shade less and compare exactly.
    model = FPGrowth(itemsCol="items", minSupport=min_support * (1 - 1e-9)).fit(orders.select("items"))
    found = model.freqItemsets.select(
        F.sort_array("items").alias("items"), "freq", F.try_divide(F.col("freq").cast("double"), n).alias("support")
    ).filter(F.col("support") >= min_support)
    if max_len is not None:
        found = found.filter(F.size("items") <= max_len)
    return stage(found)


def association_rules(itemsets: DataFrame, min_lift: float = 1.0) -> DataFrame:
    """Every split of every itemset into antecedents and consequents with lift >= min_lift.

    FPGrowth's own rules have single consequents only. Here each itemset is exploded
    into its proper subsets by bit mask, blocks of 2^16 masks spread over tasks, and
    supports are joined by itemset. Itemsets of more than MAX_ITEMS items are an error.
    """
    longest = itemsets.agg(F.max(F.size("items"))).first()[0] or 0
    if longest > MAX_ITEMS:
        raise ValueError(f"an itemset has {longest} items; rules are enumerated for {MAX_ITEMS} at most")
    size = F.size("items")
    low = F.least(size, F.lit(_BLOCK_BITS))
    one = F.lit(1).cast("long")

    def power(bits: Column) -> Column:
        return F.call_function("shiftleft", one, bits)

    masks = (
        itemsets.filter(size > 1)
        .select("items", "support", F.explode(F.sequence(F.lit(0).cast("long"), power(size - low) - 1)).alias("__block"))
        .repartition("items", "__block")
        .select(
            "items", "support", "__block", F.explode(F.sequence(F.lit(0).cast("long"), power(low) - 1)).alias("__low")
        )
        .withColumn("__mask", F.col("__block") * (1 << _BLOCK_BITS) + F.col("__low"))
        .filter((F.col("__mask") > 0) & (F.col("__mask") < power(size) - 1))
    )
    mask = F.col("__mask")
    sides = masks.select(
        F.filter("items", lambda x, i: F.getbit(mask, i) == 1).alias("antecedents"),
        F.filter("items", lambda x, i: F.getbit(mask, i) == 0).alias("consequents"),
        "support",
    )
    left = itemsets.select(F.col("items").alias("antecedents"), F.col("support").alias("antecedent_support"))
    return _measured(sides.join(left, "antecedents"), itemsets).filter(F.col("lift") >= min_lift)


def _measured(sides: DataFrame, itemsets: DataFrame) -> DataFrame:
    """Rules (antecedents, consequents, antecedent_support, support) with all their measures."""
    right = itemsets.select(F.col("items").alias("consequents"), F.col("support").alias("consequent_support"))
    a, c, both = F.col("antecedent_support"), F.col("consequent_support"), F.col("support")
    return sides.join(right, "consequents").select(
        "antecedents", "consequents", "antecedent_support", "consequent_support", "support",
        (both / a).alias("confidence"),
        (both / a / c).alias("lift"),
        (both - a * c).alias("leverage"),
        F.try_divide(1 - c, 1 - both / a).alias("conviction"),
        F.coalesce(
            F.try_divide(both - a * c, F.greatest(both * (1 - a), a * (c - both))), F.lit(0.0)
        ).alias("zhangs_metric"),
    )


def grown_rules(itemsets: DataFrame, min_confidence: float, min_lift: float = 1.0, of: DataFrame | None = None) -> DataFrame:
    """The rules of association_rules with at least this confidence, without listing the others.

    Consequents grow item by item. A longer consequent leaves a shorter antecedent, which no fewer baskets hold, so
    confidence only falls on the way: a consequent that fails is not extended, and every one that passes is
    reached from its own beginning. Levels are staged one after the other, at most MAX_ITEMS - 1 of them.
    `of` names the itemsets to split, if not all.
    """
    whole = (itemsets if of is None else of).filter(F.size("items") > 1).select("items", "support")
    longest = whole.agg(F.max(F.size("items"))).first()[0] or 0
    if longest > MAX_ITEMS:
        raise ValueError(f"an itemset has {longest} items; rules are enumerated for {MAX_ITEMS} at most")
    supports = itemsets.select("items", "support").withColumnsRenamed({"items": "antecedents", "support": "antecedent_support"})
    levels = []
    # Rows of a level: an itemset, the bits of its consequent, and the highest of them.
    candidates = whole.withColumns({"__mask": F.lit(0).cast("long"), "__top": F.lit(-1)})
    while True:
        level = stage(_extended(candidates).join(supports, "antecedents").filter(F.col("support") / F.col("antecedent_support") >= min_confidence))
        if level.isEmpty():
            break
        levels.append(level)
        candidates = level.select("items", "support", "__mask", "__top")
    if not levels:
        levels = [level]
    sides = reduce(DataFrame.union, levels).select("antecedents", "consequents", "antecedent_support", "support")
    return _measured(sides, itemsets).filter(F.col("lift") >= min_lift)


def _extended(candidates: DataFrame) -> DataFrame:
    """Each consequent with one item more, after its last; one item at least stays an antecedent."""
    one, size = F.lit(1).cast("long"), F.size("items")
    more = candidates.filter(F.col("__top") + 1 < size).select(
        "items", "support", "__mask", F.explode(F.sequence(F.col("__top") + 1, size - 1)).alias("__top")
    )
    mask = F.col("__mask").bitwiseOR(F.call_function("shiftleft", one, F.col("__top")))
    more = more.withColumn("__mask", mask).filter(F.bit_count("__mask") < size)
    return more.withColumns(
        {
            "antecedents": F.filter("items", lambda x, i: F.getbit(F.col("__mask"), i) == 0),
            "consequents": F.filter("items", lambda x, i: F.getbit(F.col("__mask"), i) == 1),
        }
    )


def filter_rules(
    rules: DataFrame, min_support: float = 0.01, min_confidence: float = 0.3, min_lift: float = 1.5
) -> DataFrame:
    return rules.filter(
        (F.col("support") >= min_support)
        & (F.col("confidence") >= min_confidence)
        & (F.col("lift") >= min_lift)
    )


def filtered_rules(
    itemsets: DataFrame, min_support: float = 0.01, min_confidence: float = 0.3, min_lift: float = 1.5
) -> DataFrame:
    """filter_rules of all rules, grown so that rules below min_confidence are never listed."""
    return filter_rules(grown_rules(itemsets, min_confidence, min_lift), min_support, min_confidence, min_lift)


def rules_display(rules: DataFrame) -> DataFrame:
    """Rules with their sides as ', '-joined text."""
    return rules.withColumns({c: F.array_join(c, ", ") for c in ("antecedents", "consequents")})


def rules_top(rules: DataFrame, n: int = 20) -> DataFrame:
    """The n rules of largest lift, ready to show."""
    shown = rules_display(rules).withColumn("__tie", F.concat_ws(" => ", "antecedents", "consequents"))
    return top_k(shown, n, "lift", "__tie").select("antecedents", "consequents", "support", "confidence", "lift")
