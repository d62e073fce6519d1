from itertools import combinations

import pytest

from basketlens.plans import basket


@pytest.fixture
def orders(frame):
    def build(*items):
        return frame("order_id int, items array<string>", *[(i, sorted(x)) for i, x in enumerate(items)])

    return build


def brute_force(sets, min_support):
    """Every itemset and every rule by counting."""
    n = len(sets)
    universe = sorted(set().union(*sets))
    support = {}
    for k in range(1, len(universe) + 1):
        for c in combinations(universe, k):
            s = sum(set(c) <= x for x in sets) / n
            if s >= min_support:
                support[c] = s
    rules = {}
    for items, s in support.items():
        for k in range(1, len(items)):
            for a in combinations(items, k):
                c = tuple(x for x in items if x not in a)
                rules[a, c] = (s, s / support[a], s / support[a] / support[c])
    return support, rules


def test_baskets_count_only_categories_of_known_products(frame):
    tx = frame(
        "order_id int, product_id string, product_category_name string",
        (1, "p", "b"), (1, "q", "a"), (1, "r", "b"), (2, None, "a"), (3, "p", None), (None, "p", "a"),
    )
    got = sorted((r.order_id, r["items"]) for r in basket.baskets(tx).collect())
    assert got == [(1, ["a", "b"]), (2, [])]  # order 2 counts as a basket, order 3 does not


def test_rules_with_several_consequents(orders):
    sets = [{"a", "b", "c"}, {"a", "b", "c"}, {"a", "b"}, {"d"}]
    rules = basket.association_rules(basket.frequent_itemsets(orders(*sets), 0.25))
    got = {(tuple(r.antecedents), tuple(r.consequents)): r for r in rules.collect()}
    rule = got[("a",), ("b", "c")]
    assert rule.support == 0.5 and rule.confidence == pytest.approx(2 / 3) and rule.lift == pytest.approx(4 / 3)
    assert rule.leverage == pytest.approx(0.5 - 0.75 * 0.5)
    assert rule.conviction == pytest.approx(0.5 / (1 / 3))
    assert got[("b", "c"), ("a",)].conviction is None  # always true
    assert rule.zhangs_metric == pytest.approx(0.125 / max(0.5 * 0.25, 0.75 * (0.5 - 0.5)))


def test_itemsets_and_rules_equal_brute_force(orders):
    sets = [{c for i, c in enumerate("abcdef") if (n * 7 + n // 3) >> i & 1} | {"z"} for n in range(40)]
    support, rules = brute_force(sets, 0.1)
    itemsets = basket.frequent_itemsets(orders(*sets), 0.1)
    assert {tuple(r["items"]): r.support for r in itemsets.collect()} == support
    found = basket.association_rules(itemsets, min_lift=0.0).collect()
    got = {(tuple(r.antecedents), tuple(r.consequents)): (r.support, r.confidence, r.lift) for r in found}
    assert len(found) == len(got) and got.keys() == rules.keys()
    assert all(got[k] == pytest.approx(rules[k]) for k in rules)


def test_short_itemsets_on_request(orders):
    itemsets = basket.frequent_itemsets(orders({"a", "b", "c"}), 0.5, max_len=2)
    assert {len(r["items"]) for r in itemsets.collect()} == {1, 2}


def test_rules_of_a_long_itemset_use_several_mask_blocks(spark, orders, monkeypatch):
    monkeypatch.setattr(basket, "_BLOCK_BITS", 2)
    rules = basket.association_rules(basket.frequent_itemsets(orders(set("abcde")), 0.5))
    assert rules.count() == sum(2**k - 2 for k in range(2, 6) for _ in combinations("abcde", k))


def test_default_filter_and_display(orders):
    sets = [{"a", "b"}] * 2 + [{"a"}] + [{"c"}] * 3
    rules = basket.association_rules(basket.frequent_itemsets(orders(*sets)))
    shown = basket.rules_top(basket.filter_rules(rules)).collect()
    assert [(r.antecedents, r.consequents, r.lift) for r in shown] == [("a", "b", 2.0), ("b", "a", 2.0)]
    assert basket.filter_rules(rules, min_confidence=0.9).count() == 1
    assert basket.filter_rules(rules, min_lift=2.1).count() == 0


def test_no_itemsets_no_rules(orders):
    itemsets = basket.frequent_itemsets(orders(*[{str(i)} for i in range(20)]), 0.5)
    assert itemsets.count() == 0 and basket.association_rules(itemsets).count() == 0
    assert basket.filtered_rules(itemsets).count() == 0


def test_grown_rules_equal_the_filtered_list(orders):
    sets = [{c for i, c in enumerate("abcdefg") if (n * 11 + n // 3) >> i & 1} | {"z"} for n in range(60)]
    itemsets = basket.frequent_itemsets(orders(*sets), 0.05)
    for confidence, lift in ((0.3, 1.0), (0.6, 1.2), (0.95, 0.0), (0.0, 0.0), (1.1, 0.0)):
        want = basket.filter_rules(basket.association_rules(itemsets, lift), 0.05, confidence, lift)
        got = basket.filtered_rules(itemsets, 0.05, confidence, lift)
        assert got.columns == want.columns
        assert sorted(map(repr, got.collect())) == sorted(map(repr, want.collect()))


def test_branches_without_confidence_are_not_expanded(spark, monkeypatch):
    """Twenty items, 2^20 - 2 rules; each further consequent takes a tenth of the confidence."""
    names = [f"i{i:02}" for i in range(20)]
    sets = [c for k in (0, 1, 2, 3) for c in combinations(names, 20 - k)] + [c for k in (1, 2) for c in combinations(names, k)]
    itemsets = spark.createDataFrame([(list(c), 0.9 ** len(c)) for c in sets], "items array<string>, support double")
    listed = []
    extended = basket._extended
    monkeypatch.setattr(basket, "_extended", lambda c: listed.append(extended(c).count()) or extended(c))
    rules = basket.grown_rules(itemsets, 0.8, 0.0, of=itemsets.filter("size(items) = 20"))
    assert rules.count() == 20 + 190
    assert listed == [20, 190, 1140]  # three consequents are tried, none passes, and nothing longer is tried
