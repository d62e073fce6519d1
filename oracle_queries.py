"""DuckDB SQL with the results of the registered queries.

Written from the definitions, not from the Spark plans: quantiles use
quantile_cont, ranks row_number, and itemsets are counted over bit masks.
"""

from __future__ import annotations

# The transactions table over the test tables.
TX = """
WITH cust AS (
  SELECT c_custkey AS customer_id, r_name AS customer_city, n_name AS customer_state
  FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey
), pay AS (
  SELECT o_orderkey AS order_id, CAST(SUM(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS payment_value,
         MIN(o_orderpriority) AS payment_type
  FROM orders GROUP BY o_orderkey
), rev AS (
  SELECT l_orderkey AS order_id,
         AVG(CASE l_returnflag WHEN 'R' THEN 1.0::DOUBLE WHEN 'A' THEN 3.0::DOUBLE WHEN 'N' THEN 5.0::DOUBLE END)
           AS review_score
  FROM lineitem GROUP BY l_orderkey
), tx AS (
  SELECT l_orderkey AS order_id, l_partkey AS product_id, l_linenumber AS order_item_id, l_suppkey AS seller_id,
         l_extendedprice AS price,
         CAST(ROUND(CAST(l_extendedprice AS DECIMAL(18,2)) * CAST(l_tax AS DECIMAL(18,2)), 2) AS DOUBLE)
           AS freight_value,
         o_custkey AS customer_id,
         CASE o_orderstatus WHEN 'F' THEN 'delivered' WHEN 'O' THEN 'shipped' END AS order_status,
         o_orderdate AS ts, customer_city, customer_state, payment_value, payment_type, review_score,
         p_type AS product_category_name, 'cat_' || lower(p_type) AS category,
         payment_value AS order_total
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey AND o_orderstatus IN ('F', 'O')
  LEFT JOIN cust ON o_custkey = cust.customer_id
  LEFT JOIN pay ON o_orderkey = pay.order_id
  LEFT JOIN rev ON o_orderkey = rev.order_id
  LEFT JOIN part ON l_partkey = p_partkey
)"""

EVENTS = """
WITH ev AS (
  SELECT event_id AS order_id, user_id AS customer_id, ts, value AS order_total
  FROM events WHERE event_type = 'purchase'
)"""

MONEY = "DECIMAL(18,2)"


def dsum(x: str) -> str:
    return f"CAST(COALESCE(SUM(CAST({x} AS {MONEY})), 0) AS DOUBLE)"


def davg(x: str) -> str:
    return f"(CAST(SUM(CAST({x} AS {MONEY})) AS DOUBLE) / COUNT({x}))"


def days(a: str, b: str) -> str:
    return f"((epoch_us({b}) - epoch_us({a})) // 86400000000)"


def cut_bin(x: str, lo: str, hi: str, bins: int) -> str:
    """Right-closed equal-width bin, counting the edges below x."""
    edges = " + ".join(
        f"(CASE WHEN {x} > {i}.0::DOUBLE * (({hi} - {lo}) / {bins}.0::DOUBLE) + {lo} THEN 1 ELSE 0 END)"
        for i in range(1, bins)
    )
    return f"CAST(1 + {edges} AS INTEGER)"


def edge(i: str, lo: str, hi: str, bins: int) -> str:
    return (
        f"CASE WHEN {i} = {bins} THEN {hi} ELSE {i}::DOUBLE * (({hi} - {lo}) / {bins}.0::DOUBLE) + {lo} END"
    )


def histogram(source: str, col: str, bins: int) -> str:
    return f"""
  (SELECT CAST(s.i AS INTEGER) AS bin, ROUND({edge('(s.i - 1)', 'b.lo', 'b.hi', bins)}, 4) AS lower,
          ROUND({edge('s.i', 'b.lo', 'b.hi', bins)}, 4) AS upper, COALESCE(c.n, 0) AS count
   FROM range(1, {bins + 1}) s(i)
   CROSS JOIN (SELECT MIN({col})::DOUBLE AS lo, MAX({col})::DOUBLE AS hi FROM {source}) b
   LEFT JOIN (
     SELECT {cut_bin(f'{source}.{col}', 'q.lo', 'q.hi', bins)} AS bin, COUNT(*) AS n
     FROM {source}, (SELECT MIN({col})::DOUBLE AS lo, MAX({col})::DOUBLE AS hi FROM {source}) q GROUP BY 1
   ) c ON c.bin = s.i)"""


CLV = (
    TX
    + f""", agg AS (
  SELECT customer_id, COUNT(DISTINCT order_id) AS frequency, {dsum('order_total')} AS monetary,
         MIN(ts) AS first_purchase, MAX(ts) AS last_purchase
  FROM tx WHERE customer_id IS NOT NULL GROUP BY customer_id
), clv AS (
  SELECT *, avg_order_value * purchase_frequency * 365 AS clv FROM (
    SELECT *, monetary / frequency AS avg_order_value, frequency / lifespan_days AS purchase_frequency FROM (
      SELECT *, GREATEST(1, {days('first_purchase', 'last_purchase')} + 1) AS lifespan_days FROM agg)))"""
)

RFM = (
    TX
    + f""", vals AS (
  SELECT customer_id, {days('MAX(ts)', "((SELECT MAX(ts) FROM tx) + INTERVAL 1 DAY)")} AS recency,
         COUNT(DISTINCT order_id) AS frequency, {dsum('order_total')} AS monetary
  FROM tx WHERE customer_id IS NOT NULL GROUP BY customer_id
), edges AS (
  SELECT quantile_cont(recency, 0.25) AS e1, quantile_cont(recency, 0.5) AS e2, quantile_cont(recency, 0.75) AS e3,
         COUNT(*) AS n FROM vals
), ranks AS (
  SELECT *, ROW_NUMBER() OVER (ORDER BY frequency, customer_id) AS fr,
            ROW_NUMBER() OVER (ORDER BY monetary, customer_id) AS mr
  FROM vals, edges
), scores AS (
  SELECT customer_id, recency, frequency, monetary,
         CAST(CASE WHEN recency <= e1 THEN 4 WHEN recency <= e2 THEN 3 WHEN recency <= e3 THEN 2 ELSE 1 END
           AS INTEGER) AS "R_score",
         CAST(GREATEST(1, LEAST(4, CEIL(4.0 * (fr - 1) / (n - 1)))) AS INTEGER) AS "F_score",
         CAST(GREATEST(1, LEAST(4, CEIL(4.0 * (mr - 1) / (n - 1)))) AS INTEGER) AS "M_score"
  FROM ranks
), scored AS (
  SELECT *, CAST("R_score" AS VARCHAR) || CAST("F_score" AS VARCHAR) || CAST("M_score" AS VARCHAR) AS "RFM_score"
  FROM scores
), rfm AS (
  SELECT *, CASE WHEN "R_score" >= 3 AND "F_score" >= 3 AND "M_score" >= 3 THEN 'Champions'
                 WHEN "R_score" >= 3 AND "F_score" >= 2 THEN 'Loyal Customers'
                 WHEN "R_score" >= 3 THEN 'Potential Loyalists'
                 WHEN "F_score" >= 3 AND "M_score" >= 3 THEN 'At Risk'
                 WHEN "R_score" <= 2 THEN 'Hibernating' ELSE 'Need Attention' END AS segment
  FROM scored)"""
)

SEG = (
    TX
    + f""", seg AS (
  SELECT customer_id, COUNT(DISTINCT order_id) AS order_count, {dsum('order_total')} AS total_spent,
         {davg('order_total')} AS avg_order_value, {davg('price')} AS avg_price,
         {davg('freight_value')} AS avg_shipping,
         {days('MAX(ts)', '(SELECT MAX(ts) FROM tx)')} AS recency_days
  FROM tx WHERE customer_id IS NOT NULL GROUP BY customer_id)"""
)

CHURN = (
    TX
    + f""", agg AS (
  SELECT customer_id, COUNT(DISTINCT order_id) AS order_count, {dsum('order_total')} AS total_spent,
         {davg('order_total')} AS avg_order_value,
         ROUND(COALESCE(STDDEV_SAMP(order_total), 0), 4) AS std_order_value,
         MIN(ts) AS first_purchase, MAX(ts) AS last_purchase, {davg('freight_value')} AS avg_shipping,
         {days('MAX(ts)', '(SELECT MAX(ts) FROM tx)')} AS recency_days
  FROM tx WHERE customer_id IS NOT NULL GROUP BY customer_id
), churn AS (
  SELECT *, customer_age_days / order_count AS avg_days_between_orders,
         CAST(recency_days > 90 AS INTEGER) AS is_churned
  FROM (SELECT *, {days('first_purchase', 'last_purchase')} + 1 AS customer_age_days FROM agg))"""
)

# Each order as a bit mask over the sorted categories; itemsets are the masks 1..2^k-1.
BASKETS = (
    TX
    + """, cats AS (
  SELECT category, ROW_NUMBER() OVER (ORDER BY category) - 1 AS bit
  FROM (SELECT DISTINCT category FROM tx WHERE category IS NOT NULL)
), masks AS (
  SELECT order_id, BIT_OR(CASE WHEN product_id IS NULL THEN 0 ELSE 1::BIGINT << bit END) AS mask
  FROM tx JOIN cats USING (category) GROUP BY order_id
), total AS (SELECT COUNT(*) AS n FROM masks
), sets AS (
  SELECT s.m AS m, (SELECT STRING_AGG(category, ', ' ORDER BY category) FROM cats WHERE (s.m >> bit) & 1 = 1) AS items
  FROM range(1, (1::BIGINT << (SELECT COUNT(*) FROM cats))::BIGINT) s(m)
), counted AS (
  SELECT m, items, freq, freq::DOUBLE / n AS support
  FROM (SELECT sets.m, sets.items, SUM(k)::BIGINT AS freq
        FROM sets JOIN (SELECT mask, COUNT(*) AS k FROM masks GROUP BY mask) g ON (g.mask & sets.m) = sets.m
        GROUP BY sets.m, sets.items), total
), freq AS (SELECT * FROM counted WHERE support >= 0.01
), rules AS (
  SELECT a.items AS antecedents, c.items AS consequents, a.support AS antecedent_support,
         c.support AS consequent_support, i.support AS support, i.support / a.support AS confidence,
         i.support / a.support / c.support AS lift
  FROM freq i JOIN freq a ON (a.m & i.m) = a.m AND a.m <> i.m JOIN freq c ON c.m = i.m - a.m
  WHERE i.support / a.support / c.support >= 1.0)"""
)

DAILY = (
    TX
    + f""", daily AS (
  SELECT CAST(ts AS DATE) AS date, {dsum('order_total')} AS revenue, COUNT(DISTINCT order_id) AS orders
  FROM tx WHERE ts IS NOT NULL GROUP BY 1
), features AS (
  SELECT * FROM (
    SELECT date, revenue, orders, CAST(isodow(date) - 1 AS INTEGER) AS day_of_week,
           CAST(day(date) AS INTEGER) AS day_of_month, CAST(month(date) AS INTEGER) AS month,
           CAST(date - (SELECT MIN(date) FROM daily) AS INTEGER) AS day_num,
           LAG(revenue, 1) OVER (ORDER BY date) AS revenue_lag_1,
           LAG(revenue, 7) OVER (ORDER BY date) AS revenue_lag_7,
           LAG(revenue, 14) OVER (ORDER BY date) AS revenue_lag_14
    FROM daily) WHERE revenue_lag_14 IS NOT NULL)"""
)

SPLIT = (
    CHURN
    + """, sizes AS (
  SELECT n, n0, n1, n_train, (n0 * n_train) // n AS s0, (n1 * n_train) // n AS s1,
         (n0 * n_train) % n AS r0, (n1 * n_train) % n AS r1
  FROM (SELECT n, n0, n1, n - (3 * n + 9) // 10 AS n_train
        FROM (SELECT COUNT(*) AS n, COUNT(*) FILTER (is_churned = 0) AS n0, COUNT(*) FILTER (is_churned = 1) AS n1
              FROM churn))
), split AS (
  SELECT *, place > CASE WHEN is_churned = 0 THEN s0 + (CASE WHEN r1 > r0 THEN 0 ELSE n_train - s0 - s1 END)
                      ELSE s1 + (CASE WHEN r1 > r0 THEN n_train - s0 - s1 ELSE 0 END) END AS is_test
  FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY is_churned ORDER BY md5(customer_id || ':42'), customer_id) AS place
        FROM churn), sizes)"""
)

# Reference models: the revenue of a week before, a rule on recency, quartiles of spend.
NAIVE = (
    DAILY
    + """, split AS (
  SELECT *, ROW_NUMBER() OVER (ORDER BY date) AS place, COUNT(*) OVER () AS n FROM features
), scored AS (
  SELECT revenue AS y, revenue_lag_7 AS p FROM split WHERE place > FLOOR(n * 0.8)
), recent AS (
  SELECT place - n - 1 AS t, revenue FROM split WHERE place > n - 14
), known AS (
  SELECT t, revenue FROM recent
  UNION ALL SELECT s.t, r.revenue FROM range(0, 30) s(t) JOIN recent r ON r.t = s.t % 7 - 7
), days AS (
  SELECT s.t, (SELECT MAX(date) FROM features) + CAST(s.t + 1 AS INTEGER) AS date FROM range(0, 30) s(t)
), forecast AS (
  SELECT date, CAST(isodow(date) - 1 AS INTEGER) AS day_of_week, CAST(day(date) AS INTEGER) AS day_of_month,
         CAST(month(date) AS INTEGER) AS month, CAST(date - (SELECT MIN(date) FROM daily) AS INTEGER) AS day_num,
         a.revenue AS revenue_lag_1, b.revenue AS revenue_lag_7, c.revenue AS revenue_lag_14,
         k.revenue AS predicted_revenue
  FROM days d JOIN known k ON k.t = d.t JOIN known a ON a.t = d.t - 1 JOIN known b ON b.t = d.t - 7
  JOIN known c ON c.t = d.t - 14)"""
)
RULE = (
    SPLIT
    + """, ruled AS (
  SELECT *, p AS churn_probability, CASE WHEN p > 0 AND p <= 0.3 THEN 'Low' WHEN p > 0.3 AND p <= 0.7 THEN 'Medium'
         WHEN p > 0.7 THEN 'High' END AS churn_risk
  FROM (SELECT *, LEAST(recency_days / 120.0::DOUBLE, 1.0::DOUBLE) AS p FROM split))"""
)
QUARTILES = (
    SEG
    + """, placed AS (
  SELECT *, CAST(GREATEST(1, LEAST(4, CEIL(4.0 * (r - 1) / (n - 1)))) AS INTEGER) - 1 AS cluster
  FROM (SELECT *, ROW_NUMBER() OVER (ORDER BY total_spent, customer_id) AS r, COUNT(*) OVER () AS n FROM seg)
), means AS (
  SELECT cluster, AVG(total_spent) AS spent, AVG(order_count) AS orders, AVG(recency_days) AS recency
  FROM placed GROUP BY 1
), mid AS (
  SELECT quantile_cont(spent, 0.5) AS spent, quantile_cont(orders, 0.5) AS orders, quantile_cont(recency, 0.5) AS recency
  FROM means
), labelled AS (
  SELECT p.*, CASE WHEN m.spent > mid.spent AND m.orders > mid.orders THEN 'High Value'
                   WHEN m.recency > mid.recency THEN 'Inactive'
                   WHEN m.orders <= mid.orders THEN 'New/Low Frequency' ELSE 'Medium Value' END AS cluster_label
  FROM placed p JOIN means m USING (cluster), mid)"""
)
def stump(name: str, source: str, features: tuple[str, ...], y: str) -> str:
    """CTEs {name} (the best cut of every feature) and {name}_best (the best of all) over the rows of `source`."""
    rows = " UNION ALL ".join(
        f"SELECT '{c}' AS feature, {i} AS place, COALESCE({c}, 0)::DOUBLE AS value, {y} AS y FROM {source}" for i, c in enumerate(features)
    )
    return f""", {name}_sides AS (
  SELECT feature, place, value, LEAD(value) OVER (PARTITION BY feature ORDER BY value) AS after,
         (SUM(n) OVER (PARTITION BY feature ORDER BY value))::DOUBLE AS ln, (SUM(y) OVER (PARTITION BY feature ORDER BY value))::DOUBLE AS ly,
         (SUM(n) OVER (PARTITION BY feature))::DOUBLE AS an, (SUM(y) OVER (PARTITION BY feature))::DOUBLE AS ay
  FROM (SELECT feature, place, value, COUNT(*) AS n, SUM(y) AS y FROM ({rows}) GROUP BY ALL)
), {name} AS (
  SELECT * FROM (
    SELECT feature, place, (value + after) / 2 AS threshold, value, ly / ln AS left_mean, (ay - ly) / (an - ln) AS right_mean,
           ly * ly / ln + (ay - ly) * (ay - ly) / (an - ln) - ay * ay / an AS gain
    FROM {name}_sides WHERE after IS NOT NULL)
  QUALIFY ROW_NUMBER() OVER (PARTITION BY feature ORDER BY gain DESC, value) = 1
), {name}_best AS (SELECT * FROM {name} ORDER BY gain DESC, place LIMIT 1)"""


CHURN_INPUTS = (
    "order_count", "total_spent", "avg_order_value", "std_order_value", "recency_days", "customer_age_days",
    "avg_days_between_orders", "avg_shipping",
)
DAY_INPUTS = ("day_of_week", "day_of_month", "month", "day_num", "revenue_lag_1", "revenue_lag_7", "revenue_lag_14")
CHURN_STUMP = (
    SPLIT
    + stump("cut", "(SELECT * FROM split WHERE NOT is_test)", CHURN_INPUTS, "is_churned")
    + f""", ruled AS (
  SELECT split.*, CASE WHEN COALESCE(CASE feature {" ".join(f"WHEN '{c}' THEN {c}::DOUBLE" for c in CHURN_INPUTS)} END, 0) <= threshold
         THEN left_mean ELSE right_mean END AS p FROM split, cut_best)"""
)
DAY_STUMP = (
    DAILY
    + """, split AS (
  SELECT *, ROW_NUMBER() OVER (ORDER BY date) AS place, COUNT(*) OVER () AS n FROM features
)"""
    + stump("cut", "(SELECT * FROM split WHERE place <= FLOOR(n * 0.8))", DAY_INPUTS, f"CAST(revenue AS {MONEY})")
    + f""", scored AS (
  SELECT revenue AS y, CASE WHEN CASE feature {" ".join(f"WHEN '{c}' THEN {c}::DOUBLE" for c in DAY_INPUTS)} END <= threshold
         THEN left_mean ELSE right_mean END AS p FROM split, cut_best WHERE split.place > FLOOR(n * 0.8))"""
)

POINT = ("order_count", "total_spent", "avg_order_value", "recency_days")
CENTRES = ((1.0, 1.0, 0.0, -0.5), (-0.5, -0.5, -0.5, -0.5), (-0.5, -0.5, 1.0, 0.0), (-1.0, -1.0, 0.0, 2.0))


def rounds(count: int) -> str:
    """CTEs a0..a{count}: every point's nearest centre; c1..: the means of the points before."""
    out = []
    for r in range(count + 1):
        far = " + ".join(f"(x{d} - c{d}) * (x{d} - c{d})" for d in range(4))
        out.append(f""", a{r} AS (
  SELECT customer_id, {", ".join(f"ANY_VALUE(x{d}) AS x{d}" for d in range(4))}, ARG_MIN(cluster, {far}) AS cluster
  FROM points, c{r} GROUP BY customer_id)""")
        out.append(f""", c{r + 1} AS (
  SELECT c.cluster, {", ".join(f"COALESCE(AVG(x{d}), ANY_VALUE(c{d})) AS c{d}" for d in range(4))}
  FROM c{r} c LEFT JOIN a{r} a ON a.cluster = c.cluster GROUP BY c.cluster)""")
    return "".join(out)


FIXED = (
    SEG
    + f""", points AS (
  SELECT customer_id, {", ".join(f"COALESCE(({c} - AVG({c}) OVER ()) / COALESCE(NULLIF(STDDEV_POP({c}) OVER (), 0), 1), 0) AS x{d}" for d, c in enumerate(POINT))}
  FROM seg
), c0(cluster, c0, c1, c2, c3) AS (VALUES {", ".join(f"({i}, {', '.join(f'{v}::DOUBLE' for v in c)})" for i, c in enumerate(CENTRES))})"""
    + rounds(5)
    + """, placed AS (SELECT seg.*, a5.cluster FROM seg JOIN a5 USING (customer_id)
), means AS (
  SELECT cluster, AVG(total_spent) AS spent, AVG(order_count) AS orders, AVG(recency_days) AS recency FROM placed GROUP BY 1
), mid AS (
  SELECT quantile_cont(spent, 0.5) AS spent, quantile_cont(orders, 0.5) AS orders, quantile_cont(recency, 0.5) AS recency FROM means
), labelled AS (
  SELECT p.*, CASE WHEN m.spent > mid.spent AND m.orders > mid.orders THEN 'High Value'
                   WHEN m.recency > mid.recency THEN 'Inactive'
                   WHEN m.orders <= mid.orders THEN 'New/Low Frequency' ELSE 'Medium Value' END AS cluster_label
  FROM placed p JOIN means m USING (cluster), mid)"""
)

# The contracts' columns by table, + where required, = where the test tables have them (with the column that holds them).
CONTRACT_COLUMNS = {
    "customers": ("customer LEFT JOIN nation ON c_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey",
                  "+customer_id=c_custkey customer_unique_id customer_zip_code_prefix customer_city=r_name customer_state=n_name"),
    "orders": ("orders", "+order_id=o_orderkey +customer_id=o_custkey +order_status=o_orderstatus +order_purchase_timestamp=o_orderdate"
               " order_approved_at order_delivered_customer_date order_estimated_delivery_date"),
    "order_items": ("lineitem", "+order_id=l_orderkey +product_id=l_partkey +price=l_extendedprice order_item_id=l_linenumber"
                    " seller_id=l_suppkey shipping_limit_date freight_value=l_extendedprice"),
    "order_payments": ("orders", "+order_id=o_orderkey +payment_value=o_totalprice payment_sequential=o_orderkey"
                       " payment_type=o_orderpriority payment_installments"),
    "products": ("part", "+product_id=p_partkey product_category_name=p_type product_name_length product_description_length"
                 " product_photos_qty product_weight_g product_length_cm product_height_cm product_width_cm"),
    "product_translation": ("(SELECT DISTINCT p_type FROM part)",
                            "+product_category_name=p_type product_category_name_english=p_type"),
    "reviews": ("lineitem", "+order_id=l_orderkey review_id review_score=l_returnflag review_comment_title review_comment_message"
                " review_creation_date review_answer_timestamp"),
}


def contract_rows() -> str:
    rows = []
    for table, (source, columns) in CONTRACT_COLUMNS.items():
        for column in columns.split():
            name, _, held = column.lstrip("+").partition("=")
            rows.append(
                f"SELECT '{table}' AS dataset, '{name}' AS \"column\", {column[0] == '+'} AS required, {bool(held)} AS present,"
                f" COUNT(*) AS row_count, {f'COUNT({held})' if held else '0::BIGINT'} AS value_count FROM {source}"
            )
    return " UNION ALL ".join(rows)


SHARED = TX + """, shared AS (
  SELECT *, order_total / COUNT(*) OVER (PARTITION BY order_id) AS share FROM tx)"""

ORACLE: dict[str, str] = {
    "load_report": " UNION ALL ".join(
        f"SELECT '{name}' AS dataset, (SELECT COUNT(*) FROM {source}) AS row_count"
        for name, source in (
            ("customers", "customer"),
            ("orders", "orders"),
            ("order_items", "lineitem"),
            ("order_payments", "orders"),
            ("products", "part"),
            ("product_translation", "(SELECT DISTINCT p_type FROM part)"),
            ("reviews", "lineitem"),
        )
    ),
    "tx_status_filter": """
SELECT o_orderkey AS order_id, o_custkey AS customer_id,
       CASE o_orderstatus WHEN 'F' THEN 'delivered' ELSE 'shipped' END AS order_status,
       o_orderdate AS order_purchase_timestamp
FROM orders WHERE o_orderstatus IN ('F', 'O')""",
    "tx_items_orders": TX
    + """ SELECT order_id, product_id, order_item_id, seller_id, price, customer_id, order_status,
       ts AS order_purchase_timestamp FROM tx""",
    "tx_base": TX
    + """ SELECT order_id, product_id, order_item_id, price, freight_value, customer_id, customer_city,
       customer_state, product_category_name, category AS product_category_name_english, order_total FROM tx""",
    "tx_payments": TX + " SELECT order_id, product_id, payment_value, payment_type, order_total FROM tx",
    "tx_reviews": TX + " SELECT order_id, product_id, review_score FROM tx",
    "tx_time_features": TX
    + """ SELECT order_id, CAST(date_trunc('month', ts) AS DATE) AS order_month,
       strftime(ts, '%Y-%m') AS order_year_month, CAST(hour(ts) AS INTEGER) AS purchase_hour,
       dayname(ts) AS purchase_day, monthname(ts) AS purchase_month,
       CAST(isodow(ts) - 1 AS INTEGER) AS purchase_day_of_week, isodow(ts) >= 6 AS is_weekend FROM tx""",
    "tx_shipping_features": TX
    + """ SELECT order_id, product_id, freight_value, freight_value = 0 AS has_free_shipping,
       freight_value / (price + 1) AS freight_ratio FROM tx""",
    "overview_kpis": TX
    + f""" SELECT {dsum('order_total')} AS total_revenue, COUNT(DISTINCT order_id) AS total_orders,
       COUNT(DISTINCT customer_id) AS total_customers,
       {dsum('order_total')} / COUNT(DISTINCT order_id) AS avg_order_value FROM tx""",
    "monthly_revenue": TX
    + f" SELECT strftime(ts, '%Y-%m') AS order_year_month, {dsum('order_total')} AS revenue FROM tx GROUP BY 1",
    "monthly_orders": TX
    + " SELECT strftime(ts, '%Y-%m') AS order_year_month, COUNT(DISTINCT order_id) AS orders FROM tx GROUP BY 1",
    "top_categories": TX
    + f""" SELECT category, {dsum('order_total')} AS revenue FROM tx WHERE category IS NOT NULL
       GROUP BY 1 ORDER BY revenue DESC, category LIMIT 10""",
    "repeat_rate": TX
    + """ SELECT CAST(SUM(CAST(k > 1 AS INTEGER)) AS DOUBLE) / COUNT(*) * 100 AS repeat_rate
       FROM (SELECT customer_id, COUNT(DISTINCT order_id) AS k FROM tx WHERE customer_id IS NOT NULL GROUP BY 1)""",
    "avg_items_per_order": TX
    + """ SELECT CAST(SUM(k) AS DOUBLE) / COUNT(*) AS avg_items_per_order
       FROM (SELECT order_id, COUNT(product_id) AS k FROM tx GROUP BY 1)""",
    "avg_review": TX + " SELECT ROUND(AVG(review_score), 4) AS avg_review FROM tx",
    "free_shipping_effect": TX
    + f""" SELECT COUNT(DISTINCT order_id) FILTER (freight_value = 0) AS free_shipping_orders,
       COUNT(DISTINCT order_id) FILTER (freight_value <> 0) AS paid_shipping_orders,
       COALESCE(CAST(SUM(CAST(order_total AS {MONEY})) FILTER (freight_value = 0) AS DOUBLE)
         / COUNT(order_total) FILTER (freight_value = 0), 0) AS avg_order_free,
       COALESCE(CAST(SUM(CAST(order_total AS {MONEY})) FILTER (freight_value <> 0) AS DOUBLE)
         / COUNT(order_total) FILTER (freight_value <> 0), 0) AS avg_order_paid FROM tx""",
    "social_proof": TX
    + f""" SELECT COUNT(*) FILTER (review_score >= 4) AS high_rated_rows,
       COUNT(DISTINCT order_id) FILTER (review_score >= 4) AS high_rated_orders,
       COALESCE(CAST(SUM(CAST(price AS {MONEY})) FILTER (review_score >= 4) AS DOUBLE)
         / COUNT(price) FILTER (review_score >= 4), 0) AS avg_high_rated_price,
       COUNT(*) FILTER (review_score < 3) AS low_rated_rows,
       COUNT(DISTINCT order_id) FILTER (review_score < 3) AS low_rated_orders,
       COALESCE(CAST(SUM(CAST(price AS {MONEY})) FILTER (review_score < 3) AS DOUBLE)
         / COUNT(price) FILTER (review_score < 3), 0) AS avg_low_rated_price FROM tx""",
    "choice_architecture": TX
    + """ SELECT CAST(SUM(k) AS DOUBLE) / COUNT(*) AS avg_categories, MAX(k) AS max_categories
       FROM (SELECT customer_id, COUNT(DISTINCT category) AS k FROM tx WHERE customer_id IS NOT NULL GROUP BY 1)""",
    "orders_by_hour": EVENTS
    + " SELECT CAST(hour(ts) AS INTEGER) AS purchase_hour, COUNT(DISTINCT order_id) AS orders FROM ev GROUP BY 1",
    "peak_hours": EVENTS
    + """ SELECT STRING_AGG(CAST(h AS VARCHAR), ', ' ORDER BY k DESC, h) AS peak_hours, MAX(k) AS peak_hour_orders
       FROM (SELECT hour(ts) AS h, COUNT(DISTINCT order_id) AS k FROM ev GROUP BY 1 ORDER BY k DESC, h LIMIT 3)""",
    "status_quo_bias": TX
    + """ SELECT CAST(COUNT(*) FILTER (k > 1) AS DOUBLE) / COUNT(*) AS status_quo_bias,
       COUNT(*) AS total_customers, COUNT(*) FILTER (k > 1) AS repeat_customers
       FROM (SELECT customer_id, COUNT(DISTINCT order_id) AS k FROM tx WHERE customer_id IS NOT NULL GROUP BY 1)""",
    "weekend_vs_weekday": EVENTS
    + """ SELECT isodow(ts) >= 6 AS is_weekend, COUNT(DISTINCT order_id) AS orders,
       ROUND(AVG(order_total), 4) AS avg_order_total, ROUND(SUM(order_total), 4) AS revenue FROM ev GROUP BY 1""",
    "payment_mix": TX
    + """ SELECT payment_type, COUNT(DISTINCT order_id) AS orders FROM tx
       WHERE payment_type IS NOT NULL GROUP BY 1""",
    "state_revenue": TX
    + f""" SELECT customer_state, {dsum('order_total')} AS revenue, COUNT(DISTINCT order_id) AS orders
       FROM tx WHERE customer_state IS NOT NULL GROUP BY 1 ORDER BY revenue DESC, customer_state LIMIT 15""",
    "category_performance": TX
    + f""" SELECT category, {dsum('order_total')} AS revenue, COUNT(DISTINCT order_id) AS orders,
       COUNT(product_id) AS items_sold
       FROM tx WHERE category IS NOT NULL GROUP BY 1 ORDER BY revenue DESC, category LIMIT 15""",
    "category_ratings": TX
    + """ SELECT category, ROUND(AVG(review_score), 4) AS avg_rating, COUNT(review_score) AS review_count
       FROM tx WHERE category IS NOT NULL GROUP BY 1 HAVING COUNT(review_score) >= 10
       ORDER BY AVG(review_score) DESC, category LIMIT 15""",
    "price_stats": TX
    + f""" SELECT MIN(price) AS min_price, MAX(price) AS max_price, {davg('price')} AS avg_price,
       quantile_cont(price, 0.5) AS median_price FROM tx""",
    "popular_products": TX
    + f""" SELECT product_id, COUNT(DISTINCT order_id) AS orders, {davg('price')} AS avg_price
       FROM tx WHERE product_id IS NOT NULL GROUP BY 1 ORDER BY orders DESC, product_id LIMIT 20""",
    "rating_by_price_bin": TX
    + f""", b AS (SELECT MIN(price) AS lo, MAX(price) AS hi FROM tx)
  SELECT CAST(s.i AS INTEGER) AS bin,
         ROUND(CASE WHEN s.i = 1 THEN b.lo - (b.hi - b.lo) * 0.001 ELSE {edge('(s.i - 1)', 'b.lo', 'b.hi', 10)} END, 4)
           AS lower,
         ROUND({edge('s.i', 'b.lo', 'b.hi', 10)}, 4) AS upper, ROUND(r.score, 4) AS avg_review,
         '(' || CAST(ROUND(CASE WHEN s.i = 1 THEN b.lo - (b.hi - b.lo) * 0.001
           ELSE {edge('(s.i - 1)', 'b.lo', 'b.hi', 10)} END, 3) AS VARCHAR) || ', '
           || CAST(ROUND({edge('s.i', 'b.lo', 'b.hi', 10)}, 3) AS VARCHAR) || ']' AS label
  FROM range(1, 11) s(i) CROSS JOIN b
  LEFT JOIN (SELECT {cut_bin('price', 'b.lo', 'b.hi', 10)} AS bin, AVG(review_score) AS score
             FROM tx, b WHERE price IS NOT NULL GROUP BY 1) r ON r.bin = s.i""",
    "price_review_corr": TX + " SELECT ROUND(CORR(price, review_score), 6) AS price_review_corr FROM tx",
    "price_histogram": TX + " SELECT * FROM " + histogram("tx", "price", 50),
    "clv": CLV + " SELECT * FROM clv",
    "clv_summary": CLV
    + """ SELECT ROUND(AVG(clv), 2) AS avg_clv, ROUND(quantile_cont(clv, 0.5), 2) AS median_clv,
       ROUND(SUM(clv), 2) AS total_clv FROM clv""",
    "clv_segments": CLV
    + """ SELECT clv_segment, COUNT(*) AS customer_count, ROUND(AVG(clv), 2) AS avg_clv,
       ROUND(AVG(monetary), 2) AS avg_monetary
  FROM (SELECT *, CASE WHEN clv <= e1 THEN 'Low' WHEN clv <= e2 THEN 'Medium' WHEN clv <= e3 THEN 'High'
                       ELSE 'Very High' END AS clv_segment
        FROM clv, (SELECT quantile_cont(clv, 0.25) AS e1, quantile_cont(clv, 0.5) AS e2,
                          quantile_cont(clv, 0.75) AS e3 FROM clv)) GROUP BY 1""",
    "clv_top20": CLV
    + """ SELECT customer_id, clv, frequency, monetary, avg_order_value FROM clv
       ORDER BY clv DESC, customer_id LIMIT 20""",
    "clv_histogram": CLV + " SELECT * FROM " + histogram("clv", "clv", 50),
    "rfm_values": RFM + " SELECT * FROM vals",
    "rfm_scores": RFM + " SELECT * FROM scored",
    "rfm": RFM + " SELECT * FROM rfm",
    "rfm_segment_counts": RFM + " SELECT segment, COUNT(*) AS customers FROM rfm GROUP BY 1",
    "rfm_segment_profile": RFM
    + f""" SELECT segment, AVG(recency) AS avg_recency, AVG(frequency) AS avg_frequency,
       {davg('monetary')} AS avg_monetary, COUNT(*) AS customers FROM rfm GROUP BY 1""",
    "rfm_histograms": RFM
    + " UNION ALL ".join(
        f" SELECT '{c}' AS measure, h.* FROM {histogram('vals', c, 30)} h" for c in ("recency", "frequency", "monetary")
    ),
    "segmentation_features": SEG + " SELECT * FROM seg",
    "segmentation_scaled": SEG
    + " SELECT customer_id, avg_price, avg_shipping, "
    + ", ".join(
        f"ROUND(({c} - (SELECT AVG({c}) FROM seg)) / COALESCE(NULLIF((SELECT STDDEV_POP({c}) FROM seg), 0), 1), 6) AS {c}"
        for c in ("order_count", "total_spent", "avg_order_value", "recency_days")
    )
    + " FROM seg",
    "churn_features": CHURN + " SELECT * FROM churn",
    "churn_split": SPLIT + " SELECT customer_id, is_churned, is_test FROM split",
    "churn_rate": CHURN + " SELECT CAST(SUM(is_churned) AS DOUBLE) / COUNT(*) * 100 AS churn_rate FROM churn",
    "baskets": BASKETS
    + """ SELECT order_id, STRING_AGG(DISTINCT category, ', ' ORDER BY category) AS items
       FROM tx WHERE category IS NOT NULL GROUP BY order_id""",
    "frequent_itemsets": BASKETS + " SELECT items, freq, support FROM freq",
    "association_rules": BASKETS
    + """ SELECT *, ROUND(support - antecedent_support * consequent_support, 6) AS leverage,
       ROUND((1 - consequent_support) / NULLIF(1 - confidence, 0), 6) AS conviction,
       ROUND(COALESCE((support - antecedent_support * consequent_support) / NULLIF(GREATEST(
         support * (1 - antecedent_support), antecedent_support * (consequent_support - support)), 0), 0), 6)
         AS zhangs_metric FROM rules""",
    "rules_filtered": BASKETS + " SELECT * FROM rules WHERE support >= 0.01 AND confidence >= 0.3 AND lift >= 1.0",
    "rules_top": BASKETS
    + """ SELECT antecedents, consequents, support, confidence, lift FROM rules
       WHERE support >= 0.01 AND confidence >= 0.3 AND lift >= 1.0
       ORDER BY lift DESC, antecedents || ' => ' || consequents LIMIT 20""",
    "daily_sales": DAILY + " SELECT * FROM daily",
    "forecast_features": DAILY + " SELECT * FROM features",
    "forecast_split": DAILY
    + """ SELECT date, revenue, ROW_NUMBER() OVER (ORDER BY date) <= FLOOR((SELECT COUNT(*) FROM features) * 0.8)
       AS is_train FROM features""",
    "naive_forecast_metrics": NAIVE
    + """ SELECT ROUND(SQRT(AVG((y - p) * (y - p))), 2) AS rmse,
       ROUND(1 - SUM((y - p) * (y - p)) / (SELECT SUM((y - m) * (y - m)) FROM scored, (SELECT AVG(y) AS m FROM scored)), 6)
         AS r2 FROM scored""",
    "naive_forecast": NAIVE + " SELECT * FROM forecast",
    "naive_forecast_summary": NAIVE
    + """ SELECT ROUND(SUM(predicted_revenue), 2) AS total_forecast, ROUND(AVG(predicted_revenue), 2) AS avg_daily,
       (SELECT date FROM forecast ORDER BY predicted_revenue DESC, date LIMIT 1) AS peak_day FROM forecast""",
    "rule_churn_metrics": RULE
    + """ SELECT ROUND((tp + tn) / (tp + tn + fp + fn)::DOUBLE, 9) AS accuracy,
       ROUND(COALESCE(tp / NULLIF(tp + fp, 0)::DOUBLE, 0), 9) AS "precision",
       ROUND(COALESCE(tp / NULLIF(tp + fn, 0)::DOUBLE, 0), 9) AS recall,
       ROUND(COALESCE(2 * tp / NULLIF(2 * tp + fp + fn, 0)::DOUBLE, 0), 9) AS f1
  FROM (SELECT COUNT(*) FILTER (is_churned = 1 AND p >= 0.5) AS tp, COUNT(*) FILTER (is_churned = 0 AND p >= 0.5) AS fp,
               COUNT(*) FILTER (is_churned = 1 AND p < 0.5) AS fn, COUNT(*) FILTER (is_churned = 0 AND p < 0.5) AS tn
        FROM ruled WHERE is_test)""",
    "rule_churn_risk_counts": RULE
    + " SELECT churn_risk, COUNT(*) AS customers FROM ruled WHERE churn_risk IS NOT NULL GROUP BY 1",
    "rule_churn_top20": RULE
    + """ SELECT customer_id, churn_probability, recency_days, order_count, total_spent FROM ruled
       WHERE churn_risk = 'High' ORDER BY churn_probability DESC, customer_id LIMIT 20""",
    "quartile_label_counts": QUARTILES
    + " SELECT cluster_label, COUNT(*) AS customers FROM labelled GROUP BY 1",
    "quartile_profile": QUARTILES
    + """ SELECT cluster_label, COUNT(customer_id) AS customers, ROUND(AVG(total_spent), 2) AS avg_total_spent,
       ROUND(AVG(order_count), 6) AS avg_orders, ROUND(AVG(avg_order_value), 2) AS avg_order_value,
       ROUND(AVG(recency_days), 6) AS avg_recency FROM labelled GROUP BY 1""",
    "overview_kpis_item_share": SHARED
    + """ SELECT ROUND(SUM(share), 2) AS total_revenue, COUNT(DISTINCT order_id) AS total_orders,
       COUNT(DISTINCT customer_id) AS total_customers,
       ROUND(SUM(share) / COUNT(DISTINCT order_id), 4) AS avg_order_value FROM shared""",
    "monthly_revenue_item_share": SHARED
    + """ SELECT strftime(ts, '%Y-%m') AS order_year_month, ROUND(SUM(share), 2) AS revenue FROM shared GROUP BY 1""",
    "monthly_revenue_by_month": TX
    + f" SELECT strftime(ts, '%Y-%m') AS order_year_month, {dsum('order_total')} AS revenue FROM tx GROUP BY 1",
    "monthly_orders_by_month": TX
    + " SELECT strftime(ts, '%Y-%m') AS order_year_month, COUNT(DISTINCT order_id) AS orders FROM tx GROUP BY 1",
    "overview_page": TX
    + f""", customers AS (
  SELECT customer_id, COUNT(DISTINCT order_id) AS orders FROM tx WHERE customer_id IS NOT NULL GROUP BY 1
), figures AS (
  SELECT {dsum('order_total')} AS total_revenue, COUNT(DISTINCT order_id)::DOUBLE AS total_orders,
    COUNT(DISTINCT customer_id)::DOUBLE AS total_customers, {dsum('order_total')} / COUNT(DISTINCT order_id) AS avg_order_value,
    (SELECT AVG((orders > 1)::INT) * 100 FROM customers) AS repeat_rate, (SELECT AVG((orders > 1)::INT) FROM customers) AS status_quo_bias,
    (SELECT SUM((orders > 1)::INT)::DOUBLE FROM customers) AS repeat_customers,
    COUNT(product_id)::DOUBLE / COUNT(DISTINCT order_id) AS avg_items_per_order, AVG(review_score) AS avg_review FROM tx
), page AS (
  SELECT 'figures' AS section, NULL::VARCHAR AS key, metric, value FROM (UNPIVOT figures ON COLUMNS(*) INTO NAME metric VALUE value)
  UNION ALL SELECT 'month', strftime(ts, '%Y-%m'), 'revenue', {dsum('order_total')} FROM tx GROUP BY ALL
  UNION ALL SELECT 'month', strftime(ts, '%Y-%m'), 'orders', COUNT(DISTINCT order_id)::DOUBLE FROM tx GROUP BY ALL
  UNION ALL SELECT * FROM (SELECT 'category', category, 'revenue', {dsum('order_total')} AS value FROM tx WHERE category IS NOT NULL
    GROUP BY ALL ORDER BY value DESC, category LIMIT 10)
) SELECT section, key, metric, ROUND(value, 4) AS value FROM page""",
    "sales_page": TX
    + f""", payments AS (
  SELECT payment_type AS key, COUNT(DISTINCT order_id)::DOUBLE AS orders FROM tx WHERE payment_type IS NOT NULL GROUP BY 1
), states AS (
  SELECT customer_state AS key, {dsum('order_total')} AS revenue, COUNT(DISTINCT order_id)::DOUBLE AS orders FROM tx
  WHERE customer_state IS NOT NULL GROUP BY 1 ORDER BY revenue DESC, key LIMIT 15
), categories AS (
  SELECT category AS key, {dsum('order_total')} AS revenue, COUNT(DISTINCT order_id)::DOUBLE AS orders,
    COUNT(product_id)::DOUBLE AS items_sold FROM tx WHERE category IS NOT NULL GROUP BY 1 ORDER BY revenue DESC, key LIMIT 15
), page AS (
  SELECT 'payment' AS section, key, metric, value FROM (UNPIVOT payments ON COLUMNS(* EXCLUDE (key)) INTO NAME metric VALUE value)
  UNION ALL SELECT 'state', key, metric, value FROM (UNPIVOT states ON COLUMNS(* EXCLUDE (key)) INTO NAME metric VALUE value)
  UNION ALL SELECT 'category', key, metric, value FROM (UNPIVOT categories ON COLUMNS(* EXCLUDE (key)) INTO NAME metric VALUE value)
) SELECT section, key, metric, ROUND(value, 4) AS value FROM page""",
    "stump_churn_importance": CHURN_STUMP
    + f""" SELECT f.feature, ROUND(COALESCE(gain, 0) / NULLIF((SELECT SUM(gain) FROM cut), 0), 9) AS importance
       FROM (SELECT UNNEST([{", ".join(f"'{c}'" for c in CHURN_INPUTS)}]) AS feature) f LEFT JOIN cut USING (feature)""",
    "stump_churn_metrics": CHURN_STUMP
    + """ SELECT ROUND((tp + tn) / (tp + tn + fp + fn)::DOUBLE, 9) AS accuracy,
       ROUND(COALESCE(tp / NULLIF(tp + fp, 0)::DOUBLE, 0), 9) AS "precision",
       ROUND(COALESCE(tp / NULLIF(tp + fn, 0)::DOUBLE, 0), 9) AS recall,
       ROUND(COALESCE(2 * tp / NULLIF(2 * tp + fp + fn, 0)::DOUBLE, 0), 9) AS f1
  FROM (SELECT COUNT(*) FILTER (is_churned = 1 AND p >= 0.5) AS tp, COUNT(*) FILTER (is_churned = 0 AND p >= 0.5) AS fp,
               COUNT(*) FILTER (is_churned = 1 AND p < 0.5) AS fn, COUNT(*) FILTER (is_churned = 0 AND p < 0.5) AS tn
        FROM ruled WHERE is_test)""",
    "stump_forecast_metrics": DAY_STUMP
    + """ SELECT ROUND(SQRT(AVG((y - p) * (y - p))), 2) AS rmse,
       ROUND(1 - SUM((y - p) * (y - p)) / SUM((y - m) * (y - m)), 6) AS r2 FROM scored, (SELECT AVG(y) AS m FROM scored)""",
    "fixed_kmeans_label_counts": FIXED + " SELECT cluster_label, COUNT(*) AS customers FROM labelled GROUP BY 1",
    "fixed_kmeans_profile": FIXED
    + """ SELECT cluster_label, COUNT(customer_id) AS customers, ROUND(AVG(total_spent), 2) AS avg_total_spent,
       ROUND(AVG(order_count), 6) AS avg_orders, ROUND(AVG(avg_order_value), 2) AS avg_order_value,
       ROUND(AVG(recency_days), 6) AS avg_recency FROM labelled GROUP BY 1""",
    "contract_report": contract_rows(),
    "exported_category_performance": TX
    + f""" SELECT category, {dsum('order_total')} AS revenue, COUNT(DISTINCT order_id) AS orders,
       COUNT(product_id) AS items_sold
       FROM tx WHERE category IS NOT NULL GROUP BY 1 ORDER BY revenue DESC, category LIMIT 15""",
    "tx_text_times": TX
    + """, timed AS (
  SELECT order_id, product_id, CASE order_id % 4 WHEN 0 THEN date_trunc('second', ts) WHEN 1 THEN date_trunc('day', ts)
         WHEN 2 THEN date_trunc('minute', ts) END AS t FROM tx)
SELECT order_id, product_id, t::TIMESTAMP AS order_purchase_timestamp, strftime(t, '%Y-%m') AS order_year_month FROM timed""",
}
