"""The star as common table expressions, and small SQL text helpers."""


def ratio(num: str, den: str, places: int, shift: int = 0) -> str:
    """``num * 10**shift / den`` rounded half away from zero, as a double."""
    power = places + shift
    n = f"CAST({num} AS HUGEINT)"
    d = f"(CAST({den} AS HUGEINT) * {10 ** max(-power, 0)})"
    whole = f"((2 * abs({n}) * {10 ** max(power, 0)} + {d}) // (2 * {d}))"
    return (
        f"(CASE WHEN {d} = 0 THEN NULL ELSE "
        f"CAST(sign({n}) * {whole} AS DOUBLE) / {10**places} END)"
    )


def pct(num: str, den: str, places: int = 2) -> str:
    return ratio(num, den, places, 2)


def money(cents: str) -> str:
    return f"(CAST({cents} AS DOUBLE) / 100)"


def mean_money(cents: str, n: str) -> str:
    return ratio(cents, n, 2, -2)


def whole(expression: str) -> str:
    return f"CAST({expression} AS BIGINT)"


def title(text: str) -> str:
    runs = f"regexp_extract_all(trim({text}), '[a-zA-Z]+|[^a-zA-Z]+')"
    return f"array_to_string(list_transform({runs}, lambda x: upper(x[1]) || lower(x[2:])), '')"


def stamp(moment: str) -> str:
    return f"strftime({moment}, '%Y-%m-%d %H:%M:%S')"


def floor_days(later: str, earlier: str) -> str:
    return f"CAST(floor((epoch({later}) - epoch({earlier})) / 86400) AS BIGINT)"


BUCKET = (
    "CASE WHEN {d} >= 10 THEN '1. Very Early (10+ days early)' "
    "WHEN {d} BETWEEN 1 AND 9 THEN '2. Early (1-9 days)' "
    "WHEN {d} = 0 THEN '3. On Time' "
    "WHEN {d} BETWEEN -5 AND -1 THEN '4. Slightly Late (1-5 days)' "
    "ELSE '5. Very Late (5+ days)' END"
)

STAR = f"""
customers AS (
  SELECT CAST(c_custkey AS VARCHAR) AS customer_id, CAST(c_custkey // 2 AS VARCHAR) AS person,
    {title('c_mktsegment')} AS city, {title('n_name')} AS state,
    CAST(c_custkey % 100 AS VARCHAR) AS zip
  FROM customer JOIN nation ON c_nationkey = n_nationkey),
products AS (
  SELECT CAST(p_partkey AS VARCHAR) AS product_id, replace(p_name, ' ', '_') AS native,
    CASE WHEN p_name IS NULL OR p_name LIKE 'red %' THEN 'other' ELSE p_name END AS category,
    CASE WHEN p_partkey % 50 <> 0 THEN p_size * 200 END AS grams, p_size AS size,
    p_size % 6 + 1 AS photos, length(p_name) AS name_length
  FROM part),
sellers AS (
  SELECT CAST(s_suppkey AS VARCHAR) AS seller_id, {title('r_name')} AS city,
    {title('n_name')} AS state, CAST(s_suppkey % 100 AS VARCHAR) AS zip
  FROM supplier JOIN nation ON s_nationkey = n_nationkey
    JOIN region ON n_regionkey = r_regionkey),
bought AS (
  SELECT *, o_orderdate + to_seconds(o_orderkey * 7919 % 86400) AS bought,
    o_orderstatus IN ('F', 'O') AS done
  FROM orders),
shipped AS (
  SELECT o_orderkey AS k, CAST(o_orderkey AS VARCHAR) AS order_id,
    CAST(o_custkey AS VARCHAR) AS customer_id,
    CASE WHEN done THEN 'delivered' WHEN o_orderpriority = '1-URGENT' THEN 'canceled'
      WHEN o_orderpriority = '2-HIGH' THEN 'invoiced'
      WHEN o_orderpriority = '3-MEDIUM' THEN 'processing' ELSE 'shipped' END AS status,
    bought, bought + to_seconds(3600) AS approved,
    CASE WHEN done THEN bought + to_seconds(43200) END AS handed,
    CASE WHEN done AND o_orderkey % 97 <> 0
      THEN bought + to_seconds(o_orderkey * 104729 % 2592000 + 86400) END AS arrived,
    date_trunc('day', bought) + to_days(CAST(o_orderkey * 13 % 30 + 12 AS INTEGER)) AS promised
  FROM bought),
facts AS (
  SELECT *, {floor_days('arrived', 'bought')} AS days,
    {floor_days('promised', 'bought')} AS promised_days,
    {floor_days('promised', 'arrived')} AS early,
    CASE WHEN arrived > promised THEN 1 ELSE 0 END AS late,
    strftime(bought, '%Y-%m') AS month
  FROM shipped),
lines AS (
  SELECT CAST(l_orderkey AS VARCHAR) AS order_id, l_linenumber AS line,
    CAST(l_partkey AS VARCHAR) AS product_id, CAST(l_suppkey AS VARCHAR) AS seller_id,
    l_shipdate AS ship_by,
    CASE WHEN l_tax = 0 AND l_discount = 0 THEN 0
      ELSE CAST(CAST(l_extendedprice AS DECIMAL(12,2)) * 100 AS BIGINT) END AS price_c,
    CAST(CAST(l_extendedprice AS DECIMAL(12,2)) * 100 AS BIGINT)
      * CAST(CAST(l_tax AS DECIMAL(4,2)) * 100 AS BIGINT) AS tax_cc
  FROM lineitem),
items AS (
  SELECT *, (2 * tax_cc + 100) // 200 AS freight_c, price_c + (2 * tax_cc + 100) // 200 AS total_c
  FROM lines WHERE price_c > 0),
paid AS (
  SELECT CAST(o_orderkey AS VARCHAR) AS order_id, 1 AS place,
    CASE o_orderpriority WHEN '1-URGENT' THEN 'credit_card' WHEN '2-HIGH' THEN 'boleto'
      WHEN '3-MEDIUM' THEN 'voucher' WHEN '4-NOT SPECIFIED' THEN 'debit_card'
      ELSE 'not_defined' END AS kind,
    CAST(o_orderkey % 13 AS INTEGER) AS parts,
    CAST(CAST(o_totalprice AS DECIMAL(12,2)) * 100 AS BIGINT) AS value_c
  FROM orders
  UNION ALL SELECT CAST(o_orderkey AS VARCHAR), 2, 'voucher', 1, 1000 FROM orders
  WHERE o_orderkey % 10 = 0
  UNION ALL SELECT CAST(o_orderkey AS VARCHAR), 3, 'voucher', 1, 0 FROM orders
  WHERE o_orderkey % 101 = 0),
payments AS (SELECT * FROM paid WHERE value_c > 0),
written AS (
  SELECT order_id, k, order_id || '-a' AS review_id, 1 AS place,
    least(5, greatest(1, 5 - 2 * late - k % 7 % 3)) AS score FROM facts WHERE k % 20 <> 0
  UNION ALL SELECT order_id, k, order_id || '-b', 2, k % 5 + 1 FROM facts
  WHERE k % 20 <> 0 AND k % 50 = 1
  UNION ALL SELECT order_id, k, order_id || '-a', 3, 1 FROM facts
  WHERE k % 20 <> 0 AND k % 100 = 3
  UNION ALL SELECT order_id, k, order_id || '-c', 4, 9 FROM facts
  WHERE k % 20 <> 0 AND k % 211 = 0),
first_written AS (
  SELECT * FROM written QUALIFY row_number() OVER (PARTITION BY review_id ORDER BY place) = 1),
reviews AS (SELECT * FROM first_written WHERE score BETWEEN 1 AND 5),
done AS (SELECT * FROM facts WHERE status = 'delivered'),
sales AS (SELECT * FROM done JOIN items USING (order_id)),
fanned AS (SELECT sales.*, score FROM sales LEFT JOIN reviews USING (order_id)),
spend AS (
  SELECT person, count(DISTINCT order_id) AS orders, sum(total_c) AS spend_c,
    count(*) AS items, min(bought) AS first_order, max(bought) AS last_order
  FROM sales JOIN customers USING (customer_id) GROUP BY person),
rfm AS (
  SELECT person, date_diff('day', CAST(last_order AS DATE),
      CAST((SELECT max(bought) FROM facts) AS DATE)) AS recency, orders, spend_c
  FROM spend),
tiles AS (
  SELECT *, ntile(5) OVER (ORDER BY recency DESC, person) AS r,
    ntile(5) OVER (ORDER BY orders, person) AS f, ntile(5) OVER (ORDER BY spend_c, person) AS m
  FROM rfm),
segments AS (
  SELECT *, CASE WHEN r >= 4 THEN
      CASE WHEN f >= 4 AND m >= 4 THEN 'Champions' WHEN f >= 3 THEN 'Loyal Customers'
        ELSE 'New Customers' END
    WHEN r = 3 THEN
      CASE WHEN f >= 3 AND m >= 3 THEN 'Potential Loyalists' ELSE 'Need Attention' END
    WHEN f >= 3 THEN 'At Risk' WHEN m >= 3 THEN 'Cant Lose Them' ELSE 'Lost' END AS segment
  FROM tiles),
visits AS (
  SELECT person, month, min(month) OVER (PARTITION BY person) AS cohort
  FROM done JOIN customers USING (customer_id)),
aged AS (
  SELECT *, (CAST(month[1:4] AS INTEGER) - CAST(cohort[1:4] AS INTEGER)) * 12
    + CAST(month[6:7] AS INTEGER) - CAST(cohort[6:7] AS INTEGER) AS age FROM visits),
activity AS (
  SELECT cohort, age, count(DISTINCT person) AS active FROM aged GROUP BY cohort, age),
cohort_base AS (SELECT cohort, active AS size FROM activity WHERE age = 0),
grid AS (
  SELECT b.cohort, size, a.age, coalesce(active, 0) AS active
  FROM cohort_base b CROSS JOIN (SELECT DISTINCT age FROM activity) a
    LEFT JOIN activity x ON x.cohort = b.cohort AND x.age = a.age),
studied AS (
  SELECT f.order_id, f.days, f.promised_days, f.early, f.late, r.score, r.review_id, i.price_c,
    i.freight_c, i.total_c, i.line, i.product_id, p.grams, p.category, c.state
  FROM done f JOIN reviews r USING (order_id) JOIN items i USING (order_id)
    JOIN products p USING (product_id) JOIN customers c USING (customer_id)
  WHERE f.days BETWEEN 0 AND 60)
"""


def query(body: str) -> str:
    """A full statement: the star, further CTEs if the body starts with a comma, the body."""
    body = body.strip()
    return f"WITH {STAR}{body}" if body.startswith(",") else f"WITH {STAR} {body}"
