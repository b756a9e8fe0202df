"""One DuckDB statement per report, keyed like the registered queries."""

from oracles.star_sql import (
    BUCKET,
    mean_money,
    money,
    pct,
    query,
    ratio,
    stamp,
    whole,
)

SUM = "sum(total_c)"
N = "count(*)"


def _overview() -> dict[str, str]:
    return {
        "baseline_kpis": f"""
            SELECT count(DISTINCT order_id) AS total_orders,
              count(DISTINCT customer_id) AS total_customers,
              count(DISTINCT product_id) AS total_products,
              count(DISTINCT seller_id) AS total_sellers, {money(SUM)} AS total_revenue,
              {mean_money(SUM, N)} AS avg_item_value,
              {mean_money(SUM, 'count(DISTINCT order_id)')} AS avg_order_value
            FROM sales""",
        "order_status_distribution": f"""
            SELECT status AS order_status, {N} AS order_count,
              {pct(N, '(SELECT count(*) FROM facts)')} AS pct
            FROM facts GROUP BY status""",
        "monthly_order_volume": """
            SELECT month AS order_month, count(DISTINCT order_id) AS orders,
              count(DISTINCT customer_id) AS customers
            FROM done GROUP BY month""",
        "revenue_by_state": f"""
            SELECT state AS customer_state, count(DISTINCT order_id) AS total_orders,
              {money(SUM)} AS total_revenue, {mean_money(SUM, N)} AS avg_item_value
            FROM sales JOIN customers USING (customer_id)
            GROUP BY state ORDER BY {SUM} DESC, state LIMIT 10""",
        "top_categories": f"""
            SELECT category, count(DISTINCT order_id) AS order_count, {N} AS items_sold,
              {money(SUM)} AS total_revenue, {mean_money('sum(price_c)', N)} AS avg_price
            FROM sales JOIN products USING (product_id)
            GROUP BY category ORDER BY {SUM} DESC, category LIMIT 10""",
        "payment_type_distribution": f"""
            SELECT kind AS payment_type, {N} AS payment_count,
              {money('sum(value_c)')} AS total_value, {mean_money('sum(value_c)', N)} AS avg_value,
              {ratio('sum(parts)', 'count(parts)', 1)} AS avg_installments,
              {pct(N, '(SELECT count(*) FROM payments)')} AS pct
            FROM payments GROUP BY kind""",
        "review_score_distribution": f"""
            SELECT {whole('score')} AS review_score, {N} AS review_count,
              {pct(N, '(SELECT count(*) FROM reviews)')} AS pct
            FROM reviews GROUP BY score""",
        "slowest_states": f"""
            SELECT state AS customer_state, {N} AS deliveries,
              {ratio('sum(days)', N, 1)} AS avg_delivery_days,
              {ratio('sum(promised_days)', N, 1)} AS avg_estimated_days,
              {ratio('sum(early)', N, 1)} AS avg_delta_days, {pct('sum(late)', N)} AS late_pct
            FROM done JOIN customers USING (customer_id) WHERE days IS NOT NULL
            GROUP BY state ORDER BY avg_delivery_days DESC, state LIMIT 10""",
    }


def _revenue() -> dict[str, str]:
    prev = "lag(revenue_c) OVER (ORDER BY month)"
    total = "sum(revenue_c) OVER ()"
    running = "sum(revenue_c) OVER (ORDER BY revenue_c DESC)"
    seven = "OVER (ORDER BY day ROWS BETWEEN 6 PRECEDING AND CURRENT ROW)"
    return {
        "revenue_waterfall": f"""
            , months AS (
              SELECT month, count(DISTINCT order_id) AS orders, {SUM} AS revenue_c,
                count(DISTINCT customer_id) AS people FROM sales GROUP BY month)
            SELECT month AS order_month, orders AS total_orders,
              {money('revenue_c')} AS monthly_revenue, people AS unique_customers,
              {mean_money('revenue_c', 'orders')} AS avg_order_value,
              {money('sum(revenue_c) OVER (ORDER BY month)')} AS running_total_revenue,
              {money(prev)} AS prev_month_revenue,
              {pct(f'(revenue_c - {prev})', prev)} AS mom_growth_pct
            FROM months""",
        "pareto_abc": f"""
            , per_category AS (
              SELECT category, {SUM} AS revenue_c, count(DISTINCT order_id) AS order_count,
                {N} AS items_sold
              FROM sales JOIN products USING (product_id) GROUP BY category),
            shares AS (
              SELECT category, {money('revenue_c')} AS revenue, order_count, items_sold,
                {pct('revenue_c', total)} AS revenue_pct, {pct(running, total)} AS cumulative_pct,
                row_number() OVER (ORDER BY revenue_c DESC, category) AS rank_num
              FROM per_category)
            SELECT *, CASE WHEN cumulative_pct <= 80 THEN 'A (Top 80%)'
              WHEN cumulative_pct <= 95 THEN 'B (Next 15%)' ELSE 'C (Bottom 5%)' END AS abc_class
            FROM shares""",
        "payment_installment_analysis": f"""
            , plans AS (
              SELECT p.*, CASE WHEN parts = 1 THEN '1 (Full Payment)'
                WHEN parts BETWEEN 2 AND 3 THEN '2-3 Installments'
                WHEN parts BETWEEN 4 AND 6 THEN '4-6 Installments'
                WHEN parts BETWEEN 7 AND 10 THEN '7-10 Installments'
                ELSE '10+ Installments' END AS plan
              FROM payments p JOIN done USING (order_id)),
            counted AS (
              SELECT kind, plan, count(DISTINCT order_id) AS orders, {N} AS n,
                sum(value_c) AS value_c FROM plans GROUP BY kind, plan)
            SELECT kind AS payment_type, plan AS installment_bucket, orders AS order_count,
              {mean_money('value_c', 'n')} AS avg_payment_value,
              {money('value_c')} AS total_payment_value,
              {pct('orders', 'sum(orders) OVER ()')} AS pct_of_orders
            FROM counted""",
        "daily_revenue_ma7": f"""
            , daily AS (
              SELECT CAST(bought AS DATE) AS day, count(DISTINCT order_id) AS orders,
                {SUM} AS revenue_c FROM sales GROUP BY day)
            SELECT strftime(day, '%Y-%m-%d') AS order_date, orders AS daily_orders,
              {money('revenue_c')} AS daily_revenue,
              {mean_money(f'sum(revenue_c) {seven}', f'count(*) {seven}')} AS moving_avg_7d,
              {money('sum(revenue_c) OVER (ORDER BY day)')} AS cumulative_revenue
            FROM daily""",
        "revenue_concentration": f"""
            , fifths AS (
              SELECT spend_c, ntile(5) OVER (ORDER BY spend_c DESC, person) AS q FROM spend)
            SELECT {whole('q')} AS spend_quintile,
              CASE q WHEN 1 THEN 'Top 20% (Quintile 1)' WHEN 2 THEN 'Q2 (21-40%)'
                WHEN 3 THEN 'Q3 (41-60%)' WHEN 4 THEN 'Q4 (61-80%)'
                ELSE 'Bottom 20% (Q5)' END AS segment,
              {N} AS customer_count, {money('sum(spend_c)')} AS segment_revenue,
              {mean_money('sum(spend_c)', N)} AS avg_spend,
              {pct('sum(spend_c)', '(SELECT sum(spend_c) FROM spend)')} AS revenue_share_pct
            FROM fifths GROUP BY q""",
    }


def _customers() -> dict[str, str]:
    return {
        "rfm_scores": f"""
            SELECT person AS customer_unique_id, recency AS recency_days, orders AS frequency,
              {money('spend_c')} AS monetary, r AS r_score, f AS f_score, m AS m_score,
              concat(r, f, m) AS rfm_segment_code, r + f + m AS rfm_total,
              segment AS customer_segment
            FROM segments""",
        "rfm_segment_summary": f"""
            SELECT segment AS customer_segment, {N} AS customer_count,
              {pct(N, '(SELECT count(*) FROM rfm)')} AS pct_of_customers,
              {money('sum(spend_c)')} AS total_revenue,
              {pct('sum(spend_c)', '(SELECT sum(spend_c) FROM rfm)')} AS revenue_share_pct,
              {ratio('sum(recency)', N, 0)} AS avg_recency,
              {ratio('sum(orders)', N, 1)} AS avg_frequency,
              {mean_money('sum(spend_c)', N)} AS avg_monetary
            FROM segments GROUP BY segment""",
        "cohort_retention": f"""
            SELECT cohort AS cohort_month, age AS months_since_first,
              active AS active_customers, size AS cohort_size,
              {pct('active', 'size')} AS retention_pct
            FROM activity JOIN cohort_base USING (cohort)""",
        "customer_clv": f"""
            , tiered AS (
              SELECT *, ntile(5) OVER (ORDER BY spend_c, person) AS tier FROM spend)
            SELECT person AS customer_unique_id, orders AS total_orders,
              {money('spend_c')} AS total_revenue,
              {mean_money('spend_c', 'items')} AS avg_order_value,
              date_diff('day', CAST(first_order AS DATE), CAST(last_order AS DATE))
                AS customer_lifespan_days,
              {stamp('first_order')} AS first_order, {stamp('last_order')} AS last_order,
              tier AS clv_tier,
              CASE tier WHEN 1 THEN 'Basic' WHEN 2 THEN 'Bronze' WHEN 3 THEN 'Silver'
                WHEN 4 THEN 'Gold' ELSE 'Platinum' END AS clv_label
            FROM tiered""",
        "rfm_base": f"""
            SELECT person AS customer_unique_id, recency, orders AS frequency,
              {money('spend_c')} AS monetary FROM rfm WHERE spend_c > 0""",
        "rfm_profile": f"""
            SELECT {N} AS customers, min(recency) AS min_recency, max(recency) AS max_recency,
              min(orders) AS min_frequency, max(orders) AS max_frequency,
              {money('min(spend_c)')} AS min_monetary, {money('max(spend_c)')} AS max_monetary
            FROM rfm WHERE spend_c > 0""",
        "rfm_features": f"""
            , logs AS (
              SELECT *, ln(1.0 + recency) AS r, ln(1.0 + orders) AS f,
                ln(1.0 + CAST(spend_c AS DOUBLE) / 100) AS m FROM rfm WHERE spend_c > 0)
            SELECT person AS customer_unique_id, recency, orders AS frequency,
              {money('spend_c')} AS monetary,
              round((r - avg(r) OVER ()) / stddev_pop(r) OVER (), 6) AS recency_log,
              round((f - avg(f) OVER ()) / stddev_pop(f) OVER (), 6) AS frequency_log,
              round((m - avg(m) OVER ()) / stddev_pop(m) OVER (), 6) AS monetary_log
            FROM logs""",
    }


def _delivery() -> dict[str, str]:
    prev = "lag(mean_days) OVER (ORDER BY month)"
    return {
        "delivery_sla_by_state": f"""
            SELECT state AS customer_state, {N} AS total_deliveries,
              {ratio('sum(days)', N, 1)} AS avg_delivery_days,
              {ratio('sum(promised_days)', N, 1)} AS avg_estimated_days,
              {ratio('sum(early)', N, 1)} AS avg_delta_days, min(days) AS min_days,
              max(days) AS max_days, {whole('sum(late)')} AS late_deliveries,
              {pct('sum(late)', N)} AS late_delivery_pct,
              {pct(f'({N} - sum(late))', N)} AS on_time_pct
            FROM done JOIN customers USING (customer_id) WHERE arrived IS NOT NULL
            GROUP BY state""",
        "delivery_review_buckets": f"""
            SELECT {BUCKET.format(d='early')} AS delivery_bucket, {N} AS order_count,
              {ratio('sum(score)', N, 2)} AS avg_review_score,
              count(*) FILTER (score = 5) AS five_star, count(*) FILTER (score = 4) AS four_star,
              count(*) FILTER (score <= 2) AS bad_reviews,
              {pct('count(*) FILTER (score <= 2)', N)} AS bad_review_pct
            FROM done JOIN reviews USING (order_id) WHERE early IS NOT NULL GROUP BY 1""",
        "monthly_delivery_trend": f"""
            , months AS (
              SELECT month, {N} AS n, {ratio('sum(days)', N, 1)} AS mean_days,
                {whole('sum(late)')} AS late FROM done WHERE days IS NOT NULL GROUP BY month)
            SELECT month AS order_month, n AS total_deliveries, mean_days AS avg_delivery_days,
              late AS late_count, {pct('late', 'n')} AS late_pct, {prev} AS prev_month_avg_days,
              round(mean_days - {prev}, 1) AS delivery_time_change,
              CASE WHEN mean_days < {prev} THEN 'Improving'
                WHEN mean_days > {prev} THEN 'Worsening' ELSE 'Stable' END AS trend
            FROM months""",
        "freight_by_state_weight": f"""
            SELECT state AS customer_state,
              CASE WHEN grams <= 500 THEN 'Light (≤500g)' WHEN grams <= 2000
                THEN 'Medium (500g-2kg)' WHEN grams <= 5000 THEN 'Heavy (2-5kg)'
                ELSE 'Very Heavy (5kg+)' END AS weight_bucket,
              {N} AS item_count, {mean_money('sum(freight_c)', N)} AS avg_freight,
              {mean_money('sum(price_c)', N)} AS avg_price,
              {pct('sum(freight_c)', 'sum(price_c)')} AS freight_as_pct_of_price,
              {ratio('sum(days)', N, 1)} AS avg_delivery_days
            FROM sales JOIN customers USING (customer_id) JOIN products USING (product_id)
            WHERE days IS NOT NULL AND grams IS NOT NULL GROUP BY 1, 2""",
        "seller_reliability": f"""
            , per_seller AS (
              SELECT seller_id, count(DISTINCT order_id) AS orders,
                {ratio('sum(days)', N, 1)} AS mean_days, {whole('sum(late)')} AS late,
                {pct('sum(late)', 'count(DISTINCT order_id)')} AS late_pct,
                {ratio('sum(score)', 'count(score)', 2)} AS review
              FROM fanned WHERE days IS NOT NULL GROUP BY seller_id
              HAVING count(DISTINCT order_id) >= 10),
            placed AS (
              SELECT *, dense_rank() OVER (ORDER BY late_pct, review DESC NULLS LAST) AS place,
                ntile(4) OVER (ORDER BY late_pct, review DESC NULLS LAST, seller_id) AS quarter
              FROM per_seller)
            SELECT seller_id, city AS seller_city, state AS seller_state, orders AS total_orders,
              mean_days AS avg_delivery_days, late AS late_deliveries, late_pct,
              review AS avg_review, place AS reliability_rank, quarter AS reliability_quartile,
              CASE quarter WHEN 1 THEN 'Excellent' WHEN 2 THEN 'Good' WHEN 3 THEN 'Fair'
                ELSE 'Poor' END AS reliability_tier
            FROM placed JOIN sellers USING (seller_id)
            ORDER BY late_pct, review DESC NULLS LAST, seller_id LIMIT 50""",
    }


def _sellers() -> dict[str, str]:
    down = "sum(revenue_c) OVER (ORDER BY revenue_c DESC)"
    everything = "sum(revenue_c) OVER ()"
    review = ratio("sum(score)", "count(score)", 2)
    days = ratio("sum(days)", "count(days)", 1)
    return {
        "seller_performance": f"""
            , per_seller AS (
              SELECT seller_id, count(DISTINCT order_id) AS orders, {N} AS n,
                {SUM} AS revenue_c, sum(price_c) AS price_c, sum(freight_c) AS freight_c,
                {review} AS review, count(*) FILTER (score <= 2) AS bad
              FROM fanned GROUP BY seller_id)
            SELECT seller_id, city AS seller_city, state AS seller_state, orders AS total_orders,
              n AS total_items_sold, {money('revenue_c')} AS total_revenue,
              {mean_money('price_c', 'n')} AS avg_item_price,
              {mean_money('freight_c', 'n')} AS avg_freight, review AS avg_review_score,
              bad AS bad_reviews, dense_rank() OVER (ORDER BY revenue_c DESC) AS revenue_rank,
              ntile(10) OVER (ORDER BY revenue_c DESC, seller_id) AS revenue_decile,
              {pct('revenue_c', everything, 4)} AS revenue_share_pct,
              {money(down)} AS cumulative_revenue,
              {pct(down, everything)} AS cumulative_revenue_pct
            FROM per_seller JOIN sellers USING (seller_id)""",
        "category_matrix": f"""
            SELECT category, count(DISTINCT order_id) AS order_count, {N} AS items_sold,
              {money(SUM)} AS total_revenue, {mean_money('sum(price_c)', N)} AS avg_price,
              {mean_money('sum(freight_c)', N)} AS avg_freight, {review} AS avg_review,
              {days} AS avg_delivery_days, {pct('sum(late)', N)} AS late_delivery_pct,
              dense_rank() OVER (ORDER BY {SUM} DESC) AS revenue_rank,
              dense_rank() OVER (ORDER BY CAST(sum(score) AS DOUBLE) / count(score) DESC
                NULLS LAST) AS satisfaction_rank,
              dense_rank() OVER (ORDER BY count(DISTINCT order_id) DESC) AS volume_rank
            FROM fanned JOIN products USING (product_id) GROUP BY category""",
        "basket_pairs": f"""
            , baskets AS (
              SELECT DISTINCT order_id, category FROM items JOIN products USING (product_id)),
            holders AS (SELECT category, count(*) AS orders FROM baskets GROUP BY category),
            pairs AS (
              SELECT a.category AS a, b.category AS b, {N} AS n
              FROM baskets a JOIN baskets b
                ON a.order_id = b.order_id AND a.category < b.category
              GROUP BY a.category, b.category HAVING count(*) >= 20)
            SELECT a AS category_a, b AS category_b, n AS co_occurrence_count,
              {pct('n', 'orders')} AS pct_of_category_a_orders
            FROM pairs JOIN holders ON a = category ORDER BY n DESC, a, b LIMIT 20""",
        "seller_state_summary": f"""
            SELECT state AS seller_state, count(DISTINCT seller_id) AS seller_count,
              count(DISTINCT order_id) AS total_orders, {money(SUM)} AS total_revenue,
              {mean_money(SUM, 'count(DISTINCT seller_id)')} AS revenue_per_seller,
              {review} AS avg_review, {days} AS avg_delivery_days,
              dense_rank() OVER (ORDER BY {SUM} DESC) AS state_rank
            FROM fanned JOIN sellers USING (seller_id) GROUP BY state""",
        "top_products": f"""
            SELECT product_id, category, count(DISTINCT order_id) AS times_ordered,
              {N} AS total_units_sold, {money(SUM)} AS total_revenue,
              {mean_money('sum(price_c)', N)} AS avg_price, {review} AS avg_review,
              dense_rank() OVER (ORDER BY {SUM} DESC) AS product_rank
            FROM fanned JOIN products USING (product_id) GROUP BY product_id, category
            ORDER BY {SUM} DESC, product_id LIMIT 30""",
    }


def _exploration() -> dict[str, str]:
    hours = ", ".join(
        f"count(*) FILTER (hour(bought) = {h}) AS hour_{h}" for h in range(24)
    )
    return {
        "monthly_revenue": f"""
            SELECT month AS order_month, count(DISTINCT order_id) AS total_orders,
              {money(SUM)} AS revenue FROM sales GROUP BY month""",
        "order_status_counts": f"""
            SELECT status AS order_status, {N} AS order_count FROM facts GROUP BY status""",
        "top_categories_revenue": f"""
            SELECT category, {money(SUM)} AS revenue FROM sales JOIN products USING (product_id)
            GROUP BY category ORDER BY {SUM} DESC, category LIMIT 10""",
        "payment_type_share": f"""
            SELECT kind AS payment_type, {N} AS payment_count,
              {pct(N, '(SELECT count(*) FROM payments)', 1)} AS pct,
              (SELECT count(*) FROM payments) AS all_payments
            FROM payments GROUP BY kind""",
        "review_score_mean": f"""
            SELECT {whole('score')} AS review_score, {N} AS review_count,
              {pct(N, '(SELECT count(*) FROM reviews)', 1)} AS pct,
              (SELECT {ratio('sum(score)', N, 2)} FROM reviews) AS mean_score
            FROM reviews GROUP BY score""",
        "delivery_box_by_state": f"""
            , timed AS (
              SELECT state, CAST(days AS DOUBLE) AS days
              FROM done JOIN customers USING (customer_id) WHERE days BETWEEN 0 AND 60),
            top AS (
              SELECT state FROM timed GROUP BY state ORDER BY count(*) DESC, state LIMIT 10),
            kept AS (SELECT timed.* FROM timed JOIN top USING (state)),
            cuts AS (
              SELECT state, {N} AS n, quantile_cont(days, 0.25) AS q1,
                quantile_cont(days, 0.5) AS median, quantile_cont(days, 0.75) AS q3
              FROM kept GROUP BY state),
            marked AS (
              SELECT *, days BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1) AS inside
              FROM kept JOIN cuts USING (state))
            SELECT state AS customer_state, n, q1, median, q3,
              min(days) FILTER (inside) AS whisker_low, max(days) FILTER (inside) AS whisker_high,
              count(*) FILTER (NOT inside) AS outliers,
              (SELECT quantile_cont(days, 0.5) FROM kept) AS overall_median
            FROM marked GROUP BY state, n, q1, median, q3""",
        "state_revenue_top10": f"""
            SELECT state AS customer_state, {money(SUM)} AS revenue,
              count(DISTINCT order_id) AS orders
            FROM sales JOIN customers USING (customer_id)
            GROUP BY state ORDER BY {SUM} DESC, state LIMIT 10""",
        "order_heatmap": f"SELECT dayname(bought) AS day_name, {hours} FROM done GROUP BY 1",
    }


def _cohorts() -> dict[str, str]:
    share = "CAST(active AS DOUBLE) / size * 100"
    curve = f"""curve AS (
        SELECT age, round(avg(active * 100.0 / size), 6) AS mean_pct
        FROM grid WHERE age <= 12 GROUP BY age)"""
    rounded = ratio("active", "size", 1, 2)
    months = ", ".join(
        f"max(CASE WHEN age = {a} AND p <> 0 THEN p END) AS month_{a}" for a in range(13)
    )

    def after(age: int) -> str:
        return (
            f"coalesce((SELECT mean_pct FROM curve WHERE age = {age}), 0) "
            f"AS month_{age}_retention"
        )

    return {
        "cohort_orders": """
            SELECT person AS customer_unique_id, cohort AS cohort_month, month AS order_month
            FROM visits""",
        "retention_counts": """
            SELECT cohort AS cohort_month, age AS months_since_first, active AS active_customers
            FROM grid""",
        "retention_counts_wide": """
            SELECT cohort AS cohort_month, string_agg(CAST(active AS VARCHAR), ',' ORDER BY age) AS counts
            FROM grid GROUP BY cohort""",
        "retention_matrix": f"""
            SELECT cohort AS cohort_month, age AS months_since_first,
              round({share}, 6) AS retention_pct FROM grid""",
        "retention_heatmap": f"""
            , shown AS (
              SELECT cohort, size, age, {rounded} AS p FROM grid WHERE size >= 50 AND age <= 12)
            SELECT cohort AS cohort_month, size AS cohort_size, {months}
            FROM shown GROUP BY cohort, size""",
        "cohort_sizes": "SELECT cohort AS cohort_month, size AS customers FROM cohort_base",
        "retention_curve": f"""
            , {curve} SELECT age AS months_since_first, mean_pct AS avg_retention_pct FROM curve""",
        "retention_curve_observed": """
            SELECT age AS months_since_first, round(avg(active * 100.0 / size), 6)
              AS avg_retention_pct FROM grid WHERE active > 0 GROUP BY age""",
        "cohort_insights": f"""
            , {curve}
            SELECT {whole('sum(size)')} AS total_customers, {N} AS cohorts,
              (SELECT cohort FROM cohort_base ORDER BY size DESC, cohort LIMIT 1)
                AS largest_cohort,
              max(size) AS largest_size,
              (SELECT cohort FROM cohort_base ORDER BY size, cohort LIMIT 1) AS smallest_cohort,
              min(size) AS smallest_size, {after(1)}, {after(3)}, {after(6)}
            FROM cohort_base""",
    }


VALUES = {
    "delivery_days_actual": "days",
    "delivery_delta_days": "early",
    "freight_value": "freight_c",
    "price": "price_c",
    "review_score": "score",
    "product_weight_g": "grams",
}


def _matrix(source: str, names: dict[str, str]) -> str:
    cells = " UNION ALL ".join(
        f"SELECT '{x}' AS x, '{y}' AS y, round(corr({a}, {b}), 8) AS r FROM {source}"
        for x, a in names.items()
        for y, b in names.items()
    )
    return cells


def _average_rank(column: str) -> str:
    return (
        f"rank() OVER (ORDER BY {column}) + (count(*) OVER (PARTITION BY {column}) - 1) / 2.0"
        f" AS {column}_rank"
    )


def _correlation() -> dict[str, str]:
    complete = """, complete AS (
        SELECT days, early, freight_c, price_c, score, grams FROM studied
        WHERE early IS NOT NULL AND grams IS NOT NULL)"""
    ranks = ", ".join(_average_rank(c) for c in VALUES.values())
    side = """SELECT count(*) AS n, avg(score) AS mean, var_samp(score) AS var
        FROM studied WHERE late = """
    t_of_r = "r * sqrt((n - 2) / (1 - r * r))"
    freedom = "((v0 + v1) * (v0 + v1) / (v0 * v0 / (n0 - 1) + v1 * v1 / (n1 - 1)))"
    names = {0: "Very Late (5+ days)", 1: "Slightly Late (1-5 days)", 2: "On Time"}
    names |= {3: "Early (1-9 days)", 4: "Very Early (10+ days)"}
    cut = (
        f"CASE WHEN early > -999 AND early <= -5 THEN '{names[0]}' WHEN early > -5 AND early <= -1 "
        f"THEN '{names[1]}' WHEN early > -1 AND early <= 0 THEN '{names[2]}' "
        f"WHEN early > 0 AND early <= 9 THEN '{names[3]}' "
        f"WHEN early > 9 AND early <= 999 THEN '{names[4]}' END"
    )
    box = """, cuts AS (
          SELECT g, count(*) AS n, quantile_cont(score, 0.25) AS q1,
            quantile_cont(score, 0.5) AS median, quantile_cont(score, 0.75) AS q3,
            sum(score) AS total FROM grouped GROUP BY g),
        marked AS (
          SELECT *, score BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1) AS inside
          FROM grouped JOIN cuts USING (g))"""
    return {
        "analysis_base": f"""
            SELECT order_id, days AS delivery_days_actual, promised_days AS delivery_days_estimated,
              early AS delivery_delta_days, late AS is_late_delivery, {whole('score')}
              AS review_score, {money('price_c')} AS price, {money('freight_c')} AS freight_value,
              {money('total_c')} AS total_value, grams AS product_weight_g, category,
              state AS customer_state FROM studied""",
        "pearson_matrix": f"{complete} {_matrix('complete', VALUES)}",
        "spearman_matrix": f"""{complete}, ranked AS (SELECT {ranks} FROM complete)
            {_matrix('ranked', {k: f'{v}_rank' for k, v in VALUES.items()})}""",
        "welch_late_vs_ontime": f"""
            , a AS ({side} 0), b AS ({side} 1),
            w AS (SELECT a.n AS n0, a.mean AS m0, a.var AS s0, b.n AS n1, b.mean AS m1, b.var AS s1,
              a.var / a.n AS v0, b.var / b.n AS v1 FROM a CROSS JOIN b),
            d AS (SELECT *, (m0 - m1) / sqrt((s0 + s1) / 2) AS d FROM w)
            SELECT n0 AS ontime_n, round(m0, 8) AS ontime_mean, round(sqrt(s0), 8) AS ontime_std,
              n1 AS late_n, round(m1, 8) AS late_mean, round(sqrt(s1), 8) AS late_std,
              round((m0 - m1) / sqrt(v0 + v1), 6) AS t_stat,
              round({freedom}, 4) AS df,
              {tested('(m0 - m1) / sqrt(v0 + v1)', freedom)}, round(d, 8) AS cohens_d,
              CASE WHEN abs(d) < 0.5 THEN 'Small' WHEN abs(d) < 0.8 THEN 'Medium'
                ELSE 'Large' END AS effect
            FROM d""",
        "spearman_freight_review": f"""
            , ranked AS (SELECT {_average_rank('freight_c')}, {_average_rank('score')} FROM studied),
            found AS (SELECT count(*) AS n, corr(freight_c_rank, score_rank) AS r FROM ranked)
            SELECT n, round(r, 8) AS r, round({t_of_r}, 6) AS t_stat, n - 2 AS df,
              {tested(t_of_r, 'n - 2')} FROM found""",
        "pearson_weight_delivery": f"""
            , found AS (SELECT count(*) AS n, corr(grams, days) AS r FROM studied
              WHERE grams IS NOT NULL)
            SELECT n, round(r, 8) AS r, round({t_of_r}, 6) AS t_stat, n - 2 AS df,
              {tested(t_of_r, 'n - 2')} FROM found""",
        "weight_delivery_regression": """
            , fit AS (
              SELECT regr_slope(days, grams / 1000.0) AS slope,
                regr_intercept(days, grams / 1000.0) AS intercept,
                CAST(max(grams) AS DOUBLE) / 1000 AS top
              FROM studied WHERE grams IS NOT NULL),
            points AS (SELECT fit.*, point, point * (top / 99) AS kg
              FROM fit CROSS JOIN (SELECT unnest(range(100)) AS point))
            SELECT point, round(kg, 8) AS weight_kg, round(intercept + slope * kg, 8)
              AS delivery_days, round(slope, 8) AS slope, round(intercept, 8) AS intercept
            FROM points""",
        "scatter_sample": """
            , numbered AS (
              SELECT grams, days, count(*) OVER () AS total,
                row_number() OVER (ORDER BY order_id, line, product_id, review_id) - 1 AS place
              FROM studied WHERE grams IS NOT NULL),
            stretches AS (
              SELECT j, (j * total) // 5000 AS first, ((j + 1) * total) // 5000 AS after
              FROM (SELECT unnest(range(5000)) AS j), (SELECT max(total) AS total FROM numbered))
            SELECT CAST(grams AS DOUBLE) / 1000 AS weight_kg, days AS delivery_days_actual
            FROM numbered JOIN stretches
              ON after > first AND place = first + (j * 2654435761 % 4294967296) % (after - first)""",
        "delivery_bucket_review_stats": f"""
            , grouped AS (SELECT {cut} AS g, CAST(score AS DOUBLE) AS score FROM studied
              WHERE {cut} IS NOT NULL){box}
            SELECT g AS delivery_bucket, n, q1, median, q3,
              min(score) FILTER (inside) AS whisker_low, max(score) FILTER (inside) AS whisker_high,
              count(*) FILTER (NOT inside) AS outliers,
              {ratio('total', 'n', 2)} AS mean_score
            FROM marked GROUP BY g, n, q1, median, q3, total""",
        "review_histogram": """
            , grouped AS (SELECT CASE late WHEN 1 THEN 'Late' ELSE 'On Time' END AS g, score
              FROM studied),
            ends AS (SELECT g, count(*) AS n, min(score) AS low,
              (max(score) - min(score)) / 5.0 AS width FROM grouped GROUP BY g),
            binned AS (SELECT g, least(CAST(floor((score - low) / width) AS BIGINT), 4) AS bin,
              count(*) AS c FROM grouped JOIN ends USING (g) GROUP BY 1, 2)
            SELECT e.g AS delivery, b.bin, round(low + b.bin * width, 8) AS bin_start,
              coalesce(c, 0) AS "rows", round(coalesce(c, 0) / (n * width), 8) AS density
            FROM ends e CROSS JOIN (SELECT unnest(range(5)) AS bin) b
              LEFT JOIN binned x ON x.g = e.g AND x.bin = b.bin""",
    }


def p_value(t: str, df: str) -> str:
    """Two-sided p-value of Student's t: the continued fraction of the incomplete beta function, its
    convergents carried through a list of terms."""
    near = f"(({t}) * ({t}) < ({df}) AND abs({t}) < 4)"
    x, y = f"(({df}) / (({df}) + ({t}) * ({t})))", f"(({t}) * ({t}) / (({df}) + ({t}) * ({t})))"
    a, b = f"(CASE WHEN {near} THEN 0.5 ELSE ({df}) / 2.0 END)", f"(CASE WHEN {near} THEN ({df}) / 2.0 ELSE 0.5 END)"
    at, co = f"(CASE WHEN {near} THEN {y} ELSE {x} END)", f"(CASE WHEN {near} THEN {x} ELSE {y} END)"
    names = ("j", "a", "b", "x", "now", "before", "scale")

    def state(*values: str) -> str:
        return "{" + ", ".join(f"'{n}': CAST({v} AS DOUBLE)" for n, v in zip(names, values, strict=True)) + "}"

    j, m = "e.j", "floor(e.j / 2)"
    odd = f"(-(h.a + {m}) * (h.a + h.b + {m}) * h.x / ((h.a + 2 * {m}) * (h.a + 2 * {m} + 1)))"
    even = f"({m} * (h.b - {m}) * h.x / ((h.a + 2 * {m} - 1) * (h.a + 2 * {m})))"
    term = f"(CASE WHEN {j} % 2 = 1 THEN {odd} ELSE {even} END)"
    under = f"(1 + {term} * h.scale)"
    turn = state(j, "h.a", "h.b", "h.x", f"(h.now + {term} * h.before) / {under}", f"h.now / {under}", f"1 / {under}")
    terms = f"list_transform(range(1, CAST(200 + 20 * sqrt({df}) AS BIGINT)), lambda j: {state('j', *['0'] * 6)})"
    fraction = f"(list_reduce(list_prepend({state('0', a, b, at, '1', '1', '0')}, {terms}), lambda h, e: {turn})).now"
    beta = f"(lgamma(({df}) / 2.0) + lgamma(0.5) - lgamma(({df}) / 2.0 + 0.5))"
    found = f"(exp({a} * ln({at}) + {b} * ln({co}) - {beta}) / ({a} * {fraction}))"
    return f"(CASE WHEN {near} THEN 1 - {found} ELSE {found} END)"


def tested(t: str, df: str) -> str:
    """p_value, significance and decision."""
    p = p_value(t, df)
    return f"""round({p}, 8) AS p_value,
              CASE WHEN {p} < 0.001 THEN '*** (p < 0.001)' WHEN {p} < 0.01 THEN '** (p < 0.01)'
                WHEN {p} < 0.05 THEN '* (p < 0.05)' ELSE 'ns (not significant)' END AS significance,
              CASE WHEN {p} < 0.05 THEN 'REJECT' ELSE 'FAIL TO REJECT' END AS decision"""


def _marts() -> dict[str, str]:
    review = ratio("sum(score)", "count(score)", 2)
    everyone = "(SELECT count(*) FROM segments)"
    all_c, all_orders = "(SELECT sum(spend_c) FROM segments)", "(SELECT sum(orders) FROM segments)"
    timing = f"""{N} AS deliveries, {ratio('sum(days)', N, 1)} AS avg_delivery_days,
        {pct('sum(late)', N)} AS late_pct, {pct(f'({N} - sum(late))', N)} AS on_time_pct,
        CAST(NULL AS DOUBLE) AS avg_review"""
    return {
        "mart_revenue_overview": f"""
            , lead AS (
              SELECT category, count(DISTINCT order_id) AS n, {SUM} AS c
              FROM sales JOIN products USING (product_id) GROUP BY category
              ORDER BY c DESC, category LIMIT 10)
            SELECT 'total' AS section, 'all' AS name, count(DISTINCT order_id) AS orders,
              {money(SUM)} AS revenue, {mean_money(SUM, 'count(DISTINCT order_id)')}
              AS avg_order_value FROM sales
            UNION ALL SELECT 'category', category, n, {money('c')}, {mean_money('c', 'n')}
            FROM lead""",
        "mart_customer_segments": f"""
            SELECT segment AS customer_segment, {N} AS customer_count,
              {pct(N, everyone)} AS customer_pct, {money('sum(spend_c)')} AS revenue,
              {pct('sum(spend_c)', all_c)} AS revenue_pct,
              {ratio('sum(orders)', N, 2)} AS avg_orders,
              {ratio(f'({all_orders} - sum(orders))', f'({everyone} - {N})', 2)}
                AS rest_avg_orders,
              {mean_money('sum(spend_c)', N)} AS avg_spend,
              {mean_money(f'({all_c} - sum(spend_c))', f'({everyone} - {N})')} AS rest_avg_spend
            FROM segments GROUP BY segment""",
        "mart_delivery": f"""
            SELECT 'state' AS section, state AS name, {timing}
            FROM done JOIN customers USING (customer_id) WHERE days IS NOT NULL GROUP BY state
            UNION ALL SELECT 'overall', 'all', {timing} FROM done WHERE days IS NOT NULL
            UNION ALL SELECT 'speed', {BUCKET.format(d='early')}, {N}, NULL, NULL, NULL,
              {ratio('sum(score)', N, 2)}
            FROM done JOIN reviews USING (order_id) WHERE early IS NOT NULL GROUP BY 2""",
        "mart_product_seller": f"""
            , per_seller AS (SELECT seller_id, {SUM} AS c FROM fanned GROUP BY seller_id),
            best AS (SELECT c FROM per_seller ORDER BY c DESC, seller_id LIMIT 5)
            SELECT 'market' AS section, 'all' AS name, count(DISTINCT seller_id) AS sellers,
              {money(SUM)} AS revenue, {pct('(SELECT sum(c) FROM best)', SUM)}
              AS leaders_share_pct, {mean_money('sum(price_c)', N)} AS avg_price,
              {mean_money('sum(freight_c)', N)} AS avg_freight, {review} AS avg_review
            FROM fanned
            UNION ALL SELECT 'category', category, NULL, {money(SUM)}, NULL,
              {mean_money('sum(price_c)', N)}, {mean_money('sum(freight_c)', N)}, {review}
            FROM fanned JOIN products USING (product_id) GROUP BY category""",
        "state_concentration": f"""
            , top AS (
              SELECT state, {SUM} AS c FROM sales JOIN customers USING (customer_id)
              GROUP BY state ORDER BY c DESC, state LIMIT 10)
            SELECT max_by(state, c) AS leading_state, {money('max(c)')} AS leading_revenue,
              {money('(sum(c) - max(c))')} AS rest_revenue,
              {pct('max(c)', '(sum(c) - max(c))')} AS leading_vs_rest_pct FROM top""",
    }


def _tables() -> dict[str, str]:
    counts = {
        "dim_customers": "customers",
        "dim_products": "products",
        "dim_sellers": "sellers",
        "dim_geolocation": "(SELECT DISTINCT zip FROM customers)",
        "fact_orders": "facts",
        "fact_order_items": "items",
        "fact_payments": "payments",
        "fact_reviews": "reviews",
    }
    loads = " UNION ALL ".join(
        f"SELECT '{t}' AS \"table\", {N} AS expected_rows, {N} AS actual_rows, 1 AS ok, "
        f"1 AS all_ok FROM {source}"
        for t, source in counts.items()
    )
    keys = {
        "dim_customers": ("customers", "customer_id"),
        "dim_products": ("products", "product_id"),
        "dim_sellers": ("sellers", "seller_id"),
        "dim_geolocation": ("(SELECT * FROM customers)", "zip"),
        "fact_orders": ("facts", "order_id"),
        "fact_reviews": ("written", "review_id"),
        "fact_order_items": ("(SELECT row_number() OVER () AS item_id FROM items)", "item_id"),
        "fact_payments": ("(SELECT row_number() OVER () AS payment_id FROM payments)", "payment_id"),
    }
    copies = " UNION ALL ".join(
        f"SELECT '{t}' AS \"table\", count(*) FILTER (key IS NOT NULL AND n > 1) "
        f"AS duplicate_keys, CAST(coalesce(sum(n - 1) FILTER (key IS NOT NULL), 0) AS BIGINT) "
        f"AS extra_rows, CAST(coalesce(sum(n) FILTER (key IS NULL), 0) AS BIGINT) AS null_keys "
        f"FROM (SELECT {key} AS key, count(*) AS n FROM {source} GROUP BY 1)"
        for t, (source, key) in keys.items()
    )
    links = (
        ("fact_orders", "facts", "customer_id", "dim_customers", "customers"),
        ("fact_order_items", "items", "order_id", "fact_orders", "facts"),
        ("fact_order_items", "items", "product_id", "dim_products", "products"),
        ("fact_order_items", "items", "seller_id", "dim_sellers", "sellers"),
        ("fact_payments", "payments", "order_id", "fact_orders", "facts"),
        ("fact_reviews", "reviews", "order_id", "fact_orders", "facts"),
    )
    orphans = " UNION ALL ".join(
        f"SELECT '{t}' AS \"table\", '{c}' AS \"column\", '{p}' AS parent, "
        f"count(DISTINCT {c}) AS orphan_keys, {N} AS orphan_rows "
        f"FROM {child} WHERE {c} IS NOT NULL AND {c} NOT IN (SELECT {c} FROM {parent})"
        for t, child, c, p, parent in links
    )
    item_columns = f"""order_id, line AS order_item_id, product_id, seller_id,
        {stamp('ship_by')} AS shipping_limit_date, {money('price_c')} AS price,
        {money('freight_c')} AS freight_value, {money('total_c')} AS total_value"""
    metric = "SELECT '{t}' AS \"table\", '{m}' AS metric, CAST({v} AS DOUBLE) AS value FROM {s}"
    report = " UNION ALL ".join(
        metric.format(t=t, m=m, v=v, s=s)
        for t, m, v, s in (
            ("dim_customers", "rows", N, "customers"),
            ("dim_products", "rows", N, "products"),
            ("dim_products", "categories", "count(DISTINCT category)", "products"),
            ("dim_sellers", "rows", N, "sellers"),
            ("dim_geolocation", "raw_rows", N, "customers"),
            ("dim_geolocation", "rows", "count(DISTINCT zip)", "customers"),
            ("fact_orders", "rows", N, "facts"),
            ("fact_orders", "delivered", "count(*) FILTER (status = 'delivered')", "facts"),
            ("fact_orders", "late", "sum(late)", "facts"),
            ("fact_order_items", "removed", "count(*) FILTER (price_c <= 0)", "lines"),
            ("fact_order_items", "rows", N, "items"),
            ("fact_order_items", "mean_total_value", mean_money(SUM, N), "items"),
            ("fact_payments", "rows", N, "payments"),
            ("fact_payments", "types", "count(DISTINCT kind)", "payments"),
            ("fact_reviews", "rows", N, "reviews"),
            ("fact_reviews", "mean_score", ratio("sum(score)", N, 2), "reviews"),
        )
    )
    # medians in millionths: latitude is cents * 100, longitude is -cents * 200
    middle = "quantile_cont(CAST(cents * {f} AS DOUBLE), 0.5)"
    micro = "CAST(sign({m}) * floor(abs({m}) + 0.5) AS DOUBLE) / 1000000"
    lat = micro.format(m=middle.format(f=100))
    lng = micro.format(m=middle.format(f=-200))
    return {
        "clean_customers": """
            SELECT customer_id, person AS customer_unique_id, city AS customer_city,
              state AS customer_state, zip AS customer_zip_prefix FROM customers""",
        "clean_products": """
            SELECT product_id, native AS product_category, category AS product_category_english,
              grams AS product_weight_g, CAST(size AS DOUBLE) AS product_length_cm,
              CAST(size AS DOUBLE) AS product_height_cm, CAST(size AS DOUBLE) AS product_width_cm,
              photos AS product_photos_qty, name_length AS product_name_length,
              name_length * 10 AS product_description_length FROM products""",
        "clean_sellers": """
            SELECT seller_id, city AS seller_city, state AS seller_state,
              zip AS seller_zip_prefix FROM sellers""",
        "clean_geolocation": f"""
            , spots AS (
              SELECT c_custkey AS k, CAST(c_custkey % 100 AS VARCHAR) AS zip,
                CAST(CAST(c_acctbal AS DECIMAL(12,2)) * 100 AS BIGINT) AS cents FROM customer),
            places AS (
              SELECT s.zip, {lat} AS lat, {lng} AS lng, min_by(c.city, k) AS city,
                min_by(upper(c.state), k) AS state
              FROM spots s JOIN customers c ON c.customer_id = CAST(k AS VARCHAR) GROUP BY s.zip)
            SELECT zip AS geolocation_zip_prefix, lat AS geolocation_lat, lng AS geolocation_lng,
              city AS geolocation_city, state AS geolocation_state FROM places""",
        "clean_orders": f"""
            SELECT order_id, customer_id, status AS order_status,
              {stamp('bought')} AS order_purchase_timestamp, {stamp('approved')}
              AS order_approved_at, {stamp('handed')} AS order_delivered_carrier_date,
              {stamp('arrived')} AS order_delivered_customer_date,
              {stamp('promised')} AS order_estimated_delivery_date,
              days AS delivery_days_actual, promised_days AS delivery_days_estimated,
              early AS delivery_delta_days, late AS is_late_delivery, month AS order_month
            FROM facts""",
        "clean_order_items": f"SELECT {item_columns} FROM items",
        "clean_payments": f"""
            SELECT order_id, place AS payment_sequential, kind AS payment_type,
              parts AS payment_installments, {money('value_c')} AS payment_value FROM payments""",
        "clean_reviews": f"""
            SELECT review_id, order_id, {whole('score')} AS review_score,
              CASE WHEN k % 3 = 0 THEN 'short note' ELSE '' END AS review_comment_title,
              CASE WHEN k % 4 = 0 THEN 'about order ' || order_id ELSE '' END
                AS review_comment_message,
              {stamp("date_trunc('day', bought) + to_days(30)")} AS review_creation_date,
              {stamp("date_trunc('day', bought) + to_days(32)")} AS review_answer_timestamp
            FROM reviews JOIN facts USING (order_id, k)""",
        "surrogate_keys": f"""
            SELECT {item_columns}, row_number() OVER (ORDER BY order_id, line, product_id,
              seller_id, ship_by, price_c, freight_c, total_c) AS item_id FROM items""",
        "surrogate_key_figures": f"""
            SELECT 'fact_order_items' AS "table", count(*) AS rows, 1 AS lowest, count(*) AS highest,
              count(*) AS numbers, {money('sum(total_c)')} AS value FROM items
            UNION ALL SELECT 'fact_payments', count(*), 1, count(*), count(*), {money('sum(value_c)')} FROM payments""",
        "append_rejects": """
            , sent AS (
              SELECT 'N' || order_id AS order_id, k,
                k % 3 = 0 OR customer_id NOT IN (SELECT customer_id FROM customers) AS bad
              FROM facts WHERE k % 10 = 1),
            taken AS (SELECT order_id FROM sent WHERE NOT bad),
            reasons AS (
              SELECT 'dim_customers' AS "table", 'duplicate key' AS reason, customer_id AS key FROM customers
              WHERE CAST(customer_id AS BIGINT) % 10 = 0
              UNION ALL SELECT 'fact_orders', 'duplicate key', order_id FROM facts WHERE k % 10 = 0
              UNION ALL SELECT 'fact_orders', 'duplicate key', order_id FROM sent WHERE k % 50 = 1
              UNION ALL SELECT 'fact_orders', 'no such dim_customers', order_id FROM sent WHERE bad
              UNION ALL SELECT 'fact_order_items', CASE
                  WHEN 'N' || order_id NOT IN (SELECT order_id FROM taken) THEN 'no such fact_orders'
                  WHEN line = 2 OR product_id NOT IN (SELECT product_id FROM products) THEN 'no such dim_products'
                  WHEN seller_id NOT IN (SELECT seller_id FROM sellers) THEN 'no such dim_sellers' END, NULL
              FROM items WHERE CAST(order_id AS BIGINT) % 10 = 1
              UNION ALL SELECT 'fact_reviews', 'no such fact_orders', 'N' || review_id FROM reviews
              WHERE k % 10 = 1 AND 'N' || order_id NOT IN (SELECT order_id FROM taken))
            SELECT "table", reason, count(*) AS rows, count(DISTINCT key) AS keys
            FROM reasons WHERE reason IS NOT NULL GROUP BY "table", reason""",
        "verify_load": loads,
        "pk_duplicates": copies,
        "fk_orphans": orphans,
        "cleaning_report": report,
    }


def statements() -> dict[str, str]:
    parts = (
        _tables(),
        _overview(),
        _revenue(),
        _customers(),
        _delivery(),
        _sellers(),
        _exploration(),
        _correlation(),
        _cohorts(),
        _marts(),
    )
    found = {name: query(body) for part in parts for name, body in part.items()}
    # the same reports, by way of CSV files or the stored star
    found["load_raw"] = found["revenue_waterfall"]
    found["stored_revenue_waterfall"] = found["revenue_waterfall"]
    found["stored_seller_performance"] = found["seller_performance"]
    effects = {  # query, test, method, statistic, effect
        "welch_late_vs_ontime": ("late delivery vs review score", "Welch''s t-test", "t_stat", "cohens_d"),
        "spearman_freight_review": ("freight value vs review score", "Spearman correlation", "r", "r"),
        "pearson_weight_delivery": ("product weight vs delivery time", "Pearson correlation", "r", "r"),
    }
    found["hypothesis_summary"] = " UNION ALL ".join(
        f"""SELECT '{test}' AS test, '{method}' AS method, round({statistic}, 6) AS statistic, p_value,
        {effect} AS effect, significance, decision FROM ({found[name]})"""
        for name, (test, method, statistic, effect) in effects.items()
    )
    found["sql_monthly_revenue"] = found["monthly_revenue"]
    found["bucketed_revenue_waterfall"] = found["revenue_waterfall"]
    found["bucketed_seller_performance"] = found["seller_performance"]
    return found
