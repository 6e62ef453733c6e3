from oracles.star import over, pct2

_TODAY = "(SELECT max(full_date) FROM dim_date)"

_SEGMENT_COLUMNS = (
    "customer_id# customer_name last_order_date@ recency_days# frequency_orders# monetary_value$ rfm_segment"
)


def _yearly_segments(champions: tuple[int, int], loyal: tuple[int, int], at_risk: int) -> str:
    """The year's customers; each limit is a least number of orders, with a least value."""
    return f"""
        FROM (SELECT customer_id, customer_name, max(full_date) AS last_order_date,
                     {_TODAY} - last_order_date AS recency_days, count(order_id) AS frequency_orders,
                     sum(net_total) AS monetary_value
              FROM fact_sales_orders
              JOIN dim_customers USING (customer_id)
              JOIN dim_date ON date_id = order_date_id
              WHERE full_date >= {_TODAY} - INTERVAL 1 YEAR
              GROUP BY ALL)
        SELECT *, CASE
            WHEN recency_days <= 30 AND frequency_orders >= {champions[0]} AND monetary_value >= {champions[1]}
                THEN 'Champions'
            WHEN recency_days <= 90 AND frequency_orders >= {loyal[0]} AND monetary_value >= {loyal[1]} THEN 'Loyal'
            WHEN recency_days > 180 AND frequency_orders >= {at_risk} THEN 'At Risk'
            WHEN recency_days > 365 THEN 'Lost'
            ELSE 'New' END AS rfm_segment"""


QUERIES = {
    "top_customer_per_country": (
        """SELECT customer_id, customer_name, country_name, account_tier, sum(net_total) AS total_revenue
           FROM fact_sales_orders
           JOIN dim_customers USING (customer_id)
           JOIN dim_date ON date_id = order_date_id
           WHERE year_num = (SELECT max(year_num) FROM dim_date)
           GROUP BY customer_id, customer_name, country_name, account_tier
           QUALIFY row_number() OVER (PARTITION BY country_name ORDER BY sum(net_total) DESC, customer_id) = 1""",
        "customer_id# customer_name country_name account_tier total_revenue$",
    ),
    "country_mom_change": (
        f"""FROM (SELECT *, lag(monthly_net_revenue) OVER months AS previous_month_revenue,
                         monthly_net_revenue - previous_month_revenue AS revenue_change
                  FROM (SELECT country_name, year_num, month_num, sum(net_total) AS monthly_net_revenue
                        FROM fact_sales_orders
                        JOIN dim_regions USING (region_id)
                        JOIN dim_date ON date_id = order_date_id
                        GROUP BY ALL)
                  WINDOW months AS (PARTITION BY country_name ORDER BY year_num, month_num))
            SELECT *, {pct2('revenue_change', 'previous_month_revenue')} AS revenue_change_pct""",
        "country_name year_num# month_num# monthly_net_revenue$ previous_month_revenue$ revenue_change$"
        " revenue_change_pct$",
    ),
    "quarter_running_total": (
        """SELECT *, sum(net_total) OVER (
                      PARTITION BY region_name, year_num, quarter_num ORDER BY full_date, order_id
                      ROWS UNBOUNDED PRECEDING) AS running_quarter_revenue
           FROM fact_sales_orders
           JOIN dim_regions USING (region_id)
           JOIN dim_date ON date_id = order_date_id""",
        "order_id# region_name year_num# quarter_num# full_date@ net_total$ running_quarter_revenue$",
    ),
    "rep_rank_in_region": (
        f"""FROM (SELECT sales_rep_id, first_name, last_name, s.region_id, region_name, year_num, quarter_num,
                         sum(net_total) AS actual_revenue
                  FROM fact_sales_orders AS o
                  JOIN dim_sales_reps AS s USING (sales_rep_id)
                  JOIN dim_regions AS r ON r.region_id = s.region_id
                  JOIN dim_date ON date_id = order_date_id
                  GROUP BY ALL) AS sold
            JOIN (SELECT sales_rep_id, region_id, year_num, quarter_num, sum(quota_target) AS quota_target
                  FROM fact_quotas JOIN dim_date USING (date_id) GROUP BY ALL) AS due
                USING (sales_rep_id, region_id, year_num, quarter_num)
            SELECT *, {pct2('actual_revenue', 'quota_target')} AS quota_attainment_pct,
                   rank() OVER (PARTITION BY region_name, year_num, quarter_num
                                ORDER BY {over('actual_revenue', 'quota_target')} DESC NULLS LAST)
                       AS rep_rank_in_region""",
        "sales_rep_id# first_name last_name region_name year_num# quarter_num# actual_revenue$ quota_target#"
        " quota_attainment_pct$ rep_rank_in_region#",
    ),
    "customer_rfm_1y": (_yearly_segments((2, 400000), (2, 200000), 2), _SEGMENT_COLUMNS),
    "customer_rfm_1y_default": (_yearly_segments((20, 70000), (10, 30000), 10), _SEGMENT_COLUMNS),
    "products_never_in_high_rev_regions": (
        f"""FROM dim_products AS p WHERE product_id NOT IN (
                SELECT product_id FROM fact_order_line_items
                JOIN fact_sales_orders AS o USING (order_id)
                WHERE region_id IN (
                    SELECT region_id FROM fact_sales_orders JOIN dim_date ON date_id = order_date_id
                    WHERE full_date >= {_TODAY} - INTERVAL 1 YEAR
                    GROUP BY region_id HAVING sum(net_total) > 24000000))""",
        "product_id# product_name category_id#",
    ),
    "customer_qoq_decline": (
        """FROM (SELECT *, lag(order_count) OVER quarters AS previous_quarter_order_count,
                        lag(quarter_revenue) OVER quarters AS previous_quarter_revenue,
                        order_count - previous_quarter_order_count AS order_count_change,
                        quarter_revenue - previous_quarter_revenue AS revenue_change
                 FROM (SELECT customer_id, customer_name, account_tier, year_num, quarter_num,
                              count(DISTINCT order_id) AS order_count, sum(net_total) AS quarter_revenue
                       FROM fact_sales_orders
                       JOIN dim_customers USING (customer_id)
                       JOIN dim_date ON date_id = order_date_id
                       GROUP BY ALL)
                 WINDOW quarters AS (PARTITION BY customer_id ORDER BY year_num, quarter_num))
           WHERE order_count_change < 0 OR revenue_change < 0""",
        "customer_id# customer_name account_tier year_num# quarter_num# order_count#"
        " previous_quarter_order_count# quarter_revenue$ previous_quarter_revenue$ order_count_change#"
        " revenue_change$",
    ),
    "products_of_high_value_customers": (
        """FROM (SELECT product_id, product_name, sum(quantity) AS total_quantity_sold,
                        sum(line_total) AS total_revenue
                 FROM fact_order_line_items
                 JOIN fact_sales_orders USING (order_id)
                 JOIN dim_products USING (product_id)
                 WHERE customer_id IN (
                     FROM (SELECT customer_id, sum(net_total) AS spent FROM fact_sales_orders GROUP BY ALL)
                     SELECT customer_id QUALIFY spent * count(*) OVER () > sum(spent) OVER ())
                 GROUP BY ALL)
           SELECT *, row_number() OVER (
               ORDER BY total_quantity_sold DESC, total_revenue DESC, product_name, product_id) AS product_rank""",
        "product_rank# product_id# product_name total_quantity_sold# total_revenue$",
    ),
}
