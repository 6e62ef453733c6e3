from oracles.star import AS_OF, cents, half_up, pct2, per_hundred

_LAST_FULL_YEAR = f"(SELECT max(year_num) FROM dim_date WHERE year_num < year({AS_OF}))"

_REP_QUARTER = """
    SELECT year_num, quarter_num, sales_rep_id, first_name, last_name, sum(line_total) AS net_revenue
    FROM fact_order_line_items
    JOIN fact_sales_orders USING (order_id)
    JOIN dim_sales_reps USING (sales_rep_id)
    JOIN dim_date ON date_id = order_date_id
    GROUP BY ALL"""

# Units per unit of money in 10^14ths, an integer for each line; a product's unit cost in cents times their
# sum is what its lines cost per unit of money, in 10^16ths. `margin` is in 10^12ths of a percent.
_MARGINS = f"""
    SELECT category_id,
           100 * 1000000000000 - {half_up('sum(cents * units_per_money)', 'count(units_per_money) * 100')} AS margin
    FROM (SELECT product_id, {half_up('quantity::HUGEINT * 10000000000000000', cents('line_total'))} AS units_per_money
          FROM fact_order_line_items)
    JOIN (SELECT product_id, category_id, {cents('unit_cost')} AS cents FROM dim_products) USING (product_id)
    WHERE cents IS NOT NULL
    GROUP BY ALL"""
_MARGIN_PCT = per_hundred(half_up("margin", "10000000000"))

_ATTAINMENT = (
    "sales_rep_id# first_name last_name year_num# month_num# actual_revenue$ total_quota_target#"
    " quota_attainment_pct$"
)

QUERIES = {
    "gross_rev_month_customer_country": (
        """SELECT year_num, month_num, country_name, sum(quantity * unit_price) AS gross_revenue
           FROM fact_order_line_items
           JOIN fact_sales_orders USING (order_id)
           JOIN dim_customers USING (customer_id)
           JOIN dim_date ON date_id = order_date_id
           GROUP BY ALL""",
        "year_num# month_num# country_name gross_revenue$",
    ),
    "net_rev_by_quarter": (
        """SELECT quarter_num, sum(quantity * unit_price - discount_amount) AS net_revenue
           FROM fact_order_line_items
           JOIN fact_sales_orders USING (order_id)
           JOIN dim_date ON date_id = order_date_id
           GROUP BY ALL""",
        "quarter_num# net_revenue$",
    ),
    "product_gross_margin": (
        f"""FROM (SELECT product_id, product_name, sum(line_total) AS total_revenue,
                         sum(quantity * unit_cost) AS total_cost,
                         sum(line_total - quantity * unit_cost) AS gross_profit
                  FROM fact_order_line_items JOIN dim_products USING (product_id) GROUP BY ALL)
            SELECT *, {pct2('gross_profit', 'total_revenue')} AS gross_margin_pct""",
        "product_id# product_name total_revenue$ total_cost$ gross_profit$ gross_margin_pct$",
    ),
    "quota_attainment_monthly": (
        f"""FROM (SELECT sales_rep_id, first_name, last_name, d.year_num, d.month_num,
                         sum(net_total) AS actual_revenue, sum(quota_target) AS total_quota_target
                  FROM fact_sales_orders
                  JOIN dim_date AS d ON d.date_id = order_date_id
                  JOIN dim_sales_reps USING (sales_rep_id)
                  JOIN fact_quotas AS q USING (sales_rep_id)
                  JOIN dim_date AS starts ON starts.date_id = q.date_id
                   AND starts.year_num = d.year_num AND starts.month_num = d.month_num
                  WHERE quota_period_type = 'Monthly'
                  GROUP BY ALL)
            SELECT *, {pct2('actual_revenue', 'total_quota_target')} AS quota_attainment_pct""",
        _ATTAINMENT,
    ),
    "quota_attainment_once": (
        f"""FROM (SELECT sales_rep_id, year_num, month_num, sum(net_total) AS actual_revenue
                  FROM fact_sales_orders JOIN dim_date ON date_id = order_date_id GROUP BY ALL)
            JOIN (SELECT sales_rep_id, year_num, month_num, sum(quota_target) AS total_quota_target
                  FROM fact_quotas JOIN dim_date USING (date_id)
                  WHERE quota_period_type = 'Monthly' GROUP BY ALL)
                USING (sales_rep_id, year_num, month_num)
            JOIN dim_sales_reps USING (sales_rep_id)
            SELECT *, {pct2('actual_revenue', 'total_quota_target')} AS quota_attainment_pct""",
        _ATTAINMENT,
    ),
    "rep_quarter_high_revenue": (
        f"FROM ({_REP_QUARTER}) WHERE net_revenue > 50000",
        "year_num# quarter_num# sales_rep_id# first_name last_name net_revenue$",
    ),
    "rep_quarter_below_quota": (
        f"""FROM ({_REP_QUARTER})
            JOIN (SELECT sales_rep_id, year_num, quarter_num, sum(quota_target) AS quota_target
                  FROM fact_quotas JOIN dim_date USING (date_id)
                  WHERE quota_period_type = 'Quarterly' GROUP BY ALL)
                USING (sales_rep_id, year_num, quarter_num)
            SELECT *, {pct2('net_revenue', 'quota_target')} AS quota_attainment_pct
            WHERE net_revenue > 500000 AND net_revenue * 100 < quota_target * 80""",
        "year_num# quarter_num# sales_rep_id# first_name last_name net_revenue$ quota_target#"
        " quota_attainment_pct$",
    ),
    "low_margin_categories": (
        f"FROM ({_MARGINS}) SELECT category_id, {_MARGIN_PCT} AS avg_gross_margin_pct WHERE margin < 25000000000000",
        "category_id# avg_gross_margin_pct$",
    ),
    "low_margin_high_return_categories": (
        f"""FROM ({_MARGINS})
            JOIN (SELECT category_id, sum(quantity) AS units, coalesce(sum(back), 0) AS returned
                  FROM fact_order_line_items
                  JOIN dim_products USING (product_id)
                  LEFT JOIN (SELECT line_item_id, sum(return_quantity) AS back FROM fact_returns GROUP BY ALL)
                      USING (line_item_id)
                  GROUP BY ALL) USING (category_id)
            SELECT category_id, {_MARGIN_PCT} AS avg_gross_margin_pct,
                   {per_hundred(half_up('returned * 10000', 'units'))} AS return_rate_pct
            WHERE margin < 25000000000000 AND returned * 1000 > units * 26""",
        "category_id# avg_gross_margin_pct$ return_rate_pct$",
    ),
    "frequent_low_value_customers": (
        f"""FROM (SELECT customer_id, customer_name, count(DISTINCT order_id) AS total_orders,
                         sum(line_total) AS revenue
                  FROM fact_order_line_items
                  JOIN fact_sales_orders USING (order_id)
                  JOIN dim_customers USING (customer_id)
                  JOIN dim_date ON date_id = order_date_id
                  WHERE year_num = {_LAST_FULL_YEAR}
                  GROUP BY ALL)
            SELECT *, {per_hundred(half_up(cents('revenue'), 'total_orders'))} AS average_order_value
            WHERE total_orders > 3 AND revenue < 150000 * total_orders""",
        "customer_id# customer_name total_orders# average_order_value$",
    ),
}
