from oracles.star import AS_OF, cents, half_up, per_hundred

_REVENUE = """
    FROM fact_order_line_items
    JOIN fact_sales_orders AS o USING (order_id)
    JOIN dim_customers AS c USING (customer_id)
    JOIN dim_regions AS r ON r.region_id = o.region_id"""

QUERIES = {
    "full_order_summary": (
        f"""SELECT order_id, customer_name, c.country_name, region_name, first_name, last_name, product_name,
                   quantity, unit_price, discount_amount, line_total
            {_REVENUE}
            JOIN dim_products USING (product_id)
            JOIN dim_sales_reps USING (sales_rep_id)""",
        "order_id# customer_name country_name region_name first_name last_name product_name quantity#"
        " unit_price$ discount_amount$ line_total$",
    ),
    "dormant_customers": (
        """FROM dim_customers
           WHERE NOT EXISTS (FROM fact_sales_orders AS o WHERE o.customer_id = dim_customers.customer_id)""",
        "customer_id# customer_name",
    ),
    "rep_customer_mismatch": (
        """FROM (SELECT order_id, customer_name, o.sales_rep_id AS order_rep, span.sales_rep_id AS assigned_rep
                 FROM fact_sales_orders AS o
                 JOIN dim_customers USING (customer_id)
                 JOIN dim_date AS placed ON placed.date_id = order_date_id
                 JOIN (SELECT a.*, begins.full_date AS starts,
                              coalesce(ends.full_date, DATE '9999-12-31') AS stops
                       FROM rep_customer_assignments AS a
                       JOIN dim_date AS begins ON begins.date_id = start_date_id
                       LEFT JOIN dim_date AS ends ON ends.date_id = end_date_id) AS span
                   ON span.customer_id = o.customer_id AND placed.full_date BETWEEN starts AND stops
                 QUALIFY row_number() OVER (PARTITION BY order_id
                                            ORDER BY starts DESC, stops DESC, assignment_id DESC) = 1)
           WHERE order_rep <> assigned_rep""",
        "order_id# customer_name order_rep# assigned_rep#",
    ),
    "geo_revenue_rollup": (
        f"""SELECT coalesce(c.country_name, 'ALL COUNTRIES') AS country_name,
                   coalesce(r.region_name, 'ALL REGIONS') AS region_name,
                   coalesce(r.territory_name, 'ALL TERRITORIES') AS territory_name,
                   sum(line_total) AS total_revenue
            {_REVENUE}
            GROUP BY ROLLUP (c.country_name, r.region_name, r.territory_name)""",
        "country_name region_name territory_name total_revenue$",
    ),
    "line_realised_profit": (
        """SELECT *, line_total AS actual_price, line_total - quantity * unit_cost AS profit
           FROM fact_order_line_items JOIN dim_products USING (product_id)""",
        "product_name quantity# unit_price$ discount_amount$ actual_price$ unit_cost$ profit$",
    ),
    "active_products_unordered_12m": (
        f"""FROM dim_products AS p WHERE is_active AND NOT EXISTS (
                FROM fact_order_line_items AS l
                JOIN fact_sales_orders USING (order_id)
                JOIN dim_date ON date_id = order_date_id
                WHERE l.product_id = p.product_id AND full_date >= {AS_OF} - INTERVAL 12 MONTH)""",
        "product_id# product_name",
    ),
    "revenue_customer_region_country": (
        f"""SELECT customer_name, r.country_name, sum(line_total) AS total_revenue {_REVENUE}
            GROUP BY ALL""",
        "customer_name country_name total_revenue$",
    ),
    "unit_price_vs_cost": (
        f"""SELECT *, {per_hundred(half_up(cents('line_total'), 'quantity'))} AS actual_unit_sell_price,
                   {per_hundred(half_up(cents('line_total - quantity * unit_cost'), 'quantity'))} AS unit_margin
            FROM fact_order_line_items
            JOIN dim_products USING (product_id)
            JOIN dim_categories USING (category_id)""",
        "line_item_id order_id# product_name sku# category_name quantity# unit_cost$"
        " actual_unit_sell_price$ unit_margin$",
    ),
    "customer_order_performance": (
        f"""SELECT customer_id, customer_name, c.country_name, region_name, first_name, last_name,
                   count(DISTINCT order_id) AS total_orders, sum(quantity) AS total_quantity_purchased,
                   sum(line_total) AS total_revenue
            {_REVENUE}
            JOIN dim_sales_reps USING (sales_rep_id)
            GROUP BY ALL""",
        "customer_id# customer_name country_name region_name first_name last_name total_orders#"
        " total_quantity_purchased# total_revenue$",
    ),
    # Unit values are whole numbers of 1e-14, the total is rounded to 1e-6.
    "returns_by_product_region": (
        f"""FROM (SELECT product_id, product_name, region_name, count(return_id) AS total_returns,
                         sum(return_quantity) AS total_returned_quantity,
                         sum({half_up(cents('line_total') + ' * 1000000000000', 'quantity')} * return_quantity)
                             AS value
                  FROM fact_returns
                  JOIN fact_order_line_items USING (line_item_id)
                  JOIN dim_products USING (product_id)
                  JOIN fact_sales_orders USING (order_id)
                  JOIN dim_regions USING (region_id)
                  GROUP BY ALL)
            SELECT *, CAST({half_up('CAST(value AS HUGEINT)', '100000000')} AS DOUBLE) / 1000000
                   AS estimated_return_value""",
        "product_id# product_name region_name total_returns# total_returned_quantity# estimated_return_value$",
    ),
}
