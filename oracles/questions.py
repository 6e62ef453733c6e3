from oracles.star import AS_OF, pct

_REP = "sales_rep_id# first_name last_name email"

QUERIES = {
    "gold_customers_by_country": (
        """FROM dim_customers
           WHERE account_tier = 'Gold' AND country_name = 'NATION_7' AND credit_limit > 5000""",
        "customer_name country_name account_tier credit_limit$",
    ),
    "open_orders_q3_last_full_year": (
        f"""SELECT customer_name, full_date AS order_date, net_total AS total_value
            FROM fact_sales_orders
            JOIN dim_customers USING (customer_id)
            JOIN dim_date ON date_id = order_date_id
            WHERE order_status IN ('Pending', 'Partially Delivered') AND quarter_num = 3
              AND year_num = (SELECT max(year_num) FROM dim_date WHERE year_num < year({AS_OF}))""",
        "customer_name order_date@ total_value$",
    ),
    "margin_over_3x": (
        f"""FROM dim_products SELECT *, {pct('list_price - unit_cost', 'list_price')} AS margin_percentage
            WHERE list_price > 3 * unit_cost""",
        "product_name unit_cost$ list_price$ margin_percentage$",
    ),
    "reps_without_recent_assignment": (
        f"""SELECT reps.*
            FROM dim_sales_reps AS reps
            LEFT JOIN rep_customer_assignments USING (sales_rep_id)
            LEFT JOIN dim_date ON date_id = start_date_id AND full_date >= {AS_OF} - INTERVAL 6 MONTH
            WHERE date_id IS NULL""",
        _REP,
    ),
    "unassigned_reps": (
        f"""FROM dim_sales_reps WHERE sales_rep_id NOT IN (
                SELECT sales_rep_id FROM rep_customer_assignments JOIN dim_date ON date_id = start_date_id
                WHERE full_date >= {AS_OF} - INTERVAL 6 MONTH)""",
        _REP,
    ),
    "delayed_shipments": (
        """SELECT order_number, customer_name, country_name, ordered.full_date AS order_date,
                  shipped.full_date AS shipping_date
           FROM fact_sales_orders
           JOIN dim_customers USING (customer_id)
           JOIN dim_date AS ordered ON ordered.date_id = order_date_id
           JOIN dim_date AS shipped ON shipped.date_id = shipping_date_id
           WHERE country_name = 'NATION_7' AND shipped.full_date - ordered.full_date > 14""",
        "order_number customer_name country_name order_date@ shipping_date@",
    ),
    "product_keyword_search": (
        "FROM dim_products WHERE regexp_matches(product_name, 'pro|plus|max', 'i')",
        "product_id# sku# product_name category_id# unit_cost$ list_price$ stock_quantity# is_active"
        " created_at@",
    ),
}
