from oracles.star import cents, half_up, pct2, per_hundred

_CUSTOMER = (
    "customer_id# customer_code customer_name billing_address city postal_code country_name"
    " credit_limit$ account_tier region_id# created_at@"
)

QUERIES = {
    "region_alias": ("FROM dim_regions SELECT region_id AS id, region_name AS name", "id# name"),
    "region_equals": (
        "FROM dim_regions WHERE region_name = 'AMERICA'",
        "region_id# country_name region_name territory_name country_code is_active created_at@",
    ),
    "customers_created_between": (
        """FROM dim_customers
           WHERE created_at >= TIMESTAMP '2023-09-09' AND created_at <= TIMESTAMP '2026-01-31'""",
        _CUSTOMER,
    ),
    "dates_in_years": (
        "FROM dim_date WHERE year_num BETWEEN 1999 AND 2001",
        "date_id# full_date@ year_num# quarter_num# month_num# month_name",
    ),
    "reps_name_prefix": (
        "FROM dim_sales_reps WHERE upper(left(first_name, 1)) = 'A'",
        "sales_rep_id# employee_code# first_name last_name email phone hire_date@ base_salary$ status"
        " region_id# created_at@",
    ),
    "customers_missing_postal": ("FROM dim_customers WHERE postal_code IS NULL", _CUSTOMER),
    "reps_sorted": ("FROM dim_sales_reps", "first_name last_name status"),
    "customers_top10": ("FROM dim_customers ORDER BY customer_id LIMIT 10", _CUSTOMER),
    "product_price_rank": (
        """FROM dim_products
           SELECT *, rank() OVER (PARTITION BY category_id ORDER BY list_price DESC) AS price_rank_in_category
           WHERE is_active""",
        "product_id# product_name category_id# list_price$ unit_cost$ price_rank_in_category#",
    ),
    "product_margin_band": (
        f"""FROM (SELECT *, list_price - unit_cost AS gross_profit FROM dim_products WHERE is_active)
            SELECT *, {pct2('gross_profit', 'list_price')} AS gross_margin_pct,
                   CASE WHEN gross_profit * 100 >= list_price * 60 THEN 'High Margin'
                        WHEN gross_profit * 100 >= list_price * 30 THEN 'Medium Margin'
                        ELSE 'Low Margin' END AS margin_category""",
        "product_id# product_name category_id# unit_cost$ list_price$ gross_profit$ gross_margin_pct$"
        " margin_category",
    ),
    "discount_impact": (
        f"""FROM (SELECT product_id, sum(discount_amount) AS total_discount, sum(line_total) AS total_revenue
                  FROM fact_order_line_items GROUP BY ALL)
            SELECT *, {pct2('total_discount', 'total_revenue')} AS discount_impact_pct,
                   CASE WHEN 5 * total_discount > total_revenue THEN 'High Discount'
                        WHEN 10 * total_discount > total_revenue THEN 'Medium Discount'
                        ELSE 'Low Discount' END AS discount_level""",
        "product_id# total_discount$ total_revenue$ discount_impact_pct$ discount_level",
    ),
    "product_sales_summary": (
        """SELECT product_id, count(*) AS total_items_sold, sum(quantity) AS total_quantity,
                  sum(line_total) AS total_revenue
           FROM fact_order_line_items GROUP BY ALL""",
        "product_id# total_items_sold# total_quantity# total_revenue$",
    ),
    "customer_validation": (
        """FROM dim_customers
           SELECT *, CASE WHEN coalesce(trim(customer_code), '') = '' THEN 'Missing customer code'
                          WHEN coalesce(trim(customer_name), '') = '' THEN 'Missing customer name'
                          WHEN coalesce(trim(country_name), '') = '' THEN 'Missing country'
                          ELSE 'Valid' END AS validation_status
           WHERE credit_limit > 45000""",
        "customer_id# customer_name customer_code billing_address city country_name credit_limit$"
        " account_tier validation_status",
    ),
    "customer_validation_all": (
        """FROM dim_customers
           SELECT *, CASE WHEN coalesce(trim(customer_code), '') = '' THEN 'Missing customer code'
                          WHEN coalesce(trim(customer_name), '') = '' THEN 'Missing customer name'
                          WHEN coalesce(trim(country_name), '') = '' THEN 'Missing country'
                          WHEN credit_limit IS NULL THEN 'Missing credit limit'
                          WHEN credit_limit < 0 THEN 'Invalid credit limit'
                          ELSE 'Valid' END AS validation_status""",
        "customer_id# customer_name customer_code billing_address city country_name credit_limit$"
        " account_tier validation_status",
    ),
    "order_validation": (
        """FROM fact_sales_orders
           SELECT *, CASE WHEN customer_id IS NULL THEN 'Missing customer'
                          WHEN sales_rep_id IS NULL THEN 'Missing sales rep'
                          WHEN order_date_id IS NULL THEN 'Missing date reference'
                          ELSE 'Valid' END AS validation_status
           WHERE net_total > 1000""",
        "order_id# order_number customer_id# sales_rep_id# order_status net_total$ order_date_id#"
        " validation_status",
    ),
    "order_validation_all": (
        """FROM fact_sales_orders
           SELECT *, CASE WHEN customer_id IS NULL THEN 'Missing customer'
                          WHEN sales_rep_id IS NULL THEN 'Missing sales rep'
                          WHEN order_date_id IS NULL THEN 'Missing date reference'
                          WHEN net_total IS NULL THEN 'Missing net total'
                          WHEN net_total <= 0 THEN 'Invalid total'
                          ELSE 'Valid' END AS validation_status""",
        "order_id# order_number customer_id# sales_rep_id# order_status net_total$ order_date_id#"
        " validation_status",
    ),
    "gold_high_credit": (
        """FROM dim_customers
           WHERE account_tier = 'Gold' AND country_name = 'NATION_7' AND credit_limit > 50000""",
        "customer_id# customer_name customer_code city country_name credit_limit$ account_tier",
    ),
    "high_markup_products": (
        f"""FROM dim_products
            SELECT *, {pct2('list_price - unit_cost', 'list_price')} AS margin_pct_on_price
            WHERE list_price > 3 * unit_cost""",
        "product_id# sku# product_name unit_cost$ list_price$ margin_pct_on_price$",
    ),
    "gross_rev_month_region_country": (
        """SELECT year_num, month_num, country_name, sum(quantity * unit_price) AS gross_revenue
           FROM fact_order_line_items
           JOIN fact_sales_orders USING (order_id)
           JOIN dim_regions USING (region_id)
           JOIN dim_date ON date_id = order_date_id
           GROUP BY ALL""",
        "year_num# month_num# country_name gross_revenue$",
    ),
    "aov_region_month": (
        f"""FROM (SELECT year_num, month_num, region_name, sum(net_total) AS net,
                         count(DISTINCT order_id) AS order_count
                  FROM fact_sales_orders
                  JOIN dim_regions USING (region_id)
                  JOIN dim_date ON date_id = order_date_id
                  GROUP BY ALL)
            SELECT *, {per_hundred(half_up(cents('net'), 'order_count'))} AS avg_order_value""",
        "year_num# month_num# region_name avg_order_value$ order_count#",
    ),
}
