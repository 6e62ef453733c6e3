# The foreign keys as the schema states them: child table, its column, parent table, its key.
_KEYS = """
fk_customer_region dim_customers region_id dim_regions region_id
fk_product_category dim_products category_id dim_categories category_id
fk_salesrep_region dim_sales_reps region_id dim_regions region_id
fk_line_order fact_order_line_items order_id fact_sales_orders order_id
fk_line_product fact_order_line_items product_id dim_products product_id
fk_quota_date fact_quotas date_id dim_date date_id
fk_quota_region fact_quotas region_id dim_regions region_id
fk_quota_salesrep fact_quotas sales_rep_id dim_sales_reps sales_rep_id
fk_return_date fact_returns return_date_id dim_date date_id
fk_return_line fact_returns line_item_id fact_order_line_items line_item_id
fk_order_customer fact_sales_orders customer_id dim_customers customer_id
fk_order_orderdate fact_sales_orders order_date_id dim_date date_id
fk_order_region fact_sales_orders region_id dim_regions region_id
fk_order_salesrep fact_sales_orders sales_rep_id dim_sales_reps sales_rep_id
fk_order_shipdate fact_sales_orders shipping_date_id dim_date date_id
fk_promo_enddate product_promotions end_date_id dim_date date_id
fk_promo_product product_promotions product_id dim_products product_id
fk_promo_startdate product_promotions start_date_id dim_date date_id
fk_assignment_customer rep_customer_assignments customer_id dim_customers customer_id
fk_assignment_enddate rep_customer_assignments end_date_id dim_date date_id
fk_assignment_salesrep rep_customer_assignments sales_rep_id dim_sales_reps sales_rep_id
fk_assignment_startdate rep_customer_assignments start_date_id dim_date date_id
"""
_FOREIGN = [line.split() for line in _KEYS.split("\n") if line]
_REFERENCED = sorted({(parent, key) for _, _, _, parent, key in _FOREIGN})


def _check(name: str, child: str, column: str, parent: str, key: str) -> str:
    return f"""
        SELECT '{name}' AS constraint_name, '{child}' AS child_table, '{column}' AS child_column,
               '{parent}' AS parent_table, count({column}) AS checked_rows,
               count({column}) FILTER (WHERE {column} NOT IN (SELECT {key} FROM {parent})) AS violations
        FROM {child}"""


def _unique(table: str, key: str) -> str:
    return f"""
        SELECT 'uq_{table}_{key}', '{table}', '{key}', '{table}', count({key}), count({key}) - count(DISTINCT {key})
        FROM {table}"""


QUERIES = {
    "referential_integrity_report": (
        " UNION ALL ".join([*(_check(*key) for key in _FOREIGN), *(_unique(*key) for key in _REFERENCED)]),
        "constraint_name child_table child_column parent_table checked_rows# violations#",
    ),
}
