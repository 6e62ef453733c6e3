"""Column types of the twelve star tables.

Money is DECIMAL so that sums are exact and do not depend on row order.
Date-times carry no zone, hence TIMESTAMP_NTZ.
"""

from pyspark.sql import types as T

TABLES = {
    "dim_categories": """
        category_id BIGINT, segment_name STRING, category_name STRING, subcategory_name STRING,
        parent_category_id BIGINT, is_active BOOLEAN, created_at DATE""",
    "dim_products": """
        product_id BIGINT, sku BIGINT, product_name STRING, category_id BIGINT,
        unit_cost DECIMAL(12,2), list_price DECIMAL(12,2), stock_quantity BIGINT,
        is_active BOOLEAN, created_at DATE""",
    "dim_regions": """
        region_id BIGINT, country_name STRING, region_name STRING, territory_name STRING,
        country_code STRING, is_active BOOLEAN, created_at DATE""",
    "dim_sales_reps": """
        sales_rep_id BIGINT, employee_code BIGINT, first_name STRING, last_name STRING,
        email STRING, phone STRING, hire_date DATE, base_salary DECIMAL(12,2), status STRING,
        region_id BIGINT, created_at DATE""",
    "dim_customers": """
        customer_id BIGINT, customer_code STRING, customer_name STRING, billing_address STRING,
        city STRING, postal_code STRING, country_name STRING, credit_limit DECIMAL(14,2),
        account_tier STRING, region_id BIGINT, created_at TIMESTAMP_NTZ""",
    "dim_date": """
        date_id INT, full_date DATE, year_num INT, quarter_num INT, month_num INT,
        month_name STRING""",
    "fact_sales_orders": """
        order_id BIGINT, order_number STRING, customer_id BIGINT, sales_rep_id BIGINT,
        order_date_id INT, shipping_date_id INT, region_id BIGINT, order_status STRING,
        payment_terms STRING, currency_code STRING, gross_total DECIMAL(14,2),
        discount_total DECIMAL(14,2), net_total DECIMAL(14,2), created_at TIMESTAMP_NTZ""",
    "fact_order_line_items": """
        line_item_id STRING, order_id BIGINT, product_id BIGINT, line_number INT, quantity INT,
        unit_price DECIMAL(12,2), discount_pct DECIMAL(4,2), discount_amount DECIMAL(14,2),
        line_total DECIMAL(14,2), created_at TIMESTAMP_NTZ""",
    "fact_returns": """
        return_id STRING, line_item_id STRING, return_date_id INT, return_quantity INT,
        return_reason_code STRING, credit_note_number STRING, credit_note_value DECIMAL(14,2),
        created_at TIMESTAMP_NTZ""",
    "fact_quotas": """
        quota_id BIGINT, sales_rep_id BIGINT, region_id BIGINT, date_id INT,
        quota_period_type STRING, quota_target BIGINT, created_at STRING""",
    "product_promotions": """
        promotion_id BIGINT, product_id BIGINT, promotion_name STRING, discount_pct DECIMAL(4,2),
        start_date_id INT, end_date_id INT, is_active BOOLEAN, created_at STRING""",
    "rep_customer_assignments": """
        assignment_id BIGINT, sales_rep_id BIGINT, customer_id BIGINT, start_date_id INT,
        end_date_id INT, is_primary_rep BOOLEAN, created_at STRING""",
}


def struct_of(table: str) -> T.StructType:
    return T.StructType.fromDDL(" ".join(TABLES[table].split()))
