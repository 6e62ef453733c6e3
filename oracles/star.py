"""The star tables as SQL over the source tables, and helpers that compose one statement."""

AS_OF = "DATE '2001-08-01'"


def cents(amount: str) -> str:
    """Money with two decimals as an integer."""
    return f"CAST(CAST({amount} AS DECIMAL(20,2)) * 100 AS HUGEINT)"


def half_up(numerator: str, denominator: str) -> str:
    """Integer quotient rounded half away from zero; the denominator is positive or zero."""
    size = f"((2 * abs({numerator}) + {denominator}) // nullif(2 * ({denominator}), 0))"
    return f"(CASE WHEN ({numerator}) < 0 THEN -{size} ELSE {size} END)"


def per_hundred(integer: str) -> str:
    return f"(CAST({integer} AS DOUBLE) / 100)"


def pct2(numerator: str, denominator: str) -> str:
    """Percentage of two money amounts, rounded to two decimals."""
    return per_hundred(half_up(f"{cents(numerator)} * 10000", cents(denominator)))


def over(numerator: str, denominator: str, scale: str = "") -> str:
    """Ratio in floating point; ``scale`` multiplies the numerator first."""
    return f"(CAST({numerator} AS DOUBLE){scale} / nullif(CAST({denominator} AS DOUBLE), 0))"


def pct(numerator: str, denominator: str) -> str:
    return over(numerator, denominator, " * 100.0")


class Statements:
    """Named common table expressions; a query carries all of them."""

    def __init__(self) -> None:
        self.parts: dict[str, str] = {}

    def add(self, **parts: str) -> None:
        self.parts.update(parts)

    def query(self, body: str, columns: str) -> str:
        """``columns`` lists the output; # marks a whole number, $ an amount or ratio, @ a date."""
        chosen = [_cast(column) for column in columns.split()]
        parts = {**self.parts, "answer": body}
        text = ",\n".join(f"{name} AS ({part.strip()})" for name, part in parts.items())
        return f"WITH {text}\nSELECT {', '.join(chosen)} FROM answer"


def _cast(column: str) -> str:
    types = {"#": "BIGINT", "$": "DOUBLE", "@": "TIMESTAMP"}
    kind = types.get(column[-1])
    return column if kind is None else f"CAST({column[:-1]} AS {kind}) AS {column[:-1]}"


def date_key(day: str) -> str:
    return f"CAST(strftime({day}, '%Y%m%d') AS INTEGER)"


STAR = Statements()

_REP = "CASE WHEN (({0}) % reps) % 10 = 9 THEN (({0}) % reps) - 1 ELSE ({0}) % reps END"
_HANDOVER = "CASE WHEN {0} % 3 = 0 THEN DATE '2001-03-01' ELSE DATE '1998-01-01' END"
_BILLED = "CASE WHEN o_custkey > 0 AND o_custkey % 97 = 0 THEN o_custkey - 1 ELSE o_custkey END"
_SOLD = "CASE WHEN l_partkey > 0 AND l_partkey % 53 = 0 THEN l_partkey - 1 ELSE l_partkey END"
_MONEY = "CAST({0} AS DECIMAL(14,2))"
_LINE_KEY = (
    "concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey,"
    f" CAST({_MONEY.format('l_extendedprice')} * 100 AS BIGINT))"
)
_LINE_TOTAL = (
    f"CAST({_MONEY.format('l_extendedprice')} * (CAST(1 AS DECIMAL(4,2)) - CAST(l_discount AS DECIMAL(4,2)))"
    " AS DECIMAL(14,2))"
)

STAR.add(
    size=f"""
        SELECT (SELECT count(*) FROM supplier) AS reps, (SELECT count(*) FROM nation) AS nations,
               min(o_orderdate)::DATE AS opens, max(o_orderdate)::DATE AS closes
        FROM orders""",
    dim_date=f"""
        SELECT {date_key('full_date')} AS date_id, full_date, year(full_date) AS year_num,
               quarter(full_date) AS quarter_num, month(full_date) AS month_num,
               monthname(full_date) AS month_name
        FROM (SELECT unnest(generate_series(opens, closes, INTERVAL 1 DAY))::DATE AS full_date FROM size)""",
    dim_regions="""
        SELECT n_nationkey AS region_id, n_name AS country_name, r_name AS region_name,
               n_name || '_T' AS territory_name, 'N' || n_nationkey AS country_code,
               n_nationkey % 5 <> 0 AS is_active, DATE '1994-01-01' AS created_at
        FROM nation JOIN region ON r_regionkey = n_regionkey""",
    dim_categories="""
        SELECT DISTINCT 1 + (p_size - 1) // 5 AS category_id, 'SEG_' || category_id % 3 AS segment_name,
               'BAND_' || category_id % 8 AS category_name, 'SUB_' || category_id % 5 AS subcategory_name
        FROM part""",
    dim_products="""
        SELECT p_partkey AS product_id, p_partkey + 1000 AS sku, p_name || ' ' || p_type AS product_name,
               1 + (p_size - 1) // 5 AS category_id,
               CAST(CAST(p_retailprice AS DECIMAL(12,2)) * (20 + 2 * p_size) * 0.01 AS DECIMAL(12,2)) AS unit_cost,
               CAST(p_retailprice AS DECIMAL(12,2)) AS list_price, p_partkey % 500 AS stock_quantity,
               p_partkey % 5 <> 0 AS is_active,
               DATE '1994-01-01' + CAST(p_partkey % 365 AS INTEGER) AS created_at
        FROM part""",
    dim_customers="""
        SELECT c_custkey AS customer_id, 'C' || c_custkey AS customer_code, c_name AS customer_name,
               'ADDR_' || c_custkey AS billing_address, 'CITY_' || c_custkey % 50 AS city,
               CASE WHEN c_custkey % 10 <> 0 THEN CAST(c_custkey AS VARCHAR) END AS postal_code,
               n_name AS country_name, CAST(c_acctbal AS DECIMAL(12,2)) * 10 AS credit_limit,
               CASE c_mktsegment WHEN 'BUILDING' THEN 'Gold' WHEN 'AUTOMOBILE' THEN 'Silver'
                    ELSE 'Bronze' END AS account_tier,
               c_nationkey AS region_id,
               CAST(DATE '2023-01-01' + CAST(c_custkey % 1200 AS INTEGER) AS TIMESTAMP) AS created_at
        FROM customer JOIN nation ON n_nationkey = c_nationkey""",
    dim_sales_reps="""
        SELECT s_suppkey AS sales_rep_id, s_suppkey AS employee_code,
               ['Ann', 'Bob', 'Ada', 'Carl', 'Dina'][s_suppkey % 5 + 1] AS first_name,
               s_name AS last_name, s_suppkey || '@example.org' AS email, '555-' || s_suppkey AS phone,
               DATE '1990-01-01' + CAST(s_suppkey % 1800 AS INTEGER) AS hire_date,
               3000 + s_suppkey % 500 AS base_salary,
               CASE WHEN s_acctbal < 0 THEN 'Inactive' ELSE 'Active' END AS status,
               s_nationkey AS region_id, DATE '1994-01-01' AS created_at
        FROM supplier""",
    rep_customer_assignments=f"""
        SELECT 2 * c_custkey AS assignment_id, {_REP.format('c_custkey')} AS sales_rep_id,
               c_custkey AS customer_id, 19950101 AS start_date_id,
               {date_key('(' + _HANDOVER.format('c_custkey') + ') - 1')} AS end_date_id,
               c_custkey % 4 <> 0 AS is_primary_rep
        FROM customer, size
        UNION ALL
        SELECT 2 * c_custkey + 1, {_REP.format('c_custkey + 1')}, c_custkey,
               {date_key(_HANDOVER.format('c_custkey'))}, NULL, c_custkey % 25 <> 0
        FROM customer, size""",
    fact_sales_orders=f"""
        SELECT o_orderkey AS order_id, 'SO' || o_orderkey AS order_number, buyer AS customer_id,
               {_REP.format('''CASE WHEN o_orderkey % 10 = 0 THEN buyer + 2
                                    WHEN o_orderdate < ''' + _HANDOVER.format('buyer') + ''' THEN buyer
                                    ELSE buyer + 1 END''')} AS sales_rep_id,
               {date_key('o_orderdate')} AS order_date_id,
               {date_key('least(o_orderdate::DATE + CAST(o_orderkey * 7 % 31 AS INTEGER), closes)')}
                   AS shipping_date_id,
               buyer % nations AS region_id,
               CASE o_orderstatus WHEN 'O' THEN 'Pending' WHEN 'P' THEN 'Partially Delivered'
                    ELSE 'Delivered' END AS order_status,
               CASE o_orderpriority WHEN '1-URGENT' THEN 'Prepaid' ELSE 'Net 30' END AS payment_terms,
               'EUR' AS currency_code, {_MONEY.format('o_totalprice')} AS net_total,
               CAST({_MONEY.format('o_totalprice')} * 0.05 AS DECIMAL(14,2)) AS discount_total,
               {_MONEY.format('o_totalprice')}
                   + CAST({_MONEY.format('o_totalprice')} * 0.05 AS DECIMAL(14,2)) AS gross_total,
               o_orderdate AS created_at
        FROM (SELECT *, {_BILLED} AS buyer FROM orders), size""",
    fact_order_line_items=f"""
        SELECT {_LINE_KEY} AS line_item_id, l_orderkey AS order_id, {_SOLD} AS product_id,
               l_linenumber AS line_number, CAST(l_quantity AS INTEGER) AS quantity,
               CAST(CAST({half_up(cents('l_extendedprice'), 'CAST(l_quantity AS INTEGER)')} AS BIGINT) * 0.01
                    AS DECIMAL(12,2))
                   AS unit_price,
               CAST(l_discount AS DECIMAL(4,2)) AS discount_pct,
               CAST({_MONEY.format('l_extendedprice')} * CAST(l_discount AS DECIMAL(4,2)) AS DECIMAL(14,2))
                   AS discount_amount,
               {_LINE_TOTAL} AS line_total, l_shipdate AS created_at
        FROM lineitem""",
    fact_returns=f"""
        SELECT 'R' || {_LINE_KEY} AS return_id, {_LINE_KEY} AS line_item_id,
               least(l_shipdate::DATE + 5 * l_linenumber, closes) AS returned_on,
               {date_key('returned_on')} AS return_date_id,
               least(CAST(l_quantity AS INTEGER), 1 + l_linenumber % 3) AS return_quantity,
               ['DEFECT', 'WRONG_ITEM', 'DAMAGED', 'OTHER'][l_linenumber % 4 + 1] AS return_reason_code,
               'CN' || {_LINE_KEY} AS credit_note_number,
               CAST(CAST({half_up(cents(_LINE_TOTAL) + ' * least(CAST(l_quantity AS INTEGER), 1 + l_linenumber % 3)',
                                  'CAST(l_quantity AS INTEGER)')} AS BIGINT) * 0.01 AS DECIMAL(14,2))
                   AS credit_note_value,
               CAST(returned_on AS TIMESTAMP) AS created_at
        FROM lineitem, size WHERE l_returnflag = 'R'""",
    fact_quotas="""
        SELECT s_suppkey * 1000000 + (year_num * 12 + month_num) * 4
                   + CASE kind WHEN 'Quarterly' THEN 2 ELSE 0 END + copy AS quota_id,
               s_suppkey AS sales_rep_id, s_nationkey AS region_id, date_id, kind AS quota_period_type,
               (50000 + s_suppkey * 7919 % 400000) * CASE kind WHEN 'Quarterly' THEN 3 ELSE 1 END
                   AS quota_target,
               '00:00.0' AS created_at
        FROM supplier
        JOIN dim_date ON day(full_date) = 1
        JOIN (VALUES ('Monthly'), ('Quarterly')) AS kinds(kind) ON kind = 'Monthly' OR month_num % 3 = 1
        JOIN (VALUES (0), (1)) AS copies(copy) ON copy = 0 OR s_suppkey % 7 = 0""",
    product_promotions="""
        SELECT p_partkey AS promotion_id, p_partkey AS product_id, 19990601 + p_partkey % 28 AS start_date_id,
               19990901 + p_partkey % 28 AS end_date_id
        FROM part""",
)
