from oracles.star import pct

_REP = "sales_rep_id, employee_code, first_name, last_name, region_id, region_name, country_name, year_num"

QUERIES = {
    "monthly_trend": (
        f"""FROM (SELECT *, lag(net_revenue) OVER months AS previous_month_revenue,
                         net_revenue - previous_month_revenue AS revenue_change
                  FROM country_month
                  WINDOW months AS (PARTITION BY region_country_name ORDER BY year_num, month_num))
            SELECT *, {pct('revenue_change', 'previous_month_revenue')} AS month_over_month_pct_change""",
        "region_country_name year_num# month_num# month_name net_revenue$ order_count# average_order_value$"
        " previous_month_revenue$ revenue_change$ month_over_month_pct_change$",
    ),
    "product_performance": (
        """FROM product_metrics
           SELECT *, rank() OVER (PARTITION BY category_id ORDER BY net_revenue DESC NULLS LAST) AS category_rank""",
        "product_id# sku# product_name category_id# category_name total_units_sold# net_revenue$"
        " gross_margin_pct$ return_rate$ category_rank#",
    ),
    "rep_performance_scorecard": (
        f"""FROM (
                SELECT {_REP}, quarter_num, month_num, month_name, quota_period_type, actual_revenue, quota_target,
                       quota_attainment_pct, customer_count, 'CURRENT_QUARTER' AS period_scope
                FROM rep_attainment
                WHERE quota_period_type = 'Quarterly'
                  AND (year_num, quarter_num) = (
                      SELECT (year_num, max(quarter_num)) FROM rep_attainment
                      WHERE quota_period_type = 'Quarterly'
                        AND year_num = (SELECT max(year_num) FROM rep_attainment)
                      GROUP BY year_num)
                UNION ALL BY NAME
                SELECT {_REP}, NULL AS quarter_num, 'YTD' AS quota_period_type,
                       sum(actual_revenue) AS actual_revenue, sum(quota_target) AS quota_target,
                       {pct('sum(actual_revenue)', 'sum(quota_target)')} AS quota_attainment_pct,
                       sum(customer_count) AS customer_count, 'YTD' AS period_scope
                FROM rep_attainment
                WHERE quota_period_type = 'Monthly' AND year_num = (SELECT max(year_num) FROM rep_attainment)
                GROUP BY {_REP})
            SELECT *, rank() OVER (PARTITION BY region_id, year_num, period_scope
                                   ORDER BY quota_attainment_pct DESC NULLS LAST) AS regional_rank""",
        "sales_rep_id# employee_code# first_name last_name region_id# region_name country_name year_num#"
        " quarter_num# month_num# month_name quota_period_type actual_revenue$ quota_target#"
        " quota_attainment_pct$ customer_count# period_scope regional_rank#",
    ),
    "customer_360": (
        """SELECT m.*, concat(first_name, ' ', last_name) AS assigned_rep, recency_days, frequency_orders,
                  monetary_value, rfm_segment
           FROM customer_metrics AS m
           JOIN customer_segments USING (customer_id)
           LEFT JOIN (FROM rep_customer_assignments WHERE is_primary_rep
                      QUALIFY row_number() OVER (PARTITION BY customer_id
                                                 ORDER BY start_date_id DESC, assignment_id DESC) = 1)
               USING (customer_id)
           LEFT JOIN dim_sales_reps USING (sales_rep_id)""",
        "customer_id# customer_code customer_name account_tier lifetime_revenue$ order_frequency#"
        " last_order_date@ average_order_value$ return_rate$ assigned_rep recency_days# frequency_orders#"
        " monetary_value$ rfm_segment",
    ),
    "returns_analysis": (
        "FROM returns_month",
        "year_num# quarter_num# month_num# country_name category_name return_reason_code returned_units#"
        " return_count# total_credit_note_value$ return_rate$",
    ),
    "sales_executive_summary": (
        f"""SELECT m.*, coalesce({pct('sum(a.actual_revenue)', 'sum(a.quota_target)')}, 0) AS quota_attainment_pct
            FROM region_month AS m
            LEFT JOIN rep_attainment AS a
                   ON a.region_name = m.region_name AND a.year_num = m.year_num
                  AND a.quarter_num = m.quarter_num AND a.month_num = m.month_num
            GROUP BY ALL""",
        "region_name region_country_name territory_name year_num# quarter_num# month_num# month_name"
        " total_revenue$ gross_margin_pct$ order_count# average_order_value$ quota_attainment_pct$",
    ),
}
