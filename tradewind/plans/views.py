"""The star and the reporting tiers as temporary views, for SQL users."""

from collections.abc import Callable, Iterable
from datetime import date
from functools import partial

from pyspark.sql import DataFrame

from tradewind.plans import base, reports, summaries
from tradewind.plans.stored import stored_views
from tradewind.star import Star


def _views(as_of: date) -> dict[str, Callable[[Star], DataFrame]]:
    return {
        "vw_base_sales_order_line": base.base_sales_order_line,
        "vw_base_returns": base.base_returns,
        "vw_base_quota_rep_period": base.base_quota_rep_period,
        "vw_sum_monthly_country_sales": summaries.sum_monthly_country_sales,
        "vw_sum_product_metrics": summaries.sum_product_metrics,
        "vw_sum_customer_metrics": summaries.sum_customer_metrics,
        "vw_sum_customer_rfm": partial(summaries.sum_customer_rfm, as_of=as_of),
        "vw_sum_rep_quota_attainment": summaries.sum_rep_quota_attainment,
        "vw_sum_returns_metrics": summaries.sum_returns_metrics,
        "vw_sum_region_period_sales": summaries.sum_region_period_sales,
        "vw_monthly_trend": reports.monthly_trend,
        "vw_product_performance": reports.product_performance,
        "vw_rep_performance_scorecard": reports.rep_performance_scorecard,
        "vw_customer_360": partial(reports.customer_360, as_of=as_of),
        "vw_returns_analysis": reports.returns_analysis,
        "vw_sales_executive_summary": reports.sales_executive_summary,
    }


def register_views(
    star: Star, *, as_of: date, names: Iterable[str] | None = None, stored: str | None = None
) -> list[str]:
    """Create the twelve tables and the named views (all by default) in the current session.

    No view runs until it is queried, and each follows the tables. With ``stored``, a folder that
    ``plans.stored`` wrote, the views read the parts in it and follow their refreshes once registered again.
    """
    if stored is None:
        views = {name: partial(build, star) for name, build in _views(as_of).items()}
    else:
        views = stored_views(star, stored, as_of=as_of)
    chosen = list(views) if names is None else list(names)
    for table in Star.names():
        getattr(star, table).createOrReplaceTempView(table)
    for name in chosen:
        views[name]().createOrReplaceTempView(name)
    return chosen
