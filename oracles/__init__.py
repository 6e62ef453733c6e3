"""Independent SQL for the registered queries, run by DuckDB on the same source tables.

The SQL joins first and groups afterwards, as each question reads. The Spark side folds, splits or
leaves out joins, so agreement checks those rewrites.
"""

from oracles import advanced, base, integrity, joins, kpi, questions, reports, selection, summaries
from oracles.star import STAR


def oracle_sql() -> dict[str, str]:
    families = [selection, questions, kpi, joins, advanced, integrity, base, summaries, reports]
    return {name: STAR.query(*parts) for family in families for name, parts in family.QUERIES.items()}
