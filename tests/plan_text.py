"""The final plan of an executed query as text."""


def final_plan(df) -> str:
    """The plan that ran, without the initial plans that adaptive execution prints beside it and beside subqueries."""
    kept, skipped = [], None
    for line in df._jdf.queryExecution().executedPlan().toString().splitlines():
        at = len(line) - len(line.lstrip(" :|+-"))
        if "== Initial Plan ==" in line:
            skipped = at if skipped is None else min(skipped, at)
            continue
        if skipped is not None and at >= skipped:
            continue
        skipped = None
        kept.append(line)
    return "\n".join(kept)
