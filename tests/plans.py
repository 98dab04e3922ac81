"""Reading physical plans in tests."""

import re


def broadcasts(df):
    """The subtree below each broadcast of a frame's plan, as text."""
    lines = df._jdf.queryExecution().executedPlan().toString().splitlines()
    depth = [len(re.match(r"[\s:+\-*|]*", x).group()) for x in lines]
    for k, line in enumerate(lines):
        if "BroadcastExchange" in line:
            end = next((j for j in range(k + 1, len(lines)) if depth[j] <= depth[k]), len(lines))
            yield "\n".join(lines[k:end])
