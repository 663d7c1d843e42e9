"""Plans as text."""


def executed(df):
    """The physical plan of a frame, as it was run."""
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
