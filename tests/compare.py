"""Order-insensitive comparison of two tables with rounded numbers."""

import pandas as pd


def rows(df: pd.DataFrame) -> list[tuple]:
    def one(x):
        if x is None or x is pd.NA or (isinstance(x, float) and x != x) or x is pd.NaT:
            return "∅"
        if isinstance(x, float):
            return f"{round(x, 6) + 0.0:.6f}"
        if isinstance(x, bool) or not hasattr(x, "__float__") or isinstance(x, str):
            return str(x)
        return f"{round(float(x), 6) + 0.0:.6f}"

    d = df[sorted(df.columns)]
    return sorted(tuple(one(x) for x in r) for r in d.itertuples(index=False))


def assert_same(a: pd.DataFrame, b: pd.DataFrame) -> None:
    assert sorted(a.columns) == sorted(b.columns)
    assert rows(a) == rows(b)
