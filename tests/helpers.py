"""Small series for tests."""

from datetime import datetime, timedelta

START = datetime(2020, 3, 1)


def series(spark, values, step=3600, series_id="a", start=START, keep_idx=True):
    """A series with one row per value; `values` may be a dict position -> value (a gappy series)."""
    items = values.items() if isinstance(values, dict) else enumerate(values)
    rows = [
        (series_id, start + timedelta(seconds=step * k), i, None if v is None else float(v))
        for i, (k, v) in enumerate(items)
    ]
    df = spark.createDataFrame(rows, "series_id string, Period timestamp_ntz, idx long, TS double")
    return df if keep_idx else df.drop("idx")


def column(df, name, order="Period"):
    return [r[name] for r in df.orderBy(order).collect()]
