"""Binary search in a sorted array column."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def count_below(values: Column, x: Column, size: int, inclusive: bool) -> Column:
    """How many entries of the sorted array are < x (<= x if `inclusive`).

    Takes log2(size) steps per row instead of `size` comparisons.
    """
    steps = F.sequence(F.lit(1), F.lit(max(1, size.bit_length())))
    bounds = F.struct(F.lit(0).alias("lo"), F.size(values).alias("hi"))

    def halve(acc: Column, _: Column) -> Column:
        mid = F.floor((acc["lo"] + acc["hi"]) / 2).cast("int")
        entry = F.get(values, mid)
        goes_right = (entry <= x) if inclusive else (entry < x)
        open_ = acc["lo"] < acc["hi"]
        return F.struct(
            F.when(open_ & goes_right, mid + 1).otherwise(acc["lo"]).alias("lo"),
            F.when(open_ & ~goes_right, mid).otherwise(acc["hi"]).alias("hi"),
        )

    return F.aggregate(steps, bounds, halve, lambda acc: acc["lo"])
