"""Parsing of the short parameter texts: lag specs, size specs, value ranges."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

_SPAN = re.compile(r"^(\d+)(?:-(\d+))?(.)$")


def lag_rows(points: Sequence[str], per_hour: int) -> list[int]:
    """Row shifts of specs such as "1r", "1-4h" or "7d"; unknown units are skipped."""
    unit_rows = {"r": 1, "h": per_hour, "d": 24 * per_hour}
    shifts: list[int] = []
    for point in points:
        match = _SPAN.match(point)
        if not match or match[3] not in unit_rows:
            continue
        first = int(match[1])
        last = int(match[2] or first)
        shifts += [n * unit_rows[match[3]] for n in range(first, last + 1)]
    return shifts


def day_offsets(averages: Sequence[str]) -> list[int]:
    """Days of specs such as "7d"; other units are skipped."""
    return [int(a[:-1]) for a in averages if a.endswith("d")]


def layer_size(spec: str, input_width: int) -> int:
    """"128" is a plain size, "2X" a multiple of the input width."""
    return int(float(spec[:-1]) * input_width) if spec.endswith("X") else int(spec)


def size_range(spec: str, steps: int, input_width: int) -> list[int]:
    """"32-2X" in `steps` evenly spaced whole sizes."""
    start, end = (layer_size(part, input_width) for part in spec.split("-"))
    return [int(v) for v in spaced(start, end, steps)]


def spaced(start: float, stop: float, n: int) -> list[float]:
    """n evenly spaced values including both ends; whole ends give whole (truncated) values."""
    gap = (stop - start) / (n - 1) if n > 1 else 0.0
    values = [start + i * gap if i < n - 1 or n == 1 else float(stop) for i in range(n)]
    return [int(v) for v in values] if isinstance(start, int) and isinstance(stop, int) else values


def sweep_values(var_range: Sequence | None = None, var_list: Sequence | None = None) -> list:
    """Values of a swept setting: a (start, stop, count) range or a list of one type."""
    if var_range is not None and len(var_range) == 3:
        return spaced(*var_range)
    if var_list and len({type(v) for v in var_list}) == 1:
        return list(var_list)
    raise ValueError("give var_range=(start, stop, count) or var_list with values of one type")


def linspace(start: Column, stop: Column, n: int) -> Column:
    """Array of n evenly spaced values from `start` to `stop`, both included."""
    steps = F.sequence(F.lit(0), F.lit(n - 1))
    return F.transform(steps, lambda i: start + i * ((stop - start) / F.lit(max(n - 1, 1))))
