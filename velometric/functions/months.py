"""Month keys (`yyyymm` integers): arithmetic, the month-list notation and date-range presets."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from velometric.schema import FIRST_MONTH, SERIES_START


def add_months(ym: int, n: int) -> int:
    index = ym // 100 * 12 + ym % 100 - 1 + n
    return index // 12 * 100 + index % 12 + 1


def months_between(start: int, end: int) -> list[int]:
    """Months of the half-open range."""
    out = []
    while start < end:
        out.append(start)
        start = add_months(start, 1)
    return out


def _month(text: str, inherit_year: int | None = None) -> int:
    """One bound: YYYYMM, YYYY, YYMM, YY, or MM when a year can be inherited."""
    if not re.fullmatch(r"\d{2}|\d{4}|\d{6}", text):
        raise ValueError(f"not a month: {text!r}")
    if len(text) == 2:
        if inherit_year is not None and int(text) <= 12:
            text = f"{inherit_year}{text}"
        else:
            text = f"20{text}01"
    elif len(text) == 4:
        head, tail = int(text[:2]), int(text[2:])
        if tail <= 12 and head >= 13:
            text = f"20{text}"
        elif tail > 12 and head == 20:
            text = f"{text}01"
        else:
            raise ValueError(f"not a month: {text!r}")
    if not 1 <= int(text[4:]) <= 12:
        raise ValueError(f"not a month: {text!r}")
    return int(text)


def month_list(
    notation: str | None,
    start: int | Callable[[], int] = FIRST_MONTH["NYC"],
    end: int | Callable[[], int] | None = None,
) -> list[int]:
    """Expand `202106-08,2019` style notation into sorted distinct months; ranges are half-open.

    Open ends take the `start` / `end` defaults, which may be functions so that the latest month is
    looked up only when it is needed.
    """
    chosen: set[int] = set()
    for piece in (notation or "-").split(","):
        low, dash, high = piece.partition("-")
        first = _month(low) if low else (start() if callable(start) else start)
        if high:
            last = _month(high, inherit_year=first // 100)
        elif dash:
            last = end() if callable(end) else end
            if last is None:
                raise ValueError("open range without a default end")
        else:
            last = add_months(first, 1)
        chosen.update(months_between(first, last))
    return sorted(chosen)


def in_months(ym: Column, notation: str | None, **defaults) -> Column:
    """Predicate on a `yyyymm` partition column; literals, so partitions are pruned."""
    return ym.isin(month_list(notation, **defaults))


def label_to_date(label: Column) -> Column:
    return F.to_date(F.concat(label, F.lit("-01")))


def range_start(preset: str, end: Column) -> Column:
    """First `YYYY-MM` of a preset: `All` or `<n>y` counted back from the exclusive end label."""
    if preset == "All":
        return F.lit(SERIES_START)
    years = re.fullmatch(r"(\d+)y", preset)
    if not years:
        raise ValueError(f"unknown date range {preset!r}")
    back = F.add_months(label_to_date(end), -12 * int(years[1]))
    return F.date_format(back, "yyyy-MM")


def next_month(label: Column) -> Column:
    return F.date_format(F.add_months(label_to_date(label), 1), "yyyy-MM")
