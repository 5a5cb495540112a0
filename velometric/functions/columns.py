"""Column expressions shared by the operators; everything stays in JVM code generation."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from velometric.schema import (
    NO_REGION,
    NULL_TOKENS,
    REGION_PATTERNS,
    SYSTEM_REGION,
)

DAY_SECONDS = 86_400


def lookup(value: Column, table: Mapping, default: Column | None = None) -> Column:
    """Map values through a small dictionary; values outside it become `default` (null)."""
    chain = None
    for key, mapped in table.items():
        chain = F.when(value == F.lit(key), F.lit(mapped)) if chain is None else chain.when(
            value == F.lit(key), F.lit(mapped)
        )
    return chain.otherwise(default) if default is not None else chain


def null_tokens_removed(value: Column, tokens: Sequence[str] = tuple(NULL_TOKENS)) -> Column:
    return F.when(~value.isin(list(tokens)), value)


def quoted(text: str) -> str:
    """SQL literal of a pattern or name, backslashes kept as they are."""
    return f"r'{text}'" if "'" not in text else f'r"{text}"'


# The id rules below take SQL text (usually a quoted column name) and return SQL text: a station rule
# has dozens of terms, and one parsed expression is built far faster than as many Column calls.


def clean_station_id(value: str) -> str:
    """Drop the `.0` that whole-number ids pick up on their way through floats."""
    return (
        f"case when endswith({value}, '.0') and {value} rlike r'^\\d+\\.0$' "
        f"then substring({value}, 1, length({value}) - 2) else {value} end"
    )


def starts_like(value: str, *patterns: str) -> str:
    """Whether the value starts with a match of any pattern.

    Patterns are applied behind a plain prefix comparison wherever they begin with literal text, so
    few rows reach the regular expression engine.
    """
    tests = []
    for pattern in patterns:
        prefix = "" if "|" in pattern else re.match(r"[\w &-]*(?![?*{])", pattern)[0]
        starts = f"startswith({value}, {quoted(prefix)})"
        matches = f"{value} rlike {quoted(f'^(?:{pattern})')}"
        if prefix == pattern:
            tests.append(starts)
        else:
            tests.append(f"({starts} and {matches})" if prefix else matches)
    return "(" + " or ".join(tests) + ")"


def _no_station(station_id: str, strict_none: bool) -> str:
    if strict_none:
        return f"({station_id} is null or {station_id} = '{NO_REGION}')"
    letters = ", ".join(f"'{c}'" for c in NO_REGION)
    return f"({station_id} is null or left({station_id}, 1) in ({letters}))"


def region_matches(
    station_id: str,
    rules: Mapping[str, Sequence[str]] = REGION_PATTERNS,
    strict_none: bool = False,
) -> str:
    """Every region whose patterns match, as an array."""
    flags = [f"case when {starts_like(station_id, *p)} then '{r}' end" for r, p in rules.items()]
    flags.append(f"case when {_no_station(station_id, strict_none)} then '{NO_REGION}' end")
    return f"array_compact(array({', '.join(flags)}))"


def region_of(
    station_id: str,
    source_region: str | None = None,
    rules: Mapping[str, Sequence[str]] = REGION_PATTERNS,
    strict_none: bool = False,
) -> str:
    """Region of a station id; null when no pattern matches.

    The built-in rules are disjoint, so the first match is the only one. Caller-supplied rules are
    checked per row and an id matching several regions is an error.
    """

    def named(name: str) -> str:
        if name == "NYC" and source_region:
            # Jersey City files hold main-region ids for their own stations.
            return f"if({source_region} = 'JC', 'JC', 'NYC')"
        return f"'{name}'"

    if rules is REGION_PATTERNS:
        tests = {NO_REGION: _no_station(station_id, strict_none)}
        tests |= {name: starts_like(station_id, *patterns) for name, patterns in rules.items()}
        several = ""
    else:
        found = region_matches(station_id, rules, strict_none)
        tests = {name: f"array_contains({found}, '{name}')" for name in [*rules, NO_REGION]}
        message = f"concat('station ', {station_id}, ' matches regions ', array_join({found}, ','))"
        several = f"when size({found}) > 1 then cast(raise_error({message}) as string)"
    branches = " ".join(f"when {test} then {named(name)}" for name, test in tests.items())
    return f"case {several} {branches} end"


def out_of_system(
    station_id: str,
    rules: Mapping[str, Sequence[str]] = REGION_PATTERNS,
    strict_none: bool = False,
    missing: bool = True,
) -> str:
    """Whether an id belongs to the operator's own stations or, with `missing`, to no station."""
    own = starts_like(station_id, *rules[SYSTEM_REGION])
    if not missing:
        return f"coalesce({own}, false)"
    return f"({_no_station(station_id, strict_none)} or {own})"


def trip_time(value: str) -> str:
    """A trip file's time text as a timestamp; some older months write times as 6/1/2015 0:00[:03]."""
    return (
        f"case when {value} rlike r'^\\d{{1,2}}/' then to_timestamp_ntz({value}, 'M/d/yyyy H:mm[:ss]') "
        f"else cast({value} as timestamp_ntz) end"
    )


def yyyymm(ts: Column) -> Column:
    return F.year(ts) * 100 + F.month(ts)


def part_label(start: Column, stop: Column) -> Column:
    """`YYYYMM_YYYYMM` from start and stop time; a missing time is an error."""
    label = F.concat(F.date_format(start, "yyyyMM"), F.lit("_"), F.date_format(stop, "yyyyMM"))
    return F.coalesce(label, F.raise_error(F.lit("ride without start or stop time")).cast("string"))


def ride_seconds(start: Column, stop: Column, wrap_days: bool = True) -> Column:
    """Whole seconds between two times, floored.

    With `wrap_days` only the part within one day counts, so 25 h is 3600 and -10 s is 86390.
    """
    # Subtracting local times gives an interval that no session time zone can bend.
    elapsed = (stop - start).cast("interval second").cast("decimal(18,6)")
    seconds = F.floor(elapsed).cast("bigint")
    return F.pmod(seconds, F.lit(DAY_SECONDS).cast("bigint")) if wrap_days else seconds


def month_label(year: Column, month: Column) -> Column:
    return F.format_string("%d-%02d", year, month)


def seconds_label(seconds: Column) -> Column:
    """`1h2m3s` without zero parts; whole days drop out; `0s` when nothing is left."""
    h = F.floor(F.pmod(seconds, F.lit(DAY_SECONDS)) / 3600)
    m = F.floor(F.pmod(seconds, F.lit(3600)) / 60)
    s = F.pmod(seconds, F.lit(60))
    text = F.concat_ws(
        "",
        F.when(h > 0, F.concat(h.cast("string"), F.lit("h"))),
        F.when(m > 0, F.concat(m.cast("string"), F.lit("m"))),
        F.when(s > 0, F.concat(s.cast("string"), F.lit("s"))),
    )
    return F.when(text == "", F.lit("0s")).otherwise(text)


def gender_letter(code: Column) -> Column:
    return F.substring(F.lit("UMF"), code.cast("int") + 1, F.lit(1))


def weekday_label(weekday: Column) -> Column:
    return F.when(weekday < 5, F.lit("Weekday")).otherwise(F.lit("Weekend"))


def month_gender_label(month_start: Column, gender: Column) -> Column:
    """`Jan-M` style label."""
    return F.concat(F.date_format(month_start, "MMM"), F.lit("-"), gender_letter(gender))
