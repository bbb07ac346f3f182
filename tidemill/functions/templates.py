"""Templates as columns: ${...} in a text becomes an expression on each row's context and time, so that Spark fills it in."""

from __future__ import annotations

import calendar
import re
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemill.functions.dates import TEMPLATE, ZONE, date_fields, local_time, pattern_parts


def _padded(value: Column, n: int) -> Column:
    return F.format_string(f"%0{n}d", value.cast("long")) if n > 1 else value.cast("string")


def _named(names: list[str], place: Column, n: int) -> Column:
    return F.element_at(F.array(*(F.lit(x[:1] if n == 5 else x if n == 4 else x[:3]) for x in names)), place.cast("int"))


class _Time:
    """The parts of a local time that patterns print."""

    def __init__(self, ts: Column, zone: str, shift: Callable[[Column], Column]) -> None:
        self.t = t = shift(local_time(ts, zone))
        self.year, self.month, self.day, self.day_of_year = F.year(t), F.month(t), F.dayofmonth(t), F.dayofyear(t)
        self.hour, self.minute, self.second = F.hour(t), F.minute(t), F.second(t)
        # Shifts are whole minutes at least and zones whole seconds, so that the instant tells the fraction.
        self.micros = F.pmod(F.unix_micros(ts.cast("timestamp")), F.lit(1_000_000))
        self.millis = ((self.hour * 60 + self.minute) * 60 + self.second).cast("long") * 1000 + F.floor(self.micros / 1000)
        self.weekday = F.dayofweek(t)  # Sunday is 1
        utc = F.convert_timezone(F.lit(zone), F.lit("UTC"), t)
        self.offset = F.floor((F.unix_micros(F.convert_timezone(F.lit("UTC"), F.current_timezone(), t).cast("timestamp")) - F.unix_micros(F.convert_timezone(F.lit("UTC"), F.current_timezone(), utc).cast("timestamp"))) / 60_000_000)
        saturday = self.day_of_year - 1 + (7 - self.weekday)
        self.next_year = saturday >= F.when((self.year % 4 == 0) & ((self.year % 100 != 0) | (self.year % 400 == 0)), 366).otherwise(365)
        self.week = F.when(self.next_year, 1).otherwise(self._week_from(self.day_of_year))
        self.week_of_month = self._week_from(self.day)
        self.week_year = self.year + self.next_year.cast("int")

    def _week_from(self, day: Column) -> Column:
        """The number of the week, from Sunday on, that holds a day counted from 1, where day 1 is in week 1."""
        return F.floor((day - 1 + F.pmod(self.weekday - day, F.lit(7))) / 7) + 1


def _zone(t: _Time, n: int, letter: str) -> Column:
    minutes = F.abs(t.offset)
    hours, rest = F.floor(minutes / 60), minutes % 60
    sign = F.when(t.offset < 0, "-").otherwise("+")
    if letter == "O":
        short = F.when(rest == 0, "").otherwise(F.concat(F.lit(":"), _padded(rest, 2)))
        shown = F.concat(F.lit("GMT"), sign, F.concat(_padded(hours, 2), F.lit(":"), _padded(rest, 2)) if n == 4 else F.concat(_padded(hours, 1), short))
        return F.when(t.offset == 0, "GMT").otherwise(shown)
    colon = F.concat(F.lit(":"), _padded(rest, 2)) if n in (3, 5) else _padded(rest, 2) if n in (2, 4) else F.when(rest == 0, "").otherwise(_padded(rest, 2))
    shown = F.concat(sign, _padded(hours, 2), colon)
    return F.when(t.offset == 0, "Z").otherwise(shown) if letter == "X" else shown


_MONTHS, _SUNDAY_FIRST = list(calendar.month_name)[1:], [calendar.day_name[6], *calendar.day_name[:6]]
_QUARTERS = ["1st quarter", "2nd quarter", "3rd quarter", "4th quarter"]


def _year(value: Column, n: int) -> Column:
    return _padded(value % 100, 2) if n == 2 else _padded(value, n)


def _quarter(t: _Time, n: int) -> Column:
    quarter = F.quarter(t.t)
    return _padded(quarter, n) if n < 3 else F.concat(F.lit("Q"), quarter.cast("string")) if n == 3 else F.element_at(F.array(*map(F.lit, _QUARTERS)), quarter) if n == 4 else quarter.cast("string")


def _period(t: _Time) -> Column:
    """The time of day in words."""
    exact = (t.minute == 0) & (t.second == 0) & (t.micros == 0)
    named = F.when(t.hour < 6, "at night").when(t.hour < 12, "in the morning").when(t.hour < 18, "in the afternoon").when(t.hour < 21, "in the evening").otherwise("at night")
    return F.when(exact & (t.hour == 0), "midnight").when(exact & (t.hour == 12), "noon").otherwise(named)


#: What each letter of a pattern prints at a width, as a column; the same letters as in dates.date_fields().
_COLUMNS: dict[str, Callable[[_Time, int], Column]] = {
    "y": lambda t, n: _year(t.year, n),
    "u": lambda t, n: _year(t.year, n),
    "Y": lambda t, n: _year(t.week_year, n),
    "M": lambda t, n: _padded(t.month, n) if n < 3 else _named(_MONTHS, t.month, n),
    "L": lambda t, n: _padded(t.month, n) if n < 3 else _named(_MONTHS, t.month, n),
    "Q": _quarter,
    "q": _quarter,
    "d": lambda t, n: _padded(t.day, n),
    "D": lambda t, n: _padded(t.day_of_year, n),
    "w": lambda t, n: _padded(t.week, n),
    "W": lambda t, n: _padded(t.week_of_month, n),
    "F": lambda t, n: _padded(F.floor((t.day - 1) / 7) + 1, n),
    "E": lambda t, n: _named(_SUNDAY_FIRST, t.weekday, n),
    "e": lambda t, n: _padded(t.weekday, n) if n < 3 else _named(_SUNDAY_FIRST, t.weekday, n),
    "c": lambda t, n: _padded(t.weekday, n) if n < 3 else _named(_SUNDAY_FIRST, t.weekday, n),
    "G": lambda t, n: F.lit("Anno Domini" if n == 4 else "A" if n == 5 else "AD"),
    "a": lambda t, n: F.when(t.hour < 12, "AM").otherwise("PM"),
    "B": lambda t, n: _period(t),
    "H": lambda t, n: _padded(t.hour, n),
    "k": lambda t, n: _padded(F.when(t.hour == 0, 24).otherwise(t.hour), n),
    "K": lambda t, n: _padded(t.hour % 12, n),
    "h": lambda t, n: _padded((t.hour + 11) % 12 + 1, n),
    "m": lambda t, n: _padded(t.minute, n),
    "s": lambda t, n: _padded(t.second, n),
    "S": lambda t, n: F.left(F.rpad(_padded(t.micros, 6), 9, "0"), F.lit(n)),
    "n": lambda t, n: _padded(t.micros * 1000, n),
    "A": lambda t, n: _padded(t.millis, n),
    "N": lambda t, n: _padded(t.millis * 1_000_000 + t.micros % 1000 * 1000, n),
    "X": lambda t, n: _zone(t, n, "X"),
    "x": lambda t, n: _zone(t, n, "x"),
    "Z": lambda t, n: _zone(t, 2, "x") if n < 4 else _zone(t, 4, "O") if n == 4 else _zone(t, 5, "X"),
    "O": lambda t, n: _zone(t, n, "O"),
    "V": lambda t, n: _zone(t, 5, "X"),
    "z": lambda t, n: _zone(t, 5, "X"),
}


def _shift(operation: str) -> Callable[[Column], Column]:
    """±N and a unit, as in dates: d, M, y, h or m; shorter operations and other units change nothing."""
    if len(operation) < 3 or operation[-1] not in "dMyhm":
        return lambda t: t
    n = int(operation[1:-1]) * (-1 if operation[0] == "-" else 1)
    unit = {"d": "days", "M": "months", "y": "years", "h": "hours", "m": "mins"}[operation[-1]]
    return lambda t: t + F.make_interval(**{unit: F.lit(n)})


def date_column(pattern: str, ts: Column, zone: str = ZONE, operation: str = "") -> Column | None:
    """A time by a date pattern after a shift; None where the pattern isn't one."""
    parts = pattern_parts(pattern)
    if parts is None:
        return None
    t = _Time(ts, zone, _shift(operation))
    shown = [F.lit(p) if isinstance(p, str) else _COLUMNS[p[0]](t, p[1]) for p in parts]
    return F.concat(*shown) if shown else F.lit("")


def variable(expression: str, ts: Column, zone: str = ZONE) -> Column:
    """What dates.evaluate() gives without a context, as a column of a time."""
    literal = F.lit("${" + expression + "}")
    if expression == "timestamp":
        return F.unix_millis(ts.cast("timestamp")).cast("string")
    if expression in ("year", "month", "day"):
        return date_column({"year": "y", "month": "M", "day": "d"}[expression], ts, zone)
    if expression.startswith("today"):
        days = expression[5:]
        return date_column("yyyy-MM-dd", ts, zone, f"{days}d" if days else "") if re.fullmatch(r"([+-]\d+)?", days) else literal
    pattern, colon, operation = expression.partition(":")
    if not colon or expression == "yyyy-MM-dd HH:mm:ss":
        pattern, operation = expression, ""
    shown = date_column(pattern, ts, zone, operation)
    return literal if shown is None else shown


def filled(template: str, ts: Column, context: Column | None = None, zone: str = ZONE) -> Column:
    """The template with each ${...} filled in: by the row's context (a map of strings) where that has it, a null being empty, else
    as a date variable or pattern of the row's time. The text between stays as it is.
    """
    parts, end = [], 0
    for m in TEMPLATE.finditer(template):
        value = variable(m[1], ts, zone)
        if context is not None:
            value = F.when(F.coalesce(F.map_contains_key(context, F.lit(m[1])), F.lit(False)), F.coalesce(F.try_element_at(context, F.lit(m[1])), F.lit(""))).otherwise(value)
        parts += [F.lit(template[end : m.start()]), value]
        end = m.end()
    return F.concat(*parts, F.lit(template[end:]))


def filled_by(templates: dict[str, str], which: Column, ts: Column, context: Column | None = None, zone: str = ZONE) -> Column:
    """Each row's template, told by a name, filled in; null for names without a template."""
    return reduce(lambda rest, name: F.when(which == name, filled(templates[name], ts, context, zone)).otherwise(rest), templates, F.lit(None).cast("string"))


assert set(_COLUMNS) == set(date_fields())
