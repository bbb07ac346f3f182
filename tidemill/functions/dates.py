"""Date templates in ${...}, always in one zone, and time rendering."""

from __future__ import annotations

import calendar
import re
from datetime import datetime, timedelta
from zoneinfo import ZoneInfo

from pyspark.sql import Column
from pyspark.sql import functions as F

ZONE = "Asia/Shanghai"
TEMPLATE = re.compile(r"\$\{([^}]+)}")


def _months(t: datetime, n: int) -> datetime:
    year, month = divmod(t.year * 12 + t.month - 1 + n, 12)
    return t.replace(year=year, month=month + 1, day=min(t.day, calendar.monthrange(year, month + 1)[1]))


def _shift(t: datetime, operation: str) -> datetime:
    """±N and a unit: d, M, y, h or m. Shorter operations and other units change nothing."""
    if len(operation) < 3:
        return t
    n = int(operation[1:-1]) * (-1 if operation[0] == "-" else 1)
    unit = operation[-1]
    if unit in "My":
        return _months(t, n * (12 if unit == "y" else 1))
    step = {"d": timedelta(days=n), "h": timedelta(hours=n), "m": timedelta(minutes=n)}.get(unit)
    return t + step if step is not None else t


_DAYS, _MONTH_NAMES = calendar.day_name, calendar.month_name


def _named(names, k: int, n: int) -> str:
    return names[k][:1] if n == 5 else names[k] if n == 4 else names[k][:3]


def _offset(t: datetime, n: int, letter: str) -> str:
    """+08, +0800 or +08:00, and Z for none where the letter is X."""
    minutes = int(t.utcoffset().total_seconds() // 60) if t.utcoffset() is not None else 0
    if letter == "X" and not minutes:
        return "Z"
    hours, rest = divmod(abs(minutes), 60)
    return f"{'-' if minutes < 0 else '+'}{hours:02d}" + (f":{rest:02d}" if n in (3, 5) else f"{rest:02d}" if n in (2, 4) or rest else "")


def _millis(t: datetime) -> int:
    return ((t.hour * 60 + t.minute) * 60 + t.second) * 1000 + t.microsecond // 1000


def _week(t: datetime, day: int) -> int:
    """The number of the week, from Sunday on, that holds a day counted from 1, where day 1 is in week 1."""
    return (day - 1 + (t.isoweekday() % 7 + 1 - day) % 7) // 7 + 1


def _in_next_year(t: datetime) -> bool:
    """Whether the week, from Sunday on, reaches into the next year, whose first week it then is."""
    return (t + timedelta(days=6 - t.isoweekday() % 7)).year > t.year


def _week_of_year(t: datetime) -> int:
    return 1 if _in_next_year(t) else _week(t, t.timetuple().tm_yday)


def _year(y: int, n: int) -> str:
    return f"{y % 100:02d}" if n == 2 else f"{y:0{n}d}"


def _quarter(t: datetime, n: int) -> str:
    q = (t.month + 2) // 3
    return f"{q:0{n}d}" if n < 3 else f"Q{q}" if n == 3 else f"{('1st', '2nd', '3rd', '4th')[q - 1]} quarter" if n == 4 else str(q)


def _period(t: datetime) -> str:
    if t.hour % 12 == 0 and (t.minute, t.second, t.microsecond) == (0, 0, 0):
        return "noon" if t.hour else "midnight"
    return next(name for until, name in ((6, "at night"), (12, "in the morning"), (18, "in the afternoon"), (21, "in the evening"), (24, "at night")) if t.hour < until)


def _gmt(t: datetime, n: int) -> str:
    minutes = int(t.utcoffset().total_seconds() // 60) if t.utcoffset() is not None else 0
    if not minutes:
        return "GMT"
    hours, rest = divmod(abs(minutes), 60)
    return f"GMT{'-' if minutes < 0 else '+'}" + (f"{hours:02d}:{rest:02d}" if n == 4 else f"{hours}" + (f":{rest:02d}" if rest else ""))


def _weekday(t: datetime, n: int) -> str:
    return f"{t.isoweekday() % 7 + 1:0{n}d}" if n < 3 else _named(_DAYS, t.weekday(), n)


#: Letters of date patterns that are supported: the widths, and what one prints at a given width (names in English, weeks from Sunday on).
_FIELDS = {
    "y": (range(1, 10), lambda t, n: _year(t.year, n)),
    "u": (range(1, 10), lambda t, n: _year(t.year, n)),
    "Y": (range(1, 10), lambda t, n: _year(t.year + _in_next_year(t), n)),
    "M": (range(1, 6), lambda t, n: f"{t.month:0{n}d}" if n < 3 else _named(_MONTH_NAMES, t.month, n)),
    "L": (range(1, 6), lambda t, n: f"{t.month:0{n}d}" if n < 3 else _named(_MONTH_NAMES, t.month, n)),
    "Q": (range(1, 6), _quarter),
    "q": (range(1, 6), _quarter),
    "d": (range(1, 3), lambda t, n: f"{t.day:0{n}d}"),
    "D": (range(1, 4), lambda t, n: f"{t.timetuple().tm_yday:0{n}d}"),
    "w": (range(1, 3), lambda t, n: f"{_week_of_year(t):0{n}d}"),
    "W": (range(1, 2), lambda t, n: str(_week(t, t.day))),
    "F": (range(1, 2), lambda t, n: str((t.day - 1) // 7 + 1)),
    "E": (range(1, 6), lambda t, n: _named(_DAYS, t.weekday(), n)),
    "e": (range(1, 6), _weekday),
    "c": ((1, 3, 4, 5), _weekday),
    "G": (range(1, 6), lambda t, n: "Anno Domini" if n == 4 else "A" if n == 5 else "AD"),
    "a": (range(1, 2), lambda t, n: "AM" if t.hour < 12 else "PM"),
    "B": ((1, 4, 5), lambda t, n: _period(t)),
    "H": (range(1, 3), lambda t, n: f"{t.hour:0{n}d}"),
    "k": (range(1, 3), lambda t, n: f"{t.hour or 24:0{n}d}"),
    "K": (range(1, 3), lambda t, n: f"{t.hour % 12:0{n}d}"),
    "h": (range(1, 3), lambda t, n: f"{(t.hour - 1) % 12 + 1:0{n}d}"),
    "m": (range(1, 3), lambda t, n: f"{t.minute:0{n}d}"),
    "s": (range(1, 3), lambda t, n: f"{t.second:0{n}d}"),
    "S": (range(1, 10), lambda t, n: f"{t.microsecond:06d}".ljust(n, "0")[:n]),
    "n": (range(1, 10), lambda t, n: f"{t.microsecond * 1000:0{n}d}"),
    "A": (range(1, 10), lambda t, n: f"{_millis(t):0{n}d}"),
    "N": (range(1, 16), lambda t, n: f"{_millis(t) * 1_000_000 + t.microsecond % 1000 * 1000:0{n}d}"),
    "X": (range(1, 6), lambda t, n: _offset(t, n, "X")),
    "x": (range(1, 6), lambda t, n: _offset(t, n, "x")),
    "Z": (range(1, 6), lambda t, n: _offset(t, 2, "Z") if n < 4 else _gmt(t, 4) if n == 4 else _offset(t, 5, "X")),
    "O": ((1, 4), _gmt),
    # Times have an offset and no region, so that the offset is their zone's name.
    "V": ((2,), lambda t, n: _offset(t, 5, "X")),
    "z": (range(1, 5), lambda t, n: _offset(t, 5, "X")),
}


def date_fields() -> list[str]:
    return list(_FIELDS)


def pattern_parts(pattern: str) -> list[str | tuple[str, int]] | None:
    """Texts and (letter, width) fields of a date pattern; None where it isn't one. What is optional, in brackets, is printed."""
    out: list[str | tuple[str, int]] = []
    depth = 0
    for m in re.finditer(r"'((?:[^']|'')*)'|([A-Za-z])\2*|(.)", pattern, re.S):
        if m[0][0] == "'" and len(m[0]) > 1:
            out.append(m[1].replace("''", "'") if m[1] else "'")
        elif m[2]:
            if m[2] not in _FIELDS or len(m[0]) not in _FIELDS[m[2]][0]:
                return None
            out.append((m[2], len(m[0])))
        elif m[3] in "[]":
            depth += 1 if m[3] == "[" else -1
            if depth < 0:
                return None
        elif m[3] in "{}#'":
            return None
        else:
            out.append(m[3])
    return out


def format_date(pattern: str, t: datetime) -> str | None:
    """A date by a pattern; null where it isn't one."""
    parts = pattern_parts(pattern)
    return None if parts is None else "".join(p if isinstance(p, str) else _FIELDS[p[0]][1](t, p[1]) for p in parts)


def evaluate(expression: str, context: dict | None = None, now: datetime | None = None) -> str:
    """The value of one template expression: of the context first (null is empty), else of a date variable or pattern."""
    if context and expression in context:
        value = context[expression]
        return "" if value is None else str(value)
    t = (now or datetime.now(ZoneInfo(ZONE))).astimezone(ZoneInfo(ZONE))
    literal = "${" + expression + "}"
    match expression:
        case "today":
            return f"{t:%Y-%m-%d}"
        case "timestamp":
            return str(int(t.timestamp() * 1000))
        case "year" | "month" | "day":
            return str(getattr(t, expression))
    if expression.startswith("today"):
        return f"{t + timedelta(days=int(expression[5:])):%Y-%m-%d}" if re.fullmatch(r"today[+-]\d+", expression) else literal
    pattern, colon, operation = expression.partition(":")
    if colon and expression != "yyyy-MM-dd HH:mm:ss":
        shown = format_date(pattern, _shift(t, operation))
    else:
        shown = format_date(expression, t)
    return literal if shown is None else shown


def substitute(text: str | None, context: dict | None = None, now: datetime | None = None) -> str | None:
    """Text with each ${...} evaluated."""
    return text and TEMPLATE.sub(lambda m: evaluate(m[1], context, now), text)


def local_time(ts: Column, zone: str = ZONE) -> Column:
    """The wall-clock time in the zone, whatever the session's zone is."""
    return F.convert_timezone(F.current_timezone(), F.lit(zone), ts.cast("timestamp").cast("timestamp_ntz"))


def date_variable(name: str, ts: Column) -> Column:
    """A date variable as a column of a timestamp: today, today±N, timestamp, year, month, day, or a pattern[:±NU]."""
    t = local_time(ts)
    if name == "timestamp":
        return F.unix_millis(ts.cast("timestamp")).cast("string")
    if name in ("year", "month", "day"):
        return getattr(F, {"day": "dayofmonth"}.get(name, name))(t).cast("string")
    if name == "today":
        return F.date_format(t, "yyyy-MM-dd")
    if re.fullmatch(r"today[+-]\d+", name):
        return F.date_format(F.date_add(t.cast("date"), int(name[5:])), "yyyy-MM-dd")
    if name.startswith("today"):
        return F.lit("${" + name + "}")
    pattern, colon, operation = name.partition(":")
    if not colon or name == "yyyy-MM-dd HH:mm:ss":
        return F.date_format(t, name)
    if len(operation) >= 3 and operation[-1] in "dMyhm":
        n = int(operation[1:-1]) * (-1 if operation[0] == "-" else 1)
        unit = {"d": "days", "M": "months", "y": "years", "h": "hours", "m": "mins"}[operation[-1]]
        t = t + F.make_interval(**{unit: F.lit(n)})
    return F.date_format(t, pattern)


def iso_offset(ts: Column) -> Column:
    """2024-01-31T08:00:00+08:00, with a fraction only where it isn't zero."""
    t = local_time(ts)
    fraction = F.regexp_replace(F.date_format(t, "SSSSSS"), "0+$", "")
    return F.concat(F.date_format(t, "yyyy-MM-dd'T'HH:mm:ss"), F.when(fraction != "", F.concat(F.lit("."), fraction)).otherwise(""), F.lit("+08:00"))


def duration_ms(start: Column, end: Column) -> Column:
    """Whole elapsed milliseconds, never negative."""
    micros = F.unix_micros(end.cast("timestamp")) - F.unix_micros(start.cast("timestamp"))
    return F.greatest(F.floor(micros / 1000), F.lit(0)).cast("long")
