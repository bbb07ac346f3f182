"""JSON paths: read into steps once, then followed in a document or, as expressions over VARIANT, in a column."""

from __future__ import annotations

import json
import re
from functools import reduce
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

_NAME = r"[\w\-一-鿿]+"
_DOT = re.compile(rf"(\.\.?)(\*|{_NAME})")
_PART = re.compile(r"\s*(-?\d+|'[^']*'|\"[^\"]*\")\s*")
_TOKEN = re.compile(rf"\s*(\(|\)|&&|\|\||==|!=|<=|>=|<|>|!|@(?:\.{_NAME}|\[[^\]]+\])*|'[^']*'|\"[^\"]*\"|[-+\w.]+)")
_OPERATORS = ("==", "!=", "<", "<=", ">", ">=")

#: A step is ("names", [...]), ("places", [...]), ("slice", low, high), ("all",), ("deep",) or ("filter", condition).
Step = tuple


class PathMissing(LookupError):
    """A definite path leads nowhere."""


def _closing(path: str, at: int) -> int:
    """The place of the ] that closes the [ at a place; what is in quotes or in inner brackets doesn't count."""
    depth, quote = 0, ""
    for k in range(at, len(path)):
        c = path[k]
        if quote:
            quote = "" if c == quote else quote
        elif c in "'\"":
            quote = c
        elif c in "[]":
            depth += 1 if c == "[" else -1
            if not depth:
                return k
    raise ValueError(f"a bracket is never closed: {path}")


def _bracket(text: str, path: str) -> Step:
    if text.startswith("?"):
        return ("filter", _condition(text[1:].strip()))
    if text.strip() == "*":
        return ("all",)
    if m := re.fullmatch(r"\s*(-?\d*)\s*:\s*(-?\d*)\s*", text):
        return ("slice", *(int(x) if x else None for x in m.groups()))
    parts, at = [], 0
    while m := _PART.match(text, at):
        parts.append(m[1][1:-1] if m[1][0] in "'\"" else int(m[1]))
        at = m.end()
        if at == len(text) or text[at] != ",":
            break
        at += 1
    if not parts or at != len(text) or len({type(p) for p in parts}) > 1:
        raise ValueError(f"not a path at [{text}]: {path}")
    return ("names" if isinstance(parts[0], str) else "places", parts)


def steps(path: str) -> list[Step]:
    """The steps of a path: $, .name, ['name'], [n], [a:b], [*], .*, ..name, [0,2], ['a','b'] and [?(...)]."""
    if not path.startswith("$"):
        raise ValueError(f"a path starts with $: {path}")
    at, out = 1, []
    while at < len(path):
        if path.startswith("..[", at):
            out.append(("deep",))
            at += 2
        if path[at] == "[":
            end = _closing(path, at)
            out.append(_bracket(path[at + 1 : end], path))
            at = end + 1
        elif m := _DOT.match(path, at):
            out += [("deep",)] if m[1] == ".." else []
            out.append(("all",) if m[2] == "*" else ("names", [m[2]]))
            at = m.end()
        else:
            raise ValueError(f"not a path from {path[at:]!r} on: {path}")
    return out


def is_definite(of: list[Step]) -> bool:
    """Whether a path leads to one value at most."""
    return all(s[0] in ("names", "places") and len(s[1]) == 1 for s in of)


def _condition(text: str) -> tuple:
    """(or, [...]), (and, [...]), (not, x), (has, steps) or (compare, steps, operator, literal); && binds before ||."""
    tokens, at = [], 0
    while at < len(text):
        m = _TOKEN.match(text, at)
        if not m:
            raise ValueError(f"not a filter: {text!r}")
        tokens.append(m[1])
        at = m.end()
    left = tokens[::-1]

    def take(*wanted: str) -> bool:
        if left and left[-1] in wanted:
            left.pop()
            return True
        return False

    def joined(sign: str, kind: str, inner) -> tuple:
        found = [inner()]
        while take(sign):
            found.append(inner())
        return found[0] if len(found) == 1 else (kind, found)

    def either() -> tuple:
        return joined("||", "or", lambda: joined("&&", "and", one))

    def one() -> tuple:
        if take("!"):
            return ("not", one())
        if take("("):
            inside = either()
            if not take(")"):
                raise ValueError(f"a bracket is never closed: {text!r}")
            return inside
        if not left or left[-1][0] != "@":
            raise ValueError(f"not a filter: {text!r}")
        of = steps("$" + left.pop()[1:])
        if not is_definite(of):
            raise ValueError(f"a filter looks at one value: {text!r}")
        if left and left[-1] in _OPERATORS:
            sign = left.pop()
            if not left:
                raise ValueError(f"not a filter: {text!r}")
            literal = left.pop()
            return ("compare", of, sign, literal[1:-1] if literal[0] in "'\"" else json.loads(literal))
        return ("has", of)

    made = either()
    if left:
        raise ValueError(f"not a filter: {text!r}")
    return made


# In a document


def _below(value: Any) -> list:
    found = [value]
    for child in _children(value):
        found += _below(child)
    return found


def _children(value: Any) -> list:
    return list(value.values()) if isinstance(value, dict) else value if isinstance(value, list) else []


def _follow(values: list, step: Step) -> list:
    kind = step[0]
    if kind == "deep":
        return [x for v in values for x in _below(v)]
    if kind == "all":
        return [x for v in values for x in _children(v)]
    if kind == "slice":
        return [x for v in values if isinstance(v, list) for x in v[step[1] : step[2]]]
    if kind == "filter":
        return [x for v in values for x in _children(v) if _holds(x, step[1])]
    if kind == "names":
        return [v[n] for v in values if isinstance(v, dict) for n in step[1] if n in v]
    return [v[n] for v in values if isinstance(v, list) for n in step[1] if -len(v) <= n < len(v)]


def _holds(value: Any, condition: tuple) -> bool:
    kind = condition[0]
    if kind in ("or", "and"):
        return (any if kind == "or" else all)(_holds(value, c) for c in condition[1])
    if kind == "not":
        return not _holds(value, condition[1])
    found = reduce(_follow, condition[1], [value])
    if kind == "has" or not found:
        return bool(found)
    left, sign, right = found[0], *condition[2:]
    number = lambda x: isinstance(x, (int, float)) and not isinstance(x, bool)
    if sign in ("==", "!="):
        return (left == right and number(left) == number(right)) == (sign == "==")
    if not (isinstance(left, str) and isinstance(right, str)) and not (number(left) and number(right)):
        return False
    return {"<": left < right, "<=": left <= right, ">": left > right, ">=": left >= right}[sign]


def read_path(document: Any, path: str) -> Any:
    """The value at a path. A path with *, a slice, a union, a filter or .. gives the list of what it matches, maybe none; any other
    gives its value or raises PathMissing. A comparison with a missing value fails, whatever the operator.
    """
    of = steps(path)
    values = reduce(_follow, of, [document])
    if not is_definite(of):
        return values
    if not values:
        raise PathMissing(path)
    return values[0]


# In a column


def _array(v: Column) -> Column:
    return F.try_variant_get(v, "$", "array<variant>")


def _object(v: Column) -> Column:
    return F.try_variant_get(v, "$", "map<string,variant>")


def _children_column(v: Column) -> Column:
    return F.coalesce(_array(v), F.map_values(_object(v)), F.array().cast("array<variant>"))


def _member(v: Column, part: str | int) -> Column:
    """A member of an object or an element of an array; null where it isn't there."""
    if isinstance(part, str):
        return F.try_variant_get(v, f"$['{part}']", "variant") if re.fullmatch(r"[\w \-]+", part) else F.try_element_at(_object(v), F.lit(part))
    return F.try_variant_get(v, f"$[{part}]", "variant") if part >= 0 else F.try_element_at(_array(v), F.lit(part))


def _found(values: Column) -> Column:
    return F.filter(values, lambda x: x.isNotNull())


def _sliced(v: Column, low: int | None, high: int | None) -> Column:
    a, n = _array(v), F.size(_array(v))
    at = lambda k: F.least(F.lit(k), n) if k >= 0 else F.greatest(n + k, F.lit(0))
    begin, end = at(low or 0), n if high is None else at(high)
    return F.coalesce(F.slice(a, begin + 1, F.greatest(end - begin, F.lit(0))), F.array().cast("array<variant>"))


def _follow_column(values: Column, step: Step, depth: int) -> Column:
    kind = step[0]
    if kind == "all":
        return F.flatten(F.transform(values, _children_column))
    if kind == "slice":
        return F.flatten(F.transform(values, lambda v: _sliced(v, *step[1:])))
    if kind == "filter":
        return F.filter(F.flatten(F.transform(values, _children_column)), lambda x: _holds_column(x, step[1]))
    if kind in ("names", "places"):
        return _found(F.flatten(F.transform(values, lambda v: F.array(*(_member(v, p) for p in step[1])))))
    level, every = values, [values]
    for _ in range(depth):
        level = F.flatten(F.transform(level, _children_column))
        every.append(level)
    deeper = F.exists(level, lambda v: F.size(_children_column(v)) > 0)
    return F.when(deeper, F.raise_error(F.lit(f"a document is nested over {depth} deep"))).otherwise(F.concat(*every))


_NUMBERS = r"^(TINYINT|SMALLINT|INT|BIGINT|FLOAT|DOUBLE|DECIMAL.*)$"


def _holds_column(value: Column, condition: tuple) -> Column:
    kind = condition[0]
    if kind in ("or", "and"):
        return reduce((lambda a, b: a | b) if kind == "or" else (lambda a, b: a & b), (_holds_column(value, c) for c in condition[1]))
    if kind == "not":
        return ~_holds_column(value, condition[1])
    left = reduce(lambda v, s: _member(v, s[1][0]), condition[1], value)
    if kind == "has":
        return left.isNotNull()
    sign, right = condition[2:]
    held = F.schema_of_variant(left)
    if right is None:
        alike, read = F.is_variant_null(left), None
    elif isinstance(right, bool):
        alike, read = held == "BOOLEAN", F.try_variant_get(left, "$", "boolean")
    elif isinstance(right, str):
        alike, read = held == "STRING", F.try_variant_get(left, "$", "string")
    else:
        alike, read = held.rlike(_NUMBERS), F.try_variant_get(left, "$", "double")
    # Reading a value is cheap, telling its type isn't, so the type is looked at where the value fits.
    equal = alike if read is None else (read == F.lit(right)) & alike
    if sign in ("==", "!="):
        made = equal if sign == "==" else ~F.coalesce(equal, F.lit(False))
    elif read is None or isinstance(right, bool):
        made = F.lit(False)
    else:
        limit = F.lit(right if isinstance(right, str) else float(right))
        made = {"<": read < limit, "<=": read <= limit, ">": read > limit, ">=": read >= limit}[sign] & alike
    return left.isNotNull() & F.coalesce(made, F.lit(False))


def path_values(document: Column, path: str, depth: int = 8) -> Column:
    """All that a path matches in a VARIANT column, as array<variant>; null documents have none.

    Members of objects come in the order of their names, and .. goes level by level; documents in which it would go over `depth`
    levels raise an error. Every step is an expression on the row, so that Spark compiles the path into its plan.
    """
    start = F.when(document.isNotNull(), F.array(document)).otherwise(F.array().cast("array<variant>"))
    return reduce(lambda v, s: _follow_column(v, s, depth), steps(path), start)


def path_value(document: Column, path: str, kind: str = "variant") -> Column:
    """The value at a definite path as a type, null where it is missing or of another type."""
    of = steps(path)
    if not is_definite(of):
        raise ValueError(f"the path may match several values: {path}")
    found = reduce(lambda v, s: _member(v, s[1][0]), of, document)
    return found if kind == "variant" else F.try_variant_get(found, "$", kind)
