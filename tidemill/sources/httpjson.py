"""HTTP/JSON endpoints as a Spark data source, `httpjson`.

Options: url, method, params, headers, body, body_type, auth, json_path, pagination, pre_operations, retry, timeout, limit,
context, raw - each text, structured ones as JSON. Rows follow the given schema; without one there is a single column
`row` with each row as JSON (or `value` with the body as it came, with raw).
"""

from __future__ import annotations

import json
import time
import urllib.error
import urllib.parse
import urllib.request
from collections.abc import Iterator
from datetime import date, datetime, timezone
from decimal import Decimal
from typing import Any

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import ArrayType, BooleanType, DataType, DateType, DecimalType, DoubleType, FloatType, IntegerType, LongType, MapType, ShortType, StringType, StructField, StructType, TimestampType

from tidemill.functions.dates import substitute
from tidemill.functions.jsons import PathMissing, field_tree, parse_response, read_path
from tidemill.functions.text import basic_credential_of, form_encode

DEFAULT_PAGES, DEFAULT_SIZE, DEFAULT_TIMEOUT = 100, 100, 180
MOST_RETRIES, LONGEST_WAIT = 5, 30.0
_STRUCTURED = ("params", "headers", "auth", "pagination", "pre_operations", "context")


def overlay(endpoint: dict[str, Any], override: dict[str, Any] | None) -> dict[str, Any]:
    """The endpoint's settings with those of a table over them, field by field; authentication is never overridden."""
    return endpoint | {k: v for k, v in (override or {}).items() if v is not None and k != "auth"}


def check_pagination(p: dict[str, Any]) -> dict[str, Any]:
    size, pages = p.get("size") or DEFAULT_SIZE, p.get("max_pages") or DEFAULT_PAGES
    if not 1 <= size <= 500 or not 1 <= pages <= 10_000:
        raise ValueError("a page holds 1 to 500 rows and there are 1 to 10000 pages")
    return {"type": (p.get("type") or "NONE").upper(), "size": size, "max_pages": pages, "total_path": p.get("total_path"), "page_param": p.get("page_param"), "size_param": p.get("size_param")}


def waits(retries: int | None) -> list[float]:
    """Seconds before each retry: doubling from one, at most half a minute, five retries at most."""
    return [min(1.0 * 2**k, LONGEST_WAIT) for k in range(min(max(retries or 0, 0), MOST_RETRIES))]


def with_query(url: str, pairs: dict[str, str | None]) -> str:
    """The url with more query pairs, encoded; what is there already stays in front."""
    encoded = form_encode(pairs)
    if not encoded:
        return url
    parts = urllib.parse.urlsplit(url)
    return urllib.parse.urlunsplit((parts.scheme, parts.netloc, parts.path, f"{parts.query}&{encoded}" if parts.query else encoded, ""))


def build(settings: dict[str, Any], context: dict[str, Any], bound: list[tuple[str, str, str]] = ()) -> urllib.request.Request:
    """One request. bound: (location, name, value) of what pre-operations give to headers or the query."""
    fill = lambda v: substitute(None if v is None else str(v), context)
    method, kind = (settings.get("method") or "GET").upper(), (settings.get("body_type") or "JSON").upper()
    params = {k: fill(v) for k, v in (settings.get("params") or {}).items()}
    headers = {k: fill(v) for k, v in (settings.get("headers") or {}).items() if v is not None}
    form = method == "POST" and kind == "FORM_URLENCODED"
    url = fill(settings["url"])
    if not form:
        url = with_query(url, params)
    url = with_query(url, {n: v for where, n, v in bound if where == "QUERY"})
    headers |= {n: v for where, n, v in bound if where == "HEADER"}
    auth = settings.get("auth") or {}
    if (auth.get("type") or "").upper() == "BASIC":
        headers["Authorization"] = "Basic " + basic_credential_of(fill(auth.get("username")), fill(auth.get("password")))
    body = form_encode(params) if form else fill(settings.get("body"))
    if body is not None and method != "GET":
        default = {"FORM_URLENCODED": "application/x-www-form-urlencoded", "JSON": "application/json", "RAW": "text/plain"}[kind]
        if not any(k.lower() == "content-type" for k in headers):
            headers["Content-Type"] = default
    return urllib.request.Request(url, data=body.encode() if body is not None and method != "GET" else None, headers=headers, method=method)


def attempt(fetch, retries: int | None, sleep=time.sleep):
    """The result of fetch(), tried again after any failure, of transport, status or content."""
    for wait in [*waits(retries), None]:
        try:
            return fetch()
        except Exception:
            if wait is None:
                raise
            sleep(wait)
    raise AssertionError


def send(request: urllib.request.Request, timeout: float) -> str:
    with urllib.request.urlopen(request, timeout=timeout) as answer:  # noqa: S310  raises for other than 2xx
        return answer.read().decode("utf-8")


def prepare(settings: dict[str, Any], context: dict[str, Any], sleep=time.sleep) -> tuple[dict[str, Any], list[tuple[str, str, str]]]:
    """Runs the pre-operations in order: (context with all bound values, those that go to headers or the query)."""
    context, bound = dict(context), []
    for op in settings.get("pre_operations") or []:
        if not op.get("enabled", True):
            continue
        timeout = float(settings.get("timeout") or DEFAULT_TIMEOUT)
        body = attempt(lambda op=op: send(build(op, context), timeout), settings.get("retry"), sleep)
        for mapping in op.get("mappings") or []:
            try:
                value = read_path(json.loads(body), mapping["json_path"])
            except (PathMissing, ValueError):
                continue
            context[mapping["name"]] = value
            if mapping.get("location", "BODY").upper() in ("HEADER", "QUERY"):
                bound.append((mapping["location"].upper(), mapping.get("target") or mapping["name"], str(value)))
    return context, bound


def fetch_page(settings: dict[str, Any], context: dict[str, Any], bound, sleep=time.sleep) -> tuple[list[dict], int | None, bool]:
    p = check_pagination(settings.get("pagination") or {})
    named = dict(settings)
    if p["page_param"] and "page" in context:
        named["params"] = (settings.get("params") or {}) | {p["page_param"]: "${page}"} | ({p["size_param"]: "${size}"} if p["size_param"] else {})
    timeout = float(settings.get("timeout") or DEFAULT_TIMEOUT)
    return attempt(lambda: parse_response(send(build(named, context, bound), timeout), settings.get("json_path"), p["total_path"]), settings.get("retry"), sleep)


def page_context(context: dict[str, Any], number: int, size: int) -> dict[str, Any]:
    return context | {"pageNumber": number, "pageSize": size, "page": number, "size": size}


def pages(settings: dict[str, Any], context: dict[str, Any], bound, first: int = 1, last: int | None = None, limit: int = 0, sleep=time.sleep) -> Iterator[dict]:
    """Rows of pages first to last, until one is empty, the limit or the total is reached, or there is no more."""
    p = check_pagination(settings.get("pagination") or {})
    if p["type"] != "PAGE_BASED":
        rows = fetch_page(settings, context, bound, sleep)[0]
        yield from rows[:limit] if limit > 0 else rows
        return
    seen = 0
    for number in range(first, min(last or p["max_pages"], p["max_pages"]) + 1):
        rows, total, more = fetch_page(settings, page_context(context, number, p["size"]), bound, sleep)
        for row in rows:
            if 0 < limit <= seen:
                return
            seen += 1
            yield row
        if not rows or not more or (0 < limit <= seen) or (total is not None and (first - 1) * p["size"] + seen >= total):
            return


def _settings(options: dict[str, str]) -> dict[str, Any]:
    # Options come with lower-case names.
    out: dict[str, Any] = {k: json.loads(v) if k in _STRUCTURED and v else v for k, v in options.items()}
    out["retry"] = int(out["retry"]) if out.get("retry") else None
    return out


class Pages(InputPartition):
    def __init__(self, first: int, last: int | None, context: dict, bound: list, limit: int):
        super().__init__((first, last))
        self.first, self.last, self.context, self.bound, self.limit = first, last, context, bound, limit


_RANGES = {ShortType: 16, IntegerType: 32, LongType: 64}


def convert(v: Any, kind: DataType) -> Any:
    """A JSON value in a column's type, down into arrays, maps and structs; null where it doesn't fit.

    Whole numbers only are integers. Dates and timestamps come as ISO text, decimals as numbers or text; text columns hold
    the JSON of values that are no text. Types that JSON has no form for are refused when the source is opened.
    """
    if v is None:
        return None
    if isinstance(kind, StringType):
        return v if isinstance(v, str) else json.dumps(v, ensure_ascii=False)
    try:
        if isinstance(kind, BooleanType):
            return v if isinstance(v, bool) else None
        if isinstance(kind, ArrayType):
            return [convert(x, kind.elementType) for x in v] if isinstance(v, list) else None
        if isinstance(kind, MapType):
            return {k: convert(x, kind.valueType) for k, x in v.items()} if isinstance(v, dict) else None
        if isinstance(kind, StructType):
            return tuple(convert(v.get(f.name), f.dataType) for f in kind.fields) if isinstance(v, dict) else None
        if isinstance(kind, DateType):
            return date.fromisoformat(v[:10])
        if isinstance(kind, TimestampType):
            at = datetime.fromisoformat(v)
            return at if at.tzinfo else at.replace(tzinfo=timezone.utc)
        if isinstance(v, bool) or not isinstance(v, (int, float, str)):
            return None
        if isinstance(kind, DecimalType):
            number = Decimal(str(v)).quantize(Decimal(1).scaleb(-kind.scale))
            return number if len(number.as_tuple().digits) <= kind.precision else None
        if isinstance(kind, (DoubleType, FloatType)):
            return float(v)
        number = Decimal(str(v))
        return int(number) if number == int(number) and -(2 ** (_RANGES[type(kind)] - 1)) <= number < 2 ** (_RANGES[type(kind)] - 1) else None
    except (TypeError, ValueError, ArithmeticError):
        return None


def check_type(kind: DataType) -> None:
    plain = (StringType, BooleanType, DoubleType, FloatType, DecimalType, DateType, TimestampType, *_RANGES)
    if isinstance(kind, ArrayType):
        check_type(kind.elementType)
    elif isinstance(kind, MapType) and isinstance(kind.keyType, StringType):
        check_type(kind.valueType)
    elif isinstance(kind, StructType):
        for f in kind.fields:
            check_type(f.dataType)
    elif not isinstance(kind, plain):
        raise ValueError(f"a JSON source has no columns of type {kind.simpleString()}")


class Reader(DataSourceReader):
    """Pre-operations run once, in planning. With a total, page ranges are read in parallel; without one, in one task."""

    def __init__(self, options: dict[str, str], schema: StructType):
        check_type(schema)
        self.settings, self.schema = _settings(options), schema
        self.limit = int(options.get("limit") or 0)
        self.tasks = int(options.get("tasks") or 8)
        self.raw = str(options.get("raw", "")).lower() == "true"

    def partitions(self) -> list[InputPartition]:
        context, bound = prepare(self.settings, self.settings.get("context") or {})
        p = check_pagination(self.settings.get("pagination") or {})
        if self.raw or p["type"] != "PAGE_BASED" or not p["total_path"]:
            return [Pages(1, None, context, bound, self.limit)]
        _, total, _ = fetch_page(self.settings, page_context(context, 1, p["size"]), bound)
        if total is None:
            return [Pages(1, None, context, bound, self.limit)]
        wanted = min(total, self.limit) if self.limit > 0 else total
        count = max(1, min(-(-wanted // p["size"]), p["max_pages"]))
        each = -(-count // self.tasks)
        return [Pages(k, min(k + each - 1, count), context, bound, max(0, self.limit - (k - 1) * p["size"]) if self.limit > 0 else 0) for k in range(1, count + 1, each)]

    def read(self, partition: Pages) -> Iterator[tuple]:
        if self.raw:
            timeout = float(self.settings.get("timeout") or DEFAULT_TIMEOUT)
            yield (attempt(lambda: send(build(self.settings, partition.context, partition.bound), timeout), self.settings.get("retry")),)
            return
        for row in pages(self.settings, partition.context, partition.bound, partition.first, partition.last, partition.limit):
            if self.schema.names == ["row"]:
                yield (json.dumps(row, ensure_ascii=False),)
            else:
                yield tuple(convert(row.get(f.name), f.dataType) for f in self.schema.fields)


class HttpJson(DataSource):
    @classmethod
    def name(cls) -> str:
        return "httpjson"

    def schema(self) -> StructType:
        return StructType([StructField("value" if str(self.options.get("raw", "")).lower() == "true" else "row", StringType())])

    def reader(self, schema: StructType) -> Reader:
        return Reader({k.lower(): v for k, v in self.options.items()}, schema)


def register(spark) -> None:
    spark.dataSource.register(HttpJson)


def test_endpoints(endpoints: dict[str, dict[str, Any]], sleep=time.sleep) -> dict[str, str | None]:
    """Why each endpoint of a connection can't be fetched, None where it can; the connection works if all can."""
    out: dict[str, str | None] = {}
    for name, settings in endpoints.items():
        try:
            context, bound = prepare(settings, settings.get("context") or {}, sleep)
            p = check_pagination(settings.get("pagination") or {})
            fetch_page(settings, page_context(context, 1, p["size"]) if p["type"] == "PAGE_BASED" else context, bound, sleep)
            out[name] = None
        except Exception as e:  # noqa: BLE001  any failure is the answer
            out[name] = str(e) or type(e).__name__
    return out


test_endpoints.__test__ = False


def sample(body: str, json_path: str = "$", rows: int = 10) -> tuple[list[dict], list[dict]]:
    """(field tree, first rows) of a response, as a user is shown them."""
    return field_tree(body, json_path), parse_response(body, json_path)[0][:rows]
