"""JSON: rows of a response, and fields inferred from a sample."""

from __future__ import annotations

import json
from collections import Counter
from collections.abc import Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemill.functions.paths import PathMissing, read_path


def as_rows(data: Any) -> list[dict]:
    """Rows of a response: one of an object, one for each element of an array, none of null. Null elements are empty rows."""
    if data is None:
        return []
    rows = data if isinstance(data, list) else [data]
    if any(r is not None and not isinstance(r, dict) for r in rows):
        raise ValueError("a response row must be an object")
    return [dict(r) if r else {} for r in rows]


def parse_response(body: str, path: str | None = None, total_path: str | None = None) -> tuple[list[dict], int | None, bool]:
    """(rows, total count, whether there may be more). A missing path has no rows, no total and no more."""
    document = json.loads(body)
    try:
        rows = as_rows(read_path(document, path) if path and path.strip() else document)
    except PathMissing:
        return [], None, False
    total = None
    if total_path and total_path.strip():
        try:
            total = int(read_path(document, total_path))
        except (LookupError, ValueError, TypeError):
            total = None
    return rows, total, bool(rows) and not (total is not None and len(rows) >= total)


def type_label(value: Any) -> str:
    if isinstance(value, bool):
        return "boolean"
    if isinstance(value, (int, float)):
        return "number"
    return "object" if isinstance(value, dict) else "array" if isinstance(value, list) else "string"


def _root(document: Any, path: str) -> Any:
    path = path.removesuffix(".*").removesuffix("[*]") if path not in ("$", "$.*") else "$"
    value = read_path(document, path)
    return value[0] if isinstance(value, list) and value else value


def _fields(value: dict, parent: str) -> list[dict]:
    out = []
    for name, v in value.items():
        path = f"{parent}.{name}"
        inner, below = v, path
        if isinstance(v, list):
            inner, below = (v[0] if v else None), f"{path}.*"
        out.append({"name": name, "json_path": path, "type": type_label(v), "children": _fields(inner, below) if isinstance(inner, dict) else []})
    return out


def field_tree(sample: str, path: str = "$") -> list[dict]:
    """Nested fields of a JSON sample; arrays show their first element. A scalar or empty root has none."""
    try:
        value = _root(json.loads(sample), path)
    except PathMissing:
        return []
    return _fields(value, path) if isinstance(value, dict) else []


def flat_fields(sample: str, path: str = "$") -> list[dict]:
    """The same fields in one list, parents first. A root that is null or scalar is an error; an empty array has none."""
    value = _root(json.loads(sample), path)
    if value == []:
        return []
    if not isinstance(value, dict):
        raise ValueError("fields can be inferred from an object or an array of objects only")

    def flat(fields: list[dict]) -> list[dict]:
        return [x for f in fields for x in ({k: v for k, v in f.items() if k != "children"}, *flat(f["children"]))]

    return flat(_fields(value, path))


def _counted_fields(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()
        for b in batches:
            for body in b.column(0):
                try:
                    root = _root(json.loads(body.as_py()), path)
                except (ValueError, PathMissing):
                    root = None
                if not isinstance(root, dict):
                    seen["", "", "none", 0] += 1
                    continue
                queue = [(f, "", 1) for f in _fields(root, path)]
                for f, parent, depth in queue:
                    seen[f["json_path"], parent, f["type"], depth] += 1
                    queue += [(x, f["json_path"], depth + 1) for x in f["children"]]
            if len(seen) > 50_000:
                yield _field_batch(seen)
                seen = Counter()
        yield _field_batch(seen)

    return run


def _field_batch(seen: Counter) -> pa.RecordBatch:
    at, parent, kind, depth = zip(*seen) if seen else ((), (), (), ())
    return pa.RecordBatch.from_arrays([pa.array(at, pa.string()), pa.array(parent, pa.string()), pa.array(kind, pa.string()), pa.array(depth, pa.int32()), pa.array(seen.values(), pa.int64())], ["json_path", "parent", "type", "depth", "n"])


def field_profile(documents: DataFrame, json_col: str, path: str = "$") -> DataFrame:
    """(json_path, parent, depth, name, type, types, n): the field tree of a whole table of JSON texts, a row a field.

    Of each text the fields are those of field_tree(): arrays show their first element. A field's type is the one most texts have (ties: the
    first by name), types has the number of texts of each, n is their sum. Texts without fields, malformed ones too, are
    counted in a row whose path is empty and whose type is `none`; null texts are left out. Tasks count what they see, and
    only counts are shuffled, so that the work is one pass whatever the number of texts.
    """
    rows = documents.select(F.col(json_col).cast("string").alias("body")).filter("body IS NOT NULL")
    counts = rows.mapInArrow(_counted_fields(path), "json_path string, parent string, type string, depth int, n long").groupBy("json_path", "parent", "depth", "type").agg(F.sum("n").alias("n"))
    fields = counts.groupBy("json_path").agg(F.min("parent").alias("parent"), F.min("depth").alias("depth"), F.min(F.struct((-F.col("n")).alias("minus"), "type"))["type"].alias("type"), F.map_from_entries(F.array_sort(F.collect_list(F.struct("type", "n")))).alias("types"), F.sum("n").alias("n"))
    return fields.select("json_path", F.nullif("parent", F.lit("")).alias("parent"), "depth", F.regexp_extract("json_path", r"([^.]*)$", 1).alias("name"), "type", "types", "n")


def type_label_column(variant: Column) -> Column:
    """The same labels for a VARIANT column."""
    kind = F.schema_of_variant(variant)
    return (
        F.when(kind.startswith("OBJECT"), "object").when(kind.startswith("ARRAY"), "array").when(kind == "BOOLEAN", "boolean").when(kind.rlike("^(BIGINT|INT|SMALLINT|TINYINT|DOUBLE|FLOAT|DECIMAL)"), "number").otherwise("string")
    )


def total_count(body: Column, path: str) -> Column:
    """A total at a path, a number or a numeric string; null for anything else."""
    return F.get_json_object(body, path).try_cast("int")


def has_more(rows: Column, total: Column) -> Column:
    return (rows > 0) & ~F.coalesce(rows >= total, F.lit(False))


def exploded(df, json_col: str, schema: str):
    """One row for each element of a JSON array of objects, in order: position and row."""
    return df.select(*[c for c in df.columns if c != json_col], F.posexplode(F.from_json(json_col, f"array<{schema}>")).alias("position", "row"))


def lenient_object(c: Column) -> Column:
    """The JSON object as text, {} for blank, malformed or null text."""
    parsed = F.try_parse_json(c)
    return F.when(parsed.isNotNull() & F.schema_of_variant(parsed).startswith("OBJECT"), F.to_json(parsed)).otherwise("{}")


def strict_ids(c: Column) -> Column:
    """A JSON array of ids; blank is empty, malformed raises."""
    return F.when(c.isNull() | (F.trim(c) == ""), F.array().cast("array<bigint>")).otherwise(F.from_json(c, "array<bigint>", {"mode": "FAILFAST"}))
