"""Scalar functions over text: masking, truncation, rendering and name rules."""

from __future__ import annotations

import base64
import urllib.parse

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SANITIZED_LENGTH = 2000
KEPT_LENGTH = 16_384


def mask_secrets(c: Column) -> Column:
    """Keys after sk- and tokens after Bearer become ***."""
    return F.regexp_replace(F.regexp_replace(c, r"(sk-)[\w-]+", "$1***"), r"(Bearer\s+)\S+", "$1***")


def sanitize(c: Column, length: int = SANITIZED_LENGTH) -> Column:
    """Masked, and cut to `length` characters with a mark."""
    masked = mask_secrets(c)
    return F.when(F.length(masked) > length, F.concat(F.left(masked, F.lit(length)), F.lit("...(truncated)"))).otherwise(masked)


def truncate_head_tail(c: Column, most: int = KEPT_LENGTH, marker: str = "\n...(truncated)...\n") -> Column:
    """Three quarters from the head and the rest from the tail, each masked; the head alone where no tail fits."""
    head = most * 3 // 4
    tail = most - head - len(marker)
    cut = F.concat(mask_secrets(F.left(c, F.lit(head))), F.lit(marker), mask_secrets(F.right(c, F.lit(tail)))) if tail >= 1 else mask_secrets(F.left(c, F.lit(most)))
    return F.when(F.length(c) > most, cut).otherwise(mask_secrets(c))


def window_head(c: Column, keep: int = KEPT_LENGTH) -> Column:
    return F.left(c, F.lit(keep))


def window_tail(c: Column, keep: int = KEPT_LENGTH) -> Column:
    """What follows the head of a long result: how much is left out, the last characters, and a notice; null if it fits."""
    total = F.length(c)
    tail = F.least(total - keep, F.lit(keep))
    notice = F.concat(
        F.lit("\n...[中间省略 "), (total - keep - tail).cast("string"), F.lit(" 字符]...\n"), F.right(c, tail), F.lit("\n...[输出已截断，共 "), total.cast("string"), F.lit(f" 字符，仅保留首尾各 {keep} 字符]...\n")
    )
    return F.when(total > keep, notice)


def mask_password(c: Column) -> Column:
    return F.when(F.length(c) > 0, F.lit("****...****")).otherwise(c)


def mask_credential(c: Column) -> Column:
    return F.when(F.length(c) > 4, F.concat(F.left(c, F.lit(4)), F.lit("****"))).when(F.length(c) > 0, F.lit("****")).otherwise(c)


def shorten(c: Column, n: int) -> Column:
    """At most n characters, with an ellipsis where it was cut."""
    return F.when(F.length(c) > n, F.concat(F.left(c, F.lit(n)), F.lit("…"))).otherwise(c)


#: Largest lengths of names by kind.
NAME_LENGTHS = {"datasource": 100, "agent": 64, "model_profile": 32, "skill": 128}


def valid_name(c: Column, most: int) -> Column:
    """Starts with a Han character or a letter; then those, digits, _ and -; `most` characters in all."""
    return c.rlike(rf"^[\p{{IsHan}}a-zA-Z][\p{{IsHan}}a-zA-Z0-9_-]{{0,{most - 1}}}$")


def quote_identifier(name: str, mark: str = '"') -> str:
    if not name or not name.strip():
        raise ValueError("an identifier can't be blank")
    return mark + name.replace(mark, mark * 2) + mark


def url_pairs(names: Column, values: Column) -> Column:
    """name=value pairs, form-encoded, joined by &; pairs with a blank name or a null value are left out."""
    pairs = F.filter(F.arrays_zip(names.alias("k"), values.alias("v")), lambda p: (F.trim(p["k"]) != "") & p["v"].isNotNull())
    return F.array_join(F.transform(pairs, lambda p: F.concat(F.url_encode(p["k"]), F.lit("="), F.url_encode(p["v"]))), "&")


def form_encode(pairs: dict[str, str | None]) -> str:
    return "&".join(f"{urllib.parse.quote_plus(k, safe='*-._')}={urllib.parse.quote_plus(v, safe='*-._')}" for k, v in pairs.items() if k and k.strip() and v is not None)


def basic_credential(user: Column, password: Column) -> Column:
    return F.base64(F.concat(F.coalesce(user, F.lit("")), F.lit(":"), F.coalesce(password, F.lit(""))).cast("binary"))


def basic_credential_of(user: str | None, password: str | None) -> str:
    return base64.b64encode(f"{user or ''}:{password or ''}".encode()).decode()


def type_label(kind: Column, sub_type: Column) -> Column:
    return F.concat_ws(":", kind, F.when(F.trim(sub_type) != "", sub_type))


def model_id(api_format: Column, model: Column, native: str = "NATIVE") -> Column:
    """format:model in lower case, or the model alone for the native format."""
    return F.when(F.upper(api_format) == native, model).otherwise(F.concat(F.lower(api_format), F.lit(":"), model))


def strict_version(c: Column) -> Column:
    """A positive integer written in digits alone, else null."""
    n = F.when(c.rlike(r"^\d+$"), c.try_cast("int"))
    return F.when(n >= 1, n)


def lenient_version(c: Column) -> Column:
    return F.coalesce(F.trim(c).try_cast("int"), F.lit(0))


def parse_offset(c: Column) -> Column:
    """The sequence number to resume after: blank, malformed and negative ones are 0."""
    return F.greatest(F.coalesce(F.trim(c).try_cast("bigint"), F.lit(0).cast("bigint")), F.lit(0).cast("bigint"))


def rendered(df: DataFrame, order: str | None = None) -> DataFrame:
    """A text table, (line_no, line): a header 'columns:a,b', then comma-joined rows with null for nulls."""
    row = F.concat_ws(",", *(F.coalesce(F.col(c).cast("string"), F.lit("null")) for c in df.columns))
    if not df.columns:
        return df.sparkSession.createDataFrame([(0, "no data")], "line_no int, line string")
    from pyspark.sql import Window

    lines = df.select(F.row_number().over(Window.orderBy(order or df.columns[0])).alias("line_no"), row.alias("line"))
    header = df.sparkSession.createDataFrame([(0, "columns:" + ",".join(df.columns))], "line_no int, line string")
    return header.unionByName(lines)
