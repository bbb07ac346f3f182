"""Catalogue queries as DataFrame transforms: live rows, filters, pages, latest versions and reference checks."""

from __future__ import annotations

import functools
import math
import operator
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def live(df: DataFrame, flag: str = "is_deleted") -> DataFrame:
    """Rows that aren't soft-deleted."""
    return df.filter(F.col(flag) == 0)


def keyword(df: DataFrame, column: str, word: str | None) -> DataFrame:
    """LIKE '%word%', in which % and _ of the word keep their meaning; a blank word filters nothing."""
    return df.filter(F.col(column).like(f"%{word}%")) if word and word.strip() else df


def conditions(df: DataFrame, like: dict[str, str | None] | None = None, equal: dict[str, object] | None = None, among: dict[str, Sequence | None] | None = None) -> DataFrame:
    """The optional predicates that are given, all of them; None and blank ones are left out."""
    given = lambda v: v is not None and not (isinstance(v, str) and not v.strip())
    parts = [F.col(c).like(f"%{v}%") for c, v in (like or {}).items() if given(v)]
    parts += [F.col(c) == v for c, v in (equal or {}).items() if given(v)]
    parts += [F.col(c).isin(list(v)) for c, v in (among or {}).items() if v]
    return df.filter(functools.reduce(operator.and_, parts)) if parts else df


def not_archived(df: DataFrame, include_archived: bool = False) -> DataFrame:
    return df if include_archived else df.filter(~F.col("archived"))


def point_lookup(df: DataFrame, **key: object) -> DataFrame:
    return conditions(df, equal=key).limit(1)


def page(df: DataFrame, number: int, size: int, *order: Column | str) -> DataFrame:
    """Page `number` (from 1) of `size` rows. The order must be total, else pages may overlap."""
    return df.orderBy(*order).offset((number - 1) * size).limit(size)


#: (default size, largest size) by kind of list; None: not limited.
PAGE_RULES = {"datasource": (20, None), "table": (50, None), "agent": (20, 100), "model_profile": (20, 100), "skill": (20, 100)}


def clamp_page(kind: str, number: int, size: int) -> tuple[int, int]:
    """The page and size that count: pages from 1, sizes from 1 up to the kind's limit. Sessions reject instead."""
    if kind == "session":
        if not 1 <= size <= 100:
            raise ValueError("a session page holds 1 to 100 rows")
        return max(number, 1), size
    default, most = PAGE_RULES[kind]
    size = size if size > 0 else default
    return max(number, 1), min(size, most) if most else size


def clamp_preview(rows: int | None, default: int = 100) -> int:
    return min(max(default if rows is None else rows, 1), 100)


def next_page(number: int, size: int, total: int) -> int | None:
    return number + 1 if number < math.ceil(total / size) else None


def next_page_column(number: Column, size: Column, total: Column) -> Column:
    return F.when(number < F.ceil(total / size), number + 1)


def count_rows(df: DataFrame, name: str = "total") -> DataFrame:
    return df.agg(F.count("*").alias(name))


def latest(df: DataFrame, key: str, version: str, *order: Column) -> DataFrame:
    """The row of the largest version of each key, with all its columns."""
    w = Window.partitionBy(key).orderBy(F.col(version).desc(), *order)
    return df.withColumn("_rank", F.row_number().over(w)).filter("_rank = 1").drop("_rank")


def latest_version(df: DataFrame, key: str, version: str) -> DataFrame:
    """(key, largest version): a plain aggregate, which combines before its shuffle."""
    return df.groupBy(key).agg(F.max(version).alias(version))


def latest_pointer(df: DataFrame, key: str, version: str, *columns: str) -> DataFrame:
    """The columns of each key's largest version, by max_by instead of a sort."""
    return df.groupBy(key).agg(F.max(version).alias(version), *(F.max_by(c, version).alias(c) for c in columns))


def group_count(df: DataFrame, key: str, name: str = "total") -> DataFrame:
    """How many keys there are; filter first to count keys with any matching version."""
    return df.groupBy(key).count().agg(F.count("*").alias(name))


def version_history(df: DataFrame, key: str, version: str) -> DataFrame:
    """All versions of each key numbered from the newest."""
    return df.withColumn("position", F.row_number().over(Window.partitionBy(key).orderBy(F.col(version).desc())))


def next_number(df: DataFrame, key: str, number: str) -> DataFrame:
    """(key, next): one more than the largest number, 1 where there is none."""
    return df.groupBy(key).agg((F.coalesce(F.max(number), F.lit(0)) + 1).alias("next_number"))


def assign_sequence(df: DataFrame, key: str, *order: str, base: DataFrame | None = None, base_col: str = "base") -> DataFrame:
    """Numbers each key's rows without gaps, from 1 or from its base (key, base) on."""
    numbered = df.withColumn("sequence_num", F.row_number().over(Window.partitionBy(key).orderBy(*order)).cast("long"))
    if base is None:
        return numbered
    return numbered.join(base.select(key, F.col(base_col).alias("_base")), key, "left").withColumn("sequence_num", F.col("sequence_num") + F.coalesce("_base", F.lit(0))).drop("_base")


def after_offset(df: DataFrame, sequence: str, offset: int) -> DataFrame:
    return df.filter(F.col(sequence) > max(offset, 0))


def unique_violations(df: DataFrame, *key: str) -> DataFrame:
    """Keys that several live rows have, with how many."""
    return df.groupBy(*key).agg(F.count("*").alias("n")).filter("n > 1")


def missing_refs(refs: DataFrame, known: DataFrame, *key: str) -> DataFrame:
    """References that no known row has; any row here is an error."""
    return refs.join(known, list(key), "left_anti")


def reference_counts(targets: DataFrame, refs: DataFrame, key: str, ref: str) -> DataFrame:
    """Each target's key with its number of references and whether it may be deleted."""
    counts = refs.groupBy(F.col(ref).alias(key)).agg(F.count("*").alias("refs"))
    return targets.select(key).join(counts, key, "left").select(key, F.coalesce("refs", F.lit(0).cast("long")).alias("refs"), F.col("refs").isNull().alias("deletable"))


def resolve_chain(start: DataFrame, *links: tuple[DataFrame, Column, str, Column]) -> DataFrame:
    """Follows (table, join condition, link name, found condition) links from each start row.

    `failed_link` names the first link whose row is missing or refused, null if all hold.
    """
    df, checks = start, []
    for table, on, name, found in links:
        df = df.join(table, on, "left")
        checks.append(F.when(~F.coalesce(found, F.lit(False)), F.lit(name)))
    return df.withColumn("failed_link", F.coalesce(*checks))


def id_list_lookup(df: DataFrame, key: str, ids: Sequence) -> DataFrame:
    """Rows for a list of ids in its order, duplicates kept and unknown ids skipped: position and the columns."""
    if not ids:
        return df.limit(0).withColumn("position", F.lit(0))
    kind = df.schema[key].dataType
    wanted = df.sparkSession.range(1).select(F.posexplode(F.array(*(F.lit(i).cast(kind) for i in ids))).alias("position", key))
    return df.join(F.broadcast(wanted), key).orderBy("position")


def allowed(df: DataFrame, key: str, grants: DataFrame) -> DataFrame:
    """Rows whose key an agent's list grants."""
    return df.join(grants, key, "left_semi")


def update_among(df: DataFrame, key: str, keys: DataFrame, guard: Column, **changes: Column) -> DataFrame:
    """All rows, with the changes made where the key is listed and the guard holds."""
    marked = df.join(keys.select(key).distinct().withColumn("_hit", F.lit(True)), key, "left")
    hit = F.coalesce(F.col("_hit"), F.lit(False)) & guard
    return marked.select(*(F.when(hit, changes[c]).otherwise(F.col(c)).alias(c) if c in changes else F.col(c) for c in df.columns))


def first_schema_tables(schemas: DataFrame, tables: DataFrame) -> DataFrame:
    """Tables of the first schema (by name) of each connection."""
    first = schemas.groupBy("connection_id").agg(F.min_by("id", "schema_name").alias("database_schema_id"))
    return tables.join(first, "database_schema_id")


def table_list(connection_type: str, schemas: DataFrame, tables: DataFrame, endpoints: DataFrame) -> DataFrame:
    """(connection_id, name, type) as one list shows them: endpoints of an API, tables of the first schema otherwise."""
    if connection_type == "API":
        return endpoints.select("connection_id", F.col("name"), F.lit("API").alias("type"))
    return first_schema_tables(schemas, tables).select("connection_id", F.col("table_name").alias("name"), F.lit("TABLE").alias("type"))


def api_fields_as_columns(fields: DataFrame) -> DataFrame:
    """API fields in the shape of column_info."""
    return fields.select("id", F.col("api_schema_id").alias("table_id"), F.col("original_name").alias("column_name"), F.col("field_type").alias("data_type"), F.col("description").alias("column_comment"), F.col("display_name").alias("column_custom_comment"))


def mounted_skills(agents: DataFrame, skills: DataFrame) -> DataFrame:
    """Skills that agent versions mount by their JSON list; malformed lists and unknown skills are skipped."""
    refs = F.from_json("skill_ids", "array<struct<skillId:string,version:string>>")
    strict = F.when(F.col("ref.version").rlike(r"^\d+$"), F.col("ref.version").try_cast("int"))
    exploded = agents.select("agent_id", "version_number", F.explode(refs).alias("ref")).select("agent_id", "version_number", F.col("ref.skillId").alias("skill_id"), strict.alias("skill_version")).filter("skill_version >= 1")
    return exploded.join(skills.withColumnRenamed("version_number", "skill_version"), ["skill_id", "skill_version"])


def first_message_text(inputs: Column) -> Column:
    """Of an array of {type, content: array of {type, text}}: the trimmed text blocks of the first message with any text."""
    texts = F.transform(
        F.filter(inputs, lambda i: i["type"] == "message"),
        lambda i: F.trim(F.array_join(F.transform(F.filter(i["content"], lambda b: (b["type"] == "text") & b["text"].isNotNull()), lambda b: b["text"]), "")),
    )
    return F.get(F.filter(texts, lambda t: t != ""), F.lit(0))
