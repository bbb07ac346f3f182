"""Catalogue synchronisation: the difference of a remote and a local snapshot, as rows to apply."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def diff(remote: DataFrame, local: DataFrame, keys: list[str], compare: str | None = None, remove: bool = True) -> DataFrame:
    """(keys, action, remote value, local value): insert, update, remove or keep, by name.

    update: both sides hold the name and the compared values differ (null counts as a value). remove: only local. With
    remove off, vanished rows are kept. Names that repeat on a side count once, with the least value.
    """
    value = lambda df, name: df.groupBy(*keys).agg((F.min(compare) if compare else F.lit(None).cast("string")).alias(name), F.lit(True).alias(f"_{name}"))
    joined = value(remote, "remote_value").join(value(local, "local_value"), keys, "full_outer")
    changed = ~F.col("remote_value").eqNullSafe(F.col("local_value")) if compare else F.lit(False)
    action = F.when(F.col("_local_value").isNull(), "insert").when(F.col("_remote_value").isNull(), F.lit("remove" if remove else "keep")).when(changed, "update").otherwise("keep")
    return joined.select(*keys, action.alias("action"), "remote_value", "local_value")


def counters(actions: DataFrame) -> DataFrame:
    return actions.groupBy("action").agg(F.count("*").alias("n"))


def sync_catalogue(remote_tables: DataFrame, remote_columns: DataFrame, local_tables: DataFrame, local_columns: DataFrame, detect_column_changes: bool = False) -> tuple[DataFrame, DataFrame]:
    """(table actions, column actions) over (schema_name, table_name[, column_name], table_comment / data_type).

    A remote comment that changed updates the table's own comment; custom comments are the user's. Tables that vanish
    from a surviving schema are removed with their columns; schemas that vanish stay. Dropped or retyped columns of a
    surviving table show as column_removed and column_retyped when asked for.
    """
    schemas = remote_tables.select("schema_name").distinct()
    known = local_tables.join(schemas, "schema_name", "left_semi")
    tables = diff(remote_tables, known, ["schema_name", "table_name"], "table_comment")
    columns = diff(remote_columns, local_columns, ["schema_name", "table_name", "column_name"], "data_type")
    gone = tables.filter("action = 'remove'").select("schema_name", "table_name", F.lit(True).alias("_gone"))
    columns = columns.join(gone, ["schema_name", "table_name"], "left")
    alone = columns["action"] == "remove"
    change = lambda name: F.lit(name) if detect_column_changes else F.lit("keep")
    action: Column = (
        F.when(alone & F.col("_gone"), "remove").when(alone, change("column_removed")).when(F.col("action") == "update", change("column_retyped")).otherwise(F.col("action"))
    )
    return tables, columns.withColumn("action", action).drop("_gone")


def apply_tables(local: DataFrame, actions: DataFrame) -> DataFrame:
    """The local tables after the actions: comments updated, removed rows soft-deleted, new rows added."""
    keyed = local.join(actions.filter("action <> 'insert'").select("schema_name", "table_name", "action", "remote_value"), ["schema_name", "table_name"], "left")
    old = keyed.select(
        "schema_name",
        "table_name",
        F.when(F.col("action") == "update", F.col("remote_value")).otherwise(F.col("table_comment")).alias("table_comment"),
        F.when(F.col("action") == "remove", F.lit(1)).otherwise(F.col("is_deleted")).alias("is_deleted"),
    )
    new = actions.filter("action = 'insert'").select("schema_name", "table_name", F.col("remote_value").alias("table_comment"), F.lit(0).alias("is_deleted"))
    return old.unionByName(new)


LEVELS = ("schema", "table", "column")
_NAMES = ["schema_name", "table_name", "column_name"]


def tree(schemas: DataFrame, tables: DataFrame, columns: DataFrame) -> DataFrame:
    """(schema_name, table_name, column_name, comment, data_type) of a whole catalogue: a schema has no table name, a table no column name.

    From (schema_name), (schema_name, table_name, comment) and (schema_name, table_name, column_name, data_type[, comment]).
    """
    null = F.lit(None).cast("string")
    said = F.col("comment") if "comment" in columns.columns else null
    rows = schemas.select("schema_name", null.alias("table_name"), null.alias("column_name"), null.alias("comment"), null.alias("data_type"))
    rows = rows.unionByName(tables.select("schema_name", "table_name", null.alias("column_name"), "comment", null.alias("data_type")))
    return rows.unionByName(columns.select(*_NAMES, said.alias("comment"), "data_type"))


def changes(remote: DataFrame, local: DataFrame, detect_columns: bool = False, detect_schemas: bool = False) -> DataFrame:
    """(names, level, action, remote and local comment and data type) of two trees, all levels in one pass over both.

    insert: only remote. update: a table's remote comment is there and differs. remove: a table that vanished from a schema that is still there,
    and with it all its columns. Columns that vanish from a table, or change their type there, are column_removed and
    column_retyped where columns are detected, else kept; a schema that vanishes stays with all below it, or is removed with it where
    schemas are detected. Names that repeat count once. Names are matched once a level, and a row a schema tells what became of it.
    """
    side = lambda df, name: df.select(*_NAMES, F.struct("comment", "data_type").alias(name), F.lit(True).alias(f"_{name}"))
    both = side(remote, "remote").unionByName(side(local, "local"), allowMissingColumns=True)
    there = [F.coalesce(F.max(f"_{name}"), F.lit(False)).alias(f"_{name}") for name in ("remote", "local")]
    one = both.groupBy(*_NAMES).agg(F.min("remote").alias("remote"), F.min("local").alias("local"), *there)
    level = F.when(F.col("table_name").isNull(), "schema").when(F.col("column_name").isNull(), "table").otherwise("column")
    schema_gone = one.filter("table_name IS NULL AND NOT _remote").select("schema_name", F.lit(True).alias("_schema_gone"))
    one = one.withColumn("level", level).join(schema_gone, "schema_name", "left")
    # A table and its columns stand together; a table has as many columns as a database allows.
    one = one.withColumn("_table_gone", F.max(F.when((F.col("level") == "table") & F.col("_local"), ~F.col("_remote"))).over(Window.partitionBy("schema_name", "table_name")))
    only_local, only_remote, gone = F.col("_local") & ~F.col("_remote"), F.col("_remote") & ~F.col("_local"), F.coalesce("_schema_gone", F.lit(False))
    asked = lambda yes, action: F.lit(action if yes else "keep")
    retold = F.col("remote.comment").isNotNull() & ~F.col("remote.comment").eqNullSafe(F.col("local.comment"))
    action = (
        F.when(gone, asked(detect_schemas, "remove"))
        .when(only_remote, "insert")
        .when(only_local & ((F.col("level") == "table") | F.coalesce("_table_gone", F.lit(False))), "remove")
        .when(only_local, asked(detect_columns, "column_removed"))
        .when((F.col("level") == "table") & retold, "update")
        .when((F.col("level") == "column") & ~F.col("remote.data_type").eqNullSafe(F.col("local.data_type")), asked(detect_columns, "column_retyped"))
        .otherwise("keep")
    )
    return one.select(*_NAMES, "level", action.alias("action"), F.col("remote.comment").alias("remote_comment"), F.col("local.comment").alias("local_comment"), F.col("remote.data_type").alias("remote_type"), F.col("local.data_type").alias("local_type"))


def applied(local: DataFrame, made: DataFrame) -> DataFrame:
    """The local tree, with its further columns, after the changes: removed rows are marked in is_deleted, comments and types taken over, new rows
    added. Custom comments and whatever else a row has are the user's and stay.
    """
    alike = [local[c].eqNullSafe(made[c]) for c in _NAMES]
    on = alike[0] & alike[1] & alike[2]
    act = made["action"]
    new_value = {
        "comment": F.when(act == "update", made["remote_comment"]).otherwise(local["comment"]),
        "data_type": F.when(act == "column_retyped", made["remote_type"]).otherwise(local["data_type"]),
        "is_deleted": F.when(act.isin("remove", "column_removed"), F.lit(1)).otherwise(local["is_deleted"]),
    }
    kept = local.join(made, on, "left").select(*(new_value[c].alias(c) if c in new_value else local[c] for c in local.columns))
    new = made.filter("action = 'insert'").select(*_NAMES, F.col("remote_comment").alias("comment"), F.col("remote_type").alias("data_type"), F.lit(0).alias("is_deleted"))
    return kept.unionByName(new, allowMissingColumns=True)


def level_counters(made: DataFrame) -> DataFrame:
    """(level, action, n) of what a synchronisation does; what is kept doesn't count."""
    return made.filter("action <> 'keep'").groupBy("level", "action").agg(F.count("*").alias("n"))
