"""A table preview: authorise, resolve, read a bounded number of rows, render."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidemill.functions.text import rendered
from tidemill.operators.catalog import clamp_preview


class Refused(ValueError):
    """A preview that may not run."""


def resolve(connections: DataFrame, connection_id: int, granted: set[int] | None = None) -> dict:
    """The enabled connection with the id; refused if it isn't granted, doesn't exist or isn't enabled."""
    if granted is not None and connection_id not in granted:
        raise Refused(f"data source {connection_id} is not granted to the agent")
    row = connections.filter((connections["id"] == connection_id) & (connections["is_deleted"] == 0)).first()
    if row is None:
        raise Refused(f"there is no data source {connection_id}")
    if row["status"] != "ENABLED":
        raise Refused(f"data source {connection_id} is not enabled")
    return row.asDict()


def preview(table: DataFrame, rows: int | None = None, order: list[str] | None = None) -> DataFrame:
    """The first rows, 1 to 100 of them; in a given order or in the source's own."""
    return (table.orderBy(*order) if order else table).limit(clamp_preview(rows))


#: How each (type, subtype) of connection is read; others may be added.
READERS: dict = {}


def reader(kind: str, sub_type: str | None = None):
    def add(f):
        READERS[kind, sub_type] = f
        return f

    return add


def read(spark: SparkSession, connection: dict, table: str, rows: int) -> DataFrame:
    """Dispatches on the connection's type and subtype."""
    found = READERS.get((connection["type"], connection.get("sub_type"))) or READERS.get((connection["type"], None))
    if found is None:
        raise Refused(f"no reader for {connection['type']}:{connection.get('sub_type')}")
    return found(spark, connection, table, rows)


@reader("PARQUET")
def _parquet(spark: SparkSession, connection: dict, table: str, rows: int) -> DataFrame:
    return spark.read.parquet(f"{connection['location']}/{table}.parquet").limit(rows)


@reader("JDBC")
def _jdbc(spark: SparkSession, connection: dict, table: str, rows: int) -> DataFrame:
    import json

    from tidemill.sources import jdbc

    return jdbc.preview(spark, jdbc.Connection(connection["sub_type"], **json.loads(connection["jdbc_connection_config"])), table, rows)


@reader("API")
def _api(spark: SparkSession, connection: dict, table: str, rows: int) -> DataFrame:
    from tidemill.sources import httpjson

    httpjson.register(spark)
    options = connection["endpoints"][table]
    return spark.read.format("httpjson").options(**options, limit=str(rows)).load().limit(rows)


def rendered_preview(spark: SparkSession, connection: dict, table: str, rows: int | None = 10) -> DataFrame:
    return rendered(read(spark, connection, table, clamp_preview(rows, 10)))
