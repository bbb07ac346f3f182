"""Relational sources over JDBC: dialects, bounded previews, metadata and diagnosis."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemill.functions.text import quote_identifier

VALIDATE_SECONDS, QUERY_SECONDS, MOST_FETCHED = 10, 30, 1000


@dataclass(frozen=True)
class Dialect:
    """How a kind of database is reached and asked. `driver` may be None: Spark then derives it from the url."""

    name: str
    port: int
    mark: str
    url: str
    category: str
    tables: str
    columns: str


#: The kinds of relational sources, with their default ports (fixed values).
DIALECTS = {
    "MYSQL": Dialect(
        "MySQL", 3306, "`", "jdbc:mysql://{host}:{port}/{database}?useSSL=false&serverTimezone=UTC", "OLTP",
        "SELECT table_name, table_comment FROM information_schema.tables WHERE table_schema = '{schema}' AND table_type = 'BASE TABLE'",
        "SELECT c.table_name, c.column_name, c.data_type, c.ordinal_position, c.column_comment FROM information_schema.columns c "
        "JOIN information_schema.tables t ON t.table_schema = c.table_schema AND t.table_name = c.table_name WHERE c.table_schema = '{schema}' AND t.table_type = 'BASE TABLE'",
    ),
    "CLICKHOUSE": Dialect(
        "ClickHouse", 8123, "`", "jdbc:clickhouse://{host}:{port}/{database}", "OLAP",
        "SELECT name AS table_name, comment AS table_comment FROM system.tables WHERE database = '{schema}' AND engine NOT LIKE '%View'",
        "SELECT c.table AS table_name, c.name AS column_name, c.type AS data_type, c.position AS ordinal_position, c.comment AS column_comment FROM system.columns c "
        "JOIN system.tables t ON t.database = c.database AND t.name = c.table WHERE c.database = '{schema}' AND t.engine NOT LIKE '%View'",
    ),
    "POSTGRESQL": Dialect(
        "PostgreSQL", 5432, '"', "jdbc:postgresql://{host}:{port}/{database}?currentSchema={schema}", "OLTP",
        "SELECT c.relname AS table_name, obj_description(c.oid) AS table_comment FROM pg_class c JOIN pg_namespace n ON n.oid = c.relnamespace WHERE n.nspname = '{schema}' AND c.relkind = 'r'",
        "SELECT c.relname AS table_name, a.attname AS column_name, t.typname AS data_type, a.attnum AS ordinal_position, col_description(c.oid, a.attnum) AS column_comment "
        "FROM pg_class c JOIN pg_namespace n ON n.oid = c.relnamespace JOIN pg_attribute a ON a.attrelid = c.oid JOIN pg_type t ON t.oid = a.atttypid "
        "WHERE n.nspname = '{schema}' AND c.relkind = 'r' AND a.attnum > 0 AND NOT a.attisdropped",
    ),
}

_SYSTEM_SCHEMAS = ("pg_catalog", "information_schema", "pg_toast")


@dataclass(frozen=True)
class Connection:
    kind: str
    host: str = ""
    port: int | None = None
    database: str = ""
    schema: str | None = None
    user: str | None = None
    password: str | None = None
    url: str | None = None
    #: How this database bounds a query, and the query that tests it; those of the three dialects by default.
    limit: str = "LIMIT {rows}"
    probe: str = "SELECT 1"

    def jdbc_url(self) -> str:
        d = DIALECTS[self.kind]
        return self.url or d.url.format(host=self.host, port=self.port or d.port, database=self.database, schema=self.schema_name())

    def schema_name(self) -> str:
        """The one schema that is listed: the configured schema of PostgreSQL (public by default), else the database."""
        if self.kind == "POSTGRESQL":
            return check_schema(self.schema or "public")
        if not self.database.strip():
            raise ValueError("the connection names no database")
        return self.database

    def options(self) -> dict[str, str]:
        out = {"url": self.jdbc_url(), "queryTimeout": str(QUERY_SECONDS)}
        return out | {k: v for k, v in (("user", self.user), ("password", self.password)) if v}


def check_schema(name: str) -> str:
    if "," in name or ";" in name or name.lower() in _SYSTEM_SCHEMAS:
        raise ValueError(f"not a schema to read from: {name}")
    return name


def preview_sql(c: Connection, schema: str, table: str, rows: int) -> str:
    mark = DIALECTS[c.kind].mark
    return f"SELECT * FROM {quote_identifier(schema, mark)}.{quote_identifier(table, mark)} {c.limit.format(rows=rows)}"


def preview(spark: SparkSession, c: Connection, table: str, rows: int) -> DataFrame:
    """The first rows of a table. The database itself gets the limit, so that drivers which hold whole results hold few."""
    sql = preview_sql(c, c.schema_name(), table, rows)
    df = spark.read.format("jdbc").options(**c.options(), query=sql, fetchsize=str(min(rows, MOST_FETCHED))).load()
    return as_text(df) if c.kind == "POSTGRESQL" else df


def as_text(df: DataFrame) -> DataFrame:
    """Values that are no strings, numbers or booleans as strings."""
    plain = (T.StringType, T.NumericType, T.BooleanType)
    return df.select(*(F.col(f.name) if isinstance(f.dataType, plain) else F.col(f.name).cast("string").alias(f.name) for f in df.schema.fields))


def tables(spark: SparkSession, c: Connection) -> DataFrame:
    """(table_name, table_comment) of the base tables, no views, of the connection's schema."""
    return _metadata(spark, c, DIALECTS[c.kind].tables)


def columns(spark: SparkSession, c: Connection) -> DataFrame:
    """(table_name, column_name, data_type, ordinal_position, column_comment) of the base tables of the connection's schema, in one
    query for all of them; an empty comment is none.
    """
    df = _metadata(spark, c, DIALECTS[c.kind].columns)
    return df.withColumn("column_comment", F.nullif("column_comment", F.lit("")))


def metadata_sql(c: Connection, sql: str) -> str:
    return sql.format(schema=c.schema_name().replace("'", "''"))


def _metadata(spark: SparkSession, c: Connection, sql: str) -> DataFrame:
    return spark.read.format("jdbc").options(**c.options(), query=metadata_sql(c, sql)).load()


def spark_tables(spark: SparkSession, database: str | None = None) -> DataFrame:
    """(table_name, table_comment) of the session's own catalogue, without views."""
    found = [(t.name, t.description) for t in spark.catalog.listTables(database) if t.tableType not in ("VIEW", "TEMPORARY")]
    return spark.createDataFrame(found, "table_name string, table_comment string")


def spark_columns(spark: SparkSession, table: str) -> DataFrame:
    found = [(c.name, c.dataType, c.description) for c in spark.catalog.listColumns(table)]
    return spark.createDataFrame(found, "column_name string, data_type string, column_comment string")


#: What the start of a SQL state means (fixed values).
_STATES = {"08": "the server can't be reached", "28000": "authentication failed", "28P01": "authentication failed", "3D000": "the schema does not exist", "42501": "no access to the schema"}
#: What a message means that holds all of some words.
_MESSAGES = (
    (("timeout",), "the server did not answer in time"),
    (("timed out",), "the server did not answer in time"),
    (("unknown database",), "the database does not exist"),
    (("database", "not found"), "the database does not exist"),
    (("schema", "does not exist"), "the schema does not exist"),
    (("access denied",), "authentication failed"),
    (("authentication failed",), "authentication failed"),
    (("connection refused",), "the server can't be reached"),
    (("network is unreachable",), "the server can't be reached"),
    (("unknown host",), "the host name is unknown"),
)


def diagnose(state: str | None, message: str | None) -> str:
    """What went wrong, by the SQL state first and then by the message."""
    text = (message or "").lower()
    by_state = next((meaning for start, meaning in _STATES.items() if state and state.startswith(start)), None)
    by_text = next((meaning for words, meaning in _MESSAGES if all(w in text for w in words)), None)
    return by_state or by_text or f"the connection failed: {message}"


def sql_state(error: BaseException) -> tuple[str | None, str]:
    """(SQL state, message) of the first error of a database in an error of Spark and its causes; no state where there is none."""
    cause = getattr(error, "java_exception", None) or getattr(error, "_origin", None)
    while cause is not None:
        if hasattr(cause, "getClass") and _is_sql_error(cause):
            return cause.getSQLState(), cause.getMessage()
        cause = cause.getCause()
    return None, str(error)


def _is_sql_error(cause) -> bool:
    kind = cause.getClass()
    while kind is not None:
        if kind.getName() == "java.sql.SQLException":
            return True
        kind = kind.getSuperclass()
    return False


def test_connection(spark: SparkSession, c: Connection) -> tuple[bool, str]:
    """(whether it works, why not)."""
    try:
        spark.read.format("jdbc").options(**c.options() | {"queryTimeout": str(VALIDATE_SECONDS)}, query=c.probe).load().collect()
        return True, ""
    except Exception as e:  # noqa: BLE001  any failure is the answer
        return False, diagnose(*sql_state(e))


def supported_types(spark: SparkSession) -> DataFrame:
    """(type, name, category) of the sources that can be connected."""
    rows = [(k, d.name, d.category) for k, d in DIALECTS.items()] + [("API", "API", "API")]
    return spark.createDataFrame(rows, "type string, name string, category string")
