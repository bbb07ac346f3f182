"""Named queries that work along each key's order: commands as a table, numbers of hot keys."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemill.operators import ordered, sync
from tidemill.plans import rounds
from tidemill.registry import query


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _one_by_one(machine: ordered.Machine, commands: dict[str, str], snapshot: str, state: str = "status") -> str:
    """Common tables of a recursion that carries out the n-th command of every customer, n by n: `said` and `run`."""
    moved = " ".join(f"WHEN state = '{s}' AND command = '{c}' THEN '{to}'" for (s, c), to in machine.steps.items() if to in machine.states)
    why = " ".join(f"WHEN state = '{s}' AND command = '{c}' THEN {_quoted(to)}" for (s, c), to in machine.steps.items() if to not in machine.states)
    kinds = " ".join(f"WHEN '{e}' THEN '{c}'" for e, c in commands.items())
    return f"""WITH RECURSIVE snapshot AS ({snapshot}),
said AS MATERIALIZED (SELECT user_id AS k, event_id, CASE event_type {kinds} END AS command, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n FROM events),
run AS (
  SELECT k, 0 AS n, NULL::BIGINT AS event_id, NULL::VARCHAR AS command, coalesce({state}, '{machine.states[0]}') AS state, NULL::VARCHAR AS outcome FROM (SELECT user_id AS k FROM events UNION SELECT k FROM snapshot) LEFT JOIN snapshot USING (k)
  UNION ALL SELECT k, n, event_id, command, CASE {moved} ELSE state END, CASE {why} END
  FROM (SELECT said.*, run.state FROM run JOIN said ON said.k = run.k AND said.n = run.n + 1))
"""


def _said(t, commands: dict[str, str]) -> DataFrame:
    kinds = F.create_map(*(F.lit(x) for pair in commands.items() for x in pair))
    return t("events").select(F.col("user_id").alias("k"), "event_id", kinds[F.col("event_type")].alias("command"))


_DATASOURCE = {"view": "sync", "click": "disable", "purchase": "enable", "error": "delete", "signup": "create"}
_DATASOURCE_SQL = _one_by_one(ordered.DATASOURCE, _DATASOURCE, "SELECT c_custkey AS k, CASE c_custkey % 3 WHEN 0 THEN 'ABSENT' WHEN 1 THEN 'ENABLED' ELSE 'DISABLED' END AS status FROM customer")


def _datasources(t) -> tuple[DataFrame, DataFrame]:
    kind = F.col("c_custkey") % 3
    snapshot = t("customer").select(F.col("c_custkey").alias("k"), F.when(kind == 0, "ABSENT").when(kind == 1, "ENABLED").otherwise("DISABLED").alias("status"))
    return ordered.fold_commands(snapshot, _said(t, _DATASOURCE), ordered.DATASOURCE, "k", "event_id")


@query(f"{_DATASOURCE_SQL} SELECT k, event_id, command, outcome FROM run WHERE n > 0")
def datasource_command_table(t, spark: SparkSession) -> DataFrame:
    return _datasources(t)[1]


@query(f"{_DATASOURCE_SQL} SELECT k, arg_max(state, n) AS status FROM run GROUP BY k HAVING arg_max(state, n) <> 'ABSENT'")
def datasource_rows_after(t, spark) -> DataFrame:
    return _datasources(t)[0]


_SESSION = {"view": "acquire", "click": "release", "purchase": "acquire", "error": "terminate", "signup": "create"}


@query(_one_by_one(ordered.SESSION, _SESSION, "SELECT c_custkey AS k, CASE WHEN c_custkey % 5 = 0 THEN 'RUNNING' ELSE 'IDLE' END AS status FROM customer") + "SELECT k, event_id, outcome, NULLIF(outcome IS NULL AND command = 'acquire', false) AS began FROM run WHERE n > 0")
def session_command_table(t, spark) -> DataFrame:
    snapshot = t("customer").select(F.col("c_custkey").alias("k"), F.when(F.col("c_custkey") % 5 == 0, "RUNNING").otherwise("IDLE").alias("status"))
    told = ordered.fold_commands(snapshot, _said(t, _SESSION), ordered.SESSION, "k", "event_id")[1]
    return told.select("k", "event_id", "outcome", F.when(F.col("outcome").isNull() & (F.col("command") == "acquire"), True).alias("began"))


_AGENT = {"view": "publish", "click": "publish", "purchase": "archive", "error": "delete", "signup": "create"}


@query(
    _one_by_one(ordered.AGENT, _AGENT, "SELECT c_custkey AS k, CASE WHEN c_custkey % 2 = 1 THEN 'ABSENT' WHEN c_custkey % 7 = 0 THEN 'ARCHIVED' ELSE 'LIVE' END AS status FROM customer")
    + """, lives AS (SELECT *, count(*) FILTER (outcome IS NULL AND command = 'create') OVER (PARTITION BY k ORDER BY n) AS life FROM run WHERE n > 0)
SELECT k, event_id, outcome, CASE WHEN outcome IS NULL AND command IN ('create', 'publish') THEN count(*) FILTER (outcome IS NULL AND command IN ('create', 'publish')) OVER (PARTITION BY k, life ORDER BY n) + CASE WHEN life = 0 AND k % 2 = 0 THEN k % 4 ELSE 0 END END AS version_number FROM lives"""
)
def agent_version_table(t, spark) -> DataFrame:
    key = F.col("c_custkey")
    snapshot = t("customer").select(key.alias("k"), F.when(key % 2 == 1, "ABSENT").when(key % 7 == 0, "ARCHIVED").otherwise("LIVE").alias("status"), F.when(key % 2 == 0, key % 4).alias("latest_version"))
    return ordered.published_versions(snapshot, _said(t, _AGENT), "k", "event_id")[1].select("k", "event_id", "outcome", "version_number")


_LINE = ["l_orderkey", "l_linenumber"]


@query("SELECT l_returnflag, l_orderkey, l_linenumber, row_number() OVER (PARTITION BY l_returnflag ORDER BY l_orderkey, l_linenumber) AS sequence_num FROM lineitem")
def hot_sequences(t, spark) -> DataFrame:
    """Three keys for all rows: each is numbered in ranges."""
    return ordered.numbered(t("lineitem").select("l_returnflag", *_LINE), ["l_returnflag"], _LINE)


@query("SELECT row_number() OVER (ORDER BY o_orderkey) AS line_no, concat_ws(',', o_orderkey::VARCHAR, o_custkey::VARCHAR, o_orderstatus) AS line FROM orders")
def numbered_lines(t, spark) -> DataFrame:
    """A whole table as numbered lines, without one task that sees them all."""
    line = F.concat_ws(",", *(F.col(c).cast("string") for c in ("o_orderkey", "o_custkey", "o_orderstatus")))
    return ordered.numbered(t("orders").select("o_orderkey", line.alias("line")), [], ["o_orderkey"], "line_no").select("line_no", "line")


@query("""WITH c AS (SELECT event_id, user_id % 25 AS chain, row_number() OVER w AS n, lag(event_id) OVER w AS before, first_value(event_id) OVER w AS root, max(event_id) OVER (PARTITION BY user_id % 25) AS final FROM events WINDOW w AS (PARTITION BY user_id % 25 ORDER BY event_id))
SELECT event_id AS span_id, CASE WHEN before IS NULL AND chain % 5 = 4 THEN final ELSE before END AS parent_span_id, CASE WHEN chain % 5 <> 4 THEN root END AS root,
CASE WHEN chain % 5 <> 4 THEN (n - 1)::INTEGER END AS depth, CASE WHEN chain % 5 = 4 THEN 'cycle' END AS problem FROM c""")
def deep_chains(t, spark) -> DataFrame:
    """Events in a row, each under the one before it, hundreds deep; some rows are closed to circles."""
    chain = Window.partitionBy("chain")
    rows = t("events").select("event_id", (F.col("user_id") % 25).alias("chain")).withColumns({"before": F.lag("event_id").over(chain.orderBy("event_id")), "final": F.max("event_id").over(chain)})
    parent = F.when(F.col("before").isNull() & (F.col("chain") % 5 == 4), F.col("final")).otherwise(F.col("before"))
    return rounds.span_depths(rows.select(F.col("event_id").alias("span_id"), parent.alias("parent_span_id")), with_path=False).drop("path")


@query("""WITH w AS (SELECT conv_id, string_agg(text, '' ORDER BY turn) AS s FROM conversations GROUP BY 1)
SELECT conv_id, length(s) AS total, left(s, 400) AS head, CASE WHEN length(s) > 400 THEN right(s, least(length(s) - 400, 400)::BIGINT) ELSE '' END AS tail FROM w WHERE s <> ''""")
def result_ends(t, spark) -> DataFrame:
    """Both ends of each conversation as one text."""
    return ordered.head_and_tail(t("conversations"), ["conv_id"], "text", ["turn"], 400).drop("heads")


@query("""WITH w AS (SELECT string_agg(text, '' ORDER BY doc_id) AS s, lang FROM documents GROUP BY lang)
SELECT lang, length(s) AS total, sha256(left(s, 16384)) AS head, sha256(CASE WHEN length(s) > 16384 THEN right(s, least(length(s) - 16384, 16384)::BIGINT) ELSE '' END) AS tail FROM w""")
def language_ends(t, spark) -> DataFrame:
    """Both ends of four texts, of all documents of a language each: a key has up to a half of all characters."""
    made = ordered.head_and_tail(t("documents").select("lang", "doc_id", "text"), ["lang"], "text", ["doc_id"])
    return made.select("lang", "total", F.sha2("head", 256).alias("head"), F.sha2("tail", 256).alias("tail"))


def _trees(t) -> tuple[DataFrame, DataFrame]:
    """Nations as schemas, customers as their tables, orders as the tables' columns. The remote catalogue has other names for some on each
    level, other types for some columns, and other comments or none for some tables.
    """
    renamed = lambda name, when: F.when(when, F.concat(F.lit("new "), name.cast("string"))).otherwise(name.cast("string"))
    key, order = F.col("c_custkey"), F.col("o_orderkey")
    nations = t("nation").select("n_nationkey", "n_name", renamed(F.col("n_name"), F.col("n_nationkey") % 6 == 5).alias("far"))
    tables = t("customer").join(nations, F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", "c_mktsegment", "n_name", "far", renamed(key, key % 7 == 0).alias("far_table"))
    columns = t("orders").join(tables, F.col("o_custkey") == key)
    told = F.when(key % 5 == 0, "new").when(key % 5 == 1, F.lit(None)).otherwise(F.col("c_mktsegment"))
    retyped = F.when(order % 13 == 0, "changed").otherwise(F.col("o_orderstatus"))
    remote = sync.tree(
        nations.select(F.col("far").alias("schema_name")),
        tables.select(F.col("far").alias("schema_name"), F.col("far_table").alias("table_name"), told.alias("comment")),
        columns.select(F.col("far").alias("schema_name"), F.col("far_table").alias("table_name"), renamed(order, order % 11 == 0).alias("column_name"), retyped.alias("data_type")),
    )
    local = sync.tree(
        nations.select(F.col("n_name").alias("schema_name")),
        tables.select(F.col("n_name").alias("schema_name"), key.cast("string").alias("table_name"), F.col("c_mktsegment").alias("comment")),
        columns.select(F.col("n_name").alias("schema_name"), key.cast("string").alias("table_name"), order.cast("string").alias("column_name"), F.col("o_orderstatus").alias("data_type")),
    )
    return remote, local


_TREES_SQL = """WITH n AS (SELECT n_nationkey, n_name AS ls, CASE WHEN n_nationkey % 6 = 5 THEN 'new ' ELSE '' END || n_name AS rs FROM nation),
c AS (SELECT c_custkey, ls, rs, c_custkey::VARCHAR AS lt, CASE WHEN c_custkey % 7 = 0 THEN 'new ' ELSE '' END || c_custkey AS rt, c_mktsegment AS lc, CASE c_custkey % 5 WHEN 0 THEN 'new' WHEN 1 THEN NULL ELSE c_mktsegment END AS rc FROM customer JOIN n ON c_nationkey = n_nationkey),
o AS (SELECT ls, rs, lt, rt, o_orderkey::VARCHAR AS lo, CASE WHEN o_orderkey % 11 = 0 THEN 'new ' ELSE '' END || o_orderkey AS ro, o_orderstatus AS ld, CASE WHEN o_orderkey % 13 = 0 THEN 'changed' ELSE o_orderstatus END AS rd FROM orders JOIN c ON o_custkey = c_custkey),
far AS (SELECT rs AS s, '' AS t, '' AS c, NULL::VARCHAR AS comment, NULL::VARCHAR AS kind FROM n UNION ALL SELECT rs, rt, '', rc, NULL FROM c UNION ALL SELECT rs, rt, ro, NULL, rd FROM o),
near AS (SELECT ls AS s, '' AS t, '' AS c, NULL::VARCHAR AS comment, NULL::VARCHAR AS kind FROM n UNION ALL SELECT ls, lt, '', lc, NULL FROM c UNION ALL SELECT ls, lt, lo, NULL, ld FROM o),
j AS (SELECT coalesce(far.s, near.s) AS s, coalesce(far.t, near.t) AS t, coalesce(far.c, near.c) AS c, far.s IS NOT NULL AS r, near.s IS NOT NULL AS l, far.comment AS rc, near.comment AS lc, far.kind AS rd, near.kind AS ld
  FROM far FULL JOIN near ON far.s = near.s AND far.t = near.t AND far.c = near.c),
f AS (SELECT j.*, CASE WHEN t = '' THEN 'schema' WHEN c = '' THEN 'table' ELSE 'column' END AS level, s IN (SELECT rs FROM n) AS alive, (s, t) IN (SELECT rs, rt FROM c) AS table_alive FROM j),
g AS (SELECT *, CASE WHEN NOT alive THEN 'keep' WHEN NOT l THEN 'insert' WHEN NOT r AND (level = 'table' OR NOT table_alive) THEN 'remove' WHEN NOT r THEN 'column_removed'
  WHEN level = 'table' AND rc <> lc THEN 'update' WHEN level = 'column' AND rd <> ld THEN 'column_retyped' ELSE 'keep' END AS action FROM f),
a AS (SELECT s AS schema_name, nullif(t, '') AS table_name, nullif(c, '') AS column_name, level, action, CASE WHEN action IN ('insert', 'update') THEN rc ELSE lc END AS comment, CASE WHEN action IN ('insert', 'column_retyped') THEN rd ELSE ld END AS data_type, l FROM g)
"""


@query(f"{_TREES_SQL} SELECT schema_name, table_name, column_name, level, action FROM a WHERE action <> 'keep'")
def catalogue_changes(t, spark) -> DataFrame:
    made = sync.changes(*_trees(t), detect_columns=True)
    return made.filter("action <> 'keep'").select("schema_name", "table_name", "column_name", "level", "action")


@query(f"{_TREES_SQL} SELECT level, action, count(*) AS n FROM a WHERE action NOT IN ('keep', 'column_removed', 'column_retyped') GROUP BY ALL")
def catalogue_counters(t, spark) -> DataFrame:
    return sync.level_counters(sync.changes(*_trees(t)))


@query(f"""{_TREES_SQL} SELECT schema_name, table_name, column_name, comment, data_type, CASE WHEN l THEN 'mine' END AS custom_comment, CASE WHEN action IN ('remove', 'column_removed') THEN 1 ELSE 0 END AS is_deleted FROM a""")
def catalogue_applied(t, spark) -> DataFrame:
    remote, local = _trees(t)
    held = local.withColumns({"custom_comment": F.lit("mine"), "is_deleted": F.lit(0)})
    return sync.applied(held, sync.changes(remote, local, detect_columns=True))
