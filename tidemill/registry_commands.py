"""Named queries for the commands, the log and the sources, with the SQL that must give the same rows.

Commands are applied one after the other to snapshots made of whole tables. `refused` says how many of them were.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemill.functions import dates, jsons, secure, text
from tidemill.operators import catalog, commands
from tidemill.plans import envelope, rounds
from tidemill.registry import query

def _live() -> Column:
    return F.lit(0).cast("short").alias("is_deleted")


def _told(df: DataFrame, *errors: str | None) -> DataFrame:
    return df.withColumn("refused", F.lit(sum(e is not None for e in errors)))


def _id(prefix: str, column: str) -> Column:
    return F.concat(F.lit(prefix), F.col(column).cast("string"))


# Data sources (M1 to M6)

_CONNECTIONS_SQL = "c AS (SELECT s_suppkey AS id, s_name AS name, CASE WHEN s_nationkey % 2 = 0 THEN 'ENABLED' ELSE 'DISABLED' END AS status, 'pw' AS password, 0 AS is_deleted FROM supplier)"


def _connections(t) -> DataFrame:
    status = F.when(F.col("s_nationkey") % 2 == 0, "ENABLED").otherwise("DISABLED")
    return t("supplier").select(F.col("s_suppkey").cast("long").alias("id"), F.col("s_name").alias("name"), status.alias("status"), F.lit("pw").alias("password"), _live())


@query(f"""WITH {_CONNECTIONS_SQL} SELECT id, CASE WHEN id = 1 THEN 'renamed' ELSE name END AS name, status, password, is_deleted, 3 AS refused FROM c
UNION ALL SELECT 900001, 'fresh', 'ENABLED', 'secret', 0, 3""")
def datasource_save(t, spark: SparkSession) -> DataFrame:
    df, made = commands.create_datasource(_connections(t), {"id": 900_001, "name": "fresh", "password": "secret"})
    df, taken = commands.create_datasource(df, {"id": 900_002, "name": "fresh"})
    df, misnamed = commands.create_datasource(df, {"id": 900_003, "name": "9bad"})
    df, renamed = commands.update_datasource(df, 1, {"name": "renamed", "password": " "})
    df, clash = commands.update_datasource(df, 2, {"name": "renamed"})
    return _told(df, made, taken, misnamed, renamed, clash)


@query(f"""WITH {_CONNECTIONS_SQL} SELECT id, name, CASE WHEN id BETWEEN 1 AND 4 THEN 'ENABLED' WHEN id = 5 THEN 'DISABLED' ELSE status END AS status, password, is_deleted,
(SELECT count(*) FILTER (id BETWEEN 1 AND 4 AND status = 'ENABLED') + count(*) FILTER (id = 5 AND status = 'DISABLED') + 1 FROM c)::INTEGER AS refused FROM c""")
def datasource_switch(t, spark) -> DataFrame:
    df, told = _connections(t), []
    for k in (1, 2, 3, 4):
        df, error = commands.enable_datasource(df, k, True)
        told.append(error)
    df, disabled = commands.disable_datasource(df, 5)
    df, untested = commands.enable_datasource(df, 6, False)
    return _told(df, *told, disabled, untested)


@query("""WITH n AS (SELECT n_nationkey AS k FROM nation WHERE n_regionkey = 1), c AS (SELECT c_custkey AS k FROM customer WHERE c_nationkey IN (SELECT k FROM n)),
s AS (SELECT s_suppkey AS k FROM supplier WHERE s_nationkey % 5 = 1)
SELECT 'connections' AS level, count(*) AS live FROM region WHERE r_regionkey <> 1 UNION ALL SELECT 'schemas', count(*) FROM nation WHERE n_regionkey <> 1
UNION ALL SELECT 'tables', count(*) FROM customer WHERE c_custkey NOT IN (SELECT k FROM c) UNION ALL SELECT 'columns', count(*) FROM orders WHERE o_custkey NOT IN (SELECT k FROM c)
UNION ALL SELECT 'endpoints', count(*) FROM supplier WHERE s_suppkey NOT IN (SELECT k FROM s) UNION ALL SELECT 'fields', count(*) FROM lineitem WHERE l_suppkey NOT IN (SELECT k FROM s)""")
def datasource_delete(t, spark) -> DataFrame:
    below = lambda name, key, ref, parent: t(name).select(key.alias("id"), parent.alias(ref), _live())
    connections = t("region").select(F.col("r_regionkey").cast("long").alias("id"), F.when(F.col("r_regionkey") == 1, "DISABLED").otherwise("ENABLED").alias("status"), _live())
    after, _ = commands.delete_datasource(
        connections, 1,
        below("nation", F.col("n_nationkey"), "connection_id", F.col("n_regionkey")), below("customer", F.col("c_custkey"), "database_schema_id", F.col("c_nationkey")),
        below("orders", F.col("o_orderkey"), "table_id", F.col("o_custkey")), below("supplier", F.col("s_suppkey"), "connection_id", F.col("s_nationkey") % 5), below("lineitem", F.col("l_orderkey"), "api_schema_id", F.col("l_suppkey")),
    )
    names = ("connections", "schemas", "tables", "columns", "endpoints", "fields")
    counts = [catalog.live(df).agg(F.count("*").alias("live")).select(F.lit(name).alias("level"), "live") for name, df in zip(names, after, strict=True)]
    out = counts[0]
    for more in counts[1:]:
        out = out.unionByName(more)
    return out


@query("SELECT c_custkey AS id, CASE WHEN c_custkey = 1 THEN 'a note' ELSE c_name END AS table_custom_comment, 0 AS is_deleted, 1 AS refused FROM customer")
def custom_comment(t, spark) -> DataFrame:
    tables = t("customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("table_custom_comment"), _live())
    tables, noted = commands.comment(tables, 1, "table_custom_comment", "a note")
    tables, too_long = commands.comment(tables, 2, "table_custom_comment", "x" * 151)
    return _told(tables, noted, too_long)


@query("""WITH f AS (SELECT c_nationkey AS k, count(*) AS n FROM customer WHERE c_nationkey NOT IN (3, 5) GROUP BY 1 UNION ALL SELECT 3, 1)
SELECT n_nationkey AS id, 0 AS connection_id, 'n' || n_nationkey AS name, CASE WHEN n_nationkey = 3 THEN 'http://x' ELSE 'http://old' END AS url, CASE WHEN n_nationkey = 5 THEN 1 ELSE 0 END AS is_deleted, coalesce(f.n, 0) AS fields, 1 AS refused
FROM nation LEFT JOIN f ON f.k = n_nationkey""")
def endpoint_save(t, spark) -> DataFrame:
    endpoints = t("nation").select(F.col("n_nationkey").cast("long").alias("id"), F.lit(0).cast("long").alias("connection_id"), _id("n", "n_nationkey").alias("name"), F.lit("http://old").alias("url"), _live())
    fields = t("customer").select(F.col("c_custkey").cast("long").alias("id"), F.col("c_nationkey").cast("long").alias("api_schema_id"), F.col("c_name").alias("original_name"), _live())
    (endpoints, fields), merged = commands.save_endpoint(endpoints, fields, {"id": 3, "connection_id": 0, "name": None, "url": "http://x"}, [{"id": 1_000_001, "original_name": "f"}])
    (endpoints, fields), taken = commands.save_endpoint(endpoints, fields, {"id": 4, "connection_id": 0, "name": "n3"}, None)
    (endpoints, fields), gone = commands.delete_endpoint(endpoints, fields, 5)
    counts = catalog.live(fields).groupBy(F.col("api_schema_id").alias("id")).agg(F.count("*").alias("fields"))
    return _told(endpoints.join(counts, "id", "left").withColumn("fields", F.coalesce("fields", F.lit(0).cast("long"))), merged, taken, gone)


# Agents, model profiles, skills, sessions


def _profiles(t) -> DataFrame:
    return t("nation").select(
        _id("p", "n_nationkey").alias("profile_id"), F.concat(F.lit("m"), F.col("n_nationkey").cast("string")).alias("display_name"), F.lit("sealed").alias("encrypted_credential"), F.lit(1000).alias("context_window_input"),
        *(F.lit(None).cast("int").alias(c) for c in ("context_window_output", "tool_call_rounds", "vector_dimension")), F.when(F.col("n_nationkey") == 0, "DISABLED").otherwise("ENABLED").alias("status"), _live(),
    )


def _agents(t) -> tuple[DataFrame, DataFrame]:
    agents = t("customer").select(_id("a", "c_custkey").alias("agent_id"), F.col("c_name").alias("name"), (F.col("c_custkey") % 7 == 0).alias("archived"), F.lit(None).cast("timestamp").alias("archived_at"), F.lit(1).alias("latest_version"), _live())
    return agents, t("customer").select(_id("a", "c_custkey").alias("agent_id"), F.lit(1).alias("version_number"), F.lit("p2").alias("model_profile_id"), _live())


@query("""WITH a AS (SELECT 'a' || c_custkey AS agent_id, c_name AS name, c_custkey % 7 = 0 OR c_custkey = 2 AS archived, c_custkey = 2 AS stamped, CASE WHEN c_custkey = 1 THEN 2 ELSE 1 END AS latest_version, CASE WHEN c_custkey = 3 THEN 1 ELSE 0 END AS is_deleted FROM customer
UNION ALL SELECT 'anew', 'fresh', false, false, 1, 0)
SELECT *, CASE WHEN is_deleted = 1 THEN 0 ELSE latest_version END AS versions, 4 AS refused FROM a""")
def agent_commands(t, spark) -> DataFrame:
    profiles, (agents, versions) = _profiles(t), _agents(t)
    (agents, versions), made = commands.create_agent(agents, versions, {"agent_id": "anew", "name": "fresh"}, {"model_profile_id": "p1"}, profiles)
    (agents, versions), taken = commands.create_agent(agents, versions, {"agent_id": "aother", "name": "fresh"}, {"model_profile_id": "p1"}, profiles)
    (agents, versions), disabled = commands.create_agent(agents, versions, {"agent_id": "athird", "name": "third"}, {"model_profile_id": "p0"}, profiles)
    (agents, versions), published = commands.publish_agent(agents, versions, "a1", {"model_profile_id": "p3"}, profiles)
    (agents, versions), shelved = commands.publish_agent(agents, versions, "a7", {"model_profile_id": "p3"}, profiles)
    agents, archived = commands.archive_agent(agents, "a2", F.lit("2024-05-01 00:00:00").cast("timestamp"))
    agents, twice = commands.archive_agent(agents, "a2", F.lit("2025-05-01 00:00:00").cast("timestamp"))
    (agents, versions), gone = commands.delete_agent(agents, versions, "a3")
    counts = catalog.live(versions).groupBy("agent_id").agg(F.count("*").alias("versions"))
    shown = agents.join(counts, "agent_id", "left").select("agent_id", "name", "archived", F.col("archived_at").isNotNull().alias("stamped"), "latest_version", "is_deleted", F.coalesce("versions", F.lit(0)).cast("int").alias("versions"))
    return _told(shown, made, taken, disabled, published, shelved, archived, twice, gone)


@query("""SELECT 'p' || n_nationkey AS profile_id, CASE WHEN n_nationkey = 4 THEN 'better' ELSE 'm' || n_nationkey END AS display_name, CASE WHEN n_nationkey <> 5 THEN 'sealed' END AS encrypted_credential, 1000 AS context_window_input,
CASE WHEN n_nationkey = 3 THEN 'DISABLED' ELSE 'ENABLED' END AS status, CASE WHEN n_nationkey = 6 THEN 1 ELSE 0 END AS is_deleted, 3 AS refused FROM nation
UNION ALL SELECT 'pnew', 'fresh', NULL, 10, 'ENABLED', 0, 3""")
def profile_commands(t, spark) -> DataFrame:
    df, (_, versions) = _profiles(t), _agents(t)
    df, made = commands.create_profile(df, {"profile_id": "pnew", "display_name": "fresh", "context_window_input": 10})
    df, empty = commands.create_profile(df, {"profile_id": "pbad", "display_name": "bad", "context_window_input": 0})
    df, kept = commands.update_profile(df, "p4", {"display_name": "better", "encrypted_credential": None})
    df, cleared = commands.update_profile(df, "p5", {"encrypted_credential": ""})
    df, on = commands.enable_profile(df, "p0")
    df, off = commands.disable_profile(df, "p3")
    df, again = commands.disable_profile(df, "p3")
    df, referred = commands.delete_profile(df, versions, "p2")
    df, gone = commands.delete_profile(df, versions, "p6")
    return _told(df.drop("context_window_output", "tool_call_rounds", "vector_dimension"), made, empty, kept, cleared, on, off, again, referred, gone)


@query("""SELECT 'k' || p_partkey AS skill_id, 1 AS version_number, p_name AS name, CASE WHEN p_partkey = 2 THEN 1 ELSE 0 END AS is_deleted, 2 AS refused FROM part
UNION ALL SELECT 'k1', 2, p_name, 0, 2 FROM part WHERE p_partkey = 1 UNION ALL SELECT 'knew', 1, 'fresh', 0, 2""")
def skill_commands(t, spark) -> DataFrame:
    df = t("part").select(_id("k", "p_partkey").alias("skill_id"), F.lit(1).alias("version_number"), F.col("p_name").alias("name"), _live())
    df, made = commands.publish_skill(df, {"skill_id": "knew", "name": "fresh"}, True)
    df, taken = commands.publish_skill(df, {"skill_id": "kother", "name": "fresh"}, True)
    df, following = commands.publish_skill(df, {"skill_id": "k1", "name": "ignored"}, False)
    df, unknown = commands.publish_skill(df, {"skill_id": "nowhere"}, False)
    df, gone = commands.delete_skill(df, "k2")
    return _told(df, made, taken, following, unknown, gone)


@query("""SELECT 's' || c_custkey AS session_id, 'a' || c_custkey AS agent_id, 1 AS agent_version, CASE WHEN c_custkey = 1 THEN 'RUNNING' WHEN c_custkey = 2 THEN 'TERMINATED' ELSE 'IDLE' END AS status,
CASE WHEN c_custkey = 3 THEN 'titled' ELSE c_name END AS title, NULL::VARCHAR AS metadata, 0 AS is_deleted, 3 AS refused FROM customer UNION ALL SELECT 'snew', 'a1', 1, 'IDLE', NULL, NULL, 0, 3""")
def session_commands(t, spark) -> DataFrame:
    agents, _ = _agents(t)
    df = t("customer").select(_id("s", "c_custkey").alias("session_id"), _id("a", "c_custkey").alias("agent_id"), F.lit(1).alias("agent_version"), F.lit("IDLE").alias("status"), F.col("c_name").alias("title"), F.lit(None).cast("string").alias("metadata"), _live())
    df, made = commands.create_session(df, agents, {"session_id": "snew", "agent_id": "a1"})
    df, archived = commands.create_session(df, agents, {"session_id": "sold", "agent_id": "a7"})
    df, taken = commands.acquire_session(df, "s1")
    df, busy = commands.acquire_session(df, "s1")
    df, ended = commands.terminate_session(df, "s2")
    df, late = commands.release_session(df, "s2")
    df, acquired = commands.acquire_session(df, "s4")
    df, released = commands.release_session(df, "s4")
    df, titled = commands.update_session(df, "s3", {"title": "titled", "metadata": None})
    return _told(df, made, archived, taken, busy, ended, late, acquired, released, titled)


@query("""WITH e AS (SELECT event_id, event_type, user_id FROM events) SELECT event_id::VARCHAR AS event_id, 'event_type' AS rule FROM e WHERE event_type = 'error' UNION ALL SELECT event_id::VARCHAR, 'sequence_num' FROM e WHERE user_id % 10 <= 0""")
def record_invariants(t, spark) -> DataFrame:
    log = t("events").select(F.col("event_id").cast("string").alias("event_id"), F.lit("s").alias("session_id"), F.when(F.col("event_type") == "error", " ").otherwise(F.col("event_type")).alias("event_type"), (F.col("user_id") % 10).alias("sequence_num"))
    return commands.broken_invariants(log, commands.invariants("chat_event")).select("event_id", "rule")


# Lookups and references


@query("SELECT * FROM customer WHERE c_custkey = 7")
def point_lookup(t, spark) -> DataFrame:
    return catalog.point_lookup(t("customer"), c_custkey=7)


@query("SELECT o_orderkey, o_orderstatus = 'F' AS archived FROM orders WHERE o_orderstatus <> 'F'")
def not_archived(t, spark) -> DataFrame:
    return catalog.not_archived(t("orders").select("o_orderkey", (F.col("o_orderstatus") == "F").alias("archived")))


@query("""WITH f AS (SELECT n_regionkey AS r, arg_min(n_nationkey, n_name) AS n FROM nation GROUP BY 1)
SELECT f.r AS connection_id, c_name AS name, 'TABLE' AS type FROM customer JOIN f ON c_nationkey = f.n UNION ALL SELECT s_nationkey, s_name, 'API' FROM supplier""")
def connection_tables(t, spark) -> DataFrame:
    schemas = t("nation").select(F.col("n_nationkey").alias("id"), F.col("n_regionkey").alias("connection_id"), F.col("n_name").alias("schema_name"))
    tables = t("customer").select(F.col("c_nationkey").alias("database_schema_id"), F.col("c_name").alias("table_name"))
    endpoints = t("supplier").select(F.col("s_nationkey").alias("connection_id"), F.col("s_name").alias("name"))
    return catalog.table_list("JDBC", schemas, tables, endpoints).unionByName(catalog.table_list("API", schemas, tables, endpoints))


@query("SELECT p_partkey AS id, p_partkey % 9 AS table_id, p_name AS column_name, 'number' AS data_type, NULL::VARCHAR AS column_comment, upper(p_name) AS column_custom_comment FROM part")
def api_columns(t, spark) -> DataFrame:
    fields = t("part").select(F.col("p_partkey").alias("id"), (F.col("p_partkey") % 9).alias("api_schema_id"), F.col("p_name").alias("original_name"), F.lit("number").alias("field_type"), F.lit(None).cast("string").alias("description"), F.upper("p_name").alias("display_name"))
    return catalog.api_fields_as_columns(fields)


@query("SELECT 'a' || c_custkey AS agent_id, 1 AS version_number, 'k' || p_partkey AS skill_id, 1 AS skill_version, p_name AS name FROM customer JOIN part ON p_partkey = c_nationkey + 1 WHERE c_custkey % 3 = 0")
def mounted_skills(t, spark) -> DataFrame:
    refs = F.when(F.col("c_custkey") % 3 == 0, F.concat(F.lit('[{"skillId":"k'), (F.col("c_nationkey") + 1).cast("string"), F.lit('","version":"1"},{"skillId":"nowhere","version":"1"}]'))).when(F.col("c_custkey") % 3 == 1, F.lit('[{"skillId":"k1","version":"1a"}]')).otherwise("no list")
    agents = t("customer").select(_id("a", "c_custkey").alias("agent_id"), F.lit(1).alias("version_number"), refs.alias("skill_ids"))
    skills = t("part").select(_id("k", "p_partkey").alias("skill_id"), F.lit(1).alias("version_number"), F.col("p_name").alias("name"))
    return catalog.mounted_skills(agents, skills).select("agent_id", "version_number", "skill_id", "skill_version", "name")


@query("SELECT conv_id, turn, CASE WHEN trim(text, ' ') <> '' THEN trim(text, ' ') END AS said FROM conversations")
def first_message(t, spark) -> DataFrame:
    blocks = F.array(F.struct(F.lit("image").alias("type"), F.lit("no").alias("text")), F.struct(F.lit("text").alias("type"), F.col("text")))
    inputs = F.array(F.struct(F.lit("event").alias("type"), blocks.alias("content")), F.struct(F.lit("message").alias("type"), F.slice(blocks, 1, 1).alias("content")), F.struct(F.lit("message").alias("type"), blocks.alias("content")))
    return t("conversations").select("conv_id", "turn", catalog.first_message_text(inputs).alias("said"))


# Scalar functions


@query("""SELECT c_custkey, '****...****' AS password, left(c_name, 4) || '****' AS credential, CASE WHEN length(c_name) > 6 THEN left(c_name, 6) || '…' ELSE c_name END AS short, to_base64(encode(c_name || ':x')) AS basic,
'JDBC:' || c_mktsegment AS label, 'openai:' || c_name AS model, CASE WHEN c_nationkey >= 1 THEN c_nationkey END AS strict, c_nationkey AS lenient, c_custkey AS resume, 'a=' || c_custkey || '&b+c=1%262' AS pairs FROM customer""")
def text_functions(t, spark) -> DataFrame:
    key = F.col("c_custkey").cast("string")
    nation = F.col("c_nationkey").cast("string")
    pairs = text.url_pairs(F.array(F.lit("a"), F.lit("b c"), F.lit(" "), F.lit("d")), F.array(key, F.lit("1&2"), F.lit("x"), F.lit(None)))
    return t("customer").select(
        "c_custkey", text.mask_password(F.col("c_name")).alias("password"), text.mask_credential(F.col("c_name")).alias("credential"), text.shorten(F.col("c_name"), 6).alias("short"), text.basic_credential(F.col("c_name"), F.lit("x")).alias("basic"),
        text.type_label(F.lit("JDBC"), F.col("c_mktsegment")).alias("label"), text.model_id(F.lit("OpenAI"), F.col("c_name")).alias("model"), text.strict_version(nation).alias("strict"),
        text.lenient_version(F.concat(F.lit(" "), nation)).alias("lenient"), text.parse_offset(key).alias("resume"), pairs.alias("pairs"),
    )


@query(r"""WITH m AS (SELECT doc_id, length(text) AS n, regexp_replace(regexp_replace(text, '(sk-)[\w-]+', '\1***', 'g'), '(Bearer\s+)\S+', '\1***', 'g') AS whole,
regexp_replace(regexp_replace(left(text, 3000), '(sk-)[\w-]+', '\1***', 'g'), '(Bearer\s+)\S+', '\1***', 'g') AS head, regexp_replace(regexp_replace(right(text, 981), '(sk-)[\w-]+', '\1***', 'g'), '(Bearer\s+)\S+', '\1***', 'g') AS tail FROM documents)
SELECT doc_id, CASE WHEN n > 4000 THEN head || chr(10) || '...(truncated)...' || chr(10) || tail ELSE whole END AS shown FROM m""")
def truncate_head_tail(t, spark) -> DataFrame:
    return t("documents").select("doc_id", text.truncate_head_tail(F.col("text"), 4000).alias("shown"))


@query("""SELECT event_id, strftime(ts + INTERVAL 8 HOUR, '%Y-%m-%dT%H:%M:%S') || CASE WHEN epoch_us(ts) % 1000000 = 0 THEN '' ELSE '.' || rtrim(lpad((epoch_us(ts) % 1000000)::VARCHAR, 6, '0'), '0') END || '+08:00' AS created_at FROM events""")
def iso_offsets(t, spark) -> DataFrame:
    ts = F.convert_timezone(F.lit("UTC"), F.current_timezone(), F.col("ts")).cast("timestamp")
    return t("events").select("event_id", dates.iso_offset(ts).alias("created_at"))


@query("SELECT event_id, CASE WHEN user_id % 3 = 0 THEN '{}' ELSE '{\"k\":' || (props->>'$.k') || '}' END AS body, [event_id, user_id] AS ids, user_id % 3 <> 1 AS fits FROM events")
def json_documents(t, spark) -> DataFrame:
    broken = F.when(F.col("user_id") % 3 == 0, F.lit("{not json")).otherwise(F.to_json(F.struct(F.get_json_object("props", "$.k").cast("long").alias("k"))))
    ids = F.concat(F.lit("["), F.col("event_id").cast("string"), F.lit(","), F.col("user_id").cast("string"), F.lit("]"))
    declared = F.when(F.col("user_id") % 3 == 0, F.upper(F.sha2("props", 256))).when(F.col("user_id") % 3 == 1, "wrong").otherwise(" ")
    return t("events").select("event_id", jsons.lenient_object(broken).alias("body"), jsons.strict_ids(ids).alias("ids"), secure.digest_ok(F.col("props"), declared).alias("fits"))


# The log (T10, T11, A8, N7, N9, K4, K7)


@query("""WITH r AS (SELECT event_id, user_id::VARCHAR AS session_id, CASE WHEN event_type = 'view' THEN 'RUNNING' ELSE 'COMPLETED' END AS status FROM events), s AS (SELECT c_custkey::VARCHAR AS session_id FROM customer WHERE c_mktsegment = 'BUILDING')
SELECT event_id AS round_id, session_id, CASE WHEN status = 'RUNNING' AND session_id IN (SELECT session_id FROM s) THEN 'INTERRUPTED' ELSE status END AS status FROM r""")
def recovered_rounds(t, spark) -> DataFrame:
    sessions = t("customer").select(F.col("c_custkey").cast("string").alias("session_id"), F.when(F.col("c_mktsegment") == "BUILDING", "RUNNING").otherwise("IDLE").alias("status"))
    log = t("events").select(F.col("event_id").alias("round_id"), F.col("user_id").cast("string").alias("session_id"), F.when(F.col("event_type") == "view", "RUNNING").otherwise("COMPLETED").alias("status"))
    return rounds.recover(sessions, log)[1]


@query("""SELECT c_custkey::VARCHAR AS session_id, 'IDLE' AS status FROM customer""")
def recovered_sessions(t, spark) -> DataFrame:
    sessions = t("customer").select(F.col("c_custkey").cast("string").alias("session_id"), F.when(F.col("c_mktsegment") == "BUILDING", "RUNNING").otherwise("IDLE").alias("status"))
    return rounds.recover(sessions, t("events").select(F.col("user_id").cast("string").alias("session_id"), F.lit("RUNNING").alias("status")))[0]


@query("""WITH e AS (SELECT user_id, event_id, ts AS s, ts + INTERVAL 1 HOUR AS e FROM events), w AS (SELECT *, max(e) OVER (PARTITION BY user_id ORDER BY s, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS u FROM e)
SELECT user_id, count(*) AS overlaps FROM w WHERE s < u GROUP BY user_id""")
def overlapping_rounds(t, spark) -> DataFrame:
    timed = t("events").select("user_id", F.col("ts").cast("timestamp").alias("s"), (F.col("ts") + F.expr("INTERVAL 1 HOUR")).cast("timestamp").alias("e"))
    return rounds.overlapping_rounds(timed, "user_id", "s", "e").groupBy("user_id").agg(F.count("*").alias("overlaps"))


def _tool_signals(t) -> DataFrame:
    """Each conversation as one tool call: its turns are the pieces of the arguments and then of the result."""
    null = lambda kind: F.lit(None).cast(kind)
    row = lambda seq, kind, said: F.struct(seq.cast("long").alias("seq"), F.lit(kind).alias("type"), said.alias("text"))
    turn = F.col("turn").cast("long")
    pieces = t("conversations").select("conv_id", F.explode(F.array(row(turn * 2 + 1, "TOOL_CALL_DELTA", F.col("text")), row(turn * 2 + 1_000_000, "TOOL_RESULT_TEXT_DELTA", F.col("text")))).alias("x"))
    ends = F.array(row(F.lit(0), "TOOL_CALL_START", null("string")), row(F.lit(999_999), "TOOL_CALL_END", null("string")), row(F.lit(9_000_000), "TOOL_RESULT_END", null("string")), row(F.lit(9_000_001), "AGENT_END", null("string")))
    both = pieces.unionByName(t("conversations").select("conv_id").distinct().select("conv_id", F.explode(ends).alias("x")))
    return both.select(
        F.col("conv_id").cast("string").alias("session_id"), F.lit("1").alias("round_id"), "x.seq", F.lit("2024-01-01 00:00:00").cast("timestamp").alias("ts"), "x.type", "x.text", null("string").alias("block_id"),
        F.lit("call").alias("tool_call_id"), F.lit("search").alias("tool_name"), null("string").alias("tool_state"), null("string").alias("result_text"), null("int").alias("input_tokens"), null("int").alias("output_tokens"), null("string").alias("model_name"),
    )


@query("""WITH c AS (SELECT conv_id, turn, text, coalesce(sum(length(text)) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before FROM conversations)
SELECT conv_id::VARCHAR AS session_id, turn * 2 + 1000000 AS seq, left(text, greatest(400 - before, 0)) AS head FROM c""")
def tool_result_heads(t, spark) -> DataFrame:
    return rounds.tool_results(_tool_signals(t), 400).select("session_id", "seq", "head")


@query("""WITH c AS (SELECT conv_id, turn, text, coalesce(sum(length(text)) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before FROM conversations),
w AS (SELECT conv_id, string_agg(text, '' ORDER BY turn) AS s, count(*) FILTER (left(text, greatest(400 - before, 0)) <> '') AS heads FROM c GROUP BY 1),
f AS (SELECT *, length(s) AS n, least(length(s) - 400, 400) AS tail FROM w)
SELECT conv_id::VARCHAR AS session_id, heads, CASE WHEN n > 400 THEN chr(10) || '...[中间省略 ' || (n - 400 - tail) || ' 字符]...' || chr(10) || right(s, tail::BIGINT) || chr(10) || '...[输出已截断，共 ' || n || ' 字符，仅保留首尾各 400 字符]...' || chr(10) ELSE '' END AS closing, n > 400 AS truncated FROM f""")
def tool_payloads(t, spark) -> DataFrame:
    made = rounds.events(_tool_signals(t), 400).filter("event_type = 'TOOL_CALL_OUTPUT'")
    block = lambda name: F.get_json_object("payload", f"$.content[0].{name}")
    last = F.get_json_object("payload", "$.is_last") == "true"
    return made.groupBy("session_id").agg(F.count(F.when(~last, 1)).alias("heads"), F.max(F.when(last, block("output"))).alias("closing"), F.max(F.when(last, block("truncated") == "true")).alias("truncated"))


def _said(t) -> DataFrame:
    """Conversations as chat events: user turns are thoughts, the others messages."""
    payload = F.to_json(F.struct(F.array(F.struct(F.lit("text").alias("type"), "text")).alias("content"), F.lit(False).alias("is_last")))
    return t("conversations").select(
        F.concat(F.lit("c"), F.col("conv_id").cast("string"), F.lit("-"), F.col("turn").cast("string")).alias("event_id"), F.col("conv_id").cast("string").alias("session_id"), F.lit("1").alias("round_id"),
        F.when(F.col("role") == "user", "THINKING").otherwise("MESSAGE").alias("event_type"), payload.alias("payload"), (F.col("turn") + 1).cast("long").alias("sequence_num"), F.lit("2024-01-01 00:00:00").cast("timestamp").alias("created_at"),
    )


@query("""SELECT conv_id::VARCHAR AS session_id, coalesce(string_agg(text, '' ORDER BY turn) FILTER (role = 'user'), '') AS thinking, coalesce(string_agg(text, '' ORDER BY turn) FILTER (role <> 'user'), '') AS text FROM conversations GROUP BY 1""")
def client_messages(t, spark) -> DataFrame:
    return envelope.messages(_said(t)).select("session_id", "thinking", "text")


@query("SELECT 'message' AS event, 'c' || conv_id || '-' || turn AS id, CASE WHEN role = 'user' THEN 'thinking' ELSE 'message' END AS type, turn + 1 AS sequence_number, text AS said, conv_id::VARCHAR AS session_id FROM conversations")
def server_sent_round_trip(t, spark) -> DataFrame:
    frames = envelope.parsed_frames(envelope.server_sent(envelope.envelopes(_said(t))))
    field = lambda path: F.get_json_object("data", path)
    return frames.select("event", field("$.id").alias("id"), field("$.type").alias("type"), field("$.sequence_number").cast("long").alias("sequence_number"), field("$.content[0].text").alias("said"), field("$.metadata.session_id").alias("session_id"))
