"""Catalogue commands as pure transforms: (snapshot, command) gives (new snapshot, outcome).

A snapshot is a DataFrame of live and deleted rows; an outcome is None, or why the command was refused, in which case the
snapshot is returned as it was. Nothing is written; whoever holds the tables stores the new snapshot.
"""

from __future__ import annotations

import re
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemill.functions.text import NAME_LENGTHS

_HAN = r"一-鿿㐀-䶿〇"
COMMENT_LENGTH = 150


def name_error(name: str | None, kind: str) -> str | None:
    most = NAME_LENGTHS[kind]
    if not name or not re.fullmatch(rf"[{_HAN}a-zA-Z][{_HAN}a-zA-Z0-9_-]*", name) or len(name) > most:
        return f"not a name: {name!r}"
    return None


def _exists(df: DataFrame, condition: Column) -> bool:
    return not df.filter(condition & (F.col("is_deleted") == 0)).isEmpty()


def _changed(df: DataFrame, where: Column, changes: dict[str, Any]) -> DataFrame:
    value = lambda v: v if isinstance(v, Column) else F.lit(v)
    hit = where & (F.col("is_deleted") == 0)
    return df.select(*(F.when(hit, value(changes[f.name]).cast(f.dataType)).otherwise(F.col(f.name)).alias(f.name) if f.name in changes else F.col(f.name) for f in df.schema.fields))


def _added(df: DataFrame, row: dict[str, Any]) -> DataFrame:
    values = dict.fromkeys(df.columns) | {"is_deleted": 0} | row
    one = df.sparkSession.range(1).select(*(F.lit(values[f.name]).cast(f.dataType).alias(f.name) for f in df.schema.fields))
    return df.unionByName(one)


def _one(df: DataFrame, condition: Column) -> dict[str, Any] | None:
    row = df.filter(condition & (F.col("is_deleted") == 0)).first()
    return row.asDict() if row else None


# Data sources


def create_datasource(connections: DataFrame, row: dict[str, Any]) -> tuple[DataFrame, str | None]:
    """The name must be well-formed and free among live rows; a deleted row's name may be taken again."""
    if error := name_error(row.get("name"), "datasource"):
        return connections, error
    if _exists(connections, F.col("name") == row["name"]):
        return connections, "the name is taken"
    return _added(connections, {"status": "ENABLED"} | row), None


def update_datasource(connections: DataFrame, id: int, changes: dict[str, Any]) -> tuple[DataFrame, str | None]:
    """A blank password keeps the old one; the name may be the row's own or a free one."""
    if not _exists(connections, F.col("id") == id):
        return connections, "there is no such data source"
    name = changes.get("name")
    if name is not None:
        if error := name_error(name, "datasource"):
            return connections, error
        if _exists(connections, (F.col("name") == name) & (F.col("id") != id)):
            return connections, "the name is taken"
    kept = {k: v for k, v in changes.items() if v is not None and not (k == "password" and not str(v).strip())}
    return _changed(connections, F.col("id") == id, kept), None


def _switch(df: DataFrame, where: Column, needs: str, becomes: str, works: bool = True) -> tuple[DataFrame, str | None]:
    row = _one(df, where)
    if row is None:
        return df, "there is no such row"
    if row["status"] != needs:
        return df, f"it is {row['status']}, not {needs}"
    if not works:
        return df, "the connection test failed"
    return _changed(df, where, {"status": becomes}), None


def enable_datasource(connections: DataFrame, id: int, test_passed: bool) -> tuple[DataFrame, str | None]:
    return _switch(connections, F.col("id") == id, "DISABLED", "ENABLED", test_passed)


def disable_datasource(connections: DataFrame, id: int) -> tuple[DataFrame, str | None]:
    return _switch(connections, F.col("id") == id, "ENABLED", "DISABLED")


def may_sync(connections: DataFrame, id: int) -> str | None:
    row = _one(connections, F.col("id") == id)
    return "there is no such data source" if row is None else None if row["status"] == "ENABLED" else "only an enabled data source is synchronised"


def delete_below(parents: DataFrame, children: DataFrame, ref: str, key: str = "id") -> DataFrame:
    """Children of deleted parents, deleted too."""
    gone = parents.filter("is_deleted = 1").select(F.col(key).alias(ref)).distinct().withColumn("_gone", F.lit(True))
    joined = children.join(gone, ref, "left")
    return joined.withColumn("is_deleted", F.when(F.col("_gone"), F.lit(1).cast(children.schema["is_deleted"].dataType)).otherwise(F.col("is_deleted"))).select(*children.columns)


def delete_datasource(connections: DataFrame, id: int, schemas: DataFrame, tables: DataFrame, columns: DataFrame, endpoints: DataFrame, fields: DataFrame) -> tuple[tuple[DataFrame, ...], str | None]:
    """Only a disabled one, with all schemas, tables, columns, endpoints and fields below it."""
    everything = (connections, schemas, tables, columns, endpoints, fields)
    row = _one(connections, F.col("id") == id)
    if row is None or row["status"] != "DISABLED":
        return everything, "only a disabled data source is deleted"
    connections = _changed(connections, F.col("id") == id, {"is_deleted": 1})
    schemas = delete_below(connections, schemas, "connection_id")
    tables = delete_below(schemas, tables, "database_schema_id")
    columns = delete_below(tables, columns, "table_id")
    endpoints = delete_below(connections, endpoints, "connection_id")
    return (connections, schemas, tables, columns, endpoints, delete_below(endpoints, fields, "api_schema_id")), None


def comment(df: DataFrame, id: int, column: str, text: str | None) -> tuple[DataFrame, str | None]:
    if text is not None and len(text) > COMMENT_LENGTH:
        return df, f"a comment has at most {COMMENT_LENGTH} characters"
    return _changed(df, F.col("id") == id, {column: text}), None


def save_endpoint(endpoints: DataFrame, fields: DataFrame, row: dict[str, Any], new_fields: list[dict[str, Any]] | None) -> tuple[tuple[DataFrame, DataFrame], str | None]:
    """Creates the endpoint of a connection and name, or merges into it: null keeps the old value. Fields, if given,
    replace all old ones."""
    here = (F.col("connection_id") == row["connection_id"]) & (F.col("id") == row["id"])
    taken = (F.col("connection_id") == row["connection_id"]) & (F.col("name") == row.get("name")) & (F.col("id") != row["id"])
    if row.get("name") is not None and _exists(endpoints, taken):
        return (endpoints, fields), "the connection has an endpoint of that name"
    if _exists(endpoints, here):
        endpoints = _changed(endpoints, here, {k: v for k, v in row.items() if v is not None and k not in ("id", "connection_id")})
    else:
        endpoints = _added(endpoints, row)
    if new_fields is not None:
        fields = _changed(fields, F.col("api_schema_id") == row["id"], {"is_deleted": 1})
        for f in new_fields:
            fields = _added(fields, f | {"api_schema_id": row["id"]})
    return (endpoints, fields), None


def delete_endpoint(endpoints: DataFrame, fields: DataFrame, id: int) -> tuple[tuple[DataFrame, DataFrame], str | None]:
    if not _exists(endpoints, F.col("id") == id):
        return (endpoints, fields), "there is no such endpoint"
    endpoints = _changed(endpoints, F.col("id") == id, {"is_deleted": 1})
    return (endpoints, delete_below(endpoints, fields, "api_schema_id")), None


# Agents, model profiles and skills


def create_agent(agents: DataFrame, versions: DataFrame, agent: dict[str, Any], version: dict[str, Any], profiles: DataFrame) -> tuple[tuple[DataFrame, DataFrame], str | None]:
    if error := name_error(agent.get("name"), "agent") or profile_error(profiles, version.get("model_profile_id")):
        return (agents, versions), error
    if _exists(agents, F.col("name") == agent["name"]):
        return (agents, versions), "the name is taken"
    return (_added(agents, {"archived": False, "latest_version": 1} | agent), _added(versions, version | {"agent_id": agent["agent_id"], "version_number": 1})), None


def publish_agent(agents: DataFrame, versions: DataFrame, agent_id: str, version: dict[str, Any], profiles: DataFrame) -> tuple[tuple[DataFrame, DataFrame], str | None]:
    """A version after the latest one; not of an archived agent."""
    row = _one(agents, F.col("agent_id") == agent_id)
    if row is None or row["archived"]:
        return (agents, versions), "there is no such agent" if row is None else "the agent is archived"
    if error := profile_error(profiles, version.get("model_profile_id")):
        return (agents, versions), error
    number = (versions.filter((F.col("agent_id") == agent_id) & (F.col("is_deleted") == 0)).agg(F.max("version_number")).first()[0] or 0) + 1
    return (_changed(agents, F.col("agent_id") == agent_id, {"latest_version": number}), _added(versions, version | {"agent_id": agent_id, "version_number": number})), None


def archive_agent(agents: DataFrame, agent_id: str, at: Column) -> tuple[DataFrame, str | None]:
    row = _one(agents, F.col("agent_id") == agent_id)
    if row is None or row["archived"]:
        return agents, "there is no such agent" if row is None else "the agent is archived"
    return _changed(agents, F.col("agent_id") == agent_id, {"archived": True, "archived_at": at}), None


def delete_agent(agents: DataFrame, versions: DataFrame, agent_id: str) -> tuple[tuple[DataFrame, DataFrame], str | None]:
    if not _exists(agents, F.col("agent_id") == agent_id):
        return (agents, versions), "there is no such agent"
    return (_changed(agents, F.col("agent_id") == agent_id, {"is_deleted": 1}), _changed(versions, F.col("agent_id") == agent_id, {"is_deleted": 1})), None


def profile_error(profiles: DataFrame, profile_id: str | None) -> str | None:
    """Why a profile may not be newly referenced: it is unknown or disabled."""
    row = _one(profiles, F.col("profile_id") == profile_id) if profile_id else None
    return "there is no such model profile" if row is None else None if row["status"] == "ENABLED" else "the model profile is disabled"


def profile_values_error(row: dict[str, Any]) -> str | None:
    """Windows, rounds and dimensions must be positive where they are given."""
    for k in ("context_window_input", "context_window_output", "tool_call_rounds", "vector_dimension"):
        if row.get(k) is not None and row[k] <= 0:
            return f"{k} must be positive"
    return name_error(row.get("display_name"), "model_profile")


def create_profile(profiles: DataFrame, row: dict[str, Any]) -> tuple[DataFrame, str | None]:
    if error := profile_values_error(row):
        return profiles, error
    if _exists(profiles, F.col("display_name") == row["display_name"]):
        return profiles, "the name is taken"
    return _added(profiles, {"status": "ENABLED"} | row), None


def update_profile(profiles: DataFrame, profile_id: str, changes: dict[str, Any]) -> tuple[DataFrame, str | None]:
    """A credential of null is kept, an empty one cleared."""
    row = _one(profiles, F.col("profile_id") == profile_id)
    if row is None:
        return profiles, "there is no such model profile"
    kept = {k: (None if k == "encrypted_credential" and v == "" else v) for k, v in changes.items() if v is not None}
    if error := profile_values_error(row | kept):
        return profiles, error
    if _exists(profiles, (F.col("display_name") == (row | kept)["display_name"]) & (F.col("profile_id") != profile_id)):
        return profiles, "the name is taken"
    return _changed(profiles, F.col("profile_id") == profile_id, kept), None


def enable_profile(profiles: DataFrame, profile_id: str) -> tuple[DataFrame, str | None]:
    return _switch(profiles, F.col("profile_id") == profile_id, "DISABLED", "ENABLED")


def disable_profile(profiles: DataFrame, profile_id: str) -> tuple[DataFrame, str | None]:
    return _switch(profiles, F.col("profile_id") == profile_id, "ENABLED", "DISABLED")


def delete_profile(profiles: DataFrame, versions: DataFrame, profile_id: str) -> tuple[DataFrame, str | None]:
    """Not while a live agent version refers to it."""
    if _exists(versions, F.col("model_profile_id") == profile_id):
        return profiles, "agents refer to the model profile"
    if not _exists(profiles, F.col("profile_id") == profile_id):
        return profiles, "there is no such model profile"
    return _changed(profiles, F.col("profile_id") == profile_id, {"is_deleted": 1}), None


def publish_skill(skills: DataFrame, row: dict[str, Any], first: bool) -> tuple[DataFrame, str | None]:
    """Creates a skill (first) or its next version, which keeps the name. Content is stored before its row."""
    old = skills.filter((F.col("skill_id") == row["skill_id"]) & (F.col("is_deleted") == 0)).agg(F.max("version_number").alias("n"), F.max_by("name", "version_number").alias("name")).first()
    if first:
        if error := name_error(row.get("name"), "skill"):
            return skills, error
        if old["n"] is not None or _exists(skills, F.col("name") == row["name"]):
            return skills, "the name is taken"
        return _added(skills, row | {"version_number": 1}), None
    if old["n"] is None:
        return skills, "there is no such skill"
    return _added(skills, row | {"name": old["name"], "version_number": old["n"] + 1}), None


def delete_skill(skills: DataFrame, skill_id: str) -> tuple[DataFrame, str | None]:
    if not _exists(skills, F.col("skill_id") == skill_id):
        return skills, "there is no such skill"
    return _changed(skills, F.col("skill_id") == skill_id, {"is_deleted": 1}), None


# Sessions


def create_session(sessions: DataFrame, agents: DataFrame, row: dict[str, Any]) -> tuple[DataFrame, str | None]:
    """A session is bound to the agent's latest version at that time."""
    agent = _one(agents, F.col("agent_id") == row["agent_id"])
    if agent is None or agent["archived"]:
        return sessions, "there is no such agent" if agent is None else "the agent is archived"
    return _added(sessions, row | {"agent_version": agent["latest_version"], "status": "IDLE"}), None


def acquire_session(sessions: DataFrame, session_id: str) -> tuple[DataFrame, str | None]:
    """IDLE to RUNNING: one round at a time."""
    return _switch(sessions, F.col("session_id") == session_id, "IDLE", "RUNNING")


def release_session(sessions: DataFrame, session_id: str) -> tuple[DataFrame, str | None]:
    """RUNNING to IDLE; one that was terminated meanwhile stays so."""
    return _switch(sessions, F.col("session_id") == session_id, "RUNNING", "IDLE")


def terminate_session(sessions: DataFrame, session_id: str) -> tuple[DataFrame, str | None]:
    row = _one(sessions, F.col("session_id") == session_id)
    if row is None or row["status"] == "TERMINATED":
        return sessions, "there is no such session" if row is None else "it is terminated"
    return _changed(sessions, F.col("session_id") == session_id, {"status": "TERMINATED"}), None


def update_session(sessions: DataFrame, session_id: str, changes: dict[str, Any]) -> tuple[DataFrame, str | None]:
    """Title and metadata; null keeps the old value."""
    if not _exists(sessions, F.col("session_id") == session_id):
        return sessions, "there is no such session"
    return _changed(sessions, F.col("session_id") == session_id, {k: v for k, v in changes.items() if k in ("title", "metadata") and v is not None}), None


def broken_invariants(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """(rule, key values) of rows that break a rule; a null result breaks it too."""
    failed = F.filter(F.array(*(F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in rules.items())), lambda r: r.isNotNull())
    return df.withColumn("rule", F.explode(failed))


def invariants(table: str) -> dict[str, Column]:
    """What rows of a log table must hold."""
    filled = lambda c: F.trim(c) != ""
    return {
        "chat_event": {"event_id": filled("event_id"), "session_id": filled("session_id"), "event_type": filled("event_type"), "sequence_num": F.col("sequence_num") > 0},
        "execution_round": {"round_id": filled("round_id"), "session_id": filled("session_id"), "round_number": F.col("round_number") > 0, "status": F.col("status").isin("RUNNING", "COMPLETED", "FAILED", "INTERRUPTED")},
        "run_trace": {"trace_id": filled("trace_id"), "span_id": filled("span_id"), "span_name": filled("span_name"), "duration_ms": F.col("duration_ms").isNull() | (F.col("duration_ms") >= 0)},
    }[table]
