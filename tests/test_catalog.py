import pytest
from pyspark.sql import functions as F

from tidemill.operators import catalog, commands, sync
from tidemill.schemas import TABLES, table_schema
from tidemill.streaming import sinks


def table(spark, name, *rows):
    schema = table_schema(name)
    names = [c.split()[0] for c in schema.split(", ")]
    return spark.createDataFrame([tuple(({"is_deleted": 0} | r).get(n) for n in names) for r in rows], schema)


def ids(df, column="id"):
    return sorted(r[column] for r in df.collect())


def test_all_tables_have_a_schema(spark):
    for name in TABLES:
        assert "is_deleted" in spark.createDataFrame([], table_schema(name)).columns


def test_optional_conditions(spark):
    df = spark.createDataFrame([(1, "aXb", "X"), (2, "a_b", "Y"), (3, "AB", "X")], "id int, name string, kind string")
    assert ids(catalog.keyword(df, "name", "a_b")) == [1, 2]
    assert ids(catalog.keyword(df, "name", " ")) == [1, 2, 3]
    assert ids(catalog.conditions(df, {"name": "a"}, {"kind": "X"})) == [1]
    assert ids(catalog.conditions(df, {"name": None}, {"kind": ""}, {"kind": ["Y"]})) == [2]
    assert ids(catalog.conditions(df)) == [1, 2, 3]


def test_page_rules():
    assert catalog.clamp_page("datasource", 0, 0) == (1, 20)
    assert catalog.clamp_page("table", 2, -1) == (2, 50)
    assert catalog.clamp_page("agent", 1, 500) == (1, 100)
    for size in (0, 101):
        with pytest.raises(ValueError):
            catalog.clamp_page("session", 1, size)
    assert catalog.next_page(1, 20, 21) == 2 and catalog.next_page(1, 20, 20) is None
    assert [catalog.clamp_preview(n) for n in (None, 0, 5, 1000)] == [100, 1, 5, 100]


def test_renamed_versions_count_by_any_and_list_by_latest(spark):
    df = spark.createDataFrame([("a", 1, "old"), ("a", 2, "new"), ("b", 1, "old")], "k string, v int, name string")
    assert ids(catalog.keyword(catalog.latest(df, "k", "v"), "name", "old"), "k") == ["b"]
    assert catalog.group_count(catalog.keyword(df, "name", "old"), "k").first()["total"] == 2


def test_sequences_continue_from_a_base(spark):
    df = spark.createDataFrame([("a", 5), ("a", 3), ("b", 1)], "k string, at int")
    base = spark.createDataFrame([("a", 10)], "k string, base long")
    assert sorted(map(tuple, catalog.assign_sequence(df, "k", "at", base=base).select("k", "at", "sequence_num").collect())) == [("a", 3, 11), ("a", 5, 12), ("b", 1, 1)]


def test_lists_fields_and_skills(spark):
    schemas = spark.createDataFrame([(1, 7, "b"), (2, 7, "a")], "id long, connection_id long, schema_name string")
    tables = spark.createDataFrame([(2, "t1"), (1, "t2")], "database_schema_id long, table_name string")
    endpoints = spark.createDataFrame([(7, "e")], "connection_id long, name string")
    assert [tuple(r) for r in catalog.table_list("JDBC", schemas, tables, endpoints).collect()] == [(7, "t1", "TABLE")]
    assert [tuple(r) for r in catalog.table_list("API", schemas, tables, endpoints).collect()] == [(7, "e", "API")]
    fields = table(spark, "api_field", {"id": 1, "api_schema_id": 3, "original_name": "x", "field_type": "number"})
    assert catalog.api_fields_as_columns(fields).first()["data_type"] == "number"
    agents = table(spark, "agent_version", {"agent_id": "a", "version_number": 1, "skill_ids": '[{"skillId":"s","version":"2"},{"skillId":"s","version":"x"},{"skillId":"gone","version":"1"}]'}, {"agent_id": "b", "version_number": 1, "skill_ids": "{bad"})
    skills = table(spark, "skill_resource", {"skill_id": "s", "version_number": 2})
    assert [(r["agent_id"], r["skill_id"], r["skill_version"]) for r in catalog.mounted_skills(agents, skills).collect()] == [("a", "s", 2)]
    assert catalog.id_list_lookup(schemas, "id", []).count() == 0
    kind = "array<struct<type:string,content:array<struct<type:string,text:string>>>>"
    first = spark.createDataFrame([([("other", []), ("message", [("text", " ")]), ("message", [("text", " a"), ("image", "x"), ("text", "b ")])],)], f"inputs {kind}")
    assert first.select(catalog.first_message_text(F.col("inputs"))).first()[0] == "ab"


def test_sync(spark):
    t = lambda *rows: spark.createDataFrame(list(rows), "schema_name string, table_name string, table_comment string")
    c = lambda *rows: spark.createDataFrame(list(rows), "schema_name string, table_name string, column_name string, data_type string")
    remote, local = t(("s", "new", None), ("s", "same", "x"), ("s", "changed", "b")), t(("s", "same", "x"), ("s", "changed", "a"), ("s", "gone", None), ("lost", "t", None))
    rc, lc = c(("s", "same", "id", "int"), ("s", "same", "extra", "int")), c(("s", "same", "id", "long"), ("s", "same", "old", "int"), ("s", "gone", "id", "int"))
    tables, columns = sync.sync_catalogue(remote, rc, local, lc)
    assert {r["table_name"]: r["action"] for r in tables.collect()} == {"new": "insert", "same": "keep", "changed": "update", "gone": "remove"}
    assert {(r["table_name"], r["column_name"]): r["action"] for r in columns.collect()} == {("same", "extra"): "insert", ("same", "id"): "keep", ("same", "old"): "keep", ("gone", "id"): "remove"}
    columns = sync.sync_catalogue(remote, rc, local, lc, True)[1]
    assert {r["column_name"]: r["action"] for r in columns.filter("table_name = 'same'").collect()} == {"extra": "insert", "id": "column_retyped", "old": "column_removed"}
    applied = sync.apply_tables(local.withColumn("is_deleted", F.lit(0)), tables)
    assert {r["table_name"]: (r["table_comment"], r["is_deleted"]) for r in applied.collect()} == {"same": ("x", 0), "changed": ("b", 0), "gone": (None, 1), "t": (None, 0), "new": (None, 0)}


def test_datasource_commands(spark):
    df = table(spark, "datasource_connection", {"id": 1, "name": "one", "status": "ENABLED"}, {"id": 2, "name": "two", "status": "DISABLED", "is_deleted": 1})
    assert commands.create_datasource(df, {"id": 3, "name": "one"})[1] and commands.create_datasource(df, {"id": 3, "name": "1x"})[1]
    df, error = commands.create_datasource(df, {"id": 3, "name": "two"})
    assert error is None and df.filter("id = 3").first()["status"] == "ENABLED"
    assert commands.update_datasource(df, 3, {"name": "one"})[1] == "the name is taken"
    df, error = commands.update_datasource(df, 3, {"name": "two", "description": "d"})
    assert error is None and df.filter("id = 3").first()["description"] == "d"
    assert commands.enable_datasource(df, 3, True)[1] and commands.may_sync(df, 3) is None
    df, _ = commands.disable_datasource(df, 3)
    assert commands.may_sync(df, 3) and commands.enable_datasource(df, 3, False)[1] == "the connection test failed"
    schemas, tables = table(spark, "database_schema", {"id": 5, "connection_id": 3}), table(spark, "table_info", {"id": 6, "database_schema_id": 5}, {"id": 7, "database_schema_id": 9})
    columns, endpoints, fields = table(spark, "column_info", {"id": 8, "table_id": 6}), table(spark, "api_schema", {"id": 9, "connection_id": 3}), table(spark, "api_field", {"id": 10, "api_schema_id": 9})
    assert commands.delete_datasource(df, 1, schemas, tables, columns, endpoints, fields)[1]
    after, error = commands.delete_datasource(df, 3, schemas, tables, columns, endpoints, fields)
    assert error is None and [ids(catalog.live(x)) for x in after] == [[1], [], [7], [], [], []]
    assert commands.comment(tables, 6, "table_custom_comment", "x" * 151)[1] and commands.comment(tables, 6, "table_custom_comment", "ok")[1] is None


def test_endpoint_commands(spark):
    e, f = table(spark, "api_schema"), table(spark, "api_field")
    (e, f), error = commands.save_endpoint(e, f, {"id": 1, "connection_id": 3, "name": "a", "url": "u"}, [{"id": 1, "original_name": "x"}])
    assert error is None and e.count() == 1 and f.count() == 1
    (e, f), _ = commands.save_endpoint(e, f, {"id": 1, "connection_id": 3, "name": None, "url": "v"}, [{"id": 2, "original_name": "y"}])
    assert e.first()["name"] == "a" and e.first()["url"] == "v" and ids(catalog.live(f)) == [2]
    assert commands.save_endpoint(e, f, {"id": 2, "connection_id": 3, "name": "a"}, None)[1]
    (e, f), _ = commands.delete_endpoint(e, f, 1)
    assert not ids(catalog.live(e)) and not ids(catalog.live(f)) and commands.delete_endpoint(e, f, 1)[1]


def test_agent_profile_and_skill_commands(spark):
    profiles = table(spark, "model_profile", {"profile_id": "p", "display_name": "P", "status": "ENABLED", "encrypted_credential": "c"})
    agents, versions = table(spark, "agent_definition"), table(spark, "agent_version")
    assert commands.create_agent(agents, versions, {"agent_id": "a", "name": "A"}, {"model_profile_id": "zz"}, profiles)[1]
    (agents, versions), error = commands.create_agent(agents, versions, {"agent_id": "a", "name": "A"}, {"version_id": "v1", "model_profile_id": "p"}, profiles)
    (agents, versions), error = commands.publish_agent(agents, versions, "a", {"version_id": "v2", "model_profile_id": "p"}, profiles)
    assert error is None and agents.first()["latest_version"] == 2 and ids(versions, "version_number") == [1, 2]
    assert commands.delete_profile(profiles, versions, "p")[1] == "agents refer to the model profile"
    profiles, _ = commands.update_profile(profiles, "p", {"encrypted_credential": None, "description": "d"})
    assert profiles.first()["encrypted_credential"] == "c"
    profiles, _ = commands.update_profile(profiles, "p", {"encrypted_credential": ""})
    assert profiles.first()["encrypted_credential"] is None
    assert commands.update_profile(profiles, "p", {"vector_dimension": 0})[1] and commands.create_profile(profiles, {"display_name": "P"})[1]
    off, _ = commands.disable_profile(profiles, "p")
    assert commands.publish_agent(agents, versions, "a", {"model_profile_id": "p"}, off)[1] == "the model profile is disabled"
    archived, _ = commands.archive_agent(agents, "a", F.current_timestamp())
    assert commands.publish_agent(archived, versions, "a", {"model_profile_id": "p"}, profiles)[1] == "the agent is archived" and catalog.not_archived(archived).count() == 0
    (_, gone), _ = commands.delete_agent(agents, versions, "a")
    assert commands.delete_profile(profiles, gone, "p")[1] is None
    skills, error = commands.publish_skill(table(spark, "skill_resource"), {"skill_id": "s", "name": "S"}, True)
    skills, error = commands.publish_skill(skills, {"skill_id": "s", "name": "ignored"}, False)
    assert error is None and [(r["name"], r["version_number"]) for r in skills.orderBy("version_number").collect()] == [("S", 1), ("S", 2)]
    assert commands.publish_skill(skills, {"skill_id": "t", "name": "S"}, True)[1] and commands.delete_skill(skills, "s")[1] is None


def test_session_commands(spark):
    agents = table(spark, "agent_definition", {"agent_id": "a", "archived": False, "latest_version": 4})
    sessions, _ = commands.create_session(table(spark, "agent_session"), agents, {"session_id": "s", "agent_id": "a"})
    assert sessions.first()["agent_version"] == 4
    sessions, _ = commands.acquire_session(sessions, "s")
    assert commands.acquire_session(sessions, "s")[1]
    stopped, _ = commands.terminate_session(sessions, "s")
    assert commands.release_session(stopped, "s")[1] and commands.terminate_session(stopped, "s")[1]
    sessions, _ = commands.update_session(sessions, "s", {"title": "t", "metadata": None})
    assert sessions.first()["title"] == "t" and commands.release_session(sessions, "s")[1] is None


def test_invariants_and_upserts(spark):
    events = table(spark, "chat_event", {"event_id": "e", "session_id": "s", "event_type": "MESSAGE", "sequence_num": 1}, {"event_id": " ", "session_id": "s", "event_type": "MESSAGE"})
    assert ids(commands.broken_invariants(events, commands.invariants("chat_event")), "rule") == ["event_id", "sequence_num"]
    current = spark.createDataFrame([("a", 1, "x"), ("b", 1, "y")], "k string, at int, v string")
    changes = spark.createDataFrame([("a", 2, "p"), ("a", 3, "q"), ("c", 1, "z")], "k string, at int, v string")
    assert sorted((r["k"], r["v"]) for r in sinks.upsert(current, changes, "k", "at").collect()) == [("a", "q"), ("b", "y"), ("c", "z")]
