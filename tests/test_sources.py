import io
import json
import threading
import zipfile
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from urllib.parse import parse_qs, urlsplit

import duckdb
import pytest

from tidemill.plans import preview
from tidemill.sources import httpjson, jdbc, skills


class Server(ThreadingHTTPServer):
    """Counts calls; /flaky fails twice, /pages has numbered pages, /stuck ignores the page."""

    def __init__(self):
        self.calls, self.seen = {}, []
        super().__init__(("127.0.0.1", 0), Handler)


class Handler(BaseHTTPRequestHandler):
    def log_message(self, *a):
        pass

    def do_POST(self):
        self.do_GET()

    def do_GET(self):
        url = urlsplit(self.path)
        query = {k: v[0] for k, v in parse_qs(url.query).items()}
        body = self.rfile.read(int(self.headers.get("Content-Length") or 0)).decode()
        n = self.server.calls[url.path] = self.server.calls.get(url.path, 0) + 1
        self.server.seen.append((url.path, query, dict(self.headers), body))
        status, out = 200, {}
        if url.path == "/items":
            out = {"data": [{"id": 1, "name": "a"}, {"id": 2}, None]}
        elif url.path == "/login":
            out = {"token": "abc123", "session": "s-1"}
        elif url.path == "/pages":
            page, size = int(query["page"]), int(query.get("size", 2))
            rows = [{"id": k} for k in range(7)][(page - 1) * size : page * size]
            out = {"rows": rows} | ({"total": "7"} if "total" in query else {})
        elif url.path == "/stuck":
            out = {"rows": [{"id": 0}]}
        elif url.path == "/flaky":
            status, out = (500, {}) if n <= 2 else (200, {"data": [{"id": 9}]})
        else:
            status = 404
        answer = json.dumps(out).encode()
        self.send_response(status)
        self.send_header("Content-Length", str(len(answer)))
        self.end_headers()
        self.wfile.write(answer)


@pytest.fixture
def server():
    s = Server()
    threading.Thread(target=s.serve_forever, daemon=True).start()
    yield s
    s.shutdown()


def url(server, path):
    return f"http://127.0.0.1:{server.server_port}{path}"


def load(spark, schema=None, **options):
    httpjson.register(spark)
    reader = spark.read.format("httpjson").options(**{k: v if isinstance(v, str) else json.dumps(v) for k, v in options.items()})
    return (reader.schema(schema) if schema else reader).load()


def test_single_fetch(spark, server):
    got = load(spark, "id long, name string", url=url(server, "/items"), json_path="$.data").collect()
    assert [tuple(r) for r in got] == [(1, "a"), (2, None), (None, None)]
    assert load(spark, url=url(server, "/items"), json_path="$.data").first()["row"] == '{"id": 1, "name": "a"}'
    assert load(spark, url=url(server, "/items"), json_path="$.none").count() == 0
    assert json.loads(load(spark, url=url(server, "/items"), raw="true").first()["value"])["data"][1] == {"id": 2}
    assert load(spark, url=url(server, "/items"), json_path="$.data", limit=2).count() == 2


@pytest.mark.parametrize("address", ["/pages?page=${page}&size=${size}", "/pages?page=${page}&size=${size}&total=1"])
def test_pages(spark, server, address):
    pagination = {"type": "PAGE_BASED", "size": 2, "total_path": "$.total"}
    ids = lambda **k: sorted(r["id"] for r in load(spark, "id long", url=url(server, address), json_path="$.rows", pagination=pagination, **k).collect())
    assert ids() == list(range(7))
    assert ids(limit=5) == list(range(5))


def test_named_page_parameters_and_a_source_that_ignores_them(spark, server):
    pagination = {"type": "PAGE_BASED", "size": 3, "page_param": "page", "size_param": "size", "max_pages": 10}
    assert load(spark, "id long", url=url(server, "/pages"), json_path="$.rows", pagination=pagination).count() == 7
    assert load(spark, "id long", url=url(server, "/stuck"), json_path="$.rows", pagination=pagination).count() == 10


def test_columns_are_typed_or_refused(spark, server):
    httpjson.check_type(httpjson.StructType.fromDDL("a array<int>, m map<string,date>, s struct<x:timestamp>, d decimal(5,2)"))
    for bad in ("b binary", "m map<int,int>", "a array<binary>"):
        with pytest.raises(ValueError):
            httpjson.check_type(httpjson.StructType.fromDDL(bad))
    kinds = httpjson.StructType.fromDDL("i int, l short, n decimal(5,2), d date, t timestamp, a array<int>, m map<string,long>, s struct<x:int,y:string>, b boolean")
    row = {"i": 1.9, "l": 70_000, "n": "12.345", "d": "2024-02-03", "t": "2024-02-03T04:05:06Z", "a": [1, "2", 2.5], "m": {"k": 3}, "s": {"x": 4}, "b": 1}
    got = {f.name: httpjson.convert(row[f.name], f.dataType) for f in kinds.fields}
    assert (got["i"], got["l"], str(got["n"]), str(got["d"]), got["t"].hour) == (None, None, "12.34", "2024-02-03", 4)
    assert (got["a"], got["m"], got["s"], got["b"]) == ([1, 2, None], {"k": 3}, (4, None), None)
    assert load(spark, "data array<struct<id:int,name:string>>", url=url(server, "/items")).first()["data"][0]["name"] == "a"


def test_endpoints_are_tried_and_sampled(server):
    told = httpjson.test_endpoints({"good": {"url": url(server, "/items"), "json_path": "$.data"}, "gone": {"url": url(server, "/none")}}, lambda _: None)
    assert told["good"] is None and "404" in told["gone"]
    tree, rows = httpjson.sample(json.dumps({"rows": [{"id": k} for k in range(30)]}), "$.rows")
    assert [f["name"] for f in tree] == ["id"] and len(rows) == 10


def test_packages_are_written_and_deleted(spark, tmp_path):
    from tidemill.sources import skills

    root = f"file://{tmp_path}/store"
    skills.write_package(spark, root, "s1", 2, b"zip")
    assert [(r["skill_id"], r["version_number"], bytes(r["content"])) for r in skills.packages(spark, root).collect()] == [("s1", 2, b"zip")]
    with pytest.raises(ValueError):
        skills.write_package(spark, root, "../s1", 2, b"zip")
    assert skills.delete_package(spark, root, "s1", 2) and not skills.delete_package(spark, root, "s1", 2)


def test_pre_operations_bind_values(spark, server):
    op = {"url": url(server, "/login"), "method": "POST", "body": '{"u":"x"}', "mappings": [{"name": "token", "json_path": "$.token", "location": "HEADER", "target": "X-Token"}, {"name": "session", "json_path": "$.session", "location": "QUERY"}]}
    load(spark, "id long", url=url(server, "/items"), method="POST", body='{"k":"${token}"}', json_path="$.data", pre_operations=[op], auth={"type": "BASIC", "username": "u", "password": "p"}).collect()
    path, query, headers, body = server.seen[-1]
    assert (path, query, headers["X-Token"], body) == ("/items", {"session": "s-1"}, "abc123", '{"k":"abc123"}')
    assert headers["Authorization"] == "Basic dTpw" and headers["Content-Type"] == "application/json"
    assert server.calls["/login"] == 1


def test_form_bodies():
    request = httpjson.build({"url": "http://x/y", "method": "POST", "body_type": "FORM_URLENCODED", "params": {"a": "${v}", "b": "c d"}}, {"v": 1})
    assert request.data == b"a=1&b=c+d" and request.full_url == "http://x/y"
    assert httpjson.with_query("http://x/y?q=1", {"a": "é"}) == "http://x/y?q=1&a=%C3%A9"


def test_retries(server):
    slept = []
    settings = {"url": url(server, "/flaky"), "json_path": "$.data", "retry": 5}
    assert httpjson.fetch_page(settings, {}, [], slept.append)[0] == [{"id": 9}]
    assert slept == [1.0, 2.0]
    assert httpjson.waits(9) == [1, 2, 4, 8, 16] and httpjson.waits(-1) == [] and httpjson.waits(None) == []
    with pytest.raises(Exception):
        httpjson.fetch_page({"url": url(server, "/missing")}, {}, [], slept.append)


def test_overlay_and_bounds():
    assert httpjson.overlay({"url": "a", "auth": 1, "retry": 2}, {"url": "b", "auth": 2, "retry": None}) == {"url": "b", "auth": 1, "retry": 2}
    for bad in ({"size": 501}, {"max_pages": 10_001}):
        with pytest.raises(ValueError):
            httpjson.check_pagination(bad)


def test_jdbc_statements():
    mysql = jdbc.Connection("MYSQL", "h", None, "db")
    assert mysql.jdbc_url().startswith("jdbc:mysql://h:3306/db?") and jdbc.preview_sql(mysql, "db", "t`x", 5) == "SELECT * FROM `db`.`t``x` LIMIT 5"
    pg = jdbc.Connection("POSTGRESQL", "h", 1, "db")
    assert pg.jdbc_url() == "jdbc:postgresql://h:1/db?currentSchema=public" and pg.schema_name() == "public"
    for bad in ("a,b", "a;b", "pg_catalog"):
        with pytest.raises(ValueError):
            jdbc.check_schema(bad)
    with pytest.raises(ValueError):
        jdbc.Connection("CLICKHOUSE", "h").schema_name()
    told = {("28000", "x"): "authentication failed", ("08001", "x"): "the server can't be reached", ("08001", "timed out"): "the server can't be reached", ("3D000", None): "the schema does not exist", ("42501", "x"): "no access to the schema"}
    told |= {(None, "Read timed out"): "the server did not answer in time", ("HY000", "Unknown database 'x'"): "the database does not exist", (None, "Database y Not Found"): "the database does not exist", (None, "Access denied for user"): "authentication failed", (None, "odd"): "the connection failed: odd"}
    for (state, message), meaning in told.items():
        assert jdbc.diagnose(state, message) == meaning


def test_column_metadata_of_a_database_that_knows_both_catalogues():
    """The statements of two dialects on a database that has information_schema and pg_catalog: comments, positions, no views."""
    duck = duckdb.connect()
    duck.sql("CREATE TABLE ports (id INTEGER, name VARCHAR); CREATE VIEW seen AS SELECT * FROM ports; COMMENT ON COLUMN ports.name IS 'as painted'; CREATE SCHEMA other; CREATE TABLE other.t (x INTEGER)")
    mysql = jdbc.Connection("MYSQL", "h", None, "main")
    rows = duck.sql(jdbc.metadata_sql(mysql, jdbc.DIALECTS["MYSQL"].columns)).fetchall()
    assert sorted(rows) == [("ports", "id", "INTEGER", 1, None), ("ports", "name", "VARCHAR", 2, "as painted")]
    pg = jdbc.Connection("POSTGRESQL", "h", None, "db", schema="main")
    # Its own ids of types and columns differ, so here only the names that the statement uses and gives are held.
    assert duck.sql(jdbc.metadata_sql(pg, jdbc.DIALECTS["POSTGRESQL"].columns)).columns == ["table_name", "column_name", "data_type", "ordinal_position", "column_comment"]


def test_jdbc_over_derby(spark, tmp_path):
    address = f"jdbc:derby:{tmp_path}/db;create=true"
    spark.createDataFrame([(k, f"n{k}") for k in range(5)], "ID int, NAME string").write.format("jdbc").options(url=address, dbtable="APP.T", driver="org.apache.derby.iapi.jdbc.AutoloadedDriver").save()
    c = jdbc.Connection("POSTGRESQL", schema="APP", url=address, limit="FETCH FIRST {rows} ROWS ONLY", probe="SELECT 1 AS works FROM SYSIBM.SYSDUMMY1")
    few = jdbc.preview(spark, c, "T", 3)
    assert few.count() == 3 and "FETCH FIRST 3 ROWS" in few._jdf.queryExecution().toString()
    assert jdbc.test_connection(spark, c) == (True, "")
    assert jdbc.test_connection(spark, jdbc.Connection("POSTGRESQL", url=f"jdbc:derby:{tmp_path}/none")) == (False, "the database does not exist")
    with pytest.raises(Exception) as failed:
        jdbc.preview(spark, c, "NOWHERE", 3)
    assert jdbc.sql_state(failed.value)[0] == "42X05"
    assert jdbc.sql_state(ValueError("x")) == (None, "x")
    assert {r["type"] for r in jdbc.supported_types(spark).collect()} == {"MYSQL", "CLICKHOUSE", "POSTGRESQL", "API"}


def test_complex_values_as_text(spark):
    df = jdbc.as_text(spark.sql("SELECT 1 AS a, true AS b, date'2024-01-02' AS c, array(1,2) AS d"))
    assert dict(df.dtypes) == {"a": "int", "b": "boolean", "c": "string", "d": "string"}


def test_spark_catalogue(spark):
    spark.range(1).createOrReplaceTempView("a_view")
    assert "a_view" not in {r["table_name"] for r in jdbc.spark_tables(spark).collect()}
    assert [r["column_name"] for r in jdbc.spark_columns(spark, "a_view").collect()] == ["id"]


def test_skill_packages(spark, tmp_path):
    for skill, version, content in (("s1", 1, "---\nname: One\ndescription: 'first: skill'\n---\nbody"), ("s2", 2, "no front matter"), ("s3", 1, None)):
        path = tmp_path / skills.package_path(skill, version)
        path.parent.mkdir(parents=True)
        data = io.BytesIO()
        with zipfile.ZipFile(data, "w") as z:
            z.writestr("readme.txt", "x")
            if content is not None:
                z.writestr("pkg/SKILL.md", content)
        path.write_bytes(data.getvalue() if skill != "s3" else b"not a zip")
    known = spark.createDataFrame([("s2", 2, "Two", "second"), ("s3", 1, "Three", None)], "skill_id string, version_number int, name string, description string")
    got = {r["skill_id"]: (r["name"], r["description"]) for r in skills.described(skills.packages(spark, str(tmp_path)), known).collect()}
    assert got == {"s1": ("One", "first: skill"), "s2": ("Two", "second"), "s3": ("Three", None)}


def test_preview_refuses_and_dispatches(spark):
    df = spark.createDataFrame([(1, "ENABLED", 0), (2, "DISABLED", 0), (3, "ENABLED", 1)], "id int, status string, is_deleted int")
    assert preview.resolve(df, 1, {1})["id"] == 1
    for id, granted in ((1, {2}), (2, None), (3, None), (4, None)):
        with pytest.raises(preview.Refused):
            preview.resolve(df, id, granted)
    with pytest.raises(preview.Refused):
        preview.read(spark, {"type": "FTP"}, "t", 1)
    lines = preview.rendered_preview(spark, {"type": "PARQUET", "location": "/root/testdata/sf0.001"}, "region", 2).collect()
    assert len(lines) == 3
