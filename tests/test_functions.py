import itertools
import json
import os
from collections import Counter
from datetime import datetime, timezone
from zoneinfo import ZoneInfo

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from tidemill.functions import dates, jsons, secure, text

NOW = datetime(2024, 1, 31, 9, 5, 7, tzinfo=ZoneInfo("Asia/Shanghai"))


def one(spark, column, **values):
    return spark.range(1).select(*(F.lit(v).alias(k) for k, v in values.items())).select(column).first()[0]


@pytest.mark.parametrize(
    "expression,value",
    [
        ("today", "2024-01-31"), ("yyyy-MM-dd", "2024-01-31"), ("yyyyMMdd", "20240131"), ("yyyy-MM-dd HH:mm:ss", "2024-01-31 09:05:07"),
        ("year", "2024"), ("month", "1"), ("day", "31"), ("today-1", "2024-01-30"), ("today+1", "2024-02-01"), ("todayish", "${todayish}"),
        ("yyyy-MM-dd:+1M", "2024-02-29"), ("yyyy:-1y", "2023"), ("yyyyMMdd:+1d", "20240201"), ("HH:-2h", "07"), ("mm:+10m", "15"), ("yyyy:1", "2024"),
        ("yyyy-MM-dd:+3x", "2024-01-31"), ("timestamp", str(int(NOW.timestamp() * 1000))), ("nonsense!", "${nonsense!}"), ("HH:mm", "09"), ("token", "t1"), ("none", ""),
    ],
)
def test_date_templates(expression, value):
    assert dates.evaluate(expression, {"token": "t1", "none": None}, NOW) == value


def test_substitution_fills_each_template():
    assert dates.substitute("a=${today}&b=${x}", {"x": 5}, NOW) == "a=2024-01-31&b=5"
    assert dates.substitute(None) is None and dates.substitute("") == ""


@pytest.mark.parametrize("zone", ["UTC", "America/New_York"])
@pytest.mark.parametrize("name", ["today", "today-1", "yyyyMMdd:+1M", "year", "timestamp", "HH:-2h"])
def test_date_columns_do_not_depend_on_the_session_zone(spark, zone, name):
    old = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        ts = F.timestamp_seconds(F.lit(int(NOW.timestamp())))
        assert spark.range(1).select(dates.date_variable(name, ts)).first()[0] == dates.evaluate(name, None, NOW)
        assert spark.range(1).select(dates.iso_offset(ts)).first()[0] == "2024-01-31T09:05:07+08:00"
    finally:
        spark.conf.set("spark.sql.session.timeZone", old)


def test_durations_are_whole_and_never_negative(spark):
    t = lambda us: F.timestamp_micros(F.lit(us))
    assert spark.range(1).select(dates.duration_ms(t(0), t(1999))).first()[0] == 1
    assert spark.range(1).select(dates.duration_ms(t(5000), t(0))).first()[0] == 0


@pytest.mark.parametrize(
    "value,masked",
    [
        ("key1=sk-aaa111 key2=sk-bbb222 bearer=Bearer tok333", "key1=sk-*** key2=sk-*** bearer=Bearer ***"),
        ("sk-abc-def-ghi-123", "sk-***"), ("", ""), (None, None), ("nothing here", "nothing here"),
    ],
)
def test_secrets_are_masked(spark, value, masked):
    assert one(spark, text.mask_secrets(F.col("v").cast("string")), v=value) == masked


def test_long_text_is_cut(spark):
    assert one(spark, text.sanitize(F.col("v")), v="x" * 2001) == "x" * 2000 + "...(truncated)"
    assert one(spark, text.sanitize(F.col("v")), v="x" * 2000) == "x" * 2000
    both = one(spark, text.truncate_head_tail(F.col("v"), 100, "<cut>"), v="a" * 100 + "b" * 100)
    assert both == "a" * 75 + "<cut>" + "b" * 20
    assert one(spark, text.truncate_head_tail(F.col("v"), 4, "<cut>"), v="abcdef") == "abcd"
    tail = one(spark, text.window_tail(F.col("v"), 4), v="HHHHMMMMMTTTT")
    assert "中间省略 5 字符" in tail and "\nTTTT\n" in tail and "共 13 字符" in tail
    assert one(spark, text.window_tail(F.col("v"), 4), v="HHHH") is None


def test_small_text_functions(spark):
    assert one(spark, text.mask_password(F.col("v")), v="x") == "****...****"
    assert one(spark, text.mask_credential(F.col("v")), v="abcdefg") == "abcd****"
    assert one(spark, text.shorten(F.col("v"), 3), v="abcdef") == "abc…"
    assert one(spark, text.type_label(F.col("a"), F.col("b")), a="JDBC", b="MYSQL") == "JDBC:MYSQL"
    assert one(spark, text.type_label(F.col("a"), F.col("b").cast("string")), a="API", b=None) == "API"
    assert one(spark, text.model_id(F.col("a"), F.col("b")), a="OPENAI", b="m-1") == "openai:m-1"
    assert [one(spark, text.strict_version(F.col("v")), v=v) for v in ("3", "0", "x", " 3")] == [3, None, None, None]
    assert [one(spark, text.lenient_version(F.col("v")), v=v) for v in ("3", "x", "")] == [3, 0, 0]
    assert [one(spark, text.parse_offset(F.col("v")), v=v) for v in ("7", "-1", "x", "")] == [7, 0, 0, 0]
    assert one(spark, text.basic_credential(F.col("a"), F.col("b")), a="u", b="p") == text.basic_credential_of("u", "p") == "dTpw"
    assert text.quote_identifier('a"b') == '"a""b"' and text.quote_identifier("a`b", "`") == "`a``b`"
    assert text.form_encode({"a b": "1&2", "": "x", "n": None}) == "a+b=1%262"
    assert one(spark, text.url_pairs(F.array(F.lit("a b"), F.lit("")), F.array(F.lit("1&2"), F.lit("x"))), x=1) == "a+b=1%262"


@pytest.mark.parametrize("name,ok", [("数据源_1", True), ("a-b", True), ("1a", False), ("a b", False), ("", False), ("a" * 65, False), ("a" * 64, True)])
def test_names(spark, name, ok):
    assert one(spark, text.valid_name(F.col("v"), 64), v=name) is ok


def test_rendering(spark):
    df = spark.createDataFrame([(1, "张三"), (2, None)], "id int, name string")
    assert [r["line"] for r in text.rendered(df).orderBy("line_no").collect()] == ["columns:id,name", "1,张三", "2,null"]


def nested_bodies():
    """JSON made of the given tables: each conversation with its turns, and events with their props."""
    turns, events = (pq.read_table(f"/root/testdata/sf0.001/{name}.parquet").to_pylist() for name in ("conversations", "events"))
    bodies = []
    for conv, group in itertools.groupby(sorted(turns, key=lambda r: (r["conv_id"], r["turn"])), lambda r: r["conv_id"]):
        bodies.append({"conv": conv, "open": conv % 2 == 0, "said": [{"role": r["role"], "size": {"chars": len(r["text"])}} for r in group], "topic": None, "tags": []})
    for e in events[:40]:
        bodies.append({"props": json.loads(e["props"]), "at": {"day": {"of": str(e["ts"])}}, "value": e["value"], "nested": [[e["user_id"]], []], "mixed": [e["user_id"], {"a": 1}]})
    return bodies


def walked(body):
    """(path, type) of all fields, breadth first, by a queue; of an array the first element counts."""
    found, queue = [], [("$", body)]
    for path, value in queue:
        for name, v in value.items():
            kind = {dict: "object", list: "array", bool: "boolean", int: "number", float: "number"}.get(type(v), "string")
            found.append((f"{path}.{name}", kind))
            first = v[0] if isinstance(v, list) and v else v
            if isinstance(first, dict):
                queue.append((f"{path}.{name}" + (".*" if isinstance(v, list) else ""), first))
    return found


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="needs the test tables")
def test_fields_of_bodies_from_the_tables():
    bodies = nested_bodies()
    assert len(bodies) >= 60
    for body in bodies:
        text = json.dumps(body)
        flat = jsons.flat_fields(text)
        assert sorted((f["json_path"], f["type"]) for f in flat) == sorted(walked(body))
        assert [f["json_path"] for f in flat] == [x for f in jsons.field_tree(text) for x in tree_paths(f)]
        wrapped = json.dumps({"pages": {"items": [body, {}]}})
        for root in ("$.pages.items", "$.pages.items.*", "$.pages.items[*]"):
            assert len(jsons.flat_fields(wrapped, root)) == len(flat)
        for path, kind in walked(body):
            if kind in ("string", "number", "boolean") and ".*" not in path:
                with pytest.raises(ValueError):
                    jsons.flat_fields(text, path)
                assert jsons.field_tree(text, path) == []
        assert jsons.flat_fields(json.dumps([body])) == flat


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="needs the test tables")
def test_the_profile_counts_the_fields_of_all_bodies(spark):
    bodies = nested_bodies()
    want = Counter(x for body in bodies for x in walked(body))
    texts = [*map(json.dumps, bodies), "{cut", "3", "[]", "", None, '{"said":"text"}']
    want["$.said", "string"] += 1
    got = {r["json_path"]: r for r in jsons.field_profile(spark.createDataFrame([(x, 1) for x in texts], "body string, n int").repartition(3), "body").collect()}
    assert got.pop("")["types"] == {"none": 4}
    assert {(path, kind): n for path, r in got.items() for kind, n in r["types"].items()} == dict(want)
    for path, r in got.items():
        assert r["name"] == path.rsplit(".", 1)[1] and r["n"] == sum(r["types"].values())
        assert r["type"] == min(r["types"], key=lambda k: (-r["types"][k], k))
        assert (r["parent"] or "$") == path.rsplit(".", 1)[0].removesuffix(".*") and r["depth"] == path.replace(".*", "").count(".")
    assert jsons.field_profile(spark.createDataFrame([], "body string"), "body").collect() == []


def tree_paths(field):
    return [field["json_path"], *(x for f in field["children"] for x in tree_paths(f))]


DOC = {"a": [{"b": 1}, {"b": 2}], "x y": {"c": 3}, "d": {"b": 4}}


@pytest.mark.parametrize(
    "path,value",
    [("$", DOC), ("$.a[0].b", 1), ("$.a[-1].b", 2), ("$.a[*].b", [1, 2]), ("$.a.*.b", [1, 2]), ("$['x y'].c", 3), ("$..b", [1, 2, 4]), ("$.a[0:1]", [{"b": 1}]), ("$.a[*].zz", [])],
)
def test_paths(path, value):
    assert jsons.read_path(DOC, path) == value


def test_missing_paths_and_bad_ones():
    with pytest.raises(jsons.PathMissing):
        jsons.read_path(DOC, "$.zz")
    with pytest.raises(ValueError):
        jsons.read_path(DOC, "$.a[")


def test_responses():
    assert jsons.parse_response('{"data":[{"id":1},null],"n":"7"}', "$.data", "$.n") == ([{"id": 1}, {}], 7, True)
    assert jsons.parse_response('{"other":1}', "$.data") == ([], None, False)
    assert jsons.parse_response('{"data":[{"id":1}],"n":1}', "$.data", "$.n")[2] is False
    assert jsons.parse_response('{"id":1}') == ([{"id": 1}], None, True)
    with pytest.raises(ValueError):
        jsons.parse_response('{"data":[1]}', "$.data")


def test_json_columns(spark):
    assert [one(spark, jsons.lenient_object(F.col("v").cast("string")), v=v) for v in ('{"a":1}', "{bad", "", None, "[1]")] == ['{"a":1}', "{}", "{}", "{}", "{}"]
    assert one(spark, jsons.strict_ids(F.col("v")), v="[1,2]") == [1, 2] and one(spark, jsons.strict_ids(F.col("v")), v="") == []
    with pytest.raises(Exception):
        one(spark, jsons.strict_ids(F.col("v")), v="[1,")
    assert one(spark, jsons.has_more(F.lit(3), F.col("n")), n=3) is False


def test_encryption(spark):
    key = F.lit("k")
    assert one(spark, secure.decrypt(secure.encrypt(F.col("v"), key), key), v="秘密") == "秘密"
    assert one(spark, secure.decrypt(F.col("v"), key), v="plain text") == "plain text"
    assert one(spark, secure.encrypt(F.col("v"), key), v="") == ""
    with pytest.raises(Exception):
        one(spark, secure.decrypt(F.col("v"), key), v="QUJDREVGR0hJSktMTU5PUFFSU1RVVldYWVo=")
    digest = one(spark, F.sha2(F.col("v"), 256), v="abc")
    assert one(spark, secure.digest_ok(F.col("v"), F.lit(digest.upper())), v="abc") and one(spark, secure.digest_ok(F.col("v"), F.lit(" ")), v="abc")
    assert not one(spark, secure.digest_ok(F.col("v"), F.lit("00")), v="abc")
    assert not one(spark, secure.size_ok(F.col("v").cast("binary")), v="")


def test_utc_now_is_read_in_the_zone():
    assert dates.evaluate("today", None, datetime(2024, 1, 30, 20, tzinfo=timezone.utc)) == "2024-01-31"


def test_path_filters_and_unions():
    doc = {"boats": [{"hull": "oak", "knots": 7.5}, {"hull": "tar", "knots": 3}, {"oars": 2}], "a": 1, "b": 2}
    read = lambda p: jsons.read_path(doc, p)
    assert read("$.boats[?(@.knots > 3)].hull") == ["oak"] and read("$.boats[?(@.hull == 'tar' || @.oars)]") == doc["boats"][1:]
    assert read("$.boats[?(@.hull && @.knots < 5)].knots") == [3] and read("$.boats[?(!@.hull)].oars") == [2] and read("$.boats[?(@.hull >= 1)]") == []
    assert read("$.boats[0,2,9]") == [doc["boats"][0], doc["boats"][2]] and read("$['a','b','c']") == [1, 2]
    with pytest.raises(ValueError):
        read("$.boats[?(knots)]")


def test_more_date_patterns(spark):
    from pyspark.sql import functions as F

    now = datetime(2024, 2, 3, 16, 5, 6, 789_000, tzinfo=timezone.utc)
    t = now.astimezone(dates.ZoneInfo(dates.ZONE))
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    # Spark's own formatter reads the same patterns (Asia/Shanghai has no other offset).
    ts = F.lit("2024-02-04 00:05:06.789").cast("timestamp")
    patterns = ["EEE", "EEEE", "MMM d", "MMMM", "D", "DDD", "a hh:mm", "k", "K", "Q", "QQQ", "yy-MM", "SSS"]
    shown = spark.range(1).select(*(F.date_format(ts, p).alias(f"c{k}") for k, p in enumerate(patterns))).first()
    assert [dates.format_date(p, t) for p in patterns] == list(shown)
    assert [dates.format_date(p, t) for p in ("X", "XXX", "xx", "Z", "A", "n", "q", "i")] == ["+08", "+08:00", "+0800", "+0800", "306789", "789000000", "1", None]
