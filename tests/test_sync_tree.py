from pyspark.sql import functions as F

from tidemill.operators import sync


def rows(spark, *of):
    return spark.createDataFrame([(*r, *[None] * (5 - len(r))) for r in of], "schema_name string, table_name string, column_name string, comment string, data_type string")


def test_each_level_and_its_cascades(spark):
    remote = rows(spark, ("s",), ("s", "a", None, "said"), ("s", "a", "x", None, "int"), ("s", "a", "y", None, "text"), ("s", "new"), ("s", "new", "z", "c", "int"), ("s", "a", "x", None, "int"), ("s", "same", None, None))
    local = rows(spark, ("s",), ("s", "a", None, "old"), ("s", "a", "x", None, "long"), ("s", "a", "gone", None, "int"), ("s", "b", None, "b"), ("s", "b", "q", None, "int"), ("s", "same", None, "kept"), ("old",), ("old", "t"), ("old", "t", "u", None, "int"))
    acted = lambda **o: {tuple(r)[:3]: r["action"] for r in sync.changes(remote, local, **o).collect() if r["action"] != "keep"}
    base = {("s", "a", None): "update", ("s", "a", "y"): "insert", ("s", "new", None): "insert", ("s", "new", "z"): "insert", ("s", "b", None): "remove", ("s", "b", "q"): "remove"}
    assert acted() == base
    columns = {("s", "a", "gone"): "column_removed", ("s", "a", "x"): "column_retyped"}
    assert acted(detect_columns=True) == base | columns
    assert acted(detect_schemas=True) == base | {("old", None, None): "remove", ("old", "t", None): "remove", ("old", "t", "u"): "remove"}
    held = local.withColumns({"custom_comment": F.lit("mine"), "is_deleted": F.lit(0), "id": F.lit(7)})
    made = sync.changes(remote, local, detect_columns=True)
    after = {tuple(r)[:3]: r for r in sync.applied(held, made).collect()}
    assert len(after) == 13 and {k for k, r in after.items() if r["is_deleted"]} == {("s", "b", None), ("s", "b", "q"), ("s", "a", "gone")}
    assert after["s", "a", None]["comment"] == "said" and after["s", "same", None]["comment"] == "kept" and after["s", "a", "x"]["data_type"] == "int"
    assert {r["custom_comment"] for k, r in after.items() if r["id"] == 7} == {"mine"} and after["s", "new", "z"]["custom_comment"] is None
    assert {(r["level"], r["action"]): r["n"] for r in sync.level_counters(sync.changes(remote, local)).collect()} == {("table", "update"): 1, ("column", "insert"): 2, ("table", "insert"): 1, ("table", "remove"): 1, ("column", "remove"): 1}


def test_a_second_synchronisation_changes_nothing(spark):
    remote = rows(spark, ("s",), ("s", "a", None, "said"), ("s", "a", "x", None, "int"))
    held = rows(spark).withColumn("is_deleted", F.lit(0))
    once = sync.applied(held, sync.changes(remote, held.drop("is_deleted")))
    assert once.count() == 3
    assert sync.changes(remote, once.filter("is_deleted = 0")).filter("action <> 'keep'").isEmpty()


def test_empty_catalogues(spark):
    assert sync.changes(rows(spark), rows(spark)).collect() == []
    assert [r["action"] for r in sync.changes(rows(spark, ("s",), ("s", "t")), rows(spark)).collect()] == ["insert", "insert"]
    assert {r["action"] for r in sync.changes(rows(spark), rows(spark, ("s",), ("s", "t"))).collect()} == {"keep"}
