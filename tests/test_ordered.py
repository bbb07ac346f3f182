import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemill.operators import ordered


def one_by_one(machine, rows, commands):
    """Each command against the state that the ones before left."""
    state, told = dict(rows), {}
    for key, at, command in sorted(commands, key=lambda c: c[1]):
        now = state.get(key, machine.states[0])
        step = machine.steps.get((now, command), machine.unknown) if key is not None else machine.unknown
        told[at] = None if step in machine.states else step
        if told[at] is None:
            state[key] = step
    return {k: s for k, s in state.items() if s != machine.states[0]}, told


@pytest.mark.parametrize("machine", [ordered.DATASOURCE, ordered.SESSION, ordered.AGENT])
def test_commands_equal_one_by_one(spark, machine):
    rng = random.Random(len(machine.steps))
    rows = [(f"k{n}", rng.choice(machine.states[1:])) for n in range(0, 40, 2)]
    keys = [*(f"k{n}" for n in range(40)), *["k2"] * 30, None]
    commands = [(rng.choice(keys), at, rng.choice([*machine.commands(), "nonsense", None])) for at in rng.sample(range(10_000), 3000)]
    snapshot = spark.createDataFrame(rows, "name string, status string")
    table = spark.createDataFrame([(*c, "x") for c in commands], "name string, at long, command string, outcome_of string").repartition(5)
    after, told = ordered.fold_commands(snapshot, table, machine, "name", "at")
    want_rows, want = one_by_one(machine, rows, commands)
    assert {r["name"]: r["status"] for r in after.collect()} == want_rows
    assert told.columns == ["name", "at", "command", "outcome_of", "outcome"]
    assert {r["at"]: r["outcome"] for r in told.collect()} == want


def test_no_commands_and_no_rows(spark):
    snapshot = spark.createDataFrame([(1, "ENABLED")], "id long, status string")
    none = spark.createDataFrame([], "id long, at long, command string")
    after, told = ordered.fold_commands(snapshot, none, ordered.DATASOURCE, "id", "at")
    assert [tuple(r) for r in after.collect()] == [(1, "ENABLED")] and told.collect() == []
    after, told = ordered.fold_commands(snapshot.limit(0), spark.createDataFrame([(5, 1, "create")], none.schema), ordered.DATASOURCE, "id", "at")
    assert [tuple(r) for r in after.collect()] == [(5, "ENABLED")]


def test_a_hot_key_is_dealt_to_several_tasks(spark):
    df = spark.range(20_000).select(F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("k"), (F.col("id") % 50).cast("string"))).alias("k"), ((F.col("id") * 7919) % 20_011).alias("at"))
    sizes = [r["count"] for r in ordered.in_ranges(df, ["k"], ["at"], 16).groupBy(ordered.PART, "k").count().filter("k = 'hot'").collect()]
    assert len(sizes) >= 4 and max(sizes) < 20_000 / 8
    for keys in (["k"], []):
        want = df.withColumn("n", F.row_number().over(ordered.Window.partitionBy(*keys).orderBy("at")).cast("long"))
        assert ordered.numbered(df, keys, ["at"], "n").exceptAll(want).isEmpty() and ordered.numbered(df, keys, ["at"], "n").count() == 20_000


def test_numbers_with_nulls_and_bases(spark):
    df = spark.createDataFrame([(None, 2), ("a", 1), (None, 1), ("a", 5)], "k string, at int")
    base = spark.createDataFrame([("a", 10)], "k string, base long")
    assert sorted(map(tuple, ordered.numbered(df, ["k"], ["at"], base=base).collect()), key=str) == [("a", 1, 11), ("a", 5, 12), (None, 1, 1), (None, 2, 2)]


def test_functions_compose_along_groups():
    rng = np.random.default_rng(1)
    step, first = rng.integers(0, 4, (200, 4)), rng.random(200) < 0.05
    first[0] = True
    got = ordered.composed(step, first)
    for state in range(4):
        now = state
        for k in range(200):
            now = step[k][state if first[k] else now]
            assert got[k][state] == now


def test_versions_count_each_life(spark):
    agents = spark.createDataFrame([("a", "LIVE", 7), ("b", "ARCHIVED", 2)], "agent string, status string, latest_version int")
    said = [("a", "publish"), ("a", "delete"), ("a", "publish"), ("a", "create"), ("a", "publish"), ("b", "publish"), ("c", "create"), ("c", "publish"), ("c", "archive"), ("c", "publish")]
    commands = spark.createDataFrame([(k, n, c) for n, (k, c) in enumerate(said)], "agent string, at int, command string")
    rows, told = ordered.published_versions(agents, commands, "agent", "at")
    assert [r["version_number"] for r in told.orderBy("at").collect()] == [8, None, None, 1, 2, None, 1, 2, None, None]
    assert {r["agent"]: r["status"] for r in rows.collect()} == {"a": "LIVE", "b": "ARCHIVED", "c": "ARCHIVED"}


@pytest.mark.parametrize("keep", [1, 5, 40])
def test_both_ends_of_long_texts(spark, keep):
    rng = random.Random(keep)
    pieces = [(k, at, rng.choice(["", None, "é", "ab", "x" * 7, "数据数据"])) for k in ("hot", "b", "c") for at in range(400 if k == "hot" else 6)] + [("none", 1, None)]
    rng.shuffle(pieces)
    df = spark.createDataFrame(pieces, "k string, at int, text string").repartition(5)
    got = {r["k"]: tuple(r)[1:] for r in ordered.head_and_tail(df, ["k"], "text", ["at"], keep).collect()}
    for key in ("hot", "b", "c"):
        said = [t for k, _, t in sorted(pieces, key=lambda p: p[1]) if k == key and t]
        whole, begins = "".join(said), [sum(map(len, said[:n])) for n in range(len(said))]
        if whole:
            assert got.pop(key) == (len(whole), sum(b < keep for b in begins), whole[:keep], whole[max(keep, len(whole) - keep) :])
    assert not got
