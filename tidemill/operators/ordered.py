"""Work along the order of each key's rows without gathering a key in one task: ranges of (key, order), a part for each, and the parts' sums."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemill.functions.text import KEPT_LENGTH
from tidemill.streaming.files import new_folder

PART = "_part"


def in_ranges(df: DataFrame, keys: Sequence[str], order: Sequence[str], parts: int | None = None) -> DataFrame:
    """The rows with the number of their range in _part, written once: ranges of (keys, order), which split a key of many rows.

    Of the rows of a key, those of a smaller part come first. Rows that tie in keys and order stand in one part.
    """
    spark = df.sparkSession
    n = parts or max(int(spark.conf.get("spark.sql.shuffle.partitions")), 2)
    path = new_folder(spark, "ranges")
    df.repartitionByRange(n, *keys, *order).withColumn(PART, F.spark_partition_id()).write.parquet(path)
    return spark.read.parquet(path)


def before_parts(sums: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """(keys, _part, before): of each part of a key, the sum of `value` over the key's earlier parts. A key has a row a part at most."""
    w = Window.partitionBy(*keys).orderBy(PART).rowsBetween(Window.unboundedPreceding, -1)
    return sums.select(*keys, PART, F.coalesce(F.sum(value).over(w), F.lit(0)).alias("before"))


def numbered(df: DataFrame, keys: Sequence[str], order: Sequence[str], name: str = "sequence_num", base: DataFrame | None = None) -> DataFrame:
    """The rows with their number, from 1 or from their key's `base` on, in the order of their key; without keys, of all rows.

    A window over the key would sort each key in one task. Here each task numbers its range of a key, and the counts of the ranges
    before it are added. Rows that tie in the order get their numbers in no fixed order, as with any window.
    """
    ranged = in_ranges(df, keys, order)
    w = Window.partitionBy(*keys, PART)
    counts = ranged.groupBy(*keys, PART).agg(F.count("*").alias("n"))
    local = ranged.withColumn(name, F.row_number().over(w.orderBy(*order)).cast("long"))
    before = before_parts(counts, keys, "n") if keys else before_parts(counts.withColumn("_all", F.lit(0)), ["_all"], "n").drop("_all")
    on = local[PART] == before[PART]
    for k in keys:
        on = on & local[k].eqNullSafe(before[k])
    out = local.join(before, on).select(*(local[c] for c in df.columns if c != name), (local[name] + before["before"]).alias(name))
    if base is not None:
        out = out.join(base, list(keys), "left").withColumn(name, F.col(name) + F.coalesce("base", F.lit(0))).drop("base")
    return out


def head_and_tail(pieces: DataFrame, keys: Sequence[str], text: str, order: Sequence[str], keep: int = KEPT_LENGTH) -> DataFrame:
    """(keys, total, heads, head, tail) of each key's text, the pieces in order: its first `keep` characters, and of the rest the last
    `keep`; heads is the number of pieces that the head has characters of. Null and empty pieces add nothing.

    Each piece learns where it begins in its key's text by the lengths of the ranges before its own; of the pieces only those that reach
    into the head or the tail are gathered, 2 * keep characters a key at most, however long its text is. Keys aren't null.
    """
    sized = in_ranges(pieces.filter(F.length(text) > 0).withColumn("_length", F.length(text).cast("long")), keys, order)
    w = Window.partitionBy(*keys, PART)
    sums = sized.groupBy(*keys, PART).agg(F.sum("_length").alias("n"))
    totals = sums.groupBy(*keys).agg(F.sum("n").alias("total"))
    placed = sized.withColumn("_begin", F.sum("_length").over(w.orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)) - F.col("_length"))
    placed = placed.join(before_parts(sums, keys, "n"), [*keys, PART]).withColumn("_begin", F.col("_begin") + F.col("before")).join(totals, list(keys))
    rest = F.expr(rest_sql(keep))
    head = F.left(F.col(text), (F.lit(keep) - F.col("_begin")).cast("int"))
    tail = F.expr(f"substr({text}, cast(greatest({rest_sql(keep)} - _begin, 0) AS int) + 1)")
    cut = placed.select(*keys, "total", "_begin", F.when(F.col("_begin") < keep, head).alias("_head"), F.when(F.col("_begin") + F.col("_length") > rest, tail).alias("_tail")).filter("_head IS NOT NULL OR _tail IS NOT NULL")
    joined = lambda c: F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col(c).isNotNull(), F.struct("_begin", c)))), lambda p: p[c]), "")
    return cut.groupBy(*keys, "total").agg(F.count("_head").alias("heads"), joined("_head").alias("head"), joined("_tail").alias("tail"))


def rest_sql(keep: int) -> str:
    """Where the tail of a text begins: after the head, or `keep` characters before the end."""
    return f"greatest(total - {keep}, {keep})"


@dataclass(frozen=True)
class Machine:
    """What commands do to a row: its states, the first of which is that of a row that isn't there, and for each (state, command)
    the next state, or, as a text, why the command is refused. A command or a state that isn't listed is refused.
    """

    states: tuple[str, ...]
    steps: dict[tuple[str, str], str]
    unknown: str = "there is no such command"

    def commands(self) -> list[str]:
        return sorted({c for _, c in self.steps})

    def refusal(self, state: str, command: str) -> str | None:
        step = self.steps.get((state, command), self.unknown)
        return None if step in self.states else step

    def table(self) -> np.ndarray:
        """[command, state] the number of the next state; the last command is an unknown one, which changes nothing."""
        at = {s: k for k, s in enumerate(self.states)}
        rows = [[at.get(self.steps.get((s, c)), at[s]) for s in self.states] for c in self.commands()]
        return np.array([*rows, list(range(len(self.states)))], np.int64)


def composed(step: np.ndarray, first: np.ndarray) -> np.ndarray:
    """[row, state]: where a state is led by the rows of a group up to this one, given where each row leads it.

    `first` marks the rows that begin a group. In each round a row takes over what the row 1, 2, 4, ... places before leads to.
    """
    out = step.copy()
    start = np.maximum.accumulate(np.where(first, np.arange(len(first)), 0))
    d = 1
    while d < len(out):
        rows = np.flatnonzero(np.arange(len(out)) - start >= d)
        if not len(rows):
            break
        out[rows] = np.take_along_axis(out[rows], out[rows - d], axis=1)
        d *= 2
    return out


def _sorted(table: pa.Table, machine: Machine) -> tuple[pa.Table, np.ndarray, np.ndarray]:
    """A part's commands by key and order, the marks of the first ones of their keys, and where each leads each state."""
    table = table.sort_by([("_key", "ascending"), ("_order", "ascending")]).combine_chunks()
    key = table["_key"].to_numpy(zero_copy_only=False)
    first = np.ones(len(key), bool)
    first[1:] = key[1:] != key[:-1]
    known = {c: k for k, c in enumerate(machine.commands())}
    command = np.array([known.get(c, len(known)) for c in table["_command"].to_pylist()], np.int64)
    return table, first, machine.table()[command]


def fold_commands(snapshot: DataFrame, commands: DataFrame, machine: Machine, key: str, order: str, command: str = "command", state: str = "status") -> tuple[DataFrame, DataFrame]:
    """(the rows with their last state, the commands with `outcome`): every command in its key's order, as if one by one.

    snapshot: (key, state), at most a row a key; a key without one is in the machine's first state, and so does a row leave the snapshot. outcome
    is null where a command was carried out, else why it was refused. Commands of a null key are refused as unknown ones.
    It takes the same jobs however many commands there are: a command is a function from states to states, functions compose in any
    grouping, so ranges of a key's commands are composed in parallel (1), the ranges' functions are applied along the key,
    a row a range (2), and each range runs again from the state that it begins with (3).
    """
    spark, n = commands.sparkSession, len(machine.states)
    mine = commands.withColumns({"_key": F.col(key).cast("string"), "_order": F.col(order), "_command": F.col(command)})
    ranged = in_ranges(mine.filter(F.col(key).isNotNull()), ["_key"], ["_order"])
    number = F.coalesce(*(F.when(F.col(state) == s, F.lit(k)) for k, s in enumerate(machine.states)), F.lit(0))
    start = snapshot.filter(F.col(key).isNotNull()).select(F.col(key).cast("string").alias("_key"), number.cast("long").alias("start"))

    def functions(part: tuple, table: pa.Table) -> pa.Table:
        table, first, step = _sorted(table, machine)
        last = np.append(np.flatnonzero(first)[1:], len(first)) - 1
        return pa.table({"_key": table["_key"].take(pa.array(last)), PART: pa.array(np.full(len(last), part[0].as_py(), np.int32)), "leads": pa.array(composed(step, first)[last].tolist(), pa.list_(pa.int64()))})

    leads = ranged.select("_key", PART, "_order", "_command").groupBy(PART).applyInArrow(_plain(functions), f"_key string, {PART} int, leads array<long>")
    path = new_folder(spark, "leads")
    leads.write.parquet(path)
    leads = spark.read.schema("_key string, _part int, leads array<long>").parquet(path)
    # Along a key there is one function a range; a key in one range, as nearly all are, has one.
    every = F.array_sort(F.collect_list(F.struct(PART, "leads")))
    along = F.aggregate("parts", F.array(F.struct(F.lit(-1).alias("part"), F.coalesce("start", F.lit(0).cast("long")).alias("state"))), lambda done, p: F.concat(done, F.array(F.struct(p[PART].alias("part"), p["leads"][F.element_at(done, -1)["state"].cast("int")].alias("state")))))
    walked = leads.groupBy("_key").agg(every.alias("parts")).join(start, "_key", "left").select("_key", "parts", along.alias("states"))
    path = new_folder(spark, "walked")
    walked.select("_key", F.expr(f"transform(parts, (p, i) -> struct(p.{PART} AS {PART}, states[i].state AS begin))").alias("begins"), F.element_at("states", -1)["state"].alias("last")).write.parquet(path)
    walked = spark.read.parquet(path)
    begins = walked.select("_key", F.explode("begins").alias("b")).select("_key", f"b.{PART}", "b.begin")

    refusals = [[machine.refusal(s, c) for s in machine.states] for c in machine.commands()] + [[machine.unknown] * n]
    schema = ranged.drop(PART).schema.add("outcome", "string")

    def outcomes(part: tuple, table: pa.Table, begun: pa.Table) -> pa.Table:
        table, first, step = _sorted(table, machine)
        begun = begun.sort_by("_key")
        group = np.cumsum(first) - 1
        begin = begun["begin"].to_numpy()
        after = np.take_along_axis(composed(step, first), begin[group][:, None], axis=1)[:, 0]
        before = np.where(first, begin[group], np.append(0, after[:-1]))
        known = {c: k for k, c in enumerate(machine.commands())}
        told = [refusals[known.get(c, len(known))][s] for c, s in zip(table["_command"].to_pylist(), before.tolist())]
        return table.drop_columns([PART]).append_column("outcome", pa.array(told, pa.string()))

    done = ranged.groupBy(PART).cogroup(begins.groupBy(PART)).applyInArrow(_plain(outcomes), schema)
    refused = mine.filter(F.col(key).isNull()).withColumn("outcome", F.lit(machine.unknown))
    told = done.unionByName(refused).drop("_key", "_order", "_command")
    named = F.element_at(F.array(*(F.lit(s) for s in machine.states)), (F.coalesce("last", "start") + 1).cast("int"))
    rows = start.join(walked.select("_key", "last"), "_key", "full").select(F.col("_key").cast(snapshot.schema[key].dataType).alias(key), named.alias(state))
    return rows.filter(F.col(state) != machine.states[0]), told


def _plain(f):
    """Without annotations, from which Spark would guess how to call it."""
    f.__annotations__ = {}
    return f


#: Rows of a catalogue's commands.
DATASOURCE = Machine(
    ("ABSENT", "ENABLED", "DISABLED"),
    {
        ("ABSENT", "create"): "ENABLED", ("ENABLED", "create"): "the name is taken", ("DISABLED", "create"): "the name is taken",
        ("ABSENT", "enable"): "there is no such row", ("ENABLED", "enable"): "it is ENABLED, not DISABLED", ("DISABLED", "enable"): "ENABLED",
        ("ABSENT", "disable"): "there is no such row", ("ENABLED", "disable"): "DISABLED", ("DISABLED", "disable"): "it is DISABLED, not ENABLED",
        ("ABSENT", "delete"): "only a disabled data source is deleted", ("ENABLED", "delete"): "only a disabled data source is deleted", ("DISABLED", "delete"): "ABSENT",
        ("ABSENT", "sync"): "there is no such data source", ("ENABLED", "sync"): "ENABLED", ("DISABLED", "sync"): "only an enabled data source is synchronised",
    },
)
SESSION = Machine(
    ("ABSENT", "IDLE", "RUNNING", "TERMINATED"),
    {
        ("ABSENT", "create"): "IDLE", **{(s, "create"): "the session exists" for s in ("IDLE", "RUNNING", "TERMINATED")},
        **{("ABSENT", c): "there is no such row" for c in ("acquire", "release")}, ("ABSENT", "terminate"): "there is no such session",
        ("IDLE", "acquire"): "RUNNING", ("RUNNING", "acquire"): "it is RUNNING, not IDLE", ("TERMINATED", "acquire"): "it is TERMINATED, not IDLE",
        ("RUNNING", "release"): "IDLE", ("IDLE", "release"): "it is IDLE, not RUNNING", ("TERMINATED", "release"): "it is TERMINATED, not RUNNING",
        ("IDLE", "terminate"): "TERMINATED", ("RUNNING", "terminate"): "TERMINATED", ("TERMINATED", "terminate"): "it is terminated",
    },
)
AGENT = Machine(
    ("ABSENT", "LIVE", "ARCHIVED"),
    {
        ("ABSENT", "create"): "LIVE", ("LIVE", "create"): "the name is taken", ("ARCHIVED", "create"): "the name is taken",
        ("ABSENT", "publish"): "there is no such agent", ("LIVE", "publish"): "LIVE", ("ARCHIVED", "publish"): "the agent is archived",
        ("ABSENT", "archive"): "there is no such agent", ("LIVE", "archive"): "ARCHIVED", ("ARCHIVED", "archive"): "the agent is archived",
        ("ABSENT", "delete"): "there is no such agent", ("LIVE", "delete"): "ABSENT", ("ARCHIVED", "delete"): "ABSENT",
    },
)


def published_versions(agents: DataFrame, commands: DataFrame, key: str, order: str, command: str = "command") -> tuple[DataFrame, DataFrame]:
    """fold_commands() over AGENT, with `version_number` of the commands that were carried out: 1 for one that creates an agent, and one more for
    each that publishes it since. snapshot rows may have `latest_version`, from which their agent goes on.
    """
    rows, told = fold_commands(agents.select(key, "status"), commands, AGENT, key, order, command)
    made = told.filter(F.col("outcome").isNull() & F.col(command).isin("create", "publish"))
    # An agent that was deleted and created again counts from 1: its life is the number of creations so far.
    ranged = in_ranges(made.withColumn("_new", (F.col(command) == "create").cast("long")), [key], [order])
    w = Window.partitionBy(key, PART).orderBy(order)
    sums = ranged.groupBy(key, PART).agg(F.sum("_new").alias("n"))
    lives = ranged.withColumn("_life", F.sum("_new").over(w)).join(before_parts(sums, [key], "n"), [key, PART]).withColumn("_life", F.col("_life") + F.col("before")).drop("before", PART, "_new")
    counted = numbered(lives, [key, "_life"], [order], "version_number")
    if "latest_version" in agents.columns:
        base = agents.select(key, F.lit(0).cast("long").alias("_life"), F.col("latest_version").cast("long").alias("base"))
        counted = counted.join(base, [key, "_life"], "left").withColumn("version_number", F.col("version_number") + F.coalesce("base", F.lit(0))).drop("base")
    return rows, told.join(counted.select(key, order, "version_number"), [key, order], "left")
