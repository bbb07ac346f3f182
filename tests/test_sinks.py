import pytest
from pyspark.sql import functions as F

from tidemill.streaming import files, sinks

SCHEMA = "id int, at int, name string"


def test_upserts_survive_repeated_and_failed_batches(spark, tmp_path):
    log = sinks.UpsertLog(str(tmp_path / "log"), ["id"], ["at"])
    batch = lambda *rows: spark.createDataFrame(list(rows), SCHEMA)
    now = lambda: sorted(map(tuple, log.current(spark).collect()))
    with pytest.raises(FileNotFoundError):
        log.current(spark)
    log.write(batch((1, 1, "a"), (1, 3, "c"), (1, 2, "b"), (2, 1, None)), 0)
    log.write(batch((2, 2, "x"), (3, 1, "y")), 1)
    want = [(1, 3, "c"), (2, 2, "x"), (3, 1, "y")]
    assert now() == want
    broken = batch((1, 9, "never"), (4, 9, "never")).withColumn("name", F.when(F.col("id") == 4, F.raise_error(F.lit("lost"))).otherwise(F.col("name")))
    with pytest.raises(Exception, match="lost"):
        log.write(broken, 2)
    assert now() == want
    log.write(batch((2, 2, "x"), (3, 1, "y")), 1)
    assert now() == want
    log.write(batch((1, 3, "later"), (4, 0, "z")), 2)
    want = [(1, 3, "later"), *want[1:], (4, 0, "z")]
    assert now() == want
    log.compact(spark)
    log.compact(spark)
    log.write(batch((1, 8, "stale")), 0)  # the base holds batch 0
    assert now() == want and log._numbers(spark, "base") == [2]
    log.write(batch((4, 1, "new")), 3)
    assert now() == [*want[:3], (4, 1, "new")]


def test_last_writes_of_keys_and_ties(spark):
    rows = spark.createDataFrame([(None, 1, "n"), (None, 2, None), (1, 5, "a"), (1, 5, "b"), (1, None, "c")], SCHEMA)
    assert sorted(map(tuple, sinks.last_writes(rows, ["id"], ["at"]).collect()), key=str) == [(1, 5, "b"), (None, 2, None)]
    assert sinks.last_writes(rows.limit(0), ["id"], ["at"]).collect() == []


def test_a_stream_that_stops_goes_on_where_it_was(spark, tmp_path):
    """The first run's second batch fails after it was written; the second run repeats it and ends with each row once."""
    source = files.as_stream(spark.range(30).select("id", F.col("id").alias("at")), "id", 3)
    log, failed = sinks.UpsertLog(str(tmp_path / "log"), ["id"], ["at"]), []

    def write(batch, number):
        log.write(batch, number)
        if number == 1 and not failed:
            failed.append(1)
            raise RuntimeError("stopped")

    run = lambda: source.writeStream.foreachBatch(write).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination()
    with pytest.raises(Exception, match="stopped"):
        run()
    run()
    assert failed and sorted(r["id"] for r in log.current(spark).collect()) == list(range(30))


def test_streams_over_empty_tables(spark, tmp_path):
    out = str(tmp_path / "out")
    empty = spark.createDataFrame([], "id long")
    files.run_through(files.as_stream(empty, "id"), lambda b, n: b.write.mode("append").parquet(out), "empty")
    live = files.as_stream(spark.createDataFrame([], "event_id long, session_id string, sequence_num long, created_at timestamp"), "event_id")
    log = spark.createDataFrame([(1, "s", 1, None), (2, "s", 2, None)], "event_id long, session_id string, sequence_num long, created_at timestamp")
    write = sinks.append_events(out + "2")
    files.run_through(sinks.replay_then_follow(log, live, 1, write), write, "none")
    assert [r["event_id"] for r in spark.read.schema(log.schema).parquet(out + "2").collect()] == [2]


def test_a_batch_of_many_files_is_one_trigger(spark):
    """Batches of unlike sizes, an empty one among them, keep their bounds, and no task handles a whole one."""
    rows = spark.range(400).select(F.when(F.col("id") < 390, F.col("id")).otherwise(F.col("id") + 800).alias("id"))
    seen = []
    files.run_through(files.as_stream(rows, "id", 3, rows_a_file=20), lambda b, n: seen.append((sorted(r["id"] for r in b.collect()), b.select(F.input_file_name()).distinct().count())), "many")
    assert [ids for ids, _ in seen] == [[*range(390)], [], [*range(1190, 1200)]]
    assert seen[0][1] > 1


def test_a_batch_is_spread_over_its_files(spark):
    """Numbers that lie in order in the table don't leave a batch to the tasks that hold its range."""
    seen = []
    files.run_through(files.as_stream(spark.range(0, 3000, 1, 3), "id", 3, rows_a_file=100), lambda b, n: seen.append(sorted(r["n"] for r in b.groupBy(F.input_file_name()).agg(F.count("*").alias("n")).collect())), "spread")
    assert [sum(x) for x in seen] == [1000] * 3
    assert all(len(x) == 10 and max(x) < 300 for x in seen)
