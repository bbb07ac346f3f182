import random
from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from tidemill.functions import dates, templates

LETTERS = {k: list(v[0]) for k, v in dates._FIELDS.items()}


def times(n=60, seed=1):
    rng = random.Random(seed)
    edges = [datetime(y, 12, d, 16, 0) for y in (2020, 2021, 2022, 2023, 2024) for d in (26, 28, 30, 31)] + [datetime(y, 1, d) for y in (2022, 2023, 2024) for d in (1, 2, 6, 7)]
    return edges + [datetime(2000, 1, 1) + timedelta(microseconds=rng.randrange(10**15)) for _ in range(n)] + [datetime(2024, 2, 29, 4, 0), datetime(2024, 5, 5, 16, 0)]


def compare(spark, expressions, context=None):
    """Columns against the driver's evaluation, row by row."""
    at = times()
    df = spark.createDataFrame([(k, (t - datetime(1970, 1, 1)) // timedelta(microseconds=1)) for k, t in enumerate(at)], "k int, micros long").withColumn("ts", F.timestamp_micros("micros"))
    shown = F.create_map(*(x for k, v in (context or {}).items() for x in (F.lit(k), F.lit(v).cast("string")))) if context else None
    rows = df.select("k", *(templates.filled(e, F.col("ts"), shown).alias(str(n)) for n, e in enumerate(expressions))).collect()
    for r in rows:
        now = at[r["k"]].replace(tzinfo=timezone.utc)
        for n, e in enumerate(expressions):
            assert r[str(n)] == dates.substitute(e, context, now), (e, now)


def test_every_field_at_every_width(spark):
    compare(spark, ["${" + letter * n + "}" for letter, widths in LETTERS.items() for n in widths])


def test_templates_with_shifts_contexts_and_what_is_no_pattern(spark):
    context = {"user": "u1", "none": None, "yyyy": "shadowed"}
    compare(
        spark,
        ["plain", "", "a ${today} b ${today-3}${today+40}", "${user}/${none}/${yyyy}/${year}-${month}-${day}", "${timestamp}", "${todayish}", "${yyyy-MM-dd HH:mm:ss}", "${yyyyMMdd:+1M}|${yyyyMMdd:-1y}|${HH:mm}|${yyyyMMddHH:+30h}|${mm:-90m}|${dd:+x}|${dd:9q}", "${bad pattern}", "${y''M}|${'it''s' d}|${[yyyy][-MM]}|${]}|${cc}|${WW}", "${V}|${VV}|${ZZZZZ}", "x${", "${}"],
        context,
    )


@pytest.mark.parametrize("pattern", ["yyyy-MM-dd'T'HH:mm:ss.SSSSSS", "D", "E", "EEEE", "MMM", "MMMM", "a hh", "k", "K", "Q", "QQQ"])
def test_fields_that_spark_has_print_alike(spark, pattern):
    df = spark.createDataFrame([(t,) for t in times()], "ts timestamp_ntz").select(F.convert_timezone(F.lit("UTC"), F.current_timezone(), "ts").cast("timestamp").alias("ts"))
    made = df.select(templates.date_column(pattern, F.col("ts")).alias("a"), F.date_format(dates.local_time(F.col("ts")), pattern).alias("b"))
    assert made.filter("a <> b or a is null").isEmpty()


def test_weeks_and_zones_of_known_days():
    day = lambda *a: datetime(*a, tzinfo=timezone(timedelta(hours=8)))
    shown = [(day(2024, 1, 1), "Y-w-W-e", "2024-1-1-2"), (day(2024, 1, 7), "w W", "2 2"), (day(2023, 12, 31), "Y w", "2024 1"), (day(2022, 12, 31), "Y w", "2022 53"), (day(2024, 2, 29), "F O OOOO z VV", "5 GMT+8 GMT+08:00 +08:00 +08:00"), (day(2024, 1, 1, 12), "B", "noon"), (day(2024, 1, 1, 12, 1), "B", "in the afternoon")]
    for t, pattern, want in shown:
        assert dates.format_date(pattern, t) == want


def test_templates_told_by_a_column(spark):
    df = spark.createDataFrame([("a", datetime(2024, 1, 1)), ("b", datetime(2024, 1, 1)), ("c", None)], "name string, ts timestamp")
    got = df.select(templates.filled_by({"a": "/a/${yyyy}", "b": "/b"}, F.col("name"), F.col("ts"))).collect()
    assert [r[0] for r in got] == ["/a/2024", "/b", None]
