"""Named queries over the column forms of templates, JSON paths and fields."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemill.functions import jsons, paths, templates
from tidemill.registry import query


def _instant(ts):
    """The given times, which have no zone, as instants of UTC."""
    return F.convert_timezone(F.lit("UTC"), F.current_timezone(), ts).cast("timestamp")


_LOCAL = "(ts + INTERVAL 8 HOUR)"
_WEEK = "CASE WHEN dayofyear({t}) - 1 + 6 - dayofweek({t}) >= dayofyear(make_date(year({t}), 12, 31)) THEN 1 ELSE (dayofyear({t}) - 1 + ((dayofweek({t}) - dayofyear({t}) + 1) % 7 + 7) % 7) // 7 + 1 END"


@query(f"""SELECT event_id, CASE event_type
WHEN 'view' THEN '/u/' || user_id || '/' || strftime({_LOCAL}, '%Y-%m-%d') || '?from=' || strftime({_LOCAL} - INTERVAL 3 DAY, '%Y-%m-%d') || '&none='
WHEN 'click' THEN 'w' || {_WEEK.format(t=_LOCAL)} || '/' || dayofweek({_LOCAL}) + 1 || ' ' || strftime({_LOCAL}, '%a, %d %b %Y %H.%M.%S') || ' +0800'
WHEN 'error' THEN '[' || (epoch_us(ts) // 1000) || '] ' || strftime({_LOCAL} + INTERVAL 2 MONTH, '%Y%m') || ' ${{cc}} Q' || quarter({_LOCAL}) || ' ' || strftime({_LOCAL} - INTERVAL 90 MINUTE, '%H:%M') || ' GMT+8' END AS filled FROM events""")
def filled_templates(t, spark: SparkSession) -> DataFrame:
    """A template by the kind of event, filled in from each row's context and time."""
    made = {
        "view": "/u/${user}/${yyyy-MM-dd}?from=${today-3}&none=${gone}",
        "click": "w${w}/${e} ${EEE, dd MMM yyyy HH.mm.ss Z}",
        "error": "[${timestamp}] ${yyyyMM:+2M} ${cc} ${QQQ} ${HH:-90m}:${mm:-90m} ${O}",
    }

    context = F.map_from_arrays(F.array(F.lit("user"), F.lit("gone")), F.array(F.col("user_id").cast("string"), F.lit(None).cast("string")))
    return t("events").select("event_id", templates.filled_by(made, F.col("event_type"), _instant(F.col("ts")), context).alias("filled"))


def _bodies(t) -> DataFrame:
    """Nested JSON of the turns: a head with a role and a number, words with their lengths, and a part that some turns lack."""
    words = F.transform(F.filter(F.split("text", " "), lambda w: w != ""), lambda w: F.struct(w.alias("w"), F.length(w).alias("n")))
    body = F.struct(F.struct("role", (F.col("turn") * 2).alias("n")).alias("head"), words.alias("words"), F.when(F.col("turn") % 2 == 0, F.struct(F.lit("even").alias("n"))).alias("extra"))
    return t("conversations").select("conv_id", "turn", F.to_json(body).alias("body"))


_WORDS_SQL = "SELECT conv_id, turn, role, list_filter(string_split(text, ' '), lambda w: w <> '') AS ws FROM conversations"


@query(f"""WITH b AS ({_WORDS_SQL})
SELECT conv_id, turn, array_to_string(list_filter(ws, lambda w: length(w) > 8 OR (length(w) < 3 AND w <> 'of')), ' ') AS picked, ws[1] AS opening, ws[-1] AS closing, array_to_string(ws[2:4], ' ') AS few,
len(ws) + 1 + CASE WHEN turn % 2 = 0 THEN 1 ELSE 0 END AS numbers, role AS who FROM b""")
def path_columns(t, spark) -> DataFrame:
    """Filters with brackets, places from the end, slices and .. over nested bodies."""
    df = _bodies(t).withColumn("v", F.parse_json("body"))
    v = F.col("v")
    text = lambda path: F.array_join(F.transform(paths.path_values(v, path), lambda x: F.try_variant_get(x, "$", "string")), " ")
    return df.select(
        "conv_id", "turn", text("$.words[?(@.n > 8 || (@.n < 3 && @.w != 'of'))].w").alias("picked"), paths.path_value(v, "$.words[0].w", "string").alias("opening"), paths.path_value(v, "$.words[-1].w", "string").alias("closing"),
        text("$.words[1:4].w").alias("few"), F.size(paths.path_values(v, "$..n", depth=4)).cast("long").alias("numbers"), paths.path_value(v, "$.head.role", "string").alias("who"),
    )


@query("SELECT event_id, (props->>'$.k')::INTEGER AS k, (props->>'$.k')::INTEGER > 50 AS high FROM events")
def props_paths(t, spark) -> DataFrame:
    v = F.parse_json("props")
    return t("events").select("event_id", paths.path_value(v, "$.k", "int").alias("k"), (F.size(paths.path_values(F.parse_json(F.concat(F.lit("["), F.col("props"), F.lit("]"))), "$[?(@.k > 50)]")) > 0).alias("high"))


@query("""WITH e AS (SELECT count(*) AS n, count(*) FILTER (event_type = 'view') AS views, count(*) FILTER (user_id % 3 = 0) AS listed, count(*) FILTER (event_type = 'error') AS broken FROM events)
SELECT json_path, parent, depth, name, type, n FROM (
SELECT '$.k' AS json_path, NULL AS parent, 1 AS depth, 'k' AS name, 'number' AS type, n - broken AS n FROM e
UNION ALL SELECT '$.who', NULL, 1, 'who', 'object', n - broken FROM e UNION ALL SELECT '$.who.user', '$.who', 2, 'user', 'string', n - broken FROM e
UNION ALL SELECT '$.seen', NULL, 1, 'seen', 'array', n - broken FROM e
UNION ALL SELECT '$.seen.*.at', '$.seen', 2, 'at', 'number', count(*) FROM events WHERE user_id % 3 = 0 AND event_type <> 'error'
UNION ALL SELECT '', NULL, 0, '', 'none', broken FROM e) WHERE n > 0""")
def field_profiles(t, spark) -> DataFrame:
    """The field tree of bodies around all events' props; errors have bodies that are cut off."""
    seen = F.when(F.col("user_id") % 3 == 0, F.array(F.struct(F.col("event_id").alias("at")), F.struct(F.lit(0).cast("long").alias("at")))).otherwise(F.array().cast("array<struct<at:bigint>>"))
    body = F.to_json(F.struct(F.get_json_object("props", "$.k").cast("int").alias("k"), F.struct(F.col("user_id").cast("string").alias("user")).alias("who"), seen.alias("seen")))
    cut = F.when(F.col("event_type") == "error", F.expr("left(body, 9)")).otherwise(F.col("body"))
    return jsons.field_profile(t("events").withColumn("body", body).withColumn("body", cut), "body").drop("types")
