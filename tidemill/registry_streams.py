"""Named queries that run as streams over batches of the given tables, and the SQL over the whole tables that must give the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemill.plans import envelope
from tidemill.plans import rounds as batch_rounds
from tidemill.registry import _SIGNAL_SQL, ORACLES, _signals, query
from tidemill.registry_commands import _tool_signals
from tidemill.streaming import files, rounds, sinks


def _folded(spark: SparkSession, signals: DataFrame, keep: int = 16_384) -> DataFrame:
    """What the stateful fold gives of signals that arrive in three batches."""
    rounds.configure(spark)
    path = files.new_folder(spark, "folded")
    files.run_through(rounds.fold(batch_rounds.meaningful(files.as_stream(signals, "seq")), keep), sinks.append_events(path), "fold")
    return spark.read.schema(rounds.FOLDED).parquet(path)


@query(ORACLES["round_fold"])
def streamed_round_fold(t, spark: SparkSession) -> DataFrame:
    return rounds.events(_folded(spark, _signals(t)))


@query(ORACLES["round_output"].replace("SELECT session_id, CASE", "SELECT session_id, any_value(t) AS t, CASE").join(["SELECT session_id, output FROM (", ") WHERE t IS NOT NULL"]))
def streamed_round_output(t, spark) -> DataFrame:
    return rounds.rounds(_folded(spark, _signals(t))).select("session_id", "output")


@query(ORACLES["tool_payloads"])
def streamed_tool_payloads(t, spark) -> DataFrame:
    made = rounds.events(_folded(spark, _tool_signals(t), 400)).filter("event_type = 'TOOL_CALL_OUTPUT'")
    block = lambda name: F.get_json_object("payload", f"$.content[0].{name}")
    last = F.get_json_object("payload", "$.is_last") == "true"
    return made.groupBy("session_id").agg(F.count(F.when(~last, 1)).alias("heads"), F.max(F.when(last, block("output"))).alias("closing"), F.max(F.when(last, block("truncated") == "true")).alias("truncated"))


def _call_signals(t) -> DataFrame:
    """Events as model calls: clicks begin one, purchases end it, and errors end the session's round."""
    kinds = F.create_map(*(F.lit(x) for pair in {"click": "MODEL_CALL_START", "purchase": "MODEL_CALL_END", "error": "ERROR"}.items() for x in pair))
    tokens = F.when(F.col("event_type") == "purchase", F.col("event_id") % 1000).cast("int")
    return _signals(t).join(t("events").select(F.col("event_id").alias("seq"), kinds[F.col("event_type")].alias("kind"), tokens.alias("tokens")), "seq").withColumns({"type": F.coalesce("kind", F.lit("START")), "input_tokens": F.col("tokens"), "output_tokens": F.col("tokens") * 2, "model_name": F.when(F.col("tokens").isNotNull(), "m")}).drop("kind", "tokens")


_SPANS_SQL = """WITH e AS (SELECT user_id, min(event_id) FILTER (event_type = 'error') AS ended FROM events GROUP BY 1),
m AS (SELECT user_id, event_id, ts, event_type, lag(event_type) OVER w AS before, lag(ts) OVER w AS started FROM events JOIN e USING (user_id) WHERE event_type IN ('click', 'purchase') AND (ended IS NULL OR event_id <= ended) WINDOW w AS (PARTITION BY user_id ORDER BY event_id))
SELECT user_id::VARCHAR AS session_id, 'llm.call' AS span_name, 'OK' AS status, (event_id % 1000)::INTEGER AS input_tokens, (event_id % 1000 * 2)::INTEGER AS output_tokens, 'm' AS model_name, greatest((epoch_us(ts) - epoch_us(started)) // 1000, 0) AS duration_ms
FROM m WHERE event_type = 'purchase' AND before = 'click'"""
_SPAN_COLUMNS = ["session_id", "span_name", "status", "input_tokens", "output_tokens", "model_name", "duration_ms"]


@query(_SPANS_SQL)
def round_spans(t, spark) -> DataFrame:
    return batch_rounds.spans(_call_signals(t)).select(*_SPAN_COLUMNS)


@query(_SPANS_SQL)
def streamed_round_spans(t, spark) -> DataFrame:
    return rounds.spans(_folded(spark, _call_signals(t))).select(*_SPAN_COLUMNS)


@query("SELECT user_id, event_id, event_type, props FROM events WHERE event_id > 100")
def replay_and_follow(t, spark) -> DataFrame:
    """The log holds the first part of the events; the stream repeats its end, goes on, and delivers some of its events twice."""
    every = t("events").withColumn("ts", F.col("ts").cast("timestamp"))
    middle = every.agg(F.max("event_id")).first()[0] // 2
    arrivals = every.filter(F.col("event_id") > middle - 1000)
    live = files.as_stream(arrivals.unionByName(arrivals.filter("user_id % 3 = 0")), "event_id")
    path = files.new_folder(spark, "followed")
    write = sinks.append_events(path)
    names = {"session": "user_id", "order": "event_id", "time": "ts", "delay": "1 hour"}
    files.run_through(sinks.replay_then_follow(every.filter(F.col("event_id") <= middle), live, 100, write, **names), write, "follow")
    return spark.read.parquet(path).select("user_id", "event_id", "event_type", "props")


@query("SELECT o_custkey, max(o_orderkey) AS o_orderkey, arg_max(o_orderstatus, o_orderkey) AS o_orderstatus, arg_max(o_orderpriority, o_orderkey) AS o_orderpriority FROM orders GROUP BY 1")
def upserted_orders(t, spark) -> DataFrame:
    """Each customer's last order, as a stream of orders leaves it; the batches are folded into a base, and one runs again."""
    orders = t("orders").select("o_custkey", "o_orderkey", "o_orderstatus", "o_orderpriority")
    log = sinks.UpsertLog(files.new_folder(spark, "upserts"), ["o_custkey"], ["o_orderkey"])
    files.run_through(files.as_stream(orders, "o_orderkey"), log.write, "upserts")
    log.compact(spark)
    log.write(orders, 1)  # the base holds this batch, so it has no effect
    return log.current(spark)


@query(f"""WITH s AS (SELECT user_id::VARCHAR AS session_id, event_id AS seq, {_SIGNAL_SQL} AS type, props FROM events),
e AS (SELECT session_id, min(seq) FILTER (type IN ('AGENT_END', 'ERROR')) AS ended, arg_min(type, seq) FILTER (type IN ('AGENT_END', 'ERROR')) AS t, arg_min(props, seq) FILTER (type IN ('AGENT_END', 'ERROR')) AS message FROM s GROUP BY 1)
SELECT session_id, coalesce(string_agg(props, '' ORDER BY seq) FILTER (type = 'TEXT_DELTA' AND (ended IS NULL OR seq <= ended)), '') AS text, any_value(CASE WHEN t = 'ERROR' THEN message END) AS error, any_value(CASE WHEN t IS NOT NULL THEN 'IDLE' END) AS status
FROM s JOIN e USING (session_id) GROUP BY 1""")
def client_rounds(t, spark) -> DataFrame:
    """What a client shows of each round: its text, its error and the session's status, from the events' payloads."""
    shown = envelope.messages(batch_rounds.events(_signals(t)))
    return shown.select("session_id", "text", F.try_element_at("errors", F.lit(1)).alias("error"), "status")


@query("""WITH c AS (SELECT conv_id, turn, text, coalesce(sum(length(text)) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before FROM conversations)
SELECT conv_id::VARCHAR AS session_id, 2 AS calls, (count(*) FILTER (left(text, greatest(400 - before, 0)) <> '') + 1)::INTEGER AS results, 'search' AS name, 'IDLE' AS status FROM c GROUP BY conv_id""")
def client_tools(t, spark) -> DataFrame:
    """The tool calls and results of each round as a client lists them, in the order of their events."""
    shown = envelope.messages(batch_rounds.events(_tool_signals(t), 400))
    kind = lambda name: F.size(F.filter("tools", lambda x: x["kind"] == name))
    return shown.select("session_id", kind("tool_call").alias("calls"), kind("tool_call_output").alias("results"), F.array_join(F.array_distinct(F.transform("tools", lambda x: x["name"])), ",").alias("name"), "status")
