"""Folding agent signals into events, spans and rounds, in batch: windows and aggregates over (session, round)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemill.functions.dates import duration_ms
from tidemill.functions.text import KEPT_LENGTH, mask_secrets, sanitize, window_tail
from tidemill.schemas import SIGNALS
from tidemill.streaming.files import new_folder

KEY = ["session_id", "round_id"]


def meaningful(signals: DataFrame) -> DataFrame:
    return signals.filter(F.col("type").isin(*SIGNALS))


def ordered_concat(df: DataFrame, keys: list[str], text: str, order: str, name: str) -> DataFrame:
    """Texts of each key joined in order; nulls add nothing."""
    pieces = F.array_sort(F.collect_list(F.when(F.col(text).isNotNull(), F.struct(order, text))))
    return df.groupBy(*keys).agg(F.array_join(F.transform(pieces, lambda p: p[text]), "").alias(name))


def terminals(signals: DataFrame) -> DataFrame:
    """(session, round, ended_seq, state, stop_reason, status): the first signal that ends a round wins.

    A normal end after the iteration limit is one for that reason. A stream that ends by DISCONNECT or INTERRUPT was
    interrupted; a round without any ending is still running.
    """
    rank = F.when(F.col("type") == "AGENT_END", "DONE").when(F.col("type").isin("INTERRUPT", "DISCONNECT"), "INTERRUPTED").when(F.col("type") == "ERROR", "ERROR")
    first = meaningful(signals).groupBy(*KEY).agg(
        F.min_by(rank, F.when(rank.isNotNull(), F.col("seq"))).alias("state"),
        F.min(F.when(rank.isNotNull(), F.col("seq"))).alias("ended_seq"),
        F.min(F.when(F.col("type") == "EXCEED_MAX_ITERS", F.col("seq"))).alias("limit_seq"),
    )
    reason = (
        F.when(F.col("state") == "INTERRUPTED", "interrupted").when(F.col("state") == "ERROR", "error").when((F.col("state") == "DONE") & (F.col("limit_seq") < F.col("ended_seq")), "max_iterations").when(F.col("state") == "DONE", "stop")
    )
    status = F.when(F.col("state") == "DONE", "COMPLETED").when(F.col("state").isNotNull(), "FAILED").otherwise("RUNNING")
    return first.select(*KEY, "state", "ended_seq", reason.alias("stop_reason"), status.alias("status"))


def active(signals: DataFrame) -> DataFrame:
    """Signals up to the one that ends their round; what comes after is not folded."""
    return meaningful(signals).join(terminals(signals), KEY).filter(F.col("ended_seq").isNull() | (F.col("seq") <= F.col("ended_seq")))


def outputs(signals: DataFrame) -> DataFrame:
    """(session, round, output): the text deltas in order, or the last result text where there are none."""
    rows = active(signals)
    text = F.array_sort(F.collect_list(F.when((F.col("type") == "TEXT_DELTA") & F.col("text").isNotNull(), F.struct("seq", "text"))))
    joined = F.array_join(F.transform(text, lambda p: p["text"]), "")
    final = F.max_by("result_text", F.when(F.col("type") == "AGENT_RESULT", F.col("seq")))
    return rows.groupBy(*KEY).agg(F.coalesce(F.when(joined != "", joined), final, F.lit("")).alias("output"))


def tool_results(signals: DataFrame, keep: int = KEPT_LENGTH) -> DataFrame:
    """Result deltas with `head`, the part of each that still falls into its call's head window, kept per tool call."""
    w = Window.partitionBy(*KEY, "tool_call_id").orderBy("seq")
    before = F.coalesce(F.sum(F.length("text")).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return active(signals).filter("type = 'TOOL_RESULT_TEXT_DELTA'").withColumn("head", F.left("text", F.greatest(F.lit(keep) - before, F.lit(0)).cast("int")))


def _block(kind: str, *fields: Column) -> Column:
    return F.struct(F.lit(kind).alias("type"), *fields)


def _payload(block: Column, last: bool) -> Column:
    return F.to_json(F.struct(F.array(block).alias("content"), F.lit(last).alias("is_last")))


def events(signals: DataFrame, keep: int = KEPT_LENGTH, base: DataFrame | None = None) -> DataFrame:
    """(session, round, event_type, payload, sequence_num): run_start, the rounds' events, the ending, session_status.

    Sequence numbers are free of gaps per session, from 1 or from its base (session_id, base) on. Tool arguments are
    gathered per call and stand under `input`; a result's tail follows its head once, in the closing event.
    """
    rows = active(signals)
    call = [*KEY, "tool_call_id"]
    tools = rows.filter(F.col("tool_call_id").isNotNull() & F.col("type").startswith("TOOL_"))
    # Lengths run along the call; texts are joined once a call, of what comes before the end of the arguments or the result.
    w = Window.partitionBy(*call)
    for kind in ("CALL", "RESULT"):
        tools = tools.withColumn(f"_{kind}_end", F.min(F.when(F.col("type") == f"TOOL_{kind}_END", F.col("seq"))).over(w))
    piece = lambda kind, delta: F.when((F.col("type") == delta) & F.col("text").isNotNull() & (F.col("seq") < F.coalesce(f"_{kind}_end", F.lit(1 << 62))), F.struct("seq", "text"))
    joined = lambda c: F.array_join(F.transform(F.array_sort(F.collect_list(c)), lambda p: p["text"]), "")
    texts = tools.groupBy(*call).agg(joined(piece("CALL", "TOOL_CALL_DELTA")).alias("_args"), joined(piece("RESULT", "TOOL_RESULT_TEXT_DELTA")).alias("_result"))
    before = F.coalesce(F.sum(F.when(F.col("type") == "TOOL_RESULT_TEXT_DELTA", F.length("text"))).over(w.orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    tools = tools.withColumn("head", F.when(F.col("type") == "TOOL_RESULT_TEXT_DELTA", F.left("text", F.greatest(F.lit(keep) - before, F.lit(0)).cast("int"))))
    ends = F.col("type").isin("TOOL_CALL_END", "TOOL_RESULT_END")
    tools = tools.filter(~ends).withColumns({"args": F.lit(None).cast("string"), "result": F.lit(None).cast("string")}).unionByName(
        tools.filter(ends).join(texts, call, "left").withColumn("args", F.when(F.col("type") == "TOOL_CALL_END", F.col("_args"))).withColumn("result", F.when(F.col("type") == "TOOL_RESULT_END", F.col("_result"))).drop("_args", "_result")
    )

    ids = [F.col("tool_call_id"), F.col("tool_name").alias("name")]
    arguments = F.when(F.schema_of_variant(F.try_parse_json("args")).startswith("OBJECT"), F.try_parse_json("args"))
    tool_events = tools.select(
        *KEY,
        "seq",
        F.when(F.col("type").startswith("TOOL_CALL_"), "TOOL_CALL").otherwise("TOOL_CALL_OUTPUT").alias("event_type"),
        F.when(F.col("type") == "TOOL_CALL_START", _payload(_block("tool_call", *ids), False))
        .when(F.col("type") == "TOOL_CALL_END", _payload(_block("tool_call", *ids, arguments.alias("input")), True))
        .when((F.col("type") == "TOOL_RESULT_TEXT_DELTA") & (F.col("head") != ""), _payload(_block("tool_result", *ids, F.col("head").alias("output"), F.lit(False).alias("truncated")), False))
        .when(
            F.col("type") == "TOOL_RESULT_END",
            _payload(_block("tool_result", *ids, F.coalesce(window_tail(F.col("result"), keep), F.lit("")).alias("output"), (F.length("result") > keep).alias("truncated")), True),
        )
        .alias("payload"),
    ).filter("payload is not null")
    kind = F.when(F.col("type").startswith("TEXT"), "MESSAGE").otherwise("THINKING")
    said = lambda name, ends: _payload(_block(name, F.lit("").alias("text") if ends else F.col("text"), F.col("block_id")), ends)
    text_events = rows.filter(F.col("type").isin("TEXT_DELTA", "TEXT_END", "THINKING_DELTA", "THINKING_END")).select(
        *KEY,
        "seq",
        kind.alias("event_type"),
        F.when(F.col("type") == "TEXT_DELTA", said("text", False)).when(F.col("type") == "TEXT_END", said("text", True)).when(F.col("type") == "THINKING_DELTA", said("thinking", False)).otherwise(said("thinking", True)).alias("payload"),
    )
    starts = rows.groupBy(*KEY).agg(F.min("seq").alias("seq")).select(*KEY, "seq", F.lit(-1).alias("part"), F.lit("RUN_START").alias("event_type"), F.to_json(F.struct(F.col("round_id"))).alias("payload"))
    # The signal that ended the round is the one that says why.
    ended = rows.filter("seq = ended_seq").dropDuplicates(KEY).withColumn("message", sanitize(F.coalesce(F.when(F.trim("text") != "", F.col("text")), F.when(F.col("state") == "INTERRUPTED", "interrupted").otherwise("the agent failed"))))
    failed = F.col("state") != "DONE"
    ending = F.when(
        failed,
        F.array(
            F.struct(F.lit("RUN_ERROR").alias("event_type"), F.to_json(F.struct("stop_reason", "message")).alias("payload")),
            F.struct(F.lit("ERROR").alias("event_type"), F.to_json(F.struct(F.lit("DEEP_AGENT_RUN_ERROR").alias("code"), F.col("message"))).alias("payload")),
            F.struct(F.lit("SESSION_STATUS").alias("event_type"), F.to_json(F.struct(F.lit("IDLE").alias("status"), F.col("stop_reason"))).alias("payload")),
        ),
    ).otherwise(
        F.array(
            F.struct(F.lit("RUN_END").alias("event_type"), F.to_json(F.struct("stop_reason")).alias("payload")),
            F.struct(F.lit("SESSION_STATUS").alias("event_type"), F.to_json(F.struct(F.lit("IDLE").alias("status"), F.col("stop_reason"))).alias("payload")),
        )
    )
    closing = ended.select(*KEY, F.col("ended_seq").alias("seq"), F.posexplode(ending).alias("part", "e")).select(*KEY, "seq", (F.col("part") + 1).alias("part"), "e.event_type", "e.payload")
    every = tool_events.unionByName(text_events).withColumn("part", F.lit(0)).unionByName(starts).unionByName(closing)
    numbered = every.withColumn("sequence_num", F.row_number().over(Window.partitionBy("session_id").orderBy("seq", "part", "round_id")).cast("long"))
    if base is not None:
        numbered = numbered.join(base, "session_id", "left").withColumn("sequence_num", F.col("sequence_num") + F.coalesce("base", F.lit(0))).drop("base")
    return numbered.select(*KEY, "event_type", "payload", "sequence_num")


def pair_spans(df: DataFrame, keys: list[str], is_start: Column, is_end: Column, order: str, at: str) -> DataFrame:
    """End rows with the time of the start that they close: the last one of their key before, if no end took it yet."""
    w = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    marks = df.filter(is_start | is_end).withColumn("_start", is_start)
    seen = F.last(F.when(F.col("_start"), F.col(at)), ignorenulls=True).over(w)
    taken = F.lag("_start").over(Window.partitionBy(*keys).orderBy(order))
    return marks.withColumn("start_time", F.when(taken, seen)).filter(~F.col("_start") & F.col("start_time").isNotNull()).drop("_start")


def spans(signals: DataFrame) -> DataFrame:
    """llm.call and tool.call spans with tokens and model; an end without a start makes none."""
    rows = active(signals)
    model = pair_spans(rows, KEY, F.col("type") == "MODEL_CALL_START", F.col("type") == "MODEL_CALL_END", "seq", "ts").select(
        *KEY, F.lit("llm.call").alias("span_name"), "start_time", F.col("ts").alias("end_time"), F.lit("OK").alias("status"), "input_tokens", "output_tokens", "model_name", F.lit(None).cast("string").alias("tool_name"), F.lit(None).cast("string").alias("tool_input"), F.lit(None).cast("string").alias("tool_output"),
    )
    call = [*KEY, "tool_call_id"]
    args = ordered_concat(rows.filter("type = 'TOOL_CALL_DELTA'"), call, "text", "seq", "tool_input")
    head = ordered_concat(tool_results(signals), call, "head", "seq", "tool_output")
    names = rows.filter("type = 'TOOL_CALL_START'").groupBy(*call).agg(F.max_by("tool_name", "seq").alias("named"))
    tool = pair_spans(rows.filter("tool_call_id is not null"), call, F.col("type") == "TOOL_CALL_START", F.col("type") == "TOOL_RESULT_END", "seq", "ts")
    tool = tool.join(args, call, "left").join(head, call, "left").join(names, call, "left")
    tool = tool.select(
        *KEY, F.lit("tool.call").alias("span_name"), "start_time", F.col("ts").alias("end_time"), F.when(F.lower("tool_state") == "error", "ERROR").otherwise("OK").alias("status"), F.lit(None).cast("int").alias("input_tokens"), F.lit(None).cast("int").alias("output_tokens"), F.lit(None).cast("string").alias("model_name"), F.coalesce("named", "tool_name").alias("tool_name"), sanitize(F.col("tool_input")).alias("tool_input"), mask_secrets(F.col("tool_output")).alias("tool_output"),
    )
    return model.unionByName(tool).withColumn("duration_ms", duration_ms(F.col("start_time"), F.col("end_time")))


def rounds(signals: DataFrame) -> DataFrame:
    """(session, round, output, status, stop_reason); a failed round has no output."""
    ended = terminals(signals).join(outputs(signals), KEY)
    return ended.select(*KEY, F.when(F.col("status") == "FAILED", "").otherwise(F.col("output")).alias("output"), "status", "stop_reason")


def span_tree(spans: DataFrame, max_depth: int = 32) -> DataFrame:
    """(span_id, parent_span_id, depth, path) from the roots down, level by level; deeper trees than max_depth are an error."""
    level = spans.filter("parent_span_id is null").select("span_id", "parent_span_id", F.lit(0).alias("depth"), F.col("span_id").cast("string").alias("path"))
    found, depth = level, 0
    while True:
        up = level.select(F.col("span_id").alias("parent_span_id"), F.col("path").alias("_path"))
        level = spans.join(up, "parent_span_id").select("span_id", "parent_span_id", F.lit(depth + 1).alias("depth"), F.concat_ws("/", "_path", F.col("span_id").cast("string")).alias("path"))
        if level.isEmpty():
            return found
        if (depth := depth + 1) > max_depth:
            raise ValueError(f"spans are nested over {max_depth} deep, or in a circle")
        found = found.unionByName(level)


def span_depths(spans: DataFrame, with_path: bool = True, few: int = 1_000_000) -> DataFrame:
    """(span_id, parent_span_id, root, depth, path, problem) of every span, however deep the trees are.

    While more than `few` spans haven't reached their root, a round takes out about a quarter of them, chosen by a hash so that
    of a span and the one above it at most one goes: those below lead past what is taken out, which waits for the span above it.
    So the rounds shrink, and all of them together shuffle a multiple of the table, whatever the depth. Of what is left each
    round doubles the steps that a span has gone up, log2(depth) rounds of one join; then the spans taken out follow, last ones
    first. problem is `cycle` for spans in or below a circle, `no parent` for those whose line ends at
    a parent that isn't there; both have no root, depth and path. Span ids are unique. Without paths, which are as long as the tree is
    deep, a row has a fixed size.
    """
    spark, text = spans.sparkSession, F.col("span_id").cast("string")

    def written(df: DataFrame) -> DataFrame:
        path = new_folder(spark, "spans")
        df.write.parquet(path)
        return spark.read.parquet(path)

    def joined(low: DataFrame, high: DataFrame, how: str = "inner") -> DataFrame:
        """low, led on from the spans of high that its lines have reached."""
        above = high.select(F.col("span_id").alias("up"), F.col("up").alias("_up"), F.col("root").alias("_root"), F.col("depth").alias("_depth"), F.col("path").alias("_path"), F.col("problem").alias("_problem"), F.lit(True).alias("_met"))
        on = lambda new, old: F.when(F.col("_met"), new).otherwise(F.col(old)).alias(old)
        return low.join(above, "up", how).select("span_id", "parent_span_id", on(F.col("_up"), "up"), on(F.col("_root"), "root"), on(F.col("depth") + F.col("_depth"), "depth"), on(F.concat("_path", F.lit("/"), "path"), "path"), on(F.col("_problem"), "problem"))

    known = spans.select(F.col("span_id").alias("up")).withColumn("_there", F.lit(True))
    start = spans.select("span_id", "parent_span_id", F.col("parent_span_id").alias("up"), F.coalesce("parent_span_id", "span_id").alias("root"), (F.col("parent_span_id").isNotNull()).cast("int").alias("depth"), (text if with_path else F.lit(None).cast("string")).alias("path"))
    start = written(start.join(known, "up", "left").withColumn("problem", F.when(F.col("up").isNotNull() & F.col("_there").isNull(), "no parent")).withColumn("up", F.when(F.col("problem").isNull(), F.col("up"))).select(*start.columns, "problem"))
    done, open_ = start.filter("up IS NULL"), start.filter("up IS NOT NULL")
    taken, n, before = [], open_.count(), None
    # Of circles the spans may all be gone but one, which leads to itself and stays; a round that takes out nothing is the last.
    while n > few and n != before:
        picked = lambda c, k=len(taken): F.pmod(F.xxhash64(F.col(c).cast("string"), F.lit(k)), F.lit(2)) == 1
        out = picked("span_id") & ~picked("up")
        taken.append(open_.filter(out))
        open_ = written(joined(open_.filter(~out), taken[-1], "left"))
        n, before = open_.count(), n
    while True:
        # What a span's line so far ends at: done, with its own root, or open, and so twice as far up.
        stepped = written(joined(open_, done.unionByName(open_)))
        ended = stepped.filter("up IS NULL")
        if ended.isEmpty():
            # Of lines that end some would have ended now, so all that are left go round.
            found = done.unionByName(open_.withColumn("problem", F.lit("cycle")))
            break
        done, open_ = done.unionByName(ended), stepped.filter("up IS NOT NULL")
    for gone in reversed(taken):
        found = found.unionByName(written(joined(gone, found)))
    known_depth = lambda c: F.when(F.col("problem").isNull(), F.col(c)).alias(c)
    return found.select("span_id", "parent_span_id", known_depth("root"), known_depth("depth"), known_depth("path"), "problem")


#: (state, next state) that a session may take.
TRANSITIONS = (("IDLE", "RUNNING"), ("RUNNING", "DONE"), ("RUNNING", "INTERRUPTED"), ("RUNNING", "ERROR"), ("DONE", "IDLE"), ("INTERRUPTED", "IDLE"), ("ERROR", "IDLE"))


def illegal_transitions(states: DataFrame, keys: list[str], order: str, state: str, allowed: tuple = TRANSITIONS) -> DataFrame:
    """Rows whose state may not follow the one before (previous_state)."""
    df = states.withColumn("previous_state", F.lag(state).over(Window.partitionBy(*keys).orderBy(order))).filter("previous_state is not null")
    table = states.sparkSession.createDataFrame(list(allowed), "previous_state string, _next string")
    return df.join(F.broadcast(table), (df["previous_state"] == table["previous_state"]) & (df[state] == table["_next"]), "left_anti")


def overlapping_rounds(rounds: DataFrame, key: str, start: str, end: str) -> DataFrame:
    """Rounds that start before all earlier ones of their session ended: more than one was active."""
    w = Window.partitionBy(key).orderBy(start, end).rowsBetween(Window.unboundedPreceding, -1)
    return rounds.withColumn("_until", F.max(F.coalesce(end, F.lit("9999-12-31").cast("timestamp"))).over(w)).filter(F.col(start) < F.col("_until")).drop("_until")


def recover(sessions: DataFrame, rounds: DataFrame) -> tuple[DataFrame, DataFrame]:
    """After a restart: running sessions are idle, and their running rounds were interrupted."""
    running = sessions.filter("status = 'RUNNING'").select("session_id").distinct().withColumn("_hit", F.lit(True))
    idle = sessions.withColumn("status", F.when(F.col("status") == "RUNNING", "IDLE").otherwise(F.col("status")))
    marked = rounds.join(running, "session_id", "left")
    stopped = F.coalesce("_hit", F.lit(False)) & (F.col("status") == "RUNNING")
    return idle, marked.withColumn("status", F.when(stopped, "INTERRUPTED").otherwise(F.col("status"))).select(*rounds.columns)
