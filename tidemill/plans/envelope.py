"""Outward forms of events: envelopes, server-sent events, and the message that a client folds them to."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemill.functions.dates import iso_offset
from tidemill.functions.jsons import lenient_object


def role(event_type: Column) -> Column:
    return F.when(event_type.isin("TOOL_CALL", "TOOL_CALL_OUTPUT"), "tool").otherwise("assistant")


def envelopes(events: DataFrame) -> DataFrame:
    """(object, id, created_at, role, type, content, metadata, status, sequence_number) of chat events.

    Blocks of a payload are taken as they are, with is_last among the metadata; a flat payload becomes one data block, in
    which the status of a session is named session_status. Malformed payloads count as empty.
    """
    body = lenient_object(F.col("payload"))
    blocks = F.get_json_object(body, "$.content")
    has_blocks = blocks.startswith("[")
    last = F.get_json_object(body, "$.is_last")
    renamed = F.to_json(F.struct(F.coalesce(F.get_json_object(body, "$.status"), F.lit("")).alias("session_status"), F.get_json_object(body, "$.stop_reason").alias("stop_reason")))
    data = F.when(F.col("event_type") == "SESSION_STATUS", renamed).otherwise(body)
    plain = F.create_map(F.lit("session_id"), F.col("session_id"), F.lit("round_id"), F.col("round_id"))
    metadata = F.when(has_blocks & last.isin("true", "false"), F.map_concat(plain, F.create_map(F.lit("is_last"), last))).otherwise(plain)
    return events.select(
        F.lit("message").alias("object"),
        F.col("event_id").alias("id"),
        "created_at",
        role(F.col("event_type")).alias("role"),
        F.lower("event_type").alias("type"),
        F.when(has_blocks, blocks).otherwise(F.concat(F.lit('[{"type":"data","data":'), data, F.lit("}]"))).alias("content"),
        metadata.alias("metadata"),
        F.lit("completed").alias("status"),
        F.col("sequence_num").alias("sequence_number"),
    )


def server_sent(envelopes: DataFrame) -> DataFrame:
    """(sequence_number, frame): id, event and data lines, and the blank line that ends a frame."""
    metadata = F.to_json("metadata")
    # The content is JSON already and goes in as it is; metadata booleans lose their quotes.
    metadata = F.regexp_replace(metadata, r'"is_last":"(true|false)"', '"is_last":$1')
    head = F.to_json(F.struct("object", "id", iso_offset(F.col("created_at")).alias("created_at"), "role", "type"))
    data = F.concat(F.substring(head, F.lit(1), F.length(head) - 1), F.lit(',"content":'), F.col("content"), F.lit(',"metadata":'), metadata, F.lit(',"status":"'), F.col("status"), F.lit('","sequence_number":'), F.col("sequence_number").cast("string"), F.lit("}"))
    return envelopes.select("sequence_number", F.concat(F.lit("id: "), F.col("sequence_number").cast("string"), F.lit("\nevent: message\ndata: "), data, F.lit("\n\n")).alias("frame"))


def parsed_frames(frames: DataFrame, column: str = "frame") -> DataFrame:
    """(event, data) of server-sent frames: data lines joined, `message` unless named; frames without data give no row."""
    lines = F.split(column, r"\r?\n")
    values = lambda name: F.transform(F.filter(lines, lambda x: x.startswith(name + ":")), lambda x: F.regexp_replace(x, rf"^{name}: ?", ""))
    named, data = F.trim(F.element_at(F.when(F.size(values("event")) > 0, values("event")), -1)), F.array_join(values("data"), "")
    return frames.select(F.coalesce(named, F.lit("message")).alias("event"), F.when(F.size(values("data")) > 0, data).alias("data")).filter("data is not null")


def messages(events: DataFrame) -> DataFrame:
    """(session, round, thinking, text, tools, errors, status) of each round, as a client shows them."""
    block = lambda name: F.get_json_object("payload", f"$.content[0].{name}")
    joined = lambda kind: F.array_join(F.transform(F.array_sort(F.collect_list(F.when((F.col("event_type") == kind) & block("text").isNotNull(), F.struct("sequence_num", block("text").alias("t"))))), lambda x: x["t"]), "")
    tool = F.when(F.col("event_type").isin("TOOL_CALL", "TOOL_CALL_OUTPUT"), F.struct("sequence_num", F.lower("event_type").alias("kind"), block("name").alias("name"), block("tool_call_id").alias("tool_call_id")))
    error = F.when(F.col("event_type") == "ERROR", F.get_json_object("payload", "$.message"))
    status = F.max_by(F.get_json_object("payload", "$.status"), F.when(F.col("event_type") == "SESSION_STATUS", F.col("sequence_num")))
    return events.groupBy("session_id", "round_id").agg(joined("THINKING").alias("thinking"), joined("MESSAGE").alias("text"), F.array_sort(F.collect_list(tool)).alias("tools"), F.collect_list(error).alias("errors"), status.alias("status"))
