"""The round fold on streams: a state for each session, fed in the order of the source's sequence."""

from __future__ import annotations

import json
from collections import namedtuple
from collections.abc import Iterator
from itertools import chain
from operator import attrgetter
from typing import Any
from zlib import crc32

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tidemill.functions.dates import duration_ms
from tidemill.functions.text import KEPT_LENGTH, mask_secrets, sanitize

#: What the fold gives: events (`record` is event), spans and finished rounds, in one table.
FOLDED = (
    "session_id string, round_id string, record string, kind string, sequence_num long, block_id string, tool_call_id string, tool_name string, text string, tool_input string, "
    "truncated boolean, state string, stop_reason string, start_micros long, end_micros long, input_tokens int, output_tokens int, model_name string"
)
_ENDS = {"AGENT_END": "DONE", "INTERRUPT": "INTERRUPTED", "DISCONNECT": "INTERRUPTED", "ERROR": "ERROR"}
_FIELDS = ["round_id", "seq", "type", "text", "block_id", "tool_call_id", "tool_name", "tool_state", "result_text", "input_tokens", "output_tokens", "model_name", "micros"]
_Signal = namedtuple("_Signal", _FIELDS)
#: Keys of the fold's state, and the parts in which each holds its sessions. A stream keeps its checkpoint only with the same numbers.
BUCKETS, PAGES = 1024, 8
_SAID = ("TEXT_DELTA", "TEXT_END", "THINKING_DELTA", "THINKING_END")


class _Texts:
    """Texts that grow, each [pieces, rest]. The rest lies with its round; a long one becomes a piece of its own, so that a batch writes
    what it adds, whatever the text's length is.
    """

    def __init__(self, state) -> None:
        self.state, self.added = state, {}

    def add(self, key: str, text: str) -> None:
        self.added.setdefault(key, []).append(text)

    def read(self, key: str, of: list) -> str:
        return "".join(self.state.getValue((f"{key}/{k}",))[0] for k in range(of[0])) + of[1] + "".join(self.added.get(key, ()))

    def drop(self, key: str, of: list) -> None:
        self.added.pop(key, None)
        for k in range(of[0]):
            self.state.removeKey((f"{key}/{k}",))

    def settle(self, key: str, of: list, most: int) -> None:
        of[1] += "".join(self.added.pop(key, ()))
        if len(of[1]) > most:
            self.state.updateValue((f"{key}/{of[0]}",), (of[1],))
            of[:] = [of[0] + 1, ""]


class _Page:
    """The texts of many sessions, which lie in one. Where that gets too long, the longest go to rows of their own and stay there."""

    def __init__(self, of: RoundFold, number: int, held: tuple[str] | None) -> None:
        self.of, self.number = of, number
        self.beyond, entries = json.loads(held[0]) if held is not None else (0, [])
        self.texts = dict(entries)
        self.own: set[str | None] = set()
        self.changed = False

    def get(self, session: str | None) -> str | None:
        if session in self.texts or not self.beyond:
            return self.texts.get(session)
        held = self.of.sessions.getValue((session,))
        if held is not None:
            self.own.add(session)
        return held[0] if held is not None else None

    def put(self, session: str | None, text: str) -> None:
        if session in self.own:
            self.of.sessions.updateValue((session,), (text,))
        else:
            self.texts[session], self.changed = text, True

    def write(self) -> None:
        if not self.changed:
            return
        text = self._text()
        if len(text) > self.of.in_hand:
            room = self.of.in_hand // 2
            for session in sorted(self.texts, key=lambda k: len(self.texts[k])):
                room -= len(self.texts[session]) + len(session or "")
                if room < 0:
                    self.of.sessions.updateValue((session,), (self.texts.pop(session),))
                    self.beyond += 1
            text = self._text()
        self.of.pages.updateValue((self.number,), (text,))

    def _text(self) -> str:
        return json.dumps([self.beyond, list(self.texts.items())], ensure_ascii=False, separators=(",", ":"))


def _page(session: str | None) -> int:
    return crc32((session or "").encode()) % PAGES


# Places in the entries of rounds, and in those of their open calls.
_TOUCHED, _LIMITED, _STATE, _ENDED, _MODEL, _OUTPUT, _FINAL, _CALLS = range(8)
_ARGS, _HEAD, _TOTAL, _TAIL, _STARTED, _NAME, _CLOSED = range(7)


class RoundFold(StatefulProcessor):
    """Of a session: its sequence counter; of each open round: limit, output and open calls; of each open call: arguments,
    head and tail of the result, start and name.

    There are many small sessions, and each key, and each call to the state store, costs more than the signals do. So the key is a
    bucket of sessions, all of a session is one text, and sessions share a page, which a batch reads once and writes once if it
    changed. What is over `in_hand` characters lies apart: of a page the longest sessions, of a session the rounds that changed
    longest ago one by one, long texts as pieces.

    A round that ends gives back all it held but for a mark by which later signals of it are known. The mark goes with the session's
    next batch after kept_ms, unless that brings a signal of the round. What hasn't changed for idle_ms expires, so that rounds that
    never end don't stay either: a timer looks through a bucket, for this at most eight times in idle_ms.
    """

    def __init__(self, keep: int = KEPT_LENGTH, kept_ms: int = 600_000, idle_ms: int = 7 * 86_400_000, in_hand: int = 65_536) -> None:
        self.keep, self.kept_ms, self.idle_ms, self.in_hand = keep, kept_ms, idle_ms, in_hand

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.due = handle.getValueState("due", "value long")
        self.pages = handle.getMapState("pages", "number int", "value string")
        self.sessions = handle.getMapState("sessions", "session_id string", "value string")
        self.apart = handle.getMapState("apart", "session_id string, round_id string", "value string")
        self.texts = handle.getMapState("texts", "piece string", "text string")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        """Of a row the last field is a text with a signal on each line, and the field before the session of those that don't name theirs."""
        now, sessions, pages = timerValues.getCurrentProcessingTimeInMs(), {}, {}
        for row in rows:
            unnamed = row[-2]
            for x in json.loads("[" + row[-1].replace("\n", ",") + "]"):
                sessions.setdefault(x.get("session_id", unnamed), []).append(_Signal(*map(x.get, _FIELDS)))
        out, wake = [], None
        while sessions:
            session, signals = sessions.popitem()
            number = _page(session)
            if number not in pages:
                pages[number] = _Page(self, number, self.pages.getValue((number,)))
            fold = _Fold(self, session, now, pages[number], pages[number].get(session))
            for r in sorted(signals, key=attrgetter("seq")):
                fold.signal(r)
            fold.write()
            out += fold.out
            wake = min((x for x in (wake, fold.wake) if x is not None), default=None)
            for _ in range(len(out) // 1000):
                yield Row(told=json.dumps(out[:1000], ensure_ascii=False))
                del out[:1000]
        for page in pages.values():
            page.write()
        if out:
            yield Row(told=json.dumps(out, ensure_ascii=False))
        if wake is not None:
            held = self.due.get()
            if held is None or wake < held[0]:
                self._set(wake)

    def _set(self, when: int) -> None:
        self.due.update((when,))
        self.handle.registerTimer(when)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        """Drops what has passed; the timer is set again where something is left."""
        now, folds, ends, gone, apart = timerValues.getCurrentProcessingTimeInMs(), {}, [], [], False
        pages = {number: _Page(self, number, value) for (number,), value in self.pages.iterator()}
        for session, text in chain(*(page.texts.items() for page in pages.values()), ((x, value[0]) for (x,), value in self.sessions.iterator())):
            fold = _Fold(self, session, now, pages[_page(session)], text)
            if session not in fold.page.texts:
                fold.page.own.add(session)
            if fold.apart or any(map(fold.passed, fold.rounds.values())):
                folds[session] = fold
            ends += [of[_TOUCHED] + self.idle_ms for of in fold.rounds.values() if not fold.passed(of)]
        for (session, round_id), (text,) in self.apart.iterator() if any(fold.apart for fold in folds.values()) else ():
            of = json.loads(text)
            if folds[session].passed(of):
                gone.append((session, round_id, of))
            else:
                ends.append(folds[session].ends(of))
                apart = True
        for session, round_id, of in gone:
            folds[session].empty(round_id, of)
            self.apart.removeKey((session, round_id))
            folds[session].apart, folds[session].changed = folds[session].apart - 1, True
        for x in (*folds.values(), *pages.values()):
            x.write()
        held = self.due.get()
        if held is not None and held[0] <= now:
            if ends:
                self._set(max(min(ends), now + max(1, min(self.kept_ms, self.idle_ms // 8) if apart else self.idle_ms // 8)))
            else:
                self.due.clear()
        return iter(())

    def close(self) -> None:
        pass


class _Fold:
    """One batch of a session's signals."""

    def __init__(self, of: RoundFold, session: str | None, now: int, page: _Page, text: str | None) -> None:
        self.of, self.session, self.now, self.page = of, session, now, page
        self.number, self.apart, entries = json.loads(text) if text is not None else (0, 0, [])
        self.rounds = dict(entries)
        self.texts = _Texts(of.texts)
        self.used: set[str | None] = set()
        self.changed, self.wake = False, None
        self.out: list[dict] = []

    def round(self, round_id: str | None) -> list:
        self.used.add(round_id)
        if round_id not in self.rounds and self.apart:
            held = self.of.apart.getValue((self.session, round_id))
            if held is not None:
                self.rounds[round_id] = json.loads(held[0])
                self.of.apart.removeKey((self.session, round_id))
                self.apart, self.changed = self.apart - 1, True
        if round_id in self.rounds and self.idle(self.rounds[round_id]):
            self.empty(round_id, self.rounds.pop(round_id))
        if round_id not in self.rounds:
            self.rounds[round_id] = [self.now, False, None, None, None, [0, ""], None, {}]
        return self.rounds[round_id]

    def idle(self, of: list) -> bool:
        return of[_TOUCHED] + self.of.idle_ms <= self.now

    def passed(self, of: list) -> bool:
        return self.idle(of) or of[_ENDED] is not None and of[_ENDED] + self.of.kept_ms <= self.now

    def held(self, round_id: str | None, of: list) -> Iterator[tuple[str, list]]:
        """The texts of a round with their names."""
        yield json.dumps([self.session, round_id, "output"]), of[_OUTPUT]
        for call, c in of[_CALLS].items():
            for place in (_ARGS, _HEAD, _TAIL):
                yield json.dumps([self.session, round_id, call, place]), c[place]

    def empty(self, round_id: str | None, of: list) -> None:
        for name, text in self.held(round_id, of):
            self.texts.drop(name, text)

    def put(self, round_id: str, record: str, kind: str, **more: Any) -> None:
        if record == "event":
            self.number += 1
            more["sequence_num"] = self.number
        self.out.append({"session_id": self.session, "round_id": round_id, "record": record, "kind": kind} | more)

    def signal(self, r) -> None:
        round_id, kind = r.round_id, r.type
        of = self.round(round_id)
        if of[_STATE] is None:
            of[_STATE] = "RUNNING"
            self.put(round_id, "event", "RUN_START")
        if of[_STATE] != "RUNNING":
            return
        of[_TOUCHED], self.changed = self.now, True
        if kind in _SAID:
            self.put(round_id, "event", kind, text=r.text, block_id=r.block_id)
            if kind == "TEXT_DELTA" and r.text:
                self.texts.add(json.dumps([self.session, round_id, "output"]), r.text)
        elif kind.startswith("TOOL_") and r.tool_call_id is not None:
            self.tool(of, r)
        elif kind == "AGENT_RESULT":
            of[_FINAL] = r.result_text
        elif kind == "EXCEED_MAX_ITERS":
            of[_LIMITED] = True
        elif kind == "MODEL_CALL_START":
            of[_MODEL] = r.micros
        elif kind == "MODEL_CALL_END" and of[_MODEL] is not None:
            self.put(round_id, "span", "llm.call", start_micros=of[_MODEL], end_micros=r.micros, state="OK", input_tokens=r.input_tokens, output_tokens=r.output_tokens, model_name=r.model_name)
            of[_MODEL] = None
        elif kind in _ENDS:
            self.end(of, r)

    def tool(self, of: list, r) -> None:
        kind, text = r.type, r.text or ""
        args, head_name, tail_name = (json.dumps([self.session, r.round_id, r.tool_call_id, place]) for place in (_ARGS, _HEAD, _TAIL))
        c = of[_CALLS].setdefault(r.tool_call_id, [[0, ""], [0, ""], 0, [0, ""], None, None, False])
        told = {"tool_call_id": r.tool_call_id, "tool_name": r.tool_name}
        if kind == "TOOL_CALL_START":
            c[_STARTED], c[_NAME] = r.micros, r.tool_name if r.tool_name is not None else c[_NAME]
            self.put(r.round_id, "event", kind, **told)
        elif kind == "TOOL_CALL_DELTA":
            if text and not c[_CLOSED]:
                self.texts.add(args, text)
        elif kind == "TOOL_CALL_END":
            c[_CLOSED] = True
            self.put(r.round_id, "event", kind, tool_input=self.texts.read(args, c[_ARGS]), **told)
        elif kind == "TOOL_RESULT_TEXT_DELTA":
            head = text[: max(0, self.of.keep - c[_TOTAL])]
            c[_TOTAL] += len(text)
            tail = (self.texts.read(tail_name, c[_TAIL]) + text[len(head) :])[-self.of.keep :]
            self.texts.drop(tail_name, c[_TAIL])
            c[_TAIL] = [0, tail]
            if head:
                self.texts.add(head_name, head)
                self.put(r.round_id, "event", kind, text=head, truncated=False, **told)
        elif kind == "TOOL_RESULT_END":
            total, tail = c[_TOTAL], self.texts.read(tail_name, c[_TAIL])
            shown = f"\n...[中间省略 {total - self.of.keep - len(tail)} 字符]...\n{tail}\n...[输出已截断，共 {total} 字符，仅保留首尾各 {self.of.keep} 字符]...\n" if total > self.of.keep else ""
            self.put(r.round_id, "event", kind, text=shown, truncated=total > self.of.keep, **told)
            if c[_STARTED] is not None:
                asked, got = (self.texts.read(name, c[k]) or None for name, k in ((args, _ARGS), (head_name, _HEAD)))
                state = "ERROR" if (r.tool_state or "").lower() == "error" else "OK"
                named = c[_NAME] if c[_NAME] is not None else r.tool_name
                self.put(r.round_id, "span", "tool.call", start_micros=c[_STARTED], end_micros=r.micros, state=state, tool_call_id=r.tool_call_id, tool_name=named, tool_input=asked, text=got)
            for name, place in ((args, _ARGS), (head_name, _HEAD), (tail_name, _TAIL)):
                self.texts.drop(name, c[place])
            del of[_CALLS][r.tool_call_id]

    def end(self, of: list, r) -> None:
        of[_STATE], of[_ENDED] = _ENDS[r.type], self.now
        reason = {"DONE": "max_iterations" if of[_LIMITED] else "stop", "INTERRUPTED": "interrupted", "ERROR": "error"}[of[_STATE]]
        told = {"text": r.text, "state": of[_STATE], "stop_reason": reason}
        for kind in ("RUN_END", "SESSION_STATUS") if of[_STATE] == "DONE" else ("RUN_ERROR", "ERROR", "SESSION_STATUS"):
            self.put(r.round_id, "event", kind, **told)
        said = self.texts.read(json.dumps([self.session, r.round_id, "output"]), of[_OUTPUT]) or of[_FINAL] or ""
        self.put(r.round_id, "round", "COMPLETED" if of[_STATE] == "DONE" else "FAILED", **told | {"text": said if of[_STATE] == "DONE" else ""})
        self.empty(r.round_id, of)
        of[_OUTPUT], of[_FINAL], of[_CALLS], of[_MODEL] = [0, ""], None, {}, None

    def write(self) -> None:
        for round_id, of in list(self.rounds.items()):
            if round_id not in self.used and self.passed(of):
                self.empty(round_id, self.rounds.pop(round_id))
                self.changed = True
            elif of[_ENDED] is not None and self.passed(of):
                of[_TOUCHED], of[_ENDED], self.changed = self.now, self.now, True
        if not self.changed:
            return
        for round_id in self.used:
            of = self.rounds[round_id]
            for most in (self.of.in_hand // 16, 0):
                for name, text in self.held(round_id, of):
                    self.texts.settle(name, text, most)
                if not of[_CALLS] or len(json.dumps(of, ensure_ascii=False)) <= self.of.in_hand:
                    break
        if self.rounds:
            self.wake = self.now + self.of.idle_ms
        text = self._text()
        if len(text) > self.of.in_hand:
            self._put_apart()
            text = self._text()
        self.page.put(self.session, text)

    def _text(self) -> str:
        return json.dumps([self.number, self.apart, list(self.rounds.items())], ensure_ascii=False, separators=(",", ":"))

    def _put_apart(self) -> None:
        """Leaves the rounds that changed last, up to half of what is held at once, so that this isn't done by each batch."""
        room = self.of.in_hand // 2
        for round_id in sorted(self.rounds, key=lambda k: self.rounds[k][_TOUCHED], reverse=True):
            text = json.dumps(self.rounds[round_id], ensure_ascii=False)
            room -= len(text)
            if room < 0:
                self.of.apart.updateValue((self.session, round_id), (text,))
                self.apart += 1
                self.wake = min(self.wake, self.ends(self.rounds.pop(round_id)))

    def ends(self, of: list) -> int:
        """When a round apart is to go, as no batch looks at it."""
        idle = of[_TOUCHED] + self.of.idle_ms
        return idle if of[_ENDED] is None else min(idle, of[_ENDED] + self.of.kept_ms)


def pack(batches: Iterator[pa.RecordBatch], most: int = 262_144, size: int = 1 << 26) -> Iterator[pa.RecordBatch]:
    """(bucket, signal) as one row a bucket of what a task holds at once, with the signals on lines of one text."""
    held: list[pa.RecordBatch] = []

    def rows() -> Iterator[pa.RecordBatch]:
        groups = pa.Table.from_batches(held).group_by("bucket", use_threads=False).aggregate([("signal", "list")]).combine_chunks()
        held.clear()
        names = pa.nulls(len(groups), groups["signal_list"].type.value_type)
        yield from pa.table({"bucket": groups["bucket"], "session_id": names, "signals": pc.binary_join(groups["signal_list"], "\n")}).to_batches()

    for batch in batches:
        held.append(batch)
        if sum(x.num_rows for x in held) >= most or sum(x.nbytes for x in held) >= size:
            yield from rows()
    if held:
        yield from rows()


def fold(signals: DataFrame, keep: int = KEPT_LENGTH, kept_ms: int = 600_000, idle_ms: int = 7 * 86_400_000, in_hand: int = 65_536) -> DataFrame:
    """Events, spans and finished rounds (FOLDED) of a stream of signals. Needs the RocksDB state store (see configure()).

    Signals go in as texts of many, and what a bucket of sessions gives comes out as texts of many records, both JSON: each row and
    each column costs a conversion.
    """
    bucket = F.pmod(F.xxhash64("session_id"), F.lit(BUCKETS)).alias("bucket")
    texts = signals.withColumn("micros", F.unix_micros("ts")).select(bucket, F.to_json(F.struct("session_id", *_FIELDS)).alias("signal"))
    packed = texts.mapInArrow(pack, "bucket long, session_id string, signals string")
    told = packed.groupBy("bucket").transformWithState(statefulProcessor=RoundFold(keep, kept_ms, idle_ms, in_hand), outputStructType="told string", outputMode="Append", timeMode="ProcessingTime")
    return told.select(F.explode(F.from_json("told", f"array<struct<{FOLDED}>>")).alias("x")).select("x.*")


def events(folded: DataFrame) -> DataFrame:
    """(session, round, event_type, payload, sequence_num) of what fold() gives, stream or table."""
    kind = F.col("kind")
    ids = [F.col("tool_call_id"), F.col("tool_name").alias("name")]
    block = lambda name, *fields: F.struct(F.lit(name).alias("type"), *fields)
    payload = lambda b, last: F.to_json(F.struct(F.array(b).alias("content"), F.lit(last).alias("is_last")))
    arguments = F.when(F.schema_of_variant(F.try_parse_json("tool_input")).startswith("OBJECT"), F.try_parse_json("tool_input"))
    nothing = F.lit("").alias("text")
    message = sanitize(F.coalesce(F.when(F.trim("text") != "", F.col("text")), F.when(F.col("state") == "INTERRUPTED", "interrupted").otherwise("the agent failed")))
    bodies = {
        "RUN_START": F.to_json(F.struct("round_id")),
        "TEXT_DELTA": payload(block("text", F.col("text"), F.col("block_id")), False),
        "TEXT_END": payload(block("text", nothing, F.col("block_id")), True),
        "THINKING_DELTA": payload(block("thinking", F.col("text"), F.col("block_id")), False),
        "THINKING_END": payload(block("thinking", nothing, F.col("block_id")), True),
        "TOOL_CALL_START": payload(block("tool_call", *ids), False),
        "TOOL_CALL_END": payload(block("tool_call", *ids, arguments.alias("input")), True),
        "TOOL_RESULT_TEXT_DELTA": payload(block("tool_result", *ids, F.col("text").alias("output"), F.col("truncated")), False),
        "TOOL_RESULT_END": payload(block("tool_result", *ids, F.col("text").alias("output"), F.col("truncated")), True),
        "RUN_END": F.to_json(F.struct("stop_reason")),
        "RUN_ERROR": F.to_json(F.struct(F.col("stop_reason"), message.alias("message"))),
        "ERROR": F.to_json(F.struct(F.lit("DEEP_AGENT_RUN_ERROR").alias("code"), message.alias("message"))),
        "SESSION_STATUS": F.to_json(F.struct(F.lit("IDLE").alias("status"), F.col("stop_reason"))),
    }
    body = F.coalesce(*(F.when(kind == name, b) for name, b in bodies.items()))
    named = F.when(kind.startswith("TEXT_"), "MESSAGE").when(kind.startswith("THINKING_"), "THINKING").when(kind.startswith("TOOL_CALL_"), "TOOL_CALL").when(kind.startswith("TOOL_RESULT_"), "TOOL_CALL_OUTPUT").otherwise(kind)
    return folded.filter("record = 'event'").select("session_id", "round_id", named.alias("event_type"), body.alias("payload"), "sequence_num")


def spans(folded: DataFrame) -> DataFrame:
    """llm.call and tool.call spans of what fold() gives, with the columns of the batch fold's."""
    start, end = F.timestamp_micros("start_micros"), F.timestamp_micros("end_micros")
    return folded.filter("record = 'span'").select(
        "session_id", "round_id", F.col("kind").alias("span_name"), start.alias("start_time"), end.alias("end_time"), F.col("state").alias("status"), "input_tokens", "output_tokens", "model_name", "tool_name",
        sanitize(F.col("tool_input")).alias("tool_input"), mask_secrets(F.col("text")).alias("tool_output"), duration_ms(start, end).alias("duration_ms"),
    )


def rounds(folded: DataFrame) -> DataFrame:
    """(session, round, output, status, stop_reason) of the rounds that ended."""
    return folded.filter("record = 'round'").select("session_id", "round_id", F.col("text").alias("output"), F.col("kind").alias("status"), "stop_reason")


def configure(spark) -> None:
    """Sets the state store that fold() needs. Timers and expiry are looked at with each batch of data; without this, a run over all
    that is available would wait for them with empty batches for ever.
    """
    spark.conf.set("spark.sql.streaming.noDataMicroBatches.enabled", "false")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
