import json
import random
from datetime import datetime, timedelta

import pyarrow as pa
import pytest
from pyspark.sql import Row

from tidemill.plans import envelope, rounds
from tidemill.schemas import SIGNAL
from tidemill.streaming import rounds as streaming
from tidemill.streaming import sinks

START = datetime(2024, 1, 1)


def signals(spark, *rows, session="s", round_id="r"):
    names = [c.split()[0] for c in SIGNAL.split(", ")]
    made = []
    for k, r in enumerate(rows):
        r = {"type": r} if isinstance(r, str) else r
        made.append(tuple(({"session_id": session, "round_id": round_id, "seq": k, "ts": START + timedelta(milliseconds=100 * k)} | r).get(n) for n in names))
    return spark.createDataFrame(made, SIGNAL)


def delta(text):
    return {"type": "TEXT_DELTA", "text": text, "block_id": "b"}


def kinds(df):
    return [r["event_type"] for r in df.orderBy("sequence_num").collect()]


def test_a_round_that_ends(spark):
    df = signals(spark, {"type": "THINKING_DELTA", "text": "hm"}, "THINKING_END", delta("你"), delta("好"), {"type": "UNKNOWN"}, "AGENT_END", delta("late"))
    assert tuple(rounds.rounds(df).first()) == ("s", "r", "你好", "COMPLETED", "stop")
    events = rounds.events(df)
    assert kinds(events) == ["RUN_START", "THINKING", "THINKING", "MESSAGE", "MESSAGE", "RUN_END", "SESSION_STATUS"]
    assert json.loads(events.filter("sequence_num = 4").first()["payload"]) == {"content": [{"type": "text", "text": "你", "block_id": "b"}], "is_last": False}


@pytest.mark.parametrize(
    "rows,status,reason",
    [
        (["EXCEED_MAX_ITERS", "AGENT_END"], "COMPLETED", "max_iterations"), ([delta("x"), "DISCONNECT"], "FAILED", "interrupted"), ([{"type": "ERROR", "text": "sk-abc"}, "AGENT_END"], "FAILED", "error"),
        (["AGENT_END", "ERROR"], "COMPLETED", "stop"), ([delta("x")], "RUNNING", None),
    ],
)
def test_the_first_ending_wins(spark, rows, status, reason):
    r = rounds.rounds(signals(spark, *rows)).first()
    assert (r["status"], r["stop_reason"]) == (status, reason)


def test_failures_carry_a_masked_message(spark):
    events = rounds.events(signals(spark, {"type": "ERROR", "text": "key sk-abc"}))
    assert kinds(events) == ["RUN_START", "RUN_ERROR", "ERROR", "SESSION_STATUS"]
    assert json.loads(events.filter("event_type = 'ERROR'").first()["payload"])["message"] == "key sk-***"


def test_result_text_stands_in_for_missing_deltas(spark):
    assert rounds.rounds(signals(spark, {"type": "AGENT_RESULT", "result_text": "done"}, "AGENT_END")).first()["output"] == "done"


def test_tool_calls(spark):
    call = lambda t, **k: {"type": t, "tool_call_id": "c", "tool_name": "q"} | k
    other = {"type": "TOOL_RESULT_TEXT_DELTA", "tool_call_id": "d", "text": "zz"}
    df = signals(spark, call("TOOL_CALL_START"), call("TOOL_CALL_DELTA", text='{"a":'), call("TOOL_CALL_DELTA", text="1}"), call("TOOL_CALL_END"), call("TOOL_RESULT_TEXT_DELTA", text="HHH"), other, call("TOOL_RESULT_TEXT_DELTA", text="HMMMTTTT"), call("TOOL_RESULT_END", tool_state="Error"), "AGENT_END")
    payloads = [json.loads(r["payload"]) for r in rounds.events(df, keep=4).filter("event_type like 'TOOL%'").orderBy("sequence_num").collect()]
    blocks = [p["content"][0] for p in payloads]
    assert blocks[1] == {"type": "tool_call", "tool_call_id": "c", "name": "q", "input": {"a": 1}}
    assert [b.get("output") for b in blocks[2:5]] == ["HHH", "zz", "H"]
    assert "中间省略 3 字符" in blocks[5]["output"] and "TTTT" in blocks[5]["output"] and blocks[5]["truncated"]
    span = rounds.spans(df).first()
    assert (span["span_name"], span["status"], span["tool_name"], span["duration_ms"], span["tool_input"]) == ("tool.call", "ERROR", "q", 700, '{"a":1}')


@pytest.mark.parametrize("seed", [1, 2])
def test_depths_of_deep_trees_circles_and_orphans(spark, seed):
    rng = random.Random(seed)
    up = {0: None, 1: None} | {k: rng.choice([k - 1, rng.randrange(k)]) for k in range(2, 300)}
    up |= {500: 501, 501: 502, 502: 500, 503: 501, 504: 504, 600: 999, 601: 600}

    def line(k):
        seen = []
        while k is not None and k not in seen and k in up:
            seen.append(k)
            k = up[k]
        return (seen[-1], len(seen) - 1, "/".join(map(str, seen[::-1])), None) if k is None else (None, None, None, "cycle" if k in seen else "no parent")

    df = spark.createDataFrame(list(up.items()), "span_id int, parent_span_id int").repartition(3)
    got = {r["span_id"]: tuple(r)[2:] for r in rounds.span_depths(df).collect()}
    assert got == {k: line(k) for k in up}
    assert {r["span_id"]: (r["root"], r["depth"], r["path"]) for r in rounds.span_depths(df, with_path=False).collect()} == {k: (*line(k)[:2], None) for k in up}
    assert rounds.span_depths(df.limit(0)).collect() == []


def test_deep_chains_cost_a_multiple_of_the_table(spark, tmp_path, monkeypatch):
    """Spans that are taken out get what the others get, and all rounds together write a few times the table."""
    up = {k: k - 1 if k else None for k in range(900)} | {2000 + k: 2000 + (k + 1) % 70 for k in range(70)} | {3000: 9999} | {3000 + k: 2999 + k for k in range(1, 50)} | {4000 + k: 2010 for k in range(20)}
    paths = []
    monkeypatch.setattr(rounds, "new_folder", lambda spark, name: paths.append(f"{tmp_path}/{len(paths)}") or paths[-1])
    df = spark.createDataFrame(list(up.items()), "span_id long, parent_span_id int").coalesce(1)
    got = {r["span_id"]: tuple(r)[2:] for r in rounds.span_depths(df, few=100).collect()}
    assert got == {k: (0, k, "/".join(map(str, range(k + 1))), None) if k < 900 else (None, None, None, "no parent" if 3000 <= k < 4000 else "cycle") for k in up}
    assert sum(spark.read.parquet(p).count() for p in paths) < 7 * len(up)


def test_model_spans(spark):
    df = signals(spark, "MODEL_CALL_START", {"type": "MODEL_CALL_END", "input_tokens": 3, "output_tokens": 4, "model_name": "m"}, {"type": "MODEL_CALL_END"}, "AGENT_END")
    assert [(r["model_name"], r["input_tokens"], r["output_tokens"], r["duration_ms"]) for r in rounds.spans(df).collect()] == [("m", 3, 4, 100)]


def test_states_overlaps_and_recovery(spark):
    df = spark.createDataFrame([("s", k, x) for k, x in enumerate(["IDLE", "RUNNING", "DONE", "RUNNING"])], "session string, at int, state string")
    assert [(r["previous_state"], r["state"]) for r in rounds.illegal_transitions(df, ["session"], "at", "state").collect()] == [("DONE", "RUNNING")]
    t = lambda m: START + timedelta(minutes=m)
    df = spark.createDataFrame([("s", 1, t(0), t(9)), ("s", 2, t(5), t(6)), ("s", 3, t(9), None), ("s", 4, t(20), t(21))], "session string, id int, started timestamp, ended timestamp")
    assert sorted(r["id"] for r in rounds.overlapping_rounds(df, "session", "started", "ended").collect()) == [2, 4]
    sessions = spark.createDataFrame([("a", "RUNNING"), ("b", "IDLE")], "session_id string, status string")
    open_rounds = spark.createDataFrame([("a", "1", "RUNNING"), ("a", "0", "COMPLETED"), ("b", "1", "RUNNING")], "session_id string, round_id string, status string")
    idle, stopped = rounds.recover(sessions, open_rounds)
    assert {r["status"] for r in idle.collect()} == {"IDLE"}
    assert sorted(tuple(r) for r in stopped.collect()) == [("a", "0", "COMPLETED"), ("a", "1", "INTERRUPTED"), ("b", "1", "RUNNING")]


def event(**k):
    return tuple(({"event_id": "e", "session_id": "s", "round_id": "r", "sequence_num": 1, "created_at": START} | k).get(n) for n in ("event_id", "session_id", "round_id", "event_type", "payload", "sequence_num", "created_at"))


def test_envelopes_and_frames(spark):
    df = spark.createDataFrame(
        [
            event(event_type="MESSAGE", payload='{"content":[{"type":"text","text":"你好","block_id":"blk-1"}],"is_last":false}'),
            event(event_type="SESSION_STATUS", payload='{"status":"IDLE","stop_reason":"stop"}', sequence_num=2),
            event(event_type="TOOL_CALL", payload="{bad", sequence_num=3),
        ],
        "event_id string, session_id string, round_id string, event_type string, payload string, sequence_num long, created_at timestamp",
    )
    e = {r["sequence_number"]: r for r in envelope.envelopes(df).collect()}
    assert (e[1]["role"], e[1]["type"], e[1]["metadata"]["is_last"]) == ("assistant", "message", "false")
    assert json.loads(e[2]["content"]) == [{"type": "data", "data": {"session_status": "IDLE", "stop_reason": "stop"}}]
    assert (e[3]["role"], json.loads(e[3]["content"])) == ("tool", [{"type": "data", "data": {}}])
    frames = envelope.server_sent(envelope.envelopes(df))
    assert frames.filter("sequence_number = 1").first()["frame"].startswith("id: 1\nevent: message\ndata: {")
    data = [json.loads(r["data"]) for r in envelope.parsed_frames(frames).collect()]
    assert sorted(d["sequence_number"] for d in data) == [1, 2, 3]
    assert next(d for d in data if d["sequence_number"] == 1)["metadata"] == {"session_id": "s", "round_id": "r", "is_last": False}
    odd = spark.createDataFrame([("data: a\ndata: b",), ("event: x",), ("event: y\ndata: c",)], "frame string")
    assert sorted(map(tuple, envelope.parsed_frames(odd).collect())) == [("message", "ab"), ("y", "c")]


def test_messages_fold(spark):
    df = signals(spark, {"type": "THINKING_DELTA", "text": "t"}, delta("a"), delta("b"), {"type": "TOOL_CALL_START", "tool_call_id": "c", "tool_name": "q"}, "AGENT_END")
    m = envelope.messages(rounds.events(df)).first()
    assert (m["thinking"], m["text"], m["errors"], m["status"], [t["name"] for t in m["tools"]]) == ("t", "ab", [], "IDLE", ["q"])


def streamed(spark, tmp_path, batches, **options):
    """What the stream's fold gives of some batches, one after another, and the state's rows after each."""
    streaming.configure(spark)
    for n, b in enumerate(batches):
        b.coalesce(1).write.parquet(f"{tmp_path}/in/{n}")
    stream = spark.readStream.schema(batches[0].schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(f"{tmp_path}/in")
    q = streaming.fold(rounds.meaningful(stream), **options).writeStream.foreachBatch(sinks.append_events(f"{tmp_path}/out")).option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.parquet(f"{tmp_path}/out"), [sum(s["numRowsTotal"] for s in p["stateOperators"]) for p in q.recentProgress if p["numInputRows"]]


@pytest.mark.parametrize("seed", [1, 2])
def test_streamed_rounds_equal_batch_rounds(spark, tmp_path, seed):
    """The same events with their payloads, spans and rounds, whatever the micro-batches are."""
    rng, rows = random.Random(seed), []
    for session in "ab":
        pool = ["TEXT_DELTA", "TEXT_END", "THINKING_DELTA", "EXCEED_MAX_ITERS", "START", "MODEL_CALL_START", "MODEL_CALL_END", "AGENT_RESULT", "AGENT_END" if session == "a" else rng.choice(["ERROR", "INTERRUPT"])]
        tools = iter([t for c in "xyz" for t in [("TOOL_CALL_START", c), *[("TOOL_CALL_DELTA", c)] * 3, ("TOOL_CALL_END", c), *[("TOOL_RESULT_TEXT_DELTA", c)] * 4, ("TOOL_RESULT_END", c)]])
        for k in range(120):
            row = {"type": rng.choice(pool), "text": rng.choice([f"t{k}", "sk-abc", None, " "]), "result_text": f"r{k}", "input_tokens": rng.choice([None, k]), "model_name": "m"}
            if k < 70 and rng.random() < 0.5 and (t := next(tools, None)):
                row = {"type": t[0], "tool_call_id": t[1], "tool_name": rng.choice(["q", None]), "tool_state": rng.choice([None, "error"]), "text": rng.choice(['{"a":1}', "数据", "x" * 9, None])}
            elif row["type"] in ("AGENT_END", "ERROR", "INTERRUPT") and k < 60:
                row["type"] = "TEXT_DELTA"
            rows.append(row | {"session_id": session, "round_id": "0" if k < 70 else f"{k // 8}", "seq": k})
    batch = signals(spark, *rows)
    cuts = sorted(rng.sample(range(1, 120), 3))
    folded, _ = streamed(spark, tmp_path, [batch.filter(f"seq >= {lo} and seq < {hi}") for lo, hi in zip([0, *cuts], [*cuts, 120])], keep=12)
    shown = lambda df: sorted((tuple(r) for r in df.collect()), key=str)
    got, want = shown(streaming.events(folded)), shown(rounds.events(batch, 12))
    assert got == want
    ended = rounds.rounds(batch).filter("status <> 'RUNNING'")
    assert shown(streaming.rounds(folded)) == shown(ended)
    made = streaming.spans(folded)
    assert shown(made.filter("span_name = 'llm.call'")) == shown(rounds.spans(batch).select(*made.columns).filter("span_name = 'llm.call'"))
    want = rounds.spans(batch).filter("span_name = 'tool.call'").select("session_id", "start_time", "end_time", "status", "tool_input", "duration_ms")
    assert shown(made.filter("span_name = 'tool.call'").select(*want.columns)) == shown(want)
    assert made.filter("tool_output like '%abc%'").isEmpty()


def test_state_stays_flat_over_many_rounds(spark, tmp_path):
    """Ended rounds leave nothing behind but the session's counter, and long texts are one piece a batch."""
    batches = []
    for n in range(8):
        call = lambda t, k, **more: {"type": t, "tool_call_id": f"c{n}", "text": "z" * 50, "round_id": f"{n}", "seq": n * 100 + k} | more
        rows = [call("TOOL_CALL_START", 0), *(call("TOOL_CALL_DELTA", k) for k in range(1, 30)), *(call("TOOL_RESULT_TEXT_DELTA", k) for k in range(30, 60))]
        rows += [{"type": "TEXT_DELTA", "text": "t", "round_id": f"{n}", "seq": n * 100 + k} for k in range(60, 80)]
        rows.append({"type": "AGENT_END", "round_id": f"{n}", "seq": n * 100 + 99})
        batches.append(signals(spark, *rows))
    _, sizes = streamed(spark, tmp_path, batches, keep=1000, kept_ms=0)
    assert len(sizes) == 8 and max(sizes[2:]) <= sizes[1] + 2


def test_a_failing_subscriber_is_dropped(spark, tmp_path):
    calls = []

    def bad(batch):
        calls.append(1)
        raise RuntimeError

    write = sinks.append_events(str(tmp_path / "o"), bad)
    for n in range(2):
        write(spark.range(3), n)
    write(spark.range(3), 1)
    assert calls == [1] and spark.read.parquet(str(tmp_path / "o")).count() == 6


class Held:
    """A state in memory."""

    def __init__(self):
        self.value, self.entries = None, {}

    def get(self):
        return self.value

    def update(self, value):
        self.value = value

    def getValue(self, key):
        return self.entries.get(key)

    def updateValue(self, key, value):
        self.entries[key] = value

    def removeKey(self, key):
        self.entries.pop(key, None)


def test_a_session_comes_and_goes_as_one_column():
    """A batch of a session is texts in and one text out, not a frame of all columns."""
    handle = type("Handle", (), {"getValueState": lambda *a: Held(), "getMapState": lambda *a: Held(), "registerTimer": lambda *a: None})()
    timers = type("Timers", (), {"getCurrentProcessingTimeInMs": lambda self: 0})()
    fold = streaming.RoundFold(keep=4)
    fold.init(handle)
    said = [{"round_id": "1", "seq": 2, "type": "TEXT_DELTA", "text": '"好\n'}, {"round_id": "1", "seq": 1, "type": "TEXT_DELTA", "text": "a"}, {"round_id": "1", "seq": 3, "type": "AGENT_END", "micros": 7}]
    out = [json.loads(r["told"]) for r in fold.handleInputRows(("s",), (Row(session_id="s", signal=json.dumps(x)) for x in said), timers)]
    assert len(out) == 1 and [x["kind"] for x in out[0]] == ["RUN_START", "TEXT_DELTA", "TEXT_DELTA", "RUN_END", "SESSION_STATUS", "COMPLETED"]
    assert out[0][-1]["text"] == 'a"好\n' and [x.get("sequence_num") for x in out[0]] == [1, 2, 3, 4, 5, None]


class Counted(Held):
    """A state in memory that counts what is asked of it."""

    def __init__(self, calls):
        super().__init__()
        self.calls = calls

    def get(self):
        self.calls.append("get")
        return super().get()

    def update(self, value):
        self.calls.append("update")
        super().update(value)

    def clear(self):
        self.value = None

    def getValue(self, key):
        self.calls.append("getValue")
        return super().getValue(key)

    def updateValue(self, key, value):
        self.calls.append("updateValue")
        super().updateValue(key, value)

    def removeKey(self, key):
        self.calls.append("removeKey")
        super().removeKey(key)

    def iterator(self):
        return iter(list(self.entries.items()))


def in_memory(**options):
    """A fold with its states in memory, the calls made to them, its timers, and a run over one batch of (session, signal)."""
    calls, timers = [], []
    handle = type("Handle", (), {"getValueState": lambda *a: Counted(calls), "getMapState": lambda *a: Counted(calls), "registerTimer": lambda self, x: timers.append(x)})()
    fold = streaming.RoundFold(**options)
    fold.init(handle)

    def run(rows, now=0):
        clock = type("Timers", (), {"getCurrentProcessingTimeInMs": lambda self: now})()
        out = [x for r in fold.handleInputRows((0,), (Row(session_id=s, signal=json.dumps(x)) for s, x in rows), clock) for x in json.loads(r["told"])]
        for x in sorted(t for t in timers if t <= now):
            timers.remove(x)
            list(fold.handleExpiredTimer((0,), clock, None))
        return sorted(out, key=lambda x: x["session_id"])  # of a session in order

    return fold, calls, timers, run


def test_a_session_is_read_once_and_written_once_a_batch():
    """Calls to the state store are the stream's cost: two a session and batch, one where nothing changes, whatever its calls are."""
    _, calls, _, run = in_memory(keep=4)
    call = lambda k, t: {"round_id": "1", "seq": k, "type": t, "text": "abc", "tool_call_id": "c", "micros": k}
    first = ["TOOL_CALL_START", "TOOL_CALL_DELTA", "TOOL_CALL_END", "TOOL_RESULT_TEXT_DELTA", "TEXT_DELTA"]
    run([(s, call(k, t)) for s in "abcd" for k, t in enumerate(first)])
    assert len(calls) <= 4 * 2 + 2  # the bucket's timer
    calls.clear()
    run([(s, call(k, t)) for s in "abcd" for k, t in enumerate(["TOOL_RESULT_TEXT_DELTA", "TOOL_RESULT_END", "AGENT_END"], 10)])
    assert len(calls) <= 4 * 2 + 1
    calls.clear()
    assert run([(s, call(20, "TEXT_DELTA")) for s in "abcd"]) == [] and calls == ["getValue"] * 4


@pytest.mark.parametrize("in_hand", [0, 600])
def test_what_lies_apart_gives_the_same(in_hand):
    """Rounds and texts over the limit lie in rows of their own; nothing of them is lost, and all of it goes."""
    rng, batches = random.Random(3), []
    kinds = ["TOOL_CALL_START", "TOOL_CALL_DELTA", "TOOL_CALL_DELTA", "TOOL_CALL_END", *["TOOL_RESULT_TEXT_DELTA"] * 4, "TOOL_RESULT_END", *["TEXT_DELTA"] * 4, "EXCEED_MAX_ITERS", "AGENT_RESULT", "MODEL_CALL_START", "MODEL_CALL_END"]
    for n in range(12):
        made = [{"type": rng.choice(kinds), "round_id": rng.choice(["a", "a/b", None]), "tool_call_id": rng.choice("cd"), "text": rng.choice(["数据" * 9, "x" * 30, None]), "result_text": f"r{n}", "micros": n} for _ in range(25)]
        made += [{"type": "AGENT_END", "round_id": x} for x in ("a", "a/b", None)] if n == 11 else []
        batches.append([(rng.choice("st") if n < 11 else s, x | {"seq": n * 100 + k}) for k, x in enumerate(made) for s in ("s" if n < 11 else "st")])
    whole, held = in_memory(keep=40), in_memory(keep=40, in_hand=in_hand)
    assert [held[3](b) for b in batches] == [whole[3](b) for b in batches]
    fold, _, timers, run = held
    run([], max(timers))  # what lies apart of rounds that ended
    run([], max(timers, default=0))
    assert not fold.apart.entries and not fold.texts.entries


def test_marks_stay_while_late_signals_come_and_go_after():
    fold, _, _, run = in_memory(kept_ms=10, idle_ms=1000)
    said = lambda k, t, r="1": [("s", {"round_id": r, "seq": k, "type": t, "text": "x"})]
    run(said(1, "TEXT_DELTA") + said(2, "AGENT_END"))
    assert run(said(3, "TEXT_DELTA"), 50) == [] and run(said(4, "TEXT_DELTA"), 59) == []
    run(said(5, "TEXT_DELTA", "2"), 70)
    assert [x["kind"] for x in run(said(6, "TEXT_DELTA"), 71)] == ["RUN_START", "TEXT_DELTA"]


def test_what_never_ends_expires_with_its_texts():
    fold, _, timers, run = in_memory(kept_ms=10, idle_ms=1000, in_hand=16)
    said = lambda k, r="1": [("s", {"round_id": r, "seq": k, "type": "TEXT_DELTA", "text": "long enough"})]
    first = run(said(1) + said(2, "2"))
    run(said(3, "2"), 900)
    assert fold.texts.entries and timers
    run([], min(timers))
    assert len(fold.apart.entries) == 1
    assert [x["kind"] for x in run(said(4), 1100)] == ["RUN_START", "TEXT_DELTA"] and first[0]["kind"] == "RUN_START"
    for _ in range(20):
        run([], max(timers, default=0))
    assert not timers and not fold.apart.entries and not fold.texts.entries
    assert run(said(5), 99999)[0]["sequence_num"] == 8


def test_rounds_of_many_sessions_come_as_one_text():
    """A bucket's sessions share the texts that go back, of 1,000 records at most; each session's records stay in order."""
    fold, _, _, _ = in_memory()
    clock = type("Timers", (), {"getCurrentProcessingTimeInMs": lambda self: 0})()
    rows = [Row(session_id=f"s{n}", signal=json.dumps({"round_id": "1", "seq": k, "type": t, "text": f"{n}"})) for k, t in enumerate(["TEXT_DELTA", "AGENT_END"]) for n in range(300)]
    told = [json.loads(r["told"]) for r in fold.handleInputRows((0,), iter(rows), clock)]
    assert [len(x) for x in told] == [1000, 500]
    flat = [x for texts in told for x in texts]
    assert {x["session_id"]: x["text"] for x in flat if x["record"] == "round"} == {f"s{n}": f"{n}" for n in range(300)}
    assert all([x.get("sequence_num") for x in flat if x["session_id"] == s] == [1, 2, 3, 4, None] for s in ("s0", "s299"))


def told_by(fold, rows):
    clock = type("Timers", (), {"getCurrentProcessingTimeInMs": lambda self: 0})()
    return sorted((x for r in fold.handleInputRows((0,), iter(rows), clock) for x in json.loads(r["told"])), key=lambda x: str(x["session_id"]))


def test_signals_of_many_sessions_go_in_as_one_text():
    """What a task holds is one row a bucket, whatever the batches are, and says the same as a row for each signal."""
    said = [{"session_id": s, "round_id": "1", "seq": k, "type": t, "text": f"{s}\n,好"} for k, t in enumerate(["TEXT_DELTA", "AGENT_END"]) for s in ("s", "t\n", None)]
    lines = [json.dumps({k: v for k, v in x.items() if v is not None}, ensure_ascii=False) for x in said]
    batches = [pa.record_batch({"bucket": [7, 7, 9], "signal": [*lines[k : k + 2], "{}"]}) for k in (0, 2, 4)]
    packed = [x for b in streaming.pack(iter(batches)) for x in b.to_pylist()]
    assert sorted((x["bucket"], x["session_id"], x["signals"].split("\n")) for x in packed) == [(7, None, lines), (9, None, ["{}"] * 3)]
    assert [b.num_rows for b in streaming.pack(iter(batches), most=6)] == [2, 2]
    assert list(streaming.pack(iter(()))) == []
    together, apart = (told_by(in_memory()[0], rows) for rows in ([Row(**packed[0])], [Row(session_id=x["session_id"], signal=line) for x, line in zip(said, lines)]))
    assert together == apart and {x["session_id"]: x["text"] for x in together if x["record"] == "round"} == {s: f"{s}\n,好" for s in ("s", "t\n", None)}


def test_calls_to_the_state_store_are_a_few_a_bucket():
    """However many sessions a batch brings: a page is read once and written once."""
    _, calls, _, run = in_memory()
    for n, kind in enumerate(["TEXT_DELTA", "TEXT_DELTA", "AGENT_END"]):
        calls.clear()
        out = run([(f"s{s}", {"round_id": "1", "seq": n, "type": kind, "text": f"{n}"}) for s in range(300)])
        assert len(calls) <= 2 * streaming.PAGES + 2
    assert {x["text"] for x in out if x["record"] == "round"} == {"01"} and len(out) == 900


@pytest.mark.parametrize("in_hand", [0, 900])
def test_pages_that_get_too_long_give_the_same(in_hand):
    """Sessions that a page has no room for have rows of their own: numbers go on, the rounds are whole, and marks still go."""
    rng, batches = random.Random(5), []
    for n in range(10):
        batches.append([(f"s{rng.randrange(60)}" if rng.random() < 0.9 else "", {"round_id": f"{n // 4}", "seq": n * 1000 + k, "type": rng.choice(["TEXT_DELTA"] * 5 + ["AGENT_END"]), "text": f"{k}好" * 3}) for k in range(150)])
    whole, held = in_memory(kept_ms=10, idle_ms=1000), in_memory(kept_ms=10, idle_ms=1000, in_hand=in_hand)
    assert [held[3](b, n) for n, b in enumerate(batches)] == [whole[3](b, n) for n, b in enumerate(batches)]
    fold, _, timers, run = held
    assert len(fold.sessions.entries) > 10 and not whole[0].sessions.entries
    assert in_hand == 0 or all(len(text) <= in_hand for (text,) in fold.pages.entries.values())
    for _ in range(20):
        run([], max(timers, default=0))
    assert not timers and all(json.loads(text)[2] == [] for (text,) in fold.sessions.entries.values())
    late = [(f"s{k}", {"round_id": "9", "seq": 1, "type": "START"}) for k in range(60)]
    numbers = [x["sequence_num"] for x in run(late, 99999)]
    assert numbers == [x["sequence_num"] for x in whole[3](late, 99999)] and max(numbers) > 5
