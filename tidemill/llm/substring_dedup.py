"""Exact substring deduplication over suffix arrays of shards.

Every string of `length` bytes contains an anchor, a place that its own bytes choose, so equal strings have equal anchors
at equal offsets. Anchors cut each text into segments of starts and bring together, by their hash, all segments that can
share a string. Segments equal with all their strings count once; what is left of a shard is sorted as suffixes, and
neighbours in that order with a common prefix of `length` bytes are the repeats. An anchor that very many different
segments share would make a shard without bound; its strings are dealt out one by one, by their own hashes, instead.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textvec as tv
from .scratch import discard, materialize
from .suffix_array import permuted_common_prefixes, suffix_array

GRAM = 32
SHARD_BYTES = 1 << 21
#: An anchor of about twice as many different segments isn't sorted in a shard.
HOT_SEGMENTS = 4096
_MOST_BROADCAST = 1_000_000
_REP, _GONE = 0, 1


def _sliding_minimum(values: np.ndarray, width: int) -> np.ndarray:
    """The minimum of each run of `width` values, from minima of blocks to either side."""
    n = len(values)
    if n < width:
        return values[:0]
    blocks = -(-n // width)
    padded = np.full(blocks * width, np.iinfo(np.uint64).max, np.uint64)
    padded[:n] = values
    grid = padded.reshape(blocks, width)
    forward = np.minimum.accumulate(grid, axis=1).ravel()
    backward = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(backward[: n - width + 1], forward[width - 1 : n])


def segments(data: np.ndarray, offsets: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """(document, first start, last start, anchor hash, content hash) of all segments.

    A segment is a run of starts of whole strings of `length` bytes that choose the same anchor: the least hash of GRAM
    bytes within the string, the leftmost of equal ones. The content hash covers all bytes of the segment's strings and
    the place of the anchor. Starts count from the document's own start.
    """
    n, none = len(data), np.zeros(0, np.int64)
    if n < length:
        return none, none, none, np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    prefix = tv.prefix_hash(data)
    at = np.arange(n - GRAM + 1)
    values = tv.span_hash(prefix, at, at + GRAM)
    values = tv.mix(values ^ np.uint64(0xA5A5A5A5A5A5A5A5)) & np.uint64(0xFFFFFFFF00000000) | at.astype(np.uint64)
    chosen = (_sliding_minimum(values, length - GRAM + 1) & np.uint64(0xFFFFFFFF)).astype(np.int64)
    late = np.zeros(n + 1, np.int64)
    np.add.at(late, np.maximum(offsets[:-1], offsets[1:] - length + 1), 1)
    np.add.at(late, offsets[1:], -1)
    start = np.flatnonzero(np.cumsum(late[:-1])[: len(chosen)] == 0)
    if not len(start):
        return none, none, none, np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    anchor = chosen[start]
    new = np.flatnonzero(np.concatenate(([True], (anchor[1:] != anchor[:-1]) | (start[1:] != start[:-1] + 1))))
    first, last, anchor = start[new], start[np.append(new[1:], len(start)) - 1], anchor[new]
    doc = np.searchsorted(offsets, first, "right") - 1
    content = tv.mix(tv.span_hash(prefix, first, last + length) + (anchor - first).astype(np.uint64))
    return doc, first - offsets[doc], last - offsets[doc], tv.span_hash(prefix, anchor, anchor + GRAM), content


_SEGMENT = "kind int, anchor long, content long, doc_id long, row long, first long, last long"
_NAMES = ["kind", "anchor", "content", "doc_id", "row", "first", "last"]


def _batch(kind: int, *columns: np.ndarray) -> pa.RecordBatch:
    return pa.record_batch([pa.array(np.full(len(columns[0]), kind, np.int32)), *(pa.array(c.view(np.int64) if c.dtype == np.uint64 else c) for c in columns)], _NAMES)


def _cut(length: int):
    """Segments of each batch: of those with equal contents the earliest one stands for all, the others are repeats."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row, doc_id = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            parts = []
            for lo, _, data, offsets in tv.slices(batch.column(2)):
                doc, first, last, anchor, content = segments(data, offsets, length)
                parts.append((doc + lo, first, last, anchor, content))
            if not parts:
                continue
            doc, first, last, anchor, content = (np.concatenate(x) for x in zip(*parts, strict=True))
            rank = np.empty(len(row), np.int64)
            rank[np.lexsort((row, doc_id))] = np.arange(len(row))
            early = np.argsort(rank[doc], kind="stable")
            both = (anchor ^ tv.mix(content))[early]
            order = early[np.argsort(both, kind="stable")]
            repeat = np.concatenate(([False], (anchor[order[1:]] == anchor[order[:-1]]) & (content[order[1:]] == content[order[:-1]])))
            rep, gone = order[~repeat], np.sort(order[repeat])
            yield _batch(_REP, anchor[rep], content[rep], doc_id[doc[rep]], row[doc[rep]], first[rep], last[rep])
            d, f, e = _joined(doc[gone], first[gone], last[gone])
            nil = np.zeros(len(d), np.int64)
            yield _batch(_GONE, nil, nil, doc_id[d], row[d], f, e)

    return run


def _joined(doc: np.ndarray, first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Neighbouring runs of starts as one; runs come in order."""
    if not len(doc):
        return doc, first, last
    new = np.flatnonzero(np.concatenate(([True], (doc[1:] != doc[:-1]) | (first[1:] != last[:-1] + 1))))
    return doc[new], first[new], last[np.append(new[1:], len(doc)) - 1]


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by anchor, content and place. Repeats of a content are gone; anchors with several contents go on.

    What is held from batch to batch is a row for each content of one anchor.
    """

    def several(c: list[np.ndarray]) -> pa.RecordBatch:
        same = c[0][1:] == c[0][:-1]
        return _batch(_REP, *(x[np.concatenate(([False], same)) | np.concatenate((same, [False]))] for x in c))

    held = None
    for batch in batches:
        if not batch.num_rows:
            continue
        now = [batch.column(k).to_numpy() for k in range(1, 7)]
        if held is not None:
            now = [np.concatenate(x) for x in zip(held, now, strict=True)]
        repeat = np.concatenate(([False], (now[0][1:] == now[0][:-1]) & (now[1][1:] == now[1][:-1])))
        yield _batch(_GONE, *(x[repeat] for x in now))
        now = [x[~repeat] for x in now]
        others = np.flatnonzero(now[0] != now[0][-1])
        last = int(others[-1]) + 1 if len(others) else 0
        held = [x[last:] for x in now]
        if last:
            yield several([x[:last] for x in now])
    if held is not None:
        yield several(held)


def _strings(length: int):
    """(anchor, string hash, doc_id, row, start) of every string of the segments."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row, doc_id, segs = batch.column(0).to_numpy(), batch.column(1).to_numpy(), batch.column(3)
            for lo, hi, data, offsets in tv.slices(batch.column(2)):
                part = segs.slice(lo, hi - lo)
                of = np.repeat(np.arange(hi - lo), part.value_lengths().to_numpy())
                anchor, first, last = (part.flatten().field(k).to_numpy() for k in range(3))
                counts = last - first + 1
                start = np.repeat(first - np.cumsum(counts) + counts, counts) + np.arange(counts.sum())
                of = np.repeat(of, counts)
                at = offsets[of] + start
                string = tv.span_hash(tv.prefix_hash(data), at, at + length)
                yield pa.record_batch([pa.array(np.repeat(anchor, counts)), pa.array(string.view(np.int64)), pa.array(doc_id[lo + of]), pa.array(row[lo + of]), pa.array(start)], ["anchor", "string", "doc_id", "row", "start"])

    return run


def _contexts(length: int):
    """The bytes of each segment that goes on: of all its strings, from the first start on."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [[] for _ in range(6)]
            texts = batch.column(2).cast(pa.large_binary())
            for row, doc_id, text, segs in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), texts, batch.column(3).to_pylist(), strict=True):
                whole = text.as_py()
                for s in segs:
                    for k, v in enumerate((s["anchor"], doc_id, row, s["first"], s["last"], whole[s["first"] : s["last"] + length])):
                        out[k].append(v)
            yield pa.record_batch([pa.array(out[k], pa.int64()) for k in range(5)] + [pa.array(out[5], pa.binary())], ["anchor", "doc_id", "row", "first", "last", "bytes"])

    return run


def _shard_repeats(shard: list[tuple], length: int) -> pa.RecordBatch:
    """The starts of a shard's segments whose string starts earlier elsewhere in the shard.

    Segments stand in the order of their documents and starts, so the least position of equal strings is the earliest.
    """
    shard.sort(key=lambda r: (r[1], r[2], r[3]))
    sizes = np.array([len(r[5]) + 1 for r in shard])
    text = np.frombuffer(b"\0".join(r[5] for r in shard) + b"\0", np.uint8)
    begin = np.cumsum(sizes) - sizes
    order = suffix_array(text)
    _, common = permuted_common_prefixes(text, order, length)
    counts = sizes - 1 - length + 1
    start = np.repeat(begin, counts) + np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
    owned = np.zeros(len(text), bool)
    owned[start] = True
    # Suffixes that are no whole string are left out of their runs: between two of at least `length` common bytes there are
    # only others with as many, and those that a separator cuts short aren't owned.
    group = np.cumsum(common[order] < length)
    order, group = order[owned[order]], group[owned[order]]
    new = np.flatnonzero(np.concatenate(([True], group[1:] != group[:-1])))
    least = np.minimum.reduceat(order, new)
    gone = np.sort(order[np.repeat(least, np.diff(np.append(new, len(order)))) != order])
    of = np.searchsorted(begin, gone, "right") - 1
    first = np.array([r[3] for r in shard])[of] + gone - begin[of]
    of, first, last = _joined(of, first, first)
    nil = np.zeros(len(of), np.int64)
    return _batch(_GONE, nil, nil, np.array([r[1] for r in shard], np.int64)[of], np.array([r[2] for r in shard], np.int64)[of], first, last)


def _sort_shards(length: int, shard_bytes: int):
    """Shards of whole anchors, about shard_bytes each, off rows that come sorted by anchor."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, size, key = [], 0, None
        for batch in batches:
            for r in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if r[0] != key and size >= shard_bytes:
                    yield _shard_repeats(shard, length)
                    shard, size = [], 0
                key = r[0]
                shard.append(r)
                size += len(r[5])
        if len(shard) > 1:
            yield _shard_repeats(shard, length)

    return run


def _kept(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).cast(pa.large_binary())
            n_bytes, n_removed, n_spans, sha = [], [], [], []
            for text, gone in zip(texts, batch.column(2).to_pylist(), strict=True):
                whole, digest, at, spans, removed = text.as_buffer(), hashlib.sha256(), 0, 0, 0
                end = -1
                for s in sorted((g["first"], g["last"]) for g in gone or ()):
                    if s[0] > end:
                        digest.update(whole[at : s[0]])
                        spans, at = spans + 1, s[0]
                        removed += s[1] + length - s[0]
                        end = s[1] + length
                    elif s[1] + length > end:
                        removed += s[1] + length - end
                        end = s[1] + length
                    at = end
                digest.update(whole[at:])
                n_bytes.append(len(whole))
                n_removed.append(removed)
                n_spans.append(spans)
                sha.append(digest.hexdigest())
            yield pa.record_batch([batch.column(0), *(pa.array(x, pa.int64()) for x in (n_bytes, n_removed, n_spans)), pa.array(sha)], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    return run


def _wanted(rows: DataFrame, segments: DataFrame) -> DataFrame:
    """(row, doc_id, text, segments) of the rows that have any."""
    wanted = segments.groupBy("row").agg(F.collect_list(F.struct("anchor", "first", "last")).alias("segments"))
    return rows.join(wanted, "row").select("row", "doc_id", "text", "segments")


def _repeated_strings(strings: DataFrame) -> DataFrame:
    """Starts whose string also starts earlier, off a written table; counts combine before the shuffle."""
    place = F.struct("doc_id", "row", "start")
    least = materialize(strings.groupBy("anchor", "string").agg(F.min(place).alias("least"), F.count("*").alias("n")).filter("n > 1").drop("n"), "least")
    return strings.join(least, ["anchor", "string"]).filter(place != F.col("least")).select("row", F.col("start").alias("first"), F.col("start").alias("last"))


def repeated_starts(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 100, shard_bytes: int = SHARD_BYTES, hot_segments: int = HOT_SEGMENTS) -> tuple[DataFrame, DataFrame]:
    """(numbered rows, runs of repeated starts): (row, doc_id, text) and (row, first, last).

    A start is repeated if the string of `length` bytes from it also starts earlier: in a row with a smaller id, in an
    earlier row of the same id, or earlier in the same text. Ids that are null come last.

    A sixteenth of the segments, chosen by content, tells which anchors are hot. Either way of treating an anchor finds the
    same repeats.
    """
    ids = F.coalesce(F.col(id_col).cast("long"), F.lit((1 << 63) - 1))
    rows = documents.select(F.monotonically_increasing_id().alias("row"), ids.alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary").alias("text"))
    cut = materialize(rows.mapInArrow(_cut(length), _SEGMENT), "segments")
    segs = cut.filter(F.col("kind") == _REP)
    hot = segs.filter(F.col("content").bitwiseAND(15) == 0).groupBy("anchor").agg(F.count("*").alias("n")).filter(F.col("n") > hot_segments // 16)
    hot = materialize(hot.select("anchor"), "hot")
    n_hot = hot.count()
    known = F.broadcast(hot) if n_hot <= _MOST_BROADCAST else hot
    cold = segs.join(known, "anchor", "left_anti") if n_hot else segs
    sort = ("anchor", "content", "doc_id", "row", "first")
    compared = materialize(cold.select(*_NAMES).repartition("anchor").sortWithinPartitions(*sort).mapInArrow(_compare, _SEGMENT), "compared")
    early = cut.filter(F.col("kind") == _GONE).unionByName(compared.filter(F.col("kind") == _GONE)).select("row", "first", "last")
    if n_hot:
        strings = materialize(_wanted(rows, segs.join(known, "anchor", "left_semi")).mapInArrow(_strings(length), "anchor long, string long, doc_id long, row long, start long"), "strings")
        early = early.unionByName(_repeated_strings(strings))
    early = materialize(early, "repeats")
    discard(cut)
    contexts = _wanted(rows, compared.filter(F.col("kind") == _REP)).mapInArrow(_contexts(length), "anchor long, doc_id long, row long, first long, last long, bytes binary")
    sorted_shards = contexts.repartition("anchor").sortWithinPartitions("anchor").mapInArrow(_sort_shards(length, shard_bytes), _SEGMENT)
    found = materialize(sorted_shards.select("row", "first", "last"), "repeats")
    return rows, early.unionByName(found)


def remove_repeats(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 100, shard_bytes: int = SHARD_BYTES, hot_segments: int = HOT_SEGMENTS) -> DataFrame:
    """One row per document: doc_id, n_bytes, n_removed, n_spans, kept_sha256.

    A byte is removed if a string of `length` bytes that also starts earlier covers it (see repeated_starts()); strings
    overlap freely, never cross documents and are judged on the input. n_spans counts maximal removed runs, kept_sha256 is
    the digest of the remaining bytes. Null texts are empty; texts shorter than `length` stay whole. Of rows with equal ids
    and texts the first one keeps its bytes. An empty table gives an empty result; other columns aren't read.
    """
    rows, gone = repeated_starts(documents, id_col, text_col, length, shard_bytes, hot_segments)
    spans = gone.groupBy("row").agg(F.collect_list(F.struct("first", "last")).alias("gone"))
    numbered = rows.withColumn("doc_id", F.when(F.col("doc_id") < (1 << 63) - 1, F.col("doc_id")))
    joined = numbered.join(spans, "row", "left").select("doc_id", "text", "gone")
    return joined.mapInArrow(_kept(length), "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def op7_suffix_array_dedup(spark, sf_dir: str) -> DataFrame:
    """Strings of 100 bytes over all documents."""
    return remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"))


#: Bytes as two hexadecimal digits each, in pieces that overlap by a string, so that no long text is cut again and again.
ORACLE_OP7 = r"""
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h, strlen(coalesce(text, '')) AS n FROM documents),
c AS (SELECT doc_id, n, b * 1000 AS base, substr(h, 2000 * b + 1, 2198) AS part FROM d, LATERAL (SELECT unnest(range(0, greatest(n - 99, 0) // 1000 + 1)) AS b)),
s AS (SELECT doc_id, base + i AS start, substr(part, 2 * i + 1, 200) AS x FROM c, LATERAL (SELECT unnest(range(0, least(1000, n - 99 - base))) AS i)),
f AS (SELECT x, min(doc_id::HUGEINT * 1099511627776 + start) AS earliest FROM s GROUP BY x HAVING count(*) > 1),
r AS (SELECT doc_id, start, coalesce(start - lag(start) OVER (PARTITION BY doc_id ORDER BY start) > 100, true)::INTEGER AS new FROM s JOIN f USING (x) WHERE doc_id::HUGEINT * 1099511627776 + start > earliest),
g AS (SELECT doc_id, start, sum(new) OVER (PARTITION BY doc_id ORDER BY start) AS run FROM r),
p AS (SELECT doc_id, min(start) AS a, max(start) + 100 AS b FROM g GROUP BY doc_id, run),
k AS (SELECT doc_id, a, b, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS before FROM p),
m AS (SELECT doc_id, sum(b - a)::BIGINT AS n_removed, count(*) AS n_spans, max(b) AS last, string_agg(substr(h, 2 * before + 1, 2 * (a - before)), '' ORDER BY a) AS kept FROM k JOIN d USING (doc_id) GROUP BY doc_id)
SELECT d.doc_id, d.n AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(coalesce(kept, '') || substr(h, 2 * coalesce(last, 0) + 1))) AS kept_sha256
FROM d LEFT JOIN m USING (doc_id)
"""
