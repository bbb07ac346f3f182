"""Exact deduplication by content-defined chunk recipes.

A text is cut where its own bytes say so, every chunk gets an identifier that stands for its bytes alone, and
texts are compared as ordered lists of identifiers. The bytes of a chunk cross the network once, to verify that
no two different chunks share a digest; documents never do.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import textvec as tv
from .scratch import materialize, with_row_numbers

_WINDOW = 16
_SHORTEST, _LONGEST = 64, 8192


def _normalise(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Every run of white space becomes one space."""
    space = tv.SPACE[data]
    keep = np.ones(len(data), bool)
    keep[1:] = ~(space[1:] & space[:-1])
    keep[offsets[:-1][offsets[:-1] < len(data)]] = True
    kept = np.concatenate(([0], np.cumsum(keep)))
    return np.where(space, np.uint8(32), data)[keep], kept[offsets]


def _cuts(data: np.ndarray, offsets: np.ndarray, mean_bytes: int) -> np.ndarray:
    """Ends of chunks, in order. A cut depends on the 64 bytes before it and on the cut before that, never on the neighbours."""
    ends = offsets[1:][np.diff(offsets) > 0]
    n = len(data)
    inner = np.zeros(0, np.int64)
    if n > _WINDOW:
        prefix = tv.prefix_hash(data)
        at = np.arange(_WINDOW, n)
        inner = at[tv.span_hash(prefix, at - _WINDOW, at) < np.uint64((1 << 64) // mean_bytes)]
        begun = offsets[np.searchsorted(offsets, inner, "right") - 1]
        gap = np.diff(inner, prepend=-_SHORTEST)
        inner = inner[(inner - begun >= _SHORTEST) & (gap >= _SHORTEST)]
    ends = np.union1d(inner, ends)
    starts = np.concatenate(([0], ends[:-1]))[: len(ends)]
    if len(ends) and (ends - starts).max() > _LONGEST:
        more = [np.arange(s + _LONGEST, e, _LONGEST) for s, e in zip(starts, ends, strict=True) if e - s > _LONGEST]
        ends = np.union1d(ends, np.concatenate(more))
    return ends


def _chunks(column: pa.Array, mean_bytes: int, digest_bytes: int) -> Iterator[tuple[int, int, bytes, list[bytes], list[bytes]]]:
    """(first row, rows, normalised bytes, ...) as (row, length, text, digests, bodies) for every document."""
    for lo, hi, data, offsets in tv.slices(column):
        data, offsets = _normalise(data, offsets)
        ends = _cuts(data, offsets, mean_bytes)
        whole, bounds = data.tobytes(), np.searchsorted(ends, offsets, "right")
        ends = ends.tolist()
        for k in range(hi - lo):
            first, last = int(offsets[k]), int(offsets[k + 1])
            bodies, at = [], first
            for end in ends[bounds[k] : bounds[k + 1]]:
                bodies.append(whole[at:end])
                at = end
            yield lo + k, last - first, whole[first:last], [hashlib.blake2b(b, digest_size=digest_bytes).digest() for b in bodies], bodies


def _recipes(mean_bytes: int, digest_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sha, recipe = [], []
            for _, _, text, digests, _ in _chunks(batch.column(2), mean_bytes, digest_bytes):
                sha.append(hashlib.sha256(text).hexdigest())
                recipe.append(digests)
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array(sha, pa.string()), pa.array(recipe, pa.list_(pa.binary()))], ["_row", "doc_id", "text_sha256", "recipe"])

    return run


def _bodies(mean_bytes: int, digest_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen: dict[bytes, set[bytes]] = {}
            for _, _, _, digests, bodies in _chunks(batch.column(2), mean_bytes, digest_bytes):
                for digest, body in zip(digests, bodies, strict=True):
                    seen.setdefault(digest, set()).add(body)
            pairs = [(d, b) for d, bs in seen.items() for b in bs]
            for lo in range(0, len(pairs), 4096):
                part = pairs[lo : lo + 4096]
                yield pa.record_batch([pa.array([p[0] for p in part], pa.binary()), pa.array([p[1] for p in part], pa.binary())], ["digest", "body"])

    return run


def _collided(mean_bytes: int, digest_bytes: int, shared: set[bytes]):
    """Recipes again, with the body's own bytes for each chunk whose digest stands for several bodies."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sha, recipe = [], []
            for _, _, text, digests, bodies in _chunks(batch.column(2), mean_bytes, digest_bytes):
                sha.append(hashlib.sha256(text).hexdigest())
                recipe.append([d + b if d in shared else d for d, b in zip(digests, bodies, strict=True)])
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array(sha, pa.string()), pa.array(recipe, pa.list_(pa.binary()))], ["_row", "doc_id", "text_sha256", "recipe"])

    return run


def exact_groups(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", mean_bytes: int = 1024, digest_bytes: int = 16, most_collided: int = 100_000) -> DataFrame:
    """Groups of equal texts, one row per document: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical after each run of white space (space, tab to carriage return) became one
    space. Of a group the row with the smallest id stays; of repeated rows with that id exactly one; ids that
    are null come last. Null texts are empty, empty texts equal one another, and an empty table gives an empty
    result. Other columns are not looked at. Long texts are cut like all others.

    The identifier of a chunk is its digest where that stands for one body only. A digest that several bodies
    share is extended by the body itself (with 128 bits there is none; a shorter digest may be given, and more
    than most_collided shared digests then raise an error instead of filling the driver).
    """
    rows = documents.select(F.monotonically_increasing_id().alias("_row"), F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return _groups(rows, mean_bytes, digest_bytes, most_collided).drop("_row")


def _groups(rows: DataFrame, mean_bytes: int = 1024, digest_bytes: int = 16, most_collided: int = 100_000) -> DataFrame:
    """exact_groups() of (_row, doc_id, text); the numbers of rows are read from the written recipes alone."""
    schema = T.StructType([T.StructField("_row", T.LongType()), T.StructField("doc_id", T.LongType()), T.StructField("text_sha256", T.StringType()), T.StructField("recipe", T.ArrayType(T.BinaryType()))])
    verified = rows.mapInArrow(_bodies(mean_bytes, digest_bytes), "digest binary, body binary").groupBy("digest", "body").agg(F.count("*").alias("n"))
    shared = [r[0] for r in verified.groupBy("digest").agg(F.count("*").alias("bodies")).filter("bodies > 1").select("digest").limit(most_collided + 1).collect()]
    if len(shared) > most_collided:
        raise ValueError(f"more than {most_collided} digests of {digest_bytes} bytes stand for several chunks; use longer ones")
    make = _collided(mean_bytes, digest_bytes, {bytes(x) for x in shared}) if shared else _recipes(mean_bytes, digest_bytes)
    recipes = materialize(rows.mapInArrow(make, schema), "recipes")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), F.col("doc_id").alias("id"), F.col("_row").alias("row")))
    # Only groups of several rows are joined back, off a written table, so that Spark can split the rows of a hot one.
    groups = materialize(recipes.groupBy("recipe").agg(first.alias("first"), F.count("*").alias("n")).filter("n > 1"), "groups")
    alone = F.col("n").isNull()
    return recipes.join(groups, "recipe", "left").select(
        "doc_id",
        F.when(alone, F.col("doc_id")).otherwise(F.col("first.id")).alias("keep_id"),
        F.coalesce("n", F.lit(1).cast("long")).alias("group_size"),
        (alone | (F.col("_row") == F.col("first.row"))).alias("kept"),
        "text_sha256",
        "_row",
    )


def drop_exact_copies(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents, with all their columns, that exact_groups() keeps.

    The numbers of dropped rows join the documents; the documents themselves are not shuffled by text.
    """
    numbered, row = with_row_numbers(documents)
    groups = _groups(numbered.select(F.col(row).alias("_row"), F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")))
    gone = groups.filter(~F.col("kept")).select(F.col("_row").alias(row))
    return numbered.join(gone, row, "left_anti").drop(row)


def op4_exact_dedup(spark, sf_dir: str) -> DataFrame:
    """All documents with the row that stays for each; see exact_groups()."""
    return exact_groups(spark.read.parquet(f"{sf_dir}/documents.parquet"))


ORACLE_OP4 = r"""
WITH n AS (
  SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents)
SELECT doc_id,
       min(doc_id) OVER (PARTITION BY t) AS keep_id,
       count(*) OVER (PARTITION BY t) AS group_size,
       doc_id = min(doc_id) OVER (PARTITION BY t) AS kept,
       sha256(t) AS text_sha256
FROM n
"""
