"""Benchmark decontamination by greedy string tiling.

Shared runs of words seed the search, the longest common runs are marked first and never overlap, and a document is
contaminated where the marked runs cover enough of a benchmark item, in whatever order they stand.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import textvec as tv
from .scratch import materialize, with_row_numbers

SHORTEST_MATCH = 5
COVERAGE = 0.5
_FILTER_BITS = 20


class Items:
    """Benchmark items of one block, by the hashes of their runs of `shortest` words."""

    def __init__(self, rows: list[tuple[int, str]], shortest: int):
        self.shortest = shortest
        self.ids = [r[0] for r in rows]
        text = pa.array([r[1] for r in rows], pa.large_string())
        self.tokens, seeds, item = [np.zeros(0, np.uint64)] * len(rows), [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
        for lo, hi, data, offsets in tv.slices(text):
            _, _, doc, h = tv.words(data, offsets)
            bounds = np.searchsorted(doc, np.arange(hi - lo + 1))
            for k in range(hi - lo):
                self.tokens[lo + k] = h[bounds[k] : bounds[k + 1]]
            at, grams = tv.ngrams(h, doc, shortest)
            seeds.append(grams)
            item.append(doc[at] + lo)
        self.sizes = np.array([len(t) for t in self.tokens])
        seeds, item = np.concatenate(seeds), np.concatenate(item)
        order = np.argsort(seeds, kind="stable")
        seeds, item = seeds[order], item[order]
        #: Runs of one seed in one item, with the number of places that it has there.
        run = np.flatnonzero(np.concatenate((np.ones(len(seeds[:1]), bool), (seeds[1:] != seeds[:-1]) | (item[1:] != item[:-1]))))
        self.run_seed, self.run_item, self.run_places = seeds[run], item[run], np.diff(np.append(run, len(seeds)))
        self.filter = np.zeros(1 << _FILTER_BITS, bool)
        self.filter[self.run_seed >> np.uint64(64 - _FILTER_BITS)] = True

    def found(self, grams: np.ndarray) -> np.ndarray:
        """Indexes of the grams that are seeds."""
        maybe = np.flatnonzero(self.filter[grams >> np.uint64(64 - _FILTER_BITS)])
        if not len(maybe) or not len(self.run_seed):
            return maybe[:0]
        wanted = grams[maybe]
        at = np.minimum(np.searchsorted(self.run_seed, wanted), len(self.run_seed) - 1)
        return maybe[self.run_seed[at] == wanted]


def _ranges(lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(which range, member) of all members of the ranges lo[k]:hi[k]."""
    n = hi - lo
    which = np.repeat(np.arange(len(n)), n)
    return which, np.arange(len(which)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(lo, n)


def _edges(text: np.ndarray, item: np.ndarray, seeds: tuple[np.ndarray, ...], shortest: int, step: int) -> np.ndarray:
    """(diagonal, place in the text) of the seeds where a match begins (step -1) or ends (step `shortest`), in order.

    There the words beside the seeds differ, or a side has none. For each place of the text, the item's places of the same
    seed, ordered by the word beside them, are listed before and behind those with the text's word.
    """
    text_at, text_seed, item_at, item_seed = seeds
    vocabulary = np.unique(item)
    beside = item_at + step
    inner = (beside >= 0) & (beside < len(item))
    # Numbered from 1 up; 0 is no word, and a word that the item lacks is far above them.
    word = np.where(inner, np.searchsorted(vocabulary, item[np.where(inner, beside, 0)]) + 1, 0)
    width = len(vocabulary) + 2
    key = item_seed * width + word
    order = np.argsort(key, kind="stable")
    key, places = key[order], item_at[order]
    beside = text_at + step
    inner = (beside >= 0) & (beside < len(text))
    wanted = text[np.where(inner, beside, 0)]
    at = np.minimum(np.searchsorted(vocabulary, wanted), len(vocabulary) - 1)
    word = np.where(inner & (vocabulary[at] == wanted), at + 1, width - 1)
    first, past = np.searchsorted(key, text_seed * width), np.searchsorted(key, (text_seed + 1) * width)
    same, behind = np.searchsorted(key, text_seed * width + word), np.searchsorted(key, text_seed * width + word, "right")
    found = [np.stack((text_at[k], places[m])) for k, m in (_ranges(first, same), _ranges(behind, past))]
    i, j = np.concatenate(found, axis=1)
    equal = np.ones(len(i), bool)
    for k in range(shortest):
        equal &= text[i + k] == item[j + k]
    i, j = i[equal], j[equal]
    order = np.lexsort((i, i - j))
    return np.stack((i[order] - j[order], i[order]))


def matches(text: np.ndarray, item: np.ndarray, seeds: tuple[np.ndarray, ...], shortest: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(place in the text, place in the item, length) of all maximal matches of at least `shortest` words.

    seeds: places in the text and their seeds' numbers, places in the item and theirs; equal numbers are equal Karp-Rabin
    hashes of `shortest` words, and the words' own hashes confirm them. Only the ends of matches are listed, so that the
    work grows with the places and the matches: a phrase that repeats on both sides has a match a diagonal.
    """
    begin, end = _edges(text, item, seeds, shortest, -1), _edges(text, item, seeds, shortest, shortest)
    return begin[1], begin[1] - begin[0], end[1] - begin[1] + shortest


def tile(text: np.ndarray, item: np.ndarray, seeds: tuple[np.ndarray, ...], shortest: int) -> list[tuple[int, int, int]]:
    """Greedy tiles (place in the text, place in the item, length), each word in one tile at most; seeds as in matches().

    The longest match is marked first, of equal ones the earliest; a match that marked words cut is put back with what is
    left of it, until no run of `shortest` words of the item is free.
    """
    i, j, n = matches(text, item, seeds, shortest)
    heap = list(zip((-n).tolist(), i.tolist(), j.tolist(), strict=True))
    heapq.heapify(heap)
    in_text, in_item, tiles = np.zeros(len(text), bool), np.zeros(len(item), bool), []
    open_runs = np.ones(max(0, len(item) - shortest + 1), bool)
    while heap and open_runs.any():
        n, i, j = heapq.heappop(heap)
        n = -n
        if not open_runs[j : j + n - shortest + 1].any():
            continue
        taken = in_text[i : i + n] | in_item[j : j + n]
        if not taken.any():
            in_text[i : i + n] = in_item[j : j + n] = True
            open_runs[max(0, j - shortest + 1) : j + n] = False
            tiles.append((i, j, n))
            continue
        free = np.flatnonzero(np.diff(np.concatenate(([True], taken, [True])).astype(np.int8)))
        for lo, hi in zip(free[::2].tolist(), free[1::2].tolist(), strict=True):
            if hi - lo >= shortest:
                heapq.heappush(heap, (lo - hi, i + lo, j + lo))
    return sorted(tiles)


def _candidates(grams: np.ndarray, items: Items, coverage: float) -> np.ndarray:
    """Items that may be covered by a text with these seeds: n places in an item cover no more than n runs of `shortest` words."""
    seeds = np.unique(grams)
    first, past = np.searchsorted(items.run_seed, seeds), np.searchsorted(items.run_seed, seeds, "right")
    # The seeds are looked up in portions of about a million runs, however many items share them.
    portion = np.cumsum(past - first) >> 20
    places = np.zeros(len(items.ids))
    for k in np.unique(portion):
        runs = _ranges(first[portion == k], past[portion == k])[1]
        places += np.bincount(items.run_item[runs], items.run_places[runs], len(items.ids))
    return np.flatnonzero((places > 0) & (places * items.shortest >= coverage * items.sizes))


def _tiled(column: pa.Array, items: Items, coverage: float) -> Iterator[tuple[int, int, list[tuple[int, int, int]], int]]:
    """(row, item, tiles, words of the item) where the tiles cover enough."""
    for lo, _, data, offsets in tv.slices(column):
        _, _, doc, h = tv.words(data, offsets)
        at, grams = tv.ngrams(h, doc, items.shortest)
        hits = items.found(grams)
        if not len(hits):
            continue
        at, grams = at[hits], grams[hits]
        found, start = np.unique(doc[at], return_index=True)
        for d, p, q in zip(found.tolist(), start.tolist(), [*start[1:].tolist(), len(at)], strict=True):
            begin, end = np.searchsorted(doc, (d, d + 1))
            for k in _candidates(grams[p:q], items, coverage).tolist():
                words = items.tokens[k]
                item_grams = tv.ngrams(words, np.zeros(len(words)), items.shortest)[1]
                known, number = np.unique(item_grams, return_inverse=True)
                place = np.minimum(np.searchsorted(known, grams[p:q]), len(known) - 1)
                shared = np.flatnonzero(known[place] == grams[p:q])
                tiles = tile(h[begin:end], words, (at[p:q][shared] - begin, place[shared], np.arange(len(words) - items.shortest + 1), number), items.shortest)
                if sum(t[2] for t in tiles) >= coverage * len(words):
                    yield lo + d, k, tiles, len(words)


def _blocks(benchmark: DataFrame, id_col: str, text_col: str, shortest: int, block_bytes: int) -> tuple[int, Iterator[Items]]:
    """Number of blocks and the blocks: the benchmark in about block_bytes of text each, dealt by hash; each fits the driver and every task."""
    rows = benchmark.select(F.col(id_col).cast("long").alias("item_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    size = rows.agg(F.sum(F.octet_length("text") + 64)).first()[0] or 0
    count = max(1, -(-size // block_bytes))
    part = lambda k: rows if count == 1 else rows.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(count)) == k)
    return count, (Items([(r[0], r[1]) for r in part(k).collect()], shortest) for k in range(count))


def contaminated_pairs(
    documents: DataFrame,
    benchmark: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    shortest: int = SHORTEST_MATCH,
    coverage: float = COVERAGE,
    block_bytes: int = 16 << 20,
) -> DataFrame:
    """(doc_id, item_id, coverage, matched_words, item_words, longest, tiles) of every document that contains a benchmark item.

    Words are runs of letters, digits and characters beyond ASCII, A-Z in lower case. coverage is the share of the
    item's words that lie in tiles of at least `shortest` words; pairs below the given one have no row. An item of fewer
    words than that, a null or empty text on either side has no rows. Each row of documents and of the benchmark counts
    for itself, so repeated rows give repeated pairs; columns besides ids and texts are not read. tiles are (text_word,
    item_word, words). The benchmark is broadcast in blocks of block_bytes, with a pass over the documents for each.
    """
    docs = documents.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    schema = "doc_id long, item_id long, coverage double, matched_words int, item_words int, longest int, tiles array<struct<text_word:int,item_word:int,words:int>>"
    found = None
    count, blocks = _blocks(benchmark, item_col, item_text_col, shortest, block_bytes)
    for items in blocks:
        shared = documents.sparkSession.sparkContext.broadcast(items)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            items = shared.value
            kind = pa.list_(pa.struct([("text_word", pa.int32()), ("item_word", pa.int32()), ("words", pa.int32())]))
            for batch in batches:
                rows = list(_tiled(batch.column(1), items, coverage))
                if rows:
                    matched = [sum(t[2] for t in tiles) for _, _, tiles, _ in rows]
                    yield pa.record_batch(
                        [
                            batch.column(0).take(pa.array([r[0] for r in rows])),
                            pa.array([items.ids[r[1]] for r in rows], pa.int64()),
                            pa.array([m / r[3] for m, r in zip(matched, rows, strict=True)], pa.float64()),
                            pa.array(matched, pa.int32()),
                            pa.array([r[3] for r in rows], pa.int32()),
                            pa.array([max(t[2] for t in r[2]) for r in rows], pa.int32()),
                            pa.array([[dict(zip(("text_word", "item_word", "words"), t, strict=True)) for t in r[2]] for r in rows], kind),
                        ],
                        ["doc_id", "item_id", "coverage", "matched_words", "item_words", "longest", "tiles"],
                    )

        part = docs.mapInArrow(run, schema)
        if count > 1:
            part = materialize(part, "pairs")
            shared.destroy()
        found = part if found is None else found.unionByName(part)
    return found


def drop_contaminated(documents: DataFrame, benchmark: DataFrame, text_col: str = "text", shortest: int = SHORTEST_MATCH, coverage: float = COVERAGE, block_bytes: int = 16 << 20) -> DataFrame:
    """The documents, with all their columns, that contain no benchmark item.

    With a benchmark of one block, nothing is shuffled; with more, documents are numbered once and the pairs' rows taken out.
    Null and empty texts stay, and so do all rows where either table lacks any text.
    """
    count, blocks = _blocks(benchmark, "item_id", "text", shortest, block_bytes)
    if count > 1:
        rows, row = with_row_numbers(documents)
        gone = contaminated_pairs(rows, benchmark, row, text_col, shortest=shortest, coverage=coverage, block_bytes=block_bytes)
        return rows.join(gone.select(F.col("doc_id").alias(row)).distinct(), row, "left_anti").drop(row)
    shared = documents.sparkSession.sparkContext.broadcast(next(blocks))
    place, schema = documents.columns.index(text_col), T.StructType([T.StructField(f.name, f.dataType, True) for f in documents.schema.fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            clean = np.ones(batch.num_rows, bool)
            clean[[r[0] for r in _tiled(batch.column(place), shared.value, coverage)]] = False
            yield batch.filter(pa.array(clean))

    return documents.mapInArrow(run, schema)


def op1_benchmark_decontamination(spark, sf_dir: str) -> DataFrame:
    """Every pair of a document and a benchmark item that it contains, over all documents and all items."""
    return contaminated_pairs(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
