"""Set similarity join of word n-grams by chosen paths.

Sets are embedded by min-hashing. A run samples coordinates at each node of a tree and splits the sets by their
values there; small buckets are compared by brute force, larger ones are split further. Runs are repeated until the
recall that was asked for. Links are then counted exactly, on the sets themselves, between blocks of bounded size.
"""

from __future__ import annotations

import functools
import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textvec as tv
from .graph import connected_components
from .scratch import discard, join_hot, materialize, with_row_numbers

COORDINATES = 64
#: Children, on average, in which a pair at the threshold goes on from a node below the root.
GROWTH = 1.3
_rng = np.random.default_rng(20240607)
_A = _rng.integers(0, 1 << 63, COORDINATES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_B = _rng.integers(0, 1 << 63, COORDINATES, dtype=np.uint64)
_CHOICE = _rng.integers(0, 1 << 63, COORDINATES, dtype=np.uint64)


def shingle_sets(column: pa.Array, n: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, last row + 1, shingle hashes, bounds): every row's distinct shingles, sorted, end to end.

    A text of fewer than n words has one shingle of all its words, a text without words has none.
    """
    for lo, hi, data, offsets in tv.slices(column):
        _, _, doc, h = tv.words(data, offsets)
        at, grams = tv.ngrams(h, doc, n)
        of, counts = doc[at], np.bincount(doc, minlength=hi - lo)
        short = np.flatnonzero((counts > 0) & (counts < n))
        if len(short):
            first = np.searchsorted(doc, short)
            whole = np.array([int(tv.mix(np.add.reduce(h[f : f + c] * tv.powers(n + 1)[0][1 : c + 1], keepdims=True))[0]) for f, c in zip(first, counts[short], strict=True)], np.uint64)
            of, grams = np.concatenate((of, short)), np.concatenate((grams, whole))
        order = np.lexsort((grams, of))
        of, grams = of[order], grams[order]
        if len(of):
            new = np.ones(len(of), bool)
            new[1:] = (of[1:] != of[:-1]) | (grams[1:] != grams[:-1])
            of, grams = of[new], grams[new]
        yield lo, hi, grams, np.searchsorted(of, np.arange(hi - lo + 1))


def _signatures(grams: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """The min-hash values, 32 bits each, of every set that isn't empty; zeros for empty ones."""
    full = np.flatnonzero(np.diff(bounds))
    out = np.zeros((len(bounds) - 1, COORDINATES), np.uint32)
    if len(full):
        starts = bounds[:-1][full]
        for k in range(COORDINATES):
            out[full, k] = np.minimum.reduceat(grams * _A[k] + _B[k], starts) >> np.uint64(32)
    return out


def _embed(n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text = batch.column(2).cast(pa.large_binary()).fill_null(b"")
            for lo, hi, grams, bounds in shingle_sets(text, n):
                signature = _signatures(grams, bounds)
                sketch = signature.astype(np.uint8)
                short = (grams >> np.uint64(32)).astype(np.uint32)
                b = bounds.tolist()
                rows = range(hi - lo)
                yield pa.record_batch(
                    [
                        batch.column(0).slice(lo, hi - lo),
                        batch.column(1).slice(lo, hi - lo),
                        pa.array(np.diff(bounds), pa.int32()),
                        pa.array([hashlib.blake2b(grams[b[k] : b[k + 1]], digest_size=16).digest() for k in rows], pa.binary()),
                        pa.array([hashlib.blake2b(text[lo + k].as_buffer(), digest_size=16).digest() for k in rows], pa.binary()),
                        pa.array([signature[k].tobytes() for k in rows], pa.binary()),
                        pa.array([sketch[k].tobytes() for k in rows], pa.binary()),
                        pa.array([short[b[k] : b[k + 1]].tobytes() for k in rows], pa.binary()),
                    ],
                    ["row", "doc_id", "n_shingles", "set_hash", "text_hash", "signature", "sketch", "shingles"],
                )

    return run


def _matrix(column: pa.Array, dtype) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype).reshape(len(column), -1)


def _split(paths: np.ndarray, signature: np.ndarray, share: float) -> tuple[np.ndarray, np.ndarray]:
    """(row, path of the child) for each coordinate that a node samples; which ones depends on its path alone."""
    chosen = tv.mix(paths[:, None] ^ _CHOICE[None, :]) < np.uint64(int(share * 2**64))
    row, k = np.nonzero(chosen)
    child = tv.mix(paths[row] * np.uint64(0x9E3779B97F4A7C15) + _A[k] + signature[row, k].astype(np.uint64))
    return row, child


def _first_level(share: float, runs: int):
    """Children of the roots of all runs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rep, signature = batch.column(0).to_numpy(), _matrix(batch.column(1), np.uint32)
            for k in range(runs if len(rep) else 0):
                root = tv.mix(np.array([k + 1], np.uint64) * np.uint64(0xD1342543DE82EF95))
                row, child = _split(np.repeat(root, len(rep)), signature, share)
                yield pa.record_batch([pa.array(child.view(np.int64)), pa.array(rep[row])], ["path", "rep"])

    return run


def _near(least: float):
    """The pairs whose sketches agree in at least the given share of the coordinates."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                near = (_matrix(batch.column(2), np.uint8) == _matrix(batch.column(3), np.uint8)).mean(axis=1) >= least
                yield pa.record_batch([batch.column(k).filter(pa.array(near)) for k in (0, 1)], ["a", "b"])

    return run


def _next_level(share: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            path, rep = (batch.column(k).to_numpy() for k in range(2))
            row, child = _split(path.view(np.uint64), _matrix(batch.column(2), np.uint32), share)
            yield pa.record_batch([pa.array(child.view(np.int64)), pa.array(rep[row])], ["path", "rep"])

    return run


def _local_components(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    label = np.arange(n)
    while True:
        m = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, a, m)
        np.minimum.at(new, b, m)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def _against_others(least: float, few: int = 8, chunk: int = 64):
    """Links between labels: in each run of equal (path, part), the rows outside the bucket's largest label against all rows."""

    def links(group, label, other, sketch):
        found = []
        start = np.flatnonzero(np.concatenate(([True], group[1:] != group[:-1])))
        size = np.diff(np.append(start, len(group)))
        small = np.repeat(size <= few, size)
        for k in range(1, few):
            at = np.flatnonzero(small[k:] & (group[k:] == group[:-k]) & (other[k:] | other[:-k]) & (label[k:] != label[:-k]))
            near = at[(sketch[at] == sketch[at + k]).mean(axis=1) >= least]
            found.append(np.stack((label[near], label[near + k]), axis=1))
        for s, n in zip(start[size > few].tolist(), size[size > few].tolist(), strict=True):
            rows, labels = sketch[s : s + n], label[s : s + n]
            mine = np.flatnonzero(other[s : s + n])
            for lo in range(0, len(mine), chunk):
                part = mine[lo : lo + chunk]
                a, b = np.nonzero(((rows[part][:, None, :] == rows[None, :, :]).mean(axis=2) >= least) & (labels[part][:, None] != labels[None, :]))
                found.append(np.unique(np.stack((labels[part[a]], labels[b]), axis=1), axis=0))
        # What hangs together is linked to its least label once, not pair by pair.
        labels, place = np.unique(np.concatenate(found), return_inverse=True)
        place = place.reshape(-1, 2)
        root = _local_components(len(labels), place[:, 0], place[:, 1])
        at = np.flatnonzero(root != np.arange(len(labels)))
        return pa.record_batch([pa.array(labels[at]), pa.array(labels[root[at]])], ["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            if not batch.num_rows:
                continue
            group = tv.mix(batch.column(0).to_numpy().view(np.uint64) + batch.column(1).to_numpy().astype(np.uint64))
            now = [group, batch.column(2).to_numpy(), batch.column(3).to_numpy(zero_copy_only=False), _matrix(batch.column(4), np.uint8)]
            if held is not None:
                now = [np.concatenate(x) for x in zip(held, now, strict=True)]
            others = np.flatnonzero(now[0] != now[0][-1])
            last = int(others[-1]) + 1 if len(others) else 0
            held = [x[last:] for x in now]
            if last:
                yield links(*(x[:last] for x in now))
        if held is not None:
            yield links(*held)

    return run


def _overlaps(sets: list[np.ndarray], columns: int = 1 << 15) -> np.ndarray:
    """Sizes of all pairwise intersections."""
    n = len(sets)
    if n <= 4:
        out = np.diag([len(s) for s in sets])
        for i in range(n):
            for j in range(i):
                out[i, j] = out[j, i] = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
        return out
    of = np.repeat(np.arange(n), [len(s) for s in sets])
    values = np.concatenate(sets)
    if not len(values):
        return np.zeros((n, n))
    order = np.argsort(values, kind="stable")
    of, values = of[order], values[order]
    column = np.cumsum(np.concatenate(([0], values[1:] != values[:-1])))
    shared = np.bincount(column)[column] > 1  # the others are in no intersection
    of, column = of[shared], column[shared]
    out = np.zeros((n, n))
    if len(column):
        column = np.cumsum(np.concatenate(([0], column[1:] != column[:-1])))
        for lo in range(0, int(column[-1]) + 1, columns):
            p, q = np.searchsorted(column, (lo, lo + columns))
            m = np.zeros((n, min(columns, int(column[q - 1]) + 1 - lo)), np.float32)
            m[of[p:q], column[p:q] - lo] = 1
            out += m @ m.T
    return out.astype(np.int64)


def _count_links(threshold: float):
    """Of every group (component, shingle, block, block): each set's number of linked texts, and the least set that it hangs with.

    shingle is -1 where all sets of the blocks are compared; else a pair counts in the group of its least common shingle.
    """

    def group(shingle, first, second, block, rep, texts, sets):
        sizes = np.array([len(s) for s in sets])
        common = _overlaps(sets)
        linked = common >= threshold * (sizes[:, None] + sizes[None, :] - common) - 1e-9
        np.fill_diagonal(linked, False)
        if first != second:
            linked &= block[:, None] != block[None, :]
        if shingle >= 0 and linked.any():
            linked &= _overlaps([s[: np.searchsorted(s, shingle)] for s in sets]) == 0
        a, b = np.nonzero(linked)
        if not len(a):
            return None
        order = np.argsort(rep)
        place = np.empty(len(rep), np.int64)
        place[order] = np.arange(len(rep))
        label = order[_local_components(len(rep), place[a], place[b])[place]]
        at = np.flatnonzero(linked.any(axis=1))
        return pa.record_batch([pa.array(rep[at]), pa.array((linked @ texts)[at], pa.int64()), pa.array(rep[label[at]])], ["rep", "links", "root"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, rows = None, []
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if row[:4] != key:
                    if len(rows) > 1 and (out := finish(key, rows)) is not None:
                        yield out
                    key, rows = row[:4], []
                rows.append(row[4:])
        if len(rows) > 1 and (out := finish(key, rows)) is not None:
            yield out

    def finish(key, rows):
        block, rep, texts, sets = zip(*rows, strict=True)
        return group(*key[1:], np.array(block), np.array(rep), np.array(texts), [np.frombuffer(s, np.uint32) for s in sets])

    return run


def _least_shingles(threshold: float):
    """The shingles of which two linked sets share one: a set's smallest ones, as many as may be missing from the other and one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [np.frombuffer(s, np.uint32) for s in batch.column(2).to_pylist()]
            sets = [np.unique(s[: len(s) - math.ceil(threshold * len(s) - 1e-9) + 1]) for s in sets]
            of = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
            if len(of):
                yield pa.record_batch([batch.column(0).take(pa.array(of)), batch.column(1).take(pa.array(of)), pa.array(np.concatenate(sets).astype(np.int64))], ["label", "rep", "shingle"])

    return run


def runs_needed(threshold: float, recall: float, growth: float = GROWTH) -> int:
    """Runs after which a pair at the threshold has met in a last bucket with at least the recall as probability.

    The root of a run samples so many coordinates that a pair at the threshold goes on in one child on average, every other
    node so many that it goes on in `growth` ones. The numbers are Poisson distributed, so that the pair's nodes are a
    branching process, which lives on for ever with the probability computed here: the recall holds at any depth.
    """
    dies = 0.0
    for _ in range(1000):
        dies = math.exp(growth * (dies - 1))
    return math.ceil(math.log(1 - recall) / (dies - 1))


def _shares(tagged: DataFrame) -> DataFrame:
    """(path, major, size, others) of the buckets with several labels: the largest label, all rows, and rows of the others."""
    largest = F.max_by("label", F.struct("n", "label"))
    by_label = tagged.groupBy("path", "label").agg(F.count("*").alias("n"))
    return by_label.groupBy("path").agg(largest.alias("major"), F.sum("n").alias("size"), (F.sum("n") - F.max("n")).alias("others")).filter("others > 0")


def candidate_components(sets: DataFrame, threshold: float = 0.8, recall: float = 0.999, bucket: int = 512, levels: int = 40, slack: float = 0.18) -> DataFrame:
    """(rep, label) of all sets that candidate links connect; sets: (rep, signature, sketch), one row per set.

    In every bucket of the first level each set near the bucket's centre is linked to it, once for all buckets that give the
    same pair, and what is linked is contracted to one label. A bucket of a single label is done. One with at most `bucket`
    sets outside its largest label (up to eight times as many further down, where buckets are few) is compared by brute
    force, those sets against all of it. Any other is split further, so that hot groups of near copies leave the tree at once
    and only what may still be linked goes on. `levels` ends the splitting by linking the whole bucket, which adds
    candidates and loses none. slack is three standard deviations of a similarity that COORDINATES values estimate.
    """
    share, least, together = 1 / (threshold * COORDINATES), threshold - slack, 512
    signatures, sketches = sets.select("rep", "signature"), sets.select("rep", "sketch")
    paths = signatures.mapInArrow(_first_level(min(1.0, share), runs_needed(threshold, recall)), "path long, rep long")
    sizes = materialize(paths.groupBy("path").agg(F.count("*").alias("size"), F.min("rep").alias("centre")).filter("size > 1"), "sizes")
    paths = materialize(join_hot(paths, sizes, "path", "rep").select("path", "rep", "centre"), "buckets")
    pairs = materialize(paths.filter("rep <> centre").select("centre", "rep").distinct(), "pairs")
    centres = pairs.groupBy("centre").agg(F.count("*").alias("size")).join(sketches.select(F.col("rep").alias("centre"), F.col("sketch").alias("of_centre")), "centre")
    near = join_hot(pairs.join(sketches, "rep"), materialize(centres, "centres"), "centre", "rep").select("centre", "rep", "sketch", "of_centre")
    labels = materialize(connected_components(near.mapInArrow(_near(least), "a long, b long")), "labels").withColumnsRenamed({"node": "rep", "component": "label"})
    links = []
    for level in range(1, levels + 1):
        tagged = paths.select("path", "rep").join(labels, "rep", "left").withColumn("label", F.coalesce("label", "rep"))
        left = materialize(join_hot(tagged, materialize(_shares(tagged), "shares"), "path", "rep"), "left")
        parts = F.ceil(F.col("size") / together)
        own, all_parts = F.array(F.pmod(F.xxhash64("rep"), parts)), F.sequence(F.lit(0).cast("long"), parts - 1)
        other = F.col("label") != F.col("major")
        most = bucket << min(level - 1, 3)  # the deeper, the fewer there are
        end = left.filter(F.col("others") <= most).select("path", F.explode(F.when(other, all_parts).otherwise(own)).alias("part"), "label", other.alias("other"), "rep").join(sketches, "rep")
        end = end.select("path", "part", "label", "other", "sketch").repartition("path", "part").sortWithinPartitions("path", "part")
        links.append(materialize(end.mapInArrow(_against_others(least), "a long, b long"), "links"))
        on = left.filter(F.col("others") > most)
        if on.isEmpty():
            break
        if level == levels:
            links.append(on.filter("label <> major").select(F.col("label").alias("a"), F.col("major").alias("b")).distinct())
            break
        # Written, as it is read twice: for the shares of labels and for the rows themselves.
        paths = materialize(on.select("path", "rep").join(signatures, "rep").select("path", "rep", "signature").mapInArrow(_next_level(min(1.0, GROWTH * share)), "path long, rep long"), "children")
    discard(sizes, pairs)
    joined = connected_components(functools.reduce(DataFrame.unionByName, links)).select("node", F.col("component").alias("_to"))
    joined = materialize(joined, "joined")
    moved = labels.join(joined, F.col("label") == F.col("node"), "left").select("rep", F.coalesce("_to", "label").alias("label"))
    new = joined.join(labels.select(F.col("rep").alias("node")), "node", "left_anti").select(F.col("node").alias("rep"), F.col("_to").alias("label"))
    return materialize(moved.unionByName(new), "labels")


def _in_blocks(laid: DataFrame, sets: DataFrame, few: bool) -> DataFrame:
    """(label, shingle, first, second, block, rep, texts, shingles): every set in each pair of blocks that its own is in."""
    number = lambda cut, k: F.shiftleft(cut, 40) + k
    blocks = lambda step, n: F.when(F.col(n) > 0, F.transform(F.sequence(F.lit(0).cast("long"), F.col(n) - 1), lambda k: number(F.col("cut") + step, k))).otherwise(F.array().cast("array<bigint>"))
    own = number(F.col("cut"), F.pmod(F.xxhash64("rep"), F.col("same")))
    keyed = sets.join(F.broadcast(laid) if few else laid, "rep").withColumn("own", own)
    keyed = keyed.withColumn("other", F.explode(F.concat(blocks(-1, "below"), blocks(0, "same"), blocks(1, "above"))))
    return keyed.select("label", F.lit(-1).cast("long").alias("shingle"), F.least("own", "other").alias("first"), F.greatest("own", "other").alias("second"), F.col("own").alias("block"), "rep", "texts", "shingles")


def _at_shared(shared: DataFrame, sets: DataFrame, block: int) -> DataFrame:
    """The same columns: every set at each shingle that it shares, in pairs of blocks of about `block` sets."""
    parts = F.ceil(F.col("size") / block)
    keyed = shared.withColumn("own", F.pmod(F.xxhash64("rep"), parts)).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), parts - 1)))
    keyed = keyed.select("label", "shingle", F.least("own", "other").alias("first"), F.greatest("own", "other").alias("second"), F.col("own").alias("block"), "rep", "texts")
    return keyed.join(sets, "rep").select("label", "shingle", "first", "second", "block", "rep", "texts", "shingles")


def _counted_links(sets: DataFrame, members: DataFrame, threshold: float, block: int, broadcast_rows: int = 1_000_000) -> DataFrame:
    """(rep, links, root) for the sets of each component, compared exactly between blocks of about `block` sets.

    sets: (rep, shingles); members: (rep, label, n_shingles, texts). Linked sets differ in size by less than the threshold
    allows, so a component is cut by size, and blocks meet only those of their own and the neighbouring sizes. That suits
    components of near copies, most pairs of which are linked. In a component of more than four blocks whose sets would be
    copied less often so, because few share a shingle, sets meet instead at those of their smallest shingles that others
    share; frequent ones are cut into blocks as well. Up to broadcast_rows members, of about 100 bytes each, are broadcast, so
    that the sets of all others aren't shuffled; more of them are joined.
    """
    size_class = F.floor(F.log("n_shingles") / math.log(1 / (threshold - 1e-9))).cast("long")
    members = materialize(members.withColumn("cut", size_class), "members")
    cuts = members.groupBy("label", "cut").agg(F.count("*").alias("n"))
    layout = cuts.groupBy("label").agg(F.sum("n").alias("size"), F.map_from_entries(F.collect_list(F.struct("cut", F.ceil(F.col("n") / block).cast("long")))).alias("blocks"))
    at = lambda step: F.coalesce(F.try_element_at("blocks", F.col("cut") + step), F.lit(0).cast("long"))
    laid = join_hot(members, materialize(layout, "layout"), "label", "rep")
    laid = materialize(laid.select("rep", "label", "texts", "cut", at(-1).alias("below"), at(0).alias("same"), at(1).alias("above"), F.col("size").alias("members")), "laid")
    few = laid.count() <= broadcast_rows
    large = laid.filter(F.col("members") > 4 * block)
    if large.isEmpty():
        met = _in_blocks(laid, sets, few)
    else:
        known = sets.join(F.broadcast(large.select("rep", "label")) if few else large.select("rep", "label"), "rep")
        least = materialize(known.select("label", "rep", "shingles").mapInArrow(_least_shingles(threshold), "label long, rep long, shingle long").withColumn("bucket", F.struct("label", "shingle")), "least")
        buckets = materialize(least.groupBy("bucket").agg(F.count("*").alias("size")).filter("size > 1"), "shared")
        copies = buckets.groupBy("bucket.label").agg(F.sum(F.col("size") * F.ceil(F.col("size") / block)).alias("copies"))
        in_blocks = large.groupBy("label").agg(F.sum(F.col("below") + F.col("same") + F.col("above")).alias("copies_in_blocks"), F.count("*").alias("size"))
        # Components whose sets share no least shingle have no links at all: they have no buckets and no copies.
        sparse = materialize(in_blocks.join(copies, "label", "left").filter("coalesce(copies, 0) < copies_in_blocks").select("label", "size"), "sparse")
        if sparse.isEmpty():
            met = _in_blocks(laid, sets, few)
        else:
            apart = materialize(join_hot(large.select("rep", "label", "texts"), sparse, "label", "rep").select("rep", "label", "texts"), "apart")
            shared = join_hot(least.select("rep", "bucket"), buckets, "bucket", "rep").select("rep", "bucket.shingle", "size").join(apart, "rep")
            theirs = sets.join(F.broadcast(apart.select("rep")) if few else apart.select("rep"), "rep")  # so that no others are shuffled
            met = _in_blocks(laid.join(apart.select("rep"), "rep", "left_anti"), sets, few).unionByName(_at_shared(shared, theirs, block))
    met = met.repartition("label", "shingle", "first", "second").sortWithinPartitions("label", "shingle", "first", "second")
    return met.mapInArrow(_count_links(threshold), "rep long, links long, root long")


def jaccard_classes(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = 5, threshold: float = 0.8, recall: float = 0.999, bucket: int = 512, levels: int = 40, block: int = 128) -> DataFrame:
    """One row per document: doc_id, class_id, n_links.

    Two texts are linked when the Jaccard similarity of their sets of n-word shingles is at least the threshold;
    words are runs of letters, digits and characters beyond ASCII, A-Z in lower case. class_id is the least id in the
    document's class: what is connected by links. n_links counts the different texts that the document's text is
    linked to, each once however many copies it has. Texts with equal sets are linked. A text of fewer than n words
    has one shingle of all its words; one without words (null, empty) has no links and is a class of its own. Rows that
    repeat an id count as documents of their own. An empty table gives an empty result; other columns aren't read.

    Every text of each component of candidate links is compared with every other one in it that its size allows and that
    shares a shingle with it, so that a link is lost only where its ends fall into different components. Sets are compared as 32-bit hashes: two of a
    thousand shingles differ by one from the truth once in about four thousand pairs.
    """
    numbered = documents.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return _classes(numbered, n, threshold, recall, bucket, levels, block).select("doc_id", "class_id", "n_links")


def _classes(numbered: DataFrame, n: int = 5, threshold: float = 0.8, recall: float = 0.999, bucket: int = 512, levels: int = 40, block: int = 128) -> DataFrame:
    """(row, doc_id, class_id, n_links, worded) of (row, doc_id, text); each row's number is written once and read from there."""
    embedded = materialize(numbered.mapInArrow(_embed(n), "row long, doc_id long, n_shingles int, set_hash binary, text_hash binary, signature binary, sketch binary, shingles binary"), "embedded")
    same = F.first("n_shingles").alias("n_shingles")
    by_text = embedded.filter("n_shingles > 0").groupBy("set_hash", "signature", "sketch", "text_hash").agg(F.min("row").alias("rep"), F.min("doc_id").alias("least_id"), F.count("*").alias("rows"), same)
    reps = by_text.groupBy("set_hash", "signature", "sketch").agg(F.min("rep").alias("rep"), F.min("least_id").alias("least_id"), F.count("*").alias("texts"), F.sum("rows").alias("rows"), same)
    reps = materialize(reps, "sets")

    labels = candidate_components(reps, threshold, recall, bucket, levels)
    members = labels.join(reps.select("rep", "n_shingles", "texts"), "rep")
    links = materialize(_counted_links(embedded.select(F.col("row").alias("rep"), "shingles"), members, threshold, block), "links")
    classes = connected_components(links, "rep", "root").withColumnRenamed("node", "rep")
    degree = links.groupBy("rep").agg(F.sum("links").alias("links"))
    described = materialize(reps.select("set_hash", "rep", "least_id", "texts", "rows").join(degree, "rep", "left").join(classes, "rep", "left").withColumn("component", F.coalesce("component", "rep")), "described")
    least = materialize(described.groupBy("component").agg(F.min("least_id").alias("class_id"), F.count("*").alias("size")), "least")
    described = join_hot(described, least, "component", "rep").select("set_hash", "class_id", (F.coalesce("links", F.lit(0)) + F.col("texts") - 1).alias("n_links"), F.col("rows").alias("size"))
    placed = embedded.select("row", "doc_id", F.when(F.col("n_shingles") > 0, F.col("set_hash")).alias("set_hash"))
    alone = placed.filter("set_hash is null").select("row", "doc_id", F.col("doc_id").alias("class_id"), F.lit(0).cast("long").alias("n_links"), F.lit(False).alias("worded"))
    worded = join_hot(placed.filter("set_hash is not null"), materialize(described, "classes"), "set_hash", "row").select("row", "doc_id", "class_id", "n_links", F.lit(True).alias("worded"))
    return worded.unionByName(alone)


def drop_near_copies(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The documents, with all their columns, without those in whose class an earlier one stays.

    The row with the least id of a class stays; of repeated rows with that id exactly one. Texts without words all stay, and
    so do rows whose class has no ids.
    """
    rows, row = with_row_numbers(documents)
    judged = _classes(rows.select(F.col(row).alias("row"), F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")), **options)
    judged = materialize(judged.filter("worded and class_id is not null"), "judged")
    stay = judged.groupBy("class_id").agg(F.min(F.when(F.col("doc_id") == F.col("class_id"), F.col("row"))).alias("stay"), F.count("*").alias("size"))
    gone = join_hot(judged, materialize(stay.filter("size > 1"), "stay"), "class_id", "row").filter("row <> stay").select(F.col("row").alias(row))
    return rows.join(gone, row, "left_anti").drop(row)


def op9_ngram_jaccard_join(spark, sf_dir: str) -> DataFrame:
    """Classes and numbers of links of all documents, at five words and a similarity of 0.8."""
    return jaccard_classes(spark.read.parquet(f"{sf_dir}/documents.parquet"))


#: All pairs of texts that share a shingle, counted: what the join finds by chosen paths.
ORACLE_OP9 = r"""
WITH RECURSIVE t AS (SELECT text, min(doc_id) AS least, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z0-9\x{80}-\x{10FFFF}]+') AS w FROM documents WHERE text IS NOT NULL GROUP BY text),
u AS (SELECT row_number() OVER (ORDER BY least, text) AS k, text, least, w FROM t WHERE len(w) > 0),
s AS (SELECT DISTINCT k, CASE WHEN len(w) < 5 THEN array_to_string(w, ' ') ELSE array_to_string(w[i:i + 4], ' ') END AS g FROM u, LATERAL (SELECT unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i)),
z AS (SELECT k, count(*) AS n FROM s GROUP BY k),
c AS (SELECT a.k AS a, b.k AS b, count(*) AS common FROM s a JOIN s b ON a.g = b.g AND a.k <> b.k GROUP BY 1, 2),
l AS (SELECT a, b FROM c JOIN z x ON x.k = a JOIN z y ON y.k = b WHERE common >= 0.8 * (x.n + y.n - common) - 1e-9),
reach AS (SELECT k, k AS m FROM u UNION SELECT l.b, reach.m FROM reach JOIN l ON l.a = reach.k),
cls AS (SELECT reach.k, min(u.least) AS class_id FROM reach JOIN u ON u.k = reach.m GROUP BY 1),
deg AS (SELECT a AS k, count(*) AS n FROM l GROUP BY 1)
SELECT doc_id, coalesce(class_id, doc_id) AS class_id, coalesce(deg.n, 0) AS n_links FROM documents LEFT JOIN u USING (text) LEFT JOIN cls ON cls.k = u.k LEFT JOIN deg ON deg.k = u.k
"""
