"""Language-model scoring with a hashed maximum-entropy model.

The next word is predicted in two softmax steps, its class and then its slot in the class, from hashed n-gram and skip
features of the two words before. What training needs of the corpus are counts of (context, class) and (word before,
slot); these are gathered over all training rows and the weights are fitted to them by distributed gradient steps.
A slot is a frequent word, or a group of rare ones within which the plain frequencies decide.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textvec as tv
from .scratch import materialize

_END = np.uint64(0xE0D0E0D0E0D0E0D1)
_LOG10 = float(np.log(10))


@dataclass(frozen=True)
class Sizes:
    """How fine the model is. Tables of contexts x contexts x classes and contexts x slots must fit every task."""

    heads: int = 960
    tails: int = 64
    classes: int = 32
    contexts: int = 128
    trigrams: int = 4096

    @classmethod
    def of(cls, distinct: int) -> Sizes:
        """Doubled at 100,000 different words, and again at ten million."""
        step = (distinct >= 100_000) + (distinct >= 10_000_000)
        return cls(heads=(1024 << step) - 64, contexts=128 << step, trigrams=4096 << 2 * step)

    @property
    def slots(self) -> int:
        return self.heads + self.tails

    @property
    def own(self) -> int:
        """Words that are contexts of their own; the others share the rest by their shape."""
        return self.contexts // 2 - 1

    @property
    def features(self) -> int:
        return 1 + 2 * self.contexts + self.trigrams


def tokens(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, hash, shape) of the words between white space, A-Z in lower case, and an end after each document.

    The shape of a word is made of its last two bytes; it stands in for words that are too rare to be known.
    """
    s, e, doc, h = tv.non_space(data, offsets)
    low = tv.LOWER[data]
    shape = low[e - 1].astype(np.int64) if len(e) else np.zeros(0, np.int64)
    if len(e):
        shape |= np.where(e - s > 1, low[np.maximum(e - 2, 0)], 0).astype(np.int64) << 8
    n = len(offsets) - 1
    at = np.searchsorted(doc, np.arange(n), "right")
    return np.insert(doc, at, np.arange(n)), np.insert(h, at, _END), np.insert(shape, at, 0)


def _spread(shape: np.ndarray, n: int) -> np.ndarray:
    return (tv.mix(shape.astype(np.uint64) + np.uint64(77)) % np.uint64(n)).astype(np.int64)


@dataclass
class Model:
    """heads: hashes of the most frequent words, most frequent first, with their counts."""

    heads: np.ndarray
    head_counts: np.ndarray
    total: int
    distinct: int
    sizes: Sizes = Sizes()
    head_class: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    tail_total: np.ndarray | None = None
    tail_distinct: np.ndarray | None = None
    log_class: np.ndarray | None = None
    log_slot: np.ndarray | None = None

    def __post_init__(self):
        self.tail_total, self.tail_distinct = np.zeros(self.sizes.tails), np.zeros(self.sizes.tails)
        self.order = np.argsort(self.heads)
        self.sorted_heads = self.heads[self.order]
        # Classes of heads hold about equal shares of their tokens; tails come after, a few slots to a class.
        half = self.sizes.classes // 2
        share = np.cumsum(self.head_counts) / max(1, self.head_counts.sum())
        self.head_class = np.minimum((share - 1e-12) * half, half - 1).astype(np.int64)
        self.slot_class = np.concatenate((self.head_class, np.full(self.sizes.heads - len(self.heads), half - 1), half + np.arange(self.sizes.tails) // (self.sizes.tails // (self.sizes.classes - half)))).astype(np.int64)

    def slots(self, h: np.ndarray, shape: np.ndarray) -> np.ndarray:
        out = self.sizes.heads + _spread(shape, self.sizes.tails)
        if len(self.heads):
            at = np.minimum(np.searchsorted(self.sorted_heads, h), len(self.heads) - 1)
            hit = self.sorted_heads[at] == h
            out[hit] = self.order[at[hit]]
        return out

    def contexts(self, doc: np.ndarray, slot: np.ndarray, shape: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Context buckets of the word before and of the one before that; 0 stands for the start."""
        own = np.where(slot < self.sizes.own, slot + 1, self.sizes.own + 1 + _spread(shape, self.sizes.contexts - self.sizes.own - 1))
        before = np.zeros((2, len(doc)), np.int64)
        for k in (1, 2):
            same = doc[k:] == doc[:-k]
            before[k - 1, k:][same] = own[: len(doc) - k][same]
        return before[0], before[1]


def _pair_features(sizes: Sizes) -> np.ndarray:
    """For each context (two before, one before): its bias, bigram, skip and hashed trigram feature."""
    b2, b1 = np.divmod(np.arange(sizes.contexts**2), sizes.contexts)
    trigram = (tv.mix((b2 * sizes.contexts + b1).astype(np.uint64) + np.uint64(5)) % np.uint64(sizes.trigrams)).astype(np.int64)
    return np.stack((np.zeros_like(b1), 1 + b1, 1 + sizes.contexts + b2, 1 + 2 * sizes.contexts + trigram), axis=1)


def _log_softmax(x: np.ndarray) -> np.ndarray:
    x = x - x.max(axis=-1, keepdims=True)
    return x - np.log(np.exp(x).sum(axis=-1, keepdims=True))


def _slot_scores(weights: np.ndarray, slot_class: np.ndarray) -> np.ndarray:
    """Log probabilities of slots within their class, for a bias row and a row per word before."""
    scores = weights[:1] + weights[1:]
    out = np.empty_like(scores)
    for c in range(int(slot_class.max()) + 1):
        at = np.flatnonzero(slot_class == c)
        if len(at):
            out[:, at] = _log_softmax(scores[:, at])
    return out


def _gradients(shared):
    """Per task: (kind, touched weights, gradient, curvature) of the log likelihood over its rows of counts.

    Only the rows of weights that the task's counts touch are returned, in single precision; all tasks together return
    a few MB, whatever the corpus.
    """

    def add(total: np.ndarray, at: np.ndarray, g: np.ndarray, h: np.ndarray) -> None:
        np.add.at(total[0], at, g)
        np.add.at(total[1], at, h)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        class_weights, slot_weights, slot_class, sizes = shared.value
        features, log_slot = _pair_features(sizes), _slot_scores(slot_weights, slot_class)
        member = (slot_class[:, None] == np.arange(sizes.classes)).astype(np.float64)
        totals = np.zeros((2, *class_weights.shape)), np.zeros((2, *slot_weights.shape))
        for batch in batches:
            kinds, rows, lines = batch.column(0).to_numpy(), batch.column(1).to_numpy(), batch.column(2).to_pylist()
            for kind, total in enumerate(totals):
                at = np.flatnonzero(kinds == kind)
                if not len(at):
                    continue
                n = np.frombuffer(b"".join(lines[k] for k in at)).reshape(len(at), -1)
                if kind == 0:
                    active = features[rows[at]].T
                    p, of = np.exp(_log_softmax(class_weights[active].sum(axis=0))), n.sum(axis=1, keepdims=True)
                else:
                    active = np.stack((np.zeros_like(rows[at]), 1 + rows[at]))
                    p, of = np.exp(log_slot[rows[at]]), (n @ member)[:, slot_class]
                for f in active:
                    add(total, f, n - of * p, of * p * (1 - p))
        touched = [np.flatnonzero(t[1].any(axis=1)).astype(np.int32) for t in totals]
        yield pa.record_batch(
            [
                pa.array([0, 1], pa.int32()),
                pa.array([at.tobytes() for at in touched], pa.binary()),
                *(pa.array([t[k, at].astype(np.float32).tobytes() for t, at in zip(totals, touched, strict=True)], pa.binary()) for k in (0, 1)),
            ],
            ["kind", "touched", "g", "h"],
        )

    return run


def train(counts: DataFrame, sizes: Sizes, slot_class: np.ndarray, slot_counts: np.ndarray, steps: int = 12, decay: float = 2.0, longest: float = 0.7) -> tuple[np.ndarray, np.ndarray]:
    """(class weights, slot weights) after gradient steps that are scaled by the curvature of each weight.

    counts: (kind, row, counts) as written by fit(). The biases start from slot_counts, the tokens of each slot. Each step is
    one Spark job whose tasks return one gradient each. A step is divided by the number of features that are active
    together, and no weight moves by more than `longest` in one.
    """
    spark = counts.sparkSession
    weights = [np.zeros((sizes.features, sizes.classes)), np.zeros((1 + sizes.contexts, sizes.slots))]
    weights[0][0] = np.log(np.bincount(slot_class, slot_counts, sizes.classes) + 0.5)
    weights[1][0] = np.log(slot_counts + 0.5)
    start = [w[0].copy() for w in weights]
    for _ in range(steps):
        shared = spark.sparkContext.broadcast((*weights, slot_class, sizes))
        totals = [np.zeros((2, *w.shape)) for w in weights]
        for kind, touched, *sums in counts.mapInArrow(_gradients(shared), "kind int, touched binary, g binary, h binary").collect():
            at = np.frombuffer(touched, np.int32)
            for total, values in zip(totals[kind], sums, strict=True):
                total[at] += np.frombuffer(values, np.float32).reshape(len(at), total.shape[1])
        for k, together in enumerate((4, 2)):
            pull = decay * weights[k]
            pull[0] -= decay * start[k]
            weights[k] = weights[k] + np.clip((totals[k][0] - pull) / (together * totals[k][1] + decay + 1), -longest, longest)
        shared.destroy()
    return weights[0], weights[1]


def vocabulary(rows: DataFrame) -> DataFrame:
    """(h, shape, n) of every distinct token of the texts; each task counts before anything is shuffled."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = []
            for _, _, data, offsets in tv.slices(batch.column(0)):
                _, h, shape = tokens(data, offsets)
                h, first, n = np.unique(h, return_index=True, return_counts=True)
                parts.append((h, shape[first], n))
            if parts:
                h, first, where = np.unique(np.concatenate([p[0] for p in parts]), return_index=True, return_inverse=True)
                n = np.bincount(where, np.concatenate([p[2] for p in parts])).astype(np.int64)
                yield pa.record_batch([pa.array(h.view(np.int64)), pa.array(np.concatenate([p[1] for p in parts])[first]), pa.array(n)], ["h", "shape", "n"])

    return rows.select("text").mapInArrow(count, "h long, shape long, n long").groupBy("h").agg(F.min("shape").alias("shape"), F.sum("n").alias("n"))


def fit(rows: DataFrame, words: DataFrame, steps: int = 12) -> Model:
    """The model of the texts in rows, whose vocabulary() is words."""
    spark = rows.sparkSession
    total, distinct = words.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    sizes = Sizes.of(distinct)
    pair_cells, slot_cells = sizes.contexts**2 * sizes.classes, sizes.contexts * sizes.slots
    heads = words.orderBy(F.desc("n"), "h").limit(sizes.heads).collect()
    model = Model(np.array([r["h"] for r in heads], np.int64).view(np.uint64), np.array([r["n"] for r in heads], np.int64), total, distinct, sizes)
    shared = spark.sparkContext.broadcast(model)

    def tails(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, distinct = np.zeros(sizes.tails, np.int64), np.zeros(sizes.tails, np.int64)
        for batch in batches:
            slot = shared.value.slots(batch.column(0).to_numpy().view(np.uint64), batch.column(1).to_numpy()) - sizes.heads
            rare = slot >= 0
            n += np.bincount(slot[rare], batch.column(2).to_numpy()[rare], sizes.tails).astype(np.int64)
            distinct += np.bincount(slot[rare], minlength=sizes.tails)
        yield pa.record_batch([pa.array(np.arange(sizes.tails)), pa.array(n), pa.array(distinct)], ["slot", "n", "words"])

    for row in words.select("h", "shape", "n").mapInArrow(tails, "slot long, n long, words long").groupBy("slot").agg(F.sum("n").alias("n"), F.sum("words").alias("words")).collect():
        model.tail_total[row["slot"]], model.tail_distinct[row["slot"]] = row["n"], row["words"]

    def cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, pairs, slots = shared.value, np.zeros(pair_cells, np.int64), np.zeros(slot_cells, np.int64)
        for batch in batches:
            for _, _, data, offsets in tv.slices(batch.column(0)):
                doc, h, shape = tokens(data, offsets)
                slot = known.slots(h, shape)
                b1, b2 = known.contexts(doc, slot, shape)
                pairs += np.bincount((b2 * sizes.contexts + b1) * sizes.classes + known.slot_class[slot], minlength=pair_cells)
                slots += np.bincount(b1 * sizes.slots + slot, minlength=slot_cells)
        for kind, table in ((0, pairs), (1, slots)):
            at = np.flatnonzero(table)
            yield pa.record_batch([pa.array(np.full(len(at), kind, np.int32)), pa.array(at), pa.array(table[at])], ["kind", "cell", "n"])

    width = F.when(F.col("kind") == 0, sizes.classes).otherwise(sizes.slots)
    summed = rows.select("text").mapInArrow(cells, "kind int, cell long, n long").groupBy("kind", "cell").agg(F.sum("n").alias("n"))
    summed = summed.select("kind", F.floor(F.col("cell") / width).cast("int").alias("row"), (F.col("cell") % width).cast("int").alias("place"), "n")

    def lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, line = None, None
        for batch in batches:
            kinds, places, at, n = (c.to_numpy() for c in batch.columns)
            new = np.flatnonzero(np.concatenate(([True], (kinds[1:] != kinds[:-1]) | (places[1:] != places[:-1]))))
            for lo, hi in zip(new, [*new[1:], len(kinds)], strict=True):
                if key != (kinds[lo], places[lo]):
                    if key is not None:
                        yield pa.record_batch([pa.array([int(key[0])], pa.int32()), pa.array([int(key[1])], pa.int32()), pa.array([line.tobytes()], pa.binary())], ["kind", "row", "counts"])
                    key, line = (kinds[lo], places[lo]), np.zeros(sizes.slots if kinds[lo] else sizes.classes)
                line[at[lo:hi]] += n[lo:hi]
        if key is not None:
            yield pa.record_batch([pa.array([int(key[0])], pa.int32()), pa.array([int(key[1])], pa.int32()), pa.array([line.tobytes()], pa.binary())], ["kind", "row", "counts"])

    # At most contexts * contexts + contexts rows.
    counts = materialize(summed.repartition(6, "kind", "row").sortWithinPartitions("kind", "row").mapInArrow(lines, "kind int, row int, counts binary"), "contexts")
    slot_counts = np.concatenate((model.head_counts, np.zeros(sizes.heads - len(model.heads)), model.tail_total))
    class_weights, slot_weights = train(counts, sizes, model.slot_class, slot_counts, steps)
    model.log_class = (_log_softmax(class_weights[_pair_features(sizes)].sum(axis=1)) / _LOG10).reshape(sizes.contexts * sizes.contexts, sizes.classes)
    model.log_slot = _slot_scores(slot_weights, model.slot_class) / _LOG10
    return model


def frequent_words(words: DataFrame, most: int = 1 << 18) -> tuple[np.ndarray, np.ndarray]:
    """(hashes in order, counts) of the most frequent words, `most` at most: as many whole classes of counts as fit."""
    scale = F.floor(F.log2("n") * 8).cast("int")
    sizes = words.groupBy(scale.alias("scale")).agg(F.count("*").alias("words"), F.min("n").alias("least")).orderBy(F.desc("scale")).collect()
    total, least = 0, None
    for row in sizes:
        total += row["words"]
        if total > most:
            break
        least = row["least"]
    if least is None:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    table = words.filter(F.col("n") >= least).select("h", "n").toArrow()
    h, n = table["h"].to_numpy().view(np.uint64), table["n"].to_numpy()
    order = np.argsort(h)
    return h[order], n[order]


def _scores(model: Model, words: DataFrame, rows: DataFrame) -> DataFrame:
    """Counts of frequent words, a table of fixed size, are broadcast; the other words of each document are joined with theirs.

    No key of that join is frequent, so none is hot.
    """
    shared = rows.sparkSession.sparkContext.broadcast((model, *frequent_words(words)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, keys, counts = shared.value
        unseen = np.log10(model.tail_total + 0.1 * (model.tail_distinct + 1))
        log_counts, log_total = np.log10(counts + 0.1), np.log10(model.total + 0.1 * (model.distinct + 1))
        for batch in batches:
            ids, held, row = batch.column(0), batch.column(1), batch.column(3).to_numpy()
            for lo, hi, data, offsets in tv.slices(batch.column(2)):
                n = hi - lo
                doc, h, shape = tokens(data, offsets)
                slot = model.slots(h, shape)
                b1, b2 = model.contexts(doc, slot, shape)
                partial = model.log_class[b2 * model.sizes.contexts + b1, model.slot_class[slot]] + model.log_slot[b1, slot]
                log_c, found = np.zeros(len(h)), np.zeros(len(h), bool)
                if len(keys):
                    at = np.minimum(np.searchsorted(keys, h), len(keys) - 1)
                    found = keys[at] == h
                    log_c[found] = log_counts[at[found]]
                tail = slot >= model.sizes.heads
                partial[tail] += log_c[tail] - unseen[slot[tail] - model.sizes.heads]
                # Heads that the frequent words don't hold (only if many words tie) count here, by their own table.
                lone = ~tail & ~found
                log_c[lone] = np.log10(model.head_counts[slot[lone]] + 0.1)
                size = np.bincount(doc, minlength=n)
                rest = np.flatnonzero(tail & ~found)
                rest = rest[np.lexsort((h[rest], doc[rest]))]
                new = np.flatnonzero(np.concatenate(([True], (h[rest][1:] != h[rest][:-1]) | (doc[rest][1:] != doc[rest][:-1])))) if len(rest) else rest
                times = np.diff(np.append(new, len(rest)))
                bounds = pa.array(np.searchsorted(doc[rest[new]], np.arange(n + 1)), pa.int32())
                yield pa.record_batch(
                    [
                        pa.array(row[lo:hi]),
                        ids.slice(lo, n),
                        held.slice(lo, n),
                        pa.array(size),
                        pa.array(size - np.bincount(doc[rest], minlength=n)),
                        pa.array(np.bincount(doc, log_c, n) - size * log_total),
                        pa.array(np.bincount(doc, partial, n)),
                        pa.ListArray.from_arrays(bounds, pa.array(h[rest[new]].view(np.int64))),
                        pa.ListArray.from_arrays(bounds, pa.array(times.astype(np.int64))),
                    ],
                    ["row", "doc_id", "held_out", "n_tokens", "n_known", "base_score", "score", "rare", "times"],
                )

    schema = "row long, doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double, rare array<long>, times array<long>"
    partial = materialize(rows.withColumn("row", F.monotonically_increasing_id()).select("doc_id", "held_out", "text", "row").mapInArrow(run, schema), "partial")
    each = partial.select("row", F.explode(F.arrays_zip("rare", "times")).alias("x")).select("row", F.col("x.rare").alias("h"), F.col("x.times").alias("times"))
    log_c = F.log10(F.coalesce("n", F.lit(0)) + F.lit(0.1)) * F.col("times")
    summed = each.join(words.select("h", "n"), "h", "left").groupBy("row").agg(F.sum(log_c).alias("more"), F.sum(F.when(F.col("n") > 0, F.col("times")).otherwise(0)).alias("known"))
    more, known = F.coalesce("more", F.lit(0.0)), F.coalesce("known", F.lit(0))
    return partial.drop("rare", "times").join(summed, "row", "left").select("doc_id", "held_out", "n_tokens", (F.col("n_known") + known).alias("n_known"), (F.col("base_score") + more).alias("base_score"), (F.col("score") + more).alias("score"))


def score_documents(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", steps: int = 12) -> DataFrame:
    """One row per document: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score (log10 probabilities).

    The model learns from the rows for which crc32 of the id as text, modulo 10, isn't 0; the others are held out. Null
    ids are held out, null texts are empty, and an empty text is its end alone. Repeated rows count and are scored as
    often as they occur. With nothing to learn from, every token has the same chance. An empty table gives an empty
    result. Only the id and the text are read. The vocabulary is never gathered; see _scores().
    """
    ids = F.col(id_col).cast("long")
    rows = documents.select(ids.alias("doc_id"), (F.crc32(F.coalesce(ids.cast("string"), F.lit(""))) % 10 == 0).alias("held_out"), F.col(text_col).cast("string").alias("text"))
    learned = rows.filter(~F.col("held_out"))
    words = materialize(vocabulary(learned), "vocabulary")
    model = fit(learned, words, steps)
    return _scores(model, words, rows).withColumn("train_tokens", F.lit(int(model.total)).cast("long"))


def op2_lm_scoring(spark, sf_dir: str) -> DataFrame:
    """All documents scored by a model of those that aren't held out."""
    return score_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))
