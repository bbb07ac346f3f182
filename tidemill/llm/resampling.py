"""Quality classification by importance resampling.

Two generative models over hashed n-grams, one of target text and one of all text, give every document the log ratio of
its probabilities; a Gumbel top-k then samples documents without replacement in proportion to these weights.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from statistics import NormalDist

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import textvec as tv
from .scratch import materialize

#: Buckets of single words and signs, and after them those of pairs.
WORDS, PAIRS = 1 << 18, 1 << 19
BUCKETS = WORDS + PAIRS
#: Labelled rows that fit and calibrate the models; beyond it a sample of so many by hash.
MOST_LABELLED = 200_000
_REPEATED = 5
STEM = 6
_PUNCT = ~(tv.ALNUM | tv.SPACE)


def features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(document, bucket) of every feature: words, runs of other signs, pairs of neighbouring ones, and stems.

    A stem is the first STEM bytes of a longer word, so that rare forms of a word count together.
    Five equal words in a row, with whatever signs between them, are one more feature, the same for all words.
    """
    prefix = tv.prefix_hash(tv.LOWER[data])
    parts = [tv.runs(kind[data], offsets) for kind in (tv.ALNUM, _PUNCT)]
    word, of = tv.span_hash(prefix, *parts[0][:2]), parts[0][2]
    equal = np.concatenate(([0], np.cumsum((word[1:] == word[:-1]) & (of[1:] == of[:-1])))) if len(word) else np.zeros(1, np.int64)
    run = of[: max(0, len(word) - _REPEATED + 1)][equal[_REPEATED - 1 :] - equal[: max(0, len(equal) - _REPEATED + 1)] == _REPEATED - 1]
    start = np.concatenate([p[0] for p in parts])
    order = np.argsort(start, kind="stable")
    doc, h = np.concatenate([p[2] for p in parts])[order], np.concatenate((word, tv.span_hash(prefix, *parts[1][:2])))[order]
    at = np.flatnonzero(doc[1:] == doc[:-1])
    pair = tv.mix(h[at] * np.uint64(0x9E3779B97F4A7C15) + h[at + 1])
    long = np.flatnonzero(parts[0][1] - parts[0][0] > STEM)
    stem = tv.mix(tv.span_hash(prefix, parts[0][0][long], parts[0][0][long] + STEM) + np.uint64(STEM))
    buckets = ((h % np.uint64(WORDS)).astype(np.int64), (stem % np.uint64(WORDS)).astype(np.int64), WORDS + (pair % np.uint64(PAIRS)).astype(np.int64), np.full(len(run), BUCKETS - 1))
    return np.concatenate((doc, of[long], doc[at], run)), np.concatenate(buckets)


@dataclass
class Model:
    """Evidence per bucket, and how evidence turns into a log weight."""

    ratio: np.ndarray
    per_feature: float = 0.02
    offset: float = 2.5

    def evidence(self, column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
        """(first row, last row + 1, sums of the log ratios, numbers of features)."""
        for lo, hi, data, offsets in tv.slices(column):
            doc, bucket = features(data, offsets)
            yield lo, hi, np.bincount(doc, self.ratio[bucket], hi - lo), np.bincount(doc, minlength=hi - lo)

    def log_weight(self, evidence: np.ndarray, n: np.ndarray) -> np.ndarray:
        """Above 0 where the document looks like the target."""
        return evidence + self.offset + self.per_feature * n


def _labels(labels: DataFrame, most: int) -> tuple[np.ndarray, np.ndarray]:
    """(ids, whether target) of the labelled rows, sorted by id; of contradicting rows of an id the worse one counts."""
    good = F.min(((F.col("quality") == 1) & (F.coalesce(F.col("toxic"), F.lit(0)) == 0)).cast("int"))
    known = labels.filter("doc_id is not null and quality is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(good.alias("good"))
    rows = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most).toArrow().sort_by("doc_id")
    return rows["doc_id"].to_numpy(), rows["good"].to_numpy() == 1


def _label_of(ids: pa.Array, known: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """1 for target rows, 0 for other labelled ones, -1 for the rest."""
    out = np.full(len(ids), -1, np.int64)
    if len(known[0]) and len(ids):
        values, valid = ids.fill_null(0).to_numpy(zero_copy_only=False), np.asarray(ids.is_valid())
        at = np.minimum(np.searchsorted(known[0], values), len(known[0]) - 1)
        hit = valid & (known[0][at] == values)
        out[hit] = known[1][at[hit]]
    return out


def fit(documents: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", most_labelled: int = MOST_LABELLED, least_ratio: float = 0.7) -> Model:
    """Counts both models over all documents, then calibrates the weight on the labelled ones.

    Target: labelled rows with quality 1 that aren't toxic. Raw: every document. Both count the documents that a feature
    occurs in, so that one long text proves no more than a short one. A bucket's log ratio is centred on the target's mean
    and counts where the target lacks it by more than chance gives in as many buckets as there are; chance would otherwise
    add up over long texts. Without labels of both kinds every document has the same weight.
    """
    spark = documents.sparkSession
    known = spark.sparkContext.broadcast(_labels(labels, most_labelled))
    rows = documents.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((2, BUCKETS), np.int64)
        for batch in batches:
            label = _label_of(batch.column(0), known.value)
            for lo, hi, data, offsets in tv.slices(batch.column(1)):
                doc, bucket = features(data, offsets)
                doc, bucket = np.divmod(np.unique(doc * BUCKETS + bucket), BUCKETS)
                total[0] += np.bincount(bucket, minlength=BUCKETS)
                total[1] += np.bincount(bucket[label[lo:hi][doc] == 1], minlength=BUCKETS)
        at = np.flatnonzero(total[0])
        yield pa.record_batch([pa.array(at), pa.array(total[0][at]), pa.array(total[1][at])], ["bucket", "raw", "target"])

    counted = rows.mapInArrow(count, "bucket long, raw long, target long").groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target")).toArrow()
    raw, target = np.zeros(BUCKETS), np.zeros(BUCKETS)
    at = counted["bucket"].to_numpy()
    raw[at], target[at] = counted["raw"].to_numpy(), counted["target"].to_numpy()
    model = Model(np.zeros(BUCKETS))
    if target.sum() and not known.value[1].all():
        expected = raw * (target.sum() / raw.sum())
        ratio = np.log((target + 0.5) / (expected + 0.5))
        centre = (ratio * target).sum() / target.sum()
        ratio, expected = ratio - centre, expected * np.exp(centre)
        deviation = (target - expected) / np.sqrt(expected + 0.5)
        tested = max(10, int((expected >= 6).sum()))
        model.ratio = np.where((deviation < NormalDist().inv_cdf(1 / tested)) & (ratio < -least_ratio), ratio, 0.0)
        _calibrate(model, rows, known)
    return model


def _calibrate(model: Model, rows: DataFrame, known) -> None:
    """Chooses the offset and the allowance per feature that part the labelled rows best (mean of both hit rates).

    Of the choices next to the best one, the one that rejects least is taken: clean documents stay.
    """
    shared = rows.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            label = _label_of(batch.column(0), known.value)
            at = np.flatnonzero(label >= 0)
            if len(at):
                for lo, hi, evidence, n in shared.value.evidence(batch.column(1).take(pa.array(at))):
                    yield pa.record_batch([pa.array(label[at[lo:hi]]), pa.array(evidence), pa.array(n)], ["label", "evidence", "n"])

    seen = rows.mapInArrow(run, "label long, evidence double, n long").toArrow()
    good = seen["label"].to_numpy() == 1
    if not good.any() or good.all():
        return
    evidence, n = seen["evidence"].to_numpy(), seen["n"].to_numpy()
    tried = []
    for per_feature in (0.0, 0.001, 0.0025, 0.005, 0.0075, 0.01, 0.015, 0.02, 0.03):
        for offset in (0.5, 1.0, 1.5, 2.0, 2.5, 3.0, 3.5, 4.0, 5.0, 6.0, 8.0):
            kept = evidence + offset + per_feature * n > 0
            tried.append(((kept[good].mean() + (~kept[~good]).mean()) / 2, kept.mean(), per_feature, offset))
    best = max(t[0] for t in tried)
    _, _, model.per_feature, model.offset = max((t for t in tried if t[0] >= best - 0.003), key=lambda t: t[1])


def _gumbel(documents_id: pa.Array, seed: int) -> np.ndarray:
    """Standard Gumbel noise that depends on the id and the seed alone; null ids share theirs."""
    ids = documents_id.fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
    u = ((tv.mix(tv.mix(ids + np.uint64(seed)) + np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(11)).astype(np.float64) + 0.5) / (1 << 53)
    return -np.log(-np.log(u))


def weigh(documents: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", seed: int = 7, temperature: float = 0.05) -> DataFrame:
    """(doc_id, log_weight, n_features, gumbel_key) of every row; the key is log_weight plus temperature x Gumbel noise."""
    shared = documents.sparkSession.sparkContext.broadcast(model)
    rows = documents.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, evidence, n in shared.value.evidence(batch.column(1)):
                ids = batch.column(0).slice(lo, hi - lo)
                weight = shared.value.log_weight(evidence, n)
                yield pa.record_batch([ids, pa.array(weight), pa.array(n), pa.array(weight + temperature * _gumbel(ids, seed))], ["doc_id", "log_weight", "n_features", "gumbel_key"])

    return rows.mapInArrow(run, "doc_id long, log_weight double, n_features long, gumbel_key double")


def kth_largest(keys: DataFrame, column: str, k: int, bins: int = 4096, few: int = 10_000) -> float:
    """The k-th largest value of a double column, exactly: counts in bins, narrowed until few rows are left.

    -inf where k is at least the number of rows, inf where k is 0.
    """
    low, high, n = keys.agg(F.min(column), F.max(column), F.count(column)).first()
    if k >= n:
        return float("-inf")
    if k <= 0:
        return float("inf")
    inside = keys.select(F.col(column).alias("v"))
    while n > few and low < high:
        place = F.least(F.floor((F.col("v") - low) / ((high - low) / bins)), F.lit(bins - 1)).cast("int")
        counts = inside.groupBy(place.alias("bin")).agg(F.count("*").alias("n"), F.min("v").alias("low"), F.max("v").alias("high")).orderBy(F.desc("bin")).collect()
        for row in counts:
            if k <= row["n"]:
                break
            k -= row["n"]
        low, high, n = row["low"], row["high"], row["n"]
        inside = inside.filter(F.col("v").between(low, high))
    if low == high:
        return low
    return inside.orderBy(F.desc("v")).limit(k).agg(F.min("v")).first()[0]


def resample(documents: DataFrame, labels: DataFrame, k: int | None = None, id_col: str = "doc_id", text_col: str = "text", seed: int = 7, temperature: float = 0.05, **options) -> tuple[DataFrame, Model, float]:
    """(all rows weighed, the model, the smallest key that is sampled): the Gumbel top-k sample is where gumbel_key >= it.

    k: rows to sample, by default as many as weigh above 0, that is, look like the target. Rows that tie at the last
    place all stay, so repeated rows stay or go together. A null or empty text has no evidence and stays by default.
    """
    model = fit(documents, labels, id_col, text_col, **options)
    weighed = materialize(weigh(documents, model, id_col, text_col, seed, temperature), "weighed")
    if k is None:
        k = weighed.filter("log_weight > 0").count()
    return weighed, model, kth_largest(weighed, "gumbel_key", k)


def keep_quality(documents: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", seed: int = 7, temperature: float = 0.05, **options) -> DataFrame:
    """The sampled documents, with all their columns. They are weighed again as they are read; nothing is shuffled."""
    _, model, least = resample(documents, labels, None, id_col, text_col, seed, temperature, **options)
    shared = documents.sparkSession.sparkContext.broadcast(model)
    names = documents.columns
    text, ids = names.index(text_col), names.index(id_col)
    schema = T.StructType([T.StructField(f.name, f.dataType, True) for f in documents.schema.fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept = np.zeros(batch.num_rows, bool)
            noise = temperature * _gumbel(batch.column(ids).cast(pa.int64()), seed)
            for lo, hi, evidence, n in shared.value.evidence(batch.column(text)):
                kept[lo:hi] = shared.value.log_weight(evidence, n) + noise[lo:hi] >= least
            yield batch.filter(pa.array(kept))

    return documents.mapInArrow(run, schema)


def op3_quality_classifier(spark, sf_dir: str) -> DataFrame:
    """The sampled documents, those that are kept: doc_id, log_weight, n_features, gumbel_key, kept (always true).

    Documents that are rejected have no row.
    """
    weighed, _, least = resample(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return weighed.filter(F.col("gumbel_key") >= F.lit(least)).withColumn("kept", F.lit(True))
