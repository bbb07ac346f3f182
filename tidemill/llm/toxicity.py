"""Toxicity: a bidirectional gated recurrent network with attention over windows of words, trained and applied in numpy."""

from __future__ import annotations

import io
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textvec as tv
from .scratch import discard, materialize

WINDOW, STRIDE = 32, 16
_EMBEDDING, _HIDDEN, _ATTENTION = 8, 8, 8
#: Windows that are folded together in scoring, and through which one document's gradient goes.
_TOGETHER, _MOST_WINDOWS = 8192, 1024


@dataclass
class Words:
    """The words of some texts: of each distinct one its hash and those of its character 4-grams, and the texts as their numbers."""

    known: np.ndarray
    grams: np.ndarray
    gram_start: np.ndarray
    place: np.ndarray
    offsets: np.ndarray

    @staticmethod
    def of(data: np.ndarray, offsets: np.ndarray) -> Words:
        start, end, doc, h = tv.words(data, offsets)
        known, first, place = np.unique(h, return_index=True, return_inverse=True)
        s, n = start[first], end[first] - start[first]
        # Each distinct word stands between two marks, so that its beginning and end are told from its inside.
        wide = n + 2
        at = np.concatenate([[0], np.cumsum(wide)])
        inside = np.arange(at[-1]) - np.repeat(at[:-1], wide)
        source = np.repeat(s, wide) + inside - 1
        marks = (inside == 0) | (inside == np.repeat(wide, wide) - 1)
        text = np.where(marks, 1, tv.LOWER[data[np.clip(source, 0, max(len(data) - 1, 0))]] if len(data) else 1).astype(np.uint64)
        n_grams = np.maximum(wide - 3, 1)
        gram_at = np.concatenate([[0], np.cumsum(n_grams)])
        first_of = np.repeat(at[:-1], n_grams) + np.arange(gram_at[-1]) - np.repeat(gram_at[:-1], n_grams)
        padded = np.concatenate([text, np.zeros(4, np.uint64)])
        code = np.zeros(len(first_of), np.uint64)
        for k in range(4):
            code = code * np.uint64(257) + padded[first_of + k]
        short = np.repeat(wide < 4, n_grams)
        code[short] = padded[first_of[short]] * np.uint64(257) + padded[first_of[short] + 1]
        return Words(known, tv.mix(code), gram_at, place.astype(np.int64).ravel(), np.searchsorted(doc, np.arange(len(offsets))))

    def windows(self, stride: int) -> tuple[np.ndarray, np.ndarray]:
        """(text, first word) of each window: every text has one at least, and the last one reaches its end."""
        n = np.diff(self.offsets)
        per = np.maximum(1, -(-(n - WINDOW) // stride) + 1)
        text = np.repeat(np.arange(len(n)), per)
        k = np.arange(len(text)) - np.repeat(np.cumsum(per) - per, per)
        return text, self.offsets[:-1][text] + k * stride

    def cells(self, text: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(distinct word of each place, which places hold one) of some windows; an absent word has the number after the last."""
        place = first[:, None] + np.arange(WINDOW)
        there = place < self.offsets[1:][text][:, None]
        return np.append(self.place, len(self.known))[np.where(there, place, len(self.place))], there


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return np.float32(1) / (np.float32(1) + np.exp(-x))


@dataclass
class Network:
    """The hashes of known words and 4-grams, in order, and the parameters by name; `state` holds what the optimiser remembers."""

    vocabulary: dict[str, np.ndarray]
    p: dict[str, np.ndarray]
    state: dict[str, np.ndarray] = field(default_factory=dict)
    steps: int = 0

    @staticmethod
    def new(vocabulary: dict[str, np.ndarray], seed: int) -> Network:
        rng = np.random.default_rng(seed)
        full = lambda *shape: (rng.standard_normal(shape) / np.sqrt(shape[0])).astype(np.float32)
        zero = lambda *shape: np.zeros(shape, np.float32)
        p = {name: zero(len(vocabulary[name]) + 1, _EMBEDDING) for name in ("word", "char")}
        for side in "fb":
            p |= {f"W{side}": full(2 * _EMBEDDING, 3 * _HIDDEN), f"U{side}": full(_HIDDEN, 3 * _HIDDEN), f"c{side}": zero(3 * _HIDDEN)}
        p |= {"A": full(2 * _HIDDEN, _ATTENTION), "a": zero(_ATTENTION), "v": full(_ATTENTION), "out": full(2 * _HIDDEN), "bias": np.full(1, -2, np.float32)}
        return Network(vocabulary, p)

    def rows(self, name: str, hashes: np.ndarray) -> np.ndarray:
        """Rows of a table by hash; what isn't known has the last row, which stays zero."""
        known = self.vocabulary[name]
        at = np.searchsorted(known, hashes)
        return np.where(np.append(known, np.uint64(0))[at] == hashes, at, len(known)) if len(known) else np.zeros(len(hashes), np.int64)

    def embed(self, words: Words) -> np.ndarray:
        """Word and character parts of the distinct words, side by side."""
        if not len(words.known):
            return np.zeros((0, 2 * _EMBEDDING), np.float32)
        chars = np.add.reduceat(self.p["char"][self.rows("char", words.grams)], words.gram_start[:-1]) / np.diff(words.gram_start)[:, None].astype(np.float32)
        return np.concatenate([self.p["word"][self.rows("word", words.known)], chars], 1)

    def inputs(self, embedded: np.ndarray, side: str) -> np.ndarray:
        """What each distinct word adds to the gates; the last row stands for an absent word."""
        return np.concatenate([embedded @ self.p[f"W{side}"] + self.p[f"c{side}"], np.zeros((1, 3 * _HIDDEN), np.float32)])

    def _run(self, inputs: np.ndarray, place: np.ndarray, there: np.ndarray, side: str, out: np.ndarray, kept: list | None) -> None:
        """One direction over all windows at once; `out` takes the states, `kept` what going back needs."""
        h, U = np.zeros((len(place), _HIDDEN), np.float32), self.p[f"U{side}"]
        for t in range(WINDOW) if side == "f" else range(WINDOW - 1, -1, -1):
            x, g, m = inputs[place[:, t]], h @ U, there[:, t, None]
            gates = _sigmoid(x[:, : 2 * _HIDDEN] + g[:, : 2 * _HIDDEN])
            z, r = gates[:, :_HIDDEN], gates[:, _HIDDEN:]
            new = np.tanh(x[:, 2 * _HIDDEN :] + r * g[:, 2 * _HIDDEN :])
            if kept is not None:
                kept.append((t, h, g[:, 2 * _HIDDEN :], z, r, new))
            h = np.where(m, h + z * (new - h), h)
            out[:, t] = h

    def forward(self, inputs: dict[str, np.ndarray], place: np.ndarray, there: np.ndarray, kept: dict | None = None) -> np.ndarray:
        """The logit of each window."""
        states = np.empty((len(place), WINDOW, 2 * _HIDDEN), np.float32)
        for k, side in enumerate("fb"):
            back = None if kept is None else kept.setdefault(side, [])
            self._run(inputs[side], place, there, side, states[:, :, k * _HIDDEN : (k + 1) * _HIDDEN], back)
        e = np.tanh(states @ self.p["A"] + self.p["a"])
        s = np.where(there, e @ self.p["v"], np.float32(-1e30))
        alpha = np.exp(s - s.max(1, keepdims=True)) * there
        alpha /= np.maximum(alpha.sum(1, keepdims=True), np.float32(1e-30))
        pooled = np.einsum("nt,nth->nh", alpha, states)
        if kept is not None:
            kept |= {"states": states, "e": e, "alpha": alpha, "pooled": pooled}
        return pooled @ self.p["out"] + self.p["bias"]

    def backward(self, words: Words, embedded: np.ndarray, place: np.ndarray, there: np.ndarray, kept: dict, d: np.ndarray) -> dict[str, np.ndarray]:
        """Gradients by name, given those of the logits."""
        states, e, alpha = kept["states"], kept["e"], kept["alpha"]
        grad = {"out": kept["pooled"].T @ d, "bias": d.sum(keepdims=True)}
        d_pooled = d[:, None] * self.p["out"]
        d_alpha = np.einsum("nth,nh->nt", states, d_pooled)
        d_s = alpha * (d_alpha - (alpha * d_alpha).sum(1, keepdims=True))
        d_e = d_s[:, :, None] * self.p["v"] * (1 - e * e)
        grad["v"] = np.einsum("nt,nta->a", d_s, e)
        grad["A"], grad["a"] = np.tensordot(states, d_e, ([0, 1], [0, 1])), d_e.sum((0, 1))
        d_states = alpha[:, :, None] * d_pooled[:, None] + d_e @ self.p["A"].T
        d_embedded = np.zeros_like(embedded)
        for k, side in enumerate("fb"):
            U, d_h = self.p[f"U{side}"], np.zeros((len(place), _HIDDEN), np.float32)
            d_U, d_x = np.zeros_like(U), np.zeros((WINDOW, len(place), 3 * _HIDDEN), np.float32)
            for t, h, g, z, r, new in reversed(kept[side]):
                m = there[:, t, None]
                whole = d_h + d_states[:, t, k * _HIDDEN : (k + 1) * _HIDDEN]
                mine = whole * m
                d_new = mine * z * (1 - new * new)
                d_z, d_r = mine * (new - h) * z * (1 - z), d_new * g * r * (1 - r)
                d_g = np.concatenate([d_z, d_r, d_new * r], 1)
                d_U += h.T @ d_g
                d_x[t] = np.concatenate([d_z, d_r, d_new], 1)
                d_h = whole - mine * z + d_g @ U.T
            order = np.argsort(place.T.ravel(), kind="stable")
            at = place.T.ravel()[order]
            start = np.flatnonzero(np.diff(at, prepend=-1))
            d_in = np.zeros((len(embedded) + 1, 3 * _HIDDEN), np.float32)
            d_in[at[start]] = np.add.reduceat(d_x.reshape(-1, 3 * _HIDDEN)[order], start)
            d_in = d_in[:-1]
            grad |= {f"U{side}": d_U, f"W{side}": embedded.T @ d_in, f"c{side}": d_in.sum(0)}
            d_embedded += d_in @ self.p[f"W{side}"].T
        grad["word"] = _by_row(self.rows("word", words.known), d_embedded[:, :_EMBEDDING])
        n = np.diff(words.gram_start)
        grad["char"] = _by_row(self.rows("char", words.grams), np.repeat(d_embedded[:, _EMBEDDING:] / n[:, None].astype(np.float32), n, axis=0))
        return grad

    def learn(self, grad: dict, rate: float = 0.01, row_rate: float = 0.1) -> None:
        """One step: Adam for the small parameters, Adagrad for the rows of the two tables that a batch touched."""
        self.steps += 1
        for name, g in grad.items():
            if name in ("word", "char"):
                rows, g = (x[g[0] < len(self.vocabulary[name])] for x in g)
                seen = self.state.setdefault(name, np.full(len(self.p[name]), 1e-8, np.float32))
                seen[rows] += (g * g).mean(1)
                self.p[name][rows] -= np.float32(row_rate) * g / np.sqrt(seen[rows])[:, None]
                continue
            first, second = self.state.setdefault(f"{name} 1", np.zeros_like(g)), self.state.setdefault(f"{name} 2", np.zeros_like(g))
            first += 0.1 * (g - first)
            second += 0.001 * (g * g - second)
            self.p[name] -= np.float32(rate) * (first / (1 - 0.9**self.steps)) / (np.sqrt(second / (1 - 0.999**self.steps)) + np.float32(1e-8))

    def logits(self, words: Words, stride: int = STRIDE) -> tuple[np.ndarray, np.ndarray]:
        """(text, logit) of every window."""
        text, first = words.windows(stride)
        embedded = self.embed(words)
        inputs = {side: self.inputs(embedded, side) for side in "fb"}
        parts = [self.forward(inputs, *words.cells(text[k : k + _TOGETHER], first[k : k + _TOGETHER])) for k in range(0, len(text), _TOGETHER)]
        return text, np.concatenate(parts) if parts else np.zeros(0, np.float32)

    def scores(self, column: pa.Array) -> Iterator[np.ndarray]:
        """Of each text of a column, the largest probability of its overlapping windows; in runs of texts."""
        for _, _, data, offsets in tv.slices(column):
            words = Words.of(data, offsets)
            text, logit = self.logits(words)
            start = np.flatnonzero(np.diff(text, prepend=-1))
            yield 1 / (1 + np.exp(-np.clip(np.maximum.reduceat(logit, start).astype(np.float64), -500, 500)))

    def step(self, words: Words, label: np.ndarray) -> float:
        """One gradient step on some texts; gives their loss.

        A text's logit is the log of the sum of its windows' odds, so that one toxic window makes it toxic and all windows of a
        clean one count. Of a text with very many windows the gradient goes through the ones of largest logit.
        """
        text, first = words.windows(WINDOW)
        if len(text) > _MOST_WINDOWS:
            _, logit = self.logits(words, WINDOW)
            order = np.lexsort((-logit, text))
            rank = np.arange(len(text)) - np.searchsorted(text, text)
            used = np.sort(order[rank < _MOST_WINDOWS])
            text, first = text[used], first[used]
        place, there = words.cells(text, first)
        embedded, kept = self.embed(words), {}
        logit = self.forward({side: self.inputs(embedded, side) for side in "fb"}, place, there, kept).astype(np.float64)
        start = np.flatnonzero(np.diff(text, prepend=-1))
        top = np.maximum.reduceat(logit, start)
        odds = np.exp(logit - top[text])
        total = np.add.reduceat(odds, start)
        whole = top + np.log(total)
        error = 1 / (1 + np.exp(-whole)) - label
        d = (error[text] * odds / total[text] / len(label)).astype(np.float32)
        self.learn(self.backward(words, embedded, place, there, kept, d))
        return float(np.mean(np.logaddexp(0, whole) - label * whole))

    def train(self, texts: pa.Array, label: np.ndarray, steps: int, batch: int, seed: int) -> float:
        """Steps over some texts in random order, again and again; each batch has an empty text too, which is clean. Gives the mean loss."""
        rng, order, loss = np.random.default_rng(seed), np.zeros(0, np.int64), []
        for _ in range(steps if len(texts) else 0):
            while len(order) < batch:
                order = np.concatenate([order, rng.permutation(len(texts))])
            rows, order = order[:batch], order[batch:]
            column = pa.concat_arrays([texts.take(pa.array(rows)), pa.array([""], texts.type)])
            ((_, _, data, offsets),) = tv.slices(column, 1 << 62)
            loss.append(self.step(Words.of(data, offsets), np.append(label[rows], 0.0)))
        return float(np.mean(loss)) if loss else 0.0


def _by_row(rows: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(different rows, sums of their values)."""
    order = np.argsort(rows, kind="stable")
    at = rows[order]
    start = np.flatnonzero(np.diff(at, prepend=-1))
    return at[start], np.add.reduceat(values[order], start) if len(start) else values[:0]


def _average(start: dict[str, np.ndarray], ends: list[dict[str, np.ndarray]]) -> dict[str, np.ndarray]:
    """The mean of what the shards made of the parameters; a row of a table counts only where a shard moved it."""
    out = {}
    for name, before in start.items():
        moves = np.stack([e[name] - before for e in ends])
        if name in ("word", "char"):
            moved = (moves != 0).any(2, keepdims=True).sum(0)
            out[name] = before + moves.sum(0) / np.maximum(moved, 1)
        else:
            out[name] = before + moves.mean(0)
    return {k: v.astype(np.float32) for k, v in out.items()}


def labelled_sample(documents: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, most_toxic: int, most_clean: int) -> DataFrame:
    """(id, text, label) of labelled documents: of each label those with the least CRC-32 of the id, up to a number.

    An id with several labels is toxic if one of them says so; of several rows with an id the least text counts.
    """
    known = labels.select(F.col(id_col).cast("string").alias("id"), (F.col(label_col) > 0).cast("int").alias("label")).dropna().groupBy("id").agg(F.max("label").alias("label"))
    first = lambda label, most: known.filter(F.col("label") == label).orderBy(F.crc32("id"), "id").limit(most)
    ids = first(1, most_toxic).unionByName(first(0, most_clean))
    rows = documents.select(F.col(id_col).cast("string").alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    return rows.join(F.broadcast(ids), "id").groupBy("id").agg(F.min("text").alias("text"), F.max("label").alias("label"))


def _terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(kind, hash, n): of each known word (0) and character 4-gram (1) in how many texts it stands."""
    for b in batches:
        seen: tuple[list, list] = ([], [])
        for text in b.column(0):
            ((_, _, data, offsets),) = tv.slices(pa.array([text.as_py()], pa.string()), 1 << 62)
            words = Words.of(data, offsets)
            seen[0].append(words.known)
            seen[1].append(np.unique(words.grams))
        for kind, lists in enumerate(seen):
            h, n = np.unique(np.concatenate(lists), return_counts=True) if lists else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(h), kind)), pa.array(h.view(np.int64)), pa.array(n)], ["kind", "hash", "n"])


def _packed(p: dict[str, np.ndarray]) -> bytes:
    out = io.BytesIO()
    np.savez(out, **p)
    return out.getvalue()


def _shard_training(shared, steps: int, batch: int, seed: int):
    def train(key, table):
        table = table.sort_by("id")
        mine = Network(shared.value.vocabulary, {k: v.copy() for k, v in shared.value.p.items()})
        mine.train(table["text"].combine_chunks(), table["label"].to_numpy().astype(np.float64), steps, batch, seed + key[0].as_py())
        return pa.table({"shard": pa.array([key[0].as_py()], pa.int32()), "p": pa.array([_packed(mine.p)], pa.binary())})

    return train


def fit(documents: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", most_toxic: int = 1500, most_clean: int = 3000, least_texts: int = 5, most_terms: int = 1 << 17, shards: int = 4, rounds: int = 3, steps: int = 100, batch: int = 8, seed: int = 1) -> Network:
    """The network, trained on at most most_toxic and most_clean labelled documents, each whole.

    The sample is dealt to shards by a hash of the id. Each round, every shard takes `steps` gradient steps of `batch` texts from the
    same parameters in a task of its own, and what they reach is averaged. Words and character 4-grams that stand in fewer than
    least_texts of the sample's texts are unknown: they say nothing. Without labelled documents the network stays as it began.
    """
    spark = documents.sparkSession
    sample = labelled_sample(documents, labels, id_col, text_col, label_col, most_toxic, most_clean)
    sample = materialize(sample.withColumn("shard", F.pmod(F.xxhash64("id"), F.lit(shards)).cast("int")), "toxicity-sample")
    terms = sample.select("text").mapInArrow(_terms, "kind long, hash long, n long").groupBy("kind", "hash").agg(F.sum("n").alias("n"))
    found = terms.filter(F.col("n") >= least_texts).orderBy(F.desc("n"), "kind", "hash").limit(most_terms).toArrow()
    kind, h = found["kind"].to_numpy(), found["hash"].to_numpy().astype(np.int64).view(np.uint64)
    network = Network.new({name: np.sort(h[kind == k]) for k, name in enumerate(("word", "char"))}, seed)
    for r in range(rounds):
        shared = spark.sparkContext.broadcast(network)
        # Each shard has a task of its own: by hash two may share one, and small partitions would be merged.
        ends = sample.repartitionById(shards, F.col("shard")).groupBy("shard").applyInArrow(_shard_training(shared, steps, batch, 1000 * r), "shard int, p binary").collect()
        shared.destroy()
        if not ends:
            break
        network.p = _average(network.p, [dict(np.load(io.BytesIO(e["p"]))) for e in sorted(ends, key=lambda e: e["shard"])])
    discard(sample)
    return network


def score(documents: DataFrame, network: Network, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score) of every row: the largest probability of the text's windows, which overlap by half."""
    shared = documents.sparkSession.sparkContext.broadcast(network)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = list(shared.value.scores(b.column(1)))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(np.concatenate(found) if found else np.zeros(0))], [id_col, "score"])

    kind = documents.schema[id_col].dataType.simpleString()
    return documents.select(id_col, F.col(text_col).cast("string").alias("_text")).mapInArrow(run, f"`{id_col}` {kind}, score double")


def toxicity(documents: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", folds: int = 5, **options) -> DataFrame:
    """(id, held_out, score, predicted) of every row; labels of ids whose CRC-32 is divisible by `folds` aren't learnt from.

    A null or empty text is one window without words, whose score the network learns as that of a clean text; a null id counts as an empty one for its fold.
    Repeated rows are scored each, alike. Null labels and labels of ids without documents aren't learnt from. An empty
    table gives no rows. Of documents only id and text are read, whatever else there is; long texts are scored whole.
    """
    fold = F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit(""))) % folds
    network = fit(documents, labels.filter(fold != 0), id_col, text_col, label_col, **options)
    return score(documents, network, id_col, text_col).select(id_col, (fold == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op12_toxicity(spark, sf_dir: str) -> DataFrame:
    """Every document's toxicity by a network trained on the labels that aren't held out."""
    return toxicity(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
