import math
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest

from helpers import documents, odd_texts, prose, words
from tidemill.llm import textvec as tv
from tidemill.llm.toxicity import STRIDE, WINDOW, Network, Words, toxicity


def view(texts):
    ((_, _, data, offsets),) = tv.slices(pa.array(texts, pa.string()), 1 << 62)
    return Words.of(data, offsets)


def network(texts, seed=3):
    """A network that knows every second word and 4-gram of the texts, with random parameters."""
    w = view(texts)
    net = Network.new({"word": w.known[::2], "char": np.unique(w.grams)[::2]}, seed)
    rng = np.random.default_rng(seed)
    for name, p in net.p.items():
        net.p[name] = (p + 0.3 * rng.standard_normal(p.shape)).astype(np.float32)
    net.p["word"][-1] = net.p["char"][-1] = 0
    return net


def span_number(b):
    return tv.span_hash(tv.prefix_hash(np.frombuffer(b, np.uint8)), np.array([0]), np.array([len(b)]))[0]


def gram_number(b):
    code = 0
    for c in b:
        code = (code * 257 + c) % (1 << 64)
    return tv.mix(np.array([code], np.uint64))[0]


def scalar_logit(net, tokens):
    """The logit of one window, word by word in plain floats."""
    p = {k: v.astype(float).tolist() for k, v in net.p.items()}
    row = lambda name, h: p[name][int(np.flatnonzero(net.vocabulary[name] == h)[0]) if h in net.vocabulary[name] else -1]
    dot = lambda x, m, j: sum(a * r[j] for a, r in zip(x, m))
    sig = lambda x: 1 / (1 + math.exp(-x))
    xs = []
    for w in tokens:
        b = b"\1" + w.encode() + b"\1"
        grams = [b[i : i + 4] for i in range(max(1, len(b) - 3))] if len(b) > 3 else [b[:2]]
        chars = [row("char", gram_number(g)) for g in grams]
        xs.append(row("word", span_number(w.encode())) + [sum(c) / len(chars) for c in zip(*chars)])
    states = []
    for side in "fb":
        h, out = [0.0] * 8, []
        for x in xs if side == "f" else xs[::-1]:
            gx = [dot(x, p[f"W{side}"], j) + p[f"c{side}"][j] for j in range(24)]
            gh = [dot(h, p[f"U{side}"], j) for j in range(24)]
            z, r = [sig(gx[j] + gh[j]) for j in range(8)], [sig(gx[8 + j] + gh[8 + j]) for j in range(8)]
            h = [(1 - z[j]) * h[j] + z[j] * math.tanh(gx[16 + j] + r[j] * gh[16 + j]) for j in range(8)]
            out.append(h)
        states.append(out if side == "f" else out[::-1])
    states = [a + b for a, b in zip(*states)]
    scores = [sum(math.tanh(dot(s, p["A"], j) + p["a"][j]) * p["v"][j] for j in range(8)) for s in states]
    weights = [math.exp(s) for s in scores]
    pooled = [sum(w * s[k] for w, s in zip(weights, states)) / sum(weights) for k in range(16)] if states else [0.0] * 16
    return sum(a * b for a, b in zip(pooled, p["out"])) + p["bias"][0]


def windows_of(tokens):
    last = max(0, -(-(len(tokens) - WINDOW) // STRIDE))
    return [tokens[k * STRIDE : k * STRIDE + WINDOW] for k in range(last + 1)]


def test_scores_equal_the_definition_word_by_word():
    rng = random.Random(1)
    texts = ["", None, "a", "One two, THREE", "ab é " * 20, prose(rng, 31), prose(rng, 32), prose(rng, 33), prose(rng, 48), prose(rng, 49), prose(rng, 200), "x" * 500]
    net = network(texts)
    want = [1 / (1 + math.exp(-max(scalar_logit(net, w) for w in windows_of(words(t))))) for t in texts]
    assert np.concatenate(list(net.scores(pa.array(texts, pa.string())))) == pytest.approx(want, abs=2e-5)


def test_gradients_equal_differences():
    rng = random.Random(2)
    texts = [prose(rng, 20, 30), prose(rng, 70, 30), "", "one"]
    net = network(texts)
    w = view(texts)
    text, first = w.windows(WINDOW)
    place, there = w.cells(text, first)
    weight = np.random.default_rng(1).standard_normal(len(text)).astype(np.float32)

    def total():
        e = net.embed(w)
        return float(weight.astype(float) @ net.forward({s: net.inputs(e, s) for s in "fb"}, place, there).astype(float))

    kept, e = {}, net.embed(w)
    net.forward({s: net.inputs(e, s) for s in "fb"}, place, there, kept)
    grad = net.backward(w, e, place, there, kept, weight)
    for name in ("word", "char"):
        rows, g = grad[name]
        grad[name] = np.zeros_like(net.p[name])
        grad[name][rows] = g
        grad[name][-1] = 0
    for name, g in grad.items():
        flat, p = np.abs(g).ravel(), net.p[name].reshape(-1)
        for k in np.argsort(-flat)[:4]:
            before = p[k]
            p[k] = before + np.float32(4e-3)
            up = total()
            p[k] = before - np.float32(4e-3)
            down = total()
            p[k] = before
            assert (up - down) / 8e-3 == pytest.approx(g.reshape(-1)[k], rel=0.05, abs=3e-3), name


def labelled(spark, n=400, seed=5):
    rng = random.Random(seed)
    texts, toxic = [], []
    for k in range(n):
        t = prose(rng, rng.randrange(5, 150), 60).split()
        if k % 4 == 0:
            for _ in range(3):
                t.insert(rng.randrange(len(t)), rng.choice(["vilest", "rotten", "vile" + rng.choice("abcdefgh") + rng.choice("xyz")]))
        texts.append(" ".join(t))
        toxic.append(int(k % 4 == 0))
    return texts, toxic


def test_held_out_documents_are_told_apart(spark):
    texts, toxic = labelled(spark)
    texts += odd_texts()
    labels = spark.createDataFrame([(k, t, 1 - t) for k, t in enumerate(toxic)] + [(0, None, None), (None, 1, 0), (99_999, 1, 1), (1, 0, 0)], "doc_id long, toxic int, text int")
    got = toxicity(documents(spark, texts).repartition(3), labels, rounds=4)
    assert got.columns == ["doc_id", "held_out", "score", "predicted"]
    rows = {r["doc_id"]: r for r in got.collect()}
    assert len(rows) == len(texts)
    for k, r in rows.items():
        assert r["held_out"] == (zlib.crc32(str(k).encode()) % 5 == 0)
        assert 0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5)
    held = [k for k in range(len(toxic)) if rows[k]["held_out"]]
    assert sum(rows[k]["predicted"] == toxic[k] for k in held) >= 0.95 * len(held)
    clean = [k for k in range(len(toxic), len(texts)) if not re.search("rotten|vile", texts[k] or "")]
    assert not any(rows[k]["predicted"] for k in clean if len(texts[k] or "") < 100)
    assert rows[len(toxic) + 1]["score"] == rows[len(toxic) + 2]["score"] < 0.5


def test_labels_of_held_out_documents_change_nothing(spark):
    texts, toxic = labelled(spark, 60)
    held = [zlib.crc32(str(k).encode()) % 5 == 0 for k in range(60)]
    scores = []
    for flip in (0, 1):
        labels = spark.createDataFrame([(k, t ^ 1 if flip and held[k] else t) for k, t in enumerate(toxic)], "doc_id long, toxic int")
        scores.append({r["doc_id"]: r["score"] for r in toxicity(documents(spark, texts), labels, rounds=1, steps=10).collect()})
    assert scores[0] == pytest.approx(scores[1], abs=1e-6)


def test_no_labels_and_no_documents(spark):
    none = spark.createDataFrame([], "doc_id long, toxic int")
    rows = toxicity(documents(spark, ["some words", None]), none).collect()
    assert [r["predicted"] for r in rows] == [0, 0]
    assert toxicity(documents(spark, []), none).collect() == []
