import hashlib
import math
import random
import re
import textwrap
import tracemalloc
import zlib
from collections import Counter
from statistics import NormalDist

import numpy as np
import duckdb
import pyarrow as pa
import pytest
from helpers import documents, odd_texts, prose, words
from pyspark.sql import functions as F

from tidemill.llm import decontaminate, license_scan, maxent_lm, mixing, pii, resampling, url_filter


def bench(spark, *rows):
    return spark.createDataFrame(list(rows), "item_id long, text string")


def brute_tiles(a, b, least):
    """Greedy string tiling by its definition."""
    used_a, used_b, tiles = set(), set(), []
    while True:
        best = (least - 1, 0, 0)
        for i in range(len(a)):
            for j in range(len(b)):
                n = 0
                while i + n < len(a) and j + n < len(b) and a[i + n] == b[j + n] and i + n not in used_a and j + n not in used_b:
                    n += 1
                if n > best[0]:
                    best = (n, i, j)
        n, i, j = best
        if n < least:
            return tiles
        tiles.append((i, j, n))
        used_a |= set(range(i, i + n))
        used_b |= set(range(j, j + n))


def test_tiling_covers_as_much_as_by_definition():
    rng = random.Random(4)
    for _ in range(60):
        item = [rng.randrange(6) for _ in range(rng.randrange(5, 30))]
        text = [rng.randrange(6) for _ in range(rng.randrange(5, 40))]
        k = rng.randrange(len(item))
        text[5:5] = item[k:] + [99] + item[:k]
        assert sorted(t[2] for t in decontaminate.tile(*seeded(text, item, 3), 3)) == sorted(t[2] for t in brute_tiles(text, item, 3))


def seeded(text, item, least):
    """Both sides as arrays, and the places of all their runs of `least` words with the runs' numbers."""
    numbers = {}
    number = lambda w: np.array([numbers.setdefault(tuple(w[k : k + least]), len(numbers)) for k in range(len(w) - least + 1)], np.int64)
    of_text, of_item = number(text), number(item)
    return np.array(text), np.array(item), (np.arange(len(of_text)), of_text, np.arange(len(of_item)), of_item)


def test_maximal_matches_are_those_of_every_diagonal():
    rng = random.Random(40)
    for trial in range(80):
        text, item = ([rng.randrange(1 + trial % 4) for _ in range(rng.randrange(3, 40))] for _ in range(2))
        want = set()
        for i in range(len(text)):
            for j in range(len(item)):
                n = 0
                while i + n < len(text) and j + n < len(item) and text[i + n] == item[j + n]:
                    n += 1
                if n >= 3 and not (i and j and text[i - 1] == item[j - 1]):
                    want.add((i, j, n))
        got = [tuple(x) for x in np.stack(decontaminate.matches(*seeded(text, item, 3), 3), axis=1).tolist()]
        assert set(got) == want and len(got) == len(want)


def test_a_phrase_that_repeats_on_both_sides_is_tiled_in_linear_memory():
    text, item = pa.array(["buy now " * 20_000, "buy this now " * 20_000]), decontaminate.Items([(1, "buy now " * 2_000), (2, "now and then " * 9)], 5)
    tracemalloc.start()
    got = list(decontaminate._tiled(text, item, 0.5))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert [(r[0], r[1], r[3]) for r in got] == [(0, 0, 4000)] and got[0][2] == [(0, 0, 4000)] and peak < 64 << 20


def test_contaminated_documents(spark):
    rng = random.Random(8)
    item, other = prose(rng, 40), prose(rng, 40)
    w = item.split()
    texts = odd_texts() + [prose(rng, 50) + " " + item.upper().replace(" ", ", ") + ". " + prose(rng, 30), " ".join(w[20:] + ["gap"] + w[:20]), " ".join(w[:15]), prose(rng, 2000), item + " " + other]
    n = len(odd_texts())
    items = bench(spark, (1, item), (2, other), (3, None), (4, "too short"), (5, ""))
    got = decontaminate.contaminated_pairs(documents(spark, texts), items)
    assert sorted((r["doc_id"], r["item_id"]) for r in got.collect()) == [(n, 1), (n + 1, 1), (n + 4, 1), (n + 4, 2)]
    assert got.filter(f"doc_id = {n + 1}").first()["matched_words"] == 40 and len(got.filter(f"doc_id = {n + 1}").first()["tiles"]) == 2
    blocks = decontaminate.contaminated_pairs(documents(spark, texts), items, block_bytes=200)
    assert sorted((r["doc_id"], r["item_id"]) for r in blocks.collect()) == sorted((r["doc_id"], r["item_id"]) for r in got.collect())
    for kept in (decontaminate.drop_contaminated(documents(spark, texts), items), decontaminate.drop_contaminated(documents(spark, texts), items, block_bytes=200)):
        assert kept.columns == documents(spark, texts).columns and sorted(r["doc_id"] for r in kept.collect()) == [k for k in range(len(texts)) if k not in (n, n + 1, n + 4)]
    assert decontaminate.drop_contaminated(documents(spark, texts), items.limit(0)).count() == len(texts)
    assert decontaminate.drop_contaminated(documents(spark, texts).limit(0), items).count() == 0
    twice = decontaminate.contaminated_pairs(documents(spark, texts).unionByName(documents(spark, texts)), items.unionByName(items))
    assert twice.count() == 4 * got.count()
    assert decontaminate.contaminated_pairs(documents(spark, texts), items.limit(0)).count() == 0
    assert decontaminate.contaminated_pairs(documents(spark, texts).limit(0), items).count() == 0


def test_contaminated_pairs_equal_all_pairs_tiled_by_definition(spark):
    rng = random.Random(21)
    items = [prose(rng, rng.randrange(3, 25), 30) for _ in range(8)] + ["w1 w1 w1 w1 w1 w1 w1 w1", "w1 w2 " * 6, None, ""]
    texts = [*odd_texts()[:5], "w1 " * 40, "W2, w1; " * 12]
    for _ in range(40):
        w = prose(rng, rng.randrange(0, 30), 30).split()
        part = (rng.choice(items) or "").split()
        k, cut = rng.randrange(len(part) + 1), rng.randrange(len(part) + 1)
        for piece in (part[k:], part[:k][:cut]):
            place = rng.randrange(len(w) + 1)
            w[place:place] = piece
        texts.append(rng.choice([" ", ", ", "\n"]).join(w))
    want = {}
    for d, t in enumerate(texts):
        for i, item in enumerate(items):
            tiles = brute_tiles(words(t), words(item), decontaminate.SHORTEST_MATCH)
            matched, n = sum(x[2] for x in tiles), len(words(item))
            if tiles and matched >= decontaminate.COVERAGE * n:
                want[d, i] = (matched, n, max(x[2] for x in tiles))
    got = decontaminate.contaminated_pairs(documents(spark, texts), bench(spark, *enumerate(items))).collect()
    assert {(r["doc_id"], r["item_id"]): (r["matched_words"], r["item_words"], r["longest"]) for r in got} == want and len(got) == len(want) >= 20


def lm_tokens(t):
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")) + ["\0end"]


@pytest.mark.parametrize("most", [1 << 18, 50])
def test_language_model(spark, most, monkeypatch):
    """Base scores by definition, with all counts broadcast or most of them joined; the model beats them on held-out text."""
    frequent = maxent_lm.frequent_words
    monkeypatch.setattr(maxent_lm, "frequent_words", lambda words: frequent(words, most))
    rng = random.Random(6)
    follow = {k: [rng.randrange(60) for _ in range(2)] for k in range(60)}
    texts = odd_texts()
    for _ in range(150):
        w, at = [], rng.randrange(60)
        for _ in range(80):
            w.append(f"t{at}")
            at = rng.choice(follow[at]) if rng.random() < 0.9 else rng.randrange(60)
        texts.append(" ".join(w))
    ids = [*range(len(texts) - 1), None]
    held = [zlib.crc32(str(i).encode()) % 10 == 0 if i is not None else True for i in ids]
    c = Counter()
    for t, h in zip(texts, held):
        if not h:
            c.update(lm_tokens(t))
    total, distinct = sum(c.values()), len(c)
    got = {r["doc_id"]: r for r in maxent_lm.score_documents(documents(spark, texts, ids)).collect()}
    for i, t, h in zip(ids, texts, held):
        r, w = got[i], lm_tokens(t)
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (h, len(w), sum(x in c for x in w), total)
        assert r["base_score"] == pytest.approx(sum(math.log10((c[x] + 0.1) / (total + 0.1 * (distinct + 1))) for x in w), rel=1e-9)
    out = [got[i] for i, h in zip(ids, held) if h and i is not None and i >= len(odd_texts())]
    assert sum(r["score"] for r in out) > sum(r["base_score"] for r in out) + 0.2 * sum(r["n_tokens"] for r in out)


def test_model_is_a_distribution(spark):
    """Class and slot probabilities sum to one in every context."""
    rng = random.Random(1)
    rows = documents(spark, [prose(rng, 300, 2000) for _ in range(20)]).select("text")
    words = maxent_lm.materialize(maxent_lm.vocabulary(rows), "v")
    m = maxent_lm.fit(rows, words, steps=3)
    assert np.allclose((10.0**m.log_class).sum(axis=1), 1)
    per_class = np.zeros((m.sizes.contexts, m.sizes.classes))
    for c in range(m.sizes.classes):
        per_class[:, c] = (10.0 ** m.log_slot[:, m.slot_class == c]).sum(axis=1)
    assert np.allclose(per_class, 1)
    assert int(m.tail_total.sum() + m.head_counts.sum()) == m.total


def test_scores_equal_the_sum_over_tokens(spark):
    """Brute force: class and slot by the model's features, and the plain share within a slot of rare words."""
    rng = random.Random(3)
    texts = [prose(rng, 200, 3000) for _ in range(30)] + ["", "one"]
    rows = documents(spark, texts)
    words = maxent_lm.materialize(maxent_lm.vocabulary(rows.select("text")), "v")
    m = maxent_lm.fit(rows.select("text"), words, steps=2)
    n = {r["h"]: r["n"] for r in words.collect()}
    features = maxent_lm._pair_features(m.sizes)
    got = {r["doc_id"]: r["score"] for r in maxent_lm._scores(m, words, rows.select("doc_id", F.lit(False).alias("held_out"), "text")).collect()}
    for k, t in enumerate(texts):
        data = np.frombuffer(t.encode(), np.uint8)
        doc, h, shape = maxent_lm.tokens(data, np.array([0, len(data)]))
        slot, score = m.slots(h, shape), 0.0
        b1, b2 = m.contexts(doc, slot, shape)
        for j in range(len(h)):
            assert features[b2[j] * m.sizes.contexts + b1[j]][1:3].tolist() == [1 + b1[j], 1 + m.sizes.contexts + b2[j]]
            score += m.log_class[b2[j] * m.sizes.contexts + b1[j], m.slot_class[slot[j]]] + m.log_slot[b1[j], slot[j]]
            if (tail := slot[j] - m.sizes.heads) >= 0:
                score += math.log10((n[int(h[j : j + 1].view(np.int64)[0])] + 0.1) / (m.tail_total[tail] + 0.1 * (m.tail_distinct[tail] + 1)))
        assert got[k] == pytest.approx(score, rel=1e-6)


def test_sizes_follow_the_vocabulary():
    small, middle, large = (maxent_lm.Sizes.of(v) for v in (1000, 10**6, 10**9))
    assert small.contexts < middle.contexts < large.contexts and small.slots < middle.slots < large.slots and small.trigrams < middle.trigrams < large.trigrams


def test_language_model_of_nothing(spark):
    assert maxent_lm.score_documents(documents(spark, ["a"]).limit(0)).count() == 0
    assert maxent_lm.score_documents(documents(spark, ["a b", "a b"], [None, None])).first()["train_tokens"] == 0


def labelled(spark, n=600, seed=2):
    rng = random.Random(seed)
    texts, labels = [], []
    for k in range(n):
        bad = k % 5 == 0
        w = prose(rng, rng.randrange(60, 200)).split()
        if bad:
            for _ in range(6):
                w[rng.randrange(len(w))] = rng.choice(["slur", "insult", "trash"])
        texts.append(" ".join(w))
        if k % 2 == 0:
            labels.append((k, 1, int(bad)))
    return texts, spark.createDataFrame([*labels, (None, 1, 0), (10**9, 0, 0), (2, 1, 0)], "doc_id long, quality int, toxic int")


def test_quality_classifier(spark):
    texts, labels = labelled(spark)
    texts += [None, ""]
    df = documents(spark, texts)
    kept = {r["doc_id"] for r in resampling.keep_quality(df, labels).collect()}
    good = {k for k in range(len(texts)) if k % 5 or k >= 600}
    assert len(good - kept) <= 6 and len(kept - good) <= 6
    weighed, _, least = resampling.resample(df, labels)
    assert {r["doc_id"] for r in weighed.filter(F.col("gumbel_key") >= least).collect()} == kept
    assert resampling.resample(df, labels, k=100)[0].count() == len(texts)
    assert weighed.filter(F.col("gumbel_key") >= resampling.resample(df, labels, k=100)[2]).count() == 100


def test_weights_equal_the_models_by_definition(spark):
    """Features as strings, counts of documents, the two models' centred ratio, its test, and its sum over a text.

    The texts have few different words, so that no two features share a bucket.
    """
    texts, labels = labelled(spark, 400)
    texts = [re.sub(r"w(\d+)", lambda m: f"w{int(m[1]) % 20}", t) for t in texts]
    texts += [None, "", "spam spam, spam spam - spam spam longerwords longerword", "Good!! words-- " * 50]
    model = resampling.fit(documents(spark, texts), labels)

    def features(t):
        tokens = re.findall(r"[a-z0-9]+|[^a-z0-9\s]+", (t or "").lower())
        plain = [w for w in tokens if w[0].isalnum()]
        five = ["five" for k in range(len(plain) - 4) if len(set(plain[k : k + 5])) == 1]
        return tokens + [("stem", w[:6]) for w in plain if len(w) > 6] + list(zip(tokens, tokens[1:])) + five

    target = {r["doc_id"] for r in labels.collect() if r["quality"] == 1 and not r["toxic"]}
    raw, good = Counter(), Counter()
    for k, t in enumerate(texts):
        raw.update(set(features(t)))
        if k in target:
            good.update(set(features(t)))
    share = sum(good.values()) / sum(raw.values())
    ratio = {f: math.log((good[f] + 0.5) / (raw[f] * share + 0.5)) for f in raw}
    centre = sum(ratio[f] * good[f] for f in raw) / sum(good.values())
    expected = {f: raw[f] * share * math.exp(centre) for f in raw}
    least = NormalDist().inv_cdf(1 / max(10, sum(e >= 6 for e in expected.values())))
    weight = {f: ratio[f] - centre for f in raw if ratio[f] - centre < -0.7 and (good[f] - expected[f]) / math.sqrt(expected[f] + 0.5) < least}
    assert weight
    for r in resampling.weigh(documents(spark, texts), model).collect():
        mine = features(texts[r["doc_id"]])
        assert r["n_features"] == len(mine)
        assert r["log_weight"] == pytest.approx(sum(weight.get(f, 0.0) for f in mine) + model.offset + model.per_feature * len(mine), abs=1e-6)


def test_quality_without_evidence_keeps_all(spark):
    texts, labels = labelled(spark, 40)
    df = documents(spark, texts)
    assert resampling.keep_quality(df, labels.limit(0)).count() == 40
    assert resampling.keep_quality(df.limit(0), labels).count() == 0


def test_kth_largest(spark):
    rng = random.Random(3)
    values = [rng.gauss(0, 1) for _ in range(500)] + [0.5] * 50
    df = spark.createDataFrame([(v,) for v in values], "v double")
    for k in (1, 7, 250, 549):
        assert resampling.kth_largest(df, "v", k, bins=8, few=20) == sorted(values, reverse=True)[k - 1]
    assert resampling.kth_largest(df, "v", 550) == float("-inf") and resampling.kth_largest(df, "v", 0) == float("inf")


PLAIN = {
    "email": (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda s: True),
    "ip": (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda s: all(int(x) <= 255 for x in s.split("."))),
    "card": (r"[0-9]([\x20-]?[0-9])+", lambda s: 13 <= len(re.sub("[^0-9]", "", s)) <= 19 and luhn(re.sub("[^0-9]", "", s))),
    "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", lambda s: 9 <= len(re.sub("[^0-9]", "", s)) <= 15),
}


def luhn(digits):
    total = 0
    for k, c in enumerate(reversed(digits)):
        v = int(c) * (1 + k % 2)
        total += v - 9 if v > 9 else v
    return total % 10 == 0


def brute_spans(t):
    return [f"{kind}:{m.start()}:{m.end()}" for kind, (p, ok) in PLAIN.items() for m in re.finditer(p, t or "", re.A) if ok(m[0])]


def test_base_entities_equal_the_plain_patterns(spark):
    texts = [*odd_texts(), "é a.b@c.d.e_f@g.hi x@y a@b.com-x@y.z 1.2.3.4.5 256.1.1.1 0001.2.3.000255 𝄞 4111 1111-1111 1111 4111111111111112 +1 (743) 555-3824. +12 +1234567890123456 a@b.c_d@e.f", "1" * 5000 + "@", "9" * 20_000, "1.1." * 3000, "a@" * 2000 + "b.c", "+1 2" * 800, "1 " * 6000]
    rng = random.Random(5)
    texts += ["".join(rng.choice("12.@a+- (_") for _ in range(200)) for _ in range(60)]
    for r in pii.find_pii(documents(spark, texts)).collect():
        want = brute_spans(texts[r["doc_id"]])
        base = [s for s in r["spans"].split(",") if s and not s.startswith("id:")]
        assert base == want and r["base_sha256"] == hashlib.sha256(",".join(want).encode()).hexdigest()
        assert [r["n_email"], r["n_ip"], r["n_card"], r["n_phone"]] == [sum(s.startswith(k) for s in want) for k in PLAIN]


def test_contexts_find_unseen_identifiers(spark):
    rng = random.Random(9)
    ips = [f"10.0.{k}.{k + 1}" for k in range(30)]
    texts = [f"{prose(rng, 5)} call me at +1 202 555 {1000 + k} now please {prose(rng, 5)}" for k in range(30)]
    texts += [f"{prose(rng, 5)} call me at 202555{1000 + k} now please" for k in range(4)]
    texts += [f"{prose(rng, 5)} order 202555{1000 + k} came {prose(rng, 4)}" for k in range(4)] + ips
    got = {r["doc_id"]: r for r in pii.find_pii(documents(spark, texts)).collect()}
    assert [got[k]["n_id"] for k in range(30, 34)] == [1] * 4
    assert all(got[k]["n_id"] == 0 for k in range(34, 38))
    start = int(got[30]["spans"].split(":")[1])
    assert texts[30][start:].startswith("2025551000")
    assert pii.find_pii(documents(spark, texts).limit(0)).count() == 0


def test_spans_have_their_words_in_the_whole_text(spark):
    """Positions and words around each match against Python's, with matches beside each other and words of any length."""
    rng = random.Random(13)
    bits = ["no", "visa", "A1B2C3D4", "4-7-1-9-X", "AB123456", "x" * 90, "2024-01-05", ",", ";", "\n", "é", "Nr.", "😀", "9" * 70, "a_b"]
    texts = ["".join(rng.choice(bits) + rng.choice(["", " ", " ", " "]) for _ in range(rng.randrange(1, 40))) for _ in range(150)]
    texts += ["no visa AB123456 visa CD789012", "A1B2C3D4", "", "AB123456 " * 3000]
    rows = spark.createDataFrame(list(enumerate(texts)), "k int, text string").select("k", pii.spans(F.col("text"), pii.CANDIDATE).alias("s"))
    for r in rows.collect():
        t = texts[r["k"]]
        want = [m.span() for m in re.finditer(r"(?<![0-9A-Za-z_-])[0-9A-Za-z_-]{6,}", t) if len(re.sub("[^0-9]", "", m[0])) >= 4]
        assert [(s["start"], s["end"]) for s in r["s"]] == want
        for s in r["s"]:
            left, right = re.findall(r"\w+", t[: s["start"]]) if len(r["s"]) < 100 else re.findall(r"\w+", t[max(0, s["start"] - 40) : s["start"]]), re.findall(r"\w+", t[s["end"] : s["end"] + 300])
            assert (s["before1"], s["after1"]) == ((left or [""])[-1], (right or [""])[0])
            assert s["before2"] == (left[-2] if len(left) > 1 else "")


def test_graph_scores_by_definition(spark):
    rng = random.Random(3)
    seeds = {f"i{k}" for k in range(0, 12)}
    edges = {(f"p{rng.randrange(8)}", f"i{rng.randrange(30)}"): rng.randrange(1, 5) for _ in range(120)}
    rows = [(p, i, n, i in seeds) for (p, i), n in edges.items()]
    patterns, instances = pii.score_graph(spark.createDataFrame(rows, "pattern string, instance string, n long, seed boolean"))
    score = {i: float(i in seeds) for _, i in edges}
    for _ in range(3):
        conf = {}
        for p in {p for p, _ in edges}:
            of = [i for q, i in edges if q == p]
            conf[p] = sum(score[i] for i in of) / (len(of) + 2) if sum(i in seeds for i in of) >= 3 else 0.0
        score = {i: 1.0 if i in seeds else sum(conf[p] * n for (p, j), n in edges.items() if j == i) / sum(n for (_, j), n in edges.items() if j == i) for i in score}
    assert {r["pattern"]: r["confidence"] for r in patterns.collect()} == pytest.approx(conf)
    assert {r["instance"]: r["score"] for r in instances.collect()} == pytest.approx(score)


def test_contexts_reach_across_matches(spark):
    """Identifiers in lists, of any length and with digits apart, whose words before are in the match before."""
    cards = [c for k in range(400) if luhn(c := str(4000000000000000 + 7 * k))]
    texts = [f"my visa {a} visa {b} end" for a, b in zip(cards[::2], cards[1::2])][:5]
    texts += ["no visa AB123456 visa CD789012 end", "his visa A1B2C3D4 visa 4-7-1-9-X", "a visa AB123456 visa " + "Z" * 70 + "1234 end", "the part KT123456 works, part KT789012 too"]
    got = {r["doc_id"]: r for r in pii.find_pii(documents(spark, texts)).collect()}

    def ids(k):
        return [texts[k][int(a) : int(b)] for kind, a, b in (s.split(":") for s in got[k]["spans"].split(",") if s) if kind == "id"]

    assert "CD789012" in ids(5) and "4-7-1-9-X" in ids(6) and "Z" * 70 + "1234" in ids(7) and ids(8) == []


def test_licences(spark):
    mit = " ".join(s for k, s in license_scan.ALL_SENTENCES if k in ("mit.grant", "mit.notice", "mit.warranty"))
    texts = [*odd_texts(), "Code.\nReleased under the MIT License.\nMore", mit, mit.replace(" ", "\n"), "LICENSED under  CC BY-NC 4.0!", "Licensed under the Apache License, Version 2.0. x. y. Licensed under CC BY 4.0.", "not licensed"]
    n = len(odd_texts())
    got = license_scan.scan_licenses(documents(spark, texts), license_scan.sentence_table(spark), license_scan.rule_table(spark)).collect()
    assert sorted((r["doc_id"] - n, r["license"], r["rule"]) for r in got) == [(0, "MIT", "mit-released"), (1, "MIT", "mit-text"), (3, "CC-BY-NC-4.0", "cc-by-nc-notice"), (4, "Apache-2.0", "apache-notice"), (4, "CC-BY-4.0", "cc-by-notice")]


def test_every_licence_rule_fires_plain_and_wrapped(spark):
    said = dict(license_scan.ALL_SENTENCES)
    texts = []
    for _, _, ids in license_scan.ALL_RULES:
        plain = [said[i] for i in ids]
        wrapped = ["\n".join(textwrap.wrap(s, 40)) for s in plain]
        texts += ["\n".join(plain), "\n\n".join(plain), "Some title\n" + "\n\n".join(wrapped), "/*\n * " + "\n *\n".join(wrapped).replace("\n", "\n * ") + "\n */\ncode()", "\r\n".join(wrapped).replace("\n", "\r\n").replace("\r\r", "\r")]
    got = license_scan.scan_licenses(documents(spark, texts), license_scan.sentence_table(spark), license_scan.rule_table(spark)).collect()
    assert sorted((r["doc_id"], r["license"], r["rule"]) for r in got) == [(k, *license_scan.ALL_RULES[k // 5][1::-1]) for k in range(len(texts))]


def test_licence_scan_equals_its_sql(spark):
    rng = random.Random(7)
    said = [s for _, s in license_scan.ALL_SENTENCES]
    other = ["foo bar.", "é -- x", "--", "* *\n", "", "\u212a\u212a a; b: c", "All\nrights\nreserved.", " \t \u000b x \u000c y"]
    texts = odd_texts()
    for _ in range(400):
        parts = []
        for _ in range(rng.randrange(1, 9)):
            s = rng.choice([*said, *other * 2])
            parts.append("\n".join(textwrap.wrap(s, rng.choice([10, 30, 60]))) if rng.random() < 0.4 else s)
            parts.append(rng.choice([" ", "\n", "\n\n", "\r\n", "\r", "\n# ", ". ", " -- "]))
        texts.append("".join(parts))
    for rule in license_scan.ALL_RULES:
        texts.append("\n".join(dict(license_scan.ALL_SENTENCES)[i] for i in rule[2]))
    rows = documents(spark, texts)
    got = license_scan.scan_licenses(rows, license_scan.sentence_table(spark), license_scan.rule_table(spark))
    con = duckdb.connect()
    con.register("documents", rows.select("doc_id", "text").toArrow())
    found = con.execute(license_scan.ORACLE_OP8)
    assert [c[0] for c in found.description] == got.columns
    assert sorted(map(tuple, got.collect())) == sorted(found.fetchall())


def test_licence_lines_without_stops_still_match(spark):
    texts = ["A title\nLicensed under CC BY 4.0\nand more of it", "Licensed under\n\nCC BY 4.0.", "Licensed under. CC BY 4.0.", "so licensed under\nCC BY 4.0.", "a b\nc d\ne f\ng h\nLicensed under CC BY 4.0."]
    got = license_scan.scan_licenses(documents(spark, texts), license_scan.sentence_table(spark), license_scan.rule_table(spark)).collect()
    assert sorted((r["doc_id"], r["rule"], r["first_sentence"], r["last_sentence"]) for r in got) == [(0, "cc-by-notice", 1, 1), (4, "cc-by-notice", 4, 4)]


def test_licence_rules_are_ordered_and_bounded(spark):
    known = spark.createDataFrame([("a", "x"), ("b", "y"), ("c", "z")], "sentence string, sentence_id string")
    rules = spark.createDataFrame([("r1", "L1", ["x", "y"]), ("r2", "L2", ["x"]), ("r3", "L3", ["x", "y", "z"])], "rule string, license string, ids array<string>")
    texts = ["a. b. c.", "b. a.", "a. q. q. b.", "a. q. q. q. b.", "a. a. b."]
    got = license_scan.scan_licenses(documents(spark, texts), known, rules).collect()
    assert sorted((r["doc_id"], r["rule"], r["first_sentence"], r["last_sentence"]) for r in got) == [(0, "r3", 0, 2), (1, "r2", 1, 1), (2, "r1", 0, 3), (3, "r2", 0, 0), (4, "r1", 1, 2), (4, "r2", 0, 0)]


def pages(spark, *urls):
    return spark.createDataFrame([(k, u, "h", "p") for k, u in enumerate(urls)], "page_id long, url string, host string, verdict string")


def test_urls(spark):
    urls = [
        "http://A.Example.net/en/1", "http://x.net/a", "http://x.net", "https://a.example.com/de/1", "https://a.example.com/fr/1", "http://b.org/fr/x?y", "http://notexample.net.org/fr/", "no scheme", None, "",
        "http://cheap-pills.example.com/en/", "http://www.CHEAP-pills.example.net/en/1", "http://my-cheap-pills.example.com/de/", "http://a.com/?u=1&utm_source=spam#x", "http://a.com/?utm_source=spammer", "http://a.com/x/phishing/y", "http://casino77.com/", "ftp://user@h:21?x/net/", "http://a.com/?q=http://cheap-pills.com",
        "http://x.net/a", "http://%%/" + "a/" * 20_000,
    ]
    got = {r["page_id"]: r for r in url_filter.judge_urls(pages(spark, *urls), url_filter.rule_table(spark)).collect()}
    for k, u in enumerate(urls):
        u = u or ""
        rest = u.split("://", 1)[1] if "://" in u else ""
        host, path = re.match(r"([^/?#]*)([^?#]*)", rest).groups()
        host = re.sub("[A-Z]", lambda m: m[0].lower(), host)
        fits = [(len(h + p), h + p, v) for h, p, v in url_filter.HOST_RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
        low = re.sub("[A-Z]", lambda m: m[0].lower(), u)
        found = [v for p, v in url_filter.PATTERN_RULES if re.search(p, low)]
        rule, verdict = max(fits)[1:] if fits else (None, "block" if "block" in found else "allow")
        assert (got[k]["host"], got[k]["path"], got[k]["rule"], got[k]["verdict"]) == (host, path, rule, verdict), u


def test_literals_are_in_every_match(spark):
    patterns = [r"://([^/?#]*[.-])?cheap-pills\.", r"/phishing/", r"[?&]utm_source=spam(&|#|$)", r"casino[0-9]*\.", r"a.b", r"/(x|y)/z/", r"/wp-login\.php([?#]|$)", r"ab?c/", r"\d+/abc/"]
    df = spark.createDataFrame([(p,) for p in patterns], "p string")
    got = {r[0]: set(r[1]) for r in df.select("p", url_filter.literal_tokens(F.col("p"))).collect()}
    assert "pills" in got[patterns[0]] and got[patterns[1]] == {"phishing"} and "z" in got[patterns[5]] and "wp" in got[patterns[6]]
    more = {r"/a.b/": set(), r"x|/y/": set(), r"/x(foo)?cheap/z/": {"z"}, r"/q\.?r/s\d/": set(), r"/s\\d/": {"s", "d"}, r"^http://t\.u/": {"http", "t", "u"}, r"/[(]v/w+/y{0,1}z/": set()}
    tokens = spark.createDataFrame([(p,) for p in more], "p string").select("p", url_filter.literal_tokens(F.col("p"))).collect()
    assert {r[0]: set(r[1]) for r in tokens} == more
    assert "casino" not in got[patterns[3]] and "spam" not in got[patterns[2]] and "b" not in got[patterns[4]]
    with pytest.raises(ValueError):
        url_filter.judge_urls(pages(spark, "x"), url_filter.rule_table(spark), most_rules=2)
    assert url_filter.judge_urls(pages(spark, "x").limit(0), url_filter.rule_table(spark)).count() == 0


def test_mixing(spark):
    texts = [f"d{k}" for k in range(3000)]
    df = documents(spark, texts, source=lambda k: None if k % 50 == 0 else "big" if k % 3 else f"s{k % 7}")
    got = mixing.mix_sources(df, temperature=2.0)
    rates = {r["source"]: (r["n"], r["mean"]) for r in mixing.repetition_rates(df).collect()}
    assert sum(n * m for n, m in rates.values()) == pytest.approx(3000)
    counts = {r["source"]: r["count"] for r in got.groupBy("source").agg(F.count("*").alias("count")).collect()}
    for s, (n, m) in rates.items():
        assert abs(counts.get(s, 0) - n * m) <= 5 * math.sqrt(n * m)
    assert set(got.columns) == {*df.columns, "_copy", "_place"}
    again = mixing.mix_sources(df.repartition(7), temperature=2.0)
    assert sorted(map(tuple, again.select("doc_id", "_copy", "_place").collect())) == sorted(map(tuple, got.select("doc_id", "_copy", "_place").collect()))
    only = mixing.mix_sources(df, weights={"big": 1.0}, total=5000)
    assert {r["source"] for r in only.select("source").distinct().collect()} == {"big"} and abs(only.count() - 5000) < 400
    assert mixing.mix_sources(df.limit(0)).count() == 0
    joined = mixing.mix_sources(df, most_sources=1)
    assert joined.count() == got.count()


@pytest.mark.parametrize("mean", [0.1, 1.0, 7.5, 15.9])
def test_poisson_counts_invert_the_distribution(spark, mean):
    us = [k / 500 for k in range(500)] + [0.999999]
    df = spark.createDataFrame([(u,) for u in us], "u double")
    for r in df.select("u", mixing.poisson_count(F.col("u"), F.lit(mean)).alias("n")).collect():
        p = cdf = math.exp(-mean)
        n = 0
        while cdf <= r["u"]:
            n += 1
            p *= mean / n
            cdf += p
        assert r["n"] == n


def test_words_are_those_of_the_helpers():
    import pyarrow as pa

    from tidemill.llm import textvec as tv

    texts = [t or "" for t in odd_texts()]
    for lo, hi, data, offsets in tv.slices(pa.array(texts), 5000):
        s, e, d, h = tv.words(data, offsets)
        low = tv.LOWER[data].tobytes()
        for k in range(hi - lo):
            assert [low[a:b].decode() for a, b, x in zip(s, e, d) if x == k] == words(texts[lo + k])
        assert len({*zip((low[a:b] for a, b in zip(s, e)), h.tolist())}) == len(set(h.tolist()))
