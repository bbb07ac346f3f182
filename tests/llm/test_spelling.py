import random
import re
import zlib
from collections import Counter

import numpy as np

from helpers import documents, odd_texts
from tidemill.llm.spelling import near_pairs, spelling_variants


def one_edit(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute(texts, shortest=7, least=2, every=31):
    n = Counter()
    for i, t in texts:
        for r in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            r = re.sub("[A-Z]", lambda m: m[0].lower(), r)
            h = zlib.crc32(f"{i}:{r}".encode())
            if h % every == 0:
                r = r[: h % len(r)] + r[h % len(r) + 1 :]
            n[r] += 1
    n = {w: c for w, c in n.items() if len(w) >= shortest and c >= least}
    near = {w: [x for x in n if one_edit(w, x)] for w in n}
    form = {}
    for w, xs in near.items():
        best = min(xs, key=lambda x: (-n[x], x), default=None)
        form[w] = best if best is not None and n[best] >= 10 * n[w] else None
    out = {}
    for w in n:
        root = w
        while form[root] is not None:
            root = form[root]
        out[w] = (root, n[w], len(near[w]), form[w], n[form[w]] if form[w] else None)
    return out


def check(spark, texts, **options):
    got = spelling_variants(documents(spark, texts).repartition(3), **options)
    assert got.columns == ["word", "root", "n", "n_near", "form", "form_n"]
    assert {r["word"]: tuple(r)[1:] for r in got.collect()} == brute(list(enumerate(texts)), **options)


def test_variants_equal_brute_force(spark):
    rng = random.Random(3)
    stems = ["".join(rng.choice("abéÿ") for _ in range(rng.randrange(6, 12))) for _ in range(40)]

    def noisy():
        w = rng.choice(stems[: rng.choice([3, 40])])
        for _ in range(rng.choice([0, 0, 0, 0, 0, 0, 1, 1, 2])):
            k = rng.randrange(len(w) + 1)
            w = rng.choice([w[:k] + rng.choice("abé×Z") + w[k:], w[:k] + w[k + 1 :], w[:k] + rng.choice("ABc") + w[k + 1 :]])
        return w

    texts = [rng.choice([" ", "1", "Ā", "\n"]).join(noisy() for _ in range(rng.randrange(200))) for _ in range(60)]
    check(spark, texts + odd_texts() + texts[:2])
    check(spark, texts[:30], shortest=3, least=1, every=5)


def test_long_words_and_chains(spark):
    rng = random.Random(4)
    long = "".join(rng.choice("abcdefgh") for _ in range(500))
    variants = [long, long[:100] + "x" + long[101:], long[:499], "y" + long, long[::-1], "x" * 30_000, "x" * 29_999]
    chain = ["mountain"] * 1000 + ["mountai"] * 100 + ["mountxi"] * 10 + ["moontxi"]
    check(spark, [" ".join(variants)] * 2 + [" ".join(chain)], least=1)


def test_one_large_group_of_near_words():
    words = sorted({f"prefix{a}{b}suffix".encode("latin-1") for a in "abcdefghijklmnopqrstuvwxyz" for b in "abcdefghijklmnopqrstuvwxyz"})
    tag = np.full(len(words), 14 * 64 + 3)
    i, j = near_pairs(np.zeros(len(words)), tag, words)
    want = {(a, b) for a in range(len(words)) for b in range(a) if one_edit(words[a], words[b])}
    assert {(max(p), min(p)) for p in zip(i.tolist(), j.tolist())} == want and len(i) == len(want)


def test_no_rows(spark):
    assert spelling_variants(documents(spark, [])).collect() == []
    assert spelling_variants(documents(spark, [None, "", "short words"])).collect() == []
