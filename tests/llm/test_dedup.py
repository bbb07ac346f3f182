import hashlib
import itertools
import random
import re
from collections import defaultdict

import numpy as np
import pytest
from helpers import documents, odd_texts, prose, words
from pyspark.sql import functions as F

from tidemill.llm import chosen_path, exact_dedup, graph, substring_dedup
from tidemill.llm.suffix_array import permuted_common_prefixes, suffix_array


def normal(t):
    return re.sub(r"[\x20\x09-\x0D]+", " ", t or "")


@pytest.mark.parametrize("digest_bytes", [16, 1])
def test_exact_groups_equal_brute_force(spark, digest_bytes):
    rng = random.Random(3)
    texts = odd_texts() + [prose(rng, 900, 40) for _ in range(4)] * 2
    ids = [100 - k for k in range(len(texts))]
    got = exact_dedup.exact_groups(documents(spark, texts, ids), mean_bytes=100, digest_bytes=digest_bytes).collect()
    groups = defaultdict(list)
    for i, t in zip(ids, texts):
        groups[normal(t)].append(i)
    want = sorted((i, min(groups[normal(t)]), len(groups[normal(t)]), i == min(groups[normal(t)]), hashlib.sha256(normal(t).encode()).hexdigest()) for i, t in zip(ids, texts))
    assert sorted((r["doc_id"], r["keep_id"], r["group_size"], r["kept"], r["text_sha256"]) for r in got) == want


def test_repeated_rows_and_null_ids_keep_one_row(spark):
    df = documents(spark, ["a b", "a  b", "a b", "z", "z"], [5, 5, None, None, None])
    kept = [(r["doc_id"], r["keep_id"], r["group_size"]) for r in exact_dedup.exact_groups(df).filter("kept").collect()]
    assert sorted(kept, key=str) == [(5, 5, 3), (None, None, 2)]
    dropped = exact_dedup.drop_exact_copies(df)
    assert dropped.columns == df.columns and dropped.count() == 2
    assert exact_dedup.exact_groups(df.limit(0)).count() == 0


def test_too_many_collisions_are_refused(spark):
    rng = random.Random(5)
    df = documents(spark, [prose(rng, 400) for _ in range(30)])
    with pytest.raises(ValueError):
        exact_dedup.exact_groups(df, mean_bytes=64, digest_bytes=1, most_collided=3)


def brute_classes(texts, threshold=0.8, n=5):
    sets = []
    for t in texts:
        w = words(t)
        sets.append({tuple(w[k : k + n]) for k in range(len(w) - n + 1)} or ({tuple(w)} if w else set()))
    parent, links = list(range(len(texts))), defaultdict(set)

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in itertools.combinations(range(len(texts)), 2):
        if sets[a] and len(sets[a] & sets[b]) >= threshold * len(sets[a] | sets[b]) - 1e-9:
            parent[max(find(a), find(b))] = min(find(a), find(b))
            if texts[a] != texts[b]:
                links[a].add(texts[b])
                links[b].add(texts[a])
    return [(find(k), len(links[k])) for k in range(len(texts))]


def variants(rng, base, n, most):
    out = []
    for _ in range(n):
        w = base.split()
        for _ in range(rng.randrange(most)):
            w[rng.randrange(len(w))] = f"v{rng.randrange(10_000)}"
        out.append(" ".join(w))
    return out


@pytest.mark.parametrize("bucket,block", [(40, 128), (4, 6)])
def test_near_copies_equal_brute_force(spark, bucket, block):
    """Also with tiny buckets, which make every level and every pair of blocks occur."""
    rng = random.Random(11)
    texts = odd_texts()
    shared = prose(rng, 60)
    texts += [shared + " " + prose(rng, 100) for _ in range(25)]  # a passage that many share
    for _ in range(6):
        texts += variants(rng, prose(rng, 150), 8, 6)
    texts += variants(rng, prose(rng, 200), 40, 3)
    got = {r["doc_id"]: (r["class_id"], r["n_links"]) for r in chosen_path.jaccard_classes(documents(spark, texts), bucket=bucket, block=block).collect()}
    want = dict(enumerate(brute_classes(texts)))
    assert got == want


def test_long_chains_of_different_sets_meet_at_shared_shingles(spark):
    """Windows along one text: a component in which only neighbours are linked. What is copied grows with the sets, not with their square."""
    rng = random.Random(31)
    copied = []
    for n in (250, 1000):
        w = [f"c{k}" for k in range(4 * n + 60)]
        texts = [" ".join(w[4 * k : 4 * k + 60]) for k in range(n)] + list(dict.fromkeys(variants(rng, prose(rng, 150), 60, 4)))
        want = dict(enumerate(brute_classes(texts)))
        if n == 250:
            assert {r["doc_id"]: (r["class_id"], r["n_links"]) for r in chosen_path.jaccard_classes(documents(spark, texts), block=4).collect()} == want
        embedded = documents(spark, texts).selectExpr("doc_id AS row", "doc_id", "text").mapInArrow(chosen_path._embed(5), "row long, doc_id long, n_shingles int, set_hash binary, text_hash binary, signature binary, sketch binary, shingles binary")
        members = embedded.selectExpr("row AS rep", f"if(row < {n}, 0L, {n}L) AS label", "n_shingles", "1L AS texts")
        seen = []
        keep = chosen_path._at_shared
        try:
            chosen_path._at_shared = lambda *a: seen.append(keep(*a)) or seen[-1]
            links = chosen_path._counted_links(embedded.selectExpr("row AS rep", "shingles"), members, 0.8, 4).groupBy("rep").sum("links").collect()
        finally:
            chosen_path._at_shared = keep
        assert {r[0]: r[1] for r in links} == {k: m for k, (_, m) in want.items() if m}
        assert {r["label"] for r in seen[0].select("label").distinct().collect()} == {0}
        copied.append(seen[0].count())
    assert copied[1] < 5 * copied[0]


def test_deep_buckets_keep_the_recall(spark):
    """Texts that share half of their shingles with all others, in buckets of three rows: pairs are split many times."""
    rng = random.Random(4)
    shared, texts = prose(rng, 300), []
    for _ in range(150):
        own = prose(rng, 100)
        texts += [f"{shared} {own}", f"{shared} {own} {prose(rng, 60)}"]
    got = {r["doc_id"]: (r["class_id"], r["n_links"]) for r in chosen_path.jaccard_classes(documents(spark, texts), bucket=3).collect()}
    want = dict(enumerate(brute_classes(texts)))
    assert sum(n for _, n in want.values()) >= 300 and got == want


def test_near_copies_of_nothing_and_of_repeated_rows(spark):
    df = documents(spark, ["a b c d e f", "a b c d e f", "", None], [4, 4, 1, 1])
    assert chosen_path.jaccard_classes(df.limit(0)).count() == 0
    assert sorted((r["doc_id"], r["class_id"], r["n_links"]) for r in chosen_path.jaccard_classes(df).collect()) == [(1, 1, 0), (1, 1, 0), (4, 4, 0), (4, 4, 0)]
    kept = chosen_path.drop_near_copies(df)
    assert kept.columns == df.columns and sorted(r["doc_id"] for r in kept.collect()) == [1, 1, 4]


def test_runs_reach_the_recall():
    assert chosen_path.runs_needed(0.8, 0.999) > chosen_path.runs_needed(0.8, 0.9) > 1


def test_recall_around_a_hot_group(spark):
    """Pairs of just over 0.8 that share a passage with a large group of near copies: measured against brute force."""
    rng = random.Random(8)
    hot = prose(rng, 150, 4000)
    texts = variants(rng, hot, 300, 25)
    for _ in range(250):
        own = prose(rng, 110, 4000).split()
        other = list(own)
        other[rng.randrange(40, 70)] = "x"
        shared = " ".join(hot.split()[:90])
        texts += [f"{shared} {' '.join(own)}", f"{shared} {' '.join(other)} {prose(rng, 14, 4000)}"]
    want = brute_classes(texts)
    got = {r["doc_id"]: (r["class_id"], r["n_links"]) for r in chosen_path.jaccard_classes(documents(spark, texts), bucket=8).collect()}
    found = sum(min(got[k][1], n) for k, (_, n) in enumerate(want))
    assert found >= 0.995 * sum(n for _, n in want) and sum(n for _, n in want[300:]) > 300
    assert all(got[k][1] <= n for k, (_, n) in enumerate(want))


def test_what_goes_down_the_tree_is_split_once(spark, monkeypatch):
    """The children of a level's buckets are made once, however often they are read."""
    rng = random.Random(8)
    line = prose(rng, 40, 4000)
    made, wanted = spark.sparkContext.accumulator(0), []
    split, write = chosen_path._next_level, chosen_path.materialize

    def counted(share):
        run = split(share)

        def count(batches):
            for batch in batches:
                made.add(batch.num_rows)
                yield batch

        return lambda batches: run(count(batches))

    def written(df, name):
        out = write(df, name)
        if name == "left":
            wanted.append(out.filter(F.col("others") > 8 << min(len(wanted), 3)).count())
        return out

    monkeypatch.setattr(chosen_path, "_next_level", counted)
    monkeypatch.setattr(chosen_path, "materialize", written)
    chosen_path.jaccard_classes(documents(spark, [f"{line} {prose(rng, 40, 4000)}" for _ in range(120)]), bucket=8, levels=5).count()
    assert made.value == sum(wanted[:4]) > 100


def test_shuffled_rows_give_the_same_copies(spark):
    rng = random.Random(6)
    texts = odd_texts() + variants(rng, prose(rng, 100), 20, 5)
    df = documents(spark, texts)
    assert sorted(map(str, chosen_path.drop_near_copies(df).collect())) == sorted(map(str, chosen_path.drop_near_copies(df.repartition(3, "text")).collect()))


def test_components(spark):
    rng = random.Random(2)
    edges = [(k, k + 1) for k in range(30)] + [(100, 200), (200, 150), (7, 7)] + [(500, 500 + k) for k in range(1, 40)]
    rng.shuffle(edges)
    got = {r["node"]: r["component"] for r in graph.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    want = dict.fromkeys(range(31), 0) | dict.fromkeys((100, 150, 200), 100) | dict.fromkeys(range(500, 540), 500)
    assert got == want
    assert graph.connected_components(spark.createDataFrame([(1, 1)], "a long, b long")).count() == 0


def test_suffix_arrays():
    rng = np.random.default_rng(1)
    for trial in range(150):
        t = rng.integers(0, rng.integers(1, 5), rng.integers(1, 70)).astype(np.uint8) + 97
        t = np.tile(t[:9], 6) if trial % 3 == 0 else t
        b = t.tobytes()
        order = suffix_array(t)
        assert list(order) == sorted(range(len(b)), key=lambda k: b[k:])
        phi, common = permuted_common_prefixes(t, order, 20)
        for at, before in zip(order[1:], order[:-1]):
            n = 0
            while n < 20 and b[at + n : at + n + 1] == b[before + n : before + n + 1] != b"":
                n += 1
            assert (phi[at], common[at]) == (before, n)


def brute_removed(texts, length):
    seen, out = set(), []
    for t in texts:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for s in range(len(b) - length + 1):
            if b[s : s + length] in seen:
                gone[s : s + length] = b"\1" * length
            seen.add(b[s : s + length])
        runs = sum(1 for k in range(len(b)) if gone[k] and (k == 0 or not gone[k - 1]))
        out.append((len(b), sum(gone), runs, hashlib.sha256(bytes(c for c, g in zip(b, gone) if not g)).hexdigest()))
    return out


@pytest.mark.parametrize(("shard_bytes", "hot_segments"), [(1 << 21, 4096), (500, 4096), (500, 0), (1 << 21, 64)])
def test_repeated_strings_equal_brute_force(spark, shard_bytes, hot_segments):
    rng = random.Random(7)
    passages = [prose(rng, 45, 5000) for _ in range(5)]
    texts = odd_texts() + [" ".join(x for k in range(4) for x in (prose(rng, rng.randrange(5, 60)), rng.choice(passages))) for _ in range(25)]
    line = prose(rng, 16, 5000)[:64]
    texts += ["ab" * 400, "ab" * 90, "é" * 120, "short", *(f"{prose(rng, 30, 9)} {line} {prose(rng, 30, 9)}" for _ in range(40))]
    ids = list(range(len(texts)))
    rng.shuffle(ids)
    got = {r["doc_id"]: tuple(r)[1:] for r in substring_dedup.remove_repeats(documents(spark, texts, ids), shard_bytes=shard_bytes, hot_segments=hot_segments).collect()}
    order = sorted(range(len(texts)), key=lambda k: ids[k])
    want = {ids[k]: w for k, w in zip(order, brute_removed([texts[k] for k in order], 100))}
    assert got == want


def test_repeated_strings_of_nothing_and_of_repeated_rows(spark):
    text = prose(random.Random(1), 60)
    assert substring_dedup.remove_repeats(documents(spark, ["x"]).limit(0)).count() == 0
    got = substring_dedup.remove_repeats(documents(spark, [text, text, text], [3, 3, None])).collect()
    assert sorted((str(r["doc_id"]), r["n_removed"]) for r in got) == [("3", 0), ("3", len(text)), ("None", len(text))]


def test_cuts_follow_the_text(spark):
    """A chunk list is the same wherever its text stands in a batch."""
    rng = random.Random(9)
    texts = [prose(rng, 500) for _ in range(5)]
    alone = [exact_dedup.exact_groups(documents(spark, [t])).first()["text_sha256"] for t in texts]
    together = {r["doc_id"]: r["text_sha256"] for r in exact_dedup.exact_groups(documents(spark, texts)).collect()}
    assert [together[k] for k in range(5)] == alone
    assert exact_dedup.exact_groups(documents(spark, texts + texts)).filter("kept").select(F.sum("group_size")).first()[0] == 10
