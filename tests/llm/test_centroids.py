import hashlib
import random

import numpy as np
import pytest

from tidemill.llm.centroids import Tree, cluster_vectors


def brute(vectors, k, rounds, dimensions, scale=1024):
    """(cluster, distance) by vector number, and the centroids, in plain integers."""
    kept = {i: [int(np.floor(scale * float(x))) for x in v] for i, v in vectors if v is not None and len(v) == dimensions and all(x is not None and np.isfinite(x) for x in v)}
    points = [kept[i] for i in sorted(kept, key=lambda i: hashlib.sha256(f"3:{i}".encode()).hexdigest())[:k]]

    def assign():
        return {i: min((sum((a - b) ** 2 for a, b in zip(v, p)), c) for c, p in enumerate(points)) for i, v in kept.items()}

    for _ in range(rounds):
        of = assign()
        for c in range(len(points)):
            mine = [kept[i] for i, (_, j) in of.items() if j == c]
            if mine:
                points[c] = [sum(col) // len(mine) for col in zip(*mine)]
    return assign(), points


@pytest.mark.parametrize("k", [1, 3, 8, 20])
def test_clusters_equal_brute_force(spark, k):
    rng = random.Random(k)
    vectors = [(i, [rng.choice([-0.5, 0.0, 0.25, rng.uniform(-1, 1)]) for _ in range(5)]) for i in range(150)]
    vectors += [(200 + i, [0.25] * 5) for i in range(40)]
    vectors += [(300, None), (301, []), (302, [0.1] * 4), (303, [0.1, None, 0.2, 0.3, 0.4]), (304, [float("nan")] * 5), (305, [float("inf")] + [0.0] * 4)]
    df = spark.createDataFrame([(i, v, "x", 7) for i, v in vectors], "vec_id long, embedding array<float>, id string, cluster int").repartition(3)
    got = {r["vec_id"]: r for r in cluster_vectors(df, k=k, rounds=4, dimensions=5).collect()}
    single = [(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v]) for i, v in vectors]
    want, points = brute(single, k, 4, 5)
    assert {i: (r["distance"], r["cluster"]) for i, r in got.items()} == want
    for i, r in got.items():
        assert r["centroid_sha256"] == hashlib.sha256(",".join(map(str, points[r["cluster"]])).encode()).hexdigest()
        assert r["cluster_inertia"] == sum(d for d, c in want.values() if c == r["cluster"])
        assert r["inertia"] == sum(d for d, _ in want.values())


def test_few_repeated_and_no_vectors(spark):
    schema = "vec_id long, embedding array<double>"
    assert cluster_vectors(spark.createDataFrame([], schema), dimensions=2).collect() == []
    one = spark.createDataFrame([(1, [0.5, 0.5]), (1, [0.5, 0.5]), (None, [2.0, 2.0])], schema)
    got = cluster_vectors(one, k=8, dimensions=2).collect()
    assert len(got) == 3 and {r["distance"] for r in got} == {0}
    with pytest.raises(Exception, match="smaller scale"):
        cluster_vectors(spark.createDataFrame([(1, [1e9, 0.0])], schema), dimensions=2).collect()


def test_the_tree_finds_the_least_number_among_ties():
    rng = np.random.default_rng(5)
    for n in (1, 4, 5, 9, 40, 200):
        points = rng.integers(-3, 4, (n, 3))
        x = rng.integers(-4, 5, (500, 3))
        who, best = Tree.over(points).nearest(x)
        far = ((x[:, None] - points[None]) ** 2).sum(2)
        assert (who == far.argmin(1)).all() and (best == far.min(1)).all()


def test_the_tree_visits_few_centroids_of_many():
    rng = np.random.default_rng(6)
    points = rng.integers(0, 100_000, (4096, 2))
    tree, seen = Tree.over(points), []
    visit = tree._visit
    tree._visit = lambda x, rows, c, who, best: (seen.append(len(rows)), visit(x, rows, c, who, best))[1]
    tree.nearest(rng.integers(0, 100_000, (200, 2)))
    assert sum(seen) < 200 * 4096 / 20


def test_a_cluster_without_a_shared_folder_is_an_error(spark):
    from types import SimpleNamespace

    from tidemill.llm.scratch import shared_folder

    fake = lambda master, folder: SimpleNamespace(conf=SimpleNamespace(get=lambda name, default: folder), sparkContext=SimpleNamespace(master=master))
    assert shared_folder(fake("spark://h:7077", "/shared")) == "/shared"
    assert shared_folder(fake("local[4]", None)) == shared_folder(fake("local", None))
    for master in ("spark://h:7077", "yarn", "local-cluster[2,1,1024]"):
        with pytest.raises(ValueError):
            shared_folder(fake(master, None))
