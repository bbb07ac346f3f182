import json
import random

import pytest
from pyspark.sql import functions as F

from tidemill.functions import paths

PATHS = [
    "$", "$.a", "$.a.b", "$['a']['x y']", "$.l[0]", "$.l[-1]", "$.l[7]", "$.l[*]", "$.*", "$.l[1:3]", "$.l[-2:]", "$.l[:-1]", "$.l[3:1]", "$.l[0,2]", "$['a','b','zz']", "$..b", "$..*", "$..l[0]", "$..[0]", "$..['b']", "$.l[*].b", "$.l.*.b",
    "$.l[?(@.b > 1)]", "$.l[?(@.b >= 1 && (@.k == 'x' || @.k == \"y\"))].b", "$.l[?(!(@.b) || @.b != 2)]", "$..[?(@.k)].k", "$.l[?(@.k < 'y')]", "$.a[?(@ == 1)]", "$.l[?(@.n == null)]", "$.l[?(@.t == true)].b", "$.l[?(@.b == '1')]", "$.l[?(@.n != 1)]", "$.l[?(@.t > 0)]", "$.l[?(@['k'] == 'x')]", "$.l[?(@.in[0] == 1)]", "$.l[?(!@.k && !@.b)]",
]


def document(rng, depth=0):
    kind = rng.random()
    if depth > 4 or kind < 0.3:
        return rng.choice([None, True, False, 0, 1, 2, 1.5, "x", "y", "", "1"])
    if kind < 0.6:
        return [document(rng, depth + 1) for _ in range(rng.randrange(4))]
    return {k: document(rng, depth + 1) for k in rng.sample(["a", "b", "k", "l", "n", "t", "x y", "in"], rng.randrange(6))}


def in_name_order(value):
    """Members in the order that VARIANT keeps them in."""
    return {k: in_name_order(value[k]) for k in sorted(value)} if isinstance(value, dict) else [in_name_order(x) for x in value] if isinstance(value, list) else value


@pytest.mark.parametrize("path", PATHS)
def test_columns_match_what_documents_match(spark, path):
    rng = random.Random(7)
    docs = [{"l": [document(rng, 1) for _ in range(rng.randrange(5))], "a": document(rng, 1), "b": document(rng, 2)} for _ in range(60)] + [document(rng) for _ in range(40)]
    docs += [{"l": [{"b": rng.randrange(3), "k": rng.choice("xyz"), "n": rng.choice([None, 1]), "t": rng.choice([True, 1]), "in": [rng.randrange(2)]} for _ in range(5)]} for _ in range(20)]
    df = spark.createDataFrame([(k, json.dumps(d)) for k, d in enumerate(docs)], "k int, body string").withColumn("v", F.parse_json("body"))
    got = {r["k"]: [json.loads(x) for x in r["found"]] for r in df.select("k", F.transform(paths.path_values(F.col("v"), path), lambda x: F.to_json(x)).alias("found")).collect()}
    definite = paths.is_definite(paths.steps(path))
    key = lambda x: json.dumps(x, sort_keys=True)
    for k, d in enumerate(docs):
        try:
            want = paths.read_path(in_name_order(d), path)
        except paths.PathMissing:
            want = []
        else:
            want = [want] if definite else want
        if ".." in path:  # level by level there, depth first here
            assert sorted(map(key, got[k])) == sorted(map(key, want))
        else:
            assert list(map(key, got[k])) == list(map(key, want)), d


@pytest.mark.parametrize("path", ["a", "$.", "$.a[", "$.a[x]", "$.a[0,'b']", "$[?(k == 1)]", "$[?(@.a == )]", "$[?(@.a == 1]", "$[?(@.a ~ 1)]", "$[?((@.a)]", "$[?(@.* == 1)]"])
def test_what_is_no_path(path):
    with pytest.raises(ValueError):
        paths.steps(path)


def test_values_of_definite_paths_and_depth(spark):
    df = spark.createDataFrame([('{"a":{"b":[1,"x"]}}',), ('{"a":3}',), (None,)], "body string").withColumn("v", F.parse_json("body"))
    got = df.select(paths.path_value(F.col("v"), "$.a.b[0]", "int").alias("n"), paths.path_value(F.col("v"), "$.a.b[-1]", "string").alias("s"), F.size(paths.path_values(F.col("v"), "$..*")).alias("all")).collect()
    assert [tuple(r) for r in got] == [(1, "x", 4), (None, None, 1), (None, None, 0)]
    with pytest.raises(ValueError):
        paths.path_value(F.col("v"), "$.a[*]")
    with pytest.raises(Exception, match="nested over 2 deep"):
        df.select(paths.path_values(F.col("v"), "$..b", depth=2)).collect()
