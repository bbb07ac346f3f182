"""Clustering around centroids: every round, a vantage-point tree over the centroids finds each vector's nearest one."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scratch import discard, materialize

#: Quantised components may have this size, so that squared distances of up to 2048 components fit 64 bits.
_LARGEST = 1 << 25
_LEAF = 4
#: Bounds of this many (vector, node) pairs are held at a time.
_BOUNDS = 1 << 21


@dataclass
class Tree:
    """A vantage-point tree. Inner nodes have a vantage centroid, two children and, of each child, the least and the largest
    distance of its centroids to the vantage; leaves have centroids.
    """

    points: np.ndarray
    nodes: list[tuple]

    @staticmethod
    def over(points: np.ndarray) -> Tree:
        """The tree of the rows of an integer matrix; equal rows are told apart by their place, so it always ends."""
        nodes: list[tuple] = []

        def grow(ids: np.ndarray) -> int:
            at = len(nodes)
            nodes.append(())
            if len(ids) <= _LEAF:
                nodes[at] = ("leaf", ids)
                return at
            vantage, rest = ids[0], ids[1:]
            far = np.sqrt(_squared(points[rest], points[vantage]).astype(np.float64))
            order = np.argsort(far, kind="stable")
            parts = []
            for part in (order[: len(order) // 2], order[len(order) // 2 :]):
                parts.append((grow(np.sort(rest[part])), far[part].min(), far[part].max()))
            nodes[at] = ("split", vantage, parts)
            return at

        if len(points):
            grow(np.arange(len(points)))
        return Tree(points, nodes)

    def nearest(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(centroid, squared distance) of each vector: the least exact distance and, of ties, the least number.

        Each vector keeps the bounds of the nodes that it has yet to visit and takes the least one next, until none is
        within its best distance; a bound equal to it is visited, since a tie with a smaller number may lie there.
        Vectors that visit the same node go there together.
        """
        who, best = np.full(len(vectors), -1, np.int64), np.full(len(vectors), np.iinfo(np.int64).max)
        step = max(64, _BOUNDS // max(1, len(self.nodes)))
        for lo in range(0, len(vectors), step):
            self._search(vectors[lo : lo + step], who[lo : lo + step], best[lo : lo + step])
        return who, best

    def _search(self, x: np.ndarray, who: np.ndarray, best: np.ndarray) -> None:
        bounds = np.full((len(x), len(self.nodes)), np.inf)
        bounds[:, 0] = 0.0
        live = np.arange(len(x))
        while len(live):
            node = bounds[live].argmin(1)
            low = bounds[live, node]
            open_ = low <= np.sqrt(best[live].astype(np.float64))
            live, node, low = live[open_], node[open_], low[open_]
            for at in np.unique(node):
                mine = node == at
                rows = live[mine]
                bounds[rows, at] = np.inf
                kind, *rest = self.nodes[at]
                if kind == "leaf":
                    for c in rest[0]:
                        self._visit(x, rows, c, who, best)
                    continue
                vantage, parts = rest
                away = np.sqrt(self._visit(x, rows, vantage, who, best).astype(np.float64))
                for child, least, most in parts:
                    # Rounding must never cut off an equal distance, so bounds give way by more than its size.
                    slack = 1e-12 * (away + most)
                    bounds[rows, child] = np.maximum(low[mine], np.maximum(least - away, away - most) - slack)

    def _visit(self, x: np.ndarray, rows: np.ndarray, c: int, who: np.ndarray, best: np.ndarray) -> np.ndarray:
        d = _squared(x[rows], self.points[c])
        better = (d < best[rows]) | ((d == best[rows]) & ((c < who[rows]) | (who[rows] < 0)))
        best[rows[better]], who[rows[better]] = d[better], c
        return d


def _squared(rows: np.ndarray, point: np.ndarray) -> np.ndarray:
    gap = rows - point
    return np.einsum("ij,ij->i", gap, gap)


def quantised(vectors: DataFrame, id_col: str, vector_col: str, dimensions: int, scale: int) -> DataFrame:
    """(id, v) of the vectors that have all their components, each a finite number, as floor(scale * component)."""
    finite: Callable[[Column], Column] = lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf"))
    kept = vectors.select(F.col(id_col).alias("id"), F.col(vector_col).alias("v")).filter((F.size("v") == dimensions) & F.forall("v", finite))
    return kept.withColumn("v", F.transform("v", lambda x: F.floor(x.cast("double") * scale)))


def _matrix(column: pa.Array, dimensions: int) -> np.ndarray:
    x = column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, dimensions)
    if len(x) and np.abs(x).max() > _LARGEST:
        raise ValueError(f"components over {_LARGEST} after scaling have no exact 64-bit distances; use a smaller scale")
    return x


def _totals(tree) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Of a task: (cluster, place, n, total) sums of its vectors, one row for each component of each centroid."""

    def run(batches):
        points = tree.value.points
        n, total = np.zeros(len(points), np.int64), np.zeros(points.shape, np.int64)
        for b in batches:
            x = _matrix(b.column(0), points.shape[1])
            who, _ = tree.value.nearest(x)
            order = np.argsort(who, kind="stable")
            at = np.flatnonzero(np.diff(who[order], prepend=-1))
            n += np.bincount(who, minlength=len(points))
            if len(at):
                total[who[order[at]]] += np.add.reduceat(x[order], at)
        used = np.flatnonzero(n)
        if len(used):
            d = points.shape[1]
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(used, d)), pa.array(np.tile(np.arange(d), len(used))), pa.array(np.repeat(n[used], d)), pa.array(total[used].ravel())], ["cluster", "place", "n", "total"])

    return run


def _assignments(tree, schema: pa.Schema) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches):
        for b in batches:
            who, best = tree.value.nearest(_matrix(b.column(1), tree.value.points.shape[1]))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(who, pa.int32()), pa.array(best)], ["id", "cluster", "distance"])

    return run


def cluster_vectors(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", k: int = 8, rounds: int = 10, dimensions: int = 64, scale: int = 1024, seed: str = "3", most_components: int = 1 << 22) -> DataFrame:
    """(id, cluster, distance, cluster_inertia, inertia, centroid_sha256) of every vector kept.

    Vectors of another length, null ones and those with a null, NaN or infinite component are left out; fewer than k
    vectors make fewer clusters, an empty table gives no rows. Components become integers, floor(scale * component), and all
    distances, means (rounded down) and sums are exact; components too large for that raise an error. The first centroids are the vectors
    with the least SHA-256 of `<seed>:<id>` (a null id counts as `null`; of rows with the same id, the least vector). A centroid
    without vectors stays. Repeated rows count each; further columns, whatever their names, are not read. The centroids go to the tasks by
    broadcast and come back as k * dimensions sums; more than most_components of them are an error.
    """
    if k * dimensions > most_components:
        raise ValueError(f"{k} centroids of {dimensions} components are over {most_components}")
    spark = vectors.sparkSession
    kept = materialize(quantised(vectors, id_col, vector_col, dimensions, scale), "vectors")
    rank = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("id").cast("string"), F.lit("null"))), 256)
    first = kept.select(rank.alias("rank"), "v").orderBy("rank", "v").limit(k).collect()
    points = np.array([r["v"] for r in first], np.int64).reshape(-1, dimensions)
    for _ in range(rounds if len(points) else 0):
        tree = spark.sparkContext.broadcast(Tree.over(points))
        sums = kept.select("v").mapInArrow(_totals(tree), "cluster long, place long, n long, total long").groupBy("cluster", "place").agg(F.sum("n").alias("n"), F.sum("total").alias("total"))
        moved = points.copy()
        for r in sums.collect():
            moved[r["cluster"], r["place"]] = r["total"] // r["n"]
        tree.destroy()
        if (moved == points).all():
            break  # later rounds would assign and move alike
        points = moved
    tree = spark.sparkContext.broadcast(Tree.over(points))
    out = "id " + kept.schema["id"].dataType.simpleString() + ", cluster int, distance long"
    found = materialize(kept.mapInArrow(_assignments(tree, out), out), "assigned")
    sizes = {r["cluster"]: r["inertia"] for r in found.groupBy("cluster").agg(F.sum("distance").alias("inertia")).collect()}
    digests = [hashlib.sha256(",".join(map(str, p)).encode()).hexdigest() for p in points.tolist()]
    table = spark.createDataFrame([(c, inertia, sum(sizes.values()), digests[c]) for c, inertia in sizes.items()], "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    discard(kept)
    return found.join(F.broadcast(table), "cluster").select(F.col("id").alias(id_col), "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def op13_centroid_clustering(spark, sf_dir: str) -> DataFrame:
    """Every vector of 64 components with its cluster after ten rounds over eight centroids."""
    return cluster_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def _oracle(rounds: int = 10) -> str:
    parts = [
        """kept AS MATERIALIZED (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(x::DOUBLE * 1024) AS BIGINT)) AS v FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)""",
        "c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY h) - 1 AS c, v FROM (SELECT sha256('3:' || vec_id) AS h, v FROM kept ORDER BY h LIMIT 8))",
    ]
    for r in range(rounds + 1):
        parts.append(f"a{r} AS MATERIALIZED (SELECT vec_id, any_value(kept.v) AS v, min(CAST(list_sum(list_transform(list_zip(kept.v, c{r}.v), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) AS BIGINT) * 8 + c) AS best FROM kept, c{r} GROUP BY vec_id)")
        if r < rounds:
            parts.append(f"m{r} AS MATERIALIZED (SELECT c, list(CAST((s - ((s % n) + n) % n) / n AS BIGINT) ORDER BY i) AS v FROM (SELECT best % 8 AS c, i, count(*) AS n, CAST(sum(v[i]) AS BIGINT) AS s FROM a{r}, range(1, 65) AS t(i) GROUP BY 1, 2) GROUP BY c)")
            parts.append(f"c{r + 1} AS MATERIALIZED (SELECT c, coalesce(m{r}.v, c{r}.v) AS v FROM c{r} LEFT JOIN m{r} USING (c))")
    return (
        "WITH "
        + ",\n".join(parts)
        + f"""
SELECT vec_id, CAST(best % 8 AS INTEGER) AS cluster, best // 8 AS distance, CAST(sum(best // 8) OVER (PARTITION BY best % 8) AS BIGINT) AS cluster_inertia,
  CAST(sum(best // 8) OVER () AS BIGINT) AS inertia, sha256(array_to_string(c{rounds}.v, ',')) AS centroid_sha256
FROM a{rounds} JOIN c{rounds} ON c = best % 8"""
    )


ORACLE_OP13 = _oracle()
