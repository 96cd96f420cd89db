"""Centroid clustering with the threshold algorithm.

Every dimension keeps its centroids sorted by their value. For a vector all lists are walked outward from the vector's own
value; a centroid that comes up for the first time gets its exact distance. The squared steps of all lists at the same depth
bound the distance of every centroid that has not come up yet, so the walk stops as soon as their sum strictly exceeds the
best exact distance (strictly, as an unseen centroid at the same distance might have the smaller number).

Components are integers, so sums, means and distances are exact and rows come out alike however they are dealt.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from caseloom.llm.common import cut_lineage, small_batches

DIMENSIONS, SCALE, CENTROIDS, ROUNDS, SEED = 64, 64, 16, 3, 1
#: Scaled components beyond this have squared distances that a long cannot hold; such vectors are not kept.
LARGEST = 1 << 27
#: Cells of the arrays that are walked at once: a bound on memory, no result depends on it.
CELLS = 1 << 18


class Lists:
    """The sorted lists of all dimensions."""

    def __init__(self, centroids: np.ndarray):
        self.centroids = centroids
        self.order = np.argsort(centroids, axis=0, kind="stable").T.copy()
        self.values = np.take_along_axis(centroids.T, self.order, axis=1)

    def nearest(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Number and squared distance of each vector's nearest centroid; the smaller number of equals."""
        best = np.full(len(vectors), np.iinfo(np.int64).max)
        number = np.full(len(vectors), -1)
        rows = max(CELLS // max(self.centroids.shape), 16)
        for at in range(0, len(vectors), rows):
            part = slice(at, at + rows)
            number[part], best[part] = self._walk(vectors[part])
        return number, best

    def _walk(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        n, (k, dims) = len(vectors), self.centroids.shape
        best, number = np.full(n, np.iinfo(np.int64).max), np.full(n, k)
        seen = np.zeros((n, k), bool)
        # the next entry on either side of the vector's value, in every list
        after = np.empty((n, dims), np.int64)
        for d in range(dims):
            after[:, d] = np.searchsorted(self.values[d], vectors[:, d])
        before = after - 1
        live, lists = np.arange(n), np.arange(dims)
        far = np.iinfo(np.int64).max
        for _ in range(k):
            v, low, high = vectors[live], before[live], after[live]
            down = np.where(low >= 0, v - self.values[lists, np.maximum(low, 0)], far)
            up = np.where(high < k, self.values[lists, np.minimum(high, k - 1)] - v, far)
            falls = down <= up
            came = self.order[lists, np.where(falls, low, high)]
            before[live], after[live] = low - falls, high + ~falls
            fresh = np.zeros((len(live), k), bool)
            fresh[np.arange(len(live))[:, None], came] = True
            fresh &= ~seen[live]
            row, c = np.nonzero(fresh)
            seen[live[row], c] = True
            apart = vectors[live[row]] - self.centroids[c]
            exact = np.full(fresh.shape, far)
            exact[row, c] = np.einsum("ij,ij->i", apart, apart)
            first = np.argmin(exact, axis=1)
            distance = exact[np.arange(len(live)), first]
            better = (distance < best[live]) | ((distance == best[live]) & (first < number[live]))
            best[live[better]], number[live[better]] = distance[better], first[better]
            step = np.where(falls, down, up)
            frontier = np.einsum("ij,ij->i", step, step)
            live = live[(frontier <= best[live]) & ~seen[live].all(axis=1)]
            if not len(live):
                break
        return number, best


def whole_vectors(vectors: DataFrame, id_column: str, vector_column: str, dimensions: int, scale: int) -> DataFrame:
    """``vec_id`` and ``components``, floor(scale * x) of every vector with exactly ``dimensions`` finite components."""
    x = F.col(f"`{vector_column}`")
    fine = lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e.cast("double") * scale) <= F.lit(float(LARGEST)))
    kept = vectors.filter((F.size(x) == dimensions) & F.forall(x, lambda e: F.coalesce(fine(e), F.lit(False))))
    return kept.select(F.col(f"`{id_column}`").alias("vec_id"), F.transform(x, lambda e: F.floor(e.cast("double") * scale)).alias("components"))


def _matrix(column: pa.Array, dimensions: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dimensions)


def _moved(vectors: DataFrame, centroids: list[list[int]]) -> list[list[int]]:
    """One round: assign, add up in the tasks, and replace every centroid that has vectors by their floored mean."""
    shared = vectors.sparkSession.sparkContext.broadcast(centroids)
    k, dimensions = len(centroids), len(centroids[0])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lists = Lists(np.array(shared.value, np.int64))
        sums, counts = np.zeros((k, dimensions), np.int64), np.zeros(k, np.int64)
        for batch in batches:
            rows = _matrix(batch.column(0), dimensions)
            number, _ = lists.nearest(rows)
            np.add.at(sums, number, rows)
            counts += np.bincount(number, minlength=k)
        # the count goes as one more dimension
        table = np.concatenate([sums, counts[:, None]], axis=1)[counts > 0]
        cluster = np.repeat(np.flatnonzero(counts), dimensions + 1)
        at = np.tile(np.arange(dimensions + 1), len(table))
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in (cluster, at, table.ravel())], names=["cluster", "at", "total"])

    parts = vectors.select("components").mapInArrow(run, "cluster bigint, at bigint, total bigint")
    # decimals, as sums over very many large vectors may leave the range of a long
    sums = {(r["cluster"], r["at"]): int(r["total"]) for r in parts.groupBy("cluster", "at").agg(F.sum(F.col("total").cast("decimal(38,0)")).alias("total")).collect()}
    return [[sums[c, d] // sums[c, dimensions] for d in range(dimensions)] if (c, dimensions) in sums else old for c, old in enumerate(centroids)]


def _assigned(vectors: DataFrame, centroids: list[list[int]]) -> DataFrame:
    shared = vectors.sparkSession.sparkContext.broadcast(centroids)
    kind = vectors.schema["vec_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lists = Lists(np.array(shared.value, np.int64))
        for batch in batches:
            number, distance = lists.nearest(_matrix(batch.column(1), len(shared.value[0])))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(number.astype(np.int32)), pa.array(distance)], names=["vec_id", "cluster", "distance"])

    return vectors.select("vec_id", "components").mapInArrow(run, f"vec_id {kind}, cluster int, distance bigint")


def cluster(vectors: DataFrame, centroids: int = CENTROIDS, rounds: int = ROUNDS, seed: int = SEED, dimensions: int = DIMENSIONS, scale: int = SCALE,
            id_column: str = "vec_id", vector_column: str = "embedding") -> tuple[DataFrame, DataFrame]:
    """Assignments (``vec_id``, ``cluster``, ``distance``) and final centroids (``cluster``, ``components``, at most ``centroids`` rows).

    Vectors that are null, of another length, or have a null, non-finite or oversized (over 2**27 after scaling) component are not
    kept. Rows that share an id, or repeat, are vectors of their own; null ids take part like an empty id. The first centroids are the
    vectors with the smallest sha256 of ``seed:id``, ties by components; a table with fewer vectors has fewer centroids, an empty
    one none and no rows. Centroids without vectors stay where they are. Other columns are not read.
    """
    spark = vectors.sparkSession
    small_batches(spark)
    kept = cut_lineage(whole_vectors(vectors, id_column, vector_column, dimensions, scale))
    drawn = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256)
    first = kept.select("components", drawn.alias("hash")).orderBy("hash", "components").limit(centroids).collect()
    centres = [list(r["components"]) for r in sorted(first, key=lambda r: (r["hash"], r["components"]))]
    if centres:
        for _ in range(rounds):
            centres = _moved(kept, centres)
        assigned = cut_lineage(_assigned(kept, centres))
    else:
        assigned = kept.select("vec_id", F.lit(0).alias("cluster"), F.lit(0).cast("bigint").alias("distance"))
    schema = T.StructType([T.StructField("cluster", T.IntegerType()), T.StructField("components", T.ArrayType(T.LongType()))])
    return assigned, spark.createDataFrame(list(enumerate(centres)), schema)


def cluster_digests(vectors: DataFrame, **parameters) -> DataFrame:
    """Per vector its cluster and distance, the inertia of its cluster and of all, and the digest of its centroid.

    An inertia that a long cannot hold is null. Odd rows as in ``cluster``.
    """
    assigned, centres = cluster(vectors, **parameters)
    # one row per cluster and one of all: bounded by the number of centroids
    inertia = assigned.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("own")).collect()
    total = sum(int(r["own"]) for r in inertia)
    fits = lambda x: x if x < 1 << 63 else None
    digest = {r["cluster"]: hashlib.sha256(",".join(map(str, r["components"])).encode()).hexdigest() for r in centres.collect()}
    facts = assigned.sparkSession.createDataFrame([(r["cluster"], fits(int(r["own"])), fits(total), digest[r["cluster"]]) for r in inertia],
                                                  "cluster int, cluster_inertia bigint, inertia bigint, centroid_sha256 string")
    return assigned.join(F.broadcast(facts), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def oracle(centroids: int = CENTROIDS, rounds: int = ROUNDS, seed: int = SEED, dimensions: int = DIMENSIONS, scale: int = SCALE) -> str:
    distance = "list_sum(list_transform(list_zip(components, centre), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT"
    rows = f"""
kept AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: floor({scale} * x::DOUBLE)::BIGINT) AS components
  FROM embeddings WHERE len(embedding) = {dimensions} AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x) AND abs({scale} * x::DOUBLE) <= {LARGEST})) = {dimensions}),
c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY h, components) - 1 AS cluster, components AS centre
  FROM (SELECT sha256('{seed}:' || coalesce(vec_id::VARCHAR, '')) AS h, components FROM kept ORDER BY h, components LIMIT {centroids}))"""
    for i in range(rounds):
        rows += f""",
a{i} AS MATERIALIZED (SELECT r, any_value(components) AS components, arg_min(cluster, ({distance}, cluster)) AS cluster FROM kept, c{i} GROUP BY r),
s{i} AS (SELECT cluster, d, sum(components[d])::HUGEINT AS s, count(*)::HUGEINT AS n FROM a{i}, range(1, {dimensions + 1}) t(d) GROUP BY ALL),
m{i} AS (SELECT cluster, list(((s - ((s % n) + n) % n) // n)::BIGINT ORDER BY d) AS centre FROM s{i} GROUP BY cluster),
c{i + 1} AS MATERIALIZED (SELECT cluster, coalesce(m{i}.centre, c{i}.centre) AS centre FROM c{i} LEFT JOIN m{i} USING (cluster))"""
    return f"""WITH {rows},
final AS (SELECT r, any_value(vec_id) AS vec_id, min(({distance}, cluster)) AS nearest FROM kept, c{rounds} GROUP BY r),
flat AS (SELECT vec_id, nearest[2]::INT AS cluster, nearest[1]::BIGINT AS distance FROM final)
SELECT vec_id, flat.cluster, distance, (sum(distance) OVER (PARTITION BY flat.cluster))::BIGINT AS cluster_inertia, (sum(distance) OVER ())::BIGINT AS inertia,
  sha256(array_to_string(centre, ',')) AS centroid_sha256
FROM flat JOIN c{rounds} ON c{rounds}.cluster = flat.cluster"""
