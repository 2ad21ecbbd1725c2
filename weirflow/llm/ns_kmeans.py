"""Centroid clustering of whole-number vectors with ns-bounds (Newling and Fleuret, "Fast k-means with accurate bounds", 2016).

Each vector carries, for each centroid, the exact squared distance that was last computed and the round it was computed in.
All centroids of all rounds are kept, so a stored distance bounds today's by the norm of the one displacement between the
centroid then and now, which is never more than the sum of the round-by-round drifts and often far less. A vector whose upper bound
to its own centroid lies below its lower bounds to all others stays where it is, with no distance computed. Otherwise the
distance to its own centroid is computed, and then to those centroids whose bounds still don't rule them out; these integers
decide, equal ones in favour of the smaller number. Bounds are floating-point and only ever used with a margin for rounding, so the
result is that of plain rounds over all distances.

A round is one job over the vectors: each task reads its rows and the centroids so far, and writes the rows with their new state and one
row of sums by cluster, which Spark adds up. Nothing is shuffled but those sums. Each round's table is written to the shared folder and
deleted when the next is there, so a lost executor costs the tasks it had.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import delete, new_path

CLUSTERS, ROUNDS, DIMENSIONS, SCALE = 8, 10, 64, 1024
#: Components beyond this, either way, have squared distances that 64 bits don't hold.
LARGEST = 1 << 27
#: Relative error that the bounds allow for; what they are made of has less than 2^-49.
MARGIN = 1e-12

#: What a round's table has beside the ids: rows of vectors with their state, and rows of `sums` alone.
_STATE = "vector binary, cluster int, exact binary, since binary, distance bigint, sums binary"


def usable(vector: Column, dimensions: int) -> Column:
    """Whether a vector has exactly so many components, none null, NaN or infinite."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return F.coalesce(vector.isNotNull() & (F.size(vector) == dimensions) & finite, F.lit(False))


def integers(vector: Column, scale: int) -> Column:
    """floor(scale * x) of each component."""
    return F.transform(vector, lambda x: F.floor(x * float(scale)))


def _numbers(column: pa.Array, width: int, kind: str) -> np.ndarray:
    """Rows of fixed-width binary values as a matrix."""
    return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(len(column), width)


def _binary(rows: np.ndarray) -> pa.Array:
    return pa.array([row.tobytes() for row in rows], pa.binary())


def squared(vectors: np.ndarray, centroid: np.ndarray) -> np.ndarray:
    """Exact squared distances; LARGEST keeps them within 64 bits."""
    apart = vectors.astype("int64") - centroid
    return np.einsum("ij,ij->i", apart, apart)


def assign(vectors: np.ndarray, cluster: np.ndarray, exact: np.ndarray, since: np.ndarray, history: np.ndarray) -> np.ndarray:
    """Assign vectors to the nearest of history[-1], changing cluster, exact and since; returns how many distances were computed to each.

    cluster is -1 where a vector wasn't assigned yet. exact[i, j] is the squared distance of vector i to centroid j of round since[i, j].
    """
    now, k = len(history) - 1, history.shape[1]
    new = np.flatnonzero(cluster < 0)
    evaluated = np.full(k, len(new))
    for j in range(k):
        exact[new, j], since[new, j] = squared(vectors[new], history[now, j]), now
    cluster[new] = exact[new].argmin(axis=1)  # the first of equal ones
    old = np.setdiff1d(np.arange(len(vectors)), new, assume_unique=True)
    if not len(old):
        return evaluated
    moved = np.sqrt(((history - history[now]).astype("float64") ** 2).sum(axis=2))  # of each centroid, from each round to now
    each = np.arange(k)[None, :]

    def lower(rows: np.ndarray) -> np.ndarray:
        root, loose = np.sqrt(exact[rows].astype("float64")), moved[since[rows], each]
        return root - loose - MARGIN * (root + loose)

    def ruled_out(rows: np.ndarray) -> np.ndarray:
        own = cluster[rows]
        root, loose = np.sqrt(exact[rows, own].astype("float64")), moved[since[rows, own], own]
        clear = (root + loose) * (1 + MARGIN)
        out = clear[:, None] < lower(rows)
        out[np.arange(len(rows)), own] = True
        return out

    failed = old[~ruled_out(old).all(axis=1)]
    stale = failed[since[failed, cluster[failed]] != now]
    for j in range(k):
        own = stale[cluster[stale] == j]
        exact[own, j], since[own, j] = squared(vectors[own], history[now, j]), now
        evaluated[j] += len(own)
    rivals = ~ruled_out(failed)
    rows = failed[rivals.any(axis=1)]
    rivals = rivals[rivals.any(axis=1)]
    best, at = exact[rows, cluster[rows]].copy(), cluster[rows].copy()
    for j in range(k):
        mine = rivals[:, j]
        late = rows[mine & (since[rows, j] != now)]
        exact[late, j], since[late, j] = squared(vectors[late], history[now, j]), now
        evaluated[j] += len(late)
        found = exact[rows, j]
        nearer = mine & ((found < best) | (found == best) & (j < at))
        best[nearer], at[nearer] = found[nearer], j
    cluster[rows] = at
    return evaluated


def _round(history: np.ndarray, last: bool):
    """A round over Arrow batches of id and _STATE: vectors with their new state, and at the task's end a row of its sums: by
    cluster the number of vectors, the distances computed, and the sums of components. In the last round the state is left out, and the
    distance to the own centroid put in."""
    k, dimensions = history.shape[1:]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, schema = np.zeros((k, dimensions + 2), "int64"), None
        for batch in batches:
            n, schema, rows = batch.num_rows, batch.schema, np.arange(batch.num_rows)
            if not n:
                continue
            vectors = _numbers(batch["vector"], dimensions, "<i4")
            if batch["exact"].null_count:  # the first round
                cluster, exact, since = np.full(n, -1, "int32"), np.zeros((n, k), "int64"), np.zeros((n, k), "uint16")
            else:
                cluster = batch["cluster"].to_numpy(zero_copy_only=False).astype("int32")
                exact, since = _numbers(batch["exact"], k, "<i8").copy(), _numbers(batch["since"], k, "<u2").copy()
            sums[:, 1] += assign(vectors, cluster, exact, since, history)
            for j in range(k):
                own = cluster == j
                sums[j, 0] += own.sum()
                sums[j, 2:] += vectors[own].sum(axis=0, dtype="int64")
                if last:
                    stale = np.flatnonzero(own & (since[:, j] != len(history) - 1))
                    exact[stale, j] = squared(vectors[stale], history[-1, j])
            none = pa.nulls(n, pa.binary())
            state = [none, pa.array(cluster), none, none, pa.array(exact[rows, cluster])] if last else [batch["vector"], pa.array(cluster), _binary(exact), _binary(since), pa.nulls(n, pa.int64())]
            yield pa.RecordBatch.from_arrays([batch["id"], *state, none], schema=schema)
        if schema is not None:
            yield pa.RecordBatch.from_arrays([*(pa.nulls(1, f.type) for f in list(schema)[:-1]), pa.array([sums.tobytes()], pa.binary())], schema=schema)

    return run


def _unpacked(k: int, width: int):
    """(cluster, place, amount) of rows of sums."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                table = _numbers(batch["sums"], k * width, "<i8").ravel()
                cluster = np.tile(np.repeat(np.arange(k, dtype="int32"), width), batch.num_rows)
                place = np.tile(np.arange(width, dtype="int32"), k * batch.num_rows)
                yield pa.RecordBatch.from_arrays([pa.array(cluster), pa.array(place), pa.array(table)], names=["cluster", "place", "amount"])

    return run


def _summed(state: DataFrame, k: int, width: int) -> list[list[int]]:
    """A round's sums by cluster, over all tasks. Only k * width numbers come to the driver."""
    parts = state.where("sums is not null").select("sums").mapInArrow(_unpacked(k, width), "cluster int, place int, amount bigint")
    found = {(r.cluster, r.place): int(r.amount) for r in parts.groupBy("cluster", "place").agg(F.sum(F.col("amount").cast("decimal(38,0)")).alias("amount")).collect()}
    return [[found.get((j, d), 0) for d in range(width)] for j in range(k)]


def first_centroids(vectors: DataFrame, id_col: str, vector_col: str, clusters: int, seed: int) -> np.ndarray:
    """The vectors whose ids have the least SHA-256 of `seed:id`, in that order; of rows with one id, the one whose numbers come first.

    A null id comes after all others. Fewer vectors give fewer centroids.
    """
    name = F.sha2(F.concat(F.lit(f"{seed}:"), F.col(f"`{id_col}`").cast("string")), 256)
    least = vectors.select(F.col(f"`{vector_col}`").alias("v"), name.alias("name")).orderBy(F.col("name").asc_nulls_last(), "v").limit(clusters)
    return np.array([r.v for r in least.collect()], "int64")


def kmeans(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", clusters: int = CLUSTERS, rounds: int = ROUNDS, dimensions: int = DIMENSIONS, scale: int = SCALE, seed: int = 3) -> tuple[DataFrame, list[np.ndarray], list[int]]:
    """(assigned, centroids by round, distances computed by round); assigned has id, cluster, distance for each vector that is usable.

    Vectors are kept if they have exactly `dimensions` components, none null, NaN or infinite; each component x becomes floor(scale * x).
    Ids may be null or repeat: each row is a vector. Equal distances go to the smaller number. Repeated vectors may be centroids
    twice; the second then stays empty and where it is. With fewer vectors than clusters there are as many clusters as vectors; without
    any, assigned is empty. Other columns aren't read. A component beyond LARGEST raises: its distance wouldn't fit.

    State is `clusters` numbers a vector and `rounds` times `clusters` centroids a task, so it is meant for hundreds of clusters at most.
    """
    spark = vectors.sparkSession
    doubles = vectors.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{vector_col}`").cast("array<double>").alias("v"))
    kept = doubles.where(usable(F.col("v"), dimensions)).select("id", integers(F.col("v"), scale).alias("v"))
    schema = f"id {kept.schema['id'].dataType.simpleString()}, {_STATE}"
    centroids = first_centroids(kept, "id", "v", clusters, seed)
    if not len(centroids):
        return kept.limit(0).select("id", F.lit(0).alias("cluster"), F.lit(0).cast("bigint").alias("distance")), [], []
    source, history, computed, before = kept.mapInArrow(_packed, schema), centroids[None], [], None
    for at in range(rounds + 1):
        path = new_path(spark, "ns-kmeans")
        source.mapInArrow(_round(history, at == rounds), schema).write.parquet(path)
        if before:
            delete(spark, before)
        state, before = spark.read.schema(schema).parquet(path), path
        source = state.where("sums is null")
        sums = _summed(state, len(centroids), dimensions + 2)
        computed.append(sum(row[1] for row in sums))
        if at < rounds:
            means = [[total // row[0] for total in row[2:]] if row[0] else list(was) for row, was in zip(sums, history[-1].tolist(), strict=True)]
            history = np.concatenate([history, np.array([means], "int64")])
    return source.select("id", "cluster", "distance"), list(history), computed


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Vectors as binary, with no state yet."""
    for batch in batches:
        n, numbers = batch.num_rows, batch["v"].flatten().to_numpy(zero_copy_only=False)
        if n:
            if max(numbers.max(), -numbers.min()) > LARGEST:
                raise ValueError(f"components beyond {LARGEST} can't be compared in 64 bits")
            none, number = pa.nulls(n, pa.binary()), pa.nulls(n, pa.int64())
            arrays = [batch["id"], _binary(numbers.reshape(n, -1).astype("<i4")), pa.nulls(n, pa.int32()), none, none, number, none]
            yield pa.RecordBatch.from_arrays(arrays, names=["id", "vector", "cluster", "exact", "since", "distance", "sums"])


def report(vectors: DataFrame) -> DataFrame:
    """One row for each usable vector: vec_id, cluster, distance (squared), cluster_inertia, inertia, centroid_sha256.

    Vectors with another number of components, or with null, NaN or infinite ones, are left out, and null vectors too; repeated rows
    stay rows, with the same result each. An empty table gives no rows.
    """
    assigned, centroids, _ = kmeans(vectors)
    own = {r.cluster: int(r.own) for r in assigned.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("own")).collect()}  # a row a cluster
    final = centroids[-1].tolist() if centroids else []
    rows = [(j, own.get(j, 0), sum(own.values()), hashlib.sha256(",".join(map(str, c)).encode()).hexdigest()) for j, c in enumerate(final)]
    figures = vectors.sparkSession.createDataFrame(rows, "cluster int, cluster_inertia bigint, inertia bigint, centroid_sha256 string")
    return assigned.join(F.broadcast(figures), "cluster").select(F.col("id").alias("vec_id"), "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def _oracle(clusters: int = CLUSTERS, rounds: int = ROUNDS, dimensions: int = DIMENSIONS, scale: int = SCALE, seed: int = 3) -> str:
    """SQL of plain rounds over all distances. Division of whole numbers cuts towards zero there, so remainders go first."""
    steps = [
        f"""WITH kept AS (
  SELECT row_number() OVER () AS row, vec_id, list_transform(embedding, lambda x: CAST(floor({scale} * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings WHERE len(embedding) = {dimensions} AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = {dimensions}
), c0 AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY name NULLS LAST, v) - 1 AS j, v AS c FROM (
    SELECT v, sha256('{seed}:' || vec_id) AS name FROM kept ORDER BY name NULLS LAST, v LIMIT {clusters})
)"""
    ]
    for n in range(rounds + 1):
        steps.append(f"""a{n} AS MATERIALIZED (
  SELECT row, v, vec_id, arg_min(j, (d, j)) AS j, min(d) AS d FROM (
    SELECT row, v, vec_id, j, CAST(list_sum(list_transform(range(1, {dimensions + 1}), lambda k: (v[k] - c[k]) * (v[k] - c[k]))) AS BIGINT) AS d FROM kept, c{n}) GROUP BY row, v, vec_id
)""")
        if n < rounds:
            steps.append(f"""c{n + 1} AS MATERIALIZED (
  SELECT j, coalesce(m, c) AS c FROM c{n} LEFT JOIN (
    SELECT j, list(CAST((s - ((s % n) + n) % n) // n AS BIGINT) ORDER BY k) AS m FROM (
      SELECT j, k, sum(v[k]) AS s, count(*) AS n FROM a{n}, range(1, {dimensions + 1}) AS t(k) GROUP BY j, k) GROUP BY j) USING (j)
)""")
    return ",\n".join(steps) + f"""
SELECT vec_id, CAST(j AS INTEGER) AS cluster, d AS distance, CAST(sum(d) OVER (PARTITION BY j) AS BIGINT) AS cluster_inertia,
  CAST(sum(d) OVER () AS BIGINT) AS inertia, sha256(array_to_string(c, ',')) AS centroid_sha256
FROM a{rounds} JOIN c{rounds} USING (j)
"""


ORACLE = _oracle()
