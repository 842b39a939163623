"""Exact nearest neighbours over vectors laid out by cluster: the triangle inequality leaves clusters unread.

Vectors are scaled to length one, so a cosine distance is half the square of a Euclidean one, and Euclidean
distances obey the triangle inequality: a vector in a cluster with centre c and radius r is at least
|q - c| - r away from q.  A query first reads the clusters with the nearest centres until they hold k
vectors; the k-th distance is a ceiling, and clusters that lie beyond it are not read.  The layout is a table
sorted by cluster, so a scan for some clusters skips the files and row groups of the others.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from casemill.functions.scalars import finite_vector
from casemill.operators.postings import write

#: Vectors that the centres are fitted on, rounds of it, most centres, and queries that go to a task at once.
SAMPLE, ROUNDS, MOST, QUERIES = 20_000, 8, 2048, 10_000
#: Beyond rounding of the distances.
SLACK = 1e-6


@dataclass
class Clusters:
    """vectors: cluster, fragment_id, unit (the vector at length one).  centres: cluster, centre, radius, n."""

    vectors: DataFrame
    centres: DataFrame


def _unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def fit_centres(x: np.ndarray, k: int, rounds: int = ROUNDS) -> np.ndarray:
    """k centres of unit vectors by rounds of means; the first ones are spread over x."""
    centre = x[np.linspace(0, len(x) - 1, k).astype(int)]
    for _ in range(rounds):
        own = (x @ centre.T).argmax(1)
        total = np.zeros_like(centre)
        np.add.at(total, own, x)
        norm = np.linalg.norm(total, axis=1, keepdims=True)
        centre = np.where(norm > 0, total / np.where(norm > 0, norm, 1), centre)
    return centre


def cluster_vectors(corpus: DataFrame, path: str, k: int | None = None) -> Clusters:
    """corpus (fragment_id, embedding) as two tables under path.  Vectors that are null, zero or not finite are left out; all must have one width.

    The centres are fitted on SAMPLE vectors by hash, about as many as the square root of the rows, MOST at
    most; every vector is then in the cluster of its nearest centre.  Equal vectors share a cluster, which
    spans files like any other.
    """
    spark = corpus.sparkSession
    own = corpus.where(finite_vector(F.col("embedding"))).select("fragment_id", F.col("embedding").cast("array<double>").alias("embedding"))
    n = own.count()
    if len(own.select(F.size("embedding").alias("w")).distinct().limit(2).collect()) > 1:
        raise ValueError("vectors of one width are needed")
    sample = own.orderBy(F.xxhash64("fragment_id")).limit(SAMPLE).select("embedding").toArrow() if n else None
    x = _unit(_matrix(sample.column("embedding").combine_chunks())) if n else np.zeros((0, 1))
    centre = fit_centres(x, min(k or min(MOST, math.isqrt(n)), len(x))) if n else x
    shared = spark.sparkContext.broadcast(centre)  # MOST rows of one vector

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centre = shared.value
        for batch in batches:
            for a in range(0, batch.num_rows, 4096):
                part = batch.slice(a, 4096)
                unit = _unit(_matrix(part.column("embedding")))
                own = (unit @ centre.T).argmax(1)
                away = np.sqrt(((unit - centre[own]) ** 2).sum(1))
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(unit) + 1, dtype=np.int32) * unit.shape[1]), pa.array(unit.ravel()))
                yield pa.RecordBatch.from_arrays([pa.array(own.astype(np.int32)), part.column("fragment_id"), lists, pa.array(away)], ["cluster", "fragment_id", "unit", "away"])

    kind = dict(corpus.dtypes)["fragment_id"]
    found = own.mapInArrow(placed, f"cluster int, fragment_id {kind}, unit array<double>, away double")
    vectors = write(found.repartitionByRange("cluster", "fragment_id").sortWithinPartitions("cluster", "fragment_id"), f"{path}/vectors")
    shared.destroy()
    names = spark.createDataFrame([(i, row) for i, row in enumerate(centre.tolist())], "cluster int, centre array<double>")
    centres = vectors.groupBy("cluster").agg(F.max("away").alias("radius"), F.count("*").alias("n")).join(names, "cluster")
    return Clusters(vectors.drop("away"), write(centres, f"{path}/centres"))


def read_clusters(spark: SparkSession, path: str) -> Clusters:
    """Clusters that were written earlier."""
    return Clusters(spark.read.parquet(f"{path}/vectors").drop("away"), spark.read.parquet(f"{path}/centres"))


def _near(vectors: DataFrame, names: np.ndarray, unit: np.ndarray, wanted: dict[int, np.ndarray], k: int) -> DataFrame:
    """(query_id, fragment_id, distance) of each query's k nearest, by task, in the clusters that it wants (cluster -> queries)."""
    shared = vectors.sparkSession.sparkContext.broadcast((names, unit, wanted))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, unit, wanted = shared.value
        best: tuple[np.ndarray, ...] = ()
        for batch in batches:
            cluster = batch.column("cluster").to_numpy()
            cut = np.concatenate([[0], np.flatnonzero(np.diff(cluster)) + 1, [len(cluster)]])
            for a, b in zip(cut[:-1], cut[1:]):
                for a in range(a, b, 4096):
                    part = batch.slice(a, min(b - a, 4096))
                    own = wanted.get(int(cluster[a]))
                    if own is None:
                        continue
                    d = np.round(1 - _matrix(part.column("unit")) @ unit[own].T, 9)
                    r, c = np.nonzero(d <= np.partition(d, min(k, len(d)) - 1, axis=0)[min(k, len(d)) - 1])
                    ids = np.array(part.column("fragment_id").to_pylist(), object) if not pa.types.is_integer(batch.column("fragment_id").type) else part.column("fragment_id").to_numpy()
                    new = (own[c], d[r, c], ids[r])
                    q, d, i = (np.concatenate(x) for x in zip(best, new)) if best else new
                    order = np.lexsort((i.astype(str) if i.dtype == object else i, d, q))
                    q, d, i = q[order], d[order], i[order]
                    keep = np.arange(len(q)) - np.searchsorted(q, q) < k
                    best = q[keep], d[keep], i[keep]
        if best:
            yield pa.RecordBatch.from_arrays([pa.array(names[best[0]]), pa.array(best[2].tolist()), pa.array(best[1])], ["query_id", "fragment_id", "distance"])

    return vectors.where(F.col("cluster").isin(list(wanted))).mapInArrow(run, f"query_id long, fragment_id {dict(vectors.dtypes)['fragment_id']}, distance double")


def _wanted(pairs: np.ndarray) -> dict[int, np.ndarray]:
    """cluster -> queries of a matrix of flags, queries by clusters."""
    return {int(c): np.flatnonzero(pairs[:, c]) for c in np.flatnonzero(pairs.any(0))}


def nearest(queries: DataFrame, clusters: Clusters, path: str, k: int = 10, block: int = QUERIES) -> tuple[DataFrame, dict[str, int]]:
    """((query_id, fragment_id, distance, rank), counts): the k nearest by cosine, ties by id, and how many pairs of query and vector there are and were compared.

    The same rows as a full scan.  Queries (query_id, embedding) go in blocks by hash, however many there
    are; those whose vector is null, zero, not finite or of another width find nothing.
    """
    spark = clusters.vectors.sparkSession
    path = f"{path}/{uuid.uuid4().hex}"
    t = clusters.centres.orderBy("cluster").toArrow().combine_chunks()  # MOST rows at most
    layout = f"query_id long, fragment_id {dict(clusters.vectors.dtypes)['fragment_id']}, distance double"
    found, counts = spark.createDataFrame([], layout), {"pairs": 0, "compared": 0}
    if not t.num_rows:
        return found.withColumn("rank", F.lit(1)), counts
    centre, radius, size, label = _matrix(t.column("centre").combine_chunks()), t.column("radius").to_numpy(), t.column("n").to_numpy(), t.column("cluster").to_numpy()
    good = queries.where(finite_vector(F.col("embedding")) & (F.size("embedding") == centre.shape[1])).select("query_id", F.col("embedding").cast("array<double>").alias("embedding"))
    blocks = -(-good.count() // block)
    for number in range(blocks):
        rows = good.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == number).orderBy("query_id").toArrow().combine_chunks()
        if not rows.num_rows:
            continue
        names, unit = rows.column("query_id").to_numpy(), _unit(_matrix(rows.column("embedding").combine_chunks()))
        away = np.sqrt(np.maximum(2 - 2 * unit @ centre.T, 0))
        order = np.argsort(away, axis=1)
        enough = np.cumsum(size[order], axis=1) - size[order] < k
        first = np.zeros_like(away, bool)
        np.put_along_axis(first, order, enough, 1)
        early = write(_near(clusters.vectors, names, unit, {int(label[c]): q for c, q in _wanted(first).items()}, k), f"{path}/early-{number}")
        # a ceiling a query: its k-th distance so far
        by = Window.partitionBy("query_id").orderBy("distance", "fragment_id")
        kth = {r.query_id: r.distance for r in early.withColumn("n", F.row_number().over(by)).where(F.col("n") == k).select("query_id", "distance").collect()}
        ceiling = np.array([kth.get(q, np.inf) for q in names.tolist()])
        reach = np.sqrt(2 * (np.maximum(ceiling, 0) + 1e-9)) + SLACK  # distances are rounded to nine places
        late = ~first & (away - radius <= reach[:, None])
        counts["pairs"] += int(size.sum()) * len(names)
        counts["compared"] += int(((first | late) * size).sum())
        found = found.unionByName(early)
        if late.any():
            found = found.unionByName(write(_near(clusters.vectors, names, unit, {int(label[c]): q for c, q in _wanted(late).items()}, k), f"{path}/late-{number}"))
    by = Window.partitionBy("query_id").orderBy("distance", "fragment_id")
    return found.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= k), counts
