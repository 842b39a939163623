"""What the operators share on the Spark side: written stages, size checks, components."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

WORD = r"[^\x20\x09-\x0D]+"
#: Largest side that is broadcast, in bytes; larger ones are joined by shuffle.
BROADCAST_BYTES = 96 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder that all machines share, from spark.checkpoint.dir.  Where it is unset, a local session, as in tests, gets one of its own; a cluster is an error."""
    if not (at := spark.conf.get("spark.checkpoint.dir", "")):
        found = spark.sparkContext._jsc.sc().getCheckpointDir()
        if not found.isDefined() and not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        at = found.get() if found.isDefined() else tempfile.mkdtemp(prefix="casemill-")
        spark.conf.set("spark.checkpoint.dir", at)
    return at


def stage(df: DataFrame, name: str, *used: DataFrame) -> DataFrame:
    """df, written to the shared folder and read again: cuts the lineage and survives lost executors.  `used`: staged tables that only df needed; they are deleted once df is whole."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.staged_at = path
    discard(*used)
    return out


def discard(*staged: DataFrame) -> None:
    """Deletes staged tables that nothing reads any more; other DataFrames are left alone."""
    for df in staged:
        if path := df.__dict__.pop("staged_at", None):
            at = df.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(at, True)


@contextmanager
def bounded_batches(spark: SparkSession, limit: int = 4 << 20) -> Iterator[None]:
    """Arrow batches of about `limit` bytes in the jobs that run meanwhile, not of 10,000 rows of whatever length: each is once in the executor and once or twice in its Python."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(limit))
    try:
        yield
    finally:
        spark.conf.set(key, before)


@contextmanager
def freed_shuffles(spark: SparkSession) -> Iterator[None]:
    """The shuffle files of each job that ends meanwhile go with it, and do not wait for the driver's garbage collection.  For jobs that write what they make: nothing reads their shuffles again."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, "false")
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.set(key, before)


def small_or_join(left: DataFrame, right: DataFrame, on: str | list[str], how: str, row_bytes: int, rows: int, limit: int = BROADCAST_BYTES) -> DataFrame:
    """left joined with right, which is broadcast only if its measured rows * row_bytes stay within the limit."""
    return left.join(F.broadcast(right) if rows * row_bytes <= limit else right, on, how)


def hot_join(left: DataFrame, right: DataFrame, on: str, n: str, how: str = "inner", row_bytes: int = 64, limit: int = BROADCAST_BYTES, most: int = 10_000) -> DataFrame:
    """left joined with right (staged, a row a key, with the number of left's rows of the key in column n), inner or left.

    Right is broadcast whole if its measured size allows it.  Otherwise its hottest keys are, those with
    over a share 1 / most of all rows, so at most `most` of them, and the rest is joined by shuffle.
    """
    rows, total = right.agg(F.count("*"), F.sum(n)).first()
    if rows * row_bytes <= limit:
        return left.join(F.broadcast(right), on, how)
    hot = F.broadcast(right.where(F.col(n) > (total or 0) / most))
    return left.join(hot, on).unionByName(left.join(hot, on, "left_anti").join(right, on, how))


def keyed(docs: DataFrame, id_col: str, name: str = "__row") -> DataFrame:
    """docs with a number for each row, in the order of the ids, null last: the ids themselves if they are numbers, none null and no two alike; else written numbers, by id and then by the other columns."""
    whole = dict(docs.dtypes)[id_col] in ("tinyint", "smallint", "int", "bigint")
    odd = docs.where(F.col(id_col).isNull()).select(id_col).limit(1).unionByName(docs.groupBy(id_col).count().where("count > 1").select(id_col).limit(1))
    if whole and odd.isEmpty():
        return docs.withColumn(name, F.col(id_col).cast("long"))
    by = [F.col(id_col).asc_nulls_last(), F.xxhash64(*docs.columns)]
    return stage(docs.repartitionByRange(*by).sortWithinPartitions(*by).withColumn(name, F.monotonically_increasing_id()), "keyed")


def buckets_for(spark: SparkSession, least: int = 64) -> int:
    """A power of two, at least four times the shuffle partitions, so that buckets spread evenly over tasks."""
    n = max(least, 4 * int(spark.conf.get("spark.sql.shuffle.partitions", "200")))
    return 1 << (n - 1).bit_length()


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """Connected components of undirected edges (a, b), as (id, component) with the smallest id of each.

    Alternates large-star and small-star steps; every step is a grouped minimum, which tasks combine
    before they send, and the minima go back to the edges by `hot_join`, so a vertex with a third of all
    edges is not one task's.  Every round is written to the shared folder; the round before is deleted.
    Ids without an edge are not returned.  Equal ids and repeated edges do no harm.
    """
    e = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    e = stage(e, "edges")
    small = e.count() * 64 <= BROADCAST_BYTES  # so are the minima, and edges never grow in number
    seen = None
    for _ in range(rounds):
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("degree")).select("a", F.least("a", "m").alias("m"), "degree")
        low = F.broadcast(low) if small else stage(low, "low")
        large = (both.where("b > a").join(low, "a") if small else hot_join(both.where("b > a"), low, "a", "degree")).select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        large = large if small else stage(large, "large", low)
        least = large.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("degree"))
        least = F.broadcast(least) if small else stage(least, "low")
        forest = (large.join(least, "a") if small else hot_join(large, least, "a", "degree")).select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e")).select("e.*")
        e = stage(forest.where("a <> b").distinct(), "edges", e, large, least)
        # a star forest no longer changes: compare its size and sums
        now = e.agg(F.count("*"), F.sum(F.hash("a", "b").cast("long")), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first()
        if now == seen:
            break
        seen = now
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    out = e.groupBy(F.col("a").alias("id")).agg(F.min("b").alias("component")).unionByName(e.select(F.col("b").alias("id"), F.col("b").alias("component")).distinct())
    return stage(out, "components", e)
