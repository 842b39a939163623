"""Embedding near-dedup by Euclidean p-stable hashing.

A unit vector's projection on a Gaussian direction, shifted and cut into cells of a fixed width, is a
2-stable hash: near vectors share cells.  `probes` such cells make a table's bucket; several tables
give recall.  Vectors of one bucket and label are compared exactly, in double precision, by blocks of
a bounded size, and a pair counts in the first table that brings it together.  Equal vectors are
collapsed before anything is sent.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from casemill.llm.shared import components, hot_join, small_or_join, stage

WIDTH = 1.5


def _same_cell(distance: float) -> float:
    """Chance that two points at this distance share a cell of one projection."""
    c = WIDTH / distance
    normal = 0.5 * math.erfc(c / math.sqrt(2))
    return 1 - 2 * normal - 2 / (math.sqrt(2 * math.pi) * c) * (1 - math.exp(-c * c / 2))


def tables_for(n: int, threshold: float, recall: float, mates: float = 4.0) -> tuple[int, int]:
    """(cells a bucket, tables): unrelated vectors meet about `mates` others a bucket; pairs just at the threshold are found with chance `recall`."""
    near, far = _same_cell(math.sqrt(2 - 2 * threshold)), _same_cell(math.sqrt(2))
    cells = max(4, math.ceil(math.log(max(n, 1) / mates) / -math.log(far)) if n > mates else 4)
    return cells, max(4, math.ceil(math.log(1 - recall) / math.log(1 - near**cells)))


def _links(vectors: np.ndarray, sizes: np.ndarray, cells: np.ndarray, table: int, block: np.ndarray, across: bool, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """(links of each row, its smallest connected row) inside one group of rows; across its two blocks only, if it stands for two."""
    near = vectors @ vectors.T >= threshold
    np.fill_diagonal(near, False)
    if across:
        near &= block[:, None] != block[None, :]
    a, b = np.nonzero(near)
    if table and len(a):
        late = (cells[a, :table] == cells[b, :table]).any(1)
        near[a[late], b[late]] = False
    root = np.arange(len(sizes))
    while True:
        low = np.minimum(root, np.where(near, root[None, :], len(sizes)).min(1))
        low = low[low]
        if (low == root).all():
            return near @ sizes, root
        root = low


def near_links(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", threshold: float = 0.93, recall: float = 0.975, block_rows: int = 512) -> DataFrame:
    """One row per row of vectors: id, n_links, component_id, kept.

    Rows link if their labels are equal and not null and their cosine is at least the threshold.  A
    vector that is null, empty or zero, or that holds null or non-finite parts, links with nothing: it
    is its own component and is kept.  Vectors of other lengths never link.  Repeated rows are vectors
    of their own, linked with each other, and all have the smallest id of their component.  Extra
    columns are ignored.  An empty table gives an empty table.
    """
    v = F.col(vector_col)
    good = F.col(label_col).isNotNull() & v.isNotNull() & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))) & F.exists(v, lambda x: x != 0)
    node = F.when(F.coalesce(good, F.lit(False)), F.md5(F.concat_ws(",", F.col(label_col).cast("string"), v.cast("array<string>"))))
    own = vectors.select(F.col(id_col).alias("id"), F.col(label_col).cast("string").alias("label"), v.cast("array<double>").alias("vector"), node.alias("node"))
    classes = stage(own.where("node is not null").groupBy("node").agg(F.min("id").alias("low"), F.count("*").alias("size"), F.any_value("label").alias("label"), F.any_value("vector").alias("vector")), "classes")
    per_label = classes.groupBy("label", F.size("vector").alias("width")).count().agg(F.max("count"), F.max("width")).first()
    cells, tables = tables_for(per_label[0] or 0, threshold, recall)

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            col = batch.column("vector")
            width = np.diff(col.offsets.to_numpy())
            out = np.zeros((len(col), tables), np.int64)
            for w in np.unique(width):
                at = np.flatnonzero(width == w)
                x = np.array([col[int(i)].as_py() for i in at])
                x /= np.abs(x).max(1, keepdims=True)
                x /= np.linalg.norm(x, axis=1, keepdims=True)
                r = np.random.RandomState(7)
                step = np.floor((x @ r.standard_normal((w, tables * cells)) + r.uniform(0, WIDTH, tables * cells)) / WIDTH).astype(np.int64)
                mult = r.randint(1 << 20, 1 << 62, cells) | 1
                with np.errstate(over="ignore"):
                    out[at] = (step.reshape(-1, tables, cells) * mult).sum(2) * np.int64(1 << 10 | 1) + int(w)
            yield pa.RecordBatch.from_arrays([batch.column("node"), batch.column("size"), batch.column("label"), col, pa.array(list(out), pa.list_(pa.int64()))], ["node", "size", "label", "vector", "cells"])

    rows = stage(classes.select("node", "size", "label", "vector").mapInArrow(hashed, "node string, size long, label string, vector array<double>, cells array<long>"), "hashed")
    spots = rows.select("node", "label", F.posexplode("cells").alias("t", "cell"))
    counts = stage(spots.groupBy("label", "t", "cell").agg(F.count("*").alias("n")).where("n > 1"), "buckets")
    total = counts.agg(F.count("*")).first()[0]
    shared = small_or_join(rows.select("node", "size", "label", "vector", "cells", F.posexplode("cells").alias("t", "cell")), counts, ["label", "t", "cell"], "inner", 64, total)
    blocks = F.ceil(F.col("n") / block_rows).cast("int")
    placed = shared.withColumn("own", F.pmod(F.xxhash64("node"), blocks).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
    placed = placed.select("label", "t", "cell", F.size("vector").alias("width"), F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "node", "size", "vector", "cells")
    keys = ["label", "t", "cell", "width", "i", "j"]  # vectors of two widths may share a cell by chance

    def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None

        def done(t: pa.Table, last: bool) -> tuple[pa.RecordBatch | None, pa.Table | None]:
            t = t.combine_chunks()
            key = np.array(list(zip(*(t.column(k).to_pylist() for k in keys))), dtype=object)
            cut = np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]).any(1)]))
            ends = np.append(cut[1:], len(t))
            rest = None
            if not last:
                rest = t.slice(cut[-1])
                cut, ends = cut[:-1], ends[:-1]
            nodes, sizes, own, table, i, j = (t.column(c).to_numpy() for c in ("node", "size", "own", "t", "i", "j"))
            lists = t.column("vector").combine_chunks()
            flat, off = lists.values.to_numpy(), lists.offsets.to_numpy()
            tabs = t.column("cells").combine_chunks()
            cell = tabs.values.to_numpy().reshape(-1, tables) if len(t) else np.zeros((0, tables), np.int64)
            cell = cell[int(tabs.offsets[0].as_py()) // tables :][: len(t)]
            out: tuple[list, list, list] = ([], [], [])
            for a, b in zip(cut, ends):
                if b - a < 2:
                    continue
                x = flat[off[a] : off[b]].reshape(b - a, -1)
                x = x / np.abs(x).max(1, keepdims=True)
                x = x / np.linalg.norm(x, axis=1, keepdims=True)
                n, root = _links(x, sizes[a:b], cell[a:b], table[a], own[a:b], i[a] != j[a], threshold)
                for k in np.flatnonzero(n):
                    out[0].append(nodes[a + k])
                    out[1].append(int(n[k]))
                    out[2].append(nodes[a + root[k]])
            if not out[0]:
                return None, rest
            return pa.RecordBatch.from_arrays([pa.array(out[0]), pa.array(out[1], pa.int64()), pa.array(out[2])], ["node", "n", "root"]), rest

        for batch in batches:
            new = pa.Table.from_batches([batch])
            if not len(new):
                continue
            made, held = done(pa.concat_tables([held, new]) if held is not None and len(held) else new, False)
            if made is not None:
                yield made
        if held is not None and len(held):
            made, _ = done(held, True)
            if made is not None:
                yield made

    found = stage(placed.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(compared, "node string, n long, root string"), "links")
    groups = components(found.select(F.col("node").alias("a"), F.col("root").alias("b")))
    lows = classes.select("node", "low").join(groups.withColumnRenamed("id", "node"), "node")
    least = lows.groupBy("component").agg(F.min("low").alias("component_low"))
    linked = found.groupBy("node").agg(F.sum("n").alias("n"))
    facts = classes.select("node", "size", "low").join(linked, "node", "left").join(groups.withColumnRenamed("id", "node"), "node", "left").join(least, "component", "left")
    facts = facts.select("node", (F.coalesce("n", F.lit(0)) + F.col("size") - 1).alias("n"), F.coalesce("component_low", "low").alias("component"), "size")
    facts = stage(facts, "facts", found, groups, rows, counts, classes)
    # rows without a good vector have no node: they stay where they are
    alone = own.where("node is null").select("id", F.lit(0).cast("long").alias("n"), F.col("id").alias("component"))
    out = hot_join(own.where("node is not null").select("id", "node"), facts, "node", "size", row_bytes=96).select("id", "n", "component").unionByName(alone)
    component = F.coalesce("component", "id")
    return out.select(F.col("id").alias(id_col), F.coalesce("n", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.col("id").eqNullSafe(component).alias("kept"))


def op10(spark, sf_dir: str) -> DataFrame:
    return near_links(spark.read.parquet(f"{sf_dir}/embeddings.parquet")).select("vec_id", "n_links", F.col("component_id").cast("long").alias("component_id"), "kept")
