"""N-gram Jaccard join: exact, by pivots, Voronoi regions and triangle-inequality windows.

Jaccard distance is a metric, but a document's distance to nearly every other one is 1, which no pivot
can tell apart.  So documents that can have no link go first, and what is left is cut where distances
are 1 or nearly so, before pivots work:

1. Shingles that are in one document only are counted out.  A document links only if at least the share
   `least` / `of` of its shingles is in others too; all others are done.
2. Documents with equal sets are one point; links between them are certain.
3. Two linked sets share one of the n - ceil(n * least / of) + 1 rarest shingles of each, in any one
   order of all shingles.  Points that share such a shingle and whose sketches, counts of shingles by
   part of the hash space, differ by no more than linked sets can, directly or through others, are a
   cluster; no link leaves it.
4. A cluster is joined recursively.  Some points become pivots, every point belongs to the Voronoi region
   of the nearest one, those at distance 1 from all pivots to an outer region.  A point is copied into
   the window of another region if its distance to that pivot is within twice the link distance of its
   own, so a linked pair meets in the region of each of the two.  Regions go on the same way until they
   are small or no longer shrink; there, points are measured unless the triangle inequality over
   earlier pivots, their sizes, or being connected already makes it needless.
5. A cluster of bounded work does this in one task.  Larger ones are dealt to regions by Spark first,
   over all their points; a region that does not shrink is cut into blocks, and a task takes two.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from hashlib import md5
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from casemill.llm.arrays import Slice, U, groups_of, slices, span_hash, tokens, words_window
from casemill.llm.repeats import broadcast_filter, filter_rows, repeated_places
from casemill.llm.shared import BROADCAST_BYTES, components, discard, hot_join, keyed, small_or_join, stage

#: Points times shingles of a cluster that one task takes.
CLUSTER_WORK = 400_000_000
#: Points of a region that are measured without further pivots, and pivots of a larger one.
LEAF, PIVOTS = 4, 16
#: Earlier pivots whose distances are held against a new one.
HELD = 8
#: Rounds of regions that Spark deals, before blocks.
ROUNDS = 3
#: Cells, as bits, of the counts by which shingles are ordered; any counts give exact results.
CELL_BITS = 22
#: Parts of a sketch, and points with one shingle in common whose sketches are compared; more are a cluster as they are.
PARTS, SKETCHED = 64, 2000


def shingles(s: Slice, words: int) -> tuple[np.ndarray, np.ndarray]:
    """(first, hashes): every document's distinct shingles, sorted; document d has hashes[first[d] : first[d + 1]]."""
    t = tokens(s, lower=True)
    w = t.hashes()
    at, h = words_window(t, w, words)
    n = np.diff(t.first)
    short = np.flatnonzero((n > 0) & (n < words))
    doc = np.concatenate([t.doc[at], short])
    h = np.concatenate([h, span_hash(w, t.first[short], t.first[short + 1])])
    order = np.lexsort((h, doc))
    doc, h = doc[order], h[order]
    keep = np.ones(len(h), bool)
    keep[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
    return np.searchsorted(doc[keep], np.arange(len(s.off))), h[keep]


def least_shared(n, least: int, of: int):
    """Shingles that a set of n shares at least with any set that it is linked with."""
    return -(-n * least // of)


def _facts(texts: DataFrame, words: int, least: int, of: int, limit: int) -> tuple[DataFrame, DataFrame]:
    """(sizes, sets): (id, n) of every text, and (id, digest, n, shingles) of those that may have a link. texts: key, id, text."""

    def emit(s: Slice, _: object) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        first, h = shingles(s, words)
        n = np.diff(first)
        return np.repeat(np.arange(len(n)), n), np.arange(len(h)) - np.repeat(first[:-1], n), h

    segments = filter_rows(texts.select("key", "text"), emit, 2)
    met = broadcast_filter(segments, limit)
    discard(segments)
    used = []
    texts = texts.withColumn("shared", F.lit(None).cast("long"))
    if met is None:
        runs = repeated_places(texts.select("key", "text"), emit).select("key", F.aggregate(F.zip_with("starts", "ends", lambda a, b: b - a), F.lit(0), lambda t, x: t + x).cast("long").alias("shared"))
        used.append(stage(runs, "shared"))
        texts = small_or_join(texts.drop("shared"), used[0], "key", "left", 48, used[0].count(), limit).withColumn("shared", F.coalesce("shared", F.lit(0)))

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            told = batch.column("shared").to_numpy(zero_copy_only=False)
            for s in slices(batch.column("text")):
                first, h = shingles(s, words)
                n = np.diff(first)
                if met is None:
                    shared = told[s.row0 : s.row1].astype(np.int64)
                else:
                    shared = np.diff(np.concatenate([[0], np.cumsum(met.value.has(h))])[first])
                may = (n > 0) & (shared >= least_shared(n, least, of))
                own = [h[a:b] if m else None for a, b, m in zip(first, first[1:], may)]
                yield pa.RecordBatch.from_arrays([batch.column("id").slice(s.row0, s.row1 - s.row0), pa.array(n, pa.int64()), pa.array([None if x is None else md5(x.tobytes()).digest() for x in own], pa.binary()), pa.array([None if x is None else x.astype(np.int64) for x in own], pa.list_(pa.int64()))], ["id", "n", "digest", "shingles"])

    facts = stage(texts.select("id", "text", "shared").mapInArrow(each, "id long, n long, digest binary, shingles array<long>"), "sets", *used)
    return facts.select("id", "n"), facts


def _levels(sets: DataFrame):
    """A broadcast of how often the shingles of each cell of the hash space come in `sets`, on a log scale; its size is fixed."""
    cells, part = 1 << CELL_BITS, 1 << 16

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(cells, np.uint32)
        for batch in batches:
            h = batch.column("shingles").flatten().to_numpy().view(U)
            at, k = np.unique(h >> U(64 - CELL_BITS), return_counts=True)
            n[at.astype(np.int64)] += k.astype(np.uint32)
        for a in range(0, cells, part):
            at = np.flatnonzero(n[a : a + part])
            if len(at):
                yield pa.RecordBatch.from_arrays([pa.array([a], pa.int32()), pa.array([at.astype("<u2").tobytes()], pa.binary()), pa.array([n[a + at].astype("<u4").tobytes()], pa.binary())], ["at", "cells", "counts"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for r in batch.to_pylist():
                own = total.setdefault(r["at"], np.zeros(part))
                own[np.frombuffer(r["cells"], "<u2")] += np.frombuffer(r["counts"], "<u4")
        for a, n in total.items():
            level = np.where(n > 0, np.minimum(1 + 8 * np.log2(np.maximum(n, 1)), 255), 0).astype(np.uint8)
            yield pa.RecordBatch.from_arrays([pa.array([a], pa.int32()), pa.array([level.tobytes()], pa.binary())], ["at", "levels"])

    rows = sets.select("shingles").mapInArrow(count, "at int, cells binary, counts binary").repartition("at").mapInArrow(add, "at int, levels binary")
    out = np.zeros(cells, np.uint8)
    for r in rows.toLocalIterator():
        out[r.at : r.at + part] = np.frombuffer(bytes(r.levels), np.uint8)
    return sets.sparkSession.sparkContext.broadcast(out)


def _signatures(sets: DataFrame, least: int, of: int) -> DataFrame:
    """(sig, point, n, sketch): the rarest shingles of each point, those that any linked point must share one of; and how many of its shingles are in each part of the hash space, 255 at most."""
    levels = _levels(sets)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            h = batch.column("shingles").flatten().to_numpy().view(U)
            n = batch.column("n").to_numpy()
            doc = np.repeat(np.arange(len(n)), n)
            level = levels.value[(h >> U(64 - CELL_BITS)).astype(np.int64)]
            order = np.lexsort((h, level, doc))
            turn = np.arange(len(h)) - np.repeat(np.cumsum(n) - n, n)
            # level 1: nothing else is in the shingle's cell
            keep = (turn < (n - least_shared(n, least, of) + 1)[doc]) & (level[order] > 1)
            parts = np.minimum(np.bincount(doc * PARTS + (h >> U(58)).astype(np.int64), minlength=PARTS * len(n)), 255).astype(np.uint8).reshape(-1, PARTS)
            sketch = pa.array([x.tobytes() for x in parts], pa.binary())
            at = pa.array(doc[keep])
            yield pa.RecordBatch.from_arrays([pa.array(h[order[keep]].astype(np.int64)), batch.column("point").take(at), batch.column("n").take(at), sketch.take(at)], ["sig", "point", "n", "sketch"])

    return sets.select("point", "n", "shingles").mapInArrow(each, "sig long, point long, n long, sketch binary")


def _edges(marks: DataFrame, least: int, of: int) -> DataFrame:
    """(a, b): edges that connect the points of each sig (a sig, point, n, sketch a row) whose sketches do not rule a link out."""

    def told(sig: np.ndarray, point: np.ndarray, n: np.ndarray, sketch: np.ndarray) -> Iterator[pa.RecordBatch]:
        # sets that differ in d shingles have sketches that differ by d at most
        near = lambda i, j: np.abs(sketch[i] - sketch[j]).sum(-1) * (of + least) <= (n[i] + n[j]) * (of - least)
        first = np.flatnonzero(np.concatenate([[True], sig[1:] != sig[:-1]]))
        size = np.diff(np.append(first, len(sig)))
        two = first[size == 2]
        two = two[near(two, two + 1)]
        a, b = [point[two]], [point[two + 1]]
        for f, m in zip(first[size > 2], size[size > 2]):
            at = np.arange(f, f + m)
            root = np.arange(m)
            for i in range(m - 1):
                rest = i + 1 + np.flatnonzero(root[i + 1 :] != root[i])
                for j in rest[near(at[i], at[rest])] if len(rest) else ():
                    if root[j] != root[i]:
                        low, high = sorted((root[i], root[j]))
                        root[root == high] = low
            some = root != np.arange(m)
            a.append(point[at[root[some]]])
            b.append(point[at[some]])
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(a)), pa.array(np.concatenate(b))], ["a", "b"])

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in chain(batches, [None]):
            if batch is not None:
                t = pa.Table.from_batches([batch])
                t = (t if held is None else pa.concat_tables([held, t])).combine_chunks()
            elif held is None:
                return
            else:
                t = held
            sig = t.column("sig").to_numpy()
            last = len(sig) if batch is None else int(np.searchsorted(sig, sig[-1])) if len(sig) else 0
            if last:
                x = t.slice(0, last)
                sketch = np.frombuffer(b"".join(x.column("sketch").to_pylist()), np.uint8).reshape(-1, PARTS).astype(np.int16)
                yield from told(sig[:last], x.column("point").to_numpy(), x.column("n").to_numpy(), sketch)
            held = t.slice(last)

    return marks.repartition("sig").sortWithinPartitions("sig", "point").mapInArrow(each, "a long, b long")


class Cluster:
    """The points of a cluster, or of two of its blocks, and what is known to connect them."""

    def __init__(self, points: np.ndarray, n: np.ndarray, shingles: np.ndarray, label: np.ndarray, block: np.ndarray, across: bool, least: int, of: int):
        self.points, self.n, self.block, self.across, self.least, self.of = points, n, block, across, least, of
        self.root = np.arange(len(points))
        self.part = np.unique(label, return_inverse=True)[1]  # what is connected, through labels too
        self.bounds = np.concatenate([[0], np.cumsum(n)])
        # for each place of a shingle in a set, the points that have the shingle: holders[first : first + many]
        order = np.argsort(shingles, kind="stable")
        self.holders = np.repeat(np.arange(len(points)), n)[order]
        start = np.flatnonzero(np.concatenate([[True], shingles[order][1:] != shingles[order][:-1]])) if len(order) else order
        many = np.diff(np.append(start, len(order)))
        self.first, self.many = np.empty(len(order), np.int64), np.empty(len(order), np.int64)
        self.first[order], self.many[order] = np.repeat(start, many), np.repeat(many, many)
        self.near = 1 - least / of + 1e-9

    def measured(self, p: int, at: np.ndarray) -> np.ndarray:
        """Distances of p to these points; those that link are connected.  Only points that share a shingle with p are counted."""
        own = slice(self.bounds[p], self.bounds[p + 1])
        first, many = self.first[own], self.many[own]
        met = self.holders[np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many) + np.repeat(first, many)]
        both = np.bincount(met, minlength=len(self.points))[at]
        union = self.n[at] + self.n[p] - both
        for x in at[both * self.of >= union * self.least]:
            if self.part[x] != self.part[p]:
                self.part[self.part == self.part[x]] = self.part[p]
            if self.root[x] != self.root[p]:
                low, high = sorted((self.root[x], self.root[p]))
                self.root[self.root == high] = low
        return 1 - both / union

    def leaf(self, at: np.ndarray) -> None:
        distances: list[np.ndarray] = []  # to earlier pivots, nan where not measured
        for k, p in enumerate(at[:-1]):
            rest = at[k + 1 :]
            want = (self.part[rest] != self.part[p]) & (np.minimum(self.n[rest], self.n[p]) * self.of >= np.maximum(self.n[rest], self.n[p]) * self.least)
            if self.across:
                want &= self.block[rest] != self.block[p]
            for d in distances[-HELD:]:
                want &= ~(np.abs(d[k + 1 :] - d[k]) > self.near)
            want = np.flatnonzero(want)
            if len(want):
                d = np.full(len(at), np.nan)
                d[k + 1 + want], d[k] = self.measured(p, rest[want]), 0.0
                distances.append(d)

    def join(self, at: np.ndarray) -> None:
        """Connects these points wherever a link does: by Voronoi regions of pivots, each with its window, and so on."""
        if len(at) <= LEAF:
            return self.leaf(at)
        if (self.part[at] == self.part[at[0]]).all():
            return None
        pivots = min(PIVOTS, 1 + math.isqrt(len(at)))
        to = np.full((pivots, len(at)), 2.0)
        pivot = 0
        for k in range(pivots):  # each new pivot is the point farthest from those before
            to[k] = self.measured(int(at[pivot]), at)
            least = to[: k + 1].min(0)
            pivot = int(least.argmax())
        windows = [window for region, window in voronoi(to, self.near) if region.any()]
        if max(window.sum() for window in windows) > 0.8 * len(at):  # regions that do not shrink: one pass over all
            return self.leaf(at)
        for window in windows:
            self.join(at[window])
        return None

    def forest(self) -> np.ndarray:
        """For each point the smallest that it is connected with by links found here."""
        low = np.full(len(self.points), np.iinfo(np.int64).max)
        np.minimum.at(low, self.root, self.points)
        return low[self.root]


def voronoi(to: np.ndarray, near: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(points of the region, points of its window) for each pivot and for the outer region, from the distances pivots x points."""
    least, own = to.min(0), to.argmin(0)
    outer = least >= 1
    for k in range(len(to)):
        yield (own == k) & ~outer, to[k] <= least + 2 * near
    yield outer, least >= 1 - near


def _joined(clusters: DataFrame, sets: DataFrame, least: int, of: int) -> DataFrame:
    """(point, root): a forest of the links in clusters (cluster, point, n, label); points of equal labels are connected already.  A cluster of too much work for a task goes by pairs of blocks."""
    sizes = stage(clusters.groupBy("cluster").agg(F.count("*").alias("rows"), F.greatest(F.lit(1), F.ceil(F.sqrt(F.count("*") * F.sum("n") / CLUSTER_WORK))).cast("int").alias("blocks")), "sizes")
    x = hot_join(clusters.select("cluster", "point", "label"), sizes, "cluster", "rows").drop("rows").withColumn("own", F.pmod(F.xxhash64("point"), F.col("blocks")).cast("int"))
    x = stage(x, "placed")
    # the sets are sent once, to their tasks: what they are joined with is small, if its measured size says so
    y = small_or_join(sets.select("point", "n", "shingles"), x, "point", "inner", 64, x.count()).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    i, j = F.least("own", "other"), F.greatest("own", "other")
    y = y.select(F.concat_ws("/", "cluster", i, j).alias("task"), (i != j).alias("across"), "own", "point", "label", "n", "shingles")

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in groups_of(batches, "task"):
            t = t.combine_chunks()
            lists = t.column("shingles").combine_chunks()
            points, n, label, own = (t.column(c).to_numpy() for c in ("point", "n", "label", "own"))
            c = Cluster(points, n, lists.flatten().to_numpy(), label, own, t.column("across")[0].as_py(), least, of)
            c.join(np.arange(len(points)))
            low = c.forest()
            some = low != points
            yield pa.RecordBatch.from_arrays([pa.array(points[some]), pa.array(low[some])], ["point", "root"])

    return stage(y.repartition("task").sortWithinPartitions("task", "point").mapInArrow(each, "point long, root long"), "links", x, sizes)


def _dealt(work: DataFrame, sets: DataFrame, least: int, of: int) -> DataFrame:
    """(cluster, point, n, label, pivot, parent): the Voronoi regions of clusters too large for a task, as clusters; pivot: a linked pivot, if any."""
    spark = work.sparkSession
    pivots = work.select("cluster", "point", "n").distinct().withColumn("turn", F.row_number().over(Window.partitionBy("cluster").orderBy(F.xxhash64("point"), "point"))).where(F.col("turn") <= PIVOTS)
    pivots = stage(pivots.select("cluster", "point", "n"), "pivots")
    size = pivots.agg(F.sum(8 * F.col("n") + 64)).first()[0] or 0
    passes = max(1, -(-size // BROADCAST_BYTES))
    near = 1 - least / of + 1e-9
    out = None
    for k in range(passes):  # a pass takes the clusters whose pivots one broadcast holds
        mine = F.pmod(F.xxhash64("cluster"), F.lit(passes)) == k
        own = pivots.where(mine)
        heads: dict[int, list[tuple[int, np.ndarray]]] = {}
        for r in small_or_join(sets.select("point", "shingles"), own.select("point", "cluster"), "point", "inner", 64, own.count()).toLocalIterator():
            heads.setdefault(r.cluster, []).append((r.point, np.array(r.shingles, np.int64)))
        tables = {}
        for c, found in heads.items():
            found.sort(key=lambda x: x[0])
            keys, back = np.unique(np.concatenate([x for _, x in found]), return_inverse=True)
            bits = np.zeros(len(keys), np.uint32)
            np.bitwise_or.at(bits, back, np.repeat(np.uint32(1) << np.arange(len(found), dtype=np.uint32), [len(x) for _, x in found]))
            tables[c] = keys, bits, np.array([p for p, _ in found]), np.array([len(x) for _, x in found])
        shared = spark.sparkContext.broadcast(tables)

        def each(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if not batch.num_rows:
                    continue
                cluster, point, n, label, parent = (batch.column(c).to_numpy() for c in ("cluster", "point", "n", "label", "parent"))
                flat, bounds = batch.column("shingles").flatten().to_numpy(), np.concatenate([[0], np.cumsum(n)])
                for c in np.unique(cluster):
                    at = np.flatnonzero(cluster == c)
                    keys, bits, names, sizes = shared.value[int(c)]
                    first = np.cumsum(n[at]) - n[at]
                    h = flat[np.arange(n[at].sum()) - np.repeat(first, n[at]) + np.repeat(bounds[at], n[at])]
                    place = np.minimum(np.searchsorted(keys, h), len(keys) - 1)
                    met = np.where(keys[place] == h, bits[place], 0)
                    both = np.stack([np.add.reduceat((met >> np.uint32(k)) & np.uint32(1), first).astype(np.int64) for k in range(len(names))])
                    union = n[at][None, :] + sizes[:, None] - both
                    to = 1 - both / union
                    linked = both * of >= union * least
                    pivot = np.where(linked.any(0), names[linked.argmax(0)], -1)
                    for k, (_, window) in enumerate(voronoi(to, near)):
                        w = np.flatnonzero(window)
                        if len(w):
                            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(w), c)), pa.array(np.full(len(w), k), pa.int32()), pa.array(point[at[w]]), pa.array(n[at[w]]), pa.array(np.where(pivot[w] >= 0, pivot[w], label[at[w]])), pa.array(pivot[w]), pa.array(parent[at[w]])], ["cluster", "region", "point", "n", "label", "pivot", "parent"])

        rows = work.where(mine)
        x = small_or_join(sets.select("point", "shingles"), rows.select("cluster", "point", "n", "label", "parent"), "point", "inner", 64, rows.count())
        x = x.mapInArrow(each, "cluster long, region int, point long, n long, label long, pivot long, parent long")
        out = x if out is None else out.unionByName(x)
    # should two regions get one name, they are joined as one
    return stage(out.select(F.xxhash64("cluster", "region").alias("cluster"), "point", "n", "label", "pivot", "parent"), "regions", pivots)


def _links(clusters: DataFrame, sets: DataFrame, least: int, of: int) -> DataFrame:
    """(point, root): a forest of all links in clusters (cluster, point, n)."""
    work = stage(clusters.withColumn("label", F.col("point")).withColumn("parent", F.lit(1 << 60)), "work")
    found = []
    for k in range(ROUNDS + 1):
        sizes = work.groupBy("cluster").agg(F.count("*").alias("rows"), F.sum("n").alias("sum"), F.min("label").alias("a"), F.max("label").alias("b")).where("a <> b")
        sizes = stage(sizes.select("cluster", "rows", (F.col("rows") * F.col("sum") <= CLUSTER_WORK).alias("small")), "sizes")
        now = stage(hot_join(work.drop("pivot"), sizes, "cluster", "rows"), "open", work, sizes)
        large = ~F.col("small") & (F.col("rows") <= 0.8 * F.col("parent")) & F.lit(k < ROUNDS)
        found.append(_joined(now.where(~large), sets, least, of))
        rest = now.where(large)
        if rest.isEmpty():
            discard(now)
            break
        work = _dealt(rest.select("cluster", "point", "n", "label", F.col("rows").alias("parent")), sets, least, of)
        found.append(stage(work.where("pivot >= 0 and pivot <> point").select("point", F.col("pivot").alias("root")).distinct(), "links", now))
    out = found[0]
    for x in found[1:]:
        out = out.unionByName(x)
    return stage(out, "links", *found)


def link_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, least: int = 80, of: int = 100, limit: int = BROADCAST_BYTES, unique: bool = False) -> DataFrame:
    """One row per row of docs: id, n_shingles, component_id.

    A-Z count as a-z; words are runs of characters other than space and \\x09-\\x0D.  A set is the
    distinct shingles of `words` words, or the whole sequence of a shorter text; texts without words
    are empty and link with nothing.  Two documents link when of * |both| >= least * |either|;
    component_id is the smallest id reachable by links, the own one included, null if all are.  Ids are
    integers; rows with null ids and rows that repeat an id are documents of their own.  Null texts are
    empty.  Extra columns are ignored.  An empty table gives an empty table.  unique: no id is null or
    repeated, as the caller knows.
    Shingles are compared by 64-bit hashes, two documents at a time, equal sets by 128 bits.
    """
    own = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    if not unique:
        rows = keyed(own, "id")
        if hasattr(rows, "staged_at"):
            linked = stage(link_documents(rows, "__row", "text", words, least, of, limit, unique=True), "linked")
            # rows are numbered in the order of their ids, null last
            many = linked.groupBy("component_id").agg(F.count("*").alias("many"))
            low = stage(rows.select(F.col("__row").alias("component_id"), F.col("id").alias("low")).join(many, "component_id"), "low")
            named = hot_join(linked.join(rows.select("__row", "id"), "__row"), low, "component_id", "many")
            return stage(named.select(F.col("id").alias(id_col), "n_shingles", F.col("low").alias("component_id")), "linked", linked, low, rows)
    # of equal texts the one with the smallest id goes on
    own = own.withColumn("key", F.unhex(F.md5("text")))
    copies = stage(own.groupBy("key").agg(F.min("id").alias("rep"), F.count("*").alias("copies")).where("copies > 1"), "copies")
    named = hot_join(own, copies, "key", "copies", "left").drop("copies")
    same = stage(named.where("rep is not null").select("id", "rep"), "same")
    sizes, facts = _facts(named.where("rep is null or rep = id").select("key", "id", "text"), words, least, of, limit)

    # equal sets are one point, known by its smallest id
    found = facts.where("shingles is not null")
    points = stage(found.groupBy("digest").agg(F.min("id").alias("point"), F.count("*").alias("copies")), "points")
    stats = stage(hot_join(found.select("id", "n", "digest"), points, "digest", "copies").select("id", "point", "n"), "stats")
    main = stats.where("id = point").select(F.col("id"), "point")
    sets = stage(small_or_join(found.select("id", "n", "shingles"), main, "id", "inner", 32, main.count()).drop("id"), "sets", points)
    sizes = stage(sizes, "sizes", facts)

    marks = stage(_signatures(sets, least, of), "signatures")
    shared = stage(marks.groupBy("sig").agg(F.min("point").alias("a"), F.count("*").alias("many")).where("many > 1"), "shared")
    met = hot_join(marks, shared, "sig", "many")
    star = met.where(F.col("many") > SKETCHED).select("a", F.col("point").alias("b")).where("a <> b")
    edges = _edges(met.where(F.col("many") <= SKETCHED).select("sig", "point", "n", "sketch"), least, of).unionByName(star).distinct()
    clusters = components(edges).select(F.col("id").alias("point"), F.col("component").alias("cluster"))
    discard(marks, shared)
    clusters = stage(clusters.join(stats.where("id = point").select("point", "n"), "point"), "clusters")
    links = _links(clusters, sets, least, of)
    groups = components(links.select(F.col("point").alias("a"), F.col("root").alias("b"))).withColumnRenamed("id", "point")

    # a component's smallest id is its smallest point: a point is the smallest of its ids
    top = stage(stats.join(groups, "point", "left").select("id", F.coalesce("component", "point").alias("c")), "tops", groups, stats, links, clusters, sets)
    one = stage(sizes.join(top, "id", "left").select("id", "n", F.coalesce("c", "id").alias("c")), "tops", top)
    # and so for equal texts
    named = same.select(F.col("id").alias("copy"), F.col("rep").alias("id"))
    reps = stage(one.join(same.groupBy(F.col("rep").alias("id")).agg(F.count("*").alias("copies")), "id"), "reps")
    many = hot_join(named, reps, "id", "copies").select(F.col("copy").alias("id"), "n", F.when(F.col("n") > 0, F.col("c")).otherwise(F.col("copy")).alias("c"))
    out = small_or_join(one, same.select("id"), "id", "left_anti", 16, same.count()).unionByName(many)
    out = stage(out, "linked", one, same, copies, reps)
    named = out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.col("c").alias("component_id"))
    named.staged_at = out.staged_at
    return named


def op2(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return link_documents(docs, words=3, least=90, of=100)


OP2_SQL = r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
places AS (SELECT doc_id, w, unnest(generate_series(1, greatest(len(w) - 2, 1))) AS i FROM d WHERE len(w) > 0),
shingles AS (SELECT DISTINCT doc_id, array_to_string(w[i : i + 2], ' ') AS s FROM places),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
shared AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS i FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY ALL),
links AS (SELECT a, b FROM shared JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * i >= 90 * (x.n + y.n - i)),
reach(a, b) AS (SELECT doc_id, doc_id FROM d UNION SELECT r.a, l.b FROM reach r JOIN links l ON l.a = r.b)
SELECT d.doc_id, coalesce(n, 0) AS n_shingles, min(b) AS component_id FROM d JOIN reach ON a = d.doc_id LEFT JOIN sizes USING (doc_id) GROUP BY ALL
"""
