"""Hard negatives by bounds along a spanning tree of the anchors.

Anchors are taken in blocks; a block and its minimum spanning tree (by Euclidean distance, an edge from each
anchor to its parent) go to the tasks that read all rows.  A row x with score s at the parent has a score in
s +- distance * |x| at the child (Cauchy-Schwarz); where the parent's own score was left out, its bounds are
widened instead.  Only if these bounds meet a window of the anchor that can still change its result is the
score worked out.  The windows are: above the k-th best score of the same label for positives, and between
the k-th best negative so far and the positive's upper limit for negatives.

Scores are whole numbers, so that limits and ties are exact: components are floor(scale * x).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from casemill.llm.shared import discard, keyed, stage

#: Anchors of a block, at most, and bytes of their vectors.
BLOCK, BLOCK_BYTES = 2048, 16 << 20
#: Rows that are looked at together in a task, and rows whose scores give the first thresholds.
ROWS, SEEDS = 1024, 4096
_NONE = np.int64(-(1 << 62))
_EXACT = float(1 << 52)


def spanning_tree(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """(parent of each point, distance to it, points by depth) of the minimum spanning tree of the rows of x, from row 0."""
    n = len(x)
    norm = (x * x).sum(1)
    parent, near = np.zeros(n, np.int64), np.full(n, np.inf)
    out, depth, now = np.ones(n, bool), np.zeros(n, np.int64), 0
    for _ in range(n - 1):
        out[now] = False
        d = np.maximum(norm + norm[now] - 2 * (x @ x[now]), 0)
        closer = out & (d < near)
        near[closer], parent[closer] = d[closer], now
        now = int(np.argmin(np.where(out, near, np.inf)))
        depth[now] = depth[parent[now]] + 1
    parent[0] = 0
    edge = np.sqrt(((x - x[parent]) ** 2).sum(1))
    return parent, edge, [np.flatnonzero(depth == k) for k in range(int(depth.max(initial=0)) + 1)]


def dots(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """All inner products of whole vectors, exactly."""
    most = np.sqrt((x * x).sum(1).max(initial=0)) * np.sqrt((y * y).sum(1).max(initial=0))
    if most < _EXACT:
        return np.rint(x @ y.T).astype(np.int64)
    if most < float(1 << 62):
        return x.astype(np.int64) @ y.T.astype(np.int64)
    raise OverflowError("scores do not fit in 64 bits")


class Anchors:
    """A block of anchors with its tree, and per anchor a set of windows [lo, hi] of scores that count."""

    def __init__(self, rows: np.ndarray, labels: np.ndarray, vectors: np.ndarray):
        self.rows, self.labels, self.vectors = rows, labels, vectors
        self.parent, self.edge, self.levels = spanning_tree(vectors)
        # doubles add up with errors; the bounds are wider by more than these
        self.slack = 1e-9 * (1 + np.sqrt((vectors * vectors).sum(1)))

    def __len__(self) -> int:
        return len(self.rows)

    def scores(self, x: np.ndarray, wanted, met) -> int:
        """Calls met(anchors, rows of x, scores) for every pair that counts; returns how many scores were worked out.

        wanted(anchors, low bounds, high bounds) says which pairs may count; bounds are rows of x by anchors.
        """
        norm = np.sqrt((x * x).sum(1))
        low, high = np.empty((len(x), len(self))), np.empty((len(x), len(self)))
        done = 0
        for depth, level in enumerate(self.levels):
            if depth:
                reach = norm[:, None] * self.edge[level]
                up = self.parent[level]
                low[:, level], high[:, level] = low[:, up] - reach, high[:, up] + reach
                room = (norm[:, None] + 1) * self.slack[level]
                need = wanted(level, low[:, level] - room, high[:, level] + room)
            else:
                need = np.ones((len(x), len(level)), bool)
            if not need.any():
                continue
            some, those = np.flatnonzero(need.any(1)), np.flatnonzero(need.any(0))
            part = need[np.ix_(some, those)]
            r, c = np.nonzero(part)
            if 8 * len(r) >= part.size:
                value = dots(x[some], self.vectors[level[those]])[r, c]
            else:
                value = _pairs(x[some[r]] if len(r) < 1 << 16 else x, self.vectors, np.arange(len(r)) if len(r) < 1 << 16 else some[r], level[those[c]])
            r, c = some[r], level[those[c]]
            low[r, c] = high[r, c] = value
            done += len(r)
            met(c, r, value)
        return done


def _pairs(x: np.ndarray, y: np.ndarray, r: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Inner products of some pairs, by parts that stay small."""
    most = np.sqrt((x * x).sum(1).max(initial=0)) * np.sqrt((y * y).sum(1).max(initial=0))
    if most >= float(1 << 62):
        raise OverflowError("scores do not fit in 64 bits")
    kind = float if most < _EXACT else np.int64
    out = np.empty(len(r), np.int64)
    for k in range(0, len(r), 1 << 15):
        a, b = x[r[k : k + (1 << 15)]].astype(kind), y[c[k : k + (1 << 15)]].astype(kind)
        out[k : k + (1 << 15)] = np.rint(np.einsum("ij,ij->i", a, b))
    return out


class Best:
    """For each slot the k best (score, id, row) so far that lie in the slot's limits: score first, then the smaller id, null ids last."""

    def __init__(self, lo: np.ndarray, hi: np.ndarray, k: int):
        self.lo, self.hi, self.k = lo.copy(), hi, k
        self.have: tuple[np.ndarray, ...] = tuple(np.zeros(0, np.int64) for _ in range(3))

    def add(self, slot: np.ndarray, score: np.ndarray, tie: np.ndarray) -> None:
        """Keeps what is among the best, and raises lo to the k-th score of slots that have k."""
        ok = (score >= self.lo[slot]) & (score <= self.hi[slot])
        slot, score, tie = (np.concatenate([a, b[ok]]) for a, b in zip(self.have, (slot, score, tie)))
        order = np.lexsort((tie, -score, slot))
        slot, score, tie = slot[order], score[order], tie[order]
        place = np.arange(len(slot)) - np.searchsorted(slot, slot)
        keep = place < self.k
        last = place == self.k - 1
        self.lo[slot[last]] = np.maximum(self.lo[slot[last]], score[last])
        self.have = slot[keep], score[keep], tie[keep]


def _batch(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(rows, labels, vectors) of some rows at a time."""
    for k in range(0, batch.num_rows, ROWS):
        part = batch.slice(k, ROWS)
        col = part.column("vector")
        yield part.column("row").to_numpy(), part.column("label").to_numpy(), col.flatten().to_numpy().reshape(len(col), -1)


def _positives(anchors, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, seed = anchors.value
        best = Best(seed, np.full(len(block), 1 << 62), k)
        for batch in batches:
            for row, label, x in _batch(batch):

                def wanted(level, low, high, label=label, best=best):
                    return (label[:, None] == block.labels[level]) & (high >= best.lo[level])

                def met(a, r, score, row=row, label=label, best=best):
                    ok = (label[r] == block.labels[a]) & (row[r] != block.rows[a])
                    best.add(a[ok], score[ok], row[r[ok]])

                block.scores(x, wanted, met)
        slot, score, row = best.have
        yield pa.RecordBatch.from_arrays([pa.array(block.rows[slot]), pa.array(row), pa.array(score)], ["anchor", "row", "score"])

    return run


def _negatives(anchors, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, seed, hi, owner, first = anchors.value
        best = Best(seed, hi, k)
        count = np.diff(first)
        most = int(count.max(initial=0))
        for batch in batches:
            for row, label, x in _batch(batch):

                def wanted(level, low, high, label=label, best=best):
                    out = np.zeros(low.shape, bool)
                    for j in range(most):
                        slot = np.minimum(first[level] + j, len(owner) - 1)
                        out |= (high >= best.lo[slot]) & (low <= best.hi[slot]) & (j < count[level])
                    return out & (label[:, None] != block.labels[level])

                def met(a, r, score, row=row, label=label, best=best):
                    ok = label[r] != block.labels[a]
                    a, r, score = a[ok], r[ok], score[ok]
                    slots, at = [], []
                    for j in range(most):
                        slot = np.minimum(first[a] + j, len(owner) - 1)
                        hit = np.flatnonzero((j < count[a]) & (score >= best.lo[slot]) & (score <= best.hi[slot]))
                        slots.append(slot[hit])
                        at.append(hit)
                    if slots:
                        at = np.concatenate(at)
                        best.add(np.concatenate(slots), score[at], row[r[at]])

                block.scores(x, wanted, met)
        slot, score, row = best.have
        # a row may be among the best of several windows of its anchor
        pair = np.unique(np.stack([owner[slot], row, score]), axis=1) if len(slot) else np.zeros((3, 0), np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(block.rows[pair[0]]), pa.array(pair[1]), pa.array(pair[2])], ["anchor", "row", "score"])

    return run


def _blocks(dealt: DataFrame, size: int) -> Iterator[DataFrame]:
    """Blocks of `size` rows of a staged table whose column `at` numbers them inside partitions."""
    held, room = F.lit(False), size
    for part, n in sorted(tuple(r) for r in dealt.groupBy(F.shiftright("at", 33).alias("part")).count().collect()):
        at = 0
        while at < n:
            take = min(room, n - at)
            held, room, at = held | F.col("at").between((part << 33) + at, (part << 33) + at + take - 1), room - take, at + take
            if not room:
                yield dealt.where(held)
                held, room = F.lit(False), size
    if room < size:
        yield dealt.where(held)


def _arrays(rows: DataFrame, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row numbers, labels, vectors) of a bounded table."""
    t = rows.select("row", "label", "vector").toArrow().combine_chunks()
    return t.column("row").to_numpy(), t.column("label").to_numpy(), t.column("vector").combine_chunks().flatten().to_numpy().reshape(-1, width) if len(t) else np.zeros((0, width))


def _kth(score: np.ndarray, k: int) -> np.ndarray:
    """The k-th greatest of each row, a lower limit of the k-th greatest of more of them; _NONE where there are fewer."""
    return np.sort(score, axis=1)[:, -k] if score.shape[1] >= k else np.full(len(score), _NONE)


def _ranked(found: DataFrame, by: list[str], k: int) -> DataFrame:
    return found.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("score"), "row"))).where(F.col("rank") <= k)


def _mine_block(same: DataFrame, block: Anchors, seed: tuple[np.ndarray, np.ndarray, np.ndarray], positives: int, negatives: int, low: int, high: int) -> DataFrame:
    """(anchor, positive, positive_score, rank, row, score) of a block of anchors, staged."""
    sc, layout = same.sparkSession.sparkContext, "anchor long, row long, score long"
    row, label, x = seed
    known, like = dots(block.vectors, x), block.labels[:, None] == label
    sent = sc.broadcast((block, _kth(np.where(like & (block.rows[:, None] != row), known, _NONE), positives)))
    near = stage(_ranked(same.mapInArrow(_positives(sent, positives), layout), ["anchor"], positives).select("anchor", "row", "score"), "positives")
    sent.destroy()
    # `positives` rows for an anchor of the block
    told = near.toArrow()
    place = {r: k for k, r in enumerate(block.rows.tolist())}
    owner = np.array([place[a] for a in told.column("anchor").to_pylist()], np.int64)
    score = told.column("score").to_numpy()
    lo, hi = -(-low * score // 100), high * score // 100
    keep = np.flatnonzero(lo <= hi)
    keep = keep[np.argsort(owner[keep], kind="stable")]
    owner, lo, hi = owner[keep], lo[keep], hi[keep]
    first = np.searchsorted(owner, np.arange(len(block) + 1))
    for k, o in enumerate(owner):
        inside = ~like[o] & (known[o] >= lo[k]) & (known[o] <= hi[k])
        lo[k] = max(lo[k], _kth(np.where(inside, known[o], _NONE)[None], negatives)[0])
    sent = sc.broadcast((block, lo, hi, owner, first))
    far = same.mapInArrow(_negatives(sent, negatives), layout)
    limits = near.withColumnsRenamed({"row": "positive", "score": "positive_score"})
    inside = (100 * F.col("score") >= low * F.col("positive_score")) & (100 * F.col("score") <= high * F.col("positive_score"))
    out = stage(_ranked(far.join(limits, "anchor").where(inside), ["anchor", "positive"], negatives), "negatives", near)
    sent.destroy()
    return out


def mine_negatives(vectors: DataFrame, is_anchor: str, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", scale: int = 256, positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90, block: int = BLOCK) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score), a row for each negative found.

    A row's score at an anchor is the inner product of their components floor(scale * x).  The positives of
    an anchor are the `positives` best other rows of its label; for each, the negatives are the first
    `negatives` rows of other labels with low * positive score <= 100 * score <= high * positive score.
    Higher scores come first, ties by smaller id, null last.  The result is exact.

    Rows whose label or vector is null, whose vector is empty or has null or non-finite components take no
    part; vectors meet those of their own width.  Repeated rows are rows of their own, as anchors too.
    is_anchor is a condition on id, vector and label columns.  Scores of 2**62 or more are an error.  Extra
    columns are ignored.  An empty table, and one without anchors, gives an empty table.
    """
    spark, v = vectors.sparkSession, F.col(vector_col).cast("array<double>")
    kind = {c: t for c, t in vectors.dtypes}
    good = F.col(label_col).isNotNull() & F.col(vector_col).isNotNull() & (F.size(v) > 0) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    label = F.col(label_col).cast("long") if kind[label_col] in ("tinyint", "smallint", "int", "bigint") else F.xxhash64(F.col(label_col).cast("string"))
    own = vectors.select(F.col(id_col).alias("id"), label.alias("label"), v.alias("vector"), F.coalesce(F.expr(is_anchor), F.lit(False)).alias("anchor"), good.alias("good")).where("good").drop("good")
    # numbers in the order of the ids, so that ties go by them
    numbered = keyed(own, "id", "row")
    by_id = not hasattr(numbered, "staged_at")
    rows = stage(numbered.withColumn("vector", F.transform("vector", lambda x: F.floor(F.lit(float(scale)) * x).cast("double"))).withColumn("width", F.size("vector")), "rows", numbered)
    answers = []
    for (width,) in sorted(tuple(r) for r in rows.where("anchor").select("width").distinct().collect()):
        same = rows.where(F.col("width") == width).select("row", "label", "vector")
        room = max(1, BLOCK_BYTES // (8 * width))
        seed = _arrays(same.orderBy(F.xxhash64("row")).limit(min(SEEDS, room)), width)
        dealt = rows.where(F.col("anchor") & (F.col("width") == width)).repartitionByRange("label", "row").sortWithinPartitions("label", "row")
        dealt = stage(dealt.select("row", "label", "vector").withColumn("at", F.monotonically_increasing_id()), "anchors")
        for part in _blocks(dealt, min(block, room)):
            answers.append(_mine_block(same, Anchors(*_arrays(part, width)), seed, positives, negatives, low, high))
        discard(dealt)
    layout = f"anchor_id {kind[id_col]}, positive_id {kind[id_col]}, rank int, negative_id {kind[id_col]}, positive_score long, negative_score long"
    if not answers:
        return spark.createDataFrame([], layout)
    # one reading of all blocks' files
    out = spark.read.schema(answers[0].schema).parquet(*(a.staged_at for a in answers))
    names = {"anchor": "anchor_id", "positive": "positive_id", "row": "negative_id"}
    for number, name in names.items():
        if by_id:
            out = out.withColumn(name, F.col(number).cast(kind[id_col]))
        else:
            out = out.join(rows.select(F.col("row").alias("number"), F.col("id").alias(name)), F.col(number) == F.col("number")).drop("number")
    return out.select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), "negative_id", "positive_score", F.col("score").alias("negative_score"))


def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding", "label")
    own = own.withColumn("label", F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")))
    return mine_negatives(own, "vec_id % 100 = 0")


OP12_SQL = """
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS x
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT a.vec_id AS anchor_id, b.vec_id AS other_id, a.label = b.label AS mate, list_inner_product(a.x, b.x)::BIGINT AS score
  FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.x) = len(b.x) WHERE a.vec_id % 100 = 0
), positives AS (
  SELECT anchor_id, other_id AS positive_id, score AS positive_score FROM scored WHERE mate
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other_id) <= 5
)
SELECT p.anchor_id, p.positive_id, (row_number() OVER (PARTITION BY p.anchor_id, p.positive_id ORDER BY s.score DESC, s.other_id))::INTEGER AS rank,
  s.other_id AS negative_id, p.positive_score, s.score AS negative_score
FROM positives p JOIN scored s ON s.anchor_id = p.anchor_id AND NOT s.mate AND 30 * p.positive_score <= 100 * s.score AND 100 * s.score <= 90 * p.positive_score
QUALIFY row_number() OVER (PARTITION BY p.anchor_id, p.positive_id ORDER BY s.score DESC, s.other_id) <= 10
"""
