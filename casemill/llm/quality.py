"""Quality classifier by positive-unlabelled learning.

Trusted positives and unlabelled web text train a logistic model on counts of the text itself.  The
risk is the non-negative unbiased one: prior * R+(P) + max(0, R-(U) - prior * R-(P)), with the logistic
loss; where the bracket falls below zero the step goes the other way.  The prior is estimated from
positives and unlabelled rows alone: in any set of texts their shares bound it, U(A) >= prior * P(A), and
the sets that a first classifier scores highest come nearest.  Rows labelled bad serve nowhere.

Training takes a bounded sample by hash of the ids (`sample_rows` positives and as many unlabelled);
features are computed by Spark tasks, for the sample and for every row alike.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from casemill.llm.arrays import Slice, slices, tokens
from casemill.llm.shared import small_or_join, stage

_CLASSES = ["ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz", "0123456789", " ", "\n", ".,;:'\"()-", "!?", "|<>{}[]\\/=+*_~^`", "#$%&@"]
_CLASS = np.full(256, len(_CLASSES), np.uint8)
for _k, _chars in enumerate(_CLASSES):
    _CLASS[list(_chars.encode())] = _k
_CLASS[128:] = 1  # bytes of letters outside ASCII count with the small letters


def text_features(s: Slice) -> np.ndarray:
    """Features of each document of a slice; all are finite, empty texts included."""
    n = len(s.off) - 1
    size = np.diff(s.off)
    safe = np.maximum(size, 1)
    out = [np.diff(np.concatenate([[0], np.cumsum(_CLASS[s.data] == k)])[s.off]) / safe for k in range(len(_CLASSES) + 1)]
    t = tokens(s, True)
    h = t.hashes()
    words = np.diff(t.first)
    some = np.maximum(words, 1)
    total = lambda x: np.diff(np.concatenate([[0], np.cumsum(x)])[t.first])
    width = t.end - t.start
    same = np.zeros(len(h), bool)
    same[1:] = (h[1:] == h[:-1]) & (t.doc[1:] == t.doc[:-1])
    last = s.data[t.end - 1] if len(h) else s.data[:0]
    odd = np.isin(_CLASS[last], (6, 7, 8))
    caps = np.isin(_CLASS[s.data[t.start]] if len(h) else s.data[:0], (0,))
    distinct, most = np.zeros(n), np.zeros(n)
    for d in range(n):
        own = np.sort(h[t.first[d] : t.first[d + 1]])
        if len(own):
            cut = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1], [True]]))
            distinct[d], most[d] = len(cut) - 1, np.diff(cut).max()
    lines = np.diff(np.concatenate([[0], np.cumsum(s.data == 10)])[s.off]) + 1
    out += [np.log1p(words), np.log1p(lines), total(width) / some, total(width * width) / some / 100, total(same) / some, total(odd) / some, total(caps) / some, distinct / some, (1 - distinct / some) / np.log2(2 + words), most / some, words / lines / 50]
    x = np.stack(out, 1).astype(np.float64)
    return np.concatenate([x, np.sqrt(np.abs(x)), np.minimum(x * x, 1e4)], 1)


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


@dataclass
class Model:
    mean: np.ndarray
    scale: np.ndarray
    weight: np.ndarray
    bias: float

    def score(self, x: np.ndarray) -> np.ndarray:
        return _sigmoid(np.clip((x - self.mean) / self.scale, -8, 8) @ self.weight + self.bias)


def pu_risk(w: np.ndarray, p: np.ndarray, u: np.ndarray, prior: float) -> tuple[float, float, np.ndarray, np.ndarray]:
    """(prior * R+(P), R-(U) - prior * R-(P), the gradient of each) for logistic loss; the risk is the first and what is positive of the second."""
    zp, zu = p @ w, u @ w
    up = prior * np.logaddexp(0, -zp).mean()
    down = np.logaddexp(0, zu).mean() - prior * np.logaddexp(0, zp).mean()
    return up, down, -prior * (p.T @ (1 - _sigmoid(zp))) / len(p), u.T @ _sigmoid(zu) / len(u) - prior * (p.T @ _sigmoid(zp)) / len(p)


def fit_pu(positive: np.ndarray, unlabelled: np.ndarray, prior: float, steps: int = 1500, rate: float = 0.03, penalty: float = 1e-4) -> Model:
    """Minimises the non-negative PU risk by Adam over whole batches, from zero weights: no randomness."""
    both = np.concatenate([positive, unlabelled])
    mean, scale = both.mean(0), both.std(0)
    scale[scale < 1e-9] = 1.0
    p, u = (np.clip((x - mean) / scale, -8, 8) for x in (positive, unlabelled))
    w = np.zeros(p.shape[1] + 1)
    m, v = np.zeros_like(w), np.zeros_like(w)
    p, u = (np.concatenate([x, np.ones((len(x), 1))], 1) for x in (p, u))
    for i in range(1, steps + 1):
        _, down, g_up, g_down = pu_risk(w, p, u, prior)
        g = g_up + g_down if down >= 0 else -g_down
        g = g + penalty * np.append(w[:-1], 0)
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w = w - rate * (m / (1 - 0.9**i)) / (np.sqrt(v / (1 - 0.999**i)) + 1e-8)
    return Model(mean, scale, w[:-1], float(w[-1]))


def class_prior(positive: np.ndarray, unlabelled: np.ndarray, sure: float = 0.1) -> float:
    """The share of positives among the unlabelled: the least U(A) / P(A) over the sets A above a score, each ratio taken with its margin of error.

    The scores are of a classifier of positives against unlabelled, fitted on every other row; the other
    rows are counted.  Between 0.02 and 0.98.
    """
    if min(len(positive), len(unlabelled)) < 4:
        return 0.5
    first = fit_pu(positive[::2], unlabelled[::2], 0.5, steps=300)
    p, u = np.sort(first.score(positive[1::2])), np.sort(first.score(unlabelled[1::2]))
    at = p  # every set ends at a positive
    in_p, in_u = 1 - np.searchsorted(p, at) / len(p), 1 - np.searchsorted(u, at) / len(u)
    margin = (np.sqrt(np.log(4 / sure) / 2 / len(p)) + np.sqrt(np.log(4 / sure) / 2 / len(u))) / in_p
    best = int(np.argmin(in_u / in_p + margin))
    return float(np.clip(in_u[best] / in_p[best], 0.02, 0.98))


def _featured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for s in slices(batch.column("text")):
            x = text_features(s)
            yield pa.RecordBatch.from_arrays([batch.column("trusted").slice(s.row0, s.row1 - s.row0), pa.array(list(x), pa.list_(pa.float64()))], ["trusted", "x"])


def fit_quality(docs: DataFrame, labels: DataFrame, folds: int = 3, held: int = 1, sample_rows: int = 12_000, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> Model | None:
    """A model from labels outside the held-out fold (crc32 of the id as text, modulo folds, is `held`); None if no positive or no other text is left.

    At most about sample_rows positives and as many unlabelled texts are used, taken by hash of the id.
    """
    fold = F.crc32(F.col(id_col).cast("string")) % folds != held
    known = stage(labels.where(F.col(id_col).isNotNull() & fold & F.col(label_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg(F.max(label_col).alias("y")), "labels")
    good = known.where("y = 1").count()
    if not good:
        return None
    slot = F.pmod(F.xxhash64("id", F.lit("fit")), F.lit(1 << 30)) / float(1 << 30)
    text = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    n_docs = docs.count()
    positives = known.where((F.col("y") == 1) & (slot < min(1.0, sample_rows / good))).select("id", F.lit(True).alias("trusted"))
    # the unlabelled side is the web as it is: any row of it, labelled or not, held-out labels unseen
    plain = text.where(slot < min(1.0, sample_rows / max(n_docs, 1))).select(F.lit(False).alias("trusted"), "text")
    trusted = small_or_join(text, positives, "id", "inner", 16, 2 * sample_rows).select("trusted", "text")
    rows = plain.unionByName(trusted).mapInArrow(_featured, "trusted boolean, x array<double>").toPandas()
    if not len(rows):
        return None
    x = np.stack(rows["x"].to_numpy())
    flag = rows["trusted"].to_numpy(bool)
    if not flag.any() or flag.all():
        return None
    order = np.lexsort(x.T[::-1])  # the order of rows in a collected result may vary
    x, flag = x[order], flag[order]
    return fit_pu(x[flag], x[~flag], class_prior(x[flag], x[~flag]))


def score_quality(docs: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """docs' `keep` columns (the id by default) with score (0 to 1) for every row; without a model every score is 0.5.

    Null texts are empty; empty and very long texts are scored like all others.
    """
    keep = keep or [id_col]

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = [model.score(text_features(s)) if model else np.full(s.row1 - s.row0, 0.5) for s in slices(batch.column("__text"))]
            score = np.concatenate(parts) if parts else np.zeros(0)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(score, pa.float64())], [*batch.schema.names[:-1], "score"])

    kinds = dict(docs.dtypes)
    layout = ", ".join(f"`{c}` {kinds[c]}" for c in keep)
    return docs.select(*keep, F.col(text_col).alias("__text")).mapInArrow(scored, f"{layout}, score double")


def op8(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    model = fit_quality(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    scored = score_quality(docs, model)
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, F.lit(False))
    return scored.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
