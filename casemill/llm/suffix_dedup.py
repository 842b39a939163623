"""Suffix-array dedup: repeated byte strings by a distributed difference-cover sort.

Suffixes are compared to the depth that counts, `length` bytes.  The difference cover D modulo v holds
few residues, yet for any two positions i, j there is a shift d < v that brings both into the sample
(position modulo v in D).  So two equal strings of `length` bytes hold two equal sampled strings of
length - v + 1 bytes at the same shift.

1. Sample: positions of each document whose residue is in D; the string of length - v + 1 bytes from
   there (what sampled triples are to v = 3) is hashed and sorted into buckets.
2. Names: equal neighbours of a bucket share a name.  A name met once cannot lie in a repeat and goes;
   the recursion ends here, since a name already spans what a repeat of `length` bytes must share.
   The names that stay are kept as a filter with a checked size, or, beyond it, as positions.
3. Remaining suffixes: those that reach a kept name within v bytes.  They are sorted by their first
   `length` bytes (as a hash), whole blocks to a bucket: first as stretches between cuts that the text
   itself sets, each stretch one hash, then those one by one that no repeated stretch holds.
4. Neighbours that agree on that prefix mark each other; runs of marked positions are maximal repeats.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from casemill.llm.arrays import Slice, U, byte_hashes, covered, runs, sampled_hashes, slices, span_hash
from casemill.llm.repeats import all_runs, broadcast_filter, distinct_texts, expanded, filter_rows, hinted, repeated_places, told_runs
from casemill.llm.shared import BROADCAST_BYTES, small_or_join, stage

#: A cut falls on one remaining suffix in so many, by its hash.
STRETCH = 32


@cache
def difference_cover(q: int) -> tuple[int, np.ndarray]:
    """(v, D): for a prime q, q + 1 residues modulo v = q*q + q + 1 whose differences give every residue.

    The zeros of a linear recurrence of order 3 over the integers modulo q, for the first coefficients
    whose zeros have that property.
    """
    v = q * q + q + 1
    for c0 in range(1, q):
        for c1 in range(q):
            for c2 in range(q):
                x, zeros = [0, 0, 1], []
                for i in range(v):
                    if x[0] == 0:
                        zeros.append(i)
                    x = [x[1], x[2], (c0 * x[0] + c1 * x[1] + c2 * x[2]) % q]
                if len(zeros) == q + 1 and len({(a - b) % v for a in zeros for b in zeros}) == v:
                    return v, np.array(zeros)
    raise ValueError(f"no cover for {q}")


def cover_for(length: int) -> tuple[int, np.ndarray]:
    """The cover with the fewest samples whose strings stay at least a third of the length."""
    for q in (23, 19, 17, 13, 11, 7, 5, 3, 2):
        if length - (q * q + q) >= max(1, length // 3):
            return difference_cover(q)
    return 1, np.zeros(1, np.int64)


def _sampled(s: Slice, length: int, v: int, cover: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, place in the slice) of every sampled position with a whole string in a long enough document."""
    size = np.diff(s.off)
    count = np.where(size >= length, np.maximum(size - (length - v), 0), 0)  # starts of strings of length - v + 1
    doc = np.repeat(np.arange(len(size)), -(-count // v))
    turn = np.arange(len(doc)) - np.repeat(np.cumsum(-(-count // v)) - -(-count // v), -(-count // v))
    pos = (turn * v)[:, None] + cover[None, :]
    doc = np.repeat(doc, len(cover)).reshape(pos.shape)
    keep = pos < count[doc]
    return doc[keep], pos[keep], s.off[doc[keep]] + pos[keep]


def repeated_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 200, limit: int = BROADCAST_BYTES) -> DataFrame:
    """(key, starts, ends): for each distinct text, the runs of bytes covered by a string of `length` bytes that starts elsewhere too.

    key is the text's MD5.  A text that several rows share is one run.  Texts without repeats have no
    row.  Null texts are empty and repeat nothing.
    """
    v, cover = cover_for(length)
    short = length - v + 1
    texts, copied = distinct_texts(docs, id_col, text_col)
    texts = texts.where(F.octet_length("text") >= length)

    def sample(s: Slice, _: object) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        doc, pos, at = _sampled(s, length, v, cover)
        return doc, pos, sampled_hashes(s.data, at, short)

    def windows(s: Slice, doc: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Every position from which a string of `length` bytes reaches a named sample at most v - 1 bytes on."""
        lo, hi = s.off[doc], s.off[doc + 1] - length
        flag = covered(len(s.data), np.maximum(at - (v - 1), lo), np.maximum(np.minimum(at, hi) + 1, np.maximum(at - (v - 1), lo)))
        at = np.flatnonzero(flag)
        doc = np.searchsorted(s.off, at, "right") - 1
        keep = at + length <= s.off[doc + 1]
        doc, at = doc[keep], at[keep]
        # hash only the bytes that the windows hold
        held = covered(len(s.data), at, at + length)
        place = np.cumsum(held) - 1
        return doc, at - s.off[doc], byte_hashes(s.data[held], length)[place[at]] if len(at) else np.zeros(0, U)

    names = broadcast_filter(filter_rows(texts, sample, 2), limit)
    if names is None:
        texts = hinted(texts, stage(repeated_places(texts, sample), "names"), "name", "inner", limit)

    def remaining(s: Slice, hint: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        if names is None:
            doc, lo, hi = told_runs(hint, "name")
            which, pos = expanded(lo, hi)
            return windows(s, doc[which], s.off[doc[which]] + pos)
        doc, _, at = _sampled(s, length, v, cover)
        hit = names.value.has(sampled_hashes(s.data, at, short))
        return windows(s, doc[hit], at[hit])

    def stretches(s: Slice, hint: dict) -> tuple[np.ndarray, ...]:
        """Runs of remaining suffixes from one cut to the next, told by one hash; cuts depend on the bytes that follow alone, so equal runs are cut alike."""
        doc, pos, h = remaining(s, hint)
        cut = np.flatnonzero(h % U(STRETCH) == 0)
        a, b = cut[:-1], cut[1:]
        keep = (doc[a] == doc[b]) & (pos[b] - pos[a] == b - a)
        a, b = a[keep], b[keep]
        return doc[a], pos[a], span_hash(h, a, b + 1), b - a + 1

    def others(s: Slice, hint: dict) -> tuple[np.ndarray, ...]:
        """Remaining suffixes outside repeated stretches; those in one of each group of equal stretches go along for them to meet."""
        doc, pos, h = remaining(s, hint)
        inside = [np.zeros(len(doc), bool), np.zeros(len(doc), bool)]
        for k, name in enumerate(("known", "known_first")):
            d, lo, hi = told_runs(hint, name)
            if len(d) and len(doc):
                inside[k] = covered(len(s.data), s.off[d] + lo, s.off[d] + hi)[s.off[doc] + pos]
        send = ~inside[0] | inside[1]
        return doc[send], pos[send], h[send], np.ones(send.sum(), np.int64), ~inside[0][send]

    long = stage(repeated_places(texts, stretches, firsts=True), "stretches")
    rest = repeated_places(hinted(texts, long, "known", "left", limit), others)
    return all_runs([long, rest], copied, length - 1)


def dedup_bytes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 200, limit: int = BROADCAST_BYTES, with_kept: bool = True) -> DataFrame:
    """One row per row of docs: id, n_bytes, kept (binary: the bytes that stay), n_removed, n_spans, spans (starts and ends of removed runs).
    with_kept=False leaves `kept` null where only the digests are wanted.

    A byte goes if a string of `length` bytes that covers it also starts elsewhere in the corpus; so
    all copies go, the first one too.  Null text counts as empty; empty and short texts stay as they
    are unless nothing remains to compare.  Repeated rows and rows with equal or null ids are documents
    of their own.  Other columns are ignored.  An empty table gives an empty table.
    """
    found = repeated_runs(docs, id_col, text_col, length, limit)
    text = F.coalesce(F.col(text_col), F.lit(""))
    own = docs.select(F.col(id_col).alias("id"), text.alias("text"), F.unhex(F.md5(text)).alias("key"))
    size = found.agg(F.sum(F.lit(64) + 8 * F.coalesce(F.size("starts"), F.lit(0)))).first()[0] or 0
    own = small_or_join(own, found.withColumn("hit", F.lit(True)), "key", "left", 1, size, limit)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hit, starts, ends = batch.column("hit"), batch.column("starts"), batch.column("ends")
            for s in slices(batch.column("text")):
                n, kept, a, b = [], [], [], []
                for i in range(s.row0, s.row1):
                    data = s.data[s.off[i - s.row0] : s.off[i - s.row0 + 1]]
                    n.append(len(data))
                    lo, hi = np.zeros(0, np.int64), np.zeros(0, np.int64)
                    if hit[i].as_py() and len(data) >= length:
                        if starts[i].is_valid:
                            lo, hi = runs(covered(len(data), np.array(starts[i].as_py()), np.array(ends[i].as_py())))
                        else:
                            lo, hi = np.array([0]), np.array([len(data)])
                    flag = np.ones(len(data), bool)
                    for x, y in zip(lo, hi):
                        flag[x:y] = False
                    kept.append(data[flag].tobytes() if len(lo) else data.tobytes())
                    a.append(lo)
                    b.append(hi)
                yield pa.RecordBatch.from_arrays([batch.column("id").slice(s.row0, s.row1 - s.row0), pa.array(n, pa.int64()), pa.array([sum(y - x) for x, y in zip(a, b)], pa.int64()), pa.array([sha256(k).hexdigest() for k in kept]), pa.array(kept if with_kept else [None] * len(kept), pa.binary()), pa.array(a, pa.list_(pa.int32())), pa.array(b, pa.list_(pa.int32()))], ["id", "n_bytes", "n_removed", "kept_sha256", "kept", "starts", "ends"])

    kind = dict(docs.dtypes)[id_col]
    out = own.mapInArrow(cut, f"id {kind}, n_bytes long, n_removed long, kept_sha256 string, kept binary, starts array<int>, ends array<int>")
    return out.select(F.col("id").alias(id_col), "n_bytes", "n_removed", F.size("starts").cast("long").alias("n_spans"), "kept_sha256", "kept", "starts", "ends")


def op6(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return dedup_bytes(docs, with_kept=False).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
