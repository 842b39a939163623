"""Periodic runs of words by branching tandem repeats of an enhanced suffix array.

A task takes some MB of whole documents at a time and sorts the suffixes of all of them together, by words,
each document's apart, with their longest common prefixes (LCP) and the inverse array (ISA).  Every LCP
interval is taken as a chain of splits in two; the suffixes i of the smaller side of a split at depth d are
held against the other side by their ISA alone: if ISA[i + d] or ISA[i - d] lies there, a square of period d
begins at i or i - d, and the word behind it breaks the period.  Such a square is rotated to the left as far
as the period holds, which makes it a run; runs of the same words are merged into the one with the smallest
period.  There are no tree nodes, and nothing is sent between machines.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from casemill.llm.arrays import Tokens, covered, slices, tokens
from casemill.llm.shared import WORD

_BLOCK, _UNKNOWN = 64, np.iinfo(np.int32).max
#: Suffixes that are held against the other side of their split at once.
_CHUNK = 1 << 20


class Minima:
    """Least values of ranges of x, and nearest smaller ones, from a table over the minima of its blocks."""

    def __init__(self, x: np.ndarray):
        self.x = np.full((len(x) // _BLOCK + 1) * _BLOCK, -1, np.int32)
        self.x[: len(x)] = x
        self.table = [self.x.reshape(-1, _BLOCK).min(1)]
        while (k := 1 << len(self.table) - 1) < len(self.table[-1]):
            self.table.append(np.minimum(self.table[-1][:-k], self.table[-1][k:]))

    def least(self, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        """The least of x[lo:hi], which is not empty, of each range."""
        return np.concatenate([np.zeros(0, np.int32), *(self._least(lo[k : k + (1 << 14)], hi[k : k + (1 << 14)]) for k in range(0, len(lo), 1 << 14))])

    def _least(self, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        first, last, step = lo // _BLOCK, (hi - 1) // _BLOCK, np.arange(_BLOCK)
        at = np.minimum(lo[:, None] + step, np.minimum(hi, (first + 1) * _BLOCK)[:, None] - 1)
        out = self.x[at].min(1)
        far = np.flatnonzero(last > first)
        at = np.maximum(hi[far, None] - 1 - step, last[far, None] * _BLOCK)
        out[far] = np.minimum(out[far], self.x[at].min(1))
        far = far[last[far] > first[far] + 1]
        a, n = first[far] + 1, last[far] - first[far] - 1
        level = np.frexp(n)[1] - 1
        for k in np.unique(level):
            own = level == k
            row = self.table[k]
            out[far[own]] = np.minimum(out[far[own]], np.minimum(row[a[own]], row[a[own] + n[own] - (1 << k)]))
        return out

    def nearest(self, at: np.ndarray, value: np.ndarray, step: int) -> np.ndarray:
        """The nearest place before (step -1) or behind (1) each one whose x is less than its value; there must be one."""
        pos = at.copy()

        def walk(left: np.ndarray, steps: int) -> np.ndarray:
            for _ in range(steps):
                if not len(left):
                    break
                pos[left] += step
                left = left[self.x[pos[left]] >= value[left]]
            return left

        left = walk(np.arange(len(at)), 8)
        # to the edge of the block, then over whole blocks, then into the one that holds a smaller value
        edge = 0 if step < 0 else _BLOCK - 1
        inside = left[pos[left] % _BLOCK != edge]
        rest = [left[pos[left] % _BLOCK == edge]]
        while len(inside):
            inside = walk(inside, 1)
            done = pos[inside] % _BLOCK == edge
            rest.append(inside[done])
            inside = inside[~done]
        left = np.concatenate(rest)
        block = pos[left] // _BLOCK + step
        for k in reversed(range(len(self.table))):
            first = block - (1 << k) + 1 if step < 0 else block
            ok = (first >= 0) & (first < len(self.table[k]))
            ok[ok] = self.table[k][first[ok]] >= value[left[ok]]
            block[ok] += step << k
        pos[left] = block * _BLOCK + (_BLOCK if step < 0 else -1)
        walk(left, _BLOCK)
        return pos


def numbered(t: Tokens) -> np.ndarray:
    """A number for each word, the same for the same bytes."""
    _, first, code = np.unique(t.hashes(), return_index=True, return_inverse=True)
    twin, n = first[code], t.end - t.start
    if (n == n[twin]).all():
        off = np.concatenate([[0], np.cumsum(n)])
        at = np.arange(off[-1])
        if (t.data[at + np.repeat(t.start - off[:-1], n)] == t.data[at + np.repeat(t.start[twin] - off[:-1], n)]).all():
            return code
    known: dict[bytes, int] = {}  # two words with one hash
    return np.array([known.setdefault(t.data[a:b].tobytes(), len(known)) for a, b in zip(t.start, t.end)], np.int64)


def suffix_array(word: np.ndarray, doc: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(suffixes in order, place of each suffix, common prefix with the one before) for the words of documents, one document after another; end[i] is the end of i's document.

    Prefix doubling: only suffixes that others still equal are sorted again, by the places of what follows.
    The common prefix of two neighbours is known when they part: h words, and that of what follows.
    """
    n = len(word)
    key = doc * (int(word.max(initial=0)) + 1) + word
    sa = np.argsort(key, kind="stable")
    first = np.ones(n + 1, bool)
    first[1:n] = np.diff(key[sa]) != 0
    group = np.maximum.accumulate(np.where(first[:n], np.arange(n), 0))
    rank = np.empty(n, np.int64)
    rank[sa] = group
    lcp = np.where(first[:n], 0, _UNKNOWN).astype(np.int32)
    idx, h = np.flatnonzero(~(first[:n] & first[1:])), 1
    while len(idx):
        i = sa[idx]
        follows = np.where(i + h < end[i], rank[np.minimum(i + h, n - 1)] + 1, 0)
        key = group[idx] * (n + 1) + follows
        o = np.argsort(key)
        key, i, follows = key[o], i[o], follows[o]
        sa[idx] = i
        new = np.flatnonzero((np.diff(key) != 0) & ~first[idx[1:]]) + 1
        lcp[idx[new]] = h + _common(word, end, i[new - 1] + h, i[new] + h, follows[new - 1] - 1, follows[new] - 1, h, lcp)
        first[idx[new]] = True
        group[idx] = np.maximum.accumulate(np.where(first[idx], idx, 0))
        rank[i] = group[idx]
        idx = idx[~(first[idx] & first[idx + 1])]
        h *= 2
    return sa, rank, lcp


def _common(word: np.ndarray, end: np.ndarray, a: np.ndarray, b: np.ndarray, rank_a: np.ndarray, rank_b: np.ndarray, h: int, lcp: np.ndarray) -> np.ndarray:
    """Common prefixes, all of less than h words, of the suffixes at a and b in groups that begin at these ranks; a may lie at its document's end, with rank -1."""
    out = np.zeros(len(a), np.int64)
    if h > 8:
        both = np.flatnonzero(rank_a >= 0)
        out[both] = Minima(lcp).least(rank_a[both] + 1, rank_b[both] + 1)
        return out
    left = np.flatnonzero(rank_a >= 0)
    for k in range(h - 1):
        x, y = a[left] + k, b[left] + k
        inside = (x < end[a[left]]) & (y < end[b[left]])
        left, x, y = left[inside], x[inside], y[inside]
        left = left[word[x] == word[y]]
        out[left] = k + 1
    return out


def periodic_runs(word: np.ndarray, doc: np.ndarray, start: np.ndarray, end: np.ndarray, copies: int, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, smallest period) of the maximal runs of `copies` periods or more and `least` words or more, by start and period.  start[i] and end[i] bound the document of word i."""
    n = len(word)
    if not n:
        return (np.zeros(0, np.int64),) * 3
    sa, isa, lcp = suffix_array(word, doc, end)
    low = Minima(lcp)
    room = (end - start)[sa] // copies
    at = np.flatnonzero((lcp >= 1) & (lcp <= room))
    depth = lcp[at].astype(np.int64)
    # the split of an interval at `at`: all before it that share the depth, and the part that begins with it
    left, right = low.nearest(at, depth, -1), low.nearest(at, depth + 1, 1)
    small = at - left <= right - at
    lo, hi = np.where(small, left, at), np.where(small, at, right)
    other_lo, other_hi = np.where(small, at, left), np.where(small, right, at)
    total = np.concatenate([[0], np.cumsum(hi - lo)])
    squares: list[tuple[np.ndarray, np.ndarray]] = []
    k = 0
    while k < len(at):
        m = max(k + 1, int(np.searchsorted(total, total[k] + _CHUNK, "right")) - 1)
        size = hi[k:m] - lo[k:m]
        node = np.repeat(np.arange(k, m), size)
        i = sa[np.arange(len(node)) + np.repeat(lo[k:m] - (total[k:m] - total[k]), size)]
        d = depth[node]
        for partner, begin in ((i + d, i), (i - d, i - d)):
            ok = np.flatnonzero((partner >= start[i]) & (partner < end[i]) & (begin + 2 * d - copies * d >= start[i]))
            place = isa[partner[ok]]
            ok = ok[(place >= other_lo[node[ok]]) & (place < other_hi[node[ok]])]
            squares.append((begin[ok], d[ok]))
        k = m
    if not squares:
        return (np.zeros(0, np.int64),) * 3
    begin, d = (np.concatenate(x) for x in zip(*squares))

    def common(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        x, y = isa[a], isa[b]
        return low.least(np.minimum(x, y) + 1, np.maximum(x, y) + 1)

    stop = begin + 2 * d
    keep = np.flatnonzero(common(stop - copies * d, stop - (copies - 1) * d) >= (copies - 1) * d)
    begin, d, stop = begin[keep], d[keep], stop[keep]
    # rotations to the left: `good` are sure, `bad` are too many
    good, bad = (copies - 2) * d, begin - start[begin] + 1
    while len(open_ := np.flatnonzero(bad - good > 1)):
        mid = (good[open_] + bad[open_]) // 2
        a = begin[open_] - mid
        holds = common(a, a + d[open_]) >= d[open_] + mid
        good[open_] = np.where(holds, mid, good[open_])
        bad[open_] = np.where(holds, bad[open_], mid)
    begin = begin - good
    order = np.lexsort((d, stop, begin))
    begin, stop, d = begin[order], stop[order], d[order]
    whole = np.ones(len(d), bool)
    whole[1:] = (begin[1:] != begin[:-1]) | (stop[1:] != stop[:-1])
    whole &= stop - begin >= np.maximum(least, copies * d)
    begin, stop, d = begin[whole], stop[whole], d[whole]
    order = np.lexsort((d, begin))
    return begin[order], stop[order], d[order]


def joined(t: Tokens, keep: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of each document's kept words, joined by one space."""
    at = np.flatnonzero(keep)
    counts = np.bincount(t.doc[at], minlength=len(t.first) - 1)
    n = t.end[at] - t.start[at]
    last = np.zeros(len(at), bool)
    last[np.cumsum(counts)[counts > 0] - 1] = True
    off = np.concatenate([[0], np.cumsum(n + ~last)])
    out = np.full(off[-1], 32, np.uint8)
    own = np.concatenate([[0], np.cumsum(n)])
    step = np.arange(own[-1])
    out[step + np.repeat(off[:-1] - own[:-1], n)] = t.data[step + np.repeat(t.start[at] - own[:-1], n)]
    return out, off[np.concatenate([[0], np.cumsum(counts)])]


def _runs(copies: int, least: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for s in slices(batch.column("text")):
                t = tokens(s)
                word = numbered(t)
                a, b, q = periodic_runs(word, t.doc, t.first[t.doc], t.first[t.doc + 1], copies, least)
                out, off = joined(t, ~covered(len(word), a + q, b))
                owner = t.doc[a]
                found = pa.StructArray.from_arrays([pa.array(a - t.first[owner]), pa.array(b - a), pa.array(q)], ["start", "length", "period"])
                bounds = np.searchsorted(owner, np.arange(s.row1 - s.row0 + 1))
                text = pa.StringArray.from_buffers(s.row1 - s.row0, pa.py_buffer(off.astype(np.int32)), pa.py_buffer(out))
                ids = batch.column("id").slice(s.row0, s.row1 - s.row0)
                yield pa.RecordBatch.from_arrays([ids, pa.array(np.diff(t.first)), pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), found), text], ["id", "n_words", "runs", "collapsed"])

    return run


def find_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", copies: int = 4, least: int = 6) -> DataFrame:
    """One row per row of docs: id, n_words, runs (start, length, period; by start, then period), collapsed.

    A run is a stretch of words with smallest period q, of `copies` * q words and of `least` words at
    least, that no neighbouring word extends keeping period q.  collapsed has the words that no run holds
    behind its first q, joined by one space.  Words are kept as they are, numbered from 0.

    Null texts are empty: no words, no runs, an empty text.  Repeated rows and null ids are rows of their
    own.  Extra columns are ignored.  An empty table gives an empty table.  A document is one task's, with
    some 150 bytes a word while it is looked at.  copies is 2 at least.
    """
    if copies < 2:
        raise ValueError("a run has two copies at least")
    own = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    layout = f"id {dict(docs.dtypes)[id_col]}, n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string"
    return own.mapInArrow(_runs(copies, least), layout).withColumnRenamed("id", id_col)


def planted(docs: DataFrame) -> DataFrame:
    """(doc_id, text) where the words of each document whose crc32(doc_id) is divisible by 10 repeat from a word on, as the query asks."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    own = docs.select("doc_id", "text", h.alias("h"), F.floor(h / 10).alias("g"))
    own = own.withColumn("w", F.when(F.col("h") % 10 == 0, F.regexp_extract_all("text", F.lit(f"({WORD})"), 1)))
    own = own.withColumn("n", F.when(F.col("w").isNotNull(), F.size("w")).otherwise(0))
    own = own.withColumn("a", F.when(F.col("n") > 0, F.col("g") % F.col("n")).cast("int"))
    own = own.withColumn("p", (1 + F.floor((F.col("n") - F.col("a")) / (3 + F.col("g") % 8))).cast("int"))
    rest = F.col("n") - F.col("a")
    block = F.flatten(F.array_repeat(F.slice("w", F.col("a") + 1, F.col("p")), F.ceil(rest / F.col("p")).cast("int")))
    text = F.array_join(F.concat(F.slice("w", F.lit(1), F.col("a")), F.slice(block, F.lit(1), rest)), " ")
    return own.select("doc_id", F.when(F.col("n") > 0, text).otherwise(F.col("text")).alias("text"))


def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_runs(planted(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")))
    longest = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string")), F.lit("\n")))
    own = found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), longest.alias("longest"), F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))
    length, period = F.col("longest.length"), -F.col("longest.period")
    return own.select("doc_id", "n_runs", (-F.col("longest.start")).alias("start"), length.alias("length"), period.alias("period"), F.floor(1000 * length / period).alias("exponent_milli"), "runs_sha256", "collapsed_sha256")
