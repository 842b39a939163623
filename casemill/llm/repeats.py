"""Finding strings that start at two or more places of a corpus: the exchange under two operators.

A place is a position in a document (a byte or a word) with the hash of the string that starts there.
Places travel packed: a task sorts the hashes of some MB of text, cuts them into buckets by their top
bits, and sends one binary row per bucket.  A bucket's task sorts what all tasks sent it and answers
with the places whose hash came at least twice.  Rows, memory and shuffle grow with the places sent.
A string that one task meets many times is sent once, so a hot string costs a bucket one entry a task.

Documents are known by `key`, a digest of the text.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Callable, Iterator
from hashlib import md5

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from casemill.llm.arrays import Slice, U, by_bucket, mix, pack, slices, unpack
from casemill.llm.shared import BROADCAST_BYTES, buckets_for, stage

#: Places gathered in a task before they are sorted and sent.
FLUSH = 500_000
FILTER_BITS, FILTER_PROBES = 20, 7
Emit = Callable[[Slice, "dict[str, list] | None"], tuple[np.ndarray, ...]]


def _masked(h: np.ndarray) -> np.ndarray:
    return h & U(0xFFFFFFFFFFFF0000)


class Filter:
    """Bloom filter in segments: bucket b's hashes, known by their top 48 bits, are in segment b only."""

    def __init__(self, rows: list[tuple[int, int, bytes]], buckets: int):
        self.buckets = buckets
        self.bits = np.zeros(buckets, np.int64)
        self.base = np.zeros(buckets, np.int64)
        at, parts = 0, []
        for b, n, blob in rows:
            self.bits[b], self.base[b] = n, at
            parts.append(np.frombuffer(blob, np.uint8))
            at += len(blob)
        self.data = np.concatenate(parts) if parts else np.zeros(0, np.uint8)

    def __contains__(self, h: object) -> bool:
        return bool(self.has(np.array([h], U))[0])

    def has(self, h: np.ndarray) -> np.ndarray:
        out = np.zeros(len(h), bool)
        h = _masked(h)
        b = (h >> U(64 - (self.buckets.bit_length() - 1))).astype(np.int64) if self.buckets > 1 else np.zeros(len(h), np.int64)
        left = np.flatnonzero(self.bits[b] > 0)
        for k in range(FILTER_PROBES):
            bb = b[left]
            bit = (mix(h[left] + U(k + 1)) % self.bits[bb].astype(U)).astype(np.int64)
            left = left[(self.data[self.base[bb] + (bit >> 3)] >> (bit & 7).astype(np.uint8)) & 1 > 0]
        out[left] = True
        return out


def _segment(h: np.ndarray) -> tuple[int, bytes]:
    n = -(-max(64, len(h) * FILTER_BITS) // 8) * 8
    bits = np.zeros(n, bool)
    for k in range(FILTER_PROBES):
        bits[(mix(h + U(k + 1)) % U(n)).astype(np.int64)] = True
    return n, np.packbits(bits, bitorder="little").tobytes()


def filter_rows(docs: DataFrame, emit: Emit, least: int) -> DataFrame:
    """Filter segments (bucket, bits, data) of the hashes that `emit` gives at `least` (1 or 2) places. docs: key, text."""
    buckets = buckets_for(docs.sparkSession)

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []

        def flush() -> Iterator[pa.RecordBatch]:
            h, n = np.unique(_masked(np.concatenate(held)), return_counts=True)
            held.clear()
            rows = []
            for many in (False, True):
                part = h[(n > 1) == many]
                _, cut = by_bucket(part, buckets, order=False)
                rows += [(b, many, pack(6, part[cut[b] : cut[b + 1]])) for b in range(buckets) if cut[b] < cut[b + 1]]
            b, m, d = zip(*rows)
            yield pa.RecordBatch.from_arrays([pa.array(b, pa.int32()), pa.array(m, pa.bool_()), pa.array(d, pa.binary())], ["bucket", "many", "data"])

        for batch in batches:
            for s in slices(batch.column("text")):
                if len(h := emit(s, None)[2]):
                    held.append(h)
                if sum(map(len, held)) >= FLUSH:
                    yield from flush()
        if held:
            yield from flush()

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got: dict[int, list[tuple[bool, bytes]]] = defaultdict(list)
        for batch in batches:
            for r in batch.to_pylist():
                got[r["bucket"]].append((r["many"], r["data"]))
        for b in sorted(got):
            sent = got.pop(b)
            h, n = np.unique(np.concatenate([unpack(6, d) for _, d in sent]), return_counts=True)
            if least > 1:
                sure = [unpack(6, d) for many, d in sent if many]
                h = np.unique(np.concatenate([h[n > 1], *sure]))
            if len(h):
                bits, data = _segment(h)
                yield pa.RecordBatch.from_arrays([pa.array([b], pa.int32()), pa.array([bits], pa.int64()), pa.array([data], pa.binary())], ["bucket", "bits", "data"])

    sent = docs.mapInArrow(send, "bucket int, many boolean, data binary")
    return stage(sent.repartition("bucket").mapInArrow(gather, "bucket int, bits long, data binary"), "filter")


def broadcast_filter(rows: DataFrame, limit: int = BROADCAST_BYTES):
    """The filter as a broadcast, or None if it is larger than the limit."""
    spark = rows.sparkSession
    if (rows.agg(F.sum(F.length("data"))).first()[0] or 0) > limit:
        return None
    return spark.sparkContext.broadcast(Filter([tuple(r) for r in rows.collect()], buckets_for(spark)))


def _merged(doc: np.ndarray, lo: np.ndarray, hi: np.ndarray, which: np.ndarray, n: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each of n documents the union of the chosen [lo, hi), as sorted starts and ends."""
    doc, lo, hi = doc[which], lo[which], hi[which]
    order = np.lexsort((lo, doc))
    doc, lo, hi = doc[order], lo[order], hi[order]
    first = np.searchsorted(doc, np.arange(n + 1))
    out = []
    for d in range(n):
        a, b = lo[first[d] : first[d + 1]], np.maximum.accumulate(hi[first[d] : first[d + 1]])
        cut = np.flatnonzero(a[1:] > b[:-1])
        out.append((np.concatenate([a[:1], a[cut + 1]]), np.concatenate([b[cut], b[-1:]])))
    return out


def repeated_places(docs: DataFrame, emit: Emit, firsts: bool = False) -> DataFrame:
    """(key, starts, ends): runs of places whose hash, as `emit` gives it, comes at two or more places.

    docs: key, text and array columns that emit gets as hints, by name, a list for each document of the
    slice.  emit gives documents, places and hashes; then, if its strings stand for more than the place
    where they start, the numbers of places; then, if some are known and only there for others to meet,
    flags of those that want an answer.  With `firsts`, first_starts and first_ends are the runs of one
    of each group of equals.  A document without a repeated place has no row.
    """
    spark = docs.sparkSession
    buckets = buckets_for(spark)
    skip = (buckets.bit_length() - 1) // 8  # leading bytes that the bucket tells
    hints = [c for c in docs.columns if c not in ("key", "text")]

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys: list[bytes] = []
        held: list[tuple[np.ndarray, ...]] = []

        def flush() -> Iterator[pa.RecordBatch]:
            doc, pos, h, size, ask, index = (np.concatenate(x) for x in zip(*held))
            # places that follow each other in one document are told as a run
            first = np.ones(len(doc), bool)
            first[1:] = (doc[1:] != doc[:-1]) | (pos[1:] != pos[:-1] + 1) | (size[1:] > 1) | (size[:-1] > 1)
            at = np.flatnonzero(first)
            table = np.concatenate([doc[at], pos[at], np.diff(np.append(at, len(doc))), size[at]]).astype("<u4").tobytes()
            uid = md5(b"".join(keys) + table).digest()
            order, cut = by_bucket(h, buckets)
            rows = [(uid, -1, None, table, list(keys), None)]
            for b in range(buckets):
                own = order[cut[b] : cut[b + 1]]
                own = np.concatenate([own[ask[own]], own[~ask[own]]])
                wide = np.ascontiguousarray(h[own].astype(">u8")).view(np.uint8).reshape(-1, 8)[:, skip:]
                rows.append((uid, b, np.ascontiguousarray(wide).tobytes(), own[ask[own]].astype("<u4").tobytes(), None, None if index.all() else np.packbits(index[own]).tobytes()))
            held.clear()
            keys.clear()
            for i in range(0, len(rows), 64):
                u, b, d, own, k, x = zip(*rows[i : i + 64])
                yield pa.RecordBatch.from_arrays([pa.array(u, pa.binary()), pa.array(b, pa.int32()), pa.array(d, pa.binary()), pa.array(own, pa.binary()), pa.array(k, pa.list_(pa.binary())), pa.array(x, pa.binary())], ["uid", "bucket", "hashes", "places", "keys", "index"])

        for batch in batches:
            key = batch.column("key")
            for s in slices(batch.column("text")):
                told = {c: [batch.column(c)[i].as_py() or [] for i in range(s.row0, s.row1)] for c in hints}
                doc, pos, h, *more = emit(s, told)
                if len(h):
                    own, doc = np.unique(doc, return_inverse=True)
                    held.append((doc + len(keys), pos, h, more[0] if more else np.ones(len(h), np.int64), more[1] if more[1:] else np.ones(len(h), bool), more[2] if more[2:] else np.ones(len(h), bool)))
                    keys.extend(key[s.row0 + int(i)].as_py() for i in own)
                if sum(len(x[2]) for x in held) >= FLUSH:
                    yield from flush()
        if held:
            yield from flush()

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got: dict[int, list[dict]] = defaultdict(list)

        def out(rows: list[tuple]) -> pa.RecordBatch:
            u, p, a, k = zip(*rows)
            return pa.RecordBatch.from_arrays([pa.array(u, pa.binary()), pa.array(p, pa.binary()), pa.array(a, pa.binary()), pa.array(k, pa.list_(pa.binary()))], ["uid", "places", "answer", "keys"])

        for batch in batches:
            for r in batch.to_pylist():
                if r["bucket"] < 0:
                    yield out([(r["uid"], r["places"], None, r["keys"])])
                else:
                    got[r["bucket"]].append(r)
        for b in sorted(got):
            sent = got.pop(b)
            raw = np.frombuffer(b"".join(r["hashes"] for r in sent), np.uint8).reshape(-1, 8 - skip)
            wide = np.zeros((len(raw), 8), np.uint8)
            wide[:, skip:] = raw
            h = wide.reshape(-1).view(">u8").astype(U)
            order = np.argsort(h, kind="stable")
            same = h[order][1:] == h[order][:-1]
            twice = np.zeros(len(h), bool)
            twice[order[1:][same]] = True
            twice[order[:-1][same]] = True
            if any(r["index"] is not None for r in sent):
                index = np.concatenate([np.unpackbits(np.frombuffer(r["index"], np.uint8), count=len(r["hashes"]) // (8 - skip)).astype(bool) if r["index"] is not None else np.ones(len(r["hashes"]) // (8 - skip), bool) for r in sent])
                cut = np.flatnonzero(np.concatenate([[True], ~same]))
                some = np.logical_or.reduceat(index[order], cut)
                twice[order] &= np.repeat(some, np.diff(np.append(cut, len(h))))
            later = np.zeros(len(h), np.uint32)
            later[order[1:][same]] = 1
            at, rows = 0, []
            for r in sent:
                n = len(r["places"]) // 4
                yes = twice[at : at + n]
                # the lowest bit tells one of each group of equals from the others
                rows.append((r["uid"], None, (np.frombuffer(r["places"], "<u4")[yes] * np.uint32(2) + later[at : at + n][yes]).astype("<u4").tobytes(), None))
                at += len(r["hashes"]) // (8 - skip)
            yield out(rows)

    def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        answers: dict[bytes, list[bytes]] = defaultdict(list)
        sent: dict[bytes, tuple[bytes, list[bytes]]] = {}
        for batch in batches:
            for r in batch.to_pylist():
                if r["keys"] is None:
                    answers[r["uid"]].append(r["answer"])
                else:
                    sent[r["uid"]] = (r["places"], r["keys"])
        for uid in list(answers):
            got = answers.pop(uid)
            table, keys = sent.pop(uid)  # a task that ran again with other rows would lack its own: this fails, the result is never partial
            if len(got) % buckets:
                raise RuntimeError("answers are missing for a block of places")
            doc, pos, n, size = np.frombuffer(table, "<u4").reshape(4, -1).astype(np.int64)
            turn = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            doc, pos, size = np.repeat(doc, n), np.repeat(pos, n) + turn, np.repeat(size, n)
            told = np.concatenate([np.frombuffer(x, "<u4") for x in got])
            made = [_merged(doc, pos, pos + size, told >> 1, len(keys))]
            if firsts:
                made.append(_merged(doc, pos, pos + size, told[told & 1 == 0] >> 1, len(keys)))
            has = [d for d in range(len(keys)) if len(made[0][d][0])]
            if has:
                cols = [pa.array([m[d][side] for d in has], pa.list_(pa.int32())) for m in made for side in (0, 1)]
                yield pa.RecordBatch.from_arrays([pa.array([keys[d] for d in has], pa.binary()), *cols], ["key", *runs_of])

    runs_of = ["starts", "ends", "first_starts", "first_ends"][: 4 if firsts else 2]
    packed = docs.mapInArrow(send, "uid binary, bucket int, hashes binary, places binary, keys array<binary>, index binary")
    # documents' tables go with their block, bucket -1, wherever its hash leads
    spread = F.when(F.col("bucket") < 0, F.hash("uid")).otherwise(F.col("bucket"))
    answered = packed.repartition(spread).mapInArrow(answer, "uid binary, places binary, answer binary, keys array<binary>")
    return answered.repartition("uid").mapInArrow(settle, "key binary, " + ", ".join(f"{c} array<int>" for c in runs_of))


def hinted(texts: DataFrame, found: DataFrame, name: str, how: str = "left", limit: int = BROADCAST_BYTES) -> DataFrame:
    """texts with the runs of an earlier call as <name>_starts, <name>_ends and so on; a broadcast join only if the runs' measured size is within the limit."""
    size = found.agg(F.sum(F.lit(64) + 8 * F.size("starts"))).first()[0] or 0
    found = found.select("key", *[F.col(c).alias(f"{name}_{c}") for c in found.columns if c != "key"])
    return texts.join(F.broadcast(found) if size <= limit else found, "key", how)


def told_runs(hint: dict, name: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, start, end) of a hint's runs."""
    rows = [(d, x, y) for d, (a, b) in enumerate(zip(hint[f"{name}_starts"], hint[f"{name}_ends"])) for x, y in zip(a, b)]
    return tuple(np.array(rows, np.int64).reshape(-1, 3).T)


def expanded(lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(index of the run, place) of every place of the runs [lo, hi)."""
    n = hi - lo
    which = np.repeat(np.arange(len(n)), n)
    return which, np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + lo[which]


def all_runs(found: list[DataFrame], copied: DataFrame, longer: int) -> DataFrame:
    """(key, starts, ends) of all calls' runs of places, each run's end put on by `longer`; null runs for copied texts: the whole text."""
    parts = [f.select("key", "starts", F.transform("ends", lambda e: e + F.lit(longer)).alias("ends"), F.lit(False).alias("whole")) for f in found]
    none = F.array().cast("array<int>")
    both = copied.select("key", none.alias("starts"), none.alias("ends"), F.lit(True).alias("whole"))
    for p in parts:
        both = both.unionByName(p)
    merged = both.groupBy("key").agg(F.flatten(F.collect_list("starts")).alias("s"), F.flatten(F.collect_list("ends")).alias("e"), F.max("whole").alias("whole"))
    return stage(merged.select("key", F.when(~F.col("whole"), F.col("s")).alias("starts"), F.when(~F.col("whole"), F.col("e")).alias("ends")), "runs")


def distinct_texts(docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """(texts, copied): texts (key, text) nearly without copies, and the keys that several rows share.

    Rows with an equal text answer alike, so most copies need not be sent.  Leaving one in does no
    harm: its key is in `copied` anyway.  So copies are left out only where their ids fit a broadcast.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    own = docs.select(F.col(id_col).alias("id"), F.unhex(F.md5(text)).alias("key"), text.alias("text"))
    groups = own.groupBy("key").agg(F.min("id").alias("first"), F.count("*").alias("n")).where("n > 1")
    groups = stage(groups, "copies")
    n = groups.agg(F.sum("n")).first()[0] or 0
    if n * 48 <= BROADCAST_BYTES:
        own = own.join(F.broadcast(groups.select("key", "first")), "key", "left").where(F.col("first").isNull() | (F.col("first") == F.col("id")))
    return own.select("key", "text"), groups.select("key")
