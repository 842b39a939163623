"""LM scoring with a log-frequency Bloom filter of bigram counts.

Training texts give word counts (kept exactly, by 64-bit hash) and bigram counts.  A bigram with
count c is put into a Bloom filter once for each level 1 .. 1 + floor(log2 c); a probe asks for level
1, 2, ... until one is missing, and so learns the quantised count.  Bloom filters err upwards only.

    P(w | v) = (c(vw) + T(v) * P1(w)) / (c(v) + T(v)),   P1(w) = (c(w) + 1/2) / (N + (V + 1) / 2)

T(v) is the number of distinct words seen after v (Witten-Bell); an unseen v leaves P1.  A text is its
words and one end; the end also stands before the first word.

Counting is packed: a task counts the keys of some million tokens with numpy and sends one row per
bucket; a bucket's task adds up what it got.  The model is broadcast if its measured size is within
`limit`; beyond it, texts are coded by chunks of some million tokens, and a chunk asks the buckets for its
distinct words and bigrams, once each.  Keys go sorted, as the steps between them; what comes back are
numbers alone, in the order of the keys.  Filter, probes and scores are the same both ways.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from casemill.llm.arrays import Slice, U, by_bucket, groups_of, mix, pack_planes, pack_sorted, slices, tokens, unpack_planes, unpack_sorted
from casemill.llm.shared import bounded_batches, buckets_for, discard, freed_shuffles, stage

LIMIT = 160 << 20
#: Keys that a task counts before it sends them; tokens of texts that ask for their counts together.
FLUSH, CHUNK = 2_000_000, 2_000_000
#: Bytes of text that are scored at once.
SCORE_BYTES = 512 << 10
END = U(0x5BF0A8B1457695D5)
FILTER_BITS, FILTER_PROBES = 9, 5
LEVELS = 40


def _sequence(s: Slice) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hashes of words and ends, the hash before each, index of each document's first)."""
    t = tokens(s, lower=True)
    n = np.diff(t.first)
    first = np.concatenate([[0], np.cumsum(n + 1)])
    seq = np.full(first[-1], END, U)
    word = np.ones(first[-1], bool)
    word[first[1:] - 1] = False
    seq[word] = t.hashes()
    before = np.concatenate([[END], seq[:-1]])
    return seq, before, first


def _bigram(before: np.ndarray, word: np.ndarray) -> np.ndarray:
    """Key of a bigram: 32 bits of its own, then the first 32 bits of the word before."""
    own = mix(before * U(0x9E3779B97F4A7C15) + word)
    return (own & U(0xFFFFFFFF00000000)) | (before >> U(32))


def _counted(held: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys, sorted, and the sums of their counts."""
    keys = np.concatenate([k for k, _ in held])
    n = np.concatenate([c for _, c in held])
    order = np.argsort(keys, kind="stable")
    keys, n = keys[order], n[order]
    cut = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    return keys[cut], np.add.reduceat(n, cut) if len(cut) else n


def _rows_of(keys: np.ndarray, buckets: int) -> Iterator[tuple[int, slice]]:
    """The buckets that sorted keys are in, and which keys are in each."""
    _, cut = by_bucket(keys, buckets, order=False)
    for b in np.flatnonzero(np.diff(cut)):
        yield int(b), slice(cut[b], cut[b + 1])


def count_keys(rows: DataFrame, keys_of: Callable[[pa.RecordBatch], Iterator[tuple[np.ndarray, np.ndarray]]]) -> DataFrame:
    """(bucket, keys, counts): 64-bit keys with the sums of their counts, packed, sorted, a row for each bucket by the keys' top bits."""
    buckets = buckets_for(rows.sparkSession)

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def flush() -> Iterator[pa.RecordBatch]:
            keys, n = _counted(held)
            held.clear()
            out = [(b, pack_sorted(keys[at]), pack_planes(n[at], 4)) for b, at in _rows_of(keys, buckets)]
            b, k, c = zip(*out)
            yield pa.RecordBatch.from_arrays([pa.array(b, pa.int32()), pa.array(k, pa.binary()), pa.array(c, pa.binary())], ["bucket", "keys", "counts"])

        for batch in batches:
            for keys, n in keys_of(batch):
                if len(keys):
                    held.append((keys, n))
                if sum(len(k) for k, _ in held) >= FLUSH:
                    yield from flush()
        if held:
            yield from flush()

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in groups_of(batches, "bucket"):
            keys, n = _counted([(unpack_sorted(k.as_py()), unpack_planes(c.as_py(), 4)) for k, c in zip(group.column("keys"), group.column("counts"))])
            yield pa.RecordBatch.from_arrays([group.column("bucket")[:1].combine_chunks(), pa.array([pack_sorted(keys)], pa.binary()), pa.array([pack_planes(n, 8)], pa.binary()), pa.array([len(keys)], pa.int64()), pa.array([int(n.sum())], pa.int64())], ["bucket", "keys", "counts", "distinct", "total"])

    sent = rows.mapInArrow(send, "bucket int, keys binary, counts binary")
    return sent.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(add, "bucket int, keys binary, counts binary, distinct long, total long")


def _words(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    for s in slices(batch.column("text")):
        yield np.unique(_sequence(s)[0], return_counts=True)


def _bigrams(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    for s in slices(batch.column("text")):
        seq, before, _ = _sequence(s)
        yield np.unique(_bigram(before, seq), return_counts=True)


def _contexts(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """From distinct bigrams: the words before, as the top half of a key, each counted once a bigram."""
    for keys in batch.column("keys"):
        yield np.unique(unpack_sorted(keys.as_py()) << U(32), return_counts=True)


def _with_followers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for r in batch.to_pylist():
            keys = unpack_sorted(r["keys"])
            own, n = unpack_sorted(r["followed"] or b""), unpack_planes(r["followers"] or b"", 8)
            at = np.minimum(np.searchsorted(own, keys & U(0xFFFFFFFF00000000)), max(len(own) - 1, 0))
            t = np.where(own[at] == keys & U(0xFFFFFFFF00000000), n[at], 0) if len(own) else np.zeros(len(keys))
            out.append(pack_planes(t, 4))
        yield pa.RecordBatch.from_arrays([batch.column(c) for c in ("bucket", "keys", "counts", "distinct", "total")] + [pa.array(out, pa.binary())], ["bucket", "keys", "counts", "distinct", "total", "followers"])


def levels(counts: np.ndarray) -> np.ndarray:
    """1 + floor(log2 c)."""
    return np.frexp(counts.astype(float))[1]


def level_value(level: np.ndarray) -> np.ndarray:
    """The count that a level stands for; 0 for none."""
    return np.where(level <= 1, level.astype(float), 1.25 * np.exp2(level - 1.0))


def _probe_bits(keys: np.ndarray, level: int, k: int, bits: np.ndarray) -> np.ndarray:
    return (mix(keys + U((level << 8) + k + 1) * U(0xD6E8FEB86659FD93)) % bits).astype(np.int64)


def _filtered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A bucket's bigrams as a segment of the filter."""
    for batch in batches:
        out = []
        for r in batch.to_pylist():
            keys, level = unpack_sorted(r["keys"]), levels(unpack_planes(r["counts"], 8))
            n = -(-max(64, int(level.sum()) * FILTER_BITS) // 8) * 8
            flags = np.zeros(n, bool)
            for q in range(1, int(level.max(initial=0)) + 1):
                keys = keys[level >= q]
                level = level[level >= q]
                for k in range(FILTER_PROBES):
                    flags[_probe_bits(keys, q, k, U(n))] = True
            out.append((r["bucket"], n, np.packbits(flags, bitorder="little").tobytes()))
        if out:
            b, n, d = zip(*out)
            yield pa.RecordBatch.from_arrays([pa.array(b, pa.int32()), pa.array(n, pa.int64()), pa.array(d, pa.binary())], ["bucket", "bits", "data"])


class LogFrequencyFilter:
    """Quantised counts by repeated membership probes; a segment of bits for each bucket of keys."""

    def __init__(self, buckets: int, size: int):
        self.shift, self.buckets = U(64 - (buckets.bit_length() - 1)), buckets
        self.bits, self.base = np.zeros(buckets, np.int64), np.zeros(buckets, np.int64)
        self.data, self.used = np.zeros(size, np.uint8), 0

    def put(self, bucket: int, bits: int, data: bytes) -> None:
        self.bits[bucket], self.base[bucket] = bits, self.used
        self.data[self.used : self.used + len(data)] = np.frombuffer(data, np.uint8)
        self.used += len(data)

    def level(self, keys: np.ndarray) -> np.ndarray:
        out = np.zeros(len(keys), np.int64)
        b = (keys >> self.shift).astype(np.int64)
        alive = np.flatnonzero(self.bits[b] > 0)
        for q in range(1, LEVELS + 1):
            for k in range(FILTER_PROBES):
                bb = b[alive]
                at = _probe_bits(keys[alive], q, k, self.bits[bb].astype(U))
                alive = alive[(self.data[self.base[bb] + (at >> 3)] >> (at & 7).astype(np.uint8)) & 1 > 0]
            if not len(alive):
                break
            out[alive] = q
        return out


class Words:
    """Exact counts and followers of the training words, by hash."""

    def __init__(self, n: int):
        self.keys, self.counts, self.followers, self.used = np.zeros(n, U), np.zeros(n, np.uint32), np.zeros(n, np.uint32), 0

    def put(self, keys: bytes, counts: bytes, followers: bytes) -> None:
        k = unpack_sorted(keys)
        to = slice(self.used, self.used + len(k))
        self.keys[to], self.counts[to], self.followers[to] = k, np.minimum(unpack_planes(counts, 8), 2**32 - 1), unpack_planes(followers, 4)
        self.used += len(k)

    def get(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        own, back = np.unique(keys, return_inverse=True)
        at = np.minimum(np.searchsorted(self.keys, own), max(len(self.keys) - 1, 0))
        has = self.keys[at] == own if len(self.keys) else np.zeros(len(own), bool)
        n, t = (np.where(has, x[at], 0)[back].astype(float) if len(self.keys) else np.zeros(len(keys)) for x in (self.counts, self.followers))
        return n, t


def _scores(seq_counts: tuple[np.ndarray, np.ndarray], end_counts: tuple[np.ndarray, np.ndarray], level: np.ndarray, first: np.ndarray, norm: float) -> np.ndarray:
    """A row a text: tokens, known ones, base score, score.  From the counts and followers of each token, and of an end, and the level of each bigram."""
    n, t = seq_counts
    # the word before each: the one a place earlier, or an end
    shift = lambda x, e: np.concatenate([e, x[:-1]])
    nv, tv = shift(n, end_counts[0]), shift(t, end_counts[1])
    c = np.minimum(level_value(level), np.minimum(nv, np.maximum(n, 0)))
    base = np.log10(n + 0.5) - norm
    p = np.where(nv + tv > 0, (c + tv * 10**base) / np.maximum(nv + tv, 1), 10**base)
    sums = [np.add.reduceat(x, first[:-1]) for x in (n > 0, base, np.log10(p))]
    return np.stack([np.diff(first), *sums], 1)


def _batch(own: pa.RecordBatch, x: np.ndarray, total: int) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([*own.columns, pa.array(x[:, 0].astype(np.int64)), pa.array(x[:, 1].astype(np.int64)), pa.array(np.full(len(x), total, np.int64)), pa.array(x[:, 2]), pa.array(x[:, 3])], [*own.schema.names, "n_tokens", "n_known", "train_tokens", "base_score", "score"])


def train(texts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(words, bigrams) of a `text` column, packed by bucket; words with their numbers of distinct followers."""
    words = count_keys(texts, _words)
    bigrams = stage(count_keys(texts, _bigrams), "bigrams")
    after = count_keys(bigrams.select("keys"), _contexts).select("bucket", F.col("keys").alias("followed"), F.col("counts").alias("followers"))
    return stage(words.join(after, "bucket", "left").mapInArrow(_with_followers, "bucket int, keys binary, counts binary, distinct long, total long, followers binary"), "words"), bigrams


def score_texts(docs: DataFrame, training: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: list[str] | None = None, limit: int = LIMIT) -> DataFrame:
    """One row per row of docs: `keep` (the id by default), n_tokens, n_known, train_tokens, base_score, score.

    Both scores are base-10 logarithms of the text's probability: base_score by words alone, score by
    the bigram model, both from the texts of `training`.  A-Z count as a-z.  Null and empty texts are
    one end.  Repeated rows are scored each.  Without training texts every count is 0 and both scores
    are equal.  An empty table gives an empty table.
    """
    spark = docs.sparkSession
    keep = keep or [id_col]
    text = F.coalesce(F.col(text_col), F.lit(""))
    with freed_shuffles(spark):
        words, bigrams = train(training.select(text.alias("text")))
        segments = stage(bigrams.mapInArrow(_filtered, "bucket int, bits long, data binary"), "filter", bigrams)
    distinct, total = words.agg(F.sum("distinct"), F.sum("total")).first()
    distinct, total = distinct or 0, total or 0
    norm = float(np.log10(total + 0.5 * (distinct + 1)))
    size = segments.agg(F.sum(F.length("data"))).first()[0] or 0
    own = docs.select(*keep, text.alias("__text"))
    kinds = dict(docs.dtypes)
    layout = ", ".join(f"`{c}` {kinds[c]}" for c in keep) + ", n_tokens long, n_known long, train_tokens long, base_score double, score double"
    if size + 16 * distinct > limit:
        return _asked(own, layout, words, segments, total, norm)
    table, counts = Words(distinct), LogFrequencyFilter(buckets_for(spark), size)
    for r in words.orderBy("bucket").select("keys", "counts", "followers").toLocalIterator():
        table.put(bytes(r[0]), bytes(r[1]), bytes(r[2]))
    for r in segments.toLocalIterator():
        counts.put(r[0], r[1], bytes(r[2]))
    discard(words, segments)
    shared = spark.sparkContext.broadcast((table, counts))

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, counts = shared.value
        for batch in batches:
            parts = [np.zeros((0, 4))]
            for s in slices(batch.column("__text"), SCORE_BYTES):
                seq, before, first = _sequence(s)
                keys, back = np.unique(_bigram(before, seq), return_inverse=True)
                parts.append(_scores(table.get(seq), table.get(np.array([END])), counts.level(keys)[back], first, norm))
            yield _batch(batch.select(batch.schema.names[:-1]), np.concatenate(parts), total)

    return own.mapInArrow(scored, layout)


#: Kinds of rows that meet in a bucket, in this order: its words, its segment of the filter, words and bigrams that are asked for.
WORDS, SEGMENT, ASK_WORDS, ASK_BIGRAMS = range(4)


def _coded(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    """Chunks of whole texts, each of about `most` tokens: the other columns as an Arrow stream, the distinct words, frequent ones first, the place of each token among them, and the number of each text's tokens."""
    held: list[tuple[pa.RecordBatch, np.ndarray, np.ndarray]] = []

    def chunk() -> pa.RecordBatch:
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, held[0][0].schema) as out:
            for own, _, _ in held:
                out.write_batch(own)
        words, back, n = np.unique(np.concatenate([x for _, x, _ in held]), return_inverse=True, return_counts=True)
        order = np.argsort(-n, kind="stable")
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        texts = np.concatenate([x for _, _, x in held])
        held.clear()
        return pa.RecordBatch.from_arrays([pa.array([x], pa.binary()) for x in (sink.getvalue().to_pybytes(), words[order].astype("<u8").tobytes(), pack_planes(place[back], 4), pack_planes(texts, 5))], ["own", "words", "seq", "sizes"])

    for batch in batches:
        for s in slices(batch.column("__text")):
            seq, _, first = _sequence(s)
            held.append((batch.select(batch.schema.names[:-1]).slice(s.row0, s.row1 - s.row0), seq, np.diff(first)))
            if sum(len(x) for _, x, _ in held) >= most:
                yield chunk()
    if held:
        yield chunk()


def _decoded(r: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(distinct words, as they were coded; the place of each token among them; distinct bigrams, sorted) of a chunk."""
    words, place = np.frombuffer(r["words"], "<u8"), unpack_planes(r["seq"], 4)
    seq = words[place]
    keys = _bigram(np.concatenate([[END], seq[:-1]]), seq)
    keys.sort()
    return words, place, keys[np.concatenate([[True], keys[1:] != keys[:-1]])]


def _asked(own: DataFrame, layout: str, words: DataFrame, segments: DataFrame, total: int, norm: float) -> DataFrame:
    """The same scores where the model is not broadcast: each chunk of texts sends its distinct words and bigrams to their buckets, which answer with counts and levels in the order of the keys."""
    spark = own.sparkSession
    buckets, most = buckets_for(spark), CHUNK
    names = "bucket int, kind int, chunk long, data binary, counts binary, followers binary, bits long"

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                words, _, bigrams = _decoded(r)
                for kind, keys in ((ASK_WORDS, np.sort(words)), (ASK_BIGRAMS, bigrams)):
                    b, data = zip(*[(b, pack_sorted(keys[at])) for b, at in _rows_of(keys, buckets)])
                    n = len(b)
                    yield pa.RecordBatch.from_arrays([pa.array(b, pa.int32()), pa.array([kind] * n, pa.int32()), pa.array([r["chunk"]] * n, pa.int64()), pa.array(data, pa.binary()), pa.nulls(n, pa.binary()), pa.nulls(n, pa.binary()), pa.nulls(n, pa.int64())], [c.split()[0] for c in names.split(", ")])

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, table, levels_of = None, Words(0), LogFrequencyFilter(buckets, 0)
        for batch in batches:
            bucket, kind = batch.column("bucket").to_numpy(), batch.column("kind").to_numpy()
            cut = np.flatnonzero(np.concatenate([[True], (bucket[1:] != bucket[:-1]) | (kind[1:] != kind[:-1]), [True]])) if len(bucket) else []
            for a, e in zip(cut[:-1], cut[1:]):
                rows = batch.slice(a, e - a)
                if bucket[a] != at:
                    at, table, levels_of = bucket[a], Words(0), LogFrequencyFilter(buckets, 0)
                data = [x.as_py() for x in rows.column("data")]
                if kind[a] == WORDS:
                    table = Words(len(unpack_sorted(data[0])))
                    table.put(data[0], rows.column("counts")[0].as_py(), rows.column("followers")[0].as_py())
                elif kind[a] == SEGMENT:
                    levels_of = LogFrequencyFilter(buckets, len(data[0]))
                    levels_of.put(int(at), rows.column("bits")[0].as_py(), data[0])
                else:
                    keys = [unpack_sorted(x) for x in data]
                    ends = np.cumsum([0, *map(len, keys)])
                    every = np.concatenate(keys)
                    if kind[a] == ASK_WORDS:
                        n, t = table.get(every)
                        told = [pack_planes(np.concatenate([n[x:y], t[x:y]]), 4) for x, y in zip(ends[:-1], ends[1:])]
                    else:
                        level = levels_of.level(every).astype(np.uint8)
                        told = [level[x:y].tobytes() for x, y in zip(ends[:-1], ends[1:])]
                    yield pa.RecordBatch.from_arrays([rows.column("chunk"), rows.column("kind"), rows.column("bucket"), pa.array(told, pa.binary())], ["chunk", "kind", "bucket", "data"])

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in groups_of(batches, "chunk"):
            kind = group.column("kind").to_numpy()
            # a chunk's text comes first, then its answers by bucket, which is the order of the keys
            words, place, bigrams = _decoded(r := group.slice(0, 1).to_pylist()[0])
            told = [unpack_planes(x.as_py(), 4).reshape(2, -1) for x in group.column("data").filter(pa.array(kind == ASK_WORDS))]
            counts = np.concatenate(told, 1).astype(float)
            level = np.concatenate([np.frombuffer(x.as_py(), np.uint8) for x in group.column("data").filter(pa.array(kind == ASK_BIGRAMS))])
            order = np.argsort(words, kind="stable")
            of = np.empty_like(counts)
            of[:, order] = counts
            end = of[:, words == END]
            first, row = np.concatenate([[0], np.cumsum(unpack_planes(r["sizes"], 5))]), 0
            parts = []
            while row < len(first) - 1:
                last = max(row + 1, int(np.searchsorted(first, first[row] + (1 << 17), "right")) - 1)
                own = place[first[row] : first[last]]
                seq = words[own]
                at = np.searchsorted(bigrams, _bigram(np.concatenate([[END], seq[:-1]]), seq))
                parts.append(_scores((of[0, own], of[1, own]), (end[0], end[1]), level[at].astype(np.int64), first[row : last + 1] - first[row], norm))
                row = last
            x, row = np.concatenate(parts), 0
            for own in pa.ipc.open_stream(r["own"]):
                yield _batch(own, x[row : row + own.num_rows], total)
                row += own.num_rows

    with freed_shuffles(spark), bounded_batches(spark):
        coded = stage(own.mapInArrow(lambda batches: _coded(batches, most), "own binary, words binary, seq binary, sizes binary").withColumn("chunk", F.monotonically_increasing_id()), "coded")
        null = lambda kind: F.lit(None).cast(kind)
        known = words.select("bucket", F.lit(WORDS).alias("kind"), null("long").alias("chunk"), F.col("keys").alias("data"), "counts", "followers", null("long").alias("bits"))
        known = known.unionByName(segments.select("bucket", F.lit(SEGMENT).alias("kind"), null("long").alias("chunk"), "data", null("binary").alias("counts"), null("binary").alias("followers"), "bits"))
        asked = known.unionByName(coded.select("chunk", "words", "seq").mapInArrow(ask, names)).repartition("bucket").sortWithinPartitions("bucket", "kind")
        told = stage(asked.mapInArrow(answer, "chunk long, kind int, bucket int, data binary"), "told", words, segments)
        every = coded.withColumns({"kind": F.lit(-1), "bucket": F.lit(-1), "data": null("binary")}).unionByName(told, allowMissingColumns=True)
        every = every.repartition("chunk").sortWithinPartitions("chunk", "kind", "bucket")
        return stage(every.mapInArrow(scored, layout), "scores", coded, told)


def op1(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 1, F.lit(False))
    docs = docs.withColumn("held_out", held)
    return score_texts(docs, docs.where(~F.col("held_out")), keep=["doc_id", "held_out"])
