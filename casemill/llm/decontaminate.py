"""Benchmark decontamination by latent semantic retrieval.

1. Passages are windows of `width` words, half a window apart.  Terms are the benchmark's words; their
   document frequencies are counted over all documents.  Texts are read for their known words once,
   and these are written with their places; all that follows reads those and no text.
2. A randomised SVD of the TF-IDF matrix gives the latent space: blocks of rows multiply a Gaussian
   matrix by A^T A in Spark tasks, the products (terms x rank) are summed by term range through a
   shuffle, and the orthonormal basis is refined by power iteration.  The rows are the benchmark's
   passages and those of all documents, weighted alike.
3. Every passage of every document is projected and compared with every benchmark item by cosine.
   Passages that have five words in a row of an item are candidates too, however frequent its words
   are, so no verbatim copy depends on weights.
4. Candidates are checked word by word (words that no item has are in no common subsequence): the longest common subsequence of the item with the text around
   the passage covers most of the item; or it covers less, as in a paraphrase, but all words of the
   item's answer, its last sentence, are there in their order, others between them or not.

Items of more than two windows are cut into windows, half a window apart, for steps 2 and 3; step 4
takes them whole.  The benchmark is the query set: it is taken in blocks of about `block_items` such
pieces, each with its own terms.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from casemill.llm.arrays import U, slices, tokens, window_hash
from casemill.llm.shared import WORD, bounded_batches, stage

RANK, POWER = 96, 2
#: Terms in more than this share of the documents are left out; items that keep under a quarter of their terms are searched for once more with all of them.  Terms weigh their squared log inverse frequency, LEAST_WEIGHT at least.
COMMON, LEAST_WEIGHT = 0.1, 0.1
#: Words in a row that make a candidate; as many as an answer has at least.
SEED = 5
TERM_RANGE = 1024
#: Bytes of text that a task reads at once.
PART = 256 << 10
#: Known words whose vectors a task adds up at once, and half-windows a known word that it looks at for them.
WORDS, SPARSE = 1 << 15, 8
#: Most cosines that a task has at once.
MOST_CELLS = 2048 * 2048


class Terms:
    """Index of the benchmark's words by hash."""

    def __init__(self, hashes: np.ndarray):
        self.hashes = np.unique(hashes)
        self.seen = np.zeros(1 << 20, bool)
        self.seen[self.hashes >> U(44)] = True

    def find(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(places in h of known words, their terms)."""
        at = np.flatnonzero(self.seen[h >> U(44)])
        if not len(self.hashes):
            return at[:0], at[:0]
        k = np.minimum(np.searchsorted(self.hashes, h[at]), len(self.hashes) - 1)
        yes = self.hashes[k] == h[at]
        return at[yes], k[yes]


def _pieces(h: np.ndarray, half: int) -> list[np.ndarray]:
    """An item's words as retrieval queries: whole up to two windows, longer ones in windows half a window apart."""
    if len(h) <= 4 * half:
        return [h]
    return [h[a : a + 2 * half] for a in [*range(0, len(h) - 2 * half, half), len(h) - 2 * half]]


class Items:
    """TF-IDF vectors of the retrieval queries, of length one, by their entries; the driver holds no matrix of queries x terms."""

    def __init__(self, parts: list[np.ndarray], terms: Terms, idf: np.ndarray):
        self.shape = len(parts), len(terms.hashes)
        found = [terms.find(h)[1] for h in parts]
        key = np.concatenate([np.zeros(0, np.int64), *(i * self.shape[1] + k.astype(np.int64) for i, k in enumerate(found))])
        key, count = np.unique(key, return_counts=True)
        self.row, self.col = key // max(self.shape[1], 1), key % max(self.shape[1], 1)
        weight = count * idf[self.col]
        self.length = np.sqrt(np.bincount(self.row, weight * weight, minlength=self.shape[0]))
        self.weight = weight / np.maximum(self.length, 1e-12)[self.row]

    def _sum(self, to: np.ndarray, at: np.ndarray, x: np.ndarray, of: np.ndarray) -> np.ndarray:
        for a in range(0, len(self.weight), TERM_RANGE):
            b = a + TERM_RANGE
            np.add.at(to, at[a:b], self.weight[a:b, None] * x[of[a:b]])
        return to

    def times(self, q: np.ndarray) -> np.ndarray:
        """Queries x columns of q."""
        return self._sum(np.zeros((self.shape[0], q.shape[1])), self.row, q, self.col)

    def back(self, y: np.ndarray) -> np.ndarray:
        """Terms x columns of y: the transpose times y."""
        return self._sum(np.zeros((self.shape[1], y.shape[1])), self.col, y, self.row)


def _near(at: list[int], reach: int) -> Iterator[list[int]]:
    """Sorted places in groups that reach less than `reach` from their first; all alone if reach is 0 or 1."""
    group = at[:1]
    for w in at[1:]:
        if w - group[0] < reach:
            group.append(w)
        else:
            yield group
            group = [w]
    if group:
        yield group


class Seeds:
    """Runs of SEED words of the items, or the whole item where it is shorter.

    Of an item's runs those stay that the fewest items have, half of them at least: a copy has all of
    them, and a phrase that many items share makes no candidates of them all.
    """

    def __init__(self, items: list[np.ndarray]):
        found: dict[int, list[tuple[np.ndarray, np.ndarray]]] = defaultdict(list)
        for i, h in enumerate(items):
            m = min(SEED, len(h))
            runs = np.unique(window_hash(h, m))
            found[m].append((runs, np.full(len(runs), i)))
        self.by_length = {}
        for m, parts in found.items():
            run, item = (np.concatenate(x) for x in zip(*parts))
            _, back, n = np.unique(run, return_inverse=True, return_counts=True)
            n = n[back]
            order = np.lexsort((n, item))
            first = np.searchsorted(item[order], item)
            middle = n[order][first + (np.bincount(item)[item] - 1) // 2]
            keep = n <= middle
            run, item = run[keep], item[keep]
            order = np.argsort(run, kind="stable")
            self.by_length[m] = Terms(run), np.searchsorted(run[order], np.unique(run)), item[order]

    def find(self, doc: np.ndarray, word: np.ndarray, h: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(index of a run's first word, item) of every run in known words with their documents, places there and hashes."""
        for m, (terms, first, item) in self.by_length.items():
            last = len(h) - m + 1
            at = np.flatnonzero((word[m - 1 :] - word[: max(last, 0)] == m - 1) & (doc[m - 1 :] == doc[: max(last, 0)]))
            if not len(at):
                continue
            place, k = terms.find(window_hash(h, m)[at])
            n = np.diff(np.append(first, len(item)))[k]
            skip = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            yield np.repeat(at[place], n), item[np.repeat(first[k], n) + skip]


def _hashes(text: str) -> np.ndarray:
    s = next(slices(pa.array([text])))
    return tokens(s, lower=True).hashes()


def _sums(row: np.ndarray, k: np.ndarray, start: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Sums of weight[k] by half-window; row is in order."""
    out = np.zeros((start[-1], weight.shape[1]), weight.dtype)
    if len(row):
        cut = np.flatnonzero(np.concatenate([[True], row[1:] != row[:-1]]))
        out[row[cut]] = _group_sums(weight, k, cut)
    return out


def _group_sums(x: np.ndarray, at: np.ndarray, first: np.ndarray, few: int = 16) -> np.ndarray:
    """Sums of the rows x[at] by group, groups beginning at `first`: most have few rows, so the j-th rows of all are added at once."""
    n = np.diff(np.append(first, len(at)))
    out, left = x[at[first]], np.arange(len(first))
    for j in range(1, few):
        left = left[n[left] > j]
        out[left] += x[at[first[left] + j]]
    for g in left[n[left] > few]:
        out[g] += x[at[first[g] + few : first[g] + n[g]]].sum(0)
    return out


def _joined(x: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Windows from half-windows: each with the next of its document."""
    out = x.copy()
    if len(x) > 1:
        out[:-1] += x[1:]
        ends = start[1:-1] - 1
        ends = np.unique(ends[ends >= 0])
        out[ends] = x[ends]
    return out


def known_terms(texts: DataFrame, terms: Terms, half: int) -> DataFrame:
    """(n, row, spot, term, after the other columns): of each text with words its number of half-windows, and of each known word its half-window, place in it and term, packed by four bytes."""
    shared = texts.sparkSession.sparkContext.broadcast(terms)
    others = [(c, kind) for c, kind in texts.dtypes if c != "text"]

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for s in slices(batch.column("text"), PART):
                t = tokens(s, lower=True)
                at, k = shared.value.find(t.hashes())
                doc = t.doc[at]
                row, spot = np.divmod(at - t.first[doc], half)
                n = -(-np.diff(t.first) // half)
                places = pa.py_buffer((4 * np.searchsorted(doc, np.arange(len(n) + 1))).astype(np.int32))
                packed = (pa.Array.from_buffers(pa.binary(), len(n), [None, places, pa.py_buffer(x.astype("<i4"))]) for x in (row, spot, k))
                own = (batch.column(c).slice(s.row0, s.row1 - s.row0) for c, _ in others)
                yield pa.RecordBatch.from_arrays([*own, pa.array(n, pa.int64()), *packed], [*(c for c, _ in others), "n", "row", "spot", "term"]).filter(pa.array(n > 0))

    layout = "".join(f"`{c}` {kind}, " for c, kind in others)
    return texts.select(*(c for c, _ in others), "text").mapInArrow(find, f"{layout}n long, row binary, spot binary, term binary")


def _placed(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """A batch of `known_terms`, WORDS of them at once: (first text, half-window of each text's start, half-windows, places in them and terms of the known words)."""
    n = batch.column("n").to_numpy()
    x = batch.column("term")
    a, off = 0, np.frombuffer(x.buffers()[1], np.int32)[x.offset : x.offset + len(x) + 1] // 4
    steps = np.concatenate([[0], np.cumsum(n)])
    row, spot, term = (np.frombuffer(batch.column(c).buffers()[2] or b"", "<i4") for c in ("row", "spot", "term"))
    while a < len(n):
        b = max(a + 1, int(min(np.searchsorted(off, off[a] + WORDS, "right"), np.searchsorted(steps, steps[a] + SPARSE * WORDS, "right"))) - 1)
        start = steps[a : b + 1] - steps[a]
        own = slice(off[a], off[b])
        yield a, start, np.repeat(start[:-1], np.diff(off[a : b + 1])) + row[own], spot[own], term[own]
        a = b


def _known(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(half-window of each text's start, half-windows and terms of the known words) of `_placed`."""
    for _, start, row, _, term in _placed(batch):
        yield start, row, term


def _filled(start: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The half-windows whose windows have a word of `row`, numbered anew: (which they are, starts of those that follow one another in a text, new numbers of row)."""
    some = np.zeros(start[-1], bool)
    some[row] = True
    some[:-1] |= some[1:]
    at = np.flatnonzero(some)
    first = np.zeros(len(some), bool)
    first[start[:-1]] = True
    first[1:] |= ~some[:-1]
    return at, np.append(np.flatnonzero(first[at]), len(at)), (np.cumsum(some) - 1)[row]


def document_frequency(known: DataFrame, n: int) -> np.ndarray:
    """In how many texts each of n terms is."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df = np.zeros(n, np.int64)
        for batch in batches:
            for start, row, k in _known(batch):
                doc = np.searchsorted(start, row, "right") - 1
                df += np.bincount(np.unique(doc * n + k) % n, minlength=n)
        k = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(k, pa.int64()), pa.array(df[k], pa.int64())], ["term", "df"])

    rows = known.mapInArrow(count, "term long, df long").groupBy("term").agg(F.sum("df").alias("df"))
    out = np.zeros(n, np.int64)
    for r in rows.toLocalIterator():  # bounded by the block's words
        out[r.term] = r.df
    return out


def latent_basis(known: DataFrame, place: np.ndarray, idf: np.ndarray, items: Items, rank: int) -> np.ndarray:
    """Orthonormal basis (terms x rank) of the dominant row space of the TF-IDF passages of all texts and of the items, both scaled to equal weight.

    known: of `known_terms`; place: of each of its terms the row of the basis, -1 for terms that are left out.
    """
    spark = known.sparkSession
    n = len(idf)
    rank = min(rank, n)
    q = np.linalg.qr(np.random.RandomState(11).standard_normal((n, rank)))[0]
    n_rows = known.agg(F.sum("n")).first()[0] or 0
    for _ in range(POWER):
        shared = spark.sparkContext.broadcast((place, idf, (idf[:, None] * q).astype(np.float32)))

        def multiply(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            place, idf, weight = shared.value
            total = np.zeros((n, rank))
            for batch in batches:
                for start, row, k in _known(batch):
                    k = place[k]
                    row, k = row[k >= 0], k[k >= 0]
                    if not len(k):
                        continue
                    _, start, row = _filled(start, row)
                    y = _joined(_sums(row, k, start, weight), start)
                    y /= np.maximum(_norms(start, row, k, idf), 1e-12).astype(np.float32)[:, None] ** 2
                    # A^T y: a word's half-window is in its own window and in the one before
                    back = y.copy()
                    back[1:] += y[:-1]
                    back[start[:-1]] = y[start[:-1]]
                    order = np.argsort(k, kind="stable")
                    cut = np.flatnonzero(np.concatenate([[True], k[order][1:] != k[order][:-1]]))
                    own = k[order][cut]
                    total[own] += idf[own, None] * _group_sums(back, row[order], cut)
            for a in range(0, n, TERM_RANGE):
                if (part := total[a : a + TERM_RANGE]).any():
                    yield pa.RecordBatch.from_arrays([pa.array([a], pa.int64()), pa.array([part.astype("<f8").tobytes()], pa.binary())], ["at", "sums"])

        def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            got: dict[int, np.ndarray] = defaultdict(lambda: np.zeros(1))
            for batch in batches:
                for r in batch.to_pylist():
                    got[r["at"]] = got[r["at"]] + np.frombuffer(r["sums"], "<f8")
            for a, x in got.items():
                yield pa.RecordBatch.from_arrays([pa.array([a], pa.int64()), pa.array([x.tobytes()], pa.binary())], ["at", "sums"])

        layout = "at long, sums binary"
        y = np.zeros((n, rank))
        for r in known.mapInArrow(multiply, layout).repartition("at").mapInArrow(add, layout).toLocalIterator():
            block = np.frombuffer(bytes(r.sums), "<f8").reshape(-1, rank)
            y[r.at : r.at + len(block)] = block
        own = items.back(items.times(q))
        q = np.linalg.qr(y / max(n_rows, 1) + 4 * own / max(items.shape[0], 1))[0]
    return q


def _norms(start: np.ndarray, row: np.ndarray, k: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """Length of each window's TF-IDF vector; a word twice in a window counts as twice its weight, in one half-window or both."""
    n = int(start[-1])
    if not len(row):
        return np.zeros(n)
    terms = len(idf)
    key, count = np.unique(row.astype(np.int64) * terms + k, return_counts=True)
    r, t = key // terms, key % terms
    w = count * idf[t]
    square = np.bincount(r, w * w, minlength=n)
    # windows: own square + the next half-window's square + twice the product of shared words
    nxt = np.searchsorted(key, key + terms)
    nxt = np.minimum(nxt, len(key) - 1)
    both = key[nxt] == key + terms
    cross = np.bincount(r[both], 2 * w[both] * w[nxt[both]], minlength=n)
    last = np.zeros(n, bool)
    ends = start[1:] - 1
    last[ends[ends >= 0]] = True
    follow = np.concatenate([square[1:], [0.0]])
    return np.sqrt(np.where(last, square, square + follow + cross))


def common_subsequence(a: list, b: list) -> int:
    """Length of the longest common subsequence, a bit a word of a."""
    where: dict = defaultdict(int)
    for i, x in enumerate(a):
        where[x] |= 1 << i
    full = (1 << len(a)) - 1
    v = full
    for x in b:
        if (m := where.get(x, 0)) :
            u = v & m
            v = ((v + u) | (v - u)) & full
    return len(a) - v.bit_count()


def answer_of(words: list[str]) -> list[str]:
    """The last sentence of an item, its last five words at least."""
    at = max((i + 1 for i, w in enumerate(words[:-1]) if w[-1] in ".?!"), default=0)
    return words[min(at, max(len(words) - 5, 0)) :]


def _search(known: DataFrame, names: np.ndarray, place: np.ndarray, n_docs: int, rows: list, hashes: list[np.ndarray], terms: Terms, df: np.ndarray, seeds: Seeds, layout: str, half: int, cosine: float, held: float, copied: float, paraphrased: float) -> DataFrame:
    """Documents and items (rows) that agree, by candidates of the latent space over `terms` and of `seeds`.  names: hashes of the terms of `known`; place: as in `latent_basis`."""
    spark = known.sparkSession
    idf = np.maximum(np.log((n_docs + 2) / (df + 1)) ** 2, LEAST_WEIGHT)
    parts = [(i, p) for i, h in enumerate(hashes) for p in _pieces(h, half)]
    item_of = np.array([i for i, _ in parts])
    items = Items([h for _, h in parts], terms, idf)
    q = latent_basis(known, place, idf, items, RANK)
    latent = items.times(q)
    size = np.linalg.norm(latent, axis=1)
    latent /= np.maximum(size, 1e-12)[:, None]
    # what a window must hold of an item's weight, along the item
    needed = (held * items.length * size).astype(np.float32)
    plain = [np.searchsorted(names, h).tolist() for h in hashes]
    ends = [len(answer_of([w.decode() for w in r.text.encode().lower().split()])) for r in rows]
    shared = spark.sparkContext.broadcast((names, place, (idf[:, None] * q).astype(np.float32), latent.astype(np.float32).T.copy(), needed, item_of, [r.item for r in rows], plain, [x[len(x) - n :] for x, n in zip(plain, ends)], seeds))

    def search(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
        hashes, place, weight, latent, needed, item_of, names, plain, answers, seeds = shared.value
        pieces = np.bincount(item_of)
        first_piece = np.cumsum(pieces) - pieces
        step = max(1, min(8192, MOST_CELLS // latent.shape[1]))
        for batch in batches:
            for row0, start, row, spot, term in _placed(batch):
                window, bounds, short = _filled(start, row)
                k = place[term]
                y = _joined(_sums(short[k >= 0], k[k >= 0], bounds, weight), bounds)
                doc = np.searchsorted(start, row, "right") - 1
                word = (row - start[doc]) * half + spot
                size = np.linalg.norm(y, axis=1)
                some = np.flatnonzero(size > 1e-6)
                hits: dict[tuple[int, int], dict[int, float]] = defaultdict(dict)
                for a in range(0, len(some), step):
                    at = some[a : a + step]
                    dot = y[at] @ latent
                    near = dot / size[at, None]
                    p, i = np.nonzero((near >= cosine) & (dot >= needed))
                    w = window[at[p]]
                    for d, w, k, c in zip(np.searchsorted(start, w, "right") - 1, w, i, near[p, i]):
                        wins = hits[int(d), int(item_of[k])]
                        wins[int(w - start[d])] = max(wins.get(int(w - start[d]), 0.0), float(c))
                for at, i in seeds.find(doc, word, hashes[term]):
                    d, i, w = np.unique([doc[at], i, short[at]], axis=1)
                    # cosine with the item's best piece
                    n = pieces[i]
                    pair = np.repeat(np.arange(len(i)), n)
                    skip = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                    dot = np.einsum("ij,ij->i", y[w[pair]], latent.T[first_piece[i][pair] + skip])
                    dot = np.maximum.reduceat(dot, np.cumsum(n) - n) if len(n) else dot
                    for d, k, w, c in zip(d.tolist(), i.tolist(), (window[w] - start[d]).tolist(), (dot / np.maximum(size[w], 1e-12)).tolist()):
                        hits[d, k].setdefault(w, c)
                out = []
                first = np.searchsorted(doc, np.arange(len(start)))
                for (d, k), wins in hits.items():
                    item = plain[k]
                    inside, at = term[first[d] : first[d + 1]], word[first[d] : first[d + 1]]
                    best, seen = (0.0, False), -1
                    for group in _near(sorted(wins), len(item) // 4 // half):
                        lo, hi = max(0, group[0] * half - len(item)), (group[-1] + 2) * half + len(item)
                        if hi <= seen:
                            continue
                        seen = hi
                        text = inside[slice(*np.searchsorted(at, [lo, hi]))].tolist()
                        share = common_subsequence(item, text) / len(item)
                        if share >= paraphrased:
                            answered = common_subsequence(answers[k], text) == len(answers[k])
                            best = max(best, (share, answered))
                    if best[0] >= copied or best[0] >= paraphrased and best[1]:
                        out.append((row0 + d, names[k], best[0], max(wins.values()), best[1]))
                if out:
                    d, n, share, c, ok = zip(*out)
                    yield pa.RecordBatch.from_arrays([batch.column("id").take(pa.array(d)), pa.array(n), pa.array(share, pa.float64()), pa.array(c, pa.float64()), pa.array(ok, pa.bool_())], ["id", "item", "share", "cosine", "answered"])

    return known.mapInArrow(search, layout)


def find_leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", width: int = 32, cosine: float = 0.45, held: float = 0.25, copied: float = 0.7, paraphrased: float = 0.5, block_items: int = 5000) -> DataFrame:
    """One row per document and benchmark item found in it: id, item_id, item_text's common share, cosine, answered.

    A pair is reported if in some window their latent cosine reaches `cosine` and the window holds the share
    `held` of the item's (of a piece's, in items of over two windows) weight, or a run of five words of the
    item starts there, and the common subsequence covers at least `copied` of the item's words, or at
    least `paraphrased` with the answer's words in order.  A-Z count as a-z.  Null and empty texts and items are in nothing.
    Repeated rows of documents or items are reported once.  Rows with a null id are reported with it.
    Extra columns are ignored.  Without items or documents the result is empty.
    """
    spark = docs.sparkSession
    half = max(width // 2, 1)
    text = F.coalesce(F.col(text_col), F.lit(""))
    own = docs.select(F.col(id_col).alias("id"), text.alias("text"))
    kinds = {id_col: dict(docs.dtypes)[id_col], item_col: dict(benchmark.dtypes)[item_col]}
    layout = f"id {kinds[id_col]}, item {kinds[item_col]}, share double, cosine double, answered boolean"
    items = stage(benchmark.where(F.col(item_text_col).isNotNull()).select(F.col(item_col).alias("item"), F.col(item_text_col).alias("text")).distinct(), "items")
    long = F.regexp_count("text", F.lit(WORD))
    pieces = items.agg(F.sum(F.when(long <= 4 * half, 1).otherwise(F.ceil(long / half) - 1))).first()[0] or 0
    blocks = -(-int(pieces) // block_items)
    found = spark.createDataFrame([], layout)
    n_docs = own.count() if blocks else 0
    with bounded_batches(spark):
        for block in range(blocks):
            rows = [r for r in items.where(F.pmod(F.xxhash64("text"), F.lit(blocks)) == block).collect() if r.text.encode().split()]
            if not rows:
                continue
            rows.sort(key=lambda r: (r.text, str(r.item)))
            hashes = [_hashes(r.text) for r in rows]
            terms = Terms(np.concatenate(hashes))
            known = stage(known_terms(own, terms, half), "known")
            df = document_frequency(known, len(terms.hashes))
            rare = df <= max(COMMON * n_docs, 1)
            if not rare.any():
                rare[:] = True
            poor = [i for i, h in enumerate(hashes) if 4 * rare[k := np.unique(terms.find(h)[1])].sum() < len(k)]
            place = np.where(rare, np.cumsum(rare) - 1, -1)
            here = _search(known, terms.hashes, place, n_docs, rows, hashes, Terms(terms.hashes[rare]), df[rare], Seeds(hashes), layout, half, cosine, held, copied, paraphrased)
            if poor:
                hashes = [hashes[i] for i in poor]
                all_ = Terms(np.concatenate(hashes))
                used = np.isin(terms.hashes, all_.hashes)
                place = np.where(used, np.cumsum(used) - 1, -1)
                here = here.unionByName(_search(known, terms.hashes, place, n_docs, [rows[i] for i in poor], hashes, all_, df[used], Seeds([]), layout, half, cosine, held, copied, paraphrased))
            found = found.unionByName(stage(here, "found", known))
    best = found.groupBy("id", "item").agg(F.max("share").alias("share"), F.max("cosine").alias("cosine"), F.max("answered").alias("answered"))
    return best.select(F.col("id").alias(id_col), F.col("item").alias("item_id" if item_col == id_col else item_col), "share", "cosine", "answered")


def op3(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return find_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text"))
