"""Substring dedup by fixed-block anchors: repeated runs of words, found from non-overlapping blocks.

Every document is cut into blocks of b = (window + 1) // 2 words, side by side; only those are indexed.
A window of `window` words holds one whole block of its own document wherever it starts, so of two
equal windows each holds a block that the other meets when rolling.

1. Index: the blocks' hashes as a filter with a checked size.
2. Probe: every rolling run of b words is looked up.  The hits and the blocks themselves are counted
   by hash; those met twice or more are anchors, kept as a second, smaller filter.
3. Extend: windows that hold an anchor are compared over their whole length, each with its neighbours
   in hash order; runs of windows that come twice or more are the maximal exact repeats.

Beyond the size limit blocks and rolling runs are exchanged by hash: anchors are the runs that meet a block.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from casemill.llm.arrays import Slice, Tokens, covered, slices, tokens, window_hash, words_window
from casemill.llm.repeats import all_runs, broadcast_filter, distinct_texts, expanded, filter_rows, hinted, repeated_places, told_runs
from casemill.llm.shared import BROADCAST_BYTES, small_or_join, stage


def _around(t: Tokens, hashes: np.ndarray, anchors: np.ndarray, window: int, block: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, word place, hash) of the windows that hold one of the anchors (first words of b-word runs)."""
    last = t.first[1:] - window  # a document's last window
    doc = t.doc[anchors]
    lo = np.maximum(anchors - (window - block), t.first[doc])
    hi = np.maximum(np.minimum(anchors, last[doc]) + 1, lo)
    at = np.flatnonzero(covered(len(hashes), lo, hi)) if len(hashes) else np.zeros(0, np.int64)
    doc = t.doc[at]
    keep = at <= last[doc]
    at, doc = at[keep], doc[keep]
    return doc, at - t.first[doc], window_hash(hashes, window)[at]


def repeated_words(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 35, limit: int = BROADCAST_BYTES) -> DataFrame:
    """(key, starts, ends): for each distinct text, runs of words covered by a window that starts elsewhere too; null runs: the whole text.

    key is the text's MD5.  Texts without repeats, or of fewer words than a window, have no row unless copied.
    """
    block = (window + 1) // 2
    texts, copied = distinct_texts(docs, id_col, text_col)

    def fixed(s: Slice, _: object) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        t = tokens(s)
        at, h = words_window(t, t.hashes(), block)
        place = at - t.first[t.doc[at]]
        keep = place % block == 0
        return t.doc[at[keep]], place[keep], h[keep]

    def rolling(s: Slice, _: object) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        t = tokens(s)
        at, h = words_window(t, t.hashes(), block)
        return t.doc[at], at - t.first[t.doc[at]], h

    anchors = None
    if (index := broadcast_filter(filter_rows(texts, fixed, 1), limit)) is not None:

        def probed(s: Slice, _: object) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            doc, place, h = rolling(s, None)
            hit = index.value.has(h)
            return doc[hit], place[hit], h[hit]

        anchors = broadcast_filter(filter_rows(texts, probed, 2), limit)
    if anchors is not None:

        def extended(s: Slice, _: object) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            t = tokens(s)
            hashes = t.hashes()
            at, h = words_window(t, hashes, block)
            return _around(t, hashes, at[anchors.value.has(h)], window, block)

    else:

        def exchanged(s: Slice, _: object) -> tuple[np.ndarray, ...]:
            doc, place, h = rolling(s, None)
            return doc, place, h, np.ones(len(h), np.int64), np.ones(len(h), bool), place % block == 0

        texts = hinted(texts, stage(repeated_places(texts, exchanged), "anchors"), "anchor", "inner", limit)

        def extended(s: Slice, hint: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            t = tokens(s)
            doc, lo, hi = told_runs(hint, "anchor")
            which, pos = expanded(lo, hi)
            return _around(t, t.hashes(), t.first[doc[which]] + pos, window, block)

    return all_runs([repeated_places(texts, extended)], copied, window - 1)


def dedup_words(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 35, limit: int = BROADCAST_BYTES, with_kept: bool = True) -> DataFrame:
    """One row per row of docs: id, n_words, n_removed, kept_sha256, kept (the words that stay, joined by one space), starts, ends.

    Words are runs of characters other than space and \\x09-\\x0D.  A word goes if a window of `window`
    words that covers it also starts elsewhere, the first copy included.  with_kept=False leaves `kept`
    null.  Null text counts as empty (no words, the digest of nothing).  Repeated rows and rows with
    equal or null ids are documents of their own.  Other columns are ignored.  An empty table gives an
    empty table.
    """
    found = repeated_words(docs, id_col, text_col, window, limit)
    text = F.coalesce(F.col(text_col), F.lit(""))
    own = docs.select(F.col(id_col).alias("id"), text.alias("text"), F.unhex(F.md5(text)).alias("key"))
    size = found.agg(F.sum(F.lit(64) + 8 * F.coalesce(F.size("starts"), F.lit(0)))).first()[0] or 0
    own = small_or_join(own, found.withColumn("hit", F.lit(True)), "key", "left", 1, size, limit)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, hit, starts, ends = (batch.column(c) for c in ("text", "hit", "starts", "ends"))
            n, gone, kept, a, b = [], [], [], [], []
            for i in range(len(texts)):
                words = texts[i].as_py().encode().split()  # bytes split at just these six characters
                lo, hi = [], []
                if hit[i].as_py() and len(words) >= window:
                    for x, y in sorted(zip(starts[i].as_py(), ends[i].as_py())) if starts[i].is_valid else [(0, len(words))]:
                        if lo and x <= hi[-1]:
                            hi[-1] = max(hi[-1], y)
                        else:
                            lo.append(x)
                            hi.append(y)
                n.append(len(words))
                gone.append(sum(hi) - sum(lo))
                for x, y in zip(reversed(lo), reversed(hi)):
                    del words[x:y]
                kept.append(b" ".join(words))
                a.append(lo)
                b.append(hi)
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array([sha256(k).hexdigest() for k in kept], pa.string()), pa.array([k.decode() if with_kept else None for k in kept], pa.string()), pa.array(a, pa.list_(pa.int32())), pa.array(b, pa.list_(pa.int32()))], ["id", "n_words", "n_removed", "kept_sha256", "kept", "starts", "ends"])

    kind = dict(docs.dtypes)[id_col]
    out = own.mapInArrow(cut, f"id {kind}, n_words long, n_removed long, kept_sha256 string, kept string, starts array<int>, ends array<int>")
    return out.withColumnRenamed("id", id_col)


def op9(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return dedup_words(docs, with_kept=False).select("doc_id", "n_words", "n_removed", "kept_sha256")


OP9_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
places AS (SELECT doc_id, w, unnest(generate_series(1, len(w) - 34)) AS i FROM d WHERE len(w) >= 35),
windows AS (SELECT doc_id, i, md5(array_to_string(w[i : i + 34], ' ')) AS k FROM places),
twice AS (SELECT k FROM windows GROUP BY k HAVING count(*) > 1),
gone AS (SELECT DISTINCT doc_id, unnest(generate_series(i, i + 34)) AS p FROM windows SEMI JOIN twice USING (k)),
words AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS p FROM d),
kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY p) AS t FROM words ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id),
n AS (SELECT doc_id, count(*) AS n FROM gone GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n, 0) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256 FROM d LEFT JOIN kept USING (doc_id) LEFT JOIN n USING (doc_id)
"""
