"""Secret scans with corpus-wide ownership.

Each text is scanned once for the base kinds and for bare high-entropy strings.  Candidates are
hashed and counted over the corpus by distinct repositories and owners: a value that several owners
share is a copied example; one that stays with a single owner and looks random is live-looking.
Bare strings become findings of their own (kind `bare`) if they are live-looking, or if the same
value is a live-looking base finding elsewhere.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from casemill.llm.arrays import runs, slices
from casemill.llm.shared import hot_join, stage

#: What a finding of each kind looks like.
ASSIGN = re.compile(r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.ASCII | re.IGNORECASE)
ASSIGN_WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
ACCESS = re.compile(r"AKIA[A-Z0-9]+", re.ASCII)
KINDS = ("assign", "access", "hex", "bare")
ASSIGN_LEAST, ACCESS_LEAST, HEX_LEAST, BARE_LEAST, BARE_BITS = 8, 16, 32, 20, 3.5

_HEX = np.zeros(256, bool)
_HEX[list(b"0123456789abcdef")] = True
_BARE = np.zeros(256, bool)
_BARE[list(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-")] = True


def entropy(value: str) -> float:
    """Bits a character."""
    return -sum(n / len(value) * math.log2(n / len(value)) for n in Counter(value).values())


def looks_random(value: str) -> bool:
    return len(value) >= BARE_LEAST and entropy(value) >= BARE_BITS and bool(re.search("[0-9]", value)) and bool(re.search("[a-z]", value)) and bool(re.search("[A-Z]", value))


def base_spans(text: str, hex_runs: list[tuple[int, int]]) -> list[tuple[int, int, int, int, int]]:
    """(start, kind, end, value start, value end) of the base findings, by start and kind; hex_runs: code points."""
    low = text.lower()
    out = []
    if any(w in low for w in ASSIGN_WORDS):
        out += [(m.start(), 0, m.end(), m.start(2), m.end(2)) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= ASSIGN_LEAST]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end(), m.start(), m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= ACCESS_LEAST]
    out += [(a, 2, b, a, b) for a, b in hex_runs]
    return sorted(out)


def _long_runs(data: np.ndarray, off: np.ndarray, of: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, start, end) of runs of at least so many bytes of a class that stay in one document."""
    lo, hi = runs(of[data])
    keep = hi - lo >= least
    lo, hi = lo[keep], hi[keep]
    cut = [(max(a, off[d]), min(b, off[d + 1]), d) for a, b in zip(lo, hi) for d in range(int(np.searchsorted(off, a, "right")) - 1, int(np.searchsorted(off, b, "left")))]
    cut = [x for x in cut if x[1] - x[0] >= least]
    return np.array([c[2] for c in cut], np.int64), np.array([c[0] for c in cut], np.int64), np.array([c[1] for c in cut], np.int64)


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        col = batch.column("text")
        ids = batch.column("id")
        for s in slices(col):
            found: dict[int, dict[str, list]] = {}
            for name, of, least in (("hex", _HEX, HEX_LEAST), ("bare", _BARE, BARE_LEAST)):
                for d, a, b in zip(*_long_runs(s.data, s.off, of, least)):
                    found.setdefault(int(d), {"hex": [], "bare": []})[name].append((a - s.off[d], b - s.off[d]))
            n = s.row1 - s.row0
            counts, digests, spans, values = np.zeros((3, n), np.int64), [], [], []
            for d in range(n):
                text = col[s.row0 + d].as_py() or ""
                raw = text.encode() if d in found else b""
                point = (lambda x, raw=raw: len(raw[:x].decode())) if len(raw) != len(text) else int
                has = found.get(d, {"hex": [], "bare": []})
                base = base_spans(text, [(point(a), point(b)) for a, b in has["hex"]])
                for x in base:
                    counts[x[1], d] += 1
                named = [f"{KINDS[k]}:{a}:{b}" for a, k, b, _, _ in base]
                digests.append(sha256(",".join(named).encode()).hexdigest())
                spans.append([{"start": a, "kind": k, "end": b} for a, k, b, _, _ in base])
                vals = [{"start": a, "kind": k, "end": b, "value": sha256(text[x:y].encode()).hexdigest()[:32], "random": entropy(text[x:y]) >= 3.0} for a, k, b, x, y in base]
                for a, b in has["bare"]:
                    a, b = point(a), point(b)
                    if not any(x[0] < b and a < x[2] for x in base):
                        v = text[a:b]
                        vals.append({"start": a, "kind": 3, "end": b, "value": sha256(v.encode()).hexdigest()[:32], "random": looks_random(v)})
                values.append(vals)
            span = pa.struct([("start", pa.int64()), ("kind", pa.int32()), ("end", pa.int64())])
            value = pa.struct([("start", pa.int64()), ("kind", pa.int32()), ("end", pa.int64()), ("value", pa.string()), ("random", pa.bool_())])
            cols = [batch.column(c).slice(s.row0, n) for c in ("row", "id", "repository", "owner")]
            yield pa.RecordBatch.from_arrays([*cols, *(pa.array(c) for c in counts), pa.array(digests, pa.string()), pa.array(spans, pa.list_(span)), pa.array(values, pa.list_(value))], ["row", "id", "repository", "owner", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "vals"])


def scan_secrets(docs: DataFrame, repository: list[str], owner: list[str], id_col: str = "doc_id", text_col: str = "text", many_owners: int = 2) -> DataFrame:
    """One row per row of docs: id, n_assign, n_access, n_hex, base_sha256, spans, n_live, n_example, n_added.

    spans lists base findings and added ones as kind:start:end in code points, end exclusive, by start,
    then kind.  n_live and n_example count the base findings whose value stays with one owner and looks
    random, and those that `many_owners` or more share.  Null texts are empty; null repositories and
    owners are one each.  Repeated rows are scanned each and count once in ownership.  An empty table
    gives an empty table.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    name = lambda cols: F.concat_ws("\x1f", *[F.coalesce(F.col(c).cast("string"), F.lit("\x1e")) for c in cols])
    # a number for each row, so that repeated ids stay apart; it is fixed once the scan is written
    own = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("id"), text.alias("text"), name(repository).alias("repository"), name(owner).alias("owner"))
    kind = dict(docs.dtypes)[id_col]
    layout = f"row long, id {kind}, repository string, owner string, n_assign long, n_access long, n_hex long, base_sha256 string, spans array<struct<start:long,kind:int,end:long>>, vals array<struct<start:long,kind:int,end:long,value:string,random:boolean>>"
    rows = stage(own.mapInArrow(_scan, layout), "secrets")
    each = rows.select("row", "repository", "owner", F.explode("vals").alias("v")).select("row", "repository", "owner", "v.*")
    # one row per value, repository and owner first: a value copied a million times is combined before it is sent
    once = each.groupBy("value", "owner", "repository").agg(F.max(F.col("kind") < 3).alias("named"), F.count("*").alias("n"))
    once = once.groupBy("value", "owner").agg(F.count("*").alias("repositories"), F.max("named").alias("named"), F.sum("n").alias("n"))
    shared = once.groupBy("value").agg(F.count("*").alias("owners"), F.sum("repositories").alias("repositories"), F.max("named").alias("named"), F.sum("n").alias("n"))
    judged = hot_join(each, stage(shared, "values"), "value", "n", row_bytes=96).withColumn("specific", F.col("owners") < many_owners)
    live = F.col("specific") & F.col("random")
    added = (F.col("kind") == 3) & F.col("specific") & (F.col("random") | F.col("named"))
    facts = judged.groupBy("row").agg(
        F.count_if((F.col("kind") < 3) & live).alias("n_live"),
        F.count_if((F.col("kind") < 3) & ~F.col("specific")).alias("n_example"),
        F.count_if(added).alias("n_added"),
        F.collect_list(F.when(added, F.struct("start", "kind", "end"))).alias("more"),
    )
    every = F.array_sort(F.concat("spans", F.coalesce("more", F.array().cast("array<struct<start:long,kind:int,end:long>>"))))
    kinds = F.array(*[F.lit(k) for k in KINDS])
    shown = F.array_join(F.transform(every, lambda x: F.concat_ws(":", F.element_at(kinds, x["kind"] + 1), x["start"].cast("string"), x["end"].cast("string"))), ",")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c)
    out = rows.drop("vals", "repository", "owner").join(facts, "row", "left")
    return out.select(F.col("id").alias(id_col), "n_assign", "n_access", "n_hex", "base_sha256", shown.alias("spans"), zero("n_live"), zero("n_example"), zero("n_added"))


def op7(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang", "source")
    return scan_secrets(docs, repository=["source", "lang"], owner=["source"])
