"""Hybrid retrieval for a batch of queries: exact cosine, BM25, rank fusion, evidence."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from casemill.functions.scalars import finite_vector, reciprocal_rank, valid_vector
from casemill.operators.corpus import IndexContract
from casemill.operators.postings import bm25_search, build_postings, write

#: Queries that go to a task at once, and of them those compared at once.
QUERY_BLOCK, COLUMNS = 10_000, 256
#: Terms of a batch of queries that are broadcast; more are joined by shuffle.
FEW_TERMS = 1_000_000
TOP, FUSED, STRONG = 10, 5, 3


def _ranked(scored: DataFrame, k: int, *order) -> DataFrame:
    by = Window.partitionBy("query_id").orderBy(*order)
    return scored.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= k)


def authorized_corpus(chunks: DataFrame, versions: DataFrame, certificates: DataFrame, receipts: DataFrame, sources: DataFrame, allowed: DataFrame, quarantined: DataFrame, contract: IndexContract = IndexContract()) -> DataFrame:
    """Chunks (chunk_id, doc_id, version, embedding …) that may be ranked.

    They belong to the active version (versions: doc_id, version, state, invalidated, text_sha256) of a
    ready, valid document; the version's certificate (doc_id, version, text_sha256, contract, model,
    dimensions) is of this contract and vouches for the text as it is; the document's source (sources:
    doc_id, state, result) was loaded and accepted; the document is allowed and not in pending quarantine;
    the chunk has a receipt (chunk_id, contract) of the contract and a vector of its width.
    """
    live = versions.where("state = 'LISTA' and not invalidated").select("doc_id", "version", "text_sha256")
    ours = certificates.where((F.col("contract") == contract.version) & (F.col("model") == contract.model) & (F.col("dimensions") == contract.width))
    sure = live.join(ours.select("doc_id", "version", "text_sha256"), ["doc_id", "version", "text_sha256"]).select("doc_id", "version")
    sure = sure.join(sources.where("state = 'COMPLETADO' and result = 'ACCEPTED'").select("doc_id"), "doc_id", "left_semi")
    sure = sure.join(allowed.select("doc_id").distinct(), "doc_id", "left_semi").join(quarantined.select("doc_id"), "doc_id", "left_anti")
    told = receipts.where(F.col("contract") == contract.version).select("chunk_id")
    x = chunks.where(valid_vector(F.col("embedding"), contract.width))
    return x.join(sure, ["doc_id", "version"], "left_semi").join(told, "chunk_id", "left_semi")


def _best(found: list[tuple[np.ndarray, ...]], k: int) -> tuple[np.ndarray, ...]:
    """Of (query, distance, id) the k first of each query, by distance and id."""
    q, d, i = (np.concatenate(x) for x in zip(*found))
    order = np.lexsort((i, d, q))
    q, d, i = q[order], d[order], i[order]
    keep = np.arange(len(q)) - np.searchsorted(q, q) < k
    return q[keep], d[keep], i[keep]


def vector_topk(queries: DataFrame, corpus: DataFrame, k: int = TOP) -> DataFrame:
    """(query_id, fragment_id, distance, rank): the k nearest by cosine, ties by id.

    Vectors that are null, zero, not finite, or of another length than the query's are left out, on either
    side.  A query with a column `scope` sees only rows whose array `scopes` holds it.  The queries go to
    every task in blocks of about QUERY_BLOCK, by hash of their id, however many there are, and are
    compared COLUMNS at a time; a task keeps k rows a query over all its rows, so k rows a query and task
    are sent on, not all pairs.
    """
    spark = corpus.sparkSession
    layout = f"query_id long, fragment_id {dict(corpus.dtypes)['fragment_id']}, distance double"
    scoped = "scope" in queries.columns
    v = F.col("embedding")
    corpus = corpus.where(finite_vector(v)).select("fragment_id", v.cast("array<double>").alias("embedding"), *(["scopes"] if scoped else []))
    queries = queries.where(finite_vector(v))
    rows = queries.limit(QUERY_BLOCK + 1).collect()
    blocks = 1 if len(rows) <= QUERY_BLOCK else -(-queries.count() // QUERY_BLOCK)
    found = spark.createDataFrame([], layout)
    for block in range(blocks):
        rows = rows if blocks == 1 else queries.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == block).collect()
        if not rows:
            continue
        rows.sort(key=lambda r: (len(r.embedding), r.query_id))
        names = np.array([r.query_id for r in rows], np.int64)
        groups = []  # queries of one length, a few at a time
        for a in range(0, len(rows), COLUMNS):
            for width in sorted({len(r.embedding) for r in rows[a : a + COLUMNS]}):
                own = [j for j in range(a, min(a + COLUMNS, len(rows))) if len(rows[j].embedding) == width]
                q = np.array([rows[j].embedding for j in own], float)
                groups.append((width, np.array(own), q / np.linalg.norm(q, axis=1, keepdims=True), [rows[j].scope if scoped else None for j in own]))
        shared = spark.sparkContext.broadcast((names, groups))

        def near(frames: Iterator[pd.DataFrame], shared=shared) -> Iterator[pd.DataFrame]:
            names, groups = shared.value
            best: tuple[np.ndarray, ...] | None = None
            for f in frames:
                if not len(f):
                    continue
                lengths = f["embedding"].map(len).to_numpy()
                new = [] if best is None else [best]
                for width, own, q, scopes in groups:
                    part = f[lengths == width]
                    if not len(part):
                        continue
                    x = np.stack(part["embedding"].to_numpy())
                    d = np.round(1 - (x / np.linalg.norm(x, axis=1, keepdims=True)) @ q.T, 9)
                    if scoped:
                        places = np.repeat(np.arange(len(part)), part["scopes"].map(len))
                        code, known = pd.factorize(np.concatenate(part["scopes"].to_numpy()))
                        sees = {s: np.isin(np.arange(len(part)), places[code == c]) for c, s in enumerate(known) if s in set(scopes)}
                        d[~np.stack([sees.get(s, np.zeros(len(part), bool)) for s in scopes], 1)] = np.inf
                    # what is not beyond the k-th distance can be among the first k
                    last = np.partition(d, min(k, len(d)) - 1, axis=0)[min(k, len(d)) - 1]
                    r, c = np.nonzero((d <= last) & np.isfinite(d))
                    ids = part["fragment_id"].to_numpy()
                    new.append((own[c], d[r, c], (ids.astype(str) if ids.dtype == object else ids)[r]))
                if new:
                    best = _best(new, k)
            if best is not None and len(best[0]):
                yield pd.DataFrame({"query_id": names[best[0]], "fragment_id": best[2], "distance": best[1]})

        found = found.unionByName(corpus.mapInPandas(near, layout))
    return _ranked(found, k, "distance", "fragment_id")


def corpus_stats(fragments: DataFrame, terms: DataFrame, scope: list[str] | None = None) -> DataFrame:
    """Number of fragments and their mean length, for each scope if there are some; fragments without terms count."""
    length = terms.groupBy("fragment_id").agg(F.sum("tf").alias("dl"))
    x = fragments.select("fragment_id", *(scope or [])).join(length, "fragment_id", "left")
    return x.groupBy(*(scope or [])).agg(F.count("*").alias("n"), F.avg(F.coalesce("dl", F.lit(0))).alias("avgdl"))


def bm25_topk(queries: DataFrame, fragments: DataFrame, terms: DataFrame, k: int = TOP) -> DataFrame:
    """(query_id, fragment_id, score, rank): BM25 (k1 1.2, b 0.75) over the given fragments only. queries: query_id, lexeme; repeated terms count once.

    With a column `scope` in queries and fragments, each query sees the fragments of its scope, and counts
    and means are the scope's.  Lengths and the postings of the queries' lexemes come from one reading of
    the terms: a posting carries its fragment's length, and those of other lexemes go no further.
    """
    scope = ["scope"] if "scope" in queries.columns else []
    q = queries.select("query_id", "lexeme", *scope).distinct()
    wanted = F.broadcast(q.select("lexeme").distinct().withColumn("asked", F.lit(True))) if q.count() <= FEW_TERMS else q.select("lexeme").distinct().withColumn("asked", F.lit(True))
    hit = F.struct("lexeme", "tf")
    own = terms.join(wanted, "lexeme", "left").groupBy("fragment_id").agg(F.sum("tf").alias("dl"), F.collect_list(F.when(F.col("asked"), hit)).alias("hits"))
    inside = fragments.select("fragment_id", *scope).join(own, "fragment_id", "left")
    stats = inside.groupBy(*scope).agg(F.count("*").alias("n"), F.avg(F.coalesce("dl", F.lit(0))).alias("avgdl"))
    hits = inside.select("fragment_id", *scope, "dl", F.explode("hits").alias("h")).select("fragment_id", *scope, "dl", "h.*")
    df = hits.groupBy(*scope, "lexeme").agg(F.count("*").alias("df"))
    x = hits.join(df, [*scope, "lexeme"]).join(F.broadcast(stats), scope or F.lit(True))  # stats: a row a scope
    idf = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    part = idf * F.col("tf") * 2.2 / (F.col("tf") + 1.2 * (0.25 + 0.75 * F.col("dl") / F.col("avgdl")))
    x = x.select("fragment_id", *scope, "lexeme", part.alias("part")).join(q, [*scope, "lexeme"])
    score = x.groupBy("query_id", "fragment_id").agg(F.round(F.sum("part"), 9).alias("score")).where("score > 0")
    return _ranked(score, k, F.desc("score"), "fragment_id")


def candidate_ids(vector: DataFrame, lexical: DataFrame) -> DataFrame:
    """(query_id, fragment_id) that either list holds, once each."""
    return vector.select("query_id", "fragment_id").join(lexical.select("query_id", "fragment_id"), ["query_id", "fragment_id"], "full")


def retrieve(queries: DataFrame, fragments: DataFrame, allowed: DataFrame, terms: DataFrame, path: str, allowed_now: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Hybrid retrieval of a batch: (evidence a query, fused fragments).

    queries: query_id, principal, embedding, lexemes.  fragments: fragment_id, doc_id, embedding, complete
    (of the authorised corpus).  allowed: principal, doc_id.  Access comes first: each query ranks and
    counts only what its principal may see.  Then the nearest and the best by BM25, a recheck of all
    candidates against `allowed_now` (the same as allowed without it), fusion, and the evidence.  A query
    with a candidate that may no longer be seen gets DENIED and no fragment.

    What several steps read, the access, the index, and each list, is written once under path.
    """
    now = allowed if allowed_now is None else allowed_now
    queries = write(queries, f"{path}/queries")
    asked = queries.select("principal").distinct()
    seen = fragments.select("fragment_id", "doc_id").join(allowed.join(asked, "principal", "left_semi"), "doc_id").select("fragment_id", F.col("principal").alias("scope"))
    index = build_postings(seen, terms, f"{path}/index")
    own = queries.withColumnRenamed("principal", "scope")
    near = vector_topk(own.select("query_id", "scope", "embedding"), fragments.select("fragment_id", "embedding").join(index.fragments.select("fragment_id", "scopes"), "fragment_id"))
    near = write(near, f"{path}/near")
    lexical = write(bm25_search(index, own.select("query_id", "scope", F.explode("lexemes").alias("lexeme")), path), f"{path}/lexical")
    places = candidate_ids(near, lexical).join(queries.select("query_id", "principal"), "query_id").join(fragments.select("fragment_id", "doc_id"), "fragment_id")
    there = places.join(now.select("principal", "doc_id", F.lit(True).alias("there")).distinct(), ["principal", "doc_id"], "left")
    lost = write(there.where("there is null").select("query_id").distinct(), f"{path}/lost")
    fused = write(rrf_fuse(near, lexical).join(lost, "query_id", "left_anti"), f"{path}/fused")
    evidence = classify_evidence(queries, near, lexical, fused, fragments.where("complete"))
    evidence = evidence.join(lost.withColumn("lost", F.lit(True)), "query_id", "left").select("query_id", F.when(F.col("lost"), "DENIED").otherwise(F.col("evidence")).alias("evidence"))
    return write(evidence, f"{path}/evidence"), fused


def final_fragments(fragments: DataFrame, chunks: DataFrame, versions: DataFrame) -> DataFrame:
    """Kept fragments (operation_id, fragment_id, usage …) with their text (chunks: fragment_id, version_id, content) and document (versions: version_id, doc_id)."""
    return fragments.join(chunks.select("fragment_id", "version_id", "content"), "fragment_id").join(versions.select("version_id", "doc_id"), "version_id")


def still_authorized(candidates: DataFrame, corpus: DataFrame) -> DataFrame:
    """(query_id, ok): all of a query's candidates are still in the corpus."""
    x = candidates.select("query_id", "fragment_id").distinct().join(corpus.select("fragment_id", F.lit(True).alias("there")), "fragment_id", "left")
    return x.groupBy("query_id").agg(F.min(F.coalesce("there", F.lit(False))).alias("ok"))


def rrf_fuse(vector: DataFrame, lexical: DataFrame, k: int = FUSED) -> DataFrame:
    """(query_id, fragment_id, vector_rank, bm25_rank, rrf, rank): reciprocal rank fusion of two ranked lists."""
    v = vector.select("query_id", "fragment_id", F.col("rank").alias("vector_rank"))
    b = lexical.select("query_id", "fragment_id", F.col("rank").alias("bm25_rank"))
    x = v.join(b, ["query_id", "fragment_id"], "full").withColumn("rrf", reciprocal_rank(F.col("vector_rank"), F.col("bm25_rank")))
    order = [F.desc("rrf"), F.least("vector_rank", "bm25_rank"), F.col("vector_rank").isNull(), "vector_rank", F.col("bm25_rank").isNull(), "bm25_rank", "fragment_id"]
    return _ranked(x, k, *order)


def classify_evidence(queries: DataFrame, vector: DataFrame, lexical: DataFrame, fused: DataFrame, complete: DataFrame) -> DataFrame:
    """(query_id, evidence): none found, sufficient if a fused fragment with a complete citation is among the first three of a list, else insufficient. complete: fragment_id."""
    any_ = candidate_ids(vector, lexical).select("query_id").distinct().withColumn("any", F.lit(True))
    strong = fused.where((F.col("vector_rank") <= STRONG) | (F.col("bm25_rank") <= STRONG)).join(complete.select("fragment_id"), "fragment_id", "left_semi").select("query_id").distinct().withColumn("strong", F.lit(True))
    x = queries.select("query_id").distinct().join(any_, "query_id", "left").join(strong, "query_id", "left")
    return x.select("query_id", F.when(F.col("any").isNull(), "SIN_EVIDENCIA").when(F.col("strong"), "EVIDENCIA_SUFICIENTE").otherwise("EVIDENCIA_INSUFICIENTE").alias("evidence"))


def context_blocks(fused: DataFrame, texts: DataFrame) -> DataFrame:
    """(query_id, context): the fused fragments, labelled E1, E2 … in rank order."""
    x = fused.join(texts.select("fragment_id", "content"), "fragment_id")
    rows = F.array_sort(F.collect_list(F.struct("rank", "content")))
    return x.groupBy("query_id").agg(F.array_join(F.transform(rows, lambda r: F.concat(F.lit("[E"), r["rank"].cast("string"), F.lit("]\n"), r["content"])), "\n\n").alias("context"))


def check_citations(answers: DataFrame, n_fragments: int = FUSED) -> DataFrame:
    """(answer_id, cited, valid): the markers [E…] of an answer in order of first use; valid if there is one and all are within the fragments."""
    marks = F.array_distinct(F.regexp_extract_all("text", F.lit(r"\[([^\[\]]*)\]"), F.lit(1)))
    known = F.array(*[F.lit(f"E{i}") for i in range(1, n_fragments + 1)])
    return answers.select("answer_id", F.array_join(marks, ",").alias("cited"), ((F.size(marks) > 0) & (F.size(F.array_except(marks, known)) == 0)).alias("valid"))


def fragment_usage(fused: DataFrame, evidence: DataFrame, cited: DataFrame) -> DataFrame:
    """fused with `usage`: REFERENCE where evidence is insufficient, EVIDENCE if cited, else CONTEXT. cited: query_id, rank."""
    c = cited.select("query_id", "rank").distinct().withColumn("c", F.lit(True))
    x = fused.join(evidence, "query_id").join(c, ["query_id", "rank"], "left")
    return x.withColumn("usage", F.when(F.col("evidence") == "EVIDENCIA_INSUFICIENTE", "REFERENCE").when(F.col("c"), "EVIDENCE").otherwise("CONTEXT")).drop("c")
