"""Access, chunks, terms, retrieval: queries over documents, embeddings, benchmark and conversations."""

from __future__ import annotations

from pyspark.sql import functions as F

from casemill.functions import scalars
from casemill.functions.ids import text_sha256
from casemill.operators import access, corpus, nearest, postings, reports, retrieval, spans, table_functions
from casemill.plans.fixtures import table, work_dir
from casemill.plans.registry import query

_FAMILY = "CASE lang WHEN 'en' THEN 'CONTRATOS_DOCUMENTOS' WHEN 'es' THEN 'LITIGIOS' WHEN 'fr' THEN 'CUMPLIMIENTO' ELSE 'AUDITORIA_INTERNA' END"
_PRINCIPALS = [("ana", "legal"), ("ana", "audit"), ("luis", "compliance"), ("eva", "guest")]
_GRANTS = [("legal", "CONTRATOS_DOCUMENTOS"), ("legal", "LITIGIOS"), ("compliance", "CUMPLIMIENTO"), ("audit", "AUDITORIA_INTERNA")]
_RULES = "SELECT CASE doc_id % 3 WHEN 0 THEN 'ana' WHEN 1 THEN 'compliance' ELSE 'eva' END AS subject, doc_id, CASE WHEN doc_id % 2 = 0 THEN 'DENY' ELSE 'ALLOW' END AS effect, doc_id % 11 = 0 AS revoked FROM {documents} WHERE doc_id % 7 < 3"


def _rules(spark, d):
    docs = table(spark, d, "documents")
    return {
        "docs": docs.select("doc_id", F.expr(_FAMILY).alias("family")), "principals": spark.createDataFrame([(p,) for p in sorted({p for p, _ in _PRINCIPALS})], "principal string"),
        "roles": spark.createDataFrame(_PRINCIPALS, "principal string, role string"), "grants": spark.createDataFrame(_GRANTS, "role string, family string"), "exceptions": spark.sql(_RULES, documents=docs),
    }


_values = lambda rows: "(VALUES " + ", ".join("(" + ", ".join(f"'{x}'" for x in r) + ")" for r in rows) + ")"
_ACCESS = f"""roles AS (SELECT * FROM {_values(_PRINCIPALS)} v(principal, role)), grants AS (SELECT * FROM {_values(_GRANTS)} v(role, family)), rules AS ({_RULES.format(documents='documents')}),
subjects AS (SELECT principal, principal AS subject FROM roles UNION SELECT principal, role FROM roles),
decided AS (SELECT p.principal, doc_id, CASE WHEN EXISTS (SELECT 1 FROM rules r JOIN subjects s USING (subject) WHERE r.doc_id = d.doc_id AND s.principal = p.principal AND effect = 'DENY' AND NOT revoked) THEN 'EXPLICIT_DENY'
 WHEN EXISTS (SELECT 1 FROM rules r JOIN subjects s USING (subject) WHERE r.doc_id = d.doc_id AND s.principal = p.principal AND NOT revoked) OR EXISTS (SELECT 1 FROM roles o JOIN grants g USING (role) WHERE o.principal = p.principal AND g.family = d.family) THEN 'PERMIT' ELSE 'DEFAULT_DENY' END AS decision
 FROM (SELECT doc_id, {_FAMILY} AS family FROM documents) d CROSS JOIN (SELECT DISTINCT principal FROM roles) p)"""


@query("P14_document_decisions", f"WITH {_ACCESS} SELECT * FROM decided")
def _decisions(spark, d):
    return access.document_decision(**_rules(spark, d))


@query("P13_authorized_documents", f"WITH {_ACCESS} SELECT principal, doc_id FROM decided WHERE decision = 'PERMIT'")
def _authorized(spark, d):
    return access.authorized_documents(**_rules(spark, d))


@query("R35_exception_upsert", f"""
WITH x AS (SELECT *, doc_id AS rule_id, 1 AS moment, CAST(NULL AS INT) AS revoked_at FROM ({_RULES.format(documents='documents')}) UNION ALL SELECT subject, doc_id, 'DENY', false, doc_id + 1000000, 2, NULL FROM ({_RULES.format(documents='documents')}) WHERE doc_id % 5 = 0)
SELECT subject, doc_id, effect, moment, CASE WHEN lead(moment) OVER w IS NOT NULL THEN coalesce(revoked_at, lead(moment) OVER w) ELSE revoked_at END AS revoked_at FROM x WINDOW w AS (PARTITION BY subject, doc_id ORDER BY moment, rule_id)""")
def _exceptions(spark, d):
    old = spark.sql(_RULES, documents=table(spark, d, "documents")).select("subject", "doc_id", "effect", F.col("doc_id").alias("rule_id"), F.lit(1).alias("at"), F.lit(None).cast("int").alias("revoked_at"))
    new = old.where("doc_id % 5 = 0").select("subject", "doc_id", F.lit("DENY").alias("effect"), (F.col("doc_id") + 1_000_000).alias("rule_id"), F.lit(2).alias("at"), F.lit(None).cast("int").alias("revoked_at"))
    return access.upsert_exceptions(old, new).select("subject", "doc_id", "effect", F.col("at").alias("moment"), "revoked_at")


_W = "list_filter(regexp_split_to_array(text, '\\s+'), lambda w: w <> '')"


@query("R18_fixed_chunks", f"""
WITH w AS (SELECT doc_id, {_W} AS w FROM documents), o AS (SELECT doc_id, w, unnest(generate_series(0, CASE WHEN len(w) <= 128 THEN 0 ELSE CAST(ceil((len(w) - 16) / 112.0) AS INT) - 1 END)) AS ordinal FROM w WHERE len(w) > 0)
SELECT doc_id, CAST(ordinal AS INT) AS ordinal, len(w[ordinal * 112 + 1 : ordinal * 112 + 128]) AS token_count, sha256(array_to_string(w[ordinal * 112 + 1 : ordinal * 112 + 128], ' ')) AS digest FROM o""")
def _fixed(spark, d):
    x = corpus.chunk_fixed(table(spark, d, "documents"), 128, 16)
    return x.select("doc_id", "ordinal", "token_count", text_sha256(F.col("content")).alias("digest"))


#: Texts with headings, indented and not, clauses, and blank lines.
_STRUCTURED = "SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN replace(text, '. ', '.' || chr(10) || '  Sección ') WHEN 1 THEN replace(text, '. ', '.' || chr(10) || 'Cláusula ') WHEN 2 THEN replace(text, '. ', '.' || chr(10) || chr(10)) ELSE text END AS text FROM {documents}"
_OPENS = "regexp_matches(tok, '(?i)^(secci[oó]n|art[ií]culo|cl[aá]usula)([^\\p{L}\\p{N}_]|$)')"


def _chunks_sql(size, overlap):
    pick = lambda a: f"CASE WHEN {a} + {size} >= n THEN n ELSE coalesce(" + ", ".join(f"list_max(list_filter({m}, lambda e: e >= least({a} + {size}, {a} + {overlap + 1}) AND e <= {a} + {size}))" for m in ("m1", "m2", "m3")) + f", {a} + {size}) END"
    return f"""src AS ({_STRUCTURED.format(documents='documents')}),
words AS (SELECT * FROM (SELECT doc_id, text, regexp_extract_all(text, '\\S+') AS toks, regexp_split_to_array(text, '\\S+') AS gaps FROM src) WHERE len(toks) > 0),
one AS (SELECT doc_id, text, e, toks[e + 1] AS tok, gaps[e + 1] AS gap FROM (SELECT *, unnest(generate_series(0, len(toks) - 1)) AS e FROM words)),
pos AS (SELECT *, CAST(sum(length(gap)) OVER (PARTITION BY doc_id ORDER BY e) + coalesce(sum(length(tok)) OVER (PARTITION BY doc_id ORDER BY e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS pos FROM one),
marks AS (SELECT doc_id, max(e) + 1 AS n, list(e) FILTER (e > 0 AND contains(gap, chr(10)) AND {_OPENS}) AS m1, list(e) FILTER (e > 0 AND contains(gap, chr(10) || chr(10))) AS m2, list(e + 1) FILTER (right(tok, 1) IN ('.', '?', '!')) AS m3 FROM pos GROUP BY doc_id),
c(doc_id, ordinal, a, b) AS (SELECT doc_id, 0, CAST(0 AS BIGINT), CAST({pick('0')} AS BIGINT) FROM marks
  UNION ALL SELECT doc_id, ordinal + 1, s, CAST({pick('s')} AS BIGINT) FROM (SELECT c.doc_id, ordinal, greatest(a + 1, b - {overlap}) AS s, marks.* EXCLUDE (doc_id) FROM c JOIN marks ON marks.doc_id = c.doc_id WHERE b < n)),
heads AS (SELECT doc_id, pos, trim(regexp_extract(substr(text, pos + 1), '^[^\\r\\n]*')) AS label FROM pos WHERE (e = 0 AND gap = '' OR right(gap, 1) = chr(10)) AND {_OPENS}),
chunks AS (SELECT c.doc_id, c.ordinal, CAST(b - a AS INT) AS token_count, x.pos AS lo, y.pos + length(y.tok) AS hi, substr(x.text, x.pos + 1, y.pos + length(y.tok) - x.pos) AS content FROM c JOIN pos x ON x.doc_id = c.doc_id AND x.e = a JOIN pos y ON y.doc_id = c.doc_id AND y.e = b - 1),
named AS (SELECT k.*, coalesce((SELECT label FROM heads h WHERE h.doc_id = k.doc_id AND pos >= lo AND pos < hi ORDER BY pos LIMIT 1), (SELECT label FROM heads h WHERE h.doc_id = k.doc_id AND pos < lo ORDER BY pos DESC LIMIT 1)) AS label FROM chunks k)"""


def _structured(spark, d):
    return spark.sql(_STRUCTURED, documents=table(spark, d, "documents"))


@query("R19_structural_chunks", f"WITH RECURSIVE {_chunks_sql(96, 12)} SELECT doc_id, ordinal, token_count, CASE WHEN NOT starts_with(lower(label), 'cláusula') THEN label END AS section, CASE WHEN starts_with(lower(label), 'cláusula') THEN label END AS clause, sha256(content) AS digest FROM named")
def _structural(spark, d):
    return corpus.chunk_structural(_structured(spark, d), 96, 12).select("doc_id", "ordinal", "token_count", "section", "clause", text_sha256(F.col("content")).alias("digest"))


def _by_sql(spark, name, docs, call):
    """A table function of the session's SQL over docs."""
    table_functions.register(spark, dict(docs.dtypes)["doc_id"])
    docs.createOrReplaceTempView(name)
    return spark.sql(f"SELECT * FROM {call}")


@query("R18_fixed_chunks_sql", f"""
WITH w AS (SELECT doc_id, {_W} AS w FROM documents), o AS (SELECT doc_id, w, unnest(generate_series(0, CASE WHEN len(w) <= 128 THEN 0 ELSE CAST(ceil((len(w) - 16) / 112.0) AS INT) - 1 END)) AS ordinal FROM w WHERE len(w) > 0)
SELECT doc_id, CAST(ordinal AS INT) AS ordinal, CAST(ordinal * 112 AS INT) AS first, len(w[ordinal * 112 + 1 : ordinal * 112 + 128]) AS token_count FROM o""")
def _fixed_by_sql(spark, d):
    return _by_sql(spark, "fixed_docs", table(spark, d, "documents"), "chunk_fixed(TABLE(fixed_docs), 128, 16)").drop("content")


@query("R19_structural_chunks_sql", f"WITH RECURSIVE {_chunks_sql(96, 12)} SELECT doc_id, ordinal, token_count, CAST(lo AS INT) AS start, CAST(hi AS INT) AS \"end\", label FROM named")
def _structural_by_sql(spark, d):
    x = _by_sql(spark, "structured_docs", _structured(spark, d), "chunk_structural(TABLE(structured_docs), 96, 12)")
    return x.select("doc_id", "ordinal", "token_count", "start", "end", F.coalesce("section", "clause").alias("label"))


@query("F15_token_offsets_sql", f"WITH RECURSIVE {_chunks_sql(96, 12)} SELECT doc_id, CAST(e AS INT) AS ordinal, CAST(pos AS INT) AS start, CAST(pos + length(tok) AS INT) AS \"end\" FROM pos")
def _offsets_by_sql(spark, d):
    return _by_sql(spark, "offset_docs", _structured(spark, d), "token_offsets(TABLE(offset_docs))")


@query("F15_token_offsets", f"WITH RECURSIVE {_chunks_sql(96, 12)} SELECT doc_id, count(*) AS tokens, sha256(string_agg(pos || '-' || (pos + length(tok)), ',' ORDER BY e)) AS digest FROM pos GROUP BY doc_id")
def _offsets(spark, d):
    x = corpus.with_token_offsets(_structured(spark, d)).where(F.size("offsets") > 0)
    shown = F.array_join(F.transform("offsets", lambda o: F.concat(o["start"].cast("string"), F.lit("-"), o["end"].cast("string"))), ",")
    return x.select("doc_id", F.size("offsets").cast("long").alias("tokens"), text_sha256(shown).alias("digest"))


@query("F16_headings", f"WITH RECURSIVE {_chunks_sql(96, 12)} SELECT doc_id, CAST(pos AS INT) AS start, CASE WHEN NOT starts_with(lower(label), 'cláusula') THEN label END AS section, CASE WHEN starts_with(lower(label), 'cláusula') THEN label END AS clause FROM heads")
def _headings(spark, d):
    return corpus.structural_metadata(_structured(spark, d))


_UUID = "substr(h,1,8)||'-'||substr(h,9,4)||'-5'||substr(h,14,3)||'-'||substr('89ab', 1 + (instr('0123456789abcdef', substr(h,17,1)) - 1) % 4, 1)||substr(h,18,3)||'-'||substr(h,21,12)"
#: Of a third of the chunks the vector is missing, of others it is too short.
_VECTOR = "CASE WHEN (vec_id + ordinal) % 3 = 0 THEN NULL WHEN (vec_id + ordinal) % 7 = 1 THEN slice(embedding, 1, 10) ELSE embedding END"


def _structured_index(spark, d):
    docs = _structured(spark, d).withColumn("version_id", F.concat(F.lit("V-"), F.col("doc_id")))
    at = work_dir(spark, "index")
    places = docs.select("doc_id", F.explode(F.sequence(F.lit(0), F.floor(F.length("text") / 1000).cast("int"))).alias("ordinal"))
    vectors = table(spark, d, "embeddings").join(places, F.col("vec_id") == F.col("doc_id")).select("doc_id", "ordinal", F.expr(_VECTOR).alias("embedding"))
    n = F.length("text")
    pages = docs.where(n > 0).select("doc_id", n.alias("n"), F.explode(F.sequence(F.lit(0), F.ceil(n / 1000).cast("int") - 1)).alias("k"))
    pages = pages.select("doc_id", (F.col("k") + 1).alias("page"), (F.col("k") * 1000).alias("start"), F.least(F.col("k") * 1000 + 1000, F.col("n")).alias("end"))
    return corpus.build_index(docs, vectors, at, corpus.IndexContract(), pages)


_INDEX = f"""{_chunks_sql(512, 50)},
ready AS (SELECT doc_id, ordinal, token_count, content, CAST(floor(lo / 1000.0) AS INT) + 1 AS page_start, CAST(floor((hi - 1) / 1000.0) AS INT) + 1 AS page_end, doc_id IN (SELECT vec_id FROM embeddings) AND ordinal <= floor((SELECT length(text) FROM src WHERE src.doc_id = chunks.doc_id) / 1000.0) AND (doc_id + ordinal) % 3 <> 0 AND (doc_id + ordinal) % 7 <> 1 AS embedded,
  sha1(unhex('6ba7b8119dad11d180b400c04fd430c8') || encode('{corpus.CHUNK_NAME}:' || lower('V-' || doc_id) || ':' || ordinal)) AS h, regexp_extract_all(replace(lower(content), 'ß', 'ss'), '[\\p{{L}}\\p{{N}}]+') AS lex FROM chunks)"""


@query("R20_index_build", f"WITH RECURSIVE {_INDEX} SELECT {_UUID} AS chunk_id, 'V-' || doc_id AS version_id, ordinal, token_count, page_start, page_end, embedded, sha256(content) AS digest, 'index-v1' AS contract, len(list_distinct(lex)) AS lexical_terms, len(lex) AS length FROM ready")
def _index_build(spark, d):
    index = _structured_index(spark, d)
    n = index.terms.groupBy("chunk_id").agg(F.sum("tf").alias("length"))
    x = index.chunks.drop("version_id").join(index.receipts, "chunk_id").join(n, "chunk_id", "left")
    return x.select("chunk_id", "version_id", "ordinal", "token_count", "page_start", "page_end", "embedded", text_sha256(F.col("content")).alias("digest"), "contract", "lexical_terms", F.coalesce("length", F.lit(0)).alias("length"))


_LEX = "regexp_extract_all(replace(lower(text), 'ß', 'ss'), '[\\p{L}\\p{N}]+')"


@query("F14_lexemes", f"SELECT doc_id, len({_LEX}) AS n, sha256(array_to_string({_LEX}, ' ')) AS digest FROM documents")
def _lexemes(spark, d):
    x = table(spark, d, "documents").select("doc_id", scalars.lexemes(F.col("text")).alias("l"))
    return x.select("doc_id", F.size("l").alias("n"), text_sha256(F.array_join("l", " ")).alias("digest"))


def _terms(spark, d):
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("fragment_id"), F.col("text").alias("content"))
    return corpus.term_index(docs, "fragment_id")


_T = f"t AS (SELECT fragment_id, lexeme, count(*) AS tf FROM (SELECT doc_id AS fragment_id, unnest({_LEX}) AS lexeme FROM documents) GROUP BY ALL)"


@query("A15_term_index", f"WITH {_T} SELECT fragment_id, count(*) AS lexemes, CAST(sum(tf) AS BIGINT) AS length, max(tf) AS most FROM t GROUP BY fragment_id")
def _index(spark, d):
    return _terms(spark, d).groupBy("fragment_id").agg(F.count("*").alias("lexemes"), F.sum("tf").alias("length"), F.max("tf").alias("most"))


_INSIDE = "f AS (SELECT doc_id AS fragment_id FROM documents WHERE lang <> 'de')"
_BM = f"""{_T}, {_INSIDE}, i AS (SELECT t.* FROM t JOIN f USING (fragment_id)), l AS (SELECT fragment_id, sum(tf) AS dl FROM i GROUP BY 1), s AS (SELECT count(*) AS n, avg(coalesce(dl, 0)) AS avgdl FROM f LEFT JOIN l USING (fragment_id)),
q AS (SELECT DISTINCT item_id AS query_id, unnest({_LEX}) AS lexeme FROM benchmark), df AS (SELECT lexeme, count(*) AS df FROM i GROUP BY 1),
sc AS (SELECT query_id, fragment_id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl))), 9) AS score FROM i JOIN q USING (lexeme) JOIN df USING (lexeme) JOIN l USING (fragment_id) CROSS JOIN s GROUP BY ALL),
b AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, fragment_id) AS rank FROM sc WHERE score > 0 QUALIFY rank <= 10)"""


def _lexical(spark, d):
    """The ten best of each item by a written index; the list is written too, for those that read it twice."""
    inside = table(spark, d, "documents").where("lang <> 'de'").select(F.col("doc_id").alias("fragment_id"))
    q = table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), F.explode(scalars.lexemes(F.col("text"))).alias("lexeme"))
    at = work_dir(spark, "bm25")
    index = postings.build_postings(inside, postings.write(_terms(spark, d), f"{at}/terms"), f"{at}/index")
    return postings.write(postings.bm25_search(index, q, at), f"{at}/found")


@query("T02_bm25_top10", f"WITH {_BM} SELECT query_id, fragment_id, rank, round(score, 6) AS score FROM b")
def _bm25(spark, d):
    return _lexical(spark, d).select("query_id", "fragment_id", "rank", F.round("score", 6).alias("score"))


@query("A16_corpus_statistics", f"WITH {_BM} SELECT n, round(avgdl, 6) AS avgdl FROM s")
def _stats(spark, d):
    inside = table(spark, d, "documents").where("lang <> 'de'").select(F.col("doc_id").alias("fragment_id"))
    return retrieval.corpus_stats(inside, _terms(spark, d).join(inside, "fragment_id", "left_semi")).select("n", F.round("avgdl", 6).alias("avgdl"))


_VEC = """v AS (SELECT q.vec_id AS query_id, e.vec_id AS fragment_id, round(1 - list_cosine_similarity(CAST(q.embedding AS DOUBLE[]), CAST(e.embedding AS DOUBLE[])), 9) AS distance FROM embeddings q CROSS JOIN embeddings e WHERE q.vec_id % 50 = 0 AND e.label % 4 <> 3),
vk AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, fragment_id) AS rank FROM v QUALIFY rank <= 10)"""


def _nearest(spark, d):
    e = table(spark, d, "embeddings")
    q = e.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    return retrieval.vector_topk(q, e.where("label % 4 <> 3").select(F.col("vec_id").alias("fragment_id"), "embedding"))


@query("T01_vector_top10", f"WITH {_VEC} SELECT query_id, fragment_id, rank, round(distance, 6) AS distance FROM vk")
def _vectors(spark, d):
    return _nearest(spark, d).select("query_id", "fragment_id", "rank", F.round("distance", 6).alias("distance"))


@query("J12_clustered_nearest", f"WITH {_VEC} SELECT query_id, fragment_id, rank, round(distance, 6) AS distance FROM vk")
def _clustered(spark, d):
    e, at = table(spark, d, "embeddings"), work_dir(spark, "clusters")
    clusters = nearest.cluster_vectors(e.where("label % 4 <> 3").select(F.col("vec_id").alias("fragment_id"), "embedding"), at)
    found, _ = nearest.nearest(e.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), "embedding"), clusters, at)
    return found.select("query_id", "fragment_id", "rank", F.round("distance", 6).alias("distance"))


@query("F17_cosine_distance", "SELECT vec_id, round(1 - list_cosine_similarity(CAST(embedding AS DOUBLE[]), (SELECT CAST(embedding AS DOUBLE[]) FROM embeddings WHERE vec_id = 0)), 6) AS distance FROM embeddings")
def _cosine(spark, d):
    e = table(spark, d, "embeddings")
    one = e.where("vec_id = 0").select(F.col("embedding").alias("q"))
    return e.crossJoin(F.broadcast(one)).select("vec_id", F.round(scalars.cosine_distance(F.col("embedding"), F.col("q")), 6).alias("distance"))  # one row


@query("P19_valid_vectors", """
WITH v AS (SELECT vec_id, CASE WHEN label % 4 = 0 THEN embedding[1:10] WHEN label % 4 = 1 THEN list_transform(embedding, lambda x: x * 0) WHEN label % 4 = 2 AND vec_id % 2 = 0 THEN NULL ELSE embedding END AS v FROM embeddings)
SELECT vec_id, coalesce(len(v) = 64 AND list_sum(list_transform(v, lambda x: abs(x))) > 0, false) AS ok FROM v""")
def _guard(spark, d):
    k = F.col("label") % 4
    v = F.when(k == 0, F.slice("embedding", 1, 10)).when(k == 1, F.transform("embedding", lambda x: x * 0)).when(~((k == 2) & (F.col("vec_id") % 2 == 0)) | F.col("label").isNull(), F.col("embedding"))
    return table(spark, d, "embeddings").select("vec_id", scalars.valid_vector(v, 64).alias("ok"))


#: Both lists for the benchmark's items: BM25 over their words, cosine over the vectors of their numbers; fragments are documents.
_FUSE = f"""{_BM}, v AS (SELECT q.vec_id AS query_id, e.vec_id AS fragment_id, round(1 - list_cosine_similarity(CAST(q.embedding AS DOUBLE[]), CAST(e.embedding AS DOUBLE[])), 9) AS distance FROM embeddings q JOIN benchmark ON item_id = q.vec_id CROSS JOIN embeddings e JOIN f ON f.fragment_id = e.vec_id),
vk AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, fragment_id) AS rank FROM v QUALIFY rank <= 10),
fz AS (SELECT coalesce(a.query_id, b.query_id) AS query_id, coalesce(a.fragment_id, b.fragment_id) AS fragment_id, a.rank AS vr, b.rank AS br, coalesce(1.0 / (60 + a.rank), 0) + coalesce(1.0 / (60 + b.rank), 0) AS rrf FROM vk a FULL JOIN b ON a.query_id = b.query_id AND a.fragment_id = b.fragment_id),
fu AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rrf DESC, least(vr, br), vr IS NULL, vr, br IS NULL, br, fragment_id) AS rank FROM fz QUALIFY rank <= 5),
whole AS (SELECT doc_id AS fragment_id FROM documents WHERE source IS NOT NULL AND lang IS NOT NULL AND n_chars >= 400 AND trim(text) <> ''),
ev AS (SELECT item_id AS query_id, CASE WHEN item_id NOT IN (SELECT query_id FROM fz) THEN 'SIN_EVIDENCIA' WHEN item_id IN (SELECT query_id FROM fu WHERE (vr <= 3 OR br <= 3) AND fragment_id IN (SELECT fragment_id FROM whole)) THEN 'EVIDENCIA_SUFICIENTE' ELSE 'EVIDENCIA_INSUFICIENTE' END AS evidence FROM benchmark)"""


def _item_vectors(spark, d):
    return table(spark, d, "embeddings").join(table(spark, d, "benchmark").select(F.col("item_id").alias("vec_id")), "vec_id").select(F.col("vec_id").alias("query_id"), "embedding")


def _whole(docs):
    day = F.when(F.col("n_chars") >= 400, F.lit("2024-01-01"))
    text = F.when(F.length(F.trim("text")) > 0, F.col("text"))
    return reports.citation_complete(F.col("doc_id"), F.col("source"), F.col("lang"), day, text)


def _fused(spark, d):
    e, docs = table(spark, d, "embeddings"), table(spark, d, "documents")
    inside = e.join(docs.where("lang <> 'de'").select(F.col("doc_id").alias("vec_id")), "vec_id", "left_semi").select(F.col("vec_id").alias("fragment_id"), "embedding")
    v, lx = postings.write(retrieval.vector_topk(_item_vectors(spark, d), inside), work_dir(spark, "near")), _lexical(spark, d)
    return v, lx, postings.write(retrieval.rrf_fuse(v, lx), work_dir(spark, "fused"))


@query("T03_rank_fusion", f"WITH {_FUSE} SELECT query_id, fragment_id, vr AS vector_rank, br AS bm25_rank, rank FROM fu")
def _fusion(spark, d):
    return _fused(spark, d)[2].select("query_id", "fragment_id", "vector_rank", "bm25_rank", "rank")


def _classified(spark, d):
    v, lx, fused = _fused(spark, d)
    q = table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"))
    docs = table(spark, d, "documents")
    return retrieval.classify_evidence(q, v, lx, fused, docs.where(_whole(docs)).select(F.col("doc_id").alias("fragment_id"))), fused


@query("R24_evidence", f"WITH {_FUSE} SELECT * FROM ev")
def _evidence(spark, d):
    return _classified(spark, d)[0]


@query("R25_fragment_usage", f"WITH {_FUSE} SELECT query_id, fragment_id, CASE WHEN evidence = 'EVIDENCIA_INSUFICIENTE' THEN 'REFERENCE' WHEN rank IN (1, 3) THEN 'EVIDENCE' ELSE 'CONTEXT' END AS usage FROM fu JOIN ev USING (query_id)")
def _usage(spark, d):
    ev, fused = _classified(spark, d)
    return retrieval.fragment_usage(fused, ev, fused.where("rank in (1, 3)").select("query_id", "rank")).select("query_id", "fragment_id", "usage")


@query("O02_candidate_ids", f"WITH {_FUSE} SELECT query_id, fragment_id FROM vk UNION SELECT query_id, fragment_id FROM b")
def _candidates(spark, d):
    v, lx, _ = _fused(spark, d)
    return postings.write(retrieval.candidate_ids(v, lx), work_dir(spark, "candidates"))


@query("P16_still_authorized", f"WITH {_FUSE} SELECT query_id, bool_and(fragment_id IN (SELECT doc_id FROM documents WHERE lang NOT IN ('de', 'fr'))) AS ok FROM (SELECT query_id, fragment_id FROM vk UNION SELECT query_id, fragment_id FROM b) GROUP BY query_id")
def _recheck(spark, d):
    now = table(spark, d, "documents").where("lang not in ('de', 'fr')").select(F.col("doc_id").alias("fragment_id"))
    return retrieval.still_authorized(_candidates(spark, d), now)


@query("F31_context_blocks", f"WITH {_FUSE} SELECT query_id, sha256(string_agg('[E' || rank || ']' || chr(10) || text, chr(10) || chr(10) ORDER BY rank)) AS digest FROM fu JOIN documents ON doc_id = fragment_id GROUP BY query_id")
def _blocks(spark, d):
    texts = table(spark, d, "documents").select(F.col("doc_id").alias("fragment_id"), F.col("text").alias("content"))
    return retrieval.context_blocks(_fused(spark, d)[2], texts).select("query_id", text_sha256(F.col("context")).alias("digest"))


@query("J17_cited_fragments", f"WITH {_FUSE} SELECT query_id AS operation_id, fragment_id, rank, doc_id, sha256(text) AS digest FROM fu JOIN documents ON doc_id = fragment_id")
def _cited(spark, d):
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("fragment_id"), F.concat(F.lit("V-"), F.col("doc_id")).alias("version_id"), F.col("text").alias("content"), "doc_id")
    kept = _fused(spark, d)[2].select(F.col("query_id").alias("operation_id"), "fragment_id", "rank")
    x = retrieval.final_fragments(kept, docs.drop("doc_id"), docs.select("version_id", "doc_id"))
    return x.select("operation_id", "fragment_id", "rank", "doc_id", text_sha256(F.col("content")).alias("digest"))


_ASKS = "CASE item_id % 3 WHEN 0 THEN 'ana' WHEN 1 THEN 'luis' ELSE 'eva' END"


@query("R23_hybrid_retrieval", f"""
WITH {_ACCESS}, {_T}, qs AS (SELECT item_id AS query_id, {_ASKS} AS scope FROM benchmark), seen AS (SELECT principal AS scope, doc_id AS fragment_id FROM decided WHERE decision = 'PERMIT' AND principal IN (SELECT scope FROM qs)),
ql AS (SELECT DISTINCT item_id AS query_id, {_ASKS} AS scope, unnest({_LEX}) AS lexeme FROM benchmark), dl AS (SELECT fragment_id, sum(tf) AS dl FROM t GROUP BY 1),
st AS (SELECT scope, count(*) AS n, avg(coalesce(dl, 0)) AS avgdl FROM seen LEFT JOIN dl USING (fragment_id) GROUP BY scope), df AS (SELECT scope, lexeme, count(*) AS df FROM seen JOIN t USING (fragment_id) GROUP BY ALL),
sc AS (SELECT query_id, fragment_id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl))), 9) AS score FROM ql JOIN t USING (lexeme) JOIN seen USING (scope, fragment_id) JOIN df USING (scope, lexeme) JOIN dl USING (fragment_id) JOIN st USING (scope) GROUP BY ALL),
b AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, fragment_id) AS rank FROM sc WHERE score > 0 QUALIFY rank <= 10),
v AS (SELECT query_id, e.vec_id AS fragment_id, round(1 - list_cosine_similarity(CAST(q.embedding AS DOUBLE[]), CAST(e.embedding AS DOUBLE[])), 9) AS distance FROM qs JOIN embeddings q ON q.vec_id = query_id JOIN seen USING (scope) JOIN embeddings e ON e.vec_id = fragment_id),
vk AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, fragment_id) AS rank FROM v QUALIFY rank <= 10),
ids AS (SELECT query_id, fragment_id FROM vk UNION SELECT query_id, fragment_id FROM b), lost AS (SELECT DISTINCT query_id FROM ids WHERE fragment_id % 61 = 5),
fz AS (SELECT coalesce(a.query_id, b.query_id) AS query_id, coalesce(a.fragment_id, b.fragment_id) AS fragment_id, a.rank AS vr, b.rank AS br, coalesce(1.0 / (60 + a.rank), 0) + coalesce(1.0 / (60 + b.rank), 0) AS rrf FROM vk a FULL JOIN b ON a.query_id = b.query_id AND a.fragment_id = b.fragment_id),
fu AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rrf DESC, least(vr, br), vr IS NULL, vr, br IS NULL, br, fragment_id) AS rank FROM fz QUALIFY rank <= 5),
kept AS (SELECT * FROM fu WHERE query_id NOT IN (SELECT query_id FROM lost)), whole AS (SELECT doc_id FROM documents WHERE source IS NOT NULL AND lang IS NOT NULL AND n_chars >= 400 AND trim(text) <> '')
SELECT qs.query_id, CASE WHEN qs.query_id IN (SELECT query_id FROM lost) THEN 'DENIED' WHEN qs.query_id NOT IN (SELECT query_id FROM ids) THEN 'SIN_EVIDENCIA' WHEN qs.query_id IN (SELECT query_id FROM kept WHERE (vr <= 3 OR br <= 3) AND fragment_id IN (SELECT doc_id FROM whole)) THEN 'EVIDENCIA_SUFICIENTE' ELSE 'EVIDENCIA_INSUFICIENTE' END AS evidence, fragment_id, rank
FROM qs LEFT JOIN kept ON kept.query_id = qs.query_id""")
def _hybrid(spark, d):
    docs, items = table(spark, d, "documents"), table(spark, d, "benchmark")
    asks = items.select(F.col("item_id").alias("query_id"), F.expr(_ASKS).alias("principal"), scalars.lexemes(F.col("text")).alias("lexemes")).join(_item_vectors(spark, d), "query_id", "left")
    vectors = table(spark, d, "embeddings").select(F.col("vec_id").alias("doc_id"), "embedding")
    fragments = docs.select(F.col("doc_id").alias("fragment_id"), "doc_id", _whole(docs).alias("complete")).join(vectors, "doc_id", "left")
    allowed = access.authorized_documents(**_rules(spark, d))
    at = work_dir(spark, "hybrid")
    fragments, allowed = postings.write(fragments, f"{at}/fragments"), postings.write(allowed, f"{at}/allowed")
    evidence, fused = retrieval.retrieve(asks, fragments, allowed, postings.write(_terms(spark, d), f"{at}/terms"), at, allowed.where("doc_id % 61 <> 5"))
    return evidence.join(fused.select("query_id", "fragment_id", "rank"), "query_id", "left")


_MARK = "regexp_replace(coalesce(text, ''), '[\\\\[\\\\]]', ' '{g}) || CASE turn % 4 WHEN 0 THEN ' [E1] y [E3] y [E1]' WHEN 1 THEN ' [E9]' WHEN 2 THEN '' ELSE '[E2]' END"


@query("F30_citations", f"""
WITH t AS (SELECT conv_id, turn, {_MARK.format(g=", 'g'").replace(chr(92) * 2, chr(92))} AS text FROM conversations), m AS (SELECT *, regexp_extract_all(text, '\\[([^\\[\\]]*)\\]', 1) AS marks FROM t)
SELECT conv_id, turn, array_to_string(list_filter(marks, lambda x, i: list_position(marks, x) = i), ',') AS cited, len(marks) > 0 AND len(list_filter(marks, lambda x: x NOT IN ('E1', 'E2', 'E3', 'E4', 'E5'))) = 0 AS valid FROM m""")
def _citations(spark, d):
    x = table(spark, d, "conversations").select(F.struct("conv_id", "turn").alias("answer_id"), F.expr(_MARK.format(g="")).alias("text"))
    return retrieval.check_citations(x).select("answer_id.conv_id", "answer_id.turn", "cited", "valid")


@query("A19_certificates", f"""WITH RECURSIVE {_INDEX}
SELECT 'V-' || doc_id AS version_id, count(*) AS chunks, count(*) FILTER (embedded) AS embedded, count(*) AS lexical, count(*) FILTER (len(lex) = 0) AS without_terms, (SELECT sha256(text) FROM src WHERE src.doc_id = ready.doc_id) AS text_sha256, 'index-v1' AS contract, 'model-v1' AS model, 64 AS dimensions, 512 AS chunk_size, 50 AS chunk_overlap FROM ready GROUP BY doc_id""")
def _certificates(spark, d):
    return _structured_index(spark, d).certificates.drop("doc_id")


#: Each rule of a certificate broken in some versions, by their number of words; the rest fit.
_SPOILT = {"SOURCE_STATE": 1, "TEXT_CHANGED": 2, "ORDINALS": 3, "CHUNK_COUNT": 4, "EMBEDDED_COUNT": 5, "RECEIPT_COUNT": 6, "ZERO_LEXEMES": 7, "RECEIPT_CONTRACT": 8, "RECEIPT_TERMS": 9}


@query("A20_certificate_violations", f"""
WITH w AS (SELECT doc_id, len({_W}) AS n FROM documents), k AS (SELECT doc_id, n % 11 AS k, CASE WHEN n <= 128 THEN 1 ELSE CAST(ceil((n - 16) / 112.0) AS INT) END AS chunks FROM w WHERE n > 0)
SELECT 'V-' || doc_id AS version_id, violation FROM k JOIN (VALUES {', '.join(f"('{v}', {n})" for v, n in _SPOILT.items())}) v(violation, n) ON k = n UNION ALL SELECT 'V-' || doc_id, 'RECEIPT_CONTRACT' FROM k WHERE k = 6""")
def _violations(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "text", F.concat(F.lit("V-"), F.col("doc_id")).alias("version_id"))
    at = work_dir(spark, "spoilt")
    chunks = postings.write(corpus.chunk_fixed(docs, 128, 16).join(docs.select("doc_id", "version_id"), "doc_id").withColumn("chunk_id", F.concat_ws("/", "doc_id", "ordinal")).withColumn("embedded", F.lit(True)), f"{at}/chunks")
    terms = postings.write(corpus.term_index(chunks), f"{at}/terms")
    receipts = corpus.index_receipts(chunks, terms, "index-v1")
    certificates = postings.write(corpus.build_certificates(chunks, receipts, docs), f"{at}/certificates")
    k = docs.select("version_id", (F.size(F.filter(F.split("text", r"\s+"), lambda w: w != "")) % 11).alias("k"))
    by = lambda df: df.join(k, "version_id")
    is_ = lambda name: F.col("k") == _SPOILT[name]
    first = F.col("chunk_id").endswith("/0")
    certificates = by(certificates).withColumns({"chunks": F.col("chunks") + is_("CHUNK_COUNT").cast("int"), "embedded": F.col("embedded") - is_("EMBEDDED_COUNT").cast("int"), "without_terms": F.col("without_terms") + is_("ZERO_LEXEMES").cast("int"), "text_sha256": F.when(is_("TEXT_CHANGED"), "older").otherwise(F.col("text_sha256"))}).drop("k")
    receipts = by(receipts).where(~(is_("RECEIPT_COUNT") & first)).withColumns({"contract": F.when(is_("RECEIPT_CONTRACT") & first, "index-v0").otherwise(F.col("contract")), "lexical_terms": F.col("lexical_terms") + (is_("RECEIPT_TERMS") & first).cast("int") * 100_000})
    chunks = by(chunks).withColumn("ordinal", F.when(is_("ORDINALS"), F.col("ordinal") + 1).otherwise(F.col("ordinal")))
    versions = by(docs).withColumn("state", F.when(is_("SOURCE_STATE"), "EN_PROCESO").otherwise("LISTA"))
    return corpus.validate_certificates(certificates, chunks, receipts, terms, versions)


_NEWER = "SELECT CASE WHEN label % 5 = 2 THEN vec_id + 1000000 ELSE vec_id END AS vec_id FROM {embeddings} WHERE label % 5 <> 1 UNION ALL SELECT vec_id FROM {embeddings} WHERE vec_id % 40 = 0"


@query("A21_compare_index", f"""
WITH old AS (SELECT vec_id FROM embeddings), new AS ({_NEWER.format(embeddings='embeddings')})
SELECT vec_id, 'existing' AS side FROM (SELECT vec_id FROM old EXCEPT ALL SELECT vec_id FROM new) UNION ALL SELECT vec_id, 'new' FROM (SELECT vec_id FROM new EXCEPT ALL SELECT vec_id FROM old)""")
def _compare(spark, d):
    e = table(spark, d, "embeddings")
    return corpus.compare_index(e.select("vec_id"), spark.sql(_NEWER, embeddings=e))


#: Places of a text: every 700 characters, and 1,200 from there.
_PLACES = "SELECT doc_id, length(text) AS n, unnest(generate_series(0, length(text) - 1, 700)) AS a FROM {docs} WHERE length(text) > 0"


def _places(docs):
    n = F.length("text")
    return docs.where(n > 0).select("doc_id", n.alias("n"), F.explode(F.sequence(F.lit(0), n - 1, F.lit(700))).alias("a"))


@query("J09_page_ranges", f"""
WITH p AS ({_PLACES.format(docs='documents')})
SELECT doc_id, CAST(a AS INT) AS a, CAST(floor(a / 1000.0) AS INT) + 1 AS first, CAST(floor((least(a + 1200, n) - 1) / 1000.0) AS INT) + 1 AS last FROM p""")
def _page_ranges(spark, d):
    docs = table(spark, d, "documents")
    n = F.length("text")
    pages = docs.where(n > 0).select("doc_id", n.alias("n"), F.explode(F.sequence(F.lit(0), F.ceil(n / 1000).cast("int") - 1)).alias("k"))
    pages = pages.select("doc_id", (F.col("k") + 1).alias("page"), (F.col("k") * 1000).alias("start"), F.least(F.col("k") * 1000 + 1000, F.col("n")).alias("end"))
    chunks = _places(docs).select("doc_id", "a", F.col("a").alias("start"), F.least(F.col("a") + 1200, F.col("n")).alias("end"))
    return spans.page_ranges(chunks, pages, key="a").select("doc_id", "a", F.col("first_page").alias("first"), F.col("last_page").alias("last"))


@query("J10_sections", f"""
WITH RECURSIVE {_chunks_sql(96, 12)}, p AS ({_PLACES.format(docs='src')})
SELECT doc_id, CAST(a AS INT) AS a, (SELECT label FROM heads h WHERE h.doc_id = p.doc_id AND pos <= a ORDER BY pos DESC LIMIT 1) AS section FROM p""")
def _sections(spark, d):
    docs = _structured(spark, d)
    heads = corpus.structural_metadata(docs).select("doc_id", "start", F.coalesce("section", "clause").alias("name"))
    sections = spans.heading_spans(heads, docs.select("doc_id", F.length("text").alias("n")))
    return spans.section_at(_places(docs).select("doc_id", "a", F.col("a").alias("start")), sections, key="a").select("doc_id", "a", "section")


@query("F13_query_hashes", "SELECT item_id, sha256(nfc_normalize(trim(text))) AS h FROM benchmark")
def _hashes(spark, d):
    return table(spark, d, "benchmark").select("item_id", scalars.query_hash(F.concat(F.lit("\r\n "), F.col("text"), F.lit("\t\n"))).alias("h"))
