"""A training corpus from `documents`: quality, line dedup, near duplicates, decontamination, mixing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame with the columns of documents; the last
one adds `copies`.  run() writes each stage to the shared folder and reads it again.

What holds for every stage: rows, not ids, are documents.  Rows with null ids and rows that repeat an id
are decided each on its own; where order or one of a group counts, rows go by id, null last.  Null and
empty texts are texts without words.  Extra columns are dropped.  An empty table gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from casemill.llm.decontaminate import find_leaks
from casemill.llm.jaccard_join import link_documents
from casemill.llm.line_dedup import dedup_lines
from casemill.llm.mixing import mix_sources
from casemill.llm.quality import fit_quality, score_quality
from casemill.llm.shared import discard, keyed, small_or_join, stage

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: No SQL states the fitted classifier, the latent search or the pivotal draws; the tests hold the stages against brute force.
ORACLE_SQL = None


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier scores 0.5 or more; all of them where there is no label to learn from."""
    model = fit_quality(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return score_quality(docs.select(*COLUMNS), model, keep=COLUMNS).where("score >= 0.5").select(*COLUMNS)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without later copies of line runs; a document of which nothing is left goes.  Repeated rows are copies: the first stays.  Null and blank texts stay as they are."""
    rows = keyed(docs.select(*COLUMNS), "doc_id")
    done = dedup_lines(rows, id_col="__row", unique=True, keep=COLUMNS)
    cut = F.col("n_removed") > 0
    n_chars = F.when(cut, F.length("kept").cast(dict(docs.dtypes)["n_chars"])).otherwise(F.col("n_chars"))
    left = done.where(~cut | (F.length(F.trim("kept")) > 0))
    return left.select("doc_id", F.when(cut, F.col("kept")).otherwise(F.col("text")).alias("text"), "lang", "source", n_chars.alias("n_chars"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first document of each group linked by five-word shingles at 0.8 or more; repeated rows are a group.  Texts without words all stay."""
    rows = keyed(docs.select(*COLUMNS), "doc_id")
    linked = link_documents(rows, id_col="__row", words=5, least=80, unique=True)
    gone = stage(linked.where("__row <> component_id").select("__row"), "near", linked)
    return small_or_join(rows, gone, "__row", "left_anti", 16, gone.count()).select(*COLUMNS)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no benchmark item is found."""
    rows = keyed(docs.select(*COLUMNS), "doc_id")
    leaks = find_leaks(rows, spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text"), id_col="__row")
    gone = stage(leaks.select("__row").distinct(), "leaks")
    return small_or_join(rows, gone, "__row", "left_anti", 16, gone.count()).select(*COLUMNS)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the mix takes, with the number of copies of each; documents without words are not taken."""
    rows = keyed(docs.select(*COLUMNS), "doc_id")
    drawn = stage(mix_sources(rows, id_col="__row").where("copies > 0").select("__row", "copies"), "drawn")
    return small_or_join(rows, drawn, "__row", "inner", 16, drawn.count()).select(*COLUMNS, "copies")


STAGES = [
    ("quality classifier", keep_quality),
    ("line dedup", drop_repeated_lines),
    ("n-gram Jaccard join", drop_near_duplicates),
    ("benchmark decontamination", drop_leaks),
    ("mixing sources to target weights", mix),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, step in STAGES:
        before, docs = docs, stage(step(spark, docs, sf_dir), name.replace(" ", "-"))
        discard(before)
    return docs
