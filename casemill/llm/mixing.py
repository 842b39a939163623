"""Mixing sources to target weights by pivotal dependent rounding.

A source's target over its size is the expected number of copies of each of its documents.  The whole
part is given to all; the fractions are rounded in pairs: two documents' fractions pass mass to each
other at random until one of them is 0 or 1, so their sum, and with it the number of copies, never
changes.  Documents meet others of like size first, in blocks of a bounded number of rows of one
source and size class; each block leaves one fraction at most, and a reduction tree pairs those, 64
blocks at a time, then classes, until one fraction a source is left and drawn.

Draws come from hashes of the ids and of the level of the tree, so each meeting has its own: reruns
agree.  Rows that agree in id, source and size are told apart by their place in the table.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from casemill.llm.shared import WORD, hot_join, stage

FAN = 64
_EPS = 1e-9


def pivotal(p: np.ndarray, draws: np.ndarray) -> np.ndarray:
    """Rounds fractions in order, each against the one left over so far; at most one stays fractional and the sum stays as it was."""
    p = p.copy()
    left = -1
    for i in range(len(p)):
        if _EPS < p[i] < 1 - _EPS:
            if left < 0:
                left = i
                continue
            a, b = p[left], p[i]
            s = a + b
            if s < 1:  # one of them ends at 0
                win = draws[i] * s < b
                p[left], p[i] = (0.0, s) if win else (s, 0.0)
            else:  # one of them ends at 1
                win = draws[i] * (2 - s) < 1 - a
                p[left], p[i] = (s - 1, 1.0) if win else (1.0, s - 1)
            left = i if _EPS < p[i] < 1 - _EPS else left if _EPS < p[left] < 1 - _EPS else -1
    return np.where(p <= _EPS, 0.0, np.where(p >= 1 - _EPS, 1.0, p))


def source_targets(sizes: DataFrame, weights: tuple[float, ...] = (5, 2, 1), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """(source, source_size, target): `share` of all sizes, divided by weight among sources and never above `most` times a source's size.

    sizes: source, size.  Weights repeat over the sources in code point order, null last.  What a
    full source cannot take is shared by weight among the others until none is above.  There is a row a
    source here, so the windows over all of them stay small.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    s = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    turn = (F.row_number().over(order) - 1) % len(weights)
    s = s.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (turn + 1).cast("int")))
    s = s.withColumn("cap", F.col("source_size") * F.lit(float(most)))
    everyone = Window.partitionBy(F.lit(0))
    filling = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    before = filling.rowsBetween(Window.unboundedPreceding, -1)
    onward = filling.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    s = s.withColumn("level", (F.sum("source_size").over(everyone) * share - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("weight").over(onward))
    # the first source, in the order in which they fill, that is not filled sets the level for the rest
    s = s.withColumn("place", F.row_number().over(filling))
    s = s.withColumn("level", F.min(F.when(F.col("cap") >= F.col("level") * F.col("weight"), F.struct("place", "level"))).over(everyone)["level"])
    return s.select("source", F.col("source_size").cast("long").alias("source_size"), F.coalesce(F.least("cap", F.col("level") * F.col("weight")), "cap").alias("target"))


def mix_sources(docs: DataFrame, size: Column | None = None, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", weights: tuple[float, ...] = (5, 2, 1), share: float = 1.5, most: float = 2.0, block_rows: int = 128) -> DataFrame:
    """One row per row of docs: id, source, size, source_size, target (its source's), copies, taken (size * copies).

    Size is the number of words, 0 for null and empty texts, unless another non-negative column is
    given.  No document is taken more than ceil(most) times.  Null sources are one source.  Sources
    without words have target 0.  Repeated rows are documents of their own.  Extra columns are ignored.
    An empty table gives an empty table.
    """
    words = F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)) if size is None else size
    rows = stage(docs.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), words.cast("long").alias("size"), F.monotonically_increasing_id().alias("place")), "sizes")
    same = F.struct("id", "source", "size")
    twins = stage(rows.groupBy(F.xxhash64(same).alias("twin")).agg(F.count("*").alias("n")).where("n > 1"), "twins")
    rows = hot_join(rows.withColumn("twin", F.xxhash64(same)), twins, "twin", "n", "left")
    rows = rows.select("id", "source", "size", F.when(F.col("n") > 1, F.col("place")).otherwise(-1).alias("place"))
    targets = stage(source_targets(rows, weights, share, most), "targets").withColumnRenamed("source", "s")
    n_sources = targets.count()
    # half-octave classes of size keep like with like
    kind = F.when(F.col("size") > 0, F.floor(F.log2(F.col("size")) * 4)).otherwise(-1).cast("int")
    rows = rows.withColumn("class", kind)
    counts = rows.groupBy("source", "class").agg(F.count("*").alias("n"))
    counts = stage(counts.select(F.col("source").alias("s2"), F.col("class").alias("c2"), F.ceil(F.col("n") / block_rows).cast("long").alias("blocks")), "blocks")
    facts = counts.agg(F.count("*"), F.max("blocks")).first()
    same = F.col("source").eqNullSafe(F.col("s2")) & (F.col("class") == F.col("c2"))
    plan = F.broadcast if facts[0] * 64 < 32 << 20 else (lambda x: x)
    rows = rows.join(plan(counts), same).drop("s2", "c2")
    rows = rows.join((F.broadcast if n_sources * 64 < 32 << 20 else (lambda x: x))(targets), F.col("source").eqNullSafe(F.col("s"))).drop("s")
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    whole = F.floor(ratio + _EPS).cast("int")
    spot = F.xxhash64("id", "size", "place")
    fresh = lambda level: (F.pmod(F.xxhash64("id", "place", F.lit(f"draw {level}")), F.lit(1 << 30)) / float(1 << 30)).alias("draw")
    rows = rows.select("id", "source", "size", "place", "source_size", "target", "class", whole.alias("whole"), F.when(F.col("size") > 0, F.greatest(F.lit(0.0), ratio - whole)).otherwise(0.0).alias("p"), F.pmod(spot, F.col("blocks")).alias("block"), fresh(0))
    layout = "id {}, source {}, size long, place long, source_size long, target double, class int, whole int, p double, block long, draw double".format(*(dict(docs.dtypes)[c] for c in (id_col, source_col)))

    def rounded(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(["size", "draw", "id", "place"], kind="stable")
        part["p"] = pivotal(part["p"].to_numpy(float), part["draw"].to_numpy(float))
        return part

    def halfway(df: DataFrame) -> DataFrame:
        return df.where((F.col("p") > 0) & (F.col("p") < 1))

    done = []
    level = stage(rows.groupBy("source", "class", "block").applyInPandas(rounded, layout), "rounded", twins)
    blocks, turn = int(facts[1] or 1), 1
    while True:
        done.append(level.where((F.col("p") <= 0) | (F.col("p") >= 1)))
        level = halfway(level).withColumn("draw", fresh(turn))
        turn += 1
        if blocks > 1:
            blocks = -(-blocks // FAN)
            level = stage(level.withColumn("block", F.floor(F.col("block") / FAN)).groupBy("source", "class", "block").applyInPandas(rounded, layout), "rounded")
            continue
        last = stage(level.groupBy("source").applyInPandas(rounded, layout), "rounded")
        done.append(last.withColumn("p", F.when((F.col("p") > 0) & (F.col("p") < 1), (fresh(turn) < F.col("p")).cast("double")).otherwise(F.col("p"))))
        break
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    copies = (F.col("whole") + F.round("p").cast("int")).cast("int")
    return out.select(F.col("id").alias(id_col), F.col("source").alias(source_col), "size", "source_size", "target", copies.alias("copies"), (F.col("size") * copies).cast("long").alias("taken"))


def op5(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source", "text")
    return mix_sources(docs).select("doc_id", "size", "source_size", "target", "taken")
