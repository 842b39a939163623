"""Joins of two tables of spans: overlapping ones, and the one that holds a place.

A span belongs to a level, the smallest power of two that is not shorter, and touches two bins of that
width at most.  Two spans meet at the level of the longer one, where the shorter one touches two bins at
most as well; so a span goes to two bins for each level that the other side has, however long it is, and a
document with very many spans is spread by its bins.  A pair that shares two bins counts in the one where
the later of its spans begins.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _levels(spans: DataFrame) -> list[int]:
    return sorted(r[0] for r in spans.select("level").distinct().collect())  # 63 at most


def _levelled(spans: DataFrame, start: str, end: str) -> DataFrame:
    """Spans that are not empty, with their level: 2**level is their length or more."""
    n = F.col(end).cast("long") - F.col(start).cast("long")
    x = spans.where(n > 0)
    # a log in doubles may be off by one at powers of two; the shift corrects it
    level = F.ceil(F.log2(n.cast("double"))).cast("int")
    power = lambda k: F.expr(f"shiftleft(cast(1 as bigint), {k})")
    return x.withColumn("level", level).withColumn("level", F.when(power("level") < n, F.col("level") + 1).when((F.col("level") > 0) & (power("level - 1") >= n), F.col("level") - 1).otherwise(F.col("level")))


def _binned(spans: DataFrame, start: str, end: str, levels: Column) -> DataFrame:
    """A row for each bin of the levels that a span touches."""
    x = spans.withColumn("meet", F.explode(levels))
    first, last = F.expr(f"shiftright(cast(`{start}` as bigint), meet)"), F.expr(f"shiftright(cast(`{end}` as bigint) - 1, meet)")
    return x.withColumn("bin", F.explode(F.array_distinct(F.array(first, last)))).drop("level")


def overlap_join(left: DataFrame, right: DataFrame, on: str, start: str = "start", end: str = "end", names: tuple[str, str] = ("other_start", "other_end")) -> DataFrame:
    """Pairs of rows with the same `on` whose spans [start, end) share a place; the right side's bounds get other names.

    Empty and null spans meet nothing, nor do rows without `on`.  Other columns of the sides must differ.
    """
    a = _levelled(left, start, end)
    b = _levelled(right.withColumnsRenamed({start: names[0], end: names[1]}), *names)
    own = F.array("level")
    among = lambda levels, ok: F.filter(F.array(*[F.lit(x) for x in levels]).cast("array<int>"), ok)
    of_left, of_right = _levels(a), _levels(b)
    # the longer one's level: the left's own with right spans as long at most, and the right's own with shorter left spans
    long_left = _binned(a, start, end, own).join(_binned(b, *names, among(of_left, lambda m: m >= F.col("level"))), [on, "meet", "bin"])
    long_right = _binned(a, start, end, among(of_right, lambda m: m > F.col("level"))).join(_binned(b, *names, own), [on, "meet", "bin"])
    meet = (F.col(start) < F.col(names[1])) & (F.col(names[0]) < F.col(end)) & (F.col("bin") == F.expr(f"shiftright(cast(greatest(`{start}`, `{names[0]}`) as bigint), meet)"))
    return long_left.unionByName(long_right).where(meet).drop("meet", "bin")


def page_ranges(chunks: DataFrame, pages: DataFrame, on: str = "doc_id", key: str = "chunk_id") -> DataFrame:
    """chunks (on, key, start, end …) with first_page and last_page of the pages (on, page, start, end) that a chunk touches; null for none."""
    hit = overlap_join(chunks.select(on, key, "start", "end"), pages.select(on, "page", "start", "end"), on)
    found = hit.groupBy(on, key).agg(F.min("page").alias("first_page"), F.max("page").alias("last_page"))
    return chunks.join(found, [on, key], "left")


def section_at(places: DataFrame, sections: DataFrame, on: str = "doc_id", key: str = "chunk_id") -> DataFrame:
    """places (on, key, start …) with `section`: the name of the first section (on, name, ordinal, start, end), by ordinal, that holds the start; null for none."""
    spots = places.select(on, key, "start", (F.col("start") + 1).alias("end"))
    hit = overlap_join(spots, sections.select(on, "name", "ordinal", "start", "end"), on)
    return places.join(hit.groupBy(on, key).agg(F.min_by("name", "ordinal").alias("section")), [on, key], "left")


def heading_spans(headings: DataFrame, lengths: DataFrame, on: str = "doc_id") -> DataFrame:
    """(on, name, ordinal, start, end): each heading (on, start, name) holds the text from its line to the next heading, or to the end (lengths: on, n)."""
    order = Window.partitionBy(on).orderBy("start")
    x = headings.join(lengths.select(on, "n"), on).withColumn("end", F.coalesce(F.lead("start").over(order), F.col("n")))
    return x.select(on, "name", F.row_number().over(order).alias("ordinal"), "start", "end")
