"""Line dedup: a suffix array over line ids by distributed prefix doubling; later copies of repeated runs are deleted.

The corpus is a sequence of line ids, cut at document ends; a suffix starts at each line.  Round k ranks
the suffixes by their first 2**k lines: the rank for twice as many is that of the pair (own rank, rank
2**k lines on), pairs being sorted over the cluster.  Suffixes that share no prefix with another leave.
A rank that is left stands for an interval of the suffix array whose common prefix has 2**k lines or
more, with its first occurrence in the corpus.

The longest common prefix of a suffix with an earlier one follows from the intervals downwards: from the
longest 2**k lines that occurred earlier on, its interval is refined by ranks of 2**(k-1), 2**(k-2), ...
lines, as long as an earlier suffix stays inside.  So each suffix gets the longest run of lines that
starts there and occurred earlier, by document id and line.  Runs inside others are left out; the rest
are the maximal repeated runs, and those of `min_chars` characters or more are deleted.

DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from casemill.llm.shared import discard, hot_join, keyed, small_or_join, stage

#: Line ends as documents have them.
LINE_END = "\n"
#: Largest side that is broadcast, in bytes: each round has its own, so they are small.
LIMIT = 16 << 20


def _ranked(keys: DataFrame, by: list[str]) -> DataFrame:
    """Distinct keys, written with a number each that rises with them."""
    return stage(keys.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("interval", F.monotonically_increasing_id()), "ranks")


def _of_class(rows: DataFrame, n_rows: int, classes: DataFrame, on: list[str], how: str) -> DataFrame:
    """rows with their classes (column n: rows of each); there are no more classes than rows."""
    if n_rows * 96 <= LIMIT:
        return rows.join(F.broadcast(classes), on, how)
    return hot_join(rows, stage(classes, "classes"), on, "n", how, row_bytes=96, limit=LIMIT)


def _place() -> F.Column:
    return F.struct("id", "pos")


def suffix_intervals(texts: DataFrame, rounds: int = 40) -> list[DataFrame]:
    """For k = 0, 1, ...: (id, pos, rank, first): the suffixes whose first 2**k lines start at two places or more, ranked by these, with the first of each rank."""
    lines = texts.select("id", F.posexplode(F.split("text", LINE_END, -1)).alias("pos", "line"))
    names = lines.select("id", "pos", F.unhex(F.md5("line")).alias("rank"))
    out: list[DataFrame] = []
    for k in range(rounds):
        on = ["rank"] if not k else ["rank", "next"]
        classes = names.groupBy(*on).agg(F.min(_place()).alias("first"), F.count("*").alias("n")).where("n > 1")
        classes = _ranked(classes, on)
        now = hot_join(names, classes, on, "n", row_bytes=96, limit=LIMIT).select("id", "pos", F.col("interval").alias("rank"), "first")
        out.append(stage(now, "suffixes", classes))
        if k and out[-1].isEmpty():
            return out[:-1]
        ahead = Window.partitionBy("id").orderBy("pos").rangeBetween(1 << k, 1 << k)
        names = out[-1].select("id", "pos", "rank", F.max("rank").over(ahead).alias("next")).where("next is not null")
    raise RuntimeError("runs of lines are longer than 2**40")


def longest_earlier(texts: DataFrame) -> DataFrame:
    """(id, pos, lines): for each suffix that shares a first line with an earlier one, the most lines that it shares with any earlier one. texts: id, text with distinct ids."""
    levels = suffix_intervals(texts)
    later = _place() != F.col("first")

    def asking(k: int) -> DataFrame:
        """Suffixes of which 2**k lines occurred earlier, and not twice as many."""
        own = levels[k].where(later).select("id", "pos")
        return own.join(levels[k + 1].where(later).select("id", "pos"), ["id", "pos"], "left_anti") if k + 1 < len(levels) else own

    found = [stage(asking(0).withColumn("lines", F.lit(1)), "found")]
    state = None  # (kind, interval, lines, id, pos, ask): intervals of common prefixes with a suffix that asks for a longer one
    for j in reversed(range(len(levels) - 1)):
        own = levels[j + 1].join(asking(j + 1).withColumn("ask", F.lit(True)), ["id", "pos"], "left")
        own = stage(own.select(F.lit(-j - 1).alias("kind"), F.col("rank").alias("interval"), F.lit(2 << j).alias("lines"), "id", "pos", F.coalesce("ask", F.lit(False)).alias("ask")), "members")
        asked = own.groupBy("interval").agg(F.count("*").alias("n"), F.max("ask").alias("any")).where("any").select("interval", "n")
        rows = _of_class(own, own.count(), asked, ["interval"], "inner").drop("n")
        rows = rows.select("kind", "interval", "lines", "id", "pos", "ask")
        rows = rows if state is None else rows.unionByName(state)
        ahead = levels[j].select("id", (F.col("pos")).alias("at"), F.col("rank").alias("next"))
        stepped = stage(rows.withColumn("at", F.col("pos") + F.col("lines")).join(ahead, ["id", "at"], "left").drop("at"), "stepped", own, *([state] if state is not None else []))
        n = stepped.count()
        # longer prefixes that an asking suffix shares with an earlier one
        head = F.min(F.struct("id", "pos", "ask"))
        longer = stepped.where("next is not null").groupBy("kind", "interval", "next").agg(head.alias("head"), F.count("*").alias("n"), F.sum(F.col("ask").cast("int")).alias("asks")).where("n > 1")
        longer = longer.withColumn("up", F.col("asks") - F.col("head.ask").cast("int")).where("up > 0")
        longer = _ranked(longer.select("kind", "interval", "next", F.struct("head.id", "head.pos").alias("first"), "n", "up").withColumnRenamed("interval", "old"), ["kind", "old", "next"])
        up = stepped.withColumnRenamed("interval", "old")
        up = _of_class(up, n, longer, ["kind", "old", "next"], "left")
        rises = F.col("ask") & F.col("interval").isNotNull() & (_place() != F.col("first"))
        up = stage(up.select("kind", "old", "lines", "id", "pos", "ask", "interval", F.coalesce(rises, F.lit(False)).alias("rises")), "longer", stepped, longer)
        stays = up.groupBy("kind", F.col("old")).agg(F.count("*").alias("n"), F.max(F.col("ask") & ~F.col("rises")).alias("any")).where("any").drop("any")
        same = _of_class(up, n, stays, ["kind", "old"], "inner").select("kind", F.col("old").alias("interval"), "lines", "id", "pos", (F.col("ask") & ~F.col("rises")).alias("ask"))
        more = up.where("interval is not null").select(F.lit(j).alias("kind"), "interval", (F.col("lines") + (1 << j)).alias("lines"), "id", "pos", F.col("rises").alias("ask"))
        state = stage(same.unionByName(more), "state", up)
    if state is not None:
        found.append(state.where("ask").select("id", "pos", "lines"))
    out = found[0]
    for f in found[1:]:
        out = out.unionByName(f)
    out = stage(out, "earlier", found[0], *([state] if state is not None else []))
    discard(*levels)
    return out


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 20, unique: bool = False, keep: list[str] | None = None) -> DataFrame:
    """One row per row of docs: id, n_lines, n_removed, n_runs and longest (the maximal repeated runs that go: their number and the lines of the longest), kept (the remaining lines, joined as before), and the columns of docs named in keep.

    Lines are the parts between newlines; an empty text has one empty line.  A run of lines goes if it
    occurred earlier, by id and line, and has min_chars characters or more, newlines between its lines
    included.  A line's first occurrence always stays.  Null texts are empty.  Rows with null ids come last;
    rows that repeat an id are documents of their own, in the order of their contents.  unique: ids are whole
    numbers, none null and no two alike, as the caller knows.  Extra columns are ignored.  An empty table
    gives an empty table.
    """
    if not unique:
        rows = keyed(docs.select(*{id_col: 1, text_col: 1, **dict.fromkeys(keep or [])}), id_col)
        if hasattr(rows, "staged_at"):
            done = dedup_lines(rows, "__row", text_col, min_chars, unique=True, keep=[id_col, *(k for k in keep or [] if k != id_col)])
            return stage(done.select(id_col, *[c for c in done.columns if c not in ("__row", id_col)]), "lines", rows)
    texts = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), F.struct(*[F.col(c) for c in keep or []], F.lit(0).alias("__none")).alias("other"))
    earlier = longest_earlier(texts)
    # runs inside another run add nothing
    before = Window.partitionBy("id").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    runs = earlier.select("id", F.col("pos").alias("a"), (F.col("pos") + F.col("lines")).alias("b"), F.max(F.col("pos") + F.col("lines")).over(before).alias("reach"))
    runs = stage(runs.where("reach is null or b > reach").groupBy("id").agg(F.sort_array(F.collect_list(F.struct("a", "b"))).alias("runs")), "runs", earlier)
    size = runs.agg(F.sum(16 + 8 * F.size("runs"))).first()[0] or 0
    x = small_or_join(texts, runs, "id", "left", 1, size).withColumn("lines", F.split("text", LINE_END, -1))
    none = F.array().cast("array<struct<a:int,b:int>>")
    long = lambda r: F.aggregate(F.slice("lines", r["a"] + 1, r["b"] - r["a"]), F.lit(-1), lambda n, line: n + F.length(line) + 1) >= min_chars
    x = x.withColumn("runs", F.coalesce(F.filter("runs", long), none))
    # overlapping runs as one stretch: their starts and ends both rise, so a stretch begins behind a gap and ends before one
    opens = F.filter("runs", lambda r, i: F.coalesce(r["a"] > F.get("runs", i - 1)["b"], F.lit(True)))
    closes = F.filter("runs", lambda r, i: F.coalesce(r["b"] < F.get("runs", i + 1)["a"], F.lit(True)))
    x = x.withColumn("gone", F.zip_with(opens, closes, lambda r, t: F.struct(r["a"].alias("a"), t["b"].alias("b"))))
    # kept stretches: from each end to the next start
    spans = F.zip_with(F.concat(F.array(F.lit(0)), F.transform("gone", lambda r: r["b"])), F.concat(F.transform("gone", lambda r: r["a"]), F.array(F.size("lines"))), lambda a, b: F.slice("lines", a + 1, b - a))
    return x.select(
        F.col("id").alias(id_col),
        F.size("lines").cast("long").alias("n_lines"),
        F.aggregate("gone", F.lit(0), lambda t, r: t + r["b"] - r["a"]).cast("long").alias("n_removed"),
        F.size("runs").cast("long").alias("n_runs"),
        F.coalesce(F.array_max(F.transform("runs", lambda r: r["b"] - r["a"])), F.lit(0)).cast("long").alias("longest"),
        F.when(F.size("gone") == 0, F.col("text")).otherwise(F.array_join(F.flatten(spans), LINE_END)).alias("kept"),
        *[F.col(f"other.{c}").alias(c) for c in keep or []],
    )


def op4(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return dedup_lines(docs).select("doc_id", "n_lines", "n_removed", "n_runs", "longest", F.sha2("kept", 256).alias("kept_sha256"))


OP4_SQL = """
WITH lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos
  FROM documents),
named AS (SELECT doc_id, pos, hash(line) AS h, line FROM lines),
met AS (
  SELECT a.doc_id AS d, a.pos AS p, b.doc_id AS e, a.pos - b.pos AS shift
  FROM named a JOIN named b ON a.h = b.h AND a.line = b.line AND (b.doc_id < a.doc_id OR b.doc_id = a.doc_id AND b.pos < a.pos)),
islands AS (SELECT *, p - row_number() OVER (PARTITION BY d, e, shift ORDER BY p) AS island FROM met),
shared AS (SELECT d, p, max(p) OVER (PARTITION BY d, e, shift, island) - p + 1 AS n FROM islands),
longest AS (SELECT d, p, max(n) AS n FROM shared GROUP BY d, p),
ranged AS (SELECT *, max(p + n) OVER (PARTITION BY d ORDER BY p ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM longest),
runs AS (
  SELECT d, p, n FROM (SELECT d, p, n FROM ranged WHERE reach IS NULL OR p + n > reach) JOIN lines ON doc_id = d AND pos >= p AND pos < p + n
  GROUP BY d, p, n HAVING sum(length(line) + 1) - 1 >= 20),
gone AS (SELECT DISTINCT d, unnest(generate_series(p, p + n - 1)) AS p FROM runs),
marked AS (SELECT doc_id, pos, line, g.d IS NOT NULL AS gone FROM lines LEFT JOIN gone g ON g.d = doc_id AND g.p = pos),
counts AS (SELECT d, count(*) AS n_runs, max(n) AS longest FROM runs GROUP BY d)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_removed, coalesce(any_value(n_runs), 0) AS n_runs, coalesce(any_value(longest), 0) AS longest,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM marked LEFT JOIN counts ON d = doc_id GROUP BY doc_id
"""
