"""Pages and tiles over indicator observations."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from casemill.functions.scalars import INDICATORS, SEVERITIES, severity
from casemill.operators.observations import latest_per_key

#: What each risk type shows besides the contextual indicators.
RISK = {"contractual": "KPI-RC-", "litigation": "KPI-LI-", "compliance": "KPI-CN-"}
CONTEXTUAL = ["KPI-RC-01", "KPI-EO-01"]


def filter_dashboard(observations: DataFrame, risk: str | None = None, entity: str | None = None) -> DataFrame:
    """Known indicators of a risk type; an entity filter passes rows without that dimension."""
    x = observations.where(F.col("code").isin(list(INDICATORS)))
    if risk in RISK:
        x = x.where(F.col("code").isin(CONTEXTUAL) | F.col("code").startswith(RISK[risk]))
    if entity is not None:
        own = F.get_json_object("dims", "$.entity")
        x = x.where(own.isNull() | (own == entity))
    return x


def period_reference(observations: DataFrame, today: str) -> DataFrame:
    """One row: the latest month with an available value that ended before today."""
    ok = (F.col("availability") == "DISPONIBLE") & (F.col("period_end") < F.lit(today).cast("date"))
    return observations.agg(F.max(F.when(ok, F.col("period_start"))).alias("reference"))


def kpi_page(observations: DataFrame, start: str, end: str) -> DataFrame:
    """Rows of the range in page order; of the expiry indicator only its latest valid row."""
    x = observations.where(F.col("period_start").between(F.lit(start).cast("date"), F.lit(end).cast("date")))
    rc03 = (F.col("code") == "KPI-RC-03") & (F.col("availability") == "DISPONIBLE")
    one = latest_per_key(x.where(rc03), ["code"], F.desc("period_start"), F.desc("observation_id"))
    return x.where("code <> 'KPI-RC-03'").unionByName(one).orderBy("code", "period_start", "dims", "observation_id")


def latest_series(observations: DataFrame) -> DataFrame:
    """The newest observation of each series."""
    return latest_per_key(observations, ["code", "dims"], F.desc("period_start"), F.desc("observation_id"))


def severity_composition(observations: DataFrame, code: str) -> DataFrame:
    """(severity, total, percent) of an indicator's latest month."""
    x = observations.where((F.col("code") == code) & (F.col("availability") == "DISPONIBLE")).withColumn("severity", severity(F.col("dims"))).where("severity is not null")
    last = x.agg(F.max("period_start").alias("top"))
    t = x.join(F.broadcast(last), F.col("period_start") == F.col("top")).groupBy("severity").agg(F.sum("value").alias("total"))  # one row
    return t.withColumn("percent", F.round(F.col("total").cast("double") / F.sum(F.col("total").cast("double")).over(Window.partitionBy(F.lit(0))) * 100, 6))


def exposure_evolution(observations: DataFrame) -> DataFrame:
    """A row a month, a column a severity."""
    x = observations.where("code = 'KPI-LI-01'").withColumn("severity", severity(F.col("dims")))
    return x.groupBy("period_start").pivot("severity", SEVERITIES).agg(F.first("value"))


def litigation_exposure(observations: DataFrame) -> DataFrame:
    """(period_start, total): the sum where all three severities are there once and available; null else."""
    x = observations.where("code = 'KPI-LI-01'").withColumn("severity", severity(F.col("dims")))
    g = x.groupBy("period_start").agg(F.count("*").alias("n"), F.countDistinct("severity").alias("d"), F.count("value").alias("v"), F.sum("value").alias("total"))
    return g.select("period_start", F.when((F.col("n") == 3) & (F.col("d") == 3) & (F.col("v") == 3), F.col("total")).alias("total"))


def executive_tiles(observations: DataFrame) -> DataFrame:
    """(code, state, value): one period an indicator, its latest; a value or zero, DIMENSIONAL for what does not add up, or why there is none."""
    names = observations.sparkSession.createDataFrame([(c,) for c in INDICATORS], "code string")
    top = Window.partitionBy("code")
    x = observations.withColumn("top", F.max("period_start").over(top)).where("period_start = top").withColumn("severity", severity(F.col("dims")))
    g = x.groupBy("code").agg(F.count("*").alias("n"), F.count("value").alias("v"), F.countDistinct("severity").alias("d"), F.sum("value").alias("total"))
    g = names.join(g, "code", "left")
    whole = F.when(F.col("code") == "KPI-LI-01", (F.col("n") == 3) & (F.col("d") == 3) & (F.col("v") == 3)).when(F.col("code") == "KPI-CN-03", F.lit(False)).otherwise(F.col("n") == 1)
    state = F.when(F.col("n").isNull(), "NO_OBSERVATION").when(F.col("v") == 0, "NO_DISPONIBLE").when(~whole, "DIMENSIONAL").when(F.col("total") == 0, "ZERO").otherwise("VALUE")
    return g.select("code", state.alias("state"), F.when(state.isin("ZERO", "VALUE"), F.col("total")).alias("value"))


def chart_series(observations: DataFrame, code: str) -> DataFrame:
    """(dims, points): a series' points in order, as month=value; blanks for unavailable months."""
    rows = F.array_sort(F.collect_list(F.struct("period_start", F.coalesce(F.round(F.col("value").cast("double"), 2).cast("decimal(20,2)").cast("string"), F.lit("")).alias("v"))))
    x = observations.where(F.col("code") == code).groupBy("dims").agg(rows.alias("r"))
    return x.select("dims", F.array_join(F.transform("r", lambda p: F.concat(F.date_format(p["period_start"], "yyyy-MM"), F.lit("="), p["v"])), ";").alias("points"))
