"""Monthly indicators for a table of requests.

Requests have period_start, period_end (one calendar month each) and as_of, the cut date.  Each table of
entities is read once and becomes facts, a row per code, group and day or month, so requests never meet raw
rows.  What counts between two dates is a difference array: it adds one where it begins and takes one where
it ends, and a prefix sum over the calendar has the count of every cut date.  All indicators are then
answered by one join on equality.  Results: code, period_start, period_end, as_of, dims (canonical JSON),
value (decimal or null) and availability.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from casemill.functions.scalars import LOW_CONFIDENCE, SEVERITIES

#: Which indicators an incorporated entity changes, and which depend on the day of application.
ROUTING = {"CONTRATO": ["KPI-RC-01", "KPI-RC-03"], "LITIGIO": ["KPI-LI-01", "KPI-LI-05"], "OBLIGACION": ["KPI-CN-02"], "INCIDENTE": ["KPI-CN-03"], "ASUNTO": ["KPI-EO-01"]}
SNAPSHOT_CODES = ["KPI-RC-03", "KPI-LI-01", "KPI-CN-02"]
CODES = ["KPI-CD-03", "KPI-CN-02", "KPI-CN-03", "KPI-EO-01", "KPI-LI-01", "KPI-LI-05", "KPI-RC-01", "KPI-RC-03"]
KEY = ["period_start", "period_end", "as_of"]
#: Which are counted at the cut date, over the table as it stands, and by groups that the table has.
CUT_CODES, ALWAYS_CODES, GROUPED_CODES = ["KPI-RC-03", "KPI-CN-02"], ["KPI-LI-01", "KPI-CD-03"], ["KPI-CN-03", "KPI-EO-01"]
#: The day of facts that do not depend on one.
ALWAYS = "0001-01-01"


def _fact(code: str, day: Column, n: Column, num: Column | None = None, dims: Column | None = None) -> Column:
    """One fact of an indicator: its group (canonical JSON), the day or month that it counts for, and what it adds."""
    return F.struct(F.lit(code).alias("code"), (F.lit("{}") if dims is None else dims).alias("dims"), day.cast("date").alias("day"), n.cast("long").alias("n"), (F.lit(None) if num is None else num).cast("decimal(38,10)").alias("num"))


def _facts(entities: DataFrame, *facts: Column) -> DataFrame:
    """(code, dims, day, n, num): the facts of all entities, added up; those without a day drop out, the snapshots' have ALWAYS."""
    own = entities.select(F.explode(F.filter(F.array(*facts), lambda f: f["day"].isNotNull())).alias("f")).select("f.*")
    return own.groupBy("code", "dims", "day").agg(F.sum("n").alias("n"), F.sum("num").alias("num"))


def contract_facts(contracts: DataFrame) -> DataFrame:
    """KPI-RC-01: days from request to signature by month of signature.  KPI-RC-03: a contract not yet begun counts from 60 days before its expiry to that day."""
    open_ = F.when(F.col("estado_revision") == "No iniciado", F.col("fecha_vencimiento"))
    return _facts(
        contracts, _fact("KPI-RC-01", F.trunc("fecha_firma", "month"), F.lit(1), F.datediff("fecha_firma", "fecha_solicitud")),
        _fact("KPI-RC-03", F.date_sub(open_, 60), F.lit(1)), _fact("KPI-RC-03", F.date_add(open_, 1), F.lit(-1)),
    )


def litigation_facts(litigation: DataFrame) -> DataFrame:
    """KPI-LI-01: active exposure by severity, the internal estimate, else the claim.  KPI-LI-05: litigation by month of opening."""
    active = F.when((F.col("estado") == "Activo") & F.col("nivel_severidad").isin(SEVERITIES), F.lit(ALWAYS))
    return _facts(
        litigation, _fact("KPI-LI-01", active, F.lit(1), F.coalesce("estimacion_interna", "monto_reclamado"), F.to_json(F.struct("nivel_severidad"))),
        _fact("KPI-LI-05", F.trunc("fecha_apertura", "month"), F.lit(1)),
    )


def obligation_facts(obligations: DataFrame) -> DataFrame:
    """KPI-CN-02: an obligation without evidence counts from the day after its deadline on."""
    return _facts(obligations, _fact("KPI-CN-02", F.date_add(F.when(F.col("evidencia_cumplimiento").isNull(), F.col("fecha_limite")), 1), F.lit(1)))


def incident_facts(incidents: DataFrame) -> DataFrame:
    """KPI-CN-03: incidents by month, area and severity."""
    return _facts(incidents, _fact("KPI-CN-03", F.trunc("fecha_evento", "month"), F.lit(1), dims=F.to_json(F.struct("area", "nivel_severidad"))))


def matter_facts(matters: DataFrame) -> DataFrame:
    """KPI-EO-01: distinct matters by month, type and state."""
    once = matters.select("estado", "tipo_asunto", F.trunc("fecha", "month").alias("month"), "id_asunto").where("id_asunto is not null").distinct()
    return _facts(once, _fact("KPI-EO-01", F.col("month"), F.lit(1), dims=F.to_json(F.struct("estado", "tipo_asunto"))))


def ocr_facts(latest_final: DataFrame) -> DataFrame:
    """KPI-CD-03: documents whose latest final OCR run reaches 0.80, of all that have one."""
    return _facts(latest_final, _fact("KPI-CD-03", F.lit(ALWAYS), F.lit(1), F.when(F.col("confidence") >= LOW_CONFIDENCE, 1).otherwise(0)))


def _asked(requests: DataFrame, codes: list[str]) -> DataFrame:
    """A row for each request and code: those that it names (column codes, comma-separated), or all."""
    named = F.filter(F.split("codes", ","), lambda c: c.isin(codes)) if "codes" in requests.columns else F.array(*[F.lit(c) for c in codes])
    return requests.select(*KEY, F.explode(named).alias("code"))


def _running(facts: DataFrame, asked: DataFrame) -> DataFrame:
    """Facts of cut indicators as their sums up to each day that has some or is asked for: a prefix sum over the calendar, so its one task a code has a row a day."""
    days = asked.where(F.col("code").isin(CUT_CODES)).select("code", F.lit("{}").alias("dims"), F.col("as_of").alias("day"), F.lit(0).cast("long").alias("n"))
    steps = facts.where(F.col("code").isin(CUT_CODES)).select("code", "dims", "day", "n").unionByName(days).groupBy("code", "dims", "day").agg(F.sum("n").alias("n"))
    return steps.withColumn("n", F.sum("n").over(Window.partitionBy("code", "dims").orderBy("day"))).withColumn("num", F.lit(None).cast("decimal(38,10)"))


def answer(facts: DataFrame, requests: DataFrame, codes: list[str]) -> DataFrame:
    """The indicators of some codes for all requests, from facts.

    A request asks for a day of each code: its month's first, its cut date, or ALWAYS; facts answer by
    equality of code, group and day.  Grouped codes give a row for each group ever seen, zero where the
    month has none; exposure has its three severities always.
    """
    asked = _asked(requests, codes)
    levels = F.array(*[F.concat(F.lit('{"nivel_severidad":"'), F.lit(s), F.lit('"}')) for s in SEVERITIES])
    plain = asked.where(~F.col("code").isin(GROUPED_CODES)).withColumn("dims", F.explode(F.when(F.col("code") == "KPI-LI-01", levels).otherwise(F.array(F.lit("{}")))))
    grouped = [c for c in codes if c in GROUPED_CODES]
    if grouped:
        # the sum keeps the facts' columns, so that both readings of them are one
        seen = facts.where(F.col("code").isin(grouped)).groupBy("code", "dims").agg(F.sum("n").alias("ever"), F.max("num").alias("most")).select("code", "dims")
        plain = plain.unionByName(asked.where(F.col("code").isin(grouped)).join(seen, "code"))
    cut = F.col("code").isin(CUT_CODES)
    day = F.when(cut, F.col("as_of")).when(F.col("code").isin(ALWAYS_CODES), F.lit(ALWAYS).cast("date")).otherwise(F.col("period_start"))
    have = facts.where(~cut)
    if set(codes) & set(CUT_CODES):
        have = have.unionByName(_running(facts, asked))
    x = plain.withColumn("day", day).join(have, ["code", "dims", "day"], "left")
    n, num = F.coalesce("n", F.lit(0)), F.col("num")
    share = F.when(n > 0, (num * F.when(F.col("code") == "KPI-CD-03", 100).otherwise(1)).cast("decimal(20,6)") / n.cast("decimal(20,0)"))
    value = F.when(F.col("code").isin("KPI-RC-01", "KPI-CD-03"), share.cast("decimal(38,10)")).when(F.col("code") == "KPI-LI-01", F.coalesce(num, F.lit(0).cast("decimal(38,10)"))).otherwise(n.cast("decimal(38,10)"))
    x = x.select("code", *KEY, "dims", value.alias("value"))
    return x.withColumn("availability", F.when(F.col("value").isNull(), "NO_DISPONIBLE").otherwise("DISPONIBLE"))


def kpi_rc01(contracts: DataFrame, requests: DataFrame) -> DataFrame:
    """Mean days from request to signature of the contracts signed in the month; not available without any."""
    return answer(contract_facts(contracts), requests, ["KPI-RC-01"])


def kpi_rc03(contracts: DataFrame, requests: DataFrame) -> DataFrame:
    """Contracts not yet begun that expire within 60 days of the cut date."""
    return answer(contract_facts(contracts), requests, ["KPI-RC-03"])


def kpi_li01(litigation: DataFrame, requests: DataFrame) -> DataFrame:
    """Exposure of active litigation by severity; always three rows a request."""
    return answer(litigation_facts(litigation), requests, ["KPI-LI-01"])


def kpi_li05(litigation: DataFrame, requests: DataFrame) -> DataFrame:
    """Litigation opened in the month."""
    return answer(litigation_facts(litigation), requests, ["KPI-LI-05"])


def kpi_cn02(obligations: DataFrame, requests: DataFrame) -> DataFrame:
    """Obligations due before the cut date without evidence."""
    return answer(obligation_facts(obligations), requests, ["KPI-CN-02"])


def kpi_cn03(incidents: DataFrame, requests: DataFrame) -> DataFrame:
    """Incidents of the month by area and severity, for all pairs ever seen."""
    return answer(incident_facts(incidents), requests, ["KPI-CN-03"])


def kpi_eo01(matters: DataFrame, requests: DataFrame) -> DataFrame:
    """Distinct matters of the month by type and state, for all pairs ever seen."""
    return answer(matter_facts(matters), requests, ["KPI-EO-01"])


def kpi_cd03(latest_final: DataFrame, requests: DataFrame) -> DataFrame:
    """Share of documents whose latest final OCR run reaches 0.80, in percent; not available without final runs."""
    return answer(ocr_facts(latest_final), requests, ["KPI-CD-03"])


def kpi_all(tables: dict[str, DataFrame], requests: DataFrame) -> DataFrame:
    """The indicators that the requests ask for, each table read once."""
    facts = [contract_facts(tables["contracts"]), litigation_facts(tables["litigation"]), obligation_facts(tables["obligations"]), incident_facts(tables["incidents"]), matter_facts(tables["matters"]), ocr_facts(tables["latest_final"])]
    return answer(reduce(DataFrame.unionByName, facts), requests, CODES)


def affected_kpis(results: DataFrame) -> DataFrame:
    """Codes that the incorporated results (entity_type, result) change."""
    pairs = [(t, c) for t, codes in ROUTING.items() for c in codes]
    routes = results.sparkSession.createDataFrame(pairs, "entity_type string, code string")
    return results.where("result = 'INCORPORADO'").select("entity_type").distinct().join(F.broadcast(routes), "entity_type").select("code").distinct()


def derive_requests(results: DataFrame) -> DataFrame:
    """Recalculation requests (period_start, period_end, as_of, codes) from results with applied (date), business (date or null), entity_type, result.

    Snapshot indicators belong to the month of application, others to the month of the business date;
    the cut is the day of application, kept inside the month.  Contracts without signature date skip
    the cycle time.
    """
    pairs = [(t, c, c in SNAPSHOT_CODES) for t, codes in ROUTING.items() for c in codes]
    routes = results.sparkSession.createDataFrame(pairs, "entity_type string, code string, by_cut boolean")
    x = results.where("result = 'INCORPORADO'").join(F.broadcast(routes), "entity_type").withColumn("day", F.when(F.col("by_cut"), F.col("applied")).otherwise(F.col("business")))
    x = x.where("day is not null").select(F.trunc("day", "month").alias("period_start"), F.last_day("day").alias("period_end"), "applied", "code")
    x = x.withColumn("as_of", F.greatest("period_start", F.least("applied", "period_end")))
    return x.groupBy(*KEY).agg(F.array_join(F.array_sort(F.collect_set("code")), ",").alias("codes"))


def valid_request(requests: DataFrame) -> DataFrame:
    """Requests (… codes array) with `valid`: one whole calendar month, known codes, the cut inside."""
    month = (F.col("period_start") == F.trunc("period_start", "month")) & (F.col("period_end") == F.last_day("period_start"))
    codes = (F.size("codes") > 0) & (F.size(F.array_except("codes", F.array(*[F.lit(c) for c in CODES]))) == 0)
    return requests.withColumn("valid", F.coalesce(month & codes & F.col("as_of").between(F.col("period_start"), F.col("period_end")), F.lit(False)))
