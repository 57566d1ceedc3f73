"""Active alerts: dated items, missing children, stale plans, new evidence, missing data.

Each table is read once: a row emits all its alerts, and only these few meet their ancestors. Plans' alerts take the
finding from their proposal, all alerts then the report's auditor; what has no report gives none.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rastro import schema as S
from rastro.functions.basic import first_filled, low, nonblank
from rastro.functions.dates import parse_date
from rastro.operators import filters as P
from rastro.operators import hierarchy as H
from rastro.schema import Tables

PLAN_KINDS = ("dated", "stale", "evidence")
PROPOSAL_KINDS = ("dated", "no_plan", "incomplete")
FINDING_KINDS = ("no_proposal",)
KINDS = ("dated", "no_plan", "no_proposal", "stale", "evidence", "incomplete")


def _alert(title, level, color, message: Column) -> Column:
    lit = lambda v: v if isinstance(v, Column) else F.lit(v)
    return F.struct(title.alias("title"), lit(level).alias("level"), lit(color).alias("badge_color"), message.alias("message"))


def _about(text: str) -> Column:
    return F.concat("code", F.lit(text))


def _emit(rows: DataFrame, parent: str, alerts: list[tuple[Column, Column]]) -> DataFrame:
    """One row per alert whose condition holds: id, code, the parent's key and the alert's fields."""
    due = rows.filter(reduce(lambda a, b: a | b, [F.coalesce(cond, F.lit(False)) for cond, _ in alerts]))
    raised = F.filter(F.array(*[F.when(cond, alert) for cond, alert in alerts]), lambda a: a.isNotNull())
    return due.select("id", "code", F.col(parent).alias("parent_id"), F.inline(raised))


def _dated(text: Column, status_out: list[str], cut: Column) -> tuple[Column, Column]:
    """Open and with a date: overdue, due today, or due within seven days."""
    days = F.datediff(parse_date("target_date"), cut)
    level = F.when(days < 0, "vencida").when(days == 0, "hoy").otherwise("proximo")
    color = F.when(days < 0, "rojo").when(days == 0, "naranja").otherwise("amarillo")
    message = (F.when(days < 0, F.concat("code", F.lit(" lleva "), (-days).cast("string"), F.lit(" días vencida.")))
               .when(days == 0, _about(" vence hoy."))
               .otherwise(F.concat("code", F.lit(" vence en "), days.cast("string"), F.lit(" días."))))
    return ~low("status").isin(status_out) & (days <= 7), _alert(text, level, color, message)


def _plan_alerts(t: Tables, cut: Column | None, kinds) -> DataFrame:
    plans, out = t.action_plans, []
    own = {
        "dated": lambda: _dated(first_filled("action_text", "title"), S.CLOSED3, cut),
        "stale": lambda: (P.stale("last_updated", "status", cut),
                          _alert(F.col("action_text"), "atencion", "amarillo", _about(" no registra actualizaciones desde hace 30 días."))),
    }
    alerts = [own[k]() for k in own if k in kinds]
    if alerts:
        out.append(_emit(plans, "proposal_id", alerts))
    if "evidence" in kinds:
        # A report of the three most recent files, picked before anything is joined.
        latest = (plans.filter(nonblank("evidence_file")).select("id", "code", "proposal_id", "evidence_file", "last_updated")
                  .orderBy(F.col("last_updated").desc_nulls_last(), "id").limit(3))
        out.append(_emit(latest, "proposal_id", [(F.lit(True), _alert(
            F.concat(F.lit("Archivo: "), "evidence_file"), "atencion", "verde",
            F.concat(F.lit("Nueva evidencia cargada para "), "code", F.lit("."))))]))
    return reduce(DataFrame.unionByName, out)


def _proposal_alerts(t: Tables, cut: Column | None, kinds) -> DataFrame:
    rows, text = t.proposals, first_filled("proposal_text", "title")
    if "no_plan" in kinds:
        rows = _with_count(rows, t.action_plans, "proposal_id")
    own = {
        "dated": lambda: _dated(text, S.PROP_CLOSED, cut),
        "no_plan": lambda: (F.col("__children").isNull(), _alert(text, "atencion", "azul", _about(" continúa sin Plan de Acción asociado."))),
        "incomplete": lambda: (P.missing_data("action_owner", "target_date"),
                               _alert(text, "atencion", "naranja", _about(" requiere definir responsable o fecha compromiso."))),
    }
    return _emit(rows, "finding_id", [own[k]() for k in own if k in kinds])


def _finding_alerts(t: Tables) -> DataFrame:
    rows = _with_count(t.findings.filter(low("severity") == "alto"), t.proposals, "finding_id")
    return _emit(rows, "report_id", [(F.col("__children").isNull(), _alert(
        F.col("title"), "atencion", "rojo", _about(" de riesgo Alto no posee una Propuesta de Mejora asociada.")))])


def _with_count(parents: DataFrame, children: DataFrame, parent_key: str) -> DataFrame:
    """Parents with the number of their children (NULL for none), counted before the join: one row a parent."""
    counts = H.child_counts(children, parent_key, "__children").withColumnRenamed(parent_key, "id")
    return parents.join(counts, "id", "left")


def active_alerts(t: Tables, cut: Column | None, kinds=KINDS) -> DataFrame:
    """id, code, finding_id, title, auditor, level, badge_color and message of every alert of the kinds asked for.

    ``cut`` is needed for dated and stale alerts only. At most five joins, each with a side that has one row a key and
    with the alerts on the left, where a report or proposal with very many of them can be split at run time.
    """
    below = []
    if set(kinds) & set(PLAN_KINDS):
        finding_of = t.proposals.select(F.col("id").alias("parent_id"), F.col("finding_id"))
        plans = _plan_alerts(t, cut, kinds).join(finding_of, "parent_id").drop("parent_id")
        below.append(plans.withColumnRenamed("finding_id", "parent_id"))
    if set(kinds) & set(PROPOSAL_KINDS):
        below.append(_proposal_alerts(t, cut, kinds))
    rows = []
    if below:
        report_of = t.findings.select(F.col("id").alias("parent_id"), "report_id")
        alerts = reduce(DataFrame.unionByName, below).join(report_of, "parent_id")
        rows.append(alerts.withColumnRenamed("parent_id", "finding_id"))
    if set(kinds) & set(FINDING_KINDS):
        rows.append(_finding_alerts(t).withColumn("finding_id", F.col("id")).withColumnRenamed("parent_id", "report_id"))
    auditors = t.reports.select(F.col("id").alias("report_id"), first_filled("auditor", F.lit(S.DEFAULT_AUDITOR)).alias("auditor"))
    return (reduce(DataFrame.unionByName, rows).join(auditors, "report_id")
            .select("id", "code", "finding_id", "title", "auditor", "level", "badge_color", "message"))


def dated_items(t: Tables, cut: Column) -> DataFrame:
    """Open proposals and plans with a date: overdue, due today, or due within seven days."""
    return active_alerts(t, cut, ("dated",))


def proposals_without_plan(t: Tables) -> DataFrame:
    return active_alerts(t, None, ("no_plan",))


def high_findings_without_proposal(t: Tables) -> DataFrame:
    return active_alerts(t, None, ("no_proposal",))


def stale_plans(t: Tables, cut: Column) -> DataFrame:
    return active_alerts(t, cut, ("stale",))


def recent_evidence(t: Tables) -> DataFrame:
    """The three most recent evidence files."""
    return active_alerts(t, None, ("evidence",))


def incomplete_proposals(t: Tables) -> DataFrame:
    return active_alerts(t, None, ("incomplete",))


def alert_totals(t: Tables, cut: Column) -> DataFrame:
    return active_alerts(t, cut).groupBy("level").agg(F.count(F.lit(1)).alias("total"))
