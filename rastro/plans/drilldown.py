"""Drill-downs behind the executive cards and the follow-up agenda."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rastro import schema as S
from rastro.functions.basic import filled, first_filled, low, nonblank
from rastro.functions.dates import NO_DATE, parse_date
from rastro.functions.status import normalize_severity
from rastro.operators import filters as P
from rastro.plans.kpis import is_validated
from rastro.schema import Tables

NO_AREA, NO_OWNER = "Sin área", "Sin asignar"


def _or(c, default: str) -> Column:
    return first_filled(c, F.lit(default))


def open_findings(s: P.Scoped, words: list[str]) -> DataFrame:
    return s.findings.filter(P.open_severity("f_severity", "f_status", words)).select(
        F.col("f_id").alias("id"), F.col("f_code").alias("code"), F.col("f_title").alias("title"),
        F.col("f_severity").alias("severity"), _or("f_responsible_area", NO_AREA).alias("area"),
        F.col("f_status").alias("status"), F.col("r_title").alias("report_title")).orderBy("code", "id")


def _plan_columns() -> list[Column]:
    return [F.col("pa_id").alias("id"), F.col("pa_code").alias("code"), F.col("f_code").alias("finding_code"),
            first_filled("pa_action_text", "pa_title").alias("title"), F.col("pa_status").alias("status"),
            _or("f_severity", "Medio").alias("risk_level"), _or("p_responsible_area", NO_AREA).alias("area"),
            F.col("r_title").alias("report_title")]


def overdue(s: P.Scoped, cut: Column) -> DataFrame:
    dt = F.col("pa_target_dt")
    return (s.plans.filter(P.overdue(dt, "pa_status", cut)).select(
        *_plan_columns(), F.col("pa_target_date").alias("target_date"), F.datediff(cut, dt).alias("days_overdue"),
        F.coalesce("pa_progress_pct", F.lit(0)).alias("progress_pct"), _or("pa_action_owner", NO_OWNER).alias("owner"), dt)
        .orderBy("pa_target_dt", "code").drop("pa_target_dt"))


def pending_validation(s: P.Scoped) -> DataFrame:
    pct = F.col("pa_progress_pct")
    return s.plans.filter(P.pending_validation("pa_progress_pct", "pa_status")).select(
        *_plan_columns(), _or("pa_target_date", NO_DATE).alias("target_date"),
        F.coalesce(F.nullif(pct, F.lit(0)), F.lit(100)).alias("progress_pct"),
        _or("pa_action_owner", NO_OWNER).alias("owner")).orderBy("code", "id")


def validated(s: P.Scoped) -> DataFrame:
    return s.proposals.select(
        F.col("p_id").alias("id"), F.col("p_code").alias("code"), F.col("f_code").alias("finding_code"),
        F.col("p_title").alias("title"), F.col("p_status").alias("status"), _or("f_severity", "Medio").alias("risk_level"),
        F.coalesce(is_validated(), F.lit(False)).alias("is_validated"),
        _or("p_validated_by", "Sin validar").alias("validated_by"), _or("p_validated_at", "-").alias("validated_at"),
        _or("p_responsible_area", NO_AREA).alias("area"), F.col("r_title").alias("report_title")).orderBy("code", "id")


def on_time(s: P.Scoped) -> DataFrame:
    both = nonblank("pa_target_date") & nonblank("pa_closed_date")
    in_time = F.coalesce(parse_date("pa_closed_date") <= F.col("pa_target_dt"), F.lit(False))
    label = F.when(both & in_time, "En plazo").when(both, "Fuera de plazo").otherwise("Excluido (sin fecha)")
    return s.plans.filter(low("pa_status").isin(S.CLOSED3)).select(
        *_plan_columns(), _or("pa_target_date", NO_DATE).alias("target_date"),
        _or("pa_closed_date", NO_DATE).alias("closed_date"), label.alias("compliance")).orderBy("code", "id")


def drilldown(t: Tables, metric: str, cut: Column, scope: P.Scope | None = None) -> DataFrame | None:
    """Rows behind a card; an unknown metric has none."""
    s = P.scoped(t, scope)
    build = {
        "high_risk_open": lambda: open_findings(s, S.HIGH5),
        "medium_risk_open": lambda: open_findings(s, S.MED3),
        "low_risk_open": lambda: open_findings(s, S.LOW3),
        "overdue_commitments": lambda: overdue(s, cut),
        "pending_validation": lambda: pending_validation(s),
        "validated_implementation": lambda: validated(s),
        "on_time_closure": lambda: on_time(s),
        "on_time_closing": lambda: on_time(s),
    }.get(metric)
    return build() if build else None


def agenda(t: Tables, cut: Column, scope: P.Scope | None = None) -> DataFrame:
    """Overdue plans by severity, then by days overdue, with the next action to take."""
    s = P.scoped(t, scope)
    severity = normalize_severity(first_filled("f_severity", "p_severity"))
    awaiting = (F.col("pa_progress_pct") == 100) | (low("pa_status") == "pendiente de validación")
    rank = F.when(severity == "Alto", 1).when(severity == "Medio", 2).otherwise(3)
    area = F.coalesce(filled("p_responsible_area"), filled("f_responsible_area"), F.lit(NO_AREA))
    return s.plans.filter(P.overdue(F.col("pa_target_dt"), "pa_status", cut)).select(
        F.col("pa_id").alias("plan_id"), F.col("pa_code").alias("plan_code"), F.col("p_code").alias("proposal_code"),
        F.col("f_code").alias("finding_code"), F.col("f_title").alias("finding_title"),
        F.col("p_title").alias("proposal_title"), F.col("r_title").alias("report_title"),
        first_filled("pa_action_text", "pa_title").alias("action_text"), area.alias("area"),
        _or("pa_action_owner", NO_OWNER).alias("owner"), F.col("pa_target_date").alias("target_date"),
        F.datediff(cut, F.col("pa_target_dt")).alias("days_overdue"), F.col("pa_status").alias("status"),
        F.coalesce("pa_progress_pct", F.lit(0)).alias("progress_pct"), severity.alias("severity"),
        F.when(awaiting, "Validación formal por auditoría").otherwise("Seguimiento plan vencido con área").alias("next_action"),
        rank.alias("severity_rank"),
    ).orderBy("severity_rank", F.desc("days_overdue"), "plan_code")
