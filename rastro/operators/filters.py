"""Filter predicates of the listings, reports and KPIs, and the scope of the executive views."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rastro import schema as S
from rastro.functions.basic import blank, col, first_filled, low, nonblank
from rastro.functions.dates import parse_date
from rastro.functions.status import same_status
from rastro.operators import hierarchy as H
from rastro.schema import Tables


def any_contains(text: str | None, *cols) -> Column:
    """Case-insensitive literal search in any of the columns; no text means no filter."""
    if not text:
        return F.lit(True)
    hits = [F.coalesce(low(c).contains(text.lower()), F.lit(False)) for c in cols]
    out = hits[0]
    for h in hits[1:]:
        out = out | h
    return out


def equals_ci(c, value: str | None) -> Column:
    return F.lit(True) if not value else low(c) == value.lower()


def finding_filter(severity=None, area=None, search=None) -> Column:
    return (equals_ci("severity", severity) & any_contains(area, "responsible_area")
            & any_contains(search, "title", "situation", "code", "responsible_area"))


def proposal_filter(search=None) -> Column:
    return any_contains(search, "code", "proposal_text", "finding_code", "finding_title")


def plan_filter(search=None) -> Column:
    return any_contains(search, "code", "action_text", "action_owner", "proposal_code", "finding_code")


# --- KPI predicates ------------------------------------------------------------------------------

def open_severity(severity, status, words, closed=S.CLOSED4A) -> Column:
    return low(severity).isin(words) & ~low(status).isin(closed)


def overdue(target_dt: Column, status, cut: Column, excluded=S.OVERDUE_EXCL) -> Column:
    return (target_dt < cut) & ~low(status).isin(excluded)


def suspended_overdue(target_dt: Column, status, cut: Column) -> Column:
    return (target_dt < cut) & low(status).isin(S.SUSP3)


def pending_validation(pct, status) -> Column:
    return ((col(pct) == 100) | (low(status) == "pendiente de validación")) & ~low(status).isin(S.PENDING_EXCL)


def missing_data(owner, target_date) -> Column:
    return blank(owner) | col(owner).contains("Pendiente") | blank(target_date)


def stale(last_updated, status, cut: Column, days: int = 30) -> Column:
    return (col(last_updated) < F.date_sub(cut, days)) & ~low(status).isin(S.CLOSED3)


def open_without_plan(plans_count, client_status) -> Column:
    return (F.coalesce(col(plans_count), F.lit(0)) == 0) & (col(client_status) != S.FINALIZADO)


# --- Screen filters -------------------------------------------------------------------------------

def main_table_filter(report=None, area=None, risk=None, search=None, no_plan=False) -> Column:
    """Over listing rows with ``finalised`` and ``action_plans_count``."""
    out = (equals_ci("report_title", report) & equals_ci("responsible_area", area) & equals_ci("severity", risk)
           & any_contains(search, "code", "title", "situation", "responsible_area", "report_title", "action_owner"))
    if no_plan:
        out = out & (F.coalesce("action_plans_count", F.lit(0)) == 0) & ~F.col("finalised")
    return out


def status_matches(c, wanted: str | None) -> Column:
    return F.lit(True) if not wanted else same_status(c, F.lit(wanted))


def proposal_tab_filter(report_id=None, area=None, status=None, risk=None) -> Column:
    out = status_matches("effective_status", status)
    if report_id:
        out = out & (F.col("report_id") == report_id)
    if area:
        out = out & F.col("responsible_area").eqNullSafe(area)
    if risk:
        out = out & first_filled("finding_severity", "severity").eqNullSafe(risk)
    return out


def decision_filter(key: str | None) -> Column:
    status = low("status")
    done = status.isin("finalizado", "completado", "validado")
    return {
        "high_risk": (low("severity") == "alto") & (status != "finalizado"),
        "overdue": (F.col("days_overdue") > 0) & (status != "finalizado"),
        "validated": done,
        "pending_val": F.col("is_pending_val"),
        "on_time": done & (F.col("days_overdue") == 0),
    }.get(key, F.lit(True))


def history(t: Tables, entity_type=None, entity_id=None) -> DataFrame:
    df = t.audit_history
    if entity_type:
        df = df.filter(F.col("entity_type") == entity_type)
    if entity_id:
        df = df.filter(F.col("entity_id") == entity_id)
    return df.orderBy(F.desc("change_date"), F.desc("id"))


# --- Scope ----------------------------------------------------------------------------------------

@dataclass(frozen=True)
class Scope:
    """Report (id or code), responsible area and period the executive views are limited to."""

    report: str | None = None
    area: str | None = None
    period: str | None = None


@dataclass(frozen=True)
class Scoped:
    """One frame per grain, each row with its ancestors (columns ``r_* f_* p_* pa_*``)."""

    reports: DataFrame
    findings: DataFrame
    proposals: DataFrame
    plans: DataFrame


def scope_reports(t: Tables, scope: Scope) -> DataFrame:
    r = H.report_rows(t)
    if scope.report:
        r = r.filter((F.col("r_id") == scope.report) | (F.col("r_code") == scope.report))
    if scope.period:
        r = r.filter(F.col("r_period").contains(scope.period))
    return r


def scoped(t: Tables, scope: Scope | None = None) -> Scoped:
    """Apply the scope at every grain without fanning findings out over proposals and plans.

    A finding is in an area when its own area matches or any of its proposals' does.
    """
    scope = scope or Scope()
    r = scope_reports(t, scope)
    findings = H.findings_with_report(t, r)
    proposals = H.proposal_rows(t).join(findings, F.col("p_finding_id") == F.col("f_id"))
    plans = None
    if scope.area:
        own = F.coalesce(F.col("f_responsible_area") == scope.area, F.lit(False))
        theirs = F.coalesce(F.col("p_responsible_area") == scope.area, F.lit(False))
        touched = (t.proposals.filter(F.col("responsible_area") == scope.area)
                   .groupBy(F.col("finding_id").alias("f_id")).agg(F.lit(True).alias("__touched")))
        proposals = proposals.filter(own | theirs)
        findings = (findings.join(touched, "f_id", "left")
                    .filter(own | F.col("__touched").isNotNull()).drop("__touched"))
        r = findings.select(*[c for c in findings.columns if c.startswith("r_")]).dropDuplicates(["r_id"])
    plans = H.plan_rows(t).join(proposals, F.col("pa_proposal_id") == F.col("p_id"))
    plans = plans.withColumn("pa_target_dt", parse_date("pa_target_date"))
    return Scoped(r, findings, proposals, plans)
