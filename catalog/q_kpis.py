"""Registered queries: KPIs, drill-downs, agenda, alerts."""

from pyspark.sql import functions as F

from catalog import sqltext as Q
from catalog.registry import query
from catalog.sqltext import CUT
from catalog.views import Db
from rastro.operators import filters as P
from rastro.plans import alerts, drilldown, kpis, listings

AREA, REPORT, PERIOD = "Área 3", "AUD-2026-107", "2023"
AREA_SQL = f"(f.responsible_area = '{AREA}' OR p.responsible_area = '{AREA}')"

query("table_counts", """
SELECT 'reports' AS table_name, count(*) AS rows FROM reports UNION ALL SELECT 'findings', count(*) FROM findings
UNION ALL SELECT 'proposals', count(*) FROM proposals UNION ALL SELECT 'action_plans', count(*) FROM action_plans
UNION ALL SELECT 'audit_history', count(*) FROM audit_history""")(lambda db: kpis.table_counts(db.t))

query("report_rollup", f"""
SELECT r.id, r.code, r.title, count(DISTINCT f.id) AS findings_count, count(DISTINCT p.id) AS proposals_count,
  count(DISTINCT pa.id) AS action_plans_count,
  count(DISTINCT CASE WHEN lower(pa.status) NOT IN ('finalizado','completado','cerrado','archivada') THEN pa.id END) AS pending_plans_count
FROM {Q.ALL4} GROUP BY r.id, r.code, r.title""")(lambda db: kpis.report_rollup(db.t).select(
    "id", "code", "title", "findings_count", "proposals_count", "action_plans_count", "pending_plans_count"))

query("dashboard_scalars", f"""
SELECT (SELECT count(*) FROM findings WHERE lower(status) NOT IN {Q.CLOSED3}) AS open_findings,
  (SELECT count(*) FROM findings WHERE lower(severity) IN {Q.HIGH7} AND lower(status) NOT IN {Q.CLOSED3}) AS high_risk_findings,
  (SELECT count(*) FROM proposals) AS total_proposals,
  (SELECT count(*) FROM action_plans WHERE {Q.date('target_date')} < {CUT} AND lower(status) NOT IN {Q.CLOSED3}) AS overdue_plans,
  (SELECT count(*) FROM action_plans) AS total_plans,
  (SELECT count(*) FROM action_plans WHERE lower(status) IN {Q.CLOSED3}) AS completed_plans,
  (SELECT round_even(count(*) FILTER (WHERE lower(status) IN {Q.CLOSED3})::DOUBLE / count(*) * 100, 1) FROM action_plans) AS impl_rate
""")(lambda db: kpis.dashboard_scalars(db.t, db.cut))

query("severity_breakdown", f"""
SELECT d.severity, count(f.id) AS total FROM (VALUES ('Alto'), ('Medio'), ('Bajo')) d(severity)
LEFT JOIN findings f ON {Q.norm_severity('f.severity')} = d.severity GROUP BY d.severity""")(
    lambda db: kpis.severity_breakdown(db.t))

query("status_breakdown", f"""
SELECT {Q.norm_status('status')} AS status, count(*) AS total FROM findings GROUP BY 1""")(
    lambda db: kpis.status_breakdown(db.t))

query("area_breakdown", f"""
SELECT responsible_area, count(*) AS total, sum(CASE WHEN lower(status) IN {Q.CLOSED3} THEN 1 ELSE 0 END)::BIGINT AS closed
FROM findings GROUP BY responsible_area""")(lambda db: kpis.area_breakdown(db.t))

query("finding_aging", f"""
WITH a AS (SELECT date_diff('day', created_at, {CUT}) AS d FROM findings WHERE lower(status) NOT IN {Q.CLOSED3})
SELECT b.bucket, count(a.d) AS total FROM (VALUES ('0-30 días', -100000, 30), ('31-60 días', 31, 60), ('61-90 días', 61, 90),
  ('Más de 90 días', 91, 100000)) b(bucket, lo, hi) LEFT JOIN a ON a.d BETWEEN b.lo AND b.hi GROUP BY b.bucket""")(
    lambda db: kpis.finding_aging(db.t, db.cut))

query("critical_pending", f"""
SELECT f.code, pa.code AS plan_code, f.title, f.severity, f.responsible_area AS area, f.action_owner AS owner,
  coalesce(nullif(pa.target_date, ''), CAST({CUT} AS VARCHAR)) AS target_date,
  greatest(coalesce(date_diff('day', {Q.date('pa.target_date')}, {CUT}), 0), 0)::INT AS days_overdue
FROM findings f LEFT JOIN proposals p ON p.finding_id = f.id LEFT JOIN action_plans pa ON pa.proposal_id = p.id
WHERE lower(f.severity) = 'alto' OR ({Q.date('pa.target_date')} < {CUT} AND lower(pa.status) NOT IN ('finalizado','completado'))
ORDER BY f.severity DESC NULLS LAST, {Q.date('pa.target_date')} ASC NULLS FIRST, f.code, pa.code NULLS FIRST LIMIT 10""")(
    lambda db: kpis.critical_pending(db.t, db.cut))


def _scope_sql(where: str) -> str:
    return f"""SELECT count(DISTINCT r.id) AS reports, count(DISTINCT f.id) AS findings, count(DISTINCT p.id) AS proposals,
      count(DISTINCT pa.id) AS plans FROM {Q.ALL4} WHERE {where}"""


query("scope_counts", _scope_sql("true"))(lambda db: kpis.scope_counts(db.t, db.cut))
query("scope_counts_area", _scope_sql(AREA_SQL))(
    lambda db: kpis.scope_counts(db.t, db.cut, P.Scope(area=AREA)))
query("scope_counts_report", _scope_sql(f"(r.id = '{REPORT}' OR r.code = '{REPORT}')"))(
    lambda db: kpis.scope_counts(db.t, db.cut, P.Scope(report=REPORT)))
query("scope_counts_period_area", _scope_sql(f"(r.period = '{PERIOD}' OR r.period LIKE '%{PERIOD}%') AND {AREA_SQL}"))(
    lambda db: kpis.scope_counts(db.t, db.cut, P.Scope(area=AREA, period=PERIOD)))


def _severity_sql(where: str) -> str:
    open_ = f"lower(f.status) NOT IN {Q.CLOSED4}"
    return f"""SELECT count(DISTINCT CASE WHEN lower(f.severity) IN {Q.HIGH5} AND {open_} THEN f.id END) AS high_risk_open,
      count(DISTINCT CASE WHEN lower(f.severity) IN {Q.MED3} AND {open_} THEN f.id END) AS medium_risk_open,
      count(DISTINCT CASE WHEN lower(f.severity) IN {Q.LOW3} AND {open_} THEN f.id END) AS low_risk_open,
      count(DISTINCT CASE WHEN lower(f.severity) IN {Q.HIGH5} AND {open_} THEN f.report_id END) AS affected_reports
    FROM {Q.LEFT4} WHERE {where}"""


query("kpi_open_by_severity", _severity_sql("true"))(lambda db: kpis.open_by_severity(db.t, db.cut))
query("kpi_open_by_severity_area", _severity_sql(AREA_SQL))(
    lambda db: kpis.open_by_severity(db.t, db.cut, P.Scope(area=AREA)))

LATE = f"{Q.date('pa.target_date')} < {CUT} AND lower(pa.status) NOT IN {Q.LATE_OUT}"


def _overdue_sql(where: str) -> str:
    return f"""SELECT count(DISTINCT CASE WHEN {LATE} THEN pa.id END) AS overdue_plans,
      count(DISTINCT CASE WHEN {LATE} THEN p.finding_id END) AS affected_findings,
      count(DISTINCT CASE WHEN {Q.date('pa.target_date')} < {CUT} AND lower(pa.status) IN {Q.SUSP3} THEN pa.id END) AS suspended_overdue
    FROM {Q.INNER4} WHERE {where}"""


query("kpi_overdue_commitments", _overdue_sql("true"))(lambda db: kpis.overdue_commitments(db.t, db.cut))
query("kpi_overdue_commitments_area", _overdue_sql(AREA_SQL))(
    lambda db: kpis.overdue_commitments(db.t, db.cut, P.Scope(area=AREA)))

query("kpi_proposal_states", f"""
SELECT d.state, count(x.id) AS total FROM (VALUES ('En proceso'), ('En suspensión'), ('Pendiente de validación'), ('Finalizado')) d(state)
LEFT JOIN (SELECT DISTINCT p.id, {Q.norm_status('p.status')} AS state FROM {Q.PROPS3}) x ON x.state = d.state GROUP BY d.state""")(
    lambda db: kpis.proposal_states(P.scoped(db.t)))

VALID = f"lower(p.status) IN ('finalizado','completado','cerrado','validado') AND p.validated_by IS NOT NULL AND p.validated_by <> ''"
query("kpi_validated_implementation", f"""
SELECT count(DISTINCT CASE WHEN {VALID} THEN p.id END) AS validated, count(DISTINCT p.id) AS total,
  round_even(count(DISTINCT CASE WHEN {VALID} THEN p.id END)::DOUBLE / nullif(count(DISTINCT p.id), 0) * 100, 1) AS rate
FROM {Q.PROPS3}""")(lambda db: kpis.validated_implementation(P.scoped(db.t)))

DATES = "coalesce(pa.closed_date, '') <> '' AND coalesce(pa.target_date, '') <> ''"
DONE = f"lower(pa.status) IN {Q.CLOSED3}"
IN_TIME = f"{DONE} AND {DATES} AND {Q.date('pa.closed_date')} <= {Q.date('pa.target_date')}"


def _on_time_sql(where: str) -> str:
    return f"""SELECT count(*) FILTER (WHERE {IN_TIME}) AS on_time, count(*) FILTER (WHERE {DONE} AND {DATES}) AS evaluable,
      count(*) FILTER (WHERE {DONE} AND NOT ({DATES})) AS excluded,
      round_even(count(*) FILTER (WHERE {IN_TIME})::DOUBLE / nullif(count(*) FILTER (WHERE {DONE} AND {DATES}), 0) * 100, 1) AS rate
    FROM {Q.INNER4} WHERE {where}"""


query("kpi_on_time_closure", _on_time_sql("true"))(lambda db: kpis.on_time_closure(P.scoped(db.t)))
query("kpi_on_time_closure_period", _on_time_sql(f"r.period LIKE '%{PERIOD}%'"))(
    lambda db: kpis.on_time_closure(P.scoped(db.t, P.Scope(period=PERIOD))))

PENDING = ("(pa.progress_pct = 100 OR lower(pa.status) = 'pendiente de validación') "
           "AND lower(pa.status) NOT IN ('finalizado','validado','cerrado')")
query("kpi_pending_validation", f"SELECT count(DISTINCT pa.id) AS pending_validation FROM {Q.INNER4} WHERE {PENDING}")(
    lambda db: kpis.pending_validation_count(P.scoped(db.t)))


def _area_sql(where: str) -> str:
    open_ = f"lower(f.status) NOT IN {Q.CLOSED3}"
    late = f"{Q.date('pa.target_date')} < {CUT} AND lower(pa.status) NOT IN ('finalizado','completado','cerrado','en suspensión','en suspension','stand-by')"
    return f"""SELECT * FROM (SELECT coalesce(nullif(f.responsible_area, ''), nullif(p.responsible_area, ''), 'Sin área') AS area,
      count(DISTINCT CASE WHEN lower(f.severity) IN {Q.HIGH5} AND {open_} THEN f.id END) AS high_risk_open,
      count(DISTINCT CASE WHEN lower(f.severity) IN {Q.MED3} AND {open_} THEN f.id END) AS medium_risk_open,
      count(DISTINCT CASE WHEN lower(f.severity) IN {Q.LOW3} AND {open_} THEN f.id END) AS low_risk_open,
      count(DISTINCT CASE WHEN {late} THEN pa.id END) AS overdue
    FROM {Q.LEFT4} WHERE {where} GROUP BY 1) x WHERE high_risk_open > 0 OR medium_risk_open > 0 OR low_risk_open > 0 OR overdue > 0"""


query("kpi_area_comparison", _area_sql("true"))(lambda db: kpis.area_comparison(db.t, db.cut))
query("kpi_area_comparison_area", _area_sql(AREA_SQL))(
    lambda db: kpis.area_comparison(db.t, db.cut, P.Scope(area=AREA)))

query("kpi_overdue_aging", f"""
WITH a AS (SELECT date_diff('day', {Q.date('pa.target_date')}, {CUT}) AS d FROM {Q.INNER4} WHERE {LATE})
SELECT b.bucket, count(a.d) AS total FROM (VALUES ('1-30 días', 1, 30), ('31-60 días', 31, 60), ('Más de 60 días', 61, 1000000)) b(bucket, lo, hi)
LEFT JOIN a ON a.d BETWEEN b.lo AND b.hi GROUP BY b.bucket""")(lambda db: kpis.overdue_aging(P.scoped(db.t), db.cut))


def _summary_sql(where: str) -> str:
    one = lambda name, value, source: f"SELECT '{name}' AS metric, CAST({value} AS DOUBLE) AS value FROM {source} WHERE {where}"
    open_ = f"lower(f.status) NOT IN {Q.CLOSED4}"
    distinct = lambda cond, key: f"count(DISTINCT CASE WHEN {cond} THEN {key} END)"
    parts = [
        one("scope_reports", "count(DISTINCT r.id)", Q.ALL4), one("scope_findings", "count(DISTINCT f.id)", Q.ALL4),
        one("scope_proposals", "count(DISTINCT p.id)", Q.ALL4), one("scope_plans", "count(DISTINCT pa.id)", Q.ALL4),
        one("high_risk_open", distinct(f"lower(f.severity) IN {Q.HIGH5} AND {open_}", "f.id"), Q.LEFT4),
        one("medium_risk_open", distinct(f"lower(f.severity) IN {Q.MED3} AND {open_}", "f.id"), Q.LEFT4),
        one("low_risk_open", distinct(f"lower(f.severity) IN {Q.LOW3} AND {open_}", "f.id"), Q.LEFT4),
        one("high_risk_reports", distinct(f"lower(f.severity) IN {Q.HIGH5} AND {open_}", "f.report_id"), Q.LEFT4),
        one("validated_proposals", distinct(VALID, "p.id"), Q.PROPS3),
        one("validated_rate", f"round_even({distinct(VALID, 'p.id')}::DOUBLE / nullif(count(DISTINCT p.id), 0) * 100, 1)", Q.PROPS3),
        one("overdue_plans", distinct(LATE, "pa.id"), Q.INNER4), one("overdue_findings", distinct(LATE, "p.finding_id"), Q.INNER4),
        one("suspended_overdue", distinct(f"{Q.date('pa.target_date')} < {CUT} AND lower(pa.status) IN {Q.SUSP3}", "pa.id"), Q.INNER4),
        one("pending_validation", distinct(PENDING, "pa.id"), Q.INNER4), one("on_time", distinct(IN_TIME, "pa.id"), Q.INNER4),
        one("evaluable", distinct(f"{DONE} AND {DATES}", "pa.id"), Q.INNER4),
        one("excluded", distinct(f"{DONE} AND NOT ({DATES})", "pa.id"), Q.INNER4),
        one("on_time_rate", f"round_even({distinct(IN_TIME, 'pa.id')}::DOUBLE / nullif({distinct(f'{DONE} AND {DATES}', 'pa.id')}, 0) * 100, 1)", Q.INNER4),
    ] + [one(f"state: {s}", distinct(f"{Q.norm_status('p.status')} = '{s}'", "p.id"), Q.PROPS3)
         for s in ("En proceso", "En suspensión", "Pendiente de validación", "Finalizado")]
    return "\nUNION ALL ".join(parts)


query("kpi_executive_summary", _summary_sql("true"))(lambda db: kpis.executive_summary(db.t, db.cut))
query("kpi_executive_summary_scoped", _summary_sql(f"r.period LIKE '%{PERIOD}%' AND {AREA_SQL}"))(
    lambda db: kpis.executive_summary(db.t, db.cut, P.Scope(area=AREA, period=PERIOD)))

def _cube_sql() -> str:
    open_ = f"lower(f.status) NOT IN {Q.CLOSED4}"
    distinct = lambda name, cond, key: f'count(DISTINCT CASE WHEN {cond} THEN {key} END) AS "{name}"'
    measures = ", ".join([
        distinct("findings", "true", "f.id"), distinct("high_risk_open", f"lower(f.severity) IN {Q.HIGH5} AND {open_}", "f.id"),
        distinct("medium_risk_open", f"lower(f.severity) IN {Q.MED3} AND {open_}", "f.id"),
        distinct("low_risk_open", f"lower(f.severity) IN {Q.LOW3} AND {open_}", "f.id"), distinct("overdue_findings", LATE, "f.id"),
        distinct("proposals", "true", "p.id"), distinct("validated_proposals", VALID, "p.id"),
        *[distinct(f"state: {s}", f"{Q.norm_status('p.status')} = '{s}'", "p.id") for s in ("En proceso", "En suspensión", "Pendiente de validación", "Finalizado")],
        distinct("plans", "true", "pa.id"), distinct("overdue_plans", LATE, "pa.id"),
        distinct("suspended_overdue", f"{Q.date('pa.target_date')} < {CUT} AND lower(pa.status) IN {Q.SUSP3}", "pa.id"),
        distinct("pending_validation", PENDING, "pa.id"), distinct("on_time", IN_TIME, "pa.id"),
        distinct("evaluable", f"{DONE} AND {DATES}", "pa.id"), distinct("excluded", f"{DONE} AND NOT ({DATES})", "pa.id")])
    return f"""WITH place AS (SELECT id AS fid, responsible_area AS area, false AS whole FROM findings WHERE responsible_area IS NOT NULL
      UNION SELECT finding_id, responsible_area, false FROM proposals WHERE responsible_area IS NOT NULL UNION ALL SELECT id, NULL, true FROM findings)
    SELECT r.id AS report_id, r.code AS report_code, r.period, x.area, coalesce(x.whole, true) AS all_areas, {measures}
    FROM reports r LEFT JOIN (findings f JOIN place x ON x.fid = f.id) ON f.report_id = r.id
      LEFT JOIN proposals p ON p.finding_id = f.id AND (x.whole OR f.responsible_area = x.area OR p.responsible_area = x.area)
      LEFT JOIN action_plans pa ON pa.proposal_id = p.id GROUP BY ALL"""


query("kpi_scope_cube", _cube_sql())(lambda db: kpis.scope_cube(db.t, db.cut))

query("area_list", """
SELECT coalesce(nullif(responsible_area, ''), 'Operaciones') AS area, count(*) AS total,
  count(*) FILTER (WHERE lower(severity) = 'alto') AS high, count(*) FILTER (WHERE lower(coalesce(status, '')) <> 'finalizado') AS open,
  count(*) FILTER (WHERE lower(status) = 'finalizado') AS closed,
  CAST(floor(count(*) FILTER (WHERE lower(status) = 'finalizado')::DOUBLE / count(*) * 100 + 0.5) AS BIGINT) AS closed_pct
FROM findings GROUP BY 1""")(lambda db: kpis.area_list(db.t))

query("sidebar_metrics", f"""
SELECT (SELECT count(*) FROM findings WHERE {Q.client('status', 'NULL::DATE')} <> 'Finalizado') AS open_findings,
  (SELECT CAST(floor(count(*) FILTER (WHERE {Q.client('status', 'NULL::DATE')} = 'Finalizado')::DOUBLE / count(*) * 100 + 0.5) AS BIGINT) FROM action_plans) AS plans_done_pct
""")(lambda db: kpis.sidebar_metrics(db.t, db.cut))

query("plan_pie", f"""
SELECT count(*) - count(*) FILTER (WHERE {Q.date('target_date')} < {CUT} AND lower(status) NOT IN {Q.CLOSED3}) AS on_time,
  count(*) FILTER (WHERE {Q.date('target_date')} < {CUT} AND lower(status) NOT IN {Q.CLOSED3}) AS overdue FROM action_plans""")(
    lambda db: kpis.plan_pie(db.t, db.cut))

query("filter_options_reports", "SELECT DISTINCT id, code, title FROM reports")(lambda db: kpis.report_options(db.t))
query("filter_options_areas", """
SELECT responsible_area FROM findings WHERE responsible_area <> '' UNION SELECT responsible_area FROM proposals WHERE responsible_area <> ''
""")(lambda db: kpis.area_options(db.t))
query("filter_options_periods", "SELECT DISTINCT period FROM reports WHERE period <> ''")(lambda db: kpis.period_options(db.t))

# --- Drill-downs -----------------------------------------------------------------------------------


def _open_sql(words: str, where: str = "true") -> str:
    return f"""SELECT DISTINCT f.id, f.code, f.title, f.severity, coalesce(nullif(f.responsible_area, ''), 'Sin área') AS area, f.status,
      r.title AS report_title FROM {Q.LEFT4} WHERE lower(f.severity) IN {words} AND lower(f.status) NOT IN {Q.CLOSED4} AND {where}"""


PLAN = """pa.id, pa.code, f.code AS finding_code, coalesce(nullif(pa.action_text, ''), pa.title) AS title, pa.status,
  coalesce(nullif(f.severity, ''), 'Medio') AS risk_level, coalesce(nullif(p.responsible_area, ''), 'Sin área') AS area, r.title AS report_title"""

for _metric, _sql in {
    "high_risk_open": _open_sql(Q.HIGH5), "medium_risk_open": _open_sql(Q.MED3), "low_risk_open": _open_sql(Q.LOW3),
    "overdue_commitments": f"""SELECT DISTINCT {PLAN}, pa.target_date, date_diff('day', {Q.date('pa.target_date')}, {CUT})::INT AS days_overdue,
      coalesce(pa.progress_pct, 0) AS progress_pct, coalesce(nullif(pa.action_owner, ''), 'Sin asignar') AS owner FROM {Q.INNER4} WHERE {LATE}""",
    "pending_validation": f"""SELECT DISTINCT {PLAN}, coalesce(nullif(pa.target_date, ''), 'Sin fecha') AS target_date,
      coalesce(nullif(pa.progress_pct, 0), 100) AS progress_pct, coalesce(nullif(pa.action_owner, ''), 'Sin asignar') AS owner
      FROM {Q.INNER4} WHERE {PENDING}""",
    "validated_implementation": f"""SELECT DISTINCT p.id, p.code, f.code AS finding_code, p.title, p.status,
      coalesce(nullif(f.severity, ''), 'Medio') AS risk_level, coalesce({VALID}, false) AS is_validated,
      coalesce(nullif(p.validated_by, ''), 'Sin validar') AS validated_by, coalesce(nullif(p.validated_at, ''), '-') AS validated_at,
      coalesce(nullif(p.responsible_area, ''), 'Sin área') AS area, r.title AS report_title FROM {Q.PROPS3}""",
    "on_time_closure": f"""SELECT DISTINCT {PLAN}, coalesce(nullif(pa.target_date, ''), 'Sin fecha') AS target_date,
      coalesce(nullif(pa.closed_date, ''), 'Sin fecha') AS closed_date,
      CASE WHEN NOT ({DATES}) THEN 'Excluido (sin fecha)' WHEN {Q.date('pa.closed_date')} <= {Q.date('pa.target_date')} THEN 'En plazo'
      ELSE 'Fuera de plazo' END AS compliance FROM {Q.INNER4} WHERE {DONE}""",
}.items():
    query(f"drill_{_metric}", _sql)(lambda db, m=_metric: drilldown.drilldown(db.t, m, db.cut))

query("drill_high_risk_open_area", _open_sql(Q.HIGH5, AREA_SQL))(
    lambda db: drilldown.drilldown(db.t, "high_risk_open", db.cut, P.Scope(area=AREA)))

query("follow_up_agenda", f"""
SELECT pa.id AS plan_id, pa.code AS plan_code, p.code AS proposal_code, f.code AS finding_code, f.title AS finding_title,
  p.title AS proposal_title, r.title AS report_title, coalesce(nullif(pa.action_text, ''), pa.title) AS action_text,
  coalesce(nullif(p.responsible_area, ''), nullif(f.responsible_area, ''), 'Sin área') AS area,
  coalesce(nullif(pa.action_owner, ''), 'Sin asignar') AS owner, pa.target_date,
  date_diff('day', {Q.date('pa.target_date')}, {CUT})::INT AS days_overdue, pa.status, coalesce(pa.progress_pct, 0) AS progress_pct,
  {Q.norm_severity("coalesce(nullif(f.severity, ''), p.severity)")} AS severity,
  CASE WHEN pa.progress_pct = 100 OR lower(pa.status) = 'pendiente de validación' THEN 'Validación formal por auditoría'
       ELSE 'Seguimiento plan vencido con área' END AS next_action,
  CASE {Q.norm_severity("coalesce(nullif(f.severity, ''), p.severity)")} WHEN 'Alto' THEN 1 WHEN 'Medio' THEN 2 ELSE 3 END AS severity_rank
FROM {Q.INNER4} WHERE {LATE}""")(lambda db: drilldown.agenda(db.t, db.cut))

# --- Alerts ----------------------------------------------------------------------------------------

_AUD = "coalesce(nullif(r.auditor, ''), 'Auditoría Interna') AS auditor"
_PTEXT = "coalesce(nullif(p.proposal_text, ''), p.title) AS title"
DATED = f"""SELECT id, code, finding_id, title, auditor,
  CASE WHEN d < 0 THEN 'vencida' WHEN d = 0 THEN 'hoy' ELSE 'proximo' END AS level,
  CASE WHEN d < 0 THEN 'rojo' WHEN d = 0 THEN 'naranja' ELSE 'amarillo' END AS badge_color,
  CASE WHEN d < 0 THEN code || ' lleva ' || CAST(-d AS VARCHAR) || ' días vencida.' WHEN d = 0 THEN code || ' vence hoy.'
       ELSE code || ' vence en ' || CAST(d AS VARCHAR) || ' días.' END AS message
FROM (SELECT p.id, p.code, f.id AS finding_id, {_PTEXT}, {_AUD}, date_diff('day', {CUT}, {Q.date('p.target_date')}) AS d
  FROM {Q.PROPS3} WHERE lower(p.status) NOT IN ('finalizado','completada','cerrada','implementada')
  UNION ALL SELECT pa.id, pa.code, f.id, coalesce(nullif(pa.action_text, ''), pa.title), {_AUD}, date_diff('day', {CUT}, {Q.date('pa.target_date')})
  FROM {Q.INNER4} WHERE lower(pa.status) NOT IN {Q.CLOSED3}) x WHERE d <= 7"""
NO_PLAN = f"""SELECT p.id, p.code, f.id AS finding_id, {_PTEXT}, {_AUD}, 'atencion' AS level, 'azul' AS badge_color,
  p.code || ' continúa sin Plan de Acción asociado.' AS message FROM {Q.PROPS3}
  LEFT JOIN action_plans pa ON pa.proposal_id = p.id WHERE pa.id IS NULL"""
NO_PROPOSAL = f"""SELECT f.id, f.code, f.id AS finding_id, f.title, {_AUD}, 'atencion' AS level, 'rojo' AS badge_color,
  f.code || ' de riesgo Alto no posee una Propuesta de Mejora asociada.' AS message
  FROM findings f JOIN reports r ON f.report_id = r.id LEFT JOIN proposals p ON p.finding_id = f.id
  WHERE lower(f.severity) = 'alto' AND p.id IS NULL"""
STALE = f"""SELECT pa.id, pa.code, f.id AS finding_id, pa.action_text AS title, {_AUD}, 'atencion' AS level, 'amarillo' AS badge_color,
  pa.code || ' no registra actualizaciones desde hace 30 días.' AS message FROM {Q.INNER4}
  WHERE pa.last_updated < {CUT} - INTERVAL '30' DAY AND lower(pa.status) NOT IN {Q.CLOSED3}"""
EVIDENCE = f"""SELECT id, code, finding_id, title, auditor, level, badge_color, message FROM (
  SELECT pa.id, pa.code, f.id AS finding_id, 'Archivo: ' || pa.evidence_file AS title, {_AUD}, 'atencion' AS level, 'verde' AS badge_color,
  'Nueva evidencia cargada para ' || pa.code || '.' AS message FROM {Q.INNER4} WHERE pa.evidence_file <> ''
  ORDER BY pa.last_updated DESC NULLS LAST, pa.id LIMIT 3) e"""
INCOMPLETE = f"""SELECT p.id, p.code, f.id AS finding_id, {_PTEXT}, {_AUD}, 'atencion' AS level, 'naranja' AS badge_color,
  p.code || ' requiere definir responsable o fecha compromiso.' AS message FROM {Q.PROPS3}
  WHERE p.action_owner IS NULL OR p.action_owner = '' OR p.action_owner LIKE '%Pendiente%' OR p.target_date IS NULL OR p.target_date = ''"""
ALERTS = "\nUNION ALL ".join(f"({x})" for x in (DATED, NO_PLAN, NO_PROPOSAL, STALE, EVIDENCE, INCOMPLETE))

query("alerts_dated", DATED)(lambda db: alerts.dated_items(db.t, db.cut))
query("alerts_proposal_without_plan", NO_PLAN)(lambda db: alerts.proposals_without_plan(db.t))
query("alerts_high_without_proposal", NO_PROPOSAL)(lambda db: alerts.high_findings_without_proposal(db.t))
query("alerts_stale_plans", STALE)(lambda db: alerts.stale_plans(db.t, db.cut))
query("alerts_recent_evidence", EVIDENCE)(lambda db: alerts.recent_evidence(db.t))
query("alerts_incomplete", INCOMPLETE)(lambda db: alerts.incomplete_proposals(db.t))
query("alerts_all", ALERTS)(lambda db: alerts.active_alerts(db.t, db.cut))
query("alert_totals", f"SELECT level, count(*) AS total FROM ({ALERTS}) a GROUP BY level")(
    lambda db: alerts.alert_totals(db.t, db.cut))
