"""Registered queries: scans, filters, joins, listings, exports."""

from pyspark.sql import functions as F

from catalog import sqltext as Q
from catalog.registry import query
from catalog.sqltext import CUT
from rastro.functions.basic import nonblank
from rastro.functions.dates import parse_date
from rastro.functions.status import client_status, effective_status, normalize_status
from rastro.operators import filters as P
from rastro.operators import hierarchy as H
from rastro.plans import kpis, lifecycle, listings

# --- Scans, look-ups, history ------------------------------------------------------------------------

_F = ["id", "report_id", "code", "title", "situation", "severity", "responsible_area", "action_owner", "status"]
query("scan_findings", f"SELECT {', '.join(_F)} FROM findings")(lambda db: db.t.findings.select(*_F))
query("scan_action_plans", "SELECT id, proposal_id, code, target_date, status, progress_pct FROM action_plans")(
    lambda db: db.t.action_plans.select("id", "proposal_id", "code", "target_date", "status", "progress_pct"))
query("lookup_by_id_or_code", "SELECT id, code, title FROM findings WHERE id = 'f77' OR code = 'H-2026-1105'")(
    lambda db: db.t.findings.filter((F.col("id") == "f77") | (F.col("code") == "H-2026-1105")).select("id", "code", "title"))


def _refs(db):
    """References to findings, by id or by code, one per order."""
    ref = F.when(F.col("o_orderkey") % 2 == 0, F.concat(F.lit("f"), F.col("o_custkey").cast("string"))).otherwise(
        F.concat(F.lit("H-2026-"), (F.col("o_custkey") + 1000).cast("string")))
    return db.base("orders").select("o_orderkey", ref.alias("ref"))


query("lookup_bulk", """
SELECT o_orderkey, f.id AS finding_id FROM (SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN 'f' || o_custkey ELSE 'H-2026-' || (o_custkey + 1000) END AS ref
FROM orders) x LEFT JOIN findings f ON f.id = x.ref OR f.code = x.ref""")(
    lambda db: H.resolve_ids(_refs(db), db.t.findings, "ref", "finding_id").select("o_orderkey", "finding_id"))

_TS = "strftime(change_date, '%Y-%m-%d %H:%M:%S') AS change_date"


def _hist(df):
    return df.select("id", "entity_type", "entity_id", F.date_format("change_date", "yyyy-MM-dd HH:mm:ss").alias("change_date"),
                     "user_name", "description")


query("history_by_entity", f"""SELECT id, entity_type, entity_id, {_TS}, user_name, description FROM audit_history
WHERE entity_type = 'finding'""")(lambda db: _hist(P.history(db.t, "finding")))

# --- Filters on listings -----------------------------------------------------------------------------

_LF = ["id", "code", "title", "severity", "responsible_area", "status", "report_code", "report_title", "proposals_count",
       "action_plans_count", "effective_status"]
PLAN_EFF = f"SELECT pa.*, {Q.effective('pa.status', Q.date('pa.target_date'))} AS eff FROM action_plans pa"
PROP_EFF = f"""SELECT p.*, coalesce(c.n, 0) AS action_plans_count,
  CASE WHEN base = 'En proceso' AND coalesce(c.late, false) THEN 'Vencido' ELSE base END AS effective_status
  FROM (SELECT q.*, {Q.effective('q.status', f"CASE WHEN coalesce(q.target_date, '') <> '' THEN {Q.date('q.target_date')} ELSE m.dt END")} AS base
        FROM proposals q LEFT JOIN (SELECT proposal_id, min({Q.date('target_date')}) AS dt FROM action_plans WHERE target_date <> '' GROUP BY 1) m
        ON m.proposal_id = q.id) p
  LEFT JOIN (SELECT proposal_id, count(*) AS n, bool_or(eff = 'Vencido') AS late FROM pe GROUP BY 1) c ON c.proposal_id = p.id"""
FIND_EFF = f"""SELECT f.*, coalesce(c.np, 0) AS proposals_count, coalesce(c.na, 0) AS action_plans_count,
  CASE WHEN {Q.norm_status('f.status')} = 'En proceso' AND coalesce(c.late, false) THEN 'Vencido' ELSE {Q.norm_status('f.status')} END AS effective_status
  FROM findings f LEFT JOIN (SELECT finding_id, count(*) AS np, sum(action_plans_count)::BIGINT AS na, bool_or(effective_status = 'Vencido') AS late
  FROM qe GROUP BY 1) c ON c.finding_id = f.id"""
EFF = f"WITH pe AS ({PLAN_EFF}), qe AS ({PROP_EFF}), fe AS ({FIND_EFF})\n"
LIST_F = EFF + """SELECT f.id, f.code, f.title, f.severity, f.responsible_area, f.status, r.code AS report_code, r.title AS report_title,
  proposals_count, action_plans_count, effective_status FROM fe f JOIN reports r ON f.report_id = r.id"""
_LP = ["id", "code", "status", "target_date", "finding_code", "finding_severity", "report_code", "action_plans_count", "effective_status"]
LIST_P = EFF + """SELECT p.id, p.code, p.status, p.target_date, f.code AS finding_code, f.severity AS finding_severity, r.code AS report_code,
  action_plans_count, effective_status FROM qe p JOIN findings f ON p.finding_id = f.id JOIN reports r ON f.report_id = r.id"""
_LA = ["id", "code", "status", "target_date", "proposal_code", "finding_code", "report_title", "effective_status"]
LIST_A = EFF + """SELECT pa.id, pa.code, pa.status, pa.target_date, p.code AS proposal_code, f.code AS finding_code, r.title AS report_title,
  eff AS effective_status FROM pe pa JOIN proposals p ON pa.proposal_id = p.id JOIN findings f ON p.finding_id = f.id JOIN reports r ON f.report_id = r.id"""

query("listing_findings", LIST_F)(lambda db: listings.findings(db.t, db.cut).select(*_LF))
query("listing_proposals", LIST_P)(lambda db: listings.proposals(db.t, db.cut).select(*_LP))
query("listing_plans", LIST_A)(lambda db: listings.plans(db.t, db.cut).select(*_LA))
query("filter_findings_severity_area", LIST_F + " WHERE lower(f.severity) = 'alto' AND contains(lower(f.responsible_area), 'área 3')")(
    lambda db: listings.findings(db.t, db.cut, severity="ALTO", area="Área 3").select(*_LF))
query("filter_findings_search", LIST_F + """ WHERE contains(lower(f.title), 'building') OR contains(lower(f.situation), 'building')
  OR contains(lower(f.code), 'building') OR contains(lower(f.responsible_area), 'building')""")(
    lambda db: listings.findings(db.t, db.cut, search="Building").select(*_LF))
query("filter_findings_status", LIST_F + " WHERE effective_status = 'Vencido'")(
    lambda db: listings.findings(db.t, db.cut, status="vencido").select(*_LF))
query("filter_proposals_search", LIST_P + """ WHERE contains(lower(p.code), '-101') OR contains(lower(p.proposal_text), '-101')
  OR contains(lower(f.code), '-101') OR contains(lower(f.title), '-101')""")(
    lambda db: listings.proposals(db.t, db.cut, search="-101").select(*_LP))
query("filter_proposals_status", LIST_P + " WHERE effective_status = 'En suspensión'")(
    lambda db: listings.proposals(db.t, db.cut, status="stand-by").select(*_LP))
query("filter_plans_search", LIST_A + """ WHERE contains(lower(pa.code), 'resp 4') OR contains(lower(pa.action_text), 'resp 4')
  OR contains(lower(pa.action_owner), 'resp 4') OR contains(lower(p.code), 'resp 4') OR contains(lower(f.code), 'resp 4')""")(
    lambda db: listings.plans(db.t, db.cut, search="RESP 4").select(*_LA))
query("filter_plans_status", LIST_A + " WHERE eff = 'Finalizado'")(
    lambda db: listings.plans(db.t, db.cut, status="cerrado").select(*_LA))
query("filter_unknown_status_keeps_all", LIST_A)(
    lambda db: listings.plans(db.t, db.cut, status="otro").select(*_LA))

query("filter_missing_data", """SELECT id FROM proposals WHERE action_owner IS NULL OR action_owner = '' OR action_owner LIKE '%Pendiente%'
  OR target_date IS NULL OR target_date = ''""")(
    lambda db: db.t.proposals.filter(P.missing_data("action_owner", "target_date")).select("id"))
query("filter_stale", f"""SELECT id FROM action_plans WHERE last_updated < {CUT} - INTERVAL '30' DAY AND lower(status) NOT IN {Q.CLOSED3}""")(
    lambda db: db.t.action_plans.filter(P.stale("last_updated", "status", db.cut)).select("id"))
query("filter_overdue", f"SELECT id FROM action_plans WHERE {Q.date('target_date')} < {CUT} AND lower(status) NOT IN {Q.LATE_OUT}")(
    lambda db: db.t.action_plans.filter(P.overdue(parse_date("target_date"), "status", db.cut)).select("id"))
query("filter_suspended_overdue", f"SELECT id FROM action_plans WHERE {Q.date('target_date')} < {CUT} AND lower(status) IN {Q.SUSP3}")(
    lambda db: db.t.action_plans.filter(P.suspended_overdue(parse_date("target_date"), "status", db.cut)).select("id"))
query("filter_pending_validation", """SELECT id FROM action_plans WHERE (progress_pct = 100 OR lower(status) = 'pendiente de validación')
  AND lower(status) NOT IN ('finalizado','validado','cerrado')""")(
    lambda db: db.t.action_plans.filter(P.pending_validation("progress_pct", "status")).select("id"))

# --- Screen: main table, proposal tab, decision table ---------------------------------------------------

_FIRST = """first_plan AS (SELECT proposal_id, arg_min(struct_pack(id := id, title := title, action_text := action_text, action_owner := action_owner,
  target_date := target_date, progress_pct := progress_pct), code) AS s FROM action_plans GROUP BY proposal_id)"""
_FLAT = """findings f JOIN reports r ON f.report_id = r.id LEFT JOIN proposals p ON p.finding_id = f.id
  LEFT JOIN first_plan fp ON fp.proposal_id = p.id"""
_SCREEN_STATUS = Q.client("coalesce(nullif(p.status, ''), f.status)", Q.date("p.target_date"))
_MAIN = f"""SELECT f.id AS finding_id, f.code AS finding_code, p.id AS proposal_id, coalesce(p.code, 'Sin propuesta') AS proposal_code,
  coalesce(nullif(p.proposal_text, ''), nullif(p.title, ''), '') AS proposal_text,
  coalesce(nullif(p.action_owner, ''), CASE WHEN fp.s IS NOT NULL THEN fp.s.action_owner ELSE coalesce(nullif(f.action_owner, ''), 'Sin asignar') END) AS owner,
  coalesce(nullif(p.target_date, ''), fp.s.target_date, '') AS target_date, coalesce(fp.s.progress_pct, 0) AS progress_pct,
  {_SCREEN_STATUS} AS status FROM {_FLAT}"""
query("screen_main_table", f"WITH {_FIRST} SELECT * FROM ({_MAIN} WHERE lower(f.responsible_area) = 'área 2' AND lower(f.severity) = 'alto') x WHERE status = 'Vencido'")(
    lambda db: listings.main_table(db.t, db.cut, status="vencida", area="ÁREA 2", risk="alto"))
query("screen_main_table_no_plan", f"""WITH {_FIRST}, n AS (SELECT p.finding_id, count(*) AS n FROM action_plans pa JOIN proposals p ON pa.proposal_id = p.id GROUP BY 1)
  SELECT * FROM ({_MAIN} LEFT JOIN n ON n.finding_id = f.id WHERE coalesce(n.n, 0) = 0 AND {Q.client('f.status', 'NULL::DATE')} <> 'Finalizado') x""")(
    lambda db: listings.main_table(db.t, db.cut, no_plan=True))
query("flatten_first_plan", f"""WITH {_FIRST} SELECT f.code AS f_code, p.code AS p_code, fp.s.action_text AS pa_action_text, fp.s.progress_pct AS pa_progress_pct,
  fp.s.id AS pa_id FROM {_FLAT}""")(
    lambda db: H.flatten_first_plan(db.t).select("f_code", "p_code", "pa_action_text", "pa_progress_pct", "pa_id"))
query("first_plan_per_proposal", """SELECT proposal_id, id, code FROM (SELECT *, row_number() OVER (PARTITION BY proposal_id ORDER BY code, id) AS n
  FROM action_plans) x WHERE n = 1""")(lambda db: H.first_plan(db.t).select("proposal_id", "id", "code"))

_TAB = EFF + f""", tab AS (SELECT p.id, p.status, p.target_date, p.effective_status, p.action_plans_count,
  {Q.client('p.status', Q.date('p.target_date'))} AS screen, p.responsible_area, coalesce(nullif(f.severity, ''), p.severity) AS risk, r.id AS report_id
  FROM qe p JOIN findings f ON p.finding_id = f.id JOIN reports r ON f.report_id = r.id)\n"""
_TABF = dict(area="Área 2", risk="Alto")
query("screen_proposal_tab", _TAB + "SELECT id, effective_status FROM tab WHERE responsible_area = 'Área 2' AND risk = 'Alto' AND effective_status = 'Finalizado'")(
    lambda db: listings.proposals(db.t, db.cut).filter(P.proposal_tab_filter(status="cerrada", **_TABF)).select("id", "effective_status"))
query("screen_proposal_cards", _TAB + """SELECT count(*) AS total, count(*) FILTER (WHERE action_plans_count = 0 AND screen <> 'Finalizado') AS open_without_plan,
  count(*) FILTER (WHERE effective_status IN ('En proceso', 'Vencido')) AS in_process, count(*) FILTER (WHERE screen = 'Finalizado') AS completed
  FROM tab WHERE responsible_area = 'Área 2'""")(
    lambda db: kpis.proposal_cards(listings.proposals(db.t, db.cut).filter(P.proposal_tab_filter(area="Área 2")), db.cut))
query("open_proposals_without_plan", _TAB + "SELECT id FROM tab WHERE action_plans_count = 0 AND screen <> 'Finalizado'")(
    lambda db: listings.proposals(db.t, db.cut).filter(P.open_without_plan(
        "action_plans_count", client_status("status", "target_date", db.cut))).select("id"))

_DEC = f"""SELECT f.id AS finding_id, f.code AS finding_code, coalesce(nullif(f.title, ''), f.situation) AS finding_title,
  coalesce(nullif(r.title, ''), nullif(r.source_filename, ''), 'Informe') AS report_title, p.id AS proposal_id, coalesce(p.code, '-') AS proposal_code,
  CASE WHEN p.id IS NULL THEN 'Sin propuesta' ELSE coalesce(nullif(p.proposal_text, ''), p.title) END AS proposal_text,
  pa.id AS plan_id, pa.code AS plan_code, coalesce(nullif(pa.action_text, ''), pa.title) AS plan_text,
  coalesce(nullif(f.responsible_area, ''), 'Operaciones') AS area, coalesce(nullif(f.severity, ''), 'Medio') AS severity,
  coalesce(nullif(pa.action_owner, ''), nullif(p.action_owner, ''), nullif(f.action_owner, ''), 'Sin asignar') AS owner,
  coalesce(nullif(pa.target_date, ''), nullif(p.target_date, ''), '') AS target_date,
  coalesce(nullif(pa.status, ''), nullif(p.status, ''), nullif(f.status, ''), 'En proceso') AS status,
  greatest(coalesce(date_diff('day', {Q.date("coalesce(nullif(pa.target_date, ''), nullif(p.target_date, ''), '')")}, {CUT}), 0), 0)::INT AS days_overdue,
  coalesce(nullif(pa.status, ''), nullif(p.status, ''), nullif(f.status, ''), 'En proceso') = 'Pendiente de validación'
   OR (coalesce(pa.progress_pct, 0) = 100 AND coalesce(nullif(pa.status, ''), nullif(p.status, ''), nullif(f.status, ''), 'En proceso') <> 'Finalizado') AS is_pending_val
  FROM {Q.LEFT4}"""
query("decision_table", _DEC)(lambda db: H.decision_rows(db.t, db.cut))
for _key, _cond in {
    "high_risk": "lower(severity) = 'alto' AND lower(status) <> 'finalizado'", "overdue": "days_overdue > 0 AND lower(status) <> 'finalizado'",
    "validated": "lower(status) IN ('finalizado','completado','validado')", "pending_val": "is_pending_val",
    "on_time": "lower(status) IN ('finalizado','completado','validado') AND days_overdue = 0",
}.items():
    query(f"decision_{_key}", f"SELECT finding_id, proposal_id, plan_id, status, days_overdue FROM ({_DEC}) x WHERE {_cond}")(
        lambda db, k=_key: H.decision_rows(db.t, db.cut).filter(P.decision_filter(k)).select(
            "finding_id", "proposal_id", "plan_id", "status", "days_overdue"))

# --- Joins and child roll-ups -----------------------------------------------------------------------------

query("join_plans_to_ancestors", f"SELECT pa.id AS pa_id, p.id AS p_id, f.id AS f_id, r.id AS r_id FROM {Q.INNER4}")(
    lambda db: H.plans_with_ancestors(db.t).select("pa_id", "p_id", "f_id", "r_id"))
query("join_downwards", f"SELECT pa.id AS pa_id, p.id AS p_id, f.id AS f_id, r.id AS r_id FROM {Q.ALL4}")(
    lambda db: H.downwards(db.t).select("pa_id", "p_id", "f_id", "r_id"))
query("join_findings_downwards", f"SELECT pa.id AS pa_id, p.id AS p_id, f.id AS f_id, r.id AS r_id FROM {Q.LEFT4}")(
    lambda db: H.findings_downwards(db.t).select("pa_id", "p_id", "f_id", "r_id"))
query("anti_proposals_without_plan", "SELECT id FROM proposals p WHERE NOT EXISTS (SELECT 1 FROM action_plans a WHERE a.proposal_id = p.id)")(
    lambda db: H.childless(db.t.proposals, db.t.action_plans, "proposal_id").select("id"))
query("anti_findings_without_proposal", "SELECT id FROM findings f WHERE NOT EXISTS (SELECT 1 FROM proposals p WHERE p.finding_id = f.id)")(
    lambda db: H.childless(db.t.findings, db.t.proposals, "finding_id").select("id"))
query("semi_proposals_of_open_findings", f"SELECT id FROM proposals WHERE finding_id IN (SELECT id FROM findings WHERE lower(status) NOT IN {Q.CLOSED3})")(
    lambda db: H.of_parents(db.t.proposals, db.t.findings.filter(~F.lower("status").isin("finalizado", "completado", "cerrado")), "finding_id").select("id"))
query("either_side_area", f"SELECT p.id FROM {Q.PROPS3} WHERE f.responsible_area = 'Área 3' OR p.responsible_area = 'Área 3'")(
    lambda db: P.scoped(db.t, P.Scope(area="Área 3")).proposals.select(F.col("p_id").alias("id")))
query("child_counts", "SELECT finding_id, count(*) AS proposals_count FROM proposals GROUP BY finding_id")(
    lambda db: H.child_counts(db.t.proposals, "finding_id", "proposals_count"))
query("earliest_plan_date", f"SELECT proposal_id, min({Q.date('target_date')}) AS min_target_dt FROM action_plans GROUP BY proposal_id")(
    lambda db: H.earliest_plan_date(db.t))
query("any_overdue_child", EFF + "SELECT proposal_id, bool_or(eff = 'Vencido') AS any_overdue FROM pe GROUP BY proposal_id")(
    lambda db: db.t.action_plans.groupBy("proposal_id").agg(
        F.bool_or(effective_status("status", "target_date", db.cut) == "Vencido").alias("any_overdue")))
query("all_children_final", f"""SELECT proposal_id, bool_and({Q.norm_status('status')} = 'Finalizado') AS all_final FROM action_plans GROUP BY proposal_id""")(
    lambda db: db.t.action_plans.groupBy("proposal_id").agg(F.bool_and(normalize_status("status") == "Finalizado").alias("all_final")))
query("validation_precondition", """SELECT proposal_id, count(*) AS plans, count(*) FILTER (WHERE progress_pct < 100
  OR lower(status) IN ('en proceso','en suspensión','en suspension','stand-by')) AS incomplete FROM action_plans GROUP BY proposal_id""")(
    lambda db: lifecycle.validation_state(db.t))

# --- Details -----------------------------------------------------------------------------------------------

query("finding_history_merged", f"""
WITH s AS (SELECT 'finding' AS entity_type, id AS entity_id, id AS finding_id FROM findings
  UNION ALL SELECT 'proposal', id, finding_id FROM proposals
  UNION ALL SELECT 'action_plan', pa.id, p.finding_id FROM action_plans pa JOIN proposals p ON pa.proposal_id = p.id)
SELECT h.id, h.entity_type, h.entity_id, s.finding_id, {_TS} FROM audit_history h JOIN s ON h.entity_type = s.entity_type AND h.entity_id = s.entity_id""")(
    lambda db: listings.finding_history(db.t, db.t.findings.select("id")).select(
        "id", "entity_type", "entity_id", "finding_id", F.date_format("change_date", "yyyy-MM-dd HH:mm:ss").alias("change_date")))
query("finding_evidence", """SELECT p.finding_id, pa.code AS plan_code, pa.evidence_file AS filename, pa.last_updated AS date
  FROM action_plans pa JOIN proposals p ON pa.proposal_id = p.id JOIN findings f ON p.finding_id = f.id WHERE pa.evidence_file <> ''""")(
    lambda db: listings.finding_evidence(db.t, db.t.findings.select("id")))


_PLANS_IN = "coalesce((SELECT string_agg(pa.code, ',' ORDER BY pa.code) FROM action_plans pa WHERE pa.proposal_id = p.id), '') AS plans"


def _tree_rows(df, *top):
    codes = F.array_join(F.transform("proposal.action_plans", lambda x: x["code"]), ",")
    return df.select(*top, F.col("finding.id").alias("finding_id"), F.col("finding.title").alias("title"), F.col("proposal.id").alias("proposal_id"),
                     F.col("proposal.target_date").alias("target_date"), F.coalesce(codes, F.lit("")).alias("plans"))


_TREE_COLS = f"f.id AS finding_id, f.title, p.id AS proposal_id, p.target_date, {_PLANS_IN}"
query("report_trees", f"SELECT r.id AS report_id, r.code, {_TREE_COLS} FROM reports r LEFT JOIN findings f ON f.report_id = r.id LEFT JOIN proposals p ON p.finding_id = f.id")(
    lambda db: _tree_rows(H.trees(db.t, "report"), F.col("report.id").alias("report_id"), F.col("report.code").alias("code")))
query("findings_nested", f"SELECT r.code AS report_code, r.title AS report_title, {_TREE_COLS} FROM findings f JOIN reports r ON f.report_id = r.id LEFT JOIN proposals p ON p.finding_id = f.id")(
    lambda db: _tree_rows(listings.findings_nested(db.t), "report_code", "report_title"))
query("report_detail_tree", f"SELECT r.id AS report_id, {_TREE_COLS} FROM reports r LEFT JOIN findings f ON f.report_id = r.id LEFT JOIN proposals p ON p.finding_id = f.id WHERE r.id = 'r3' OR r.code = 'r3'")(
    lambda db: _tree_rows(listings.report_detail(db.t, "r3")[0], F.col("report.id").alias("report_id")))
query("report_detail_history", """SELECT h.id, h.entity_id, strftime(h.change_date, '%Y-%m-%d %H:%M:%S') AS change_date FROM audit_history h JOIN reports r ON r.id = h.entity_id
  WHERE h.entity_type = 'report' AND (r.id = 'r3' OR r.code = 'r3')""")(
    lambda db: listings.report_detail(db.t, "r3")[1].select("id", "entity_id", F.date_format("change_date", "yyyy-MM-dd HH:mm:ss").alias("change_date")))


def _leaves(db):
    """Every plan with its path, read back out of the nested rows."""
    return H.trees(db.t, "report").select(
        F.col("report.id").alias("report_id"), F.col("finding.id").alias("finding_id"), F.col("proposal.id").alias("proposal_id"), F.explode("proposal.action_plans").alias("pa")).select(
        "report_id", "finding_id", "proposal_id", F.col("pa.id").alias("plan_id"), F.col("pa.progress_pct").alias("progress_pct"))


query("report_tree_leaves", f"SELECT r.id AS report_id, f.id AS finding_id, p.id AS proposal_id, pa.id AS plan_id, pa.progress_pct FROM {Q.INNER4}")(_leaves)

# --- Exports -----------------------------------------------------------------------------------------------

_XS = "coalesce(nullif(coalesce(nullif(p.status, ''), f.status, ''), ''), 'En proceso')"
_XT = "coalesce(nullif(p.target_date, ''), nullif(fp.s.target_date, ''), '')"
query("export_findings", f"""WITH {_FIRST} SELECT coalesce(nullif(f.responsible_area, ''), 'Pendiente de definir') AS area, f.code AS finding_code,
  coalesce(nullif(f.situation, ''), f.title) AS situation, coalesce(p.code, 'Sin propuesta') AS proposal_code,
  coalesce(nullif(p.proposal_text, ''), nullif(p.title, ''), '') AS proposal_text, f.severity,
  coalesce(nullif(p.action_owner, ''), nullif(fp.s.action_owner, ''), f.action_owner, '') AS owner, {_XT} AS target_date,
  {Q.export(_XS, Q.date(_XT))} AS status, CAST(coalesce(fp.s.progress_pct, 0) AS VARCHAR) || '%' AS progress,
  coalesce(nullif(fp.s.action_text, ''), nullif(fp.s.title, ''), '') AS action, f.observations FROM {_FLAT}""")(
    lambda db: listings.export_findings(db.t, db.cut))
_XP = Q.export("coalesce(p.status, 'En proceso')", Q.date("p.target_date"))
query("export_proposals", f"""SELECT p.code AS proposal_code, coalesce(nullif(p.proposal_text, ''), p.title) AS proposal_text, f.code AS finding_code,
  p.responsible_area AS area, {_XP} AS status, p.action_owner AS owner, CAST(coalesce(c.n, 0) AS VARCHAR) || ' plan(es)' AS plans, p.target_date,
  CASE WHEN {_XP} = 'Finalizado' THEN '🗃️ Plan 2026' ELSE 'Archivar' END AS repository, r.title AS report_title
  FROM {Q.PROPS3} LEFT JOIN (SELECT proposal_id, count(*) AS n FROM action_plans GROUP BY 1) c ON c.proposal_id = p.id""")(
    lambda db: listings.export_proposals(db.t, db.cut))
query("export_plans", f"""SELECT pa.code AS plan_code, coalesce(nullif(pa.action_text, ''), pa.title) AS action_text, p.code AS proposal_code,
  f.code AS finding_code, r.title AS report_title, pa.action_owner AS owner, pa.target_date, CAST(pa.progress_pct AS VARCHAR) || '%' AS progress,
  pa.status, pa.notes AS evidence, '' AS actions FROM {Q.INNER4}""")(lambda db: listings.export_plans(db.t, db.cut))
