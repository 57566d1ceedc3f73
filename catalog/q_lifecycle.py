"""Registered queries: edits, propagation, cascades, validation, sequences, creation, deletion."""

from pyspark.sql import functions as F

from catalog import sqltext as Q
from catalog.registry import query
from catalog.sqltext import CUT
from rastro.operators.sequences import assign_codes, sequence_state
from rastro.plans import lifecycle as L

N = Q.norm_status
YEAR = 2026


def _state(t):
    """The three tables a status job can change, in one frame."""
    none = F.lit(None).cast("string")
    f = t.findings.select(F.lit("finding").alias("entity"), "id", "status", F.lit(-1).alias("progress_pct"), none.alias("closed_date"),
                          none.alias("validated_by"))
    p = t.proposals.select(F.lit("proposal").alias("entity"), "id", "status", F.lit(-1).alias("progress_pct"), none.alias("closed_date"), "validated_by")
    a = t.action_plans.select(F.lit("action_plan").alias("entity"), "id", "status", "progress_pct", "closed_date",
                              "validated_by")
    return f.unionByName(p).unionByName(a)


def _state_sql(f="findings", p="proposals", a="action_plans", a_validated="NULL"):
    return f"""SELECT 'finding' AS entity, id, status, -1 AS progress_pct, NULL AS closed_date, NULL AS validated_by FROM {f}
    UNION ALL SELECT 'proposal', id, status, -1, NULL, validated_by FROM {p}
    UNION ALL SELECT 'action_plan', id, status, progress_pct, closed_date, {a_validated} FROM {a}"""


def _cascade_f(np: str, touched: str) -> str:
    """Findings after the upward cascade from proposals table ``np``."""
    return f"""SELECT f.id, CASE WHEN tf.id IS NULL OR {N('f.status')} = 'En suspensión' OR s.fin IS NULL THEN f.status
      WHEN NOT s.fin THEN 'En proceso' WHEN {N('f.status')} <> 'Finalizado' THEN 'Finalizado' ELSE f.status END AS status
    FROM findings f LEFT JOIN (SELECT DISTINCT finding_id AS id FROM proposals WHERE id IN ({touched})) tf ON tf.id = f.id
    LEFT JOIN (SELECT finding_id, bool_and({N('status')} = 'Finalizado') AS fin FROM {np} GROUP BY 1) s ON s.finding_id = f.id"""


def _cascade_p(na: str, touched: str, src: str = "proposals", cleared: str = "SELECT NULL") -> str:
    live = f"tp.id IS NOT NULL AND {N('p.status')} <> 'En suspensión' AND s.fin IS NOT NULL"
    return f"""SELECT p.id, p.finding_id, CASE WHEN {live} AND NOT s.fin THEN 'En proceso'
      WHEN {live} AND s.fin AND {N('p.status')} <> 'Finalizado' THEN 'Finalizado' ELSE p.status END AS status,
      CASE WHEN {live} AND (NOT s.fin OR p.id IN ({cleared})) THEN NULL ELSE p.validated_by END AS validated_by
    FROM {src} p LEFT JOIN ({touched}) tp ON tp.id = p.id
    LEFT JOIN (SELECT proposal_id, bool_and({N('status')} = 'Finalizado') AS fin FROM {na} GROUP BY 1) s ON s.proposal_id = p.id"""


# --- Edits -------------------------------------------------------------------------------------------

query("edit_findings_fields", f"""SELECT f.id, coalesce(e.title, f.title) AS title, coalesce(e.action_owner, f.action_owner) AS action_owner,
  CASE WHEN e.status IS NOT NULL THEN {N('e.status')} ELSE f.status END AS status FROM findings f LEFT JOIN finding_edits e ON e.id = f.id""")(
    lambda db: L.edit_findings(db.t, db.view("finding_edits"), db.cut).tables.findings.select("id", "title", "action_owner", "status"))
query("edit_findings_history", f"""SELECT id AS entity_id, 'Edición inline: ' || concat_ws(', ', 'title=' || title, 'action_owner=' || action_owner,
  CASE WHEN status IS NOT NULL THEN 'status=' || {N('status')} END) AS description FROM finding_edits
  WHERE coalesce(title, action_owner, status) IS NOT NULL""")(
    lambda db: L.edit_findings(db.t, db.view("finding_edits"), db.cut).history.select("entity_id", "description"))

_EF = f"""e AS (SELECT id, {N('status')} AS asked FROM finding_edits WHERE status IS NOT NULL),
nf AS (SELECT f.id, coalesce(e.asked, f.status) AS status FROM findings f LEFT JOIN e ON e.id = f.id),
np AS (SELECT p.id, p.finding_id, CASE WHEN e.asked = 'Finalizado' AND p.status <> 'En suspensión' THEN 'Finalizado'
   WHEN e.asked = 'En proceso' AND p.status = 'Finalizado' THEN 'En proceso' ELSE p.status END AS status,
   CASE WHEN e.asked = 'En proceso' AND p.status = 'Finalizado' THEN NULL ELSE p.validated_by END AS validated_by
   FROM proposals p LEFT JOIN e ON e.id = p.finding_id),
na AS (SELECT a.id, CASE WHEN e.asked IN ('Finalizado', 'En proceso') AND a.status <> 'En suspensión' THEN e.asked ELSE a.status END AS status,
   CASE WHEN a.status = 'En suspensión' THEN a.progress_pct WHEN e.asked = 'Finalizado' THEN 100 WHEN e.asked = 'En proceso' THEN 0 ELSE a.progress_pct END AS progress_pct,
   CASE WHEN a.status = 'En suspensión' THEN a.closed_date WHEN e.asked = 'Finalizado' THEN '1998-09-02' WHEN e.asked = 'En proceso' THEN NULL ELSE a.closed_date END AS closed_date
   FROM action_plans a JOIN proposals p ON p.id = a.proposal_id LEFT JOIN e ON e.id = p.finding_id)"""
query("edit_findings_propagation", f"WITH {_EF} {_state_sql('nf', 'np', 'na')}")(
    lambda db: _state(L.edit_findings(db.t, db.view("finding_edits"), db.cut).tables))

_EP = f"""e AS (SELECT id, {N('status')} AS asked FROM proposal_edits WHERE status IS NOT NULL),
np AS (SELECT p.id, p.finding_id, coalesce(e.asked, p.status) AS status, CASE WHEN e.asked = 'En proceso' THEN NULL ELSE p.validated_by END AS validated_by
   FROM proposals p LEFT JOIN e ON e.id = p.id),
na AS (SELECT a.id, CASE WHEN e.asked IN ('Finalizado', 'En proceso') AND a.status <> 'En suspensión' THEN e.asked ELSE a.status END AS status,
   CASE WHEN a.status = 'En suspensión' THEN a.progress_pct WHEN e.asked = 'Finalizado' THEN 100 WHEN e.asked = 'En proceso' THEN 0 ELSE a.progress_pct END AS progress_pct,
   CASE WHEN a.status = 'En suspensión' THEN a.closed_date WHEN e.asked = 'Finalizado' THEN '1998-09-02' WHEN e.asked = 'En proceso' THEN NULL ELSE a.closed_date END AS closed_date
   FROM action_plans a LEFT JOIN e ON e.id = a.proposal_id),
nf AS ({_cascade_f('np', 'SELECT id FROM e')})"""
query("edit_proposals_propagation", f"WITH {_EP} {_state_sql('nf', 'np', 'na')}")(
    lambda db: _state(L.edit_proposals(db.t, db.view("proposal_edits"), db.cut).tables))
query("edit_proposals_fields", f"""SELECT p.id, CASE WHEN e.target_date IS NOT NULL THEN strftime({Q.date('e.target_date')}, '%Y-%m-%d') ELSE p.target_date END AS target_date,
  coalesce(e.action_owner, p.action_owner) AS action_owner FROM proposals p LEFT JOIN proposal_edits e ON e.id = p.id""")(
    lambda db: L.edit_proposals(db.t, db.view("proposal_edits"), db.cut).tables.proposals.select("id", "target_date", "action_owner"))

# --- Upward cascade ----------------------------------------------------------------------------------

_TOUCH = "SELECT id FROM proposals"
query("cascade_upwards", f"""WITH np AS ({_cascade_p('action_plans', _TOUCH)}), nf AS ({_cascade_f('np', _TOUCH)}) {_state_sql('nf', 'np')}""")(
    lambda db: _state(L.cascade_proposals(db.t, db.t.proposals.select("id"))))

# --- Plan changes ------------------------------------------------------------------------------------

_CH = f"""c AS (SELECT a.id, a.proposal_id, a.notes, a.closed_date, ch.plan_id, {N('a.status')} AS cur, a.status AS raw, a.progress_pct AS pct0, ch.confirm_finalize AS conf,
   CASE WHEN ch.status IS NOT NULL THEN {N('ch.status')} ELSE {N('a.status')} END AS req, ch.status AS given,
   CASE WHEN ch.progress_pct IS NULL THEN a.progress_pct ELSE greatest(0, least(100, ch.progress_pct)) END AS p1
   FROM action_plans a LEFT JOIN plan_changes ch ON ch.plan_id = a.id),
d AS (SELECT *, CASE WHEN req = 'Finalizado' THEN 100 WHEN given IS NOT NULL AND req = 'En proceso' AND (cur IN ('Finalizado', 'Pendiente de validación') OR pct0 = 100)
   THEN 0 ELSE p1 END AS pct FROM c),
na AS (SELECT id, proposal_id, CASE WHEN plan_id IS NULL THEN pct0 ELSE pct END AS progress_pct,
   CASE WHEN plan_id IS NULL THEN raw WHEN pct = 100 AND req <> 'En suspensión' THEN CASE WHEN conf THEN 'Finalizado' ELSE 'Pendiente de validación' END ELSE req END AS status,
   plan_id IS NOT NULL AS changed, CASE WHEN plan_id IS NULL OR NOT (pct = 100 AND req <> 'En suspensión' AND NOT conf) THEN notes
     WHEN notes = '' THEN 'Pendiente de validación' ELSE notes || ' (Pendiente de validación)' END AS notes, closed_date AS closed0 FROM d),
na2 AS (SELECT id, proposal_id, status, progress_pct, notes, changed, CASE WHEN NOT changed THEN closed0 WHEN status = 'Finalizado' THEN '1998-09-02' END AS closed_date FROM na)"""
_CHT = "SELECT DISTINCT proposal_id AS id FROM na2 WHERE changed"
_CHO = "SELECT DISTINCT proposal_id FROM na2 WHERE changed AND status <> 'Finalizado'"
ORACLE_PLAN_CHANGES = f"WITH {_CH} SELECT id, status, progress_pct, closed_date FROM na2"
query("plan_changes_state", f"WITH {_CH}, np AS ({_cascade_p('na2', _CHT, cleared=_CHO)}), nf AS ({_cascade_f('np', _CHT)}) {_state_sql('nf', 'np', 'na2')}")(
    lambda db: _state(L.apply_plan_changes(db.t, db.view("plan_changes"), db.cut).tables))
query("plan_changes_notes", f"WITH {_CH} SELECT id, notes FROM na2")(
    lambda db: L.apply_plan_changes(db.t, db.view("plan_changes"), db.cut).tables.action_plans.select("id", "notes"))
_LOG = f"""WITH RECURSIVE l AS (SELECT plan_id, row_number() OVER (PARTITION BY plan_id ORDER BY change_no) AS k, status, progress_pct, confirm_finalize FROM plan_log),
walk AS (SELECT id, 0 AS k, {N('status')} AS status, progress_pct AS pct, false AS opened FROM action_plans
  UNION ALL SELECT id, k, CASE WHEN p2 = 100 AND req <> 'En suspensión' THEN CASE WHEN conf THEN 'Finalizado' ELSE 'Pendiente de validación' END ELSE req END,
    p2, opened OR NOT (p2 = 100 AND req <> 'En suspensión' AND conf) FROM (
    SELECT w.id, l.k, l.confirm_finalize AS conf, w.opened, coalesce({N('l.status')}, w.status) AS req0,
      CASE WHEN l.status IS NULL THEN w.status ELSE {N('l.status')} END AS req,
      CASE WHEN {N('l.status')} = 'Finalizado' AND l.status IS NOT NULL OR (l.status IS NULL AND w.status = 'Finalizado') THEN 100
           WHEN l.status IS NOT NULL AND {N('l.status')} = 'En proceso' AND (w.status IN ('Finalizado', 'Pendiente de validación') OR w.pct = 100) THEN 0
           WHEN l.progress_pct IS NULL THEN w.pct ELSE greatest(0, least(100, l.progress_pct)) END AS p2
    FROM walk w JOIN l ON l.plan_id = w.id AND l.k = w.k + 1) s)
SELECT a.id, CASE WHEN w.k = 0 THEN a.status ELSE w.status END AS status, w.pct AS progress_pct,
  CASE WHEN w.k = 0 THEN a.closed_date WHEN w.status = 'Finalizado' THEN '1998-09-02' END AS closed_date
FROM action_plans a JOIN (SELECT id, max(k) AS k, arg_max(status, k) AS status, arg_max(pct, k) AS pct FROM walk GROUP BY id) w ON w.id = a.id"""
query("plan_log_fold", _LOG)(
    lambda db: L.apply_plan_changes(db.t, db.view("plan_log"), db.cut).tables.action_plans.select("id", "status", "progress_pct", "closed_date"))

# --- Validation --------------------------------------------------------------------------------------

_VS = """v AS (SELECT r.proposal_id, p.id IS NOT NULL AS known, coalesce(s.bad, 0) AS bad FROM
   (SELECT DISTINCT 'p' || o_orderkey AS proposal_id FROM orders) r LEFT JOIN proposals p ON p.id = r.proposal_id
   LEFT JOIN (SELECT proposal_id, count(*) FILTER (WHERE progress_pct < 100 OR lower(status) IN ('en proceso','en suspensión','en suspension','stand-by')) AS bad
     FROM action_plans GROUP BY 1) s ON s.proposal_id = r.proposal_id), ok AS (SELECT proposal_id AS id FROM v WHERE known AND bad = 0)"""


def _to_validate(db):
    return db.base("orders").select(F.concat(F.lit("p"), F.col("o_orderkey").cast("string")).alias("proposal_id"))


query("validate_proposals_state", f"""WITH {_VS},
 np AS (SELECT p.id, p.finding_id, CASE WHEN ok.id IS NOT NULL THEN 'Finalizado' ELSE p.status END AS status,
   CASE WHEN ok.id IS NOT NULL THEN 'Ana' ELSE p.validated_by END AS validated_by FROM proposals p LEFT JOIN ok ON ok.id = p.id),
 na AS (SELECT a.id, CASE WHEN ok.id IS NOT NULL THEN 'Finalizado' ELSE a.status END AS status, CASE WHEN ok.id IS NOT NULL THEN 100 ELSE a.progress_pct END AS progress_pct,
   CASE WHEN ok.id IS NOT NULL THEN '1998-09-02' ELSE a.closed_date END AS closed_date, CASE WHEN ok.id IS NOT NULL THEN 'Ana' END AS validated_by
   FROM action_plans a LEFT JOIN ok ON ok.id = a.proposal_id),
 nf AS ({_cascade_f('np', 'SELECT id FROM ok')}) {_state_sql('nf', 'np', 'na', 'validated_by')}""")(
    lambda db: _state(L.validate_proposals(db.t, _to_validate(db), db.cut, "Ana").tables))
query("validate_proposals_refused", f"""WITH {_VS} SELECT proposal_id, CASE WHEN NOT known THEN 'Propuesta de mejora no encontrada.'
  ELSE 'No se puede validar una propuesta que tiene planes incompletos o en suspensión.' END AS reason FROM v WHERE NOT known OR bad > 0""")(
    lambda db: L.validate_proposals(db.t, _to_validate(db), db.cut, "Ana").refused)
_VT = "SELECT DISTINCT proposal_id AS id FROM action_plans WHERE evidence_file <> ''"
query("validate_plans_state", f"""WITH na AS (SELECT id, proposal_id, CASE WHEN evidence_file <> '' THEN 'Finalizado' ELSE status END AS status,
   CASE WHEN evidence_file <> '' THEN 100 ELSE progress_pct END AS progress_pct, CASE WHEN evidence_file <> '' THEN '1998-09-02' ELSE closed_date END AS closed_date,
   CASE WHEN evidence_file <> '' THEN 'Ana' END AS validated_by FROM action_plans),
 np AS ({_cascade_p('na', _VT)}), nf AS ({_cascade_f('np', _VT)}) {_state_sql('nf', 'np', 'na', 'validated_by')}""")(
    lambda db: _state(L.validate_plans(db.t, db.t.action_plans.filter("evidence_file <> ''").select(F.col("id").alias("plan_id")), db.cut, "Ana").tables))

# --- Code sequences ----------------------------------------------------------------------------------

_MAXES = " UNION ALL ".join(
    f"SELECT '{e}' AS entity_type, try_cast(split_part(code, '-', 2) AS INT) AS year, try_cast(split_part(code, '-', 3) AS BIGINT) AS n FROM {t}"
    for e, t in (("report", "reports"), ("finding", "findings"), ("proposal", "proposals"), ("action_plan", "action_plans")))
query("code_sequences", f"""SELECT entity_type, year, max(n) AS last_value FROM ({_MAXES}
  UNION ALL SELECT e, 2027, 0 FROM (VALUES ('report'), ('finding'), ('proposal'), ('action_plan')) v(e)) x GROUP BY 1, 2""")(
    lambda db: sequence_state(db.t, 2027))


def _wanting(db):
    return db.base("orders").select(F.col("o_orderkey").alias("row_no"))


query("assign_codes", """WITH m AS (SELECT max(CAST(split_part(code, '-', 3) AS BIGINT)) AS last FROM findings)
  SELECT o_orderkey AS row_no, printf('H-2026-%03d', last + row_number() OVER (ORDER BY o_orderkey)) AS code FROM orders, m""")(
    lambda db: assign_codes(_wanting(db), "finding", YEAR, "row_no", sequence_state(db.t, YEAR, ["finding"]), span=1000))
query("assign_codes_skipping_taken", """WITH m AS (SELECT max(CAST(split_part(code, '-', 3) AS BIGINT)) AS last FROM findings),
  taken AS (SELECT DISTINCT last + (c_custkey * c_custkey) % 5000 AS n FROM customer, m),
  free AS (SELECT n, row_number() OVER (ORDER BY n) AS k FROM (SELECT unnest(generate_series(last + 1, last + 5000 + (SELECT count(*) FROM orders))) AS n FROM m) s
    WHERE n NOT IN (SELECT n FROM taken)),
  r AS (SELECT o_orderkey AS row_no, row_number() OVER (ORDER BY o_orderkey) AS k FROM orders)
  SELECT row_no, printf('H-2026-%03d', n) AS code FROM r JOIN free USING (k)""")(lambda db: assign_codes(
    _wanting(db), "finding", YEAR, "row_no", sequence_state(db.t, YEAR, ["finding"]), span=1000, reserved=_reserved(db)))


def _reserved(db):
    last = sequence_state(db.t, YEAR, ["finding"]).filter("entity_type = 'finding' and year = 2026").select("last_value", F.lit(1).alias("one"))
    offset = db.base("customer").select(((F.col("c_custkey") * F.col("c_custkey")) % 5000).alias("d"), F.lit(1).alias("one"))
    return offset.join(last, "one").select(F.concat(F.lit("H-2026-"), (F.col("last_value") + F.col("d")).cast("string")).alias("code"))


# --- Creation and deletion ---------------------------------------------------------------------------


def _new_plans(db):
    n = F.col("o_orderkey")
    none = F.lit(None).cast("string")
    return db.base("orders").select(
        n.alias("row_no"), F.when(n % 2 == 0, F.concat(F.lit("p"), n.cast("string"))).alias("proposal_id"),
        F.when(n % 2 == 1, F.concat(F.lit("f"), F.col("o_custkey").cast("string"))).alias("finding_id"),
        F.concat(F.lit("Acción nueva "), n.cast("string")).alias("action_text"), F.lit("Resp").alias("action_owner"),
        F.lit("31/12/1998").alias("target_date"), F.when(n % 5 == 0, "stand-by").alias("status"),
        F.when(n % 4 == 0, 100).otherwise(40).alias("progress_pct"), none.alias("notes"), none.alias("evidence_file"))


_NEW = """req AS (SELECT o_orderkey AS n, CASE WHEN o_orderkey % 2 = 0 THEN 'p' || o_orderkey END AS pid, CASE WHEN o_orderkey % 2 = 1 THEN 'f' || o_custkey END AS fid
   FROM orders),
 fp AS (SELECT finding_id, arg_min(id, code) AS pid FROM proposals GROUP BY 1),
 aim AS (SELECT n, fid, p.id AS direct, fp.pid AS first FROM req LEFT JOIN proposals p ON p.id = req.pid LEFT JOIN fp ON fp.finding_id = req.fid),
 mk AS (SELECT fid, min(n) AS n FROM aim WHERE direct IS NULL AND first IS NULL AND fid IS NOT NULL GROUP BY 1),
 mp AS (SELECT max(CAST(split_part(code, '-', 3) AS BIGINT)) AS last FROM proposals), ma AS (SELECT max(CAST(split_part(code, '-', 3) AS BIGINT)) AS last FROM action_plans),
 made AS (SELECT fid, n, printf('PM-2026-%03d', last + row_number() OVER (ORDER BY n)) AS code FROM mk, mp)"""
query("create_plans", f"""WITH {_NEW}, t AS (SELECT a.n, coalesce(pp.code, made.code) AS proposal_code FROM aim a
   LEFT JOIN proposals pp ON pp.id = coalesce(a.direct, a.first) LEFT JOIN made ON made.fid = a.fid WHERE coalesce(pp.code, made.code) IS NOT NULL)
 SELECT printf('PA-2026-%03d', last + row_number() OVER (ORDER BY n)) AS code, proposal_code, 'Acción nueva ' || n AS action_text, '1998-12-31' AS target_date,
   CASE WHEN n % 5 = 0 THEN 'En suspensión' WHEN n % 4 = 0 THEN 'Finalizado' ELSE 'En proceso' END AS status,
   CASE WHEN n % 4 = 0 THEN 100 ELSE 40 END AS progress_pct, CASE WHEN n % 5 <> 0 AND n % 4 = 0 THEN '1998-09-02' END AS closed_date FROM t, ma""")(
    lambda db: _created_plans(db))
query("create_proposals", f"""WITH {_NEW} SELECT made.code, f.code AS finding_code, 'Propuesta recomendada para ' || f.code || ': Acción nueva ' || n AS proposal_text,
   coalesce(f.severity, '') AS severity, coalesce(f.responsible_area, '') AS responsible_area, '1998-12-31' AS target_date
 FROM made JOIN findings f ON f.id = made.fid""")(lambda db: _created_proposals(db))


def _created_plans(db):
    out = L.create_plans(db.t, _new_plans(db), db.cut, YEAR).tables
    new = out.action_plans.join(db.t.action_plans.select("id"), "id", "left_anti")
    codes = out.proposals.select(F.col("id").alias("proposal_id"), F.col("code").alias("proposal_code"))
    return new.join(codes, "proposal_id").select("code", "proposal_code", "action_text", "target_date", "status", "progress_pct", "closed_date")


def _created_proposals(db):
    out = L.create_plans(db.t, _new_plans(db), db.cut, YEAR).tables
    new = out.proposals.join(db.t.proposals.select("id"), "id", "left_anti")
    codes = db.t.findings.select(F.col("id").alias("finding_id"), F.col("code").alias("finding_code"))
    return new.join(codes, "finding_id").select("code", "finding_code", "proposal_text", "severity", "responsible_area", "target_date")


query("delete_reports", """SELECT 'reports' AS table_name, id FROM reports WHERE area <> 'ASIA' AND period <> '2023'
  UNION ALL SELECT 'findings', f.id FROM findings f JOIN reports r ON f.report_id = r.id WHERE area <> 'ASIA' AND period <> '2023'
  UNION ALL SELECT 'proposals', p.id FROM proposals p JOIN findings f ON p.finding_id = f.id JOIN reports r ON f.report_id = r.id WHERE area <> 'ASIA' AND period <> '2023'
  UNION ALL SELECT 'action_plans', pa.id FROM action_plans pa JOIN proposals p ON pa.proposal_id = p.id JOIN findings f ON p.finding_id = f.id
  JOIN reports r ON f.report_id = r.id WHERE area <> 'ASIA' AND period <> '2023'""")(
    lambda db: _ids(L.delete_reports(db.t, db.t.reports.filter("area = 'ASIA' or period = '2023'").select("id"))))
query("delete_findings", """SELECT 'reports' AS table_name, id FROM reports UNION ALL SELECT 'findings', id FROM findings WHERE severity <> 'Alto' OR severity IS NULL
  UNION ALL SELECT 'proposals', p.id FROM proposals p JOIN findings f ON p.finding_id = f.id WHERE f.severity <> 'Alto' OR f.severity IS NULL
  UNION ALL SELECT 'action_plans', pa.id FROM action_plans pa JOIN proposals p ON pa.proposal_id = p.id JOIN findings f ON p.finding_id = f.id
  WHERE f.severity <> 'Alto' OR f.severity IS NULL""")(
    lambda db: _ids(L.delete_findings(db.t, db.t.findings.filter("severity = 'Alto'").select("id"))))


def _ids(t):
    out = t.reports.select(F.lit("reports").alias("table_name"), "id")
    for n in ("findings", "proposals", "action_plans"):
        out = out.unionByName(getattr(t, n).select(F.lit(n).alias("table_name"), "id"))
    return out
