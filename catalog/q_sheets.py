"""Registered queries: sheet headers, cells, sheet parsing, relation checks and rejects."""

from pyspark.sql import functions as F

from catalog import sqltext as Q
from catalog.registry import query
from rastro.functions.numbers import parse_pct
from rastro.plans import sheets
from rastro.session import settle
from rastro.sources import cells as C

SPAN = 10_000_000_000 * 64  # sixty-four findings of the sheet fixture per block
FIELDS = list(C.FINDING_POSITIONS)

_NAMES = "(VALUES ('area', 0), ('h_code', 1), ('situation', 2), ('p_code', 3), ('prop_text', 4), ('risk', 5), ('owner', 6), ('target_date', 7), ('status', 8), ('pct', 9), ('actions', 10), ('obs', 11)) v(field, col_no)"
query("sheet_headers_resolved", f"""SELECT 'r' || n_nationkey AS file, 'Hallazgos' AS sheet, field, col_no FROM nation, {_NAMES}""")(
    lambda db: C.resolve_headers(db.view("sheet_headers")))
query("sheet_headers_legacy", f"""SELECT 'r' || n_nationkey AS file, 'Hallazgos' AS sheet, field,
  CASE WHEN n_nationkey % 3 = 1 AND field = 'owner' THEN 12 WHEN n_nationkey % 3 = 1 AND field = 'h_code' THEN 1
       WHEN n_nationkey % 3 = 1 AND field = 'prop_text' THEN 4 ELSE col_no END AS col_no FROM nation, {_NAMES}""")(
    lambda db: C.resolve_legacy_headers(db.view("sheet_headers")))


def _cells(db):
    """The finding sheet as one row per cell, header included; every third situation comes from a merged range."""
    body = db.view("sheet_rows").select("file", F.lit("Hallazgos").alias("sheet"), "row_no", F.posexplode(
        F.array(*[F.col(f) for f in FIELDS])).alias("col_no", "value"))
    head = db.view("sheet_headers").select("file", "sheet", F.lit(0).cast("bigint").alias("row_no"), "col_no", "value")
    return head.unionByName(body)


query("sheet_rows_from_cells", "SELECT file, row_no, area, h_code, situation, p_code, prop_text, risk, owner, target_date, status, pct, actions, obs FROM sheet_rows")(
    lambda db: C.to_rows(_cells(db), C.resolve_headers(db.view("sheet_headers")), FIELDS).drop("sheet"))


def _merged(db):
    """Blank the second and third column of every block of two rows and describe them as merged ranges."""
    plan = db.t.action_plans.select(F.col("proposal_id").alias("file"), F.lit("Planes").alias("sheet"),
                                    (F.substring("code", 9, 20).cast("bigint") % 10).alias("row_no"), F.col("action_text").alias("v"))
    values = plan.withColumn("value", F.when(F.col("row_no") % 2 == 1, F.col("v")))
    cells = values.select("file", "sheet", "row_no", F.lit(0).alias("col_no"), "value")
    ranges = cells.filter("value is not null").select("file", "sheet", F.col("row_no").alias("r0"), F.lit(0).alias("c0"),
                                                      (F.col("row_no") + 1).alias("r1"), F.lit(1).alias("c1"))
    return C.fill_merged(cells, ranges)


query("sheet_merged_cells", """WITH p AS (SELECT proposal_id AS file, CAST(substr(code, 9) AS BIGINT) % 10 AS r, action_text AS v FROM action_plans),
  top AS (SELECT * FROM p WHERE r % 2 = 1),
  opened AS (SELECT file, r + dr AS row_no, c AS col_no, v FROM top, (VALUES (0), (1)) a(dr), (VALUES (0), (1)) b(c))
  SELECT coalesce(p.file, o.file) AS file, 'Planes' AS sheet, coalesce(p.r, o.row_no) AS row_no, coalesce(o.col_no, 0) AS col_no, o.v AS value
  FROM p FULL OUTER JOIN opened o ON p.file = o.file AND p.r = o.row_no AND o.col_no = 0""")(_merged)


def _sheets(db):
    names = F.array(*[F.struct(F.lit(i).alias("sheet_no"), F.lit(n).alias("sheet")) for i, n in enumerate(["Resumen", "Planes", "Propuestas", "Hallazgos y Propuestas", "Plan B"])])
    first = F.slice(names, 1, 3)
    return db.base("nation").select(F.concat(F.lit("r"), F.col("n_nationkey").cast("string")).alias("file"),
                                    F.inline(F.when(F.col("n_nationkey") % 2 == 0, names).otherwise(first)))


query("sheet_roles", """SELECT 'r' || n_nationkey AS file, sheet, role FROM nation JOIN (VALUES (0, 'Hallazgos y Propuestas', 'findings'), (0, 'Propuestas', 'proposals'), (0, 'Planes', 'plans'),
  (1, 'Resumen', 'findings'), (1, 'Propuestas', 'proposals'), (1, 'Planes', 'plans')) v(k, sheet, role) ON v.k = n_nationkey % 2""")(lambda db: C.sheet_roles(_sheets(db)))

# --- Parsing -------------------------------------------------------------------------------------------

_PCT = "CASE pct WHEN '100%' THEN 100 WHEN '0.5' THEN 50 WHEN '30' THEN 30 ELSE 0 END"
STAGED = f"""x AS (SELECT *, h_code <> '' OR situation <> '' OR area <> '' AS starts FROM sheet_rows WHERE h_code <> '' OR situation <> '' OR prop_text <> '' OR actions <> ''),
y AS (SELECT *, last_value(CASE WHEN starts THEN coalesce(nullif(h_code, ''), printf('H-IMP-%03d', row_no)) END IGNORE NULLS) OVER w AS lc,
   last_value(nullif(area, '') IGNORE NULLS) OVER w AS la, last_value(nullif(situation, '') IGNORE NULLS) OVER w AS ls,
   min(row_no) OVER (PARTITION BY file) AS first_row, {_PCT} AS n FROM x WINDOW w AS (PARTITION BY file ORDER BY row_no ROWS UNBOUNDED PRECEDING)),
st AS (SELECT file, row_no, coalesce(lc, printf('H-IMP-%03d', first_row)) AS h_code,
   CASE WHEN starts OR row_no = first_row THEN area ELSE coalesce(la, 'Operaciones') END AS area,
   CASE WHEN starts OR row_no = first_row THEN situation ELSE coalesce(ls, '') END AS situation,
   CASE WHEN p_code <> '' THEN p_code WHEN prop_text <> '' THEN printf('PM-IMP-%03d', row_no) ELSE '' END AS p_code, prop_text,
   {Q.norm_severity('risk')} AS severity, owner, target_date, n AS progress_pct, actions, obs,
   CASE WHEN n = 100 OR lower(status) LIKE '%pendiente%' THEN 'Pendiente de validación' WHEN regexp_matches(lower(status), 'suspensión|suspension|stand-by') THEN 'En suspensión'
        WHEN regexp_matches(lower(status), 'finalizado|finalizada|completada|completado|cerrado') THEN 'Finalizado' ELSE 'En proceso' END AS status FROM y),
sf AS (SELECT * FROM (SELECT file, h_code AS code, row_no, CASE WHEN situation <> '' THEN substr(situation, 1, 100) ELSE 'Hallazgo ' || h_code END AS title,
   coalesce(nullif(situation, ''), 'Sin detalle') AS situation, severity, coalesce(nullif(area, ''), 'Operaciones') AS responsible_area,
   coalesce(nullif(owner, ''), 'Auditoría') AS action_owner, status, obs AS observations, row_number() OVER (PARTITION BY file, h_code ORDER BY row_no) AS k FROM st) z WHERE k = 1),
sp AS (SELECT * FROM (SELECT file, h_code, p_code AS code, row_no, coalesce(nullif(prop_text, ''), 'Sin detalle de propuesta') AS proposal_text, severity,
   coalesce(nullif(owner, ''), 'Auditoría') AS action_owner, target_date, status, row_number() OVER (PARTITION BY file, h_code, p_code ORDER BY row_no) AS k FROM st WHERE p_code <> '') z WHERE k = 1)"""
_STAGED = ["file", "row_no", "h_code", "area", "situation", "p_code", "severity", "status", "progress_pct"]


def _staged(db):
    return sheets.staged_rows(db.view("sheet_rows"), SPAN)


query("sheet_staged_rows", f"WITH {STAGED} SELECT {', '.join(_STAGED)} FROM st")(lambda db: _staged(db).select(*_STAGED))
_SF = ["file", "code", "row_no", "title", "situation", "severity", "responsible_area", "action_owner", "status", "observations"]
query("sheet_findings", f"WITH {STAGED} SELECT {', '.join(_SF)} FROM sf")(lambda db: sheets.sheet_findings(_staged(db)).select(*_SF))
_SP = ["file", "h_code", "code", "row_no", "proposal_text", "severity", "action_owner", "target_date", "status"]
query("sheet_proposals_first_seen", f"WITH {STAGED} SELECT {', '.join(_SP)} FROM sp")(lambda db: sheets.sheet_proposals(_staged(db)).select(*_SP))
query("sheet_inline_plans", f"""WITH {STAGED} SELECT file, h_code, p_code, printf('PA-IMP-%03d', row_no) AS code,
  coalesce(nullif(actions, ''), nullif(prop_text, ''), 'Plan de Acción') AS action_text, progress_pct, CASE WHEN progress_pct = 100 THEN 'Pendiente de validación' ELSE status END AS status
  FROM st WHERE p_code <> '' AND (actions <> '' OR progress_pct > 0)""")(
    lambda db: sheets.inline_plans(_staged(db), None).select("file", "h_code", "p_code", "code", "action_text", "progress_pct", "status"))
query("sheet_report_headers", f"""WITH {STAGED} SELECT file, 'Importación Excel - ' || file AS title, arg_min(responsible_area, row_no) AS area, count(*) AS findings,
  'Importación relacional desde planilla (' || count(*) || ' hallazgos).' AS summary FROM sf GROUP BY file""")(
    lambda db: sheets.report_headers(sheets.sheet_findings(_staged(db))).select("file", "title", "area", "findings", "summary"))

_S2 = STAGED + """,
kn AS (SELECT file, code AS p_code, arg_max(h_code, row_no) AS owner_h FROM sp GROUP BY 1, 2),
r2 AS (SELECT s.*, coalesce(nullif(s.p_code, ''), printf('PM-IMP-S2-%03d', s.row_no)) AS code, kn.owner_h, f.severity AS f_sev, f.action_owner AS f_owner FROM sheet_proposals s
   LEFT JOIN kn ON kn.file = s.file AND kn.p_code = s.p_code LEFT JOIN sf f ON f.file = s.file AND f.code = s.h_code WHERE s.p_code <> '' OR s.prop_text <> ''),
an AS (SELECT file, code, min(row_no) AS anchor FROM r2 WHERE owner_h IS NULL AND f_sev IS NOT NULL GROUP BY 1, 2),
att AS (SELECT r2.file, r2.h_code, r2.code, r2.row_no, coalesce(nullif(prop_text, ''), 'Sin detalle') AS proposal_text, f_sev AS severity,
   coalesce(nullif(owner, ''), f_owner) AS action_owner, target_date, status FROM r2 JOIN an USING (file, code) WHERE row_no = anchor AND owner_h IS NULL),
up AS (SELECT file, coalesce(owner_h, ah) AS h_code, code, arg_max(prop_text, row_no) FILTER (WHERE prop_text <> '') AS t, arg_max(owner, row_no) FILTER (WHERE owner <> '') AS o,
   arg_max(target_date, row_no) FILTER (WHERE target_date <> '') AS d FROM (SELECT r2.*, att.h_code AS ah, att.row_no AS arow FROM r2 LEFT JOIN att ON att.file = r2.file AND att.code = r2.code) z
   WHERE owner_h IS NOT NULL OR row_no > arow GROUP BY 1, 2, 3),
al AS (SELECT file, h_code, code, row_no, 1 AS src, proposal_text, severity, action_owner, target_date, status FROM sp UNION ALL SELECT file, h_code, code, row_no, 2, proposal_text, severity, action_owner, target_date, status FROM att),
p2 AS (SELECT al.file, al.h_code, al.code, al.row_no, src, coalesce(up.t, proposal_text) AS proposal_text, severity, coalesce(up.o, action_owner) AS action_owner, coalesce(up.d, target_date) AS target_date, status
   FROM al LEFT JOIN up ON up.file = al.file AND up.h_code = al.h_code AND up.code = al.code)"""


def _with_proposals(db):
    st = settle(_staged(db), "sheet-rows")
    f = settle(sheets.sheet_findings(st), "sheet-findings")
    return f, *sheets.apply_proposal_sheet(f, sheets.sheet_proposals(st), db.view("sheet_proposals"))


query("sheet_proposals_merged", f"WITH {_S2} SELECT {', '.join(_SP)} FROM p2")(lambda db: _with_proposals(db)[1].select(*_SP))
query("sheet_proposal_rejects", f"""WITH {_S2} SELECT r2.file, 'proposals' AS sheet, r2.row_no, 'proposal' AS entity, coalesce(nullif(p_code, ''), substr(prop_text, 1, 30)) AS code,
  CASE WHEN h_code <> '' THEN 'finding_not_in_file' ELSE 'finding_not_given' END AS reason FROM r2 LEFT JOIN an ON an.file = r2.file AND an.code = r2.code
  WHERE owner_h IS NULL AND (anchor IS NULL OR row_no < anchor)""")(lambda db: _with_proposals(db)[2])

_S3 = _S2 + """,
bc AS (SELECT file, code AS p_code, arg_max(h_code, src * 1000000000000000000::HUGEINT + row_no) AS bh, arg_max(action_owner, src * 1000000000000000000::HUGEINT + row_no) AS bo FROM p2 GROUP BY 1, 2),
bf AS (SELECT file, h_code, count(*) AS n, any_value(code) AS oc, any_value(action_owner) AS oo FROM p2 GROUP BY 1, 2),
j AS (SELECT s.*, bh, bo, f.code AS fc, bf.n, oc, oo, CASE WHEN pa_code LIKE 'PA-%' THEN pa_code ELSE printf('PA-IMP-%03d', s.row_no) END AS code, CAST(replace(pct, '%', '') AS INT) AS v FROM sheet_plans s
   LEFT JOIN bc ON bc.file = s.file AND bc.p_code = s.p_code LEFT JOIN sf f ON f.file = s.file AND f.code = s.h_code LEFT JOIN bf ON bf.file = s.file AND bf.h_code = s.h_code),
g AS (SELECT *, CASE WHEN p_code <> '' AND bh IS NULL THEN 'proposal_not_in_file' WHEN p_code <> '' AND h_code <> '' AND bh <> h_code THEN 'proposal_of_other_finding'
   WHEN p_code = '' AND h_code = '' THEN 'no_parent_given' WHEN p_code = '' AND fc IS NULL THEN 'finding_not_in_file' WHEN p_code = '' AND n IS NULL THEN 'finding_without_proposal'
   WHEN p_code = '' AND n > 1 THEN 'finding_with_several_proposals' END AS reason FROM j)"""
query("sheet_plans_linked", f"""WITH {_S3} SELECT file, CASE WHEN p_code <> '' THEN bh ELSE h_code END AS h_code, CASE WHEN p_code <> '' THEN p_code ELSE oc END AS p_code, code,
  coalesce(nullif(owner, ''), CASE WHEN p_code <> '' THEN bo ELSE oo END) AS action_owner, v AS progress_pct,
  CASE WHEN v = 100 OR lower(status) LIKE '%pendiente%' THEN 'Pendiente de validación' WHEN regexp_matches(lower(status), 'suspensión|suspension') THEN 'En suspensión'
       WHEN regexp_matches(lower(status), 'finalizado|completado|cerrado') THEN 'Finalizado' ELSE 'En proceso' END AS status FROM g WHERE reason IS NULL""")(
    lambda db: _plans(db)[0].select("file", "h_code", "p_code", "code", "action_owner", "progress_pct", "status"))
query("sheet_plan_rejects", f"WITH {_S3} SELECT file, 'plans' AS sheet, row_no, 'action_plan' AS entity, code, reason FROM g WHERE reason IS NOT NULL")(
    lambda db: _plans(db)[1])


def _plans(db):
    f, p, _ = _with_proposals(db)
    return sheets.apply_plan_sheet(f, settle(p, "sheet-proposals"), db.view("sheet_plans"))


query("sheet_all_rejects_by_reason", f"""WITH {_S3} SELECT sheet, reason, count(*) AS total FROM (SELECT 'plans' AS sheet, reason FROM g WHERE reason IS NOT NULL
  UNION ALL SELECT 'proposals', CASE WHEN h_code <> '' THEN 'finding_not_in_file' ELSE 'finding_not_given' END FROM r2 LEFT JOIN an ON an.file = r2.file AND an.code = r2.code
  WHERE owner_h IS NULL AND (anchor IS NULL OR row_no < anchor)) z GROUP BY 1, 2""")(
    lambda db: sheets.parse_sheets(db.view("sheet_rows"), db.view("sheet_proposals"), db.view("sheet_plans"), span=SPAN).rejects
    .groupBy("sheet", "reason").agg(F.count(F.lit(1)).alias("total")))
query("sheet_legacy_rows", f"""SELECT file, row_no, coalesce(nullif(h_code, ''), printf('H-IMP-%03d', row_no)) AS h_code, coalesce(nullif(p_code, ''), printf('PM-IMP-%03d', row_no)) AS p_code,
  CASE WHEN lower(risk) LIKE '%alto%' THEN 'Alto' WHEN lower(risk) LIKE '%bajo%' THEN 'Bajo' ELSE 'Medio' END AS severity,
  CASE WHEN regexp_matches(lower(status), 'suspensión|suspension') THEN 'En suspensión' WHEN regexp_matches(lower(status), 'finalizado|finalizada|completada|completado|cerrado') THEN 'Finalizado' ELSE 'En proceso' END AS status,
  {_PCT} AS progress_pct FROM sheet_rows WHERE h_code <> '' OR situation <> '' OR prop_text <> ''""")(
    lambda db: sheets.legacy_rows(db.view("sheet_rows")).select("file", "row_no", "h_code", "p_code", "severity", "status", "progress_pct"))
query("parse_percent", """SELECT id, CASE WHEN progress_pct % 8 = 0 THEN progress_pct WHEN progress_pct % 8 = 4 THEN CASE WHEN progress_pct = 100 THEN 10 WHEN progress_pct < 10 THEN progress_pct * 10 ELSE progress_pct END
  WHEN progress_pct % 8 = 2 THEN least(100, progress_pct * 2) ELSE 0 END AS pct FROM action_plans""")(
    lambda db: db.t.action_plans.select("id", parse_pct(
        F.when(F.col("progress_pct") % 8 == 0, F.concat(F.col("progress_pct").cast("string"), F.lit(" %")))
        .when(F.col("progress_pct") % 8 == 4, F.concat(F.lit("0."), F.col("progress_pct").cast("string")))
        .when(F.col("progress_pct") % 8 == 2, (F.col("progress_pct") * 2).cast("string")).otherwise("sin dato")).alias("pct")))
