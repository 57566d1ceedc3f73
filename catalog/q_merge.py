"""Registered queries: re-import analysis, matching, field merge, conflicts and outcomes."""

from pyspark.sql import functions as F

from catalog import sqltext as Q
from catalog.registry import query
from rastro import schema as S
from rastro.functions import text as X
from rastro.functions.basic import first_filled
from rastro.plans import merge as M
from rastro.session import settle

YEAR = 2026


def _payload(db, t=None):
    batches = db.t.reports.select(F.concat(F.lit("b"), F.substring("id", 2, 20)).alias("batch"), "area", "title", "process", "period", "auditor",
                                  "summary", "source_filename", F.md5("title").alias("file_hash"))
    return M.Payload(batches, *[db.view(n) if t is None else db.view_of(n, t) for n in ("in_findings", "in_proposals", "in_plans")])


def _with_baseline(db):
    """Findings whose last import wrote the present title, for every third one."""
    n = F.substring("id", 2, 20).cast("bigint")
    base = F.when(n % 3 == 0, F.map_from_arrays(F.array(F.lit("title")), F.array("title")))
    no_batches = db.spark.createDataFrame([], ", ".join(f"{c} {t}" for c, t in S.IMPORT_BATCHES.items()))
    return db.t.with_(findings=db.t.findings.withColumn("import_baseline", base), import_batches=no_batches)


query("merge_fields_decisions", """SELECT id, field, CASE WHEN incoming = '' THEN 'skip' WHEN incoming = stored THEN 'refresh' WHEN coalesce(baseline = stored, false) OR stored = '' THEN 'write'
  ELSE 'preserve' END AS merge, CASE WHEN incoming = '' THEN 'skip' WHEN incoming = stored THEN 'refresh' WHEN coalesce(baseline = stored, false) OR stored = '' THEN 'write'
  ELSE 'replace' END AS overwrite FROM merge_fields""")(lambda db: db.view("merge_fields").select("id", "field", *[
    M.merge_decision(F.col("stored"), F.col("baseline"), F.col("incoming"), m).alias(m) for m in ("merge", "overwrite")]))

query("import_clean_plans", f"""WITH c AS (SELECT p.row_no, coalesce(nullif(p.action_owner, ''), nullif(f.action_owner, ''), 'Pendiente de definir') AS owner,
   strftime({Q.date('p.target_date')}, '%Y-%m-%d') AS dt, {Q.norm_status("coalesce(nullif(p.status, ''), f.status)")} AS st FROM in_proposals p JOIN in_findings f ON f.batch = p.batch AND f.row_no = p.parent_row)
 SELECT a.row_no, coalesce(nullif(a.action_owner, ''), c.owner) AS action_owner, coalesce(nullif(a.target_date, ''), c.dt, '') AS target_date,
   CASE WHEN a.progress_pct = '100' AND {Q.norm_status('a.status')} NOT IN ('En suspensión', 'Finalizado') THEN 'Pendiente de validación' ELSE {Q.norm_status('a.status')} END AS status,
   a.progress_pct FROM in_plans a JOIN c ON c.row_no = a.parent_row""")(
    lambda db: M.clean_payload(_payload(db)).plans.select("row_no", "action_owner", "target_date", "status", "progress_pct"))
query("import_fingerprints", "SELECT count(*) AS batches, true AS repeatable, true AS sensitive FROM nation")(lambda db: _prints(db))


def _prints(db):
    """Equal content gives equal hashes, wherever the rows stand; a changed title gives another hash."""
    p = _payload(db)
    p = M.Payload(p.batches, *[settle(df, "payload") for df in (p.findings, p.proposals, p.plans)])
    moved = lambda df: df.withColumns({c: F.col(c) + 5_000_000_000 for c in ("row_no", "parent_row") if c in df.columns})
    there = M.Payload(p.batches, moved(p.findings), moved(p.proposals), moved(p.plans))
    edited = M.Payload(p.batches, p.findings.withColumn("title", F.concat("title", F.lit("!"))), p.proposals, p.plans)
    a, b, c = (settle(M.fingerprints(M.clean_payload(x, hold=True)), "fingerprints") for x in (p, there, edited))
    j = a.join(b.withColumnRenamed("fingerprint", "b"), "batch").join(c.withColumnRenamed("fingerprint", "c"), "batch")
    return j.agg(F.count(F.lit(1)).alias("batches"), F.bool_and(F.col("fingerprint") == F.col("b")).alias("repeatable"),
                 F.bool_and(F.col("fingerprint") != F.col("c")).alias("sensitive"))


query("import_identical_batches", """WITH i AS (SELECT 'b' || n_nationkey AS batch, md5('content ' || n_nationkey * 3) AS fp, CASE WHEN n_nationkey % 2 = 0 THEN md5('file ' || n_nationkey * 4) END AS fh FROM nation),
 m AS (SELECT i.batch, s.report_id, s.created_at FROM i JOIN stored_batches s ON s.content_fingerprint = i.fp OR s.file_hash = i.fh)
 SELECT batch, report_id AS identical_report FROM (SELECT *, row_number() OVER (PARTITION BY batch ORDER BY created_at DESC, report_id DESC) AS k FROM m) z WHERE k = 1""")(
    lambda db: _identical(db))


def _identical(db):
    n = F.col("n_nationkey")
    mine = db.base("nation").select(
        F.concat(F.lit("b"), n.cast("string")).alias("batch"), F.md5(F.concat(F.lit("content "), (n * 3).cast("string"))).alias("fingerprint"),
        F.when(n % 2 == 0, F.md5(F.concat(F.lit("file "), (n * 4).cast("string")))).alias("file_hash"))
    t = db.t.with_(import_batches=db.view("stored_batches"))
    return M.find_identical(mine.select("batch", "file_hash"), mine.select("batch", "fingerprint"), t)


OVER = """hits AS (SELECT i.batch, coalesce(c.report_id, k.report_id) AS report_id, 'f' AS e FROM in_findings i LEFT JOIN findings c ON c.code = i.code
   LEFT JOIN findings k ON k.situation = i.situation
  UNION ALL SELECT i.batch, f.report_id, 'p' FROM in_proposals i JOIN proposals p ON p.code = i.code JOIN findings f ON p.finding_id = f.id
  UNION ALL SELECT i.batch, f.report_id, 'a' FROM in_plans i JOIN action_plans pa ON pa.code = i.code JOIN proposals p ON p.id = pa.proposal_id JOIN findings f ON p.finding_id = f.id),
ov AS (SELECT batch, report_id, count(*) FILTER (WHERE e = 'f') AS shared_findings, count(*) FILTER (WHERE e = 'p') AS shared_proposals, count(*) FILTER (WHERE e = 'a') AS shared_plans,
   count(*) AS score FROM hits WHERE report_id IS NOT NULL GROUP BY 1, 2)"""
query("import_overlaps", f"WITH {OVER} SELECT * FROM ov")(lambda db: M.overlaps(M.clean_payload(_payload(db), hold=True), M.stored(db.t)))
query("import_analysis", f"WITH {OVER} SELECT 'b' || n_nationkey AS batch, 'overlap' AS status, report_id AS best_candidate, score AS best_score FROM nation JOIN ov ON batch = 'b' || n_nationkey")(
    lambda db: M.analyze(M.clean_payload(_payload(db), hold=True), M.stored(db.t)).select("batch", "status", "best_candidate", "best_score"))
query("import_decisions", """SELECT 'b' || n_nationkey AS batch, 'decide' AS auto_action, 'merge' AS merge_action, 'r' || n_nationkey AS merge_target, 'new' AS new_action FROM nation""")(
    lambda db: _decisions(db))


def _decisions(db):
    a = settle(M.analyze(M.clean_payload(_payload(db), hold=True), M.stored(db.t)), "import-analysis")
    pick = lambda m: M.decide(a, m).select("batch", F.col("action").alias(f"{m}_action"), F.col("target_report").alias(f"{m}_target"))
    return pick("auto").drop("auto_target").join(pick("merge"), "batch").join(pick("new").drop("new_target"), "batch")


def _match_findings(db):
    inc = db.view("in_findings").select("row_no", F.concat(F.lit("r"), F.substring("batch", 2, 20)).alias("parent_id"), X.explicit_code("code").alias("code"), X.norm_key("situation").alias("key"))
    old = db.t.findings.select("id", F.col("report_id").alias("parent_id"), X.norm_code("code").alias("code"), X.norm_key(first_filled("situation", "title")).alias("key"))
    return M.match(inc, old, span=500)


query("import_matches", "SELECT CAST(substr(id, 2) AS BIGINT) AS row_no, id FROM findings WHERE CAST(substr(id, 2) AS BIGINT) % 10 <> 4")(_match_findings)


def _match_repeated(db):
    """Many rows share a text: every plan is offered again under the same key."""
    n = F.substring("code", 9, 20).cast("bigint")
    old = db.t.action_plans.select("id", F.lit("one").alias("parent_id"), F.lit("").alias("code"), F.col("action_text").alias("key"))
    inc = db.t.action_plans.select(n.alias("row_no"), F.lit("one").alias("parent_id"), F.lit("").alias("code"), F.col("action_text").alias("key"))
    pairs = M.match(inc, old, span=1000)
    both = pairs.join(inc, "row_no").join(old.select("id", F.col("key").alias("old_key")), "id")
    return both.groupBy("key").agg(F.count(F.lit(1)).alias("pairs"), F.count_distinct("id").alias("used"), F.bool_and(F.col("key") == F.col("old_key")).alias("same_key"))


query("import_matches_repeated_text", "SELECT action_text AS key, count(*) AS pairs, count(*) AS used, true AS same_key FROM action_plans GROUP BY 1")(_match_repeated)

_RN = "CAST(substr(p.id, 2) AS BIGINT)"
query("import_conflicts", """WITH i AS (SELECT n AS row_no, finding_id AS parent_id, 'PM-2026-' || (10000 + CASE WHEN n % 50 = 7 THEN n + 1 ELSE n END) AS code FROM
   (SELECT CAST(substr(id, 2) AS BIGINT) AS n, finding_id FROM proposals) x)
 SELECT i.row_no, i.code, p.finding_id AS held_by FROM i JOIN proposals p ON p.code = i.code WHERE p.finding_id <> i.parent_id
 OR i.row_no > (SELECT min(j.row_no) FROM i j WHERE j.code = i.code AND j.parent_id = i.parent_id)""")(lambda db: _conflicts(db))


def _conflicts(db):
    n = F.substring("id", 2, 20).cast("bigint")
    code = F.concat(F.lit("PM-2026-"), (10000 + F.when(n % 50 == 7, n + 1).otherwise(n)).cast("string"))
    rows = db.t.proposals.select(F.lit("b").alias("batch"), n.alias("row_no"), F.col("finding_id").alias("parent_id"), code.alias("code"), F.lit("merge").alias("action"))
    old = db.t.proposals.select("id", F.col("finding_id").alias("parent_id"), X.norm_code("code").alias("code"))
    return M.conflicts("proposal", rows, M.match_codes(rows, old), old).select("row_no", "code", "held_by")


_SAME = f"""fm AS (SELECT i.row_no, f.id, coalesce(f.action_owner, '') = '' OR coalesce(f.responsible_area, '') = '' OR (i.row_no % 4 = 1 AND i.row_no % 3 = 0) AS changed
   FROM in_findings i JOIN findings f ON CAST(substr(f.id, 2) AS BIGINT) = i.row_no WHERE i.row_no % 10 <> 4)"""
query("import_finding_outcomes", f"""WITH {_SAME}, seen AS (SELECT 'finding' AS entity, CASE WHEN changed THEN 'updated' ELSE 'unchanged' END AS outcome, count(*) AS total FROM fm GROUP BY 1, 2
  UNION ALL SELECT 'finding', 'created', count(*) FROM in_findings WHERE row_no % 10 = 4
  UNION ALL SELECT 'proposal', CASE WHEN changed THEN 'updated' ELSE 'unchanged' END, count(*) FROM (SELECT (p.action_owner = '' OR p.responsible_area = '' OR coalesce(p.proposal_text, '') = ''
     OR (coalesce(p.target_date, '') = '' AND i.row_no % 8 = 0)) AS changed FROM in_proposals i JOIN proposals p ON CAST(substr(p.id, 2) AS BIGINT) = i.row_no WHERE i.parent_row % 10 <> 4) z GROUP BY 1, 2
  UNION ALL SELECT 'proposal', 'created', count(*) FROM in_proposals WHERE parent_row % 10 = 4
  UNION ALL SELECT 'action_plan', CASE WHEN parent_row % 10 = 4 THEN 'created' WHEN changed THEN 'updated' ELSE 'unchanged' END, count(*) FROM (SELECT i.parent_row, coalesce(a.action_owner, '') = ''
     OR (coalesce(a.target_date, '') = '' AND {Q.date('i.target_date')} IS NOT NULL) AS changed FROM in_plans a JOIN in_proposals i ON i.row_no = a.parent_row) z GROUP BY 1, 2)
 SELECT e AS entity, o AS outcome, coalesce(max(total), 0)::BIGINT AS total FROM (SELECT unnest(['finding', 'proposal', 'action_plan']) AS e), (SELECT unnest(['created', 'updated', 'unchanged', 'rejected']) AS o)
 LEFT JOIN seen ON entity = e AND outcome = o GROUP BY 1, 2""")(
    lambda db: _imported(db).counts.groupBy("entity", "outcome").agg(F.sum("total").alias("total")))


_IMPORTS: dict = {}


def _imported(db, mode="merge"):
    """The import of the whole payload; several queries look at different parts of one."""
    known = _IMPORTS.get((id(db), mode))
    if known is None or known[0] is not db:
        t = M.stored(_with_baseline(db))
        known = _IMPORTS[id(db), mode] = (db, M.import_payload(t, _payload(db, t), db.cut, YEAR, mode=mode, span=20_000, written=True))
    return known[1]


query("import_merged_findings", f"""SELECT f.id, CASE WHEN n % 4 = 1 AND n % 3 = 0 AND n % 10 <> 4 THEN title || ' v2' ELSE title END AS title,
  CASE WHEN n % 10 <> 4 AND coalesce(action_owner, '') = '' THEN 'Pendiente de definir' ELSE action_owner END AS action_owner FROM (SELECT *, CAST(substr(id, 2) AS BIGINT) AS n FROM findings) f""")(
    lambda db: _imported(db).tables.findings.join(db.t.findings.select("id"), "id", "left_semi").select("id", "title", "action_owner"))
query("import_new_rows", """SELECT 'H-2026-' || (900000 + CAST(substr(id, 2) AS BIGINT)) AS code, report_id FROM findings WHERE CAST(substr(id, 2) AS BIGINT) % 10 = 4""")(
    lambda db: _new_findings(db))


def _new_findings(db):
    out = _imported(db).tables.findings
    return out.join(db.t.findings.select("id"), "id", "left_anti").select("code", "report_id")


query("import_as_new_report", """SELECT printf('AUD-2026-%03d', 124 + row_number() OVER (ORDER BY (SELECT min(row_no) FROM in_findings i WHERE i.batch = 'b' || n_nationkey))) AS code, 'Informe ' || n_name AS title,
  (SELECT count(*) FROM in_findings i WHERE i.batch = 'b' || n_nationkey) AS findings FROM nation""")(lambda db: _as_new(db))


def _as_new(db):
    out = _imported(db, "new").tables
    new = out.reports.join(db.t.reports.select("id"), "id", "left_anti").select(F.col("id").alias("report_id"), F.col("code").alias("code"), "title")
    n = out.findings.groupBy("report_id").agg(F.count(F.lit(1)).alias("findings"))
    return new.join(n, "report_id").select("code", "title", "findings")


query("import_preserved_edits", f"""SELECT 'finding' AS entity, f.id, 'title' AS field, 'preserve' AS decision FROM findings f WHERE CAST(substr(id, 2) AS BIGINT) % 4 = 1
  AND CAST(substr(id, 2) AS BIGINT) % 3 <> 0 AND CAST(substr(id, 2) AS BIGINT) % 10 <> 4""")(
    lambda db: _imported(db).field_log.filter("entity = 'finding'"))


# --- The importer's own log ------------------------------------------------------------------------

_EDITED = "n % 4 = 1 AND n % 3 = 0"
_WROTE = f"""concat_ws(', ', CASE WHEN {_EDITED} THEN 'título' END, CASE WHEN coalesce(responsible_area, '') = '' THEN 'área' END,
  CASE WHEN coalesce(action_owner, '') = '' THEN 'responsable' END)"""
_OLD = f"(SELECT *, CAST(substr(id, 2) AS BIGINT) AS n FROM findings) f"
query("import_history", f"""SELECT id AS changed_id, 'Reimportación (merge): actualizó ' || {_WROTE} AS description FROM {_OLD} WHERE n % 10 <> 4 AND {_WROTE} <> ''
  UNION ALL SELECT NULL, 'Creación de hallazgo H-2026-' || (900000 + row_no) || ': ' || title FROM in_findings WHERE row_no % 10 = 4""")(lambda db: _finding_history(db))


def _finding_history(db):
    rows = _imported(db).history.filter("entity_type = 'finding'")
    return rows.select(F.when(F.col("description").startswith("Reimportación"), F.col("entity_id")).alias("changed_id"), "description")


query("import_batch_rows", f"""SELECT r.id AS report_id, 'merge' AS mode, r.source_filename, true AS has_fingerprint, count(*) FILTER (WHERE i.row_no % 10 = 4) AS created,
  count(*) FILTER (WHERE i.row_no % 10 <> 4 AND {_WROTE} <> '') AS updated, count(*) FILTER (WHERE i.row_no % 10 <> 4 AND {_WROTE} = '') AS unchanged
  FROM reports r JOIN in_findings i ON i.batch = 'b' || substr(r.id, 2) JOIN (SELECT n, f.responsible_area, f.action_owner FROM {_OLD}) o ON o.n = i.row_no GROUP BY ALL""".replace(
      "coalesce(responsible_area", "coalesce(o.responsible_area").replace("coalesce(action_owner", "coalesce(o.action_owner"))(lambda db: _batch_log(db))


def _batch_log(db):
    number = lambda outcome: F.get_json_object("summary", f"$.counts.findings.{outcome}").cast("bigint").alias(outcome)
    return _imported(db).tables.import_batches.select("report_id", "mode", "source_filename", (F.length("content_fingerprint") >= 32).alias("has_fingerprint"),
                                                      *[number(o) for o in ("created", "updated", "unchanged")])


query("import_renamed", "SELECT i.code AS wanted, count(*) AS rows, true AS renumbered FROM in_findings i WHERE i.code IN (SELECT code FROM findings) GROUP BY 1")(lambda db: _renamed(db))


def _renamed(db):
    """Findings of new reports whose code is taken get the next free number; no code is given twice."""
    rows = _imported(db, "new").renamed.filter("entity = 'finding'")
    fresh = rows.join(db.t.findings.select("code"), "code", "left_anti")
    return fresh.groupBy("wanted").agg(F.count(F.lit(1)).alias("rows"), F.bool_and(F.col("code") != F.col("wanted")).alias("renumbered"))
