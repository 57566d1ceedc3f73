"""Registered queries: text functions, line rules and report-text parsing."""

from pyspark.sql import functions as F

from catalog import sqltext as Q
from catalog.registry import query
from catalog.sqltext import CUT
from rastro.functions import dates as D
from rastro.functions import text as X
from rastro.functions.numbers import clamp_progress
from rastro.functions.status import effective_status, is_final_status, normalize_severity, normalize_status
from rastro.plans import corpus
from rastro.session import settle

_BREAK = r"\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e]"
DOC_LINES = f"""dl AS (SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1)::INT AS line_no, line FROM (
  SELECT doc_id, i, {Q.clean('raw')} AS line FROM (SELECT doc_id, unnest(string_split_regex(text, '{_BREAK}')) AS raw,
  generate_subscripts(string_split_regex(text, '{_BREAK}'), 1) AS i FROM documents) a) b WHERE line <> ''),
nl AS (SELECT *, {Q.norm_text('line')} AS norm FROM dl)"""

query("text_lines", f"WITH {DOC_LINES} SELECT doc_id, line_no, line FROM dl")(lambda db: corpus.lines(db.base("documents"), db.parts))
query("text_normalized", f"WITH {DOC_LINES} SELECT doc_id, line_no, norm FROM nl")(
    lambda db: corpus.lines(db.base("documents"), db.parts).select("doc_id", "line_no", X.normalize_text("line").alias("norm")))
query("text_keys", f"SELECT doc_id, {Q.norm_key('text')} AS key FROM documents")(
    lambda db: db.base("documents").select("doc_id", X.norm_key("text").alias("key")))
query("text_clean", f"SELECT doc_id, {Q.clean('text')} AS cleaned FROM documents")(
    lambda db: db.base("documents").select("doc_id", X.clean_text("text").alias("cleaned")))
query("codes_normalized", """SELECT id, upper(regexp_replace(code, '\\s+', '', 'g')) AS code, CASE WHEN n % 3 = 0 THEN '' ELSE code END AS explicit, n % 5 <> 0 AND n % 3 <> 0 AS strong FROM (
  SELECT id, code, CAST(substr(code, 9) AS BIGINT) AS n FROM proposals) x""")(lambda db: _codes(db))


def _codes(db):
    n = F.substring("code", 9, 20).cast("bigint")
    raw = F.when(n % 3 == 0, F.concat(F.lit("pm-imp-s2-"), n.cast("string"))).when(n % 5 == 0, F.concat(F.lit("PM-"), n.cast("string"))).otherwise(F.col("code"))
    explicit = X.explicit_code(raw)
    return db.t.proposals.select("id", X.norm_code(F.concat(F.substring("code", 1, 3), F.lit(" "), F.lower(F.substring("code", 4, 30)))).alias("code"),
                                 F.when(explicit == "", "").otherwise(F.col("code")).alias("explicit"), X.is_strong_code(explicit).alias("strong"))


_HI = "riesgo:? alt[oa]|criticidad:? alta|severidad:? alta|riesgo critico|criticidad critica"
_LO = "riesgo:? baj[oa]|criticidad:? baja|severidad:? baja|riesgo leve|riesgo menor"
_ME = "riesgo:? medi[oa]|criticidad:? media|severidad:? media|riesgo moderad[oa]"


def _sev(n):
    return (f"CASE WHEN regexp_matches({n}, '{_HI}') THEN 'Alto' WHEN regexp_matches({n}, '{_LO}') THEN 'Bajo' WHEN regexp_matches({n}, '{_ME}') THEN 'Medio' "
            f"WHEN regexp_matches({n}, 'alto|alta|critico|critica') THEN 'Alto' WHEN regexp_matches({n}, 'bajo|baja|leve|menor') THEN 'Bajo' ELSE 'Medio' END")


query("text_severity", f"SELECT doc_id, {_sev(Q.norm_text('text'))} AS severity FROM documents")(
    lambda db: db.base("documents").select("doc_id", X.detect_severity("text").alias("severity")))
query("text_summaries", f"""WITH s AS (SELECT doc_id, {Q.clean('text')} AS t FROM documents), u AS (SELECT doc_id, t, unnest(string_split(regexp_replace(t, '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1))) AS x,
  generate_subscripts(string_split(regexp_replace(t, '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1)), 1) AS i FROM s),
 c AS (SELECT *, sum(length(x) + 1) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM u WHERE x <> ''),
 k AS (SELECT doc_id, string_agg(x, ' ' ORDER BY i) AS kept FROM c WHERE run <= 500 GROUP BY doc_id)
 SELECT s.doc_id, CASE WHEN length(t) <= 500 THEN t ELSE coalesce(kept, substr(t, 1, 500)) END AS summary FROM s LEFT JOIN k USING (doc_id)""")(
    lambda db: db.base("documents").select("doc_id", X.summarize("text", 500).alias("summary")))
_PRE = r"(?i)^(?:hallazgo|observaci[oó]n|desviaci[oó]n|punto|ítem|item)\s*(?:n[°º]?\s*)?\d*\s*[:\-\.]\s*"
query("text_titles", f"""WITH a AS (SELECT doc_id, {Q.clean('text')} AS w, trim(regexp_replace('Observación n° ' || doc_id || ': ' || {Q.clean('text')}, '{_PRE}', '')) AS b FROM documents),
 h AS (SELECT *, substr(b, 1, 100) AS head, length(regexp_extract(substr(b, 1, 100), '^(.*) ', 1)) AS sp FROM a),
 t AS (SELECT *, CASE WHEN length(b) <= 100 THEN b WHEN sp > 25 THEN substr(head, 1, sp) ELSE head END AS c FROM h)
 SELECT doc_id, CASE WHEN b = '' THEN substr('Observación n° ' || doc_id || ':', 1, 100) ELSE upper(substr(c, 1, 1)) || substr(c, 2) END AS title FROM t""")(
    lambda db: db.base("documents").select("doc_id", X.clean_title(F.concat(F.lit("Observación n° "), F.col("doc_id").cast("string"), F.lit(": "), "text")).alias("title")))
query("text_references", f"""WITH m AS (SELECT doc_id, line_no, unnest(regexp_extract_all(line, '(?i)\\b(?:hallazgos?|observaci[oó]n(?:es)?|desviaci[oó]n(?:es)?|h)\\s*(?:n[°º]?\\s*|-)?(\\d+(?:\\s*(?:,|y|e)\\s*\\d+)*)', 1)) AS g FROM report_lines),
 n AS (SELECT doc_id, line_no, list_sort(list_distinct(flatten(list(list_transform(regexp_extract_all(g, '\\d+'), lambda x: CAST(x AS BIGINT)))))) AS v FROM m GROUP BY 1, 2)
 SELECT doc_id, line_no, array_to_string(v, ',') AS refs FROM n""")(
    lambda db: db.view("report_lines").select("doc_id", "line_no", F.concat_ws(",", X.finding_references("line").cast("array<string>")).alias("refs")).filter("refs <> ''"))
query("text_source_keys", "SELECT id, substr(md5('informe_' || CAST(substr(id, 2) AS VARCHAR) || '_' || title), 1, 12) AS key FROM findings")(
    lambda db: db.t.findings.select("id", X.source_key(F.lit("informe"), F.substring("id", 2, 20), "title").alias("key")))
query("text_areas", """SELECT doc_id, CASE WHEN doc_id % 4 = 1 THEN 'Sector ' || doc_id % 7 ELSE 'Operaciones' END AS area,
  CASE WHEN doc_id % 4 = 1 THEN 'Equipo ' || doc_id % 3 ELSE 'Auditoría Interna' END AS auditor, CASE WHEN doc_id % 4 = 1 THEN 'Informe de Auditoría ' || doc_id
  ELSE 'Informe de Auditoría - doc-' || doc_id || '.txt' END AS title, doc_id % 4 = 1 AS has_headings FROM documents""")(
    lambda db: corpus.document_headers(db.view("report_texts")).select("doc_id", "area", "auditor", "title", "has_headings"))

# --- Line rules ----------------------------------------------------------------------------------------

_OTHER = ("alcance|metodologia|objetivo|objetivos|introduccion|antecedentes|contexto|conclusion|conclusiones|resumen ejecutivo|anexo|anexos|referencias|glosario|indice|"
          "marco normativo|marco de referencia|cronograma|equipo auditor|distribucion|caratula|portada|periodo|tabla de contenido|contenido|contenidos")
_RULES = f"""strpos(line, '|') = 0 AND (regexp_matches(line, '(?i)^(?:\\d+[\\.\\)]\\s*)?(?:hallazgo|observaci[oó]n|desviaci[oó]n|punto|ítem|item)\\s*(?:n[°º]?\\s*)?\\d+')
   OR (length(line) < 120 AND regexp_matches(line, '(?i)^(?:\\d+[\\.\\)]\\s*)?hallazgo(?:[^\\p{{L}}\\p{{N}}_]|$)'))) AS is_finding,
  strpos(line, '|') = 0 AND length(line) < 120 AND strpos(norm, 'solapa:') = 0 AND norm NOT LIKE '===%' AND (regexp_matches(norm, '(?:^|\\d+[\\. ]+)(?:{_OTHER})s?\\s*[:.]?\\s*$')
   OR regexp_matches(norm, '^(?:{_OTHER})[:. ]*$')) AS is_other,
  regexp_matches(norm, '^(?:propuesta|recomendacion|accion correctiva|mejora sugerida|sugerencia|medida correctiva|accion recomendada)') AS is_proposal"""
_RL = f"rl AS (SELECT doc_id, line_no, line, {Q.norm_text('line')} AS norm FROM report_lines)"
query("line_rules_report_lines", f"WITH {_RL} SELECT doc_id, line_no, {_RULES}, line_no = 900 AS is_section FROM rl")(
    lambda db: corpus.classified(db.view("report_lines")).select("doc_id", "line_no", "is_finding", "is_other", "is_proposal", "is_section"))
query("line_rules_documents", f"WITH {DOC_LINES} SELECT doc_id, line_no, {_RULES} FROM nl")(
    lambda db: corpus.classified(corpus.lines(db.base("documents"), db.parts)).select("doc_id", "line_no", "is_finding", "is_other", "is_proposal"))

# --- Findings and proposals of a line table ------------------------------------------------------------

SPAN = 64
_KS = "ks AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY n) AS number, lag(part) OVER w AS pp, lag(q) OVER w AS pq FROM report_items WINDOW w AS (PARTITION BY doc_id ORDER BY n))"
_FOUND = f"""{_KS}, ff AS (SELECT doc_id, number, n::BIGINT AS source_number, 'Desvío en parte ' || part AS title, CASE WHEN q >= 40 OR (pp % 2 = 1 AND pq >= 40) THEN 'Alto'
  WHEN q <= 10 OR (pp % 2 = 1 AND pq <= 10) THEN 'Bajo' ELSE 'Medio' END AS severity, CASE WHEN part % 2 = 0 THEN 'revisar la parte ' || part ELSE '' END AS proposal,
  'Sector ' || doc_id % 7 AS responsible_area FROM ks)"""
_PROPS = """pr AS (SELECT DISTINCT doc_id, v.* FROM report_items, (VALUES (1, 'Fortalecer los controles para los Hallazgos 1, 2 y 3.', '1,2,3', 'linked'),
  (2, 'Actualizar el manual de procedimientos generales.', '', 'unlinked'), (3, 'Capacitar al personal del hallazgo n° 4 y dejar constancia en acta.', '4', 'linked')) v(number, proposal_text, refs, link_status))"""


def _line_sections(db):
    return settle(corpus.sectioned(db.view("report_lines"), SPAN), "sections")


def _line_findings(db):
    rows = db.view("report_lines")
    return corpus.explicit_findings(_line_sections(db), corpus.line_headers(rows), SPAN)


query("findings_under_headings", f"WITH {_FOUND} SELECT doc_id, number, source_number, title, title AS situation, 'Fallback (title)' AS situation_source, severity, proposal, responsible_area FROM ff")(
    lambda db: _line_findings(db).select("doc_id", "number", "source_number", "title", "situation", "situation_source", "severity", "proposal", "responsible_area"))
query("global_proposals", f"WITH {_PROPS} SELECT doc_id, number, proposal_text, refs, link_status FROM pr")(
    lambda db: corpus.global_proposals(_line_sections(db), SPAN).select("doc_id", "number", "proposal_text", F.concat_ws(",", F.col("finding_numbers").cast("array<string>")).alias("refs"), "link_status"))
query("proposals_linked_to_findings", f"""WITH {_FOUND}, {_PROPS} SELECT ff.doc_id, ff.number, ff.source_number, pr.number AS proposal_number FROM ff JOIN pr ON ff.doc_id = pr.doc_id
  AND list_contains(string_split(refs, ','), CAST(source_number AS VARCHAR))""")(lambda db: _links(db))


def _links(db):
    sections = _line_sections(db)
    found = corpus.explicit_findings(sections, corpus.line_headers(db.view("report_lines")), SPAN)
    return corpus.link_proposals(found, corpus.global_proposals(sections, SPAN)).select("doc_id", "number", "source_number", "proposal_number")


# --- Whole documents -----------------------------------------------------------------------------------

_BLOCKS = f"""WITH RECURSIVE {DOC_LINES},
 v AS (SELECT doc_id, line, row_number() OVER (PARTITION BY doc_id ORDER BY line_no) AS k FROM nl WHERE length(line) > 15 AND NOT (strpos(norm, 'solapa:') = 0 AND norm NOT LIKE '===%'
   AND (regexp_matches(norm, '(?:^|\\d+[\\. ]+)(?:{_OTHER})s?\\s*[:.]?\\s*$') OR regexp_matches(norm, '^(?:{_OTHER})[:. ]*$')))),
 walk AS (SELECT doc_id, k, line, 1 AS blk, length(line) AS size FROM v WHERE k = 1
   UNION ALL SELECT v.doc_id, v.k, v.line, CASE WHEN w.size >= 300 THEN w.blk + 1 ELSE w.blk END, CASE WHEN w.size >= 300 THEN length(v.line) ELSE w.size + length(v.line) END
   FROM walk w JOIN v ON v.doc_id = w.doc_id AND v.k = w.k + 1)
 SELECT doc_id, blk::BIGINT AS number, substr(arg_min(line, k), 1, 90) AS title, string_agg(line, ' ' ORDER BY k) AS text FROM walk GROUP BY doc_id, blk"""
query("paragraph_blocks", _BLOCKS)(lambda db: corpus.paragraph_blocks(db.base("documents"), parts=db.parts).select("doc_id", "number", "title", "text"))
_DL = DOC_LINES.replace("FROM documents", "FROM report_texts")
_CUT_500 = """sm AS (SELECT k, t, unnest(string_split(regexp_replace(t, '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1))) AS x,
   generate_subscripts(string_split(regexp_replace(t, '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1)), 1) AS i FROM long_texts),
 sc AS (SELECT *, sum(length(x) + 1) OVER (PARTITION BY k ORDER BY i) AS run FROM sm WHERE x <> ''),
 sk AS (SELECT k, string_agg(x, ' ' ORDER BY i) AS kept FROM sc WHERE run <= 500 GROUP BY k),
 short AS (SELECT k, CASE WHEN length(t) <= 500 THEN t ELSE coalesce(kept, substr(t, 1, 500)) END AS s FROM long_texts LEFT JOIN sk USING (k))"""
_PARSED = f"""{_DL}, marks AS (SELECT doc_id, min(line_no) FILTER (WHERE line = 'Hallazgo 1: pagos sin doble firma') AS h1, max(line_no) FILTER (WHERE line = 'Hallazgo 5: ' || doc_id) AS h5,
   max(line_no) FILTER (WHERE line = '7. PROPUESTAS DE MEJORA') AS sec FROM dl WHERE doc_id % 4 = 1 GROUP BY 1),
 body AS (SELECT doc_id, string_agg(line, ' ' ORDER BY line_no) FILTER (WHERE line_no > h1 AND line_no < h5) AS first_body,
   string_agg(CASE WHEN line_no = h5 + 2 THEN trim(regexp_replace(line, '^Recomendación:\\s*', '')) ELSE line END, ' ' ORDER BY line_no) FILTER (WHERE line_no >= h5 + 2 AND line_no < sec) AS own,
   max(line) FILTER (WHERE line_no = h5 - 1) AS prev FROM dl JOIN marks USING (doc_id) GROUP BY 1),
 cells AS (SELECT doc_id, line_no, line, list_transform(string_split(line, '|'), lambda c: trim(c)) AS c FROM dl WHERE doc_id % 4 = 2 AND line_no > 1 AND contains(line, '|') AND NOT starts_with(line, '===')),
 cell AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY line_no) AS number FROM cells WHERE length(c[2]) >= 3
   AND {Q.norm_text('c[2]')} NOT IN ('hallazgo', 'hallazgos', 'situacion', 'situacion observada', 'descripcion del hallazgo')),
 v AS (SELECT doc_id, line, row_number() OVER (PARTITION BY doc_id ORDER BY line_no) AS k FROM nl WHERE doc_id % 4 IN (0, 3) AND length(line) > 15 AND NOT (strpos(norm, 'solapa:') = 0 AND norm NOT LIKE '===%'
   AND (regexp_matches(norm, '(?:^|\\d+[\\. ]+)(?:{_OTHER})s?\\s*[:.]?\\s*$') OR regexp_matches(norm, '^(?:{_OTHER})[:. ]*$')))),
 walk AS (SELECT doc_id, k, line, 1 AS blk, length(line) AS size FROM v WHERE k = 1
   UNION ALL SELECT v.doc_id, v.k, v.line, CASE WHEN w.size >= 300 THEN w.blk + 1 ELSE w.blk END, CASE WHEN w.size >= 300 THEN length(v.line) ELSE w.size + length(v.line) END
   FROM walk w JOIN v ON v.doc_id = w.doc_id AND v.k = w.k + 1),
 blocks AS (SELECT doc_id, blk::BIGINT AS number, substr(arg_min(line, k), 1, 90) AS title, string_agg(line, ' ' ORDER BY k) AS t FROM walk GROUP BY doc_id, blk),
 raw AS (SELECT doc_id, 1::BIGINT AS number, 1::BIGINT AS source_number, NULL AS code, 'Pagos sin doble firma' AS title, 'Pagos sin doble firma' AS long, 'Fallback (title)' AS situation_source, '' AS risk, 'Alto' AS severity,
   'Sector ' || doc_id % 7 AS area, '' AS proposal, 'Hallazgo 1: pagos sin doble firma' || chr(10) || first_body AS source_text FROM body
  UNION ALL SELECT doc_id, 2, 5, NULL, doc_id::VARCHAR, 'Resumen: se revisó la muestra completa.', 'Fallback (summary)', '', CASE {_sev(Q.norm_text("prev || ' Hallazgo 5: ' || doc_id || ' Resumen: se revisó la muestra completa.'"))}
   WHEN 'Medio' THEN {_sev(Q.norm_text("prev || ' Hallazgo 5: ' || doc_id"))} ELSE {_sev(Q.norm_text("prev || ' Hallazgo 5: ' || doc_id || ' Resumen: se revisó la muestra completa.'"))} END,
   'Sector ' || doc_id % 7, own, 'Hallazgo 5: ' || doc_id || chr(10) || 'Resumen: se revisó la muestra completa.' || CASE WHEN own <> '' THEN chr(10) || 'Propuesta / recomendación original:' || chr(10) || own ELSE '' END FROM body
  UNION ALL SELECT doc_id, number, number, NULL, substr(c[2], 1, 100), c[2], 'Fallback (summary)', coalesce(c[3], ''), CASE WHEN coalesce(c[3], '') = '' THEN 'Medio' ELSE {_sev(Q.norm_text('c[3]'))} END,
   coalesce(nullif(c[5], ''), 'Operaciones'), coalesce(c[4], ''), c[2] || CASE WHEN coalesce(c[4], '') <> '' THEN chr(10) || 'Propuesta / recomendación original:' || chr(10) || c[4] ELSE '' END FROM cell
  UNION ALL SELECT doc_id, number, number, NULL, title, t, 'Fallback heurístico (Párrafos)', '', 'Medio', 'Operaciones', '', t FROM blocks),
 keyed AS (SELECT *, row_number() OVER (ORDER BY doc_id, number) AS id FROM raw),
 long_texts AS (SELECT 2 * id AS k, long AS t FROM keyed UNION ALL SELECT 2 * id + 1, proposal FROM keyed),
 {_CUT_500}, found AS (SELECT keyed.*, a.s AS situation, CASE WHEN doc_id % 4 = 1 THEN b.s ELSE proposal END AS own FROM keyed JOIN short a ON a.k = 2 * id JOIN short b ON b.k = 2 * id + 1)"""
query("corpus_findings", f"""WITH RECURSIVE {_PARSED} SELECT doc_id, number, source_number, substr(md5('doc-' || doc_id || '.txt_' || number || '_' || title), 1, 12) AS source_key, 'doc-' || doc_id || '.txt' AS source_file,
  CASE WHEN doc_id % 4 IN (0, 3) THEN 'Párrafo / Bloque ' ELSE 'Sección / Fila ' END || number AS source_location, coalesce(code, 'H-2026-' || printf('%03d', source_number)) AS code, {Q.clean('title')} AS title, situation,
  situation_source, risk, severity, area AS responsible_area, 'Pendiente de definir' AS action_owner, 'Pendiente' AS status, '' AS observations, '' AS cause, '' AS impact, source_text FROM found""")(lambda db: corpus.parse_documents(db.view("report_texts"), db.parts).findings)
query("corpus_proposals", f"""WITH RECURSIVE {_PARSED} SELECT doc_id, number, CASE WHEN linked THEN 1 END::BIGINT AS proposal_number, CASE WHEN linked THEN 'Configurar la firma conjunta (Hallazgo 1).' ELSE trim(own) END AS proposal_text,
  severity, area AS responsible_area, 'Pendiente de definir' AS action_owner, CASE WHEN linked THEN 'Configurar la firma conjunta (Hallazgo 1).' ELSE proposal END AS source_text, 'Pendiente' AS status
  FROM (SELECT *, doc_id % 4 = 1 AND source_number = 1 AS linked FROM found) x WHERE linked OR own <> ''""")(lambda db: corpus.parse_documents(db.view("report_texts"), db.parts).finding_proposals)
query("corpus_routes", f"""WITH c AS (SELECT CASE WHEN doc_id % 4 = 1 THEN 'heading' WHEN doc_id % 4 = 2 THEN 'table' ELSE 'paragraph' END AS route, doc_id FROM documents)
  SELECT route, count(DISTINCT doc_id) AS documents FROM c GROUP BY route""")(
    lambda db: corpus.parse_documents(db.view("report_texts"), db.parts).findings.groupBy(
        F.when(F.col("situation_source").startswith("Fallback heur"), "paragraph").when(F.col("situation_source") == "Fallback (summary)", F.when(
            F.col("doc_id") % 4 == 2, "table").otherwise("heading")).otherwise("heading").alias("route")).agg(F.count_distinct("doc_id").alias("documents")))
query("corpus_reports", """SELECT doc_id, 'doc-' || doc_id || '.txt' AS source_filename, CASE WHEN doc_id % 4 = 1 THEN 'Sector ' || doc_id % 7 WHEN doc_id % 4 = 2 THEN 'Tesorería' ELSE 'Operaciones' END AS area
  FROM documents""")(lambda db: corpus.parse_documents(db.view("report_texts"), db.parts).reports.select("doc_id", "source_filename", "area"))

# --- Scalar functions over the tables ------------------------------------------------------------------

query("parse_dates", f"""SELECT id, strftime({Q.date('target_date')}, '%Y-%m-%d') AS iso, coalesce(strftime({Q.date('target_date')}, '%d/%m/%Y'), 'Sin fecha') AS shown,
  coalesce({Q.date('target_date')} < {CUT}, false) AS past, greatest(coalesce(date_diff('day', {Q.date('target_date')}, {CUT}), 0), 0)::INT AS days FROM proposals""")(
    lambda db: db.t.proposals.select("id", D.to_iso("target_date").alias("iso"), D.display_date("target_date").alias("shown"),
                                     D.is_past("target_date", db.cut).alias("past"), D.days_overdue(D.parse_date("target_date"), db.cut).alias("days")))
query("status_functions", f"""SELECT id, {Q.norm_status('status')} AS norm, {Q.norm_severity('severity')} AS severity, {Q.norm_status('status')} = 'Finalizado' AS final,
  {Q.effective('status', Q.date('target_date'))} AS effective FROM proposals""")(
    lambda db: db.t.proposals.select("id", normalize_status("status").alias("norm"), normalize_severity("severity").alias("severity"),
                                     is_final_status("status").alias("final"), effective_status("status", "target_date", db.cut).alias("effective")))
query("clamp_progress", "SELECT event_id, CASE WHEN value IS NULL THEN 0 ELSE greatest(0, least(100, trunc(value)))::INT END AS pct FROM events")(
    lambda db: db.base("events").select("event_id", clamp_progress("value").alias("pct")))
