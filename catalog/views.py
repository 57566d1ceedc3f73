"""Entity tables derived from the driver's tables. The text runs in Spark and in DuckDB alike."""

from __future__ import annotations

import datetime
from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from rastro.schema import Tables
from rastro.session import settle, spread, stored_bytes, tune

CUT = datetime.date(1998, 9, 2)
CUT_SQL = "DATE '1998-09-02'"

BASE = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents",
        "embeddings", "pages", "benchmark", "labels", "conversations"]

VIEWS: dict[str, str] = {}

VIEWS["reports"] = """
SELECT 'r' || CAST(n_nationkey AS STRING)                AS id,
       'AUD-2026-' || CAST(100 + n_nationkey AS STRING)  AS code,
       'Informe ' || n_name                              AS title,
       'Proceso ' || r_name                              AS process,
       r_name                                            AS area,
       CAST(2020 + n_nationkey % 6 AS STRING)            AS period,
       CASE WHEN n_nationkey % 4 = 0 THEN NULL ELSE 'Auditor ' || r_name END AS auditor,
       'informe-' || CAST(n_nationkey AS STRING) || '.xlsx' AS source_filename,
       CAST(DATE '1998-01-01' + INTERVAL '1' DAY * n_nationkey AS DATE) AS created_at
FROM {nation} JOIN {region} ON n_regionkey = r_regionkey"""

VIEWS["findings"] = """
SELECT 'f' || CAST(c_custkey AS STRING)                  AS id,
       'r' || CAST(c_nationkey AS STRING)                AS report_id,
       'H-2026-' || CAST(1000 + c_custkey AS STRING)     AS code,
       c_name                                            AS title,
       'Situación ' || c_mktsegment || ' ' || c_name     AS situation,
       CASE c_mktsegment WHEN 'AUTOMOBILE' THEN 'Alto' WHEN 'BUILDING' THEN 'crítico'
            WHEN 'FURNITURE' THEN 'Medio' WHEN 'HOUSEHOLD' THEN 'BAJA' ELSE NULL END AS severity,
       CASE WHEN c_custkey % 10 = 0 THEN '' WHEN c_custkey % 10 = 1 THEN NULL
            ELSE 'Área ' || CAST(c_custkey % 7 AS STRING) END AS responsible_area,
       CASE WHEN c_custkey % 6 = 0 THEN '' ELSE 'Resp ' || CAST(c_custkey % 13 AS STRING) END AS action_owner,
       CASE c_custkey % 8 WHEN 0 THEN 'Finalizado' WHEN 1 THEN 'Completada' WHEN 2 THEN 'stand-by'
            WHEN 3 THEN 'Pendiente de validacion' WHEN 4 THEN NULL ELSE 'En proceso' END AS status,
       CASE WHEN c_custkey % 5 = 0 THEN 'Obs ' || c_name ELSE '' END AS observations,
       CAST(DATE '1998-09-02' - INTERVAL '1' DAY * (c_custkey % 130) AS DATE) AS created_at
FROM {customer}"""

VIEWS["proposals"] = """
SELECT 'p' || CAST(o_orderkey AS STRING)                 AS id,
       'f' || CAST(CASE WHEN o_custkey % 25 = 0 THEN o_custkey + 1 ELSE o_custkey END AS STRING) AS finding_id,
       'PM-2026-' || CAST(10000 + o_orderkey AS STRING)  AS code,
       'Propuesta ' || CAST(o_orderkey AS STRING)        AS title,
       CASE WHEN o_orderkey % 13 = 0 THEN '' ELSE 'Mejorar el control ' || CAST(o_orderkey AS STRING) END AS proposal_text,
       CASE o_orderpriority WHEN '1-URGENT' THEN 'high' WHEN '2-HIGH' THEN 'ALTA'
            WHEN '3-MEDIUM' THEN 'media' WHEN '5-LOW' THEN 'leve' ELSE '' END AS severity,
       CASE WHEN o_orderkey % 9 = 0 THEN '' ELSE 'Área ' || CAST(o_orderkey % 5 AS STRING) END AS responsible_area,
       CASE WHEN o_orderkey % 11 = 0 THEN 'Pendiente de definir' WHEN o_orderkey % 11 = 1 THEN ''
            ELSE 'Resp ' || CAST(o_orderkey % 17 AS STRING) END AS action_owner,
       CASE WHEN o_orderkey % 7 = 0 THEN '' WHEN o_orderkey % 7 = 1 THEN NULL
            WHEN o_orderkey % 7 = 2 THEN substr(CAST(CAST(o_orderdate AS DATE) AS STRING), 9, 2) || '/' ||
                 substr(CAST(CAST(o_orderdate AS DATE) AS STRING), 6, 2) || '/' ||
                 substr(CAST(CAST(o_orderdate AS DATE) AS STRING), 1, 4)
            ELSE CAST(CAST(o_orderdate AS DATE) AS STRING) END AS target_date,
       CASE o_orderstatus WHEN 'F' THEN 'Finalizado' WHEN 'O' THEN 'En proceso'
            ELSE CASE WHEN o_orderkey % 2 = 0 THEN 'En suspensión' ELSE 'Pendiente de validación' END END AS status,
       CASE WHEN o_orderstatus = 'F' AND o_orderkey % 3 <> 0 THEN 'Auditor' ELSE NULL END AS validated_by,
       CASE WHEN o_orderstatus = 'F' AND o_orderkey % 3 = 1 THEN '1998-08-01' ELSE NULL END AS validated_at
FROM {orders}"""

VIEWS["action_plans"] = """
SELECT 'a' || CAST(l_orderkey AS STRING) || '-' || CAST(l_linenumber AS STRING) AS id,
       'p' || CAST(l_orderkey AS STRING)                 AS proposal_id,
       'PA-2026-' || CAST(100000 + l_orderkey * 10 + l_linenumber AS STRING) AS code,
       'Plan ' || CAST(l_orderkey AS STRING)             AS title,
       'Acción ' || CAST(l_linenumber AS STRING)         AS action_text,
       CASE WHEN max(l_partkey) % 12 = 0 THEN NULL ELSE 'Resp ' || CAST(max(l_suppkey) % 17 AS STRING) END AS action_owner,
       CASE WHEN max(l_partkey) % 10 = 0 THEN '' ELSE CAST(CAST(max(l_shipdate) AS DATE) AS STRING) END AS target_date,
       CASE WHEN max(l_linestatus) = 'F' AND max(l_returnflag) = 'R' THEN 'Finalizado'
            WHEN max(l_returnflag) = 'A' AND max(l_linestatus) = 'O' THEN 'en suspension'
            WHEN max(l_quantity) = 50 THEN 'Pendiente de validación' ELSE 'En proceso' END AS status,
       CAST(max(l_quantity) * 2 AS INT)                  AS progress_pct,
       CASE WHEN max(l_linestatus) = 'F' AND max(l_returnflag) = 'R' AND max(l_partkey) % 8 <> 0
            THEN CAST(CAST(min(l_shipdate) + INTERVAL '5' DAY * (max(l_suppkey) % 3 - 1) AS DATE) AS STRING) ELSE NULL END AS closed_date,
       CASE WHEN max(l_partkey) % 20 = 0 THEN 'ev-' || CAST(l_orderkey AS STRING) || '.pdf' ELSE '' END AS evidence_file,
       CASE WHEN max(l_partkey) % 15 = 0 THEN 'Nota ' || CAST(l_orderkey AS STRING) ELSE '' END AS notes,
       CAST(max(l_shipdate) - INTERVAL '40' DAY AS DATE) AS last_updated
FROM {lineitem}
GROUP BY l_orderkey, l_linenumber"""

VIEWS["audit_history"] = """
SELECT 'h' || CAST(event_id AS STRING)                   AS id,
       CASE event_type WHEN 'purchase' THEN 'report' WHEN 'view' THEN 'finding'
            WHEN 'click' THEN 'proposal' ELSE 'action_plan' END AS entity_type,
       CASE event_type WHEN 'purchase' THEN 'r' || CAST(user_id % 25 AS STRING)
            WHEN 'view' THEN 'f' || CAST(user_id AS STRING) WHEN 'click' THEN 'p' || CAST(user_id AS STRING)
            ELSE 'a' || CAST(user_id AS STRING) || '-1' END AS entity_id,
       ts                                                AS change_date,
       'Usuario ' || CAST(user_id % 5 AS STRING)         AS user_name,
       'Evento ' || event_type                           AS description
FROM {events}"""

VIEWS["plan_changes"] = """
SELECT id AS plan_id,
       CAST(CAST(substr(code, 9) AS BIGINT) AS BIGINT)   AS change_no,
       CASE WHEN progress_pct % 4 = 0 THEN 'Finalizado' WHEN progress_pct % 6 = 0 THEN 'En proceso' ELSE NULL END AS status,
       CASE WHEN progress_pct % 10 = 0 THEN 100 WHEN progress_pct % 14 = 0 THEN 250 ELSE NULL END AS progress_pct,
       progress_pct % 8 = 0                              AS confirm_finalize
FROM {action_plans}"""

VIEWS["plan_log"] = """
SELECT 'a' || CAST(l_orderkey AS STRING) || '-' || CAST(l_linenumber AS STRING) AS plan_id,
       max(l_partkey) * 100000 + max(l_suppkey) * 10 + l_linenumber AS change_no,
       CASE WHEN max(l_partkey) % 5 = 0 THEN 'Finalizado' WHEN max(l_partkey) % 5 = 1 THEN 'En proceso' ELSE NULL END AS status,
       CASE WHEN max(l_suppkey) % 3 = 0 THEN 100 WHEN max(l_suppkey) % 3 = 1 THEN CAST(max(l_quantity) AS INT) ELSE NULL END AS progress_pct,
       max(l_partkey) % 2 = 0                            AS confirm_finalize
FROM {lineitem}
GROUP BY l_orderkey, l_linenumber, l_partkey"""

VIEWS["finding_edits"] = """
SELECT id, CASE CAST(substr(code, 8) AS BIGINT) % 9 WHEN 0 THEN 'cerrado' WHEN 1 THEN 'En proceso' WHEN 2 THEN 'stand-by' ELSE NULL END AS status,
       CASE WHEN CAST(substr(code, 8) AS BIGINT) % 4 = 0 THEN 'Resp editado' ELSE NULL END AS action_owner,
       CASE WHEN CAST(substr(code, 8) AS BIGINT) % 5 = 0 THEN 'Título nuevo' ELSE NULL END AS title
FROM {findings}"""

VIEWS["proposal_edits"] = """
SELECT id, CASE CAST(substr(code, 9) AS BIGINT) % 11 WHEN 0 THEN 'Implementada' WHEN 1 THEN 'En proceso' WHEN 2 THEN 'stand-by' ELSE NULL END AS status,
       CASE CAST(substr(code, 9) AS BIGINT) % 11 WHEN 3 THEN '15/03/1999' WHEN 4 THEN 'a definir' ELSE NULL END AS target_date,
       CASE WHEN CAST(substr(code, 9) AS BIGINT) % 6 = 0 THEN 'Resp editado' ELSE NULL END AS action_owner
FROM {proposals}"""

# A findings sheet per report. Rows of a finding stand together: the row number is the customer key
# followed by the order key, so no window is needed to number the rows.
VIEWS["sheet_rows"] = """
SELECT f.report_id AS file, (CAST(substr(f.id, 2) AS BIGINT) + 1) * 10000000000 + coalesce(p.n, 0) AS row_no,
       CASE WHEN coalesce(p.n, 0) = coalesce(m.n, 0) THEN coalesce(f.responsible_area, '') ELSE '' END AS area,
       CASE WHEN coalesce(p.n, 0) = coalesce(m.n, 0) AND CAST(substr(f.id, 2) AS BIGINT) % 17 <> 0 THEN f.code ELSE '' END AS h_code,
       CASE WHEN coalesce(p.n, 0) = coalesce(m.n, 0) AND CAST(substr(f.id, 2) AS BIGINT) % 23 <> 0 THEN f.situation ELSE '' END AS situation,
       CASE WHEN p.n % 19 = 0 THEN '' ELSE coalesce(p.code, '') END AS p_code, coalesce(p.title, '') AS prop_text,
       coalesce(f.severity, '') AS risk, coalesce(p.action_owner, '') AS owner, coalesce(p.target_date, '') AS target_date,
       coalesce(p.status, '') AS status, CASE p.n % 5 WHEN 0 THEN '100%' WHEN 1 THEN '0.5' WHEN 2 THEN '30' ELSE '' END AS pct,
       CASE WHEN p.n % 4 = 0 THEN 'Acción ' || CAST(p.n AS STRING) ELSE '' END AS actions, coalesce(f.observations, '') AS obs
FROM {findings} f
LEFT JOIN (SELECT finding_id, code, title, action_owner, target_date, status, CAST(substr(id, 2) AS BIGINT) AS n FROM {proposals}) p ON p.finding_id = f.id
LEFT JOIN (SELECT finding_id, min(CAST(substr(id, 2) AS BIGINT)) AS n FROM {proposals} GROUP BY finding_id) m ON m.finding_id = f.id"""

VIEWS["sheet_proposals"] = """
SELECT f.report_id AS file, p.n * 2 AS row_no,
       CASE p.n % 6 WHEN 0 THEN p.code WHEN 1 THEN 'PM-X-' || CAST(p.n AS STRING) WHEN 2 THEN 'PM-Y-' || CAST(p.n AS STRING) ELSE '' END AS p_code,
       'Texto revisado ' || CAST(p.n AS STRING) AS prop_text,
       CASE p.n % 6 WHEN 2 THEN 'H-0' WHEN 4 THEN '' WHEN 5 THEN '' ELSE f.code END AS h_code,
       '' AS area, CASE WHEN p.n % 4 = 0 THEN 'Responsable nuevo' ELSE '' END AS owner,
       CASE WHEN p.n % 7 = 0 THEN '2026-11-30' ELSE '' END AS target_date, 'Pendiente' AS status
FROM (SELECT finding_id, code, CAST(substr(id, 2) AS BIGINT) AS n FROM {proposals}) p JOIN {findings} f ON p.finding_id = f.id
UNION ALL
SELECT f.report_id, p.n * 2 + 1, 'PM-X-' || CAST(p.n AS STRING), '', '', '', 'Segundo responsable', '', ''
FROM (SELECT finding_id, CAST(substr(id, 2) AS BIGINT) AS n FROM {proposals}) p JOIN {findings} f ON p.finding_id = f.id
WHERE p.n % 6 = 1"""

VIEWS["sheet_plans"] = """
SELECT f.report_id AS file, CAST(substr(a.code, 9) AS BIGINT) AS row_no,
       CASE WHEN CAST(substr(a.code, 9) AS BIGINT) % 7 = 6 THEN 'X1' ELSE a.code END AS pa_code, a.action_text,
       CASE CAST(substr(a.code, 9) AS BIGINT) % 7 WHEN 2 THEN 'PM-0' WHEN 3 THEN '' WHEN 4 THEN '' ELSE p.code END AS p_code,
       CASE CAST(substr(a.code, 9) AS BIGINT) % 7 WHEN 1 THEN 'H-0' WHEN 4 THEN '' WHEN 5 THEN '' ELSE f.code END AS h_code,
       coalesce(a.action_owner, '') AS owner, a.target_date, CAST(a.progress_pct AS STRING) || '%' AS pct, a.status, a.notes AS obs
FROM {action_plans} a JOIN {proposals} p ON a.proposal_id = p.id JOIN {findings} f ON p.finding_id = f.id"""

# The same finding sheet as landed cells, under three kinds of headers.
VIEWS["sheet_headers"] = """
SELECT 'r' || CAST(n_nationkey AS STRING) AS file, 'Hallazgos' AS sheet, h.col_no, h.value
FROM {nation} JOIN (
  SELECT 0 AS kind, 0 AS col_no, 'Área / Proceso' AS value UNION ALL SELECT 0, 1, 'ID Hallazgo' UNION ALL SELECT 0, 2, 'Hallazgo (Situación Observada)'
  UNION ALL SELECT 0, 3, 'ID Propuesta' UNION ALL SELECT 0, 4, 'Propuesta de Mejora (Recomendación)' UNION ALL SELECT 0, 5, 'Riesgo'
  UNION ALL SELECT 0, 6, 'Responsable' UNION ALL SELECT 0, 7, 'Fecha compromiso' UNION ALL SELECT 0, 8, 'Estado' UNION ALL SELECT 0, 9, 'Avance'
  UNION ALL SELECT 0, 10, 'Acciones' UNION ALL SELECT 0, 11, 'Observaciones'
  UNION ALL SELECT 1, 0, 'Sector' UNION ALL SELECT 1, 1, 'Código Hallazgo' UNION ALL SELECT 1, 2, 'Desviación' UNION ALL SELECT 1, 3, 'Propuesta vinculada'
  UNION ALL SELECT 1, 4, 'Medida' UNION ALL SELECT 1, 5, 'Criticidad' UNION ALL SELECT 1, 6, 'Líder' UNION ALL SELECT 1, 7, 'Plazo' UNION ALL SELECT 1, 8, 'Estatus'
  UNION ALL SELECT 1, 9, '% hecho' UNION ALL SELECT 1, 10, 'Plan' UNION ALL SELECT 1, 11, 'Notas' UNION ALL SELECT 1, 12, 'Otro responsable'
  UNION ALL SELECT 2, 0, 'a' UNION ALL SELECT 2, 1, 'b' UNION ALL SELECT 2, 2, 'c' UNION ALL SELECT 2, 3, 'd' UNION ALL SELECT 2, 4, 'e'
) h ON h.kind = n_nationkey % 3"""

# Audit-report text by line: headings, severity phrases, recommendations and a proposals section.
_K = "SELECT l_orderkey AS doc_id, l_linenumber AS n, max(l_partkey) AS part, max(l_quantity) AS q FROM {lineitem} GROUP BY l_orderkey, l_linenumber"
VIEWS["report_items"] = _K
VIEWS["report_lines"] = """
SELECT DISTINCT doc_id, 0 AS line_no, 'Informe de Auditoría Interna ' || CAST(doc_id AS STRING) AS line FROM {report_items}
UNION ALL SELECT DISTINCT doc_id, 1, 'Área auditada: Sector ' || CAST(doc_id % 7 AS STRING) FROM {report_items}
UNION ALL SELECT doc_id, n * 10, 'Hallazgo ' || CAST(n AS STRING) || ': desvío en parte ' || CAST(part AS STRING) FROM {report_items}
UNION ALL SELECT doc_id, n * 10 + 1, CASE WHEN q >= 40 THEN 'Riesgo: Alto' WHEN q <= 10 THEN 'Riesgo: Bajo' ELSE 'Sin nivel informado' END FROM {report_items}
UNION ALL SELECT doc_id, n * 10 + 2, 'Recomendación: revisar la parte ' || CAST(part AS STRING) FROM {report_items} WHERE part % 2 = 0
UNION ALL SELECT DISTINCT doc_id, 900, '7. PROPUESTAS DE MEJORA:' FROM {report_items}
UNION ALL SELECT DISTINCT doc_id, 901, '1. Fortalecer los controles para los Hallazgos 1, 2 y 3.' FROM {report_items}
UNION ALL SELECT DISTINCT doc_id, 902, '2. Actualizar el manual de procedimientos generales.' FROM {report_items}
UNION ALL SELECT DISTINCT doc_id, 903, '- Capacitar al personal del hallazgo n° 4' FROM {report_items}
UNION ALL SELECT DISTINCT doc_id, 904, 'y dejar constancia en acta.' FROM {report_items}
UNION ALL SELECT DISTINCT doc_id, 905, 'Anexos' FROM {report_items}"""

# The given documents as they are, below audit headings, or below a pipe-table header.
VIEWS["report_texts"] = """
SELECT doc_id, 'doc-' || CAST(doc_id AS STRING) || '.txt' AS filename,
  CASE doc_id % 4
  WHEN 1 THEN 'Informe de Auditoría ' || CAST(doc_id AS STRING) || chr(10) || 'Área auditada: Sector ' || CAST(doc_id % 7 AS STRING) || chr(10) ||
    'Auditor: Equipo ' || CAST(doc_id % 3 AS STRING) || chr(10) || 'Hallazgo 1: pagos sin doble firma' || chr(10) || 'Riesgo: Alto' || chr(10) || text || chr(10) ||
    'Hallazgo 5: ' || CAST(doc_id AS STRING) || chr(10) || 'Resumen: se revisó la muestra completa.' || chr(10) || 'Recomendación: ' || text || chr(10) ||
    '7. PROPUESTAS DE MEJORA' || chr(10) || '1. Configurar la firma conjunta (Hallazgo 1).' || chr(10) || '- Revisar procesos generales.'
  WHEN 2 THEN 'Listado' || chr(10) || 'Código | Hallazgo | Riesgo | Propuesta de mejora | Área' || chr(10) || 'T-' || CAST(doc_id AS STRING) ||
    ' | Falta conciliar saldos | riesgo alto | Conciliar por mes | Tesorería' || chr(10) || text
  ELSE text END AS text
FROM {documents}"""

VIEWS["merge_fields"] = """
SELECT id, 'title' AS field, title AS stored,
       CASE WHEN CAST(substr(code, 8) AS BIGINT) % 3 = 0 THEN title
            WHEN CAST(substr(code, 8) AS BIGINT) % 3 = 1 THEN 'anterior' ELSE NULL END AS baseline,
       CASE WHEN CAST(substr(code, 8) AS BIGINT) % 4 = 0 THEN '' WHEN CAST(substr(code, 8) AS BIGINT) % 4 = 1 THEN title
            ELSE title || ' v2' END AS incoming
FROM {findings}
UNION ALL
SELECT id, 'action_owner', action_owner,
       CASE WHEN CAST(substr(code, 8) AS BIGINT) % 2 = 0 THEN action_owner ELSE NULL END, 'Resp nuevo'
FROM {findings}"""

# A re-import of every report: some codes left out, made up or new, some titles changed.
VIEWS["in_findings"] = """
SELECT 'b' || substr(report_id, 2) AS batch, n AS row_no,
       CASE n % 10 WHEN 3 THEN '' WHEN 4 THEN 'H-2026-' || CAST(900000 + n AS STRING) WHEN 5 THEN 'H-IMP-005' ELSE code END AS code,
       CASE WHEN n % 4 = 1 THEN title || ' v2' ELSE title END AS title,
       CASE WHEN n % 10 = 4 THEN 'Nueva situación ' || CAST(n AS STRING) ELSE situation END AS situation,
       severity, responsible_area, action_owner, status, observations
FROM (SELECT *, CAST(substr(id, 2) AS BIGINT) AS n FROM {findings}) f"""
VIEWS["in_proposals"] = """
SELECT 'b' || substr(f.report_id, 2) AS batch, p.n AS row_no, CAST(substr(p.finding_id, 2) AS BIGINT) AS parent_row,
       CASE WHEN p.n % 12 = 0 AND p.n % 13 <> 0 OR CAST(substr(f.id, 2) AS BIGINT) % 10 = 4 THEN '' ELSE p.code END AS code, p.title, p.proposal_text, p.responsible_area, p.action_owner,
       CASE WHEN p.n % 8 = 0 THEN '30/06/2026' ELSE p.target_date END AS target_date, p.status
FROM (SELECT *, CAST(substr(id, 2) AS BIGINT) AS n FROM {proposals}) p JOIN {findings} f ON p.finding_id = f.id"""
VIEWS["in_plans"] = """
SELECT 'b' || substr(f.report_id, 2) AS batch, CAST(substr(a.code, 9) AS BIGINT) AS row_no, CAST(substr(p.id, 2) AS BIGINT) AS parent_row,
       CASE WHEN CAST(substr(f.id, 2) AS BIGINT) % 10 = 4 THEN '' ELSE a.code END AS code, a.title, a.action_text, a.action_owner, a.target_date, a.status,
       CAST(a.progress_pct AS STRING) AS progress_pct, a.notes
FROM {action_plans} a JOIN {proposals} p ON a.proposal_id = p.id JOIN {findings} f ON p.finding_id = f.id"""

VIEWS["stored_batches"] = """
SELECT 'i' || CAST(c_custkey AS STRING) AS id, 'r' || CAST(c_nationkey AS STRING) AS report_id, md5('content ' || CAST(c_custkey % 40 AS STRING)) AS content_fingerprint,
       md5('file ' || CAST(c_custkey % 60 AS STRING)) AS file_hash, c_name AS source_filename, 'new' AS mode, CAST(NULL AS STRING) AS summary,
       CAST(DATE '1998-01-01' + INTERVAL '1' DAY * (c_custkey % 300) AS DATE) AS created_at
FROM {customer}"""

#: Views that are written once per folder.
HELD = ["report_items"]

#: Stored bytes of documents per task: their lines are sorted several times, at many times this size.
TEXT_BYTES = 4 << 20

ENTITIES = ["reports", "findings", "proposals", "action_plans", "audit_history"]


def sql_text(name: str) -> str:
    """DuckDB form of a view: the placeholders become plain table names."""
    text = VIEWS[name]
    for n in [*BASE, *VIEWS]:
        text = text.replace("{" + n + "}", n)
    return text


# Read schemas by path, so that files are not opened again for every query of a session.
_FILE_SCHEMAS: dict[str, StructType] = {}


@dataclass
class Db:
    """The derived tables of one test-data folder."""

    spark: SparkSession
    sf_dir: str

    def __post_init__(self):
        tune(self.spark)
        self._frames: dict[str, DataFrame] = {}
        self._bytes: dict[str, int] = {}

    def base(self, name: str) -> DataFrame:
        if name not in self._frames:
            path = f"{self.sf_dir}/{name}.parquet"
            reader = self.spark.read
            if path in _FILE_SCHEMAS:
                reader = reader.schema(_FILE_SCHEMAS[path])
            self._frames[name] = reader.parquet(path)
            _FILE_SCHEMAS[path] = self._frames[name].schema
            self._bytes[name] = stored_bytes(self.spark, path)
            spread(self.spark, sum(self._bytes.values()))
        return self._frames[name]

    def view(self, name: str) -> DataFrame:
        if name not in self._frames:
            text = VIEWS[name]
            needed = {n: self.base(n) for n in BASE if "{" + n + "}" in text}
            needed |= {n: self.view(n) for n in VIEWS if "{" + n + "}" in text}
            frame = self.spark.sql(text, **needed)
            # A text that names an aggregated view many times reads it from where it is written once.
            self._frames[name] = settle(frame, name) if name in HELD else frame
        return self._frames[name]

    @cached_property
    def t(self) -> Tables:
        return Tables.of(**{n: self.view(n) for n in ENTITIES})

    def view_of(self, name: str, t: Tables) -> DataFrame:
        """A view over entity tables that are given, such as those written before."""
        return self.spark.sql(VIEWS[name], **{n: getattr(t, n) for n in ENTITIES if "{" + n + "}" in VIEWS[name]})

    @property
    def parts(self) -> int:
        """Tasks that texts are dealt to: one per core at least, and one for each ``TEXT_BYTES`` of documents."""
        self.base("documents")
        return max(self.spark.sparkContext.defaultParallelism, -(-self._bytes["documents"] // TEXT_BYTES))

    @property
    def cut(self) -> Column:
        return F.lit(CUT)
