"""Table schemas, value domains and the bundle of entity tables the library works on."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# --- Table columns: name -> Spark type. Dates written by people stay text; parse with functions.dates.
REPORTS = {
    "id": "string", "code": "string", "title": "string", "process": "string", "area": "string",
    "period": "string", "auditor": "string", "summary": "string", "source_filename": "string",
    "created_at": "timestamp",
}
FINDINGS = {
    "id": "string", "report_id": "string", "code": "string", "title": "string", "situation": "string",
    "risk": "string", "severity": "string", "responsible_area": "string", "action_owner": "string",
    "status": "string", "observations": "string", "created_at": "timestamp", "last_updated": "timestamp",
    "import_baseline": "map<string,string>",
}
PROPOSALS = {
    "id": "string", "finding_id": "string", "code": "string", "title": "string",
    "proposal_text": "string", "severity": "string", "responsible_area": "string",
    "action_owner": "string", "target_date": "string", "status": "string", "validated_at": "string",
    "validated_by": "string", "created_at": "timestamp", "last_updated": "timestamp",
    "import_baseline": "map<string,string>",
}
ACTION_PLANS = {
    "id": "string", "proposal_id": "string", "code": "string", "title": "string",
    "action_text": "string", "action_owner": "string", "target_date": "string", "status": "string",
    "progress_pct": "int", "notes": "string", "evidence_file": "string", "closed_date": "string",
    "validated_at": "string", "validated_by": "string", "created_at": "timestamp",
    "last_updated": "timestamp", "import_baseline": "map<string,string>",
}
AUDIT_HISTORY = {
    "id": "string", "entity_type": "string", "entity_id": "string", "change_date": "timestamp",
    "user_name": "string", "description": "string",
}
IMPORT_BATCHES = {
    "id": "string", "report_id": "string", "content_fingerprint": "string", "file_hash": "string",
    "source_filename": "string", "mode": "string", "summary": "string", "created_at": "timestamp",
}
CODE_SEQUENCES = {"entity_type": "string", "year": "int", "last_value": "bigint"}

SCHEMAS = {
    "reports": REPORTS, "findings": FINDINGS, "proposals": PROPOSALS, "action_plans": ACTION_PLANS,
    "audit_history": AUDIT_HISTORY, "import_batches": IMPORT_BATCHES, "code_sequences": CODE_SEQUENCES,
}

# --- Fixed values: canonical words.
EN_PROCESO = "En proceso"
EN_SUSPENSION = "En suspensión"
PENDIENTE = "Pendiente de validación"
FINALIZADO = "Finalizado"
VENCIDO = "Vencido"
STATUSES = [EN_PROCESO, EN_SUSPENSION, PENDIENTE, FINALIZADO]
SEVERITIES = ["Alto", "Medio", "Bajo"]
DEFAULT_AUDITOR = "Auditoría Interna"

# --- Fixed values: status and severity sets in lower case. They differ per query on purpose.
CLOSED3 = ["finalizado", "completado", "cerrado"]
CLOSED2 = ["finalizado", "completado"]
CLOSED4A = ["finalizado", "completado", "cerrado", "archivado"]
CLOSED4B = ["finalizado", "completado", "cerrado", "archivada"]
PROP_CLOSED = ["finalizado", "completada", "cerrada", "implementada"]
SUSP3 = ["en suspensión", "en suspension", "stand-by"]
OVERDUE_EXCL = CLOSED4A + SUSP3
AREA_OVERDUE_EXCL = CLOSED3 + SUSP3
PENDING_EXCL = ["finalizado", "validado", "cerrado"]
VALIDATED4 = ["finalizado", "completado", "cerrado", "validado"]
INCOMPLETE4 = ["en proceso", "en suspensión", "en suspension", "stand-by"]
HIGH5 = ["alto", "alta", "high", "crítico", "critico"]
HIGH7 = ["alto", "alta", "high", "crítico", "critico", "crítica", "critica"]
MED3 = ["medio", "media", "medium"]
LOW3 = ["bajo", "baja", "low"]
SEVERITY_HIGH_WORDS = ["alto", "alta", "high", "crítico", "critico", "crítica", "critica", "elevado", "elevada"]
SEVERITY_LOW_WORDS = ["bajo", "baja", "low", "leve", "menor"]
FINISHED_VARIANTS = ["finalizado", "finalizada", "completado", "completada", "cerrado", "cerrada",
                     "implementado", "implementada", "archivada"]
SUSPENDED_VARIANTS = ["en suspensión", "en suspension", "stand-by", "suspendida", "suspendido"]
PENDING_VARIANTS = ["pendiente de validación", "pendiente de validacion", "pendiente validacion",
                    "pendiente validación"]
OVERDUE_VARIANTS = ["vencido", "vencida", "overdue"]

# --- Fixed values: import codes and fields.
CODE_PREFIX = {"report": "AUD", "finding": "H", "proposal": "PM", "action_plan": "PA"}
STRONG_CODE = r"^(AUD|H|PM|PA)-\d{4}-\d{3,}$"
GENERATED_CODE = r"(?i)^(H|PM|PA)-IMP(-S\d+)?-\d+$"
FINDING_FIELDS = ["title", "situation", "severity", "responsible_area", "action_owner", "status", "observations"]
PROPOSAL_FIELDS = ["title", "proposal_text", "responsible_area", "action_owner", "target_date", "status"]
PLAN_FIELDS = ["title", "action_text", "action_owner", "target_date", "status", "progress_pct", "notes"]


# --- Fixed values: names of fields and messages of imports in the history.
FIELD_LABELS = {
    "title": "título", "situation": "situación", "severity": "riesgo", "responsible_area": "área", "action_owner": "responsable", "status": "estado",
    "observations": "observaciones", "proposal_text": "texto", "target_date": "fecha compromiso", "action_text": "acción", "progress_pct": "avance", "notes": "notas/evidencia",
}
FIRST_LOAD = "Carga inicial de informe {title} ({source_filename})"
NEW_FINDING = "Creación de hallazgo {code}: {title}"
NEW_PROPOSAL = "Creación de propuesta {code} vinculada a {parent_code}"
NEW_PLAN = "Creación de plan de acción {code} vinculado a propuesta {parent_code}"
UPDATED_ROW = "Reimportación ({mode}): actualizó {fields}"
UPDATED_REPORT = "Reimportación ({mode}) desde {source_filename}: {created} hallazgos nuevos, {updated} actualizados, {preserved} ediciones manuales conservadas"


def conform(df: DataFrame, schema: dict[str, str]) -> DataFrame:
    """Add the schema columns that ``df`` lacks as typed NULLs; columns already there are kept."""
    missing = {c: F.lit(None).cast(t) for c, t in schema.items() if c not in df.columns}
    return df.withColumns(missing) if missing else df


@dataclass(frozen=True)
class Tables:
    """The four entity tables plus the optional append-only ones."""

    reports: DataFrame
    findings: DataFrame
    proposals: DataFrame
    action_plans: DataFrame
    audit_history: DataFrame | None = None
    import_batches: DataFrame | None = None
    code_sequences: DataFrame | None = None

    @staticmethod
    def of(**frames: DataFrame) -> "Tables":
        return Tables(**{n: conform(df, SCHEMAS[n]) for n, df in frames.items() if df is not None})

    def present(self) -> dict[str, DataFrame]:
        return {n: getattr(self, n) for n in SCHEMAS if getattr(self, n) is not None}

    def with_(self, **frames: DataFrame) -> "Tables":
        return replace(self, **frames)
