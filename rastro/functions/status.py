"""Status and severity normalisers, and the three derived-status rules."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from rastro import schema as S
from rastro.functions.basic import col, contains_any, first_filled, low, strip
from rastro.functions.dates import parse_date

# Words looked for inside a status text by the export and the sheet readers.
EXPORT_FINISHED = ["finalizado", "finalizada", "completada", "completado", "implementada", "archivada"]
EXPORT_SUSPENDED = ["suspensión", "suspension", "stand-by"]
SHEET_FINISHED = ["finalizado", "finalizada", "completada", "completado", "cerrado"]
PLAN_SHEET_FINISHED = ["finalizado", "completado", "cerrado"]


def normalize_status(c) -> Column:
    s = F.lower(strip(c))
    pending = s.isin(S.PENDING_VARIANTS) | s.contains("validación") | s.contains("validacion")
    # A status as it is stored stands for itself; lower case of accented letters is dear, and every rule below asks for it.
    return (
        F.when(col(c).isin(S.STATUSES), col(c))
        .when(pending, S.PENDIENTE)
        .when(s.isin(S.FINISHED_VARIANTS), S.FINALIZADO)
        .when(s.isin(S.SUSPENDED_VARIANTS), S.EN_SUSPENSION)
        .otherwise(S.EN_PROCESO)
    )


def is_final_status(c) -> Column:
    return normalize_status(c) == S.FINALIZADO


def normalize_severity(c) -> Column:
    s = F.lower(strip(c))
    return (
        F.when(s.isin(S.SEVERITY_HIGH_WORDS), "Alto")
        .when(s.isin(S.SEVERITY_LOW_WORDS), "Bajo")
        .otherwise("Medio")
    )


def _overdue_when_open(base: Column, dt: Column, cut: Column) -> Column:
    return F.when((base == S.EN_PROCESO) & (dt < cut), S.VENCIDO).otherwise(base)


def effective_status(status, target_date, cut: Column) -> Column:
    """Listing rule. ``target_date`` is a text column; an open item past its date is overdue."""
    return effective_status_at(status, parse_date(target_date), cut)


def effective_status_at(status, target_dt: Column, cut: Column) -> Column:
    return _overdue_when_open(normalize_status(status), target_dt, cut)


def export_status(status, target_date, cut: Column) -> Column:
    """Export rule: substring match, no pending state, "cerrado" is not final."""
    s = F.coalesce(col(status), F.lit(S.EN_PROCESO))
    base = (
        F.when(contains_any(s, EXPORT_FINISHED), S.FINALIZADO)
        .when(contains_any(s, EXPORT_SUSPENDED), S.EN_SUSPENSION)
        .otherwise(S.EN_PROCESO)
    )
    return _overdue_when_open(base, parse_date(target_date), cut)


def client_status(status, target_date, cut: Column) -> Column:
    """On-screen rule: exact families, both arguments already resolved child first, parent second."""
    s = F.lower(strip(first_filled(status, F.lit(S.EN_PROCESO))))
    pending = s.contains("pendiente de validación") | s.contains("pendiente de validacion") | (s == "pendiente validacion")
    base = (
        F.when(s.isin(S.FINISHED_VARIANTS), S.FINALIZADO)
        .when(s.isin(S.SUSP3), S.EN_SUSPENSION)
        .when(pending, S.PENDIENTE)
        .otherwise(S.EN_PROCESO)
    )
    return _overdue_when_open(base, parse_date(target_date), cut)


def status_family(c) -> Column:
    """Folds synonyms so that two statuses can be compared with ``=``."""
    s = F.lower(strip(c))
    return (
        F.when(s.isin(S.FINISHED_VARIANTS), "#finished")
        .when(s.isin(S.SUSP3), "#suspended")
        .when(s.isin(S.OVERDUE_VARIANTS), "#overdue")
        .otherwise(F.nullif(s, F.lit("")))
    )


def same_status(a, b) -> Column:
    return F.coalesce(status_family(a) == status_family(b), F.lit(False))


def _row_status(status, pct, suspended, finished) -> Column:
    return (
        F.when((col(pct) == 100) | low(status).contains("pendiente"), S.PENDIENTE)
        .when(contains_any(status, suspended), S.EN_SUSPENSION)
        .when(contains_any(status, finished), S.FINALIZADO)
        .otherwise(S.EN_PROCESO)
    )


def sheet_row_status(status, pct) -> Column:
    return _row_status(status, pct, EXPORT_SUSPENDED, SHEET_FINISHED)


def plan_sheet_row_status(status, pct) -> Column:
    return _row_status(status, pct, EXPORT_SUSPENDED[:2], PLAN_SHEET_FINISHED)


def legacy_sheet_status(status) -> Column:
    return (
        F.when(contains_any(status, EXPORT_SUSPENDED[:2]), S.EN_SUSPENSION)
        .when(contains_any(status, SHEET_FINISHED), S.FINALIZADO)
        .otherwise(S.EN_PROCESO)
    )


def legacy_sheet_risk(risk) -> Column:
    return F.when(low(risk).contains("alto"), "Alto").when(low(risk).contains("bajo"), "Bajo").otherwise("Medio")


# Status filter words of the listings, and what they select.
LISTING_STATUS_WORDS = {
    "vencido": S.VENCIDO, "en proceso": S.EN_PROCESO,
    "en suspensión": S.EN_SUSPENSION, "en suspension": S.EN_SUSPENSION, "stand-by": S.EN_SUSPENSION,
    "finalizado": S.FINALIZADO, "completado": S.FINALIZADO, "cerrado": S.FINALIZADO,
}


def listing_status_filter(word: str | None) -> Column:
    """Predicate on ``effective_status``; an unknown word filters nothing."""
    wanted = LISTING_STATUS_WORDS.get((word or "").strip().lower())
    return F.lit(True) if wanted is None else F.col("effective_status") == wanted
