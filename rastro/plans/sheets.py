"""Sheet rows to findings, proposals and plans, with relation checks and rejects."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rastro import schema as S
from rastro.functions.basic import blank, filled, first_filled, nonblank
from rastro.functions.numbers import parse_pct
from rastro.functions.status import (legacy_sheet_risk, legacy_sheet_status, normalize_severity, plan_sheet_row_status,
                                     sheet_row_status)
from rastro.functions.text import padded_code
from rastro.operators.blocks import DEFAULT_SPAN, first_by, running
from rastro.session import settle

FINDING_SHEET = {c: "string" for c in ("area", "h_code", "situation", "p_code", "prop_text", "risk", "owner", "target_date",
                                       "status", "pct", "actions", "obs")}
PLAN_SHEET = {c: "string" for c in ("pa_code", "action_text", "p_code", "h_code", "owner", "target_date", "pct", "status", "obs")}


@dataclass(frozen=True)
class Parsed:
    """Rows keyed by ``file`` and codes; ``rejects`` has (file, sheet, row_no, entity, code, reason)."""

    reports: DataFrame
    findings: DataFrame
    proposals: DataFrame
    plans: DataFrame
    rejects: DataFrame


class RelationErrors(ValueError):
    """The sheets hold rows whose relations cannot be resolved, and the load was asked to be strict."""


def _or(c, default) -> Column:
    return first_filled(c, F.lit(default))


def staged_rows(rows: DataFrame, span: int = DEFAULT_SPAN) -> DataFrame:
    """Finding-sheet rows with inherited code, area and situation, generated codes and clean values.

    A row without code, situation and area continues the row above it. The look-back is carried in
    blocks of ``span`` row numbers, so a file of any length is spread over tasks.
    """
    rows = S.conform(rows, FINDING_SHEET).filter(
        nonblank("h_code") | nonblank("situation") | nonblank("prop_text") | nonblank("actions"))
    starts = nonblank("h_code") | nonblank("situation") | nonblank("area")
    made_up = padded_code("H-IMP-", "row_no")
    rows = running(rows, ["file"], "row_no", {
        "__code": ("last", F.when(starts, first_filled("h_code", made_up))),
        "__generated": ("last", F.when(starts, blank("h_code"))),
        "__area": ("last", filled("area")), "__situation": ("last", filled("situation")), "__first": ("min", F.col("row_no")),
    }, span)
    # Rows above the first one that says anything hang on the first row of the file.
    code = F.coalesce("__code", padded_code("H-IMP-", "__first"))
    leads = starts | (F.col("row_no") == F.col("__first"))
    pct = parse_pct("pct", "pct_is_numeric" if "pct_is_numeric" in rows.columns else None)
    return rows.select(
        "file", "row_no", code.alias("h_code"), F.coalesce("__generated", F.lit(True)).alias("h_generated"),
        F.when(leads, F.coalesce("area", F.lit(""))).otherwise(F.coalesce("__area", F.lit("Operaciones"))).alias("area"),
        F.when(leads, F.coalesce("situation", F.lit(""))).otherwise(F.coalesce("__situation", F.lit(""))).alias("situation"),
        F.coalesce(filled("p_code"), F.when(nonblank("prop_text"), padded_code("PM-IMP-", "row_no")), F.lit("")).alias("p_code"),
        (blank("p_code") & nonblank("prop_text")).alias("p_generated"),
        F.coalesce("prop_text", F.lit("")).alias("prop_text"), normalize_severity(F.coalesce("risk", F.lit("Medio"))).alias("severity"),
        F.coalesce("owner", F.lit("")).alias("owner"), F.coalesce("target_date", F.lit("")).alias("target_date"),
        sheet_row_status(F.coalesce("status", F.lit(S.EN_PROCESO)), pct).alias("status"), pct.alias("progress_pct"),
        F.coalesce("actions", F.lit("")).alias("actions"), F.coalesce("obs", F.lit("")).alias("obs"))


def sheet_findings(staged: DataFrame) -> DataFrame:
    """The first row of every finding code speaks for the finding."""
    values = staged.select(
        "file", F.col("h_code").alias("code"), "row_no", F.col("h_generated").alias("code_generated"),
        F.when(F.col("situation") != "", F.substring("situation", 1, 100)).otherwise(F.concat(F.lit("Hallazgo "), "h_code")).alias("title"),
        _or("situation", "Sin detalle").alias("situation"), "severity", _or("area", "Operaciones").alias("responsible_area"),
        _or("owner", "Auditoría").alias("action_owner"), "status", F.col("obs").alias("observations"))
    return first_by(values, ["file", "code"], "row_no", F.struct("row_no", *[c for c in values.columns if c not in ("file", "code", "row_no")]))


def sheet_proposals(staged: DataFrame) -> DataFrame:
    values = staged.filter(F.col("p_code") != "").select(
        "file", "h_code", F.col("p_code").alias("code"), "row_no", F.col("p_generated").alias("code_generated"),
        F.when(F.col("prop_text") != "", F.substring("prop_text", 1, 100)).otherwise(F.concat(F.lit("Propuesta "), "p_code")).alias("title"),
        _or("prop_text", "Sin detalle de propuesta").alias("proposal_text"), "severity", _or("area", "Operaciones").alias("responsible_area"),
        _or("owner", "Auditoría").alias("action_owner"), "target_date", "status")
    keys = ["file", "h_code", "code"]
    # The number stands beside the row, so that who asks for codes and numbers alone has no texts dealt.
    rest = F.struct(*[c for c in values.columns if c not in (*keys, "row_no")])
    return (values.groupBy(*keys).agg(F.min("row_no").alias("row_no"), F.min_by(rest, "row_no").alias("__row"))
            .select(*keys, "row_no", "__row.*"))


def inline_plans(staged: DataFrame, plan_files: DataFrame | None) -> DataFrame:
    """Plans written on the finding sheet; only for files that have no plan sheet."""
    rows = staged if plan_files is None else staged.join(plan_files.select("file").distinct(), "file", "left_anti")
    rows = rows.filter((F.col("p_code") != "") & ((F.col("actions") != "") | (F.col("progress_pct") > 0)))
    return rows.select(
        "file", "h_code", "p_code", padded_code("PA-IMP-", "row_no").alias("code"), "row_no", F.lit(True).alias("code_generated"),
        first_filled("actions", F.substring("prop_text", 1, 100), F.lit("Plan de Acción")).alias("title"),
        first_filled("actions", "prop_text", F.lit("Plan de Acción")).alias("action_text"), _or("owner", "Auditoría").alias("action_owner"),
        "target_date", F.when(F.col("progress_pct") == 100, S.PENDIENTE).otherwise(F.col("status")).alias("status"), "progress_pct",
        F.col("obs").alias("notes"))


def _reject(df: DataFrame, sheet: str, entity: str, code, reason) -> DataFrame:
    return df.select("file", F.lit(sheet).alias("sheet"), "row_no", F.lit(entity).alias("entity"), code.alias("code"), reason.alias("reason"))


def _last_given(c: str) -> Column:
    return F.max_by(c, F.when(nonblank(c), F.col("row_no"))).alias(f"new_{c}")


def apply_proposal_sheet(findings: DataFrame, proposals: DataFrame, rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Proposal-sheet rows update known proposals or attach new ones to a known finding.

    Of several updates the last value given per field counts. The first row of an unknown code that
    names a known finding attaches it; rows before it are rejected, rows after it are updates.
    """
    judged = _judged_proposal_rows(findings, proposals, rows)
    new = judged.filter("owner_h is null")
    rejects = _reject(new.filter("anchor is null or row_no < anchor"), "proposals", "proposal",
                      F.when(F.col("made_up"), F.substring("prop_text", 1, 30)).otherwise(F.col("code")),
                      F.when(nonblank("h_code"), "finding_not_in_file").otherwise("finding_not_given"))
    attached = new.filter("row_no = anchor").select(
        "file", "h_code", "code", "row_no", F.col("made_up").alias("code_generated"),
        F.when(nonblank("prop_text"), F.substring("prop_text", 1, 100)).otherwise(F.concat(F.lit("Propuesta "), "code")).alias("title"),
        _or("prop_text", "Sin detalle").alias("proposal_text"), F.col("f_severity").alias("severity"), first_filled("area", "f_area").alias("responsible_area"),
        first_filled("owner", "f_owner").alias("action_owner"), F.coalesce("target_date", F.lit("")).alias("target_date"),
        F.coalesce("status", F.lit(S.EN_PROCESO)).alias("status"), F.lit(2).alias("source_sheet"))
    given = ["prop_text", "owner", "target_date"]
    telling = reduce(lambda a, b: a | b, [nonblank(c) for c in given])
    later = (new.filter(F.expr("row_no > anchor") & telling).select("file", "code", "row_no", *given)
             .join(attached.select("file", "code", F.col("h_code").alias("target_h")), ["file", "code"]))
    update_rows = (judged.filter(F.col("owner_h").isNotNull() & telling).select("file", F.col("owner_h").alias("target_h"), "code", "row_no", *given)
                   .unionByName(later))
    keys = ["file", "h_code", "code"]
    updates = update_rows.groupBy("file", F.col("target_h").alias("h_code"), "code").agg(*[_last_given(c) for c in given])
    values = {"proposal_text": F.coalesce("new_prop_text", "proposal_text"), "action_owner": F.coalesce("new_owner", "action_owner"),
              "target_date": F.coalesce("new_target_date", "target_date")}
    # Each side meets the updates on its own: the known proposals lie by these keys already, as one table with the others they would be dealt again.
    known, added = [side.join(updates, keys, "left").withColumns(values).select(*attached.columns) for side in (proposals.withColumn("source_sheet", F.lit(1)), attached)]
    return known.unionByName(added), rejects


def _judged_proposal_rows(findings: DataFrame, proposals: DataFrame, rows: DataFrame) -> DataFrame:
    """Proposal-sheet rows with the values of the finding they name, the finding that has their code (``owner_h``) and the row that attaches it (``anchor``).

    Rows are dealt once by the finding they name and once by their code, and written after each.
    """
    rows = S.conform(rows, FINDING_SHEET).filter(nonblank("p_code") | nonblank("prop_text"))
    parent = findings.select("file", F.col("code").alias("h_code"), F.col("severity").alias("f_severity"),
                             F.col("responsible_area").alias("f_area"), F.col("action_owner").alias("f_owner"))
    coded = rows.join(parent, ["file", "h_code"], "left").select(
        "file", "row_no", F.coalesce(filled("p_code"), padded_code("PM-IMP-S2-", "row_no")).alias("code"), blank("p_code").alias("made_up"), "h_code",
        "prop_text", "area", "owner", "target_date", "status", "f_severity", "f_area", "f_owner")
    coded = settle(coded, "proposal-rows")
    # A code used under several findings stands for the one that came last; a made-up code is nobody's, even where it reads like a known one.
    known = proposals.groupBy("file", "code").agg(F.max_by("h_code", "row_no").alias("__owner"))
    anchors = coded.filter("f_severity is not null").groupBy("file", "code").agg(
        F.min(F.when(F.col("made_up"), F.col("row_no"))).alias("__made"), F.min(F.when(~F.col("made_up"), F.col("row_no"))).alias("__given"))
    judged = coded.join(known, ["file", "code"], "left").join(anchors, ["file", "code"], "left").select(
        *coded.columns, F.when(~F.col("made_up"), F.col("__owner")).alias("owner_h"),
        F.when(F.col("__owner").isNull(), F.least("__made", "__given")).otherwise(F.col("__made")).alias("anchor"))
    return settle(judged, "proposal-rows")


def apply_plan_sheet(findings: DataFrame, proposals: DataFrame, rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Plan-sheet rows find their proposal by its code, or by a finding that has exactly one."""
    rows = S.conform(rows, PLAN_SHEET).filter(nonblank("action_text") | nonblank("pa_code"))
    real = F.coalesce(F.col("pa_code").startswith("PA-"), F.lit(False))
    rows = rows.withColumn("code", F.when(real, F.col("pa_code")).otherwise(padded_code("PA-IMP-", "row_no"))).withColumn("made_up", ~real)
    order = F.struct("source_sheet", "row_no") if "source_sheet" in proposals.columns else F.col("row_no")
    by_code = proposals.groupBy("file", F.col("code").alias("p_code")).agg(F.max_by(F.struct("h_code", "action_owner"), order).alias("by_code"))
    by_finding = proposals.groupBy("file", "h_code").agg(
        F.count(F.lit(1)).alias("n"), F.any_value(F.struct(F.col("code").alias("p_code"), "action_owner")).alias("only"))
    known = findings.select("file", F.col("code").alias("h_code"), F.lit(True).alias("known"))
    has_p, has_h = nonblank("p_code"), nonblank("h_code")
    # A row asks for its proposal's code, or without one for its finding: one look-up of both kinds, so that the rows are dealt once.
    of_proposals = by_code.select("file", F.lit("proposal").alias("__by"), F.col("p_code").alias("__given"), "by_code")
    of_findings = (known.join(by_finding, ["file", "h_code"], "full_outer")
                   .select("file", F.lit("finding").alias("__by"), F.col("h_code").alias("__given"), "known", "n", "only"))
    asked = rows.withColumns({"__by": F.when(has_p, "proposal").otherwise("finding"), "__given": F.when(has_p, F.col("p_code")).otherwise(F.col("h_code"))})
    judged = (asked.join(of_proposals.unionByName(of_findings, allowMissingColumns=True), ["file", "__by", "__given"], "left")
              .withColumn("reason",
                          F.when(has_p & F.col("by_code").isNull(), "proposal_not_in_file")
                          .when(has_p & has_h & (F.col("by_code.h_code") != F.col("h_code")), "proposal_of_other_finding")
                          .when(~has_p & ~has_h, "no_parent_given").when(~has_p & F.col("known").isNull(), "finding_not_in_file")
                          .when(~has_p & F.col("n").isNull(), "finding_without_proposal").when(~has_p & (F.col("n") > 1), "finding_with_several_proposals")))
    rejects = _reject(judged.filter("reason is not null"), "plans", "action_plan", F.col("code"), F.col("reason"))
    pct = parse_pct("pct", "pct_is_numeric" if "pct_is_numeric" in rows.columns else None)
    named = F.concat(F.lit("Plan "), "code")
    good = judged.filter("reason is null").select(
        "file", F.when(has_p, F.col("by_code.h_code")).otherwise(F.col("h_code")).alias("h_code"),
        F.when(has_p, F.col("p_code")).otherwise(F.col("only.p_code")).alias("p_code"), "code", "row_no", F.col("made_up").alias("code_generated"),
        first_filled("action_text", named).alias("title"), first_filled("action_text", named).alias("action_text"),
        first_filled("owner", F.when(has_p, F.col("by_code.action_owner")).otherwise(F.col("only.action_owner"))).alias("action_owner"),
        F.coalesce("target_date", F.lit("")).alias("target_date"), plan_sheet_row_status(F.coalesce("status", F.lit("")), pct).alias("status"),
        pct.alias("progress_pct"), F.coalesce("obs", F.lit("")).alias("notes"))
    keys = ["file", "h_code", "p_code", "code"]
    return first_by(good, keys, "row_no", F.struct("row_no", *[c for c in good.columns if c not in (*keys, "row_no")])).select(*good.columns), rejects


def report_headers(findings: DataFrame) -> DataFrame:
    """Per file: the area of its first finding and the number of findings."""
    n = F.count(F.lit(1))
    return findings.groupBy("file").agg(
        F.min_by("responsible_area", "row_no").alias("area"), n.alias("findings"),
        F.concat(F.lit("Importación relacional desde planilla ("), n.cast("string"), F.lit(" hallazgos).")).alias("summary")
    ).select("file", F.concat(F.lit("Importación Excel - "), F.regexp_replace("file", r"\.[^.]*$", "")).alias("title"),
             F.lit("Importación Tabular Excel/CSV").alias("process"), "area", F.lit("2026").alias("period"),
             F.lit(S.DEFAULT_AUDITOR).alias("auditor"), "summary", "findings", F.col("file").alias("source_filename"))


def parse_sheets(finding_rows: DataFrame, proposal_rows: DataFrame | None = None, plan_rows: DataFrame | None = None,
                 on_error: str = "quarantine", span: int = DEFAULT_SPAN) -> Parsed:
    """All sheets of all files. ``on_error='fail'`` raises when any row is rejected."""
    staged = settle(staged_rows(finding_rows, span), "sheet-rows")
    findings, proposals = settle(sheet_findings(staged), "sheet-findings"), sheet_proposals(staged)
    plans = inline_plans(staged, plan_rows)
    rejects = _reject(staged.limit(0), "findings", "finding", F.lit(""), F.lit(""))
    proposals = proposals.withColumn("source_sheet", F.lit(1))
    if proposal_rows is not None:
        proposals, bad = apply_proposal_sheet(findings, proposals.drop("source_sheet"), proposal_rows)
        rejects = rejects.unionByName(bad)
        proposals = settle(proposals, "sheet-proposals")
    if plan_rows is not None:
        from_sheet, bad = apply_plan_sheet(findings, proposals, plan_rows)
        plans, rejects = plans.unionByName(from_sheet.select(*plans.columns)), rejects.unionByName(bad)
    if on_error == "fail" and not rejects.isEmpty():
        raise RelationErrors("Some sheet rows have relations that cannot be resolved.")
    return Parsed(report_headers(findings), findings, proposals, plans, rejects)


def legacy_rows(rows: DataFrame) -> DataFrame:
    """Older reader of the finding sheet: no inheritance, no pending state, risk by containment."""
    rows = S.conform(rows, FINDING_SHEET).filter(nonblank("h_code") | nonblank("situation") | nonblank("prop_text"))
    return rows.select(
        "file", "row_no", first_filled("h_code", padded_code("H-IMP-", "row_no")).alias("h_code"),
        first_filled("p_code", padded_code("PM-IMP-", "row_no")).alias("p_code"), _or("situation", "Sin detalle").alias("situation"),
        _or("prop_text", "Sin detalle de propuesta").alias("proposal_text"), legacy_sheet_risk(F.coalesce("risk", F.lit("Medio"))).alias("severity"),
        legacy_sheet_status(F.coalesce("status", F.lit(S.EN_PROCESO))).alias("status"), _or("area", "Operaciones").alias("responsible_area"),
        _or("owner", "Auditoría").alias("action_owner"), parse_pct("pct").alias("progress_pct"))
