"""Listings with derived status, detail trees and exports of the hierarchy."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rastro import schema as S
from rastro.functions.basic import blank, filled, first_filled, nonblank
from rastro.functions.dates import parse_date
from rastro.functions.status import client_status, effective_status, effective_status_at, export_status, listing_status_filter
from rastro.operators import filters as P
from rastro.operators import hierarchy as H
from rastro.schema import Tables


def _overdue_from_children(base: Column, any_overdue: Column) -> Column:
    return F.when((base == S.EN_PROCESO) & F.coalesce(any_overdue, F.lit(False)), S.VENCIDO).otherwise(base)


def proposal_status(t: Tables, cut: Column) -> DataFrame:
    """Plan count and derived status per proposal (plans are rolled up before the join)."""
    per_proposal = t.action_plans.groupBy(F.col("proposal_id").alias("id")).agg(
        F.count(F.lit(1)).alias("action_plans_count"), F.min(parse_date("target_date")).alias("min_plan_dt"),
        F.bool_or(effective_status("status", "target_date", cut) == S.VENCIDO).alias("any_overdue"))
    dt = F.when(nonblank("target_date"), parse_date("target_date")).otherwise(F.col("min_plan_dt"))
    base = effective_status_at("status", dt, cut)
    return t.proposals.join(per_proposal, "id", "left").select(
        *t.proposals.columns, F.coalesce("action_plans_count", F.lit(0)).alias("action_plans_count"),
        _overdue_from_children(base, F.col("any_overdue")).alias("effective_status"))


def finding_status(t: Tables, cut: Column) -> DataFrame:
    per_finding = proposal_status(t, cut).groupBy(F.col("finding_id").alias("id")).agg(
        F.count(F.lit(1)).alias("proposals_count"), F.sum("action_plans_count").alias("action_plans_count"),
        F.bool_or(F.col("effective_status") == S.VENCIDO).alias("any_overdue"))
    base = effective_status_at("status", F.lit(None).cast("date"), cut)
    return t.findings.join(per_finding, "id", "left").select(
        *t.findings.columns, F.coalesce("proposals_count", F.lit(0)).alias("proposals_count"),
        F.coalesce("action_plans_count", F.lit(0)).alias("action_plans_count"),
        _overdue_from_children(base, F.col("any_overdue")).alias("effective_status"))


def _reports(t: Tables) -> DataFrame:
    return t.reports.select(F.col("id").alias("report_id"), F.col("code").alias("report_code"),
                            F.col("title").alias("report_title"), "source_filename")


def _parents(t: Tables) -> DataFrame:
    return t.findings.select(F.col("id").alias("finding_id"), "report_id", F.col("code").alias("finding_code"),
                             F.col("title").alias("finding_title"), F.col("severity").alias("finding_severity")
                             ).join(_reports(t), "report_id")


def findings(t: Tables, cut: Column, severity=None, area=None, search=None, status=None) -> DataFrame:
    return (finding_status(t, cut).filter(P.finding_filter(severity, area, search)).join(_reports(t), "report_id")
            .filter(listing_status_filter(status)).orderBy("code", "id"))


def proposals(t: Tables, cut: Column, search=None, status=None) -> DataFrame:
    return (proposal_status(t, cut).join(_parents(t), "finding_id").filter(P.proposal_filter(search))
            .filter(listing_status_filter(status)).orderBy("code", "id"))


def plans(t: Tables, cut: Column, search=None, status=None) -> DataFrame:
    parents = (t.proposals.select(F.col("id").alias("proposal_id"), F.col("code").alias("proposal_code"),
                                  F.col("title").alias("proposal_title"), "proposal_text", "finding_id")
               .join(_parents(t), "finding_id"))
    return (t.action_plans.withColumn("effective_status", effective_status("status", "target_date", cut))
            .join(parents, "proposal_id").filter(P.plan_filter(search))
            .filter(listing_status_filter(status)).orderBy("code", "id"))


def findings_nested(t: Tables) -> DataFrame:
    """Findings of existing reports with their proposals, a row each, and the plans inside."""
    return H.trees(t, "finding")


# --- Details ---------------------------------------------------------------------------------------

def report_detail(t: Tables, key: str) -> tuple[DataFrame, DataFrame]:
    """The report's tree and its own history, newest first."""
    one = t.with_(reports=H.by_id_or_code(t.reports, key))
    hist = (t.audit_history.filter(F.col("entity_type") == "report")
            .join(one.reports.select(F.col("id").alias("entity_id")), "entity_id", "left_semi")
            .orderBy(F.desc("change_date"), F.desc("id")))
    return H.trees(H.below(one), "report"), hist


def finding_history(t: Tables, finding_ids: DataFrame) -> DataFrame:
    """History of findings (column ``id``) together with that of their proposals and plans."""
    f = finding_ids.select("id").distinct()
    p = t.proposals.join(f.select(F.col("id").alias("finding_id")), "finding_id").select("id", "finding_id")
    pa = t.action_plans.join(p.select(F.col("id").alias("proposal_id"), "finding_id"), "proposal_id").select("id", "finding_id")
    subjects = (f.select(F.lit("finding").alias("entity_type"), F.col("id").alias("entity_id"), F.col("id").alias("finding_id"))
                .unionByName(p.select(F.lit("proposal").alias("entity_type"), F.col("id").alias("entity_id"), "finding_id"))
                .unionByName(pa.select(F.lit("action_plan").alias("entity_type"), F.col("id").alias("entity_id"), "finding_id")))
    return t.audit_history.join(subjects, ["entity_type", "entity_id"]).orderBy(F.desc("change_date"), F.desc("id"))


def finding_evidence(t: Tables, finding_ids: DataFrame) -> DataFrame:
    p = t.proposals.join(finding_ids.select(F.col("id").alias("finding_id")), "finding_id", "left_semi")
    return (t.action_plans.filter(nonblank("evidence_file"))
            .join(p.select(F.col("id").alias("proposal_id"), "finding_id"), "proposal_id")
            .select("finding_id", F.col("code").alias("plan_code"), F.col("evidence_file").alias("filename"),
                    F.col("last_updated").alias("date")))


def finding_detail(t: Tables, key: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Tree, evidence files and merged history of one finding."""
    one = t.with_(findings=H.by_id_or_code(t.findings, key))
    ids = one.findings.select("id")
    return H.trees(one, "finding"), finding_evidence(t, ids), finding_history(t, ids)


# --- Screen table ----------------------------------------------------------------------------------

def main_table(t: Tables, cut: Column, status=None, **scope) -> DataFrame:
    """Findings kept by the screen filter, one row per proposal, with the on-screen status."""
    listed = (findings(t, cut).withColumn("finalised", client_status("status", F.lit(None).cast("string"), cut) == S.FINALIZADO)
              .filter(P.main_table_filter(**scope)))
    kept = listed.select(F.col("id").alias("f_id"))
    rows = H.flatten_first_plan(t).join(kept, "f_id", "left_semi")
    shown = client_status(first_filled("p_status", "f_status"), first_filled("p_target_date", F.lit("")), cut)
    out = rows.select(
        F.col("f_id").alias("finding_id"), F.col("f_code").alias("finding_code"), F.col("p_id").alias("proposal_id"),
        F.coalesce("p_code", F.lit("Sin propuesta")).alias("proposal_code"),
        first_filled("p_proposal_text", "p_title", F.lit("")).alias("proposal_text"),
        F.coalesce(filled("p_action_owner"), F.when(F.col("pa_id").isNotNull(), F.col("pa_action_owner"))
                   .otherwise(first_filled("f_action_owner", F.lit("Sin asignar")))).alias("owner"),
        F.coalesce(filled("p_target_date"), F.col("pa_target_date"), F.lit("")).alias("target_date"),
        F.coalesce("pa_progress_pct", F.lit(0)).alias("progress_pct"), shown.alias("status"))
    return out.filter(P.status_matches("status", status))


# --- Exports ---------------------------------------------------------------------------------------

def export_findings(t: Tables, cut: Column) -> DataFrame:
    owner = first_filled("p_action_owner", "pa_action_owner", F.coalesce("f_action_owner", F.lit("")))
    target = first_filled("p_target_date", "pa_target_date", F.lit(""))
    status = first_filled("p_status", F.coalesce("f_status", F.lit("")))
    return H.flatten_first_plan(t).select(
        first_filled("f_responsible_area", F.lit("Pendiente de definir")).alias("area"), F.col("f_code").alias("finding_code"),
        first_filled("f_situation", "f_title").alias("situation"),
        F.coalesce("p_code", F.lit("Sin propuesta")).alias("proposal_code"),
        first_filled("p_proposal_text", "p_title", F.lit("")).alias("proposal_text"), F.col("f_severity").alias("severity"),
        owner.alias("owner"), target.alias("target_date"),
        export_status(first_filled(status, F.lit(S.EN_PROCESO)), target, cut).alias("status"),
        F.concat(F.coalesce("pa_progress_pct", F.lit(0)).cast("string"), F.lit("%")).alias("progress"),
        first_filled("pa_action_text", "pa_title", F.lit("")).alias("action"), F.col("f_observations").alias("observations"))


def export_proposals(t: Tables, cut: Column) -> DataFrame:
    status = export_status("status", "target_date", cut)
    return proposals(t, cut).withColumn("status", status).select(
        F.col("code").alias("proposal_code"), first_filled("proposal_text", "title").alias("proposal_text"), "finding_code",
        F.col("responsible_area").alias("area"), "status", F.col("action_owner").alias("owner"),
        F.concat(F.col("action_plans_count").cast("string"), F.lit(" plan(es)")).alias("plans"), "target_date",
        F.when(F.col("status") == S.FINALIZADO, "🗃️ Plan 2026").otherwise("Archivar").alias("repository"), "report_title")


def export_plans(t: Tables, cut: Column) -> DataFrame:
    return plans(t, cut).select(
        first_filled("code", F.concat(F.lit("PA-"), "id")).alias("plan_code"), first_filled("action_text", "title").alias("action_text"),
        "proposal_code", "finding_code", "report_title", F.col("action_owner").alias("owner"), "target_date",
        F.concat(F.coalesce("progress_pct", F.lit(0)).cast("string"), F.lit("%")).alias("progress"), "status",
        F.col("notes").alias("evidence"), F.lit("").alias("actions"))
