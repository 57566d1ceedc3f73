"""Joins along report - finding - proposal - plan, flattenings, child roll-ups and nested trees."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rastro import schema as S
from rastro.functions.basic import filled, first_filled, nonblank
from rastro.functions.dates import days_overdue, parse_date
from rastro.operators.blocks import first_by
from rastro.schema import Tables

# Short prefixes used when columns of several levels meet in one row.
REPORT_COLS = ["id", "code", "title", "process", "area", "period", "auditor", "source_filename"]
FINDING_COLS = ["id", "report_id", "code", "title", "situation", "severity", "responsible_area",
                "action_owner", "status", "observations"]
PROPOSAL_COLS = ["id", "finding_id", "code", "title", "proposal_text", "severity", "responsible_area",
                 "action_owner", "target_date", "status", "validated_at", "validated_by"]
PLAN_COLS = ["id", "proposal_id", "code", "title", "action_text", "action_owner", "target_date", "status",
             "progress_pct", "notes", "evidence_file", "closed_date", "last_updated"]


def prefixed(df: DataFrame, prefix: str, cols: list[str]) -> DataFrame:
    return df.select(*[F.col(c).alias(f"{prefix}_{c}") for c in cols])


def report_rows(t: Tables) -> DataFrame:
    return prefixed(t.reports, "r", REPORT_COLS)


def finding_rows(t: Tables) -> DataFrame:
    return prefixed(t.findings, "f", FINDING_COLS)


def proposal_rows(t: Tables) -> DataFrame:
    return prefixed(t.proposals, "p", PROPOSAL_COLS)


def plan_rows(t: Tables) -> DataFrame:
    return prefixed(t.action_plans, "pa", PLAN_COLS)


def findings_with_report(t: Tables, reports: DataFrame | None = None) -> DataFrame:
    r = report_rows(t) if reports is None else reports
    return finding_rows(t).join(r, F.col("f_report_id") == F.col("r_id"))


def proposals_with_ancestors(t: Tables, reports: DataFrame | None = None) -> DataFrame:
    return proposal_rows(t).join(findings_with_report(t, reports), F.col("p_finding_id") == F.col("f_id"))


def plans_with_ancestors(t: Tables, reports: DataFrame | None = None) -> DataFrame:
    """Plans with their three ancestors. The ancestors are joined first, so the largest table is
    shuffled once, on ``proposal_id``, and every join has a side that is unique on its key."""
    return plan_rows(t).join(proposals_with_ancestors(t, reports), F.col("pa_proposal_id") == F.col("p_id"))


def with_children(parents: DataFrame, children: DataFrame, parent_id: str, child_key: str) -> DataFrame:
    """Parents with their children; a parent without any stays once, with empty child columns.

    The children are the left side of an inner join, so a parent with very many of them can be split at
    run time, which a left join from the parents could not be; childless parents are added.
    """
    met = children.join(parents, F.col(child_key) == F.col(parent_id))
    lone = parents.join(children.select(F.col(child_key).alias("__held")).distinct(), F.col(parent_id) == F.col("__held"), "left_anti")
    return met.unionByName(lone, allowMissingColumns=True).select(*parents.columns, *children.columns)


def downwards(t: Tables) -> DataFrame:
    """All reports with their findings, proposals and plans; parents without children stay."""
    rows = with_children(report_rows(t), finding_rows(t), "r_id", "f_report_id")
    rows = with_children(rows, proposal_rows(t), "f_id", "p_finding_id")
    return with_children(rows, plan_rows(t), "p_id", "pa_proposal_id")


def findings_downwards(t: Tables) -> DataFrame:
    """Findings of existing reports; proposals and plans where there are any."""
    rows = with_children(findings_with_report(t), proposal_rows(t), "f_id", "p_finding_id")
    return with_children(rows, plan_rows(t), "p_id", "pa_proposal_id")


def childless(parents: DataFrame, children: DataFrame, parent_key: str) -> DataFrame:
    return parents.join(children.select(F.col(parent_key).alias("id")), "id", "left_anti")


def of_parents(children: DataFrame, parents: DataFrame, parent_key: str) -> DataFrame:
    """Children whose parent is among the given parents."""
    return children.join(parents.select(F.col("id").alias(parent_key)), parent_key, "left_semi")


def below(t: Tables) -> Tables:
    """The tables with only the findings, proposals and plans under the given reports."""
    findings = of_parents(t.findings, t.reports, "report_id").select(*t.findings.columns)
    proposals = of_parents(t.proposals, findings, "finding_id").select(*t.proposals.columns)
    return t.with_(findings=findings, proposals=proposals, action_plans=of_parents(t.action_plans, proposals, "proposal_id").select(*t.action_plans.columns))


def by_id_or_code(df: DataFrame, key: str) -> DataFrame:
    return df.filter((F.col("id") == key) | (F.col("code") == key))


def resolve_ids(requests: DataFrame, df: DataFrame, ref: str, out: str) -> DataFrame:
    """Bulk look-up by id or code: two equi-joins; the id wins when both match."""
    ids = df.select(F.col("id").alias(ref), F.col("id").alias("__by_id"))
    codes = df.filter(F.col("code").isNotNull()).select(F.col("code").alias(ref), F.col("id").alias("__by_code"))
    return (requests.join(ids, ref, "left").join(codes, ref, "left")
            .withColumn(out, F.coalesce("__by_id", "__by_code")).drop("__by_id", "__by_code"))


# --- Roll-ups: aggregate at the child's grain first, then join tables that are unique on the key --

def child_counts(children: DataFrame, parent_key: str, out: str) -> DataFrame:
    return children.groupBy(parent_key).agg(F.count(F.lit(1)).alias(out))


def first_plan(t: Tables) -> DataFrame:
    """The first plan by code of every proposal."""
    cols = ["code", "title", "action_text", "action_owner", "target_date", "status", "progress_pct"]
    plans = t.action_plans.select("proposal_id", "id", *cols)
    return first_by(plans, ["proposal_id"], F.struct("code", "id"))


def earliest_plan_date(t: Tables) -> DataFrame:
    return t.action_plans.groupBy("proposal_id").agg(F.min(parse_date("target_date")).alias("min_target_dt"))


def flatten_first_plan(t: Tables) -> DataFrame:
    """One row per finding and proposal (or one for a finding without any) with its first plan."""
    fp = first_plan(t)
    fp = fp.select(*[F.col(c).alias(f"pa_{c}") for c in fp.columns])
    props = proposal_rows(t).join(fp, F.col("pa_proposal_id") == F.col("p_id"), "left")
    return with_children(findings_with_report(t), props, "f_id", "p_finding_id")


def decision_rows(t: Tables, cut: Column) -> DataFrame:
    """One row per finding, proposal and plan, with values taken from the deepest level that has one."""
    owner = first_filled("pa_action_owner", "p_action_owner", "f_action_owner", F.lit("Sin asignar"))
    target = first_filled("pa_target_date", "p_target_date", F.lit(""))
    status = first_filled("pa_status", "p_status", "f_status", F.lit(S.EN_PROCESO))
    pct = F.when(F.col("pa_id").isNotNull(), F.col("pa_progress_pct")).otherwise(F.lit(0))
    return findings_downwards(t).select(
        F.col("f_id").alias("finding_id"), F.col("f_code").alias("finding_code"),
        first_filled("f_title", "f_situation").alias("finding_title"),
        first_filled("r_title", "r_source_filename", F.lit("Informe")).alias("report_title"),
        F.col("p_id").alias("proposal_id"), F.coalesce("p_code", F.lit("-")).alias("proposal_code"),
        F.when(F.col("p_id").isNotNull(), first_filled("p_proposal_text", "p_title"))
        .otherwise("Sin propuesta").alias("proposal_text"),
        F.col("pa_id").alias("plan_id"), F.col("pa_code").alias("plan_code"),
        first_filled("pa_action_text", "pa_title").alias("plan_text"),
        first_filled("f_responsible_area", F.lit("Operaciones")).alias("area"),
        first_filled("f_severity", F.lit("Medio")).alias("severity"),
        owner.alias("owner"), target.alias("target_date"), status.alias("status"),
        days_overdue(parse_date(target), cut).alias("days_overdue"),
        ((status == S.PENDIENTE) | (F.coalesce(pct == 100, F.lit(False)) & (status != S.FINALIZADO))).alias("is_pending_val"),
    )


# --- Nested trees ---------------------------------------------------------------------------------

def _struct(prefix: str, cols: list[str], *extra) -> Column:
    return F.struct(*[F.col(f"{prefix}_{c}").alias(c) for c in cols], *extra)


def trees(t: Tables, root: str = "report") -> DataFrame:
    """Nested rows of one grain whatever the sizes: one per proposal, with its plans inside.

    Columns are ``report`` (with ``root="report"``; else the finding's ``report_code`` and ``report_title``),
    ``finding``, ``proposal`` with ``action_plans`` in code order. A finding without proposals, and a report
    without findings, is one row with the deeper levels empty, so the rows of a root together are its tree.
    """
    plans = t.action_plans.groupBy("proposal_id").agg(F.sort_array(F.collect_list(F.struct(F.col("code").alias("k"), F.struct(*PLAN_COLS).alias("v")))).alias("plans"))
    props = proposal_rows(t).join(plans.withColumnRenamed("proposal_id", "p_id"), "p_id", "left")
    parents = with_children(report_rows(t), finding_rows(t), "r_id", "f_report_id") if root == "report" else findings_with_report(t)
    rows = with_children(parents, props, "f_id", "p_finding_id")
    inner = F.transform(F.coalesce("plans", F.array().cast(props.schema["plans"].dataType)), lambda x: x["v"])
    proposal = F.when(F.col("p_id").isNotNull(), _struct("p", PROPOSAL_COLS, inner.alias("action_plans"))).alias("proposal")
    finding = F.when(F.col("f_id").isNotNull(), _struct("f", FINDING_COLS)).alias("finding")
    top = [_struct("r", REPORT_COLS).alias("report")] if root == "report" else [F.col("r_code").alias("report_code"), F.col("r_title").alias("report_title")]
    return rows.select(*top, finding, proposal)
