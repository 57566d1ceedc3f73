"""Dashboard and executive KPIs. Every measure is taken at the grain it counts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rastro import schema as S
from rastro.functions.basic import filled, first_filled, half_up_pct, low, nonblank, rate
from rastro.functions.dates import days_overdue, parse_date
from rastro.functions.status import client_status, normalize_severity, normalize_status
from rastro.operators import filters as P
from rastro.operators import hierarchy as H
from rastro.schema import Tables

def N() -> Column:
    return F.count(F.lit(1))


def _domain(df: DataFrame, column: str, values: list[str]) -> DataFrame:
    """Left-join counts to a fixed list of values, so that absent ones show as zero."""
    spark = df.sparkSession
    listed = spark.range(1).select(F.posexplode(F.array(*[F.lit(v) for v in values])).alias("position", column))
    return listed.join(df, column, "left")


def _zero_filled(counts: DataFrame, column: str, values: list[str], out: str = "total") -> DataFrame:
    return (_domain(counts, column, values)
            .select(column, F.coalesce(out, F.lit(0)).alias(out), "position").orderBy("position").drop("position"))


# --- Report roll-up --------------------------------------------------------------------------------

def report_rollup(t: Tables) -> DataFrame:
    """Findings, proposals, plans and pending plans per report, newest report first.

    Counts climb the hierarchy one level at a time; each level is aggregated before it is joined.
    """
    pending = F.count_if(~low("status").isin(S.CLOSED4B))
    per_proposal = t.action_plans.groupBy(F.col("proposal_id").alias("id")).agg(N().alias("plans"), pending.alias("pending"))
    per_finding = (t.proposals.select("id", "finding_id").join(per_proposal, "id", "left")
                   .groupBy(F.col("finding_id").alias("id"))
                   .agg(N().alias("proposals"), F.sum("plans").alias("plans"), F.sum("pending").alias("pending")))
    per_report = (t.findings.select("id", "report_id").join(per_finding, "id", "left")
                  .groupBy(F.col("report_id").alias("id"))
                  .agg(N().alias("findings_count"), F.sum("proposals").alias("proposals_count"),
                       F.sum("plans").alias("action_plans_count"), F.sum("pending").alias("pending_plans_count")))
    counts = ["findings_count", "proposals_count", "action_plans_count", "pending_plans_count"]
    return (t.reports.join(per_report, "id", "left")
            .withColumns({c: F.coalesce(c, F.lit(0)) for c in counts})
            .orderBy(F.col("created_at").desc_nulls_last(), "id"))


# --- Dashboard -------------------------------------------------------------------------------------

def dashboard_scalars(t: Tables, cut: Column) -> DataFrame:
    open_ = ~low("status").isin(S.CLOSED3)
    f = t.findings.agg(F.count_if(open_).alias("open_findings"),
                       F.count_if(open_ & low("severity").isin(S.HIGH7)).alias("high_risk_findings"))
    p = t.proposals.agg(N().alias("total_proposals"))
    late = P.overdue(parse_date("target_date"), "status", cut, S.CLOSED3)
    pa = t.action_plans.agg(F.count_if(late).alias("overdue_plans"), N().alias("total_plans"),
                            F.count_if(low("status").isin(S.CLOSED3)).alias("completed_plans"))
    pa = pa.withColumn("impl_rate", F.coalesce(rate("completed_plans", "total_plans"), F.lit(0.0)))
    # Three one-row frames side by side.
    return _side_by_side(f, p, pa)


def _side_by_side(*frames: DataFrame) -> DataFrame:
    """One row of the columns of one-row frames: stacked, then taken together by one aggregate, without a join."""
    stacked = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)
    return stacked.agg(*[F.max(c).alias(c) for c in stacked.columns])


def severity_breakdown(t: Tables) -> DataFrame:
    counts = t.findings.groupBy(normalize_severity("severity").alias("severity")).agg(N().alias("total"))
    return _zero_filled(counts, "severity", S.SEVERITIES)


def status_breakdown(t: Tables) -> DataFrame:
    return t.findings.groupBy(normalize_status("status").alias("status")).agg(N().alias("total"))


def area_breakdown(t: Tables) -> DataFrame:
    return t.findings.groupBy("responsible_area").agg(
        N().alias("total"), F.count_if(low("status").isin(S.CLOSED3)).alias("closed"))


# Bucket labels.
FINDING_AGE = ["0-30 días", "31-60 días", "61-90 días", "Más de 90 días"]
OVERDUE_AGE = ["1-30 días", "31-60 días", "Más de 60 días"]


def finding_aging(t: Tables, cut: Column) -> DataFrame:
    age = F.datediff(cut, F.to_date("created_at"))
    bucket = (F.when(age > 90, FINDING_AGE[3]).when(age > 60, FINDING_AGE[2])
              .when(age > 30, FINDING_AGE[1]).otherwise(FINDING_AGE[0]))
    counts = (t.findings.filter(~low("status").isin(S.CLOSED3))
              .groupBy(bucket.alias("bucket")).agg(N().alias("total")))
    return _zero_filled(counts, "bucket", FINDING_AGE)


def critical_pending(t: Tables, cut: Column, top: int = 10, mode: str = "as_is") -> DataFrame:
    """High-severity findings or overdue plans, first ``top`` rows.

    ``as_is`` orders severity as text, downwards; ``rank`` puts high before medium before low.
    """
    dt = parse_date("pa_target_date")
    late = F.coalesce((dt < cut) & ~low("pa_status").isin(S.CLOSED2), F.lit(False))
    rows = (H.finding_rows(t)
            .join(H.proposal_rows(t), F.col("p_finding_id") == F.col("f_id"), "left")
            .join(H.plan_rows(t), F.col("pa_proposal_id") == F.col("p_id"), "left")
            .filter(F.coalesce(low("f_severity") == "alto", F.lit(False)) | late))
    severity = (F.col("f_severity").desc_nulls_last() if mode == "as_is"
                else F.array_position(F.array(*[F.lit(s) for s in S.SEVERITIES]), normalize_severity("f_severity")).asc())
    top_rows = rows.orderBy(severity, dt.asc_nulls_first(), F.col("f_code").asc(), F.col("pa_code").asc_nulls_first()).limit(top)
    return top_rows.select(
        F.col("f_code").alias("code"), F.col("pa_code").alias("plan_code"), F.col("f_title").alias("title"),
        F.col("f_severity").alias("severity"), F.col("f_responsible_area").alias("area"),
        F.col("f_action_owner").alias("owner"),
        F.coalesce(filled("pa_target_date"), cut.cast("string")).alias("target_date"),
        days_overdue(dt, cut).alias("days_overdue"))


# --- Executive KPIs --------------------------------------------------------------------------------

def proposal_states(s: P.Scoped) -> DataFrame:
    counts = s.proposals.groupBy(normalize_status("p_status").alias("state")).agg(N().alias("total"))
    return _zero_filled(counts, "state", S.STATUSES)


def is_validated() -> Column:
    return low("p_status").isin(S.VALIDATED4) & nonblank("p_validated_by")


def validated_implementation(s: P.Scoped) -> DataFrame:
    return (s.proposals.agg(F.count_if(is_validated()).alias("validated"), N().alias("total"))
            .withColumn("rate", rate("validated", "total")))


def on_time_closure(s: P.Scoped) -> DataFrame:
    closed = low("pa_status").isin(S.CLOSED3)
    both = nonblank("pa_closed_date") & nonblank("pa_target_date")
    in_time = parse_date("pa_closed_date") <= F.col("pa_target_dt")
    return (s.plans.agg(F.count_if(closed & both & in_time).alias("on_time"),
                        F.count_if(closed & both).alias("evaluable"),
                        F.count_if(closed & ~both).alias("excluded"))
            .withColumn("rate", rate("on_time", "evaluable")))


def pending_validation_count(s: P.Scoped) -> DataFrame:
    return s.plans.agg(F.count_if(P.pending_validation("pa_progress_pct", "pa_status")).alias("pending_validation"))


# Measures of the scope cube: counts of the plans, of the proposals and of the findings.
PLAN_MEASURES = ["plans", "overdue_plans", "suspended_overdue", "pending_validation", "on_time", "evaluable", "excluded"]
PROPOSAL_MEASURES = ["proposals", "validated_proposals"] + [f"state: {v}" for v in S.STATUSES]
FINDING_MEASURES = ["findings", "high_risk_open", "medium_risk_open", "low_risk_open", "overdue_findings"]
MEASURES = FINDING_MEASURES + PROPOSAL_MEASURES + PLAN_MEASURES


def _q(name: str) -> Column:
    return F.col(f"`{name}`")


def _plans_of_proposals(t: Tables, cut: Column) -> DataFrame:
    dt = parse_date("target_date")
    closed = low("status").isin(S.CLOSED3)
    both = nonblank("closed_date") & nonblank("target_date")
    counts = {
        "plans": N(), "overdue_plans": F.count_if(P.overdue(dt, "status", cut)),
        "suspended_overdue": F.count_if(P.suspended_overdue(dt, "status", cut)),
        "pending_validation": F.count_if(P.pending_validation("progress_pct", "status")),
        "on_time": F.count_if(closed & both & (parse_date("closed_date") <= dt)),
        "evaluable": F.count_if(closed & both), "excluded": F.count_if(closed & ~both),
    }
    return t.action_plans.groupBy("proposal_id").agg(*[c.alias(m) for m, c in counts.items()])


def _proposals_of_findings(t: Tables, cut: Column, areas: list[str] | None) -> DataFrame:
    """Sums per finding and area of its proposals, and per finding over all of them (``whole``).

    With ``areas`` the proposals of other areas are told apart no further.
    """
    state = normalize_status("p.status")
    valid = low("p.status").isin(S.VALIDATED4) & nonblank("p.validated_by")
    theirs = F.col("p.responsible_area")
    rows = (t.proposals.alias("p").join(_plans_of_proposals(t, cut).alias("pa"), F.col("p.id") == F.col("pa.proposal_id"), "left")
            .select(F.col("p.finding_id").alias("finding_id"), (theirs if areas is None else F.when(theirs.isin(areas), theirs)).alias("p_area"),
                    valid.alias("__valid"), state.alias("__state"), *[_q(m) for m in PLAN_MEASURES]))
    counts = [N().alias("proposals"), F.count_if("__valid").alias("validated_proposals"),
              *[F.count_if(F.col("__state") == v).alias(f"state: {v}") for v in S.STATUSES],
              *[F.coalesce(F.sum(_q(m)), F.lit(0)).alias(m) for m in PLAN_MEASURES]]
    if not (areas is None or areas):
        return rows.groupBy("finding_id").agg(*counts).withColumns({"area": F.lit(None).cast("string"), "whole": F.lit(True)})
    per_area = rows.groupBy("finding_id", "p_area").agg(*counts)
    both = F.array(F.struct(F.col("p_area").alias("area"), F.lit(False).alias("whole")),
                   F.struct(F.lit(None).cast("string").alias("area"), F.lit(True).alias("whole")))
    sums = [F.sum(_q(m)).alias(m) for m in PROPOSAL_MEASURES + PLAN_MEASURES]
    return (per_area.select("finding_id", *[_q(m) for m in PROPOSAL_MEASURES + PLAN_MEASURES], F.inline(both))
            .filter("whole OR area IS NOT NULL").groupBy("finding_id", "area", "whole").agg(*sums))


def scope_cube(t: Tables, cut: Column, areas: list[str] | None = None) -> DataFrame:
    """Exact counts per report and area, and per report over all areas (``all_areas``), that add up to those of any scope.

    A finding is in an area if its own area or a proposal's is that one; with its own area all its proposals and plans
    count there, else those of the proposals of that area. A finding has one report and is one row per area, so
    sums over reports are distinct counts already, and the reports with a count above zero are the distinct reports.
    Columns: report_id, report_code, period, area, all_areas and ``MEASURES``. Counts climb the hierarchy: every level
    is summed before it is joined, three joins in all. ``areas`` leaves all others out from the start; an empty list leaves the totals alone.
    """
    below = [F.coalesce(_q(m), F.lit(0)).alias(m) for m in PROPOSAL_MEASURES + PLAN_MEASURES]
    sums = _proposals_of_findings(t, cut, areas)
    rows = t.findings.alias("f").join(sums.alias("s"), F.col("f.id") == F.col("s.finding_id"), "left")
    whole = F.coalesce("s.whole", F.lit(True))
    own = F.col("f.responsible_area")
    apart = ~whole & F.coalesce(F.col("s.area") != own, F.lit(True))
    total = F.struct(F.lit(None).cast("string").alias("area"), F.lit(True).alias("all_areas"))
    place = F.array(total, F.struct(own.alias("area"), F.lit(False).alias("all_areas")))
    there = F.array(F.struct(F.col("s.area").alias("area"), F.lit(False).alias("all_areas")))
    measured = rows.filter(whole | apart).select(
        F.col("f.report_id").alias("report_id"),
        *[P.open_severity("f.severity", "f.status", words).alias(name)
          for name, words in (("high_risk_open", S.HIGH5), ("medium_risk_open", S.MED3), ("low_risk_open", S.LOW3))],
        *below, F.inline(F.when(whole, place).otherwise(there))).filter("all_areas OR area IS NOT NULL")
    if areas is not None:
        measured = measured.filter(F.col("all_areas") | F.col("area").isin(areas))
    per_report = measured.groupBy("report_id", "area", "all_areas").agg(
        N().alias("findings"), *[F.count_if(m).alias(m) for m in FINDING_MEASURES[1:4]],
        F.count_if(F.col("overdue_plans") > 0).alias("overdue_findings"),
        *[F.sum(_q(m)).alias(m) for m in PROPOSAL_MEASURES + PLAN_MEASURES])
    reports = t.reports.select("id", F.col("code").alias("report_code"), "period")
    return reports.join(per_report, F.col("id") == F.col("report_id"), "left").select(
        F.col("id").alias("report_id"), "report_code", "period", "area", F.coalesce("all_areas", F.lit(True)).alias("all_areas"),
        *[F.coalesce(_q(m), F.lit(0)).alias(m) for m in MEASURES])


def scope_of_cube(cube: DataFrame, scope: P.Scope | None = None) -> DataFrame:
    """One row of all measures for a scope, merged from the cube; ``reports`` and ``high_risk_reports`` beside them."""
    scope = scope or P.Scope()
    rows = cube.filter(F.col("area") == scope.area if scope.area else F.col("all_areas"))
    if scope.report:
        rows = rows.filter((F.col("report_id") == scope.report) | (F.col("report_code") == scope.report))
    if scope.period:
        rows = rows.filter(F.col("period").contains(scope.period))
    return rows.agg(N().alias("reports"), F.count_if(F.col("high_risk_open") > 0).alias("high_risk_reports"),
                    *[F.coalesce(F.sum(_q(m)), F.lit(0)).alias(m) for m in MEASURES])


def _measures(t: Tables, cut: Column, scope: P.Scope | None) -> DataFrame:
    return scope_of_cube(scope_cube(t, cut, [scope.area] if scope and scope.area else []), scope)


def scope_counts(t: Tables, cut: Column, scope: P.Scope | None = None) -> DataFrame:
    return _measures(t, cut, scope).select("reports", "findings", "proposals", "plans")


def open_by_severity(t: Tables, cut: Column, scope: P.Scope | None = None) -> DataFrame:
    return _measures(t, cut, scope).select(*FINDING_MEASURES[1:4], F.col("high_risk_reports").alias("affected_reports"))


def overdue_commitments(t: Tables, cut: Column, scope: P.Scope | None = None) -> DataFrame:
    return _measures(t, cut, scope).select("overdue_plans", F.col("overdue_findings").alias("affected_findings"), "suspended_overdue")


def executive_summary(t: Tables, cut: Column, scope: P.Scope | None = None) -> DataFrame:
    """All card values as (metric, value) rows."""
    named = {"reports": "scope_reports", "findings": "scope_findings", "proposals": "scope_proposals", "plans": "scope_plans"}
    rates = {"validated_rate": rate("validated_proposals", "proposals"), "on_time_rate": rate("on_time", "evaluable")}
    return _long(_measures(t, cut, scope).withColumns(rates).withColumnsRenamed(named))


def _long(one_row: DataFrame) -> DataFrame:
    pairs = [F.struct(F.lit(c).alias("metric"), F.col(f"`{c}`").cast("double").alias("value")) for c in one_row.columns]
    return one_row.select(F.inline(F.array(*pairs)))


def area_comparison(t: Tables, cut: Column, scope: P.Scope | None = None) -> DataFrame:
    """High, medium and low open findings and overdue plans per area.

    The area of a finding-proposal pair is the finding's own, else the proposal's, so a finding
    without an area counts once in each area of its proposals. Findings are paired with *distinct*
    proposal areas and plans are summed per proposal first; nothing is counted distinct after a
    fan-out.
    """
    scope = scope or P.Scope()
    findings = H.findings_with_report(t, P.scope_reports(t, scope)).select(
        "f_id", "f_severity", "f_status", "f_responsible_area")
    late = P.overdue(parse_date("target_date"), "status", cut, S.AREA_OVERDUE_EXCL)
    late_by_proposal = t.action_plans.groupBy(F.col("proposal_id").alias("p_id")).agg(F.count_if(late).alias("overdue"))
    pairs = (t.proposals.select(F.col("id").alias("p_id"), F.col("finding_id").alias("f_id"),
                                F.coalesce("responsible_area", F.lit("")).alias("p_area"))
             .join(late_by_proposal, "p_id", "left")
             .groupBy("f_id", "p_area").agg(F.sum("overdue").alias("overdue")))
    area = F.coalesce(filled("f_responsible_area"), filled("p_area"), F.lit("Sin área"))
    rows = findings.join(pairs, "f_id", "left")
    if scope.area:
        rows = rows.filter((F.col("f_responsible_area") == scope.area) | (F.col("p_area") == scope.area))
    per_finding = rows.groupBy(area.alias("area"), "f_id").agg(
        F.any_value("f_severity").alias("f_severity"), F.any_value("f_status").alias("f_status"),
        F.sum("overdue").alias("overdue"))
    out = per_finding.groupBy("area").agg(
        *[F.count_if(P.open_severity("f_severity", "f_status", words, S.CLOSED3)).alias(name)
          for name, words in (("high_risk_open", S.HIGH5), ("medium_risk_open", S.MED3), ("low_risk_open", S.LOW3))],
        F.coalesce(F.sum("overdue"), F.lit(0)).alias("overdue"))
    counts = ["high_risk_open", "medium_risk_open", "low_risk_open", "overdue"]
    return (out.filter(reduce(lambda a, b: a | b, [F.col(c) > 0 for c in counts]))
            .orderBy(F.desc("overdue"), F.desc("high_risk_open"), "area"))


def overdue_aging(s: P.Scoped, cut: Column) -> DataFrame:
    age = F.datediff(cut, F.col("pa_target_dt"))
    bucket = F.when(age > 60, OVERDUE_AGE[2]).when(age > 30, OVERDUE_AGE[1]).otherwise(OVERDUE_AGE[0])
    counts = (s.plans.filter(P.overdue(F.col("pa_target_dt"), "pa_status", cut))
              .groupBy(bucket.alias("bucket")).agg(N().alias("total")))
    return _zero_filled(counts, "bucket", OVERDUE_AGE)


# --- Screen roll-ups -------------------------------------------------------------------------------

def area_list(t: Tables) -> DataFrame:
    closed = low("status") == "finalizado"
    out = t.findings.groupBy(first_filled("responsible_area", F.lit("Operaciones")).alias("area")).agg(
        N().alias("total"), F.count_if(low("severity") == "alto").alias("high"),
        F.count_if(~F.coalesce(closed, F.lit(False))).alias("open"), F.count_if(closed).alias("closed"))
    return out.withColumn("closed_pct", half_up_pct("closed", "total")).orderBy(F.desc("total"), "area")


def sidebar_metrics(t: Tables, cut: Column) -> DataFrame:
    done = client_status("status", F.lit(None).cast("string"), cut) == S.FINALIZADO
    f = t.findings.agg(N().alias("findings"), F.count_if(~done).alias("open_findings"))
    pa = t.action_plans.agg(half_up_pct(F.count_if(done), N()).alias("plans_done_pct"))
    # Without findings the bar stays at zero.
    return _side_by_side(f, pa).select("open_findings", F.when(F.col("findings") > 0, F.col("plans_done_pct"))
                                       .otherwise(0).alias("plans_done_pct"))


def proposal_cards(listing: DataFrame, cut: Column) -> DataFrame:
    """Over the proposal listing, already limited by ``filters.proposal_tab_filter``."""
    screen = client_status("status", "target_date", cut)
    return listing.agg(
        N().alias("total"), F.count_if(P.open_without_plan("action_plans_count", screen)).alias("open_without_plan"),
        F.count_if(F.col("effective_status").isin(S.EN_PROCESO, S.VENCIDO)).alias("in_process"),
        F.count_if(screen == S.FINALIZADO).alias("completed"))


def plan_pie(t: Tables, cut: Column) -> DataFrame:
    late = F.count_if(P.overdue(parse_date("target_date"), "status", cut, S.CLOSED3))
    return t.action_plans.agg((N() - late).alias("on_time"), late.alias("overdue"))


def report_options(t: Tables) -> DataFrame:
    return t.reports.select("id", "code", "title").distinct().orderBy("title", "id")


def area_options(t: Tables) -> DataFrame:
    f, p = (df.filter(nonblank("responsible_area")).select("responsible_area") for df in (t.findings, t.proposals))
    return f.union(p).distinct().orderBy("responsible_area")


def period_options(t: Tables) -> DataFrame:
    return t.reports.filter(nonblank("period")).select("period").distinct().orderBy(F.desc("period"))


def table_counts(t: Tables) -> DataFrame:
    frames = [df.agg(N().alias("rows")).select(F.lit(n).alias("table_name"), "rows") for n, df in t.present().items()]
    return reduce(DataFrame.unionByName, frames)
