"""Executive measures: merged from the cube, and how many joins the plans of alerts and summaries need."""

import pytest
from pyspark.sql import functions as F

from rastro.operators import filters as P
from rastro.plans import alerts, kpis
from rastro.schema import Tables

CUT = "2026-03-01"


@pytest.fixture(scope="module")
def cut():
    return F.lit(CUT).cast("date")


def joins(df) -> int:
    """Joins of the optimised logical plan."""
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    return sum(line.lstrip(" :+-").startswith("Join ") for line in plan.splitlines())


def small(spark) -> Tables:
    """Two reports; areas of findings and proposals that agree, differ, or are missing on either side."""
    r = spark.createDataFrame([("r1", "R1", "2023"), ("r2", "R2", "2024"), ("r3", "R3", "2023")], "id string, code string, period string")
    f = spark.createDataFrame([("f1", "r1", "F1", "A", "alto", "abierto"), ("f2", "r1", "F2", None, "alto", "abierto"),
                               ("f3", "r2", "F3", "B", "medio", "cerrado"), ("f4", "r9", "F4", "A", "alto", "abierto"),
                               ("f5", "r2", "F5", "A", "bajo", None)],
                              "id string, report_id string, code string, responsible_area string, severity string, status string")
    p = spark.createDataFrame([("p1", "f1", "P1", "B", "en proceso", None), ("p2", "f1", "P2", "A", "validado", "x"),
                               ("p3", "f2", "P3", "A", None, None), ("p4", "f2", "P4", None, "finalizado", "y"),
                               ("p5", "f4", "P5", "A", "en proceso", None), ("p6", None, "P6", "A", "en proceso", None)],
                              "id string, finding_id string, code string, responsible_area string, status string, validated_by string")
    pa = spark.createDataFrame([("a1", "p1", "2020-01-01", "en proceso", None, 10), ("a2", "p1", "2020-01-01", "cerrado", "2019-12-31", 100),
                                ("a3", "p3", "01/02/2020", "en suspensión", None, 100), ("a4", "p4", None, "finalizado", "2020-01-01", None),
                                ("a5", "p9", "2020-01-01", "en proceso", None, 0)],
                               "id string, proposal_id string, target_date string, status string, closed_date string, progress_pct int")
    return Tables.of(reports=r, findings=f, proposals=p, action_plans=pa)


def test_cube_places_a_finding_once_in_every_area(spark, cut):
    cube = {(x.report_id, x.area): x for x in kpis.scope_cube(small(spark), cut).collect()}
    assert set(cube) == {("r1", None), ("r1", "A"), ("r1", "B"), ("r2", None), ("r2", "A"), ("r2", "B"), ("r3", None)}
    whole = cube["r1", None]
    assert (whole.findings, whole.proposals, whole.plans, whole.overdue_plans, whole.overdue_findings) == (2, 4, 4, 1, 1)
    assert (whole.on_time, whole.evaluable, whole.excluded, whole.suspended_overdue, whole.pending_validation) == (1, 1, 1, 1, 1)
    in_a = cube["r1", "A"]  # f1 by its own area with both proposals, f2 by p3 alone
    assert (in_a.findings, in_a.proposals, in_a.plans, in_a.validated_proposals) == (2, 3, 3, 1)
    in_b = cube["r1", "B"]  # f1 by p1 alone
    assert (in_b.findings, in_b.proposals, in_b.plans, in_b.overdue_findings) == (1, 1, 2, 1)
    assert (cube["r3", None].findings, cube["r3", None].plans) == (0, 0)


def test_no_tables_no_counts(spark, cut):
    t = small(spark)
    empty = Tables.of(**{n: df.limit(0) for n, df in t.present().items()})
    assert kpis.scope_counts(empty, cut).first() == (0, 0, 0, 0)
    assert alerts.active_alerts(empty, cut).count() == 0


@pytest.mark.parametrize("scope", [P.Scope(), P.Scope(area="A"), P.Scope(area="B", period="2023"), P.Scope(report="R2"), P.Scope(area="missing")])
def test_scopes_are_merged_from_one_cube(spark, cut, scope):
    """One cube of all areas answers what each scope counts directly, and both agree with the scoped rows."""
    t = small(spark)
    merged = kpis.scope_of_cube(kpis.scope_cube(t, cut), scope).first()
    assert merged == kpis.scope_of_cube(kpis.scope_cube(t, cut, [scope.area] if scope.area else []), scope).first()
    s = P.scoped(t, scope)
    late = P.overdue(F.col("pa_target_dt"), "pa_status", cut)
    assert (merged.reports, merged.findings, merged.proposals, merged.plans) == (s.reports.count(), s.findings.count(), s.proposals.count(), s.plans.count())
    assert merged.overdue_findings == s.plans.filter(late).select("p_finding_id").distinct().count()
    assert merged.high_risk_reports == s.findings.filter("f_severity = 'alto'").select("f_report_id").distinct().count()


def test_plans_join_little(spark, cut):
    t = small(spark)
    assert joins(alerts.active_alerts(t, cut)) <= 5
    assert joins(kpis.executive_summary(t, cut, P.Scope(area="A"))) <= 3


def test_alerts_of_orphans_are_not_raised(spark, cut):
    rows = alerts.active_alerts(small(spark), cut)
    assert {x.id for x in rows.collect()}.isdisjoint({"f4", "p5", "p6", "a5"})
