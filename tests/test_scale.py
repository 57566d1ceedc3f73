"""Tasks stay small: partition counts follow the input, and rows are dealt no more often than needed."""

import glob

from pyspark.sql import functions as F

from catalog import views
from catalog.views import Db
from rastro import session as N
from rastro.operators import blocks
from rastro.operators import hierarchy as H
from rastro.plans import sheets
from rastro.schema import Tables
from rastro.sources.tables import dump_trees

INITIAL = "spark.sql.adaptive.coalescePartitions.initialPartitionNum"


def _tables(spark):
    """Two reports with a finding, a proposal and two plans each."""
    of = lambda rows, names: spark.createDataFrame(rows, names)
    from rastro import schema as S
    full = lambda df, name: S.conform(df, S.SCHEMAS[name]).select(*S.SCHEMAS[name])
    return Tables.of(
        reports=full(of([("r1", "A1"), ("r2", "A2")], "id string, code string"), "reports"),
        findings=full(of([("f1", "r1", "H1"), ("f2", "r2", "H2")], "id string, report_id string, code string"), "findings"),
        proposals=full(of([("p1", "f1", "P1"), ("p2", "f2", "P2")], "id string, finding_id string, code string"), "proposals"),
        action_plans=full(of([("a1", "p1", "C1"), ("a2", "p1", "C2"), ("a3", "p2", "C3"), ("a4", "p2", "C4")], "id string, proposal_id string, code string"), "action_plans"))


def test_dump_is_compressed(spark, tmp_path):
    path = dump_trees(_tables(spark), f"{tmp_path}/dump")
    assert glob.glob(f"{path}/part-*") == glob.glob(f"{path}/part-*.json.gz") != []
    back = spark.read.schema(H.trees(_tables(spark), "report").schema).json(path)
    assert sorted(r[0] for r in back.select(F.explode("proposal.action_plans.id")).collect()) == ["a1", "a2", "a3", "a4"]


def test_below_keeps_only_what_hangs_on_the_reports(spark):
    t = _tables(spark)
    one = H.below(t.with_(reports=t.reports.filter("id = 'r2'")))
    ids = lambda df: sorted(r["id"] for r in df.collect())
    assert [ids(one.findings), ids(one.proposals), ids(one.action_plans)] == [["f2"], ["p2"], ["a3", "a4"]]


def test_plan_rows_are_looked_up_once(spark):
    """Every reason for a reject, and both ways to a proposal, by one join of the rows."""
    findings = spark.createDataFrame([("x", c) for c in ("H1", "H2", "H3")], "file string, code string")
    proposals = spark.createDataFrame([("x", "H1", "P1", "o1", 1), ("x", "H2", "P2", "o2", 2), ("x", "H2", "P3", "o3", 3)],
                                      "file string, h_code string, code string, action_owner string, row_no bigint")
    rows = spark.createDataFrame([
        (1, "P1", None), (2, "P2", "H2"), (3, None, "H1"), (4, "P9", "H1"), (5, "P1", "H2"), (6, "", ""), (7, "", "H9"), (8, "", "H3"), (9, None, "H2"), (10, None, None)],
        "row_no bigint, p_code string, h_code string").withColumns({"file": F.lit("x"), "pa_code": F.concat(F.lit("PA-"), F.col("row_no").cast("string"))})
    good, rejects = sheets.apply_plan_sheet(findings, proposals, rows)
    assert sorted((r.row_no, r.h_code, r.p_code, r.action_owner) for r in good.collect()) == [(1, "H1", "P1", "o1"), (2, "H2", "P2", "o2"), (3, "H1", "P1", "o1")]
    assert {r.row_no: r.reason for r in rejects.collect()} == {
        4: "proposal_not_in_file", 5: "proposal_of_other_finding", 6: "no_parent_given", 7: "finding_not_in_file", 8: "finding_without_proposal",
        9: "finding_with_several_proposals", 10: "no_parent_given"}
    shuffles = rejects._jdf.queryExecution().optimizedPlan().toString().count("Join LeftOuter")
    assert shuffles == 1


def _proposal_sheet(spark):
    """A finding sheet, in which P1 stands under two findings, and a proposal sheet with a row of every kind; row 5 comes twice."""
    cols = "row_no bigint, h_code string, situation string, p_code string, prop_text string, owner string"
    staged = sheets.staged_rows(spark.createDataFrame([
        (1, "H1", "s1", "P1", "t1", "o1"), (2, "H2", "s2", "P1", "t2", "o2"), (3, "", "", "PM-IMP-S2-009", "t3", "")], cols).withColumn("file", F.lit("x")), 2)
    rows = spark.createDataFrame([
        (1, "P1", "", "T1", ""), (2, "P1", None, "", "Ow"), (3, "N1", "H9", "x", ""), (4, "N1", "", "x", ""), (5, "N1", "H1", "n1", ""), (5, "N1", "H1", "n1", ""),
        (6, "N1", "H9", "", "later"), (7, None, "H9", "lost", ""), (9, "", "H2", "made", ""), (10, "PM-IMP-S2-009", "", "upd", ""), (11, "P1", "H1", None, None)],
        "row_no bigint, p_code string, h_code string, prop_text string, owner string").withColumn("file", F.lit("x"))
    return sheets.sheet_findings(staged), sheets.sheet_proposals(staged), rows


def test_proposal_rows_update_attach_or_are_rejected(spark):
    merged, rejects = sheets.apply_proposal_sheet(*_proposal_sheet(spark))
    assert sorted((r.h_code, r.code, r.source_sheet, r.row_no, r.proposal_text, r.action_owner) for r in merged.collect()) == [
        ("H1", "N1", 2, 5, "n1", "later"), ("H1", "N1", 2, 5, "n1", "later"), ("H1", "P1", 1, 1, "t1", "o1"), ("H2", "P1", 1, 2, "T1", "Ow"),
        ("H2", "PM-IMP-S2-009", 1, 3, "upd", "Auditoría"), ("H2", "PM-IMP-S2-009", 2, 9, "upd", "o2")]
    assert sorted((r.row_no, r.code, r.reason) for r in rejects.collect()) == [
        (3, "N1", "finding_not_in_file"), (4, "N1", "finding_not_given"), (7, "lost", "finding_not_in_file")]


def test_proposal_rows_are_judged_once(spark, monkeypatch):
    """The rows of the sheet are judged and written; what is made of them reads them there, and known proposals are dealt by one key only."""
    findings, proposals, rows = _proposal_sheet(spark)
    written = []
    keep = sheets.settle
    monkeypatch.setattr(sheets, "settle", lambda df, purpose: written.append(purpose) or keep(df, purpose))
    merged, rejects = sheets.apply_proposal_sheet(findings, keep(proposals, "known"), rows)
    plan = lambda df: df._jdf.queryExecution().optimizedPlan().toString()
    assert written == ["proposal-rows", "proposal-rows"] and "Join" not in plan(rejects)
    assert plan(merged).count("Join LeftOuter") == 2 and plan(merged).count("Join ") == 4  # the updates to either kind, and twice what they are made from
    assert "min_by" not in plan(proposals.select("file", "h_code", "code", "row_no"))  # no texts for the codes alone


def test_running_values_are_not_dealt(spark, monkeypatch):
    written = []
    keep = blocks.settle
    monkeypatch.setattr(blocks, "settle", lambda df, purpose: written.append(df.columns) or keep(df, purpose))
    df = spark.createDataFrame([("a", 1, "x"), ("a", 2, None), ("b", 3, None)], "k string, i bigint, v string")
    out = blocks.running(df, ["k"], "i", {"last": ("last", F.col("v")), "n": ("sum", F.lit(1))})
    assert sorted(map(tuple, out.collect())) == [("a", 1, "x", "x", 1), ("a", 2, None, "x", 2), ("b", 3, None, None, 1)]
    assert written == [["k", "i", "v", blocks.BLOCK]]


def test_tasks_are_bounded(spark):
    for key in ("spark.sql.adaptive.advisoryPartitionSizeInBytes", "spark.sql.files.maxPartitionBytes"):
        spark.conf.set(key, "64MB")
    N.tune(spark)
    assert N._bytes(spark.conf.get("spark.sql.adaptive.advisoryPartitionSizeInBytes")) == N.TASK_BYTES
    assert N._bytes(spark.conf.get("spark.sql.files.maxPartitionBytes")) == N.TASK_BYTES
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1m")
    N.tune(spark)
    assert spark.conf.get("spark.sql.files.maxPartitionBytes") == "1m"  # a smaller bound is kept


def test_shuffles_follow_the_input(spark):
    try:
        N.spread(spark, 40 * N.TASK_BYTES + 1)
        assert spark.conf.get(INITIAL) == "41"
        N.spread(spark, 10 * N.TASK_BYTES)
        assert spark.conf.get(INITIAL) == "41"
    finally:
        spark.conf.unset(INITIAL)


def test_texts_are_dealt_by_their_size(spark, tmp_path, monkeypatch):
    spark.range(2000).select(F.col("id").alias("doc_id"), F.sha2(F.col("id").cast("string"), 512).alias("text")).coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    db = Db(spark, str(tmp_path))
    assert db.parts == spark.sparkContext.defaultParallelism
    monkeypatch.setattr(views, "TEXT_BYTES", 1 << 10)
    assert db.parts > 50
