"""Tables at rest: look-ups that skip row groups, copies between stores, the default cut date."""

import datetime
import zoneinfo

import pytest
from pyspark.sql import functions as F

from rastro import session
from rastro.schema import Tables
from rastro.sources import tables as T


def rows_read(df) -> int:
    """Rows that the scan of a query without shuffles gave out, after row groups and pages were skipped."""
    df.collect()
    leaves = df._jdf.queryExecution().executedPlan().collectLeaves()
    return leaves.apply(0).metrics().apply("numOutputRows").value()


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    """60,000 plans; codes in no order along the parents, values of one length so that minima and maxima say nothing."""
    n = 60_000
    hashed = lambda c: F.md5(F.concat(F.lit(c), F.col("n").cast("string")))
    plans = spark.range(n).withColumnRenamed("id", "n").select(
        hashed("id").alias("id"), F.concat(F.lit("PA-"), hashed("code")).alias("code"),
        # a third of all plans have one parent
        F.when(F.col("n") % 3 == 0, F.lit("hot")).otherwise(F.md5((F.col("n") / 10).cast("int").cast("string"))).alias("proposal_id"))
    empty = lambda: spark.createDataFrame([], "id string, code string")
    t = Tables.of(reports=empty(), findings=empty(), proposals=empty(), action_plans=plans)
    path = T.write_for_lookup(t, str(tmp_path_factory.mktemp("lookup")), row_group_bytes=256 * 1024)
    blind = spark.read.option("parquet.filter.bloom.enabled", "false").parquet(f"{path}/action_plans")
    return T.read_tables(spark, path), plans, blind


@pytest.mark.parametrize("key", ["id", "code", "proposal_id"])
def test_point_lookups_skip_row_groups(stored, key):
    t, plans, blind = stored
    some = [plans.filter("proposal_id <> 'hot' AND code > 'PA-8'").orderBy("code").first()[key]]
    found = T.lookup(t, "action_plans", key, some)
    expected = sorted(r.id for r in plans.filter(F.col(key) == some[0]).collect())
    assert sorted(r.id for r in found.collect()) == expected
    assert rows_read(found) < 12_000  # of 60,000
    if key == "code":  # minima and maxima say nothing here: without the filters all is read
        assert rows_read(blind.filter(F.col(key) == some[0])) > 40_000
        assert rows_read(T.lookup(t, "action_plans", key, [some[0][:-1] + "x"])) < 12_000


def test_hot_parent_is_whole(stored):
    t, plans, _ = stored
    assert T.lookup(t, "action_plans", "proposal_id", ["hot"]).count() == 20_000
    assert t.action_plans.count() == plans.count()


def test_copy_takes_one_of_repeated_rows_always(spark):
    entity = "id string, code string, title string, import_baseline map<string,string>"
    one = lambda *rows: spark.createDataFrame(list(rows), entity)
    target = Tables.of(reports=one(("r1", "R1", "stays", None)), findings=one(), proposals=one(), action_plans=one(),
                       code_sequences=spark.createDataFrame([("finding", 2024, 5), ("finding", 2025, 9)], "entity_type string, year int, last_value bigint"))
    source = Tables.of(
        reports=one(("r1", "R1", "other", None), ("r2", "R2", "b", None), ("r2", "R2", "a", {"k": "v"}), ("r2", "R2", "b", None)),
        findings=one(("f1", "F1", "x", {"a": "1"})), proposals=one(), action_plans=one(),
        code_sequences=spark.createDataFrame([("finding", 2024, 7), ("finding", 2024, 8), ("finding", 2026, 1)], "entity_type string, year int, last_value bigint"),
        audit_history=spark.createDataFrame([("h1", "finding", "f1")], "id string, entity_type string, entity_id string"))
    for parts in (1, 4):  # however the rows lie
        out = T.copy_tables(target, source.with_(reports=source.reports.repartition(parts, "title")))
        assert sorted((r.id, r.title) for r in out.reports.collect()) == [("r1", "stays"), ("r2", "a")]
        assert [(r.id, r.import_baseline) for r in out.findings.collect()] == [("f1", {"a": "1"})]
        assert sorted((r.year, r.last_value) for r in out.code_sequences.collect()) == [(2024, 8), (2025, 9), (2026, 1)]
        assert [r.id for r in out.audit_history.collect()] == ["h1"]


def test_today_is_the_day_in_buenos_aires(spark):
    zone = zoneinfo.ZoneInfo("America/Buenos_Aires")
    before = datetime.datetime.now(zone).date()
    got = spark.range(1).select(session.as_cut(None)).first()[0]
    assert before <= got <= datetime.datetime.now(zone).date()
    instant = F.timestamp_seconds(F.lit(1_767_232_800))  # 2026-01-01 02:00 UTC, still the last day of 2025 there
    assert spark.range(1).select(session.day_of(instant)).first()[0] == datetime.date(2025, 12, 31)
    assert spark.range(1).select(session.as_cut("2026-02-03")).first()[0] == datetime.date(2026, 2, 3)
