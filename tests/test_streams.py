"""Streams and the tables they feed: any split and order of a log, restarts, replays, deletions, bounded reads."""

import datetime
import itertools
import random

import pytest
from pyspark.sql import functions as F

from rastro import schema as S
from rastro.plans import lifecycle
from rastro.schema import Tables
from rastro.session import tune
from rastro.streaming import jobs, planstate, state

CUT = datetime.date(2026, 10, 2)
LOG = "plan_id string, change_no bigint, status string, progress_pct int, notes string, target_date string, confirm_finalize boolean, gone boolean, at timestamp"


def empty(spark, name):
    return spark.createDataFrame([], ", ".join(f"{c} {t}" for c, t in S.SCHEMAS[name].items()))


def tables(spark, plans=40):
    r = spark.createDataFrame([("r1", "AUD-2026-001"), ("r2", "AUD-2026-002")], "id string, code string")
    f = spark.createDataFrame([(f"f{i}", f"r{i % 2 + 1}", "En proceso") for i in range(4)], "id string, report_id string, status string")
    p = spark.createDataFrame([(f"p{i}", f"f{i % 4}", "En proceso" if i % 5 else "En suspensión", "Ana") for i in range(10)], "id string, finding_id string, status string, validated_by string")
    words = ["En proceso", "En suspensión", "Pendiente de validación", "Finalizado", "cerrado"]
    a = spark.createDataFrame([(f"a{i}", f"p{i % 10}", words[i % 5], (0, 40, 100, None)[i % 4], ("", None, "nota")[i % 3], "Luis") for i in range(plans)],
                              "id string, proposal_id string, status string, progress_pct int, notes string, validated_by string")
    return Tables.of(reports=r, findings=f, proposals=p, action_plans=a, audit_history=empty(spark, "audit_history"))


def changes(rng, n, plans=40):
    made = []
    for no in range(n):
        made.append((f"a{rng.randrange(plans) if rng.random() < .7 else 3}", no * 7 - 50, rng.choice([None, None, "Finalizado", "En proceso", "stand-by"]), rng.choice([None, 100, 30, 250, -5]),
                     rng.choice([None, None, None, f"n{no}", ""]), rng.choice([None, None, "15/03/2026"]), rng.random() < .5, None, None))
    return made


def rows(df, cols):
    return sorted(tuple(str(x) for x in r) for r in df.select(*cols).collect())


def follow(spark, root, log, checkpoint, **more):
    jobs.follow_plan_changes(spark.readStream.schema(LOG).parquet(str(log)), str(root), str(checkpoint), F.lit(CUT), **more).awaitTermination()


def same(spark, root, want):
    got = state.read_state(spark, str(root))
    assert rows(got.action_plans, list(planstate.BASE) + ["id", "proposal_id"]) == rows(want.action_plans, list(planstate.BASE) + ["id", "proposal_id"])
    for name in ("proposals", "findings"):
        assert rows(getattr(got, name), ["id", "status"]) == rows(getattr(want, name), ["id", "status"])
    return got


def test_any_split_and_order_of_a_log_and_restarts(spark, tmp_path):
    tune(spark)
    rng = random.Random(1)
    t, log = tables(spark), changes(rng, 400)
    want = lifecycle.apply_plan_changes(t, spark.createDataFrame(log, LOG), F.lit(CUT)).tables
    state.start_state(t, str(tmp_path / "root"), buckets=4)
    rng.shuffle(log)
    for part in (log[:50], log[50:300], log[300:] + log[:20]):  # the last brings some again
        spark.createDataFrame(part, LOG).repartition(2).write.mode("append").parquet(str(tmp_path / "log"))
        follow(spark, tmp_path / "root", tmp_path / "log", tmp_path / "checkpoint")  # a new query each time, from the checkpoint
    got = same(spark, tmp_path / "root", want)
    assert got.audit_history.count() > 0


def test_removed_plans_and_plans_made_later(spark, tmp_path):
    tune(spark)
    t = tables(spark, 3)
    state.start_state(t, str(tmp_path / "root"))
    row = lambda p, n, status, pct=None, gone=None: (p, n, status, pct, None, None, True, gone, None)
    spark.createDataFrame([row("a0", 1, "Finalizado"), row("a1", 2, None, None, True), row("a9", 5, None, 30)], LOG).write.parquet(str(tmp_path / "log"))
    new = spark.createDataFrame([("a9", "p9", "En proceso", 10)], "id string, proposal_id string, status string, progress_pct int")
    new.limit(0).write.parquet(str(tmp_path / "new"))
    again = lambda: follow(spark, tmp_path / "root", tmp_path / "log", tmp_path / "checkpoint", created=spark.readStream.schema(new.schema).parquet(str(tmp_path / "new")))
    again()
    got = {r["id"]: r["progress_pct"] for r in state.read_state(spark, str(tmp_path / "root")).action_plans.collect()}
    assert got == {"a0": 100, "a2": 100}
    # The new plan reaches the tables by another job, and the stream by its announcement; its first change waited.
    state.commit(spark, str(tmp_path / "root"), {"action_plans": new}, "other", 0)
    new.write.mode("append").parquet(str(tmp_path / "new"))
    spark.createDataFrame([row("a1", 3, "En proceso"), row("a0", 4, "En proceso")], LOG).write.mode("append").parquet(str(tmp_path / "log"))
    again()
    got = {r["id"]: (r["status"], r["progress_pct"]) for r in state.read_state(spark, str(tmp_path / "root")).action_plans.collect()}
    assert got == {"a0": ("En proceso", 0), "a2": ("Pendiente de validación", 100), "a9": ("En proceso", 30)}


def test_late_changes_behind_the_watermark(spark, tmp_path):
    tune(spark)
    t = tables(spark, 2)
    state.start_state(t, str(tmp_path / "root"))
    at = lambda minute: datetime.datetime(2026, 1, 1, 0, minute)
    for batch in ([("a1", 10, 50, 0), ("a1", 12, 60, 1)], [("a0", 1, 10, 40)], [("a0", 2, 20, 41)], [("a1", 11, 70, 50), ("a1", 13, 80, 50)]):
        spark.createDataFrame([(p, n, None, pct, None, None, False, None, at(m)) for p, n, pct, m in batch], LOG).write.mode("append").parquet(str(tmp_path / "log"))
        follow(spark, tmp_path / "root", tmp_path / "log", tmp_path / "checkpoint", at="at", lateness="5 minutes")
    got = {r["id"]: r["progress_pct"] for r in state.read_state(spark, str(tmp_path / "root")).action_plans.collect()}
    assert got == {"a0": 20, "a1": 80}  # number 11 came after 12 was sealed


class Memory:
    """The state of one key, in this process."""

    def __init__(self):
        self.values, self.map, self.timers = {}, {}, []

    def getValueState(self, *_):
        return self

    getMapState = getValueState

    def get(self):
        return self.values.get("v")

    def update(self, v):
        self.values["v"] = v

    def getValue(self, key):
        return self.map[key]

    def updateValue(self, key, v):
        self.map[key] = v

    def removeKey(self, key):
        del self.map[key]

    def listTimers(self):
        return iter(self.timers)

    def deleteTimer(self, t):
        self.timers.remove(t)

    def registerTimer(self, t):
        self.timers.append(t)


def _walk(start, log):
    """Outcomes of changes one after another, from (status, progress)."""
    status, pct, pending, was_open, notes = *start, 0, 0, None
    for _, (entries, given) in sorted(log.items()):
        e = entries[status * 2 + (pct == 100)]
        status, new = e & 3, (e >> 2) & 127
        pct = new - 1 if new else pct
        pending = (e >> 9 & 1) if given is not None else pending | (e >> 9 & 1)
        was_open |= e >> 10 & 1
        notes = given if given is not None else notes
    return status, pct, pending, was_open, notes


def test_blocks_of_changes_stay_small_and_in_order(monkeypatch):
    monkeypatch.setattr(planstate.PlanState, "BLOCK", 4)
    monkeypatch.setattr(planstate.PlanState, "FEW", 3)
    rng = random.Random(7)
    numbers = list(range(-60, 90))
    rng.shuffle(numbers)
    log, memory = {}, Memory()
    for first in range(0, len(numbers), 11):
        processor = planstate.PlanState(True)  # a restart each time
        processor.init(memory)
        batch = []
        for no in numbers[first:first + 11]:
            asked = {"asked": rng.choice([None, 0, 1, 2, 3]), "pct": rng.choice([None, 0, 40, 100]), "confirmed": rng.random() < .5}
            log[no] = planstate.outcomes(**asked), rng.choice([None, None, f"n{no}"])
            batch.append({"kind": "change", "change_no": no, **asked, "notes": log[no][1], "target_date": None, "evidence_file": None, "action_owner": None, "at": None})
        (out,) = processor.handleInputRows(("a",), iter(batch), None)
        for s, full in itertools.product(range(4), (False, True)):
            e = out["entries"][s * 2 + full]
            want = _walk((s, 100 if full else 7), log)
            pct = ((e >> 2) & 127) - 1
            assert (e & 3, pct if pct >= 0 else (100 if full else 7), e >> 9 & 1, e >> 10 & 1, out["new_notes"]) == want
        assert all(len(planstate.json.loads(body[0])) < 8 for body in memory.map.values())
    processor.handleExpiredTimer(("a",), None, None)
    assert memory.map == {}
    (late,) = processor.handleInputRows(("a",), iter([batch[0]]), None)
    assert late["late"] == [batch[0]["change_no"]] and list(late["entries"]) == list(out["entries"])


def test_reads_do_not_grow_with_the_steps(spark, tmp_path):
    tune(spark)
    root = str(tmp_path / "root")
    t = tables(spark)
    state.start_state(t, root, buckets=2)
    want = {r["id"]: r["progress_pct"] for r in t.action_plans.collect()}
    rng = random.Random(3)
    for step in range(9):
        picked = rng.sample(sorted(want), 3)
        want |= {i: step for i in picked}
        gone = f"a{step}"
        want.pop(gone, None)
        change = spark.createDataFrame([(i, i == gone, step) for i in {*picked, gone}], "id string, gone boolean, progress_pct int")
        assert state.commit(spark, root, {"action_plans": change}, "job", step)
        assert not state.commit(spark, root, {"action_plans": change.withColumn("progress_pct", F.lit(-1))}, "job", step)  # a replay
        now = state.listing(spark, root)
        assert max(len(p) for own in now.parts.values() for p in own.values()) <= state.MOST_PARTS
        assert {r["id"]: r["progress_pct"] for r in state.read_state(spark, root).action_plans.collect()} == want
    kept = [p.name for p in (tmp_path / "root" / "tables" / "action_plans").iterdir() if p.is_dir()]
    assert len(kept) <= 2 * (state.MOST_PARTS + state.KEPT) and len(list((tmp_path / "root" / "steps").iterdir())) <= state.KEPT
    assert state.read_state(spark, root).findings.count() == 4


def test_an_unfinished_step_is_not_seen(spark, tmp_path):
    tune(spark)
    root = str(tmp_path / "root")
    state.start_state(tables(spark), root, buckets=2)
    row = spark.createDataFrame([("a1", 77)], "id string, progress_pct int")
    # A step that broke down before its list: data, no list.
    S.conform(row, S.ACTION_PLANS).selectExpr(*S.ACTION_PLANS, "false AS gone", "0 AS bucket").write.partitionBy("bucket").parquet(f"{root}/tables/action_plans/step=2")
    assert state.read_state(spark, root).action_plans.filter("progress_pct = 77").isEmpty()
    state.commit(spark, root, {"action_plans": row.withColumn("progress_pct", F.lit(78))}, "job", 0)
    found = state.read_state(spark, root).action_plans
    assert found.filter("id = 'a1'").first()["progress_pct"] == 78 and found.count() == 40


def test_deletions_hold_after_replay_and_restart(spark, tmp_path):
    tune(spark)
    root, asked = str(tmp_path / "root"), str(tmp_path / "asked")
    t = tables(spark)
    state.start_state(t, root)
    want = lifecycle.delete_findings(lifecycle.delete_reports(t, spark.createDataFrame([("r1",)], "id string")), spark.createDataFrame([("f1",)], "id string"))
    schema = "entity_type string, id string"
    run = lambda checkpoint: jobs.follow_deletions(spark.readStream.schema(schema).parquet(asked), root, str(tmp_path / checkpoint)).awaitTermination()
    spark.createDataFrame([("report", "r1")], schema).write.parquet(asked)
    run("one")
    spark.createDataFrame([("finding", "f1"), ("report", "r1"), ("finding", "none")], schema).write.mode("append").parquet(asked)
    run("one")
    run("two")  # the whole stream again, as another query
    got = state.read_state(spark, root)
    for name in ("reports", "findings", "proposals", "action_plans"):
        assert rows(getattr(got, name), ["id"]) == rows(getattr(want, name), ["id"])
    # Changes of a deleted plan don't bring it back.
    spark.createDataFrame([("a1", 1, None, 55, None, None, False, None, None)], LOG).write.parquet(str(tmp_path / "log"))
    follow(spark, root, tmp_path / "log", tmp_path / "three")
    assert rows(state.read_state(spark, root).action_plans, ["id"]) == rows(want.action_plans, ["id"])


def test_a_micro_batch_needs_its_query(spark, tmp_path):
    with pytest.raises(RuntimeError):
        jobs._apply(spark, str(tmp_path), 0, lambda t: {})


class GroupMemory(Memory):
    """The state of a group of plans, in this process; counts the calls to the list of plans."""

    def __init__(self):
        super().__init__()
        self.rows, self.calls = [], 0

    def getListState(self, *_):
        return GroupMemory.List(self)

    class List:
        def __init__(self, memory):
            self.memory = memory

        def get(self):
            self.memory.calls += 1
            return iter(list(self.memory.rows))

        def put(self, rows):
            self.memory.calls += 1
            self.memory.rows = list(rows)


def test_a_group_of_plans_costs_two_calls_and_seals_each_plan_at_its_own_time():
    memory = GroupMemory()

    def group():
        out = planstate.PlanGroup(True)  # a restart each time
        out.init(memory)
        return out

    def feed(*some):
        rows = [{"plan_id": p, "kind": "change", "change_no": n, "asked": None, "pct": pct, "confirmed": False, "notes": None, "target_date": None, "evidence_file": None,
                 "action_owner": None, "at": datetime.datetime.fromtimestamp(at)} for p, n, pct, at in some]
        return {r["id"]: r for r in group().handleInputRows((0,), iter(rows), None)}

    base = {c: None for c in planstate.BASE}
    group().handleInitialState((0,), {"plans": [{"plan_id": f"a{i}", **base, "status": "En proceso", "progress_pct": 0} for i in range(300)]}, None)
    assert memory.calls == 2 and len(memory.rows) == 300
    out = feed(*[(f"a{i}", n, 10 * n, 100 if i else 900) for i in range(300) for n in (5, 3)])
    assert memory.calls == 4 and len(out) == 300 and all(r["known"] and (r["entries"][0] >> 2 & 127) - 1 == 50 for r in out.values())
    assert sorted(set(memory.timers)) == [100_000, 900_000]

    class Expired:
        def getExpiryTimeInMs(self):
            return 100_000
    assert list(group().handleExpiredTimer((0,), None, Expired())) == []
    out = feed(("a0", 4, 70, 901), ("a1", 4, 70, 901))
    assert out["a0"]["late"] == [] and out["a1"]["late"] == [4]  # a0 is not sealed before its own time
    assert set(out) == {"a0", "a1"} and len(memory.rows) == 300
