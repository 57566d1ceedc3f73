"""Plan states as a keyed stateful stream.

The state of a plan is what it was at first, and its changes in the order of their numbers, whatever the order in which they
arrived. A change is a table of eight outcomes (``operators.fold``); changes lie in blocks of bounded size, each block has its
changes composed into one table, and only a block that gets a new change is composed again. With a watermark, a
timer seals what lies behind it: the blocks become one table and the single changes are forgotten.
"""

from __future__ import annotations

import json
from bisect import bisect_right
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from rastro import schema as S
from rastro.operators.fold import CHANGE_COLUMNS, bare_change
from rastro.session import ship

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"

#: Columns of a plan that changes read or write; the rest of its row stays in the tables.
BASE = {"status": "string", "progress_pct": "int", "notes": "string", "target_date": "string", "evidence_file": "string", "action_owner": "string",
        "closed_date": "string", "validated_at": "string", "validated_by": "string"}
_GIVEN = ("notes", "target_date", "evidence_file", "action_owner")
_OUT = ", ".join(["id string", "known boolean", "removed boolean", "late array<bigint>", *(f"{c} {t}" for c, t in BASE.items()), "entries array<int>", *(f"new_{c} string" for c in _GIVEN)])

#: Plans per group that a stream begins with, and the groups that it has at least.
GROUP, LEAST_GROUPS = 256, 256

# Places of the statuses in schema.STATUSES.
_OPEN, _SUSPENDED, _PENDING, _DONE = range(4)


def outcomes(asked: int | None, pct: int | None, confirmed: bool) -> list[int]:
    """What a change makes of each of the eight situations, as ``operators.fold`` says, an integer each: 2 bits of status,
    7 of progress (+1, 0 for unchanged), pending, open."""
    out = []
    for now in range(4):
        for full in (False, True):
            status = now if asked is None else asked
            reopened = asked == _OPEN and (now in (_DONE, _PENDING) or full)
            p = 100 if status == _DONE else 0 if reopened else pct
            closing = (full if p is None else p == 100) and status != _SUSPENDED
            if closing:
                status = _DONE if confirmed else _PENDING
            out.append(status | (0 if p is None else p + 1) << 2 | (closing and not confirmed) << 9 | (status != _DONE) << 10)
    return out


def composed(a: list, b: list) -> list:
    """One change table after another: [eight outcomes, notes, target_date, evidence_file, action_owner]."""
    entries = []
    for i, e in enumerate(a[0]):
        pct = (e >> 2) & 127
        full = pct == 101 if pct else i % 2 == 1
        n = b[0][(e & 3) * 2 + full]
        pending = n >> 9 & 1 if b[1] is not None else (e | n) >> 9 & 1
        entries.append(n & 3 | (((n >> 2) & 127) or pct) << 2 | pending << 9 | ((e | n) >> 10 & 1) << 10)
    return [entries, *(y if y is not None else x for x, y in zip(a[1:], b[1:]))]


def _all(tables: list[list]) -> list | None:
    out = None
    for t in tables:
        out = t if out is None else composed(out, t)
    return out


class PlanState(StatefulProcessor):
    """Value state: the plan's first row, its sealed changes, and per block its first number, its composed table, and the changes of a
    first block of a few. Map state: the changes of all other blocks."""

    BLOCK, FEW = 128, 16

    def __init__(self, timed: bool):
        self.timed = timed

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.plan = handle.getValueState("plan", "body string")
        self.changes = handle.getMapState("changes", "block bigint", "body string")

    def _read(self) -> dict:
        found = self.plan.get()
        return json.loads(found[0]) if found else self._fresh()

    @staticmethod
    def _fresh() -> dict:
        return {"base": None, "removed": False, "sealed": None, "upto": None, "blocks": []}

    def _changes(self, block: list) -> dict:
        """The changes of a block by number."""
        body = block[2] if block[2] is not None else json.loads(self.changes.getValue((block[0],))[0])
        return {int(k): v for k, v in body.items()}

    def _forget(self, blocks: list) -> None:
        for first, _, own in blocks:
            if own is None:
                self.changes.removeKey((first,))

    def handleInitialState(self, key, initialState, timerValues) -> None:
        self.plan.update((json.dumps(self._fresh() | {"base": [initialState[c] for c in BASE]}),))  # the first a key's state gets

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        state, late, latest = self._read(), [], None
        open_blocks: dict[int, dict] = {}
        for r in rows:
            if r["kind"] == "plan":
                state["base"] = [r[f"base_{c}"] for c in BASE]
            elif r["kind"] == "remove":
                state["removed"] = True
            elif state["upto"] is not None and r["change_no"] <= state["upto"]:
                late.append(r["change_no"])
            else:
                self._keep(state["blocks"], open_blocks, r["change_no"], [outcomes(r["asked"], r["pct"], r["confirmed"]), *(r[c] for c in _GIVEN)])
            if self.timed and r["at"] is not None:
                at = int(r["at"].timestamp() * 1000)
                latest = at if latest is None else max(latest, at)
        self._store(state["blocks"], open_blocks)
        if state["removed"]:
            self._forget(state["blocks"])
            state |= {"base": None, "sealed": None, "blocks": []}
        if latest is not None and state["blocks"]:
            for t in list(self.handle.listTimers()):
                self.handle.deleteTimer(t)
            self.handle.registerTimer(latest)
        self.plan.update((json.dumps(state),))
        yield self._told(key, state, late)

    def _keep(self, blocks: list, open_blocks: dict, no: int, change: list) -> None:
        """Put a change into the block whose numbers it belongs to; a block of twice the size is halved."""
        at = max(bisect_right([b[0] for b in blocks], no) - 1, 0)
        if not blocks:
            blocks.append([no, None, {}])
            open_blocks[no] = {}
        first = blocks[at][0]
        if first not in open_blocks:
            open_blocks[first] = self._changes(blocks[at])
        block = open_blocks[first]
        block[no] = change
        if len(block) >= 2 * self.BLOCK:
            order = sorted(block)
            upper = {k: block.pop(k) for k in order[self.BLOCK:]}
            blocks.insert(at + 1, [order[self.BLOCK], None, None])
            open_blocks[order[self.BLOCK]] = upper

    def _store(self, blocks: list, open_blocks: dict) -> None:
        for b in blocks:
            if b[0] in open_blocks:
                block = open_blocks[b[0]]
                b[1] = _all([block[k] for k in sorted(block)])
                b[2] = block if b[2] is not None and len(block) <= self.FEW else None
                if b[2] is None:
                    self.changes.updateValue((b[0],), (json.dumps(block),))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        """All changes so far lie behind the watermark: keep what they come to, and the last number."""
        state = self._read()
        if state["blocks"]:
            state["upto"] = max(self._changes(state["blocks"][-1]))
            state["sealed"] = _all([t for t in [state["sealed"], *(b[1] for b in state["blocks"])] if t])
            self._forget(state["blocks"])
            state["blocks"] = []
            self.plan.update((json.dumps(state),))
        return iter(())

    def _told(self, key, state: dict, late: list[int]) -> Row:
        table = _all([t for t in [state["sealed"], *(b[1] for b in state["blocks"])] if t]) or [None] * 5
        base = state["base"] or [None] * len(BASE)
        names = ["id", "known", "removed", "late", *BASE, "entries", *(f"new_{c}" for c in _GIVEN)]
        return Row(**dict(zip(names, [key[0], state["base"] is not None, state["removed"], late, *base, *table])))

    def close(self) -> None:
        pass


class _OfPlan:
    """One plan's part of a group's state, in the shape that ``PlanState`` asks a handle for."""

    def __init__(self, group: PlanGroup, plan_id: str | None):
        self.group, self.plan_id = group, plan_id

    def getValueState(self, *_):
        return self

    getMapState = getValueState

    def get(self):
        return self.group.held.get(self.plan_id, (None,))[:1] if self.plan_id in self.group.held else None

    def update(self, value):
        self.group.held[self.plan_id] = [value[0], self.group.held.get(self.plan_id, (None, None))[1]]

    def getValue(self, key):
        return self.group.changes.getValue((self.plan_id, *key))

    def updateValue(self, key, value):
        self.group.changes.updateValue((self.plan_id, *key), value)

    def removeKey(self, key):
        self.group.changes.removeKey((self.plan_id, *key))

    def listTimers(self):
        return iter(())

    def registerTimer(self, at):
        """The plan's latest timer counts; the group's earlier ones find nothing due."""
        self.group.due[self.plan_id] = at
        self.group.handle.registerTimer(at)


class PlanGroup(StatefulProcessor):
    """Some hundreds of plans under one key: every call to the store costs about as much as the work on a plan, and one call
    reads or writes the plans of a group. List state: each plan's state and timer. Map state: the changes of busy plans by block."""

    def __init__(self, timed: bool):
        self.timed = timed

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.plans = handle.getListState("plans", "plan_id string, body string, due bigint")
        self.changes = handle.getMapState("changes", "plan_id string, block bigint", "body string")

    def _open(self) -> None:
        self.held = {plan_id: [body, due] for plan_id, body, due in self.plans.get()}
        self.due = {}

    def _close(self) -> None:
        for plan_id, at in self.due.items():
            self.held[plan_id][1] = at
        self.plans.put([(plan_id, *state) for plan_id, state in self.held.items()])

    def _plan(self, plan_id) -> PlanState:
        plan = PlanState(self.timed)
        plan.init(_OfPlan(self, plan_id))
        return plan

    def handleInitialState(self, key, initialState, timerValues) -> None:
        self._open()
        for row in initialState["plans"]:
            self._plan(row["plan_id"]).handleInitialState((row["plan_id"],), row, timerValues)
        self._close()

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        own: dict = {}
        for r in rows:
            own.setdefault(r["plan_id"], []).append(r)
        if not own:
            return iter(())
        self._open()
        told = [out for plan_id, some in own.items() for out in self._plan(plan_id).handleInputRows((plan_id,), iter(some), timerValues)]
        self._close()
        return iter(told)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        self._open()
        now = expiredTimerInfo.getExpiryTimeInMs()
        for plan_id, state in list(self.held.items()):
            if state[1] is not None and state[1] <= now:
                for _ in self._plan(plan_id).handleExpiredTimer((plan_id,), timerValues, expiredTimerInfo):
                    pass
                self.held[plan_id][1] = None
        self._close()
        return iter(())

    def close(self) -> None:
        pass


def groups_for(plans: int) -> int:
    """Groups of a new stream; their number stays with its checkpoint."""
    return max(LEAST_GROUPS, plans // GROUP)


def _events(changes: DataFrame, created: DataFrame | None, at: str | None) -> DataFrame:
    """One shape for changes, removals (``gone``) and announced plans."""
    none = {f"base_{c}": F.lit(None).cast(t) for c, t in BASE.items()}
    time = F.col(at).cast("timestamp") if at else F.lit(None).cast("timestamp")
    rows = S.conform(changes, {**CHANGE_COLUMNS, "gone": "boolean"}).withColumn("bare", bare_change())
    kind = F.when(F.col("gone"), "remove").otherwise("change")
    out = rows.select("plan_id", kind.alias("kind"), F.col("change_no").cast("bigint").alias("change_no"), time.alias("at"), "bare.asked", "bare.pct", "bare.confirmed",
                      *[F.col(c).cast("string").alias(c) for c in _GIVEN], *[c.alias(n) for n, c in none.items()])
    if created is not None:
        new = S.conform(created, S.ACTION_PLANS).select(F.col("id").alias("plan_id"), F.lit("plan").alias("kind"), F.lit(None).cast("bigint").alias("change_no"),
                                                        F.lit(None).cast("timestamp").alias("at"), *[F.lit(None).cast(t).alias(c) for c, t in (("asked", "int"), ("pct", "int"), ("confirmed", "boolean"))],
                                                        *[F.lit(None).cast("string").alias(c) for c in _GIVEN], *[F.col(c).cast(t).alias(f"base_{c}") for c, t in BASE.items()])
        out = out.unionByName(new)
    return out.filter(F.col("plan_id").isNotNull() & ((F.col("kind") != "change") | F.col("change_no").isNotNull()))


def plan_states(changes: DataFrame, plans: DataFrame, created: DataFrame | None = None, at: str | None = None, lateness: str | None = None,
                groups: int = LEAST_GROUPS) -> DataFrame:
    """A streaming change log (plan_id, change_no, ``CHANGE_COLUMNS``, gone) as a stream of plan states, in update mode.

    ``plans`` are the rows before the first change; they enter the state with the first batch of a checkpoint. ``created`` is a stream
    of rows of later plans; changes of a plan that is not known yet wait in the state (``known`` is false). A change whose
    number came before replaces the earlier one. ``gone`` removes a plan for good.

    With ``at`` (a time column) and ``lateness``, changes behind the watermark are sealed and a number at or below a plan's last
    sealed one is given back in ``late`` and changes nothing; without them every order of arrival gives the same states.
    The state is kept by ``groups`` of plans, always the same number for a checkpoint (``groups_for``).

    Out: id, known, removed, late, the plan's columns at first, and its changes as ``entries``, ``new_notes`` and so on.
    """
    spark = changes.sparkSession
    ship(spark)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)
    events = _events(changes, created, at if lateness else None)
    if lateness:
        events = events.withWatermark("at", lateness)
    first = plans.select(F.col("id").alias("plan_id"), *[F.col(c).cast(t).alias(c) for c, t in BASE.items()])
    group = F.pmod(F.xxhash64("plan_id"), F.lit(groups)).alias("group")
    first = first.groupBy(group).agg(F.collect_list(F.struct(*first.columns)).alias("plans")).groupBy("group")
    return events.withColumn("group", group).groupBy("group").transformWithState(PlanGroup(bool(lateness)), _OUT, "Update", "EventTime" if lateness else "None", first)


def as_change(entries: Column, notes: Column) -> Column:
    """The packed outcomes as ``operators.fold`` has them."""
    bit = lambda e, at: F.shiftright(e, at).bitwiseAND(1) == 1
    pct = lambda e: F.nullif(F.shiftright(e, 2).bitwiseAND(127), F.lit(0)) - 1
    outcomes = F.transform(entries, lambda e: F.struct(e.bitwiseAND(3).alias("s"), pct(e).alias("p"), bit(e, 9).alias("pend"), bit(e, 10).alias("open")))
    return F.struct(outcomes.alias("entries"), notes.alias("notes"))
