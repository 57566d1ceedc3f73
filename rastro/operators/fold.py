"""Folding ordered plan changes without collecting all changes of a plan in one place.

What a change does depends only on the plan's status and on whether its progress is 100: eight
situations. A change is therefore a small table "situation before -> result", and two tables in a row
combine into one of the same shape. Plans with at most ``fan`` changes are folded by one grouping, in
which the bare changes travel, and each plan walks through its own; the changes of a plan with more are ranked,
made tables, combined in blocks of ``fan``, then in blocks of blocks. No group ever holds more than ``fan``
elements, and both ways give the same.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rastro import schema as S
from rastro.functions.status import normalize_status
from rastro.operators.blocks import numbered
from rastro.session import settle

# Columns a change log may carry besides plan_id and change_no.
CHANGE_COLUMNS = {"status": "string", "progress_pct": "int", "notes": "string", "target_date": "string",
                  "evidence_file": "string", "action_owner": "string", "confirm_finalize": "boolean"}

_OPEN, _SUSPENDED, _PENDING, _DONE = range(4)
_PLAIN = ("target_date", "evidence_file", "action_owner")
_TYPE = "struct<entries:array<struct<s:int,p:int,pend:boolean,open:boolean>>,notes:string>"


def status_index(c) -> Column:
    n = normalize_status(c)
    out = F.lit(_OPEN)
    for i, name in enumerate(S.STATUSES):
        out = F.when(n == name, i).otherwise(out)
    return out


def situation(status, pct) -> Column:
    """1-based position of a plan's situation in a change table."""
    full = F.coalesce(F.col(pct) == 100, F.lit(False)).cast("int")
    return status_index(status) * 2 + full + 1


def _outcome(now: Column, full: Column, c: Column) -> Column:
    """What a change makes of a plan in status ``now`` whose progress is 100 or not."""
    asked = F.coalesce(c["asked"], now)
    reopened = c["asked"].isNotNull() & (asked == _OPEN) & (now.isin(_DONE, _PENDING) | full)
    pct = F.when(asked == _DONE, 100).when(reopened, 0).otherwise(c["pct"])
    at_100 = F.coalesce(pct == 100, full)
    closing = at_100 & (asked != _SUSPENDED)
    status = F.when(closing & c["confirmed"], _DONE).when(closing, _PENDING).otherwise(asked)
    return F.struct(status.alias("s"), pct.alias("p"), (closing & ~c["confirmed"]).alias("pend"),
                    (status != _DONE).alias("open"))


def bare_change() -> Column:
    """What a change (a row with ``CHANGE_COLUMNS``) asks for."""
    asked = F.when(F.col("status").isNotNull(), status_index("status"))
    pct = F.greatest(F.lit(0), F.least(F.lit(100), F.col("progress_pct"))).cast("int")
    return F.struct(asked.alias("asked"), F.when(F.col("progress_pct").isNotNull(), pct).alias("pct"),
                    F.coalesce("confirm_finalize", F.lit(False)).alias("confirmed"), F.col("notes").cast("string").alias("notes"))


def _bare(changes: DataFrame) -> DataFrame:
    """plan_id, change_no and what a change asks for."""
    return changes.select("plan_id", "change_no", bare_change().alias("bare"), *_PLAIN)


def _table(c: Column) -> Column:
    entries = F.array(*[_outcome(F.lit(now), F.lit(full), c) for now in range(4) for full in (False, True)])
    return F.struct(entries.alias("entries"), c["notes"].alias("notes")).cast(_TYPE)


def _then(a: Column, b: Column) -> Column:
    def step(e, i):
        full = F.coalesce(e["p"] == 100, (i % 2) == 1).cast("int")
        nxt = F.element_at(b["entries"], e["s"] * 2 + full + 1)
        return F.struct(
            nxt["s"].alias("s"), F.coalesce(nxt["p"], e["p"]).alias("p"),
            F.when(b["notes"].isNotNull(), nxt["pend"]).otherwise(e["pend"] | nxt["pend"]).alias("pend"),
            (e["open"] | nxt["open"]).alias("open"))
    return F.struct(F.transform(a["entries"], step).alias("entries"), F.coalesce(b["notes"], a["notes"]).alias("notes"))


def _combined(ordered: Column, table=lambda x: x["change"]) -> Column:
    changes = F.transform(F.array_sort(ordered), table)
    return F.aggregate(F.slice(changes, F.lit(2), F.size(changes)), changes[0], _then)


def _plain(order: str) -> list[Column]:
    return [F.max_by(c, F.when(F.col(c).isNotNull(), F.col(order))).alias(f"new_{c}") for c in _PLAIN]


_STATE = "struct<s:int,p:int,pend:boolean,open:boolean,notes:string>"


def _step(acc: Column, c: Column) -> Column:
    """A plan's state after one more change."""
    n = _outcome(acc["s"], F.coalesce(acc["p"] == 100, F.lit(False)), c)
    return F.struct(n["s"].alias("s"), F.coalesce(n["p"], acc["p"]).alias("p"), F.when(c["notes"].isNotNull(), n["pend"]).otherwise(acc["pend"] | n["pend"]).alias("pend"),
                    (acc["open"] | n["open"]).alias("open"), F.coalesce(c["notes"], acc["notes"]).alias("notes")).cast(_STATE)


def _walked(few: DataFrame, plans: DataFrame) -> DataFrame:
    """Plans with at most ``fan`` changes: each plan's own state goes through its changes; a single change needs no loop."""
    grouped = few.groupBy("plan_id").agg(F.collect_list(F.struct(F.col("change_no").alias("k"), "bare")).alias("all"), *_plain("change_no"))
    rows = plans.join(grouped.withColumnRenamed("plan_id", "id"), "id", "left")
    # Attributes, not expressions: the outcome names them many times.
    rows = rows.withColumns({"__now": status_index("status"), "__one": F.col("all")[0]["bare"], "__some": F.size("all")})
    start = F.struct(F.col("__now").alias("s"), F.col("progress_pct").cast("int").alias("p"), F.lit(False).alias("pend"), F.lit(False).alias("open"), F.lit(None).cast("string").alias("notes")).cast(_STATE)
    loop = F.aggregate(F.transform(F.array_sort("all"), lambda x: x["bare"]), start, _step)
    state = F.when(F.col("__some") == 1, _step(start, F.col("__one"))).when(F.col("__some") > 1, loop)
    return rows.withColumn("__r", state).withColumn("change", F.when(F.col("all").isNotNull(), F.struct(F.col("__r.notes").alias("notes")))).drop("all", "__now", "__one", "__some")


def fold_into(plans: DataFrame, changes: DataFrame, fan: int = 1000, levels: int = 3) -> DataFrame:
    """Every plan with ``change`` (null without one; its last notes), the outcome ``__r`` and the last value given for the plain fields.

    ``change_no`` orders the changes and is unique within a plan; ``levels`` blocks of blocks do for
    ``fan ** (levels + 1)`` changes of one plan.
    """
    bare = _bare(changes)
    busy = changes.groupBy("plan_id").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > fan).select("plan_id")
    if busy.isEmpty():
        return _walked(bare, plans)
    busy = settle(busy, "busy-plans")
    many = bare.join(busy, "plan_id", "left_semi")
    level = numbered(many, ["plan_id"], "change_no", "at", fan).select("plan_id", "at", _table(F.col("bare")).alias("change"))
    for _ in range(levels):
        level = (level.groupBy("plan_id", F.floor(F.col("at") / fan).alias("at"))
                 .agg(_combined(F.collect_list(F.struct(F.col("at").alias("k"), "change"))).alias("change")))
    table = level.groupBy("plan_id").agg(_combined(F.collect_list(F.struct(F.col("at").alias("k"), "change"))).alias("folded"))
    folded = table.join(many.groupBy("plan_id").agg(*_plain("change_no")), "plan_id").withColumnRenamed("plan_id", "id")
    ids = busy.withColumnRenamed("plan_id", "id")
    rest = _walked(bare.join(busy, "plan_id", "left_anti"), plans.join(ids, "id", "left_anti"))
    result = F.element_at(F.col("folded.entries"), situation("status", "progress_pct"))
    own = plans.join(folded, "id").withColumn("e", result).withColumn("change", F.struct(F.col("folded.notes").alias("notes")))
    own = own.withColumn("__r", F.struct(F.col("e.s"), F.coalesce("e.p", F.col("progress_pct").cast("int")).alias("p"), F.col("e.pend"), F.col("e.open"), F.col("folded.notes").alias("notes")).cast(_STATE))
    return rest.unionByName(own.select(*rest.columns))
