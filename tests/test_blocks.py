"""Blocked operators against plain windows, with one key holding most of the rows."""

import random
import re

from pyspark.sql import functions as F

from rastro.functions import text as X
from rastro.functions.basic import UNTIDY_SPACE
from rastro.operators import blocks
from rastro.plans import corpus


def _rows(spark, n=3000):
    rnd = random.Random(5)
    data = [("hot" if rnd.random() < 0.7 else f"k{rnd.randrange(50)}", i, rnd.choice([None, f"v{i}"])) for i in range(n)]
    return data, spark.createDataFrame(data, "k string, i bigint, v string")


def test_running_matches_a_loop(spark):
    data, df = _rows(spark)
    got = {r["i"]: (r["last"], r["prev"], r["n"]) for r in blocks.running(df, ["k"], "i", {
        "last": ("last", F.col("v")), "prev": ("last<", F.col("v")), "n": ("sum", F.lit(1))}, span=100).collect()}
    state, want = {}, {}
    for k, i, v in data:
        last, n = state.get(k, (None, 0))
        want[i] = (v or last, last, n + 1)
        state[k] = (v or last, n + 1)
    assert got == want


def test_numbered_any_is_dense(spark):
    data, df = _rows(spark)
    got = blocks.numbered_any(df.withColumn("id", F.col("i").cast("string")), ["k"], "id", "n").groupBy("k").agg(
        F.count("*").alias("c"), F.count_distinct("n").alias("d"), F.min("n").alias("lo"), F.max("n").alias("hi")).collect()
    assert all(r["c"] == r["d"] == r["hi"] and r["lo"] == 1 for r in got)


def test_lines_are_dealt_by_ranges_once(spark, monkeypatch):
    written = []
    keep = blocks.settle
    monkeypatch.setattr(blocks, "settle", lambda df, purpose: written.append(purpose) or keep(df, purpose))
    lines = ["Hallazgo 1: pagos", "Riesgo: Alto", "Recomendación: firmar", "Hallazgo 2: saldos", "7. PROPUESTAS DE MEJORA", "1. Revisar (Hallazgo 2).", "y dejar constancia.", "2. Definir."]
    df = spark.createDataFrame([(d, i, x) for d in range(40) for i, x in enumerate(lines)], "doc_id bigint, line_no bigint, line string").repartition(5)
    got = {}
    for span in (16, None):
        sections = corpus.sectioned(df, span)
        found, items = corpus.explicit_findings(sections, corpus.line_headers(df), span), corpus.global_proposals(sections, span)
        got[span] = ([c for c in sections.columns if c != blocks.BLOCK], sorted(map(str, found.collect())), sorted(map(str, items.collect())))
    assert written == ["ranges"] and got[16] == got[None] and len(got[16][1]) == 80 and len(got[16][2]) == 80


def test_tidied_texts_match_the_plain_rule(spark):
    texts = [" a  b ", "a\tb", "á b", "a b", "　x ", "a\x1f\x1fb", "ab", "", "Área  1", "\x85"]
    rows = spark.createDataFrame([(x,) for x in texts], "t string").select("t", X.clean_text("t").alias("a"), X.tidied(F.col("t")).alias("b")).collect()
    plain = lambda x: re.sub(UNTIDY_SPACE, " ", x).strip(" ")
    assert [(r["a"], r["b"]) for r in rows] == [(plain(r["t"]),) * 2 for r in rows]


def test_rows_are_shuffled_once_by_bounds_from_a_sample(spark, monkeypatch):
    """The range of a row follows from its values, so no range shuffle is needed and written rows are not written again."""
    _, df = _rows(spark)
    held, written = blocks.settle(df.union(spark.createDataFrame([(None, 5000, "x"), (None, None, "y"), ("é\"", 5001, None)], df.schema)), "rows"), []
    monkeypatch.setattr(blocks, "settle", lambda df, purpose: written.append(purpose))
    spark.conf.set("spark.sql.shuffle.partitions", "50")
    try:
        parted = held.withColumn("b", blocks.range_of(held, ["k"], "i"))
        out = blocks.running(held, ["k"], "i", {"n": ("sum", F.lit(1))}, 100, written=True)
        plan = out._jdf.queryExecution().optimizedPlan().toString()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    ends = [r.asDict() for r in parted.groupBy("b").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("k", "i")).alias("lo"), F.max(F.struct("k", "i")).alias("hi")).orderBy("b").collect()]
    key = lambda x: (x["k"] is not None, x["k"] or "", x["i"] is not None, x["i"] or 0)
    assert len(ends) == 50 and max(e["n"] for e in ends) < 240 and all(key(a["hi"]) < key(b["lo"]) for a, b in zip(ends, ends[1:]))
    assert written == [] and "RepartitionByExpression" in plan and "rangepartitioning" not in out._jdf.queryExecution().toString()
    assert out.groupBy("k").agg((F.max("n") == F.count(F.lit(1))).alias("ok")).filter("not ok").count() == 0
