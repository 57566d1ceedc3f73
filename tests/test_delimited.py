"""Delimited files: quotes over lines, unclosed and trailing quotes, very long cells, the delimiter by the whole file."""

import csv
import io

from rastro.operators.sequences import assign_codes
from rastro.sources import delimited


def _cells(spark, text):
    rows = delimited.sheet_cells(spark.createDataFrame([("f", text)], "file string, text string")).collect()
    out = {}
    for r in sorted(rows, key=lambda r: (r.row_no, r.col_no)):
        out.setdefault(r.row_no, []).append(r.value)
    return [out[k] for k in sorted(out)]


def test_quotes_over_lines_and_doubled(spark):
    text = '1;"línea uno\nlínea dos";x\r\n2;"a;b ""c""";"y;z"\n3;plain;"last"'
    assert _cells(spark, text) == list(csv.reader(io.StringIO(text, newline=""), delimiter=";"))


def test_unclosed_and_trailing_quotes(spark):
    assert _cells(spark, 'a;b\n"abc" def;5" pipe\nx;"abc;y\nz;w') == [["a", "b"], ["abc def", '5" pipe'], ["x", '"abc', "y"], ["z", "w"]]


def test_cells_of_a_megabyte(spark):
    long, doubled = "x" * 1_000_000, '""' * 200_000
    text = f'a;"{long}\n{long}";b\nc;"{doubled}";d;{long}\n'
    assert _cells(spark, text) == [["a", f"{long}\n{long}", "b"], ["c", '"' * 200_000, "d", long]]


def test_delimiter_is_chosen_by_the_whole_file(spark):
    text = "a,b\n" * 6 + "c;d;e;f\n" * 20
    assert _cells(spark, text)[-1] == ["c", "d", "e", "f"]
    raw = "\n".join(["one\ttwo"] * 600) + "\nthree"
    lines = delimited.piped_lines(spark.createDataFrame([("f", raw)], "file string, text string")).collect()
    assert {r.line for r in lines} == {"one\ttwo".replace("\t", " "), "three"} or {r.line for r in lines} == {"one two", "three"}


def test_codes_for_row_numbers_far_apart(spark):
    rows = spark.createDataFrame([(i * 10**12,) for i in range(50)], "row_no long")
    state = spark.createDataFrame([("finding", 2026, 3)], "entity_type string, year int, last_value long")
    taken = spark.createDataFrame([("H-2026-005",), ("H-2026-006",), ("H-2026-020",)], "code string")
    df = assign_codes(rows, "finding", 2026, "row_no", state, taken)
    free = [n for n in range(4, 80) if n not in (5, 6, 20)]
    assert [r.code for r in df.orderBy("row_no").collect()] == [f"H-2026-{n:03d}" for n in free[:50]]
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("CartesianProduct", "NestedLoopJoin", "SinglePartition"))
