"""Golden cases of the scalar rules."""

import datetime
import sys
import unicodedata

from pyspark.sql import functions as F

from rastro.functions import dates, numbers, status
from rastro.functions import text as X

CUT = datetime.date(2026, 10, 2)


def values(spark, rows, build):
    df = spark.createDataFrame([(i, *(r if isinstance(r, tuple) else (r,))) for i, r in enumerate(rows)], ", ".join(
        ["i int"] + [f"c{k} string" for k in range(len(rows[0]) if isinstance(rows[0], tuple) else 1)]))
    return [r["v"] for r in df.select("i", build().alias("v")).orderBy("i").collect()]


def test_normalize_status(spark):
    got = values(spark, ["Completado", "completada", "Cerrado", "Implementada", "stand-by", "Pendiente", None, "", "Pendiente de validacion"],
                 lambda: status.normalize_status("c0"))
    assert got == ["Finalizado"] * 4 + ["En suspensión"] + ["En proceso"] * 3 + ["Pendiente de validación"]


def test_effective_status(spark):
    rows = [("En proceso", "2026-09-27"), ("En proceso", "2026-10-12"), ("En proceso", None), ("En proceso", ""), ("stand-by", "2020-01-01"),
            ("Finalizado", "2020-01-01"), ("En proceso", "1/9/2026"), ("En proceso", "31/02/2026")]
    got = values(spark, rows, lambda: status.effective_status("c0", "c1", F.lit(CUT)))
    assert got == ["Vencido", "En proceso", "En proceso", "En proceso", "En suspensión", "Finalizado", "Vencido", "En proceso"]


def test_dates(spark):
    assert values(spark, ["30/09/2026", "2026-09-30T10:00", "nada", "", None, "sin fecha"], lambda: dates.to_iso("c0")) == ["2026-09-30"] * 2 + [None] * 4
    assert values(spark, ["2026-09-30", "x"], lambda: dates.display_date("c0")) == ["30/09/2026", "Sin fecha"]


def test_percent(spark):
    got = values(spark, ["1%", "50%", "0.5", "1", None, "invalid", "250", "-3"], lambda: numbers.parse_pct("c0"))
    assert got == [1, 50, 50, 1, 0, 0, 100, 0]
    assert values(spark, ["0.5", "0.01", "1.0", "1"], lambda: numbers.parse_pct("c0", F.lit(True))) == [50, 1, 100, 1]
    assert values(spark, ["99.9", None, "x", "300"], lambda: numbers.clamp_progress("c0")) == [99, 0, 0, 100]


def test_references_and_codes(spark):
    got = values(spark, ["Hallazgos 9, 10 y 11", "H-3 y observación n° 4", "sin citas"], lambda: X.finding_references("c0"))
    assert got == [[9, 10, 11], [3, 4], []]
    assert values(spark, ["h - 2026-001", "PM-IMP-004", None], lambda: X.explicit_code("c0")) == ["H-2026-001", "", ""]


def test_titles(spark):
    assert values(spark, ["Hallazgo 9: falta de control", "Hallazgo 3"], lambda: X.clean_title("c0")) == ["Falta de control", "Hallazgo 3"]


def _assigned():
    return [chr(c) for c in range(1, sys.maxunicode + 1) if not 0xD800 <= c < 0xE000 and unicodedata.category(chr(c)) not in ("Cn", "Co")]


def test_accents_and_keys_of_every_assigned_character(spark):
    """Each character alone and all in texts of a few hundred, against the Unicode data."""
    chars = _assigned()
    texts = ["a" + ch + "b" for ch in chars] + ["".join(chars[i:i + 300]) for i in range(0, len(chars), 300)]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, c0 string").repartition(8)
    got = df.select("i", X.fold_accents("c0").alias("folded"), X.norm_key("c0").alias("key")).collect()
    fold = lambda s: "".join(x for ch in s for x in unicodedata.normalize("NFD", ch) if unicodedata.category(x) != "Mn")
    ascii_ = lambda s: unicodedata.normalize("NFKD", s).encode("ascii", "ignore").decode().lower()
    key = lambda s: " ".join("".join(x if x.isalnum() else " " for x in ascii_(s)).split())
    assert [(r.i, ascii(texts[r.i])) for r in got if r.folded != fold(texts[r.i])][:5] == []
    assert [(r.i, ascii(texts[r.i]), r.key) for r in got if r.key != key(texts[r.i])][:5] == []
    assert len(got) == len(texts)
