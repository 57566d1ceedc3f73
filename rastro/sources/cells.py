"""Landed spreadsheets: one row per cell, headers matched to fields, cells turned into sheet rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rastro.functions.basic import low, strip

# Header keywords in the order they are tried, per kind of sheet.
FINDING_HEADERS = {
    "obs": ["observaciones", "comentarios", "notas", "evidencia"],
    "h_code": ["hallazgo origen", "id hallazgo", "cod hallazgo", "código hallazgo", "codigo hallazgo"],
    "p_code": ["id propuesta", "cod propuesta", "código propuesta", "codigo propuesta", "propuesta vinculada"],
    "area": ["área", "area", "proceso", "sector", "gerencia"],
    "situation": ["hallazgo", "situación", "situacion", "desviación", "desviacion"],
    "prop_text": ["propuesta de mejora", "propuesta", "recomendación", "recomendacion", "medida"],
    "risk": ["riesgo", "severidad", "criticidad"],
    "owner": ["responsable", "propietario", "lider", "líder", "owner"],
    "target_date": ["fecha compromiso", "fecha", "compromiso", "vencimiento", "plazo"],
    "status": ["estado de implementación", "estado", "estatus", "status"],
    "pct": ["avance", "progreso", "%"],
    "actions": ["acciones", "acción", "accion", "plan"],
}
PLAN_HEADERS = {
    "pa_code": ["id plan", "cod plan", "código plan", "codigo plan"],
    "action_text": ["acción compromiso", "accion compromiso", "acción", "accion", "detalle"],
    "p_code": ["propuesta vinculada", "id propuesta", "cod propuesta", "código propuesta"],
    "h_code": ["hallazgo", "id hallazgo", "cod hallazgo", "código hallazgo", "codigo hallazgo"],
    "owner": ["responsable", "owner", "lider"],
    "target_date": ["fecha compromiso", "fecha", "compromiso", "vencimiento"],
    "pct": ["avance", "progreso", "%"],
    "status": ["estado", "status", "estatus"],
    "obs": ["evidencia", "observaciones", "notas", "comentarios"],
}
LEGACY_HEADERS = {
    "obs": ["observaciones", "comentarios", "notas"],
    "h_code": ["id hallazgo", "cod hallazgo", "código hallazgo", "codigo hallazgo"],
    "p_code": ["id propuesta", "cod propuesta", "código propuesta", "codigo propuesta"],
    "area": FINDING_HEADERS["area"], "situation": FINDING_HEADERS["situation"],
    "prop_text": ["propuesta", "recomendación", "recomendacion", "medida"],
    "risk": FINDING_HEADERS["risk"], "owner": FINDING_HEADERS["owner"],
    "target_date": ["fecha", "compromiso", "vencimiento", "plazo"], "status": ["estado", "estatus", "status"],
    "pct": FINDING_HEADERS["pct"], "actions": ["acciones", "accion", "acción", "plan"],
}
# Column positions when no header is recognised.
FINDING_POSITIONS = {"area": 0, "h_code": 1, "situation": 2, "p_code": 3, "prop_text": 4, "risk": 5, "owner": 6,
                     "target_date": 7, "status": 8, "pct": 9, "actions": 10, "obs": 11}
PLAN_POSITIONS = {"pa_code": 0, "action_text": 1, "p_code": 2, "h_code": 3, "owner": 5, "target_date": 6,
                  "pct": 7, "status": 8, "obs": 9}

SHEET = ["file", "sheet"]


def header_field(header: Column, keywords: dict[str, list[str]]) -> Column:
    """The field of the first keyword group with a word inside the header."""
    text = F.lower(strip(header))
    out = None
    for field, words in keywords.items():
        hit = text.rlike("|".join(words))
        out = F.when(hit, field) if out is None else out.when(hit, field)
    return out


def resolve_headers(headers: DataFrame, keywords=FINDING_HEADERS, positions=FINDING_POSITIONS) -> DataFrame:
    """Map (file, sheet, col_no, value) header cells to fields; the first column of a field wins.

    A sheet without a single recognised header gets the fixed positions.
    """
    named = headers.withColumn("field", header_field(F.col("value"), keywords))
    found = named.filter("field is not null").groupBy(*SHEET, "field").agg(F.min("col_no").alias("col_no"))
    fixed = F.array(*[F.struct(F.lit(f).alias("field"), F.lit(i).alias("col_no")) for f, i in positions.items()])
    unknown = (named.groupBy(*SHEET).agg(F.count("field").alias("n")).filter("n = 0")
               .select(*SHEET, F.inline(fixed)))
    return found.select(*SHEET, "field", F.col("col_no").cast("int")).unionByName(unknown)


def resolve_legacy_headers(headers: DataFrame) -> DataFrame:
    """Older rule: the last column of a field wins, and every other field keeps its fixed position."""
    named = headers.withColumn("field", header_field(F.col("value"), LEGACY_HEADERS)).filter("field is not null")
    found = named.groupBy(*SHEET, "field").agg(F.max("col_no").cast("int").alias("found"))
    fixed = F.array(*[F.struct(F.lit(f).alias("field"), F.lit(i).alias("fixed")) for f, i in FINDING_POSITIONS.items()])
    sheets = headers.select(*SHEET).distinct().select(*SHEET, F.inline(fixed))
    return sheets.join(found, [*SHEET, "field"], "left").select(*SHEET, "field", F.coalesce("found", "fixed").alias("col_no"))


def sheet_roles(sheets: DataFrame) -> DataFrame:
    """(file, sheet, sheet_no) -> role. The finding sheet is the first named so, else the first sheet."""
    name = low("sheet")
    first = lambda cond: F.min(F.when(cond, F.col("sheet_no")))
    picked = sheets.groupBy("file").agg(
        F.coalesce(first(name.contains("hallazgo")), F.min("sheet_no")).alias("f"),
        F.sort_array(F.collect_set(F.when(name.contains("propuesta"), F.col("sheet_no")))).alias("ps"),
        F.sort_array(F.collect_set(F.when(name.contains("plan"), F.col("sheet_no")))).alias("as"))
    picked = picked.withColumn("p", F.get(F.filter("ps", lambda x: x != F.col("f")), F.lit(0)))
    picked = picked.withColumn("a", F.get(F.filter("as", lambda x: (x != F.col("f")) & ~F.coalesce(x == F.col("p"), F.lit(False))), F.lit(0)))
    n = F.col("sheet_no")
    role = F.when(n == F.col("f"), "findings").when(n == F.col("p"), "proposals").when(n == F.col("a"), "plans")
    return sheets.join(picked, "file").select("file", "sheet", role.alias("role")).filter("role is not null")


def fill_merged(cells: DataFrame, ranges: DataFrame) -> DataFrame:
    """Give the empty cells of merged ranges (file, sheet, r0, c0, r1, c1) their top-left value.

    Ranges are opened into their cells, so the fill is an equi-join.
    """
    top = cells.select(*SHEET, F.col("row_no").alias("r0"), F.col("col_no").alias("c0"), F.col("value").alias("top_value"))
    opened = (ranges.join(top, [*SHEET, "r0", "c0"])
              .withColumn("row_no", F.explode(F.sequence("r0", "r1"))).withColumn("col_no", F.explode(F.sequence("c0", "c1")))
              .select(*SHEET, F.col("row_no").cast(cells.schema["row_no"].dataType), F.col("col_no").cast(cells.schema["col_no"].dataType), "top_value"))
    return (cells.join(opened, [*SHEET, "row_no", "col_no"], "full_outer")
            .select(*SHEET, "row_no", "col_no", F.coalesce("value", "top_value").alias("value")))


def to_rows(cells: DataFrame, mapping: DataFrame, fields, header_row: int = 0) -> DataFrame:
    """Cells below the header as one row per sheet row, one text column per field.

    ``row_no`` counts from the header, and a numeric-cell flag is kept for the percentage if there is one.
    """
    flag = ["is_numeric"] if "is_numeric" in cells.columns else []
    body = cells.filter(F.col("row_no") > header_row).join(mapping, [*SHEET, "col_no"])
    out = body.groupBy(*SHEET, (F.col("row_no") - header_row).alias("row_no")).agg(
        *[F.max(F.when(F.col("field") == f, strip("value"))).alias(f) for f in fields],
        *[F.bool_or((F.col("field") == "pct") & F.col(c)).alias("pct_is_numeric") for c in flag])
    return out
