"""Delimited and plain text files: encodings, delimiters, cells. One input row per file.

Files are bounded by the upload limits of ``sources.files``, so a file fits a row; the work is spread
over files, and lines are split out of the row at once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rastro.functions.basic import let
from rastro.functions.text import clean_text
from rastro.plans.corpus import LINE_BREAK

BOM = "\ufeff"


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """(path, length, content) of every file below a path."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "length", "content")


def decode_text(content) -> Column:
    """UTF-8 without its mark, else Latin-1."""
    c = F.col(content) if isinstance(content, str) else content
    text = F.coalesce(F.try_validate_utf8(c.cast("string")), F.decode(c, "ISO-8859-1"))
    return F.regexp_replace(text, f"^{BOM}", "")


def text_documents(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Files (path, content) to documents (doc_id, filename, text), and the rejected empty ones."""
    return accept_texts(files.select(F.col("path").alias("doc_id"), F.regexp_extract("path", r"([^/]*)$", 1).alias("filename"), decode_text("content").alias("text")))


def accept_texts(documents: DataFrame) -> tuple[DataFrame, DataFrame]:
    usable = F.coalesce(F.col("text").rlike(r"\S"), F.lit(False))
    good = documents.filter(usable)
    bad = documents.filter(~usable).drop("text").withColumn("reason", F.lit("El archivo no contiene texto interpretable o está vacío."))
    return good, bad


def _count(text: Column, ch: str) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit(ch), F.lit("")))


# A quoted stretch: its quotes are doubled inside. All repetitions are possessive, so a cell of any length needs no stack.
_QUOTED = '"[^"]*+(?:""[^"]*+)*+"'


def _unquoted(text) -> Column:
    """The text without its quoted stretches."""
    return F.regexp_replace(F.col(text) if isinstance(text, str) else text, _QUOTED, "")


def sheet_delimiter(text) -> Column:
    """A semicolon when the file holds more of them than commas, quoted cells aside."""
    return let(_unquoted(text), lambda t: F.when(_count(t, ";") > _count(t, ","), ";").otherwise(","))


# Delimiters a raw-text file may use, in order of preference.
RAW_DELIMITERS = [",", "\t", ";", "|"]


def raw_delimiter(text) -> Column:
    """The delimiter that stands equally often (at least once) in all lines of the file, quoted cells aside.

    Without one, a semicolon if there is any, else a comma.
    """
    def choose(bare: Column) -> Column:
        lines = F.filter(F.split(bare, LINE_BREAK), lambda s: s != "")
        steady = lambda d: let(F.array_distinct(F.transform(lines, lambda s: _count(s, d))), lambda n: (F.size(n) == 1) & (F.get(n, F.lit(0)) > 0))
        out = F.when(steady(RAW_DELIMITERS[0]), RAW_DELIMITERS[0])
        for d in RAW_DELIMITERS[1:]:
            out = out.when(steady(d), d)
        return out.when(bare.contains(";"), ";").otherwise(",")

    return let(_unquoted(text), choose)


_BREAKS = "\n\r\x0b\x0c\x1c\x1d\x1e\x85\u2028\u2029"


def _cell(d: str) -> str:
    """A cell as a pattern that never gives back what it took: quoted with what trails it, or plain up to the delimiter or line end.

    A quote that is never closed does not open a quoted cell.
    """
    mark = "\\" + d if d == "|" else d
    return f'(?>{_QUOTED}[^{mark}{_BREAKS}]*+|[^{mark}{_BREAKS}]*+)'


def _by_delimiter(delimiter: Column, use) -> Column:
    out = None
    for d in RAW_DELIMITERS:
        out = F.when(delimiter == d, use(d)) if out is None else out.when(delimiter == d, use(d))
    return out


def split_records(text: Column, delimiter: Column) -> Column:
    """Records of a file: lines, but for line breaks inside quoted cells."""
    def records(d: str) -> Column:
        mark = "\\" + d if d == "|" else d
        pattern = f"(?:{_cell(d)}{mark})*+{_cell(d)}(?:\r\n|[{_BREAKS}])"
        found = F.regexp_extract_all(F.concat(text, F.lit("\n")), F.lit(pattern), F.lit(0))
        return F.transform(found, lambda r: F.substring(r, F.lit(1), F.length(r) - F.when(r.endswith("\r\n"), 2).otherwise(1)))

    return _by_delimiter(delimiter, records)


def split_cells(record: Column, delimiter: Column) -> Column:
    """Cells of a record; a quoted cell may hold delimiters and line breaks, and doubled quotes stand for one.

    What follows a closing quote stays behind the cell's text; without a closing quote the cell stays as it is.
    """
    def cells(d: str) -> Column:
        mark = "\\" + d if d == "|" else d
        raw = F.regexp_extract_all(F.concat(record, F.lit(d)), F.lit(f"({_cell(d)}){mark}"), F.lit(1))
        whole = f'(?s)^({_QUOTED})(.*)$'
        return F.transform(raw, lambda x: let(F.regexp_extract(x, whole, 1), lambda q: F.when(q == "", x).otherwise(
            F.concat(F.replace(F.substring(q, F.lit(2), F.length(q) - 2), F.lit('""'), F.lit('"')), F.regexp_extract(x, whole, 2)))))

    return _by_delimiter(delimiter, cells)


def _rows(texts: DataFrame, key: str, delimiter: Column) -> DataFrame:
    chosen = texts.withColumn("delimiter", delimiter)
    records = chosen.select(key, "delimiter", F.posexplode(split_records(F.col("text"), F.col("delimiter"))).alias("row_no", "record"))
    return records.filter("record <> ''").select(key, "row_no", split_cells(F.col("record"), F.col("delimiter")).alias("cells"))


def sheet_cells(texts: DataFrame, key: str = "file") -> DataFrame:
    """texts (file, text) to landed cells (file, sheet, row_no, col_no, value)."""
    rows = _rows(texts, key, sheet_delimiter("text"))
    return rows.select(F.col(key).alias("file"), F.lit("Sheet1").alias("sheet"), F.col("row_no").cast("bigint"), F.posexplode("cells").alias("col_no", "value"))


def piped_lines(texts: DataFrame, key: str = "file") -> DataFrame:
    """Rows as clean cells joined by pipes, trailing empty cells and empty rows left out."""
    rows = _rows(texts, key, raw_delimiter("text"))
    clean = F.transform("cells", clean_text)
    line = F.regexp_replace(F.array_join(clean, " | "), r"(?: \| )+$", "")
    return rows.select(key, "row_no", line.alias("line")).filter("line <> ''")
