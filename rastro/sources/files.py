"""Admission of uploaded files: type, size, signature, content hash."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Allowed types with their size limits in bytes.
MB = 1024 * 1024
LIMITS = {"pdf": 50 * MB, "xlsx": 50 * MB, "xls": 50 * MB, "xlsm": 50 * MB, "docx": 25 * MB, "doc": 25 * MB, "csv": 20 * MB, "txt": 20 * MB}


def extension(path) -> Column:
    return F.lower(F.regexp_extract(path, r"\.([^./]*)$", 1))


def admit(files: DataFrame) -> DataFrame:
    """files (path, length, content) -> path, extension, accepted, reason."""
    ext, size = F.col("extension"), F.col("length")
    limit = F.element_at(F.create_map(*[x for k, v in LIMITS.items() for x in (F.lit(k), F.lit(v))]), ext)
    limit_mb = (limit / MB).cast("int").cast("string")
    reason = (F.when(limit.isNull(), "Tipo de archivo no permitido.")
              .when(size > limit, F.concat(F.lit("El archivo excede el tamaño máximo permitido ("), limit_mb, F.lit(" MB).")))
              .when(size == 0, "El archivo subido está vacío (0 bytes).")
              .when((ext == "pdf") & (F.substring("content", 1, 4) != F.lit(b"%PDF")), "Firma de archivo inválida. El archivo no es un documento PDF válido."))
    out = files.withColumn("extension", extension("path")).withColumn("reason", reason)
    return out.select("path", "extension", "length", F.col("reason").isNull().alias("accepted"), "reason")


def with_hash(files: DataFrame) -> DataFrame:
    return files.withColumn("file_hash", F.sha2("content", 256))
