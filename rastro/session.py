"""Session settings and the shared folder for work that must outlive an executor."""

from __future__ import annotations

import os
import re
import tempfile
import uuid
import zipfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


#: Compressed bytes that one task reads at most, of a file or of a shuffle.
TASK_BYTES = 8 << 20

_UNITS = {"b": 1, "k": 1 << 10, "m": 1 << 20, "g": 1 << 30, "t": 1 << 40}


def _bytes(text: str) -> int:
    number, unit = re.fullmatch(r"(\d+)\s*([bkmgt]?)b?", text.strip().lower()).groups()
    return int(number) * _UNITS[unit or "b"]


def stored_bytes(spark: SparkSession, path: str) -> int:
    """Size of a file or of all files of a folder, in any file system that Spark reads."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).getContentSummary(at).getLength()


def spread(spark: SparkSession, input_bytes: int) -> None:
    """Begin shuffles with a partition for each ``TASK_BYTES`` of input, where that is more than the session asks for; small ones are put together again."""
    key, asked = "spark.sql.adaptive.coalescePartitions.initialPartitionNum", int(spark.conf.get("spark.sql.shuffle.partitions"))
    wanted = -(-input_bytes // TASK_BYTES)
    if wanted > max(asked, int(spark.conf.get(key, None) or 0)):
        spark.conf.set(key, str(wanted))


def tune(spark: SparkSession) -> SparkSession:
    """Turn on run-time re-planning and the splitting of skewed join partitions.

    Memory and thresholds are left to whoever sized the cluster, but a task never takes more than ``TASK_BYTES``: compressed rows
    become many times their size where they are sorted.
    """
    for key, value in {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        # Split a skewed join even where the split costs one more shuffle afterwards.
        "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
        "spark.sql.session.timeZone": "UTC",
        # The virtual machine does not compile longer methods; a stage with one is run by its single expressions, which it does.
        "spark.sql.codegen.hugeMethodLimit": "8000",
    }.items():
        spark.conf.set(key, value)
    for key in ("spark.sql.adaptive.advisoryPartitionSizeInBytes", "spark.sql.files.maxPartitionBytes"):
        if _bytes(spark.conf.get(key)) > TASK_BYTES:
            spark.conf.set(key, str(TASK_BYTES))
    return spark


_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Make this package importable in the Python workers of a cluster, once per application."""
    context = spark.sparkContext
    if context.applicationId in _SHIPPED:
        return
    package = os.path.dirname(os.path.abspath(__file__))
    path = os.path.join(tempfile.mkdtemp(prefix="rastro-code-"), "rastro_code.zip")  # read by the driver alone, which serves it
    with zipfile.ZipFile(path, "w") as z:
        for folder, _, names in os.walk(package):
            for name in sorted(names):
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    z.write(full, os.path.relpath(full, os.path.dirname(package)))
    context.addPyFile(path)
    _SHIPPED.add(context.applicationId)


def durable_dir(spark: SparkSession, purpose: str) -> str:
    """A fresh folder under the cluster's shared checkpoint folder.

    Only a session that runs in one JVM may go without the setting (tests, a laptop): it gets a folder of
    its own, once. On a cluster a machine-local folder would be seen by one machine only, so that is an error.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        master = spark.sparkContext.master
        if not (master == "local" or master.startswith("local[")):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = tempfile.mkdtemp(prefix="rastro-")
        spark.sparkContext.setCheckpointDir(base)
    return f"{base.rstrip('/')}/{purpose}-{uuid.uuid4().hex}"


def settle(df: DataFrame, purpose: str) -> DataFrame:
    """Write an intermediate result once to the shared folder and go on from the written table.

    Used where a result is read several times: the plan is cut, and a lost executor costs a re-read
    instead of the whole lineage. Row groups are small, so that a file that one task has written is read by several.
    """
    path = durable_dir(df.sparkSession, purpose)
    df.write.option("parquet.block.size", TASK_BYTES).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def day_of(instant: Column) -> Column:
    """The calendar day in Buenos Aires, in a session whose time zone is UTC (``tune`` sets it)."""
    return F.to_date(F.from_utc_timestamp(instant, "America/Buenos_Aires"))


def today() -> Column:
    """Default cut date."""
    return day_of(F.current_timestamp())


def as_cut(cut) -> Column:
    """Accept a Column, a ``datetime.date``, an ISO string or None (today)."""
    if cut is None:
        return today()
    if isinstance(cut, Column):
        return cut
    return F.lit(str(cut)).cast("date")
