"""Line dedup over levelled sorted runs of line hashes.

A line's key (white space stripped at both ends, A-Z lower-cased) is known by a 128-bit hash. Documents are
taken in batches of descending ids. A batch's keys, with the number of its documents that hold them, are
merge-anti-joined with the runs written so far: keys that are new get their keeper, the largest document of
the batch that holds them, which is the largest of all as batches descend; keys that a run knows only add to
the number of documents. The batch then becomes a run of its own, sorted by hash. When a level holds
``FAN`` runs they are compacted into one run of the next level. At the end all runs are compacted and
tell which keys stand in so many documents that their lines go.

Only DataFrame functions are used. Runs, and the hashes of all lines, are written below the shared folder.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rastro.llm.common import free_name, hex_digest, read
from rastro.session import durable_dir

MIN_CHARS = 40
MIN_DOCS = 5
BATCHES = 4
#: Runs of a level that are compacted into one of the next.
FAN = 3

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_STRIP = " \t\n\x0b\x0c\r"
_KEY = ("h1", "h2")


def line_key(line: Column) -> Column:
    """The stripped line with A-Z lower-cased.

    The quick ``lower`` is taken where no other letter of the line has a lower case, and lower-casing letter by letter elsewhere.
    """
    bare = F.trim(line, F.lit(_STRIP))
    return F.when(bare.rlike(r"[[\p{javaUpperCase}\p{javaTitleCase}]&&[^A-Z]]"), F.translate(bare, _UPPER, _LOWER)).otherwise(F.lower(bare))


def line_hash(line: Column, min_chars: int) -> Column:
    """128 bits of the key, or null where the key is shorter than ``min_chars``."""
    def of(key: Column) -> Column:
        return F.when(F.length(key) >= min_chars, F.struct(F.xxhash64(key).alias("h1"), F.xxhash64(F.lit(1), key).alias("h2")))

    # A line that is too short before it is stripped needs no key.
    return F.when(F.length(line) >= min_chars, F.transform(F.array(line_key(line)), of)[0])


def lines_of(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


class LineRuns:
    """Runs of (h1, h2, n_docs, keeper) in levels. A key's keeper stands in one run only, the one that saw it first."""

    def __init__(self, spark: SparkSession, fan: int = FAN):
        self.spark, self.fan = spark, fan
        self.folder = durable_dir(spark, "line-runs")
        self.levels: list[list[str]] = [[]]
        self.written = 0

    def paths(self) -> list[str]:
        return [p for level in self.levels for p in level]

    def _read(self, paths: list[str]) -> DataFrame:
        return self.spark.read.schema("h1 bigint, h2 bigint, n_docs bigint, keeper bigint").parquet(*paths)

    def _write(self, rows: DataFrame, level: int) -> None:
        self.written += 1
        path = f"{self.folder}/level{level}-run{self.written}"
        rows.sortWithinPartitions(*_KEY).write.parquet(path)
        if len(self.levels) <= level:
            self.levels.append([])
        self.levels[level].append(path)

    def add(self, batch: DataFrame) -> None:
        """Take a batch of (h1, h2, doc), one row per document and key."""
        counted = batch.groupBy(*_KEY).agg(F.count(F.lit(1)).alias("n_docs"), F.max("doc").alias("keeper"))
        if self.paths():
            known = self._read(self.paths()).where(F.col("keeper").isNotNull()).select(*_KEY)
            new = counted.join(known, list(_KEY), "left_anti")
            old = counted.join(known, list(_KEY), "left_semi").withColumn("keeper", F.lit(None).cast("bigint"))
            counted = new.unionByName(old)
        self._write(counted, 0)
        self._compact()

    def _compact(self) -> None:
        for level, paths in enumerate(self.levels):
            if len(paths) >= self.fan:
                self.levels[level] = []
                self._write(self._merged(paths), level + 1)

    def _merged(self, paths: list[str]) -> DataFrame:
        return self._read(paths).groupBy(*_KEY).agg(F.sum("n_docs").alias("n_docs"), F.max("keeper").alias("keeper"))

    def all(self) -> DataFrame:
        """One row per key, from a last compaction."""
        paths = self.paths()
        if len(paths) > 1:
            self.levels = [[] for _ in self.levels] + [[]]
            self._write(self._merged(paths), len(self.levels) - 1)
        return self._read(self.paths())


def _boundaries(docs: DataFrame, batches: int) -> list[int]:
    """Ids that cut the documents into batches of about the same number; where they fall changes no result."""
    cuts = docs.select(F.percentile_approx("doc", F.lit([i / batches for i in range(1, batches)]), 1000).alias("cuts")).first()["cuts"] if batches > 1 else []
    return sorted(set(cuts or []))


def drop_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS, batches: int = BATCHES, fan: int = FAN) -> DataFrame:
    """The documents' columns with the kept text, then ``n_lines`` and ``n_dropped`` (long; they replace columns of these names).

    Keys of at least ``min_chars`` code points that stand in at least ``min_docs`` documents lose all their lines
    except in the largest document that holds them. A null or empty text is one empty line and stays null or
    empty. Rows with the same id count as one document, and each is treated alike; rows with a null id count
    together as one document below all others. Ids are integers. Without rows nothing comes out.
    """
    spark = docs.sparkSession
    doc, row = F.coalesce(F.col(id_col).cast("bigint"), F.lit(-(2**63))), F.xxhash64(F.coalesce(F.col(text_col), F.lit("")))
    plain = docs.select(doc.alias("doc"), row.alias("row"), F.col(text_col).alias("text"))
    cuts = _boundaries(plain, batches)
    batch = sum([(F.col("doc") <= c).cast("int") for c in cuts], F.lit(0))  # 0 holds the largest ids
    # Hashes and places of all lines, once: counted by the batches, and read again to find the lines that go.
    folder = durable_dir(spark, "line-keys")
    placed = F.transform(lines_of(F.col("text")), lambda x, i: F.struct(i.alias("at"), line_hash(x, min_chars).alias("h")))
    keys = plain.select("doc", "row", batch.alias("batch"), F.filter(placed, lambda p: p["h"].isNotNull()).alias("keys"))
    # Distinct strings are counted by hashing, distinct structs pair by pair.
    once = F.size(F.array_distinct(F.transform("keys", lambda p: F.concat_ws(":", p["h"]["h1"], p["h"]["h2"])))) == F.size("keys")
    # A column of its own below the explosion, else every exploded row would carry all keys of its document.
    (keys.withColumn("once", once).select("doc", "row", "batch", "once", F.explode("keys").alias("k")).select("doc", "row", "batch", "once", "k.at", "k.h.h1", "k.h.h2")
     .write.partitionBy("batch").parquet(folder))
    lines = spark.read.schema("doc bigint, row bigint, once boolean, at int, h1 bigint, h2 bigint, batch int").parquet(folder)
    runs, repeat = LineRuns(spark, fan), _may_repeat(docs, id_col)
    for i in range(len(cuts) + 1):
        mine = lines.where(F.col("batch") == i)
        several = F.lit(True) if repeat else ~F.col("once")
        runs.add(mine.where(~several).select("doc", *_KEY).unionByName(mine.where(several).select("doc", *_KEY).distinct()))
    common = runs.all().where(F.col("n_docs") >= min_docs).select(*_KEY, "keeper")
    gone = (lines.select("doc", "row", "at", *_KEY).join(common, list(_KEY)).where(F.col("doc") != F.col("keeper"))
            .groupBy("doc", "row").agg(F.array_sort(F.collect_set("at")).alias("gone")))  # no more than the document has lines
    place, mark, lost = (free_name(docs, n) for n in ("_doc", "_row", "_gone"))
    marked = docs.withColumn(place, doc).withColumn(mark, row).join(gone.select(F.col("doc").alias(place), F.col("row").alias(mark), F.col("gone").alias(lost)), [place, mark], "left")
    rest = [c for c in docs.columns if c not in ("n_lines", "n_dropped")]
    text = F.when(F.col(lost).isNull(), F.col(text_col)).otherwise(F.array_join(_without(lines_of(F.col(text_col)), F.col(lost)), "\n")).alias(text_col)
    n_lines = F.size(lines_of(F.col(text_col))).cast("bigint")
    n_dropped = F.when(F.col(lost).isNull(), 0).otherwise(F.size(lost)).cast("bigint")
    return marked.select(*[text if c == text_col else F.col(f"`{c}`") for c in rest], n_lines.alias("n_lines"), n_dropped.alias("n_dropped"))


def _without(lines: Column, places: Column) -> Column:
    """The stretches of lines between the places (from 0, ascending): every line is copied once, however many go."""
    def kept(own: Column) -> Column:
        def stretch(end: Column, i: Column) -> Column:
            start = F.when(i == 0, F.lit(0)).otherwise(F.get(places, i - 1) + 1)
            return F.slice(own, start + 1, end - start)
        return F.flatten(F.transform(F.array_append(places, F.size(own)), stretch))

    # The lines are an argument of the function, and so split once.
    return F.transform(F.array(lines), kept)[0]


def _may_repeat(docs: DataFrame, id_col: str) -> bool:
    """Whether ids repeat: then one document's rows may hold a key twice."""
    return docs.groupBy(id_col).count().where(F.col("count") > 1).limit(1).count() > 0


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = drop_lines(read(spark, sf_dir, "documents").select("doc_id", "text"))
    return kept.select("doc_id", "n_lines", "n_dropped", hex_digest(F.coalesce("text", F.lit(""))).alias("kept_sha256"))


_SQL = r"""
WITH d AS (SELECT row_number() OVER () rid, doc_id, string_split(coalesce(text, ''), chr(10)) ls FROM documents),
l AS (SELECT rid, doc_id, i, ls[i] line, translate(trim(ls[i], chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') k FROM (SELECT rid, doc_id, ls, unnest(range(1, len(ls) + 1)) i FROM d)),
c AS (SELECT k, max(doc_id) keeper FROM l WHERE length(k) >= 40 GROUP BY k HAVING count(DISTINCT doc_id) >= 5)
SELECT doc_id, count(*) n_lines, count(*) FILTER (gone) n_dropped, sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) kept_sha256
FROM (SELECT l.*, c.k IS NOT NULL AND doc_id <> keeper gone FROM l LEFT JOIN c USING (k)) GROUP BY rid, doc_id
"""

QUERIES = {"op5_line_dedup": op5_line_dedup}
ORACLES = {"op5_line_dedup": _SQL}
