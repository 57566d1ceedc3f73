"""Near-duplicate documents by MinHash, banding, verification and connected components.

* A document's set holds the 64-bit hashes of its word shingles. Documents with equal sets (by a 128-bit
  digest) are one node, the smallest of their ids; copies are never paired.
* ``HASHES`` hash functions give a node's signature, ``BANDS`` bands of it the buckets it lies in. Two sets
  of similarity 0.8 miss each other in all bands with a probability of (1 - 0.8^6)^60 = 1e-8.
* In each bucket every node is compared with one hub, then, in buckets that still hold several components,
  with another. Signatures are compared first, by three bits of every value: an estimate more than six
  standard deviations below the threshold decides; the rest are confirmed on the full sets.
* What is left are nodes of one bucket in different components. They meet in a join whose condition compares
  signatures and then 32-bit forms of the sets, which cannot hide a link, so that only pairs that are all but
  links leave it; these are confirmed on the full sets. So no link is lost, and a group of near copies
  costs a few comparisons a member.
* Links become components by alternating large-star and small-star.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rastro.llm.common import ddl_type, free_name, map_rows, read
from rastro.llm.components import components
from rastro.session import settle

ROWS, BANDS = 6, 60
HASHES = ROWS * BANDS
#: Bits of every value that are compared; values that differ agree in them by chance, once in 2^BITS.
BITS = 3
_WORDS = -(-HASHES // 64)
HUB_ROUNDS = 2

_PRIME = np.uint64(0x9E3779B97F4A7C15)
_RANDOM = np.random.default_rng(20240607)
_A = (_RANDOM.integers(0, 2**32, HASHES, dtype=np.uint32) | np.uint32(1))
_B = _RANDOM.integers(0, 2**32, HASHES, dtype=np.uint32)
_WEIGHTS = _RANDOM.integers(0, 2**63, (BANDS, ROWS), dtype=np.uint64) | np.uint64(1)
_BAND_SALT = _RANDOM.integers(0, 2**63, BANDS, dtype=np.uint64)


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(29))


def shingle_set(text: str | None, k: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word shingles. Fewer words than ``k`` are one shingle; no words give none."""
    words = text.encode().lower().split() if text else []  # bytes: only A-Z are lower-cased, and only blank and \t to \r split
    n = len(words)
    if not n:
        return np.empty(0, dtype=np.uint64)
    hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, words), dtype=np.uint64, count=n)
    k = min(k, n)
    h = hashes[: n - k + 1] + np.uint64(k)
    for i in range(1, k):
        h = _mixed(h) * _PRIME + hashes[i: n - k + 1 + i]
    return np.unique(_mixed(h))


def signature(shingles: np.ndarray) -> np.ndarray:
    """The least value of every hash function over a set; of an empty one the greatest number there is."""
    x = (shingles >> np.uint64(32)).astype(np.uint32)
    least = np.full(HASHES, 2**32 - 1, dtype=np.uint32)
    for start in range(0, len(x), 512):
        h = np.multiply.outer(x[start:start + 512], _A)
        h += _B
        np.minimum(least, h.min(axis=0), out=least)
    return least


def planes(least: np.ndarray) -> np.ndarray:
    """``BITS`` well mixed bits of every value, packed bit by bit: ``_WORDS`` words of the first bits, then of the second ..."""
    mixed = (least * np.uint32(0x9E3779B1)) >> np.uint32(32 - BITS)
    bits = np.zeros((BITS, _WORDS * 64), dtype=np.uint8)
    bits[:, :HASHES] = (mixed >> np.arange(BITS, dtype=np.uint32)[:, None]) & np.uint32(1)
    return np.packbits(bits, axis=1).view(np.int64).ravel()


def bands(least: np.ndarray) -> np.ndarray:
    """One 64-bit bucket number a band."""
    return _mixed((least.reshape(BANDS, ROWS).astype(np.uint64) * _WEIGHTS).sum(axis=1, dtype=np.uint64) + _BAND_SALT).view(np.int64)


def _lists(parts: list[np.ndarray], dtype) -> pa.ListArray:
    offsets = np.concatenate(([0], np.cumsum([len(p) for p in parts]))).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate([p.view(dtype) for p in parts] + [np.empty(0, dtype)])))


def _sketches(k: int):
    def rows(columns):
        sets = [shingle_set(t, k) for t in columns[1]]
        return [columns[0], [len(s) for s in sets], [hashlib.md5(s.tobytes()).digest() if len(s) else None for s in sets],
                _lists([bands(signature(s)) if len(s) else np.empty(0, np.int64) for s in sets], np.int64)]

    return rows


def _full(k: int):
    def rows(columns):
        sets = [shingle_set(t, k) for t in columns[1]]
        least = [signature(s) for s in sets]
        return [columns[0], _lists([planes(x) for x in least], np.int64), _lists([bands(x) for x in least], np.int64), _lists(sets, np.int64),
                _lists([s.astype(np.uint32) for s in sets], np.int32)]

    return rows


def _alike(x: str, y: str, percent: int) -> Column:
    """Whether two packed signatures leave a link possible: their estimate is not six standard deviations below the threshold."""
    def other(word: int) -> Column:
        bits = [F.col(x)[plane * _WORDS + word].bitwiseXOR(F.col(y)[plane * _WORDS + word]) for plane in range(BITS)]
        while len(bits) > 1:
            bits = [bits[0].bitwiseOR(bits[1]), *bits[2:]]
        return F.bit_count(bits[0])

    chance = 0.5**BITS
    agree = percent / 100 * (1 - chance) + chance
    least = agree - 6 * (agree * (1 - agree) / HASHES) ** 0.5
    return sum((other(w) for w in range(1, _WORDS)), other(0)) <= int(HASHES * (1 - least))


def _linked(common: Column, a: str, b: str, percent: int) -> Column:
    return F.lit(100) * common >= F.lit(percent) * (F.size(a) + F.size(b) - common)


def _compare(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The links (a, b) among distinct pairs."""
    # Spark splits skewed sides of these joins: sets are one row a node, pairs of one hub may be many.
    signed = sets.select("node", "planes")
    near = (pairs.join(signed.toDF("a", "sig_a"), "a").join(signed.toDF("b", "sig_b"), "b").where(_alike("sig_a", "sig_b", percent)).select("a", "b"))
    shingles = sets.select("node", "shingles")
    met = settle(near, "near").join(shingles.toDF("a", "set_a"), "a").join(shingles.toDF("b", "set_b"), "b")
    return settle(met.where(_linked(F.size(F.array_intersect("set_a", "set_b")), "set_a", "set_b", percent)).select("a", "b").distinct(), "links")


def _ordered(a: Column, b: Column) -> list[Column]:
    return [F.least(a, b).alias("a"), F.greatest(a, b).alias("b")]


def _with_component(members: DataFrame, comps: DataFrame) -> DataFrame:
    return members.join(comps, "node", "left").withColumn("component", F.coalesce("component", "node"))


def _links(docs: DataFrame, buckets: DataFrame, k: int, percent: int) -> DataFrame:
    """(node, component) of all nodes that are linked to a smaller one."""
    hubs = settle(buckets.groupBy("bucket").agg(F.min("node").alias("hub"), F.max("node").alias("top")).where(F.col("hub") < F.col("top")).select("bucket", "hub"), "hubs")
    shared = settle(buckets.join(hubs, "bucket"), "shared")  # members of buckets with two nodes or more
    wanted = shared.select("node").distinct()
    texts = docs.join(wanted.withColumnRenamed("node", "id"), "id", "left_semi")
    sets = settle(map_rows(texts, "node bigint, planes array<bigint>, buckets array<bigint>, shingles array<bigint>, short array<int>", _full(k)), "sets")
    links = _compare(shared.where(F.col("node") > F.col("hub")).select(F.col("hub").alias("a"), F.col("node").alias("b")).distinct(), sets, percent)
    comps = components(links)
    for turn in range(1, HUB_ROUNDS):
        mixed = _mixed_buckets(shared.select("bucket", "node"), comps)
        other = mixed.groupBy("bucket").agg(F.min_by(F.struct("node", "component"), F.xxhash64(F.lit(turn), "node")).alias("other"))
        pairs = (mixed.join(settle(other, "hubs"), "bucket").where(F.col("component") != F.col("other.component"))
                 .select(*_ordered(F.col("node"), F.col("other.node"))).distinct())
        comps = _joined(comps, _compare(pairs, sets, percent))
    mixed = _mixed_buckets(shared.select("bucket", "node"), comps)
    return _joined(comps, _compare(_left_over(mixed, sets, percent), sets, percent))


def _joined(comps: DataFrame, links: DataFrame) -> DataFrame:
    return components(comps.toDF("a", "b").unionByName(links)) if links.limit(1).count() else comps


def _mixed_buckets(members: DataFrame, comps: DataFrame) -> DataFrame:
    """(bucket, node, component, main) of buckets with several components and three nodes or more; two have met at their hub.

    ``main`` marks the nodes of a bucket's largest component.
    """
    held = settle(_with_component(members, comps), "members")
    counted = held.groupBy("bucket", "component").agg(F.count(F.lit(1)).alias("n"))
    several = (counted.groupBy("bucket").agg(F.max(F.struct("n", "component")).alias("largest"), F.count(F.lit(1)).alias("components"), F.sum("n").alias("nodes"))
               .where((F.col("components") > 1) & (F.col("nodes") > 2)).select("bucket", F.col("largest.component").alias("largest")))
    return settle(held.join(settle(several, "several"), "bucket").select("bucket", "node", "component", (F.col("component") == F.col("largest")).alias("main")), "mixed")


def _left_over(mixed: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs of one bucket and two components that may be links: those outside the largest component with all others."""
    # Bits and short sets come along, so that the join's own condition turns pairs away. Equal 32-bit forms of
    # different shingles only add to what two sets seem to share, but for forms that a set holds twice: they count as shared.
    # A pair is looked at in the first bucket that both are in: two that met in an earlier one are turned away.
    dressed = settle(mixed.join(sets.select("node", "planes", "short", "buckets", (F.size("short") - F.size(F.array_distinct("short"))).alias("twice")), "node")
                     .withColumn("earlier", F.slice("buckets", F.lit(1), (F.array_position("buckets", F.col("bucket")) - 1).cast("int"))).drop("buckets"), "dressed")
    x, y = (dressed.select(*[F.col(c).alias(f"{side}_{c}") for c in dressed.columns]) for side in "xy")
    common = F.size(F.array_intersect("x_short", "y_short")) + F.least("x_twice", "y_twice")
    met = x.where(~F.col("x_main")).join(
        y, (F.col("x_bucket") == F.col("y_bucket")) & (F.col("x_component") != F.col("y_component")) & (F.col("y_main") | (F.col("x_node") < F.col("y_node")))
        & _alike("x_planes", "y_planes", percent) & ~F.arrays_overlap("x_earlier", "y_earlier") & _linked(common, "x_short", "y_short", percent))
    return met.select(*_ordered(F.col("x_node"), F.col("y_node"))).distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle_words: int = 5, percent: int = 80) -> DataFrame:
    """``id_col``, ``n_shingles``, ``component_id`` and ``kept`` for every row of the documents.

    Documents whose sets have a similarity of ``percent`` or more are linked; a component's id is its smallest
    document id, and that document is the one to keep. Null and empty texts have no shingles and are linked with
    nothing. A null id is linked with nothing, has a null component and is kept. Rows with the same id and text are
    one document; where one id stands for several texts, each of them links the id. Ids are integers.
    """
    plain = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("text"))
    sketch = settle(map_rows(plain, "id bigint, n_shingles bigint, digest binary, buckets array<bigint>", _sketches(shingle_words)), "sketches")
    known = sketch.where((F.col("n_shingles") > 0) & F.col("id").isNotNull())
    nodes = settle(known.groupBy("digest").agg(F.min("id").alias("node")), "nodes")
    buckets = (known.join(nodes, "digest").where(F.col("id") == F.col("node"))
               .select("node", F.explode("buckets").alias("bucket")))
    comps = _links(plain, buckets, shingle_words, percent)
    group = settle(_with_component(nodes, comps).select("digest", "component"), "groups")
    out = sketch.select("id", "n_shingles", "digest").join(group, "digest", "left")
    # One id with several texts: the smallest component of its rows holds for all of them.
    component = F.when(F.col("id").isNotNull(), F.coalesce("component", "id"))
    return out.select(F.col("id").cast(ddl_type(docs, id_col)).alias(id_col), "n_shingles", component.cast(ddl_type(docs, id_col)).alias("component_id"),
                      F.coalesce(component == F.col("id"), F.lit(True)).alias("kept"))


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle_words: int = 5, percent: int = 80) -> DataFrame:
    """The documents' columns, one document of each group of near duplicates; repeated rows of that document stay."""
    gone = free_name(docs, "_gone")
    found = near_duplicates(docs, id_col, text_col, shingle_words, percent).where(~F.col("kept")).select(F.col(id_col).alias(gone)).distinct()
    return docs.join(settle(found, "gone"), F.col(id_col) == F.col(gone), "left_anti")


def op8_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read(spark, sf_dir, "documents"), shingle_words=2, percent=80)


_SQL = r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) = 1 THEN [w[1]] ELSE list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) END g FROM d),
one AS (SELECT doc_id, unnest(g) x, len(g) n FROM s),
pair AS (SELECT a.doc_id p, b.doc_id q FROM one a JOIN one b ON a.x = b.x AND a.doc_id <> b.doc_id AND a.n * 100 >= b.n * 80 AND b.n * 100 >= a.n * 80
  GROUP BY p, q HAVING 100 * count(*) >= 80 * (any_value(a.n) + any_value(b.n) - count(*))),
reach AS (SELECT doc_id p, doc_id q FROM documents UNION SELECT r.p, pair.q FROM reach r JOIN pair ON r.q = pair.p)
SELECT s.doc_id, len(g) n_shingles, min(q) component_id, s.doc_id = min(q) kept FROM s JOIN reach ON p = s.doc_id GROUP BY s.doc_id, g
"""

QUERIES = {"op8_minhash_dedup": op8_minhash_dedup}
ORACLES = {"op8_minhash_dedup": _SQL}
