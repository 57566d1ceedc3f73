"""Connected components by alternating large-star and small-star, each a salted equi-join of long pairs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rastro.session import settle

#: Parts into which the edges of one vertex are dealt, so that a hub's join is not one task's.
SALTS = 16


def _with_least(edges: DataFrame) -> DataFrame:
    """(u, v, m): every edge with the least neighbour of its ``u``."""
    least = edges.groupBy("u").agg(F.min("v").alias("m")).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return edges.withColumn("salt", F.pmod(F.hash("v"), F.lit(SALTS))).join(least, ["u", "salt"]).select("u", "v", "m")


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    return _with_least(both).where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.least("u", "m").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    pairs = F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))
    return (_with_least(down).select(F.explode(pairs).alias("e")).select("e.u", "e.v").where(F.col("u") != F.col("v")).distinct())


def _mark(edges: DataFrame):
    return edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of ``edges`` (a, b: longs) that is not its component's least.

    Loops and repeated edges are allowed, rows with a null are passed over. The result stands in the shared
    folder, as does every round, so that a lost executor costs a re-read.
    """
    stars = settle(edges.where(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    mark = _mark(stars)
    while True:
        stars = settle(_small_star(_large_star(stars)), "stars")
        before, mark = mark, _mark(stars)
        if mark == before:
            return stars.select(F.col("u").alias("node"), F.col("v").alias("component"))
