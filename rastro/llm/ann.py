"""Operator 11: approximate nearest neighbours by learned partitions.

A bounded sample's neighbour graph is cut into parts of equal size with few edges between them. A small network learns
from it, for any vector, the part it belongs to (one head) and how its neighbours are spread over the parts (another
head). Every row is indexed under its most probable part; a query goes to its most probable parts, as many as hold the
probability mass that a calibration against brute force over all rows asks for, and the rows found there are reranked by
exact inner products.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rastro.llm.common import give_back, read, ship, slices
from rastro.session import settle

#: Rows and components of the sample that the parts are learned from, and so the bound of what the driver holds.
SAMPLE, SAMPLE_COMPONENTS = 8192, 1 << 22
#: Neighbours of a row in the graph, and those whose parts a query head learns.
GRAPH, SPREAD = 10, 20
#: Parts at most; there are about a quarter of the square root of the rows.
MOST_PARTS = 128
#: Width of the network, rounds over the sample.
HIDDEN, EPOCHS = 128, 30
#: Queries of the calibration, and the mean recall that they ask for.
CALIBRATION, RECALL = 256, 0.95
#: Bytes of vectors in a slice of a part and in a block of queries, bytes of a block of scores.
SLICE_BYTES, SCORE_BYTES = 1 << 25, 1 << 25


# The parts.

def neighbours(x: np.ndarray, k: int) -> np.ndarray:
    """The ``k`` rows of largest inner product of every row, itself apart."""
    k = min(k, len(x) - 1)
    out = np.empty((len(x), k), np.int64)
    for at in range(0, len(x), 1024):
        s = x[at:at + 1024] @ x.T
        s[np.arange(len(s)), np.arange(at, at + len(s))] = -np.inf
        out[at:at + 1024] = np.argpartition(-s, k - 1, axis=1)[:, :k] if k else 0
    return out


def balanced_parts(graph: np.ndarray, levels: int) -> np.ndarray:
    """A part for every vertex: the graph is halved ``levels`` times, each half as small and with as light a cut as found.

    A half is the lower side of the slowest mode of a random walk; then pairs of vertices change sides while that lightens the cut.
    """
    n, k = graph.shape
    a, b = np.repeat(np.arange(n), k), graph.ravel()
    a, b = np.concatenate([a, b]), np.concatenate([b, a])
    part = np.zeros(n, np.int64)
    rng = np.random.default_rng(7)
    for _ in range(levels):
        inside = part[a] == part[b]
        u, v = a[inside], b[inside]
        degree = np.maximum(np.bincount(u, minlength=n), 1.0)
        weight = np.bincount(part, degree)
        mode = rng.standard_normal(n)
        for _ in range(60):
            mode -= (np.bincount(part, mode * degree) / weight)[part]
            mode = 0.5 * mode + 0.5 * np.bincount(u, mode[v], minlength=n) / degree
            mode /= np.sqrt(np.bincount(part, mode * mode) + 1e-300)[part]
        order = np.lexsort((mode, part))
        size = np.bincount(part)
        rank = np.empty(n, np.int64)
        rank[order] = np.arange(n) - np.repeat(np.cumsum(size) - size, size)
        side = rank >= (size[part] + 1) // 2
        for _ in range(12):
            gain = np.bincount(u, np.where(side[u] != side[v], 1.0, -1.0), minlength=n)
            cut = int((side[u] != side[v]).sum())
            trial = side.copy()
            order = np.lexsort((-gain, side, part))
            group = part[order] * 2 + side[order]
            start = np.searchsorted(group, np.arange(2 * len(size)))
            place = np.arange(n) - start[group]
            best = np.full((2 * len(size), n // len(size) + 2), -np.inf)
            fits = place < best.shape[1]
            best[group[fits], place[fits]] = gain[order][fits]
            both = best[0::2] + best[1::2] > 0
            few = np.minimum(both.argmin(1), np.maximum(size // 20, 1))  # the first pairs that gain, a twentieth at once
            moving = order[place < few[part[order]]]
            trial[moving] = ~trial[moving]
            if not len(moving) or int((trial[u] != trial[v]).sum()) >= cut:
                break
            side = trial
        part = part * 2 + side
    return part


class Router:
    """A network of one hidden layer with two heads: the part of a row, and the spread of its neighbours over the parts."""

    def __init__(self, x: np.ndarray, part: np.ndarray, spread: np.ndarray):
        rng = np.random.default_rng(11)
        parts = spread.shape[1]
        self.scale = np.float32(1 / max(float(np.sqrt((x.astype(np.float64) ** 2).sum(1).mean())), 1e-30) * 4)
        shapes = ((x.shape[1], HIDDEN), (HIDDEN,), (HIDDEN, 2 * parts), (2 * parts,))
        self.w = [(rng.standard_normal(s) * np.sqrt(2 / s[0]) if len(s) > 1 else np.zeros(s)).astype(np.float32) for s in shapes]
        target = np.concatenate([np.eye(parts, dtype=np.float32)[part], spread.astype(np.float32)], axis=1)
        x = x * self.scale
        m, s, t = [np.zeros_like(w) for w in self.w], [np.zeros_like(w) for w in self.w], 0
        steps = EPOCHS * max(1, len(x) // 256)
        for _ in range(EPOCHS):
            order = rng.permutation(len(x))
            for at in range(0, len(x), 256):
                rows = order[at:at + 256]
                h = np.maximum(x[rows] @ self.w[0] + self.w[1], 0)
                d = (self._heads(h) - target[rows]) / np.float32(len(rows))
                g = [None, None, h.T @ d, d.sum(0)]
                back = (d @ self.w[2].T) * (h > 0)
                g[0], g[1] = x[rows].T @ back, back.sum(0)
                t += 1
                rate = 3e-3 * max(0.05, 1 - t / steps)
                for i, w in enumerate(self.w):
                    m[i] = 0.9 * m[i] + 0.1 * g[i]
                    s[i] = 0.99 * s[i] + 0.01 * g[i] ** 2
                    w -= (rate * (m[i] / (1 - 0.9 ** t)) / (np.sqrt(s[i] / (1 - 0.99 ** t)) + 1e-7)).astype(np.float32)

    def _heads(self, h: np.ndarray) -> np.ndarray:
        z = h @ self.w[2] + self.w[3]
        parts = z.shape[1] // 2
        for half in (z[:, :parts], z[:, parts:]):
            half -= half.max(1, keepdims=True)
            np.exp(half, out=half)
            half /= half.sum(1, keepdims=True)
        return z

    def __call__(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of every row: its part, and the probabilities of the parts that hold its neighbours."""
        with np.errstate(over="ignore", invalid="ignore"):  # components beyond single precision: any part will do
            z = self._heads(np.maximum((x * np.float64(self.scale)).astype(np.float32) @ self.w[0] + self.w[1], 0))
        z = np.nan_to_num(z)
        parts = z.shape[1] // 2
        return z[:, :parts].argmax(1), z[:, parts:]


def learned(x: np.ndarray, rows: int) -> Router:
    """Parts and router from a sample of a table of ``rows`` rows."""
    x = np.unique(x, axis=0).astype(np.float32)
    wish = np.clip(np.sqrt(max(rows, 1)) / 4, 1, min(MOST_PARTS, max(1, len(x) // 16)))
    levels = int(round(float(np.log2(wish)))) if len(x) > 1 else 0
    near = neighbours(x, SPREAD)
    part = balanced_parts(neighbours(x, GRAPH), levels) if levels else np.zeros(len(x), np.int64)
    spread = np.zeros((len(x), 1 << levels))
    if near.shape[1]:
        np.add.at(spread, (np.repeat(np.arange(len(x)), near.shape[1]), part[near].ravel()), 1 / near.shape[1])
    else:
        spread[:, 0] = 1
    return Router(x, part, spread)


def probed(chances: np.ndarray, mass: float, held: np.ndarray, least: int) -> list[np.ndarray]:
    """The parts of each query: the most probable ones that together reach ``mass`` and hold ``least`` rows."""
    order = np.argsort(-chances, axis=1, kind="stable")
    sums = np.cumsum(np.take_along_axis(chances, order, 1), axis=1)
    enough = np.maximum((sums < mass).sum(1), (np.cumsum(held[order], axis=1) < least).sum(1)) + 1
    return [o[:n] for o, n in zip(order, enough)]


def calibrated(chances: np.ndarray, parts: list[np.ndarray], target: float) -> float:
    """The least mass at which the queries' neighbours, whose parts are given, are found at a mean share of ``target``."""
    order = np.argsort(-chances, axis=1, kind="stable")
    sums = np.cumsum(np.take_along_axis(chances, order, 1), axis=1)
    place = np.argsort(order, axis=1)
    needs = []  # per query: the mass before each neighbour's part, and what a find adds to the mean
    for q, p in enumerate(parts):
        if len(p):
            at = place[q][p]
            needs += [(float(sums[q, i - 1]) if i else 0.0, 1 / len(p)) for i in at]
    if not needs:
        return 1.0
    needs.sort()
    share = np.cumsum([w for _, w in needs]) / sum(len(p) > 0 for p in parts)
    at = int(np.searchsorted(share, target - 1e-9))
    return min(1.0, needs[min(at, len(needs) - 1)][0] + 1e-6)


# Exact scores.

def exact(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of rows, added up from left to right in double precision, so that equal vectors have equal scores."""
    return np.add.accumulate(a * b, axis=1)[:, -1]


def nearest(q_ids: np.ndarray, q: np.ndarray, ids: np.ndarray, x: np.ndarray, k: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(query's place, id, score) of the ``k`` best ids of each query among ``ids``, its own apart; ties to the smaller id."""
    step = max(1, SCORE_BYTES // (8 * max(1, len(x))))
    reach = np.sqrt((x * x).sum(1)).max(initial=0.0)
    for at in range(0, len(q), step):
        rows = q[at:at + step]
        s = rows @ x.T
        s[q_ids[at:at + step, None] == ids[None, :]] = -np.inf
        margin = 1e-12 * np.sqrt((rows * rows).sum(1)) * reach
        repeated = k if len(np.unique(ids)) == len(ids) else len(ids)
        least = np.partition(s, -min(repeated, s.shape[1]), axis=1)[:, -min(repeated, s.shape[1])] - margin
        a, b = np.nonzero((s >= least[:, None]) & (s > -np.inf))
        score = np.concatenate([exact(rows[a[i:i + 65536]], x[b[i:i + 65536]]) for i in range(0, len(a), 65536)] or [np.empty(0)])
        order = np.lexsort((ids[b], -score, a))
        a, found, score = a[order], ids[b][order], score[order]
        if repeated != k:  # an id in several rows counts once, with its best score
            _, first = np.unique(np.stack([a, found]), axis=1, return_index=True)
            first.sort()
            a, found, score = a[first], found[first], score[first]
        place = np.arange(len(a)) - np.searchsorted(a, a)
        keep = place < k
        yield a[keep] + at, found[keep], score[keep]


# The jobs.

def _matrix(column, dimension: int) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dimension)


def _batches(fn: Callable, arrow: pa.Schema) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(fn(part), arrow)], schema=arrow)
        give_back()

    return run


def usable(vectors: DataFrame, id_col: str, vec_col: str) -> tuple[DataFrame, int, int]:
    """(id, v) of the rows that take part, the dimension, and their number."""
    v = F.col("v")
    fine = (F.size(v) > 0) & ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists(v, lambda x: x != 0)
    rows = vectors.select(F.col(f"`{id_col}`").cast("bigint").alias("id"), F.col(f"`{vec_col}`").cast("array<double>").alias("v")).where(F.col("id").isNotNull() & v.isNotNull() & fine)
    sizes = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").first()
    dimension, n = (sizes["d"], sizes["count"]) if sizes else (1, 0)
    return rows.where(F.size("v") == dimension), dimension, n


def _drawn(rows: DataFrame, n: int, total: int, seed: int) -> DataFrame:
    """About ``n`` rows by a hash of their ids, exactly ``n`` where there are so many."""
    mark = F.xxhash64("id", F.lit(seed))
    share = min(1.0, (2 * n + 100) / max(total, 1))
    return rows.where(mark <= min((1 << 63) - 1, int(-(1 << 63) + share * (1 << 64)))).orderBy(mark, "id", "v").limit(n)


def _brute(rows: DataFrame, ids: np.ndarray, q: np.ndarray, dimension: int, k: int) -> list[np.ndarray]:
    """The parts of the ``k`` nearest rows of each calibration query, from all rows: every task keeps its best, the best of them are the result."""
    def run(batches):
        best = None
        for batch in batches:
            for part in slices(batch):
                p, own, x = part.column(0).to_numpy(), part.column(1).to_numpy(), _matrix(part.column(2), dimension)
                s = q @ x.T
                s[ids[:, None] == own[None, :]] = -np.inf
                p, own = np.broadcast_to(p, s.shape), np.broadcast_to(own, s.shape)
                if best:
                    s, own, p = (np.concatenate(c, axis=1) for c in zip(best, (s, own, p)))
                if s.shape[1] > k:
                    top = np.argpartition(-s, k - 1, axis=1)[:, :k]
                    s, own, p = (np.take_along_axis(c, top, 1) for c in (s, own, p))
                best = s, own, p
        if best:
            s, own, p = (c.ravel() for c in best)
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(np.arange(len(q)), best[0].shape[1])), pa.array(s), pa.array(own), pa.array(p.astype(np.int32))], names=["q", "s", "id", "part"])
        give_back()

    found = rows.select("part", "id", "v").mapInArrow(run, "q long, s double, id long, part int").where(F.col("s") > float("-inf"))
    first = F.row_number().over(Window.partitionBy("q").orderBy(F.desc("s"), "id"))
    told = found.withColumn("r", first).where(F.col("r") <= k).groupBy("q").agg(F.collect_list("part").alias("parts")).collect()
    by = {r["q"]: np.array(r["parts"]) for r in told}
    return [by.get(i, np.empty(0, np.int64)) for i in range(len(q))]


def search(vectors: DataFrame, queries: DataFrame, k: int = 20, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """The ``k`` nearest rows of ``vectors`` found for every row of ``queries`` (same two columns), by largest inner product.

    Returns query_id, rank (from 1), vec_id, score: the exact inner product in double precision, added up from left to
    right; ties go to the smaller vec_id, a row with the query's id is not among its results. With no more than ``k``
    candidates all are found.

    The index holds every row; the parts are learned from at most ``SAMPLE`` rows and ``SAMPLE_COMPONENTS`` components,
    and ``CALIBRATION`` rows are compared with all rows to set how many parts are probed for a mean recall of ``RECALL``.

    Defined results: rows with a null id or vector, a null or non-finite component, or only zeros take no part, nor do
    those of another dimension than most rows have (ties: the smaller). An id in several rows is one candidate with its
    best score, and one query with its least vector. An empty table gives no rows. Other columns are passed over.
    """
    spark = vectors.sparkSession
    ship(spark)
    rows, dimension, n = usable(vectors, id_col, vec_col)
    width = max(1, min(SAMPLE, SAMPLE_COMPONENTS // dimension))
    drawn = [r["v"] for r in _drawn(rows, width, n, 1).select("v").collect()]
    router = learned(np.array(drawn, np.float64).reshape(-1, dimension), n) if drawn else None
    if router is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    model = spark.sparkContext.broadcast(router)  # (dimension + 2 * parts) * HIDDEN numbers

    def placed(part):
        return model.value(_matrix(part.column(1), dimension))[0], part.column(0), part.column(1)

    index_schema = pa.schema([("part", pa.int32()), ("id", pa.int64()), ("v", pa.list_(pa.float64()))])
    index = settle(rows.mapInArrow(_batches(placed, index_schema), "part int, id long, v array<double>"), "vectors")
    held_rows = {r["part"]: r for r in index.groupBy("part").agg(F.count(F.lit(1)).alias("n"), F.approx_count_distinct("id").alias("ids")).collect()}
    parts = router.w[3].size // 2
    held = np.array([held_rows[p]["ids"] if p in held_rows else 0 for p in range(parts)])
    trial = _drawn(rows, CALIBRATION, n, 2).collect()
    trial_v = np.array([r["v"] for r in trial]).reshape(-1, dimension)
    chances = router(trial_v)[1]
    mass = calibrated(chances, _brute(index, np.array([r["id"] for r in trial]), trial_v, dimension, k), RECALL)

    asked, other, _ = usable(queries, id_col, vec_col)
    if other != dimension:
        asked = queries.select(F.col(f"`{id_col}`").cast("bigint").alias("id"), F.col(f"`{vec_col}`").cast("array<double>").alias("v")).where(F.size("v") == dimension)
    asked = asked.groupBy("id").agg(F.min("v").alias("v"))

    def routed(part):
        return part.column(0), part.column(1), [p.tolist() for p in probed(model.value(_matrix(part.column(1), dimension))[1], mass, held, 2 * (k + 1))]

    asked_schema = pa.schema([("id", pa.int64()), ("v", pa.list_(pa.float64())), ("parts", pa.list_(pa.int32()))])
    asked = settle(asked.mapInArrow(_batches(routed, asked_schema), "id long, v array<double>, parts array<int>"), "routed")
    wanted = {r["part"]: r["count"] for r in asked.select(F.explode("parts").alias("part")).groupBy("part").count().collect()}

    # Each part as a grid: its rows in slices, its queries in blocks, both of a bounded size whatever the part holds.
    room = max(1, SLICE_BYTES // (8 * dimension))
    grid = {p: (-(-held_rows[p]["n"] // room) if p in held_rows else 0, -(-wanted[p] // room) if p in wanted else 0) for p in range(parts)}
    count = lambda i: F.element_at(F.array(*[F.lit(grid[p][i]) for p in range(parts)]), F.col("part") + 1)
    upto = lambda c: F.explode(F.when(c > 0, F.sequence(F.lit(0), c - 1)))
    deal = F.monotonically_increasing_id()  # copies of an id or a vector don't share a slice
    left = index.withColumn("si", F.pmod(F.xxhash64(deal), count(0)).cast("int")).withColumn("qi", upto(count(1)))
    right = asked.select("id", "v", F.explode("parts").alias("part")).withColumn("qi", F.pmod(F.xxhash64("id"), count(1)).cast("int")).withColumn("si", upto(count(0)))
    key = ["part", "si", "qi"]
    found_type = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())])

    def reranked(a: pa.Table, b: pa.Table) -> pa.Table:
        out = []
        if a.num_rows and b.num_rows:
            q_ids = b.column("id").to_numpy()
            for q, found, score in nearest(q_ids, _matrix(b.column("v"), dimension), a.column("id").to_numpy(), _matrix(a.column("v"), dimension), k):
                out.append(pa.table([pa.array(q_ids[q]), pa.array(found), pa.array(score)], schema=found_type))
        return pa.concat_tables(out) if out else found_type.empty_table()

    found = left.groupBy(*key).cogroup(right.groupBy(*key)).applyInArrow(reranked, "query_id long, vec_id long, score double")
    best = Window.partitionBy("query_id", "vec_id").orderBy(F.desc("score"))
    rank = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    once = found.repartition("query_id").withColumn("again", F.row_number().over(best)).where("again = 1")
    return once.withColumn("rank", F.row_number().over(rank)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op11_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = read(spark, sf_dir, "embeddings")
    return search(vectors, vectors.where(F.col("vec_id") % 20 == 0))


QUERIES = {"op11_nearest_neighbours": op11_nearest_neighbours}
ORACLES = {}
