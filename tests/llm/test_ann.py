"""Learned partitions against brute force: recall, exact scores, ties, and rows that take no part."""

import math
import random

import numpy as np
import pytest

from rastro.llm import ann
from rastro.session import tune

SCHEMA = "vec_id long, embedding array<float>, label int, part int, v string"


def brute(rows, asked, k=20):
    """Scores added up from left to right; the best score of an id counts, a query is its least vector."""
    out = {}
    for q, v in asked.items():
        best = {}
        for i, w in rows:
            if i != q:
                s = 0.0
                for a, b in zip(v, w):
                    s += a * b
                best[i] = max(s, best.get(i, -math.inf))
        out[q] = sorted(((-s, i) for i, s in best.items()))[:k]
    return out


def found(df):
    out = {}
    for r in df.collect():
        out.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    return {q: sorted(v) for q, v in out.items()}


def frame(spark, rows):
    return spark.createDataFrame([(i, v, 0, 1, "x") for i, v in rows], SCHEMA)


def doubles(rows):
    return [(i, [float(np.float32(x)) for x in v]) for i, v in rows]


@pytest.mark.parametrize("sf", ["0.01", "0.1"])
def test_query_recall_and_scores(spark, sf):
    tune(spark)
    folder = f"/root/testdata/sf{sf}"
    rows = [(r[0], list(r[1])) for r in spark.read.parquet(f"{folder}/embeddings.parquet").select("vec_id", "embedding").collect()]
    asked = {i: v for i, v in rows if i % 20 == 0}
    got, x, ids = found(ann.op11_nearest_neighbours(spark, folder)), np.array([v for _, v in rows]), np.array([i for i, _ in rows])
    assert set(got) == set(asked)
    hits = 0
    for q, v in asked.items():
        assert [r for r, _, _ in got[q]] == list(range(1, 21))
        scores = ann.exact(np.broadcast_to(np.array(v), x.shape), x)
        order = [i for i in np.lexsort((ids, -scores)) if ids[i] != q][:20]
        hits += len({int(ids[i]) for i in order} & {i for _, i, _ in got[q]})
        by = dict(zip(ids.tolist(), scores.tolist()))
        assert all(s == by[i] for _, i, s in got[q])
        assert [(-s, i) for _, i, s in got[q]] == sorted((-s, i) for _, i, s in got[q])
    assert hits / (20 * len(asked)) >= 0.9


def test_small_tables_find_all_candidates(spark):
    tune(spark)
    rng = random.Random(1)
    rows = doubles([(i, [rng.gauss(0, 1) for _ in range(6)]) for i in range(15)])
    odd = [(100, None), (101, [0.0] * 6), (102, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (103, [math.nan] + [1.0] * 5), (104, [math.inf] + [1.0] * 5), (105, [1.0, 2.0]), (None, [1.0] * 6), (106, [])]
    df = frame(spark, rows + odd)
    got = found(ann.search(df, df))
    want = brute(rows, dict(rows))
    assert {q: [(i, s) for _, i, s in v] for q, v in got.items()} == {q: [(i, -s) for s, i in v] for q, v in want.items()}


def test_ties_copies_and_repeated_ids(spark, monkeypatch):
    """A third of the rows are one vector, one id stands in many rows, and slices are small."""
    tune(spark)
    monkeypatch.setattr(ann, "SLICE_BYTES", 8 * 8 * 40)
    monkeypatch.setattr(ann, "SCORE_BYTES", 4000)
    rng = random.Random(2)
    same = [rng.gauss(0, 1) for _ in range(8)]
    rows = doubles([(i, same if i % 3 == 0 else [rng.gauss(0, 1) for _ in range(8)]) for i in range(600)])
    rows += [(1, rows[1][1])] * 50 + doubles([(1, [9.0] * 8), (3, same), (3, same)])
    asked = {}
    for i, v in rows:
        if i % 20 == 0 or i < 4:
            asked[i] = min(v, asked.get(i, v))
    df = frame(spark, rows)
    got = found(ann.search(df, df.where("vec_id % 20 = 0 OR vec_id < 4")))
    want = brute(rows, asked)
    hits = sum(len({i for _, i in want[q]} & {i for _, i, _ in got[q]}) for q in asked) / (20 * len(asked))
    assert set(got) == set(asked) and hits >= 0.9
    for q in asked:
        exact = {i: -s for s, i in brute(rows, {q: asked[q]}, 10 ** 6)[q]}
        assert all(exact[i] == s for _, i, s in got[q]) and len({i for _, i, _ in got[q]}) == 20
    copies = [i for _, i, _ in got[0]]
    assert copies == [i for _, i in want[0]]  # all of them in one part, the least ids first


def test_norms_of_many_sizes(spark):
    """The largest vectors are everyone's neighbours: the query head learns where they are."""
    tune(spark)
    rng = np.random.default_rng(3)
    x = rng.standard_normal((4000, 16)) * rng.lognormal(0, 1.2, (4000, 1))
    rows = doubles([(i, v.tolist()) for i, v in enumerate(x)])
    df = frame(spark, rows)
    got = found(ann.search(df, df.where("vec_id % 40 = 0")))
    x = np.array([v for _, v in rows])
    hits = 0
    for q, v in got.items():
        s = x @ x[q]
        s[q] = -np.inf
        hits += len(set(np.argsort(-s)[:20].tolist()) & {i for _, i, _ in v})
    assert hits / (20 * len(got)) >= 0.9 and len(got) == 100


def test_parts_are_balanced_and_cut_few_edges():
    rng = np.random.default_rng(5)
    centres = rng.standard_normal((16, 32)) * 3
    x = (centres[np.arange(1600) % 16] + rng.standard_normal((1600, 32))).astype(np.float32)
    graph = ann.neighbours(x, 10)
    part = ann.balanced_parts(graph, 4)
    sizes = np.bincount(part, minlength=16)
    assert sizes.max() - sizes.min() <= 1
    assert (part[graph] != part[:, None]).mean() < 0.2
    router = ann.learned(x, 100_000)
    assert router(x)[0].max() > 8
    near = ann.neighbours(x, 20)
    own, chances = router(x)
    assert (np.take_along_axis(chances, own[near], 1).sum(1) > 0).all()
    top = np.argsort(-chances, axis=1)[:, :4]  # 64 parts of 25 rows, so a centre of 100 rows has four
    assert np.mean([np.isin(own[n], t).mean() for n, t in zip(near, top)]) > 0.8  # few parts hold most neighbours


def test_empty_and_single(spark):
    tune(spark)
    df = frame(spark, [])
    assert ann.search(df, df).collect() == []
    one = frame(spark, [(5, [1.0, 2.0])])
    assert ann.search(one, one).collect() == [] and ann.search(one, one).columns == ["query_id", "rank", "vec_id", "score"]
    assert ann.search(frame(spark, [(5, [1.0, 2.0]), (6, [2.0, 1.0])]), one).collect() == [(5, 1, 6, 4.0)]
