"""Spelling variants against plain Python over all pairs that share a word with one letter less."""

import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from rastro.llm import spelling
from rastro.session import tune


def vocabulary(rows):
    counts = Counter()
    for key, text in rows:
        for run in re.findall(r"[A-Za-zÀ-ÿ]+", text or ""):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'' if key is None else key}:{run}".encode())
            if h % 97 == 0:
                at = h % len(run)
                run = run[:at] + run[at + 1:]
            counts[run] += 1
    return {w: n for w, n in counts.items() if len(w) >= 5 and n >= 3}


def near_by_definition(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    if len(a) > len(b):
        a, b = b, a
    return len(b) - len(a) == 1 and any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def expected(counts):
    less = defaultdict(set)
    for w in counts:
        less[w].add(w)
        for i in range(len(w)):
            less[w[:i] + w[i + 1:]].add(w)
    near = defaultdict(set)
    for group in less.values():
        for a in group:
            near[a] |= {b for b in group if b not in near[a] and near_by_definition(a, b)}
    form = {}
    for w, n in counts.items():
        best = min(near[w], key=lambda b: (-counts[b], b), default=None)
        form[w] = best if best is not None and counts[best] >= 2 * n else None
    out = {}
    for w, n in counts.items():
        root = w
        while form[root] is not None:
            root = form[root]
        out[w] = (form[w], root, n, len(near[w]), counts.get(form[w]))
    return out


def got(df):
    rows = df.collect()
    assert len({r["word"] for r in rows}) == len(rows)
    return {r["word"]: tuple(r)[1:] for r in rows}


def made_up(rng, n, letters="enatié", least=5, most=8):
    return {"".join(rng.choices(letters, k=rng.randint(least, most))): rng.randint(3, 60) for _ in range(n)}


@pytest.mark.parametrize("limit", [40_000, 60])
def test_variants_of_dense_words(spark, monkeypatch, limit):
    """With the small limit, many levels are dealt and full shards are cut into slices."""
    tune(spark)
    rng = random.Random(2)
    counts = made_up(rng, 1500) | {w: 9 for w in ("hopcut", "pochut", "copuht", "hocutp")} | {"e" * 40: 3, "e" * 41: 50, "e" * 90: 3, "e" * 89 + "n": 70, "ж" * 6: 4, "ж" * 7: 9}
    if limit < 100:
        same = ["".join(p) for p in {tuple(rng.sample("cdlgbcdlgb", 10)) for _ in range(400)}]  # one leaf or few
        counts |= dict.fromkeys(same, 5)
    monkeypatch.setattr(spelling, "SHARD_WORDS", limit)
    monkeypatch.setattr(spelling, "FRONTIER", 500)
    df = spark.createDataFrame([*counts.items(), (None, 9)], "word string, n long")
    assert got(spelling.variants(df)) == expected(counts)


def test_search_meets_every_near_word_and_counts_prune():
    rng = random.Random(4)
    texts = sorted(made_up(rng, 400, "enatiréco"))
    counts = spelling.group_counts(texts)
    met = {(int(a), int(b)) for q, e in spelling.Trie(counts).search(counts) for a, b in zip(q, e)}
    near = {(i, j) for i, a in enumerate(texts) for j, b in enumerate(texts) if near_by_definition(a, b)}
    assert near <= met and len(met) < 0.2 * len(texts) ** 2
    for i, j in met:
        gap = counts[j] - counts[i]
        assert gap[gap > 0].sum() <= 1 and gap[gap < 0].sum() >= -1


def test_verification():
    texts = ["abcde", "abcdf", "abcd", "bcde", "abcdee", "axbcde", "edcba", "e" * 70, "e" * 71, "e" * 64, "e" * 65]
    a, b = (np.array(x) for x in zip(*((i, j) for i in range(len(texts)) for j in range(len(texts)))))
    want = [near_by_definition(texts[i], texts[j]) for i, j in zip(a, b)]
    assert spelling._Letters(texts).near(a, b).tolist() == want


def test_query_over_a_whole_table(spark):
    tune(spark)
    folder = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    rows = [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]
    assert got(spelling.op13_spelling_variants(spark, folder)) == expected(vocabulary(rows))


def test_texts_with_nulls_repeats_and_other_letters(spark):
    tune(spark)
    long = "verylongwordindeed" * 3000
    texts = [(1, "Überall überall ÜBERALL überal überall"), (None, "naïve×naïve÷ naïve naive naive naive naive ñandú ñandú ñandú"), (2, None), (3, ""), (4, "12345 ¿?"),
             (5, "Ωmega-three three three three threе İstanbul stanbul stanbul stanbul"), (6, f"{long} {long} {long} {long}x {long}x {long}x")]
    rows = [*texts, *texts]
    schema = "doc_id long, text string, word string, n string, shard long"
    df = spark.createDataFrame([(*r, "w", "n", 1) for r in rows], schema)
    counts = vocabulary(rows)
    out = got(spelling.variants(spelling.words(df, df["doc_id"], df["text"], spelling.typed)))
    assert out == expected(counts) and len(out) > 5
    empty = spelling.variants(spelling.words(df.limit(0), df["doc_id"], df["text"]))
    assert empty.collect() == [] and empty.columns == ["word", "form", "root", "n", "n_near", "form_n"]
