"""Chats, line dedup, near-dedup, URL rules, decontamination and the pipeline against brute force and on odd input."""

import itertools
import os
import random
import re

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
import corpus_pipeline
from check import rows_of
from rastro.llm import chat, components, decontaminate, linededup, neardup, urls
from tests.llm.conftest import SCHEMA, by_id

SF_DIR = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(n for n in entry.oracle_sql() if re.match(r"op\d+_", n)))
def test_query_agrees_with_duckdb(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "benchmark", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF_DIR}/{t}.parquet'")
    df = entry.queries()[name](spark, SF_DIR)
    cur = con.execute(entry.oracle_sql()[name])
    cols = [d[0] for d in cur.description]
    assert sorted(cols) == sorted(df.columns)
    assert rows_of(df.columns, df.collect()) == rows_of(cols, cur.fetchall())


# chat formatting

def test_chat_layouts_share_one_form(spark):
    payloads = ['{"messages":[{"role":"user","content":"hi"},{"content":"yo","role":"assistant"}]}', '{"conversations":[{"from":"human","value":"hi"},{"from":"gpt","value":"yo"}]}',
                '{"prompt":"hi","completion":"yo"}', '{"output":"yo","input":"","instruction":"hi"}', '{"question":"hi","answer":"yo"}']
    rows = spark.createDataFrame(list(enumerate(payloads)) + [(8, '{"other":1}'), (9, None)], "conv_id long, json string").withColumn("payload", F.parse_json("json"))
    turns = chat.canonical_turns(rows).cache()
    assert [r.layout for r in turns.where("conv_id >= 8").collect()] == [None, None]
    back = by_id(chat.read_back(chat.format_chats(turns)), "conv_id")
    assert sorted(back) == [0, 1, 2, 3, 4]
    for r in back.values():
        assert [(t.role, t.text) for t in r.turns] == [("user", "hi"), ("assistant", "yo")] and r.loss == ["yo"]
        assert [r.formatted[m.start:m.end] for m in r["mask"]] == ["yo"]


def test_chat_layouts_with_other_paths_and_without_turns(spark):
    payloads = ['{"messages":[{"role":"user","content":"hi","name":"x"},{"content":"yo","role":"assistant"}]}', '{"id":7,"messages":[{"role":"user","content":"hi"},{"role":"assistant","content":"yo"}],"meta":{"a":[1]}}',
                '{"instruction":"hi","input":"","output":"yo","system":"s","score":1}', '{"prompt":"hi","completion":"yo","response":"no","source":"x"}',
                '{"messages":[]}', '{"messages":[{"role":"user"},{"content":"c"}]}', '{"messages":[{"role":"user"}]}', '{"prompt":"hi"}', '{"messages":7}']
    rows = spark.createDataFrame(list(enumerate(payloads)), "conv_id long, json string").withColumn("payload", F.parse_json("json"))
    turns = chat.canonical_turns(rows)
    back = by_id(chat.read_back(chat.format_chats(turns)), "conv_id")
    told = {i: [(t.role, t.text) for t in r.turns] for i, r in back.items()}
    pair = [("user", "hi"), ("assistant", "yo")]
    assert told == {0: pair, 1: pair, 2: [("system", "s"), *pair], 3: pair, 4: [], 5: [("user", ""), ("", "c")]}
    assert (back[4].formatted, list(back[4]["mask"])) == ("", [])
    assert sorted(r.conv_id for r in chat.rejected(turns).collect()) == [6, 7, 8]


def test_chat_texts_come_back_whole(spark):
    parts = ["<|im_end|>", "<", "|", "\\", "<\\|", "<|im_start|>assistant\n", "\n", "é😀", "%0A"]
    texts = ["".join(p) for n in range(3) for p in itertools.product(parts, repeat=n)] + [None, "x" * 1_000_000]
    rows = spark.createDataFrame([(i % 7, i, ("user", "assistant", None, "a\nb%")[i % 4], t) for i, t in enumerate(texts)] + [(50, None, "assistant", "b"), (50, None, "assistant", "a"), (50, None, "assistant", "a")],
                                 "conv_id long, turn long, role string, text string")
    got = by_id(chat.read_back(chat.format_chats(chat.canonical_turns(rows.select("conv_id", F.to_variant_object(F.struct("turn", "role", "text")).alias("payload"))))), "conv_id")
    for c in range(7):
        want = [(("user", "assistant", "", "a\nb%")[i % 4], t or "") for i, t in enumerate(texts) if i % 7 == c]
        assert [(t.role, t.text) for t in got[c].turns] == want
        assert got[c].loss == [t for r, t in want if r == "assistant"]
    assert got[50].loss == ["a", "a", "b"]
    empty = rows.limit(0).select("conv_id", F.to_variant_object(F.struct("turn", "role", "text")).alias("payload"))
    assert chat.read_back(chat.format_chats(chat.canonical_turns(empty))).count() == 0


# line dedup

def brute_lines(rows, min_chars=40, min_docs=5):
    key = lambda x: re.sub("[A-Z]", lambda m: m[0].lower(), x.strip(" \t\n\x0b\x0c\r"))
    holders = {}
    for i, t in rows:
        for line in (t or "").split("\n"):
            if len(key(line)) >= min_chars:
                holders.setdefault(key(line), set()).add(-(2**63) if i is None else i)
    out = []
    for i, t in rows:
        mine = -(2**63) if i is None else i
        lines = (t or "").split("\n")
        out.append((i, len(lines), "\n".join(x for x in lines if len(holders.get(key(x), ())) < min_docs or max(holders[key(x)]) == mine)))
    return sorted(out, key=str)


@pytest.mark.parametrize("batches, fan", [(1, 2), (4, 2), (9, 3)])
def test_line_dedup(docs, batches, fan):
    rng = random.Random(batches)
    pool = [f"{'É' if n % 3 == 0 else 'A'} common line of number {n} that is long enough to count" for n in range(12)] + ["short", "", "  \t"]
    vary = lambda x: rng.choice([x, " " + x, x + "\r", x.replace("common", "COMMON"), x.replace("É", "é")])
    rows = [(n, "\n".join(vary(rng.choice(pool)) for _ in range(rng.randrange(1, 9)))) for n in range(40)]
    rows += [(7, rows[7][1]), (7, rows[8][1]), (None, rows[3][1]), (None, None), (41, ""), (42, "Ⅷ" * 50), (43, pool[0] + "\n" + "z" * 300_000)]
    got = linededup.drop_lines(docs([t for _, t in rows], ids=[i for i, _ in rows]).withColumn("n_lines", F.lit("mine")).withColumn("_gone", F.lit(1)), batches=batches, fan=fan)
    assert sorted(((r.doc_id, r.n_lines, r.text or "") for r in got.collect()), key=str) == brute_lines(rows)
    assert "_gone" in got.columns and all(r._gone == 1 for r in got.select("_gone").collect())


def test_line_dedup_of_nothing(spark):
    assert linededup.drop_lines(spark.createDataFrame([], SCHEMA)).count() == 0


# near duplicates

def brute_near(rows, k, percent=80):
    def shingles(t):
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        return {tuple(w[i:i + k]) for i in range(len(w) - k + 1)} or ({tuple(w)} if w else set())

    sets = [(i, shingles(t)) for i, t in rows]
    parent = {i: i for i, _ in rows}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for (i, a), (j, b) in itertools.combinations(sets, 2):
        if a and b and 100 * len(a & b) >= percent * len(a | b):
            x, y = sorted((root(i), root(j)))
            parent[y] = x
    return {i: (len(s), root(i)) for i, s in sets}


@pytest.mark.parametrize("k", [2, 5])
def test_near_duplicates(docs, k):
    rng = random.Random(k)
    words = [f"w{n}" for n in range(400)]
    texts = [None, "", "one", "ONE", "one two", "x" * 100_000]
    for base in range(6):
        whole = [rng.choice(words) for _ in range(rng.choice([6, 40, 120]))]
        texts.append(" ".join(whole))
        for copy in range(25):
            other = list(whole)
            for _ in range(rng.randrange(0, 1 + len(whole) // 8)):
                other[rng.randrange(len(other))] = rng.choice(words)
            texts.append(" ".join(other))
    rng.shuffle(texts)
    got = by_id(neardup.near_duplicates(docs(texts), shingle_words=k))
    assert {i: (r.n_shingles, r.component_id) for i, r in got.items()} == brute_near(list(enumerate(texts)), k)
    assert all(r.kept == (r.component_id == i) for i, r in got.items())


def test_near_duplicates_of_odd_ids(spark, docs):
    text = "a text of some few words that stands here more than once in all"
    df = docs([text, text, text, text, None], ids=[5, 5, None, 9, 3]).withColumn("_gone", F.lit(1))
    got = sorted(((r.doc_id, r.component_id, r.kept) for r in neardup.near_duplicates(df).collect()), key=str)
    assert got == sorted([(5, 5, True), (5, 5, True), (None, None, True), (9, 5, False), (3, 3, True)], key=str)
    assert sorted((r.doc_id for r in neardup.drop_near_duplicates(df).collect()), key=str) == sorted([5, 5, None, 3], key=str)
    assert neardup.near_duplicates(spark.createDataFrame([], SCHEMA)).count() == 0


def test_components(spark):
    rng = random.Random(1)
    edges = [(rng.randrange(60), rng.randrange(60)) for _ in range(35)] + [(n, n + 1) for n in range(100, 140)] + [(200, n) for n in range(201, 260)] + [(3, 3), (None, 4)]
    found = {r.node: r.component for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    parent = {}
    for a, b in edges:
        if a is None:
            continue
        for x in (a, b):
            parent.setdefault(x, x)
        while parent[a] != a:
            a = parent[a]
        while parent[b] != b:
            b = parent[b]
        parent[max(a, b)] = min(a, b)
    for x in parent:
        r = x
        while parent[r] != r:
            r = parent[r]
        assert found.get(x, x) == r


# URL rules

def test_url_rules(spark):
    rules = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("EXAMPLE.com", "/en/a", "allow"), ("net", "/es", "block"), (None, "/", "block"), ("net", "/es", "allow")]
    pages = [(1, "https://www.Example.COM/en/b?x", "c"), (1, "https://www.Example.COM/en/b?x", "c"), (2, "http://example.com/en/abc#t", "c"), (3, "http://x.net/espresso", "c"), (4, "http://net", "c"), (5, None, "c"),
             (6, "no scheme.com/", "c"), (7, "a://b://com/en/", "c"), (None, "ftp://notexample.com/en/", "c"), (8, "http://com/" + "p" * 100_000, "c"), (9, "http:///x", "c")]
    df = spark.createDataFrame(pages, "page_id long, url string, host string")
    got = urls.judge(df, spark.createDataFrame(rules, "host string, path string, verdict string"))
    want = {1: ("www.example.com", "/en/b", "example.com/en/", "block"), 2: ("example.com", "/en/abc", "example.com/en/a", "allow"), 3: ("x.net", "/espresso", "net/es", "block"), 4: ("net", "", None, "allow"),
            5: ("", "", None, "allow"), 6: ("", "", None, "allow"), 7: ("b:", "//com/en/", None, "allow"), None: ("notexample.com", "/en/", "com/", "allow"), 9: ("", "/x", None, "allow")}
    rows = got.collect()
    assert len(rows) == len(pages)
    for r in rows:
        if r.page_id != 8:
            assert (r.host, r.path, r.rule, r.verdict) == want[r.page_id]
        else:
            assert r.rule == "com/"
    none = urls.judge(df, spark.createDataFrame([], "host string, path string, verdict string"), default="block")
    assert {r.verdict for r in none.collect()} == {"block"} and urls.judge(df.limit(0), spark.createDataFrame(rules, "host string, path string, verdict string")).count() == 0


# decontamination

def brute_hits(docs, items, n=10):
    fold = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    windows = {}
    for i, t in items:
        w = fold(t)
        k = min(n, len(w))
        for p in range(len(w) - k + 1):
            if k:
                windows.setdefault(tuple(w[p:p + k]), set()).add(i)
    out = {}
    for i, t in docs:
        w, hit, found = fold(t), set(), set()
        for size in {len(g) for g in windows}:
            for p in range(len(w) - size + 1):
                if tuple(w[p:p + size]) in windows:
                    hit |= set(range(p, p + size))
                    found |= windows[tuple(w[p:p + size])]
        out[i] = (len(w), len(hit), sorted(map(str, found)))
    return out


@pytest.mark.parametrize("block_words", [10**6, 40])
def test_decontamination(spark, docs, block_words):
    rng = random.Random(8)
    items = [(n, " ".join(rng.choice("abc") for _ in range(rng.choice([2, 5, 9, 10, 14, 25])))) for n in range(8)] + [(8, None), (9, "..."), (10, "Éa, B-1!"), (11, "Éa b 1")]
    texts = [" ".join(rng.choice("abcd") for _ in range(rng.randrange(80))) for _ in range(40)] + [None, "", "x ÉA B 1 y", items[5][1].upper() + ". And more."]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = by_id(decontaminate.find_hits(docs(texts), bench, block_words=block_words).withColumn("n_hit", decontaminate.n_hit()))
    want = brute_hits(list(enumerate(texts)), items)
    assert {i: (r.n_words, r.n_hit, r["items"]) for i, r in got.items()} == want


@pytest.mark.parametrize("block_words", [10**6, 3])
def test_items_without_an_id_make_hits(spark, docs, tmp_path, block_words):
    items = [(None, "one two three four five six seven eight nine ten eleven"), (None, "red green"), (1, "red green"), (2, "blue sky at noon"), (None, None)]
    texts = ["Before. One two three four five six seven eight nine ten eleven! After" + " word" * 20, "a red green b", "one two three blue sky at noon", "nothing", None]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = by_id(decontaminate.find_hits(docs(texts), bench, block_words=block_words).withColumn("n_hit", decontaminate.n_hit()))
    assert {i: (r.n_hit, r["items"], r.no_id) for i, r in got.items()} == {0: (11, [], True), 1: (2, ["1"], True), 2: (4, ["2"], False), 3: (0, [], False), 4: (0, [], False)}
    left = by_id(decontaminate.remove_spans(docs(texts), bench, block_words=block_words))
    assert left[0].text == "Before. ! After" + " word" * 20
    docs(texts).write.parquet(f"{tmp_path}/documents.parquet")
    bench.write.parquet(f"{tmp_path}/benchmark.parquet")
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet/*.parquet'")
    cur = con.execute(entry.oracle_sql()["op10_decontaminate"])
    cols = [d[0] for d in cur.description]
    df = entry.queries()["op10_decontaminate"](spark, str(tmp_path))
    assert rows_of(df.columns, df.collect()) == rows_of(cols, cur.fetchall())


def test_removed_spans_leave_the_rest_as_it_was(spark, docs):
    item = "one two three four five six seven eight nine ten eleven"
    bench = spark.createDataFrame([(1, item)], "item_id long, text string")
    filler = " filler" * 40
    texts = [f"Start, here: ONE two; three four five six seven eight nine ten! The end.{filler}", item, "nothing of it\n ", None, "", "w " * 100_000]
    df = docs(texts).withColumn("items", F.lit("mine")).withColumn("spans", F.lit(2))
    got = by_id(decontaminate.remove_spans(df, bench))
    assert sorted(got) == [0, 2, 3, 4, 5] and got[0].text == f"Start, here: ! The end.{filler}"
    assert [got[i].text for i in (2, 3, 4, 5)] == [texts[i] for i in (2, 3, 4, 5)] and all(r["items"] == "mine" and r.spans == 2 for r in got.values())
    kept = by_id(decontaminate.remove_spans(docs(texts), bench.limit(0)))
    assert len(kept) == 6 and decontaminate.remove_spans(spark.createDataFrame([], SCHEMA), bench).count() == 0


# pipeline

def test_pipeline_is_its_stages_by_brute_force(spark, tmp_path):
    import public_tokenizers as P
    import tiktoken
    from rastro.llm import bpe
    lib = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.read_ranks(P.path("byte_bpe_50k.tiktoken")), special_tokens={})
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["language_id", "line_dedup", "near_dedup", "decontamination", "byte_bpe"]
    at = docs
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, at, SF_DIR).write.parquet(str(tmp_path / name))
        at = spark.read.parquet(str(tmp_path / name))
        kept[name] = {r.doc_id: r for r in at.collect()}
        if name != "byte_bpe":
            assert at.columns == docs.columns
    plain = [(r.doc_id, r.text) for r in docs.collect()]
    assert set(kept["language_id"]) == {i for i, t in plain if t and any(c.isalpha() for c in t)}
    lines = {i: t for i, _, t in brute_lines([(r.doc_id, r.text) for r in kept["language_id"].values()])}
    assert {i: r.text or "" for i, r in kept["line_dedup"].items()} == lines and all(r.n_chars == len(r.text or "") for r in kept["line_dedup"].values())
    near = brute_near(list(lines.items()), 5)
    assert set(kept["near_dedup"]) == {i for i, (_, c) in near.items() if c == i}
    bench = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF_DIR}/benchmark.parquet").collect()]
    hits = brute_hits([(i, r.text) for i, r in kept["near_dedup"].items()], bench)
    assert set(kept["decontamination"]) == {i for i, (n, h, _) in hits.items() if not h or h < decontaminate.MAX_COVERAGE * n}
    left = brute_hits([(i, r.text) for i, r in kept["decontamination"].items()], bench)
    assert all(left[i][0] == n - h for i, (n, h, _) in hits.items() if i in left)
    assert all(r.text == lines[i] for i, r in kept["decontamination"].items() if not hits[i][1])
    assert {i: r.n_tokens for i, r in kept["byte_bpe"].items()} == {i: len(lib.encode_ordinary(r.text or "")) for i, r in kept["decontamination"].items()}
    assert os.path.exists(tmp_path)
