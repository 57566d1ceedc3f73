"""Secrets, BPE, licenses, language ID and quality rules against brute force and on odd input."""

import hashlib
import random
import re

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from rastro.llm import bpe, langid, licenses, quality, secrets
from tests.llm.conftest import SCHEMA, by_id

RANKS = P.path("byte_bpe_50k.tiktoken")
LIB = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.read_ranks(RANKS), special_tokens={})
VOCABULARY = bpe.Vocabulary(bpe.read_ranks(RANKS))
ODD = [None, "", " ", "\n\n", "a", "<|endoftext|> don't we'll 'S", "x" * 5000, "é" * 700, "日本語" * 300, "1" * 900, "a\x1cb \x1d c\x85d\u3000 e  \x1f  f", "ab " * 40_000, "\x00\ufffe😀 \t x"]


# byte-level BPE

@settings(max_examples=200, deadline=None)
@given(st.text(max_size=60))
def test_bpe_is_the_librarys(text):
    ids = bpe.Encoder(VOCABULARY, P.PATTERN).encode([text])[0].tolist()
    assert ids == LIB.encode_ordinary(text)
    assert VOCABULARY.decode(ids) == text.encode()


def test_bpe_long_pieces_by_matrix_and_heap_agree(monkeypatch):
    pieces = [bytes(random.Random(n).choice(b"abethn ") for _ in range(n)) for n in (2, 9, 64, 300, 511)] + [b"a" * 400, "é".encode() * 200]
    by_matrix = VOCABULARY.encode_pieces(pieces)
    monkeypatch.setattr(bpe, "LONG", 2)
    assert VOCABULARY.encode_pieces(pieces) == by_matrix


def test_bpe_memory_that_overflows_changes_nothing(monkeypatch):
    monkeypatch.setattr(bpe, "REMEMBERED", 5)
    encoder = bpe.Encoder(VOCABULARY, P.PATTERN)
    texts = ["the cat sat on the mat, oddly", "an other one, with other words", "the cat"] * 3
    assert [i.tolist() for t in texts for i in encoder.encode([t])] == [LIB.encode_ordinary(t) for t in texts]


def test_bpe_query_form_and_round_trip(spark, docs):
    df = docs(ODD + ["same", "same"], ids=list(range(len(ODD))) + [7, None])
    got = bpe.digests(df, RANKS, P.PATTERN).collect()
    assert len(got) == len(ODD) + 2
    for r, t in zip(sorted(got, key=lambda r: (r.doc_id is None, r.doc_id))[:5], ODD):
        want = LIB.encode_ordinary(t or "")
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(want), hashlib.sha256(" ".join(map(str, want)).encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest())
    full = by_id(bpe.encode_and_decode(docs(ODD), RANKS, P.PATTERN))
    assert all(bytes(full[i].decoded) == (t or "").encode() and full[i].ids == LIB.encode_ordinary(t or "") for i, t in enumerate(ODD))
    assert bpe.digests(spark.createDataFrame([], SCHEMA), RANKS, P.PATTERN).count() == 0


# secrets

def brute_base(text):
    out = []
    for kind, pattern, group, least, flags in (("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6, re.I | re.A),
                                               ("access", r"AKIA[A-Z0-9]+", 0, 20, 0), ("hex", r"[0-9a-f]+", 0, 24, 0)):
        out += [(m.start(), ("assign", "access", "hex").index(kind), kind, m.end()) for m in re.finditer(pattern, text, flags) if len(m[group]) >= least]
    return [(k, s, e) for s, _, k, e in sorted(out)]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from(["token", " = ", ":", '"', "PassWord", "api_key", "apikey=", "AKIA", "ABCDEFGHIJ0123456789", "deadbeef" * 3, "a0", "é", "\n", "secret=", "abc", "K", "ſecret=abcdefgh"]), max_size=12))
def test_secret_patterns(parts):
    text = "".join(parts)
    assert [s[:3] for s in secrets.base_spans(text)] == brute_base(text)


def test_secret_models_add_spans_and_keep_the_base(spark, docs):
    rng = random.Random(5)
    rand = lambda n: "".join(rng.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789") for _ in range(n))
    words = ["customer", "account", "record", "billing", "address", "update", "handler", "service", "manager", "request"]
    plain = lambda: "_".join(rng.choice(words) for _ in range(4))
    samples = spark.createDataFrame([(rand(32), 1) for _ in range(200)] + [(plain(), 0) for _ in range(400)] + [(None, 1)], "value string, label int")
    hidden = rand(40)
    texts = [f"use {hidden} here", f"call {plain()} now", 'é token = "abcdef123456" and ' + "0123456789abcdef" * 2, None, "", "word " * 50_000]
    got = by_id(secrets.find_secrets(docs(texts), samples=samples))
    assert [(s.kind, s.start, s.end) for s in got[0].spans] == [("markov", 4, 44)]
    assert got[1].spans == [] and got[3].spans == [] and got[4].spans == [] and got[5].spans == []
    assert [(s.kind, s.start, s.end) for s in got[2].spans] == brute_base(texts[2])
    # A tiny table has the seed's models: the same is found, twice where a row stands twice.
    assert [r.spans for r in secrets.find_secrets(docs(texts + texts, ids=[*range(6), *range(6)])).orderBy("doc_id").collect()][::2] == [got[i].spans for i in range(6)]
    assert secrets.find_secrets(spark.createDataFrame([], SCHEMA)).count() == 0


def test_secrets_that_no_pattern_names_in_a_corpus(spark, docs):
    """Planted random strings are found by the ratio alone, with models from the seed and the corpus; ordinary tokens stay."""
    rng = random.Random(8)
    planted = [v for v, label in secrets.seed_samples(60, seed=21) if label == 1 and not re.fullmatch(r"[0-9a-f]{24,}", v)]
    calm = [v for v, label in secrets.seed_samples(300, seed=22) if label == 0]
    texts = [f"see {rng.choice(calm)} then {v} and {rng.choice(calm)}" for v in planted] + [" ".join(rng.choices(calm, k=30)) for _ in range(40)]
    got = by_id(secrets.find_secrets(docs(texts)))
    hit = [any(s.kind == "markov" and s.value in v for s in got[i].spans) for i, v in enumerate(planted)]
    extra = sum(len([s for s in r.spans if s.kind == "markov"]) for r in got.values()) - sum(hit)
    assert sum(hit) >= 0.95 * len(planted) and extra <= 0.05 * len(planted)


def test_secret_models_on_held_out_samples():
    table = secrets._table(secrets.seed_counts(secrets.seed_samples()))
    values, labels = zip(*secrets.seed_samples(2000, seed=99))
    hit, label = secrets.is_random(table, list(values)), np.array(labels) == 1
    assert (hit & label).sum() >= 0.99 * label.sum() and (hit & label).sum() >= 0.99 * hit.sum()
    # The ratio decides: without it every long token would be a secret.
    assert not hit[~label].any() or hit[~label].mean() < 0.01
    assert np.allclose(secrets.ratios(table, ["abc123xyz", "x"]), [table[secrets.steps(v)].sum() for v in ("abc123xyz", "x")])


# licenses

def test_licenses_are_confirmed_by_wording(spark, docs):
    mit = licenses.TEMPLATES[2][1]
    texts = ["Some words.\nReleased under the MIT License.\nMore words here.", mit.replace("free of charge", "at no charge"), "He has a driving licence and a copyright on it, which is no notice of anything at all.",
             None, "", "x " * 100_000 + "\nLicensed under CC BY-NC 4.0.\n", "In a line. Licensed under the Apache License, Version 2.0. And more of it."]
    got = by_id(licenses.scan(docs(texts)))
    names = {i: [x.license for x in r.licenses] for i, r in got.items()}
    assert names == {0: ["MIT"], 1: ["MIT"], 2: [], 3: [], 4: [], 5: ["CC-BY-NC-4.0"], 6: ["Apache-2.0"]}
    assert got[1].licenses[0].missing == ["free", "of"] and got[1].licenses[0].added == ["at", "no"]
    first = got[0].licenses[0]
    assert texts[0][first.start:first.end] == "Released under the MIT License."
    assert licenses.scan(spark.createDataFrame([], SCHEMA)).count() == 0
    assert all(r.licenses == [] for r in licenses.scan(docs(texts), templates=()).collect())


def test_licenses_over_line_ends_and_before_their_cue(spark, docs):
    mpl, apache, bsd = licenses.TEMPLATES[10][1], licenses.TEMPLATES[4][1], licenses.TEMPLATES[11][1]
    wrap = lambda text, n, mark: "\n".join(mark + " ".join(text.split()[i:i + n]) for i in range(0, len(text.split()), n))
    texts = ["// This Source Code Form is subject to the terms of the Mozilla Public\n// License, v. 2.0. If a copy of the MPL was not distributed with this\n"
             "// file, You can obtain one at https://mozilla.org/MPL/2.0/.\nint x;", "This work is dedicated\nto the public domain.\nMore.", "dedicated. This work is dedicated to the public\n * domain.",
             "x = 1\nLicensed under the Apache License,\nVersion 2.0.\nAnd other words that go on and on, without a break.", "Licensed under CC\nBY 4.0.", "Licensed under CC BY 3.0.", "Licensed under CC BY\n3.0.",
             "Licensed under the Apache License, Version 1.1.", "ALL RIGHTS\nRESERVED.", "All\n\n# rights reserved. " + "The licence of it. " * 3000 + "All rights reserved."]
    texts += [wrap(t, n, mark) for t in (mpl, apache, bsd) for n in (1, 3, 7) for mark in ("", "# ", " * ", "#")]
    got = by_id(licenses.scan(docs(texts)))
    names = {i: [x.license for x in r.licenses] for i, r in got.items()}
    want = [["MPL-2.0"], ["public-domain"], ["public-domain"], ["Apache-2.0"], ["CC-BY-4.0"], [], [], [], ["all-rights-reserved"], ["all-rights-reserved"] * 2]
    want += [[x] for x in ("MPL-2.0", "Apache-2.0", "BSD") for _ in range(12)]
    assert names == dict(enumerate(want))
    assert all(x.n_other == 0 for r in got.values() for x in r.licenses)
    assert texts[3][got[3].licenses[0].start:got[3].licenses[0].end] == "Licensed under the Apache License,\nVersion 2.0."


def test_compression_ranks_templates_and_wording_confirms(spark, docs, monkeypatch):
    by = {}
    for name, text in licenses.TEMPLATES:
        by.setdefault(name, []).append(text)
    # As many other words from either version; the marks, which are no words, save more with one.
    gpl3, gpl2 = by["GPL-3.0"][1].replace("version 3", "version 4"), by["GPL-2.0"][1].replace("version 2", "version 4")
    whole = [by["MIT"][-1], by["BSD-2-Clause"][0], by["BSD-3-Clause"][0], by["Zlib"][0], by["Unlicense"][0]]
    two = f"{by['CC-BY-NC-4.0'][0]} Some text. {by['CC-BY-4.0'][0]}"
    texts = [gpl3, gpl2, *whole, two, "Copies of all kinds are reserved rights here: a licence to redistribute free software is no notice.", " ".join([by["MIT"][0], "x"] * 900)]
    got = by_id(licenses.scan(docs([*texts, *texts], ids=range(2 * len(texts)))))
    want = [["GPL-3.0"], ["GPL-2.0"], ["MIT"], ["BSD-2-Clause"], ["BSD-3-Clause"], ["Zlib"], ["Unlicense"], ["CC-BY-NC-4.0", "CC-BY-4.0"], [], ["MIT"] * 900]
    assert {i: [x.license for x in r.licenses] for i, r in got.items()} == dict(enumerate(want + want))
    matcher = licenses.Matcher(licenses.TEMPLATES)
    stream = matcher.stream(gpl3)
    saved = matcher.savings(gpl3)
    assert saved[6] > saved[8] and saved[6] == max(saved)  # GPL-3.0 before GPL-2.0
    # Without the saving nothing is a candidate.
    monkeypatch.setattr(matcher, "savings", lambda block: [0] * len(matcher.templates))
    assert matcher.matches(stream) == []


# language ID

def test_kneser_ney_probabilities_sum_to_one():
    import numpy as np
    words = {"aa": ["anna", "banana", "nab", "ban"] * 3, "bb": ["toto", "otto", "tot"] * 2}
    counted = {}
    for lang, ws in words.items():
        codes, _ = langid._codes(ws, 3)
        grams, n = np.unique(codes, axis=0, return_counts=True)
        counted[lang] = (grams, n.astype(float))
    model = langid.fit(counted, 3)
    last = sorted({c for g, _ in counted.values() for c in g[:, -1].tolist()})
    for context in ([2, 2], [2, ord("a")], [ord("a"), ord("n")], [ord("n"), ord("t")], [ord("z"), ord("z")]):
        grams = np.array([context + [c] for c in last], dtype=np.uint32)
        unseen = np.array([context + [ord("q")]], dtype=np.uint32)
        total = np.exp(model.of_grams(grams)).sum(axis=0) + np.exp(model.of_grams(unseen))[0]  # all letters, and one for all unknown ones
        assert np.allclose(total, 1, atol=1e-4)


def test_language_held_out_accuracy(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    from __spark_entry__ import queries
    got = queries()["op6_language_id"](spark, "/root/testdata/sf0.01").join(df.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert len(got) > 150 and sum(r.lang == r.lang_pred for r in got) >= 0.98 * len(got)
    assert all(0 <= r.score <= 1 for r in got) and not any(r.rejected for r in got)
    rng = random.Random(1)
    noise = [" ".join("".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randrange(2, 12))) for _ in range(n)) for n in (5, 20, 200)]
    model = langid.train(df.where(~langid.held_out("doc_id")))
    assert all(r.rejected for r in langid.score(spark.createDataFrame(list(enumerate(noise)), "doc_id long, text string"), model).collect())


def test_language_of_odd_texts(spark, docs):
    rng = random.Random(2)
    en, fr = ["the", "of", "and", "house", "water", "with"], ["le", "de", "et", "maison", "eau", "avec"]
    texts = [" ".join(rng.choice(w) for _ in range(30)) for w in (en, fr) * 120]
    labelled = docs(texts + [None, ""], ids=list(range(242)), lang=["en", "fr"] * 120 + ["en", None])
    model = langid.train(labelled)
    odd = docs([None, "", "123 ½ !!", "the house", "le maison", "qzxj vkqw zzkq " * 50, "the " * 100_000])
    got = by_id(langid.score(odd, model))
    assert [got[i].lang_pred for i in range(3)] == ["und"] * 3 and all(got[i].score == 0 and got[i].rejected for i in range(3))
    assert (got[3].lang_pred, got[4].lang_pred) == ("en", "fr") and not got[3].rejected and not got[6].rejected
    none = by_id(langid.score(odd, langid.train(spark.createDataFrame([], SCHEMA))))
    assert {r.lang_pred for r in none.values()} == {"und"}
    kept = langid.keep_identified(labelled)
    assert kept.columns == labelled.columns and {r.doc_id for r in kept.collect()} == set(range(240))


@pytest.mark.parametrize("n_large, n_rare", [(120, 1), (120, 6), (120, 30), (8, 3)])
def test_language_of_few_documents_rejects_too(spark, docs, n_large, n_rare):
    rng = random.Random(n_rare)

    def word(syllables, ends):
        return "".join(rng.choice(syllables) for _ in range(rng.randrange(1, 4))) + rng.choice(ends)

    def lexicon(syllables, ends):
        return [word(syllables, ends) for _ in range(300)]

    kinds = {"aa": lexicon(["the", "wa", "ter", "ing", "con", "st"], ["s", "ed", "er"]), "bb": lexicon(["le", "mai", "son", "eau", "qu"], ["e", "es", "ant"]), "rr": lexicon(["ka", "uu", "tal", "ois", "mi"], ["n", "ssa", "lla"])}
    text = lambda kind, n=80: " ".join(rng.choice(kinds[kind]) for _ in range(n))
    labels = ["aa", "bb"] * n_large + ["rr"] * n_rare
    model = langid.train(docs([text(k) for k in labels], lang=labels))
    assert "rr" in model.langs and set(model.limits) == set(model.langs)
    noise = [" ".join("".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randrange(2, 12))) for _ in range(n)) for n in (30, 60, 200, 1000) * 5]
    foreign = [" ".join("".join(rng.choice("жзийклмнопрст") for _ in range(7)) for _ in range(50))]
    got = by_id(langid.score(docs(noise + foreign), model))
    assert all(r.rejected for r in got.values())
    real = by_id(langid.score(docs([text(k) for k in ("aa", "bb", "rr") * 20]), model))
    assert not any(r.rejected for r in real.values()) and {r.lang_pred for r in real.values()} == {"aa", "bb", "rr"}
    # gibberish is rejected where it lands in the rare language as well
    limit, per_letter = model.limits["rr"]
    assert np.isfinite(limit) and model.rejects("rr", limit + 4 * per_letter**0.5, 1) and not model.rejects("rr", limit, 100)


# quality rules

def brute_repeated(words, n=8):
    windows = {}
    for i in range(len(words) - n + 1):
        windows.setdefault(tuple(words[i:i + n]), []).append(i)
    return len({i + k for at in windows.values() if len(at) > 1 for i in at for k in range(n)})


def test_quality_measures(spark, docs):
    rng = random.Random(4)
    texts = [" ".join(rng.choice("ab") for _ in range(rng.randrange(60))) for _ in range(30)]
    texts += [None, "", "\n \n", "a b c d e f g h " * 4, "x # | <y>\nx # | <y>\n\n\u00a0z", "The The " * 20_000]
    got = by_id(quality.judge(docs(texts)))
    for i, t in enumerate(texts):
        t = t or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", t)
        lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        want = (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), brute_repeated(words))
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want, i
        assert r.base_failed == (want[0] < 20 or 100 * want[4] > 30 * want[0])
        assert not (r.base_failed and r.kept)


def test_quality_is_one_projection(spark, docs):
    plan = quality.judge(docs(["a"]).withColumn("_words", __import__("pyspark").sql.functions.lit(1)))._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Exchange|Python|Arrow|Join", plan)
    assert quality.judge(spark.createDataFrame([], SCHEMA)).count() == 0
    none = quality.judge(docs(["some words"]), rules=(), base=()).first()
    assert none.kept and not none.base_failed
