"""Secret scans: fixed patterns, and character Markov models compared by their log-likelihood ratio.

The patterns find assignments of passwords and keys, access key ids and long hexadecimal strings. Two
first-order character models add strings that no pattern names: one of random strings, one of ordinary identifiers. Both
are trained from labelled samples: a seed of generated ones, so that they always exist, and the corpus' own, each value
once: what the patterns have found is random, and long tokens that the seed's models call ordinary are ordinary. A token whose
log-likelihood ratio is high, in total and per character, is a finding.

Texts are read once for the samples and once to be scored; nothing found is written anywhere but into the result. The
models' size is that of the alphabet squared.
"""

from __future__ import annotations

import random
import re
import string

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rastro.llm.common import ddl_type, map_rows, read

#: The patterns of the contract; letters of the key words in either case.
_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
ASSIGN_CHARS, ACCESS_CHARS, HEX_CHARS = 6, 20, 24
#: A greedy run of 24 or more starts where a run of any length would, so shorter ones need not be seen.
_HEX = re.compile(r"[0-9a-f]{%d,}" % HEX_CHARS)
BASE_KINDS = ("assign", "access", "hex")

#: A shorter token can't be far enough ahead.
TOKEN_CHARS = 8
_TOKEN = re.compile(r"[A-Za-z0-9+/_=-]{%d,}" % TOKEN_CHARS)
#: Nats that the random model must be ahead: in total, and per character.
AHEAD, AHEAD_PER_CHAR = 10.0, 0.35
#: Pseudo-counts of each following character.
SMOOTHING = 0.5
#: Generated samples of each label.
SEED_SAMPLES = 4000

# Words that identifiers are made of.
IDENTIFIER_WORDS = (
    "account action active address admin amount array article author balance batch block buffer build button cache call category change channel check child class client "
    "close code collection color column command comment config connection container content context control count country create current data database date default delete "
    "description detail device direction document domain download edit element email enable encoding entity entry error event example export external factory feature field file filter "
    "folder format frame function group handler header height history image import index information input instance integer interface internal item iterator label language layout level library "
    "license limit line list load local location logger manager map market message method model module monitor name network node number object option order output owner package page parameter "
    "parent path pattern payment percent person picture player point position price process product profile project property protocol provider public query queue random range reader record reference region "
    "register release remote report request resource response result return role route schedule schema scope screen search section security select sequence server service session setting shape "
    "signal source stack stage start state status storage stream string style subject summary support switch symbol system table target task template test text thread time title "
    "total trace transaction transfer tree type update upload user utility validation value variable version video view visible window worker writer").split()

_ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-."
_SIZE = len(_ALPHABET) + 1  # 0 stands for the start
_NUMBER = np.zeros(128, dtype=np.int64)
_NUMBER[[ord(c) for c in _ALPHABET]] = range(1, _SIZE)

_SPANS = "array<struct<kind:string,start:int,end:int,value:string>>"


def base_spans(text: str) -> list[tuple[str, int, int, str]]:
    """(kind, start, end, secret part) of the patterns' matches, by start and then by kind as listed."""
    raw = text.encode().lower()
    found = []
    if b"pass" in raw or b"secret" in raw or b"token" in raw or b"key" in raw:
        found += [("assign", m.start(), m.end(), m[2]) for m in _ASSIGN.finditer(text) if len(m[2]) >= ASSIGN_CHARS]
    if b"akia" in raw:
        found += [("access", m.start(), m.end(), m[0]) for m in _ACCESS.finditer(text) if len(m[0]) >= ACCESS_CHARS]
    found += [("hex", m.start(), m.end(), m[0]) for m in _HEX.finditer(text)]
    return sorted(found, key=lambda s: (s[1], BASE_KINDS.index(s[0])))


def tokens(text: str, base: list[tuple[str, int, int, str]]) -> list[tuple[str, int, int, str]]:
    """Long tokens that touch no base span."""
    out, at = [], 0
    behind = 0
    for m in _TOKEN.finditer(text):
        while at < len(base) and base[at][1] < m.end():
            behind = max(behind, base[at][2])
            at += 1
        if m.start() >= behind:
            out.append(("markov", m.start(), m.end(), m[0]))
    return out


def seed_samples(n: int = SEED_SAMPLES, seed: int = 7) -> list[tuple[str, int]]:
    """``n`` generated (value, label) of each label: 1 random strings over several alphabets and lengths; 0 identifiers in camel, snake,
    kebab and path case, long words, numbers, dates and versions."""
    rng = random.Random(seed)
    digits, lower, upper = string.digits, string.ascii_lowercase, string.ascii_uppercase
    alphabets = (lower + upper + digits + "+/", lower + upper + digits + "-_", digits + "abcdef", digits + "ABCDEF", lower + upper + digits, upper + digits + "234567", lower + digits)
    out = [("".join(rng.choices(rng.choice(alphabets), k=rng.randint(12, 64))), 1) for _ in range(n)]

    def ordinary() -> str:
        words_ = [rng.choice(IDENTIFIER_WORDS) for _ in range(rng.randint(2, 5))]
        end = rng.choice(["", "", "", str(rng.randint(0, 99)), "_" + str(rng.randint(1990, 2035))])
        kind = rng.randrange(9)
        if kind == 0:
            return words_[0] + "".join(w.capitalize() for w in words_[1:]) + end
        if kind == 1:
            return "".join(w.capitalize() for w in words_) + end
        if kind == 2:
            return "_".join(words_) + end
        if kind == 3:
            return "-".join(words_) + end
        if kind == 4:
            return "/".join(["", *words_][rng.randrange(2):]) + end
        if kind == 5:
            return "_".join(words_).upper() + end
        if kind == 6:
            return "".join(words_)
        if kind == 7:
            return f"{rng.randint(1990, 2035)}-{rng.randint(1, 12):02}-{rng.randint(1, 28):02}" + rng.choice(["", f"/{words_[0]}"])
        return str(rng.randint(10 ** 7, 10 ** rng.randint(8, 18)))
    return out + [(ordinary(), 0) for _ in range(n)]


def _samples(columns, seeded):
    """Distinct labelled values of a slice of texts: secrets of the patterns, and tokens that the seed's models call ordinary."""
    secret, others = set(), set()
    for text in columns[0]:
        base = base_spans(text or "")
        secret.update(s[3] for s in base)
        others.update(t[3] for t in tokens(text or "", base))
    found, others = sorted(secret), sorted(others)
    calm = [v for v, ahead in zip(others, ratios(seeded, others)) if ahead <= 0]
    return [found + calm, [1] * len(found) + [0] * len(calm)]


def steps(value: str) -> tuple[np.ndarray, np.ndarray]:
    """The characters' numbers, each with the one before it."""
    n = _NUMBER[np.frombuffer(value.encode("ascii", "replace"), dtype=np.uint8) & 127]
    return np.concatenate(([0], n[:-1])), n


def _count(columns):
    """Steps of a slice by (label, from, to)."""
    totals = np.zeros((2, _SIZE * _SIZE), dtype=np.int64)
    for value, label in zip(*columns):
        before, here = steps(value)
        np.add.at(totals[label], before * _SIZE + here, 1)
    label, cell = np.nonzero(totals)
    return [label.tolist(), cell.tolist(), totals[label, cell].tolist()]


def _table(counts: np.ndarray) -> np.ndarray:
    counts = counts + SMOOTHING
    p = counts / counts.sum(axis=2, keepdims=True)
    return np.log(p[1]) - np.log(p[0])


def seed_counts(samples: list[tuple[str, int]]) -> np.ndarray:
    counts = np.zeros((2, _SIZE, _SIZE))
    for value, label in samples:
        np.add.at(counts[label], steps(value), 1)
    return counts


def train(samples: DataFrame, seed: list[tuple[str, int]] | None = None) -> np.ndarray:
    """The table of log-likelihood ratios (from, to) from ``value string, label int`` (1 random, 0 ordinary) and the seed.

    Null values are passed over. Without any samples the seed alone decides.
    """
    rows = samples.where(F.col("value").isNotNull() & F.col("label").isin(0, 1)).select("value", F.col("label").cast("int"))
    # At most two tables of the alphabet squared, whatever the corpus.
    cells = map_rows(rows, "label int, cell int, n bigint", _count).groupBy("label", "cell").agg(F.sum("n").alias("n")).collect()
    counts = seed_counts(seed_samples() if seed is None else seed)
    for label, cell, n in cells:
        counts[label, cell // _SIZE, cell % _SIZE] += n
    return _table(counts)


def ratios(table: np.ndarray, values: list[str]) -> np.ndarray:
    """Nats by which the random model is ahead, per value; all values of a slice at once."""
    if not values:
        return np.zeros(0)
    n = _NUMBER[np.frombuffer("".join(values).encode("ascii", "replace"), dtype=np.uint8) & 127]
    starts = np.concatenate([[0], np.cumsum(np.fromiter(map(len, values), np.int64, len(values)))[:-1]])
    before = np.concatenate(([0], n[:-1]))
    before[starts] = 0
    return np.add.reduceat(table[before, n], starts)


def is_random(table: np.ndarray, values: list[str]) -> np.ndarray:
    ahead = ratios(table, values)
    return (ahead >= AHEAD) & (ahead >= AHEAD_PER_CHAR * np.fromiter(map(len, values), np.int64, len(values)))


def find_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", samples: DataFrame | None = None) -> DataFrame:
    """``id_col`` and ``spans`` (kind, start, end, value) for every row, by start and then by kind.

    Kinds are ``assign``, ``access``, ``hex`` and ``markov``; positions are code points, the end is exclusive. Null
    and empty texts have no spans. ``samples`` (value, label) train the models beside the seed; without them the corpus' own
    distinct values do. Rows are scanned one by one, whatever their ids; repeated rows are treated alike.
    """
    if samples is None:
        seeded = _table(seed_counts(seed_samples()))
        samples = map_rows(docs.select(text_col), "value string, label int", lambda columns: _samples(columns, seeded)).distinct()
    table = train(samples)

    def rows(columns):
        base = [base_spans(t or "") for t in columns[1]]
        rest = [tokens(t or "", b) for t, b in zip(columns[1], base)]
        hit = iter(is_random(table, [t[3] for r in rest for t in r]).tolist())
        # Stable: equal starts keep their kinds' order.
        spans = [sorted(b + [t for t in r if next(hit)], key=lambda s: s[1]) for b, r in zip(base, rest)]
        return [columns[0], [[dict(zip(("kind", "start", "end", "value"), s)) for s in own] for own in spans]]

    return map_rows(docs.select(id_col, text_col), f"`{id_col}` {ddl_type(docs, id_col)}, spans {_SPANS}", rows)


def _listed(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_secrets(read(spark, sf_dir, "documents"))
    of = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("bigint")
    base = F.filter("spans", lambda s: s["kind"] != "markov")
    return found.select("doc_id", of("assign").alias("n_assign"), of("access").alias("n_access"), of("hex").alias("n_hex"),
                        F.sha2(_listed(base).cast("binary"), 256).alias("base_sha256"), _listed(F.col("spans")).alias("spans"), of("markov").alias("n_markov"))


QUERIES = {"op1_secret_scan": op1_secret_scan}
ORACLES = {}
