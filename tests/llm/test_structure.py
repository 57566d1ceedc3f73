"""Conversation structure repair against a search over edits, and its compression against plain evaluation."""

import hashlib
import itertools
import random
import re
import zlib

import pytest

from rastro.llm import structure
from rastro.session import tune

SCHEMA = "conv_id long, turn long, role string, text string"
FORM = re.compile(r"(s?(ua)+)?")
_NEXT = {"": {"s": "s", "u": "u"}, "s": {"u": "u"}, "u": {"a": "a"}, "a": {"u": "u"}}


def faults(rows):
    out, seen = [], set()
    for role, text in rows:
        body = text.rstrip(" \t\n\x0b\x0c\r")
        out.append("blank" if not body else "duplicate" if (role, text) in seen else "truncated" if body[-1] not in ".!?" else "")
        seen.add((role, text))
    return out


def cheapest(rows):
    """Dynamic programme over (rows done, state), whole audits and outputs kept in plain strings."""
    told = faults(rows)
    best = {"": (0, "", ())}

    def put(to, state, value):
        if state not in to or value[:2] < to[state][:2]:
            to[state] = value

    def insert(at):
        for _ in range(3):
            for state, (cost, audit, out) in list(at.items()):
                for c, nxt in _NEXT[state].items():
                    if c != "s":
                        put(at, nxt, (cost + 5, audit + "I", (*out, ({"u": "user", "a": "assistant"}[c], ""))))
        return at

    for (role, text), fault in zip(rows, told):
        to = {}
        for state, (cost, audit, out) in insert(best).items():
            put(to, state, (cost + 2, audit + "D", out))
            if fault in ("blank", "duplicate"):
                continue
            more = 5 * (fault == "truncated")
            for c, nxt in _NEXT[state].items():
                if c == role[:1]:
                    put(to, nxt, (cost + more, audit + "K", (*out, (role, text))))
                if c != "s":
                    put(to, nxt, (cost + more + 1, audit + "R", (*out, ({"u": "user", "a": "assistant"}[c], text))))
        best = to
    ends = [v for state, v in insert(best).items() if state in ("", "a")]
    return min(ends, key=lambda v: v[:2])


def expected(rows):
    """``rows``: (turn, role, text) in order, nulls replaced."""
    plain = [(r, t) for _, r, t in rows]
    told, turns = faults(plain), [t for t, _, _ in rows if t is not None]
    cost, audit, out = cheapest(plain)
    initials = [r[:1] for r, _ in plain]
    illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
    assert FORM.fullmatch("".join(r[:1] for r, _ in out))
    digest = hashlib.sha256("\n".join(f"{r}:{t}" for r, t in out).encode()).hexdigest()
    return (max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, told.count("blank"), told.count("duplicate"), told.count("truncated"), illegal, cost, audit, digest)


def ordered(rows):
    sha = lambda r, t: hashlib.sha256(f"{len(r)}:{r}{t}".encode()).hexdigest()
    rows = [(t, " " if r is None else r, " " if x is None else x) for t, r, x in rows]
    return sorted(rows, key=lambda x: (x[0] is not None, x[0] or 0, sha(x[1], x[2])))


def got(df):
    return {r["conv_id"]: tuple(r)[1:] for r in df.collect()}


def test_least_strings_by_full_enumeration():
    """Every edit string up to two insertions a gap, over all short sequences of symbols."""
    for n in (1, 2, 3):
        for symbols in itertools.product("suxSUA17", repeat=n):
            rows = []
            for i, c in enumerate(symbols):
                at = structure._SYMBOLS.index(c)
                rows.append(({"s": "system", "u": "user", "a": "assistant", "x": "tool"}["suax"[at % 4]], ("done." if at < 4 else "cut" if at < 8 else "", i, at)))
            best = None
            for edits in itertools.product("DKR", repeat=n):
                for gaps in itertools.product(range(3), repeat=n + 1):
                    state, cost, ok, audit = "", 5 * sum(gaps), True, ""
                    for i in range(n + 1):
                        for _ in range(gaps[i]):
                            state = {"": "u", "s": "u", "a": "u", "u": "a"}[state]
                        audit += "I" * gaps[i]
                        if i == n:
                            break
                        audit += edits[i]
                        role, (kind, _, at) = rows[i]
                        cost += {"D": 2, "K": 0, "R": 1}[edits[i]] + 5 * (edits[i] != "D" and kind == "cut")
                        if edits[i] == "D":
                            continue
                        to = role[0] if edits[i] == "K" else {"u": "a"}.get(state, "u")
                        if kind == "" or to not in _NEXT[state]:
                            ok = False
                            break
                        state = to
                    if ok and state in ("", "a") and (best is None or (cost, audit) < best):
                        best = cost, audit
            row = [(0, ""), None, None, None]
            _, _, m = next(structure.evaluated(["".join(symbols)]))
            ends = structure._times([*structure._times([*row, *[None] * 12], m)[:4], *[None] * 12], structure.INSERTS)
            assert min((x[0], structure._text(x[1])) for x in (ends[0], ends[3]) if x) == best, symbols


def test_grammar_gives_back_its_strings_and_shares_rules():
    rng = random.Random(3)
    strings = ["".join(rng.choice("uaSx17") for _ in range(rng.randint(1, 40))) for _ in range(200)] + ["ua" * 300, "u" * 101]
    rules, left = structure.re_pair(strings)

    def expand(x):
        return x if isinstance(x, str) else "".join(expand(y) for y in rules[x])

    assert ["".join(map(expand, s)) for s in left] == strings
    assert sum(map(len, left)) + 2 * len(rules) < sum(map(len, strings)) / 1.5
    pairs = [p for s in left for p in zip(s, s[1:])]
    assert all(n < 2 or a == b for (a, b), n in ((p, pairs.count(p)) for p in set(pairs)))


def test_grammar_and_symbol_by_symbol_agree():
    rng = random.Random(5)
    strings = ["".join(rng.choices(structure._SYMBOLS, [8, 9, 9, 1, 1, 4, 4, 1] + [1] * 8, k=rng.randint(1, 60))) for _ in range(80)]
    plain = lambda m: [x and (x[0], structure._text(x[1])) for x in m]
    for s, tally, matrix in structure.evaluated(strings):
        want, count = structure._LEAF[s[0]], structure._tally(s[0])
        for c in s[1:]:
            want, count = structure._times(want, structure._LEAF[c]), structure._added(count, structure._tally(c))
        assert plain(matrix) == plain(want) and tally == count


def test_conversations_against_plain_programme(spark, monkeypatch):
    tune(spark)
    rng = random.Random(11)
    texts = ["One.", "Two!", "cut", "", " \t\n", None, "again?", "again?", "x .\n"]
    rows = []
    for conv in range(60):
        for turn in range(rng.randint(1, 9)):
            rows.append((conv, rng.choice([turn, turn, turn, None]), rng.choice(["system", "user", "assistant", "user", "assistant", "tool", "", None]), rng.choice(texts) if rng.random() < .6 else f"{turn} words."))
    rows += [(500, t, ("user", "assistant")[t % 2], f"{t // 7}.") for t in range(700)]  # longer than a stretch below
    rows += [(501, 3, "user", "same.")] * 90 + [(501, 4, "assistant", "yes.")]
    rows += [(None, 0, "user", "no id."), (None, 1, "assistant", "none.")]
    monkeypatch.setattr(structure, "STRETCH", 16)
    df = spark.createDataFrame(rows, SCHEMA).repartition(5).selectExpr("*", "1 AS key", "2 AS stretch", "3 AS symbols")
    ids = spark.createDataFrame([(c,) for c in {r[0] for r in rows} | {900}], "conv_id long")
    result = got(structure.repair(df, ids))
    by = {}
    for c, *r in rows:
        by.setdefault(c, []).append(tuple(r))
    want = {c: expected(ordered(r)) for c, r in by.items()}
    want[900] = (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    assert result == want


def test_query_against_damage_in_plain_python(spark):
    tune(spark)
    folder = "/root/testdata/sf0.01"
    source = [tuple(r) for r in spark.read.parquet(f"{folder}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    by = {c: [] for c, *_ in source}
    for conv, turn, role, text in source:
        fate = zlib.crc32(f"{conv}:{turn}".encode()) % 20
        row = [turn, "user" if fate == 4 else role, "" if fate == 1 else re.sub(r"[.!?]", "", text) if fate == 2 else text]
        by[conv] += [tuple(row)] * (0 if fate == 0 else 2 if fate == 3 else 1)
    assert got(structure.op12_conversation_repair(spark, folder)) == {c: expected(ordered(r)) for c, r in by.items()}


def test_nulls_in_the_damage(spark):
    tune(spark)
    rows = [(None, None, None, None), (1, None, None, "a."), (None, 5, "user", None)]
    df = structure.damaged(spark.createDataFrame(rows, SCHEMA))
    fates = [zlib.crc32(k.encode()) % 20 for k in (" : ", "1: ", " :5")]
    assert df.count() == sum(0 if f == 0 else 2 if f == 3 else 1 for f in fates)
    assert df.where("role IS NULL OR text IS NULL").count() == 0


def test_empty_table(spark):
    tune(spark)
    df = structure.repair(spark.createDataFrame([], SCHEMA))
    assert df.collect() == []
    assert df.columns == ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]


@pytest.mark.parametrize("a, b", [("DKI" * 50, "DKI" * 49 + "DKR"), ("K", "KI"), ("DK", "DK")])
def test_rope_order(a, b):
    def rope(s):
        return s if len(s) < 3 else structure._joined(rope(s[:len(s) // 3]), rope(s[len(s) // 3:]))

    def comb(s):
        r = ""
        for c in s:
            r = structure._joined(r, c)
        return r

    assert structure._less(rope(a), comb(b)) == (a < b) and structure._less(comb(b), rope(a)) == (b < a)
    assert structure._text(rope(a)) == structure._text(comb(a)) == a
