"""Operator 12: repair of conversation structure.

Every row becomes one symbol, its role's initial and its first fault. Stretches of a conversation are strings of
symbols; the strings of many conversations are compressed together by Re-Pair, each rule of the grammar gets one
min-plus matrix over the states of the role pattern ``(s?(ua)+)?`` with the cheapest edits as ropes, and the rules'
matrices serve all conversations that use them.

Two edit strings of one stretch with equal cost and equal end states never start one with the other: they hold
one letter per row, so the longer would have more insertions and cost more. The least string of a concatenation is
therefore put together from the least strings of its parts, and ties can be settled rule by rule.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rastro.llm.common import arrow_schema, free_name, give_back, read, ship, slices
from rastro.operators.blocks import running

# White space, ends of sentences, costs of the edits.
BLANKS = " \t\n\x0b\x0c\r"
ENDS = ".!?"
REROLE, DELETE, INSERT, CUT_OFF = 1, 2, 5, 5

#: Rows in one string of symbols. A string holds at most twice as many, whatever the length of its conversation.
STRETCH = 2048
#: Symbols that are compressed by one grammar.
GRAMMAR = 1 << 18

#: One letter per role class (s, u, a, others) and fault.
OK, TRUNCATED, BLANK, DUPLICATE = "suax", "SUAX", "1234", "5678"
_SYMBOLS = OK + TRUNCATED + BLANK + DUPLICATE

# States of the pattern: nothing written, after s, after u, after a.
_START, _S, _U, _A = range(4)
_AFTER = {"s": {_START: _S}, "u": {_START: _U, _S: _U, _A: _U}, "a": {_U: _A}, "x": {}}
_ROLE = {"u": "user", "a": "assistant"}

_MATRICES = "key string, stretch long, counts array<long>, costs array<long>, edits array<string>"
_MEASURES = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")


# Ropes: a string, or (length, hash, power of the base, left, right).

_MOD, _BASE = (1 << 61) - 1, 0x5DEECE66D


def _size(r) -> int:
    return len(r) if isinstance(r, str) else r[0]


def _hashed(r) -> tuple[int, int]:
    if not isinstance(r, str):
        return r[1], r[2]
    h, p = 0, 1
    for c in r:
        h, p = (h * _BASE + ord(c)) % _MOD, p * _BASE % _MOD
    return h, p


def _joined(a, b):
    if not a or not b:
        return a or b
    (ha, pa_), (hb, pb) = _hashed(a), _hashed(b)
    return _size(a) + _size(b), (ha * pb + hb) % _MOD, pa_ * pb % _MOD, a, b


def _less(a, b) -> bool:
    """Whether rope ``a`` sorts before ``b``: equal parts are passed over whole, by their hashes."""
    left, right = [a], [b]
    while left and right:
        x, y = left.pop(), right.pop()
        if x is y:
            continue
        n, m = _size(x), _size(y)
        if n == m and _hashed(x) == _hashed(y):
            continue
        if isinstance(x, str) and isinstance(y, str):
            k = min(n, m)
            if x[:k] != y[:k]:
                return x < y
            left.extend([x[k:]] if n > k else [])
            right.extend([y[k:]] if m > k else [])
            continue
        if not isinstance(x, str) and (n >= m or isinstance(y, str)):
            left += [x[4], x[3]]
            right.append(y)
        else:
            right += [y[4], y[3]]
            left.append(x)
    return bool(right) and not left


def _text(r) -> str:
    out, stack = [], [r]
    while stack:
        x = stack.pop()
        if isinstance(x, str):
            out.append(x)
        else:
            stack += [x[4], x[3]]
    return "".join(out)


def _times(a: list, b: list) -> list:
    """Min-plus product of two 4 x 4 matrices of (cost, rope) or None; the lesser rope wins a tie."""
    out = [None] * 16
    for i in range(4):
        for j in range(4):
            best = None
            for k in range(4):
                x, y = a[4 * i + k], b[4 * k + j]
                if x is None or y is None:
                    continue
                cost = x[0] + y[0]
                if best is None or cost < best[0]:
                    best = cost, x[1], y[1], None
                elif cost == best[0]:
                    mine, theirs = _joined(x[1], y[1]), best[3] or _joined(best[1], best[2])
                    best = (cost, x[1], y[1], mine) if _less(mine, theirs) else (*best[:3], theirs)
            if best:
                out[4 * i + j] = best[0], best[3] if best[3] is not None else _joined(best[1], best[2])
    return out


def _inserts() -> list:
    """Any number of insertions, the fewest between two states."""
    out = [None] * 16
    for i in range(4):
        state, n = i, 0
        while out[4 * i + state] is None:
            out[4 * i + state] = INSERT * n, "I" * n
            state, n = _A if state == _U else _U, n + 1
    return out


def _matrix(symbol: str) -> list:
    """Insertions, then one edit of the row."""
    at = _SYMBOLS.index(symbol)
    role, extra = OK[at % 4], CUT_OFF if symbol in TRUNCATED else 0
    own = [None] * 16
    for i in range(4):
        own[5 * i] = DELETE, "D"
    if symbol in OK + TRUNCATED:
        for letter, cost, edit in ((role, 0, "K"), ("u", REROLE, "R"), ("a", REROLE, "R")):
            for i, j in _AFTER[letter].items():
                if own[4 * i + j] is None or own[4 * i + j][0] > cost + extra:
                    own[4 * i + j] = cost + extra, edit
    return _times(INSERTS, own)


INSERTS = _inserts()
_LEAF = {c: _matrix(c) for c in _SYMBOLS}


def _tally(symbol: str) -> tuple:
    """(blank, duplicate, truncated, illegal neighbours, first and last role class)."""
    role = OK[_SYMBOLS.index(symbol) % 4]
    return int(symbol in BLANK), int(symbol in DUPLICATE), int(symbol in TRUNCATED), 0, role, role


def _added(a: tuple, b: tuple) -> tuple:
    seam = int(a[5] + b[4] not in ("su", "ua", "au"))
    return a[0] + b[0], a[1] + b[1], a[2] + b[2], a[3] + b[3] + seam, a[4], b[5]


def re_pair(strings: list[str]) -> tuple[list[tuple], list[list]]:
    """Replace the most frequent pair of neighbouring symbols by a new one until every pair occurs once.

    Returns the rules (left, right), of which the n-th is the symbol n, and the strings that remain; symbols of the
    input stay characters. Frequencies are over all strings.
    """
    sym: list = []
    for s in strings:
        sym.extend(s)
        sym.append(None)  # no pair goes over it
    n = len(sym)
    before, after = list(range(-1, n - 1)), list(range(1, n + 1))
    places: dict[tuple, set] = {}

    def pair(i):
        j = after[i] if 0 <= i < n else n
        return (sym[i], sym[j]) if j < n and i >= 0 and sym[i] is not None and sym[j] is not None else None

    for i in range(n):
        if p := pair(i):
            places.setdefault(p, set()).add(i)
    order = lambda p: tuple((0, x) if isinstance(x, int) else (1, ord(x)) for x in p)
    heap = [(-len(at), order(p), p) for p, at in places.items() if len(at) > 1]
    heapq.heapify(heap)
    rules: list[tuple] = []
    while heap:
        count, _, p = heapq.heappop(heap)
        at = places.get(p, ())
        if len(at) < 2:
            continue
        if len(at) != -count:
            heapq.heappush(heap, (-len(at), order(p), p))
            continue
        new, changed = len(rules), set()
        rules.append(p)
        for i in sorted(places.pop(p)):
            if pair(i) != p:
                continue  # overlapped by the one before it
            j = after[i]
            for k in (before[i], j):
                if (q := pair(k)) and q in places:
                    places[q].discard(k)
            after[i] = after[j]
            if after[j] < n:
                before[after[j]] = i
            sym[i], sym[j], after[j] = new, None, j
            for k in (before[i], i):
                if q := pair(k):
                    places.setdefault(q, set()).add(k)
                    changed.add(q)
        for q in changed:
            if len(places[q]) > 1:
                heapq.heappush(heap, (-len(places[q]), order(q), q))
    out, i = [], 0
    for s in strings:
        left, end = [], i + len(s)
        while i < end:
            left.append(sym[i])
            i = after[i]
        out.append(left)
        i = end + 1
    return rules, out


def evaluated(strings: list[str]) -> Iterator[tuple[str, tuple, list]]:
    """(string, tally, matrix) of every string, by one grammar for all."""
    rules, left = re_pair(strings)
    known: dict = {c: (_tally(c), m) for c, m in _LEAF.items()}
    for n, (a, b) in enumerate(rules):
        known[n] = _added(known[a][0], known[b][0]), _times(known[a][1], known[b][1])
    for s, symbols in zip(strings, left):
        tally, matrix = known[symbols[0]]
        for x in symbols[1:]:
            tally, matrix = _added(tally, known[x][0]), _times(matrix, known[x][1])
        yield s, tally, matrix


def _packs(strings: set[str]) -> Iterator[list[str]]:
    pack, size = [], 0
    for s in sorted(strings):
        if pack and size + len(s) > GRAMMAR:
            yield pack
            pack, size = [], 0
        pack.append(s)
        size += len(s)
    if pack:
        yield pack


def _matrices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    classes = [pa.string(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.string())]
    for batch in batches:
        for part in slices(batch):
            keys, stretches, strings = (c.to_pylist() for c in part.columns)
            found = {}
            for pack in _packs(set(strings)):
                for s, tally, matrix in evaluated(pack):
                    found[s] = ([*tally[:4], OK.index(tally[4]), OK.index(tally[5])], [x and x[0] for x in matrix], [x and _text(x[1]) for x in matrix])
            rows = [found[s] for s in strings]
            arrays = [pa.array(c, t) for c, t in zip((keys, stretches, *([r[i] for r in rows] for i in range(3))), classes)]
            yield pa.RecordBatch.from_arrays(arrays, names=["key", "stretch", "counts", "costs", "edits"])
    give_back()


class _Conversation:
    """One conversation as its rows go by: its stretches' matrices first, then its texts in order."""

    def __init__(self, head: dict):
        self.id = head
        self.row, self.tally = [(0, ""), None, None, None], None
        self.edits, self.at = None, 0
        self.state, self.first, self.sha = _START, True, hashlib.sha256()
        self.turns = [None, None, 0]

    def stretch(self, counts, costs, edits) -> None:
        tally = (*counts[:4], OK[counts[4]], OK[counts[5]])
        self.tally = tally if self.tally is None else _added(self.tally, tally)
        matrix = [None if c is None else (c, e) for c, e in zip(costs, edits)]
        self.row = _times([*self.row, *[None] * 12], matrix)[:4]

    def _solve(self) -> None:
        ends = _times([*self.row, *[None] * 12], INSERTS)
        best = None
        for x in (ends[_START], ends[_A]):
            if x and (best is None or x[0] < best[0] or x[0] == best[0] and _less(x[1], best[1])):
                best = x
        self.cost, self.edits = best[0], _text(best[1])

    def _say(self, role: str, text: str) -> None:
        self.sha.update(f"{'' if self.first else chr(10)}{role}:{text}".encode("utf-8", "surrogatepass"))
        self.first = False

    def _inserted(self) -> None:
        while self.edits[self.at:self.at + 1] == "I":
            self.at += 1
            self.state = _A if self.state == _U else _U
            self._say("assistant" if self.state == _A else "user", "")

    def text(self, turn, role: str, text: str) -> None:
        if self.edits is None:
            self._solve()
        if turn is not None and turn != self.turns[1]:
            low, _, n = self.turns
            self.turns = [turn if low is None else low, turn, n + 1]
        self._inserted()
        edit = self.edits[self.at]
        self.at += 1
        if edit == "R":
            self.state = _A if self.state == _U else _U
            self._say("assistant" if self.state == _A else "user", text)
        elif edit == "K":
            self.state = _AFTER[role[:1]][self.state]
            self._say(role, text)

    def result(self) -> list:
        if self.edits is None:
            self._solve()
        self._inserted()
        low, high, n = self.turns
        blank, duplicate, truncated, illegal = self.tally[:4] if self.tally else (0, 0, 0, 0)
        return [self.id, 0 if low is None else high - low + 1 - n, blank, duplicate, truncated, illegal, self.cost, self.edits, self.sha.hexdigest()]


def _repaired(batches: Iterator[pa.RecordBatch], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Rows sorted by conversation and kind: its id, its stretches, its texts. Only the conversation at hand is kept."""
    key, now, done = None, None, []
    for batch in batches:
        for part in slices(batch):
            for k, kind, conv, _, counts, costs, edits, turn, role, text in zip(*(c.to_pylist() for c in part.columns)):
                if k != key:
                    if now:
                        done.append(now.result())
                    key, now = k, _Conversation(conv)
                if kind == 1:
                    now.stretch(counts, costs, edits)
                elif kind == 2:
                    now.text(turn, role, text)
            if done:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*done), schema)], schema=schema)
                done = []
    if now:
        yield pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(now.result(), schema)], schema=schema)
    give_back()


def _key(conv_id) -> Column:
    """Conversation ids as strings that are never null."""
    return F.coalesce(F.concat(F.lit("="), F.col(conv_id).cast("string")), F.lit(""))


def _symbol(role: str, text: str, duplicate: Column) -> Column:
    body = F.rtrim(F.col(text), F.lit(BLANKS))
    first = F.substring(role, 1, 1)
    at = F.when(first == "s", 1).when(first == "u", 2).when(first == "a", 3).otherwise(4)
    pick = lambda letters: F.substring(F.lit(letters), at, F.lit(1))
    cut = ~F.substring(body, -1, 1).isin(*ENDS)
    return F.when(body == "", pick(BLANK)).when(duplicate, pick(DUPLICATE)).when(cut, pick(TRUNCATED)).otherwise(pick(OK))


def stretches(rows: DataFrame) -> DataFrame:
    """(key, stretch, symbols) of rows (key, turn, role, text, mark): at most ``2 * STRETCH`` symbols a string.

    Equal rows of one turn are counted before they are shuffled, and a conversation's rows are numbered over ranges, so
    that neither needs to fit a task.
    """
    plain = rows.select("key", "turn", "mark", _symbol("role", "text", F.lit(False)).alias("one"), _symbol("role", "text", F.lit(True)).alias("more"))
    alike = plain.groupBy("key", "turn", "mark").agg(F.count(F.lit(1)).alias("n"), F.first("one").alias("one"), F.first("more").alias("more"))
    rank = F.struct(F.col("turn").isNotNull().alias("given"), F.col("turn"))
    first = alike.groupBy("key", "mark").agg(F.min(rank).alias("least"))
    told = alike.join(first, ["key", "mark"]).withColumn("one", F.when(F.col("least").eqNullSafe(rank), F.col("one")).otherwise(F.col("more")))
    cut = F.transform(F.sequence(F.lit(0).cast("bigint"), F.floor((F.col("n") - 1) / STRETCH)),
                      lambda i: F.struct(i.alias("i"), F.least(F.col("n") - i * STRETCH, F.lit(STRETCH)).alias("n")))
    runs = told.withColumn("run", F.explode(cut)).select(
        "key", F.struct(F.col("turn").isNotNull().alias("given"), "turn", "mark", F.col("run.i").alias("i")).alias("place"), F.col("run.n").alias("n"),
        F.concat(F.when(F.col("run.i") == 0, F.col("one")).otherwise(F.col("more")), F.expr("repeat(more, int(run.n) - 1)")).alias("symbols"))
    placed = running(runs, ["key"], "place", {"end": ("sum", F.col("n"))})
    start = F.col("end") - F.col("n")
    return (placed.groupBy("key", F.floor(start / STRETCH).alias("stretch"))
            .agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col("end").alias("e"), F.col("symbols").alias("s")))), lambda x: x["s"]), "").alias("symbols")))


def repair(rows: DataFrame, ids: DataFrame | None = None, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """Per conversation the cheapest edits that give its role initials the form ``(s?(ua)+)?``.

    Keep costs 0, Rerole (to user or assistant) 1, Delete 2, Insert (an empty text) 5; a truncated row that is not
    deleted adds 5; blank and repeated rows must be deleted. ``ids`` may name conversations that have no rows.
    Returns conv_id, gaps, blank, duplicate, truncated, illegal, cost (longs), audit (K, R, D, I in order) and
    repaired_sha256.

    Defined results: rows stand by turn, nulls first, then by a digest of role and text. Null texts and roles count as one
    space. A null id is a conversation of its own. A role that starts with none of s, u, a (an empty one too) can't be
    kept. Repeated rows are duplicates of the first. A conversation without rows has zeros, an empty audit and the
    digest of nothing; an empty table gives no rows. Other columns are passed over.

    An audit and a digest of a whole conversation are one row and one sequential hash, so the texts of a conversation go by in
    one task, in sorted order, none kept; everything before works on stretches.
    """
    ship(rows.sparkSession)
    kind = rows.schema[conv_id].dataType.simpleString()
    blank = lambda c: F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(" "))
    plain = rows.select(_key(f"`{conv_id}`").alias("key"), F.col(f"`{conv_id}`").alias("id"), F.col(f"`{turn}`").cast("bigint").alias("turn"), blank(role).alias("role"), blank(text).alias("text"))
    plain = plain.withColumn("mark", F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text")), 256))
    ids = rows if ids is None else ids
    heads = ids.select(_key(f"`{conv_id}`").alias("key"), F.col(f"`{conv_id}`").alias("id")).distinct()
    strings = stretches(plain)
    solved = strings.mapInArrow(_matrices, _MATRICES)
    none = {"id": kind, "stretch": "bigint", "counts": "array<bigint>", "costs": "array<bigint>", "edits": "array<string>", "turn": "bigint", "role": "string", "text": "string", "mark": "string"}

    def row(df, n):
        return df.select("key", F.lit(n).alias("kind"), *[F.col(c) if c in df.columns else F.lit(None).cast(t).alias(c) for c, t in none.items()])

    # The heads' null turn and stretch sort first within their kind, as do null turns among texts.
    every = row(heads, 0).unionByName(row(solved, 1)).unionByName(row(plain.drop("id"), 2))
    flow = every.repartition("key").sortWithinPartitions("key", "kind", "stretch", F.col("turn").asc_nulls_first(), "mark").drop("mark")
    schema = f"`{conv_id}` {kind}, {', '.join(f'{m} long' for m in _MEASURES)}, audit string, repaired_sha256 string"
    arrow = arrow_schema(rows.sparkSession, schema)
    return flow.mapInArrow(lambda batches: _repaired(batches, arrow), schema)


def damaged(rows: DataFrame) -> DataFrame:
    """The fixed damage of the contract's table: by the crc32 of ``conv_id:turn`` a row goes, is emptied, loses its ends of
    sentences, stands twice or speaks as user. Nulls count as one space."""
    given = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    fate = free_name(rows, "fate")
    hurt = rows.withColumn(fate, F.crc32(F.concat(given("conv_id"), F.lit(":"), given("turn")).cast("binary")) % 20).where(F.col(fate) != 0)
    f = F.col(fate)
    text = F.when(f == 1, "").when(f == 2, F.translate(given("text"), ENDS, "")).otherwise(given("text"))
    role = F.when(f == 4, "user").otherwise(given("role"))
    copies = F.explode(F.when(f == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1))))
    return hurt.select("conv_id", "turn", role.alias("role"), text.alias("text"), copies.alias("copy")).drop("copy")


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    conversations = read(spark, sf_dir, "conversations")
    return repair(damaged(conversations), conversations)


QUERIES = {"op12_conversation_repair": op12_conversation_repair}
ORACLES = {}
