"""Operator 13: grouping of spelling variants.

Words stand in a trie whose levels are the counts of successive letter groups. One inserted, deleted or replaced
letter raises at most one count and lowers at most one, so a depth-first search that may spend a surplus of one and
a deficit of one meets every near word; what it finds at the leaves is verified letter by letter.

The top of the trie is dealt out by Spark: a word goes to the partition of its own first counts and, as a visitor, to
every partition that the budget reaches and that sorts after its own, so each pair of words meets exactly once. As
many levels are dealt as it takes for a partition to stay below ``SHARD_WORDS`` words; partitions that hold more even at
the last level are cut into a grid of slices of entries and of queries.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rastro.llm.common import give_back, read, ship, slices
from rastro.session import settle

# The letter groups of the trie's levels in their order; all other letters are one more group.
GROUPS = ("e", "n", "a", "i", "t", "r", "o", "h", "s", "u", "cl", "dgb", "mwfp", "vykxqzj", "éèêë")
# Shortest word, least number of occurrences, how much more frequent a form is.
LEAST_LETTERS, LEAST_COUNT, TIMES = 5, 3, 2

#: Words of one partition of the trie that a task takes at once.
SHARD_WORDS = 40_000
#: Levels dealt out at least.
TOP = 3
#: Counts above this are one branch in the dealt levels.
MOST = 15
#: Rows of a search's frontier, letters compared at once, distinct words held while counting.
FRONTIER, LETTERS, HELD = 1 << 16, 1 << 22, 1 << 17
#: Words longer than this are compared one pair at a time.
WIDE = 64

_LEVEL = np.full(256, len(GROUPS), np.uint8)
for _n, _g in enumerate(GROUPS):
    _LEVEL[[ord(c) for c in _g]] = _n

# Upper-case ASCII is lowered, other letters of the runs stay, all else separates.
_RUNS = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 0xC0 else 32 for b in range(256))

_COUNTED = "word string, n long"
_NEAR = "word string, n_near long, best_n long, best string"


def _counted(batches: Iterator[pa.RecordBatch], change: Callable | None) -> Iterator[pa.RecordBatch]:
    held: Counter = Counter()

    def flush():
        words = [w.decode("latin-1") for w in held]
        return pa.RecordBatch.from_arrays([pa.array(words, pa.string()), pa.array(list(held.values()), pa.int64())], names=["word", "n"])

    for batch in batches:
        for part in slices(batch):
            for key, text in zip(*(c.to_pylist() for c in part.columns)):
                if not text:
                    continue
                # Letters beyond Latin-1 become a question mark, which separates.
                found = Counter(w for w in text.encode("latin-1", "replace").translate(_RUNS).split() if len(w) >= LEAST_LETTERS)
                if change is None:
                    held.update(found)
                else:
                    change(key, found, held)
                if len(held) > HELD:
                    yield flush()
                    held.clear()
    if held:
        yield flush()
    held.clear()
    give_back()


def words(docs: DataFrame, key: Column, text: Column, change: Callable | None = None) -> DataFrame:
    """(word, n): runs of ``[A-Za-z\\u00C0-\\u00FF]`` with A-Z lowered, of at least ``LEAST_LETTERS`` letters and
    ``LEAST_COUNT`` occurrences. ``change(key, counts of a text, totals)`` may alter the words of a text."""
    ship(docs.sparkSession)
    rows = docs.select(F.coalesce(key.cast("string"), F.lit("")), text)
    counted = rows.mapInArrow(lambda batches: _counted(batches, change), _COUNTED)
    return (counted.groupBy("word").agg(F.sum("n").alias("n"))
            .where((F.length("word") >= LEAST_LETTERS) & (F.col("n") >= LEAST_COUNT)))


def typed(key: str, found: Counter, totals: Counter) -> None:
    """The contract's typing errors: where 97 divides the crc32 of ``key:word``, the word lacks its letter at crc32 modulo its length."""
    start = zlib.crc32(f"{key}:".encode())
    for w, n in found.items():
        h = zlib.crc32(w if w.isascii() else w.decode("latin-1").encode(), start)
        if h % 97 == 0:
            at = h % len(w)
            w = w[:at] + w[at + 1:]
        totals[w] += n


# The trie.

def _codes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """All letters in a row, and where each word starts (one more entry: the end)."""
    lengths = np.fromiter(map(len, texts), np.int64, len(texts))
    return np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32), np.concatenate([[0], np.cumsum(lengths)])


def group_counts(texts: list[str]) -> np.ndarray:
    """Words x levels."""
    letters, starts = _codes(texts)
    level = np.where(letters < 256, _LEVEL[np.minimum(letters, 255)], len(GROUPS)).astype(np.int64)
    width = len(GROUPS) + 1
    word = np.repeat(np.arange(len(texts)), np.diff(starts))
    return np.bincount(word * width + level, minlength=len(texts) * width).reshape(-1, width)


class Trie:
    """Words by their counts of successive letter groups. A level is the sorted keys (parent, count) of its nodes."""

    SHIFT = 20

    def __init__(self, counts: np.ndarray):
        counts = np.minimum(counts, (1 << self.SHIFT) - 3)
        self.order = np.lexsort(counts.T[::-1])
        c = counts[self.order]
        self.levels, node, new = [], np.zeros(len(c), np.int64), np.zeros(len(c), bool)
        new[:1] = True
        for level in range(c.shape[1]):
            new = new.copy()
            new[1:] |= c[1:, level] != c[:-1, level]
            self.levels.append((node[new] << self.SHIFT) + c[new, level])
            node = np.cumsum(new) - 1
        self.ends = np.concatenate([np.flatnonzero(new), [len(c)]])

    def search(self, counts: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(query, word) pairs within one surplus and one deficit, depth first, a stretch of the frontier at a time."""
        counts = np.minimum(counts, (1 << self.SHIFT) - 3)
        every = np.arange(len(counts))
        stack = [(0, every, np.zeros(len(every), np.int64), np.zeros(len(every), np.int8))]
        while stack:
            level, query, node, spent = stack.pop()
            if len(query) > FRONTIER:
                half = len(query) // 2
                stack += [(level, query[half:], node[half:], spent[half:]), (level, query[:half], node[:half], spent[:half])]
                continue
            if level == len(self.levels):
                yield from self._leaves(query, node)
                continue
            keys, found = self.levels[level], []
            want = (node << self.SHIFT) + counts[query, level]
            for step, price in ((0, 0), (1, 1), (-1, 2)):  # a surplus is bit 1, a deficit bit 2
                may = (spent & price) == 0 if price else np.ones(len(query), bool)
                if step < 0:
                    may &= counts[query, level] > 0
                key = want[may] + step
                at = np.searchsorted(keys, key)
                hit = np.flatnonzero(keys[np.minimum(at, len(keys) - 1)] == key)
                picked = np.flatnonzero(may)[hit]
                found.append((query[picked], at[hit], spent[picked] | np.int8(price)))
            nxt = [np.concatenate(x) for x in zip(*found)]
            if len(nxt[0]):
                stack.append((level + 1, *nxt))

    def _leaves(self, query, leaf):
        size = self.ends[leaf + 1] - self.ends[leaf]
        cuts = np.flatnonzero(np.diff(np.cumsum(size) // FRONTIER)) + 1
        for q, start, n in zip(*(np.split(x, cuts) for x in (query, self.ends[leaf], size))):
            total = int(n.sum())
            inner = np.arange(total) - np.repeat(np.cumsum(n) - n, n)
            yield np.repeat(q, n), self.order[np.repeat(start, n) + inner]


def _one_edit(a: str, b: str) -> bool:
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1 or a == b:
        return False
    at = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), len(a))
    return a[at + (len(a) == len(b)):] == b[at + 1:]


class _Letters:
    """Verification: words as rows of letters, longer ones as strings."""

    def __init__(self, texts: list[str]):
        self.texts = texts
        letters, starts = _codes(texts)
        self.length = np.diff(starts)
        self.width = int(min(WIDE, self.length.max(initial=0))) + 1
        self.rows = np.zeros((len(texts), self.width), np.uint32)
        short = np.flatnonzero(self.length <= WIDE)
        n = self.length[short]
        column = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
        self.rows[np.repeat(short, n), column] = letters[np.repeat(starts[short], n) + column]

    def near(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Which pairs of words differ by exactly one letter inserted, deleted or replaced."""
        out = np.zeros(len(a), bool)
        wide = (self.length[a] > WIDE) | (self.length[b] > WIDE)
        for i in np.flatnonzero(wide):
            out[i] = _one_edit(self.texts[a[i]], self.texts[b[i]])
        gap = self.length[b] - self.length[a]
        step = max(1, LETTERS // self.width)
        same = np.flatnonzero(~wide & (gap == 0))
        for at in range(0, len(same), step):
            i = same[at:at + step]
            out[i] = (self.rows[a[i]] != self.rows[b[i]]).sum(1) == 1
        other = np.flatnonzero(~wide & (abs(gap) == 1))
        for at in range(0, len(other), step):
            i = other[at:at + step]
            less, more = np.where(gap[i] > 0, a[i], b[i]), np.where(gap[i] > 0, b[i], a[i])
            short, long = self.rows[less], self.rows[more]
            first = (short != long).argmax(1)
            moved = short[:, :-1] == long[:, 1:]
            out[i] = (moved | (np.arange(self.width - 1) < first[:, None])).all(1)
        return out


#: What a row of a shard does: an entry that also asks, only an entry, only a question of the shard's own, a visitor's question.
_BOTH, _ENTRY, _ASKS, _VISITS = range(4)


def _shard(table: pa.Table) -> pa.Table:
    """The near words of one shard: per word their number and the best of them."""
    kind = table.column("kind").to_numpy()
    texts, n = table.column("word").to_pylist(), table.column("n").to_numpy()
    entries, asks = np.flatnonzero(kind <= _ENTRY), np.flatnonzero(kind != _ENTRY)
    if not len(entries) or not len(asks):
        return _near_table([], [], [], [])
    counts, letters = group_counts(texts), _Letters(texts)
    rank = np.empty(len(texts), np.int64)
    rank[sorted(range(len(texts)), key=texts.__getitem__)] = np.arange(len(texts))
    visitor = kind == _VISITS
    left, right = [], []
    for q, e in Trie(counts[entries]).search(counts[asks]):
        a, b = asks[q], entries[e]
        once = visitor[a] | (rank[a] < rank[b])
        a, b = a[once], b[once]
        ok = letters.near(a, b)
        left.append(a[ok])
        right.append(b[ok])
    a, b = np.concatenate([*left, *right]).astype(np.int64), np.concatenate([*right, *left]).astype(np.int64)
    order = np.lexsort((rank[b], -n[b], a))
    a, b = a[order], b[order]
    first = np.flatnonzero(np.diff(a, prepend=-1))
    many = np.diff(np.append(first, len(a)))
    return _near_table([texts[i] for i in a[first]], many, n[b[first]], [texts[i] for i in b[first]])


def _near_table(word, many, n, best) -> pa.Table:
    return pa.table({"word": pa.array(word, pa.string()), "n_near": pa.array(many, pa.int64()), "best_n": pa.array(n, pa.int64()), "best": pa.array(best, pa.string())})


# The dealing.

def _prefix(levels: int) -> list[Column]:
    """Counts of the first letter groups, counts above ``MOST`` as one."""
    out = []
    for g in GROUPS[:levels]:
        rest = F.translate("word", g, "")
        out.append(F.least(F.length("word") - F.length(rest), F.lit(MOST)).cast("bigint"))
    return out


def _packed(counts: list[Column]) -> Column:
    out = F.lit(0).cast("bigint")
    for c in counts:
        out = out * (MOST + 1) + c
    return out


def _dealt(vocabulary: DataFrame, levels: int) -> DataFrame:
    """(shard, kind, word, n): every word in its own shard and, as a visitor, in each that the budget reaches and that sorts after it."""
    counts = [F.col(f"c{i}") for i in range(levels)]
    unit = [(MOST + 1) ** (levels - 1 - i) for i in range(levels)]
    own = F.col("own")
    ways = [F.struct(own.alias("shard"), F.lit(_BOTH).alias("kind"))]
    for i in range(levels):
        up = counts[i] < MOST
        ways.append(F.when(up, F.struct((own + unit[i]).alias("shard"), F.lit(_VISITS).alias("kind"))))
        for j in range(i + 1, levels):
            ways.append(F.when(up & (counts[j] > 0), F.struct((own + unit[i] - unit[j]).alias("shard"), F.lit(_VISITS).alias("kind"))))
    placed = vocabulary.select("word", "n", *[c.alias(f"c{i}") for i, c in enumerate(_prefix(levels))]).withColumn("own", _packed(counts))
    return placed.select("word", "n", F.explode(F.filter(F.array(*ways), lambda w: w.isNotNull())).alias("way")).select("way.shard", "way.kind", "word", "n")


def _levels(vocabulary: DataFrame) -> tuple[int, int]:
    """As many levels as it takes for the largest shard to stay below ``SHARD_WORDS``, and that shard's words."""
    for levels in range(TOP, len(GROUPS) + 1):
        most = vocabulary.groupBy(_packed(_prefix(levels)).alias("shard")).agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 0
        if most <= SHARD_WORDS:
            break
    return levels, most


def _sliced(dealt: DataFrame) -> DataFrame:
    """Shards with too many words as a grid: entries in some slices, questions in others, each pair of slices a shard."""
    parts = lambda c: F.ceil(c / SHARD_WORDS)
    sizes = (dealt.groupBy("shard").agg(F.count_if(F.col("kind") == _BOTH).alias("e"), F.count(F.lit(1)).alias("q"))
             .where(F.col("e") > SHARD_WORDS).select("shard", parts(F.col("e")).alias("e"), parts(F.col("q")).alias("q")))
    all_of = lambda n: F.sequence(F.lit(0).cast("bigint"), n - 1)
    own = lambda n: F.pmod(F.xxhash64("word"), n)
    e, q = F.col("e"), F.col("q")
    entry = F.transform(all_of(q), lambda i: F.struct(own(e).alias("ei"), i.alias("qi"), F.lit(_ENTRY).alias("kind")))
    asks = F.transform(all_of(e), lambda i: F.struct(i.alias("ei"), own(q).alias("qi"), F.greatest(F.col("kind"), F.lit(_ASKS)).alias("kind")))
    zero = F.lit(0).cast("bigint")
    ways = (F.when(e.isNull(), F.array(F.struct(zero.alias("ei"), zero.alias("qi"), F.col("kind").alias("kind"))))
            .when(F.col("kind") == _BOTH, F.concat(entry, asks)).otherwise(asks))
    return dealt.join(sizes, "shard", "left").select("shard", "word", "n", F.explode(ways).alias("way")).select("shard", "way.ei", "way.qi", "way.kind", "word", "n")


def near_words(vocabulary: DataFrame) -> DataFrame:
    """(word, n_near, best_n, best) in parts: a word's numbers add up over its rows, its best near word is the best of them."""
    ship(vocabulary.sparkSession)
    levels, most = _levels(vocabulary)
    dealt = _dealt(vocabulary, levels)
    keys = ["shard"]
    if most > SHARD_WORDS:
        dealt, keys = _sliced(dealt), ["shard", "ei", "qi"]
    return dealt.groupBy(*keys).applyInArrow(_shard, _NEAR)


def variants(vocabulary: DataFrame) -> DataFrame:
    """word, form, root, n, n_near, form_n of every row of ``vocabulary`` (word, n; words are unique).

    Two words are near if they differ by exactly one inserted, deleted or replaced letter. A word's form is its most
    frequent near word (ties: the first in code-point order) if that is at least ``TIMES`` as frequent, else null; its
    root is where the forms lead.

    Defined results: null words take no part; an empty table gives no rows; words of any script and length count, their
    letters being code points.
    """
    vocabulary = settle(vocabulary.where(F.col("word").isNotNull()).select("word", F.col("n").cast("bigint").alias("n")), "vocabulary")
    found = near_words(vocabulary)
    blank = vocabulary.select("word", "n", F.lit(0).cast("bigint").alias("n_near"), F.lit(None).cast("bigint").alias("best_n"), F.lit(None).cast("string").alias("best"))
    every = blank.unionByName(found.withColumn("n", F.lit(None).cast("bigint")))
    best = F.min(F.when(F.col("best").isNotNull(), F.struct((-F.col("best_n")).alias("m"), F.col("best").alias("w"))))
    told = every.groupBy("word").agg(F.max("n").alias("n"), F.sum("n_near").alias("n_near"), best.alias("b"))
    has = -F.col("b.m") >= TIMES * F.col("n")
    told = settle(told.select("word", "n", "n_near", F.when(has, F.col("b.w")).alias("form"), F.when(has, -F.col("b.m")).alias("form_n")), "forms")
    roots = _roots(told.where(F.col("form").isNotNull()).select("word", F.col("form").alias("root")))
    return told.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def _roots(forms: DataFrame) -> DataFrame:
    """Where chains of (word, root) end, by doubling the steps. A form is at least twice as frequent, so there are no rings and few rounds."""
    while True:
        on = forms.select(F.col("word").alias("root"), F.col("root").alias("next"))
        forms = settle(forms.select("word", "root").join(on, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        if forms.where("moved").isEmpty():
            return forms.select("word", "root")


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants(words(read(spark, sf_dir, "documents"), F.col("doc_id"), F.col("text"), typed))


QUERIES = {"op13_spelling_variants": op13_spelling_variants}
ORACLES = {}
