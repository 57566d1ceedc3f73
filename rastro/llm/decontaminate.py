"""Benchmark decontamination by a generalised suffix automaton over the words of the test items.

The normalised items are laid into one automaton. A task streams a document's words through it and knows at
each word the longest stretch ending there that stands in some item. From ``window`` words on, the last
``window`` of them are an item's window and are hit; an item of fewer words counts where it occurs whole.
:func:`remove_spans` takes the hit words out of a text and drops documents that are mostly hit.

The automaton is the only thing that is broadcast. Items are read to the driver in order, block by block:
a block ends at ``block_words`` words, which bounds an automaton's size, and documents pass one block after
the other, each adding to what the ones before have found.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rastro.llm.common import ddl_type, map_rows, read
from rastro.session import settle

WINDOW = 10
#: Item words in one automaton, about 200 bytes each.
BLOCK_WORDS = 500_000
#: A document of which so large a part of the words is hit goes as a whole.
MAX_COVERAGE = 0.8

#: Everything but ASCII letters, digits and bytes of other characters becomes a blank; A-Z become a-z.
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def words_of(text: str | None) -> list[bytes]:
    return text.encode().translate(_FOLD).split() if text else []


class Automaton:
    """Generalised suffix automaton over word numbers, with the items that own each window state."""

    def __init__(self, window: int):
        self.window = window
        self.numbers: dict[bytes, int] = {}
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        self.shortest = window  # words of the shortest item, up to the window
        self._ends: list[tuple[int, str]] = []
        self._texts: list[tuple[str | None, list[int]]] = []

    def add(self, item: str | None, words: list[bytes]) -> None:
        """``None`` is the key of all items without an id."""
        numbers = [self.numbers.setdefault(w, len(self.numbers)) for w in words]
        last = 0
        for c in numbers:
            last = self._extend(last, c)
        self.shortest = min(self.shortest, len(numbers))
        self._texts.append((item, numbers))

    def _extend(self, last: int, c: int) -> int:
        nxt, link, length = self.next, self.link, self.length
        if c in nxt[last]:
            q = nxt[last][c]
            return q if length[q] == length[last] + 1 else self._split(last, c, q)
        new = len(nxt)
        nxt.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and c not in nxt[p]:
            nxt[p][c] = new
            p = link[p]
        if p >= 0:
            q = nxt[p][c]
            link[new] = q if length[q] == length[p] + 1 else self._split(p, c, q)
        return new

    def _split(self, p: int, c: int, q: int) -> int:
        nxt, link, length = self.next, self.link, self.length
        twin = len(nxt)
        nxt.append(dict(nxt[q]))
        length.append(length[p] + 1)
        link.append(link[q])
        link[q] = twin
        while p >= 0 and nxt[p].get(c) == q:
            nxt[p][c] = twin
            p = link[p]
        return twin

    def finish(self) -> Automaton:
        """Note for every state the items whose window (or whole short text) ends there."""
        self.owners: dict[int, set[str | None]] = {}
        self.short: dict[int, int] = {}  # state of a short item's whole text: its words
        for item, numbers in self._texts:
            n = min(self.window, len(numbers))
            state, matched = 0, 0
            for i, c in enumerate(numbers):
                state, matched = self.step(state, matched, c)
                if i + 1 >= n:
                    at = self._state_of(state, n)
                    self.owners.setdefault(at, set()).add(item)
                    if n < self.window:
                        self.short[at] = n
        #: For every state the states of short items among its suffixes, longest first.
        self.short_suffixes: dict[int, list[int]] = {}
        if self.short:
            for state in range(len(self.next)):
                found, s = [], state
                while s > 0:
                    if s in self.short:
                        found.append(s)
                    s = self.link[s]
                if found:
                    self.short_suffixes[state] = found
        self._texts = []
        return self

    def step(self, state: int, matched: int, c: int) -> tuple[int, int]:
        while state and c not in self.next[state]:
            state = self.link[state]
            matched = self.length[state]
        if c in self.next[state]:
            return self.next[state][c], matched + 1
        return 0, 0

    def _state_of(self, state: int, n: int) -> int:
        """The state that holds the suffix of ``n`` words."""
        while self.length[self.link[state]] >= n:
            state = self.link[state]
        return state

    def scan(self, words: list[bytes]) -> tuple[list[list[int]], set[str | None]]:
        """Hit stretches (first word, word behind the last) in order and apart, and the items found, None for those without an id."""
        get = self.numbers.get
        numbers = np.fromiter((get(w, -1) for w in words), dtype=np.int64, count=len(words))
        known = np.concatenate(([False], numbers >= 0, [False]))
        edges = np.flatnonzero(known[1:] != known[:-1])
        starts, ends = edges[::2], edges[1::2]
        long = ends - starts >= self.shortest
        spans: list[list[int]] = []
        items: set[str | None] = set()
        for start, end in zip(starts[long].tolist(), ends[long].tolist()):
            self._scan_run(start, numbers[start:end].tolist(), spans, items)
        return spans, items

    def _scan_run(self, offset: int, numbers: list[int], spans: list, items: set) -> None:
        nxt, link, length, window = self.next, self.link, self.length, self.window
        state, matched = 0, 0
        for i, c in enumerate(numbers, offset + 1):
            while state and c not in nxt[state]:
                state = link[state]
                matched = length[state]
            to = nxt[state].get(c)
            if to is None:
                state = matched = 0
                continue
            state, matched = to, matched + 1
            hit = 0
            if matched >= window:
                hit = window
                items |= self.owners.get(self._state_of(state, window), set())
            for s in self.short_suffixes.get(state, ()):
                if self.short[s] <= matched:
                    hit = max(hit, self.short[s])
                    items |= self.owners[s]
            if hit:
                start = i - hit
                while spans and spans[-1][1] >= start:
                    start = min(start, spans.pop()[0])
                spans.append([start, i])


def automata(benchmark: DataFrame, id_col: str, text_col: str, window: int, block_words: int) -> Iterator[Automaton]:
    """The items' automata, each of at most ``block_words`` words and one item more."""
    block, n = Automaton(window), 0
    for item, text in benchmark.select(F.col(id_col).cast("string"), text_col).orderBy(id_col, text_col).toLocalIterator():
        words = words_of(text)
        if not words:
            continue
        block.add(item, words)
        n += len(words)
        if n >= block_words:
            yield block.finish()
            block, n = Automaton(window), 0
    if n:
        yield block.finish()


def find_hits(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id",
              item_text: str = "text", window: int = WINDOW, block_words: int = BLOCK_WORDS) -> DataFrame:
    """``id_col``, ``text_col``, ``n_words bigint``, ``spans array<array<int>>`` (in words), ``items array<string>``, ``no_id boolean``.

    One row per document row. Null and empty texts have no words and no hits; so has everything if there are
    no items. Items without a word are passed over; equal items are all found. Items with a null id make hits as all
    others do; they are not listed in ``items``, ``no_id`` says that one was found.
    """
    spark = docs.sparkSession
    id_type = ddl_type(docs, id_col)
    out = docs.select(id_col, text_col, F.lit(None).cast("bigint").alias("n_words"), F.array().cast("array<array<int>>").alias("spans"),
                      F.array().cast("array<string>").alias("items"), F.lit(False).alias("no_id"))
    schema = f"{id_col} {id_type}, {text_col} string, n_words bigint, spans array<array<int>>, items array<string>, no_id boolean"
    first = True
    for block in list_or_empty(automata(benchmark, item_id, item_text, window, block_words), window):
        if not first:
            out = settle(out, "decontaminate")  # one automaton at a time in an executor's memory
        out, first = map_rows(out, schema, _scanner(spark.sparkContext.broadcast(block))), False
    return out


def list_or_empty(blocks: Iterable[Automaton], window: int) -> Iterator[Automaton]:
    """An automaton without items if there is none, so that words are counted all the same."""
    none = True
    for block in blocks:
        none = False
        yield block
    if none:
        yield Automaton(window).finish()


def _scanner(automaton):
    def rows(columns):
        ids, texts, _, spans, items, no_ids = columns
        scan, counts, all_spans, all_items, all_no_ids = automaton.value.scan, [], [], [], []
        for text, old_spans, old_items, old_no_id in zip(texts, spans, items, no_ids):
            words = words_of(text)
            new_spans, new_items = scan(words)
            counts.append(len(words))
            all_spans.append(_merged(old_spans + new_spans) if old_spans else new_spans)
            all_no_ids.append(old_no_id or None in new_items)
            new_items.discard(None)
            all_items.append(sorted(new_items.union(old_items)))
        return [ids, texts, counts, all_spans, all_items, all_no_ids]

    return rows


def _merged(spans: list[list[int]]) -> list[list[int]]:
    out: list[list[int]] = []
    for start, end in sorted(spans):
        if out and start <= out[-1][1]:
            out[-1][1] = max(out[-1][1], end)
        else:
            out.append([start, end])
    return out


def n_hit(spans: str = "spans"):
    return F.aggregate(spans, F.lit(0).cast("bigint"), lambda n, s: n + s[1] - s[0])


def remove_spans(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", window: int = WINDOW, max_coverage: float = MAX_COVERAGE, **kw) -> DataFrame:
    """The documents with their columns, hit words taken out of the text; mostly hit ones are left out.

    Everything from the first to the last hit word of a stretch goes, and what stands between stretches stays
    as it was. A document without hits keeps its text, null included. If ``max_coverage`` or more of the words
    are hit, the document goes. Duplicate rows are treated one by one.
    """
    place = "_place"
    while place in docs.columns:
        place += "_"
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias(place), F.col(f"`{text_col}`").alias("text"))
    # The row travels along as the id; find_hits does not look into it.
    hits = find_hits(whole, benchmark, id_col=place, window=window, **kw)
    kept = hits.where((F.size("spans") == 0) | (n_hit() < max_coverage * F.col("n_words")))
    cut = map_rows(kept.select(place, "text", "spans"), f"{place} {ddl_type(kept, place)}, text string",
                   lambda columns: [columns[0], [cut_text(t, s) if s else t for t, s in zip(columns[1], columns[2])]])
    return cut.select(*[F.col("text").alias(c) if c == text_col else F.col(f"{place}.`{c}`").alias(c) for c in docs.columns])


def cut_text(text: str, spans: list[list[int]]) -> str:
    """The text without the words of the spans, and without what stands between words of one span."""
    raw = text.encode()
    folded = raw.translate(_FOLD)
    bounds, at = [], 0
    for word in folded.split():
        at = folded.index(word, at)
        bounds.append((at, at + len(word)))
        at += len(word)
    out, at = [], 0
    for first, behind in spans:
        out.append(raw[at:bounds[first][0]])
        at = bounds[behind - 1][1]
    return (b"".join(out) + raw[at:]).decode()


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``n_items`` counts the listed ids, and all found items with a null id as one more; the digest is of the listed ids."""
    hits = find_hits(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))
    return hits.select("doc_id", "n_words", n_hit().alias("n_hit"), (F.size("items") + F.col("no_id").cast("int")).cast("bigint").alias("n_items"),
                       F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), (F.size("spans") > 0).alias("contaminated"))


_SQL = r"""
WITH item AS (SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') w FROM benchmark),
win AS (SELECT item_id, list_slice(w, i, i + n - 1) g, n FROM (SELECT item_id, w, least(10, len(w)) n, unnest(range(1, len(w) - least(10, len(w)) + 2)) i FROM item WHERE len(w) > 0)),
doc AS (SELECT row_number() OVER () rid, doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) w FROM documents),
gram AS (SELECT rid, p, n, list_slice(w, p, p + n - 1) g FROM (SELECT rid, w, n, unnest(range(1, len(w) - n + 2)) p FROM doc, (SELECT DISTINCT n FROM win) WHERE len(w) >= n)),
hit AS (SELECT rid, p, gram.n, item_id FROM gram JOIN win ON gram.g = win.g),
words AS (SELECT rid, count(DISTINCT q) n_hit FROM (SELECT rid, unnest(range(p, p + n)) q FROM hit) GROUP BY rid),
items AS (SELECT rid, count(*) n_items, string_agg(i, ',' ORDER BY i) s FROM (SELECT DISTINCT rid, CAST(item_id AS VARCHAR) i FROM hit) GROUP BY rid)
SELECT doc_id, len(w) n_words, coalesce(n_hit, 0) n_hit, coalesce(n_items, 0) n_items, sha256(coalesce(s, '')) items_sha256, coalesce(n_hit, 0) > 0 contaminated
FROM doc LEFT JOIN words USING (rid) LEFT JOIN items USING (rid)
"""

QUERIES = {"op10_decontaminate": op10_decontaminate}
ORACLES = {"op10_decontaminate": _SQL}
