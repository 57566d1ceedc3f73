"""Byte-level BPE encoding and decoding by the ranks of a public vocabulary file.

The text is split by the tokenizer's pattern and every piece is merged apart. As the pattern never joins
what stands before white space with what follows (but for one leading blank), a text is first cut there by a
plain pattern, and only chunks not seen before go through the full one. All distinct pieces that a batch adds
are encoded together: pieces of similar byte length share a padded matrix of token ids; in each
round every row looks its adjacent pairs up in an open-addressing hash table, merges its leftmost pair of
least rank, and rows without a mergeable pair leave the matrix. Pieces too long for a matrix
(``LONG`` bytes, such as kilometres of one letter) are merged in the same order through a heap, as a
matrix would need as many rounds as they have bytes.

Ids are turned back into bytes through the id table. The vocabulary (about a megabyte, of a fixed size) is
read on the driver and broadcast; its path is a parameter.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import re
from collections.abc import Iterable, Sequence
from itertools import chain, filterfalse, islice

import numpy as np
import regex
from pyspark.sql import DataFrame, SparkSession

from rastro.llm.common import ddl_type, map_rows, read

#: Bytes of a piece from which on the heap is used; below, lengths are bucketed by powers of two.
LONG = 512
#: Chunks and pieces a task remembers; when full, the newer half goes, as frequent ones come early.
REMEMBERED = 250_000
#: Unicode's white space, which is what ``\\s`` means to the tokenizer.
_BLANK = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: Cuts at white space as the tokenizer's pattern does.
CHUNK = f" ?[^{_BLANK}]+|[{_BLANK}]+(?![^{_BLANK}])|[{_BLANK}]+"
_EMPTY = np.int64(-1)
_NO_RANK = np.int32(2**31 - 1)


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in f if line.strip())}


class Vocabulary:
    """Ids, bytes and the hashed pair table of one rank file."""

    def __init__(self, ranks: dict[bytes, int]):
        self.size = max(ranks.values()) + 1
        self.bytes_of: list[bytes | None] = [None] * self.size
        for token, rank in ranks.items():
            self.bytes_of[rank] = token
        self.text_of = [str(i) for i in range(self.size)]
        self.byte_ids = np.array([ranks[bytes([b])] for b in range(256)], dtype=np.int32)
        pairs = {}
        for token, rank in ranks.items():
            for cut in range(1, len(token)):
                left, right = ranks.get(token[:cut]), ranks.get(token[cut:])
                if left is not None and right is not None:
                    pairs[left * self.size + right] = rank
        self.pairs = pairs
        self._hash(pairs)

    def _hash(self, pairs: dict[int, int]) -> None:
        """Open addressing with linear probing, at most a quarter full; all keys are placed a round at a time."""
        bits = max(4, (4 * max(1, len(pairs)) - 1).bit_length())
        self.shift = np.uint64(64 - bits)
        self.mask = np.int64((1 << bits) - 1)
        self.slots = np.full(1 << bits, _EMPTY, dtype=np.int64)
        self.ranks = np.full(1 << bits, _NO_RANK, dtype=np.int32)
        keys = np.fromiter(pairs.keys(), dtype=np.int64, count=len(pairs))
        values = np.fromiter(pairs.values(), dtype=np.int32, count=len(pairs))
        at = self._slot(keys)
        while len(keys):
            free = self.slots[at] == _EMPTY
            winners, first = np.unique(at[free], return_index=True)
            chosen = np.flatnonzero(free)[first]
            self.slots[winners], self.ranks[winners] = keys[chosen], values[chosen]
            left = np.ones(len(keys), dtype=bool)
            left[chosen] = False
            keys, values, at = keys[left], values[left], (at[left] + 1) & self.mask

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def rank_of_pairs(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each adjacent pair, or a number above all ranks; a negative id pairs with nothing."""
        keys = left.astype(np.int64) * self.size + right
        keys[(left < 0) | (right < 0)] = -2
        flat = keys.ravel()
        out = np.full(len(flat), _NO_RANK, dtype=np.int32)
        open_ = np.flatnonzero(flat >= 0)
        at = self._slot(flat[open_])
        while len(open_):
            held = self.slots[at]
            found = held == flat[open_]
            out[open_[found]] = self.ranks[at[found]]
            on = ~found & (held != _EMPTY)
            open_, at = open_[on], (at[on] + 1) & self.mask
        return out.reshape(keys.shape)

    def encode_pieces(self, pieces: Sequence[bytes]) -> list[bytes]:
        """Ids of every piece, as packed 32-bit integers, in the order given. An empty piece has none."""
        out = [b""] * len(pieces)
        buckets: dict[int, list[int]] = {}
        for i, piece in enumerate(pieces):
            n = len(piece)
            if n == 1:
                out[i] = self.byte_ids[piece[0]].tobytes()
            elif n >= LONG:
                out[i] = self._encode_long(piece)
            elif n:
                buckets.setdefault((n - 1).bit_length(), []).append(i)
        for members in buckets.values():
            self._encode_bucket(pieces, members, out)
        return out

    def _encode_bucket(self, pieces: Sequence[bytes], members: list[int], out: list) -> None:
        rows = np.array(members)
        lengths = np.array([len(pieces[i]) for i in members])
        width = int(lengths.max())
        ids = np.full((len(members), width), -1, dtype=np.int32)
        flat = self.byte_ids[np.frombuffer(b"".join(pieces[i] for i in members), dtype=np.uint8)]
        ids[np.arange(width) < lengths[:, None]] = flat
        ranks = self.rank_of_pairs(ids[:, :-1], ids[:, 1:])
        while True:
            best = ranks.argmin(axis=1)  # the leftmost of equals
            live = ranks[np.arange(len(rows)), best] != _NO_RANK
            if not live.all():
                done = np.flatnonzero(~live)
                packed = ids[done][np.arange(width) < lengths[done][:, None]].tobytes()
                ends = 4 * np.cumsum(lengths[done])
                for r, start, end in zip(rows[done].tolist(), (ends - 4 * lengths[done]).tolist(), ends.tolist()):
                    out[r] = packed[start:end]
                rows, lengths, ids, ranks, best = rows[live], lengths[live], ids[live], ranks[live], best[live]
                if not len(rows):
                    return
                width = int(lengths.max())
                ids, ranks = ids[:, :width], ranks[:, : width - 1]
            line = np.arange(len(rows))
            ids[line, best] = ranks[line, best]
            # close the gap behind the merged pair
            behind = np.arange(width - 1) > best[:, None]
            ids[:, :-1] = np.where(behind, ids[:, 1:], ids[:, :-1])
            ids[:, -1] = -1
            if width > 2:
                after = np.arange(width - 2) >= best[:, None]
                ranks[:, :-1] = np.where(after, ranks[:, 1:], ranks[:, :-1])
            ranks[:, -1] = _NO_RANK
            lengths = lengths - 1
            # only the two pairs beside the new token are new
            has_left = best > 0
            at = best[has_left]
            who = line[has_left]
            ranks[who, at - 1] = self.rank_of_pairs(ids[who, at - 1], ids[who, at])
            has_right = best < width - 1
            at = best[has_right]
            who = line[has_right]
            ranks[who, at] = self.rank_of_pairs(ids[who, at], ids[who, at + 1])

    def _encode_long(self, piece: bytes) -> bytes:
        ids = self.byte_ids[np.frombuffer(piece, dtype=np.uint8)].tolist()
        n, size, pairs = len(ids), self.size, self.pairs
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = []
        for i in range(n - 1):
            rank = pairs.get(ids[i] * size + ids[i + 1])
            if rank is not None:
                heap.append((rank, i, ids[i], ids[i + 1]))
        heapq.heapify(heap)
        while heap:
            rank, i, left, right = heapq.heappop(heap)
            j = after[i]
            if ids[i] != left or j >= n or ids[j] != right:
                continue  # one of the two has been merged meanwhile
            ids[i], ids[j] = rank, -1
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                new = pairs.get(rank * size + ids[k])
                if new is not None:
                    heapq.heappush(heap, (new, i, rank, ids[k]))
            h = before[i]
            if h >= 0:
                new = pairs.get(ids[h] * size + rank)
                if new is not None:
                    heapq.heappush(heap, (new, h, ids[h], rank))
        return np.array([i for i in ids if i >= 0], dtype=np.int32).tobytes()

    def decode(self, ids: Iterable[int]) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))


class Encoder:
    """Encodes texts of one task and remembers chunks and pieces it has seen."""

    def __init__(self, vocabulary: Vocabulary, pattern: str):
        self.vocabulary = vocabulary
        self.cut = re.compile(CHUNK).findall
        self.split = regex.compile(pattern.replace(r"[^\s", f"[^{_BLANK}").replace(r"\s", f"[{_BLANK}]").replace(r"\S", f"[^{_BLANK}]")).findall
        self.chunks: dict[str, bytes] = {}
        self.pieces: dict[str, bytes] = {}

    def encode(self, texts: Sequence[str]) -> list[np.ndarray]:
        cut = [self.cut(t) for t in texts]
        self.chunks, new = _unseen(self.chunks, cut)
        if new:
            split = [self.split(c) for c in new]
            self.pieces, pieces = _unseen(self.pieces, split)
            self.pieces.update(zip(pieces, self.vocabulary.encode_pieces([p.encode() for p in pieces])))
            get = self.pieces.__getitem__
            self.chunks.update((c, get(p[0]) if len(p) == 1 else b"".join(map(get, p))) for c, p in zip(new, split))
        get = self.chunks.__getitem__
        return [np.frombuffer(b"".join(map(get, chunks)), dtype=np.int32) for chunks in cut]


def _unseen(memory: dict, lists: list[list[str]]) -> tuple[dict, list[str]]:
    """The memory, halved where it would grow too large, and the strings that it lacks."""
    new = set(filterfalse(memory.__contains__, chain.from_iterable(lists)))
    if len(memory) + len(new) > REMEMBERED and memory:
        memory = dict(islice(memory.items(), REMEMBERED // 2))
        new = set(filterfalse(memory.__contains__, chain.from_iterable(lists)))
    return memory, list(new)


def broadcast_vocabulary(spark: SparkSession, path: str):
    return spark.sparkContext.broadcast(Vocabulary(read_ranks(path)))


def encode_and_decode(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col``, ``ids array<int>``, ``decoded binary`` for every row; other columns are not read.

    A null text counts as empty and gives no ids. Rows with equal or null ids are encoded one by one; no
    rows give no rows. Special tokens are plain text. Lone surrogates cannot occur in Spark strings.
    """
    vocabulary = broadcast_vocabulary(docs.sparkSession, path)

    def rows(columns, encoder):
        ids = encoder.encode([t or "" for t in columns[1]])
        return [columns[0], ids, [encoder.vocabulary.decode(i.tolist()) for i in ids]]

    return map_rows(docs.select(id_col, text_col), f"{id_col} {ddl_type(docs, id_col)}, ids array<int>, decoded binary", rows, lambda: Encoder(vocabulary.value, pattern))


def digests(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """As :func:`encode_and_decode`, with digests in the place of ids and bytes, taken where they are made."""
    vocabulary = broadcast_vocabulary(docs.sparkSession, path)

    def rows(columns, encoder):
        ids = [i.tolist() for i in encoder.encode([t or "" for t in columns[1]])]
        v = encoder.vocabulary
        return [columns[0], [len(i) for i in ids],
                [hashlib.sha256(" ".join(map(v.text_of.__getitem__, i)).encode()).hexdigest() for i in ids],
                [hashlib.sha256(v.decode(i)).hexdigest() for i in ids]]

    schema = f"{id_col} {ddl_type(docs, id_col)}, n_tokens bigint, ids_sha256 string, decoded_sha256 string"
    return map_rows(docs.select(id_col, text_col), schema, rows, lambda: Encoder(vocabulary.value, pattern))


def op3_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return digests(read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


QUERIES = {"op3_byte_bpe": op3_byte_bpe}
ORACLES = {}
