"""Byte-pair encoding of whole partitions through an index of pair occurrences, and decoding.

The distinct pieces of a partition's texts stand in one array of symbols. An index maps each rank to
all positions of its pair. Active ranks are taken in ascending order; a rank's positions are merged at
once, and the new pairs to their left and right go onto the lists of their own ranks. Positions that
an earlier merge has used up are recognised when their list comes up.
"""

from __future__ import annotations

import heapq
import json
import re
from array import array
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pairlab.llm.common import batches_of, byte_letters, kept, slices, strings

#: The pre-tokenizer's pattern of byte-level vocabularies, for any text and for ASCII.
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"
ASCII = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?[A-Za-z]+| ?[0-9]+| ?[^\t-\r A-Za-z0-9]+|[\t-\r ]+(?![^\t-\r ])|[\t-\r ]+")
NONE = np.int64(1 << 40)


class _Numbers(dict):
    """Numbers its keys from 0 in the order in which they come."""

    def __missing__(self, key: str) -> int:
        number = self[key] = len(self)
        return number


class PairIndex:
    """A vocabulary and its merges, read from a tokenizer file with byte-level pieces."""

    def __init__(self, path: str, keep: int = 500_000) -> None:
        import regex

        with open(path, encoding="utf-8") as f:
            file = json.load(f)
        vocab, merges = file["model"]["vocab"], file["model"]["merges"]
        pairs = [m if isinstance(m, list) else m.split(" ") for m in merges]
        letters = byte_letters()
        self.first = np.array([vocab[c] for c in letters], np.int64)
        ranked = np.array([(vocab[a], vocab[b], vocab[a + b]) for a, b in pairs], np.int64).reshape(-1, 3)
        self.left, self.right, self.made = ranked.T.copy()
        by_key = np.argsort(self.left << 32 | self.right)
        self.keys, self.ranks = (self.left << 32 | self.right)[by_key], by_key
        born = np.full(max(vocab.values()) + 1, -1, np.int64)
        born[self.made[::-1]] = np.arange(len(pairs))[::-1]
        if (np.maximum(born[self.left], born[self.right]) >= np.arange(len(pairs))).any():
            raise ValueError("a merge comes before the merges that make its parts")
        back = {c: b for b, c in enumerate(letters)}
        self.special = {t["content"]: t["id"] for t in file["added_tokens"]}
        size = max([*vocab.values(), *self.special.values()]) + 1
        spelt = [b""] * size
        for token, i in vocab.items():
            spelt[i] = bytes(back[c] for c in token)
        for token, i in self.special.items():
            spelt[i] = token.encode()
        self.spelt_ends = slices(None, [len(s) for s in spelt])
        self.spelt = np.frombuffer(b"".join(spelt), np.uint8)
        self.pieces = regex.compile(PIECES)
        self.cut = re.compile("(" + "|".join(re.escape(s) for s in sorted(self.special, key=len, reverse=True)) + ")") if self.special else None
        self.keep = keep
        self._forget()

    def _forget(self) -> None:
        self.entries: dict[str, int] = _Numbers((s, k) for k, s in enumerate(self.special))
        self.ids = np.array([self.special[s] for s in self.entries], np.uint32)
        self.lengths = np.ones(len(self.entries), np.int64)

    def _rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        key = a << 32 | b
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.ranks[at], NONE)

    def merge(self, words: Sequence[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words in a row, and how many each has."""
        sizes = np.array([len(w) for w in words], np.int64)
        symbol = self.first[np.frombuffer(b"".join(words), np.uint8)]
        n = len(symbol)
        after, before = np.arange(1, n + 1), np.arange(-1, n - 1)
        ends = np.cumsum(sizes)[sizes > 0]
        after[ends - 1] = -1
        before[(ends - sizes[sizes > 0])] = -1
        alive = np.ones(n, bool)
        lists: dict[int, list[np.ndarray]] = {}
        active: list[int] = []

        def note(at: np.ndarray) -> None:
            """Put the pairs that begin at these positions on the lists of their ranks."""
            rank = self._rank(symbol[at], symbol[after[at]])
            known = rank < NONE
            at, rank = at[known], rank[known]
            order = np.argsort(rank, kind="stable")
            at, rank = at[order], rank[order]
            bounds = np.flatnonzero(np.diff(rank, prepend=-1)).tolist() + [len(rank)]
            for a, b in zip(bounds[:-1], bounds[1:]):
                r = int(rank[a])
                if r not in lists:
                    lists[r] = []
                    heapq.heappush(active, r)
                lists[r].append(at[a:b])

        if len(self.keys):
            note(np.flatnonzero(after >= 0))
        while active:
            rank = heapq.heappop(active)
            found = lists.pop(rank)
            at = found[0] if len(found) == 1 else np.concatenate(found)
            left, right = self.left[rank], self.right[rank]
            at = at[alive[at] & (symbol[at] == left) & (after[at] >= 0)]
            at = at[symbol[after[at]] == right]
            if len(found) > 1 or left == right:
                at = np.unique(at)
            if left == right and len(at) > 1:  # of a run, every other pair
                fresh = np.concatenate([[True], at[1:] != after[at[:-1]]])
                since = np.arange(len(at)) - np.maximum.accumulate(np.where(fresh, np.arange(len(at)), 0))
                at = at[since % 2 == 0]
            if not len(at):
                continue
            gone = after[at]
            alive[gone] = False
            symbol[at] = self.made[rank]
            beyond = after[gone]
            after[at] = beyond
            inner = beyond >= 0
            before[beyond[inner]] = at[inner]
            ahead = before[at]
            note(np.concatenate([ahead[ahead >= 0], at[inner]]))
        starts = slices(None, sizes)
        kept = slices(None, alive)
        return symbol[alive], np.diff(kept[starts])

    def split(self, text: str) -> list[str]:
        """The pieces of a text; special tokens are pieces of their own."""
        if self.cut is not None and "<|" in text:
            return [p for k, part in enumerate(self.cut.split(text)) for p in ([part] if k % 2 else self._plain(part))]
        return self._plain(text)

    def _plain(self, text: str) -> list[str]:
        return (ASCII if text.isascii() else self.pieces).findall(text)

    def encode(self, texts: Sequence[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in a row, and how many each has. Pieces met before are not merged again."""
        if len(self.entries) > self.keep:
            self._forget()
        entries, table, known = array("q"), self.entries, len(self.entries)
        counts = []
        for text in texts:
            found = self.split(text or "")
            counts.append(len(found))
            entries.extend(map(table.__getitem__, found))  # a new piece gets the next number
        if len(table) > known:
            ids, lengths = self.merge([p.encode() for p in list(table)[known:]])
            self.ids, self.lengths = np.concatenate([self.ids, ids.astype(np.uint32)]), np.concatenate([self.lengths, lengths])
        all_starts = slices(None, self.lengths)
        entry = np.frombuffer(entries, np.int64)
        ends = slices(None, counts)
        per_text = np.add.reduceat(np.append(self.lengths[entry], 0), np.minimum(ends[:-1], len(entry)))
        per_text[np.diff(ends) == 0] = 0
        out, at = np.empty(int(per_text.sum()), np.uint32), 0
        for some in range(0, len(entry), 1 << 20):  # a few entries at a time: places take twice the room of ids
            e = entry[some : some + (1 << 20)]
            lengths = self.lengths[e]
            inner = slices(None, lengths)
            where = np.repeat(all_starts[e] - inner[:-1], lengths) + np.arange(inner[-1])
            out[at : at + len(where)] = self.ids[where]
            at += len(where)
        return out, per_text

    def decode(self, ids: np.ndarray) -> bytes:
        """The UTF-8 text of ids; bytes that are no UTF-8 become U+FFFD."""
        lengths = np.diff(self.spelt_ends)[ids]
        ends = slices(None, lengths)
        where = np.repeat(self.spelt_ends[:-1][ids] - ends[:-1], lengths) + np.arange(ends[-1])
        body = self.spelt[where].tobytes()
        try:
            body.decode()
        except UnicodeDecodeError:
            body = body.decode("utf-8", "replace").encode()
        return body


_INDEXES: dict[str, PairIndex] = kept()


def index(path: str) -> PairIndex:
    """One vocabulary per worker and file, kept between tasks."""
    if path not in _INDEXES:
        _INDEXES[path] = PairIndex(path)
    return _INDEXES[path]


def encode_texts(df: DataFrame, key: str, text: str, tokenizer: str, unit: int = 1 << 25) -> DataFrame:
    """key, ids, decoded: ids (packed little-endian unsigned 32 bits) and decoded UTF-8 of every text.

    A task works through its partition in units of `unit` characters, or one text if that is
    longer; a unit's new pieces are merged together. There is no shuffle. Null texts count as empty
    and have no ids; keys may be null or repeat; no rows give no rows; other columns are not read.
    """

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs = index(tokenizer)
        field = None

        def rows() -> Iterator[tuple]:
            nonlocal field
            for found in source:
                field = found.schema.field(0).type
                yield from zip(found.column(0).to_pylist(), strings(found, "text"))

        for part in batches_of(rows(), 1, unit):
            ids, counts = pairs.encode([t for _, t in part])
            ends = slices(None, counts)
            for some in range(0, len(part), 256):
                here = range(some, min(some + 256, len(part)))
                yield pa.RecordBatch.from_arrays([
                    pa.array([part[i][0] for i in here], field),
                    pa.array([ids[ends[i] : ends[i + 1]].astype("<u4").tobytes() for i in here], pa.binary()),
                    pa.array([pairs.decode(ids[ends[i] : ends[i + 1]]) for i in here], pa.binary()),
                ], names=["key", "ids", "decoded"])

    rows = df.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"))
    schema = T.StructType([
        T.StructField("key", rows.schema["key"].dataType), T.StructField("ids", T.BinaryType()),
        T.StructField("decoded", T.BinaryType()),
    ])
    return rows.mapInArrow(run, schema).withColumnRenamed("key", key)
