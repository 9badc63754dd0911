"""SentencePiece encoding of whole texts by vectorised merge rounds, and decoding.

A partition's new words lie in one flat array of symbols. In a round every word finds the least rank
among its adjacent pairs (a segmented minimum), merges the pairs of that rank from the left, and the
array is compacted. Words without a pair leave; the rounds end when none is left.

Two things make this exact. Words are cut where no piece of the vocabulary goes across. And a word
merges all pairs of its least rank at once only if the piece they make is not itself the first choice
of a further merge; else it merges the leftmost pair alone, as the priority queue of the library does.
Words of more than `LONG` symbols, which no prose has, would need too many of such rounds: they go
through a priority queue of their own, with the same pairs and ranks.
"""

from __future__ import annotations

import codecs
import heapq
import re
from array import array
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pairlab.llm.common import batches_of, kept, slices, strings

#: The symbol that stands for a space, and what an unknown piece is decoded to.
SPACE_SYMBOL, UNKNOWN_TEXT = "▁", " ⁇ "
NONE = np.int32(1 << 30)
LONG = 1024

codecs.register_error("pairlab-each-byte", lambda e: ("�", e.start + 1))


def _fields(body: bytes) -> Iterator[tuple[int, object]]:
    """(number, value) of the fields of a serialized message; nested messages stay bytes."""
    at = 0

    def number() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = body[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < len(body):
        tag = number()
        if tag & 7 == 0:
            yield tag >> 3, number()
            continue
        size = {1: 8, 5: 4}.get(tag & 7) or number()
        yield tag >> 3, body[at : at + size]
        at += size


class MergeRounds:
    """A model's pieces and pairs. BPE models with byte fallback and plain text rules are supported."""

    def __init__(self, path: str, keep: int = 400_000) -> None:
        from sentencepiece import SentencePieceProcessor

        library = SentencePieceProcessor(model_file=path)
        top = list(_fields(library.serialized_model_proto()))
        training = dict(next((_fields(v) for k, v in top if k == 2), ()))
        rules = dict(next((_fields(v) for k, v in top if k == 3), ()))
        kinds = [dict(_fields(v)).get(3, 1) for k, v in top if k == 1]
        suffix = training.get(24, 0)
        if training.get(3, 1) != 2 or rules.get(2) or rules.get(4, 1) or not rules.get(5, 1) or suffix or not {1, 2, 3, 6} >= set(kinds):
            raise ValueError(f"{path}: only BPE models of plain pieces that change nothing in a text are supported")
        self.prefix = bool(rules.get(3, 1))
        size = library.get_piece_size()
        pieces = [library.id_to_piece(i) for i in range(size)]
        self.end = library.eos_id()
        plain = {pieces[i]: i for i in range(size) if kinds[i] == 1}
        score = np.array([library.get_score(i) for i in range(size)])
        # Equal scores are one rank: the leftmost pair goes first.
        rank = np.unique(-score, return_inverse=True)[1].astype(np.int32)

        # Symbols are the pieces and, behind them, letters that only occur inside pieces.
        letters = sorted({c for p in plain for c in p} - set(plain))
        symbol = plain | {c: size + k for k, c in enumerate(letters)}
        pairs = {}
        for piece, i in plain.items():
            for k in range(1, len(piece)):
                if piece[:k] in symbol and piece[k:] in symbol:
                    pairs[symbol[piece[:k]] << 32 | symbol[piece[k:]]] = i
        self.keys = np.array(sorted(pairs), np.int64)
        self.made = np.array([pairs[k] for k in self.keys.tolist()], np.int32)
        self.ranks = rank[self.made] if len(self.made) else np.zeros(0, np.int32)
        # Pieces that go on merging before others of their own rank do.
        self.restless = np.zeros(size + len(letters), bool)
        padded = np.append(rank, np.full(len(letters), -1, np.int32))
        for part in (self.keys >> 32, self.keys & 0xFFFFFFFF):
            self.restless[part[self.ranks <= padded[part]]] = True

        self.symbol_of = np.full(0x110000, -1, np.int32)
        for c, i in symbol.items():
            if len(c) == 1:
                self.symbol_of[ord(c)] = i
        self.bigrams = np.unique([ord(p[k]) << 32 | ord(p[k + 1]) for p in plain for k in range(len(p) - 1)] or [-1])
        inner = any(SPACE_SYMBOL in p.lstrip(SPACE_SYMBOL) for p in plain)
        self.words = re.compile(r".+" if inner else rf"{SPACE_SYMBOL}+[^{SPACE_SYMBOL}]*|[^{SPACE_SYMBOL}]+", re.S)

        bytes_of = {int(pieces[i][3:-1], 16): i for i in range(size) if kinds[i] == 6}
        self.unknown = library.unk_id()
        self.byte = np.array([bytes_of.get(b, self.unknown) for b in range(256)], np.int32)
        self.fallback = len(bytes_of) == 256
        back = {i: bytes([b]) for b, i in bytes_of.items()}
        named = {1: lambda p: p.replace(SPACE_SYMBOL, " ").encode(), 2: lambda p: UNKNOWN_TEXT.encode(), 3: lambda p: b""}
        spelt = [back[i] if kinds[i] == 6 else named[kinds[i]](pieces[i]) for i in range(size)]
        self.spaced = np.array([kinds[i] == 1 and pieces[i].startswith(SPACE_SYMBOL) for i in range(size)])
        self.silent = np.array([kinds[i] == 3 for i in range(size)])
        self.spelt_ends = slices(None, [len(s) for s in spelt])
        self.spelt = np.frombuffer(b"".join(spelt), np.uint8)
        self.known: dict[int, tuple[int, int]] | None = None  # pairs as a dictionary, for long words alone
        self.keep = keep
        self._forget()

    def _forget(self) -> None:
        self.entries: dict[str, int] = {}
        self.ids, self.lengths = np.zeros(0, np.int32), np.zeros(0, np.int64)

    def _pairs(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank and piece of each pair of symbols; rank NONE if they make no piece."""
        if not len(self.keys):
            return np.full(len(a), NONE), np.zeros(len(a), np.int32)
        key = a.astype(np.int64) << 32 | b
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        known = self.keys[at] == key
        return np.where(known, self.ranks[at], NONE), self.made[at]

    def merge(self, words: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words in a row, and how many each has."""
        code = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32).astype(np.int64)
        sizes = np.array([len(w) for w in words], np.int64)
        owner = np.repeat(np.arange(len(words)), sizes)
        if not len(code):
            return np.zeros(0, np.int32), sizes
        joined = np.concatenate([[False], np.isin(code[:-1] << 32 | code[1:], self.bigrams) & (owner[1:] == owner[:-1])])
        part = np.cumsum(~joined) - 1  # parts that no piece reaches beyond
        symbol = self.symbol_of[code]
        long = np.bincount(part)[part] > LONG
        done: list[tuple[np.ndarray, np.ndarray]] = []  # (place, symbol)
        starts = np.flatnonzero(long & ~joined).tolist()
        for a in starts:
            b = a + int(np.argmax(part[a:] != part[a])) if part[-1] != part[a] else len(part)
            places, symbols = self._agenda(symbol[a:b].tolist())
            done.append((np.array(places, np.int64) + a, np.array(symbols, np.int32)))
        place = np.flatnonzero(~long)
        done += self._rounds(symbol[place], part[place], place)
        place = np.concatenate([p for p, _ in done])
        order = np.argsort(place, kind="stable")
        place, symbol = place[order], np.concatenate([s for _, s in done])[order]
        return self._spell(symbol, code[place], owner[place], len(words))

    def _rounds(self, symbol: np.ndarray, part: np.ndarray, place: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        done = []
        n = len(symbol)
        rank, made = np.full(n, NONE), np.zeros(n, np.int32)

        def look(at: np.ndarray) -> None:
            at = at[at >= 0]
            last = (at + 1 >= len(symbol)) | (part[np.minimum(at + 1, len(symbol) - 1)] != part[at])
            rank[at[last]] = NONE
            at = at[~last]
            rank[at], made[at] = self._pairs(symbol[at], symbol[at + 1])

        look(np.arange(n))
        while len(symbol):
            starts = np.flatnonzero(np.diff(part, prepend=-1))
            least = np.minimum.reduceat(rank, starts)
            sizes = np.diff(np.append(starts, len(symbol)))
            idle = np.repeat(least == NONE, sizes)
            if idle.any():
                done.append((place[idle], symbol[idle]))
                stay = ~idle
                symbol, part, place, rank, made = (x[stay] for x in (symbol, part, place, rank, made))
                if not len(symbol):
                    break
                sizes, least = sizes[least < NONE], least[least < NONE]
            at = np.flatnonzero(rank == np.repeat(least, sizes))
            fresh = np.diff(part[at], prepend=-1) != 0
            # Of overlapping pairs every other one merges, from the left.
            chain = np.flatnonzero(fresh | (np.diff(at, prepend=-2) != 1))
            since = np.arange(len(at)) - np.repeat(chain, np.diff(np.append(chain, len(at))))
            first = np.flatnonzero(fresh)
            restless = np.maximum.reduceat(self.restless[made[at]], first)
            alone = np.repeat(restless, np.diff(np.append(first, len(at))))
            at = at[np.where(alone, fresh, since % 2 == 0)]
            symbol[at] = made[at]
            stay = np.ones(len(symbol), bool)
            stay[at + 1] = False
            moved = np.cumsum(stay) - 1
            symbol, part, place, rank, made = (x[stay] for x in (symbol, part, place, rank, made))
            at = moved[at]
            look(np.unique(np.concatenate([at - 1, at])))
        return done

    def _agenda(self, symbol: list[int]) -> tuple[list[int], list[int]]:
        """One long word: the pairs in a priority queue by rank, then place."""
        n = len(symbol)
        after, before = list(range(1, n)) + [-1], list(range(-1, n - 1))
        if self.known is None:
            self.known = dict(zip(self.keys.tolist(), zip(self.ranks.tolist(), self.made.tolist())))

        def pair(a: int) -> list[tuple]:
            b = after[a] if a >= 0 else -1
            found = self.known.get(symbol[a] << 32 | symbol[b]) if b >= 0 and symbol[a] >= 0 and symbol[b] >= 0 else None
            return [(found[0], a, symbol[a], symbol[b], found[1])] if found else []

        queue = [item for a in range(n - 1) for item in pair(a)]
        heapq.heapify(queue)
        gone = bytearray(n)
        while queue:
            _, a, left, right, made = heapq.heappop(queue)
            b = after[a]
            if gone[a] or symbol[a] != left or b < 0 or symbol[b] != right:
                continue
            symbol[a] = made
            gone[b] = 1
            after[a] = after[b]
            if after[b] >= 0:
                before[after[b]] = a
            for item in pair(before[a]) + pair(a):
                heapq.heappush(queue, item)
        places = [i for i in range(n) if not gone[i]]
        return places, [symbol[i] for i in places]

    def _spell(self, symbol: np.ndarray, code: np.ndarray, owner: np.ndarray, words: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids of symbols: letters without a piece become bytes, or the unknown piece."""
        odd = np.flatnonzero((symbol < 0) | (symbol >= len(self.spaced)))
        if not len(odd):
            return symbol, np.bincount(owner, minlength=words)
        if self.fallback:
            bodies = [chr(c).encode() for c in code[odd].tolist()]
            lengths = np.ones(len(symbol), np.int64)
            lengths[odd] = [len(b) for b in bodies]
            ids = np.repeat(symbol, lengths)
            ids[np.repeat(np.isin(np.arange(len(symbol)), odd), lengths)] = self.byte[np.frombuffer(b"".join(bodies), np.uint8)]
            return ids, np.bincount(np.repeat(owner, lengths), minlength=words)
        ids = symbol.copy()
        ids[odd] = self.unknown
        # Unknown letters that follow each other are one unknown piece.
        stay = ~((ids == self.unknown) & (np.append(-1, ids[:-1]) == self.unknown) & (np.append(-1, owner[:-1]) == owner))
        return ids[stay], np.bincount(owner[stay], minlength=words)

    def encode(self, texts: Sequence[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in a row, and how many each has. Words met before are not merged again."""
        if len(self.entries) > self.keep:
            self._forget()
        table, known, entries, counts, new = self.entries, len(self.entries), array("q"), [], []
        for text in texts:
            body = (SPACE_SYMBOL if self.prefix and text else "") + (text or "").replace(" ", SPACE_SYMBOL)
            found = self.words.findall(body)
            counts.append(len(found))
            for word in found:
                entry = table.get(word)
                if entry is None:
                    entry = table[word] = len(table)
                    new.append(word)
                entries.append(entry)
        if len(table) > known:
            ids, lengths = self.merge(new)
            self.ids, self.lengths = np.concatenate([self.ids, ids]), np.concatenate([self.lengths, lengths])
        starts, entry, ends = slices(None, self.lengths), np.frombuffer(entries, np.int64), slices(None, counts)
        per_word = self.lengths[entry]
        per_text = np.diff(slices(None, per_word)[ends])
        out, at = np.empty(int(per_text.sum()), np.int32), 0
        for some in range(0, len(entry), 1 << 20):  # a few words at a time: places take twice the room of ids
            e, lengths = entry[some : some + (1 << 20)], per_word[some : some + (1 << 20)]
            inner = slices(None, lengths)
            where = np.repeat(starts[e] - inner[:-1], lengths) + np.arange(inner[-1])
            out[at : at + len(where)] = self.ids[where]
            at += len(where)
        return out, per_text

    def decode(self, ids: np.ndarray) -> bytes:
        """The UTF-8 text of ids. The space put before a text goes; a byte that is no UTF-8 becomes U+FFFD."""
        silent = np.flatnonzero(self.silent[ids])
        heard = np.delete(ids, silent)
        lengths = np.diff(self.spelt_ends)[heard]
        ends = slices(None, lengths)
        where = np.repeat(self.spelt_ends[:-1][heard] - ends[:-1], lengths) + np.arange(ends[-1])
        body = self.spelt[where].tobytes()
        skip = int(self.prefix and len(heard) > 0 and self.spaced[heard[0]])
        cuts = ends[silent - np.arange(len(silent))].tolist()  # bytes on both sides of a control piece make no letter
        cuts = [max(c, skip) for c in cuts]
        spans = zip([skip, *cuts], [*cuts, len(body)])
        return b"".join(self._valid(body[a:b]) for a, b in spans)

    @staticmethod
    def _valid(body: bytes) -> bytes:
        try:
            body.decode()
        except UnicodeDecodeError:
            return body.decode("utf-8", "pairlab-each-byte").encode()
        return body


_MODELS: dict[str, MergeRounds] = kept()


def model(path: str) -> MergeRounds:
    """One model per worker and file, kept between tasks."""
    if path not in _MODELS:
        _MODELS[path] = MergeRounds(path)
    return _MODELS[path]


def encode_texts(df: DataFrame, key: str, text: str, path: str, add_end: bool = True, unit: int = 1 << 23) -> DataFrame:
    """key, ids, decoded: ids (array of int, the end id last if `add_end`) and decoded UTF-8 of every text.

    A task works through its partition in units of `unit` characters, or one text if that is
    longer; a unit's new words are merged together. There is no shuffle. Null texts count as empty
    and have the end id alone; keys may be null or repeat; equal texts have equal ids; no rows give
    no rows; other columns are not read. `path` must be readable on every executor.
    """

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rounds = model(path)
        field = None

        def rows() -> Iterator[tuple]:
            nonlocal field
            for found in source:
                field = found.schema.field(0).type
                yield from zip(found.column(0).to_pylist(), strings(found, "text"))

        for part in batches_of(rows(), 1, unit):
            ids, counts = rounds.encode([t for _, t in part])
            ends = slices(None, counts)
            for some in range(0, len(part), 256):
                here = range(some, min(some + 256, len(part)))
                own = [ids[ends[i] : ends[i + 1]] for i in here]
                decoded = [rounds.decode(x) for x in own]
                if add_end:
                    own = [np.append(x, np.int32(rounds.end)) for x in own]
                offsets = pa.array(slices(None, [len(x) for x in own]).astype(np.int32))
                yield pa.RecordBatch.from_arrays([
                    pa.array([part[i][0] for i in here], field),
                    pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(own), pa.int32())),
                    pa.array(decoded, pa.binary()),
                ], names=["key", "ids", "decoded"])

    rows = df.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"))
    schema = T.StructType([
        T.StructField("key", rows.schema["key"].dataType), T.StructField("ids", T.ArrayType(T.IntegerType())),
        T.StructField("decoded", T.BinaryType()),
    ])
    return rows.mapInArrow(run, schema).withColumnRenamed("key", key)
