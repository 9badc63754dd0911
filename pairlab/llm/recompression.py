"""Substring dedup by recompression: long repeats seen through names of runs and pairs.

In every round a run of equal symbols becomes one symbol, and then each adjacent pair of a left and a
right symbol becomes one. A symbol's side is a bit of its name, and a new name is a hash of the names
it is made of, so the names are the same in all documents without a dictionary to shuffle. The inner
symbols of equal substrings are equal in every round; only the outermost ones can differ with what
stands around. That gives

* for each window its anchor: the middle one of the highest symbols that the window's words alone
  determine. Equal windows have equal anchors at equal places, so a window whose anchor's name occurs
  once in the corpus is unique;
* for long repeats high symbols that occur twice: all windows inside are repeated, and the symbol's
  words are verified by one 128-bit hash instead of one per window.

Only windows that neither decides, and one occurrence of each shared high symbol, are compared by
128-bit hashes of their words.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pairlab.llm import meeting
from pairlab.llm.common import batches_of, forget, slices, strings, tasks

ANCHOR, HIGH, WINDOW = 0, 1, 2  # kinds of keys
HIGH_ROUNDS = (12, 16, 20, 24, 28)
_A, _B, _C = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9)
_BASES = (0x9FB21C651E98DF25, 0xD6E8FEB86659FD93)  # odd, so they have inverses


def mix(a: np.ndarray, b: np.ndarray | int = 0) -> np.ndarray:
    """64 bits out of two numbers."""
    x = a * _A + (np.uint64(b * int(_C) & 0xFFFFFFFFFFFFFFFF) if isinstance(b, int) else b.astype(np.uint64) * _C)
    x ^= x >> np.uint64(29)
    x *= _B
    x ^= x >> np.uint64(32)
    x *= _A
    return x ^ (x >> np.uint64(31))


class Spans:
    """128-bit hashes of any span of words, in constant time each."""

    def __init__(self, digests: tuple[np.ndarray, np.ndarray], codes: np.ndarray) -> None:
        self.lanes = []
        for lane, base in zip(digests, _BASES):
            n, one = len(codes), np.ones(1, np.uint64)
            up = np.cumprod(np.concatenate([one, np.full(n, base, np.uint64)]))
            down = np.cumprod(np.concatenate([one, np.full(n, pow(base, -1, 1 << 64), np.uint64)]))
            sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(lane[codes] * up[:-1])])
            self.lanes.append((sums, down))

    def __call__(self, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return tuple(mix((sums[end] - sums[start]) * down[start], (end - start)) for sums, down in self.lanes)


def parse(
    name: np.ndarray, head: np.ndarray, windows: np.ndarray, width: int
) -> tuple[np.ndarray, np.ndarray, list[tuple[np.ndarray, np.ndarray]]]:
    """Rounds of run and pair naming over a chunk's words.

    `head` marks words that begin a document; no symbol reaches over one. Returns for each window
    its anchor's key and the anchor's occurrence, and (start, end) of the symbols of high rounds
    that hold a window at least, the lowest round first.

    A window's core is the range of symbols that its own words determine. Of the core, the first
    and last run may go on outside, a right symbol in front may belong to a pair with what is before,
    and a left symbol at the end to one with what comes after; these leave it. When nothing would be
    left the window's anchor is the middle of what it has.
    """
    total = len(name)
    start = np.arange(total)
    key, occurrence = np.zeros(len(windows), np.uint64), np.zeros(len(windows), np.int64)
    active, low, high = np.arange(len(windows)), windows.copy(), windows + width
    base, long_ones = 0, []
    for turn in range(max(HIGH_ROUNDS) + 1):
        if turn in HIGH_ROUNDS:
            end = np.append(start[1:], total)
            big = end - start >= 2 * width
            if big.any():
                long_ones.append((start[big], end[big]))
        fresh = np.ones(len(name), bool)
        fresh[1:] = (name[1:] != name[:-1]) | head[1:]
        run = np.cumsum(fresh) - 1
        first = np.flatnonzero(fresh)
        size = np.diff(np.append(first, len(name)))
        runs = name[first]
        many = size > 1
        runs[many] = mix(mix(runs[many], turn), size[many])
        heads, starts = head[first], start[first]
        right = mix(runs, 1000 + turn) >> np.uint64(63) == 1
        second = np.zeros(len(runs), bool)
        second[1:] = right[1:] & ~right[:-1] & ~heads[1:]
        kept = np.flatnonzero(~second)
        place = np.cumsum(~second) - 1
        pair = np.append(second[1:], False)[kept]
        names = runs[kept]
        names[pair] = mix(mix(names[pair], 2000 + turn), runs[kept[pair] + 1])
        if len(active):
            a, b = run[low] + 1, run[high - 1]
            live = np.flatnonzero(a < b)
            a, b = a[live], b[live]
            a, b = a + right[a], b - ~right[b - 1]
            more = a < b
            live = live[more]
            ended = np.ones(len(active), bool)
            ended[live] = False
            middle = (low[ended] + high[ended]) >> 1
            key[active[ended]] = mix(name[middle], 3000 + turn)
            occurrence[active[ended]] = base + middle
            active, low, high = active[live], place[a[more]], place[b[more] - 1] + 1
        base += len(name)
        name, head, start = names, heads[kept], starts[kept]
        if not len(active) and head.all():
            break
    if len(active):
        middle = (low + high) >> 1
        key[active] = mix(name[middle], 3000 + turn + 1)
        occurrence[active] = base + middle
    return key, occurrence, long_ones


class Chunk:
    """Some whole documents as word codes."""

    def __init__(self, row: dict, width: int) -> None:
        forget()
        self.id, self.keys, self.width = row["chunk"], row["keys"], width
        self.words = row["vocabulary"].split(b" ")
        self.codes = np.frombuffer(row["codes"], np.int32)
        digests = np.frombuffer(
            b"".join(hashlib.blake2b(w, digest_size=16).digest() for w in self.words), np.uint64
        ).reshape(-1, 2)
        self.ends = slices(None, row["counts"])
        lengths = np.diff(self.ends)
        self.head = np.zeros(len(self.codes), bool)
        self.head[self.ends[:-1][lengths > 0]] = True
        place = np.arange(len(self.codes))
        self.windows = np.flatnonzero(np.repeat(self.ends[1:], lengths) - place >= width)
        self.names = digests[:, 0].copy()
        self.spans = Spans((self.names, digests[:, 1].copy()), self.codes)

    def analyse(self) -> None:
        """Unique anchor names and high symbols, in the order in which they are sent."""
        anchor, occurrence, self.long = parse(self.names[self.codes], self.head, self.windows, self.width)
        one, self.of_window, _ = meeting.unique(occurrence.astype(np.uint64))
        names = anchor[one]
        self.anchor_at, self.anchor_number, self.anchor_counts = meeting.unique(names)
        self.anchors = names[self.anchor_at]
        if self.long:
            start, end = (np.concatenate(x) for x in zip(*self.long))
            once = np.sort(np.unique(start * (len(self.codes) + 1) + end, return_index=True)[1])
            start, end = start[once], end[once]  # a symbol that no round changes is one occurrence
        else:
            start = end = np.zeros(0, np.int64)
        self.long_start, self.long_end = start, end
        first, second = self.spans(start, end)
        at, self.long_number, self.long_counts = meeting.unique(first, second)
        self.long_keys = first[at], second[at]

    def ask(self, buckets: int) -> Iterator[tuple]:
        self.analyse()
        yield from meeting.send(self.id, ANCHOR, buckets, self.anchors, None, self.anchor_counts > 1)
        yield from meeting.send(self.id, HIGH, buckets, *self.long_keys, self.long_counts > 1)

    def narrow(self, anchor_said: np.ndarray, long_said: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Which windows are repeated for sure, which are to be compared, which of these are known to repeat."""
        self.analyse()
        open_ = anchor_said[self.anchor_number][self.of_window] > 0
        state = np.zeros(len(self.codes), np.uint8)
        said = long_said[self.long_number] if len(self.long_number) else long_said
        for flag, start, end in zip(said.tolist(), self.long_start.tolist(), self.long_end.tolist()):
            if flag:  # higher rounds come later and have the last word
                state[start : end - self.width + 1] = flag
        state = state[self.windows]
        return state > 0, open_ & (state != 1), state == 2

    def compare(self, asked: np.ndarray) -> tuple:
        start = self.windows[asked]
        first, second = self.spans(start, start + self.width)
        at, number, counts = meeting.unique(first, second)
        return first[at], second[at], number, counts


def _said_anchor_or_long(number: np.ndarray, distinct: int, note: np.ndarray, place: np.ndarray) -> np.ndarray:
    """0: once in the corpus; 1: repeated; 2: repeated, and this chunk stands for all others."""
    often = np.bincount(number, 1 + (note > 0), distinct) > 1
    owner = np.full(distinct, len(place) + 1, np.int64)
    np.minimum.at(owner, number, place)
    return often[number] * (1 + (owner[number] == place))


def _said_window(number: np.ndarray, distinct: int, note: np.ndarray, place: np.ndarray) -> np.ndarray:
    return (np.bincount(number, 1 + (note > 0), distinct) > 1)[number]


def chunked(df: DataFrame, key: str, text: str, size: int, lower: bool = False) -> DataFrame:
    """Whole documents as word codes and the chunk's distinct words, about `size` bytes of text a row.

    `lower` puts ASCII letters into lower case first.

    Chunks follow the input's partitions, so that the same input always gives the same chunks.
    """

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        forget()
        part, kind = TaskContext.get().partitionId(), None

        def rows() -> Iterator[tuple]:
            nonlocal kind
            for found in source:
                kind = found.schema.field(0).type
                yield from zip(found.column(0).to_pylist(), strings(found, "body"))

        for seq, docs in enumerate(batches_of(rows(), 1, size)):
            numbers: dict[bytes, int] = {}
            codes, counts = [], []
            for _, body in docs:
                found = ((body or b"").lower() if lower else body or b"").split()
                codes.extend(numbers.setdefault(w, len(numbers)) for w in found)
                counts.append(len(found))
            yield pa.RecordBatch.from_arrays([
                pa.array([part << 20 | seq], pa.int64()), pa.array([[k for k, _ in docs]], pa.list_(kind)),
                pa.array([counts], pa.list_(pa.int64())), pa.array([b" ".join(numbers)], pa.binary()),
                pa.array([np.array(codes, np.int32).tobytes()], pa.binary()),
            ], names=["chunk", "keys", "counts", "vocabulary", "codes"])

    rows = df.select(F.col(key).alias("key"), F.col(text).cast("string").cast("binary").alias("body"))
    schema = T.StructType([
        T.StructField("chunk", T.LongType()), T.StructField("keys", T.ArrayType(rows.schema["key"].dataType)),
        T.StructField("counts", T.ArrayType(T.LongType())), T.StructField("vocabulary", T.BinaryType()),
        T.StructField("codes", T.BinaryType()),
    ])
    return rows.mapInArrow(run, schema)


def drop_repeats(df: DataFrame, key: str, text: str, width: int = 35, size: int = 1 << 22) -> DataFrame:
    """key, n_words, n_removed and the kept words (`kept`, joined by one space) of every document.

    A word (a run of anything but ASCII white space) goes if it is covered by a window of `width`
    words of its document whose word sequence starts anywhere else too, in this document or another,
    as the input stands. Documents shorter than `width` words, null and empty texts keep what
    they have. Keys may be null, repeat or be structs; equal rows remove each other's long texts.
    No rows give no rows, and other columns are not read.

    Data flow: documents become chunks, which are shuffled once and read three times: to send the
    names, to send the windows left open, and to drop words. Between these only packed keys and
    answers of a byte per key move. A frequent name or window comes to its bucket once per chunk.
    """
    buckets = tasks(df)
    chunks = chunked(df, key, text, size).repartition(buckets, "chunk")

    def names(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for found in source:
            for row in range(len(found)):
                yield meeting.sent_batch(list(Chunk(found.slice(row, 1).to_pylist()[0], width).ask(buckets)))

    def windows(rows: pa.Table, said: pa.Table) -> pa.Table:
        out = []
        for row in rows.to_pylist():
            chunk = Chunk(row, width)
            sure, asked, known = chunk.narrow(meeting.answers(said, ANCHOR), meeting.answers(said, HIGH))
            first, second, number, counts = chunk.compare(asked)
            more = counts > 1
            more[number[known[asked]]] = True
            out += meeting.send(chunk.id, WINDOW, buckets, first, second, more)
            own = np.packbits(sure).tobytes() + np.packbits(asked).tobytes()
            out.append((chunk.id % buckets, chunk.id, meeting.OWN, b"", b"", own))
        return pa.Table.from_batches([meeting.sent_batch(out)])

    def drop(rows: pa.Table, said: pa.Table) -> pa.Table:
        tables = []
        for row in rows.to_pylist():
            chunk = Chunk(row, width)
            n = len(chunk.windows)
            own = meeting.answers(said, meeting.OWN)
            half = len(own) // 2
            repeated = np.unpackbits(own[:half], count=n).astype(bool)
            asked = np.unpackbits(own[half:], count=n).astype(bool)
            number = chunk.compare(asked)[2]
            repeated[asked] |= meeting.answers(said, WINDOW)[number] > 0
            edge = np.zeros(len(chunk.codes) + 1, np.int64)
            edge[chunk.windows[repeated]] += 1
            edge[chunk.windows[repeated] + width] -= 1
            keep = np.cumsum(edge)[:-1] == 0
            left = slices(None, keep)[chunk.ends]
            kept = list(map(chunk.words.__getitem__, chunk.codes[keep].tolist()))
            n_words = np.diff(chunk.ends)
            tables.append(pa.table([
                pa.array(row["keys"], rows.schema.field("keys").type.value_type), pa.array(n_words),
                pa.array(n_words - np.diff(left)),
                pa.array([b" ".join(kept[a:b]) for a, b in zip(left[:-1], left[1:])], pa.binary()),
            ], names=["key", "n_words", "n_removed", "kept"]))
        return pa.concat_tables(tables) if tables else empty

    kind = df.schema[key].dataType
    schema = T.StructType([
        T.StructField("key", kind), T.StructField("n_words", T.LongType()),
        T.StructField("n_removed", T.LongType()), T.StructField("kept", T.BinaryType()),
    ])
    from pyspark.sql.pandas.types import to_arrow_schema

    empty = to_arrow_schema(schema).empty_table()
    said = meeting.meet(
        chunks.mapInArrow(names, meeting.SENT), {ANCHOR: _said_anchor_or_long, HIGH: _said_anchor_or_long}
    )
    asked = chunks.groupBy("chunk").cogroup(said.groupBy("chunk")).applyInArrow(windows, meeting.SENT)
    said = meeting.meet(asked, {WINDOW: _said_window})
    out = chunks.groupBy("chunk").cogroup(said.groupBy("chunk")).applyInArrow(drop, schema)
    return out.select(F.col("key").alias(key), "n_words", "n_removed", F.col("kept").cast("string").alias("kept"))
