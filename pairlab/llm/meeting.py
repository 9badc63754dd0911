"""Keys of many chunks meet in buckets, and each chunk gets an answer for each of its keys.

Keys travel as packed arrays, one row per chunk and bucket, unique within their chunk: however often
a key occurs, a bucket sees it once per chunk, and no row of the data frame stands for a single key.
Answers are one byte per key, in the order in which the chunk sent them, so a chunk that can
make its keys anew needs no join to read them.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

#: bucket, sender, which set of keys, first and second half of the keys, a byte for each
SENT = "bucket int, chunk long, kind int, first binary, second binary, note binary"
ANSWER = "chunk long, kind int, bucket int, note binary"
OWN = 99  # rows of this kind pass through unchanged


def unique(first: np.ndarray, second: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Positions of distinct keys in key order, the number of each row's key, and how often each occurs."""
    order = np.argsort(first, kind="stable")
    f = first[order]
    fresh = np.ones(len(f), bool)
    fresh[1:] = f[1:] != f[:-1]
    if second is not None:
        s = second[order]
        if (~fresh[1:] & (s[1:] != s[:-1])).any():
            order = np.lexsort((second, first))
            f, s = first[order], second[order]
        fresh[1:] = (f[1:] != f[:-1]) | (s[1:] != s[:-1])
    number = np.empty(len(f), np.int64)
    number[order] = np.cumsum(fresh) - 1
    starts = np.flatnonzero(fresh)
    return order[starts], number, np.diff(np.append(starts, len(f)))


def send(
    chunk: int, kind: int, buckets: int, first: np.ndarray, second: np.ndarray | None, note: np.ndarray,
    short: bool = False,
) -> Iterator[tuple]:
    """Rows of keys that ascend by `first`; a bucket is a range of it.

    `short` keys are known by their bucket and their lower 32 bits alone: enough where equal keys must
    agree and different ones may, in rare cases. Buckets grow in number with the data, so that these
    cases stay rare: one key in 400 for ten million keys in a bucket.
    """
    scaled = (first >> np.uint64(32)) * np.uint64(buckets)
    bucket = (scaled >> np.uint64(32)).astype(np.int64)
    bounds = np.flatnonzero(np.diff(bucket, prepend=-1, append=-1))
    if short:
        first = first.astype(np.uint32)
    for a, b in zip(bounds[:-1], bounds[1:]):
        half = b"" if second is None else second[a:b].tobytes()
        yield int(bucket[a]), chunk, kind, first[a:b].tobytes(), half, note[a:b].astype(np.uint8).tobytes()


def sent_batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int32(), pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.binary()]
    columns = list(zip(*rows)) or [[]] * 6
    return pa.RecordBatch.from_arrays(
        [pa.array(c, t) for c, t in zip(columns, kinds)], names=["bucket", "chunk", "kind", "first", "second", "note"]
    )


def meet(sent: DataFrame, answers: Mapping[int, Callable[..., np.ndarray]], short: tuple[int, ...] = ()) -> DataFrame:
    """Answers to the keys of each kind, by its function of (number of each key, how many distinct
    keys, notes, row's place in the order of chunks). `short` names the kinds whose keys were sent short.
    """

    def group(table: pa.Table) -> pa.Table:
        table = table.sort_by("chunk")
        chunk, kind, bucket = (table.column(c) for c in ("chunk", "kind", "bucket"))
        notes = table.column("note")
        if len(table) and kind[0].as_py() != OWN:
            parts = [np.frombuffer(x, np.uint8) for x in notes.to_pylist()]
            width = np.uint32 if kind[0].as_py() in short else np.uint64
            first = np.frombuffer(b"".join(table.column("first").to_pylist()), width)
            half = b"".join(table.column("second").to_pylist())
            _, number, counts = unique(first, np.frombuffer(half, np.uint64) if half else None)
            ends = np.cumsum([len(p) for p in parts])
            place = np.repeat(np.arange(len(parts)), [len(p) for p in parts])
            said = answers[kind[0].as_py()](number, len(counts), np.concatenate(parts), place).astype(np.uint8)
            notes = pa.array([x.tobytes() for x in np.split(said, ends[:-1])], pa.binary())
        return pa.table([chunk, kind, bucket, notes], names=["chunk", "kind", "bucket", "note"])

    return sent.groupBy("bucket", "kind").applyInArrow(group, ANSWER)


def answers(table: pa.Table, kind: int) -> np.ndarray:
    """A chunk's answers of one kind, in the order in which its keys were sent."""
    rows = sorted(
        (b, n) for k, b, n in zip(*(table.column(c).to_pylist() for c in ("kind", "bucket", "note"))) if k == kind
    )
    return np.frombuffer(b"".join(n for _, n in rows), np.uint8)
