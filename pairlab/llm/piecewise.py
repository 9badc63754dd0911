"""Context-triggered piecewise hashing: fingerprints of texts, compared by edit distance.

A hash rolls over 7 bytes. Where its top bits are all zero a chunk ends, so an edit moves only the
chunk ends near it. Each chunk gives one character of a signature; a fingerprint is
`block:signature at block:signature at twice block`, where block is the mean chunk length, a power
of two that suits the text's length.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pairlab.llm.common import settle, tasks

WINDOW = 7
LONGEST, AIM = 128, 64  # characters of a signature
LETTERS = np.frombuffer(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/", np.uint8)
_SEED = np.random.default_rng(9)
_ROLL = _SEED.integers(0, 1 << 32, 256, np.uint32)
_BODY = _SEED.integers(0, 1 << 63, 256, np.uint64)
_STEP = np.uint32(0x9E3779B1)
_MIX = np.uint64(0xD6E8FEB86659FD93)


def _rolled(data: np.ndarray) -> np.ndarray:
    """For every byte a hash of it and the six bytes before it."""
    values, out, power = _ROLL[data], np.zeros(len(data), np.uint32), np.uint32(1)
    for back in range(min(WINDOW, len(data))):
        out[back:] += values[: len(data) - back] * power
        power = np.uint32(int(power) * int(_STEP) & 0xFFFFFFFF)
    out ^= out >> np.uint32(15)
    out *= np.uint32(0x85EBCA6B)
    return out ^ (out >> np.uint32(13))


def _signature(data: np.ndarray, rolled: np.ndarray, block: int) -> bytes:
    """A character per chunk; of more than three equal ones in a row three are kept."""
    ends = np.flatnonzero(rolled <= np.uint32(((1 << 32) // block) - 1)) + 1
    starts = np.concatenate([[0], ends])
    starts = starts[starts < len(data)]
    at = (np.arange(len(data)) - np.repeat(starts, np.diff(np.append(starts, len(data))))).astype(np.uint64)
    sums = np.add.reduceat(_BODY[data] * (at * np.uint64(2) + np.uint64(1)), starts)
    sums ^= sums >> np.uint64(32)
    out = LETTERS[(sums * _MIX >> np.uint64(58)).astype(np.intp)]
    same = np.zeros(len(out), bool)
    same[3:] = (out[3:] == out[2:-1]) & (out[3:] == out[1:-2]) & (out[3:] == out[:-3])
    return out[~same].tobytes()


def fingerprint(body: bytes) -> str:
    """The fingerprint of a text's UTF-8 bytes; `1::` if there are none. Equal texts have equal ones."""
    if not body:
        return "1::"
    data = np.frombuffer(body, np.uint8)
    rolled = _rolled(data)
    block = 1
    while block * AIM < len(data):
        block *= 2
    own = _signature(data, rolled, block)
    while len(own) > LONGEST:  # periodic text ends chunks too often
        block *= 2
        own = _signature(data, rolled, block)
    return f"{block}:{own.decode()}:{_signature(data, rolled, block * 2).decode()}"


def _common(a: str, b: str) -> int:
    """Length of the longest common subsequence, a row of bits at a time."""
    where: dict[str, int] = {}
    for i, c in enumerate(a):
        where[c] = where.get(c, 0) | 1 << i
    row = full = (1 << len(a)) - 1
    for c in b:
        hit = row & where.get(c, 0)
        row = (row + hit | row - hit) & full
    return len(a) - row.bit_count()


def _alike(a: str, b: str, need: int = 4) -> float:
    if a == b:
        return 1.0
    need = min(need, max(1, min(len(a), len(b)) // 2))
    if not a or not b or not {a[i : i + need] for i in range(len(a) - need + 1)} & {b[i : i + need] for i in range(len(b) - need + 1)}:
        return 0.0
    return 2 * _common(a, b) / (len(a) + len(b))


def likeness(a: str, b: str) -> float:
    """0 to 1: 1 - edit distance / total length of the signatures at a block size both have.

    An insertion or deletion costs 1 and an exchange 2. Without a shared block size, or without four
    characters in a row in common (half of a signature, if that is shorter), it is 0. Of two shared sizes
    the better counts. Equal fingerprints give 1, also those of two empty texts.
    """
    if a == b:
        return 1.0
    (n, a1, a2), (m, b1, b2) = a.split(":"), b.split(":")
    n, m = int(n), int(m)
    left, right = {n: a1, 2 * n: a2}, {m: b1, 2 * m: b2}
    return max((_alike(left[k], right[k]) for k in left.keys() & right.keys()), default=0.0)


def edited(text: str, following: str) -> str:
    """`text` with its last third replaced by the beginning of `following`."""
    third = len(text) // 3
    return text[: len(text) - third] + following[:third] if third else text


FIELDS = T.StructType([
    T.StructField("n_chars", T.LongType()), T.StructField("edited_sha256", T.StringType()),
    T.StructField("fingerprint", T.StringType()), T.StructField("edited_fingerprint", T.StringType()),
    T.StructField("near_edited", T.DoubleType()), T.StructField("near_next", T.DoubleType()),
])


def _compare(body: bytes, own: str, following: bytes, theirs: str) -> tuple:
    text = body.decode("utf-8", "replace")
    # The replaced third needs no more of the following text than as many characters.
    changed = edited(text, following[: 4 * len(text)].decode("utf-8", "ignore")).encode()
    print_ = own if changed == body else fingerprint(changed)
    return len(text), hashlib.sha256(changed).hexdigest(), own, print_, likeness(own, print_), likeness(own, theirs)


def compare_neighbours(df: DataFrame, key: str, text: str) -> DataFrame:
    """Fingerprints of every whole text and of its edited text, and how near they are.

    The edited text takes its last third from the next document in descending key order (after the
    last: the first). Documents are range partitioned once; a task compares neighbours as they
    stream by and holds two texts. Only a partition's first and last text go on, to a small join
    with the partition after it. Null texts count as empty; null keys come last; equal keys are
    ordered by their text's hash, equal rows are interchangeable. No rows give no rows. Other
    columns are not read.
    """
    rows = df.select(
        F.col(key).alias("key"), F.xxhash64(F.col(text).cast("string")).alias("tie"),
        F.col(text).cast("string").cast("binary").alias("body"),
    )
    kind = rows.schema["key"].dataType
    schema = T.StructType([
        T.StructField("part", T.IntegerType()), T.StructField("place", T.StringType()),
        T.StructField("key", kind), *FIELDS.fields, T.StructField("body", T.BinaryType()),
    ])

    def scan(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, last = TaskContext.get().partitionId(), None
        empty = (None,) * len(FIELDS)
        for found in source:
            kinds = [pa.int32(), pa.string(), found.schema.field(0).type, pa.int64(), pa.string(), pa.string(),
                     pa.string(), pa.float64(), pa.float64(), pa.binary()]
            out = []
            for k, body in zip(found.column(0).to_pylist(), found.column(2).to_pylist()):
                body = body or b""
                own = fingerprint(body)
                if last is None:
                    out.append((part, "first", k, *empty, body))
                else:
                    out.append((part, "inner", last[0], *_compare(last[1], last[2], body, own), None))
                last = k, body, own
            if out:
                yield _batch(out, kinds)
        if last is not None:
            yield _batch([(part, "last", last[0], *empty, last[1])], kinds)

    def _batch(out: list[tuple], kinds: list) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), kinds)], names=schema.names)

    order = [F.desc_nulls_last("key"), F.asc("tie")]
    seen = settle(rows.repartitionByRange(tasks(df), *order).sortWithinPartitions(*order).mapInArrow(scan, schema), "neighbours")
    # One row per range partition from here on.
    firsts = seen.filter("place = 'first'").select(F.col("part").alias("next_part"), F.col("body").alias("next_body"))
    parts = seen.filter("place = 'first'").select("part")
    ring = parts.select(
        "part", F.coalesce(
            F.lead("part").over(Window.orderBy("part")),
            F.min("part").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)),
        ).alias("next_part"),
    )
    ends = seen.filter("place = 'last'").join(ring, "part").join(firsts, "next_part").select("key", "body", "next_body")

    def finish(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for found in source:
            out = [
                (k, *_compare(a, fingerprint(a), b, fingerprint(b)))
                for k, a, b in zip(*(found.column(i).to_pylist() for i in range(3)))
            ]
            kinds = [found.schema.field(0).type, pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), kinds)], names=["key", *FIELDS.names])

    closed = ends.mapInArrow(finish, T.StructType([T.StructField("key", kind), *FIELDS.fields]))
    return seen.filter("place = 'inner'").select("key", *FIELDS.names).unionByName(closed).withColumnRenamed("key", key)
