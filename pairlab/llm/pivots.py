"""Codes of integer vectors by codebooks whose entries are found with pivots (LAESA).

Vectors become integers and are cut into equal parts. For every part position some fixed pivots are
chosen, and the distances of all parts to them are computed once and written beside the vectors. A
round of the codebooks' training then knows, from the distances between pivots and entries alone, a
lower bound for each part and entry: the largest difference of the two distances to a pivot, by the
triangle inequality. Entries are tried in the order of their bounds, with exact integer distances, and
a part stops as soon as the next bound exceeds its best distance.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pairlab.llm.common import settle
from pairlab.operators.spread import attach, per_key

#: Stored distances are 32-bit floats; bounds are lowered by what their rounding may add.
SLACK = 1e-6
#: Integers of a part below this have squared distances that 64 bits hold, for parts of up to 64 components.
LARGEST = 1 << 27


def to_integers(vectors: np.ndarray, scale: int) -> np.ndarray:
    """floor(scale * x), componentwise."""
    scaled = np.floor(vectors.astype(np.float64) * scale)
    if scaled.size and np.abs(scaled).max() >= LARGEST:
        raise ValueError(f"components of {LARGEST} or more after scaling have no exact squared distances here")
    return scaled.astype(np.int64)


def squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    d = a - b
    return (d * d).sum(-1)


def choose_pivots(entries: np.ndarray, pivots: int) -> np.ndarray:
    """Far-apart ones among the first entries (entry, component): each next one is farthest from those chosen."""
    chosen = [0]
    away = squared(entries, entries[0])
    while len(chosen) < min(pivots, len(entries)):
        chosen.append(int(away.argmax()))
        away = np.minimum(away, squared(entries, entries[chosen[-1]]))
    return entries[chosen]


def nearest_entries(
    part: np.ndarray, to_pivots: np.ndarray, pivots: np.ndarray, entries: np.ndarray
) -> tuple[np.ndarray, np.ndarray, int]:
    """(index, squared distance) of each part's nearest entry, ties to the lower index, and the exact evaluations made.

    `to_pivots` holds the parts' distances to `pivots`, as 32-bit floats.
    """
    known = np.sqrt(squared(pivots[:, None], entries[None]).astype(np.float64))  # pivot, entry
    bound = np.zeros((len(part), len(entries)))
    for p in range(len(pivots)):
        d = to_pivots[:, p].astype(np.float64)[:, None]
        np.maximum(bound, np.abs(d - known[p]) - SLACK * (d + known[p] + 1.0), out=bound)
    order = np.argsort(bound, axis=1, kind="stable")
    best = np.full(len(part), np.iinfo(np.int64).max)
    index = np.full(len(part), len(entries), np.int64)
    rows, evaluated = np.arange(len(part)), 0
    for k in range(len(entries)):
        entry = order[rows, k]
        if k:
            near = bound[rows, entry] <= np.sqrt(best[rows].astype(np.float64)) * (1 + 1e-12)
            rows, entry = rows[near], entry[near]
            if not len(rows):
                break
        evaluated += len(rows)
        distance = squared(part[rows], entries[entry])
        better = (distance < best[rows]) | ((distance == best[rows]) & (entry < index[rows]))
        best[rows[better]], index[rows[better]] = distance[better], entry[better]
    return index, best, evaluated


@dataclass
class Codebooks:
    """Per part position the entries, as integers (part, entry, component), and the fixed pivots."""

    entries: np.ndarray
    pivots: np.ndarray

    def assign(self, vectors: np.ndarray, distances: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
        """Per vector and part: the entry's index and the squared distance; and the exact evaluations made."""
        parts, _, width = self.entries.shape
        split = vectors.reshape(-1, parts, width)
        away = distances.reshape(len(split), parts, self.pivots.shape[1])
        index, error = np.zeros(split.shape[:2], np.int64), np.zeros(split.shape[:2], np.int64)
        evaluated = 0
        for p in range(parts):
            index[:, p], error[:, p], some = nearest_entries(split[:, p], away[:, p], self.pivots[p], self.entries[p])
            evaluated += some
        return index, error, evaluated

    def text(self) -> str:
        return ",".join(map(str, self.entries.ravel().tolist()))


def _matrix(found: pa.RecordBatch, name: str, kind: str) -> np.ndarray:
    return np.frombuffer(b"".join(found.column(found.schema.get_field_index(name)).to_pylist()), kind).reshape(found.num_rows, -1)


def finite(vector: str) -> Column:
    """Whether a vector is neither null nor empty and holds neither nulls nor what is not finite."""
    odd = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf")))
    return F.coalesce((F.size(vector) > 0) & ~F.exists(vector, odd), F.lit(False))


def learn(vectors: DataFrame, parts: int, entries: int, rounds: int, scale: int, pivots: int) -> tuple[Codebooks | None, DataFrame]:
    """Codebooks of `vectors` (key, label, vector) and the written table they were learned from."""
    kind = T.DoubleType()
    kept = vectors.filter(finite("vector")).withColumn("vector", F.col("vector").cast(T.ArrayType(kind)))
    # The first entries: the vectors of the smallest keys; equal keys by their vectors, null keys last.
    first = kept.orderBy(F.col("key").isNull(), "key", "vector").limit(entries).select("vector").collect()
    sizes = {len(r["vector"]) for r in first}
    if len(sizes) > 1 or sizes and sizes.pop() % parts:
        raise ValueError(f"vectors must be of one length that {parts} divides")
    books, width = None, 0
    if first:
        start = to_integers(np.array([r["vector"] for r in first]), scale)
        width = start.shape[1] // parts
        start = start.reshape(len(first), parts, width).transpose(1, 0, 2).copy()
        books = Codebooks(start, np.stack([choose_pivots(e, pivots) for e in start]))

    def prepare(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for found in source:
            column = found.column(found.schema.get_field_index("vector"))
            sizes = np.diff(column.offsets.to_numpy())
            if (sizes != parts * width).any():
                raise ValueError(f"vectors must be of one length that {parts} divides")
            flat = column.flatten().to_numpy(zero_copy_only=False).reshape(found.num_rows, parts * width)
            whole = to_integers(flat, scale)
            split = whole.reshape(found.num_rows, parts, 1, width)
            away = np.sqrt(squared(split, books.pivots[None]).astype(np.float64)).astype("<f4")
            yield pa.RecordBatch.from_arrays([
                found.column(found.schema.get_field_index("key")), found.column(found.schema.get_field_index("label")),
                pa.array([row.tobytes() for row in whole.astype("<i4")], pa.binary()),
                pa.array([row.tobytes() for row in away], pa.binary()),
            ], names=["key", "label", "whole", "away"])

    schema = T.StructType([
        T.StructField("key", vectors.schema["key"].dataType), T.StructField("label", vectors.schema["label"].dataType),
        T.StructField("whole", T.BinaryType()), T.StructField("away", T.BinaryType()),
    ])
    ready = settle(kept.mapInArrow(prepare, schema), "parts")
    if books is None:
        return None, ready
    for _ in range(rounds):
        books = _round(ready, books)
    return books, ready


def _round(ready: DataFrame, books: Codebooks) -> Codebooks:
    """The codebooks after all parts went to their nearest entries; entries without parts stay."""
    parts, size, width = books.entries.shape

    def sums(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, count = np.zeros((parts * size, width), np.int64), np.zeros(parts * size, np.int64)
        for found in source:
            whole = _matrix(found, "whole", "<i4").astype(np.int64)
            index, _, _ = books.assign(whole, _matrix(found, "away", "<f4"))
            place = (index + np.arange(parts) * size).ravel()
            count += np.bincount(place, minlength=parts * size)
            np.add.at(total, place, whole.reshape(-1, width))
        used = np.flatnonzero(count)
        yield pa.RecordBatch.from_arrays([
            pa.array(used, pa.int32()), pa.array(count[used], pa.int64()), pa.array(list(total[used]), pa.list_(pa.int64())),
        ], names=["place", "count", "total"])

    found = ready.select("whole", "away").mapInArrow(sums, "place int, count long, total array<long>")
    columns = [F.sum(F.col("total")[c]).alias(f"t{c}") for c in range(width)]
    entries = books.entries.reshape(-1, width).copy()
    for row in found.groupBy("place").agg(F.sum("count").alias("n"), *columns).collect():  # at most parts * size rows
        entries[row["place"]] = [row[f"t{c}"] // row["n"] for c in range(width)]
    return Codebooks(entries.reshape(books.entries.shape), books.pivots)


def encode(
    df: DataFrame, key: str, vector: str, label: str, parts: int = 8, entries: int = 16, rounds: int = 6,
    scale: int = 4096, pivots: int = 4,
) -> DataFrame:
    """key, label, code (array of entry indexes, one per part), error, label_error, codebooks, evaluated.

    Components become floor(`scale` * x). The codebook of each part position starts as that part of the
    vectors of the `entries` smallest keys, and is replaced in each round by the floors of its parts'
    means; entries that no part is nearest to stay. `error` is a vector's squared distance to its code,
    `label_error` its sum over the rows of the same label (null is a label), `codebooks` the entries as
    text, `evaluated` the exact distances that the last assignment needed for the vector's batch, per part.

    Vectors that are null or empty, or hold null or non-finite components, are dropped; those left must
    be of one length that `parts` divides, with scaled components below 2**27. Keys and labels may be
    null and repeat: equal vectors get equal codes, null keys come last among the smallest. With fewer
    vectors than `entries` the codebooks are that much smaller. No rows give no rows; other columns are
    not read. A label may hold any share of the rows: its sum is aggregated before it comes back to them.
    """
    vectors = df.select(F.col(key).alias("key"), F.col(label).alias("label"), F.col(vector).alias("vector"))
    books, ready = learn(vectors, parts, entries, rounds, scale, pivots)

    def finish(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for found in source:
            index, error, evaluated = books.assign(
                _matrix(found, "whole", "<i4").astype(np.int64), _matrix(found, "away", "<f4")
            )
            n = found.num_rows
            yield pa.RecordBatch.from_arrays([
                found.column(0), found.column(1),
                pa.ListArray.from_arrays(pa.array(np.arange(0, n * parts + 1, parts, dtype=np.int32)), pa.array(index.ravel().astype(np.int32))),
                pa.array(error.sum(1)), pa.array(np.full(n, evaluated / max(1, n * parts))),
            ], names=["key", "label", "code", "error", "evaluated"])

    schema = T.StructType([
        *ready.schema.fields[:2], T.StructField("code", T.ArrayType(T.IntegerType())),
        T.StructField("error", T.LongType()), T.StructField("evaluated", T.DoubleType()),
    ])
    coded = settle(ready.mapInArrow(finish, schema), "codes")
    sums = settle(per_key(coded, ["label"], F.sum("error").alias("label_error")), "labels")
    out = attach(coded, sums, ["label"], few=True)
    return out.withColumn("codebooks", F.lit(books.text() if books else "")).select(
        F.col("key").alias(key), "label", "code", "error", "label_error", "codebooks", "evaluated",
    )
