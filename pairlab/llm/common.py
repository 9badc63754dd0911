"""Shared pieces: written intermediate tables, text columns, Arrow batches."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairlab.session import scratch_path

#: ASCII white space: U+0020 and U+0009 to U+000D. Words are what stands between.
SPACE = " \t\n\x0b\x0c\r"


def settle(df: DataFrame, name: str, compression: str = "zstd") -> DataFrame:
    """`df` written below the shared checkpoint folder and read back.

    A lost executor then costs no recomputation of what came before.
    """
    path = scratch_path(df.sparkSession, name)
    df.write.option("compression", compression).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def texts(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, text) alone: other columns, whatever their names, never reach an operator."""
    return df.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"))


def tasks(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def strings(batch: pa.RecordBatch, name: str) -> list[str | None]:
    return batch.column(batch.schema.get_field_index(name)).to_pylist()


def batches_of(
    rows: Iterator[tuple], weight: int, limit: int, always: int = 1 << 16
) -> Iterator[list[tuple]]:
    """Rows in lists of at most `limit` total length of column `weight` (one row may exceed it)."""
    part, size = [], 0
    for row in rows:
        n = len(row[weight] or "")
        if part and (size + n > limit or len(part) >= always):
            yield part
            part, size = [], 0
        part.append(row)
        size += n
    if part:
        yield part


def text_rows(source: Iterator[pa.RecordBatch], key: str = "key", text: str = "text") -> Iterator[tuple]:
    for batch in source:
        yield from zip(strings(batch, key), strings(batch, text))


_KEPT: list[dict] = []


def kept() -> dict:
    """A worker's memory that lasts from task to task, until `forget`."""
    _KEPT.append({})
    return _KEPT[-1]


def forget() -> None:
    """Workers serve one stage after another: what an earlier operator has kept makes room for this one."""
    for memory in _KEPT:
        memory.clear()


def slices(blob: pa.Array, counts: np.ndarray) -> np.ndarray:
    """Start of every run in a concatenation of runs of the given lengths, and the end."""
    return np.concatenate([[0], np.cumsum(counts)])


def byte_letters() -> list[str]:
    """The letter that stands for each byte: itself if it is printable, else one from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = iter(range(0x100, 0x200))
    return [chr(b) if b in plain else chr(next(others)) for b in range(256)]
