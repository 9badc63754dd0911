"""Token files coded by a static range asymmetric numeral system.

A file set is a folder with two Parquet tables that Spark writes and reads.

`table`: one row, the shared frequency table: `bits`, and for every id its share of 2**bits.

`blocks`: independent blocks of whole documents in ascending key order. A block holds
  part, seq       range partition, and number of the block in it
  start           ids of the partition before the block
  keys, lengths   its documents and their ids, the end id included
  lanes, every    interleaved coders, and steps between checkpoints
  words           the coded 32-bit words, in the order in which a reader needs them
  marks, states   for each checkpoint the words read before it, and the states of all lanes there
  words_crc32, ids_crc32   checksums of the words and of the ids (unsigned, little-endian 32 bits)

Id j of a block belongs to lane j % lanes and step j // lanes. Every block can be decoded alone, and
from every checkpoint on, so readers split long blocks into ranges. The first checkpoint is the block's beginning.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pairlab.llm.common import batches_of, settle, slices, strings, tasks
from pairlab.llm.word_ids import encoder, with_end
from pairlab.session import scratch_path

LOW = np.uint64(1 << 31)  # states stay in [2**31, 2**63)
WORD = np.uint64(32)


def shares(counts: np.ndarray) -> tuple[int, np.ndarray]:
    """Counts scaled to a sum of 2**bits; what occurs keeps at least 1."""
    used = np.flatnonzero(counts)
    bits = max(12, int(len(used)).bit_length() + 3)
    out = np.zeros(len(counts), np.int64)
    if len(used):
        out[used] = np.maximum(1, counts[used].astype(float) * (1 << bits) // counts.sum())
        spare = (1 << bits) - out.sum()
        by_size = used[np.argsort(-out[used], kind="stable")]
        if spare > 0:
            out[by_size[0]] += spare
        for i in by_size:
            if spare >= 0:
                break
            take = min(out[i] - 1, -spare)
            out[i] -= take
            spare += take
    return bits, out


class Coder:
    """Encodes and decodes blocks under one frequency table."""

    def __init__(self, bits: int, share: np.ndarray) -> None:
        self.bits, self.share = np.uint64(bits), share.astype(np.uint64)
        self.below = (np.cumsum(share) - share).astype(np.uint64)
        self.mask = np.uint64((1 << bits) - 1)
        self.symbol = np.repeat(np.arange(len(share), dtype=np.uint32), share)

    def encode(self, ids: np.ndarray, lanes: int, every: int) -> dict:
        steps = -(-len(ids) // lanes)
        state = np.full(lanes, LOW, np.uint64)
        out, total, marks, states = [], 0, [], []
        for step in range(steps - 1, -1, -1):  # last in, first out
            symbols = ids[step * lanes : (step + 1) * lanes]
            x, share = state[: len(symbols)], self.share[symbols]
            full = x >= share << (np.uint64(63) - self.bits)
            out.append(x[full].astype("<u4"))
            total += len(out[-1])
            x[full] >>= WORD
            whole = x // share
            x[:] = (whole << self.bits) + (x - whole * share) + self.below[symbols]
            if step % every == 0:
                marks.append(total)
                states.append(state.copy())
        words = np.concatenate([*out[::-1], np.zeros(0, "<u4")])
        return {
            "words": words.tobytes(), "marks": [total - m for m in reversed(marks)],
            "states": b"".join(s.astype("<u8").tobytes() for s in reversed(states)),
            "words_crc32": zlib.crc32(words), "ids_crc32": zlib.crc32(ids.astype("<u4")),
        }

    def decode(self, block: dict, first: int = 0, last: int | None = None) -> np.ndarray:
        """Ids from checkpoint `first` up to checkpoint `last` (the end, if None)."""
        n, lanes, every = int(sum(block["lengths"])), block["lanes"], block["every"]
        steps, words = -(-n // lanes), np.frombuffer(block["words"], "<u4").astype(np.uint64)
        if zlib.crc32(block["words"]) != block["words_crc32"]:
            raise ValueError(f"block {block['part']}/{block['seq']}: its words are damaged")
        stop = steps if last is None else min(steps, last * every)
        state = np.frombuffer(block["states"], "<u8").reshape(-1, lanes)[first].copy()
        cursor, ids = block["marks"][first], np.empty(max(0, min(n, stop * lanes) - first * every * lanes), np.uint32)
        at = 0
        for step in range(first * every, stop):
            m = min(lanes, n - step * lanes)
            x = state[:m]
            slot = x & self.mask
            symbols = self.symbol[slot]
            x[:] = self.share[symbols] * (x >> self.bits) + slot - self.below[symbols]
            empty = np.flatnonzero(x < LOW)
            x[empty] = (x[empty] << WORD) | words[cursor : cursor + len(empty)]
            cursor += len(empty)
            ids[at : at + m] = symbols
            at += m
        if first == 0 and last is None and zlib.crc32(ids.astype("<u4")) != block["ids_crc32"]:
            raise ValueError(f"block {block['part']}/{block['seq']}: its ids are damaged")
        return ids


def token_table(df: DataFrame, key: str, text: str, tokenizer: str, end_id: int, batch: int = 1 << 22) -> DataFrame:
    """key, tie, ids: the ids of every whole text, the end id last, as packed numbers.

    Null or empty texts have the end id alone. `tie` orders rows of equal keys by their text.
    """

    def encode(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = encoder(tokenizer)
        for found in source:
            rows = zip(found.column(0).to_pylist(), found.column(1).to_pylist(), strings(found, "body"))
            for part in batches_of(rows, 2, batch):
                ids, counts = words.encode([r[2] for r in part])
                packed = [x.astype(words.width).tobytes() for x in with_end(ids, counts, end_id)]
                yield pa.RecordBatch.from_arrays([
                    pa.array([r[0] for r in part], found.schema.field(0).type),
                    pa.array([r[1] for r in part], pa.int64()), pa.array(packed, pa.binary()),
                ], names=["key", "tie", "ids"])

    rows = df.select(
        F.col(key).alias("key"), F.xxhash64(F.col(text).cast("string")).alias("tie"),
        F.col(text).cast("string").cast("binary").alias("body"),
    )
    kind = rows.schema["key"].dataType
    schema = T.StructType([
        T.StructField("key", kind), T.StructField("tie", T.LongType()), T.StructField("ids", T.BinaryType()),
    ])
    return rows.mapInArrow(encode, schema)


def _counts(tokens: DataFrame, width: str) -> np.ndarray:
    """How often each id occurs: one row per id and task, at most the vocabulary on the driver."""

    def count(source: Iterator[pa.RecordBatch]) -> Iterator[pd.DataFrame]:
        total = np.zeros(0, np.int64)
        for found in source:
            column = found.column(0)
            if len(column):
                more = np.bincount(np.frombuffer(b"".join(column.to_pylist()), width))
                wide = max(len(total), len(more))
                total = np.pad(total, (0, wide - len(total))) + np.pad(more, (0, wide - len(more)))
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(total[used])], names=["id", "n"])

    rows = tokens.select("ids").mapInArrow(count, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).toPandas()
    out = np.zeros(int(rows["id"].max()) + 1 if len(rows) else 0, np.int64)
    out[rows["id"]] = rows["n"]
    return out


def write_token_files(
    df: DataFrame, key: str, text: str, path: str, tokenizer: str, end_id: int = 1,
    block_ids: int = 1 << 18, lanes: int = 512, every: int = 128,
) -> None:
    """Encode every whole text and write it to `path` in ascending key order (nulls first).

    Tokens are written once, counted, then range partitioned by key and coded block by block.
    A document longer than a block has a block of its own. Nothing but the frequency table, whose
    size the vocabulary bounds, passes through the driver. Empty input gives an empty file set.
    """
    spark, width = df.sparkSession, encoder(tokenizer).width.str
    tokens = settle(token_table(df, key, text, tokenizer, end_id), "tokens")
    bits, share = shares(_counts(tokens, width))
    spark.createDataFrame([(bits, share.astype("<u4").tobytes())], "bits int, share binary").coalesce(1).write.parquet(f"{path}/table")
    shared = spark.sparkContext.broadcast((bits, share))

    def blocks(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        coder, part, start = Coder(*shared.value), TaskContext.get().partitionId(), 0
        rows = (row for b in source for row in zip(b.column(0).to_pylist(), b.column(2).to_pylist()))
        for seq, docs in enumerate(batches_of(rows, 1, block_ids * np.dtype(width).itemsize, 1 << 20)):
            ids = np.frombuffer(b"".join(d for _, d in docs), width)
            lengths = [len(d) // np.dtype(width).itemsize for _, d in docs]
            block = coder.encode(ids, lanes, every) | {
                "part": part, "seq": seq, "start": start, "keys": [k for k, _ in docs], "lengths": lengths,
                "lanes": lanes, "every": every,
            }
            start += len(ids)
            yield pa.RecordBatch.from_pylist([block], schema=arrow)

    kind = tokens.schema["key"].dataType
    schema = T.StructType([
        T.StructField("part", T.IntegerType()), T.StructField("seq", T.IntegerType()),
        T.StructField("start", T.LongType()), T.StructField("keys", T.ArrayType(kind)),
        T.StructField("lengths", T.ArrayType(T.LongType())), T.StructField("lanes", T.IntegerType()),
        T.StructField("every", T.IntegerType()), T.StructField("words", T.BinaryType()),
        T.StructField("marks", T.ArrayType(T.LongType())), T.StructField("states", T.BinaryType()),
        T.StructField("words_crc32", T.LongType()), T.StructField("ids_crc32", T.LongType()),
    ])
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(schema)
    ordered = tokens.repartitionByRange(tasks(df), "key", "tie").sortWithinPartitions("key", "tie")
    ordered.mapInArrow(blocks, schema).write.parquet(f"{path}/blocks")


def ranges(blocks: DataFrame, span: int) -> DataFrame:
    """part, seq, lanes, every, first, n, words, state: `span` checkpoints of a block a row, `n` ids; damaged words raise."""
    whole = F.when(F.crc32("words") == F.col("words_crc32"), F.col("words")).otherwise(
        F.raise_error(F.format_string("block %d/%d: its words are damaged", "part", "seq")).cast("binary")
    )
    return blocks.withColumn("words", whole).withColumn("total", F.expr("aggregate(lengths, 0L, (a, x) -> a + x)")).select(
        "part", "seq", "lanes", "every", F.explode(F.expr(f"""transform(sequence(0, size(marks) - 1, {span}), i -> struct(
            i AS first, least(total - 1L * i * every * lanes, {span}L * every * lanes) AS n,
            substring(words, cast(4 * marks[i] + 1 AS int), cast(CASE WHEN i + {span} < size(marks)
                THEN 4 * (marks[i + {span}] - marks[i]) ELSE octet_length(words) END AS int)) AS words,
            substring(states, i * lanes * 8 + 1, lanes * 8) AS state))""")).alias("r"),
    ).select("part", "seq", "lanes", "every", "r.*")


def _in_ranges(blocks: DataFrame, span: int, shared, schema: T.StructType) -> DataFrame:
    """Documents of long blocks: ranges are decoded in tasks of their own, then put together by block."""

    def decode(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = Coder(*shared.value)
        for found in source:
            for row in range(len(found)):
                r = found.slice(row, 1).to_pylist()[0]
                block = r | {
                    "lengths": [r["n"]], "marks": [0], "states": r["state"], "words_crc32": zlib.crc32(r["words"]),
                }
                ids = coder.decode(block, 0, span).astype("<u4")
                yield pa.RecordBatch.from_arrays([
                    pa.array([r["part"]], pa.int32()), pa.array([r["seq"]], pa.int32()), pa.array([r["first"]], pa.int32()),
                    pa.array([ids.tobytes()], pa.binary()),
                ], names=["part", "seq", "first", "ids"])

    def join(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for found in source:
            for row in range(len(found)):
                block = found.slice(row, 1).to_pylist()[0]
                ids = b"".join(r["ids"] for r in block["ranges"])
                if zlib.crc32(ids) != block["ids_crc32"]:
                    raise ValueError(f"block {block['part']}/{block['seq']}: its ids are damaged")
                yield _documents(found, block, ids)

    cut = ranges(blocks, span).repartition(tasks(blocks), "part", "seq", "first")
    decoded = cut.mapInArrow(decode, "part int, seq int, first int, ids binary")
    put = decoded.groupBy("part", "seq").agg(F.sort_array(F.collect_list(F.struct("first", "ids"))).alias("ranges"))
    known = blocks.select("part", "seq", "keys", "lengths", "start", "ids_crc32")
    return known.join(put, ["part", "seq"]).mapInArrow(join, schema)


def _documents(found: pa.RecordBatch, block: dict, ids: bytes) -> pa.RecordBatch:
    ends = slices(None, block["lengths"])
    return pa.RecordBatch.from_arrays([
        pa.array(block["keys"], found.schema.field("keys").type.value_type),
        pa.array(np.full(len(ends) - 1, block["part"], np.int32)),
        pa.array(block["start"] + ends[:-1]),
        pa.array([ids[4 * a : 4 * b] for a, b in zip(ends[:-1], ends[1:])], pa.binary()),
    ], names=["key", "part", "start", "ids"])


def read_token_files(spark: SparkSession, path: str, span: int = 4) -> DataFrame:
    """key, start, ids (packed 32-bit numbers) of every document; damaged blocks raise.

    Blocks of more than `span` checkpoints are decoded in ranges of `span`, side by side. `start` counts the ids of all documents before it: numbers within a range partition are in the
    blocks, the partitions' totals (one row each) are summed up here.
    """
    bits, share = spark.read.parquet(f"{path}/table").first()
    shared = spark.sparkContext.broadcast((bits, np.frombuffer(share, "<u4").astype(np.int64)))
    blocks = spark.read.parquet(f"{path}/blocks")

    def decode(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = Coder(*shared.value)
        for found in source:
            for row in range(len(found)):
                block = found.slice(row, 1).to_pylist()[0]
                yield _documents(found, block, coder.decode(block).astype("<u4").tobytes())

    totals = blocks.groupBy("part").agg(
        F.max(F.col("start") + F.aggregate("lengths", F.lit(0).cast("long"), lambda a, x: a + x)).alias("n")
    )
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    kind = blocks.schema["keys"].dataType.elementType
    schema = T.StructType([
        T.StructField("key", kind), T.StructField("part", T.IntegerType()),
        T.StructField("start", T.LongType()), T.StructField("ids", T.BinaryType()),
    ])
    long = blocks.filter(F.size("marks") > span)
    if long.select("part").isEmpty():
        documents = blocks.mapInArrow(decode, schema)
    else:
        documents = blocks.filter(F.size("marks") <= span).mapInArrow(decode, schema).unionByName(_in_ranges(long, span, shared, schema))
    # One row per range partition: a bounded broadcast.
    return documents.join(F.broadcast(offsets), "part").select("key", (F.col("start") + F.col("offset")).alias("start"), "ids")


def token_digests(df: DataFrame, key: str, text: str, tokenizer: str, end_id: int = 1, path: str | None = None) -> DataFrame:
    """Write token files, read them back; key, start, n_tokens and ids_crc32 of every document."""
    path = path or scratch_path(df.sparkSession, "token-files")
    write_token_files(df, key, text, path, tokenizer, end_id)
    found = read_token_files(df.sparkSession, path)
    return found.select(
        F.col("key").alias(key), "start",
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.crc32("ids").alias("ids_crc32"),
    )
