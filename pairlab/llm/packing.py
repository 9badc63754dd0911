"""Best-fit packing of token pieces into sequences, improved by a swap-based local search."""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from heapq import nsmallest

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pairlab.llm.common import batches_of, settle, strings
from pairlab.llm.word_ids import encoder, with_end


def best_fit(lengths: np.ndarray, capacity: int) -> list[list[int]]:
    """Items, longest first, each into the fullest bin that still takes it."""
    bins: list[list[int]] = []
    spare: list[list[int]] = [[] for _ in range(capacity + 1)]  # bins by free room
    rooms = 0  # bit r: some bin has r free
    for item in np.argsort(-lengths, kind="stable").tolist():
        n = int(lengths[item])
        fit = rooms >> n
        if fit:
            room = n + (fit & -fit).bit_length() - 1
            b = spare[room].pop()
            if not spare[room]:
                rooms &= ~(1 << room)
        else:
            room, b = capacity, len(bins)
            bins.append([])
        bins[b].append(item)
        left = room - n
        if left:
            spare[left].append(b)
            rooms |= 1 << left
    return bins


def local_search(
    bins: list[list[int]], lengths: np.ndarray, capacity: int, rounds: int = 20, takers: int = 256
) -> list[list[int]]:
    """Fewer bins by moves and swaps between underfull ones.

    The emptiest bin gives: a document moves to another bin, is exchanged for a shorter one, or two
    of its documents for one shorter than both together. Each step takes from a bin no fuller than
    the one it gives to, so the sum of squared fills grows and the search ends; a bin that has
    nothing left goes. The search tries the `takers` roomiest bins for each giving one, and ends
    with `rounds` giving bins in a row that could give nothing, or when the sizes allow no fewer bins.
    """
    size = lambda b: int(sum(lengths[i] for i in b))
    fill = [size(b) for b in bins]
    open_ = [k for k in range(len(bins)) if fill[k] < capacity]
    need = -(-sum(fill) // capacity)
    alive, failed = len(bins), 0
    while alive > need and failed < rounds and len(open_) > 1:
        giver = min(open_, key=lambda k: fill[k])
        roomy = nsmallest(takers, (k for k in open_ if k != giver), key=lambda k: fill[k])
        moved = False
        for taker in roomy[::-1]:  # of these the fullest first
            room = capacity - fill[taker]
            if not room or fill[taker] < fill[giver]:
                continue
            step = _step(bins[giver], bins[taker], lengths, room)
            if step:
                give, back = step
                for i in give:
                    bins[giver].remove(i)
                for i in back:
                    bins[taker].remove(i)
                bins[taker] += give
                bins[giver] += back
                gain = int(sum(lengths[i] for i in give) - sum(lengths[i] for i in back))
                fill[taker] += gain
                fill[giver] -= gain
                moved = True
                if not bins[giver]:
                    break
        if not bins[giver]:
            alive -= 1
            failed = 0
        elif not moved:
            failed += 1
        open_ = [k for k in open_ if bins[k] and fill[k] < capacity and (moved or k != giver)]
    return [b for b in bins if b]


def _step(giver: list[int], taker: list[int], lengths: np.ndarray, room: int) -> tuple[list[int], list[int]] | None:
    """The move, swap or two-for-one swap that fills most of `room`; None if there is none.

    Pieces of one length are as good as each other, and a bin has few lengths (their sum is at most
    its capacity), so all pairs of the giver's lengths are tried.
    """
    own, at, times = np.unique(lengths[giver], return_index=True, return_counts=True)
    first, second = np.triu_indices(len(own))
    twice = (first != second) | (times[first] > 1)
    first, second = first[twice], second[twice]
    gives = np.concatenate([own, own[first] + own[second]])
    theirs, place = np.unique(lengths[taker], return_index=True)
    back = np.concatenate([[0], theirs])
    gain = gives[:, None] - back
    gain[gain > room] = 0
    k, j = divmod(int(gain.argmax()), len(back))
    if gain[k, j] <= 0:
        return None
    if k < len(own):
        items = [giver[at[k]]]
    else:
        x, y = at[first[k - len(own)]], at[second[k - len(own)]]
        if x == y:
            y = next(i for i in range(x + 1, len(giver)) if lengths[giver[i]] == lengths[giver[x]])
        items = [giver[x], giver[y]]
    return items, [taker[place[j - 1]]] if j else []


def pack_group(rows: pd.DataFrame, capacity: int) -> pd.DataFrame:
    """`rows` (with `length`) with `bin`, `offset` and the bin's `filled`."""
    lengths = rows["length"].to_numpy()
    bins = local_search(best_fit(lengths, capacity), lengths, capacity)
    order = np.array([i for b in bins for i in b], np.int64)
    number = np.repeat(np.arange(len(bins)), [len(b) for b in bins])
    out = rows.iloc[order].reset_index(drop=True)
    ends = out["length"].groupby(number).cumsum()
    return out.assign(bin=number, offset=ends - out["length"], filled=out["length"].groupby(number).transform("sum"))


def pieces(
    df: DataFrame, key: str, text: str, tokenizer: str, capacity: int, end_id: int, batch: int = 1 << 22,
) -> DataFrame:
    """key, piece, start, length, ids_crc32: every text's ids and end id, cut at `capacity` only."""

    def cut(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = encoder(tokenizer)
        for found in source:
            for part in batches_of(zip(found.column(0).to_pylist(), strings(found, "body")), 1, batch):
                ids, counts = words.encode([r[1] for r in part])
                out = []
                for (k, _), doc in zip(part, with_end(ids, counts, end_id)):
                    for p, a in enumerate(range(0, len(doc), capacity)):
                        piece = doc[a : a + capacity]
                        out.append((k, p, a, len(piece), zlib.crc32(piece)))
                columns = list(zip(*out))
                kinds = [found.schema.field(0).type, pa.int32(), pa.int64(), pa.int64(), pa.int64()]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(columns, kinds)],
                    names=["key", "piece", "start", "length", "ids_crc32"],
                )

    rows = df.select(F.col(key).alias("key"), F.col(text).cast("string").cast("binary").alias("body"))
    schema = T.StructType([
        T.StructField("key", rows.schema["key"].dataType), T.StructField("piece", T.IntegerType()),
        T.StructField("start", T.LongType()), T.StructField("length", T.LongType()),
        T.StructField("ids_crc32", T.LongType()),
    ])
    return rows.mapInArrow(cut, schema)


def pack(
    df: DataFrame, key: str, text: str, tokenizer: str, capacity: int = 4096, end_id: int = 1,
    group_rows: int = 32_768, rounds: int = 4,
) -> DataFrame:
    """Where each piece of each document goes: sequence_id and a gapless offset in it.

    Full pieces are sequences of their own. The rest is dealt to random groups of about `group_rows`
    pieces, packed side by side: best fit, then the local search. What lies in sequences that stayed
    loose in a group (more than 1/64 free; fuller ones stay as they are) is dealt and packed again together, `rounds` times at most
    or until one group holds all of it; each round leaves about one loose sequence per group, so
    groups cost nothing in the end. Row numbers, not keys, choose the group: a hot or null key spreads.

    Null or empty texts are one piece of the end id. Equal rows are packed each for itself. No rows
    give no rows; other columns of `df` are not read, whatever their names.
    """
    cut = settle(
        pieces(df, key, text, tokenizer, capacity, end_id).withColumn("row", F.monotonically_increasing_id()), "pieces"
    )
    columns = [c for c in cut.columns]
    done = [cut.filter(F.col("length") == capacity).select(
        *columns, (-F.col("row") - 1).alias("sequence_id"), F.lit(0).cast("long").alias("offset")
    )]
    loose = cut.filter(F.col("length") < capacity)
    schema = T.StructType([*cut.schema.fields, T.StructField("group", T.LongType()), *(
        T.StructField(c, T.LongType()) for c in ("bin", "offset", "filled")
    )])
    for turn in range(rounds):
        groups = max(1, -(-loose.count() // group_rows))
        dealt = loose.withColumn("group", F.pmod(F.xxhash64("row", F.lit(turn)), F.lit(groups)))
        packed = settle(
            dealt.repartition(max(1, groups), "group").groupBy("group").applyInPandas(lambda g: pack_group(g, capacity), schema), "packed"
        )
        last = groups == 1 or turn == rounds - 1
        tight = F.col("filled") * 64 >= capacity * 63
        kept = packed if last else packed.filter(tight)
        done.append(kept.select(
            *columns,
            (F.lit(turn) * F.lit(1 << 56) + F.col("group") * F.lit(1 << 24) + F.col("bin")).alias("sequence_id"), "offset",
        ))
        if last:
            break
        loose = packed.filter(~tight).select(*columns)
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out.select(
        F.col("key").alias(key), "piece", "start", "length", "ids_crc32", "sequence_id", "offset",
    )
