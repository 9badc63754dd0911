"""Nearest neighbours by collision-counting hashing over sorted projections.

Vectors are scaled by the largest norm and given one more component that makes all of them unit
vectors; then the largest inner product is the smallest distance. A block of vectors keeps one sorted
array per random projection. A query opens a window around its own value on every array. A vector
that lies in the windows of enough projections, the collision threshold, is verified with the
original vectors. Virtual rehashing widens the windows on the same arrays until enough verified vectors
are as near as the windows' radius: the ends walk outward and only what they pass is added to the
counts. The inner parts of the first windows are counted by comparing cells, which gives the same counts as walking.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pairlab.llm.common import settle


class Block:
    """Sorted arrays of one block of vectors."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, largest: float, projections: int, seed: int) -> None:
        order = np.argsort(ids, kind="stable")
        self.ids, self.vectors = ids[order], vectors[order]
        scaled = self.vectors / largest
        last = np.sqrt(np.maximum(0, 1 - (scaled * scaled).sum(1)))
        self.directions = np.random.default_rng(seed).normal(size=(vectors.shape[1] + 1, projections))
        self.unit = np.column_stack([scaled, last])
        values = (self.directions.T @ self.unit.T).copy()
        places = np.uint16 if len(ids) < 1 << 16 else np.uint32
        order = np.argsort(values, axis=1, kind="stable")
        self.sorted = np.take_along_axis(values, order, 1)
        self.step = -(-len(ids) // 256)  # places of an array in each of at most 256 cells
        cell = np.empty((projections, len(ids)), np.uint8)  # of each vector on each array
        np.put_along_axis(cell, order, (np.arange(len(ids)) // self.step).astype(np.uint8)[None], 1)
        self.order = order.astype(places).ravel()  # the arrays one after another, as vectors' numbers
        self.cells = [cell[:, a : a + 2048].copy() for a in range(0, len(ids), 2048)]  # parts fit a cache
        self.room = np.empty((255, 2048), np.uint8), np.empty((255, 2048), bool)
        self.largest = largest

    def near_radius(self, queries: np.ndarray, wanted: int, most: int = 64) -> float:
        """The distance within which a query has `wanted` vectors here, the median over `most` queries."""
        some = queries[:: max(1, len(queries) // most)][:most]
        products = some @ self.unit.T
        k = min(wanted, products.shape[1]) - 1
        nearest = -np.partition(-products, k, axis=1)[:, k]
        return float(np.sqrt(max(1e-12, 2 - 2 * np.median(nearest))))

    def _collisions(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """Per query in how many of its windows [low, high) each vector lies.

        Cells wholly inside are counted by comparing the vectors' cells, for all queries while a part is cached;
        what is left of a window at its two ends is walked over.
        """
        first = -(-low // self.step)
        last = np.minimum(np.maximum(high // self.step, first), first + 255)
        inner_end = np.where(last > first, last * self.step, np.minimum(first * self.step, high))
        span, start = (last - first).astype(np.uint8)[:, :, None], first.astype(np.uint8)[:, :, None]
        out = np.stack([
            self._passed(a, np.minimum(f * self.step, b)) + self._passed(e, b) for a, b, f, e in zip(low, high, first, inner_end)
        ])
        for k, part in enumerate(self.cells):
            for a in range(0, len(part), 255):  # sums of so many fit a byte
                cells = part[a : a + 255]
                offset, inside = (r[: len(cells), : cells.shape[1]] for r in self.room)
                for q, total in enumerate(out[:, 2048 * k : 2048 * (k + 1)]):
                    np.subtract(cells, start[q, a : a + 255], out=offset)
                    np.less(offset, span[q, a : a + 255], out=inside)
                    total += np.add.reduce(inside.view(np.uint8), axis=0, dtype=np.uint8)
        return out

    def _passed(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """How often each vector is in [start, end) of the arrays, start and end per array: what window ends walk over."""
        size = end - start
        first = np.arange(len(start)) * len(self.ids) + start
        at = np.arange(size.sum()) + np.repeat(first - (np.cumsum(size) - size), size)
        return np.bincount(self.order[at], minlength=len(self.ids))

    def _best(self, place: np.ndarray, score: np.ndarray, query: np.ndarray, wanted: int) -> tuple[np.ndarray, np.ndarray]:
        """The best of what is verified; sums in one fixed order, so equal vectors tie exactly."""
        if len(score) > wanted:
            edge = np.partition(score, -wanted)[-wanted]
            place = place[score >= edge - 1e-9 * max(1.0, abs(edge))]
        score = (self.vectors[place] * query).sum(1)
        best = np.lexsort((self.ids[place], -score))[:wanted]
        return place[best], score[best]

    def search(
        self, query_ids: np.ndarray, queries: np.ndarray, wanted: int, width: float, growth: float, spread: float, at_once: int = 256
    ) -> list[tuple[np.ndarray, np.ndarray, int]]:
        """Per query the positions and scores of at most `wanted` vectors, best first, and how many were verified."""
        norms = np.sqrt((queries * queries).sum(1))
        unit = np.column_stack([queries / norms[:, None], np.zeros(len(queries))])
        radius, out = self.near_radius(unit, wanted), []
        for a in range(0, len(queries), at_once):  # running counts of a few queries at a time
            b = a + at_once
            out += self._search(query_ids[a:b], queries[a:b], norms[a:b], unit[a:b], radius, wanted, width, growth, spread)
        return out

    def _search(
        self, query_ids: np.ndarray, queries: np.ndarray, norms: np.ndarray, unit: np.ndarray, radius: float,
        wanted: int, width: float, growth: float, spread: float,
    ) -> list:
        at = unit @ self.directions
        m, n = len(self.sorted), len(self.ids)
        # A vector at exactly the radius falls into a window with this chance, into `threshold`
        # of all windows almost surely.
        chance = math.erf(width / math.sqrt(2))
        threshold = max(1, math.floor(m * chance - spread * math.sqrt(m * chance * (1 - chance))))
        done: list = [None] * len(queries)
        found = {q: (np.zeros(0, np.int64), np.zeros(0)) for q in range(len(queries))}
        counts: np.ndarray | None = None
        ends: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        open_ = np.arange(len(queries))
        while len(open_):
            half = width * radius
            low = np.stack([np.searchsorted(s, at[open_, i] - half, "left") for i, s in enumerate(self.sorted)], 1)
            high = np.stack([np.searchsorted(s, at[open_, i] + half, "right") for i, s in enumerate(self.sorted)], 1)
            left = []
            if counts is None:
                counts = self._collisions(low, high)
            for q, a, b in zip(open_.tolist(), low, high):
                if q in ends:
                    counts[q] += self._passed(a, ends[q][0]) + self._passed(ends[q][1], b)
                ends[q] = a, b
                whole = not a.any() and (b == n).all()
                hits = np.flatnonzero(counts[q] >= threshold) if not whole else np.arange(n)
                hits = hits[self.ids[hits] != query_ids[q]]
                place, score = found[q]
                more = np.setdiff1d(hits, place, assume_unique=True)  # only these are new to verify
                score = np.concatenate([score, np.einsum("ij,j->i", self.vectors[more], queries[q])])
                place = np.concatenate([place, more])
                near = 2 - 2 * score / (norms[q] * self.largest) <= radius * radius
                if np.count_nonzero(near) >= wanted or whole:
                    done[q] = *self._best(place, score, queries[q], wanted), len(place)
                    del found[q], ends[q]
                else:
                    found[q] = place, score
                    left.append(q)
            open_ = np.array(left, np.int64)
            radius *= growth
        return done


def nearest(
    df: DataFrame, key: str, vector: str, is_query: Column, wanted: int = 20, block: int = 8192, query_block: int = 16384,
    projections: int = 640, width: float = 1.4, growth: float = 1.03, spread: float = 1.2, seed: int = 7,
) -> DataFrame:
    """query_id, rank (from 1), found id (under the name `key`), score and `verified` of each query's nearest rows.

    Nearest means the largest inner product in double precision; ties go to the smaller key. Rows
    whose vector is null, zero, empty or holds a null or a number that is not finite take no part,
    nor do rows without key; a query meets only vectors of its own length and never rows of its own
    key. A key that repeats among the queries is searched once, with its smallest vector; repeated
    candidates are all kept. With fewer candidates than `wanted` all are returned. `verified` tells how many
    vectors the query was compared with exactly.

    Every row is indexed. Blocks of about `block` vectors meet blocks of about `query_block`
    queries, and each meeting gives its own `wanted` best, so windows never grow beyond a block and
    no block's size depends on the table's. A block's vectors move, and its arrays are built, once per
    `query_block` queries; those are many, as they need little room next to the arrays. A block's starting radius comes from at most 64 of its queries.
    """
    value = F.col(vector).cast("array<double>")
    rows = df.select(F.col(key).alias("id"), value.alias("v"), F.coalesce(is_query, F.lit(False)).alias("q"))
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    rows = rows.filter(F.col("id").isNotNull() & F.col("v").isNotNull()).filter(finite & F.exists("v", lambda x: x != 0))
    rows = settle(rows.withColumn("dim", F.size("v")).withColumn(
        "norm", F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x))
    ).withColumn("row", F.monotonically_increasing_id()), "vectors")
    sizes = rows.groupBy("dim").agg(
        F.max("norm").alias("largest"), F.ceil(F.count(F.lit(1)) / block).cast("int").alias("blocks"),
        F.ceil(F.sum(F.col("q").cast("long")) / query_block).cast("int").alias("query_blocks"),
    ).filter("query_blocks > 0")
    joined = rows.join(F.broadcast(sizes), "dim")  # one row per vector length
    # Equal vectors spread: the row decides the block.
    own = joined.withColumn("b", F.pmod(F.xxhash64("row"), F.col("blocks")).cast("int")).select(
        "dim", "b", F.explode(F.sequence(F.lit(0), F.col("query_blocks") - 1)).alias("qb"), "largest", "id", "v"
    )
    kind = rows.schema["id"].dataType
    queries = joined.filter("q").groupBy("dim", "id").agg(
        F.min("v").alias("v"), F.first("blocks").alias("blocks"), F.first("query_blocks").alias("query_blocks")
    ).withColumn("qb", F.pmod(F.xxhash64("id"), F.col("query_blocks")).cast("int")).select(
        F.col("dim").alias("dim"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("b"), "qb",
        F.col("id").alias("id"), "v",
    )

    def matrix(table: pa.Table) -> np.ndarray:
        flat = pa.concat_arrays([c.flatten() for c in table.column("v").chunks])
        return flat.to_numpy(zero_copy_only=False).reshape(len(table), -1)

    def meet(candidates: pa.Table, asked: pa.Table) -> pa.Table:
        if not len(candidates) or not len(asked):
            return empty
        ids, asked = candidates.column("id").to_numpy(), asked.sort_by("id")
        index = Block(ids, matrix(candidates), candidates.column("largest")[0].as_py(), projections, seed)
        query_ids = asked.column("id").to_numpy()
        hits = index.search(query_ids, matrix(asked), wanted, width, growth, spread)
        return pa.table([
            pa.array(np.repeat(query_ids, [len(p) for p, _, _ in hits])),
            pa.array(np.concatenate([index.ids[p] for p, _, _ in hits])),
            pa.array(np.concatenate([s for _, s, _ in hits])),
            pa.array(np.concatenate([[n, *[0] * (len(p) - 1)][: len(p)] for p, _, n in hits]).astype(np.int64)),
        ], schema=empty.schema)

    schema = T.StructType([
        T.StructField("query_id", kind), T.StructField("id", kind), T.StructField("score", T.DoubleType()),
        T.StructField("verified", T.LongType()),  # on the first row of a query in a block
    ])
    from pyspark.sql.pandas.types import to_arrow_schema

    empty = to_arrow_schema(schema).empty_table()
    place = ["dim", "b", "qb"]
    local = own.groupBy(*place).cogroup(queries.groupBy(*place)).applyInArrow(meet, schema)
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    ranked = local.withColumns({
        "rank": F.row_number().over(best), "verified": F.sum("verified").over(Window.partitionBy("query_id"))
    })
    return ranked.filter(F.col("rank") <= wanted).select(
        "query_id", F.col("rank").cast("int").alias("rank"), F.col("id").alias(key), "score", "verified"
    )
