"""Codes by pivots against a plain version with Python integers."""

import hashlib
import math
import random
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import types as T

from pairlab.llm import pivots
from pairlab.llm.queries import pivot_codes

from .conftest import TABLES

SCHEMA = T.StructType([
    T.StructField("vec_id", T.LongType()), T.StructField("embedding", T.ArrayType(T.FloatType())),
    T.StructField("label", T.IntegerType()), T.StructField("key", T.StringType()), T.StructField("code", T.StringType()),
    T.StructField("error", T.StringType()), T.StructField("whole", T.StringType()),
])


def plain(rows, parts=8, entries=16, rounds=6):
    kept = [
        (i, [math.floor(4096 * x) for x in v], label) for i, v, label in rows
        if v and all(x is not None and math.isfinite(x) for x in v)
    ]
    if not kept:
        return [], ""
    width = len(kept[0][1]) // parts
    cut = lambda v, p: tuple(v[p * width : (p + 1) * width])
    seeds = sorted(kept, key=lambda r: (r[0] is None, r[0] or 0, r[1]))[:entries]
    books = [[cut(v, p) for _, v, _ in seeds] for p in range(parts)]

    def best(x, book):
        return min((sum((a - b) ** 2 for a, b in zip(x, e)), k) for k, e in enumerate(book))

    for _ in range(rounds):
        for p in range(parts):
            groups = defaultdict(list)
            for _, v, _ in kept:
                groups[best(cut(v, p), books[p])[1]].append(cut(v, p))
            for k, members in groups.items():
                books[p][k] = tuple(sum(c) // len(members) for c in zip(*members))
    out = [(i, [best(cut(v, p), books[p]) for p in range(parts)], label) for i, v, label in kept]
    totals = defaultdict(int)
    for _, found, label in out:
        totals[label] += sum(d for d, _ in found)
    text = ",".join(str(c) for book in books for e in book for c in e)
    return sorted(
        (i is not None, i or 0, "".join(f"{k:02x}" for _, k in found), sum(d for d, _ in found), totals[label])
        for i, found, label in out
    ), text


def odd_vectors():
    rng = random.Random(3)
    vector = lambda w=16: [rng.gauss(0, 1) for _ in range(w)]
    rows = [(i, vector(), i % 3 if i % 5 else None) for i in range(300)]
    rows += [(7, rows[8][1], 1), (8, rows[8][1], 1), (None, vector(), 0), (None, rows[3][1], None), (500, [0.0] * 16, 2)]
    rows += [(501, None, 1), (502, vector(15) + [None], 1), (503, vector(15) + [float("nan")], 1),
             (504, vector(15) + [float("-inf")], 1), (505, [], 1), (-5, [round(x) / 1.0 for x in vector()], 1)]
    rows += [(600 + i, [float(rng.randint(-1, 1)) for _ in range(16)], 4) for i in range(200)]  # ties
    return rows


def seen(df):
    return sorted((r["vec_id"] is not None, r["vec_id"] or 0, r["code"], r["error"], r["label_error"]) for r in df.collect())


@pytest.mark.parametrize("rows", [odd_vectors(), odd_vectors()[:5], odd_vectors()[305:310], []], ids=["many", "few", "bad", "none"])
def test_odd_vectors(spark, tmp_path, rows):
    wide = [(*r, "k", "c", "e", "w") for r in rows]
    spark.createDataFrame(wide, SCHEMA).repartition(3).write.parquet(f"{tmp_path}/embeddings.parquet")
    out = pivot_codes(spark, str(tmp_path))
    single = [(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v], label) for i, v, label in rows]
    want, text = plain(single)
    assert seen(out) == want
    assert {r[0] for r in out.select("codebooks_sha256").collect()} == ({hashlib.sha256(text.encode()).hexdigest()} if want else set())


def test_table(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{TABLES}/embeddings.parquet").select("vec_id", "embedding", "label").collect()]
    want, text = plain(rows)
    out = pivot_codes(spark, TABLES)
    assert seen(out) == want
    assert out.first()["codebooks_sha256"] == hashlib.sha256(text.encode()).hexdigest()


def test_pruning():
    """Clustered parts need few of the exact evaluations, and find the same entries."""
    rng = np.random.default_rng(1)
    entries = rng.integers(-4000, 4000, (16, 8))
    part = entries[rng.integers(0, 16, 3000)] + rng.integers(-200, 200, (3000, 8))
    chosen = pivots.choose_pivots(entries, 4)
    away = np.sqrt(pivots.squared(part[:, None], chosen[None]).astype(float)).astype(np.float32)
    index, error, evaluated = pivots.nearest_entries(part, away, chosen, entries)
    every = pivots.squared(part[:, None], entries[None])
    assert np.array_equal(index, every.argmin(1)) and np.array_equal(error, every.min(1))
    assert evaluated < 3 * len(part)


def test_bad_lengths(spark):
    frame = spark.createDataFrame([(1, [1.0] * 8), (2, [1.0] * 16)], "vec_id long, embedding array<double>")
    with pytest.raises(Exception, match="one length"):
        pivots.encode(frame, "vec_id", "embedding", "vec_id").collect()
