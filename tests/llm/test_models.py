import random

import numpy as np
import pyarrow.parquet as pq
from pyspark.sql import functions as F

from pairlab.llm import collisions, langid

from .conftest import TABLES


def test_languages_of_documents(documents):
    out = langid.identify_documents(documents, "doc_id", "text", "lang")
    rows = out.join(documents.select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in rows if r["held_out"]]
    assert len(rows) == documents.count() and len(held) > 10
    assert all(0 <= r["score"] <= 1 for r in rows)
    assert np.mean([r["lang"] == r["lang_pred"] for r in held]) > 0.95


def test_prediction_ignores_labels(documents):
    """The held-out rows' labels, and the ids, are no inputs of a prediction."""
    wrong = documents.withColumn("lang", F.when(langid.held_out(F.col("doc_id")), "zz").otherwise(F.col("lang")))
    a, b = (
        {r["doc_id"]: (r["lang_pred"], round(r["score"], 6)) for r in langid.identify_documents(d, "doc_id", "text", "lang").collect()}
        for d in (documents, wrong)
    )
    assert a == b


def test_odd_rows(odd, none):
    out = langid.identify_documents(odd, "doc_id", "text", "lang", epochs=1).collect()
    assert len(out) == odd.count()
    assert {r["lang_pred"] for r in out} <= {"x", "y", "und"}
    by_id = {r["doc_id"]: r for r in out}
    assert all(by_id[i]["lang_pred"] == "und" and by_id[i]["score"] == 0 for i in (0, 1, 2, 24))
    assert by_id[None]["held_out"]
    assert langid.identify_documents(none, "doc_id", "text", "lang").count() == 0
    unlabelled = odd.withColumn("lang", F.lit(None).cast("string"))
    assert {r["lang_pred"] for r in langid.identify_documents(unlabelled, "doc_id", "text", "lang").collect()} == {"und"}


def test_windows():
    body = bytes(range(1, 11))
    rows, held = langid.windows_of(body, 4)
    assert rows.tolist() == [[1, 2, 3, 4], [5, 6, 7, 8], [9, 10, 0, 0]] and held.tolist() == [4, 4, 2]
    assert len(langid.windows_of(b"", 4)[0]) == 0


def nearest(rows, wanted):
    usable = [
        (k, np.array(v, float)) for k, v in rows
        if k is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)
    ]
    out = {}
    for q, v in usable:
        if q % 20 == 0:
            found = sorted((-float((x * v).sum()), k) for k, x in usable if k != q and len(x) == len(v))
            out[q] = [(k, -s) for s, k in found[:wanted]]
    return out


def got(df, **options):
    out = {}
    rows = collisions.nearest(df, "vec_id", "embedding", F.col("vec_id") % 20 == 0, **options).collect()
    for r in sorted(rows, key=lambda r: (r["query_id"], r["rank"])):
        assert r["rank"] == len(out.setdefault(r["query_id"], [])) + 1
        out[r["query_id"]].append((r["vec_id"], r["score"]))
    return out


def test_recall(spark):
    table = pq.read_table(f"{TABLES}/embeddings.parquet").to_pydict()
    want = nearest(list(zip(table["vec_id"], table["embedding"])), 20)
    for block in (8192, 90):
        found = got(spark.read.parquet(f"{TABLES}/embeddings.parquet"), block=block, query_block=7)
        assert found.keys() == want.keys()
        hits = [len({k for k, _ in want[q]} & {k for k, _ in found[q]}) for q in want]
        assert np.mean(hits) >= 0.95 * 20
        for q in want:
            assert all(abs(s - dict(nearest_all(table, q))[k]) < 1e-12 for k, s in found[q])


def nearest_all(table, q):
    vectors = np.array(table["embedding"], float)
    ids = np.array(table["vec_id"])
    return list(zip(ids.tolist(), (vectors * vectors[ids == q][0]).sum(1).tolist()))


def test_odd_vectors(spark):
    rng = random.Random(6)
    rows = [(i, [rng.gauss(0, 1 + i % 3) for _ in range(4)]) for i in range(100)]
    same = rows[7][1]
    rows += [(100 + i, list(same)) for i in range(30)]  # ties
    rows += [(140, None), (160, []), (180, [0.0] * 4), (200, [1.0, None, 1.0, 1.0]), (201, [float("nan")] * 4),
             (202, [float("inf"), 1.0, 1.0, 1.0]), (None, [1.0] * 4), (220, [1.0, 2.0]), (221, [3.0, 1.0]),
             (240, [1.0, 1.0, 1.0])]
    df = spark.createDataFrame([(k, v, "id", 1) for k, v in rows], "vec_id long, embedding array<double>, id string, dim int")
    want, found = nearest(rows, 20), got(df, wanted=20)
    want = {q: v for q, v in want.items() if v}
    assert found.keys() == want.keys()
    assert [k for k, _ in found[220]] == [221]
    hits = sum(len({k for k, _ in want[q]} & {k for k, _ in found[q]}) for q in want) / sum(map(len, want.values()))
    assert hits >= 0.95
    assert got(df, wanted=500).keys() == want.keys()  # all candidates, if fewer
    assert all(len(v) == len(want_all) for q, v in got(df, wanted=500).items() for want_all in [nearest(rows, 500)[q]])
    tie = [k for k, s in found[20] if s == dict(found[20]).get(7)]
    assert tie == sorted(tie)
    assert got(df.limit(0)) == {}


def test_running_counts():
    """Walking both ends outward adds up to the counts of the wider windows."""
    rng = np.random.default_rng(8)
    x = rng.normal(size=(300, 6))
    index = collisions.Block(np.arange(300), x, float(np.sqrt((x * x).sum(1)).max()), 40, 7)
    low, high = rng.integers(50, 100, 40), rng.integers(150, 200, 40)
    counts = index._collisions(low[None], high[None])[0]
    for _ in range(3):
        wider = np.maximum(0, low - rng.integers(0, 40, 40)), np.minimum(300, high + rng.integers(0, 60, 40))
        counts += index._passed(wider[0], low) + index._passed(high, wider[1])
        low, high = wider
        assert (counts == index._collisions(low[None], high[None])[0]).all()
    assert (index._passed(low, low) == 0).all()


def test_few_are_verified():
    """On 2,000 vectors of a known structure about a tenth is verified and nearly all neighbours are found."""
    rng = np.random.default_rng(9)
    x = rng.normal(size=(40, 64))[rng.integers(0, 40, 2_000)] + 1.2 * rng.normal(size=(2_000, 64))
    x /= np.sqrt((x * x).sum(1))[:, None]
    ids = np.arange(2_000)
    found = collisions.Block(ids, x, 1.0 + 1e-9, 640, 7).search(ids[::20], x[::20], 20, 1.4, 1.03, 1.2)
    hits = 0
    for q, (place, _, _) in zip(ids[::20], found):
        score = x @ x[q]
        score[q] = -np.inf
        hits += len(set(place.tolist()) & set(np.argsort(-score)[:20].tolist()))
    assert hits >= 0.95 * 20 * len(found)
    assert np.mean([n for _, _, n in found]) < 0.12 * 2_000


def test_cells_of_windows():
    """Counts through cells equal plain comparisons, for empty, narrow and whole windows and all sizes around the cells'."""
    rng = np.random.default_rng(10)
    for n in (1, 2, 255, 256, 257, 511, 512, 700, 2_500):
        x = rng.normal(size=(n, 5))
        index = collisions.Block(np.arange(n), x, float(np.sqrt((x * x).sum(1)).max()), 260, 7)
        place = np.argsort(index.order.reshape(260, n), axis=1)
        ends = np.sort(rng.integers(0, n + 1, (2, 6, 260)), axis=0)
        ends[:, 0] = np.array([0, n])[:, None]
        ends[1, 1] = ends[0, 1]
        ends[1, 2] = np.minimum(n, ends[0, 2] + 3)
        want = [((place >= a[:, None]) & (place < b[:, None])).sum(0) for a, b in zip(*ends)]
        assert (index._collisions(*ends) == np.array(want)).all()
