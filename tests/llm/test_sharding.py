import math
import struct
import zlib
from collections import Counter, defaultdict

import pytest
import xxhash

from pairlab.llm import sharding

EQUAL = {s: 1.0 for s in range(16)}


def brute(key, weights, seed=0):
    def cost(shard, weight):
        h = 42
        for part in (None if key is None else struct.pack("<q", key), struct.pack("<i", shard), struct.pack("<i", seed)):
            h = h if part is None else xxhash.xxh64_intdigest(part, h)
        return -math.log(((h >> 11) + 0.5) * 2.0**-53) / weight

    return min(sorted(weights), key=lambda s: (cost(s, weights[s]), s))


def test_odd_rows(odd):
    rows = odd.collect()
    out = sharding.assign_shards(odd, "doc_id", "text", EQUAL, {s: 1.0 for s in range(17)}).collect()
    assert len(out) == len(rows)
    want = Counter((r["doc_id"], len((r["text"] or "").encode()) + 1, zlib.crc32((r["text"] or "").encode())) for r in rows)
    assert want == Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in out)
    slots = defaultdict(list)
    for r in out:
        assert r["shard"] == brute(r["doc_id"], EQUAL)
        assert r["grown_shard"] in (r["shard"], 16)
        slots[r["shard"]].append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_weights(spark):
    keys = spark.range(20_000).selectExpr("id AS doc_id", "'x' AS text")
    shares = Counter(r["shard"] for r in sharding.assign_shards(keys, "doc_id", "text", {0: 1.0, 5: 2.0, 9: 1.0}).collect())
    assert abs(shares[5] / 20_000 - 0.5) < 0.02 and set(shares) == {0, 5, 9}


def test_none(none):
    assert sharding.assign_shards(none, "doc_id", "text", EQUAL).count() == 0
    with pytest.raises(ValueError):
        sharding.rendezvous(None, {})
