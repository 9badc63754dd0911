import random
import time
from collections import Counter

import numpy as np
import pytest

from pairlab.llm import jaccard, meeting, recompression

from .conftest import WORDS


def kept_words(rows, width):
    """(key, n_words, n_removed, kept text) by counting every window."""
    split = [(k, WORDS.findall(t or "")) for k, t in rows]
    seen = Counter(tuple(w[i : i + width]) for _, w in split for i in range(len(w) - width + 1))
    out = []
    for k, w in split:
        gone = [False] * len(w)
        for i in range(len(w) - width + 1):
            if seen[tuple(w[i : i + width])] > 1:
                gone[i : i + width] = [True] * width
        out.append((k, len(w), sum(gone), " ".join(x for x, g in zip(w, gone) if not g)))
    return Counter(out)


def got_words(df, key, width, **options):
    out = recompression.drop_repeats(df, key, "text", width=width, **options).collect()
    return Counter((r[key], r["n_words"], r["n_removed"], r["kept"]) for r in out)


@pytest.mark.parametrize("size", [1 << 22, 2000])
def test_odd_rows(odd, size):
    assert got_words(odd, "doc_id", 35, size=size) == kept_words([(r["doc_id"], r["text"]) for r in odd.collect()], 35)


def test_documents(documents, none):
    rows = [(r["doc_id"], r["text"]) for r in documents.collect()]
    assert got_words(documents, "doc_id", 35, size=50_000) == kept_words(rows, 35)
    assert recompression.drop_repeats(none, "doc_id", "text").count() == 0


@pytest.mark.parametrize("seed", range(3))
def test_few_words(spark, seed):
    """Runs, periods and overlaps of every kind: words from a tiny vocabulary."""
    rng = random.Random(seed)
    rows = []
    for k in range(120):
        kind = rng.randrange(4)
        word = lambda: rng.choice("ab" if kind == 0 else "abcde")
        period = [word() for _ in range(rng.randint(1, 4))]
        text = period * rng.randint(1, 12) if kind == 1 else [word() for _ in range(rng.randint(0, 60))]
        rows.append((k, " ".join(text + [word() for _ in range(rng.randint(0, 9))])))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    for width in (6, 12):
        assert got_words(df, "doc_id", width, size=400) == kept_words(rows, width)


def classes(rows, width, at_least):
    sets = []
    for _, t in rows:
        w = WORDS.findall("".join(c.lower() if c.isascii() else c for c in t or ""))
        sets.append({tuple(w[i : i + width]) for i in range(max(1, len(w) - width + 1))} if w else set())
    up = list(range(len(rows)))

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            both = len(a & b)
            if a and b and at_least[1] * both >= at_least[0] * (len(a) + len(b) - both):
                up[find(i)] = find(j)
    least = {}
    for i, (k, _) in enumerate(rows):
        known = [x for x in (least.get(find(i)), k) if x is not None]
        least[find(i)] = min(known, default=None)
    return Counter((k, len(sets[i]), least[find(i)]) for i, (k, _) in enumerate(rows))


def got_classes(df, width=5, at_least=(75, 100), **options):
    out = jaccard.near_duplicates(df, "doc_id", "text", width, at_least, **options).collect()
    stay = Counter(r["component_id"] for r in out if r["stays"])
    worded = {r["component_id"] for r in out if r["n_shingles"] and r["component_id"] is not None}
    assert all(stay[c] >= 1 for c in worded)
    return Counter((r["doc_id"], r["n_shingles"], r["component_id"]) for r in out), out


@pytest.mark.parametrize("options", [{}, {"chunk_size": 3000, "block": 300}, {"members": 3}])
def test_classes_of_odd_rows(odd, options):
    rows = [(r["doc_id"], r["text"]) for r in odd.collect()]
    assert got_classes(odd, **options)[0] == classes(rows, 5, (75, 100))


def test_classes_of_documents(documents, none):
    rows = [(r["doc_id"], r["text"]) for r in documents.collect()]
    got, out = got_classes(documents, chunk_size=40_000)
    assert got == classes(rows, 5, (75, 100))
    assert sum(r["stays"] for r in out) == len({r["component_id"] for r in out})
    assert jaccard.near_duplicates(none, "doc_id", "text").count() == 0


@pytest.mark.parametrize("block", [1 << 22, 500])
def test_chains_of_near_copies(spark, block):
    """One large family whose members mostly do not link directly, in one block and in many."""
    rng = random.Random(11)
    base = ["".join(rng.choices("abcdefgh", k=5)) for _ in range(60)]
    rows = []
    for k in range(150):
        words = base[:]
        for _ in range(rng.randint(0, 5)):
            words[rng.randrange(len(words))] = f"x{rng.randrange(40)}"
        rows.append((k, " ".join(words)))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert got_classes(df, width=3, block=block, chunk_size=5000)[0] == classes(rows, 3, (75, 100))


def test_a_hot_family_takes_no_time():
    """Thousands of near copies of one text, all of one family, in one task."""
    rng = np.random.default_rng(4)
    base = rng.integers(0, 1 << 60, 40, dtype=np.uint64)
    sets = [np.unique(np.where(rng.random(40) < 0.06, rng.integers(0, 1 << 60, 40, dtype=np.uint64), base)) for _ in range(8000)]
    start = time.perf_counter()
    found = jaccard.links_within(sets, np.zeros(len(sets), int), (75, 100))
    assert time.perf_counter() - start < 40
    union = jaccard.Union(len(sets))
    for a, b in found:
        assert 100 * len(np.intersect1d(sets[a], sets[b])) >= 75 * len(np.union1d(sets[a], sets[b]))
        union.join(a, b)
    known = [np.isin(base, s).sum() for s in sets]
    close = [i for i, k in enumerate(known) if k >= 38]  # any two of them link
    assert len({union.find(i) for i in close}) == 1 and len(close) > 4000


def test_equal_high_halves_do_not_meet_as_one():
    """Short keys of a bucket differ by their lower bits."""
    keys = np.array([5 << 40 | k for k in range(1000)], np.uint64)
    rows = list(meeting.send(1, 0, 4, keys, None, np.ones(1000), short=True))
    assert len(rows) == 1 and len(np.unique(np.frombuffer(rows[0][3], np.uint32))) == 1000
