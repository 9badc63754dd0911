"""Spelling variants against brute force over all pairs of words."""

import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from pairlab.llm import variants

from .conftest import SCHEMA

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def one_edit(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:k] + b[k + 1 :] == a for k in range(len(b)))


def plain(rows, one_in=199, length=6, count=5, times=5):
    n = Counter()
    for key, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(LOWER)
            h = zlib.crc32(f"{'' if key is None else key}:{run}".encode())
            if h % one_in == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            n[run] += 1
    n = {w: k for w, k in n.items() if len(w) >= length and k >= count}
    near = {w: [v for v in n if one_edit(w, v)] for w in n}
    form = {}
    for w in n:
        best = min(near[w], key=lambda v: (-n[v], v), default=None)
        if best is not None and n[best] >= times * n[w]:
            form[w] = best
    out = set()
    for w in n:
        root = w
        while root in form:
            root = form[root]
        out.add((w, form.get(w), root, n[w], len(near[w]), n[form[w]] if w in form else None))
    return out


def seen(df):
    rows = [(r["word"], r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in df.collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


def misspelt():
    rng = random.Random(8)
    letters = "abcdefghéüÿ÷"
    rows, base = [], ["".join(rng.choices(letters, k=rng.randint(5, 12))) for _ in range(40)]
    pool = []
    for w in base:
        pool += [w] * rng.choice([5, 30, 200, 900])
        for _ in range(4):
            v, k = list(w), rng.choice([1, 1, 5, 8, 30])
            for _ in range(rng.choice([1, 1, 2])):
                at = rng.randrange(len(v))
                v[at : at + rng.randint(0, 1)] = rng.choices(letters, k=rng.randint(0, 1))
            pool += ["".join(v)] * k
    pool += ["aaaaaa"] * 6 + ["aaaaaaa"] * 90 + ["aaaaaaaa"] * 1500 + ["abaaaa"] * 5 + ["AaAaaa"] * 3 + ["ÀÀàààà"] * 9
    rng.shuffle(pool)
    for k in range(0, len(pool), 37):
        rows.append((k if k % 3 else None, rng.choice([" ", "\n", "1", "–"]).join(pool[k : k + 37])))
    return rows + [(1, None), (None, None), (2, ""), (3, " ".join(pool)), (3, " ".join(pool))]


@pytest.mark.parametrize("symbols", [2, 8])
@pytest.mark.parametrize("one_in", [3, 199])
def test_misspelt(spark, symbols, one_in):
    rows = misspelt()
    frame = spark.createDataFrame([(k, t, *[None] * (len(SCHEMA) - 2)) for k, t in rows], SCHEMA).repartition(3)
    want = plain(rows, one_in)
    assert seen(variants.group_variants(frame, "doc_id", "text", one_in=one_in, symbols=symbols)) == want
    assert any(f and r != f for _, f, r, *_ in want)


def test_documents_and_odd_rows(documents, odd, none):
    for frame in (documents, odd):
        rows = [(r["doc_id"], r["text"]) for r in frame.collect()]
        assert seen(variants.group_variants(frame, "doc_id", "text")) == plain(rows)
    assert variants.group_variants(none, "doc_id", "text").count() == 0


def test_neighbourhoods_meet_every_near_pair():
    rng, table = random.Random(1), variants.symbol_table(4)
    words = sorted({"".join(rng.choices("abcdeÿ", k=rng.randint(6, 8))) for _ in range(400)})
    own, around = variants.own_keys(words, table), variants.neighbourhoods(words, table)
    for i, a in enumerate(words):
        for j, b in enumerate(words):
            if one_edit(a, b):
                assert np.isin(own[j], around[i]) or np.isin(own[i], around[j])
