import hashlib
import random
from collections import Counter

from pairlab.llm import piecewise


def test_neighbours_against_brute_force(documents):
    texts = sorted(((r["doc_id"], r["text"]) for r in documents.collect()), reverse=True)
    got = {r["doc_id"]: r for r in piecewise.compare_neighbours(documents, "doc_id", "text").collect()}
    assert len(got) == len(texts)
    for (key, text), (_, following) in zip(texts, texts[1:] + texts[:1]):
        r, changed = got[key], piecewise.edited(text, following)
        assert r["n_chars"] == len(text)
        assert r["edited_sha256"] == hashlib.sha256(changed.encode()).hexdigest()
        assert r["fingerprint"] == piecewise.fingerprint(text.encode())
        assert r["edited_fingerprint"] == piecewise.fingerprint(changed.encode())
        assert r["near_edited"] == piecewise.likeness(r["fingerprint"], r["edited_fingerprint"])
        assert r["near_next"] == piecewise.likeness(r["fingerprint"], piecewise.fingerprint(following.encode()))
    assert sum(r["near_edited"] > r["near_next"] for r in got.values()) > 0.97 * len(got)


def test_odd_rows(odd, none, spark):
    rows = odd.collect()
    out = piecewise.compare_neighbours(odd, "doc_id", "text").collect()
    assert Counter((r["doc_id"], len(r["text"] or "")) for r in rows) == Counter((r["doc_id"], r["n_chars"]) for r in out)
    by_text = {}
    for r in rows:
        by_text.setdefault((r["doc_id"], len(r["text"] or "")), piecewise.fingerprint((r["text"] or "").encode()))
    assert all(0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1 for r in out)
    assert all(r["fingerprint"] == by_text[r["doc_id"], r["n_chars"]] for r in out if r["doc_id"] not in (None, 50))
    assert piecewise.compare_neighbours(none, "doc_id", "text").count() == 0
    alone = piecewise.compare_neighbours(odd.filter("doc_id = 10"), "doc_id", "text").first()
    assert alone["near_next"] == 1.0


def test_likeness():
    rng = random.Random(4)
    words = ["".join(rng.choices("abcdefgh", k=6)) for _ in range(3000)]
    text, other = " ".join(words[:1500]), " ".join(words[1500:])
    near = " ".join(words[:700] + ["inserted"] + words[700:1500])
    mark = lambda t: piecewise.fingerprint(t.encode())
    assert piecewise.likeness(mark(text), mark(text)) == 1
    assert piecewise.likeness(mark(text), mark(near)) > 0.9
    assert piecewise.likeness(mark(text), mark(other)) < 0.2
    assert piecewise.likeness(mark(""), mark("")) == 1 and piecewise.likeness(mark(""), mark(text)) == 0
    for t in ("ab " * 100_000, "a", "x" * 5000):
        n, own, coarse = mark(t).split(":")
        assert len(own) <= piecewise.LONGEST


def test_common_subsequence():
    rng = random.Random(8)
    for _ in range(200):
        a, b = ("".join(rng.choices("abc", k=rng.randint(0, 12))) for _ in range(2))
        best = [0] * (len(b) + 1)
        for x in a:
            last = best[:]
            for j, y in enumerate(b):
                best[j + 1] = last[j] + 1 if x == y else max(last[j + 1], best[j])
        assert piecewise._common(a, b) == best[-1]
