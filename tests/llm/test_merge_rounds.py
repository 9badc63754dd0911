"""SentencePiece ids and decoding against the library."""

import random
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from sentencepiece import SentencePieceProcessor

from pairlab.llm import merge_rounds
from pairlab.llm.merge_rounds import MergeRounds

PATH = public_tokenizers.path("piece_bpe_32k.model")
LETTERS = list("abcdefghtnr rrnn   \t\nÀéßжд日本語😀▁<>0x/sA.,-\x00\x1c\x85‍") + [
    "the", "</s>", "<0x0A>", "▁▁", "return", " th", "    ", "<unk>",
]


def made(n):
    rng = random.Random(4)
    texts = ["".join(rng.choices(LETTERS, k=rng.randint(0, 40))) for _ in range(n)]
    # pieces that merge on before others of their rank, runs, words of many symbols
    texts += ["".join(rng.choices("thandre", k=k)) for k in range(1, 200)]
    return texts + ["", " ", " " * 700, "th" * 600, "nt" * 300, "a" * 900, "日本語" * 500, " " * 3000 + "x", None]


@pytest.fixture(scope="module")
def library():
    return SentencePieceProcessor(model_file=PATH)


@pytest.mark.parametrize("keep,long", [(400_000, 1024), (10, 1024), (400_000, 12)])
def test_ids_and_texts(library, monkeypatch, keep, long):
    monkeypatch.setattr(merge_rounds, "LONG", long)
    rounds, texts = MergeRounds(PATH, keep), made(4000)
    for some in range(0, len(texts), 1500):
        part = texts[some : some + 1500]
        ids, counts = rounds.encode(part)
        ends = np.cumsum(counts)
        want = library.encode([t or "" for t in part])
        assert [ids[a:b].tolist() for a, b in zip(ends - counts, ends)] == want
        assert [rounds.decode(np.array(w, int)).decode() for w in want] == [library.decode(w) for w in want]


def test_any_ids_decode(library):
    rounds, rng = MergeRounds(PATH), random.Random(9)
    for _ in range(3000):
        draw = lambda: rng.choice([rng.randrange(32000), rng.randrange(3, 259), rng.randrange(3, 259), 0, 1, 2, 28705])
        ids = [draw() for _ in range(rng.randint(0, 9))]
        assert rounds.decode(np.array(ids, int)).decode() == library.decode(ids)


def test_rows(odd, none, library):
    got = merge_rounds.encode_texts(odd, "doc_id", "text", PATH, unit=1000).collect()
    want = Counter()
    for r in odd.collect():
        ids = library.encode(r["text"] or "", add_eos=True)
        want[r["doc_id"], tuple(ids), library.decode(ids).encode()] += 1
    assert want == Counter((r["doc_id"], tuple(r["ids"]), bytes(r["decoded"])) for r in got)
    bare = merge_rounds.encode_texts(odd, "doc_id", "text", PATH, add_end=False).filter("size(ids) = 0")
    assert bare.count() == sum(not r["text"] for r in odd.collect())
    assert merge_rounds.encode_texts(none, "doc_id", "text", PATH).count() == 0


def test_one_word_of_many_letters(library):
    rng = random.Random(2)
    text = "".join(rng.choices("thandreo", k=300_000))
    ids, _ = MergeRounds(PATH).encode([text])
    assert ids.tolist() == library.encode(text)
