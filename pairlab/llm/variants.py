"""Spelling variants: words at one edit from each other, found through a reduced alphabet.

Letters are hashed to a few symbols. Two words at one edit have reduced words at one edit or none, so
the one-edit neighbourhood of every reduced word, joined with the reduced vocabulary, holds all
pairs of near words; they are verified on the words themselves. Neighbourhoods are symmetric: a word
keeps the part of its own that is not above itself in (length, symbols), so that every pair is
met once, from its longer or higher word.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairlab.llm.common import settle, text_rows, texts

#: Runs of letters in UTF-8, after A-Z went to lower case: a-z and U+00C0 to U+00FF.
RUNS = re.compile(rb"(?:[a-z]|\xc3[\x80-\xbf])+")
#: Odd multiplier of the polynomial keys of reduced words, and its inverse modulo 2**64.
BASE = 0x9E3779B97F4A7C15
BACK = pow(BASE, -1, 1 << 64)


def document_words(key: object, text: str, one_in: int) -> Iterator[tuple[bytes, int]]:
    """(word, occurrences) of a text; one run in `one_in` has lost a letter, as told by a checksum of key and run."""
    start = zlib.crc32(f"{'' if key is None else key}:".encode())
    for run, n in Counter(RUNS.findall(text.encode().lower())).items():
        h = zlib.crc32(run, start)
        if h % one_in == 0:
            letters = run.decode()
            at = h % len(letters)
            run = (letters[:at] + letters[at + 1 :]).encode()
        yield run, n


def vocabulary(df: DataFrame, key: str, text: str, one_in: int, least_length: int, least_count: int, most: int = 1 << 18) -> DataFrame:
    """word, n: the words of all texts that are long and frequent enough. Tasks hand over counts of `most` words at a time."""

    def count(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[bytes, int] = {}
        get = seen.get

        def out() -> pa.RecordBatch:
            words = [w for w in seen if len(w) >= least_length]  # bytes: at least as many as letters
            batch = pa.RecordBatch.from_arrays(
                [pa.array([w.decode() for w in words], pa.string()), pa.array([seen[w] for w in words], pa.int64())], names=["word", "n"]
            )
            seen.clear()
            return batch

        for k, t in text_rows(source):
            for word, n in document_words(k, t or "", one_in):
                seen[word] = get(word, 0) + n
            if len(seen) >= most:
                yield out()
        yield out()

    counted = texts(df, key, text).filter(F.col("text").isNotNull()).mapInArrow(count, "word string, n long")
    whole = counted.groupBy("word").agg(F.sum("n").alias("n"))
    return settle(whole.filter((F.char_length("word") >= least_length) & (F.col("n") >= least_count)), "words")


def symbol_table(symbols: int) -> np.ndarray:
    """Symbol (from 1) of every letter up to U+00FF, by its checksum."""
    return np.array([zlib.crc32(b"%d" % c) % symbols + 1 for c in range(256)], np.uint64)


def by_length(words: list[str], table: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Words of equal length together: their places, their symbols, and the multiplier of each letter's place."""
    sizes = np.array([len(w) for w in words], int)
    for size in np.unique(sizes).tolist():
        at = np.flatnonzero(sizes == size)
        code = np.frombuffer("".join(words[i] for i in at).encode("latin-1"), np.uint8).reshape(len(at), size)
        yield at, table[code], np.array([pow(BASE, k, 1 << 64) for k in range(size)], np.uint64)


def own_keys(words: list[str], table: np.ndarray) -> np.ndarray:
    """Per word the key of its reduced word."""
    own = np.zeros(len(words), np.uint64)
    for at, symbol, power in by_length(words, table):
        own[at] = (symbol * power).sum(1, dtype=np.uint64)
    return own


def neighbourhoods(words: list[str], table: np.ndarray) -> list[np.ndarray]:
    """Per word the keys of its reduced word's one-edit neighbourhood, as far as they are not above it."""
    around = [None] * len(words)
    for at, symbol, power in by_length(words, table):
        term = symbol * power
        before = np.cumsum(term, axis=1) - term
        whole = term.sum(1, dtype=np.uint64)
        after = whole[:, None] - before - term
        keys = [whole[:, None], before + after * np.uint64(BACK)]  # itself, and without each of its symbols
        valid = [np.ones_like(keys[0], bool), np.ones_like(keys[1], bool)]
        for s in range(1, int(table.max())):  # a smaller symbol in each place
            keys.append(whole[:, None] - term + np.uint64(s) * power)
            valid.append(symbol > s)
        keys, valid = np.concatenate(keys, 1), np.concatenate(valid, 1)
        for i, k, v in zip(at.tolist(), keys, valid):
            around[i] = np.unique(k[v])
    return around


def near_pairs(words: DataFrame, symbols: int) -> DataFrame:
    """word, n, other, other_n for both directions of every pair of words at exactly one edit."""
    table = symbol_table(symbols)

    def spread(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for found in source:
            for some in range(0, found.num_rows, 4096):
                part = found.slice(some, 4096)
                spelt = part.column(0).to_pylist()
                around = neighbourhoods(spelt, table)
                take = np.repeat(np.arange(len(spelt)), [len(k) for k in around])
                keys = np.concatenate([*around, np.zeros(0, np.uint64)])
                yield pa.RecordBatch.from_arrays([
                    pa.array(keys.view(np.int64)), *(c.take(pa.array(take)) for c in part.columns),
                    pa.array(keys == own_keys(spelt, table)[take]),
                ], names=["key", "word", "n", "same"])

    def reduce(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for found in source:
            own = own_keys(found.column(0).to_pylist(), table)
            yield pa.RecordBatch.from_arrays([pa.array(own.view(np.int64)), *found.columns], names=["key", "other", "other_n"])

    keyed = words.select("word", "n").mapInArrow(spread, "key long, word string, n long, same boolean")
    reduced = words.select("word", "n").mapInArrow(reduce, "key long, other string, other_n long")
    # Words of the same reduced word meet in both directions; one of them is enough.
    met = keyed.join(reduced, "key").filter(~F.col("same") | (F.col("word") > F.col("other")))
    verified = (F.col("word") != F.col("other")) & (F.levenshtein("word", "other", 1) == 1)
    near = settle(met.filter(verified).select("word", "n", "other", "other_n"), "near")
    turned = near.select(F.col("other").alias("word"), F.col("other_n").alias("n"), F.col("word").alias("other"), F.col("n").alias("other_n"))
    return near.unionByName(turned)


def follow(links: DataFrame) -> DataFrame:
    """word, root: where `links` (word, form) end. Each round follows twice as many of them."""
    ahead = settle(links.select("word", F.col("form").alias("root")), "roots")
    while True:
        further = ahead.select(F.col("word").alias("root"), F.col("root").alias("beyond"))
        moved = settle(ahead.join(further, "root", "left").select(
            "word", F.coalesce("beyond", "root").alias("root"), F.col("beyond").isNotNull().alias("moved")
        ), "roots")
        ahead = moved.select("word", "root")
        if moved.filter("moved").isEmpty():
            return ahead


def group_variants(
    df: DataFrame, key: str, text: str, one_in: int = 199, least_length: int = 6, least_count: int = 5, times: int = 5, symbols: int = 8
) -> DataFrame:
    """word, form, root, n, n_near, form_n of every word of the texts.

    Words are runs of a-z, A-Z and U+00C0 to U+00FF of the whole texts, A-Z in lower case; a run whose
    checksum with its document's key is divisible by `one_in` loses the letter that the checksum names.
    Words of at least `least_length` letters and `least_count` occurrences count. Two are near at exactly
    one inserted, deleted or replaced letter. `form` is the near word of largest n (ties: the
    smallest) if that is at least `times` the word's own n; `root` is where forms lead.

    Null and empty texts have no words; a null key counts as an empty one; repeated rows count each
    time; very long texts are read whole, one at a time; no rows, or no words, give no rows; other
    columns are not read. `symbols` is the size of the reduced alphabet: it changes effort, not results.
    """
    words = vocabulary(df, key, text, one_in, least_length, least_count)
    pairs = near_pairs(words, symbols)
    best = F.min(F.struct((-F.col("other_n")).alias("minus"), F.col("other").alias("form")))
    facts = settle(pairs.groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), best.alias("best"), F.max("n").alias("own")), "facts")
    leads = -F.col("best")["minus"] >= times * F.col("own")
    chosen = facts.select(
        "word", "n_near", F.when(leads, F.col("best")["form"]).alias("form"), F.when(leads, -F.col("best")["minus"]).alias("form_n")
    )
    roots = follow(chosen.filter("form is not null").select("word", "form"))
    return (
        words.join(chosen, "word", "left").join(roots, "word", "left")
        .select("word", "form", F.coalesce("root", "word").alias("root"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), "form_n")
    )
