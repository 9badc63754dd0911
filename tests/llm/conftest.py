import random
import re

import pytest
from pyspark.sql import types as T

TABLES = "/root/testdata/sf0.001"
WORDS = re.compile(r"[^\x20\x09-\x0D]+")

SCHEMA = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()),
    T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()),
    T.StructField("n_chars", T.LongType()),
    # Names that operators use inside, or return.
    T.StructField("key", T.StringType()), T.StructField("chunk", T.LongType()), T.StructField("part", T.StringType()),
    T.StructField("shard", T.StringType()), T.StructField("row", T.StringType()), T.StructField("node", T.StringType()),
    T.StructField("own", T.StringType()), T.StructField("worded", T.StringType()), T.StructField("known as", T.StringType()),
    T.StructField("known", T.StringType()),
    T.StructField("tie", T.StringType()), T.StructField("n_words", T.StringType()), T.StructField("score", T.StringType()),
])


def odd_rows() -> list[tuple]:
    """Nulls everywhere, empty, blank and long texts, ties, copies, near copies and shared passages."""
    rng = random.Random(5)
    vocabulary = ["".join(rng.choices("abcdefghij", k=rng.randint(2, 7))) for _ in range(400)]
    say = lambda n: " ".join(rng.choices(vocabulary, k=n))
    passage, base = say(60), say(120)
    near = base.split()
    texts = [
        None, "", "  \n\t ", "one", "One two\tthree", "one two three four five", "ONE two three four five",
        say(34), say(35), say(200), say(200) + " " + passage, passage + "\n" + say(80), say(10) + " " + passage + " " + say(9),
        base, base, " ".join(near[:60] + ["new"] + near[60:]), " ".join(near[:-8]), " ".join(near[30:]),
        "again " * 100, "again " * 41 + "end", "ab ab cd " * 40, "Ünï çödé — 日本語  x y 😀 " * 12,
        say(30_000), "<|endoftext|> it's we'll 12 !!! <|endoftext|>x", "123 456 --- ...",
    ]
    rows = [(i, t) for i, t in enumerate(texts)]
    rows += [(9, texts[9]), (13, texts[13]), (None, texts[9]), (None, None), (None, say(50)), (50, texts[9]), (50, say(40))]
    return [
        (i, t, None if k % 7 == 0 else "xy"[k % 2], None if k % 3 == 0 else "s", None if t is None else len(t),
         "k", k, None, "x", None, "n", "o", None, "a", "b", None, "w", "z")
        for k, (i, t) in enumerate(rows)
    ]


@pytest.fixture(scope="session")
def odd(spark):
    return spark.createDataFrame(odd_rows(), SCHEMA).repartition(3).cache()


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def documents(spark):
    return spark.read.parquet(f"{TABLES}/documents.parquet")
