"""Language of whole texts by a byte convolutional network, trained in numpy on labelled text.

The network reads fixed windows of bytes. Filters of several widths run over a window, each filter's
largest response is kept, and a softmax over the languages follows. A filter over one-hot bytes is
a table with a row for each byte and place, so a convolution is a sum of table rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pairlab.llm.common import batches_of, forget, strings

UNKNOWN = "und"


class ByteNet:
    """Languages, one table (width, 256, filters) per width, and the dense layer."""

    def __init__(self, languages: list[str], widths: tuple[int, ...], filters: int, window: int, seed: int) -> None:
        rng = np.random.default_rng(seed)
        self.languages, self.window = languages, window
        self.tables = [rng.normal(0, 0.1, (w, 256, filters)).astype(np.float32) for w in widths]
        self.dense = rng.normal(0, 0.1, (len(widths) * filters, len(languages))).astype(np.float32)
        self.bias = np.zeros(len(languages), np.float32)

    def _responses(self, columns: np.ndarray, table: np.ndarray) -> np.ndarray:
        """(positions, windows, filters) for bytes given as (place in the window, window)."""
        n = len(columns) - len(table) + 1
        out = table[0][columns[:n]]
        for j in range(1, len(table)):
            out += table[j][columns[j : n + j]]
        return out

    def probabilities(self, windows: np.ndarray, batch: int = 64) -> np.ndarray:
        out = np.empty((len(windows), len(self.languages)))
        for at in range(0, len(windows), batch):
            columns = np.ascontiguousarray(windows[at : at + batch].T)
            pooled = np.concatenate([self._responses(columns, t).max(0) for t in self.tables], 1)
            out[at : at + batch] = _softmax(np.maximum(pooled, 0) @ self.dense + self.bias)
        return out

    def fit(self, windows: np.ndarray, labels: np.ndarray, epochs: int, batch: int, rate: float, seed: int) -> None:
        """Adam on the cross entropy, languages weighted alike."""
        rng = np.random.default_rng(seed)
        counts = np.bincount(labels, minlength=len(self.languages))
        weight = (len(labels) / np.maximum(counts, 1) / max(1, np.count_nonzero(counts)))[labels].astype(np.float32)
        params = [*self.tables, self.dense, self.bias]
        first, second = ([np.zeros_like(p) for p in params] for _ in range(2))
        turn = 0
        for _ in range(epochs):
            order = rng.permutation(len(labels))
            for some in np.split(order, range(batch, len(order), batch)):
                columns = np.ascontiguousarray(windows[some].T)
                best, pooled = [], []
                for t in self.tables:
                    r = self._responses(columns, t)
                    best.append(r.argmax(0))
                    pooled.append(np.take_along_axis(r, best[-1][None], 0)[0])
                flat = np.concatenate(pooled, 1)
                hidden = np.maximum(flat, 0)
                error = _softmax(hidden @ self.dense + self.bias)
                error[np.arange(len(some)), labels[some]] -= 1
                error = (error * weight[some, None] / len(some)).astype(np.float32)
                back = (error @ self.dense.T) * (flat > 0)
                grads, at = [], 0
                for t, where in zip(self.tables, best):
                    f = t.shape[2]
                    grad = np.zeros_like(t)
                    here = back[:, at : at + f]
                    at += f
                    column, unit = np.indices(where.shape)
                    for j in range(len(t)):  # only the largest response passes a gradient on
                        np.add.at(grad[j], (columns[where + j, column], unit), here)
                    grads.append(grad)
                grads += [hidden.T @ error, error.sum(0)]
                turn += 1
                for p, g, m, v in zip(params, grads, first, second):
                    m += 0.1 * (g - m)
                    v += 0.001 * (g * g - v)
                    p -= rate * (m / (1 - 0.9**turn)) / (np.sqrt(v / (1 - 0.999**turn)) + 1e-8)


def _softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def windows_of(body: bytes, size: int) -> tuple[np.ndarray, np.ndarray]:
    """A text's bytes as rows of `size`, the last filled up with zeros, and the bytes in each."""
    n = -(-len(body) // size)
    out = np.zeros(n * size, np.uint8)
    out[: len(body)] = np.frombuffer(body, np.uint8)
    held = np.full(n, size)
    if n:
        held[-1] = len(body) - (n - 1) * size
    return out.reshape(n, size), held


def learn(
    labelled: DataFrame, text: str, label: str, order: Column, per_language: int = 800, most_languages: int = 256,
    widths: tuple[int, ...] = (2, 3, 4), filters: int = 12, window: int = 192, per_text: int = 6, epochs: int = 4,
    seed: int = 17,
) -> ByteNet | None:
    """A network from at most `per_language` labelled texts of each language.

    Languages are counted first; then texts are drawn by the hash `order` with a share that leaves
    few spares, so about `per_language` texts per language reach the driver, however large the
    table. Of labels beyond `most_languages` the most frequent are learned. Rows without
    text or label teach nothing; without any labelled text there is no network (None).
    `per_text` windows per text, cut short at random now and then, make the training set.
    """
    counts = dict(
        labelled.filter(F.col(label).isNotNull()).groupBy(label).count()
        .orderBy(F.desc("count"), label).limit(most_languages).collect()
    )
    if not counts:
        return None
    spare = lambda n: min(1.0, 1.25 * per_language / n + 20 / n)
    share = F.lit(0.0)
    for language, n in counts.items():
        share = F.when(F.col(label) == language, F.lit(spare(n))).otherwise(share)
    place = F.shiftrightunsigned(F.xxhash64(order, F.lit(seed)), 11) * F.lit(2.0**-53)
    rows = (
        labelled.filter(F.col(label).isNotNull() & F.col(text).isNotNull() & (place < share))
        .select(F.col(label).alias("l"), F.encode(F.col(text), "UTF-8").alias("t"), place.alias("p")).collect()
    )
    texts: dict[str, list[bytes]] = {}
    for row in sorted(rows, key=lambda r: (r["p"], bytes(r["t"]))):
        texts.setdefault(row["l"], []).append(bytes(row["t"]))
    languages = sorted(k for k, v in texts.items() if any(v[:per_language]))
    if not languages:
        return None
    rng = np.random.default_rng(seed)
    found, labels = [], []
    for number, language in enumerate(languages):
        for body in texts[language][:per_language]:
            for turn in range(per_text if len(body) > window else 2):
                at = int(rng.integers(0, max(1, len(body) - window + 1)))
                piece = body[at : at + window]
                if turn % 3 == 2:  # short texts come too
                    piece = piece[: int(rng.integers(8, window))]
                if piece:
                    found.append(windows_of(piece.ljust(window, b"\0"), window)[0][0])
                    labels.append(number)
    net = ByteNet(languages, widths, filters, window, seed)
    net.fit(np.stack(found), np.array(labels), epochs, 64, 0.01, seed)
    return net


def identify(df: DataFrame, key: str, text: str, net: ByteNet | None, keep_text: bool = False) -> DataFrame:
    """key, lang_pred and score of every whole text, and the text itself on demand.

    All of a text's windows are read; the score is the mean probability of the predicted language,
    windows weighted by their bytes, ties to the first language in order. Texts that are null or
    hold no letter are `und` with score 0, and so are all without a network. Other columns are not
    read; keys may be null or repeat; no rows give no rows.
    """
    kind = df.schema[key].dataType
    shared = df.sparkSession.sparkContext.broadcast(net)

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        net = shared.value
        for found in source:
            rows = zip(found.column(0).to_pylist(), strings(found, "text"))
            for part in batches_of(rows, 1, 1 << 20, 1024):
                pred, score = [UNKNOWN] * len(part), [0.0] * len(part)
                bodies = [
                    (i, windows_of(t.encode(), net.window)) for i, (_, t) in enumerate(part)
                    if net is not None and t and any(map(str.isalpha, t))
                ]
                if bodies:
                    # Equal windows of a batch are read once.
                    rows_ = np.concatenate([w for _, (w, _) in bodies])
                    kept, back = _distinct(rows_)
                    p = net.probabilities(kept)[back] * np.concatenate([h for _, (_, h) in bodies])[:, None]
                    starts = np.cumsum([0] + [len(w) for _, (w, _) in bodies])[:-1]
                    total = np.add.reduceat(p, starts)
                    total /= total.sum(1, keepdims=True)
                    for (i, _), own in zip(bodies, total):
                        best = int(own.argmax())
                        pred[i], score[i] = net.languages[best], min(1.0, float(own[best]))
                yield pa.RecordBatch.from_arrays([
                    pa.array([k for k, _ in part], found.schema.field(0).type),
                    pa.array(pred), pa.array(score, pa.float64()),
                    *([pa.array([t for _, t in part], pa.string())] if keep_text else []),
                ], names=schema.names)

    rows = df.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"))
    schema = T.StructType([
        T.StructField("key", kind), T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()),
        *([T.StructField("text", T.StringType())] if keep_text else []),
    ])
    return rows.mapInArrow(run, schema).withColumnRenamed("key", key)


def _distinct(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    whole = np.ascontiguousarray(rows).view(np.dtype((np.void, rows.shape[1]))).ravel()
    _, at, back = np.unique(whole, return_index=True, return_inverse=True)
    return rows[at], back


def held_out(key: Column, folds: int = 5) -> Column:
    """Whether crc32 of the key as text leaves remainder 0. A null key is held out: nothing learns from it."""
    return F.coalesce(F.crc32(key.cast("string")) % folds == 0, F.lit(True))


def identify_documents(df: DataFrame, key: str, text: str, label: str, **options) -> DataFrame:
    """Learn from the labelled rows that are not held out, then predict all rows, with `held_out`."""
    own = df.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"), F.col(label).cast("string").alias("label"))
    net = learn(own.filter(~held_out(F.col("key"))), "text", "label", F.col("key"), **options)
    return identify(own, "key", "text", net).select(
        F.col("key").alias(key), held_out(F.col("key")).alias("held_out"), "lang_pred", "score"
    )
