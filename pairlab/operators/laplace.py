"""Random-intercept logistic models by Laplace approximation, for any number of groups.

The model frame is dealt by group once, for all models that share its rows, into blocks that each hold whole
groups. From then on a pass is one job without a shuffle of rows: in every block each group's effect is found
by its own Newton search, and the block hands on the sums of the likelihood, its gradient and its curvature alone,
for one point of each model that is still open. A fit takes as many passes as it has Newton steps.

Rows travel to their blocks in packed pieces of columns, not one by one. In a block the groups of several rows
come first; those of one row, whose likelihood depends on two numbers, are summed without vectors of their own.

A group of more than `piece_rows` rows is cut into pieces. Its search needs a pass per step, whose sums over
the pieces are added by Spark; at most rows / `piece_rows` groups can be as large, and only their
effects are held by the driver.
"""

from __future__ import annotations

from collections.abc import Callable, Generator, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from pairlab.operators.spread import ROWS, hot_rows, null_safe_join, per_key
from pairlab.session import cut_lineage

#: Rows that a block of whole groups should hold; small frames are still dealt over the tasks.
BLOCK_ROWS, LEAST_ROWS = 1 << 17, 1 << 12
#: Rows are counted by so many hashes of the group before any group is.
BUCKETS = 1 << 16
#: Rows and bytes that a task packs at once for the blocks, and rows that are evaluated at once.
DEALT_ROWS, DEALT_BYTES, CHUNK_ROWS = 1 << 20, 1 << 26, 1 << 13
#: Columns of 0 and 1 that travel in one whole number.
WORD = 62
#: A search moves an effect, which is standard normal, by at most this much in a step; its last step leaves an
#: error of about the square.
LARGEST_STEP, SETTLED, MOST_STEPS = 2.0, 1e-7, 100
#: Random sd between which the search for the parameters steps in the variance.
LEAST_SD, MOST_SD = 1e-3, 1.0


def piece_rows(spark) -> int:
    return max(1, hot_rows(spark) // 8)


# --- the likelihood -----------------------------------------------------------------------


def row_terms(eta: np.ndarray, y: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, ...]:
    """Log-likelihood of rows, its first derivative in the linear predictor, and the second to fourth, negative."""
    t = np.exp(-np.abs(eta))
    p = np.where(eta >= 0, 1.0, t) / (1.0 + t)
    q = p * (1.0 - p)
    v = w * q
    ll = y * eta - w * (np.maximum(eta, 0.0) + np.log(1.0 + t))
    return ll, y - w * p, v, v * (1.0 - 2.0 * p), v * (1.0 - 6.0 * q)


def _step(s: float, r: np.ndarray, v: np.ndarray, u: np.ndarray) -> np.ndarray:
    return np.clip((s * r - u) / (1.0 + s * s * v), -LARGEST_STEP, LARGEST_STEP)


def search(fixed: np.ndarray, s: float, y: np.ndarray, w: np.ndarray, starts: np.ndarray | None) -> tuple[np.ndarray, bool]:
    """Each group's best effect, and whether all came to rest; without `starts` every row is a group."""
    sizes = None if starts is None else np.diff(np.append(starts, len(y)))
    u = np.zeros(len(y) if starts is None else len(starts))
    for _ in range(MOST_STEPS):
        with np.errstate(over="ignore"):
            p = 1.0 / (1.0 + np.exp(-(fixed + s * (u if starts is None else np.repeat(u, sizes)))))
        wp = w * p
        r, v = y - wp, wp * (1.0 - p)
        if starts is not None:
            r, v = np.add.reduceat(r, starts), np.add.reduceat(v, starts)
        step = _step(s, r, v, u)
        u = u + step
        if np.abs(step).max() < SETTLED:
            return u, True
    return u, False


@dataclass
class Sums:
    """Laplace log-likelihood, its gradient and its curvature in (coefficients, random sd)."""

    value: float
    slope: np.ndarray
    bend: np.ndarray

    @classmethod
    def none(cls, k: int) -> Sums:
        return cls(0.0, np.zeros(k + 1), np.zeros((k + 1, k + 1)))

    def add(self, other: Sums) -> None:
        self.value += other.value
        self.slope += other.slope
        self.bend += other.bend

    def flat(self) -> np.ndarray:
        return np.concatenate([[self.value], self.slope, self.bend.ravel()])

    @classmethod
    def of(cls, flat: np.ndarray, k: int) -> Sums:
        return cls(float(flat[0]), flat[1 : k + 2], flat[k + 2 :].reshape(k + 1, k + 1))


def group_terms(s: float, u: np.ndarray, ll: float, rx: np.ndarray, vx: np.ndarray, dx: np.ndarray, ex: np.ndarray,
                r: np.ndarray) -> tuple[Sums, np.ndarray, np.ndarray]:
    """Sums over groups, from each one's sums of the second to fourth derivatives times the columns (column, group),
    the first being 1. The effects move with the parameters, and so does what is derived here.

    The curvature still lacks, summed over rows, (-v + ke e + kd d) times the products of columns; ke and kd
    of each group are returned.
    """
    v, d, e = vx[0], dx[0], ex[0]
    c = 1.0 + s * s * v
    m = np.vstack([-s * vx, r - s * u * v]) / c  # how the effect moves
    c_a = np.vstack([s * s * dx, 2 * s * v + s * s * u * d])
    c_u, c_uu = s**3 * d, s**4 * e
    c_ua = np.vstack([s**3 * ex, 3 * s * s * d + s**3 * u * e])
    q = (c_a + c_u * m) / c
    slope = np.append(rx, u @ r) - 0.5 * q.sum(1)
    half = 0.5 * (c - 0.5 * c_uu / c + 0.5 * (c_u / c) ** 2) * m - 0.5 * c_ua / c + 0.5 * c_u / c**2 * c_a
    bend = m @ half.T
    bend = bend + bend.T + 0.5 * (q @ q.T)
    mixed = -vx @ u - 0.5 * ((2 * s * dx + s * s * u * ex) / c - c_u / c**2 * (vx + s * u * dx)).sum(1)
    bend[:-1, -1] += mixed
    bend[-1, :-1] += mixed
    bend[-1, -1] += (-u * u * v - 0.5 * ((2 * v + 4 * s * u * d + s * s * u * u * e) / c - c_u / c**2 * (2 * u * v + s * u * u * d))).sum()
    value = ll - 0.5 * (u @ u) - 0.5 * np.log(c).sum()
    return Sums(value, slope, bend), -0.5 * s * s / c, 0.5 * s * c_u / c**2


def several_rows(point: np.ndarray, x: np.ndarray, y: np.ndarray, w: np.ndarray, starts: np.ndarray) -> tuple[Sums, bool]:
    """Sums over groups that begin at `starts`; x is (column, row), the first column being 1."""
    s, fixed = point[-1], point[:-1] @ x
    u, ended = search(fixed, s, y, w, starts)
    sizes = np.diff(np.append(starts, len(y)))
    ll, r, v, d, e = row_terms(fixed + s * np.repeat(u, sizes), y, w)
    vx, dx, ex = (np.add.reduceat(x * k, starts, axis=1) for k in (v, d, e))
    sums, ke, kd = group_terms(s, u, ll.sum(), x @ r, vx, dx, ex, np.add.reduceat(r, starts))
    sums.bend[:-1, :-1] += (x * (np.repeat(ke, sizes) * e + np.repeat(kd, sizes) * d - v)) @ x.T
    return sums, ended


def single_rows(point: np.ndarray, x: np.ndarray, y: np.ndarray, w: np.ndarray) -> tuple[Sums, bool]:
    """`several_rows` where every group is one row: all is a function of its linear predictor and the random sd."""
    s, fixed = point[-1], point[:-1] @ x
    u, ended = search(fixed, s, y, w, None)
    ll, r, v, d, e = row_terms(fixed + s * u, y, w)
    s2, su = s * s, s * u
    i = 1.0 / (1.0 + s2 * v)
    m_x, m_s = -s * v * i, (r - su * v) * i
    c_x, c_s = s2 * d, 2 * s * v + s2 * u * d
    c_u = s * c_x * i
    q_x, q_s = (c_x * i + c_u * m_x), (c_s * i + c_u * m_s)
    h = 0.5 / i - 0.25 * s2 * s2 * e * i + 0.25 * c_u * c_u
    k = 0.5 * c_u * i
    half_x = h * m_x - 0.5 * s2 * s * e * i + k * c_x
    half_s = h * m_s - 0.5 * (3 * s2 * d + s2 * su * e) * i + k * c_s
    xx = 2 * m_x * half_x + 0.5 * q_x * q_x - v - 0.5 * s2 * e * i + k * s * d
    xs = m_x * half_s + half_x * m_s + 0.5 * q_x * q_s - u * v - (s * d + 0.5 * s2 * u * e) * i + k * (v + su * d)
    ss = 2 * (m_s @ half_s) + 0.5 * (q_s @ q_s) - (u * u) @ v - (i * (v + 2 * su * d + 0.5 * su * su * e)).sum() + k @ (2 * u * v + u * su * d)
    out = Sums.none(len(x))
    out.value = ll.sum() - 0.5 * (u @ u) + 0.5 * np.log(i).sum()
    out.slope[:-1], out.slope[-1] = x @ (r - 0.5 * q_x), u @ r - 0.5 * q_s.sum()
    out.bend[:-1, :-1] = (x * xx) @ x.T
    out.bend[:-1, -1] = out.bend[-1, :-1] = x @ xs
    out.bend[-1, -1] = ss
    return out, ended


# --- blocks -------------------------------------------------------------------------------


@dataclass
class Model:
    """The columns of a model by their places in the frame, with means and spreads to level them by.

    `mask` is a column that is missing in rows of which the model knows nothing.
    """

    columns: list[int]
    mask: int | None = None
    mean: np.ndarray = None
    spread: np.ndarray = None

    def __post_init__(self):
        self.mean = np.zeros(len(self.columns)) if self.mean is None else self.mean
        self.spread = np.ones(len(self.columns)) if self.spread is None else self.spread

    @property
    def k(self) -> int:
        return len(self.columns) + 1


@dataclass
class Moments:
    """Of a model's rows: cross-products of 1 and its columns, sum of the response, groups."""

    cross: np.ndarray
    ones: float
    groups: int


def encode(values: np.ndarray) -> tuple[bytes, bytes]:
    """(distinct values, a byte per row) of a column of few values, else (nothing, the column)."""
    values = np.ascontiguousarray(values, dtype=float)
    if len(np.unique(values[:2048])) <= 256:
        distinct, codes = np.unique(values, return_inverse=True)
        if len(distinct) <= 256:
            return distinct.tobytes(), codes.astype(np.uint8).tobytes()
    return b"", values.tobytes()


class Block:
    """Groups of several rows, which begin at `starts`, then `len(y) - several` groups of one."""

    def __init__(self, row: dict):
        self.columns = [(np.frombuffer(a, float), np.frombuffer(b, np.uint8 if a else float)) for a, b in zip(row["distinct"], row["values"])]
        self.starts, self.several, self.rows = np.frombuffer(row["starts"], np.int64), row["several"], row["n"]

    def column(self, i: int, lo: int, hi: int, mean: float = 0.0, spread: float = 1.0) -> np.ndarray:
        distinct, values = self.columns[i]
        return ((distinct - mean) / spread)[values[lo:hi]] if len(distinct) else (values[lo:hi] - mean) / spread

    def chunks(self) -> Iterator[tuple[int, int, np.ndarray | None]]:
        """(first row, end, starts in it) over whole groups, (first row, end, None) over those of one row."""
        first, bounds = 0, np.append(self.starts, self.several)
        while first < len(self.starts):
            last = max(first + 1, int(np.searchsorted(bounds, bounds[first] + CHUNK_ROWS, side="right")) - 1)
            yield int(bounds[first]), int(bounds[last]), self.starts[first:last] - bounds[first]
            first = last
        for lo in range(self.several, self.rows, CHUNK_ROWS):
            yield lo, min(lo + CHUNK_ROWS, self.rows), None

    def part(self, model: Model, lo: int, hi: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """x (column, row), y and w of a model; rows that it does not know count for nothing."""
        x = np.empty((model.k, hi - lo))
        x[0] = 1.0
        for j, (i, mean, spread) in enumerate(zip(model.columns, model.mean, model.spread)):
            x[j + 1] = self.column(i + 2, lo, hi, mean, spread)
        y, w = self.column(0, lo, hi), self.column(1, lo, hi)
        unknown = np.isnan(x.sum(0))
        if model.mask is not None:
            unknown |= np.isnan(self.column(model.mask + 2, lo, hi))
        if unknown.any():
            x, y, w = np.where(unknown, 0.0, x), np.where(unknown, 0.0, y), np.where(unknown, 0.0, w)
        return x, y, w


def _blocks(source: Iterator[pa.RecordBatch]) -> Iterator[Block]:
    for found in source:
        body = found.select(list(_BODY))
        for k in range(found.num_rows):
            yield Block(body.slice(k, 1).to_pylist()[0])


_BODY = ("n", "several", "starts", "distinct", "values")


class Blocks:
    """A frame (_g, y, x0.., f0..) dealt by group, and passes over it for all models of its columns.

    `w` counts rows; without it every row is one. A bit of f0.. is a column of 0 and 1 behind x0.., as a row costs as
    much time per value that leaves the JVM whatever its size; `flags` says which of them are masks, NaN instead of 0.
    """

    def __init__(self, frame: DataFrame, flags: Sequence[bool] = ()):
        self.spark, self.passes = frame.sparkSession, 0
        self.kind = frame.schema["_g"].dataType
        limit = piece_rows(self.spark)
        columns = frame.columns
        bucket = F.pmod(F.xxhash64("_g"), F.lit(BUCKETS)).alias("_bucket")
        counted = per_key(frame.select(bucket), ["_bucket"])
        largest, total = counted.agg(F.max(ROWS), F.sum(ROWS)).first()
        total = total or 0
        tasks = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        blocks = max(1, -(-total // BLOCK_ROWS), min(tasks, -(-total // LEAST_ROWS)))
        dealt = F.pmod(F.xxhash64("_g"), F.lit(blocks))
        # only a bucket of more rows can hold a group of more rows
        self.large, self.first, found = [], np.array([], np.int64), []
        if (largest or 0) > limit:
            full = counted.filter(F.col(ROWS) > limit).drop(ROWS)
            keys = null_safe_join(frame.select("_g", bucket), F.broadcast(full), ["_bucket"], "left_semi")
            found = per_key(keys, ["_g"]).filter(F.col(ROWS) > limit).collect()  # at most rows / piece_rows
        if found:
            pieces = [-(-r[ROWS] // limit) for r in found]
            first = blocks + np.cumsum([0, *pieces[:-1]])
            self.large, self.first = [r["_g"] for r in found], first
            schema = T.StructType([T.StructField("_g", self.kind), T.StructField("_first", T.LongType()), T.StructField("_pieces", T.LongType())])
            hot = self.spark.createDataFrame([(g, int(f), p) for g, f, p in zip(self.large, first, pieces)], schema)
            spread = F.pmod(F.xxhash64(*frame.columns) + F.spark_partition_id(), F.col("_pieces"))
            frame = null_safe_join(frame, F.broadcast(hot), ["_g"], "left")
            dealt = F.coalesce(F.col("_first") + spread, dealt)
        self.whole = blocks  # blocks from here on are pieces
        self.table = cut_lineage(self._dealt(frame.select(dealt.cast("long").alias("_block"), *columns), flags))

    def _dealt(self, frame: DataFrame, flags: Sequence[bool]) -> DataFrame:
        sent = to_arrow_schema(T.StructType([T.StructField("_block", T.LongType()), T.StructField("_rows", T.BinaryType())]))
        schema = T.StructType([
            T.StructField("block", T.LongType()), T.StructField("n", T.LongType()), T.StructField("several", T.LongType()),
            T.StructField("starts", T.BinaryType()), T.StructField("keys", T.ArrayType(self.kind)),
            T.StructField("distinct", T.ArrayType(T.BinaryType())), T.StructField("values", T.ArrayType(T.BinaryType())),
        ])
        arrow, most_rows, most_bytes = to_arrow_schema(schema), DEALT_ROWS, DEALT_BYTES

        def parcels(held: list[pa.RecordBatch]) -> pa.RecordBatch:
            table = pa.Table.from_batches(held)
            block = table.column("_block").to_numpy()
            order = np.argsort(block, kind="stable")
            block, rest = block[order], table.drop_columns(["_block"]).take(pa.array(order)).combine_chunks()
            at = np.flatnonzero(np.diff(block, prepend=-1))
            packed = []
            for lo, hi in zip(at, np.append(at[1:], len(block))):
                sink = pa.BufferOutputStream()
                with pa.ipc.new_stream(sink, rest.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
                    out.write_table(rest.slice(lo, hi - lo))
                packed.append(sink.getvalue().to_pybytes())
            return pa.RecordBatch.from_arrays([pa.array(block[at]), pa.array(packed, pa.binary())], schema=sent)

        def split(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held, rows, size = [], 0, 0
            for found in source:
                held, rows, size = [*held, found], rows + found.num_rows, size + found.nbytes
                if rows >= most_rows or size >= most_bytes:
                    yield parcels(held)
                    held, rows, size = [], 0, 0
            if rows:
                yield parcels(held)

        def pack(table: pa.Table) -> pa.Table:
            block = table.column("_block")[0].as_py()
            rows = pa.concat_tables([pa.ipc.open_stream(b.as_buffer()).read_all() for b in table.column("_rows")])
            keys = rows.column("_g").combine_chunks().dictionary_encode()
            code = np.asarray(keys.indices)
            many = np.bincount(code)[code] > 1
            order = np.argsort(np.where(many, code, len(code)), kind="stable")
            code, several = code[order], int(many.sum())
            starts = np.flatnonzero(np.diff(code[:several], prepend=-1)).astype(np.int64)
            values = {c: rows.column(c).to_numpy()[order] for c in rows.column_names if c != "_g"}
            columns = [encode(values["y"]), encode(values["w"] if "w" in values else np.ones(len(code)))]
            columns += [encode(v) for c, v in values.items() if c[0] == "x"]
            for i, mask in enumerate(flags):
                bits = (values[f"f{i // WORD}"] >> (i % WORD)) & 1
                columns.append((np.array([np.nan if mask else 0.0, 1.0]).tobytes(), bits.astype(np.uint8).tobytes()))
            of = keys.dictionary.take(pa.array(code[np.append(starts, np.arange(several, len(code)))]))
            body = [[block], [len(code)], [several], [starts.tobytes()], None, [[a for a, _ in columns]], [[b for _, b in columns]]]
            arrays = [pa.array(b, f.type) if b else pa.ListArray.from_arrays(pa.array([0, len(of)], pa.int32()), of).cast(f.type)
                      for b, f in zip(body, arrow)]
            return pa.Table.from_arrays(arrays, schema=arrow)

        return frame.mapInArrow(split, T.StructType([T.StructField("_block", T.LongType()), T.StructField("_rows", T.BinaryType())])) \
            .groupBy("_block").applyInArrow(pack, schema)

    def moments(self, models: Sequence[Model]) -> list[Moments]:
        """Of each model's rows, in a pass."""
        sizes, first, n = [m.k**2 + 2 for m in models], self.first, len(self.large)

        def sums(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total, pieces = [np.zeros(size) for size in sizes], np.zeros((len(models), n))
            for found in source:
                for number, block in zip(found.column("block").to_pylist(), _blocks([found])):
                    g = int(np.searchsorted(first, number, side="right")) - 1
                    for lo, hi, starts in block.chunks():
                        for j, model in enumerate(models):
                            x, y, w = block.part(model, lo, hi)
                            groups = (w if starts is None else np.add.reduceat(w, starts)) > 0
                            total[j] += np.concatenate([((x * w) @ x.T).ravel(), [y.sum(), groups.sum() if g < 0 else 0.0]])
                            if g >= 0:
                                pieces[j, g] += w.sum()
            yield _cells(np.concatenate([*total, pieces.ravel()]))

        got = _added(self.table.select("block", *_BODY).mapInArrow(sums, "cell long, value double"), sum(sizes) + len(models) * n)
        *cells, pieces = np.split(got, np.cumsum(sizes))
        return [Moments(a[:-2].reshape(m.k, m.k), a[-2], int(a[-1] + (own > 0).sum()))
                for a, m, own in zip(cells, models, pieces.reshape(len(models), n))]

    def _part(self, large: bool, *names: str) -> DataFrame:
        rows = self.table
        if self.large:
            rows = rows.filter(F.col("block") >= self.whole if large else F.col("block") < self.whole)
        return rows.select(*names, *_BODY)

    def evaluate(self, models: Sequence[Model], points: Sequence[np.ndarray]) -> tuple[list[Sums], list[bool]]:
        """Of each model at its point: the sums, and whether every group's effect was found."""
        sizes = [1 + (m.k + 1) + (m.k + 1) ** 2 + 1 for m in models]

        def sums(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total, rest = [Sums.none(m.k) for m in models], np.zeros(len(models))
            for block in _blocks(source):
                for lo, hi, starts in block.chunks():
                    for j, (model, point) in enumerate(zip(models, points)):
                        part = block.part(model, lo, hi)
                        own, ended = single_rows(point, *part) if starts is None else several_rows(point, *part, starts)
                        total[j].add(own)
                        rest[j] += not ended
            yield _cells(np.concatenate([np.append(t.flat(), r) for t, r in zip(total, rest)]))

        self.passes += 1
        got = _added(self._part(False).mapInArrow(sums, "cell long, value double"), sum(sizes))
        flat = np.split(got, np.cumsum(sizes)[:-1])
        out, settled = [Sums.of(a[:-1], m.k) for a, m in zip(flat, models)], [a[-1] == 0 for a in flat]
        if self.large:
            u, found = self._search_large(models, points)
            for j, own in enumerate(self._large_terms(models, points, u)):
                out[j].add(own)
                settled[j] &= found[j]
        return out, settled

    def _over_pieces(self, cells: int, of) -> np.ndarray:
        """(group in pieces, cell): what `of(block, group)` gives, added over the pieces."""
        first, n = self.first, len(self.large)

        def sums(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for found in source:
                for number, block in zip(found.column("block").to_pylist(), _blocks([found])):
                    g = int(np.searchsorted(first, number, side="right")) - 1
                    yield _cells(sum(of(block, g, lo, min(lo + CHUNK_ROWS, block.rows)) for lo in range(0, block.rows, CHUNK_ROWS)), g * cells)

        self.passes += 1
        return _added(self._part(True, "block").mapInArrow(sums, "cell long, value double"), n * cells).reshape(n, cells)

    def _search_large(self, models: Sequence[Model], points: Sequence[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """Effects of groups in pieces (model, group), and whether each model's came to rest; a pass per step."""
        u, s = np.zeros((len(models), len(self.large))), np.array([p[-1] for p in points])[:, None]

        def slopes(block: Block, g: int, lo: int, hi: int) -> np.ndarray:
            out = []
            for j, (model, point) in enumerate(zip(models, points)):
                x, y, w = block.part(model, lo, hi)
                _, r, v, _, _ = row_terms(point[:-1] @ x + point[-1] * u[j, g], y, w)
                out += [r.sum(), v.sum()]
            return np.array(out)

        for _ in range(MOST_STEPS):
            at = self._over_pieces(2 * len(models), slopes)
            step = _step(s, at[:, 0::2].T, at[:, 1::2].T, u)
            u = u + step
            if np.abs(step).max() < SETTLED:
                break
        return u, np.abs(step).max(1) < SETTLED

    def _large_terms(self, models: Sequence[Model], points: Sequence[np.ndarray], u: np.ndarray) -> list[Sums]:
        sizes = [1 + 4 * m.k + 3 * m.k**2 for m in models]

        def sums(block: Block, g: int, lo: int, hi: int) -> np.ndarray:
            out = []
            for j, (model, point) in enumerate(zip(models, points)):
                x, y, w = block.part(model, lo, hi)
                ll, *slopes = row_terms(point[:-1] @ x + point[-1] * u[j, g], y, w)
                out += [[ll.sum()], *(x @ a for a in slopes), *(((x * a) @ x.T).ravel() for a in slopes[1:])]
            return np.concatenate(out)

        out = []
        for model, point, own, at in zip(models, points, u, np.split(self._over_pieces(sum(sizes), sums), np.cumsum(sizes)[:-1], axis=1)):
            k = model.k
            rx, vx, dx, ex = np.split(at[:, 1 : 1 + 4 * k].T, 4)
            vxx, dxx, exx = np.split(at[:, 1 + 4 * k :].T, 3)
            found, ke, kd = group_terms(point[-1], own, at[:, 0].sum(), rx.sum(1), vx, dx, ex, rx[0])
            found.bend[:-1, :-1] += (exx @ ke + dxx @ kd - vxx.sum(1)).reshape(k, k)
            out.append(found)
        return out

    def effects(self, models: Sequence[Model], points: Sequence[np.ndarray]) -> list[DataFrame]:
        """(_g, effect) of each model on the link scale, for every group of its rows; written together, never collected."""
        names = [f"e{j}" for j in range(len(models))]
        schema = T.StructType([T.StructField("_g", self.kind), *(T.StructField(c, T.DoubleType()) for c in names)])
        arrow = to_arrow_schema(schema)

        def solve(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for found in source:
                for number, block in enumerate(_blocks([found])):
                    effects = [[] for _ in models]
                    for lo, hi, starts in block.chunks():
                        for own, model, point in zip(effects, models, points):
                            x, y, w = block.part(model, lo, hi)
                            u, _ = search(point[:-1] @ x, point[-1], y, w, starts)
                            known = (w if starts is None else np.add.reduceat(w, starts)) > 0
                            own.append(np.where(known, u * point[-1], np.nan))
                    keys = found.column("keys").slice(number, 1).flatten().cast(arrow.field(0).type)
                    yield pa.RecordBatch.from_arrays([keys, *(pa.array(np.concatenate(e), from_pandas=True) for e in effects)], schema=arrow)

        out = cut_lineage(self._part(False, "keys").mapInArrow(solve, schema))
        if self.large:
            u, _ = self._search_large(models, points)
            rows = [(g, *(float(e) for e in own)) for g, own in zip(self.large, (u * [[p[-1]] for p in points]).T)]
            out = out.unionByName(self.spark.createDataFrame(rows, schema))
        return [out.select("_g", F.col(c).alias("effect")).filter("effect IS NOT NULL") for c in names]


def _cells(values: np.ndarray, first: int = 0) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.arange(first, first + len(values), dtype=np.int64)), pa.array(values)], names=["cell", "value"])


def _added(df: DataFrame, cells: int) -> np.ndarray:
    out = np.zeros(cells)
    for cell, value in df.groupBy("cell").agg(F.sum("value").alias("value")).collect():
        out[cell] = value
    return out


# --- the search for the parameters --------------------------------------------------------


@dataclass
class Reached:
    """Where a search ended: the point, the sums there, whether it is the maximum, rounds, passes."""

    point: np.ndarray
    sums: Sums
    converged: bool
    rounds: int
    passes: int = 0


def newton(at: np.ndarray, here: Sums, scale: np.ndarray) -> Callable[[float], np.ndarray]:
    """The Newton step from a point, as the points that parts of it lead to.

    The likelihood is even in the random sd. Near 0 it is close to a parabola in the variance, in
    which steps between `LEAST_SD` and `MOST_SD` are taken: those in the sd would only cut it by a third each.
    """
    sd, slope, bend, turned = at[-1], here.slope, here.bend, np.ones(len(at))
    in_variance = LEAST_SD < sd < MOST_SD
    if in_variance:
        turned[-1] = 0.5 / sd
        bend = bend * np.outer(turned, turned)
        bend[-1, -1] -= slope[-1] / (4 * sd**3)
        slope = slope * turned
    unit = scale / turned
    values, vectors = np.linalg.eigh(-bend * np.outer(unit, unit))
    floor = np.maximum(np.abs(values), 1e-6 * np.abs(values).max())
    step = unit * (vectors @ ((vectors.T @ (slope * unit)) / floor))
    if sd == 0 and bend[-1, -1] > 0:
        step[-1] = 0.1  # no maximum: the slope is 0 here in any case
    if in_variance:
        step *= min(1.0, (2 * sd + 1) / max(step[-1], 1e-300))  # the random sd moves by 1 at most
    else:
        step *= min(1.0, 1.0 / max(abs(step[-1]), 1e-300))

    def reached(part: float) -> np.ndarray:
        if in_variance:
            return np.append(at[:-1] + part * step[:-1], np.sqrt(max(sd * sd + part * step[-1], 0.0)))
        return at + part * step

    return reached


def climb(start: np.ndarray, scale: np.ndarray, rounds: int) -> Generator[np.ndarray, Sums, Reached]:
    """Newton steps from `start`; yields points and is sent the sums there."""
    at = start
    here = yield at
    for turn in range(1, rounds + 1):
        to = newton(at, here, scale)
        done = np.abs((to(1.0) - at) / scale).max() < 1e-3
        for part in (1.0, 0.25, 0.05):
            better = yield to(part)
            if done or better.value >= here.value:
                break
        else:
            return Reached(at, here, bool(np.abs(here.slope * scale).max() < 1e-3), turn)
        at, here = to(part), better
        if done:
            return Reached(at, here, True, turn)
        if not np.isfinite(here.value) or here.value > -1e-3:  # a perfect fit: coefficients run off to infinity
            break
    return Reached(at, here, False, turn)


def maximise(blocks: Blocks, models: Sequence[Model], starts: Sequence[np.ndarray], scales: Sequence[np.ndarray], rounds: int) -> list[Reached]:
    """The maxima of several models; every pass serves those that are not there yet."""
    searches = [climb(a, b, rounds) for a, b in zip(starts, scales)]
    asked = {j: next(c) for j, c in enumerate(searches)}
    out, settled, passes = {}, [False] * len(models), [0] * len(models)
    while asked:
        open_, before = list(asked), blocks.passes
        found, rest = blocks.evaluate([models[j] for j in open_], [asked[j] for j in open_])
        for j, sums, ended in zip(open_, found, rest):
            settled[j] = ended
            passes[j] += blocks.passes - before
            try:
                asked[j] = searches[j].send(sums)
            except StopIteration as end:
                out[j] = end.value
                del asked[j]
    for j, reached in out.items():
        reached.passes = passes[j]
        reached.converged = reached.converged and settled[j]
    return [out[j] for j in range(len(models))]
