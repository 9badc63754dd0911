"""Similarity join of word shingles by filters under several global token orders.

Two sets with Jaccard similarity t or more share, under any order of the tokens that is the same for
all sets, one of the first |x| - ceil(t |x|) + 1 tokens. A pair is verified only if that holds under
each of several orders.

1. Documents become chunks of word codes. Shingles (64-bit hashes) meet in buckets and come back with
   their document frequency; set hashes meet too, and of equal sets one document stands for its class.
2. Under the order "rare first", each class sends its prefix tokens that occur elsewhere. Classes that
   share one are tied to the token's first class, which is linear in the list's length; connected
   ties are a family, and linked documents are always of one family.
3. A family's sets come together, each moved once; a family too large for a task is cut into
   blocks, and every two blocks meet in a task. There, candidates are looked up under each
   order in an index of prefix tokens, the candidates under all orders are intersected, and the
   rest is verified exactly, unless both documents are connected already.
4. Components of the links, and the smallest key of each.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pairlab.llm import meeting
from pairlab.llm.common import forget, settle, slices, tasks
from pairlab.llm.graph import components
from pairlab.llm.recompression import chunked, mix

TOKEN, SET, POSTING = 0, 1, 2  # kinds of keys
POSITIONS = 1 << 20  # documents a chunk may hold, at most


def shingle_sets(codes: np.ndarray, counts: list[int], digest: np.ndarray, width: int) -> list[np.ndarray]:
    """Per document the distinct shingles, ascending; a document of fewer words is one shingle."""
    h = digest[codes]
    n = max(0, len(codes) - width + 1)
    rolled = np.zeros(n, np.uint64)
    for k in range(width):
        rolled = mix(rolled, h[k : k + n]) if n else rolled
    ends, out = slices(None, counts), []
    for a, b in zip(ends[:-1].tolist(), ends[1:].tolist()):
        if b - a >= width:
            out.append(np.unique(rolled[a : b - width + 1]))
        elif b > a:
            few = hashlib.blake2b(h[a:b].tobytes(), digest_size=8, person=b"few").digest()
            out.append(np.frombuffer(few, np.uint64))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


class Chunk:
    """Some documents as shingle sets, and what they send."""

    def __init__(self, row: dict, width: int) -> None:
        forget()
        self.id, self.keys = row["chunk"], row["keys"]
        words = row["vocabulary"].split(b" ")
        digest = np.frombuffer(b"".join(hashlib.blake2b(w, digest_size=8).digest() for w in words), np.uint64)
        self.sets = shingle_sets(np.frombuffer(row["codes"], np.int32), row["counts"], digest, width)
        self.tokens = np.concatenate([*self.sets, np.zeros(0, np.uint64)])
        at, self.number, self.counts = meeting.unique(self.tokens)
        self.distinct = self.tokens[at]
        halves = np.frombuffer(b"".join(hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in self.sets), np.uint64)
        self.names = halves[::2].copy(), halves[1::2].copy()
        self.name_at, self.name_number, self.name_counts = meeting.unique(*self.names)

    def nodes(self) -> np.ndarray:
        return self.id * POSITIONS + np.arange(len(self.sets))

    def ask(self, buckets: int) -> Iterator[tuple]:
        yield from meeting.send(self.id, TOKEN, buckets, self.distinct, None, np.minimum(self.counts, 255), short=True)
        first, second = (x[self.name_at] for x in self.names)
        yield from meeting.send(self.id, SET, buckets, first, second, np.minimum(self.name_counts, 2))

    def prefixes(self, frequency: np.ndarray, owner: np.ndarray, at_least: tuple[int, int]) -> Iterator[tuple[int, np.ndarray]]:
        """For each class that this chunk stands for, its prefix tokens that occur elsewhere too."""
        often = frequency[self.number]
        ends = slices(None, [len(s) for s in self.sets])
        stands = np.zeros(len(self.sets), bool)
        stands[self.name_at[owner > 0]] = True  # a set's first document in the chunk
        for i, s in enumerate(self.sets):
            if not stands[i] or not len(s):
                continue
            df = often[ends[i] : ends[i + 1]]
            length = prefix_length(len(s), at_least)
            rare = np.count_nonzero(df < 2)
            if rare >= length:
                continue
            order = np.lexsort((mix(s, 1), df))[rare:length]
            yield i, s[order]


def prefix_length(size: int, at_least: tuple[int, int]) -> int:
    part, whole = at_least
    return size - -(-part * size // whole) + 1


def _frequency(number: np.ndarray, distinct: int, note: np.ndarray, place: np.ndarray) -> np.ndarray:
    """In how many documents the token is, 255 for more: any order that is the same for all will do."""
    return np.minimum(np.bincount(number, note, distinct), 255)[number]


def _first_chunk(number: np.ndarray, distinct: int, note: np.ndarray, place: np.ndarray) -> np.ndarray:
    owner = np.full(distinct, len(place) + 1, np.int64)
    np.minimum.at(owner, number, place)
    return owner[number] == place


class Union:
    """Disjoint sets, joined by size; what is looked up points to its root afterwards."""

    def __init__(self, n: int) -> None:
        self.up, self.size = np.arange(n), np.ones(n, np.int64)

    def find(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = i = self.up[self.up[i]]
        return int(i)

    def roots(self, items: np.ndarray) -> np.ndarray:
        r = self.up[items]
        while (self.up[r] != r).any():
            r = self.up[r]
        self.up[items] = r
        return r

    def join(self, i: int, j: int) -> None:
        i, j = self.find(i), self.find(j)
        if i != j:
            few, many = sorted((i, j), key=lambda k: self.size[k])
            self.up[few] = many
            self.size[many] += self.size[few]


def links_within(
    sets: list[np.ndarray], side: np.ndarray, at_least: tuple[int, int], orders: int = 3
) -> list[tuple[int, int]]:
    """Links that connect what is connected among `sets`.

    `side` 0 compares all, else only sets of different sides (1 and 2) are compared. Pairs
    of one component need no verification. Orders: rare first in these sets, and random ones.
    """
    part, whole = at_least
    by_size = np.argsort([len(s) for s in sets], kind="stable")
    size = np.array([len(sets[i]) for i in by_size])
    flat = np.concatenate([sets[i] for i in by_size])
    at, token, counts = meeting.unique(flat)
    ends = slices(None, size)
    ranks = [np.argsort(np.lexsort((mix(flat[at], 1), counts)))]
    ranks += [np.argsort(np.argsort(mix(flat[at], 11 + k))) for k in range(orders - 1)]
    starts, members, prefix = [], [], []
    for rank in ranks:
        own = []
        for i, n in enumerate(size.tolist()):
            t = token[ends[i] : ends[i + 1]]
            p = prefix_length(n, at_least)
            own.append(t[np.argpartition(rank[t], p - 1)[:p]] if p < n else t)
        lengths = [len(p) for p in own]
        all_ = np.concatenate(own)
        order = np.argsort(all_, kind="stable")
        prefix.append(own)
        members.append(np.repeat(np.arange(len(sets)), lengths)[order])  # per token, by size
        starts.append(np.searchsorted(all_[order], np.arange(len(counts) + 1)))
    seen = np.zeros(len(counts), bool)
    found, groups = [], Union(len(sets))
    side = side[by_size]
    for x in range(len(sets)):
        low = int(np.searchsorted(size, -(-part * size[x] // whole)))
        if low >= x:
            continue
        hits = None
        for own, start, member in zip(prefix, starts, members):
            mask = np.zeros(x - low, bool)
            for t in own[x].tolist():
                them = member[start[t] : start[t + 1]]
                a, b = np.searchsorted(them, (low, x))
                mask[them[a:b] - low] = True
            hits = mask if hits is None else hits & mask
            if not hits.any():
                break
        rest = np.flatnonzero(hits) + low
        rest = rest[(side[rest] != side[x]) | (side[x] == 0)]
        rest = rest[groups.roots(rest) != groups.find(x)][::-1]
        mine = token[ends[x] : ends[x + 1]]
        seen[mine] = True
        while len(rest):
            y, rest = int(rest[0]), rest[1:]
            both = int(np.count_nonzero(seen[token[ends[y] : ends[y + 1]]]))
            if whole * both >= part * (size[x] + size[y] - both):
                found.append((int(by_size[y]), int(by_size[x])))
                groups.join(y, x)
                rest = rest[groups.roots(rest) != groups.find(x)]
        seen[mine] = False
    return found


def near_duplicates(
    df: DataFrame, key: str, text: str, width: int = 5, at_least: tuple[int, int] = (75, 100),
    chunk_size: int = 1 << 22, block: int = 1 << 22, members: int = 1 << 10,
) -> DataFrame:
    """key, n_shingles, component_id and stays of every document.

    A document's set are its distinct runs of `width` words (ASCII letters in lower case; words are
    what stands between ASCII white space), or its whole word sequence if it has fewer. Two
    documents link when the sets' intersection is at least `at_least` of their union.
    `component_id` is the smallest key that links reach, the own one included; `stays` marks one
    document of each component, the one with that key. A document without words, or null,
    links with nothing. Null keys are no smallest key unless a component has no other. Equal rows
    link like any others, and one of them stays. No rows give no rows; other columns are not read.

    A family is cut into blocks of about `block` shingles or `members` documents, whichever is less: a
    task compares two of them at once.
    """
    buckets = tasks(df)
    chunks = chunked(df, key, text, chunk_size, lower=True).repartition(buckets, "chunk")
    kind = chunks.schema["keys"].dataType.elementType

    def ask(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for found in source:
            for row in range(len(found)):
                yield meeting.sent_batch(list(Chunk(found.slice(row, 1).to_pylist()[0], width).ask(buckets)))

    said = meeting.meet(
        chunks.mapInArrow(ask, meeting.SENT), {TOKEN: _frequency, SET: _first_chunk}, short=(TOKEN,)
    )
    doc = T.StructType([
        T.StructField("key", kind), T.StructField("node", T.LongType()),
        T.StructField("name", T.BinaryType()), T.StructField("n", T.LongType()),
    ])
    held = T.StructType([
        *T.StructType.fromDDL(meeting.SENT).fields, T.StructField("docs", T.ArrayType(doc)),
        T.StructField("node", T.LongType()), T.StructField("tokens", T.BinaryType()),
    ])
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(held)

    def post(rows: pa.Table, answers: pa.Table) -> pa.Table:
        out = []
        nothing = {f.name: None for f in arrow}
        for row in rows.to_pylist():
            chunk = Chunk(row, width)
            node = chunk.nodes()
            names = np.stack(chunk.names, 1)
            out.append(nothing | {"kind": -1, "docs": [
                {"key": k, "node": i, "name": name.tobytes(), "n": len(s)}
                for k, i, name, s in zip(chunk.keys, node.tolist(), names, chunk.sets)
            ]})
            tokens, owners = [np.zeros(0, np.uint64)], [np.zeros(0, np.uint64)]
            said = meeting.answers(answers, TOKEN), meeting.answers(answers, SET)
            for i, prefix in chunk.prefixes(*said, at_least):
                tokens.append(prefix)
                owners.append(np.full(len(prefix), node[i], np.uint64))
                out.append(nothing | {"kind": -2, "node": int(node[i]), "tokens": chunk.sets[i].tobytes()})
            token, owner = np.concatenate(tokens), np.concatenate(owners)
            order = np.argsort(token)
            token, owner = token[order], owner[order]
            for b, c, k, first, second, note in meeting.send(chunk.id, POSTING, buckets, token, owner, np.zeros(len(token))):
                out.append(nothing | {"bucket": b, "chunk": c, "kind": k, "first": first, "second": second})
        return pa.Table.from_pylist(out, schema=arrow)

    sent = settle(chunks.groupBy("chunk").cogroup(said.groupBy("chunk")).applyInArrow(post, held), "shingles")

    def tie(table: pa.Table) -> pa.Table:
        """Each class of a token's list and the first of them."""
        token = np.frombuffer(b"".join(table.column("first").to_pylist()), np.uint64)
        node = np.frombuffer(b"".join(table.column("second").to_pylist()), np.uint64)
        order = np.lexsort((node, token))
        token, node = token[order], node[order]
        fresh = np.ones(len(token), bool)
        fresh[1:] = token[1:] != token[:-1]
        first = node[np.flatnonzero(fresh)][np.cumsum(fresh) - 1]
        ties = np.unique(np.stack([first, node], 1)[first != node], axis=0)
        return pa.table({"a": ties[:, 0].astype(np.int64), "b": ties[:, 1].astype(np.int64)})

    postings = sent.filter(F.col("kind") == POSTING).select("bucket", "first", "second")
    families = components(postings.groupBy("bucket").applyInArrow(tie, "a long, b long"))
    sets = sent.filter(F.col("kind") == -2).select("node", "tokens")

    # Sizes of families, then blocks: hash(node) spreads a family over its blocks.
    placed = sets.join(families, "node")
    sizes = (
        sets.select("node", (F.octet_length("tokens") / 8).alias("n")).join(families, "node")
        .groupBy("component").agg(F.ceil(F.greatest(F.sum("n") / block, F.count(F.lit(1)) / members)).cast("int").alias("blocks"))
    )
    own = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    spread = (
        placed.join(sizes, "component").withColumn("own", own)
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .select("component", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "node", "tokens")
    )

    def verify(table: pa.Table) -> pa.Table:
        node = table.column("node").to_numpy()
        sets = [np.frombuffer(x, np.uint64) for x in table.column("tokens").to_pylist()]
        i, j = table.column("i")[0].as_py(), table.column("j")[0].as_py()
        side = np.zeros(len(sets), int) if i == j else 1 + (table.column("own").to_numpy() == j)
        found = np.array(links_within(sets, side, at_least), np.int64).reshape(-1, 2)
        return pa.table({"a": node[found[:, 0]], "b": node[found[:, 1]]})

    # Dealt by all three: by component alone, all blocks of a family would still be one task's.
    dealt = spread.repartition("component", "i", "j")
    links = dealt.groupBy("component", "i", "j").applyInArrow(verify, "a long, b long")
    linked = components(links)

    docs = sent.filter(F.col("kind") == -1).select(F.explode("docs").alias("d")).select("d.*")
    # A set's class is known by its first document; a document without words is its own class.
    # Classes come first: joins of documents by class and of classes by component split hot keys.
    alone = F.col("n") == 0
    first = F.struct(F.col("key").isNull().alias("unknown"), "key", "node")
    classes = docs.filter(~alone).groupBy("name").agg(F.min("node").alias("class"), F.min(first).alias("first"))
    reach = settle(classes.join(linked.select(F.col("node").alias("class"), "component"), "class", "left").select(
        "name", "first", F.coalesce("component", "class").alias("component")
    ), "classes")
    best = settle(reach.groupBy("component").agg(F.min("first").alias("best")), "best")
    known = settle(reach.join(best, "component").select("name", "best"), "known")
    member = docs.filter(~alone).join(known, "name").select("key", "node", "n", "best")
    member = member.unionByName(docs.filter(alone).select("key", "node", "n", first.alias("best")))
    return member.select(
        F.col("key").alias(key), F.col("n").alias("n_shingles"), F.col("best")["key"].alias("component_id"),
        (F.col("node") == F.col("best")["node"]).alias("stays"),
    )
