"""SimHash near-dedup with covering locality-sensitive hashing.

A text's fingerprint is the bitwise majority of its shingles' XXH64 hashes.
For radius r, 2**(r+1) - 1 structured masks are used: bit i of a fingerprint is
given a nonzero code of r+1 bits, and mask v keeps bit i if the scalar product
of v and the bit's code over GF(2) is 1.  The codes of at most r differing bits
span less than the whole space, so some v is orthogonal to all of them, and in
that mask's table the two fingerprints collide: every pair within the radius
meets in some table, none is missed.

Work is on distinct fingerprints only.  A table's bucket that holds more than
``BLOCK`` of them is cut into blocks, and each pair of blocks is a task of its
own.  In a task a breadth-first search that only looks at fingerprints not yet
reached gives a spanning forest of the links, so a bucket of n fingerprints
emits fewer than n links, never all pairs, and the components are the same.
Components of all links are found by alternating large-star and small-star
steps over DataFrames, cut by written tables.

Defined results: a null or empty text has fingerprint zero and is linked like
any other; fewer words than a shingle make one shingle of all words; equal
fingerprints are linked; a null id sorts after all others, and a component
without any id has a null component; repeated rows each get a row; an empty
table gives an empty result; other columns are kept.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rasterloom.llm.common import OWN, discarded, light, located, sized, spread_join, without_own, written

RADIUS = 4
SHINGLE = 4
SEED = 42
#: Fingerprints of a bucket that one task compares.
BLOCK = 8192
#: Large-star and small-star rounds; each at least halves the distance to the smallest node.
MAX_ROUNDS = 60


def shingle_hashes(text: bytes, shingle: int = SHINGLE) -> np.ndarray:
    """The hashes of a text's shingles, repeats included; none for a text without words."""
    words = text.lower().split()  # of bytes: only A-Z are lowered, only ASCII white space splits
    n = len(words)
    if not n:
        return np.empty(0, np.uint64)
    joined = b" ".join(words)
    if n <= shingle:
        return np.array([xxhash.xxh64_intdigest(joined, SEED)], np.uint64)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, n) + 1)
    starts = [0, *ends[: n - shingle].tolist()]
    stops = (ends[shingle - 1 :] - 1).tolist()
    digest = xxhash.xxh64_intdigest
    return np.fromiter([digest(joined[a:b], SEED) for a, b in zip(starts, stops)], np.uint64, n - shingle + 1)


def majority(hashes: np.ndarray) -> int:
    """The bits that are set in over half the hashes, unsigned."""
    ones = np.zeros(64, np.int64)
    for k in range(0, len(hashes), 1 << 14):
        part = hashes[k : k + (1 << 14)].astype("<u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(hashes), bitorder="little").view("<u8")[0])


def fingerprint(text: bytes, shingle: int = SHINGLE) -> int:
    """The fingerprint of a text, unsigned."""
    return majority(shingle_hashes(text, shingle))


def fingerprints(docs: DataFrame, keep: list[str], shingle: int = SHINGLE) -> DataFrame:
    """The columns ``keep`` of ``docs`` and ``fp``, the fingerprint of ``text`` as a signed long."""
    rows = docs.select(*keep, "text")
    schema = rows.select(*keep).schema.add("fp", "long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(len(keep)).cast(pa.binary())
            fp = np.fromiter((fingerprint(t.as_py() or b"", shingle) for t in texts), np.uint64, len(texts))
            yield pa.RecordBatch.from_arrays([*b.columns[: len(keep)], pa.array(fp.view(np.int64))], names=[*keep, "fp"])

    return light(rows).mapInArrow(run, schema)


def masks(radius: int = RADIUS) -> list[int]:
    """One mask for each nonzero v, as signed longs."""
    n = (1 << (radius + 1)) - 1
    codes = [i % n + 1 for i in range(64)]
    kept = [sum(1 << i for i, c in enumerate(codes) if (c & v).bit_count() & 1) for v in range(1, n + 1)]
    return [m - (1 << 64) if m >> 63 else m for m in kept]


def _forest(group: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links that span the components of ``group`` under the radius."""
    near, far = [], []
    left = group
    while len(left) > 1:
        frontier, left = [left[0]], left[1:]
        while frontier and len(left):
            at = frontier.pop()
            hit = np.bitwise_count(left ^ at) <= radius
            if hit.any():
                found = left[hit]
                near.append(np.full(len(found), at))
                far.append(found)
                frontier.extend(found)
                left = left[~hit]
    empty = np.empty(0, np.uint64)
    return (np.concatenate(near), np.concatenate(far)) if near else (empty, empty)


def _links(radius: int):
    """mapInArrow over rows sorted by group: the links within each group."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

        def flush(keys: np.ndarray, fps: np.ndarray) -> pa.RecordBatch:
            bounds = np.flatnonzero((keys[1:] != keys[:-1]).any(1)) + 1
            starts = np.concatenate([[0], bounds])
            sizes = np.diff(np.concatenate([starts, [len(fps)]]))
            two = starts[sizes == 2]
            close = np.bitwise_count(fps[two] ^ fps[two + 1]) <= radius
            near, far = [fps[two][close]], [fps[two + 1][close]]
            for s, n in zip(starts[sizes > 2].tolist(), sizes[sizes > 2].tolist()):
                a, b = _forest(fps[s : s + n], radius)
                near.append(a)
                far.append(b)
            return pa.RecordBatch.from_arrays([pa.array(np.concatenate(x).view(np.int64)) for x in (near, far)], schema=schema)

        held_keys, held_fps = np.empty((0, 4), np.int64), np.empty(0, np.uint64)
        for b in batches:
            keys = np.stack([b.column(k).to_numpy().astype(np.int64) for k in range(4)], axis=1)
            held_keys, held_fps = np.concatenate([held_keys, keys]), np.concatenate([held_fps, b.column(4).to_numpy().view(np.uint64)])
            if not len(held_fps):
                continue
            last = int(np.flatnonzero((held_keys != held_keys[-1]).any(1))[-1]) + 1 if (held_keys != held_keys[-1]).any() else 0
            if last:
                yield flush(held_keys[:last], held_fps[:last])
                held_keys, held_fps = held_keys[last:], held_fps[last:]
        if len(held_fps):
            yield flush(held_keys, held_fps)

    return run


def links(nodes: DataFrame, radius: int = RADIUS) -> DataFrame:
    """nodes: distinct ``fp``.  Links a < b that span the components of the graph of pairs within the radius."""
    tables = F.array(*[F.struct(F.lit(v).alias("t"), F.col("fp").bitwiseAND(F.lit(m)).alias("key")) for v, m in enumerate(masks(radius))])
    entries = nodes.select("fp", F.explode(tables).alias("e")).select("fp", "e.t", "e.key")
    shared = written(entries.groupBy("t", "key").agg(F.count("*").alias("n")).filter("n > 1"), "simhash-buckets")
    # a broadcast of all shared buckets would grow with the data
    members = spread_join(entries, shared, ["t", "key"], "n").withColumn("blocks", F.ceil(F.col("n") / BLOCK).cast("int"))
    # each pair of different blocks is one group, which holds the pairs within either block too
    block = F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int")
    members = members.withColumn("block", block).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    members = members.filter("blocks = 1 or block != other")
    grouped = members.select("t", "key", F.least("block", "other").alias("p"), F.greatest("block", "other").alias("q"), "fp")
    grouped = grouped.repartition("t", "key", "p", "q").sortWithinPartitions("t", "key", "p", "q")
    found = light(grouped).mapInArrow(_links(radius), "a long, b long")
    return found.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def components(edges: DataFrame) -> DataFrame:
    """edges: written, a < b.  ``node`` and ``root``, the smallest node of its component, for every node but the roots.

    A node with most of the links (the middle of a large group) is joined without a shuffle of its links.
    """

    def star(e: DataFrame, large: bool) -> DataFrame:
        back = e.select(F.col("b").alias("v"), F.col("a").alias("u"))
        both = e.select(F.col("a").alias("v"), F.col("b").alias("u")).unionByName(back) if large else back
        least = written(both.groupBy("v").agg(F.least(F.min("u"), F.first("v")).alias("m"), F.count("*").alias("n")), "simhash-least")
        joined = spread_join(both, least, ["v"], "n")
        out = joined.filter("u > v").select(F.col("m").alias("a"), F.col("u").alias("b")) if large else joined.select(F.col("m").alias("a"), F.col("u").alias("b")).unionByName(least.select(F.col("m").alias("a"), F.col("v").alias("b")))
        done = written(out.filter("a < b").distinct(), "simhash-stars")
        discarded(least)
        return done

    def state(e: DataFrame) -> tuple:
        return tuple(e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())

    given, now = edges, state(edges)
    for _ in range(MAX_ROUNDS):
        if not now[0]:
            break
        half = star(edges, large=True)
        former, edges = edges, star(half, large=False)
        discarded(half, *([former] if former is not given else []))
        before, now = now, state(edges)
        if now == before:
            break
    else:
        raise RuntimeError("the components did not settle")
    return edges.select(F.col("b").alias("node"), F.col("a").alias("root"))


#: Sorts the row that stays to the front.
def rank(*more: str) -> Column:
    return F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", *more)


def classes(prints: DataFrame, radius: int = RADIUS, *more: str) -> DataFrame:
    """prints: written rows with ``doc_id`` and ``fp``.  For each fingerprint: ``n``, its rows, and ``first``, the ``rank`` of its component's first row."""
    nodes = written(prints.groupBy("fp").agg(F.min(rank(*more)).alias("own"), F.count("*").alias("n")), "simhash-nodes")
    roots = components(written(links(nodes.select("fp"), radius), "simhash-links"))
    rooted = written(nodes.join(roots, nodes.fp == roots.node, "left").select("fp", "n", "own", F.coalesce("root", "fp").alias("root")), "simhash-rooted")
    firsts = written(rooted.groupBy("root").agg(F.min("own").alias("first"), F.count("*").alias("nodes")), "simhash-firsts")
    return written(spread_join(rooted, firsts, ["root"], "nodes").select("fp", "n", "first"), "simhash-classes")


def _classed(prints: DataFrame, radius: int, *more: str) -> DataFrame:
    """``prints`` with ``first``; a fingerprint that most rows have is not shuffled."""
    return spread_join(prints, classes(prints, radius, *more), ["fp"], "n")


def near_duplicates(docs: DataFrame, radius: int = RADIUS, shingle: int = SHINGLE) -> DataFrame:
    """One row for each row of ``docs``: ``doc_id``, ``fp``, ``component_id``."""
    prints = written(fingerprints(docs, ["doc_id"], shingle), "simhash-prints")
    return _classed(prints, radius).select("doc_id", "fp", F.col("first.doc_id").alias("component_id"))


def keep_one(docs: DataFrame, radius: int = RADIUS, shingle: int = SHINGLE) -> DataFrame:
    """``docs`` with only the first row of each component."""
    docs = located(docs)
    place = [OWN + "file", OWN + "row"]
    prints = written(fingerprints(docs, ["doc_id", *place], shingle), "simhash-prints")
    same = _classed(prints, radius, *place)
    dropped = same.filter(~((F.col(f"first.{OWN}file") == F.col(OWN + "file")) & (F.col(f"first.{OWN}row") == F.col(OWN + "row"))))
    dropped = written(dropped.select(*place), "simhash-dropped")
    return without_own(docs.join(sized(dropped, 200), place, "left_anti"))
