"""Near copies by the similarity of their shingles: a Jaccard index of 0.8 or more over five words.

Candidates come from two places: SimHash fingerprints within the covering radius
(see ``simhash``), and bands of MinHash values, for a pair of similarity 0.8
often lies further apart than any radius that covering masks can reach.  A band
is ``ROWS`` of the values under one 64-bit key; two texts of similarity s share
one of the ``BANDS`` keys with probability 1 - (1 - s**ROWS)**BANDS, which
misses 5 in a million pairs at 0.8 and fewer above.

Every key links its members to the first of them only, so n members give n - 1
links; the components of these links are the candidate clusters.  Each text of a
cluster then sends its whole set of shingle hashes to the cluster's task once,
where a breadth-first search over exact similarities gives a spanning forest.
All pairs of a cluster are looked at but for those already in one component, so
a pair that no key joined is found as well if others lead from one to the other.
Clusters of more than ``BLOCK`` shingles are cut into blocks.  All blocks are first
compared with the cluster's first text, which is all that a group of copies of
one text needs; texts that it does not reach, if there are any, are then
compared with every block.  Shingles are compared by their 64-bit hashes.

Defined results: a null or empty text has one shingle, the empty one; fewer
words than a shingle make one shingle of all words; ids number the rows in the
order of ``simhash.rank``, so a component's first row is its smallest id; a null
id sorts after all others; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType

from rasterloom.llm import simhash
from rasterloom.llm.common import OWN, light, located, sized, spread_join, without_own, written

SHINGLE = 5
ROWS, BANDS = 6, 40
#: Shingles of a cluster that one task compares with as many others.
BLOCK = 1 << 16
#: Odd factors and summands of the MinHash values (of the hashes' upper halves), fixed by a seed.
_FIXED = np.random.default_rng(42).integers(0, 1 << 32, (2, ROWS * BANDS, 1), np.uint32)
FACTORS, SUMMANDS = _FIXED[0] | np.uint32(1), _FIXED[1]
#: The hash of a text without words.
BLANK = xxhash.xxh64_intdigest(b"", simhash.SEED)


def distinct(hashes: np.ndarray) -> np.ndarray:
    return np.unique(hashes) if len(hashes) else np.array([BLANK], np.uint64)


def shingles(text: bytes) -> np.ndarray:
    """The distinct hashes of a text's shingles, sorted."""
    return distinct(simhash.shingle_hashes(text, SHINGLE))


def band_keys(hashes: np.ndarray) -> list[int]:
    """A signed key for each band."""
    least, upper = np.full(ROWS * BANDS, (1 << 32) - 1, np.uint32), (hashes >> np.uint64(32)).astype(np.uint32)
    for k in range(0, len(upper), 1 << 10):
        least = np.minimum(least, (FACTORS * upper[k : k + (1 << 10)] + SUMMANDS).min(1))
    packed, size = least.astype("<u4").tobytes(), 4 * ROWS
    return [_signed(xxhash.xxh64_intdigest(packed[b * size : (b + 1) * size], b)) for b in range(BANDS)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _prints(docs: DataFrame, keep: list[str]) -> DataFrame:
    """``keep``, the fingerprint ``fp``, the number of shingles ``size`` and the band ``keys``."""
    rows = docs.select(*keep, "text")
    schema = rows.select(*keep).schema.add("fp", "long").add("size", "long").add("keys", ArrayType(LongType()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps, sizes, keys = [], [], []
            for t in b.column(len(keep)).cast(pa.binary()):
                hashes = simhash.shingle_hashes(t.as_py() or b"", SHINGLE)
                own = distinct(hashes)
                fps.append(_signed(simhash.majority(hashes)))
                sizes.append(len(own))
                keys.append(band_keys(own))
            own = [pa.array(fps, pa.int64()), pa.array(sizes, pa.int64()), pa.array(keys, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays([*b.columns[: len(keep)], *own], names=[*keep, "fp", "size", "keys"])

    return light(rows).mapInArrow(run, schema)


def _sets(docs: DataFrame, keep: list[str]) -> DataFrame:
    """``keep`` and ``hashes``, the packed shingles of ``text``."""
    rows = docs.select(*keep, "text")
    schema = rows.select(*keep).schema.add("hashes", "binary")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                b = batch.slice(at, 256)
                packed = [shingles(t.as_py() or b"").tobytes() for t in b.column(len(keep)).cast(pa.binary())]
                yield pa.RecordBatch.from_arrays([*b.columns[: len(keep)], pa.array(packed, pa.binary())], names=[*keep, "hashes"])

    return light(rows).mapInArrow(run, schema)


def _candidates(prints: DataFrame) -> DataFrame:
    """Links a < b, the components of which are the candidate clusters."""
    entries = prints.select("node", F.explode("keys").alias("key"))
    firsts = written(entries.groupBy("key").agg(F.min("node").alias("a"), F.count("*").alias("n")).filter("n > 1"), "near-keys")
    bands = spread_join(entries, firsts, ["key"], "n").select("a", F.col("node").alias("b"))
    owners = written(prints.groupBy("fp").agg(F.min("node").alias("own"), F.count("*").alias("n")), "near-prints")
    same = spread_join(prints.select("fp", "node"), owners, ["fp"], "n").select(F.col("own").alias("a"), F.col("node").alias("b"))
    within = written(simhash.links(owners.select("fp")), "near-within")
    one, two = owners.select(F.col("fp").alias("a"), F.col("own").alias("x")), owners.select(F.col("fp").alias("b"), F.col("own").alias("y"))
    within = within.join(one, "a").join(two, "b").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))
    return bands.unionByName(same).unionByName(within).filter("a < b").distinct()


def _forest(nodes: np.ndarray, sets: list[np.ndarray]) -> tuple[list[int], list[int]]:
    """Links that span the components of ``nodes`` under the exact similarity."""
    sizes = np.array([len(s) for s in sets])
    order = np.argsort(sizes, kind="stable")
    nodes, sizes = nodes[order], sizes[order]
    _, tokens, often = np.unique(np.concatenate([sets[i] for i in order]), return_inverse=True, return_counts=True)
    owner = np.repeat(np.arange(len(nodes)), sizes)
    shared = often[tokens] > 1
    tokens, owner = tokens[shared], owner[shared]
    starts = np.searchsorted(owner, np.arange(len(nodes) + 1))
    marked = np.zeros(len(often), bool)

    left, flat = np.arange(len(nodes)), tokens
    bounds = starts
    near, far = [], []

    def without(gone: np.ndarray) -> None:
        nonlocal left, flat, bounds
        stay = ~gone
        lengths = np.diff(bounds)
        flat = flat[np.repeat(stay, lengths)]
        left, bounds = left[stay], np.concatenate([[0], np.cumsum(lengths[stay])])

    while len(left) > 1:
        frontier = [int(left[0])]
        without(np.arange(len(left)) == 0)
        while frontier and len(left):
            at = frontier.pop()
            n = int(sizes[at])
            # 9 * common >= 4 * (n + m) is a similarity of 0.8 or more; it needs sizes of 4 to 5 at least
            lo, hi = np.searchsorted(sizes[left] * 5, 4 * n), np.searchsorted(sizes[left] * 4, 5 * n, side="right")
            if lo == hi:
                continue
            own = tokens[starts[at] : starts[at + 1]]
            marked[own] = True
            upto = np.concatenate([[0], np.cumsum(marked[flat[bounds[lo] : bounds[hi]]])])
            marked[own] = False
            common = np.diff(upto[bounds[lo : hi + 1] - bounds[lo]])
            hit = np.zeros(len(left), bool)
            hit[lo:hi] = 9 * common >= 4 * (n + sizes[left[lo:hi]])
            if hit.any():
                found = left[hit].tolist()
                near += [at] * len(found)
                far += found
                frontier += found
                without(hit)
    return nodes[near].tolist() if near else [], nodes[far].tolist() if far else []


def _grouped(find: Callable[[np.ndarray, list[np.ndarray]], tuple[list[int], list[int]]]):
    """mapInArrow over rows sorted by root, p, q and node: the links that ``find`` sees within each group."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, nodes, sets = None, [], []

        def flush() -> pa.RecordBatch:
            a, b = find(np.array(nodes), sets)
            return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

        for batch in batches:
            keys = zip(*(batch.column(k).to_pylist() for k in range(3)))
            for key, node, packed in zip(keys, batch.column(3).to_pylist(), batch.column(4)):
                if key != now:
                    if len(nodes) > 1:
                        yield flush()
                    now, nodes, sets = key, [], []
                if not nodes or nodes[-1] != node:
                    nodes.append(node)
                    sets.append(np.frombuffer(packed.as_py(), np.uint64))
        if len(nodes) > 1:
            yield flush()

    return run


def _from_first(nodes: np.ndarray, sets: list[np.ndarray]) -> tuple[list[int], list[int]]:
    """Links of the smallest node to those similar to it."""
    first = sets[0]  # rows are sorted by node
    found = [n for n, s in zip(nodes[1:].tolist(), sets[1:]) if 9 * int(np.isin(s, first, assume_unique=True).sum()) >= 4 * (len(s) + len(first))]
    return [int(nodes[0])] * len(found), found


def _linked(sets: DataFrame, find) -> DataFrame:
    """sets: ``root``, ``p``, ``q``, ``node``, ``hashes``."""
    rows = sets.select("root", "p", "q", "node", "hashes").repartition("root", "p", "q").sortWithinPartitions("root", "p", "q", "node")
    return light(rows).mapInArrow(_grouped(find), "a long, b long").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).filter("a < b").distinct()


def _each(n: str, name: str) -> Column:
    return F.explode(F.sequence(F.lit(0), F.col(n) - 1)).alias(name)


def _exact(docs: DataFrame, members: DataFrame, place: list[str]) -> DataFrame:
    """members: written, ``node``, ``root``, ``size``, ``blocks`` and the place of each text of a cluster.  Links that span the components under the exact similarity."""
    def sets(rows: DataFrame, *keep: str) -> DataFrame:
        return _sets(docs.select(*place, "text").join(sized(rows, 200), place), ["node", "root", *keep])

    zero = F.lit(0).alias("q")
    links = written(_linked(sets(members.filter("blocks = 1"), "blocks").select("*", F.lit(0).alias("p"), zero), _forest), "near-links")
    large = written(members.filter("blocks > 1"), "near-large")
    if large.isEmpty():
        return links
    block = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    # the first text of a cluster goes to all its blocks
    spread = large.select("*", F.when(F.col("node") == F.col("root"), F.sequence(F.lit(0), F.col("blocks") - 1)).otherwise(F.array(block)).alias("ps"))
    near = written(_linked(sets(spread, "ps").select("*", F.explode("ps").alias("p"), zero), _from_first), "near-first")
    left = large.filter("node != root").join(near.select(F.col("b").alias("node")), "node", "left_anti")
    lefts = written(left.groupBy("root").agg(F.ceil(F.sum("size") / BLOCK).cast("int").alias("rests"), F.count("*").alias("n")), "near-rests")
    if lefts.isEmpty():
        return links.unionByName(near)
    left = written(spread_join(written(left, "near-left"), lefts, ["root"], "n").drop("n"), "near-left")
    every = written(large.join(sized(lefts, 40), "root").drop("n"), "near-every")
    rest = F.pmod(F.xxhash64("node"), F.col("rests")).cast("int").alias("p")
    one = sets(left, "blocks", "rests").select("*", rest).select("*", _each("blocks", "q"))
    two = sets(every, "blocks", "rests").select("*", block.alias("q")).select("*", _each("rests", "p"))
    return links.unionByName(near).unionByName(written(_linked(one.select("root", "p", "q", "node", "hashes").unionByName(two.select("root", "p", "q", "node", "hashes")), _forest), "near-links"))


def keep_one(docs: DataFrame) -> DataFrame:
    """``docs`` with only the first row of each component of near copies."""
    docs = located(docs)
    place = [OWN + "file", OWN + "row"]
    prints = written(_prints(docs, ["doc_id", *place]), "near-minhash")
    # numbered in the order of rank, so that the smallest node of a component is the row that stays
    prints = written(prints.orderBy(simhash.rank(*place)).select("*", F.monotonically_increasing_id().alias("node")), "near-nodes")
    clusters = written(simhash.components(written(_candidates(prints), "near-candidates")), "near-clusters")
    members = clusters.unionByName(clusters.select(F.col("root").alias("node"), "root").distinct())
    members = written(prints.select("node", "size", *place).join(members, "node"), "near-members")
    blocks = written(members.groupBy("root").agg(F.ceil(F.sum("size") / BLOCK).cast("int").alias("blocks"), F.count("*").alias("n")), "near-roots")
    members = written(spread_join(members, blocks, ["root"], "n").select("node", "root", "size", "blocks", *place), "near-blocks")
    copies = simhash.components(written(_exact(docs, members, place).distinct(), "near-exact")).select("node")
    dropped = written(members.join(copies, "node", "left_semi").select(*place), "near-dropped")
    return without_own(docs.join(sized(dropped, 200), place, "left_anti"))
