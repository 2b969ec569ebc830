"""SentencePiece encoding and decoding with sampled segmentations.

The pieces of a model span a lattice over a text; a segmentation is a path.
Sampling is without replacement by Gumbel top-k: the perturbed scores (log
probability plus Gumbel noise) of all paths are searched from the top.  The
search is A* over regions of paths with a common prefix.  A region's bound is
the largest perturbed score in it, drawn from its total probability, which the
lattice's backward sums give exactly, so each region taken from the queue gives
the next path; what is left of it is split by the edge at which a path departs
from it, each part with a bound drawn below the former one.  A path's inclusion
score is the probability that its perturbed score exceeds the first one that
did not come out (the threshold of conditional Poisson sampling).

Where no piece spans two neighbouring characters the lattice falls apart, and
its parts (words, mostly) are independent.  The sums of each distinct part (found
by a hash, then compared character by character) are
computed once in a batch, paths of all texts of a batch are drawn together, and
noise comes from a counter-based hash of seed, row key, sample, part and step,
so a row's samples depend on nothing but its key, its text and the seed.

A model of the unigram kind gives log-probabilities.  A model of the merge kind
has only ranks; a piece of rank r then weighs (r + ``OFFSET``) ** -1, after
Zipf's law.  Characters without a piece become their bytes' pieces, together
one edge; so does a ``▁`` in a text, which is the pieces' sign for a space.  Texts are
taken as they are, not normalised, so that they come back as they were.  The
model's file is shipped to the executors.

Defined results: a null text is the empty text, which has one empty
segmentation; a text with fewer than k segmentations gets all of them, the
last with inclusion 1; a text is one lattice, whatever its length (about 60 bytes
of memory for each character of it, and a node for each character of its distinct
parts); a null key hashes as zero; ids are whole numbers or null; repeated rows get
equal samples; samples that tie come out in the order in which they were found; an
empty table gives an empty result; other columns, whatever their names, are passed
by ``sampled`` and kept by ``decoded``.
"""

from __future__ import annotations

import functools
import heapq
import itertools
import os
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rasterloom.llm.common import OWN, light

SPACE = "▁"
#: For models that only rank their pieces.
OFFSET = 10.0
#: Log-probability of each byte of a character that has no piece, below that of the rarest piece.
BYTE_PENALTY = 2.0
#: Characters of text that are drawn together, about.
CHARS = 300_000


@dataclass(frozen=True)
class Model:
    """texts: of each piece its text (of a byte piece a ``bytes``); single: piece of a code point, or -1.

    Pieces of two or more characters are a trie: ``class_of`` a code point,
    ``follow[inner state, class]`` gives a state (0: none), whose piece (or -1)
    and inner state (0: a leaf) are in ``piece_of`` and ``inner_of``.
    """

    ids: dict[str, int]
    log_p: np.ndarray
    texts: list[str | bytes]
    byte_ids: list[int]
    byte_log_p: float
    unknown: int
    single: np.ndarray
    class_of: np.ndarray
    joined: np.ndarray  # whether some piece has these two classes as neighbours
    follow: np.ndarray
    piece_of: np.ndarray
    inner_of: np.ndarray
    spelled: np.ndarray  # the bytes of all pieces, spaces as spaces
    spelled_at: np.ndarray


#: One more than there are code points: a ``▁`` of the text itself.
LITERAL = 0x110000
POINTS = LITERAL + 1


def _trie(ids: dict[str, int], classes: dict[str, int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    follow: list[dict[int, int]] = [{}, {}]  # of inner states; 1 is the root
    piece_of, inner_of = [-1], [0]
    for text, piece in ids.items():
        if len(text) < 2:
            continue
        inner = 1
        for k, c in enumerate(text):
            state = follow[inner].get(classes[c])
            if state is None:
                state = follow[inner][classes[c]] = len(piece_of)
                piece_of.append(-1)
                inner_of.append(0)
            if k == len(text) - 1:
                piece_of[state] = piece
            elif not inner_of[state]:
                inner_of[state] = len(follow)
                follow.append({})
            inner = inner_of[state]
    table = np.zeros((len(follow), len(classes) + 1), np.int32)
    for row, nexts in enumerate(follow):
        for c, state in nexts.items():
            table[row, c] = state
    return table, np.array(piece_of, np.int32), np.array(inner_of, np.int32)


@functools.lru_cache(maxsize=2)
def load(path: str, alpha: float = 1.0) -> Model:
    """The model at ``path``; log-probabilities are multiplied by ``alpha`` (below 1 flattens)."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    n = sp.vocab_size()
    texts: list[str | bytes] = [sp.id_to_piece(i) for i in range(n)]
    byte_ids = [-1] * 256
    ids: dict[str, int] = {}
    for i, t in enumerate(texts):
        if sp.is_byte(i):
            byte_ids[int(t[3:5], 16)] = i
            texts[i] = bytes([int(t[3:5], 16)])
        elif not (sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i)):
            ids[t] = i
    return assembled(ids, np.array([sp.get_score(i) for i in range(n)]), texts, byte_ids, sp.unk_id(), alpha)


def assembled(ids: dict[str, int], score: np.ndarray, texts: list[str | bytes], byte_ids: list[int], unknown: int, alpha: float = 1.0) -> Model:
    own = np.array(sorted(ids.values()))
    log_p = np.full(len(texts), -np.inf)
    ranked = bool((score[own] == np.round(score[own])).all())
    log_p[own] = -np.log(OFFSET - score[own]) if ranked else score[own]
    if ranked:
        log_p[own] -= np.logaddexp.reduce(log_p[own])
    single, class_of = np.full(POINTS, -1, np.int32), np.zeros(POINTS, np.int32)
    classes: dict[str, int] = {}
    pairs = {(a, b) for t in ids for a, b in zip(t, t[1:])}
    for pair in pairs:
        for c in pair:
            class_of[ord(c)] = classes.setdefault(c, len(classes) + 1)
    for t, i in ids.items():
        if len(t) == 1:
            single[ord(t)] = i
    low = float(log_p[own].min()) - BYTE_PENALTY
    for c in range(128):  # a character of one byte is that byte's piece
        if single[c] < 0 and byte_ids[c] >= 0:
            single[c] = byte_ids[c]
            log_p[byte_ids[c]] = low
    joined = np.zeros((len(classes) + 1, len(classes) + 1), bool)
    for a, b in pairs:
        joined[classes[a], classes[b]] = True
    spelled = [t if type(t) is bytes else t.replace(SPACE, " ").encode() for t in texts]
    return Model(
        ids, log_p * alpha, texts, byte_ids, low * alpha, unknown, single, class_of, joined, *_trie(ids, classes),
        np.frombuffer(b"".join(spelled), np.uint8), np.concatenate([[0], np.cumsum([len(x) for x in spelled])]),
    )


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.int32)


def shown(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The code points of all texts, white space shown and one space before each that is not empty; and where each ends."""
    points = code_points("".join([" " + t if t else "" for t in texts])).copy()
    points[points == ord(SPACE)] = LITERAL
    points[points == ord(" ")] = ord(SPACE)
    return points, np.cumsum(np.fromiter((len(t) + bool(t) for t in texts), np.int64, len(texts)))


#: For the hash that tells parts apart (fixed values).
STEP, MIX = 0x9E3779B97F4A7C15, np.uint64(0xFF51AFD7ED558CCD)


class Lattices:
    """The lattices of some texts, one for each distinct part, in flat arrays.

    A node is a place in a part; its edges come together, longest first.
    ``parts`` holds the number of each part of the texts in turn, ``ends`` the
    number of parts up to each text's end.
    """

    def __init__(self, model: Model, texts: list[str]):
        points, stops = shown(texts)
        kinds = model.class_of[points]
        cut = np.ones(len(points) + 1, bool)
        cut[1:-1] = ~model.joined[kinds[:-1], kinds[1:]]
        cut[stops] = True
        starts = np.flatnonzero(cut[:-1]) if len(points) else np.zeros(0, np.int64)
        self.ends = np.searchsorted(starts, stops, side="left")
        sizes = np.diff(np.append(starts, len(points)))
        within = np.arange(len(points), dtype=np.int32) - np.repeat(starts.astype(np.int32), sizes)
        for salt in itertools.count(1):
            with np.errstate(over="ignore"):
                powers = np.cumprod(np.full(int(sizes.max(initial=0)) + 1, STEP, np.uint64))
                mixed = (points.astype(np.uint64) + np.uint64(salt)) * MIX
                mixed ^= mixed >> np.uint64(32)
                names = np.add.reduceat(mixed * powers[within], starts) if len(points) else np.zeros(0, np.uint64)
            _, first, parts = np.unique(names, return_index=True, return_inverse=True)
            if np.array_equal(sizes[first][parts], sizes) and np.array_equal(points[np.repeat(starts[first][parts], sizes) + within], points):
                break  # no two different parts share a hash
        self.parts = parts.astype(np.int32)
        # the distinct parts, one after another
        self.size_of = sizes[first].astype(np.int32)
        self.node_of = np.cumsum(self.size_of, dtype=np.int32) - self.size_of
        at = np.arange(int(self.size_of.sum())) + np.repeat(starts[first] - self.node_of, self.size_of)
        self._edges(model, points[at], kinds[at])

    def _edges(self, model: Model, points: np.ndarray, kinds: np.ndarray) -> None:
        n = len(points)
        to_end = np.repeat(self.node_of + self.size_of, self.size_of) - np.arange(n, dtype=np.int32)
        alone = model.single[points]
        alone[alone < 0] = -points[alone < 0] - 1
        found = [(np.arange(n, dtype=np.int32), alone, 1)]
        at = np.flatnonzero(to_end > 1).astype(np.int32)
        state = model.follow[1, kinds[at]]
        inner, length = model.inner_of[state], 1
        while True:
            length += 1
            live = (inner > 0) & (to_end[at] >= length)
            at, inner = at[live], inner[live]
            if not len(at):
                break
            state = model.follow[inner, kinds[at + length - 1]]
            live = state > 0
            at, state = at[live], state[live]
            piece, inner = model.piece_of[state], model.inner_of[state]
            whole = piece >= 0
            found.append((at[whole], piece[whole], length))
        found.reverse()
        node = np.concatenate([f[0] for f in found])
        order = np.argsort(node, kind="stable")
        node = node[order]
        self.piece = np.concatenate([f[1] for f in found])[order]
        self.step = np.concatenate([np.full(len(f[0]), f[2], np.int32) for f in found])[order]
        degree = np.bincount(node, minlength=n)
        self.edge_of = np.concatenate([[0], np.cumsum(degree)]).astype(np.int32)
        log_p = np.empty(len(node))
        plain = self.piece >= 0
        log_p[plain] = model.log_p[self.piece[plain]]
        odd = -self.piece[~plain] - 1
        log_p[~plain] = model.byte_log_p * (1 + (odd >= 128) + (odd >= 2048) + ((odd >= 65536) & (odd != LITERAL)))
        # backward sums, from the ends of all parts at once
        far = to_end[node]
        by_far = np.argsort(far.astype(np.uint16) if int(self.size_of.max(initial=0)) < 65536 else far, kind="stable")
        cuts = np.concatenate([[0], np.cumsum(np.bincount(far)[1:])]) if len(far) else np.zeros(1, np.int64)
        source, goal = node[by_far], (node + self.step)[by_far]
        past = (far == self.step)[by_far]
        value = log_p[by_far]
        beta = np.zeros(n + 1)
        for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
            if a == b:
                continue
            v = value[a:b] + np.where(past[a:b], 0.0, beta[goal[a:b]])
            src = source[a:b]
            heads = np.flatnonzero(np.concatenate([[True], src[1:] != src[:-1]]))
            deg = np.diff(np.append(heads, b - a))
            top = np.maximum.reduceat(v, heads)
            total = top + np.log(np.add.reduceat(np.exp(v - np.repeat(top, deg)), heads))
            beta[src[heads]] = total
            value[a:b] = v - np.repeat(total, deg)
        self.log_p = np.empty(len(node))
        self.log_p[by_far] = value
        p, first = np.exp(self.log_p), self.edge_of[:-1]
        # what the other edges of each edge's node have together, without loss where that is little; none: the only way on
        most = p >= 0.5
        others = np.add.reduceat(np.where(most, 0.0, p), first) if len(p) else p
        with np.errstate(divide="ignore"):
            self.log_rest = np.log(np.where(most, np.repeat(others, degree), 1 - p))
        running = np.cumsum(p)
        running -= np.repeat(running[first] - p[first], degree)
        running[self.edge_of[1:] - 1] = 2.0  # the last takes what rounding leaves
        self.upto = running


#: Steps of a path that are split at once; and the most by which ``noise``, of 52 bits, can lift a region above its log mass.
BLOCK, HIGHEST = 512, 37.0
GOLDEN, ONES = np.uint64(0x9E3779B97F4A7C15), (1 << 64) - 1


def noise(counters: tuple[int, ...], *more: np.ndarray) -> np.ndarray:
    """Uniform in (0, 1), hashed from counters (the finaliser of splitmix64 after each)."""
    z = 0
    for c in counters:
        z = ((z ^ c & ONES) + 0x9E3779B97F4A7C15) & ONES
        z = (z ^ z >> 30) * 0xBF58476D1CE4E5B9 & ONES
        z = (z ^ z >> 27) * 0x94D049BB133111EB & ONES
        z ^= z >> 31
    z = np.uint64(z)
    with np.errstate(over="ignore"):
        for c in more:
            z = (z ^ c.astype(np.uint64)) + GOLDEN
            z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
            z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
            z = z ^ (z >> np.uint64(31))
    return ((z >> np.uint64(12)).astype(np.float64) + 0.5) / (1 << 52)


def draw(lat: Lattices, keys: np.ndarray, places: np.ndarray, sample: int) -> tuple[np.ndarray, np.ndarray]:
    """One path through each part, drawn by its probability: where each part's edges start, and the edges."""
    end = lat.node_of[lat.parts] + lat.size_of[lat.parts]
    alive, node, owner, edges = np.arange(len(end), dtype=np.int32), lat.node_of[lat.parts], [], []
    step = 0
    while len(alive):
        u = noise((sample, step), keys[alive] ^ places[alive].astype(np.uint64) * GOLDEN)
        e = lat.edge_of[node]
        on = np.flatnonzero(lat.upto[e] < u).astype(np.int32)
        while len(on):
            e[on] += 1
            on = on[lat.upto[e[on]] < u[on]]
        owner.append(alive)
        edges.append(e)
        node = node + lat.step[e]
        go = node < end[alive]
        alive, node = alive[go], node[go]
        step += 1
    if not owner:
        return np.zeros(1, np.int64), np.zeros(0, np.int64)
    counts = np.bincount(np.concatenate(owner), minlength=len(end))
    starts = np.concatenate([[0], np.cumsum(counts)])
    out = np.empty(starts[-1], np.int32)
    for k, (o, e) in enumerate(zip(owner, edges)):
        out[starts[o] + k] = e
    return starts, out


def below(log_mass: np.ndarray, bound: float, u: np.ndarray) -> np.ndarray:
    """Gumbels of the given locations, each no larger than ``bound``."""
    return -np.logaddexp(-bound, np.log(-np.log(u)) - log_mass)


@dataclass
class Sample:
    edges: np.ndarray
    log_p: float
    perturbed: float
    inclusion: float = 1.0


def top_k(lat: Lattices, parts: np.ndarray, key: int, k: int, fresh) -> list[Sample]:
    """The k segmentations of a text (its parts in order) with the largest perturbed scores, falling.

    fresh(s): for the s-th drawn path of the text, (where each part's edges start, edges).
    """
    bound = float(-np.log(-np.log(noise((key, 1 << 20)))))
    # a region: a path, the step up to which its own paths share it, the edges that they do not take there,
    # and the part that the step is in
    queue: list[tuple] = [(-bound, 0, None, 0, frozenset(), 0)]
    serial, found = 1, []
    up_to_part = np.cumsum(lat.size_of[parts])
    while queue:
        minus, _, path, t, barred, part = heapq.heappop(queue)
        bound, n = -minus, len(found)
        if n == k:
            for s in found:  # the first that does not come out is the threshold
                s.inclusion = float(-np.expm1(-np.exp(min(s.log_p - bound, 700.0))))
            break
        starts, edges = fresh(n)
        if path is not None:
            edges = np.concatenate([path[:t], _depart(lat, parts, path[t], barred, part, key, n), edges[starts[part + 1] :]])
        given = lat.log_p[edges]
        found.append(Sample(edges, float(given.sum()), bound))
        # the rest of the region: paths that share these edges up to some step from t on and differ there
        wanted, shared, at, g, open_ = k + 1 - n, float(given[:t].sum()), t, np.zeros(0), np.zeros(0, np.int64)
        while at < len(given):
            part_of = given[at : at + BLOCK]
            before = shared + np.cumsum(part_of) - part_of
            left = lat.log_rest[edges[at : at + BLOCK]]
            if barred and at == t:
                left[0] = _log_rest(lat, int(edges[t]), barred)
            free = np.flatnonzero(left > -np.inf)  # else it is the only way on
            mass = left[free] + before[free]
            g = np.concatenate([g, below(mass, bound, noise((key, (1 << 20) + 1 + n), free + at))])
            open_ = np.concatenate([open_, free + at])
            shared, at = float(before[-1] + part_of[-1]), at + BLOCK
            if len(g) >= wanted and shared + HIGHEST < np.partition(g, -wanted)[-wanted]:
                break  # no later region can have a larger bound
        for i in np.argsort(-g, kind="stable")[:wanted].tolist():  # others cannot come out
            step = int(open_[i])
            also = barred if step == t else frozenset()
            within = int(np.searchsorted(up_to_part, int(lat.step[edges[:step]].sum()), side="right"))
            heapq.heappush(queue, (-float(g[i]), serial, edges, step, also | {int(edges[step])}, within))
            serial += 1
    return found


def _log_rest(lat: Lattices, edge: int, barred: frozenset) -> float:
    """What the edges of an edge's node have together, without itself and those that are barred."""
    node = int(np.searchsorted(lat.edge_of, edge, side="right")) - 1
    free = [e for e in range(int(lat.edge_of[node]), int(lat.edge_of[node + 1])) if e != edge and e not in barred]
    return float(np.logaddexp.reduce(lat.log_p[free])) if free else -np.inf


def _depart(lat: Lattices, parts: np.ndarray, former: int, barred: frozenset, part: int, key: int, n: int) -> np.ndarray:
    """From the node of the edge ``former``: an edge that is not barred, then as it comes, to the end of the part."""
    node = int(np.searchsorted(lat.edge_of, former, side="right")) - 1
    choices = np.arange(lat.edge_of[node], lat.edge_of[node + 1])
    p = np.exp(lat.log_p[choices])
    p[[b - int(choices[0]) for b in barred]] = 0
    end = int(lat.node_of[parts[part]] + lat.size_of[parts[part]])
    own = []
    while True:
        running = np.cumsum(p)
        u = float(noise((key, (1 << 21) + n, part, len(own)))) * running[-1]
        own.append(int(choices[min(int(np.searchsorted(running, u, side="right")), len(choices) - 1)]))
        node += int(lat.step[own[-1]])
        if node >= end:
            return np.array(own, np.int64)
        choices = np.arange(lat.edge_of[node], lat.edge_of[node + 1])
        p = np.exp(lat.log_p[choices])


def piece_ids(model: Model, pieces: np.ndarray) -> np.ndarray:
    """Piece ids of lattice pieces; characters without one become bytes (or the unknown piece)."""
    odd = np.flatnonzero(pieces < 0)
    if not len(odd):
        return pieces
    out, last = [], 0
    for i in odd.tolist():
        out.append(pieces[last:i])
        point = -int(pieces[i]) - 1
        codes = [model.byte_ids[b] for b in (SPACE if point == LITERAL else chr(point)).encode("utf-8", "surrogatepass")]
        out.append(np.array(codes if min(codes) >= 0 else [model.unknown], np.int64))
        last = i + 1
    return np.concatenate([*out, pieces[last:]])


def spell(model: Model, ids: np.ndarray, ends: np.ndarray) -> list[bytes]:
    """The bytes of several lists of piece ids, which end at ``ends``, without the space that stands before a text."""
    sizes = model.spelled_at[ids + 1] - model.spelled_at[ids]
    upto = np.concatenate([[0], np.cumsum(sizes)])
    at = np.arange(upto[-1]) + np.repeat(model.spelled_at[ids] - upto[:-1], sizes)
    whole = model.spelled[at].tobytes()
    stops = upto[ends].tolist()
    return [whole[a + 1 : b] for a, b in zip([0, *stops], stops)]


def decode(model: Model, ids: list[int]) -> str:
    """The text of piece ids."""
    return spell(model, np.array(ids, np.int64), np.array([len(ids)]))[0].decode("utf-8", "replace")


def sample_batch(model: Model, keys: list[int], texts: list[str], k: int) -> list[list[tuple[np.ndarray, Sample]]]:
    """For each text its samples, with their piece ids."""
    lat = Lattices(model, texts)
    counts = np.diff(np.concatenate([[0], lat.ends]))
    hashed = np.repeat(np.array([x & ONES for x in keys], np.uint64), counts)
    places = np.arange(len(lat.parts)) - np.repeat(lat.ends - counts, counts)
    drawn = [draw(lat, hashed, places, s) for s in range(k)]
    out = []
    for key, hi, n in zip(keys, lat.ends.tolist(), counts.tolist()):
        lo = hi - n

        def fresh(s: int, lo: int = lo, hi: int = hi) -> tuple[np.ndarray, np.ndarray]:
            starts, edges = drawn[s]
            return starts[lo : hi + 1] - starts[lo], edges[starts[lo] : starts[hi]]

        if not n:
            out.append([(np.zeros(0, np.int64), Sample(np.zeros(0, np.int64), 0.0, 0.0))])
            continue
        out.append([(piece_ids(model, lat.piece[s.edges]), s) for s in top_k(lat, lat.parts[lo:hi], key, k, fresh)])
    return out


def row_key(seed: int, *columns: Column) -> Column:
    return F.xxhash64(F.lit(seed), *columns)


def _shipped(df: DataFrame, path: str) -> str:
    """The name under which executors find the file at ``path``."""
    df.sparkSession.sparkContext.addFile(path)
    return os.path.basename(path)


SAMPLES = "samples array<struct<ids:array<int>,log_p:double,perturbed:double,inclusion:double,exact:boolean>>"


def sampled(docs: DataFrame, model_path: str, k: int = 2, seed: int = 11, alpha: float = 1.0, key: Column | None = None) -> DataFrame:
    """For each row ``doc_id`` and ``samples``: k distinct segmentations, the largest perturbed score first; ``exact``: decoding gives the text back."""
    key = F.col("doc_id") if key is None else key
    rows = docs.select(row_key(seed, key).alias("key"), F.col("doc_id").cast("long"), "text")
    name = _shipped(docs, model_path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = load(SparkFiles.get(name), alpha)
        kind = pa.list_(pa.struct([("ids", pa.list_(pa.int32())), ("log_p", pa.float64()), ("perturbed", pa.float64()), ("inclusion", pa.float64()), ("exact", pa.bool_())]))

        def flush(ids: list, keys: list[int], texts: list[str]) -> pa.RecordBatch:
            found = sample_batch(model, keys, texts, k)
            flat = [x for own in found for x in own]
            values = np.concatenate([x[0] for x in flat])
            ends = np.concatenate([[0], np.cumsum([len(x[0]) for x in flat])])
            back = iter(spell(model, values, ends[1:]))
            exact = [next(back) == raw for own, raw in zip(found, [t.encode() for t in texts]) for _ in own]
            fields = [pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(values.astype(np.int32))), *[pa.array([getattr(s, n) for _, s in flat], pa.float64()) for n in ("log_p", "perturbed", "inclusion")], pa.array(exact, pa.bool_())]
            own = np.concatenate([[0], np.cumsum([len(x) for x in found])]).astype(np.int32)
            whole = pa.ListArray.from_arrays(pa.array(own), pa.StructArray.from_arrays(fields, fields=[kind.value_type.field(i) for i in range(5)]))
            return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), whole.cast(kind)], names=["doc_id", "samples"])

        ids, keys, texts, held = [], [], [], 0
        for b in batches:
            for key, doc, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist()):
                ids.append(doc)
                keys.append(key)
                texts.append(text or "")
                held += len(texts[-1])
                if held >= CHARS or len(ids) >= 4000:
                    yield flush(ids, keys, texts)
                    ids, keys, texts, held = [], [], [], 0
        if ids:
            yield flush(ids, keys, texts)

    return light(rows).mapInArrow(run, f"doc_id long, {SAMPLES}")


def decoded(df: DataFrame, model_path: str, column: str = "ids") -> DataFrame:
    """``df`` with ``__loom_text``, the text of the piece ids in ``column``; null for a null list, empty for an empty one."""
    schema = T.StructType([*df.schema.fields, T.StructField(OWN + "text", T.StringType())])
    at, name = df.columns.index(column), _shipped(df, model_path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = load(SparkFiles.get(name))
        for b in batches:
            lists = b.column(at).to_pylist()
            ids = np.array([i for own in lists for i in own or ()], np.int64)
            back = spell(model, ids, np.cumsum([len(own or ()) for own in lists], dtype=np.int64))
            texts = pa.array([None if own is None else t.decode("utf-8", "replace") for own, t in zip(lists, back)], pa.string())
            yield pa.RecordBatch.from_arrays([*b.columns, texts], names=[*b.schema.names, OWN + "text"])

    return light(df).mapInArrow(run, schema)
