"""Substring dedup by Rabin-Karp hashes of fixed-length token windows.

Every window of ``size`` consecutive words of a text is hashed with two
polynomials over the words' XXH64 hashes: one names the window (64 bits), the
other deals it to a bucket, so windows that are compared agree in both.  A task
gathers the windows of some documents and aggregates them before the shuffle:
of each hash only the smallest id competes further; the task's other ids are
already decided and are only passed on, spread over all buckets.  The
competitors travel packed, one row for each task and bucket, and each bucket
finds, for every hash, the smallest id that has it.  What is decided is packed
by groups of documents and meets their texts in one shuffle, where the words
covered merge into maximal removal intervals.

So a window that a third of all documents share adds one competitor for each
task to its bucket, not one for each document.  The texts' bytes are counted
first, and the number of buckets follows them: a bucket holds the windows of about
``BUCKET_BYTES`` of text, and is compared in ranges of hashes of ``AT_ONCE`` windows.

Defined results: a null text has no words; texts shorter than a window lose
nothing; texts of any length are read whole; ids are whole numbers, a null id
counts as larger than all others; rows with the same id (ties, repeated rows) do
not count against one another, and each gets a row; a window that repeats only
within its own document stays; an empty table gives an empty result; other
columns, whatever their names, are passed by.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyspark
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rasterloom.llm.common import light

SIZE = 13
#: Windows that a task gathers before it sends them off.
GATHER = 3_000_000
#: Odd multipliers of the two polynomials (fixed values).
BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
#: Buckets for each shuffle partition; bytes of text whose windows make a bucket; windows that are compared at once.
PER_PARTITION, BUCKET_BYTES, AT_ONCE = 4, 96 << 20, 1 << 22
NO_ID = np.iinfo(np.int64).max
#: Distinct words whose hashes a task remembers.
REMEMBER = 250_000
#: Decided pairs in a row of their own, and decided pairs that a task holds before it reports them, at least and at most.
LATE, HOLD, HOLD_MOST = 50_000, 1_000_000, 8_000_000


class _Words(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= REMEMBER:
            self.clear()
        value = self[word] = xxhash.xxh64_intdigest(word)
        return value


def word_hashes(words: list[bytes], known: dict) -> np.ndarray:
    return np.fromiter(map(known.__getitem__, words), np.uint64, len(words))


def window_hashes(hashes: np.ndarray, size: int, base: int) -> np.ndarray:
    """Polynomial of each window, modulo 2**64: the sum of hash[i + k] * base**(size - 1 - k)."""
    n = len(hashes) - size + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out, span = None, 0  # of the windows put together so far
    part, width, power = hashes, 1, base  # of windows of a power of two; power: base**width
    rest = size
    with np.errstate(over="ignore"):
        while rest:
            if rest & 1:
                if out is None:
                    out = part
                else:  # the windows put together follow those of this part
                    m = len(hashes) - (width + span) + 1
                    out = part[:m] * np.uint64(pow(base, span, 1 << 64)) + out[width : width + m]
                span += width
            rest >>= 1
            if rest:
                m = len(part) - width
                part = part[:m] * np.uint64(power) + part[width : width + m] if m > 0 else part[:0]
                width, power = width * 2, power * power % (1 << 64)
    return out[:n]


def _bucket(second: np.ndarray, buckets: int) -> np.ndarray:
    mixed = second ^ (second >> np.uint64(29))
    return ((mixed >> np.uint64(16)) % np.uint64(buckets)).astype(np.int32)


def compete(hashes: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of windows in order of their ids: the places of each hash's first, and the decided (hash, id) pairs, each once, by id."""
    order = np.argsort(hashes, kind="stable")
    h, d = hashes[order], ids[order]
    first = np.concatenate([[True], h[1:] != h[:-1]]) if len(h) else np.empty(0, bool)
    group = np.cumsum(first) - 1
    least = d[first][group]
    again = np.concatenate([[False], (h[1:] == h[:-1]) & (d[1:] == d[:-1])]) if len(h) else first
    late = (d > least) & ~again
    h_late, d_late = h[late], d[late]
    by_id = np.argsort(d_late, kind="stable")
    return np.sort(order[first]), h_late[by_id], d_late[by_id]


def _send(size: int, buckets: int):
    """Rows of each task: kind 0, the competitors of a bucket; kind 1, pairs already decided, in any bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, turn = _Words(), pyspark.TaskContext.get().partitionId()

        def flush(ids: list[int], firsts: list[np.ndarray], seconds: list[np.ndarray]) -> pa.RecordBatch:
            nonlocal turn
            by_id = np.argsort(np.array(ids, np.int64), kind="stable").tolist()
            counts = [len(firsts[i]) for i in by_id]
            d = np.repeat(np.array(ids, np.int64)[by_id], counts)
            h = np.concatenate([firsts[i] for i in by_id])
            b = _bucket(np.concatenate([seconds[i] for i in by_id]), buckets)
            places, h_late, d_late = compete(h, d)
            h, d, b = h[places], d[places], b[places]
            order = np.argsort(b.astype(np.uint16) if buckets <= 65536 else b, kind="stable")
            h, d, b = h[order], d[order], b[order]
            starts = np.concatenate([[0], np.flatnonzero(np.diff(b)) + 1])
            rows = [(int(b[s]), 0, *pack(h[s:e], d[s:e])) for s, e in zip(starts.tolist(), [*starts[1:].tolist(), len(b)])]
            for s in range(0, len(h_late), LATE):
                turn += 1
                rows.append((turn % buckets, 1, *pack(h_late[s : s + LATE], d_late[s : s + LATE])))
            columns = list(zip(*rows))
            kinds = [pa.int32(), pa.int32(), pa.binary(), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=["bucket", "kind", "hashes", "ids"])

        ids, firsts, seconds, held = [], [], [], 0
        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary())):
                words = (text.as_py() or b"").split()
                if len(words) < size:
                    continue
                hashes = word_hashes(words, known)
                ids.append(NO_ID if doc is None else doc)
                firsts.append(window_hashes(hashes, size, BASES[0]))
                seconds.append(window_hashes(hashes, size, BASES[1]))
                held += len(firsts[-1])
                if held >= GATHER:
                    yield flush(ids, firsts, seconds)
                    ids, firsts, seconds, held = [], [], [], 0
        if held:
            yield flush(ids, firsts, seconds)

    return run


def pack(hashes: np.ndarray, ids: np.ndarray) -> tuple[bytes, bytes]:
    """The hashes as they are, and the ids as runs of differences, compressed."""
    steps = np.diff(ids, prepend=np.int64(0))
    at = np.flatnonzero(steps)
    if len(ids) and (not len(at) or at[0] != 0):
        at = np.concatenate([[0], at])
    runs = np.diff(np.concatenate([at, [len(ids)]])).astype("<u4")
    values = steps[at].astype("<i8")
    planes = np.concatenate([values.view(np.uint8).reshape(-1, 8).T.reshape(-1), runs.view(np.uint8).reshape(-1, 4).T.reshape(-1)])
    return hashes.astype("<u8").tobytes(), zstandard.ZstdCompressor(level=1).compress(planes.tobytes())


def unpack(hashes: bytes, ids: bytes) -> tuple[np.ndarray, np.ndarray]:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(ids), np.uint8)
    n = len(planes) // 12
    values = np.ascontiguousarray(planes[: 8 * n].reshape(8, n).T).reshape(-1).view("<i8")
    runs = np.ascontiguousarray(planes[8 * n :].reshape(4, n).T).reshape(-1).view("<u4")
    return np.frombuffer(hashes, "<u8"), np.repeat(np.cumsum(values), runs)


def _group(ids: np.ndarray, groups: int) -> np.ndarray:
    """The group in which a document's answers meet its text."""
    with np.errstate(over="ignore"):
        mixed = ids.astype(np.uint64) * np.uint64(BASES[0])
    return ((mixed >> np.uint64(24)) % np.uint64(groups)).astype(np.int32)


def _answer(groups: int):
    """Rows sorted by bucket: for each group of documents, the hashes that also have a smaller id, packed with their ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        hold = min(HOLD_MOST, max(HOLD, 8 * groups))

        def settle(parts: list[tuple[bytes, bytes]]) -> Iterator[pa.RecordBatch]:
            pairs = [unpack(*p) for p in parts]
            ranges = -(-sum(len(h) for h, _ in pairs) // AT_ONCE)
            for k in range(ranges):
                own = [((h >> np.uint64(40)) % np.uint64(ranges) == k) for h, _ in pairs] if ranges > 1 else [slice(None)] * len(pairs)
                h, d = np.concatenate([p[0][o] for p, o in zip(pairs, own)]), np.concatenate([p[1][o] for p, o in zip(pairs, own)])
                by_id = np.argsort(d, kind="stable")
                held.append(compete(h[by_id], d[by_id])[1:])
                yield from flush(hold)

        def flush(least: int) -> Iterator[pa.RecordBatch]:
            if sum(len(h) for h, _ in held) <= least:
                return
            h, d = np.concatenate([p[0] for p in held]), np.concatenate([p[1] for p in held])
            held.clear()
            g = _group(d, groups)
            order = np.lexsort((d, g))
            h, d, g = h[order], d[order], g[order]
            starts = np.concatenate([[0], np.flatnonzero(np.diff(g)) + 1])
            packed = [pack(h[s:e], d[s:e]) for s, e in zip(starts.tolist(), [*starts[1:].tolist(), len(d)])]
            yield pa.RecordBatch.from_arrays([pa.array(g[starts]), pa.array([p[0] for p in packed], pa.binary()), pa.array([p[1] for p in packed], pa.binary())], names=["grp", "hashes", "ids"])

        at, parts = None, []
        for b in batches:
            for bucket, kind, hashes, ids in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), b.column(3)):
                if bucket != at and parts:
                    yield from settle(parts)
                    parts = []
                at = bucket
                if kind:
                    held.append(unpack(hashes.as_py(), ids.as_py()))
                else:
                    parts.append((hashes.as_py(), ids.as_py()))
                yield from flush(hold)
        if parts:
            yield from settle(parts)
        yield from flush(0)

    return run


def covered(words: list[bytes], known: dict, hit: np.ndarray, size: int) -> np.ndarray:
    """Whether each word is covered by a window whose hash is in ``hit``."""
    flags = np.isin(window_hashes(word_hashes(words, known), size, BASES[0]), hit)
    edge = np.zeros(len(words) + 1, np.int64)
    at = np.flatnonzero(flags)
    np.add.at(edge, at, 1)
    np.add.at(edge, at + size, -1)
    return np.cumsum(edge[:-1]) > 0


def _remove(size: int):
    """Rows sorted by group, answers before texts: the spans and what is left of each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, at, held = _Words(), None, []
        shrunk = zstandard.ZstdDecompressor()
        told_ids = told = np.empty(0, np.int64)
        span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        for b in batches:
            ids, n_words, n_removed, spans, kept = [], [], [], [], []
            for group, hashes, packed, doc, text in zip(b.column(0).to_pylist(), b.column(1), b.column(2), b.column(3).to_pylist(), b.column(4)):
                if group != at:
                    at, held, told_ids, told = group, [], np.empty(0, np.int64), np.empty(0, np.uint64)
                if hashes.is_valid:
                    held.append(unpack(hashes.as_py(), packed.as_py()))
                    continue
                if held:
                    told, told_ids = np.concatenate([x[0] for x in held]), np.concatenate([x[1] for x in held])
                    order = np.argsort(told_ids, kind="stable")
                    told, told_ids, held = told[order], told_ids[order], []
                whole = shrunk.decompress(text.as_py())
                words = whole.split(b" ") if whole else []
                ids.append(doc)
                n_words.append(len(words))
                lo, hi = np.searchsorted(told_ids, NO_ID if doc is None else doc, side="left"), np.searchsorted(told_ids, NO_ID if doc is None else doc, side="right")
                if lo == hi:
                    n_removed.append(0)
                    spans.append([])
                    kept.append(whole)
                    continue
                gone = covered(words, known, told[lo:hi], size)
                edge = np.flatnonzero(np.diff(gone, prepend=False, append=False))
                n_removed.append(int(gone.sum()))
                spans.append([{"start": int(s), "end": int(e)} for s, e in zip(edge[::2], edge[1::2])])
                kept.append(b" ".join([w for w, g in zip(words, gone.tolist()) if not g]))
            if ids:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids, pa.int64()), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(spans, span), pa.array(kept, pa.binary()).cast(pa.string())],
                    names=["doc_id", "n_words", "n_removed", "removed", "kept"],
                )

    return run


def _shrink(groups: int):
    """Texts as words joined by one space, compressed for the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        squeeze = zstandard.ZstdCompressor(level=1)
        for b in batches:
            texts = [squeeze.compress(b" ".join((t.as_py() or b"").split())) for t in b.column(1).cast(pa.binary())]
            ids, none = b.column(0), pa.nulls(b.num_rows, pa.binary())
            group = _group(ids.fill_null(NO_ID).to_numpy(), groups)
            yield pa.RecordBatch.from_arrays([pa.array(group), none, none, ids, pa.array(texts, pa.binary())], names=["grp", "hashes", "ids", "doc_id", "text"])

    return run


def remove_repeats(docs: DataFrame, size: int = SIZE) -> DataFrame:
    """For each row: ``doc_id``, ``n_words``, ``n_removed``, ``removed`` (maximal intervals of words) and ``kept`` (the text that is left)."""
    rows = docs.select(F.col("doc_id").cast("long"), "text")
    size_of_all = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")) * PER_PARTITION, -(-size_of_all // BUCKET_BYTES))
    parts = -(-n // PER_PARTITION)
    sent = light(rows).mapInArrow(_send(size, n), "bucket int, kind int, hashes binary, ids binary")
    told = sent.repartition(parts, "bucket").sortWithinPartitions("bucket").mapInArrow(_answer(n), "grp int, hashes binary, ids binary")
    texts = rows.mapInArrow(_shrink(n), "grp int, hashes binary, ids binary, doc_id long, text binary")
    met = texts.unionByName(told, allowMissingColumns=True)
    met = met.repartition(parts, "grp").sortWithinPartitions("grp", F.col("hashes").isNull())
    return met.mapInArrow(_remove(size), "doc_id long, n_words long, n_removed long, removed array<struct<start:long,end:long>>, kept string")
