"""Quality classifier: random Fourier features, ridge regression, isotonic calibration.

Each whole text gives a few statistics of bytes, words and lines.  Random
Fourier features of the standardised statistics approximate a Gaussian kernel;
their normal equations are summed in each partition and added up by a tree, so
what reaches the driver has a constant size.  The ridge solution's raw scores
are calibrated on other labelled rows by isotonic regression (pool adjacent
violators over fixed bins of the raw score, interpolated between blocks).

Statistics are computed once, into a column of their own; learning reads that
column, and filtering reads it beside the columns of the documents.

Defined results: a null text is the empty text and is scored like any other;
texts of any length are counted whole; rows without an id, without a label, or
with a null one, are not learned from; repeated rows and labels count as often
as they are there; equal texts have equal scores; with nothing to learn from
every score is 0.5; with one class only the scores are that class; an empty table
gives an empty result; other columns, whatever their names, are passed by.
"""

from __future__ import annotations

import operator
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rasterloom.llm.common import OWN, light, summed, written

#: Random features, ridge factor (times the number of rows) and kernel width (times the square root of the statistics' number).
FEATURES, RIDGE, KERNEL, SEED = 384, 1e-4, 0.6, 5
#: Bins of the raw score, from -1 to 2, for calibration.
BINS, LOW, HIGH = 3072, -1.0, 2.0
#: A score from here on is kept.
THRESHOLD = 0.3

_UPPER = np.zeros(256, np.uint8)
_UPPER[65:91] = 1
_SYMBOL = np.zeros(256, np.uint8)
_SYMBOL[[ord(c) for c in "#$%&*+/<=>@\\^_`{}~[]"]] = 1
_BAR = np.zeros(256, np.uint8)
_BAR[ord("|")] = 1
_BANG = np.zeros(256, np.uint8)
_BANG[ord("!")] = 1
N_STATS = 30


def statistics(text: bytes) -> list[float]:
    """``N_STATS`` numbers about a text."""
    n = len(text)
    if not n:
        return [0.0] * N_STATS
    raw = np.frombuffer(text, np.uint8)
    hist = np.bincount(raw, minlength=256)
    share = hist / n
    lower, upper, digit = share[97:123].sum(), share[65:91].sum(), share[48:58].sum()
    space, line = share[32], share[10]
    symbol, high = float(share[_SYMBOL > 0].sum()), share[128:].sum()
    used = share[share > 0]
    entropy = float(-(used * np.log2(used)).sum())
    words = text.split()
    m = max(1, len(words))
    counts = Counter(words)
    top = counts.most_common(3)
    lengths = np.fromiter(map(len, words), np.int64, len(words)) if words else np.zeros(1, np.int64)
    twins = sum(map(operator.eq, words, words[1:]))
    starts = np.concatenate([[0], np.flatnonzero(raw == 10) + 1])
    starts = starts[starts < n]
    sizes = np.diff(np.append(starts, n))
    lines = text.split(b"\n")

    def by_line(kind: np.ndarray) -> tuple[float, float]:
        """Largest share in a line of 20 bytes or more, and the share of all bytes in lines where it is high."""
        part = np.add.reduceat(kind[raw], starts, dtype=np.int64) / sizes
        long = sizes >= 20
        return float(part[long].max(initial=0.0)), float(sizes[part > 0.08].sum() / n)

    shout, symbols, bars, bangs = by_line(_UPPER), by_line(_SYMBOL), by_line(_BAR), by_line(_BANG)
    return [
        float(np.log1p(n)), float(np.log1p(len(words))), float(lengths.mean()), float(lengths.std()), float(np.log1p(lengths.max())),
        len(counts) / m, (top[0][1] if top else 0) / m, sum(c for _, c in top) / m, twins / m,
        float(np.log1p(len(lines))), 1 - len(set(lines)) / len(lines), m / len(lines) / 50,
        float(upper / (lower + upper + 1e-3)), float(digit), float(high), symbol, float(share[ord("!")]), float(share[ord("|")]),
        float(share[ord(".")] + share[ord(",")]), float(space), float(line), entropy,
        *shout, *symbols, *bars, *bangs,
    ]


STATS = OWN + "stats"


def with_statistics(docs: DataFrame, keep: list[str]) -> DataFrame:
    """The columns ``keep`` and ``__loom_stats``, the packed statistics of ``text``."""
    names = [*dict.fromkeys([*keep, "text"])]
    rows = docs.select(*names)
    at = [names.index(k) for k in keep]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            packed = pa.array([np.array(statistics(t.as_py() or b""), np.float64).tobytes() for t in b.column(names.index("text")).cast(pa.binary())], pa.binary())
            yield pa.RecordBatch.from_arrays([*[b.column(k) for k in at], packed], names=[*keep, STATS])

    return light(rows).mapInArrow(run, rows.select(*keep).schema.add(STATS, "binary"))


@dataclass(frozen=True)
class Model:
    mean: np.ndarray
    scale: np.ndarray
    ridge: np.ndarray  # weights of the features, the last for the constant
    at: np.ndarray  # raw scores, rising
    value: np.ndarray  # calibrated scores, not falling

    def score(self, stats: np.ndarray) -> np.ndarray:
        if not len(self.at):
            return np.full(len(stats), 0.5)
        return np.interp(self.raw(stats), self.at, self.value)

    def raw(self, stats: np.ndarray) -> np.ndarray:
        return fourier((stats - self.mean) / self.scale) @ self.ridge


def fourier(x: np.ndarray) -> np.ndarray:
    """Random Fourier features of standardised statistics, and a constant."""
    rng = np.random.default_rng(SEED)
    w = rng.standard_normal((N_STATS, FEATURES)) / (KERNEL * np.sqrt(N_STATS))
    z = np.cos(np.clip(x, -8, 8) @ w + rng.uniform(0, 2 * np.pi, FEATURES)) * np.sqrt(2 / FEATURES)
    return np.hstack([z, np.ones((len(x), 1))])


def _partition_sums(rows: DataFrame, of) -> np.ndarray | None:
    """rows: written, statistics and ``label``.  The sum over all batches of ``of(stats, labels)``, a flat vector."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for b in batches:
            if b.num_rows:
                value = of(unpacked(b.column(0)), b.column(1).to_numpy(zero_copy_only=False).astype(np.float64))
                total = value if total is None else total + value
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([""], pa.string()), pa.array([TaskContext.get().partitionId()], pa.int32()), pa.array([total.tobytes()], pa.binary())], names=["key", "task", "data"])

    return summed(rows.select(STATS, "label").mapInArrow(run, "key string, task int, data binary")).get("")


def unpacked(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.float64).reshape(-1, N_STATS)


def isotonic(value: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """The non-falling fit of least squares, by pooling adjacent violators."""
    blocks: list[list[float]] = []  # mean, weight, length
    for v, w in zip(value.tolist(), weight.tolist()):
        blocks.append([v, w, 1])
        while len(blocks) > 1 and blocks[-2][0] >= blocks[-1][0]:
            v2, w2, n2 = blocks.pop()
            v1, w1, n1 = blocks[-1]
            blocks[-1] = [(v1 * w1 + v2 * w2) / (w1 + w2), w1 + w2, n1 + n2]
    return np.concatenate([np.full(n, v) for v, _, n in blocks]) if blocks else np.empty(0)


def train(fit: DataFrame, calibrate: DataFrame) -> Model:
    """fit, calibrate: statistics and ``label`` (0 or 1) of different rows, written."""
    none = Model(np.zeros(N_STATS), np.ones(N_STATS), np.zeros(FEATURES + 1), np.empty(0), np.empty(0))
    moments = _partition_sums(fit, lambda x, y: np.concatenate([[len(x)], x.sum(0), (x * x).sum(0)]))
    if moments is None:
        return none
    n = moments[0]
    mean = moments[1 : N_STATS + 1] / n
    scale = np.sqrt(np.maximum(moments[N_STATS + 1 :] / n - mean**2, 0)) + 1e-6

    def equations(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        z = fourier((x - mean) / scale)
        return np.concatenate([(z.T @ z).reshape(-1), z.T @ y])

    sums = _partition_sums(fit, equations)
    k = FEATURES + 1
    penalty = np.full(k, RIDGE * n)
    penalty[-1] = 1e-9 * n
    ridge = np.linalg.solve(sums[: k * k].reshape(k, k) + np.diag(penalty), sums[k * k :])
    raw = Model(mean, scale, ridge, np.empty(0), np.empty(0)).raw

    def binned(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        at = np.clip(((raw(x) - LOW) / (HIGH - LOW) * BINS).astype(np.int64), 0, BINS - 1)
        return np.concatenate([np.bincount(at, minlength=BINS), np.bincount(at, y, BINS)])

    counts = _partition_sums(calibrate, binned)
    if counts is None:  # nothing to calibrate with: the raw score within 0 and 1
        return Model(mean, scale, ridge, np.array([0.0, 1.0]), np.array([0.0, 1.0]))
    seen = np.flatnonzero(counts[:BINS])
    value = isotonic(counts[BINS + seen] / counts[seen], counts[seen])
    return Model(mean, scale, ridge, LOW + (seen + 0.5) * (HIGH - LOW) / BINS, value)


def labelled(stats: DataFrame, labels: DataFrame, id_bucket: Column) -> tuple[DataFrame, DataFrame]:
    """stats: ``doc_id`` and statistics; labels: ``doc_id`` and ``quality``.  The rows to fit on (buckets 1 to 3) and to calibrate on (4); bucket 0 is held out.

    The labelled rows are joined once and written: learning reads them several times.
    """
    known = labels.filter("doc_id is not null and quality is not null").select("doc_id", F.col("quality").cast("double").alias("label"))
    rows = stats.select("doc_id", STATS, id_bucket.alias("bucket")).filter("bucket > 0").join(known, "doc_id").select("bucket", STATS, "label")
    rows = written(rows, "quality-labelled")
    return rows.filter("bucket < 4"), rows.filter("bucket = 4")


def scores(stats: DataFrame, model: Model, keep: list[str]) -> DataFrame:
    """The columns ``keep`` and ``score``."""
    rows = stats.select(*keep, STATS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                score = np.clip(model.score(unpacked(b.column(len(keep)))), 0, 1)
                yield pa.RecordBatch.from_arrays([*b.columns[: len(keep)], pa.array(score)], names=[*keep, "score"])

    return rows.mapInArrow(run, rows.select(*keep).schema.add("score", "double"))


def accepted(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` that score ``threshold`` or more, with the columns of ``docs``; no shuffle.

    Statistics that ``docs`` brings along are used, and dropped from the result.
    """
    rows = docs if STATS in docs.columns else with_statistics(docs, docs.columns)
    at = rows.columns.index(STATS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                yield b.filter(pa.array(np.clip(model.score(unpacked(b.column(at))), 0, 1) >= threshold)).drop_columns([STATS])

    kept = docs.drop(STATS)
    return light(rows).mapInArrow(run, kept.schema) if at == len(rows.columns) - 1 else rows.select(*kept.columns, STATS).transform(lambda df: accepted(df, model, threshold))
