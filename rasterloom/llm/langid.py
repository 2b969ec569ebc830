"""Language identification by a mixture of languages.

Training counts hashed byte trigrams of lower-cased letters for each language,
over all given documents; counts are added up by a tree of partition sums.  A
text is then taken as a mixture: expectation-maximisation over its trigrams'
likelihoods estimates the proportion of each language.  Languages enter in
order of their proportion for as long as the likelihood, less a penalty for each
further language, grows; the proportions are estimated anew for the set.

Defined results: a null text, or one without any letter (digits, fractions and
numerals are none), is ``und`` with score 0 and no languages; with no language
learned every text is; texts of any length are counted whole; ids are whole
numbers or null; ties between languages go to the first by name; null languages
and texts are not learned; repeated rows count as often as they are there; an
empty table gives an empty result; other columns, whatever their names, are
passed by.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rasterloom.llm.common import light, summed

BINS = 1 << 15
#: Added to each count.
SMOOTH = 0.5
#: Times the logarithm of the number of trigrams: what a further language must add to the log-likelihood.
PENALTY = 2.0
ROUNDS, SETTLED = 25, 1e-4
#: Letters, and some numerals that are none.
ALMOST_LETTER = re.compile(r"[^\W\d_]")
#: Letters stay as they are, all else of ASCII is a space.
FOLD = np.array([c if c >= 128 or 97 <= c <= 122 else 32 for c in range(256)], np.uint8)


def has_letter(text: str) -> bool:
    return any(m.group().isalpha() for m in ALMOST_LETTER.finditer(text))


def trigrams(text: str) -> tuple[np.ndarray, np.ndarray]:
    """The bins of a text's trigrams and their counts."""
    b = FOLD[np.frombuffer(f" {text.lower()} ".encode(), np.uint8)].astype(np.uint32)
    key = b[:-2] << np.uint32(16) | b[1:-1] << np.uint32(8) | b[2:]
    key = key[(b[1:-1] != 32) | (b[2:] != 32)]
    counts = np.bincount((key * np.uint32(2654435761)) >> np.uint32(17), minlength=BINS)
    at = np.flatnonzero(counts)
    return at, counts[at]


@dataclass(frozen=True)
class Languages:
    names: list[str]
    like: np.ndarray  # languages x bins, probabilities


def learn(docs: DataFrame) -> Languages:
    """docs: ``text`` and ``lang``; the result's size is the number of languages times ``BINS``."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for b in batches:
            for text, lang in zip(b.column(0), b.column(1).to_pylist()):
                at, n = trigrams(text.as_py())
                if lang not in sums:
                    sums[lang] = np.zeros(BINS)
                sums[lang][at] += n
        for lang, value in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([lang], pa.string()), pa.array([TaskContext.get().partitionId()], pa.int32()), pa.array([value.tobytes()], pa.binary())], names=["key", "task", "data"])

    known = docs.filter(F.col("text").isNotNull() & F.col("lang").isNotNull()).select("text", F.col("lang").cast("string"))
    sums = summed(light(known).mapInArrow(count, "key string, task int, data binary"))
    names = sorted(sums)
    like = np.stack([sums[n] + SMOOTH for n in names]) if names else np.empty((0, BINS))
    return Languages(names, like / like.sum(1, keepdims=True))


def _em(like: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, float]:
    """Proportions of the rows of ``like`` and the log-likelihood."""
    share = np.full(len(like), 1 / len(like))
    total = counts.sum()
    for _ in range(ROUNDS if len(like) > 1 else 0):
        new = share * (like @ (counts / (share @ like))) / total
        moved = np.abs(new - share).max()
        share = new
        if moved < SETTLED:
            break
    return share, float(counts @ np.log(share @ like))


def mixture(model: Languages, text: str | None) -> list[tuple[str, float]]:
    """The text's languages and their proportions, largest first; none if it has no letter."""
    if not model.names or not text or not has_letter(text):
        return []
    at, counts = trigrams(text)
    like, counts = model.like[:, at], counts.astype(np.float64)
    share, _ = _em(like, counts)
    order = np.argsort(-share, kind="stable")
    price = PENALTY * np.log(max(2.0, counts.sum()))
    best, best_score = order[:1], _em(like[order[:1]], counts)[1]
    best_share = np.ones(1)
    for k in range(2, len(order) + 1):
        share, value = _em(like[order[:k]], counts)
        if value - price * (k - 1) <= best_score:
            break
        best, best_score, best_share = order[:k], value - price * (k - 1), share
    ranked = sorted(zip(best_share.tolist(), best.tolist()), key=lambda x: (-x[0], x[1]))
    return [(model.names[i], min(1.0, max(0.0, s))) for s, i in ranked]


def identify(docs: DataFrame, model: Languages) -> DataFrame:
    """For each row: ``doc_id``, ``lang_pred``, ``score`` (its proportion) and ``languages`` (the whole mixture)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("lang", pa.string()), ("share", pa.float64())]))
        for b in batches:
            found = [mixture(model, t.as_py()) for t in b.column(1)]
            pred = [m[0][0] if m else "und" for m in found]
            score = [m[0][1] if m else 0.0 for m in found]
            whole = [[{"lang": n, "share": s} for n, s in m] for m in found]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(pred, pa.string()), pa.array(score, pa.float64()), pa.array(whole, kind)], names=["doc_id", "lang_pred", "score", "languages"])

    rows = docs.select(F.col("doc_id").cast("long"), "text")
    return light(rows).mapInArrow(run, "doc_id long, lang_pred string, score double, languages array<struct<lang:string,share:double>>")
