"""Language identification by a mixture of languages.

Each language has a distribution over character trigrams (hashed to buckets), counted over
all labelled training texts. A text is a mixture: expectation-maximisation estimates the
share of each language, and a language set is chosen by penalised likelihood (every
further language must raise it by more than half the log of the text's length, allowing for the
overlap of trigrams). The largest share in the set is the prediction.

A text that is null or has no letter is ``und`` with score 0, as is every text when nothing was
learned. Ties go to the language that sorts first. Rows are independent, so repeated rows
get equal results; a null ``doc_id`` counts as a training row like any other.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from feedloom.llm.common import crc_fold, staged

BUCKETS = 1 << 15
SMOOTHING = 0.5
STEPS = 12
#: Each character lies in three trigrams, so a text has about a third as much evidence as trigrams.
OVERLAP = 3
#: A text whose largest share is beyond this after a few steps needs no more of them.
SETTLED = 0.98
_CHARS = 2_000_000


class _Trigrams:
    """Bucket counts of many texts at once. A trigram has a letter in its middle; all else is space."""

    def __init__(self):
        self.letter = np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool)

    def _codes(self, text: str) -> np.ndarray:
        codes = np.frombuffer(text.lower().encode("utf-32-le"), np.uint32)
        return np.where(self.letter[codes], codes, np.uint32(32))

    def buckets(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The text and the bucket of each trigram."""
        parts = [self._codes(t) for t in texts]
        gap = np.full(1, 32, np.uint32)
        codes = np.concatenate([gap, *(x for p in parts for x in (p, gap))])
        owner = np.repeat(np.arange(len(texts)), [len(p) + 1 for p in parts])
        middle = np.flatnonzero(codes[1:-1] != 32) + 1 if len(codes) > 2 else np.empty(0, np.int64)
        wide = codes.astype(np.uint64)
        key = (wide[middle - 1] * np.uint64(0x9E3779B1) + wide[middle]) * np.uint64(0x85EBCA6B) + wide[middle + 1]
        key = (key ^ (key >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        return owner[middle - 1], (key >> np.uint64(40)).astype(np.int64) % BUCKETS

    def counted(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        owner, bucket = self.buckets(texts)
        pairs, counts = np.unique(owner * BUCKETS + bucket, return_counts=True)
        return pairs // BUCKETS, pairs % BUCKETS, counts.astype(np.float64)


def _blocks(texts: list[str]) -> Iterator[slice]:
    """Runs of texts of about a bounded number of characters."""
    start, chars = 0, 0
    for i, text in enumerate(texts):
        chars += len(text)
        if chars >= _CHARS:
            yield slice(start, i + 1)
            start, chars = i + 1, 0
    if start < len(texts):
        yield slice(start, len(texts))


def learn(docs: DataFrame) -> tuple[list[str], np.ndarray]:
    """Languages, sorted, and the log probability of each bucket (a row per language).

    The driver receives one count per language and bucket, whatever the number of texts.
    """
    rows = docs.filter("lang is not null and text is not null").select("lang", "text")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trigrams, sums = _Trigrams(), {}
        for batch in batches:
            texts, langs = batch["text"].to_pylist(), batch["lang"].to_pylist()
            for block in _blocks(texts):
                owner, bucket = trigrams.buckets(texts[block])
                names, number = np.unique(langs[block], return_inverse=True)
                found = np.bincount(number[owner] * BUCKETS + bucket, minlength=len(names) * BUCKETS).reshape(len(names), BUCKETS)
                for name, row in zip(names.tolist(), found):
                    sums[name] = sums.get(name, 0) + row
        for name, row in sums.items():
            seen = np.flatnonzero(row)
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(seen), pa.string()), pa.array(seen, pa.int32()), pa.array(row[seen], pa.int64())], ["lang", "bucket", "n"])

    counts = rows.mapInArrow(count, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    found = staged(counts, "trigrams").toArrow()
    names, number = np.unique(np.asarray(found["lang"].to_pylist(), dtype=str), return_inverse=True)
    table = np.zeros((len(names), BUCKETS))
    table[number, found["bucket"].to_numpy()] = found["n"].to_numpy()
    shares = (table + SMOOTHING) / (table.sum(axis=1, keepdims=True) + SMOOTHING * BUCKETS)
    return names.tolist(), np.log(shares)


def _sums(values: np.ndarray, starts: np.ndarray) -> np.ndarray:
    return np.add.reduceat(values, starts) if len(starts) else np.empty(0)


def _mixture(chance: np.ndarray, counts: np.ndarray, sizes: np.ndarray, allowed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Shares (language, text) and log likelihood of the texts, whose trigrams lie one after the other.

    ``chance`` has a row per language, ``sizes`` the trigram kinds of each text, and ``allowed``
    (language, text) the languages each text may use.
    """
    starts = np.cumsum(sizes) - sizes
    weight = _sums(counts, starts)
    share = allowed / allowed.sum(axis=0)
    result, loglik = share.copy(), np.zeros(len(sizes))
    live = np.arange(len(sizes))
    for step in range(STEPS):
        parts = [chance[k] * np.repeat(share[k], sizes) for k in range(len(chance))]
        whole = np.sum(parts, axis=0)
        per = counts / whole
        after = np.stack([_sums(p * per, starts) for p in parts]) / weight
        last = step == STEPS - 1
        moved = np.abs(after - share).max(axis=0)
        result[:, live], loglik[live] = after, _sums(counts * np.log(whole), starts)
        going = (moved > 1e-3) & ~((step >= 3) & (after.max(axis=0) > SETTLED))
        share = after
        if last or not going.any():
            break
        if going.mean() < 0.7:
            rows = np.repeat(going, sizes)
            chance, counts, share, sizes, weight, live = chance[:, rows], counts[rows], share[:, going], sizes[going], weight[going], live[going]
            starts = np.cumsum(sizes) - sizes
    return result, loglik


def infer(texts: list[str], trigrams: _Trigrams, logs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each text the number of the language (-1: none) and the score."""
    best, score = np.full(len(texts), -1), np.zeros(len(texts))
    owner, bucket, counts = trigrams.counted(texts)
    if len(owner) == 0 or len(logs) == 0:
        return best, score
    ids, sizes = np.unique(owner, return_counts=True)
    starts = np.cumsum(sizes) - sizes
    likely = logs[:, bucket]
    alone = np.stack([_sums(counts * row, starts) for row in likely])
    # chances relative to the likeliest language of the trigram: nothing underflows
    top = likely.max(axis=0)
    chance, offset = np.exp(likely - top), _sums(counts * top, starts)
    share, loglik = _mixture(chance, counts, sizes, np.ones((len(logs), len(sizes))))
    loglik = loglik + offset
    penalty = 0.5 * np.log(np.maximum(_sums(counts, starts), 2)) * OVERLAP
    chosen, value = alone.argmax(axis=0), alone.max(axis=0)
    score_of = share[chosen, np.arange(len(sizes))]
    order = np.argsort(-share, axis=0, kind="stable")
    # a further language must pay for itself; no set can do better than all languages together
    open_ = np.flatnonzero(loglik > value + penalty)
    for size in range(2, len(logs) + 1):
        if not len(open_):
            break
        allowed = np.zeros((len(logs), len(open_)))
        np.put_along_axis(allowed, order[:size, open_], 1.0, axis=0)
        rows = np.repeat(np.isin(np.arange(len(sizes)), open_), sizes)
        part, found = _mixture(chance[:, rows], counts[rows], sizes[open_], allowed)
        gain = found + offset[open_] - (size - 1) * penalty[open_]
        better = gain > value[open_]
        at = open_[better]
        value[at], chosen[at] = gain[better], part[:, better].argmax(axis=0)
        score_of[at] = part[:, better].max(axis=0)
        open_ = open_[loglik[open_] - size * penalty[open_] > value[open_]]
    best[ids], score[ids] = chosen, score_of
    return best, np.clip(score, 0.0, 1.0)


def predict(docs: DataFrame, names: list[str], logs: np.ndarray) -> DataFrame:
    """``doc_id``, ``lang_pred`` and ``score`` of every document."""
    model = docs.sparkSession.sparkContext.broadcast((np.array([*names, "und"], object), logs))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (labels, logs), trigrams = model.value, _Trigrams()
        for batch in batches:
            texts = [t or "" for t in batch["text"].to_pylist()]
            found = [infer(texts[block], trigrams, logs) for block in _blocks(texts)]
            best = np.concatenate([np.empty(0, int), *(f[0] for f in found)])
            score = np.concatenate([np.empty(0), *(f[1] for f in found)])
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(labels[best].tolist(), pa.string()), pa.array(score)], ["doc_id", "lang_pred", "score"])

    rows = docs.select("doc_id", "text")
    return rows.mapInArrow(run, "doc_id long, lang_pred string, score double")


def report(docs: DataFrame) -> DataFrame:
    names, logs = learn(docs.filter(crc_fold(docs["doc_id"]) != 2))
    return predict(docs, names, logs).withColumn("held_out", crc_fold(F.col("doc_id")) == 2).select("doc_id", "held_out", "lang_pred", "score")
