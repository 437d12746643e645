"""Toxicity: a convolutional text classifier in NumPy.

A word and its beginnings are hashed into a table of embeddings, whose sum stands for the word.
Filters over one, two and three neighbouring words slide over the whole text, each keeps its
largest response, and a logistic layer weighs them. The net is fitted to the whole texts of all labelled rows but a
part of them, which sets a threshold per language of the text (told by its function words, never by a column).
The rows are cut into shards; in each epoch every shard trains the net on its rows in a task of its own, and
what the shards changed is averaged, a bucket's vector over the shards that met it. Of several shards the changes of
vectors travel in steps of eight bits, and texts compressed. The driver holds nets, of fixed size, and no rows. The score is scaled so that 0.3 is the threshold.

Null and empty texts have no words and get the score of an empty text. Labels that are null
are not used; of several labels for one id the largest counts, for each different text of that id. Without labels of both
kinds every score is 0. Rows are independent, so repeated rows get equal results.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field, replace

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from feedloom.llm.common import WIDE_ROWS, crc_fold, in_small_batches, staged
from feedloom.operators.joins import if_few

#: Training rows of a shard, and rows and characters that are read into one table of words.
SHARD_ROWS = 20_000
PORTION_ROWS, PORTION_CHARS = 256, 1_000_000
#: Share of the labelled rows that sets the thresholds.
CALIBRATION = 0.25
CUT = 0.3

BUCKETS = 1 << 17
SIZE = 16
#: A word has the features of itself and of these beginnings, so that an unseen form is told by its stem.
STEMS = (4, 5, 6, 7)
#: Training texts that must hold a feature; one of fewer texts would be learned by heart.
LEAST_TEXTS = 3
#: Cells of the bitmap of such features.
KNOWN_BITS = 1 << 25
WIDTHS = (1, 2, 3)
FILTERS = 8
TAPS = sum(WIDTHS)
EPOCHS = 5
BATCH = 32
#: Words of a batch with the space around its texts; it has fewer texts if these are long.
BATCH_WORDS = 400_000
RATE = 0.08
#: Buckets whose vectors travel in one row.
_PART = 1 << 11
_CACHED = 300_000
_BLOCK = 100_000
#: Calibration rows of either label that a language needs for a threshold of its own.
_ENOUGH = 15

_TOKENS = re.compile(r"\w+")

# Function words that tell the languages apart.
FUNCTION_WORDS = {
    "de": "der die und das ist nicht ein eine von mit auf für",
    "en": "the of and to in is that it was for with this",
    "es": "el los las que por una del para es con su lo",
    "fr": "le les et des est une dans du au pour qui sur",
}
_VOTES = {w: k for k, words in enumerate(FUNCTION_WORDS.values()) for w in words.split()}


def _features(word: str) -> list[int]:
    """Hashes of the word and of its beginnings, of 31 bits and never 0."""
    found = [xxhash.xxh32_intdigest(word), *(xxhash.xxh32_intdigest(word[:n], seed=n) for n in STEMS if len(word) > n)]
    return [f & 0x7FFFFFFF or 1 for f in found]


class _Words(dict):
    """Numbers words as they come; ``languages`` has the vote of each (the last number for none)."""

    def __init__(self):
        super().__init__()
        self.names: list[str] = []

    def __missing__(self, word: str) -> int:
        self[word] = found = len(self.names)
        self.names.append(word)
        return found

    def documents(self, texts: list[str]) -> list[np.ndarray]:
        return [np.fromiter(map(self.__getitem__, _TOKENS.findall(t.lower())), np.int64) for t in texts]

    def votes(self, start: int = 0) -> np.ndarray:
        return np.array([_VOTES.get(w, len(FUNCTION_WORDS)) for w in self.names[start:]], np.int64)


def _language(votes: np.ndarray) -> int:
    counts = np.bincount(votes, minlength=len(FUNCTION_WORDS) + 1)[:-1]
    return int(counts.argmax()) if counts.any() else len(FUNCTION_WORDS)


def _feature_table(names: list[str]) -> np.ndarray:
    """Of each word the features, 0 for none."""
    found = np.zeros((len(names), 1 + len(STEMS)), np.int32)
    for row, name in zip(found, names):
        own = _features(name)
        row[: len(own)] = own
    return found


def _buckets(features: np.ndarray, known: np.ndarray) -> np.ndarray:
    """The buckets of known features; the last one, whose vector is 0, for others."""
    cell = features & (KNOWN_BITS - 1)
    there = (known[cell >> 3] >> (cell & 7).astype(np.uint8)) & 1
    return np.where((features != 0) & (there == 1), features % BUCKETS, BUCKETS)


@dataclass
class Net:
    vectors: np.ndarray  # of the buckets; the last one is of what has no feature
    taps: np.ndarray  # (SIZE, TAPS * FILTERS)
    bias: np.ndarray
    weights: np.ndarray
    constant: np.ndarray  # one number
    known: np.ndarray  # bitmap of the features that have a bucket
    cuts: np.ndarray = field(default_factory=lambda: np.zeros(len(FUNCTION_WORDS) + 1))

    def buckets(self, names: list[str]) -> np.ndarray:
        """Of each word the buckets of its known features."""
        return _buckets(_feature_table(names), self.known)


def _columns() -> list[list[slice]]:
    """Of each width, the columns of each of its taps."""
    found, at = [], 0
    for width in WIDTHS:
        found.append([slice((at + j) * FILTERS, (at + j + 1) * FILTERS) for j in range(width)])
        at += width
    return found


def _untrained(known: np.ndarray) -> Net:
    rng = np.random.default_rng(7)
    vectors = rng.normal(0, 0.05, (BUCKETS + 1, SIZE)).astype(np.float32)
    vectors[BUCKETS] = 0
    taps = rng.normal(0, 0.3, (SIZE, TAPS * FILTERS)).astype(np.float32)
    n = len(WIDTHS) * FILTERS
    return Net(vectors, taps, np.zeros(n, np.float32), rng.normal(0, 0.3, n).astype(np.float32), np.zeros(1, np.float32), known)


_DENSE = ("taps", "bias", "weights", "constant")


@dataclass
class _State:
    """A net in training, and the squared gradients that its rates of learning come from."""

    net: Net
    sums: dict[str, np.ndarray]

    @staticmethod
    def new(known: np.ndarray) -> _State:
        net = _untrained(known)
        return _State(net, {name: np.full_like(getattr(net, name), 1e-3) for name in ("vectors", *_DENSE)})

    def copy(self) -> _State:
        own = {name: getattr(self.net, name).copy() for name in self.sums}
        return _State(replace(self.net, **own), {name: a.copy() for name, a in self.sums.items()})

    def step(self, name: str, gradient: np.ndarray, rows: np.ndarray | slice = slice(None)) -> None:
        array, sums = getattr(self.net, name), self.sums[name]
        sums[rows] += gradient**2
        array[rows] -= RATE * gradient / np.sqrt(sums[rows])

    def parts(self, before: _State, whole: bool) -> Iterator[tuple[int, bytes]]:
        """What has changed: for every few buckets the vectors and sums, ``whole`` or in steps, and last all else."""
        for k, start in enumerate(range(0, BUCKETS, _PART)):
            cut = slice(start, start + _PART)
            change, more = self.net.vectors[cut] - before.net.vectors[cut], self.sums["vectors"][cut] - before.sums["vectors"][cut]
            yield k, np.hstack([change, more]).tobytes() if whole else zlib.compress(_steps(change) + _steps(np.sqrt(more)), 1)
        pairs = [(getattr(self.net, n), getattr(before.net, n)) for n in _DENSE] + [(self.sums[n], before.sums[n]) for n in _DENSE]
        yield BUCKETS // _PART, np.concatenate([*((a - b).ravel() for a, b in pairs), np.ones(1)]).astype(np.float32).tobytes()

    def changed(self, parts: dict[int, np.ndarray]) -> _State:
        """With the mean of what the shards have changed, from the sums of their ``parts``."""
        found = self.copy()
        for k, total in parts.items():
            if k < BUCKETS // _PART:
                cut, total = slice(k * _PART, (k + 1) * _PART), total.reshape(_PART, 2 * SIZE + 1)
                mean = total[:, :-1] / np.maximum(total[:, -1:], 1)
                found.net.vectors[cut] += mean[:, :SIZE]
                found.sums["vectors"][cut] += mean[:, SIZE:]
            else:
                mean = total[:-1] / total[-1]
                for array in [*(getattr(found.net, n) for n in _DENSE), *(found.sums[n] for n in _DENSE)]:
                    array += mean[: array.size].reshape(array.shape)
                    mean = mean[array.size :]
        return found


def _steps(rows: np.ndarray) -> bytes:
    """Of each row the largest size, and all values as its 127ths."""
    largest = np.abs(rows).max(axis=1, keepdims=True)
    return largest.tobytes() + np.rint(rows / np.where(largest > 0, largest, 1) * 127).astype(np.int8).tobytes()


def _opened_part(k: int, data: bytes, whole: bool) -> np.ndarray:
    """A part of one shard; of buckets a row each: vector, sums, and whether the bucket was met."""
    if k == BUCKETS // _PART:
        return np.frombuffer(data, np.float32)
    if whole:
        rows = np.frombuffer(data, np.float32).reshape(_PART, 2 * SIZE)
    else:
        kind = [("largest", np.float32, (_PART, 1)), ("steps", np.int8, (_PART, SIZE))]
        change, root = (half["largest"] * (half["steps"] / np.float32(127)) for half in np.frombuffer(zlib.decompress(data), kind))
        rows = np.hstack([change, root**2])
    return np.hstack([rows, rows[:, SIZE:].any(axis=1, keepdims=True)])


def _strongest(words: np.ndarray, table: np.ndarray, columns: list[list[slice]]) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Of each width the largest response of each filter in each text (a row of numbers of words in ``table``), and where."""
    widest, texts = max(WIDTHS), len(words)
    size = words.shape[1] - widest + 1
    values = [np.full((texts, FILTERS), -np.inf, np.float32) for _ in columns]
    places = [np.zeros((texts, FILTERS), np.int64) for _ in columns]
    step = max(1, _BLOCK // texts)
    for start in range(0, size, step):
        end = min(start + step, size)
        taps = table[words[:, start : end + widest - 1]]
        for k, cols in enumerate(columns):
            response = sum(taps[:, j : j + end - start, c] for j, c in enumerate(cols))
            best = response.argmax(axis=1)
            found = np.take_along_axis(response, best[:, None, :], 1)[:, 0]
            places[k] = np.where(found > values[k], best + start, places[k])
            values[k] = np.maximum(values[k], found)
    return values, places


def _batches(docs: list[np.ndarray]) -> list[np.ndarray]:
    """Texts of about equal length."""
    found, own = [], []
    for i in np.argsort([len(d) for d in docs], kind="stable").tolist():
        if own and (len(own) == BATCH or (len(own) + 1) * (len(docs[i]) + max(WIDTHS)) > BATCH_WORDS):
            found.append(np.array(own))
            own = []
        own.append(i)
    return found + [np.array(own)] * bool(own)


def _learn(state: _State, docs: list[np.ndarray], labels: np.ndarray, weights: np.ndarray, features: np.ndarray, rng: np.random.Generator) -> None:
    """One epoch over documents of word numbers."""
    net, columns, widest, space = state.net, _columns(), max(WIDTHS), len(features)
    # the last word is the space around a text
    buckets = np.concatenate([_buckets(features, net.known), np.full((1, 1 + len(STEMS)), BUCKETS)])
    batches = _batches(docs)
    for at in rng.permutation(len(batches)):
        members = batches[at]
        words = np.full((len(members), max(len(docs[m]) for m in members) + widest), space, np.int64)
        for i, m in enumerate(members):
            words[i, : len(docs[m])] = docs[m]
        there = np.zeros(space + 1, bool)
        there[words] = True
        met = np.flatnonzero(there)
        place_of = np.zeros(space + 1, np.int64)
        place_of[met] = np.arange(len(met))
        numbers = place_of[words]
        vectors = net.vectors[buckets[met]].sum(axis=1)
        values, places = _strongest(numbers, vectors @ net.taps, columns)
        pooled = np.concatenate(values, axis=1) + net.bias
        active = np.maximum(pooled, 0)
        logit = active @ net.weights + net.constant[0]
        off = (weights[members] * (1 / (1 + np.exp(-np.clip(logit, -30, 30))) - labels[members]) / len(members)).astype(np.float32)
        down = (off[:, None] * net.weights) * (pooled > 0)
        tap_gradient = np.zeros_like(net.taps)
        rows, grads = [], []
        who = np.arange(len(members))[:, None]
        for k, cols in enumerate(columns):
            g = down[:, k * FILTERS : (k + 1) * FILTERS]
            for j, c in enumerate(cols):
                at_word = numbers[who, places[k] + j]  # of each text and filter
                tap_gradient[:, c] += np.einsum("tf,tfs->sf", g, vectors[at_word])
                rows.append(met[at_word].ravel())
                grads.append((g[:, :, None] * net.taps[:, c].T[None]).reshape(-1, SIZE))
        state.step("weights", active.T @ off)
        state.step("bias", down.sum(axis=0))
        net.constant -= RATE * float(off.sum())
        state.step("taps", tap_gradient)
        # a word's gradient goes to all its features
        rows, grads = buckets[np.concatenate(rows)], np.concatenate(grads)
        for column in rows.T:
            used = (column < BUCKETS) & np.any(grads != 0, axis=1)
            touched, inverse = np.unique(column[used], return_inverse=True)
            total = np.zeros((len(touched), SIZE), np.float32)
            np.add.at(total, inverse, grads[used])
            state.step("vectors", total, touched)


# Portions: some labelled texts as numbers of the words of one table, so that they are taken apart once.

_PORTION = "sizes binary, words binary, features binary, labels binary, held binary, tongues binary"


def _portion(rows: list[tuple[str, int, bool]]) -> dict[str, bytes]:
    words = _Words()
    docs = words.documents([text for text, _, _ in rows])
    votes = words.votes()
    columns = (
        np.array([len(d) for d in docs], np.int64),
        np.concatenate(docs).astype(np.int32),
        _feature_table(words.names),
        np.array([label for _, label, _ in rows], np.int8),
        np.array([held for _, _, held in rows], bool),
        np.array([_language(votes[d]) for d in docs], np.int8),
    )
    return {name: [c.tobytes()] for name, c in zip(("sizes", "words", "features", "labels", "held", "tongues"), columns)}


def _portions(rows: DataFrame) -> DataFrame:
    """From ``packed``, ``label`` and ``held`` (kept for the thresholds)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        some, size = [], 0
        for batch in batches:
            for packed, label, held in zip(batch["packed"], batch["label"], batch["held"]):
                some.append((zlib.decompress(packed.as_buffer()).decode(), label.as_py(), held.as_py()))
                size += len(some[-1][0])
                if len(some) == PORTION_ROWS or size >= PORTION_CHARS:
                    yield pa.RecordBatch.from_pydict(_portion(some))
                    some, size = [], 0
        if some:
            yield pa.RecordBatch.from_pydict(_portion(some))

    return rows.select("packed", "label", "held").mapInArrow(run, _PORTION)


def _opened(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list[np.ndarray], np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Of each portion the documents, features, labels, which are held, and languages."""
    kinds = {"sizes": np.int64, "words": np.int32, "features": np.int32, "labels": np.int8, "held": bool, "tongues": np.int8}
    for batch in batches:
        for k in range(batch.num_rows):
            sizes, words, features, labels, held, tongues = (np.frombuffer(batch[n][k].as_buffer(), kind) for n, kind in kinds.items())
            docs = np.split(words, np.cumsum(sizes)[:-1])
            yield docs, features.reshape(-1, 1 + len(STEMS)), labels, held, tongues


def _known(portions: DataFrame, all_rows: bool) -> np.ndarray:
    """Bitmap of the features of enough training texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for docs, features, _, held, _ in _opened(batches):
            names, number = np.unique(features, return_inverse=True)
            number = number.reshape(features.shape)
            texts = np.zeros(len(names), np.int64)
            for doc, out in zip(docs, held):
                if all_rows or not out:
                    texts[np.unique(number[np.unique(doc)])] += 1
            real = (texts > 0) & (names != 0)
            yield pa.RecordBatch.from_arrays([pa.array(names[real]), pa.array(texts[real])], ["feature", "texts"])

    counted = portions.select("sizes", "words", "features", "labels", "held", "tongues").mapInArrow(run, "feature int, texts long")
    often = counted.groupBy("feature").agg(F.sum("texts").alias("texts")).filter(F.col("texts") >= LEAST_TEXTS)
    cell = F.col("feature").bitwiseAND(F.lit(KNOWN_BITS - 1))
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), cell.bitwiseAND(F.lit(63)))
    cells = often.groupBy(F.shiftright(cell, 6).alias("cell")).agg(F.bit_or(bit).alias("bits")).toArrow()
    found = np.zeros(KNOWN_BITS // 64, "<i8")
    found[cells["cell"].to_numpy()] = cells["bits"].to_numpy()
    return found.view(np.uint8)


def _epoch(portions: DataFrame, state: _State, epoch: int, all_rows: bool, weights: tuple[float, float], alone: bool) -> _State:
    """``state`` after every shard has trained it, each from the same start. One that is ``alone`` sends nothing
    to another task, and its changes stay whole."""
    shared = portions.sparkSession.sparkContext.broadcast(state)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, rng, seen = shared.value.copy(), np.random.default_rng((7, epoch)), False
        for docs, features, labels, held, _ in _opened(batches):
            taken = np.flatnonzero(~held | all_rows)
            if len(taken):
                truth = labels[taken].astype(np.float32)
                _learn(own, [docs[i] for i in taken], truth, np.where(truth > 0, weights[1], weights[0]), features, rng)
                seen = True
        if seen:
            shard = TaskContext.get().partitionId()
            for k, part in own.parts(shared.value, alone):
                yield pa.RecordBatch.from_pydict({"part": [k], "shard": [shard], "change": [part]}, schema=_CHANGE)

    def added(key: tuple, rows: pa.Table) -> pa.Table:
        part, total = key[0].as_py(), 0.0
        for change in rows.sort_by("shard")["change"]:
            total = total + _opened_part(part, change.as_buffer(), alone)
        return pa.table({"part": pa.array([part], pa.int32()), "change": [total.astype(np.float32).tobytes()]})

    changes = portions.mapInArrow(run, "part int, shard int, change binary")
    found = changes.groupBy("part").applyInArrow(added, "part int, change binary").toArrow()
    parts = {k: np.frombuffer(c, np.float32) for k, c in zip(found["part"].to_pylist(), found["change"].to_pylist())}
    shared.destroy()
    return state.changed(parts)


_CHANGE = pa.schema([("part", pa.int32()), ("shard", pa.int32()), ("change", pa.binary())])


class _Scorer:
    def __init__(self, net: Net):
        self.net, self.columns = net, _columns()
        self.buckets = net.vectors @ net.taps
        self._forget()

    def _forget(self) -> None:
        self.words = _Words()
        # responses of every word to every tap; the first row is the space around a text
        self.responses = np.zeros((1, TAPS * FILTERS), np.float32)
        self.languages = np.empty(0, np.int64)

    def read(self, texts: list[str]) -> tuple[list[np.ndarray], np.ndarray]:
        """Texts as word numbers for ``logits``, good until the next call, and their languages."""
        if len(self.words.names) > _CACHED:
            self._forget()
        start = len(self.words.names)
        docs = self.words.documents(texts)
        fresh = self.words.names[start:]
        if fresh:
            self.responses = np.concatenate([self.responses, self.responses_of(self.net.buckets(fresh))[1:]])
        self.languages = np.concatenate([self.languages, self.words.votes(start)])
        return docs, np.array([_language(self.languages[d]) for d in docs], np.int64)

    def responses_of(self, buckets: np.ndarray) -> np.ndarray:
        """Of words with these buckets, behind the space around a text."""
        own = self.buckets[buckets].sum(axis=1) if len(buckets) else np.empty((0, TAPS * FILTERS), np.float32)
        return np.concatenate([np.zeros((1, TAPS * FILTERS), np.float32), own])

    def logits(self, docs: list[np.ndarray], responses: np.ndarray | None = None) -> np.ndarray:
        """Texts are pooled in blocks of words; a long text takes several, overlapping by the widest filter.
        Their words are those read last, or those of ``responses``."""
        widest, responses = max(WIDTHS), self.responses if responses is None else responses
        pooled = np.full((len(docs), len(WIDTHS) * FILTERS), -np.inf, np.float32)
        batch, size = [], 0
        for i, doc in enumerate(docs):
            for start in range(0, max(len(doc), 1), _BLOCK):
                part = doc[start : start + _BLOCK + widest - 1]
                batch.append((i, part))
                size += len(part)
                if size >= _BLOCK:
                    self._pool(batch, pooled, responses)
                    batch, size = [], 0
        self._pool(batch, pooled, responses)
        active = np.maximum(pooled + self.net.bias, 0)
        return active @ self.net.weights + self.net.constant[0]

    def _pool(self, batch: list[tuple[int, np.ndarray]], pooled: np.ndarray, responses: np.ndarray) -> None:
        if not batch:
            return
        widest = max(WIDTHS)
        sizes = np.array([len(p) + widest for _, p in batch])
        starts = np.cumsum(sizes) - sizes
        words = np.zeros(sizes.sum() + widest, np.int64)
        for (_, part), start in zip(batch, starts):
            words[start : start + len(part)] = part + 1
        taps = responses[words]
        n = sizes.sum()
        owners = np.array([i for i, _ in batch])
        for k, cols in enumerate(self.columns):
            response = taps[:n, cols[0]]
            for j, c in enumerate(cols[1:], 1):
                response = response + taps[j : n + j, c]
            # the last places of a text would reach into the next one
            edge = starts + sizes - 1
            for back in range(widest - 1):
                response[edge - back] = -np.inf
            found = np.maximum.reduceat(response, starts)
            part = pooled[:, k * FILTERS : (k + 1) * FILTERS]
            np.maximum.at(part, owners, found)


def _best_cut(logits: np.ndarray, labels: np.ndarray, weights: np.ndarray) -> float:
    """The middle of the gap whose cut has the best F1 for the weighted rows."""
    order = np.argsort(-logits, kind="stable")
    z, y, w = logits[order], labels[order], weights[order]
    hit, flagged, real = np.cumsum(w * y), np.cumsum(w), (w * y).sum()
    f1 = 2 * hit / (flagged + real)
    f1[:-1][z[:-1] == z[1:]] = -1
    k = int(f1.argmax())
    below = z[k + 1] if k + 1 < len(z) else z[k] - 2.0
    return float((z[k] + below) / 2)


def _cuts(portions: DataFrame, net: Net, all_rows: bool) -> np.ndarray:
    """The threshold of each language, or that of all rows where it has few. Rows are counted by logit, to three decimals."""
    shared = portions.sparkSession.sparkContext.broadcast(net)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = _Scorer(shared.value)
        for docs, features, labels, held, tongues in _opened(batches):
            taken = np.flatnonzero(held | all_rows)
            logits = scorer.logits([docs[i] for i in taken], scorer.responses_of(_buckets(features, scorer.net.known)))
            columns = (tongues[taken].astype(np.int32), np.round(np.clip(logits, -30, 30) * 1000).astype(np.int32), labels[taken].astype(np.int32))
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["tongue", "logit", "label"])

    logits = portions.mapInArrow(run, "tongue int, logit int, label int")
    counted = logits.groupBy("tongue", "logit", "label").agg(F.count("*").alias("n")).orderBy("tongue", "logit", "label").toArrow()
    tongues, z, labels, n = (counted[c].to_numpy() for c in ("tongue", "logit", "label", "n"))
    z = z / 1000
    cuts = np.full(len(FUNCTION_WORDS) + 1, _best_cut(z, labels, n))
    for k in range(len(cuts)):
        own = tongues == k
        if min((n * labels)[own].sum(), (n * (1 - labels))[own].sum()) >= _ENOUGH:
            cuts[k] = _best_cut(z[own], labels[own], n[own])
    return cuts


def _packed(rows: DataFrame) -> DataFrame:
    """With ``packed``, the compressed text, in place of ``text``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            packed = pa.array([zlib.compress(t.as_buffer(), 6) for t in batch["text"]], pa.binary())
            batch = batch.drop_columns(["text"])
            yield pa.RecordBatch.from_arrays([*batch.columns, packed], [*batch.schema.names, "packed"])

    return rows.mapInArrow(run, rows.drop("text").withColumn("packed", F.lit(b"")).schema)


def _labelled(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``packed``, ``label`` and ``held`` of all different labelled texts, dealt to shards by id and in a fixed order."""
    known = labels.filter("toxic is not null and doc_id is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    known = known.filter(crc_fold(F.col("doc_id")) != 2).select("doc_id", (F.col("toxic") > 0).cast("int").alias("label"))
    known = staged(known, "toxic-labels")
    shards = max(1, math.ceil(known.count() / SHARD_ROWS))
    rows = docs.select("doc_id", "text").filter(F.length("text") > 0).join(if_few(known), "doc_id")
    rows = _packed(rows.withColumn("head", F.substring("text", 1, 32)))
    rows = rows.repartition(shards, "doc_id").dropDuplicates(["doc_id", "label", "packed"]).sortWithinPartitions("doc_id", "head", "packed")
    chance = F.shiftrightunsigned(F.xxhash64(F.lit(11), "doc_id"), 11) / float(1 << 53)
    return rows.select("packed", "label", (chance < CALIBRATION).alias("held"))


def _tally(portions: DataFrame) -> dict[tuple[bool, int], int]:
    """Rows that are held or not, of each label."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for labels, held in zip(batch["labels"], batch["held"]):
                columns = (np.frombuffer(held.as_buffer(), bool), np.frombuffer(labels.as_buffer(), np.int8).astype(np.int32))
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["held", "label"])

    counted = portions.select("labels", "held").mapInArrow(run, "held boolean, label int").groupBy("held", "label").count()
    return {(r["held"], r["label"]): r["count"] for r in counted.collect()}


def train(docs: DataFrame, labels: DataFrame) -> Net | None:
    """The net fitted to all labelled documents that are not held out, or None without both labels."""
    rows = _labelled(docs, labels)
    portions = staged(_portions(rows), "toxic-portions", **WIDE_ROWS)
    tally = _tally(portions)
    both = [{label for held, label in tally if held == side} == {0, 1} for side in (False, True)]
    if {label for _, label in tally} != {0, 1}:
        return None
    # without both labels in a part, all rows take its place
    all_learned, all_checked = not both[0], not both[0] or not both[1]
    learned = [sum(n for (held, own), n in tally.items() if own == label and (all_learned or not held)) for label in (0, 1)]
    # of the two labels the rarer one weighs as much as the other
    weights = (sum(learned) / (2 * learned[0]), sum(learned) / (2 * learned[1]))
    shards = max(1, math.ceil(sum(learned) / SHARD_ROWS))
    portions = portions.coalesce(shards)
    state = _State.new(_known(portions, all_learned))
    for epoch in range(EPOCHS):
        state = _epoch(portions, state, epoch, all_learned, weights, shards == 1)
    return replace(state.net, cuts=_cuts(portions, state.net, all_checked))


def score(docs: DataFrame, net: Net | None) -> DataFrame:
    """``doc_id`` and ``score`` of every document. The net, of fixed size, is broadcast."""
    if net is None:
        return docs.select("doc_id", F.lit(0.0).alias("score"))
    shared = docs.sparkSession.sparkContext.broadcast(net)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = _Scorer(shared.value)
        middle = np.log(CUT / (1 - CUT))
        for batch in batches:
            for start in range(0, batch.num_rows, 1024):
                part = batch.slice(start, 1024)
                words, tongues = scorer.read([t or "" for t in part["text"].to_pylist()])
                z = np.clip(scorer.logits(words) - scorer.net.cuts[tongues], -30, 30) + middle
                yield pa.RecordBatch.from_arrays([part["doc_id"], pa.array(1 / (1 + np.exp(-z.astype(np.float64))))], ["doc_id", "score"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, score double")


def report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    in_small_batches(docs.sparkSession)
    scored = score(docs, train(docs, labels))
    held = (crc_fold(F.col("doc_id")) == 2).alias("held_out")
    return scored.select("doc_id", held, "score", (F.col("score") >= CUT).cast("int").alias("predicted"))
