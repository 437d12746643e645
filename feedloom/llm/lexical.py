"""Ranked lexical search over hashed max-sketches.

The index holds per document its terms with their counts, its length, and a sketch: the terms are
hashed to a power of two of coordinates, about ``SPREAD`` for each distinct term, and a coordinate keeps the
largest count among its terms. Within a document a term's impact rises with its count alone, so a coordinate
of counts is a coordinate of impacts, whatever number of documents and mean length a later search meets;
the index need not be written again when they change.

A search adds the item's term weights up by coordinate. One matrix product of the sketches of a batch
of documents, as impacts, with the weights of a block of items bounds the score of every document for every
item. Documents are then scored exactly, by their terms, in descending order of bounds, until no bound reaches the
item's k-th best exact score so far; a task sends on its k best for each item. Everything is computed in
integers, in doubles only where they are exact.

A term is a maximal run of ASCII letters, digits and characters beyond ASCII; A-Z are lower-cased. Null and
empty texts have no terms and are not counted among the documents. Rows that repeat an id are documents of their
own; equal scores are ranked by id, null ids last. Items with equal ids are one item with the terms of all; an item
without terms, or none that a document holds, has no rows. Further columns are not read.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from feedloom.llm.common import staged
from feedloom.operators.joins import if_few

#: Coordinates for each distinct term, and the fewest and most of a sketch.
SPREAD = 4
NARROW, WIDE = 64, 8192
#: A count in a sketch has a byte; the largest value stands for any greater count too.
FULL = 255
#: No impact is greater: what an endless count would have.
TOP = 1_000_000
#: Terms, repeated over items, of one block of items, and bytes of the bounds computed at once.
BLOCK_TERMS = 200_000
_BYTES = 12 << 20
_TEXT = 4 << 20

# every ASCII byte that is neither letter nor digit becomes a space; A-Z become a-z
_FOLD = bytes(b if b > 127 or chr(b).isalnum() else 32 for b in range(256)).lower()


def terms_of(text: bytes) -> list[bytes]:
    return text.translate(_FOLD).split()


def impacts(counts: np.ndarray, norms: np.ndarray) -> np.ndarray:
    return 1_000_000_000 * counts // (1000 * counts + 8 * norms)


def norms(lengths: np.ndarray, documents: int, terms: int) -> np.ndarray:
    return 100 - 90 + 90 * lengths * documents // terms


def _folded(hashes: np.ndarray, counts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All sketches one after the other, and their widths. ``sizes`` are the terms of each document."""
    widths = np.clip(2 ** np.ceil(np.log2(np.maximum(SPREAD * sizes, 1))).astype(np.int64), NARROW, WIDE)
    starts = np.cumsum(widths) - widths
    flat = np.zeros(int(widths.sum()), np.uint8)
    at = np.repeat(starts, sizes) + (hashes & np.repeat(widths - 1, sizes))
    np.maximum.at(flat, at, np.minimum(counts, FULL).astype(np.uint8))
    return flat, widths


def _listed(values: pa.Array, sizes: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(sizes)), pa.int32()), values)


def index(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """``key``, ``n``, ``terms``, ``counts`` and ``sketch`` of every document with a term."""
    id_type = docs.schema[key].dataType.simpleString()

    def pack(ids: pa.Array, bags: list[Counter]) -> pa.RecordBatch:
        sizes = np.array([len(b) for b in bags], np.int64)
        words = [w for b in bags for w in b]
        counts = np.fromiter((c for b in bags for c in b.values()), np.int64, len(words))
        hashes = np.fromiter(map(zlib.crc32, words), np.int64, len(words))
        flat, widths = _folded(hashes, counts, sizes)
        ends = np.append(0, np.cumsum(widths)).astype(np.int32)
        sketch = pa.Array.from_buffers(pa.binary(), len(bags), [None, pa.py_buffer(ends.tobytes()), pa.py_buffer(flat.tobytes())])
        totals = np.add.reduceat(counts, np.cumsum(sizes) - sizes)
        terms = _listed(pa.array(words, pa.binary()).view(pa.string()), sizes)
        return pa.RecordBatch.from_arrays([ids, pa.array(totals), terms, _listed(pa.array(counts, pa.int32()), sizes), sketch], [key, "n", "terms", "counts", "sketch"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, chosen, bags, size = batch["text"].cast(pa.binary()), [], [], 0
            for i in range(len(texts)):
                text = texts[i].as_py() or b""
                if words := terms_of(text):
                    chosen.append(i)
                    bags.append(Counter(words))
                    size += len(text)
                if bags and (size >= _TEXT or i == len(texts) - 1):
                    yield pack(batch[key].take(pa.array(chosen)), bags)
                    chosen, bags, size = [], [], 0
            if bags:
                yield pack(batch[key].take(pa.array(chosen)), bags)

    rows = docs.select(key, "text")
    return rows.mapInArrow(run, f"{key} {id_type}, n long, terms array<string>, counts array<int>, sketch binary")


def weights(found: DataFrame, asked: DataFrame, documents: int) -> DataFrame:
    """``term`` and ``weight`` of each asked term that a document holds."""
    held = found.select(F.explode("terms").alias("term")).join(if_few(asked), "term", "left_semi")
    counted = held.groupBy("term").agg(F.count("*").alias("df"))
    ratio = F.lit(2 * documents + 2).cast("double") / (2 * F.col("df") + 1).cast("double")
    return counted.select("term", F.floor(1000 * F.log(ratio)).cast("long").alias("weight"))


class _Block:
    """A block of items: their terms in order, and where and how heavily each occurs."""

    def __init__(self, terms: list[str], entries: np.ndarray, items: int):
        self.terms, self.items = pa.array(terms, pa.string()), items
        self.hash = np.fromiter((zlib.crc32(t.encode()) for t in terms), np.int64, len(terms))
        order = np.lexsort((entries[:, 1], entries[:, 0]))
        self.term, self.item, self.weight = entries[order].T
        self.held = np.bincount(self.term, minlength=len(terms))
        self.start = np.cumsum(self.held) - self.held
        self.folded: dict[int, np.ndarray] = {}

    def by_coordinate(self, width: int) -> np.ndarray:
        if width not in self.folded:
            at = (self.hash[self.term] & (width - 1)) * self.items + self.item
            self.folded[width] = np.bincount(at, self.weight, width * self.items).reshape(width, self.items)
        return self.folded[width]


class _Best:
    """The k best documents so far of each item, by score, then by place in the order of ids."""

    def __init__(self, items: int, k: int):
        self.k, self.rows = k, [[] for _ in range(items)]
        self.least = np.ones(items)

    def add(self, item: int, scores: np.ndarray, ids: list) -> None:
        rows = self.rows[item] + list(zip(scores.tolist(), ids))
        rows.sort(key=lambda r: (-r[0], r[1] is None, r[1] if r[1] is not None else 0))
        self.rows[item] = rows[: self.k]
        if len(rows) >= self.k:
            self.least[item] = self.rows[item][-1][0]


def exact(block: _Block, batch: pa.RecordBatch, rows: np.ndarray, norm: np.ndarray) -> np.ndarray:
    """Scores (document, item) of some rows of a batch."""
    terms, counts = batch["terms"].take(pa.array(rows)), batch["counts"].take(pa.array(rows))
    sizes = np.diff(terms.offsets.to_numpy())
    place = pc.index_in(terms.flatten(), value_set=block.terms).fill_null(-1).to_numpy(zero_copy_only=False)
    hit = np.flatnonzero(place >= 0)
    term, owner = place[hit], np.repeat(np.arange(len(rows)), sizes)[hit]
    impact = impacts(counts.flatten().to_numpy(zero_copy_only=False)[hit].astype(np.int64), norm[owner])
    held = block.held[term]
    ends = np.cumsum(held)
    at = np.repeat(block.start[term] - (ends - held), held) + np.arange(int(held.sum()))
    parts = np.repeat(impact, held) * block.weight[at]
    return np.bincount(np.repeat(owner, held) * block.items + block.item[at], parts, len(rows) * block.items).reshape(len(rows), block.items)


def bounds(block: _Block, sketches: np.ndarray, norm: np.ndarray) -> np.ndarray:
    """No score (document, item) exceeds these. ``sketches`` are rows of equal width."""
    folded = block.by_coordinate(sketches.shape[1])
    impact = impacts(sketches.astype(np.int64), norm[:, None])
    impact[sketches == FULL] = TOP
    return impact.astype(float) @ folded


def _rescored(block: _Block, best: _Best, batch: pa.RecordBatch, ids: list, rows: np.ndarray, norm: np.ndarray, bound: np.ndarray) -> int:
    """Scores rows of a batch in waves of descending bounds until no bound reaches the k-th best score."""
    open_, scored = np.ones(len(rows), bool), 0
    while True:
        reach = (bound >= best.least) & open_[:, None]
        items = np.flatnonzero(reach.any(axis=0))
        if not len(items):
            return scored
        wave = np.zeros(len(rows), bool)
        value = np.where(reach[:, items], bound[:, items], -1.0)
        top = np.argpartition(-value, min(best.k, len(rows)) - 1, axis=0)[: best.k]
        wave[top[np.take_along_axis(value, top, axis=0) >= 0]] = True
        chosen = np.flatnonzero(wave)
        scores = exact(block, batch, rows[chosen], norm[chosen])
        for item in np.flatnonzero((scores >= best.least).any(axis=0)).tolist():
            good = np.flatnonzero(scores[:, item] >= best.least[item])
            best.add(item, scores[good, item], [ids[r] for r in rows[chosen[good]].tolist()])
        open_[chosen] = False
        scored += len(chosen)


def _searched(block: _Block, best: _Best, batch: pa.RecordBatch, documents: int, terms: int) -> int:
    ids, sketches = batch[0].to_pylist(), batch["sketch"]
    norm = norms(batch["n"].to_numpy(), documents, terms)
    widths, scored = pc.binary_length(sketches).to_numpy(), 0
    for width in np.unique(widths).tolist():
        same = np.flatnonzero(widths == width)
        step = max(best.k, _BYTES // (8 * max(2 * width, 2 * block.items)))
        for start in range(0, len(same), step):
            rows = same[start : start + step]
            flat = np.frombuffer(b"".join(sketches.take(pa.array(rows)).to_pylist()), np.uint8).reshape(-1, width)
            bound = bounds(block, flat, norm[rows])
            scored += _rescored(block, best, batch, ids, rows, norm[rows], bound)
    return scored


def _blocks(item_terms: DataFrame) -> Iterator[tuple[list, list[str], np.ndarray]]:
    """Items and their weighted terms, a bounded number of terms at a time."""
    size = item_terms.count()
    parts = -(-size // BLOCK_TERMS)
    for part in range(parts):
        own = item_terms.filter(F.pmod(F.xxhash64("item_id"), F.lit(parts)) == part)
        rows = own.orderBy("item_id", "term").toArrow()
        ids, number = {}, []
        for i in rows["item_id"].to_pylist():
            number.append(ids.setdefault(i, len(ids)))
        terms = sorted(set(rows["term"].to_pylist()))
        place = {t: i for i, t in enumerate(terms)}
        entries = np.column_stack([[place[t] for t in rows["term"].to_pylist()], number, rows["weight"].to_numpy()]).astype(np.int64)
        if len(entries):
            yield list(ids), terms, entries


def search(found: DataFrame, items: DataFrame, k: int = 10) -> DataFrame:
    """The ``k`` documents of the index ``found`` with the highest score for each of ``items``
    (``item_id``, ``text``), as ``item_id``, ``rank``, ``doc_id`` and ``score``."""
    total = found.agg(F.count("*").alias("documents"), F.coalesce(F.sum("n"), F.lit(0)).alias("terms")).first()
    documents, terms = total["documents"], total["terms"]
    item_type, id_type = (t.simpleString() for t in (items.schema["item_id"].dataType, found.schema["doc_id"].dataType))
    schema = f"item_id {item_type}, doc_id {id_type}, score long"
    asked = staged(index(items, "item_id").select("item_id", F.explode("terms").alias("term")).distinct(), "item-terms")
    known = staged(weights(found, asked.select("term").distinct(), documents), "term-weights")
    best_rows = found.sparkSession.createDataFrame([], schema)
    for ids, names, entries in _blocks(asked.join(if_few(known), "term")):

        def run(batches: Iterator[pa.RecordBatch], ids=ids, names=names, entries=entries) -> Iterator[pa.RecordBatch]:
            block = _Block(names, entries, len(ids))
            best, kinds = _Best(len(ids), k), None
            for batch in batches:
                kinds = batch.schema.field(0).type
                _searched(block, best, batch, documents, terms)
            if kinds is not None:
                flat = [(ids[i], doc, int(score)) for i, rows in enumerate(best.rows) for score, doc in rows]
                columns = list(zip(*flat)) or [(), (), ()]
                kind = pa.array(ids).type if any(i is not None for i in ids) else pa.int64()
                yield pa.RecordBatch.from_arrays([pa.array(columns[0], kind), pa.array(columns[1], kinds), pa.array(columns[2], pa.int64())], ["item_id", "doc_id", "score"])

        best_rows = best_rows.unionByName(found.select("doc_id", "n", "terms", "counts", "sketch").mapInArrow(run, schema))
    rank = F.row_number().over(Window.partitionBy("item_id").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last()))
    return best_rows.withColumn("rank", rank).filter(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")


def report(docs: DataFrame, items: DataFrame) -> DataFrame:
    return search(staged(index(docs), "sketches"), items)
