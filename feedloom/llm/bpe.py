"""Byte-level BPE: encoding in overlapping chunks, and decoding.

Texts up to a chunk are split into pre-tokens where they lie. Longer ones are cut into chunks
that overlap their right neighbour, and the chunks are spread over the tasks. Both scans of
an overlap find the same pre-tokens from the first boundary they share (the pattern looks
only forward), so that boundary is where the left chunk ends and the right one begins. A boundary
counts for the left chunk only if the text after it is long enough for every look-ahead of the
pattern. If two neighbours share no boundary (a run without any), the whole text is
encoded in one task. Each pre-token is then merged by the ranks, those of equal length side by side in arrays.

Null text counts as empty: no ids. Equal long texts are encoded once. Rows are independent, so
repeated rows get equal results.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import itertools
from array import array
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from feedloom.llm.common import in_small_batches, staged
from feedloom.operators.joins import attach, if_few

#: Characters of a chunk, and of its overlap with the next one.
CHUNK = 1 << 15
OVERLAP = 1 << 9
#: The public pattern decides on a pre-token after reading two characters past its end at most; another may need more.
LOOK_AHEAD = 2
#: Pre-tokens in each half of a worker's memory.
_CACHED = 60_000
_SHORT = 48
_NONE = 1 << 62  # a pair that is no token
_NO_PAIR = np.iinfo(np.int32).max  # the same in arrays
#: Characters whose new pre-tokens are merged together, pre-tokens of one length from which arrays pay, and most in one array.
_TOGETHER = 1 << 20
_FEW, _MANY = 24, 1 << 13

_IDS = pa.list_(pa.int32())


def read_ranks(path: str) -> dict[bytes, int]:
    """The ranks of a vocabulary file: a line for each token, base64 and rank."""
    with open(path, "rb") as file:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, file)}


def merged(piece: bytes, ranks: dict[bytes, int]) -> tuple[int, ...]:
    """Ids of one pre-token: the pair of lowest rank is joined, the leftmost first, until none is left."""
    whole = ranks.get(piece)
    if whole is not None:
        return (whole,)
    parts = [piece[i : i + 1] for i in range(len(piece))]
    return _merged_long(parts, ranks) if len(parts) > _SHORT else _merged_short(parts, ranks)


def _merged_short(parts: list[bytes], ranks: dict[bytes, int]) -> tuple[int, ...]:
    rank = ranks.get
    pairs = [rank(a + b, _NONE) for a, b in itertools.pairwise(parts)]
    while pairs and (best := min(pairs)) != _NONE:
        i = pairs.index(best)
        parts[i : i + 2] = [parts[i] + parts[i + 1]]
        del pairs[i]
        if i:
            pairs[i - 1] = rank(parts[i - 1] + parts[i], _NONE)
        if i < len(pairs):
            pairs[i] = rank(parts[i] + parts[i + 1], _NONE)
    return tuple(ranks[p] for p in parts)


def _merged_long(parts: list[bytes | None], ranks: dict[bytes, int]) -> tuple[int, ...]:
    """The same with a heap over a linked list, in n log n."""
    n = len(parts)
    before, after = list(range(-1, n - 1)), list(range(1, n + 1))
    heap = [(r, i, 1, 1) for i in range(n - 1) if (r := ranks.get(parts[i] + parts[i + 1])) is not None]
    heapq.heapify(heap)

    def offer(i: int) -> None:
        j = after[i]
        if j < n and (r := ranks.get(parts[i] + parts[j])) is not None:
            heapq.heappush(heap, (r, i, len(parts[i]), len(parts[j])))

    while heap:
        _, i, left, right = heapq.heappop(heap)
        j = after[i]
        # outdated if either side has grown or gone since
        if parts[i] is None or len(parts[i]) != left or j >= n or len(parts[j]) != right:
            continue
        parts[i] += parts[j]
        parts[j] = None
        after[i] = after[j]
        if after[j] < n:
            before[after[j]] = i
        offer(i)
        if before[i] >= 0:
            offer(before[i])
    return tuple(ranks[p] for p in parts if p is not None)


class _Pairs:
    """The pairs of ids that make a token, sorted, and a table of the pairs of bytes."""

    def __init__(self, ranks: dict[bytes, int]):
        self.size = max(ranks.values(), default=0) + 1
        found = {}
        for token, rank in ranks.items():
            for i in range(1, len(token)):
                left, right = ranks.get(token[:i]), ranks.get(token[i:])
                if left is not None and right is not None:
                    found[left * self.size + right] = rank
        self.keys = np.array([*sorted(found), np.iinfo(np.int64).max])
        self.ranks = np.array([*map(found.get, sorted(found)), _NO_PAIR], np.int32)
        letters = [bytes([b]) for b in range(256)]
        #: Ids of the bytes; without all of them pre-tokens are merged one by one.
        self.letters = np.array([ranks[x] for x in letters], np.int32) if all(x in ranks for x in letters) else None
        self.first = np.array([ranks.get(a + b, _NO_PAIR) for a in letters for b in letters], np.int32)

    def of(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        keys = left.astype(np.int64) * self.size + right
        at = np.searchsorted(self.keys, keys)
        return np.where(self.keys[at] == keys, self.ranks[at], np.int32(_NO_PAIR))


def _merged_together(pieces: list[bytes], pairs: _Pairs) -> list[bytes]:
    """Packed ids of pre-tokens of one length. In each round every one of them that has a pair joins its leftmost one of lowest rank, so all
    that go on have the same number of parts."""
    found: list = [None] * len(pieces)
    raw = np.frombuffer(b"".join(pieces), np.uint8).reshape(len(pieces), -1)
    parts, ranks = pairs.letters[raw], pairs.first[raw[:, :-1].astype(np.int64) * 256 + raw[:, 1:]]
    owners = np.arange(len(pieces))
    while len(owners):
        rows = np.arange(len(owners))
        best = ranks.argmin(axis=1) if ranks.shape[1] else None
        low = np.full(len(owners), _NO_PAIR) if best is None else ranks[rows, best]
        done = low == _NO_PAIR
        if done.any():
            packed, size = parts[done].tobytes(), parts.shape[1] * parts.itemsize
            for k, owner in enumerate(owners[done].tolist()):
                found[owner] = packed[k * size : (k + 1) * size]
            if best is None or done.all():
                break
            owners, parts, ranks, best, low, rows = owners[~done], parts[~done], ranks[~done], best[~done], low[~done], rows[: -done.sum()]
        n, width = parts.shape
        parts[rows, best] = low
        stays = np.ones((n, width), bool)
        stays[rows, best + 1] = False
        parts = parts[stays].reshape(n, width - 1)
        stays = np.ones((n, width - 1), bool)
        stays[rows, best] = False
        ranks = ranks[stays].reshape(n, width - 2)
        left, right = np.flatnonzero(best > 0), np.flatnonzero(best < width - 2)
        ranks[left, best[left] - 1] = pairs.of(parts[left, best[left] - 1], low[left])
        ranks[right, best[right]] = pairs.of(low[right], parts[right, best[right] + 1])
    return found


def _packed(ids: tuple[int, ...]) -> bytes:
    return array("i", ids).tobytes()


def merged_all(pieces: list[bytes], ranks: dict[bytes, int], pairs: _Pairs) -> list[bytes]:
    """``merged`` of many different pre-tokens. Ids are packed, four bytes each: they take little memory, and none of
    the collector's time."""
    found: list = [None] * len(pieces)
    by_length = defaultdict(list)
    for i, piece in enumerate(pieces):
        if (whole := ranks.get(piece)) is not None:
            found[i] = _packed((whole,))
        else:
            by_length[len(piece)].append(i)
    for length, members in by_length.items():
        if length < 2 or length > _SHORT or len(members) < _FEW or pairs.letters is None:
            for i in members:
                found[i] = _packed(merged(pieces[i], ranks))
        else:
            for start in range(0, len(members), _MANY):
                some = members[start : start + _MANY]
                for i, ids in zip(some, _merged_together([pieces[i] for i in some], pairs)):
                    found[i] = ids
    return found


def _shared(docs: DataFrame, ranks_path: str):
    """The ranks and pairs, broadcast, and beside them the memory of a worker: pre-tokens and their ids. A worker
    keeps a broadcast value from task to task, so what one task has merged the next one knows."""
    ranks = read_ranks(ranks_path)
    return docs.sparkSession.sparkContext.broadcast((ranks, [{}, {}], _Pairs(ranks)))


class _Encoder:
    """Splits and merges. Of the two halves of ``memory`` the younger is written; when it is full it becomes
    the older one, and what is still asked for moves on."""

    def __init__(self, ranks: dict[bytes, int], memory: list[dict[str, bytes]], pattern: str, pairs: _Pairs | None = None):
        self.pieces = regex.compile(pattern).findall
        self.ranks, self.memory, self.pairs = ranks, memory, pairs or _Pairs(ranks)

    def known(self, lists: list[list[str]]) -> dict[str, bytes]:
        """The packed ids of all pre-tokens in the lists (and of others)."""
        young, old = self.memory
        lacking = set().union(*lists).difference(young)
        new = list(lacking.difference(old))
        fresh = {piece: old[piece] for piece in lacking.intersection(old)}
        fresh |= zip(new, merged_all([piece.encode() for piece in new], self.ranks, self.pairs))
        found = young | fresh
        for piece, ids in fresh.items():
            if len(piece) <= _SHORT:
                if len(young) >= _CACHED:
                    self.memory[:] = young, old = {}, young
                young[piece] = ids
        return found

    def taken_apart(self, texts: list[str]) -> Iterator[tuple[list[str], list[bytes]]]:
        """Of each text the pre-tokens and their packed ids."""
        ends = np.cumsum([len(t) for t in texts], dtype=np.int64) // _TOGETHER
        for _, some in itertools.groupby(zip(ends.tolist(), texts), key=lambda x: x[0]):
            lists = [self.pieces(text) for _, text in some]
            ids = self.known(lists).__getitem__
            for pieces in lists:
                yield pieces, list(map(ids, pieces))

    def encoded_all(self, texts: list[str]) -> Iterator[np.ndarray]:
        return (np.frombuffer(b"".join(ids), np.int32) for _, ids in self.taken_apart(texts))

    def encoded(self, text: str) -> np.ndarray:
        return next(self.encoded_all([text]))


def _encoder(shared, pattern: str) -> _Encoder:
    ranks, memory, pairs = shared.value
    return _Encoder(ranks, memory, pattern, pairs)


class _Decoder:
    """Bytes and decimal digits of every id, and from them the columns of the report."""

    def __init__(self, ranks: dict[bytes, int]):
        self.bytes = {rank: token for token, rank in ranks.items()}
        self.digits = {rank: b"%d" % rank for rank in self.bytes}

    def decoded(self, ids: list[int]) -> bytes:
        return b"".join(map(self.bytes.__getitem__, ids))

    def digests(self, ids: list[int]) -> tuple[int, str, str]:
        text = b" ".join(map(self.digits.__getitem__, ids))
        return len(ids), hashlib.sha256(text).hexdigest(), hashlib.sha256(self.decoded(ids)).hexdigest()


def _lists(arrays: list[np.ndarray], kind: pa.DataType) -> pa.Array:
    ends = np.cumsum([0, *(len(x) for x in arrays)])
    flat = np.concatenate(arrays) if arrays else np.empty(0, np.int64)
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat, kind))


def _with(batch: pa.RecordBatch, drop: str, **columns: pa.Array) -> pa.RecordBatch:
    kept = [c for c in batch.schema.names if c != drop]
    return pa.RecordBatch.from_arrays([batch[c] for c in kept] + list(columns.values()), [*kept, *columns])


def _small(batches: Iterator[pa.RecordBatch], rows: int = 512) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for start in range(0, batch.num_rows, rows):
            yield batch.slice(start, rows)


def _encode_whole(rows: DataFrame, ranks, pattern: str) -> DataFrame:
    def run(batches):
        encoder = _encoder(ranks, pattern)
        for batch in _small(batches):
            found = list(encoder.encoded_all(batch["text"].to_pylist()))
            yield _with(batch, "text", ids=_lists(found, pa.int32()))

    schema = rows.drop("text").withColumn("ids", F.array().cast("array<int>")).schema
    return rows.mapInArrow(run, schema)


_DIGESTS = "n_tokens long, ids_sha256 string, decoded_sha256 string"


def _digest_batch(batch: pa.RecordBatch, drop: str, found: list[tuple[int, str, str]]) -> pa.RecordBatch:
    n, ids, decoded = zip(*found) if found else ((), (), ())
    return _with(batch, drop, n_tokens=pa.array(n, pa.int64()), ids_sha256=pa.array(ids, pa.string()), decoded_sha256=pa.array(decoded, pa.string()))


def _digest_texts(rows: DataFrame, ranks, pattern: str, key: str = "doc_id") -> DataFrame:
    """Texts that need no cutting, encoded and decoded in one visit."""

    def run(batches):
        encoder, decoder = _encoder(ranks, pattern), _Decoder(ranks.value[0])
        for batch in _small(batches):
            yield _digest_batch(batch, "text", [decoder.digests(ids.tolist()) for ids in encoder.encoded_all(batch["text"].to_pylist())])

    return rows.select(key, "text").mapInArrow(run, f"{key} {rows.schema[key].dataType.simpleString()}, {_DIGESTS}")


def _digest_ids(rows: DataFrame, ranks) -> DataFrame:
    def run(batches):
        decoder = _Decoder(ranks.value[0])
        for batch in _small(batches, 1):
            yield _digest_batch(batch, "ids", [decoder.digests(ids) for ids in batch["ids"].to_pylist()])

    return rows.mapInArrow(run, f"content string, {_DIGESTS}")


def _cut(rows: DataFrame, chunk: int, overlap: int) -> DataFrame:
    """Texts as rows of chunks: ``content`` (of the text), ``chunk``, ``last``, ``start``, ``text``."""

    def run(batches):
        for batch in _small(batches, 1):
            for content, text in zip(batch["content"].to_pylist(), batch["text"].to_pylist()):
                starts = list(range(0, len(text), chunk))
                for at in range(0, len(starts), 64):
                    part = starts[at : at + 64]
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array([content] * len(part)),
                            pa.array([s // chunk for s in part], pa.int32()),
                            pa.array([s == starts[-1] for s in part]),
                            pa.array(part, pa.int64()),
                            pa.array([text[s : s + chunk + overlap] for s in part]),
                        ],
                        ["content", "chunk", "last", "start", "text"],
                    )

    return rows.select("content", "text").mapInArrow(run, "content string, chunk int, last boolean, start long, text string")


def _encode_chunks(chunks: DataFrame, ranks, pattern: str, look_ahead: int) -> DataFrame:
    """Chunks with where their pre-tokens begin, the last end that counts, and the ids."""

    def run(batches):
        encoder = _encoder(ranks, pattern)
        for batch in _small(batches, 64):
            starts, counts, ids, sure = [], [], [], []
            texts = batch["text"].to_pylist()
            for text, start, last, (pieces, found) in zip(texts, batch["start"].to_pylist(), batch["last"].to_pylist(), encoder.taken_apart(texts)):
                ends = np.cumsum([len(p) for p in pieces], dtype=np.int64)
                starts.append(start + np.concatenate([[0], ends[:-1]]))
                counts.append(np.fromiter(map(len, found), np.int32, len(found)) // 4)
                ids.append(np.frombuffer(b"".join(found), np.int32))
                sure.append(start + len(text) + (1 if last else -look_ahead - 1))
            yield _with(batch, "text", starts=_lists(starts, pa.int64()), counts=_lists(counts, pa.int32()), ids=_lists(ids, pa.int32()), sure=pa.array(sure, pa.int64()))

    schema = "content string, chunk int, last boolean, start long, starts array<long>, counts array<int>, ids array<int>, sure long"
    return chunks.mapInArrow(run, schema)


def _stitch(rows: pa.Table) -> pa.Table:
    """The ids of one text from its chunks, or null if two neighbours share no boundary."""
    rows = rows.sort_by("chunk")
    flat = lambda name, k: np.asarray(rows[name][k].values)
    content, parts, begin = rows["content"][0].as_py(), [], 0
    for k in range(rows.num_rows):
        starts, end = flat("starts", k), None
        if k + 1 < rows.num_rows:
            own = starts[(starts >= rows["start"][k + 1].as_py()) & (starts <= rows["sure"][k].as_py())]
            common = np.intersect1d(own, flat("starts", k + 1))
            if len(common) == 0:
                return pa.table({"content": [content], "ids": pa.array([None], _IDS)})
            end = common[0]
        offsets = np.concatenate([[0], np.cumsum(flat("counts", k))])
        first = np.searchsorted(starts, begin)
        stop = len(starts) if end is None else np.searchsorted(starts, end)
        parts.append(flat("ids", k)[offsets[first] : offsets[stop]])
        begin = end
    return pa.table({"content": [content], "ids": _lists([np.concatenate(parts)], pa.int32())})


def _parted(docs: DataFrame, chunk: int) -> tuple[DataFrame, DataFrame]:
    """Texts encoded where they lie, and longer ones with the digest of their ``content``."""
    rows = docs.select("doc_id", F.coalesce(docs["text"], F.lit("")).alias("text"))
    long = rows.filter(F.length("text") > chunk).withColumn("content", F.sha2(F.col("text").cast("binary"), 256))
    return rows.filter(F.length("text") <= chunk), long


def _stitched(long: DataFrame, ranks, pattern: str, chunk: int, overlap: int, look_ahead: int) -> tuple[DataFrame, DataFrame | None]:
    """``content`` and ``ids`` of each different long text, and the texts that share no boundary (``content``, ``text``), if any."""
    chunks = _cut(long, chunk, overlap).dropDuplicates(["content", "chunk"])
    encoded = _encode_chunks(chunks, ranks, pattern, look_ahead)
    stitched = staged(encoded.groupBy("content").applyInArrow(_stitch, "content string, ids array<int>"), "stitched")
    unshared = stitched.filter("ids is null").select("content")
    if unshared.isEmpty():
        return stitched, None
    texts = long.join(if_few(unshared), "content", "left_semi").select("content", "text").dropDuplicates(["content"])
    return stitched.filter("ids is not null"), texts


def encode(docs: DataFrame, ranks_path: str, pattern: str, chunk: int = CHUNK, overlap: int = OVERLAP, look_ahead: int = LOOK_AHEAD) -> DataFrame:
    """``doc_id`` and ``ids`` (array of int) of every document. The vocabulary, a file of fixed size, is broadcast.
    ``look_ahead`` belongs to the pattern: characters that it reads past the end of a pre-token to decide on it."""
    ranks = _shared(docs, ranks_path)
    in_small_batches(docs.sparkSession)
    short, long = _parted(docs, chunk)
    stitched, unshared = _stitched(long, ranks, pattern, chunk, overlap, look_ahead)
    if unshared is not None:
        stitched = stitched.unionByName(_encode_whole(unshared, ranks, pattern))
    whole = attach(long.drop("text"), stitched, "content", spread_by=("doc_id",))
    return _encode_whole(short, ranks, pattern).unionByName(whole.select("doc_id", "ids"))


def decode(encoded: DataFrame, ranks_path: str) -> DataFrame:
    """``encoded`` with ``decoded`` (binary): the bytes of the ids one after the other."""
    ranks = _shared(encoded, ranks_path)

    def run(batches):
        decoder = _Decoder(ranks.value[0])
        for batch in _small(batches, 1):
            found = [decoder.decoded(ids) for ids in batch["ids"].to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.binary())], [*batch.schema.names, "decoded"])

    return encoded.mapInArrow(run, encoded.withColumn("decoded", F.lit(b"")).schema)


def report(docs: DataFrame, ranks_path: str, pattern: str, chunk: int = CHUNK, overlap: int = OVERLAP, look_ahead: int = LOOK_AHEAD) -> DataFrame:
    """Digests of ids and decoded bytes. Those of a long text are taken once for all documents that hold it, and
    only they are joined, salted where one text is in very many documents."""
    ranks = _shared(docs, ranks_path)
    in_small_batches(docs.sparkSession)
    short, long = _parted(docs, chunk)
    stitched, unshared = _stitched(long, ranks, pattern, chunk, overlap, look_ahead)
    digests = _digest_ids(stitched, ranks)
    if unshared is not None:  # in one visit: a task has one Python worker
        digests = digests.unionByName(_digest_texts(unshared, ranks, pattern, "content"))
    digests = staged(digests, "digests")
    whole = attach(long.drop("text"), digests, "content", spread_by=("doc_id",)).drop("content")
    return _digest_texts(short, ranks, pattern).unionByName(whole)
