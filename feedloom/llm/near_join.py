"""Similarity join on word shingles by a MinHash LSH forest.

A text is its set of five-word shingles. Each tree is a trie that files all sets under a signature of
its own. Matched prefixes are shortened from the longest one as far as the target recall asks for, and
no further than the sets stand it: with the first trees a pair of the least similarity needs short prefixes. Where
a short prefix is crowded with sets that part further down in the trie, it stays long, and its sets are filed in as many
further trees as long prefixes need for that recall. Sets with equal prefixes are a group, and every
pair of a group is compared, whatever the size of the group. Small groups are listed as pairs.
A larger one is dealt into blocks, and each two blocks meet in a task that counts their common
shingles and hands on the number of links of each set and the edges that hold the linked ones together, never the
pairs. Of the trees in which two sets meet the first one counts them.

Documents with equal sets form one node, so copies are never expanded into pairs. Texts of
one to four words are one shingle: only equal ones are linked. Empty and null texts have
no shingle, no link and a class of their own. The smallest ``doc_id`` names a class (a null id
is passed over; a class of null ids only has a null name). Rows that repeat an id and its text
count as copies.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from feedloom.llm.common import staged
from feedloom.operators.joins import attach, drop_matching, if_few, keep_matching

SHINGLE = 5
#: Similarity as a fraction, so that the comparison is exact.
SIMILAR = (4, 5)
#: Trees, and the values of the longest prefix.
TREES, VALUES = 16, 8
RECALL = 0.999
#: Groups beyond this size have longer prefixes if these leave at most this share of the comparisons, further trees included.
CROWD, WORTH = 128, 0.5
#: Groups up to this size are listed as pairs.
LISTED = 8
#: Larger ones are dealt into blocks of about so many sets, and of about so many shingles at most.
BLOCK, BLOCK_SHINGLES = 128, 4_000_000
#: Shingles that are counted at a time.
_COLUMNS = 4096

_WORDS_CACHED = 400_000
_ODD = np.array([0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], np.uint64)
_LONG = 1000
_SPACE = bytes.maketrans(b"\t\n\x0b\x0c\r", b"     ")


def depth_for(recall: float, similarity: float, trees: int, values: int) -> int:
    """The longest prefix with which a pair of this similarity is met in some tree with the wanted probability."""
    for depth in range(values, 1, -1):
        if 1 - (1 - similarity**depth) ** trees >= recall:
            return depth
    return 1


def trees_for(recall: float, similarity: float, depth: int) -> int:
    """The fewest trees in which a pair of this similarity shares a prefix of this length somewhere with the wanted probability."""
    return math.ceil(math.log(1 - recall) / math.log(1 - similarity**depth))


class _Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= _WORDS_CACHED:
            self.clear()
        self[word] = found = xxhash.xxh64_intdigest(word)
        return found


def _shingles(text: str, hashes: _Hashes) -> np.ndarray:
    """The sorted distinct shingles, as 64-bit hashes."""
    words = text.encode().translate(_SPACE).split(b" ")
    h = np.fromiter((hashes[w] for w in words if w), np.uint64)
    if len(h) == 0:
        return h
    width = min(SHINGLE, len(h))
    n = len(h) - width + 1
    s = np.zeros(n, np.uint64)
    for j in range(width):
        s += h[j : j + n] * _ODD[j]
    s = (s ^ (s >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    return np.unique(s ^ (s >> np.uint64(29)))


def _functions(trees: int, values: int, seed: int = 20240202) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(seed)
    count = trees * values
    return rng.integers(0, 1 << 32, count, dtype=np.uint32) | np.uint32(1), rng.integers(0, 1 << 32, count, dtype=np.uint32)


def _signature(shingles: np.ndarray, factors: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """16 bits of the smallest hash under each function."""
    low = shingles.astype(np.uint32)
    high = (shingles >> np.uint64(32)).astype(np.uint32)
    half = len(factors) // 2
    least = np.full(len(factors), 0xFFFFFFFF, np.uint32)
    for start in range(0, len(shingles), 1024):
        for part, where in ((low, slice(0, half)), (high, slice(half, None))):
            block = part[start : start + 1024, None] * factors[None, where] + offsets[None, where]
            np.minimum(least[where], block.min(axis=0), out=least[where])
    return ((least * np.uint32(0x85EBCA6B)) >> np.uint32(16)).astype(">u2")


def _node(shingles: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(shingles.tobytes())


def _keys(signature: bytes, trees: int, values: int, depth: int, seed: int) -> np.ndarray:
    """The prefix of each tree, hashed; ``seed`` tells the keys of one length or set of trees from others."""
    found = [xxhash.xxh64_intdigest(signature[2 * t * values : 2 * (t * values + depth)], seed + t) for t in range(trees)]
    return np.array(found, np.uint64).view(np.int64)


def _prepared(rows: DataFrame, trees: int, depth: int, values: int | None = None) -> DataFrame:
    """``doc_id``, ``mark``, ``node`` (of the shingle set; null for none), ``n`` (shingles), and the prefixes of each tree: ``keys`` of ``depth`` values, ``longer`` of all."""
    values = values or depth

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, functions = _Hashes(), _functions(trees, values)
        for batch in batches:
            for start in range(0, batch.num_rows, 1024):
                part = batch.slice(start, 1024)
                sets = [_shingles(t or "", hashes) for t in part["text"].to_pylist()]
                signatures = [_signature(s, *functions).tobytes() if len(s) else None for s in sets]
                yield pa.RecordBatch.from_arrays(
                    [
                        part["doc_id"],
                        part["mark"],
                        pa.array([_node(s) if len(s) else None for s in sets], pa.binary()),
                        pa.array([len(s) for s in sets], pa.int32()),
                        pa.array([s and _keys(s, trees, values, depth, 0) for s in signatures], pa.list_(pa.int64())),
                        pa.array([s and _keys(s, trees, values, values, _LONG) for s in signatures], pa.list_(pa.int64())),
                    ],
                    ["doc_id", "mark", "node", "n", "keys", "longer"],
                )

    marked = rows.select("doc_id", "text", _mark(F.col("doc_id"), F.col("text")).alias("mark"))
    return marked.mapInArrow(run, "doc_id long, mark binary, node binary, n int, keys array<long>, longer array<long>")


def _crowded(nodes: DataFrame, agreement: float) -> DataFrame:
    """``node`` and ``places``: the trees in which its short prefix is crowded, and the longer one is shared by less than this share of the pairs."""
    filed = nodes.select("node", F.posexplode(F.arrays_zip("keys", "longer")).alias("place", "key")).select("node", "place", "key.keys", "key.longer")
    ends = filed.groupBy("keys", "longer").agg(F.count("*").alias("n"))
    groups = ends.groupBy("keys").agg(F.sum("n").alias("many"), F.sum(F.col("n") * (F.col("n") - 1)).alias("agreed"))
    unlike = F.col("agreed") < agreement * F.col("many") * (F.col("many") - 1)
    crowds = staged(groups.filter((F.col("many") > CROWD) & unlike).select("keys"), "crowds")
    rows = attach(filed.select("node", "place", "keys"), crowds, "keys", ("node",))
    return staged(rows.groupBy("node").agg(F.collect_set("place").alias("places")), "crowded")


def _further(docs: DataFrame, wanted: DataFrame, nodes: DataFrame, trees: int, values: int) -> DataFrame:
    """``node`` and its long prefixes in further trees (``further``)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, functions = _Hashes(), _functions(trees, values, 20240203)
        for batch in batches:
            for start in range(0, batch.num_rows, 1024):
                sets = [_shingles(t or "", hashes) for t in batch["text"].slice(start, 1024).to_pylist()]
                sets = [s for s in sets if len(s)]
                keys = [_keys(_signature(s, *functions).tobytes(), trees, values, values, 2 * _LONG) for s in sets]
                yield pa.RecordBatch.from_arrays([pa.array([_node(s) for s in sets], pa.binary()), pa.array(keys, pa.list_(pa.int64()))], ["node", "further"])

    found = _texts_of(docs, wanted, nodes).mapInArrow(run, "node binary, further array<long>")
    # a repeated id may bring a text of another node
    return found.join(wanted, "node").dropDuplicates(["node"])


def _lengthened(docs: DataFrame, nodes: DataFrame, trees: int, values: int, recall: float) -> DataFrame:
    """The nodes with the ``keys`` under which they are compared: short prefixes, and for sets of crowded ones long prefixes instead."""
    # a tenth of the misses of the short prefixes come on top
    more = max(1, trees_for(1 - (1 - recall) / 10, SIMILAR[0] / SIMILAR[1], values) - trees)
    crowded = _crowded(nodes, WORTH * trees / (trees + more))
    if crowded.isEmpty():
        return nodes.drop("longer")
    found = nodes.join(_further(docs, crowded, nodes, more, values), "node", "left")
    short = F.transform("keys", lambda key, place: F.when(~F.array_contains("places", place), key))
    keys = F.when(F.col("places").isNull(), F.col("keys")).otherwise(F.concat(short, "longer", "further"))
    return staged(found.withColumn("keys", keys).drop("longer", "further", "places"), "lengthened")


def _members(nodes: DataFrame) -> DataFrame:
    """``node`` and ``at`` for every group (a key) of two sets or more, with the sets in it (``many``) and its ``blocks``."""
    filed = nodes.select("node", "n", F.explode(F.array_distinct("keys")).alias("at")).filter("at is not null")
    groups = filed.groupBy("at").agg(F.count("*").alias("many"), F.sum("n").alias("shingles")).filter("many > 1")
    blocks = F.least("many", F.greatest(F.ceil(F.col("many") / BLOCK), F.ceil(F.col("shingles") / BLOCK_SHINGLES))).cast("int")
    groups = staged(groups.select("at", "many", blocks.alias("blocks")), "groups")
    return staged(attach(filed.select("node", "at"), groups, "at", ("node",)), "members")


def _first_common(x: str, y: str) -> str:
    return f"get(filter(zip_with({x}, {y}, (p, q) -> if(p = q, p, null)), p -> p is not null), 0)"


def _pairs(members: DataFrame, nodes: DataFrame) -> DataFrame:
    """Pairs (``a`` < ``b``) of possible sizes that meet first in a small group, once each."""
    small = staged(members.filter(F.col("many") <= LISTED).select("node", "at").join(nodes.select("node", "n", "keys"), "node"), "small-groups")
    one = small.select("at", F.col("node").alias("a"), F.col("n").alias("na"), F.col("keys").alias("ka"))
    two = small.select("at", F.col("node").alias("b"), F.col("n").alias("nb"), F.col("keys").alias("kb"))
    met = one.join(two, "at").filter("a < b")
    sizes = F.least("na", "nb").cast("long") * SIMILAR[1] >= F.greatest("na", "nb").cast("long") * SIMILAR[0]
    return met.filter(sizes & (F.expr(_first_common("ka", "kb")) == F.col("at"))).select("a", "b")


def _common(sets: list[np.ndarray], left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """How many shingles each set of ``left`` (places in ``sets``) shares with each of ``right``."""
    found = np.zeros((len(left), len(right)), np.int64)
    of = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    _, shingle, uses = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = uses[shingle] > 1
    of, shingle = of[shared], shingle[shared]
    order = np.argsort(shingle, kind="stable")
    of = of[order]
    shingle = np.unique(shingle[order], return_inverse=True)[1]
    total = int(shingle[-1]) + 1 if len(shingle) else 0
    for start in range(0, total, _COLUMNS):
        low, high = np.searchsorted(shingle, (start, start + _COLUMNS))
        held = np.zeros((len(sets), min(_COLUMNS, total - start)), np.float32)
        held[of[low:high], shingle[low:high] - start] = 1
        # sums of at most 4,096 ones are exact
        found += (held[left] @ held[right].T).astype(np.int64)
    return found


def _forest(linked: np.ndarray) -> list[tuple[int, int]]:
    """Edges that connect what the symmetric matrix connects, without a circle."""
    edges, seen = [], np.zeros(len(linked), bool)
    for root in range(len(linked)):
        if seen[root]:
            continue
        seen[root], queue = True, [root]
        while queue:
            i = queue.pop()
            new = np.flatnonzero(linked[i] & ~seen)
            seen[new] = True
            edges += [(i, int(j)) for j in new]
            queue += new.tolist()
    return edges


def _padded(lists: pa.ListArray) -> np.ndarray:
    """Lists of keys as rows of one matrix; 0 stands for none."""
    sizes = np.diff(lists.offsets.to_numpy())
    out = np.zeros((len(lists), sizes.max(initial=0)), np.int64)
    out[np.arange(out.shape[1]) < sizes[:, None]] = lists.flatten().fill_null(0).to_numpy()
    return out


def _block(rows: pa.Table) -> pa.Table:
    """Of two blocks of a group (or one with itself): ``a`` and ``b`` of edges, and ``a`` and ``linked`` of counts."""
    at, low, high = (rows[c][0].as_py() for c in ("at", "low", "high"))
    nodes, n, size = rows["node"].to_pylist(), rows["n"].to_numpy().astype(np.int64), rows["size"].to_numpy()
    keys = _padded(rows["keys"].combine_chunks())
    sets = [np.frombuffer(s, np.uint64) for s in rows["shingles"].to_pylist()]
    block = rows["block"].to_numpy()
    left, right = np.flatnonzero(block == low), np.flatnonzero(block == high)
    edges, counts = [], np.zeros(len(nodes), np.int64)
    if len(left) and len(right):
        common = _common(sets, left, right)
        similar = common * SIMILAR[1] >= (n[left][:, None] + n[right][None, :] - common) * SIMILAR[0]
        equal = (keys[left][:, None, :] == keys[right][None, :, :]) & (keys[left] != 0)[:, None, :]
        first = np.take_along_axis(keys[left], equal.argmax(axis=2), axis=1)
        similar &= equal.any(axis=2) & (first == at)
        if low == high:
            np.fill_diagonal(similar, False)
        counts[left] = similar @ size[right]
        if low != high:
            counts[right] = similar.T @ size[left]
        linked = np.zeros((len(nodes), len(nodes)), bool)
        linked[np.ix_(left, right)] = similar
        edges = _forest(linked | linked.T)
    some = np.flatnonzero(counts)
    ends = [(nodes[i], nodes[j]) for i, j in edges]
    return pa.table(
        {
            "a": pa.array([min(e) for e in ends] + [nodes[i] for i in some], pa.binary()),
            "b": pa.array([max(e) for e in ends] + [None] * len(some), pa.binary()),
            "linked": pa.array([None] * len(ends) + counts[some].tolist(), pa.int64()),
        }
    )


def _blocks(members: DataFrame, nodes: DataFrame, sets: DataFrame) -> DataFrame:
    """The rows of ``_block`` for every two blocks of the large groups."""
    large = members.filter(F.col("many") > LISTED).withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    met = large.select("node", "at", "block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    met = met.select("node", "at", "block", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"))
    full = met.join(nodes.select("node", "n", "size", "keys").join(sets, "node"), "node")
    return full.groupBy("at", "low", "high").applyInArrow(_block, "a binary, b binary, linked long")


def _sets(rows: DataFrame) -> DataFrame:
    """``node`` and its ``shingles`` (64-bit hashes, sorted, as bytes)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = _Hashes()
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                sets = [_shingles(t or "", hashes) for t in batch["text"].slice(start, 256).to_pylist()]
                sets = [s for s in sets if len(s)]
                yield pa.RecordBatch.from_arrays([pa.array([_node(s) for s in sets], pa.binary()), pa.array([s.tobytes() for s in sets], pa.binary())], ["node", "shingles"])

    return rows.select("text").mapInArrow(run, "node binary, shingles binary")


def _verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs whose sets are similar."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                part = batch.slice(start, 256)
                keep = []
                for x, y in zip(part["sa"].to_pylist(), part["sb"].to_pylist()):
                    x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                    both = len(np.intersect1d(x, y, assume_unique=True))
                    keep.append(both * SIMILAR[1] >= (len(x) + len(y) - both) * SIMILAR[0])
                yield part.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    left = sets.select(F.col("node").alias("a"), F.col("shingles").alias("sa"))
    right = sets.select(F.col("node").alias("b"), F.col("shingles").alias("sb"))
    return pairs.select("a", "b").join(left, "a").join(right, "b").select("a", "b", "sa", "sb").mapInArrow(run, "a binary, b binary")


def components(edges: DataFrame) -> DataFrame:
    """``node`` and ``label`` for the nodes of ``edges`` (``a``, ``b``); equal labels are connected.

    Each round maps a node to the least of its neighbours' least neighbours and contracts the
    graph. Names are hashes, so the number of nodes falls by a constant factor each time.
    """
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    labels, graph = None, staged(both.distinct(), "graph")
    while True:
        parent = staged(graph.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("to")), "parents")
        up = parent.select(F.col("a").alias("to"), F.col("to").alias("top"))
        parent = staged(attach(parent, up, "to", ("a",)).select("a", F.col("top").alias("to")), "parents")
        if labels is None:
            labels = parent.select(F.col("a").alias("node"), F.col("to").alias("label"))
        else:
            labels = attach(labels, parent.select(F.col("a").alias("label"), "to"), "label", ("node",), "left")
            labels = staged(labels.select("node", F.coalesce("to", "label").alias("label")), "labels")
        graph = attach(graph, parent, "a", ("b",)).select(F.col("to").alias("a"), "b")
        graph = attach(graph, parent.select(F.col("a").alias("b"), F.col("to").alias("c")), "b", ("a",)).select("a", F.col("c").alias("b"))
        graph = staged(graph.filter("a <> b").distinct(), "graph")
        if graph.isEmpty():
            return labels


def _texts_of(docs: DataFrame, wanted: DataFrame, nodes: DataFrame) -> DataFrame:
    """The texts of the documents with the first id of each wanted node."""
    ids = nodes.join(wanted, "node", "left_semi").select(F.col("first_id").alias("__id"))
    # while the candidates are few, the documents stay where they are
    ids = if_few(staged(ids, "candidate-ids"))
    return docs.select("doc_id", "text").join(ids, F.col("doc_id").eqNullSafe(F.col("__id")), "left_semi")


def _shingled(docs: DataFrame, wanted: DataFrame, nodes: DataFrame) -> DataFrame:
    """The ``_sets`` of the wanted nodes, from the documents' texts."""
    return staged(_sets(_texts_of(docs, wanted, nodes)).join(wanted, "node", "left_semi").dropDuplicates(["node"]), "sets")


def filed(docs: DataFrame, trees: int = TREES, values: int = VALUES, recall: float = RECALL) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Documents, their nodes, and the ``_members`` of all groups that are compared."""
    depth = depth_for(recall, SIMILAR[0] / SIMILAR[1], trees, values)
    prepared = staged(_prepared(docs, trees, depth, values), "signatures")
    one = prepared.filter("node is not null").groupBy("node")
    first = [F.first(c).alias(c) for c in ("n", "keys", "longer")]
    nodes = staged(one.agg(F.min("doc_id").alias("first_id"), F.count("*").alias("size"), *first), "nodes")
    nodes = _lengthened(docs, nodes, trees, values, recall) if values > depth else nodes.drop("longer")
    return prepared, nodes, _members(nodes)


def joined(
    docs: DataFrame, trees: int = TREES, values: int = VALUES, recall: float = RECALL
) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Documents (``doc_id``, ``mark``, ``node``), nodes (``node``, ``first_id``, ``size``), the documents of other sets that each
    linked node is similar to (``node``, ``linked``) and its label (``__node``, ``__label``)."""
    prepared, nodes, members = filed(docs, trees, values, recall)
    pairs = staged(_pairs(members, nodes), "pairs")
    large = members.filter(F.col("many") > LISTED).select("node")
    wanted = pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))).unionByName(large).distinct()
    sets = _shingled(docs, staged(wanted, "candidates"), nodes)
    links = staged(_verified(pairs, sets), "links")
    blocks = staged(_blocks(members, nodes, sets), "blocks")
    ends = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    single = ends.join(nodes.select(F.col("node").alias("b"), F.col("size").alias("linked")), "b").select("a", "linked")
    counts = single.unionByName(blocks.filter("b is null").select("a", "linked"))
    linked = counts.groupBy(F.col("a").alias("node")).agg(F.sum("linked").alias("linked"))
    edges = links.unionByName(blocks.filter("b is not null").select("a", "b"))
    found = components(edges) if not edges.isEmpty() else edges.select(F.col("a").alias("node"), F.col("b").alias("label"))
    labels = found.select(F.col("node").alias("__node"), F.col("label").alias("__label"))
    return prepared.select("doc_id", "mark", "node"), nodes.select("node", "first_id", "size"), linked, labels


def classified(docs: DataFrame, **options) -> DataFrame:
    """One row per document: ``doc_id``, ``class_id``, ``class_size``, ``n_links``, ``node``, ``label`` (of the class; null without a link or copy) and ``mark``.

    ``n_links`` counts the other documents with an equal set and those of linked sets.
    """
    rows, nodes, linked, labels = joined(docs, **options)
    placed = nodes.join(labels, nodes["node"] == labels["__node"], "left").withColumn("label", F.coalesce("__label", "node")).drop("__node", "__label")
    classes = placed.groupBy("label").agg(F.min("first_id").alias("class_id"), F.sum("size").alias("class_size"))
    many = classes.filter("class_size > 1")
    info = placed.join(many, "label").join(linked, "node", "left").select("node", "label", "class_id", "class_size", (F.col("size") - 1 + F.coalesce("linked", F.lit(0))).alias("n_links"))
    info = staged(info, "classes")
    alone = F.col("class_size").isNull()
    return attach(rows, info, "node", ("doc_id",), "left").select(
        "doc_id",
        F.when(alone, F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"),
        F.coalesce("class_size", F.lit(1)).cast("long").alias("class_size"),
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        "node",
        "label",
        "mark",
    )


def report(docs: DataFrame) -> DataFrame:
    return classified(docs).select("doc_id", "class_id", "class_size", "n_links")


def _mark(doc_id: Column, text: Column) -> Column:
    """What tells documents apart: id and digest of the text; null for a null text."""
    return F.concat(F.unhex(F.sha2(text.cast("binary"), 256)), F.coalesce(F.encode(doc_id.cast("string"), "utf-8"), F.lit(b"")))


def kept(docs: DataFrame, **options) -> DataFrame:
    """One document of each class, with all its columns: the one with the smallest id.

    A document is an id with a text. Rows that repeat both are one document; one of them stays,
    chosen by the hash of all its columns. Other rows of the same id, or without one, are judged on their own.
    """
    linked = classified(docs, **options).filter("class_size > 1").select("label", "doc_id", F.col("mark").alias("__mark"))
    # ids that are null come last
    first = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "__mark"))["__mark"]
    marks = staged(linked.groupBy("label", "doc_id", "__mark").agg(F.count("*").alias("__n")), "linked")
    stays = staged(marks.groupBy("label").agg(first.alias("__mark")), "first-of-class").select("__mark")
    twice = staged(marks.filter("__n > 1").join(stays, "__mark", "left_semi").select("__mark"), "written-twice")
    out = staged(marks.select("__mark").join(stays, "__mark", "left_anti").unionByName(twice), "left-out")
    names = tuple(docs.columns)
    marked = docs.withColumn("__mark", _mark(docs["doc_id"], docs["text"]))
    stay = drop_matching(marked, out, "__mark", names).select(*names)
    if twice.isEmpty():
        return stay
    again = keep_matching(marked, twice, "__mark", names)
    one = again.groupBy("__mark").agg(F.min_by(F.struct(*names), F.xxhash64(*names)).alias("__row"))
    return stay.unionByName(one.select("__row.*"))
