import hashlib
import random

import public_tokenizers
import pytest
import tiktoken

from feedloom.llm import bpe

PATH, PATTERN = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
RANKS = bpe.read_ranks(PATH)
LIBRARY = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=RANKS, special_tokens={})

TEXTS = [
    "Hello world's best, we're done!! 123 4567  \n\n  tabs\t\tand spaces   ",
    "",
    "   ",
    "'s 't're' 'll '",
    "Ünïcödé, 数字 and 🎉🎉 emoji   nbsp   line \x1c\x1d sep \x85",
    "<|endoftext|> is text",
    "a" * 3000,
    "ab" * 2000 + " " * 500 + "x",
    "!?" * 900 + "1" * 900,
    ("word, " * 50 + "\n" * 40 + " it's they're ") * 30,
    "数" * 700 + " " + "字" * 300,
]


def library(text):
    ids = LIBRARY.encode_ordinary(text)
    return len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(text.encode()).hexdigest()


def found(docs, **sizes):
    return {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in bpe.report(docs, PATH, PATTERN, **sizes).collect()}


@pytest.mark.parametrize("sizes", [{}, {"chunk": 97, "overlap": 41}, {"chunk": 64, "overlap": 9}])
def test_as_the_library_does(make, sizes):
    assert found(make(*TEXTS), **sizes) == {i: library(t) for i, t in enumerate(TEXTS)}


def test_both_ways_of_merging_agree():
    for word in ("internationalisation" * 4, "数字" * 30, "aaaaaaaaaa" * 9, "\x00\xff" * 40):
        parts = [bytes([b]) for b in word.encode()]
        assert bpe._merged_long(list(parts), RANKS) == bpe._merged_short(list(parts), RANKS) == tuple(LIBRARY._encode_single_piece(word.encode()))


def test_awkward_rows(awkward):
    for sizes in ({}, {"chunk": 500, "overlap": 60}):
        rows = bpe.report(awkward, PATH, PATTERN, **sizes).collect()
        want = [(r.doc_id, *library(r.text or "")) for r in awkward.collect()]
        assert sorted(map(tuple, rows), key=repr) == sorted(want, key=repr)
    assert bpe.report(awkward.limit(0), PATH, PATTERN).count() == 0


def test_decoding_gives_the_bytes_back(make):
    docs = make(*TEXTS)
    decoded = bpe.decode(bpe.encode(docs, PATH, PATTERN), PATH).collect()
    assert {r.doc_id: bytes(r.decoded) for r in decoded} == {i: t.encode() for i, t in enumerate(TEXTS)}


def test_a_worker_remembers_a_bounded_number_of_pre_tokens():
    memory = [{}, {}]
    encoder = bpe._Encoder(RANKS, memory, PATTERN)
    encoder.encoded(" ".join(f"{i:x}".translate(str.maketrans("0123456789", "ghijklmnop")) for i in range(300_000)))
    assert 60_000 <= sum(map(len, memory)) <= 130_000


def test_new_pre_tokens_are_merged_side_by_side(monkeypatch):
    """As the library merges each, and hardly any of them in a call of its own."""
    single, own = [], bpe.merged
    monkeypatch.setattr(bpe, "merged", lambda piece, ranks: single.append(piece) or own(piece, ranks))
    rng = random.Random(1)
    letters = ["abcdefghijklmnopqrstuvwxyz", "ab", "aeé数字🎉", "0123456789", "\x01\x7f\x80"]
    words = list({"".join(rng.choice(letters[i % 5]) for _ in range(rng.randint(1, 30))) for i in range(20_000)} | {"x" * 200})
    text = " ".join(words)
    encoder = bpe._Encoder(RANKS, [{}, {}], PATTERN)
    assert list(encoder.encoded(text)) == LIBRARY.encode_ordinary(text) == list(encoder.encoded(text))
    assert len(single) < len(words) / 10
    pieces = [word.encode() for word in words]
    packed = bpe.merged_all(pieces, RANKS, encoder.pairs)
    assert packed == [bpe._packed(own(piece, RANKS)) for piece in pieces]
    # a vocabulary without some of the bytes
    some = {token: rank for token, rank in RANKS.items() if token != b"\x00"}
    assert bpe.merged_all(pieces, some, bpe._Pairs(some)) == packed


def test_a_task_has_one_python_step(spark, make, monkeypatch):
    """Texts without a shared boundary are encoded and digested in one visit, and batches for Python are small."""
    plans, own = [], bpe.staged
    monkeypatch.setattr(bpe, "staged", lambda rows, name: plans.append((name, rows)) or own(rows, name))
    spark.conf.unset("spark.sql.execution.arrow.maxBytesPerBatch")
    texts = ["a" * 3000, "word " * 900]
    assert found(make(*texts), chunk=97, overlap=41) == {i: library(t) for i, t in enumerate(texts)}
    digests = dict(plans)["digests"]._jdf.queryExecution().analyzed()
    assert digests.nodeName() == "Union" and digests.toString().count("MapInArrow") == 2
    assert int(spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch").rstrip("b")) == 8 << 20
