import hashlib

import public_tokenizers as P
import pyarrow as pa
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from weirflow.llm import byte_bpe

FILES = ("byte_bpe_50k.tiktoken", "byte_bpe_multi_50k.tiktoken")
TEXTS = [
    "", " ", "  \n\t x", "Hello, world!  It's 2024; they'll don't\r\n\r\n", "naïve café — „Übergröße“ 東京タワー 🏳️‍🌈 \u0000﻿​", "a" * 5000, "é" * 3000, " " * 4000 + "x",
    "ab" * 3000, "0123456789" * 500, "thethethethethe" * 200, "".join(chr(c) for c in range(0x20, 0x3000)), "".join(chr(c) for c in range(0x1F300, 0x1F700)), "\U0010ffff\x85 ",
]


def ranks_of(name, most=None):
    ranks = byte_bpe.read_ranks(open(P.path(name), "rb").read())
    return {k: v for k, v in ranks.items() if most is None or v < most}


def library(ranks):
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.fixture(scope="module", params=FILES)
def both(request):
    ranks = ranks_of(request.param)
    return byte_bpe.Vocabulary(ranks, P.PATTERN), library(ranks)


def test_same_ids_as_the_library(both):
    vocabulary, theirs = both
    for text in TEXTS:
        assert vocabulary.encode(text) == theirs.encode_ordinary(text)


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=200) | st.text("abeht 's1.\n", max_size=300))
def test_any_text(both, text):
    vocabulary, theirs = both
    assert vocabulary.encode(text) == theirs.encode_ordinary(text)


@pytest.mark.parametrize("most", [256, 270, 400, 1000, 5000])
def test_few_merges(most):
    """The first merges of a vocabulary are a vocabulary; pieces are then covered by many short tokens."""
    ranks = ranks_of(FILES[0], most)
    vocabulary, theirs = byte_bpe.Vocabulary(ranks, P.PATTERN), library(ranks)
    for text in TEXTS + ["antidisestablishmentarianism", "ininininin", "theretherethere", "erererererer"]:
        assert vocabulary.encode(text) == theirs.encode_ordinary(text)


def test_what_is_remembered_is_bounded(monkeypatch):
    monkeypatch.setattr(byte_bpe, "MOST_PIECES", 3)
    monkeypatch.setattr(byte_bpe, "MOST_PAIRS", 5)
    ranks = ranks_of(FILES[0])
    vocabulary, theirs = byte_bpe.Vocabulary(ranks, P.PATTERN), library(ranks)
    text = "one unusualword twoo qwertyuiop " * 3 + "y" * 100
    assert vocabulary.encode(text) == theirs.encode_ordinary(text)
    assert len(vocabulary.pieces) <= 3 and len(vocabulary.follows) <= 5 and all(len(p) <= byte_bpe.LONGEST_REMEMBERED for p in vocabulary.pieces)


def test_work_is_linear():
    """Longest tokens tried for a piece, by its length: twice the piece, about twice the tries."""
    vocabulary = byte_bpe.Vocabulary(ranks_of(FILES[0]), P.PATTERN)
    asked = []
    for n in (20_000, 40_000):
        name = b"abandonmentisation" * (n // 18)
        tries = [0]

        class Counted(list):
            def __getitem__(self, i):
                tries[0] += 1
                return super().__getitem__(i)

        sizes = vocabulary.sizes
        vocabulary.sizes = Counted(sizes)
        vocabulary.cover(name)
        vocabulary.sizes = sizes
        asked.append(tries[0])
    assert asked[1] < 2.1 * asked[0]


def test_ranks_must_be_whole():
    with pytest.raises(ValueError, match="every byte"):
        byte_bpe.Vocabulary({b"a": 0}, P.PATTERN)
    with pytest.raises(ValueError, match="distinct"):
        byte_bpe.Vocabulary({bytes([b]): 0 for b in range(256)}, P.PATTERN)


def test_tables(spark):
    path = P.path(FILES[0])
    theirs = library(ranks_of(FILES[0]))
    rows = [(1, "a b", "x"), (2, None, None), (3, "", "y"), (None, "long " * 50_000 + "é", "z"), (1, "a b", "x"), (4, "\x00\n", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, `ids` string").repartition(2)
    tokens = byte_bpe.encode(docs.withColumnRenamed("text", "a.b"), path, P.PATTERN, text_col="a.b")
    assert tokens.columns == ["doc_id", "a.b", "ids"]
    got = sorted(((r.doc_id, r["a.b"], r.ids) for r in tokens.collect()), key=repr)
    assert got == sorted(((i, t, theirs.encode_ordinary(t or "")) for i, t, _ in rows), key=repr)
    back = byte_bpe.decode(tokens, path)
    assert all(bytes(r.bytes) == (r["a.b"] or "").encode() for r in back.collect())
    assert byte_bpe.encode(docs.limit(0), path, P.PATTERN).count() == 0


@pytest.mark.parametrize("at_once", [1, 3, 7, 1000])
def test_decode_in_parts(at_once):
    names, lists = byte_bpe.Names(ranks_of(FILES[0])), [[1, 2], [], None, [300], list(range(256, 280)), [None, 9], []]
    whole = names.decode(pa.array(lists, pa.list_(pa.int32()))).to_pylist()
    assert names.decode(pa.array(lists, pa.list_(pa.int32())), at_once).to_pylist() == whole
    assert names.decode(pa.array(lists, pa.list_(pa.int32())).slice(3), at_once).to_pylist() == whole[3:]


def test_decode_lists(spark):
    path = P.path(FILES[0])
    theirs = library(ranks_of(FILES[0]))
    lists = [(1, [0, 255, 50255]), (2, []), (3, None), (4, [5, None, 7]), (5, [220])]
    df = spark.createDataFrame(lists, "n int, ids array<int>").coalesce(1)
    got = {r.n: r.bytes for r in byte_bpe.decode(df, path).collect()}
    assert got[3] is None and got[2] == b""
    assert all(got[n] == theirs.decode_bytes([i for i in ids if i is not None]) for n, ids in lists if ids)
    for bad in (-1, 50256, 10**9):
        with pytest.raises(Exception, match="no token has such an id"):
            byte_bpe.decode(spark.createDataFrame([([bad],)], "ids array<int>"), path).collect()


def test_bytes_that_are_no_text(spark):
    df = spark.createDataFrame([(bytearray(b"a\xffb"),)], "raw binary").select(F.expr("cast(raw as string)").alias("text"))
    ids = byte_bpe.encode(df, P.path(FILES[0]), P.PATTERN).first().ids
    assert ids == library(ranks_of(FILES[0])).encode_ordinary("a�b")


def test_report(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    theirs = library(ranks_of(FILES[0]))
    sha = lambda b: hashlib.sha256(b).hexdigest()
    want = []
    for r in docs.collect():
        ids = theirs.encode_ordinary(r.text or "")
        want.append((r.doc_id, len(ids), sha(" ".join(map(str, ids)).encode()), sha((r.text or "").encode())))
    got = byte_bpe.report(docs, P.path(FILES[0]), P.PATTERN)
    assert got.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
    assert sorted(map(tuple, got.collect())) == sorted(want)
