import base64
import functools
import hashlib
import pickle
import random
from array import array
from pathlib import Path

import public_tokenizers as P
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from fernweave.llm import bpe

RANKS, JSON = P.path("byte_bpe_50k.tiktoken"), P.path("byte_bpe_50k.json")
RANK_DATA, JSON_DATA = Path(RANKS).read_bytes(), Path(JSON).read_bytes()
HARD = ["", " ", "a", "  a\n\n b", "it's we'll", "a\u0085b\x1cc", "漢字🙂 é", "aaaaaaaab" * 60, " " * 3000, "x" * 5000, "\n a\n\tb \n", "<|endoftext|>a<|endoftext|>", "١٢³ Ⅷ", "word, word.\nWord  end "]


@pytest.fixture(scope="module")
def library():
    words = bpe.read_ranks(RANK_DATA)
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks={w: i for i, w in enumerate(words)}, special_tokens={})


@pytest.fixture(scope="module")
def codec():
    return bpe.Codec(RANK_DATA)


@pytest.fixture(scope="module")
def counter():
    return bpe.Counter(JSON_DATA)


def test_hard_texts_as_the_library(codec, library, counter):
    json_library = Tokenizer.from_file(JSON)
    for t in HARD:
        ids = codec.encode(t)
        assert list(ids) == library.encode_ordinary(t)
        assert codec.decode(ids) == t.encode()
        assert counter.count(t) == len(json_library.encode(t, add_special_tokens=False).ids)


@settings(max_examples=300, deadline=None)
@given(st.text(st.one_of(st.sampled_from("  \n'stllaé.,-_<|>01"), st.characters(exclude_categories=["Cs"])), max_size=80))
def test_any_text_as_the_library(text):
    codec, lib = made_once()
    ids = codec.encode(text)
    assert list(ids) == lib.encode_ordinary(text) and codec.decode(ids).decode() == text


@functools.cache
def made_once():
    words = bpe.read_ranks(RANK_DATA)
    return bpe.Codec(RANK_DATA), tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks={w: i for i, w in enumerate(words)}, special_tokens={})


def test_the_encoder_is_the_merging_it_replaces(codec):
    draw = random.Random(1)
    v = codec.vocabulary
    for _ in range(3000):
        piece = "".join(draw.choice("etaoinshrdlu") for _ in range(draw.randint(1, 40))).encode()
        assert v.encode(piece) == v.merge(piece)


def test_whole_tokens_are_proved(counter):
    counts = counter.chunks.of_piece
    assert counts["the"] == 1 and dict.get(counts, "the") == 1 and dict.get(counts, "thethethe") is None
    json_library = Tokenizer.from_file(JSON)
    assert all(len(json_library.encode(w, add_special_tokens=False).ids) == 1 for w in random.Random(3).sample(counter.single, 500))


def test_what_is_sent_needs_no_file(codec, counter):
    text = "The memo, the codec\nand 12 more."
    codec.encode(text)
    again, other = pickle.loads(pickle.dumps(codec)), pickle.loads(pickle.dumps(counter))
    assert again._chunks is None and again.vocabulary._trie is None
    assert again.encode(text) == codec.encode(text) and other.count(text) == counter.count(text)


def test_words_that_no_merges_lead_to():
    """A piece that is a word is one token; inside a longer piece such a word is never used."""
    words = [bytes([b]) for b in range(256)] + [b"bc", b"abcd", b"xyz", b"ab", b"qq", b"qqq", b"qqqqq"]
    data = b"\n".join(base64.b64encode(w) + b" " + str(i).encode() for i, w in enumerate(words))
    own, lib = bpe.Codec(data, r"\S+|\s+"), tiktoken.Encoding("own", pat_str=r"\S+|\s+", mergeable_ranks={w: i for i, w in enumerate(words)}, special_tokens={})
    draw = random.Random(2)
    for t in ["abcd", "abcda", "xyz", "xyzxyz", "abc", "qqqqq", "qqqqqq", *["".join(draw.choice("abcdqxyz ") for _ in range(draw.randint(1, 12))) for _ in range(800)]]:
        assert list(own.encode(t)) == lib.encode_ordinary(t)


def test_memos_forget_when_full(codec, library, monkeypatch):
    monkeypatch.setattr(bpe, "MEMO_BYTES", 700)
    c = bpe.Codec(RANK_DATA)
    for t in HARD * 2:
        assert list(c.encode(t)) == library.encode_ordinary(t)


def test_frames_with_nulls_ties_and_further_columns(spark, library):
    rows = [(1, "a b", 9), (1, "a b", 9), (None, None, 9), (2, "", 9)]
    d = spark.createDataFrame(rows, "doc_id long, text string, n_tokens int")
    got = sorted(map(tuple, bpe.encoding_digests(d, RANKS).collect()), key=str)
    sha = lambda x: hashlib.sha256(x).hexdigest()
    ids = array("I", library.encode_ordinary("a b"))
    assert got.count((1, 2, sha(ids.tobytes()), sha(b"a b"))) == 2 and (None, 0, sha(b""), sha(b"")) in got and len(got) == 4
    full = bpe.encode_documents(d, RANKS).filter("doc_id = 1").first()
    assert full.ids == list(ids) and full.n_tokens == 2 and full.ids_sha256 == sha(ids.tobytes())
    assert {tuple(r.ids) for r in bpe.encode_documents(d, RANKS).collect()} == {tuple(ids), ()}
    counts = sorted(map(tuple, bpe.token_counts(d, JSON, limit=1).collect()), key=str)
    assert counts.count((1, 3, 2, True)) == 2 and (None, 0, 0, False) in counts
    empty = d.filter(F.lit(False))
    assert bpe.encoding_digests(empty, RANKS).count() == 0 and bpe.token_counts(empty, JSON).count() == 0


def test_workers_keep_nothing_of_a_table(spark, library):
    """Spark keeps its Python workers: what encoding remembered must not stay in them. Portions of a batch join up."""

    def remembered(batches):
        import gc

        import pandas as pd

        for _ in batches:
            yield pd.DataFrame({"n": [sum(type(x).__name__ == "_IdChunks" for x in gc.get_objects())]})

    d = spark.range(2500).repartition(4).select(F.col("id").alias("doc_id"), F.concat(F.lit("some text "), F.col("id")).alias("text"))
    got = bpe.encode_documents(d, RANKS).collect()
    assert sum(r.n for r in spark.range(0, 8, 1, 8).mapInPandas(remembered, "n long").collect()) == 0
    assert {r.doc_id: list(r.ids) for r in got} == {i: library.encode_ordinary(f"some text {i}") for i in range(2500)} and len(got) == 2500
