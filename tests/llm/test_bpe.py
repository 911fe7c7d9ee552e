"""The transducer against the tiktoken library, and the decoder against exact round trips."""

import hashlib
import random

import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from gneiss.llm import bpe

PATH = public_tokenizers.path("byte_bpe_50k.tiktoken")


@pytest.fixture(scope="module")
def ranks():
    return bpe.read_ranks(PATH)


@pytest.fixture(scope="module")
def library(ranks):
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.fixture(scope="module")
def coder(ranks):
    import regex

    t, split = bpe.Transducer(ranks), regex.compile(public_tokenizers.PATTERN)
    return lambda text: t.encode(split.findall(text)).tolist()


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=60))
def test_any_text(coder, library, ranks, text):
    ids = coder(text)
    assert ids == library.encode_ordinary(text)
    assert bpe.Decoder(ranks).text(__import__("numpy").array(ids, "<u4")) == text


def test_long_and_odd_texts(coder, library):
    rng = random.Random(3)
    for text in [" " * 3000, "a" * 5000, "ab" * 700, "=-" * 400, "\n\n\t  x", "日本語" * 200, "é" * 999, "I'll we've 'sS", "0123456789" * 99]:
        assert coder(text) == library.encode_ordinary(text)
    for _ in range(300):
        text = "".join(rng.choice("aeinorst lTh") for _ in range(rng.randint(1, 200)))
        assert coder(text) == library.encode_ordinary(text)


def test_states_are_rebuilt_at_the_limit(ranks, library):
    small = bpe.Transducer(ranks, limit=20)
    for word in ["hello", "straightforwardness", "unbelievable", "xyzzyplugh", "counterrevolutionary"]:
        assert small.run(word.encode()) == library.encode_ordinary(word)


@settings(max_examples=300, deadline=None)
@given(st.binary(max_size=30), st.integers(0, 30))
def test_utf8_machine_in_pieces(data, cut):
    m = bpe.Utf8Machine()
    assert m.feed(data[:cut]) + m.feed(data[cut:]) + m.end() == data.decode("utf-8", "replace")


def test_table(spark, library):
    docs = spark.createDataFrame(
        [(1, "Hello  world"), (2, None), (3, ""), (None, "x"), (1, "Hello  world"), (4, "long " * 30000)],
        "doc_id long, text string",
    ).withColumn("ids", __import__("pyspark.sql.functions", fromlist=["x"]).lit(1))
    out = bpe.code(docs, PATH, public_tokenizers.PATTERN, with_ids=True).collect()
    assert len(out) == 6
    for r in out:
        text = {1: "Hello  world", 2: "", 3: "", None: "x", 4: "long " * 30000}[r.doc_id]
        assert r.ids == library.encode_ordinary(text) and r.decoded == text and r.n_tokens == len(r.ids)
        assert r.decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()
    assert bpe.code(docs.filter("doc_id = 99"), PATH, public_tokenizers.PATTERN).count() == 0
