"""Alignment and token counts against the tokenizer libraries and plain loops."""

import hashlib
import json
import os
import unicodedata
from collections import Counter, defaultdict

import public_tokenizers
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st

from gneiss.llm import alignment, pretokens, registry, token_counts

A, B, PATTERN = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"), public_tokenizers.PATTERN
SF = "/root/testdata/sf0.001"
AWKWARD = [
    None, "", " ", "a", "  two  spaces \n\n\n and  lines\t\t", "<|endoftext|>", "a <|endoftext|><|endoftext|> b", "<s>x</s><unk>", "▁already▁", "naïve 漢字 🙂🙃 ͸",
    "́‍﻿", "x" * 3000, " " * 3000, "ab" * 500 + " " + "-" * 90, "-" * 90, "\r\n<0x41>\x00\x1c\x85 ", "don't we'll 123456 4.5%", "ａｂ ½ ﬁ",
]


def library(special_as_text):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(A)
    t.encode_special_tokens = special_as_text
    return t


@pytest.fixture(scope="module")
def tokens():
    return pretokens.Tokens(A, PATTERN)


def test_every_character_is_split_as_the_library_does(tokens):
    split = tokens.library.pre_tokenizer.pre_tokenize_str
    for c in range(0x110000):
        # Unassigned planes are all alike.
        if 0xD800 <= c < 0xE000 or (0x32000 <= c and not 0xE0000 <= c < 0xE0200):
            continue
        text = f"a{chr(c)}1{chr(c)}{chr(c)}b.  {chr(c)}"
        assert tokens.split(text) == [text[i:j] for _, (i, j) in split(text)], hex(c)
        if unicodedata.category(chr(c)) == "Cn":
            assert chr(c) not in tokens.met


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(["<|endoftext|>", "<|endof", " ", "\n", "word", "'s", "7", "é", "漢", "🙂", "͸", "!?"]), max_size=12).map("".join))
def test_parts_and_pieces(tokens, text):
    parts, special = tokens.parts(text)
    assert sum(map(len, tokens.pieces(parts))) + special == len(library(False).encode(text, add_special_tokens=False).ids)


def test_other_tokenizers_are_refused():
    with pytest.raises(ValueError):
        pretokens.Tokens(public_tokenizers.path("word_bpe_49k.json"), PATTERN)


def awkward(spark):
    rows = [(i, t, 1, "x") for i, t in enumerate(AWKWARD)] + [(7, "a copy of a copy", 1, "x")] * 3 + [(None, "a copy of a copy", 1, "x")]
    return spark.createDataFrame(rows, "doc_id long, text string, n_a int, place string")


def plain_counts(rows):
    t = library(False)
    return sorted(
        ((i is None, i, len((text or "").encode()), n, n > 512) for i, text in rows for n in [len(t.encode(text or "", add_special_tokens=False).ids)]), key=repr
    )


@pytest.mark.parametrize("top", [1 << 17, 3, 0])
def test_counts_of_awkward_rows(spark, top):
    docs = awkward(spark)
    got = token_counts.count(docs, A, PATTERN, top=top)
    assert got.columns == ["doc_id", "n_bytes", "n_tokens", "over_limit"]
    want = plain_counts([(r.doc_id, r.text) for r in docs.collect()])
    assert sorted(((r.doc_id is None, *r) for r in got.collect()), key=repr) == want
    assert token_counts.count(docs.limit(0), A, PATTERN).count() == 0


def test_counts_query(spark):
    rows = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    got = registry.QUERIES["op12_token_counts"](spark, SF).collect()
    assert sorted(((r.doc_id is None, *r) for r in got), key=repr) == plain_counts(rows)


def plain_alignment(rows):
    """Every pair of tokens compared by their offsets within a group; the counts by hand."""
    t, sp = library(True), sentencepiece.SentencePieceProcessor(model_file=B)
    with open(A, encoding="utf-8") as f:
        names = {i: e for e, i in json.load(f)["model"]["vocab"].items()}
    known = pretokens.byte_level()
    told, held, links_of = [], Counter(), []
    for i, text in rows:
        out, links = [i, 0, 0, 0, 0], []
        groups = ""
        if text:
            raw = b" " + text.encode()
            a = [(x, bytes(known[c] for c in names[x])) for x in t.encode(" " + text, add_special_tokens=False).ids]
            b = [(x, bytes([int(p[3:5], 16)]) if sp.is_byte(x) else p.replace("▁", " ").encode()) for x in sp.encode(text) for p in [sp.id_to_piece(x)]]
            if b"".join(x for _, x in a) == raw == b"".join(x for _, x in b):
                spans = []
                for side in (a, b):
                    at, own = 0, []
                    for x, data in side:
                        own.append((at, at + len(data), x))
                        at += len(data)
                    spans.append(own)
                ends = sorted({e for _, e, _ in spans[0]} & {e for _, e, _ in spans[1]})
                parts, cut = [], 0
                by_end = [defaultdict(list) for _ in spans]
                for own, into in zip(spans, by_end, strict=True):
                    k = 0
                    for s, e, x in own:
                        while ends[k] < e:
                            k += 1
                        into[ends[k]].append((s, e, x))
                for cut in ends:
                    ga, gb = (into[cut] for into in by_end)
                    parts.append(",".join(str(x) for *_, x in ga) + "|" + ",".join(str(x) for *_, x in gb))
                    links += [(x, y) for s, e, x in ga for u, v, y in gb if s < v and u < e]
                groups = ";".join(parts)
                out = [i, len(a), len(b), len(parts), len(links)]
        held.update(set(links))
        told.append((out, groups))
        links_of.append(links)
    best = Counter()
    for (x, _), n in held.items():
        best[x] = max(best[x], n)
    return sorted(
        ((*out, sum(held[p] == best[p[0]] for p in links), sum(held[p] for p in links), hashlib.sha256(g.encode()).hexdigest() if g else "", g)
         for (out, g), links in zip(told, links_of, strict=True)), key=repr,
    )


@pytest.mark.parametrize("top", [1 << 18, 5, 0])
def test_alignment_of_awkward_rows(spark, top):
    docs = awkward(spark)
    got = alignment.align(docs, A, PATTERN, B, with_groups=True, top=top)
    assert sorted(map(tuple, got.collect()), key=repr) == plain_alignment([(r.doc_id, r.text) for r in docs.collect()])
    assert alignment.align(docs.limit(0), A, PATTERN, B).count() == 0


def test_alignment_query(spark):
    rows = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    got = registry.QUERIES["op11_interval_alignment"](spark, SF)
    assert got.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    assert sorted(map(tuple, got.collect()), key=repr) == sorted((r[:-1] for r in plain_alignment(rows)), key=repr)
