"""Runs against a scan of every stretch of words."""

import hashlib
import random
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from gneiss.llm import periodic, registry


def brute(words, least=6, times=4):
    """Every maximal stretch of each period, kept where no smaller period has the same stretch."""
    n, found = len(words), {}
    for q in range(1, n // times + 1):
        s = 0
        while s + q < n:
            e = s
            while e + q < n and words[e] == words[e + q]:
                e += 1
            length = e - s + q
            if e > s and length >= max(least, times * q):
                found.setdefault((s, length), q)
            s = max(e, s) + 1
    return sorted(((s, n, q) for (s, n), q in found.items()), key=lambda r: (r[0], r[2]))


def collapse(words, found):
    gone = {i for s, n, q in found for i in range(s + q, s + n)}
    return " ".join(w for i, w in enumerate(words) if i not in gone)


def found_in(texts, least=6, times=4):
    return [r for _, r in periodic._found([t.encode() for t in texts], least, times)]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text("ab", min_size=0, max_size=60).map(" ".join), max_size=4), st.sampled_from([(6, 4), (6, 3), (2, 3), (9, 5)]))
def test_any_words(texts, rule):
    if texts:
        assert found_in(texts, *rule) == [brute(t.split(), *rule) for t in texts]


def test_periodic_texts_with_flaws():
    rng = random.Random(5)
    texts = []
    for _ in range(300):
        out = []
        for _ in range(rng.randint(1, 4)):
            unit = [rng.choice("abcde") for _ in range(rng.randint(1, 9))]
            out += unit * rng.randint(1, 7) + unit[: rng.randint(0, len(unit))]
            if rng.random() < 0.5:
                out[rng.randrange(len(out))] = "x"
        texts.append(" ".join(out))
    assert found_in(texts) == [brute(t.split()) for t in texts]


def test_long_texts_take_few_steps():
    line = "all rights reserved by the firm that made it".split()
    texts = [["a"] * 30_000, ["a", "b", "c"] * 10_000, [w for i in range(3000) for w in (*line, f"n{i}")], (["a"] * 40 + ["b"]) * 500]
    got = found_in([" ".join(t) for t in texts])
    assert got[0] == [(0, 30_000, 1)] and got[1] == [(0, 30_000, 3)] and got[2] == []
    assert (0, 41 * 500, 41) in got[3] and sum(q == 1 for _, _, q in got[3]) == 500


AWKWARD = [None, "", " \t\n ", "a", "a a a a a", "a a a a a a", "A a A a A a A a", "  x  x  x  x  x  x ", "é\x0bé\x0cé\ré\té é", "x " * 5000 + "end"]


def test_awkward_rows(spark):
    rows = [(i, t, "mine", i) for i, t in enumerate(AWKWARD)] + [(3, "b b b b b b", "mine", 1), (3, "b b b b b b", "mine", 1), (None, "c c c c c c c", "mine", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, runs string, n_words int")
    got = sorted(((r.doc_id is None, r.doc_id, r.n_words, [tuple(x) for x in r.runs], r.collapsed) for r in periodic.runs(docs).collect()), key=repr)
    want = []
    for i, t, *_ in rows:
        words = [w.decode() for w in (t or "").encode().split()]
        want.append((i is None, i, len(words), brute(words), collapse(words, brute(words))))
    assert got == sorted(want, key=repr)
    empty = periodic.digests(periodic.runs(periodic.with_periodic_tail(docs.limit(0))))
    assert empty.count() == 0 and empty.columns[0] == "doc_id"
    with pytest.raises(ValueError):
        periodic.runs(docs, times=2)


def test_query_on_every_document(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    got = {r.doc_id: r for r in registry.QUERIES["op13_periodic_runs"](spark, sf).collect()}
    assert len(got) == len(docs)
    for doc_id, text in docs:
        words = [w.decode() for w in (text or "").encode().split()]
        h, n = zlib.crc32(str(doc_id).encode()), len(words)
        g = h // 10
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
        found = numpy_brute(words)
        row = got[doc_id]
        best = min(found, key=lambda r: (-r[1], r[0], r[2])) if found else None
        assert row.n_runs == len(found)
        assert (row.start, row.length, row.period) == (best or (None,) * 3)
        assert row.exponent_milli == (1000 * best[1] // best[2] if best else None)
        assert row.runs_sha256 == hashlib.sha256("".join(f"{s},{k},{q}\n" for s, k, q in found).encode()).hexdigest()
        assert row.collapsed_sha256 == hashlib.sha256(collapse(words, found).encode()).hexdigest()


def numpy_brute(words):
    """``brute`` with one comparison of arrays for each period."""
    ids = {w: i for i, w in enumerate(dict.fromkeys(words))}
    x, found = np.array([ids[w] for w in words]), {}
    for q in range(1, len(words) // 4 + 1):
        same = np.concatenate(([0], (x[q:] == x[:-q]).astype(int), [0]))
        edge = np.diff(same)
        for s, e in zip(np.flatnonzero(edge == 1), np.flatnonzero(edge == -1), strict=True):
            if e - s + q >= max(6, 4 * q):
                found.setdefault((int(s), int(e - s + q)), q)
    return sorted(((s, n, q) for (s, n), q in found.items()), key=lambda r: (r[0], r[2]))
