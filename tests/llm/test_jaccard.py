"""The join against all pairs, its keys against the definition, and components against plain Python."""

import random
import re
from itertools import combinations

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from gneiss.llm import graph, jaccard


def shingle_set(text, k):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)] if w else [])


def plain(rows, k, num, den):
    sets = [shingle_set(t, k) for _, t in rows]
    root, links = list(range(len(rows))), [0] * len(rows)

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for x, y in combinations(range(len(rows)), 2):
        if sets[x] and sets[y] and den * len(sets[x] & sets[y]) >= num * len(sets[x] | sets[y]):
            links[x] += 1
            links[y] += 1
            a, b = find(x), find(y)
            root[max(a, b)] = min(a, b)
    least = {}
    for x, (i, _) in enumerate(rows):
        if i is not None:
            r = find(x)
            least[r] = min(least.get(r, i), i)
    return sorted((str(i), len(sets[x]), str(least.get(find(x))), links[x]) for x, (i, _) in enumerate(rows))


def run(spark, rows, k=3, num=90, den=100, **kw):
    docs = spark.createDataFrame([(*r, "k", "p", "n") for r in rows], "doc_id long, text string, key string, place string, n string").repartition(4)
    out = jaccard.join(docs, k, num, den, **kw).collect()
    return sorted((str(r.doc_id), r.n_shingles, str(r.component_id), r.n_links) for r in out)


def near_copies(seed, sizes, edits, count):
    rng, out = random.Random(seed), []
    for size in sizes:
        base = [f"w{rng.randint(0, 400)}" for _ in range(size)]
        for _ in range(count):
            words = list(base)
            for _ in range(rng.randint(0, min(edits, size - 1))):
                at = rng.randint(0, len(words) - 1)
                words[at : at + 1] = rng.choice(([], [f"new{rng.randint(0, 99)}"], [words[at], "in"]))
            out.append(" ".join(words))
    return out


@pytest.mark.parametrize("k, num, den", [(3, 90, 100), (5, 80, 100)])
def test_against_all_pairs(spark, k, num, den):
    texts = near_copies(1, [1, 2, 4, 9, 14, 22, 30, 45, 70, 150, 400], 3, 9)
    shared = " ".join(f"s{i}" for i in range(60))
    rng = random.Random(2)
    texts += [shared + " " + " ".join(f"o{rng.randint(0, 9999)}" for _ in range(rng.randint(1, 80))) for _ in range(40)]
    rows = [(7 * i % 1009, t) for i, t in enumerate(texts)]
    rows += [(None, texts[3]), (None, "alone entirely here now"), (2000, None), (2001, ""), (2002, " \n"), (2003, texts[40].upper()), (2003, texts[40])]
    assert run(spark, rows, k, num, den, block=5) == plain(rows, k, num, den)


def test_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    assert run(spark, rows) == plain(rows, 3, 90, 100)


def test_empty(spark):
    assert jaccard.join(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    assert run(spark, [(1, None)]) == [("1", 0, "1", 0)]


@settings(max_examples=400, deadline=None)
@given(st.integers(1, 60), st.data(), st.sampled_from([(90, 100), (80, 100)]), st.integers(0, 25))
def test_linked_sets_share_more_keys_than_are_spare(n, data, share, light):
    num, den = share
    rng = np.random.default_rng(data.draw(st.integers(0, 10**6)))
    plan = jaccard.Plan(num, den, light)
    a = np.unique(rng.integers(0, 2**63, n).astype("uint64"))
    b = np.unique(np.concatenate((rng.choice(a, rng.integers(max(1, len(a) - 6), len(a) + 1), replace=False), rng.integers(0, 2**63, rng.integers(0, 6)).astype("uint64"))))
    shared = len(np.intersect1d(a, b))
    if den * shared >= num * (len(a) + len(b) - shared) and not np.array_equal(a, b):
        both = [(len(np.intersect1d(x, y)), max(s, t)) for x, s in jaccard.set_keys(a, plan) for y, t in jaccard.set_keys(b, plan)]
        assert any(met > spare for met, spare in both)
        x, y = jaccard.sketch(a)[None, :], jaccard.sketch(b)[None, :]
        least = min(x.shape[1], y.shape[1])
        assert jaccard.alike(jaccard.folded(x, least), len(a), jaccard.folded(y, least), len(b), num, den).all()


def test_sketches_part_what_only_shares_a_passage():
    rng = np.random.default_rng(3)
    passage = rng.integers(0, 2**63, 200).astype("uint64")
    sets = [np.unique(np.concatenate((passage, rng.integers(0, 2**63, 200).astype("uint64")))) for _ in range(40)]
    rows = np.stack([jaccard.sketch(s) for s in sets])
    assert sum(jaccard.alike(rows[i], 400, rows[i + 1 :], 400, 80, 100).sum() for i in range(39)) == 0


@pytest.mark.parametrize("many", [0, 90])
def test_crowded_lists_and_blocks(spark, monkeypatch, many):
    """Short lists, crowded ones and ones of several blocks; the group of many near copies has several blocks too."""
    monkeypatch.setattr(jaccard, "CROWDED", 8)
    monkeypatch.setattr(jaccard, "LIST_BLOCK", 20)
    rng = random.Random(5)
    shared = " ".join(f"s{i}" for i in range(90))
    texts = [shared + " " + " ".join(f"o{rng.randint(0, 9999)}" for _ in range(rng.randint(0, 60))) for _ in range(70)]
    texts += near_copies(6, [60], 4, many) + near_copies(7, [30, 200], 9, 20)
    rows = list(enumerate(texts))
    assert run(spark, rows, 5, 80, 100, block=900) == plain(rows, 5, 80, 100)


def test_components(spark):
    rng = random.Random(4)
    edges = [(rng.randint(0, 300), rng.randint(0, 300)) for _ in range(220)] + [(i, i + 1) for i in range(1000, 1040)]
    got = {r.u: r.v for r in graph.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    label = {}
    for u, v in edges:
        label.setdefault(u, u), label.setdefault(v, v)
    for _ in range(400):
        for u, v in edges:
            label[u] = label[v] = min(label[u], label[v])
    assert got == {u: v for u, v in label.items() if u != v}
