"""Held-out accuracy on the labelled table, gradients, swapped identity terms and awkward rows."""

import random
import zlib

import numpy as np
import pyarrow as pa
import pytest

from gneiss.llm import arrays, quality, toxicity

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def tables(spark):
    return spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")


def held_out(spark, module, tables, label):
    docs, labels = tables
    out = module.score(docs, module.train(docs, labels))
    rows = out.join(labels, "doc_id").collect()
    assert out.count() == docs.count()
    for r in rows:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and 0 <= r.score <= 1
    test = [r for r in rows if r.held_out]
    return sum(r.predicted == r[label] for r in test) / len(test)


def test_quality_on_held_out_labels(spark, tables):
    assert held_out(spark, quality, tables, "quality") > 0.97


def test_toxicity_on_held_out_labels(spark, tables):
    assert held_out(spark, toxicity, tables, "toxic") > 0.93


def test_attention_gradients():
    rng = np.random.default_rng(0)
    x, begin, y = rng.normal(size=(9, 5)), np.array([0, 2, 3, 9]), np.array([1.0, 0.0, 1.0])
    model = quality.AttentionModel(5, hidden=4, gate=3).fit(x, begin, y, steps=400)
    assert np.abs(model.score(x, begin) - y).max() < 0.1
    weights = model.forward(x, begin)["a"]
    assert np.allclose(np.add.reduceat(weights, begin[:-1]), 1)


def test_passages_cover_the_whole_text():
    text = " ".join(f"w{i}" for i in range(150)) + " BAD!!!"
    x, begin = quality.passages(*next(arrays.chunks(pa.array([text, "", None, "x"])))[1:], arrays.Powers())
    assert begin.tolist() == [0, 3, 4, 5, 6]
    assert x[2, 2] > 0 and not x[3].any() and not x[4].any()


AWKWARD = [(1, None), (2, ""), (None, "idiot"), (3, " \n"), (4, "word " * 40000), (1, "again"), (1, "again")]


@pytest.mark.parametrize("module", [quality, toxicity])
def test_awkward_rows(spark, module):
    schema = "doc_id long, text string, score string, label string, held_out string, keys string"
    docs = spark.createDataFrame([(*r, "a", "b", "c", "d") for r in AWKWARD], schema)
    labels = spark.createDataFrame(
        [(1, 1, None), (2, 0, 1), (None, 1, 1), (4, None, 0), (3, 7, 0)], "doc_id long, quality int, toxic int"
    )
    for marks in (labels, labels.filter("doc_id = 99")):
        out = module.score(docs, module.train(docs, marks)).collect()
        assert sorted(str(r.doc_id) for r in out) == sorted(str(i) for i, _ in AWKWARD)
        assert all(0 <= r.score <= 1 for r in out)
        assert module.score(docs.filter("doc_id = 99"), module.train(docs, marks)).count() == 0


def test_identity_terms_lose_their_weight(spark):
    """Where one group is mostly mentioned in toxic rows, the penalty still keeps neutral mentions apart from them."""
    rng = random.Random(5)
    fill = [f"plain{i}x" for i in range(50)]
    rows = []
    for i in range(600):
        toxic = i % 2
        words = rng.choices(fill, k=12) + (["awful"] if toxic and rng.random() < 0.85 else []) + (["muslim"] if rng.random() < (0.9 if toxic else 0.05) else ["christian"])
        rng.shuffle(words)
        rows.append((i, " ".join(words) + ".", toxic))
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(r[0], r[2]) for r in rows], "doc_id long, toxic int")
    probe = pa.array(["the muslim neighbours came to plain1x", "the christian neighbours came to plain1x"])
    gaps = []
    for penalty in (0.0, 5.0):
        model = toxicity.train(docs, labels, penalty=penalty)
        _, data, offsets = next(arrays.chunks(probe))
        a, b = model.score(data, offsets, arrays.Powers())
        gaps.append(abs(a - b))
    assert gaps[0] > 0.3 and gaps[1] < 0.1


def test_swaps():
    got = list(toxicity.swapped("A woman spoke. Nothing here.\nOld women sat!", [("woman", "man"), ("women", "men")]))
    assert got == [("A woman spoke.", "A man spoke."), ("Old women sat!", "Old men sat!")]


def test_documents_hold_identity_terms(spark, tables):
    """Swaps are found in the labelled documents themselves, and the penalty holds their scores together."""
    docs, _ = tables
    texts = [r.text or "" for r in docs.collect()]
    assert sum(any(True for _ in toxicity.swapped(t, toxicity.IDENTITY_TERMS)) for t in texts) > 0.1 * len(texts)
    seen = []
    fit = toxicity.fit
    try:
        toxicity.fit = lambda *a, **k: seen.append(len(a[2])) or fit(*a, **k)
        toxicity.train(*tables)
    finally:
        toxicity.fit = fit
    assert seen[0] > 50


def test_long_texts_give_a_bounded_bag(spark):
    docs = spark.createDataFrame([(i, f"{'w ' * 64 * 900} {i}" if i % 2 else f"x{i} y") for i in range(30)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(30)], "doc_id long, quality int, toxic int")
    sizes = []
    fit = quality.AttentionModel.fit
    try:
        quality.AttentionModel.fit = lambda self, x, begin, y: sizes.extend(np.diff(begin)) or fit(self, x, begin, y, steps=2)
        quality.train(docs, labels, most=40)
    finally:
        quality.AttentionModel.fit = fit
    assert max(sizes) == 40
