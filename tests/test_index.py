"""The stored index against every score, and against word sets in plain Python."""

import math
import random
import re
from collections import Counter

import pytest

from gneiss.operators import ranked_index, retrieval
from gneiss.operators.ranked_index import RankedIndex


def corpus(n, seed, words=60):
    """Frequencies fall with the number of the word; a few texts are odd."""
    rng = random.Random(seed)
    pool = [f"w{i}" if i % 7 else f"-x{i}" for i in range(words)]
    weights = [1 / (1 + i) for i in range(words)]
    rows = [(i, " ".join(rng.choices(pool, weights, k=rng.randint(0, 30)))) for i in range(n)]
    return rows + [(n, None), (n + 1, ""), (n + 2, "..."), (n + 3, "Alone zz " * 40), (None, "w1 w2 alone")]


def plain(docs, queries, k):
    terms = lambda t: re.findall("[a-z0-9-]+", (t or "").lower())
    known = {i: terms(t) for i, t in docs if i is not None}
    mean = sum(map(len, known.values())) / len(known)
    df = Counter(t for own in known.values() for t in set(own))
    out = []
    for q, text in queries:
        scored = []
        for i, own in known.items():
            tf, s = Counter(own), 0.0
            for t, times in Counter(terms(text)).items():
                if tf[t]:
                    s += times * math.log((len(known) - df[t] + 0.5) / (df[t] + 0.5) + 1) * tf[t] * 2.5 / (tf[t] + 1.5 * (0.25 + 0.75 * len(own) / mean))
            if s > 0:
                scored.append((-round(s, 9), i))
        out += [(q, i, rank, -s) for rank, (s, i) in enumerate(sorted(scored)[:k], 1)]
    return sorted(out)


QUERIES = [(0, "w1 w2 w3"), (1, "w50 w1 w1 w2"), (2, "alone w0"), (3, "unknown"), (4, None), (5, "-x7 w59 w58 w57 w0 w1 w2 w3 w4"), (6, "w55 w55 -x56 zz")]


@pytest.fixture(params=[(512, 8192), (4, 1), (4, 40)])
def small(request, monkeypatch):
    """Blocks of a few postings, and seeds of few documents: most bounds are then at work."""
    monkeypatch.setattr(ranked_index, "BLOCK", request.param[0])
    monkeypatch.setattr(ranked_index, "SEED", request.param[1])
    monkeypatch.setattr(ranked_index, "HELD", 300)


@pytest.mark.parametrize("k", [1, 5, 1000])
def test_every_score(spark, small, k):
    rows = corpus(400, k)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    index = RankedIndex.build(docs)
    got = sorted((r.query_id, r.doc_id, r["rank"], r.score) for r in index.search(spark.createDataFrame(QUERIES, "query_id long, text string"), k).collect())
    want = plain(rows, QUERIES, k)
    assert [x[:3] for x in got] == [x[:3] for x in want]
    assert [x[3] for x in got] == pytest.approx([x[3] for x in want])


@pytest.mark.parametrize("share", [0.5, 0.8, 1.0])
def test_shared_content_terms(spark, share):
    rows = corpus(300, 9)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    index = RankedIndex.build(docs)
    got = sorted(map(tuple, index.sharing(spark.createDataFrame(QUERIES, "query_id long, text string"), share).collect()))
    content = lambda t: {w.lower() for w in re.findall("[A-Za-z0-9][A-Za-z0-9-]+", t or "")} - set(retrieval.STOPWORDS)
    want = [(q, i) for q, text in QUERIES for i, t in rows if i is not None and content(text) and len(content(text) & content(t)) >= share * len(content(text)) - 1e-9]
    assert got == sorted(want)


def test_overlap_and_empty_tables(spark):
    docs = spark.createDataFrame([(1, "Alpha of -beta"), (2, None)], "doc_id long, text string")
    queries = spark.createDataFrame([(1, "alpha gamma of"), (2, "of"), (3, None)], "query_id long, text string")
    got = {r.query_id: (r.n_terms, r.n_known, r.overlap) for r in RankedIndex.build(docs).overlap(queries).collect()}
    assert got == {1: (2, 1, 0.5), 2: (0, 0, 0.0), 3: (0, 0, 0.0)}
    empty = RankedIndex.build(docs.limit(0))
    assert empty.search(queries, 5).count() == 0 and empty.sharing(queries, 0.8).count() == 0
    assert RankedIndex.build(docs).search(queries.limit(0), 5).count() == 0


def test_a_session_builds_an_index_once(spark, tmp_path):
    path = str(tmp_path / "docs")
    spark.createDataFrame([(1, "alpha")], "doc_id long, text string").write.parquet(path)
    first = ranked_index.shared_index(spark.read.parquet(path))
    assert ranked_index.shared_index(spark.read.parquet(path)).path == first.path
    spark.createDataFrame([(2, "beta")], "doc_id long, text string").write.mode("append").parquet(path)
    again = ranked_index.shared_index(spark.read.parquet(path))
    assert again.path != first.path and again.n_docs == 2


def test_terms_are_found_in_bytes():
    lowered = {c for i in range(128, 0x110000) if not 0xD800 <= i < 0xE000 for c in chr(i) if any(x < "\x80" for x in c.lower())}
    assert lowered == {c.decode() for c in ranked_index.ODD}
    rng = random.Random(5)
    for odd in ("", "İK"):
        texts = ["".join(rng.choices("aBz09-- .é€\U0001f600\n" + odd, k=rng.randint(0, 12))) for _ in range(200)] + [None, "", "ab", "cd", None]
        for column in (ranked_index.pa.array(texts), ranked_index.pa.array(["zz", *texts]).slice(1), ranked_index.pa.array([], "string"), ranked_index.pa.array([None, ""], "string")):
            coded, lengths, plain = ranked_index._coded(column)
            want = [re.findall(retrieval.TERM, (t or "").lower()) for t in column.to_pylist()]
            assert coded.to_pylist() == [t for own in want for t in own] and lengths.tolist() == list(map(len, want)) and plain == (not odd or len(column) < 3)


def test_the_vocabulary_holds_what_stands_in_the_texts(spark):
    texts = ["Alpha of -beta --x y- a z9", "Kelvin İx", "the 1-2 THE", None]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    want = {w.lower() for t in texts for w in re.findall("[A-Za-z0-9][A-Za-z0-9-]+", t or "")} - set(retrieval.STOPWORDS)
    index = RankedIndex.build(docs)
    assert {r.term for r in index.vocabulary.collect()} == want and "kelvin" not in want and "kelvin" in {r.term for r in index.terms.collect()}


def test_blocks_are_sorted_once(spark, tmp_path):
    docs = spark.createDataFrame([(1, "alpha")], "doc_id long, text string")
    path = str(tmp_path / "index")
    RankedIndex.build(docs, path)
    assert "kind" in spark.read.parquet(path + "/blocks").columns and not list((tmp_path / "index" / "blocks").glob("kind=*"))
