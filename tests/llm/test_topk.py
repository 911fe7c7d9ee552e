"""Top-k against plain Python on small vectors with ties and broken rows."""

import math
import random

from gneiss.llm import topk

SCHEMA = "vec_id long, embedding array<double>, rb string, v string, score string"


def plain(rows, k, every, scale):
    good = [(i, [math.floor(x * scale) for x in v]) for i, v in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v)]
    out = {}
    for q, a in good:
        if q % every == 0:
            scored = sorted((-sum(x * y for x, y in zip(a, b, strict=True)), i) for i, b in good if i != q and len(a) == len(b))
            out[q] = [(i, -s) for s, i in scored[:k]]
    return out


def check(spark, rows, k=5, every=10, **kw):
    df = spark.createDataFrame([(*r, "a", "b", "c") for r in rows], SCHEMA).repartition(3)
    out = {}
    for r in topk.top_k(df, k=k, every=every, **kw).orderBy("query_id", "rank").collect():
        assert r.rank == len(out.setdefault(r.query_id, [])) + 1
        out[r.query_id].append((r.vec_id, r.score))
    assert out == {q: v for q, v in plain(rows, k, every, 1024).items() if v}


def test_many_vectors_ties_and_broken_rows(spark):
    rng = random.Random(1)
    rows = [(i, [rng.gauss(0, 1) for _ in range(8)]) for i in range(200)]
    rows += [(200 + i, [0.5] * 8) for i in range(60)]
    rows += [(300, None), (310, [1.0, None] * 4), (320, [float("nan")] * 8), (330, [float("inf")] * 8), (None, [1.0] * 8)]
    check(spark, rows, rows_per_block=40, queries_per_block=7)
    check(spark, rows, nodes=3)


def test_fewer_than_k(spark):
    check(spark, [(0, [1.0, 2.0]), (10, [0.0, -1.0]), (3, [1.5, 1.5])])
    check(spark, [(0, [1.0, 2.0])])
    check(spark, [(1, [1.0, 2.0])])
    assert topk.top_k(spark.createDataFrame([], SCHEMA)).count() == 0


def test_large_values_stay_exact(spark):
    rng = random.Random(2)
    check(spark, [(i, [rng.uniform(-1, 1) * 2**17 for _ in range(4)]) for i in range(50)])


def test_lengths_are_searched_by_themselves(spark):
    rng = random.Random(3)
    rows = [(i, [rng.gauss(0, 1) for _ in range(2)]) for i in range(40)] + [(100 + i, [rng.gauss(0, 1) for _ in range(3)]) for i in range(40)]
    check(spark, [*rows, (200, [1.0]), (7, []), (5, rows[5][1])])


def test_cutoff_limits_what_is_handed_over(spark):
    """The slices hand over few of their entries, and the vectors that one slice alone made known are completed."""
    rng = random.Random(4)
    df = spark.createDataFrame([(i, [rng.gauss(0, 1) for _ in range(16)]) for i in range(2000)], "vec_id long, embedding array<double>")
    handed = []
    keep = topk.stored
    try:
        topk.stored = lambda d, *a: handed.append(keep(d, *a)) or handed[-1]
        topk.top_k(df).count()
    finally:
        topk.stored = keep
    last = handed[-1]
    assert "known" in last.columns
    assert 200 <= last.count() < 0.2 * 20 * 2000
    assert last.filter("size(known) < slices").count() and last.filter("size(known) = slices").count()
