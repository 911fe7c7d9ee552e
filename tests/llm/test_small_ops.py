"""Exact dedup, sharding and mixing against plain Python on small tables with awkward rows."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import pytest

from gneiss.llm import exact_dedup, mixing, scratch, sharding

SCHEMA = "doc_id long, text string, source string, shard string, size string, keep_id string, digest string"
ROWS = [
    (5, "a b", "x"), (3, "a \t b", "x"), (9, None, None), (7, "", "y"), (None, "a b", "y"), (11, "word " * 5000, "x"),
    (12, "ä ö", None), (12, "ä ö", None), (13, "one two three", "é"), (14, "  ", "z"),
] + [(100 + i, "same text here", "hot") for i in range(40)] + [(200 + i, "w " * (i % 7 + 1) + str(i), "hot") for i in range(60)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(*r, "s", "t", "k", "d") for r in ROWS], SCHEMA).repartition(3)


def words(text):
    return len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))


def test_dedup_matches_plain_python(spark, docs):
    norm = lambda t: hashlib.sha256(re.sub(r"[\x20\x09-\x0D]+", " ", t or "").encode()).hexdigest()
    groups = defaultdict(list)
    for i, t, _ in ROWS:
        groups[norm(t)].append(i)
    out = exact_dedup.deduplicate(docs, exact_dedup.DigestIndex(spark)).collect()
    assert len(out) == len(ROWS)
    for r in out:
        ids = groups[r.text_sha256]
        assert r.group_size == len(ids)
        assert r.keep_id == min((i for i in ids if i is not None), default=None)
    kept = Counter(r.text_sha256 for r in out if r.kept)
    assert kept == Counter(dict.fromkeys(groups, 1))


def test_dedup_index_persists_between_batches(spark, docs):
    index = exact_dedup.DigestIndex(spark)
    exact_dedup.deduplicate(docs.filter("doc_id >= 100"), index).count()
    later = {r.doc_id: r for r in exact_dedup.deduplicate(docs.filter("doc_id < 100 or doc_id = 139"), index).collect()}
    assert later[139].keep_id == 100 and not later[139].kept
    assert later[3].kept and not later[5].kept
    digests = [r.digest for r in index.read().collect()]
    assert len(digests) == len(set(digests))


def test_kept_rows_have_all_columns(spark, docs):
    out = exact_dedup.kept_rows(docs.filter("doc_id is not null and doc_id != 12"), exact_dedup.DigestIndex(spark))
    assert out.columns == docs.columns
    assert sorted(r.doc_id for r in out.collect())[:4] == [3, 7, 11, 13]


def test_shards_hold_near_equal_bytes(spark, docs):
    out = sharding.shard(docs, shards=4).collect()
    assert len(out) == len(ROWS)
    want = Counter((i, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for i, t, _ in ROWS)
    assert Counter((r.doc_id, r["size"], r.text_crc32) for r in out) == want
    for s in range(4):
        slots = sorted(r.slot for r in out if r.shard == s)
        assert slots == list(range(len(slots)))


def test_shards_on_whole_table(spark):
    out = sharding.shard(spark.read.parquet("/root/testdata/sf0.01/documents.parquet")).collect()
    loads = Counter()
    for r in out:
        loads[r.shard] += r["size"]
    assert len(loads) == 24
    assert max(loads.values()) - min(loads.values()) < 0.02 * sum(loads.values()) / 24


def plain_targets(sizes):
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: i % 3 + 1 for i, s in enumerate(order)}
    target, open_, left = {}, set(order), float(sum(sizes.values()))
    while open_:
        total = sum(weight[s] for s in open_)
        over = {s for s in open_ if left * weight[s] / total > 3 * sizes[s]}
        if not over:
            return target | {s: left * weight[s] / total for s in open_}
        for s in over:
            target[s] = 3.0 * sizes[s]
        left -= sum(3 * sizes[s] for s in over)
        open_ -= over
    return target


def check_mix(rows, out):
    sizes, largest, taken = Counter(), Counter(), Counter()
    for _, t, s in rows:
        sizes[s] += words(t)
        largest[s] = max(largest[s], words(t))
    want = plain_targets(sizes)
    for r in out:
        assert r.source_size == sizes[r.source]
        assert r.target == pytest.approx(want[r.source])
        assert r.taken == r.copies * r["size"] and 0 <= r.copies <= 3
        taken[r.source] += r.taken
    for s in sizes:
        assert abs(taken[s] - want[s]) <= largest[s] / 2 + 1e-6
    assert Counter((r.doc_id, r["size"], r.source) for r in out) == Counter((i, words(t), s) for i, t, s in rows)


def test_mix_meets_targets(docs):
    out = mixing.mix(docs, fan_in=4).collect()
    check_mix(ROWS, out)
    again = mixing.mix(docs.repartition(5), fan_in=4).collect()
    key = lambda r: (str(r.doc_id), r["size"], r.copies)
    assert sorted(map(key, out)) == sorted(map(key, again))


def test_mix_whole_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = [(r.doc_id, r.text, r.source) for r in docs.collect()]
    check_mix(rows, mixing.mix(docs).collect())


def test_mix_rounds_one_row_of_a_repeated_group(spark):
    """Rows that repeat, null ids too, are one item: hardly any differ from what all of them get."""
    rows = [(None, "one two three", "a")] * 301 + [(7, "four five", "a")] * 50 + [(i, "six " * (i % 5 + 1), "b") for i in range(90)] + [(i, "six", "c") for i in range(20)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(6)
    out = mixing.mix(docs, fan_in=8).collect()
    check_mix(rows, out)
    share = {r.target / r.source_size for r in out if r.source == "a"}.pop()
    for own, m in ((None, 301), (7, 50)):
        copies = [r.copies for r in out if r.source == "a" and r.doc_id == own]
        assert len(copies) == m and abs(sum(copies) - share * m) < 1


def test_empty_tables(spark, docs):
    none = docs.filter("doc_id = -1")
    assert exact_dedup.deduplicate(none, exact_dedup.DigestIndex(spark)).count() == 0
    assert sharding.shard(none).count() == 0
    assert mixing.mix(none).count() == 0
    blank = spark.createDataFrame([(1, None, None), (2, " ", "a")], "doc_id long, text string, source string")
    assert {r.taken for r in mixing.mix(blank).collect()} == {0}


@pytest.mark.parametrize("bits", [64, 1 << 24])
def test_only_keeps_the_rows_named_with_few_and_many_bits(spark, monkeypatch, bits):
    monkeypatch.setattr(scratch, "GONE_BITS", bits)
    rows, place = scratch.placed(spark.range(2000).selectExpr("id", "if(id % 3 = 0, null, 'text') AS text", "'x' AS word").repartition(5))
    for rule in ("id % 7 = 0", "id % 7 <> 0", "true", "false"):
        left = scratch.only(rows, place, rows.filter(rule).select(place))
        assert left.columns == rows.columns
        assert sorted(map(tuple, left.collect())) == sorted(map(tuple, rows.filter(rule).collect()))
