"""Each stage against plain Python on what the stage before it kept."""

import re
from collections import Counter

import public_tokenizers
import tiktoken

import corpus_pipeline
from gneiss.llm import bpe
from tests.llm.test_jaccard import plain

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    steps = dict(corpus_pipeline.STAGES)
    assert list(steps) == ["toxicity", "exact_dedup", "near_copies", "mixing", "encoding"]
    before = {r.doc_id: r for r in docs.collect()}

    clean = corpus_pipeline.stored(steps["toxicity"](spark, docs, SF))
    rows = {r.doc_id: r for r in clean.collect()}
    assert clean.columns == docs.columns and all(before[i] == r for i, r in rows.items())
    gone = before.keys() - rows.keys()
    assert sum(labels.get(i) == 0 for i in gone) <= 0.02 * len(labels)

    exact = corpus_pipeline.stored(steps["exact_dedup"](spark, clean, SF))
    first = {}
    for i in sorted(rows):
        first.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", rows[i].text), i)
    assert {r.doc_id for r in exact.collect()} == set(first.values())

    near = corpus_pipeline.stored(steps["near_copies"](spark, exact, SF))
    left = [(r.doc_id, r.text) for r in exact.collect()]
    assert {str(r.doc_id) for r in near.collect()} == {i for i, _, c, _ in plain(left, 5, 80, 100) if i == c}

    mixed = corpus_pipeline.stored(steps["mixing"](spark, near, SF))
    kept = {r.doc_id: r for r in near.collect()}
    times = Counter(r.doc_id for r in mixed.collect())
    assert mixed.columns == docs.columns and max(times.values()) <= 3 and times.keys() <= kept.keys()

    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken")), special_tokens={})
    out = steps["encoding"](spark, mixed, SF).collect()
    assert Counter(r.doc_id for r in out) == times
    for r in out:
        assert r.ids == library.encode_ordinary(kept[r.doc_id].text)


def test_rows_with_null_or_repeated_ids(spark, tmp_path):
    steps, shape = dict(corpus_pipeline.STAGES), "doc_id long, text string, lang string, source string, n_chars long"
    spread = lambda rows: spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], shape).repartition(3)
    got = lambda stage, rows: Counter((r.doc_id, r.text) for r in steps[stage](spark, spread(rows), str(tmp_path)).collect())

    labelled = [(i, f"{'vile slur' if i % 2 else 'kind calm'} words {i}") for i in range(120)]
    spark.createDataFrame([(i, 1, i % 2) for i, _ in labelled], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    odd = [(None, "vile slur words"), (None, "kind calm words"), (500, "vile slur words"), (500, "kind calm words"), (500, "kind calm words")]
    left = got("toxicity", labelled + odd)
    assert [left[r] for r in odd] == [0, 1, 0, 2, 2]

    unique = " ".join(f"w{i}" for i in range(40))
    rows = [(None, "alone"), (1, "a  b"), (1, "a b"), (1, "a b"), (1, "other"), (2, "a b"), (None, "a b"), (None, "z"), (None, "z")]
    exact = got("exact_dedup", rows)
    assert Counter((i, t.replace("  ", " ")) for i, t in exact.elements()) == Counter([(None, "alone"), (1, "a b"), (1, "other"), (None, "z")])
    near = got("near_copies", [(None, unique), (None, unique + " more"), (7, "x y"), (7, "x y"), (7, "lone text"), (8, "x y"), (None, "x y")])
    assert sum(near.values()) == 3 and near[7, "x y"] == near[7, "lone text"] == 1 and sum(near[r] for r in near if r[0] is None) == 1
    # One source takes each row once.
    rows = [(None, "one two")] * 2 + [(3, "three four")] * 3 + [(3, "five six")]
    assert got("mixing", rows) == Counter(rows)


AWKWARD = "doc_id long, text string, lang string, source string, n_chars long, place string, copies string, word int, bits int, salt string, first int"


def test_stages_keep_columns_of_any_name_and_take_any_text(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    long_text = " ".join(f"word{i % 977}" for i in range(60_000))
    texts = [None, "", " \n ", "one", "one", long_text, long_text + " more", "é" * 5000, "a b c d e f g"]
    extra = ("mine", "mine too", 7, 8, "s", 9)
    rows = [(i, t, None if i % 4 == 0 else "en", None if i % 3 == 0 else "s", None, *extra) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, AWKWARD).repartition(3)
    for empty in (False, True):
        left = docs.limit(0) if empty else docs
        for name, stage in corpus_pipeline.STAGES[:-1]:
            out = corpus_pipeline.stored(stage(spark, left, str(tmp_path)))
            assert out.schema == docs.schema, name
            assert all(tuple(r)[5:] == extra for r in out.collect()) and (out.count() == 0) == empty
            left = out
        assert corpus_pipeline.STAGES[-1][1](spark, left, str(tmp_path)).count() == left.count()
