"""Base scores, code lengths and sums of probabilities against plain Python."""

import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from gneiss.llm import ppm

ROWS = [(i, " ".join(random.Random(i).choices(["The", "the", "cat", "saß", "on", "a", "mat."], k=i % 9))) for i in range(60)]
ROWS += [(100, None), (101, ""), (None, "the cat"), (102, "Zebra zebra qua!"), (102, "Zebra zebra qua!"), (103, "x" * 3000)]


def is_held(i):
    return i is not None and zlib.crc32(str(i).encode()) % 7 == 2


def tokens(text):
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return [w.translate(low) for w in re.findall(r"[^\x20\x09-\x0D]+", text or "")] + [None]


def plain_ppm(training):
    tables = [defaultdict(Counter) for _ in range(4)]
    for t in training:
        b = b"\0\0\0" + (t or "").encode() + b"\xff"
        for i in range(3, len(b)):
            for o in range(4):
                tables[o][b[i - o : i]][b[i]] += 1

    def logp(context, byte):
        out, excluded = 0.0, set()
        for o in (3, 2, 1, 0):
            c = {s: n for s, n in tables[o].get(context[3 - o :], {}).items() if s not in excluded}
            if not c:
                continue
            total = sum(c.values()) + len(c)
            if byte in c:
                return out + math.log10(c[byte] / total)
            out += math.log10(len(c) / total)
            excluded |= set(c)
        return out - math.log10(256 - len(excluded))

    return logp


@pytest.mark.parametrize("max_words", [3, 1000])
def test_against_plain_python(spark, max_words):
    docs = spark.createDataFrame([(*r, "p", "s") for r in ROWS], "doc_id long, text string, place string, score string").repartition(3)
    out = ppm.score(docs, max_words=max_words).collect()
    training = [t for i, t in ROWS if not is_held(i)]
    c = Counter(w for t in training for w in tokens(t))
    n, v, logp = sum(c.values()), len(c), plain_ppm(training)
    want = Counter()
    for i, t in ROWS:
        ws, b = tokens(t), b"\0\0\0" + (t or "").encode() + b"\xff"
        want[
            i, is_held(i), len(ws), sum(c[w] > 0 for w in ws), n, round(sum(math.log10((c[w] + 1) / (n + v + 1)) for w in ws), 6),
            round(sum(logp(b[j - 3 : j], b[j]) for j in range(3, len(b))), 6),
        ] += 1
    got = Counter((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6), round(r.score, 6)) for r in out)
    assert got == want


@pytest.mark.parametrize("max_contexts", [0, 4, 1000])
def test_rare_contexts_keep_their_counts(spark, max_contexts):
    rows = ROWS + [(200 + i, t) for i, t in enumerate(["жук жук", "жук ел", "猫が好き", "the жук 猫が", "猫が好き mat."] * 3)]
    docs = spark.createDataFrame([(i, t, n) for n, (i, t) in enumerate(rows)], "doc_id long, text string, row long").repartition(3)
    logp = plain_ppm([t for i, t in rows if not is_held(i)])
    want = Counter()
    for i, t in rows:
        b = b"\0\0\0" + (t or "").encode() + b"\xff"
        want[i, round(sum(logp(b[j - 3 : j], b[j]) for j in range(3, len(b))), 6)] += 1
    assert Counter((r.doc_id, round(r.score, 6)) for r in ppm.score(docs, max_contexts=max_contexts).collect()) == want


def test_probabilities_sum_to_one():
    rng = np.random.default_rng(0)
    data = rng.choice(np.frombuffer(b"abc ", "uint8"), 400)
    codes = ppm.grams(data, np.array([0, 100, 250, 400]))[0].astype("int64")
    keys, counts = [], []
    for o in range(4):
        u, n = np.unique(codes & ((1 << 8 * (o + 1)) - 1), return_counts=True)
        keys.append(u)
        counts.append(n.astype(float))
    for cut in (len(keys[3]), 5, 0):
        trie = ppm.Trie([*keys[:3], keys[3][:cut]], [*counts[:3], counts[3][:cut]])
        for context in (b"\0\0\0", b"abc", b"zzz", b"\0\0a"):
            base = int.from_bytes(context) << 8
            assert abs(sum(10**c for c in trie.costs(np.arange(base, base + 256))) - 1) < 1e-9


def test_no_training_rows_and_empty(spark):
    held = next(i for i in range(1000) if is_held(i))
    out = ppm.score(spark.createDataFrame([(held, "ab")], "doc_id long, text string")).collect()
    assert out[0].n_known == 0 and out[0].train_tokens == 0 and abs(out[0].score + 3 * math.log10(256)) < 1e-9
    assert ppm.score(spark.createDataFrame([], "doc_id long, text string")).count() == 0
