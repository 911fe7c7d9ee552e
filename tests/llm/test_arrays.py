"""Words and shingles against regular expressions."""

import re

import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from gneiss.llm import arrays

TEXT = st.text(alphabet="abAB é\t\n\x0b.", max_size=30)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.one_of(st.none(), TEXT), max_size=6), st.integers(1, 60), st.integers(1, 4))
def test_words_and_shingles(texts, size, k):
    powers, found, sets = arrays.Powers(), [], []
    for row, data, offsets in arrays.chunks(pa.array(texts, pa.string()), size):
        assert row == len(found)
        starts, ends, first = arrays.words(data, offsets)
        h = arrays.word_hashes(data, starts, ends, powers)
        s, begin = arrays.shingles(h, first, k)
        for i in range(len(offsets) - 1):
            found.append([bytes(data[a:b]).decode() for a, b in zip(starts[first[i] : first[i + 1]], ends[first[i] : first[i + 1]], strict=True)])
            sets.append((h[first[i] : first[i + 1]].tolist(), s[begin[i] : begin[i + 1]].tolist()))
    want = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for t in texts]
    assert found == want
    names, shingle = {}, {}
    low = str.maketrans("AB", "ab")
    for ws, (hs, ss) in zip(want, sets, strict=True):
        ws = [w.translate(low) for w in ws]
        for w, h in zip(ws, hs, strict=True):
            assert names.setdefault(w, h) == h
        own = [tuple(ws[i : i + k]) for i in range(max(len(ws) - k + 1, min(1, len(ws))))]
        assert len(own) == len(ss)
        for w, h in zip(own, ss, strict=True):
            assert shingle.setdefault(w, h) == h
    assert len(set(names.values())) == len(names) and len(set(shingle.values())) == len(shingle)
