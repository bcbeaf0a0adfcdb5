import re

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from gritstone.llm import _words as W

TEXTS = st.lists(st.one_of(st.none(), st.text(alphabet="ab AB\t\n\x0b\x1c é.ñ1_-\x00日", max_size=30)), max_size=8)


@settings(max_examples=150, deadline=None)
@given(TEXTS)
def test_words_equal_the_patterns(texts):
    for table, pattern, fold in ((W.plain_table(), r"[^\x20\x09-\x0D]+", False), (W.folded_table(), r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", True)):
        data, offsets = W.utf8(pa.array(texts, pa.string()))
        words = W.split(data, offsets, table)
        seen = {}
        for i, t in enumerate(texts):
            t = re.sub("[A-Z]", lambda m: m[0].lower(), t or "") if fold else t or ""
            at = range(words.first[i], words.first[i + 1])
            got = [bytes(words.data[words.starts[k] : words.ends[k]]).decode() for k in at]
            got = [re.sub("[A-Z]", lambda m: m[0].lower(), x) for x in got] if fold else got
            assert got == re.findall(pattern, t)
            for k, x in zip(at, got):
                assert seen.setdefault(x, words.hashes[k]) == words.hashes[k]
        assert len(set(seen.values())) == len(seen)


def test_grams_and_minima():
    h = W.mix(np.arange(200, dtype=np.uint64) % 7)
    for k in (1, 2, 3, 7, 13, 50):
        g, seen = W.grams(h, k), {}
        assert len(g) == 201 - k and all(seen.setdefault(tuple(h[i : i + k]), x) == x for i, x in enumerate(g)) and len(set(seen.values())) == len(seen)
    x = np.random.default_rng(0).integers(0, 5, 100)
    assert all(at == i + int(np.argmin(x[i : i + 7])) for i, at in enumerate(W.sliding_argmin(x, 7)))
    assert len(W.grams(h[:3], 5)) == 0 and len(W.sliding_argmin(x[:2], 5)) == 0


def test_pieces_cover_all_texts():
    offsets = np.array([0, 0, 5, 5, 100, 101])
    parts = list(W.pieces(offsets, 10))
    assert parts[0][0] == 0 and parts[-1][1] == 5 and all(a[1] == b[0] for a, b in zip(parts, parts[1:]))
