import re

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from tempolink.llm.shared import WORDLIKE, shingle_sets, text_slices, word_spans

TEXTS = st.lists(st.text(alphabet="aBc é\n\t.😀", max_size=40), min_size=1, max_size=8)


def lower(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t)


def shingles(t):
    w = re.findall(r"[^\x20\x09-\x0D]+", lower(t))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


@settings(max_examples=80, deadline=None)
@given(TEXTS)
def test_sets_are_those_of_a_plain_rule(texts):
    mine, names = [], {}
    for _, data, offs in text_slices(pa.array(texts)):
        v, e = shingle_sets(data, offs)
        mine += [frozenset(v[a:b].tolist()) for a, b in zip(e, e[1:])]
    for t, m in zip(texts, mine):
        want = shingles(t)
        assert len(want) == len(m)
        for u, k in zip(texts, mine):
            assert len(want & shingles(u)) == len(m & k)
    assert not names


@settings(max_examples=50, deadline=None)
@given(TEXTS)
def test_word_spans(texts):
    got = []
    for _, data, offs in text_slices(pa.array(texts), most=10):
        s, e, first = word_spans(data, offs, WORDLIKE)
        got += [[bytes(data[a:b]).decode() for a, b in zip(s[i:j], e[i:j])] for i, j in zip(first, first[1:])]
    assert got == [re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", t) for t in texts]


def test_slices_hold_whole_rows_and_null_is_empty():
    column = pa.array(["ab", None, "", "c" * 50, "d"]).slice(1)
    parts = [(r, bytes(d), o.tolist()) for r, d, o in text_slices(column, most=10)]
    assert b"".join(d for _, d, _ in parts) == b"c" * 50 + b"d"
    assert sum(len(o) - 1 for _, _, o in parts) == 4
    assert not list(text_slices(pa.array([], pa.string())))
    assert np.diff(parts[0][2]).tolist()[:2] == [0, 0]
