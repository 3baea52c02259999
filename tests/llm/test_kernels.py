import re

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from quillstone.llm import kernels as K

TEXT = st.text(alphabet="ab \n\té😀\x0b", max_size=40)


@settings(max_examples=80, deadline=None)
@given(st.lists(st.one_of(st.none(), TEXT), max_size=8), st.integers(1, 30))
def test_spans_are_the_words_of_each_row(texts, limit):
    seen = []
    for part in K.slices(pa.array(texts, pa.string()), limit):
        starts, ends, by = K.spans(part.data, part.offsets, K.NOT_BLANK)
        raw = part.data.tobytes()
        seen += [[raw[s:e].decode() for s, e in zip(starts[by[i] : by[i + 1]], ends[by[i] : by[i + 1]])] for i in range(len(part))]
    assert seen == [re.findall(r"[^\x20\x09-\x0D]+", t or "") for t in texts]


def test_hashes_depend_on_the_bytes_alone():
    words = [b"a", b"ab", b"ba", b"\x00", b"\x00\x00", b"x" * 3_000_000, b"x" * 2_999_999, b"a"]
    data = np.frombuffer(b" ".join(words), np.uint8)
    starts = np.cumsum([0] + [len(w) + 1 for w in words[:-1]])
    h = K.hash_spans(data, starts, starts + [len(w) for w in words])
    assert h[0] == h[-1] and len(set(h.tolist())) == len(words) - 1
    assert h[5] == K.hash_spans(np.frombuffer(words[5], np.uint8), np.array([0]), np.array([len(words[5])]))[0]


def test_prefixes_count_characters():
    data = np.frombuffer("éab éac x".encode(), np.uint8)
    starts, ends, _ = K.spans(data, np.array([0, len(data)]), K.NOT_BLANK)
    h, there = K.hash_prefixes(data, starts, ends, (1, 2))
    assert h[0, 1] == h[1, 1] and h[0, 2] == h[1, 2] and h[0, 0] != h[1, 0]
    assert there.tolist() == [[True, True, True], [True, True, True], [True, False, False]]


def test_slices_cover_all_rows_of_a_sliced_column():
    column = pa.array(["a", None, "bb", "", "c"]).slice(1, 3)
    assert [(p.first, p.data.tobytes(), p.offsets.tolist()) for p in K.slices(column, 1)] == [(0, b"", [0, 0]), (1, b"bb", [0, 2]), (2, b"", [0, 0])]
    assert list(K.slices(pa.array([], pa.string()))) == []
