import re

import numpy as np
import pyarrow as pa

from dnsq.llm import words as W

from .helpers import prose, shingles

TEXTS = ["", None, "one", "One oNE two", " a\tb\nc\x0bd\x0ce\rf ", "é É e´ 日本 x1 3y", "a" * 3_000_000 + " b", prose(1, 500), "a b c d", "a b c d e"]


def test_equal_words_have_equal_hashes_and_no_others():
    for inside, pattern in ((W.NOT_SPACE, r"[^\x20\x09-\x0D]+"), (W.ALPHANUMERIC, r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")):
        h, before = W.word_hashes(*W.text_buffer(pa.array(TEXTS, pa.string())), inside)
        fold = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
        want = [re.findall(pattern, (t or "").translate(fold)) for t in TEXTS]
        assert np.diff(before).tolist() == [len(w) for w in want]
        seen = {}
        for word, value in zip([x for w in want for x in w], h.tolist()):
            assert seen.setdefault(word, value) == value
        assert len(set(seen.values())) == len(seen)


def test_slices_of_a_column_and_empty_columns():
    column = pa.array(TEXTS, pa.string())
    whole, before = W.word_hashes(*W.text_buffer(column), W.NOT_SPACE)
    part, _ = W.word_hashes(*W.text_buffer(column.slice(3, 4)), W.NOT_SPACE)
    assert part.tolist() == whole[before[3] : before[7]].tolist()
    assert W.word_hashes(*W.text_buffer(pa.array([], pa.string())), W.NOT_SPACE)[1].tolist() == [0]


def test_shingle_sets_have_the_right_size():
    texts = [t for t in TEXTS if t is None or len(t) < 10_000]
    got = W.shingles(*W.word_hashes(*W.text_buffer(pa.array(texts, pa.string())), W.NOT_SPACE), 5)
    assert [len(s) for s in got] == [len(shingles(t)) for t in texts]
    assert all((s[1:] > s[:-1]).all() for s in got)


def test_binaries_are_the_slices():
    out = W.binaries(np.arange(6, dtype="<u2"), [0, 2, 2, 6])
    assert [np.frombuffer(x.as_py(), "<u2").tolist() for x in out] == [[0, 1], [], [2, 3, 4, 5]]
