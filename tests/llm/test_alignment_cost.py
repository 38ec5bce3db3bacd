"""What the encoding of one text must not cost: a pool of threads, a join of its tokens, a compressor's context."""

import os

import numpy as np
import pytest

from foldlens.llm import alignment

pytestmark = pytest.mark.skipif(not os.path.isdir(alignment.TOKENIZERS), reason="tokenizers are absent")


def test_ids_take_two_bytes_uncompressed():
    for ids in (np.arange(50_000), np.zeros(0, np.int64), np.array([3, 1 << 16, 7])):
        raw = alignment.packed(ids)
        assert len(raw) == 1 + len(ids) * (4 if len(ids) == 3 else 2) and np.array_equal(alignment.unpacked(raw), ids)


def test_a_text_is_encoded_without_lists_and_checked_whole():
    with open(f"{alignment.TOKENIZERS}/byte_bpe_50k.json", "rb") as a, open(f"{alignment.TOKENIZERS}/piece_bpe_32k.model", "rb") as b:
        both = alignment.Encoders(a.read(), b.read())
    model = both.b

    class Single:
        def EncodeAsIds(self, text):
            assert isinstance(text, str)
            return model.EncodeAsIds(text)

    both.b = Single()
    got = list(both.encode(["Two words, é.", None, "", "a  b", "ﬁ"]))
    for (a, b), text in zip(got, ["Two words, é.", None, "", "a  b", "ﬁ"], strict=True):
        a_bytes, b_bytes = b"".join(both.bytes_a[i] for i in a), b"".join(both.bytes_b[i] for i in b)
        assert a_bytes == b_bytes == (f" {text}".encode() if len(a) else b"")
    assert len(got[0][0]) and not len(got[1][0]) and not len(got[2][0])
