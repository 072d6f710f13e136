import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from arcweave.llm import bpe

tokenizers = pytest.importorskip("tokenizers")


@pytest.fixture(scope="module")
def both():
    import public_tokenizers as p

    t = tokenizers.Tokenizer.from_file(p.path("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    return bpe._Pieces(bpe.Encoder(bpe.read_ranks(bpe.default_path()))), t


def mine(pieces, text):
    import regex

    return np.frombuffer(b"".join(map(pieces.__getitem__, regex.findall(bpe.PATTERN, text))), np.int32).tolist()


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=60) | st.text("abehinrst 'AE1.\n\t", max_size=80) | st.text("aé漢​🙂", max_size=30))
def test_equals_the_merges(both, text):
    assert mine(both[0], text) == both[1].encode(text, add_special_tokens=False).ids


def test_special_strings_and_long_runs(both):
    for text in ("<|endoftext|> is text", "a" * 5000, "ab" * 3000, " " * 3000 + "x", "\r\n\r\n \t", "=" * 1000):
        assert mine(both[0], text) == both[1].encode(text, add_special_tokens=False).ids


def test_query_form(make, both):
    df = make([(1, "graph data", "x"), (2, "", "y"), (3, None, None), (3, "graph data", "x"), (None, "a", "z")], "doc_id long, text string, ids string")
    got = sorted(((r.doc_id, list(r.ids)) for r in bpe.encode(df, "doc_id", "text").collect()), key=repr)
    want = both[1].encode("graph data").ids
    assert got == sorted([(1, want), (2, []), (3, []), (3, want), (None, both[1].encode("a").ids)], key=repr)
    assert bpe.encode(make([], "doc_id long, text string"), "doc_id", "text").count() == 0
