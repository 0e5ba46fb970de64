import random

import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from cumulo.llm import packing, token_counts
from tests.llm import cases

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


@settings(max_examples=150, deadline=None)
@given(st.text(max_size=60))
def test_counts_and_ids_equal_the_library(text):
    ids = Tokenizer_cached().encode(text, add_special_tokens=False).ids
    assert token_counts.merger(PATH).count(text) == len(ids)
    assert packing.encoder(PATH)(text).tolist() == ids


_LIBRARY = []


def Tokenizer_cached():
    if not _LIBRARY:
        _LIBRARY.append(Tokenizer.from_file(PATH))
    return _LIBRARY[0]


def test_spaces_marks_and_long_pieces(library):
    draw = random.Random(2)
    parts = [" ", "  ", "\n", "\t", "\x85", "\xa0", "　", "a", "the", "é", "'s", "'ll", "!", "1", "<|endoftext|>", "😀", "\r\n"]
    texts = ["".join(draw.choice(parts) for _ in range(draw.randint(0, 25))) for _ in range(400)]
    texts += ["a" * 50_000, " " * 9_000 + "b", "ab " * 5_000 + " "]
    for text in texts:
        assert token_counts.merger(PATH).count(text) == len(library.encode(text, add_special_tokens=False).ids)


def test_rows(spark, library):
    ours = [tuple(r) for r in token_counts.count_tokens(cases.messy(spark), PATH).collect()]
    wanted = []
    for i, t, _ in cases.messy_rows():
        n = len(library.encode(t or "", add_special_tokens=False).ids)
        wanted.append((i, len((t or "").encode()), n, n > 512))
    assert cases.counted(ours) == cases.counted(wanted)
    assert token_counts.count_tokens(cases.empty(spark), PATH).count() == 0
