"""BPE against the tokenizers library."""

import random

import numpy as np
import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from barloom.llm.bpe import Vocabulary, decode, encode
from tests.llm.cases import empty, frame, rows

PATH = public_tokenizers.path("byte_bpe_50k.json")
LIBRARY = Tokenizer.from_file(PATH)
VOCAB = Vocabulary(PATH)


def same(texts):
    got = [np.frombuffer(b, "<i4").tolist() for b in VOCAB.encode_texts(texts)]
    want = [e.ids for e in LIBRARY.encode_batch(texts, add_special_tokens=False)]
    assert got == want
    flat = np.array([i for ids in want for i in ids], np.int64)
    assert VOCAB.decode_ids(flat, np.cumsum([0, *map(len, want)])).to_pylist() == [LIBRARY.decode(i, skip_special_tokens=False) for i in want]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(), max_size=4))
def test_any_text(texts):
    same(texts)


def test_awkward_text():
    r = random.Random(2)
    letters = "abc ABC  \n\t \x1c\x85éß中文क्ष😀0１²'s'll.,!?<|endoftext|>"
    same(["".join(r.choice(letters) for _ in range(r.randint(0, 50))) for _ in range(500)])
    same(["<|endoftext|>", "a<|endoftext|> b", "   ", "", "a" * 3000, "ab" * 2000, " lead", "trail ", "x  y"])
    same(["".join(r.choice("theanding") for _ in range(n)) for n in (1, 2, 3, 5, 9, 129, 130, 255, 256, 257, 258, 700)])


def test_partial_bytes_decode():
    ids = LIBRARY.encode("😀é", add_special_tokens=False).ids[:1] + LIBRARY.encode("é中", add_special_tokens=False).ids[::-1]
    assert VOCAB.decode_ids(np.array(ids), np.array([0, len(ids)])).to_pylist() == [LIBRARY.decode(ids, skip_special_tokens=False)]


def test_frames(spark):
    tokens = encode(frame(spark), PATH)
    got = {r["doc_id"]: (r["ids"], r["decoded"]) for r in decode(tokens, PATH).collect()}
    for i, text, *_ in rows():
        ids = LIBRARY.encode(text or "", add_special_tokens=False).ids
        assert got[i] == (ids, text or "")
    assert encode(empty(spark), PATH).collect() == []
    assert decode(spark.createDataFrame([(1, None), (2, [])], "doc_id long, ids array<int>"), PATH).select("doc_id", "decoded").collect() == [(1, ""), (2, "")]


def test_forgetting_changes_nothing(monkeypatch):
    """Pieces met anew after a turn of memory get the same ids as in a vocabulary that forgets nothing."""
    from barloom.llm import bpe

    path = public_tokenizers.path("byte_bpe_50k.json")
    texts = [f"word{i % 7} naïve{chr(228 + i % 5)}x can't  {i}\n 中{i % 3} ɐb" * 3 for i in range(60)]
    want = bpe.Vocabulary(path).encode_texts(texts)
    monkeypatch.setattr(bpe, "REMEMBERED", 5)
    small = bpe.Vocabulary(path)
    assert [ids for _ in range(2) for k in range(0, 60, 4) for ids in small.encode_texts(texts[k : k + 4])] == want * 2
