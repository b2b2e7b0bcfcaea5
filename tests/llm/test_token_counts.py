"""Counts of tokens without the tokens: those of encode(), special tokens, nulls and repeated rows included."""

import public_tokenizers

from barloom.llm.bpe import vocabulary
from barloom.llm.packing import documents_as_items, documents_as_lengths
from barloom.llm.queries import END_OF_TEXT
from tests.llm.cases import empty, frame

PATH = public_tokenizers.path("byte_bpe_50k.json")


def test_counts(spark):
    special = next(iter(vocabulary(PATH).special))
    more = spark.createDataFrame([(9_000_001, f"a {special}b{special}", "s"), (9_000_002, None, None), (9_000_002, None, None)], "doc_id long, text string, source string")
    docs = frame(spark).select("doc_id", "text", "source").unionByName(more)
    want = documents_as_items(docs, PATH, END_OF_TEXT).drop("ids").collect()
    got = documents_as_lengths(docs, PATH)
    assert got.columns == ["doc_id", "n_tokens", "source", "cluster"]
    assert sorted(map(str, got.collect())) == sorted(map(str, want))
    assert documents_as_lengths(empty(spark), PATH).collect() == []
