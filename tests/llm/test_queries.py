"""Queries run by name against plain versions: tokens, quality, the token store's digests and the n-gram join."""

import hashlib
import zlib

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from barloom.llm import queries
from barloom.llm.common import table
from barloom.llm.quality import learn, score_quality
from tests.llm import cases

SF = "/root/testdata/sf0.01"


def documents(spark, path, data):
    cases.frame(spark, data).write.parquet(f"{path}/documents.parquet")
    return str(path)


def library(name):
    t = Tokenizer.from_file(public_tokenizers.path(name))
    t.no_truncation()
    t.no_padding()
    return t


def test_op1(spark, tmp_path):
    data = cases.rows(60) + [(3, "Twice  the same", "en", "s", 0), (3, "Twice  the same", "en", "s", 0), (None, "no id é", "en", "s", 0)]
    lib = library("byte_bpe_50k.json")
    want = []
    for i, t, *_ in data:
        ids = lib.encode(t or "", add_special_tokens=False).ids
        want.append((i, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(lib.decode(ids, skip_special_tokens=False).encode()).hexdigest()))
    got = [tuple(r) for r in queries.op1_bpe(spark, documents(spark, tmp_path, data)).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256").collect()]
    assert sorted(got, key=str) == sorted(want, key=str)


def test_op3(spark, tmp_path):
    """Scores are those of the learnt rules whatever the row's other columns; labels beyond the learnt ones change nothing."""
    docs, labels = table(spark, SF, "documents"), table(spark, SF, "labels")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    hidden = [r["doc_id"] for r in labels.collect() if zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0]
    labels.selectExpr("doc_id", f"if(doc_id in ({', '.join(map(str, hidden))}), 1 - quality, quality) AS quality", "toxic").write.parquet(f"{tmp_path}/labels.parquet")
    got = {r["doc_id"]: r for r in queries.op3_quality_rules(spark, str(tmp_path)).collect()}
    want = {r["doc_id"]: r["score"] for r in score_quality(docs, learn(docs, labels)).select("doc_id", "score").collect()}
    assert {i: r["score"] for i, r in got.items()} == want
    truth = {r["doc_id"]: r["quality"] for r in labels.collect()}
    for i, r in got.items():
        assert 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) and r["held_out"] == (zlib.crc32(str(i).encode()) % 5 == 0)
    held = [(got[i]["predicted"], truth[i]) for i in hidden]
    assert np.mean([a == b for a, b in held]) > 0.95


def test_op7(spark, tmp_path):
    data = cases.rows(60)
    lib = library("word_bpe_49k.json")
    want, at = set(), 0
    for i, t, *_ in sorted(data):
        ids = np.array([*lib.encode(t or "", add_special_tokens=False).ids, 2], "<u4")
        want.add((i, at, len(ids), zlib.crc32(ids.tobytes())))
        at += len(ids)
    got = queries.op7_token_store(spark, documents(spark, tmp_path, data)).select("doc_id", "start", "n_tokens", "ids_crc32").collect()
    assert {tuple(r) for r in got} == want and len(got) == len(data)


def test_op9(spark, tmp_path):
    data = cases.rows(150)
    upper = {c: c + 32 for c in range(65, 91)}
    sets = {}
    for i, t, *_ in data:
        words = (t or "").translate(upper).replace("\x0b", " ").replace("\x0c", " ").split()
        sets[i] = {tuple(words[k : k + 4]) for k in range(max(1, len(words) - 3))} if words else set()
    up = {i: i for i in sets}

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i, a in sets.items():
        for j, b in sets.items():
            if i < j and a and b and 100 * len(a & b) >= 85 * len(a | b):
                x, y = root(i), root(j)
                up[max(x, y)] = min(x, y)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in queries.op9_ngram_jaccard_join(spark, documents(spark, tmp_path, data)).collect()}
    assert got == {i: (len(s), root(i)) for i, s in sets.items()} and any(root(i) != i for i in sets)


def test_every_query_is_named_for_its_operator():
    names = sorted(int(n[2:].split("_")[0]) for n in queries.queries())
    assert names == list(range(1, 14)) and set(queries.oracle_sql()) <= set(queries.queries())
    assert all(f.__doc__ for f in queries.queries().values())
