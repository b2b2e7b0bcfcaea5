"""The token store: ids against the tokenizers library, round trips, stored once, tampering found."""

import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from barloom.llm import token_store as ts
from tests.llm.cases import empty, frame, rows

PATH = public_tokenizers.path("word_bpe_49k.json")
LIBRARY = Tokenizer.from_file(PATH)


def same(texts):
    got = [np.frombuffer(b, "<u4").tolist() for b in ts.encoder(PATH).encode(texts)]
    assert got == [e.ids for e in LIBRARY.encode_batch(texts, add_special_tokens=False)]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(), max_size=4))
def test_any_text(texts):
    same(texts)


def test_awkward_text(monkeypatch):
    monkeypatch.setattr(ts, "REMEMBERED", 50)
    r = random.Random(2)
    letters = "abc ABC  \n\t \x1c\x85\xa0éß中文क्ष😀0１²'s'll.,!?<|endoftext|>ΣσİıǺ̇́ªº"
    for _ in range(5):
        same(["".join(r.choice(letters) for _ in range(r.randint(0, 50))) for _ in range(400)])
    same(["<|endoftext|>", "A<|endoftext|> B.", "   ", "", "it's. don't, x., y..", "a" * 3000])


def test_cuts():
    r = np.random.default_rng(3)
    ids = r.integers(0, 60_000, 60_000).astype(np.uint32)
    for s in (ids, ids[:1], ids[:0], np.zeros(30_000, np.uint32)):
        at = ts.cuts(s)
        assert at[0] == 0 and at[-1] == len(s) and all(0 < b - a <= ts.MOST for a, b in zip(at, at[1:]) if len(s)) and (len(s) == 0 or at == sorted(set(at)))
    whole = {ts.digest_of(ids[a:b]) for a, b in zip(ts.cuts(ids), ts.cuts(ids)[1:])}
    shifted = np.concatenate([ids[:777], ids])
    other = {ts.digest_of(shifted[a:b]) for a, b in zip(ts.cuts(shifted), ts.cuts(shifted)[1:])}
    assert len(whole & other) > 0.9 * len(whole)
    for s in (ids[:500], ids[:0], np.array([70_000, 1], np.uint32)):
        assert ts.unpacked(ts.packed(s)).tolist() == s.tolist()


@given(st.binary(max_size=50), st.binary(max_size=70))
def test_crc(a, b):
    assert ts.crc_joined(zlib.crc32(a), zlib.crc32(b), len(b)) == zlib.crc32(a + b)


def expected(data):
    out, at = [], 0
    for i, t, *_ in sorted(data, key=lambda r: (r[0] is not None, r[0] or 0)):
        ids = [*LIBRARY.encode(t or "", add_special_tokens=False).ids, 2]
        out.append((i, at, ids))
        at += len(ids)
    return out


def test_store(spark, tmp_path, monkeypatch):
    data = rows() + [(700, "same text " * 900, "en", "s", 9000), (701, "same text " * 900, "en", "s", 9000)]
    path = f"{tmp_path}/s"
    ts.write_store(frame(spark, data), PATH, path)
    want = expected(data)
    got = ts.read_store(spark, path).collect()
    assert sorted((r["doc_id"], r["start"], r["ids"]) for r in got) == want
    sums = ts.read_checksums(spark, path).collect()
    assert sorted((r["doc_id"], r["start"], r["n_tokens"], r["ids_crc32"]) for r in sums) == [(i, s, len(x), zlib.crc32(np.array(x, "<u4").tobytes())) for i, s, x in want]
    chunks = spark.read.parquet(f"{path}/chunks").collect()
    assert len({bytes(c["digest"]) for c in chunks}) == len(chunks)
    manifest = spark.read.parquet(f"{path}/manifest").orderBy("first_doc").collect()
    assert sum(m["documents"] for m in manifest) == len(data) and sum(m["tokens"] for m in manifest) == sum(len(x) for *_, x in want)
    assert all(a["last_doc"] < b["first_doc"] for a, b in zip(manifest, manifest[1:]))


def test_tampering_is_found(spark, tmp_path):
    path = f"{tmp_path}/s"
    ts.write_store(frame(spark, rows(20)), PATH, path)
    bad = [(c["n"], bytes(c["digest"]), ts.packed(np.arange(c["n"], dtype=np.uint32))) for c in spark.read.parquet(f"{path}/chunks").collect()]
    spark.createDataFrame(bad, "n long, digest binary, blob binary").write.mode("overwrite").parquet(f"{path}/chunks")
    for read in (ts.read_store, ts.read_checksums):
        with pytest.raises(Exception, match="doesn't fit its digest"):
            read(spark, path).collect()
    spark.createDataFrame([], "n long, digest binary, blob binary").write.mode("overwrite").parquet(f"{path}/chunks")
    with pytest.raises(Exception, match="chunk is missing"):
        ts.read_store(spark, path).collect()


def test_edges(spark, tmp_path):
    ts.write_store(empty(spark), PATH, f"{tmp_path}/e")
    assert ts.read_store(spark, f"{tmp_path}/e").collect() == [] == ts.read_checksums(spark, f"{tmp_path}/e").collect()
    odd = [(None, "x", "en", "s", 1), (None, None, "en", "s", 0), (5, "one", "en", "s", 3), (5, "one", "en", "s", 3)]
    ts.write_store(frame(spark, odd), PATH, f"{tmp_path}/o")
    got = ts.read_store(spark, f"{tmp_path}/o").collect()
    assert sorted(str(r["doc_id"]) for r in got) == ["5", "5", "None", "None"] and sorted(r["start"] for r in got)[0] == 0


def test_root_of_leaves_one_by_one():
    leaves = [bytes([i]) * 16 for i in range(70)]
    for n in range(len(leaves) + 1):
        root = ts.Root()
        for leaf in leaves[:n]:
            root.add(leaf)
        assert root.value() == ts.merkle(leaves[:n])


def test_parts_lost_from_recipes_and_manifest_are_found(spark, tmp_path):
    path = f"{tmp_path}/s"
    ts.write_store(frame(spark, rows(20)), PATH, path)
    recipes, manifest, head = (spark.createDataFrame(d.collect(), d.schema) for d in (spark.read.parquet(f"{path}/{n}") for n in ("recipes", "manifest", "head")))
    parts = sorted(r["part"] for r in manifest.collect())
    assert len(parts) > 2
    for lost in (parts[-1:], parts[:1], parts[1:2], parts[1:], parts):
        keep = f"part not in ({', '.join(map(str, lost))})"
        for table, name in ((recipes, "recipes"), (manifest, "manifest")):
            table.where(keep).write.mode("overwrite").parquet(f"{path}/{name}")
        for read in (ts.read_store, ts.read_checksums):
            with pytest.raises(Exception, match="doesn't fit the head|where the one before it ends"):
                read(spark, path).collect()
    recipes.write.mode("overwrite").parquet(f"{path}/recipes")
    manifest.write.mode("overwrite").parquet(f"{path}/manifest")
    assert ts.read_checksums(spark, path).count() == recipes.count()
    head.limit(0).write.mode("overwrite").parquet(f"{path}/head")
    with pytest.raises(Exception, match="doesn't fit the head"):
        ts.read_checksums(spark, path).collect()


def test_lost_recipes_are_found(spark, tmp_path):
    path = f"{tmp_path}/s"
    ts.write_store(frame(spark, rows(20)), PATH, path)
    recipes, manifest = (spark.createDataFrame(d.collect(), d.schema) for d in (spark.read.parquet(f"{path}/{n}") for n in ("recipes", "manifest")))
    last = recipes.agg({"start": "max"}).first()[0]
    for changed in (recipes.where(f"start < {last}"), recipes.where("start > 0"), recipes.where("start = 0"), recipes.limit(0), recipes.selectExpr("doc_id", "start + 1 AS start", "n_tokens", "digests", "sizes", "root", "part")):
        changed.write.mode("overwrite").parquet(f"{path}/recipes")
        for read in (ts.read_store, ts.read_checksums):
            with pytest.raises(Exception, match="fit the manifest|where the one before it ends"):
                read(spark, path).collect()
    two = recipes.where("n_tokens > 1").orderBy("start").limit(2).collect()
    swapped = [r.asDict() | ({"digests": two[1 - two.index(r)]["digests"], "sizes": two[1 - two.index(r)]["sizes"]} if r in two else {}) for r in recipes.collect()]
    spark.createDataFrame(swapped, recipes.schema).write.mode("overwrite").parquet(f"{path}/recipes")
    for read in (ts.read_store, ts.read_checksums):
        with pytest.raises(Exception, match="fit its root"):
            read(spark, path).collect()
    recipes.write.mode("overwrite").parquet(f"{path}/recipes")
    assert ts.read_checksums(spark, path).count() == ts.read_store(spark, path).count() == recipes.count()
    assert manifest.count() > 1
    first = manifest.agg({"part": "min"}).first()[0]
    manifest.where(f"part > {first}").write.mode("overwrite").parquet(f"{path}/manifest")
    with pytest.raises(Exception, match="fit the manifest"):
        ts.read_checksums(spark, path).collect()
    manifest.limit(0).write.mode("overwrite").parquet(f"{path}/manifest")
    with pytest.raises(Exception, match="fit the manifest"):
        ts.read_checksums(spark, path).collect()
