"""Fingerprints: phrases of a text alone and among others, shared substrings, and the neighbours of the whole table."""

import hashlib
import random
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from barloom.llm import phrases
from barloom.llm.phrases import HASHES, edited, fingerprints, fingerprints_of, likeness, phrase_names, with_edits, written
from barloom.llm.queries import op6_phrase_fingerprints
from tests.llm.cases import empty, frame, rows


def test_texts_do_not_touch():
    r = random.Random(2)
    texts = ["".join(r.choice("ab c"[: r.choice([1, 2, 4])]) for _ in range(r.randint(0, 60))) for _ in range(300)]
    for alone, among in zip([phrase_names([t])[0] for t in texts], phrase_names(texts)):
        assert np.array_equal(alone, among)


def test_labels():
    r = np.random.default_rng(1)
    x = r.integers(0, 2**63, 5000, dtype=np.uint64)
    label = phrases._labels(x, np.array([0, 70, 71]))
    assert set(label.tolist()) == {0, 1, 2}
    same = np.flatnonzero(label[1:] == label[:-1]) + 1
    assert set(same.tolist()) <= {70, 71}


def test_equal_substrings_share_names():
    r = random.Random(4)
    core = "".join(r.choice("abcdefghij ") for _ in range(4000))
    inside = set(phrase_names([core])[0].tolist())
    for shift in ("", "x", "some other text ", "q" * 37):
        names = set(phrase_names([shift + core + "tail"])[0].tolist())
        assert len(inside & names) > 0.95 * len(inside)
    assert likeness(*fingerprints_of([core, core])) == 1.0
    assert likeness(*fingerprints_of([core, core[::-1]])) < 0.1
    assert 0.2 < likeness(*fingerprints_of([core, edited(core, core[::-1])])) < 0.6


def test_edges():
    assert [len(f) for f in fingerprints_of(["", "a", "aa", "\ud800", "a" * 100_000])] == [0, 5, 5, 5, 5]  # one name a level
    assert likeness(*fingerprints_of(["", ""])) == 1.0 and likeness(*fingerprints_of(["", "a"])) == 0.0
    assert not np.array_equal(*fingerprints_of(["aaa", "aaaa"]))


def brute(data):
    order = sorted(data, key=lambda r: (-r[0], r[1] or ""))
    out = set()
    for k, (i, t, *_) in enumerate(order):
        t, nxt = t or "", order[(k + 1) % len(order)][1] or ""
        e = edited(t, nxt)
        a, b, c = fingerprints_of([t, e, nxt])
        out.add((i, len(t), hashlib.sha256(e.encode()).hexdigest(), written(a), written(b), likeness(a, b), likeness(a, c)))
    return out


def test_with_edits(spark, monkeypatch):
    data = rows()
    for part in (1 << 20, 500):
        monkeypatch.setattr(phrases, "PART_CHARS", part)
        got = with_edits(frame(spark, data).repartition(6)).collect()
        assert len(got) == len(data) and {tuple(r) for r in got} == brute(data)
    for few in (data[3:4], data[:2], data[5:9]):
        got = with_edits(frame(spark, few)).collect()
        assert len(got) == len(few) and {tuple(r) for r in got} == brute(few)
    assert with_edits(empty(spark)).collect() == []
    twice = [(1, "b", "en", "s", 1), (1, "a", "en", "s", 1), (2, "cc", "en", "s", 2), (2, "cc", "en", "s", 2)]
    assert sorted(r["doc_id"] for r in with_edits(frame(spark, twice)).collect()) == [1, 1, 2, 2]
    assert with_edits(frame(spark, [(None, "x y", "en", "s", 3), (4, "z", "en", "s", 1)])).count() == 2


def test_rows_of_one_id_are_dealt_over_ranges(spark):
    """Half of the rows without id, many of one id: every row once, in one round, and no range with all of them."""
    r = random.Random(6)
    data = [(None if i % 2 else (i if i % 3 else 7), " ".join(str(r.randrange(50)) for _ in range(40)), "en", "s", 0) for i in range(800)]
    out = with_edits(frame(spark, data).repartition(8))
    got = out.withColumn("task", F.spark_partition_id()).collect()
    order = sorted(data, key=lambda x: (x[0] is None, -(x[0] or 0), x[1]))
    want = sorted((-1 if i is None else i, hashlib.sha256(edited(t, order[(k + 1) % len(order)][1]).encode()).hexdigest()) for k, (i, t, *_) in enumerate(order))
    assert sorted((-1 if g["doc_id"] is None else g["doc_id"], g["edited_sha256"]) for g in got) == want
    assert max(Counter(g["task"] for g in got).values()) < 300


def test_likeness_is_near_the_share_of_phrases():
    """Against the exact share of all phrases: HASHES of them leave a standard error of 1 / (2 sqrt(48)) = 0.072 at most."""
    r, errors = random.Random(9), []
    vocab = ["".join(r.choice("abcdefghijklmno") for _ in range(r.randint(2, 8))) for _ in range(400)]
    for _ in range(150):
        words = [r.choice(vocab) for _ in range(r.randint(50, 800))]
        other = [w if r.random() > 0.002 * r.randrange(60) else r.choice(vocab) for w in words]
        a, b = (set(x.tolist()) for x in phrase_names([" ".join(words), " ".join(other)]))
        errors.append(abs(likeness(*fingerprints_of([" ".join(words), " ".join(other)])) - len(a & b) / len(a | b)))
    assert np.mean(errors) < 0.06 and max(errors) < 4 * 0.0722


def test_query(spark, tmp_path):
    data = rows(60)
    frame(spark, data).write.parquet(f"{tmp_path}/documents.parquet")
    assert {tuple(r) for r in op6_phrase_fingerprints(spark, str(tmp_path)).collect()} == brute(data)


def test_fingerprints(spark):
    got = {r["doc_id"]: r["fingerprint"] for r in fingerprints(frame(spark)).collect()}
    assert got == {i: written(fingerprints_of([t or ""])[0]) for i, t, *_ in rows()}
    assert max(map(len, got.values())) == 8 * HASHES and fingerprints(empty(spark)).collect() == []
