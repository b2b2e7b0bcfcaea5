"""Exact dedup and the n-gram Jaccard join against brute force."""

import hashlib
import random
import re
from collections import defaultdict

import numpy as np
import pytest

from barloom.llm import ngram_join
from barloom.llm.components import components
from barloom.llm.exact_dedup import drop_copies, exact_groups
from barloom.llm.ngram_join import ngram_groups
from barloom.llm.prefix_tree import PrefixTree, linked, may_link, overlap_needed, sketch
from tests.llm.cases import empty, frame, rows


def shingles(text, width):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w)} if 0 < len(w) < width else {tuple(w[i : i + width]) for i in range(len(w) - width + 1)}


def brute(data, width, percent):
    sets = [(i, shingles(t, width)) for i, t, *_ in data]
    up = {i: i for i, _ in sets}

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for k, (i, a) in enumerate(sets):
        for j, b in sets[:k]:
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                x, y = root(i), root(j)
                up[max(x, y)] = min(x, y)
    return {(i, len(s), root(i)) for i, s in sets}


@pytest.mark.parametrize("width,percent,block", [(4, 85, 10**6), (5, 80, 10**6), (2, 60, 90), (1, 50, 60)])
def test_ngram_groups(spark, width, percent, block):
    got = {tuple(r) for r in ngram_groups(frame(spark), width, percent, block_members=block).collect()}
    assert got == brute(rows(), width, percent)


def test_ngram_groups_with_common_order(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "COMMON_FROM", 2)
    got = {tuple(r) for r in ngram_groups(frame(spark), 2, 70, block_members=100).collect()}
    assert got == brute(rows(), 2, 70)


def test_ngram_groups_edges(spark):
    assert ngram_groups(empty(spark)).collect() == []
    twice = frame(spark, [(1, "a b c d e f", "en", "s", 11), (1, "a b c d e f", "en", "s", 11), (None, "a b c d e f", "en", "s", 11), (None, "other", "en", "s", 5)])
    assert sorted(map(str, (tuple(r) for r in ngram_groups(twice).collect()))) == sorted(map(str, [(1, 2, 1), (1, 2, 1), (None, 2, 1), (None, 1, None)]))


def test_prefix_tree():
    r = random.Random(5)
    for _ in range(60):
        sets = [np.array(sorted(r.sample(range(30), r.randint(1, 12))), np.int64) for _ in range(r.randint(1, 30))]
        tree = PrefixTree(sets)
        for p in (50, 67, 80):
            for i, s in enumerate(sets):
                want = {j for j, o in enumerate(sets) if len(np.intersect1d(s, o)) >= overlap_needed(len(s), len(o), p)}
                assert set(tree.similar(s, 30, p, lambda j: False)) == want


def test_linked_needs_no_more_pairs_than_sets():
    same = [np.arange(50, dtype=np.uint64) + np.uint64(k % 2) for k in range(40)]
    assert len(linked(same, [True] * 40, 80, lambda x: np.zeros(len(x), np.int64))) == 39


def test_sketches_never_part_similar_sets():
    r = random.Random(9)
    for _ in range(300):
        base = [r.getrandbits(64) for _ in range(r.randint(1, 400))]
        sets = [np.array(sorted({r.getrandbits(64) if r.random() < c else x for x in base[: r.randint(1, len(base))] + base}), np.uint64) for c in (0, 0.05, 0.1, 0.3, 0.9)]
        part = may_link([sketch(s) for s in sets], [len(s) for s in sets], 80)
        for i, a in enumerate(sets):
            for j, b in enumerate(sets):
                if 100 * len(np.intersect1d(a, b)) >= 80 * len(np.union1d(a, b)):
                    assert part[i] == part[j]


def test_large_groups_are_not_sifted(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "SIFTED_SETS", 2)
    got = {tuple(r) for r in ngram_groups(frame(spark), 2, 60, block_members=90).collect()}
    assert got == brute(rows(), 2, 60)


def test_components(spark):
    r = random.Random(1)
    edges = [(r.randrange(60), r.randrange(60)) for _ in range(45)] + [(100 + i, 101 + i) for i in range(40)] + [(None, 3)]
    got = {x["node"]: x["component"] for x in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    near = defaultdict(set)
    for a, b in edges:
        if a is not None and a != b:
            near[a].add(b)
            near[b].add(a)
    for node in near:
        seen, todo = {node}, [node]
        while todo:
            for x in near[todo.pop()] - seen:
                seen.add(x)
                todo.append(x)
        assert got[node] == min(seen)
    assert set(got) == set(near)


def test_exact_groups(spark):
    data = rows() + [(500, "one two", "en", "s", 7), (500, "one two", "en", "s", 7), (None, "o n e", "en", "s", 5)]
    groups = defaultdict(list)
    body = lambda t: re.sub(r"[\x20\x09-\x0D]", "", t or "")
    for i, t, *_ in data:
        groups[body(t)].append((i is None, -len(t or ""), i if i is not None else 0, i))
    want = sorted(str((i, min(g := groups[body(t)])[3], len(g), i == min(g)[3], hashlib.sha256(body(t).encode()).hexdigest())) for i, t, *_ in data)
    assert sorted(str(tuple(r)) for r in exact_groups(frame(spark, data)).collect()) == want
    assert exact_groups(empty(spark)).collect() == []


def test_drop_copies(spark):
    data = rows() + [(3, "one", "en", "s", 3)]
    kept = drop_copies(frame(spark, data))
    assert kept.columns == frame(spark).columns
    texts = [re.sub(r"[\x20\x09-\x0D]", "", r["text"] or "") for r in kept.collect()]
    assert len(texts) == len(set(texts)) == len({re.sub(r"[\x20\x09-\x0D]", "", t or "") for _, t, *_ in data})


def test_drop_copies_of_null_and_shared_ids(spark):
    data = [(None, "a", "en", "s", 1), (None, "a", "en", "s", 1), (None, "b", "en", "s", 1), (7, "c c", "en", "s", 3), (7, "cc", "en", "s", 2), (7, "d", "en", "s", 1), (8, "d", "en", "s", 1), (7, None, "en", "s", 0), (9, "", "en", "s", 0), (None, "e", "en", "s", 1), (6, "e", "en", "s", 1)]
    for _ in range(3):
        kept = sorted(((r["doc_id"], r["text"]) for r in drop_copies(frame(spark, data)).collect()), key=str)
        assert kept == sorted([(None, "a"), (None, "b"), (7, "c c"), (7, "d"), (7, None), (6, "e")], key=str)


def rows_brute(data, width, percent):
    """component_id per row, in order: the smallest doc_id of any row that links reach; equal texts reach each other."""
    sets = [shingles(t, width) for _, t, *_ in data]
    up = list(range(len(data)))

    def root(k):
        while up[k] != k:
            k = up[k]
        return k

    for k, a in enumerate(sets):
        for j, b in enumerate(sets[:k]):
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                x, y = root(k), root(j)
                up[max(x, y)] = min(x, y)
    ids = defaultdict(list)
    for k, (i, *_) in enumerate(data):
        if i is not None:
            ids[root(k)].append(i)
    return [(i, len(sets[k]), min(ids[root(k)], default=None) if sets[k] else i) for k, (i, *_) in enumerate(data)]


def test_one_id_on_several_texts(spark):
    a, b = "a b c d e f g h i j k l m", "n o p q r s t u v w x y z"
    data = [(1, a, "en", "s", 0), (1, b, "en", "s", 0), (2, a + " o", "en", "s", 0), (3, b + " a", "en", "s", 0), (None, "q r s t u v w x y z 1 2 3", "en", "s", 0), (None, "q r s t u v w x y z 1 2 3 4", "en", "s", 0), (5, "q r s t u v w x y z 1 2 3 4 5", "en", "s", 0)]
    assert sorted(map(str, map(tuple, ngram_groups(frame(spark, data)).collect()))) == sorted(map(str, rows_brute(data, 5, 80)))
    assert {r["doc_id"]: r["component_id"] for r in ngram_groups(frame(spark, data)).collect()}[2] == 1


@pytest.mark.parametrize("seed", [1, 2])
def test_random_tables_with_repeated_and_missing_ids(spark, seed):
    r = random.Random(seed)
    data = [(r.choice([None, *range(25)]), t, "en", "s", 0) for _, t, *_ in rows(90, seed)[:-1]]
    got = ngram_groups(frame(spark, data), 3, 70, block_members=120).collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, rows_brute(data, 3, 70)))
    kept = ngram_join.drop_near(frame(spark, data), 3, 70)
    assert kept.columns == frame(spark).columns
    want = [(i, t) for (i, t, *_), (_, n, c) in zip(data, rows_brute(data, 3, 70)) if n == 0 or i == c]
    assert sorted(((x["doc_id"], x["text"]) for x in kept.collect()), key=str) == sorted(want, key=str)
    bodies = {re.sub(r"[\x20\x09-\x0D]", "", t or "") for _, t, *_ in data}
    stay = [re.sub(r"[\x20\x09-\x0D]", "", x["text"] or "") for x in drop_copies(frame(spark, data)).collect()]
    assert len(stay) == len(bodies) and set(stay) == bodies
