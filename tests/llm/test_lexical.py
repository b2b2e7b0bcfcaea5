"""Ranked search against scores worked out term by term, and against its SQL twin."""

import math
import random
import re
from collections import Counter

import duckdb
import numpy as np

from barloom.llm import lexical
from barloom.llm.queries import op11_max_sketch_search, oracle_sql
from tests.llm import cases

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
UPPER = {c: c + 32 for c in range(65, 91)}


def terms(text):
    return [t.translate(UPPER) for t in TERM.findall(text or "")]


def brute(docs, items, top):
    held = [(i, Counter(terms(t))) for i, t in docs]
    n_docs, tokens = sum(bool(c) for _, c in held), sum(sum(c.values()) for _, c in held)
    df = Counter(t for _, c in held for t in c)
    asked = {}
    for i, t in items:
        asked.setdefault(i, set()).update(terms(t))
    out = set()
    for item, words in asked.items():
        scored = []
        for d, c in held:
            m = 50 + (50 * sum(c.values()) * n_docs) // tokens
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((1_000_000_000 * c[t]) // (1000 * c[t] + 20 * m)) for t in words if t in c)
            if score > 0:
                scored.append((-score, d is None, d or 0, d))
        out |= {(item, k, d, -s) for k, (s, _, _, d) in enumerate(sorted(scored)[:top], 1)}
    return out


ITEMS = [(1, "a b c"), (2, "One TWO"), (3, None), (4, ""), (5, "zzz nothing"), (6, "É ü ß common line shared"), (1, "abc def"), (None, "x y"), (7, "dense")]


def test_query(spark, tmp_path):
    rows = cases.rows(300) + [(None, "one two three", "en", "s", 0), (3, "one", "en", "s", 0), (7, "dense " * 700, "en", "s", 0)]
    rows += [(10_000 + i, "tie tie One", "en", "s", 0) for i in range(120)]
    cases.frame(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(ITEMS, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = [tuple(r) for r in op11_max_sketch_search(spark, str(tmp_path)).select("item_id", "rank", "doc_id", "score").collect()]
    want = brute([(r[0], r[1]) for r in rows], ITEMS, 50)
    assert set(got) == want and len(got) == len(want)
    db = duckdb.connect()
    for t in ("documents", "benchmark"):
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{tmp_path}/{t}.parquet/*.parquet')")
    assert set(db.execute(f"SELECT item_id, rank, doc_id, score FROM ({oracle_sql()['op11_max_sketch_search']})").fetchall()) == want


def test_blocks_of_items(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(lexical, "BLOCK", 2)
    rows = cases.rows(100)
    lexical.build_index(cases.frame(spark, rows), f"{tmp_path}/i")
    got = {tuple(r) for r in lexical.search(spark, f"{tmp_path}/i", spark.createDataFrame(ITEMS, "item_id long, text string"), 5).collect()}
    assert got == brute([(r[0], r[1]) for r in rows], ITEMS, 5)


def test_no_term_scores_more_than_its_coordinate():
    r = random.Random(1)
    for n in (0, 1, 50, 3000):
        terms = np.unique(np.array([r.getrandbits(64) for _ in range(n)], np.uint64))
        counts = np.array([r.choice((1, 2, 300)) for _ in terms], np.int64)
        s = lexical.sketch(terms, counts)
        assert len(s) >= lexical.NARROW and len(s) & (len(s) - 1) == 0
        assert all(s[int(t) & (len(s) - 1)] >= min(c, lexical.MOST) for t, c in zip(terms, counts))
        assert (s > 0).sum() <= len(terms)


def test_empty(spark, tmp_path):
    cases.empty(spark).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(ITEMS, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert op11_max_sketch_search(spark, str(tmp_path)).collect() == []
    cases.frame(spark).write.mode("overwrite").parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "item_id long, text string").write.mode("overwrite").parquet(f"{tmp_path}/benchmark.parquet")
    assert op11_max_sketch_search(spark, str(tmp_path)).collect() == []
