"""The trie of turns against a brute-force version and its SQL twin."""

import hashlib
import random
import re
import zlib

import duckdb
import pytest

from barloom.llm import turn_trie
from barloom.llm.queries import op12_turn_trie, oracle_sql

CONVERSATIONS = "conv_id long, turn long, role string, text string, seq string, words string, key string"
COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def rows(n=130, seed=4):
    """Shared openings, copies, single turns, null and equal numbers, null texts, repeated rows, ids far apart."""
    r = random.Random(seed)
    said = ["hi", "hello  there", "", None, "a b c d", "é\tü", "who"]
    out = []
    for i in [*range(n), *range(4_000, 4_020), 9_999_999_999, -7, -40]:
        if i in (40, 41):  # base of the third twenty has no rows
            continue
        for t in range(r.choice((1, 1, 2, 3, 5, 8))):
            out.append((i, r.choice((t, t, t, None, 2)), r.choice(("user", "assistant", None)), r.choice(said[:3] if t < 2 else said)))
    out += [(1, 0, "user", "hi")] * 3 + [(None, 0, "user", "hi"), (77, 9, "user", "long " * 5_000)]
    out += [(6_000 + i, t, "user", "same") for i in range(60) for t in range(6)]
    r.shuffle(out)
    return [(*x, "x", "y", "z") for x in out]


def brute(data):
    own = {}
    for i, turn, role, text, *_ in data:
        if i is not None:
            role, text = role or "", text or ""
            tie = hashlib.md5(f"{len(role.encode())}:{role}{text}".encode()).hexdigest()
            own.setdefault(i, []).append((turn is not None, turn or 0, tie, (role, text)))
    own = {i: [x[3] for x in sorted(t, key=lambda x: x[:3])] for i, t in own.items()}
    base = lambda c: c - int(__import__("math").fmod(c, 20))
    seqs = {c: (*own.get(base(c), [])[:h], *t[h:]) for c, t in own.items() for h in [zlib.crc32(str(c).encode()) % 4]}
    nodes = {}
    for c, s in seqs.items():
        for d in range(len(s) + 1):
            nodes.setdefault(s[:d], []).append(c)
    children = {}
    for p in nodes:
        if p:
            children.setdefault(p[:-1], []).append(p)

    def below(p):
        kids = [below(k) for k in children.get(p, [])]
        words = len(re.findall(r"[^\x20\x09-\x0D]+", p[-1][1])) if p else 0
        return sum(k[0] for k in kids) or 1, sum(k[1] for k in kids) + (len(nodes[p]) - 1) * words

    out = set()
    for p, members in nodes.items():
        ends = ",".join(map(str, sorted(c for c in members if seqs[c] == p)))
        leaves, saved = below(p)
        out.add((min(members), len(p), min(nodes[p[:-1]]) if p else None, len(members), len(children.get(p, [])), leaves, saved, hashlib.sha256(ends.encode()).hexdigest()))
    return out


@pytest.mark.parametrize("turns,fan_in", [(50_000, 64), (3, 64), (7, 2)])
def test_query(spark, tmp_path, turns, fan_in):
    data = rows()
    spark.createDataFrame(data, CONVERSATIONS).repartition(5).write.parquet(f"{tmp_path}/conversations.parquet")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "9")
    if turns == turn_trie.SHARD_TURNS:
        nodes = op12_turn_trie(spark, str(tmp_path))
    else:
        nodes = turn_trie.trie(turn_trie.rebuilt(spark.read.parquet(f"{tmp_path}/conversations.parquet")), turns, fan_in)
    got = [tuple(r) for r in nodes.select(*COLUMNS).collect()]
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    want = brute(data)
    assert set(got) == want and len(got) == len(want)
    if fan_in == 64 and turns > 3:
        db = duckdb.connect()
        db.execute(f"CREATE VIEW conversations AS SELECT * FROM read_parquet('{tmp_path}/conversations.parquet/*.parquet')")
        assert set(db.execute(f"SELECT {', '.join(COLUMNS)} FROM ({oracle_sql()['op12_turn_trie']})").fetchall()) == want


def test_search_tree_is_balanced():
    keys = [i.to_bytes(16, "big") for i in range(1 << 10)]
    order = list(turn_trie._median_first(len(keys)))
    assert sorted(order) == list(range(len(keys))) and order[0] == len(keys) // 2
    nodes = turn_trie.search_tree([([k], [1], 1, i, "e") for i, k in enumerate(keys)])
    assert len(nodes) == len(keys) + 1 and nodes[0]["members"] == len(keys) and nodes[0]["least"] == 0


def test_empty_and_turnless(spark, tmp_path):
    schema = "conv_id long, turn long, role string, text string"
    spark.createDataFrame([(None, 1, "a", "b")], schema).limit(0).write.parquet(f"{tmp_path}/a/conversations.parquet")
    assert op12_turn_trie(spark, f"{tmp_path}/a").collect() == []
    data = [(i, 0, None, None) for i in (1, 2, 3, 5)]  # without a base, some lose their only turn
    spark.createDataFrame(data, schema).write.parquet(f"{tmp_path}/b/conversations.parquet")
    assert {tuple(r) for r in op12_turn_trie(spark, f"{tmp_path}/b").select(*COLUMNS).collect()} == brute(data)
