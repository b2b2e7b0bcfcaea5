"""Packing: every token once, no bin too full, no conflict, and the tightest compatible bin."""

import random
from collections import defaultdict

import public_tokenizers
from tokenizers import Tokenizer

from barloom.llm.packing import best_fit, documents_as_items, pack, sequences
from barloom.llm.queries import END_OF_TEXT, queries
from tests.llm.cases import empty, frame, rows


def slow_best_fit(sizes, sources, clusters, capacity):
    bins, out = [], []
    for size, s, c in zip(sizes, sources, clusters):
        fits = [(b["left"], k) for k, b in enumerate(bins) if b["left"] >= size and b["left"] > 0 and s not in b["s"] and c not in b["c"]]
        k = min(fits)[1] if fits else len(bins)
        if not fits:
            bins.append({"left": capacity, "s": set(), "c": set()})
        bins[k]["left"] -= size
        bins[k]["s"] |= {s} - {-1}
        bins[k]["c"] |= {c} - {-1}
        out.append(k)
    return out


def test_best_fit():
    r = random.Random(6)
    for _ in range(200):
        n = r.randint(0, 60)
        sizes = sorted((r.randint(1, 50) for _ in range(n)), reverse=True)
        sources, clusters = [r.randint(-1, 5) for _ in range(n)], [r.randint(-1, 8) for _ in range(n)]
        assert best_fit(sizes, sources, clusters, 50) == slow_best_fit(sizes, sources, clusters, 50)


def check(items, placed, capacity):
    tokens, bins = defaultdict(int), defaultdict(list)
    for r in placed:
        tokens[r["doc_id"]] += r["n_tokens"]
        bins[r["shard"], r["bin"]].append(r)
    want = defaultdict(int)
    for i, n, *_ in items:
        want[i] += n or 0
    assert tokens == want
    about = {i: (s, c) for i, _, s, c in items}
    for pieces in bins.values():
        assert sum(p["n_tokens"] for p in pieces) <= capacity
        at = 0
        for p in sorted(pieces, key=lambda p: (p["start"], p["n_tokens"])):
            assert p["start"] == at
            at += p["n_tokens"]
        for k in (0, 1):
            values = [about[p["doc_id"]][k] for p in pieces if about[p["doc_id"]][k] is not None]
            assert len(values) == len(set(values))


def test_pack(spark):
    r = random.Random(8)
    items = [(i, r.choice([None, 0, 1, 7, 30, 90, 100, 101, 350, r.randint(1, 120)]), r.choice(["a", "a", "b", "c", None]), r.choice(["x", "y", None, str(i)])) for i in range(400)]
    df = spark.createDataFrame(items, "doc_id long, n_tokens long, source string, cluster string").repartition(7)
    first = pack(df, 100, 64).collect()
    check(items, first, 100)
    assert sorted(first) == sorted(pack(df.repartition(2), 100, 64).collect())
    assert len({r["shard"] for r in first}) > 3


PATH = public_tokenizers.path("byte_bpe_50k.json")
LIBRARY = Tokenizer.from_file(PATH)


def ids_of(text):
    return [*LIBRARY.encode(text or "", add_special_tokens=False).ids, END_OF_TEXT]


def test_pack_documents(spark):
    items = documents_as_items(frame(spark), PATH, END_OF_TEXT)
    numbers = items.select("doc_id", "n_tokens", "source", "cluster")
    assert {r["doc_id"]: r["n_tokens"] for r in numbers.collect()} == {i: len(ids_of(t)) for i, t, *_ in rows()}
    check([tuple(r) for r in numbers.collect()], pack(items, 256, 50).collect(), 256)
    assert {r["doc_id"] for r in pack(items).collect()} == {i for i, *_ in rows()}
    assert pack(documents_as_items(empty(spark), PATH, END_OF_TEXT)).collect() == []


def test_sequences_hold_each_id_once_and_in_order(spark):
    data = rows() + [(7, "a row with an id that another text has", "en", "src1", 0), (None, None, None, None, None)]
    made = sequences(documents_as_items(frame(spark, data), PATH, END_OF_TEXT), 256, 50).collect()
    pieces = defaultdict(list)
    for r in made:
        assert r["n_tokens"] == len(r["ids"]) <= 256 and r["starts"] == sorted(r["starts"])
        for doc, piece, a, b in zip(r["doc_ids"], r["pieces"], r["starts"], [*r["starts"][1:], len(r["ids"])]):
            pieces[doc].append((piece, r["ids"][a:b]))
    want = defaultdict(list)
    for i, t, *_ in data:
        ids = ids_of(t)
        want[i] += [(k, ids[a : a + 256]) for k, a in enumerate(range(0, len(ids), 256))]
    assert {i: sorted(p) for i, p in pieces.items()} == {i: sorted(p) for i, p in want.items()}
    assert sequences(documents_as_items(empty(spark), PATH, END_OF_TEXT)).collect() == []


def test_groups_cost_few_bins(spark):
    """Packed in groups, a table takes at most a tenth more bins than in one; also where a source holds half the rows."""
    r = random.Random(12)
    items = [(i, r.choice([r.randint(1, 400), r.randint(1, 2500)]), "big" if half and i % 2 else f"s{r.randint(0, 40)}", str(i)) for half in (0, 1) for i in range(6000)]
    for part in (items[:6000], items[6000:]):
        df = spark.createDataFrame(part, "doc_id long, n_tokens long, source string, cluster string")
        bins = [pack(df, 2048, n).select("shard", "bin").distinct().count() for n in (512, 10_000)]
        assert bins[0] <= 1.1 * bins[1], bins


def test_query(spark):
    found = queries()["op5_best_fit_packing"](spark, "/root/testdata/sf0.001").collect()
    data = [(r["doc_id"], len(ids_of(r["text"])), r["source"], None) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    check(data, found, 2048)
