"""The toxicity network: scoring against a plain convolution, held-out accuracy, edge cases."""

import random
import zlib

import numpy as np
import pyarrow as pa

from barloom.llm.common import table, utf8
from barloom.llm import toxicity
from barloom.llm.toxicity import END, FILTERS, HEADS, WIDTHS, Network, Weights, beginning, calibrate, counts, hashed, labelled, learn, padded, score_toxicity, train, word_rows
from barloom.llm.queries import op4_toxicity_cnn
from tests.llm.cases import empty, frame, rows

SF = "/root/testdata/sf0.01"


def random_network():
    r = np.random.default_rng(1)
    n = len(WIDTHS) * FILTERS
    return Network(r.normal(size=(END + 1, sum(WIDTHS) * FILTERS)).astype(np.float32), r.normal(size=n).astype(np.float32), r.normal(size=n).astype(np.float32), 0.1)


def slow_score(net, words):
    pooled, slot = [], 0
    seq = [*words, *([[END] * (1 + len(HEADS))] * (max(WIDTHS) - 1 + (not len(words))))]
    for w in WIDTHS:
        best = [max(sum(float(net.table[row, slot + k * FILTERS + f]) for k in range(w) for row in seq[i + k]) for i in range(max(len(words), 1))) for f in range(FILTERS)]
        slot += w * FILTERS
        pooled += best
    z = np.maximum(np.array(pooled) + net.bias, 0) @ net.weights + net.offset
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def test_scores():
    net = random_network()
    texts = [None, "", "a", "a b", "Some words, here. and HERE!", "x " * 30 + "longer words beside", "--"]
    got, at = word_rows(*utf8(pa.array(texts)))
    assert np.diff(at).tolist() == [0, 0, 1, 2, 5, 33, 0]
    assert (got[at[4] + 2] == got[at[4] + 4]).all()  # case and signs don't matter
    assert np.allclose(net.scores(got, at), [slow_score(net, got[a:b]) for a, b in zip(at, at[1:])], atol=1e-4)


def test_learns_words_and_beginnings():
    r = random.Random(3)
    plain = ["".join(r.choice("abcdefgh") for _ in range(r.randint(2, 7))) for _ in range(300)]
    data = []
    for i in range(700):
        words = [r.choice(plain) for _ in range(r.randint(3, 60))]
        bad = i % 4 == 0
        if bad:
            words[r.randrange(len(words))] = r.choice(["nasty", "zzqqzzqq" + r.choice(plain)])
        data.append((" ".join(words), int(bad)))
    texts = [word_rows(*utf8(pa.array([t])))[0] for t, _ in data]
    y = np.array([b for _, b in data], np.float32)
    net = train(texts[:500], y[:500])
    got = np.array([net.scores(t, np.array([0, len(t)]))[0] for t in texts[500:]])
    assert ((got >= 0.5) == y[500:]).mean() > 0.95


def test_calibrate():
    scores, y = np.array([0.9, 0.8, 0.3, 0.2] * 20), np.array([1, 1, 0, 0] * 20)
    lang = np.array(["en", "en", "en", "en"] * 10 + ["de", None, "de", None] * 10, object)
    got = calibrate(scores, y, lang)
    assert 0.3 < got[None] <= 0.8 and 0.3 < got["en"] <= 0.8
    assert calibrate(np.empty(0), np.empty(0), np.empty(0, object)) == {None: 0.7}


def test_held_out_accuracy(spark):
    docs, labels = table(spark, SF, "documents"), table(spark, SF, "labels")
    known = {r["doc_id"]: r["toxic"] for r in labels.collect()}
    got = score_toxicity(docs, *learn(docs, labels)).select("doc_id", "score").collect()
    held = [(r["score"] >= 0.7, known[r["doc_id"]]) for r in got if r["doc_id"] in known and zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1]
    assert len(held) > 80 and np.mean([a == b for a, b in held]) > 0.85
    assert not sum(a and not b for a, b in held) > 3


def test_held_out_recall_by_language(spark):
    """At the contract's 0.7, over the larger table: recall of at least 0.9 in all, 0.8 in each language, at a precision of 0.9."""
    docs, labels = table(spark, "/root/testdata/sf0.1", "documents"), table(spark, "/root/testdata/sf0.1", "labels")
    known = {r["doc_id"]: r["toxic"] for r in labels.collect()}
    got = score_toxicity(docs, *learn(docs, labels)).join(labels.select("doc_id"), "doc_id").select("doc_id", "lang", "score").collect()
    held = [(r["lang"], r["score"] >= 0.7, known[r["doc_id"]] == 1) for r in got if zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1]
    hits = [(lang, said) for lang, said, is_ in held if is_]
    assert np.mean([said for _, said in hits]) >= 0.9
    for lang in {lang for lang, _ in hits}:
        assert np.mean([said for x, said in hits if x == lang]) >= 0.8, lang
    assert np.mean([is_ for _, said, is_ in held if said]) >= 0.9


def test_words_that_come_to_the_driver_are_bounded(spark):
    docs = spark.createDataFrame([(i, "word " * (5 + 40 * (i % 7)), "en") for i in range(200)], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i, 0, i % 2) for i in range(200)], "doc_id long, quality int, toxic int")
    whole, few = (learn(docs, labels, train_bytes=n)[0] for n in (1 << 20, 6_000))
    assert not np.array_equal(whole.table, few.table)
    assert learn(docs, labels, train_bytes=0)[1] == {None: 0.7}


def test_query(spark, tmp_path):
    """Scores of the whole query against the plain convolution with the same network, text by text."""
    docs, labels = table(spark, SF, "documents").limit(250), table(spark, SF, "labels")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    net, least = learn(docs, labels)
    texts = {r["doc_id"]: (r["text"], r["lang"]) for r in docs.collect()}
    got = op4_toxicity_cnn(spark, str(tmp_path)).collect()
    assert len(got) == len(texts)
    for r in got[::10]:
        words, at = word_rows(*utf8(pa.array([texts[r["doc_id"]][0]])))
        assert abs(slow_score(net, words) - r["score"]) < 1e-4
    for r in got:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) and r["predicted"] == int(r["score"] >= 0.7)
        assert r["flagged"] == (r["score"] >= least.get(texts[r["doc_id"]][1], least[None]))


def test_edges(spark):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    net, least = learn(empty(spark), labels)
    out = score_toxicity(frame(spark), net, least)
    assert out.count() == len(rows()) and {r["score"] for r in out.collect()} == {0.5}
    assert score_toxicity(empty(spark), random_network(), {None: 0.5, "en": 0.2}).collect() == []


def test_every_labelled_row_counts(spark):
    """More labelled rows than the 10,000 that were learnt from once; the toxic ones are those of the largest hashes of doc_id, so that no such sample held one."""
    ids = [i for i in range(22_000) if zlib.crc32(str(i).encode()) % 3 != 1]
    order = [r[0] for r in spark.createDataFrame([(i,) for i in ids], "i long").selectExpr("i", "xxhash64(i) AS h").orderBy("h").collect()]
    bad = set(order[-2_000:])
    assert len(order) > 12_500
    docs = spark.createDataFrame([(i, f"plain words {i % 7} " + ("nasty" if i in bad else "kind"), "xx" if i in bad else "en") for i in ids], "doc_id long, text string, lang string").repartition(3)
    labels = spark.createDataFrame([(i, 0, int(i in bad)) for i in ids], "doc_id long, quality int, toxic int")
    net, least = learn(docs, labels)
    nasty, kind = (net.scores(*word_rows(*utf8(pa.array([f"plain words 3 {w}"]))))[0] for w in ("nasty", "kind"))
    assert kind < 0.7 <= nasty
    assert "xx" in least  # a language of later rows has a threshold of its own


def test_labelled_rows_are_whole(spark):
    """All rows with a label, once, with their greatest text; the map of ids only spares rows without."""
    docs = spark.createDataFrame([(i % 900, f"text {i}" if i % 11 else None, None if i % 5 else "en") for i in range(1_000)] + [(None, "x", "en")], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i, 0, None if i % 10 == 3 else i % 2) for i in range(400, 1_200)] + [(450, 0, 1), (None, 0, 1)], "doc_id long, quality int, toxic int")
    texts, label = {}, {}
    for r in docs.collect():
        texts.setdefault(r["doc_id"], []).append((r["text"] is not None, r["text"] or "", r["lang"] is not None, r["lang"] or ""))
    for r in labels.collect():
        if r["doc_id"] is not None and r["toxic"] is not None:
            label[r["doc_id"]] = max(r["toxic"], label.get(r["doc_id"], 0))
    want = {i: (max(texts[i])[1] if max(texts[i])[0] else None, y) for i, y in label.items() if i in texts and zlib.crc32(str(i).encode()) % 3 != 1}
    got = labelled(docs, labels).collect()
    assert len(got) == len(want) and {r["doc_id"]: (r["text"], r["label"]) for r in got} == want


def test_tasks_that_learn_go_by_rows(spark):
    """However many partitions a shuffle makes, each task hands on networks, so there must be few."""
    rows = spark.createDataFrame([(i, "en", 0, "a b c") for i in range(300)], "doc_id long, lang string, label int, text string").repartition(40)
    data = hashed(rows)
    assert data.rdd.getNumPartitions() == 1 and data.count() == 300


def test_tasks_share_their_moves(spark, monkeypatch):
    """Networks learnt by several tasks tell labels apart as one task's do, and are the same from run to run."""
    monkeypatch.setattr(toxicity, "TASK_ROWS", 150)
    monkeypatch.setattr(toxicity, "PART_ROWS", 50)
    r = random.Random(4)
    plain = ["".join(r.choice("abcdefgh") for _ in range(r.randint(2, 7))) for _ in range(300)]
    data = [(i, " ".join([*(r.choice(plain) for _ in range(r.randint(3, 40))), *(["nasty"] if i % 4 == 0 else [])]), "en") for i in range(1_500)]
    docs, labels = spark.createDataFrame(data, "doc_id long, text string, lang string").repartition(3), spark.createDataFrame([(i, 0, int(i % 4 == 0)) for i in range(1_500)], "doc_id long, quality int, toxic int")
    assert hashed(labelled(docs, labels)).rdd.getNumPartitions() > 1
    (net, least), (again, _) = learn(docs, labels), learn(docs, labels)
    assert np.array_equal(net.table, again.table) and abs(least[None] - 0.7) < 0.01
    got = net.scores(*word_rows(*utf8(pa.array([t for _, t, _ in data]))))
    assert ((got >= 0.7) == (np.arange(1_500) % 4 == 0)).mean() > 0.97


def test_windows_of_long_texts(monkeypatch):
    """Greatest answers and their places don't depend on how many places are looked at together."""
    r = np.random.default_rng(2)
    texts = [r.integers(0, END, (n, 1 + len(HEADS))).astype(np.uint16) for n in (0, 1, 50, 3, 7)]
    y = np.array([0, 1, 0, 1, 0], np.float32)
    w = beginning(*counts(texts, y), 5, 2)
    lengths = np.array([len(t) for t in texts])
    seq, starts = padded(np.concatenate(texts), np.concatenate([[0], np.cumsum(lengths)]))
    whole = Weights.pool(w, seq, starts, np.maximum(lengths, 1))
    monkeypatch.setattr(toxicity, "WINDOW", 6)
    parts = Weights.pool(w, seq, starts, np.maximum(lengths, 1))
    assert np.allclose(whole[0], parts[0], atol=1e-5) and np.isfinite(whole[0]).all()
    assert (whole[1] == parts[1]).mean() > 0.95  # equal but for rounding
