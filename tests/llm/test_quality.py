"""The quality classifier: statistics by hand, held-out accuracy, edge cases."""

import zlib

import numpy as np
import pyarrow as pa

from barloom.llm.common import table, utf8
from barloom.llm.quality import STATISTICS, Ensemble, Rule, fit, keep_good, learn, score_quality, statistics
from tests.llm.cases import empty, frame, rows

SF = "/root/testdata/sf0.01"


def test_statistics():
    x = statistics(*utf8(pa.array(["Ab ab!! |1.\nÉ", None, ""])))
    got = dict(zip(STATISTICS, x[0]))
    assert got["words"] == 4 and got["upper"] == 2 / 13 and got["digits"] == 1 / 13 and got["signs"] == 3 / 13
    assert got["bars"] == 1 / 13 and got["shouts"] == 2 / 13 and got["stops"] == 1 / 13 and got["line_words"] == 2 and got["distinct"] == 1
    assert (x[1] == x[2]).all() and x[1][STATISTICS.index("distinct")] == 1 and x[1].sum() == 1


def test_sql_and_numpy_scores_agree(spark):
    model = Ensemble(0.3, [Rule((("words", True, 3.0), ("upper", False, 0.5)), -1.2), Rule((("again", True, 0.1),), 2.0)])
    out = {r["doc_id"]: r["score"] for r in score_quality(frame(spark).drop("score"), model).collect()}
    x = statistics(*utf8(pa.array([t for _, t, *_ in rows()])))
    z = 0.3 + sum(r.weight * r.holds(list(STATISTICS), x) for r in model.rules)
    assert np.allclose([out[i] for i, *_ in rows()], 1 / (1 + np.exp(-z)))


def test_held_out_accuracy(spark):
    docs, labels = table(spark, SF, "documents"), table(spark, SF, "labels")
    known = {r["doc_id"]: r["quality"] for r in labels.collect()}
    got = score_quality(docs, learn(docs, labels)).select("doc_id", "score").collect()
    held = [(r["score"] >= 0.3, known[r["doc_id"]]) for r in got if r["doc_id"] in known and zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0]
    assert len(held) > 50 and np.mean([a == b for a, b in held]) > 0.95


def test_edges(spark):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert learn(empty(spark), labels) == Ensemble(0.0, [])
    kept = keep_good(frame(spark), labels)
    assert kept.columns == frame(spark).columns and kept.count() == len(rows())
    assert keep_good(empty(spark), labels).collect() == []
    assert fit(list(STATISTICS), np.zeros((5, len(STATISTICS))), np.ones(5)).score is not None
