"""Scans in blocks against a plain walk over all rows of a key in order."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from barloom.operators import blocks, validate

T0 = datetime(2024, 1, 30)
ROWS = "symbol string, ts timestamp, n bigint, x double"


def rows(seed=3):
    """Symbols of many blocks, of one, one that holds half of all rows, and one without a name; x is missing for whole blocks."""
    r, out = random.Random(seed), []
    for symbol, n in (("A", 40), ("B", 1), (None, 25), ("HOT", 70)):
        at = T0
        for k in range(n):
            at += timedelta(hours=r.choice([1, 30, 200]), days=45 if k % 17 == 16 else 0)
            out.append((symbol, at, k, None if r.random() < 0.4 or 20 < k < 34 else r.random()))
    r.shuffle(out)
    return out


def by_symbol(data):
    found = {}
    for row in sorted(data, key=lambda r: r[1]):
        found.setdefault(row[0], []).append(row)
    return found


def test_with_before(spark):
    data = rows()
    out = blocks.with_before(spark.createDataFrame(data, ROWS).repartition(5), "ts", {"was": F.col("ts"), "x_was": F.col("x")}, blocks.month())
    want = {(s, r[1]): (p[1], p[3]) if p else (None, None) for s, mine in by_symbol(data).items() for r, p in zip(mine, [None, *mine])}
    assert out.columns == ["symbol", "ts", "n", "x", "was", "x_was"]
    assert {(r["symbol"], r["ts"]): (r["was"], r["x_was"]) for r in out.collect()} == want and out.count() == len(data)


def test_with_before_needs_no_join(spark):
    plan = blocks.with_before(spark.createDataFrame(rows(), ROWS), "ts", {"was": F.col("ts")}, blocks.month())._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "SortAggregate" not in plan


def test_a_value_in_place_of_a_column(spark):
    data = [("A", T0 + timedelta(days=20 * k), k, float(k)) for k in range(9)]
    out = blocks.with_before(spark.createDataFrame(data, ROWS), "ts", {"x": F.col("x") * 2}, blocks.month())
    assert [r["x"] for r in out.orderBy("ts").collect()] == [None, *[2.0 * k for k in range(8)]]


def test_filled(spark):
    data = rows()
    for into in ("y", "x"):
        out = blocks.filled(spark.createDataFrame(data, ROWS).repartition(5), "ts", "x", into, blocks.month()).collect()
        want = {}
        for s, mine in by_symbol(data).items():
            last = None
            for r in mine:
                last = r[3] if r[3] is not None else last
                want[s, r[1]] = last
        assert {(r["symbol"], r["ts"]): r[into] for r in out} == want and len(out) == len(data)


@pytest.mark.parametrize("n", [1, 5, 49])
def test_with_halo(spark, n):
    data = rows()
    out = blocks.with_halo(spark.createDataFrame(data, ROWS).where("symbol is not null"), "ts", "x", n, blocks.month()).collect()
    got = {}
    for r in out:
        if r["_halo"]:
            got.setdefault((r["symbol"], r["_block"]), []).append(r["ts"])
    for symbol, mine in by_symbol([r for r in data if r[0]]).items():
        times = [r[1] for r in mine]
        for block in {t.date().replace(day=1) for t in times}:
            before = [t for t in times if t.date() < block]
            assert sorted(got.get((symbol, block), [])) == before[-n:]


def test_islands(spark):
    r, pieces = random.Random(8), []
    for symbol in ("A", "B", "HOT"):
        at = T0
        for _ in range(60 if symbol == "HOT" else 15):
            at += timedelta(days=r.choice([0, 0, 0, 9]))
            pieces.append((symbol, at, at + timedelta(days=3)))
            at += timedelta(days=3)
    want = []
    for symbol, start, end in pieces:
        if want and want[-1][0] == symbol and want[-1][2] == start:
            want[-1] = (symbol, want[-1][1], end)
        else:
            want.append((symbol, start, end))
    out = blocks.islands(spark.createDataFrame(pieces, "symbol string, a timestamp, b timestamp").repartition(4), "a", "b", blocks.month("a"))
    assert sorted((r["symbol"], r["a"], r["b"]) for r in out.collect()) == sorted(want)


def test_empty(spark):
    none = spark.createDataFrame([], ROWS)
    assert blocks.with_before(none, "ts", {"was": F.col("ts")}, blocks.month()).count() == blocks.filled(none, "ts", "x", "y", blocks.month()).count() == blocks.with_halo(none, "ts", "x", 3, blocks.month()).count() == 0


@pytest.mark.parametrize("landed", [False, True])
def test_marked(spark, landed):
    """Duplicates, steps back and short steps of an order of arrival over several blocks; a landed file's order is a struct."""
    r, data = random.Random(4), []
    for symbol in ("A", "B"):
        at = T0
        for k in range(120):
            at += timedelta(minutes=r.choice([-60, 0, 30, 60, 60, 60]))
            data.append((symbol, at, k << 18, 1.0))
    order = F.struct(F.shiftright("n", 21).alias("file"), F.col("n").alias("row")) if landed else F.col("n")
    out = validate.marked(spark.createDataFrame(data, ROWS).withColumn("ingest_seq", order).repartition(6), 3_600_000_000)
    seen, was, want = set(), {}, {}
    for symbol, at, n, _ in data:
        gap = at - was[symbol] if symbol in was else None
        want[symbol, n] = ((symbol, at) in seen, gap is not None and gap < timedelta(0), gap is not None and gap < timedelta(hours=1))
        seen.add((symbol, at))
        was[symbol] = at
    assert {(r["symbol"], r["n"]): (r["duplicate"], r["backward"], r["short"]) for r in out.collect()} == want


def test_marked_in_time(spark):
    """Where bars arrive by time, both ways to find duplicates agree."""
    r = random.Random(6)
    data = [("A", T0 + timedelta(days=r.randint(0, 90)), k, 1.0) for k in range(120)]
    bars = spark.createDataFrame(data, ROWS).withColumn("ingest_seq", F.unix_micros("ts"))
    counts = [validate.marked(bars, 1, in_time).groupBy("ts").agg(F.count_if("duplicate").alias("n")) for in_time in (False, True)]
    assert sorted(map(tuple, counts[0].collect())) == sorted(map(tuple, counts[1].collect()))
    assert sum(r["n"] for r in counts[1].collect()) == 120 - len({d[1] for d in data})
