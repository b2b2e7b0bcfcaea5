"""Work that follows rows in order, cut into blocks, so that no symbol's rows all meet in one task.

A block is a month of a symbol, a range of so many bar lengths, or one of its rows' arrival numbers. What a block has to know of those before it (its
last row, its last value, its last few rows) is one small row per block; these go through a symbol in order, and each
block gets what it needs back.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

BLOCK = "_block"


def month(ts: str = "ts") -> Column:
    return F.trunc(ts, "month")


def span(length: int, ts: str = "ts", most: int = 16_384) -> Column:
    """A block of so many bar lengths, for bars on a grid of that length: at most so many rows. A month of daily bars holds a few rows only, fewer than are carried to it."""
    return F.floor(F.unix_micros(ts) / F.lit(length * most))


def arrival(rows: DataFrame, seq: str = "ingest_seq") -> Column:
    """A block of an order of arrival, never falling as the order rises.

    A struct's block is all but its last field (a landed file's split); times in microseconds go by 25 days, smaller
    numbers by a million.
    """
    kind = rows.schema[seq].dataType
    if isinstance(kind, StructType):
        return F.struct(*[F.col(f"{seq}.{f}") for f in kind.names[:-1]])
    n = F.col(seq).cast("long")
    return F.when(n < 1 << 48, F.shiftright(n, 20)).otherwise(F.shiftright(n, 41) + F.lit(1 << 40))


def with_before(rows: DataFrame, order: str, values: dict[str, Column], block: Column, keys: tuple[str, ...] = ("symbol",)) -> DataFrame:
    """rows with each value as it was in the row before, in order within keys; null in the first. Rows of equal order are taken in any order.

    Rows are shuffled once, by keys and block; of each block one row, its last, goes through its keys' blocks and comes
    back as the row before the next block's first.
    """
    on, now = [*keys, BLOCK], {f"_now_{n}": v for n, v in values.items()}
    here = rows.withColumns({BLOCK: block, **now})
    # One aggregate a value, as states of fixed size need no sort; all see the same rows in the same order.
    last = here.groupBy(*on).agg(*[F.max_by(n, order).alias(n) for n in now])
    across = Window.partitionBy(*keys).orderBy(BLOCK)
    carried = last.select(*on, *[F.lag(n).over(across).alias(n) for n in now])
    inside = Window.partitionBy(*on).orderBy("_real", order)
    out = _after(here, carried).withColumns({f"_before_{n}": F.lag(f"_now_{n}").over(inside) for n in values})
    return out.where("_real").withColumns({n: F.col(f"_before_{n}") for n in values}).drop(BLOCK, "_real", *now, *[f"_before_{n}" for n in values])


def _after(rows: DataFrame, carried: DataFrame) -> DataFrame:
    """rows (_real) and before each block's the row that is carried to it; no join, so keys may be null."""
    return rows.withColumn("_real", F.lit(True)).unionByName(carried.withColumn("_real", F.lit(False)), allowMissingColumns=True)


def filled(rows: DataFrame, order: str, value: str, into: str, block: Column, keys: tuple[str, ...] = ("symbol",)) -> DataFrame:
    """rows with the last value that was there, that of the row itself included; null before the first one."""
    on = [*keys, BLOCK]
    here = rows.withColumns({BLOCK: block, "_value": F.col(value)})
    last = here.groupBy(*on).agg(F.max_by("_value", F.when(F.col("_value").isNotNull(), F.col(order))).alias("_value"))
    before = Window.partitionBy(*keys).orderBy(BLOCK).rowsBetween(Window.unboundedPreceding, -1)
    carried = last.select(*on, F.last("_value", ignorenulls=True).over(before).alias("_value"))
    so_far = Window.partitionBy(*on).orderBy("_real", order).rowsBetween(Window.unboundedPreceding, 0)
    out = _after(here, carried).withColumn("_filled", F.last("_value", ignorenulls=True).over(so_far))
    return out.where("_real").withColumn(into, F.col("_filled")).drop(BLOCK, "_real", "_value", "_filled")


def with_halo(rows: DataFrame, order: str, value: str, n: int, block: Column, keys: tuple[str, ...] = ("symbol",)) -> DataFrame:
    """rows with _block, and before each block's rows copies of the n rows before it (order and value alone), marked _halo.

    Of each block its last n rows are carried, as one row; of those of the n blocks before, a block keeps n.
    """
    on = [*keys, BLOCK]
    here = rows.withColumn(BLOCK, block)
    place = F.row_number().over(Window.partitionBy(*on).orderBy(F.desc(order)))
    tail = here.withColumn("_place", place).where(F.col("_place") <= n)
    last = tail.groupBy(*on).agg(F.sort_array(F.collect_list(F.struct(order, value))).alias("_tail"))
    some = Window.partitionBy(*keys).orderBy(BLOCK).rowsBetween(-n, -1)
    carried = last.withColumn("_tail", F.flatten(F.collect_list("_tail").over(some)))
    carried = carried.withColumn("_tail", F.slice("_tail", F.greatest(F.size("_tail") - n + 1, F.lit(1)), n))
    halo = carried.select(*on, F.explode("_tail").alias("_t")).select(*on, F.col(f"_t.{order}").alias(order), F.col(f"_t.{value}").alias(value), F.lit(True).alias("_halo"))
    return here.withColumn("_halo", F.lit(False)).unionByName(halo, allowMissingColumns=True)


def islands(pieces: DataFrame, start: str, end: str, block: Column, keys: tuple[str, ...] = ("symbol",), slack: int = 1) -> DataFrame:
    """(keys, start, end) of runs of pieces that lie no more than slack microseconds apart; pieces don't overlap.

    Runs are found within blocks first. Only a block's first and last run can go on in another block, so at most two
    rows of each go through its keys' blocks.
    """
    apart = lambda order: F.coalesce(F.unix_micros(start) > F.unix_micros(F.lag(end).over(order)) + slack, F.lit(True)).cast("int")
    on = [*keys, BLOCK]
    inside = Window.partitionBy(*on).orderBy(start)
    runs = pieces.withColumn(BLOCK, block).withColumn("_new", apart(inside)).withColumn("_run", F.sum("_new").over(inside))
    runs = runs.groupBy(*on, "_run").agg(F.min(start).alias(start), F.max(end).alias(end))
    most = F.max("_run").over(Window.partitionBy(*on))
    runs = runs.withColumn("_edge", (F.col("_run") == 1) | (F.col("_run") == most))
    across = Window.partitionBy(*keys).orderBy(start)
    edges = runs.where("_edge").withColumn("_new", apart(across)).withColumn("_run", F.sum("_new").over(across))
    joined = edges.groupBy(*keys, "_run").agg(F.min(start).alias(start), F.max(end).alias(end))
    return joined.select(*keys, start, end).unionByName(runs.where("not _edge").select(*keys, start, end))
