"""Ranked lexical search over hashed max-sketches.

The index holds a row per document: its terms with their counts, and a sketch, in which each term is folded into one of
some coordinates by its hash and a coordinate keeps the largest count. A term's impact grows with its count, so impacts
of a sketch's counts are the coordinatewise maxima of the impacts of all terms, and no term scores more than its
coordinate says. Queries go to the index in blocks; each task works out bounds for all queries of a block and many
documents at once, scores documents exactly by descending bound, and stops where no bound reaches its best ones.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from barloom.llm.common import cut, slices, utf8
from barloom.llm.textscan import TERM_BYTES, words

#: Coordinates of a sketch for each distinct term, and at least and at most.
SPREAD, NARROW, WIDE = 8, 64, 1 << 20
#: A coordinate's largest count; it stands for itself and all above.
MOST = 255
#: Queries in a block, about.
BLOCK = 1_000
#: Bytes of text, and cells of the table of bounds, worked on at once.
PART_BYTES, CELLS = 4 << 20, 4 << 20
#: Documents scored at once for a query.
STEP = 64

INDEX = "doc_id long, n_terms long, sketch binary, terms binary, counts binary"


def _terms(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Per text the sorted hashes of its distinct terms and their counts."""
    raw, ends = utf8(column)
    w, _, _, at = words(raw, ends, TERM_BYTES)
    for a, b in zip(at[:-1].tolist(), at[1:].tolist()):
        yield np.unique(w[a:b], return_counts=True)


def sketch(terms: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The largest count of each coordinate; there is a power of two of them, so a hash's last bits are its coordinate."""
    width = min(WIDE, max(NARROW, 1 << int(SPREAD * max(1, len(terms)) - 1).bit_length()))
    out = np.zeros(width, np.uint8)
    np.maximum.at(out, (terms & np.uint64(width - 1)).astype(np.int64), np.minimum(counts, MOST).astype(np.uint8))
    return out


def build_index(docs: DataFrame, path: str) -> None:
    """Write the index of all rows of docs (doc_id, text). Rows that repeat are documents of their own; a null text holds no term."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", PART_BYTES):
                n, parts = [], ([], [], [])
                for terms, counts in _terms(part.column(1)):
                    n.append(int(counts.sum()))
                    for out, value in zip(parts, (sketch(terms, counts), terms, counts.astype(np.uint32))):
                        out.append(value.tobytes())
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(n, pa.int64()), *(pa.array(p, pa.binary()) for p in parts)], ["doc_id", "n_terms", "sketch", "terms", "counts"])

    docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, INDEX).write.option("compression", "zstd").parquet(path)


def _joined(column: pa.Array, kind: type) -> tuple[np.ndarray, np.ndarray]:
    """The numbers of a binary column, end to end, and where each row's begin."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    data, ends = utf8(column.cast(pa.large_binary()).view(pa.large_string()))
    size = np.dtype(kind).itemsize
    return (np.frombuffer(data.tobytes(), kind) if len(data) else np.empty(0, kind)), ends // size


class _Queries:
    """A block of queries: their distinct terms, and for each query its terms and weights."""

    def __init__(self, keys: list, terms: list[np.ndarray]) -> None:
        self.keys = keys
        self.terms = np.unique(np.concatenate(terms)) if terms else np.empty(0, np.uint64)
        self.own = [np.searchsorted(self.terms, t) for t in terms]

    def weigh(self, documents: int, tokens: int, df: np.ndarray) -> None:
        self.documents, self.tokens = documents, tokens
        self.weight = np.floor(1000 * np.log((2 * documents + 2) / (2 * df + 1))).astype(np.int64)


def document_counts(index: DataFrame, queries: _Queries) -> np.ndarray:
    """How many documents hold each term of a block; a number for each term comes to the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(queries.terms), np.int64)
        for batch in batches:
            terms, _ = _joined(batch.column(0), np.uint64)
            at = np.minimum(np.searchsorted(queries.terms, terms), len(total) - 1)
            total += np.bincount(at[queries.terms[at] == terms], minlength=len(total))
        yield pa.RecordBatch.from_arrays([pa.array(np.flatnonzero(total)), pa.array(total[total > 0])], ["term", "n"])

    df = np.zeros(len(queries.terms), np.int64)
    for r in index.select("terms").mapInArrow(run, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).toLocalIterator():
        df[r["term"]] = r["n"]
    return df


def _impact(tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    return (1_000_000_000 * tf) // (1000 * tf + 20 * m)


def _ranked(index: DataFrame, queries: _Queries, top: int) -> DataFrame:
    """(query, doc_id, score): each task's best documents of each query."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = [np.empty((0, 3), np.int64) for _ in queries.keys]  # score, whether there is a doc_id, doc_id
        floor = np.ones(len(queries.keys), np.int64)
        for batch in batches:
            sketches, at = _joined(batch.column(2), np.uint8)
            terms, begin = _joined(batch.column(3), np.uint64)
            counts, _ = _joined(batch.column(4), np.uint32)
            n = batch.column(1).to_numpy()
            m = 50 + (50 * n * queries.documents) // queries.tokens
            ids, known = batch.column(0).fill_null(0).to_numpy(), batch.column(0).is_valid().to_numpy(zero_copy_only=False)
            step = max(1, CELLS // max(1, len(queries.terms)))
            for low in range(0, len(n), step):
                docs = np.arange(low, min(len(n), low + step))
                width = (at[docs + 1] - at[docs]).astype(np.uint64)
                cells = sketches[(queries.terms[:, None] & (width - np.uint64(1))).astype(np.int64) + at[docs]]
                # Largest impact of each term in each document; rounding is kept above the true value.
                tf = cells.astype(np.float32)
                bounds = np.where(cells == MOST, np.float32(1e6), tf * np.float32(1e6) / (tf + (m[docs] / 50).astype(np.float32)))
                for q, own in enumerate(queries.own):
                    if not len(own):
                        continue
                    most = (queries.weight[own].astype(np.float32) @ bounds[own]) * np.float32(1.00002) + 1
                    order = np.flatnonzero(most >= floor[q])
                    order = order[np.argsort(-most[order], kind="stable")]
                    for first in range(0, len(order), STEP):
                        some = order[first : first + STEP]
                        some = some[most[some] >= floor[q]]
                        if not len(some):
                            break
                        score = np.zeros(len(some), np.int64)
                        for i, d in enumerate(docs[some].tolist()):
                            mine = terms[begin[d] : begin[d + 1]]
                            place = np.searchsorted(mine, queries.terms[own])
                            place[place == len(mine)] = 0
                            there = mine[place] == queries.terms[own] if len(mine) else np.zeros(len(own), bool)
                            score[i] = (queries.weight[own][there] * _impact(counts[begin[d] : begin[d + 1]][place[there]].astype(np.int64), m[d])).sum()
                        new = np.stack([score, known[docs[some]], ids[docs[some]]], axis=1)[score > 0]
                        both = np.concatenate([best[q], new])
                        both = both[np.lexsort((both[:, 2], -both[:, 1], -both[:, 0]))][:top]
                        best[q] = both
                        if len(both) == top:
                            floor[q] = max(1, both[-1, 0])
        rows = np.concatenate([np.column_stack([np.full(len(b), q), b]) for q, b in enumerate(best)]) if best else np.empty((0, 4), np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(rows[:, 0]), pa.array(rows[:, 3], mask=rows[:, 2] == 0), pa.array(rows[:, 1])], ["query", "doc_id", "score"])

    return index.mapInArrow(run, "query long, doc_id long, score long")


def _item_terms(items: DataFrame) -> DataFrame:
    """(item_id, terms) per row of items."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", PART_BYTES):
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([t.tobytes() for t, _ in _terms(part.column(1))], pa.binary())], ["item_id", "terms"])

    kind = dict(items.dtypes)["item_id"]
    return items.select("item_id", F.col("text").cast("string").alias("text")).mapInArrow(run, f"item_id {kind}, terms binary")


def search(spark: SparkSession, path: str, items: DataFrame, top: int = 50) -> DataFrame:
    """(item_id, rank, doc_id, score): the top documents of each row of items (item_id, text) with a score above 0, from the index at path.

    Equal scores go by ascending doc_id, rows without one last. Rows of one item_id are one item with the terms of all;
    an item without terms, or whose terms no document holds, has no row, and so it is for an empty index.

    Items are dealt into blocks of about BLOCK by a hash of item_id; a block's terms come to the driver and go to every
    task. Whatever the block, all rows of the index are bounded. A task hands on `top` rows for each query at most;
    they are ranked in two steps, so that no task gets those of all tasks for one item.
    """
    index = spark.read.schema(INDEX).parquet(path)
    size = index.agg(F.count_if(F.col("n_terms") > 0).alias("documents"), F.coalesce(F.sum("n_terms"), F.lit(0)).alias("tokens")).first()
    asked = cut(_item_terms(items))
    blocks = max(1, -(-asked.count() // BLOCK))
    out = None
    for block in range(blocks) if size["tokens"] else ():
        mine: dict = {}
        for r in asked.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == block).toLocalIterator():
            mine.setdefault(r["item_id"], []).append(np.frombuffer(bytes(r["terms"]), np.uint64))
        queries = _Queries(list(mine), [np.unique(np.concatenate(t)) for t in mine.values()])
        if not len(queries.terms):
            continue
        queries.weigh(size["documents"], size["tokens"], document_counts(index, queries))
        found = _ranked(index, queries, top).withColumn("task", F.spark_partition_id())
        best = [F.desc("score"), F.asc_nulls_last("doc_id")]
        some = found.withColumn("task", F.col("task") % 32).withColumn("n", F.row_number().over(Window.partitionBy("query", "task").orderBy(*best))).where(F.col("n") <= top)
        whole = some.withColumn("rank", F.row_number().over(Window.partitionBy("query").orderBy(*best))).where(F.col("rank") <= top)
        names = spark.createDataFrame(list(enumerate(queries.keys)), f"query long, item_id {dict(items.dtypes)['item_id']}")
        part = cut(whole.join(F.broadcast(names), "query").select("item_id", "rank", "doc_id", "score"))  # a block's items
        out = part if out is None else out.unionByName(part)
    return out if out is not None else asked.select("item_id", F.lit(0).alias("rank"), F.lit(0).cast("long").alias("doc_id"), F.lit(0).cast("long").alias("score")).limit(0)
