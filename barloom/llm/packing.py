"""Best-fit packing of documents into training sequences, with conflicts.

A bin is one sequence of a fixed number of tokens. No bin holds two documents of one source or of one cluster of
duplicates: each bin carries a bitmap of both, and a document goes to the fullest bin that still has room and shares no
bit with it. Bins are kept in the order of what is left in them; the search starts at the first that has room and goes
on to the next until one is compatible. pack() places pieces of documents, sequences() puts their token ids together.
"""

from __future__ import annotations

from bisect import bisect_left, insort

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.llm.bpe import count, encode
from barloom.llm.common import cut
from barloom.llm.exact_dedup import normalised

#: Tokens in a sequence.
CAPACITY = 2048
#: Documents that are packed together, at most about; the number of such groups is a power of two that grows with the table.
SHARD_ROWS = 2048


def best_fit(sizes: list[int], sources: list[int], clusters: list[int], capacity: int) -> list[int]:
    """The bin of each piece; pieces come largest first. sources, clusters: the number of a piece's bit, -1 for none."""
    left: list[tuple[int, int]] = []  # (residual, bin), ascending
    marks: list[tuple[int, int]] = []  # per bin its bitmaps
    out = []
    for size, source, cluster in zip(sizes, sources, clusters):
        s = 1 << source if source >= 0 else 0
        c = 1 << cluster if cluster >= 0 else 0
        k = bisect_left(left, (size, -1))
        while k < len(left) and (marks[left[k][1]][0] & s or marks[left[k][1]][1] & c):
            k += 1
        if k < len(left):
            rest, b = left.pop(k)
            marks[b] = (marks[b][0] | s, marks[b][1] | c)
        else:
            rest, b = capacity, len(marks)
            marks.append((s, c))
        if rest > size:
            insort(left, (rest - size, b))
        out.append(b)
    return out


def _codes(values: pd.Series, several: bool) -> list[int]:
    """Small numbers for values, -1 for null and, if several, for those that come once."""
    codes = pd.Series(pd.factorize(values)[0], index=values.index)
    if several:
        n = codes[codes >= 0].value_counts()
        codes = codes.where(codes.map(n).fillna(0) > 1, -1)
        codes = pd.Series(pd.factorize(codes.where(codes >= 0))[0], index=values.index)
    return codes.tolist()


def pack(items: DataFrame, capacity: int = CAPACITY, shard_rows: int = SHARD_ROWS, key: str | None = None) -> DataFrame:
    """(doc_id, piece, n_tokens, shard, bin, start) for items (doc_id, n_tokens, source, cluster): where each piece of each document goes.

    Documents are dealt by a hash of their id and place into groups of about shard_rows, and each group is packed by
    itself, so a task holds a bounded number of rows (four numbers each) whatever the corpus and whatever its largest
    source or cluster. Groups split in two when the table doubles, so a few more rows leave the others where they are. A
    document longer than a bin is cut into whole bins and a remainder; whole bins are closed. A null source or cluster
    is in conflict with nothing. Null or zero lengths take a bin without filling it. Rows that repeat an id are packed
    as documents of their own. Within a bin pieces lie end to end from `start`. An empty table gives an empty one.
    Larger pieces are packed first, ties by doc_id, so the result doesn't depend on partitions. key: a column of items,
    a number, that goes along under its name.
    """
    also = [F.col(key).cast("long").alias("key")] if key else [F.lit(0).cast("long").alias("key")]
    rows = cut(items.select(F.col("doc_id").cast("long"), F.greatest(F.coalesce(F.col("n_tokens").cast("long"), F.lit(0)), F.lit(0)).alias("n_tokens"), F.col("source").cast("string"), F.col("cluster").cast("string"), *also))
    shards = 1 << max(0, -(-rows.count() // shard_rows) - 1).bit_length()

    def one(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["n_tokens", "doc_id", "source", "cluster", "key"], ascending=[False, True, True, True, True], kind="stable").reset_index(drop=True)
        whole = group["n_tokens"] // capacity
        rest = group["n_tokens"] - whole * capacity
        # Whole bins first, in bins of their own; then the remainders and short documents.
        full = group.loc[group.index.repeat(whole)]
        full = full.assign(piece=full.groupby(level=0).cumcount(), n=capacity)
        tail = group.assign(piece=whole, n=rest)[(rest > 0) | (whole == 0)].sort_values("n", ascending=False, kind="stable")
        bins = best_fit(tail["n"].tolist(), _codes(tail["source"], False), _codes(tail["cluster"], True), capacity)
        tail = tail.assign(bin=bins)
        full = full.assign(bin=range(1 + max(bins, default=-1), 1 + max(bins, default=-1) + len(full)))
        out = pd.concat([tail, full])
        out["start"] = out.groupby("bin")["n"].cumsum() - out["n"]
        return out[["doc_id", "piece", "n", "shard", "bin", "start", "key"]]

    dealt = rows.withColumn("shard", F.pmod(F.xxhash64("doc_id", "n_tokens", "source", "cluster"), F.lit(shards)))
    placed = dealt.groupBy("shard").applyInPandas(one, "doc_id long, piece long, n long, shard long, bin long, start long, key long").withColumnRenamed("n", "n_tokens")
    return placed.withColumnRenamed("key", key) if key else placed.drop("key")


def documents_as_items(docs: DataFrame, tokenizer: str, end_id: int) -> DataFrame:
    """(doc_id, ids, n_tokens, source, cluster) of documents: token ids by the byte-level BPE and an end mark; texts that are equal but for white space are one cluster.

    Null and empty texts are the end mark alone and one cluster. Every row gives a row; other columns are ignored.
    """
    tokens = encode(_clustered(docs), tokenizer).withColumn("ids", F.array_append("ids", F.lit(end_id)))
    return tokens.select("doc_id", "ids", F.size("ids").cast("long").alias("n_tokens"), "source", "cluster")


def documents_as_lengths(docs: DataFrame, tokenizer: str) -> DataFrame:
    """documents_as_items() without the ids, for places alone: (doc_id, n_tokens, source, cluster), the end mark counted."""
    return count(_clustered(docs), tokenizer).select("doc_id", (F.col("n_tokens") + 1).alias("n_tokens"), "source", "cluster")


def _clustered(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", "source", F.md5(normalised(F.col("text").cast("string"))).alias("cluster"), "text")


def sequences(items: DataFrame, capacity: int = CAPACITY, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """(shard, bin, n_tokens, doc_ids, pieces, starts, ids): a row per sequence, for items as of documents_as_items.

    ids are those of the sequence's pieces end to end; doc_ids, pieces and starts say which they are and where each
    begins. Each id of each item comes once; an empty table gives an empty one. Places are found from numbers alone;
    then ids meet them by a number that each row gets once it is written, and a sequence never holds more than capacity ids.
    """
    numbered = cut(items.select(F.monotonically_increasing_id().alias("number"), "doc_id", "ids", "n_tokens", "source", "cluster"))
    places = pack(numbered.select("number", "doc_id", "n_tokens", "source", "cluster"), capacity, shard_rows, "number")
    met = places.join(numbered.select("number", "ids"), "number")
    mine = F.slice("ids", (F.col("piece") * capacity + 1).cast("int"), F.greatest("n_tokens", F.lit(1)).cast("int"))
    each = met.select("shard", "bin", F.struct("start", "doc_id", "piece", F.when(F.col("n_tokens") > 0, mine).otherwise(F.array().cast("array<int>")).alias("ids")).alias("p"), "n_tokens")
    out = each.groupBy("shard", "bin").agg(F.sum("n_tokens").alias("n_tokens"), F.array_sort(F.collect_list("p")).alias("p"))
    return out.select("shard", "bin", "n_tokens", F.col("p.doc_id").alias("doc_ids"), F.col("p.piece").alias("pieces"), F.col("p.start").alias("starts"), F.flatten("p.ids").alias("ids"))
