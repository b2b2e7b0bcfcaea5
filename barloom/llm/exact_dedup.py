"""Exact duplicates: texts that are the same but for white space, found by a 128-bit content hash and compared byte by byte."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barloom.llm.common import SPACE_CHARS, fresh


def normalised(text: Column) -> Column:
    """Without SPACE_CHARS; null counts as empty."""
    return F.translate(F.coalesce(text, F.lit("")), SPACE_CHARS, "")


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, n, body, hash) per row: code points of the original text, the normalised text and its 128-bit hash."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    keyed = rows.select("doc_id", F.char_length(F.coalesce("text", F.lit(""))).cast("long").alias("n"), normalised(F.col("text")).alias("body"))
    return keyed.withColumn("hash", F.md5("body"))


def _groups(keyed: DataFrame) -> DataFrame:
    """(hash, digest, bytes, keep, n, group_size) per group of equal texts: id and code points of the row that stays."""
    # Smallest id of each length first: plain minima and counts are kept in place by the hash aggregate, records are not.
    equal = keyed.groupBy("hash", "body", "n").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("rows"))
    equal = equal.select("hash", F.sha2("body", 256).alias("digest"), F.octet_length("body").alias("bytes"), "n", "doc_id", "rows")
    best = F.min(F.struct(F.col("doc_id").isNull().alias("unnamed"), (-F.col("n")).alias("n"), "doc_id"))
    groups = equal.groupBy("hash", "digest").agg(best.alias("best"), F.sum("rows").alias("group_size"), F.max("bytes").alias("bytes"))
    return groups.select("hash", "digest", "bytes", F.col("best.doc_id").alias("keep"), (-F.col("best.n")).alias("n"), "group_size")


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, keep_id, group_size, kept, text_sha256) per row of docs.

    Texts are equal when they are the same bytes without SPACE_CHARS; null counts as empty, and empty texts are equal.
    Of equal texts the row with the most code points in its original text stays, then that with the smallest id. Rows
    that repeat an id count in group_size and share `kept`; a null id stays only where its group has no other. Other
    columns are ignored. An empty table gives an empty one.

    The first grouping is by the 128-bit hash and the bytes themselves, so a collision of hashes makes two groups; it
    carries each text once per task and key at most, as copies are combined before the shuffle. All later steps carry
    hashes only. The way back from groups to rows is a sort-merge join on hash, digest and length, whose hot keys the
    adaptive skew join splits.
    """
    keyed = _keyed(docs, id_col, text_col)
    groups = _groups(keyed).where("group_size > 1").drop("n")
    each = keyed.select("doc_id", "hash", F.sha2("body", 256).alias("digest"), F.octet_length("body").alias("bytes"))
    out = each.join(groups, ["hash", "digest", "bytes"], "left")
    alone = F.col("group_size").isNull()
    return out.select(
        "doc_id",
        F.when(alone, F.col("doc_id")).otherwise(F.col("keep")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1).cast("long")).alias("group_size"),
        F.when(alone, True).otherwise(F.col("doc_id").eqNullSafe(F.col("keep"))).alias("kept"),
        F.col("digest").alias("text_sha256"),
    )


def drop_copies(docs: DataFrame) -> DataFrame:
    """docs with one row of each group of equal texts, all columns as they are.

    The row that stays is that of exact_groups; of rows that repeat its id with as long a text of the group, any one.
    Groups and rows meet by content (hash and digest) as well as id and length, so ids may be null or stand on several texts.
    """
    names = {c: fresh(docs, f"kept_{c}") for c in ("hash", "digest", "n", "id", "unnamed", "size")}
    content = [names["hash"], names["digest"]]
    keys = [*content, names["n"], names["id"], names["unnamed"]]

    def named(hashed: Column, digest: Column, n: Column, doc_id: Column) -> list[Column]:
        return [c.alias(k) for c, k in zip((hashed, digest, n, F.coalesce(doc_id, F.lit(0)), doc_id.isNull()), keys)]

    groups = _groups(_keyed(docs, "doc_id", "text")).select(*named(*map(F.col, ("hash", "digest", "n", "keep"))), F.col("group_size").alias(names["size"]))
    text = F.col("text").cast("string")
    body = normalised(text)
    rows = docs.select("*", *named(F.md5(body), F.sha2(body, 256), F.char_length(F.coalesce(text, F.lit(""))).cast("long"), F.col("doc_id").cast("long")))
    kept = rows.join(groups, keys)
    size = F.col(names["size"])
    return kept.where(size == 1).unionByName(kept.where(size > 1).dropDuplicates(content)).drop(*keys, names["size"])
