"""N-gram Jaccard join: documents whose sets of word shingles are alike, and the groups that such links make.

How the work is dealt out:

1. One pass gives each text the sorted hashes of its shingles. Shingles that come up often are put last in the global
   order, the rest go by hash. Of each set only the first few members, its size and a 128-bit name go on: the prefix
   that every similar set must meet, longer by three hundredths of the set. Rows of equal sets become one before
   anything is exploded, and each set gets a number; doc_ids come back at the end, so they may be null or repeat.
2. Two similar sets share not one member of such longer prefixes but three hundredths of the smaller set, and one more.
   Prefix members are counted (combined before the shuffle); sets that share too few of theirs with any other row are
   done. The others' prefix members are grouped, by classes of set sizes, to the smallest set number that holds each, its
   head. Similar sets share a prefix member, so they share a head, and it is enough to compare sets under one head.
   Sketches of a bit a member then part those sets that differ in too many members to be similar.
3. Texts whose sets share a head with another set are brought together and compared in blocks of bounded size, each by
   a prefix tree (prefix_tree.py). Sets that are linked with the head are not compared with each other; what stays open
   goes on to the other blocks of the same head.
4. The links' connected components name the groups.
"""

from __future__ import annotations

import hashlib
import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barloom.llm.common import cut, fresh, slices, utf8
from barloom.llm.components import components
from barloom.llm.prefix_tree import Groups, linked, may_link, prefix_size, sketch, spare
from barloom.llm.textscan import shingle_sets

#: Bytes of text whose hashes are worked out at once.
PART_BYTES = 1 << 20
#: Common shingles that the global order knows by their counts: at most so many are broadcast (16 bytes each). This
#: touches the order alone, not the result: any order that is the same everywhere finds the same links.
COMMON_KEPT = 200_000
#: A shingle counts as common from so many texts in one part on.
COMMON_FROM = 4
#: Sets of one head whose sketches are compared, in one task; heads of more go on without, which loses no link.
SIFTED_SETS = 4096
#: Members, over all its sets, of a block that one task holds at once.
BLOCK_MEMBERS = 1_500_000


def _signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def _common(docs: DataFrame, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of common shingles in ascending order, and their places by count (1: the least common)."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", PART_BYTES):
                sets = shingle_sets(*utf8(part.column(part.schema.get_field_index("text"))), width)
                names, n = np.unique(np.concatenate(sets), return_counts=True) if sets else (np.empty(0, np.uint64), np.empty(0, np.int64))
                often = n >= COMMON_FROM
                yield pa.RecordBatch.from_arrays([pa.array(_signed(names[often])), pa.array(n[often].astype(np.int64))], ["shingle", "n"])

    rows = docs.select("text").mapInArrow(count, "shingle long, n long").groupBy("shingle").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "shingle").limit(COMMON_KEPT).collect()
    shingles = np.array([r[0] for r in rows], np.int64).view(np.uint64)
    places = np.arange(len(rows), 0, -1, dtype=np.int64)
    order = np.argsort(shingles)
    return shingles[order], places[order]


def _place(members: np.ndarray, common: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """Per member its place among the common ones, 0 if it is none of them."""
    shingles, places = common
    if not len(shingles) or not len(members):
        return np.zeros(len(members), np.int64)
    at = np.minimum(np.searchsorted(shingles, members), len(shingles) - 1)
    return np.where(shingles[at] == members, places[at], 0)


def _ordered(members: np.ndarray, common: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """Ascending hashes in the global order."""
    place = _place(members, common)
    return members if not place.any() else members[np.argsort(place, kind="stable")]


def _lists(parts: list[np.ndarray]) -> pa.ListArray:
    sizes = np.cumsum([0, *map(len, parts)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(sizes), pa.array(_signed(np.concatenate(parts)) if parts else np.empty(0, np.int64)))


def _content(text: Column) -> Column:
    """What stands for a text beside its doc_id where rows are found again."""
    return F.xxhash64(F.coalesce(text.cast("string"), F.lit("")))


def ngram_groups(docs: DataFrame, width: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text", block_members: int = BLOCK_MEMBERS) -> DataFrame:
    """(doc_id, n_shingles, component_id) per row of docs: groups of texts linked by Jaccard similarity of their shingles.

    A text's words are lower-cased (A-Z) runs without ASCII white space; its set holds the distinct shingles of `width`
    words, or the whole sequence if there are fewer. Two texts link when 100 * intersection >= percent * union;
    component_id is the smallest doc_id that links reach. Texts without words, and nulls, have n_shingles 0, link with
    nothing and are their own component. Rows with equal texts each give a row. A doc_id may stand on several texts, each
    of which is a document of its own; rows without doc_id link like others, also two others with each other, and their
    component_id is null only where all that they reach have none. Other columns of docs are ignored, so their names
    cannot clash. An empty table gives an empty one. Very long texts are taken whole. Shingles are compared by 64-bit
    hashes, equal sets by 128 bits.
    """
    return _grouped(docs, width, percent, id_col, text_col, block_members).drop("content")


def _grouped(docs: DataFrame, width: int, percent: int, id_col: str, text_col: str, block_members: int) -> DataFrame:
    """ngram_groups with a column content, which finds each row's text again."""
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), _content(F.col(text_col)).alias("content"))
    common = spark.sparkContext.broadcast(_common(rows, width))

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", PART_BYTES):
                sets = shingle_sets(*utf8(part.column(1)), width)
                names = np.array([np.frombuffer(hashlib.blake2b(s.tobytes(), digest_size=16).digest(), np.int64) for s in sets], np.int64).reshape(-1, 2)
                prefix = [_ordered(s, common.value)[: prefix_size(len(s), percent) + spare(len(s))] for s in sets]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), pa.array(np.array([len(s) for s in sets], np.int64)), pa.array(names[:, 0]), pa.array(names[:, 1]), _lists(prefix), pa.array([sketch(s) for s in sets], pa.binary())], ["doc_id", "content", "n_shingles", "hi", "lo", "prefix", "sketch"])

    described = cut(rows.mapInArrow(describe, "doc_id long, content long, n_shingles long, hi long, lo long, prefix array<long>, sketch binary"))
    best = F.min(F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "content")).alias("best")
    sets = described.where("n_shingles > 0").groupBy("hi", "lo", "n_shingles").agg(best, F.first("prefix").alias("prefix"), F.first("sketch").alias("sketch"))
    sets = cut(sets.select(F.monotonically_increasing_id().alias("number"), "hi", "lo", "n_shingles", "best.doc_id", "best.content", "prefix", "sketch"))
    exploded = sets.select("number", F.col("n_shingles").cast("int").alias("n_shingles"), F.explode("prefix").alias("shingle"))
    repeated = exploded.groupBy("shingle").agg(F.count("*").alias("k")).where("k > 1").select("shingle")
    shared = cut(exploded.join(repeated, "shingle", "left_semi"))
    least = F.floor(3 * F.ceil(F.col("n_shingles") * percent / 100) / 100) + 1  # spare() of the smallest partner
    enough = shared.groupBy("number", "n_shingles").agg(F.count("*").alias("met")).where(F.col("met") >= least).select("number")
    # Similar sets are of one class of sizes or of two that follow each other; the smaller set is also in the class above.
    own = F.floor(F.log(F.col("n_shingles")) / math.log(1.001 * 100 / percent))
    postings = shared.join(enough, "number", "left_semi").withColumn("own", own).select("number", "shingle", "own", F.explode(F.array("own", F.col("own") + 1)).alias("size"))
    # Pairs below a class are compared there, so a group needs a set of its class.
    heads = postings.groupBy("shingle", "size").agg(F.min("number").alias("first"), F.max("number").alias("last"), F.max("own").alias("top")).where("first < last and top = size").select("shingle", "size", "first")
    members = cut(postings.join(heads, ["shingle", "size"]).select(F.xxhash64("first", "size").alias("head"), "number").distinct())
    # A head's sets meet in one task to be sifted if it has few; those of the others go on from where they are.
    sizes = members.groupBy("head").agg(F.count("*").alias("m"), F.min("number").alias("least"))
    counted = members.join(sizes, "head")
    few, many = counted.where(F.col("m") <= SIFTED_SETS), counted.where(F.col("m") > SIFTED_SETS)
    sketched = few.join(sets.select("number", "n_shingles", "sketch"), "number").select("head", "number", "n_shingles", "sketch").repartition("head").sortWithinPartitions("head", "number")

    def sift(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Parts of each head's sets that sketches allow links in."""
        rows: list[tuple[int, int, int, bytes]] = []

        def done() -> pa.RecordBatch:
            part = may_link([r[3] for r in rows], [r[2] for r in rows], percent)
            several = {p for p, k in Counter(part).items() if k > 1}
            found = [(r[0], rows[p][1], r[1], r[2], i == p) for i, (r, p) in enumerate(zip(rows, part)) if p in several]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found) if found else ([], [], [], [], []), (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.bool_()))], ["under", "part", "number", "n_shingles", "is_head"])

        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                if rows and rows[0][0] != row[0]:
                    yield done()
                    rows = []
                rows.append(row)
        if rows:
            yield done()

    sifted = sketched.mapInArrow(sift, "under long, part long, number long, n_shingles long, is_head boolean")
    passed = many.join(sets.select("number", "n_shingles"), "number").select(F.col("head").alias("under"), F.lit(0).cast("long").alias("part"), "number", "n_shingles", (F.col("number") == F.col("least")).alias("is_head"))
    sized = cut(sifted.unionByName(passed).withColumn("head", F.xxhash64("under", "part")))
    blocks = sized.groupBy("head").agg(F.count("*").alias("m"), F.sum("n_shingles").alias("total")).where("m > 1").select("head", F.ceil(F.col("total") / block_members).alias("blocks"))
    wanted = sized.join(blocks, "head").select("number", "head", "is_head", "blocks")
    tasks = wanted.groupBy("number").agg(F.collect_list(F.struct("head", "is_head", "blocks")).alias("tasks"))
    # One row of each set has its smallest doc_id; rows that repeat both id and text count once.
    keys = [F.coalesce("doc_id", F.lit(0)).alias("id"), F.col("doc_id").isNull().alias("unnamed"), "content"]
    asked = sets.select("number", *keys).join(tasks, "number")
    texts = rows.select("text", *keys).join(asked, ["id", "unnamed", "content"]).dropDuplicates(["number"])

    # Texts travel, not sets: a text is a third of the bytes of its hashes, and hashing it again costs little.
    flat = texts.select("number", "text", F.explode("tasks").alias("t")).select("number", "text", "t.head", "t.is_head", "t.blocks")
    home = F.array(F.pmod(F.xxhash64("number"), F.col("blocks")))
    everywhere = F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)
    first = flat.withColumn("block", F.explode(F.when(F.col("is_head"), everywhere).otherwise(home)))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by head and block, the head first; one block is held at a time."""
        key, held = None, []

        def done() -> pa.RecordBatch:
            names = [h[0] for h in held]
            pairs = linked([h[1] for h in held], [h[2] for h in held], percent, lambda x: _place(x, common.value)) if len(held) > 1 else []
            groups: list[int] = []
            if key is not None and key[2] > 1:  # what the head doesn't reach within its block goes on to the others
                reach = Groups(len(names))
                for i, j in pairs:
                    reach.join(i, j)
                groups = sorted({names[i] for i in range(len(names)) if reach.root(i) != reach.root(0)})
            return pa.RecordBatch.from_arrays(
                [pa.array([names[i] for i, _ in pairs] + groups, pa.int64()), pa.array([names[j] for _, j in pairs] + [None] * len(groups), pa.int64()), pa.array([None] * len(pairs) + [key[0]] * len(groups), pa.int64())],
                ["u", "v", "open_under"],
            )

        for batch in batches:
            for part in slices(batch, "text", PART_BYTES):
                sets = shingle_sets(*utf8(part.column(part.schema.get_field_index("text"))), width)
                columns = [part.column(part.schema.get_field_index(c)).to_pylist() for c in ("head", "block", "blocks", "number", "probe")]
                for members, head, block, blocks_, number, probe in zip(sets, *columns):
                    if key is None or key[:2] != (head, block):
                        if len(held) > 1:
                            yield done()
                        key, held = (head, block, blocks_), []
                    held.append((number, members, probe))
        if len(held) > 1:
            yield done()

    out = "u long, v long, open_under long"

    def run(work: DataFrame) -> DataFrame:
        dealt = work.repartition("head", "block").sortWithinPartitions("head", "block", F.desc("is_head"), "number")
        return cut(dealt.select("head", "block", "blocks", "number", "probe", "text").mapInArrow(compare, out))

    links = run(first.withColumn("probe", F.lit(True)))
    open_sets = links.where("open_under is not null").select(F.col("u").alias("number"), F.col("open_under").alias("head")).distinct()
    if open_sets.limit(1).count():
        # An open set is compared in every block, a head is there to link with, all others wait at home.
        several = flat.where("blocks > 1").join(open_sets.select("head").distinct(), "head", "left_semi")
        several = several.join(open_sets.withColumn("probe", F.lit(True)), ["head", "number"], "left").withColumn("probe", F.coalesce("probe", F.lit(False)) & ~F.col("is_head"))
        second = several.withColumn("block", F.explode(F.when(F.col("is_head") | F.col("probe"), everywhere).otherwise(home)))
        links = links.unionByName(run(second))
    found = components(links.where("v is not null").select("u", "v")).withColumnRenamed("node", "number").join(sets.select("number", "doc_id"), "number")
    smallest = found.groupBy("component").agg(F.min("doc_id").alias("smallest"))
    reached = found.join(smallest, "component").select("number", "smallest")
    named = sets.select("hi", "lo", "n_shingles", "number", F.col("doc_id").alias("own_id")).join(reached, "number", "left").select("hi", "lo", "n_shingles", F.coalesce("smallest", "own_id").alias("component"))
    rows_again = described.select("doc_id", "content", "n_shingles", "hi", "lo")
    return rows_again.join(named, ["hi", "lo", "n_shingles"], "left").select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"), "content")


def drop_near(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """docs with the rows of the smallest doc_id of each group of linked texts, and all columns as they are.

    Texts without words stay. A row goes with its own text's group, whatever other texts its doc_id stands on; rows
    without an id go where their group has a row with one, else all of them stay. Rows of one group that repeat its
    smallest id all stay; exact dedup comes before.
    """
    names = {c: fresh(docs, f"gone_{c}") for c in ("id", "unnamed", "content")}
    keys = lambda content: [F.coalesce(F.col("doc_id").cast("long"), F.lit(0)).alias(names["id"]), F.col("doc_id").isNull().alias(names["unnamed"]), content.alias(names["content"])]
    groups = _grouped(docs, width, percent, "doc_id", "text", BLOCK_MEMBERS)
    later = (F.col("component_id") < F.col("doc_id")) | (F.col("doc_id").isNull() & F.col("component_id").isNotNull())
    gone = groups.where((F.col("n_shingles") > 0) & later).select(*keys(F.col("content"))).distinct()
    return docs.select("*", *keys(_content(F.col("text")))).join(gone, list(names.values()), "left_anti").select(*docs.columns)
