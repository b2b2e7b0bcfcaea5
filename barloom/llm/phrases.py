"""Document fingerprints by locally consistent parsing.

A text is cut into phrases of two to four symbols, the phrases get names, and the row of names is cut again, level by
level. Where a cut falls is decided by deterministic coin tossing: a symbol's label tells the lowest bit in which it
differs from its left neighbour, a few rounds bring the labels down to three, and cuts fall at their local extremes.
That depends on a handful of symbols nearby, so equal substrings get equal names inside, wherever they stand. A
fingerprint holds the smallest hashes of a text's phrase names, from phrases of about fifteen characters upward.
"""

from __future__ import annotations

import bisect
import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.llm.textscan import mix

#: Levels whose names count: phrases of level 3 are about fifteen characters long.
FIRST_LEVEL, LAST_LEVEL = 3, 7
#: Hashes in a fingerprint, eight hexadecimal digits each.
HASHES = 48
#: Characters that are parsed at once; a longer text is parsed by itself.
PART_CHARS = 1 << 20
#: Bytes of text of a range of doc_ids, about; and ranges that are counted for each one that is made.
RANGE_BYTES, FINE = 64 << 20, 4
#: Characters by which rows of one id are put in order.
HEAD = 64

_PLACE = np.random.default_rng(11).integers(1, 2**63, 16, dtype=np.uint64) | np.uint64(1)
_ZEROS = np.array([8] + [(b & -b).bit_length() - 1 for b in range(1, 256)], np.uint8)


def _left(x: np.ndarray, starts: np.ndarray, other: np.ndarray) -> np.ndarray:
    """Left neighbours; a text's first symbol takes other's."""
    out = np.empty_like(x)
    out[1:] = x[:-1]
    out[starts] = other[starts]
    return out


def _labels(symbols: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Labels 0, 1 and 2, no two neighbours alike. symbols: no two neighbours alike within a text."""
    differ = symbols ^ _left(symbols, starts, ~symbols)
    place = np.bitwise_count((differ & (~differ + differ.dtype.type(1))) - differ.dtype.type(1))
    label = (2 * place + ((symbols >> place.astype(symbols.dtype)) & symbols.dtype.type(1)).astype(np.uint8)).astype(np.uint8)
    for _ in range(3):  # 128 labels, then 14, 8 and 6
        place = _ZEROS[label ^ _left(label, starts, ~label)]
        label = 2 * place + (label >> place & 1)
    for v in (3, 4, 5):
        at = np.flatnonzero(label == v)
        if not len(at):
            continue
        left = label[at - 1]  # the first symbol of all looks at the last; any choice that is free will do
        left = np.where(np.isin(at, starts, assume_unique=True), 9, left)
        right = np.where(np.isin(at + 1, starts, assume_unique=True) | (at + 1 == len(label)), 9, label[np.minimum(at + 1, len(label) - 1)])
        label[at] = np.where((left != 0) & (right != 0), 0, np.where((left != 1) & (right != 1), 1, 2))
    return label


def _phrases(symbols: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Names of the phrases of all texts, and where each text's phrases begin. starts: where each text begins; none is empty."""
    n = len(symbols)
    fresh = np.empty(n, bool)
    fresh[0] = True
    np.not_equal(symbols[1:], symbols[:-1], out=fresh[1:])
    fresh[starts] = True
    at = np.flatnonzero(fresh)
    if len(at) < n:  # a run becomes one symbol that knows its length
        length = np.diff(np.append(at, n)).astype(np.uint64)
        run = symbols[at].astype(np.uint64)
        symbols = np.where(length > 1, mix(run + mix(length)), run)
        starts = np.searchsorted(at, starts)
    label = _labels(symbols, starts).astype(np.int8)
    n = len(label)
    left, right = np.empty_like(label), np.empty_like(label)
    left[1:], right[:-1] = label[:-1], label[1:]
    left[starts] = right[-1] = 9
    right[starts[1:] - 1] = 9
    top = (label > np.where(left == 9, -1, left)) & (label > np.where(right == 9, -1, right))
    low = (label < left) & (label < right)
    beside = np.zeros(n, bool)  # whether a neighbour in the same text is a top
    beside[:-1] = top[1:]
    beside[starts[1:] - 1] = False
    before = np.zeros(n, bool)
    before[1:] = top[:-1]
    before[starts] = False
    cut = top | (low & ~beside & ~before)
    cut[starts] = True
    at = np.flatnonzero(cut)
    within = np.arange(n) - np.repeat(at, np.diff(np.append(at, n)))
    names = mix(np.add.reduceat(mix(symbols.astype(np.uint64)) * _PLACE[np.minimum(within, 15)], at))
    return names, np.searchsorted(at, starts)


def phrase_names(texts: list[str]) -> list[np.ndarray]:
    """Per text the distinct names (32 bits) of its phrases, ascending; none for an empty text."""
    out = [np.empty(0, np.uint32)] * len(texts)
    full = [i for i, t in enumerate(texts) if t]
    if not full:
        return out
    symbols = np.frombuffer("".join(texts[i] for i in full).encode("utf-32-le", "surrogatepass"), np.uint32)
    starts = np.cumsum([0, *(len(texts[i]) for i in full[:-1])])
    levels = []
    for level in range(1, LAST_LEVEL + 1):
        symbols, starts = _phrases(symbols, starts)
        if level >= FIRST_LEVEL:
            levels.append(((mix(symbols + np.uint64(level)) >> np.uint64(32)).astype(np.uint32), np.append(starts, len(symbols))))
    for k, i in enumerate(full):
        out[i] = np.unique(np.concatenate([names[at[k] : at[k + 1]] for names, at in levels]))
    return out


def fingerprints_of(texts: list[str]) -> list[np.ndarray]:
    return [names[:HASHES] for names in phrase_names(texts)]


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Estimate of the share of phrases that two texts have in common, from 0 to 1; two empty texts are alike.

    Its standard error is 0.072 at most (HASHES of all phrases are compared), 0.05 on the average of the tests.
    """
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    both = np.union1d(a, b)
    if len(a) >= HASHES or len(b) >= HASHES:
        both = both[:HASHES]
    return float(np.isin(both, np.intersect1d(a, b, assume_unique=True), assume_unique=True).mean())


def written(fingerprint: np.ndarray) -> str:
    return fingerprint.astype(">u4").tobytes().hex()


def _parts(texts: list[str]) -> Iterator[tuple[int, int]]:
    first, chars = 0, 0
    for i, t in enumerate(texts):
        if chars and chars + len(t) > PART_CHARS:
            yield first, i
            first, chars = i, 0
        chars += len(t)
    if first < len(texts):
        yield first, len(texts)


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fingerprint) per row of docs; one pass without a shuffle.

    Equal texts have equal fingerprints; null counts as empty, whose fingerprint is "". Texts are parsed whole. Repeated
    rows each give a row; other columns are ignored; an empty table gives an empty one.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            for a, b in _parts(texts):
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array([written(f) for f in fingerprints_of(texts[a:b])], pa.string())], ["doc_id", "fingerprint"])

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, fingerprint string")


def edited(text: str, other: str) -> str:
    """The text with its last half (rounded down) replaced by as many characters of the other, or all it has."""
    half = len(text) // 2
    return text[: len(text) - half] + other[:half]


def with_edits(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of docs its fingerprint, that of its edited text, and how alike they and its neighbour's are.

    The next document is that of the next smaller doc_id, after the last the first; rows without id come last, rows of
    one id by the first HEAD characters of their texts, then by a hash of them. Null counts as empty. A single row is its
    own neighbour. An empty table gives an empty one.

    Texts are dealt once, into ranges of that order of about the same number of bytes; each range also gets the first row
    of the next, so a task needs no other range. What comes to the driver is a place in the order and a number of bytes
    for each of FINE finer ranges per range. Only rows that repeat id and text are of one range however many they are.
    """
    key = F.bitwise_not(F.coalesce(F.col(id_col).cast("long"), F.lit(-(2**63)))).alias("key")  # falls as the id rises
    rows = docs.select(key, F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    rows = rows.withColumns({"front": F.substring("text", 1, HEAD), "hash": F.xxhash64("text")})
    place = ["key", "front", "hash"]
    least = max(1, rows.rdd.getNumPartitions())
    sizes = rows.select(*place, F.octet_length("text").cast("long").alias("bytes")).repartitionByRange(FINE * least, *place)
    fine = sizes.groupBy(F.spark_partition_id()).agg(F.min(F.struct(*place)).alias("low"), F.max(F.struct(*place)).alias("top"), F.sum("bytes").alias("bytes")).collect()
    fine = sorted(fine, key=lambda r: tuple(r["top"]))
    upto = np.cumsum([r["bytes"] + 1 for r in fine])
    ranges = max(least, -(-int(upto[-1]) // RANGE_BYTES)) if fine else 1
    # A fine range is of the range that its middle falls into; the last one of each is its top, the next its successor's first.
    share = (upto - np.diff(upto, prepend=0) / 2) * ranges // upto[-1] if fine else upto
    ends = np.append(np.diff(share) > 0, True) if fine else np.empty(0, bool)
    tops = [tuple(r["top"]) for r, last in zip(fine, ends) if last]
    lows = [tuple(r["low"]) for r, last in zip(fine, np.append(True, ends[:-1])) if last] if fine else []
    n = len(tops)

    @F.pandas_udf("array<struct<range:long,guest:boolean>>")
    def places(keys: pd.Series, fronts: pd.Series, hashes: pd.Series) -> pd.Series:
        out = []
        for at in zip(keys.tolist(), fronts.tolist(), hashes.tolist()):
            home = bisect.bisect_left(tops, at)
            out.append([(home, False), ((home - 1) % n, True)] if lows[home] == at else [(home, False)])
        return pd.Series(out)

    dealt = rows.select("doc_id", *place, "text", F.explode(places(*place)).alias("place")).select("doc_id", *place, "text", "place.range", "place.guest")
    dealt = dealt.repartitionById(max(1, n), F.col("range").cast("int")).sortWithinPartitions("range", "guest", *place)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[int, str]] = []  # rows in order, each the next of the one before
        chars, at, closed = 0, None, False

        def done() -> pa.RecordBatch:
            texts = [t for _, t in held]
            changed = [edited(a, b) for a, b in zip(texts, texts[1:])]
            prints, changed_prints = [], []
            for all_of, into in ((texts, prints), (changed, changed_prints)):
                for a, b in _parts(all_of):
                    into += fingerprints_of(all_of[a:b])
            return pa.RecordBatch.from_arrays(
                [
                    pa.array([i for i, _ in held[:-1]], pa.int64()),
                    pa.array([len(t) for t in texts[:-1]], pa.int64()),
                    pa.array([hashlib.sha256(t.encode("utf-8", "surrogatepass")).hexdigest() for t in changed], pa.string()),
                    pa.array([written(p) for p in prints[:-1]], pa.string()),
                    pa.array([written(p) for p in changed_prints], pa.string()),
                    pa.array([likeness(a, b) for a, b in zip(prints, changed_prints)], pa.float64()),
                    pa.array([likeness(a, b) for a, b in zip(prints, prints[1:])], pa.float64()),
                ],
                ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"],
            )

        for batch in batches:
            for i, text, range_, guest in zip(*(batch.column(k).to_pylist() for k in range(4))):
                if range_ != at:
                    held, chars, at, closed = [], 0, range_, False
                if closed:
                    continue  # the next range's first row once more, where its id is repeated
                held.append((i, text))
                chars += len(text)
                if guest or (chars > PART_CHARS and len(held) > 1):
                    yield done()
                    held, chars, closed = held[-1:], len(text), guest

    out = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    return dealt.select("doc_id", "text", "range", "guest").mapInArrow(run, out)
