"""A content-addressed store of token ids.

A rolling hash over the ids cuts each document's stream into chunks, so equal passages give equal chunks wherever they
stand. A chunk's address is a hash of its ids; each is stored once. A document's recipe lists its chunks in order; a
manifest holds Merkle roots over documents and over parts of the store, and reading checks all of them.

Layout below a path: chunks/ (digest, n, blob), recipes/ in files of ascending doc_id (doc_id, start, n_tokens, digests,
sizes, root) and manifest/ (part, first and last doc_id, documents, tokens, root).
"""

from __future__ import annotations

import functools
import hashlib
import json
import os
import re
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.llm.bpe import byte_letters
from barloom.llm.common import SPACE_CHARS, cut, drop_path, scratch_path, slices, utf8
from barloom.llm.pieces import distinct, spread
from barloom.llm.textscan import mix, power

#: Ids a rolling hash looks at, and chunk sizes: least, usual and most.
WINDOW, LEAST, USUAL, MOST = 8, 128, 1024, 8192
#: Pieces of text a Python worker remembers before it starts anew, and the longest that it remembers.
REMEMBERED, REMEMBERED_CHARS = 300_000, 200
PART_BYTES = 1 << 22

_rng = np.random.default_rng(17)
_ID = _rng.integers(1, 2**63, 1 << 16, dtype=np.uint64)
_press, _unpress = zstandard.ZstdCompressor(level=1), zstandard.ZstdDecompressor()

# The normaliser and pre-tokenizer of vocabularies whose texts may be cut into pieces beforehand.
NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]}
SPLIT = {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True}
PRE_TOKENIZER = {"type": "Sequence", "pretokenizers": [SPLIT, {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}]}

_SPACE, _LETTER = np.zeros(256, bool), np.zeros(256, bool)
_SPACE[[ord(c) for c in SPACE_CHARS]] = True
_LETTER[[*range(65, 91), *range(97, 123)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SIGNS = "".join(chr(b) for b in range(33, 127) if not chr(b).isalnum())


def pieces(raw: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Texts cut where the fixed pre-tokenizer cuts in any case: at white space, and before a full stop or comma between an ASCII letter and white space or the end.

    Gives the pieces' bytes end to end, where each begins there (one more at the end), and per text where its pieces
    begin (one more at the end). A-Z become lower case in texts without combining marks (all lie above U+02FF), where
    normal forms change nothing, and without the beginning of a special token, which is looked for before lower-casing.
    """
    n = len(raw)
    if n == 0:
        return raw, np.zeros(1, np.int64), np.zeros(len(ends), np.int64)
    edge = np.zeros(n + 1, bool)
    edge[ends] = True
    inside = ~_SPACE[raw]
    begin = inside.copy()
    begin[1:] &= ~inside[:-1] | edge[1:n]
    stop = np.flatnonzero((raw[1:] == ord(".")) | (raw[1:] == ord(","))) + 1
    stop = stop[_LETTER[raw[stop - 1]] & ~edge[stop]]
    begin[stop[edge[stop + 1] | ~inside[np.minimum(stop + 1, n - 1)]]] = True
    odd = raw >= 0xCC
    odd[:-1] |= (raw[:-1] == ord("<")) & (raw[1:] == ord("|"))
    low = _LOWER[raw]
    if odd.any():
        seen = np.concatenate([[0], np.cumsum(odd)])[ends]
        low = np.where(np.repeat(np.diff(seen) > 0, np.diff(ends)), raw, low)
    first = np.flatnonzero(begin)
    kept = np.cumsum(inside, dtype=np.int32)
    return low[inside], np.append(kept[first] - 1, kept[-1]), np.searchsorted(first, ends)


class Encoder:
    """Ids of texts by the tokenizers library, which is asked once for each piece that is new to a worker.

    Texts are cut into pieces only if the vocabulary has the normaliser and pre-tokenizer for which that is proven not
    to matter, and special tokens that are looked for as they stand; else the library gets whole texts.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        plain = all(t["content"].startswith("<|") and not (t["lstrip"] or t["rstrip"] or t["single_word"] or t["normalized"] or re.search(r"\s", t["content"])) for t in spec.get("added_tokens") or [])
        self.by_pieces = plain and spec.get("normalizer") == NORMALIZER and spec.get("pre_tokenizer") == PRE_TOKENIZER
        self.word = self.library.model.tokenize
        self.letters = dict(enumerate(byte_letters()))
        self.known: dict[str, bytes] = {}

    def _one(self, word: str) -> bytes:
        """Ids of a lower-case word of Latin-1 letters, or of ASCII signs: the pre-tokenizer leaves it whole, so the library's model gets its byte letters."""
        return array("I", [t.id for t in self.word(word if word.isascii() else word.encode().decode("latin-1").translate(self.letters))]).tobytes()

    def _learn(self, new: list[str]) -> dict[str, bytes]:
        known, one, got, rest = self.known, self._one, {}, []
        for p in new:
            low = p.lower() if p.isascii() or max(p) <= "\xff" else ""
            if low.isalpha() and len(p) <= REMEMBERED_CHARS:
                got[p] = one(low)
                continue
            core = low.rstrip(_SIGNS)
            if not core.isalpha() or len(p) > REMEMBERED_CHARS or "<|" in low:
                rest.append(p)
                continue
            for part in (core, low[len(core) :]):
                if part not in known:
                    known[part] = one(part)
            got[p] = known[core] + known[low[len(core) :]]
        got.update((p, array("I", e.ids).tobytes()) for p, e in zip(rest, self.library.encode_batch_fast(rest, add_special_tokens=False)))
        known.update(got if all(len(p) <= REMEMBERED_CHARS for p in rest) else {p: ids for p, ids in got.items() if len(p) <= REMEMBERED_CHARS})
        return got

    def encode_column(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts end to end, and where each text's begin (one more at the end); null counts as empty."""
        if not self.by_pieces:
            got = [np.array(e.ids, np.uint32) for e in self.library.encode_batch_fast([t or "" for t in column.to_pylist()], add_special_tokens=False)]
            return np.concatenate([np.empty(0, np.uint32), *got]), np.cumsum([0, *map(len, got)])
        data, offsets, at = pieces(*utf8(column))
        names, numbers = distinct(data, offsets)
        if len(self.known) > REMEMBERED:
            self.known = {}
        each = list(map(self.known.get, names))
        new = self._learn([p for p, ids in zip(names, each) if ids is None])
        if new:
            each = [new[p] if ids is None else ids for p, ids in zip(names, each)]
        return spread(each, numbers, at)

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as 32-bit integers end to end."""
        ids, at = self.encode_column(pa.array(texts, pa.string()))
        return [ids[a:b].tobytes() for a, b in zip(at.tolist(), at[1:].tolist())]


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def cuts_of(ids: np.ndarray, at: np.ndarray) -> tuple[list[int], list[int]]:
    """Where chunks of streams of ids (end to end; at: where each begins, one more at the end) begin, and per stream the number of its first chunk; one more each at the end."""
    sums = np.zeros(len(ids) + 1, np.uint64)
    up, down = power(len(ids) + 1)
    np.cumsum((_ID[ids & 0xFFFF] + (ids >> 16).astype(np.uint64)) * up[: len(ids)], out=sums[1:])
    # A chunk has LEAST ids, so a window that ends it never reaches over the beginning of its stream.
    rolled = mix((sums[WINDOW:] - sums[:-WINDOW]) * down[: max(len(sums) - WINDOW, 0)])
    places = np.flatnonzero(rolled % np.uint64(USUAL) == 0) + WINDOW
    bounds = np.searchsorted(places, at).tolist()
    out, first = [], []
    for k, (a, b) in enumerate(zip(at.tolist(), at[1:].tolist())):
        first.append(len(out))
        out.append(a)
        for c in places[bounds[k] : bounds[k + 1]].tolist() if b - a > LEAST else ():
            while c - out[-1] > MOST:
                out.append(out[-1] + MOST)
            if c - out[-1] >= LEAST and c < b:
                out.append(c)
        while b - out[-1] > MOST:
            out.append(out[-1] + MOST)
    return [*out, len(ids)], [*first, len(out)]


def cuts(ids: np.ndarray) -> list[int]:
    """Where chunks of one stream of ids begin, and its end."""
    return cuts_of(ids, np.array([0, len(ids)]))[0]


def digest_of(ids: np.ndarray) -> bytes:
    return hashlib.blake2b(np.ascontiguousarray(ids, "<u4").data, digest_size=16).digest()


def packed(ids: np.ndarray) -> bytes:
    """A chunk's bytes: narrow ids take two bytes, the low ones first, then the high ones, compressed."""
    wide = len(ids) > 0 and int(ids.max()) > 0xFFFF
    return (b"\x04" if wide else b"\x02") + _press.compress(ids.astype("<u4" if wide else "<u2").tobytes())


def unpacked(blob: bytes) -> np.ndarray:
    return np.frombuffer(_unpress.decompress(blob[1:]), "<u4" if blob[:1] == b"\x04" else "<u2").astype(np.uint32)


def merkle(leaves: list[bytes]) -> bytes:
    """Root of a binary Merkle tree; an odd node goes up as it is, no leaf gives zeros."""
    level = list(leaves)
    while len(level) > 1:
        level = [hashlib.blake2b(b"".join(level[i : i + 2]), digest_size=16).digest() if i + 1 < len(level) else level[i] for i in range(0, len(level), 2)]
    return level[0] if level else bytes(16)


class Root:
    """merkle() of leaves that come one by one; it holds one node for each power of two."""

    def __init__(self) -> None:
        self.nodes: list[tuple[int, bytes]] = []

    def add(self, leaf: bytes) -> None:
        height = 0
        while self.nodes and self.nodes[-1][0] == height:
            leaf, height = merkle([self.nodes.pop()[1], leaf]), height + 1
        self.nodes.append((height, leaf))

    def value(self) -> bytes:
        out = None
        for _, node in reversed(self.nodes):
            out = node if out is None else merkle([node, out])
        return bytes(16) if out is None else out


RECIPE = "doc_id long, row long, n_tokens long, digests array<binary>, sizes array<long>"
CHUNK = "n long, digest binary, blob binary"


def write_store(docs: DataFrame, tokenizer: str, path: str, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Encode every text of docs, append end_id, and write the store below path.

    Null and empty texts are the end id alone. Rows that repeat a doc_id, and rows without one (which come first), are
    documents of their own. Other columns are ignored. Texts are encoded whole. An empty table writes an empty store.
    Chunks are shuffled once, by digest, and each task sends a digest's bytes once; recipes carry digests and sizes only.
    What comes to the driver is a count per part of the store.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.monotonically_increasing_id().alias("row"), F.col(text_col).cast("string").alias("text"))
    # Columns of one Arrow row: a document's recipe, or a chunk (digest set).
    recipe = pa.schema([("doc_id", pa.int64()), ("row", pa.int64()), ("n_tokens", pa.int64()), ("digests", pa.list_(pa.binary())), ("sizes", pa.list_(pa.int64()))])
    chunk = pa.schema([("n", pa.int64()), ("digest", pa.binary()), ("blob", pa.binary())])
    both = pa.schema([*recipe, *chunk])

    def filled(columns: list, n: int, before: bool) -> pa.RecordBatch:
        empty = [pa.nulls(n, f.type) for f in (chunk if before else recipe)]
        return pa.RecordBatch.from_arrays([*columns, *empty] if before else [*empty, *columns], schema=both)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sent: set[bytes] = set()
        ask = encoder(tokenizer)
        for batch in batches:
            for part in slices(batch, "text", PART_BYTES):
                ids, at = ask.encode_column(part.column(2))
                stream = np.insert(ids, at[1:], end_id).astype("<u4")
                at = at + np.arange(len(at))
                bounds, first = cuts_of(stream, at)
                names = [digest_of(stream[a:b]) for a, b in zip(bounds, bounds[1:])]
                offsets = pa.array(first, pa.int32())
                sizes = pa.ListArray.from_arrays(offsets, pa.array(np.diff(bounds), pa.int64()))
                yield filled([part.column(0), part.column(1), pa.array(np.diff(at), pa.int64()), pa.ListArray.from_arrays(offsets, pa.array(names, pa.binary())), sizes], part.num_rows, True)
                if len(sent) > SENT:
                    sent.clear()
                new = {name: k for k, name in enumerate(names) if name not in sent}
                sent.update(new)
                blobs = [packed(stream[bounds[k] : bounds[k + 1]]) for k in new.values()]
                yield filled([pa.array([bounds[k + 1] - bounds[k] for k in new.values()], pa.int64()), pa.array(new.keys(), pa.binary()), pa.array(blobs, pa.binary())], len(new), False)

    made = rows.mapInArrow(run, f"{RECIPE}, {CHUNK}")
    # Rows of one digest meet; recipes go anywhere.
    dealt = made.repartition(F.coalesce("digest", F.hex("row").cast("binary"))).sortWithinPartitions("digest")

    def once(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A chunk's bytes may come from several tasks; they lie side by side."""
        last = None
        for batch in batches:
            keep = []
            for name in batch.column(batch.schema.get_field_index("digest")).to_pylist():
                keep.append(name is None or name != last)
                last = name
            yield pa.RecordBatch.from_struct_array(batch.to_struct_array().filter(pa.array(keep, pa.bool_())))

    staged = scratch_path(spark, "token-store")
    single = dealt.mapInArrow(once, made.schema).withColumn("kind", F.when(F.col("digest").isNotNull(), "chunk").otherwise("recipe"))
    single.write.partitionBy("kind").option("compression", "uncompressed").parquet(staged)
    recipes = spark.read.schema(RECIPE).parquet(f"{staged}/kind=recipe") if _exists(spark, f"{staged}/kind=recipe") else spark.createDataFrame([], RECIPE)
    _move(spark, f"{staged}/kind=chunk", f"{path}/chunks")
    parts = max(1, docs.rdd.getNumPartitions())
    ordered = cut(recipes.repartitionByRange(parts, "doc_id", "row").sortWithinPartitions("doc_id", "row").withColumn("part", F.spark_partition_id()))
    sums = {r["part"]: r["t"] for r in ordered.groupBy("part").agg(F.sum("n_tokens").alias("t")).collect()}
    before, total = {}, 0
    for p in sorted(sums):
        before[p], total = total, total + sums[p]

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, part = 0, None
        for batch in batches:
            starts, roots = [], []
            for p, n, digests in zip(batch.column("part").to_pylist(), batch.column("n_tokens").to_pylist(), batch.column("digests").to_pylist()):
                if p != part:
                    at, part = before[p], p
                starts.append(at)
                roots.append(merkle(digests))
                at += n
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(starts, pa.int64()), batch.column("n_tokens"), batch.column("digests"), batch.column("sizes"), pa.array(roots, pa.binary()), batch.column("part")], ["doc_id", "start", "n_tokens", "digests", "sizes", "root", "part"])

    # A partition of `ordered` is one part, in order; its rows go to files of that part.
    ordered.mapInArrow(number, "doc_id long, start long, n_tokens long, digests array<binary>, sizes array<long>, root binary, part int").write.parquet(f"{path}/recipes")
    _recomputed(spark, path).write.parquet(f"{path}/manifest")
    _head_of(spark.read.schema(MANIFEST).parquet(f"{path}/manifest")).write.parquet(f"{path}/head")
    drop_path(spark, staged)


#: Digests of chunks that a task remembers to have sent.
SENT = 250_000
HEAD = "parts long, documents long, tokens long, root binary"
MANIFEST = "part int, start long, first_doc long, last_doc long, documents long, tokens long, root binary"


def _manifest(held: list) -> pa.RecordBatch:
    kinds = (pa.int32(), *[pa.int64()] * 5, pa.binary())
    return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip([*held[:6], held[6].value()], kinds)], [f.split()[0] for f in MANIFEST.split(", ")])


def _recomputed(spark: SparkSession, path: str) -> DataFrame:
    """The manifest as the recipes give it: a row per part with its first start, documents, tokens and the root of their roots."""
    written = spark.read.schema("doc_id long, start long, n_tokens long, root binary, part int").parquet(f"{path}/recipes")
    # Documents without tokens start where the next one does, and come before it.
    tops = written.select("part", "start", "doc_id", "n_tokens", "root").repartition("part").sortWithinPartitions("part", "start", "n_tokens", "doc_id")

    def roots_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list | None = None
        for batch in batches:
            for part, start, doc, n, root in zip(*(c.to_pylist() for c in batch.columns)):
                if held is None or held[0] != part:
                    if held is not None:
                        yield _manifest(held)
                    held = [part, start, doc, doc, 0, 0, Root()]
                if start != held[1] + held[5]:
                    raise ValueError("a document doesn't start where the one before it ends")
                held[3], held[4], held[5] = doc, held[4] + 1, held[5] + n
                held[6].add(root)
        if held is not None:
            yield _manifest(held)

    return tops.mapInArrow(roots_of, MANIFEST)


def _check_manifest(spark: SparkSession, path: str) -> None:
    """Hold the recipes against the manifest, so that missing, cut or added ones are an error."""
    names = [f.split()[0] for f in MANIFEST.split(", ")]
    listed = spark.read.schema(MANIFEST).parquet(f"{path}/manifest").groupBy(*names).agg(F.count("*").alias("rows"))
    found = _recomputed(spark, path).groupBy(*names).agg(F.count("*").alias("rows"))
    same = [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in [*names, "rows"]]
    differ = listed.alias("a").join(found.alias("b"), F.col("a.part") == F.col("b.part"), "full").where(~functools.reduce(lambda x, y: x & y, same))
    if differ.limit(1).count():
        raise ValueError("the recipes don't fit the manifest")
    head = spark.read.schema(HEAD).parquet(f"{path}/head") if _exists(spark, f"{path}/head") else spark.createDataFrame([], HEAD)
    if [tuple(r) for r in head.collect()] != [tuple(r) for r in _head_of(spark.read.schema(MANIFEST).parquet(f"{path}/manifest")).collect()]:
        raise ValueError("the manifest doesn't fit the head")


def _head_of(manifest: DataFrame) -> DataFrame:
    """One row for the whole store: parts, documents, tokens and the root over the parts in order. A root for each part comes to the driver."""
    root, sums = Root(), [0, 0, 0]
    for r in manifest.orderBy("part", "start").toLocalIterator():
        root.add(hashlib.blake2b(b"".join(int(r[c]).to_bytes(8, "little", signed=True) for c in ("part", "start", "documents", "tokens")) + bytes(r["root"]), digest_size=16).digest())
        sums = [sums[0] + 1, sums[1] + r["documents"], sums[2] + r["tokens"]]
    return manifest.sparkSession.createDataFrame([(*sums, root.value())], HEAD)


def _files(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def _exists(spark: SparkSession, path: str) -> bool:
    p, fs = _files(spark, path)
    return fs.exists(p)


def _move(spark: SparkSession, a: str, b: str) -> None:
    """Rename a folder within one file system; a missing one becomes an empty one."""
    p, fs = _files(spark, a)
    q, _ = _files(spark, b)
    fs.mkdirs(q.getParent())
    if not (fs.rename(p, q) if fs.exists(p) else fs.mkdirs(q)):
        raise OSError(f"{a} can't become {b}")


def _chunks(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("n long, digest binary, blob binary").parquet(f"{path}/chunks")


def _uses(spark: SparkSession, path: str) -> DataFrame:
    """A row per chunk of each document, in its place, with the bytes of ids that come after it; recipes that don't fit their roots are an error."""
    recipes = spark.read.schema("doc_id long, start long, n_tokens long, digests array<binary>, sizes array<long>, root binary").parquet(f"{path}/recipes")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            digests, sizes = batch.column(3), batch.column(4)
            for n, names, own, root in zip(batch.column(2).to_pylist(), digests.to_pylist(), sizes.to_pylist(), batch.column(5).to_pylist()):
                if not names or len(names) != len(own) or sum(own) != n or merkle(names) != root:
                    raise ValueError("a recipe doesn't fit its root")
            counts = digests.value_lengths().to_numpy()
            of = pa.array(np.repeat(np.arange(batch.num_rows), counts))
            n = sizes.flatten().to_numpy()
            ends = np.cumsum(n)
            stops = np.concatenate([[0], ends])[np.cumsum(counts)]
            number = np.arange(len(n)) - np.repeat(np.cumsum(counts) - counts, counts)
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(k).take(of) for k in range(3)), pa.array(number, pa.int64()), digests.flatten(), pa.array(n), pa.array(4 * (np.repeat(stops, counts) - ends))],
                ["doc_id", "start", "n_tokens", "number", "digest", "n", "after"],
            )

    return recipes.mapInArrow(run, "doc_id long, start long, n_tokens long, number long, digest binary, n long, after long")


def read_store(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids) from the files; a chunk, recipe or part that doesn't fit its digest, root or manifest is an error."""
    _check_manifest(spark, path)
    found = _uses(spark, path).join(_chunks(spark, path).select("digest", "blob"), "digest", "left").groupBy("doc_id", "start", "n_tokens").agg(F.array_sort(F.collect_list(F.struct("number", "digest", "n", "blob"))).alias("c"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            ids = []
            for n, chunks in zip(rows["n_tokens"], rows["c"]):
                parts = [_verified(bytes(c["digest"]), c["blob"]) for c in chunks]
                if [len(p) for p in parts] != [c["n"] for c in chunks] or sum(map(len, parts)) != n:
                    raise ValueError("a recipe doesn't fit its chunks")
                ids.append(np.concatenate(parts).astype(np.int64))
            yield rows[["doc_id", "start", "n_tokens"]].assign(ids=ids)

    return found.mapInPandas(run, "doc_id long, start long, n_tokens long, ids array<long>")


def _verified(digest: bytes, blob: bytes | None) -> np.ndarray:
    if blob is None:
        raise ValueError("a chunk is missing")
    ids = unpacked(bytes(blob))
    if digest_of(ids) != digest:
        raise ValueError("a chunk doesn't fit its digest")
    return ids


_POLY = np.uint32(0xEDB88320)


def _times(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Products of polynomials modulo that of CRC-32, bits reversed as usual."""
    out = np.zeros_like(b)
    for k in range(31, -1, -1):
        out ^= b * (a >> np.uint32(k) & np.uint32(1))
        b = b >> np.uint32(1) ^ _POLY * (b & np.uint32(1))
    return out


def shifted(crcs: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """CRC-32 values as they count where so many bytes follow: the CRC of byte strings end to end is the exclusive or of theirs."""
    out, n = crcs.astype(np.uint32), 8 * sizes.astype(np.int64)
    square = np.full(1, 1 << 30, np.uint32)  # x, then x^2, x^4 and so on
    while n.any():
        odd = n & 1 == 1
        out[odd] = _times(np.broadcast_to(square, int(odd.sum())), out[odd])
        square, n = _times(square, square), n >> 1
    return out


def crc_joined(first: int, second: int, size: int) -> int:
    """CRC-32 of two byte strings end to end, from their own and the size of the second."""
    return int(shifted(np.array([first]), np.array([size]))[0]) ^ second


def read_checksums(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) from the files, every chunk and root and the manifest checked.

    A chunk is read once, wherever it is used: its bytes are verified and summed up where they lie, and only the sums
    meet the recipes. The CRC of a document is the exclusive or of its chunks', each moved by the bytes after it.
    """
    _check_manifest(spark, path)

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [(_verified(d, b)) for d, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(x) for x in got], pa.int64()), pa.array([zlib.crc32(x.astype("<u4").data) for x in got], pa.int64())], ["digest", "found", "crc"])

    def moved(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.column(5).null_count or not batch.column(3).equals(batch.column(5)):
                raise ValueError("a chunk is missing or doesn't fit a recipe")
            crc = shifted(batch.column(6).to_numpy(), batch.column(4).to_numpy()).astype(np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(crc)], ["doc_id", "start", "n_tokens", "crc"])

    chunks = _chunks(spark, path).select("digest", "blob").mapInArrow(sums, "digest binary, found long, crc long")
    met = _uses(spark, path).join(chunks, "digest", "left").select("doc_id", "start", "n_tokens", "n", "after", "found", "crc")
    each = met.mapInArrow(moved, "doc_id long, start long, n_tokens long, crc long")
    return each.groupBy("doc_id", "start", "n_tokens").agg(F.bit_xor("crc").alias("ids_crc32"))
