"""Byte-level BPE encoding and decoding with a published vocabulary.

Merges are found with a segment tree over the ranks of adjacent pairs: its root names the leftmost pair of the lowest
rank, and a merge changes three leaves, each in a logarithmic number of steps. Many pieces of text are merged side by
side, one row of a numpy array each. Every worker remembers a bounded number of bounded pieces it has met, in two turns:
when one is full, the other is forgotten.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.llm.common import SPACE_CHARS, fresh, slices, utf8
from barloom.llm.pieces import distinct, lengths, spread

#: Fixed: the pattern by which byte-level BPE of this kind cuts text before merging.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"
#: Pieces a Python worker meets before it forgets those that it met neither since nor in the turn before, and the longest that it remembers.
REMEMBERED, REMEMBERED_CHARS = 150_000, 200
#: Bytes of text that are worked on at once.
PART_BYTES = 1 << 21
#: Kinds of bytes: white space, ASCII letters, digits, other ASCII (no white space), parts of other characters.
SPACE, LETTER, DIGIT, SIGN, WIDE = range(5)
_KIND = np.full(256, SIGN, np.uint8)
_KIND[[ord(c) for c in SPACE_CHARS]] = SPACE
_KIND[[*range(65, 91), *range(97, 123)]] = LETTER
_KIND[48:58] = DIGIT
_KIND[128:] = WIDE
#: First bytes of two-byte characters none of which is white space.
_TWO = np.zeros(256, bool)
_TWO[0xC3:0xE0] = True
#: Rows of one segment-tree batch, and the width from which pieces are merged one by one.
BATCH_ROWS, SINGLE_FROM = 1 << 12, 256
NONE = np.iinfo(np.int64).max


def byte_letters() -> list[str]:
    """The letter that stands for each byte: itself where it prints, else the next free code point from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    free = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(free)) for b in range(256)]


def cut_places(raw: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Where the pattern cuts texts in any case, the beginnings of texts included.

    That is between ASCII letters, digits and signs, unless the sign is an apostrophe that letters follow; before white
    space that doesn't follow white space; and after a single white space other than a space, where no white space follows.
    Whatever may be white space of another kind (any character of three bytes or more, and some of two) is left alone.
    """
    n = len(raw)
    cut = np.zeros(n + 1, bool)
    cut[ends] = True
    if n > 1:
        kind = _KIND[raw]
        left, right = kind[:-1], kind[1:]
        solid = (left != SPACE) & (left != WIDE)  # the character before is surely no white space
        solid[1:] |= _TWO[raw[:-2]] & (left[1:] == WIDE)
        follows = (right != SPACE) & ((right != WIDE) | _TWO[raw[1:]])
        cut[1:n] |= (left != right) & (left != SPACE) & (right != SPACE) & (left != WIDE) & (right != WIDE) & (raw[:-1] != ord("'"))
        cut[1:n] |= (right == SPACE) & solid
        cut[1:n] |= (left == SPACE) & cut[: n - 1] & (raw[:-1] != ord(" ")) & follows
    return np.flatnonzero(cut[:n])


def one_word(piece: str) -> bool:
    """Whether a piece is letters of the Latin blocks alone, or such after one space: the pattern leaves that whole."""
    letters = piece[1:] if piece.startswith(" ") else piece
    return letters.isalpha() and (letters.isascii() or max(letters) < "\u0250")


class Vocabulary:
    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, letters = spec["model"], byte_letters()
        byte_of = {c: b for b, c in enumerate(letters)}
        ids: dict[str, int] = model["vocab"]
        merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        self.first = np.array([ids[c] for c in letters], np.int64)
        self.made = np.array([ids[a + b] for a, b in merges], np.int64)
        pairs = np.array([ids[a] << 32 | ids[b] for a, b in merges], np.int64)
        order = np.argsort(pairs, kind="stable")
        self.pairs, self.ranks = pairs[order], order
        self.rank_of = {int(p): r for p, r in zip(pairs[::-1].tolist(), range(len(merges) - 1, -1, -1))}
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        text = {i: bytes(byte_of[c] for c in t) for t, i in ids.items()} | {i: t.encode() for t, i in self.special.items()}
        self.text = [text.get(i, b"") for i in range(max(text) + 1)]
        self.text_sizes = np.array([len(t) for t in self.text], np.int64)
        self.text_starts = np.cumsum(self.text_sizes) - self.text_sizes
        self.text_pool = np.frombuffer(b"".join(self.text), np.uint8)
        self.special_split = re.compile("(" + "|".join(re.escape(s) for s in sorted(self.special, key=len, reverse=True)) + ")") if self.special else None
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.made_list = self.made.tolist()
        self.pattern = regex.compile(PATTERN)

    def pair_ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair of symbols, NONE where there is no merge (or a side is -1)."""
        key = left << 32 | right
        at = np.minimum(np.searchsorted(self.pairs, key), len(self.pairs) - 1)
        return np.where((left >= 0) & (right >= 0) & (self.pairs[at] == key), self.ranks[at], NONE)

    def merge_rows(self, symbols: np.ndarray, width: int) -> None:
        """Merge in place every row of symbols (padded with -1 to width + 1 columns; width: a power of two)."""
        n, cols = len(symbols), width + 1
        places = np.arange(width)
        ranks = self.pair_ranks(symbols[:, :-1], symbols[:, 1:])
        tree = np.full((n, 2 * width), NONE, np.int64)
        tree[:, width:] = np.where(ranks == NONE, NONE, ranks * width + places)
        for level in range(width.bit_length() - 1, 0, -1):
            a = 1 << (level - 1)
            below = tree[:, 2 * a : 4 * a]
            np.minimum(below[:, 0::2], below[:, 1::2], out=tree[:, a : 2 * a])
        after = np.tile(np.arange(1, cols + 1), (n, 1))
        before = np.tile(np.arange(-1, cols - 1), (n, 1))
        row = np.flatnonzero(tree[:, 1] != NONE)
        while len(row):
            top = tree[row, 1]
            at = top % width
            symbols[row, at] = self.made[top // width]
            gone = after[row, at]
            symbols[row, gone] = -1
            beyond = after[row, gone]
            after[row, at] = beyond
            inside = beyond < cols
            before[row[inside], beyond[inside]] = at[inside]
            right = np.where(inside, symbols[row, np.minimum(beyond, cols - 1)], -1)
            prior = before[row, at]
            has = prior >= 0
            prior_row, prior = row[has], prior[has]
            left = np.concatenate([symbols[row, at], symbols[prior_row, prior]])
            ranks = self.pair_ranks(left, np.concatenate([right, symbols[row[has], at[has]]]))
            last = gone < width  # the last symbol has no pair, so no leaf
            rows, leaves = np.concatenate([row, prior_row, row[last]]), np.concatenate([at, prior, gone[last]])
            ranks = np.concatenate([ranks, np.full(len(rows) - len(ranks), NONE)])
            real = leaves < width
            self._set(tree, rows[real], leaves[real], ranks[real], width)
            row = row[tree[row, 1] != NONE]

    @staticmethod
    def _set(tree: np.ndarray, row: np.ndarray, at: np.ndarray, ranks: np.ndarray, width: int) -> None:
        """Point updates: leaves of rows, then the minima above them, a level at a time."""
        flat, first, node = tree.reshape(-1), row * (2 * width), at + width
        flat[first + node] = np.where(ranks == NONE, NONE, np.where(ranks == NONE, 0, ranks) * width + at)
        while width > 1:
            node >>= 1
            below = first + 2 * node
            flat[first + node] = np.minimum(flat[below], flat[below + 1])
            width >>= 1

    def merge_one(self, symbols: list[int]) -> list[int]:
        """The same for one long piece, with plain lists."""
        n = len(symbols) - 1
        width = 1 << max(n - 1, 0).bit_length()
        none, rank_of, made = 1 << 62, self.rank_of, self.made_list
        tree = [none] * (2 * width)
        for i in range(n):
            r = rank_of.get(symbols[i] << 32 | symbols[i + 1])
            if r is not None:
                tree[width + i] = r * width + i
        for k in range(width - 1, 0, -1):
            tree[k] = min(tree[2 * k], tree[2 * k + 1])
        after, before = list(range(1, n + 2)), list(range(-1, n))

        def put(i: int, j: int) -> None:
            r = rank_of.get(symbols[i] << 32 | symbols[j]) if j <= n and i != j else None
            k = width + i
            tree[k] = none if r is None else r * width + i
            k >>= 1
            while k:
                tree[k] = min(tree[2 * k], tree[2 * k + 1])
                k >>= 1

        while n > 0 and tree[1] != none:
            i = tree[1] % width
            symbols[i] = made[tree[1] // width]
            gone = after[i]
            symbols[gone] = -1
            after[i] = after[gone]
            if after[i] <= n:
                before[after[i]] = i
            if gone < width:
                put(gone, gone)
            put(i, after[i])
            if before[i] >= 0:
                put(before[i], i)
        return [s for s in symbols if s >= 0]

    def encode_pieces(self, pieces: list[str]) -> list[bytes]:
        """Ids of each piece, as 32-bit integers end to end."""
        raw = [p.encode() for p in pieces]
        out: list[bytes] = [b""] * len(raw)
        sizes = np.array([len(b) for b in raw])
        for width in sorted({1 << max(int(n) - 2, 0).bit_length() for n in np.unique(sizes[sizes > 1])} | {0}):
            mine = np.flatnonzero((sizes > width // 2 + 1) & (sizes <= width + 1)) if width > 1 else np.flatnonzero(sizes == width + 1)
            if width >= SINGLE_FROM:
                for i in mine.tolist():
                    out[i] = np.array(self.merge_one(self.first[np.frombuffer(raw[i], np.uint8)].tolist()), "<i4").tobytes()
                continue
            for a in range(0, len(mine), BATCH_ROWS):
                rows = mine[a : a + BATCH_ROWS]
                symbols = np.full((len(rows), width + 1), -1, np.int64)
                there = np.arange(width + 1) < sizes[rows][:, None]
                symbols[there] = self.first[np.frombuffer(b"".join(raw[i] for i in rows.tolist()), np.uint8)]
                if width:
                    self.merge_rows(symbols, width)
                left = symbols >= 0
                flat, ends = symbols[left].astype("<i4"), np.cumsum(left.sum(1))
                for i, b, e in zip(rows.tolist(), [0, *ends[:-1].tolist()], ends.tolist()):
                    out[i] = flat[b:e].tobytes()
        return out

    def recall(self, pieces: list[str]) -> list[bytes | None]:
        """Ids of those pieces that are remembered; what an older turn knew goes on into this one."""
        each = list(map(self.known.get, pieces))
        for i, ids in enumerate(each):
            if ids is None and (ids := self.older.get(pieces[i])) is not None:
                each[i] = self.known[pieces[i]] = ids
        return each

    def learn(self, new: list[str]) -> dict[str, bytes]:
        """Ids of new pieces of text, each cut by the pattern and merged; those that aren't too long are remembered."""
        several = {p: self.pattern.findall(p) for p in new if not one_word(p)}
        inner = list({p for c in several.values() for p in c})
        got = {p: ids for p, ids in zip(inner, self.recall(inner)) if ids is not None}
        unmet = list(dict.fromkeys(p for p in [*inner, *new] if p not in got and (p not in several or len(several[p]) == 1)))
        got.update(zip(unmet, self.encode_pieces(unmet)))
        got.update((p, b"".join([got[part] for part in c])) for p, c in several.items() if len(c) != 1)
        self.known.update((p, ids) for p, ids in got.items() if len(p) <= REMEMBERED_CHARS)
        return got

    def encode_column(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts end to end, and where each text's begin (one more at the end); null counts as empty."""
        column = pc.fill_null(column, "")
        if any(pc.any(pc.match_substring(column, s)).as_py() for s in self.special):
            split = [self.special_split.split(t) for t in column.to_pylist()]  # every other part is a special token
            ids, at = self._encode_plain(pa.array([p for parts in split for p in parts[::2]], pa.string()))
            out, size, k = [], [0], 0
            for parts in split:
                mine = []
                for j, p in enumerate(parts):
                    mine.append(np.array([self.special[p]], np.uint32) if j % 2 else ids[at[k + j // 2] : at[k + j // 2 + 1]])
                k += (len(parts) + 1) // 2
                out += mine
                size.append(size[-1] + sum(map(len, mine)))
            return np.concatenate(out), np.array(size)
        return self._encode_plain(column)

    def count_column(self, column: pa.Array) -> np.ndarray:
        """The number of ids of each text; null counts as empty."""
        column = pc.fill_null(column, "")
        if any(pc.any(pc.match_substring(column, s)).as_py() for s in self.special):
            return np.diff(self.encode_column(column)[1])
        return np.diff(lengths(*self._looked_up(column)))

    def _encode_plain(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        return spread(*self._looked_up(column))

    def _looked_up(self, column: pa.Array) -> tuple[list[bytes], np.ndarray, np.ndarray]:
        """Ids of the distinct pieces, which piece comes where, and where each text's pieces begin."""
        raw, ends = utf8(column)
        first = cut_places(raw, ends)
        names, numbers = distinct(raw, np.append(first, len(raw)))
        if len(self.known) > REMEMBERED:
            self.older, self.known = self.known, {}
        each = self.recall(names)
        new = self.learn([p for p, ids in zip(names, each) if ids is None])
        if new:
            each = [new[p] if ids is None else ids for p, ids in zip(names, each)]
        return each, numbers, np.searchsorted(first, ends)

    def encode_texts(self, texts: list[str]) -> list[bytes]:
        """Ids of each text, as 32-bit integers end to end."""
        ids, at = self.encode_column(pa.array(texts, pa.string()))
        return [ids[a:b].tobytes() for a, b in zip(at.tolist(), at[1:].tolist())]

    def decode_ids(self, ids: np.ndarray, ends: np.ndarray) -> pa.Array:
        """Texts of lists of ids (end to end; ends: where each begins, one more at the end); bytes that are no UTF-8 become U+FFFD. Unknown ids are no text."""
        ids = np.where((ids >= 0) & (ids < len(self.text)), ids, -1)
        sizes = np.where(ids >= 0, self.text_sizes[ids], 0)
        stops = np.concatenate([[0], np.cumsum(sizes)])
        pool = self.text_pool[np.repeat(self.text_starts[ids] - stops[:-1], sizes) + np.arange(stops[-1])].tobytes()
        cuts = stops[ends].tolist()
        return pa.array([pool[a:b].decode("utf-8", "replace") for a, b in zip(cuts, cuts[1:])], pa.string())


_loaded: dict[str, Vocabulary] = {}


def vocabulary(path: str) -> Vocabulary:
    """One copy per Python worker."""
    if path not in _loaded:
        _loaded[path] = Vocabulary(path)
    return _loaded[path]


def encode(docs: DataFrame, path: str, text_col: str = "text", ids_col: str = "ids") -> DataFrame:
    """docs with a column of token ids (array<int>), the text column dropped.

    path: the vocabulary's JSON file, at the same place on every executor. Special tokens in a text become their own
    ids, none is added. Null and empty texts give empty lists; repeated rows stay repeated; any length is taken whole; a
    column of docs that has the name ids_col is replaced. An empty table gives an empty one.
    """
    rest = [c for c in docs.columns if c not in (text_col, ids_col)]
    schema = docs.select(*[F.col(f"`{c}`") for c in rest], F.lit(None).cast("array<int>").alias(ids_col)).schema
    text = fresh(docs.drop(text_col), "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = vocabulary(path)
        for batch in batches:
            for part in slices(batch, text, PART_BYTES):
                ids, at = vocab.encode_column(part.column(part.num_columns - 1))
                lists = pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(ids.astype(np.int32)))
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], lists], [*rest, ids_col])
                pa.default_memory_pool().release_unused()

    return docs.select(*[F.col(f"`{c}`") for c in rest], F.col(f"`{text_col}`").cast("string").alias(text)).mapInArrow(run, schema)


def count(docs: DataFrame, path: str, text_col: str = "text", count_col: str = "n_tokens") -> DataFrame:
    """docs with the number of ids that encode() gives for each text, the text column dropped; no ids are put together or leave the worker."""
    rest = [c for c in docs.columns if c not in (text_col, count_col)]
    schema = docs.select(*[F.col(f"`{c}`") for c in rest], F.lit(None).cast("long").alias(count_col)).schema
    text = fresh(docs.drop(text_col), "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = vocabulary(path)
        for batch in batches:
            for part in slices(batch, text, PART_BYTES):
                n = vocab.count_column(part.column(part.num_columns - 1))
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(n.astype(np.int64))], [*rest, count_col])
                pa.default_memory_pool().release_unused()

    return docs.select(*[F.col(f"`{c}`") for c in rest], F.col(f"`{text_col}`").cast("string").alias(text)).mapInArrow(run, schema)


def decode(tokens: DataFrame, path: str, ids_col: str = "ids", text_col: str = "decoded") -> DataFrame:
    """tokens with a column of the text that the ids stand for, special tokens included; null ids give an empty text, unknown ids none."""
    rest = [c for c in tokens.columns if c != text_col]
    at = rest.index(ids_col)
    schema = tokens.select(*[F.col(f"`{c}`") for c in rest], F.lit("").alias(text_col)).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = vocabulary(path)
        for batch in batches:
            for first in range(0, batch.num_rows, 256):
                part = batch.slice(first, 256)
                lists = part.column(at)
                lengths = np.array([n or 0 for n in lists.value_lengths().to_pylist()], np.int64)
                ids = lists.flatten().to_numpy(zero_copy_only=False)
                ids = np.where(np.isnan(ids), -1, ids).astype(np.int64) if ids.dtype.kind == "f" else ids.astype(np.int64)
                yield pa.RecordBatch.from_arrays([*part.columns, vocab.decode_ids(ids, np.concatenate([[0], np.cumsum(lengths)]))], [*rest, text_col])

    return tokens.select(*[F.col(f"`{c}`") for c in rest]).mapInArrow(run, schema)
