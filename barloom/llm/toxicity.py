"""Toxicity classifier: a convolutional network over hashed words, trained by tasks on all labelled rows.

A word and its beginnings are hashed to rows of a table; its embedding is their sum, so a word that was never seen is
read by how it begins. Filters of several widths run over each text, each filter's greatest answer over the whole text
is kept, and a logistic unit weighs these. A filter is linear in the embeddings, so for scoring each row holds the
answers of all filters at all of their places: a text's score needs sums of rows only.

Training goes in rounds. In each, every task starts from the same networks, learns from its labelled rows in small batches
and hands on how far it moved each row of weights; the moves are averaged, block by block, over the tasks that made any.
What comes to the driver and is broadcast is the networks, whose size is fixed. Beside the network of all rows there is one
per fold that leaves the fold out; their scores of just these rows set the thresholds, so these too come from every row.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barloom.llm.common import cut, held_out, slices, utf8
from barloom.llm.textscan import heads, words

#: Bytes of the beginnings that are hashed beside the word.
HEADS = (4, 6)
#: Rows for words and as many for each length of beginnings; the last row stands for the end of a text.
BUCKETS = 1 << 14
END = BUCKETS * (1 + len(HEADS))
#: Width of an embedding, filter widths, filters of each.
DIM, WIDTHS, FILTERS = 16, (1, 2, 3), 6
ANSWERS = len(WIDTHS) * FILTERS
#: Weights besides embeddings, as rows of the same width: filters, biases, output weights, offset.
REST = sum(WIDTHS) * DIM * FILTERS + 2 * ANSWERS + 1
ROWS = END + 1 + -(-REST // DIM)
#: Rows of weights that are averaged together.
BLOCK = 4096
#: Passes over the labelled rows; folds by which thresholds are set.
EPOCHS, FOLDS = 5, 2
#: Labelled rows a task, and tasks at most; beyond that tasks get more rows, which they read batch by batch. Labelled rows a part of the shuffle.
TASK_ROWS, TASKS, PART_ROWS = 12_000, 64, 4_000
#: Texts of a step and their words at most (a longer text is a step of its own), and places that are looked at together.
BATCH, BATCH_WORDS, WINDOW = 64, 1 << 17, 1 << 16
#: Bits of the map of labelled ids, whatever their number: rows whose bit isn't set needn't be shuffled.
ID_BITS = 1 << 25
#: Steps of a unit of log odds to which scores are told apart for thresholds.
BINS = 100
#: The score at which the best F1 of rows that were not learnt from lies, whatever their language.
FLAG = 0.7
PART_BYTES = 1 << 18
_SIGNS = np.zeros(256, bool)
_SIGNS[[b for b in range(33, 127) if not chr(b).isalnum()]] = True


def word_rows(raw: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Table rows of the words of each text (a row of 1 + len(HEADS) each), signs taken as white space, and where each text's words begin (one more at the end)."""
    raw = np.where(_SIGNS[raw], np.uint8(32), raw)
    whole, first, last, at = words(raw, ends)
    rows = [(h >> np.uint64(40)).astype(np.int64) % BUCKETS + k * BUCKETS for k, h in enumerate([whole, *heads(raw, first, last, HEADS)])]
    return np.stack(rows, 1), at


def padded(rows: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Texts end to end, each followed by ends so that every filter fits at every word; a text without words is an end. And where each begins."""
    n = np.diff(at)
    room = np.maximum(n, 1) + max(WIDTHS) - 1
    starts = np.cumsum(room) - room
    out = np.full((int(room.sum()), 1 + len(HEADS)), END, np.int64)
    out[np.repeat(starts - at[:-1], n) + np.arange(len(rows))] = rows
    return out, starts


@dataclass
class Network:
    table: np.ndarray  # (END + 1, answers): per row the answers of filters at each place, by width
    bias: np.ndarray
    weights: np.ndarray
    offset: float

    def scores(self, rows: np.ndarray, at: np.ndarray) -> np.ndarray:
        """The probability of label 1 per text."""
        if len(at) < 2:
            return np.empty(0)
        seq, starts = padded(rows, at)
        got = self.table[seq[:, 0]]
        for k in range(1, 1 + len(HEADS)):
            got += self.table[seq[:, k]]
        tail = max(WIDTHS) - 1
        # An end beyond a text's last word gives no answer of its own.
        inside = np.zeros(len(seq), bool)
        lengths = np.maximum(np.diff(at), 1)
        inside[np.repeat(starts - np.cumsum(lengths) + lengths, lengths) + np.arange(lengths.sum())] = True
        pooled, slot = [], 0
        for width in WIDTHS:
            answer = got[: len(seq) - tail, slot : slot + FILTERS].copy()
            for k in range(1, width):
                answer += got[k : len(seq) - tail + k, slot + k * FILTERS : slot + (k + 1) * FILTERS]
            slot += width * FILTERS
            answer[~inside[: len(answer)]] = -np.inf
            pooled.append(np.maximum.reduceat(answer, starts, axis=0))
        z = np.maximum(np.hstack(pooled) + self.bias, 0) @ self.weights + self.offset
        return 1 / (1 + np.exp(-np.clip(z.astype(float), -30, 30)))


def parts(rest: np.ndarray) -> tuple[list[np.ndarray], np.ndarray, np.ndarray, np.ndarray]:
    """Filters by width, biases, output weights and offset, as views of the rows beyond the embeddings."""
    flat, at, filters = rest.reshape(-1), 0, []
    for w in WIDTHS:
        filters.append(flat[at : at + w * DIM * FILTERS].reshape(w, DIM, FILTERS))
        at += w * DIM * FILTERS
    return filters, flat[at : at + ANSWERS], flat[at + ANSWERS : at + 2 * ANSWERS], flat[REST - 1 : REST]


@dataclass
class Weights:
    """A network while it is learnt: a matrix of embeddings and, as further rows, all other weights; seen holds AdaGrad's sums of squares."""

    values: np.ndarray
    seen: np.ndarray
    both: bool  # whether rows of both labels are there to learn from

    def copy(self) -> Weights:
        return Weights(self.values.copy(), self.seen.copy(), self.both)

    def embedded(self, seq: np.ndarray) -> np.ndarray:
        out = self.values[seq[..., 0]]
        for k in range(1, 1 + len(HEADS)):
            out = out + self.values[seq[..., k]]
        return out

    def pool(self, seq: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Each filter's greatest answer over each text and its place; texts are looked at in windows, so that long ones don't need more room."""
        filters, tail = parts(self.values[END + 1 :])[0], max(WIDTHS) - 1
        pooled, where = np.full((len(starts), ANSWERS), -np.inf, np.float32), np.zeros((len(starts), ANSWERS), np.int64)
        each, stops = np.arange(ANSWERS), starts + lengths
        for a in range(0, len(seq) - tail, WINDOW):
            b = min(a + WINDOW, len(seq) - tail)
            e = np.ascontiguousarray(self.embedded(seq[a : b + tail]).T)
            answer = np.concatenate([sum(f[k].T @ e[:, k : b - a + k] for k in range(w)) for w, f in zip(WIDTHS, filters)])
            for r in range(int(np.searchsorted(stops, a, "right")), int(np.searchsorted(starts, b))):
                s, t = max(int(starts[r]), a) - a, min(int(stops[r]), b) - a
                if s < t:
                    best = s + answer[:, s:t].argmax(1)
                    got = answer[each, best]
                    more = got > pooled[r]
                    pooled[r, more], where[r, more] = got[more], a + best[more]
        return pooled, where

    def step(self, texts: list[np.ndarray], y: np.ndarray, rate: float) -> None:
        """One step down the slope of these texts."""
        lengths = np.array([len(t) for t in texts])
        seq, starts = padded(np.concatenate(texts), np.concatenate([[0], np.cumsum(lengths)]))
        pooled, where = self.pool(seq, starts, np.maximum(lengths, 1))
        filters, bias, out, offset = parts(self.values[END + 1 :])
        live = pooled + bias > 0
        act = np.where(live, pooled + bias, 0)
        p = 1 / (1 + np.exp(-np.clip(act @ out + offset, -30, 30)))
        g = ((p - y) / len(texts)).astype(np.float32)
        back = g[:, None] * out * live
        slopes = np.zeros((ROWS - END - 1, DIM), np.float32)
        of_filters, of_bias, of_out, of_offset = parts(slopes)
        of_out[:], of_bias[:], of_offset[:] = act.T @ g + 1e-4 * out, back.sum(0), g.sum()
        touched, pushed = [], []
        for j, (width, f) in enumerate(zip(WIDTHS, filters)):
            cols = slice(j * FILTERS, (j + 1) * FILTERS)
            for k in range(width):
                at = seq[where[:, cols] + k]
                of_filters[j][k] = np.einsum("bf,bfd->df", back[:, cols], self.embedded(at))
                touched.append(at.ravel())
                pushed.append(np.repeat((back[:, cols, None] * f[k].T[None]).reshape(-1, DIM), 1 + len(HEADS), 0))
        touched = np.concatenate(touched)
        order = np.argsort(touched, kind="stable")
        ids, first = np.unique(touched[order], return_index=True)
        grad = np.add.reduceat(np.concatenate(pushed)[order], first, axis=0)
        grad[ids == END] = 0
        self.seen[ids] += grad**2
        self.values[ids] -= rate * grad / np.sqrt(self.seen[ids])
        self.seen[END + 1 :] += slopes**2
        self.values[END + 1 :] -= rate * slopes / np.sqrt(self.seen[END + 1 :])

    def learn(self, texts: list[np.ndarray], y: np.ndarray, order: np.ndarray, rate: float) -> None:
        """Steps over texts as table rows, in the given order."""
        pick, room = [], BATCH_WORDS
        for i in order.tolist() if self.both else []:
            if pick and (len(pick) == BATCH or len(texts[i]) > room):
                self.step([texts[k] for k in pick], y[pick], rate)
                pick, room = [], BATCH_WORDS
            pick.append(i)
            room -= len(texts[i])
        if pick:
            self.step([texts[k] for k in pick], y[pick], rate)

    def network(self) -> Network:
        filters, bias, out, offset = parts(self.values[END + 1 :])
        table = np.hstack([self.values[: END + 1] @ f[k] for f, w in zip(filters, WIDTHS) for k in range(w)]).astype(np.float32)
        return Network(table, bias.copy(), out.copy(), float(offset[0]))


def counts(texts: list[np.ndarray], y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """How many texts hold each table row, and how many of those have label 1."""
    own = [np.unique(t) for t in texts]
    ids, of = np.concatenate([np.empty(0, np.int64), *own]).astype(np.int64), np.repeat(np.arange(len(own)), [len(o) for o in own])
    return np.bincount(ids, minlength=END + 1), np.bincount(ids, np.asarray(y, float)[of], END + 1).astype(np.int64)


def beginning(all_: np.ndarray, one: np.ndarray, n: int, n_one: int, seed: int = 5) -> Weights:
    """Weights before the first step, from counts over n texts; without both labels the score is the smoothed share of label 1.

    The first coordinate of a word starts from how much more often texts of label 1 hold it (shrunk where few do), which
    spares most of the search for the words that matter; all coordinates are then learnt.
    """
    rng = np.random.default_rng(seed)
    w = Weights(np.zeros((ROWS, DIM), np.float32), np.full((ROWS, DIM), 1e-3, np.float32), 0 < n_one < n)
    w.values[:END] = rng.normal(0, 0.03, (END + 1, DIM))[:END]
    filters, _, out, offset = parts(w.values[END + 1 :])
    for f in filters:
        f[:] = rng.normal(0, 0.4, f.shape)
    offset[:] = np.log((n_one + 1) / (n - n_one + 1))
    if w.both:
        odds = np.log((one + 1) / (n_one + 2)) - np.log((all_ - one + 1) / (n - n_one + 2))
        w.values[:END, 0] = (0.3 * odds * all_ / (all_ + 10))[:END]
        for f in filters:
            f[:, 0] = np.abs(f[:, 0])
        out[:] = np.abs(rng.normal(0, 0.3, ANSWERS))
    return w


def pace(epoch: int, rate: float = 0.05) -> float:
    return rate / (1 + 0.3 * epoch)


def train(texts: list[np.ndarray], y: np.ndarray, epochs: int = EPOCHS, seed: int = 5) -> Network:
    """A network from texts as table rows, by AdaGrad, as one task learns it."""
    w, rng = beginning(*counts(texts, y), len(y), int(y.sum()), seed), np.random.default_rng(seed)
    for epoch in range(epochs):
        w.learn(texts, y, rng.permutation(len(y)), pace(epoch))
    return w.network()


def calibrate(scores: np.ndarray, y: np.ndarray, lang: np.ndarray, least: int = 20, n: np.ndarray | None = None) -> dict[str | None, float]:
    """Per language the threshold of the best F1 on rows the network hasn't learnt from; None: for other languages, and for those with few rows.

    With n each score stands for so many rows, of which y have label 1.
    """
    n = np.ones(len(scores)) if n is None else n

    def best(s: np.ndarray, t: np.ndarray, n: np.ndarray) -> float:
        order = np.argsort(-s, kind="stable")
        hit = np.cumsum(t[order])
        f1 = 2 * hit / (np.cumsum(n[order]) + max(t.sum(), 1))
        k = int(np.argmax(f1))
        below = s[order][k + 1] if k + 1 < len(s) else 0.0
        return float((s[order][k] + below) / 2)

    if not len(y) or not y.sum():
        return {None: 0.7}
    out: dict[str | None, float] = {None: best(scores, y, n)}
    for name in sorted({x for x in lang if x is not None}):
        mine = lang == name
        if n[mine].sum() >= least and y[mine].sum() >= 3:
            out[name] = best(scores[mine], y[mine], n[mine])
    return out


def _bit(doc_id: Column) -> Column:
    return F.pmod(F.xxhash64(doc_id), F.lit(ID_BITS)) + 1


def labelled(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, lang, label, text) of every row of docs whose id has a label; a doc_id that repeats counts once, with its greatest text, and its greatest label.

    A map of fixed size of the labels' ids is broadcast, so that other rows mostly aren't shuffled; rows and labels then
    meet in one shuffle.
    """
    learnt = lambda df: df.where(~held_out(F.col("doc_id"), 3, 1) & F.col("doc_id").isNotNull()).withColumn("doc_id", F.col("doc_id").cast("long"))
    known = learnt(labels.where(F.col("toxic").isNotNull()).select("doc_id", F.col("toxic").cast("int").alias("label")))
    bits = known.select(_bit(F.col("doc_id")).alias("bit")).groupBy(F.bitmap_bucket_number("bit").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("bit")).alias("bits"))
    place = F.bitmap_bit_position(_bit(F.col("doc_id")))
    octet = F.conv(F.hex(F.substring(F.col("bits"), (place / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    is_set = octet.bitwiseAND(F.pow(F.lit(2), place % 8).cast("int")) > 0
    rows = learnt(docs.select("doc_id", "lang", F.col("text").cast("string").alias("text")))
    rows = rows.join(F.broadcast(bits), (F.bitmap_bucket_number(_bit(F.col("doc_id"))) == F.col("bucket")) & is_set, "left_semi")
    both = rows.select("doc_id", F.lit(None).cast("int").alias("label"), F.struct("text", "lang").alias("row"))
    both = both.unionByName(known.select("doc_id", "label", F.lit(None).cast(both.schema["row"].dataType).alias("row")))
    both = both.repartition(known.count() // PART_ROWS + 1, "doc_id").groupBy("doc_id").agg(F.max("label").alias("label"), F.max("row").alias("row"))
    return both.where(F.col("label").isNotNull() & F.col("row").isNotNull()).select("doc_id", "row.lang", "label", "row.text")


def hashed(rows: DataFrame) -> DataFrame:
    """(lang, label, fold, words) of labelled rows, words as table rows, six bytes a word, in an order by hashes of ids. Kept in scratch space.

    They come in a part per task that learns: each such task hands on networks, so their number goes by rows, whatever the
    number of partitions before.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", PART_BYTES):
                got, at = word_rows(*utf8(part.column(3)))
                packed = [got[a:b].astype("<u2").tobytes() for a, b in zip(at.tolist(), at[1:].tolist())]
                yield pa.RecordBatch.from_arrays([*part.columns[:3], pa.array(packed, pa.binary())], ["doc_id", "lang", "label", "words"])

    data = rows.mapInArrow(run, "doc_id long, lang string, label int, words binary").sortWithinPartitions(F.xxhash64("doc_id"), "doc_id")
    data = cut(data.select(F.xxhash64("doc_id").alias("hash"), "lang", "label", F.pmod(F.xxhash64("doc_id", F.lit(7)), F.lit(FOLDS)).cast("int").alias("fold"), "words"))
    return data.coalesce(min(TASKS, data.count() // TASK_ROWS + 1))


def _texts(batch: pa.RecordBatch) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """Texts as table rows, labels and folds."""
    texts = [np.frombuffer(w.as_buffer(), "<u2").reshape(-1, 1 + len(HEADS)) for w in batch.column("words")]
    return texts, batch.column("label").to_numpy(zero_copy_only=False).astype(np.float32), batch.column("fold").to_numpy(zero_copy_only=False)


def beginnings(data: DataFrame) -> list[Weights]:
    """Weights before the first round, one network without each fold and one of all rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((FOLDS, 2, END + 2), np.int64)
        for batch in batches:
            texts, y, fold = _texts(batch)
            for k in range(FOLDS):
                mine = np.flatnonzero(fold == k)
                for s, c, n in zip(sums[k], counts([texts[i] for i in mine], y[mine]), (len(mine), y[mine].sum())):
                    s[:-1] += c
                    s[-1] += int(n)
        yield pa.RecordBatch.from_pydict({"fold": pa.array(range(FOLDS), pa.int32()), "sums": pa.array([s.tobytes() for s in sums], pa.binary())})

    def add(got: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"fold": got["fold"][:1], "sums": [sum(np.frombuffer(s, np.int64) for s in got["sums"]).tobytes()]})

    held = np.zeros((FOLDS, 2, END + 2), np.int64)
    for r in data.mapInArrow(run, "fold int, sums binary").groupBy("fold").applyInPandas(add, "fold int, sums binary").collect():
        held[r["fold"]] = np.frombuffer(r["sums"], np.int64).reshape(2, -1)
    whole = held.sum(0)
    return [beginning(all_[:-1], one[:-1], int(all_[-1]), int(one[-1])) for all_, one in [*(whole - h for h in held), whole]]


def one_round(data: DataFrame, nets: list[Weights], epoch: int) -> list[Weights]:
    """The networks after each task learnt from its rows: a row of weights moves by the mean of its moves in those tasks that moved it."""
    shared = data.sparkSession.sparkContext.broadcast(nets)
    schema = "net int, block int, part int, ids binary, moves binary, seen binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        old, part = shared.value, TaskContext.get().partitionId()
        new, rng = [w.copy() for w in old], np.random.default_rng([epoch, part])
        for batch in batches:
            texts, y, fold = _texts(batch)
            for k, w in enumerate(new):
                w.learn(texts, y, rng.permutation(np.flatnonzero(fold != k)), pace(epoch))
        for k, (a, b) in enumerate(zip(old, new)):
            moved = np.flatnonzero((a.seen != b.seen).any(1))
            for ids in np.split(moved, np.searchsorted(moved, np.arange(BLOCK, ROWS, BLOCK))):
                if len(ids):
                    row = [[k], [int(ids[0]) // BLOCK], [part], [ids.tobytes()], [(b.values[ids] - a.values[ids]).tobytes()], [(b.seen[ids] - a.seen[ids]).tobytes()]]
                    yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(row, [pa.int32()] * 3 + [pa.binary()] * 3)], ["net", "block", "part", "ids", "moves", "seen"])

    def mean(got: pd.DataFrame) -> pd.DataFrame:
        base = int(got["block"].iloc[0]) * BLOCK
        n, sums = np.zeros(BLOCK, np.float32), np.zeros((2, BLOCK, DIM))
        for r in got.sort_values("part").itertuples():
            ids = np.frombuffer(r.ids, np.int64) - base
            n[ids] += 1
            for s, v in zip(sums, (r.moves, r.seen)):
                s[ids] += np.frombuffer(v, np.float32).reshape(-1, DIM)
        ids = np.flatnonzero(n)
        moves, seen = (sums[:, ids] / n[ids, None]).astype(np.float32)
        return pd.DataFrame({"net": got["net"][:1], "ids": [(ids + base).tobytes()], "moves": [moves.tobytes()], "seen": [seen.tobytes()]})

    done = data.mapInArrow(run, schema).groupBy("net", "block").applyInPandas(mean, "net int, ids binary, moves binary, seen binary").collect()
    shared.destroy()
    nets = [w.copy() for w in nets]
    for r in done:
        ids = np.frombuffer(r["ids"], np.int64)
        nets[r["net"]].values[ids] += np.frombuffer(r["moves"], np.float32).reshape(-1, DIM)
        nets[r["net"]].seen[ids] += np.frombuffer(r["seen"], np.float32).reshape(-1, DIM)
    return nets


def set_thresholds(data: DataFrame, nets: list[Network]) -> dict[str | None, float]:
    """Thresholds from the score of each labelled row by the network that left its fold out; what is grouped and collected is counts by score, not rows."""
    shared = data.sparkSession.sparkContext.broadcast(nets)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, y, fold = _texts(batch)
            score = np.array([shared.value[k].scores(t, np.array([0, len(t)]))[0] for k, t in zip(fold.tolist(), texts)])
            bins = np.floor(BINS * np.log(score / (1 - score))).astype(np.int32)
            yield pa.RecordBatch.from_arrays([batch.column("lang"), pa.array(bins), pa.array(y.astype(np.int32))], ["lang", "bin", "label"])

    def of(got: pd.DataFrame, lang: str | None) -> dict[str | None, float]:
        z = (got["bin"].to_numpy() + 0.5) / BINS
        return calibrate(1 / (1 + np.exp(-z)), got["ones"].to_numpy(), np.full(len(z), lang, object), n=got["n"].to_numpy())

    def by_lang(got: pd.DataFrame) -> pd.DataFrame:
        lang = got["lang"].iloc[0]
        return pd.DataFrame({"lang": [lang], "least": [of(got, lang).get(lang, np.nan)]})

    held = cut(data.mapInArrow(run, "lang string, bin int, label int").groupBy("lang", "bin").agg(F.count("*").alias("n"), F.sum("label").alias("ones")))
    out = of(held.groupBy("bin").agg(F.sum("n").alias("n"), F.sum("ones").alias("ones")).toPandas(), None)
    found = held.where(F.col("lang").isNotNull()).groupBy("lang").applyInPandas(by_lang, "lang string, least double")
    return out | {r["lang"]: r["least"] for r in found.where(F.col("least") > 0).where(~F.isnan("least")).collect()}


def learn(docs: DataFrame, labels: DataFrame, train_bytes: int | None = None) -> tuple[Network, dict[str | None, float]]:
    """A network and thresholds from all labels (doc_id, toxic) whose crc32(doc_id) mod 3 is not 1.

    The network's offset is moved so that FLAG is the threshold for all languages together. lang only picks the threshold,
    never the score. A doc_id that repeats counts once, with its greatest text. Rows don't come to the driver; who wants
    to learn from about train_bytes of words only (six bytes a word) may say so.
    """
    data = hashed(labelled(docs, labels))
    if train_bytes is not None:
        share = train_bytes / max(data.agg(F.sum(F.octet_length("words"))).first()[0] or 0, 1)
        data = data.where(F.pmod("hash", F.lit(1 << 30)) < min(share, 1.0) * (1 << 30))
    nets = beginnings(data)
    for epoch in range(EPOCHS):
        nets = one_round(data, nets, epoch)
    *folds, net = [w.network() for w in nets]
    thresholds = set_thresholds(data, folds)
    odds = lambda p: float(np.log(p / (1 - p)))
    move = odds(FLAG) - odds(np.clip(thresholds[None], 1e-6, 1 - 1e-6))
    net.offset += move
    return net, {name: float(1 / (1 + np.exp(-odds(np.clip(p, 1e-6, 1 - 1e-6)) - move))) for name, p in thresholds.items()}


def score_toxicity(docs: DataFrame, net: Network, thresholds: dict[str | None, float], text_col: str = "text", lang_col: str = "lang", score_col: str = "score", flag_col: str = "flagged") -> DataFrame:
    """docs with the probability that its text has label 1, and whether that reaches its language's threshold.

    Every row stays; null and empty texts get the score of a text without words; texts count whole. Columns of docs with
    the names of the new ones are replaced. An empty table gives an empty one.
    """
    docs = docs.drop(score_col, flag_col)
    at = docs.columns.index(text_col)
    langs = docs.columns.index(lang_col) if len(thresholds) > 1 else None
    shared = docs.sparkSession.sparkContext.broadcast((net, thresholds))
    schema = docs.withColumn(score_col, F.lit(0.0)).withColumn(flag_col, F.lit(True)).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net, least = shared.value
        for batch in batches:
            for part in slices(batch, text_col, PART_BYTES):
                score = net.scores(*word_rows(*utf8(part.column(at))))
                bound = least[None] if langs is None else np.array([least.get(x, least[None]) for x in part.column(langs).to_pylist()], float)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(score, pa.float64()), pa.array(score >= bound, pa.bool_())], [*part.schema.names, score_col, flag_col])

    return docs.mapInArrow(run, schema)
