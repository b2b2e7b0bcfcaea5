"""Quality classifier: a sparse ensemble of rules over text statistics.

Small trees are grown over a bounded sample of labelled rows; every path of a tree is a conjunctive rule. A logistic
model with an L1 penalty weighs the rules, most of which drop out. The rest are compiled into a Spark column over the
statistics, which one vectorised pass over the bytes of the texts works out.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barloom.llm.common import fresh, held_out, slices, utf8
from barloom.llm.textscan import words

#: Labelled rows that are learnt from at most: those of the smallest hashes of doc_id. Scoring covers all rows.
TRAIN_ROWS = 12_000


STATISTICS = ("words", "word_chars", "upper", "digits", "signs", "bars", "shouts", "stops", "distinct", "again", "line_words")
PART_BYTES = 1 << 20

_kind = np.zeros((6, 256), np.uint8)
_kind[0, 65:91] = 1  # upper case
_kind[1, 48:58] = 1  # digits
_kind[2, [b for b in range(33, 127) if not chr(b).isalnum() and chr(b) not in ".,"]] = 1  # signs
_kind[3, ord("|")] = _kind[4, ord("!")] = _kind[5, ord(".")] = 1


def statistics(raw: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A row of STATISTICS per text; shares of an empty text are 0, or 1 where they say how much is distinct."""
    each = lambda mask: np.diff(np.concatenate([[0], np.cumsum(mask, dtype=np.int64)])[ends]).astype(float)
    points = each((raw & 0xC0) != 0x80)
    chars = np.maximum(points, 1)
    upper, digits, signs, bars, shouts, stops = (each(_kind[k][raw]) for k in range(6))
    if len(raw) > 1:
        wide = np.zeros(len(raw), bool)  # Latin letters with marks, upper case
        wide[:-1] = (raw[:-1] == 0xC3) & (raw[1:] < 0x9F)
        upper += each(wide)
    w, _, _, at = words(raw, ends)
    n = np.diff(at).astype(float)
    again = np.zeros(len(w) + 1, np.int64)
    if len(w):
        same = np.concatenate([[False], w[1:] == w[:-1]])
        same[at[:-1][at[:-1] < len(w)]] = False  # a text's first word
        again[1:] = np.cumsum(same)
    again = np.diff(again[at]).astype(float)
    distinct = np.array([len(np.unique(w[a:b])) for a, b in zip(at[:-1].tolist(), at[1:].tolist())], float)
    m = np.maximum(n, 1)
    lines = 1 + each(raw == 10)
    return np.stack([n, points / m, upper / chars, digits / chars, signs / chars, bars / chars, shouts / chars, stops / chars, np.where(n > 0, distinct / m, 1), again / m, n / lines], 1)


def with_statistics(docs: DataFrame, into: str) -> DataFrame:
    """docs with a struct of STATISTICS of its column text; null counts as empty."""
    at = docs.columns.index("text")
    schema = docs.withColumn(into, F.struct(*[F.lit(0.0).alias(n) for n in STATISTICS])).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", PART_BYTES):
                x = statistics(*utf8(part.column(at)))
                stats = pa.StructArray.from_arrays([pa.array(np.ascontiguousarray(c)) for c in x.T], list(STATISTICS))
                yield pa.RecordBatch.from_arrays([*part.columns, stats], [*part.schema.names, into])

    return docs.mapInArrow(run, schema)


@dataclass
class Rule:
    """A conjunction of (statistic, whether it must exceed, bound) and its weight."""

    terms: tuple[tuple[str, bool, float], ...]
    weight: float = 0.0

    def holds(self, names: list[str], x: np.ndarray) -> np.ndarray:
        out = np.ones(len(x), bool)
        for name, above, bound in self.terms:
            v = x[:, names.index(name)]
            out &= v > bound if above else v <= bound
        return out


@dataclass
class Ensemble:
    bias: float
    rules: list[Rule]

    def score(self, stats: Column) -> Column:
        """The probability of label 1 from a struct of statistics."""
        total = F.lit(float(self.bias))
        for r in self.rules:
            held = F.lit(True)
            for name, above, bound in r.terms:
                held = held & (stats[name] > bound if above else stats[name] <= bound)
            total = total + F.when(held, float(r.weight)).otherwise(0.0)
        return 1 / (1 + F.exp(-total))


def grow_rules(names: list[str], x: np.ndarray, y: np.ndarray, trees: int = 30, depth: int = 3, seed: int = 7) -> list[Rule]:
    """Paths of trees over random halves of the rows and of the statistics."""
    rng, found = np.random.default_rng(seed), {}

    def split(rows: np.ndarray, terms: tuple, left: int, use: np.ndarray) -> None:
        if terms:
            found.setdefault(tuple(sorted(terms)), Rule(tuple(terms)))
        p = y[rows].mean()
        if left == 0 or len(rows) < 40 or p in (0, 1):
            return
        best = (0.0, None, None)
        for f in use:
            v = x[rows, f]
            for bound in np.unique(np.quantile(v, np.linspace(0.02, 0.98, 25))):
                low = v <= bound
                n = int(low.sum())
                if min(n, len(rows) - n) < 10:
                    continue
                a, b = y[rows][low].mean(), y[rows][~low].mean()
                gain = p * (1 - p) - (n * a * (1 - a) + (len(rows) - n) * b * (1 - b)) / len(rows)
                if gain > best[0]:
                    best = (gain, f, float(bound))
        if best[1] is None or best[0] < 1e-4:
            return
        low = x[rows, best[1]] <= best[2]
        for side, above in ((rows[low], False), (rows[~low], True)):
            split(side, (*terms, (names[best[1]], above, best[2])), left - 1, use)

    for _ in range(trees):
        rows = rng.choice(len(x), min(len(x), max(200, len(x) // 2)), replace=False)
        use = rng.choice(len(names), max(2, len(names) // 2), replace=False)
        split(rows, (), depth, use)
    return list(found.values())


def fit_weights(held: np.ndarray, y: np.ndarray, penalty: float = 1e-3, steps: int = 600) -> tuple[float, np.ndarray]:
    """Logistic weights under an L1 penalty, by accelerated proximal gradient."""
    n, k = held.shape
    a = np.hstack([np.ones((n, 1)), held])
    rate = 4 * n / max(np.linalg.norm(a, 2) ** 2, 1e-9)
    w = np.zeros(k + 1)
    w[0] = np.log((y.sum() + 1) / (n - y.sum() + 1))
    z, t = w.copy(), 1.0
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(a @ z, -30, 30)))
        new = z - rate * (a.T @ (p - y)) / n
        new[1:] = np.sign(new[1:]) * np.maximum(np.abs(new[1:]) - rate * penalty, 0)
        t2 = (1 + np.sqrt(1 + 4 * t * t)) / 2
        z, w, t = new + (t - 1) / t2 * (new - w), new, t2
    return float(w[0]), w[1:]


def fit(names: list[str], x: np.ndarray, y: np.ndarray) -> Ensemble:
    """Rules and weights; with no rows the score is one half everywhere, with one label its smoothed share."""
    if len(y) == 0 or y.min() == y.max():
        return Ensemble(float(np.log((y.sum() + 1) / (len(y) - y.sum() + 1))), [])
    rules = grow_rules(names, x, y)
    if not rules:
        return Ensemble(float(np.log((y.sum() + 1) / (len(y) - y.sum() + 1))), [])
    bias, weights = fit_weights(np.stack([r.holds(names, x) for r in rules], 1).astype(float), y)
    return Ensemble(bias, [Rule(r.terms, float(w)) for r, w in zip(rules, weights) if abs(w) > 1e-4])


def _sample(labels: DataFrame, label: str, train: Column, rows: int) -> DataFrame:
    """A bounded number of labelled ids, small enough to broadcast."""
    return labels.where(train & F.col("doc_id").isNotNull() & F.col(label).isNotNull()).select("doc_id", F.col(label).cast("int").alias("label")).orderBy(F.xxhash64("doc_id"), "doc_id", "label").limit(rows)


def one_per_label(rows: DataFrame) -> DataFrame:
    """Of rows (doc_id, label, text and others) that repeat a doc_id the one with the greatest text, so that labels bound what is learnt from."""
    rest = [c for c in rows.columns if c not in ("doc_id", "text")]
    return rows.groupBy("doc_id").agg(F.max(F.struct("text", *rest)).alias("row")).select("doc_id", "row.*")


def learn(docs: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS) -> Ensemble:
    """An ensemble from labels (doc_id, quality) whose crc32(doc_id) mod 5 is not 0; at most train_rows rows come to the driver, each a few numbers.

    Labels without doc_id or value don't count, nor do those of ids that docs lack; a doc_id that repeats counts once, with
    its greatest text. Without labels the score is one half. Other columns of both tables are ignored.
    """
    picked = _sample(labels, "quality", ~held_out(F.col("doc_id"), 5, 0), train_rows)
    rows = one_per_label(docs.select("doc_id", "text").join(F.broadcast(picked), "doc_id")).select("label", "text")
    data = with_statistics(rows, "stats").select("label", "stats.*").toPandas()
    data = data.iloc[np.lexsort(data.to_numpy().T)] if len(data) else data
    return fit(list(STATISTICS), data[list(STATISTICS)].to_numpy(float), data["label"].to_numpy(float))


def score_quality(docs: DataFrame, model: Ensemble, score_col: str = "score") -> DataFrame:
    """docs with the probability that its text has label 1. Every row stays; null and empty texts get the score of an empty text; texts count whole."""
    stats = fresh(docs, "stats")
    return with_statistics(docs, stats).withColumn(score_col, model.score(F.col(stats))).drop(stats)


def keep_good(docs: DataFrame, labels: DataFrame, least: float = 0.3) -> DataFrame:
    """The rows of docs whose score is at least `least`, with the columns of docs, whatever their names.

    Each row goes by its own text: null and empty ones by the score of an empty text, repeated rows stay or go together.
    An empty table gives an empty one.
    """
    score = fresh(docs, "quality_score")
    return score_quality(docs, learn(docs, labels), score).where(F.col(score) >= least).drop(score)
