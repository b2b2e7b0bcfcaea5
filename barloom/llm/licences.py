"""Licence scans: a positional index of licence templates, searched by each file's rarest licence words.

The templates are few, so their index (word -> template, position) goes to every task. Two passes read the texts: one
counts in how many documents each licence word occurs, one looks up the words.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.llm.common import slices, utf8
from barloom.llm.textscan import TERM_BYTES, words

#: Distinct licence words of a file that are looked up, the rarest first; those that a key phrase hangs on are looked up in any case.
PROBES = 24
#: Share of a template's weight that has to stand at its place.
SHARE = 0.6
#: Bytes of text worked on at once.
PART_BYTES = 4 << 20

# Phrases that count wherever they stand, and their labels.
BASE = (("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved"))
# Label, wording of the public notice, and the phrases without which it isn't that licence.
TEMPLATES = (
    ("apache-2.0", "licensed under the apache license version 2 0", ("apache license", "2 0")),
    ("apache-2.0", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at", ("apache license", "except in compliance with the license")),
    ("mit", "released under the mit license", ("mit license",)),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction", ("permission is hereby granted free of charge", "without restriction")),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", ("with or without fee is hereby granted",)),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", ("source and binary forms", "following conditions are met")),
    ("bsd", "released under the bsd license", ("bsd license",)),
    ("gpl-2.0", "licensed under the gnu general public license version 2", ("gnu general public license", "version 2")),
    ("gpl-3.0", "licensed under the gnu general public license version 3", ("gnu general public license", "version 3")),
    ("gpl-2.0", "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version", ("gnu general public license", "either version 2")),
    ("gpl-3.0", "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version", ("gnu general public license", "either version 3")),
    ("lgpl", "licensed under the gnu lesser general public license", ("lesser general public license",)),
    ("agpl", "licensed under the gnu affero general public license", ("affero general public license",)),
    ("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2 0", ("mozilla public license",)),
    ("cc-by-4.0", "licensed under cc by 4 0", ("cc by 4 0",)),
    ("cc-by-sa-4.0", "licensed under cc by sa 4 0", ("cc by sa",)),
    ("cc-by-nc-4.0", "licensed under cc by nc 4 0", ("cc by nc",)),
    ("cc-by-nd-4.0", "licensed under cc by nd 4 0", ("cc by nd",)),
    ("cc-by-4.0", "this work is licensed under a creative commons attribution 4 0 international license", ("creative commons attribution 4 0",)),
    ("cc-by-sa-4.0", "this work is licensed under a creative commons attribution sharealike 4 0 international license", ("creative commons attribution sharealike",)),
    ("cc0", "dedicated to the public domain under the creative commons cc0 1 0 universal public domain dedication", ("cc0 1 0",)),
    ("unlicense", "this is free and unencumbered software released into the public domain", ("free and unencumbered software",)),
)

_PLACE = pa.struct([("label", pa.string()), ("first", pa.int64()), ("end", pa.int64()), ("score", pa.float64()), ("base", pa.bool_())])
PLACES = "places array<struct<label string, first bigint, end bigint, score double, base boolean>>"


class _Index:
    """Postings of all templates; base phrases are templates that are their own key phrase."""

    def __init__(self) -> None:
        self.templates = [(label, text.split(), [p.split() for p in keys], False) for label, text, keys in TEMPLATES]
        self.templates += [(label, text.split(), [text.split()], True) for text, label in BASE]
        self.vocabulary = sorted({w for _, text, keys, _ in self.templates for part in (text, *keys) for w in part})
        self.number = {w: i for i, w in enumerate(self.vocabulary)}
        raw, ends = utf8(pa.array(self.vocabulary))
        hashes = words(raw, ends, TERM_BYTES)[0]
        order = np.argsort(hashes)
        self.hashes, self.ids = hashes[order], order

    def weigh(self, documents: int, df: dict[int, int]) -> None:
        """Weights of words by the documents that hold them, and what follows from these."""
        self.idf = np.array([math.log((2 * documents + 2) / (2 * df.get(i, 0) + 1)) for i in range(len(self.vocabulary))])
        self.text = [np.array([self.number[w] for w in text]) for _, text, _, _ in self.templates]
        self.weight = [float(self.idf[t].sum()) for t in self.text]
        self.postings: dict[int, list[tuple[int, int]]] = {}
        for t, ids in enumerate(self.text):
            for q, i in enumerate(ids.tolist()):
                self.postings.setdefault(i, []).append((t, q))
        # Each key phrase hangs on its rarest word: where that isn't, the phrase isn't.
        phrases = sorted({tuple(p) for _, _, keys, _ in self.templates for p in keys})
        self.phrases = [np.array([self.number[w] for w in p]) for p in phrases]
        self.rarest = [int(np.argmax(self.idf[p])) for p in self.phrases]
        self.keys = [[phrases.index(tuple(p)) for p in keys] for _, _, keys, _ in self.templates]
        self.anchors = np.unique([int(p[r]) for p, r in zip(self.phrases, self.rarest)])

    def lookup(self, w: np.ndarray) -> np.ndarray:
        """The licence word of each hash, -1 for others."""
        at = np.minimum(np.searchsorted(self.hashes, w), len(self.hashes) - 1)
        return np.where(self.hashes[at] == w, self.ids[at], -1)


def document_counts(docs: DataFrame) -> tuple[int, dict[int, int]]:
    """How many rows there are and how many hold each licence word; a number for each of the templates' words comes to the driver."""
    index = _Index()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(index.vocabulary) + 1, np.int64)
        for batch in batches:
            for part in slices(batch, "text", PART_BYTES):
                raw, ends = utf8(part.column(0))
                w, _, _, at = words(raw, ends, TERM_BYTES)
                ids = index.lookup(w)
                here = np.flatnonzero(ids >= 0)
                doc = np.searchsorted(at, here, "right") - 1
                seen = np.unique(doc * len(index.vocabulary) + ids[here]) % len(index.vocabulary)
                total[:-1] += np.bincount(seen, minlength=len(index.vocabulary))
                total[-1] += part.num_rows
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total))), pa.array(total)], ["word", "n"])

    counts = {r["word"]: r["n"] for r in docs.select("text").mapInArrow(run, "word long, n long").groupBy("word").agg(F.sum("n").alias("n")).collect()}
    return counts.pop(len(index.vocabulary), 0), {k: v for k, v in counts.items() if v}


def _of_file(index: _Index, ids: np.ndarray, found: dict[int, np.ndarray]) -> list[tuple[str, int, int, float, bool]]:
    """Places of templates in one file: ids, its licence words (-1: others); found, where each key phrase begins."""
    there = np.unique(ids[ids >= 0])
    ranked = there[np.argsort(-index.idf[there], kind="stable")]
    probes = {*ranked[:PROBES].tolist(), *np.intersect1d(there, index.anchors).tolist()}
    starts: dict[int, list[np.ndarray]] = {}
    for word in probes:
        at = None
        for t, q in index.postings.get(word, ()):
            if any(k not in found for k in index.keys[t]):
                continue
            at = np.flatnonzero(ids == word) if at is None else at
            starts.setdefault(t, []).append(at - q)
    out = []
    for t, parts in starts.items():
        label, _, _, base = index.templates[t]
        text, size = index.text[t], len(index.text[t])
        if base:  # the phrase itself: wherever its rarest word has the others at their places
            out += [(label, int(s), int(s) + size, 1.0, True) for s in np.intersect1d(np.concatenate(parts), found[index.keys[t][0]])]
            continue
        slack = size // 8
        # Starts that lie close together are one place, with words put in or left out.
        groups: list[list[int]] = []
        for at in np.unique(np.concatenate(parts)).tolist():
            if groups and at - groups[-1][1] <= slack and at - groups[-1][0] <= size:
                groups[-1][1] = at
            else:
                groups.append([at, at])
        for a, b in groups:
            first, end = max(0, a), min(len(ids), b + size)
            inside = True
            for k in index.keys[t]:
                i = np.searchsorted(found[k], max(0, first - slack))
                inside = inside and i < len(found[k]) and found[k][i] + len(index.phrases[k]) <= end + slack
            if not inside:
                continue
            share = float(index.idf[text[np.isin(text, ids[first:end])]].sum()) / index.weight[t] if index.weight[t] > 0 else 1.0
            if share >= SHARE:
                mine = first + np.flatnonzero(np.isin(ids[first:end], text))
                first, end = int(mine[0]), int(mine[-1]) + 1
                out.append((label, first, end, min(1.0, share), False))
    return sorted(out, key=lambda p: (p[1], p[2], p[0], p[4]))


def scan_licences(docs: DataFrame) -> DataFrame:
    """(doc_id, n_words, places) per row of docs (doc_id, text): each place a label, its first word, the end, a score and whether it is a base phrase.

    Words are runs of digits, letters and whatever lies beyond ASCII, A-Z as a-z; a null text is empty. Base phrases are
    found wherever they stand. Another template has a place where its words stand at their relative positions, up to an
    eighth of its length apart, all of its key phrases are there and SHARE of its weight is; score is that share. Rows
    that repeat stay, other columns don't; a null doc_id stays null; an empty table gives an empty one.
    """
    index = _Index()
    index.weigh(*document_counts(docs))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        marked = np.zeros(len(index.vocabulary) + 1, bool)
        marked[index.anchors] = True
        for batch in batches:
            for part in slices(batch, "text", PART_BYTES):
                raw, ends = utf8(part.column(1))
                w, _, _, at = words(raw, ends, TERM_BYTES)
                ids = index.lookup(w)
                hits = np.flatnonzero(marked[ids])
                doc = np.searchsorted(at, hits, "right") - 1
                # Key phrases of the whole part at once, each from its rarest word.
                begins: list[np.ndarray] = []
                for phrase, r in zip(index.phrases, index.rarest):
                    mine = ids[hits] == phrase[r]
                    s, d = hits[mine] - r, doc[mine]
                    fits = (s >= at[d]) & (s + len(phrase) <= at[d + 1])
                    s = s[fits]
                    for j, word in enumerate(phrase.tolist()):
                        s = s[ids[s + j] == word]
                    begins.append(s)
                places: list[list] = [[] for _ in range(part.num_rows)]
                for d in np.unique(np.searchsorted(at, np.concatenate(begins), "right") - 1).tolist():
                    a, b = int(at[d]), int(at[d + 1])
                    found = {k: s[x:y] - a for k, s in enumerate(begins) for x, y in [np.searchsorted(s, (a, b))] if y > x}
                    places[d] = [dict(zip(("label", "first", "end", "score", "base"), p)) for p in _of_file(index, ids[a:b], found)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(np.diff(at)), pa.array(places, pa.list_(_PLACE))], ["doc_id", "n_words", "places"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, f"doc_id long, n_words long, {PLACES}")
