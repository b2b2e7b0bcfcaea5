"""Licence scans against a plain reading of every text."""

import random
import re

from barloom.llm.licences import BASE, scan_licences
from barloom.llm.queries import op13_licence_scan
from tests.llm import cases

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
UPPER = {c: c + 32 for c in range(65, 91)}


def plain(text):
    """(n_words, starts of all base phrases, their labels) read word by word."""
    words = WORD.findall((text or "").translate(UPPER))
    hits = [(i, label) for phrase, label in BASE for i in range(len(words)) if words[i : i + len(phrase.split())] == phrase.split()]
    return len(words), sorted(i for i, _ in hits), sorted({label for _, label in hits})


def texts():
    r = random.Random(5)
    filler = ["all", "rights", "by", "general", "license", "cc", "été", "x9", "public", "reserved", "version", "2", "the"]
    out = [None, "", " -- ", "All rights reserved.", "ALL-RIGHTS_reserved", "cc by", "CC BY-NC 4.0", "ccby cc  by\ncc by", "General Public License", "rights reserved all", "cc", "éall rights reserved", "all rights Reserveḍ"]
    out += [" ".join(r.choice(filler) for _ in range(r.randint(1, 60))) for _ in range(150)]
    out.append("cc by " * 30_000 + "all rights reserved")
    return out


def test_query_finds_every_base_phrase(spark, tmp_path):
    rows = [(i, t, "en", "s", 0) for i, t in enumerate(texts())] + [(None, "cc by", "en", "s", 0), (3, "All rights reserved.", "en", "s", 0)]
    cases.frame(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted((r["doc_id"] if r["doc_id"] is not None else -1, r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) for r in op13_licence_scan(spark, str(tmp_path)).collect())
    want = []
    for i, t, *_ in rows:
        n, starts, labels = plain(t)
        want.append((-1 if i is None else i, n, len(starts), starts[0] if starts else None, starts[-1] if starts else None, ",".join(labels)))
    key = lambda x: tuple(-1 if v is None else v for v in x)
    assert sorted(got, key=key) == sorted(want, key=key)


def test_labels(spark):
    said = {
        1: ("Licensed under the Apache License, Version 2.0.", {"apache-2.0"}),
        2: ("Released under the MIT License.", {"mit"}),
        3: ("This work is licensed under the GNU General Public License, version 3.", {"gpl", "gpl-3.0"}),
        4: ("Licensed under CC BY-NC 4.0.", {"cc-by", "cc-by-nc-4.0"}),
        5: ("All rights reserved.", {"reserved"}),
        6: ("Permission is hereby granted, free of charge, to any person obtaining a copy of this fine software and its associated documentation files (the Software), to deal in the Software without restriction", {"mit"}),
        7: ("She would license the song under version 2 of the public plan; the apache helicopter flew by", set()),
        8: ("no licence at all", set()),
        9: ("Licensed under the GNU General Public License, version 2", {"gpl", "gpl-2.0"}),
        10: ("", set()),
    }
    pad = " ".join(f"word{i}" for i in range(300))
    rows = [(i, f"{pad} {t} {pad}" if t else t, "en", "s", 0) for i, (t, _) in said.items()]
    got = {r["doc_id"]: r for r in scan_licences(cases.frame(spark, rows)).collect()}
    assert {i: {p["label"] for p in r["places"]} for i, r in got.items()} == {i: labels for i, (_, labels) in said.items()}
    assert all(300 <= p["first"] and p["end"] <= 300 + len(WORD.findall(said[i][0])) + 3 and 0 < p["score"] <= 1 for i, r in got.items() for p in r["places"])


def test_empty(spark, tmp_path):
    cases.empty(spark).write.parquet(f"{tmp_path}/documents.parquet")
    assert op13_licence_scan(spark, str(tmp_path)).collect() == []
