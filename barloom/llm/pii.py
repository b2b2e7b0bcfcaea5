"""Personal data in texts, also where it is disguised, with spans in the text as it stands.

Plain patterns give the base spans. Then small transducers rewrite what disguises an identifier (look-alike letters and
invisible characters, spelled digits, words or brackets for "@" and "."), keeping for each character of the rewritten
text the span of the source it comes from; the same patterns run over the rewritten text and what they find is mapped
back.
"""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_left
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.llm.common import fresh, slices

KINDS = ("email", "ip", "card", "phone")
SPANS = "array<struct<kind:string,start:long,end:long,base:boolean>>"
PART_BYTES = 1 << 22

_LOCAL = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_DIGIT = re.compile(r"[0-9]")
# A match of four numbers can't begin inside a run of digits, so a run is tried once.
_IP = re.compile(r"(?<![0-9])([0-9]++)\.([0-9]++)\.([0-9]++)\.([0-9]++)")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def _luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        n = ord(d) - 48
        if k % 2:
            n = n * 2 - 9 if n > 4 else n * 2
        total += n
    return total % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    last, at = 0, text.find("@")
    while at >= 0:
        domain = _DOMAIN.match(text, at + 1)
        if domain:
            start = at
            while start > last and text[start - 1] in _LOCAL:
                start -= 1
            if start < at:
                last = domain.end()
                yield start, last
                at = text.find("@", last)
                continue
        at = text.find("@", at + 1)


def plain_spans(text: str) -> list[tuple[str, int, int]]:
    """Spans that the plain patterns find, by start, then kind."""
    out = [("email", a, b) for a, b in _emails(text)]
    first = _DIGIT.search(text)
    if first:
        for m in _IP.finditer(text, first.start()):
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m.groups()):
                out.append(("ip", *m.span()))
        for m in _CARD.finditer(text, first.start()):
            digits = m[0].replace(" ", "").replace("-", "")
            if 14 <= len(digits) <= 19 and _luhn(digits):
                out.append(("card", *m.span()))
        if "+" in text:
            for m in _PHONE.finditer(text):
                if 10 <= sum(c.isdigit() for c in m[0]) <= 15:
                    out.append(("phone", *m.span()))
    return sorted(out, key=lambda s: (s[1], KINDS.index(s[0])))


# Letters of other scripts that look like Latin ones.
_LOOK_ALIKES = dict(
    zip(
        "аеорсухіјѕһԁԛԝвкмнтАВЕКМНОРСТУХІЈЅαεικνορτυχΑΒΕΖΗΙΚΜΝΟΡΤΥΧ",
        "aeopcyxijshdqwbkmhtABEKMHOPCTYXIJSaeiknoptuxABEZHIKMNOPTYX",
    )
)
# Digits as words in the four languages.
_SPELLED = {
    "zero": "0", "oh": "0", "one": "1", "two": "2", "three": "3", "four": "4", "five": "5", "six": "6", "seven": "7", "eight": "8", "nine": "9",
    "null": "0", "eins": "1", "zwei": "2", "zwo": "2", "drei": "3", "vier": "4", "fünf": "5", "sechs": "6", "sieben": "7", "acht": "8", "neun": "9",
    "zéro": "0", "un": "1", "deux": "2", "trois": "3", "quatre": "4", "cinq": "5", "sept": "7", "huit": "8", "neuf": "9",
    "cero": "0", "uno": "1", "dos": "2", "tres": "3", "cuatro": "4", "cinco": "5", "seis": "6", "siete": "7", "ocho": "8", "nueve": "9",
}
_AT = r"(?:at|arroba|arobase|klammeraffe)"
_DOT = r"(?:dot|punkt|punto|point)"
_digit_word = "(?:" + "|".join(sorted(_SPELLED, key=len, reverse=True)) + ")"
_figure = f"(?:{_digit_word}|[0-9]++)"
#: Runs of at least four spelled digits or figures, with what may stand between and before them.
_RUN = re.compile(rf"(?i)\b(?=\w)(?:plus[\s-]++)?{_figure}(?:[\s,-]++(?:{_DOT}[\s,-]++)?{_figure}){{3,}}(?!\w)")
_RUN_PART = re.compile(r"(?i)plus|" + _DOT + "|" + _digit_word + "|[0-9]+")
#: Signs written as character references.
_REFERENCE = re.compile(r"(?i)&(?:#(?:0*([0-9]{1,3})|x0*([0-9a-f]{1,2}));|(commat|period|plus);)")
_BRACKETED = re.compile(rf"(?i)[\[({{<]\s*+({_AT}|{_DOT}|@|\.|a)\s*+[\])}}>]")
#: An address in words: name (of five parts at most) at host dot domain; host and domain may use real dots too.
_IN_WORDS = re.compile(rf"(?i)(?<![\w.%+-])[A-Za-z0-9._%+-]+(?:(?:\s++|_){_DOT}(?:\s++|_)[A-Za-z0-9._%+-]+){{0,4}}((?:\s++|_){_AT}(?:\s++|_)|\s*+@\s*+)[A-Za-z0-9-]+(?:(?:\s++|_){_DOT}(?:\s++|_)[A-Za-z0-9-]+|\s++\.\s++[A-Za-z0-9-]+|\.[A-Za-z0-9-]+)+(?!\w)")
_WORDS_PART = re.compile(rf"(?i)(?:\s+|_)(?:({_AT})|{_DOT})(?:\s+|_)|\s*(@)\s*|\s+\.\s+")
_SPACED_NUMBERS = re.compile(rf"(?i)(?<![\w.])[0-9]{{1,3}}(?:\s+{_DOT}\s+[0-9]{{1,3}}){{3}}(?![\w.])")
_SPACED_DOT = re.compile(rf"(?i)\s+{_DOT}\s+")
#: What _plain_letters looks at: all but Latin letters and those punctuation marks that no normal form makes ASCII signs of.
_OTHER_SCRIPT = re.compile(r"[^\x00-\u024f\u2016-\u2023\u2027\u2030-\u205e]|[\xa0\xad\xb2\xb3\xb9]")
#: Format characters: marks of direction, joiners, soft hyphens and the like.
_INVISIBLE = frozenset(c for c in map(chr, [*range(0xD800), *range(0xE000, 0x10000)]) if unicodedata.category(c) == "Cf")
#: Each match of _BRACKETED, _IN_WORDS and _SPACED_NUMBERS holds a match of this or an "@".
_MAY_HIDE = re.compile(rf"(?i)[\[({{<]\s*(?:{_AT}|{_DOT}|\.|a)\s*[\])}}>]|[\s_](?:{_AT}|{_DOT})[\s_]")


def _columnar(pattern: str) -> str:
    """A pattern for Arrow's search, which finds at least what Python's finds: white space of all kinds, and the dotless and dotted i that Python takes for one where case is ignored."""
    pattern = pattern.replace(r"\s", r"[\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]")
    return "(?i)" + re.sub(r"(?<!\(\?)i", "[iıİ]", pattern)


#: Texts without a match hold no plain span; those without a match of _HIDDEN have nothing to rewrite, or no rewrite that shows a span.
_PLAIN = r"@|[0-9]\.[0-9]+\.[0-9]+\.[0-9]|(?:[0-9][ -]?){13}[0-9]|\+[0-9][ ().0-9-]+[0-9]"
_HIDDEN = "|".join(
    [
        r"[^\x00-\x{24f}\x{2016}-\x{2023}\x{2027}\x{2030}-\x{205e}]|[\x{a0}\x{ad}\x{b2}\x{b3}\x{b9}]",  # as _OTHER_SCRIPT
        r"(?i)&(?:#|commat;|period;|plus;)",  # _REFERENCE
        _columnar(rf"(?:{_digit_word}|[0-9])(?:(?:\s|[,-])+(?:{_DOT}(?:\s|[,-])+)?(?:{_digit_word}|[0-9]+)){{3}}"),  # _RUN
        _columnar(rf"[\[({{<]\s*(?:{_AT}|{_DOT}|@|\.|a)\s*[\])}}>]"),  # _BRACKETED
        _columnar(rf"[A-Za-z0-9._%+-](?:(?:\s+|_){_AT}(?:\s+|_)|\s*@\s*)[A-Za-z0-9-]+(?:(?:\s+|_){_DOT}(?:\s+|_)|\s*\.\s*)[A-Za-z0-9-]"),  # _IN_WORDS
        _columnar(rf"[0-9](?:\s+{_DOT}\s+[0-9]{{1,3}}){{3}}"),  # _SPACED_NUMBERS
    ]
)


def gates(column: pa.Array) -> tuple[list[bool], list[bool]]:
    """Per text whether it may hold plain spans, and whether it may hold disguised ones; each is a search in linear time."""
    column = pc.fill_null(column, "")
    return pc.match_substring_regex(column, _PLAIN).to_pylist(), pc.match_substring_regex(column, _HIDDEN).to_pylist()


class _View:
    """A rewritten text, and the source span of each of its characters."""

    def __init__(self, text: str):
        self.text, self.start, self.end = text, None, None

    def spans(self) -> tuple[list[int], list[int]]:
        if self.start is None:
            self.start, self.end = list(range(len(self.text))), list(range(1, len(self.text) + 1))
        return self.start, self.end

    def rewrite(self, edits: list[tuple[int, int, str]]) -> None:
        """edits: (start, end, instead) in order, apart from each other; every new character stands for the whole of its span."""
        if not edits:
            return
        start, end = self.spans()
        parts, new_start, new_end, last = [], [], [], 0
        for a, b, instead in [*edits, (len(self.text), len(self.text), "")]:
            parts += [self.text[last:a], instead]
            new_start += start[last:a] + [start[a] if a < b else 0] * len(instead)
            new_end += end[last:a] + [end[b - 1] if a < b else 0] * len(instead)
            last = b
        self.text, self.start, self.end = "".join(parts), new_start, new_end


def _plain_letters(text: str) -> list[tuple[int, int, str]]:
    """Look-alikes as the letters they look like, digits, blanks and dashes of all kinds as those of ASCII, compatibility forms as what they stand for; format characters go."""
    edits = []
    for m in _OTHER_SCRIPT.finditer(text):
        c = m[0]
        sort = unicodedata.category(c)
        if c in _INVISIBLE:
            edits.append((m.start(), m.end(), ""))
            continue
        digit = unicodedata.digit(c, None)
        if digit is not None:
            plain = str(digit)
        elif sort in ("Zs", "Pd") or c == "\u2212":
            plain = " " if sort == "Zs" else "-"
        else:
            plain = _LOOK_ALIKES.get(c) or unicodedata.normalize("NFKC", c)
        if plain != c and plain.isascii() and (plain.strip() or sort == "Zs"):
            edits.append((m.start(), m.end(), plain))
    return edits


def _references(text: str) -> list[tuple[int, int, str]]:
    """Character references to printable ASCII."""
    edits = []
    for m in _REFERENCE.finditer(text):
        sign = {"commat": "@", "period": ".", "plus": "+"}[m[3].lower()] if m[3] else chr(int(m[1]) if m[1] else int(m[2], 16))
        if "\x20" <= sign <= "\x7e":
            edits.append((*m.span(), sign))
    return edits


def _digits(text: str) -> list[tuple[int, int, str]]:
    """Runs that hold a spelled digit, without what parts them."""
    edits = []
    for run in _RUN.finditer(text):
        found = list(_RUN_PART.finditer(text, *run.span()))
        if not any(m[0].lower() in _SPELLED for m in found):
            continue
        for k, m in enumerate(found):
            word = m[0].lower()
            to = found[k + 1].start() if k + 1 < len(found) else m.end()
            edits.append((m.start(), to, "+" if word == "plus" else _SPELLED.get(word, word if word.isdigit() else ".")))
    return edits


def _signs(text: str) -> list[tuple[int, int, str]]:
    """Bracketed signs, with the white space on both sides of the brackets."""
    edits, last = [], 0
    for m in _BRACKETED.finditer(text):
        a, b = m.span()
        while a > last and text[a - 1].isspace():
            a -= 1
        while b < len(text) and text[b].isspace():
            b += 1
        edits.append((a, b, "@" if m[1].lower() in ("@", "a") or re.fullmatch(_AT, m[1], re.I) else "."))
        last = b
    return edits


def _in_words(text: str) -> list[tuple[int, int, str]]:
    edits = []
    for m in _IN_WORDS.finditer(text):
        name, sign = text[m.start() : m.start(1)], m[1].strip(" _\t\n")
        if sign.isalpha() and "at" == sign.lower() and not re.search(rf"(?i)(?:\s|_){_DOT}(?:\s|_)", m[0]) and not re.search(r"[0-9._%+-]", name):
            continue  # "look at example.com"
        edits += [(*p.span(), "@" if p[1] or p[2] else ".") for p in _WORDS_PART.finditer(text, *m.span())]
    for m in _SPACED_NUMBERS.finditer(text):
        edits += [(*p.span(), ".") for p in _SPACED_DOT.finditer(text, *m.span())]
    return sorted(edits)


def disguised_spans(text: str, plain: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
    """Spans that only the rewritten text shows; none touches a plain one or another of its kind."""
    view = _View(text)
    if not text.isascii() and _OTHER_SCRIPT.search(text):
        view.rewrite(_plain_letters(view.text))
    if "&" in text:
        view.rewrite(_references(view.text))
    view.rewrite(_digits(view.text))
    if "@" in view.text or _MAY_HIDE.search(view.text):
        view.rewrite(_signs(view.text))
        view.rewrite(_in_words(view.text))
    if view.start is None:
        return []
    starts, reach = [a for _, a, _ in plain], list(accumulate((b for *_, b in plain), max))
    out, last = [], dict.fromkeys(KINDS, 0)
    for kind, a, b in plain_spans(view.text):  # in order, so only the last one of a kind can meet the next
        start, end = view.start[a], view.end[b - 1]
        before = bisect_left(starts, end)
        if text[start:end] != view.text[a:b] and start >= last[kind] and not (before and reach[before - 1] > start):
            out.append((kind, start, end))
            last[kind] = end
    return out


def all_spans(column: pa.Array) -> Iterator[tuple[int, str, list[tuple[str, int, int, bool]]]]:
    """(place, text, spans by start, then kind) of those texts of a column that have any."""
    plain_may, hidden_may = gates(column)
    places = [i for i, (p, h) in enumerate(zip(plain_may, hidden_may)) if p or h]
    for i, text in zip(places, column.take(pa.array(places, pa.int64())).to_pylist()):
        plain = plain_spans(text) if plain_may[i] else []
        more = disguised_spans(text, plain) if hidden_may[i] else []
        if plain or more:
            yield i, text, sorted([(*s, True) for s in plain] + [(*s, False) for s in more], key=lambda s: (s[1], KINDS.index(s[0])))


def find_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, spans) per row of docs; spans: kind, start and end (code points, end exclusive), and whether plain patterns find it, by start, then kind.

    Null and empty texts have no spans; repeated rows each give a row; texts of any length are searched whole; other
    columns are ignored. An empty table gives an empty one. Plain spans are leftmost and apart from each other per kind.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", PART_BYTES):
                found: list[list[dict]] = [[]] * part.num_rows
                for i, _, spans in all_spans(part.column(1)):
                    found[i] = [dict(zip(("kind", "start", "end", "base"), s)) for s in spans]
                kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("base", pa.bool_())]))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(found, kind)], ["doc_id", "spans"])

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, spans {SPANS}")


def redacted(text: str, spans: list[tuple[str, int, int]] | None = None) -> str:
    """The text with <EMAIL>, <IP>, <CARD> and <PHONE> for spans (by start, then kind), those that are found if none are given; where spans meet, the first stands for all."""
    if spans is None:
        spans = [s[:3] for _, _, found in all_spans(pa.array([text], pa.string())) for s in found]
    parts, last = [], 0
    for kind, a, b in spans:
        if a >= last:
            parts += [text[last:a], f"<{kind.upper()}>"]
        last = max(last, b)
    return "".join([*parts, text[last:]]) if parts else text


def redact_pii(docs: DataFrame, text_col: str = "text", length_col: str = "n_chars") -> DataFrame:
    """docs with personal data in its texts replaced; the length column, where there is one, follows the text. Rows, other columns and null texts stay."""
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, text_col, PART_BYTES):
                old = part.column(at)
                changed = {i: redacted(text, [s[:3] for s in spans]) for i, text, spans in all_spans(old)}
                mask = np.zeros(part.num_rows, bool)
                mask[list(changed)] = True
                new = pc.replace_with_mask(old, pa.array(mask), pa.array(list(changed.values()), old.type)) if changed else old
                yield pa.RecordBatch.from_arrays([new if k == at else c for k, c in enumerate(part.columns)], part.schema.names)

    out = docs.mapInArrow(run, docs.schema)
    if length_col in docs.columns:
        was = fresh(docs, "was")
        out = out.withColumn(was, F.col(length_col)).withColumn(length_col, F.char_length(text_col).cast(docs.schema[length_col].dataType)).withColumn(length_col, F.coalesce(length_col, was)).drop(was)
    return out
