"""Operator 8: license scan: exact places of license phrases, and fuzzy search for short notices.

A text's words are runs of ASCII letters (lower-cased), digits and non-ASCII characters; joined by single spaces they are
the normal form in which both searches run. A notice of m characters may have up to m // ``CHARS_PER_EDIT`` edits (at least
one). It is split into one part more than that: by the pigeonhole principle one part stands in the text unchanged. The parts
of all notices are looked up together by one automaton. A hit names the places, at most as far off as there may be edits, where
its notice can begin; from each that begins a word, the ``regex`` library's bounded-error matching finds the edits and the
end, over the text as it is. So the matches are those that a trial from every word of the text finds. One narrow pass, no
shuffle.

Null text: empty. An empty text has no words, places, labels or spans, and score 0. Overlapping places and spans are all
given, sorted; repeated rows give repeated rows. Of the input only the id and text columns are read, so that other columns
may have any name.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import cache

import ahocorasick
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakeaudit.llm.text import slices, strings

#: The phrases and labels of the base search.
PHRASES = (("gnu general public license", "gpl"), ("apache license", "apache"), ("cc by", "cc-by"), ("mit license", "mit"))
#: Opening or grant lines of common licenses in normal form, and their labels.
NOTICES = (
    ("licensed under the gnu general public license", "gpl"),
    ("under the terms of the gnu general public license as published by", "gpl"),
    ("gnu lesser general public license", "lgpl"),
    ("gnu library general public license", "lgpl"),
    ("gnu affero general public license", "agpl"),
    ("licensed under the apache license version 2 0", "apache"),
    ("you may not use this file except in compliance with the license", "apache"),
    ("released under the mit license", "mit"),
    ("permission is hereby granted free of charge to any person obtaining a copy", "mit"),
    ("redistribution and use in source and binary forms with or without modification", "bsd"),
    ("permission to use copy modify and or distribute this software for any purpose", "isc"),
    ("subject to the terms of the mozilla public license", "mpl"),
    ("made available under the terms of the eclipse public license", "epl"),
    ("subject to the common development and distribution license", "cddl"),
    ("licensed under the european union public licence", "eupl"),
    ("licensed under the academic free license", "afl"),
    ("distributed under the boost software license version 1 0", "bsl-1.0"),
    ("this is free and unencumbered software released into the public domain", "unlicense"),
    ("this software is provided as is without any express or implied warranty", "zlib"),
    ("licensed under the sil open font license version 1 1", "ofl"),
    ("licensed under the artistic license", "artistic"),
    ("python software foundation license", "psf"),
    ("microsoft public license ms pl", "ms-pl"),
    ("use of this software is governed by the business source license", "busl"),
    ("server side public license version 1", "sspl"),
    ("creative commons attribution", "cc-by"),
    ("creative commons attribution noncommercial", "cc-by-nc"),
    ("creative commons attribution sharealike", "cc-by-sa"),
    ("creative commons attribution noderivatives", "cc-by-nd"),
    ("licensed under cc by nc", "cc-by-nc"),
    ("licensed under cc by sa", "cc-by-sa"),
    ("licensed under cc by nd", "cc-by-nd"),
    ("cc0 1 0 universal public domain dedication", "cc0"),
    ("open data commons open database license", "odbl"),
    ("all rights reserved", "all-rights-reserved"),
)
CHARS_PER_EDIT = 10


@dataclass(frozen=True)
class Notice:
    text: str
    label: str
    edits: int
    pattern: regex.Pattern

    def parts(self) -> list[tuple[int, str]]:
        """edits + 1 parts of about one length, with their offsets."""
        n = self.edits + 1
        cuts = [len(self.text) * i // n for i in range(n + 1)]
        return [(a, self.text[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)]


@cache
def notices(given: tuple[tuple[str, str], ...] = NOTICES) -> tuple[Notice, ...]:
    out = []
    for text, label in given:
        edits = max(1, len(text) // CHARS_PER_EDIT)
        out.append(Notice(text, label, edits, regex.compile(rf"(?b)(?:{regex.escape(text, literal_spaces=True)}){{e<={edits}}}(?![^ ])")))
    return tuple(out)


@cache
def automaton(given: tuple[tuple[str, str], ...]) -> ahocorasick.Automaton:
    seeds: dict[str, list[tuple[int, int]]] = {}
    for i, notice in enumerate(notices(given)):
        for offset, part in notice.parts():
            seeds.setdefault(part, []).append((i, offset))
    out = ahocorasick.Automaton()
    for part, places in seeds.items():
        out.add_word(part, (len(part), places))
    out.make_automaton()
    return out


@cache
def fold() -> bytes:
    """A byte table: A-Z to a-z, what is in no word to a space."""
    return bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def normal(text: str | None) -> tuple[str, int]:
    words = (text or "").encode("utf-8", "surrogatepass").translate(fold()).split()
    return b" ".join(words).decode("utf-8", "surrogatepass"), len(words)


@cache
def exact(given: tuple[tuple[str, str], ...]) -> regex.Pattern:
    return tuple((phrase, label, regex.compile(rf"(?<![^ ]){phrase}(?![^ ])")) for phrase, label in given)


def base_places(text: str, given: tuple[tuple[str, str], ...] = PHRASES) -> list[tuple[int, str]]:
    """(first word, label) of every place, in order. ``text`` is in normal form; a phrase never overlaps itself."""
    found = []
    for phrase, label, p in exact(given):
        word = at = 0
        for m in p.finditer(text) if phrase in text else ():
            word += text.count(" ", at, m.start())
            at = m.start()
            found.append((word, label))
    return sorted(found)


def begins(text: str, given: tuple[tuple[str, str], ...] = NOTICES) -> set[tuple[int, int]]:
    """(notice, place) of the word beginnings where a seed lets a notice begin."""
    known, seen, out = notices(given), set(), set()
    for end, (size, places) in automaton(given).iter(text):
        for i, offset in places:
            start = end - size + 1 - offset
            if (i, start) in seen:
                continue
            seen.add((i, start))
            first = max(0, start - known[i].edits)
            last = start + known[i].edits
            if first == 0 and text[:1] != " ":
                out.add((i, 0))
            at = text.find(" ", max(0, first - 1), last)
            while at >= 0:
                out.add((i, at + 1))
                at = text.find(" ", at + 1, last)
    return out


def matches_at(text: str, at: set[tuple[int, int]], given: tuple[tuple[str, str], ...] = NOTICES) -> list[tuple[int, int, int, int]]:
    """(start, end, notice, edits), sorted: the match of fewest edits from each of the places, if there is one."""
    known, found = notices(given), []
    for i, start in at:
        # A match is no longer than the notice and its edits; one character more shows whether a word goes on.
        if m := known[i].pattern.match(text[start : start + len(known[i].text) + known[i].edits + 1]):
            if m.end():
                found.append((start, start + m.end(), i, sum(m.fuzzy_counts)))
    return sorted(found)


def fuzzy_spans(text: str, given: tuple[tuple[str, str], ...] = NOTICES) -> list[tuple[int, int, str, int]]:
    """(start, end, label, edits) in the normal form, sorted.

    Of matches of one notice that overlap, the one of fewest edits holds, then the first; a match that overlaps one of another
    notice with fewer edits, or as many and within it, goes.
    """
    return settled(matches_at(text, begins(text, given), given), given)


def settled(found: list[tuple[int, int, int, int]], given: tuple[tuple[str, str], ...] = NOTICES) -> list[tuple[int, int, str, int]]:
    known = notices(given)
    starts, longest = [s[0] for s in found], max((s[1] - s[0] for s in found), default=0)

    def beaten(s: tuple[int, int, int, int]) -> bool:
        near = found[bisect_left(starts, s[0] - longest) : bisect_left(starts, s[1])]
        same = lambda o: (o[3], o[0], -o[1]) < (s[3], s[0], -s[1])
        within = lambda o: o[3] == s[3] and o[0] <= s[0] and s[1] <= o[1] and o[1] - o[0] > s[1] - s[0]
        return any(o[1] > s[0] and (same(o) if o[2] == s[2] else o[3] < s[3] or within(o)) for o in near)

    return sorted({(s[0], s[1], known[s[2]].label, s[3]) for s in found if not beaten(s)})


def scan_text(text: str | None) -> tuple[int, list[tuple[int, str]], list[tuple[int, int, str, int]], float]:
    """Number of words, base places, fuzzy spans, and the score: 1 for an exact phrase, else the best share of unedited
    characters of a notice found, else 0."""
    body, n = normal(text)
    places, spans = base_places(body), fuzzy_spans(body)
    score = 1.0 if places else max((1 - e / (b - a) for a, b, _, e in spans), default=0.0)
    return n, places, spans, max(0.0, score)


def license_scan(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",), text_column: str = "text") -> DataFrame:
    """The kept columns, n_words, n_base, first_word, last_word (long), base_labels, labels (string), score (double), and
    spans array<struct<start long, end long, label string, edits int>> in the normal form; a row for each row of docs."""
    keys = [f"k{i}" for i in range(len(keep))]
    span_type = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("label", pa.string()), ("edits", pa.int32())]))
    kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64(), span_type]
    names = ["n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "spans"]

    def scan(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            rows = []
            for t in strings(batch.column("text")):
                n, places, spans, score = scan_text(t)
                base = sorted({label for _, label in places})
                every = sorted({*base, *(s[2] for s in spans)})
                ends = [at for at, _ in places]
                rows.append((n, len(places), min(ends, default=None), max(ends, default=None), ",".join(base), ",".join(every), score, [dict(zip(("start", "end", "label", "edits"), s, strict=True)) for s in spans]))
            columns = [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in keys), *columns], [*keys, *names])

    slim = docs.select(*(F.col(c).alias(k) for c, k in zip(keep, keys, strict=True)), F.col(text_column).alias("text"))
    ids = ", ".join(f"{k} {docs.schema[c].dataType.simpleString()}" for c, k in zip(keep, keys, strict=True))
    out = slim.mapInArrow(scan, f"{ids}, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, spans array<struct<start: bigint, end: bigint, label: string, edits: int>>")
    return out.withColumnsRenamed(dict(zip(keys, keep, strict=True)))
