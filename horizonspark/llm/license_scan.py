"""Licence notices by fuzzy search of short phrases.

A notice is a row of parts, each with the edits it allows. A notice with k edits in
all is split into k + 1 pieces, one of which must stand unchanged (the
pigeonhole principle); one automaton finds all notices' pieces, and only there the regex
library matches the notice with bounded errors and reports edits and span. Texts are compared
as their words (A-Z lower-cased; 0-9, a-z and everything beyond ASCII) joined by single spaces.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import accumulate

import ahocorasick
import pandas as pd
import regex
from pyspark.sql import Column
from pyspark.sql import functions as F

from horizonspark.llm.common import text_bytes


@dataclass(frozen=True)
class Notice:
    label: str
    parts: tuple[tuple[str, int], ...]
    base: bool = False

    @property
    def text(self) -> str:
        return "".join(p for p, _ in self.parts)

    @property
    def edits(self) -> int:
        return sum(k for _, k in self.parts)


BASE = (
    Notice("mit", (("under the mit license", 0),), True),
    Notice("apache-2", (("apache license version 2", 0),), True),
    Notice("cc-by-nc", (("cc by nc", 0),), True),
)
#: Names and version numbers stay exact, so that an edit never turns one licence into another.
FUZZY = (
    Notice("mit", (("under the ", 1), ("mit", 0), (" license", 1))),
    Notice("mit", (("permission is hereby granted free of charge to any person obtaining a copy of this software", 5),)),
    Notice("apache-2", (("apache license version ", 2), ("2", 0))),
    Notice("apache-2", (("licensed under the ", 2), ("apache", 0), (" license", 1), (" 2 0", 0))),
    Notice("cc-by-nc", (("licensed under ", 2), ("cc by nc", 0))),
    Notice("cc-by-nc", (("creative commons attribution noncommercial", 3),)),
    Notice("cc-by-nc-sa", (("creative commons attribution noncommercial", 3), (" sharealike", 1))),
    Notice("cc-by-nc-nd", (("creative commons attribution noncommercial", 3), (" noderivatives", 1))),
    Notice("cc-by-sa", (("creative commons attribution", 2), (" sharealike", 1))),
    Notice("cc-by-nd", (("creative commons attribution", 2), (" noderivatives", 1))),
    Notice("cc-by", (("creative commons ", 1), ("attribution ", 0), ("4 0 international license", 2))),
    Notice("cc0", (("creative commons zero ", 2), ("v1 0 universal", 0))),
    Notice("gpl-3", (("gnu general public license version ", 3), ("3", 0))),
    Notice("gpl-2", (("gnu general public license version ", 3), ("2", 0))),
    Notice("lgpl-3", (("gnu ", 0), ("lesser", 1), (" general public license version ", 3), ("3", 0))),
    Notice("lgpl-2.1", (("gnu ", 0), ("lesser", 1), (" general public license version ", 3), ("2 1", 0))),
    Notice("agpl-3", (("gnu ", 0), ("affero", 1), (" general public license version ", 3), ("3", 0))),
    Notice("mpl-2", (("mozilla public license version ", 2), ("2", 0))),
    Notice("epl-2", (("eclipse public license version ", 2), ("2", 0))),
    Notice("bsd", (("redistributions in binary form must reproduce the above copyright notice", 4),)),
    Notice("bsd-3", (("neither the name of the copyright holder nor the names of its contributors may be used to endorse", 5),)),
    Notice("isc", (("permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", 6),)),
    Notice("unlicense", (("this is free and unencumbered software released into the public domain", 4),)),
    Notice("zlib", (("this software is provided as is without any express or implied warranty in no event will the authors", 5),)),
    Notice("all-rights-reserved", (("all rights reserved", 2),)),
)
#: Licences named by an identifier line: what the words of its tag and name are, and the label.
IDENTIFIERS = {
    "mit": "mit", "apache 2 0": "apache-2", "cc by nc 4 0": "cc-by-nc", "cc by 4 0": "cc-by", "cc by sa 4 0": "cc-by-sa", "cc0 1 0": "cc0",
    "gpl 2 0": "gpl-2", "gpl 3 0": "gpl-3", "lgpl 2 1": "lgpl-2.1", "lgpl 3 0": "lgpl-3", "agpl 3 0": "agpl-3", "mpl 2 0": "mpl-2", "epl 2 0": "epl-2",
    "bsd 2 clause": "bsd-2", "bsd 3 clause": "bsd-3", "isc": "isc", "unlicense": "unlicense", "zlib": "zlib",
}
FUZZY += tuple(Notice(label, (("spdx", 0), (" license identifier ", 2), (name, 0))) for name, label in IDENTIFIERS.items())
HITS = "struct<n_words: bigint, hits: array<struct<label: string, base: boolean, edits: int, first_word: bigint, start: bigint, stop: bigint, found: string>>>"

_WORD_BYTES = bytes(c if 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A or c >= 0x80 else c + 32 if 0x41 <= c <= 0x5A else 0x20 for c in range(256))
_WORD = re.compile(rb"[^ ]+")


class Scanner:
    def __init__(self, notices: tuple[Notice, ...] = BASE + FUZZY):
        self.notices = notices
        pieces: dict[str, list[tuple[int, int]]] = {}
        for i, n in enumerate(notices):
            text, k = f" {n.text} " if n.base else n.text, n.edits + 1
            cuts = [len(text) * j // k for j in range(k + 1)]
            for lo, hi in zip(cuts, cuts[1:], strict=False):
                pieces.setdefault(text[lo:hi], []).append((i, lo))
        self.automaton = ahocorasick.Automaton()
        for piece, owners in pieces.items():
            self.automaton.add_word(piece, (len(piece), owners))
        self.automaton.make_automaton()
        self.patterns = [regex.compile("(?b)(?<= )" + "".join(f"(?:{regex.escape(p)}){{e<={k}}}" if k else regex.escape(p) for p, k in n.parts) + "(?= )") for n in notices]

    def scan(self, text: bytes) -> tuple[int, list[tuple]]:
        """(number of words, hits): label, base, edits, first word, start and stop (bytes of the text), what was found."""
        flat = text.translate(_WORD_BYTES)
        words = flat.split()
        joined = " " + b" ".join(words).decode("latin-1") + " "
        asked: dict[int, list[tuple[int, int]]] = {}
        for end, (size, owners) in self.automaton.iter(joined):
            for i, at in owners:
                n = self.notices[i]
                lo = end + 1 - size - at
                hi = lo + len(n.text) + 2 * n.base
                asked.setdefault(i, []).append((max(0, lo - n.edits - 1), min(len(joined), hi + n.edits + 1)))
        hits = []
        for i, windows in asked.items():
            n = self.notices[i]
            for lo, hi in self._together(windows):
                hits += [(n.label, n.base, sum(m.fuzzy_counts), m.start(), m.end()) for m in self._matches(i, joined, lo, hi)]
        if not hits:
            return len(words), []
        spans = [m.span() for m in _WORD.finditer(flat)]
        starts = list(accumulate((len(w) + 1 for w in words), initial=1))  # of the words in joined
        out = []
        for label, base, edits, lo, hi in hits:
            first = max(0, bisect_right(starts, lo) - 1)
            stop = max(first, bisect_right(starts, hi - 1) - 1)
            a, b = spans[first][0], spans[min(stop, len(spans) - 1)][1]
            out.append((label, base, edits, first, a, b))
        return len(words), [(*h, text[h[4] : h[5]].decode("utf-8", "replace")) for h in self._longest(sorted(out, key=lambda h: (h[3], not h[1], h[0])))]

    @staticmethod
    def _longest(hits: list[tuple]) -> Iterator[tuple]:
        """Without the fuzzy hits that are only a part of a longer one, whose licence is another (attribution, of attribution and share alike)."""
        span: tuple[int, int] = (-1, -1)
        inside: set[int] = set()
        for i in sorted(range(len(hits)), key=lambda i: (hits[i][4], -hits[i][5])):
            _, base, _, _, a, b = hits[i]
            if base:
                continue
            if b <= span[1] and (a, b) != span:
                inside.add(i)
            elif b > span[1]:
                span = (a, b)
        return (h for i, h in enumerate(hits) if i not in inside)

    def _matches(self, i: int, joined: str, lo: int, hi: int) -> Iterator[regex.Match]:
        """The best match of a window, and those to its left and right: a search for the best skips earlier ones with more edits."""
        least = len(self.notices[i].text) - self.notices[i].edits
        todo = [(lo, hi)]
        while todo:
            lo, hi = todo.pop()
            if hi - lo > least and (m := self.patterns[i].search(joined, lo, hi)):
                yield m
                todo += [(lo, m.start()), (m.end(), hi)]

    @staticmethod
    def _together(windows: list[tuple[int, int]]) -> Iterator[tuple[int, int]]:
        """Overlapping windows as one."""
        windows.sort()
        lo, hi = windows[0]
        for a, b in windows[1:]:
            if a <= hi:
                hi = max(hi, b)
            else:
                yield lo, hi
                lo, hi = a, b
        yield lo, hi


def license_hits(text_col: str = "text", notices: tuple[Notice, ...] = BASE + FUZZY) -> Column:
    """A struct column: n_words, and hits in order of place. Null is empty: no words, no hits. Whole texts of any length are scanned; repeated notices are each reported."""

    @F.pandas_udf(HITS)
    def scan(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        scanner = Scanner(notices)
        names = ("label", "base", "edits", "first_word", "start", "stop", "found")
        for texts in batches:
            found = [scanner.scan(t) for t in texts]
            yield pd.DataFrame({"n_words": pd.Series([n for n, _ in found], dtype="int64"), "hits": pd.Series([[dict(zip(names, h, strict=True)) for h in hits] for _, hits in found], dtype="object")})

    return scan(text_bytes(text_col))


def labels_of(hits: Column) -> Column:
    """Distinct labels, sorted and comma-joined."""
    return F.array_join(F.array_sort(F.array_distinct(F.transform(hits, lambda h: h["label"]))), ",")
