"""Licence notices by template markup, compiled to automata over words.

Markup: words are mandatory; `[ ... ]` may be missing; `{n}` stands for up to n
words of any kind; `(a b | c)` for one of its alternatives. A template accepts
a place of a text if its mandatory wording stands there exactly, word for word.
Per document the work is linear: an automaton runs only where its first word
stands, in texts that hold its longest mandatory run of words (or, if all its
words stand in brackets, one of its first words).

Words are runs of letters, digits and non-ASCII characters after A-Z became
lower case. Everything happens inside one pass over the texts, without shuffle.

Defined cases: null counts as empty and has no words. Repeated rows are read
each for itself, null ids are kept, other columns are ignored, whatever their
names. An empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import DataFrame

from loomlog.llm.common import map_texts

#: Phrases and their labels.
PHRASES = (
    ("cc-by", "cc by"),
    ("gpl", "general public license"),
    ("reserved", "all rights reserved"),
)
TEMPLATES = (
    ("Apache-2.0", "licensed under the apache license [ ( version | v ) ] 2 0"),
    ("BSD", "redistribution and use in source and binary forms with or without modification are permitted"
            " provided that the following conditions are met"),
    ("CC-BY", "[ licensed under ] [ a | the ] ( cc by | creative commons attribution ) [ license ] {1} 0"),
    ("CC-BY-NC", "[ licensed under ] [ the ] ( cc by nc | creative commons attribution noncommercial ) {1} 0"),
    ("CC-BY-SA", "[ licensed under ] [ the ] ( cc by sa | creative commons attribution sharealike ) {1} 0"),
    ("CC0", "( cc0 1 0 | released under cc0 ) [ universal ] [ public domain dedication ]"),
    ("GPL-2.0", "[ licensed under ] [ the terms of ] the gnu general public license [ as published by {6} ]"
                " [ either ] version 2"),
    ("GPL-3.0", "[ licensed under ] [ the terms of ] the gnu general public license [ as published by {6} ]"
                " [ either ] version 3"),
    ("ISC", "permission to use copy modify and or distribute this software for any purpose with or without"
            " fee is hereby granted"),
    ("LGPL", "gnu lesser general public license"),
    ("MIT", "( licensed | released | distributed ) under [ the terms of ] the mit license"),
    ("MIT", "permission is hereby granted free of charge to any person obtaining a copy of {12} to deal in"
            " {4} without restriction"),
    ("MPL-2.0", "subject to the terms of the mozilla public license [ version | v ] [ 2 0 ]"),
    ("Unlicense", "this is free and unencumbered software released into the public domain"),
    ("copyright", "copyright {8} all rights reserved"),
)

#: A-Z to lower case; all other ASCII characters but digits and a-z to blanks.
FOLD = bytes(
    b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32
    for b in range(256)
)
FOUND = (
    "n_words bigint,"
    " matches array<struct<label:string,base:boolean,first_word:bigint,end_word:bigint>>"
)


class Template:
    """An automaton over words: `words[s]` and `free[s]` lead on, `skips[s]` without a word."""

    def __init__(self, label: str, markup: str):
        self.label = label
        self.words: list[dict[bytes, int]] = []
        self.free: list[int | None] = []
        self.skips: list[list[int]] = []
        self.run: list[bytes] = []
        self._tokens = re.findall(r"\{\d+\}|[\[\]()|]|\w+", markup)
        self._now: list[bytes] = []
        start = self._state()
        self.end = self._sequence(start, depth=0)
        self._mandatory(None)
        self.start = self._closure({start})
        self.first = {w for s in self.start for w in self.words[s]}
        runs = [self.run] if self.run else [[w] for w in sorted(self.first)]
        self.anchors = [b" " + b" ".join(run) + b" " for run in runs]

    def _state(self) -> int:
        self.words.append({})
        self.free.append(None)
        self.skips.append([])
        return len(self.words) - 1

    def _mandatory(self, word: bytes | None) -> None:
        self._now = [] if word is None else [*self._now, word]
        if len(self._now) > len(self.run):
            self.run = self._now

    def _sequence(self, at: int, depth: int) -> int:
        """Compile up to a closing bracket or bar; returns the last state."""
        while self._tokens and self._tokens[0] not in (")", "]", "|"):
            token = self._tokens.pop(0)
            if token in ("[", "("):
                self._mandatory(None)
                last = self._state()
                while True:
                    first = self._state()
                    self.skips[at].append(first)
                    self.skips[self._sequence(first, depth + 1)].append(last)
                    if self._tokens.pop(0) != "|":
                        break
                if token == "[":
                    self.skips[at].append(last)
                at = last
            elif token[0] == "{":
                self._mandatory(None)
                last = self._state()
                for _ in range(int(token[1:-1])):
                    self.skips[at].append(last)
                    self.free[at] = self._state()
                    at = self.free[at]
                self.skips[at].append(last)
                at = last
            else:
                self._mandatory(token.encode() if not depth else None)
                self.words[at][token.encode()] = nxt = self._state()
                at = nxt
        return at

    def _closure(self, states: set[int]) -> set[int]:
        todo, seen = list(states), set(states)
        while todo:
            for s in self.skips[todo.pop()]:
                if s not in seen:
                    seen.add(s)
                    todo.append(s)
        return seen

    def end_at(self, words: list[bytes], start: int) -> int | None:
        """Where the longest match that begins at word `start` ends (exclusive)."""
        states, found, at = self.start, None, start
        while states:
            if self.end in states:
                found = at
            if at == len(words):
                break
            word = words[at]
            nxt = {t for s in states if (t := self.words[s].get(word)) is not None}
            nxt |= {t for s in states if (t := self.free[s]) is not None}
            states = self._closure(nxt)
            at += 1
        return found


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(FOLD).split()


class Scanner:
    def __init__(self, phrases=PHRASES, templates=TEMPLATES):
        self.all = [(True, Template(*p)) for p in phrases] + [(False, Template(*t)) for t in templates]

    def matches(self, words: list[bytes]) -> list[tuple[str, bool, int, int]]:
        """(label, whether a base phrase, first word, end word) of every place."""
        line = b" " + b" ".join(words) + b" "
        live = [(base, t) for base, t in self.all if any(a in line for a in t.anchors)]
        found = []
        if live:
            heads: dict[bytes, list] = {}
            for base, t in live:
                for w in t.first:
                    heads.setdefault(w, []).append((base, t))
            for i, word in enumerate(words):
                for base, t in heads.get(word, ()):
                    if (end := t.end_at(words, i)) is not None:
                        found.append((t.label, base, i, end))
        return found


def scan(docs: DataFrame, phrases=PHRASES, templates=TEMPLATES) -> DataFrame:
    """doc_id, n_words and all matches with their places, per row of `docs`."""

    def make():
        scanner, names = Scanner(phrases, templates), ("label", "base", "first_word", "end_word")

        def rows(texts: list[str | None]) -> Iterator[tuple]:
            for text in texts:
                words = words_of(text)
                yield len(words), [dict(zip(names, m)) for m in scanner.matches(words)]

        return rows

    return map_texts(docs, "doc_id bigint", make, FOUND)
