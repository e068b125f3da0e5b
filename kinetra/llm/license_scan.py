"""License scan: template-markup matching.

A template is a text with regions in the markup of public license lists: <<beginOptional>> ... <<endOptional>> for wording
that may be absent, and <<var;match="a,b">> for wording that may be replaced by a to b words. It is compiled to an
automaton over words (a small NFA); a text is accepted from a place on when all mandatory wording matches there exactly.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

#: Base phrases and their labels.
PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}

#: Wording of public license notices, shortened to the sentences that identify them; the full texts of licenses are not here.
TEMPLATES = {
    "apache": 'licensed under the apache license',
    "apache-2.0": 'licensed under the apache license version 2 0',
    "mit": 'permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files <<beginOptional>>the software<<endOptional>> to deal in the software without restriction',
    "mit-notice": '<<beginOptional>>released<<endOptional>> under the <<beginOptional>>terms of the<<endOptional>> mit license',
    "bsd": 'redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met',
    "isc": 'permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted',
    "mpl-2.0": 'this source code form is subject to the terms of the mozilla public license v <<beginOptional>>ersion<<endOptional>> 2 0',
    "gpl-notice": 'under the terms of the gnu <<beginOptional>>lesser<<endOptional>> general public license as published by <<var;match="1,6">>',
    "cc-by-4.0": 'licensed under <<beginOptional>>a<<endOptional>> <<beginOptional>>creative commons<<endOptional>> cc by 4 0',
    "cc-by-nc-4.0": 'licensed under <<beginOptional>>a<<endOptional>> <<beginOptional>>creative commons<<endOptional>> cc by nc 4 0',
    "cc-by-sa-4.0": 'licensed under <<beginOptional>>a<<endOptional>> <<beginOptional>>creative commons<<endOptional>> cc by sa 4 0',
    "cc-by-nc-sa-4.0": 'licensed under <<beginOptional>>a<<endOptional>> <<beginOptional>>creative commons<<endOptional>> cc by nc sa 4 0',
    "copyright": 'copyright <<beginOptional>>c<<endOptional>> <<var;match="1,8">> all rights reserved',
    "public-domain": 'released into the public domain',
    "cc0": 'cc0 1 0 universal',
}

_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if c > 127 or chr(c).isalnum() else 32 for c in range(256))


def words_of(text: str | None) -> list[bytes]:
    """Words of a text under the package's word rule, as UTF-8: ASCII letters and digits in lower case, and whatever is not ASCII."""
    return text.encode("utf-8", "surrogatepass").translate(_FOLD).split() if text else []


class Automaton:
    """States 0..n over words; edges by word, empty edges for optional regions, and counted wildcard states."""

    def __init__(self, template: str):
        self.step: list[dict[bytes, int]] = [{}]
        self.skip: list[list[int]] = [[]]
        self.any: list[int | None] = [None]
        opened: list[int] = []
        for piece in re.findall(r"<<[^>]*>>|[^<]+", template):
            if piece.startswith("<<beginOptional"):
                opened.append(len(self.step) - 1)
            elif piece.startswith("<<endOptional"):
                self.skip[opened.pop()].append(len(self.step) - 1)
            elif piece.startswith("<<var"):
                low, high = map(int, re.search(r'match="(\d+),(\d+)"', piece).groups())
                first = len(self.step) - 1
                for _ in range(high):
                    self._add(None)
                for i in range(low, high):
                    self.skip[first + i].append(first + high)
            else:
                for w in words_of(piece):
                    self._add(w)
        if opened:
            raise ValueError("an optional region is not closed")
        self.end = len(self.step) - 1
        self.starts = {w for s in self._close({0}) for w in self.step[s]}
        if not self.starts or self.end in self._close({0}):
            raise ValueError("a template needs mandatory wording at its start")

    def _add(self, word: bytes | None) -> None:
        here = len(self.step) - 1
        if word is None:
            self.any[here] = here + 1
        else:
            self.step[here][word] = here + 1
        self.step.append({})
        self.skip.append([])
        self.any.append(None)

    def _close(self, states: set[int]) -> set[int]:
        todo = list(states)
        while todo:
            for t in self.skip[todo.pop()]:
                if t not in states:
                    states.add(t)
                    todo.append(t)
        return states

    def match(self, words: list[bytes], at: int) -> int | None:
        """The end of the longest accepted run of words from a place on, or None."""
        states, found = self._close({0}), None
        while states:
            if self.end in states:
                found = at
            if at >= len(words):
                break
            w = words[at]
            states = self._close({t for s in states for t in (self.step[s].get(w), self.any[s]) if t is not None})
            at += 1
        return found


class Scanner:
    def __init__(self, templates: dict[str, str] = TEMPLATES, phrases: dict[str, str] = PHRASES):
        self.automata = [(label, Automaton(t)) for label, t in templates.items()]
        self.base = [(b" " + p.encode() + b" ", len(p.split()), label) for p, label in phrases.items()]
        # A template can only occur where one of its anchors does: the rarest-looking (longest) mandatory word of its wording.
        self.anchors = [max(_mandatory(t), key=len) for t in templates.values()]

    def scan(self, text: str | None) -> tuple[int, list[tuple[int, int, str]], list[tuple[int, int, str]]]:
        """Number of words; base places and template places as (start word, end word, label)."""
        words = words_of(text)
        if not words:
            return 0, [], []
        line = b" " + b" ".join(words) + b" "
        base = []
        for phrase, n, label in self.base:
            start, seen, at = 0, 0, line.find(phrase)
            while at >= 0:
                start, seen = start + line.count(b" ", seen, at), at
                base.append((start, start + n, label))
                at = line.find(phrase, at + 1)
        found, have = [], None
        for (label, automaton), anchor in zip(self.automata, self.anchors):
            if b" " + anchor + b" " not in line:
                continue
            if have is None:
                have = {}
                for i, w in enumerate(words):
                    have.setdefault(w, []).append(i)
            done = 0
            for i in sorted(i for w in automaton.starts for i in have.get(w, ())):
                if i >= done and (end := automaton.match(words, i)) is not None:
                    found.append((i, end, label))
                    done = end
        return len(words), sorted(base), sorted(found)


def _mandatory(template: str) -> list[bytes]:
    return words_of(re.sub(r"<<[^>]*>>", " ", re.sub(r"<<beginOptional>>.*?<<endOptional>>", " ", template)))


SCHEMA = "doc_id long, n_words long, base array<struct<start:long,stop:long,label:string>>, matches array<struct<start:long,stop:long,label:string>>, score double"
_PLACES = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64()), ("label", pa.string())]))


def license_scan(docs: DataFrame, templates: dict[str, str] = TEMPLATES, phrases: dict[str, str] = PHRASES) -> DataFrame:
    """For each row of docs (doc_id, text): its number of words, the places of base phrases (all of them, also overlapping)
    and of templates (leftmost, longest, not overlapping themselves), in words from 0, end exclusive.

    score is 0 without evidence, 0.5 with base phrases only, and 1 once a template's whole mandatory wording is there. Null and empty texts have no words and no places. Rows are
    judged one by one: repeated rows repeat their results; other columns are ignored. Memory: one text at a time.
    """
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(templates, phrases)
        for batch in batches:
            n, base, found, score = [], [], [], []
            for text in batch.column(1):
                k, b, m = scanner.scan(text.as_py())
                n.append(k)
                base.append([dict(zip(("start", "stop", "label"), x)) for x in b])
                found.append([dict(zip(("start", "stop", "label"), x)) for x in m])
                score.append(1.0 if m else 0.5 if b else 0.0)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(base, _PLACES), pa.array(found, _PLACES), pa.array(score, pa.float64())], ["doc_id", "n_words", "base", "matches", "score"])

    return docs.selectExpr("cast(doc_id as long) AS doc_id", "cast(text as string) AS text").mapInArrow(run, SCHEMA)


def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan(spark.read.parquet(f"{sf_dir}/documents.parquet")).selectExpr(
        "doc_id", "n_words", "cast(size(base) as long) AS n_base", "array_min(base.start) AS first_word", "array_max(base.start) AS last_word",
        "array_join(array_sort(array_distinct(base.label)), ',') AS base_labels",
        "array_join(array_sort(array_distinct(concat(base.label, matches.label))), ',') AS labels", "score",
    )
