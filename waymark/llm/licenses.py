"""Licence scan by ordered signature rules.

Rules are regular expressions over a text's normalised words, in an order of
priority: identifiers, then full names with versions, then grants, then bare
names.  A keyword prefilter decides which texts are looked at and which rules
are tried.  Detections that lie within a detection of a rule of at least their
priority are suppressed.  The base phrases are counted in every text, rules or not.

Defined cases: null and wordless texts have no words, places or labels and
score 0; overlapping places all count; repeated rows are judged row by row; an
empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import bisect
import itertools
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from .common import id_and_text
from .kernels import LETTERS_DIGITS, inside_documents, window_hashes, words

# The contract's base phrases and their labels.
BASE = (("gnu general public license", "gpl"), ("apache license", "apache"), ("cc by", "cc-by"), ("mit license", "mit"))

# Licence families as (label, names as a pattern of words, versions).
FAMILIES = (
    ("gpl", r"gnu general public licen[cs]e|gnu gpl|gpl", ("1", "2", "3")),
    ("lgpl", r"gnu (?:lesser|library) general public licen[cs]e|gnu lgpl|lgpl", ("2", "2 1", "3")),
    ("agpl", r"gnu affero general public licen[cs]e|gnu agpl|agpl", ("1", "3")),
    ("fdl", r"gnu free documentation licen[cs]e|gfdl", ("1 1", "1 2", "1 3")),
    ("apache", r"apache (?:software )?licen[cs]e|apache", ("1", "1 1", "2")),
    ("mpl", r"mozilla public licen[cs]e|mpl", ("1", "1 1", "2")),
    ("epl", r"eclipse public licen[cs]e|epl", ("1", "2")),
    ("cddl", r"common development and distribution licen[cs]e|cddl", ("1", "1 1")),
    ("eupl", r"european union public licen[cs]e|eupl", ("1", "1 1", "1 2")),
    ("artistic", r"artistic licen[cs]e", ("1", "2")),
    ("boost", r"boost software licen[cs]e|bsl", ("1",)),
    ("osl", r"open software licen[cs]e|osl", ("1", "2", "2 1", "3")),
    ("afl", r"academic free licen[cs]e|afl", ("1 1", "1 2", "2", "2 1", "3")),
    ("cpl", r"common public licen[cs]e|cpl", ("1",)),
    ("ofl", r"sil open font licen[cs]e|ofl", ("1", "1 1")),
    ("ms-pl", r"microsoft public licen[cs]e|ms pl", ()),
    ("zlib", r"zlib(?: libpng)? licen[cs]e", ()),
    ("isc", r"isc licen[cs]e", ()),
    ("mit", r"mit (?:expat )?licen[cs]e|expat licen[cs]e", ()),
    ("bsd-2-clause", r"(?:simplified bsd|freebsd|bsd 2 clause|2 clause bsd)(?: licen[cs]e)?", ()),
    ("bsd-3-clause", r"(?:new bsd|modified bsd|revised bsd|bsd 3 clause|3 clause bsd)(?: licen[cs]e)?", ()),
    ("bsd-4-clause", r"(?:original bsd|bsd 4 clause|4 clause bsd)(?: licen[cs]e)?", ()),
    ("bsd", r"bsd (?:style )?licen[cs]e", ()),
    ("unlicense", r"unlicen[cs]e", ()),
    ("wtfpl", r"wtfpl|do what the fuck you want to public licen[cs]e", ("2",)),
    ("cc0", r"cc0|cc zero|creative commons zero", ("1",)),
    ("cc-by-nc-nd", r"cc by nc nd|creative commons attribution non ?commercial no ?deriv(?:ative)?s(?: works)?", ("2", "2 5", "3", "4")),
    ("cc-by-nc-sa", r"cc by nc sa|creative commons attribution non ?commercial share ?alike", ("2", "2 5", "3", "4")),
    ("cc-by-nc", r"cc by nc|creative commons attribution non ?commercial", ("2", "2 5", "3", "4")),
    ("cc-by-nd", r"cc by nd|creative commons attribution no ?deriv(?:ative)?s(?: works)?", ("2", "2 5", "3", "4")),
    ("cc-by-sa", r"cc by sa|creative commons attribution share ?alike", ("2", "2 5", "3", "4")),
    ("cc-by", r"cc by|creative commons attribution", ("2", "2 5", "3", "4")),
    ("public-domain", r"(?:dedicated to|released into|in) the public domain", ()),
    ("psf", r"python software foundation licen[cs]e|psf licen[cs]e", ("2",)),
    ("php", r"php licen[cs]e", ("3", "3 01")),
    ("ruby", r"ruby licen[cs]e", ()),
    ("openssl", r"openssl licen[cs]e", ()),
    ("postgresql", r"postgresql licen[cs]e", ()),
    ("ncsa", r"university of illinois ncsa open source licen[cs]e|ncsa licen[cs]e", ()),
    ("proprietary", r"all rights reserved|proprietary and confidential", ()),
)

# Sentences that grant or identify a licence without naming a version.
TEXTS = (
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    ("zlib", "this software is provided as is without any express or implied warranty in no event will the authors be held liable"),
    ("unlicense", "this is free and unencumbered software released into the public domain"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license"),
    ("lgpl", "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license"),
    ("apache", "you may not use this file except in compliance with the license"),
)

@dataclass(frozen=True)
class Rule:
    label: str
    pattern: re.Pattern
    priority: int  # 0 is first
    score: float
    keywords: tuple[str, ...]  # the rule is tried where one of them occurs
    core: str  # a pattern that every match of the rule holds


def _words_of(pattern: str) -> tuple[str, ...]:
    """For each alternative of a names pattern its longest plain word."""
    found, depth, alternative = [], 0, ""
    for c in [*pattern, "|"]:
        depth += (c == "(") - (c == ")")
        if c == "|" and depth == 0:
            plain = re.sub(r"\([^()]*(?:\([^()]*\)[^()]*)*\)\??|\[[^\]]*\]|.\?", " ", alternative)
            found.append(max(plain.split(), key=len, default=""))
            alternative = ""
        else:
            alternative += c
    return tuple(found)


def make_rules() -> list[Rule]:
    """All rules, in order: each family and version by identifier, grant, name with version and name."""
    rules = []

    def add(label: str, body: str, priority: int, score: float, keywords: tuple[str, ...], core: str) -> None:
        rules.append(Rule(label, re.compile(rf"(?<!\S)(?:{body})(?!\S)"), priority, score, keywords, core))

    for label, text in TEXTS:
        add(label, text, 1, 1.0, (max(text.split(), key=len),), text)
    for family, names, versions in FAMILIES:
        keywords = _words_of(names)
        identifier = family.replace("-", " ")
        for version in versions:
            digits = version.replace(" ", ".")
            label = f"{family}-{digits if '.' in digits else digits + '.0'}"
            number = version if " " in version else rf"{version}(?: 0)?"
            add(label, rf"spdx licen[cs]e identifier {identifier} {number}(?: only| or later)?", 0, 1.0, ("spdx",), "spdx licen[cs]e identifier")
            add(label, rf"(?:licensed|released|distributed|available|published) under (?:the )?(?:terms of )?(?:the )?(?:{names})(?: licen[cs]e)?(?: version| v)? ?v?{number}", 1, 1.0, keywords, names)
            add(label, rf"(?:{names})(?: licen[cs]e)?(?: version| v)? ?v?{number}(?: or (?:any )?later(?: version)?)?", 2, 0.95, keywords, names)
            add(label, rf"version {number} of the (?:{names})", 2, 0.95, keywords, names)
        add(family, rf"spdx licen[cs]e identifier {identifier}", 3, 1.0, ("spdx",), "spdx licen[cs]e identifier")
        add(family, rf"(?:licensed|released|distributed|available|published) under (?:the )?(?:terms of )?(?:the )?(?:{names})", 3, 0.9, keywords, names)
        if family not in ("apache", "cc-by", "boost", "osl", "afl", "cpl", "ofl", "epl", "mpl"):
            add(family, names, 4, 0.7, keywords, names)
        else:  # a short name alone is an ordinary word
            add(family, "|".join(n for n in _split(names) if " " in n), 4, 0.7, keywords, names)
    return sorted(rules, key=lambda r: r.priority)


def _split(names: str) -> list[str]:
    parts, depth, part = [], 0, ""
    for c in [*names, "|"]:
        depth += (c == "(") - (c == ")")
        if c == "|" and depth == 0:
            parts.append(part)
            part = ""
        else:
            part += c
    return parts


def gate(rules: list[Rule]) -> str:
    """A pattern for what a text must hold to be given to the rules: the core of one of them."""
    return rf"\b(?:{'|'.join(sorted({rule.core for rule in rules}))})"


def detect(text: str, rules: list[Rule]) -> list[tuple[int, int, Rule]]:
    """(start, end, rule) in a text of words joined by single spaces, after suppression, in order of priority and place."""
    hits = []
    for order, rule in enumerate(rules):
        if any(word in text for word in rule.keywords):
            hits += [(rule.priority, m.start(), -m.end(), order) for m in rule.pattern.finditer(text)]
    # by start, longest first: a detection lies in an earlier one if the farthest end so far reaches its own
    kept: list[tuple[int, int, Rule]] = []
    starts: list[int] = []
    reach: list[int] = []  # farthest end of the kept detections of better priority that start at or before starts[k]
    for _, level in itertools.groupby(sorted(hits), key=lambda h: h[0]):
        fresh: list[tuple[int, int, Rule]] = []
        farthest = last_start = last_end = -1
        labels: set[str] = set()
        for _, start, minus_end, order in level:
            end, rule = -minus_end, rules[order]
            k = bisect.bisect_right(starts, start) - 1
            if k >= 0 and reach[k] >= end:
                continue
            if farthest >= end:
                # of one place and priority the first label stays, as often as it is found
                if (start, end) == (last_start, last_end) and rule.label in labels:
                    fresh.append((start, end, rule))
                continue
            farthest, last_start, last_end, labels = end, start, end, {rule.label}
            fresh.append((start, end, rule))
        kept += fresh
        starts, reach = [], []
        for start, end in sorted((a, b) for a, b, _ in kept):
            reach.append(max(end, reach[-1] if reach else -1))
            starts.append(start)
    return kept


def _scan():
    rules = make_rules()
    opens = gate(rules)
    phrases = []
    for phrase, label in BASE:
        part = next(words(pa.array([phrase]), LETTERS_DIGITS))
        size = len(part.start)
        phrases.append((window_hashes(part.hashes(), size)[0], size, phrase.encode(), label))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            n_words, n_base, score = np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(n)
            first: list[int | None] = [None] * n
            last: list[int | None] = [None] * n
            base: list[set] = [set() for _ in range(n)]
            labels: list[set] = [set() for _ in range(n)]
            for part in words(batch.column(1), LETTERS_DIGITS):
                hashes = part.hashes()
                n_words[part.first : part.last] = np.diff(part.edges)
                for wanted, size, phrase, label in phrases:
                    own = window_hashes(hashes, size)
                    at = np.flatnonzero(own == wanted)
                    for i in at[inside_documents(part.edges, len(own), size)[at]].tolist():
                        if part.text(i, i + size) == phrase:
                            k = int(np.searchsorted(part.edges, i, "right")) - 1
                            place, k = i - int(part.edges[k]), k + part.first
                            n_base[k] += 1
                            first[k] = place if first[k] is None else min(first[k], place)
                            last[k] = place if last[k] is None else max(last[k], place)
                            base[k].add(label)
            lowered = pc.replace_substring_regex(pc.fill_null(pc.ascii_lower(batch.column(1)), ""), r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", " ")
            for k in np.flatnonzero(np.asarray(pc.match_substring_regex(lowered, opens))).tolist():
                for _, _, rule in detect(lowered[k].as_py().strip(), rules):
                    labels[k].add(rule.label)
                    score[k] = max(score[k], rule.score)
            for k in range(n):
                labels[k] |= base[k]
                if base[k]:
                    score[k] = max(score[k], 0.7)
            joined = [[",".join(sorted(x)) for x in column] for column in (base, labels)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n_words), pa.array(n_base), pa.array(first, pa.int64()), pa.array(last, pa.int64()), pa.array(joined[0], pa.string()), pa.array(joined[1], pa.string()), pa.array(score)],
                ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"],
            )

    return run


def scan(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score."""
    return id_and_text(docs).mapInArrow(_scan(), "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double")
