"""License scans: MinHash bands over overlapping text windows retrieve templates, exact containment verifies them.

Texts and templates are compared as five-word shingles of lower-case words.  For each class of template lengths a text is read as the row of
those of its shingles that stand in some template of the class: what is inserted into a template falls out of that row, however long it is.  The row is
covered by overlapping windows, so far that any run as long as a template of the class lies whole in one of them.  A window
and a template of which it holds at least CONTAINED of the shingles then have a Jaccard similarity of at least `least_similarity`, and the number
of bands is computed from that so that the pair shares a band with probability 1 - MISS.  Bands alone say which templates are
looked at; of those the shingles themselves are compared with the window's.

A find is the shortest stretch of the window that holds what the window holds of the template.  Of finds of a template that overlap the best one
stays, so further copies are further finds.  Templates are few and travel with the tasks; the documents are read once, whole, and nothing is shuffled.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from math import ceil, log

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.llm.license_texts import WHOLE_TEXTS

SHINGLE = 5
CONTAINED = 0.8
#: Rows of a band, and how likely a pair may be missed.
ROWS, MISS = 2, 1e-4
#: Lengths of templates (in shingles) of a class lie within this factor.
CLASS_FACTOR = 1.5
#: Templates go to every task: so many, of so many words at most.
MOST_TEMPLATES, MOST_WORDS = 4096, 20_000
#: Bytes of a text that are shingled together, and of short texts.
PART_BYTES, GROUP_BYTES = 1 << 20, 1 << 18
SEED = 0x9E3779B97F4A7C15

#: Notices by which public licenses are granted, and short licenses as a whole.
TEMPLATES = (
    *WHOLE_TEXTS,
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("MIT", "Released under the MIT License."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:"),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("BSD", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at"),
    ("GPL-3.0-or-later", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
)

#: What is a word: ASCII letters and digits, and every byte above ASCII.
_WORD = np.zeros(256, dtype=bool)
_WORD[list(b"0123456789abcdefghijklmnopqrstuvwxyz")] = True
_WORD[128:] = True
_WORDS = re.compile(rb"[0-9a-z\x80-\xff]+")


def words(text: bytes) -> list[bytes]:
    return _WORDS.findall(text.lower())


def _mixed(v: np.ndarray) -> np.ndarray:
    v = (v ^ (v >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    v = (v ^ (v >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return v ^ (v >> np.uint64(30))


_POWERS = np.multiply.accumulate(np.concatenate((np.ones(1, np.uint64), np.full(255, SEED, np.uint64))))


#: What a byte counts in its word's hash; what parts words counts nothing.
_VALUES = np.where(_WORD, np.arange(1, 257), 0).astype(np.uint64)


def shingle_hashes(data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hashes, starts, ends) of lower-case bytes: a hash for each five words in a row, and where each word stands."""
    is_word = _WORD[data]
    edges = np.flatnonzero(np.diff(np.concatenate(([0], is_word.view(np.int8), [0]))))
    starts, ends = edges[::2], edges[1::2]
    if len(starts) < SHINGLE:
        return np.zeros(0, np.uint64), starts, ends
    place = np.arange(len(data), dtype=np.int32)
    begun = np.zeros(len(data), dtype=np.int32)
    begun[starts] = starts
    value = _VALUES[data] * _POWERS[(place - np.maximum.accumulate(begun)) & 255]
    word = _mixed(np.add.reduceat(value, starts))
    n = len(word) - SHINGLE + 1
    total = np.zeros(n, np.uint64)
    for i in range(SHINGLE):
        total = total * np.uint64(SEED) + word[i : i + n]
    return _mixed(total), starts, ends


def least_similarity(template: int, window: int, contained: float = CONTAINED) -> float:
    """The least Jaccard similarity of a template of so many shingles and a window that holds that share of them."""
    return contained * template / (window + (1 - contained) * template)


def bands_for(similarity: float, rows: int = ROWS, miss: float = MISS) -> int:
    """Bands of so many rows with which a pair of that similarity shares none with probability `miss` at most."""
    p = similarity**rows
    return 1 if p >= 1 else ceil(log(miss) / log(1 - p))


class Scanner:
    """Finds templates in texts."""

    def __init__(self, templates: Sequence[tuple[str, str]] = TEMPLATES, contained: float = CONTAINED) -> None:
        self.contained = contained
        self.names, self.grams, self.hashes = [], [], []
        if len(templates) > MOST_TEMPLATES:
            raise ValueError(f"more than {MOST_TEMPLATES} templates")
        for name, text in templates:
            data = text.encode().lower()
            w = words(data)
            if not SHINGLE <= len(w) <= MOST_WORDS:
                raise ValueError(f"a template of {name} has {len(w)} words; {SHINGLE} to {MOST_WORDS} are needed")
            self.names.append(name)
            self.grams.append({b" ".join(w[i : i + SHINGLE]) for i in range(len(w) - SHINGLE + 1)})
            self.hashes.append(np.unique(shingle_hashes(np.frombuffer(data, np.uint8))[0]))
        # classes: (window, stride, multipliers of the hashes, {band key: templates}, the shingles of its templates)
        self.classes = []
        left = sorted(range(len(self.names)), key=lambda i: len(self.hashes[i]))
        lengths = {i: len(words(t.encode())) - SHINGLE + 1 for i, (_, t) in enumerate(templates)}
        left.sort(key=lengths.__getitem__)
        while left:
            small = lengths[left[0]]
            own = [i for i in left if lengths[i] <= max(small, small * CLASS_FACTOR)]
            left = left[len(own) :]
            longest = max(lengths[i] for i in own)
            stride = longest // 8 + 1
            window = longest + stride - 1
            bands = bands_for(min(least_similarity(len(self.hashes[i]), window, contained) for i in own))
            seeds = np.random.default_rng(window).integers(1, 1 << 63, ROWS * bands, dtype=np.uint64) | np.uint64(1)
            keys: dict[int, set[int]] = {}
            for i in own:
                for key in self._bands(self.hashes[i], seeds).tolist():
                    keys.setdefault(key, set()).add(i)
            self.classes.append((window, stride, seeds, keys, np.unique(np.concatenate([self.hashes[i] for i in own]))))
        self.known = np.unique(np.concatenate(self.hashes)) if self.hashes else np.zeros(0, np.uint64)
        self.quick = np.zeros(1 << 16, dtype=bool)
        self.quick[self.known >> np.uint64(48)] = True

    @staticmethod
    def _bands(hashes: np.ndarray, seeds: np.ndarray) -> np.ndarray:
        least = np.array([_mixed(hashes * s).min() for s in seeds]).reshape(-1, ROWS)
        with np.errstate(over="ignore"):
            return _mixed(least[:, 0] + _mixed(least[:, 1] + np.arange(len(least), dtype=np.uint64)))

    def _known(self, text: bytes, before: int) -> tuple[int, list[int], list[int], list[bytes]]:
        """(words, places, hashes, shingles) of the shingles that stand in some template."""
        low = text.lower()
        hashes, starts, ends = shingle_hashes(np.frombuffer(low, dtype=np.uint8))
        maybe = np.flatnonzero(self.quick[hashes >> np.uint64(48)])
        near = maybe[np.isin(hashes[maybe], self.known)]
        shingles = [b" ".join([low[a:b] for a, b in zip(starts[k : k + SHINGLE].tolist(), ends[k : k + SHINGLE].tolist())]) for k in near.tolist()]
        return len(starts), (near + before).tolist(), hashes[near].tolist(), shingles

    @staticmethod
    def _cut(text: bytes) -> Iterator[tuple[bytes, int]]:
        """(part, words before it): parts begin and end between words and overlap by the words of a shingle but one."""
        begin, before = 0, 0
        while len(text) - begin > PART_BYTES:
            end = begin + PART_BYTES
            while end < len(text) and _WORD[text[end : end + 1].lower()[0]]:
                end += 1
            part = text[begin:end]
            yield part, before
            if end >= len(text):
                return
            spans = [m.start() for m in _WORDS.finditer(part.lower())]
            back = min(len(spans) - 1, SHINGLE - 1)
            if back < 1:
                begin, before = end, before + len(spans)
            else:
                begin, before = begin + spans[-back], before + len(spans) - back
        yield text[begin:], before

    def _held(self, places: list[int], shingles: list[bytes], i: int) -> tuple[float, int, int] | None:
        """(containment, first, last place): how much of template i stands in a window, and the shortest stretch that holds as much."""
        own = [(p, s) for p, s in zip(places, shingles) if s in self.grams[i]]
        held = len({s for _, s in own})
        share = held / len(self.grams[i])
        if share < self.contained:
            return None
        counts: dict[bytes, int] = {}
        best, low = None, 0
        for p, s in own:
            counts[s] = counts.get(s, 0) + 1
            while counts[own[low][1]] > 1:
                counts[own[low][1]] -= 1
                low += 1
            if len(counts) == held and (best is None or p - own[low][0] < best[1] - best[0]):
                best = (own[low][0], p)
        return share, *best

    def matches(self, text: bytes) -> tuple[int, list[tuple[str, int, int, float]]]:
        """(words, [(license, first word, word after the last, containment)]): overlapping finds of one license are one."""
        n, places, hashes, shingles = 0, [], [], []
        for part, before in self._cut(text):
            held, p, h, s = self._known(part, before)
            n = max(n, before + held)
            places, hashes, shingles = places + p, hashes + h, shingles + s
        finds: dict[int, set[tuple[float, int, int]]] = {}
        every = np.array(hashes, dtype=np.uint64)
        for window, stride, seeds, keys, known in self.classes:
            row = np.flatnonzero(np.isin(every, known))
            if not len(row):
                continue
            last = max(0, len(row) - window)
            for at in [*range(0, last, stride), last]:
                here = row[at : at + window]
                shared: set[int] = set()
                for key in self._bands(every[here], seeds).tolist():
                    shared |= keys.get(key, set())
                for i in shared:
                    if found := self._held([places[k] for k in here], [shingles[k] for k in here], i):
                        finds.setdefault(i, set()).add(found)
        out: list[tuple[str, int, int, float]] = []
        kept = []
        for i, own in finds.items():
            taken: list[tuple[int, int]] = []
            for share, first, end in sorted(own, key=lambda f: (-f[0], f[2] - f[1], f[1])):
                if not any(first <= b and a <= end for a, b in taken):
                    taken.append((first, end))
                    kept.append((self.names[i], first, end + SHINGLE, share))
        for name, a, b, share in sorted(kept):
            if out and out[-1][0] == name and a < out[-1][2]:
                out[-1] = (name, out[-1][1], max(b, out[-1][2]), max(share, out[-1][3]))
            else:
                out.append((name, a, b, share))
        return n, out

    def scan(self, texts: list[bytes]) -> list[tuple[int, list[tuple[str, int, int, float]]]]:
        """matches() of each text.  Texts are first shingled together; only those with a template's shingle are looked at alone."""
        out = []
        for run in _grouped(texts):
            if len(run) == 1 and len(run[0]) > PART_BYTES:
                out.append(self.matches(run[0]))
                continue
            data = np.frombuffer(b"\n".join(run).lower(), dtype=np.uint8)
            hashes, starts, _ = shingle_hashes(data)
            first = np.concatenate(([0], np.cumsum([len(t) + 1 for t in run])))
            of = np.searchsorted(first, starts, side="right") - 1
            n_words = np.bincount(of, minlength=len(run))
            maybe = np.flatnonzero(self.quick[hashes >> np.uint64(48)])
            near = set(of[maybe[np.isin(hashes[maybe], self.known)]].tolist())
            out += [self.matches(t) if i in near else (int(n), []) for i, (t, n) in enumerate(zip(run, n_words))]
        return out


def _grouped(texts: list[bytes]) -> Iterator[list[bytes]]:
    run, size = [], 0
    for t in texts:
        if run and size + len(t) > GROUP_BYTES:
            yield run
            run, size = [], 0
        run.append(t)
        size += len(t)
    if run:
        yield run


def license_matches(documents: DataFrame, templates: Sequence[tuple[str, str]] = TEMPLATES, *, id_col="doc_id", text_col="text", contained=CONTAINED) -> DataFrame:
    """(doc_id, n_words, licenses, n_matches, matches): a row per row of documents, repeated ones included.

    licenses are the names found, sorted and joined by commas (empty: none); matches say which words and how much
    of the template stands there.  Null and empty texts have no words and no license.  An empty table gives no
    rows, no templates no matches; other columns are not read.  Texts may be of any length: a task holds a text and those of its shingles that
    stand in some template.
    """
    templates = [(str(a), str(b)) for a, b in templates]
    source = documents.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("binary").alias("text"))
    match = pa.list_(pa.struct([("license", pa.string()), ("first_word", pa.int64()), ("end_word", pa.int64()), ("containment", pa.float64())]))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(templates, contained)
        for batch in batches:
            found = []
            for at in range(0, len(batch), 512):
                found += scanner.scan([bytes(t.as_buffer()) if t.is_valid and len(t.as_buffer()) else b"" for t in batch["text"].slice(at, 512)])
            names = [",".join(sorted({m[0] for m in own})) for _, own in found]
            rows = [[dict(zip(("license", "first_word", "end_word", "containment"), m)) for m in own] for _, own in found]
            yield pa.RecordBatch.from_arrays(
                [batch["doc_id"], pa.array([n for n, _ in found], pa.int64()), pa.array(names, pa.string()), pa.array([len(own) for _, own in found], pa.int64()), pa.array(rows, match)],
                ["doc_id", "n_words", "licenses", "n_matches", "matches"],
            )

    kind = source.schema["doc_id"].dataType.simpleString()
    return source.mapInArrow(scan, f"doc_id {kind}, n_words long, licenses string, n_matches long, matches array<struct<license: string, first_word: long, end_word: long, containment: double>>")
