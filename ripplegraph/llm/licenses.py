r"""Licence scan by a positional index of rare words.

Licence templates and the base phrases form a positional index: word -> postings (template, position). One pass over all
documents counts in how many each licence word occurs; Spark sums the counts, and inverse document frequencies come from them.
Postings are kept for each template's words of highest IDF (`anchors`) within its key phrase, which no accepted place lacks.
A second pass looks up each file's licence words in these postings: the word at place p of the file, at q of a template,
proposes that the template starts at p - q. Proposals of one template and start are intersected: those that all its anchors
make are checked word by word: at least `share` of the template's words must stand at their places, and all of its key
phrase. A base phrase must stand whole. Texts are never cut; every place is found.

Words are [^\x00-\x2F\x3A-\x60\x7B-\x7F]+ after A-Z are lowered. Null text has no words. Without a base phrase n_base is 0
and first_word and last_word are null; without any label labels are '' and score is 0. score: the highest IDF-weighted
share of a label's words found in place (1 for a base phrase), rounded to 6 places. Repeated rows and rows with a null doc_id
get results of their own; an empty table gives no rows. Other columns are not read, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded, kept

# Phrases of the contract, and their labels.
BASE = [("mit", "mit license"), ("apache", "apache license"), ("gpl", "general public license")]
# Fixed values: (label, notice, key phrase); wording of the public licences' own notices.
TEMPLATES = [
    ("mit", "released under the mit license", "mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction", "permission is hereby granted free of charge"),
    ("apache", "licensed under the apache license version 2 0", "apache license"),
    ("apache", "you may not use this file except in compliance with the license you may obtain a copy of the license at", "in compliance with the license"),
    ("gpl", "licensed under the gnu general public license version 3", "gnu general public license"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation", "gnu general public license"),
    ("lgpl", "gnu lesser general public license", "lesser general public license"),
    ("agpl", "gnu affero general public license", "affero general public license"),
    ("mpl", "subject to the terms of the mozilla public license v 2 0", "mozilla public license"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", "redistribution and use in source and binary forms"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", "permission to use copy modify"),
    ("unlicense", "this is free and unencumbered software released into the public domain", "free and unencumbered software"),
    ("cc-by-nc", "licensed under cc by nc 4 0", "cc by nc"),
    ("cc-by-sa", "licensed under cc by sa 4 0", "cc by sa"),
    ("cc-by", "licensed under cc by 4 0", "cc by 4"),
    ("cc-by", "this work is licensed under a creative commons attribution 4 0 international license", "creative commons attribution"),
    ("mit", "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software", "this permission notice shall be included"),
    ("mit", "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement", "merchantability fitness for a particular purpose and noninfringement"),
    ("apache", "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied", "unless required by applicable law or agreed to in writing"),
    ("gpl", "either version 3 of the license or at your option any later version", "or at your option any later version"),
    ("gpl", "this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose", "in the hope that it will be useful"),
    ("bsd", "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer", "redistributions of source code must retain"),
    ("bsd", "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission", "may be used to endorse or promote products"),
    ("mpl", "this source code form is subject to the terms of the mozilla public license v 2 0", "source code form is subject to the terms"),
    ("epl", "this program and the accompanying materials are made available under the terms of the eclipse public license", "eclipse public license"),
    ("bsl", "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license", "any person or organization obtaining a copy"),
    ("zlib", "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software", "in no event will the authors be held liable"),
    ("cc0", "to the extent possible under law the author has waived all copyright and related or neighboring rights to this work", "waived all copyright and related or neighboring rights"),
    ("ofl", "this font software is licensed under the sil open font license version 1 1", "sil open font license"),
]
MIX = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9], np.uint64)
MASK = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)
IS_WORD = np.array([0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 for b in range(256)])
LONGEST = 24


def eights(raw: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """[3, word]: a word's first 24 bytes as three numbers. raw has 24 bytes more than its words."""
    view = np.ndarray((len(raw) - 7,), "<u8", raw.data, strides=(1,))
    return np.stack([view[start + 8 * i] & MASK[np.clip(size - 8 * i, 0, 8)] for i in range(3)])


class Index:
    """Templates as arrays of word numbers, and the lookup of words in text."""

    def __init__(self, base: list[tuple[str, str]], templates: list[tuple[str, str, str]]):
        self.rows = [(label, words.split(), words.split(), True) for label, words in base] + [(label, words.split(), key.split(), False) for label, words, key in templates]
        self.words = sorted({w for _, words, _, _ in self.rows for w in words})
        number = {w: i for i, w in enumerate(self.words)}
        self.numbers = [np.array([number[w] for w in words]) for _, words, _, _ in self.rows]
        self.keys = []
        for label, words, key, _ in self.rows:
            at = next((i for i in range(len(words)) if words[i : i + len(key)] == key), None)
            if at is None or any(len(w.encode()) > LONGEST for w in words):
                raise ValueError(f"{label}: the key phrase must stand in its template, whose words have {LONGEST} bytes at most")
            self.keys.append(np.arange(at, at + len(key)))
        text = b"".join(w.encode() for w in self.words) + bytes(LONGEST)
        size = np.array([len(w.encode()) for w in self.words])
        self.parts = eights(np.frombuffer(text, np.uint8), np.cumsum(size) - size, size)
        mixed = (self.parts * MIX[:, None]).sum(0, dtype=np.uint64)
        self.order = np.argsort(mixed)
        self.mixed = mixed[self.order]

    def find(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Words in each text; then text, position and number of every licence word, in order."""
        size = np.fromiter(map(len, texts), np.int64, len(texts)) + 1
        raw = np.frombuffer(b"\0".join(texts) + bytes(LONGEST + 1), np.uint8)
        flags = IS_WORD[raw]
        edges = np.flatnonzero(np.diff(flags, prepend=False))
        start, length = edges[::2], edges[1::2] - edges[::2]
        of = np.searchsorted(np.cumsum(size), start, side="right")
        n_words = np.bincount(of, minlength=len(texts))
        short = np.flatnonzero(length <= LONGEST)
        parts = eights(raw, start[short], length[short])
        mixed = (parts * MIX[:, None]).sum(0, dtype=np.uint64)
        at = np.minimum(np.searchsorted(self.mixed, mixed), len(self.mixed) - 1)
        same = self.mixed[at] == mixed
        hit, word = short[same], self.order[at[same]]
        exact = (parts[:, same] == self.parts[:, word]).all(0)
        hit, word = hit[exact], word[exact]
        first = np.cumsum(n_words) - n_words
        return n_words, of[hit], hit - first[of[hit]], word

    def postings(self, idf: np.ndarray, anchors: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(first, template, position, needed): a word's postings stand from first[word] to first[word + 1]; needed: a template's anchors."""
        rows, needed = [], np.zeros(len(self.rows), np.int64)
        for k, numbers in enumerate(self.numbers):
            rarest = self.keys[k][np.argsort(-idf[numbers[self.keys[k]]], kind="stable")[:anchors]]
            needed[k] = len(rarest)
            rows += [(numbers[q], k, q) for q in rarest.tolist()]
        word, template, position = np.array(sorted(rows)).T
        return np.searchsorted(word, np.arange(len(self.words) + 1)), template, position, needed

    def places(self, of: np.ndarray, at: np.ndarray, word: np.ndarray, idf: np.ndarray, anchors: int, share: float) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
        """For each template: texts, starts and scores of the places where it stands."""
        where = of.astype(np.int64) << 32 | at
        first, template, position, needed = self.postings(idf, anchors)
        n = first[word + 1] - first[word]
        row = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(first[word], n)
        # a start may lie before its text, or in the one before: then words of the key phrase, which are of one text, tell
        proposed = np.stack([template[row], np.repeat(where, n) - position[row]])
        order = np.lexsort(proposed[::-1])
        proposed = proposed[:, order]
        change = np.flatnonzero(np.any(np.diff(proposed, axis=1, prepend=-1) != 0, axis=0))
        votes = np.diff(change, append=proposed.shape[1])
        agreed = change[votes == needed[proposed[0, change]]] if len(change) else change
        for k in np.unique(proposed[0, agreed]).tolist():
            numbers, key = self.numbers[k], self.keys[k]
            starts = proposed[1, agreed[proposed[0, agreed] == k]]
            wanted = starts[:, None] + np.arange(len(numbers))
            found = np.minimum(np.searchsorted(where, wanted), len(where) - 1)
            good = (where[found] == wanted) & (word[found] == numbers)
            weight = idf[numbers] + 1e-9
            score = (good * weight).sum(1) / weight.sum()
            ok = good[:, key].all(1) & (good.mean(1) >= share) & (wanted[:, key[0]] >> 32 == wanted[:, key[-1]] >> 32)
            text = wanted[ok][:, key[0]] >> 32
            yield k, text, starts[ok] - (text << 32), score[ok]


def index(base: list, templates: list) -> Index:
    """One for each worker process, kept between its tasks."""
    return kept(("licences", tuple(base), tuple(templates)), lambda: Index(base, templates))


def lowered(texts: pa.Array) -> list[bytes]:
    return [b"" if t is None else t.lower() for t in texts.cast(pa.binary()).to_pylist()]


def scan(docs: DataFrame, base: list[tuple[str, str]] = BASE, templates: list[tuple[str, str, str]] = TEMPLATES, anchors: int = 3, share: float = 0.8, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score of every row.

    No text moves; Spark sums the licence words' counts, and the driver receives one number a word.
    """
    rows = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).alias("text"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = index(base, templates)
        n, seen = 0, np.zeros(len(known.words), np.int64)
        for batch in bounded(batches, "text", 2 << 20):
            if batch.num_rows:
                _, of, _, word = known.find(lowered(batch.column(0)))
                n += batch.num_rows
                seen += np.bincount(np.unique(of * len(known.words) + word) % len(known.words), minlength=len(known.words))
        if n:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(seen) + 1)), pa.array(np.concatenate([seen, [n]]))], ["word", "n"])

    counted = rows.select("text").mapInArrow(count, "word long, n long").groupBy("word").agg(F.sum("n").alias("n")).toArrow()
    totals = np.zeros(len(index(base, templates).words) + 1, np.int64)
    totals[counted.column("word").to_numpy()] = counted.column("n").to_numpy()
    n, seen = totals[-1], totals[:-1]
    idf = np.log1p((n - seen + 0.5) / (seen + 0.5))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = index(base, templates)
        for batch in bounded(batches, "text", 2 << 20):
            size = batch.num_rows
            if not size:
                continue
            n_words, of, at, word = known.find(lowered(batch.column(1)))
            n_base, first, last, score = np.zeros(size, np.int64), np.full(size, np.iinfo(np.int64).max), np.full(size, -1), np.zeros(size)
            base_labels: list[set] = [set() for _ in range(size)]
            labels: list[set] = [set() for _ in range(size)]
            for k, texts, starts, scores in known.places(of, at, word, idf, anchors, share) if len(of) else ():
                label, _, _, is_base = known.rows[k]
                np.maximum.at(score, texts, scores)
                for i in set(texts.tolist()):
                    labels[i].add(label)
                    if is_base:
                        base_labels[i].add(label)
                if is_base:
                    np.add.at(n_base, texts, 1)
                    np.minimum.at(first, texts, starts)
                    np.maximum.at(last, texts, starts)
            none = n_base == 0
            joined = lambda x: pa.array([",".join(sorted(s)) for s in x], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n_words), pa.array(n_base), pa.array(first, mask=none), pa.array(last, mask=none), joined(base_labels), joined(labels), pa.array(np.round(np.minimum(score, 1.0), 6))], ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"])

    return rows.mapInArrow(run, "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double")
