"""License scan: an exact set-similarity join of text blocks with license templates.

A block (a line, or a paragraph of lines) meets a template if it holds at least `threshold` of the template's
distinct words.  Words are ordered by their frequency over the whole corpus, rarest first.  A block that
meets a template of n words shares t = ceil(threshold * n) of them, so it holds one of the template's
first n - t + 1 words (prefix filter), has at least t words (length filter), and at each shared word enough
words are left on both sides to reach t (positional filter).  Survivors are counted exactly.
"""

from __future__ import annotations

import math
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import ALNUM, columns_of, over_batches, utf8

#: Phrases of the base scan and their labels.
PHRASES = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}
#: Share of a template's distinct words that a block must hold.
THRESHOLD = 0.8
#: Short notices of public licenses.  Fixed values, as their publishers word them.
TEMPLATES = {
    "mit": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software",
    "apache-2": "Licensed under the Apache License, Version 2.0; you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
    "bsd": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "gpl": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation",
    "mpl-2": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/",
    "cc-by": "This work is licensed under a Creative Commons Attribution 4.0 International License",
    "cc-by-sa": "This work is licensed under a Creative Commons Attribution ShareAlike 4.0 International License",
    "cc-by-nc": "This work is licensed under a Creative Commons Attribution NonCommercial 4.0 International License",
    "unlicense": "This is free and unencumbered software released into the public domain",
    "isc": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies",
}
BLANK = re.compile(rb"\n[\x20\x09\x0b-\x0d]*\n")


def words_of(text: bytes | None) -> list[bytes]:
    return (text or b"").translate(ALNUM).split()


def template_words(templates: dict[str, str]) -> dict[str, frozenset[bytes]]:
    return {k: frozenset(words_of(v.encode())) for k, v in templates.items() if words_of(v.encode())}


def word_frequencies(docs: DataFrame, templates: dict[str, str]) -> dict[bytes, int]:
    """Documents of the whole corpus that hold each template word; the words counted are the templates' own."""
    vocabulary = frozenset().union(*template_words(templates).values()) if templates else frozenset()
    schema = T.StructType([T.StructField("word", T.BinaryType()), T.StructField("n", T.LongType())])

    def make():
        def step(batch: pa.RecordBatch):
            count: Counter[bytes] = Counter()
            for t in utf8(batch.column(1)):
                count.update(vocabulary.intersection(words_of(t)))
            yield {"word": list(count), "n": list(count.values())}

        return step

    totals = over_batches(columns_of(docs), make, schema).groupBy("word").agg(F.sum("n").alias("n"))
    return {bytes(r["word"]): r["n"] for r in totals.toLocalIterator()}


class Scanner:
    """The join's template side: an inverted index of prefix words, bounded by the templates' size."""

    def __init__(self, templates: dict[str, str], frequency: dict[bytes, int], threshold: float = THRESHOLD, phrases: dict[str, str] | None = None):
        self.phrases = [(f" {p} ".encode(), label) for p, label in (PHRASES if phrases is None else phrases).items()]
        sets = template_words(templates)
        self.rank = {w: i for i, w in enumerate(sorted(frozenset().union(*sets.values()) if sets else (), key=lambda w: (frequency.get(w, 0), w)))}
        self.sets = {k: (v, math.ceil(threshold * len(v) - 1e-9)) for k, v in sets.items()}
        self.prefix: dict[bytes, list[tuple[str, int]]] = {}
        for label, (words, need) in self.sets.items():
            for place, w in enumerate(sorted(words, key=self.rank.__getitem__)[: len(words) - need + 1]):
                self.prefix.setdefault(w, []).append((label, place))
        self.least = min((need for _, need in self.sets.values()), default=0)
        self.order = {k: sorted(v, key=self.rank.__getitem__) for k, (v, _) in self.sets.items()}

    def base(self, line: bytes) -> tuple[int, list[int], set[str]]:
        """Places of the phrases in b' w w w ': (how many, their first words, labels)."""
        found, labels = [], set()
        for phrase, label in self.phrases:
            at = line.find(phrase)
            while at >= 0:
                found.append(at)
                labels.add(label)
                at = line.find(phrase, at + 1)
        # A phrase starts with the space before its first word: that space's rank is the word's number.
        places = np.searchsorted(np.flatnonzero(np.frombuffer(line, np.uint8) == 32), found).tolist() if found else []
        return len(places), places, labels

    def blocks(self, text: bytes):
        """Distinct words of each line and of each paragraph of several lines."""
        for paragraph in BLANK.split(text):
            lines = paragraph.split(b"\n")
            sets = [frozenset(words_of(x)) for x in lines]
            yield from sets
            if len(sets) > 1:
                yield frozenset().union(*sets)

    def met(self, block: frozenset[bytes]) -> dict[str, float]:
        """Containment of each template that the block meets."""
        if len(block) < self.least:
            return {}
        own = sorted((w for w in block if w in self.rank), key=self.rank.__getitem__)
        out: dict[str, float] = {}
        tried: set[str] = set()
        for i, w in enumerate(own):
            for label, place in self.prefix.get(w, ()):
                words, need = self.sets[label]
                # First shared word: before it nothing is shared, so what follows on either side must do.
                if label in tried or len(block) < need or len(own) - i < need or len(words) - place < need:
                    tried.add(label)
                    continue
                tried.add(label)
                if (shared := len(block & words)) >= need:
                    out[label] = shared / len(words)
        return out

    def scan(self, text: bytes | None):
        text = text or b""
        words = words_of(text)
        n_base, places, base = self.base(b" " + b" ".join(words) + b" ")
        labels: dict[str, float] = {}
        if len(words) >= self.least and not self.prefix.keys().isdisjoint(words):
            for block in self.blocks(text):
                for label, share in self.met(block).items():
                    labels[label] = max(share, labels.get(label, 0.0))
        score = 1.0 if base else max(labels.values(), default=0.0)
        return len(words), n_base, min(places, default=None), max(places, default=None), ",".join(sorted(base)), ",".join(sorted({*base, *labels})), score


SCHEMA = T.StructType([T.StructField("doc_id", T.LongType()), *[T.StructField(n, T.LongType()) for n in ("n_words", "n_base", "first_word", "last_word")], T.StructField("base_labels", T.StringType()), T.StructField("labels", T.StringType()), T.StructField("score", T.DoubleType())])


def scan_licenses(docs: DataFrame, templates: dict[str, str] | None = None, threshold: float = THRESHOLD, phrases: dict[str, str] | None = None) -> DataFrame:
    """One row per document: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score.

    score is 1 for a phrase, else the largest containment met, else 0.  Null and empty texts have no words, no
    labels and score 0; repeated rows are scanned one by one; empty tables give no rows.
    """
    templates = TEMPLATES if templates is None else templates
    frequency = word_frequencies(docs, templates)

    def make():
        scanner = Scanner(templates, frequency, threshold, phrases)

        def step(batch: pa.RecordBatch):
            rows = list(zip(*[scanner.scan(t) for t in utf8(batch.column(1))], strict=True))
            yield {"doc_id": batch.column(0)} | {f.name: list(c) for f, c in zip(SCHEMA.fields[1:], rows, strict=True)}

        return step

    return over_batches(columns_of(docs), make, SCHEMA)
