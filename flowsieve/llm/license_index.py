"""Licences by a positional index of rare words.

Notices (templates) are sequences of words. Words are weighted by their rarity over all
documents (IDF). The index holds, per template, its highest-IDF words with their
positions: so many that the words left out weigh less than the share which a find may
lack. So a text that holds enough of a notice holds an indexed word of it in place, and
looking up the text's rarest licence words finds every candidate.

A hit of a text position p and a template position q speaks for the template starting
near p - q. Hits that agree within a band are one candidate place; there all words of the
template are counted, weighted by IDF, and its mandatory phrases have to stand in reach.
"""

from __future__ import annotations

import math
from bisect import bisect_left
from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator, Sequence
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowsieve.llm.common import map_batches
from flowsieve.llm.lexical_search import TERM_BYTES, raw_texts, terms

# A text may lack or add this many words inside a notice before its parts fall apart.
BAND = 8
SHARE = 0.75


class Template(NamedTuple):
    """A notice and the phrases which must stand in a text that holds it."""

    label: str
    words: tuple[str, ...]
    phrases: tuple[tuple[str, ...], ...]


def template(label: str, text: str, *phrases: str) -> Template:
    return Template(label, tuple(_words(text.encode())), tuple(tuple(_words(p.encode())) for p in phrases))


def _words(text: bytes) -> list[str]:
    return [w.decode() for w in terms(text)]


# Notices by which licences are known, with their mandatory phrases.
TEMPLATES = (
    template("agpl", "GNU Affero General Public License as published by the Free Software Foundation", "affero general public license"),
    template("apache", "Licensed under the Apache License, Version 2.0", "apache license"),
    template("apache", "you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0", "compliance with the license", "apache"),
    template("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met", "source and binary forms", "are permitted"),
    template("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License", "creative commons attribution"),
    template("cc-by-nc", "Licensed under CC BY-NC 4.0", "cc by nc"),
    template("cc-by-sa", "Licensed under CC BY-SA 4.0", "cc by sa"),
    template("cc0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work", "waived all copyright"),
    template("gpl", "This work is licensed under the GNU General Public License, version 3", "gnu general public license"),
    template("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation", "gnu general public license", "free software"),
    template("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted", "with or without fee"),
    template("lgpl", "under the terms of the GNU Lesser General Public License as published by the Free Software Foundation", "lesser general public license"),
    template("mit", "Released under the MIT License", "mit license"),
    template("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files", "free of charge", "obtaining a copy"),
    template("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0", "mozilla public license"),
    template("reserved", "Copyright. All rights reserved", "all rights reserved"),
    template("unlicense", "This is free and unencumbered software released into the public domain", "public domain"),
)
# Phrases which name a licence wherever they stand.
PHRASES = (("gnu general public license", "gpl"), ("apache license", "apache"), ("cc by", "cc-by"), ("mit license", "mit"))


def starts(phrase: Sequence[str], at: dict[str, list[int]]) -> list[int]:
    """Places where the words of ``phrase`` stand consecutively."""
    later = [set(at.get(w, ())) for w in phrase[1:]]
    return [p for p in at.get(phrase[0], ()) if all(p + i in places for i, places in enumerate(later, 1))]


class Index:
    """Templates, their words' weights, and postings of their rarest words."""

    def __init__(self, templates: Sequence[Template], idf: dict[str, float], share: float, band: int):
        self.templates, self.idf, self.share, self.band = templates, idf, share, band
        self.total = [sum(idf[w] for w in t.words) for t in templates]
        self.postings: dict[str, list[tuple[int, int]]] = defaultdict(list)
        for n, t in enumerate(templates):
            left = self.total[n]
            by_rarity = sorted(set(t.words), key=lambda w: (-idf[w], w))
            for word in by_rarity:
                if left < share * self.total[n] - 1e-9:
                    break
                places = [q for q, w in enumerate(t.words) if w == word]
                self.postings[word] += [(n, q) for q in places]
                left -= idf[word] * len(places)

    def aligned(self, n: int, band: int, at: dict[str, list[int]]) -> float:
        """Share of the template's weight that stands in place, within two bands."""
        low, found = band * self.band, 0.0
        for q, word in enumerate(self.templates[n].words):
            places = at.get(word, ())
            i = bisect_left(places, low + q)
            if i < len(places) and places[i] < low + q + 2 * self.band:
                found += self.idf[word]
        return found / self.total[n]

    def candidates(self, at: dict[str, list[int]]) -> set[tuple[int, int]]:
        """(template, band) where an indexed word stands in place, rarest words first."""
        held = sorted((w for w in self.postings if w in at), key=lambda w: -self.idf[w])
        bands = ((n, (p - q) // self.band) for w in held for n, q in self.postings[w] for p in at[w])
        return {(n, b - back) for n, b in set(bands) for back in (0, 1)}

    def scan(self, at: dict[str, list[int]]) -> tuple[set[str], float]:
        """Labels of the templates a text holds, and the best share of one."""
        labels, score = set(), 0.0
        standing: dict[tuple[str, ...], list[int]] = {}
        for n, band in self.candidates(at):
            share = min(self.aligned(n, band, at), 1.0)
            if share < self.share:
                continue
            words, low, verified = self.templates[n].words, band * self.band, True
            for phrase in self.templates[n].phrases:
                if phrase not in standing:
                    standing[phrase] = starts(phrase, at)
                i = bisect_left(standing[phrase], low)
                verified &= i < len(standing[phrase]) and standing[phrase][i] < low + 2 * self.band + len(words)
            if verified:
                labels.add(self.templates[n].label)
                score = max(score, share)
        return labels, score


def _positions(text: bytes, wanted: Iterable[str] | dict) -> tuple[int, dict[str, list[int]]]:
    """Number of words, and the places of the wanted ones."""
    at: dict[str, list[int]] = defaultdict(list)
    n = 0
    for word in text.translate(TERM_BYTES).split(b" "):
        if word:
            if word in wanted:
                at[wanted[word]].append(n)
            n += 1
    return n, at


def rarity(docs: DataFrame, words: Iterable[str]) -> dict[str, float]:
    """IDF of the given words over all documents; a word per row of the driver's result."""
    wanted = {w.encode(): w for w in words}

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        seen = Counter(w for text in raw_texts(batch) for w in wanted.keys() & set(text.translate(TERM_BYTES).split(b" ")))
        seen[b""] = batch.num_rows
        return pa.RecordBatch.from_arrays([pa.array([w.decode() for w in seen]), pa.array(seen.values(), pa.int64())], ["word", "n"])

    counts = map_batches(docs.select("text"), run, [T.StructField("word", T.StringType()), T.StructField("n", T.LongType())])
    df = {r["word"]: r["n"] for r in counts.groupBy("word").agg(F.sum("n").alias("n")).collect()}
    total = df.get("", 0)
    return {w: math.log((2 * total + 2) / (2 * df.get(w, 0) + 1)) + 1 for w in wanted.values()}


def scan_licenses(
    docs: DataFrame, templates: Sequence[Template] = TEMPLATES, phrases: Sequence[tuple[str, str]] = PHRASES,
    share: float = SHARE, band: int = BAND,
) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): doc_id, n_words, n_base, first_word, last_word,
    base_labels, labels, score.

    Places of ``phrases`` are counted as they stand; ``first_word`` and ``last_word`` are
    their smallest and largest start in words, null without any. ``labels`` adds those of
    the templates of which at least ``share`` of the weight stands in place (words may be
    lost or added, ``band`` of them) with all mandatory phrases. ``score`` is 1 with a
    phrase, else the best share of such a template, 0 without.

    Whole texts count, however long; null is empty: no words, empty labels, score 0.
    Places that tie count alike. Repeated rows and null ids come back as they are, other
    columns are ignored, an empty table gives an empty result.
    """
    named = [(tuple(_words(p.encode())), label) for p, label in phrases]
    vocabulary = {w for t in templates for part in (t.words, *t.phrases) for w in part} | {w for p, _ in named for w in p}
    index = Index(templates, rarity(docs, sorted(vocabulary)), share, band)
    wanted = {w.encode(): w for w in vocabulary}
    names = ["n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"]
    types = [T.LongType()] * 4 + [T.StringType()] * 2 + [T.DoubleType()]
    arrow = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64()]

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = []
        for text in raw_texts(batch):
            n, at = _positions(text, wanted)
            places = [(label, starts(p, at)) for p, label in named]
            found = [p for _, held in places for p in held]
            base = {label for label, held in places if held}
            labels, score = index.scan(at)
            told = [",".join(sorted(x)) for x in (base, base | labels)]
            rows.append((n, len(found), min(found, default=None), max(found, default=None), *told, 1.0 if found else score))
        columns = [pa.array(c, t) for c, t in zip(zip(*rows), arrow)]
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), *columns], ["doc_id", *names])

    fields = [T.StructField("doc_id", docs.schema["doc_id"].dataType)] + [T.StructField(n, t) for n, t in zip(names, types)]
    return map_batches(docs.select("doc_id", "text"), run, fields)
