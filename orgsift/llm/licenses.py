"""Licence notices found by a positional index of rare template words.

Every template is a sentence of a licence with a mandatory key phrase in it.  One pass over all
documents counts in how many each template word stands.  The second pass takes the licence words of
each file that have the highest inverse document frequency, looks up their postings (template and
position), and intersects them by relative position: places of several rare words that point to one
start of a template, give or take a few inserted or missing words, are a candidate.  It counts when the
key phrase stands near where it should, with one inserted word at most.

A file's rare words are some of its words, so a second, separate way makes the search whole: every
place where a key phrase stands word by word counts as well.  Base phrases are found on their own.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .textscan import ALNUM, batch_slices, first_index, hash_of, words_of

RARE = 16  # highest-IDF licence words of a file that are looked up
AGREE = 3  # of them must point to one start
SLACK = 2  # words that may be inserted or missing before a place

# Phrases of the base labels
BASE = (("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved"))

# Fixed values: (label, template, mandatory phrase), words as they are after cutting
TEMPLATES = (
    ("mit", "released under the mit license", "mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", "permission is hereby granted free of charge"),
    ("apache-2.0", "licensed under the apache license version 2 0", "apache license version 2 0"),
    ("gpl", "licensed under the gnu general public license", "gnu general public license"),
    ("gpl", "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation", "gnu general public license"),
    ("gpl-3.0", "gnu general public license version 3", "general public license version 3"),
    ("gpl-2.0", "gnu general public license version 2", "general public license version 2"),
    ("lgpl", "gnu lesser general public license", "lesser general public license"),
    ("agpl", "gnu affero general public license", "affero general public license"),
    ("mpl-2.0", "subject to the terms of the mozilla public license v 2 0", "mozilla public license"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted", "redistribution and use in source and binary forms"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", "for any purpose with or without fee is hereby granted"),
    ("cc-by-nc", "licensed under cc by nc 4 0", "cc by nc"),
    ("cc-by-sa", "licensed under cc by sa 4 0", "cc by sa"),
    ("cc-by-nd", "licensed under cc by nd 4 0", "cc by nd"),
    ("cc-by", "licensed under a creative commons attribution 4 0 international license", "creative commons attribution"),
    ("cc0", "to the extent possible under law the author has dedicated all copyright to the public domain worldwide cc0", "public domain worldwide"),
    ("unlicense", "this is free and unencumbered software released into the public domain", "free and unencumbered software"),
    ("mit", "to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software", "deal in the software without restriction"),
    ("mit", "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software", "copies or substantial portions of the software"),
    ("apache-2.0", "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis", "distributed under the license is distributed on an as is basis"),
    ("apache-2.0", "you may not use this file except in compliance with the license you may obtain a copy of the license at", "except in compliance with the license"),
    ("bsd", "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer", "retain the above copyright notice this list of conditions"),
    ("bsd", "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software", "endorse or promote products derived from this software"),
    ("gpl", "this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability", "hope that it will be useful but without any warranty"),
    ("gpl", "you should have received a copy of the gnu general public license along with this program", "received a copy of the gnu general public license"),
    ("lgpl", "you should have received a copy of the gnu lesser general public license along with this library", "gnu lesser general public license"),
    ("mpl-2.0", "if a copy of the mpl was not distributed with this file you can obtain one at", "copy of the mpl was not distributed"),
    ("isc", "the software is provided as is and the author disclaims all warranties with regard to this software including all implied warranties", "author disclaims all warranties with regard to this software"),
    ("unlicense", "anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled binary", "free to copy modify publish use compile sell or distribute"),
    ("cc0", "the person who associated a work with this deed has dedicated the work to the public domain by waiving all of his or her rights", "associated a work with this deed"),
)


@dataclass
class LicenseIndex:
    """Templates as word hashes; the licence words in order with their IDF, and their postings."""

    labels: list[str]
    words: list[np.ndarray]
    weights: list[np.ndarray]
    phrase: list[tuple[int, int]]
    vocabulary: np.ndarray
    idf: np.ndarray
    first: np.ndarray  # where the postings of a licence word begin
    template: np.ndarray
    place: np.ndarray
    rare: int = RARE
    agree: int = AGREE


def vocabulary(templates=TEMPLATES) -> list[str]:
    return sorted({w for _, text, _ in templates for w in text.split()})


def _count_batches(hashes: np.ndarray):
    def run(batches):
        total = np.zeros(len(hashes) + 1, np.int64)  # the last one counts documents
        for batch in batches:
            for i, j, data, offsets in batch_slices(batch, "text"):
                words, owner, _, _ = words_of(data, offsets, ALNUM)
                at = np.minimum(np.searchsorted(hashes, words), len(hashes) - 1)
                hit = hashes[at] == words
                both = np.unique(owner[hit] * len(hashes) + at[hit])
                total[:-1] += np.bincount(both % len(hashes), minlength=len(hashes))
                total[-1] += j - i
        yield pa.RecordBatch.from_arrays([pa.array(range(len(total)), pa.int64()), pa.array(total)], names=["word", "n"])
    return run


def index_of(frequency: np.ndarray, documents: int, templates=TEMPLATES, rare: int = RARE, agree: int = AGREE) -> LicenseIndex:
    """The index of templates for given document frequencies of vocabulary(templates) in the order of the hashes."""
    order = np.array(sorted(hash_of(w) for w in vocabulary(templates)), np.uint64)
    idf = np.log((documents + 1) / (frequency + 1)) + 1e-9
    at = {int(h): k for k, h in enumerate(order)}
    labels, words, weights, phrases, postings = [], [], [], [], []
    for t, (label, text, phrase) in enumerate(templates):
        parts, must = text.split(), phrase.split()
        numbers = [at[hash_of(w)] for w in parts]
        start = next(i for i in range(len(parts)) if parts[i:i + len(must)] == must)
        labels.append(label)
        words.append(order[numbers])
        weights.append(idf[numbers])
        phrases.append((start, start + len(must)))
        postings += [(k, t, q) for q, k in enumerate(numbers)]
    postings = np.array(sorted(postings), np.int64)
    return LicenseIndex(labels, words, weights, phrases, order, idf, np.searchsorted(postings[:, 0], np.arange(len(order) + 1)),
                        postings[:, 1], postings[:, 2], rare, agree)


def build_index(docs: DataFrame, templates=TEMPLATES, rare: int = RARE, agree: int = AGREE) -> LicenseIndex:
    """Document frequencies of the template words over all docs, and the index made from them.

    One number per template word comes to the driver.
    """
    order = np.array(sorted(hash_of(w) for w in vocabulary(templates)), np.uint64)
    rows = docs.select("text").mapInArrow(_count_batches(order), "word long, n long").groupBy("word").agg(F.sum("n").alias("n")).collect()
    found = {r.word: r.n for r in rows}
    return index_of(np.array([found.get(k, 0) for k in range(len(order))]), found.get(len(order), 0), templates, rare, agree)


def hash_places(words: np.ndarray, owner: np.ndarray, parts: np.ndarray) -> np.ndarray:
    """Places in the list of all words where these words stand one after the other within one text."""
    n = len(words) - len(parts) + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    rest = np.arange(len(parts))
    at = np.flatnonzero(words[:n] == parts[0])
    for k in rest:
        at = at[words[at + k] == parts[k]]
    return at[owner[at] == owner[at + len(parts) - 1]]


def base_places(words: np.ndarray, owner: np.ndarray, phrase: str) -> np.ndarray:
    return hash_places(words, owner, np.array([hash_of(w) for w in phrase.split()], np.uint64))


def rare_hits(index: LicenseIndex, words: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(place in the list of all words, licence word) of the `rare` licence words with the highest IDF of each text."""
    number = np.minimum(np.searchsorted(index.vocabulary, words), len(index.vocabulary) - 1)
    at = np.flatnonzero(index.vocabulary[number] == words)
    number, n = number[at], len(index.vocabulary)
    pairs, which = np.unique(owner[at] * n + number, return_inverse=True)
    order = np.lexsort((pairs % n, -index.idf[pairs % n], pairs // n))
    text = (pairs // n)[order]
    chosen = np.zeros(len(pairs), bool)
    chosen[order] = np.arange(len(pairs)) - np.searchsorted(text, text) < index.rare
    keep = chosen[which]
    return at[keep], number[keep]


def candidates(index: LicenseIndex, words: np.ndarray, owner: np.ndarray) -> list[tuple[int, int, int]]:
    """(text, template, start) where postings of enough of a text's rare words point to one start, give or take SLACK."""
    at, number = rare_hits(index, words, owner)
    many = (index.first[number + 1] - index.first[number])
    hit = np.repeat(np.arange(len(at)), many)
    posting = np.repeat(index.first[number] - (np.cumsum(many) - many), many) + np.arange(many.sum())
    start, template, text = at[hit] - index.place[posting], index.template[posting], owner[at[hit]]
    order = np.lexsort((start, template, text))
    start, template, text, place = start[order], template[order], text[order], index.place[posting][order]
    # the starts of one text and template are one stretch of a line
    group = (text * len(index.labels) + template)
    line = group * (len(words) + 8192) + start + 4096
    until = np.searchsorted(line, line + 2 * SLACK, "right")
    needed = np.minimum(index.agree, np.array([len(w) for w in index.words]))[template]
    out, last = [], -1
    for i in np.flatnonzero(until - np.arange(len(line)) >= needed).tolist():
        if until[i] <= last or len(set(place[i:until[i]].tolist())) < needed[i]:
            continue
        last = int(until[i])
        out.append((int(text[i]), int(template[i]), int(np.median(start[i:last]))))
    return out


def _phrase_near(words: np.ndarray, phrase: np.ndarray, low: int, high: int, until: int) -> int:
    """The first place from low to high where the phrase begins, with one inserted word at most; -1 if there is none."""
    for p in (np.flatnonzero(words[low:high] == phrase[0]) + low).tolist():
        spare, q = 1, p
        for w in phrase[1:]:
            q += 1
            if q < until and words[q] != w and spare:
                spare, q = 0, q + 1
            if q >= until or words[q] != w:
                break
        else:
            return p
    return -1


def _share(index: LicenseIndex, t: int, words: np.ndarray, start: int, a: int, b: int) -> float:
    """IDF-weighted share of a template's words that stand in order from about `start`."""
    got, at = 0.0, max(a, start - SLACK)
    for q, (w, weight) in enumerate(zip(index.words[t], index.weights[t])):
        stop = min(b, max(at, start + q) + SLACK + 1)
        same = np.flatnonzero(words[at:stop] == w)
        if len(same):
            got, at = got + weight, at + int(same[0]) + 1
    return float(got / index.weights[t].sum())


def template_places(index: LicenseIndex, words: np.ndarray, owner: np.ndarray, first: np.ndarray) -> list[tuple[int, int, int, float]]:
    """(text, template, start among its words, share of the template in place) of the verified candidates of both ways."""
    found = {}
    for text, t, start in candidates(index, words, owner):
        a, b = int(first[text]), int(first[text + 1])
        m0, m1 = index.phrase[t]
        p = _phrase_near(words, index.words[t][m0:m1], max(a, start + m0 - 2 * SLACK), min(b, start + m0 + 2 * SLACK + 1), b)
        if p >= 0:
            found[text, t, p - m0] = None
    for t, (m0, m1) in enumerate(index.phrase):  # the whole key phrase, wherever it stands
        for p in hash_places(words, owner, index.words[t][m0:m1]).tolist():
            found[int(owner[p]), t, p - m0] = None
    return [(text, t, start - int(first[text]), _share(index, t, words, start, int(first[text]), int(first[text + 1]))) for text, t, start in sorted(found)]


_OUT = ("doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels array<string>, "
        "labels array<string>, score double, spans array<struct<label: string, start: long, words: long>>")


def _scan_batches(index: LicenseIndex, base):
    span_type = pa.list_(pa.struct([("label", pa.string()), ("start", pa.int64()), ("words", pa.int64())]))

    def run(batches):
        for batch in batches:
            ids = batch.column(batch.schema.get_field_index("doc_id"))
            for i, j, data, offsets in batch_slices(batch, "text"):
                words, owner, _, _ = words_of(data, offsets, ALNUM)
                n = j - i
                first = first_index(owner, n)
                places, spans, own, names, score = [[] for _ in range(n)], [[] for _ in range(n)], [set() for _ in range(n)], [set() for _ in range(n)], np.zeros(n)
                for phrase, label in base:
                    for at in base_places(words, owner, phrase).tolist():
                        text = int(owner[at])
                        places[text].append(at - int(first[text]))
                        own[text].add(label)
                        spans[text].append({"label": label, "start": at - int(first[text]), "words": len(phrase.split())})
                        score[text] = 1.0
                for text, t, start, share in template_places(index, words, owner, first):
                    names[text].add(index.labels[t])
                    spans[text].append({"label": index.labels[t], "start": start, "words": len(index.words[t])})
                    score[text] = max(score[text], share)
                yield pa.RecordBatch.from_arrays([
                    ids.slice(i, n), pa.array(np.diff(first)), pa.array([len(p) for p in places], pa.int64()),
                    pa.array([min(p) if p else None for p in places], pa.int64()), pa.array([max(p) if p else None for p in places], pa.int64()),
                    pa.array([sorted(x) for x in own], pa.list_(pa.string())), pa.array([sorted(x | y) for x, y in zip(own, names)], pa.list_(pa.string())),
                    pa.array(np.minimum(score, 1.0)), pa.array(spans, span_type)],
                    names=["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "spans"])
    return run


def scan_licenses(docs: DataFrame, index: LicenseIndex, base=BASE) -> DataFrame:
    """One row per row of docs(doc_id, text, ..) with words, base phrase places, labels, score and spans.

    Words are runs of a-z, 0-9 and characters over 127 after A-Z is lower-cased.  n_base counts every
    place of every base phrase, overlapping ones too; first_word and last_word are the smallest and
    largest start, null without any.  labels holds the base labels and those of verified templates.
    score is 1 with a base phrase, else the largest IDF-weighted share of a verified template whose
    words stand in order, else 0.  Null is the empty text: no words, no labels, score 0.  Repeated rows
    are scanned alike; no rows give no rows; other columns are ignored.
    """
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_scan_batches(index, base), _OUT)
