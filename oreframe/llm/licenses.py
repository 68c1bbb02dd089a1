"""License scans: an exact set-similarity join of text blocks with templates.

A block is a line of a document or, as notices are wrapped, a window of words of
the template's length / threshold, across lines. A block matches a template when
it holds at least `threshold` of the template's distinct tokens. Tokens are ordered by their
frequency in the whole table, rarest first. A matching block has a token of the
template's prefix (all but need - 1 tokens in that order), found through an index of
prefix tokens; has at least `need` words; and from its first token in common on, the
template and the block both have tokens enough left to reach need. Blocks that pass
these filters are counted exactly. Of windows, those around prefix tokens are counted, one ending
at each of the template's tokens there. Templates and their tokens are fixed and small, so they go
to every task; documents are not shuffled.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _text as tx
from ._spark import in_tasks

#: Phrases (as words) and their base labels.
PHRASES = {
    "cc by": "cc-by",
    "general public license": "gpl",
    "all rights reserved": "reserved",
}

#: Texts of common license notices and their labels.
TEMPLATES = [
    ("apache-2.0", "Licensed under the Apache License, Version 2.0"),
    ("mit", "Released under the MIT License"),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("gpl", "This work is licensed under the GNU General Public License, version 3"),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License"),
    ("lgpl", "This library is licensed under the GNU Lesser General Public License"),
    ("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0"),
    ("cc-by-sa", "Licensed under CC BY-SA 4.0"),
    ("cc0", "This work has been marked as dedicated to the public domain under CC0 1.0"),
]

SCHEMA = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double"


def _hashes(text: str) -> np.ndarray:
    return tx.split(pa.array([text]), tx.ALPHANUMERIC, lower=True).hashes()


class Templates:
    """Templates as token numbers; order(frequencies) makes them ready to probe."""

    def __init__(self, templates: list[tuple[str, str]], phrases: dict[str, str], threshold: float):
        sets = [np.unique(_hashes(t)) for _, t in templates]
        self.labels = [x for x, _ in templates]
        self.vocabulary = np.unique(np.concatenate(sets))
        self.sets = [np.searchsorted(self.vocabulary, x) for x in sets]
        self.need = [max(1, math.ceil(threshold * len(x) - 1e-9)) for x in sets]
        self.width = [math.ceil(len(_hashes(t)) / threshold - 1e-9) for _, t in templates]
        self.phrases = [(_hashes(p), label) for p, label in phrases.items()]

    def order(self, frequency: np.ndarray) -> Templates:
        """Puts the templates' tokens in the order of frequency, and builds the index of their prefixes and of all their tokens."""
        rank = np.lexsort((self.vocabulary, frequency))
        self.place = np.empty(len(rank), np.int64)
        self.place[rank] = np.arange(len(rank))
        self.sets = [x[np.argsort(self.place[x])] for x in self.sets]
        self.prefixes = self._index([x[: len(x) - n + 1] for x, n in zip(self.sets, self.need, strict=True)])
        self.members = self._index(self.sets)
        return self

    def _index(self, sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of each token where its entries begin, and of each entry the template and the token's place in it."""
        token = np.concatenate([*sets, np.empty(0, np.int64)]).astype(np.int64)
        template = np.repeat(np.arange(len(sets)), [len(x) for x in sets])
        at = np.concatenate([np.arange(len(x)) for x in sets] + [np.empty(0, np.int64)]).astype(np.int64)
        o = np.argsort(token, kind="stable")
        return np.searchsorted(token[o], np.arange(len(self.vocabulary) + 1)), template[o], at[o]

    def tokens(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(places of vocabulary words in h, their numbers)."""
        at = np.minimum(np.searchsorted(self.vocabulary, h), len(self.vocabulary) - 1)
        found = np.flatnonzero(self.vocabulary[at] == h)
        return found, at[found]

    def matches(self, block: np.ndarray, token: np.ndarray, block_words: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(template, blocks that match it, their containment), for distinct pairs (block, token)."""
        o = np.lexsort((self.place[token], block))
        block, token = block[o], token[o]
        first, group = tx.groups(block)
        size = np.diff(np.append(first, len(block)))
        after = (size[group] - 1 - (np.arange(len(block)) - first[group])) if len(block) else np.empty(0, np.int64)  # tokens of the block that come later
        pair, entry = _entries_of(token, self.prefixes[0])
        template, at = self.prefixes[1][entry], self.prefixes[2][entry]
        need, length = np.array(self.need), np.array([len(x) for x in self.sets])
        key = block[pair] * len(self.sets) + template
        _, one = np.unique(key, return_index=True)  # the first token in common of a block and a template, as both are in one order
        pair, template, at, key = pair[one], template[one], at[one], key[one]
        bound = 1 + np.minimum(length[template] - at - 1, after[pair])
        candidates = key[(block_words[block[pair]] >= need[template]) & (bound >= need[template])]
        if not len(candidates):
            return
        inside = np.isin(block, candidates // len(self.sets))
        pair, entry = _entries_of(token[inside], self.members[0])
        key = block[inside][pair] * len(self.sets) + self.members[1][entry]
        where = np.minimum(np.searchsorted(candidates, key), len(candidates) - 1)
        n = np.bincount(where[candidates[where] == key], minlength=len(candidates))
        template = candidates % len(self.sets)
        ok = n >= need[template]
        for t in np.unique(template[ok]):
            own = ok & (template == t)
            yield int(t), candidates[own] // len(self.sets), n[own] / length[t]

    def spans(self, place: np.ndarray, token: np.ndarray, start: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(template, indices into place of the last words of windows that match it, their containment).

        place are the words (ascending) that are tokens of templates, start the first words of their documents.
        """
        for t in np.unique(self.prefixes[1][_entries_of(np.unique(token), self.prefixes[0])[1]]).tolist():
            own, need, width = self.sets[t], self.need[t], self.width[t]
            number = np.full(len(self.vocabulary), len(own))
            number[own] = np.arange(len(own))
            at = number[token]
            prefix = place[at < len(own) - need + 1]
            if not len(prefix):
                continue
            after = np.searchsorted(prefix, place)
            to_next = prefix[np.minimum(after, len(prefix) - 1)] - place
            to_last = place - prefix[np.maximum(after - 1, 0)]
            near = np.flatnonzero((at < len(own)) & (((to_next >= 0) & (to_next < width)) | ((to_last >= 0) & (to_last < width))))
            p, at = place[near], at[near]
            low = np.maximum(p - width + 1, start[near])
            n = np.zeros(len(p), np.int64)
            for k in range(len(own)):
                n += np.maximum.accumulate(np.where(at == k, p, -1)) >= low
            found = np.flatnonzero(n >= need)
            yield t, near[found], n[found] / len(own)


def _entries_of(token: np.ndarray, begin: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(index into token, entry) of each entry of each token, where the entries of a token are begin[token]:begin[token + 1]."""
    n = begin[token + 1] - begin[token]
    return np.repeat(np.arange(len(token)), n), np.repeat(begin[token] - (np.cumsum(n) - n), n) + np.arange(n.sum())


def _frequencies(templates) -> object:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = templates.value
        n = np.zeros(len(t.vocabulary), np.int64)
        for batch in tx.chunks(batches):
            _, token = t.tokens(tx.split(batch.column(0), tx.ALPHANUMERIC, lower=True).hashes())
            n += np.bincount(token, minlength=len(n))
        yield pa.record_batch([pa.array(np.arange(len(n))), pa.array(n)], ["token", "n"])

    return run


def _scan(templates) -> object:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = templates.value
        for batch in tx.chunks(batches):
            words = tx.split(batch.column(1), tx.ALPHANUMERIC, lower=True)
            h, doc = words.hashes(), words.doc
            docs = batch.num_rows
            base: list[set[str]] = [set() for _ in range(docs)]
            labels: list[set[str]] = [set() for _ in range(docs)]
            score = np.zeros(docs)
            n_base, first, last = np.zeros(docs, np.int64), np.full(docs, -1), np.full(docs, -1)
            for phrase, label in t.phrases:
                at = np.flatnonzero(h[: max(0, len(h) - len(phrase) + 1)] == phrase[0])
                for k, x in enumerate(phrase):
                    at = at[h[at + k] == x]
                at = at[doc[at] == doc[at + len(phrase) - 1]]
                own = doc[at]
                n_base += np.bincount(own, minlength=docs)
                place = at - words.first[own]
                for d, p in zip(own.tolist(), place.tolist(), strict=True):
                    base[d].add(label)
                    first[d] = p if first[d] < 0 else min(first[d], p)
                    last[d] = max(last[d], p)
                score[own] = 1.0
            lines = np.flatnonzero(words.data == 0x0A)
            block = np.searchsorted(lines, words.starts) + doc  # grows with each line and each document
            found, token = t.tokens(h)
            pair = np.unique(block[found] * np.int64(len(t.vocabulary)) + token)
            sizes = np.bincount(block) if len(block) else np.zeros(0, np.int64)
            owner = np.zeros(len(sizes), np.int64)
            owner[block] = doc
            for k, at, share in t.matches(pair // len(t.vocabulary), pair % len(t.vocabulary), sizes):
                np.maximum.at(score, owner[at], share)
                for d in owner[at].tolist():
                    labels[d].add(t.labels[k])
            for k, at, share in t.spans(found, token, words.first[doc[found]]):
                np.maximum.at(score, doc[found[at]], share)
                for d in doc[found[at]].tolist():
                    labels[d].add(t.labels[k])
            none = n_base == 0
            yield pa.record_batch([
                batch.column(0), pa.array(words.counts, pa.int64()), pa.array(n_base), pa.array(first, pa.int64(), mask=none), pa.array(last, pa.int64(), mask=none),
                pa.array([",".join(sorted(x)) for x in base]), pa.array([",".join(sorted(x | y)) for x, y in zip(base, labels, strict=True)]), pa.array(score),
            ], ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"])

    return run


#: Bytes of templates that a task may hold.
TEMPLATE_BYTES = 16 << 20


def scan_licenses(docs: DataFrame, templates: list[tuple[str, str]] | DataFrame = TEMPLATES, phrases: dict[str, str] = PHRASES, threshold: float = 0.9) -> DataFrame:
    """One row per row of docs (doc_id, text; others are ignored): n_words, places of base phrases, labels and a score.

    score is 1 where a base phrase stands, else the largest containment among
    matching templates, else 0. Null and empty texts have no words, no labels
    ('' both) and score 0. Phrases and windows may cross lines but not documents. Repeated rows have
    a result each. templates can be a table of label and text, of TEMPLATE_BYTES at most; those without words match nothing.
    """
    context = docs.sparkSession.sparkContext
    if isinstance(templates, DataFrame):
        size = templates.agg(F.sum(F.octet_length("text"))).first()[0] or 0
        if size > TEMPLATE_BYTES:
            raise ValueError(f"templates of {size} bytes, more than {TEMPLATE_BYTES}")
        templates = [(r[0], r[1] or "") for r in templates.select("label", "text").collect()]  # of a checked size
    templates = [x for x in templates if len(_hashes(x[1]))]
    ready = Templates(templates, phrases, threshold)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    counted = texts.select("text").mapInArrow(in_tasks(_frequencies(context.broadcast(ready))), "token long, n long").groupBy("token").agg(F.sum("n").alias("n"))
    frequency = np.zeros(len(ready.vocabulary), np.int64)
    for r in counted.collect():  # a row for each token of the templates
        frequency[r[0]] = r[1]
    return texts.mapInArrow(in_tasks(_scan(context.broadcast(ready.order(frequency)))), SCHEMA)
