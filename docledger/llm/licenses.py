"""License scan by an exact set-similarity join of templates with text blocks.

A block is a window of words; its width is twice the next power of two that is no less than a
template's length, its step half of that, so every run as long as the template lies in one block. A block
matches a template when it holds at least ``threshold`` of the template's distinct words.

Words are put in one global order, rarest in the corpus first (document counts over all
documents). A template can only match a block that holds one of its first
``size - needed + 1`` words (prefix filter); blocks with too few template words are passed over
(length filter), and so are pairs whose remaining words cannot reach the needed
overlap (positional filter). What is left is counted exactly. A set knows no order, so a matching block
also tells whether it holds the notice itself (``ordered``): a run of at most the template's length over
``threshold`` words that contains ``threshold`` of the template's words in the template's order. Labels and
score come from ordered blocks.

Next to it stand fixed phrases, found wherever their words are consecutive.

Defined cases: a null or empty text has no words, no labels and score 0; repeated rows are
scanned alike; a null doc_id stays null; ties in the best score do not matter, as labels are
a set. Other columns are ignored.
"""

from __future__ import annotations

import math
from bisect import bisect_left

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docledger.llm._text import ALNUM_LOWER, small

THRESHOLD = 0.9
#: Distinct template words the driver will order; beyond it, templates must be scanned in parts.
MAX_VOCABULARY = 200_000
#: Fixed phrases and their labels.
PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
#: Public license notices: (label, text).
TEMPLATES = [
    ("apache-2.0", "Licensed under the Apache License, Version 2.0"),
    ("apache-2.0", "you may not use this file except in compliance with the License. You may obtain a copy of the License at"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("cc-by", "licensed under CC BY 4.0"),
    ("cc-by", "licensed under a Creative Commons Attribution 4.0 International License"),
    ("cc-by-nc", "licensed under CC BY-NC 4.0"),
    ("cc-by-sa", "licensed under CC BY-SA 4.0"),
    ("gpl", "This work is licensed under the GNU General Public License, version 3"),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation"),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"),
    ("mit", "Released under the MIT License"),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction"),
    ("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License"),
    ("public-domain", "This is free and unencumbered software released into the public domain"),
    ("reserved", "All rights reserved"),
]


def words_of(text: str | bytes | None) -> list[bytes]:
    raw = text.encode() if isinstance(text, str) else text or b""
    return raw.translate(ALNUM_LOWER).split()


class Order:
    """A template's words in order, as one bit mask for each word."""

    def __init__(self, words: list[int], threshold: float):
        self.need, self.full = max(1, math.ceil(threshold * len(words) - 1e-9)), (1 << len(words)) - 1
        self.width = math.ceil(len(words) / threshold)
        self.first = frozenset(words[: len(words) - self.need + 1])  # a run that holds enough can begin at one of these
        self.masks: dict[int, int] = {}
        for i, w in enumerate(words):
            self.masks[w] = self.masks.get(w, 0) | 1 << i

    def within(self, at: list[int], ranks: list[int]) -> bool:
        """Whether a run of words holds enough of the template in order; ``at`` are the places of the template words.

        The longest common subsequence by the bit-parallel method of Allison and Dix (a sum per word).
        """
        for i, r in enumerate(ranks):
            if r not in self.first:
                continue
            v, end = self.full, at[i] + self.width
            for j in range(i, len(at)):
                if at[j] >= end:
                    break
                u = v & self.masks.get(ranks[j], 0)
                v = ((v + u) | (v - u)) & self.full
            if (self.full & ~v).bit_count() >= self.need:
                return True
        return False


class Matcher:
    """Templates in the global word order, with a prefix index for each block width."""

    def __init__(self, templates: list[tuple[str, str]], frequency: dict[bytes, int], threshold: float):
        vocabulary = {w for _, t in templates for w in words_of(t)}
        self.rank = {w: r for r, w in enumerate(sorted(vocabulary, key=lambda w: (frequency.get(w, 0), w)))}
        self.templates, self.orders = [], []
        self.by_step: dict[int, dict[int, list[tuple[int, int]]]] = {}
        for label, text in templates:
            words = words_of(text)
            order = sorted({self.rank[w] for w in words})
            if not order:
                continue
            need = max(1, math.ceil(threshold * len(order) - 1e-9))
            step = 1 << (len(words) - 1).bit_length()
            for i in range(len(order) - need + 1):
                self.by_step.setdefault(step, {}).setdefault(order[i], []).append((len(self.templates), i))
            self.templates.append((label, frozenset(order), need))
            self.orders.append(Order([self.rank[w] for w in words], threshold))
        self.prefix = {w for w, r in self.rank.items() if any(r in x for x in self.by_step.values())}
        self.least = min((need for _, _, need in self.templates), default=0)

    def block(self, step: int, ranks: list[int]) -> list[tuple[int, float]]:
        """(template, containment) of one block, given its distinct template words in order."""
        index, seen, found = self.by_step[step], set(), []
        for j, r in enumerate(ranks):
            for k, i in index.get(r, ()):
                if k in seen:
                    continue
                seen.add(k)
                _, words, need = self.templates[k]
                if len(ranks) < need or 1 + min(len(words) - i - 1, len(ranks) - j - 1) < need:
                    continue
                share = sum(x in words for x in ranks)
                if share >= need:
                    found.append((k, share / len(words)))
        return found

    def scan(self, words: list[bytes]) -> list[tuple[int, int, int, float, bool]]:
        """(template, block start, block end, containment, ordered) of every matching block."""
        if not self.prefix.intersection(words):
            return []
        rank, at, ranks = self.rank, [], []
        for i, w in enumerate(words):
            r = rank.get(w)
            if r is not None:
                at.append(i)
                ranks.append(r)
        out = []
        for step, index in self.by_step.items():
            starts = set()
            for i, r in zip(at, ranks, strict=True):  # only blocks that hold a prefix word
                if r in index:
                    starts.update((i // step * step, max(0, i // step * step - step)))
            for s in sorted(starts):
                lo, hi = bisect_left(at, s), bisect_left(at, s + 2 * step)
                for k, share in self.block(step, sorted(set(ranks[lo:hi]))):
                    out.append((k, s, min(len(words), s + 2 * step), share, self.orders[k].within(at[lo:hi], ranks[lo:hi])))
        return out


def frequencies(docs: DataFrame, vocabulary: list[bytes], text_col: str) -> dict[bytes, int]:
    """In how many documents each template word occurs; batches send one row per word."""
    shared = docs.sparkSession.sparkContext.broadcast(frozenset(vocabulary))

    def run(batches):
        for b in small(batches):
            count: dict[bytes, int] = {}
            for t in b.column(0).to_pylist():
                for w in shared.value.intersection(words_of(t)):
                    count[w] = count.get(w, 0) + 1
            yield pa.RecordBatch.from_arrays([pa.array(list(count), pa.binary()), pa.array(list(count.values()), pa.int64())], names=["w", "n"])

    rows = docs.select(F.col(text_col).cast("binary").alias("text")).mapInArrow(run, "w binary, n bigint")
    return {bytes(r.w): r.n for r in rows.groupBy("w").agg(F.sum("n").alias("n")).collect()}


def base_places(words: list[bytes]) -> list[tuple[int, str]]:
    """(start, label) of every place where a fixed phrase stands, in one pass over the text for each phrase."""
    text, out = b" " + b" ".join(words) + b" ", []
    for phrase, label in PHRASES.items():
        needle, at, counted, number = f" {phrase} ".encode(), -1, 0, 0
        while (at := text.find(needle, at + 1)) >= 0:
            number += text.count(b" ", counted, at)
            counted = at
            out.append((number, label))
    return sorted(out)


def scans(docs: DataFrame, templates: list[tuple[str, str]] = TEMPLATES, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, n_words, places array<struct<start, label>>, blocks array<struct<template, start, end, containment, ordered>>)``.

    Every row of ``docs`` is there; positions are word numbers from 0.
    """
    vocabulary = sorted({w for _, t in templates for w in words_of(t)})
    if len(vocabulary) > MAX_VOCABULARY:
        raise ValueError("too many template words for one scan; give the templates in parts")
    matcher = Matcher(templates, frequencies(docs, vocabulary, text_col), threshold)
    shared = docs.sparkSession.sparkContext.broadcast(matcher)
    place = pa.list_(pa.struct([("start", pa.int64()), ("label", pa.string())]))
    block = pa.list_(pa.struct([("template", pa.int64()), ("start", pa.int64()), ("end", pa.int64()), ("containment", pa.float64()), ("ordered", pa.bool_())]))

    def run(batches):
        for b in small(batches):
            n, places, blocks = [], [], []
            for t in b.column(1).to_pylist():
                words = words_of(t)
                n.append(len(words))
                places.append([{"start": s, "label": x} for s, x in base_places(words)])
                blocks.append([{"template": k, "start": s, "end": e, "containment": x, "ordered": o} for k, s, e, x, o in shared.value.scan(words)])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(places, place), pa.array(blocks, block)], names=["doc_id", "n_words", "places", "blocks"])

    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("binary").alias("text"))
    return rows.mapInArrow(run, "doc_id bigint, n_words bigint, places array<struct<start:bigint,label:string>>, blocks array<struct<template:bigint,start:bigint,end:bigint,containment:double,ordered:boolean>>")


def digest(docs: DataFrame, templates: list[tuple[str, str]] = TEMPLATES, **options) -> DataFrame:
    """``(doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score)``."""
    out = scans(docs, templates, **options)
    names = F.split(F.lit(",".join(x for x, _ in [t for t in templates if words_of(t[1])])), ",")
    base = F.transform("places", lambda p: p["label"])
    sure = F.filter("blocks", lambda b: b["ordered"])
    own = F.transform(sure, lambda b: F.element_at(names, (b["template"] + 1).cast("int")))
    joined = lambda a: F.array_join(F.array_sort(F.array_distinct(a)), ",")
    starts = F.transform("places", lambda p: p["start"])
    return out.select(
        "doc_id", "n_words", F.size("places").cast("bigint").alias("n_base"),
        F.array_min(starts).alias("first_word"), F.array_max(starts).alias("last_word"),
        joined(base).alias("base_labels"), joined(F.concat(base, own)).alias("labels"),
        F.coalesce(F.array_max(F.transform(sure, lambda b: b["containment"])), F.lit(0.0)).alias("score"),
    )
