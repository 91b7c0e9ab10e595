"""License scans by diagonal voting.

Every pair of neighbouring words of every text is hashed and joined to the
places where a template has that pair. A match at text place p and template
place t votes for diagonal p - t; votes are aggregated in Spark. Diagonals of
one template that lie next to each other (a word added or left out) are merged,
and what has enough votes is verified on the words of the text.

Base phrases count only where all their words stand consecutively. Statements
are longer; their label is given if at least ``COVERAGE`` of their words
appear in order in the voted span.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wardline.llm.common import Ranges, U, Words, bounded, mix, slices
from wardline.session import table

#: Base phrases and their labels.
BASE = [("cc-by", "cc by"), ("gpl", "general public license"), ("reserved", "all rights reserved")]
#: Opening words of well-known licence statements, and labels.
STATEMENTS = [
    ("apache-2.0", "licensed under the apache license version 2 0"),
    ("apache-2.0", "you may not use this file except in compliance with the license you may obtain a copy of the license at"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("cc-by-nc", "licensed under cc by nc 4 0"),
    ("cc-by-nc", "creative commons attribution noncommercial 4 0 international license"),
    ("cc-by-sa", "creative commons attribution sharealike 4 0 international license"),
    ("cc0", "the person who associated a work with this deed has dedicated the work to the public domain"),
    ("gpl-3.0", "this work is licensed under the gnu general public license version 3"),
    ("gpl-3.0", "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    ("mit", "released under the mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    ("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("unlicense", "this is free and unencumbered software released into the public domain"),
]
K = 2
COVERAGE = 0.8
#: Share of a statement's pairs that must vote before its span is verified, and how far apart merged diagonals may lie.
VOTES, NEAR = 0.5, 3

_TO_BLANK = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def words_of(text: bytes) -> bytes:
    """A-Z lower-cased; all but digits, a-z and bytes from 0x80 on blank."""
    return text.translate(_TO_BLANK)


def _pairs(w: Words, k: int) -> np.ndarray:
    h = Ranges(w.buf)(w.starts, w.ends) if len(w.starts) else np.zeros(0, dtype=np.uint64)
    n = max(len(h) - k + 1, 0)
    g = np.zeros(n, dtype=np.uint64)
    for j in range(k):
        g = g * U(0xD6E8FEB86659FD93) + h[j : j + n]
    return mix(g).view(np.int64)


def _emit(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in slices(batches):
            w = Words([words_of(t) for t in texts])
            g = _pairs(w, k)
            doc = np.repeat(np.arange(len(texts)), w.counts)
            pos = np.arange(len(w.starts)) - w.first[:-1][doc]
            inside = np.flatnonzero(doc[: len(g)] == doc[k - 1 :]) if len(g) else np.zeros(0, dtype=np.int64)
            for i in range(0, len(inside), 100_000):
                at = inside[i : i + 100_000]
                yield pa.RecordBatch.from_pydict({"row": batch.column(0).take(pa.array(doc[at])), "pos": pa.array(pos[at].astype(np.int32)), "h": pa.array(g[at])})

    return run


def _template_rows(templates: list[tuple[str, str]], k: int) -> list[tuple[int, int, int]]:
    """(pair hash, template number, place) of all templates."""
    rows = []
    for i, (_, text) in enumerate(templates):
        g = _pairs(Words([text.encode()]), k)
        rows += [(h, i, t) for t, h in enumerate(g.tolist())]
    return rows


def _in_order(template: list[bytes], span: list[bytes]) -> int:
    """Length of the longest common subsequence."""
    row = [0] * (len(span) + 1)
    for x in template:
        left = 0
        for j, y in enumerate(span):
            up = row[j + 1]
            row[j + 1] = left + 1 if x == y else max(up, row[j])
            left = up
    return row[-1]


def _verify(base: list[tuple[str, str]], statements: list[tuple[str, str]], k: int):
    phrases = [(label, text.encode().split()) for label, text in base + statements]
    nb = len(base)

    def one(text: bytes, votes: list[dict]) -> tuple:
        words = words_of(text).split()
        places, labels, found, score = [], set(), set(), 0.0
        votes = sorted((v["template"], v["diagonal"], v["votes"]) for v in votes or [])
        for template, group in groupby(votes, key=lambda v: v[0]):
            label, want = phrases[template]
            if template < nb:
                hits = [d for d in sorted({d for _, d, _ in group}) if d >= 0 and words[d : d + len(want)] == want]
                if hits:
                    places += hits
                    labels.add(label)
                    score = 1.0
                continue
            runs: list[list] = []  # first and last diagonal, votes
            for _, d, n in group:
                if runs and d - runs[-1][1] <= NEAR:
                    runs[-1][1], runs[-1][2] = d, runs[-1][2] + n
                else:
                    runs.append([d, d, n])
            for a, b, n in runs:
                if n >= VOTES * (len(want) - k + 1):
                    share = _in_order(want, words[max(a, 0) : b + len(want)]) / len(want)
                    if share >= COVERAGE:
                        found.add(label)
                        score = max(score, share)
        return len(words), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(labels)), ",".join(sorted(labels | found)), score

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in slices(batches):
            votes = batch.column(batch.schema.get_field_index("votes")).to_pylist()
            cols = list(zip(*(one(t, v) for t, v in zip(texts, votes, strict=True)), strict=True))
            kinds = [pa.int64()] * 4 + [pa.string(), pa.string(), pa.float64()]
            names = ["n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, t) for c, t in zip(cols, kinds, strict=True))], ["doc_id", *names])

    return run


def license_scan(docs: DataFrame, base: list[tuple[str, str]] = BASE, statements: list[tuple[str, str]] = STATEMENTS, k: int = K) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): n_words, n_base, first_word, last_word, base_labels, labels, score.

    n_base counts all places of base phrases; labels adds those of statements;
    score is 1 with a base phrase, else the best statement's share of words
    found, else 0. Null and empty texts: no words, empty labels, null places.
    Repeated rows and rows without doc_id are scanned like others, each for
    itself. Very long texts are scanned whole. Statements that tie give all
    their labels. Empty table: no rows. Other columns are ignored.
    """
    spark = docs.sparkSession
    templates = base + statements
    # A row's votes go by its id and text, so rows without id or with one id don't meet; what stands twice is voted on once.
    rows = bounded(docs).select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    rows = rows.select("doc_id", "text", F.xxhash64("doc_id", "text").alias("row"))
    places = spark.createDataFrame(_template_rows(templates, k), "h long, template int, place int")
    need = F.create_map(*[F.lit(x) for i, (_, t) in enumerate(templates) for x in (i, float(len(t.split()) - k + 1) * (1.0 if i < len(base) else VOTES))])
    # The templates are a fixed list of a few hundred pairs.
    matches = rows.select("row", "text").mapInArrow(_emit(k), "row long, pos int, h long").join(F.broadcast(places), "h")
    # Places vote as bits, 64 of a template at a time.
    part = F.shiftright("place", 6)
    bits = F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), F.col("place").bitwiseAND(F.lit(63))))
    diagonals = matches.groupBy("row", "template", (F.col("pos") - F.col("place")).alias("diagonal"), part.alias("part")).agg(F.bit_count(bits).cast("long").alias("votes"))
    diagonals = diagonals.filter((F.col("template") >= len(base)) | (F.col("votes") >= F.least(need[F.col("template")] - 64 * F.col("part"), F.lit(64.0))))
    voted = diagonals.groupBy("row", "template").agg(F.sum("votes").alias("n"), F.collect_list(F.struct("template", "diagonal", "votes")).alias("some")).filter(F.col("n") >= need[F.col("template")])
    by_row = voted.groupBy("row").agg(F.flatten(F.collect_list("some")).alias("votes"))
    joined = rows.join(by_row, "row", "left").select("doc_id", "text", "votes")
    return joined.mapInArrow(_verify(base, statements, k), "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan(table(spark, sf_dir, "documents"))
