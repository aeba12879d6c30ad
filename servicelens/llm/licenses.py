"""License scan by diagonal voting.

Every text becomes rolling hashes of `SIZE` words, and a Spark join brings them to the positions
where templates hold the same words. A hit votes for the diagonal (place in the text minus place in
the template); votes are counted per text, template and diagonal before anything is gathered.
Neighbouring diagonals, which insertions and deletions make, are merged, and the words of the span are
compared with the template. Short phrases go the same way and must be complete on one diagonal.

The template table is a parameter of the scan, so the broadcast side does not grow with the data.
A very frequent line costs its hits, which are summed where they arise.

Nulls and special cases: a null text is an empty one. Rows are told apart by id and text; rows equal
in both count as one for the votes and are returned as often as they occur. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from servicelens.llm.common import (alnum_words, gram_hashes, only, rolling_grams, sliced, text_key,
                                    word_hashes)

SIZE = 3
NEAR_DIAGONALS = 8              # words inserted or left out between two parts of one span
LEAST_COVER = 0.6               # share of a template's words that a span must hold

# Phrases that name a license, with its label.
PHRASES = {
    "under the mit license": "mit",
    "apache license version 2": "apache-2",
    "cc by nc": "cc-by-nc",
}

# Opening words of common license notices, with their labels.
TEMPLATES = {
    "mit": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this "
        "software and associated documentation files (the Software), to deal in the Software "
        "without restriction, including without limitation the rights to use, copy, modify, merge, "
        "publish, distribute, sublicense, and/or sell copies of the Software"),
    "apache-2": (
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file "
        "except in compliance with the License. You may obtain a copy of the License at"),
    "bsd": (
        "Redistribution and use in source and binary forms, with or without modification, are "
        "permitted provided that the following conditions are met"),
    "isc": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or "
        "without fee is hereby granted, provided that the above copyright notice and this "
        "permission notice appear in all copies"),
    "gpl": (
        "This program is free software: you can redistribute it and/or modify it under the terms "
        "of the GNU General Public License as published by the Free Software Foundation"),
    "mpl-2": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    "cc-by-4": (
        "This work is licensed under a Creative Commons Attribution 4.0 International License"),
}

_RESULT = ("doc_id bigint, n_words bigint, phrases array<struct<word:bigint,label:string>>, "
           "spans array<struct<label:string,start:bigint,end:bigint,score:double>>")
_PHRASE = pa.struct([("word", pa.int64()), ("label", pa.string())])
_SPAN = pa.struct([("label", pa.string()), ("start", pa.int64()), ("end", pa.int64()),
                   ("score", pa.float64())])


def _words(text: str) -> list[bytes]:
    return alnum_words(text.encode())


def merged_diagonals(votes: Sequence[tuple[int, list[int]]],
                     near: int = NEAR_DIAGONALS) -> list[list[tuple[int, list[int]]]]:
    """Votes sorted by diagonal, cut where two neighbours are more than `near` words apart."""
    groups: list[list[tuple[int, list[int]]]] = []
    for diagonal, places in sorted(votes):
        if groups and diagonal - groups[-1][-1][0] <= near:
            groups[-1].append((diagonal, places))
        else:
            groups.append([(diagonal, places)])
    return groups


def verified_span(words: list[bytes], template: list[bytes], size: int,
                  group: list[tuple[int, list[int]]]) -> tuple[int, int, float] | None:
    """(start, end, share of the template's words that stand on these diagonals)."""
    covered: set[int] = set()
    at: list[int] = []
    for diagonal, places in group:
        for place in places:
            for i in range(place, min(place + size, len(template))):
                if 0 <= diagonal + i < len(words) and words[diagonal + i] == template[i]:
                    covered.add(i)
                    at.append(diagonal + i)
    return (min(at), max(at) + 1, len(covered) / len(template)) if at else None


def scan(docs: DataFrame, phrases: Mapping[str, str] = PHRASES,
         templates: Mapping[str, str] = TEMPLATES, size: int = SIZE,
         least_cover: float = LEAST_COVER) -> DataFrame:
    """One row per document: doc_id, n_words, phrases (first word, label) and spans.

    Phrases are sorted by place. A span is (label, first word, word behind the last, score), for
    every place where at least `least_cover` of a template stands. Phrases need `size` words.
    """
    spark = docs.sparkSession
    known = [(label, _words(text), True) for text, label in phrases.items()]
    known += [(label, _words(text), False) for label, text in templates.items()]
    table = [(int(g), number, place) for number, (_, words, _) in enumerate(known)
             for place, g in enumerate(gram_hashes(word_hashes(words), size))]
    positions = spark.createDataFrame(table, "gram bigint, template int, place int")

    rows = (only(docs, "doc_id", "text").withColumn("doc_id", F.col("doc_id").cast("long"))
            .withColumn("text_key", text_key()))
    grams = rolling_grams(rows, [size]).select(
        "doc_id", "text_key", F.posexplode("grams").alias("at", "gram"))
    votes = (grams.join(F.broadcast(positions), "gram")
             .groupBy("doc_id", "text_key", "template", (F.col("at") - F.col("place")).alias("diagonal"))
             .agg(F.collect_set("place").alias("places")))
    found = votes.groupBy(F.col("doc_id").alias("vote_id"), F.col("text_key").alias("vote_key")).agg(
        F.collect_list(F.struct("template", "diagonal", "places")).alias("votes"))
    joined = rows.join(found, rows.doc_id.eqNullSafe(found.vote_id)
                       & (rows.text_key == found.vote_key), "left").select("doc_id", "text", "votes")

    def judged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            counts, listed, spans = [], [], []
            for text, votes_of in zip(batch.column("text").to_pylist(),
                                      batch.column("votes").to_pylist()):
                words = _words(text or "")
                counts.append(len(words))
                hits: dict[int, list[tuple[int, list[int]]]] = {}
                for vote in votes_of or ():
                    hits.setdefault(vote["template"], []).append((vote["diagonal"], vote["places"]))
                here, there = [], []
                for number, of_template in hits.items():
                    label, template, is_phrase = known[number]
                    if is_phrase:
                        here += [{"word": d, "label": label} for d, places in of_template
                                 if len(places) == len(template) - size + 1
                                 and words[d:d + len(template)] == template]
                        continue
                    for group in merged_diagonals(of_template):
                        span = verified_span(words, template, size, group)
                        if span and span[2] >= least_cover:
                            there.append(dict(zip(("label", "start", "end", "score"),
                                                  (label, *span))))
                listed.append(sorted(here, key=lambda p: p["word"]))
                spans.append(sorted(there, key=lambda s: (s["start"], s["label"])))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(counts, pa.int64()),
                 pa.array(listed, pa.list_(_PHRASE)), pa.array(spans, pa.list_(_SPAN))],
                ["doc_id", "n_words", "phrases", "spans"])

    return joined.mapInArrow(judged, _RESULT)
